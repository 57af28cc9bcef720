"""Chunkers: from a text to line-addressed pieces, as table-generating functions over Arrow batches.

A piece is (start_line, end_line, text), lines from 1 and both included. The pure functions work on one text; chunk() applies
one to a DataFrame and adds chunk ids.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from json import JSONDecoder

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrow import front_matter_of

Piece = tuple[int, int, str]
LINK = re.compile(r"!?\[\[([^\[\]|#\n]+?)(?:#[^\[\]|\n]+)?(?:\|[^\[\]\n]+)?\]\]")


# -- bytes -------------------------------------------------------------------


def link_spans(text: str) -> list[tuple[int, int]]:
    """Byte ranges of the links of a text."""
    spans, at, done = [], 0, 0
    for m in LINK.finditer(text):
        if m[1].strip():
            at += len(text[done : m.start()].encode())
            spans.append((at, at + len(m[0].encode())))
            at, done = spans[-1][1], m.end()
    return spans


def by_bytes(text: str, size: int = 10_000, overlap: int = 100, links: bool = True) -> list[Piece]:
    """Windows of `size` bytes that overlap by `overlap`. A cut inside a link moves before it if the piece keeps half of its size, and
    an overlap that would begin in a link begins after it. Parts of characters at a cut are dropped."""
    size, overlap = max(100, size), max(4, overlap)
    raw = text.encode()
    breaks = [i for i, b in enumerate(raw) if b == 10]
    spans = link_spans(text) if links else []
    begins = [a for a, _ in spans]

    def inside(at: int) -> tuple[int, int] | None:
        k = bisect_right(begins, at) - 1
        return spans[k] if k >= 0 and spans[k][0] < at < spans[k][1] else None

    out, a = [], 0
    while a < len(raw):
        b = min(a + size, len(raw))
        if b < len(raw) and (span := inside(b)) and span[0] - a >= size // 2:
            b = span[0]
        last = bisect_right(breaks, b - 1) + 1 - (raw[b - 1] == 10)
        out.append((bisect_right(breaks, a - 1) + 1, last, raw[a:b].decode("utf-8", "ignore")))
        if b == len(raw):
            break
        onward = b - overlap
        if span := inside(onward):
            onward = span[1]
        a = onward if onward > a else b
    return out


# -- lines -------------------------------------------------------------------


def framed(text: str) -> list[str]:
    """Lines with their LF; other separators are no line ends."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def line_windows(sizes: list[int], most: int, overlap: int = 0, most_lines: int | None = None) -> list[tuple[int, int]]:
    """Half-open ranges of lines that hold `most` at most; each begins with as many last lines of the one before as `overlap` holds."""
    out, a, n = [], 0, len(sizes)
    while a < n:
        b, total = a, 0
        while b < n and total + sizes[b] <= most and (most_lines is None or b - a < most_lines):
            total += sizes[b]
            b += 1
        b = max(b, a + 1)
        out.append((a, b))
        if b == n:
            break
        back, shared = b, 0
        while back > a and shared + sizes[back - 1] <= overlap:
            back -= 1
            shared += sizes[back]
        a = back if back > a else b
    return out


def by_lines(text: str, most: int = 2000, overlap: int = 0, most_lines: int | None = None, unit: str = "chars") -> list[Piece]:
    """Whole lines, packed up to `most` characters or bytes; a longer line is a piece of its own."""
    if unit not in ("chars", "bytes"):
        raise ValueError(f"unit is chars or bytes, not {unit!r}")
    if not text.strip():
        return []
    own = framed(text)
    sizes = [len(x.encode()) if unit == "bytes" else len(x) for x in own]
    return [(a + 1, b, "".join(own[a:b])) for a, b in line_windows(sizes, max(64, most), max(0, overlap), None if most_lines is None else max(1, most_lines))]


# -- JSON --------------------------------------------------------------------

BLANK = re.compile(r"[ \t\n\r]*")


@dataclass
class Leaf:
    """A value that isn't taken apart, with the way to it (keys and places) and its lines."""

    way: tuple
    value: object
    size: int
    first: int
    last: int


class JsonReader:
    """Finds a JSON text's leaves: scalars, empty containers, and containers whose compact form is short enough."""

    def __init__(self, text: str, small: int):
        self.text, self.small = text, small
        self.decoder = JSONDecoder()
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1

    def skip(self, at: int) -> int:
        return BLANK.match(self.text, at).end()

    def read(self, at: int, way: tuple) -> tuple[object, list[Leaf], int]:
        """The value at a place, its leaves, and the place after it."""
        at = self.skip(at)
        opening = self.text[at]
        if opening not in "{[":
            value, end = self.decoder.raw_decode(self.text, at)
            return value, [self.leaf(way, value, at, end)], end
        keyed, end, place = opening == "{", self.skip(at + 1), 0
        value: dict | list = {} if keyed else []
        leaves: list[Leaf] = []
        while self.text[end] not in "}]":
            step: object = place
            if keyed:
                step, end = self.decoder.raw_decode(self.text, end)
                end = self.skip(end) + 1
            child, under, end = self.read(end, (*way, step))
            if keyed:
                value[step] = child
            else:
                value.append(child)
            leaves += under
            place += 1
            end = self.skip(end)
            if self.text[end] == ",":
                end = self.skip(end + 1)
        end += 1
        whole = self.leaf(way, value, at, end)
        return value, [whole] if not value or whole.size <= self.small else leaves, end

    def leaf(self, way: tuple, value: object, at: int, end: int) -> Leaf:
        return Leaf(way, value, len(json.dumps(value, ensure_ascii=False)), self.line(at), self.line(end))


def regrown(leaves: list[Leaf]) -> object:
    """The smallest value that holds the leaves on their ways; places in arrays close up."""
    if not leaves[0].way:
        return leaves[0].value
    groups: dict[object, list[Leaf]] = {}
    for leaf in leaves:
        groups.setdefault(leaf.way[0], []).append(Leaf(leaf.way[1:], leaf.value, leaf.size, leaf.first, leaf.last))
    grown = {step: regrown(own) for step, own in groups.items()}
    return grown if isinstance(leaves[0].way[0], str) else list(grown.values())


def added_size(before: tuple | None, leaf: Leaf) -> int:
    """Characters that a leaf adds to the compact form of those before it: its own and those of the containers that its way opens."""
    same = 0
    if before is not None:
        while same < min(len(before), len(leaf.way)) and before[same] == leaf.way[same]:
            same += 1
    total = leaf.size + (2 if before is not None else 0)
    for depth, step in enumerate(leaf.way):
        if depth > same or before is None:
            total += 2  # the brackets of a container that is new
        if depth >= same and isinstance(step, str):
            total += len(json.dumps(step, ensure_ascii=False)) + 2
    return total


def by_json(text: str, most: int = 2000) -> list[Piece]:
    """Pieces that are JSON values with the original's nesting, up to `most` characters; what isn't JSON is packed by lines."""
    most = max(256, most)
    if not text.strip():
        return []
    try:
        json.loads(text)
        _, leaves, _ = JsonReader(text, max(64, int(most * 0.05))).read(0, ())
    except (ValueError, RecursionError):
        return loose_lines(text, most)
    out, own, size = [], [], 0

    def flush() -> None:
        out.append((own[0].first, own[-1].last, json.dumps(regrown(own), ensure_ascii=False)))

    for leaf in leaves:
        more = added_size(own[-1].way if own else None, leaf)
        if own and size + more > most:
            flush()
            own, size, more = [], 0, added_size(None, leaf)
        own.append(leaf)
        size += more
    flush()
    return out


def loose_lines(text: str, most: int) -> list[Piece]:
    own = framed(text)
    return [(a + 1, b, "".join(own[a:b])) for a, b in line_windows([len(x) for x in own], most)]


# -- Markdown ----------------------------------------------------------------

ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})(.*)$")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:[ \t]|$)")
RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


@dataclass
class Block:
    """A heading (level over 0), or one paragraph, code block, table, list or quote."""

    first: int
    last: int
    text: str
    level: int = 0
    parts: list[tuple[int, int, str]] = field(default_factory=list)  # units that a long block splits into
    wrap: tuple[str, str] = ("", "")  # what each of its splits is put into
    blank_parts: bool = False  # whether empty units are text too


class MarkdownReader:
    """Cuts a Markdown text into blocks."""

    def __init__(self, text: str, offset: int):
        self.lines, self.offset = [x.removesuffix("\r") for x in text.split("\n")], offset

    def number(self, i: int) -> int:
        return i + 1 + self.offset

    def begins_block(self, i: int) -> bool:
        line = self.lines[i]
        return bool(ATX.match(line) or FENCE.match(line) or RULE.match(line) or re.match(r" {0,3}>", line))

    def blocks(self) -> Iterator[Block]:
        i, n = 0, len(self.lines)
        while i < n:
            line = self.lines[i]
            if not line.strip():
                i += 1
            elif m := ATX.match(line):
                yield self.heading(i, i, len(m[1]), (m[2] or "").strip())
                i += 1
            elif m := FENCE.match(line):
                i, block = self.code(i, m)
                yield block
            elif RULE.match(line) and not UNDERLINE.match(line):
                yield self.text_block(i, i + 1)
                i += 1
            elif ITEM.match(line):
                i, block = self.items(i)
                yield block
            elif i + 1 < n and "|" in line and "-" in self.lines[i + 1] and DELIMITER.match(self.lines[i + 1]) and "|" in self.lines[i + 1]:
                i, block = self.table(i)
                yield block
            else:
                i, block = self.paragraph(i)
                yield block

    def heading(self, a: int, b: int, level: int, title: str) -> Block:
        return Block(self.number(a), self.number(b), f"{'#' * level} {title}", level)

    def text_block(self, a: int, b: int) -> Block:
        return Block(self.number(a), self.number(b - 1), "\n".join(self.lines[a:b]), parts=[(self.number(i), self.number(i), self.lines[i]) for i in range(a, b)])

    def code(self, i: int, m: re.Match) -> tuple[int, Block]:
        end, n = i + 1, len(self.lines)
        close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
        while end < n and not close.match(self.lines[end]):
            end += 1
        closed = end < n
        inner = self.lines[i + 1 : end]
        while inner and not closed and not inner[-1]:
            inner.pop()
        fence = m[1] + m[2]
        block = Block(self.number(i), self.number(end if closed else i + len(inner)), "\n".join([self.lines[i], *inner, fence]), wrap=(self.lines[i] + "\n", "\n" + fence), blank_parts=True)
        block.parts = [(self.number(i + 1 + k), self.number(i + 1 + k), x) for k, x in enumerate(inner)]
        return end + closed, block

    def table(self, i: int) -> tuple[int, Block]:
        end = i + 2
        while end < len(self.lines) and self.lines[end].strip() and not self.begins_block(end):
            end += 1
        block = self.text_block(i, end)
        block.wrap = ("\n".join(self.lines[i : i + 2]) + "\n", "")
        block.parts = block.parts[2:]
        return end, block

    def items(self, i: int) -> tuple[int, Block]:
        mark = ITEM.match(self.lines[i])[2]
        kind = mark if mark in "-+*" else mark[-1]
        starts, end, n = [i], i + 1, len(self.lines)
        while end < n:
            line = self.lines[end]
            m = ITEM.match(line)
            if m and (m[2] if m[2] in "-+*" else m[2][-1]) == kind and len(m[1]) < 2:
                starts.append(end)
            elif not line.strip():
                follow = next((k for k in range(end, n) if self.lines[k].strip()), n)
                nested = follow < n and (self.lines[follow].startswith(("  ", "\t")) or ((f := ITEM.match(self.lines[follow])) and (f[2] if f[2] in "-+*" else f[2][-1]) == kind))
                if not nested:
                    break
            elif not line.startswith((" ", "\t")) and (self.begins_block(end) or m or not self.lines[end - 1].strip()):
                break
            end += 1
        while not self.lines[end - 1].strip():
            end -= 1
        block = self.text_block(i, end)
        block.parts = []
        for a, b in zip(starts, [*starts[1:], end], strict=True):
            while not self.lines[b - 1].strip():
                b -= 1
            block.parts.append((self.number(a), self.number(b - 1), "\n".join(self.lines[a:b])))
        return end, block

    def paragraph(self, i: int) -> tuple[int, Block]:
        end = i + 1
        while end < len(self.lines) and self.lines[end].strip():
            if (m := UNDERLINE.match(self.lines[end])) and not self.lines[i].lstrip().startswith(">"):
                title = " ".join(x.strip() for x in self.lines[i:end]) if end - i == 1 else self.lines[i].strip()
                return end + 1, self.heading(i, end, 1 if m[1][0] == "=" else 2, title)
            if self.begins_block(end) or (ITEM.match(self.lines[end]) and not re.match(r" {0,3}\d", self.lines[end])):
                break
            end += 1
        return end, self.text_block(i, end)


GAP = "\n\n"


class Outline:
    """Blocks in a row, as an outline: a heading's section runs to the next heading that isn't deeper. What a range of blocks takes comes
    from prefix sums, so no text is put together before it is cut."""

    def __init__(self, blocks: list[Block], size: int, breadcrumbs: bool):
        self.blocks, self.size = blocks, size
        self.upto = [0]
        for b in blocks:
            self.upto.append(self.upto[-1] + len(b.text.encode()) + len(GAP))
        self.end, self.above = [i + 1 for i in range(len(blocks))], []
        open_: list[int] = []
        for i, b in enumerate(blocks):
            while b.level and open_ and blocks[open_[-1]].level >= b.level:
                self.end[open_.pop()] = i
            self.above.append(tuple(open_) if breadcrumbs else ())
            if b.level:
                open_.append(i)
        for i in open_:
            self.end[i] = len(blocks)

    def bytes(self, a: int, b: int) -> int:
        return self.upto[b] - self.upto[a] - len(GAP)

    def crumbs(self, i: int, n: int) -> tuple[int, ...]:
        """As many of the nearest headings over block i as fit before n bytes."""
        above = self.above[i]
        while above and n + sum(self.upto[k + 1] - self.upto[k] for k in above) > self.size:
            above = above[1:]
        return above

    def ranges(self) -> Iterator[tuple[int, int]]:
        """Cuts the row into ranges. A section that fits stays whole, and neighbours share a range as long as they fit under the first one's
        crumbs. A section that doesn't fit is entered: its heading begins a range, and no range reaches beyond its end. A block that doesn't
        fit is a range that is too long."""
        a = b = 0  # the open range
        walls = [len(self.blocks)]
        i = 0
        while i < len(self.blocks):
            end = self.end[i]
            while i >= walls[-1]:
                walls.pop()
                if a < b:
                    yield a, b
                a = b = i
            whole = self.bytes(i, end) <= self.size
            upto = end if whole else i + 1
            room = self.size - sum(self.upto[k + 1] - self.upto[k] for k in self.crumbs(a, self.bytes(a, b))) if a < b else 0
            joins = whole and a < b and self.bytes(a, upto) <= room
            if not joins:
                if a < b:
                    yield a, b
                a = i
            b = upto
            if not whole and end > i + 1:
                walls.append(end)
            i = upto
        if a < b:
            yield a, b

    def pieces(self) -> Iterator[Piece]:
        for a, b in self.ranges():
            own = self.blocks[a:b]
            if b == a + 1 and self.bytes(a, b) > self.size and own[0].parts:
                yield from self.split(a)
            else:
                lead = [self.blocks[k].text for k in self.crumbs(a, self.bytes(a, b))]
                yield own[0].first, own[-1].last, GAP.join([*lead, *(x.text for x in own)])

    def split(self, i: int) -> Iterator[Piece]:
        """A long block in parts that repeat its frame (a table's head, a code's fence) and tell their number. A unit that is too long for a
        part is one by itself."""
        block = self.blocks[i]
        units = [u for u in block.parts if u[2] or block.blank_parts]
        sizes = [len(t.encode()) + 1 for _, _, t in units]
        label = "[Part {}/{}]" + GAP
        frame = len("".join(block.wrap).encode()) + (len(label.format(len(units), len(units))) if len(units) > 1 else 0)
        lead = self.crumbs(i, frame + min(max(sizes, default=0), self.size // 2))
        room = self.size - frame - sum(self.upto[k + 1] - self.upto[k] for k in lead)
        cuts = line_windows(sizes, room + 1)
        for k, (a, b) in enumerate(cuts, 1):
            body = block.wrap[0] + "\n".join(t for _, _, t in units[a:b]) + block.wrap[1]
            yield units[a][0], units[b - 1][1], GAP.join([*(self.blocks[j].text for j in lead), (label.format(k, len(cuts)) if len(cuts) > 1 else "") + body])


def by_markdown(text: str, size: int = 10_000, overlap: int = 100, breadcrumbs: bool = True, most_headings: int | None = 100) -> list[Piece]:
    """Sections and blocks packed up to `size` bytes, under the headings above them; byte windows where there are very many headings."""
    size = max(100, size)
    _, body, offset = front_matter_of(text)
    if not body.strip():
        return []
    blocks = [b for b in MarkdownReader(body, offset).blocks() if b.text]
    if most_headings is not None and sum(b.level > 0 for b in blocks) > max(0, most_headings):
        return [(a + offset, b + offset, t) for a, b, t in by_bytes(body, size, overlap)]
    return list(Outline(blocks, size, breadcrumbs).pieces())


def by_default(text: str, path: str = "", size: int = 10_000, overlap: int = 100) -> list[Piece]:
    """Byte windows; links and front matter are looked at in Markdown files only."""
    if not path.lower().endswith(".md"):
        return by_bytes(text, size, overlap, links=False)
    if text.startswith("---") and (end := text.find("\n---", 3)) >= 0:
        text = text[end + 4 :].lstrip("\n")
    return by_bytes(text, size, overlap)


# -- on DataFrames -----------------------------------------------------------

KINDS: dict[str, Callable[..., list[Piece]]] = {"default": by_default, "markdown": by_markdown, "json": by_json, "jsonl": by_lines}
#: Which chunker a file's extension gets, in this order.
BY_SUFFIX = {".md": "markdown", ".json": "json", ".jsonl": "jsonl"}
CHUNKS = "path string, chunk_index int, start_line int, end_line int, text string"


def kind_of(path: X.Col):
    out = None
    for suffix, kind in BY_SUFFIX.items():
        test = F.lower(X.col(path)).endswith(suffix)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("default")


def chunk(files: DataFrame, kind: str | None = None, path: str = "path", text: str = "text", **options: object) -> DataFrame:
    """path, chunk_index, start_line, end_line, text, id of every file's chunks. kind: one of KINDS, else each file's own."""
    for name in {kind} - {None}:
        if name not in KINDS:
            raise ValueError(f"no chunker {name!r}")
    rows = files.select(files[path].cast("string").alias("path"), files[text].cast("string").alias("text"), (F.lit(kind) if kind else kind_of(files[path])).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for p, t, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = KINDS[k](t or "", p or "", **options) if k == "default" else KINDS[k](t or "", **(options if kind else {}))
                out += [(p, i, a, b, x) for i, (a, b, x) in enumerate(own)]
                held += sum(len(x) for _, _, x in own)
                if held > 4 << 20:
                    yield rows_of(out)
                    out, held = [], 0
            if out:
                yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        p, i, a, b, x = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(i, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(x, pa.string())], names=["path", "chunk_index", "start_line", "end_line", "text"])

    return rows.mapInArrow(run, CHUNKS).withColumn("id", X.chunk_id("path", "start_line", "end_line", "text"))


def byte_windows(files: DataFrame, path: str = "path", text: str = "text", size: int = 10_000, overlap: int = 100) -> DataFrame:
    """The windows of texts without links, in the JVM: path, chunk_index, start_byte, n_bytes, n_newlines before the window."""
    raw = F.col(text).cast("binary")
    step = size - overlap
    n = F.octet_length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return files.select(F.col(path).alias("path"), raw.alias("raw"), n.alias("n"), F.explode(starts).alias("chunk_index")).select(
        "path", "chunk_index", (F.col("chunk_index") * step).alias("start_byte"), F.least(F.lit(size), F.col("n") - F.col("chunk_index") * step).alias("n_bytes"),
    )
