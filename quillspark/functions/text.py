"""Column functions on texts, paths, links, dates and anchors."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str

#: One wikilink: bang, target, anchor, alias.
WIKILINK = r"(!?)\[\[([^\[\]|#\n]+?)(#[^\[\]|\n]+)?(\|[^\[\]\n]+)?\]\]"
CJK = "[一-鿿]"
#: A CJK character, or a word of two or more other characters.
TOKEN = r"[一-鿿]|[\p{L}\p{N}_&&[^一-鿿]]{2,}"
#: Extensions that are read as images, with their types.
IMAGE_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".gif": "image/gif", ".bmp": "image/bmp", ".tiff": "image/tiff", ".heic": "image/heic"}


def col(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(text: str) -> str:
    """text as a part of a Java or RE2 pattern that matches it alone."""
    return "".join(c if c.isalnum() or c in "_ /" or ord(c) > 127 else f"\\{c}" for c in text)


# -- tokens ------------------------------------------------------------------


def tokens(text: Col, stopwords: Iterable[str] | None = None, lower: bool = True) -> Column:
    """CJK characters one by one, then words of two or more characters; stop words left out."""
    text = F.coalesce(col(text), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    found = F.when(text.rlike(CJK), F.concat(F.filter(found, lambda t: t.rlike(CJK)), F.filter(found, lambda t: ~t.rlike(CJK)))).otherwise(found)
    found = F.transform(found, F.lower) if lower else found
    stop = sorted(set(stopwords or ()))
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def token_estimate(text: Col) -> Column:
    """Tokens that a text may have: its UTF-8 bytes over four, rounded half up."""
    return (F.octet_length(col(text)) / 4 + 0.5).cast("int")


# -- hashes ------------------------------------------------------------------


def chunk_id(path: Col, start: Col, end: Col, text: Col) -> Column:
    return F.sha2(F.concat_ws(" ", col(path), col(start).cast("string"), col(end).cast("string"), col(text)), 256)


def short_hash(text: Col) -> Column:
    return F.left(F.sha1(col(text)), F.lit(8))


def url_uuid(text: Col) -> Column:
    """The name-based (version 5) UUID of a text in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(col(text), "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


# -- paths and dates ---------------------------------------------------------


def date_in_path(path: Col) -> Column:
    """The day that the second segment of a path names, as a directory or as a Markdown file; else null."""
    day = F.regexp_extract(col(path), r"^[^/]+/(\d{4}-\d{2}-\d{2})(?:\.md$|/|$)", 1)
    return F.when(F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day)


def layer_of_path(path: Col) -> Column:
    return F.substring_index(col(path), "/", 1)


def leading_date(value: Col) -> Column:
    """The day that a value's first ten characters give, else null."""
    day = F.left(F.trim(col(value).cast("string")), F.lit(10))
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day)


def exact_date(value: Col) -> Column:
    return F.when(F.length(F.trim(col(value).cast("string"))) == 10, leading_date(value))


def lenient_date(value: Col) -> Column:
    """As leading_date, and months and days without a leading zero."""
    text = F.trim(col(value).cast("string"))
    loose = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.date_format(F.try_to_date(text, "yyyy-M-d"), "yyyy-MM-dd"))
    return F.coalesce(leading_date(value), loose)


def iso_week(day: Col) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), col(day)).cast("int"), F.weekofyear(col(day)))


def month_label(day: Col) -> Column:
    return F.date_format(col(day), "yyyy-MM")


def session_time(text: Col) -> Column:
    """2023/05/20 (Sat) 02:21"""
    parts = F.regexp_replace(col(text), r"\s*\([A-Za-z]+\)\s*", " ")
    return F.try_to_timestamp(parts, F.lit("yyyy/MM/dd HH:mm"))


def anchor_day(text: Col) -> Column:
    """March-15-2024 or Mar-15-2024"""
    return F.coalesce(F.try_to_date(col(text), "MMMM-d-yyyy"), F.try_to_date(col(text), "MMM-d-yyyy"))


def iso_seconds(text: Col) -> Column:
    """An ISO-8601 time that names seconds; dates alone and minutes are null."""
    text = F.trim(col(text).cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), F.try_to_timestamp(text))


def normal_path(path: Col) -> Column:
    """Forward slashes, no empty or `.` segments, `..` taken back where there is something to take back."""
    parts = F.filter(F.split(F.replace(F.trim(col(path)), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    up = lambda acc: F.when((F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(F.lit(".."))))
    walked = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.when(col(path).startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(walked, "/"))


#: Names of devices, which some file systems keep for themselves whatever the extension.
DEVICES = ["CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10))]
#: Characters that some file systems don't allow in names.
FORBIDDEN = '<>:"/\\|?*'


def name_error(name: Col, kind: str = "filename") -> Column:
    """The first rule of portable file names that a name breaks, or null: there is one, it is no step in a path, it has no blanks around it, no
    control or forbidden characters, no final dot, and isn't a device."""
    name = col(name)
    banned = f"[\\x00-\\x1f{re.escape(FORBIDDEN)}]"
    broken = [
        (F.coalesce(name, F.lit("")) == "", "is empty"),
        (name.rlike(r"^\.{1,2}$"), "is a step in a path, not a name"),
        (name.rlike(r"^\s|\s$"), "has blanks around it"),
        (F.regexp_replace(name, banned, "") != name, "has a character that names can't have"),
        (name.like("%."), "has a dot at its end"),
        (F.substring_index(F.upper(name), ".", 1).isin(DEVICES), "is the name of a device"),
    ]
    found = F.array(*[F.when(test, F.concat_ws(" ", F.lit(kind), F.when(name != "", F.concat(F.lit("'"), name, F.lit("'"))), F.lit(why))) for test, why in broken])
    return F.get(F.filter(found, lambda e: e.isNotNull()), F.lit(0))


def path_error(path: Col) -> Column:
    """What is wrong with a path inside the workspace, or null."""
    path = col(path)
    depth = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, p: F.struct((a["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(p == "..", -1).otherwise(0)).alias("low")))
    return (
        F.when(path.isNull() | (F.trim(path) == ""), F.lit("path is required"))
        .when(path.startswith("~"), F.concat(F.lit("file does not exist: "), path))
        .when(path.startswith("/"), F.lit("path must be relative"))
        .when(depth["low"] < 0, F.lit("path must stay inside the workspace"))
        .otherwise(first_error(path))
    )


def first_error(path: Column) -> Column:
    errors = F.filter(F.transform(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", "..")), lambda p: name_error(p, "path component")), lambda e: e.isNotNull())
    return F.get(errors, F.lit(0))


def under(path: Col, scope: str) -> Column:
    """The path is the scope or lies in it."""
    scope = scope.strip("/")
    return F.lit(True) if not scope else (col(path) == scope) | col(path).startswith(scope + "/")


def allowed_path(path: Col, allowed: list[str] | None) -> Column:
    """Nothing named: all is allowed. An empty list allows nothing; entries of a home directory count as none."""
    if allowed is None:
        return F.lit(True)
    out = F.lit(False)
    for scope in allowed:
        if not scope.strip().startswith("~"):
            out = out | under(path, scope)
    return out


def with_markdown_suffix(path: Col) -> Column:
    name = F.substring_index(col(path), "/", -1)
    return F.when(F.instr(F.substring(name, F.lit(2), F.length(name)), ".") == 0, F.concat(col(path), F.lit(".md"))).otherwise(col(path))


def suffix(path: Col) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(col(path), "/", -1), r".(\.[^.]*)$", 1))


def image_type(path: Col) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in IMAGE_TYPES.items() for x in kv]), suffix(path))


def resource_parts(path: Col, root: str = "resource") -> Column:
    """Of root/day/name the day and name; of root/name the loose name."""
    rest = F.regexp_extract(col(path), rf"^{literal(root)}/(.*)$", 1)
    day = F.regexp_extract(rest, r"^(\d{4}-\d{2}-\d{2})(?:/|$)", 1)
    return F.struct(
        day.alias("day"),
        F.when(day != "", F.regexp_extract(rest, r"^[^/]+/(.+)$", 1)).otherwise("").alias("name"),
        F.when((rest != "") & (F.instr(rest, "/") == 0) & ~rest.isin(".", ".."), rest).otherwise("").alias("loose"),
    )


def note_name(raw: Col, fallback: Col) -> Column:
    """A safe file name made from a title; from the fallback where nothing is left; from a hash where that is reserved."""
    unsafe = r'[<>:"/\\|?*\x00-\x1f]+'
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(col(x), F.lit(""))), unsafe, "-"), r"\s+", " "), F.lit(" ."))
    name = F.when(clean(raw) != "", clean(raw)).otherwise(clean(fallback))
    hashed = F.concat(F.lit("resource-"), short_hash(F.coalesce(F.nullif(col(fallback), F.lit("")), F.nullif(col(raw), F.lit("")), F.lit("note"))))
    return F.when(name_error(name).isNull(), name).otherwise(hashed)


# -- links -------------------------------------------------------------------


def wikilinks(text: Col) -> Column:
    """Links in order without repetition: array of (target, anchor)."""
    text = F.coalesce(col(text), F.lit(""))
    group = lambda i: F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(i))
    pairs = F.arrays_zip(group(2).alias("target"), group(3).alias("anchor"))
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    links = F.transform(pairs, lambda p: F.struct(trim(p["target"]).alias("target"), F.when(p["anchor"] != "", trim(F.substring(p["anchor"], F.lit(2), F.length(p["anchor"])))).alias("anchor")))
    return F.array_distinct(F.filter(links, lambda p: p["target"] != ""))


def link_pattern(target: str) -> str:
    return rf"(!?)\[\[\s*{literal(target)}\s*(#[^\[\]|\n]+)?(\|[^\[\]\n]+)?\]\]"


def link_count(text: Col, target: str) -> Column:
    return F.regexp_count(F.coalesce(col(text), F.lit("")), F.lit(link_pattern(target)))


def retarget(text: Col, old: str, new: str) -> Column:
    """Links to old lead to new; bang, anchor and alias stay."""
    return F.regexp_replace(col(text), link_pattern(old), "$1[[" + new.replace("\\", "\\\\").replace("$", "\\$") + "$2$3]]")


def plain_hybrid_links(text: Col) -> Column:
    """[[a]](a) becomes [[a]] where the destination repeats the link's target, with or without its anchor."""
    text = F.regexp_replace(col(text), r"(\[\[\s*([^\[\]|\n]+?)\s*(?:\|[^\[\]\n]*)?\]\])\(\s*<?\s*\2\s*>?\s*\)", "$1")
    return F.regexp_replace(text, r"(\[\[\s*([^\[\]|#\n]+?)\s*(?:#[^\[\]|\n]*)?(?:\|[^\[\]\n]*)?\]\])\(\s*<?\s*\2\s*>?\s*\)", "$1")


# -- line anchors ------------------------------------------------------------


def merge_ranges(ranges: Col) -> Column:
    """Sorted ranges (low, high) with those that overlap or touch joined."""
    kind = "array<struct<low:int,high:int>>"
    pair = lambda a, b: F.struct(a.cast("int").alias("low"), b.cast("int").alias("high"))

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(pair(last["low"], F.greatest(last["high"], r["high"]))))
        return F.when((F.size(acc) > 0) & (r["low"] <= F.get(acc, F.size(acc) - 1)["high"] + 1), F.when(F.size(acc) > 0, joined)).otherwise(F.concat(acc, F.array(pair(r["low"], r["high"]))))

    items = F.array_sort(F.transform(col(ranges), lambda r: pair(r["low"], r["high"])))
    return F.aggregate(items, F.array().cast(kind), lambda acc, r: step(acc, r).cast(kind))


def line_ranges(anchor: Col) -> Column:
    """Ranges of L9, L9-L10 or L9-L10,L15-L20, merged; null for what isn't a line anchor; an error for a bad one."""
    anchor = col(anchor)
    numbers = F.transform(F.split(anchor, ","), lambda p: F.transform(F.split(F.replace(p, F.lit("L"), F.lit("")), "-"), lambda n: F.try_to_number(n, F.lit("999999999")).cast("int")))
    pairs = F.transform(numbers, lambda n: F.struct(F.get(n, F.lit(0)).alias("low"), F.coalesce(F.get(n, F.lit(1)), F.get(n, F.lit(0))).alias("high")))
    bad = F.exists(pairs, lambda r: r["low"].isNull() | (r["low"] < 1) | (r["low"] > r["high"]))
    return (
        F.when(anchor.isNull() | ~anchor.rlike(r"^L[0-9]"), F.lit(None))
        .when(~anchor.rlike(r"^L[0-9]+(-L[0-9]+)?(,L[0-9]+(-L[0-9]+)?)*$") | bad, F.raise_error(F.concat(F.lit("invalid line anchor: #"), anchor)))
        .otherwise(merge_ranges(pairs))
    )


def line_anchor(ranges: Col) -> Column:
    return F.array_join(F.transform(col(ranges), lambda r: F.when(r["low"] == r["high"], F.concat(F.lit("L"), r["low"].cast("string"))).otherwise(F.concat(F.lit("L"), r["low"].cast("string"), F.lit("-L"), r["high"].cast("string")))), ",")


# -- lines -------------------------------------------------------------------


def lines(text: Col) -> Column:
    """Lines by LF; the last newline ends a line and begins none."""
    text = F.coalesce(col(text), F.lit(""))
    parts = F.split(text, "\n")
    return F.when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).when(text == "", F.array().cast("array<string>")).otherwise(parts)


def line_slice(text: Col, start: int | None = None, end: int | None = None) -> Column:
    """Lines start to end (from 1, both included), clamped to what is there; an error past the end or when they cross."""
    own = lines(text)
    low = max(1, start or 1)
    high = F.least(F.size(own), F.lit(end)) if end is not None else F.size(own)
    return (
        F.when(F.size(own) < low, F.raise_error(F.concat(F.lit(f"line {low} is past the end: "), F.size(own).cast("string"))))
        .when(high < low, F.raise_error(F.lit("the range ends before it starts")))
        .otherwise(F.array_join(F.slice(own, F.lit(low), high - low + 1), "\n"))
    )


# -- small formats -----------------------------------------------------------


def topic_key(title: Col) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), "[^a-z0-9一-鿿]+", " "))


def verdict(reply: Col) -> Column:
    """yes or no where a reply begins so, else the reply in lower case."""
    said = F.lower(F.regexp_extract(col(reply), r"(?i)^\s*(yes|no)\b", 1))
    return F.when(said != "", said).otherwise(F.lower(F.trim(col(reply))))


def fenced_json(reply: Col) -> Column:
    """The JSON part of a reply: inside a fence, or all of it if it is JSON, or the first object or array in it; else null."""
    reply = F.trim(col(reply))
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\[.*\]|\{.*\})\s*```", 1)
    whole = F.when(reply.startswith("```") & (fenced != ""), F.trim(fenced)).otherwise(reply)
    part = F.regexp_extract(whole, r"(?s)(\{.*?\}|\[.*?\])", 1)
    valid = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(valid(whole), whole).when((part != "") & valid(part), part)


def injected_only(text: Col, tags: Iterable[str], least: int = 16) -> Column:
    """A text that begins with one of the tags and has under `least` characters outside of such blocks."""
    text = F.trim(col(text))
    rest = F.trim(F.regexp_replace(text, r"(?s)<([a-z-]+)>.*?</\1>", ""))
    starts = F.lit(False)
    for tag in tags:
        starts = starts | text.startswith(tag)
    return starts & (F.length(rest) < least)


def flat_line(speaker: Col, at: Col, text: Col) -> Column:
    """[speaker @ time] text, on one line."""
    body = F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))
    return F.rtrim(F.concat(F.lit("["), col(speaker), F.lit(" @ "), col(at), F.lit("] "), body))


def human_bytes(size: Col) -> Column:
    size, out = col(size).cast("double"), None
    for power, unit in enumerate(("B", "KiB", "MiB", "GiB", "TiB")):
        said = F.format_string("%d B", size.cast("long")) if not power else F.format_string(f"%.2f {unit}", F.bround(size / 1024.0**power, 2))
        if unit == "TiB":
            return out.otherwise(said)
        test = F.abs(size) < 1024.0 ** (power + 1)
        out = F.when(test, said) if out is None else out.when(test, said)


def tick_step(most: Col, ticks: int = 5) -> Column:
    """A readable interval: 1, 2, 5 or 10 times a power of ten."""
    rough = F.greatest(col(most), F.lit(1)) / ticks
    size = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    share = rough / size
    return F.greatest(F.lit(1.0), size * F.when(share <= 1, 1).when(share <= 2, 2).when(share <= 5, 5).otherwise(10))


#: Names of settings that are masked, and how such names end.
SECRET_KEYS = ("api_key", "app_secret", "authorization", "cookie", "password", "private_key", "proxy_authorization", "secret", "set_cookie", "token")
SECRET_ENDS = ("_access_key", "_api_key", "_password", "_private_key", "_secret", "_token")


def secret_key(key: Col) -> Column:
    name = F.lower(F.replace(col(key), F.lit("-"), F.lit("_")))
    out = name.isin(*SECRET_KEYS)
    for end in SECRET_ENDS:
        out = out | name.endswith(end)
    return out


def redacted_url(url: Col) -> Column:
    """A URL without its user's password and without the values of secret query fields."""
    url = F.regexp_replace(col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/@:]*):[^/@]*@", "$1:***@")
    names = "|".join(map(literal, SECRET_KEYS)) + "|[^=&?]*(?:" + "|".join(map(literal, SECRET_ENDS)) + ")"
    return F.regexp_replace(url, rf"(?i)([?&](?:{names})=)[^&#]*", "$1***")


def redacted(settings: Col) -> Column:
    """A map of settings with secrets masked."""
    return F.transform_values(col(settings), lambda k, v: F.when(secret_key(k) | (F.lower(k) == "credential"), F.lit("***")).otherwise(redacted_url(v)))
