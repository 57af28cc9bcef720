from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import chunkers as C


def merged(values):
    """Chunks put together again; places in arrays don't count."""

    def join(a, b):
        if isinstance(a, dict) and isinstance(b, dict):
            return {k: join(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}
        return b

    out = values[0]
    for v in values[1:]:
        out = join(out, v)
    return out


def test_lines_fit_exactly():
    assert [(a, b) for a, b, _ in C.by_lines(("x" * 20 + "\n") * 4, 64)] == [(1, 3), (4, 4)]
    assert C.by_lines(" \n") == [] and C.by_lines("") == []
    assert [(a, b) for a, b, _ in C.by_lines(("x" * 20 + "\n") * 6, 64, overlap=25)] == [(1, 3), (3, 5), (5, 6)]
    assert [t for _, _, t in C.by_lines("a b\nc", 64)] == ["a b\nc"]
    assert [(a, b) for a, b, _ in C.by_lines("a\n" * 5, 64, most_lines=2)] == [(1, 2), (3, 4), (5, 5)]
    assert [(a, b) for a, b, _ in C.by_lines("é" * 40 + "\n" + "b\n", 64, unit="bytes")] == [(1, 1), (2, 2)]
    with pytest.raises(ValueError):
        C.by_lines("a", unit="words")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=90), max_size=30), st.integers(64, 200))
def test_lines_cover_the_text(lines, most):
    text = "\n".join(lines)
    parts = C.by_lines(text, most)
    if text.strip():
        assert "".join(t for _, _, t in parts) == text
        assert all(b[0] == a[1] + 1 for a, b in zip(parts, parts[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n[]|#x日", max_size=900), st.integers(100, 300), st.integers(4, 60), st.booleans())
def test_bytes_cover_the_text(text, size, overlap, links):
    raw, at = text.encode(), 0
    for first, last, part in C.by_bytes(text, size, overlap, links):
        assert len(part.encode()) <= size and 1 <= first <= max(first, last) <= text.count("\n") + 1
        found = raw.find(part.encode(), max(0, at - size - 4))
        assert found >= 0 and found <= at + 3
        at = max(at, found + len(part.encode()))
    assert at >= len(raw) - 3


def test_bytes_leave_links_whole():
    link = "[[some/note.md#L1|a name]]"
    text = "x" * 90 + link + "y" * 150
    parts = [t for _, _, t in C.by_bytes(text, 100, 20)]
    assert parts[0] == "x" * 90 and any(link in t for t in parts)
    assert all("]]" not in t.split("[[")[0] for t in parts)
    long = "x" * 30 + "[[" + "L" * 76 + "]]" + "y" * 200
    assert len(C.by_bytes(long, 100, 10)) >= 2
    assert len(C.by_bytes("test", 1, 0)) == 1
    assert C.by_bytes("") == []


def test_front_matter_is_no_text_of_notes():
    assert C.by_default("---\nname: x\n---\n\nbody", "a.md") == [(1, 1, "body")]
    assert C.by_default("---\nname: x\n---\n\nbody", "a.txt")[0][2].startswith("---")


@pytest.mark.parametrize("raw", ["42", '"hello"', "null", "true", "{}", "[]"])
def test_json_scalars(raw):
    assert [json.loads(t) for _, _, t in C.by_json(raw)] == [json.loads(raw)]


def test_json_keeps_ways_and_lines():
    raw = '{\n  "alice": {"name": "Alice", "bio": "' + "x" * 200 + '"},\n  "bob": {"name": "Bob", "bio": "' + "y" * 200 + '"}\n}'
    parts = C.by_json(raw, 300)
    assert len(parts) >= 2 and merged([json.loads(t) for _, _, t in parts]) == json.loads(raw)
    assert parts[0][0] == 2 and parts[-1][1] == 3
    many = {f"k{i}": "v" * 50 for i in range(40)}
    parts = C.by_json(json.dumps(many), 500)
    assert all(len(t) <= 500 for _, _, t in parts) and merged([json.loads(t) for _, _, t in parts]) == many
    array = C.by_json(json.dumps([{"a": "x" * 200, "b": i} for i in range(6)]), 300)
    assert len(array) > 1 and all(isinstance(json.loads(t), list) for _, _, t in array)


def test_json_that_is_none():
    assert C.by_json('{"bad": json}') == [(1, 1, '{"bad": json}')]
    parts = C.by_json("{x}\n" * 200, 300)
    assert len(parts) > 1 and "".join(t for _, _, t in parts) == "{x}\n" * 200
    assert C.by_json("[" * 3000 + "]" * 3000)


json_values = st.recursive(st.none() | st.booleans() | st.integers(-999, 999) | st.text(max_size=40), lambda c: st.lists(c, max_size=5) | st.dictionaries(st.text(max_size=8), c, max_size=5), max_leaves=40)


@settings(max_examples=200, deadline=None)
@given(json_values, st.sampled_from([None, 1]))
def test_json_sizes_and_leaves(value, indent):
    text = json.dumps(value, ensure_ascii=False, indent=indent)
    parts = C.by_json(text, 256)
    count = lambda v: sum(map(count, v.values())) if isinstance(v, dict) and v else sum(map(count, v)) if isinstance(v, list) and v else 1
    got = [json.loads(t) for _, _, t in parts]
    assert sum(map(count, got)) == count(value)
    _, leaves, _ = C.JsonReader(text, 64).read(0, ())
    assert all(len(t) <= 256 or count(v) == 1 or len(leaves) == 1 for (_, _, t), v in zip(parts, got, strict=True))


def test_markdown_sections_that_fit_share_a_piece():
    assert C.by_markdown("") == [] and C.by_markdown("---\ntitle: only\n---\n") == []
    assert C.by_markdown("Intro\n=====\n\nOne line.", 400) == [(1, 4, "# Intro\n\nOne line.")]
    text = "# Rivers\n\nlong ones\n\n# Lakes\n\ndeep ones\n\n# Seas\n\n" + "salt " * 30
    assert [(a, b) for a, b, _ in C.by_markdown(text, 170)] == [(1, 7), (9, 11)]
    assert [t for _, _, t in C.by_markdown(text, 170)][0] == "# Rivers\n\nlong ones\n\n# Lakes\n\ndeep ones"


def test_markdown_sections_that_do_not_fit_are_entered():
    text = "# Trees\n\n## Oak\n\n" + "acorn " * 12 + "\n\n## Elm\n\n" + "seed " * 14 + "\n\n# Birds\n\nfew"
    plain = [t for _, _, t in C.by_markdown(text, 110, breadcrumbs=False)]
    assert [t.split("\n")[0] for t in plain] == ["# Trees", "## Elm", "# Birds"]  # no piece reaches over the end of Trees
    led = [t for _, _, t in C.by_markdown(text, 110)]
    assert led[1].startswith("# Trees\n\n## Elm\n\nseed") and led[2] == "# Birds\n\nfew"
    assert all(len(t.encode()) <= 110 for t in led + plain)


def test_markdown_crumbs_give_way_from_the_top():
    text = "# " + "top " * 20 + "\n\n## mid\n\n" + "\n\n".join("word " * 12 for _ in range(4))
    parts = [t for _, _, t in C.by_markdown(text, 120)]
    assert all(len(t.encode()) <= 120 for t in parts) and any(t.startswith("## mid\n\nword") for t in parts[1:]) and not any("top" in t for t in parts[2:])


def test_markdown_long_blocks_are_split_in_their_frames():
    rows = [f"| r{i} | {'cell ' * 6}|" for i in range(25)]
    parts = C.by_markdown("| name | what |\n| --- | --- |\n" + "\n".join(rows), 220)
    assert len(parts) > 4 and all("| name | what |\n| --- | --- |\n| r" in t and t.startswith(f"[Part {i}/{len(parts)}]") for i, (_, _, t) in enumerate(parts, 1))
    assert [r for _, _, t in parts for r in t.split("\n")[4:]] == rows and all(len(t.encode()) <= 220 for _, _, t in parts)
    code = ["def f():", "", "    return 'é'"] * 20
    parts = C.by_markdown("~~~python\n" + "\n".join(code) + "\n~~~", 130)
    assert [x for _, _, t in parts for x in t.split("\n")[3:-1]] == code and all("~~~python\n" in t and t.endswith("\n~~~") for _, _, t in parts)
    steps = [f"{i}. " + "do it " * 6 for i in range(1, 15)]
    parts = C.by_markdown("\n".join(steps), 140)
    assert (parts[0][0], parts[-1][1]) == (1, 14) and [x.strip() for _, _, t in parts for x in t.split("\n") if x[:1].isdigit()] == [x.strip() for x in steps]
    open_code = C.by_markdown("# A\n\n```\n# no heading\nx", 300)
    assert open_code == [(1, 5, "# A\n\n```\n# no heading\nx\n```")]


def test_markdown_with_very_many_headings_falls_back():
    body = "".join(f"## Day {i}\n\n{'rain ' * 40}[[notes/{i}.md]]\n\n" for i in range(120))
    parts = C.by_markdown(f"---\nkind: log\n---\n{body}", 3000)
    assert parts == [(a + 3, b + 3, t) for a, b, t in C.by_bytes(body, 3000, 100)] and len(parts) > 5
    assert len(C.by_markdown(body, 3000, most_headings=None)) > 5 and C.by_markdown("# One\n\nTwo\n---\n\n```\n# Three\n```", most_headings=2)[0][2].startswith("# One")
    assert C.by_markdown("# One\n\nTwo\n---\n", most_headings=1) == [(a, b, t) for a, b, t in C.by_bytes("# One\n\nTwo\n---\n")]


BLOCKS_OF = st.lists(st.tuples(st.integers(0, 4), st.text("abc é", min_size=1, max_size=60)).map(lambda x: ("#" * x[0] + " " if x[0] else "") + (x[1].strip() or "x")), max_size=25)


@settings(max_examples=300, deadline=None)
@given(BLOCKS_OF, st.integers(100, 260), st.booleans())
def test_markdown_equals_brute_force(lines, size, crumbs):
    """Every block once and in order; cuts only where the rules ask for them, told by putting texts together and measuring these."""
    blocks = [b for b in C.MarkdownReader("\n\n".join(lines), 0).blocks() if b.text]
    text = lambda a, b: "\n\n".join(x.text for x in blocks[a:b])
    n_bytes = lambda t: len(t.encode())

    def section_end(i):
        return next((k for k in range(i + 1, len(blocks)) if blocks[k].level and blocks[k].level <= blocks[i].level), len(blocks)) if blocks[i].level else i + 1

    def over(i):
        out, level = [], 9
        for k in range(i - 1, -1, -1):
            if blocks[k].level and blocks[k].level < min(level, blocks[i].level or 9):
                out.insert(0, k)
                level = blocks[k].level
        return out

    def lead(a, b):
        above = over(a) if crumbs else []
        while above and n_bytes("\n\n".join([*(blocks[k].text for k in above), text(a, b)])) > size:
            above = above[1:]
        return above

    want = []

    def cut(a, b, first=None):
        """Blocks a to b, of which `first` is the heading that opens the region's first range."""
        run = [first, a] if first is not None else None
        while a < b:
            e = section_end(a)
            if n_bytes(text(a, e)) <= size:
                if run and n_bytes("\n\n".join([*(blocks[k].text for k in lead(*run)), text(run[0], e)])) <= size:
                    run[1] = e
                else:
                    if run:
                        want.append(run)
                    run = [a, e]
            else:
                if run:
                    want.append(run)
                run = None
                cut(a + 1, e, a)
            a = e
        if run:
            want.append(run)

    cut(0, len(blocks))
    got = C.by_markdown("\n\n".join(lines), size, breadcrumbs=crumbs)
    assert [t for _, _, t in got] == ["\n\n".join([*(blocks[k].text for k in lead(a, b)), text(a, b)]) for a, b in want]
    assert [(x, y) for x, y, _ in got] == [(blocks[a].first, blocks[b - 1].last) for a, b in want]


def test_chunk_routes_by_suffix(spark):
    rows = [("a.md", "# A\n\nb"), ("b.json", '{"a": 1}'), ("c.jsonl", '{"a": 1}\n{"b": 2}\n'), ("d.txt", "plain"), ("e.md", None), ("f.md", "")]
    got = {(r["path"], r["chunk_index"]): r for r in C.chunk(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {k: (r["start_line"], r["end_line"], r["text"]) for k, r in got.items()} == {("a.md", 0): (1, 3, "# A\n\nb"), ("b.json", 0): (1, 1, '{"a": 1}'), ("c.jsonl", 0): (1, 2, '{"a": 1}\n{"b": 2}\n'), ("d.txt", 0): (1, 1, "plain")}
    assert len({r["id"] for r in got.values()}) == 4
    with pytest.raises(ValueError):
        C.chunk(spark.createDataFrame(rows, "path string, text string"), "nothing")
