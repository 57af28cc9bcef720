"""Text of HTML pages, in the JVM: what isn't shown goes, tags become blanks or nothing, and then character references are read."""

from __future__ import annotations

from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Col, col

#: Parts that aren't shown, with their content; one that isn't closed reaches to the end.
UNSEEN = (r"(?is)<script\b.*?(?:</script\s*>|\z)", r"(?is)<style\b.*?(?:</style\s*>|\z)", r"(?s)<!--.*?(?:-->|\z)")
#: Tags that part words, and then any other (an open one at the end too).
PARTING, TAG = r"(?i)</?(?:div|li|p)\b[^>]*>|<br\b[^>]*>", r"<[/!?]?[A-Za-z][^>]*(?:>|\z)"
#: A reference as HTML 5 reads it, a stretch without one, or an ampersand that is none.
PIECE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)|[^&]+|&"
LOST = "\ufffd"
#: Stands where a tag was while references are read, as none reaches over a tag.
SEAM = "\x01"


@lru_cache(maxsize=1)
def names() -> tuple[dict[str, str], str]:
    """Names (with their semicolon) and what they stand for; a pattern of those that need no semicolon, longest first."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return {n: c for n, c in html5.items() if n.endswith(";")}, "^&(" + "|".join(bare) + ")"


def numbered(code: Column) -> Column:
    """The character of a number. Numbers of control characters from 128 on mean those of Windows' code page."""
    old = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    of = F.create_map(*[x for n, c in old.items() if c for x in (F.lit(n), F.lit(c))])
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    wrong = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(wrong, F.lit(LOST)).when(code.between(128, 159), F.coalesce(F.try_element_at(of, code.cast("int")), plain)).otherwise(plain)


def character(piece: Column) -> Column:
    known, bare = names()
    of = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    named = F.try_element_at(of, F.substring(piece, 2, 40))
    short = F.regexp_extract(piece, bare, 1)
    by_prefix = F.concat(F.try_element_at(of, F.concat(short, F.lit(";"))), F.substring(piece, F.length(short) + 2, F.length(piece)))
    hexed = F.regexp_extract(piece, "^&#[xX]0*([0-9a-fA-F]{1,8});?$", 1)
    tens = F.regexp_extract(piece, "^&#0*([0-9]{1,9});?$", 1)
    return (
        F.when((F.length(piece) == 1) | ~piece.startswith("&"), piece)
        .when(piece == "&amp;", "&").when(piece == "&lt;", "<").when(piece == "&gt;", ">").when(piece == "&quot;", '"').when(piece == "&nbsp;", "\u00a0")
        .when(hexed != "", numbered(F.conv(hexed, 16, 10).cast("long"))).when(tens != "", numbered(tens.cast("long"))).when(piece.startswith("&#"), LOST)
        .when(named.isNotNull(), named).when(short != "", by_prefix).otherwise(piece)
    )


def unescaped(text: Col) -> Column:
    text = col(text)
    return F.when(text.contains("&"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), character), "")).otherwise(text)


def plain_text(page: Col) -> Column:
    """The text of HTML pages: script and style dropped, white space collapsed. Null: empty."""
    text = F.coalesce(col(page).cast("string"), F.lit(""))
    for pattern in UNSEEN:
        text = F.regexp_replace(text, pattern, SEAM)
    text = F.regexp_replace(F.regexp_replace(text, PARTING, " "), TAG, SEAM)
    blank = r"[\p{IsWhite_Space}\x1c-\x1f]+"
    return F.regexp_replace(F.regexp_replace(F.replace(unescaped(text), F.lit(SEAM), F.lit("")), blank, " "), "^ | $", "")
