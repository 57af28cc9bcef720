"""Search filters as predicates on chunks: they reach the scan, and the layer of a path is its partition."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

PATHS, PREFIXES = ("path", "paths"), ("path_prefix", "path_prefixes", "prefix", "prefixes")
DATES, STRICT = ("start_date", "end_date"), "strict_date_filter"


def as_list(value: object) -> list:
    return list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]


def both(a: Column | None, b: Column) -> Column:
    return b if a is None else a & b


def python_date(value: object) -> str | None:
    """YYYY-MM-DD of a value's first ten characters, or of a date without leading zeros; None if it is neither."""
    import datetime as dt
    import re

    text = str(value or "").strip()
    for pattern, part in ((r"(\d{4})-(\d{2})-(\d{2})", text[:10]), (r"(\d{4})-(\d{1,2})-(\d{1,2})", text)):
        if m := re.fullmatch(pattern, part):
            try:
                return dt.date(*map(int, m.groups())).isoformat()
            except ValueError:
                return None
    return None


def normalized(search_filter: Mapping | None, start_date: object = None, end_date: object = None, strict: bool | None = None) -> dict:
    """The filter with top-level dates that it doesn't have itself; dates that aren't are dropped."""
    out = dict(search_filter or {})
    for key, value in zip(DATES, (start_date, end_date), strict=True):
        if value and key not in out:
            out[key] = value
        if out.get(key) is not None:
            out[key] = python_date(out[key])
        if out.get(key, "") is None:
            del out[key]
    if strict:
        out[STRICT] = True
    return out


def predicate(search_filter: Mapping | None, path: str = "path", metadata: str = "metadata") -> Column:
    """Paths and prefixes (any of each), dates in the path (paths without one pass unless strict), and metadata: equal, or one of a
    list; a missing key equals None."""
    out: Column | None = None
    search_filter = dict(search_filter or {})
    paths = [p for k in PATHS if k in search_filter for p in as_list(search_filter.pop(k))]
    prefixes = [p for k in PREFIXES if k in search_filter for p in as_list(search_filter.pop(k))]
    start, end, strict = (search_filter.pop(k, None) for k in (*DATES, STRICT))
    if paths:
        out = both(out, F.col(path).isin(paths))
    if prefixes:
        some = F.lit(False)
        for p in prefixes:
            some = some | F.col(path).startswith(p)
        out = both(out, some)
    if start or end:
        day = X.date_in_path(path)
        inside = F.lit(True)
        if start:
            inside = inside & (day >= start)
        if end:
            inside = inside & (day <= end)
        out = both(out, F.when(day.isNull(), F.lit(not strict)).otherwise(inside))
    for key, value in search_filter.items():
        held = F.col(metadata)[key]
        if isinstance(value, (list, tuple, set, frozenset)):
            test = F.lit(False)
            for v in value:
                test = test | held.eqNullSafe(F.lit(None if v is None else str(v)))
        else:
            test = held.eqNullSafe(F.lit(None if value is None else str(value)))
        out = both(out, test)
    return F.lit(True) if out is None else out
