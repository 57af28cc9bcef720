"""Where a language model would take part: column functions that stand in for it, and a registry of named ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

ColumnFunction = Callable[..., Column]
_named: dict[tuple[str, str], ColumnFunction] = {}
_closed = False


def register(kind: str, name: str) -> Callable[[ColumnFunction], ColumnFunction]:
    """Names a function of a kind (embedding, model, tokenizer, ...); a name is given once."""

    def keep(f: ColumnFunction) -> ColumnFunction:
        if _closed:
            raise RuntimeError("the registry is closed")
        if (kind, name) in _named and _named[kind, name] is not f:
            raise ValueError(f"{kind} {name!r} is taken")
        _named[kind, name] = f
        return f

    return keep


def named(kind: str, name: str) -> ColumnFunction:
    if (kind, name) not in _named:
        raise KeyError(f"no {kind} {name!r}; there are {sorted(n for k, n in _named if k == kind)}")
    return _named[kind, name]


def close() -> None:
    global _closed
    _closed = True


@register("embedding", "hash")
def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic vector of a text's tokens: each adds +1 or -1 at a place given by its hash; length 1."""
    hashes = F.transform(X.tokens(text), lambda t: F.xxhash64(t))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(hashes, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(dim)) == i, F.when(h >= 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    size = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(sums, lambda x: (x / F.when(size == 0, F.lit(1.0)).otherwise(size)).cast("float"))


@register("model", "first_sentence")
def first_sentence(text: Column) -> Column:
    """Stands in for a summarizer."""
    return F.trim(F.regexp_extract(text, r"(?s)^(.*?[.!?])(?:\s|$)", 1))


@register("model", "contains_judge")
def contains_judge(answer: Column, reference: Column) -> Column:
    """Stands in for a judge: yes if the answer holds the reference."""
    return F.when(F.contains(F.lower(answer), F.lower(reference)), "yes").otherwise("no")


def expose(spark: SparkSession) -> None:
    """The chunkers as SQL table functions and the Python text functions as SQL functions."""
    from pyspark.sql.functions import udtf

    from ..functions import arrow as A
    from ..operators import chunkers

    for kind, cut in chunkers.KINDS.items():

        class Chunk:
            def eval(self, text: str, cut=cut):
                yield from cut(text or "")

        spark.udtf.register(f"chunk_{kind}", udtf(Chunk, returnType="start_line int, end_line int, text string"))
    spark.udf.register("front_matter", A.front_matter)
