"""What a caller has been given already: ids, or line ranges, that expire.

A request is a batch of results of one context: (context_id, request_id, ts, rank, id, path, start_line, end_line, limit). Only what is returned is
remembered, so results cut off by the limit can come later.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import intervals

RESULT = "context_id string, request_id long, place int, id string, path string, start_line int, end_line int"


def unseen_ids(results: DataFrame, seen: DataFrame, now: float, ttl: float, limit: int) -> DataFrame:
    """Ranked results (context_id, rank, id) of which the context wasn't given the id (seen: context_id, id, ts) within the time."""
    fresh = results.join(intervals.live(seen, now, ttl).select("context_id", "id").distinct(), ["context_id", "id"], "left_anti")
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy("context_id").orderBy("rank"))).where(F.col("place") <= limit)


def unseen_ranges(results: DataFrame, seen: DataFrame, now: float, ttl: float, limit: int) -> DataFrame:
    """The same for line ranges (seen: context_id, path, start_line, end_line, ts): what seen ranges cover together is left out."""
    fresh = intervals.uncovered(results, intervals.live(seen, now, ttl), "context_id", "path")
    kept = fresh.withColumn("place", F.row_number().over(Window.partitionBy("context_id").orderBy("rank"))).where(F.col("place") <= limit)
    return kept.withColumn("path_place", F.min("place").over(Window.partitionBy("context_id", "path")))


def remember(returned: DataFrame, seen: DataFrame, now: float, ttl: float) -> DataFrame:
    """The seen table after a request: what has expired goes, what was returned comes."""
    return intervals.live(seen, now, ttl).unionByName(returned.withColumn("ts", F.lit(now)).select(*seen.columns))


def joined(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def returned_stream(requests: DataFrame, ttl: float = 24 * 3600, by_ranges: bool = True) -> DataFrame:
    """A stream of requests with the results that each returns. A context's state is its list of returned ids or ranges with their times; a
    context that is quiet for the whole time is forgotten, once the requests' own times show it. Requests may come late by `ttl`, too."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [tuple(x) for x in state.get[0]] if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["request_id", "rank"], kind="stable")
        for request, own in rows.groupby("request_id", sort=True):
            now, limit = float(own["ts"].max()), int(own["limit"].max())
            held = [h for h in held if now - h[4] < ttl]
            cover: dict[str, list[tuple[int, int]]] = {}
            for _, path, low, high, _ in held:
                cover.setdefault(path, []).append((low, high))
            cover = {p: joined(r) for p, r in cover.items()} if by_ranges else cover
            ids = {h[0] for h in held}
            given = []
            for r in own.itertuples():
                covered = any(a <= r.start_line and r.end_line <= b for a, b in cover.get(r.path, ())) if by_ranges else r.id in ids
                if not covered and len(given) < limit:
                    given.append(r)
            held += [(r.id, r.path, int(r.start_line), int(r.end_line), now) for r in given]
            if by_ranges:
                first = {}
                for i, r in enumerate(given):
                    first.setdefault(r.path, i)
                given.sort(key=lambda r: (first[r.path], r.start_line))
            if given:
                yield pd.DataFrame({"context_id": key[0], "request_id": int(request), "place": range(1, len(given) + 1), "id": [r.id for r in given], "path": [r.path for r in given], "start_line": [int(r.start_line) for r in given], "end_line": [int(r.end_line) for r in given]}).astype({"place": "int32", "start_line": "int32", "end_line": "int32"})
        state.update(([list(h) for h in held],))
        last = max([h[4] for h in held], default=float(rows["ts"].max()))
        state.setTimeoutTimestamp(max(int((last + ttl) * 1000), state.getCurrentWatermarkMs() + 1))

    timed = requests.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", f"{int(ttl) + 1} seconds")
    return timed.groupBy("context_id").applyInPandasWithState(run, RESULT, "held array<struct<id:string,path:string,low:int,high:int,ts:double>>", "append", GroupStateTimeout.EventTimeTimeout)
