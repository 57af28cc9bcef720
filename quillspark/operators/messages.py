"""Conversations: merging, cleaning, turns, times."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Other names of a message's time.
TIME_NAMES = ("time_created", "timestamp", "createdAt", "timeCreated", "created_time")
#: Tags of blocks that a client adds to what a user says; characters of a tool's input or result that are kept.
INJECTED = ("<local-command-caveat>", "<local-command-stdout>", "<local-command-stderr>", "<command-name>", "<command-message>", "<command-args>", "<system-reminder>", "<bash-input>", "<bash-stdout>", "<bash-stderr>")
EXCERPT = 200
CONTENT = "array<struct<type:string,text:string,name:string,input:string,source_type:string>>"


def first_time(columns: list[str], created: str = "created_at", metadata: str | None = None) -> Column:
    """A message's time: its own, else by one of the other names, else by one of them in its metadata."""
    names = [n for n in (created, *TIME_NAMES) if n in columns]
    tries = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names]
    tries += [F.nullif(F.col(metadata)[n], F.lit("")) for n in TIME_NAMES] if metadata else []
    return F.coalesce(*tries, F.lit(None).cast("string"))


def clean_content(content: Column) -> Column:
    """Blocks without tool results and without base64 data."""
    return F.filter(content, lambda b: ~((b["type"] == "tool_result") | ((b["type"] == "data") & (F.coalesce(b["source_type"], F.lit("")) == "base64"))))


def merge(existing: DataFrame, new: DataFrame, *key: str, id: str = "id", at: str = "created_at") -> DataFrame:
    """Messages by id, new ones before existing ones, with their place in the order of their times."""
    both = existing.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
    both = both.withColumn("line", F.monotonically_increasing_id()) if "line_no" not in both.columns else both.withColumn("line", F.col("line_no"))
    last = both.withColumn("nth", F.row_number().over(Window.partitionBy(*key, id).orderBy(F.desc("new"), F.desc("line")))).where("nth = 1")
    return last.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(at, id)) - 1).drop("new", "nth", "line")


def can_append(existing: DataFrame, merged: DataFrame, *key: str, id: str = "id") -> DataFrame:
    """key, append: the existing messages (place) are the first ones of the merged ones, so that a file need not be rewritten."""
    old = existing.select(*key, id, F.col("place").alias("old_place"))
    joined = old.join(merged.select(*key, id, "place"), [*key, id], "left")
    return joined.groupBy(*key).agg(F.bool_and(F.coalesce(F.col("place") == F.col("old_place"), F.lit(False))).alias("append"))


def sessions(rows: DataFrame, *key: str, at: str = "created_at") -> DataFrame:
    """key, n, first_at, last_at of the stored conversations, the latest first."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).orderBy(F.desc("last_at"), *key)


def without_sessions(rows: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), list(key), "left_anti")


def new_rows(rows: DataFrame, stored: DataFrame, *key: str) -> DataFrame:
    """Rows whose key isn't stored yet, each key once."""
    return rows.dropDuplicates(list(key)).join(stored.select(*key), list(key), "left_anti")


def turns(messages: DataFrame, key: str, order: str, role: str = "role") -> DataFrame:
    """messages with `turn_no`: a turn begins at each user message."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn_no", F.greatest(F.sum((F.col(role) == "user").cast("int")).over(w), F.lit(0)) + F.when(F.first(role).over(w) == "user", 0).otherwise(1))


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def segments(messages: DataFrame, key: str, order: str, most_words: int, role: str = "role", text: str = "text") -> DataFrame:
    """messages with `segment`, the place of its segment's first message: whole turns, packed up to most_words words. What a turn adds to
    depends on all before it, so a fold over each conversation's turns (two numbers each) decides where segments begin."""
    own = turns(messages, key, order, role).withColumn("words", words(F.col(text)))
    if most_words <= 0:
        return own.withColumn("segment", F.lit(0)).drop("words", "turn_no")
    per_turn = own.groupBy(key, "turn_no").agg(F.sum("words").cast("int").alias("w"), F.count("*").cast("int").alias("n"))
    folded = per_turn.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn_no", "w", "n"))).alias("all"))
    state = "struct<used:int,at:int,begin:int,out:array<int>>"
    zero = F.struct(F.lit(0).alias("used"), F.lit(0).alias("at"), F.lit(0).alias("begin"), F.array(F.lit(0)).alias("out")).cast(state)

    def step(acc: Column, t: Column) -> Column:
        fresh = (acc["at"] > acc["begin"]) & (acc["used"] + t["w"] > most_words)
        used = F.when(fresh, F.lit(0)).otherwise(acc["used"]) + t["w"]
        return F.struct(used.alias("used"), (acc["at"] + t["n"]).alias("at"), F.when(fresh, acc["at"]).otherwise(acc["begin"]).alias("begin"), F.when(fresh, F.concat(acc["out"], F.array(acc["at"]))).otherwise(acc["out"]).alias("out")).cast(state)

    begins = folded.select(key, F.explode(F.aggregate("all", zero, step, lambda a: a["out"])).alias("at")).withColumn("segment", F.col("at"))
    w = Window.partitionBy(key).orderBy("turn_no")
    starts = per_turn.withColumn("at", (F.sum("n").over(w) - F.col("n")).cast("int")).join(begins, [key, "at"], "left")
    placed = starts.select(key, "turn_no", F.last("segment", ignorenulls=True).over(w).alias("segment"))
    return own.join(placed, [key, "turn_no"]).drop("words", "turn_no")


def carried_anchor(rows: DataFrame, key: str, order: str, anchor: str, default: Column | None = None) -> DataFrame:
    """rows with `anchor_at`: their own anchor, else the last one before them, else the default."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(anchor, ignorenulls=True).over(w)
    return rows.withColumn("anchor_at", last if default is None else F.coalesce(last, default))


def interpolated(rows: DataFrame, key: str, order: str, at: str) -> DataFrame:
    """rows with `filled_at`: their own time; between two times by place; before the first and after the last the nearest one."""
    base = Window.partitionBy(key).orderBy(order)
    place = rows.withColumn("_i", F.row_number().over(base)).withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    known = F.when(F.col("_t").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("_t").alias("t")))
    before = F.last(known, ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(base.rowsBetween(0, Window.unboundedFollowing))
    both = place.withColumn("_a", before).withColumn("_b", after)
    share = (F.col("_i") - F.col("_a.i")) / F.nullif(F.col("_b.i") - F.col("_a.i"), F.lit(0))
    micros = F.when(F.col("_t").isNotNull(), F.col("_t").cast("double")).when(F.col("_a").isNull(), F.col("_b.t").cast("double")).when(F.col("_b").isNull(), F.col("_a.t").cast("double")).otherwise(F.col("_a.t") + (F.col("_b.t") - F.col("_a.t")) * share)
    return both.withColumn("filled_at", F.timestamp_micros(F.round(micros).cast("long"))).drop("_i", "_t", "_a", "_b")


def day_of(messages: DataFrame, *key: str, at: str = "created_at", zone: str = "UTC") -> DataFrame:
    """key, day: the last day, in a time zone, that a conversation has a message on."""
    return messages.groupBy(*key).agg(F.max(F.to_date(F.from_utc_timestamp(F.col(at), zone))).alias("day"))


def new_day(sessions: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """sessions with `is_new_day`: not the day of the one before. ties: columns that put sessions of the same time in order."""
    day = F.to_date(F.col(at))
    return sessions.withColumn("is_new_day", F.coalesce(day != F.lag(day).over(Window.partitionBy(key).orderBy(at, *ties)), F.lit(True)))


def pairs(messages: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """key, nth, user, assistant: each user message with the assistant message right after it."""
    w = Window.partitionBy(key).orderBy(order)
    near = messages.withColumn("next_role", F.lead(role).over(w)).withColumn("reply", F.lead(text).over(w)).where(F.col(role) == "user")
    return near.select(key, F.row_number().over(w).alias("nth"), F.col(text).alias("user"), F.when(F.col("next_role") == "assistant", F.col("reply")).alias("assistant"))


def spoken(messages: DataFrame, tags: tuple[str, ...] = INJECTED, role: str = "role", text: str = "text") -> DataFrame:
    """What users and assistants said: no empty texts, and none that is nothing but injected blocks."""
    return messages.where(F.col(role).isin("user", "assistant") & (F.length(F.trim(F.coalesce(text, F.lit("")))) > 0) & ~X.injected_only(text, tags))


def rendered_content(content: Column, excerpt: int = EXCERPT) -> Column:
    """A message's blocks as text: what was said, tools with their input, results cut short."""

    def block(b: Column) -> Column:
        result = F.trim(F.coalesce(b["text"], F.lit("")))
        cut = F.when(F.length(result) > excerpt, F.concat(F.left(result, F.lit(excerpt)), F.lit("..."))).otherwise(result)
        return (
            F.when(b["type"] == "text", F.trim(F.coalesce(b["text"], F.lit(""))))
            .when(b["type"] == "tool_use", F.concat(F.lit("[tool "), F.coalesce(b["name"], F.lit("?")), F.lit("("), F.left(F.coalesce(b["input"], F.lit("null")), F.lit(excerpt)), F.lit(")]")))
            .when(b["type"] == "tool_result", F.concat(F.lit("[tool_result "), cut, F.lit("]")))
            .otherwise("")
        )

    return F.trim(F.array_join(F.filter(F.transform(content, block), lambda t: t != ""), "\n"))


def history(messages: DataFrame, *key: str, order: str = "line_no", name: str = "role", text: str = "text") -> DataFrame:
    """key, history: a conversation's messages as one text, for those that fit into a row."""
    line = F.concat(F.col(name), F.lit(": "), F.col(text))
    return messages.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"]), "\n").alias("history"))


def last_text(content: Column) -> Column:
    """The last text block that isn't blank."""
    said = F.filter(content, lambda b: (b["type"] == "text") & (F.length(F.trim(F.coalesce(b["text"], F.lit("")))) > 0))
    return F.when(F.size(said) > 0, F.element_at(said, -1)["text"])


def attach_records(turn_rows: DataFrame, records: DataFrame, *key: str, turn: str = "turn", order: str = "seq") -> DataFrame:
    """turn_rows with `records`, those of their turn in order."""
    fields = [c for c in records.columns if c not in (*key, turn)]
    grouped = records.groupBy(*key, turn).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias("records"))
    return turn_rows.join(grouped, [*key, turn], "left")


def nearest_pairs(left: DataFrame, right: DataFrame, key: str, most: float) -> DataFrame:
    """key, left_id, right_id of rows (key, id, at in seconds): each left row, in the order of its time, takes the nearest right row that is
    still free, if it is within `most` seconds. Which one is free depends on all earlier choices, so a key's rows are matched together."""

    def run(k: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        lefts = sorted(zip(a.column("at").to_pylist(), a.column("id").to_pylist(), strict=True))
        free = sorted(zip(b.column("at").to_pylist(), b.column("id").to_pylist(), strict=True))
        out = []
        for at, i in lefts:
            best = min(free, key=lambda r: abs(r[0] - at), default=None)
            if best is not None and abs(best[0] - at) <= most:
                out.append((i, best[1]))
                free.remove(best)
        return pa.table([pa.array([k[0].as_py()] * len(out), pa.string()), pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string())], names=["key", "left_id", "right_id"])

    rows = lambda df: df.select(F.col(key).cast("string").alias("key"), F.col("id").cast("string").alias("id"), F.col("at").cast("double").alias("at"))
    return rows(left).groupBy("key").cogroup(rows(right).groupBy("key")).applyInArrow(run, "key string, left_id string, right_id string")


def anchored_sessions(batches: DataFrame) -> DataFrame:
    """Messages of nested chats (batch_number, time_anchor, turns: arrays of messages with role, content, time_anchor): session, place, role,
    content, created_at. A turn's time is its first message's anchor, else that of the turn before, else the batch's."""
    turn = batches.select("batch_number", "time_anchor", F.posexplode("turns").alias("turn", "messages"))
    own = F.get(F.filter(F.transform("messages", lambda m: m["time_anchor"]), lambda t: F.length(t) > 0), F.lit(0))
    dated = carried_anchor(turn.withColumn("own", own), "batch_number", "turn", "own", F.coalesce(F.nullif(F.col("time_anchor"), F.lit("")), F.lit("January-1-2024")))
    each = dated.select("batch_number", "turn", X.anchor_day("anchor_at").cast("timestamp").alias("created_at"), F.posexplode("messages").alias("pos", "m"))
    place = F.row_number().over(Window.partitionBy("batch_number").orderBy("turn", "pos")) - 1
    return each.select(F.col("batch_number").alias("session"), place.alias("place"), "m.role", "m.content", "created_at")


def zipped_sessions(rows: DataFrame, ids: str, dates: str, sessions: str) -> DataFrame:
    """session_id, started_at, messages of three arrays side by side, in the order of their times."""
    zipped = rows.select(F.explode(F.arrays_zip(F.col(ids).alias("session_id"), F.col(dates).alias("date"), F.col(sessions).alias("messages"))).alias("s"))
    return zipped.select("s.session_id", X.session_time("s.date").alias("started_at"), "s.messages").orderBy("started_at", "session_id")

