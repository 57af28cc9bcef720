"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as assistant and all others as named
users; system turns stay system turns. A trained span is the text and end mark of the assistant's turns. The result is
one row per turn of each rendering, with its place in it, so that a conversation of any length is laid out by many
tasks: offsets are prefix sums over stretches of SPAN turn numbers and then within them.

What a text or a name holds can't open or close a turn: `<|` becomes `< |` in both, and control characters in names (line ends
too) become blanks. Perspectives are told apart by the names as they are in the table.

Defined results: turns are ordered by (turn, speaker, text), nulls first; a null or empty speaker is called `unknown` and is no
participant, nor is `system`; null text is empty; turns with a null conversation id form one conversation; repeated rows are
repeated turns; a conversation without participants gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 64
BEGIN, END = "<|im_start|>", "<|im_end|>\n"

#: The same in DuckDB.
SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker NOT IN ('unknown', 'system')
), r AS (
  SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.body, t.speaker = p.perspective AS trained,
         CASE WHEN t.speaker = p.perspective THEN '<|im_start|>assistant' || chr(10)
              WHEN t.speaker = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || replace(regexp_replace(t.speaker, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '<|', '< |') || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS segment,
         row_number() OVER w - 1 AS place,
         CAST(sum(length(head || body || '<|im_end|>' || chr(10))) OVER w AS BIGINT) AS upto
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, CAST(place AS BIGINT) AS place, turn, speaker, segment, upto - length(segment) AS start_at,
       CASE WHEN trained THEN upto - length(body) - 11 END AS train_from, CASE WHEN trained THEN upto END AS train_to
FROM s
"""


def plain(said: Column) -> Column:
    """Without the opening of any control string."""
    return F.replace(said, F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, place (from 0), turn, speaker, segment (the rendered turn), start_at (its first character's place in the
    rendering), train_from and train_to (of its trained characters, null if it has none)."""
    rows = turns.select(
        turns[conv_id].alias("conv_id"), turns[turn].cast("long").alias("turn"), F.coalesce(F.nullif(turns[role].cast("string"), F.lit("")), F.lit("unknown")).alias("speaker"), plain(F.coalesce(turns[text].cast("string"), F.lit(""))).alias("body"),
    )
    who = rows.where(~F.col("speaker").isin("unknown", "system")).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    trained = F.col("speaker") == F.col("perspective")
    head = F.when(trained, f"{BEGIN}assistant\n").when(F.col("speaker") == "system", f"{BEGIN}system\n").otherwise(F.concat(F.lit(f"{BEGIN}user name="), plain(F.regexp_replace("speaker", r"[\x00-\x1F\x7F]", " ")), F.lit("\n")))
    seen = rows.join(who, rows["conv_id"].eqNullSafe(who["of"])).drop("of")
    seen = seen.withColumn("trained", trained).withColumn("segment", F.concat(head, "body", F.lit(END))).withColumn("size", F.length("segment").cast("long"))
    seen = seen.withColumn("stretch", F.floor(F.col("turn") / SPAN))
    key = ["conv_id", "perspective"]
    stretches = seen.groupBy(*key, "stretch").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    before = Window.partitionBy(*key).orderBy(F.asc_nulls_first("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("stretch").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("size_before"))
    own = Window.partitionBy(*key, "stretch").orderBy(F.asc_nulls_first("turn"), "speaker", "body").rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.withColumn("nth", F.row_number().over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("upto", F.sum("size").over(own))
    placed = placed.join(stretches, placed["conv_id"].eqNullSafe(stretches["c"]) & (placed["perspective"] == stretches["p"]) & placed["stretch"].eqNullSafe(stretches["s"]))
    upto = F.col("size_before") + F.col("upto")
    return placed.select(
        *key, (F.col("n_before") + F.col("nth") - 1).cast("long").alias("place"), "turn", "speaker", "segment", (upto - F.col("size")).alias("start_at"),
        F.when(F.col("trained"), upto - F.length("body") - len(END)).alias("train_from"), F.when(F.col("trained"), upto).alias("train_to"),
    )


def transcripts(placed: DataFrame) -> DataFrame:
    """Whole renderings of perspectives(): conv_id, perspective, dialogue, spans. For conversations that fit into a row."""
    turns = F.sort_array(F.collect_list(F.struct("place", "segment", "train_from", "train_to")))
    spans = F.transform(F.filter("turns", lambda t: t["train_from"].isNotNull()), lambda t: F.struct(t["train_from"].alias("train_from"), t["train_to"].alias("train_to")))
    return placed.groupBy("conv_id", "perspective").agg(turns.alias("turns")).select("conv_id", "perspective", F.array_join("turns.segment", "").alias("dialogue"), spans.alias("spans"))
