"""Notes: front matter, edits, moves and deletions, the index of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as X

#: The marks around a day's list of notes, and fields that it doesn't show.
OPEN, CLOSE = "<!-- notes:auto -->", "<!-- /notes:auto -->"
HIDDEN = ("schema_version", "session_id", "source_conversation")


def parsed(notes: DataFrame, text: str = "text") -> DataFrame:
    """notes with fields, body and offset in the place of their text."""
    return notes.withColumn("parsed", A.front_matter(text)).select(*[c for c in notes.columns if c != text], "parsed.*")


def rendered(notes: DataFrame) -> DataFrame:
    """notes with text in the place of fields and body."""
    return notes.select(*[c for c in notes.columns if c not in ("fields", "body", "offset")], A.note_text("fields", "body").alias("text"))


def update_fields(fields: Column, new: Column) -> Column:
    """Fields with new ones; what both have is the new one's."""
    kept = F.map_filter(fields, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def delete_fields(fields: Column, keys: Column) -> Column:
    """The rest of the fields, the keys that went and those that weren't there."""
    return F.struct(F.map_filter(fields, lambda k, v: ~F.array_contains(keys, k)).alias("fields"), F.array_intersect(keys, F.map_keys(fields)).alias("deleted"), F.array_except(keys, F.map_keys(fields)).alias("missing"))


def written_fields(metadata: Column, name: Column, description: Column) -> Column:
    """A note's fields: the metadata without empty values, name and description as given (where they say something)."""
    own = F.map_filter(metadata, lambda k, v: ~k.isin("name", "description") & v.isNotNull())
    given = F.map_filter(F.create_map(F.lit("name"), F.trim(name), F.lit("description"), F.trim(description)), lambda k, v: F.length(v) > 0)
    return F.map_concat(own, given)


def edit(notes: DataFrame, old: str, new: str) -> DataFrame:
    """notes (body) with every occurrence of old replaced, and how many there were."""
    found = (F.length("body") - F.length(F.replace(F.col("body"), F.lit(old), F.lit("")))) / max(1, len(old))
    return notes.withColumn("replaced", found.cast("int") if old else F.lit(0)).withColumn("body", F.replace(F.col("body"), F.lit(old), F.lit(new)) if old else F.col("body"))


def inbound_counts(notes: DataFrame, target: str, scope: str = "", path: str = "path", text: str = "text") -> DataFrame:
    """path, links of the notes in the scope that link to the target."""
    return notes.where(X.under(path, scope)).select(F.col(path).alias("path"), X.link_count(text, target).alias("links")).where("links > 0")


def move(notes: DataFrame, old: str, new: str, path: str = "path", text: str = "text") -> DataFrame:
    """notes with the one at `old` at `new`, and links to it led there."""
    return notes.withColumn(text, F.when(X.link_count(text, old) > 0, X.retarget(text, old, new)).otherwise(F.col(text))).withColumn(path, F.when(F.col(path) == old, new).otherwise(F.col(path)))


def delete_report(links: DataFrame, doomed: str) -> DataFrame:
    """target_path, sources, links: what from outside leads to a file or into a folder that is to go."""
    inside = X.under("target_path", doomed) & ~X.under("source_path", doomed)
    return links.where(inside).groupBy("target_path").agg(F.countDistinct("source_path").alias("sources"), F.count("*").alias("links"))


def notes_of_days(notes: DataFrame, daily: str = "daily", path: str = "path") -> DataFrame:
    """notes directly in a day's folder, with their day."""
    day = F.regexp_extract(path, rf"^{X.literal(daily)}/(\d{{4}}-\d{{2}}-\d{{2}})/[^/]+\.md$", 1)
    return notes.withColumn("day", day).where("day <> ''")


def day_blocks(notes: DataFrame, path: str = "path") -> DataFrame:
    """day, n, block: one line for each note (day, path, fields), name and description first."""
    rest = F.array_sort(F.filter(F.map_keys("fields"), lambda k: ~k.isin("name", "description", *HIDDEN)))
    keys = F.concat(F.filter(F.array(F.lit("name"), F.lit("description")), lambda k: F.map_contains_key("fields", k)), rest)
    said = F.transform(F.filter(keys, lambda k: F.length(F.col("fields")[k]) > 0), lambda k: F.concat(k, F.lit(": "), F.replace(F.col("fields")[k], F.lit("\n"), F.lit(" "))))
    line = F.array_join(F.concat(F.array(F.concat(F.lit("- [["), F.col(path), F.lit("]]"))), said), " ")
    return notes.withColumn("line", line).groupBy("day").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), "line"))), lambda x: x["line"]), "\n").alias("block"))


def spliced(body: Column, block: Column) -> Column:
    """A body with the block between its marks; at its end where it has none. Doing it again changes nothing."""
    whole = F.concat(F.lit(f"{OPEN}\n"), F.when(F.length(block) > 0, block).otherwise("(none)"), F.lit(f"\n{CLOSE}"))
    first = F.instr(body, OPEN)
    after = F.instr(body, CLOSE)
    bare = F.regexp_replace(body, r"\s+$", "")
    return (
        F.when((first > 0) & (after > 0), F.concat(F.substring(body, F.lit(1), first - 1), whole, F.substring(body, after + len(CLOSE), F.length(body))))
        .when(F.length(F.trim(bare)) > 0, F.concat(bare, F.lit("\n\n"), whole, F.lit("\n")))
        .otherwise(F.concat(whole, F.lit("\n")))
    )


def day_indexes(blocks: DataFrame, existing: DataFrame) -> DataFrame:
    """day, fields, body, created of the days' index notes: of blocks (day, n, block), and of indexes that are there (day, fields, body)."""
    both = blocks.join(existing.select("day", F.col("fields").alias("had"), F.col("body").alias("was")), "day", "full_outer")
    n = F.coalesce("n", F.lit(0))
    about = F.when(n == 0, "No notes today.").otherwise(F.concat(n.cast("string"), F.lit(" note(s) today.")))
    had = F.coalesce("had", F.create_map().cast("map<string,string>"))
    name = F.when(F.length(had["name"]) > 0, had["name"]).otherwise(F.col("day"))
    fields = update_fields(had, F.create_map(F.lit("name"), name, F.lit("description"), about))
    return both.select("day", fields.alias("fields"), spliced(F.coalesce("was", F.lit("")), F.coalesce("block", F.lit(""))).alias("body"), F.col("had").isNull().alias("created"))


def unique_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """wanted (day, name, source) with `suffixed`: the name, with a hash of the source if it is taken or asked for twice; and with `unique_name`:
    that, with a number if it is taken or asked for twice, too (hashes have 32 bits, so among many sources of one name some are equal)."""
    used = taken.select("day", "name", F.lit(True).alias("used")).distinct()
    order = Window.partitionBy("day", "name").orderBy("source")
    first = wanted.join(used, ["day", "name"], "left").withColumn("nth", F.row_number().over(order))
    second = F.when(F.col("used").isNull() & (F.col("nth") == 1), F.col("name")).otherwise(F.concat("name", F.lit("--"), X.short_hash("source")))
    tried = first.withColumn("tried", second)
    clash = tried.join(used.select("day", F.col("name").alias("tried"), F.col("used").alias("again")), ["day", "tried"], "left").withColumn("copy", F.row_number().over(Window.partitionBy("day", "tried").orderBy("source")) + F.when(F.col("again"), 1).otherwise(0))
    return clash.withColumn("unique_name", F.when(F.col("copy") > 1, F.concat("tried", F.lit("-"), F.col("copy").cast("string"))).otherwise(F.col("tried"))).select(*wanted.columns, F.col("tried").alias("suffixed"), "unique_name")


def validated_links(notes: DataFrame, files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """notes whose links lead to files that are there (files: path), Markdown, inside and not the note itself; others become their alias, or
    their file's name. A note's links are told apart natively: each text is cut at its links, and joined again."""
    rows = notes.select(path, text)
    pieces = F.split(F.col(text), r"\[\[[^\[\]\n]+\]\]")
    inner = F.regexp_extract_all(F.col(text), F.lit(r"\[\[([^\[\]\n]+)\]\]"), F.lit(1))
    each = rows.select(path, F.posexplode(inner).alias("i", "inner"))
    target = F.trim(F.substring_index(F.substring_index("inner", "|", 1), "#", 1))
    alias = F.trim(F.when(F.instr("inner", "|") > 0, F.expr("substring(inner, instr(inner, '|') + 1)")).otherwise(""))
    stem = F.replace(F.regexp_replace(F.substring_index(target, "/", -1), r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))
    fine = target.endswith(".md") & ~target.startswith("/") & ~target.contains("\\") & ~target.rlike(r"(^|/)\.\.?(/|$)")
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("there")).distinct()
    said = F.when(F.col("there") & F.col("fine") & (F.col("target") != F.col(path)), F.concat(F.lit("[["), "inner", F.lit("]]"))).otherwise(F.col("plain"))
    each = each.select(path, "i", "inner", target.alias("target"), F.when(alias != "", alias).otherwise(stem).alias("plain"), fine.alias("fine")).join(known, "target", "left").withColumn("said", F.coalesce(said, F.col("plain")))
    again = each.groupBy(path).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "said"))), lambda x: x["said"]).alias("said"))
    whole = F.concat(F.get("pieces", F.lit(0)), F.array_join(F.zip_with("said", F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0))), lambda a, b: F.concat(a, b)), ""))
    return notes.withColumn("pieces", pieces).join(again, path, "left").withColumn(text, F.when(F.col("said").isNull(), F.col(text)).otherwise(whole)).select(*notes.columns)
