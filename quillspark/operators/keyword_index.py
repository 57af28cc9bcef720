"""A keyword index on disk: postings by token, changed in place of being rebuilt.

The base has the postings of all documents in buckets by token, and a change those of new documents; each has the documents whose older
postings it takes away. Each task that reads texts writes its own files, sorted by token: nothing is shuffled and nothing is kept beside the
index, so its disk is the index and what its changes hold. A task that would sort more than TASK_ROWS postings becomes several, each of which
reads the task's texts and takes a part of them, so sorts needn't spill however large the input's splits are. A state has the corpus
statistics beside it, so a query opens its terms' buckets, the documents' own rows and one row, and no text; within files it reads the pages
that hold its terms. The base names its tokenizer and this form: an index that another one has made is rebuilt.

Documents have numbers (place) within their folder, dense in each task's run. A posting has its place alone, and a document's own row its id
and length, which hits are joined with. What is gone is a bit for each place, 64 to a row, so compaction and queries join postings with a
small table, however many documents go.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import bm25
from .versions import MOST_CHANGES, Versions

#: Postings of a bucket, as long as buckets are MOST_BUCKETS at most (each task writes a file to each), and of a task at least, in expectation.
BUCKET_ROWS, MOST_BUCKETS, FILE_ROWS = 1 << 22, 64, 1 << 18
#: Postings that a task sorts, in expectation.
TASK_ROWS = 1 << 22
#: Characters of a posting, about; for the numbers above only.
CHARACTERS = 8
#: Bucket of the documents' own rows: token is empty.
DOCS = -1
#: doc_id: of documents' own rows only. n: the posting's tf, or the document's length.
POSTINGS = "doc_id {0}, place long, token string, n int, bucket int"
#: Sorted places and tokens are written as differences; their dictionaries would come with each bucket of each task.
WRITTEN = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#place": "false", "parquet.enable.dictionary#token": "false"}
GONE = "folder string, word long, bits long, n long, len long"
STATE = "fingerprint string, buckets int, n_docs long, total_len long, places long"


class KeywordIndex(Versions):
    def __init__(self, spark: SparkSession, path: str, stopwords: Iterable[str] = (), id_type: str = "string"):
        super().__init__(spark, path)
        self.stopwords, self.id_type = sorted(set(stopwords)), id_type
        self.fingerprint = hashlib.sha256("\0".join(["words of 2 and more, single Han; places alone", *self.stopwords]).encode()).hexdigest()[:16]

    def state(self) -> tuple[str, int, int, int] | None:
        """fingerprint, buckets, n_docs, total_len of what readers see."""
        folders = self.folders()
        return tuple(self.spark.read.schema(STATE).parquet(f"{self.path}/{folders[-1]}/state").first())[:4] if folders else None

    def fits(self) -> bool:
        """Whether the index is there, and made by this tokenizer."""
        state = self.state()
        return state is not None and state[0] == self.fingerprint

    def postings_of(self, docs: DataFrame, id: str, text: str) -> DataFrame:
        """doc_id, place, token, n, and a row for each document, of an empty token. Documents without a token have no row."""
        some = docs.select(F.col(id).cast(self.id_type).alias("doc_id"), F.col(text).alias("text"))
        n, most = some.groupBy(F.spark_partition_id()).agg(F.sum(F.length("text")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        slices = -(-most // (CHARACTERS * TASK_ROWS))
        if slices > 1:
            slice = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices))
            # parts that are dealt out alike would be put together again, partition by partition; one without rows isn't dealt out like them
            other = self.spark.range(0, 0, 1, 2).select(F.lit(None).cast(self.id_type).alias("doc_id"), F.lit(None).cast("string").alias("text"))
            some = reduce(DataFrame.unionByName, [some.where(slice == k) for k in range(slices)], other)
        some = some.coalesce(max(1, -(-n // (CHARACTERS * FILE_ROWS))))
        own = some.select("doc_id", F.sort_array(X.tokens("text", self.stopwords)).alias("tokens")).withColumn("dl", F.size("tokens"))
        # where runs of equal tokens start, and the end; each step has its own projection, so none is computed for each token anew
        runs = own.withColumn("place", F.monotonically_increasing_id()).where("dl > 0")  # a filter on dl alone would be pushed below and tokenize once more
        runs = runs.withColumn("starts", F.array_compact(F.transform("tokens", lambda t, i: F.when((i == 0) | (t != F.get("tokens", i - 1)), i))))
        runs = runs.withColumn("ends", F.concat("starts", F.array("dl"))).withColumn("starts", F.concat(F.array(F.lit(-1)), "starts"))
        each = runs.select("doc_id", "place", "dl", "tokens", F.inline(F.arrays_zip("starts", "ends")))
        own = F.col("starts") < 0
        return each.select(F.when(own, F.col("doc_id")).alias("doc_id"), "place", F.when(own, "").otherwise(F.get("tokens", F.col("starts"))).alias("token"), F.when(own, F.col("dl")).otherwise(F.col("ends") - F.col("starts")).alias("n"))

    def _save(self, name: str, postings: DataFrame, buckets: int, before: tuple[int, int] = (0, 0)) -> str:
        """Writes a base or a change. before: documents and their length that stay from earlier."""
        folder = f"{self.path}/{name}"
        columns = [c.split()[0] for c in POSTINGS.split(", ")]
        dealt = postings.withColumn("bucket", F.when(F.col("token") == "", DOCS).otherwise(F.pmod(F.xxhash64("token"), F.lit(buckets))).cast("int"))
        dealt.sortWithinPartitions("bucket", "token", "place").select(*columns).write.options(**WRITTEN).partitionBy("bucket").parquet(f"{folder}/postings")
        own = self._load(name).where(F.col("bucket") == DOCS)
        n, total, places = own.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("place"), F.lit(-1)) + 1).first()
        self.spark.createDataFrame([(self.fingerprint, buckets, before[0] + n, before[1] + total, places)], STATE).coalesce(1).write.parquet(f"{folder}/state")
        return name

    @staticmethod
    def _buckets(rows: int) -> int:
        return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))

    def build(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> str:
        """A new base from all documents."""
        n = docs.agg(F.sum(F.length(text))).first()[0] or 0
        return self.point_to([self._save(uuid.uuid4().hex, self.postings_of(docs, id, text), self._buckets(n // CHARACTERS))])

    def _load(self, folder: str) -> DataFrame:
        return self.spark.read.schema(POSTINGS.format(self.id_type)).parquet(f"{self.path}/{folder}/postings")

    def _rows(self, where: Column | None = None) -> DataFrame:
        """All folders' rows that no later change has taken away, with their folder; where: only those."""
        folders = self.folders()
        each = [self._load(f).where(F.lit(True) if where is None else where) for f in folders]
        rows = reduce(DataFrame.unionByName, [r.withColumn("folder", F.lit(f)) for f, r in zip(folders, each, strict=True)])
        if len(folders) == 1:
            return rows
        gone = reduce(DataFrame.unionByName, [self.spark.read.schema(GONE).parquet(f"{self.path}/{f}/gone") for f in folders[1:]])
        # a row stands for 64 places
        bits = gone.groupBy("folder", "word").agg(F.bit_or("bits").alias("bits"))
        bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
        marked = rows.withColumn("word", F.expr("shiftright(place, 6)")).join(F.broadcast(bits), ["folder", "word"], "left")
        return marked.where(F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(bit) == 0).drop("word", "bits")

    def _documents(self) -> DataFrame:
        """doc_id, place, dl and folder of the documents that have a token."""
        return self._rows(F.col("bucket") == DOCS).select("doc_id", "place", F.col("n").alias("dl"), "folder")

    def documents(self) -> DataFrame:
        """doc_id and dl of the documents that have a token."""
        return self._documents().select("doc_id", "dl")

    def change(self, gone: DataFrame, docs: DataFrame | None = None, id: str = "doc_id", text: str = "text") -> str:
        """Takes away documents (gone: doc_id), and adds new ones."""
        if len(self.folders()) > MOST_CHANGES:
            self.compact()
        name = uuid.uuid4().hex
        lost = self._documents().join(gone.select(F.col("doc_id").cast(self.id_type).alias("doc_id")), "doc_id", "left_semi")
        words = lost.groupBy("folder", F.expr("shiftright(place, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("bits"), F.count("*").alias("n"), F.sum("dl").alias("len"))
        words.write.parquet(f"{self.path}/{name}/gone")
        n_lost, len_lost = self.spark.read.schema(GONE).parquet(f"{self.path}/{name}/gone").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("len"), F.lit(0))).first()
        _, buckets, n, total = self.state()
        new = self.postings_of(docs, id, text) if docs is not None else self.spark.createDataFrame([], POSTINGS.format(self.id_type)).drop("bucket")
        return self.point_to([*self.folders(), self._save(name, new, buckets, (n - n_lost, total - len_lost))])

    def upsert(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> str:
        if not self.fits():
            raise ValueError(f"{self.path} holds no index of this tokenizer: build it")
        return self.change(docs.select(F.col(id).alias("doc_id")), docs, id, text)

    def delete(self, ids: DataFrame) -> str:
        return self.change(ids)

    def compact(self) -> str:
        """One base without what was deleted; its buckets follow its size. The folders' places follow one another."""
        folders = self.folders()
        states = [self.spark.read.schema(STATE).parquet(f"{self.path}/{f}/state").first() for f in folders]
        starts, rows = [], 0
        for state in states:
            starts.append(starts[-1] + -(-last // 64) * 64 if starts else 0)
            last = state["places"]
        for f in folders:
            rows += self._load(f).count()
        # some buckets at a time, so that tasks sort TASK_ROWS: a scan has about as many tasks as there are cores, or more
        slices = max(1, min(states[0]["buckets"], -(-rows // (TASK_ROWS * self.spark.sparkContext.defaultParallelism))))
        kept = reduce(DataFrame.unionByName, [self._rows(F.pmod(F.col("bucket"), F.lit(slices)) == k) for k in range(slices)])
        start = F.element_at(F.create_map(*[F.lit(x) for f, k in zip(folders, starts, strict=True) for x in (f, k)]), F.col("folder"))
        moved = kept.withColumn("place", F.col("place") + start.cast("long")).drop("folder", "bucket")
        return self.point_to([self._save(uuid.uuid4().hex, moved, self._buckets(rows))])

    def optimize(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> str:
        """The upkeep job: rebuilds what another tokenizer has made, else compacts."""
        return self.compact() if self.fits() else self.build(docs, id, text)

    def scores(self, query: str, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
        """doc_id, score of the documents that hold a term; only the terms' buckets and the documents' own rows are opened."""
        terms = bm25.query_terms(query, self.stopwords)
        _, buckets, n, total = self.state()
        wanted = [r["b"] for r in self.spark.createDataFrame([(t,) for t in terms], "token string").select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()] if terms else []
        hits = self._rows(F.col("bucket").isin(wanted) & F.col("token").isin(terms) if terms else F.lit(False))
        hits = hits.select("folder", "place", "token", F.col("n").alias("tf")).join(self._documents(), ["folder", "place"])
        hits = hits.repartition("doc_id").groupBy("doc_id", "token", "dl").agg(F.sum("tf").alias("tf"))  # of rows of one id
        stats = self.spark.createDataFrame([(n, total / n if n else 0.0)], "n_docs long, avg_len double")
        return bm25.score_index(hits, stats, terms, k1, b)

    def search(self, query: str, k: int) -> DataFrame:
        return bm25.top_k(self.scores(query), k)
