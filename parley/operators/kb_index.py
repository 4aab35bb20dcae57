"""A stored postings index for knowledge-base search.

``add`` writes sections once: their texts with their token sets, their postings
dealt by token into ``BUCKETS`` folders (a section's tokens of a bucket are one
row), and the documents they are of. Nothing of this is shuffled but the hashes
of sections. Files are known by (doc_id, hash of the text), so adding a folder
again takes only what is new; every ``add`` is a batch of its own, and running one again
replaces it (``sinks.write_batch``). A file whose text has changed replaces its
older sections.

``topk`` gives what ``kb.topk`` gives. Tokens that more than ``often`` sections
hold are not joined with the queries at first: the rare tokens' postings give
candidates, and a section without a rare token of the query scores no more
than the query's frequent tokens. Where the k-th best candidate is above that,
the frequent tokens cannot change which sections are seen, and only the
candidates' token sets are asked for them. The other queries take all postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import kb
from parley.plans.windows import top_k
from parley.session import cut_lineage
from parley.streaming import sinks

BUCKETS = 16
OFTEN = 10_000
FEW = 200_000  # sections: up to so many candidates are broadcast to the stored token sets, so that only theirs are shuffled


def _bucket(token: str | Column, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _schema(id_type: T.DataType, *own: tuple) -> T.StructType:
    return T.StructType([T.StructField("doc_id", id_type), *(T.StructField(*f) for f in own), T.StructField(sinks.BATCH, T.LongType())])


_PLACE = (("section_no", T.LongType()), ("source", T.StringType()))
_TOKENS = ("tokens", T.ArrayType(T.StringType()))


class Index:
    """The index under ``path``; ``id_type`` is the type of ``doc_id``."""

    def __init__(self, spark: SparkSession, path: str, id_type: T.DataType | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.id_type = id_type or T.StringType()

    def _every(self) -> DataFrame:
        return sinks.read_table(self.spark, f"{self.path}/sections", _schema(self.id_type, *_PLACE, ("content", T.StringType()), _TOKENS))

    def _files(self) -> DataFrame:
        return sinks.read_table(self.spark, f"{self.path}/files", _schema(self.id_type, ("file", T.LongType())))

    def _current(self, table: DataFrame, before: int | None = None) -> DataFrame:
        """Rows of each document's newest batch (of those before ``before``). Where no document has two, the batches alone tell, and ``table`` is not joined."""
        files = self._files() if before is None else self._files().where(F.col(sinks.BATCH) < before)
        newest = files.groupBy(F.col("doc_id").alias("_d")).agg(F.max(sinks.BATCH).alias("_b"), F.min(sinks.BATCH).alias("_first"))
        if newest.where("_b > _first").isEmpty():
            return table.where(F.col(sinks.BATCH).isin([r[0] for r in files.select(sinks.BATCH).distinct().collect()])).drop(sinks.BATCH)
        newest = newest.drop("_first")
        return table.join(newest, table["doc_id"].eqNullSafe(F.col("_d")) & (table[sinks.BATCH] == F.col("_b"))).drop("_d", "_b", sinks.BATCH)

    def sections(self) -> DataFrame:
        """doc_id, section_no, source and content of what is indexed."""
        return self._current(self._every()).select(*kb.KEY, "source", "content")

    def add(self, sections: DataFrame, batch_id: int) -> None:
        """Sections (``kb_files.read_kb_files`` or ``sections_from_table``) of new or changed documents, as batch ``batch_id``."""
        parts = F.xxhash64(F.array_sort(F.collect_list(F.struct("section_no", "h"))))
        hashes = sections.select("doc_id", "section_no", F.xxhash64("source", "content").alias("h"))
        files = hashes.groupBy("doc_id").agg(parts.alias("file"))
        known = self._current(self._files().where(F.col(sinks.BATCH) < batch_id), batch_id).select(F.col("doc_id").alias("_d"), F.col("file").alias("_f"))
        same = files.join(known, files["doc_id"].eqNullSafe(F.col("_d")) & (F.col("file") == F.col("_f"))).select("_d").distinct()
        # where nothing is known the texts stay where they are
        if not known.isEmpty():
            sections = sections.join(same, sections["doc_id"].eqNullSafe(F.col("_d")), "left_anti")
            files = files.join(same, files["doc_id"].eqNullSafe(F.col("_d")), "left_anti")
        rows = sections.select(*kb.KEY, "source", "content", kb.tokens(F.col("content")).alias("tokens"))
        sinks.write_batch(rows, batch_id, f"{self.path}/sections", [], compression="zstd")
        if sinks.has_rows(self.spark, f"{self.path}/sections", batch_id):
            own = self._every().where(F.col(sinks.BATCH) == batch_id)
            # a section's tokens of one bucket are one row, written by the task that reads the section
            hashed = own.where(F.size("tokens") > 0).withColumn("tokens", F.transform("tokens", lambda t: F.struct(_bucket(t, self.buckets).alias("bucket"), t.alias("token"))))
            each = hashed.select(*kb.KEY, "source", "tokens", F.explode_outer(F.array_distinct("tokens.bucket")).alias("bucket"))
            postings = each.withColumn("tokens", F.filter("tokens", lambda t: t["bucket"] == F.col("bucket"))["token"])
            sinks.write_batch(postings, batch_id, f"{self.path}/postings", ["bucket"], dealt=False, compression="zstd")
        # last: only what is listed here counts as indexed
        sinks.write_batch(files.select("doc_id", "file"), batch_id, f"{self.path}/files", [])

    def _postings(self, asked: DataFrame) -> DataFrame:
        """token, bucket, doc_id, section_no and source of the newest batch of each document, of the tokens in ``asked`` (bucket, token)."""
        stored = sinks.read_table(self.spark, f"{self.path}/postings", _schema(self.id_type, *_PLACE, ("bucket", T.IntegerType()), _TOKENS))
        each = stored.select("bucket", *kb.KEY, "source", sinks.BATCH, F.explode("tokens").alias("token"))
        return self._current(each.join(asked.select("bucket", "token").distinct(), ["bucket", "token"], "left_semi"))

    def topk(self, queries: DataFrame, k: int = kb.TOP_K, often: int = OFTEN) -> DataFrame:
        """The best k sections of every query, as ``kb.topk``; ``often`` only decides which tokens are joined first."""
        asked = kb.query_tokens(queries).withColumn("bucket", _bucket("token", self.buckets))
        # (only asked tokens are counted; their buckets are the only folders that hold them)
        counts = self._postings(asked).groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("held"))
        asked = cut_lineage(asked.join(counts, ["bucket", "token"]))
        rare, frequent = asked.where(F.col("held") <= often), asked.where(F.col("held") > often)
        tail = frequent.groupBy("query_id").agg(F.collect_list("token").alias("frequent"))
        key = [*kb.KEY, "source", "query_id"]

        def score(tokens: DataFrame) -> DataFrame:
            """Postings are dealt by section before they meet the queries, so that scores are counted where they are."""
            return self._postings(tokens).repartition(*kb.KEY).join(tokens.select("bucket", "token", "query_id"), ["bucket", "token"]).groupBy(*key).agg(F.count(F.lit(1)).alias("score"))

        partial = score(rare)
        least = top_k(partial, ["query_id"], [F.col("score").desc()], k, "rank").groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        # k candidates above anything that frequent tokens alone can give
        state = least.join(tail, "query_id", "left").withColumn("more", F.greatest(F.size(F.coalesce("frequent", F.array().cast("array<string>"))), F.lit(0)))
        sure = cut_lineage(state.where((F.col("more") == 0) | ((F.col("n") == k) & (F.col("least") > F.col("more")))))
        near = cut_lineage(partial.join(sure, "query_id").where((F.col("n") < k) | (F.col("score") + F.col("more") >= F.col("least"))))
        texts = self._current(self._every().select(*kb.KEY, "tokens", sinks.BATCH))
        places = near.select(*(F.col(c).alias(f"_{c}") for c in kb.KEY)).distinct()
        if places.limit(FEW + 1).count() <= FEW:
            texts = texts.join(F.broadcast(places), texts["doc_id"].eqNullSafe(F.col("_doc_id")) & (F.col("section_no") == F.col("_section_no")), "left_semi")
        on = near.alias("a").join(texts.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.section_no") == F.col("b.section_no")))
        held = F.when(F.col("more") > 0, F.size(F.array_intersect("b.tokens", "frequent"))).otherwise(0)
        first = on.select(*(f"a.{c}" for c in key), (F.col("score") + held).alias("score"))
        rest = score(asked.join(sure.select("query_id"), "query_id", "left_anti"))
        order = [F.col("score").desc(), F.col("source"), *(F.col(c) for c in kb.KEY)]
        best = top_k(first.unionByName(rest), ["query_id"], order, k, "rank")
        return best.select("query_id", F.col("rank").cast("bigint").alias("rank"), *kb.KEY, "source", "score")

    def search(self, queries: DataFrame, k: int = kb.TOP_K, often: int = OFTEN) -> DataFrame:
        """``topk`` with the sections' texts."""
        found, texts = self.topk(queries, k, often), self.sections().select(*kb.KEY, "content")
        on = found.alias("a").join(texts.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.section_no") == F.col("b.section_no")))
        return on.select("a.*", "b.content")
