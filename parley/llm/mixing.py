"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

Each source has a target in words: its weight's share of all words, at most
``max_repeats`` times its own, the excess reshared by weight. Targets are the
votes in a Sainte-Laguë apportionment of equal blocks of words (highest
quotients of votes by 1, 3, 5, ...), which gives every source an integer quota
of blocks; a source's quota is apportioned over its shards the same way. A
shard lines its documents up in seeded order, takes as many whole passes over
them as its quota holds, and selects the rest as single blocks by a seeded
permutation of block numbers. ``mix`` emits whole documents for the passes and,
for as many words as the selected blocks hold, the documents first in the
shard's seeded order, the last of them cut to the words that are left; so each
shard's mixed words are its takings, however long its documents are.

Shards hold about ``shard_rows`` documents each, so a hot source is many
shards. Only per-source rows (and per-shard rows within a source) meet in one
window; documents never do, beyond their shard.

Defined results: a null or empty text has size 0 and nothing is taken of it; a
null source is a source of its own, last in order; a null doc_id is a document
like any other; repeated rows are lined up one after the other and share their
words' fate evenly; an empty table gives an empty result; if no text has a word
every target is 0. Only ``doc_id``, ``text`` and ``source`` are read; ``mix``
passes all other columns through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SHARD_ROWS = 4_000
MAX_BLOCK = 64  # words
BLOCKS_PER_SOURCE = 10_000
SEED = 17

#: Multipliers of block numbers; primes above any shard's number of blocks, so each gives a permutation.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def word_count(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds place, weight and target to (source, source_size, ...) rows; one row per source meets here.

    With sources by rising cap per weight, the sources before the first one
    whose cap holds its share of what is left are the capped ones; that share
    is every other source's target per unit of weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = sources.withColumn("place", F.row_number().over(order)).withColumn("weight", w.cast("double"))
    placed = placed.withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.sum(c).over(rising), F.lit(0.0))
    total = F.sum(F.col("source_size").cast("double")).over(every)
    level = placed.withColumn("total", total).withColumn("left", total - before("cap")).withColumn("weights_left", F.sum("weight").over(every) - before("weight"))
    level = level.withColumn("share", F.col("left") / F.col("weights_left"))
    holds = F.when(F.col("cap") / F.col("weight") >= F.col("share"), F.struct(F.col("cap") / F.col("weight"), "place", "share"))
    level = level.withColumn("first", F.min(holds).over(every))
    fair = F.coalesce(F.col("first.share"), F.col("cap") / F.col("weight")) * F.col("weight")
    return level.withColumn("target", F.least("cap", fair)).select(*sources.columns, "place", "weight", "target")


def sainte_lague(parties: DataFrame, votes: str, order: list[str], seats: Column, group: list[str], name: str) -> DataFrame:
    """Adds ``name``, the seats of each party: the highest quotients of ``votes`` by 1, 3, 5, ...

    ``seats`` is the number to give out in each ``group``; ties go by ``order``.
    With V votes, M seats and n parties, every quotient of V / (2M - n) or more
    wins and none under V / (2M + n) does, so only the few between are ranked.
    """
    every = Window.partitionBy(*group) if group else Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    party = parties.withColumn("_v", F.col(votes).cast("double")).withColumn("_m", seats.cast("double"))
    party = party.withColumn("_all", F.sum("_v").over(every)).withColumn("_n", F.sum((F.col("_v") > 0).cast("double")).over(every))
    each = F.when(F.col("_all") > 0, F.col("_v") / F.col("_all")).otherwise(0.0)
    upto = lambda m: F.floor((each * m + 1) / 2)
    party = party.withColumn("_sure", F.greatest(F.lit(0), upto(F.greatest(F.lit(0.0), 2 * F.col("_m") - F.col("_n"))) - 1))
    party = party.withColumn("_most", F.when(F.col("_v") > 0, upto(2 * F.col("_m") + F.col("_n")) + 1).otherwise(0))
    party = party.withColumn("_open", F.col("_m") - F.sum("_sure").over(every))
    own = [c for c in parties.columns]
    ask = party.select(*own, "_v", "_sure", "_open", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_most")))).alias("_k"))
    best = Window.partitionBy(*group).orderBy(F.col("_q").desc_nulls_last(), *order, "_k") if group else Window.orderBy(F.col("_q").desc_nulls_last(), *order, "_k")
    ranked = ask.withColumn("_q", F.col("_v") / (2 * F.col("_k") - 1)).withColumn("_rank", F.row_number().over(best))
    won = F.sum(((F.col("_rank") <= F.col("_open")) & F.col("_k").isNotNull()).cast("long"))
    return ranked.groupBy(*own).agg((F.first("_sure") + won).cast("long").alias(name))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, taken, copies and last of every row.

    ``taken`` counts words of the selected blocks, repeats included; ``copies``
    turns the shard's takings into documents in seeded order, and ``last`` is
    the number of words of the last copy: ``size``, but for one in a shard.
    """
    sized = cut_lineage(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", word_count("text").alias("size")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = targets(sources, weights, max_repeats)
    block = F.floor(F.sum("source_size").over(every) / (F.count(F.lit(1)).over(every) * BLOCKS_PER_SOURCE))
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), block)).cast("long"))
    sources = sources.withColumn("blocks", F.round(F.sum("target").over(every) / F.col("block")))
    sources = sainte_lague(sources, "target", ["place"], F.col("blocks"), [], "quota")
    sources = cut_lineage(sources.withColumn("shards", F.ceil(F.col("n_docs") / shard_rows).cast("long")))

    of = sources.select(F.col("source").alias("_source"), "place", "source_size", "target", "block", "quota", "shards")
    dealt = sized.join(of, sized.source.eqNullSafe(of._source)).drop("_source")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key"), F.col("shards")))

    shards = dealt.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("block").alias("block"), F.first("quota").alias("source_quota"))
    shards = sainte_lague(shards, "shard_size", ["shard"], F.col("source_quota"), ["place"], "quota")
    words = F.least(F.col("quota") * F.col("block"), F.col("shard_size") * max_repeats)
    shards = shards.withColumn("words", words).withColumn("passes", F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0))
    shards = shards.withColumn("n_blocks", F.ceil(F.col("shard_size") / F.col("block")))
    picked = F.round((F.col("words") - F.col("passes") * F.col("shard_size")) / F.col("block")).cast("long")
    shards = shards.withColumn("picked", F.least("n_blocks", picked)).select("place", "shard", "passes", "n_blocks", "picked")

    line = Window.partitionBy("place", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_key"), "doc_id", "text_key")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    lined = dealt.drop("quota").join(shards, ["place", "shard"]).withColumn("end", F.sum("size").over(upto)).withColumn("begin", F.col("end") - F.col("size"))
    key = F.xxhash64(F.lit(seed + 2), "place", "shard")
    prime = F.element_at(F.array(*(F.lit(p) for p in PRIMES)), (F.pmod(key, F.lit(len(PRIMES))) + 1).cast("int"))
    lined = lined.withColumn("n_perm", F.greatest(F.lit(1).cast("long"), "n_blocks"))
    lined = lined.withColumn("step", F.pmod(prime, F.col("n_perm"))).withColumn("shift", F.pmod(F.shiftright(key, 8), F.col("n_perm")))

    def selected(total: Column, b: Column) -> Column:
        inside = F.least(F.col("end"), (b + 1) * F.col("block")) - F.greatest(F.col("begin"), b * F.col("block"))
        return total + F.when(F.pmod(b * F.col("step") + F.col("shift"), F.col("n_perm")) < F.col("picked"), inside).otherwise(F.lit(0).cast("long"))

    numbers = F.sequence(F.floor(F.col("begin") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block")))
    part = F.when((F.col("size") == 0) | (F.col("picked") == 0), F.lit(0).cast("long")).when(F.col("picked") == F.col("n_blocks"), F.col("size"))
    lined = lined.withColumn("part", part.otherwise(F.aggregate(numbers, F.lit(0).cast("long"), selected)))
    left = F.sum("part").over(Window.partitionBy("place", "shard")) - F.col("begin")
    lined = lined.withColumn("extra", F.least("size", F.greatest(F.lit(0).cast("long"), left)))
    whole = F.when(F.col("size") > 0, F.col("passes")).otherwise(0)
    return lined.select(
        "doc_id", "text_key", "source", "size", "source_size", "target",
        (whole * F.col("size") + F.col("part")).cast("long").alias("taken"), (whole + (F.col("extra") > 0).cast("int")).cast("int").alias("copies"),
        F.when(F.col("extra") > 0, F.col("extra")).otherwise(F.col("size")).alias("last"),
    )


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to its ``n``-th word and the blanks after it."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    blank = F.regexp_like(text, F.lit(r"^[\x20\x09-\x0D]")).cast("int")  # the first piece is blank
    return F.concat_ws("", F.slice(pieces, F.lit(1), (n + blank).cast("int")))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it, with all its columns; one text in a shard is cut to the words left."""
    plan = plan_mix(docs, **how).where("copies > 0").select("doc_id", "text_key", "source", "copies", F.when(F.col("last") < F.col("size"), F.col("last")).alias("cut"))
    same = Window.partitionBy("doc_id", "text_key", "source").orderBy(F.col("copies").desc(), F.col("cut").desc_nulls_first())
    plan = plan.withColumn("n", F.row_number().over(same))
    # whole input rows travel as one struct, so their names meet none of these
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", F.struct(*docs.columns).alias("row"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "text_key", "source").orderBy(F.xxhash64("row"))))
    a, b = rows.alias("a"), plan.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "text_key", "source", "n")]
    both = a.join(b, on).select("a.row", "b.copies", "b.cut", F.explode(F.sequence(F.lit(1), F.col("b.copies"))).alias("copy"))
    text = F.when(F.col("cut").isNotNull() & (F.col("copy") == F.col("copies")), first_words(F.col("row.text"), F.col("cut"))).otherwise(F.col("row.text"))
    return both.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Query: what the mix takes of every document."""
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")
