"""Window plans that stay parallel when one key holds a large share of rows.

* ``running_total``: running sum/count per key split into fixed-size chunks of
  the order column, so a hot key is spread over many tasks.
* ``time_positions``: a dense 1..N numbering in (time, id) order from counts of
  minutes and of groups within them; no single-partition window over rows,
  nothing materialised.
* ``rolling_global``: count-based rolling frames over a global order with the
  halo technique: fixed blocks of B rows, each block also receives the last H
  rows of the previous block, one window per block.
* ``top_k``: rank-limited window; Spark plans a partial group limit before the
  shuffle, so hot groups are cut down map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = 1 << 16


def same(a: str, b: str, cols: list[str]) -> Column:
    """Null-safe equality of ``cols`` of the aliases ``a`` and ``b`` (an equi-join key for the planner)."""
    out = F.lit(True)
    for i, c in enumerate(cols):
        on = F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        out = on if i == 0 else out & on
    return out


def running_total(
    df: DataFrame,
    keys: list[str],
    order_col: str,
    value: Column,
    out_col: str,
    chunk: int = DEFAULT_CHUNK,
    tiebreak: list[str] | None = None,
) -> DataFrame:
    """Add ``out_col`` = sum of ``value`` over rows of the same key with
    (order, tiebreak) <= the current row's. ``order_col`` must be integral;
    null keys are a key of their own and null orders come first. Pass decimal
    or integral values: their sums do not depend on the partitioning.

    The rows are shuffled once, by (key, chunk of the order column). The sums
    of the chunks (partial sums before a shuffle of one row per task and chunk)
    come from a second, narrow reading of the input; their prefix sums are
    joined to the rows where these already lie.
    """
    tiebreak = tiebreak or []
    ch, v = "_chunk", "_val"
    by = [*keys, ch]
    base = df.withColumn(ch, F.floor(F.col(order_col) / F.lit(chunk))).withColumn(v, value)
    prior = Window.partitionBy(*keys).orderBy(ch).rowsBetween(Window.unboundedPreceding, -1)
    sums = base.groupBy(*by).agg(F.sum(v).alias("_csum"))
    offsets = sums.select(*by, F.sum("_csum").over(prior).alias("_off"))
    joined = base.alias("a").join(offsets.alias("b"), same("a", "b", by), "left").select("a.*", "b._off")
    within = Window.partitionBy(*by).orderBy(order_col, *tiebreak).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(v).over(within)
    total = F.when(F.col("_off").isNull(), running).otherwise(F.col("_off") + running)
    return joined.withColumn(out_col, total).drop(ch, v, "_off")


_LOWEST = -(1 << 60)
_MINUTE, _SLOT = 60_000_000, 10_000  # microseconds


def _id_chunks(id_col: Column, chunk: int) -> tuple[Column, Column]:
    """Two order-preserving parts of an integral id: ids below 2 ** 48 go by ``chunk``, larger ones (hashes) by their upper bits, so neither kind makes a group a row."""
    small = (id_col >= -(1 << 48)) & (id_col < 1 << 48)
    return F.shiftright(id_col, 48), F.when(small, F.floor(id_col / chunk)).otherwise(F.lit(0))


def time_positions(df: DataFrame, ts_col: str, id_col: str, out_col: str = "rn", keys: list[str] | None = None, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Dense 1-based position of each row in (time, id) order, over the whole table or per ``keys``; a null time comes first.

    Rows are numbered in groups: those within one slot of ``_SLOT``
    microseconds, but rows at the very start of a slot (coarse times lie there)
    by ranges of their ids too, so that a single time holding a large share of
    the rows is many groups. What comes before a group is counted: groups
    within their minute, minutes within the table (one row a minute and key in
    the last window). ``id_col`` is integral; rows of equal time and id are
    numbered in any order.
    """
    keys = keys or []
    ident = F.col(id_col).cast("long")
    micros = F.coalesce(F.unix_micros(F.col(ts_col).cast("timestamp")), F.lit(_LOWEST))
    inside = F.pmod(micros, F.lit(_SLOT)) != 0
    high, low = _id_chunks(ident, chunk)
    base = df.withColumns({
        "_m": F.floor(micros / _MINUTE), "_g": F.floor(F.pmod(micros, F.lit(_MINUTE)) / _SLOT) * 2 + inside.cast("int"),
        "_c": F.when(inside, 0).otherwise(F.coalesce(high, F.lit(_LOWEST))), "_d": F.when(inside, 0).otherwise(F.coalesce(low, F.lit(_LOWEST))),
    })
    minute, group = [*keys, "_m"], [*keys, "_m", "_g", "_c", "_d"]
    counts = base.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*minute).orderBy("_g", "_c", "_d")
    counts = counts.select(*group, "_n", F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"), F.lead(F.lit(True)).over(upto).alias("_more"))
    every = (Window.partitionBy(*keys) if keys else Window).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    minutes = counts.where(F.col("_more").isNull()).select(*minute, F.coalesce(F.sum("_run").over(every), F.lit(0)).alias("_before"))
    offsets = counts.alias("a").join(minutes.alias("b"), same("a", "b", minute)).select(*(f"a.{c}" for c in group), (F.col("_before") + F.col("_run") - F.col("_n")).alias("_off"))
    own = Window.partitionBy(*group).orderBy(F.col(ts_col), F.col(id_col))
    rows = base.alias("a").join(offsets.alias("b"), same("a", "b", group)).select("a.*", "b._off")
    return rows.withColumn(out_col, F.col("_off") + F.row_number().over(own)).drop("_m", "_g", "_c", "_d", "_off")


def trailing_sums(
    df: DataFrame,
    part_cols: list[str],
    order_cols: list[str],
    rn_col: str,
    sums: dict[str, tuple[int, Column]],
) -> DataFrame:
    """Sums over the current row and the n-1 rows before it, in O(1) per row.

    ``sums`` maps output column → (n, integral Column). A running sum over the
    window partition minus the same running sum n rows back gives the frame
    sum; integer arithmetic keeps it exact. (A sliding ROWS frame is
    re-aggregated for every row, O(n) per row.) ``rn_col`` is the row's
    1-based position in its logical sequence; the number of rows in the frame
    is ``least(rn, n)``. Rows that have fewer than n-1 predecessors inside the
    window partition must have ``rn`` < n (true for halo blocks, where the
    first n-1 rows of a block are copies of the previous block).
    """
    w_run = Window.partitionBy(*part_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_ord = Window.partitionBy(*part_cols).orderBy(*order_cols)
    runs = {f"_run_{k}": F.sum(v).over(w_run) for k, (_, v) in sums.items()}
    out = df.withColumns(runs)
    outs = {
        k: F.col(f"_run_{k}") - F.coalesce(F.lag(f"_run_{k}", n).over(w_ord), F.lit(0))
        for k, (n, _) in sums.items()
    }
    return out.withColumns(outs).drop(*runs)


def rolling_global(
    df: DataFrame,
    order_cols: list[str],
    aggs: dict[str, tuple[int, Column]],
    block: int = 1 << 16,
    exact_sums: dict[str, tuple[int, Column]] | None = None,
    keys: list[str] | None = None,
    numbering: str = "time",
) -> DataFrame:
    """Count-based trailing frames over a global order (or per ``keys``),
    computed per block of ``block`` rows plus a halo.

    ``aggs`` maps output column → (frame length n, aggregate Column); the
    frame is the current row and the n-1 rows before it in the sequence.
    ``exact_sums`` (output → (n, integral or decimal Column)) are computed with
    ``trailing_sums`` instead of a sliding frame. The 1-based position in the
    sequence is kept as ``_rn``. With keys, a key holding a large share of the
    rows is split into many blocks, so no window partition exceeds
    ``block`` + halo rows.

    ``numbering``: ``time`` (``order_cols`` is a time and an integral id,
    numbered by ``time_positions``) or ``chunked`` (keys required,
    ``order_cols[0]`` integral: a skew-safe running count).
    """
    keys = keys or []
    exact_sums = exact_sums or {}
    halo = max([n for n, _ in aggs.values()] + [n for n, _ in exact_sums.values()]) - 1
    if block <= halo:
        raise ValueError("block must exceed the largest frame")
    if numbering == "chunked":
        numbered = running_total(df, keys, order_cols[0], F.lit(1), "_rn", chunk=block, tiebreak=order_cols[1:])
    else:
        numbered = time_positions(df, *order_cols, "_rn", keys=keys)
    numbered = numbered.withColumn("_home", F.floor((F.col("_rn") - 1) / F.lit(block)))
    # a row is also a halo row of the next block when it is among the last
    # `halo` rows of its own block
    in_halo = ((F.col("_rn") - 1) % F.lit(block)) >= F.lit(block - halo)
    copies = numbered.withColumn(
        "_blk",
        F.explode(F.when(in_halo, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array(F.col("_home")))),
    )
    out = copies
    if aggs:
        out = out.withColumns(
            {
                name: agg.over(Window.partitionBy(*keys, "_blk").orderBy("_rn").rowsBetween(-(n - 1), Window.currentRow))
                for name, (n, agg) in aggs.items()
            }
        )
    if exact_sums:
        out = trailing_sums(out, [*keys, "_blk"], ["_rn"], "_rn", exact_sums)
    return out.filter(F.col("_blk") == F.col("_home")).drop("_blk", "_home")


def rolling_naive(
    df: DataFrame,
    order_cols: list[str],
    aggs: dict[str, tuple[int, Column]],
    exact_sums: dict[str, tuple[int, Column]] | None = None,
) -> DataFrame:
    """Same result as ``rolling_global`` with one global window (one task)."""
    out = df.withColumn("_rn", F.row_number().over(Window.orderBy(*order_cols)))
    if aggs:
        out = out.withColumns(
            {name: agg.over(Window.orderBy(*order_cols).rowsBetween(-(n - 1), Window.currentRow)) for name, (n, agg) in aggs.items()}
        )
    if exact_sums:
        out = trailing_sums(out, [], order_cols, "_rn", exact_sums)
    return out


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
