"""Running sums, group heads and neighbours along a sorted table, whatever the sizes of its groups.

``sorted_parts`` deals the rows out by ranges of the sort columns and writes
them; ``scan`` walks through each part and carries over, from one row a part on
the driver, what the parts before it (or the one after it) hold. A group may
span any number of parts, so no key is gathered in a task. All columns that
take part are longs without nulls; sums wrap at 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import cut_lineage


def sorted_parts(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` sorted by ``by`` across its parts, which ``_part`` numbers."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))


def _longs(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]) if names else np.zeros((0, batch.num_rows), np.int64)


def _heads(key: np.ndarray, last: list[int] | None) -> np.ndarray:
    """Where a key differs from the one before; ``last`` is the key before the first row."""
    new = np.ones(key.shape[1], bool)
    new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
    if last is not None:
        new[0] = key[:, 0].tolist() != last
    return new


def scan(
    rows: DataFrame,
    key: list[str],
    sums: dict[str, str] | None = None,
    sums_before: dict[str, str] | None = None,
    firsts: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
) -> DataFrame:
    """Adds long columns to ``rows`` (of ``sorted_parts``, sorted by ``key`` first).

    ``sums`` and ``sums_before`` (new name: column) are sums over the group up
    to and up to before the row, ``firsts`` the group's first value, ``after``
    the next row's value (null after the last row of the table).
    """
    sums, sums_before, firsts, after = sums or {}, sums_before or {}, firsts or {}, after or {}
    added = list(dict.fromkeys([*sums.values(), *sums_before.values()]))
    heads, nexts = list(firsts.values()), list(after.values())
    wide = [*key, *added, *heads, *nexts]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a part: its first row's key and next values, its last group's key, sums and first values, and whether it is one group."""
        part = first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, v, f = _longs(batch, key), _longs(batch, added), _longs(batch, heads)
            if first is None:
                part, first = batch.column("_part")[0].as_py(), (k[:, 0].tolist(), _longs(batch, nexts)[:, 0].tolist())
                last, total, head, one = k[:, 0].tolist(), np.zeros(len(added), np.int64), f[:, 0], True
            new = np.flatnonzero(_heads(k, last))
            if len(new):
                total, head, one = v[:, new[-1] :].sum(1), f[:, new[-1]], False
            else:
                total = total + v.sum(1)
            last = k[:, -1].tolist()
        if first is not None:
            row = [first[0], first[1], last, total.tolist(), head.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.list_(pa.int64())) for x in row), pa.array([one])], names)

    names = ["part", "first_key", "first_next", "last_key", "total", "head", "one"]
    narrow = rows.select("_part", *dict.fromkeys(wide))
    found = narrow.mapInArrow(ends, "part int, first_key array<long>, first_next array<long>, last_key array<long>, total array<long>, head array<long>, one boolean")
    found = sorted(found.collect(), key=lambda r: r.part)  # one row a part
    carried: dict[int, tuple] = {}
    state = None
    for i, r in enumerate(found):
        following = found[i + 1].first_next if i + 1 < len(found) else None
        carried[r.part] = (state, following)
        total, head = np.array(r.total, np.int64), list(r.head)
        if state is not None and r.one and state[0] == r.first_key:
            total, head = total + state[1], state[2]
        state = (list(r.last_key), total, head)

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in [*sums, *sums_before, *firsts, *after])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state_ = following = None

        def out(batch: pa.RecordBatch, new: list[np.ndarray], next_: list[int] | None) -> pa.RecordBatch:
            columns = [pa.array(x) for x in new]
            for i, c in enumerate(after.values()):
                columns.append(pa.concat_arrays([batch.column(c).slice(1).cast(pa.int64()), pa.array([next_[i] if next_ is not None else None], pa.int64())]))
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *sums, *sums_before, *firsts, *after])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, v, f = _longs(batch, key), _longs(batch, added), _longs(batch, heads)
            if held is None:
                state_, following = carried[batch.column("_part")[0].as_py()]
            else:
                yield out(*held, _longs(batch, nexts)[:, 0].tolist())
            new = _heads(k, state_[0] if state_ is not None else None)
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            total = np.cumsum(v, axis=1)
            base = np.concatenate([np.zeros((len(added), 1), np.int64), total], axis=1)[:, np.maximum(at, 0)]
            carry = np.where(at < 0, state_[1][:, None], 0) if state_ is not None else 0
            total = total - base + carry
            head = np.where(at < 0, np.array(state_[2], np.int64)[:, None], f[:, np.maximum(at, 0)]) if state_ is not None else f[:, np.maximum(at, 0)]
            made = [total[added.index(c)] for c in sums.values()]
            made += [total[added.index(c)] - v[added.index(c)] for c in sums_before.values()] + list(head)
            held = (batch, made)
            state_ = (k[:, -1].tolist(), total[:, -1], head[:, -1].tolist())
        if held is not None:
            yield out(*held, following)

    return rows.mapInArrow(run, schema)
