"""Running sums over a table in a global order: ranges are sorted in parallel, what a range begins with is carried in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofact.llm.common import extended
from tempofact.session import cut, ship

#: Sums are kept modulo 2^61, so that two of them still add up within a long.
MASK = (1 << 61) - 1


def running(df: DataFrame, order: list[str], sums: dict[str, str], group: str | None = None, name: str = "running") -> DataFrame:
    """``df`` with a running sum for each of ``sums`` (bigint column without nulls: new name) in ascending ``order``, nulls first.

    With ``group``, a bigint column without nulls and the first of ``order``, sums begin anew for each of its values. No group has
    to fit a task: ranges of rows are summed on their own and written once with their number; the driver gets one row a range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, last, total = TaskContext.get().partitionId(), 0, None, np.zeros(len(sums), dtype=np.uint64)
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            first = np.zeros(m, dtype=bool)
            if group:
                g = b.column(b.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
                first[1:] = g[1:] != g[:-1]
                first[0] = last is not None and g[0] != last
                last = g[-1]
            at = np.maximum.accumulate(np.where(first, np.arange(m), -1))
            out = []
            for i, c in enumerate(sums):
                x = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                s = np.cumsum(x, dtype=np.uint64)  # wraps, and 2^61 divides 2^64
                s += np.where(at < 0, total[i], x[at] - s[at])
                total[i] = s[-1]
                out.append(pa.array((s & np.uint64(MASK)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, *out, pa.array(np.full(m, part, dtype=np.int32)), pa.array(np.arange(n, n + m))], [*b.schema.names, *sums.values(), "_part", "_n"])
            n += m

    runs = [*sums.values()]
    fields = ", ".join(f"{r} bigint" for r in runs)
    table = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, extended(df, f"{fields}, _part int, _n bigint"))
    table = cut(table, name)
    key = F.col(group) if group else F.lit(0).cast("long")
    ends = table.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(F.struct(*runs), "_n").alias("at")).collect()  # a row a range
    before, now, held = [], [0] * len(runs), None
    for r in sorted(ends, key=lambda r: r["_part"]):
        carried = now if r["first"] == held else [0] * len(runs)
        before.append((r["_part"], r["first"], *carried))
        now = [((x if r["first"] == r["last"] else 0) + y) & MASK for x, y in zip(carried, r["at"])]
        held = r["last"]
    carries = df.sparkSession.createDataFrame(before, ", ".join(["_part int", "_first bigint", *(f"_{r} bigint" for r in runs)]))
    whole = table.join(F.broadcast(carries), "_part")
    return whole.withColumns({r: F.when(key == F.col("_first"), F.col(r) + F.col(f"_{r}")).otherwise(F.col(r)).bitwiseAND(F.lit(MASK)) for r in runs}).select(*df.columns, *runs)


ship(__name__)
