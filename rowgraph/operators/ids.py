"""Dense ids in a given order without a single-task window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgraph.runtime import cut, ship_package


def _starts(sizes: dict[int, int]) -> Column:
    """How many come before the rows of partition ``_at``."""
    total, before = 0, {}
    for at in sorted(sizes):
        before[at], total = total, total + sizes[at]
    if not before:
        return F.lit(0).cast("long")
    table = F.create_map(*[F.lit(x) for at, n in before.items() for x in (at, n)])
    return F.element_at(table, F.col("_at")).cast("long")


def with_dense_ids(df: DataFrame, name: str, *order: str, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``df`` with 1, 2, ... in ``order`` as ``name``.

    Rows are range-partitioned and sorted; only the number of rows of each
    partition goes to the driver.
    """
    placed = keep(df.orderBy(*order).withColumn("_at", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()))
    sizes = {r["_at"]: r["n"] for r in placed.groupBy("_at").agg(F.count(F.lit(1)).alias("n")).collect()}
    within = F.col("_k").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, _starts(sizes) + within + 1).drop("_at", "_k")


def with_group_ids(
    df: DataFrame, name: str, *order: str, within: Column | None = None, firsts: bool = False, keep: Callable[[DataFrame], DataFrame] = cut
) -> DataFrame:
    """``df`` with 1, 2, ... for the values of ``order``, which equal ones share, as ``name``; ``first`` marks one row of each.

    Rows are sent once, by range of ``order``, so equal ones are in one
    partition; none of ``order`` is null.  The first row of each is the one
    that ``within`` sorts first; with ``firsts`` only those are left.
    """
    ship_package(df.sparkSession)
    columns = list(order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.schema.get_field_index(c) for c in columns]
            changed = np.zeros(batch.num_rows, dtype=bool)
            changed[0] = last != (last := [batch.column(i)[0].as_py() for i in at])
            for i in at:
                column = batch.column(i)
                changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            last = [batch.column(i)[batch.num_rows - 1].as_py() for i in at]
            within = seen + np.cumsum(changed)
            seen = int(within[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within), pa.array(changed)], names=[*batch.schema.names, "_k", "first"])

    placed = df.repartitionByRange(*order).sortWithinPartitions(*order, *([within] if within is not None else [])).withColumn("_at", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    counted = placed.mapInArrow(count, f"{kinds}, _k long, first boolean")
    placed = keep(counted.filter("first") if firsts else counted)
    sizes = {r["_at"]: r["n"] for r in placed.groupBy("_at").agg(F.max("_k").alias("n")).collect()}
    return placed.withColumn(name, _starts(sizes) + F.col("_k")).drop("_at", "_k")
