"""Best-fit packing into bins of several permitted lengths.

Documents longer than the longest permitted length are cut into pieces of that
length and a rest; nothing is truncated.  Pieces go longest first to the open
bin with the least room that holds them.  If none does, the size opened is the
one of least cost for each token it is expected to hold, given what is still
to come; at the end each bin shrinks to the least permitted length that holds
its contents, so the sizes are chosen jointly with the fill.

Only ids and lengths are packed.  They are spread over groups of about
``GROUP`` documents, each packed by one task in memory proportional to the
group; the loss against one global packing is at most a few open bins a group.

Defined results: a document without a token is a piece of length 0; a null
length counts as 0; repeated rows are packed each for itself; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgraph.runtime import ship_package

CAPACITIES = (512, 1024, 2048, 4096)
GROUP = 50_000
#: Tokens that a bin costs beyond its length.
OVERHEAD = 16
#: The length at which attention, quadratic in it, costs as much as all that is linear.
QUADRATIC_FROM = 8192


def default_cost(capacity: int) -> float:
    """What a training step pays for a sequence: its length, attention over it, and a fixed part."""
    return capacity + capacity * capacity / QUADRATIC_FROM + OVERHEAD


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = default_cost):
    """Bins of ``(capacity, used, [item, ...])`` for items that each fit the greatest capacity."""
    sizes = sorted(set(capacities))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    to_come = sum(lengths)
    bins: list[list] = []
    open_by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while a bin has room r
    for i in order:
        need = lengths[i]
        to_come -= need
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            stack = open_by_room[room]
            at = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            best = min((c for c in sizes if c >= need), key=lambda c: (cost(c) / max(1, min(c, need + to_come)), c))
            at, room = len(bins), best
            bins.append([best, 0, []])
        entry = bins[at]
        entry[1] += need
        entry[2].append(i)
        room -= need
        open_by_room.setdefault(room, []).append(at)
        rooms |= 1 << room
    for entry in bins:
        entry[0] = next(c for c in sizes if c >= entry[1])
    return bins


def count_tokens(text: Column) -> Column:
    """Words and marks of a text: what a packed length is measured in by default."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]++|[^\s\p{L}\p{N}]"))


_OUT = "bin_id long, capacity int, used int, `{id}` {kind}, piece int, start long, length int, bin_offset int"


def pack_documents(
    docs: DataFrame,
    length: Column,
    id_col: str = "doc_id",
    capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = default_cost,
) -> DataFrame:
    """One row per piece: its bin, the bin's final capacity and fill, and its place."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    most = max(capacities)
    groups = max(1, -(-docs.count() // GROUP))
    sized = docs.select(F.col(id_col), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n"))

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        ids, lengths, owner, piece = table.column(0), [], [], []
        for row, n in enumerate(table.column(1).to_pylist()):
            for k, at in enumerate(range(0, max(n, 1), most)):
                lengths.append(min(most, n - at))
                owner.append(row)
                piece.append(k)
        base = TaskContext.get().partitionId() << 32
        rows: list[list] = [[] for _ in range(7)]
        owners = []
        for k, (capacity, used, items) in enumerate(pack(lengths, capacities, cost)):
            offset = 0
            for i in items:
                owners.append(owner[i])
                for column, value in zip(rows, (base + k, capacity, used, piece[i], piece[i] * most, lengths[i], offset)):
                    column.append(value)
                offset += lengths[i]
        taken = ids.combine_chunks().take(pa.array(owners, pa.int64()))
        i32, i64 = pa.int32(), pa.int64()
        made = [pa.array(c, t) for c, t in zip(rows, (i64, i32, i32, i32, i64, i32, i32))]
        yield from pa.table(
            [*made[:3], taken, *made[3:]],
            names=["bin_id", "capacity", "used", id_col, "piece", "start", "length", "bin_offset"],
        ).to_batches()

    # rows are dealt out evenly, whatever their ids
    return sized.repartition(groups).mapInArrow(run, _OUT.format(id=id_col, kind=kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, count_tokens(F.col("text")))
