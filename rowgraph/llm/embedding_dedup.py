"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors are scaled to length one and projected on many directions, orthonormal
within each basis.  Two vectors collide in a projection if the second lies in
the window around the first.  For unit vectors of cosine ``t`` the squared
differences over a whole basis sum to ``2 - 2t``, so at most ``(2 - 2t) / w^2``
of its windows of half-width ``w`` can miss: a pair with fewer collisions than
``d`` less that number is out, and no pair that qualifies is lost.  Pairs that
pass are verified in double precision on the original vectors.

A single projection separates little (at 64 dimensions a window that holds a
pair of cosine 0.9 nearly always holds over a third of all vectors), so
counting over all pairs would be quadratic.  The counted pairs are therefore
those that meet in a sorted order: each of ``L`` orders sorts the vectors by
the signs of its own ``m`` projections, and pairs are counted within runs of
equal signs.  ``m`` grows with the logarithm of the number of vectors, so that
a run holds about ``RUN`` of them, and ``L`` is set so that a pair at the
threshold meets in none with probability ``miss`` at most.

Equal vectors collapse first.  A run with more than ``BLOCK`` vectors is split
into blocks, and a task holds two blocks, so that hot groups spread and none
of their pairs is left out.

Defined results: every row with an id is returned; vectors that are null,
empty, zero or hold null or non-finite components link with nothing; vectors
of different lengths do not link; ids are unique but for repeated rows, which
count as links of each other; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgraph.llm.vectors import basis, clean, groups, matrix
from rowgraph.operators.components import connected_components
from rowgraph.runtime import cut, ship_package

RUN = 200
BLOCK = 1024
SEED = 20


class Plan:
    """How many orders of how many projections, and the window of the count."""

    def __init__(self, vectors: int, threshold: float, miss: float = 1e-4):
        self.threshold = threshold
        self.signs = max(4, round(math.log2(max(vectors, 1) / RUN)) if vectors > RUN else 4)
        agree = 1 - math.acos(min(1.0, threshold)) / math.pi
        meet = agree**self.signs
        self.orders = 1 if meet >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-meet)))

    def runs(self, unit: np.ndarray) -> np.ndarray:
        """The run of each vector in each order."""
        d = unit.shape[1]
        signs = unit @ basis(d, self.orders * self.signs, SEED).T >= 0
        weights = 1 << np.arange(self.signs, dtype=np.int64)
        return (signs.reshape(len(unit), self.orders, self.signs) * weights).sum(axis=2)

    def passing(self, unit: np.ndarray, cross: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs ``i < j`` with enough collisions; ``cross``: only across that index."""
        n, d = unit.shape
        slack = 2 - 2 * self.threshold
        width = math.sqrt(3.2 * slack / d) + 1e-9
        allowed = math.floor(slack / width**2 + 1e-6)
        p = (unit @ basis(d, d, SEED).T).astype(np.float32)
        rows, columns = (p, p) if cross is None else (p[:cross], p[cross:])
        missed = np.zeros((len(rows), len(columns)), np.uint16)
        for k in range(d):
            missed += np.abs(rows[:, k, None] - columns[None, :, k]) > np.float32(width + 1e-5)
        close = missed <= allowed
        if cross is None:
            i, j = np.nonzero(np.triu(close, 1))
            return i, j
        i, j = np.nonzero(close)
        return i, j + cross


def _links(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Distinct ``(a, b)`` of nodes whose vectors reach the threshold."""
    spark = nodes.sparkSession
    ship_package(spark)
    element = nodes.schema["v"].dataType.elementType.simpleString()

    def keyed(batches, vectors: bool):
        for batch in batches:
            v, sizes = batch.column("v"), np.diff(np.asarray(batch.column("v").offsets))
            for d in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == d))
                part, ids = v.take(at), batch.column("id").take(at)
                x = matrix(part)
                runs = plan.runs(x / np.linalg.norm(x, axis=1)[:, None])
                for k in range(plan.orders):
                    n = len(ids)
                    columns = [pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(runs[:, k])]
                    names = ["d", "k", "run"]
                    yield pa.RecordBatch.from_arrays(columns + ([ids, part] if vectors else []), names + (["id", "v"] if vectors else []))

    run = "d int, k int, run long"
    hot = (
        nodes.select("id", "v").mapInArrow(lambda b: keyed(b, False), run)
        .groupBy("d", "k", "run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
        .select("d", "k", "run", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    rows = nodes.select("id", "v").mapInArrow(lambda b: keyed(b, True), f"{run}, id long, v array<{element}>")
    split = rows.join(hot, ["d", "k", "run"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = split.withColumn("own", F.expr("pmod(xxhash64(id), blocks)").cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = paired.select(
        "d", "k", "run", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "v"
    )
    keys = ["d", "k", "run", "lo", "hi"]

    def compare(batches):
        for table in groups(batches, keys):
            if table.num_rows < 2:
                continue
            first = table.slice(0, 1).to_pylist()[0]
            own, ids, x = table.column("own").to_numpy(), table.column("id").to_numpy(), matrix(table.column("v"))
            cross = None
            if first["lo"] != first["hi"]:
                cross = int((own == first["lo"]).sum())
            norms = np.linalg.norm(x, axis=1)
            unit = x / norms[:, None]
            i, j = plan.passing(unit, cross)
            if not len(i):
                continue
            cosine = np.einsum("ij,ij->i", x[i], x[j]) / (norms[i] * norms[j])
            i, j = i[cosine >= plan.threshold], j[cosine >= plan.threshold]
            runs = plan.runs(unit)
            # a pair belongs to the first order in which it meets
            new = ~(runs[i, : first["k"]] == runs[j, : first["k"]]).any(axis=1)
            a, b = ids[i[new]], ids[j[new]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return placed.repartition(*keys).sortWithinPartitions(*keys, "own").mapInArrow(compare, "a long, b long")


def near_vectors(
    table: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = 1e-4
) -> DataFrame:
    """Rows ``(id, n_links, component_id, kept)``, one per row with an id."""
    every = table.filter(F.col(id_col).isNotNull())
    members = clean(every, id_col, vector_col)
    nodes = cut(members.groupBy("v").agg(F.min("id").cast("long").alias("id"), F.count(F.lit(1)).alias("copies")))
    links = cut(_links(nodes, Plan(nodes.count(), threshold, miss)))
    sizes = nodes.select("id", "copies")
    ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(sizes.withColumnsRenamed({"id": "b", "copies": "c"}), "b").groupBy(F.col("a").alias("id")).agg(F.sum("c").alias("linked"))
    known = (
        nodes.join(degree, "id", "left")
        .join(connected_components(links).withColumnRenamed("node", "id"), "id", "left")
        .select("v", F.coalesce("component", "id").alias("least"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    joined = every.select(
        F.col(id_col), F.when(F.col(id_col).isNotNull(), F.col(vector_col)).alias("v")
    ).join(known, "v", "left")
    return joined.select(
        F.col(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("least"), F.col(id_col)).cast("long").alias("component_id"),
        F.coalesce(F.col(id_col) == F.col("least"), F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
