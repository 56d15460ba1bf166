"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots and posted in
the inverted files of the first ``post`` of them.  A query opens the files of
its own first ``probe`` pivots and ranks every vector that they hold by the
exact inner product.  Nothing in an opened file is dropped, neither at a length
nor by the footrule distance between the two orders: the vectors are read
anyway, the footrule costs more than the product, and a bound on it that is
fitted to a sample loses neighbours where the sample is unlike the whole.

Pivots are a bounded sample (``pivots`` vectors of least id hash); every row
is posted.  Files with many vectors or many queries are split into blocks, and
a task holds one block of each, so no file is gathered whole.  A query that
finds fewer than ``k`` goes to all files.  It is the same at every size;
``exact=True`` opens all files for all queries.

Defined results: ranks start at 1, ties go to the smaller id; a query's own id
is no candidate; with fewer candidates than ``k`` all are returned; vectors
that are null, empty, zero or hold null or non-finite components take no part;
vectors must share one length (that of the pivots; others take no part);
repeated rows are separate candidates; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowgraph.llm.vectors import clean, groups, matrix
from rowgraph.runtime import cut, ship_package

VECTORS_A_BLOCK = 4096
QUERIES_A_BLOCK = 1024


class Index:
    """Pivots, and the orders of vectors by them."""

    def __init__(self, pivots: np.ndarray, post: int, probe: int):
        self.pivots, self.post, self.probe = pivots, post, probe

    def orders(self, x: np.ndarray) -> np.ndarray:
        """For each vector its pivots, nearest (greatest cosine) first."""
        near = (x / np.linalg.norm(x, axis=1)[:, None]) @ self.pivots.T
        return np.argsort(-near, axis=1, kind="stable").astype(np.int16)


def _positions(orders: np.ndarray) -> np.ndarray:
    out = np.empty_like(orders)
    np.put_along_axis(out, orders, np.arange(orders.shape[1], dtype=orders.dtype)[None, :], axis=1)
    return out


def _postings(vectors: DataFrame, index: Index, many: int, only: DataFrame | None = None) -> DataFrame:
    """``(file, id, v)`` for the first ``many`` pivots of each vector."""
    element = vectors.schema["v"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            orders = index.orders(matrix(batch.column("v")))
            for k in range(many):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(orders[:, k].astype(np.int32)), batch.column("id"), batch.column("v")], ["file", "id", "v"]
                )

    return vectors.mapInArrow(run, f"file int, id long, v array<{element}>")


def _search(vectors: DataFrame, queries: DataFrame, index: Index, k: int, all_files: bool) -> DataFrame:
    pivots = len(index.pivots)
    probe = pivots if all_files else index.probe
    post = 1 if probe >= pivots else index.post
    held, asked = _postings(vectors, index, post), _postings(queries, index, probe)
    # one row per file: as many as there are pivots
    def blocks(df: DataFrame, size: int) -> Column:
        counts = {r["file"]: -(-r["n"] // size) for r in df.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
        return F.element_at(F.array(*[F.lit(counts.get(p, 1)) for p in range(pivots)]), F.col("file") + 1)

    vb, qb = blocks(held, VECTORS_A_BLOCK), blocks(asked, QUERIES_A_BLOCK)
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    left = held.withColumn("n", vb).select("file", own.alias("vb"), every(qb).alias("qb"), F.lit(0).alias("asks"), "id", "v")
    right = asked.withColumn("n", qb).select("file", every(vb).alias("vb"), own.alias("qb"), F.lit(1).alias("asks"), "id", "v")
    keys = ["file", "vb", "qb"]

    def work(batches):
        for table in groups(batches, keys):
            asks = table.column("asks").to_numpy() == 1
            if asks.all() or not asks.any():
                continue
            file = table.column("file")[0].as_py()
            ids, x = table.column("id").to_numpy(), matrix(table.column("v"))
            orders = index.orders(x)
            vids, vx, vpos = ids[~asks], x[~asks], _positions(orders[~asks])
            out_q, out_v, out_s = [], [], []
            for qid, q, order in zip(ids[asks], x[asks], orders[asks]):
                at = int(np.flatnonzero(order == file)[0])
                # a vector is met in the first of the query's files that holds it
                new = (vids != qid) & ~(vpos[:, order[:at]] < post).any(axis=1)
                rows = np.flatnonzero(new)
                if not len(rows):
                    continue
                score = vx[rows] @ q
                if len(rows) > k:
                    # all that tie with the k-th stay for the order by id
                    bar = np.partition(score, len(rows) - k)[len(rows) - k]
                    rows, score = rows[score >= bar], score[score >= bar]
                    best = np.lexsort((vids[rows], -score))[:k]
                    rows, score = rows[best], score[best]
                out_q.append(np.full(len(rows), qid))
                out_v.append(vids[rows])
                out_s.append(score)
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

    met = left.unionAll(right).repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(work, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _fit(vectors: DataFrame, pivots: int, post: int, probe: int) -> Index:
    """Pivots from a bounded sample: vectors of least hash, of the greatest length among them."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(8 * pivots).collect()
    most = max((len(r["v"]) for r in rows), default=0)
    x = np.array([r["v"] for r in rows if len(r["v"]) == most], dtype=np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None] if len(x) else np.zeros((0, 1))
    unit = unit[:pivots]
    return Index(unit, min(post, len(unit)), min(probe, len(unit)))


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = 64,
    post: int = 14,
    probe: int = 14,
    exact: bool = False,
) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)`` for the rows that ``is_query`` picks."""
    ship_package(table.sparkSession)
    good = clean(table, id_col, vector_col).withColumn("id", F.col("id").cast("long"))
    asks = clean(table.filter(is_query), id_col, vector_col).withColumn("id", F.col("id").cast("long")).dropDuplicates(["id"])
    index = _fit(good, pivots, post, probe)
    if not len(index.pivots):
        return good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same = F.size("v") == index.pivots.shape[1]
    good, asks = good.filter(same), asks.filter(same)
    found = _search(good, asks, index, k, all_files=exact)
    if not exact:
        found = cut(found)
        counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
        short = cut(asks.join(counts, F.col("id") == F.col("query_id"), "left").filter(F.coalesce("found", F.lit(0)) < k).select("id", "v"))
        if short.limit(1).count():
            again = _search(good, short, index, k, all_files=True)
            found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*again.columns).unionAll(again)
    return found.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(table, F.col("vec_id") % 20 == 0)


SQL = """
WITH good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
