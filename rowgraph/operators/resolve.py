"""Which names are one entity: the match lanes and their components.

Every lane works on distinct names.  Names that share a phonetic key form a
star around one of them instead of a clique, which has the same components;
only keys of which every name is in a vetoed pair are expanded, because there a
direct pair has to be taken out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from rowgraph.functions import phonetic, text
from rowgraph.operators.components import connected_components
from rowgraph.operators.ids import with_dense_ids
from rowgraph.runtime import cut, ship_package

FUZZY = 82  # per cent of shared shingles
SHORT = 16  # shingles of a set that is paired by remainders
BLOCK = 1024  # vectors of a block at least, if there are so many
BLOCK_VALUES = 1 << 20  # components of a block's vectors at most, unless they are wider than that allows
TILE = 1024  # vectors of a block that are multiplied at once


def _with_keys(names: DataFrame, col: str = "norm") -> DataFrame:
    """Rows ``(norm, keys)``; words of a-z in the JVM, the rest through Arrow."""
    ship_package(names.sparkSession)
    kept = names.select(F.col(col).alias("norm")).filter("norm is not null and norm <> ''")
    native = kept.filter(F.col("norm").rlike("^[a-z]+$")).select("norm", phonetic.latin_keys(F.col("norm")).alias("keys"))
    general = kept.filter(~F.col("norm").rlike("^[a-z]+$")).select("norm", phonetic.phonetic_keys_udf("norm").alias("keys"))
    return native.unionAll(general)


def phonetic_keyed(names: DataFrame, col: str = "norm") -> DataFrame:
    """Rows ``(norm, key)``."""
    return _with_keys(names, col).select("norm", F.explode("keys").alias("key"))


def phonetic_edges(names: DataFrame, vetoed: DataFrame | None = None, gated: bool = True) -> DataFrame:
    """Pairs ``(a, b)`` that connect the names sharing a key.

    Under a key where a vetoed pair meets, the hub of the star is a name of no
    such pair; if there is none, all pairs are formed.
    """
    kept = names.filter(text.passes_gate(F.col("norm"))) if gated else names
    keyed = phonetic_keyed(kept).distinct()
    if vetoed is None:
        hubs = keyed.groupBy("key").agg(F.min("norm").alias("hub"))
        return keyed.join(hubs, "key").filter("norm <> hub").select(F.col("hub").alias("a"), F.col("norm").alias("b")).distinct()
    keyed = cut(keyed)
    left, right = keyed.withColumnRenamed("norm", "norm_a"), keyed.withColumnRenamed("norm", "norm_b")
    met = vetoed.select("norm_a", "norm_b").join(left, "norm_a").join(right, ["norm_b", "key"]).select("key", F.explode(F.array("norm_a", "norm_b")).alias("norm")).distinct()
    flagged = keyed.join(met.withColumn("bound", F.lit(True)), ["key", "norm"], "left")
    hubs = flagged.groupBy("key").agg(F.min(F.when(F.col("bound").isNull(), F.col("norm"))).alias("hub"))
    star = keyed.join(hubs.filter("hub is not null"), "key").filter("norm <> hub").select(F.least("hub", "norm").alias("a"), F.greatest("hub", "norm").alias("b"))
    clique = left.join(hubs.filter("hub is null"), "key", "left_semi").join(right, "key").filter("norm_a < norm_b")
    return star.unionAll(clique.select(F.col("norm_a").alias("a"), F.col("norm_b").alias("b"))).distinct()


def phonetic_pairs(names: DataFrame, gated: bool = True) -> DataFrame:
    """Every pair ``(a, b)``, ``a < b``, of names that share a key.

    A pair comes from the first of the keys it shares only, so the pairs, which
    grow with the square of a key's names, are neither shuffled nor held.
    """
    kept = names.filter(text.passes_gate(F.col("norm"))) if gated else names
    keyed = cut(_with_keys(kept.select("norm").distinct()).withColumn("key", F.explode(F.array_distinct("keys"))))
    a, b = (keyed.select("key", F.col("norm").alias(x), F.col("keys").alias(f"k{x}")) for x in "ab")
    single = (F.size("ka") == 1) | (F.size("kb") == 1)
    first = F.when(single, True).otherwise(F.element_at(F.array_intersect("ka", "kb"), 1) == F.col("key"))
    return a.join(b, "key").filter((F.col("a") < F.col("b")) & first).select("a", "b")


def share_a_key(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of ``names`` that share a phonetic key, found from the pairs."""
    keys = _with_keys(names.select("norm").distinct())
    a, b = (keys.select(F.col("norm").alias(x), F.col("keys").alias(f"k{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").filter(F.arrays_overlap("ka", "kb")).select("a", "b")


def _fits(small: int, large: int) -> tuple[int, int] | None:
    """Shingles that sets of these sizes may lack of each other at the threshold; None if they cannot reach it."""
    shared = -(-FUZZY * (small + large) // (100 + FUZZY))
    return (small - shared, large - shared) if shared <= small else None


def _remainders(sets: DataFrame) -> DataFrame:
    """Rows ``(norm, kind, large, key)``: what is left of a set without as many shingles as a partner may lack.

    ``kind`` holds both sizes; two sets up to ``SHORT`` reach the threshold
    exactly if they have a remainder of one kind, one as the smaller of the two
    and one as the larger (or both, at one size).
    """
    roles = []
    for large in range(1, SHORT + 1):
        for small in range(1, large + 1):
            if fit := _fits(small, large):
                kind = small * (SHORT + 1) + large
                roles += [(small, kind, False, fit[0])] + ([(large, kind, True, fit[1])] if large > small else [])
    table = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(r, ("n", "kind", "large", "less"))]) for r in roles]))
    table = sets.sparkSession.range(1).select(table.alias("r")).select("r.*")

    def without(all_of: Column, h: Column, depth: int) -> Column:
        if depth == 0:
            return F.array(all_of)
        parts = F.transform(h, lambda x, i: without(all_of.bitwiseXOR(x), F.slice(h, i + 2, F.size(h)), depth - 1))
        return F.flatten(parts)

    hashed = sets.filter(F.size("grams") <= SHORT).select("norm", F.size("grams").alias("n"), F.transform("grams", lambda g: F.xxhash64(g)).alias("h"))
    hashed = hashed.withColumn("all", F.aggregate("h", F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)))
    placed = hashed.join(F.broadcast(table), "n")
    left = None
    for depth in sorted({r[3] for r in roles}):
        one = placed.filter(F.col("less") == depth).select("norm", "kind", "large", F.explode(without(F.col("all"), F.col("h"), depth)).alias("key"))
        left = one if left is None else left.unionAll(one)
    return left


def fuzzy_candidates(names: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, among them all whose shingle sets are similar enough.

    Sets of up to ``SHORT`` shingles that are similar enough lack few of
    each other, so they meet by what is left of each without those, and hardly
    any others do.  Where one is larger, prefix filtering: with shingles
    ordered from rare to frequent, two sets that reach the threshold share one
    among the first few of each.
    """
    sets = cut(names.select("norm", text.shingles(F.col("norm")).alias("grams")).filter(F.size("grams") > 0))
    left = _remainders(sets)
    small = left.filter("not large").select("kind", "key", F.col("norm").alias("p"))
    large = left.filter(F.col("large") | (F.col("kind") % (SHORT + 2) == 0)).select("kind", "key", F.col("norm").alias("q"), "large")
    short = small.join(large, ["kind", "key"]).filter("large or p < q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()

    partner = next(n for n in range(1, SHORT + 2) if _fits(n, SHORT + 1))
    sized = sets.withColumn("n", F.size("grams")).filter(F.col("n") >= partner)
    grams = sized.select("norm", "n", F.explode("grams").alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("norm").orderBy("df", "gram")
    prefix = F.col("n") - F.ceil(F.col("n") * FUZZY / 100) + 1
    heads = grams.join(counted, "gram").withColumn("at", F.row_number().over(rarest)).filter(F.col("at") <= prefix).select("gram", "norm", "n")
    one = heads.select("gram", F.col("norm").alias("a"), F.col("n").alias("na"))
    other = heads.filter(F.col("n") > SHORT).select("gram", F.col("norm").alias("b"), F.col("n").alias("nb"))
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * FUZZY) & (F.col("a") != F.col("b"))
    long = one.join(other, "gram").filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    return short.unionAll(long)


def fuzzy_pairs(names: DataFrame, gated: bool = True) -> DataFrame:
    """Pairs ``(a, b, shared, either)`` of names whose shingle sets are similar enough."""
    kept = names.filter(text.passes_gate(F.col("norm"))) if gated else names
    # a name is short, so its shingles are made again rather than carried
    sized = fuzzy_candidates(kept).withColumn("x", text.shingles(F.col("a"))).withColumn("y", text.shingles(F.col("b")))
    shared = sized.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("s"))
    return shared.select("a", "b", "shared", (F.col("s") - F.col("shared")).alias("either")).filter(F.col("shared") * 100 >= F.col("either") * FUZZY)


def embedding_pairs(vectors: DataFrame, threshold: float = 0.83, id_col: str = "norm", vector_col: str = "vector") -> DataFrame:
    """Pairs ``(a, b, cosine)``, ``a < b``, at or above the threshold.

    All pairs are compared, as the lane asks, block against block: a task holds
    two blocks of vectors and multiplies them tile by tile.  A vector travels
    once for each block, so blocks are as large as a task's memory allows, not
    as many as the vectors would fill at some fixed size.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    single = isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    good = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v")).filter(
        F.col("id").isNotNull() & (F.size("v") > 0)
    )
    many, widest = good.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = block_count(many, widest or 1, spark.sparkContext.defaultParallelism)
    own = good.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = paired.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "v")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
        lists = table.column("v").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        within = key[0].as_py() == key[1].as_py()
        sides = [np.arange(len(ids))] * 2 if within else [np.flatnonzero(own == k.as_py()) for k in key]
        found: list[tuple] = []

        def tiles(left: np.ndarray, right: np.ndarray):
            for i in range(0, len(left), TILE):
                for j in range(i if within else 0, len(right), TILE):
                    yield left[i : i + TILE], right[j : j + TILE], within and i == j

        # vectors of different lengths have cosine 0
        if threshold <= 0:
            for p, q, same in tiles(*sides):
                differ = sizes[p][:, None] != sizes[q][None, :]
                i, j = np.nonzero(np.triu(differ, 1) if same else differ)
                found.append((p[i], q[j], np.zeros(len(i))))
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x = values[starts[at][:, None] + np.arange(d)]
            norms = np.linalg.norm(x, axis=1)
            unit = (x / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)
            place = np.full(len(ids), -1)
            place[at] = np.arange(len(at))
            # what rounding to single precision may take from a product
            slack = 1e-6 + 3e-7 * d
            for p, q, same in tiles(*(s[sizes[s] == d] for s in sides)):
                near = unit[place[p]] @ unit[place[q]].T >= threshold - slack
                i, j = np.nonzero(np.triu(near, 1) if same else near)
                for k in range(0, len(i), TILE * 16):
                    e, f = p[i[k : k + TILE * 16]], q[j[k : k + TILE * 16]]
                    dot = np.einsum("ij,ij->i", x[place[e]], x[place[f]])
                    scale = norms[place[e]] * norms[place[f]]
                    value = np.where(scale > 0, dot / np.where(scale > 0, scale, 1), 0.0)
                    keep = value >= threshold
                    found.append((e[keep], f[keep], value[keep]))
        e, f, value = (np.concatenate(c) for c in zip((np.zeros(0, int), np.zeros(0, int), np.zeros(0)), *found))
        ordered = ids[e] < ids[f]
        kinds = table.schema.field("id").type
        a, b = np.where(ordered, ids[e], ids[f]), np.where(ordered, ids[f], ids[e])
        return pa.table([pa.array(a, kinds), pa.array(b, kinds), pa.array(value, pa.float64())], names=["a", "b", "cosine"])

    spread = placed.repartition(min(blocks * (blocks + 1) // 2, 10_000), "lo", "hi")
    return spread.groupBy("lo", "hi").applyInArrow(compare, f"a {kind}, b {kind}, cosine double")


def block_count(many: int, widest: int, cores: int) -> int:
    """Blocks of so many vectors: few, but enough to give each core some pairs of them."""
    least = math.ceil(many / max(BLOCK, BLOCK_VALUES // widest))
    return max(1, least, min(math.ceil(many / BLOCK), math.ceil(math.sqrt(4 * cores))))


def canonical_map(names: DataFrame, pairs: DataFrame, vetoed: DataFrame | None = None) -> DataFrame:
    """Rows ``(norm, canon)``: the least name of each component.

    Vetoed pairs are taken out as direct links only; pairs with a name that is
    not among ``names`` are ignored.
    """
    known = with_dense_ids(names.select("norm").distinct(), "id", "norm")
    kept = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if vetoed is not None:
        veto = vetoed.select(F.col("norm_a").alias("a"), F.col("norm_b").alias("b"))
        kept = kept.join(veto, ["a", "b"], "left_anti")
    # numbers in the order of the names are compared in place of them
    for end, number in (("a", "i"), ("b", "j")):
        kept = kept.join(known.select(F.col("norm").alias(end), F.col("id").alias(number)), end)
    found = connected_components(kept, "i", "j")
    roots = known.select(F.col("id").alias("component"), F.col("norm").alias("root"))
    return known.join(found.withColumnRenamed("node", "id").join(roots, "component"), "id", "left").select("norm", F.coalesce("root", "norm").alias("canon"))
