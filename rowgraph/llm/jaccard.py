"""N-gram Jaccard join with Bayesian candidate pruning, DataFrame functions only.

Texts become sets of word n-grams (64-bit hashes).  Equal texts collapse into
one class first.  Each class gets 128 MinHash values from one sorted array of its
hashes: value j is the first hash at or after the start of the j-th of 128
equal ranges, cyclically, so one hash function and one sort give them all and
none is ever missing.  Bands of three distant values put the classes in
buckets; texts below ``FEW`` n-grams, whose values repeat, get twice as many.
Texts below ``EXACT`` n-grams, whose values are copies of a few hashes, get
none: their pairs, with one another and with longer texts, come from a prefix
filter that loses nothing.  A pair of a bucket is taken up in the first band
that it shares, judged by the very bits that make the buckets, and its values,
four bits of each, are compared in steps: after each step the
pair is dropped if the posterior probability that its similarity reaches
the threshold, given the matches so far and a uniform prior, is below the
tolerance.  The values of a set of k n-grams weigh as about k / 2 independent
ones, so the pairs of smaller sets are judged by fewer.  A pair whose sizes
alone rule the threshold out is dropped as well.  All this happens while a
bucket is joined with itself, so only pairs that pass are ever shuffled; they
are then verified on the whole sets.

The prefix filter puts the n-grams of a set in one order for all sets, rarest
first.  A pair that reaches the threshold shares an n-gram among the first
``size - need + 1`` of each set, ``need`` being the least overlap that the size
allows; n-grams that no other set has are never posted.  A pair is kept if the
places of the common n-gram leave room for the overlap that the threshold asks
for, and if no more n-grams than it allows are missing on either side by 256
bits of each set, which never count too many.

Near copies of one text come in groups that grow with the input, and their
links with the square.  Texts of a bucket of more than ``HOT`` therefore get a
hub, the text of it that shares the most.  With the exact overlap ``o`` of each
text with its hub of ``r`` n-grams, two texts of one hub share at least
``o + o' - r``; where that reaches the threshold the link is certain.  This
comes to a sum of one number for each text (``surplus``), so certain links are
counted by running sums and never written down; all other pairs are verified.

Keys are counted with partial sums before anything meets.  A bucket of many
classes is split into blocks and so is a group of near copies when its pairs
are verified: there classes are put in blocks of about ``BLOCK_GRAMS`` n-grams
along their least neighbour, and a task holds two blocks, so that a set travels
once a pair of blocks, not once a pair of texts, no task ever holds a whole hot
group, and no partner is left out.

Result: one row per document with ``class_id`` (least id reachable by links),
``n_links`` (other documents linked directly, copies included) and
``copies`` (documents with the same text, itself included).

Defined results: a text without a word (null, empty, punctuation only) links
with nothing; a text of fewer than n words is one n-gram; a row with a null id
is left out of the result (``keep_one`` lets it pass); ids are unique but for
repeated rows, which count as copies.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowgraph.llm.expressions import let
from rowgraph.operators.components import connected_components
from rowgraph.runtime import cut

VALUES = 128
ROWS = 3
BANDS = VALUES // ROWS
STEP = 16
FEW = 256
EXACT = 64
#: N-grams a block of verification holds on average (8 bytes each).
BLOCK_GRAMS = 1 << 16
BUCKET_BLOCK = 256
#: Texts in a bucket from which they get a hub.
HOT = 64
_LOW = 0xFFFFFFFF


def word_ngrams(text: Column, n: int = 3) -> Column:
    """The 64-bit hashes of a text's word n-grams, with repetitions."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def grams(w: Column) -> Column:
        every = F.transform(
            F.sequence(F.lit(1), F.size(w) - (n - 1)),
            lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)]),
        )
        short = F.array(F.xxhash64(F.array_join(w, " ")))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= n, every).when(F.size(w) > 0, short).otherwise(none)

    return let(words, grams)


def least_matches(threshold: float, tolerance: float, bits: int = 4) -> dict[int, int]:
    """For 16, 32, ... independent values, the fewest matches with which a pair stays.

    With ``b`` bits of a value, texts of similarity ``s`` match with
    probability ``s + (1 - s) / 2**b``.  The posterior is integrated over a
    uniform prior of ``s``.
    """
    grid = 2000
    sims = [(k + 0.5) / grid for k in range(grid)]
    match = [s + (1 - s) / 2**bits for s in sims]
    out = {}
    for h in range(STEP, VALUES + 1, STEP):
        for m in range(h + 1):
            logs = [m * math.log(p) + (h - m) * math.log1p(-p) if p < 1 or m == h else -math.inf for p in match]
            top = max(logs)
            mass = [math.exp(x - top) for x in logs]
            if sum(w for w, s in zip(mass, sims) if s >= threshold) >= tolerance * sum(mass):
                out[h] = m
                break
    return out


def minhash(grams: Column) -> Column:
    """128 values from an array of hashes that is not empty."""

    def bin_of(h: Column) -> Column:
        return (F.shiftright(h, 57) + VALUES // 2).cast("int")

    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(ordered, i - 1))))

    def dense(f: Column) -> Column:
        runs = F.transform(
            f, lambda h, i: F.array_repeat(h, bin_of(h) - F.when(i == 0, F.lit(-1)).otherwise(bin_of(F.get(f, i - 1))))
        )
        rest = F.array_repeat(F.get(f, F.lit(0)), VALUES - 1 - bin_of(F.element_at(f, -1)))
        return F.concat(F.flatten(runs), rest)

    return let(let(F.sort_array(grams), firsts), dense)


def _packed(values: Column) -> Column:
    """Four low bits of each value, sixteen in a word."""

    def word(w: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(STEP):
            low = F.get(values, w * STEP + k).bitwiseAND(F.lit(15).cast("long"))
            out = out.bitwiseOR(F.shiftleft(low, 4 * k))
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(VALUES // STEP - 1)), word)


def _banded(values: Column, size: Column) -> Column:
    """32 bits of each band's values; a bucket is a place in this array and what stands there."""

    def bands(count: int) -> Column:
        # the places of a band lie a third of the circle apart, shifted from one pass to the next
        return F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)),
            lambda b: F.shiftright(
                F.xxhash64(*[F.get(values, (b % BANDS + r * (BANDS + 11 * F.floor(b / BANDS)).cast("int")) % VALUES) for r in range(ROWS)]), 32
            ).cast("int"),
        )

    none = F.array().cast("array<int>")
    return F.when(size < EXACT, none).when(size < FEW, bands(2 * BANDS)).otherwise(bands(BANDS))


def _matching(a: Column, b: Column) -> Column:
    """How many of the sixteen four-bit values of two words are equal."""
    x = a.bitwiseXOR(b)
    folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    return F.lit(STEP) - F.bit_count(folded.bitwiseAND(F.lit(0x1111111111111111)))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def signatures(docs: DataFrame, threshold: float, id_col: str, text_col: str, n: int) -> DataFrame:
    """Rows ``(h1, h2, node, copies, size, bands, words, grams)``, one per distinct text with a word.

    ``grams`` is null for sets too large to reach the threshold with one below ``EXACT``.
    """
    keyed = docs.filter(F.col(id_col).isNotNull()).select(
        *_text_key(F.col(text_col)), F.col(id_col).alias("id"), F.array_distinct(word_ngrams(F.col(text_col), n)).alias("grams")
    )
    hashed = keyed.filter(F.size("grams") > 0).select("h1", "h2", "id", F.size("grams").alias("size"), minhash(F.col("grams")).alias("values"), F.when(F.size("grams") * threshold < EXACT, F.col("grams")).alias("grams"))
    made = hashed.select("h1", "h2", "id", "size", "grams", _banded(F.col("values"), F.col("size")).alias("bands"), _packed(F.col("values")).alias("words"))
    return made.groupBy("h1", "h2").agg(
        F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"),
        F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("words").alias("words"), F.first("grams").alias("grams"),
    )


def _stays(threshold: float, tolerance: float) -> Column:
    """Whether the pair of a row (``a_size``, words ``a_w0 ..``; ``b_size``, ``b_w0 ..``) passes every step.

    Plain columns keep the generated code of the join small enough to be compiled.
    """
    least = least_matches(threshold, tolerance)
    small = F.greatest("a_size", "b_size")

    def seen(values: int) -> Column:
        total = F.lit(0)
        for w in range(values // STEP):
            total = total + _matching(F.col(f"a_w{w}"), F.col(f"b_w{w}"))
        return total

    # fewer independent values than are compared: the whole comparison counts as so many
    needed = F.lit(least[VALUES])
    for worth in range(VALUES - STEP, 0, -STEP):
        needed = F.when(small < 2 * (worth + STEP), F.lit(-(-least[worth] * VALUES // worth))).otherwise(needed)
    needed = F.when(small < 2 * STEP, F.lit(0)).otherwise(needed)
    stays = F.lit(True)
    for values in (VALUES // 4, VALUES // 2):
        stays = stays & ((small < 2 * VALUES) | (seen(values) >= least[values]))
    return stays & (seen(VALUES) >= needed)


def _in_blocks(rows: DataFrame, *key: str) -> DataFrame:
    """``rows``, each in its block ``own``, with ``lo`` and ``hi``, once for each pair of its block with one of the first ``meets``.

    The exchange is the same for both sides of a join with itself, so it is written once.
    """
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    placed = each.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "meets")
    return placed.repartition(*key, "lo", "hi")


def _met(rows: DataFrame, *key: str) -> tuple[DataFrame, Column]:
    """Pairs of rows that share a key: every column as ``a_`` and ``b_``, and what makes each pair of blocks count it once."""
    a, b = (rows.select(*key, "lo", "hi", *[F.col(c).alias(f"{x}_{c}") for c in rows.columns if c not in (*key, "lo", "hi")]) for x in "ab")
    once = ((F.col("lo") == F.col("hi")) | (F.col("a_own") != F.col("b_own"))) & (F.col("a_node") < F.col("b_node"))
    return a.hint("merge").join(b, [*key, "lo", "hi"]), once


def _blocks_of(n: Column) -> Column:
    return F.ceil(n / BUCKET_BLOCK).cast("int")


def _block(node: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(node), blocks).cast("int")


def shared_bands(signed: DataFrame) -> DataFrame:
    """Rows ``(band, node, n)`` of the bands that ``n`` > 1 nodes share."""
    rows = signed.select("node", F.posexplode("bands").alias("k", "h"))
    rows = rows.select("node", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("h").cast("long").bitwiseAND(F.lit(_LOW))).alias("band"))
    counted = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(counted.hint("merge"), "band").select("band", "node", "n")


def members_of(held: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str, n: int) -> DataFrame:
    """Rows ``(node, hub, surplus, top)`` of the nodes of large buckets.

    Two nodes of one hub reach the threshold if their surpluses add up to more
    than 0; ``top`` is the hub's own, which no other exceeds.
    """
    hot = cut(held.filter(F.col("n") > HOT))
    score = hot.groupBy("node").agg(F.sum("n").alias("score"))
    best = hot.join(score, "node").groupBy("band").agg(F.max(F.struct("score", "node")).alias("best"))
    hubs = cut(hot.join(best, "band").groupBy("node").agg(F.max("best")["node"].alias("hub")))
    sets = cut(_sets(docs, hubs.select("node").unionAll(hubs.select("hub")).distinct(), id_col, text_col, n))
    met = hubs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("grams").alias("center")), "hub")
    sized = met.select("node", "hub", F.size("grams").alias("s"), F.size("center").alias("r"), F.size(F.array_intersect("grams", "center")).alias("o"))
    # (o + o' - r) / (s + s' - (o + o' - r)) >= threshold, taken apart; whole numbers, so that every step agrees on each pair
    whole = lambda o, s: F.floor(1024 * ((1 + threshold) * (o - F.col("r") / 2) - threshold * s)).cast("long")
    return cut(sized.select("node", "hub", whole(F.col("o"), F.col("s")).alias("surplus"), whole(F.col("r"), F.col("r")).alias("top")))


def candidate_pairs(signed: DataFrame, held: DataFrame, threshold: float, tolerance: float, members: DataFrame | None = None) -> DataFrame:
    """Rows ``(a, b, na, nb)``, ``a < b``, of nodes that share a band and may reach the threshold, certain links of ``members`` left out."""
    sides = signed.filter(F.size("bands") > 0)
    certain = F.lit(False)
    own = F.col("n").cast("long")
    if members is None:
        placed = held.select("band", "node", _block("node", _blocks_of(own)).alias("own"), _blocks_of(own).alias("meets"))
        group = []
    else:
        sides = sides.join(members.select("node", "hub", "surplus"), "node", "left")
        group = [F.coalesce("hub", "node").alias("hub"), F.coalesce("surplus", F.lit(-(1 << 60))).alias("surplus")]
        certain = (F.col("a_hub") == F.col("b_hub")) & (F.col("a_surplus") + F.col("b_surplus") > 0)
        # nodes of one hub with a surplus above 0 are all linked: in a bucket they meet the rest only
        core = members.filter("surplus > 0").select("node", "hub")
        cores = held.join(core, "node").groupBy("band", "hub").agg(F.count(F.lit(1)).alias("m"))
        cores = cores.groupBy("band").agg(F.max(F.struct("m", "hub")).alias("c"))
        rows = held.join(core, "node", "left").join(cores, "band", "left").select(
            "band", "node", F.coalesce(F.col("hub") == F.col("c.hub"), F.lit(False)).alias("inner"),
            _blocks_of(F.col("n") - F.coalesce("c.m", F.lit(0))).alias("outers"), _blocks_of(F.coalesce("c.m", F.lit(0))).alias("inners"),
        )
        placed = rows.filter("outers > 0").select(
            "band", "node",
            F.when(F.col("inner"), F.col("outers") + _block("node", F.greatest("inners", F.lit(1)))).otherwise(_block("node", F.col("outers"))).alias("own"),
            F.when(F.col("inner"), F.col("outers")).otherwise(F.col("outers") + F.col("inners")).alias("meets"),
        )
    zero = F.lit(0).cast("long")
    # two bands in a word: whether an earlier one is shared is a matter of the same bits that make the buckets
    pair = lambda i: F.shiftleft(F.get("bands", F.lit(2 * i + 1)).cast("long"), 32).bitwiseOR(F.get("bands", F.lit(2 * i)).cast("long").bitwiseAND(F.lit(_LOW)))
    sides = sides.select(
        "node", "size", *group, *[F.coalesce(pair(i), zero).alias(f"p{i}") for i in range(BANDS // 2)],
        *[F.coalesce(F.get("words", F.lit(w)), zero).alias(f"w{w}") for w in range(VALUES // STEP)],
    )
    met, once = _met(_in_blocks(placed.join(sides.hint("merge"), "node"), "band"), "band")
    here, apart = F.shiftright("band", 32), F.lit(True)
    for i in range(BANDS // 2):
        x = F.col(f"a_p{i}").bitwiseXOR(F.col(f"b_p{i}"))
        apart = apart & ((here <= 2 * i) | (x.bitwiseAND(F.lit(_LOW)) != 0)) & ((here <= 2 * i + 1) | (F.shiftrightunsigned(x, 32) != 0))
    near = F.least("a_size", "b_size") >= threshold * F.greatest("a_size", "b_size")
    kept = met.filter(once & ~certain & near & apart & _stays(threshold, tolerance))
    return kept.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_size").alias("na"), F.col("b_size").alias("nb"))


def _least_overlap(share: float, size: Column) -> Column:
    """The least whole number of n-grams that is ``share`` of ``size``, against rounding."""
    return F.ceil(size * share - 1e-9).cast("int")


def _bitmap(grams: Column) -> Column:
    """256 bits, as four words, of which each n-gram sets one."""
    none = F.struct(*[F.lit(0).cast("long").alias(f"m{k}") for k in range(4)])

    def add(m: Column, g: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(g, 2).bitwiseAND(F.lit(63).cast("long")).cast("int"))
        return F.struct(*[F.when(g.bitwiseAND(F.lit(3).cast("long")) == k, m[f"m{k}"].bitwiseOR(bit)).otherwise(m[f"m{k}"]).alias(f"m{k}") for k in range(4)])

    return F.aggregate(grams, none, add)


def short_pairs(signed: DataFrame, threshold: float) -> DataFrame:
    """Rows ``(a, b, na, nb)``, ``a < b``, with every pair that reaches the threshold and has a set below ``EXACT``."""
    sets = signed.filter(F.col("grams").isNotNull())
    rows = sets.select("node", "size", F.explode("grams").alias("gram"))
    counted = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # what only one set has comes first in the order and cannot be common
    ordered = rows.join(counted.hint("merge"), "gram").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("known"))
    room = F.size("known") - _least_overlap(threshold, F.col("size")) + 1
    marked = ordered.filter(room > 0).withColumn("m", _bitmap(F.transform("known", lambda e: e["gram"])))
    posted = marked.select(
        "node", "size", (F.col("size") - F.size("known")).alias("own_grams"), "m.*", F.posexplode(F.slice("known", F.lit(1), room)).alias("at", "e")
    )
    posted = posted.select(
        F.col("e.gram").alias("gram"), "node", "size", "own_grams", (F.col("size") - F.col("own_grams") - F.col("at")).alias("left"),
        _block("node", _blocks_of(F.col("e.n"))).alias("own"), _blocks_of(F.col("e.n")).alias("meets"), *[f"m{k}" for k in range(4)],
    )
    met, once = _met(_in_blocks(posted, "gram"), "gram")
    need = _least_overlap(threshold / (1 + threshold), F.col("a_size") + F.col("b_size"))

    def lost(x: str, y: str) -> Column:
        """The least number of n-grams of ``x`` that ``y`` has not."""
        return F.col(f"{x}_own_grams") + sum(F.bit_count(F.col(f"{x}_m{k}").bitwiseAND(F.bitwise_not(f"{y}_m{k}"))) for k in range(4))

    kept = met.filter(
        once & (F.least("a_size", "b_size") < EXACT) & (F.least("a_left", "b_left") >= need)
        & (F.col("a_size") - lost("a", "b") >= need) & (F.col("b_size") - lost("b", "a") >= need)
    )
    return kept.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_size").alias("na"), F.col("b_size").alias("nb"))


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Rows ``(node, grams)`` of the nodes asked for."""
    return (
        docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
        .join(nodes, "node", "left_semi")
        .dropDuplicates(["node"])
        .select("node", F.array_distinct(word_ngrams(F.col("text"), n)).alias("grams"))
    )


def verify(pairs: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str, n: int) -> DataFrame:
    """``(a, b, jaccard)`` of the pairs ``(a, b, na, nb)`` that reach the threshold on whole sets."""
    pairs = cut(pairs.distinct(), fused=False)
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("na").alias("size")).unionAll(
        pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), F.col("nb").alias("size"))
    )
    home = cut(ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("home"), F.max("size").alias("size")))
    parts = home.groupBy("home").agg(F.ceil(F.sum("size") / BLOCK_GRAMS).alias("parts"))
    placed = cut(home.join(parts, "home").select("node", F.struct("home", F.expr("pmod(xxhash64(node), parts)").alias("part")).alias("block")))
    blocked = (
        pairs.join(placed.select(F.col("node").alias("a"), F.col("block").alias("ba")), "a")
        .join(placed.select(F.col("node").alias("b"), F.col("block").alias("bb")), "b")
        .select("a", "b", F.struct(F.least("ba", "bb").alias("lo"), F.greatest("ba", "bb").alias("hi")).alias("g"))
    )
    blocked = cut(blocked)
    members = blocked.select("g", F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(docs, placed.select("node"), id_col, text_col, n)
    held = members.join(sets, "node").groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("node", "grams"))).alias("sets"))
    asked = blocked.groupBy("g").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    each = asked.join(held.hint("merge"), "g").select("sets", F.explode("pairs").alias("p")).select(
        F.col("p.a").alias("a"), F.col("p.b").alias("b"),
        F.element_at("sets", F.col("p.a")).alias("x"), F.element_at("sets", F.col("p.b")).alias("y"),
    )
    shared = each.select("a", "b", F.size(F.array_intersect("x", "y")).alias("k"), (F.size("x") + F.size("y")).alias("s"))
    jaccard = F.col("k") / (F.col("s") - F.col("k"))
    return shared.select("a", "b", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def jaccard_links(
    docs: DataFrame, threshold: float = 0.5, n: int = 3, tolerance: float = 1e-4, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Distinct texts ``(h1, h2, node, copies)`` and all links ``(a, b, jaccard)`` between them."""
    signed = cut(signatures(docs, threshold, id_col, text_col, n))
    pairs = candidate_pairs(signed, shared_bands(signed), threshold, tolerance).unionAll(short_pairs(signed, threshold))
    return signed.select("h1", "h2", "node", "copies"), cut(verify(pairs, docs, threshold, id_col, text_col, n))


def grouped_links(
    docs: DataFrame, threshold: float = 0.5, n: int = 3, tolerance: float = 1e-4, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``jaccard_links``, without the links that the rows ``(node, hub, surplus, top)``, which come last, make certain."""
    signed = cut(signatures(docs, threshold, id_col, text_col, n))
    held = cut(shared_bands(signed))
    members = members_of(held, docs, threshold, id_col, text_col, n)
    pairs = candidate_pairs(signed, held, threshold, tolerance, members).unionAll(short_pairs(signed, threshold))
    links = cut(verify(pairs, docs, threshold, id_col, text_col, n))
    return signed.select("h1", "h2", "node", "copies"), links, members


def _certain(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows ``(node, linked)``: how many documents of other nodes a node's certain links reach."""
    sized = members.join(sizes, "node")
    # of one hub there are as many rows as different surpluses, whatever the number of its nodes
    values = sized.groupBy("hub", "surplus").agg(F.sum("copies").alias("c"))
    asked = values.select("hub", (1 - F.col("surplus")).alias("at"), F.lit(0).cast("long").alias("c"), "surplus")
    given = values.select("hub", F.col("surplus").alias("at"), "c", F.lit(None).cast("long").alias("surplus"))
    reached = asked.unionAll(given).withColumn("reached", F.sum("c").over(Window.partitionBy("hub").orderBy(F.desc("at"))))
    found = sized.join(reached.filter("surplus is not null").select("hub", "surplus", "reached"), ["hub", "surplus"])
    return found.select("node", (F.col("reached") - F.when(F.col("surplus") > 0, F.col("copies")).otherwise(0)).alias("linked"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows ``(id, class_id, n_links, copies)``, one per document with an id."""
    nodes, links, members = grouped_links(docs, id_col=id_col, text_col=text_col, **options)
    sizes = nodes.select("node", "copies")
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    verified = ends.join(sizes.select(F.col("node").alias("other"), F.col("copies").alias("linked")), "other").select("node", "linked")
    degree = verified.unionAll(_certain(members, sizes)).groupBy("node").agg(F.sum("linked").alias("linked"))
    # whoever has a certain link has one with the hub
    spokes = members.filter("surplus + top > 0 and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    classes = connected_components(links.select("a", "b").unionAll(spokes)).withColumnRenamed("component", "least")
    known = nodes.join(degree, "node", "left").join(classes, "node", "left")
    known = known.select(
        "h1", "h2", "copies",
        F.coalesce("least", "node").alias("class_id"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    ids = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col), *_text_key(F.col(text_col)))
    return ids.join(known, ["h1", "h2"], "left").select(
        id_col,
        F.coalesce("class_id", id_col).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, the one of least id; rows with a null id all stay."""
    found = near_duplicates(docs, id_col, text_col, **options)
    first = found.filter(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias("_first")).distinct()
    kept = docs.join(first, F.col(id_col) == F.col("_first"), "left_semi").dropDuplicates([id_col, text_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).withColumn("kept", F.col("doc_id") == F.col("class_id"))
