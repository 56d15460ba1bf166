"""Scalars and lanes on unit cases."""

import pytest
from pyspark.sql import functions as F

from rowgraph.functions import phonetic, text
from rowgraph.operators import resolve
from rowgraph.operators.components import connected_components
from rowgraph.operators.ids import with_dense_ids


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(f(F.col("s"))).first()[0]


def test_latin_keys():
    for name, keys in {"ali": ["l"], "sarah": ["srh", "sr"], "sara": ["sr"], "khashayar": ["xcr"], "khabarov": ["xbrv"]}.items():
        assert phonetic.phonetic_keys(name) == keys
    assert phonetic.phonetic_keys(None) == [] == phonetic.phonetic_keys("123") == phonetic.phonetic_keys("Ω")


def test_scripts_meet():
    keys = lambda s: set(phonetic.phonetic_keys(s))
    assert keys("Хабаров") & keys("Khabarov")
    assert keys("Сергей") & keys("Sergei")
    assert not keys("Иванов") & keys("Khabarov")
    assert keys("Faeze") & keys("فائزه")
    assert phonetic.phonetic_keys("Sara Khan") == ["sr xn"]


def test_native_latin_keys_equal_the_general_ones(spark):
    words = "ali sarah sara khashayar khabarov wow yahya chchccah phphoebe aeiou uh hh kkhh wyw yw shah ghghazal zh x ah".split()
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", phonetic.latin_keys(F.col("w")).alias("k")).collect()
    assert {r["w"]: r["k"] for r in rows} == {w: phonetic.phonetic_keys(w) for w in words}


@pytest.mark.parametrize(
    "raw,norm",
    [("Ｒｅｚａ", "reza"), ("ﬁrouz", "firouz"), ("((Sara))", "sara"), ("٢٠٢٤", ""), ("علي", "علی"), ("  Anna    Lee ", "anna lee"), ("O'Hara", "o'hara"), ("", "")],
)
def test_normalize(spark, raw, norm):
    assert one(spark, raw, text.normalize_name) == norm


def test_tokenize(spark):
    assert one(spark, "Sara, sara! met  Tom-2", text.tokenize) == ["sara", "met", "tom", "2"]
    assert one(spark, None, text.tokenize) == [] == one(spark, "?!", text.tokenize)


def test_entropy_and_gate(spark):
    assert one(spark, "khabarov", text.entropy) == pytest.approx(2.75)
    assert one(spark, "reza", text.passes_gate) is True
    assert one(spark, "ali", text.passes_gate) is False


def test_shingles_and_jaccard(spark):
    assert one(spark, "abcd", text.shingles) == ["abc", "bcd"]
    assert one(spark, "ab", text.shingles) == ["ab"] and one(spark, "", text.shingles) == []
    s = lambda a, b: spark.range(1).select(text.jaccard(F.lit(a), F.lit(b)) if a else F.lit(0)).first()[0]
    assert s(["a", "b"], ["a", "b"]) == 1 and s(["a"], ["b"]) == 0


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0], [1.0]), ([1.0, 1.0], [1.0, 0.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(text.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1, 0, 0, 2**-0.5])


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "norm string")


def pairs(df):
    return {(r["a"], r["b"]) for r in df.collect()}


def test_fuzzy_lane(spark):
    a, b = "shahrbanoodeylam", "shahrbanoodeylan"
    assert not pairs(resolve.phonetic_pairs(names(spark, a, b)))
    assert pairs(resolve.fuzzy_pairs(names(spark, a, b))) == {(a, b)}
    assert not pairs(resolve.fuzzy_pairs(names(spark, "khorasani", "khorasari", "aaaa", "aaa")))


def test_fuzzy_lane_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcdef", k=rng.randint(9, 16))) for _ in range(120)})
    words += [w[:-1] + "x" for w in words[:40]] + [w + "yz" for w in words[:40]]
    words = sorted(set(words))

    def grams(w):
        return {w[i : i + 3] for i in range(len(w) - 2)}

    want = {(a, b) for a in words for b in words if a < b and len(grams(a) & grams(b)) * 100 >= len(grams(a) | grams(b)) * 82}
    assert want and pairs(resolve.fuzzy_pairs(names(spark, *words), gated=False)) == want


def test_fuzzy_lane_around_the_size_that_is_paired_by_remainders(spark):
    import random

    rng = random.Random(5)
    words = {"".join(rng.choices("abcdefgh", k=n)) for n in range(5, 30) for _ in range(4)}
    words |= {w[:i] + "x" + w[i + more :] for w in list(words) for i, more in ((0, 0), (len(w), 0), (0, 1), (2, 1))}
    words |= {w + tail for w in list(words) for tail in ("z", "zy", "zyx", "zyxw")}

    def grams(w):
        return {w[i : i + 3] for i in range(len(w) - 2)}

    sets = {w: grams(w) for w in sorted(words)}
    want = {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) * 100 >= len(x | y) * 82}
    sizes = {(len(sets[a]) > resolve.SHORT) + (len(sets[b]) > resolve.SHORT) for a, b in want}
    assert sizes == {0, 1, 2} and pairs(resolve.fuzzy_pairs(names(spark, *words), gated=False)) == want


def test_fuzzy_lane_compares_few_of_the_names_that_share_a_shingle(spark):
    import itertools

    words = ["xyz" + "".join(p) for p in itertools.permutations("abcdef")]
    seen = resolve.fuzzy_candidates(names(spark, *words)).count()
    assert seen < 10 * len(words)


def test_a_pair_that_shares_two_keys_comes_once(spark):
    from rowgraph.functions import phonetic

    a, b = "sarah", "serah"
    assert len(set(phonetic.phonetic_keys(a)) & set(phonetic.phonetic_keys(b))) == 2
    found = resolve.phonetic_pairs(names(spark, a, b, "sara"), gated=False)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == [("sara", "sarah"), ("sara", "serah"), ("sarah", "serah")]
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert pairs(resolve.share_a_key(found.unionAll(names(spark, a).selectExpr("norm as a", "'tom' as b")), names(spark, a, b, "sara", "tom"))) == pairs(found)


def test_a_veto_forms_no_clique_where_a_name_is_free(spark):
    group = names(spark, *[f"k{x}r{y}m" for x in "aeiou" for y in "aeiou"])
    veto = spark.createDataFrame([("karam", "karem")], "norm_a string, norm_b string")
    found = pairs(resolve.phonetic_edges(group, veto, gated=False))
    assert len(found) == 24 and ("karam", "karem") not in found
    canon = resolve.canonical_map(group, spark.createDataFrame(sorted(found), "a string, b string"), veto)
    assert {r["canon"] for r in canon.collect()} == {"karam"}


def test_embedding_lane(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [1.0]), ("e", [0.0, 0.0])]
    got = resolve.embedding_pairs(spark.createDataFrame(rows, "norm string, vector array<double>"))
    assert pairs(got) == {("a", "b")}


def test_split_is_no_cannot_link(spark):
    known = names(spark, "a", "b", "c")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "zz")], "a string, b string")
    veto = spark.createDataFrame([("a", "c")], "norm_a string, norm_b string")
    canon = {r["norm"]: r["canon"] for r in resolve.canonical_map(known, links, veto).collect()}
    assert canon == {"a": "a", "b": "a", "c": "a"}


def test_vetoed_bucket_is_expanded(spark):
    group = names(spark, "karimhashem", "kerimhashem", "karemhashem")
    veto = spark.createDataFrame([("karemhashem", "karimhashem")], "norm_a string, norm_b string")
    canon = resolve.canonical_map(group, resolve.phonetic_edges(group, veto), veto)
    assert {r["canon"] for r in canon.collect()} == {"karemhashem"}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100} and 200 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(5)
    rows = with_dense_ids(df, "n", "x").orderBy("x").collect()
    assert [r["n"] for r in rows] == list(range(1, 1001))


def test_embedding_lane_at_threshold_zero(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0]), ("d", [1.0])]
    got = resolve.embedding_pairs(spark.createDataFrame(rows, "norm string, vector array<double>"), 0.0)
    assert pairs(got) == {("a", "b"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")}


def test_vectors_travel_to_few_blocks():
    assert resolve.block_count(500, 64, 12) == 1 and resolve.block_count(50_000, 64, 12) == 7
    # six times the vectors: each goes to as many blocks as memory asks, no more
    assert resolve.block_count(600_000, 64, 12) == 37 and resolve.block_count(600_000, 1024, 12) == 586


def test_embedding_lane_over_several_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(resolve, "BLOCK", 50)
    x = np.random.default_rng(1).normal(size=(300, 8)).round(3)
    x[7] = 0
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000, [1.0, 2.0])]
    got = resolve.embedding_pairs(spark.createDataFrame(rows, "norm long, vector array<double>"), 0.7)
    norms = np.linalg.norm(x, axis=1)
    cosine = (x @ x.T) / np.where(norms > 0, norms, 1)[:, None] / np.where(norms > 0, norms, 1)[None, :]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(cosine >= 0.7, 1)))}
    assert want and pairs(got) == want and got.count() == len(want)


def graph_of(spark, rows, **options):
    from rowgraph.operators import graph as graphs

    source = spark.createDataFrame(rows, "id string, body string")
    return graphs.build(graphs.extraction(source, F.col("id"), F.col("body"), text.tokenize(F.col("body"))), **options)


@pytest.mark.parametrize("ids", ["123", "cab"])
@pytest.mark.parametrize("kept", [False, True])
def test_edges_judged_at_once_equal_those_joined_with_their_support(spark, ids, kept):
    rows = list(zip(ids, ["sara tehran", "sara berlin tehran", "tehran sara berlin"]))
    g = graph_of(spark, rows, kept=kept)
    seen = spark.createDataFrame([(ids[0],), (ids[1],)], "source_pk string")

    def ends(df):
        return sorted((r["edge_id"], r["src"], r["dst"]) for r in df.collect())

    every = ends(g.edge)
    assert [e[0] for e in every] == [1, 2, 3] and every == sorted(every, key=lambda e: e[1:])
    surfaces = {r["entity_id"]: r["surface"] for r in g.entity.collect()}
    first = sorted(rows)[0][1].split()
    assert [surfaces[k] for k in (1, 2)] == first[:2]
    named = {e: {surfaces[e[1]], surfaces[e[2]]} for e in every}
    assert {frozenset(named[e]) for e in ends(g.edges_of(seen, "union"))} == {frozenset(p) for p in (("sara", "tehran"), ("sara", "berlin"), ("berlin", "tehran"))}
    assert {frozenset(named[e]) for e in ends(g.edges_of(seen, "intersection"))} == {frozenset(("berlin", "tehran"))}
    assert {frozenset((surfaces[r["src"]], surfaces[r["dst"]])) for r in g.pairs_of(seen.limit(1)).collect()} <= {frozenset(v) for v in named.values()}
    assert g.edge_support.count() == 5


def test_entities_are_made_without_mentions_and_edges(spark):
    g = graph_of(spark, [("1", "sara tehran"), ("2", "sara")])
    assert g.entity.count() == 2 and not {"mention", "edge", "_support"} & set(g.__dict__)


def test_group_ids(spark):
    from rowgraph.operators.ids import with_group_ids

    df = spark.range(1000).select((F.col("id") * 7919 % 101).alias("x"), F.lit("k").alias("y"), "id").repartition(5)
    rows = with_group_ids(df, "n", "x", "y").collect()
    assert all(r["n"] == r["x"] + 1 for r in rows) and len(rows) == 1000 and sum(r["first"] for r in rows) == 101
    least = with_group_ids(df, "n", "x", "y", within=F.asc("id"), firsts=True).collect()
    assert len(least) == 101 and all(r["id"] < 101 for r in least)
