"""Text operators against brute force, round trips and odd input."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from rowgraph.llm import bpe, jaccard, line_dedup, packing, pii, quality, secrets, suffix_dedup

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

DOCS = "doc_id long, text string, lines string, score string"


def docs(spark, *texts, start=1):
    """Documents with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts, start)], DOCS)


# --- byte-level BPE


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


ALPHABET = "aab b\n\n  \t'sre'll123٣é你好😀ß.,!-- _''<|endoftext|>"


def test_encoding_equals_the_library(encoder, reference):
    rng = random.Random(1)
    texts = ["", " ", "   ", "a" * 3000, "the thing " * 300, "x  y   z\n \n w"]
    texts += ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(2000)]
    for text in texts:
        want = reference.encode_ordinary(text)
        assert encoder.encode(text) == want
        assert encoder.decode(want) == text.encode()
        n, ids, decoded = encoder.rendered(text)
        assert (n, ids.decode(), decoded) == (len(want), " ".join(map(str, want)), text.encode())


def test_mixed_white_space_equals_the_library(encoder, reference):
    rng = random.Random(3)
    spaces = " \u00a0\u2003\u3000\t\n\r\x0b\x0c\x1c\x85\u2028\u200b"
    texts = ["a \u00a0 \u00a0 word", "a\u00a0 \u00a0 b", " \u00a0 \u00a0" * 4]
    texts += ["".join(rng.choices(spaces + "  \u00a0\u00a0ab1.'s", k=rng.randint(0, 30))) for _ in range(5000)]
    for text in texts:
        want = reference.encode_ordinary(text)
        assert encoder.encode(text) == want
        n, ids, decoded = encoder.rendered(text)
        assert (n, ids.decode(), decoded) == (len(want), " ".join(map(str, want)), text.encode())


def test_edits_and_appends_are_exact_and_local(encoder, reference):
    rng = random.Random(2)
    text = bpe.EditableText(encoder)
    for _ in range(400):
        a = rng.randint(0, len(text.text))
        text.replace(a, min(len(text.text), a + rng.choice([0, 1, 4])), "".join(rng.choices(ALPHABET, k=rng.randint(0, 5))))
        assert text.ids() == reference.encode_ordinary(text.text)
    long = bpe.EditableText(encoder, "some words here " * 500)
    before = long.encoded_bytes
    long.replace(4000, 4001, "Q")
    long.append(" end")
    assert long.ids() == reference.encode_ordinary(long.text) and long.encoded_bytes - before < 100


def test_documents_round_trip(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    d = docs(spark, "Hello  wörld", None, "", "Hello  wörld")
    coded = bpe.encode_documents(d, path, P.PATTERN)
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode_documents(coded, path, P.PATTERN).collect()}
    assert back == {1: "Hello  wörld", 2: "", 3: "", 4: "Hello  wörld"}
    digests = {r["doc_id"]: r for r in bpe.round_trip_digests(d, path, P.PATTERN).collect()}
    assert digests[2]["n_tokens"] == 0 and digests[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_documents(d.limit(0), path, P.PATTERN).count() == 0


# --- line dedup


def test_perfect_hash_is_minimal():
    import numpy as np

    words = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.int64)).view(np.uint64)
    for part in (words, words[:1], words[:3]):
        table = line_dedup.PerfectHash.build(part)
        assert sorted(table.slots(part)) == list(range(len(part)))


def test_frequent_lines_go(spark):
    texts = [f"own {i}\n Shared LINE \t\nend" for i in range(4)] + ["shared line", None, "", "\n\n", "own 1\nown 1"]
    found = line_dedup.drop_frequent_lines(docs(spark, *texts), min_docs=4).orderBy("doc_id").collect()
    assert [r["kept_text"] for r in found] == ["own 0", "own 1", "own 2", "own 3", "", "", "", "\n\n", "own 1\nown 1"]
    assert [(r["n_lines"], r["n_dropped"]) for r in found] == [(3, 2)] * 4 + [(1, 1), (1, 0), (1, 0), (3, 0), (2, 0)]
    assert found[0]["lines"] == "x"
    assert line_dedup.drop_frequent_lines(docs(spark, "a").limit(0)).count() == 0


def test_many_shards_and_a_missing_one(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 4)
    often = [f"line {i}" for i in range(120)]
    d = spark.createDataFrame([(i, "\n".join(often[i % 3 :: 2] + [f"own {i}"]), 77) for i in range(60)], "doc_id long, text string, n_lines long")
    shards = line_dedup.index_lines(line_dedup.count_lines(d), 10)
    assert shards.shards >= 20
    found = line_dedup.drop_frequent_lines(d, names=("t", "a", "b")).collect()
    assert {r["doc_id"]: r["t"] for r in found} == {i: f"own {i}" for i in range(60)} and {r["n_lines"] for r in found} == {77}
    import numpy as np

    words = np.arange(100, dtype=np.int64)
    assert not shards.counts(words, words).any()
    with pytest.raises(FileNotFoundError):
        line_dedup.Shards(["nowhere"] * 3).counts(words, words)


# --- n-gram Jaccard


def exact_links(texts, threshold=0.5):
    sets = {}
    for i, t in texts:
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed=5, groups=6):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(3000)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([12, 60, 500]))
        for _ in range(8):
            copy = list(base)
            for _ in range(len(copy) // 40 + 1):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0], None, "", "?!", "one", "One.", "two words"]
    texts += [" ".join(rng.choices(vocabulary, k=80)) for _ in range(20)]
    return list(enumerate(texts, 1))


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    texts = corpus()
    want = exact_links(texts)
    degree, parent = {i: 0 for i, _ in texts}, {i: i for i, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        degree[a] += 1
        degree[b] += 1
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    for bucket, grams in ((jaccard.BUCKET_BLOCK, jaccard.BLOCK_GRAMS), (3, 200)):  # small blocks split every group
        monkeypatch.setattr(jaccard, "BLOCK_GRAMS", grams)
        monkeypatch.setattr(jaccard, "BUCKET_BLOCK", bucket)
        found = {r["doc_id"]: r for r in jaccard.near_duplicates(docs(spark, *[t for _, t in texts])).collect()}
        assert {i: r["n_links"] for i, r in found.items()} == degree
        assert {i: r["class_id"] for i, r in found.items()} == {i: root(i) for i in parent}


def test_links_of_short_texts_equal_brute_force(spark, monkeypatch):
    texts, k = [], 0
    for size in range(1, 31):
        for j in (0.5, 0.6, 0.7, 0.8, 0.9):
            for grown in (True, False):
                # n-grams of one set, and a second that holds it or differs at the end
                shared = size if grown else -(-int(2 * j * size * 1000) // int((1 + j) * 1000))
                more = int(size / j + 1e-9) - size if grown else size - shared
                base = [f"w{k}x{i}" for i in range(size + 2)]
                other = base[: shared + 2] + [f"v{k}x{i}" for i in range(more)]
                texts += [" ".join(base), " ".join(other)]
                k += 1
    # a long text that holds a short one, and one n-gram in very many texts
    long = [f"l{i}" for i in range(122)]
    texts += [" ".join(long), " ".join(long[:64]), " ".join(long[:63])]
    texts += [f"all share this t{i} " + " ".join(f"u{i % 7}y{m}" for m in range(i % 5)) for i in range(60)]
    texts = list(enumerate(texts, 1))
    want = exact_links(texts)
    assert len(want) > 300
    d = docs(spark, *[t for _, t in texts])
    for block in (jaccard.BUCKET_BLOCK, 5):
        monkeypatch.setattr(jaccard, "BUCKET_BLOCK", block)
        _, links = jaccard.jaccard_links(d)
        found = sorted((r["a"], r["b"]) for r in links.collect())
        # copies are one node
        first = {}
        for i, t in texts:
            first.setdefault(t, i)
        assert found == sorted((a, b) for a, b in want if first[texts[a - 1][1]] == a and first[texts[b - 1][1]] == b)


def test_links_of_many_near_copies_are_counted_without_being_listed(spark, monkeypatch):
    rng = random.Random(9)
    texts = []
    for size, copies in ((200, 90), (70, 80)):
        base = [f"w{size}x{i}" for i in range(size)]
        texts.append(" ".join(base))
        for k in range(copies):
            # from nearly equal to below the threshold, so that some pairs link and some do not
            changed = set(rng.sample(range(size), 1 + size * (k % 9) // 120))
            texts.append(" ".join(f"v{k}x{i}" if i in changed else w for i, w in enumerate(base)))
    texts += [texts[0], texts[0], texts[5]]
    texts = list(enumerate(texts, 1))
    want = exact_links(texts)
    degree = {i: sum(i in pair for pair in want) for i, _ in texts}
    listed, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *rest: (listed.append(pairs.distinct().count()), verify(pairs, *rest))[1])
    monkeypatch.setattr(jaccard, "HOT", 8, raising=False)
    d = docs(spark, *[t for _, t in texts])
    for block in (jaccard.BUCKET_BLOCK, 7):
        monkeypatch.setattr(jaccard, "BUCKET_BLOCK", block)
        found = {r["doc_id"]: r["n_links"] for r in jaccard.near_duplicates(d).collect()}
        assert {i: n for i, n in found.items() if n != degree[i]} == {}
    assert max(listed) < len(want) / 2, (listed, len(want))


def test_keep_one_drops_copies_and_repeated_rows(spark):
    d = docs(spark, "a b c d e f", "a b c d e f", "x y z").unionAll(docs(spark, "a b c d e f"))
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert jaccard.keep_one(d.limit(0)).count() == 0
    # a null id passes, and one id with two texts stays whole
    odd = d.unionAll(spark.createDataFrame([(None, "a b c d e f", "x", "y"), (3, "other words here now", "x", "y")], DOCS))
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in jaccard.keep_one(odd).collect())
    assert kept == [(0, "a b c d e f"), (1, "a b c d e f"), (3, "other words here now"), (3, "x y z")]


def test_a_long_text_and_its_near_copy_link(spark):
    words = [f"w{i % 5003}x{i}" for i in range(60_000)]
    changed = [w if i % 50 else "changed" for i, w in enumerate(words)]
    found = jaccard.near_duplicates(docs(spark, " ".join(words), " ".join(changed), "short one")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


# --- surrogates

KEY = "a test's own key"


def test_surrogates_keep_type_and_identity(spark):
    texts = [
        "call +1 (286) 555-5136, mail a.b@x.com or A.B@X.COM!! ip 152.143.123.131. card 4111 1111 1111 1111, ssn 123-45-6789",
        "a.b@x.com met Dr. Anna Weber, Ms. Weber and Mr. Tom Smith; г-н Иван Петров",
        None,
        "",
        "nothing here, 3.14 and 1.2.3 and 24be64439e3e49cf46b2d7c90f3602a3d0b907ff",
    ]
    rows = pii.replace_entities(docs(spark, *texts), KEY, count_col="n").orderBy("doc_id").collect()
    a, b = rows[0]["text"], rows[1]["text"]
    for secret in ("286", "555-5136", "a.b@", "A.B@", "152.143.123.131", "4111 1111", "123-45-6789"):
        assert secret not in a
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and re.search(r"ssn \d{3}-\d{2}-\d{4}", a)
    mails = re.findall(r"\S+@\S+(?=[ !])", a)
    assert mails[1].upper().rstrip("!") == mails[1].rstrip("!") and mails[0].upper() == mails[1].rstrip("!")
    assert mails[0] in b
    card = re.search(r"card ([\d ]+),", a)[1]
    digits = [int(c) for c in card.replace(" ", "")][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"Dr\. \w+ (\w+), Ms\. \1 ", b) and "Smith" not in b and re.search("г-н [А-Яа-яё]+ [А-Яа-яё]+", b) and "Петров" not in b
    assert (rows[2]["text"], rows[3]["text"], rows[4]["text"]) == (None, "", texts[4])
    assert [r["n"] for r in rows] == [6, 5, 0, 0, 0]


def test_distinct_entities_stay_distinct(spark, monkeypatch):
    phones = [f"+1 (286) 555-{i:04d}" for i in range(300)]
    assert len({r["text"] for r in pii.replace_entities(docs(spark, *phones), KEY).collect()}) == 300
    # a pool of 16 one-letter mail names forces draws again
    monkeypatch.setattr(pii, "_letters", lambda d, many: F.translate(F.substring(d, 1, 1), "0123456789abcdef", "abcdefghijklmnop"))
    mails = [f"user{i}@x.com" for i in range(9)]
    assert len({r["text"] for r in pii.replace_entities(docs(spark, *mails), KEY).collect()}) == 9


def test_names_and_phones_keep_and_tell_apart(spark):
    given = [a + b for a in ("An", "Be", "Cla", "Do", "Em", "Fri", "Ge", "Han") for b in ("na", "rta", "ra", "lla", "mi")]
    texts = [f"Ms. {g} Weber" for g in given]
    texts += ["Dr. Anna Weber", "Ms. Weber and Prof. Berta Weber", "Dr. Kim Lang", "г-жа Анна Петрова; Prof. Анна Петрова"]
    texts += ["+49123456789", "+49 123 456789", "+49-123-456789", "+1 2865555136", "+12865555136", "+491234567"]
    out = [r["text"] for r in pii.replace_entities(docs(spark, *texts), KEY).orderBy("doc_id").collect()]
    women = out[: len(given)]
    assert len(set(women)) == len(given)
    assert {w.split()[2] for w in women} == {women[0].split()[2]}
    for w in women:
        assert w.split()[1][:3] in {n[:3] for n in pii._GIVEN[("female", "latin")]}
    at = len(given)
    anna, berta = women[given.index("Anna")], women[given.index("Berta")]
    assert out[at].split()[1:] == anna.split()[1:] and out[at + 1].split(" and ")[1].split()[1:] == berta.split()[1:]
    left, right = out[at + 3].split("; ")
    assert left.split()[1:] == right.split()[1:]
    phones = [re.sub("[^0-9+]", "", x) for x in out[at + 4 :]]
    assert phones[0] == phones[1] == phones[2] != "+49123456789" and phones[3] == phones[4]
    assert phones[0].startswith("+49") and phones[3].startswith("+1") and out[at + 5][3] == " " and out[at + 6][7] == "-"


def test_ten_thousand_entities_stay_distinct_and_themselves(spark):
    surnames = [a + b + c for a in ("Ba", "Ke", "Lo", "Mi", "Na", "Ru", "So", "Ti", "Wa", "Ze") for b in ("ck", "ld", "mm", "nn", "rt") for c in ("er", "en", "mann", "berg", "hof")]
    given = [a + b for a in ("An", "Be", "Cla", "Do", "Em", "Fri", "Ge", "Han") for b in ("na", "rta", "ra", "lla", "mi")]
    names = [f"{g} {s}" for s in surnames for g in given][:4000]
    mails = [f"user{i}@host{i % 7}.example.net" for i in range(3000)]
    phones = [f"+49 30 {i:07d}" for i in range(3000)]
    rows = [(i, t) for i, t in enumerate([f"Dr. {x}" for x in names] + mails + phones)]
    rows += [(10_000 + i, t) for i, t in rows]  # every entity in two documents
    out = {r["doc_id"]: r["text"] for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert all(out[i] == out[10_000 + i] != rows[i][1] for i in range(10_000))
    assert len({out[i] for i in range(10_000)}) == 10_000
    by = {}
    for i, n in enumerate(names):
        by.setdefault(n.split()[1], set()).add(out[i].split()[-1])
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)


def test_only_texts_that_may_hold_an_entity_are_searched_whole(spark, monkeypatch):
    # a pattern that takes every word shows which texts it is used on
    monkeypatch.setattr(pii, "ENTITY", r"[\p{L}\p{N}]+")
    texts = ["Plain words of a Don, Hal and Mr who", "He came on 3 May", "Dr. Anna Weber", "г-н Иван Петров", ""]
    out = [r["text"] for r in pii.replace_entities(docs(spark, *texts), KEY).orderBy("doc_id").collect()]
    assert out[:2] == texts[:2] and out[4] == "" and out[2] != texts[2] and out[3] != texts[3]
    monkeypatch.setattr(pii, "WITHOUT_MAIL", r"[\p{L}\p{N}]+")
    found = [r[0] for r in docs(spark, *texts).orderBy("doc_id").select(pii.entities(F.col("text"))).collect()]
    assert [len(x) for x in found] == [0, 5, 3, 4, 0]


def test_entities_are_those_of_all_patterns_under_one_guard(spark):
    rng = random.Random(5)
    some = "@ + ( ) . - _ 1 12 123 1234 4111 555 255.1.2.3 +49 GB12 ABCD a.b@x.com c_d@y.org Mr Ms. Dr. Don Señora г-н Г-жа Anna Weber Иван Петров who é x 123-45-6789 (286) 555-5136 4111111111111111 ٣٤".split(" ")
    texts = ["".join(rng.choice(some) + rng.choice(["", " ", " ", ".", "-", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(6000)] + ["", None]
    plain = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in (pii._MAIL, pii._PHONE, pii._IP, pii._SSN, pii._CARD, pii._IBAN, pii._NAME)) + ")"
    text = F.col("text")
    rows = docs(spark, *texts).select("text", pii.entities(text).alias("e"), pii.gaps(text).alias("g"), F.regexp_extract_all(text, F.lit(plain), F.lit(0)).alias("want"), F.split(text, plain, -1).alias("between")).collect()
    assert sum(len(r["want"] or []) for r in rows) > 3000
    for r in rows:
        assert (r["e"] or []) == (r["want"] or []), r["text"]
        assert r["text"] is None or r["g"] == r["between"], r["text"]


def test_very_long_texts_without_recursion(spark):
    texts = ["mail a@b" + ".c" * 500_000, "1" * 1_000_000, "1 " * 500_000, "Dr. A" + "a" * 500_000, "a" * 1_000_000 + "@b.cd", "GB12 " + "ABCD " * 200_000, "+1" + "-22" * 300_000]
    out = [r["text"] for r in pii.replace_entities(docs(spark, *texts, *texts), KEY).orderBy("doc_id").collect()]
    assert out[: len(texts)] == out[len(texts) :]
    assert "a@b" not in out[0] and out[1] == texts[1] and len(out[4]) < 100
    assert pii.replace_entities(docs(spark, "x").limit(0), KEY).count() == 0
    with pytest.raises(ValueError):
        pii.replace_entities(docs(spark, "x"), "")


# --- secrets


def base_by_definition(text):
    names = "password|passwd|secret|token|api_?key"
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""(?a:(?i:{names}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_base_spans():
    rng = random.Random(4)
    parts = ["token", "Api_Key", "PASSWORD", "=", ":", " ", '"', "AKIA", "AKIAAKIA", "ABCDEFGH1234567", "0123456789abcdef", "deadbeef", "secret", "é", "x", "apikey", "longvalue-1234"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert secrets.base_spans(text) == base_by_definition(text)


def test_grammars_tell_credentials_from_words(spark):
    grammars = secrets.learn()
    for made in secrets.labelled_credentials(40, seed=77).values():
        assert sum(grammars.score(s) >= grammars.threshold for s in made) >= 39
    ordinary = secrets.ordinary_strings(300, seed=78)
    assert sum(grammars.score(s) >= grammars.threshold for s in ordinary) <= 3
    d = docs(spark, "key ghp_a8Fk2LmQ9zXw1VtR5uYb7NcE3oPd6SgHj0Ti here", None, "é token=abcdefghijkl", "plain words only")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(d, grammars).collect()}
    assert found == {1: [("inferred", 4, 44)], 2: [], 3: [("assign", 2, 20)], 4: []}
    assert secrets.scan(d.limit(0), grammars).count() == 0


def test_every_candidate_is_scored_in_linear_time():
    import time

    grammars = secrets.learn(60)
    text = "key sk_live_0123456789abcdef01234567 there"
    base = secrets.base_spans(text)
    assert [k for _, k, _ in base] == [2] and [(4, 3, 36)] == grammars.spans(text, base)
    took = []
    for many in (2_000, 16_000):
        text = " ".join(f"{i:032x}" for i in range(many))
        base = secrets.base_spans(text)
        began = time.perf_counter()
        assert grammars.spans(text, base) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * max(took[0], 1e-3)


# --- quality


def test_ranking_learns_and_handles_odd_input(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choices("alpha beta gamma delta epsilon".split(), k=30)) + "." for _ in range(60)]
    bad = [" ".join(w + rng.choice(["###", "$$$"]) for w in rng.choices("alpha beta gamma".split(), k=30)) for _ in range(60)]
    d = docs(spark, *good, *bad, None, "", "x" * 100_000)
    labels = spark.createDataFrame([(i, int(i <= 60)) for i in range(1, 121) if i % 2] + [(999, 1), (1, None)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.score_documents(d, labels).collect()}
    assert len(found) == 123 and all(0 <= r["score"] <= 1 for r in found.values())
    assert all(found[i]["predicted"] == int(i <= 60) for i in range(1, 121))
    assert quality.keep_good(d, labels).columns == d.columns
    assert all(r["score"] == 0.5 for r in quality.score_documents(d, labels.limit(0)).collect())
    assert quality.score_documents(d.limit(0), labels).count() == 0
    # ten thousand rows of one labelled id train as one
    many = d.unionAll(docs(spark, *["alpha beta"] * 10_000).withColumn("doc_id", F.lit(1).cast("long")))
    again = quality.fit_ranker(many, labels)
    assert quality.fit_ranker(many.orderBy(F.desc("text")), labels).weights.tolist() == again.weights.tolist()


def test_all_labelled_documents_train(spark):
    rng = random.Random(10)
    # more than 10,000, with every length seldom and all of them in the mean
    texts = ["a" * rng.randint(1, 400) + ("#" * rng.randint(1, 9) if i % 4 == 0 else ".") for i in range(12_001)]
    d = docs(spark, *texts)
    labels = spark.createDataFrame([(i, int((i - 1) % 4 != 0)) for i in range(1, 12_002)], "doc_id long, quality int")
    ranker = quality.fit_ranker(d, labels)
    mean = sum(math.log1p(len(t)) for t in texts) / len(texts)
    assert ranker.mean[quality.NAMES.index("length")] == pytest.approx(mean, rel=1e-8)
    # as many lie below the threshold as are labelled bad
    assert d.filter(ranker.score(F.col("text")) < 0.5).count() == sum(i % 4 == 0 for i in range(12_001))


# --- packing


def test_packing_keeps_every_token(spark):
    rng = random.Random(8)
    lengths = [rng.choice([0, 1, 30, 300, 900, 5000]) for _ in range(300)]
    d = docs(spark, *["w " * n for n in lengths[:-1]], None)
    rows = packing.pack_documents(d, packing.count_tokens(F.col("text")), capacities=(128, 512, 1024)).collect()
    per, bins = {}, {}
    for r in rows:
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["length"]
        bins.setdefault(r["bin_id"], []).append(r)
    assert per == {i: n for i, n in enumerate(lengths[:-1] + [0], 1)}
    for rs in bins.values():
        rs.sort(key=lambda r: (r["bin_offset"], r["length"]))
        assert sum(r["length"] for r in rs) == rs[0]["used"] <= rs[0]["capacity"]
        assert rs[0]["capacity"] == min(c for c in (128, 512, 1024) if c >= rs[0]["used"])
        at = 0
        for r in rs:
            assert r["bin_offset"] == at
            at += r["length"]
    assert packing.pack_documents(d.limit(0), F.lit(1)).count() == 0


def test_packing_costs_little_more_than_the_optimum():
    rng = random.Random(2)
    sizes, opened, total, best = (8, 16, 32), set(), 0, 0

    def optimum(items, bins=()):
        if not items:
            return sum(cost(next(c for c in sizes if c >= b)) for b in bins)
        found = [optimum(items[1:], (*bins, items[0]))]
        found += [optimum(items[1:], (*bins[:k], b + items[0], *bins[k + 1 :])) for k, b in enumerate(bins) if b + items[0] <= 32]
        return min(found)

    cost = lambda c: c + c * c / 64 + 1
    for _ in range(60):
        items = [rng.randint(1, 30) if rng.random() < 0.4 else rng.randint(1, 8) for _ in range(6)]
        bins = packing.pack(items, sizes, cost)
        opened |= {b[0] for b in bins}
        total += sum(cost(b[0]) for b in bins)
        best += optimum(tuple(items))
    assert opened == set(sizes) and best <= total <= 1.15 * best


def test_the_size_opened_follows_the_cost():
    lengths = [60] * 200 + [3000] * 5
    flat, steep = packing.pack(lengths, cost=lambda c: c + 16), packing.pack(lengths)
    assert [sum(b[0] == 512 for b in bins) > 1 for bins in (flat, steep)] == [False, True]
    assert sum(packing.default_cost(b[0]) for b in steep) < sum(packing.default_cost(b[0]) for b in flat)


def test_packing_uses_the_least_room():
    bins = packing.pack([600, 500, 400, 300, 120, 100], (512, 1024), lambda c: c + 16)
    assert sum(b[1] for b in bins) == 2020 and len(bins) == 2 and sorted(b[0] for b in bins) == [1024, 1024]


# --- repeated passages


def test_passages_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    shared = [[word() for _ in range(n)] for n in (20, 25, 60)]
    texts = []
    for k in range(40):
        body = [word() for _ in range(rng.randint(0, 80))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = s[rng.randint(0, 3) :]
        texts.append(" ".join(body))
    texts += [texts[3], None, "", "same " * 200]
    seen = {}
    for i, t in enumerate(texts, 1):
        w = (t or "").split()
        for k in range(len(w) - 19):
            seen.setdefault(tuple(w[k : k + 20]), set()).add(i)
    want = {}
    for i, t in enumerate(texts, 1):
        w, cover = (t or "").split(), set()
        for k in range(len(w) - 19):
            if len(seen[tuple(w[k : k + 20])]) > 1:
                cover |= set(range(k, k + 20))
        if cover:
            want[i] = len(cover)
    for hot, portion in ((suffix_dedup.HOT, suffix_dedup.PORTION), (1, 1)):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "PORTION", portion)
        found = suffix_dedup.repeated_passages(docs(spark, *texts), min_words=20).collect()
        assert {r["doc_id"]: r["n_words"] for r in found} == want
    assert suffix_dedup.repeated_passages(docs(spark, "a").limit(0)).count() == 0


def test_a_shared_8_gram_alone_is_no_passage(spark):
    words = lambda a, b: F.transform(F.sequence(F.lit(a), F.lit(b)), lambda i: F.md5(F.concat_ws("-", "id", i)))
    shared = F.array(*[F.lit(w) for w in "these eight words stand in every single text".split()])
    d = spark.range(150_000).select(F.col("id").alias("doc_id"), F.array_join(F.concat(words(1, 45), shared, words(46, 90)), " ").alias("text"))
    assert suffix_dedup.repeated_passages(d).count() == 0


def test_spans_join_in_order():
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 12)))]
        a, b = suffix_dedup._merged(np.array([x for x, _ in spans], np.int32), np.array([y for _, y in spans], np.int32))
        covered = {k for x, y in spans for k in range(x, y)}
        assert sum(y - x for x, y in zip(a, b)) == len(covered) and all(x > y for x, y in zip(a[1:], b))


def test_a_long_text_passes_whole(spark):
    words = [f"w{i}" for i in range(200_000)]
    found = suffix_dedup.repeated_passages(docs(spark, " ".join(words), " ".join(words[1000:150_000]), "x", None)).collect()
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found} == {1: [(1000, 150_000)], 2: [(0, 149_000)]}
