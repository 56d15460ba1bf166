"""Behaviours of the graph on small fixtures."""

import pytest
from pyspark.sql import functions as F

from rowgraph.plans.engine import Engine

PAIRS = ["a Sara Tehran", "b Sara Berlin", "a Reza Berlin", "a Sara Berlin"]
NOTES = [(i, "role_" + pair[0], pair[2:]) for i, pair in enumerate(PAIRS, 1)]


class Source:
    """A table that tests change."""

    def __init__(self, spark, rows):
        self.spark, self.rows = spark, list(rows)

    def __call__(self):
        return self.spark.createDataFrame(self.rows, "id int, owner string, body string")


def owned(rows, user):
    return rows.filter(F.col("owner") == user)


def built(spark, rows, visibility=None, **options):
    source, engine = Source(spark, rows), Engine(spark, **options)
    engine.watch("notes", source, "body", "id", visibility, owned)
    engine.maintain()
    return source, engine


def names(engine, user=None):
    return [r["surface"] for r in engine.session(user).entities("notes").collect()]


def edges(engine, user=None):
    return {(r["src"], r["dst"]) for r in engine.session(user).edges("notes").collect()}


@pytest.fixture(scope="module")
def notes(spark):
    return built(spark, NOTES)[1]


def test_entities_follow_row_visibility(notes):
    assert names(notes, "role_a") == ["berlin", "reza", "sara", "tehran"]
    assert names(notes, "role_b") == ["berlin", "sara"]


def test_union_shows_edges_with_any_visible_support(notes):
    assert edges(notes, "role_a") == {("sara", "berlin"), ("sara", "tehran"), ("berlin", "reza")}
    assert edges(notes, "role_b") == {("sara", "berlin")}


def test_intersection_hides_partially_visible_edges(notes):
    notes.find("notes").visibility = "intersection"
    try:
        assert edges(notes, "role_a") == {("sara", "tehran"), ("berlin", "reza")}
        assert len(edges(notes)) == 3
    finally:
        notes.find("notes").visibility = None


def test_catalog_is_filtered_like_the_accessors(notes):
    assert notes.session().catalog("notes", "entity").count() == 4
    b = notes.session("role_b")
    assert b.catalog("notes", "entity").count() == 2
    assert b.catalog("notes", "edge_support").count() == 1
    assert b.catalog("notes", "mention").count() == 2
    assert b.catalog("notes", "edge").count() == 1
    assert b.catalog("notes", "entity_phonetic").count() == 2
    with pytest.raises(LookupError):
        b.catalog("notes", "watch")


def test_mentions_and_most_connected(notes):
    rows = notes.session("role_b").mentions("notes").collect()
    assert [(r["surface"], r["source_pk"], r["surface_form"]) for r in rows] == [("berlin", "2", "berlin"), ("sara", "2", "sara")]
    top = notes.session("role_a").most_connected("notes").collect()
    assert [(r["person"], r["times_together"]) for r in top] == [("berlin", 2), ("sara", 2), ("reza", 1), ("tehran", 1)]


def test_views(spark, notes):
    notes.session("role_b").views("notes")
    assert {r[0] for r in spark.sql("select person from my_people").collect()} == {"berlin", "sara"}
    assert spark.sql("select * from my_circle").count() == 1
    assert spark.sql("select * from my_review_queue").count() == 0


def test_live_maintenance_applies_inserts_updates_deletes(spark):
    source, engine = built(spark, [(1, "amir", "Sara Tehran")])
    assert names(engine) == ["sara", "tehran"]
    source.rows.append((2, "amir", "Reza Berlin"))
    assert names(engine) == ["sara", "tehran"]
    assert engine.maintain() >= 1
    assert names(engine) == ["berlin", "reza", "sara", "tehran"]
    source.rows[0] = (1, "amir", "Sara Paris")
    del source.rows[1]
    engine.maintain()
    assert names(engine) == ["paris", "sara"]


def test_change_queue_keeps_updated_rows(spark):
    source, engine = built(spark, [(1, "amir", "Sara Tehran"), (2, "amir", "Reza")])
    source.rows = [(1, "amir", "Sara Paris")]
    engine.enqueue(1, [("1", "delete"), ("1", "upsert"), ("2", "upsert"), ("2", "delete")])
    assert engine.process_changes(1) == 4
    assert names(engine) == ["paris", "sara"]
    assert engine.process_changes(1) == 0


def test_empty_table_then_insert(spark):
    source, engine = built(spark, [])
    assert names(engine) == []
    source.rows.append((1, "amir", "Sara Tehran"))
    assert engine.maintain() >= 1
    assert names(engine) == ["sara", "tehran"]


def test_gc_forgets_deleted_rows(spark):
    source, engine = built(spark, [(1, "amir", "Sara Tehran"), (2, "amir", "Reza Berlin")])
    dump = engine.index_dump("notes")
    assert sorted(",".join(r["surfaces"]) for r in dump.collect()) == ["reza,berlin", "sara,tehran"]
    source.rows.pop()
    assert engine.gc("notes") == 1
    assert [r["surfaces"] for r in engine.index_dump("notes").collect()] == [["sara", "tehran"]]
    assert engine.gc("notes") == 0


def test_reindex_counts_mentions(spark):
    _, engine = built(spark, NOTES)
    assert engine.reindex(1) == 8


def caps(text):
    words = F.split(text, r"[^\p{L}]+")
    return F.transform(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")), lambda w: F.lower(w))


def rels(text):
    found = F.regexp_extract_all(text, F.lit(r"(\p{Lu}\p{L}+ (?:closed|signed) \p{Lu}\p{L}+)"), F.lit(1))
    return F.flatten(F.transform(found, lambda m: F.split(F.lower(m), " ")))


def test_custom_extractor(spark):
    _, engine = built(spark, [(1, "amir", "had coffee with Sara in Tehran"), (2, "amir", None)], extractor=caps)
    assert names(engine) == ["sara", "tehran"]


def test_relation_extractor_makes_typed_edges(spark):
    _, engine = built(spark, [(1, "a", "Joe closed Globex. Nadia signed Globex.")], extractor=caps, relation_extractor=rels)
    rows = engine.session().edges("notes").collect()
    assert [(r["src"], r["predicate"], r["dst"]) for r in rows] == [("joe", "closed", "globex"), ("nadia", "signed", "globex")]


def test_relations_drop_nulls_then_chunk(spark):
    def flat(text):
        return F.array(F.lit("joe"), F.lit(None), F.lit("met"), F.lit("nadia"), F.lit("rest"))

    _, engine = built(spark, [(1, "a", "Joe Nadia")], relation_extractor=flat)
    assert [tuple(r)[1:] for r in engine.session().edges("notes").collect()] == [("joe", "nadia", "met")]


def test_judge(spark):
    def drop(text, found):
        return F.filter(found, lambda x: x != "secret")

    _, engine = built(spark, [(1, "amir", "sara secret tehran")], judge=drop)
    assert names(engine) == ["sara", "tehran"]
    _, engine = built(spark, [(1, "amir", "sara secret")], judge=lambda t, s: F.lit(None).cast("array<string>"))
    assert names(engine) == ["sara", "secret"]


def test_python_point_failures_cost_one_row(spark):
    from rowgraph.functions.extension import python_point

    def f(text):
        if "bad" in text:
            raise ValueError(text)
        return text.lower().split()

    _, engine = built(spark, [(1, "a", "Sara"), (2, "a", "bad")], extractor=python_point(f, on_error=[]))
    assert names(engine) == ["sara"]


def test_script_variants_fold(spark):
    assert len(names(built(spark, [(1, "a", "علي"), (2, "a", "علی")])[1])) == 1


def test_phonetic_proposals_bridge_scripts(spark):
    _, engine = built(spark, [(1, "a", "Faeze"), (2, "a", "فائزه")])
    rows = engine.session().proposals("notes").collect()
    assert [{r["surface_a"], r["surface_b"]} for r in rows] == [{"faeze", "فائزه"}]
    assert len(names(engine)) == 2


def test_gated_merge_with_reversible_decisions(spark):
    _, engine = built(spark, [(1, "a", "Khashayar"), (2, "a", "خشایار"), (3, "a", "Ali"), (4, "a", "علی")])
    assert len(names(engine)) == 3
    assert engine.split("notes", "Khashayar", "خشایار")
    assert len(names(engine)) == 4
    assert engine.merge("notes", "Ali", "علی")
    assert len(names(engine)) == 3
    assert engine.session("a").decisions("notes").count() == 2
    assert engine.session("nobody").decisions("notes").count() == 0
    assert engine.unmerge("notes", "Khashayar", "خشایار")
    assert len(names(engine)) == 2
    assert not engine.merge("notes", "Ali", "ali") and not engine.merge("notes", "...", "ali")


def test_gated_fuzzy_merge_is_reversible(spark):
    _, engine = built(spark, [(1, "s", "Shahrbanoodeylam"), (2, "s", "Shahrbanoodeylan")])
    assert len(names(engine)) == 1
    engine.split("notes", "Shahrbanoodeylam", "Shahrbanoodeylan")
    assert len(names(engine)) == 2


def test_mention_split_separates_identical_spellings(spark):
    _, engine = built(spark, [(1, "a", "Sara"), (2, "b", "Sara")])
    assert names(engine) == ["sara"]
    assert engine.split_mention("notes", 2, "Sara")
    assert names(engine) == ["sara", "sara"]
    assert engine.session("b").catalog("notes", "mention_override").count() == 1
    assert engine.session("a").catalog("notes", "mention_override").count() == 0
    assert not engine.split_mention("notes", 2, "...")
    assert engine.unsplit_mention("notes", 2, "Sara")
    assert names(engine) == ["sara"]


def test_embedding_rescues_a_short_name(spark):
    def vector(norm):
        near = norm.isin("ali", "علی")
        return F.when(near, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))

    rows = [(1, "a", "Ali"), (2, "a", "علی"), (3, "a", "Reza")]
    assert len(names(built(spark, rows)[1])) == 3
    _, engine = built(spark, rows, embedder=vector)
    assert len(names(engine)) == 2
    engine.split("notes", "Ali", "علی")
    assert len(names(engine)) == 3


def test_shares_show_at_once(spark):
    docs = [(1, "joe", "Joe Globex Nadia"), (2, "kimi", "Kimi Stark")]
    shares = []

    def policy(rows, user):
        shared = spark.createDataFrame(shares, "id int, who string").filter(F.col("who") == user)
        return rows.join(shared, "id", "left").filter((F.col("owner") == user) | F.col("who").isNotNull()).drop("who")

    source, engine = Source(spark, docs), Engine(spark)
    engine.watch("notes", source, "body", "id", policy=policy)
    engine.maintain()
    assert names(engine, "kimi") == ["kimi", "stark"]
    shares.append((1, "kimi"))
    assert names(engine, "kimi") == ["globex", "joe", "kimi", "nadia", "stark"]
    shares.clear()
    assert names(engine, "kimi") == ["kimi", "stark"]


def test_two_watched_columns_are_ambiguous(spark):
    source, engine = Source(spark, NOTES), Engine(spark, resolution="exact")
    assert engine.watch("notes", source, "body", "id") == 1
    assert engine.watch("notes", source, "owner", "id") == 2
    assert engine.watch("notes", source, "body", ["id"]) == 1
    engine.maintain()
    with pytest.raises(LookupError):
        engine.session().entities("notes")
    assert engine.session().entities("notes", "owner").count() == 3


def test_streaming_maintenance(spark, tmp_path):
    from rowgraph.streaming.maintain import start_maintenance

    source, engine = built(spark, [(1, "a", "Sara Tehran"), (2, "a", "Reza")])
    source.rows = [(1, "a", "Sara Paris"), (3, "a", "Ben")]
    folder = str(tmp_path / "changes")
    spark.createDataFrame([(1, "1", "upsert"), (2, "2", "delete"), (3, "3", "upsert")], "seq long, source_pk string, op string").write.parquet(folder)
    stream = spark.readStream.schema("seq long, source_pk string, op string").parquet(folder)
    start_maintenance(engine, 1, stream, str(tmp_path / "at"), every=None).awaitTermination()
    assert names(engine) == ["ben", "paris", "sara"]


def test_a_failed_run_loses_no_change(spark, monkeypatch):
    watch, engine = built(spark, [(1, "a", "Sara Tehran"), (2, "a", "Reza Berlin")])
    engine.enqueue(1, [("1", "delete")])

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(engine, "resolve", fail)
        with pytest.raises(RuntimeError):
            engine.process_changes(1)
        with pytest.raises(RuntimeError):
            engine.maintain()
    assert engine.process_changes(1) == 1 and engine.process_changes(1) == 0
