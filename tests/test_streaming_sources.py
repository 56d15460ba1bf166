"""The extraction store replaces versions as a whole."""

from rowgraph.sources.storage import SCHEMA, ExtractionStore


def test_store_versions(spark, tmp_path):
    store = ExtractionStore(spark, str(tmp_path))
    assert store.read(1).count() == 0
    one = spark.createDataFrame([("1", (1, "1"), ["sara"], "Sara", 5)], SCHEMA)
    store.replace(1, one)
    assert store.read(1).count() == 1
    store.replace(1, store.read(1).unionAll(one))
    assert store.read(1).count() == 2
    assert len(list((tmp_path / "1").iterdir())) == 1
