"""The pipeline's stages keep what they should, on a small corpus."""

import random

import corpus_pipeline
from rowgraph.llm import packing


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    rows, labels = [], []
    for i in range(120):
        bad = i % 5 == 0
        body = prose(40)
        if bad:
            body = " ".join(w + "###" for w in body.split())
        rows.append((i, f"{body}\nA line that all of them share.", "en", "s", len(body)))
        labels.append((i, int(not bad), 0))
    rows += [(200, rows[1][1], "en", "s", 1), (201, rows[2][1] + " more", "en", "s", 1), (202, prose(40) + " mail me@x.com now", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = str(tmp_path / f"out{len(kept)}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r["doc_id"]: r for r in docs.collect()})
    good = {i for i in range(120) if i % 5} | {200, 201, 202}
    assert set(kept[0]) == good
    assert set(kept[1]) == good and not any("all of them share" in r["text"] for i, r in kept[1].items() if i != 201)
    assert set(kept[2]) == good - {200, 201}
    assert set(kept[3]) == set(kept[2]) and "me@x.com" not in kept[3][202]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in kept[3].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept[3]) and all(r["capacity"] in packing.CAPACITIES for r in packed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
