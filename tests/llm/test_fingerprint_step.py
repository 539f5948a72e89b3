"""The pipeline's third stage takes candidates from SimHash fingerprints too."""

import corpus_pipeline
from lodestruct.llm import nearcopies


def test_pairs_of_near_fingerprints(spark):
    rows = [(5, 0b1011), (3, 0b1011), (9, 0b1011), (4, 0b1000), (8, (1 << 40) - 1), (7, 7 << 60)]
    found = nearcopies.fingerprint_pairs(spark.createDataFrame(rows, "node long, fp long")).collect()
    assert sorted(map(tuple, found)) == [(4, 3), (5, 3), (9, 3)]


def test_stage_goes_through_fingerprints(spark, sf, monkeypatch):
    seen, real = [], nearcopies.near_links
    monkeypatch.setattr(nearcopies, "near_links", lambda fps: seen.append(fps.columns) or real(fps))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (2, text + " more", "en", "a", 1), (3, "quite another text of some words", "en", "a", 1), (4, "", "en", "a", 0), (5, None, "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [1, 3, 4]
    assert seen == [["fp"]]
