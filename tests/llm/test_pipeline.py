from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
import pytest
from brute import SMALL
from pyspark.sql import functions as F
from test_packing import ids_of, places
from test_pii import base

from campaign_analytics.llm import quality_crf


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage returns, as the driver runs them."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out[name] = docs
    return out


def texts(frame):
    return sorted((r["doc_id"], r["text"]) for r in frame.collect())


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    for name in ("quality", "near_duplicates", "personal_data", "mixing"):
        assert stages[name].columns == stages["documents"].columns


def test_quality_decisions_take_effect(spark, stages):
    scored = quality_crf.score_quality(stages["documents"], spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = {r["doc_id"] for r in scored.filter("predicted = 1").collect()}
    assert {i for i, _ in texts(stages["quality"])} == good
    clean = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").select("doc_id").collect()
    assert sum(r[0] in good for r in clean) >= 0.97 * len(clean)


def test_one_of_each_group_stays(stages):
    before = texts(stages["quality"])
    groups = brute.near_duplicates(before)
    assert texts(stages["near_duplicates"]) == [(i, t) for i, t in before if groups[i][1] == i]


def test_personal_data_is_gone(stages):
    before, after = dict(texts(stages["near_duplicates"])), dict(texts(stages["personal_data"]))
    assert before.keys() == after.keys()
    for i, text in after.items():
        assert not base(text)
        if not base(before[i]):
            assert "[TERM]" in text or text == before[i]


def test_the_mix_meets_its_budgets(stages):
    size = lambda frame: {
        s: sum(len(brute.words(r["text"])) for r in frame.filter(F.col("source") == s).collect())
        for s in {r[0] for r in frame.select("source").collect()}
    }
    before, after = size(stages["personal_data"]), size(stages["mixing"])
    wanted = brute.targets(before)
    assert {s: after.get(s, 0) for s in before} == {s: int(t + 1e-6) for s, t in wanted.items()}
    own = dict(texts(stages["personal_data"]))
    assert max(Counter(i for i, _ in texts(stages["mixing"])).values()) <= 2
    assert all(own[i].startswith(t) for i, t in texts(stages["mixing"]))


def test_every_text_of_the_mix_is_packed(stages):
    rows = stages["packing"].collect()
    places(rows)
    wanted = Counter()
    for i, t in texts(stages["mixing"]):
        wanted.update((i, *p) for p in brute.pack_pieces(ids_of, [(i, t)], 2048)[i])
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted


def test_run_returns_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.columns == stages["packing"].columns and found.count() == stages["packing"].count()


def test_stages_take_an_empty_table(spark, stages):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, stages["documents"].limit(0), SMALL).count() == 0, name


def test_stages_take_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use."""
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality":
            kept = stage(spark, odd, str(tmp_path))
            assert kept.columns == odd.columns and kept.count() <= odd.count()
            continue
        found = stage(spark, odd, str(tmp_path))
        assert found.columns == odd.columns, name
        found.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).count() >= odd.count()


def test_ids_that_repeat_do_not_grow_the_training_sample(spark):
    from campaign_analytics.llm.training import training_rows

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert sorted(tuple(r) for r in training_rows(docs, labels, "quality", 5).collect()) == [("a", 1), ("c", 0)]
