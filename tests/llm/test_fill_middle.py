from __future__ import annotations

import hashlib

import numpy as np
import pytest
from brute import ODD, sha
from pyspark.sql import functions as F

from campaign_analytics.llm import fill_middle

MORE = [
    (20, "é" * 700 + "a" * 900 + "漢字" * 400 + "\U0001f600" * 300),
    (21, "holds a <S> mark"),
    (22, "<P><" * 3),
    (23, "a < b <S and <<M"),
    (24, "<"),
    (25, "<S" * 40),
    (26, "x"),
]


def brute(doc_id, text):
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, form, a, b - a, sha(out), sha(text))


def digests(frame):
    text = fill_middle.restored(F.col("output"), F.col("form"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(text, 256)]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=str)


@pytest.mark.parametrize("run_bytes", [1, 3000, 4 << 20])
def test_against_brute_force(spark, odd, run_bytes):
    more = spark.createDataFrame([(i, t) for i, t in MORE], "doc_id long, text string")
    found = digests(fill_middle.fill_in_middle(odd.select("doc_id", "text").union(more), run_bytes=run_bytes))
    assert found == sorted((brute(i, t) for i, t in [*ODD, *MORE]), key=str)


def test_clashing_columns_and_empty_tables(odd, empty):
    clash = odd.withColumns({c: F.lit(1) for c in ("a", "b", "form", "n", "output", "prefix_chars")})
    assert digests(fill_middle.fill_in_middle(clash)) == sorted((brute(i, t) for i, t in ODD), key=str)
    assert fill_middle.fill_in_middle(empty).collect() == []


def test_other_shares_and_marks(spark):
    rows = [(i, f"text number {i} " * 5) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = ("[P]", "[S]", "[M]")
    cut = fill_middle.fill_in_middle(frame, cut_percent=100, spm_percent=100, marks=marks).cache()
    assert {r["form"] for r in cut.collect()} == {"spm"}
    back = cut.select("doc_id", fill_middle.restored(F.col("output"), F.col("form"), marks).alias("text"))
    assert sorted(map(tuple, back.collect())) == rows
    assert {r["form"] for r in fill_middle.fill_in_middle(frame, cut_percent=0).collect()} == {"plain"}


def test_rank_index_is_exact_and_bounded():
    rng = np.random.Generator(np.random.PCG64(3))
    for steps in (
        np.ones(300_000, int),
        rng.integers(1, 5, 100_000),
        np.repeat(rng.integers(1, 5, 400), rng.integers(1, 900, 400)),
        rng.integers(1, 5, 1),
        np.empty(0, int),
    ):
        offsets = np.concatenate(([0], np.cumsum(steps)))
        index = fill_middle.RankIndex(offsets)
        ranks = np.arange(len(offsets))
        assert (index.find(ranks) == offsets).all()
        assert np.abs(offsets - index.predict(ranks)).max() <= 127
    assert len(fill_middle.RankIndex(np.arange(300_000)).starts) == 1
