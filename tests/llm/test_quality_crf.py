from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import ODD, SMALL

from campaign_analytics.llm import quality_crf, queries, wordhash

CHECKED = SMALL.replace("0.001", "0.01")


def test_marginals_match_all_labellings():
    rng = np.random.Generator(np.random.PCG64(8))
    doc = np.repeat([0, 1, 2], [4, 1, 3])
    good, steps = rng.normal(size=len(doc)), rng.normal(size=(2, 2))
    found, _, expected = quality_crf.marginals(good, steps, quality_crf._by_position(doc))
    total = np.zeros((2, 2))
    for d in range(3):
        own = good[doc == d]
        weight, share, moves = 0.0, np.zeros(len(own)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(own)):
            w = np.exp(sum(a for a, b in zip(own, y) if b) + sum(steps[a, b] for a, b in zip(y, y[1:])))
            weight += w
            share += w * np.array(y)
            for a, b in zip(y, y[1:]):
                moves[a, b] += w
        assert found[doc == d] == pytest.approx(share / weight)
        total += moves / weight
    assert expected == pytest.approx(total)


KINDS = ["#*$%&<>@_=+~^", "|", "!", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", ".", ","]


def plain_features(text):
    """The features of a text's lines with a word, line by line and word by word."""
    every = [w for w in re.split(rb"[\x20\x09-\x0d]+", text.encode()) if w]
    shingles = Counter(zip(every, every[1:], every[2:]))
    again = [False] * len(every)
    for i, three in enumerate(zip(every, every[1:], every[2:])):
        if shingles[three] > 1:
            again[i] = again[i + 1] = again[i + 2] = True
    rows, sizes, seen, at = [], [], set(), 0
    for line in text.encode().split(b"\n"):
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", line) if w]
        if not words:
            continue
        share = lambda flags: sum(flags) / len(words)  # noqa: E731, B023
        own = [sum(line.count(c.encode()) for c in kind) / len(line) for kind in KINDS]
        own.append(share([a == b for a, b in zip(words, words[1:])]))
        own.append(share([w in words[:i] for i, w in enumerate(words)]))
        own.append(share(again[at : at + len(words)]))
        own = [math.sqrt(v) for v in own]
        own += [min(len(line) / len(words), 40) / 20, math.log1p(len(words)) / 6, float(line in seen)]
        own += [share([len(w) > 25 for w in words]), float(line.endswith(b"."))]
        seen.add(line)
        at += len(words)
        rows.append(own)
        sizes.append(len(line))
    around = [rows[max(i - 1, 0)] + rows[min(i + 1, len(rows) - 1)] + [1.0] for i in range(len(rows))]
    return [a + b for a, b in zip(rows, around)], sizes


def plain_score(field, text):
    """Length-weighted mean of the lines' probabilities of good, by plain forward and backward sums."""
    rows, sizes = plain_features(text)
    if not rows:
        return 0.0
    good = [sum(a * b for a, b in zip(row, field.weights)) for row in rows]
    emit = [(1.0, math.exp(g)) for g in good]
    step = np.exp(field.steps)
    ahead = [emit[0]]
    for e in emit[1:]:
        now = [e[b] * sum(ahead[-1][a] * step[a, b] for a in (0, 1)) for b in (0, 1)]
        ahead.append(tuple(v / sum(now) for v in now))
    back = [(1.0, 1.0)]
    for e in reversed(emit[1:]):
        now = [sum(step[a, b] * e[b] * back[-1][b] for b in (0, 1)) for a in (0, 1)]
        back.append(tuple(v / sum(now) for v in now))
    share = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(ahead, reversed(back))]
    return sum(p * n for p, n in zip(share, sizes)) / sum(sizes)


def test_query_against_plain_scores(spark, documents):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    field = quality_crf.fit_field(docs, labels)
    found = {r["doc_id"]: r["score"] for r in queries.op2_quality_crf(spark, SMALL).collect()}
    for doc_id, text in documents:
        assert found[doc_id] == pytest.approx(plain_score(field, text or ""), abs=1e-9)


def test_a_score_is_that_of_the_text_alone(spark):
    docs, labels = (spark.read.parquet(f"{CHECKED}/{t}.parquet") for t in ("documents", "labels"))
    field = quality_crf.fit_field(docs, labels)
    texts = [(r[0] or "").encode() for r in docs.select("text").collect()]
    texts += [b"foo bar baz", b"ends in foo", b"foo", b"foo foo", b"", b"bar\nfoo\nfoo"] * 3

    def scores(batch):
        return field.score(*quality_crf.line_features(wordhash.Run(batch)), len(batch)).tolist()

    alone = {t: scores([t])[0] for t in dict.fromkeys(texts)}
    random.Random(8).shuffle(texts)
    assert scores(texts) == [alone[t] for t in texts]


def test_held_out_accuracy(spark):
    rows = queries.op2_quality_crf(spark, CHECKED)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    found = rows.join(spark.read.parquet(f"{CHECKED}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in found]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_held_out_rows_do_not_train(spark):
    docs = spark.read.parquet(f"{CHECKED}/documents.parquet")
    labels = spark.read.parquet(f"{CHECKED}/labels.parquet")
    held = quality_crf.is_held_out(labels["doc_id"])
    other = labels.withColumn("quality", held.cast("int") * (1 - labels["quality"]) + (1 - held.cast("int")) * labels["quality"])
    a, b = (quality_crf.fit_field(docs, x).weights for x in (labels, other))
    assert a == pytest.approx(b)


def test_features_see_the_neighbours():
    run = wordhash.Run([b"a b\n\n### ###\nc", b"x"])
    x, size, doc = quality_crf.line_features(run)
    n = quality_crf.OWN_FEATURES
    assert doc.tolist() == [0, 0, 0, 1] and size.tolist() == [3, 7, 1, 1]
    assert (x[1, n : 2 * n] == x[0, :n]).all() and (x[1, 2 * n : 3 * n] == x[2, :n]).all()
    assert (x[3, n : 2 * n] == x[3, :n]).all()


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (3, 0)], "doc_id long, quality int")
    rows = quality_crf.score_quality(odd, labels).collect()
    assert len(rows) == len(ODD)
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    kept = quality_crf.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert quality_crf.score_quality(empty, labels).collect() == []
    assert quality_crf.score_quality(odd, labels.limit(0)).count() == len(ODD)
