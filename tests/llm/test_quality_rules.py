from __future__ import annotations

import math
from collections import Counter

import brute
import numpy as np
import pytest
from brute import ODD, SMALL

from campaign_analytics.llm import ngram_tables, quality_rules, queries, wordhash


def counts(text):
    words = brute.words(text)
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_counts_match(spark, documents):
    found = {r["doc_id"]: tuple(r)[1:7] for r in queries.op9_quality_rules(spark, SMALL).collect()}
    assert found == {i: counts(t) for i, t in documents}


def test_packed_arrays_come_back():
    rng = np.random.Generator(np.random.PCG64(6))
    for n in (0, 1, 2, 5000):
        points = rng.integers(1, 0x110000 if n < 3000 else 40, (5, n)).astype(np.uint64)
        high, low = points[0] << 21 | points[1], points[2] << 42 | points[3] << 21 | points[4]
        order = np.lexsort((low, high))
        keys = high[order], low[order]
        for a, b in zip(keys, ngram_tables.unpack_keys(ngram_tables.pack_keys(keys))):
            assert (a == b).all()
        numbers = rng.integers(-(2**60), 2**60, n)
        assert (ngram_tables.unpack(ngram_tables.pack(numbers)) == numbers).all()


def test_parts_of_grams():
    def key(text):
        codes = [0] * (5 - len(text)) + [ord(c) for c in text]
        parts = codes[0] << 21 | codes[1], codes[2] << 42 | codes[3] << 21 | codes[4]
        return np.array(parts[:1], np.uint64), np.array(parts[1:], np.uint64)

    for text in ("abcde", "a\U0010ffffc\U0010fffee", "bcde", "cde", "de", "e"):
        assert ngram_tables.without_first(key(text), len(text)) == key(text[1:])
        assert ngram_tables.without_last(key(text)) == key(text[:-1])


def test_clean_documents_stay_and_noise_goes(spark):
    sf = SMALL.replace("0.001", "0.01")
    rows = queries.op9_quality_rules(spark, sf).select("doc_id", "base_failed", "kept")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = rows.join(labels, "doc_id").collect()
    clean = [r["kept"] for r in found if r["quality"] == 1 and not r["base_failed"]]
    noise = [r["kept"] for r in found if r["quality"] == 0]
    assert np.mean(clean) >= 0.98 and np.mean(noise) <= 0.3


def test_odd_rows(odd, empty):
    rows = quality_rules.judge(odd).collect()
    assert sorted(repr((r[0], *r[1:7])) for r in rows) == sorted(repr((i, *counts(t))) for i, t in ODD)
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert quality_rules.judge(empty).collect() == []
    assert quality_rules.judge(odd.filter("doc_id = 4")).collect()[0]["kept"] is False


def test_word_hashes_follow_the_bytes():
    texts = ["a bb a", "", "bb\n a\x0bbb ", " x a"]
    run = wordhash.Run([t.encode() for t in texts])
    words = [w for t in texts for w in brute.words(t)]
    assert run.n_words.tolist() == [len(brute.words(t)) for t in texts]
    by = {}
    for w, h in zip(words, run.words.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def plain_code_points(texts):
    """gram -> log-probability by dictionaries; a gram of one text only is scored without that text."""
    k = ngram_tables.GRAM
    texts = [" " + " ".join(brute.words(t)) + " " for t in texts]
    owners, grams = {}, Counter()
    for i, t in enumerate(texts):
        for g in (t[j : j + k] for j in range(len(t) - k + 1)):
            grams[g] += 1
            owners.setdefault(g, set()).add(i)
    levels = [grams]
    for _ in range(k - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels.reverse()

    def probability(g):
        n = levels[len(g) - 1]
        of = [max(sum(c == i for c in n.values()), 1) for i in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1])
        off = [1 - 2 * y * of[1] / of[0], 2 - 3 * y * of[2] / of[1], 3 - 4 * y * of[3] / of[2]]
        off = [0] + [min(max(d, 0.05), m) for d, m in zip(off, (0.95, 1.9, 2.85))]
        below = probability(g[1:]) if len(g) > 1 else 1 / len(n)
        own = {x: c for x, c in n.items() if x[:-1] == g[:-1]}
        if len(g) == k and len(owners[g]) == 1:
            own = {x: c for x, c in own.items() if x != g}
            if not own:
                return below
        total, c = sum(own.values()), own.get(g, 0)
        return (c - off[min(c, 3)] + sum(off[min(x, 3)] for x in own.values()) * below) / total

    return texts, lambda g: math.log(probability(g))


@pytest.mark.parametrize("bucket_grams", [2, 1 << 19])
def test_model_of_code_points_in_tables(spark, monkeypatch, bucket_grams):
    monkeypatch.setattr(ngram_tables, "BUCKET_GRAMS", bucket_grams)
    texts = ["in 1984 the cat sat, the cat", "in 1985 the hat: the cat é日本語日本", "the cat 日本語", "(the) cat? 1984 日本語日本", ""]
    frame = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    found = {r["doc_id"]: r["cross"] for r in quality_rules.measure(frame.repartition(3)).collect()}
    plain, logp = plain_code_points(texts)
    for i, t in enumerate(plain):
        own = [-logp(t[j : j + 5]) for j in range(len(t) - 4)]
        assert found[i] == pytest.approx(sum(own) / max(len(own), 1) / quality_rules.GRID, abs=1)


def test_medians(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    given = [(lang, int(v)) for lang, size in (("a", 501), ("b", 2), (None, 70)) for v in rng.integers(-300, 5000, size)]
    found = quality_rules._grid_median(spark.createDataFrame(given, "lang string, cross long"), "cross", "middle").collect()
    wanted = {}
    for lang in ("a", "b", None):
        own = sorted(v for x, v in given if x == lang)
        wanted[lang] = own[(len(own) - 1) // 2]
    assert {r["lang"]: r["middle"] for r in found} == wanted


def test_digits_and_other_scripts_are_told_apart(spark):
    line = "order 1984 was 東京都庁 and then shipped to the old house by the river "
    rows = [(i, "en", line * 2) for i in range(6)]
    rows += [(6, "en", line * 2), (7, "en", line.replace("1984", "7263") * 2), (8, "en", line.replace("東京都庁", "北海道札") * 2)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = {r["doc_id"]: r["cross"] for r in quality_rules.measure(frame).collect()}
    assert found[7] > 1.2 * found[6] and found[8] > 1.2 * found[6]
