from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import ODD, SMALL, words
from pyspark.sql import functions as F

from campaign_analytics.llm import hidden_markov, hmm, queries


def random_model(states=3, kinds=7, seed=1):
    rng = np.random.Generator(np.random.PCG64(seed))
    chain = hmm.Chain(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states))
    return rng, chain, rng.dirichlet(np.ones(kinds), states).T.copy()


def over_all_paths(tokens, lengths, emissions, chain):
    """Log-likelihoods and expected counts, from every path of states."""
    states = len(chain.start)
    by_word, moves, start = np.zeros_like(emissions), np.zeros((states, states)), np.zeros(states)
    out, at = [], 0
    for n in lengths:
        text, at = tokens[at : at + n], at + n
        paths = {}
        for path in itertools.product(range(states), repeat=n + 1):
            p = chain.start[path[0]]
            for k, word in enumerate(text):
                p *= chain.moves[path[k], path[k + 1]] * emissions[word, path[k + 1]]
            paths[path] = p
        total = sum(paths.values())
        out.append(math.log(total))
        for path, p in paths.items():
            start[path[0]] += p / total
            for k, word in enumerate(text):
                moves[path[k], path[k + 1]] += p / total
                by_word[word, path[k + 1]] += p / total
    return np.array(out), by_word, moves, start


@pytest.mark.parametrize("chunk, block", [(4096, 1 << 18), (2, 4), (1, 1), (3, 5)])
def test_recursions_against_all_paths(chunk, block):
    rng, chain, emissions = random_model()
    lengths = np.array([1, 5, 2, 7, 3, 6])
    tokens = rng.integers(0, len(emissions), lengths.sum())
    found, by_word, moves, start = over_all_paths(tokens, lengths, emissions, chain)
    counts, total = hmm.expected_counts(tokens, lengths, emissions, chain, chunk=chunk, block=block)
    alone = hmm.log_likelihoods(tokens, lengths, emissions, chain, chunk=chunk, block=block)
    np.testing.assert_allclose(alone, found, rtol=1e-12)
    np.testing.assert_allclose(total, found.sum(), rtol=1e-12)
    np.testing.assert_allclose(counts.words, by_word, atol=1e-12)
    np.testing.assert_allclose(counts.moves, moves, atol=1e-12)
    np.testing.assert_allclose(counts.start, start, atol=1e-12)


def test_expectation_and_maximisation_raise_the_likelihood():
    rng, chain, emissions = random_model(3, 20, seed=4)
    lengths = rng.integers(1, 60, 40)
    tokens = rng.integers(0, 20, lengths.sum())
    last = -math.inf
    for _ in range(8):
        counts, total = hmm.expected_counts(tokens, lengths, emissions, chain)
        assert total > last
        last = total
        emissions = counts.words / counts.words.sum(axis=0)
        chain = hmm.Chain.from_counts(counts.start, counts.moves, firmness=0)


def test_long_text_does_not_underflow():
    _, chain, emissions = random_model()
    tokens = np.arange(300_000) % 7
    alone = hmm.log_likelihoods(tokens, np.array([300_000]), emissions, chain)
    cut = hmm.log_likelihoods(tokens, np.array([300_000]), emissions, chain, chunk=777)
    assert np.isfinite(alone).all()
    np.testing.assert_allclose(alone, cut, rtol=1e-12)


def test_parts_add_up():
    rng = np.random.Generator(np.random.PCG64(7))
    whole = hidden_markov._whole(hidden_markov._parted(rng.gamma(0.2, size=(500, 8))))
    assert (whole.sum(axis=1) == 255).all() and (whole >= 0).all()


def lowered(text):
    return [w.encode().lower() for w in words(text)]


def is_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base(docs):
    counts = Counter()
    for i, t in docs:
        if not is_out(i):
            counts.update([*lowered(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in docs:
        tokens = [*lowered(t), None]
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((i, is_out(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, score))
    return out


def same_base(found, docs):
    key = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted((r[:6] for r in found), key=key), sorted(base(docs), key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9)


def test_query_against_brute_force(spark, documents):
    found = [tuple(r) for r in queries.op12_hidden_markov(spark, SMALL).collect()]
    same_base(found, documents)
    held_out = [r for r in found if r[1]]
    assert sum(r[6] for r in held_out) > sum(r[5] for r in held_out)


def plain_score(tokens, model, by_word, states):
    """The forward recursion in logarithms, token by token."""
    ahead = np.log(model.chain.start)
    for word in tokens:
        before = np.logaddexp.reduce(ahead[:, None] + np.log(model.chain.moves), axis=0)
        ahead = before + np.log(by_word(word))
    return np.logaddexp.reduce(ahead) / math.log(10)


def test_scores_against_the_trained_model(spark, documents):
    """Every text again, by the plain recursion, with the model read from its tables; and it is a model."""
    docs = spark.createDataFrame(documents[:60], "doc_id long, text string").repartition(5)
    states, sizes = 4, {"run_bytes": 30_000, "bucket_words": 500, "sample_documents": 20}
    model = hidden_markov.train(docs, states=states, **sizes)
    words_of = {r["run"]: np.frombuffer(r["words"], "<u8") for r in model.runs.select("run", "words").collect()}
    table, buckets = {}, set()
    for r in model.answers.orderBy("run", "bucket").collect():
        buckets.add(r["bucket"])
        counts, parts = np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["parts"], np.uint8).reshape(-1, states - 1)
        hashes, words_of[r["run"]] = np.split(words_of[r["run"]], [len(counts)])
        rows = model.sums.emissions(counts, parts)
        for h, c, p in zip(hashes.tolist(), counts.tolist(), rows):
            if c:
                assert h not in table or (table[h] == p).all()
                table[h] = p
    assert len(words_of) > 3 and len(buckets) > 3 and not any(map(len, words_of.values()))
    unknown = model.sums.emissions(np.zeros(1, np.int64), np.zeros((1, states - 1)))[0]
    np.testing.assert_allclose(sum(table.values()) + unknown, np.ones(states), rtol=1e-9)
    np.testing.assert_allclose(model.chain.moves.sum(axis=1), np.ones(states))
    found = {r["doc_id"]: r["score"] for r in hidden_markov.score(docs, states=states, **sizes).collect()}
    for doc_id, text in documents[:60]:
        hashes, _ = hidden_markov._hashed([text])
        again = plain_score(hashes.tolist(), model, lambda h: table.get(h, unknown), states)
        assert math.isclose(found[doc_id], again, rel_tol=1e-9)


def test_odd_rows(spark, odd, empty):
    clash = odd.withColumns({c: F.lit(1) for c in ("run", "docs", "tokens", "held_out", "bucket")})
    same_base([tuple(r) for r in hidden_markov.score(clash).collect()], ODD)
    assert hidden_markov.score(empty).collect() == []
    out = spark.createDataFrame([(i, "a b a") for i in range(60) if is_out(i)], "doc_id long, text string")
    rows = hidden_markov.score(out).collect()
    assert rows and all((r["n_known"], r["train_tokens"], r["score"]) == (0, 0, 0.0) for r in rows)
    alone = hidden_markov.score(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    same_base([tuple(r) for r in alone], [(1, None)])


def test_all_training_documents_make_the_model(spark, documents):
    """Scores are those of Baum-Welch over every training text from hashed shares; no sample has a part."""
    docs = [(i, t) for i, t in documents if not is_out(i)][:40] + [(i, t) for i, t in documents if is_out(i)][:5]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["score"] for r in hidden_markov.score(frame).collect()}
    hashes, lengths = hidden_markov._hashed([t for _, t in docs])
    kinds, tokens = np.unique(hashes, return_inverse=True)
    trained = hidden_markov._Trained.of(tokens, lengths, np.array([is_out(i) for i, _ in docs]))
    emissions = hidden_markov._start_emissions(kinds, hidden_markov.STATES)
    chain = hmm.Chain.sticky(hidden_markov.STATES, hidden_markov.START_STAY)
    for _ in range(hidden_markov.ROUNDS):
        counts, parts, moves = trained.step(emissions, chain)
        moves, start = np.split(moves / hidden_markov._MOVE, [hidden_markov.STATES**2])
        chain = hmm.Chain.from_counts(start, moves.reshape(hidden_markov.STATES, -1))
        emissions = hidden_markov._sums(counts, parts).emissions(counts, parts)
    again = hmm.log_likelihoods(tokens, lengths, emissions, chain) / math.log(10)
    np.testing.assert_allclose([found[i] for i, _ in docs], again, rtol=1e-9)
    other = {r["doc_id"]: r["score"] for r in hidden_markov.score(frame, sample_documents=1).collect()}
    assert other == found
