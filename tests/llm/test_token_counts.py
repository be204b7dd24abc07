from __future__ import annotations

import random

from brute import ODD, SMALL
from tokenizers import Tokenizer

from campaign_analytics.llm import queries, token_counts, tokens

TOKENIZER = Tokenizer.from_file(queries.COUNTING_TOKENIZER)


def expected(i, text):
    n = len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)
    return i, len((text or "").encode()), n, n > 2048


def test_against_the_library(spark, documents):
    found = sorted(tuple(r) for r in queries.op10_token_counts(spark, SMALL).collect())
    assert found == [expected(i, t) for i, t in documents]


def test_odd_rows_and_small_pieces(odd, empty):
    for size in (7, 1 << 15):
        found = token_counts.count_tokens(odd, queries.COUNTING_TOKENIZER, piece_chars=size, batch_bytes=4 * size)
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(expected(i, t)) for i, t in ODD)
    assert token_counts.count_tokens(empty, queries.COUNTING_TOKENIZER).collect() == []


def test_pieces_join_to_the_text():
    for _, text in ODD:
        for size in (1, 5, 1000):
            assert "".join(tokens.safe_pieces(text or "", size)) == (text or "")


def test_counts_are_those_of_the_library():
    rng = random.Random(5)
    counter = tokens.TokenCounter(tokens.tokenizer_json(queries.COUNTING_TOKENIZER))
    assert counter.bare is not None
    texts = [bytes(rng.choices(range(256), k=rng.randrange(60))).decode("latin-1") for _ in range(4000)]
    texts += [chr(c) + chr(c) for c in range(256)]
    parts = ["The", "Straße", "'S", "don'T", "<|endoftext|>", "<|ENDOFTEXT|>", "e\u0301", "Σ", "ΟΔΟΣ", "İ", "\xa0", "\x85", "\x1c", " "]
    parts += ["\n", "ÀÉ", "½", "²", "12", "...", "日本", "ﬁ", "\u3000"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(1, 20))) for _ in range(4000)]
    wanted = [len(e.ids) for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, a, b in zip(texts, counter.count(texts), wanted) if a != b]
    assert not wrong, wrong[:5]
