from __future__ import annotations

import itertools
import random
from collections import Counter

import brute
from brute import ODD, SMALL
from tokenizers import Tokenizer

from campaign_analytics.llm import packing, queries, tokens

TOKENIZER = Tokenizer.from_file(queries.PACKING_TOKENIZER)


def ids_of(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def places(rows, capacity=2048):
    """Every sequence is gapless from 0 and holds at most the capacity; returns their number."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pieces_and_places(spark, documents):
    rows = queries.op7_packing(spark, SMALL).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        found.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert found == brute.pack_pieces(ids_of, documents, 2048)
    total = sum(r["length"] for r in rows)
    assert places(rows) <= -(-total // 2048) + 1


def test_ids_are_those_of_the_library():
    rng = random.Random(11)
    content = tokens.tokenizer_json(queries.PACKING_TOKENIZER)
    assert tokens.rank_table(content) is not None
    parts = ["the", "don't", " ", "  ", "\n", "\n\n", "\t", "é", "<|endoftext|>", "<", "12", "...", "\xa0", "\u3000", "\x85", "a<b"]
    parts += ["\r\n", "\x1c", "²", "ª", "'LL", "'s", "ÿß", "\x00", "日本", "\u200b", "½x", "_", "Ünd", "x" * 500, " " * 450]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(4000)]
    latin = [bytes(rng.choices(range(256), k=rng.randrange(40))).decode("latin-1") for _ in range(4000)]
    encoder = tokens.Encoder(content)
    assert sum(map(encoder._is_plain, latin)) > 3900
    for text, ids in zip(texts + latin, encoder.encode(texts + latin)):
        assert ids == b"".join(x.to_bytes(4, "little") for x in ids_of(text)), repr(text)


def test_bin_completion_is_optimal_on_small_sets():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.randrange(10, 60)
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 11))]
        bins = packing.BinCompletion(capacity, branches=50).pack(sizes, nodes=100_000)
        assert sorted(s for b in bins for s in b) == sorted(sizes)
        assert all(sum(b) <= capacity for b in bins)
        assert len(bins) == brute.fewest_bins(sizes, capacity), (capacity, sizes)


def test_bin_completion_improves_on_best_fit():
    rng = random.Random(4)
    completion = packing.BinCompletion(2048)
    sizes = [min(2048, max(1, int(rng.gauss(700, 250)))) for _ in range(2000)]
    counts = {s: sizes.count(s) for s in set(sizes)}
    assert len(completion.pack(sizes)) <= len(completion.best_fit(counts))
    assert len(completion.pack(sizes)) <= 1.01 * sum(sizes) / 2048 + 1


def test_odd_rows(odd, empty):
    rows = packing.pack(odd, queries.PACKING_TOKENIZER).collect()
    places(rows)
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    expected = {}
    for i, t in ODD:
        expected.setdefault(i, []).extend(brute.pack_pieces(ids_of, [(i, t)], 2048)[i])
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in expected.items()}
    assert packing.pack(empty, queries.PACKING_TOKENIZER).collect() == []


def test_production_defaults_are_optimal_on_small_sets():
    rng = random.Random(21)
    for k in range(300):
        capacity = rng.randrange(20, 2049)
        largest = capacity // rng.choice([1, 2, 3])
        sizes = [rng.randrange(1, largest + 1) for _ in range(rng.randrange(1, 11))]
        bins = packing.BinCompletion(capacity).pack(sizes)
        assert sorted(s for b in bins for s in b) == sorted(sizes)
        assert len(bins) == brute.fewest_bins(sizes, capacity), (capacity, sizes)


def exchanges(filling, sizes, room):
    """Fillings got by putting one size that is left in the place of some of the filling's."""
    left = Counter(sizes) - Counter(filling)
    for n in range(1, len(filling) + 1):
        for some in set(itertools.combinations(filling, n)):
            for s in left:
                more = s - sum(some)
                if more >= (n == 1) and sum(filling) + more <= room:
                    yield tuple(sorted((Counter(filling) - Counter(some) + Counter([s])).elements()))


def test_all_undominated_fillings():
    rng = random.Random(22)
    left_out = 0
    for _ in range(300):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 10))]
        counts = {s: sizes.count(s) for s in sizes}
        room = rng.randrange(1, 60)
        completion = packing.BinCompletion(60)
        present = sum(1 << s for s in counts)
        mirrored = sum(1 << (60 - s) for s in counts)
        found = [tuple(sorted(f)) for f in completion.fillings(counts, present, mirrored, room) if f is not None]
        subsets = {tuple(sorted(c)) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n)}
        maximal = set()
        for c in subsets:
            left = room - sum(c)
            if left >= 0 and not any(c.count(s) < counts[s] and s <= left for s in counts):
                maximal.add(c)
        assert set(found) <= maximal and len(found) == len(set(found))
        if room in counts:
            assert found == [(room,)]
            continue
        for c in maximal - set(found):  # each one left out is worse than another, up to one found
            left_out += 1
            assert any(True for _ in exchanges(c, sizes, room)), (sizes, room, c)
        for c in set(found):
            few = [e for e in exchanges(c, sizes, room) if len(c) - len(e) <= 2]
            assert not few or len(c) > packing._EXCHANGED, (sizes, room, c, few)
    assert left_out > 300


def test_sizes_below_a_half_are_paired():
    rng = random.Random(1)
    sizes = [rng.randint(410, 1024) for _ in range(3000)]
    completion = packing.BinCompletion(2048)
    counts = Counter(sizes)
    bins = completion.pack(sizes)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 2048 for b in bins)
    assert len(bins) < 0.97 * len(completion.best_fit(counts))
    for found in (completion.least_waste(counts), completion.in_pairs(counts)):
        assert sorted(s for b in found for s in b) == sorted(sizes) and all(sum(b) <= 2048 for b in found)


def test_lower_bounds_hold():
    rng = random.Random(31)
    above = 0
    for _ in range(300):
        capacity = rng.randrange(10, 200)
        sizes = [rng.randrange(max(1, capacity // 5), capacity + 1) for _ in range(rng.randrange(1, 10))]
        bound = packing.BinCompletion(capacity).lower_bound(dict(Counter(sizes)))
        fewest = brute.fewest_bins(sizes, capacity)
        assert -(-sum(sizes) // capacity) <= bound <= fewest
        above += bound > max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    assert above


def test_equal_rows_are_dealt_to_many_groups(spark):
    third = [(None, "the same short text"), (7, "another text, again and again")]
    rows = third * 400 + [(i, f"text number {i}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = packing.pack(frame, queries.PACKING_TOKENIZER, docs_per_group=100).collect()
    places(packed)
    by_group = Counter(r["sequence_id"] >> 32 for r in packed)
    assert len(packed) == len(rows) and max(by_group.values()) < 250
