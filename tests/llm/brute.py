"""Plain restatements of the operators' results, for small tables only."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

SMALL = "/root/testdata/sf0.001"

#: Null ids and texts, empty and very long texts, ties, repeated rows, and columns that clash
#: with the names operators use.
_LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ODD = [
    (1, "one two three four five six seven eight nine ten"),
    (2, "one two three four five six seven eight nine ten"),
    (2, "one two three four five six seven eight nine ten"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, _LONG),
    (7, _LONG + " end"),
    (None, "a row without an id, one two three four five six seven eight"),
    (None, None),
    (8, "non breaking   spaces \U0001f600 é é <|endoftext|> <|startoftext|>  two"),
]

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs, window):
    """docs: [(doc_id, text)], distinct ids -> {doc_id: (n_words, n_removed, sha256)}"""
    seen, removed = set(), {}
    for doc_id, text in sorted(docs):
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        removed[doc_id] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return removed


def simhash(text, k=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs, bits=2):
    """[(doc_id, text)] -> {doc_id: (hex, component)}"""
    prints = [(d, simhash(t)) for d, t in docs]
    parent = {d: d for d, _ in prints}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= bits:
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {d: (f"{x:016x}", find(d)) for d, x in prints}


def pack_pieces(ids_of, docs, capacity):
    """Pieces by document: [(piece, start, length, crc32)]"""
    out = {}
    for doc_id, text in docs:
        ids = [*ids_of(text or ""), 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        out[doc_id] = [
            (i, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b])))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]
    return out


def fewest_bins(sizes, capacity):
    """The least number of bins, by trying every place for each size."""
    best = len(sizes)

    def place(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= rest[0]:
                i = rooms.index(room)
                place(rest[1:], rooms[:i] + [room - rest[0]] + rooms[i + 1 :])
        place(rest[1:], [*rooms, capacity - rest[0]])

    place(sorted(sizes, reverse=True), [])
    return best if sizes else 0


def targets(sizes, weights=(5, 2, 1)):
    """{source: size} -> {source: target}: share by weight, stop at twice the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, active = 1.5 * sum(sizes.values()), {}, set(names)
    while active:
        share = left / sum(weight[s] for s in active)
        over = {s for s in active if share * weight[s] >= 2 * sizes[s]}
        if not over:
            out |= {s: share * weight[s] for s in active}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        active -= over
    return out
