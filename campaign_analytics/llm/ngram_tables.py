"""A modified Kneser-Ney model of code points, in sorted hash arrays spread over buckets.

An n-gram's hash is the bits of its code points, 21 each, in two 64-bit numbers: no two n-grams
share one, and its first and last code points can be taken off.  A bucket holds the n-grams of
one order whose first code points (all but the last) fall into it, as sorted packed arrays in
one row, so that all n-grams after one context are together.

Counts go down: runs of texts send their n-grams to the buckets of the highest order, and each
order sends the n-grams' ends to the next lower one, which counts how many different code points
stand before.  Probabilities go back up the same ways: a bucket answers each sender with the
values of what it was sent, in that order.  Nothing passes through the driver but six sums per
order.  A sender has at most one row per bucket, so rows are never more than n-grams sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash

#: Code points of an n-gram of the model.
GRAM = 5
#: N-grams that meet in one bucket, about.
BUCKET_GRAMS = 1 << 19
_PIECE = 1 << 20
_SIZE = 21  # bits of a code point
_U = np.uint64
_ONE = (1 << _SIZE) - 1
_FACTOR = _U(0x9E3779B97F4A7C15)

Keys = tuple[np.ndarray, np.ndarray]  # code points but the last three, and the last three


# --- n-grams and their parts -------------------------------------------------------------


def without_first(keys: Keys, n: int) -> Keys:
    """N-grams of n code points without the first one."""
    high, low = keys
    if n > 3:
        return high & _U((1 << _SIZE * (n - 4)) - 1), low
    return high, low & _U((1 << _SIZE * (n - 1)) - 1)


def without_last(keys: Keys) -> Keys:
    high, low = keys
    return high >> _U(_SIZE), (low >> _U(_SIZE)) | ((high & _U(_ONE)) << _U(2 * _SIZE))


def buckets_of(keys: Keys, bits: int) -> np.ndarray:
    """The bucket of each n-gram, by the hash of all its code points but the last."""
    if not bits:
        return np.zeros(len(keys[0]), np.int64)
    high, low = without_last(keys)
    return (wordhash.mix(wordhash.mix(high + _FACTOR) + low) >> _U(64 - bits)).astype(np.int64)


def bucket_bits(grams: int) -> int:
    return max(0, int(grams // BUCKET_GRAMS).bit_length())


def _same_as_before(keys: Keys) -> np.ndarray:
    same = np.zeros(len(keys[0]), bool)
    same[1:] = (keys[0][1:] == keys[0][:-1]) & (keys[1][1:] == keys[1][:-1])
    return same


def gram_pieces(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, Keys]]:
    """Places, hashes and n-grams within one line, of some code points at a time."""
    for a in range(0, len(codes) - GRAM + 1, _PIECE):
        piece = codes[a : a + _PIECE + GRAM - 1].astype(np.uint64)
        n = len(piece) - GRAM + 1
        high, low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        inside = np.ones(n, bool)
        line = piece == 10
        for k in range(GRAM):
            part = high if k < GRAM - 3 else low
            part <<= _U(_SIZE)
            part |= piece[k : n + k]
            inside &= ~line[k : n + k]
        places = np.flatnonzero(inside)
        high, low = high[places], low[places]
        yield a + places, gram_hashes((high, low)), (high, low)


def gram_hashes(keys: Keys) -> np.ndarray:
    """One 64-bit hash per n-gram, to find it within a run."""
    return wordhash.mix(keys[0] * _FACTOR + keys[1])


class GramIndex:
    """Numbers of hashes: most by a table of their first bits, the others by search."""

    BITS = 21

    def __init__(self, hashes: np.ndarray | None = None):
        self.hashes = np.empty(0, np.uint64)
        self._slots = np.zeros(1 << self.BITS, np.int32)
        if hashes is not None:
            self.add(hashes)

    def add(self, hashes: np.ndarray) -> None:
        """Further hashes, none held so far, get the next numbers."""
        first = len(self.hashes)
        self.hashes = np.concatenate((self.hashes, hashes))
        self._slots[self._slot(hashes)] = np.arange(first, len(self.hashes), dtype=np.int32)
        self._order = np.argsort(self.hashes)
        self._sorted = self.hashes[self._order]

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> _U(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        out = self._slots[self._slot(hashes)].astype(np.int64)
        rest = np.flatnonzero(self.hashes[out] != hashes)
        at = np.minimum(np.searchsorted(self._sorted, hashes[rest]), len(self.hashes) - 1)
        out[rest] = np.where(self._sorted[at] == hashes[rest], self._order[at], -1)
        return out


class Grams:
    """The different n-grams of a run of texts, their counts, and which stand in several texts."""

    def __init__(self) -> None:
        self.index, self.counts = GramIndex(), np.empty(0, np.int64)
        self.high, self.low = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.first, self.several, self.n_texts = np.empty(0, np.int64), np.empty(0, bool), 0

    def add(self, codes: np.ndarray) -> None:
        """Texts as code points, parted by line feeds."""
        owners = self.n_texts + np.cumsum(codes == 10)
        self.n_texts = int(owners[-1]) + 1 if len(codes) else self.n_texts + 1
        for places, hashes, (high, low) in gram_pieces(codes):
            found, owner = self.index.find(hashes), owners[places]
            unknown = np.flatnonzero(found < 0)
            if len(unknown):
                new, first, number = np.unique(hashes[unknown], return_index=True, return_inverse=True)
                found[unknown] = len(self.counts) + number
                at = unknown[first]
                self.index.add(new)
                self.high, self.low = np.concatenate((self.high, high[at])), np.concatenate((self.low, low[at]))
                self.counts = np.concatenate((self.counts, np.zeros(len(new), np.int64)))
                self.first = np.concatenate((self.first, owner[at]))
                self.several = np.concatenate((self.several, np.zeros(len(new), bool)))
            self.counts += np.bincount(found, minlength=len(self.counts))
            self.several[found[owner != self.first[found]]] = True

    def packed(self) -> tuple[bytes, bytes]:
        """The n-grams in order, and their counts doubled, plus one for those of several texts."""
        order = np.lexsort((self.low, self.high))
        values = 2 * self.counts + self.several
        return pack_keys((self.high[order], self.low[order])), pack(values[order])


# --- packed arrays -----------------------------------------------------------------------

_CODEC = pa.Codec("zstd", 3)


def pack(values: np.ndarray) -> bytes:
    """Numbers of 8 bytes, byte by byte, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), 8).T)
    return len(values).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes, kind: type = np.int64) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(_CODEC.decompress(blob[8:], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_keys(keys: Keys) -> bytes:
    """N-grams in order, as differences."""
    high, low = keys
    step_high = np.diff(high, prepend=_U(0))
    step_low = np.where(step_high == 0, np.diff(low, prepend=_U(0)), low)
    return pack(np.concatenate((step_high, step_low)))


def unpack_keys(blob: bytes) -> Keys:
    step_high, step_low = np.split(unpack(blob, np.uint64), 2)
    starts = step_high != 0
    starts[:1] = True
    at = np.flatnonzero(starts)
    upto = np.cumsum(step_low, dtype=np.uint64)
    base = np.repeat(upto[at] - step_low[at], np.diff(np.append(at, len(upto))))
    return np.cumsum(step_high, dtype=np.uint64), upto - base


# --- from senders to buckets -------------------------------------------------------------

SENT = "bucket long, sender long, keys binary, counts binary"
_TABLE = "bucket long, keys binary, counts binary, several binary, senders binary, sizes binary, places binary"
FIGURES = ["ones", "twos", "threes", "fours", "total", "types"]
TABLE = ", ".join([_TABLE, *[f"{f} long" for f in FIGURES]])
ANSWER = "sender long, bucket long, values binary"


def by_bucket(keys: Keys, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ordered n-grams by bucket: their order, the buckets that occur, and where each one's begin and end."""
    bucket = buckets_of(keys, bits)
    order = np.argsort(bucket, kind="stable")
    numbers, first = np.unique(bucket[order], return_index=True)
    return order, numbers, np.append(first, len(order))


def sent_rows(sender: int, keys: Keys, values: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A sender's ordered n-grams with their values, one row for each bucket."""
    order, numbers, edges = by_bucket(keys, bits)
    for number, a, b in zip(numbers.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
        own = order[a:b]
        row = [number, sender, pack_keys((keys[0][own], keys[1][own])), pack(values[own])]
        yield pa.RecordBatch.from_pydict(dict(zip(("bucket", "sender", "keys", "counts"), [[v] for v in row])))


def send_runs(bits: int) -> Callable:
    """From rows of (run, grams, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, grams, counts in zip(*[batch.column(c).to_pylist() for c in ("run", "grams", "counts")]):
                yield from sent_rows(number, unpack_keys(grams), unpack(counts), bits)

    return run


def _ends(keys: Keys, n: int) -> tuple[Keys, np.ndarray, np.ndarray]:
    """The different ends (all code points but the first) of n-grams, in order; which one each has; how many have each."""
    high, low = without_first(keys, n)
    order = np.lexsort((low, high))
    ends = high[order], low[order]
    new = ~_same_as_before(ends)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return (ends[0][new], ends[1][new]), which, np.bincount(which, minlength=int(new.sum()))


def _send_ends(n: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist()):
                ends, _, counts = _ends(unpack_keys(blob), n)
                yield from sent_rows(bucket, ends, counts, bits)

    return run


def _merge(n: int) -> Callable:
    """A bucket's n-grams over all senders, added up, and which of them each sender sent."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("sender")
        parts = [unpack_keys(b) for b in table.column("keys").to_pylist()]
        values = np.concatenate([unpack(b) for b in table.column("counts").to_pylist()])
        keys = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((keys[1], keys[0]))
        keys = keys[0][order], keys[1][order]
        new = ~_same_as_before(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        types = int(new.sum())
        if n == GRAM:  # counts of texts are doubled, with a mark for n-grams of several texts
            marked = np.bincount(place, weights=values & 1, minlength=types) > 0
            several = marked | (np.bincount(place, minlength=types) > 1)
            values = values >> 1
        else:
            several = np.ones(types, bool)
        counts = np.bincount(place, weights=values, minlength=types).astype(np.int64)  # exact below 2**53
        figures = [int((counts == i).sum()) for i in (1, 2, 3, 4)] + [int(counts.sum()), types]
        sizes = np.array([len(p[0]) for p in parts], np.int64)
        row = [table.column("bucket")[0].as_py(), pack_keys((keys[0][new], keys[1][new])), pack(counts)]
        row += [pack(several.astype(np.int64)), pack(table.column("sender").to_numpy().astype(np.int64)), pack(sizes)]
        row += [pack(np.diff(place, prepend=0)), *figures]
        names = ["bucket", "keys", "counts", "several", "senders", "sizes", "places", *FIGURES]
        return pa.table({name: [value] for name, value in zip(names, row)})

    return run


# --- probabilities -----------------------------------------------------------------------


def discounts(ones: int, twos: int, threes: int, fours: int) -> list[float]:
    """What is taken off counts of one, of two, and of more."""
    ones, twos, threes, fours = (max(x, 1) for x in (ones, twos, threes, fours))
    y = ones / (ones + 2 * twos)
    found = [1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes]
    return [float(np.clip(d, 0.05, most)) for d, most in zip(found, (0.95, 1.9, 2.85))]


def _probabilities(keys: Keys, counts: np.ndarray, several: np.ndarray, below: np.ndarray, off: list[float]) -> np.ndarray:
    """Of each n-gram's last code point after the others; ``below`` is that of the n-gram's end.

    An n-gram that only one text has is no evidence for that text: its probability is the one
    that the others give.
    """
    own = np.array([0.0, *off])[np.minimum(counts, 3)]
    new = ~_same_as_before(without_last(keys))
    context = np.cumsum(new) - 1
    total = np.bincount(context, weights=counts)[context]
    mass = np.zeros(len(counts))
    for i, d in enumerate(off, 1):  # whole numbers are summed, so that their order does not matter
        mass += d * np.bincount(context, weights=np.minimum(counts, 3) == i)[context]
    seen = ((counts - own) + mass * below) / total
    rest = np.maximum(total - counts, 1)
    unseen = np.where(total == counts, below, (mass - own) / rest * below)
    return np.where(several, seen, unseen)


def _answers(rows: pa.Table, values: np.ndarray, log: bool) -> pa.Table:
    """Each sender's values, in the order that it sent."""
    senders, sizes, places = (unpack(rows.column(c)[0].as_py()) for c in ("senders", "sizes", "places"))
    given = values[np.cumsum(places)]
    blobs = [
        np.log(part).astype("<f4").tobytes() if log else part.astype("<f8").tobytes()
        for part in np.split(given, np.cumsum(sizes)[:-1])
    ]
    bucket = rows.column("bucket")[0].as_py()
    return pa.table({"sender": pa.array(senders), "bucket": pa.array([bucket] * len(blobs), pa.int64()), "values": blobs})


def joined(answers: pa.Table, kind: str) -> np.ndarray:
    """A sender's answers one after the other, in order of its buckets."""
    return np.frombuffer(b"".join(answers.sort_by("bucket").column("values").to_pylist()), kind)


def _lowest(figures: dict[str, int]) -> Callable:
    """Single code points: discounted counts, and one share for each that occurs."""

    def run(table: pa.Table) -> pa.Table:
        counts = unpack(table.column("counts")[0].as_py())
        off = discounts(*[figures[f] for f in FIGURES[:4]])
        total, types = max(figures["total"], 1), max(figures["types"], 1)
        many = figures["types"] - figures["ones"] - figures["twos"]
        share = (off[0] * figures["ones"] + off[1] * figures["twos"] + off[2] * many) / total
        own = np.array([0.0, *off])[np.minimum(counts, 3)]
        return _answers(table, (counts - own) / total + share / types, log=False)

    return run


def _higher(n: int, bits: int, figures: dict[str, int]) -> Callable:
    """N-grams from the answers on their ends; ``bits`` is that of the order below."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys = unpack_keys(table.column("keys")[0].as_py())
        ends, which, _ = _ends(keys, n)
        order, _, _ = by_bucket(ends, bits)
        of_end = np.empty(len(order))
        of_end[order] = joined(answers, "<f8")
        counts, several = (unpack(table.column(c)[0].as_py()) for c in ("counts", "several"))
        off = discounts(*[figures[f] for f in FIGURES[:4]])
        return _answers(table, _probabilities(keys, counts, several > 0, of_end[which], off), log=n == GRAM)

    return run


def log_probabilities(runs: DataFrame, written: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, int]:
    """sender (the run), bucket, values: for each run the log-probabilities of its n-grams, and the
    bits of their buckets.

    ``runs`` has run, grams, counts (:meth:`Grams.packed`) and n_grams.  ``written`` writes a table
    under a name and gives it back.
    """
    bits = bucket_bits(runs.agg(F.sum("n_grams")).first()[0] or 0)
    top = bits
    sent = runs.select("run", "grams", "counts").mapInArrow(send_runs(bits), SENT)
    levels = []
    for n in range(GRAM, 0, -1):
        table = written(sent.groupBy("bucket").applyInArrow(_merge(n), TABLE), f"order{n}")
        figures = table.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in FIGURES]).first().asDict()
        levels.append((n, table, bits, figures))
        bits = bucket_bits(figures["types"])
        if n > 1:
            sent = table.select("bucket", "keys").mapInArrow(_send_ends(n, bits), SENT)
    answers, below = None, 0
    for n, table, bits, figures in reversed(levels):
        kept = table.drop(*FIGURES).groupBy("bucket")
        if answers is None:
            answers = kept.applyInArrow(_lowest(figures), ANSWER)
        else:
            answers = kept.cogroup(answers.groupBy("sender")).applyInArrow(_higher(n, below, figures), ANSWER)
        below = bits
    return answers, top
