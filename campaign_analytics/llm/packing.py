"""Operator 7: best-fit packing by bin completion.

Texts become token ids inside Arrow functions; only lengths and checksums leave them.  A
document of more than ``capacity`` ids is cut so that its first piece is the remainder and
all others are full.  Full pieces fill a sequence alone.  The remainders, one per document
at most, are dealt into groups of about ``docs_per_group`` by hash, and each group is packed
by branch and bound, so the work per task is bounded whatever the input.  Packing groups
apart costs at most part of one sequence per group.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import id_and_text, materialise, text_slices

CAPACITY = 2048
DOCS_PER_GROUP = 8192
SEARCH_NODES_PER_BIN = 8
MORE_SEARCH_NODES = 1000
#: Thresholds tried by ``BinCompletion.in_pairs``.
PAIR_THRESHOLDS = 12
#: Pairs that are tried before all other fillings.
_FIRST_PAIRS = 4
#: Sizes of a filling, the largest, among which exchanges of two or three are looked for.
_EXCHANGED = 6
RUN_BYTES = 2 << 20


_NO_MORE = object()


class BinCompletion:
    """Fewest bins for a multiset of sizes, by bin completion.

    Each step takes the largest size left and enumerates the undominated fillings of the rest of
    its bin: a few pairs, a triple and the best single size first, from the least waste on, then
    all others to which no size can be added, one at a time as the search asks for them.  A
    filling is dominated, and left out, if some of its sizes together fit into the place of one
    size that is left, and that one into theirs and the free space: whatever is packed with the
    filling can be packed with the exchange.  A branch is cut when its waste exceeds what a
    solution of one bin less than the incumbent may waste.  Best-fit decreasing gives the
    first incumbent, and where it is far from the bound :meth:`in_pairs`; the search ends at the lower bound (:meth:`lower_bound`) or after
    ``nodes`` fillings and dead ends.
    """

    def __init__(self, capacity: int, branches: int | None = None):
        """``branches``: the most fillings of one bin that are tried; all if not given."""
        self.capacity = capacity
        self.branches = branches

    def best_fit(self, counts: dict[int, int]) -> list[list[int]]:
        """Best-fit decreasing; open bins are kept by their free space."""
        free: dict[int, list[list[int]]] = {}
        spaces = 0  # bit s is set if a bin with s free is open
        bins: list[list[int]] = []
        for size in sorted(counts, reverse=True):
            for _ in range(counts[size]):
                fitting = spaces >> size
                if fitting:
                    room = size + (fitting & -fitting).bit_length() - 1
                    chosen = free[room].pop()
                    if not free[room]:
                        spaces &= ~(1 << room)
                else:
                    room, chosen = self.capacity, []
                    bins.append(chosen)
                chosen.append(size)
                left = room - size
                if left:
                    free.setdefault(left, []).append(chosen)
                    spaces |= 1 << left
        return bins

    def least_waste(self, counts: dict[int, int]) -> list[list[int]]:
        """Each bin the largest size left and its filling of least waste, without going back."""
        counts = dict(counts)
        present = sum(1 << s for s, n in counts.items() if n)
        mirrored = sum(1 << (self.capacity - s) for s, n in counts.items() if n)
        bins = []

        def take(s: int) -> None:
            nonlocal present, mirrored
            counts[s] -= 1
            if not counts[s]:
                present &= ~(1 << s)
                mirrored &= ~(1 << (self.capacity - s))

        while present:
            largest = present.bit_length() - 1
            take(largest)
            filling = self._first_fillings(counts, present, mirrored, self.capacity - largest)[0]
            for s in filling:
                take(s)
            bins.append([largest, *filling])
        return bins

    def in_pairs(self, counts: dict[int, int]) -> list[list[int]]:
        """The best of some packings that put the sizes between a threshold and a half into pairs.

        Where many sizes are just below a half, a pair of them wastes little, and small sizes
        spent on exact fillings of large ones are missed later.  Thresholds go in steps from a third.
        """
        low, high = self.capacity // 3, self.capacity // 2
        best: list[list[int]] = []
        for threshold in range(low, high, max(1, (high - low) // PAIR_THRESHOLDS)):
            middle = [s for s in sorted(counts, reverse=True) if threshold < s <= high for _ in range(counts[s])]
            pairs = [middle[i : i + 2] for i in range(0, len(middle) - 1, 2)]
            rest = dict(counts)
            for s in itertools.chain.from_iterable(pairs):
                rest[s] -= 1
            rest = {s: n for s, n in rest.items() if n}
            found = pairs + min(self.best_fit(rest), self.least_waste(rest), key=len)
            if not best or len(found) < len(best):
                best = found
        return best

    def _pair(self, present: int, mirrored: int, counts: dict[int, int], total: int) -> tuple[int, int] | None:
        """The pair of sizes summing to ``total`` with the largest larger size."""
        shift = self.capacity - total
        both = present & (mirrored >> shift if shift >= 0 else mirrored << -shift)
        while both:
            a = both.bit_length() - 1
            b = total - a
            if b > a:
                return None
            if a != b or counts[a] > 1:
                return a, b
            both &= ~(1 << a)
        return None

    def fillings(
        self, counts: dict[int, int], present: int, mirrored: int, room: int
    ) -> Iterator[tuple[int, ...] | None]:
        """Fillings of ``room`` that nothing can be added to; ``()`` if nothing fits, None for a dead end.

        ``counts`` must be as at the start whenever the next one is asked for.
        """
        first = self._first_fillings(counts, present, mirrored, room)
        for filling in first:
            yield None if self._is_dominated(counts, present, room, filling) else filling
        if first == [()] or sum(first[0]) == room == first[0][0]:
            return
        known = set(first)
        below = present & ((1 << (room + 1)) - 1)
        sizes = []
        while below:
            a = below.bit_length() - 1
            sizes.append(a)
            below &= ~(1 << a)
        for filling in self._maximal(sizes, [counts[a] for a in sizes], room):
            if filling is None or filling not in known:
                dominated = filling is not None and self._is_dominated(counts, present, room, filling)
                yield None if dominated else filling

    @staticmethod
    def _is_dominated(counts: dict[int, int], present: int, room: int, filling: tuple[int, ...]) -> bool:
        """Whether one, two or three of the filling's sizes can be exchanged for a size that is left.

        The size is at least their sum, and more than a single one; it fits with the rest.
        """
        free = room - sum(filling)
        if not filling or free < 0:
            return False
        held: dict[int, int] = {}
        for s in filling:
            held[s] = held.get(s, 0) + 1
        left = present
        for s, n in held.items():
            if counts[s] <= n:
                left &= ~(1 << s)
        if free:
            for s in held:
                if left >> (s + 1) & ((1 << free) - 1):
                    return True
        few = filling[:_EXCHANGED]
        for n in (2, 3):
            for some in itertools.combinations(few, n):
                if left >> sum(some) & ((1 << (free + 1)) - 1):
                    return True
        return False

    def lower_bound(self, counts: dict[int, int]) -> int:
        """No packing has fewer bins: the total size, and Martello and Toth's second bound.

        For each threshold t of at most half a bin, sizes above ``capacity - t`` and others above
        a half fill bins of their own; sizes from t on must fit into what these leave, or need more.
        """
        sizes = sorted(counts)
        total = sum(s * n for s, n in counts.items())
        best = -(-total // self.capacity)
        halves = [s for s in sizes if 2 * s > self.capacity]
        over = sum(counts[s] for s in halves)
        best = max(best, over)
        for t in (s for s in sizes if 2 * s <= self.capacity):
            middle = [s for s in halves if s <= self.capacity - t]
            space = sum((self.capacity - s) * counts[s] for s in middle)
            small = sum(s * counts[s] for s in sizes if t <= s and 2 * s <= self.capacity)
            best = max(best, over + max(0, -(-(small - space) // self.capacity)))
        return best

    @staticmethod
    def _maximal(sizes: list[int], numbers: list[int], room: int) -> Iterator[tuple[int, ...] | None]:
        """All fillings of ``room`` by sizes, largest first, to which none can be added; None for a dead end."""
        rest = [0] * (len(sizes) + 1)
        for j in range(len(sizes) - 1, -1, -1):
            rest[j] = rest[j + 1] + sizes[j] * numbers[j]
        chosen: list[int] = []

        def further(i: int, room: int, left_out: int) -> Iterator[tuple[int, ...] | None]:
            for j in range(bisect.bisect_left(sizes, -room, i, key=lambda x: -x), len(sizes)):
                if room - rest[j] >= left_out:  # all that is left cannot keep a size left out from fitting
                    yield None
                    return
                size = sizes[j]
                for k in range(min(numbers[j], room // size), 0, -1):
                    chosen.extend([size] * k)
                    yield from further(j + 1, room - k * size, left_out if k == numbers[j] else min(left_out, size))
                    del chosen[-k:]
                left_out = min(left_out, size)
            yield tuple(chosen) if room < left_out else None

        return further(0, room, room + 1)

    def _first_fillings(self, counts: dict[int, int], present: int, mirrored: int, room: int) -> list[tuple[int, ...]]:
        """Some good fillings of ``room``, the least waste first; ``[()]`` if nothing fits."""
        below = present & ((1 << (room + 1)) - 1)
        if not below:
            return [()]
        single = below.bit_length() - 1
        if single == room:
            return [(single,)]  # fills the bin: it dominates every other filling
        found: list[tuple[int, ...]] = []
        smallest = (below & -below).bit_length() - 1
        for total in range(room, single, -1):
            if total < 2 * smallest:
                break
            pair = self._pair(below, mirrored, counts, total)
            if pair:
                found.append(pair)
                if len(found) >= _FIRST_PAIRS:
                    break
        if not found or sum(found[0]) < room:
            rest, tried = below, 0
            while rest and tried < 64:
                a = rest.bit_length() - 1
                rest &= ~(1 << a)
                tried += 1
                if room - a < 2 * smallest:
                    continue
                if counts[a] == 1:
                    pair = self._pair(below & ~(1 << a), mirrored & ~(1 << (self.capacity - a)), counts, room - a)
                else:
                    counts[a] -= 1
                    pair = self._pair(below, mirrored, counts, room - a)
                    counts[a] += 1
                if pair and pair[0] <= a:
                    found.append((a, *pair))
                    break
            else:
                a = single
        found.append((single,))
        full = []
        for f in found:
            full.append(tuple(sorted(self._topped(counts, below, room, f), reverse=True)))
        full.sort(key=sum, reverse=True)
        return list(dict.fromkeys(full))

    @staticmethod
    def _topped(counts: dict[int, int], below: int, room: int, filling: tuple[int, ...]) -> tuple[int, ...]:
        """``filling`` with further sizes, largest first, until none fits."""
        out, room = list(filling), room - sum(filling)
        while room > 0:
            fits = below & ((1 << (room + 1)) - 1)
            while fits:
                a = fits.bit_length() - 1
                if counts[a] > out.count(a):
                    break
                fits &= ~(1 << a)
            if not fits:
                break
            out.append(a)
            room -= a
        return tuple(out)

    def pack(self, sizes: list[int], nodes: int | None = None) -> list[list[int]]:
        """Bins of sizes.  ``nodes`` bounds the fillings tried (default: 8 per bin and 1000)."""
        counts: dict[int, int] = {}
        for s in sizes:
            counts[s] = counts.get(s, 0) + 1
        total = sum(sizes)
        incumbent = self.best_fit(counts)
        if len(incumbent) <= -(-total // self.capacity):
            return incumbent
        bound = self.lower_bound(counts)
        if len(incumbent) <= bound:
            return incumbent
        if len(incumbent) > bound + 1:  # the search below seldom saves more than one
            incumbent = min(incumbent, self.in_pairs(counts), key=len)
            if len(incumbent) <= bound:
                return incumbent
        budget = nodes if nodes is not None else SEARCH_NODES_PER_BIN * len(incumbent) + MORE_SEARCH_NODES
        present = mirrored = 0
        for s in counts:
            present |= 1 << s
            mirrored |= 1 << (self.capacity - s)

        def take(size: int) -> None:
            nonlocal present, mirrored
            counts[size] -= 1
            if not counts[size]:
                present &= ~(1 << size)
                mirrored &= ~(1 << (self.capacity - size))

        def give(size: int) -> None:
            nonlocal present, mirrored
            counts[size] += 1
            present |= 1 << size
            mirrored |= 1 << (self.capacity - size)

        chosen: list[list[int]] = []
        waste = 0
        stack: list[tuple[int, Iterator[tuple[int, ...] | None]]] = []

        def open_bin() -> None:
            largest = present.bit_length() - 1
            take(largest)
            options = self.fillings(counts, present, mirrored, self.capacity - largest)
            stack.append((largest, itertools.islice(options, self.branches)))

        open_bin()
        while stack:
            largest, options = stack[-1]
            if len(chosen) == len(stack):  # back from below: undo this bin's filling
                last = chosen.pop()
                waste -= self.capacity - sum(last)
                for s in last[1:]:
                    give(s)
            allowed = (len(incumbent) - 1) * self.capacity - total
            filling = next(options, _NO_MORE) if budget > 0 and waste <= allowed else _NO_MORE
            budget -= 1
            if filling is _NO_MORE:
                stack.pop()
                give(largest)
                continue
            if filling is None:
                continue
            lost = self.capacity - largest - sum(filling)
            if waste + lost > allowed:  # another may waste less
                continue
            for s in filling:
                take(s)
            chosen.append([largest, *filling])
            waste += lost
            if present:
                open_bin()
            else:  # every size is placed, in fewer bins than the incumbent has
                incumbent = [list(b) for b in chosen]
                if len(incumbent) <= bound:
                    break
        return incumbent


def _encode_documents(content: str, capacity: int, closing: int) -> Callable:
    end = closing.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = tokens.encoder(content), 0
        for batch in batches:
            lengths: list[int] = []
            sums: list[list[int]] = []
            for _, texts in text_slices(batch, "text", RUN_BYTES):
                for ids in encoder.encode([t or "" for t in texts]):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    view = memoryview(ids)
                    cuts = [0, *range(first, n + 1, capacity)]
                    sums.append([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])])
                    lengths.append(n)
            number = np.arange(seen, seen + len(lengths))
            seen += len(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.list_(pa.int64())),
                    pa.array(number, pa.int64()),
                ],
                names=["doc_id", "n_ids", "crcs", "number"],
            )

    return run


def _pack_group(capacity: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        group = key[0].as_py()
        lengths = rows.column("n_ids").to_numpy()
        first = (lengths - 1) % capacity + 1
        waiting: dict[int, list[int]] = {}
        for row, size in enumerate(first.tolist()):
            waiting.setdefault(size, []).append(row)
        bins = BinCompletion(capacity).pack(first.tolist())
        sequence, offset = [0] * len(first), [0] * len(first)
        for i, sizes in enumerate(bins):
            at = 0
            for s in sizes:
                row = waiting[s].pop()
                sequence[row], offset[row] = i, at
                at += s
        full = (lengths - first) // capacity
        base = group << 32
        # full pieces get the group's numbers after its packed sequences
        full_base = base + len(bins) + np.cumsum(full) - full
        added = [base + np.array(sequence, np.int64), np.array(offset, np.int64), full_base.astype(np.int64)]
        return pa.table(
            [*[rows.column(c) for c in ("doc_id", "n_ids", "crcs")], *[pa.array(x) for x in added]],
            names=["doc_id", "n_ids", "crcs", "first_sequence", "first_offset", "full_base"],
        )

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    closing: int = 0,
    docs_per_group: int = DOCS_PER_GROUP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then ``closing``.  Null and empty texts have the closing id
    alone.  Null or repeated ids: each row is a document of its own.  Empty table: no rows.
    Other columns are not read.  Sequence numbers are unique over all groups.

    Lengths and checksums are kept before they are dealt; equal rows go to different groups by
    their number within their task.
    """
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType
    coded = rows.mapInArrow(
        _encode_documents(tokens.tokenizer_json(tokenizer_path), capacity, closing),
        T.StructType(
            [
                T.StructField("doc_id", id_type),
                T.StructField("n_ids", T.LongType()),
                T.StructField("crcs", T.ArrayType(T.LongType())),
                T.StructField("number", T.LongType()),
            ]
        ),
    )
    coded = materialise(coded)
    groups = max(1, -(-coded.count() // docs_per_group))
    dealt = coded.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "n_ids", "crcs", "number"), F.lit(groups)))
    packed = dealt.groupBy("pack_group").applyInArrow(
        _pack_group(capacity),
        T.StructType(
            [
                T.StructField("doc_id", id_type),
                T.StructField("n_ids", T.LongType()),
                T.StructField("crcs", T.ArrayType(T.LongType())),
                T.StructField("first_sequence", T.LongType()),
                T.StructField("first_offset", T.LongType()),
                T.StructField("full_base", T.LongType()),
            ]
        ),
    )
    first = (F.col("n_ids") - 1) % capacity + 1
    pieces = packed.select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    head = F.col("piece") == 0
    return pieces.select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        F.when(head, F.lit(0)).otherwise(first + (F.col("piece") - 1) * capacity).cast("long").alias("start"),
        F.when(head, first).otherwise(F.lit(capacity)).cast("long").alias("length"),
        "ids_crc32",
        F.when(head, F.col("first_sequence")).otherwise(F.col("full_base") + F.col("piece") - 1).alias("sequence_id"),
        F.when(head, F.col("first_offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )
