"""Operator 5: exact substring deduplication with Rabin-Karp window hashes.

Every window of ``window`` words of every text is hashed inside the tasks that read the
texts.  A run of documents keeps, of windows equal within it, the first; those go to hash
buckets as packed arrays, so a passage that a third of all documents share sends one entry
per run.  A bucket finds the first occurrence of each window; all others are repeats.  Their
starts go back to the documents, where covered words merge into maximal intervals.

A window's identity is 64 bits of one hash and the bucket number taken from a second,
independent one, so the bits compared grow with the number of buckets, that is with the data.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import id_and_text

WINDOW = 20
WINDOWS_PER_BUCKET = 2_000_000
RUN_BYTES = 4 << 20
BYTES_PER_DOC_GROUP = 8 << 20
#: A window's bytes are at least these on average; only sizes the buckets.
_BYTES_PER_WORD = 6
_NONE = -(1 << 63)  # order key of a null id: before all others

_first_powers = wordhash.Powers(0xD6E8FEB86659FD93, 1 << 20)
_second_powers = wordhash.Powers(0xA0761D6478BD642F, 1 << 20)


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes that hold the largest; first byte: the width."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k, most in (("<u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32), ("<u8", 1 << 64)) if top < most)
    return kind[2].encode() + values.astype(kind).tobytes()


def _blob(parts: list[bytes]) -> bytes:
    """Length-prefixed parts; all but the first, which holds hashes, are compressed."""
    packed = zstandard.ZstdCompressor(level=1).compress(b"".join(struct.pack("<I", len(p)) + p for p in parts[1:]))
    return struct.pack("<I", len(parts[0])) + parts[0] + packed


def _parts(blob: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", blob)[0]
    out, rest, at = [blob[4 : 4 + n]], zstandard.ZstdDecompressor().decompress(blob[4 + n :]), 0
    while at < len(rest):
        size = struct.unpack_from("<I", rest, at)[0]
        out.append(rest[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def _wide(part: bytes) -> np.ndarray:
    return np.frombuffer(part[1:], "<u" + part[:1].decode()).astype(np.uint64)


def _pack_entries(
    hashes: np.ndarray, ids: np.ndarray, marks: np.ndarray, docs: np.ndarray, starts: np.ndarray
) -> bytes:
    """Entries sorted by document and start.  ``ids`` and ``marks`` are per document, ascending."""
    present, count = np.unique(docs, return_counts=True)
    own = ids[present]
    steps = np.diff(own.view(np.uint64), prepend=own[:1].view(np.uint64))
    gaps = np.diff(starts, prepend=0)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    gaps[first] = starts[first]
    own_marks = marks[present] if marks.any() else np.empty(0, np.int64)
    numbers = [own[:1].tobytes(), _narrow(steps), own_marks.tobytes(), _narrow(count), _narrow(gaps)]
    return _blob([hashes.tobytes(), *numbers])


def _unpack_entries(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, and per entry the document's id and mark, and the start."""
    hashes, base, steps, marks, count, gaps = _parts(blob)
    steps, count, gaps = _wide(steps), _wide(count).astype(np.int64), _wide(gaps).astype(np.int64)
    ids = (np.frombuffer(base, np.uint64) + np.cumsum(steps, dtype=np.uint64)).view(np.int64)
    own_marks = np.frombuffer(marks, np.int64) if marks else np.zeros(len(ids), np.int64)
    total = np.cumsum(gaps)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    starts = total - np.repeat(total[first] - gaps[first], count)
    return np.frombuffer(hashes, np.uint64), np.repeat(ids, count), np.repeat(own_marks, count), starts


def _group_of(ids: np.ndarray, marks: np.ndarray, groups: int) -> np.ndarray:
    """The group of a document, by id and mark: the documents of one id, or of none, go to many groups."""
    mixed = wordhash.mix(ids.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) + marks.view(np.uint64)
    return (wordhash.mix(mixed) % np.uint64(groups)).astype(np.int64)


def _repeat_rows(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """(document group, packed starts) of repeated windows."""
    if not len(ids):
        return
    group = _group_of(ids, marks, groups)
    order = np.lexsort((starts, marks, ids, group))
    ids, marks, starts, group = ids[order], marks[order], starts[order], group[order]
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    for a, b in zip(cuts, cuts[1:]):
        new = np.ones(b - a, bool)
        new[1:] = (ids[a + 1 : b] != ids[a : b - 1]) | (marks[a + 1 : b] != marks[a : b - 1])
        at = np.flatnonzero(new)
        docs = np.cumsum(new) - 1
        yield int(group[a]), _pack_entries(np.empty(0, np.uint64), ids[a:b][at], marks[a:b][at], docs, starts[a:b])


_ROUTED = pa.schema([("bucket", pa.int64()), ("doc_group", pa.int64()), ("packed", pa.binary())])


def _routed(buckets: list, groups: list, blobs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int64()), pa.array(groups, pa.int64()), pa.array(blobs, pa.binary())], schema=_ROUTED
    )


def _windows(window: int, buckets: int, groups: int) -> Callable:
    """Texts to packed window entries by bucket, and repeats found within a run."""

    def run(texts: list[bytes], ids: list[int], marks: list[int]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((np.array(marks, np.int64), np.array(ids, np.int64)))
        ids_a, marks_a = np.array(ids, np.int64)[order], np.array(marks, np.int64)[order]
        whole_run = wordhash.Run([texts[i] for i in order])
        words, doc = whole_run.words, whole_run.doc_of_word()
        if len(words) < window:
            return
        n = len(words) - window + 1
        whole = np.flatnonzero(doc[:n] == doc[window - 1 :])
        hashes = wordhash.hash_windows(words, window, _first_powers)[whole]
        second = wordhash.hash_windows(words, window, _second_powers)[whole]
        doc = doc[whole]
        start = whole - whole_run.first_word[doc]
        del whole_run, words, whole
        # rows with one id and one mark are the same document, and equal
        same_doc = np.zeros(len(ids_a), bool)
        same_doc[1:] = (ids_a[1:] == ids_a[:-1]) & (marks_a[1:] == marks_a[:-1])
        if same_doc.any():
            kept = ~same_doc[doc]
            hashes, second, doc, start = hashes[kept], second[kept], doc[kept], start[kept]
        by_hash = np.argsort(hashes, kind="stable")
        h, s = hashes[by_hash], second[by_hash]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
        repeated = np.zeros(len(h), bool)
        repeated[by_hash] = again
        del h, s, by_hash, again
        rows = list(_repeat_rows(ids_a[doc[repeated]], marks_a[doc[repeated]], start[repeated], groups))
        if rows:
            yield _routed([r[0] % buckets for r in rows], [r[0] for r in rows], [r[1] for r in rows])
        keep = ~repeated
        bucket = (second[keep] % np.uint64(buckets)).astype(np.int64)
        hashes, doc, start = hashes[keep], doc[keep], start[keep]
        by_bucket = np.argsort(bucket, kind="stable")
        bucket, hashes, doc, start = bucket[by_bucket], hashes[by_bucket], doc[by_bucket], start[by_bucket]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        out_b, out_p, held = [], [], 0
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            out_b.append(int(bucket[a]))
            out_p.append(_pack_entries(hashes[a:b], ids_a, marks_a, doc[a:b], start[a:b]))
            held += len(out_p[-1])
            if held > RUN_BYTES:
                yield _routed(out_b, [None] * len(out_b), out_p)
                out_b, out_p, held = [], [], 0
        if out_b:
            yield _routed(out_b, [None] * len(out_b), out_p)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, marks, held = [], [], [], 0
        for batch in batches:
            column = batch.column("text")
            for i, (key, mark) in enumerate(zip(batch.column("doc_key").to_pylist(), batch.column("mark").to_pylist())):
                text = column[i].as_py()
                if not text:
                    continue
                texts.append(text.encode())
                ids.append(key)
                marks.append(mark)
                held += len(texts[-1])
                if held >= RUN_BYTES:
                    yield from run(texts, ids, marks)
                    texts, ids, marks, held = [], [], [], 0
        if texts:
            yield from run(texts, ids, marks)

    return read


def _repeats_of_bucket(groups: int) -> Callable:
    """Of each window of a bucket, every occurrence but the first."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out_g, out_p, entries = [], [], []
        for group, blob in zip(rows.column("doc_group").to_pylist(), rows.column("packed")):
            if group is None:
                entries.append(_unpack_entries(blob.as_py()))
            else:
                out_g.append(group)
                out_p.append(blob.as_py())
        if entries:
            hashes = np.concatenate([e[0] for e in entries])
            order = np.argsort(hashes, kind="stable")
            h = hashes[order]
            equal = h[1:] == h[:-1]
            among = np.zeros(len(h), bool)  # in a group of two or more
            among[1:] |= equal
            among[:-1] |= equal
            order = order[among]
            h = h[among]
            ids = np.concatenate([e[1] for e in entries])[order]
            marks = np.concatenate([e[2] for e in entries])[order]
            starts = np.concatenate([e[3] for e in entries])[order]
            entries.clear()
            by = np.lexsort((starts, marks, ids, h))
            h, ids, marks, starts = h[by], ids[by], marks[by], starts[by]
            # a row repeated whole is the same document, not a later one
            new = np.ones(len(h), bool)
            same = (h[1:] == h[:-1]) & (ids[1:] == ids[:-1]) & (marks[1:] == marks[:-1]) & (starts[1:] == starts[:-1])
            new[1:] = ~same
            h, ids, marks, starts = h[new], ids[new], marks[new], starts[new]
            later = np.zeros(len(h), bool)
            later[1:] = h[1:] == h[:-1]
            for g, blob in _repeat_rows(ids[later], marks[later], starts[later], groups):
                out_g.append(g)
                out_p.append(blob)
        return pa.table([pa.array(out_g, pa.int64()), pa.array(out_p, pa.binary())], names=["doc_group", "packed"])

    return run


def intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) of words covered by windows at sorted ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    edges = [0, *cut.tolist(), len(starts)]
    return [(int(starts[a]), int(starts[b - 1]) + window) for a, b in zip(edges, edges[1:])]


_PRESSED = ["doc_id", "doc_key", "mark", "pressed"]
#: Copies of a row made by one task at a time.
_COPIES = 1 << 14


def _one_of_each(pressed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are equal in id and text as one row, and how many there are of each that has copies.

    Copies are combined in every task before the exchange, so they never meet in one group.
    """
    group = ["doc_group", "doc_key", "mark"]
    firsts = [F.first(c).alias(c) for c in ("doc_id", "pressed")]
    single = pressed.groupBy(*group).agg(*firsts).select("doc_group", *_PRESSED)
    counts = pressed.groupBy("doc_key", "mark").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return single, counts.withColumnsRenamed({"doc_key": "copied_key", "mark": "copied_mark"})


def _with_copies(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of ``found`` as often as their document stands in the table."""
    same = (F.col("doc_key") == F.col("copied_key")) & (F.col("mark") == F.col("copied_mark"))
    blocks = F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1, F.lit(_COPIES).cast("long"))
    parts = found.join(counts, same, "left").withColumn("copy", F.explode(blocks)).repartition("doc_key", "copy")
    own = F.least(F.coalesce("copies", F.lit(1)) - F.col("copy"), F.lit(_COPIES))
    return parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), own)))


def _press(groups: int) -> Callable:
    """Texts compressed for the exchange, with their document group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = (x.as_py() for x in batch.column("text"))
            small = [None if t is None else press.compress(t.encode()) for t in texts]
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_key", "mark"))
            group = _group_of(ids, marks, groups)
            kept = map(batch.column, ("doc_id", "doc_key", "mark"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group), *kept, pa.array(small, pa.binary())], names=["doc_group", *_PRESSED]
            )

    return run


def _cut(window: int) -> Callable:
    """Documents without the words that repeated windows cover."""

    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for blob in repeats.column("packed"):
            _, ids, marks, starts = _unpack_entries(blob.as_py())
            edge = np.flatnonzero((np.diff(ids) != 0) | (np.diff(marks) != 0)) + 1
            cuts = [0, *edge.tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    found.setdefault((int(ids[a]), int(marks[a])), []).append(starts[a:b])
        open_ = zstandard.ZstdDecompressor()
        n_words, n_removed, kept_text, spans = [], [], [], []
        keys = zip(docs.column("doc_key").to_pylist(), docs.column("mark").to_pylist(), docs.column("pressed"))
        for key, mark, pressed in keys:
            pressed = pressed.as_py()
            words = open_.decompress(pressed).split() if pressed else []
            own = found.get((key, mark))
            cover = intervals(np.unique(np.concatenate(own)), window) if own else []
            kept, at = [], 0
            for a, b in cover:
                kept.extend(words[at:a])
                at = b
            kept.extend(words[at:])
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            kept_text.append(b" ".join(kept).decode())
            spans.append([{"from": a, "to": b} for a, b in cover])
        return pa.table(
            [
                *[docs.column(c) for c in ("doc_id", "doc_key", "mark")],
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(kept_text, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
            ],
            names=["doc_id", "doc_key", "mark", "n_words", "n_removed", "kept_text", "removed"],
        )

    return run


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    windows_per_bucket: int = WINDOWS_PER_BUCKET,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, removed.

    A word is removed if a window over it has a word sequence that also starts earlier: in a
    document of smaller id, or earlier in the same one.  ``removed`` lists maximal intervals
    [from, to) of words.  Null and empty texts have no words.  A null id comes before all
    others.  Rows with one id and different texts are documents of their own, ordered by a
    hash of the text; rows with one id and one text are the same document and get the same
    result.  Empty table: no rows.  Other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType
    if not isinstance(id_type, T.IntegralType):
        raise TypeError("remove_repeats orders documents by an integer id")
    copies = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    mark = F.xxhash64("text") if copies else F.lit(0).cast("long")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // (_BYTES_PER_WORD * windows_per_bucket)))
    groups = max(1, -(-total // BYTES_PER_DOC_GROUP))
    keyed = rows.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_key"), mark.alias("mark"), "text"
    )
    routed = keyed.select("doc_key", "mark", "text").mapInArrow(
        _windows(window, buckets, groups), "bucket long, doc_group long, packed binary"
    )
    repeats = routed.groupBy("bucket").applyInArrow(_repeats_of_bucket(groups), "doc_group long, packed binary")
    pressed = keyed.mapInArrow(
        _press(groups),
        T.StructType(
            [
                T.StructField("doc_group", T.LongType()),
                *[f for f in keyed.schema.fields if f.name != "text"],
                T.StructField("pressed", T.BinaryType()),
            ]
        ),
    )
    interval = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    out = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("doc_key", T.LongType()),
            T.StructField("mark", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
            T.StructField("removed", T.ArrayType(interval)),
        ]
    )
    counts = None
    if copies:
        pressed, counts = _one_of_each(pressed)
    found = pressed.groupBy("doc_group").cogroup(repeats.groupBy("doc_group")).applyInArrow(_cut(window), out)
    if counts is not None:
        found = _with_copies(found, counts)
    return found.select("doc_id", "n_words", "n_removed", "kept_text", "removed")
