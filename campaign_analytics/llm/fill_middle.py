"""Operator 13: fill-in-the-middle transformation with a learned rank index for the cuts.

A document is cut at two code point boundaries and its middle is moved to the end, behind
marks.  Texts stay UTF-8 bytes: the offsets of all code point boundaries of a run of texts
are indexed by piecewise-linear segments of bounded error, a cut's offset is predicted from
its rank, and the stored residual of that rank corrects it exactly.
Where to cut, and which form a document takes, follows from a hash of its id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text

# Fixed values of the contract: the marks before prefix, suffix and middle, and the forms.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"

SALT = "1"
#: Of 100 documents, how many are cut; of 100 cut ones, how many have the suffix first.
CUT_PERCENT = 90
SPM_PERCENT = 20
#: Bytes of text whose boundaries are indexed together (one text at least).
RUN_BYTES = 4 << 20


class RankIndex:
    """Offsets by rank: linear segments of bounded error, and the residual of every rank in a byte.

    A segment takes ranks while one slope through its first offset stays within ``error`` of
    all of them (the cone of such slopes is not empty); the next rank starts a new segment.
    """

    ERROR = 120  # with rounding below 127, so a residual fits a signed byte

    def __init__(self, offsets: np.ndarray):
        starts, slopes = [], []
        at, n = 0, len(offsets)
        while at < n:
            low, high, k, width = -np.inf, np.inf, 1, 256
            while at + k < n:
                steps = np.arange(k, min(k + width, n - at), dtype=np.float64)
                away = (offsets[at + k : at + k + len(steps)] - offsets[at]).astype(np.float64)
                lows = np.maximum(np.maximum.accumulate((away - self.ERROR) / steps), low)
                highs = np.minimum(np.minimum.accumulate((away + self.ERROR) / steps), high)
                shut = int(np.searchsorted(lows > highs, True))  # once shut, a cone stays shut
                if shut:
                    low, high = lows[shut - 1], highs[shut - 1]
                k += shut
                if shut < len(steps):
                    break
                width = min(2 * width, 1 << 16)
            starts.append(at)
            slopes.append((low + high) / 2 if k > 1 else 0.0)
            at += k
        self.starts, self.slopes = np.array(starts, np.int64), np.array(slopes)
        self.bases = offsets[self.starts] if n else np.empty(0, np.int64)
        # the segments' ranks in order, so no search is needed here
        segment = np.repeat(np.arange(len(starts)), np.diff(np.append(self.starts, n)))
        self.residuals = (offsets - self._predict(np.arange(n), segment)).astype(np.int8)

    def _predict(self, ranks: np.ndarray, segment: np.ndarray) -> np.ndarray:
        return self.bases[segment] + np.rint(self.slopes[segment] * (ranks - self.starts[segment])).astype(np.int64)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        return self._predict(ranks, np.searchsorted(self.starts, ranks, "right") - 1)

    def find(self, ranks: np.ndarray) -> np.ndarray:
        """The offsets of some ranks, exactly."""
        return self.predict(ranks) + self.residuals[ranks]


def boundaries(data: np.ndarray) -> np.ndarray:
    """Offsets at which a code point of UTF-8 bytes starts, and the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the rows' edges in them; a null row is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.empty(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


_RESULT = ["n", "prefix_chars", "middle_chars", "output"]


def _cut(column: pa.Array, forms: list[str], draws: list[np.ndarray], marks: tuple[str, str, str]) -> list[pa.Array]:
    data, edges = _utf8(column)
    offsets = boundaries(data)
    index = RankIndex(offsets)
    first = np.searchsorted(offsets, edges)
    n = np.diff(first)
    cuts = np.sort(np.stack([draw % (n + 1) for draw in draws]), axis=0)
    places = index.find(first[:-1] + cuts)
    plain = np.array([f == PLAIN for f in forms], bool)
    p, s, m = (mark.encode() for mark in marks)
    raw, out = data.tobytes(), []
    for form, a, b, c, d in zip(forms, edges[:-1].tolist(), *places.tolist(), edges[1:].tolist()):
        if form == PLAIN:
            out.append(raw[a:d])
        elif form == PSM:
            out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
        else:
            out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
    return [
        pa.array(n.astype(np.int64)),
        pa.array(cuts[0], pa.int64(), mask=plain),
        pa.array(cuts[1] - cuts[0], pa.int64(), mask=plain),
        pa.array(out, pa.binary()).cast(pa.string()),
    ]


def _transform(marks: tuple[str, str, str], run_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(_utf8(batch.column("text"))[1])
            at = 0
            while at < len(sizes):
                stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), run_bytes, "right")))
                part = batch.slice(at, stop - at)
                drawn = [part.column(d).to_numpy() for d in ("a", "b")]
                cut = _cut(part.column("text"), part.column("form").to_pylist(), drawn, marks)
                kept = [part.column(c) for c in ("doc_id", "form")]
                yield pa.RecordBatch.from_arrays([*kept, *cut], names=["doc_id", "form", *_RESULT])
                at = stop

    return run


def draw(salt: str, doc_id: Column, which: int) -> Column:
    """The given group of 8 hexadecimal digits of the id's hash, as a number (a null id: no digits)."""
    key = F.concat(F.lit(salt), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * which - 7, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame,
    salt: str = SALT,
    cut_percent: int = CUT_PERCENT,
    spm_percent: int = SPM_PERCENT,
    marks: tuple[str, str, str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
    run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, form, n (code points), prefix_chars, middle_chars, output.

    ``output`` is the text (form ``plain``) or prefix, suffix and middle behind their marks, with
    the prefix (``psm``) or the suffix (``spm``) first.  ``marks`` are those before prefix, suffix
    and middle.  Null and empty texts, and texts that hold a mark, stay plain; the two counts are
    null for plain rows.  Null ids are hashed as no digits.  Repeated ids are cut by the same
    draws; repeated rows: a row each.  Empty table: no rows.  Other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(text, F.lit(mark))
    draws = [draw(salt, F.col("doc_id"), i) for i in (1, 2, 3, 4)]
    plain = (text == "") | marked | (draws[2] % 100 >= cut_percent)
    form = F.when(plain, PLAIN).when(draws[3] % 100 < spm_percent, SPM).otherwise(PSM)
    given = rows.select("doc_id", text.alias("text"), form.alias("form"), draws[0].alias("a"), draws[1].alias("b"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("form", T.StringType())])
    for name in _RESULT:
        schema = schema.add(name, T.StringType() if name == "output" else T.LongType())
    return given.mapInArrow(_transform(marks, run_bytes), schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from an output and its form.

    A text with a mark is never cut, and a mark's first character stands nowhere else in the
    marks, so the marks found in an output are those put there.
    """
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)
