"""Operator 9: quality rules with a perplexity band per language.

A modified Kneser-Ney model of five code points is counted over all documents and kept in sorted
hash arrays over buckets (:mod:`ngram_tables`); a run of documents sends each of its different
n-grams once and gets back their probabilities.  Each document gets its log-perplexity; the
median and median deviation per language set a lower and an upper bound, narrower for longer
texts, outside of which documents are rejected.  Counting rules come first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from . import ngram_tables, wordhash
from .common import as_utf8, importable_on_workers, materialise, text_slices, written

#: Bytes of text whose different n-grams are sent together.
MODEL_RUN_BYTES = 32 << 20
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50
REPEAT_WINDOW = 3
LOWER_DEVIATIONS = 8.0
UPPER_DEVIATIONS = 3.5
#: The least median deviation a band is built on, and the grid of log-perplexities, in nats a code point.
LEAST_DEVIATION = 0.01
GRID = 1e-4
_AWAY_STEP = 10
RUN_BYTES = 2 << 20
_BROADCAST_LANGUAGES = 50_000

# Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_repeat_powers = wordhash.Powers(0xC2B2AE3D27D4EB4F, 1 << 20)


def base_counts(run: wordhash.Run) -> dict[str, np.ndarray]:
    """The counting rules' figures of each text."""
    data = run.data
    inside = ~wordhash.is_space(data) & ((data & 0xC0) != 0x80)
    starts, ends, owner = run.lines()
    with_word = np.searchsorted(run.starts, ends) > np.searchsorted(run.starts, starts)
    starts, ends, owner = starts[with_word], ends[with_word], owner[with_word]
    earlier, _ = wordhash.equal_within(wordhash.hash_spans(data, starts, ends), owner)
    repeated = np.bincount(owner[earlier], minlength=len(run.n_words))
    windows = wordhash.hash_windows(run.words, REPEAT_WINDOW, _repeat_powers)
    doc = run.doc_of_word()
    whole = np.flatnonzero(doc[: len(windows)] == doc[REPEAT_WINDOW - 1 :]) if len(windows) else np.empty(0, np.int64)
    before, after = wordhash.equal_within(windows[whole], doc[whole])
    at = whole[before | after]
    covered = np.zeros(len(run.words), bool)
    for k in range(REPEAT_WINDOW):
        covered[at + k] = True
    return {
        "n_words": run.n_words,
        "word_chars": run.count(inside),
        "n_symbols": run.count(_SYMBOL[data]),
        "n_dup_lines": repeated,
        "n_repeat_words": np.bincount(doc[covered], minlength=len(run.n_words)),
    }


_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _plain(texts: list[bytes]) -> bytes:
    """Texts as lines, each run of white space as one space, and one at both ends."""
    return b"\n".join([b" " + b" ".join(t.split()) + b" " for t in texts])


def _codes(plain: bytes) -> np.ndarray:
    return np.frombuffer(plain.decode().encode("utf-32-le"), np.uint32)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per run of texts: its number, documents with their counts, packed texts, n-grams."""
    number = TaskContext.get().partitionId() << 32
    codec = pa.Codec("zstd", 9)
    parts: list[pa.StructArray] = []
    packed: list[bytes] = []
    grams, held = ngram_tables.Grams(), 0

    def row() -> pa.RecordBatch:
        docs = pa.concat_arrays(parts)
        lists = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
        keys, counts = grams.packed()
        values = [pa.array([number]), lists, pa.array([packed], pa.list_(pa.binary()))]
        values += [pa.array([keys]), pa.array([counts]), pa.array([len(grams.counts)])]
        return pa.RecordBatch.from_arrays(values, names=["run", "docs", "packed", "grams", "counts", "n_grams"])

    for batch in batches:
        for start, texts in text_slices(batch, "text", RUN_BYTES):
            raw = [(t or "").encode() for t in texts]
            counts = base_counts(wordhash.Run(raw))
            own = [batch.column(c).slice(start, len(texts)) for c in ("doc_id", "lang")]
            values = [pa.array(counts[m].astype(np.int64)) for m in _MEASURES]
            parts.append(pa.StructArray.from_arrays([*own, *values], names=["doc_id", "lang", *_MEASURES]))
            plain = _plain(raw)
            grams.add(_codes(plain))
            packed.append(len(plain).to_bytes(8, "little") + codec.compress(plain, asbytes=True))
            held += len(plain)
            if held >= MODEL_RUN_BYTES:
                yield row()
                number, parts, packed, grams, held = number + 1, [], [], ngram_tables.Grams(), 0
    if parts:
        yield row()


def _score_run(bits: int) -> Callable:
    """The documents of a run with the mean negative log-probability of their n-grams, on the grid."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys = ngram_tables.unpack_keys(rows.column("grams")[0].as_py())
        order, _, _ = ngram_tables.by_bucket(keys, bits)
        logp = np.zeros(len(order) + 1)
        logp[order] = ngram_tables.joined(answers, "<f4")
        index = ngram_tables.GramIndex(ngram_tables.gram_hashes(keys))
        cross: list[np.ndarray] = []
        for blob in rows.column("packed").to_pylist()[0]:
            size = int.from_bytes(blob[:8], "little")
            codes = _codes(pa.Codec("zstd").decompress(blob[8:], size, asbytes=True))
            owners = np.cumsum(codes == 10)
            sums, n = np.zeros(owners[-1] + 1), np.zeros(owners[-1] + 1, np.int64)
            for places, hashes, _ in ngram_tables.gram_pieces(codes):
                owner, found = owners[places], index.find(hashes)
                if len(found) and found.min() < 0:
                    raise ValueError("an n-gram of the run has no probability")
                sums += np.bincount(owner, weights=logp[found], minlength=len(sums))
                n += np.bincount(owner, minlength=len(n))
            cross.append(np.round(-sums / np.maximum(n, 1) / GRID).astype(np.int64))
        values = pa.array(np.concatenate(cross))
        lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table([rows.column("docs"), lists], names=["docs", "cross"])

    return run


def measure(rows: DataFrame) -> DataFrame:
    """doc_id, lang, the counts and cross of every row of (doc_id, lang, text)."""
    doc = T.StructType(
        [*rows.select("doc_id", "lang").schema.fields, *[T.StructField(m, T.LongType()) for m in _MEASURES]]
    )
    fields = [T.StructField("run", T.LongType()), T.StructField("docs", T.ArrayType(doc))]
    fields += [T.StructField("packed", T.ArrayType(T.BinaryType())), T.StructField("grams", T.BinaryType())]
    fields += [T.StructField("counts", T.BinaryType()), T.StructField("n_grams", T.LongType())]
    folder = f"{ensure_checkpoint_dir(rows.sparkSession)}/quality-rules-{uuid.uuid4().hex}"

    def kept(frame: DataFrame, name: str) -> DataFrame:
        return written(frame, f"{folder}/{name}")

    runs = kept(rows.mapInArrow(_runs, T.StructType(fields)), "runs")
    answers, bits = ngram_tables.log_probabilities(runs, kept)
    scored = (
        runs.select("run", "docs", "packed", "grams")
        .groupBy("run")
        .cogroup(answers.groupBy("sender"))
        .applyInArrow(
            _score_run(bits),
            T.StructType([T.StructField("docs", T.ArrayType(doc)), T.StructField("cross", T.ArrayType(T.LongType()))]),
        )
    )
    each = scored.select(F.explode(F.arrays_zip("docs", "cross")).alias("r"))
    return materialise(each.select("r.docs.*", "r.cross"))


#: Values of a histogram that are added up before the running sum.
_CELL = 64


def _grid_median(rows: DataFrame, value: str, name: str) -> DataFrame:
    """The median of a whole-number column per language, from its histogram; exact and repeatable.

    The running sum over a language goes by cells of ``_CELL`` values, and then by the values of
    the one cell that holds the median, so no language brings all its values to one task.
    """
    counted = rows.groupBy("lang", value).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("cell", F.floor(F.col(value) / _CELL))
    along = Window.partitionBy("lang").orderBy("cell")
    cells = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).select(
        "lang", "cell", F.sum("n").over(along).alias("up_to"), F.sum("n").over(Window.partitionBy("lang")).alias("all"), "n"
    )
    first = cells.filter(2 * F.col("up_to") >= F.col("all")).groupBy("lang").agg(
        F.min(F.struct("cell", (F.col("up_to") - F.col("n")).alias("before"), "all")).alias("m")
    )
    first = first.select(F.col("lang").alias("cell_lang"), "m.*").withColumnRenamed("cell", "median_cell")
    same = F.col("lang").eqNullSafe(F.col("cell_lang")) & (F.col("cell") == F.col("median_cell"))
    inside = counted.join(first, same).select(
        "lang", value, "before", "all", F.sum("n").over(Window.partitionBy("lang").orderBy(value)).alias("up_to")
    )
    reached = inside.filter(2 * (F.col("before") + F.col("up_to")) >= F.col("all"))
    return reached.groupBy("lang").agg(F.min(value).alias(name))


def bands(measured: DataFrame) -> DataFrame:
    """Per language: ``middle`` on the grid of log-perplexities, and ``wide``, the unit of ``_away``."""
    medians = materialise(_grid_median(measured, "cross", "middle").withColumnRenamed("lang", "of_lang"))
    away = _join_language(measured, medians).withColumn("away", F.abs(F.round(_away() / _AWAY_STEP)).cast("long"))
    spread = _grid_median(away, "away", "spread")
    least = F.lit(round(LEAST_DEVIATION / GRID))
    return materialise(
        medians.join(spread, F.col("lang").eqNullSafe(F.col("of_lang"))).select(
            "of_lang", "middle", F.greatest(F.col("spread") * _AWAY_STEP, least).alias("wide")
        )
    )


def _away() -> Column:
    """How far a document is from its language's median, as much as one of ``MIN_WORDS`` words would be.

    A mean over n words varies as 1 / sqrt(n); so the band is narrow for long texts.
    """
    return (F.col("cross") - F.col("middle")) * F.sqrt(F.col("n_words") / MIN_WORDS)


def _join_language(rows: DataFrame, per_language: DataFrame) -> DataFrame:
    """One row per language joins all rows; sent to all tasks only if the list of languages is short."""
    if per_language.count() <= _BROADCAST_LANGUAGES:
        per_language = F.broadcast(per_language)
    return rows.join(per_language, F.col("lang").eqNullSafe(F.col("of_lang")), "left")


def judge(
    docs: DataFrame,
    lower: float = LOWER_DEVIATIONS,
    upper: float = UPPER_DEVIATIONS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, log_perplexity, kept.

    A document fails the counting rules with fewer than 50 words or more than half of its
    words in repeated windows; it is kept if it does not, and its log-perplexity (nats a
    code point) lies in its language's band.  Bands come from the documents that pass the counting
    rules.  Null and empty texts have no words and fail.  A null language is a language.
    Null or repeated ids: a row each.  Empty table: no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    importable_on_workers(spark)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), as_utf8(text_col).alias("text")
    )
    measured = measure(rows)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    found = bands(measured.filter(~F.col("base_failed")))
    inside = _away().between(-lower * F.col("wide"), upper * F.col("wide"))
    return _join_language(measured, found).select(
        "doc_id",
        *_MEASURES,
        "base_failed",
        (F.col("cross") * GRID).alias("log_perplexity"),
        F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept"),
    )
