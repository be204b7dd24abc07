"""Operator 12: a hidden Markov language model over words, trained on the whole corpus.

Documents are dealt into runs; a run's tokens are numbers into its own sorted array of word
hashes.  The expectation step of Baum-Welch works inside a run and sends, for each of its
words, the training count and how it is shared out among the states, packed by hash bucket.
A bucket adds up its words over all runs and answers every run with the totals of that run's
words alone.  So the model is spread over buckets and grows with the input; through the driver
pass only the matrix of moves and a few sums per state.  The first expectation step starts from
shares that are drawn from the words' hashes, so that nothing is learnt from a part of the
documents; the others use the model of the corpus.  Then every text is scored by the scaled
forward recursion.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from . import hmm, wordhash
from .common import id_and_text, importable_on_workers, text_slices, written

STATES = 8
#: Expectation steps over all training documents.
ROUNDS = 2
#: The fold that does not train: crc32 of the id as text modulo the first number equals the second.
FOLD = (7, 2)
#: The model that the first expectation step starts from: the probability of a state to follow itself,
#: and how far above 0 the even draws from 0 to 1 are that are a word's shares in the states.
START_STAY, START_SHARE = 0.99, 4.0
#: The share of a word's probability that is the same in all states.
SAME_IN_ALL = 0.05
RUN_BYTES = 32 << 20
#: Words of all runs that meet in one bucket, about.
BUCKET_WORDS = 1 << 19
_PIECE_BYTES = 2 << 20
#: Counts are shared out among the states in parts of this many.
_PARTS = 255
#: Expected moves are added up as whole numbers of this fraction.
_MOVE = 1 << 16
#: The hash that stands for the end of a text.
END = np.uint64(0x454E44)


def _parted(words: np.ndarray) -> np.ndarray:
    """Each row's share of its sum in whole parts of ``_PARTS``, all states but the last."""
    total = words.sum(axis=1, keepdims=True)
    upto = np.cumsum(words, axis=1)[:, :-1] / np.where(total > 0, total, 1)
    return np.diff(np.rint(_PARTS * upto), axis=1, prepend=0).astype(np.uint8)


def _whole(parts: np.ndarray) -> np.ndarray:
    """All states' parts, which add up to ``_PARTS``."""
    parts = parts.astype(np.int64)
    return np.concatenate([parts, _PARTS - parts.sum(axis=1, keepdims=True)], axis=1)


@dataclass
class Sums:
    """What all emission probabilities share: training tokens, words, and per state the counts, and
    those of words that occur once, in parts."""

    tokens: int
    types: int
    mass: np.ndarray
    once: np.ndarray

    def emissions(self, counts: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """The probability of each word in each state; a word never trained on counts as the unknown word.

        A state leaves the unknown word the share that words occurring once have in it.  The rest
        is, but for ``SAME_IN_ALL``, each word's share of the state's counts.
        """
        states = len(self.mass)
        out = np.empty((len(counts), states))
        if not self.tokens:
            out[:] = 1.0
            return out
        unknown = (self.once + _PARTS / 2) / (self.mass + _PARTS)
        known = np.flatnonzero(counts > 0)
        plain = counts[known, None] / self.tokens
        own = counts[known, None] * _whole(parts[known]) / np.maximum(self.mass, 1)
        own = np.where(self.mass > 0, own, plain)
        out[:] = unknown
        out[known] = (1 - unknown) * ((1 - SAME_IN_ALL) * own + SAME_IN_ALL * plain)
        return out


# --- the first model ---------------------------------------------------------------------


def _start_emissions(words: np.ndarray, states: int) -> np.ndarray:
    """Uneven shares of the states in each word, from its hash, so that the states can part.

    They are the same wherever the word stands, and stand for its probabilities: a factor that is
    the same in all states changes no expected count.
    """
    salts = np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = (wordhash.mix(words[:, None] + salts) >> np.uint64(40)).astype(np.float64) / (1 << 24)
    shares = START_SHARE + drawn
    return shares / shares.sum(axis=1, keepdims=True)


def _sums(counts: np.ndarray, parts: np.ndarray) -> Sums:
    shares = counts[:, None] * _whole(parts)
    known = counts > 0
    return Sums(int(counts.sum()), int(known.sum()), shares[known].sum(axis=0), shares[counts == 1].sum(axis=0))


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of texts, each with its end, and the numbers of tokens."""
    run = wordhash.Run([(t or "").encode().lower() for t in texts])
    lengths = run.n_words + 1
    out = np.full(int(lengths.sum()), END)
    ends = np.cumsum(lengths) - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = run.words
    return out, lengths


# --- runs --------------------------------------------------------------------------------

_CODEC = pa.Codec("zstd", 3)


def _pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True), kind)


def _narrow(tokens: np.ndarray) -> np.ndarray:
    """Word numbers in three bytes each."""
    return np.ascontiguousarray(tokens.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3]


def _wide(blob: bytes) -> np.ndarray:
    three = _unpack(blob, np.uint8).reshape(-1, 3)
    out = np.zeros((len(three), 4), np.uint8)
    out[:, :3] = three
    return out.view("<i4").ravel()


@dataclass
class _Trained:
    """The training tokens of a run, for one expectation step."""

    tokens: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, tokens: np.ndarray, lengths: np.ndarray, held_out: np.ndarray) -> _Trained:
        return cls(tokens[np.repeat(~held_out, lengths)], lengths[~held_out])

    def step(self, emissions: np.ndarray, chain: hmm.Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training counts and parts of each word, and the expected moves and starts in whole numbers."""
        found, _ = hmm.expected_counts(self.tokens, self.lengths, emissions, chain)
        counts = np.bincount(self.tokens, minlength=len(emissions))
        moves = np.concatenate([found.moves.ravel(), found.start])
        return counts, _parted(found.words), np.rint(moves * _MOVE).astype(np.int64)


_TABLE = "run long, docs array<struct<doc_id:{0},held_out:boolean,n_tokens:long>>, tokens binary, words binary, "
_TABLE += "n_words long, counts binary, parts binary, moves array<long>"


def _runs(states: int, run_bytes: int) -> Callable:
    """A row per run of texts, with what the first expectation step gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs: list[pa.RecordBatch] = []
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def row() -> pa.RecordBatch:
            joined = np.concatenate(hashes)
            hashes.clear()
            words, tokens = np.unique(joined, return_inverse=True)
            del joined
            tokens = tokens.astype(np.int32)
            lengths = np.concatenate(sizes)
            rows = pa.Table.from_batches(docs).combine_chunks()
            out = np.concatenate([c.to_numpy(zero_copy_only=False) for c in rows.column("held_out").chunks]).astype(bool)
            trained = _Trained.of(tokens, lengths, out)
            counts, parts, moves = trained.step(_start_emissions(words, states), hmm.Chain.sticky(states, START_STAY))
            fields = [rows.column(c).combine_chunks() for c in ("doc_id", "held_out")]
            fields = [f.chunk(0) if isinstance(f, pa.ChunkedArray) else f for f in fields]
            each = pa.StructArray.from_arrays([*fields, pa.array(lengths)], names=["doc_id", "held_out", "n_tokens"])
            values = [
                pa.array([number]),
                pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), each),
                pa.array([_pack(_narrow(tokens))], pa.binary()),
                pa.array([words.tobytes()], pa.binary()),
                pa.array([len(words)]),
                pa.array([_pack(counts)], pa.binary()),
                pa.array([_pack(parts)], pa.binary()),
                pa.array([moves.tolist()]),
            ]
            names = ["run", "docs", "tokens", "words", "n_words", "counts", "parts", "moves"]
            return pa.RecordBatch.from_arrays(values, names=names)

        for batch in batches:
            for start, texts in text_slices(batch, "text", _PIECE_BYTES):
                some, lengths = _hashed(texts)
                hashes.append(some)
                sizes.append(lengths)
                docs.append(batch.select(["doc_id", "held_out"]).slice(start, len(texts)))
                held += sum(len(t) for t in texts if t)
                if held >= run_bytes or sum(map(len, hashes)) >= run_bytes:
                    yield row()
                    number, held = number + 1, 0
                    docs, hashes, sizes = [], [], []
        if docs:
            yield row()

    return run


# --- buckets -----------------------------------------------------------------------------

_SENT = "bucket int, run long, words binary, counts binary, parts binary, moves array<long>"
_ANSWER = "run long, bucket int, counts binary, parts binary, types long, tokens long, mass array<long>, once array<long>, moves array<long>"


def _send(bits: int, run: int, words: np.ndarray, counts: np.ndarray, parts: np.ndarray, moves: list[int]) -> Iterator[tuple]:
    """A run's rows, one for each bucket that has words of it; the first one brings the moves."""
    bucket = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
    numbers, first = np.unique(bucket, return_index=True)
    edges = np.append(first, len(words)).tolist()
    for i, (number, a, b) in enumerate(zip(numbers.tolist(), edges[:-1], edges[1:])):
        sent = (words[a:b].tobytes(), counts[a:b].astype("<u4").tobytes(), parts[a:b].tobytes())
        yield (number, run, *sent, None if i else moves)


_SENT_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
_SENT_NAMES = ["bucket", "run", "words", "counts", "parts", "moves"]


def _sent_rows(bits: int, states: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("run", "words", "counts", "parts", "moves")]
            for number, words, counts, parts, moves in zip(*columns):
                arrays = np.frombuffer(words, "<u8"), _unpack(counts, "<i8"), _unpack(parts, np.uint8)
                for row in _send(bits, number, *arrays[:2], arrays[2].reshape(-1, states - 1), moves):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SENT_TYPES)], names=_SENT_NAMES)

    return run


def _add_up(states: int) -> Callable:
    """A bucket's words over all runs; each run gets the totals of its own words, in its order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("run")
        rows = zip(*[table.column(c).to_pylist() for c in ("run", "words", "counts", "parts", "moves")])
        rows = [
            (r, np.frombuffer(w, "<u8"), np.frombuffer(c, "<u4"), np.frombuffer(p, np.uint8).reshape(-1, states - 1), m)
            for r, w, c, p, m in rows
        ]
        words, own = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        given = np.concatenate([r[2] for r in rows]).astype(np.int64)
        shares = given[:, None] * _whole(np.concatenate([r[3] for r in rows]))
        # sums of whole numbers below 2**53 are exact
        counts = np.bincount(own, weights=given, minlength=len(words)).astype(np.int64)
        added = np.stack([np.bincount(own, weights=s, minlength=len(words)) for s in shares.T], axis=1)
        parts = _parted(added)
        sums = _sums(counts, parts)
        moves = [np.array(r[4], np.int64) for r in rows if r[4] is not None]
        figures = [sums.types, sums.tokens, sums.mass.tolist(), sums.once.tolist()]
        figures.append(sum(moves).tolist() if moves else None)
        out, at = [], 0
        for i, (number, own_words, *_) in enumerate(rows):
            mine = own[at : at + len(own_words)]
            at += len(own_words)
            answer = [counts[mine].astype("<i8").tobytes(), parts[mine].tobytes()]
            out.append([number, table.column("bucket")[0].as_py(), *answer, *(figures if i == 0 else [None] * 5)])
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
        names = ["run", "bucket", "counts", "parts", "types", "tokens", "mass", "once", "moves"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _joined(answers: pa.Table, states: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and parts of a run's words, from its buckets' answers in order."""
    answers = answers.sort_by("bucket")
    counts = np.frombuffer(b"".join(answers.column("counts").to_pylist()), "<i8")
    parts = np.frombuffer(b"".join(answers.column("parts").to_pylist()), np.uint8)
    return counts, parts.reshape(-1, states - 1)


@dataclass
class Model:
    """The trained model: ``answers`` holds each run's part of it, the rest is small."""

    runs: DataFrame
    answers: DataFrame
    sums: Sums
    chain: hmm.Chain


def _step(bits: int, states: int, sums: Sums, chain: hmm.Chain) -> Callable:
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        docs = rows.column("docs").combine_chunks()
        docs = (docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs).flatten()
        held_out = docs.field("held_out").to_numpy(zero_copy_only=False).astype(bool)
        tokens, lengths = _wide(rows.column("tokens")[0].as_py()), docs.field("n_tokens").to_numpy()
        emissions = sums.emissions(*_joined(answers, states))
        counts, parts, moves = _Trained.of(tokens, lengths, held_out).step(emissions, chain)
        words = np.frombuffer(rows.column("words")[0].as_py(), "<u8")
        sent = _send(bits, rows.column("run")[0].as_py(), words, counts, parts, moves.tolist())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*sent), _SENT_TYPES)], names=_SENT_NAMES)

    return run


_SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]


def _score(states: int, sums: Sums, chain: hmm.Chain) -> Callable:
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        docs = rows.column("docs").combine_chunks()
        docs = (docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs).flatten()
        tokens, lengths = _wide(rows.column("tokens")[0].as_py()), docs.field("n_tokens").to_numpy()
        counts, parts = _joined(answers, states)
        found = hmm.log_likelihoods(tokens, lengths, sums.emissions(counts, parts), chain) / np.log(10)
        first = np.cumsum(lengths) - lengths
        plain = np.log10((counts + 1) / (sums.tokens + sums.types + 1))
        base = np.add.reduceat(plain[tokens], first)
        known = np.add.reduceat((counts > 0)[tokens], first, dtype=np.int64)
        values = [docs.field("doc_id"), docs.field("held_out"), docs.field("n_tokens")]
        return pa.table([*values, pa.array(known), pa.array(base), pa.array(found)], names=_SCORED)

    return run


# --- the operator ------------------------------------------------------------------------


def held_out_fold(doc_id: Column, fold: tuple[int, int] = FOLD) -> Column:
    """Whether a document is in the fold that does not train; null ids train."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % fold[0] == fold[1], F.lit(False))


def _totals(answers: DataFrame, states: int) -> tuple[Sums, hmm.Chain]:
    """The sums over all buckets: a few numbers per state."""
    parts = [F.sum("tokens"), F.sum("types")]
    for name, n in (("mass", states), ("once", states), ("moves", states * states + states)):
        parts += [F.sum(F.get(name, F.lit(i))) for i in range(n)]
    numbers = [int(v or 0) for v in answers.filter("types is not null").agg(*parts).first()]
    per_state = np.array(numbers[2:], np.int64)
    mass, once, moves, start = np.split(per_state, np.cumsum([states, states, states * states]))
    chain = hmm.Chain.from_counts(start / _MOVE, moves.reshape(states, states) / _MOVE)
    return Sums(numbers[0], numbers[1], mass, once), chain


def train(
    docs: DataFrame,
    states: int = STATES,
    rounds: int = ROUNDS,
    fold: tuple[int, int] = FOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_documents: int | None = None,
    run_bytes: int = RUN_BYTES,
    bucket_words: int = BUCKET_WORDS,
) -> Model:
    """Baum-Welch over all documents outside the fold; see :func:`score` for the rows it takes.

    ``sample_documents`` is taken for callers that still give it and does nothing: there is no sample.
    """
    spark: SparkSession = docs.sparkSession
    importable_on_workers(spark)
    rows = id_and_text(docs, id_col, text_col).withColumn("held_out", held_out_fold(F.col("doc_id"), fold))
    folder = f"{ensure_checkpoint_dir(spark)}/hidden-markov-{uuid.uuid4().hex}"
    schema = _TABLE.format(rows.schema["doc_id"].dataType.simpleString())
    runs = written(rows.mapInArrow(_runs(states, run_bytes), schema), f"{folder}/runs")
    words = runs.agg(F.sum("n_words")).first()[0] or 0
    bits = max(0, int(words // bucket_words).bit_length())
    own = runs.select("run", "words", "counts", "parts", "moves")
    sent = own.mapInArrow(_sent_rows(bits, states), _SENT)
    for i in range(rounds):
        answers = written(sent.groupBy("bucket").applyInArrow(_add_up(states), _ANSWER), f"{folder}/answers{i}")
        sums, chain = _totals(answers, states)
        given = answers.select("run", "bucket", "counts", "parts").groupBy("run")
        if i + 1 < rounds:
            kept = runs.select("run", "docs", "tokens", "words").groupBy("run")
            sent = kept.cogroup(given).applyInArrow(_step(bits, states, sums, chain), _SENT)
    return Model(runs, answers, sums, chain)


def score(
    docs: DataFrame,
    states: int = STATES,
    rounds: int = ROUNDS,
    fold: tuple[int, int] = FOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_documents: int | None = None,
    run_bytes: int = RUN_BYTES,
    bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the lower-cased (A-Z) words and one end.  ``score`` is the log10 probability of the
    whole text under the hidden Markov model of ``states`` states, ``base_score`` that of single
    tokens with one added to each count.  Documents in ``fold`` do not train.  Null and empty
    texts are their end alone.  Null ids train; repeated rows train, and have a row each.  A word
    is known by a 64-bit hash.  Without training rows every token is unknown and has probability
    1 in the model.  Empty table: no rows.  Other columns are not read.  ``sample_documents``: see
    :func:`train`.
    """
    model = train(docs, states, rounds, fold, id_col, text_col, sample_documents, run_bytes, bucket_words)
    given = model.answers.select("run", "bucket", "counts", "parts").groupBy("run")
    kept = model.runs.select("run", "docs", "tokens").groupBy("run")
    doc_id = model.runs.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    result = f"doc_id {doc_id}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = kept.cogroup(given).applyInArrow(_score(states, model.sums, model.chain), result)
    known = scored.withColumn("train_tokens", F.lit(model.sums.tokens).cast("long"))
    return known.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
