"""Operator 2: document quality from a linear-chain conditional random field over lines.

Every line gets features of its own and of its neighbours; a two-state chain (bad, good)
labels the lines of a document together.  The marginals of the forward-backward pass,
weighted by line length, give the document's score.  The field is fitted by gradient ascent
on the driver, on the lines of a bounded sample of labelled documents whose lines all carry
the document's label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import as_utf8, id_and_text, importable_on_workers, text_slices
from .training import is_held_out, training_rows

#: Labelled documents the field is fitted on, of each label; and the lines such a document may have.
TRAINING_ROWS = 1500
TRAINING_LINES = 400
STEPS = 150
PENALTY = 1e-3
THRESHOLD = 0.3
RUN_BYTES = 2 << 20

_WINDOW = wordhash.Powers(0xC2B2AE3D27D4EB4F, 1 << 20)
_KINDS = {
    "symbol": b"#*$%&<>@_=+~^",
    "bar": b"|",
    "bang": b"!",
    "digit": b"0123456789",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "stop": b".",
    "comma": b",",
}
_MASKS = np.zeros((len(_KINDS), 256), bool)
for _row, _members in enumerate(_KINDS.values()):
    _MASKS[_row, list(_members)] = True
OWN_FEATURES = len(_KINDS) + 8
FEATURES = 3 * OWN_FEATURES + 1


def line_features(run: wordhash.Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, lengths in bytes and text numbers of all lines with a word, in order."""
    data = run.data
    starts, ends, doc = run.lines()
    first = np.searchsorted(run.starts, starts)
    last = np.searchsorted(run.starts, ends)
    some = last > first
    starts, ends, doc, first, last = starts[some], ends[some], doc[some], first[some], last[some]
    if not len(starts):
        return np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, np.int64)
    size = (ends - starts).astype(np.float64)
    words = (last - first).astype(np.float64)
    own = []
    between = np.stack([starts, ends], axis=1).ravel()  # every second sum is a line's
    for mask in _MASKS:
        own.append(np.add.reduceat(mask[data], between, dtype=np.int64)[::2] / size)

    def per_word(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (sums[last] - sums[first]) / words

    line_of_word = np.searchsorted(ends, run.starts)
    same = np.zeros(len(run.words), bool)
    same[1:] = (run.words[1:] == run.words[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    own.append(per_word(same))
    own.append(per_word(wordhash.equal_within(run.words, line_of_word)[0]))
    owner = run.doc_of_word()
    windows = wordhash.hash_windows(run.words, 3, _WINDOW)
    whole = np.flatnonzero(owner[: len(windows)] == owner[2:]) if len(windows) else np.empty(0, np.int64)
    before, after = wordhash.equal_within(windows[whole], owner[whole])
    again = np.zeros(len(run.words), bool)
    for k in range(3):
        again[whole[before | after] + k] = True
    own.append(per_word(again))
    own.append(np.minimum(size / words, 40) / 20)
    own.append(np.log1p(words) / 6)
    own.append(wordhash.equal_within(wordhash.hash_spans(data, starts, ends), doc)[0].astype(np.float64))
    lengths = (run.ends - run.starts)
    own.append(per_word(lengths > 25))
    own.append((data[ends - 1] == ord(".")).astype(np.float64))
    x = np.stack(own, axis=1)
    x[:, : len(_KINDS) + 3] = np.sqrt(x[:, : len(_KINDS) + 3])  # shares: small ones tell the most
    # the neighbours' features; at the ends of a text the line's own
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    end = np.concatenate((new[1:], [True]))
    at = np.arange(len(doc))
    return np.concatenate([x, x[at - ~new], x[at + ~end], np.ones((len(doc), 1))], axis=1), size, doc


def _by_position(doc: np.ndarray) -> list[np.ndarray]:
    """For line positions 0, 1, ...: the rows at that position, longest documents first."""
    if not len(doc):
        return []
    _, first, count = np.unique(doc, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    return [first[: np.searchsorted(-count, -t, "left")] + t for t in range(int(count[0]))]


def marginals(good: np.ndarray, steps: np.ndarray, positions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) per line, log-normaliser per document (in position order), expected transitions.

    ``good`` is the score of good over bad per line, ``steps[a, b]`` that of state b after a.
    """
    n = len(good)
    score = np.stack([np.zeros(n), good], axis=1)
    ahead = np.zeros((n, 2))
    for t, rows in enumerate(positions):
        if t == 0:
            ahead[rows] = score[rows]
        else:
            before = ahead[positions[t - 1][: len(rows)]]
            ahead[rows] = score[rows] + np.logaddexp(before[:, :1] + steps[0], before[:, 1:] + steps[1])
    back = np.zeros((n, 2))
    expected = np.zeros((2, 2))
    norm = np.zeros(len(positions[0]) if positions else 0)
    for t in range(len(positions) - 1, -1, -1):
        rows = positions[t]
        following = positions[t + 1] if t + 1 < len(positions) else rows[:0]
        m = len(following)
        norm[m : len(rows)] = np.logaddexp(ahead[rows[m:], 0], ahead[rows[m:], 1])
        if m:
            gone = score[following] + back[following]
            here = rows[:m]
            back[here] = np.logaddexp(steps[:, 0] + gone[:, :1], steps[:, 1] + gone[:, 1:])
            pair = ahead[here][:, :, None] + steps + gone[:, None, :] - norm[:m, None, None]
            expected += np.exp(pair).sum(axis=0)
    total = ahead + back
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), norm, expected


def line_scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The products of the lines' features with the weights, added up feature by feature.

    A matrix product would round by the number of lines, and so by what else is in a batch.
    """
    out = np.zeros(len(x))
    for feature, weight in zip(x.T, weights):
        out += feature * weight
    return out


class LineField:
    """Weights of the line features and of the transitions."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def score(self, x: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Length-weighted mean of the lines' marginals per text; 0 for a text without words."""
        good, _, _ = marginals(line_scores(x, self.weights), self.steps, _by_position(doc))
        total = np.bincount(doc, weights=size, minlength=n)
        return np.bincount(doc, weights=size * good, minlength=n) / np.maximum(total, 1)

    @classmethod
    def fit(cls, x: np.ndarray, doc: np.ndarray, label: np.ndarray, steps: int = STEPS) -> LineField:
        """Penalised maximum likelihood by Adam; ``label`` is per document."""
        weights, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
        if not len(x):
            return cls(weights, moves)
        y = label[doc].astype(np.float64)
        positions = _by_position(doc)
        counts = np.bincount(doc, minlength=len(label))
        held = np.zeros((2, 2))
        for value in (0, 1):
            held[value, value] = np.maximum(counts[label == value] - 1, 0).sum()
        value = np.concatenate([weights, moves.ravel()])
        first, second = np.zeros_like(value), np.zeros_like(value)
        n = len(label)
        for i in range(1, steps + 1):
            weights, moves = value[:-4], value[-4:].reshape(2, 2)
            good, _, expected = marginals(x @ weights, moves, positions)
            slope = np.concatenate([x.T @ (y - good), (held - expected).ravel()]) / n - PENALTY * value
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope * slope
            value = value + 0.1 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
        return cls(value[:-4], value[-4:].reshape(2, 2))


def _line_table(most_lines: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for at, texts in text_slices(batch, "text", RUN_BYTES):
                x, _, doc = line_features(wordhash.Run([(t or "").encode() for t in texts]))
                rows = [x[a:b].astype(np.float32).tobytes() for a, b in _spans(doc, len(texts)) if b - a <= most_lines]
                kept = [labels[at + i] for i, (a, b) in enumerate(_spans(doc, len(texts))) if b - a <= most_lines]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept, pa.int32()), pa.array(rows, pa.binary())], names=["label", "lines"]
                )

    return run


def _spans(doc: np.ndarray, n: int) -> list[tuple[int, int]]:
    edges = np.searchsorted(doc, np.arange(n + 1))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def fit_field(
    docs: DataFrame,
    labels: DataFrame,
    rows_per_class: int = TRAINING_ROWS,
    most_lines: int = TRAINING_LINES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> LineField:
    """A field fitted on at most ``rows_per_class`` documents of each label.

    Rows held out and documents of more than ``most_lines`` lines do not train.  What the
    driver gathers is bounded by these parameters.  Without labels every score is a half.
    """
    importable_on_workers(docs.sparkSession)
    rows = training_rows(id_and_text(docs, id_col, text_col), labels, "quality", rows_per_class)
    table = rows.mapInArrow(_line_table(most_lines), "label int, lines binary").toArrow()
    drawn = sorted(zip(table.column("label").to_pylist(), table.column("lines").to_pylist()))
    label = np.array([d[0] for d in drawn], np.int64)
    parts = [np.frombuffer(d[1], np.float32).reshape(-1, FEATURES) for d in drawn]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
    x = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, FEATURES))
    return LineField.fit(x, doc, label)


def scorer(field: LineField) -> Callable:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out, run, held, values = [], [], 0, texts.tolist()
        for i, text in enumerate(values):
            run.append((text or "").encode())
            held += len(run[-1])
            if held >= RUN_BYTES or i + 1 == len(values):
                out.append(field.score(*line_features(wordhash.Run(run)), len(run)))
                run, held = [], 0
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return score


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    rows_per_class: int = TRAINING_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if the score reaches the threshold).

    Scores read the text alone.  Null and empty texts have no line: score 0.  Null ids are
    not held out.  Repeated rows: a row each.  Empty table: no rows.  Other columns are not read.
    """
    field = fit_field(docs, labels, rows_per_class, id_col=id_col, text_col=text_col)
    rows = id_and_text(docs, id_col, text_col).select("doc_id", scorer(field)("text").alias("score"))
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted")
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    rows_per_class: int = TRAINING_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns.

    Null and empty texts score 0 and go, with any threshold above 0.  Null ids, repeated rows
    and extra columns of any name are kept as they are; each row is judged by its own text.
    Without labels every text with a word scores a half.  Empty table: no rows.
    """
    field = fit_field(docs, labels, rows_per_class, id_col=id_col, text_col=text_col)
    return docs.filter(scorer(field)(as_utf8(text_col)) >= threshold).select(*docs.columns)
