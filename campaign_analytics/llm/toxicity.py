"""Operator 3: toxicity from misspelling-tolerant lexicon matches and their context.

The lexicon is learned from a bounded sample of labelled documents: words, and word stems
with many endings, that toxic documents hold and others do not.  Its trie is intersected with
Levenshtein automata into one deterministic automaton, which reads every word of every text;
a word is a hit if it is a term or begins with a stem, or does so within the edits that the
term or stem allows.  Words around a hit, of the same text, tell quotation and report from abuse.  A document's score is a logistic
function of its hits by kind and context, fitted on the same sample.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, importable_on_workers
from .tokens import safe_pieces
from .training import is_held_out, training_rows

#: Labelled documents the lexicon and the weights are fitted on, of each label; terms at most.
TRAINING_ROWS = 2500
MOST_TERMS = 200
THRESHOLD = 0.5
LEAST_DOCUMENTS = 8
LEAST_EVIDENCE = 25.0
EXPLAINED = 3
COMMON_SHARE = 0.03
STEM_LENGTHS = range(4, 13)
#: A hit's context: words on each side, within this many characters.
CONTEXT_WORDS = 6
CONTEXT_CHARS = 2000
#: A term's edits are given up if they add words that more than this share of the clean sample holds.
NEAR_SHARE = 0.002
RUN_CHARS = 1 << 20

# Characters that stand for letters, quotation marks, and words of report.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
QUOTES = "\"“”„«»‘’‹›"
REPORT = (
    "said says wrote writes called calling quoted quote word term slur insult insults "
    "sagte schrieb nannte wort zitat dit disait mot appelé terme dijo escribió palabra llamó término"
).split()

EXACT, STEM, NEAR, NEAR_STEM = 1, 2, 3, 4


def edits_allowed(term: str, stem: bool = False) -> int:
    """Edits by length.  A short stem allows none: whatever follows it, it would match too much."""
    if len(term) < (5 if stem else 4):
        return 0
    return 1 if len(term) < 9 else 2


# --- words of a text, as code points -----------------------------------------------------

_PLANE = 1 << 16
_LETTER = np.array([chr(c).isalpha() and not 0xD800 <= c < 0xE000 for c in range(_PLANE)])
_DIGIT, _SIGN = np.zeros(_PLANE, bool), np.zeros(_PLANE, bool)
for _c in (*LOOKALIKES, "*", "#", "%", "&", "+", "-", "_", "."):
    (_DIGIT if _c.isdigit() else _SIGN)[ord(_c)] = True
_FOLD = np.arange(_PLANE, dtype=np.uint32)
for _c, _to in LOOKALIKES.items():
    _FOLD[ord(_c)] = ord(_to)
#: Blocks of styled letters and digits, from the first to before the last; no other character
#: beyond the first plane is part of a word.
_STYLED = ((0xFF10, 0xFF5B), (0x1D400, 0x1D800), (0x1F130, 0x1F18A), (0x1FBF0, 0x1FBFA))


def _plain_letters() -> tuple[np.ndarray, np.ndarray]:
    """Styled characters in order, and the plain ones they stand for."""
    found = {}
    for first, last in _STYLED:
        for c in range(first, last):
            plain = unicodedata.normalize("NFKC", chr(c)).lower()
            if len(plain) == 1 and ord(plain) < _PLANE:
                found[c] = ord(plain)
    return np.array(list(found), np.uint32), np.array(list(found.values()), np.uint32)


_STYLED_CODES, _PLAIN_CODES = _plain_letters()


def _in_first_plane(codes: np.ndarray) -> np.ndarray:
    """Styled letters and digits as plain ones, all else beyond the first plane as no letter."""
    at = np.flatnonzero(codes >= _STYLED[0][0])
    if len(at):
        codes = codes.copy()
        place = np.minimum(np.searchsorted(_STYLED_CODES, codes[at]), len(_STYLED_CODES) - 1)
        styled = _STYLED_CODES[place] == codes[at]
        codes[at] = np.where(styled, _PLAIN_CODES[place], np.minimum(codes[at], _PLANE - 1))
    return codes


class Words:
    """The words of lower-cased text: runs of letters, digits beside them, and signs between two of these."""

    def __init__(self, text: str):
        self.codes = _in_first_plane(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32))
        inside = _LETTER[self.codes]
        digit, sign = _DIGIT[self.codes], _SIGN[self.codes]
        for _ in range(2):  # digits beside a letter, and beside such a digit
            beside = inside.copy()
            beside[1:] |= inside[:-1]
            beside[:-1] |= inside[1:]
            inside |= digit & beside
        inside[1:-1] |= sign[1:-1] & inside[:-2] & inside[2:]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def word(self, i: int) -> str:
        return "".join(map(chr, self.codes[self.starts[i] : self.ends[i]].tolist()))


# --- the lexicon's trie with Levenshtein automata -----------------------------------------


class Automaton:
    """All terms' Levenshtein automata at once, over the trie of the terms.

    A state is a set of (trie node, edits so far), with the fewest edits per node; reading a
    letter moves along an edge, or substitutes, inserts or deletes at one edit.  The subset
    construction gives a table of states by character class.  A term ends a path only if the
    edits stay within its own allowance; a stem does so too, whatever follows.
    """

    def __init__(self, terms: dict[str, bool], allowed: dict[str, int] | None = None):
        """``terms``: term -> whether it is a stem; ``allowed``: edits of terms that have not
        those of their length."""
        children: list[dict[str, int]] = [{}]
        budget = [0]  # the most edits any term below a node allows
        ends: dict[int, int] = {}
        stems: dict[int, int] = {}
        for term, stem in sorted(terms.items()):
            at, path = 0, [0]
            for c in term:
                if c not in children[at]:
                    children.append({})
                    budget.append(0)
                    children[at][c] = len(children) - 1
                at = children[at][c]
                path.append(at)
            edits = (allowed or {}).get(term, edits_allowed(term, stem))
            (stems if stem else ends)[at] = edits
            for node in path:
                budget[node] = max(budget[node], edits)
        letters = sorted({c for t in terms for c in t})
        self.classes = np.zeros(_PLANE, np.int32)  # 0: a letter that no term has
        for i, c in enumerate(letters, 1):
            self.classes[ord(c)] = i

        def closed(states: dict[int, int]) -> frozenset[tuple[int, int]]:
            todo = list(states)
            while todo:  # letters left out
                node = todo.pop()
                for child in children[node].values():
                    edits = states[node] + 1
                    if edits <= budget[child] and states.get(child, 99) > edits:
                        states[child] = edits
                        todo.append(child)
            return frozenset(states.items())

        def step(state: frozenset[tuple[int, int]], c: str | None) -> frozenset[tuple[int, int]]:
            out: dict[int, int] = {}
            for node, edits in state:
                if edits < budget[node] and out.get(node, 99) > edits + 1:
                    out[node] = edits + 1  # a letter too many
                for letter, child in children[node].items():
                    cost = edits + (letter != c)
                    if (cost == 0 or cost <= budget[child]) and out.get(child, 99) > cost:
                        out[child] = cost
            return closed(out)

        def kind_of(state: frozenset[tuple[int, int]], passed: bool) -> int:
            if any(e == 0 and node in ends for node, e in state):
                return EXACT
            if any(e <= ends.get(node, -1) for node, e in state):
                return NEAR
            return NEAR_STEM if passed else 0

        # a state also knows whether a stem was passed within its edits
        start = (closed({0: 0}), False)
        nothing = (frozenset(), False)
        known = {nothing: 0, start: 1}
        todo = [start]
        rows: dict[int, np.ndarray] = {}
        stem_state = -1
        while todo:
            at = todo.pop()
            state, passed = at
            relevant = {c for node, _ in state for c in children[node]}
            other = step(state, None)
            row = np.zeros(len(letters) + 1, np.int32)
            for i, c in enumerate([None, *letters]):
                nodes = step(state, c) if c in relevant else other
                if any(e == 0 and node in stems for node, e in nodes):
                    row[i] = stem_state
                    continue
                to = (nodes, passed or any(e <= stems.get(node, -1) for node, e in nodes))
                if to not in known:
                    known[to] = len(known)
                    todo.append(to)
                row[i] = known[to]
            rows[known[at]] = row
        n = len(known)
        self.table = np.zeros((n + 1, len(letters) + 1), np.int32)
        for i, row in rows.items():
            self.table[i] = np.where(row < 0, n, row)
        self.table[n] = n  # begins with a stem: so it stays
        self.accepts = np.zeros(n + 1, np.int8)
        for (state, passed), i in known.items():
            self.accepts[i] = kind_of(state, passed)
        self.accepts[n] = STEM

    def read(self, words: Words) -> np.ndarray:
        """For each word: 0, or how it is a hit."""
        codes = _FOLD[words.codes]
        at = np.flatnonzero(words.ends > words.starts)
        state = np.ones(len(at), np.int32)
        place = words.starts[at].copy()
        out = np.zeros(len(words.starts), np.int8)
        while len(at):
            state = self.table[state, self.classes[codes[place]]]
            place += 1
            over = place >= words.ends[at]
            out[at[over]] = self.accepts[state[over]]
            alive = (state != 0) & ~over
            at, state, place = at[alive], state[alive], place[alive]
        return out


def match_kind(word: str, term: str, stem: bool, edits: int | None = None) -> int:
    """How ``word`` is a hit of one term, by the usual table of edit distances; for tests."""
    edits = edits_allowed(term, stem) if edits is None else edits
    row = list(range(len(term) + 1))
    least = row[-1] if stem else len(term) + len(word)
    for i, a in enumerate(word, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(term, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        least = min(least, row[-1]) if stem else row[-1]
    if least > edits:
        return 0
    return (NEAR_STEM if least else STEM) if stem else NEAR if least else EXACT


# --- learning the lexicon ----------------------------------------------------------------


def _evidence(toxic: int, other: int, n_toxic: int, n_other: int) -> float:
    """Log-likelihood ratio of a term's counts against one rate in both classes."""
    p, both = n_toxic / (n_toxic + n_other), toxic + other
    if toxic <= both * p:
        return 0.0
    out = toxic * math.log(toxic / (both * p))
    return 2 * (out + (other * math.log(other / (both * (1 - p))) if other else 0.0))


def _documents_of_words(texts: list[tuple[str, int]]) -> tuple[dict[str, tuple[set[int], set[int]]], list[int]]:
    """The clean and the toxic documents that hold each word, and how many of each there are."""
    documents: dict[str, tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))
    sizes = [0, 0]
    for i, (text, label) in enumerate(dict.fromkeys(texts)):
        words = Words(text)
        folded = _FOLD[words.codes]
        sizes[label] += 1
        spans = zip(words.starts.tolist(), words.ends.tolist())
        for w in {folded[a:b].tobytes() for a, b in spans if b - a < 40}:
            documents[w.decode("utf-32-le", "replace")][label].add(i)
    return documents, sizes


def learn_edits(texts: list[tuple[str, int]], lexicon: dict[str, bool]) -> dict[str, int]:
    """Edits of the terms that allow fewer than their length does.

    While the words that a term's edits add, and no other term explains, stand in more than
    ``NEAR_SHARE`` of the clean documents, the term allows one edit less.
    """
    documents, sizes = _documents_of_words(texts)
    known = list(documents)
    every = Words(" ".join(known))
    if len(every.starts) != len(known):  # a word that lower-casing parts once more
        known = [w for w in known if len(Words(w).starts) == 1]
        every = Words(" ".join(known))
    exact = Automaton(lexicon, dict.fromkeys(lexicon, 0)).read(every) > 0
    out: dict[str, int] = {}
    for term, stem in lexicon.items():
        edits = edits_allowed(term, stem)
        while edits:
            added = np.flatnonzero((Automaton({term: stem}, {term: edits}).read(every) > 0) & ~exact)
            clean = set().union(*(documents[known[i]][0] for i in added))
            if len(clean) <= NEAR_SHARE * sizes[0]:
                break
            edits -= 1
            out[term] = edits
    return out


def learn_lexicon(texts: list[tuple[str, int]], most_terms: int = MOST_TERMS) -> dict[str, bool]:
    """Terms that toxic texts hold and others hardly do -> whether the term is a stem.

    Candidates are words and their beginnings.  The one with the most evidence is taken, then
    the next, while the evidence is strong.  A toxic text that ``EXPLAINED`` different words
    explain is no evidence for the rest of its words, so chance words and words that only
    copies of one text share are not learned, unless a large share of toxic texts hold them.
    """
    documents, sizes = _documents_of_words(texts)
    if not min(sizes):
        return {}
    stems: dict[str, list[str]] = defaultdict(list)
    for w, (_, toxic) in documents.items():
        if toxic:
            for n in STEM_LENGTHS:
                if n < len(w):
                    stems[w[:n]].append(w)
    for w, (_, toxic) in documents.items():  # a stem stands for all words that begin so
        if not toxic:
            for n in STEM_LENGTHS:
                if n < len(w) and w[:n] in stems:
                    stems[w[:n]].append(w)
    candidates = {(w, False): [w] for w, (other, toxic) in documents.items() if len(toxic) >= LEAST_DOCUMENTS}
    candidates |= {(s, True): words for s, words in stems.items() if len(words) >= 4}
    explained: dict[int, int] = defaultdict(int)

    def worth(words: list[str]) -> float:
        other = set().union(*(documents[w][0] for w in words))
        every = set().union(*(documents[w][1] for w in words))
        toxic = every if len(every) >= COMMON_SHARE * sizes[1] else {i for i in every if explained[i] < EXPLAINED}
        if len(toxic) < LEAST_DOCUMENTS or len(other) * sizes[1] * 10 > len(toxic) * sizes[0]:
            return 0.0
        return _evidence(len(toxic), len(other), sizes[1], sizes[0])

    # evidence only falls as texts are explained: recount the best until it stays the best
    queue = [(-worth(words), -len(term), term, stem) for (term, stem), words in candidates.items()]
    queue = [q for q in queue if -q[0] >= LEAST_EVIDENCE]
    heapq.heapify(queue)
    out: dict[str, bool] = {}
    gone: set[str] = set()
    while queue and len(out) < most_terms:
        _, length, term, stem = heapq.heappop(queue)
        left = [w for w in candidates[term, stem] if w not in gone]
        now = worth(left) if left else 0.0
        if now < LEAST_EVIDENCE:
            continue
        entry = (-now, length, term, stem)
        if queue and entry > queue[0]:
            heapq.heappush(queue, entry)
            continue
        out[term] = stem
        gone.update(left)
        for w in left:
            for i in documents[w][1]:
                explained[i] += 1
    return out


# --- documents ---------------------------------------------------------------------------

FEATURES = 6  # 1, exact hits, by stem, near hits, near hits by stem, hits in quotation or report
_REPORTED = 5
_BREAK = "\x1e"


def _is_reported(words: Words, i: int, low: int, high: int) -> bool:
    """Whether word i stands in quotation marks, or after a word of report, among words ``low`` to ``high`` - 1."""
    start, end = words.starts[i], words.ends[i]
    low = max(low, i - CONTEXT_WORDS, int(np.searchsorted(words.starts, start - CONTEXT_CHARS)))
    high = min(high, i + CONTEXT_WORDS + 1, int(np.searchsorted(words.ends, end + CONTEXT_CHARS, "right")))
    before = words.codes[words.starts[low] : start]
    after = words.codes[end : words.ends[high - 1] + 1]
    if np.isin(before, _QUOTE_CODES).sum() % 2 == 1 and np.isin(after, _QUOTE_CODES).any():
        return True
    return any(words.word(j) in _REPORT for j in range(max(low, i - 3), i))


_QUOTE_CODES = np.array([ord(c) for c in QUOTES], np.uint32)
_REPORT = frozenset(REPORT)


def _pieces(text: str) -> Iterator[tuple[str, int, int]]:
    """A text in pieces with the context of their first and last words, and where in the
    lower-cased piece the part that is its own starts and ends.

    Context reaches to a space beyond ``CONTEXT_CHARS``, so that no word of it is cut.
    """
    at = 0
    for own in safe_pieces(text, RUN_CHARS):
        end = at + len(own)
        first = max(text.rfind(" ", 0, max(at - CONTEXT_CHARS, 0)), 0) if at else 0
        last = text.find(" ", end + CONTEXT_CHARS) if end < len(text) else end
        before, after = text[first:at].lower(), text[end : last if last >= 0 else len(text)].lower()
        own = own.lower()
        yield before + own + after, len(before), len(before) + len(own)
        at = end


def hit_features(automaton: Automaton, texts: list[str]) -> np.ndarray:
    """The features of each text, whatever texts stand beside it.

    Short texts are read together, parted by a control character; long ones in pieces that
    end at a space, whose hits add up.
    """
    out = np.zeros((len(texts), FEATURES))
    out[:, 0] = 1
    run: list[tuple[str, int, int]] = []
    owners: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        for piece in _pieces(text.replace(_BREAK, " ")):
            run.append(piece)
            owners.append(i)
            held += len(piece[0])
            if held >= RUN_CHARS:
                _add_hits(automaton, run, owners, out)
                run, owners, held = [], [], 0
    if run:
        _add_hits(automaton, run, owners, out)
    out[:, 1:] = np.log1p(np.minimum(out[:, 1:], 20))
    return out


def _add_hits(automaton: Automaton, run: list[tuple[str, int, int]], owners: list[int], out: np.ndarray) -> None:
    words = Words(_BREAK.join(piece for piece, _, _ in run))
    breaks = np.flatnonzero(words.codes == ord(_BREAK))
    kinds = automaton.read(words)
    hits = np.flatnonzero(kinds)
    piece = np.searchsorted(breaks, words.starts[hits])
    starts = np.concatenate(([0], breaks + 1))
    first_word = np.append(np.searchsorted(words.starts, starts), len(words.starts))
    place = words.starts[hits] - starts[piece]
    for i, own, kind, at in zip(hits.tolist(), piece.tolist(), kinds[hits].tolist(), place.tolist()):
        _, a, b = run[own]
        if a <= at < b:
            reported = _is_reported(words, i, int(first_word[own]), int(first_word[own + 1]))
            out[owners[own], _REPORTED if reported else kind] += 1


#: What the weights are before any label is seen, and how firmly: hits count, near ones a
#: little less, reported ones hardly.
PRIOR = np.array([-4.0, 6.0, 5.0, 4.0, 4.0, 1.0])
FIRMNESS = np.array([0.5, 0.5, 0.5, 4.0, 4.0, 4.0])


def fit_weights(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression around the prior, by Newton's method; classes weigh the same."""
    weights = PRIOR.copy()
    if not len(x):
        return weights
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))
        slope = x.T @ (share * (y - p)) - FIRMNESS * (weights - PRIOR)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(FIRMNESS)
        move = np.linalg.solve(curve, slope)
        weights = weights + move / max(1.0, np.abs(move).max())
    return weights


class ToxicityModel:
    def __init__(
        self, lexicon: dict[str, bool], weights: np.ndarray | None = None, allowed: dict[str, int] | None = None
    ):
        self.lexicon, self.automaton = lexicon, Automaton(lexicon, allowed)
        self.weights = PRIOR.copy() if weights is None else weights

    def scores(self, texts: list[str]) -> np.ndarray:
        # added up feature by feature, so that a text's score does not depend on the others' number
        x = hit_features(self.automaton, texts)
        total = np.zeros(len(texts))
        for feature, weight in zip(x.T, self.weights):
            total += feature * weight
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

    @classmethod
    def fit(cls, texts: list[tuple[str, int]], most_terms: int = MOST_TERMS) -> ToxicityModel:
        lexicon = learn_lexicon(texts, most_terms)
        model = cls(lexicon, allowed=learn_edits(texts, lexicon))
        if texts:
            x = hit_features(model.automaton, [t for t, _ in texts])
            model.weights = fit_weights(x, np.array([y for _, y in texts], np.float64))
        return model


def fit_model(
    docs: DataFrame,
    labels: DataFrame,
    rows_per_class: int = TRAINING_ROWS,
    most_terms: int = MOST_TERMS,
    most_chars: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    """Lexicon and weights from at most ``rows_per_class`` labelled documents of each label.

    Rows held out and documents of more than ``most_chars`` characters do not train.  What
    the driver gathers is bounded by these parameters.  Without labels the lexicon is empty.
    """
    importable_on_workers(docs.sparkSession)
    rows = training_rows(id_and_text(docs, id_col, text_col), labels, "toxic", rows_per_class)
    table = rows.filter(F.length("text") <= most_chars).toArrow()
    texts = sorted(zip(table.column("text").to_pylist(), table.column("label").to_pylist()))
    return ToxicityModel.fit(texts, most_terms)


def scorer(model) -> Callable:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.scores([t or "" for t in texts]), dtype="float64")

    return score


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    rows_per_class: int = TRAINING_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if the score reaches the threshold).

    Scores read the text alone.  Null and empty texts have no hit.  Null ids are not held
    out.  Repeated rows: a row each.  Empty table: no rows.  Other columns are not read.
    """
    model = fit_model(docs, labels, rows_per_class, id_col=id_col, text_col=text_col)
    # the automaton's size is bounded by the number of terms and their lengths
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = id_and_text(docs, id_col, text_col).select("doc_id", scorer(sent)("text").alias("score"))
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted")
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", predicted)
