"""Operator 6: personal data and what discloses it, with DataFrame functions only.

Base spans of four kinds come from patterns and checks.  Then the corpus tells which terms
disclose a protected entity (one email address, one number): around every occurrence the
words of a window are paired with the entity; a term's strength is the share of all documents
with it that have it in windows of that entity, if chance does not explain so many.  Terms beyond
the threshold become spans too.  Sanitising cuts the text at these spans: base spans are replaced
by their kind, terms are generalised, and the strongest are removed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_utf8, free_names, materialise

# Fixed values of the contract: kinds in order, patterns, digits allowed.  The patterns match
# the same spans as the plain ones and stay linear: a run of characters is not tried again
# from its middle, and a card needs its twelve digits to match at all.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match of the kind must hold; most texts are passed over by this alone.
_HOLDS = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
}
CARD_DIGITS = (12, 19)
PHONE_DIGITS = (9, 15)

TERM = "term"
#: Characters on each side of an occurrence whose whole words are its window.
WINDOW_CHARS = 48
MIN_CONTEXTS = 2
MIN_SHARE = 0.5
REMOVE_SHARE = 0.9
#: The expected number of pairs of term and entity in a corpus that chance alone makes disclosing.
MOST_BY_CHANCE = 1.0
MIN_TERM_CHARS = 3
#: Terms, and documents with a term, up to which a list of them is sent to all tasks.
_BROADCAST_ROWS = 100_000
#: Candidate terms up to which each text is reduced to the candidates in it before it is exploded.
_LISTED_TERMS = 10_000
_BLOCK = 512
#: Code points of the parts that a text is cut in, so that no cut reads a whole long text.
_PART = 4096
#: What parts a text's terms: white space with all that is no letter or digit around it.
_BETWEEN = r"[^\p{L}\p{N}]*[\x20\x09-\x0D][^\p{L}\p{N}]*"
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_BEFORE_WORD = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, first: Column, step) -> Column:
    """``first`` and what ``step`` makes of it with the first 1, 2, ... numbers of an array of few."""
    return F.aggregate(values, F.array(first), lambda found, x: F.array_append(found, step(F.element_at(found, -1), x)))


def _prefixes(values: Column, step) -> Column:
    """What ``step`` (a sum or a maximum of numbers from 0) makes of the first 1, 2, ... numbers of
    an array, by blocks, so that none is copied often."""
    zero = F.lit(0).cast("long")

    def by_blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(v) - 1, F.lit(_BLOCK))
        return F.transform(starts, lambda a: F.slice(_running(F.slice(v, a + 1, _BLOCK), zero, step), 2, _BLOCK))

    def joined(blocks: Column) -> Column:
        before = _running(F.transform(blocks, lambda b: F.element_at(b, -1)), zero, step)
        return _let(before, lambda o: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: step(x, o[i])))))

    return _let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(_let(by_blocks(v), joined)))


def _prefix_sums(values: Column) -> Column:
    return _prefixes(values, lambda a, b: a + b)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right counts double."""
    places = F.split(F.reverse(digits), "")
    doubled = F.transform(
        F.filter(places, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2).cast("int")),
    )
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    """Whether a match of the pattern is of its kind."""
    if kind == "ip":
        # longer parts are above 255 whatever they are, unless led by zeros
        parts = F.split(value, r"\.")
        return F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3)) & F.forall(
            parts, lambda p: F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(*CARD_DIGITS) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(*PHONE_DIGITS)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """One form for all spellings of a value."""
    return F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value)


_SPANS = "array<struct<start:bigint,kind:int,end:bigint,entity:bigint,before:string,after:string,whole_before:boolean,"
_SPANS += "whole_after:boolean>>"


def _matches(kind: str, text: Column) -> Column:
    """Struct of all matches and of the text before, between and after them; null if there are none."""
    pattern = PATTERNS[kind]
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
        F.split(text, pattern, -1).alias("gaps"),
    )
    return F.when(text.rlike(_HOLDS[kind]) & text.rlike(pattern), found)


def kind_spans(kind: str, text: Column) -> Column:
    """The valid spans of one kind, by start, with the entity meant and the text around it."""

    def spans(found: Column) -> Column:
        matches, gaps = found["matches"], found["gaps"]
        lengths = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
        ends = _prefix_sums(F.transform(lengths, lambda n: n.cast("long")))
        placed = F.zip_with(matches, ends, lambda m, e: F.struct(m.alias("value"), e.alias("end")))
        all_spans = F.transform(
            placed,
            lambda s, i: F.struct(
                (s["end"] - F.length(s["value"])).alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                s["end"].alias("end"),
                F.when(is_valid(kind, s["value"]), F.xxhash64(F.lit(kind), _entity(kind, s["value"]))).alias("entity"),
                F.right(gaps[i], F.lit(WINDOW_CHARS)).alias("before"),
                F.left(gaps[i + 1], F.lit(WINDOW_CHARS)).alias("after"),
                (F.length(gaps[i]) <= WINDOW_CHARS).alias("whole_before"),
                (F.length(gaps[i + 1]) <= WINDOW_CHARS).alias("whole_after"),
            ),
        )
        return F.filter(all_spans, lambda s: s["entity"].isNotNull())

    found = _let(text, lambda t: _matches(kind, t))
    return F.coalesce(_let(found, lambda f: F.when(f.isNotNull(), spans(f))).cast(_SPANS), F.array().cast(_SPANS))


def base_spans(rows: DataFrame) -> DataFrame:
    """doc_key, doc_id and the base spans of every row of (doc_id, text), by start and kind."""
    spans = rows.withColumns({f"of_{k}": kind_spans(k, F.col("text")) for k in KINDS})
    return spans.select(
        F.xxhash64("doc_id", "text").alias("doc_key"),
        "doc_id",
        F.array_sort(F.concat(*[f"of_{k}" for k in KINDS])).alias("spans"),
    )


def _terms(text: Column) -> Column:
    """The terms of a text in order; what is no letter or digit is taken off the first and the last one too."""

    def stripped(words: Column, start: int | Column) -> Column:
        return F.transform(F.slice(words, start, 1), lambda w: F.regexp_replace(w, _EDGES, ""))

    def parts(words: Column) -> Column:
        inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
        last = F.when(F.size(words) > 1, stripped(words, F.size(words))).otherwise(F.array().cast("array<string>"))
        return F.concat(stripped(words, 1), inner, last)

    return _let(F.split(F.lower(text), _BETWEEN), parts)


def _window_terms(span: str) -> Column:
    """The terms around a span; the outer word of a side is left out where the window may cut it."""
    before, after = _terms(F.col(f"{span}.before")), _terms(F.col(f"{span}.after"))
    cut_before = F.slice(before, 2, F.greatest(F.size(before) - 1, F.lit(0)))
    cut_after = F.slice(after, 1, F.greatest(F.size(after) - 1, F.lit(0)))
    inner = F.concat(
        F.when(F.col(f"{span}.whole_before"), before).otherwise(cut_before),
        F.when(F.col(f"{span}.whole_after"), after).otherwise(cut_after),
    )
    return F.array_distinct(inner)


def _is_term(word: Column) -> Column:
    return (F.length(word) >= MIN_TERM_CHARS) & word.rlike(r"\p{L}")


def _limited(table: DataFrame) -> DataFrame:
    """A small table as one that is sent to all tasks; a larger one is left to a shuffle."""
    return F.broadcast(table) if table.count() <= _BROADCAST_ROWS else table


def _words_among(rows: DataFrame, candidates: DataFrame, *kept: Column) -> DataFrame:
    """``kept`` and ``term``: each row's different words that are among the candidate terms.

    A list of few candidates is sent along, and a text gives only its candidates; with more,
    all words of a text are joined to them.
    """
    listed = [r["term"] for r in candidates.limit(_LISTED_TERMS + 1).collect()]
    words = _terms(F.col("text"))
    if len(listed) <= _LISTED_TERMS:
        wanted = F.array(*[F.lit(t) for t in sorted(listed)]).cast("array<string>")
        return rows.select(*kept, F.explode(F.array_intersect(words, wanted)).alias("term"))
    each = rows.select(*kept, F.explode(F.array_distinct(words)).alias("term"))
    return each.join(_limited(candidates), "term", "left_semi")


def disclosing_terms(
    rows: DataFrame, base: DataFrame, min_contexts: int = MIN_CONTEXTS, min_share: float = MIN_SHARE
) -> DataFrame:
    """term, share: terms of (doc_id, text) ``rows`` that disclose an entity of ``base``.

    ``share`` is the part of all documents with the term that have it in a window of the
    entity.  A pair counts only with ``min_contexts`` different windows, so copies of one text are
    one, and only if chance does not explain it: by Chernoff's bound on the documents with the
    term that name the entity, times the number of pairs.
    """
    spans = base.select("doc_key", F.explode("spans").alias("s"))
    near = spans.select(
        "doc_key", "s.entity", F.xxhash64("s.before", "s.after").alias("context"), F.explode(_window_terms("s")).alias("term")
    )
    near = near.filter(_is_term(F.col("term"))).distinct()
    pairs = near.groupBy("entity", "term").agg(
        F.count_distinct("context").alias("contexts"), F.count_distinct("doc_key").alias("together")
    )
    pairs = materialise(pairs)
    tried = pairs.count()
    pairs = pairs.filter(F.col("contexts") >= min_contexts)
    # the documents with the term in any window are some of those with the term, so the share
    # is at most this; it spares the corpus count the words that stand near all entities
    anywhere = near.groupBy("term").agg(F.count_distinct("doc_key").alias("near_any"))
    pairs = materialise(pairs.join(anywhere, "term").filter(F.col("together") >= min_share * F.col("near_any")))
    candidates = pairs.select("term").distinct()
    if candidates.isEmpty():
        return materialise(candidates.withColumn("share", F.lit(0.0)))
    # one row for each term and task is shuffled
    counted = _words_among(rows, candidates).groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    named = spans.select("s.entity", "doc_key").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("named"))
    share = F.least(F.col("together") / F.col("documents"), F.lit(1.0))
    rate = F.col("named") / F.lit(max(rows.count(), 1))  # of all documents, those that name the entity

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log(p / q)).otherwise(0.0)

    far = F.when(rate >= 1, 0.0).otherwise(part(share, rate) + part(1 - share, 1 - rate))
    strong = (share > rate) & (F.col("documents") * far >= math.log(max(tried, 1) / MOST_BY_CHANCE))
    strength = pairs.join(counted, "term").join(named, "entity").filter((share >= min_share) & strong)
    return materialise(strength.groupBy("term").agg(F.max(share).alias("share")))


def _documents_with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_key, found (the disclosing terms of the document and their shares) of those that have some."""
    words = _words_among(rows, terms.select("term"), F.xxhash64("doc_id", "text").alias("doc_key"))
    held = words.distinct().join(_limited(terms), "term")
    found = F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("found")
    return materialise(held.groupBy("doc_key").agg(found))


def _term_of(piece: Column) -> Column:
    return F.regexp_replace(F.lower(F.rtrim(F.regexp_replace(piece, r"[\x20\x09-\x0D]+$", ""))), _EDGES, "")


def _term_spans(text: Column, found: Column) -> Column:
    """Spans of the words of ``text`` that are terms in the map ``found``, and their shares."""

    def spans(pieces: Column) -> Column:
        ends = _prefix_sums(F.transform(pieces, lambda p: F.length(p).cast("long")))
        placed = F.zip_with(pieces, ends, lambda p, e: F.struct(p.alias("piece"), (e - F.length(p)).alias("at")))
        hits = F.filter(placed, lambda s: F.map_contains_key(found, _term_of(s["piece"])))

        def edges(hit: Column) -> Column:
            piece, at = hit["piece"], hit["at"]
            from_first = F.length(F.regexp_replace(piece, r"^[^\p{L}\p{N}]+", ""))
            to_last = F.length(F.regexp_replace(piece, r"[^\p{L}\p{N}]+$", ""))
            start, end = (at + F.length(piece) - from_first).alias("start"), (at + to_last).alias("end")
            return F.struct(start, end, found[_term_of(piece)].alias("share"))

        return F.transform(hits, edges)

    return _let(F.split(text, _BEFORE_WORD), spans)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end; base kinds, then terms, by start).

    Offsets count code points, ends are exclusive.  Null and empty texts have no spans.  Null
    or repeated ids: a row each.  Empty table: no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), as_utf8(text_col).alias("text"))
    base = materialise(base_spans(rows))
    terms = disclosing_terms(rows, base, **thresholds)
    names = F.array(*[F.lit(k) for k in KINDS])

    def span(s: Column, place: Column, kind: Column) -> Column:
        return F.struct(s["start"].alias("start"), place.alias("place"), kind.alias("kind"), s["end"].alias("end"))

    named = F.transform("spans", lambda s: span(s, s["kind"], names[s["kind"]]))
    out = base.select("doc_key", "doc_id", named.alias("spans"))
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    if terms.isEmpty():
        return out.select("doc_id", "spans", none.alias("term_spans"))
    held = _documents_with_terms(rows, terms)
    texts = rows.withColumn("doc_key", F.xxhash64("doc_id", "text")).join(_limited(held), "doc_key")
    own = F.transform(
        _term_spans(F.col("text"), F.col("found")), lambda s: span(s, F.lit(len(KINDS)), F.lit(TERM))
    )
    term_spans = materialise(texts.select("doc_key", own.alias("term_spans")).dropDuplicates(["doc_key"]))
    joined = out.join(_limited(term_spans), "doc_key", "left")
    return joined.select("doc_id", "spans", F.coalesce("term_spans", none).alias("term_spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans as kind:start:end lists."""
    found = find_spans(docs, id_col, text_col, **thresholds)

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    every = F.array_sort(F.concat("spans", "term_spans"))
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(every).alias("spans")
    )


def _cut(text: Column, spans: Column) -> Column:
    """``text`` with its spans (start, end, label; in order) replaced by their labels.

    Spans that overlap are one cut, with the label of the first.
    """

    def with_reach(s: Column) -> Column:
        ends = _prefixes(F.transform(s, lambda x: x["end"]), F.greatest)
        return _let(
            ends,
            lambda e: F.transform(
                s,
                lambda x, i: F.struct(
                    F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(e, i - 1)).alias("open"),
                    x["start"].alias("start"),
                    e[i].alias("reach"),
                    x["label"].alias("label"),
                ),
            ),
        )

    def inside(block: Column, at: Column, a: Column, b: Column) -> Column:
        """What of the text from a to b is in the block, which starts at ``at``."""
        first = F.greatest(a - at, F.lit(0).cast("long"))
        return F.substring(block, (first + 1).cast("int"), F.greatest(b - at - first, F.lit(0).cast("long")).cast("int"))

    def block_of(block: Column, at: Column, cuts: Column) -> Column:
        end = at + F.length(block)
        own = F.filter(cuts, lambda c: (c["start"] >= c["open"]) & (c["open"] < end) & (c["start"] >= at))
        pieces = F.transform(
            own,
            lambda c: F.concat(
                inside(block, at, c["open"], c["start"]),
                F.when(c["start"].between(at, end - 1), c["label"]).otherwise(""),
            ),
        )
        rest = inside(block, at, F.element_at(cuts, -1)["reach"], end)
        return F.concat(F.array_join(pieces, ""), rest)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0))
    done = _let(
        with_reach(spans),
        lambda cuts: F.array_join(
            F.transform(blocks, lambda block, i: block_of(block, i.cast("long") * _PART, cuts)), ""
        ),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


_LABELLED = "array<struct<start:bigint,kind:int,end:bigint,label:string>>"


def _labelled(text: Column, term_spans: Column | None) -> Column:
    """All spans of a text in order, each with what is put in its place."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def base(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), labels[s["kind"]].alias("label"))

    def term(s: Column) -> Column:
        label = F.when(s["share"] >= REMOVE_SHARE, "").otherwise("[TERM]")
        return F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end"), label.alias("label"))

    parts = [F.transform(kind_spans(k, text), base).cast(_LABELLED) for k in KINDS]
    if term_spans is not None:
        parts.append(F.transform(term_spans, term).cast(_LABELLED))
    return F.array_sort(F.concat(*parts))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """``docs`` with base spans as [EMAIL], [IP], [CARD], [PHONE], and disclosing terms removed or as [TERM].

    What is replaced are the spans that :func:`find_spans` gives of the text as it came in;
    overlapping ones are one cut.  All rows and columns stay, whatever their names; ``n_chars``,
    if there, follows the text.  Null and empty texts stay as they are.  Null and repeated ids, and
    repeated rows, are cut row by row.  Empty table: no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), as_utf8(text_col).alias("text"))
    base = materialise(base_spans(rows))
    terms = disclosing_terms(rows, base, **thresholds)
    out = docs.withColumn(text_col, as_utf8(text_col))
    text = F.col(text_col)
    plain = _let(_labelled(text, None), lambda s: _cut(text, s))
    if terms.isEmpty():
        out = out.withColumn(text_col, plain)
    else:
        key, found = free_names(docs, "pii_key", "pii_found")
        held = _documents_with_terms(rows, terms).withColumnsRenamed({"doc_key": key, "found": found})
        out = out.withColumn(key, F.xxhash64(id_col, text_col)).join(_limited(held), key, "left")
        both = _let(_labelled(text, _term_spans(text, F.col(found))), lambda s: _cut(text, s))
        out = out.withColumn(text_col, F.when(F.col(found).isNotNull(), both).otherwise(plain))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
