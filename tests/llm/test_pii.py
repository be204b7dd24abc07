from __future__ import annotations

import math
import random
import re

import brute
import pytest
import regex
from brute import ODD, SMALL

from campaign_analytics.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for place, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), place, kind, m.end()))
    return sorted(out)


def row(text):
    spans = base(text)
    n = [sum(s[2] == k for s in spans) for k in PLAIN]
    return (*n, brute.sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)))


def test_base_spans(spark, documents):
    found = {r[0]: tuple(r)[1:6] for r in queries.op6_pii(spark, SMALL).collect()}
    assert found == {i: row(t) for i, t in documents}


def test_base_spans_of_hard_texts(spark):
    rng = random.Random(6)
    parts = [
        "a@b.c", "@", ".", "..", "x_y%z", "1.2.3.4", "256.1.1.1", "001.0255.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112",
        "+1 (386) 555-3733", "+", "12", "7", " ", "-", "é", "😀", "(", ")", "abc.def@ghi.jk-l.m_n@o.pq", "5555555555554444", "\n",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(3000)]
    texts += ["1" * 5000, "1 " * 4000, "a" * 20000, "a@" + ".b" * 5000, "9.9.9.9 " * 1500, "+1" + "-2" * 4000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r[0]: tuple(r)[1:6] for r in pii.span_report(frame).collect()}
    wrong = [t[:200] for i, t in enumerate(texts) if found[i] != row(t)]
    assert not wrong, wrong[:3]


def _disclosing(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=6))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = []
    for i in range(40):
        text = f"{line(9)} write to Zebulon, zeb@mail.example.com today {line(9)}" if i % 4 == 0 else f"{line(9)} other{i}@b.example {line(9)} today"
        texts.append((i, text))
    texts.append((40, line(12) + " ask (Zebulon) " + line(3)))
    texts += [(i, "write to us today " + line(5)) for i in range(41, 60)]
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_terms_that_disclose_an_entity(spark):
    frame = _disclosing(spark)
    rows = {r["doc_id"]: r for r in pii.span_report(frame).collect()}
    text = {r[0]: r[1] for r in frame.collect()}
    for i in (0, 40):
        at = text[i].index("Zebulon")
        assert f"term:{at}:{at + 7}" in rows[i]["spans"]
    assert not any("term" in rows[i]["spans"] for i in range(41, 60))
    cleaned = {r[0]: r[1] for r in pii.sanitise(frame).collect()}
    assert "[EMAIL]" in cleaned[0] and "Zebulon" not in cleaned[0] and "Zebulon" not in cleaned[40]
    assert cleaned[41] == text[41]


def test_copies_of_one_text_disclose_nothing(spark):
    frame = spark.createDataFrame(
        [(i, "some unusual words around me@site.example are copied often") for i in range(30)], "doc_id long, text string"
    )
    assert {r["spans"] for r in pii.span_report(frame).collect()} == {"email:26:41"}


def test_sanitised_texts_hold_no_base_span(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    cleaned = pii.sanitise(docs)
    assert cleaned.columns == docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = cleaned.collect()
    assert len(rows) == len(before)
    for r in rows:
        assert not base(r["text"]) and r["n_chars"] == len(r["text"])


def test_odd_rows(odd, empty):
    found = pii.span_report(odd)
    assert sorted(repr(tuple(r)[:6]) for r in found.collect()) == sorted(repr((i, *row(t))) for i, t in ODD)
    assert pii.span_report(empty).collect() == []
    assert pii.sanitise(odd).columns == odd.columns and pii.sanitise(odd).count() == len(ODD)
    assert pii.sanitise(empty).count() == 0


BETWEEN = regex.compile(r"[^\p{L}\p{N}]*[\x20\x09-\x0D][^\p{L}\p{N}]*")
EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def terms_of(text):
    return BETWEEN.split(EDGES.sub("", text.lower()))


def disclosing(docs, min_contexts=2, min_share=0.5):
    """{term: share} by the production rule, of texts whose only entities are email addresses."""
    windows, together, named = {}, {}, {}
    for doc, (_, text) in enumerate(docs):
        found = list(re.finditer(PLAIN["email"], text))
        for i, m in enumerate(found):
            gap_before = text[found[i - 1].end() if i else 0 : m.start()]
            gap_after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else None]
            before, after = gap_before[-48:], gap_after[:48]
            entity = m[0].lower()
            named.setdefault(entity, set()).add(doc)
            around = terms_of(before)[len(gap_before) > 48 :]
            last = terms_of(after)
            around += last[:-1] if len(gap_after) > 48 else last
            for t in set(around):
                if len(t) >= 3 and regex.search(r"\p{L}", t):
                    windows.setdefault((entity, t), set()).add((before, after))
                    together.setdefault((entity, t), set()).add(doc)
    out = {}
    for (entity, t), contexts in windows.items():
        having = sum(t in terms_of(text) for _, text in docs)
        share, rate = min(1.0, len(together[entity, t]) / having), len(named[entity]) / len(docs)
        if len(contexts) < min_contexts or share < min_share or share <= rate:
            continue
        far = share * math.log(share / rate)
        if share < 1:
            far += (1 - share) * math.log((1 - share) / (1 - rate))
        if having * far >= math.log(len(windows)):
            out[t] = max(share, out.get(t, 0))
    return out


def _corpus(seed, size=150):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdk" for b in "aeiou" for c in ("rn", "st", "lm")]
    entities = [f"{w}@mail{i}.example" for i, w in enumerate(vocabulary[:12])]
    docs = []
    for i in range(size):
        words = rng.choices(vocabulary[:30], k=rng.randrange(3, 30))
        for _ in range(rng.randrange(3)):
            e = rng.randrange(len(entities))
            at = rng.randrange(len(words) + 1)
            near = ["(" + vocabulary[-1 - e].title() + "),", entities[e].title() if rng.random() < 0.2 else entities[e]]
            words[at:at] = near[:: rng.choice([1, 1, -1])]
        if rng.random() < 0.2:
            words.append(rng.choice(vocabulary[-12:]))
        docs.append((i, rng.choice([" ", "  ", "\n", " - "]).join(words)))
    return docs


@pytest.mark.parametrize("seed", [12, 13])
@pytest.mark.parametrize("listed", [10_000, 0])
def test_disclosing_terms_against_brute_force(spark, monkeypatch, seed, listed):
    monkeypatch.setattr(pii, "_LISTED_TERMS", listed)
    docs = _corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    terms = pii.disclosing_terms(frame, pii.base_spans(frame)).collect()
    wanted = disclosing(docs)
    assert len(wanted) > 3
    assert {r["term"]: round(r["share"], 9) for r in terms} == {t: round(share, 9) for t, share in wanted.items()}


def test_words_at_the_ends_of_texts_are_whole(spark):
    frame = spark.createDataFrame([(i, "Zebulon zeb@mail.example.com") for i in range(29)] + [(30, "plain")], "doc_id long, text string")
    terms = pii.disclosing_terms(frame, pii.base_spans(frame), min_contexts=1).collect()
    assert [r["term"] for r in terms] == ["zebulon"]


LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def cut(text, spans, shares):
    """``text`` without the reported spans, overlapping ones as one."""
    out, reach = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], [*LABELS, "term"].index(s[0]))):
        if a >= reach:
            term = terms_of(text[a:b])[0] if kind == "term" else None
            out += [text[reach:a], LABELS[kind] if kind != "term" else "" if shares[term] >= 0.9 else "[TERM]"]
        reach = max(reach, b)
    return "".join(out) + text[reach:]


def reported(row):
    parts = [s.split(":") for s in row["spans"].split(",") if s]
    return [(k, int(a), int(b)) for k, a, b in parts]


def test_sanitised_text_is_the_text_without_the_reported_spans(spark):
    docs = _corpus(14, 300)
    rng = random.Random(4)
    extra = ["4111 1111 Zebulon 1111 1111", "+1 4111 1111 1111 1111 5", "mail a@b.c,9.9.9.9;+4911 222 333 444", "x" * 4095 + " a@b.c", "é" * 5000]
    docs += [(1000 + i, t) for i, t in enumerate(extra)]
    docs += [(2000 + i, " ".join(rng.choices(["Brn", "a@b.c", "9.9.9.9", "word", "é😀"], k=3000))) for i in range(3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    shares = {r["term"]: r["share"] for r in pii.disclosing_terms(frame, pii.base_spans(frame)).collect()}
    assert shares
    spans = {r["doc_id"]: reported(r) for r in pii.span_report(frame).collect()}
    assert any(k == "term" for own in spans.values() for k, _, _ in own)
    cleaned = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    for i, text in docs:
        assert cleaned[i] == cut(text, spans[i], shares), i
    assert cleaned[1000] == docs[-8][1]


def test_sanitised_table_agrees_with_its_report(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    shares = {r["term"]: r["share"] for r in pii.disclosing_terms(docs, pii.base_spans(docs)).collect()}
    spans = {r["doc_id"]: reported(r) for r in pii.span_report(docs).collect()}
    for r in pii.sanitise(docs).collect():
        assert (r["text"] or "") == cut(text[r["doc_id"]], spans[r["doc_id"]], shares)


def test_frequent_entities_are_disclosed_with_production_defaults(spark):
    frame = _disclosing(spark)
    rows = {r["doc_id"]: r["spans"] for r in pii.span_report(frame).collect()}
    text = {r[0]: r[1] for r in frame.collect()}
    for i in (0, 40):
        at = text[i].index("Zebulon")
        assert f"term:{at}:{at + 7}" in rows[i]
    assert not any("term" in rows[i] for i in range(41, 60))
    cleaned = {r[0]: r[1] for r in pii.sanitise(frame).collect()}
    assert "Zebulon" not in cleaned[0] and "Zebulon" not in cleaned[40] and cleaned[41] == text[41]


def test_two_windows_suffice_for_a_rare_term(spark):
    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choices("abcdefghijkl", k=6)) for _ in range(n))
    texts = [(i, f"{line(9)} other{i}@b.example {line(9)}") for i in range(400)]
    texts += [(i, f"{line(9)} write Quillon zeb@mail.example.com today {line(9)}") for i in (400, 401)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    terms = {r["term"] for r in pii.disclosing_terms(frame, pii.base_spans(frame)).collect()}
    assert "quillon" in terms and not any(len(t) == 6 for t in terms)
