from __future__ import annotations

import random

import numpy as np
from brute import ODD, SMALL

from campaign_analytics.llm import queries, toxicity

TERMS = {"idiot": False, "worthless": False, "scum": False, "clown": False, "lowei": True}


def kinds(text):
    words = toxicity.Words(text)
    found = toxicity.Automaton(TERMS).read(words)
    return {words.word(i): int(found[i]) for i in range(len(found))}


def test_automaton_agrees_with_the_table_of_distances():
    automaton = toxicity.Automaton(TERMS)
    rng = random.Random(3)
    words = []
    for _ in range(4000):
        w = list(rng.choice(["idiot", "worthless", "scum", "clown", "lowei", "clot"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choices("idotwrhlescunx", k=rng.randrange(2))
        words.append("".join(w) or "x")
    read = automaton.read(toxicity.Words(" ".join(words)))
    for word, kind in zip(words, read.tolist(), strict=True):
        found = {toxicity.match_kind(word, t, stem) for t, stem in TERMS.items()}
        # beginning with a stem goes before all, for it holds whatever follows
        order = [toxicity.STEM, toxicity.EXACT, toxicity.NEAR, toxicity.NEAR_STEM, 0]
        assert kind == next(k for k in order if k in found or k == 0), word


def test_misspellings():
    assert kinds("Idiot! id1ot idioot 1d10t wortless w0rthles clow loweischaft scun skum st*r an id*ot loveiding lovi") == {
        "idiot": 1, "id1ot": 1, "idioot": 3, "1d10t": 1, "wortless": 3, "w0rthles": 3, "clow": 3, "loweischaft": 2,
        "scun": 3, "skum": 3, "st*r": 0, "an": 0, "id*ot": 3, "loveiding": 4, "lovi": 0,
    }
    assert kinds("\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d \uff29\uff24\uff29\uff2f\uff34 \U0001f602") == {"idiot": 1}


def test_edits_that_clean_texts_need_are_given_up():
    clean = [(f"the sum of it all is plain {i}", 0) for i in range(300)]
    toxic = [(f"scum and clown {i}", 1) for i in range(30)]
    lexicon = {"scum": False, "clown": False, "worthless": False}
    assert toxicity.learn_edits(clean + toxic, lexicon) == {"scum": 0}


NEIGHBOURS = [
    "zorbish people here", "a plain text he said", "that is what she said", '"', 'a "', '" and zorbish "', "zorbish",
    "he wrote", "", "insult", "quote the word", "zorbishly",
]


def test_a_score_is_that_of_the_text_alone():
    model = toxicity.ToxicityModel({"zorbish": False, "scum": False})
    alone = {t: model.scores([t])[0] for t in NEIGHBOURS}
    assert alone["zorbish people here"] > 0.5 > alone["a plain text he said"]
    rng = random.Random(5)
    for _ in range(60):
        batch = rng.choices(NEIGHBOURS, k=rng.randrange(1, 12))
        assert model.scores(batch).tolist() == [alone[t] for t in batch]


def test_every_score_of_a_table_is_that_of_the_text_alone(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_model(docs, labels)
    texts = [r[0] or "" for r in docs.select("text").collect()]
    alone = {t: model.scores([t])[0] for t in texts}
    random.Random(8).shuffle(texts)
    assert model.scores(texts).tolist() == [alone[t] for t in texts]


def plain_features(model, text):
    """Hits by kind, from every word by the table of distances and its context word by word."""
    words = toxicity.Words(text)
    spans = list(zip(words.starts.tolist(), words.ends.tolist()))
    order = [toxicity.STEM, toxicity.EXACT, toxicity.NEAR, toxicity.NEAR_STEM]
    out = [1.0] + [0] * 5
    for i, (a, b) in enumerate(spans):
        folded = "".join(toxicity.LOOKALIKES.get(c, c) for c in text.lower()[a:b])
        found = {toxicity.match_kind(folded, t, stem) for t, stem in model.lexicon.items()}
        kind = next((k for k in order if k in found), 0)
        if not kind:
            continue
        before = text[spans[max(i - 6, 0)][0] : a]
        after = text[b : spans[min(i + 6, len(spans) - 1)][1] + 1]
        quoted = sum(c in toxicity.QUOTES for c in before) % 2 and any(c in toxicity.QUOTES for c in after)
        told = any(words.word(j) in toxicity.REPORT for j in range(max(i - 3, 0), i))
        out[5 if quoted or told else kind] += 1
    return out


def test_features_against_brute_force():
    model = toxicity.ToxicityModel(TERMS)
    pool = "idiot 1diot idiots scum scun worthless wrthless loweiing loveiing clown a b said wrote the “ ” \" - plain , .".split()
    rng = random.Random(21)
    texts = [" ".join(rng.choices(pool, k=rng.randrange(25))) for _ in range(300)]
    found = np.expm1(toxicity.hit_features(model.automaton, texts)[:, 1:]).round().astype(int).tolist()
    assert found == [plain_features(model, t)[1:] for t in texts]


def test_context_is_whole_across_cuts(monkeypatch):
    model = toxicity.ToxicityModel({"zorbish": False})
    text = "plain words " * 30 + "he wrote zorbish and " + 'so the "zorbish kind" of word ' + "plain words " * 30 + "zorbish"
    whole = toxicity.hit_features(model.automaton, [text])
    for chars in range(20, 500, 7):
        monkeypatch.setattr(toxicity, "RUN_CHARS", chars)
        assert (toxicity.hit_features(model.automaton, [text]) == whole).all(), chars
    assert np.round(np.expm1(whole[0, 1:])).tolist() == [1, 0, 0, 0, 2]


def test_quotation_is_told_from_abuse():
    model = toxicity.ToxicityModel({"idiot": False})
    abuse, quoted, reported, clean = model.scores(
        ["you idiot, go, idiot", 'the line reads "an idiot, truly an idiot" here', "he said idiot", "a fine day"]
    )
    assert abuse > 0.5 > quoted and reported < 0.5 and clean < 0.5


def test_long_texts_and_separators():
    model = toxicity.ToxicityModel({"idiot": False})
    filler = "some plain words here " * 60_000
    texts = [filler + "idiot " + filler + "idiot", filler, "an\x1eidiot\x1e", "", "idiot " * 30]
    counts = np.round(np.expm1(toxicity.hit_features(model.automaton, texts)[:, 1])).astype(int).tolist()
    assert counts == [2, 0, 1, 0, 20]


def test_lexicon_is_learned():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    texts = [(" ".join(word() for _ in range(40)), 0) for _ in range(300)]
    for _ in range(80):
        bad = rng.choices(["zorgling", "plumber" + rng.choice("xyz"), "quib" + word(), "quib" + word()], k=4)
        texts.append((" ".join([*(word() for _ in range(30)), *bad]), 1))
    lexicon = toxicity.learn_lexicon(texts)
    assert lexicon.get("zorgling") is False and any(s and t.startswith("quib") for t, s in lexicon.items())
    assert all(t.startswith(("zorg", "plum", "quib")) for t in lexicon)


def test_held_out_accuracy(spark):
    sf = SMALL.replace("0.001", "0.1")
    rows = queries.op3_toxicity(spark, sf)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    found = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic = [r["predicted"] for r in found if r["toxic"] == 1]
    clean = [r["predicted"] for r in found if r["toxic"] == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.02


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(empty, labels).collect() == []
    assert toxicity.score_toxicity(odd, labels.limit(0)).count() == len(ODD)
