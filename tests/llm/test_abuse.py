"""Automaton against plain edit distance, and scores on held-out examples."""

import os
import random

import numpy as np
import pandas as pd
import pytest

from throng.llm import abuse

LABELS = "/root/testdata/sf0.001/moderation_labels.parquet"
TERMS = "/root/testdata/sf0.001/abuse_terms.parquet"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_the_nearest_term():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    trie = abuse.Trie({w: "x" for w in words})
    for _ in range(500):
        w = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 7)))
        for most in (0, 1, 2):
            near = min((distance(w, t), t) for t in words)
            got = trie.find(w, most)
            assert (got and got[:2]) == (near if near[0] <= most else None)


def test_disguises():
    lexicon = abuse.Lexicon({"bonehead": "abusive", "rat": "abusive"}, frozenset({"bedhead"}))
    for word in ("bonehead", "b0neh3ad", "boneheeeead", "b-o-n-e-h-e-a-d", "bonehed", "b#nehead", "bonehead's"):
        assert lexicon.match(word) == ("bonehead", "abusive"), word
    assert lexicon.match("rats") is None and lexicon.match("bedhead") is None and lexicon.match("!!!") is None
    assert abuse.raw_tokens("never a b o n e h e a d", None, lexicon.terms) == ["never", "a", "bonehead"]
    assert lexicon.match("0900085") is None
    assert abuse.raw_tokens("you b o n e h e a d ok", "🖕🖕😂") == ["you", "bonehead", "ok", "<e>", "🖕", "😂"]


@pytest.fixture(scope="module")
def held_out():
    if not os.path.exists(LABELS):
        pytest.skip("no labelled table here")
    labels, terms = pd.read_parquet(LABELS), pd.read_parquet(TERMS)
    part = np.random.default_rng(7).random(len(labels)) < 0.75
    return abuse.train(labels[part], terms), labels[~part]


def test_held_out_examples(held_out):
    model, rest = held_out
    margin, kind = model.score([model.tokens(t, e) for t, e in zip(rest["text"], rest["emojis"], strict=True)])
    said = np.where(margin > 0, np.array(abuse.CATEGORIES)[kind], "none")
    truth = rest["category"].to_numpy()
    assert (said == truth).mean() > 0.95
    assert (said[truth == "none"] == "none").mean() > 0.98


PROBES = [
    ("you are an idiot", "abusive"),
    ("you absolute moron", "abusive"),
    ("y0u are an 1diot", "abusive"),
    ("go kill yourself", "abusive"),
    ("why are you so stupid", "abusive"),
    ("they are subhuman filth", "hateful"),
    ("they are subhumn filth", "hateful"),
    ('"you are a moron" is what he wrote', "none"),
    ('someone wrote "you are a idiot" and got banned', "none"),
    ("he called me an idiot", "none"),
    ("my brother is an idiot", "none"),
    ("nice animals in this scene", "none"),
    ("the word idiot is overused", "none"),
]


def test_phrases_that_no_label_has():
    if not os.path.exists(LABELS):
        pytest.skip("no labelled table here")
    model = abuse.train(pd.read_parquet(LABELS), pd.read_parquet(TERMS))
    margin, kind = model.score([model.tokens(t, None) for t, _ in PROBES])
    said = np.where(margin > 0, np.array(abuse.CATEGORIES)[kind], "none")
    assert said.tolist() == [c for _, c in PROBES]


@pytest.mark.parametrize("family", ["imagine being this", "you would say that", "and everyone knows it", "go cry somewhere else"])
def test_families_of_phrases_held_out(family):
    """Insults of a form that training never saw, by their listed terms alone."""
    if not os.path.exists(LABELS):
        pytest.skip("no labelled table here")
    labels, terms = pd.read_parquet(LABELS), pd.read_parquet(TERMS)
    own = labels["text"].fillna("").str.lower().str.contains(family)
    model = abuse.train(labels[~own], terms)
    rest = labels[own & (labels["category"] != "none")]
    tokens = [model.tokens(t, e) for t, e in zip(rest["text"], rest["emojis"], strict=True)]
    hit = np.array([any(model.symbol(x) == "<abusive>" for x in words) for words in tokens])
    margin, kind = model.score(tokens)
    assert hit.sum() > 5 and ((margin > 0) & (kind == 0))[hit].mean() > 0.9


def test_terms_of_several_words():
    model = abuse.Model(abuse.Lexicon({"complete fool": "abusive", "rat": "abusive"}, frozenset()), {})
    assert model.tokens("you complete fool, go", None) == ["you", "completefool,", "go"]
    assert model.tokens("a complte fool again", None) == ["a", "completefool", "again"]
    assert model.tokens("a complete rat", None) == ["a", "complete", "rat"]


def test_quotation_marks():
    model = abuse.Model(abuse.Lexicon({}, frozenset()), {})
    inside = lambda text: [w for w, q in zip(text.split(), model.quoted([model.role(x) for x in text.split()]), strict=True) if q]
    assert inside('he said "you are bad." and left') == ['"you', "are", 'bad."']
    assert inside('"all of it"') == [] and inside('an "open end') == []
    assert inside('such a "genius" here') == ['"genius"']


def test_lexicon_is_never_cut(spark, monkeypatch):
    monkeypatch.setattr(abuse, "MOST_TERMS", 2)
    labels = spark.createDataFrame([(1, "you rat", "", "abusive"), (2, "nice", "", "none")], "label_id long, text string, emojis string, category string")
    terms = spark.createDataFrame([(i, f"word{i}", "abusive") for i in range(3)], "term_id long, term string, category string")
    with pytest.raises(ValueError):
        abuse.fit(labels, terms)


def test_table(spark, held_out):
    model, rest = held_out
    case = rest[rest["category"] == "abusive"].iloc[0]
    rows = [("c0", None, None, None), ("c1", "", "", "s"), ("c2", "x " * 50_000, None, "s"), ("c3", case.text, case.emojis, "s"), ("c3", case.text, case.emojis, "s"), (None, case.text, case.emojis, None)]
    df = spark.createDataFrame([(*r, 0.5, "kept") for r in rows], "cid string, text string, emojis string, source string, score double, category string")
    scored = abuse.score_comments(df, model)
    got = {r.cid: r.category for r in scored.collect()}
    assert got["c0"] == got["c1"] == got["c2"] == "none" and scored.count() == 6
    assert [tuple(r) for r in abuse.found(df, model).collect()] in ([("c3", "abusive")], [])
    assert {r.source for r in abuse.rates(scored).collect()} == {None, "s"}
    assert abuse.found(df.limit(0), model).count() == 0
