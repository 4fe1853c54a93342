"""Pieces make up the text, fit, overlap and end at natural places."""

import random
import re

import pytest

from throng.llm import bpe, pieces


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(*bpe.read_merges(bpe.tokenizer_path()))


def cut(encoder, text, limit, overlap):
    word, at, _ = encoder.pieces([text])
    return pieces.split_text(text, at, encoder.sizes[word], encoder, limit, overlap)


def checked(encoder, text, limit, overlap):
    out = cut(encoder, text, limit, overlap)
    assert "".join(text[a:b] for _, a, b, _ in out) == text
    counts = encoder.count([text[s:b] for s, _, b, _ in out]).tolist()
    assert counts == [n for *_, n in out] and max(counts) <= limit
    over = encoder.count([text[s:a] for s, a, _, _ in out]).tolist()
    assert max(over) <= overlap and over[0] == 0
    return out


def test_random_texts(encoder):
    rnd = random.Random(4)
    parts = ["# A heading\n", "## Sub\n\n", "@name: hello there.\n", "  > @reply | so it is!\n", "\r\n", "   \n\n", "word ", "日本語の文。", "- item one\n", "x" * 90, "1234567 ", "é", "\t"]
    for _ in range(60):
        checked(encoder, "".join(rnd.choice(parts) for _ in range(rnd.randint(30, 300))), rnd.choice([24, 40, 90]), rnd.choice([0, 4, 10]))


def test_unbroken_runs(encoder):
    for text in ("qzx" * 5000, "日本" * 3000, "!" * 4000, " " * 5000, "\n" * 3000, "a b" + "z" * 3000 + " c d"):
        checked(encoder, text, 64, 8)


def test_headings_come_first(encoder):
    section = "# Part\n" + "A sentence of some words here. " * 6 + "\n"
    out = checked(encoder, section * 8, 130, 0)
    assert all(section.startswith("# Part") and (section * 8)[a:].startswith("# Part") for _, a, _, _ in out)


def test_comments_stay_whole(encoder):
    text = "".join(f"@user{i}: this is a remark with several words in it\n" for i in range(60))
    out = checked(encoder, text, 100, 0)
    assert all(text[a] == "@" for _, a, _, _ in out)


def test_sentences_before_words(encoder):
    text = "This is one sentence with words. " * 60
    out = checked(encoder, text, 60, 12)
    assert all(text[:b].rstrip().endswith(".") for _, _, b, _ in out)
    assert all(s < a for s, a, _, _ in out[1:])


def test_outline_nests():
    text = "# A\n\nsome words\nmore\n\n## B\n- one\n  - two\n\n    of two\n- three\n# C\n<ul>\n<li>x</li>\n</ul>\nlast\n"
    at = lambda part: text.index(part)
    assert pieces.outline(text) == [
        (0, 0), (0, 1), (0, 2), (at("more"), 3), (at("## B"), 2), (at("## B"), 3), (at("  - two"), 4), (at("    of two"), 5), (at("- three"), 3),
        (at("# C"), 1), (at("# C"), 2), (at("# C"), 3), (at("last"), 2),
    ]


def test_outline_of_very_deep_nesting(encoder):
    text = "".join(" " * i + "- item\n" for i in range(1500))
    assert max(d for _, d in pieces.outline(text)) == pieces.DEEPEST
    checked(encoder, text, 400, 0)


def test_fenced_lines_are_no_headings():
    text = "words\n\n```\n# no heading\n- no item\n```\n\nTitle\n=====\nbody\n"
    assert [(text[c:][:3], d) for c, d in pieces.outline(text)] == [("wor", 0), ("wor", 1), ("```", 1), ("# n", 2), ("- n", 2), ("```", 2), ("Tit", 1), ("Tit", 2)]


def test_neighbours_never_fit_in_one(encoder):
    rnd = random.Random(8)
    for _ in range(30):
        text = "".join(rnd.choice(["# Head\n", "## Sub\n", "- item of words\n", "  - nested one\n", "Words in a line. And more of it. " * rnd.randint(1, 9) + "\n", "\n"]) + "." for _ in range(200))
        out = checked(encoder, text, 90, 0)
        sizes = encoder.count([text[a:b] for _, a, b, _ in out]).tolist()
        assert all(a + b > 90 - 3 for a, b in zip(sizes, sizes[1:], strict=False))
        assert all(text[a:b].strip() for _, a, b, _ in out)


def test_headings_stay_with_what_follows(encoder):
    text = "".join(f"# Part {i}\n\n" + "Some words of a long body. " * 40 + "\n\n" for i in range(6))
    out = checked(encoder, text, 80, 0)
    assert not any(re.fullmatch(r"\s*# Part \d\s*", text[a:b]) or re.search(r"# Part \d\s*$", text[a:b]) for _, a, b, _ in out)


def test_rest_of_an_opened_section_joins_the_next(encoder):
    text = "# A\n" + "Some long words here. " * 60 + "\n\n## B\nshort\n\n## C\nshort too\n"
    out = checked(encoder, text, 128, 0)
    assert "## B" in text[out[-1][1] :] and "## C" in text[out[-1][1] :] and "long words" in text[out[-1][1] :]


def test_table(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "short", 0), (4, "Word after word. " * 400, 0), (4, "Word after word. " * 400, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    out = pieces.split_documents(df, 100, 10).collect()
    assert {r.doc_id for r in out} == {4} and sum(r.piece == 0 for r in out) == 2
    assert all(r.text == rows[3][1][r.begin : r.finish] and r.tokens <= 100 for r in out)
    assert pieces.split_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.split_documents(df, 100, 60)
