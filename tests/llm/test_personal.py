"""Personal information: spans, reliabilities, redaction."""

import pytest

from throng.llm import personal

CASES = [
    ("write me at jo.smith@post.example please", "email", "jo.smith@post.example"),
    ("mail: jo_s (at) post [dot] example thanks", "email", "jo_s (at) post [dot] example"),
    ("contact jos77 at post dot example today", "email", "jos77 at post dot example"),
    ("call me on +44 7700 900123 tonight", "phone", "+44 7700 900123"),
    ("whatsapp (212) 555-0182 anyone?", "phone", "(212) 555-0182"),
    ("mi número es ７９０－５５５－０１０２, escríbeme", "phone", "７９０－５５５－０１０２"),
    ("my social is 923-04-1188 if you need it", "id", "923-04-1188"),
    ("mi DNI es 00412345-K para el sorteo", "id", "00412345-K"),
    ("passport no ZZ0123456 for the trip", "id", "ZZ0123456"),
    ("I live at 14b Willow Lane and could hear it", "address", "14b Willow Lane"),
    ("mándalo a Calle del Pozo, 8, gracias", "address", "Calle del Pozo, 8"),
    ("Treffpunkt ist Lange Gasse 12 a, wie immer", "address", "Lange Gasse 12 a"),
    ("la fête est au 3 bis rue des Lilas samedi", "address", "3 bis rue des Lilas"),
    ("my name is Clara M. Hofberg and I drew it", "name", "Clara M. Hofberg"),
    ("thanks Dr. Pedro Valdini for explaining", "name", "Pedro Valdini"),
]
HARMLESS = [
    "don't @ me. I said so",
    "at 56 dot 19 percent the odds look bad",
    "patch 11.0.2010.16 broke it",
    "order 8057-21-2018 of the box set",
    "1 447 326 818 views and counting",
    "2018-04-25 was the day",
    "from 1991-2011 this show had no rival",
    "the recap in episode 12 was way too long",
    "Quill lives on Willow Lane in the story",
    "my name is not important, the plot is",
    "@clara_hofberg nice one",
]


@pytest.fixture(scope="module")
def table(spark):
    said = [t for t, _, _ in CASES] + HARMLESS
    rows = [(f"c{i}", t, "old") for i, t in enumerate(said * 6)] + [("n", None, "old"), ("e", "", "old"), ("l", "word " * 40_000 + "call me on +44 7700 900123 tonight", "old"), ("c0", CASES[0][0], "old"), (None, CASES[0][0], "old")]
    return spark.createDataFrame(rows, "cid string, text string, kind string")


def test_found(table):
    got = {(r.cid, r.kind, r.value) for r in personal.found(table).collect()}
    n = len(CASES) + len(HARMLESS)
    expected = {(f"c{i + n * k}", kind, value) for k in range(6) for i, (_, kind, value) in enumerate(CASES)} | {("l", "phone", "+44 7700 900123")}
    assert got == expected


def test_nothing(table):
    assert personal.found(table.limit(0)).count() == 0
    assert personal.found(table.where("cid = 'n'")).count() == 0


def test_redaction(table):
    model = personal.fit(personal.spans_table(table))
    rows = {r.cid: r for r in personal.redact(table, model).collect()}
    assert rows["c0"].text_redacted == "write me at [EMAIL] please"
    assert rows[f"c{len(CASES)}"].text_redacted == HARMLESS[0]
    assert rows["n"].text_redacted is None and rows["e"].text_redacted == "" and rows["c0"].kind == "old"


UNLISTED = [
    ("My neighbour is Deepak Chopra and he sings", ["Deepak Chopra"]),
    ("I met Wei Zhang yesterday", ["Wei Zhang"]),
    ("we talked to Nguyen Van Minh about it", ["Nguyen Van Minh"]),
    ("saw Tyrone Jackson at the premiere", ["Tyrone Jackson"]),
    ("Thanks Priyanka Sharma for the ride", ["Priyanka Sharma"]),
    ("thanks, Old Hesper did nothing wrong", []),
    ("Mottrick lives on Quarry Hill Lane in the story", []),
    ("the Quarry Hill scene still hurts", []),
    ("I SAID SO MANY TIMES", []),
]


def test_names_that_no_list_has(spark, table):
    figures = personal.figure_words(spark.createDataFrame([("Old Hesper: the end, part 1",), ("Mottrick: editing",), (None,)], "title string"))
    assert figures == {"old", "hesper", "mottrick"}
    model = personal.fit(personal.spans_table(table, figures), figures)
    for text, names in UNLISTED:
        assert [text[s.begin : s.end] for s in model.decide(personal.propose(text, figures), text)] == names, text


def test_words_common_in_capitals_are_no_names(spark):
    rows = [(f"c{i}", f"ich habe Liebe Oma{'rst'[i % 3]} gefragt") for i in range(60)] + [("d", "then Wei Zhang sang"), ("e", "my name is Clara Hofberg")]
    spans = personal.spans_table(spark.createDataFrame(rows, "cid string, text string"))
    assert personal.common_words(spans) >= {"liebe", "omar"}
    assert "zhang" not in personal.common_words(spans)
    told = personal.with_common(spans, frozenset({"liebe"}))
    assert told.where(f"votes like '%-' and array_contains(features, {personal.COMMON})").count() == 60


def test_long_addresses_are_whole(table):
    street = "Neue " + "Ober" * 30 + "straße 12"
    model = personal.fit(personal.spans_table(table))
    text = f"ich wohne {street} schon lange"
    assert [s.kind for s in personal.propose(text)] == ["address"]
    assert [text[s.begin : s.end] for s in model.decide(personal.propose(text), text)] == [street]


def test_texts_of_one_cid_are_decided_on_apart(spark, table):
    extra = spark.createDataFrame([("t", "call me on +44 7700 900123 tonight", ""), ("t", "my social 923-04-1188 is known", "")], table.schema)
    assert {(r.kind, r.value) for r in personal.found(table.unionByName(extra)).where("cid = 't'").collect()} == {("phone", "+44 7700 900123"), ("id", "923-04-1188")}


def test_draw_of_any_number_of_spans():
    assert personal.draw_below(10) == 2**63 - 1
    assert 0 < personal.draw_below(10**11) < personal.draw_below(10**7) < 2**63 - 1
    assert personal.draw_below(10**7) / 2**63 * 10**7 <= personal.MOST_SPANS / len(personal.KINDS)


def test_silence_of_partial_labelers_is_no_evidence():
    counts = {(1, 1, 0): 300, (0, 1, 0): 5, (0, 1, -1): 40, (0, -1, -1): 300}
    p = personal.reliabilities(counts, partial=(0,))
    assert p[(0, 1, 0)] > 0.9 and p[(0, -1, -1)] < 0.05


def test_reliabilities_follow_the_better_labeler():
    counts = {(1, 1): 400, (-1, -1): 400, (1, -1): 60, (-1, 1): 2, (0, 1): 50, (0, -1): 50}
    p = personal.reliabilities(counts)
    assert p[(1, 1)] > 0.95 and p[(-1, -1)] < 0.05 and p[(0, 1)] > p[(0, -1)]


def test_places_in_odd_text():
    text = "c​all me on +44 77​00 900123 tonight é"
    (span,) = [s for s in personal.propose(text) if s.kind == "phone"]
    assert text[span.begin : span.end] == "+44 77​00 900123"
