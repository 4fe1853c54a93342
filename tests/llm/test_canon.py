"""Canonical forms and look-alike pairs."""

from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from throng.llm import canon

letters = st.text(st.sampled_from("aeoAxаеоАх éñ́̃̈ｄＡ　 ​­ﬁﬀ가ㄱ각ガｶﾞ日。.!'Ωάό\t\n0０"), max_size=30)


@settings(max_examples=400, deadline=None)
@given(letters)
def test_splicing_equals_plain_normalization(text):
    assert canon.canonical(text) == canon.canonical_segment.__wrapped__(text)
    assert canon.canonical(canon.canonical(text)) == canon.canonical(text)


def test_what_looks_the_same():
    same = [("ｄｒａｍａ！", "drama!"), ("café", "café"), ("ﬁne", "fine"), ("a b", "a b"), ("no​w", "now"), ("сор", "cop"), ("가", "가"), ("ｶﾞ", "ガ"), ("ё", "ë"), ("ᎳᎻ", "WH"), ("ρ", "p"), ("ꓐꓴꓢ", "BUS"), ("ŉ", "ʼn")]
    assert all(canon.canonical(a) == canon.canonical(b) for a, b in same)
    apart = [("Now", "now"), ("café", "cafe"), ("a.", "a"), ("0", "o"), ("ab", "a b"), ("º", "o"), ("и", "й"), ("№ 5", "No 5"), ("℡", "TEL"), ("㏒", "log"), ("ᴀ", "A")]
    assert all(canon.canonical(a) != canon.canonical(b) for a, b in apart)


ROWS = [("c0", "drama", "@a", 1), ("c1", "ｄrama", "@а", 2), ("c1", "ｄrama", "@а", 2), ("c2", "drama", None, 3), ("c3", "dramа", "", 4), ("c4", None, "@x", 5), ("c5", "", "@x", 6), ("c6", "Drama", "@A", 7), (None, "drama", "@z", 8), ("c10", "x" * 200_000 + "​", "@q", 9), ("c9", "x" * 200_000, "@q", 9)]
SCHEMA = "cid string, text string, author string, h long"


def brute(rows):
    by, out = defaultdict(set), set()
    for cid, text, *_ in rows:
        if cid and text:
            by[canon.canonical_segment.__wrapped__(text)].add((cid, text))
    for group in by.values():
        out |= {("text", min(a, b), max(a, b)) for a, t in group for b, u in group if t != u and a != b}
    names = {r[2] for r in rows if r[2]}
    out |= {("author", min(a, b), max(a, b)) for a in names for b in names if a != b and canon.canonical_segment.__wrapped__(a) == canon.canonical_segment.__wrapped__(b)}
    return sorted(out)


def test_pairs_match_brute_force(spark):
    got = sorted(map(tuple, canon.found(spark.createDataFrame(ROWS, SCHEMA)).collect()))
    assert got == brute(ROWS)
    assert ("text", "c10", "c9") in got


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert canon.found(empty).count() == 0 and canon.canonical_forms(empty).count() == 0


def test_forms_keep_nulls_and_replace_clashing_columns(spark):
    df = spark.createDataFrame([("c0", None, "", "old"), ("c1", "​", "ａ", "old")], "cid string, text string, author string, text_canonical string")
    rows = {r.cid: r for r in canon.canonical_forms(df).collect()}
    assert rows["c0"].text_canonical is None and rows["c0"].author_canonical == ""
    assert rows["c1"].text_canonical == "" and rows["c1"].author_canonical == "a"
