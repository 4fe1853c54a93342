"""One consistent form for text that looks the same.

Canonical form: compatibility width folded, joined letters taken apart, every
kind of blank made a plain space, characters that show nothing removed, letters
of another script with the same shape replaced by one of them, and the result
composed (NFC). Case, accents, punctuation, digits and words stay.

Text is scanned once for *unstable* characters, those that the form would alter
or that may combine with what stands before them (normalization quick check "No"
or "Maybe"). Only such a run, with the one character before it as boundary
context, is normalised, and the result is spliced into the unchanged rest.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from throng.session import stage_table

# Letters of other scripts and the Latin letter of the same shape.
SAME_SHAPE = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "У": "Y", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    # Greek
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Ϝ": "F",
    # Armenian and phonetic letters
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ɑ": "a", "ɡ": "g", "ɩ": "i", "Օ": "O", "Տ": "S",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Coptic
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X",
}
# Format characters that do show something.
_VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD, *range(0x13430, 0x13460)}
# Characters outside category Cf that show nothing.
_SHOWS_NOTHING = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_SCANNED = [*range(0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]


def _expansions() -> dict[int, str]:
    out = {}
    for cp in _SCANNED:
        ch = chr(cp)
        kind, tag = ud.category(ch), ud.decomposition(ch)
        if cp in _SHOWS_NOTHING or kind == "Cf" and cp not in _VISIBLE_FORMAT:
            out[cp] = ""
        elif kind == "Zs" or ch == "\t":
            out[cp] = " "
        elif tag.startswith(("<wide>", "<narrow>")) or tag.startswith("<compat>") and kind[0] == "L" and tag.count(" ") > 1 and all(ud.category(chr(int(x, 16)))[0] == "L" for x in tag.split()[1:]):
            out[cp] = "".join(chr(int(x, 16)) for x in tag.split()[1:])
    return out


_EXPAND = _expansions()
_SHAPE = str.maketrans(SAME_SHAPE)


@lru_cache(maxsize=200_000)
def canonical_segment(segment: str) -> str:
    """The canonical form of a whole string, by plain normalization."""
    return ud.normalize("NFC", ud.normalize("NFD", segment.translate(_EXPAND)).translate(_SHAPE))


def _unstable() -> str:
    """A character class of all code points that the quick check doesn't pass."""
    second = {ud.decomposition(chr(cp)).split()[-1] for cp in _SCANNED if (d := ud.decomposition(chr(cp))) and d[0] != "<" and " " in d}
    maybe = {int(x, 16) for x in second} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    bad = sorted(cp for cp in _SCANNED if not 0xD800 <= cp < 0xE000 and cp > 0x7F and (cp in maybe or ud.combining(chr(cp)) or canonical_segment.__wrapped__(chr(cp)) != chr(cp)))
    bad.append(9)
    spans: list[list[int]] = []
    for cp in sorted(bad):
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


_CLASS = _unstable()
_SEGMENT = re.compile(f"[^{_CLASS}]?[{_CLASS}]+")


def _splice(found: re.Match) -> str:
    return canonical_segment(found.group())


def canonical(text: str) -> str:
    """The canonical form of ``text``."""
    if text.isascii() and "\t" not in text:
        return text
    return _SEGMENT.sub(_splice, text)


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def canonical_column(col: Column) -> Column:
    """The canonical form of a string column; null stays null, empty stays empty.

    Plain ASCII is stable as a whole, so only other rows are sent to Python.
    """
    stable = ~col.rlike(r"[^\x00-\x08\x0a-\x7f]")
    return F.when(stable, col).otherwise(_canonical(F.when(stable, F.lit(None)).otherwise(col)))


def duckdb_canonical(col: str) -> str:
    """The canonical form as a DuckDB expression, character by character."""
    one, many = {}, {}
    for cp in _SCANNED:
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000 or (form := canonical_segment.__wrapped__(ch)) in (ch, ud.normalize("NFC", ch)):
            continue
        (one if len(form) == 1 else many)[ch] = form
    gone = "".join(c for c, form in many.items() if not form)
    quoted = "".join(one.values()).replace("'", "''")
    out = f"translate({col}, '{''.join(one)}{gone}', '{quoted}')"
    for ch, form in many.items():
        if form:
            out = f"replace({out}, '{ch}', '{form}')"
    return f"nfc_normalize({out})"


def canonical_forms(comments: DataFrame, fields: tuple[str, ...] = ("text", "author")) -> DataFrame:
    """``comments`` with ``<field>_canonical`` beside each of ``fields``.

    Nulls give null and empty strings give empty strings; a string of characters
    that show nothing gives an empty string. Other columns pass through, and one
    that already has the new name is replaced.
    """
    return comments.withColumns({f"{f}_canonical": canonical_column(F.col(f)) for f in fields})


def lookalike_pairs(values: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Pairs of keys whose values are different strings of one canonical form.

    ``values`` may repeat rows. Null and empty values take no part. Returns
    ``key_a``, ``key_b`` with key_a < key_b, each pair once.

    1. Every string is brought to its form once; only hashes of both are kept.
       Each form is reduced map-side to the least and greatest hash of its
       strings; where they differ, it is mixed.
    2. Rows whose string may be of a mixed form, found again by the hash of the
       string, go on whole, so that hashes that two strings share can't pair them.
    3. Pairs are made between the different strings of a form first and joined
       with the keys of either string then. No row meets another of its own
       string, so the work follows the result however many copies a string has.

    The hashes in question are written before they are joined: Spark knows their
    size then and sends them to all tasks only below its broadcast threshold.
    """
    rows = values.select(F.col(key).alias("k"), F.col(value).alias("v")).where("k is not null and v is not null and v <> ''")
    hashed = stage_table(rows.select(F.xxhash64("v").alias("s"), F.xxhash64(canonical_column(F.col("v"))).alias("h")), f"{name}-hashes")
    mixed = stage_table(hashed.groupBy("h").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("h"), f"{name}-mixed")
    odd = stage_table(hashed.join(mixed, "h", "left_semi").select("s").distinct(), f"{name}-odd")
    few = rows.withColumn("s", F.xxhash64("v")).join(odd, "s", "left_semi").select(canonical_column(F.col("v")).alias("c"), "v", "k")
    few = stage_table(few.distinct(), name)
    strings = few.select("c", "v").distinct()
    other = strings.select("c", F.col("v").alias("w"))
    met = strings.join(other, "c").where("v < w").select("c", "v", "w")
    left = few.select("v", F.col("k").alias("x"))
    right = few.select(F.col("v").alias("w"), F.col("k").alias("y"))
    pairs = met.join(left, "v").join(right, "w").where("x <> y")
    return pairs.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def found(comments: DataFrame) -> DataFrame:
    """Look-alike pairs: of cids by their texts, of authors by themselves."""
    texts = lookalike_pairs(comments, "cid", "text", "p1-text").select(F.lit("text").alias("field"), "key_a", "key_b")
    names = comments.select("author").distinct().withColumn("name", F.col("author"))
    authors = lookalike_pairs(names, "author", "name", "p1-author").select(F.lit("author").alias("field"), "key_a", "key_b")
    return texts.unionByName(authors)
