"""Separating records that don't parse from those that do.

Each value is one CSV record that ought to hold one field, a sentence with a
comment's text, likes, author and age. Every partition is parsed in Arrow
batches: well-quoted records go through the CSV reader, whose invalid-row
callback takes out those with another number of columns; all fields are read as
strings and then cast as whole vectors, so that failing cells can be labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REASONS = ("empty", "quoting", "columns", "shape", "likes", "author", "time")
# The formats of a record and of its cells, as RE2 patterns.
BLANK = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
RECORD = rf"(?s)^{FIELD}(?:,{FIELD})*$"
ENCLOSED = r'(?s)^"(?:[^"]|"")*"$'
SENTENCE = r"(?s)^comment is '(?P<text>.*)' with likes= (?P<likes>.*) with user_id '(?P<author>.*)' and published\(time\) '(?P<time>.*)'$"
LIKES = r"^(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+(?:\.[0-9]+)?[KMBkmb])$"
AUTHOR = rf"^@[^{BLANK}]+$"
AGE = r"^[0-9]+ (?:second|minute|hour|day|week|month|year)s? ago(?: \(edited\))?$"
MOST = 2**63 - 1

_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("reason", T.StringType()), ("text", T.StringType()), ("likes", T.LongType()), ("author", T.StringType()), ("published", T.StringType()))])


def _matches(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(values, pattern), False).to_numpy(zero_copy_only=False)


def _fields(records: pa.Array, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Positions and fields of the records at ``at`` that have one column."""
    rows = records.take(pa.array(at))
    alone = pc.match_substring_regex(rows, ENCLOSED)
    quoted = pc.match_substring(rows, '"')
    # a line break outside quotes belongs to the record; the reader would end the row there
    wrapped = pc.binary_join_element_wise('"', pc.replace_substring(rows, ",", '","'), '"', "")
    flat = pc.replace_substring_regex(rows, r"[\r\n]", " ")
    rows = pc.if_else(alone, rows, pc.if_else(quoted, flat, wrapped))
    lines = pc.binary_join_element_wise(pc.cast(pa.array(at), pa.string()), rows, ",")
    data = "\n".join(lines.to_pylist()).encode() + b"\n"
    rejected: list[str] = []

    def other_width(row: pacsv.InvalidRow) -> str:
        rejected.append(row.text)
        return "skip"

    read = pacsv.read_csv(
        pa.BufferReader(data),
        read_options=pacsv.ReadOptions(column_names=["at", "field"], block_size=min(len(data) + 1, 2**31 - 1), use_threads=False),
        parse_options=pacsv.ParseOptions(newlines_in_values=True, invalid_row_handler=other_width),
        convert_options=pacsv.ConvertOptions(column_types={"at": pa.string(), "field": pa.string()}, strings_can_be_null=False),
    )
    if len(read) + len(rejected) != len(at):
        raise ValueError(f"{len(at)} records gave {len(read)} rows and {len(rejected)} rejects")
    return pc.cast(read["at"], pa.int64()).to_numpy(), read["field"].combine_chunks()


def _counts(likes: pa.Array) -> pa.Array:
    """Likes that match LIKES as numbers."""
    digits = pc.replace_substring_regex(likes, r"[,KMBkmb]", "")
    last = pc.utf8_lower(pc.utf8_slice_codeunits(likes, -1))
    factor = np.select([last.to_numpy(zero_copy_only=False) == x for x in "kmb"], [1e3, 1e6, 1e9], 1.0)
    number = pc.round(pc.multiply(pc.cast(digits, pa.float64()), pa.array(factor)))
    whole = pc.and_(pc.equal(pa.array(factor), 1.0), pc.less(pc.utf8_length(digits), 19))
    exact = pc.cast(pc.if_else(whole, digits, "0"), pa.int64())
    big = pc.greater_equal(number, float(MOST))
    scaled = pc.cast(pc.if_else(pc.or_(big, whole), 0.0, number), pa.int64())
    return pc.if_else(whole, exact, pc.if_else(big, MOST, scaled))


def label(values: pa.Array) -> dict[str, pa.Array]:
    """Reason and cells of each record; the reason of a valid one is null."""
    n = len(values)
    bare = pc.replace_substring_regex(pc.fill_null(values, ""), "^﻿", "")
    trimmed = pc.utf8_trim_whitespace(bare)
    inside = pc.if_else(pc.match_substring_regex(trimmed, r'(?s)^".*"$'), pc.utf8_slice_codeunits(trimmed, 1, -1), "x")
    blank = pc.or_(pc.equal(trimmed, ""), pc.equal(pc.utf8_trim_whitespace(inside), "")).to_numpy(zero_copy_only=False)
    reason = np.full(n, None, dtype=object)
    reason[blank] = "empty"
    sound = _matches(bare, RECORD)
    reason[~blank & ~sound] = "quoting"
    todo = np.flatnonzero(~blank & sound)
    reason[todo] = "columns"
    at, field = _fields(bare, todo) if len(todo) else (todo, pa.array([], pa.string()))
    cells = pc.extract_regex(pc.utf8_trim_whitespace(field), SENTENCE)
    part = {c: pc.struct_field(cells, c) for c in ("text", "likes", "author", "time")}
    shaped = pc.is_valid(cells).to_numpy(zero_copy_only=False)
    bad = [~shaped, ~_matches(part["likes"], LIKES), ~_matches(part["author"], AUTHOR), ~_matches(part["time"], AGE)]
    reason[at] = np.select(bad, np.array(["shape", "likes", "author", "time"], dtype=object), None)
    good = np.flatnonzero(np.equal(reason[at], None))
    rows = np.full(n, -1, dtype=np.int64)
    rows[at[good]] = np.arange(len(good))
    take = pa.array(rows, mask=rows < 0)
    kept = {c: x.take(pa.array(good)) for c, x in part.items()}
    likes = _counts(kept["likes"])
    return {"reason": pa.array(reason, pa.string()), "text": kept["text"].take(take), "likes": likes.take(take), "author": kept["author"].take(take), "published": kept["time"].take(take)}


def parse_records(rows: DataFrame, value: str = "merged_comment", keep: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """``rows`` with ``reason, text, likes, author, published`` for each record.

    ``reason`` is null for a valid record and the first of REASONS that holds for
    another, whose other new columns are null. A null record is 'empty'. Likes
    beyond a bigint become the greatest bigint. ``keep`` names the columns that
    pass through; other columns of the input are dropped, so theirs may clash
    with the new names. An empty table gives an empty table.
    """
    slim = rows.select(*keep, F.col(value).cast("string").alias("__record"))
    schema = T.StructType([*slim.drop("__record").schema.fields, *_SCHEMA.fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = label(pc.cast(batch.column("__record"), pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new.values()], names=[*keep, *new])

    return slim.mapInArrow(parse, schema)


def found(rows: DataFrame) -> DataFrame:
    """Line numbers and reasons of the records that fail."""
    return parse_records(rows).where("reason is not null").select("line_no", "reason")


def valid(rows: DataFrame) -> DataFrame:
    """The cells of the records that parse."""
    return parse_records(rows).where("reason is null").drop("reason")
