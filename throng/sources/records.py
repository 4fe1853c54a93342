"""Comment records from raw rows, CSV and JSON, and back."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from throng.functions import columns as C
from throng.operators.rejects import parse_records
from throng.session import stage_table

COMMENT = T.StructType(
    [
        T.StructField("cid", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("likes", T.LongType()),
        T.StructField("published", T.StringType()),
        T.StructField("published_ts", T.DoubleType()),
        T.StructField("reply_count", T.LongType()),
        T.StructField("is_reply", T.BooleanType()),
        T.StructField("emojis", T.StringType()),
        T.StructField("valence", T.DoubleType()),
    ]
)
RAW = ("text", "time", "author", "votes", "likes", "replies", "reply")


def numbered(rows: DataFrame, name: str = "position") -> DataFrame:
    """``rows`` with consecutive numbers from 0 in their order, without gathering
    them: rows are numbered in their partition, whose number stands in the upper bits,
    and only the sizes of partitions are summed up. Written once, so both agree."""
    held = stage_table(rows.withColumn("__n", F.monotonically_increasing_id()), "numbered")
    part, own = F.shiftright("__n", 33), F.col("__n").bitwiseAND(F.lit(2**33 - 1))
    sizes = held.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = held.withColumns({"__part": part, "__own": own}).join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before", "__n")


def normalise(raw: DataFrame, now: float, cid: str = "cid") -> DataFrame:
    """The ten comment columns of raw records.

    raw: ``cid`` and any of text, time, author, votes (or likes), replies, reply;
    votes count if the column is there. Missing and null cells become '', 0, false
    or, for an unreadable time, null. ``now`` is one moment for all rows.
    """
    has = set(raw.columns)
    col = lambda n: F.col(n).cast("string") if n in has else F.lit(None).cast("string")
    text = F.coalesce(col("text"), F.lit(""))
    published = F.coalesce(col("time"), F.lit(""))
    reply = F.coalesce(F.col("reply"), F.lit(False)) if "reply" in has and isinstance(raw.schema["reply"].dataType, T.BooleanType) else F.coalesce(col("reply"), F.lit("")) != ""
    return raw.select(
        F.col(cid).cast("string").alias("cid"),
        C.prose(text).alias("text"),
        F.coalesce(col("author"), F.lit("")).alias("author"),
        C.parse_count(col("votes" if "votes" in has else "likes")).alias("likes"),
        published.alias("published"),
        C.published_at(published, now).alias("published_ts"),
        C.parse_count(col("replies")).alias("reply_count"),
        reply.alias("is_reply"),
        C.emoji_of(text).alias("emojis"),
        C.valence(C.emoji_of(text)).alias("valence"),
    )


def from_records(spark: SparkSession, records: Iterable[dict], now: float) -> DataFrame:
    """Comments of dictionaries, ``c0, c1, ...`` in their order."""
    rows = [Row(cid=f"c{i}", **{k: None if (v := r.get(k)) is None else str(v).lower() if isinstance(v, bool) else str(v) for k in RAW}) for i, r in enumerate(records)]
    if not rows:
        raise ValueError("no records")
    raw = spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in ("cid", *RAW)]))
    raw = raw.withColumn("votes", F.coalesce("votes", "likes")).withColumn("reply", F.coalesce(F.col("reply"), F.lit("")).isin("true", "1", "yes") if all(str(r.get("reply")) in ("True", "False", "None", "") for r in records) else F.col("reply"))
    return normalise(raw.drop("likes"), now)


def from_csv(spark: SparkSession, path: str, now: float) -> DataFrame:
    """Comments of a CSV file of named columns or of one merged column.

    Headers are trimmed and lower-cased; for each field the first non-empty of its
    names counts. With a single header that has "merged" in it, each record is a
    sentence; those that don't read are left out before ids are given. ``cid`` and
    ``emojis`` are read back where the file has them.
    """
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    read = spark.read.options(header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, encoding="UTF-8").csv(path)
    heads = [h.strip().strip("﻿").lower() for h in read.columns]
    if len(heads) == 1 and "merged" in heads[0]:
        merged = numbered(read.toDF("record"), "n")
        quoted = merged.withColumn("record", F.concat(F.lit('"'), F.replace(F.col("record"), F.lit('"'), F.lit('""')), F.lit('"')))
        cells = parse_records(quoted, "record", ("n",)).where("text is not null").orderBy("n").select("text", F.col("likes").cast("string").alias("votes"), "author", F.col("published").alias("time"))
        return normalise(_ids(cells), now)
    named = read.toDF(*heads)
    first = lambda *names: F.coalesce(*[F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in heads], F.lit(None))
    emojis = F.coalesce(first("emojis"), F.lit(""))
    raw = named.select(F.concat(F.coalesce(first("text", "comment", "comment text"), F.lit("")), emojis).alias("text"), first("likes", "votes").alias("votes"), first("author", "user_id").alias("author"), first("time", "published").alias("time"), first("cid").alias("own"))
    return normalise(_ids(raw).withColumn("cid", F.coalesce("own", "cid")), now)


def _ids(rows: DataFrame) -> DataFrame:
    return numbered(rows, "n").withColumn("cid", F.concat(F.lit("c"), F.col("n").cast("string")))


def from_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Comments of JSON lines with the ten fields; blank lines are skipped."""
    return spark.read.schema(COMMENT).json(path).where("cid is not null")


def to_csv(comments: DataFrame, path: str) -> None:
    """Write the seven display columns as CSV with a header."""
    out = comments.select("cid", "text", "author", "likes", F.col("published").alias("time"), "emojis", F.round("valence", 3).alias("valence"))
    out.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def corpus(comments: DataFrame) -> DataFrame:
    """One row for each cid, the last loaded, with defaults for missing cells."""
    order = [F.col(c).desc_nulls_last() for c in ("loaded_at", "likes", "reply_count", "published") if c in comments.columns]
    last = Window.partitionBy("cid").orderBy(*order)
    blank = {"text": "", "author": "", "published": "", "emojis": "", "likes": 0, "reply_count": 0, "valence": 0.0, "is_reply": False}
    rows = comments.where("cid is not null").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return rows.fillna({k: v for k, v in blank.items() if k in comments.columns})


def checked(comments: DataFrame) -> DataFrame:
    """The same rows, refused if there are none."""
    if comments.isEmpty():
        raise ValueError("cannot build a store with no comments")
    return comments


def save(comments: DataFrame, path: str, dim: int, embedder: str = "hashing") -> None:
    """Write comments as Parquet with a manifest beside them."""
    comments.write.mode("overwrite").parquet(f"{path}/comments")
    about = {"format_version": 1, "count": comments.count(), "dim": dim, "embedder": embedder}
    spark = comments.sparkSession
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Read what ``save`` wrote; refuses another dimension of vectors."""
    try:
        about = json.loads(spark.read.text(f"{path}/manifest").first().value)
    except Exception as why:
        raise FileNotFoundError(f"no index at {path}") from why
    if about["dim"] != dim:
        raise ValueError(f"index has vectors of {about['dim']}, not {dim}, numbers")
    return spark.read.parquet(f"{path}/comments")


def from_pages(spark: SparkSession, fetch: Callable[[int], Iterable[dict]], pages: int, now: float, limit: int = 500) -> DataFrame:
    """Comments that ``fetch(page)`` gives, at most ``limit`` (one at least).

    Pages are fetched by the executors, a page in a partition, a few pages at a time
    until there are enough comments or an empty page comes; no client for a network
    comes with this. Refused if nothing comes.
    """
    if pages < 1:
        raise ValueError("no pages")
    at_once = max(1, spark.sparkContext.defaultParallelism)

    class Fetched(DataSource):
        @classmethod
        def name(cls) -> str:
            return "fetched_comments"

        def schema(self) -> str:
            return "row long, " + ", ".join(f"{n} string" for n in ("page", *RAW))

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Pages(fetch, int(self.options["first"]), int(self.options["last"]))

    spark.dataSource.register(Fetched)
    got, have = None, 0
    for first in range(0, pages, at_once):
        last = min(first + at_once, pages)
        some = stage_table(spark.read.format("fetched_comments").options(first=first, last=last).load(), "pages")
        got = some if got is None else got.unionByName(some)
        came = some.select(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages")).first()
        have += came.n
        if have >= max(1, limit) or came.pages < last - first:
            break
    if not have:
        raise ValueError("nothing was fetched")
    raw = got.withColumn("votes", F.coalesce("votes", "likes")).drop("likes")
    return normalise(_ids(raw.orderBy(F.col("page").cast("long"), "row").drop("row")).where(F.col("n") < max(1, limit)), now)


def batches(comments: DataFrame, size: int = 1000) -> Iterator[list[Row]]:
    """The rows in lists of ``size``, a partition at a time on the driver."""
    if size < 1:
        raise ValueError("a batch must have a row at least")
    held: list[Row] = []
    for row in comments.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


class _Pages(DataSourceReader):
    def __init__(self, fetch: Callable[[int], Iterable[dict]], first: int, last: int) -> None:
        self.fetch, self.first, self.last = fetch, first, last

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.first, self.last)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n, record in enumerate(self.fetch(partition.value)):
            yield (n, str(partition.value), *(None if record.get(k) is None else str(record[k]) for k in RAW))
