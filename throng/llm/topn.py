"""Top N rows of every group by statistics-guided skipping.

Rows are written once, clustered by group and, inside a group, by descending
score, into Parquet files of row groups small enough that a large group has many
to itself. A range partitioning on (group, score, tie) splits a group of any size
over as many files as it needs. Then only footers are read for every row group, and
data pages for few:

* a row group that holds one group only, with at least N rows, proves that the
  group's N-th score is no less than its own least score; every row group of that
  group alone whose greatest score is strictly below the greatest such proof is
  skipped unread, whatever file it is in;
* a task reads the row groups of its file in descending greatest score and skips
  those strictly below the N-th score that every group in them has reached by then.

Rows are in order of their groups, so of the several groups in a row group all but
the first begin there and have reached nothing before: a row group with several
groups is never below all of them and is always read. What remains is at most N
rows of a group for each row group read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from throng.session import stage_path

CLUSTERED = "grp string, score long, tie string"
FOOTER = "path string, row_group long, first string, last string, low long, high long, rows long"
#: Rows of a row group, the unit of skipping, and of a file, the unit of reading.
ROW_GROUP_ROWS, FILE_ROWS = 4096, 4_000_000


def _open(path: str) -> pq.ParquetFile:
    files, at = pa.fs.FileSystem.from_uri(path)
    return pq.ParquetFile(files.open_input_file(at))


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            with _open(path) as file:
                meta = file.metadata
                at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
                out = []
                for k in range(meta.num_row_groups):
                    part = meta.row_group(k)
                    grp, score = (part.column(at[c]).statistics for c in ("grp", "score"))
                    # the writer leaves out statistics of very long strings
                    ends = (grp.min, grp.max) if grp is not None and grp.has_min_max else (None, None)
                    out.append((path, k, *ends, score.min, score.max, part.num_rows))
                yield pd.DataFrame(out, columns=["path", "row_group", "first", "last", "low", "high", "rows"])


def _firsts(rows: pa.Table, n: int) -> pd.DataFrame:
    """The first ``n`` rows of each run of a group."""
    codes = pc.run_end_encode(rows["grp"].combine_chunks())
    ends = codes.run_ends.to_numpy()
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(rows)) - np.repeat(starts, ends - starts)
    return rows.filter(pa.array(place < n)).to_pandas()


def _reader(n: int, report: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Row groups come by file and descending greatest score; one is held at a time."""
        file, path, reached = None, None, {}
        for batch in batches:
            for row in batch.itertuples():
                if row.path != path:
                    if file:
                        file.close()
                    file, path, reached = _open(row.path), row.path, {}
                best = reached.get(row.first, ())
                skip = row.first is not None and row.first == row.last and len(best) == n and row.high < best[-1]
                if report:
                    yield pd.DataFrame({"path": [path], "row_group": [row.row_group], "read": [not skip]})
                if skip:
                    continue
                top = _firsts(file.read_row_group(int(row.row_group), columns=["grp", "score", "tie"]), n)
                for grp in {row.first, row.last} - {None}:
                    scores = top["score"][top["grp"] == grp].tolist()
                    reached[grp] = sorted([*reached.get(grp, ()), *scores], reverse=True)[:n]
                if not report:
                    yield top
        if file:
            file.close()

    return read


def write_clustered(rows: DataFrame, group: str, score: str, tie: str, files: int | None = None, row_group_rows: int = ROW_GROUP_ROWS, row_group_bytes: int = 16 << 20) -> str:
    """Write the rows that count in order of group, score and tie; the folder's path.

    files: partitions of the copy; None: as the sizes suggest at run time. No file
    has more than FILE_ROWS rows.
    """
    slim = rows.select(F.col(group).cast("string").alias("grp"), F.col(score).cast("long").alias("score"), F.col(tie).cast("string").alias("tie")).where("grp <> '' and score is not null and tie is not null")
    order = ("grp", F.desc("score"), "tie")
    path = stage_path(rows.sparkSession, "p2-clustered")
    parted = slim.repartitionByRange(files, *order) if files else slim.repartitionByRange(*order)
    sized = {"parquet.block.row.count.limit": row_group_rows, "parquet.block.size": row_group_bytes, "maxRecordsPerFile": FILE_ROWS}
    parted.sortWithinPartitions(*order).write.options(**sized).parquet(path)
    return path


def wanted_row_groups(spark: SparkSession, path: str, n: int) -> tuple[DataFrame, DataFrame]:
    """All row groups of a clustered copy, and those that no proof excludes, each
    file in one partition in the order in which they are to be read."""
    names = [(x,) for x in spark.read.schema(CLUSTERED).parquet(path).inputFiles()]
    files = max(1, len(names))
    footers = spark.createDataFrame(names, "path string").repartition(files, "path").mapInPandas(_footers, FOOTER).where("rows > 0")
    one = F.col("first") == F.col("last")
    proofs = footers.where(one & (F.col("rows") >= n)).groupBy(F.col("first").alias("of")).agg(F.max("low").alias("proof"))
    # proofs grow with the data: both sides are shuffled, none is broadcast
    todo = footers.join(proofs.hint("merge"), one & (F.col("first") == F.col("of")), "left").where("proof is null or high >= proof").drop("of", "proof")
    return footers, todo.repartition(files, "path").sortWithinPartitions("path", F.desc("high"), "row_group")


def top_n_by_group(rows: DataFrame, group: str, score: str, tie: str, n: int = 3, files: int | None = None, row_group_rows: int = ROW_GROUP_ROWS, row_group_bytes: int = 16 << 20) -> DataFrame:
    """``group``, ``place`` (1 to ``n``), ``tie`` and ``score`` of the best rows.

    Order: score descending, then tie ascending as a string; rows equal in both
    get neighbouring places. Rows with a null or empty group, a null score or a
    null tie are left out; an empty input gives an empty result. Columns other
    than the three are not used, whatever their names. The other arguments are
    those of ``write_clustered``.
    """
    path = write_clustered(rows, group, score, tie, files, row_group_rows, row_group_bytes)
    picked = wanted_row_groups(rows.sparkSession, path, n)[1].mapInPandas(_reader(n, False), CLUSTERED)
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "tie"))
    return picked.withColumn("place", place.cast("long")).where(F.col("place") <= n).select(F.col("grp").alias(group), "place", F.col("tie").alias(tie), F.col("score").alias(score))


def row_groups_read(rows: DataFrame, group: str, score: str, tie: str, n: int = 3, **sizes: int) -> DataFrame:
    """One row: how many row groups the clustered copy has, how many are skipped by
    proofs from footers, how many while reading, and how many are read."""
    path = write_clustered(rows, group, score, tie, **sizes)
    footers, todo = wanted_row_groups(rows.sparkSession, path, n)
    told = todo.mapInPandas(_reader(n, True), "path string, row_group long, read boolean")
    out = footers.select("path", "row_group").join(told, ["path", "row_group"], "left")
    return out.agg(F.count(F.lit(1)).alias("row_groups"), F.count_if(F.col("read").isNull()).alias("proved"), F.count_if(~F.col("read")).alias("passed"), F.count_if("read").alias("read"))


def latest(comments: DataFrame) -> DataFrame:
    """Of each cid the author and likes of the row with the latest ``loaded_at``.

    Of rows loaded at the same time, the one with more likes and then the greater
    author counts. A null ``loaded_at`` is earlier than any. Null cids are left out.
    """
    newest = F.max(F.struct("loaded_at", "likes", "author")).alias("row")
    return comments.where("cid is not null").groupBy("cid").agg(newest).select("cid", "row.author", "row.likes")


def found(comments: DataFrame) -> DataFrame:
    """The first three comments of every author."""
    return top_n_by_group(latest(comments), "author", "likes", "cid").select("author", "place", "cid")
