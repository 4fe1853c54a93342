"""Exact answers over every comment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from throng.functions import columns as C
from throng.operators.search import positions


def corpus_stats(comments: DataFrame) -> DataFrame:
    """One row: counts, likes (sum, mean, exact median, most), mean length of text
    and the share of all likes that the most liked comment has."""
    out = comments.agg(
        F.count(F.lit(1)).alias("comments"),
        F.coalesce(F.sum("likes"), F.lit(0)).alias("total_likes"),
        F.coalesce(F.avg("likes"), F.lit(0.0)).alias("mean_likes"),
        F.coalesce(F.median("likes"), F.lit(0.0)).alias("median_likes"),
        F.coalesce(F.max("likes"), F.lit(0)).alias("max_likes"),
        F.coalesce(F.avg(F.length("text")), F.lit(0.0)).alias("mean_length"),
    )
    return out.withColumn("top_comment_like_share", F.when(F.col("total_likes") > 0, F.col("max_likes") / F.col("total_likes")).otherwise(0.0))


def top_liked(comments: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most liked, then by cid as a string."""
    return comments.orderBy(F.desc("likes"), "cid").limit(n)


def longest(comments: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` with the longest text, then by cid."""
    return comments.withColumn("length", F.length("text")).orderBy(F.desc("length"), "cid").limit(n)


def authors(comments: DataFrame) -> DataFrame:
    """Comments and likes of every known author."""
    return comments.where("author <> ''").groupBy("author").agg(F.count(F.lit(1)).alias("comments"), F.sum("likes").alias("likes"))


def top_authors(comments: DataFrame, n: int = 5) -> DataFrame:
    """The authors with most comments, then most likes, then by name."""
    return authors(comments).orderBy(F.desc("comments"), F.desc("likes"), "author").limit(n)


def mention_report(comments: DataFrame, terms: list[str]) -> DataFrame:
    """For each term: count, share and likes of the comments that mention it.

    All terms are counted in one pass; a blank term is mentioned nowhere.
    """
    hits = [(t, C.mentions(F.col("text"), F.lit(t))) for t in terms]
    sums = [x for i, (_, hit) in enumerate(hits) for x in (F.count_if(hit).alias(f"n{i}"), F.coalesce(F.sum(F.when(hit, F.col("likes"))), F.lit(0)).alias(f"l{i}"))]
    wide = comments.agg(F.count(F.lit(1)).alias("all"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"n{i}").alias("count"), (F.col(f"n{i}") / F.greatest(F.lit(1), F.col("all"))).alias("share"), F.col(f"l{i}").alias("likes")) for i, (t, _) in enumerate(hits)]))
    return wide.select(rows.alias("r")).select("r.*")


def mention_cids(comments: DataFrame, terms: list[str]) -> DataFrame:
    """``term, cid, place`` of every comment that mentions a term, in the order of
    their numbers, for terms of any frequency."""
    hit = F.filter(F.array(*[F.when(C.mentions(F.col("text"), F.lit(t)), F.lit(t)) for t in terms]), lambda t: t.isNotNull())
    rows = comments.select(F.explode(hit).alias("term"), "cid")
    return positions(rows, "term", F.length("cid"), F.col("cid"))


def mentioning(comments: DataFrame, term: str) -> DataFrame:
    """The comments that mention a term."""
    return comments.where(C.mentions(F.col("text"), F.lit(term)))


def sentiment(comments: DataFrame) -> DataFrame:
    """Comments and likes by mood, in one row."""
    mood = C.mood(F.col("valence"))
    moods = ("positive", "negative", "neutral")
    counts = [F.count_if(mood == m).alias(m) for m in moods]
    likes = [F.coalesce(F.sum(F.when(mood == m, F.col("likes"))), F.lit(0)).alias(f"like_weighted_{m}") for m in moods]
    return comments.agg(*counts, *likes)


def timeline(comments: DataFrame, buckets: int = 6) -> DataFrame:
    """Comments and likes in equal spans of time, oldest first, empty ones too.

    ``bucket`` from 0. Undated comments join the last one. The label is the age as
    displayed of a bucket's newest comment, both ends of the span included; ties go
    to the lowest cid. Without dates, or for fewer than one bucket, there is one
    row "unknown".
    """
    frame = comments.sparkSession.range(max(1, buckets)).withColumnRenamed("id", "bucket")
    whole = comments.agg(F.min("published_ts").alias("oldest"), F.max("published_ts").alias("newest"), F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("likes"), F.lit(0)).alias("likes")).first()
    if whole.oldest is None or buckets < 1:
        nothing = F.lit(None).cast("double")
        return frame.where("bucket = 0").select("bucket", F.lit("unknown").alias("label"), F.lit(whole["count"]).alias("count"), F.lit(whole.likes).alias("likes"), nothing.alias("start"), nothing.alias("end"))
    oldest, width = F.lit(whole.oldest), F.lit(max(whole.newest - whole.oldest, 1e-6) / buckets)
    frame = frame.select("bucket", (oldest + F.col("bucket") * width).alias("start"), (oldest + (F.col("bucket") + 1) * width).alias("end"))
    own = F.coalesce(F.least(F.lit(buckets - 1), F.floor((F.col("published_ts") - oldest) / width)), F.lit(buckets - 1)).cast("long")
    # a dated comment on the border labels both buckets, but counts in its own
    near = F.filter(F.array("own", F.col("own") - 1, F.col("own") + 1), lambda k: (k == F.col("own")) | F.col("published_ts").between(oldest + k * width, oldest + (k + 1) * width))
    rows = comments.select("cid", "likes", "published", "published_ts", own.alias("own")).withColumn("bucket", F.explode(near))
    home = F.col("bucket") == F.col("own")
    inside = F.col("published_ts").between(oldest + F.col("bucket") * width, oldest + (F.col("bucket") + 1) * width) & (F.col("published") != "")
    counts = rows.groupBy("bucket").agg(F.count_if(home).alias("count"), F.sum(F.when(home, F.col("likes"))).alias("likes"), F.min_by("published", F.when(inside, F.struct(-F.col("published_ts"), F.col("cid")))).alias("label"))
    out = frame.join(counts, "bucket", "left")
    return out.select("bucket", F.coalesce("label", F.concat(F.lit("bucket "), F.col("bucket") + 1)).alias("label"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("likes", F.lit(0)).alias("likes"), "start", "end")


def like_distribution(comments: DataFrame, bins: int = 24) -> DataFrame:
    """Comments in equal bins of log10(likes + 1), the last one closed."""
    value = F.log10(F.col("likes") + 1)
    ends = comments.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    frame = comments.sparkSession.range(bins if ends.low is not None else 0).withColumnRenamed("id", "bin")
    low = ends.low or 0.0
    width = ((ends.high if ends.high is not None and ends.high > low else low + 1) - low) / bins
    counts = comments.groupBy(F.least(F.lit(bins - 1), F.floor((value - low) / width)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("comments"))
    return frame.join(counts, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * width).alias("start"), F.coalesce("comments", F.lit(0)).alias("comments"))
