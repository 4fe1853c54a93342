"""Exact results put into words: a headline fact, then what stands beside it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from throng.functions import columns as C
from throng.operators import aggregates

#: Rows a fact lists.
LISTED = 5


def whole(value: float) -> str:
    """A number without decimals, thousands apart."""
    return f"{value:,.0f}"


def percent(part: float) -> str:
    """A share in percent with one decimal."""
    return f"{part * 100:.1f}%"


def counted(n: int, one: str) -> str:
    """A number with its noun."""
    return f"{whole(n)} {one}" if n == 1 else f"{whole(n)} {one}s"


def told(*facts: tuple[str, str]) -> str:
    """Label and value of each fact, one after another."""
    return "; ".join(f"{label}: {value}" for label, value in facts)


def rows_of(df: DataFrame) -> list[dict]:
    """A few result rows as dictionaries."""
    return [r.asDict() for r in df.collect()]


def _result(text: str, data: dict, cited: list[str] | None = None) -> dict[str, Any]:
    return {"text": text, "citations": cited or [], "data": data}


def _comment(r: dict) -> str:
    by = ", ".join(x for x in (r.get("author"), r.get("published")) if x)
    return f'"{r["shown"]}"{f" ({by})" if by else ""} [{r["cid"]}]'


def top_liked(comments: DataFrame, term: str) -> dict[str, Any]:
    said = F.when(F.col("text") != "", F.col("text")).otherwise(F.col("emojis"))
    top = rows_of(aggregates.top_liked(comments, 3).select("cid", "author", "likes", "published", C.excerpt(said, 120).alias("shown")))
    labels = ["most liked", "second", "third"]
    return _result(told(*((f"{label}, {counted(r['likes'], 'like')}", _comment(r)) for label, r in zip(labels, top, strict=False))), {"top": top}, [r["cid"] for r in top])


def count_all(comments: DataFrame, term: str) -> dict[str, Any]:
    r = rows_of(comments.agg(F.count(F.lit(1)).alias("comments"), F.coalesce(F.sum("likes"), F.lit(0)).alias("total_likes")))[0]
    return _result(told(("size", f"{counted(r['comments'], 'comment')}, {counted(r['total_likes'], 'like')}")), r)


def mention_count(comments: DataFrame, term: str) -> dict[str, Any]:
    r = rows_of(aggregates.mention_report(comments, [term]))[0] | {"total": comments.count()}
    if not r["count"]:
        return _result(told((f'"{term}"', "in no comment")), r)
    cited = [x.cid for x in aggregates.mentioning(comments, term).orderBy(F.length("cid"), "cid").limit(10).select("cid").collect()]
    return _result(told((f'"{term}"', f"in {whole(r['count'])} of {counted(r['total'], 'comment')}, {percent(r['share'])}"), ("their likes", whole(r["likes"]))), r, cited)


def top_authors(comments: DataFrame, term: str) -> dict[str, Any]:
    rows = rows_of(aggregates.top_authors(comments, LISTED))
    if not rows:
        return _result(told(("authors", "none is known")), {})
    return _result(told(*((r["author"], f"{counted(r['comments'], 'comment')}, {counted(r['likes'], 'like')}") for r in rows)), {"authors": rows})


def longest(comments: DataFrame, term: str) -> dict[str, Any]:
    r = rows_of(aggregates.longest(comments, 1).select("cid", "author", "length", C.excerpt(F.col("text"), 240).alias("shown")))[0]
    return _result(told((f"longest, {counted(r['length'], 'character')}", _comment(r))), {"cid": r["cid"], "length": r["length"]}, [r["cid"]])


def stats(comments: DataFrame, term: str) -> dict[str, Any]:
    s = rows_of(aggregates.corpus_stats(comments))[0]
    likes = f"mean {s['mean_likes']:.1f}, median {whole(s['median_likes'])}, greatest {whole(s['max_likes'])}, sum {whole(s['total_likes'])}"
    return _result(told(("size", counted(s["comments"], "comment")), ("likes of a comment", likes), ("the greatest has of all likes", percent(s["top_comment_like_share"])), ("mean length", f"{s['mean_length']:.1f}")), s)


def timeline(comments: DataFrame, term: str) -> dict[str, Any]:
    rows = rows_of(aggregates.timeline(comments).orderBy("bucket"))
    most = max(rows, key=lambda r: r["count"])
    return _result(told(("oldest to newest", ", ".join(f"{r['label']} {whole(r['count'])}" for r in rows)), ("busiest", f"{most['label']}, {counted(most['count'], 'comment')}")), {"timeline": rows})


def sentiment(comments: DataFrame, term: str) -> dict[str, Any]:
    b = rows_of(aggregates.sentiment(comments))[0]
    total = max(1, b["positive"] + b["negative"] + b["neutral"])
    each = ((m, f"{counted(b[m], 'comment')}, {percent(b[m] / total)}, {counted(b[f'like_weighted_{m}'], 'like')}") for m in ("positive", "negative", "neutral"))
    return _result(told(("mood", "as emoji tell it, words aren't read"), *each), b)


INTENTS: dict[str, Callable[[DataFrame, str], dict[str, Any]]] = {f.__name__: f for f in (top_liked, count_all, mention_count, top_authors, longest, stats, timeline, sentiment)}
