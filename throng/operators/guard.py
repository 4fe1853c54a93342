"""Checking answers against the comments and figures they may state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What cites a comment, and what states a percentage or a count.
CITATION = r"\[\s*(c[0-9]+)\s*\]"
PERCENT = r"([0-9]+(?:\.[0-9]+)?)\s*%"
COUNTED = r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s+(likes?|upvotes?|comments?|commenters?|people|users|viewers|replies)\b"
#: How far a stated percentage and count may be from a computed one.
PERCENT_WITHIN, COUNT_WITHIN = 1.0, 0.51


def citations(text: Column) -> Column:
    """Ids cited in a text, lower-case, each once in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(CITATION), F.lit(1)))


def stated(text: Column) -> Column:
    """Percentages and counts that a text states, each as ``whole, value, within``:
    its words, its number and how far a computed number may be from it."""

    def told(pattern: str, within: float) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        number = lambda x: F.regexp_replace(x["value"], ",", "").try_cast("double").alias("value")
        return F.transform(F.arrays_zip(whole.alias("whole"), value.alias("value")), lambda x: F.struct(x["whole"].alias("whole"), number(x), F.lit(within).alias("within")))

    return F.concat(told(PERCENT, PERCENT_WITHIN), told(COUNTED, COUNT_WITHIN))


def verify(answers: DataFrame, text: str = "text", ids: str = "allowed_ids", numbers: str = "allowed_numbers") -> DataFrame:
    """Answers with ``clean, citations, invalid, unsupported, grounded, warnings``.

    ``clean`` is the text without citations of ids that aren't allowed;
    ``unsupported`` are percentages and counts that no allowed number is near.
    Without allowed numbers figures aren't checked; nulls count as nothing allowed.
    """
    allowed = F.transform(F.coalesce(F.col(ids), F.array().cast("array<string>")), F.lower)
    figures = F.coalesce(F.col(numbers), F.array().cast("array<double>"))
    cited = citations(F.col(text))
    out = answers.withColumn("citations", F.array_intersect(cited, allowed)).withColumn("invalid", F.array_except(cited, allowed))
    strip = F.aggregate("invalid", F.coalesce(F.col(text), F.lit("")), lambda acc, bad: F.regexp_replace(acc, F.concat(F.lit(r"(?i)\s*\[\s*"), bad, F.lit(r"\s*\]")), F.lit("")))
    out = out.withColumn("clean", F.trim(F.regexp_replace(strip, r"\s+([.,;:])", "$1")))

    bare = F.filter(stated(F.col("clean")), lambda x: ~F.exists(figures, lambda n: F.abs(n - x["value"]) <= x["within"]))
    found = F.transform(bare, lambda x: x["whole"])
    out = out.withColumn("unsupported", F.when(F.size(figures) > 0, found).otherwise(F.array().cast("array<string>")))
    told = F.array(
        F.when(F.size("invalid") > 0, F.concat(F.lit("removed citations of comments that weren't retrieved: "), F.array_join("invalid", ", "))),
        F.when(F.size("unsupported") > 0, F.concat(F.lit("figures that nothing computed supports, perhaps invented: "), F.array_join("unsupported", ", "))),
        F.when((F.size("citations") == 0) & (F.size("invalid") == 0), F.lit("no citation, so the answer can't be traced to a comment")),
    )
    return out.withColumn("grounded", (F.size("invalid") == 0) & (F.size("unsupported") == 0)).withColumn("warnings", F.filter(told, lambda w: w.isNotNull()))
