"""Which plan answers a question: exact, a reading of opinions, or both.

What a question may look like is written as rules of words: ``a|b`` stands for one
of several words, ``word?`` may be missing, ``*`` is any word or none, ``...`` is
anything between, ``_`` is a blank inside one choice, ``!a|b`` must not follow and
``TERM`` takes the words up to " and " or the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What asks for something exact; the first that fits counts.
INTENTS = {
    "mention_count": ("how many comment|comments|people|users|viewers|of_them? mention|mentions|mentioned|talk_about|talks_about|talked_about|say|says|said|reference|discuss|discusses TERM",),
    "top_liked": ("most|highest|top liked|likes|upvoted|rated|popular|voted", "most|highest|top * comment|one", "top|best comment|comments", "comment ... most|highest likes|votes"),
    "top_authors": ("who commented|posted|wrote the? most", "most active|prolific user|commenter|author|person", "which user|author|commenter ... most"),
    "longest": ("longest|shortest|biggest|wordiest comment",),
    "sentiment": ("sentiment|valence breakdown|split|distribution|ratio", "how many ... positive|negative", "positive|negative vs|versus|to positive|negative"),
    "timeline": ("when were|was|did ... post|posts|posted|comment|comments|commented|written", "comment timeline"),
    "stats": ("average|mean|median|typical ... like|likes|comment|comments|length", "statistics|stats"),
    "count_all": ("how many comment|comments !mention|talk|say", "total|overall number|count of comment|comments", "comment count", "how many people commented"),
}
# Signs that a question is about what people think on the whole, and
# that it wants more than a number.
CONSENSUS = (
    "overall|in_general|generally|consensus|majority|most_people|everyone|public_opinion", "general opinion|reaction|sentiment|feeling|mood", "what do people|they|viewers|fans think", "how do people|they|viewers|fans feel",
    "sentiment|reaction|vibe|mood|gist|summary|summarise|summarize|tldr|tl;dr", "positive|negative|mixed ... or|vs",
)
ELABORATION = ("and what|why|how", "what do they say|think", "explain|describe|summary|summarise|summarize")
FILLER = ("the", "a", "an", "this", "that", "it", "about")
#: Weights of relevance, support and endorsement.
RELEVANCE, SHARED, OVERVIEW = (0.6, 0.2, 0.2), (0.25, 0.4, 0.35), (0.0, 0.55, 0.45)


def pattern(rule: str) -> str:
    """A rule of words as a regular expression for lower-case text."""
    out = r"\b"
    gap = ""
    for part in rule.split():
        if part == "...":
            out, gap = out + r"\b.*", r"\b"
        elif part == "TERM":
            out, gap = out + r"\s+(.+?)(?:\s+and\s.*)?[?.]*$", ""
        elif part == "*":
            gap = r"\s+(?:\w+\s+)?"
        elif part[0] == "!":
            out += rf"\b(?!\s+(?:{part[1:]}))"
        else:
            words = part.removesuffix("?").replace(";", ";?").replace("_", r"\s+")
            if part[-1] == "?":
                out += rf"(?:{gap}(?:{words}))?"
            else:
                out += f"{gap}(?:{words})"
            gap = r"\s+"
    return out if out.endswith(("$", "))")) else out + r"\b"


def any_of(rules: tuple[str, ...]) -> str:
    """A regular expression that fits what any of the rules fits."""
    return "|".join(pattern(r) for r in rules)


def clean_term(term: Column) -> Column:
    """A term without final punctuation and filler words, if others are left."""
    bare = F.regexp_replace(F.lower(F.trim(term)), r"[?.!,]+$", "")
    words = F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~w.isin(*FILLER))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(bare)


def route(questions: DataFrame, words: str = "words") -> DataFrame:
    """``kind, intent, term`` and the three weights beside every question.

    kind: AGGREGATE (exact), HYBRID (exact and a reading), CONSENSUS or SEMANTIC.
    intent is null and term '' where nothing exact is asked; blank and null
    questions are SEMANTIC.
    """
    text = F.lower(F.trim(F.coalesce(F.col(words), F.lit(""))))
    intent = F.coalesce(*[F.when(text.rlike(any_of(rules)), name) for name, rules in INTENTS.items()])
    shared, more = text.rlike(any_of(CONSENSUS)), text.rlike(any_of(ELABORATION))
    out = questions.withColumns({"intent": intent, "__shared": shared, "__more": more})
    exact, shared, more = F.col("intent").isNotNull(), F.col("__shared"), F.col("__more")
    kind = F.when(exact & (shared | more), "HYBRID").when(exact, "AGGREGATE").when(shared, "CONSENSUS").otherwise("SEMANTIC")
    heavy = shared & (kind != "AGGREGATE")
    weights = [F.when(heavy, s).otherwise(r).alias(n) for n, s, r in zip(("salience_weight", "support_weight", "endorsement_weight"), SHARED, RELEVANCE, strict=True)]
    term = F.when(F.col("intent") == "mention_count", clean_term(F.regexp_extract(text, pattern(INTENTS["mention_count"][0]), 1))).otherwise("")
    return out.select("*", kind.alias("kind"), F.coalesce(term, F.lit("")).alias("term"), *weights).drop("__shared", "__more")
