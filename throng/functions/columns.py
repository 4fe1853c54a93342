"""Column expressions on comment records; all run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of each unit of age, with the mean month and year.
UNIT_SECONDS = {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0, "week": 604800.0, "month": 2629746.0, "year": 31556952.0}
# Emoji with an opinion.
POSITIVE = "❤🧡💛💚💙💜🖤🤍🤎💖💕💗💓💞💘😍🥰😘🤩😊😁😄😃🙂😂🤣😹👍👏🙌🔥💯✨⭐🌟🏆🥇💪🫶🤝🎉🎊😻🥹"
NEGATIVE = "😡🤬😠👎💀☠😢😭😞😔😩😫🤮🤢🙄😒😑😐🥱💩⚰🚮❌⛔😤😰😱"
# English words that say nothing about a question's topic.
STOPWORDS = (
    "a an the this that these those there here i me my we our you your he she it its they them their is are was were be been being am do does did doing done have has had having "
    "what which who whom whose when where why how can could will would shall should may might must of in on at to for with about from by as into over under and or but nor so yet if then than "
    "because while not no none any some all more most other another such own same myself us tell show give find get say says said saying told think thinks thinking thought feel feels feeling felt "
    "people person everyone anyone someone somebody folks comment comments commenter commenters video videos mention mentions mentioned mentioning talk talks talked talking regarding concerning "
    "please just really very much many lot lots s t ll re ve d m o"
).split()
# Words that older indexes dropped from questions as well.
COMPAT_WORDS = ("word", "list", "reads", "better", "than", "60", "quoted", "strings")
#: What no word goes on with; engines differ on classes such as \\w.
WORD_SIGN = r"[\p{L}\p{N}_]"


def _symbols() -> str:
    """Ranges of all characters that Python's tables call other symbols, which are
    newer than those of most Java releases, with the emoji blocks and joiners."""
    spans: list[list[int]] = []
    for cp in range(0x110000):
        if unicodedata.category(chr(cp)) == "So" or 0x1F000 <= cp <= 0x1FAFF or cp in (0x200D, 0xFE0E, 0xFE0F):
            if spans and spans[-1][1] == cp - 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)


EMOJI = _symbols()
COUNT = r"^([0-9][0-9,. ]*) *([kmbKMB])?$"
AGE = r"(?i)([0-9]+)\s*(second|minute|hour|day|week|month|year)s?\s*ago"
LONG_MAX = 2**63 - 1
#: Valence from which a comment is positive, and down to which it is negative.
POSITIVE_FROM, NEGATIVE_TO = 0.2, -0.2


def collapsed(text: Column) -> Column:
    """Runs of any blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def parse_count(raw: Column) -> Column:
    """A displayed count as a bigint: thousands commas, K, M or B; else 0.

    Null and what isn't a count give 0; halves round to even; beyond a bigint it
    is the greatest one.
    """
    text = F.regexp_replace(F.coalesce(raw.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
    number = F.regexp_replace(F.regexp_extract(text, COUNT, 1), "[, ]", "").try_cast("double")
    suffix = F.lower(F.regexp_extract(text, COUNT, 2))
    value = F.rint(number * F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "b", 1e9).otherwise(1.0))
    return F.when(value >= float(LONG_MAX), F.lit(LONG_MAX)).otherwise(F.coalesce(F.greatest(value, F.lit(0.0)).try_cast("bigint"), F.lit(0)))


def prose(text: Column) -> Column:
    """The text without emoji, blanks collapsed; null gives ''."""
    return collapsed(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{EMOJI}]", ""))


def emoji_of(text: Column) -> Column:
    """The emoji of a text in order, without joiners; null gives ''."""
    only = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{EMOJI}]", "")
    return F.regexp_replace(only, r"[\x{200D}\x{FE0E}\x{FE0F}]", "")


def valence(emojis: Column) -> Column:
    """(positive - negative) / (positive + negative) emoji, 0 without either."""
    count = lambda known: F.length(F.regexp_replace(F.coalesce(emojis, F.lit("")), f"[^{known}]", ""))
    up, down = count(POSITIVE), count(NEGATIVE)
    return F.when(up + down > 0, (up - down) / (up + down)).otherwise(F.lit(0.0))


def age_seconds(published: Column) -> Column:
    """Seconds of "<n> <unit>s ago" anywhere in a text, else null."""
    amount = F.regexp_extract(published, AGE, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(published, AGE, 2))
    seconds = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    return F.when(amount.isNotNull() & (unit != ""), amount * F.try_element_at(seconds, unit))


def published_at(published: Column, now: float) -> Column:
    """POSIX seconds of a relative age seen from ``now``, else null."""
    return F.lit(float(now)) - age_seconds(published)


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))


def query_tokens(text: Column, compat: bool = False) -> Column:
    """Tokens that aren't stopwords; possibly none. compat: leave out COMPAT_WORDS too."""
    stop = F.array(*[F.lit(w) for w in (*STOPWORDS, *(COMPAT_WORDS if compat else ()))])
    return F.filter(tokens(text), lambda t: ~F.array_contains(stop, t))


def mood(value: Column) -> Column:
    """positive, negative or neutral by valence."""
    return F.when(value >= POSITIVE_FROM, "positive").when(value <= NEGATIVE_TO, "negative").otherwise("neutral")


def mentions(text: Column, term: Column) -> Column:
    """Whether a term stands in the text with no letter, number or underscore on
    either side, in any case; a blank or null term does nowhere."""
    word = F.lower(F.trim(F.coalesce(term, F.lit(""))))
    quoted = F.regexp_replace(word, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1")
    edged = F.concat(F.lit(rf"(?<!{WORD_SIGN})"), quoted, F.lit(rf"(?!{WORD_SIGN})"))
    return (word != "") & F.regexp_like(F.lower(F.coalesce(text, F.lit(""))), edged)


def excerpt(text: Column, limit: int = 160) -> Column:
    """Blanks collapsed, cut to ``limit`` characters with an ellipsis."""
    flat = collapsed(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def embedding_text(text: Column, emojis: Column) -> Column:
    """What stands for a comment: its text, else its emoji, else a blank."""
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(emojis, F.lit("")), F.lit(" "))
