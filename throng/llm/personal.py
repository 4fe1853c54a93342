"""Finding personal information in comments and replacing it by placeholders.

Weak supervision without labels: generous patterns propose spans; for each kind a
few labelers (formats, gazetteers, words around the span) vote for it, against it
or not at all; expectation-maximisation over the counts of all vote patterns in
the corpus estimates how reliable each labeler is; the resulting probabilities
train a linear span classifier on votes, shape and neighbouring words, which
decides every span. Texts are matched in a folded form of the same length, so a
value comes out exactly as it stands, full-width digits included.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from throng.llm.canon import SAME_SHAPE, canonical_segment
from throng.session import stage_table

KINDS = ("email", "phone", "id", "address", "name")
#: Spans that the classifier is fitted on at most, drawn by a hash of the span.
MOST_SPANS = 20_000
#: Labelers of names that know some of them: given names, endings, words around.
PARTIAL = (0, 1, 2, 3)
#: Words of figures' names that are sent to all tasks.
MOST_FIGURES = 100_000
#: Slots of hashed features.
SLOTS = 1 << 15

# Given names of several languages.
GIVEN = frozenset(
    "adam ahmed aisha alejandro alice amara amir ana anders andrea andreas anita anna anneke antonio astrid beatriz bernd boris brigitte bruno camille carla carlos carmen carol catherine charles chiara chloé christine claire clara daniel david diego dieter dmitri edgar elena eli elias elif emilia emma eric erik esther eva fatima felix fiona frank franz gabriel george gerhard giulia greta grace hana hannah hans hassan heidi helen helga hugo ida ilse ines ingrid irene isabel ivan jakob james jan jana javier jean jelena joao johan john jonas jorge josé juan julia jürgen kai karen karin karl katarina kenji klaus lars laura lea leila lena leon linda lisa liam luca lucas lucia lucía luis maja manuel marco maria marie mario marta martin mary mateo matthias max mehmet mei michael miguel mila milo mohammed monika nadia nicolas niels nina noah noemi nora olga olivia omar oskar otto pablo paolo paul pedro petra philippe pierre priya rachel rafael rahul renée renee robert rosa ruben samir samuel sara sarah sofia sophie stefan susanne sven theo thomas tomas ursula viktor wanda walter yara yuki zoe".split()
)
# Endings of family names.
FAMILY_ENDING = re.compile(r"(?:owitz|wicz|ski|sky|ov|ova|ev|eva|ić|enko|anko|aker|macher|mann|stein|berg|sen|ensen|sson|son|ström|strom|qvist|lund|dottir|idge|bridge|hurst|ton|ham|ley|worth|elli|etti|ini|ardo|ardi|ez|es|eaux|eau|ault|ier|unis|idis|oğlu|poulos|ian|yan)$")
# Words that go before or after a span of a kind.
CUES = {
    "email": "mail email e-mail mails correo adresse address contact hmu write schreib an from at login kontakt reach",
    "phone": "call number phone whatsapp text ruf an handy número numero appelle-moi au reach tel telephone mobile cell telefon escríbeme still",
    "id": "ssn social dni steuer-id ausweisnummer passport passeport reisepass pasaporte ni insurance identity tax nif nie id no no. number is lautet es de",
    "address": "live lives at to merch treffpunkt ist au mándalo wohne adresse moved parcel send never came vivo calle a",
    "name": "name is llamo heiße m'appelle signed from dr dr. teacher neighbour ask am mr mrs ms frau herr señor señora professor prof called",
}
_AFTER_ADDRESS = frozenset("please samedi gracias wie this and immer bitte merci in near before after next today tomorrow".split())
NAME_AFTER = frozenset("from at for showed and y et und the".split())
_AGAINST_BEFORE = frozenset("order patch frame version since build part episode from folge bestellung commande pedido serie season ticket level score".split())
_AGAINST_AFTER = frozenset("views was this of broke is percent likes subscribers times people episodes".split())
# Words of a street's name and where its number goes.
_STREET_EN = "street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|close|boulevard|blvd|way|place|pl|square|sq|terrace|crescent|row|gardens|grove|mews"
_STREET_FR = "rue|avenue|av|impasse|chemin|boulevard|bd|place|allée|allee|quai|cours|route|square|passage|sentier|villa"
_STREET_ES = "calle|c/|avenida|avda|av|plaza|plza|paseo|camino|ronda|travesía|carretera|callejón|glorieta|via|viale|piazza|corso|rua|praça|largo"
_STREET_DE = "straße|strasse|str\\.|str|gasse|weg|allee|platz|ring|ufer|damm|steig|pfad|grund|hof|markt|chaussee"
_LETTER = r"[^\W\d_]"
_WORD = rf"{_LETTER}(?:{_LETTER}|['’-])*"

EMAIL = re.compile(
    r"(?<![\w.+%-])[a-z0-9_](?:[a-z0-9._%+-]*[a-z0-9_])?(?P<at>@| @ |@ | @| ?[(\[{] ?(?:at|@) ?[)\]}] ?| at )[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:(?:\.| ?[(\[{] ?(?:dot|\.|punkt|punto|point) ?[)\]}] ?| dot | punkt )[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+",
    re.I,
)
NUMBER = re.compile(r"(?<![\w:.,/@#$€-])(?:\+ ?)?\(?\d+(?:(?:[ .\-/]|\) ?| ?\(|\)[-./])\d+)*(?![\w])")
IDENTITY = re.compile(r"(?<![\w:.,/@+(-])(?:[a-z]{1,2} ?)?\d{2,9}(?:[ -]?\d{2,7}){0,4}(?:[ -]?[a-z])?(?![\w])", re.I)
_AT_NEXT = re.compile(r"[\w.+-]*(?:@| @| ?[(\[{] ?(?:at|@)| at [\w-]+(?: dot |\.))", re.I)
SMALL = re.compile(r"(?<![\w:.,/-])\d{1,4}(?![\d:.]\d|/|st\b|nd\b|rd\b|th\b)")
ADDRESS_RIGHT = re.compile(
    rf"\d{{1,4}}(?: ?[a-z](?![\w'’]))?(?:(?: (?:bis|ter|quater))?,? (?:{_STREET_FR})\.? (?:de la |de l['’]|des |du |de |d['’])?{_WORD}(?: (?:(?:de la|du|des|de) )?{_WORD})?|,? (?:{_WORD} ){{1,3}}?(?:{_STREET_EN})\b)",
    re.I,
)
ADDRESS_LEFT = re.compile(
    rf"(?<![\w-])(?:(?:{_STREET_ES})\.? (?:(?:de las|de los|de la|del|de|da|do|della|del) )?{_WORD}(?: (?:(?:de|del|de la) )?{_WORD})?,? ?(?:n[º°.]\.? ?|núm\.? |no\. )?|(?:(?:alte|neue|kleine|große|lange|obere|untere|hintere)[rns]? {_LETTER}*|{_LETTER}{{3,}}(?:-{_LETTER}+)*)(?:{_STREET_DE}) |(?:am|an der|an den|im|in der|zum|zur|auf dem|auf der|unter den|hinter dem) {_LETTER}{{4,}} )(?P<number>\d{{1,4}}(?: ?[a-h](?![\w'’]))?)(?![\w]|:\d)",
    re.I,
)
NAME = re.compile(rf"(?<![\w@#'’-])(?P<given>{_LETTER}{{2,}}(?:-{_LETTER}{{2,}})?) (?P<middle>(?:{_LETTER}\.? )*)(?P<family>(?:(?:(?i:van der|van|von|de la|de|di|da|del|le|al|bin|mc)|[oO]['’]) ?)?{_LETTER}{{3,}}(?:['’-]{_LETTER}{{2,}})*)(?![\w@])")
NAME_CUE = re.compile(r"(?:name is|me llamo|ich heiße|je m['’]appelle|mi nombre es|signed,?|greetings from|(?:mr|mrs|ms|dr|prof|frau|herr)\.?|teacher|neighbour) $", re.I)
_CAPITAL = r"[^\W\d_a-zà-öø-ÿß-]"
TITLED = re.compile(rf"(?<![\w@#'’-]){_CAPITAL}[^\W\d_]+(?:-[^\W\d_]+)? (?:{_LETTER}\.? )*(?:{_LETTER}+ |[oO]['’]|Mc)?{_CAPITAL}")
_DATE = re.compile(r"(?:19|20)\d\d[-./ ]\d{1,2}[-./ ]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./](?:19|20)?\d\d")
_YEARS = re.compile(r"(?:19|20)\d\d ?[-–/] ?(?:19|20)\d\d")
_BUILD = re.compile(r"\d{1,3}\.\d{1,3}\.\d{4}\.\d{1,4}")
_THOUSANDS = re.compile(r"\d{1,3}(?: \d{3}){2,}")
_SSN = re.compile(r"\d{3}([- ])\d{2}\1\d{4}")
_LONG_ID = re.compile(r"\d{2} ?\d{3} ?\d{3} ?\d{3}")
_LETTERED = re.compile(r"\d{8}[- ]?[a-z]|[a-z]{1,2}\d{7}|[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d]", re.I)
_NANP = re.compile(r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}")
_PAIRS = re.compile(r"0\d(?:[ .]\d\d){4}")
_WORDS = re.compile(rf"{_LETTER}+")

_BLANKS = {c: " " for c in [9, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]}
_FOLD = {**{cp: chr(cp - 0xFEE0) for cp in range(0xFF01, 0xFF5F)}, **_BLANKS, **{ord(a): b for a, b in SAME_SHAPE.items()}, **{c: "-" for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2212)}}


def fold(text: str) -> tuple[str, list[int] | None]:
    """A plain form to match in, and where each of its characters stands in the
    text; None: at the same place."""
    if text.isascii():
        return text, None
    plain = text.translate(_FOLD)
    if plain.isascii() or unicodedata.is_normalized("NFC", plain) and not any(canonical_segment(c) == "" for c in set(plain) if c > "\x7f"):
        return plain, None
    out, at = [], []
    for k, ch in enumerate(plain):
        if unicodedata.combining(ch) and out and len(both := unicodedata.normalize("NFC", out[-1] + ch)) == 1:
            out[-1] = both
        elif ch.isascii() or canonical_segment(ch):
            out.append(ch)
            at.append(k)
    return "".join(out), [*at, len(text)]


@dataclass
class Span:
    """A proposed piece of personal information."""

    kind: str
    begin: int
    end: int
    votes: tuple[int, ...]
    features: list[int] = field(default_factory=list)


def _around(text: str, begin: int, end: int) -> tuple[list[str], list[str]]:
    before = text[max(0, begin - 40) : begin].lower().split()[-4:]
    after = text[end : end + 30].lower().split()[:2]
    return [w.strip("«»“”\"(),!?;:") for w in before], [w.strip("«»“”\"(),.!?;:") for w in after]


def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def _spans(text: str, figures: frozenset[str]) -> Iterator[tuple[str, int, int, tuple[int, ...]]]:
    """Kind, begin, end and votes of every proposed span of a folded text."""
    low = text.lower()
    if "@" in low or "at" in low and (" at " in low or "at)" in low or "at]" in low or "at}" in low):
        for m in _emails(text):
            before, after = _around(text, *m.span())
            local, domain = m.group()[: m.start("at") - m.start()], m.group()[m.end("at") - m.start() :]
            parts = re.split(r"[^\w-]+(?:dot|punkt|punto|point)?[^\w-]*", domain)
            tight = m["at"].strip(" ") == "@"
            yield (
                "email",
                *m.span(),
                (
                    _vote(bool(re.search(r"[a-z]{2,}$", domain, re.I)), not re.search(r"[a-z]", domain, re.I)),
                    _vote(tight or m["at"].strip()[0] in "([{", local.lower() in ("me", "up", "place", "look", "watching", "laugh") or not tight and "dot" not in domain.lower() and "." not in domain),
                    _vote(bool(set(before[-2:]) & _cues("email"))),
                    _vote(bool(re.search(r"[\d._+]", local)) or len(local) > 7),
                    _vote(len(parts) > 1 and all(len(p) > 1 for p in parts if p), any(p.isdigit() for p in parts if p)),
                ),
            )
    if re.search(r"\d[ ().\-/]{0,3}\d[ ().\-/]{0,3}\d[ ().\-/]{0,3}\d[ ().\-/]{0,3}\d", text):
        for m in NUMBER.finditer(text):
            value = m.group()
            digits = sum(c.isdigit() for c in value)
            if not 7 <= digits <= 15:
                continue
            begin, end = m.start(), m.end()
            if value[0] == "(" and ")" not in value:
                begin, value = begin + 1, value[1:]
            before, after = _around(text, begin, end)
            cue = set(before[-2:]) & _cues("phone") or set(before) & {"call", "number", "whatsapp", "handy", "appelle-moi", "número", "ruf", "phone", "reach"}
            identity = set(before[-4:]) & _ID_WORDS
            intl = value[0] == "+" or value.startswith("00")
            yield (
                "phone",
                begin,
                end,
                (
                    _vote(intl or bool(_NANP.fullmatch(value)) or bool(_PAIRS.fullmatch(value)) or bool(re.match(r"0\d{2,4}[ /-]?\d{5,}", value))),
                    _vote(bool(cue), bool(identity or set(before[-2:]) & _AGAINST_BEFORE)),
                    _vote(False, bool(_DATE.fullmatch(value) or _YEARS.fullmatch(value) or _BUILD.fullmatch(value))),
                    _vote(False, bool(set(after[:1]) & {"views", "was", "broke", "of", "percent", "likes", "this", "subscribers"})),
                    _vote(9 <= digits <= 13, digits < 8),
                    _vote(False, bool(_SSN.fullmatch(value) or (_THOUSANDS.fullmatch(value) and not intl))),
                    _vote(bool(set(after) & {"tonight", "please", "anyone", "bitte", "escríbeme", "pour"}) and not identity),
                ),
            )
        for m in IDENTITY.finditer(text):
            value = m.group()
            digits = sum(c.isdigit() for c in value)
            if not 6 <= digits <= 13:
                continue
            begin = m.start()
            head = re.match(r"[a-zA-Z]{1,2} ", value)
            if head and not re.fullmatch(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", value.upper()):
                begin, value = begin + head.end(), value[head.end() :]
            tail = re.search(r" [a-zA-Z]$", value)
            end = m.end()
            if tail and not re.fullmatch(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8} [A-Z]", value.upper()):
                end, value = end - 2, value[:-2]
            before, after = _around(text, begin, end)
            cue = set(before) & _ID_WORDS
            yield (
                "id",
                begin,
                end,
                (
                    _vote(bool(cue), bool(set(before[-2:]) & _AGAINST_BEFORE)),
                    _vote(bool(_SSN.fullmatch(value) or _LONG_ID.fullmatch(value) or _LETTERED.fullmatch(value) or re.fullmatch(r"\d{9}", value)), bool(_DATE.fullmatch(value) or _YEARS.fullmatch(value))),
                    _vote(False, bool(set(before[-2:]) & (_cues("phone") - {"an", "au", "still", "number"})) and not cue),
                    _vote(False, bool(set(after[:1]) & _AGAINST_AFTER) and not cue),
                    _vote(bool(_LETTERED.fullmatch(value)) or bool(_SSN.fullmatch(value)), value.startswith("0") and digits == 10 or bool(_NANP.fullmatch(value))),
                    _vote(8 <= digits <= 11 or any(c.isalpha() for c in value), digits < 7),
                ),
            )
    left: dict[int, re.Match] | None = None
    places: list[tuple[int, int]] = []
    for m in SMALL.finditer(text):
        if right := ADDRESS_RIGHT.match(text, m.start()):
            begin, end = right.start(), right.start() + len(_whole_name(right.group()))
            words = _WORDS.findall(text[begin:end].lower())
        else:
            if left is None:
                left = {h.start("number"): h for h in ADDRESS_LEFT.finditer(text)}
            if not (hit := left.get(m.start())):
                continue
            begin, end = hit.span()
            words = _WORDS.findall(hit.group().lower())
        before, after = _around(text, begin, end)
        number_first = bool(right)
        places.append((begin, end))
        yield (
            "address",
            begin,
            end,
            (
                _vote(bool(set(before[-3:]) & _cues("address")), bool(set(before[-1:]) & {"episode", "part", "folge", "season", "épisode", "episodio"})),
                _vote(any(w in _STREETS or w.endswith(_STREET_ENDS) for w in words), not any(len(w) > 3 for w in words)),
                _vote(False, bool(set(words) & _ORDINARY)),
                _vote(bool(re.search(r"[A-ZÀ-Þ]", text[begin:end])) or number_first and text.islower()),
                _vote(bool(set(after) & {"please", "samedi", "gracias", "wie", "this", "and"})),
            ),
        )
    words = {w for w in _WORDS.findall(low)}
    told = not words.isdisjoint(GIVEN) or not words.isdisjoint(_NAME_WORDS)
    for m in _names(text) if told else _titled(text):
        given, family = m["given"].lower(), m["family"].lower()
        before, after = _around(text, *m.span())
        known = all(g in GIVEN for g in given.split("-"))
        cue = bool(NAME_CUE.search(text, max(0, m.start() - 24), m.start()))
        g, f = m["given"], m["family"]
        alike = g[:1].isupper() and f[:1].isupper() and (g.isupper() == f.isupper() or len(f) < 4)
        own = {given, *family.split()}
        against = given == family or not own.isdisjoint(_ORDINARY) or before[-1:] != [] and before[-1] in _ARTICLES, not own.isdisjoint(figures), not own.isdisjoint(_STREETS) or f.lower().endswith(_STREET_ENDS) or after[:1] != [] and after[0] in _STREETS
        if not known and (against[1] or not cue and (any(against) or any(m.start() < e and b < m.end() for b, e in places))):
            continue  # capitals alone don't make a figure, a street or the start of a sentence a name
        last = text[: m.start()].rstrip()[-1:]
        yield (
            "name",
            *m.span(),
            (
                _vote(known, not known and not alike),
                _vote(bool(FAMILY_ENDING.search(family)) and len(family) > 5, family in _ORDINARY or len(family) < 4),
                _vote(cue or bool(set(before[-1:]) & _cues("name"))),
                _vote(bool(set(after[:1]) & NAME_AFTER)),
                _vote(alike, g[:1].isupper() != f[:1].isupper()),
                *(_vote(False, no) for no in against),
                _vote(last.isalpha() and before[-1:] != [] and before[-1] not in _ORDINARY_OPENERS or last == ","),
            ),
        )


def _emails(text: str) -> Iterator[re.Match]:
    """Matches of EMAIL; "write me at" before an address isn't part of it."""
    at = 0
    while m := EMAIL.search(text, at):
        if m["at"] == " at " and _AT_NEXT.match(text, m.end()):
            at = m.end("at")
        else:
            yield m
            at = m.end()


_FRENCH_END = re.compile(rf"(?<=[^\W_]) (?P<last>{_LETTER}+)$")


def _whole_name(address: str) -> str:
    """An address without a word of the sentence after its street's name."""
    low = address.lower()
    kind = re.search(rf"\b(?:{_STREET_FR})\b", low)
    last = _FRENCH_END.search(address)
    if not kind or not last or last.start() <= kind.end() + 1:
        return address
    name = address[kind.end() : last.start()].strip()
    if not name or name.lower() in ("de", "du", "des", "de la", "la"):
        return address
    word = last["last"]
    styled = any(c.isupper() for c in name)
    if (styled and word[0].islower()) or word.lower() in _ORDINARY or word.lower() in _AFTER_ADDRESS:
        return address[: last.start()]
    return address


def _names(text: str) -> Iterator[re.Match]:
    """Pairs of neighbouring words with a known given name, after words that
    announce a name, or with capitals; the latter may overlap others."""
    at = 0
    while m := NAME.search(text, at):
        given = m["given"].lower()
        if given.split("-")[0] in GIVEN or given not in _ORDINARY and NAME_CUE.search(text, max(0, m.start() - 24), m.start()):
            yield m
            at = m.end()
        else:
            if _is_titled(m):
                yield m
            at = m.end("given")


def _titled(text: str) -> Iterator[re.Match]:
    """Pairs of neighbouring words with capitals, overlapping ones too."""
    at = 0
    while found := TITLED.search(text, at):
        if (m := NAME.match(text, found.start())) and _is_titled(m):
            yield m
        at = found.start() + 1


def _is_titled(m: re.Match) -> bool:
    """Whether given and family name have a capital at their start and small letters."""
    family = m["family"].split()[-1]
    return m["given"].lower() not in _PARTICLES and m["given"][0].isupper() and m["given"][1:].islower() and family[0].isupper() and not family.isupper()


def figure_words(titles: DataFrame, column: str = "title") -> frozenset[str]:
    """Words with a capital in titles: names of figures, which are no persons.

    For titles of a catalogue of bounded size; refused beyond MOST_FIGURES words.
    """
    words = titles.select(F.explode(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"(\p{Lu}[\p{L}'’-]+)"), F.lit(1))).alias("w")).select(F.lower("w").alias("w")).distinct().limit(MOST_FIGURES + 1).collect()
    if len(words) > MOST_FIGURES:
        raise ValueError(f"more than {MOST_FIGURES} words with a capital in titles")
    return frozenset(r.w for r in words)


def _cues(kind: str) -> frozenset[str]:
    return _CUE_SETS[kind]


_CUE_SETS = {k: frozenset(v.split()) for k, v in CUES.items()}
_ID_WORDS = frozenset("ssn social dni steuer-id ausweisnummer passport passeport reisepass pasaporte ni insurance identity tax nif nie".split())
_NAME_WORDS = frozenset("name llamo heiße appelle nombre signed greetings dr prof frau herr mrs teacher neighbour".split())
_STREETS = frozenset(f"{_STREET_EN}|{_STREET_FR}|{_STREET_ES}".replace("/", "").split("|")) - {"c", "via"} | {"am", "im"}
_STREET_ENDS = ("straße", "strasse", "str", "gasse", "weg", "allee", "platz", "ufer", "damm", "grund", "chaussee")
# Frequent words that are no part of a person's or a street's name.
_ORDINARY = frozenset("hey hello hi dear thanks thank please only also even then just maybe honestly great good my our your no yes if there here seit meine mein kann bitte für ich warum wer wie nicht eine ein auch noch sehr merci pour une dans avec gracias muy pero the is was and are for that this with you not but have had has were been its it's his her she he they them who what when why how all any can did does est les des une und der die das ist war mit von auf que los las por con para del minutes minute seconds episode episodes season part pacing ending animation views year years time times weeks did one best more".split())


_PARTICLES = frozenset("van von der de la di da del le al bin mc".split())
_ARTICLES = frozenset("the a an this that these those der die das dem den le la les el los las il lo".split())
_ORDINARY_OPENERS = frozenset("thanks thank hey hello hi dear".split())


def propose(text: str | None, figures: frozenset[str] = frozenset()) -> list[Span]:
    """Proposed spans of a text, in places of the text itself. figures: words of
    names that aren't persons', in lower case."""
    if not text:
        return []
    plain, at = fold(text)
    out = []
    for kind, begin, end, votes in _spans(plain, figures):
        before, after = _around(plain, begin, end)
        value = plain[begin:end]
        shape = re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"\d", "9", value)))
        named = [f"v{i}{v}" for i, v in enumerate(votes) if v] + [f"b{i}{w}" for i, w in enumerate(reversed(before[-2:]))] + [f"a{i}{w}" for i, w in enumerate(after)] + [f"s{shape}" if len(shape) < 24 else "s", f"n{min(len(value), 30) // 3}", "bias"]
        features = [zlib.crc32(f"{kind}|{x}".encode()) % SLOTS for x in named]
        out.append(Span(kind, begin, end, votes, features))
    if at:
        for s in out:
            s.begin, s.end = at[s.begin], at[s.end - 1] + 1
    return out


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 60, partial: tuple[int, ...] = ()) -> dict[tuple[int, ...], float]:
    """Probability of each vote pattern to be a case, by EM over pattern counts.

    A two-class naive Bayes model; it starts from the majority of votes. partial:
    labelers that can only know some of the cases, as a list of names does: if they
    say nothing, that is no evidence. Where there are such, each labeler is taken
    to be better than chance, so a vote never counts for its opposite.
    """
    patterns = sorted(counts)
    votes = np.array(patterns)
    n = np.array([counts[p] for p in patterns], dtype=float)
    p = 1 / (1 + np.exp(-1.5 * (votes.sum(axis=1) - 0.5)))
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 0.01, 0.99)
        score = np.full(len(p), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            for v in (-1, 1) if j in partial else (-1, 0, 1):
                here = votes[:, j] == v
                yes = ((n * p)[here].sum() + 0.5) / ((n * p).sum() + 1.5)
                no = ((n * (1 - p))[here].sum() + 0.5) / ((n * (1 - p)).sum() + 1.5)
                low, high = (min(4 * v, 0), max(4 * v, 0)) if partial and v else (-4, 4)
                score[here] += np.clip(np.log(yes / no), low, high)
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return dict(zip(patterns, p.tolist(), strict=True))


def fit_spans(features: list[list[int]], truth: np.ndarray, steps: int = 300, decay: float = 1e-5) -> np.ndarray:
    """Weights of a logistic model of probabilities ``truth``, by Adam."""
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    used, column = np.unique(np.concatenate([np.array(f, dtype=np.int64) for f in features]), return_inverse=True)
    w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[column], minlength=len(truth))
        gap = (1 / (1 + np.exp(-z)) - truth) / len(truth)
        grad = np.bincount(column, weights=gap[row], minlength=len(used)) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(SLOTS)
    out[used] = w
    return out


@dataclass
class SpanModel:
    """What decides on spans: weights, words that are common in pairs of words
    with capitals, and words of figures' names. Of bounded size."""

    weights: np.ndarray
    common: frozenset[str] = frozenset()
    figures: frozenset[str] = frozenset()

    def decide(self, spans: list[Span], text: str | None = None) -> list[Span]:
        """The spans that are cases; of overlapping ones the likeliest, then longest.

        text: given if features of common words aren't in the spans yet.
        """
        scored = []
        for s in spans:
            z = float(self.weights[s.features].sum())
            if text is not None and s.kind == "name" and not self.common.isdisjoint(text[s.begin : s.end].lower().split(" ")):
                z += float(self.weights[COMMON])
            scored.append((z, s))
        kept: list[Span] = []
        for z, s in sorted(scored, key=lambda p: (-p[0], p[1].begin - p[1].end, p[1].begin)):
            if z > 0 and all(s.end <= k.begin or k.end <= s.begin for k in kept):
                kept.append(s)
        return sorted(kept, key=lambda s: s.begin)


#: Feature of names that have a common word.
COMMON = zlib.crc32(b"name|common") % SLOTS
_SPAN = [
    T.StructField("kind", T.StringType()),
    T.StructField("begin", T.IntegerType()),
    T.StructField("finish", T.IntegerType()),
    T.StructField("value", T.StringType()),
    T.StructField("votes", T.StringType()),
    T.StructField("features", T.ArrayType(T.IntegerType())),
]
_CELLS = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32())]


def spans_table(comments: DataFrame, figures: frozenset[str] = frozenset()) -> DataFrame:
    """All proposed spans of ``cid, text``, written to the shared folder. ``text_key``
    tells different texts of a cid apart."""
    slim = comments.select("cid", F.xxhash64("text").alias("text_key"), "text").where("text <> ''")
    schema = T.StructType([*slim.drop("text").schema.fields, *_SPAN])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for s in propose(text, figures):
                    rows.append(k)
                    found.append((s.kind, s.begin, s.end, text[s.begin : s.end], "".join("-0+"[v + 1] for v in s.votes), s.features))
            if rows:
                cells = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), _CELLS, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(2)), *cells], names=names)

    return stage_table(slim.mapInArrow(run, schema), "p5-spans")


def common_words(spans: DataFrame) -> frozenset[str]:
    """Words in at least one of 500 pairs that only capitals made a name, and in
    five: such words are no names. A pair has few words, so these are few too."""
    pairs = spans.where("kind = 'name' and votes like '0%'")
    words = pairs.select(F.explode(F.array_distinct(F.split(F.lower("value"), " "))).alias("w")).groupBy("w").count()
    return frozenset(r.w for r in words.where(F.col("count") >= max(5, pairs.count() / 500)).collect())


def with_common(spans: DataFrame, common: frozenset[str]) -> DataFrame:
    """Spans with the vote, and feature, of common words in names."""
    has = F.exists(F.split(F.lower("value"), " "), lambda w: w.isin(*sorted(common))) if common else F.lit(False)
    hit = (F.col("kind") == "name") & has
    votes = F.when(F.col("kind") == "name", F.concat("votes", F.when(hit, "-").otherwise("0"))).otherwise(F.col("votes"))
    return spans.withColumns({"votes": votes, "features": F.when(hit, F.concat("features", F.array(F.lit(COMMON)))).otherwise(F.col("features"))})


def draw_below(spans: int) -> int:
    """What a hash of 63 bits has to stay below for a span of a kind to be drawn,
    if there are so many of them."""
    share = 0.9 * MOST_SPANS / len(KINDS)
    return 2**63 - 1 if spans <= share else max(1, int(2**63 * (share / spans)))


def fit(spans: DataFrame, figures: frozenset[str] = frozenset()) -> SpanModel:
    """The model of all vote patterns and a bounded sample of spans, drawn from
    each kind alike.

    A kind has no more than three to the power of its labelers patterns, so their
    counts are few whatever the corpus.
    """
    common = common_words(spans)
    spans = with_common(spans, common)
    counts: dict[str, dict[tuple[int, ...], int]] = {}
    for kind, votes, n in spans.groupBy("kind", "votes").count().collect():
        counts.setdefault(kind, {})[tuple("-0+".index(v) - 1 for v in votes)] = n
    if not counts:
        return SpanModel(np.zeros(SLOTS), common, figures)
    belief = {kind: reliabilities(c, partial=PARTIAL if kind == "name" else ()) for kind, c in counts.items()}
    below = F.create_map(*[F.lit(x) for kind, c in counts.items() for x in (kind, draw_below(sum(c.values())))])
    drawn = F.shiftrightunsigned(F.xxhash64("cid", "kind", "begin", "value"), 1) < below[F.col("kind")]
    sample = spans.where(drawn).select("kind", "votes", "features").limit(MOST_SPANS).collect()
    if not sample:
        raise ValueError("no span was drawn to fit the classifier on")
    truth = np.array([belief[r.kind][tuple("-0+".index(v) - 1 for v in r.votes)] for r in sample])
    return SpanModel(fit_spans([r.features for r in sample], truth), common, figures)


def found(comments: DataFrame, figures: frozenset[str] = frozenset()) -> DataFrame:
    """``cid, kind, value``: each distinct value of a kind in a cid's text.

    Null and empty texts have none; repeated rows of a cid give one row, different
    texts of a cid are decided on apart; rows without a cid are left out; other
    columns aren't read. figures: words of names that aren't persons'.
    """
    spans = spans_table(comments.where("cid is not null"), figures)
    model = fit(spans, figures)
    sent = comments.sparkSession.sparkContext.broadcast(model)
    schema = "cid string, kind string, value string"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                spans = [Span(s["kind"], s["begin"], s["finish"], (), list(s["features"])) for s in row.spans]
                value = {(s["kind"], s["begin"], s["finish"]): s["value"] for s in row.spans}
                out += [(row.cid, s.kind, value[(s.kind, s.begin, s.end)]) for s in sent.value.decide(spans)]
            yield pd.DataFrame(out, columns=["cid", "kind", "value"])

    span = F.struct("kind", "begin", "finish", "value", "features").alias("span")
    by = with_common(spans, model.common).select("cid", "text_key", span).groupBy("cid", "text_key").agg(F.collect_set("span").alias("spans"))
    return by.mapInPandas(each, schema).distinct()


def redact(comments: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """``comments`` with ``<text>_redacted``: each case replaced by ``[KIND]``.

    All else stays as it is; null stays null. A column that has the new name
    already is replaced. Spans are proposed anew here: joining those the model was
    fitted on would shuffle all texts.
    """
    sent = comments.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def placeholders(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            for s in reversed(sent.value.decide(propose(text, sent.value.figures), text)):
                text = f"{text[: s.begin]}[{s.kind.upper()}]{text[s.end :]}"
            return text

        return texts.map(one, na_action="ignore")

    return comments.withColumn(f"{text_col}_redacted", placeholders(F.col(text_col)))
