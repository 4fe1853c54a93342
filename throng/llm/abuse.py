"""Scoring comments for abusive, hateful and sexual content.

Every token is looked up in a lexicon trie by a Levenshtein automaton, which also
finds misspelled and disguised terms; a hit stands for its category from then on.
Hits, and words and emojis that labelled cases have and harmless examples lack,
anchor context windows. A linear model, trained on the labelled examples, tells
"you are a complete <term>" from "the word <term>" or "<term> race" by the n-grams
inside these windows and by what a window says of its hit in any phrase: whether
somebody is addressed, the writer speaks of themselves, or the hit is quoted or
reported. What stands in quotation marks inside a text isn't the writer's own: its
n-grams don't count. Text outside every window has no say, so a long harmless text
around an insult doesn't dilute it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from throng.llm.canon import canonical

CATEGORIES = ("abusive", "hateful", "sexual")
#: Tokens that a context window has on either side of its anchor.
REACH = 8
#: At most so many labelled rows are fitted, the first by ``label_id``.
MOST_LABELS = 20_000
#: At most so many terms of a lexicon; more are refused.
MOST_TERMS = 200_000
#: How many raw tokens a worker remembers before it starts anew.
REMEMBERED = 500_000
# Signs that stand for letters in disguised words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "|": "l", "!": "i", "8": "b", "9": "g"})
# Words that address somebody, that speak of the writer, and that report
# what was said.
ADDRESSING = frozenset("you your yours you're youre you've u ur ya yall yourself yourselves du dich dir dein deine bist ihr euch tu te toi t'es vous ton eres tú ti usted ustedes ты тебя тебе вы вас".split())
SELF = frozenset("i i'm im me my myself ich bin mich je suis moi soy yo я меня".split())
REPORTING = frozenset("call calls called calling say says said saying wrote writes write written word words term comment comments quote quoted quoting reported means nannte gesagt sagte wort dit appelle mot dijo llamó palabra слово сказал".split())
# Phrases that wish somebody's death, beside any lexicon.
DEATH_WISHES = ("kill yourself", "hang yourself", "drop dead", "kys")
_OPEN, _CLOSE = "\"“„«‚‘", "\"”“»’"
#: What a raw token is besides a symbol.
_YOU, _ME, _TOLD, _ENDS, _OPENS, _CLOSES, _WEAK = 1, 2, 4, 8, 16, 32, 64
_EDGE = ".,!?…:;\"'()[]«»“”„‚‘’¿¡-–—*、。！？"
_SPACED = re.compile(r"(?<!\S)(?:[^\W_] ){2,}[^\W_](?!\S)")
_PARTED = re.compile(r"[^\W_](?:[-_.*·][^\W_]){2,}")
_RUN = re.compile(r"(.)\1{2,}")
_LETTERS = re.compile(r"[^\W\d_]")


def _letters(word: str) -> int:
    """A bit for each letter, as far as 61 bits tell them apart."""
    bits = 0
    for ch in set(word):
        bits |= 1 << ord(ch) % 61
    return bits


class Trie:
    """Lexicon terms without blanks; ``find`` walks it with an automaton."""

    def __init__(self, terms: dict[str, str]) -> None:
        self.root: dict = {}
        self.letters = sorted({(len(t), _letters(t)) for t in terms})
        for term, kind in sorted(terms.items()):
            node = self.root
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = (term, kind)

    def find(self, word: str, most: int) -> tuple[int, str, str] | None:
        """The nearest term within ``most`` edits: (edits, term, category).

        An edit alters at most two of the letters that a word has at all, so words
        whose letters differ more from every term's aren't walked.
        """
        own, size = _letters(word), len(word)
        if not any(abs(n - size) <= most and (own ^ bits).bit_count() <= 2 * most for n, bits in self.letters):
            return None
        best = None
        stack = [(self.root, tuple((i, i) for i in range(most + 1)))]
        n = len(word)
        while stack:
            node, states = stack.pop()
            for ch, child in node.items():
                if not ch:
                    ends = [e + n - i for i, e in states if n - i <= most - e]
                    if ends and (best is None or (min(ends), *child) < best):
                        best = (min(ends), *child)
                elif after := _step(word, n, states, ch, most):
                    stack.append((child, after))
        return best


def _step(word: str, n: int, states: tuple[tuple[int, int], ...], ch: str, most: int) -> tuple[tuple[int, int], ...]:
    """One transition of the Levenshtein automaton of ``word``; states are
    (characters of the word used, edits), none of which another makes needless."""
    least: dict[int, int] = {}
    for i, e in states:
        for j in range(i, min(n, i + most - e) + 1):  # skip j - i characters, then read ch
            cost = e + j - i
            if j < n and word[j] == ch and cost < least.get(j + 1, most + 1):
                least[j + 1] = cost
            if cost < most:
                if j < n and cost + 1 < least.get(j + 1, most + 1):
                    least[j + 1] = cost + 1
                if cost + 1 < least.get(j, most + 1):
                    least[j] = cost + 1
    return tuple(sorted(least.items()))


def edits_allowed(length: int, odd: bool) -> int:
    """Edits that a word of this length may have and still be the term; two only
    in long words that are disguised anyway, as names come near terms too."""
    return 0 if length + odd < 4 else 2 if odd and length > 6 else 1


class Lexicon:
    """Terms and the words that are known to be ordinary."""

    def __init__(self, terms: dict[str, str], ordinary: frozenset[str]) -> None:
        split = {tuple(canonical(t).lower().split()): c for t, c in terms.items()}
        self.terms = {"".join(words): c for words, c in split.items()}
        #: terms of several words, joined, with how many they have
        self.phrases = {"".join(words): words for words in split if len(words) > 1}
        self.longest = max((len(w) for w in self.phrases.values()), default=0)
        self.whole = Trie(dict.fromkeys(self.phrases, ""))
        self.parts = Trie({x: "" for words in self.phrases.values() for x in words})
        self.ordinary = ordinary - self.terms.keys()
        self.trie = Trie(self.terms)

    def is_part(self, word: str) -> bool:
        """Whether a word is, or is near, one of a term of several words."""
        return bool(self.phrases) and self.parts.find(word, edits_allowed(len(word), False)) is not None

    def phrase(self, words: list[str]) -> str | None:
        """The term that neighbouring words make together, each misspelled as it may be."""
        joined = "".join(words)
        if joined not in self.phrases:
            hit = self.whole.find(joined, sum(edits_allowed(len(w), False) for w in words))
            joined = hit[1] if hit else ""
        return joined if len(self.phrases.get(joined, ())) == len(words) else None

    def match(self, raw: str) -> tuple[str, str] | None:
        """(term, category) of a token, disguised or misspelled as it may be."""
        word = raw.removesuffix("'s").removesuffix("’s").replace("'", "")
        odd = False
        if _PARTED.fullmatch(word):
            word, odd = re.sub(r"[-_.*·]", "", word), True
        if not _LETTERS.search(word) and not any(c in "$@|" for c in word):
            return None
        forms = [word]
        if any(not c.isalpha() for c in word):
            forms += [word.translate(LEET), word.replace("1", "l").translate(LEET)]
            odd = True
        if _RUN.search(word):
            forms += [_RUN.sub(r"\1", f) for f in forms] + [_RUN.sub(r"\1\1", f) for f in forms]
            odd = True
        for form in forms:
            if form in self.terms:
                return form, self.terms[form]
        if not odd and word in self.ordinary:
            return None
        best = None
        for form in forms if len(forms) < 2 else forms[1:]:
            if (most := edits_allowed(len(form), odd)) and (hit := self.trie.find(form, most)) and hit[0] <= edits_allowed(len(hit[1]), odd) and (best is None or hit < best):
                best = hit
        return best and best[1:]


def raw_tokens(text: str | None, emojis: str | None, known: Container[str] = ()) -> list[str]:
    """Words by blanks, spaced-out words joined, then each kind of emoji once.

    A word of one letter before a spaced-out word of ``known`` stays by itself.
    """

    def join(found: re.Match) -> str:
        word = found.group().replace(" ", "")
        whole = canonical(word).lower()
        return f"{word[0]} {word[1:]}" if whole not in known and whole[1:] in known else word

    text = text or ""
    if len(text) > 4 and _SPACED.search(text):
        text = _SPACED.sub(join, text)
    words = text.split() or ["<empty>"]
    if emojis:
        words.append("<e>")
        words.extend(dict.fromkeys(emojis.replace("️", "")))
    return words


class Model:
    """Lexicon, vocabulary and n-gram weights; small and of bounded size."""

    def __init__(self, lexicon: Lexicon, vocabulary: dict[str, int], weak: frozenset[str] = frozenset()) -> None:
        self.lexicon, self.vocabulary, self.weak = lexicon, vocabulary, weak
        self.anchors = np.zeros(2, dtype=bool)
        self.keys = np.zeros(1, dtype=np.int64)
        self.weights = np.zeros((1, len(CATEGORIES)))
        self.bias = np.zeros(len(CATEGORIES))
        self.alike: dict[str, str] = {}
        self.plain = Lexicon({}, frozenset())
        self.seen: dict[str, int] = {}
        self.roles: dict[str, int] = {}
        self.part: dict[str, str] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}, "roles": {}, "part": {}}

    def tokens(self, text: str | None, emojis: str | None) -> list[str]:
        """Raw tokens, with the lexicon at hand for spaced-out words and for terms
        of several words, which become one token."""
        words = raw_tokens(text, emojis, self.lexicon.terms)
        if not self.lexicon.phrases:
            return words
        bare = [self._part(w) for w in words]
        out, i = [], 0
        while i < len(words):
            size = 1
            if bare[i]:
                for k in range(min(self.lexicon.longest, len(words) - i), 1, -1):
                    if all(bare[i : i + k]) and (term := self.lexicon.phrase(bare[i : i + k])):
                        first, last = words[i], words[i + k - 1]
                        words[i] = (first[0] if first[0] in _OPEN else "") + term + (last[-1] if last[-1] in _EDGE else "")
                        size = k
                        break
            out.append(words[i])
            i += size
        return out

    def _part(self, raw: str) -> str:
        """The bare word if it may be a part of a term of several words, else ''."""
        part = self.part.get(raw)
        if part is None:
            if len(self.part) > REMEMBERED:
                self.part.clear()
            bare = canonical(raw).strip(_EDGE).lower()
            part = self.part[raw] = bare if bare and self.lexicon.is_part(bare) else ""
        return part

    def symbol(self, raw: str) -> str:
        """What a raw token counts as."""
        if raw[0] == "<" and raw in ("<empty>", "<e>"):
            return raw
        bare = canonical(raw).strip(_EDGE)
        if not bare:
            return "<mark>"
        if bare[0] == "@" and bare[1:].replace("_", "").isalpha():
            return "<name>"
        low = bare.lower()
        if low == "an":
            low = "a"
        hit = self.lexicon.match(low)
        if hit:
            return f"<{hit[1]}>"
        if low not in self.vocabulary and len(low) > 2 and _LETTERS.search(low) and (plain := low.translate(LEET)) in self.vocabulary:
            low = plain
        if low in self.vocabulary or low in self.alike:
            return self.alike.get(low, low)
        if bare[0] != "@" and (not low.isalpha() or _RUN.search(low)) and _LETTERS.search(low) and (word := self.plain.match(low)):
            return self.alike.get(word[0], word[0])
        if bare[0].isdigit():
            return "<number>"
        return "<name>" if bare[0].isupper() or bare[0] == "@" else "<word>"

    def ids(self, raw: list[str]) -> np.ndarray:
        """Vocabulary numbers of raw tokens; 0 is the start of a text."""
        seen = self.seen
        out = []
        for token in raw:
            k = seen.get(token)
            if k is None:
                if len(seen) > REMEMBERED:
                    seen.clear()
                k = seen[token] = self.vocabulary.get(self.symbol(token), 1)
            out.append(k)
        return np.array(out, dtype=np.int64)

    def role(self, raw: str) -> int:
        """Bits that tell whom a token addresses, what it reports, what it opens and ends."""
        role = self.roles.get(raw)
        if role is None:
            if len(self.roles) > REMEMBERED:
                self.roles.clear()
            bare = canonical(raw).strip(_EDGE).lower()
            words = self.lexicon.phrases.get(bare, (bare, bare.translate(LEET)) if len(bare) > 1 else (bare,))
            tail = raw.rstrip(".,!?…:;")
            role = _YOU * (bare[:1] == "@" or any(w in ADDRESSING for w in words)) | _ME * (bare in SELF) | _TOLD * (bare in REPORTING)
            role |= _ENDS * (raw[-1] in ".!?…" and len(raw) > 1) | _OPENS * (raw[0] in _OPEN) | _CLOSES * (len(tail) > 0 and tail[-1] in _CLOSE)
            if self.weak and (hit := self.lexicon.match(bare)) and hit[0] in self.weak:
                role |= _WEAK
            self.roles[raw] = role
        return role

    def quoted(self, roles: list[int]) -> list[bool]:
        """Which tokens stand in quotation marks that aren't around the whole text."""
        out, begin = [False] * len(roles), None
        for i, r in enumerate(roles):
            if begin is None and r & _OPENS:
                begin = i
            if begin is not None and r & _CLOSES and (i > begin or r & _OPENS):
                out[begin : i + 1] = [True] * (i + 1 - begin)
                begin = None
        return [False] * len(roles) if all(out) else out

    def bearings(self, raw: list[str], ids: list[int], first_hit: int) -> set[int]:
        """What the windows say of their hits, as negative keys: for each category
        that there is a hit, and whether one is addressed to somebody, speaks of the
        writer, or is quoted or reported."""
        hits = [i for i, k in enumerate(ids) if first_hit <= k < first_hit + len(CATEGORIES)]
        if not hits:
            return set()
        roles = [self.role(x) for x in raw]
        quoted = self.quoted(roles)
        out: set[int] = set()
        for h in hits:
            low = high = h
            while low > 0 and h - low < REACH and not roles[low - 1] & _ENDS:
                low -= 1
            while high + 1 < len(raw) and high - h < REACH and not roles[high] & _ENDS and raw[high + 1] != "<e>":
                high += 1
            around = [roles[i] for i in range(low, high + 1) if quoted[i] <= quoted[h] and not (quoted[h] and quoted[i])]
            you = any(r & _YOU for r in around)
            told = quoted[h] or any(roles[i] & _TOLD for i in range(low, high + 1) if not quoted[i])
            me = not you and any(roles[i] & _ME for i in range(low, h) if not quoted[i])
            if roles[h] & _WEAK and not you:
                continue  # an ordinary word as often as an insult: only known phrases tell
            base = -1 - 4 * (ids[h] - first_hit)
            out |= {base} | ({base - 1} if you else set()) | ({base - 2} if told else set()) | ({base - 3} if me else set())
        return out

    def flat(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens, two starts before each text, and lengths."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        ids = self.ids([t for ts in texts for t in ts])
        out = np.zeros(len(ids) + 2 * len(texts), dtype=np.int64)
        at = np.arange(len(ids)) + 2 * (np.repeat(np.arange(len(texts)), lengths) + 1)
        out[at] = ids
        return out, lengths + 2

    def gathered(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Text number and key of every one- to three-gram that ends in a window, and
        of what the windows say of their hits."""
        flat, lengths = self.flat(texts)
        size = len(self.vocabulary) + 2
        ends = np.cumsum(lengths)
        doc = np.repeat(np.arange(len(texts)), lengths)
        hits = np.concatenate([[0], np.cumsum(self.anchors[flat])])
        at = np.arange(len(flat))
        low, high = np.maximum(at - REACH, (ends - lengths)[doc]), np.minimum(at + REACH + 1, ends[doc])
        near = (hits[high] > hits[low]) & (at >= (ends - lengths)[doc] + 2)
        bearing_doc, bearing_key = [], []
        first_hit = self.vocabulary.get(f"<{CATEGORIES[0]}>", len(self.vocabulary) + 2)
        for d in np.unique(doc[near & self.anchors[flat]]).tolist():
            begin = int(ends[d] - lengths[d]) + 2
            said = self.bearings(texts[d], flat[begin : ends[d]].tolist(), first_hit)
            bearing_doc += [d] * len(said)
            bearing_key += sorted(said)
            if any('"' in x or x[0] in _OPEN for x in texts[d]):
                near[begin : ends[d]] &= ~np.array(self.quoted([self.role(x) for x in texts[d]]))
        near = np.flatnonzero(near)
        one, before, first = flat[near], flat[near - 1], flat[near - 2]
        two = before * size + one + size
        three = first * size * size + two + size * size
        bearing = np.array(bearing_doc, dtype=np.int64), np.array(bearing_key, dtype=np.int64)
        return np.concatenate([np.tile(doc[near], 3), bearing[0]]), np.concatenate([one, two, three, bearing[1]])

    def score(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Margin over a harmless text, and number of the category, for each."""
        doc, keys = self.gathered(texts)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        doc, at = doc[hit], at[hit]
        total = np.stack([np.bincount(doc, weights=w[at], minlength=len(texts)) for w in self.weights.T], axis=1) + self.bias
        return total.max(axis=1), total.argmax(axis=1)


def _learned_terms(rows: list[tuple[list[str], str]], terms: dict[str, str]) -> dict[str, str]:
    """Words that fill the places of listed terms in labelled cases.

    A place is the pair of neighbours of a word. A word joins the lexicon if most
    of its places enclose listed terms of one category in other cases of it, at
    least two terms or at two places. Disguised forms of terms don't join.
    """
    known = {canonical(t).lower(): c for t, c in terms.items()}
    trie = Trie(known)
    places: dict[tuple, set[str]] = {}
    fill: dict[str, Counter] = {}
    for words, category in rows:
        w = ["<s>", *(canonical(x).strip(_EDGE).lower() for x in words if x != "<e>"), "</s>"]
        for a, x, b in zip(w, w[1:], w[2:], strict=False):
            if category != "none" and known.get(x) == category:
                places.setdefault((category, a, b), set()).add(x)
            elif x.isalpha() and x not in known:
                fill.setdefault(x, Counter())[(category, a, b)] += 1
    out = {}
    for x, where in fill.items():
        good = Counter()
        for place, n in where.items():
            if place in places:
                good[place[0]] += n
        if not good or len(x) < 3 or _RUN.search(x) or trie.find(x, edits_allowed(len(x), True)):
            continue
        category, n = good.most_common(1)[0]
        terms_there = set().union(*(places[p] for p in where if p in places))
        spots = sum(p in places for p in where)
        cases = sum(k for p, k in where.items() if p[0] == category)
        if n >= 0.6 * cases >= 0.25 * sum(where.values()) and (len(terms_there) > 1 or spots > 1):
            out[x] = category
    return out


def _interchangeable(texts: list[list[str]], least: int = 3, part: float = 0.3) -> dict[str, str]:
    """Words that take one another's places, each with the one that stands for all.

    Two words are interchangeable if they share at least ``least`` places (pairs of
    neighbours) and that part of the places of the rarer one.
    """
    places: dict[str, set] = {}
    for words in texts:
        w = ["<s>", *words, "</s>"]
        for a, x, b in zip(w, w[1:], w[2:], strict=False):
            if x not in ("<e>", "<empty>", "<mark>", "<word>", "<number>") and (a, b) != ("<s>", "</s>") and a != "<e>":
                places.setdefault(x, set()).add((a, b))
    by: dict[tuple, list[str]] = {}
    for x, where in places.items():
        for p in where:
            by.setdefault(p, []).append(x)
    shared = Counter((x, y) for xs in by.values() for i, x in enumerate(sorted(xs)) for y in sorted(xs)[i + 1 :])
    parent = {x: x for x in places}

    def root(x: str) -> str:
        while parent[x] != x:
            x = parent[x]
        return x

    for (x, y), n in sorted(shared.items(), key=lambda p: (-p[1], p[0])):
        a, b = sorted((root(x), root(y)))  # '<name>' and terms come before words
        if a != b and n >= least and n >= part * min(len(places[x]), len(places[y])) and not (b[0] == "<") and a not in ("<abusive>", "<hateful>", "<sexual>"):
            parent[b] = a
    return {x: r for x in places if (r := root(x)) != x}


def _anchors(rows: list[tuple[set[str], str]], counts: Counter, cases: Counter, terms: list[str], special: list[str]) -> set[str]:
    """Symbols around which contexts are scored: hits of the lexicon, then, purest
    first, what explains labelled cases that have fewer than two anchors so far.
    What only goes along with something purer isn't one."""
    purity = {w: cases[w] / (counts[w] + 0.5) for w in counts if w not in special}
    chosen = set(terms)
    need = [(symbols, 2 - len(symbols & chosen)) for symbols, c in rows if c != "none"]
    for w in sorted((w for w, p in purity.items() if p >= 0.6), key=lambda w: (-purity[w], w)):
        lack = 1 if purity[w] >= 0.9 else 2
        if any(n >= lack and w in symbols for symbols, n in need):
            chosen.add(w)
            need = [(symbols, n - (w in symbols)) for symbols, n in need]
    return chosen


def train(labels: pd.DataFrame, terms: pd.DataFrame, copies: int = 3, steps: int = 500, decay: float = 3e-5, seed: int = 1) -> Model:
    """Fit the model on ``text, emojis, category`` with ``term, category`` and, if
    there, the ``strength`` of a term, of which 1 is an ordinary word as well.

    Every example is fitted alone and in ``copies`` with the end and the start of
    random harmless examples around it, as comments join several remarks.
    """
    rows = [(raw_tokens(t, e), c if c in CATEGORIES else "none") for t, e, c in labels[["text", "emojis", "category"]].itertuples(index=False)]
    listed = dict.fromkeys(DEATH_WISHES, "abusive") | {t: c for t, c in terms[["term", "category"]].itertuples(index=False) if isinstance(t, str) and t.strip() and c in CATEGORIES}
    bare = [({canonical(x).strip(_EDGE).lower() for x in words} - {""}, c) for words, c in rows]
    usual = Counter(w for words, _ in bare for w in words)
    harmless = Counter(w for words, c in bare if c == "none" for w in words)
    pairs = Counter((a, b, c) for words, c in rows if c != "none" for a, b in zip(words, words[1:], strict=False) if a.isalpha() and b.isalpha() and not harmless[a.lower()] and not harmless[b.lower()])
    parted = {re.sub(r"[-_.*·]", "", canonical(x).strip(_EDGE)).lower() for words, _ in rows for x in words}
    joined = {w: c for (a, b, c), n in pairs.items() if n > 1 and (w := (a + b).lower()) in parted}
    lexicon = Lexicon(joined | _learned_terms(rows, listed) | listed, frozenset(w for w, n in usual.items() if n > 3))
    rows = [(raw_tokens(t, e, lexicon.terms), c) for (_, c), t, e in zip(rows, labels["text"], labels["emojis"], strict=True)]
    weak = frozenset(canonical(t).lower().replace(" ", "") for t in terms["term"][terms["strength"] == 1] if t in listed) if "strength" in terms else frozenset()
    model = Model(lexicon, {w: 0 for w, n in usual.items() if n > 1}, weak)
    model.alike = _interchangeable([[model.symbol(x) for x in words] for words, _ in rows])
    symbols = [({model.symbol(x) for x in words}, c) for words, c in rows]
    counts = Counter(w for words, _ in symbols for w in words)
    cases = Counter(w for words, c in symbols if c != "none" for w in words)
    terms_of = [f"<{c}>" for c in CATEGORIES]
    special = ["<empty>", "<e>", "<name>", "<mark>", "<number>", "<word>", *terms_of]
    words = [*special, *sorted(w for w, n in counts.items() if n > 1 and w not in special)]
    model.vocabulary = {w: k for k, w in enumerate(words, 2)}
    model.roles.clear()
    chosen = _anchors(symbols, counts, cases, terms_of, special)
    # other words of cases may be disguised too
    known = lexicon.terms.keys()
    model.plain = Lexicon({w: "word" for w, n in usual.items() if n > 2 and len(w) > 3 and w.isalpha() and not harmless[w] and w not in known}, frozenset())
    model.seen.clear()
    model.anchors = np.array([False, False, *(w in chosen for w in words)])
    rng = np.random.default_rng(seed)
    plain = [w for w, c in rows if c == "none" and "<e>" not in w and w != ["<empty>"]]
    texts, truth = [w for w, _ in rows], [CATEGORIES.index(c) + 1 if c != "none" else 0 for _, c in rows]
    for words, category in rows if plain else []:
        for _ in range(copies if words[0] != "<empty>" else 0):
            before, after = (plain[k] for k in rng.integers(0, len(plain), 2))
            cut = words.index("<e>") if "<e>" in words else len(words)
            texts.append(before[-REACH:] + words[:cut] + (after[:REACH] if rng.random() < 0.5 else []) + words[cut:])
            truth.append(CATEGORIES.index(category) + 1 if category != "none" else 0)
    doc, keys = model.gathered(texts)
    # once more with nothing but bearings, so that these hold without any known phrase
    some = keys < 0
    again, of = np.unique(doc[some], return_inverse=True)
    truth += [truth[d] for d in again.tolist()]
    doc, keys = np.concatenate([doc, len(texts) + of]), np.concatenate([keys, keys[some]])
    model.keys, column = np.unique(keys, return_inverse=True)
    # a word alone says little: it is held back more than word sequences are
    hold = np.where((model.keys >= 0) & (model.keys < len(model.vocabulary) + 2), 30 * decay, decay)[:, None]
    model.weights, model.bias = _softmax_fit(doc, column, hold, np.array(truth), steps)
    return model


def _softmax_fit(doc: np.ndarray, column: np.ndarray, hold: np.ndarray, truth: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of each category against none, by Adam on all rows."""
    k, n, width = len(CATEGORIES), len(truth), len(hold)
    w, b = np.zeros((width, k)), np.zeros(k)
    goal = np.eye(k + 1)[truth][:, 1:]
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = np.stack([np.bincount(doc, weights=c[column], minlength=n) for c in w.T], axis=1) + b
        top = np.maximum(z.max(axis=1, keepdims=True), 0)
        p = np.exp(z - top)
        p /= p.sum(axis=1, keepdims=True) + np.exp(-top)
        gap = (p - goal) / n
        slope = np.stack([np.bincount(column, weights=g[doc], minlength=width) for g in gap.T], axis=1)
        for i, (param, grad) in enumerate(((w, slope + hold * w), (b, gap.sum(axis=0)))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            param -= 0.05 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w, b


def fit(labels: DataFrame, terms: DataFrame) -> Model:
    """The model of the labelled rows, of which at most MOST_LABELS are used, and of
    the whole lexicon, which is refused beyond MOST_TERMS."""
    few = labels.select("label_id", "text", "emojis", "category").orderBy("label_id").limit(MOST_LABELS).toPandas()
    listed = terms.select("term_id", "term", "category", *(["strength"] if "strength" in terms.columns else [])).orderBy("term_id").limit(MOST_TERMS + 1).toPandas()
    if len(listed) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms in the lexicon")
    return train(few, listed)


def score_comments(comments: DataFrame, model: Model, keep: tuple[str, ...] = ("cid", "source")) -> DataFrame:
    """``keep`` with ``score`` and ``category`` for every row.

    ``score`` is the margin of the likeliest category over none; where it is
    positive, that is the category, else 'none'. Null and empty
    texts and emojis count as nothing said; a row with neither has category
    'none'. Repeated rows are scored again; other columns aren't read.
    """
    sent = comments.sparkSession.sparkContext.broadcast(model)
    slim = comments.select(*keep, F.col("text").alias("__text"), F.col("emojis").alias("__emojis"))
    schema = T.StructType([*slim.drop("__text", "__emojis").schema.fields, T.StructField("score", T.DoubleType()), T.StructField("category", T.StringType())])
    names = np.array([*CATEGORIES, "none"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = len(keep)
            texts = [sent.value.tokens(t, e) for t, e in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            margin, kind = sent.value.score(texts)
            kind = np.where(margin > 0, kind, len(CATEGORIES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(margin), pa.array(names[kind], pa.string())], names=[f.name for f in schema])

    return slim.mapInArrow(run, schema)


def found(comments: DataFrame, model: Model) -> DataFrame:
    """Each cid that is a case, with its category."""
    return score_comments(comments, model, ("cid",)).where("category <> 'none' and cid is not null").groupBy("cid").agg(F.max(F.struct("score", "category")).alias("worst")).select("cid", "worst.category")


def rates(scored: DataFrame) -> DataFrame:
    """Rows, cases and rates of each category by ``source``; null is a source too."""
    parts = [F.sum((F.col("category") == c).cast("long")).alias(f"{c}_rows") for c in CATEGORIES]
    by = scored.groupBy("source").agg(F.count(F.lit(1)).alias("comments"), *parts)
    return by.select("*", *((F.col(f"{c}_rows") / F.col("comments")).alias(f"{c}_rate") for c in CATEGORIES))
