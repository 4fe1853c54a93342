"""Byte-level byte-pair encoding of whole text columns with a public vocabulary.

Texts of an Arrow batch are cut into pre-tokens by vectorised character classes
(letters, digits, blanks, the rest, English contractions). The distinct
pre-tokens that this Python worker hasn't met yet are encoded together through a
pair occurrence index: every adjacent pair of symbols is mapped to all its
positions, active merge ranks are applied in ascending order, each to all
positions of its pair at once, and only the lists of the pairs beside a merge are
updated. A merge only makes pairs of higher rank, so one ascending pass is exact.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: How many distinct pre-tokens a worker remembers before it starts anew.
REMEMBERED = 1_000_000
# What a contraction of the pre-token pattern may be.
_ONE = b"sdmt"
_TWO = ((ord("l"), ord("l")), (ord("v"), ord("e")), (ord("r"), ord("e")))
_BLANKS = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _DIGIT, _BLANK = range(4)


def tokenizer_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """The vocabulary file ``name`` in ``folder``; None: of the installed package."""
    if folder:
        return f"{folder}/{name}.json"
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


def read_merges(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the 256 bytes, and a row (left id, right id, new id) for each rank."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in printable)}
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int64)
    return np.array([vocab[shown[b]] for b in range(256)], dtype=np.int64), merges


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            kinds[cp] = _LETTER
        elif kind == "N":
            kinds[cp] = _DIGIT
    kinds[_BLANKS] = _BLANK
    return kinds


def pretoken_starts(cps: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """True where a pre-token starts. firsts: where each non-empty text starts."""
    n = len(cps)
    kind = _classes()[cps]
    begin = np.zeros(n + 1, dtype=bool)
    begin[firsts] = True
    begin[n] = True
    run = begin.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run.copy()
    ends = np.flatnonzero(run[1:]) + 1
    # the last of several blanks leaves its run when something follows in the text
    lead = ends[(kind[ends - 1] == _BLANK) & ~begin[ends]]
    start[lead - 1] = True
    start[lead[cps[lead - 1] == 32]] = False
    # contractions: an apostrophe alone in its run, not after a plain space
    at = np.flatnonzero(cps == 39)
    at = at[start[at] & run[at + 1] & ~begin[at + 1]]
    pad = np.concatenate([cps, [0, 0, 0]])
    a, b = pad[at + 1], np.where(begin[np.minimum(at + 2, n)], 0, pad[at + 2])
    one = np.isin(a, list(_ONE))
    two = ~one & np.logical_or.reduce([(a == x) & (b == y) for x, y in _TWO])
    for hit, size in ((at[one], 1), (at[two], 2)):
        start[hit + 1] = False
        start[np.minimum(hit + 1 + size, n)] = True
    return start[:n]


class Encoder:
    """One vocabulary, with what this worker has encoded so far."""

    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray) -> None:
        self.bytes = byte_ids.tolist()
        self.rank = {(a << 20) | b: r for r, (a, b, _) in enumerate(merges.tolist())}
        self.merged = merges[:, 2].tolist()
        self.pairs = [(a, b) for a, b, _ in merges.tolist()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.size, self.sizes, self.starts = np.zeros(1 << 16, dtype=np.int32), 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        table, rank_of, merged, pairs = self.bytes, self.rank, self.merged, self.pairs
        sym: list[int] = []
        for piece in pieces:
            sym.append(-1)
            sym.extend([table[b] for b in piece])
        sym.append(-1)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        get = rank_of.get
        for p in range(n - 1):
            a, b = sym[p], sym[p + 1]
            if a >= 0 and b >= 0 and (r := get((a << 20) | b)) is not None:
                if r in places:
                    places[r].append(p)
                else:
                    places[r] = [p]
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b = pairs[r]
            new = merged[r]
            here = places.pop(r)
            here.sort()
            done = []
            for p in here:
                if sym[p] == a and sym[q := after[p]] == b:
                    sym[p], sym[q] = new, -2
                    far = after[p] = after[q]
                    before[far] = p
                    done.append(p)
            for p in done:
                if (x := sym[left := before[p]]) >= 0 and (s := get((x << 20) | new)) is not None:
                    if s in places:
                        places[s].append(left)
                    else:
                        places[s] = [left]
                        heapq.heappush(active, s)
                if (y := sym[after[p]]) >= 0 and y != new and (s := get((new << 20) | y)) is not None:
                    if s in places:
                        places[s].append(p)
                    else:
                        places[s] = [p]
                        heapq.heappush(active, s)
        flat = np.array(sym[:-1], dtype=np.int64)
        kept = flat[flat != -2]
        heads = np.flatnonzero(kept == -1)
        counts = np.diff(np.append(heads, len(kept))) - 1
        return kept[kept >= 0].astype(np.int32), counts

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Where each pre-token stands among the known ones; new ones are encoded."""
        known = self.known
        fresh = [p for p in dict.fromkeys(pieces) if p not in known]
        if fresh:
            if len(known) + len(fresh) > REMEMBERED:
                self._forget()
                known = self.known
                fresh = list(dict.fromkeys(pieces))
            ids, counts = self._merge([p.encode() for p in fresh])
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            while self.size + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.size : self.size + len(ids)] = ids
            self.starts = np.concatenate([self.starts, self.size + np.cumsum(counts) - counts])
            self.sizes = np.concatenate([self.sizes, counts])
            self.size += len(ids)
        return np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known-piece number of every pre-token of all texts, where it starts as
        a character of the joined texts, and how many pre-tokens each text has."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        cps = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        firsts = (np.cumsum(lengths) - lengths)[lengths > 0]
        at = np.flatnonzero(pretoken_starts(cps, firsts))
        cuts = at.tolist()
        words = [joined[a:b] for a, b in zip(cuts, [*cuts[1:], len(joined)], strict=True)]
        per = np.diff(np.searchsorted(at, np.concatenate([[0], np.cumsum(lengths)])))
        return self.learn(words), at, per

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        word, _, per = self.pieces(texts)
        sizes = self.sizes[word]
        ends = np.cumsum(sizes)
        where = np.repeat(self.starts[word] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.pool[where], self._by_text(sizes, per)

    def count(self, texts: list[str]) -> np.ndarray:
        """How many tokens each text has."""
        word, _, per = self.pieces(texts)
        return self._by_text(self.sizes[word], per)

    @staticmethod
    def _by_text(sizes: np.ndarray, per: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(total[np.concatenate([[0], np.cumsum(per)])])


class SharedEncoder:
    """Sends a vocabulary to the workers once; each builds its encoder once.

    The vocabulary has a fixed size of about a megabyte, whatever the data.
    """

    _built: dict[str, Encoder] = {}

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.path = path or tokenizer_path()
        self.sent = spark.sparkContext.broadcast(read_merges(self.path))

    def get(self) -> Encoder:
        if self.path not in SharedEncoder._built:
            SharedEncoder._built[self.path] = Encoder(*self.sent.value)
        return SharedEncoder._built[self.path]


def slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Parts of a text column of about ``most`` characters, nulls as ''."""
    values = [x or "" for x in texts.to_pylist()]
    at = size = 0
    for k, v in enumerate(values):
        size += len(v)
        if size >= most:
            yield at, values[at : k + 1]
            at, size = k + 1, 0
    if at < len(values):
        yield at, values[at:]


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col`` and ``ids``, the token ids of each text without special tokens.

    Null and empty texts give an empty list. Their strings count as ordinary text
    where a text holds special tokens. Each row gives one row, repeated rows too;
    a null id passes through. Other columns are not read.
    """
    encoder = SharedEncoder(documents.sparkSession, path)
    slim = documents.select(id_col, text_col)
    schema = T.StructType([slim.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, counts = encoder.get().encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], names=[id_col, "ids"])

    return slim.mapInArrow(run, schema)


def token_counts(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``tokens``, how many tokens each text has; 0 for null."""
    encoder = SharedEncoder(documents.sparkSession, path)
    slim = documents.select(*keep, text_col)
    schema = T.StructType([*slim.drop(text_col).schema.fields, T.StructField("tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [encoder.get().count(texts) for _, texts in slices(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=[*keep, "tokens"])

    return slim.mapInArrow(run, schema)
