"""Lexical and dense retrieval for a set of questions at once.

Questions are few and known: their terms and vectors are sent to the executors
after a check of their number; comments are read once, and only rows that share a
term, or the best of each task, are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from throng.functions import columns as C
from throng.session import stage_table

#: Questions of one call; they are sent to every executor.
MOST_QUESTIONS = 10_000
K1, B = 1.5, 0.75
DIM, NGRAM = 512, 4
#: What isn't of tokens and isn't one blank.
_GAPS = " ?[^a-z0-9' ][^a-z0-9']*|  [^a-z0-9']*"
#: Texts that are made into vectors at once.
CHUNK = 1024
SPARSE = T.StructType([T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("norm2", T.LongType())])


def few(questions: DataFrame) -> DataFrame:
    """The questions, refused if they are more than a broadcast should hold."""
    if questions.limit(MOST_QUESTIONS + 1).count() > MOST_QUESTIONS:
        raise ValueError(f"more than {MOST_QUESTIONS} questions in one call")
    return questions


def joined(text: F.Column) -> F.Column:
    """The tokens of a text with a blank between them; what is one blank already
    isn't replaced."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _GAPS, " "))


def said(comments: DataFrame) -> F.Column:
    """The joined tokens of a comment's text or else its emoji, where they aren't
    in a column ``said`` already."""
    return F.col("said") if "said" in comments.columns else joined(C.embedding_text(F.col("text"), F.col("emojis")))


def tokenised(comments: DataFrame) -> DataFrame:
    """Comments with the joined tokens of their column ``said`` in its place, as
    ``joined`` gives them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("said")
            text = pc.fill_null(batch.column(at), "")
            try:
                text.validate(full=True)
            except pa.ArrowInvalid:  # bytes that are no text
                text = pa.array([t.decode(errors="replace") for t in text.cast(pa.binary()).to_pylist()], pa.string())
            # a capital with a dot gives two letters, as in Java
            low = pc.utf8_lower(pc.replace_substring(text, "\u0130", "i\u0307"))
            text = pc.ascii_trim(pc.replace_substring_regex(low, _GAPS, " "), " ")
            yield batch.set_column(at, batch.schema.field(at), text)

    return comments.mapInArrow(cut, comments.schema)


def lexical_text() -> F.Column:
    """Text and author, as the lexical index of comments reads them."""
    return F.concat_ws(" ", F.col("text"), F.col("author"))


def asked_terms(questions: DataFrame) -> DataFrame:
    """``question, term, qtf``: the terms of each question that aren't stopwords."""
    return few(questions).select("question", F.explode(C.query_tokens(F.col("words"))).alias("term")).groupBy("question", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(documents: DataFrame, questions: DataFrame, doc: str = "cid", k1: float = K1, b: float = B) -> DataFrame:
    """``question, <doc>, score`` of every document that shares a term with it.

    documents: ``<doc>, document``; questions: ``question, words``. Stopwords of a
    question don't count, repeated terms count repeatedly, terms the corpus lacks
    not at all. One pass over the documents keeps their lengths and asked terms; the
    number and mean length of documents, document frequencies and scores come from these.
    """
    asked = asked_terms(questions)
    terms = [r.term for r in asked.select("term").distinct().collect()]
    words = documents.select(F.col(doc).alias("doc"), C.tokens(F.col("document")).alias("words"))
    # documents are cut into words once: lengths and asked terms serve all that follows
    sized = stage_table(words.select("doc", F.size("words").alias("len"), _hits(terms).alias("hits")), "bm25-documents")
    corpus = sized.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    # a document's words are in its row: their counts need no exchange
    tf = sized.select("doc", "len", F.explode("hits").alias("hit")).select("doc", "len", "hit.term", "hit.tf")
    return bm25_scores(tf, asked, corpus, doc, k1, b)


def _hits(terms: list[str]) -> F.Column:
    """Asked terms among ``words`` with their counts; membership is by hash."""
    found = F.filter("words", lambda w: w.isin(*terms)) if terms else F.array().cast("array<string>")
    return F.transform(F.array_distinct(found), lambda t: F.struct(t.alias("term"), F.size(F.filter(found, lambda w: w == t)).alias("tf")))


def bm25_scores(tf: DataFrame, asked: DataFrame, corpus: DataFrame, doc: str, k1: float = K1, b: float = B) -> DataFrame:
    """Scores from ``doc, term, tf, len`` of the asked terms."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(corpus)).select("term", "mean", F.greatest(F.lit(1e-6), F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
    norm = 1 - b + b * F.col("len") / F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
    scored = tf.join(F.broadcast(asked), "term").join(F.broadcast(idf), "term")
    return scored.groupBy("question", "doc").agg(F.sum(part).alias("score")).withColumnRenamed("doc", doc)


def bm25_grouped(rows: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """BM25 over the joined texts of each key, from rows ``<key>, text``, where a
    text is its joined tokens.

    Same scores as over one document for each key, without ever joining its
    texts: lengths and term counts of the rows are summed.
    """
    asked = asked_terms(questions)
    terms = [r.term for r in asked.select("term").distinct().collect()]
    if not terms:  # nothing was asked for
        return rows.sparkSession.createDataFrame([], f"question string, {key} string, score double")
    sized = rows.select(F.col(key).alias("doc"), F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " ")).alias("words"))
    # written once: scores, document frequencies and the mean length all come from them
    lengths = stage_table(sized.groupBy("doc").agg(F.sum(F.size("words")).alias("len")), "bm25-lengths")
    corpus = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    counts = sized.select("doc", F.explode(_hits(terms)).alias("hit")).groupBy("doc", "hit.term").agg(F.sum("hit.tf").alias("tf"))
    tf = stage_table(counts.join(lengths, "doc"), "bm25-counts")
    return bm25_scores(tf, asked, corpus, key)


def best(scored: DataFrame, n: int, doc: str = "cid") -> DataFrame:
    """The ``n`` best of each question with ``place`` from 1; ties by document."""
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), doc))
    return scored.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def positions(rows: DataFrame, group: str, *order: F.Column) -> DataFrame:
    """``rows`` with their ``place`` from 1 in their group, for groups of any size.

    Rows are sorted by range over all tasks and numbered in their part; the sizes of
    the parts of a group, few as they are, give what to add. The order must have no
    ties. Rows without a group are left out. Written to the shared folder, so numbers
    and sizes are of the same parts.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("__part", T.LongType()), T.StructField("place", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(group).to_pandas()
            place = (own.groupby(own, sort=False).cumcount() + 1).to_numpy()
            place = place + np.where((own == last).to_numpy(), count, 0)
            last, count = own.iloc[-1], int(place[-1])
            yield batch.append_column("__part", pa.array(np.full(len(own), part))).append_column("place", pa.array(place.astype(np.int64)))

    sorted_ = rows.where(F.col(group).isNotNull()).repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    held = stage_table(sorted_.mapInArrow(number, schema), "positions")
    sizes = held.groupBy(group, "__part").agg(F.max("place").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # written, so that it is known to be small
    added = stage_table(sizes.withColumn("before", before).drop("n"), "position-sizes")
    out = held.join(added, [group, "__part"])
    return out.withColumn("place", F.col("place") + F.col("before")).select(*rows.columns, "place")


@lru_cache(maxsize=500_000)
def slot(feature: str, dim: int = DIM, digest: str = "blake2b") -> tuple[int, int]:
    """Slot and sign of a feature, by a hash that never changes."""
    if digest == "md5":
        told = hashlib.md5(feature.encode()).digest()
        return int.from_bytes(told[:4], "big") % dim, 1 if told[4] >> 7 else -1
    value = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
    return value % dim, 1 if value >> 63 else -1


class Embedder(Protocol):
    """What turns words into vectors of whole numbers; comments that are alike have
    a cosine of at least ``threshold``."""

    name: str
    dim: int
    threshold: float

    def sparse(self, words: list[str]) -> tuple[list[int], list[int], int]:
        """Slots, their counts, and the squared length of the vector."""

    def questions(self, comments: DataFrame, asked: dict[str, list[str]]) -> dict[str, np.ndarray]:
        """Unit vectors of questions given as words."""


@dataclass(frozen=True)
class Hashing:
    """Signed counts of hashed words, pairs and character n-grams; needs no model.

    digest: blake2b, as saved indexes have it, or md5, which SQL engines have too.
    """

    dim: int = DIM
    digest: str = "blake2b"
    name: str = "hashing"
    threshold: float = 0.30

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ValueError("dim must be positive")

    def sparse(self, words: list[str]) -> tuple[list[int], list[int], int]:
        return sparse(words, self.dim, self.digest)

    def rows(self, texts: list[str]) -> np.ndarray:
        """Vectors of many texts, given as tokens joined by blanks, at once."""
        at, ids = _hashes(self.dim, self.digest).of(texts)
        return np.bincount(at * self.dim + (ids >> 1), (ids & 1) * 2.0 - 1.0, len(texts) * self.dim).reshape(len(texts), self.dim)

    def questions(self, comments: DataFrame, asked: dict[str, list[str]]) -> dict[str, np.ndarray]:
        """Each feature is weighted by the root of its inverse document frequency."""
        having = {q: features(words) for q, words in asked.items()}
        df, docs = feature_frequencies(comments, frozenset(f for fs in having.values() for f in fs))
        out = {}
        for question, fs in having.items():
            v = np.zeros(self.dim)
            for f in fs:
                k, sign = slot(f, self.dim, self.digest)
                v[k] += sign * math.sqrt(math.log((docs + 1) / (df.get(f, 0) + 1)) + 1)
            size = float(np.linalg.norm(v))
            out[question] = v / size if size else v
        return out


@dataclass(frozen=True)
class Encoded:
    """Vectors of a given model: ``encode`` takes a text and gives ``dim`` numbers.

    Unit vectors are rounded to 1/10,000, so equal texts are equal everywhere.
    """

    name: str
    dim: int
    encode: Callable[[str], list[float]]
    threshold: float = 0.62

    def sparse(self, words: list[str]) -> tuple[list[int], list[int], int]:
        v = np.asarray(self.encode(" ".join(words)), dtype=float)
        if len(v) != self.dim:
            raise ValueError(f"{self.name} gave {len(v)}, not {self.dim}, numbers")
        size = float(np.linalg.norm(v))
        whole = np.rint(v / size * 10_000).astype(np.int64) if words and size else np.zeros(self.dim, dtype=np.int64)
        at = np.flatnonzero(whole)
        return at.tolist(), whole[at].tolist(), int((whole**2).sum())

    def questions(self, comments: DataFrame, asked: dict[str, list[str]]) -> dict[str, np.ndarray]:
        out = {}
        for question, words in asked.items():
            v = np.zeros(self.dim)
            slots, counts, norm2 = self.sparse(words)
            v[slots] = counts
            out[question] = v / math.sqrt(norm2) if norm2 else v
        return out


_EMBEDDERS: dict[str, Callable[[int], Embedder]] = {"hashing": Hashing, "auto": Hashing, "hashing-md5": lambda dim: Hashing(dim, "md5", "hashing-md5")}


def register_embedder(name: str, build: Callable[[int], Embedder]) -> None:
    """Make ``build(dim)`` known as ``name``."""
    _EMBEDDERS[name] = build


def get_embedder(name: str = "auto", dim: int = DIM) -> Embedder:
    """The embedder of that name; hashing unless another is asked for."""
    if name not in _EMBEDDERS:
        raise ValueError(f"no embedder {name!r}; known: {', '.join(sorted(_EMBEDDERS))}")
    return _EMBEDDERS[name](dim)


def features(words: list[str], n: int = NGRAM) -> list[str]:
    """Words, neighbouring pairs and character n-grams of the joined words."""
    packed = " ".join(words)
    return [f"w:{w}" for w in words] + [f"b:{a}_{b}" for a, b in zip(words, words[1:], strict=False)] + [f"c:{packed[i : i + n]}" for i in range(len(packed) - n + 1)]


#: What tokens are made of, with the blank between them; others end a text.
_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789' "
_CODES = np.full(256, len(_SIGNS), np.int32)
_CODES[np.frombuffer(_SIGNS.encode(), np.uint8)] = np.arange(len(_SIGNS))


class Numbered:
    """The features of many texts as numbers that ``number`` gives, -1 for none.

    A feature's string is only made where it is first met: n-grams of four signs
    stand in a table, words and pairs of words in dictionaries that start anew when
    they are large.
    """

    MOST = 500_000

    def __init__(self, number: Callable[[str], int], closed: bool = False) -> None:
        """closed: only pairs of words that have numbers may have one."""
        self.number, self.closed = number, closed
        self.grams = np.full((len(_SIGNS) + 1) ** NGRAM, -2, np.int32)
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.words = np.zeros(1024, np.int32)
        self.pairs: dict[int, int] = {}

    def _word(self, word: str) -> int:
        if word not in self.ids:
            self.ids[word] = k = len(self.names)
            self.names.append(word)
            if k == len(self.words):
                self.words = np.concatenate([self.words, np.zeros_like(self.words)])
            self.words[k] = self.number(f"w:{word}")
        return self.ids[word]

    def _pair(self, code: int) -> int:
        if code not in self.pairs:
            self.pairs[code] = self.number(f"b:{self.names[code >> 32]}_{self.names[code & 0xFFFFFFFF]}")
        return self.pairs[code]

    def _gram(self, code: int) -> None:
        rest, gram = code, ""
        for _ in range(NGRAM):
            rest, k = divmod(rest, len(_SIGNS) + 1)
            gram = (_SIGNS[k] if k < len(_SIGNS) else "\n") + gram
        self.grams[code] = -1 if "\n" in gram else self.number(f"c:{gram}")  # the end of a text is in none

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The text's place and the number of every feature of texts of tokens joined
        by blanks, as often as it occurs."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.ids) > self.MOST or len(self.pairs) > self.MOST:
            self.forget()
        codes = _CODES[np.frombuffer(("\n".join(texts) + "\n" * NGRAM).encode(), np.uint8)]
        ends = np.flatnonzero(codes == len(_SIGNS))
        if len(ends) != len(texts) + NGRAM - 1:
            raise ValueError("tokens have other signs than letters, digits and apostrophes")
        sizes = np.diff(ends[: len(texts)], prepend=-1) - 1
        base, n = len(_SIGNS) + 1, int(ends[len(texts) - 1])
        gram = ((codes[:n] * base + codes[1 : n + 1]) * base + codes[2 : n + 2]) * base + codes[3 : n + 3]
        found = self.grams[gram]
        if (new := found == -2).any():
            for code in np.unique(gram[new]).tolist():
                self._gram(code)
            found = self.grams[gram]
        at = np.flatnonzero(found >= 0)
        full = np.flatnonzero(sizes)
        split = pc.split_pattern(pa.array(texts, pa.string()).take(pa.array(full)), " ")
        words = split.flatten().dictionary_encode()
        known = np.fromiter(map(self._word, words.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(words.dictionary))
        ids = known[words.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
        own = full[pc.list_parent_indices(split).to_numpy()]
        numbers = self.words[ids]
        same = own[:-1] == own[1:]
        if self.closed:
            same &= (numbers[:-1] >= 0) & (numbers[1:] >= 0)
        pair = pa.array((ids[:-1] << 32 | ids[1:])[same]).dictionary_encode()
        codes = pair.dictionary.to_numpy().tolist()
        pairs = np.fromiter(map(self.pairs.get, codes, repeat(-2)), np.int64, len(codes))
        for i in np.flatnonzero(pairs == -2).tolist():
            pairs[i] = self._pair(codes[i])
        pairs = pairs[pair.indices.to_numpy()] if len(pairs) else pairs
        rows = np.concatenate([np.repeat(np.arange(len(texts)), sizes + 1)[at], own, own[:-1][same]])
        numbers = np.concatenate([found[at], numbers, pairs])
        if (numbers < 0).any():
            rows, numbers = rows[numbers >= 0], numbers[numbers >= 0]
        return rows, numbers


@lru_cache(maxsize=4)
def _hashes(dim: int, digest: str) -> Numbered:
    """Twice the slot, plus 1 for a positive sign; kept by a worker."""

    def number(feature: str) -> int:
        k, sign = slot.__wrapped__(feature, dim, digest)
        return 2 * k + (sign > 0)

    return Numbered(number)


def matrix(texts: list[str], embedder: Embedder) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of texts, tokens joined by blanks, and their squared lengths.

    In single precision where the products of any two such vectors are whole
    numbers that it holds exactly, else in double. Copies of a text are made from it.
    """
    place: dict[str, int] = {}
    copies = [place.setdefault(t, len(place)) for t in texts]
    if len(place) < 0.9 * len(texts):
        x, norm2 = matrix(list(place), embedder)
        return x[copies], norm2[copies]
    if hasattr(embedder, "rows"):
        x = embedder.rows(texts)
    else:
        x = np.zeros((len(texts), embedder.dim))
        for i, text in enumerate(texts):
            slots, counts, _ = embedder.sparse(text.split(" ") if text else [])
            x[i, slots] = counts
    norm2 = np.einsum("ij,ij->i", x, x)
    return (x.astype(np.float32) if norm2.max(initial=0) < 2**24 else x), norm2


def sparse(words: list[str], dim: int = DIM, digest: str = "blake2b") -> tuple[list[int], list[int], int]:
    """Signed counts of the features by slot, and their squared length."""
    total: Counter = Counter()
    for f in features(words):
        k, sign = slot(f, dim, digest)
        total[k] += sign
    items = sorted((k, v) for k, v in total.items() if v)
    return [k for k, _ in items], [v for _, v in items], sum(v * v for _, v in items)


def embedding(text: F.Column, embedder: Embedder = Hashing()) -> F.Column:
    """Sparse vector of a text of whole numbers, so equal texts are equal exactly;
    a text without tokens has an empty one."""

    @F.pandas_udf(SPARSE)
    def vectors(words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([embedder.sparse(list(w)) for w in words], columns=["slots", "counts", "norm2"])

    return vectors(C.tokens(text))


def feature_frequencies(comments: DataFrame, wanted: frozenset[str]) -> tuple[dict[str, int], int]:
    """In how many comments each wanted feature is, and how many comments there are."""

    names = sorted(wanted)
    place = {f: i for i, f in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Numbered(lambda f: place.get(f, -1), closed=True)
        seen, docs = np.zeros(len(names), np.int64), 0
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                rows, ids = known.of(batch.column(0).slice(at, CHUNK).to_numpy(zero_copy_only=False).tolist())
                seen += np.bincount(np.unique(rows * len(names) + ids) % max(1, len(names)), minlength=len(names))[: len(names)]
            docs += len(batch)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"feature": ["", *(names[i] for i in some)], "n": [docs, *seen[some].tolist()]})

    if not names:
        return {}, max(1, comments.count())
    rows = comments.select(said(comments).alias("said")).mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = {r.feature: r.n for r in rows}
    return df, max(1, df.pop("", 0))


def question_vectors(comments: DataFrame, questions: DataFrame, embedder: Embedder = Hashing()) -> dict[str, np.ndarray]:
    """Unit vectors of the questions; stopwords don't count."""
    asked = {r.question: list(r.w) for r in few(questions).select("question", C.query_tokens(F.col("words")).alias("w")).collect()}
    return embedder.questions(comments, asked)


def dense(comments: DataFrame, vectors: dict[str, np.ndarray], n: int | None, doc: str = "cid", embedder: Embedder = Hashing()) -> DataFrame:
    """``question, <doc>, score``: cosine of each comment with each question.

    With ``n`` only the ``n`` best of each question in a batch of rows go on, ties
    by the document; None keeps all rows. Scores are rounded to nine places, so
    that they don't depend on the order of additions.
    """
    names = sorted(vectors)
    matrix = np.stack([vectors[q] for q in names]) if names else np.zeros((0, embedder.dim))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs = batch["doc"].to_numpy(dtype=object)
            x, length = np.zeros((len(batch), matrix.shape[1])), np.ones(len(batch))
            for i, words in enumerate(batch["words"]):
                slots, counts, norm2 = embedder.sparse(list(words))
                x[i, slots] = counts
                length[i] = math.sqrt(norm2) or 1.0
            found = np.round(x @ matrix.T / length[:, None], 9) + 0.0
            rows = []
            for j in range(len(names)):
                col = found[:, j]
                at = np.arange(len(col))
                if n is not None and n < len(col):
                    at = np.flatnonzero(col >= np.partition(col, -n)[-n])
                    at = at[np.lexsort((docs[at].astype(str), -col[at]))[:n]]
                rows.append(pd.DataFrame({"question": names[j], "doc": docs[at], "score": col[at]}))
            if rows:
                yield pd.concat(rows)

    text = C.embedding_text(F.col("text"), F.col("emojis")) if "emojis" in comments.columns else F.col("text")
    rows = comments.select(F.col(doc).cast("string").alias("doc"), C.tokens(text).alias("words"))
    return rows.mapInPandas(score, "question string, doc string, score double").withColumnRenamed("doc", doc)


def fuse(rankings: list[DataFrame], k: int = 60, weights: list[float] | None = None, doc: str = "cid") -> DataFrame:
    """Reciprocal rank fusion of ``question, <doc>, place`` lists (places from 1):
    the sum of weight / (k + place) over the lists that have a document."""
    weights = weights if weights is not None else [1.0] * len(rankings)
    if len(weights) != len(rankings):
        raise ValueError("as many weights as rankings are needed")
    parts = [r.select("question", doc, (F.lit(float(w)) / (k + F.col("place"))).alias("part")) for r, w in zip(rankings, weights, strict=True)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("question", doc).agg(F.sum("part").alias("score"))


def hybrid(comments: DataFrame, questions: DataFrame, n: int = 10, depth: int = 50, weights: tuple[float, float] = (1.0, 1.0), embedder: Embedder = Hashing()) -> DataFrame:
    """The ``n`` best comments of each question by fused lexical and dense rank."""
    scored = bm25(comments.select("cid", lexical_text().alias("document")), questions)
    lexical = best(scored.withColumn("score", F.round("score", 9)), depth)
    near = best(dense(comments, question_vectors(comments, questions, embedder), depth, embedder=embedder), depth)
    fused = fuse([lexical, near], weights=list(weights))
    return best(fused.withColumn("score", F.round("score", 12)), n)
