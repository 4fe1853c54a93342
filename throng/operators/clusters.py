"""Opinion clusters: comments grouped under their most liked neighbours.

In the order (likes descending, cid) a comment becomes a leader if no earlier
leader of its corpus is at least as similar as the threshold; any other comment
joins its most similar earlier leader, the earliest of equals. A corpus is what
shares a partition column (a video); its comments may be in any number of tasks.

A corpus of few comments is settled and assigned in one task. The leaders of larger
ones are found in rounds: of every corpus the first undecided texts, a block of
bounded size, are settled one by one in one task; then all undecided texts
meet the new leaders of their corpus and those near one leave. A last pass assigns
every comment to a leader. Equal texts have equal vectors, which are made once. Similarities are quotients of integers,
computed in one way everywhere, so ties are exact. Vectors are made from the texts
where they meet and never stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from throng.functions import columns as C
from throng.operators import search
from throng.session import drop_stage, stage_table

THRESHOLD = search.Hashing().threshold
#: Texts of a corpus that are settled in one task in the first round; after it few
#: texts are undecided, and LATER times as many are settled at once.
BLOCK, LATER = 2048, 8
#: About how many comments of a corpus meet leaders in one task; a corpus of no more
#: is settled there as well.
SHARE = 20_000
#: Texts that meet leaders at once.
STEP = 256
#: Places of a ranking from which clusters are looked at first.
FIRST = 256
#: So many of these are sent to all tasks; more are joined.
MOST_FIRST = 100_000
_TEXT = T.StructType([T.StructField("corpus", T.StringType()), T.StructField("salt", T.LongType()), T.StructField("rank", T.StringType()), T.StructField("said", T.StringType())])


def similarities(a: np.ndarray, a2: np.ndarray, b: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Cosines of integer vectors: exact dot products over the root of an exact
    product, hence equal for equal inputs wherever they are computed."""
    size = np.sqrt(a2[:, None].astype(float) * b2[None, :])
    return np.divide(a @ b.T, size, out=np.zeros_like(size), where=size > 0)


def _vectors(said: pa.Array | pa.ChunkedArray, embedder: search.Embedder) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of a bounded number of texts at a time, with the first one's place."""
    for at in range(0, len(said), search.CHUNK):
        # to_pylist makes a scalar of every text first
        yield (at, *search.matrix(np.asarray(said.slice(at, search.CHUNK)).tolist(), embedder))


def _matrix(said: pa.Array, embedder: search.Embedder) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the texts of one task and their squared lengths."""
    parts = [(x, x2) for _, x, x2 in _vectors(said, embedder)] or [search.matrix([], embedder)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x2 for _, x2 in parts])


def _near(x: np.ndarray, x2: np.ndarray, leads: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """Which vectors are near any of the leaders."""
    near = np.zeros(len(x), bool)
    for y, y2 in leads:
        if len(y) and not near.all():
            far = np.flatnonzero(~near)
            near[far] = (similarities(x[far], x2[far], y, y2) >= threshold).any(axis=1)
    return near


def _closest(x: np.ndarray, x2: np.ndarray, y: np.ndarray, y2: np.ndarray, copy: np.ndarray | None = None, hidden: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each vector, or each copy of one, the most similar leader that isn't
    hidden, the earliest of equals, and the similarity; -2 where all are hidden.

    What isn't near the greatest by scaled products, which are exact but for their
    rounding, can't be it; only the rest get their similarity.
    """
    dots = x @ y.T
    scaled = dots * np.divide(1.0, np.sqrt(y2), out=np.zeros(len(y2)), where=y2 > 0).astype(dots.dtype)
    if copy is not None:
        dots, scaled, x2 = dots[copy], scaled[copy], x2[copy]
    if hidden is not None:
        scaled[hidden] = -np.inf
    most = scaled.max(axis=1)
    row, col = np.nonzero(scaled >= (most - 1e-6 * np.abs(np.where(np.isinf(most), 0, most)))[:, None])
    size = np.sqrt(x2[row].astype(float) * y2[col])
    sim = np.divide(dots[row, col], size, out=np.zeros(len(row)), where=size > 0)
    order = np.lexsort((col, -sim, row))
    first = order[np.searchsorted(row, np.arange(len(most)))]  # row is sorted, so each has its own range
    return col[first], np.where(np.isinf(most), -2.0, sim[first])


def _leaders(x: np.ndarray, x2: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the leaders among texts in the order of their ranks; for each text
    the number of its most similar earlier leader, a leader's own, and the similarity.
    Every text meets every earlier leader once."""
    lead, y, y2 = np.zeros(0, np.int64), np.empty((0, x.shape[1]), x.dtype), np.empty(0, x2.dtype)
    at, best, count = np.zeros(len(x), np.int64), np.full(len(x), -2.0), 0
    for low in range(0, len(x), STEP):
        mine, mine2 = x[low : low + STEP], x2[low : low + STEP]
        top, value = _closest(mine, mine2, y[:count], y2[:count]) if count else (np.zeros(len(mine), np.int64), np.full(len(mine), -2.0))
        left = np.flatnonzero(value < threshold)
        alike = similarities(mine[left], mine2[left], mine[left], mine2[left]) >= threshold
        open_, new = np.ones(len(left), bool), []
        for i in range(len(left)):
            if open_[i]:
                new.append(left[i])
                open_ &= ~alike[i]
        if new:
            if count + len(new) > len(y):
                more = max(STEP, len(y))
                y, y2 = np.concatenate([y, np.empty((more, x.shape[1]), x.dtype)]), np.concatenate([y2, np.empty(more, x2.dtype)])
            y[count : count + len(new)], y2[count : count + len(new)] = mine[new], mine2[new]
            near, sim = _closest(mine, mine2, mine[new], mine2[new], hidden=np.asarray(new)[None, :] >= np.arange(len(mine))[:, None])
            top, value = np.where(sim > value, count + near, top), np.maximum(sim, value)
            top[new], value[new] = count + np.arange(len(new)), np.inf
            lead, count = np.concatenate([lead, low + np.asarray(new)]), count + len(new)
        at[low : low + STEP], best[low : low + STEP] = top, value
    return lead, at, best


def _distinct(said: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Each text once, in the order of their first copies, and every row's number."""
    coded = said.combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _blank(said: pa.ChunkedArray) -> np.ndarray:
    """A comment without tokens is near nothing, and nothing is near it."""
    return np.asarray(pc.starts_with(said, "\0"), dtype=bool)


def _settle(threshold: float, embedder: search.Embedder):
    def settle(block: pa.Table) -> pa.Table:
        """The leaders among the first undecided texts of one corpus."""
        block = block.sort_by("rank").select(_TEXT.names)
        texts, number = _distinct(block["said"])
        first = np.unique(number, return_index=True)[1]
        return block.take(first[_leaders(*_matrix(texts, embedder), threshold)[0]])

    return settle


def _far(threshold: float, embedder: search.Embedder):
    def far(texts: pa.Table, leads: pa.Table) -> pa.Table:
        """The texts, each by its first copy, that are near none of the leaders."""
        texts = texts.select(_TEXT.names).sort_by("rank")
        texts = texts.take(np.unique(_distinct(texts["said"])[1], return_index=True)[1])
        texts = texts.filter(pc.invert(pc.is_in(texts["said"], leads["said"].combine_chunks())))
        known = [(y, y2) for _, y, y2 in _vectors(leads["said"], embedder)]
        keep = [~_near(x, x2, known, threshold) for _, x, x2 in _vectors(texts["said"], embedder)]
        return texts.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))

    return far


def _places(text: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray, x2: np.ndarray, leads: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the most similar of its leaders from low to before high, the
    earliest of equals, and the similarity; -2 without any. text: the row's vector.
    leads: blocks of leaders, each with the number of its first."""
    at, best = high.copy(), np.full(len(text), -2.0)
    order = np.lexsort((text, low, high))  # those that meet the same leaders
    for start, y, y2 in leads:
        mine = order[(low[order] < start + len(y)) & (high[order] > start) & (low[order] < high[order])]
        for k in range(0, len(mine), STEP):
            rows = mine[k : k + STEP]
            i, j = max(0, low[rows].min() - start), min(len(y), high[rows].max() - start)
            own, copy = np.unique(text[rows], return_inverse=True)
            here = np.arange(start + i, start + j)[None, :]
            hidden = (here < low[rows][:, None]) | (here >= high[rows][:, None])
            top, value = _closest(x[own], x2[own], y[i:j], y2[i:j], copy, hidden)
            better = value > best[rows]
            best[rows[better]], at[rows[better]] = value[better], start + i + top[better]
    return at, best


def _copied(number: np.ndarray, before: np.ndarray, x: np.ndarray, x2: np.ndarray, leads: Iterable[tuple[int, np.ndarray, np.ndarray]], known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The leader of each row, whose vector is its number. before: how many leaders
    its rank comes after, in no falling order. The first row of a text meets all of
    these, unless its leader and similarity are known, other copies those since."""
    first = np.unique(number, return_index=True)[1]
    low = before[first][number]
    low[first] = before[first] if known else 0
    at, best = _places(number, low, before, x, x2, leads)
    if known:
        at[first], best[first] = known
    earlier = first[number]
    return np.where(best > best[earlier], at, at[earlier])


def _join(embedder: search.Embedder, names: list[str]):
    def join(rows: pa.Table, leads: pa.Table) -> pa.Table:
        """Each row with its leader, a leader with itself."""
        rows, leads = rows.sort_by("rank"), leads.sort_by("rank")
        rank, lead = rows["rank"].to_numpy().astype(str), leads["rank"].to_numpy().astype(str)
        at = np.searchsorted(lead, rank)
        own = np.zeros(len(rows), bool)
        own[at < len(lead)] = lead[at[at < len(lead)]] == rank[at < len(lead)]
        there, here = np.flatnonzero(~_blank(leads["said"])), np.flatnonzero(~_blank(rows["said"]) & ~own)
        if len(here) and len(there):
            texts, number = _distinct(rows["said"].take(here))
            found = _copied(number, np.searchsorted(there, at[here]), *_matrix(texts, embedder), _vectors(leads["said"].take(there), embedder))
            at[here] = there[found]
        chosen = leads.select(["cluster_id", "leader"]).take(at)
        return rows.select(names).append_column("cluster_id", chosen["cluster_id"]).append_column("leader", chosen["leader"])

    return join


def _settled(rows: pa.Table, threshold: float, embedder: search.Embedder) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a corpus of few comments in the order of ranks: the places of its leaders
    and each row's number among them; the places of rows with tokens, their texts
    and each one's number, and the texts' vectors, which are made once."""
    blank = _blank(rows["said"])
    here = np.flatnonzero(~blank)
    texts, number = _distinct(rows["said"].take(here))
    x, x2 = _matrix(texts, embedder)
    found, at, best = _leaders(x, x2, threshold)
    first = np.unique(number, return_index=True)[1]
    there = here[first[found]]
    before = np.searchsorted(there, here)
    lead = np.sort(np.concatenate([np.flatnonzero(blank), there]).astype(np.int64))
    cluster = np.searchsorted(lead, np.arange(len(rows)))
    if len(here):
        blocks = ((k, x[found[k : k + search.CHUNK]], x2[found[k : k + search.CHUNK]]) for k in range(0, len(found), search.CHUNK))
        leads = np.zeros(len(x), bool)
        leads[found] = True
        before[leads[number]] = 0  # copies of a leader are nearest to it
        cluster[here] = np.searchsorted(lead, there)[_copied(number, before, x, x2, blocks, (at, best))]
    return lead, cluster, here, texts, number, x, x2


def _whole(threshold: float, embedder: search.Embedder, names: list[str]):
    def whole(rows: pa.Table) -> pa.Table:
        """The clusters of a corpus of few comments."""
        rows = rows.sort_by("rank")
        lead, at, *_ = _settled(rows, threshold, embedder)
        return rows.select(names).append_column("cluster_id", pa.array(at)).append_column("leader", rows["cid"].take(lead[at]))

    return whole


def _lists(owner: np.ndarray, count: int, values: pa.Array) -> pa.Array:
    """One list for each of count owners, from values in the order of their owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(count + 1)), pa.int32()), values)


def _cosines(at: np.ndarray, number: np.ndarray, count: int, x: np.ndarray, x2: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Cosines of each cluster's mean unit vector with each question, for rows with
    their cluster and the number of their vector."""
    pairs, copies = np.unique(at * len(x) + number, return_counts=True)
    cluster, text = pairs // len(x), pairs % len(x)
    weight = copies / np.sqrt(np.where(x2 > 0, x2, 1))[text]
    starts = np.unique(cluster, return_index=True)[1]
    out, k = np.zeros((count, asked.shape[1])), 0
    while k < len(starts):
        # whole clusters of about CHUNK texts
        end = max(k + 1, int(np.searchsorted(starts, starts[k] + search.CHUNK)))
        low, high = starts[k], starts[end] if end < len(starts) else len(pairs)
        unit = x[text[low:high]] * weight[low:high, None]
        edges = [*(starts[k:end] - low).tolist(), len(unit)]
        sums = np.stack([unit[i] if j == i + 1 else unit[i:j].sum(axis=0) for i, j in zip(edges, edges[1:], strict=False)])
        size = np.linalg.norm(sums, axis=1)
        out[cluster[starts[k:end]]] = sums @ asked / np.where(size > 0, size, 1)[:, None]
        k = end
    return out


_MEASURED = "corpus string, cluster_id long, support long, endorsement long, words long, terms array<string>, counts array<long>, asked array<string>, near array<double>"


def _measured(threshold: float, embedder: search.Embedder, terms: list[str], vectors: dict[str, np.ndarray]):
    names = sorted(q for q, v in vectors.items() if v.any())
    asked = np.stack([vectors[q] for q in names]).T if names else np.zeros((embedder.dim, 0))

    def measured(rows: pa.Table) -> pa.Table:
        """What the clusters of a corpus of few comments have: comments, likes, words
        and asked terms of those with a text, cosines with the questions."""
        rows = rows.sort_by("rank")
        lead, at, here, texts, number, x, x2 = _settled(rows, threshold, embedder)
        likes = np.zeros(len(lead), np.int64)
        np.add.at(likes, at, rows["likes"].to_numpy())
        worded = np.asarray(rows["worded"], dtype=bool)[here]
        mine, text = at[here][worded], number[worded]
        split = pc.split_pattern(texts, " ")
        size = np.where(np.asarray(pc.equal(texts, ""), dtype=bool), 0, pc.list_value_length(split).to_numpy(zero_copy_only=False)).astype(np.int64)
        words = np.zeros(len(lead), np.int64)
        np.add.at(words, mine, size[text])
        # asked terms by text, then once for each row of the text
        term = pc.index_in(split.flatten(), pa.array(terms, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        keys, tf = np.unique((pc.list_parent_indices(split).to_numpy(zero_copy_only=False) * max(1, len(terms)) + term)[term >= 0], return_counts=True)
        ends = np.searchsorted(keys // max(1, len(terms)), np.arange(len(texts) + 1))
        many = np.diff(ends)[text]
        hit = np.repeat(ends[text] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        found, place = np.unique(np.repeat(mine, many) * max(1, len(terms)) + keys[hit] % max(1, len(terms)), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, place, tf[hit])
        owner = found // max(1, len(terms))
        scores = _cosines(at[here], number, len(lead), x, x2, asked)
        k, q = np.nonzero(scores > 1e-12)
        return pa.Table.from_pydict({
            "corpus": rows["corpus"].take(lead), "cluster_id": np.arange(len(lead)), "support": np.bincount(at, minlength=len(lead)), "endorsement": likes, "words": words,
            "terms": _lists(owner, len(lead), pa.array(terms, pa.string()).take(found % max(1, len(terms)))), "counts": _lists(owner, len(lead), pa.array(total)),
            "asked": _lists(k, len(lead), pa.array(names, pa.string()).take(q)), "near": _lists(k, len(lead), pa.array(scores[k, q])),
        })

    return measured


def _for_all(leads: DataFrame, shares: DataFrame) -> DataFrame:
    """Leaders once for each share of their corpus."""
    return leads.drop("salt").join(shares, "corpus").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")


def _with(members: DataFrame, comments: DataFrame, *columns: str) -> DataFrame:
    """Members with columns of their comments, joined unless they are there."""
    lacking = [c for c in columns if c not in members.columns]
    return members.join(comments.select("cid", *lacking), "cid") if lacking else members


def _laid(comments: DataFrame, corpus: str | None, threshold: float, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The comments with their tokens, written; in how many shares each corpus is
    settled; and the comments as they are settled."""
    name = F.coalesce(F.col(corpus).cast("string"), F.lit("")) if corpus else F.lit("")
    # tokens are found once; all that follows reads them
    raw = F.col("said") if "said" in comments.columns else C.embedding_text(F.col("text"), F.col("emojis"))
    told = comments.withColumns({"corpus": name, "said": raw}).select("cid", "corpus", "said", *dict.fromkeys(("likes", *(c for c in keep if c != "said"))))
    held = stage_table(told if "said" in comments.columns else search.tokenised(told), "cluster-rows")
    # texts without tokens are all one vector, but near nothing: each stays by itself
    alone = (F.col("said") == "") & F.lit(threshold > 0)
    # a key that sorts as (likes descending, cid): no large corpus is sorted in one task
    first = F.lpad((F.lit(2**62) - F.col("likes")).cast("string"), 20, "0")
    ranked = held.withColumns({"blank": alone, "rank": F.concat(first, F.lit(" "), F.col("cid"))})
    marked = F.when(F.col("blank"), F.concat(F.lit("\0"), F.col("cid"))).otherwise(F.col("said"))
    shares = stage_table(held.groupBy("corpus").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("shares")), "cluster-shares")
    salt = F.pmod(F.xxhash64("said"), F.col("shares"))
    given = [c for c in ("cid", "corpus", *keep) if c != "said"]
    rows = ranked.join(shares, "corpus").select(*given, "shares", "rank", "blank", salt.alias("salt"), marked.alias("said"))
    return held, shares, rows


def leader_clusters(comments: DataFrame, corpus: str | None = "video_id", threshold: float | None = None, embedder: search.Embedder = search.Hashing(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``cid, corpus, cluster_id, leader`` of every comment, with the columns to keep.

    comments: unique cids with text, emojis, likes and the corpus column; None for
    a single corpus; a null corpus is one of its own. Cluster numbers of a corpus
    start at 0 in the order of their leaders. Texts without tokens are near nothing
    unless the threshold is 0 or less.
    """
    threshold = embedder.threshold if threshold is None else threshold
    names = ["cid", "corpus", *keep]
    held, shares, rows = _laid(comments, corpus, threshold, keep)
    schema = T.StructType([*held.select(names).schema.fields, T.StructField("cluster_id", T.LongType()), T.StructField("leader", T.StringType())])
    members = rows.where("shares = 1").groupBy("corpus").applyInArrow(_whole(threshold, embedder, names), schema)
    old = [held]
    if not shares.where("shares > 1").isEmpty():
        members = members.unionByName(_large(rows, shares, threshold, embedder, names, schema, old))
    if "said" in keep:
        members = members.withColumn("said", F.when(F.col("said").startswith("\0"), "").otherwise(F.col("said")))
    members = stage_table(members.select("cid", "corpus", "cluster_id", "leader", *keep), "cluster-members")
    for table in old:
        drop_stage(table)
    return members


def _large(rows: DataFrame, shares: DataFrame, threshold: float, embedder: search.Embedder, names: list[str], schema: T.StructType, old: list[DataFrame]) -> DataFrame:
    """The members of the clusters of large corpora; tables that they are read from
    are added to ``old``."""
    many, shares = rows.where("shares > 1"), shares.where("shares > 1")
    numbered = _numbered(many, shares, threshold, embedder, old)
    met = many.groupBy("corpus", "salt").cogroup(_for_all(numbered, shares).groupBy("corpus", "salt"))
    return met.applyInArrow(_join(embedder, names), schema)


def _numbered(rows: DataFrame, shares: DataFrame, threshold: float, embedder: search.Embedder, old: list[DataFrame]) -> DataFrame:
    """``corpus, rank, said, cluster_id, leader`` of the leaders of large corpora;
    tables that are needed until all comments are assigned are added to ``old``."""
    todo = rows.where("not blank").select(*_TEXT.names)
    found, size = rows.where("blank").select(*_TEXT.names), BLOCK
    while True:
        head = Window.partitionBy("corpus").orderBy("rank")
        block = todo.withColumn("n", F.row_number().over(head)).where(F.col("n") <= size).drop("n")
        new = stage_table(block.groupBy("corpus").applyInArrow(_settle(threshold, embedder), _TEXT), "cluster-leaders")
        found = found.unionByName(new)
        old.append(new)
        if todo.groupBy("corpus").count().where(F.col("count") > size).isEmpty():
            break  # every corpus was settled to its end
        pairs = todo.groupBy("corpus", "salt").cogroup(_for_all(new, shares).groupBy("corpus", "salt"))
        todo = stage_table(pairs.applyInArrow(_far(threshold, embedder), _TEXT), "cluster-todo")
        old.append(todo)
        size = BLOCK * LATER
    placed = search.positions(found, "corpus", F.col("rank"))
    numbered = stage_table(placed.select("corpus", "rank", "said", (F.col("place") - 1).alias("cluster_id"), F.substring("rank", 22, 1_000_000).alias("leader")), "cluster-numbered")
    old.append(numbered)
    return numbered


def summaries(comments: DataFrame, members: DataFrame, max_quotes: int = 5) -> DataFrame:
    """One row for each cluster: support, endorsement, mean valence, leader and its
    text, and the first ``max_quotes`` members by likes as exemplars."""
    rows = _with(members, comments, "text", "emojis", "likes", "valence")
    said = F.when(F.col("text") != "", F.col("text")).otherwise(F.col("emojis"))
    key = ["corpus", "cluster_id"]
    # numbers only, so they are summed by hash; the leader's text comes from its row
    sums = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("support"), F.sum("likes").alias("endorsement"), F.avg("valence").alias("valence"))
    sums = sums.join(rows.where(F.col("cid") == F.col("leader")).select(*key, F.col("leader").alias("representative_cid"), said.alias("representative_text")), key)
    # the limit stands right at the window, so each task passes on a few rows of a cluster
    first = rows.select(*key, "cid", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("likes"), "cid")).alias("place")).where(F.col("place") <= max_quotes)
    shown = first.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "cid"))), lambda x: x["cid"]).alias("exemplar_cids"))
    return sums.join(shown, key, "left").withColumn("exemplar_cids", F.coalesce("exemplar_cids", F.array().cast("array<string>")))


def centroid_scores(comments: DataFrame, members: DataFrame, vectors: dict[str, np.ndarray], embedder: search.Embedder = search.Hashing()) -> DataFrame:
    """``question, corpus, cluster_id, score``: positive cosines of each cluster's
    mean unit vector with each question. Rows are sorted by range over all tasks, so a
    cluster of any size may lie in several; a task holds one sum of vectors. Clusters
    that a task has whole are scored there, and only sums of the first and the last
    one of each task, which may go on elsewhere, are put together."""
    names = sorted(q for q, v in vectors.items() if v.any())
    out = "question string, corpus string, cluster_id long, score double"
    if not names:  # nothing is near a question without words
        return comments.sparkSession.createDataFrame([], out)
    asked = np.stack([vectors[q] for q in names]).T

    def cosines(keys: list[tuple], sums: np.ndarray) -> dict[str, list]:
        size = np.linalg.norm(sums, axis=1)
        found = sums @ asked / np.where(size > 0, size, 1)[:, None]
        k, q = np.nonzero(found > 1e-12)
        return {"question": [names[i] for i in q], "corpus": [keys[i][0] for i in k], "cluster_id": [keys[i][1] for i in k], "score": found[k, q]}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = lambda key, total: pa.RecordBatch.from_pydict({"question": [None], "corpus": [key[0]], "cluster_id": [key[1]], "score": [None], "total": [total.tobytes()]}, schema=parts)
        open_, total, first = None, np.zeros(embedder.dim), True
        for batch in batches:
            for at in range(0, len(batch), search.CHUNK):
                rows = {c: v.to_numpy(zero_copy_only=False).tolist() for c, v in zip(batch.schema.names, batch.slice(at, search.CHUNK).columns, strict=True)}
                x, x2 = search.matrix(rows["said"], embedder)
                x = x / np.sqrt(np.where(x2 > 0, x2, 1))[:, None]
                keys = list(zip(rows["corpus"], rows["cluster_id"], strict=True))
                starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
                sums = np.add.reduceat(x, starts, axis=0)
                runs = [keys[i] for i in starts]
                if runs[0] == open_:
                    sums[0] += total
                elif open_ is not None:
                    runs, sums = [open_, *runs], np.vstack([total, sums])
                if first and len(runs) > 1:  # it may have begun in the task before
                    yield edge(runs[0], sums[0])
                    runs, sums, first = runs[1:], sums[1:], False
                open_, total = runs[-1], sums[-1].copy()
                told = cosines(runs[:-1], sums[:-1])
                yield pa.RecordBatch.from_pydict(told | {"total": [None] * len(told["question"])}, schema=parts)
        if open_ is not None:
            yield edge(open_, total)

    def whole(sums: pa.Table) -> pa.Table:
        keys = list(zip(sums["corpus"].to_pylist()[:1], sums["cluster_id"].to_pylist()[:1], strict=True))
        told = cosines(keys, sum(np.frombuffer(t) for t in sums["total"].to_pylist())[None, :])
        return pa.Table.from_pydict(told, schema=parts.remove(4))

    parts = pa.schema([("question", pa.string()), ("corpus", pa.string()), ("cluster_id", pa.int64()), ("score", pa.float64()), ("total", pa.binary())])
    rows = members if "said" in members.columns else _with(members, comments, "text", "emojis")
    rows = rows.select("corpus", "cluster_id", "cid", search.said(rows).alias("said")).where("said <> ''")
    order = ["corpus", "cluster_id", "cid"]
    scored = stage_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("cid").mapInArrow(gather, f"{out}, total binary"), "evidence-central")
    edges = scored.where("total is not null").groupBy("corpus", "cluster_id").applyInArrow(whole, out)
    return scored.where("total is null").drop("total").unionByName(edges)


def ratio(value: F.Column, best: F.Column) -> F.Column:
    """A value as a part of the greatest one; 1 for all where that is nothing."""
    clamped = F.greatest(value, F.lit(0.0))
    return F.when(best <= 1e-12, F.lit(1.0)).otherwise(clamped / best)


def _weighed(weights: tuple[float, float, float]) -> None:
    if min(weights) < 0 or weights[0] > 1 or sum(weights) <= 0:
        raise ValueError("weights must not be negative, the first at most 1, their sum positive")


def _key() -> F.Column:
    return F.concat_ws("#", "corpus", F.lpad(F.col("cluster_id").cast("string"), 12, "0")).alias("key")


def _ranked(lexical: DataFrame, near: DataFrame, keyed: DataFrame, questions: DataFrame, weights: tuple[float, float, float], limit: int) -> DataFrame:
    """``question, key, salience, score, place`` of the ``limit`` best clusters of each
    question, from its two rankings' scores and from support and endorsement by key.

    Only clusters among the FIRST places of a ranking are put together. All others
    have less salience than such places give, and less social proof than those that
    have most; where that would be enough for a place, all clusters are put together.
    """
    g, a, b = weights
    ranks = [search.positions(r.select("question", "key", "score"), "question", F.desc("score"), F.col("key")) for r in (lexical, near)]
    most = keyed.agg(F.max(F.log1p(F.col("support").cast("double"))).alias("best_support"), F.max(F.log1p(F.col("endorsement").cast("double"))).alias("best_likes"))
    social = 1 + a * ratio(F.log1p(F.col("support").cast("double")), F.col("best_support")) + b * ratio(F.log1p(F.col("endorsement").cast("double")), F.col("best_likes"))
    keyed = keyed.crossJoin(F.broadcast(most)).select("key", social.alias("social"))
    part = lambda factor: keyed.orderBy(F.desc(F.round(F.col("social") * factor, 9)), "key").limit(limit)
    likeliest = part(1 - g).unionByName(part(1.0)).select("key").distinct()
    asked = search.few(questions).select("question", (F.size(C.query_tokens(F.col("words"))) > 0).alias("content"))
    # at most twice the limit of clusters for each of a few questions, of no weight, and what was ranked
    named = asked.select("question").crossJoin(F.broadcast(likeliest)).withColumn("place", F.lit(1))

    def placed(lists: list[DataFrame]) -> DataFrame:
        fused = stage_table(search.fuse([*lists, named], k=10, weights=[1.0, 1.0, 0.0], doc="key").withColumnRenamed("score", "fused"), "evidence-fused")
        best = fused.groupBy("question").agg(F.max("fused").alias("best_fused"))
        rows = fused.join(F.broadcast(asked), "question").join(F.broadcast(best), "question").join(keyed, "key")
        rows = rows.withColumn("salience", F.when(F.col("content"), ratio(F.col("fused"), F.col("best_fused"))).otherwise(1.0))
        rows = rows.withColumn("score", ((1 - g) + g * F.col("salience")) * F.col("social"))
        place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc(F.round("score", 9)), "key"))
        top = rows.withColumn("place", place.cast("long")).where(F.col("place") <= limit)
        return stage_table(top.select("question", "key", "salience", "score", "place", "best_fused"), "evidence-top")

    first = stage_table(ranks[0].unionByName(ranks[1]).where(F.col("place") <= FIRST).select("question", "key").unionByName(named.select("question", "key")).distinct(), "evidence-first")
    kept = F.broadcast(first) if first.count() <= MOST_FIRST else first
    top = placed([r.join(kept, ["question", "key"], "left_semi") for r in ranks])
    # what a cluster beyond these places could reach at most, against the last of the best
    last = top.groupBy("question").agg(F.min("score").alias("score"), F.max("best_fused").alias("best_fused"), F.count(F.lit(1)).alias("n"))
    proof = part(1.0).agg(F.min("social").alias("proof"))
    most_salient = F.when(F.col("best_fused") * (11.0 + FIRST) > 2.0, 2.0 / (F.col("best_fused") * (11.0 + FIRST))).otherwise(1.0)
    bound = ((1 - g) + g * most_salient) * (F.col("proof") + 1e-8)
    open_ = last.crossJoin(F.broadcast(proof)).where((F.col("n") < limit) | (F.col("score") <= bound + 1e-8))
    if not open_.isEmpty():
        longer = ranks[0].unionByName(ranks[1]).where(F.col("place") > FIRST).select("question")
        if not longer.join(F.broadcast(open_), "question", "left_semi").isEmpty():
            top = placed(ranks)
    return top.drop("best_fused")


def standing(comments: DataFrame, questions: DataFrame, weights: tuple[float, float, float] = (0.6, 0.2, 0.2), limit: int = 6, corpus: str | None = "video_id", threshold: float | None = None, embedder: search.Embedder = search.Hashing()) -> tuple[DataFrame, DataFrame]:
    """``question, place, corpus, cluster_id, support, endorsement, salience, score`` as
    ``evidence`` gives them for the ``leader_clusters`` of the comments, and the
    comments that were read.

    Clusters of corpora of few comments are counted and meet the questions where they
    are settled, from the vectors that are there; neither their members nor any text of
    theirs goes on. The members of larger ones are counted over all tasks.
    """
    _weighed(weights)
    threshold = embedder.threshold if threshold is None else threshold
    keep = ("likes", "worded", "said")
    held, shares, rows = _laid(comments.withColumn("worded", F.coalesce(F.col("text") != "", F.lit(False))), corpus, threshold, keep)
    asked = search.asked_terms(questions)
    terms = [r.term for r in asked.select("term").distinct().orderBy("term").collect()]
    vectors = search.question_vectors(held, questions, embedder)
    few = rows.where("shares = 1").select("corpus", "rank", "said", "likes", "worded")
    made = stage_table(few.groupBy("corpus").applyInArrow(_measured(threshold, embedder, terms, vectors), _MEASURED).withColumn("key", _key()), "cluster-measures")
    sizes = made.select("key", "corpus", "cluster_id", "support", "endorsement", "words")
    counts = made.select("key", F.explode(F.arrays_zip("terms", "counts")).alias("hit"), "words").select("key", "hit.terms", "hit.counts", "words").toDF("doc", "term", "tf", "len")
    near = made.select("key", F.explode(F.arrays_zip("asked", "near")).alias("hit")).select(F.col("hit.asked").alias("question"), "key", F.col("hit.near").alias("score"))
    if not shares.where("shares > 1").isEmpty():
        names = ["cid", "corpus", *keep]
        old: list[DataFrame] = []
        schema = T.StructType([*held.select(names).schema.fields, T.StructField("cluster_id", T.LongType()), T.StructField("leader", T.StringType())])
        members = _large(rows, shares, threshold, embedder, names, schema, old)
        members = stage_table(members.withColumn("said", F.when(F.col("said").startswith("\0"), "").otherwise(F.col("said"))).drop("leader"), "cluster-members")
        for table in old:
            drop_stage(table)
        words = F.when(F.col("worded") & (F.col("said") != ""), F.split("said", " ")).otherwise(F.array().cast("array<string>"))
        told = members.select("corpus", "cluster_id", "likes", words.alias("words"))
        more = stage_table(told.groupBy("corpus", "cluster_id").agg(F.count(F.lit(1)).alias("support"), F.sum("likes").alias("endorsement"), F.sum(F.size("words")).cast("long").alias("words")).withColumn("key", _key()), "cluster-sizes")
        sizes = sizes.unionByName(more)
        hits = told.select(_key(), F.explode(search._hits(terms)).alias("hit")).groupBy("key", "hit.term").agg(F.sum("hit.tf").alias("tf"))
        counts = counts.unionByName(hits.join(more.select("key", F.col("words").alias("len")), "key").withColumnRenamed("key", "doc"))
        near = near.unionByName(centroid_scores(members, members, vectors, embedder).select("question", _key(), "score"))
    about = sizes.agg(F.count(F.lit(1)).alias("docs"), F.avg("words").alias("mean"))
    lexical = search.bm25_scores(counts, asked, about, "key").withColumn("score", F.round("score", 9))
    near = near.withColumn("score", F.round("score", 9)).where("score > 0")
    top = _ranked(stage_table(lexical, "evidence-lexical"), near, sizes.select("key", "support", "endorsement"), questions, weights, limit)
    found = top.join(sizes.drop("words"), "key")
    return found.select("question", "place", "corpus", "cluster_id", "support", "endorsement", "salience", "score"), held


def evidence(comments: DataFrame, members: DataFrame, clusters: DataFrame, questions: DataFrame, weights: tuple[float, float, float] = (0.6, 0.2, 0.2), limit: int = 6, max_quotes: int = 3, embedder: search.Embedder = search.Hashing()) -> DataFrame:
    """The ``limit`` best clusters of each question over the whole table.

    Salience: reciprocal rank fusion (k = 10) of BM25 over the clusters' joined
    texts and of positive cosines to their centroids, as a part of the best; 1 for
    all where a question has no content words. score = ((1 - g) + g salience)
    (1 + a log-support + b log-endorsement), both as parts of the best. Quotes are
    the exemplars nearest to the question, or without any the leader's text.

    A cluster that no ranking of a question has differs from others of its kind by
    its social part only, so of these the ``limit`` first are enough, the same for
    all questions; no cluster meets a question it has nothing to do with.
    """
    _weighed(weights)
    key = _key()
    texts = _with(members, comments, "text")
    # tokens that were found before, unless they are those of the emoji
    texts = texts.select(key, (F.when(F.col("text") != "", F.col("said")).otherwise("") if "said" in texts.columns else search.joined(F.col("text"))).alias("text"))
    lexical = search.bm25_grouped(texts, questions, "key").withColumn("score", F.round("score", 9))
    vectors = search.question_vectors(comments, questions, embedder)
    near = centroid_scores(comments, members, vectors, embedder).select("question", key, F.round("score", 9).alias("score")).where("score > 0")
    keyed = clusters.withColumn("key", key)
    top = _ranked(lexical, near, keyed, questions, weights, limit)
    total = comments.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("n"), F.greatest(F.lit(1), F.sum("likes")).alias("l"))
    top = stage_table(top.join(keyed, "key").crossJoin(F.broadcast(total)), "evidence-top")
    top = top.withColumn("support_share", F.col("support") / F.col("n")).withColumn("endorsement_share", F.col("endorsement") / F.col("l"))
    names = ("question", "place", "corpus", "cluster_id", "support", "endorsement", "valence", "representative_cid", "representative_text", "exemplar_cids", "salience", "score", "support_share", "endorsement_share")
    if max_quotes < 1:
        return top.select(*names, F.array("representative_text").alias("quotes"))
    shown = top.select("question", "key", F.explode("exemplar_cids").alias("cid"))
    wanted = stage_table(comments.join(F.broadcast(shown.select("cid").distinct()), "cid", "left_semi").select("cid", "text", "emojis"), "evidence-quoted")
    sims = search.dense(wanted, vectors, None, embedder=embedder)
    said = F.when(F.col("text") != "", F.col("text")).otherwise(F.col("emojis"))
    by = Window.partitionBy("question", "key").orderBy(F.desc(F.coalesce("sim", F.lit(0.0))), "cid")
    quotes = shown.join(sims.withColumnRenamed("score", "sim"), ["question", "cid"], "left").join(wanted.select("cid", said.alias("said")), "cid").withColumn("q", F.row_number().over(by)).where((F.col("q") <= max_quotes) & (F.col("said") != ""))
    quotes = quotes.groupBy("question", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("q", "said"))), lambda x: x["said"]).alias("quotes"))
    out = top.join(quotes, ["question", "key"], "left")
    return out.select(*names, F.coalesce("quotes", F.array("representative_text")).alias("quotes"))


def opinion_share(found: DataFrame, top: int = 8) -> DataFrame:
    """What a chart of opinions shows: a label, percent of people and of likes."""
    label = F.when(F.coalesce("representative_text", F.lit("")) == "", "(emoji only)").otherwise(C.excerpt(F.col("representative_text"), 52))
    percent = lambda c: F.round(F.col(c) * 100, 4)
    return found.where(F.col("place") <= top).select("question", "place", label.alias("label"), percent("support_share").alias("people"), percent("endorsement_share").alias("likes"))


def coverage(found: DataFrame, comments: DataFrame) -> DataFrame:
    """Share of all comments that each question's evidence speaks for; clusters
    of a corpus have no comment in common."""
    total = comments.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("n"))
    return found.groupBy("question").agg(F.sum("support").alias("s")).crossJoin(F.broadcast(total)).select("question", (F.col("s") / F.col("n")).alias("coverage"))


__all__ = ["centroid_scores", "coverage", "evidence", "leader_clusters", "opinion_share", "ratio", "similarities", "standing", "summaries"]
