"""Containers hold everything, nothing too much, and little room is left."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from throng.llm import bpe, packing

DATA = "/root/testdata/sf0.01"


def test_best_fit_and_search_keep_items():
    rnd = random.Random(2)
    for _ in range(30):
        sizes = np.array([rnd.randint(0, 100) for _ in range(rnd.randint(1, 200))])
        start = packing.best_fit(sizes, 100)
        bins = packing.local_search([list(b) for b in start], sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sizes[b].sum() <= 100 for b in bins) and len(bins) <= len(start)


def test_search_empties_a_container():
    sizes = np.array([6, 5, 5, 4, 7, 3])  # 30 in containers of 10
    bins = packing.local_search([[0, 5], [1, 3], [4], [2]], sizes, 10)
    assert len(bins) == 3


def test_exchanges_two_for_one():
    sizes = np.array([60, 39, 30, 31])
    search = packing._Search([[0, 1], [2, 3]], sizes, 100)
    assert search.step(1, [(0,)]) == 0
    assert search.fill[0] == 100 and search.fill.sum() == 160 and sorted(search.bins[0]) == [1, 2, 3]


def test_search_goes_on_after_a_stuck_giver():
    sizes = np.array([400, 401, 405, 402, 590])
    bins = packing.local_search([[0], [1, 2], [3, 4]], sizes, 1000)
    assert sorted(int(sizes[b].sum()) for b in bins) == [400, 803, 995]


def test_pairs_beyond_the_largest_items():
    sizes = np.array([1000 + 2 * i for i in range(41)] + [4, 3, 6, 49_993])
    bins = [list(range(43)), [43, 44]]
    search = packing._Search(bins, sizes, 50_000)
    assert search.step(0, [(1,)]) == 1
    assert search.fill[1] == 50_000 and sorted(search.bins[1]) == [41, 42, 44]


def test_search_removes_containers_of_large_items():
    """Items of a sixth to three quarters of a container: best fit leaves many short."""
    sizes = np.random.default_rng(0).integers(700, 3000, 400)
    start = packing.best_fit(sizes, 4096)
    search = packing._Search(start, sizes, 4096)
    search.run()
    filled = [b for b in search.bins if b]
    assert search.steps > 100 and len(filled) < 0.97 * len(start) and sorted(i for b in filled for i in b) == list(range(400))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_search_works_on_the_given_documents():
    texts = pq.read_table(f"{DATA}/documents.parquet")["text"].to_pylist()
    sizes = np.minimum(bpe.Encoder(*bpe.read_merges(bpe.tokenizer_path())).count([t or "" for t in texts]), 4096)
    search = packing._Search(packing.best_fit(sizes, 4096), sizes, 4096)
    before = (search.fill**2).sum()
    search.run()
    assert search.steps > 0 and (search.fill**2).sum() > before and search.fill.max() <= 4096
    assert sum(map(bool, search.bins)) <= -(-sizes.sum() // 4096) + 1


def test_search_moves_items_of_no_tokens():
    sizes = np.array([5, 0, 5])
    bins = packing.local_search([[0, 1], [2]], sizes, 10)
    assert len(bins) == 1 and sorted(bins[0]) == [0, 1, 2]


def test_table(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 1, 5, 80, 300, 950, 1001, 5000])) for i in range(800)] + [(7, 10), (7, 10), (None, 3), (9_007_199_254_740_993, 2), (801, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").repartition(4)
    out = packing.pack_items(df, 1000).collect()
    total = Counter()
    for d, t in rows:
        total[d] += t or 0
    back, fill = Counter(), Counter()
    for r in out:
        back[r.doc_id] += r.tokens
        fill[r.container] += r.tokens
        assert r.part == 0 or r.tokens <= 1000
    assert {k: v for k, v in back.items() if v} == {k: v for k, v in total.items() if v}
    assert {r.doc_id for r in out} == set(total)
    parts = [p for _, t in rows for p in [1000] * ((t or 0) // 1000) + [(t or 0) % 1000]]
    assert max(fill.values()) <= 1000 and len(fill) <= len(packing.best_fit(np.array(parts), 1000)) + 1
    assert all(fill[r.container] + r.room == 1000 for r in out)
    whole = Counter(r.doc_id for r in out if r.doc_id is not None and r.doc_id < 800 and r.doc_id != 7)
    assert all(whole[i] == max(1, -(-t // 1000)) for i, t in rows[:800] if i != 7)


def test_no_items_and_bad_capacity(spark):
    df = spark.createDataFrame([], "doc_id long, tokens long")
    assert packing.pack_items(df, 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack_items(df, 0)


def test_items_that_fill_no_container(spark):
    """More than a load of them: every one keeps a container of its own."""
    df = spark.createDataFrame([(i, 700) for i in range(50)], "doc_id long, tokens long").repartition(3)
    out = packing.pack_items(df, 1000, load=20).collect()
    assert sorted(r.doc_id for r in out) == list(range(50)) and len({r.container for r in out}) == 50
    assert all(r.room == 300 for r in out)
    with pytest.raises(ValueError):
        packing.pack_items(df, 1000, load=0)


def test_sizes_of_different_loads_meet(spark):
    """Large items in some partitions and small ones in others: alone 60 and 20 containers."""
    df = spark.createDataFrame([(i, 700 if i < 60 else 260) for i in range(120)], "doc_id long, tokens long").coalesce(4).sortWithinPartitions("doc_id")
    out = packing.pack_items(df, 1000, load=20).collect()
    fill = Counter()
    for r in out:
        fill[r.container] += r.tokens
    assert sorted(r.doc_id for r in out) == list(range(120)) and max(fill.values()) <= 1000
    assert 60 <= len(fill) <= 70


def test_documents(spark):
    df = spark.createDataFrame([(1, "one two three", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 9000, "x")], "doc_id long, text string, tokens string")
    rows = packing.containers(df, 4096).collect()
    assert sorted(r.part for r in rows if r.doc_id == 4) == [0, 1, 2] and {r.doc_id for r in rows} == {1, 2, 3, 4}
