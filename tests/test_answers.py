"""Exact answers, retrieval, clusters, routes, guard and the façade."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from throng import catalog
from throng.operators import aggregates, clusters, evaluate, guard, search
from throng.plans import routes
from throng.plans.answers import Comments


@pytest.fixture(scope="module")
def asked(corpus):
    return Comments(corpus)


def one(df):
    return df.collect()[0].asDict()


def test_stats(corpus):
    s = one(aggregates.corpus_stats(corpus))
    assert (s["comments"], s["total_likes"], s["median_likes"], s["max_likes"]) == (11, 3142, 40, 1000)
    assert one(aggregates.corpus_stats(corpus.limit(0)))["top_comment_like_share"] == 0.0


def test_orders(corpus):
    assert [r.cid for r in aggregates.top_liked(corpus, 3).collect()] == ["c4", "c6", "c3"]
    assert aggregates.longest(corpus, 1).first().cid == "c9"
    assert aggregates.top_authors(corpus, 20).count() == 10


def test_mentions_are_whole_words(corpus):
    rows = {r.term: r for r in aggregates.mention_report(corpus, ["harbour", "season", "rain", "", "RASP"]).collect()}
    assert (rows["harbour"]["count"], rows["harbour"].likes) == (6, 2020)
    assert rows["harbour"].share == pytest.approx(6 / 11)
    assert rows["rain"]["count"] == rows[""]["count"] == 0
    assert rows["RASP"]["count"] == 2


def test_mentions_take_signs_literally(spark):
    df = spark.createDataFrame([("c0", "is it c++ or c.", 1), ("c1", "cxx", 1)], "cid string, text string, likes long")
    rows = {r.term: r["count"] for r in aggregates.mention_report(df, ["c++", "c.", "c"]).collect()}
    assert rows["c"] == 1 and rows["c."] <= 1


def test_sentiment(corpus):
    s = one(aggregates.sentiment(corpus))
    assert (s["positive"], s["negative"], s["neutral"]) == (2, 2, 7)
    assert (s["like_weighted_positive"], s["like_weighted_negative"]) == (1900, 1060)


def test_timeline(corpus):
    rows = aggregates.timeline(corpus, 3).orderBy("bucket").collect()
    assert sum(r["count"] for r in rows) == 11 and len(rows) == 3
    undated = corpus.withColumn("published_ts", F.lit(None).cast("double"))
    assert [r.label for r in aggregates.timeline(undated).collect()] == ["unknown"]
    assert [r.label for r in aggregates.timeline(corpus, 0).collect()] == ["unknown"]


def test_timeline_of_one_moment(corpus):
    same = corpus.withColumn("published_ts", F.lit(5.0))
    assert sum(r["count"] for r in aggregates.timeline(same).collect()) == 11


def test_clusters(corpus):
    rows = {r.cid: (r.cluster_id, r.leader) for r in clusters.leader_clusters(corpus, None).collect()}
    assert {c for c, r in rows.items() if r[1] == "c4"} == {"c0", "c1", "c2", "c3", "c4", "c5"}
    assert {c for c, r in rows.items() if r[1] == "c6"} == {"c6", "c7", "c8"}
    assert rows["c4"][0] == 0


def test_clusters_in_many_rounds(corpus, monkeypatch):
    whole = {tuple(r) for r in clusters.leader_clusters(corpus, None).collect()}
    monkeypatch.setattr(clusters, "BLOCK", 2)
    assert {tuple(r) for r in clusters.leader_clusters(corpus, None).collect()} == whole


def test_cluster_extremes(corpus):
    assert clusters.leader_clusters(corpus, None, 0.99).select("cluster_id").distinct().count() == 11
    assert clusters.leader_clusters(corpus, None, -1.0).select("cluster_id").distinct().count() == 1
    assert clusters.leader_clusters(corpus.limit(0), None).count() == 0


def test_same_emoji_never_cluster(spark, corpus):
    two = corpus.limit(2).withColumn("text", F.lit("")).withColumn("emojis", F.lit("🔥"))
    assert clusters.leader_clusters(two, None).select("cluster_id").distinct().count() == 2


def test_bm25_matches_the_formula(spark, corpus):
    q = spark.createDataFrame([("q", "editing editing of Rasp nothingness")], "question string, words string")
    docs = corpus.select("cid", search.lexical_text().alias("document"))
    got = {r.cid: r.score for r in search.bm25(docs, q).collect()}
    import re

    words = {r.cid: re.findall("[a-z0-9']+", r.document.lower()) for r in docs.collect()}
    mean = sum(map(len, words.values())) / len(words)
    exp = {}
    for term in ("editing", "editing", "rasp"):
        df = sum(term in w for w in words.values())
        idf = math.log(1 + (len(words) - df + 0.5) / (df + 0.5))
        for c, w in words.items():
            if tf := w.count(term):
                exp[c] = exp.get(c, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
    assert got == pytest.approx(exp)


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "question string, cid string, place long")
    b = spark.createDataFrame([("q", "y", 1)], "question string, cid string, place long")
    got = {r.cid: r.score for r in search.fuse([a, b]).collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61})
    with pytest.raises(ValueError):
        search.fuse([a, b], weights=[1.0])


def test_hybrid_search(spark, corpus):
    q = spark.createDataFrame([("q", "slow editing")], "question string, words string")
    assert {r.cid for r in search.hybrid(corpus, q, 3).collect()} == {"c6", "c7", "c8"}


@pytest.mark.parametrize(
    ("question", "kind", "intent", "term"),
    [
        ("which comment has the most likes?", "AGGREGATE", "top_liked", ""),
        ("MOST LIKED COMMENT", "AGGREGATE", "top_liked", ""),
        ("how many comments are there", "AGGREGATE", "count_all", ""),
        ("how many comments mention the Harbour?", "AGGREGATE", "mention_count", "harbour"),
        ("how many people mention editing and what do they say about it", "HYBRID", "mention_count", "editing"),
        ("who commented the most", "AGGREGATE", "top_authors", ""),
        ("what is the shortest comment", "AGGREGATE", "longest", ""),
        ("what is the average number of likes", "AGGREGATE", "stats", ""),
        ("when were these comments posted", "AGGREGATE", "timeline", ""),
        ("sentiment breakdown", "HYBRID", "sentiment", ""),
        ("what do people think of this", "CONSENSUS", None, ""),
        ("is the reaction positive or negative", "CONSENSUS", None, ""),
        ("any theories about the harbour", "SEMANTIC", None, ""),
        ("did anyone mention the animation quality", "SEMANTIC", None, ""),
        ("   ", "SEMANTIC", None, ""),
        (None, "SEMANTIC", None, ""),
    ],
)
def test_routes(spark, question, kind, intent, term):
    r = routes.route(spark.createDataFrame([(question,)], "words string")).first()
    assert (r.kind, r.intent, r.term) == (kind, intent, term)


def test_guard(spark):
    rows = [("Six [C0] say so [c9] , 54% agree, 7 comments [c0].", ["c0"], [54.5, 6.0]), (None, None, None), ("99% [c0]", ["c0"], [])]
    got = guard.verify(spark.createDataFrame(rows, "text string, allowed_ids array<string>, allowed_numbers array<double>")).collect()
    assert got[0].citations == ["c0"] and got[0].invalid == ["c9"] and got[0].unsupported == ["7 comments"]
    assert got[0].clean == "Six [C0] say so, 54% agree, 7 comments [c0]." and not got[0].grounded
    assert got[1].clean == "" and got[1].warnings
    assert got[2].unsupported == [] and got[2].grounded


def test_exact_question(asked):
    a = asked.ask("which comment has the most likes?")
    assert a.kind == "AGGREGATE" and "1,000 likes" in a.text and a.coverage == 1.0 and a.citations[0] == "c4"
    a = asked.ask("how many comments mention harbour")
    assert "6 of 11" in a.text and "54.5%" in a.text


def test_reading_question(asked):
    a = asked.ask("what is being said about the slow editing")
    assert a.kind == "SEMANTIC" and a.evidence[0]["representative_cid"] == "c6" and 0 < a.coverage <= 1
    assert not [w for w in a.warnings if "invented" in w]


def test_likes_of_any_member_may_be_stated(spark, corpus):
    """The least likes of a cluster with more than 10,000 different counts."""
    n = 10_050
    said = F.lit("the blue harbour scene is the best moment")
    rows = spark.range(n).select(F.concat(F.lit("c"), F.col("id") + 100).alias("cid"), said.alias("text"), ((F.col("id") + 1) * 7).alias("likes"), *[F.lit(v).cast(corpus.schema[c].dataType).alias(c) for c, v in (("author", "@a"), ("published", ""), ("published_ts", None), ("reply_count", 0), ("is_reply", False), ("emojis", ""), ("valence", 0.0))])
    told = "One has 14 likes [c101], one 1,000,003 likes, one 11 [c999999] likes, one 21 [c999999] likes."
    answer = Comments(rows.select(corpus.columns), complete=lambda shown, question: told).ask("the harbour scene")
    assert [w for w in answer.warnings if "figures" in w] == ["figures that nothing computed supports, perhaps invented: 1,000,003 likes, 11 likes"]


def test_consensus_question(asked):
    a = asked.ask("what do people think overall")
    assert a.kind == "CONSENSUS" and a.evidence[0]["representative_cid"] == "c4" and "%" in a.text


def test_overview_and_blank(asked):
    o = asked.overview()
    assert o["clusters"][0]["support"] == 6 and o["stats"]["comments"] == 11
    assert asked.ask(" ").warnings == ["empty question"]
    assert asked.ask("which comment has the most likes?").to_dict()["coverage"] == 1.0


def test_weights_are_checked(spark, corpus):
    with pytest.raises(ValueError):
        clusters.evidence(corpus, corpus, corpus, corpus, (1.5, 0, 0))


def test_r_precision(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "question string, cid string, place long")
    want = spark.createDataFrame([("q", "a"), ("q", "c")], "question string, cid string")
    assert one(evaluate.r_precision(ranked, want)) == {"correct": 1, "total": 2, "precision": 0.5}


def test_empty_corpus_is_refused(corpus):
    with pytest.raises(ValueError):
        Comments(corpus.limit(0))


def test_evaluation(asked, corpus):
    cases = evaluate.exact_cases(corpus, ("rain", "harbour"))
    assert ("how many people mention harbour?", "6", "mentions") in cases
    assert evaluate.accuracy(cases, lambda q: asked.ask(q).text)[:2] == (6, 6)
    assert evaluate.accuracy(cases, lambda q: evaluate.nearest_texts(corpus, q))[0] < 6


def test_opinion_share(spark, corpus, asked):
    q = spark.createDataFrame([("q", "the slow editing")], "question string, words string")
    found = clusters.evidence(corpus, *asked._clustered(), q)
    rows = clusters.opinion_share(found, 2).orderBy("place").collect()
    assert len(rows) == 2 and rows[0].people == round(300 / 11, 4)
    assert clusters.coverage(found.where("place = 1"), corpus).first().coverage == 3 / 11


def test_positions_of_a_group_in_many_tasks(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("s"), "id").unionByName(spark.range(2).select(F.lit(None).cast("long").alias("g"), F.lit(1).cast("long").alias("s"), "id")).repartition(7)
    got = search.positions(rows, "g", F.desc("s"), F.col("id")).collect()
    assert {r.g for r in got} == {0, 1, 2}
    for g in (0, 1, 2):
        own = sorted((r for r in got if r.g == g), key=lambda r: (-r.s, r.id))
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and own
    assert search.positions(rows.limit(0), "g", F.desc("s"), F.col("id")).count() == 0


def test_embedders(spark, corpus):
    assert search.get_embedder().name == "hashing" and search.get_embedder("hashing-md5", 64).dim == 64
    with pytest.raises(ValueError):
        search.get_embedder("none such")
    with pytest.raises(ValueError):
        search.Hashing(0)
    search.register_embedder("camps", lambda dim: search.Encoded("camps", 2, lambda text: [float("harbour" in text), float("editing" in text)]))
    own = Comments(corpus, embedder="camps")
    assert own.embedder.threshold == 0.62
    leads = {r.cid: r.leader for r in own.members.collect()}
    assert {c for c, x in leads.items() if x == "c4"} == {"c0", "c1", "c2", "c3", "c4", "c5"} and leads["c9"] == "c9"


def test_answerers(corpus):
    from throng.plans import answers

    answers.register_answerer("echo", lambda shown, question: f"{shown.splitlines()[0]} [c6] [c9] {question}")
    got = Comments(corpus, complete="echo").ask("the slow editing", evidence_limit=1, strict=True)
    assert "11 comments, 3,142 likes" in got.text and "[c9]" not in got.text
    with pytest.raises(ValueError):
        Comments(corpus, complete="none such")


def test_a_frequent_word_makes_the_mention_case(corpus):
    assert evaluate.frequent_word(corpus) == "blue"
    assert evaluate.frequent_word(corpus.limit(0)) == ""


def test_mention_cids(corpus):
    assert [(r.term, r.cid, r.place) for r in aggregates.mention_cids(corpus, ["rasp", "rain"]).orderBy("place").collect()] == [("rasp", "c9", 1), ("rasp", "c10", 2)]


def test_words_that_older_indexes_drop(spark):
    from throng.functions import columns as C

    df = spark.createDataFrame([("the better list of endings",)], "t string")
    assert df.select(C.query_tokens(F.col("t")), C.query_tokens(F.col("t"), compat=True)).first()[:] == (["better", "list", "endings"], ["endings"])


def test_registered_share_is_the_overview(spark, corpus, monkeypatch):
    """Nine opinions, of which the eight with the most comments and likes are shown."""
    words = ["harbour", "editing", "music", "dragon", "voices", "ending", "costumes", "jokes", "pacing"]
    rows = [(f"c{10 * i + j}", f"{w} {w} {w}", 100 * (9 - i) + j) for i, w in enumerate(words) for j in range(9 - i)]
    said = spark.createDataFrame(rows, "cid string, text string, likes long")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in corpus.schema if f.name not in said.columns]
    monkeypatch.setattr(catalog, "corpus", lambda spark, sf_dir: said.select("*", *rest, F.lit("v1").alias("video_id")).fillna("").fillna(0.0))
    got = catalog.opinion_share(spark, "").orderBy("place").collect()
    assert [(r.question, r.place, r.label) for r in got] == [("", i + 1, f"{w} {w} {w}") for i, w in enumerate(words[:8])]
    assert got[0].people == pytest.approx(20.0) and got[7].people == pytest.approx(round(200 / 45, 4))


def test_facade_constructors(spark, corpus, tmp_path):
    Comments(corpus).save(str(tmp_path / "i"))
    again = Comments.load(spark, str(tmp_path / "i"))
    assert again.get("c4")["likes"] == 1000 and again.get("zz") is None
    one_row = Comments.from_records(spark, [{"text": "🔥🔥", "votes": "500", "author": "@a"}], 0.0)
    assert "500" in one_row.ask("most liked comment").text and one_row.ask("what do people think").text


@pytest.mark.parametrize("share", [7, 1000])
def test_clusters_follow_the_rule_comment_by_comment(spark, corpus, monkeypatch, share):
    """Large corpora in rounds and shares, small ones in one task: copies, blanks and ties included."""
    words = "harbour editing music dragon voices ending costume joke pacing quill rasp tern".split()
    said = [f"{words[i * 5 % 12]} {words[i * 7 % 11]} {words[i % 5]}" if i % 9 else "🔥" for i in range(90)]
    rows = [(f"c{i}", t, i * 13 % 17, f"v{i % 3 // 2}") for i, t in enumerate(said)]
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in corpus.schema if f.name not in ("cid", "text", "likes")]
    comments = spark.createDataFrame(rows, "cid string, text string, likes long, video_id string").select("*", *rest).fillna("").fillna(0)
    monkeypatch.setattr(clusters, "SHARE", share)
    monkeypatch.setattr(clusters, "BLOCK", 4)
    got = {r.cid: (r.corpus, r.cluster_id, r.leader) for r in clusters.leader_clusters(comments).collect()}
    want, leads = {}, {}
    for cid, text, _, video in sorted(rows, key=lambda r: (-r[2], r[0])):
        slots, counts, norm2 = search.sparse(text.split(" ") if text != "🔥" else [])
        own, v = leads.setdefault(video, []), dict(zip(slots, counts, strict=True))
        sims = [sum(n * w.get(s, 0) for s, n in v.items()) / math.sqrt(norm2 * m) if norm2 * m else 0.0 for _, w, m in own]
        if not sims or max(sims) < clusters.THRESHOLD:
            own.append((cid, v, norm2))
            sims = [0.0] * (len(own) - 1) + [1.0]
        k = sims.index(max(sims))
        want[cid] = (video, k, own[k][0])
    assert got == want


@pytest.mark.parametrize("words", [7, 512])
def test_vectors_of_many_texts_are_those_of_each(words):
    texts = ["", "a", "abc", "abcd", "ab cd", "it's 12 o'clock", "''' ' 9", "", "a a a a", "x" * 5000]
    for embedder in (search.Hashing(words), search.get_embedder("hashing-md5", words)):
        got, norm2 = search.matrix(texts, embedder)
        for x, n, text in zip(got, norm2, texts, strict=True):
            slots, counts, size = embedder.sparse(text.split(" ") if text else [])
            assert n == size and {i: x[i] for i in np.flatnonzero(x)} == dict(zip(slots, counts, strict=True))
    assert search.matrix([], search.Hashing())[0].shape == (0, 512)
    with pytest.raises(ValueError):
        search.matrix(["a\nb"], search.Hashing())


def test_tokens_joined_at_once(spark):
    from throng.functions import columns as C

    texts = [("",), ("É a--B  'c' 9\n\x0bİx K",), ("😀",), (None,), ("  don't  ",)]
    rows = spark.createDataFrame(texts, "t string").select(search.joined(F.col("t")).alias("a"), F.array_join(C.tokens(F.col("t")), " ").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_centroids_of_clusters_in_many_tasks(spark):
    """A cluster that begins in one task and ends in another has one mean."""
    rows = [(f"c{i:03}", "v", i // 40, f"blue harbour scene {i % 7}") for i in range(120)] + [("d", "w", 0, "slow editing")]
    members = spark.createDataFrame(rows, "cid string, corpus string, cluster_id long, said string").repartition(5)
    v = search.matrix(["blue harbour"], search.Hashing())[0][0].astype(float)
    got = {(r.corpus, r.cluster_id): r.score for r in clusters.centroid_scores(members, members, {"q": v / np.linalg.norm(v)}).collect()}
    for key in {(c, k) for _, c, k, _ in rows}:
        x, n = search.matrix([t for _, c, k, t in rows if (c, k) == key], search.Hashing())
        mean = (x / np.sqrt(n)[:, None]).sum(axis=0)
        score = float(mean @ v / np.linalg.norm(v) / np.linalg.norm(mean))
        assert got.get(key, 0.0) == pytest.approx(max(0.0, score), abs=1e-9)


def test_overview_reads_no_vectors_and_no_terms(spark, corpus, asked, monkeypatch):
    """A question without words ranks by social proof alone, so no text is read for it."""
    members, summary = asked._clustered()
    blank = spark.createDataFrame([("", "")], "question string, words string")
    monkeypatch.setattr(search, "_hits", None)
    monkeypatch.setattr(search, "matrix", None)
    got = clusters.evidence(corpus, members, summary, blank, routes.OVERVIEW, 8, max_quotes=0).orderBy("place").collect()
    assert got[0].support == 6 and got[0].salience == 1.0 and got[0].quotes == [got[0].representative_text]


def test_coverage_quotes_nothing(spark, corpus, asked, monkeypatch):
    """Coverage is the same without quotes, for which comments would be read again."""
    q = spark.createDataFrame([("q", "the slow editing")], "question string, words string")
    monkeypatch.setattr(search, "dense", None)
    found = clusters.evidence(corpus, *asked._clustered(), q, max_quotes=0)
    assert clusters.coverage(found.where("place = 1"), corpus).first().coverage == 3 / 11


def test_coverage_follows_no_members(spark, monkeypatch):
    """Small corpora are counted where they are settled: no table of members, no
    summary and no second vector is made for their coverage."""
    for name in ("leader_clusters", "summaries", "centroid_scores", "evidence"):
        monkeypatch.setattr(clusters, name, None)
    monkeypatch.setattr(search, "bm25_grouped", None)
    got = catalog.opinion_coverage(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 40 and all(0 < r.coverage < 1 for r in got)


@pytest.mark.parametrize(("share", "first", "weights"), [(20_000, 256, routes.RELEVANCE), (6, 256, routes.RELEVANCE), (20_000, 1, routes.RELEVANCE), (6, 2, routes.SHARED), (20_000, 1, routes.OVERVIEW)])
def test_standing_is_that_of_the_evidence(spark, corpus, monkeypatch, share, first, weights):
    """With copies, texts without tokens, emoji only and no text at all; in small and
    large corpora; from the first places of the rankings and from all of them."""
    rng = np.random.default_rng(5)
    words = "blue harbour scene best moment slow editing season two terrible theory rasp".split()
    said = [" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(60)] + ["!!", "", None, ""]
    rows = [(f"c{i:03}", said[i % len(said)], "🔥" if i % 7 == 0 else "", int(rng.integers(0, 30)), f"v{i % 5 // 2}", 0.0) for i in range(130)]
    comments = spark.createDataFrame(rows, "cid string, text string, emojis string, likes long, video_id string, valence double").persist()
    asked = spark.createDataFrame([("a", "blue harbour scene"), ("b", "what of the slow editing"), ("c", "the"), ("d", "zebra")], "question string, words string")
    members = clusters.leader_clusters(comments)
    names = ("question", "place", "corpus", "cluster_id", "support", "endorsement")
    shown = lambda df: sorted((*(r[n] for n in names), round(r.salience, 9), round(r.score, 9)) for r in df.collect())
    want = shown(clusters.evidence(comments, members, clusters.summaries(comments, members), asked, weights, 4, max_quotes=0))
    monkeypatch.setattr(clusters, "SHARE", share)
    monkeypatch.setattr(clusters, "BLOCK", 4)
    monkeypatch.setattr(clusters, "FIRST", first)
    assert shown(clusters.standing(comments, asked, weights, 4)[0]) == want and len(want) == 16


def test_tokens_cut_by_arrow(spark):
    texts = ["", "É a--B  'c' 9\n\x0bİx K", "😀", None, "  don't  ", "a , b", " , ", "a  b", "ß Å ǅ x y", "O'K\t\r\nZ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("said", F.col("t"))
    assert [r.said for r in search.tokenised(rows).collect()] == [r.a for r in rows.select(search.joined(F.col("t")).alias("a")).collect()]
