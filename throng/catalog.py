"""Registered queries of the core, and their SQL."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from throng.functions import columns as C
from throng.operators import aggregates, clusters, evaluate, guard, rejects, search
from throng.plans import routes
from throng.session import stage_path, stage_table
from throng.sources import records
from throng.sources.tables import table
from throng.streaming import ingest

#: The moment from which ages in the raw records are counted.
NOW = 1_700_000_000.0
#: The registered retrieval queries hash by md5, which SQL engines have as well.
EMBEDDER = search.get_embedder("hashing-md5")
#: Terms whose mentions are counted.
TERMS = ["Brask", "Tooth Moss", "animation", "don't @ me", "rain"]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments as the exact answers see them: one row for each cid."""
    return records.corpus(table(spark, sf_dir, "comments"))


def normalised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_records").withColumn("cid", F.concat(F.lit("c"), F.col("record_no")))
    return records.normalise(raw, NOW)


def unique_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("cid", "text", "author", "likes", "published", "published_ts", "reply_count", "is_reply", "emojis", "valence")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.corpus_stats(corpus(spark, sf_dir))


def top_liked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_liked(corpus(spark, sf_dir)).select("cid", "author", "likes", "text")


def longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.longest(corpus(spark, sf_dir)).select("cid", "length", "text")


def author_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.authors(corpus(spark, sf_dir))


def top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_authors(corpus(spark, sf_dir))


def mention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mention_report(corpus(spark, sf_dir), TERMS)


def mentioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mentioning(corpus(spark, sf_dir), TERMS[1]).select("cid", "likes")


def mention_cids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mention_cids(corpus(spark, sf_dir), TERMS)


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.sentiment(corpus(spark, sf_dir))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.timeline(corpus(spark, sf_dir))


def like_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.like_distribution(corpus(spark, sf_dir))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("cid", C.excerpt(F.col("text"), 60).alias("excerpt"), C.mood(F.col("valence")).alias("mood"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.found(table(spark, sf_dir, "youtube_comments"))


def p3_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.valid(table(spark, sf_dir, "youtube_comments"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each video, by its title; the videos are a fixed table."""
    return table(spark, sf_dir, "videos").select(F.col("video_id").alias("question"), F.col("title").alias("words"))


#: Ways to ask about something, with the intent, kind and weight of consensus that each has.
SHAPES = (
    ("how many comments mention {}?", "mention_count", "AGGREGATE", False),
    ("how many people talk about the {} and what do they say", "mention_count", "HYBRID", False),
    ("what is the most liked comment about {}", "top_liked", "AGGREGATE", False),
    ("who commented the most on {}", "top_authors", "AGGREGATE", False),
    ("what do people think of {}", None, "CONSENSUS", True),
    ("any theories about {}", None, "SEMANTIC", False),
    ("sentiment breakdown for {}", "sentiment", "HYBRID", True),
    ("when were the comments on {} posted", "timeline", "AGGREGATE", False),
    ("average likes on {}", "stats", "AGGREGATE", False),
    ("longest comment on {}", "longest", "AGGREGATE", False),
    ("total number of comments on {}", "count_all", "AGGREGATE", False),
)


def _phrased(named: DataFrame, shapes: list[str]) -> DataFrame:
    """A question of each shape about each ``name``."""
    words = [F.concat(F.lit(x.split("{}")[0]), F.col("name"), F.lit(x.split("{}")[1])) for x in shapes]
    return named.select(F.explode(F.array(*words)).alias("words")).distinct()


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures that the titles of the videos are about."""
    return table(spark, sf_dir, "videos").select(F.regexp_extract("title", "^([^:]+):", 1).alias("name")).distinct()


def opinion_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two open questions about each figure."""
    shapes = [x for x, intent, _, _ in SHAPES if intent is None]
    return _phrased(figures(spark, sf_dir), shapes).select(F.col("words").alias("question"), "words")


def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of every shape about each figure and each author of a comment who
    has a plain handle."""
    authors = table(spark, sf_dir, "comments").where(F.col("author").rlike("^@[a-z0-9_]+$")).select(F.col("author").alias("name"))
    return routes.route(_phrased(figures(spark, sf_dir).unionByName(authors.distinct()), [x for x, *_ in SHAPES]))


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = corpus(spark, sf_dir).select(C.tokens(search.lexical_text()).alias("w"))
    each = words.select(F.explode("w").alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")).unionByName(words.select(F.explode(F.array_distinct("w")).alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    return each.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).select("cid", search.lexical_text().alias("document"))
    scored = search.bm25(docs, questions(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return search.best(scored, 10)


def dense_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = corpus(spark, sf_dir)
    asked = questions(spark, sf_dir)
    return search.best(search.dense(comments, search.question_vectors(comments, asked, EMBEDDER), 10, embedder=EMBEDDER), 10)


def hybrid_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(corpus(spark, sf_dir), questions(spark, sf_dir), embedder=EMBEDDER)


def fused_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).where("video_id is not null").select(F.col("video_id").alias("question"), "cid", "likes", "reply_count")
    ranks = [search.best(rows.select("question", "cid", F.col(c).alias("score")), 50) for c in ("likes", "reply_count")]
    return search.best(search.fuse(ranks, weights=[1.0, 0.5]).withColumn("score", F.round("score", 12)), 10)


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Comments, members and summaries; members keep what is read of their comments,
    so nothing is joined with the corpus again."""
    members = clusters.leader_clusters(corpus(spark, sf_dir), embedder=EMBEDDER, keep=("text", "emojis", "likes", "valence", "said"))
    comments = members.select("cid", "text", "emojis", "likes", "said")
    return comments, members, stage_table(clusters.summaries(comments, members), "cluster-summaries")


def opinion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.leader_clusters(corpus(spark, sf_dir), embedder=EMBEDDER)


def cluster_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = _clusters(spark, sf_dir)[2]
    return summary.withColumns({"valence": F.round("valence", 9), "exemplar_cids": F.array_join("exemplar_cids", " ")})


def opinion_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments, members, summary = _clusters(spark, sf_dir)
    found = clusters.evidence(comments, members, summary, opinion_questions(spark, sf_dir), embedder=EMBEDDER)
    return found.select("question", "place", "corpus", "cluster_id", "support", "endorsement", "representative_cid", *[F.round(c, 9).alias(c) for c in ("salience", "score", "support_share", "endorsement_share")], F.array_join("exemplar_cids", " ").alias("exemplar_cids"), F.array_join("quotes", " | ").alias("quotes"))


def opinion_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of all comments the evidence for each question speaks for."""
    found, comments = clusters.standing(corpus(spark, sf_dir), opinion_questions(spark, sf_dir), embedder=EMBEDDER)
    return clusters.coverage(found, comments).withColumn("coverage", F.round("coverage", 9))


def opinion_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight opinions of the overview: no question, ranked by social proof."""
    comments, members, summary = _clusters(spark, sf_dir)
    asked = spark.createDataFrame([("", "")], "question string, words string")
    return clusters.opinion_share(clusters.evidence(comments, members, summary, asked, routes.OVERVIEW, 8, max_quotes=0, embedder=EMBEDDER))


def bm25_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-precision of BM25 for the figures of the titles; relevant are comments
    whose text mentions the figure."""
    comments = corpus(spark, sf_dir)
    names = [r.name for r in figures(spark, sf_dir).orderBy("name").collect()]
    asked = spark.createDataFrame([(f, f) for f in names], "question string, words string")
    said = F.explode(F.filter(F.array(*[F.when(C.mentions(F.col("text"), F.lit(f)), F.lit(f)) for f in names]), lambda x: x.isNotNull()))
    relevant = stage_table(comments.select(said.alias("question"), "cid"), "relevant")
    scored = search.bm25(comments.select("cid", F.col("text").alias("document")), asked).withColumn("score", F.round("score", 6))
    return evaluate.r_precision(search.positions(scored, "question", F.desc("score"), F.col("cid")), relevant)


def like_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = corpus(spark, sf_dir).where("video_id is not null").select("video_id", "cid", "likes")
    best = comments.groupBy("video_id").agg(F.max("likes").alias("best"))
    return comments.join(best, "video_id").select("cid", clusters.ratio(F.col("likes").cast("double"), F.col("best").cast("double")).alias("ratio"))


def checked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement on each author: true and false figures, a comment of theirs and
    one that nobody wrote."""
    by = corpus(spark, sf_dir).where("author <> ''").groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.sum("likes").alias("l"), F.max_by("cid", F.struct("likes", "cid")).alias("best"))
    n, likes = F.col("n").cast("string"), F.col("l").cast("string")
    text = F.concat(n, F.lit(" comments ["), F.upper("best"), F.lit("] and [c99999999] , 12% more, "), likes, F.lit(" likes, 7 replies [ "), F.col("best"), F.lit(" ]."))
    told = by.select("author", text.alias("text"), F.array("best").alias("allowed_ids"), F.array(F.col("n").cast("double"), F.col("l").cast("double")).alias("allowed_numbers"))
    return guard.verify(told).select("author", "clean", F.array_join("citations", " ").alias("cited"), F.array_join("invalid", " ").alias("invalid"), F.array_join("unsupported", " ").alias("unsupported"), "grounded")


def streamed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records normalised as a stream of files, then read back."""
    path = f"{sf_dir}/raw_records.parquet"
    rows = table(spark, sf_dir, "raw_records")
    whole = os.path.isdir(path.removeprefix("file://"))
    read = spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet" if whole else "raw_records.parquet")
    raw = read.parquet(path if whole else sf_dir).withColumn("cid", F.concat(F.lit("c"), F.col("record_no")))
    out = stage_path(spark, "stream")
    ingest.append(ingest.normalised(raw, NOW), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.schema(records.COMMENT).parquet(f"{out}/rows")


QUERIES: dict = {f.__name__: f for f in (
    p3_found, p3_valid, normalised_records, unique_comments, corpus_stats, top_liked, longest, author_totals, top_authors, mention_report, mentioning, mention_cids,
    sentiment, timeline, like_distribution, excerpts, routed_questions, term_frequencies, bm25_top, dense_top, hybrid_top, fused_ranks,
    opinion_clusters, cluster_summaries, opinion_evidence, opinion_coverage, opinion_share, bm25_precision, like_ratios, checked_answers, streamed_records,
)}

_SQ = "'"


def _trim(sql: str) -> str:
    return f"regexp_replace({sql}, '^[{rejects.BLANK}]+|[{rejects.BLANK}]+$', '', 'g')"


_SENTENCE = rejects.SENTENCE.replace("?P<text>", "").replace("?P<likes>", "").replace("?P<author>", "").replace("?P<time>", "").replace(_SQ, _SQ * 2)
_P3 = f"""bare AS (SELECT line_no, regexp_replace(coalesce(merged_comment, ''), '^﻿', '') AS r FROM youtube_comments),
cut AS (SELECT line_no, r, {_trim("r")} AS t FROM bare),
field AS (SELECT line_no, r, t, {_trim("CASE WHEN regexp_matches(r, '" + rejects.ENCLOSED + "') THEN replace(r[2:-2], '\"\"', '\"') ELSE r END")} AS f FROM cut),
cell AS (SELECT *, regexp_extract(f, '{_SENTENCE}', 1) AS text, regexp_extract(f, '{_SENTENCE}', 2) AS likes, regexp_extract(f, '{_SENTENCE}', 3) AS author, regexp_extract(f, '{_SENTENCE}', 4) AS published FROM field),
told AS (SELECT line_no, text, likes, author, published, CASE
  WHEN t = '' OR regexp_matches(t, '(?s)^"[{rejects.BLANK}]*"$') THEN 'empty'
  WHEN NOT regexp_matches(r, '{rejects.RECORD}') THEN 'quoting'
  WHEN NOT regexp_matches(r, '{rejects.ENCLOSED}') AND contains(r, ',') THEN 'columns'
  WHEN NOT regexp_matches(f, '{_SENTENCE}') THEN 'shape'
  WHEN NOT regexp_matches(likes, '{rejects.LIKES}') THEN 'likes'
  WHEN NOT regexp_matches(author, '{rejects.AUTHOR}') THEN 'author'
  WHEN NOT regexp_matches(published, '{rejects.AGE}') THEN 'time' END AS reason FROM cell)"""

CORPUS = """corpus AS (SELECT cid, video_id, coalesce(text, '') AS text, coalesce(author, '') AS author, coalesce(likes, 0) AS likes, coalesce(published, '') AS published, published_ts,
  coalesce(reply_count, 0) AS reply_count, coalesce(is_reply, false) AS is_reply, coalesce(emojis, '') AS emojis, coalesce(valence, 0.0) AS valence
  FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY loaded_at DESC NULLS LAST, likes DESC NULLS LAST, reply_count DESC NULLS LAST, published DESC NULLS LAST) AS n FROM comments WHERE cid IS NOT NULL) WHERE n = 1)"""
_MOOD = f"CASE WHEN valence >= {C.POSITIVE_FROM} THEN 'positive' WHEN valence <= {C.NEGATIVE_TO} THEN 'negative' ELSE 'neutral' END"


def _count_sql(col: str) -> str:
    text = f"regexp_replace(coalesce({col}, ''), '^[{rejects.BLANK}]+|[{rejects.BLANK}]+$', '', 'g')"
    number = f"try_cast(replace(replace(regexp_extract({text}, '{C.COUNT}', 1), ',', ''), ' ', '') AS DOUBLE)"
    factor = f"CASE lower(regexp_extract({text}, '{C.COUNT}', 2)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1.0 END"
    return f"CAST(coalesce(round_even({number} * {factor}, 0), 0) AS BIGINT)"


def _known(emojis: str, known: str) -> str:
    return f"length(regexp_replace({emojis}, '[^{known}]', '', 'g'))"


def _mention_sql(term: str) -> str:
    """Whole words: no letter, digit or underscore on either side."""
    word = term.lower().replace(_SQ, _SQ * 2)
    return rf"regexp_matches(lower(text), '(?:^|[^\p{{L}}\p{{N}}_]){word}(?:$|[^\p{{L}}\p{{N}}_])')"


_EMOJIS = f"regexp_replace(regexp_replace(coalesce(text, ''), '[^{C.EMOJI}]', '', 'g'), '[\\x{{200D}}\\x{{FE0E}}\\x{{FE0F}}]', '', 'g')"
_UNITS = " ".join(f"WHEN '{u}' THEN {x}" for u, x in C.UNIT_SECONDS.items())
_NORMAL = f"""SELECT cid, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[{C.EMOJI}]', '', 'g'), '[{rejects.BLANK}]+', ' ', 'g')) AS text, coalesce(author, '') AS author,
{_count_sql("votes")} AS likes, coalesce(time, '') AS published,
{NOW} - try_cast(regexp_extract(time, '{C.AGE}', 1) AS DOUBLE) * CASE lower(regexp_extract(time, '{C.AGE}', 2)) {_UNITS} END AS published_ts,
{_count_sql("replies")} AS reply_count, coalesce(reply, '') <> '' AS is_reply, {_EMOJIS} AS emojis, CASE WHEN up + down > 0 THEN (up - down) / (up + down) ELSE 0.0 END AS valence
FROM (SELECT *, 'c' || record_no AS cid, {_known(_EMOJIS, C.POSITIVE)} AS up, {_known(_EMOJIS, C.NEGATIVE)} AS down FROM raw_records)"""

_STOP = ", ".join(f"'{w}'" for w in C.STOPWORDS)
_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9'']+')"


def _bm25_sql(document: str, question: str, words: str, source: str) -> str:
    return f"""docs AS (SELECT cid, {_TOKENS.format(document)} AS w FROM corpus), sizes AS (SELECT cid, len(w) AS l FROM docs), n AS (SELECT count(*) AS n, avg(l) AS mean FROM sizes),
asked AS (SELECT {question} AS question, term, count(*) AS qtf FROM (SELECT {question}, unnest({_TOKENS.format(words)}) AS term FROM {source}) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
words AS (SELECT cid, unnest(w) AS term FROM docs), tf AS (SELECT cid, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
idf AS (SELECT term, greatest(1e-6, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM tf, n GROUP BY term),
scored AS (SELECT question, cid, round(sum(qtf * idf * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * l / mean))), 6) AS score FROM tf JOIN asked USING (term) JOIN idf USING (term) JOIN sizes USING (cid), n GROUP BY question, cid)"""


_BM25 = _bm25_sql("text || ' ' || author", "video_id", "title", "videos")
_FIGURES = "figures AS (SELECT DISTINCT regexp_extract(title, '^([^:]+):', 1) AS f FROM videos)"
_CASES = " UNION ALL ".join(f"SELECT '{x}' AS shape, {_SQ + intent + _SQ if intent else 'NULL'} AS intent, '{kind}' AS kind, {str(heavy).lower()} AS heavy" for x, intent, kind, heavy in SHAPES)
_NAMED = """named AS (SELECT DISTINCT regexp_extract(title, '^([^:]+):', 1) AS name FROM videos UNION SELECT author FROM comments WHERE regexp_full_match(author, '@[a-z0-9_]+'))"""

# hashed vectors: words, pairs and 4-grams of each text by the first digits of their md5
_STOP_LIST = "[" + _STOP + "]"
_FEATURES = """list_concat(list_transform(w, lambda x: 'w:' || x), list_transform(range(1, len(w)), lambda i: 'b:' || w[i] || '_' || w[i + 1]), list_transform(range(1, length(array_to_string(w, ' ')) - 2), lambda i: 'c:' || substr(array_to_string(w, ' '), i, 4)))"""
_SLOT = "(('0x' || substr(md5(f), 1, 8))::UBIGINT % 512)::INT"
_SIGN = "(CASE WHEN substr(md5(f), 9, 1) >= '8' THEN 1 ELSE -1 END)"
_VECTORS = f"""said AS (SELECT cid, coalesce(video_id, '') AS corpus, likes, {_TOKENS.format("coalesce(nullif(text, ''), nullif(emojis, ''), ' ')")} AS w FROM corpus),
texts AS (SELECT row_number() OVER () AS t, w FROM (SELECT DISTINCT w FROM said)), feats AS (SELECT t, unnest({_FEATURES}) AS f FROM texts),
vec AS (SELECT t, {_SLOT} AS slot, sum({_SIGN})::BIGINT AS n FROM feats GROUP BY ALL HAVING n <> 0), norm AS (SELECT t, sum(n * n)::DOUBLE AS n2 FROM vec GROUP BY t),
own AS (SELECT cid, corpus, likes, t FROM said JOIN texts USING (w)), docs AS (SELECT count(*) AS docs FROM said)"""


def _question_vectors(source: str) -> str:
    """Unit vectors of ``question, words``, weighted by document frequency."""
    return f"""qw AS (SELECT question, list_filter({_TOKENS.format("words")}, lambda x: NOT list_contains({_STOP_LIST}, x)) AS w FROM {source}), qf AS (SELECT question, unnest({_FEATURES}) AS f FROM qw),
copies AS (SELECT t, count(*) AS c FROM own GROUP BY t), df AS (SELECT f, sum(c) AS df FROM (SELECT DISTINCT t, f FROM feats SEMI JOIN qf USING (f)) JOIN copies USING (t) GROUP BY f),
qraw AS (SELECT question, {_SLOT} AS slot, sum({_SIGN} * sqrt(ln((docs + 1) / (coalesce(df, 0) + 1)) + 1)) AS v FROM qf LEFT JOIN df USING (f), docs GROUP BY ALL),
qvec AS (SELECT question, slot, v / sqrt(sum(v * v) OVER (PARTITION BY question)) AS v FROM qraw)"""


_DENSE = """scores AS (SELECT question, t, round(sum(n * v) / sqrt(max(n2)), 9) AS score FROM vec JOIN qvec USING (slot) JOIN norm USING (t) GROUP BY question, t),
near AS (SELECT question, cid, score, place FROM (SELECT question, cid, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, cid) AS place FROM scores JOIN own USING (t)) WHERE place <= 50)"""
_ASKED_VIDEOS = "asked_of AS (SELECT video_id AS question, title AS words FROM videos)"
_ASKED_OPEN = "asked_of AS (SELECT replace(shape, '{}', name) AS question, question AS words FROM (SELECT DISTINCT regexp_extract(title, '^([^:]+):', 1) AS name FROM videos), (SELECT unnest(['" + "', '".join(x for x, intent, _, _ in SHAPES if intent is None) + "']) AS shape))"

# leader clusters: greedy in the order of likes, one comment of each corpus a step
_LEADERS = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY likes DESC, cid) AS r FROM own), apart AS (SELECT DISTINCT corpus, t FROM own),
placed AS (SELECT corpus, t, slot, n FROM apart JOIN vec USING (t)), dots AS (SELECT x.corpus, x.t AS a, y.t AS b, sum(x.n * y.n) AS dot FROM placed x JOIN placed y ON x.corpus = y.corpus AND x.slot = y.slot AND x.t <= y.t GROUP BY ALL),
close AS (SELECT corpus, a, b, dot / sqrt(na.n2 * nb.n2) AS sim FROM dots JOIN norm na ON na.t = a JOIN norm nb ON nb.t = b WHERE dot / sqrt(na.n2 * nb.n2) >= {clusters.THRESHOLD}),
alike AS (SELECT corpus, a, b, sim FROM close UNION ALL SELECT corpus, b, a, sim FROM close WHERE a <> b),
pairs AS (SELECT x.corpus, y.r AS i, x.r AS r, sim FROM ranked x JOIN alike ON alike.corpus = x.corpus AND alike.a = x.t JOIN ranked y ON y.corpus = x.corpus AND y.t = alike.b AND y.r < x.r),
earlier AS (SELECT corpus, r, list(i) AS js FROM pairs GROUP BY ALL), sizes_of AS (SELECT corpus, max(r) AS n FROM ranked GROUP BY corpus),
step(corpus, r, leads) AS (SELECT corpus, 0::BIGINT, []::BIGINT[] FROM sizes_of UNION ALL SELECT s.corpus, s.r + 1, CASE WHEN list_has_any(s.leads, coalesce(e.js, [])) THEN s.leads ELSE list_append(s.leads, s.r + 1) END FROM step s JOIN sizes_of z ON z.corpus = s.corpus AND s.r < z.n LEFT JOIN earlier e ON e.corpus = s.corpus AND e.r = s.r + 1),
leads AS (SELECT corpus, unnest(leads) AS r, generate_subscripts(leads, 1) - 1 AS cluster_id FROM step JOIN sizes_of USING (corpus) WHERE step.r = n),
joined AS (SELECT p.corpus, p.r, arg_max(i, (sim, -i)) AS lead FROM pairs p JOIN leads l ON l.corpus = p.corpus AND l.r = p.i WHERE NOT EXISTS (SELECT 1 FROM leads k WHERE k.corpus = p.corpus AND k.r = p.r) GROUP BY ALL),
member AS (SELECT m.cid, m.t, m.corpus, l.cluster_id, h.cid AS leader FROM (SELECT corpus, r, lead FROM joined UNION ALL SELECT corpus, r, r FROM leads) j JOIN ranked m ON m.corpus = j.corpus AND m.r = j.r JOIN leads l ON l.corpus = j.corpus AND l.r = j.lead JOIN ranked h ON h.corpus = j.corpus AND h.r = j.lead)"""
# the steps look up what was computed once
_VECTORS, _LEADERS = (re.sub(r"\b(\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", x) for x in (_VECTORS, _LEADERS))
_SAID = "CASE WHEN text <> '' THEN text ELSE emojis END"
_SUMMARY = f"""full_rows AS (SELECT m.*, c.likes, c.valence, c.text, {_SAID} AS shown, row_number() OVER (PARTITION BY m.corpus, cluster_id ORDER BY c.likes DESC, cid) AS place FROM member m JOIN corpus c USING (cid)),
cluster AS (SELECT corpus, cluster_id, corpus || '#' || lpad(cluster_id::VARCHAR, 12, '0') AS key, count(*) AS support, sum(likes)::BIGINT AS endorsement, avg(valence) AS valence, max(leader) AS representative_cid, max(shown) FILTER (cid = leader) AS representative_text, list(cid ORDER BY place) FILTER (place <= 5) AS exemplar_cids FROM full_rows GROUP BY ALL)"""


def _evidence_sql(limit: int, weights: tuple[float, float, float]) -> str:
    """The best clusters of each question of ``asked_of``."""
    g, a, b = weights
    ratio = lambda x: f"{x} / max({x}) OVER (PARTITION BY question)"
    return f"""term_of AS (SELECT question, term, count(*) AS qtf FROM (SELECT question, unnest(w) AS term FROM qw) GROUP BY ALL),
kw AS (SELECT corpus || '#' || lpad(cluster_id::VARCHAR, 12, '0') AS key, {_TOKENS.format("text")} AS w FROM full_rows), klen AS (SELECT key, sum(len(w)) AS l FROM kw GROUP BY key), kn AS (SELECT count(*) AS n, avg(l) AS mean FROM klen),
ktf AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(w) AS term FROM kw) WHERE term IN (SELECT term FROM term_of) GROUP BY ALL), kidf AS (SELECT term, greatest(1e-6, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM ktf, kn GROUP BY term),
lexical AS (SELECT question, key, round(sum(qtf * idf * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * l / mean))), 9) AS score FROM ktf JOIN term_of USING (term) JOIN kidf USING (term) JOIN klen USING (key), kn GROUP BY question, key),
mean_of AS (SELECT key, slot, sum(n / sqrt(n2)) AS v FROM (SELECT corpus || '#' || lpad(cluster_id::VARCHAR, 12, '0') AS key, t FROM member) JOIN vec USING (t) JOIN norm USING (t) GROUP BY ALL), size_of AS (SELECT key, sqrt(sum(v * v)) AS size FROM mean_of GROUP BY key),
central AS (SELECT question, key, round(sum(m.v * q.v) / max(size), 9) AS score FROM mean_of m JOIN qvec q USING (slot) JOIN size_of USING (key) GROUP BY question, key HAVING score > 0),
parts AS (SELECT question, key, 1 / (10 + row_number() OVER (PARTITION BY question ORDER BY score DESC, key)) AS p FROM lexical UNION ALL SELECT question, key, 1 / (10 + row_number() OVER (PARTITION BY question ORDER BY score DESC, key)) FROM central),
rrf AS (SELECT question, key, sum(p) AS fused FROM parts GROUP BY ALL),
salient AS (SELECT question, cluster.*, CASE WHEN len(w) = 0 THEN 1.0 ELSE coalesce(coalesce(fused, 0) / (max(fused) OVER (PARTITION BY question)), 1.0) END AS salience, ln(support + 1) / (SELECT max(ln(support + 1)) FROM cluster) AS s, CASE WHEN (SELECT max(endorsement) FROM cluster) > 0 THEN ln(endorsement + 1) / (SELECT max(ln(endorsement + 1)) FROM cluster) ELSE 1 END AS e FROM qw CROSS JOIN cluster LEFT JOIN rrf USING (question, key)),
scored_all AS (SELECT *, ((1 - {g}) + {g} * salience) * (1 + {a} * s + {b} * e) AS score FROM salient),
evidence AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, key) AS place FROM scored_all) WHERE place <= {limit})"""


_OPEN = f"WITH RECURSIVE {CORPUS}, {_VECTORS}, {_LEADERS}, {_SUMMARY}, {_ASKED_OPEN.replace('question AS words', 'replace(shape, ' + _SQ + '{}' + _SQ + ', name) AS words')}, {_question_vectors('asked_of')}, {_evidence_sql(6, routes.RELEVANCE)}"

SQL: dict = {
    "p3_found": f"WITH {_P3} SELECT line_no, reason FROM told WHERE reason IS NOT NULL",
    "p3_valid": f"""WITH {_P3} SELECT line_no, text, CAST(round_even(CAST(regexp_replace(likes, '[,KMBkmb]', '', 'g') AS DOUBLE) *
  CASE lower(right(likes, 1)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END, 0) AS BIGINT) AS likes, author, published FROM told WHERE reason IS NULL""",
    "normalised_records": _NORMAL,
    "unique_comments": f"WITH {CORPUS} SELECT * EXCLUDE (video_id) FROM corpus",
    "corpus_stats": f"""WITH {CORPUS} SELECT count(*) AS comments, coalesce(sum(likes), 0)::BIGINT AS total_likes, coalesce(avg(likes), 0.0) AS mean_likes, coalesce(median(likes), 0.0) AS median_likes,
  coalesce(max(likes), 0) AS max_likes, coalesce(avg(length(text)), 0.0) AS mean_length, CASE WHEN sum(likes) > 0 THEN max(likes) / sum(likes) ELSE 0.0 END AS top_comment_like_share FROM corpus""",
    "top_liked": f"WITH {CORPUS} SELECT cid, author, likes, text FROM corpus ORDER BY likes DESC, cid LIMIT 5",
    "longest": f"WITH {CORPUS} SELECT cid, length(text) AS length, text FROM corpus ORDER BY length(text) DESC, cid LIMIT 5",
    "author_totals": f"WITH {CORPUS} SELECT author, count(*) AS comments, sum(likes)::BIGINT AS likes FROM corpus WHERE author <> '' GROUP BY author",
    "top_authors": f"WITH {CORPUS} SELECT author, count(*) AS comments, sum(likes)::BIGINT AS likes FROM corpus WHERE author <> '' GROUP BY author ORDER BY comments DESC, likes DESC, author LIMIT 5",
    "mention_report": f"WITH {CORPUS} " + " UNION ALL ".join(
        f"SELECT '{t.replace(_SQ, _SQ * 2)}' AS term, count(*) FILTER ({_mention_sql(t)}) AS count, count(*) FILTER ({_mention_sql(t)}) / greatest(1, count(*)) AS share, coalesce(sum(likes) FILTER ({_mention_sql(t)}), 0)::BIGINT AS likes FROM corpus" for t in TERMS
    ),
    "mentioning": f"WITH {CORPUS} SELECT cid, likes FROM corpus WHERE {_mention_sql(TERMS[1])}",
    "sentiment": f"WITH {CORPUS} SELECT " + ", ".join(f"count(*) FILTER ({_MOOD} = '{m}') AS {m}, coalesce(sum(likes) FILTER ({_MOOD} = '{m}'), 0)::BIGINT AS like_weighted_{m}" for m in ("positive", "negative", "neutral")) + " FROM corpus",
    "timeline": f"""WITH {CORPUS}, ends AS (SELECT min(published_ts) AS oldest, greatest(max(published_ts) - min(published_ts), 1e-6) / 6 AS width FROM corpus),
  frame AS (SELECT range AS bucket, oldest + range * width AS s, oldest + (range + 1) * width AS e FROM range(6), ends),
  placed AS (SELECT CASE WHEN published_ts IS NULL THEN 5 ELSE least(5, floor((published_ts - oldest) / width)) END AS bucket, likes FROM corpus, ends),
  counts AS (SELECT bucket, count(*) AS n, sum(likes) AS l FROM placed GROUP BY bucket),
  labels AS (SELECT bucket, arg_min(published, (-published_ts, cid)) AS label FROM frame JOIN corpus ON published_ts BETWEEN s AND e AND published <> '' GROUP BY bucket)
  SELECT f.bucket, coalesce(label, 'bucket ' || (f.bucket + 1)) AS label, coalesce(n, 0) AS count, coalesce(l, 0)::BIGINT AS likes, s AS start, e AS "end" FROM frame f LEFT JOIN counts USING (bucket) LEFT JOIN labels USING (bucket)""",
    "like_distribution": f"""WITH {CORPUS}, x AS (SELECT log10(likes + 1) AS x FROM corpus), e AS (SELECT min(x) AS low, CASE WHEN max(x) > min(x) THEN max(x) ELSE min(x) + 1 END AS high FROM x),
  n AS (SELECT least(23, floor((x - low) / ((high - low) / 24)))::BIGINT AS bin, count(*) AS n FROM x, e GROUP BY 1)
  SELECT range AS bin, low + range * ((high - low) / 24) AS start, coalesce(n, 0) AS comments FROM range(24) JOIN e ON true LEFT JOIN n ON n.bin = range""",
    "excerpts": f"""WITH {CORPUS}, flat AS (SELECT cid, valence, trim(regexp_replace(text, '[{rejects.BLANK}]+', ' ', 'g')) AS t FROM corpus)
  SELECT cid, CASE WHEN length(t) > 60 THEN substring(t, 1, 59) || '…' ELSE t END AS excerpt, {_MOOD} AS mood FROM flat""",
    "routed_questions": f"""WITH {_NAMED}, shapes AS ({_CASES}) SELECT replace(shape, '{{}}', name) AS words, intent, kind, CASE WHEN intent = 'mention_count' THEN lower(name) ELSE '' END AS term,
  CASE WHEN heavy THEN 0.25 ELSE 0.6 END::DOUBLE AS salience_weight, CASE WHEN heavy THEN 0.4 ELSE 0.2 END::DOUBLE AS support_weight, CASE WHEN heavy THEN 0.35 ELSE 0.2 END::DOUBLE AS endorsement_weight FROM named, shapes""",
    "term_frequencies": f"""WITH {CORPUS}, w AS (SELECT cid, unnest({_TOKENS.format("text || ' ' || author")}) AS term FROM corpus) SELECT term, count(*) AS tf, count(DISTINCT cid) AS df FROM w GROUP BY term""",
    "bm25_top": f"WITH {CORPUS}, {_BM25} SELECT question, cid, score, place FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, cid) AS place FROM scored) WHERE place <= 10",
    "fused_ranks": f"""WITH {CORPUS}, a AS (SELECT video_id, cid, row_number() OVER (PARTITION BY video_id ORDER BY likes DESC, cid) AS p, row_number() OVER (PARTITION BY video_id ORDER BY reply_count DESC, cid) AS q FROM corpus WHERE video_id IS NOT NULL),
  f AS (SELECT video_id AS question, cid, round(CASE WHEN p <= 50 THEN 1.0::DOUBLE / (60 + p) ELSE 0 END + CASE WHEN q <= 50 THEN 0.5::DOUBLE / (60 + q) ELSE 0 END, 12) AS score FROM a WHERE p <= 50 OR q <= 50)
  SELECT question, cid, score, place FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, cid) AS place FROM f) WHERE place <= 10""",
    "dense_top": f"WITH {CORPUS}, {_VECTORS}, {_ASKED_VIDEOS}, {_question_vectors('asked_of')}, {_DENSE} SELECT question, cid, score, place FROM near WHERE place <= 10",
    "hybrid_top": f"""WITH {CORPUS}, {_VECTORS}, {_ASKED_VIDEOS}, {_question_vectors('asked_of')}, {_DENSE}, {_bm25_sql("text || ' ' || author", "video_id", "title", "videos").replace(", 6) AS score", ", 9) AS score").replace("docs AS (", "lexdocs AS (").replace("FROM docs)", "FROM lexdocs)")},
  lexical AS (SELECT question, cid, row_number() OVER (PARTITION BY question ORDER BY score DESC, cid) AS place FROM scored),
  fused AS (SELECT question, cid, round(sum(1 / (60 + place)), 12) AS score FROM (SELECT question, cid, place FROM lexical WHERE place <= 50 UNION ALL SELECT question, cid, place FROM near) GROUP BY ALL)
  SELECT question, cid, score, place FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, cid) AS place FROM fused) WHERE place <= 10""",
    "opinion_clusters": f"WITH RECURSIVE {CORPUS}, {_VECTORS}, {_LEADERS} SELECT cid, corpus, cluster_id, leader FROM member",
    "cluster_summaries": f"WITH RECURSIVE {CORPUS}, {_VECTORS}, {_LEADERS}, {_SUMMARY} SELECT corpus, cluster_id, support, endorsement, round(valence, 9) AS valence, representative_cid, representative_text, array_to_string(exemplar_cids, ' ') AS exemplar_cids FROM cluster",
    "opinion_evidence": f"""{_OPEN}, sims AS (SELECT question, t, round(sum(n * v) / sqrt(max(n2)), 9) AS sim FROM vec JOIN qvec USING (slot) JOIN norm USING (t) WHERE t IN (SELECT t FROM full_rows WHERE place <= 5) GROUP BY ALL),
  placed_quotes AS (SELECT e.question, e.key, f.shown, row_number() OVER (PARTITION BY e.question, e.key ORDER BY coalesce(sim, 0) DESC, f.cid) AS q FROM evidence e JOIN full_rows f ON f.corpus = e.corpus AND f.cluster_id = e.cluster_id AND f.place <= 5 LEFT JOIN sims s ON s.question = e.question AND s.t = f.t),
  quoted AS (SELECT question, key, string_agg(shown, ' | ' ORDER BY q) AS quotes FROM placed_quotes WHERE q <= 3 AND shown <> '' GROUP BY ALL)
  SELECT question, place, corpus, cluster_id, support, endorsement, representative_cid, round(salience, 9) AS salience, round(score, 9) AS score, round(support / (SELECT count(*) FROM corpus), 9) AS support_share, round(endorsement / (SELECT greatest(1, sum(likes)) FROM corpus), 9) AS endorsement_share,
  array_to_string(exemplar_cids, ' ') AS exemplar_cids, coalesce(quotes, representative_text, '') AS quotes FROM evidence LEFT JOIN quoted USING (question, key)""",
    "opinion_coverage": f"{_OPEN} SELECT question, round(sum(support) / (SELECT count(*) FROM corpus), 9) AS coverage FROM evidence GROUP BY question",
    "opinion_share": f"""WITH RECURSIVE {CORPUS}, {_VECTORS}, {_LEADERS}, {_SUMMARY}, most AS (SELECT max(ln(support + 1)) AS s, max(ln(endorsement + 1)) AS e FROM cluster),
  shown AS (SELECT *, row_number() OVER (ORDER BY round(1 + 0.55 * ln(support + 1) / s + 0.45 * ln(endorsement + 1) / e, 9) DESC, key) AS place, trim(regexp_replace(representative_text, '[{rejects.BLANK}]+', ' ', 'g')) AS label FROM cluster, most)
  SELECT '' AS question, place, CASE WHEN coalesce(representative_text, '') = '' THEN '(emoji only)' WHEN length(label) > 52 THEN substring(label, 1, 51) || '…' ELSE label END AS label, round(100 * support / (SELECT count(*) FROM corpus), 4) AS people, round(100 * endorsement / (SELECT sum(likes) FROM corpus), 4) AS likes FROM shown WHERE place <= 8""",
    "mention_cids": f"WITH {CORPUS} " + " UNION ALL ".join(f"SELECT '{t.replace(_SQ, _SQ * 2)}' AS term, cid, row_number() OVER (ORDER BY length(cid), cid) AS place FROM corpus WHERE {_mention_sql(t)}" for t in TERMS),
    "bm25_precision": f"""WITH {CORPUS}, {_FIGURES}, {_bm25_sql("text", "f", "f", "figures")}, said AS (SELECT cid, lower(text) AS t, ' ' || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g') || ' ' AS bare FROM corpus),
  named AS (SELECT f, lower(f) AS low, ' ' || regexp_replace(lower(f), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g') || ' ' AS bare FROM figures),
  relevant AS (SELECT f AS question, cid FROM said JOIN named ON contains(t, low) AND contains(said.bare, named.bare)), budget AS (SELECT question, count(*) AS r FROM relevant GROUP BY question),
  placed AS (SELECT question, cid, row_number() OVER (PARTITION BY question ORDER BY score DESC, cid) AS place FROM scored), hits AS (SELECT count(*) AS correct FROM placed JOIN budget USING (question) JOIN relevant USING (question, cid) WHERE place <= r)
  SELECT correct, (SELECT sum(r) FROM budget)::BIGINT AS total, correct / (SELECT sum(r) FROM budget) AS precision FROM hits""",
    "like_ratios": f"WITH {CORPUS} SELECT cid, CASE WHEN max(likes) OVER (PARTITION BY video_id) <= 0 THEN 1.0 ELSE likes / max(likes) OVER (PARTITION BY video_id) END::DOUBLE AS ratio FROM corpus WHERE video_id IS NOT NULL",
    "checked_answers": f"""WITH {CORPUS}, b AS (SELECT author, count(*) AS n, sum(likes)::BIGINT AS l, arg_max(cid, (likes, cid)) AS best FROM corpus WHERE author <> '' GROUP BY author),
  near AS (SELECT *, least(abs(n - 12), abs(l - 12)) <= 1 AS twelve, least(abs(n - 7), abs(l - 7)) <= 0.51 AS seven FROM b)
  SELECT author, n || ' comments [' || upper(best) || '] and, 12% more, ' || l || ' likes, 7 replies [ ' || best || ' ].' AS clean, best AS cited, 'c99999999' AS invalid, concat_ws(' ', CASE WHEN NOT twelve THEN '12%' END, CASE WHEN NOT seven THEN '7 replies' END) AS unsupported, false AS grounded FROM near""",
    "streamed_records": _NORMAL,
}
