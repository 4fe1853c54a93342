"""Normalising, reading, writing and rejecting records."""

import json

import pytest
from pyspark.sql import functions as F

from throng import cli
from throng.functions import columns as C
from throng.operators import rejects
from throng.sources import records
from throng.streaming import ingest

NOW = 1_700_000_000.0


def values(spark, expr, cells, kind="string"):
    df = spark.createDataFrame([(c,) for c in cells], f"x {kind}")
    return [r.y for r in df.select(expr(F.col("x")).alias("y")).collect()]


def test_counts(spark):
    cells = ["7", "1,234", "1.2K", "3.4m", "2B", " 5 ", "", None, "abc", "1.2.3", "1,5K", "0.5", "1.5", "2.5", "-3", "9" * 30, "1e3", "5 K"]
    assert values(spark, C.parse_count, cells) == [7, 1234, 1200, 3_400_000, 2_000_000_000, 5, 0, 0, 0, 0, 15000, 0, 2, 2, 0, 2**63 - 1, 0, 5000]


def test_emoji(spark):
    cells = ["so good 🔥🔥", "🔥", "plain", None, "a👍b", "x ❤️ y", "👩‍🚀"]
    assert values(spark, C.prose, cells) == ["so good", "", "plain", "", "ab", "x y", ""]
    assert values(spark, C.emoji_of, cells) == ["🔥🔥", "🔥", "", "", "👍", "❤", "👩🚀"]
    assert values(spark, C.valence, ["🔥🔥", "🔥💀", "💀", "🚗", "", None]) == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0]


def test_ages(spark):
    got = values(spark, lambda c: C.published_at(c, NOW), ["8 hours ago", "1 day ago (edited)", "x", "", None, "Streamed 2 weeks ago"])
    assert got == [NOW - 8 * 3600, NOW - 86400, None, None, None, NOW - 2 * 604800]


def test_excerpt_and_tokens(spark):
    assert values(spark, lambda c: C.excerpt(c, 5), ["a  b", "abcdef", None]) == ["a b", "abcd…", ""]
    assert values(spark, C.query_tokens, ["What do people think of IT'S end?", None]) == [["it's", "end"], []]


def test_from_records(spark):
    rows = records.from_records(spark, [{"text": "Hi 🔥", "votes": "1.2K", "author": "@a", "time": "2 days ago", "reply": True}, {}], NOW).orderBy("cid").collect()
    assert (rows[0].cid, rows[0].text, rows[0].likes, rows[0].emojis, rows[0].is_reply) == ("c0", "Hi", 1200, "🔥", True)
    assert (rows[1].text, rows[1].likes, rows[1].published_ts, rows[1].author) == ("", 0, None, "")
    with pytest.raises(ValueError):
        records.from_records(spark, [], NOW)


def test_csv_with_names(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿ Comment Text ,text,Votes,user_id,Published\n"first, with ""quotes""",,"1,200",@a,1 hour ago\n"two\nlines",x,3K,@b,\n', encoding="utf-8")
    rows = records.from_csv(spark, str(path), NOW).orderBy("cid").collect()
    assert [(r.cid, r.text, r.likes, r.author) for r in rows] == [("c0", 'first, with "quotes"', 1200, "@a"), ("c1", "x", 3000, "@b")]
    with pytest.raises(FileNotFoundError):
        records.from_csv(spark, str(tmp_path / "none.csv"), NOW)


def test_csv_of_one_column(spark, tmp_path):
    path = tmp_path / "m.csv"
    say = "comment is '{}' with likes= {} with user_id '@u' and published(time) '1 day ago'"
    path.write_text("Merged Comment\n" + "\n".join(f'"{x}"' for x in (say.format("it's 'so' good", "2K"), "nonsense", say.format("second", "4"))) + "\n")
    rows = records.from_csv(spark, str(path), NOW).orderBy("cid").collect()
    assert [(r.cid, r.text, r.likes) for r in rows] == [("c0", "it's 'so' good", 2000), ("c1", "second", 4)]


def test_round_trips(spark, corpus, tmp_path):
    records.to_csv(corpus, str(tmp_path / "out"))
    back = records.from_csv(spark, str(tmp_path / "out"), NOW)
    assert back.count() == 11 and back.agg(F.sum("likes")).first()[0] == 3142
    assert {r.cid: r.emojis for r in back.collect()}["c3"] == "🔥"
    records.save(corpus, str(tmp_path / "index"), 512)
    assert records.load(spark, str(tmp_path / "index"), 512).count() == 11
    with pytest.raises(ValueError):
        records.load(spark, str(tmp_path / "index"), 256)
    with pytest.raises(FileNotFoundError):
        records.load(spark, str(tmp_path / "nothing"), 512)


def test_json_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"cid": "c0", "text": "a", "likes": 3}\n\n{"cid": "c1", "text": "b", "likes": 4}\n')
    assert [r.likes for r in records.from_jsonl(spark, str(tmp_path / "c.jsonl")).orderBy("cid").collect()] == [3, 4]


def test_last_row_of_a_cid_counts(spark):
    rows = [("c0", "a", None, 1), ("c0", "a", 5, 2), (None, "b", 1, 1), ("c1", None, 2, None)]
    got = {r.cid: r for r in records.corpus(spark.createDataFrame(rows, "cid string, text string, likes long, loaded_at long")).collect()}
    assert got["c0"].likes == 5 and got["c1"].text == "" and len(got) == 2


def test_fetched_pages(spark):
    got = records.from_pages(spark, lambda page: [{"text": f"p{page}", "votes": 10 + page}], 3, NOW).orderBy("cid").collect()
    assert [(r.cid, r.text, r.likes) for r in got] == [("c0", "p0", 10), ("c1", "p1", 11), ("c2", "p2", 12)]
    assert records.from_pages(spark, lambda page: [{"text": "x"}] * 9, 1, NOW, limit=0).count() == 1
    with pytest.raises(ValueError):
        records.from_pages(spark, lambda page: [], 2, NOW)


def test_numbered_keeps_order(spark):
    df = spark.range(100, numPartitions=7)
    assert all(r.id == r.position for r in records.numbered(df).collect())


SAY = "comment is '{}' with likes= {} with user_id '{}' and published(time) '{}'"
GOOD = SAY.format("hi", "3", "@a", "1 day ago")
RECORDS = [
    (None, "empty"),
    ("", "empty"),
    (" \t ", "empty"),
    ('"  "', "empty"),
    ("﻿", "empty"),
    (GOOD, None),
    (f'"{GOOD}"', None),
    (f"﻿  {GOOD}  ", None),
    (f'"{SAY.format('she said ""yes"", a\nb', "1,234", "@a", "2 weeks ago (edited)")}"', None),
    (SAY.format(GOOD, "9", "@b", "1 year ago"), None),
    (SAY.format("no\nquotes", "9", "@b", "1 year ago"), None),
    (f'"{GOOD}', "quoting"),
    (f'"{GOOD}" ', "quoting"),
    ('say "x"', "quoting"),
    (SAY.format("one, two", "9", "@b", "1 year ago"), "columns"),
    (f'"{GOOD}",x', "columns"),
    ('"a",b\nc', "columns"),
    ('b\nc,"a"', "columns"),
    ("Merged Comment", "shape"),
    (GOOD + " more", "shape"),
    (SAY.format("hi", "1e3", "@a", "1 day ago"), "likes"),
    (f'"{SAY.format("hi", "12,34", "x", "now")}"', "likes"),
    (SAY.format("hi", "1.5", "@a", "1 day ago"), "likes"),
    (SAY.format("hi", "1.5k", "a b", "1 day ago"), "author"),
    (SAY.format("hi", "5", "@a b", "1 day ago"), "author"),
    (SAY.format("hi", "5", "@", "1 day ago"), "author"),
    (SAY.format("hi", "5", "@a", "yesterday"), "time"),
    (SAY.format("x" * 300_000, "5", "@a", "1 day"), "time"),
]


def test_rejects(spark):
    df = spark.createDataFrame([(i, r, "clash") for i, (r, _) in enumerate(RECORDS)], "line_no long, merged_comment string, reason string").repartition(3)
    got = {r.line_no: r for r in rejects.parse_records(df).collect()}
    assert [got[i].reason for i in range(len(RECORDS))] == [x for _, x in RECORDS]
    assert got[8].text == 'she said "yes", a\nb' and got[8].likes == 1234
    assert got[9].text == GOOD and got[10].text == "no\nquotes"
    assert rejects.found(df).count() + rejects.valid(df).count() == len(RECORDS)
    assert rejects.found(df.limit(0)).count() == 0


def test_likes_of_any_size(spark):
    df = spark.createDataFrame([(i, SAY.format("t", n, "@a", "1 day ago")) for i, n in enumerate(["99999999999999999999", "1.25K", "3B", "9007199254740993"])], "line_no long, merged_comment string")
    assert [r.likes for r in rejects.valid(df).orderBy("line_no").collect()] == [2**63 - 1, 1250, 3_000_000_000, 9007199254740993]


def test_stream(spark, tmp_path):
    raw = spark.createDataFrame([("c0", "a 🔥", "3 hours ago", "1K"), ("c1", None, "3 hours ago", None)], "cid string, text string, time string, votes string")
    raw.write.parquet(str(tmp_path / "in"))
    stream = ingest.normalised(ingest.read_raw(spark, str(tmp_path / "in"), raw.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")), NOW)
    ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.cid: r.likes for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"c0": 1000, "c1": 0}
    hours = ingest.hourly_counts(ingest.normalised(ingest.read_raw(spark, str(tmp_path / "in"), "cid string, text string, time string, votes string"), NOW))
    q = hours.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").first().comments == 2


def test_command_line(spark, corpus, tmp_path, capsys):
    records.to_csv(corpus, str(tmp_path / "csv"))
    index = str(tmp_path / "index")
    assert cli.main(["--index", index, "build", "--csv", str(tmp_path / "csv")]) == 0
    assert cli.main(["--index", index, "--json", "ask", "how many comments are there"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["exact"]["comments"] == 11
    assert cli.main(["--index", str(tmp_path / "none"), "ask", "x"]) == 1
