"""The driver contract, with and without the text subpackage."""

import importlib
import os
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_names():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(names) > 20


def test_core_never_imports_text_operators():
    code = "import sys; from throng import catalog; import throng.cli; print([m for m in sys.modules if m.startswith('throng.llm')])"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "[]"


def test_entry_without_text_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("throng.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "throng.llm", None)
    monkeypatch.delattr("throng.llm", raising=False)
    try:
        assert "p2_found" not in importlib.reload(__spark_entry__).queries()
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_flagship(spark):
    assert __spark_entry__.entry(spark).first().comments > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["corpus_stats", "mention_report", "timeline", "bm25_top", "bm25_precision", "routed_questions", "dense_top", "opinion_evidence", "mention_cids", "checked_answers", "p3_found", "p3_valid"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cells = lambda df: sorted(tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert cells(got) == cells(want)
