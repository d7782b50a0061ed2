import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: float("%.10g" % v) if isinstance(v, float) else v
    return sorted(columns), sorted(repr([plain(r[k]) for k in order]) for r in records)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_smoke_query(spark):
    assert entry.entry(spark).count() == 1


def test_library_works_without_the_optional_parts(monkeypatch):
    import importlib

    for name in [n for n in sys.modules if n.startswith("blockloom.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("blockloom.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    import blockloom

    monkeypatch.delattr(blockloom, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    try:
        assert "pipeline_gray" in importlib.reload(entry).queries()
        assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
        assert entry.oracle_sql().keys() <= entry.queries().keys()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
