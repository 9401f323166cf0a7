"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from sparkmere.plans import files, registry

SF = "/root/testdata/sf0.001"
NAMES = ["tokenize_docs", "scalar_functions", "build_pairs", "pair_stats", "qrels_split", "loader_lines", "synth_unpivot", "bm25_topk", "mine_negatives", "rrf_fusion", "ndcg_mrr_recall_by_slice", "clean_negatives", *files.QUERIES]


def same(df, con, sql):
    a, b = df.toPandas(), con.sql(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    plain = lambda f: sorted(repr([round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else None if v is None else str(v) for v in r]) for r in f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False))
    assert plain(a) == plain(b)


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    same(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
