"""Queries against their SQL twins at the smallest scale; the checker does the rest at sf0.01."""
import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from patchlens.plans.bindings import Tables

QUICK = ["delta_signature", "defect_score", "candidate_scores", "hunk_pairs", "token_vector64", "vector_topk",
         "tfidf_transform", "hybrid_gate", "cap_per_group", "issue_report", "dataset_stats", "stratified_split",
         "class_report", "stream_caps"]


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, folder, name):
    df = entry.queries()[name](spark, folder)
    assert compare(df.collect(), df.columns, duck.execute(entry.oracle_sql()[name])) is None


@pytest.mark.parametrize("name", ["ranked_candidates", "classify_ladder"])
def test_pairs_without_a_before_text_are_kept(spark, duck, folder, name):
    df = entry.queries()[name](spark, folder)
    rows = df.collect()
    assert compare(rows, df.columns, duck.execute(entry.oracle_sql()[name])) is None
    pairs = Tables(spark, folder).pairs().select("pair_id", "before").collect()
    assert any(p["before"] is None for p in pairs)
    assert sorted(r["pair_id"] for r in rows) == sorted(p["pair_id"] for p in pairs)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_token_vector120_gives_every_share(spark, duck, folder):
    df = entry.queries()["token_vector120"](spark, folder)
    rows = df.collect()
    assert compare(rows, df.columns, duck.execute(entry.oracle_sql()["token_vector120"])) is None
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], {})[r["slot"]] = r["value"]
    # the shares of a text are those of all 120 numbers, the structural ones among them
    assert all(abs(sum(v.values()) - 1) < 1e-4 and {0, 39, 105, 106, 107, 108} <= set(v) for v in of.values())
    assert {18, 19, 89} <= {r["slot"] for r in rows}
