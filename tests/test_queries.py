"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from textloom.plans import inventory, registry

DIR = "/root/testdata/sf0.001"
NAMES = ["dict_build", "dict_stats", "edits_explode_k2", "lookup_top_k1", "lookup_top_k2", "lookup_topk", "lookup_miss", "lookup_all", "lookup_stored", "segment_phrases", "bit_pack", "bucket_mappers", "human_bytes", "edits_explode_k1", "fuzzy_join_lev", "ef_next_geq", "rank1", "select0", "next_set_bit", "phf_assign", "lru_hits", "schema_roundtrip"]
NAMES += sorted(n for n, f in registry.QUERIES.items() if f.__module__ == inventory.__name__)


def same(df, sql, folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    want, got = c.sql(sql).df(), df.toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    want, got = (x[cols].sort_values(cols).reset_index(drop=True) for x in (want, got))
    assert len(want) == len(got)
    for k in cols:
        assert ((want[k] == got[k]) | (want[k].isna() & got[k].isna())).all(), k


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    same(registry.QUERIES[name](spark, DIR), registry.ORACLES[name], DIR)


def test_join_of_rare_words(spark, tmp_path):
    """Rare words are joined too."""
    text = " ".join(5 * ["house", "mouse", "horse", "other"] + 4 * ["mousy"])
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    near = {("house", "mouse", 1), ("house", "horse", 1), ("mouse", "horse", 2), ("mouse", "mousy", 1), ("house", "mousy", 2)}
    same = {(w, w, 0) for w in ("house", "mouse", "horse", "other", "mousy")}
    for name, k in (("fuzzy_join_lev", 2), ("symspell_dl", 1)):
        got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(same | {x for a, b, d in near if d <= k for x in ((a, b, d), (b, a, d))})


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
