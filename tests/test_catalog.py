"""Each catalog query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from semloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def clean(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NA or v != v:
        return "NULL"
    return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else repr(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(clean, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    wanted = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


def test_all_have_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_a_passage_is_found_wherever_it_stands(spark, tmp_path):
    """Against brute force: ids that no residue brings together, and a passage behind the first 400 characters."""
    item = "alpha beta gamma delta epsilon zeta"
    texts = {1: "other words " * 60 + item, 2: "short text with " + item, 3: "nothing in common", 4: None, 5: ""}
    items = {7: item, 48: "y" * 250 + " short"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    jaccard, quote = {}, {}
    for d, t in texts.items():
        for b, u in items.items():
            w, v = set((t or "").split()), set(u.split())
            if w & v:
                jaccard[d, b] = round(len(w & v) / len(w | v), 6)
                quote[d, b] = 1.0 if len(t.split()) <= 60 and len(v) >= 5 and len(w & v) / len(v) >= 0.9 else jaccard[d, b]
    for name, wanted in (("token_jaccard", jaccard), ("quote_score", quote)):
        assert {(r.doc_id, r.item_id): r.score for r in catalog.queries()[name](spark, str(tmp_path)).collect()} == wanted
    assert (1, 7) in jaccard and quote[2, 7] == 1.0
