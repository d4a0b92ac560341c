"""Queries over documents without text, without an id or with an id twice, and with signs at the start of a text, next to their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import key, norm

TEXTS = [
    (0, None), (1, ""), (2, "  \n "), (3, "- a b"), (4, ". . ."), (5, "—dash : x"), (6, " x y"), (7, "a\x0bb c"), (8, "Abstract: abstract: x"), (9, "Summary"),
    (10, "one"), (10, "two"), (10, "one"), (None, "no id"), (None, "no id either"), (None, None), (-7, "below zero"), (11, "😀😀 more than thirty characters of a text"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["abstracts_rebuilt", "plans_parsed"])
def test_odd_documents(spark, tables, name):
    folder, con = tables
    df = entry.queries()[name](spark, folder)
    got = sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=key)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = sorted((tuple(map(norm, r)) for r in con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()), key=key)
    assert got and got == want
