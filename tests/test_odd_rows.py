"""Queries against their SQL on tables of odd rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import key, norm

TEXTS = [
    (1, "Costs rose to $5. The rest is $7 now. It ended.\nPlain text here."),  # two dollar signs over a sentence end
    (2, "We set $x. Y$ here. Then it ends. A $$a. B$$ too."),
    (3, "One sentence. Another one. A third.\n" + "word " * 75 + "stop, and on $1; Next$ it goes."),
]
LONG = "Some words of the page's end. " * 4
PAGES = [
    (1, "http://a.org/", "<html><body><article><h1>Few.</h1><p><b>Few.<br></article><footer>" + LONG + "</footer>"),  # the body has no end
    (2, "http://a.org/", "<html><body><article><h1>Few.</h1><p>Few.</p></article><footer>" + LONG + "</footer></body></html>"),
    (3, "http://a.org/", "<html><body><p>Before.</p><article><h1>Few.</h1><p>Few.</p></article><footer>" + LONG * 12 + "</footer></body></html>"),
    (4, "http://a.org/", "<html><body><article><h2>Long.</h2><p>" + LONG * 5 + "</p>"),  # neither has an end
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for name, rows, schema in (("documents", TEXTS, "doc_id long, text string"), ("pages", PAGES, "page_id long, url string, html string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["article_roots", "web_blocks", "web_blocks_typed", "document_sentences", "readable_documents"])
def test_odd_rows(spark, tables, name):
    folder, con = tables
    df = entry.queries()[name](spark, folder)
    got = sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=key)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = sorted((tuple(map(norm, r)) for r in con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()), key=key)
    assert got and got == want
