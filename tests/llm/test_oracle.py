"""The SQL of the queries gives what the brute-force versions give (those are
what the Spark tests compare with, too)."""

import duckdb
import pytest

from cases import SF
from filelens.llm import oracle
from test_bagminhash import brute as classes
from test_va_topk import brute as topk


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_near_duplicates(con):
    got = con.sql(oracle.NEAR_DUPLICATES).fetchall()
    want = classes(con.sql("SELECT doc_id, text FROM documents").fetchall())
    assert {r[0]: r[1] for r in got} == want and sum(r[3] for r in got) == len(set(want.values()))


def test_top_k(con):
    rows = con.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    assert set(con.sql(oracle.TOP_K).fetchall()) == topk(rows, 20, lambda q: q % 20 == 0)


def test_url_filter():
    c = duckdb.connect()
    c.execute("""CREATE TABLE pages AS SELECT * FROM (VALUES
        (1, 'http://Shop.com/x#t', '<link rel="canonical" href="http://shop.com/y">'), (2, 'https://SHOP.com/y', ''),
        (3, 'http://a.net/1', '<link href="http://shop.com/y" rel=canonical>'),
        (4, 'http://b.org/fr/x', '<link href="https://c.com" rel=canonical>'), (5, 'https://c.com/', ''),
        (6, null, null), (7, 'none', '')) t(page_id, url, html)""")
    got = {r[0]: (r[3], r[4]) for r in c.sql(oracle.URL_FILTER).fetchall()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: ("net/", "block"), 4: ("org/fr/", "allow"),
                   5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow")}
