import duckdb
from pyspark.sql import functions as F

from cases import SF
from filelens.llm import warc_fixity as M

LEAF = "archive long, slot long, offset long, length long, digest string"


def leaves(n, change=()):
    return [(i // 1024, i % 1024, 10 * i, 10, f"d{i}" if i not in change else "bad") for i in range(n)]


def test_query_against_sql(spark):
    from filelens.llm.registry import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cols = ["archive", "slot", "page_id", "begin", "end", "status", "expected", "found"]
    want = {tuple(r) for r in con.sql(ORACLE["op5_warc_fixity"]).select(*[f'"{c}"' for c in cols]).fetchall()}
    got = QUERIES["op5_warc_fixity"](spark, SF)
    assert {tuple(r) for r in got.select(*cols).collect()} == want and len(want) > 0


def test_locates_damage_only(spark):
    good = spark.createDataFrame(leaves(3000), LEAF)
    bad = spark.createDataFrame([r for r in leaves(3000, {5, 1500}) if r[2] != 20000] + [(2, 1000, 0, 10, "new")], LEAF)
    got = {(r.archive, r.slot): r.status for r in M.audit(good, bad).collect()}
    assert got == {(0, 5): "changed", (1, 1500 - 1024): "changed", (1, 2000 - 1024): "missing", (2, 1000): "extra"}
    assert M.audit(good, good).count() == 0


def test_descends_only_into_differing_branches(spark):
    good, bad = spark.createDataFrame(leaves(2048), LEAF), spark.createDataFrame(leaves(2048, {700}), LEAF)
    a, b = M.tree(good), M.tree(bad)
    assert [x.count() for x in a] == [2048, 128, 8, 2]
    assert [M._differing(x, y).count() for x, y in zip(a, b)] == [1, 1, 1, 1]
    root = M._differing(a[-1], b[-1]).first()
    assert (root.begin_a, root.end_a) == (0, 10240)


def test_awkward_pages(spark):
    rows = [(1, "u", "x" * 500_000, "a"), (1, "u", "x" * 500_000, "a"), (None, None, None, None), (2, "u", "", "b"),
            (5, "é", "ünï", "c"), (11, "u", "half", "d"), (13, "u", "lost", "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, status string")
    got = {r.page_id: r.status for r in M.audit_pages(df).collect()}
    assert got.keys() == {5, 11, 13} and got[11] == "truncated" and got[13] == "missing"
    m = M.page_replicas(df).orderBy("offset").collect()
    assert [r.offset for r in m] == [sum(x.length for x in m[:i]) for i in range(len(m))]
    assert M.audit_pages(df.where(F.lit(False))).count() == 0


def test_whole_records_at_other_offsets(spark):
    rows = leaves(2048)
    good = spark.createDataFrame(rows, LEAF)
    # from record 1020 on, three bytes lie between the records before and after
    shifted = spark.createDataFrame([(a, s, o + 3 * (1020 <= i < 1024), n, d) for i, (a, s, o, n, d) in enumerate(rows)], LEAF)
    got = [(r.archive, r.slot, r.begin, r.status, r.expected == r.found) for r in M.audit(good, shifted).collect()]
    assert sorted(got) == [(0, s, 10 * s, "moved", True) for s in range(1020, 1024)]
    # the roots tell it
    assert [r.archive for r in M._differing(M.tree(good)[-1], M.tree(shifted)[-1]).collect()] == [0]


def test_second_replica_has_its_own_offsets(spark):
    df = spark.createDataFrame([(i, "u", "x" * i) for i in range(10, 16)], "page_id long, url string, html string")
    both = M.page_replicas(df)  # 11 is cut in half, 13 is lost
    rows = both.orderBy("slot").collect()
    assert [r.offset_b for r in rows] == [sum(x.length_b or 0 for x in rows[:i]) for i in range(len(rows))]
    got = {r.page_id: r.status for r in M.audit_replicas(both).collect()}
    assert got == {11: "truncated", 12: "moved", 13: "missing", 14: "moved", 15: "moved"}
