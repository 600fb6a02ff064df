import corpus_pipeline as P
from cases import awkward, nothing
from test_bagminhash import brute as classes
from test_concat_pack import check as check_pieces
from test_quality_mcd import brute_verdicts
from test_source_mix import brute_targets
from test_winnow import W

from cases import SF, WORD


def test_stages_against_brute_force(spark):
    """Every stage on what the stage before it kept."""
    import duckdb

    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(P.STAGES)
    rows = docs.collect()
    kept = stage["quality"](spark, docs, sf).cache()
    _, _, want = brute_verdicts([(r.text, r.lang, r.source) for r in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r, k in zip(rows, want) if k)

    lines = stage["line_dedup"](spark, kept, sf).cache()
    con = duckdb.connect()
    con.register("documents", kept.toPandas())
    want = {i: t for i, t, _ in con.sql(W.ORACLE).fetchall() if WORD.search(t or "")}
    got = lines.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)

    near = stage["near_dedup"](spark, lines, sf).cache()
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(classes(list(want.items())).values()))

    mixed = stage["mix"](spark, near, sf).cache()
    size, taken = {}, {}
    for r in near.collect():
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text))
    longest = max(len(WORD.findall(r.text)) for r in near.collect())
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall(r.text))
    for s, t in brute_targets(size).items():
        assert abs(taken.get(s, 0) - t) <= longest / 2 + 1

    pieces = stage["pack"](spark, mixed, sf)
    check_pieces(pieces.collect(), [r.text for r in mixed.collect()])
    for a, b in ((docs, kept), (kept, lines), (lines, near), (near, mixed)):
        assert a.columns == b.columns


def test_run_and_awkward_tables(spark, tmp_path):
    for name, df in (("odd", awkward(spark)), ("none", nothing(spark))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = P.run(spark, f"{tmp_path}/{name}")
        assert (out.count() == 0) == (name == "none")
