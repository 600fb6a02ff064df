import duckdb

from cases import SF, awkward, nothing, sentence
from filelens.llm import winnow as W


def parity(docs, df):
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.sql(W.ORACLE).df()
    got = W.dedup(df).select("doc_id", "text", "n_deleted_lines").toPandas()
    rows = lambda d: sorted(zip(d.doc_id, d.text.where(d.text.notna(), None), d.n_deleted_lines), key=repr)
    assert rows(got) == rows(want)
    return got


def test_query_against_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = parity(docs.toPandas()[["doc_id", "text"]], docs)
    assert got.n_deleted_lines.sum() > 0


def test_runs_extend_both_ways(spark):
    a, b, c, d = (sentence(i, 20) for i in range(20, 24))
    docs = [(1, f"{a}\n{b}\n{c}\nx"), (2, f"{b}\n{c}\n{d}"), (3, f"q\n{a}\n\n{b}\n{c}\nx\nz"), (4, f"{b}\n{c}"),
            (5, f"{b}\n{c}\n{d}\nnew"), (6, "\n".join([sentence(30, 60)] * 3)), (7, ""), (8, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in W.dedup(df).collect()}
    # 1 and 3 share a run over a blank line; 2 and 5 share one whose middle
    # came first in 1; 40 words in 4 are too few
    assert got == {1: docs[0][1], 2: docs[1][1], 3: "q\n\nz", 4: docs[3][1], 5: "new", 6: sentence(30, 60), 7: "", 8: None}
    parity(df.toPandas(), df)


def lines(spark, docs):
    return W.lines_of(spark.createDataFrame([(i, i, t) for i, t in enumerate(docs)], "k long, doc_id long, text string"))


def test_fingerprints_are_window_minima(spark):
    texts = ["\n".join(sentence(100 * d + i, 5 + 7 * i % 23) for i in range(120)) for d in range(3)] + [sentence(9, 49)]
    rows = lines(spark, texts)
    by_doc = {}
    for r in rows.orderBy("k", "pos").collect():
        by_doc.setdefault(r.k, []).append((r.h.a, r.pos, r.words))
    want = set()
    for k, ls in by_doc.items():
        for i in range(len(ls)):
            for j in range(i, len(ls)):
                if sum(x[2] for x in ls[i:j + 1]) >= W.MIN_WORDS:
                    a, pos, _ = min(ls[i:j + 1])
                    want.add((k, pos, a))
                    break
    got = [tuple(r) for r in W.fingerprints(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(got) < sum(map(len, by_doc.values())) * 2 / 3  # minima, not every line


def test_only_repeated_fingerprints_are_extended(spark):
    run = "\n".join(sentence(700 + i, 10) for i in range(7))
    texts = ["\n".join(sentence(800 + i, 10) for i in range(30)), f"{sentence(1, 20)}\n{run}\n{sentence(2, 20)}",
             f"{run}\n{sentence(3, 90)}"]
    rows = lines(spark, texts)
    positions = W.repeated_positions(W.fingerprints(rows))
    assert {r.k for r in positions.collect()} == {1, 2}
    windows = W.extensions(rows, positions).collect()
    assert {r.k for r in windows} == {1, 2}  # text without a common fingerprint is done with
    assert {(r.k, r.n) for r in W.repeated_lines(rows).collect()} == {(2, n) for n in range(1, 8)}


def test_random_runs_against_sql(spark):
    import random

    rng = random.Random(5)
    pool = [sentence(40 + i, rng.choice([1, 3, 9, 12, 25, 49, 50, 60])) for i in range(12)] + ["", " "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert parity(df.toPandas(), df).n_deleted_lines.sum() > 100


def test_columns_named_like_helpers(spark):
    df = spark.createDataFrame([(1, sentence(1, 60), 7, 1, "a", True), (2, sentence(1, 60) + "\nx", 8, 2, "b", False)],
                               "doc_id long, text string, n_deleted_lines long, winnow_count int, winnow_gone string, k boolean")
    got = [tuple(r) for r in W.drop_repeats(df).orderBy("doc_id").collect()]
    assert got == [(1, sentence(1, 60), 7, 1, "a", True), (2, "x", 8, 2, "b", False)]
    assert [r.n_deleted_lines for r in W.dedup(df).orderBy("doc_id").collect()] == [0, 1]


def test_main_path_is_native(spark):
    plan = W.dedup(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_awkward_tables(spark):
    df = awkward(spark)
    got = W.drop_repeats(df)
    assert got.columns == df.columns
    rows = got.collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert 6 not in by and by[0].text is None and by[1].text == "" and by[2].text == "  \n\t "
    assert by[9].text == "x\ny" and by[9].n_chars == 3 and by[10].n_chars == len(by[10].text)
    assert sum(r.doc_id == 5 for r in rows) == 1 and sum(r.doc_id is None for r in rows) == 2
    assert W.drop_repeats(nothing(spark)).count() == 0
