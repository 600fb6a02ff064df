from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cases import SF, WORD, awkward, awkward_rows, nothing
from filelens.llm import quality_mcd as Q


def brute_stats(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def brute_verdicts(rows):
    """kept per (text, lang, source), with the estimates in numpy."""
    stats = [brute_stats(t) for t, _, _ in rows]
    failed = [s[0] < 10 or 100 * s[4] > 20 * s[0] for s in stats]
    x = np.array([[np.log(max(s[1], 1) / max(s[0], 1)), *(np.sqrt(s[i] / max(s[0], 1)) for i in (2, 3, 4))] for s in stats])
    keys = [[(lang, src), (lang,), ()] for _, lang, src in rows]
    low = lambda v, p: np.sort(v)[int(np.ceil(p * len(v))) - 1]
    n = np.array([max(s[0], 1) for s in stats], float)

    def distance(v, words, c, cov):  # each row in its own scatter: the group's and its noise
        own = cov + np.array([np.diag(Q.NOISE) / w for w in words])
        return np.einsum("ij,ij->i", v - c, np.linalg.solve(own, (v - c)[..., None])[..., 0])

    rows_of = {}
    for i, (ks, f) in enumerate(zip(keys, failed)):
        for k in () if f else ks:
            rows_of.setdefault(k, []).append(i)
    models, logs = {}, {}
    for g, at in rows_of.items():
        if len(at) >= Q.MIN_GROUP:
            c = np.array([low(x[at, j], .5) for j in range(4)])
            s = np.array([low(np.abs(x[at, j] - c[j]), .5) for j in range(4)])
            models[g] = c, np.diag((1.4826 * s) ** 2 + Q.GUARD ** 2)
    for _ in range(Q.MOST_STEPS):  # all groups until the last one settles
        moved = 0.0
        for g, (c, cov) in models.items():
            d = distance(x[rows_of[g]], n[rows_of[g]], c, cov)
            h = x[rows_of[g]][d <= low(d, Q.SUPPORT)]
            c = h.mean(0)
            cov = (h.T @ h / len(h) - np.outer(c, c)) * Q._consistency(Q.SUPPORT)
            cov[np.diag_indices(4)] = np.maximum(np.diag(cov), 0) + Q.GUARD ** 2
            log = np.linalg.slogdet(cov)[1]
            moved = max(moved, logs.get(g, np.inf) - log)
            if log < logs.get(g, np.inf):
                models[g], logs[g] = (c, cov), log
        if moved <= Q.SETTLED:
            break
    out = []
    for i, ks in enumerate(keys):
        m = next((models[k] for k in ks if k in models), None)
        d = 0 if m is None else distance(x[i:i + 1], n[i:i + 1], *m)[0]
        out.append(not failed[i] and d <= Q.CUTOFF)
    return stats, failed, out


def test_query_against_numpy(spark):
    from filelens.llm.registry import QUERIES

    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    stats, failed, kept = brute_verdicts([(r.text, r.lang, r.source) for r in docs])
    got = {r.doc_id: r for r in QUERIES["op6_quality_rules"](spark, sf).collect()}
    assert len(got) == len(docs)
    for r, s, f, k in zip(docs, stats, failed, kept):
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == s
        assert (g.base_failed, g.kept) == (f, k)
    assert any(not k and not f for k, f in zip(kept, failed))  # outliers that the base rules let pass


def test_clean_documents_stay(spark):
    sf = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    rows = got.groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) == 0 and n[0, False] > n.get((0, True), 0) * 0.5


def planted(text, feature):
    """``text`` made an outlier of one feature that the base rules let pass."""
    w = WORD.findall(text)
    if feature == "symbols":  # two in every twelve words
        return " ".join(" ".join(w[i:i + 12]) + " # |" for i in range(0, len(w), 12))
    if feature == "length":
        return " ".join(x + x[:max(1, round(0.6 * len(x)))] for x in w)
    if feature == "lines":  # a line of two words after every twelve
        return "\n".join(" ".join(w[i:i + 12]) + "\nread more" for i in range(0, len(w), 12))
    return text + " " + " ".join(w[:int(0.09 * len(w))])  # the first words once more


def test_planted_outliers_of_every_feature_go(spark):
    sf = SF.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    clean = sorted(docs.join(good, "doc_id").collect(), key=lambda r: r.doc_id)
    usual = [r for r in clean if 150 <= brute_stats(r.text)[0] <= 600 and not brute_stats(r.text)[4]][:40]
    long = [(r.text, r) for r in clean if len(r.text) > 10_000 and brute_stats(r.text)[0] >= 2200
            and 50 * brute_stats(r.text)[4] <= brute_stats(r.text)[0]]
    assert len(long) >= 10
    rows = [(f"{f}-{i}", planted(r.text, f), r.lang, r.source)
            for f in ("symbols", "length", "lines") for i, r in enumerate(usual)]
    rows += [(f"words-{i}", planted(t, "words"), r.lang, r.source) for i, (t, r) in enumerate(long)]
    more = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    got = Q.judge(docs.withColumn("doc_id", F.col("doc_id").cast("string")).unionByName(more))
    seen = {}
    for r in got.where("doc_id like '%-%'").collect():
        seen.setdefault(r.doc_id.split("-")[0], []).append((r.base_failed, r.kept))
    for feature, verdicts in seen.items():
        assert sum(not k for _, k in verdicts) >= 0.9 * len(verdicts), feature
        if feature in ("symbols", "length"):
            assert not any(f for f, _ in verdicts), feature  # the distance alone decides
    # the others stay as they were
    lost = got.join(good.select(F.col("doc_id").cast("string")), "doc_id").where("not base_failed and not kept")
    assert lost.count() == 0


def test_awkward_tables(spark):
    df = awkward(spark)
    got = Q.judge(df).collect()
    assert len(got) == df.count()
    want = {r[0]: brute_stats(r[1]) for r in awkward_rows() if r[0] is not None}
    assert all(tuple(r.stats) == want[r.doc_id] for r in got if r.doc_id is not None)
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    rows = awkward_rows()
    _, _, keep = brute_verdicts([r[1:4] for r in rows])
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r, k in zip(rows, keep) if k)
    assert Q.judge(nothing(spark)).count() == 0 and Q.keep_good(nothing(spark)).count() == 0


def test_columns_named_like_helpers(spark):
    helpers = ["mcd_distance", "mcd_kept", "_p", "_p0", "_g0", "mcd_group", "mcd_part", "mcd_best", "quality_stats", "g", "n"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    clashing = docs.select("*", *[F.concat(F.lit(h), "doc_id").alias(h) for h in helpers])
    got = Q.keep_good(clashing)
    assert got.columns == clashing.columns
    rows = got.drop("text").collect()
    assert rows and all(r[h] == f"{h}{r.doc_id}" for r in rows for h in helpers)
    plain = {r.doc_id: (r.kept, r.mcd_distance) for r in Q.judge(docs).collect()}
    assert {r.doc_id for r in rows} == {k for k, v in plain.items() if v[0]}
    judged = Q.judge(clashing)
    assert {r.doc_id: r.kept for r in judged.collect()} == {k: v[0] for k, v in plain.items()}
    assert judged.where(F.col("_p0") != F.concat(F.lit("_p0"), "doc_id")).count() == 0
