import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from cases import SF, awkward, awkward_rows, nothing
from filelens.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    """rows: (text, lang, source); Python integers throughout."""
    count, docs, groups = Counter(), Counter(), set()
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in rows):
        groups.add((lang, source))
        terms = TERM.findall(lower(text))
        count.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang in {g for g, _ in groups}:
        sources = sorted(s for g, s in groups if g == lang)
        kept = [t for (g, t), n in docs.items() if g == lang and n >= 3]
        size = {s: sum(count[lang, s, t] for t in kept) for s in sources}

        def prop(n, whole):
            return 1 + 10 ** 9 * (n + 1) // (whole + len(kept))

        p = {s: {t: prop(count[lang, s, t], size[s]) for t in kept} for s in sources}
        q = {t: prop(sum(count[lang, s, t] for s in sources), sum(size.values())) for t in kept}
        for s in sources:
            found = defaultdict(list)
            for o in sources:
                if o != s:
                    found["pair"].append((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o))
            for t in kept:
                if count[lang, s, t] and p[s][t] > q[t]:
                    found["term"].append((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t))
            for part, items in found.items():
                for rank, (v, _, item) in enumerate(sorted(items), 1):
                    if part == "pair" or rank <= 200:
                        out.add((lang, s, part, item, -v, rank))
    return out


def result(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_awkward_tables(spark, monkeypatch):
    want = brute([(r[1], r[2], r[3]) for r in awkward_rows()])
    assert result(D.audit(awkward(spark))) == want
    monkeypatch.setattr(D, "SHARD_CELLS", 7)   # many shards, many term blocks
    assert result(D.audit(awkward(spark))) == want
    assert D.audit(nothing(spark)).count() == 0


def test_partial_counts_survive_any_bound(spark, monkeypatch):
    import pyarrow as pa

    rows = [("a b A é" * (i % 4), "en", "s%d" % (i % 3)) for i in range(40)] + [(None, None, None), ("\x00x\x7fy", "", None)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("text", "lang", "source"), r)) for r in rows])

    def total():
        n = Counter()
        for b in D._partial(iter([batch, batch.slice(0, 0)])):
            for r in b.to_pylist():
                n[r["lang"], r["source"], r["term"]] += r["n"]
        return n

    want = total()
    for limit in (1, 3, 10):
        monkeypatch.setattr(D, "PARTIAL_ROWS", limit)
        monkeypatch.setattr(D, "SLICE_BYTES", 16)
        assert total() == want
    assert want["", "", "x"] == want["", "", "y"] == 1 and want["en", "s0", None] == 0


def test_proportions_are_exact():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 9 * 10 ** 15, 2000)
    n = (size * rng.random(2000)).astype(np.int64)
    assert D.proportion(n, size, 17).tolist() == [1 + 10 ** 9 * (int(a) + 1) // (int(b) + 17) for a, b in zip(n, size)]


def test_query_sql_and_brute_force(spark):
    from filelens.llm import registry

    got = result(registry.op12_divergence(spark, SF))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = con.sql("SELECT text, lang, source FROM documents").fetchall()
    assert got == set(con.sql(D.ORACLE).fetchall()) == brute(rows)
