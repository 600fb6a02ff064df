"""Repair of conversations whose turns are out of structure.

The role initials of a sound conversation are ``(s?(ua)+)?``. Every row's first
fault is found (blank, duplicate, truncated), and the cheapest edits that give
such a conversation (keep, relabel, delete, insert) are shortest paths over an
integer-cost lattice, found by the auction algorithm of :mod:`lattice`.

All rows are sorted once over the whole table and numbered. Runs of at most
``RUN_ROWS`` consecutive rows of a conversation are solved as one lattice each,
many in one Arrow batch. A conversation of several runs (a hot one has very
many) is joined by distances: each run gives the distances between its role
states, an exclusive scan from the end gives every run the distances that are
left at its exit, and a scan from the start the state in which it is entered.
The scans work in groups of ``FAN`` and then over the groups, so no task holds
a conversation. A repaired conversation of many runs is hashed as a stream;
only its audit, which the result holds, grows with it.

Defined cases: a null role or text is one space, so such a text is blank;
rows with a null turn come first; rows of one turn are ordered by role and
text; rows without a conversation id are one conversation; a role is judged by
its first letter; other columns are ignored; an empty table gives an empty
result. A conversation all of whose rows are deleted is empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelens.operators.common import materialized

from . import lattice as L
from .common import col

RUN_ROWS = 64      # consecutive rows of a conversation solved as one lattice
LANES = 2048       # lattices advanced together
FAN = 1024         # runs, or groups of them, that one scan step holds
SPACES = " \t\n\x0b\f\r"
ROLES = {"u": "user", "a": "assistant"}


def _key(c: Column) -> Column:
    """A conversation's key: text that also tells a null id from others."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that a hash of
    ``conv_id:turn`` deals out: rows dropped, emptied, without sentence ends,
    twice, or with the role of the user."""
    key = F.concat_ws(":", *[F.coalesce(col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(F.encode(key, "UTF-8")) % 20
    role, text = (F.coalesce(col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    made = rows.select(
        col("conv_id"), col("turn"), F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        fault.alias("fault")).where("fault > 0")
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))) \
        .drop("fault", "copy")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, pos): the rows in order, numbered through the
    whole table without holes. Written."""
    named = rows.select(_key(col("conv_id")).alias("conv"), col("turn"),
                        *[F.coalesce(col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    # the last key splits a very common row over partitions
    put = materialized(named.orderBy("conv", F.col("turn").asc_nulls_first(), "role", "text", F.monotonically_increasing_id())
                       .withColumn("mid", F.monotonically_increasing_id()), "turns")
    part = F.shiftright("mid", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition
    bases = put.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")) \
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return put.withColumn("part", part).join(F.broadcast(bases), "part").select(
        "conv", "turn", "role", "text",
        (F.col("base") + F.col("mid") - F.shiftleft(F.col("part"), 33)).alias("pos"))


def judged(turns: DataFrame) -> DataFrame:
    """(conv, turn, pos, initial, fault) of every row. Written."""
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    first = F.substring("role", 1, 1)
    marks = turns.select("conv", "turn", "pos", F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"),
                         (said == "").alias("blank"), (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"),
                         F.unhex(content).alias("content"))
    twice = marks.groupBy("conv", "content").agg(F.min("pos").alias("seen"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").select("conv", "content", "seen")
    found = marks.join(twice, ["conv", "content"], "left")
    return materialized(found.select("conv", "turn", "pos", "initial", F.when(F.col("blank"), "blank").when(
        F.col("pos") > F.col("seen"), "duplicate").when(F.col("cut"), "truncated").alias("fault")), "turn-faults")


def runs_of(marks: DataFrame) -> DataFrame:
    """(conv, run, first, letters, initials, last, many): runs of rows as
    letters. A run holds ``RUN_ROWS`` at most. Written."""
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "-") \
        .when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    rows = marks.select("conv", F.floor(F.col("pos") / RUN_ROWS).alias("run"), "pos", letter.alias("letter"), "initial")
    runs = rows.groupBy("conv", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "letter", "initial"))).alias("r"))
    ends = runs.groupBy("conv").agg(F.max("run").alias("end"), F.min("run").alias("begin"))
    return materialized(runs.join(ends, "conv").select(
        "conv", "run", F.col("r")[0]["pos"].alias("first"), F.array_join("r.letter", "").alias("letters"),
        F.array_join("r.initial", "").alias("initials"), (F.col("run") == F.col("end")).alias("last"),
        (F.col("begin") < F.col("end")).alias("many")), "turn-runs")


def _lanes(batch: pa.RecordBatch):
    for at in range(0, len(batch), LANES):
        yield batch.slice(at, LANES)


def _distances(batches):
    for b in batches:
        for s in _lanes(b):
            d = L.transfer(s.column("letters").to_pylist()).reshape(-1, L.STATES ** 2)
            yield pa.RecordBatch.from_arrays([s.column("conv"), s.column("run"), pa.array(d.tolist(), pa.list_(pa.int64()))],
                                             ["conv", "run", "value"])


def _through(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    return np.minimum((d[:, :, None] + e[None, :, :]).min(1), L.INF)


class _ToGo:
    """Scan from the end: distances left at each run's exit."""

    start = L.END.tolist()
    backward = True

    @staticmethod
    def step(state, value):
        d = np.array(value, np.int64).reshape(L.STATES, L.STATES)
        return np.minimum((d + np.array(state, np.int64)).min(1), L.INF).tolist()

    @staticmethod
    def merge(values):
        out = np.array(values[0], np.int64).reshape(L.STATES, L.STATES)
        for v in values[1:]:
            out = _through(out, np.array(v, np.int64).reshape(L.STATES, L.STATES))
        return out.reshape(-1).tolist()


class _Entry:
    """Scan from the start: the state in which each run is entered. A run is
    given as its exit state by entry state."""

    start = [L.EMPTY]
    backward = False

    @staticmethod
    def step(state, value):
        return [value[state[0]]]

    @staticmethod
    def merge(values):
        out = list(values[0])
        for v in values[1:]:
            out = [v[q] for q in out]
        return out


def scan(runs: DataFrame, kind, fan: int | None = None) -> DataFrame:
    """(conv, run, state): the state before each run of ``runs`` (conv, run,
    value) in the scan's direction, within its conversation. Groups of ``fan``
    consecutive runs are merged, the groups scanned in turn, and then each
    group from its own state."""
    fan = fan or FAN
    grouped = materialized(runs.select("conv", "run", "value", F.floor(F.col("run") / fan).alias("up")), "scan-runs")
    state_type, value_type = "state array<bigint>", "value array<bigint>"

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("run")
        return pa.table({"conv": t["conv"][:1], "run": t["up"][:1],
                         "value": pa.array([kind.merge(t["value"].to_pylist())], pa.list_(pa.int64()))})

    def spread(t: pa.Table) -> pa.Table:
        t = t.sort_by([("run", "descending" if kind.backward else "ascending")])
        state, out = t["state"][0].as_py(), []
        for v in t["value"].to_pylist():
            out.append(state)
            state = kind.step(state, v)
        return pa.table({"conv": t["conv"], "run": t["run"], "state": pa.array(out, pa.list_(pa.int64()))})

    several = grouped.groupBy("conv").agg(F.countDistinct("up").alias("n")).where("n > 1").limit(1).count() > 0
    start = F.array(*[F.lit(int(x)).cast("bigint") for x in kind.start])
    if several:
        above = scan(grouped.groupBy("conv", "up").applyInArrow(merge, f"conv string, run bigint, {value_type}"), kind, fan)
        given = grouped.join(above.withColumnRenamed("run", "up"), ["conv", "up"])
    else:
        given = grouped.withColumn("state", start)
    return given.groupBy("conv", "up").applyInArrow(spread, f"conv string, run bigint, {state_type}")


_SOLVED = "conv string, run bigint, first bigint, entry int, leave int, cost bigint, audit string"


def _solve(batches):
    """The audit of each run from its entry states: all of them if it is one
    of many of its conversation."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    names = ["conv", "run", "first", "entry", "leave", "cost", "audit"]
    for b in batches:
        for s in _lanes(b):
            entries = [range(L.STATES) if e is None else [e] for e in s.column("entry").to_pylist()]
            row = np.repeat(np.arange(len(s)), [len(e) for e in entries])
            entry = np.array([q for e in entries for q in e], np.int64)
            runs = s.column("letters").to_pylist()
            last = s.column("last").to_numpy(False)[row]
            left = np.array(s.column("state").to_pylist(), np.int64)[row]
            # inserts after the last row are part of its run
            left = np.where(last[:, None], np.array([0, L.INF, L.INF, 0]), left)
            lat = L.Lattices([runs[i] for i in row], entry, left, last)
            audit, leave = lat.trace()
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(s.column(c).take(take).cast(t) for c, t in zip(names[:3], types)), pa.array(entry, pa.int32()),
                 pa.array(leave, pa.int32()), pa.array(lat.lengths()), pa.array(audit)], names)


def solved(runs: DataFrame) -> DataFrame:
    """(conv, run, first, entry, cost, audit): the least cheapest edits, run by run;
    ``cost`` is what is left from the run's entry on. Written."""
    many = runs.where("many")
    whole = runs.where("not many").withColumn("state", F.array(*[F.lit(int(x)).cast("bigint") for x in L.END])) \
        .withColumn("entry", F.lit(L.EMPTY)).select("conv", "run", "first", "letters", "last", "state", "entry")
    distances = many.select("conv", "run", "letters").mapInArrow(_distances, "conv string, run bigint, value array<bigint>")
    parts = many.join(scan(distances, _ToGo), ["conv", "run"]).withColumn("entry", F.lit(None).cast("int")) \
        .select("conv", "run", "first", "letters", "last", "state", "entry")
    ways = materialized(parts.mapInArrow(_solve, _SOLVED), "turn-ways")
    exits = ways.groupBy("conv", "run").agg(
        F.sort_array(F.collect_list(F.struct("entry", "leave")))["leave"].cast("array<bigint>").alias("value"))
    taken = scan(exits, _Entry).select("conv", "run", F.col("state")[0].cast("int").alias("entry"))
    chosen = ways.join(taken, ["conv", "run", "entry"])
    return materialized(chosen.unionByName(whole.mapInArrow(_solve, _SOLVED))
                        .select("conv", "run", "first", "entry", "cost", "audit"), "turn-edits")


def _apply(batches):
    """Audits as edits per row: the roles inserted before it, what becomes of
    it, and the roles inserted after the last one."""
    grow = {L.EMPTY: "u", L.SYSTEM: "u", L.USER: "a", L.ASSISTANT: "u"}
    after = {"u": L.USER, "a": L.ASSISTANT, "s": L.SYSTEM}
    for b in batches:
        rows = []
        for audit, letters, entry in zip(*(b.column(c).to_pylist() for c in ("audit", "letters", "entry"))):
            state, before, act, waiting, k = entry, [], [], "", 0
            for e in audit:
                role = letters[k].lower() if e == "K" else grow[state]
                if e != "D":
                    state = after[role]
                if e == "I":
                    waiting += role
                    continue
                before.append(waiting)
                act.append({"K": "", "D": "-"}.get(e, role))
                waiting, k = "", k + 1
            rows.append((before, act, waiting))
        text = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), b.column("run"), b.column("first"), *(pa.array([r[i] for r in rows], t)
                                                                     for i, t in enumerate((text, text, pa.string())))],
            ["conv", "run", "first", "before", "act", "behind"])


def _inserted(initials: Column) -> Column:
    """Turns without text of the given initials."""
    return F.transform(F.filter(F.split(initials, ""), lambda x: x != ""), lambda x: F.struct(
        _role(x).alias("role"), F.lit("").alias("text")))


def _role(initial: Column) -> Column:
    out = F.when(F.lit(False), "")
    for i, name in ROLES.items():
        out = out.when(initial == i, name)
    return out


def repaired(turns: DataFrame, runs: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, run, turns): the repaired turns (role, text) of each run, in
    order. A run holds a bounded number of rows."""
    todo = edits.join(runs.select("conv", "run", "letters"), ["conv", "run"])
    rowwise = todo.select("conv", "run", "first", "audit", "letters", "entry").mapInArrow(
        _apply, "conv string, run bigint, first bigint, before array<string>, act array<string>, behind string")
    rows = turns.withColumn("run", F.floor(F.col("pos") / RUN_ROWS)).join(rowwise, ["conv", "run"])
    k = (F.col("pos") - F.col("first") + 1).cast("int")
    act, none = F.element_at("act", k), F.array().cast("array<struct<role:string,text:string>>")
    own = F.array(F.struct(F.when(act == "", F.col("role")).otherwise(_role(act)).alias("role"), F.col("text")))
    lines = F.concat(_inserted(F.element_at("before", k)), F.when(act == "-", none).otherwise(own),
                     F.when(k == F.size("act"), _inserted(F.col("behind"))).otherwise(none))
    return rows.select("conv", "run", F.struct("pos", lines.alias("lines")).alias("r")).groupBy("conv", "run").agg(
        F.flatten(F.sort_array(F.collect_list("r"))["lines"]).alias("turns"))


def _stream_hash(batches):
    """SHA-256 over the parts of each conversation, which arrive in order; the
    parts that have turns are joined by newlines."""
    conv = digest = None
    some = False
    for b in batches:
        keys, out = [], []
        for c, n, body in zip(*(b.column(x).to_pylist() for x in ("conv", "n", "body"))):
            if c != conv:
                if conv is not None:
                    keys.append(conv)
                    out.append(digest.hexdigest())
                conv, digest, some = c, hashlib.sha256(), False
            if n:
                digest.update(("\n" + body if some else body).encode())
                some = True
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(out)], ["conv", "hash"])
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], ["conv", "hash"])


def digests(parts: DataFrame, runs: DataFrame) -> DataFrame:
    """(conv, hash): SHA-256 of each conversation's ``role:text`` lines."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    bodies = parts.join(runs.select("conv", "run", "many"), ["conv", "run"]) \
        .select("conv", "run", "many", F.size("turns").alias("n"), F.array_join(lines, "\n").alias("body"))
    done = materialized(bodies.select(
        "conv", "run", "many", "n", F.when(~F.col("many"), F.sha2("body", 256)).alias("hash"),
        F.when(F.col("many"), F.col("body")).alias("body")), "repaired")
    long = done.where("many").select("conv", "run", "n", "body").repartition("conv") \
        .sortWithinPartitions("conv", "run").select("conv", "n", "body").mapInArrow(_stream_hash, "conv string, hash string")
    return done.where("not many").select("conv", "hash").unionByName(long)


class Repair:
    """The repair of one table of turns (conv_id, turn, role, text)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.turns = ordered(rows)
        self.marks = judged(self.turns)
        self.runs = runs_of(self.marks)
        self.edits = solved(self.runs)

    def repaired(self) -> DataFrame:
        """(conv, run, turns) of every run, in order within a conversation."""
        return repaired(self.turns, self.runs, self.edits)

    def report(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
        repaired_sha256) per conversation."""
        faults = [F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")]
        span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
        facts = self.marks.groupBy("conv").agg(
            F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[F.coalesce(f, F.lit(0)).alias(n) for f, n in
                                                                    zip(faults, ("blank", "duplicate", "truncated"))])
        # rows beside each other, the last row of the run before included
        before = self.runs.select("conv", (F.col("run") + 1).alias("run"), F.substring("initials", -1, 1).alias("prev"))
        all_initials = F.concat(F.coalesce("prev", F.lit("")), F.col("initials"))
        sound = F.regexp_count(all_initials, F.lit("s(?=u)|u(?=a)|a(?=u)"))
        illegal = self.runs.join(before, ["conv", "run"], "left").groupBy("conv").agg(
            F.sum(F.length(all_initials) - 1 - sound).cast("long").alias("illegal"))
        pieces = F.sort_array(F.collect_list(F.struct("run", "audit", "cost")))
        audit = self.edits.groupBy("conv").agg(pieces.alias("p")).select(
            "conv", F.col("p")[0]["cost"].alias("cost"), F.array_join("p.audit", "").alias("audit"))
        hashes = digests(self.repaired(), self.runs).withColumnRenamed("hash", "repaired_sha256")
        return facts.join(illegal, "conv").join(audit, "conv").join(hashes, "conv")


def audit(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """The report per ``conv_id`` of ``every`` (default: of ``rows``)."""
    ids = (rows if every is None else every).select(col("conv_id")).distinct().withColumn("conv", _key(col("conv_id")))
    done = ids.join(Repair(rows).report(), "conv", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return done.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c)
                     for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
