import hashlib
import random
import re
import zlib

import pytest

from cases import SF
from filelens.llm import conversation_repair as C, lattice as L, registry
from test_lattice import best

SCHEMA = "conv_id long, turn long, role string, text string, conv string, run int, pos string, `odd.name` int"
SAID = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(c, t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute(rows, every):
    """{conv_id: the other columns} by one shortest path per conversation."""
    out = {}
    for conv in {r[0] for r in every}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, letters, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        initials = [r[2][:1] if r[2][:1] in ("s", "u", "a") else "x" for r in mine]
        for r, i in zip(mine, initials):
            said = SAID.findall(r[3])
            fault = "blank" if not said else "duplicate" if r[2:] in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add(r[2:])
            if fault:
                n[fault] += 1
            letters += {None: i, "truncated": i.upper()}.get(fault, "-")
        cost, audit, _ = best(letters)
        turns = [r[1] for r in mine if r[1] is not None]
        lines, state, k = [], "", 0
        for e in audit:
            grow = "assistant" if state == "u" else "user"
            if e == "I":
                lines.append(grow + ":")
                state = grow[0]
                continue
            if e == "K":
                lines.append(f"{mine[k][2]}:{mine[k][3]}")
                state = initials[k]
            elif e == "R":
                lines.append(f"{grow}:{mine[k][3]}")
                state = grow[0]
            k += 1
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"],
                     n["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost,
                     audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def odd_rows():
    rng = random.Random(7)
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(rng.choice([1, 2, 3, 5, 8, 30])):
            rows.append((conv, rng.choice([None, *range(12)]),
                         rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "U", None]),
                         rng.choice(["Yes.", "No!  ", "cut", "", " \n", None, "é", "中。", "Why? \t", "a.b", "same."])))
    rows += [(100, i, ("user", "assistant")[i % 2], f"text {i}.") for i in range(700)]        # a hot conversation
    rows += [(101, 3, "user", "again.")] * 300 + [(102, 1, "user", "x" * 200_000 + "."), (103, None, None, None)]
    rows += rows[:20]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "p", 2) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("run_rows,fan", [(C.RUN_ROWS, C.FAN), (4, 3)])
def test_awkward_rows(spark, monkeypatch, run_rows, fan):
    monkeypatch.setattr(C, "RUN_ROWS", run_rows)
    monkeypatch.setattr(C, "FAN", fan)
    rows = odd_rows()
    hurt = damaged(rows)
    given = frame(spark, rows)
    got, want = result(C.audit(C.damage(given), given)), brute(hurt, rows)
    assert got == want
    assert all(set(r[6]) <= set("DIKR") for r in got.values())


def test_empty_tables_and_lost_conversations(spark):
    given = frame(spark, [(1, 1, "user", "a."), (2, 1, None, None)])
    none = given.limit(0)
    assert C.audit(none).count() == 0
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert result(C.audit(none, given)) == {1: empty, 2: empty}


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "user", ""), (1, 3, "user", "So?")]
    done = C.Repair(frame(spark, rows)).repaired().collect()
    assert [[tuple(t) for t in r.turns] for r in done] == [
        [("system", "Be kind."), ("user", ""), ("assistant", "Hi."), ("user", "So?"), ("assistant", "")]]


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(registry.op13_conversation_repair(spark, SF)) == brute(damaged(rows), rows)
