import itertools
import random

import numpy as np

from filelens.llm import lattice as L

ACCEPT = {L.EMPTY: 0, L.ASSISTANT: 0}


def best(run, start=L.EMPTY, togo=None, open_end=True):
    """(cost, audit, last state) by Dijkstra over (cost, audit) labels."""
    import heapq

    togo = ACCEPT if togo is None else togo
    heap, seen = [(0, "", 0, start, False)], set()
    while heap:
        c, s, i, q, done = heapq.heappop(heap)
        if done:
            return c, s, q
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(run) and q in togo:
            heapq.heappush(heap, (c + togo[q], s, i, q, True))
        grow = L.ASSISTANT if q == L.USER else L.USER
        if i < len(run) or open_end:
            heapq.heappush(heap, (c + 2, s + "I", i, grow, False))
        if i < len(run):
            r = run[i]
            heapq.heappush(heap, (c + 3, s + "D", i + 1, q, False))
            if r != "-":
                more = int(r.isupper())
                heapq.heappush(heap, (c + 2 + more, s + "R", i + 1, grow, False))
                to = {"s": L.SYSTEM if q == L.EMPTY else None, "u": L.USER if q != L.USER else None,
                      "a": L.ASSISTANT if q == L.USER else None}.get(r.lower())
                if to is not None:
                    heapq.heappush(heap, (c + more, s + "K", i + 1, to, False))
    return None


def test_all_short_runs():
    runs = ["".join(p) for n in range(5) for p in itertools.product("suaUA-", repeat=n)]
    lat = L.Lattices(runs, np.zeros(len(runs), int), np.tile([0, L.INF, L.INF, 0], (len(runs), 1)), np.ones(len(runs), bool))
    audits, leave = lat.trace()
    want = [best(r) for r in runs]
    assert [tuple(x) for x in zip(lat.lengths().tolist(), audits)] == [w[:2] for w in want]
    assert leave.tolist() == [w[2] for w in want]


def test_random_runs_entries_and_exits():
    rng = random.Random(2)
    for _ in range(6):
        runs = ["".join(rng.choice("uauauauasxSUAX-") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
        entry = [rng.randrange(4) for _ in runs]
        togo = [[rng.randrange(9) for _ in range(4)] for _ in runs]
        lat = L.Lattices(runs, np.array(entry), np.array(togo), np.zeros(60, bool))
        audits, leave = lat.trace()
        for i, r in enumerate(runs):
            assert (lat.lengths()[i], audits[i], leave[i]) == best(r, entry[i], dict(enumerate(togo[i])), False)


def test_transfer_distances():
    rng = random.Random(4)
    runs = ["".join(rng.choice("uauasxSUA-") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    got = L.transfer(runs)
    for i, r in enumerate(runs):
        for a, b in itertools.product(range(4), range(4)):
            want = best(r, a, {b: 0}, False)
            assert got[i, a, b] == (L.INF if want is None else want[0]), (r, a, b)
