"""Cheapest edits of runs of turns by the auction algorithm for shortest paths.

A run's lattice has a node per (rows read, role state) and an arc per edit,
with small integer costs. Every lattice of a batch keeps node prices and one
path from its entry: where the last node's price is below the least of (arc
cost + price at the arc's head), the price rises to it and the path contracts;
else the path extends along that arc. Prices never break
``price(i) <= cost + price(j)``, so a path that reaches the end is a shortest
one, and all shortest paths lie on tight arcs, where the two sides are equal.
The wanted one is traced over the tight arcs that lead to the end, least
letter first. The lattices of a batch are advanced together.

Rows are letters: the role's initial (``s u a``, else ``x``), in upper case if
the row costs one more when it stays, or ``-`` if it must go.
"""

from __future__ import annotations

import numpy as np

EMPTY, SYSTEM, USER, ASSISTANT = range(4)    # what the roles so far end with
STATES = 4
DELETE, INSERT, RELABEL, TRUNCATED = 3, 2, 2, 1
INF = np.int64(1) << 40
# Distance to an accepted end where inserts are still possible
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
LETTERS = np.frombuffer(b"DIKR", np.uint8)   # arc slots, in ASCII order
_NEXT = np.array([USER, USER, ASSISTANT, USER])  # state after an inserted or relabelled turn


def _moves() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row letter and state: cost and state after each of the four edits;
    the cost that the row has at least."""
    codes = "suaxSUAX-"
    cost = np.full((len(codes), STATES, 4), INF, np.int64)
    after = np.zeros((len(codes), STATES, 4), np.int64)
    after[:] = np.arange(STATES)[None, :, None]
    cost[:, :, 0], cost[:, :, 1] = DELETE, INSERT
    after[:, :, 1] = after[:, :, 3] = _NEXT
    least = np.zeros(len(codes), np.int64)
    for c, code in enumerate(codes):
        if code == "-":
            least[c] = DELETE
            continue
        least[c] = stay = TRUNCATED if code.isupper() else 0
        cost[c, :, 3] = RELABEL + stay
        for q in range(STATES):
            to = {"s": SYSTEM if q == EMPTY else -1, "u": USER if q != USER else -1,
                  "a": ASSISTANT if q == USER else -1}.get(code.lower(), -1)
            if to >= 0:
                cost[c, q, 2], after[c, q, 2] = stay, to
    return cost, after, least


_COST, _AFTER, _LEAST = _moves()
_CODE = np.full(256, -1, np.int64)
for _i, _c in enumerate(b"suaxSUAX-"):
    _CODE[_c] = _i


class Lattices:
    """A batch of lattices, one per (run, entry state, distances at the exit).
    ``open_end``: inserts are possible after the last row."""

    def __init__(self, runs: list[str], entry: np.ndarray, togo: np.ndarray, open_end: np.ndarray):
        n = np.array([len(r) for r in runs], np.int64)
        lanes, width = len(runs), int(n.max(initial=0))
        self.n, self.width, self.entry = n, width, np.asarray(entry, np.int64)
        # rows are aligned at their end; what is before a run is never reached
        code = np.zeros((lanes, width), np.int64)
        mine = np.arange(width)[None, :] >= (width - n)[:, None]
        code[mine] = _CODE[np.frombuffer("".join(runs).encode(), np.uint8)]
        per = (width + 1) * STATES + 1
        self.origin = np.arange(lanes) * per + (width - n) * STATES + self.entry
        self.dest = np.arange(lanes) * per + per - 1
        cost = np.full((lanes, per, 4), INF, np.int64)
        head = np.broadcast_to(self.dest[:, None, None], (lanes, per, 4)).copy()
        base = np.arange(lanes)[:, None, None, None] * per
        level = np.arange(width)[None, :, None, None] * STATES
        rows = width * STATES
        cost[:, :rows] = _COST[code].reshape(lanes, rows, 4)
        down = np.array([STATES, 0, STATES, STATES])  # an insert stays at its level
        head[:, :rows] = (base + level + _AFTER[code] + down).reshape(lanes, rows, 4)
        cost[:, rows:rows + STATES, 0] = togo
        cost[:, rows:rows + STATES, 1] = np.where(np.asarray(open_end)[:, None], INSERT, INF)
        head[:, rows:rows + STATES, 1] = base[:, :, 0, 0] + rows + _NEXT
        # starting prices: what the rows to come cost at least
        least = np.where(mine, _LEAST[code], 0)
        rest = np.concatenate([np.cumsum(least[:, ::-1], 1)[:, ::-1], np.zeros((lanes, 1), np.int64)], 1)
        price = np.zeros((lanes, per), np.int64)
        price[:, :-1] = np.repeat(rest + np.minimum(togo, INF).min(1, initial=INF)[:, None], STATES, 1)
        self.cost, self.head, self.price = cost.reshape(-1, 4), head.reshape(-1, 4), price.reshape(-1)
        self.per, self.rows = per, rows
        self.steps = self._settle()

    def _settle(self) -> int:
        """Path extension and contraction until every path is at its end."""
        cost, head, price = self.cost, self.head, self.price
        path = np.zeros((len(self.n), self.per), np.int64)
        path[:, 0] = self.origin
        lane, depth, node = np.arange(len(self.n)), np.zeros(len(self.n), np.int64), self.origin.copy()
        steps = 0
        while len(lane):
            ahead = cost[node] + price[head[node]]
            slot = ahead.argmin(1)
            least = ahead[np.arange(len(node)), slot]
            rise = price[node] < least
            price[node[rise]] = least[rise]
            depth = np.where(rise, np.maximum(depth - 1, 0), depth + 1)
            on = ~rise
            path[lane[on], depth[on]] = head[node[on], slot[on]]
            node = path[lane, depth]
            steps += len(lane)
            end = node == self.dest[lane]
            if end.any():
                lane, depth, node = lane[~end], depth[~end], node[~end]
        return steps

    def lengths(self) -> np.ndarray:
        return self.price[self.origin] - self.price[self.dest]

    def trace(self) -> tuple[list[str], np.ndarray]:
        """The least audit among the shortest paths, and the state in which
        it leaves the run."""
        lanes, width = len(self.n), self.width
        tight = self.price[:, None] == self.cost + self.price[self.head]
        leads = np.zeros(len(self.price), bool)
        leads[self.dest] = True
        of_level = (np.arange(lanes)[:, None] * self.per + np.arange(STATES)).reshape(-1)
        for level in range(width, -1, -1):
            at = of_level + level * STATES
            for _ in range(3):  # then over inserts at the level
                leads[at] |= (tight[at] & leads[self.head[at]]).any(1)
        good = tight & leads[self.head]
        node, lane = self.origin.copy(), np.arange(lanes)
        out = np.zeros((lanes, 2 * (width + 2) * STATES), np.uint8)
        size, leave = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        while len(lane):
            slot = good[node].argmax(1)
            to = self.head[node, slot]
            end = to == self.dest[lane]
            leave[lane[end]] = (node - lane * self.per)[end] - self.rows
            lane, slot, node = lane[~end], slot[~end], to[~end]
            out[lane, size[lane]] = LETTERS[slot]
            size[lane] += 1
        return [out[i, :size[i]].tobytes().decode() for i in range(lanes)], leave


def transfer(runs: list[str]) -> np.ndarray:
    """Shortest distances through each run from every state to every state,
    without inserts after its last row: (run, from, to)."""
    out = np.full((len(runs), STATES, STATES), INF, np.int64)
    n = np.array([len(r) for r in runs], np.int64)
    # nothing said yet, or the system turn alone: all other rows are deleted
    out[:, EMPTY, EMPTY] = out[:, SYSTEM, SYSTEM] = DELETE * n
    keep = np.array([0 if "s" in r else TRUNCATED if "S" in r else INF for r in runs], np.int64)
    out[:, EMPTY, SYSTEM] = np.minimum(DELETE * (n - 1) + keep, INF)
    for a in range(STATES):
        for b in (USER, ASSISTANT):
            togo = np.full((len(runs), STATES), INF, np.int64)
            togo[:, b] = 0
            out[:, a, b] = Lattices(runs, np.full(len(runs), a), togo, np.zeros(len(runs), bool)).lengths()
    return out
