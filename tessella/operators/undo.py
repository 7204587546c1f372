"""Undo and redo as functions that compose.

The depth of a history is moved by undo (one down, not below 0), redo (one up, not above
the top) and draw (a new top). Between two draws the top is fixed; where the depth then
ends is a function of the top alone: it rises by 0 or 1 with each step of the top, so a
few break points hold it, and such functions compose by composing break points. A block
of events is therefore summed up by its undos and redos before the first draw, one
function over its draws, and one for what follows the last.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from tessella.operators.scan import Machine

Points = list[list[int]]
"""Break points (x, y) of a function on 0, 1, 2 …, of slope 0 or 1 between them and
slope 1 after the last."""
SAME: Points = [[0, 0]]


def value(f: Points, x: int) -> int:
    i = bisect_right(f, x, key=lambda p: p[0]) - 1
    flat = i + 1 < len(f) and f[i + 1][1] == f[i][1]
    return f[i][1] + (0 if flat else x - f[i][0])


def reach(f: Points, y: int) -> int:
    """The least x with f(x) >= y."""
    i = bisect_left(f, y, key=lambda p: p[1])
    if i == 0:
        return 0
    return f[i - 1][0] + y - f[i - 1][1]


def plain(points: Points) -> Points:
    """Without points in the middle of a straight line."""
    out: Points = []
    for x, y in points:
        while len(out) > 1 and (out[-1][1] - out[-2][1]) * (x - out[-1][0]) == (y - out[-1][1]) * (out[-1][0] - out[-2][0]):
            out.pop()
        out.append([x, y])
    while len(out) > 1 and out[-1][1] - out[-2][1] == out[-1][0] - out[-2][0]:
        out.pop()
    return out


def then(f: Points, g: Points) -> Points:
    """x → g(f(x))."""
    xs = {x for x, _ in f}
    for u, _ in g:
        xs |= {reach(f, u), max(0, reach(f, u + 1) - 1)}
    return plain([[x, value(g, value(f, x))] for x in sorted(xs)])


def moved(f: Points, kind: str, n: int) -> Points:
    """f(top), the depth, after n undos or redos."""
    if kind == "undo":
        xs = sorted({x for x, _ in f} | {reach(f, n), max(0, reach(f, n + 1) - 1)})
        return plain([[x, max(value(f, x) - n, 0)] for x in xs])
    fall = f[-1][0] - f[-1][1]  # how far below the top a high top ends
    if n >= fall:
        return [[0, 0]]
    low, high = 0, f[-1][0]
    while low < high:  # the first top that redo does not reach
        mid = (low + high) // 2
        low, high = (low, mid) if value(f, mid) + n <= mid else (mid + 1, high)
    xs = sorted({x for x, _ in f if x > low} | {low})
    return plain([[0, 0], *[[x, value(f, x) + n] for x in xs if x]] if low else [[x, value(f, x) + n] for x in xs])


Runs = list[list]
"""(undo or redo, how often), in turn."""


def added(runs: Runs, kind: str, n: int) -> Runs:
    """One more run: A^x B^y A^z is A^(x-y+z) where y is least."""
    runs = runs[:-1] + [[kind, runs[-1][1] + n]] if runs and runs[-1][0] == kind else runs + [[kind, n]]
    while len(runs) > 2 and runs[-2][1] <= min(runs[-1][1], runs[-3][1]):
        runs = runs[:-3] + [[runs[-1][0], runs[-3][1] - runs[-2][1] + runs[-1][1]]]
    return runs


def in_runs(kinds: list[str]) -> Runs:
    out: Runs = []
    for k in kinds:
        k = k if k in ("undo", "redo") else "draw"
        if out and out[-1][0] == k:
            out[-1][1] += 1
        else:
            out.append([k, 1])
    return out


def step(kind: str, n: int, depth: int, top: int) -> int:
    return max(depth - n, 0) if kind == "undo" else min(depth + n, top)


class History(Machine):
    """State: [depth, top]. `log`: a draw goes to the end of a log that keeps everything,
    instead of replacing what was undone."""

    start = [0, 0]
    emits = "depth long"

    def __init__(self, log: bool):
        self.log = log

    def drawn(self, before: object, tail: Points | None, n: int) -> object:
        """What happens to the depth at the first draw up to the top after n more draws;
        for a log, how many draws there were."""
        if self.log:
            return (before or 0) + n
        over = then(before, tail) if before is not None else SAME
        return [[x, y + n] for x, y in over]

    def summary(self, events: dict[str, list]) -> object:
        ahead, over, tail = [], None, None
        for kind, n in in_runs(events["kind"]):
            if kind == "draw":
                over, tail = self.drawn(over, tail, n), SAME
            elif over is None:
                ahead = added(ahead, kind, n)
            else:
                tail = moved(tail, kind, n)
        return [ahead, over, tail]

    def combine(self, parts: list) -> object:
        ahead, over, tail = [], None, None
        for runs, more, rest in parts:
            for kind, n in runs:
                if over is None:
                    ahead = added(ahead, kind, n)
                else:
                    tail = moved(tail, kind, n)
            if more is not None:
                if over is None:
                    over = more
                else:
                    over = over + more if self.log else then(then(over, tail), more)
                tail = rest
        return [ahead, over, tail]

    def apply(self, summary: object, state: object) -> object:
        (ahead, over, tail), (depth, top) = summary, state
        for kind, n in ahead:
            depth = step(kind, n, depth, top)
        if over is not None:
            top = top + over if self.log else value(over, depth)
            depth = value(tail, top)
        return [depth, top]

    def emit(self, events: dict[str, list], state: object) -> list[list]:
        (depth, top), out = state, []
        for kind in events["kind"]:
            if kind in ("undo", "redo"):
                depth = step(kind, 1, depth, top)
            else:
                depth = top = (top if self.log else depth) + 1
            out.append(depth)
        return [out]
