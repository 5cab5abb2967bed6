"""Optimal partition of a column's pre-bins by interval dynamic programming.

A feature's pre-bins are a small table (at most some tens of rows), whatever the data behind it. Of all
ways to cut their sequence into bins of consecutive pre-bins, the one of greatest information value is
wanted, such that every bin holds a least share of the rows, there are at most so many bins, and the event
rates follow a trend. The smoothing term of the weights of evidence depends on the number of bins, so each
number is solved on its own: for bins b, b - 1, ... the best value of cutting what follows a given first bin
is the bin's own value plus the best over the next bins that the trend allows. That is exact, where merging
neighbours step by step stops at a local optimum.
"""

from __future__ import annotations

import numpy as np

TRENDS = ("rising", "falling", "monotone", "peak", "valley", "any_turn")
SAME = 1e-10         # values closer than this count as equal: fewer bins, then earlier cuts


def _directions(trend: str) -> list[tuple[int, ...]]:
    """The phases of a trend: +1 rates do not fall, -1 they do not rise."""
    return {"rising": [(1,)], "falling": [(-1,)], "monotone": [(1,), (-1,)], "peak": [(1, -1)], "valley": [(-1, 1)],
            "any_turn": [(1, -1), (-1, 1)]}[trend]


def bin_values(count: np.ndarray, events: np.ndarray, bins: int, total: tuple[float, float], eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(WoE, IV) of bins under smoothing by ``eps`` a bin; ``total``: events and non-events of the feature."""
    de = (events + eps) / (total[0] + eps * bins)
    dn = (count - events + eps) / (total[1] + eps * bins)
    woe = np.log(de / dn)
    return woe, (de - dn) * woe


def _solve(iv: np.ndarray, rate: np.ndarray, allowed: np.ndarray, bins: int, phases: tuple[int, ...]) -> tuple[float, list[int]] | None:
    """Best value of cutting 0..n into ``bins`` bins, and their ends. ``iv[i, j]`` is the value of the bin i..j-1."""
    n = iv.shape[0]
    # behind[left][p][i, j]: best value of the ``left`` bins behind a bin i..j-1 that was entered in phase p
    behind = [[np.where(np.arange(n + 1)[None, :] == n, 0.0, -np.inf).repeat(n, axis=0) for _ in phases]]
    for _ in range(bins - 1):
        now = [np.full((n, n + 1), -np.inf) for _ in phases]
        for j in range(1, n):
            step = rate[j][None, :] - rate[:j, j][:, None]                # the next bin's rate against the bin's
            entered = [np.where((sign * step >= 0) & allowed[j], iv[j] + behind[-1][q][j], -np.inf).max(axis=1) for q, sign in enumerate(phases)]
            for p in range(len(phases)):
                now[p][:j, j] = np.max(entered[p:p + 2], axis=0)
        behind.append(now)
    options = {0: np.where(allowed[0], iv[0] + behind[bins - 1][0][0], -np.inf)}
    value = float(options[0].max())
    if not np.isfinite(value):
        return None
    ends, kept, i, j = [], {0}, 0, 0
    for left in range(bins - 1, -1, -1):            # the earliest cut among those as good as the best
        if ends:
            next_phases = {q for p in kept for q in (p, p + 1) if q < len(phases)}
            options = {q: np.where(allowed[j] & (phases[q] * (rate[j] - rate[i, j]) >= 0), iv[j] + behind[left][q][j], -np.inf) for q in next_phases}
        good = max(o.max() for o in options.values()) - SAME
        end = min(int(np.argmax(o >= good)) for o in options.values() if (o >= good).any())
        kept = {q for q, o in options.items() if o[end] >= good}
        ends.append(end)
        i, j = j, end
    return value, ends


def best_partition(count, events, min_share: float = 0.05, max_bins: int | None = None, trend: str = "monotone", eps: float = 0.5) -> list[int]:
    """Ends of the best bins over pre-bins 0..n-1 (the last is n)."""
    if trend not in TRENDS:
        raise ValueError(f"trend must be one of {TRENDS}")
    count, events = np.asarray(count, float), np.asarray(events, float)
    n, rows = len(count), float(count.sum())
    total = (float(events.sum()), rows - float(events.sum()))
    c, e = np.concatenate(([0.0], np.cumsum(count))), np.concatenate(([0.0], np.cumsum(events)))
    cnt, ev = c[None, :] - c[:n, None], e[None, :] - e[:n, None]                          # [i, j]: bin i..j-1
    some = np.arange(n + 1)[None, :] > np.arange(n)[:, None]
    allowed = some & (cnt >= min_share * rows) & (cnt > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = np.where(cnt > 0, ev / cnt, 0.0)
    most = min(n, max_bins or n, int(1 / min_share + 1e-9) if min_share > 0 else n)
    best: tuple[float, int, list[int]] | None = None
    for bins in range(1, max(1, most) + 1):
        iv = np.where(allowed, bin_values(np.where(some, cnt, 1.0), np.where(some, ev, 0.5), bins, total, eps)[1], -np.inf)
        found = [f for phases in _directions(trend) if (f := _solve(iv, rate, allowed, bins, phases))]
        for value, ends in sorted(found, key=lambda f: f[1]):
            if best is None or value > best[0] + SAME or (bins == best[1] and value > best[0] - SAME and ends < best[2]):
                best = (value, bins, ends)
    return best[2] if best else [n]
