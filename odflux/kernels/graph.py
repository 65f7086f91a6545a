"""Dense-graph kernels.  A graph is a square matrix of trips with a zero diagonal; lengths are inf where no edge is."""

from __future__ import annotations

import numpy as np


def lengths(trips: np.ndarray) -> np.ndarray:
    """Cost 1 / trips."""
    with np.errstate(divide="ignore"):
        out = np.where(trips > 0, 1.0 / np.where(trips > 0, trips, 1), np.inf)
    np.fill_diagonal(out, 0)
    return out


def all_pairs(length: np.ndarray) -> np.ndarray:
    """Shortest path lengths between all pairs, one vectorised relaxation for each middle node."""
    d = length.copy()
    for k in range(len(d)):
        np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
    return d


def efficiency(distance: np.ndarray) -> float:
    n = len(distance)
    if n < 2:
        return 0.0
    off = distance[~np.eye(n, dtype=bool)]
    with np.errstate(divide="ignore"):
        return float(np.where(np.isfinite(off) & (off > 0), 1 / np.where(off > 0, off, 1), 0).sum() / (n * (n - 1)))


def betweenness_from(length: np.ndarray, source: int) -> np.ndarray:
    """One source's share of betweenness: shortest-path counts forward, dependencies backward."""
    n = len(length)
    dist, sigma = np.full(n, np.inf), np.zeros(n)
    dist[source], sigma[source] = 0.0, 1.0
    done, order = np.zeros(n, dtype=bool), []
    for _ in range(n):
        v = int(np.argmin(np.where(done, np.inf, dist)))
        if done[v] or not np.isfinite(dist[v]):
            break
        done[v] = True
        order.append(v)
        reach = dist[v] + length[v]
        better = (reach < dist * (1 - 1e-12)) & ~done
        same = np.isfinite(reach) & np.isfinite(dist) & (np.abs(np.where(np.isfinite(reach), reach, 0) - np.where(np.isfinite(dist), dist, 0)) <= 1e-12 * np.maximum(dist, 1e-300)) & ~done & ~better
        better[v] = same[v] = False
        dist[better], sigma[better] = reach[better], sigma[v]
        sigma[same] += sigma[v]
    share = np.zeros(n)
    for w in reversed(order):
        before = np.isfinite(length[:, w]) & (np.abs(dist + length[:, w] - dist[w]) <= 1e-12 * max(dist[w], 1e-300)) & (np.arange(n) != w) & np.isfinite(dist)
        if sigma[w] > 0:
            share[before] += sigma[before] / sigma[w] * (1 + share[w])
    share[source] = 0
    return share


def betweenness(length: np.ndarray) -> np.ndarray:
    return sum((betweenness_from(length, s) for s in range(len(length))), np.zeros(len(length)))


def reachable(adjacent: np.ndarray) -> np.ndarray:
    """Transitive closure by repeated squaring."""
    r = (adjacent > 0) | np.eye(len(adjacent), dtype=bool)
    while True:
        new = (r.astype(np.float32) @ r.astype(np.float32)) > 0
        if (new == r).all():
            return r
        r = new


def labels(related: np.ndarray) -> np.ndarray:
    """Component labels of an equivalence matrix: the smallest member."""
    return related.argmax(axis=1)


def survivors(trips: np.ndarray, alive: np.ndarray, base: float, with_efficiency: bool = True) -> dict[str, float]:
    """Giant weak and strong component shares, trips left inside the former, and efficiency against the start."""
    n0, total = len(trips), trips.sum()
    sub = trips[np.ix_(alive, alive)]
    out = {"wcc_frac": 0.0, "scc_frac": 0.0, "trip_frac": 0.0, "eff_frac": 0.0}
    if not len(sub):
        return out
    weak = labels(reachable(sub + sub.T))
    size = np.bincount(weak)
    giant = weak == int(size.argmax())
    r = reachable(sub)
    out["wcc_frac"] = float(size.max() / n0)
    out["scc_frac"] = float(np.bincount(labels(r & r.T)).max() / n0)
    out["trip_frac"] = float(sub[np.ix_(giant, giant)].sum() / total) if total else 0.0
    if with_efficiency and base > 0:
        out["eff_frac"] = efficiency(all_pairs(lengths(sub))) / base
    return out


def local_efficiency(trips: np.ndarray, node: int) -> float:
    near = (trips[node] > 0) | (trips[:, node] > 0)
    near[node] = False
    return efficiency(all_pairs(lengths(trips[np.ix_(near, near)]))) if near.sum() >= 2 else 0.0


def cascade(trips: np.ndarray, tolerance: float) -> dict[str, float]:
    """Overload cascade: capacity (1 + tolerance) * load, the node of largest load fails first."""
    n, total = len(trips), trips.sum()
    load0 = betweenness(lengths(trips))
    capacity = (1 + tolerance) * load0
    alive = np.ones(n, dtype=bool)
    alive[int(load0.argmax())] = False
    failed, steps = ~alive, 0
    while alive.any():
        idx = np.flatnonzero(alive)
        load = betweenness(lengths(trips[np.ix_(idx, idx)]))
        over = idx[load > capacity[idx] * (1 + 1e-9) + 1e-9]
        if not len(over):
            break
        alive[over] = False
        steps += 1
    failed = ~alive
    kept = survivors(trips, alive, 0, False)
    net = trips.sum(axis=1) - trips.sum(axis=0)
    return {
        "g_wcc": kept["wcc_frac"],
        "failed": int(failed.sum()),
        "failed_frac": float(failed.mean()),
        "flow_frac": float(trips[np.ix_(alive, alive)].sum() / total) if total else 0.0,
        "injectors": int((failed & (net > 0)).sum()),
        "absorbers": int((failed & (net < 0)).sum()),
        "steps": steps,
    }


def modularity(w: np.ndarray, part: np.ndarray, resolution: float = 1.0) -> float:
    k, m2 = w.sum(axis=1), w.sum()
    if not m2:
        return 0.0
    same = part[:, None] == part[None, :]
    return float((w[same].sum() / m2) - resolution * (np.bincount(part, k) ** 2).sum() / m2**2)


def louvain(w: np.ndarray, seed: int, resolution: float = 1.0, refine: bool = False) -> np.ndarray:
    """Greedy modularity by node moves and aggregation, nodes in seeded random order; w is symmetric.

    With ``refine``, communities whose nodes aren't connected are split before aggregation.
    """
    rng, n = np.random.default_rng(seed), len(w)
    member, graph = np.arange(n), w.astype(float).copy()
    while True:
        part, k, m2 = np.arange(len(graph)), graph.sum(axis=1), graph.sum()
        if not m2:
            break
        mass, moved = k.copy(), True
        for _ in range(50):
            moved = False
            for i in rng.permutation(len(graph)):
                own = part[i]
                links = np.bincount(part, graph[i], len(graph))
                links[own] -= graph[i, i]
                mass[own] -= k[i]
                gain = links - resolution * k[i] * mass / m2
                best = int(gain.argmax())
                if gain[best] <= gain[own] + 1e-12:
                    best = own
                mass[best] += k[i]
                if best != own:
                    part[i], moved = best, True
            if not moved:
                break
        if refine:
            for c in np.unique(part):
                idx = np.flatnonzero(part == c)
                piece = labels(reachable(graph[np.ix_(idx, idx)]))
                part[idx] = idx[piece]
        names, part = np.unique(part, return_inverse=True)
        if len(names) == len(graph):
            break
        onehot = np.eye(len(names))[part]
        graph, member = onehot.T @ graph @ onehot, part[member]
    return np.unique(member, return_inverse=True)[1]


def agglomerate(w: np.ndarray) -> np.ndarray:
    """Greedy merging of the pair of communities that raises modularity most, until none does."""
    part, m2 = np.arange(len(w)), w.sum()
    e = w / m2 if m2 else w.astype(float)
    while len(e) > 1:
        a = e.sum(axis=1)
        gain = 2 * (e - np.outer(a, a))
        gain[e == 0] = -np.inf
        np.fill_diagonal(gain, -np.inf)
        i, j = sorted(np.unravel_index(int(gain.argmax()), gain.shape))
        if not gain[i, j] > 1e-12:
            break
        e[i] += e[j]
        e[:, i] += e[:, j]
        e = np.delete(np.delete(e, j, 0), j, 1)
        part = np.where(part == j, i, part - (part > j))
    return part


def map_equation(trips: np.ndarray, part: np.ndarray, damping: float = 0.85) -> float:
    """Description length in bits of a walk with teleportation, for a partition."""
    n = len(trips)
    out = trips.sum(axis=1, keepdims=True)
    step = np.where(out > 0, trips / np.where(out > 0, out, 1), 1.0 / n)
    rank = np.full(n, 1.0 / n)
    for _ in range(200):
        rank = damping * rank @ step + (1 - damping) / n
    flow = damping * rank[:, None] * step + (1 - damping) * rank[:, None] / n
    groups = part.max() + 1
    onehot = np.eye(groups)[part]
    between = onehot.T @ flow @ onehot
    leave = between.sum(axis=1) - np.diag(between)
    inside = onehot.T @ rank
    h = lambda x: float(-(x[x > 0] * np.log2(x[x > 0])).sum())
    q = leave.sum()
    index = h(leave) + (q * np.log2(q) if q > 0 else 0)
    total = leave + inside
    books = h(leave) + h(rank) + float((total[total > 0] * np.log2(total[total > 0])).sum())
    return index + books


def infomap(trips: np.ndarray, seed: int) -> np.ndarray:
    """Greedy moves between communities while the description length falls, from single nodes or from one block."""
    rng, n = np.random.default_rng(seed), len(trips)
    best, bits = np.zeros(n, dtype=int), map_equation(trips, np.zeros(n, dtype=int))
    part = louvain(trips + trips.T, seed)
    now = map_equation(trips, part)
    for _ in range(3):
        before = now
        for i in rng.permutation(n):
            near = np.unique(part[(trips[i] > 0) | (trips[:, i] > 0)])
            for c in near[:8]:
                if c != part[i]:
                    trial = part.copy()
                    trial[i] = c
                    trial = np.unique(trial, return_inverse=True)[1]
                    size = map_equation(trips, trial)
                    if size < now - 1e-12:
                        part, now = trial, size
                        break
        if now >= before - 1e-9:
            break
    return part if now < bits else best


def erdos_renyi(n: int, m: int, rng: np.random.Generator) -> np.ndarray:
    """Directed simple graph with n nodes and m edges."""
    out = np.zeros((n, n))
    cells = rng.choice(n * (n - 1), m, replace=False)
    i, j = cells // (n - 1), cells % (n - 1)
    out[i, j + (j >= i)] = 1
    return out


def configuration(adjacent: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Stubs joined at random; self-loops and parallel edges are dropped and counted."""
    i = np.repeat(np.arange(len(adjacent)), (adjacent > 0).sum(axis=1))
    j = rng.permutation(np.repeat(np.arange(len(adjacent)), (adjacent > 0).sum(axis=0)))
    out = np.zeros(adjacent.shape)
    out[i[i != j], j[i != j]] = 1
    return out, int(len(i) - out.sum())


def shuffled_weights(trips: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The same edges with their weights permuted."""
    out = np.zeros(trips.shape)
    at = trips > 0
    out[at] = rng.permutation(trips[at])
    return out


def statistics(trips: np.ndarray) -> dict[str, float]:
    """Bundle compared with null models."""
    a = (trips > 0).astype(float)
    n, m = len(a), a.sum()
    un = ((a + a.T) > 0).astype(float)
    k = un.sum(axis=1)
    triads = (k * (k - 1)).sum()
    r, density = (a * a.T).sum() / m if m else 0.0, m / (n * (n - 1)) if n > 1 else 0.0
    i, j = np.nonzero(a)
    x, y = a.sum(axis=1)[i], a.sum(axis=0)[j]
    return {
        "transitivity": float(np.trace(un @ un @ un) / triads) if triads else 0.0,
        "assortativity": float(np.corrcoef(x, y)[0, 1]) if len(x) and x.std() > 0 and y.std() > 0 else 0.0,
        "reciprocity_rho": float((r - density) / (1 - density)) if density < 1 else 0.0,
        "weighted_reciprocity": float(np.minimum(trips, trips.T).sum() / trips.sum()) if trips.sum() else 0.0,
        "cost_efficiency": efficiency(all_pairs(lengths(trips))),
        "hop_efficiency": efficiency(all_pairs(lengths(a))),
    }


def mutual_information(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted mutual information, arithmetic-mean normaliser, expectation under the hypergeometric model."""
    from math import exp, lgamma, log

    n = len(a)
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    ra, cb = table.sum(axis=1), table.sum(axis=0)
    p = table[table > 0] / n
    mi = float((p * np.log(p / (np.outer(ra, cb)[table > 0] / n**2))).sum())
    h = lambda c: float(-(c[c > 0] / n * np.log(c[c > 0] / n)).sum())
    g, expected = lambda x: lgamma(x + 1), 0.0
    for x in ra:
        for y in cb:
            for k in range(max(1, int(x + y - n)), int(min(x, y)) + 1):
                weight = exp(g(x) + g(y) + g(n - x) + g(n - y) - g(n) - g(k) - g(x - k) - g(y - k) - g(n - x - y + k))
                expected += k / n * log(n * k / (x * y)) * weight
    top, bottom = mi - expected, (h(ra) + h(cb)) / 2 - expected
    return 1.0 if abs(bottom) < 1e-12 else top / bottom


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    two = lambda x: float((x * (x - 1) / 2).sum())
    idx, sa, sb, t = two(table), two(table.sum(axis=1)), two(table.sum(axis=0)), len(a) * (len(a) - 1) / 2
    expected = sa * sb / t if t else 0.0
    return 1.0 if (sa + sb) / 2 == expected else (idx - expected) / ((sa + sb) / 2 - expected)
