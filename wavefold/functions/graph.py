"""Measures of one weighted undirected graph given as a small dense matrix, from the published definitions of complex
network analysis (weighted and binary graphs, module structure, centralities)."""

from __future__ import annotations

import numpy as np

#: The measures of `profile`, in order; the vector has 25 places, those named None are not kept.
NAMES = (
    "degree", "strength", "local_assortativity", "path_length", "local_efficiency", None, "eccentricity", "betweenness", None, "eigenvector_centrality", None,
    "clustering", "coreness", "participation", "diversity", "assortativity", "global_efficiency", "radius", "diameter", "transitivity", None, None,
    "edge_overlap", "pair_degree", "matching",
)


def clean(w: np.ndarray, scale: bool = True) -> np.ndarray:
    """No self-links, no NaN or infinity, symmetric; with `scale` the largest absolute weight is 1."""
    w = np.nan_to_num(np.array(w, float), nan=0.0, posinf=0.0, neginf=0.0)
    np.fill_diagonal(w, 0)
    if not np.allclose(w, w.T, atol=1e-10):
        w = np.maximum(w, w.T)
    top = np.abs(w).max(initial=0)
    return w / top if scale and top else w


def distances(w: np.ndarray) -> np.ndarray:
    """Shortest paths where a link of weight w is 1 / w long (Floyd and Warshall)."""
    with np.errstate(divide="ignore"):
        d = np.where(w > 0, 1 / w, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return d


def _mean_inverse(d: np.ndarray) -> float:
    n = len(d)
    off = ~np.eye(n, dtype=bool)
    with np.errstate(divide="ignore"):
        return float((1 / d[off]).sum() / (n * (n - 1))) if n > 1 else 0.0


def local_efficiency(w: np.ndarray) -> np.ndarray:
    """Of each node: inverse distances among its neighbours, by cube roots of the three weights, over the possible."""
    n, out = len(w), np.zeros(len(w))
    root = np.cbrt(w)
    for u in range(n):
        v = np.flatnonzero(w[u])
        if len(v) < 2:
            continue
        e = 1 / np.where(np.eye(len(v), dtype=bool), np.inf, distances(w[np.ix_(v, v)]))
        both = np.outer(root[u, v], root[u, v])
        total = (both * np.cbrt(e)).sum()
        k = len(v)
        out[u] = total / (k * (k - 1))
    return out


def betweenness(w: np.ndarray) -> np.ndarray:
    """Brandes' algorithm over lengths 1 / weight."""
    n = len(w)
    with np.errstate(divide="ignore"):
        length = np.where(w > 0, 1 / w, np.inf)
    out = np.zeros(n)
    for s in range(n):
        dist, paths, done, order = np.full(n, np.inf), np.zeros(n), np.zeros(n, bool), []
        dist[s], paths[s] = 0, 1
        before = np.zeros((n, n), bool)
        while True:
            open_ = np.where(done, np.inf, dist)
            u = int(open_.argmin())
            if not np.isfinite(open_[u]):
                break
            done[u] = True
            order.append(u)
            for v in np.flatnonzero(np.isfinite(length[u]) & ~done):
                d = dist[u] + length[u, v]
                if d < dist[v] - 1e-12:
                    dist[v], paths[v] = d, paths[u]
                    before[v] = False
                    before[v, u] = True
                elif abs(d - dist[v]) <= 1e-12:
                    paths[v] += paths[u]
                    before[v, u] = True
        share = np.zeros(n)
        for v in order[:0:-1]:
            for u in np.flatnonzero(before[v]):
                share[u] += (1 + share[v]) * paths[u] / paths[v]
            out[v] += share[v]
    return out


def eigenvector_centrality(w: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(w)
    return np.abs(vectors[:, values.argmax()])


def clustering(w: np.ndarray) -> np.ndarray:
    root, k = np.cbrt(w), (w != 0).sum(axis=1).astype(float)
    triangles = np.diag(root @ root @ root)
    k[triangles == 0] = np.inf
    return np.clip(triangles / (k * (k - 1)), 0, 1)


def transitivity(w: np.ndarray) -> float:
    root, k = np.cbrt(w), (w != 0).sum(axis=1)
    open_ = float((k * (k - 1)).sum())
    return float(np.trace(root @ root @ root)) / open_ if open_ else 0.0


def coreness(b: np.ndarray) -> np.ndarray:
    """The largest k for which a node stays when nodes of degree below k are peeled off."""
    out = np.zeros(len(b))
    for k in range(1, len(b)):
        alive = np.ones(len(b), bool)
        while True:
            low = alive & (b[:, alive].sum(axis=1) < k)
            if not low.any():
                break
            alive &= ~low
        if not alive.any():
            break
        out[alive] = k
    return out


def assortativity(w: np.ndarray) -> float:
    """Correlation of the strengths at the two ends of links."""
    s = w.sum(axis=1)
    i, j = np.nonzero(np.triu(w > 0, 1))
    if not len(i):
        return float("nan")
    half = ((s[i] + s[j]) / 2).mean() ** 2
    up, down = (s[i] * s[j]).mean() - half, ((s[i] ** 2 + s[j] ** 2) / 2).mean() - half
    return float(up / down) if abs(down) > 1e-15 else float("nan")


def local_assortativity(w: np.ndarray) -> np.ndarray:
    """Each node's part of the correlation of strengths, of positive and of negative weights, summed."""
    out = np.zeros(len(w))
    for part in (np.where(w > 0, w, 0), np.where(w < 0, -w, 0)):
        s = part.sum(axis=1)
        if not s.any():
            continue
        r = assortativity(part)
        gap = np.array([np.abs(s[part[u] > 0] - s[u]).sum() for u in range(len(w))])
        gap = np.divide(gap, s, out=np.zeros(len(w)), where=s > 0)
        if gap.sum() and np.isfinite(r):
            out += (r + 1) / len(w) - gap / gap.sum()
    return out


def modules(w: np.ndarray) -> np.ndarray:
    """Communities (from 1) by repeated bisection along the leading eigenvector of the modularity matrix, each bisection
    refined by moving single nodes while that raises modularity."""
    n, k, total = len(w), w.sum(axis=1), w.sum()
    label = np.ones(n, int)
    if total <= 0:
        return label
    b = w - np.outer(k, k) / total
    queue, count = [np.arange(n)], 1
    while queue:
        own = queue.pop()
        g = b[np.ix_(own, own)]
        g = g - np.diag(g.sum(axis=1))
        values, vectors = np.linalg.eigh(g)
        if values[-1] <= 1e-10:
            continue
        s = np.where(vectors[:, -1] >= 0, 1.0, -1.0)
        gain = s @ g @ s
        moved = np.zeros(len(own), bool)
        best, trial = s.copy(), s.copy()
        while not moved.all():
            change = -4 * trial * (g @ trial) + 4 * np.diag(g)
            change[moved] = -np.inf
            at = int(change.argmax())
            trial[at] *= -1
            moved[at] = True
            if (now := trial @ g @ trial) > gain + 1e-10:
                gain, best = now, trial.copy()
        if gain <= 1e-10 or abs(best.sum()) == len(own):
            continue
        count += 1
        label[own[best < 0]] = count
        queue += [own[best > 0], own[best < 0]]
    return np.unique(label, return_inverse=True)[1] + 1


def participation(w: np.ndarray, label: np.ndarray) -> np.ndarray:
    s = w.sum(axis=1)
    within = np.stack([w[:, label == c].sum(axis=1) for c in np.unique(label)])
    return np.where(s > 0, 1 - (within**2).sum(axis=0) / np.where(s > 0, s, 1) ** 2, 0.0)


def diversity(w: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Entropy of a node's positive strength over communities, by the logarithm of their number."""
    kinds = np.unique(label)
    if len(kinds) < 2:
        return np.zeros(len(w))
    pos = np.where(w > 0, w, 0)
    within = np.stack([pos[:, label == c].sum(axis=1) for c in kinds])
    p = within / np.where(within.sum(axis=0) > 0, within.sum(axis=0), 1)
    return -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(axis=0) / np.log(len(kinds))


def edge_overlap(b: np.ndarray) -> tuple[float, float]:
    """Mean share of common neighbours of the ends of a link, and mean degree of the ends."""
    i, j = np.nonzero(b)
    if not len(i):
        return float("nan"), float("nan")
    k, common = b.sum(axis=1), (b @ b)[i, j]
    either = k[i] + k[j] - 2 - common
    return float(np.divide(common, either, out=np.zeros(len(i)), where=either > 0).mean()), float(((k[i] + k[j]) / 2).mean())


def matching(w: np.ndarray) -> np.ndarray:
    """Share of two nodes' other links that go to the same nodes."""
    b = (w != 0).astype(float)
    k = b.sum(axis=1)
    both = k[:, None] + k[None, :] - 2 * b
    out = np.divide(2 * (b @ b), both, out=np.zeros_like(b), where=both > 0)
    np.fill_diagonal(out, 0)
    return out


def profile(w: np.ndarray) -> np.ndarray:
    """The 20 kept measures of a graph, means over nodes or links where they have several values; NaN for a graph with
    fewer than 3 nodes."""
    n = len(w)
    if n < 3:
        return np.full(20, np.nan)
    b = (w != 0).astype(float)
    d = distances(w)
    off = np.where(np.eye(n, dtype=bool) | ~np.isfinite(d), np.nan, d)
    with np.errstate(all="ignore"):
        reach = np.isfinite(off).any(axis=1)
        path = np.array([np.nanmean(r) if ok else np.nan for r, ok in zip(off, reach, strict=True)])
        ecc = np.array([np.nanmax(r) if ok else np.nan for r, ok in zip(off, reach, strict=True)])
    label = modules(w)
    overlap, pair = edge_overlap(b)
    mean = lambda v: float(np.mean(v))
    return np.array([
        mean(b.sum(axis=1)), mean(w.sum(axis=1)), mean(local_assortativity(w)), mean(path), mean(local_efficiency(w)), mean(ecc), mean(2 * betweenness(w) / ((n - 1) * (n - 2))),
        mean(eigenvector_centrality(w)), mean(clustering(w)), mean(coreness(b)), mean(participation(w, label)), mean(diversity(w, label)), assortativity(w), _mean_inverse(d),
        float(np.nanmin(ecc)) if reach.any() else np.nan, float(np.nanmax(ecc)) if reach.any() else np.nan, transitivity(w), overlap, pair, mean(matching(w)),
    ])
