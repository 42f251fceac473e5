"""Linear searches of one graph in plain Python: what the distributed forms are held to."""

from __future__ import annotations

import numpy as np


def _neighbours(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and targets of each node's edges."""
    order = np.argsort(src, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst[order]


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The number of each node's strongly connected component; an edge between two leads to the smaller number."""
    at, to = _neighbours(n, src, dst)
    low, index, part = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    place, count, met = at[:-1].copy(), 0, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        path, open_nodes = [root], [root]
        index[root] = low[root] = met
        met += 1
        while path:
            u = path[-1]
            if place[u] < at[u + 1]:
                v = to[place[u]]
                place[u] += 1
                if index[v] < 0:
                    index[v] = low[v] = met
                    met += 1
                    path.append(v)
                    open_nodes.append(v)
                elif part[v] < 0:
                    low[u] = min(low[u], index[v])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[u])
            if low[u] == index[u]:
                while True:
                    v = open_nodes.pop()
                    part[v] = count
                    if v == u:
                        break
                count += 1
    return part


def longest_path(n: int, src: np.ndarray, dst: np.ndarray) -> int:
    """Most edges on a path through the components' acyclic graph."""
    part = strong_components(n, src, dst)
    a, b = part[src], part[dst]
    far = np.zeros(part.max() + 1, np.int64)
    between = a != b
    for u, v in sorted(set(zip(a[between].tolist(), b[between].tolist()))):  # targets have smaller numbers, so they are done
        far[u] = max(far[u], far[v] + 1)
    return int(far.max())


def cut_vertices(n: int, src: np.ndarray, dst: np.ndarray) -> int:
    """How many nodes split their undirected component when they go."""
    pairs = {(min(a, b), max(a, b)) for a, b in zip(src.tolist(), dst.tolist()) if a != b}
    if n <= 2 or not pairs:
        return 0
    ends = np.array(sorted(pairs))
    at, to = _neighbours(n, np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]]))
    index, low, parent, place = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64), at[:-1].copy()
    cut, met = np.zeros(n, bool), 0
    for root in range(n):
        if index[root] >= 0:
            continue
        path, below_root = [root], 0
        index[root] = low[root] = met
        met += 1
        while path:
            u = path[-1]
            if place[u] < at[u + 1]:
                v = to[place[u]]
                place[u] += 1
                if index[v] < 0:
                    parent[v] = u
                    index[v] = low[v] = met
                    met += 1
                    path.append(v)
                elif v != parent[u]:
                    low[u] = min(low[u], index[v])
                continue
            path.pop()
            if path:
                p = path[-1]
                low[p] = min(low[p], low[u])
                below_root += p == root
                cut[p] |= p != root and low[u] >= index[p]
        cut[root] = below_root > 1
    return int(cut.sum())
