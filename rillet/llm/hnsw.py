"""A hierarchical navigable small-world graph over unit vectors, built and searched in blocks of vectors with numpy.

Nodes stand in a fixed order and layer l holds the first sizes[l] of them, so the layers are nested prefixes and the top one
is small enough to be scanned. A layer starts from the graph of the layer above and takes its further nodes in batches:
each batch is searched in the graph so far, compared with itself, and linked both ways under the usual diversity rule.
"""

from __future__ import annotations

import numpy as np

M, TOP, SHRINK, BATCH, BUILD_BEAM, WIDE = 24, 64, 16, 512, 48, 4


def _gather_dot(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(b, c) inner products of q[b] with x[rows[b, c]]."""
    return np.matmul(x[rows], q[:, :, None])[:, :, 0]


class Graph:
    def __init__(self, x: np.ndarray, links: np.ndarray | None = None):
        """x: (n, d) float32 unit vectors. links: (n, M) of an earlier build, else the graph is built."""
        self.x, n = x, len(x)
        self.sizes = [n]
        while self.sizes[-1] > TOP:
            self.sizes.append(max(TOP // 2, self.sizes[-1] // SHRINK))
        self.layers: list[np.ndarray] = []
        if links is not None:
            self.layers = [links[sum(self.sizes[:i]) : sum(self.sizes[: i + 1])] for i in range(len(self.sizes))]
            return
        top = self.sizes[-1]
        graph = np.full((top, M), -1, np.int32)
        if top > 1:
            sims = x[:top] @ x[:top].T
            np.fill_diagonal(sims, -np.inf)
            near = np.argsort(-sims, axis=1, kind="stable")[:, : min(2 * M, top - 1)].astype(np.int32)
            graph[:] = self._choose(x[:top], near, np.take_along_axis(sims, near, 1))
        self.layers = [graph]
        for size in self.sizes[-2::-1]:
            self._grow(size)
        self.layers.reverse()

    @property
    def links(self) -> np.ndarray:
        return np.concatenate(self.layers)

    def _choose(self, q: np.ndarray, near: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """(b, M) of candidates ``near`` (by falling ``sims``, -1 none): first those nearer to q than to any chosen one,
        then the nearest of the others."""
        v = self.x[near]
        among = np.matmul(v, v.transpose(0, 2, 1))
        b, c = near.shape
        chosen, count = np.zeros((b, c), bool), np.zeros(b, np.int64)
        for i in range(c):
            apart = ~((among[:, i] > sims[:, i, None]) & chosen).any(1)
            chosen[:, i] = apart & (count < M) & (near[:, i] >= 0)
            count += chosen[:, i]
        rank = np.argsort(np.where(near < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :M]
        out = np.full((b, M), -1, np.int32)
        out[:, : rank.shape[1]] = np.take_along_axis(near, rank, 1)
        return out

    def _grow(self, size: int) -> None:
        """The next layer down: all nodes up to ``size``."""
        above = self.layers
        base = len(above[-1])
        graph = np.full((size, M), -1, np.int32)
        graph[:base] = above[-1]
        at = base
        while at < size:
            end = min(size, at + min(BATCH, max(64, at // 2)))
            q = self.x[at:end]
            near, sims = self._beam(graph, q, self._entries(q, above[::-1], base), BUILD_BEAM)
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            mates = np.argsort(-own, axis=1, kind="stable")[:, : min(M, len(q) - 1)]
            near = np.concatenate([near, (mates + at).astype(np.int32)], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, mates, 1)], 1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * M]
            graph[at:end] = self._choose(q, np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1))
            self._link_back(graph, at, end)
            at = end
        above.append(graph)

    def _link_back(self, graph: np.ndarray, at: int, end: int) -> None:
        to = graph[at:end].ravel()
        new = np.repeat(np.arange(at, end, dtype=np.int32), M)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        nodes, start, count = np.unique(to, return_index=True, return_counts=True)
        for s in range(0, len(nodes), BATCH):
            some, n = nodes[s : s + BATCH], count[s : s + BATCH]
            # Of very many new neighbours a node looks at the last 2 M; a graph needs no more and the results don't rest on it.
            width = min(int(n.max()), 2 * M)
            back = np.full((len(some), width), -1, np.int32)
            for i in range(width):
                has = n > i
                back[has, i] = new[(start[s : s + BATCH] + n - 1 - i)[has]]
            both = np.concatenate([graph[some], back], 1)
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sims = np.where(both < 0, -np.inf, _gather_dot(self.x, both, self.x[some]))
            order = np.argsort(-sims, axis=1, kind="stable")
            graph[some] = self._choose(self.x[some], np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1))

    def _entries(self, q: np.ndarray, layers: list[np.ndarray], top: int | None = None) -> np.ndarray:
        """Entry nodes for the layer under ``layers`` (lowest first)."""
        first = len(layers[-1])
        sims = q @ self.x[:first].T
        k = min(WIDE, first)
        entry = np.argpartition(-sims, k - 1, axis=1)[:, :k].astype(np.int32)
        for graph in layers[-2::-1]:
            entry = self._beam(graph, q, entry, 2 * WIDE)[0][:, :WIDE]
        return entry

    def _beam(self, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes met (-1: fewer) by falling similarity, expanding the best WIDE unexpanded ones at a time."""
        b, n = len(q), len(graph)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True  # stands for -1
        rows = np.arange(b)[:, None]
        entry = np.where(entry < 0, n, entry)
        seen[rows, entry] = True
        ids = np.full((b, width), n, np.int32)
        sims = np.full((b, width), -np.inf, np.float32)
        done = np.ones((b, width), bool)
        k = min(entry.shape[1], width)
        ids[:, :k] = entry[:, :k]
        sims[:, :k] = np.where(entry[:, :k] < n, _gather_dot(self.x, np.minimum(entry[:, :k], n - 1), q), -np.inf)
        done[:, :k] = entry[:, :k] == n
        live = np.arange(b)
        while len(live := live[~done[live].all(1)]):
            li, ls, ld = ids[live], sims[live], done[live]
            pick = np.argsort(np.where(ld, np.inf, -ls), axis=1, kind="stable")[:, :WIDE]
            fit = ~np.take_along_axis(ld, pick, 1)
            np.put_along_axis(ld, pick, True, 1)
            nb = graph[np.where(fit, np.take_along_axis(li, pick, 1), 0)]
            nb = np.where(fit[:, :, None] & (nb >= 0), nb, n).reshape(len(live), -1)
            nb.sort(axis=1)
            new = ~seen[live[:, None], nb]
            new[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            nb = np.where(new, nb, n)
            seen[live[:, None], nb] = True
            found = np.where(new, _gather_dot(self.x, np.minimum(nb, n - 1), q[live]), -np.inf)
            li, ls, ld = np.concatenate([li, nb], 1), np.concatenate([ls, found], 1), np.concatenate([ld, ~new], 1)
            best = np.argpartition(-ls, width - 1, axis=1)[:, :width]
            ids[live], sims[live], done[live] = (np.take_along_axis(a, best, 1) for a in (li, ls, ld))
        order = np.argsort(-sims, axis=1, kind="stable")
        ids = np.take_along_axis(ids, order, 1)
        return np.where(ids == n, -1, ids), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        width = min(width, len(self.x))
        if len(self.layers) == 1:
            sims = q @ self.x.T
            ids = np.argsort(-sims, axis=1, kind="stable")[:, :width].astype(np.int32)
            return ids, np.take_along_axis(sims, ids, 1)
        return self._beam(self.layers[0], q, self._entries(q, self.layers[1:]), width)
