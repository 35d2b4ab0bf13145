"""The recursive join inside a region of shingle sets, in one task.

Distances are Jaccard's, d = 1 - common / union, a metric.  Pivots are members of the region;
every member's distance to all of them is known, its home is the nearest pivot's region
(Voronoi), and the boundary windows replicate it to each other pivot p with
d(x, p) <= d(x, home) + 2 r whose ring |d(x, p) - d(y, p)| <= r holds a member at home there.
Two sets within r of each other meet in the home region of either, so the recursion loses no
link.  Members that are linked already, through any chain, need no comparison.

A set of which the others hold less than the similarity's share has no link in the region and
takes no part; what it alone held is then no longer shared, and so on.

Common shingles of many pairs come from products of 0/1 matrices over the shingles that
members share, exact in single precision, a block of rows and of columns at a time.
"""

from __future__ import annotations

import numpy as np

LEAF = 256
PIVOTS = 12
_ROWS, _COLUMNS = 1024, 4096


class Links:
    """Components of rows, and the links that made them."""

    def __init__(self, ids: np.ndarray):
        _, first, same = np.unique(ids, return_index=True, return_inverse=True)
        self.parent = first[same]  # rows that share an id are one from the start
        self.found: list[tuple[int, int]] = []

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.parent
        while True:
            up = at[at]
            if (up == at).all():
                break
            at = up
        self.parent = at
        return at[rows]

    def _find(self, x: int) -> int:
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self._find(x), self._find(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.found.append((x, y))


class Shared:
    """Rows of keys as a 0/1 matrix over the keys that rows share.

    ``least``: how many of its keys each row must share with others to take part at all.
    """

    def __init__(self, keys: np.ndarray, bounds: np.ndarray, least: np.ndarray):
        n = len(bounds) - 1
        column, row = np.unique(keys, return_inverse=True)[1], np.repeat(np.arange(n), np.diff(bounds))
        self.active = np.ones(n, bool)
        while True:
            count = np.bincount(column)
            shared = count[column] > 1  # a key of one row adds to no intersection
            still = self.active & (np.bincount(row[shared], minlength=n) >= least)
            keep = still[row] & shared
            column, row = column[keep], row[keep]
            done = still.sum() == self.active.sum()
            self.active = still
            if done:
                break
        number = np.unique(column, return_inverse=True)
        self.columns, self.width = number[1], len(number[0])
        self.rows = np.searchsorted(row, np.arange(n + 1))

    def _block(self, rows: np.ndarray, low: int, high: int) -> np.ndarray:
        out = np.zeros((len(rows), high - low), np.float32)
        for i, r in enumerate(rows.tolist()):
            c = self.columns[self.rows[r] : self.rows[r + 1]]
            if high - low < self.width:
                c = c[np.searchsorted(c, low) : np.searchsorted(c, high)] - low
            out[i, c] = 1
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), np.float32)
        for low in range(0, self.width, _COLUMNS):
            high = min(self.width, low + _COLUMNS)
            x = self._block(a, low, high)
            for k in range(0, len(b), _ROWS):
                out[:, k : k + _ROWS] += x @ self._block(b[k : k + _ROWS], low, high).T
        return out


def drawn(n: np.ndarray, share: int) -> np.ndarray:
    """How many shingles a set of n brings."""
    return np.minimum(n, -(-share * n // 100) + 1)


def least_shared(n: np.ndarray, percent: int, share: int) -> np.ndarray:
    """How many of the shingles that it brings a set of n shares with any one that it links with."""
    return (share - (100 - percent)) * percent * n // 10000 + 1


def with_partners(keys: np.ndarray, bounds: np.ndarray, n: np.ndarray, ids: np.ndarray, percent: int, share: int) -> np.ndarray:
    """Which rows may link with another of these, judged by the shingles of least hash.

    A linked pair has at least percent / (100 + percent) of both sizes in common; of the
    shingles that x brings the other lacks no more than it lacks of x altogether.
    """
    work, brought = Shared(keys, bounds, least_shared(n, percent, share)), drawn(n, share)
    rows, found = np.flatnonzero(work.active), np.zeros(len(n), bool)
    for k in range(0, len(rows), LEAF):
        a = rows[k : k + LEAF]
        both = -(-percent * (n[a][:, None] + n[rows][None, :]) // (100 + percent))
        need = np.minimum((brought[a] - n[a])[:, None] + both, (brought[rows] - n[rows])[None, :] + both)
        near = (work.common(a, rows) >= np.maximum(need, 1)) & (ids[a][:, None] != ids[rows][None, :])
        found[a] |= near.any(1)
    return found


class Region(Shared):
    """Sets as flat keys with bounds; ``percent`` is the similarity from which two link."""

    def __init__(self, keys: np.ndarray, bounds: np.ndarray, ids: np.ndarray, percent: int):
        self.percent, self.size, self.links = percent, np.diff(bounds), Links(ids)
        self.apart = 1 - percent / 100 + 1e-9
        super().__init__(keys, bounds, -(-percent * self.size // 100))

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """d of every row of ``a`` to every row of ``b``; rows that link are joined."""
        common = self.common(a, b).astype(np.int64)
        union = self.size[a][:, None] + self.size[b][None, :] - common
        i, j = np.nonzero(100 * common >= self.percent * union)
        x, y = a[i], b[j]
        new = self.links.roots(x) != self.links.roots(y)
        self.links.add(x[new], y[new])
        return 1 - common / union

    def against(self, queries: np.ndarray, members: np.ndarray) -> None:
        """Compare each query with the members that aren't in its component."""
        queries, members = queries[self.active[queries]], members[self.active[members]]
        for k in range(0, len(queries), LEAF):
            block = queries[k : k + LEAF]
            if len(np.unique(self.links.roots(np.concatenate([block, members])))) > 1:
                self.distances(block, members)

    def _outside(self, rows: np.ndarray) -> np.ndarray:
        """Rows that aren't in the largest component among these."""
        roots = self.links.roots(rows)
        some, count = np.unique(roots, return_counts=True)
        return rows[roots != some[np.argmax(count)]]

    def resolve(self, rows: np.ndarray, first: int | None = None) -> None:
        """Find all links among ``rows``; ``first`` is the region's pivot."""
        rows = rows[self.active[rows]]
        if len(rows) < 2:
            return
        if first is not None and self.active[first]:
            self.distances(np.array([first]), rows)
        outside = self._outside(rows)
        if not len(outside):
            return
        if len(outside) <= LEAF:
            self.against(outside, rows)
            return
        # new pivots: members of different components, the smallest components' too
        _, at = np.unique(self.links.roots(outside), return_index=True)
        pivots = outside[np.sort(at)[np.linspace(0, len(at) - 1, min(PIVOTS, len(at))).astype(np.int64)]]
        d = self.distances(pivots, rows)
        home, near = d.argmin(0), d.min(0)
        for j in range(len(pivots)):
            own = home == j
            if not own.any():
                continue
            window = (d[j] <= near + 2 * self.apart) & (d[j] >= d[j][own].min() - self.apart) & (d[j] <= d[j][own].max() + self.apart)
            inner = rows[own | window]
            if 4 * len(inner) <= 3 * len(rows):
                self.resolve(inner)
            else:  # a region that pivots don't divide any more: who is at home, against all of its window
                roots = self.links.roots(inner)
                some, count = np.unique(roots, return_counts=True)
                most = some[np.argmax(count)]
                mine = np.isin(inner, rows[own])
                self.against(inner[mine & (roots != most)], inner)
                self.against(inner[mine & (roots == most)], inner[~mine & (roots != most)])
