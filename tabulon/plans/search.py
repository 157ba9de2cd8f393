"""The k nearest of the rows that one task holds, for many queries at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabulon.functions.distance import Metric
from tabulon.plans.tree import Bounds, Splits

#: Features up to which a task's rows are split into leaves of about so many rows.
TREE_WIDTH, LEAF_ROWS = 15, 128
#: Distances held at once, those of a tile (it stays in a core's cache), rows of a group of which one minimum is kept, pairs refined at once.
HELD, TILE, GROUP, REFINED = 1 << 21, 1 << 14, 32, 1 << 16


def first_of_equal(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows of ``x`` with fewer than ``k`` equal rows before them."""
    x = np.ascontiguousarray(x + 0.0)  # one zero
    if not x.shape[1]:
        return np.arange(min(k, len(x)))
    value = x[:, 0] if x.shape[1] == 1 else x.view(np.dtype((np.void, x.shape[1] * 8)))[:, 0]
    order = np.argsort(value, kind="stable")
    new = value[order][1:] != value[order][:-1]
    if new.all():
        return np.arange(len(x))
    starts = np.flatnonzero(np.concatenate([[True], new]))
    rank = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    return np.sort(order[rank < k])


def top(row: np.ndarray, col: np.ndarray, power: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` least of each row, sorted by row, power and column."""
    order = np.lexsort((col, power, row))
    row, col, power = row[order], col[order], power[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], power[keep]


class Held:
    """Rows with their ids. Of equal rows only the ``k`` smallest ids stay: a query that finds one finds them first.

    Few features: leaves of a tree that a query's bounds rule out are not searched. Many: every row gets a value that is near its power sum and
    cheap (a product for order 2), and what it can't rule out is measured by direct differences. Results are those of direct
    differences alone, ties to the smaller id.
    """

    def __init__(self, ids: pa.Array, x: np.ndarray, k: int, metric: Metric, leaf_size: int = LEAF_ROWS, tree: bool = True):
        order = pc.sort_indices(ids).to_numpy()
        order = order[first_of_equal(x[order], k)]
        self.k, self._metric = k, metric
        self._bounds = None
        x = x[order]
        leaf = max(LEAF_ROWS, leaf_size, k)
        if tree and x.shape[1] <= TREE_WIDTH and len(x) > 2 * leaf:
            splits = Splits.of(x, len(x) // leaf)
            at = splits.leaves_of(x)
            own = np.argsort(at, kind="stable")
            self._rank = own  # ids ascend with a row's place before
            self._at, x = at[own], x[own]
            order = order[own]
            self._bounds = Bounds.around(x, self._at, splits.leaves, metric)
        self.ids, self._x = ids.take(pa.array(order)), x
        with np.errstate(all="ignore"):
            self._columns = np.ascontiguousarray(x.T, dtype=np.float32 if metric.p >= 1 and metric.p != 2 else float)
            self._squares = np.einsum("ij,ij->i", x, x)
            self._norm = (np.abs(x) ** metric.p).sum(axis=1).max(initial=0.0) ** (1 / metric.p)

    def best(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``q``, place in ``ids``, power sum), sorted by row and nearness."""
        with np.errstate(all="ignore"):
            search, wide = (self._by_tile, len(self._x)) if self._bounds is None else (self._by_leaf, len(self._bounds.count) * max(8, self.k))
            step = max(1, HELD // max(1, wide))
            parts = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
            for i in range(0, len(q), step) if len(self._x) else ():
                row, col, power = search(np.ascontiguousarray(q[i : i + step]))
                parts.append((row + i, col, power))
            return tuple(np.concatenate(c) for c in zip(*parts))

    def _by_leaf(self, q: np.ndarray):
        asker, leaf = np.nonzero(self._bounds.needed(q, self.k))
        order = np.argsort(leaf, kind="stable")
        asker, leaf = asker[order], leaf[order]
        cuts = np.flatnonzero(np.diff(leaf, prepend=-1))
        found = [(asker[:0], asker[:0], np.zeros(0))]
        for a, b in zip(cuts, [*cuts[1:], len(leaf)]):
            lo, hi = np.searchsorted(self._at, [leaf[a], leaf[a] + 1])
            step = max(1, HELD // (hi - lo))
            for i in range(a, b, step):
                own = asker[i : min(b, i + step)]
                power = self._metric.powers(q[own], self._x[lo:hi])
                if self.k < hi - lo:  # ties at the k-th place: the smaller ids, which are first in a leaf, and at most k of each value
                    r, c = np.nonzero(power <= np.partition(power, self.k - 1, axis=1)[:, self.k - 1 : self.k])
                else:
                    r, c = np.nonzero(power == power)
                found.append((own[r], lo + c, power[r, c]))
        row, col, power = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((self._rank[col], power, row))
        row, col, power = row[order], col[order], power[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[keep], col[keep], power[keep]

    def _near(self, q: np.ndarray) -> np.ndarray:
        """Values that rank each query's rows about as power sums do: products for order 2, else power sums, in single precision from order 1 on."""
        p, width = self._metric.p, q.shape[1]
        if p == 2:
            near = q @ self._columns
            near *= -2.0
            near += self._squares
            return near
        kind = self._columns.dtype
        near = np.empty((len(q), len(self._x)), kind)
        whole = int(p) if p in (1, 3, 4, 5, 6) else 0
        q = q.astype(kind)
        tall, broad = TILE // 1024, 1024
        for j in range(0, len(self._x), broad):
            columns = self._columns[:, j : j + broad]
            for i in range(0, len(q), tall):
                rows = np.ascontiguousarray(q[i : i + tall].T)
                out = near[i : i + tall, j : j + broad]
                total, gap, power = np.zeros(out.shape, kind), np.empty(out.shape, kind), np.empty(out.shape, kind)
                for f in range(width):
                    np.subtract(rows[f][:, None], columns[f], out=gap)
                    np.abs(gap, out=gap)
                    if whole == 1:
                        total += gap
                        continue
                    if whole:
                        np.multiply(gap, gap, out=power)
                        for _ in range(whole - 2):
                            power *= gap
                    else:
                        np.power(gap, kind.type(p), out=power)
                    total += power
                out[...] = total
        return near

    def _limit(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """What no value of ``_near`` is above whose power sum is at most the k-th least, where ``kth`` is no less than the k-th least value."""
        p, width = self._metric.p, q.shape[1]
        unit = np.finfo(self._columns.dtype).eps
        if p == 2:
            reach = np.sqrt(np.einsum("ij,ij->i", q, q)) + np.sqrt(self._squares.max())
            return kth + 16 * (width + 8) * unit * reach * reach
        share = 1 + 4 * (width + 8 * p) * unit
        if p < 1:
            return kth * share
        # Rounded points are off by so much at most, and distances obey the triangle inequality.
        off = 4 * unit * ((np.abs(q) ** p).sum(axis=1) ** (1 / p) + self._norm)
        return ((kth.astype(float) * share + width * 1e-36) ** (1 / p) + off) ** p * share

    def _by_tile(self, q: np.ndarray):
        near = self._near(q)
        n, m = near.shape
        k = min(self.k, m)
        whole = m // GROUP * GROUP
        if m // GROUP > 4 * k:  # the k-th least minimum of groups is no less than the k-th least value
            least = np.concatenate([near[:, :whole].reshape(n, -1, GROUP).min(axis=2), near[:, whole:]], axis=1)
            kth = np.partition(least, k - 1, axis=1)[:, k - 1]
        else:
            least, kth = None, np.partition(near, k - 1, axis=1)[:, k - 1]
        limit = self._limit(q, kth)
        plain = ~np.isfinite(limit)
        limit[plain] = -np.inf
        if least is None:
            row, col = np.nonzero(near <= limit[:, None])
        else:
            r, g = np.nonzero(least <= limit[:, None])
            tail = g >= whole // GROUP
            r2, c2 = r[tail], whole + g[tail] - whole // GROUP
            r, g = r[~tail], g[~tail]
            inside = near[:, :whole].reshape(n, -1, GROUP)
            i, c = np.nonzero(inside[r, g] <= limit[r, None])
            row, col = np.concatenate([r[i], r2]), np.concatenate([g[i] * GROUP + c, c2])
        del near
        power = np.empty(len(row))
        for i in range(0, len(row), REFINED):
            power[i : i + REFINED] = self._metric.paired(q[row[i : i + REFINED]], self._x[col[i : i + REFINED]])
        found = [top(row, col, power, self.k)]
        odd = np.flatnonzero(plain)  # values beyond what products can hold, if any
        for i in range(0, len(odd), max(1, HELD // m)):
            own = odd[i : i + max(1, HELD // m)]
            direct = self._metric.powers(q[own], self._x)
            r, c = np.nonzero(direct <= np.partition(direct, k - 1, axis=1)[:, k - 1 : k])
            found.append(top(own[r], c, direct[r, c], self.k))
        if len(odd):
            return top(*(np.concatenate(c) for c in zip(*found)), self.k)
        return found[0]
