"""Numpy kernels for one partition: neighbours by cells, nearest points by a tree, local
clusters, OPTICS order, the minimum spanning forest of what one task holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from gridwell.functions import cell_side

_PAIRS_AT_ONCE = 1 << 20
#: Pairs of points that are compared instead of cutting two groups in halves.
_COMPARED = 1 << 12
#: Points of a leaf of the tree, at most.
_LEAF = 32
#: Pairs of points and pairs of leaves that the tree compares at once.
_NEAREST_AT_ONCE, _LEAVES_AT_ONCE = 1 << 16, 1 << 7
#: Edges beyond its own that wait before a forest takes them in.
_EDGES_AT_ONCE = 1 << 17


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest vertex reachable from each, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, label[i], label[j])
        np.minimum.at(new, i, label[j])
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


class _Cells:
    """A partition's points by cells of which each lies within eps of itself."""

    def __init__(self, x: np.ndarray, y: np.ndarray, eps: float):
        self.x, self.y, self.limit = x, y, eps * eps
        side = cell_side(eps)
        cx, cy = np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)
        cx, cy = cx - cx.min(), cy - cy.min()
        self.wide = int(cy.max()) + 5
        key = cx * self.wide + cy + 2
        self.order = np.argsort(key, kind="stable")
        self.keys, self.cell, self.size = np.unique(key, return_inverse=True, return_counts=True)
        self.first = np.cumsum(self.size) - self.size

    def diagonals(self) -> np.ndarray:
        """Each cell's squared diagonal of what it holds."""
        spread = lambda v: np.maximum.reduceat(v, self.first) - np.minimum.reduceat(v, self.first)
        dx, dy = spread(self.x[self.order]), spread(self.y[self.order])
        return dx * dx + dy * dy

    def blocks(self, asked: np.ndarray, among: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of ``asked`` points and their neighbours, of ``among`` only if it
        is given (a mask), in blocks of a bounded size."""
        order = self.order if among is None else self.order[among[self.order]]
        # places of each cell's points among those
        held = np.bincount(self.cell[order], minlength=len(self.keys))
        starts = np.append(0, np.cumsum(held))
        for step in (0, 1, -1, 2, -2):
            # the five cells of a column are neighbours in key order
            key = self.keys[self.cell[asked]] + step * self.wide
            low = starts[np.searchsorted(self.keys, key - 2, "left")]
            n = starts[np.searchsorted(self.keys, key + 2, "right")] - low
            yield from self._close(asked, low, n, order)

    def between(self, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of the points of each of ``one`` and the cell beside it in ``two``."""
        n = self.size[one]
        of = np.repeat(np.arange(len(one)), n)
        asked = self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[one][of]]
        yield from self._close(asked, self.first[two][of], self.size[two][of], self.order)

    def _close(self, asked: np.ndarray, low: np.ndarray, n: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        total, at = np.cumsum(n), 0
        while at < len(asked):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS_AT_ONCE, "right")))
            k = n[at:end]
            i = np.repeat(asked[at:end], k)
            j = order[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[at:end], k)]
            dx, dy = self.x[i] - self.x[j], self.y[i] - self.y[j]
            ok = dx * dx + dy * dy <= self.limit
            yield i[ok], j[ok]
            at = end

    def touching(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether a point of ``a`` is within eps of one of ``b``: halves of what can be in
        reach of the other's box are compared until boxes or few points decide."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            while True:
                size = len(a) + len(b)
                a, b = a[self._to_box(a, b)[0] <= self.limit], b
                b = b[self._to_box(b, a)[0] <= self.limit] if len(a) else b[:0]
                if not len(a) or not len(b) or len(a) + len(b) == size:
                    break
            if not len(a) or not len(b):
                continue
            if (self._to_box(a, b)[1] <= self.limit).any():
                return True
            if len(a) * len(b) <= _COMPARED:
                dx, dy = self.x[a][:, None] - self.x[b], self.y[a][:, None] - self.y[b]
                if (dx * dx + dy * dy <= self.limit).any():
                    return True
                continue
            if len(a) < len(b):
                a, b = b, a
            v = self.x if np.ptp(self.x[a]) >= np.ptp(self.y[a]) else self.y
            middle = len(a) // 2
            halves = a[np.argpartition(v[a], middle)]
            todo += [(halves[:middle], b), (halves[middle:], b)]
        return False

    def _to_box(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest squared distance from each point of ``a`` to the box around ``b``."""
        near, far = 0.0, 0.0
        for v in (self.x, self.y):
            low, high, own = v[b].min(), v[b].max(), v[a]
            gap, most = np.maximum(np.maximum(low - own, own - high), 0), np.maximum(high - own, own - low)
            near, far = near + gap * gap, far + most * most
        return near, far


def local_clusters(group: pd.DataFrame, eps: float, min_points: int) -> pd.DataFrame:
    """For each copy: whether it is a core point here, and the local clusters next to it.

    A local cluster is named by its smallest core id. Core points of other partitions
    may be missed here, but none is found that is not one. A cell with ``min_points`` or
    more is core as a whole; other cells hold so few points that comparing each of them
    with all around stays in proportion to the points.
    """
    group = group.sort_values("id", ignore_index=True)
    x, y, ids = group["x"].to_numpy(), group["y"].to_numpy(), group["id"].to_numpy()
    n = len(group)
    cells = _Cells(x, y, eps)
    full = (cells.size >= min_points) & (cells.diagonals() <= eps * eps)
    core = full[cells.cell]
    rest = np.flatnonzero(~core)
    count = np.zeros(n, np.int64)
    for i, _ in cells.blocks(rest):
        count += np.bincount(i, minlength=n)
    core[rest] = count[rest] >= min_points
    label = _joined(cells, full, core)
    named = ids[label]
    rims = [np.zeros((2, 0), np.int64)]
    for i, j in cells.blocks(np.flatnonzero(~core), core):
        rims.append(np.unique(np.stack([i, named[j]]), axis=1))
    at, name = np.unique(np.concatenate([*rims, np.stack([np.flatnonzero(core), named[core]])], 1), axis=1)
    near = np.split(name, np.searchsorted(at, np.arange(1, n))) if n else []
    return pd.DataFrame({"id": ids, "home": group["home"], "core": core, "clusters": near})


def _joined(cells: _Cells, full: np.ndarray, core: np.ndarray) -> np.ndarray:
    """The smallest place of each core point's cluster. Full cells are one from the start."""
    n = len(core)
    label = np.arange(n)
    least = np.full(len(full), n)
    np.minimum.at(least, cells.cell, label)
    label = np.where(full[cells.cell], least[cells.cell], label)

    def join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = label[i], label[j]
        new = a != b
        return least_labels(n, np.concatenate([a[new], b[new]]), np.concatenate([b[new], a[new]]))[label] if new.any() else label

    for i, j in cells.blocks(np.flatnonzero(core & ~full[cells.cell]), core):
        label = join(label, i, j)
    own = np.flatnonzero(full)
    members = np.split(cells.order, cells.first[1:])
    for dx, dy in sorted(((i, j) for i in range(3) for j in range(-2, 3) if i > 0 or j > 0), key=lambda s: s[0] * s[0] + s[1] * s[1]):
        # the nearest cells first: what they join needs no test later
        at = np.minimum(np.searchsorted(cells.keys, cells.keys[own] + dx * cells.wide + dy), len(full) - 1)
        hit = (cells.keys[at] == cells.keys[own] + dx * cells.wide + dy) & full[at]
        one, two = own[hit], at[hit]
        apart = label[least[one]] != label[least[two]]
        one, two = one[apart], two[apart]
        small = cells.size[one] * cells.size[two] <= _COMPARED
        for i, j in cells.between(one[small], two[small]):
            label = join(label, i, j)
        found = [(a, b) for a, b in zip(one[~small].tolist(), two[~small].tolist(), strict=True) if cells.touching(members[a], members[b])]
        if found:
            a, b = np.array(found).T
            label = join(label, least[a], least[b])
    return label


class _Near:
    """The neighbours of one point at a time, by cells of slightly more than eps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, eps: float):
        side = eps * (1 + 1e-9)
        cx, cy = np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)
        cx, cy = cx - cx.min(), cy - cy.min()
        self.wide = int(cy.max()) + 3
        key = cx * self.wide + cy + 1
        self.order = np.argsort(key, kind="stable")
        keys = key[self.order]
        self.x, self.y, self.limit = x[self.order], y[self.order], eps * eps
        self.own = x, y
        self.runs = [(np.searchsorted(keys, key + d * self.wide - 1, "left"), np.searchsorted(keys, key + d * self.wide + 1, "right")) for d in (-1, 0, 1)]

    def __call__(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and squared distances of the points within eps of the one at ``p``, itself included."""
        at, far = [], []
        px, py = self.own[0][p], self.own[1][p]
        for low, high in self.runs:
            a, b = low[p], high[p]
            if a < b:
                dx, dy = px - self.x[a:b], py - self.y[a:b]
                d2 = dx * dx + dy * dy
                ok = d2 <= self.limit
                at.append(self.order[a:b][ok])
                far.append(d2[ok])
        return np.concatenate(at), np.concatenate(far)


class _Tree:
    """Points halved at medians of the wider axis down to small leaves, with their boxes.

    The k-th nearest of a point in a crowd is near, so that it sees few leaves, where cells
    of eps would compare it with the whole crowd. (For all points within eps cells are faster.)
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, eps: float):
        n = len(x)
        self.limit, self.order = eps * eps, np.arange(n)
        self.bounds = [np.array([0, n])]
        while np.diff(self.bounds[-1]).max() > _LEAF:
            self.bounds.append(self._halved(x, y, self.bounds[-1]))
        self.x, self.y = x[self.order], y[self.order]
        self.boxes = [tuple(f.reduceat(v, b[:-1]) for v in (self.x, self.y) for f in (np.minimum, np.maximum)) for b in self.bounds]
        self.first, self.size = self.bounds[-1][:-1], np.diff(self.bounds[-1])

    def _halved(self, x: np.ndarray, y: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        middles = (bounds[:-1] + bounds[1:]) // 2
        for low, middle, high in zip(bounds[:-1].tolist(), middles.tolist(), bounds[1:].tolist(), strict=True):
            some = self.order[low:high]
            v = x if np.ptp(x[some]) >= np.ptp(y[some]) else y
            self.order[low:high] = some[np.argpartition(v[some], middle - low)]
        return np.sort(np.concatenate([bounds, middles]))

    @staticmethod
    def _gap(box: tuple, low_x: float, high_x: float, low_y: float, high_y: float) -> np.ndarray:
        """Least squared distances between boxes and one box."""
        x1, x2, y1, y2 = box
        dx, dy = np.maximum(np.maximum(x1 - high_x, low_x - x2), 0), np.maximum(np.maximum(y1 - high_y, low_y - y2), 0)
        return dx * dx + dy * dy

    def leaves(self, leaf: int, limit: float) -> np.ndarray:
        """Leaves that may hold points within the squared distance ``limit`` of points of ``leaf``."""
        own = [v[leaf] for v in self.boxes[-1]]
        nodes = np.zeros(1, np.int64)
        for box in self.boxes[1:]:
            nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
            nodes = nodes[self._gap(tuple(v[nodes] for v in box), *own) <= limit]
        return np.sort(nodes)

    def _held(self, leaves: np.ndarray) -> np.ndarray:
        """Places in tree order of all points of some leaves."""
        n = self.size[leaves]
        return np.arange(n.sum()) + np.repeat(self.first[leaves] - (np.cumsum(n) - n), n)

    def kth(self, k: int) -> np.ndarray:
        """Each point's squared distance to its ``k``-th nearest, itself included; infinite beyond eps."""
        out = np.full(len(self.order), np.inf)
        for leaf in range(len(self.size)):
            own = np.arange(self.first[leaf], self.first[leaf] + self.size[leaf])
            limit = self.limit
            if len(own) >= k:
                # k points of its own leaf bound how far a point has to look
                limit = min(limit, self._kth(own, own, k).max())
                if limit == 0:
                    # all in places of k points, however many more are there
                    out[self.order[own]] = 0
                    continue
            among = self._held(self.leaves(leaf, limit))
            if len(among) >= k:
                rows = max(1, _NEAREST_AT_ONCE // len(among))
                for at in range(0, len(own), rows):
                    some = own[at : at + rows]
                    out[self.order[some]] = self._kth(some, among, k)
        out[out > self.limit] = np.inf
        return out

    def _kth(self, asked: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
        dx, dy = self.x[asked][:, None] - self.x[among], self.y[asked][:, None] - self.y[among]
        return np.partition(dx * dx + dy * dy, k - 1, axis=1)[:, k - 1]


class _Heap:
    """Numbers below n by (key, number), each at most once: a lowered key moves its number up."""

    def __init__(self, n: int):
        self.items: list[tuple[float, int]] = []
        self.at = [-1] * n

    def __len__(self) -> int:
        return len(self.items)

    def lower(self, key: float, number: int) -> None:
        """Put in a number, or lower its key."""
        at = self.at[number]
        if at < 0:
            at = len(self.items)
            self.items.append((key, number))
        self._rise(at, (key, number))

    def _rise(self, at: int, item: tuple[float, int]) -> None:
        items, places = self.items, self.at
        while at and item < items[above := (at - 1) >> 1]:
            items[at] = items[above]
            places[items[at][1]] = at
            at = above
        items[at] = item
        places[item[1]] = at

    def pop(self) -> int:
        """The number of the least (key, number)."""
        items, places = self.items, self.at
        number, last = items[0][1], items.pop()
        places[number] = -1
        if items:
            # the smaller child moves up to the bottom, the last item rises from there
            at, n = 0, len(items)
            while (below := 2 * at + 1) < n:
                if below + 1 < n and items[below + 1] < items[below]:
                    below += 1
                items[at] = items[below]
                places[items[at][1]] = at
                at = below
            self._rise(at, last)
        return number


def optics_order(group: pd.DataFrame, eps: float, min_points: int) -> pd.DataFrame:
    """Order, reachability and core distance of a partition's points. Neighbours are
    looked up point by point; no list of all pairs is held.

    Next comes the unprocessed point of the least (reachability, id); without a finite
    one the unprocessed point of the smallest id starts anew.
    """
    group = group.sort_values("id", ignore_index=True)
    x, y, ids = group["x"].to_numpy(), group["y"].to_numpy(), group["id"].to_numpy()
    n = len(group)
    near = _Near(x, y, eps)
    core = np.full(n, np.inf)
    reach, done, position = np.full(n, np.inf), np.zeros(n, bool), np.zeros(n, np.int64)
    heap = _Heap(n)
    seed = 0
    for step in range(n):
        if heap:
            p = heap.pop()
        else:
            while done[seed]:
                seed += 1
            p = seed
        done[p], position[p] = True, step
        q, d2 = near(p)
        if len(q) >= min_points:
            d = np.sqrt(d2)
            core[p] = np.partition(d, min_points - 1)[min_points - 1]
            new = np.maximum(core[p], d)
            better = ~done[q] & (new < reach[q])
            reach[q[better]] = new[better]
            for r, k in zip(new[better].tolist(), q[better].tolist(), strict=True):
                heap.lower(r, k)
    undefined = lambda v: np.where(np.isfinite(v), v, np.nan)
    return pd.DataFrame({"id": ids, "pos": position, "reach": undefined(reach), "core_dist": undefined(core), "x": x, "y": y})


def kth_distances(group: pd.DataFrame, eps: float, k: int) -> pd.DataFrame:
    """(id, core2) of a partition's own points that have ``k`` points, themselves included,
    within eps: the squared distance of the k-th nearest."""
    far = _Tree(group["x"].to_numpy(), group["y"].to_numpy(), eps).kth(k)
    own = group["home"].to_numpy() & np.isfinite(far)
    return pd.DataFrame({"id": group["id"].to_numpy()[own], "core2": far[own]})


def spanning(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b) between ``n`` vertices that are the minimum spanning
    forest by ``rank``, an array that sorts them without ties."""
    order = np.argsort(rank)
    a, b, at = a[order], b[order], order
    taken = []
    while len(at):
        least, own = np.full(n, len(at)), np.arange(len(at))
        np.minimum.at(least, a, own)
        np.minimum.at(least, b, own)
        edges = np.unique(least[least < len(at)])
        taken.append(at[edges])
        label = least_labels(n, np.concatenate([a[edges], b[edges]]), np.concatenate([b[edges], a[edges]]))
        a, b = label[a], label[b]
        apart = a != b
        a, b, at = a[apart], b[apart], at[apart]
    return np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)


class _Forest:
    """A minimum spanning forest by (w, a, b) that takes edges in by blocks, a < b."""

    def __init__(self, n: int):
        self.n = n
        self.edges = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.wait: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.label, self.most = np.arange(n), np.full(n, np.inf)

    def add(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        # what is joined by lesser edges alone needs no more of this weight
        open_ = (self.label[a] != self.label[b]) | (w <= self.most[self.label[a]])
        self.wait.append((w[open_], a[open_], b[open_]))
        self.waiting += int(open_.sum())
        if self.waiting >= _EDGES_AT_ONCE + len(self.edges[0]):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The forest (w, a, b) of all edges so far."""
        w, a, b = (np.concatenate(c) for c in zip(self.edges, *self.wait, strict=True))
        rank = np.empty(len(w), np.int64)
        rank[np.lexsort((b, a, w))] = np.arange(len(w))
        kept = spanning(self.n, a, b, rank)
        w, a, b = self.edges = w[kept], a[kept], b[kept]
        self.wait, self.waiting = [], 0
        self.label = least_labels(self.n, np.concatenate([a, b]), np.concatenate([b, a]))
        self.most = np.full(self.n, -np.inf)
        np.maximum.at(self.most, self.label[a], w)
        return self.edges


class _Reach:
    """Pairs of a partition's core points by mutual reachability, in a tree of the points.

    Nodes are looked at in pairs from the root down. A pair is left out if it lies too far
    apart, or if both nodes are of one component; of two nodes that are of a component
    each, if two others of the same components are surely as near.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, core2: np.ndarray, eps: float):
        self.tree = tree = _Tree(x, y, eps)
        self.least = [np.minimum.reduceat(core2[tree.order], b[:-1]) for b in tree.bounds]
        # leaves side by side; what fills them up compares as false
        held = np.arange(_LEAF) < tree.size[:, None]
        self.place = tree.order[np.where(held, tree.first[:, None] + np.arange(_LEAF), 0)]
        self.x, self.y = (np.where(held, v[self.place], np.nan) for v in (x, y))
        self.core2 = core2[self.place]

    def _weights(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dx, dy = (v[a][:, :, None] - v[b][:, None, :] for v in (self.x, self.y))
        return np.maximum(np.maximum(self.core2[a][:, :, None], self.core2[b][:, None, :]), dx * dx + dy * dy)

    def radii(self) -> np.ndarray:
        """Rising squared radii up to eps, each four times the one before, from where few leaves have any pair."""
        least = []
        for at in range(0, len(self.place), _LEAVES_AT_ONCE):
            own = np.arange(at, min(at + _LEAVES_AT_ONCE, len(self.place)))
            w = self._weights(own, own)
            least.append(np.where(w > 0, w, np.inf).min((1, 2)))
        first = np.quantile(np.concatenate(least), 0.01, method="lower")
        halvings = int(np.clip(np.log2(self.tree.limit / first) // 2, 0, 40)) if np.isfinite(first) else 0
        return self.tree.limit / 4.0 ** np.arange(halvings, -1, -1)

    def between(self, label: np.ndarray, high: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(w, i, j) of weights up to ``high``, with the least of each two components of ``label`` among them."""
        tree, own = self.tree, label[self.tree.order]
        a = b = np.zeros(1, np.int64)
        for level, (bounds, box, least) in enumerate(zip(tree.bounds, tree.boxes, self.least, strict=True)):
            if level:
                two = a != b
                a, b = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a[two] + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b + 1, 2 * b[two]])
            low, top = np.minimum.reduceat(own, bounds[:-1]), np.maximum.reduceat(own, bounds[:-1])
            x1, x2, y1, y2 = (v[b] for v in box)
            core2 = np.maximum(least[a], least[b])
            near = np.maximum(tree._gap(tuple(v[a] for v in box), x1, x2, y1, y2), core2)
            ok = (near <= high) & ((low[a] != top[b]) | (top[a] != low[b]))
            a, b, near, core2 = a[ok], b[ok], near[ok], core2[ok]
            most = np.full(len(a), high)
            single = np.flatnonzero((low[a] == top[a]) & (low[b] == top[b]))
            if len(single):
                i, j = a[single], b[single]
                dx, dy = (np.maximum(v2[i] - v1[j], v2[j] - v1[i]) for v1, v2 in (box[:2], box[2:]))
                pair = np.minimum(low[i], low[j]) * len(label) + np.maximum(low[i], low[j])
                names, at = np.unique(pair, return_inverse=True)
                bound = np.full(len(names), high)
                np.minimum.at(bound, at, np.maximum(dx * dx + dy * dy, core2[single]))
                most[single] = bound[at]
                ok = near <= most
                a, b, near, most = a[ok], b[ok], near[ok], most[ok]
        label, order = label[self.place], np.argsort(near, kind="stable")
        once = np.triu(np.ones((_LEAF, _LEAF), bool), 1)
        for at in range(0, len(order), _LEAVES_AT_ONCE):
            some = order[at : at + _LEAVES_AT_ONCE]
            i, j = a[some], b[some]
            w = self._weights(i, j)
            ok = (w <= most[some][:, None, None]) & (label[i][:, :, None] != label[j][:, None, :])
            ok[i == j] &= once
            k, m, n = np.nonzero(ok)
            yield w[k, m, n], self.place[i[k], m], self.place[j[k], n]


def partition_forest(group: pd.DataFrame, eps: float) -> pd.DataFrame:
    """(i, j, w), i < j: those edges of the minimum spanning forest of all pairs within eps of
    which one end is home here, weighed by squared mutual reachability. Reads id, x, y, home, core2.

    By rising radii: what lesser edges have joined is compared no more. Memory goes with
    the points, not with their pairs.
    """
    group = group.sort_values("id", ignore_index=True)
    x, y, ids, home, core2 = (group[c].to_numpy() for c in ("x", "y", "id", "home", "core2"))
    # core points in one place, at no distance from enough others: a star around the least id
    place = np.flatnonzero(core2 == 0)
    place = place[np.lexsort((place, y[place], x[place]))]
    new = np.append(True, (np.diff(x[place]) != 0) | (np.diff(y[place]) != 0))[: len(place)]
    centre = place[np.flatnonzero(new)[np.cumsum(new) - 1]]
    star = centre[~new], place[~new]
    kept = np.delete(np.arange(len(group)), star[1])
    reach, forest = _Reach(x[kept], y[kept], core2[kept], eps), _Forest(len(kept))
    for high in reach.radii():
        for w, i, j in reach.between(forest.label, high):
            forest.add(w, np.minimum(i, j), np.maximum(i, j))
        w, a, b = forest.settle()
    w, a, b = np.append(w, np.zeros(len(star[0]))), np.append(kept[a], star[0]), np.append(kept[b], star[1])
    own = home[a] | home[b]
    return pd.DataFrame({"i": ids[a[own]], "j": ids[b[own]], "w": w[own]})
