"""One level of growth on whole batches: rows walked to their nodes, histograms of open nodes, best splits.

The functions on arrays are shared by the two ways of growing: over all partitions (growth) and
inside one task (local_growth).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa

from grovelight.functions.expressions import ladder, uniform_array
from grovelight.operators.sampling import draw_many, node_key

if TYPE_CHECKING:
    from grovelight.operators.growth import Model, Shape

PARTIAL = pa.schema([("forest", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
PARTIAL_DDL = "forest int, tree int, node int, at array<int>, n array<bigint>"
SIDES = ("left", "right", "missing", "all")
BEST = pa.schema(
    [("forest", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("pos", pa.int32()), ("categorical", pa.bool_()), ("bin", pa.int32()), ("score", pa.float64())]
    + [(f"{s}_{x}", pa.int64()) for s in SIDES for x in ("n", "label", "ok")]
)
BEST_DDL = "forest int, tree int, node int, feature int, pos int, categorical boolean, bin int, score double, " + ", ".join(f"{s}_{x} bigint" for s in SIDES for x in ("n", "label", "ok"))
DENSE = 1 << 20  # cells of one tree's histogram that are held as an array; beyond that as counted keys
HELD = 4_000_000  # counted keys that a task holds before it gives them out
CELLS = 1 << 21  # cells of histograms scored together


@dataclass
class Space:
    """Sizes of a forest's histograms: candidates of a node, bins (0 is for missing values), classes."""

    k: int
    bins: int
    classes: int

    @property
    def cells(self) -> int:
        return self.k * self.bins * self.classes


def space(shape: Shape, forest: int) -> Space:
    bins = max((shape.categorical.get(f) or min(shape.fine(f), shape.coarse[forest]) for f in range(shape.features)), default=1) + 1
    return Space(min(shape.per_node[forest], shape.features), bins, shape.classes)


def candidates(shape: Shape, forest: int, tree: Sequence[int] | np.ndarray | int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features drawn for each node, in the order drawn, and whether they are categorical."""
    drawn = draw_many(node_key(forest, np.asarray(tree, np.int64), nodes.astype(np.int64)), shape.features, shape.per_node[forest], shape.seed)
    flags = np.zeros(max(1, shape.features), bool)
    flags[list(shape.categorical)] = True
    return drawn, flags[drawn]


def coarse(bins: np.ndarray | SparseBins, shape: Shape, forest: int) -> np.ndarray | SparseBins:
    """The forest's bins of fine ones."""
    limit = shape.coarse[forest]
    fine = np.array([0 if f in shape.categorical else shape.fine(f) for f in range(shape.features)])
    if not (fine > limit).any():
        return bins

    def fold(b: np.ndarray, fine: np.ndarray) -> np.ndarray:
        return np.where((fine <= limit) | (b == 0), b, np.minimum(limit, np.maximum(1, (b / (np.maximum(fine, 1) / limit)).astype(np.int64))))

    return bins.mapped(fold, fine) if isinstance(bins, SparseBins) else fold(bins, fine[None, :])


class SparseBins:
    """Bins of a batch by row and feature, of which only the stored ones are kept; the others are those of the value 0."""

    def __init__(self, keys: np.ndarray, bins: np.ndarray, zero: np.ndarray, rows: np.ndarray) -> None:
        self.keys, self.bins, self.zero, self.rows = keys, bins, zero, rows  # keys: row * features + feature, in order

    @classmethod
    def of(cls, idx: pa.Array, bins: pa.Array, zero: np.ndarray) -> SparseBins:
        lens = idx.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        keys = np.repeat(np.arange(len(idx)), lens) * len(zero) + idx.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(keys, kind="stable")
        return cls(keys[order], bins.flatten().to_numpy(zero_copy_only=False).astype(np.int64)[order], zero, np.arange(len(idx)))

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, at):
        if not isinstance(at, tuple):
            return SparseBins(self.keys, self.bins, self.zero, self.rows[at])
        rows, features = at
        want = self.rows[rows] * len(self.zero) + features
        if not len(self.keys):
            return np.broadcast_to(self.zero[features], want.shape)
        pos = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[pos] == want, self.bins[pos], self.zero[features])

    def mapped(self, fold, fine: np.ndarray) -> SparseBins:
        return SparseBins(self.keys, fold(self.bins, fine[self.keys % len(self.zero)]), fold(self.zero, fine), self.rows)


def histogram(slot: np.ndarray, drawn: np.ndarray, bins: np.ndarray, label: np.ndarray, w: np.ndarray, s: Space) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Weights by (slot, candidate, bin, class): an array of the whole, or the cells met and their sums where the whole is large."""
    k = np.arange(s.k)
    at = (((slot[:, None] * s.k + k) * s.bins + bins[np.arange(len(slot))[:, None], drawn[slot]]) * s.classes + label[:, None]).ravel()
    each = np.repeat(w, s.k)
    if len(drawn) * s.cells <= DENSE:
        return np.bincount(at, each, len(drawn) * s.cells).astype(np.int64)
    at, of = np.unique(at, return_inverse=True)
    return at, np.bincount(of, each).astype(np.int64)


def _entropy(c: np.ndarray) -> np.ndarray:
    n = c.sum(-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = c / n
        return -np.where(c > 0, p * np.log(p), 0.0).sum(-1)


def scored(h: np.ndarray, categorical: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Score of every cut of histograms [node, candidate, bin, class] (minus infinity where there is none), and the class counts of its sides.

    Continuous: bins up to the cut go left. Categorical: the bin itself goes left. The score is the
    entropy of all minus the weighted entropies of left, right and missing, rounded so that engines
    with other logarithms order alike. A candidate without values has one cut, at bin 0, of score 0.
    """
    missing, present = h[:, :, 0], h[:, :, 1:]
    valid = present.sum(2)
    left = np.where(categorical[:, :, None, None], present, np.cumsum(present, 2))
    right = valid[:, :, None] - left
    n = (valid + missing).sum(-1)[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _entropy(valid + missing)[:, :, None] - (left.sum(-1) / n * _entropy(left) + right.sum(-1) / n * _entropy(right) + (missing.sum(-1) / n[:, :, 0] * _entropy(missing))[:, :, None])
    out = np.full(h.shape[:3], -np.inf)
    out[:, :, 1:] = np.where(present.sum(-1) > 0, np.round(gain, 9), -np.inf)
    out[:, :, 0] = np.where(valid.sum(-1) > 0, -np.inf, 0.0)
    none = np.zeros_like(left[:, :, :1])
    return out, {"left": np.concatenate([none, left], 2), "right": np.concatenate([none, right], 2), "missing": missing, "all": valid + missing}


def facts(counts: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Weight, majority label (the lowest on a tie) and its weight on every side of the chosen cuts."""
    out = {}
    for side, c in counts.items():
        c = c[i, j, b] if c.ndim == 4 else c[i, j]
        out |= {f"{side}_n": c.sum(-1), f"{side}_label": c.argmax(-1), f"{side}_ok": c.max(-1)}
    return out


def best(h: np.ndarray, drawn: np.ndarray, categorical: np.ndarray) -> dict[str, np.ndarray]:
    """The best cut of each node: score, then the earlier feature drawn, then the lower bin."""
    score, counts = scored(h, categorical)
    i = np.arange(len(h))
    j, b = np.divmod(score.reshape(len(h), -1).argmax(1), h.shape[2])
    return {"feature": drawn[i, j], "pos": j, "categorical": categorical[i, j], "bin": b, "score": score[i, j, b], **facts(counts, i, j, b)}


# ---- trees as arrays


@dataclass
class Tree:
    """Nodes of one tree in order of number; places of the children, -1 for none."""

    node: np.ndarray
    kind: np.ndarray  # 0 none, 1 continuous, 2 category, 3 missing
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray


KINDS = {None: 0, "le": 1, "category": 2, "missing": 3}


def trees_of(model: Model, keys: set[tuple[int, int]]) -> dict[tuple[int, int], Tree]:
    by: dict[tuple[int, int], list] = {k: [] for k in keys}
    for (f, t, n), v in model.nodes.items():
        if (f, t) in by:
            by[f, t].append((n, KINDS[v.get("kind")], v.get("feature") or 0, v.get("bin") or 0))
    out = {}
    for key, rows in by.items():
        a = np.array(sorted(rows) or [(0, 0, 0, 0)], np.int64)
        node = a[:, 0]

        def place(of: np.ndarray, node=node) -> np.ndarray:
            at = np.minimum(np.searchsorted(node, of), len(node) - 1)
            return np.where(node[at] == of, at, -1)

        left, right = place(2 * node + 1), place(2 * node + 2)
        out[key] = Tree(node, np.where((left < 0) & (right < 0), 0, a[:, 1]), a[:, 2], a[:, 3], left, right)
    return out


def walked(t: Tree, bins: np.ndarray) -> np.ndarray:
    """Number of the node that each row of bins ends at."""
    at, alive = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(alive):
        n = at[alive]
        go = t.kind[n] > 0
        n, alive = n[go], alive[go]
        b, kind = bins[alive, t.feature[n]], t.kind[n]
        is_left = np.where(kind == 1, b <= t.cut[n], np.where(kind == 2, b == t.cut[n], b == 0))
        nxt = np.where(is_left, t.left[n], t.right[n])
        ok = nxt >= 0
        at[alive[ok]] = nxt[ok]
        alive = alive[ok]
    return t.node[at]


def slots_of(nodes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each node among the wanted ones (in order), -1 for others."""
    if not len(wanted):
        return np.full(len(nodes), -1)
    at = np.minimum(np.searchsorted(wanted, nodes), len(wanted) - 1)
    return np.where(wanted[at] == nodes, at, -1)


# ---- batches


def matrix(col: pa.Array, n: int, kind: type) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, n) if len(col) else np.zeros((0, n), kind)


def rows_of(b: pa.RecordBatch, shape: Shape, trees: int) -> tuple[np.ndarray, np.ndarray | SparseBins, np.ndarray]:
    """label, bins, weights of a batch; a fourth column has the indices of sparse rows."""
    label, weights = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(b.column(2), trees, np.int64)
    if b.num_columns == 4:
        return label, SparseBins.of(b.column(3), b.column(1), zero_bins(shape)), weights
    return label, matrix(b.column(1), shape.features, np.int64), weights


# ---- values to bins, bags


def bin_of(values: np.ndarray, thresholds: np.ndarray | list[float], categories: int = 0) -> np.ndarray:
    """0 for a missing value; a category + 1 (one outside 0..categories-1 counts as missing); else 1 + the number of thresholds below the value."""
    gone = np.isnan(values)
    if categories:
        gone |= ~((values > -1) & (values < categories))
        return np.where(gone, -1, np.where(gone, 0, values).astype(np.int64)) + 1
    return np.where(gone, 0, np.searchsorted(np.asarray(thresholds, np.float64), values, side="left") + 1)


def zero_bins(shape: Shape) -> np.ndarray:
    return np.array([int(bin_of(np.zeros(1), shape.thresholds[f], shape.categorical.get(f, 0))[0]) for f in range(shape.features)], np.int64)


def bag_weights(ids: np.ndarray, trees: Sequence[int], mean: float | None, seed: int) -> np.ndarray:
    """Poisson weights of rows in trees, the same as sampling.bagging gives; 1 without a mean."""
    if mean is None:
        return np.ones((len(ids), len(trees)), np.int8)
    return np.searchsorted(np.array(ladder(mean)), uniform_array(ids[:, None], np.array(trees, np.int64)[None, :], seed), side="right").astype(np.int8)


def _list(flat: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, kind))


def prepare(shape: Shape, trees: Sequence[int], mean: float | None, seed: int):
    """Batches of row_id, label, features (or row_id, label, idx, val) to label, bins, weights (and idx)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            weights = bag_weights(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), trees, mean, seed)
            bags = _list(weights.ravel(), np.arange(n + 1) * len(trees), pa.int8())
            if b.num_columns == 3:
                x = dense(b.column(2), shape.features)
                bins = np.empty(x.shape, np.int16)
                for f in range(shape.features):
                    bins[:, f] = bin_of(x[:, f], shape.thresholds[f], shape.categorical.get(f, 0))
                yield pa.RecordBatch.from_arrays([b.column(1), _list(bins.ravel(), np.arange(n + 1) * shape.features, pa.int16()), bags], ["label", "bins", "weights"])
                continue
            lens = b.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            idx = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            val = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            inside = (idx >= 0) & (idx < shape.features)
            lens = np.bincount(np.repeat(np.arange(n), lens)[inside], minlength=n)
            idx, val = idx[inside], val[inside]
            bins, order = np.empty(len(idx), np.int16), np.argsort(idx, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(idx[order])) + 1):
                if len(part):
                    f = int(idx[part[0]])
                    bins[part] = bin_of(val[part], shape.thresholds[f], shape.categorical.get(f, 0))
            ends = np.r_[0, np.cumsum(lens)]
            yield pa.RecordBatch.from_arrays([b.column(1), _list(bins, ends, pa.int16()), bags, _list(idx.astype(np.int32), ends, pa.int32())], ["label", "bins", "weights", "idx"])

    return run


def dense(col: pa.Array, n: int) -> np.ndarray:
    """Matrix of a list column: NULL lists, elements and the ends of short lists are NaN; longer lists are cut."""
    lens = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lens == n).all():
        return flat.reshape(-1, n)
    out = np.full((len(col), n), np.nan)
    row = np.repeat(np.arange(len(col)), lens)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    keep = at < n
    out[row[keep], at[keep]] = flat[keep]
    return out


def partial(shape: Shape, trees: Sequence[int], packed: dict[tuple[int, int], Tree], frontier: dict[tuple[int, int], np.ndarray]):
    """Histograms of the open nodes over a task's rows, cells that are not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = {key: candidates(shape, *key, nodes)[0] for key, nodes in frontier.items()}
        dense: dict[tuple[int, int], np.ndarray] = {}
        sparse: dict[tuple[int, int], list] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for key, h in dense.items():
                at = np.flatnonzero(h)
                yield from _cells(key, frontier[key], space(shape, key[0]).cells, at, h[at])
            for key, parts in sparse.items():
                at, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                yield from _cells(key, frontier[key], space(shape, key[0]).cells, at, np.bincount(of, np.concatenate([p[1] for p in parts])).astype(np.int64))
            dense.clear()
            sparse.clear()

        for b in batches:
            label, fine, weights = rows_of(b, shape, len(trees))
            for forest in sorted({f for f, _ in frontier}):
                bins = coarse(fine, shape, forest)
                for at, tree in enumerate(trees):
                    key = (forest, tree)
                    if key not in frontier:
                        continue
                    rows = np.flatnonzero(weights[:, at])
                    slot = slots_of(walked(packed[key], bins[rows]), frontier[key])
                    rows, slot = rows[slot >= 0], slot[slot >= 0]
                    if not len(rows):
                        continue
                    h = histogram(slot, drawn[key], bins[rows], label[rows], weights[rows, at], space(shape, forest))
                    if isinstance(h, tuple):
                        sparse.setdefault(key, []).append(h)
                        held += len(h[0])
                    elif key in dense:
                        dense[key] += h
                    else:
                        dense[key] = h
            if held > HELD:
                yield from out()
                held = 0
        yield from out()

    return run


def _cells(key: tuple[int, int], nodes: np.ndarray, cells: int, at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per node of cells in order."""
    slot, inside = np.divmod(at, cells)
    heads = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else slot
    for s in range(0, len(heads), 5000):
        part = heads[s : s + 5000]
        end = heads[s + 5000] if s + 5000 < len(heads) else len(slot)
        off = pa.array(np.r_[part, end] - part[0], pa.int32())
        rows = slice(part[0], end)
        ids = nodes[slot[part]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), key[0], np.int32)), pa.array(np.full(len(ids), key[1], np.int32)), pa.array(ids.astype(np.int32)), pa.ListArray.from_arrays(off, pa.array(inside[rows].astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(n[rows]))],
            schema=PARTIAL,
        )


def summed(shape: Shape, finish, schema: pa.Schema):
    """Partial histograms come ordered by node: whole nodes are added up and handed to ``finish(forest, tree, node, histograms)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            if not held:
                return
            t = pa.concat_tables(held).combine_chunks()
            key = np.stack([t[c].to_numpy() for c in ("forest", "tree", "node")], 1)
            stop = len(key)
            if not last:  # the last node may go on in the next batch
                stop = int(np.flatnonzero((key != key[-1]).any(1))[-1]) + 1 if (key != key[-1]).any() else 0
            held, count = ([t.slice(stop)] if stop < len(key) else []), 0
            at_, n_ = (t[c].combine_chunks() for c in ("at", "n"))
            heads = np.flatnonzero(np.r_[True, (key[1:stop] != key[: stop - 1]).any(1)]) if stop else []
            ends = np.r_[heads[1:], stop] if stop else []
            lens = at_.value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(lens) - lens
            at, n = at_.flatten().to_numpy(zero_copy_only=False), n_.flatten().to_numpy(zero_copy_only=False)
            k = 0
            while k < len(heads):
                forest = int(key[heads[k], 0])
                s = space(shape, forest)
                most = k + max(1, CELLS // s.cells)
                e = k
                while e < len(heads) and e < most and key[heads[e], 0] == forest:
                    e += 1
                a, b = heads[k], ends[e - 1]
                node = np.repeat(np.arange(e - k), ends[k:e] - heads[k:e])
                cell = slice(first[a], first[b - 1] + lens[b - 1])
                h = np.bincount(np.repeat(node, lens[a:b]) * s.cells + at[cell], n[cell], (e - k) * s.cells).astype(np.int64)
                ids = key[heads[k:e]]
                yield from finish(forest, ids[:, 1], ids[:, 2], h.reshape(e - k, s.k, s.bins, s.classes))
                k = e

        for b in batches:
            if b.num_rows:
                held.append(pa.Table.from_batches([b]).cast(PARTIAL))
                count += b.num_rows
            if count > 5000:
                yield from flush(False)
        yield from flush(True)

    return run


def pick(shape: Shape):
    def finish(forest: int, tree: np.ndarray, node: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = {"forest": np.full(len(node), forest), "tree": tree, "node": node, **best(h, *candidates(shape, forest, tree, node))}
        yield pa.RecordBatch.from_arrays([pa.array(found[f.name]).cast(f.type) for f in BEST], schema=BEST)

    return summed(shape, finish, BEST)
