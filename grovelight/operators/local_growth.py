"""Finishing small sub-trees inside one task each.

Once a node's rows fit a worker, growing its sub-tree level by level costs a job per level for
little data. The rows of such nodes are brought together in packed blocks, one block per node and
batch, and each sub-tree is grown with arrays. The planner hands over only nodes of at most
``local_rows`` rows, so what a task holds at a time is bounded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grovelight.operators import level as lv
from grovelight.operators.growth import Key, Model, Shape, apply_split, by_tree

BLOCK = pa.schema([("forest", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("label", pa.binary()), ("w", pa.binary()), ("bins", pa.binary())])
BLOCK_DDL = "forest int, tree int, node int, label binary, w binary, bins binary"
NODE = pa.schema([("forest", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("kind", pa.string()), ("feature", pa.int32()), ("bin", pa.int32()), ("threshold", pa.float64()), ("label", pa.int32()), ("n", pa.int64()), ("deep", pa.bool_()), ("later", pa.string())])
NODE_DDL = "forest int, tree int, node int, kind string, feature int, bin int, threshold double, label int, n bigint, deep boolean, later string"


def grow_subtree(bins: np.ndarray, label: np.ndarray, w: np.ndarray, key: Key, shape: Shape, max_depth: int) -> Model:
    """The sub-tree below a node from its rows (the forest's bins): the splits that the level queries would pick."""
    forest, tree, root = key
    s = lv.space(shape, forest)
    model, at = Model(), np.full(len(label), root, np.int64)
    todo = np.array([root], np.int64)
    while len(todo):
        slot = lv.slots_of(at, todo)
        keep = slot >= 0
        bins, label, w, slot = bins[keep], label[keep], w[keep], slot[keep]
        drawn, flags = lv.candidates(shape, forest, tree, todo)
        opened: list[int] = []
        moves = np.full((len(todo), 6), -1, np.int64)  # feature, cut, categorical, left, right, missing
        step = max(1, lv.CELLS // s.cells)
        for a in range(0, len(todo), step):
            z = slice(a, a + step)
            here = (slot >= a) & (slot < a + step)
            n = len(todo[z])
            h = lv.histogram(slot[here] - a, drawn[z], bins[here], label[here], w[here], s)
            if isinstance(h, tuple):
                full = np.zeros(n * s.cells, np.int64)
                full[h[0]] = h[1]
                h = full
            found = lv.best(h.reshape(n, s.k, s.bins, s.classes), drawn[z], flags[z])
            cols = {c: v.tolist() for c, v in found.items()}
            for i in range(n):
                node = int(todo[a + i])
                split = {"forest": forest, "tree": tree, "node": node} | {c: v[i] for c, v in cols.items()}
                kids = [k[2] for k in apply_split(model, shape, split, max_depth)]
                opened += kids
                deep = model.nodes[forest, tree, node].get("kind") == "missing"
                m = 2 * node + 2 if deep else node
                alive = set(kids)
                moves[a + i] = split["feature"], split["bin"], split["categorical"], *(k if k in alive else -1 for k in (2 * m + 1, 2 * m + 2)), 2 * node + 1 if deep and 2 * node + 1 in alive else -1
        mv = moves[slot]
        b = bins[np.arange(len(bins)), mv[:, 0]]
        is_left = np.where(mv[:, 2] == 1, b == mv[:, 1], b <= mv[:, 1])
        at = np.where(b == 0, mv[:, 5], np.where(is_left, mv[:, 3], mv[:, 4]))
        todo = np.array(sorted(opened), np.int64)
    return model


def _blocks(shape: Shape, trees: Sequence[int], packed: dict, frontier: dict):
    """Rows at the nodes to finish, packed per node and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, fine, weights = lv.rows_of(b, shape, len(trees))
            out = []
            for forest in sorted({f for f, _ in frontier}):
                bins = lv.coarse(fine, shape, forest).astype("<i2")
                for k, tree in enumerate(trees):
                    if (forest, tree) not in frontier:
                        continue
                    rows = np.flatnonzero(weights[:, k])
                    slot = lv.slots_of(lv.walked(packed[forest, tree], bins[rows]), frontier[forest, tree])
                    rows, slot = rows[slot >= 0], slot[slot >= 0]
                    order = np.argsort(slot, kind="stable")
                    rows, slot = rows[order], slot[order]
                    ends = np.r_[np.flatnonzero(np.diff(slot)) + 1, len(slot)] if len(slot) else []
                    a = 0
                    for e in ends:
                        r = rows[a:e]
                        out.append((forest, tree, int(frontier[forest, tree][slot[a]]), label[r].astype("<i4").tobytes(), weights[r, k].astype("<u1").tobytes(), bins[r].tobytes()))
                        a = e
            for z in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[z : z + 2000], strict=True), BLOCK, strict=True)], schema=BLOCK)

    return run


def _finish(shape: Shape, max_depth: int):
    """Blocks come ordered by node: one sub-tree at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []

        def close() -> None:
            if not held:
                return
            label, w, bins = (np.concatenate([np.frombuffer(h[i], kind) for h in held]).astype(np.int64) for i, kind in enumerate(("<i4", "<u1", "<i2")))
            m = grow_subtree(bins.reshape(-1, shape.features), label, w, key, shape, max_depth)
            done.extend((*k, v.get("kind"), v.get("feature"), v.get("bin"), v.get("threshold"), v["label"], v["n"], v.get("deep", False), json.dumps(v["later"]) if "later" in v else None) for k, v in m.nodes.items())
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), NODE, strict=True)], schema=NODE)
                done.clear()

        for b in batches:
            for f, t, n, *data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (f, t, n) != key:
                    close()
                    key = (f, t, n)
                    if len(done) > 20_000:
                        yield from out()
                held.append(data)
        close()
        yield from out()

    return run


def finish_locally(rows: DataFrame, shape: Shape, trees: Sequence[int], keys: Sequence[Key], max_depth: int, model: Model | None = None) -> Model:
    """``model`` with the sub-trees of the given open nodes (the roots of a model without nodes)."""
    model = model or Model()
    if not keys:
        return model
    frontier = by_tree(keys)
    blocks = rows.mapInArrow(_blocks(shape, trees, lv.trees_of(model, set(frontier)), frontier), BLOCK_DDL)
    got = blocks.repartition("forest", "tree", "node").sortWithinPartitions("forest", "tree", "node").mapInArrow(_finish(shape, max_depth), NODE_DDL).toArrow()
    for r in got.to_pylist():  # the model itself
        v = {"label": r["label"], "n": r["n"], "open": False, "deep": r["deep"]}
        if r["kind"]:
            v |= {k: r[k] for k in ("kind", "feature", "bin", "threshold")}
        if r["later"]:
            v["later"] = json.loads(r["later"])
        model.nodes[r["forest"], r["tree"], r["node"]] = v
    return model
