"""A sample whose share of each category matches targets: top-down allocation over a category tree.

The sample's size is the quota of the root. From the root down every node deals its quota to its
children: first the reserved minimums of the labels below, then the rest by target. A child that has
fewer rows below it than its part is filled up, and what it lacks goes to the other children: so a
label's unmet quota is taken by its siblings, and by its cousins only when the siblings have no rows
left. Rows are drawn by a dense rank in a permuted order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovelight.sources.tables import cut, maybe_broadcast

ALLOCATED = "plan_id string, label_id int, target_share double, min_rows int, available bigint, wanted double, quota bigint, passed bigint, received bigint, short boolean"
MILLION = 1_000_000  # shares are counted in millionths, so that all of the allocation is in whole numbers
PRIME = 2147483647
BUCKETS = 4096


def binary_path(label: int, depth: int = 4) -> tuple[int, ...]:
    """Default tree: labels whose numbers differ in the last bit are siblings, in the last two cousins."""
    return tuple(label >> k for k in range(depth, 0, -1))


@dataclass
class Node:
    """Totals of the labels below: reserved minimums, rows there are, weight of the rest."""

    reserved: int = 0
    room: int = 0
    weight: int = 0


def dealt(quota: int, children: Sequence[Node]) -> list[int]:
    """The parts of the children, which add up to ``quota`` (at most their room, at least what they reserve).

    Each gets what it reserves and a share of the rest by weight, by largest remainder, the first
    one on a tie. Parts beyond a child's room go to the children that have room, again by weight.
    """
    out = [c.reserved for c in children]
    rest = quota - sum(out)
    while rest > 0:
        open_ = [k for k, c in enumerate(children) if out[k] < c.room]
        total = sum(children[k].weight for k in open_)
        part = {k: divmod(rest * children[k].weight, total) for k in open_}
        extra = rest - sum(q for q, _ in part.values())
        for n, k in enumerate(sorted(open_, key=lambda k: (-part[k][1], k))):
            got = min(part[k][0] + (n < extra), children[k].room - out[k])
            out[k] += got
            rest -= got
    return out


def spread(size: int, leaves: Sequence[tuple[int, int, int, int]], path: Callable[[int], tuple[int, ...]]) -> dict[int, int]:
    """label -> quota, top-down. leaves: (label, millionths wanted, minimum, room), labels in order."""
    tree: dict[tuple, Node] = {}
    below: dict[tuple, list[tuple]] = {}
    for label, share, least, room in leaves:
        at = (*path(label), ("leaf", label))
        for k in range(len(at) + 1):
            key = at[:k]
            if key not in tree:
                tree[key] = Node()
                if k:
                    below.setdefault(at[: k - 1], []).append(key)
            n = tree[key]
            n.reserved += min(least, room)
            n.room += room
            n.weight += max(0, share * size - least * MILLION) + 1
    if not tree:
        return {}
    quota = {(): min(max(size, tree[()].reserved), tree[()].room)}
    todo = [()]
    while todo:
        key = todo.pop()
        kids = below.get(key, [])
        for kid, q in zip(kids, dealt(quota[key], [tree[k] for k in kids]), strict=True) if kids else ():
            quota[kid] = q
            todo.append(kid)
    return {label: quota[(*path(label), ("leaf", label))] for label, *_ in leaves}


def allocate(leaves: Sequence[tuple[int, float, int]], room: dict[int, int], size: int, path: Callable[[int], tuple[int, ...]] = binary_path) -> dict[int, tuple[int, int, int]]:
    """label -> (quota, passed on, received). leaves: (label, target share, minimum); room: rows available.

    Quotas add up to ``size``, or to the minimums where these alone are more, or to all rows where
    these are fewer. passed on: what the label would have got had it rows enough, beyond those it
    has; received: what it got beyond that part.
    """
    own = sorted((x, round(w * MILLION), m, room.get(x, 0)) for x, w, m in leaves)
    quota = spread(size, own, path)
    wanted = spread(size, [(x, w, m, 10**15) for x, w, m, _ in own], path)
    return {x: (quota[x], max(0, wanted[x] - r), max(0, quota[x] - min(wanted[x], r))) for x, _, _, r in own}


def usable_rows(df: DataFrame, labels: int = 12, split: str = "train") -> DataFrame:
    """row_id, label_id of rows of the split whose label is neither NULL nor NaN and lies in 0..labels-1 after max(label, 0)."""
    label = F.greatest(F.col("label"), F.lit(0.0))
    ok = (F.col("split_name") == split) & F.col("label").isNotNull() & ~F.isnan("label") & (label <= labels - 1)
    return df.filter(ok).select("row_id", label.cast("int").alias("label_id"))


def allocation(counts: DataFrame, targets: DataFrame, path: Callable[[int], tuple[int, ...]] = binary_path) -> DataFrame:
    """One row per plan and label: wanted, quota, what was passed on and received, ``short``.

    ``counts``: label_id, available. ``short`` where a label has fewer rows than its own part needs,
    that is fewer than min_rows or than target_share * (sample_share * all usable rows). A plan is
    worked out in one task (one row per label). NULL shares or minimums count as 0; a label without
    rows has 0 available; rows of targets without plan or label are left out, a repeated label of a
    plan counts once; an empty target table gives an empty result.
    """
    total = counts.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("usable"))
    side = maybe_broadcast(counts.select(F.col("label_id").alias("l"), "available"))
    t = targets.filter("plan_id is not null and label_id is not null").select("plan_id", F.col("label_id").cast("int").alias("label_id"), "target_share", "min_rows", "sample_share")
    t = t.join(side, F.col("label_id") == F.col("l"), "left").join(F.broadcast(total), F.lit(True))  # one row
    t = t.select("plan_id", "label_id", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"), F.coalesce("sample_share", F.lit(0.0)).alias("sample_share"), F.coalesce("available", F.lit(0)).alias("available"), "usable")

    def plan(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["label_id", "target_share", "min_rows"]).drop_duplicates("label_id")
        usable = int(p.usable.iloc[0])
        size = (round(p.sample_share.max() * MILLION) * usable + MILLION // 2) // MILLION
        got = allocate(list(zip(p.label_id.tolist(), p.target_share.tolist(), p.min_rows.tolist(), strict=True)), dict(zip(p.label_id.tolist(), p.available.tolist(), strict=True)), size, path)
        out = p[["plan_id", "label_id", "target_share", "min_rows", "available"]].copy()
        out["wanted"] = p.target_share * (p.sample_share * p.usable)
        for k, name in enumerate(("quota", "passed", "received")):
            out[name] = [got[x][k] for x in p.label_id]
        need = out[["wanted", "min_rows"]].max(axis=1)
        out["short"] = p.available < need
        return out

    return t.groupBy("plan_id").applyInPandas(plan, ALLOCATED)


def permuted(row_id: Column) -> Column:
    """Place of a row in the permuted order: a number below PRIME, the same in any SQL engine."""
    a = F.pmod(F.pmod(row_id, F.lit(PRIME)) * 48271 + 11, F.lit(PRIME))
    return F.pmod((a % 46337) * 46309 + F.floor(a / 46337).cast("long") * 7919 + 13, F.lit(PRIME))


def draw(rows: DataFrame, allocated: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """plan_id, label_id, row_id: of each label the ``quota`` rows that come first in the permuted order.

    Rows fall into buckets of the order. Counts of buckets tell which of them a plan takes whole and
    in which one its quota ends; only rows of these last buckets are ranked, so neither a label that
    holds most rows nor a sample of any size is sorted or shuffled as a whole. Equal places are ranked
    by row_id.
    """
    r = rows.select("row_id", "label_id", permuted(F.col("row_id")).alias("place")).withColumn("bucket", F.floor(F.col("place") * buckets / PRIME).cast("int"))
    n = r.groupBy("label_id", "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("label_id").orderBy("bucket"))  # at most ``buckets`` rows a label
    want = allocated.filter("quota > 0").select("plan_id", "label_id", "quota")
    b = cut(n.withColumn("upto", upto).join(want, "label_id").filter("upto - n < quota").select("plan_id", "label_id", "bucket", (F.col("quota") - F.col("upto") + F.col("n")).alias("left"), (F.col("upto") <= F.col("quota")).alias("whole")))
    whole = r.join(maybe_broadcast(b.filter("whole"), 200_000), ["label_id", "bucket"]).select("plan_id", "label_id", "row_id")
    ends = r.join(maybe_broadcast(b.filter("not whole")), ["label_id", "bucket"])
    k = F.row_number().over(Window.partitionBy("plan_id", "label_id").orderBy("place", "row_id"))
    return whole.unionByName(ends.withColumn("k", k).filter("k <= left").select("plan_id", "label_id", "row_id"))


def report(rows: DataFrame, allocated: DataFrame) -> DataFrame:
    """The allocation with the rows ``drawn``, the plan's ``sample_rows`` and the share reached."""
    got = draw(rows, allocated).groupBy("plan_id", "label_id").agg(F.count("*").alias("drawn"))
    out = allocated.join(maybe_broadcast(cut(got)), ["plan_id", "label_id"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    out = out.withColumn("sample_rows", F.sum("drawn").over(Window.partitionBy("plan_id")))  # one row per label
    return out.withColumn("reached_share", F.round(F.coalesce(F.try_divide("drawn", "sample_rows"), F.lit(0.0)), 6))


def counted(rows: DataFrame) -> DataFrame:
    return cut(rows.groupBy("label_id").agg(F.count("*").alias("available")))
