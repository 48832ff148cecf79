"""SQL texts that the forest queries must equal, put together from common table expressions."""

from __future__ import annotations

from grovelight.functions.expressions import ladder, uniform_sql

TREES, CLASSES, BINS = 3, 3, 8
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_SEG = "cast(case c_mktsegment " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(SEGMENTS)) + " end as double)"

FRAME = f"""
a as (select l_orderkey, sum(l_quantity) as sum_qty, round(avg(l_discount), 6) as avg_disc, cast(count(*) as double) as n_lines from lineitem group by l_orderkey),
frame as (select o_orderkey as row_id,
                 cast(case when o_totalprice + 20 * c_acctbal <= 165000 then 0 when o_totalprice + 20 * c_acctbal <= 331000 then 1 else 2 end as int) as label,
                 o_totalprice as f0, c_acctbal as f1, sum_qty as f2, avg_disc as f3, n_lines as f4,
                 cast(cast(substr(o_orderpriority, 1, 1) as int) - 1 as double) as f5, {_SEG} as f6
          from orders join customer on c_custkey = o_custkey left join a on l_orderkey = o_orderkey)"""


def long(features: list[int]) -> str:
    """Features renumbered from 0 in the order given."""
    return "long as (" + " union all ".join(f"select row_id, label, cast({i} as int) as feature, f{f} as v from frame" for i, f in enumerate(features)) + ")"


def thresholds(bins: int, continuous: list[int], where: str = "true") -> str:
    inside = ", ".join(map(str, continuous))
    return f"""
vc as (select feature, v, count(*) as n from long where v is not null and feature in ({inside}) and {where} group by feature, v),
w as (select *, sum(n) over (partition by feature) as total, count(*) over (partition by feature) as dv, max(v) over (partition by feature) as largest,
             sum(n) over (partition by feature order by v) as upto, lag(v) over (partition by feature order by v) as bef,
             row_number() over (partition by feature order by v) - 1 as i from vc),
m1 as (select *, ceil((2 * upto - n) * {bins} / (2.0 * total)) - 1 - i as slack from w where dv > {bins} and i > 0),
m2 as (select *, i + least(0, min(slack) over (partition by feature order by v)) as made from m1),
m3 as (select *, coalesce(lag(made) over (partition by feature order by v), 0) as had from m2),
thr as (select feature, v as threshold from w where dv <= {bins} and v < largest union all select feature, bef as threshold from m3 where made > had)"""


def binned(categorical: list[int], coarse: int | None = None) -> str:
    """b(row_id, label, feature, categorical, bin); with ``coarse``, bins folded into so many."""
    cat = " or ".join(f"feature = {c}" for c in categorical) or "false"
    fold = "bin" if coarse is None else f"case when bin = 0 or categorical or fine <= {coarse} then bin else least({coarse}, greatest(1, cast(floor(bin / (fine * 1.0 / {coarse})) as int))) end"
    return f"""
b0 as (select l.row_id, l.label, l.feature, ({cat}) as categorical, (select count(*) from thr t where t.feature = l.feature) + 1 as fine,
             cast(case when v is null then 0 when {cat} then cast(v as int) + 1
                  else 1 + (select count(*) from thr t where t.feature = l.feature and t.threshold < l.v) end as int) as bin from long l),
b as (select row_id, label, feature, categorical, cast({fold} as int) as bin from b0)"""


def weight(r: str, t: str) -> str:
    steps = ladder(1.0)
    return "case " + " ".join(f"when {uniform_sql(r, t)} < {x} then {k}" for k, x in enumerate(steps)) + f" else {len(steps)} end"


def bags(trees: int = TREES, where: str = "true") -> str:
    return f"bags as (select row_id, cast(t as int) as tree, cast({weight('row_id', 't')} as int) as w from (select row_id from frame where {where}), (select unnest(range({trees})) as t))"


def h(c: list[str], n: str) -> str:
    return "(" + " + ".join(f"case when {x} > 0 then -({x} * 1.0 / ({n})) * ln({x} * 1.0 / ({n})) else 0.0 end" for x in c) + ")"


def scores(src: str, out: str) -> str:
    """From src(tree, node, feature, pos, categorical, bin, c0..) the scores of every candidate."""
    k = range(CLASSES)
    g = "partition by tree, node, feature"
    run = f"{g} order by bin rows between unbounded preceding and current row"
    v = ", ".join(f"sum(case when bin > 0 then c{i} else 0 end) over ({g}) as v{i}, sum(case when bin = 0 then c{i} else 0 end) over ({g}) as m{i}, case when categorical then c{i} else sum(case when bin > 0 then c{i} else 0 end) over ({run}) end as l{i}" for i in k)
    ra = ", ".join(f"v{i} - l{i} as r{i}, v{i} + m{i} as a{i}" for i in k)
    tot = {s: " + ".join(f"{s}{i}" for i in k) for s in "lrmav"}
    ent = {s: h([f"{s}{i}" for i in k], tot[s]) for s in "lrma"}

    def lab(s: str) -> str:
        most = "greatest(" + ", ".join(f"{s}{i}" for i in k) + ")"
        return "case " + " ".join(f"when {s}{i} = {most} then {i}" for i in k) + " end"

    cols = ", ".join(f"cast({tot[s]} as bigint) as {n}_n, cast({lab(s)} as int) as {n}_label, cast(greatest({', '.join(f'{s}{i}' for i in k)}) as bigint) as {n}_ok" for s, n in (("l", "left"), ("r", "right"), ("m", "missing"), ("a", "all")))
    score = f"round({ent['a']} - ({tot['l']}) * 1.0 / ({tot['a']}) * {ent['l']} - ({tot['r']}) * 1.0 / ({tot['a']}) * {ent['r']} - ({tot['m']}) * 1.0 / ({tot['a']}) * {ent['m']}, 9)"
    return f"""
{out}_1 as (select *, {v} from {src}),
{out}_2 as (select *, {ra} from {out}_1),
{out} as (select tree, node, feature, pos, categorical, bin, {score} as score, {cols} from {out}_2 where bin > 0 or {tot["v"]} = 0)"""


def best(src: str, out: str) -> str:
    return f"{out} as (select * from (select *, row_number() over (partition by tree, node order by score desc, pos, bin) as k from {src}) where k = 1)"


def level_of(n: str) -> str:
    return f"cast(floor(log2({n} + 1)) as int)"


def grown(depth: int, n_features: int, k: int, trees: int = TREES, forest: int = 0, first: int = 0) -> str:
    """Levels of growth, unrolled: nodes(tree, node, label, n, ok) and splits(tree, node, kind, feature, bin).

    A node with missing values tests for them first; the real cut is that of its right child, one level below.
    """
    out = ["as0 as (select tree, 0 as node, row_id, w from bags where w > 0)", f"open0 as (select cast(t as int) as tree, 0 as node from (select unnest(range({trees})) as t))"]
    sums = ", ".join(f"cast(sum(case when b.label = {c} then a.w else 0 end) as bigint) as c{c}" for c in range(CLASSES))
    left = "case when s.categorical then b.bin = s.bin else b.bin <= s.bin end"
    for d in range(depth):
        draw = "feature" if k >= n_features else f"{uniform_sql(f'cast(tree + {1009 * forest + first} as bigint) * 2147483648 + node', 'feature')}, feature"
        out += [
            f"fr{d} as (select * from (select tree, node, feature, row_number() over (partition by tree, node order by {draw}) - 1 as pos from open{d}, (select unnest(range({n_features})) as feature)) where pos < {k})",
            f"h{d} as (select a.tree, a.node, b.feature, f.pos, b.categorical, b.bin, {sums} from as{d} a join b on b.row_id = a.row_id join fr{d} f on f.tree = a.tree and f.node = a.node and f.feature = b.feature group by a.tree, a.node, b.feature, f.pos, b.categorical, b.bin)",
            scores(f"h{d}", f"s{d}"),
            best(f"s{d}", f"best{d}"),
            f"sp{d} as (select *, missing_n > 0 as gone, left_n > 0 and right_n > 0 and (missing_n = 0 or {level_of('(2 * node + 2)')} + 1 <= {depth}) as real, case when missing_n > 0 then 2 * node + 2 else node end as inner_node from best{d} where (missing_n > 0 and left_n + right_n > 0) or (missing_n = 0 and left_n > 0 and right_n > 0))",
            f"""kid{d} as (select tree, 2 * inner_node + 1 as node, left_label as label, left_n as n, left_ok as ok from sp{d} where real
                   union all select tree, 2 * inner_node + 2, right_label, right_n, right_ok from sp{d} where real
                   union all select tree, 2 * node + 1, missing_label, missing_n, missing_ok from sp{d} where gone
                   union all select tree, inner_node, case when left_n = 0 then right_label when right_n = 0 then left_label when left_n >= right_n then left_label else right_label end, left_n + right_n, left_n + right_n from sp{d} where gone)""",
            f"open{d + 1} as (select tree, node from kid{d} where ok < n and {level_of('node')} + 1 <= {depth})",
            f"as{d + 1} as (select q.* from (select a.tree, case when b.bin = 0 then 2 * a.node + 1 when not s.real then s.inner_node when ({left}) then 2 * s.inner_node + 1 else 2 * s.inner_node + 2 end as node, a.row_id, a.w from as{d} a join sp{d} s on s.tree = a.tree and s.node = a.node join b on b.row_id = a.row_id and b.feature = s.feature) q join open{d + 1} o on o.tree = q.tree and o.node = q.node)",
        ]
    nodes = "select tree, node, all_label as label, all_n as n, all_ok as ok from best0 " + " ".join(f"union all select tree, node, label, n, ok from kid{d}" for d in range(depth))
    splits = " union all ".join(
        f"select tree, inner_node as node, case when categorical then 'category' else 'le' end as kind, feature, bin from sp{d} where real union all select tree, node, 'missing', feature, 0 from sp{d} where gone" for d in range(depth)
    )
    return ", ".join([*out, f"nodes as ({nodes})", f"splits as ({splits})"])


def walked(depth: int, where: str = "true") -> str:
    """pred(row_id, label, tree, pred): the label of the deepest node that each row reaches, at most ``depth`` down."""
    out = [f"p0 as (select f.row_id, f.label, n.tree, 0 as node from (select * from frame where {where}) f, (select distinct tree from nodes) n)"]
    for d in range(depth):
        go = "case s.kind when 'missing' then b.bin = 0 when 'category' then b.bin = s.bin else b.bin <= s.bin end"
        out.append(f"p{d + 1} as (select p.row_id, p.label, p.tree, case when s.node is null or (b.bin = 0 and s.kind <> 'missing') then p.node when {go} then 2 * p.node + 1 else 2 * p.node + 2 end as node from p{d} p left join splits s on s.tree = p.tree and s.node = p.node and {level_of('p.node')} = {d} left join b on b.row_id = p.row_id and b.feature = s.feature)")
    return ", ".join([*out, f"pred as (select p.row_id, p.label, p.tree, n.label as pred from p{depth} p join nodes n on n.tree = p.tree and n.node = p.node)"])


def voted(where: str = "true") -> str:
    v = ", ".join(f"cast(sum(case when pred = {c} then 1 else 0 end) as int) as v{c}" for c in range(CLASSES))
    top = "greatest(" + ", ".join(f"v{c}" for c in range(CLASSES)) + ")"
    lab = "case " + " ".join(f"when v{c} = {top} then {c}" for c in range(CLASSES)) + " end"
    return f"votes as (select row_id, label, {v} from pred where {where} group by row_id, label), won as (select *, cast({lab} as int) as predicted from votes)"


CORE4 = [0, 1, 5, 6]  # no missing values; the last two are categories
ALL = list(range(7))


def forest(features: list[int], depth: int, k: int, trees: int, fit: str = "true", cuts: str | None = None, bins: int = BINS, coarse: int | None = None, number: int = 0) -> str:
    """Common table expressions up to nodes and splits of a forest on the rows where ``fit``, cut points from those where ``cuts``."""
    categorical = [i for i, f in enumerate(features) if f >= 5]
    continuous = [i for i in range(len(features)) if i not in categorical]
    return ", ".join([FRAME, long(features), thresholds(bins, continuous, cuts or fit), binned(categorical, coarse), bags(trees, fit), grown(depth, len(features), k, trees, number)])


def core4(depth: int, k: int, tail: str, body: str) -> str:
    return "with " + forest(CORE4, depth, k, TREES) + (", " + tail if tail else "") + " " + body


def dump() -> str:
    """line_no, line of the indented trees, in the order root, left, right."""
    path = f"list_aggregate(list_transform(range({{lv}} - 1, -1, -1), lambda i: cast((node + 1) >> i & 1 as varchar)), 'string_agg', '')"
    what = "case when s.kind is null then 'LEAF' else s.kind || ' feature ' || s.feature || ' ' || cast(case s.kind when 'missing' then 0.0 when 'category' then cast(s.bin - 1 as double) else t.threshold end as varchar) end"
    return f"""
t as (select feature, threshold, row_number() over (partition by feature order by threshold) as pos from thr),
d as (select n.tree, n.node, n.label, {level_of('n.node')} as lv, {what} as what from nodes n left join splits s on s.tree = n.tree and s.node = n.node left join t on t.feature = s.feature and t.pos = s.bin),
e as (select tree, coalesce({path.format(lv="lv")}, '') as path, repeat('  ', lv) || node || ' ' || what || ' label ' || label as line from d union all select distinct tree, '!', 'forest 0 tree ' || tree from d),
f as (select row_number() over (order by tree, path <> '!', path) - 1 as line_no, line from e)"""


def turned(matrix: list[list[float]], fit: str) -> str:
    """frame of the scaled and turned features; spans come from the rows where ``fit``."""
    n = len(matrix)
    span = ", ".join(f"min(f{j}) as lo{j}, max(f{j}) as hi{j}" for j in range(n))
    unit = ", ".join(f"case when f{j} is null or hi{j} = lo{j} then 0.0 else least(1.0, greatest(0.0, (f{j} - lo{j}) / (hi{j} - lo{j}))) end as s{j}" for j in range(n))
    out = ", ".join("round(" + " + ".join(f"cast('{m!r}' as double) * s{j}" for j, m in enumerate(row)) + f", 9) as f{i}" for i, row in enumerate(matrix))
    return ", ".join([FRAME.replace("frame as (", "frame0 as ("), f"spans as (select {span} from frame0 where {fit})", f"units as (select row_id, label, {unit} from frame0, spans)", f"frame as (select row_id, label, {out} from units)"])


def ends(depths: tuple[int, ...], counts: tuple[int, ...], first: int = 0) -> str:
    """votes(row_id, label, depth, trees, v0..) of the first ``trees`` trees cut at each depth, from p0, p1, ..."""
    votes = ", ".join(f"sum(case when n.label = {c} then 1 else 0 end) as v{c}" for c in range(CLASSES))
    rows = " union all ".join(f"select row_id, label, tree, node, {x} as depth from p{x}" for x in depths)
    return f"ends as ({rows}), votes as (select e.row_id, e.label, depth, trees, {votes} from ends e join nodes n on n.tree = e.tree and n.node = e.node, (select unnest([{', '.join(map(str, counts))}]) as trees) where e.tree < trees group by e.row_id, e.label, depth, trees)"


def winner() -> str:
    return "case " + " ".join(f"when v{c} = greatest(" + ", ".join(f"v{k}" for k in range(CLASSES)) + f") then {c}" for c in range(CLASSES)) + " end"
