"""Parent-child links to full hierarchies.

Nodes are cut into blocks by id within their group. A block follows its own
chains to the exits of its fragments; the nodes other blocks point to form a
smaller quotient forest, which is solved the same way, its blocks wider by as much as
the forest has shrunk, so that no block grows; its
answers are then expanded through the fragments. A chain that never leaves a
block and never ends is a local ring; one that does so only in the quotient is a
global ring. A quotient that has not shrunk to half, as where parents lie anywhere, is
solved by doubling the reach of every node instead, which needs no blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqweave.session import written

TREE, RING, TAIL = "tree", "ring", "leads_to_ring"


# ---------------------------------------------------------------- resolving names


class Resolved:
    """Entries and links of a table, names resolved once for links of all kinds:
    ``nodes`` (``g, id, name``) and ``links`` (``g, kind, id, target``), both written to
    the shared folder. ``links`` names Columns that give linked names, by kind.

    Rows with a null group, id or name are left out; of different ids of one name the
    smallest counts; links to absent names end there; repeats count once."""

    def __init__(self, df: DataFrame, group: str, node: str, name: str, links: dict[str, list]) -> None:
        named = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("link")) for k, cols in links.items() for c in cols))
        src = df.select(df[group].alias("g"), df[node].cast("long").alias("id"), df[name].alias("name"), named.alias("links")).filter(F.col("g").isNotNull() & F.col("id").isNotNull() & F.col("name").isNotNull())
        rows = written(src.groupBy("g", "name").agg(F.min(F.struct("id", "links")).alias("m")).select("g", "name", "m.id", "m.links"), "nodes")
        self.nodes = rows.select("g", "id", "name")
        # names without links never enter the join, so nulls make no hot key
        each = rows.select("g", "id", F.inline("links")).filter(F.col("link").isNotNull())
        self.links = written(each.join(rows.select("g", F.col("name").alias("link"), F.col("id").alias("target")), ["g", "link"]).select("g", "kind", "id", "target").distinct(), "links")


# ---------------------------------------------------------------- forests


def _contract(t: pa.Table) -> pa.Table:
    """One block: each node with its fragment's exit, the names on the way down
    to it and how its chain ends. A dead node is known to end in a ring."""
    ids = t["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    target = t["target"].combine_chunks()
    dead = t["dead"].combine_chunks().to_numpy(zero_copy_only=False)[order]
    has = target.is_valid().to_numpy(zero_copy_only=False)[order] & ~dead
    to = target.fill_null(-1).to_numpy(zero_copy_only=False)[order]
    n = len(ids)
    here = np.arange(n)
    at = np.minimum(np.searchsorted(ids, to), n - 1)
    inside = (has & (ids[at] == to)) | dead
    step = np.where(dead, here, np.where(inside, at, here))
    jump, dist = step.copy(), inside.astype(np.int64)
    for _ in range(int(n).bit_length() + 1):
        dist = dist + dist[jump]
        jump = jump[jump]
    ends = ~inside[jump]  # the chain ends in this block or leaves it
    ring = np.zeros(n, dtype=bool)
    ring[jump[~ends]] = True
    ring &= ~dead
    frags = t["frag"].to_pylist()
    frags = [frags[i] for i in order]
    paths = list(frags)
    for v in np.argsort(np.where(ends, dist, n + 1), kind="stable"):
        if not ends[v]:
            break
        if inside[v]:
            paths[v] = paths[step[v]] + frags[v]
    leaves = ends & has[jump]
    status = np.where(ends, TREE, np.where(ring, RING, TAIL)).astype(object)
    status[leaves] = None
    out = [t["g"].take(pa.array(order)), pa.array(ids), pa.array(np.where(leaves, to[jump], 0), mask=~leaves), pa.array(paths, type=pa.list_(pa.string())), pa.array(status, type=pa.string())]
    return pa.table(out, names=["g", "id", "exit", "frag", "status"])


def _doubled(level: DataFrame) -> DataFrame:
    """``g, id, exit, frag, status`` of all nodes of a forest (``g, id, target, frag, dead``), none with an
    exit: every open node takes over the reach of the node it has come to, until all have
    ended. A chain that meets a name again ends; its node is on the ring if the name is its own."""
    status = F.when(F.col("dead"), TAIL).when(F.col("target").isNull(), TREE)
    now = level.select("g", "id", "target", "frag", F.col("frag").alias("own"), status.alias("status"))
    while True:
        now = written(now, "doubled")
        ended, live = now.filter("status IS NOT NULL"), now.filter("status IS NULL")
        if live.isEmpty():
            return now.select("g", "id", F.lit(None).cast("long").alias("exit"), F.when(F.col("status") == TREE, F.col("frag")).otherwise(F.col("own")).alias("frag"), "status")
        above = now.select("g", F.col("id").alias("target"), F.col("target").alias("next"), F.col("frag").alias("up"), F.col("status").alias("end"))
        step = live.join(above, ["g", "target"]).withColumn("frag", F.when(F.col("end").isin(TAIL, RING), F.col("frag")).otherwise(F.concat("up", "frag")))
        again = F.size(F.array_distinct("frag")) < F.size("frag")
        own = F.array_contains(F.slice("frag", F.lit(1), F.size("frag") - 1), F.element_at("frag", -1))
        end = F.when(F.col("end").isin(TAIL, RING), TAIL).when(again & own, RING).when(again, TAIL).when(F.col("end") == TREE, TREE)
        now = ended.unionByName(step.select("g", "id", F.col("next").alias("target"), "frag", "own", end.alias("status")))


def forest_paths(df: DataFrame | Resolved, group: str = "", node: str = "", name: str = "", parent: str = "", *, kind: str = "parent", block_nodes: int = 200_000) -> DataFrame:
    """``g, id, name, depth, root, path, status`` for every node of the forest.

    ``path`` is the array of names from the root down to the node, ``depth`` its
    number of links, ``root`` its first name. ``status`` is ``tree``, ``ring``
    (the node can be reached from itself) or ``leads_to_ring``; the last two have
    a null path, root and depth.

    Defined cases: those of ``Resolved``, which may be given instead of a table and has the
    links as ``kind``; a null or absent parent makes a root; a node that is its own
    parent is a ring; an empty table gives no row; further columns are not read.
    ``block_nodes`` is the width in ids of a block at the first level; only nodes
    that other blocks point to go on to the next.
    """
    known = df if isinstance(df, Resolved) else Resolved(df, group, node, name, {kind: [df[parent]]})
    names = known.nodes
    links = known.links.filter(F.col("kind") == kind).select("g", "id", "target")
    level = names.join(links, ["g", "id"], "left").select("g", "id", "target", F.array("name").alias("frag"), F.lit(False).alias("dead"))
    shape = T.StructType([T.StructField("g", level.schema["g"].dataType), T.StructField("id", T.LongType()), T.StructField("exit", T.LongType()), T.StructField("frag", T.ArrayType(T.StringType())), T.StructField("status", T.StringType())])
    width, levels, before = block_nodes, [], None
    while True:
        local = written(level.select("g", "id", "target", "frag", "dead", F.floor(F.col("id") / width).alias("block")).groupBy("g", "block").applyInArrow(_contract, shape), f"forest-{len(levels) + 1}")
        levels.append(local)
        before = before or local.count()
        exits = local.filter(F.col("exit").isNotNull()).select("g", F.col("exit").alias("id")).distinct()
        level = written(exits.join(local, ["g", "id"]).select("g", "id", F.col("exit").alias("target"), "frag", F.coalesce(F.col("status") != TREE, F.lit(False)).alias("dead")), "quotient")
        left = level.count()
        if not left:
            break
        if left > block_nodes and left * 2 > before:
            levels.append(_doubled(level))
            break
        # as many nodes to a block as before; what fits in one block altogether is one
        width = 1 << 62 if left <= block_nodes else width * (before // left)
        before = left
    ring_names = None
    for local in levels:
        part = local.filter(F.col("status") == RING).select("g", F.explode("frag").alias("name"))
        ring_names = part if ring_names is None else ring_names.unionByName(part)
    solved = levels[-1].select("g", "id", "frag", "status")
    for local in reversed(levels[:-1]):
        ended = local.filter(F.col("exit").isNull()).select("g", "id", "frag", "status")
        above = solved.select("g", F.col("id").alias("exit"), F.col("frag").alias("up"), "status")
        rest = local.filter(F.col("exit").isNotNull()).select("g", "id", "exit", "frag").join(above, ["g", "exit"])
        solved = ended.unionByName(rest.select("g", "id", F.concat("up", "frag").alias("frag"), "status"))
    tree = F.col("status") == TREE
    out = names.join(solved, ["g", "id"]).join(ring_names.distinct().withColumn("on_ring", F.lit(True)), ["g", "name"], "left")
    path = F.when(tree, F.col("frag"))
    return out.select("g", "id", "name", F.when(tree, F.size("frag") - 1).alias("depth"), F.when(tree, F.element_at("frag", 1)).alias("root"), path.alias("path"), F.when(tree, TREE).when(F.col("on_ring"), RING).otherwise(TAIL).alias("status"))


def descendants(paths: DataFrame) -> DataFrame:
    """``g, ancestor, descendant, distance`` from the paths of ``forest_paths``:
    one row per node and proper ancestor, so no group is ever gathered."""
    up = paths.filter(F.col("path").isNotNull()).select("g", F.col("name").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.col("depth"))).alias("level", "ancestor"))
    return up.select("g", "ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))


# ---------------------------------------------------------------- rings of any links


def _trimmed(src: np.ndarray, dst: np.ndarray, free_src: np.ndarray, free_dst: np.ndarray, n: int) -> np.ndarray:
    """Edges that stay when nodes without a way on or a way in are taken off
    again and again; a free node counts as having one."""
    live = np.ones(len(src), dtype=bool)
    for a, b, free in ((src, dst, free_dst), (dst, src, free_src)):
        # take off nodes with no live edge leading away from them
        order = np.argsort(b, kind="stable")
        into = np.searchsorted(b[order], np.arange(n + 1))
        left = np.bincount(a[live], minlength=n)
        front = np.flatnonzero((left == 0) & ~free)
        while len(front):
            spans = [order[into[v] : into[v + 1]] for v in front]
            edges = np.concatenate(spans)
            edges = edges[live[edges]]
            live[edges] = False
            heads = a[edges]
            np.subtract.at(left, heads, 1)
            heads = np.unique(heads)
            front = heads[(left[heads] == 0) & ~free[heads]]
    return live


def _components(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Of each node the first node of its ring (strong components of more than one node, and
    loops), -1 for nodes that cannot be reached from themselves; one depth-first pass with
    an explicit stack."""
    order = np.argsort(src, kind="stable")
    out, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    number, low, on, ring = [0] * n, [0] * n, bytearray(n), np.full(n, -1, dtype=np.int64)
    loops = src[src == dst]
    ring[loops] = loops
    count, stack = 0, []
    for start in np.unique(src).tolist():
        if number[start]:
            continue
        count += 1
        number[start] = low[start] = count
        stack.append(start)
        on[start] = 1
        work = [(start, first[start])]
        while work:
            v, e = work.pop()
            if e < first[v + 1]:
                work.append((v, e + 1))
                w = out[e]
                if not number[w]:
                    count += 1
                    number[w] = low[w] = count
                    stack.append(w)
                    on[w] = 1
                    work.append((w, first[w]))
                elif on[w]:
                    low[v] = min(low[v], number[w])
                continue
            if low[v] == number[v]:
                cut = len(stack) - 1
                while stack[cut] != v:
                    cut -= 1
                for w in stack[cut:]:
                    on[w] = 0
                if len(stack) - cut > 1:
                    ring[stack[cut:]] = min(stack[cut:])
                del stack[cut:]
            if work:
                u = work[-1][0]
                low[u] = min(low[u], low[v])
    return ring


def _bypassed(src: list, dst: list, kept: set) -> tuple[list, dict, dict]:
    """Links of a graph without rings after nodes outside ``kept`` with one way in or one way on
    are taken out, their neighbours linked instead; and for each node taken out the nodes
    that are left before and after it."""
    into, on, way = {}, {}, []
    for a, b in zip(src, dst):
        on.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)
    for v in sorted(into.keys() & on.keys() - kept):
        if len(into[v]) == 1 or len(on[v]) == 1:
            before, after = into.pop(v), on.pop(v)
            for a in before:
                on[a].remove(v)
                on[a] |= after
            for b in after:
                into[b].remove(v)
                into[b] |= before
            way.append((v, before, after))
    first, last = {}, {}
    for v, before, after in reversed(way):  # those taken out later stand between those that are left
        first[v] = set().union(*(first.get(a, {a}) for a in before))
        last[v] = set().union(*(last.get(b, {b}) for b in after))
    return [(a, b) for a, way_on in on.items() for b in way_on], first, last


def _fragments(t: pa.Table) -> pa.Table:
    """One block of links: ``role, id, other`` rows. A ``member`` lies on a local ring, known by its
    first node; an ``edge`` leads on in the quotient, where rings are single nodes and chains
    single links; ``before`` and ``after`` name the ends of the fragments a node lies on."""
    a, b, own, w = t["id"].to_numpy(), t["target"].to_numpy(), t["block"][0].as_py(), t["width"][0].as_py()
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, src, dst = len(ids), flat[: len(a)], flat[len(a) :]
    outside = ids // w != own  # nodes of other blocks keep their unknown ways
    live = _trimmed(src, dst, outside, outside, n)
    src, dst = src[live], dst[live]
    entry, leaves = outside[src], outside[dst]
    inner = ~entry & ~leaves
    ring = _components(src[inner], dst[inner], n)
    rep = np.where(ring >= 0, ring, np.arange(n))
    src, dst = rep[src], rep[dst]
    inner &= src != dst
    enters, exits = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    enters[dst[entry]] = True
    exits[src[leaves & ~entry]] = True
    # with the rings closed to nodes, ways that neither come in nor lead out end here
    stay = _trimmed(src[inner], dst[inner], enters, exits, n)
    edges, first, last = _bypassed(src[inner][stay].tolist(), dst[inner][stay].tolist(), {*np.flatnonzero(enters | exits | (ring >= 0)).tolist()})
    member = np.flatnonzero(ring >= 0)
    edges += list(zip(src[leaves & ~entry].tolist(), dst[leaves & ~entry].tolist()))
    rows = [("member", v, ring[v]) for v in member.tolist()] + [("edge", *e) for e in edges]
    rows += [(role, v, x) for role, of in (("before", first), ("after", last)) for v, xs in of.items() for x in xs]
    role, one, two = zip(*rows) if rows else ((), (), ())
    at = lambda x: pa.array(ids[np.array(x, dtype=np.int64)])
    of = {c: pa.array([t[c][0].as_py()] * len(rows), type=t[c].type) for c in ("g", "kind")}
    return pa.table(of | {"role": pa.array(role, type=pa.string()), "id": at(one), "other": at(two)})


def ring_members(df: DataFrame | Resolved, group: str = "", node: str = "", name: str = "", links: list | None = None, *, width: int = 200_000, block_edges: int = 1_000_000) -> DataFrame:
    """``g, kind, id``: the nodes that can be reached from themselves by one or more of
    ``links`` (Columns giving the linked names; several for links of more parts).

    Blocks of ``width`` ids take off the nodes whose ways all end inside, close local rings
    to single nodes and contract chains to links between the nodes other blocks see.
    What is left, the quotient, is solved the same way, its blocks wider by as much as it
    has shrunk; one of fewer than ``block_edges`` links, or that has not shrunk to half,
    as one block a group. Then the nodes inside the fragments are expanded: one is on a
    global ring if a node before it and a node after it lie on the same one.

    Defined cases: those of ``Resolved``, which may be given instead of a table; its
    kinds of links are then searched side by side, each by itself; a node linked to itself is a
    ring; a node that merely leads to a ring is none; an empty table gives no row.
    """
    known = df if isinstance(df, Resolved) else Resolved(df, group, node, name, {"link": links})
    edges, by = known.links, ["g", "kind"]
    shape = T.StructType([*(edges.schema[c] for c in by), T.StructField("role", T.StringType()), T.StructField("id", T.LongType()), T.StructField("other", T.LongType())])
    levels, before = [], edges.count()
    while before:
        block = lambda c, w=width: F.floor(F.col(c) / F.lit(w))
        # a link between blocks goes to both: one sees where it leads, the other that it comes in
        dealt = edges.select("*", F.explode(F.array_distinct(F.array(block("id"), block("target")))).alias("block"), F.lit(width).cast("long").alias("width"))
        parts = written(dealt.groupBy(*by, "block").applyInArrow(_fragments, shape), "ring-parts")
        levels.append(parts)
        members = parts.filter("role = 'member'").select(*by, F.col("id").alias("target"), F.col("other").alias("rep"))
        onward = parts.filter("role = 'edge'").select(*by, "id", F.col("other").alias("target"))
        left = onward.count()
        if not left:
            break
        edges = written(onward.join(members, [*by, "target"], "left").select(*by, "id", F.coalesce("rep", "target").alias("target")).distinct(), "ring-edges")
        width = 1 << 62 if left <= block_edges or left * 2 > before else width * (before // left)
        before = left
    labels = None
    for parts in reversed(levels):
        of = lambda role, c: parts.filter(F.col("role") == role).select(*by, "id", F.col("other").alias(c))  # noqa: E731, B023
        if labels is None:
            labels = of("member", "label")
        else:
            named = labels.select(*by, F.col("id").alias("rep"), "label")
            labels = labels.unionByName(of("member", "rep").join(named, [*by, "rep"], "left").select(*by, "id", F.coalesce("label", "rep").alias("label"))).distinct()
        if len(levels) > 1:
            labels = written(labels, "ring-labels")
            at = lambda role: of(role, "x").join(labels.select(*by, F.col("id").alias("x"), "label"), [*by, "x"]).select(*by, "id", "label").distinct()  # noqa: E731, B023
            labels = labels.unionByName(at("before").join(at("after"), [*by, "id", "label"])).distinct()
    if labels is None:
        return known.links.select(*by, "id").limit(0)
    return labels.select(*by, "id").distinct() if len(levels) > 1 else labels.select(*by, "id")
