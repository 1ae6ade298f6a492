"""Parent-child links to full hierarchies: root, depth, entry-exit intervals, paths, descendants, cycles.

Method: leaves are peeled off (and runs of only children spliced out, so that long chains need few rounds)
until the rest fits a bound; roots and self-loops that nothing hangs from any more are finished on the way. In that core, peeling to the end exposes the cycles; what hangs below is laid
out as Euler tours, whose lists are ranked by parallel pointer jumping. Entry and exit positions give depth,
root and the interval of each subtree; the removed nodes get theirs back in reverse order.

Defined results: a node whose parent is itself is a cycle of one; nodes on or below a cycle have the depth
-1; a parent that has no row of its own is a root; null ids go, repeated rows of a node keep the least parent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from veinstone.session import broadcast_if_small, cut, join_spread

#: Nodes that one task may hold (below 200 MB with all arrays of the tour).
CORE_NODES = 1_000_000
_SALTS = 64
_CORE = ("id", "parent", "w", "own", "pre")
_RESULT = "id long, tree long, cycle long, depth long, enter long, leave long"


def rank_lists(following: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """(last element, sums of weights from the element to its list's end) by pointer jumping; an end points to itself."""
    jump = following.copy()
    sums = [np.where(jump == np.arange(len(jump)), 0, w) for w in weights]
    while not np.array_equal(beyond := jump[jump], jump):
        sums = [s + s[jump] for s in sums]
        jump = beyond
    ends = jump
    return ends, *[s + w[ends] for s, w in zip(sums, weights)]


def solve_core(ids: np.ndarray, parents: np.ndarray, w: np.ndarray, own: np.ndarray, pre: np.ndarray, has_parent: np.ndarray) -> dict[str, np.ndarray]:
    """Tours of a graph in which each node has at most one parent; arrays as in _RESULT, cycle is -1 off cycles' components."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[order], parents)
    found = has_parent & (at < n)
    found[found] = ids[order][at[found]] == parents[found]
    parent = np.where(found, order[np.minimum(at, n - 1)], -1)
    # peel: what is left when no leaf is left lies on cycles
    below = np.bincount(parent[parent >= 0], minlength=n).tolist()
    up, todo, left = parent.tolist(), [], bytearray(b"\1" * n)
    todo = [i for i in range(n) if not below[i]]
    while todo:
        i = todo.pop()
        left[i] = 0
        if (p := up[i]) >= 0:
            below[p] -= 1
            if not below[p]:
                todo.append(p)
    on_cycle = np.frombuffer(bytes(left), np.uint8).astype(bool)
    cycle = np.full(n, -1, np.int64)
    for start in np.flatnonzero(on_cycle).tolist():
        if cycle[start] < 0:
            i, members = start, []
            while True:
                members.append(i)
                i = up[i]
                if i == start:
                    break
            cycle[members] = min(members)
    parent = np.where(on_cycle, -1, parent)  # each cycle node keeps its own tree
    # Euler tour: 2v goes down into v, 2v + 1 leaves it
    nodes = np.arange(n)
    by_parent = np.lexsort((nodes, parent))
    by_parent = by_parent[np.searchsorted(parent[by_parent], 0) :]
    first, sibling = np.full(n, -1), np.full(n, -1)
    if len(by_parent):
        above = parent[by_parent]
        starts = np.r_[True, above[1:] != above[:-1]]
        first[above[starts]] = by_parent[starts]
        same = ~starts[1:]
        sibling[by_parent[:-1][same]] = by_parent[1:][same]
    following = np.empty(2 * n, np.int64)
    following[0::2] = np.where(first >= 0, 2 * first, 2 * nodes + 1)
    following[1::2] = np.where(sibling >= 0, 2 * sibling, np.where(parent >= 0, 2 * parent + 1, 2 * nodes + 1))
    length, steps = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    length[0::2] = own + pre
    edge = np.where(parent >= 0, w, 0)
    steps[0::2], steps[1::2] = edge, -edge
    ends, to_end, climb = rank_lists(following, length, steps)
    root = ends[0::2] // 2
    total = to_end[2 * root]
    return {
        "id": ids, "tree": ids[root], "cycle": np.where(cycle[root] >= 0, ids[cycle[root]], 0), "cyclic": cycle[root] >= 0,
        "depth": edge - climb[0::2], "enter": total - to_end[0::2] + pre, "leave": total - to_end[1::2],
    }


def _solve(table: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        arrays = {c: got.column(c).combine_chunks() for c in _CORE}
        has_parent = arrays["parent"].is_valid().to_numpy(zero_copy_only=False)
        plain = [arrays[c].fill_null(0).to_numpy(zero_copy_only=False) for c in _CORE]
        out = solve_core(*plain, has_parent)
        cycle = pa.array(out["cycle"], pa.int64(), mask=~out["cyclic"])
        whole = pa.table([pa.array(out["id"]), pa.array(out["tree"]), cycle, *[pa.array(out[c], pa.int64()) for c in ("depth", "enter", "leave")]], names=["id", "tree", "cycle", "depth", "enter", "leave"])
        yield from whole.to_batches(max_chunksize=50_000)

    return table.select(*_CORE).repartition(1).mapInArrow(run, _RESULT)


def _rake(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without its leaves, and the leaves with their offset in the parent's block."""
    inner = table.select(F.col("parent").alias("id")).filter(F.col("id").isNotNull()).distinct()
    leaves = table.filter(F.col("parent").isNotNull()).join(inner, "id", "left_anti").withColumn("salt", F.pmod("id", F.lit(_SALTS)))
    block = F.col("own") + F.col("pre")
    in_salt = Window.partitionBy("parent", "salt").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    totals = leaves.groupBy("parent", "salt").agg(F.sum(block).alias("total"))
    before = Window.partitionBy("parent").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # one row per parent and salt carries what the leaves need of their parent, so the many leaves of one parent meet it in as many parts
    own = table.select(F.col("id").alias("parent"), F.col("own").alias("parent_own"))
    starts = totals.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total").join(own, "parent")
    sums = totals.groupBy("parent").agg(F.sum("total").alias("more")).withColumnRenamed("parent", "id")
    removed = (
        leaves.withColumn("inside", F.coalesce(F.sum(block).over(in_salt), F.lit(0)))
        .join(starts, ["parent", "salt"])
        .select("id", F.col("parent").alias("via"), "w", (F.col("parent_own") + F.col("start") + F.col("inside") + F.col("pre")).alias("offset"), "own")
    )
    kept = (
        table.join(leaves.select("id"), "id", "left_anti").join(sums, "id", "left")
        .select("id", "parent", "w", (F.col("own") + F.coalesce("more", F.lit(0))).alias("own"), "pre")
    )
    return kept, removed


def _compress(table: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The table without some only-child links' upper ends, no two of which are neighbours, and these with their child."""
    coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), F.col(c)), F.lit(2)) == 1
    only = table.filter(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("n"), F.min("id").alias("child")).filter("n = 1")
    chosen = (
        table.filter(F.col("parent").isNotNull() & (F.col("parent") != F.col("id")) & coin("id") & ~coin("parent"))
        .join(only.select(F.col("parent").alias("id"), "child"), "id")
    )
    lower = table.select(F.col("id").alias("child"), F.col("w").alias("child_w"), F.col("pre").alias("child_pre"))
    removed = chosen.join(lower, "child").select("id", F.col("child").alias("via"), F.col("child_w").alias("w"), (F.col("child_pre") + F.col("own")).alias("offset"), "own")
    patch = chosen.select(F.col("child").alias("id"), F.col("parent").alias("to"), F.col("w").alias("more_w"), (F.col("own") + F.col("pre")).alias("more_pre"))
    kept = (
        table.join(chosen.select("id"), "id", "left_anti").join(patch, "id", "left")
        .select("id", F.coalesce("to", "parent").alias("parent"), (F.col("w") + F.coalesce("more_w", F.lit(0))).alias("w"), "own", (F.col("pre") + F.coalesce("more_pre", F.lit(0))).alias("pre"))
    )
    return kept, removed


def _finish(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without its whole components (roots and self-loops that nothing else hangs from), and these as rows of the result."""
    above = table.filter(F.col("parent") != F.col("id")).select(F.col("parent").alias("id")).distinct()
    ended = table.filter(F.col("parent").isNull() | (F.col("parent") == F.col("id"))).join(above, "id", "left_anti")
    done = ended.select(
        "id", F.col("id").alias("tree"), F.when(F.col("parent").isNotNull(), F.col("id")).alias("cycle"), F.lit(0).cast("long").alias("depth"),
        F.col("pre").alias("enter"), (F.col("pre") + F.col("own")).alias("leave"),
    )
    return table.join(ended.select("id"), "id", "left_anti").select(*_CORE), done


def forest(links: DataFrame, core_nodes: int = CORE_NODES) -> DataFrame:
    """id, tree, cycle, depth, enter, leave from (id long, parent long or null), one row per node.

    tree is the root of the node's tree (for nodes at a cycle the cycle node it hangs from), cycle one id of
    the component's cycle or null; a subtree is what has the same tree and enter within [enter, leave).
    """
    table = cut(links.select("id", "parent", F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("own"), F.lit(0).cast("long").alias("pre")))
    removals: list[tuple[str, DataFrame]] = []
    finished: list[DataFrame] = []
    turn = 0
    while table.count() > core_nodes:
        kept, leaves = _rake(table)
        kept = cut(kept)
        removals.append(("leaf", cut(leaves)))
        table, spliced = _compress(kept, turn)
        table = cut(table)
        removals.append(("link", cut(spliced)))
        left, done = _finish(table)
        finished.append(cut(done))
        table = cut(left)
        turn += 1
    result = _solve(table)
    for done in finished:
        result = result.unionByName(done)
    if removals:
        result = cut(result)
    for kind, removed in reversed(removals):
        via = result.select(F.col("id").alias("via"), "tree", "cycle", "depth", "enter", F.col("leave").alias("via_leave"))
        joined = join_spread(removed, via, "via", "id") if kind == "leaf" else removed.join(via, "via")
        if kind == "leaf":
            added = joined.select("id", "tree", "cycle", (F.col("depth") + F.col("w")).alias("depth"), (F.col("enter") + F.col("offset")).alias("enter"), (F.col("enter") + F.col("offset") + F.col("own")).alias("leave"))
        else:
            on_cycle = F.col("cycle").isNotNull() & (F.col("via") == F.col("tree"))
            pick = lambda there, else_: F.when(on_cycle, there).otherwise(else_)
            added = joined.select(
                "id", pick(F.col("id"), F.col("tree")).alias("tree"), "cycle", pick(F.lit(0), F.col("depth") - F.col("w")).alias("depth"),
                pick(F.lit(0), F.col("enter") - F.col("offset")).alias("enter"), pick(F.col("own"), F.col("via_leave")).alias("leave"),
            )
        result = cut(result.unionByName(added))
    return result


def with_hashed_ids(nodes: DataFrame, bits: int = 64) -> DataFrame:
    """nodes (node, parent, no node twice) with id and parent_id: 64-bit hashes, and others for the few nodes whose hash is taken.

    Of the nodes with one hash the least keeps it, the others get the next seed's, and so on until all differ. bits
    takes fewer bits of the hashes, so that tests meet collisions.
    """
    take = lambda seed, c: F.shiftright(F.xxhash64(seed, F.col(c)), 64 - bits)
    moved: DataFrame | None = None  # node, seed of the nodes that don't have the first hash
    seed = 0
    while True:
        hashed = nodes
        for column, name in (("id", "node"), ("parent_id", "parent")):
            if moved is None:
                hashed = hashed.withColumn(column, take(F.lit(0), name))
            else:
                seeds = moved.select(F.col("node").alias(name), F.col("seed").alias("__seed"))
                hashed = hashed.join(broadcast_if_small(seeds), name, "left").withColumn(column, take(F.coalesce("__seed", F.lit(0)), name)).drop("__seed")
        hashed = hashed.withColumn("parent_id", F.when(F.col("parent").isNotNull(), F.col("parent_id")))
        taken = hashed.groupBy("id").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1").select("id", "least")
        if not taken.head(1):
            return hashed
        seed += 1
        again = hashed.join(taken, "id").filter(F.col("node") != F.col("least")).select("node", F.lit(seed).alias("seed"))
        if moved is not None:
            again = again.unionByName(moved.join(again.select("node"), "node", "left_anti"))
        moved = cut(again)


def hierarchy(links: DataFrame, core_nodes: int = CORE_NODES) -> DataFrame:
    """node, parent, root, depth, in_cycle, tree, enter, leave from (node, parent) rows of strings.

    root is the top of the tree, or, where parents never end, the smallest node on the cycle with depth -1;
    in_cycle marks the nodes on a cycle itself. tree, enter and leave are the interval of the node's subtree.
    """
    links = links.select("node", "parent").filter(F.col("node").isNotNull())
    # one shuffle: parents are nodes too, with no parent of their own unless another row names it
    every = links.unionByName(links.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")).filter(F.col("node").isNotNull()))
    nodes = with_hashed_ids(cut(every.groupBy("node").agg(F.min("parent").alias("parent"))))
    found = forest(nodes.select("id", F.col("parent_id").alias("parent")), core_nodes)
    rows = cut(nodes.drop("parent_id").join(found, "id").withColumn("top", F.coalesce("cycle", "tree")))
    in_cycle = F.col("cycle").isNotNull() & (F.col("id") == F.col("tree"))
    tops = rows.filter(in_cycle | (F.col("cycle").isNull() & (F.col("id") == F.col("tree")))).groupBy("top").agg(F.min("node").alias("root"))
    return join_spread(rows, tops, "top", "id").select(
        "node", "parent", "root", F.when(F.col("cycle").isNotNull(), -1).otherwise(F.col("depth")).cast("int").alias("depth"), in_cycle.alias("in_cycle"), "tree", "enter", "leave"
    )


def descendants_of(tree: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, descendant for the nodes of chosen (column node), from the intervals of hierarchy(); cycles are cut at their nodes.

    Each interval is cut into blocks of 2, 4, 8 ... positions, at most two of a width; a node meets the blocks that
    hold its position by equality, so that nothing but the pairs themselves is made, however large a tree is.
    """
    tops = join_spread(tree, chosen.select("node").distinct(), "node", "enter")
    tops = tops.filter("leave > enter + 1").select(F.col("node").alias("ancestor"), "tree", (F.col("enter") + 1).alias("low"), F.col("leave").alias("high"))
    cover = tops.select("ancestor", "tree", F.explode(F.expr(_BLOCKS)).alias("b")).select("ancestor", "tree", "b.width", "b.block")
    widths = [r.width for r in cover.select("width").distinct().collect()]  # at most 63
    if not widths:
        return tops.select(F.col("ancestor").alias("node"), F.col("ancestor").alias("descendant")).limit(0)
    own = F.array(*[F.struct(F.lit(w).alias("width"), F.shiftright("enter", w).alias("block")) for w in sorted(widths)])
    inside = tree.select(F.col("node").alias("descendant"), "tree", F.explode(own).alias("b")).select("descendant", "tree", "b.width", "b.block")
    return cover.join(inside, ["tree", "width", "block"]).select(F.col("ancestor").alias("node"), "descendant")


#: The dyadic blocks (exponent of the width, number) that make up [low, high): from the left and from the right of each width.
_BLOCKS = """
filter(flatten(transform(sequence(0, 62), w -> array(
  if(shiftright(low + shiftleft(1L, w) - 1, w) < shiftright(high, w) and shiftright(low + shiftleft(1L, w) - 1, w) % 2 = 1,
     named_struct('width', w, 'block', shiftright(low + shiftleft(1L, w) - 1, w)), null),
  if(shiftright(low + shiftleft(1L, w) - 1, w) < shiftright(high, w) and shiftright(high, w) % 2 = 1,
     named_struct('width', w, 'block', shiftright(high, w) - 1), null)))), b -> b is not null)
"""


def full_paths(tree: DataFrame, from_cycles: bool = False) -> DataFrame:
    """node, path: the nodes from the root down to the node, by doubling the known lower part in each round.

    A path holds as many names as its depth. Nodes on or below a cycle have none (null), or with from_cycles
    the path from the cycle node that they hang from. A round looks up the upper parts of the paths still open and
    carries these alone; what is finished stays where it was written.
    """
    sound = tree if from_cycles else tree.filter(F.col("depth") >= 0)
    top = F.col("in_cycle") | (F.col("depth") == 0)
    open_ = cut(sound.select("node", F.array("node").alias("path"), F.when(~top, F.col("parent")).alias("above")))
    done: list[DataFrame] = []
    while True:
        done.append(open_.filter(F.col("above").isNull()).select("node", "path"))
        rest = open_.filter(F.col("above").isNotNull())
        if not rest.head(1):
            break
        known = rest.select("node", "path", "above")
        for part in done:
            known = known.unionByName(part.withColumn("above", F.lit(None).cast("string")))
        upper = known.select(F.col("node").alias("above"), F.col("path").alias("upper"), F.col("above").alias("next"))
        open_ = cut(join_spread(rest, upper, "above", "node").select("node", F.concat("upper", "path").alias("path"), F.col("next").alias("above")))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole if from_cycles else whole.unionByName(tree.filter(F.col("depth") < 0).select("node", F.lit(None).cast("array<string>").alias("path")))


def descendant_pairs(tree: DataFrame, from_cycles: bool = False) -> DataFrame:
    """node, descendant, distance for every node above another; as many rows as the depths add up to.

    With from_cycles also on and below cycles, which are cut at their nodes as in the intervals of hierarchy().
    """
    steps = full_paths(tree, from_cycles).filter(F.size("path") > 1).select(F.col("node").alias("descendant"), (F.size("path") - 1).alias("depth"), F.posexplode("path").alias("at", "node"))
    return steps.filter(F.col("at") < F.col("depth")).select("node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
