"""Chains of parents by pointer doubling: the number of rounds follows the logarithm of a chain's length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .graph import saved

#: Members of a walk that are put together as one array; a longer one is rows.
SHORT = 64


def _rings(links: DataFrame) -> DataFrame | None:
    """The nodes (node) of links (node, to), one row a node, that lie on a cycle; None without any.

    What ever more steps lead to shrinks until it is the cycles. A round makes four times the steps and goes on from what is left only, so
    there are as many rounds as the logarithm of the longest way to a cycle, however many nodes there are.
    """
    size = None
    while True:
        ends = links.select(F.col("to").alias("node")).distinct()
        left = ends.count()
        if left == 0 or left == size:
            return saved(ends) if left else None
        size, far = left, links.join(ends, "node", "left_semi")
        for _ in range(3):
            far = far.alias("x").join(links.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", "y.to")
        links = saved(far)


def _jumps(links: DataFrame, most: int | None = None) -> list[DataFrame]:
    """For each k (node, to): the ancestor 2**k steps up, for the nodes that have one; links (node, to) have no cycle."""
    out = [links]
    while most is None or 2 ** len(out) <= most:
        step = saved(out[-1].alias("x").join(out[-1].alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", "y.to"))
        if step.isEmpty():
            break
        out.append(step)
    return out


def depths(parents: DataFrame, labels: str | None = None) -> DataFrame:
    """(node, root, depth) of a forest (node, parent), one row a node; null root and depth in or above a cycle. A node is a root if its parent is null or no node.

    labels names a column of text that is joined by '/' from the root to the node, as path. Each round doubles the steps that a node has
    looked up, and is one join; a chain of n nodes takes log2(n) + 2 rounds.
    """
    names = [labels] if labels else []
    nodes = saved(parents.where("node IS NOT NULL").select("node", "parent", *names))
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    path = [F.col(labels).cast("string").alias("path")] if labels else []
    state = nodes.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("to"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("steps"), F.when(~F.coalesce("known", F.lit(False)), F.col("node")).alias("root"), *path)
    state, size, looked = saved(state), nodes.count(), 1
    # a node that is not done after as many steps as there are nodes is on its way around a cycle
    while looked < 2 * size and not state.where("to IS NOT NULL").isEmpty():
        x, y = state.alias("x"), state.alias("y")
        joined = F.when(F.col("y.path").isNotNull(), F.concat_ws("/", "y.path", "x.path")).otherwise(F.col("x.path")) if labels else None
        state = x.join(y, F.col("x.to") == F.col("y.node"), "left").select("x.node", F.col("y.to").alias("to"), (F.col("x.steps") + F.coalesce("y.steps", F.lit(0))).alias("steps"), F.coalesce("x.root", "y.root").alias("root"), *([joined.alias("path")] if labels else []))
        state, looked = saved(state), 2 * looked
    done = F.col("root").isNotNull()
    return state.select("node", "root", F.when(done, F.col("steps")).cast("int").alias("depth"), *([F.when(done, F.col("path")).alias("path")] if labels else []))


def walks(parents: DataFrame, starts: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(node, position, member): from each start (node) up its parents, itself at position 0, until there is none or a member would repeat, or most steps.

    parents: (node, parent) with one row a node; without starts, each node is one. Walks of up to SHORT members are put together as
    arrays, longer ones as rows, so that a long chain is spread over tasks.
    """
    short, long = chains(parents, starts, most)
    rows = short.select("node", F.posexplode("chain").alias("position", "member")).withColumn("position", F.col("position").cast("long"))
    return rows if long is None else rows.unionByName(long)


def chains(parents: DataFrame, starts: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """What walks() gives: (node, chain), an array for each walk of up to SHORT members, and (node, position, member) of the longer ones, None without any.

    The walks of all nodes double in each round, so one join a round is all there is to do, on cycles too: what a walk is continued by
    ends where it comes to a member of its own. Walks that have ended are not joined or written again.
    """
    parent = F.when(F.col("parent") != F.col("node"), F.col("parent"))
    last = one = saved(parents.where("node IS NOT NULL").select("node", F.array("node").alias("chain"), parent.alias("to")))
    done, size = [last.where("to IS NULL")], 1
    open_ = last.where("to IS NOT NULL")
    while size < SHORT and (most is None or size <= most) and not open_.isEmpty():
        x, y = open_.alias("x"), reduce(DataFrame.unionByName, done, open_).alias("y")
        more, then = F.array_except("y.chain", "x.chain"), F.col("y.to")
        goes_on = (F.size(more) == F.size("y.chain")) & ~F.array_contains("x.chain", then)  # null where there is no more
        step = x.join(y, F.col("x.to") == F.col("y.node"), "left").select("x.node", F.concat("x.chain", F.coalesce(more, F.array("x.to"))).alias("chain"), F.when(goes_on, then).alias("to"))
        last, size = saved(step), 2 * size
        done, open_ = [*done, last.where("to IS NULL")], last.where("to IS NOT NULL")
    ended = most is not None and size > most or open_.isEmpty()
    short = reduce(DataFrame.unionByName, [*done, open_] if ended else done).select("node", "chain")
    out = short if most is None else short.select("node", F.slice("chain", 1, most + 1).alias("chain"))
    long = None if ended else open_.select("node")
    if starts is not None:
        starts = starts.select("node").distinct()
        if long is not None:
            long = long.join(starts, "node", "left_semi")
            starts = starts.join(open_, "node", "left_anti")
        out = starts.join(out, "node", "left").select("node", F.coalesce("chain", F.array("node")).alias("chain"))
    if long is None or long.isEmpty():
        return out, None
    return out, _long_walks(one.where("to IS NOT NULL").select("node", "to"), short, open_.select("node", "to"), long, most)


def _long_walks(one: DataFrame, short: DataFrame, far: DataFrame, starts: DataFrame, most: int | None) -> DataFrame:
    """The walks of starts (node) as rows throughout. The rows of a start double in each round: those at positions that are multiples of 2**(k+1) give those 2**k further.

    one: links (node, to) without those of a node to itself; short: (node, chain) of the walks that ended early; far: (node, to) as many steps up as the others have come.
    """
    # the nodes of a short cycle are where their own walks would go on
    ring, long_rings = short.select("node", F.element_at("chain", -1).alias("last")).join(one.withColumnRenamed("node", "last"), "last").where(F.col("to") == F.col("node")).select("node"), _rings(far)
    ring = saved(ring if long_rings is None else ring.unionByName(long_rings))
    ring = None if ring.isEmpty() else ring
    jumps = _jumps(one if ring is None else saved(one.join(ring, "node", "left_anti")), most)
    rows = saved(starts.select("node", F.lit(0).cast("long").alias("position"), F.col("node").alias("member")))
    for k in reversed(range(len(jumps))):
        if most is not None and 2**k > most:
            continue
        step = rows.join(jumps[k].select(F.col("node").alias("member"), "to"), "member").select("node", (F.col("position") + 2**k).alias("position"), F.col("to").alias("member"))
        if most is not None:
            step = step.where(F.col("position") <= most)
        rows = saved(rows.unionByName(step))
    if ring is None:
        return rows
    # a walk that meets a cycle ends there, on its first node, and goes once around
    entered = saved(rows.join(ring.select(F.col("node").alias("member")), "member", "left_semi").select("node", "position", "member"))
    around = _turns(one.join(ring, "node", "left_semi"), entered.select(F.col("member").alias("node")).distinct()).where("position > 0")
    more = entered.select("node", F.col("position").alias("before"), F.col("member").alias("entry")).join(around.select(F.col("node").alias("entry"), "position", "member"), "entry")
    more = more.select("node", (F.col("before") + F.col("position")).alias("position"), "member")
    return rows.unionByName(more if most is None else more.where(F.col("position") <= most))


def _turns(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, position, member): once around its cycle from each start (node); links (node, to) are cycles only."""
    states = [saved(links.select("node", "to", F.least("node", "to").alias("least")))]
    while True:  # until each node knows the least node of its cycle
        x, y = states[-1].alias("x"), states[-1].alias("y")
        next_ = saved(x.join(y, F.col("x.to") == F.col("y.node")).select("x.node", "y.to", F.least("x.least", "y.least").alias("least"), (F.col("y.least") < F.col("x.least")).alias("moved")))
        if next_.where("moved").isEmpty():
            break
        states.append(next_.drop("moved"))
    size = states[-1].groupBy("least").agg(F.count(F.lit(1)).alias("around"))
    rows = saved(starts.join(states[-1].select("node", "least"), "node").join(size, "least").select("node", F.lit(0).cast("long").alias("position"), F.col("node").alias("member"), "around"))
    for k in reversed(range(len(states))):
        step = rows.join(states[k].select(F.col("node").alias("member"), "to"), "member").select("node", (F.col("position") + 2**k).alias("position"), F.col("to").alias("member"), "around")
        rows = saved(rows.unionByName(step.where("position < around")))
    return rows.select("node", "position", "member")


def process_tree(events: DataFrame, depth: int | None = None) -> DataFrame:
    """(host_name, pid, ppid, process_name, depth, path, root): the last event of a pid wins; a pid whose parent is absent is a root.

    Rows in a cycle, or deeper than depth where that is given, have a null depth, path and root.
    """
    last = F.row_number().over(Window.partitionBy("host_name", "pid").orderBy(F.desc("timestamp"), F.desc("event_id")))
    rows = saved(events.where("pid IS NOT NULL").withColumn("rn", last).where("rn = 1").select("host_name", "pid", "ppid", "process_name"))
    node = lambda pid: F.struct(F.col("host_name"), F.col(pid).cast("long").alias("pid"))
    found = depths(rows.select(node("pid").alias("node"), F.when(F.col("ppid").isNotNull(), node("ppid")).alias("parent"), "pid"), "pid")
    if depth is not None:
        found = found.where(F.col("depth") <= depth)
    found = found.select(F.col("node.host_name").alias("host_name"), F.col("node.pid").alias("pid"), "depth", "path", F.col("root.pid").alias("root"))
    return rows.join(found, ["host_name", "pid"], "left")
