"""Entities and edges of canonical events, neighbours, paths and trees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.exprs import is_internal, short_hash
from . import bits


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below a temporary one where that is unset on a single machine.

    What lies there is read for as long as a DataFrame made from it is used, so a job that is over deletes its checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="casegraph-")  # one machine
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir and read again: an iteration's plan stays short and survives lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over three tasks a core: rules and parsing take far longer than reading, and a file may have few row groups."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def _id(kind: str, key: Column) -> Column:
    return short_hash(F.col("case_id"), F.lit(kind), key)


def _made(kind: str, when: Column, key: Column) -> Column:
    return F.when(when, F.struct(_id(kind, key).alias("entity_id"), F.lit(kind).alias("entity_type"), key.alias("entity_key")))


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def _kinds(any_process: bool) -> dict[str, tuple[Column, Column]]:
    process = _filled("process_name") & F.col("pid").isNotNull() & (F.lit(any_process) | (F.col("canonical_type") == "PROCESS_EXECUTION"))
    return {
        "host": (_filled("host_name"), F.col("host_name")),
        "user": (_filled("user"), F.col("user")),
        "process": (process, F.concat_ws(":", "host_name", F.col("pid").cast("string"), F.unix_timestamp("timestamp").cast("string"))),
        "file": (_filled("target_file"), F.concat_ws(":", "host_name", "target_file")),
        "ip": (_filled("remote_ip"), F.col("remote_ip")),
        "registry": (_filled("registry_key"), F.concat_ws(":", "host_name", "registry_key")),
        "service": (F.col("canonical_type") == "SERVICE_INSTALLATION", F.concat_ws(":", "host_name", F.coalesce("process_name", F.lit("service")))),
    }


def entities(events: DataFrame, any_process: bool = True) -> DataFrame:
    """(entity_id, case_id, entity_type, entity_key, first_seen, last_seen, seen_count, internal)"""
    made = F.array_compact(F.array(*[_made(k, *v) for k, v in _kinds(any_process).items()]))
    rows = events.select("case_id", "timestamp", F.explode(made).alias("e")).select("case_id", "timestamp", "e.*")
    out = rows.groupBy("entity_id", "case_id", "entity_type", "entity_key").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("seen_count"))
    return out.withColumn("internal", F.when(F.col("entity_type") == "ip", is_internal(F.col("entity_key"))))


def edges(events: DataFrame, any_process: bool = True) -> DataFrame:
    """(edge_id, case_id, from_id, to_id, edge_type, timestamp): equal edges merge."""
    k = _kinds(any_process)
    ident = {name: _id(name, key) for name, (_, key) in k.items()}

    def edge(a: str, b: str, kind: str, when: Column) -> Column:
        return F.when(when & k[a][0] & k[b][0], F.struct(ident[a].alias("from_id"), ident[b].alias("to_id"), F.lit(kind).alias("edge_type")))

    t = F.col("canonical_type")
    made = F.array_compact(F.array(
        edge("user", "host", "authenticated_as", t == "AUTHENTICATION"), edge("process", "user", "spawned_by", t == "PROCESS_EXECUTION"), edge("process", "file", "wrote", t.isin("FILE_CREATION", "FILE_MODIFICATION")),
        edge("user", "file", "accessed", t.startswith("FILE_")), edge("process", "ip", "connected_to", t == "NETWORK_CONNECTION"), edge("process", "registry", "modified", t == "REGISTRY_MODIFICATION"),
        edge("service", "host", "persists_via", t == "SERVICE_INSTALLATION"), edge("host", "ip", "accessed", t == "NETWORK_CONNECTION"), edge("host", "file", "accessed", t.startswith("FILE_")), edge("host", "registry", "accessed", t == "REGISTRY_MODIFICATION"), edge("host", "process", "accessed", t == "PROCESS_EXECUTION"),
    ))
    rows = events.select("case_id", "timestamp", F.explode(made).alias("e")).select("case_id", "timestamp", "e.*")
    rows = rows.withColumn("edge_id", short_hash(F.col("from_id"), F.col("to_id"), F.col("edge_type"), F.unix_timestamp("timestamp")))
    return rows.dropDuplicates(["edge_id"])


def neighbours(edges_: DataFrame, ids: DataFrame, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """(entity_id, neighbour_id, edge_type, direction) of the entities in ids (entity_id)."""
    rows = edges_.where(F.col("edge_type") == edge_type) if edge_type else edges_
    out = rows.join(ids.select(F.col("entity_id").alias("from_id")), "from_id").select(F.col("from_id").alias("entity_id"), F.col("to_id").alias("neighbour_id"), "edge_type", F.lit("out").alias("direction"))
    into = rows.join(ids.select(F.col("entity_id").alias("to_id")), "to_id").select(F.col("to_id").alias("entity_id"), F.col("from_id").alias("neighbour_id"), "edge_type", F.lit("in").alias("direction"))
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


def components(links: DataFrame) -> DataFrame:
    """(node, part): the nodes of links (a, b), whose direction doesn't count; nodes have equal parts if links connect them.

    In each round a node goes over to the one of its neighbours, or itself, that is first in an order drawn anew, and links that then lie
    within a node go; a constant share of the nodes goes with them, so there are about as many rounds as the logarithm of their number.
    """
    edge = saved(links.select("a", "b").where("a <> b").distinct())
    part = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).where("node IS NOT NULL").distinct()
    part, k = saved(part.select("node", F.col("node").alias("part"))), 0
    while not edge.isEmpty():
        first = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("at"), F.col(c).alias("to"))  # noqa: B023, E731
        near = edge.select("a", F.least(first("a"), first("b")).alias("f")).unionByName(edge.select(F.col("b").alias("a"), F.least(first("a"), first("b")).alias("f")))
        over = saved(near.groupBy("a").agg(F.min("f").alias("f")).select(F.col("a").alias("from"), "f.to"))
        x, y = over.select(F.col("from").alias("a"), F.col("to").alias("a_to")), over.select(F.col("from").alias("b"), F.col("to").alias("b_to"))
        edge = saved(edge.join(x, "a").join(y, "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        part, k = saved(part.join(over, F.col("part") == F.col("from"), "left").select("node", F.coalesce("to", "part").alias("part"))), k + 1
    return part


def nodes(links: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(name, id, n): the ends of links (a, b) and the names in more (name), numbered, with the rows that name them."""
    ends = links.select(F.explode(F.array("a", "b")).alias("name"))
    ends = (ends if more is None else ends.unionByName(more)).where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return saved(ends.repartitionByRange("name").sortWithinPartitions("name").withColumn("id", F.monotonically_increasing_id()))  # nodes of a kind lie together


def by_number(links: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n): links by the numbers of their ends, with the rows that name each end; links of a node with itself or null are left out."""
    links = links.select("a", "b").where("a <> b")
    for c in ("a", "b"):
        links = links.join(names.select(F.col("name").alias(c), "id", F.col("n").alias(f"{c}_n")), c).drop(c).withColumnRenamed("id", c)
    return links


def numbered(links: DataFrame, both: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) by number, each once, and the names of their nodes (name, id). With both, links go both ways, and are named once."""
    names = nodes(links.where("a <> b"))
    links = by_number(links, names)
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) if both else links.select("a", "b")
    return saved(links.distinct()), names.select("name", "id")


def reach(links: DataFrame, start: DataFrame, depth: int, both: bool = False) -> DataFrame:
    """(src, node, depth): nodes within depth steps along links (a, b) of the start nodes (src), by the fewest steps; with both, links go both ways.

    The start nodes search together, as bits of rows of words. A link lies in the part of that of its ends with fewer links, so a row of
    words goes to a part, or comes from it, once for all links there: a node with many links costs a row for each part, not for each
    link. Each round extends only the bits found in the round before, and drops those already seen; bits become rows at the end.
    """
    first = start.select(F.col("src").alias("name")).where("name IS NOT NULL").distinct()
    names = nodes(links, first)
    many = first.count()
    groups, wide = max(1, -(-many // (64 * bits.WORDS))), min(bits.WORDS, max(1, -(-many // 64)))
    place = F.monotonically_increasing_id()  # neighbours in the order of start nodes share words
    first = saved(names.join(first, "name", "left_semi").repartitionByRange(groups, "name").sortWithinPartitions("name").withColumn("place", place).select("name", "id", F.floor(F.col("place") / (64 * bits.WORDS)).alias("grp"), (F.col("place") % (64 * bits.WORDS)).cast("int").alias("bit")))
    parts = max(3 * first.sparkSession.sparkContext.defaultParallelism, (names.agg(F.sum("n")).first()[0] or 0) // 2_000_000)
    edge = by_number(links, names).withColumn("home", F.pmod(F.xxhash64(F.when(F.col("a_n") <= F.col("b_n"), F.col("a")).otherwise(F.col("b"))), F.lit(parts)))
    if both:
        edge = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b"), "a_n", "b_n", "home"))
    near = saved(edge.select("a", "home", "b").repartition(parts, "a").mapInArrow(bits.packed, "a long, home long, next array<long>"))
    bit = F.expr(f"transform(sequence(0, {wide - 1}), k -> CASE WHEN k = bit div 64 THEN shiftleft(1L, bit % 64) ELSE 0L END)")
    front = saved(first.select("grp", F.col("id").alias("node"), bit.alias("words")))
    levels = [front]
    for _ in range(depth):
        step = front.join(near, F.col("node") == F.col("a")).select("home", "grp", "words", "next").repartition(parts, "home").select("grp", "words", "next").mapInArrow(bits.pushed, bits.ROWS)
        rows = step.withColumn("seen", F.lit(False))
        for x in levels:
            rows = rows.unionByName(x.withColumn("seen", F.lit(True)))
        front = saved(rows.repartition(parts, "node").sortWithinPartitions("grp", "node").mapInArrow(bits.merged, bits.ROWS))
        if front.isEmpty():
            break
        levels.append(front)
    found = levels[0].withColumn("depth", F.lit(0))
    for k, x in enumerate(levels[1:], 1):
        found = found.unionByName(x.withColumn("depth", F.lit(k)))
    named = found.join(names, F.col("node") == F.col("id")).select("grp", "name", "depth", "words")
    kind = named.schema["name"].dataType.simpleString()
    each = named.mapInArrow(bits.numbers, f"grp long, name {kind}, depth int, bits array<int>").select("grp", F.col("name").alias("node"), "depth", F.explode("bits").alias("bit"))
    each = each.join(first.select("grp", "bit", F.col("name").alias("src")), ["grp", "bit"]).select("src", "node", "depth")
    loose = links.where((F.col("a").isNull() | F.col("b").isNull()) if both else F.col("b").isNull())  # a null is reached too, and leads nowhere
    loose = saved(loose.select(F.coalesce("a", "b").alias("node")).where("node IS NOT NULL").distinct())
    if loose.isEmpty():
        return each
    return each.unionByName(each.where(F.col("depth") < depth).join(loose, "node", "left_semi").groupBy("src").agg((F.min("depth") + 1).alias("depth")).select("src", F.lit(None).cast(kind).alias("node"), "depth"))


def subgraph(edges_: DataFrame, nodes: DataFrame, both: bool = True) -> DataFrame:
    """Edges with both ends, or either end, among nodes (entity_id)."""
    a = edges_.join(nodes.select(F.col("entity_id").alias("from_id")), "from_id", "left_semi")
    if both:
        return a.join(nodes.select(F.col("entity_id").alias("to_id")), "to_id", "left_semi")
    return a.unionByName(edges_.join(nodes.select(F.col("entity_id").alias("to_id")), "to_id", "left_semi")).dropDuplicates(["edge_id"])
