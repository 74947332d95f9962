"""Clusters: trigger hits by rule family, host and time bucket, scored with supporting and counter signals."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import cluster_score, cluster_tier, computed, short_hash
from .graph import saved, spread
from .rules import BY_NAME, CHANNELS, EXTERNAL, FAMILIES, Family, low, prepared

#: Columns of an event that rules about a cluster's first event, or about its members, read.
FIRST = ["proc", "ppath", "usr", "tfile", "ip", "user_agent", "vol_path", "vol_base", "hour", "minute"]
FLAGS = ["common_process", "known_hash"]
#: Columns of an event that clusters read besides those that rules name.
OWN = ["event_id", "case_id", "host_name", "timestamp", "epoch", "user", "remote_ip", "target_file", "kind", "usr", *FIRST, *FLAGS]
#: Slots of 1, 8, 64, 512 and 4096 seconds, of which a span of time is put together.
BASE, LEVELS = 8, 5
#: How long the text of the rules is at most that one number of with_bits() holds.
RULE_TEXT = 1_200


def trigger_hits(events: DataFrame, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """(event columns, constructor, trigger, base, bucket, lead, who): one row for each rule that an event meets.

    who is the user for families whose clusters are of a host and user, else null. lead is 1 for the first rule of a family that an event meets. One narrow pass over columns that are computed once; no shuffle.
    """
    rows = events if "kind" in events.columns else prepared(events)
    rows = rows.withColumns({c: F.lit(False) for c in FLAGS if c not in rows.columns})
    member = {f"m_{c.name}": F.expr(c.when) for f in families for c in f.counters if c.on == "member" and c.when not in FLAGS}
    rows = rows.withColumns(member)
    keep = ["event_id", "case_id", "host_name", "timestamp", "epoch", "user", "remote_ip", "target_file", *(c for c in FIRST if c not in ("user", "remote_ip")), *FLAGS, *member]

    rows, numbers = with_bits(rows, "met", [[t.when for t in f.triggers] for f in families])
    table = [(n, 1 << k, f.name, t.name, t.base, f.window, f.by_user) for n, f in enumerate(families) for k, t in enumerate(f.triggers)]
    table = events.sparkSession.createDataFrame(table, "family int, rule long, constructor string, trigger string, base int, window int, by_user boolean")
    met = rows.select(*keep, F.posexplode(F.array(*numbers)).alias("family", "met")).where("met <> 0")
    hits = met.join(F.broadcast(table), "family").where(F.col("met").bitwiseAND(F.col("rule")) != 0)  # the rules, not data
    lead = F.col("met").bitwiseAND(F.col("rule") - 1) == 0
    at = F.when(F.col("window").isNull(), F.lit(0)).when(F.col("window") <= 0, F.col("epoch")).otherwise(F.col("epoch") - F.pmod(F.col("epoch"), F.greatest("window", F.lit(1))))
    who = F.when(F.col("by_user"), F.coalesce("user", F.lit("")))
    return hits.select(*keep, "constructor", "trigger", "base", at.cast("long").alias("bucket"), lead.cast("int").alias("lead"), who.alias("who"))


def cluster_id(*more_keys: str) -> Column:
    return F.concat(F.lit("cluster-"), F.substring(F.sha2(F.concat_ws("|", "constructor", "host_name", F.col("bucket").cast("string"), "who", *more_keys), 256), 1, 16))


def group_hits(hits: DataFrame, *more_keys: str) -> DataFrame:
    """Clusters without scores. more_keys: further grouping columns, such as user or remote_ip.

    A cluster has counts, the fields of its first event that rules read (as first), and what holds for any member (as any); its
    members stay rows, see cluster_members(). Everything is combined before the shuffle, so a hot host sends a row for each bucket and task.
    """
    keys = ["case_id", "constructor", "host_name", "bucket", "who", *more_keys]
    members = [c for c in hits.columns if c in FLAGS or c.startswith("m_")]
    order = F.struct("timestamp", "event_id", "lead", "base", "trigger")
    out = hits.groupBy(*keys).agg(
        F.array_sort(F.collect_set("trigger")).alias("triggers_fired"), F.max("base").alias("base_score"), F.sum("lead").alias("n_members"),
        F.min("timestamp").alias("time_start"), F.max("timestamp").alias("time_end"), F.min("epoch").alias("start_epoch"), F.max("epoch").alias("end_epoch"), F.min_by("trigger", order).alias("first_trigger"),
        F.min_by(F.struct(*[F.col(c) for c in FIRST if c in hits.columns], F.col("epoch").alias("epoch")), order).alias("first"), F.struct(*[F.bool_or(c).alias(c) for c in members]).alias("any"),
    )
    return out.withColumn("cluster_id", cluster_id(*more_keys))


def cluster_members(hits: DataFrame, *more_keys: str) -> DataFrame:
    """(cluster_id, event_id): one row for each member, without a shuffle. Events are told apart by their id."""
    return hits.where("lead = 1").select(cluster_id(*more_keys).alias("cluster_id"), "event_id")


def slots(lo: Column, hi: Column) -> Column:
    """The fewest slots (level, slot) that cover lo to hi seconds, both included: at most 14 of each level below the last."""
    size = [BASE**k for k in range(LEVELS)]
    first = [F.ceil(lo / n).cast("long") for n in size]
    after = [F.floor((hi + 1) / n).cast("long") for n in size]
    none = F.array().cast("array<bigint>")
    run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(none)
    at = lambda k: lambda x: F.struct(F.lit(k).alias("level"), x.alias("slot"))
    parts = []
    for k in range(LEVELS):
        own = run(first[k], after[k])
        if k + 1 < LEVELS:
            inner = first[k + 1] < after[k + 1]
            own = F.when(inner, F.concat(run(first[k], first[k + 1] * BASE), run(after[k + 1] * BASE, after[k]))).otherwise(own)
        parts.append(F.transform(own, at(k)))
    return F.concat(*parts)


def over_context(clusters: DataFrame, rows: DataFrame, window: int | str, aggregates: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]]) -> DataFrame:
    """(cluster_id, aggregates) over the rows of a cluster's host within window seconds of it, both ends included.

    aggregates: name: (of a column of that name in rows, of partial results), such as (F.count, F.sum). window is a number or a
    column of clusters. Rows are first combined by host and slot of time, for slots of several sizes; a cluster then meets
    the few slots that its span is put together of, each of them one row. So no cluster meets the events themselves, and the
    join has at most one row for each key on that side, however busy a host is.
    """
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("epoch") / BASE**k).cast("long").alias("slot")) for k in range(LEVELS)])).alias("s")
    by_second = rows.groupBy("host_name", "epoch").agg(*[f(F.col(c)).alias(c) for c, (f, _) in aggregates.items()])
    by_slot = by_second.select("host_name", *aggregates, level).select("host_name", *aggregates, "s.*").groupBy("host_name", "level", "slot").agg(*[g(F.col(c)).alias(c) for c, (_, g) in aggregates.items()])
    reach = F.col(window) if isinstance(window, str) else F.lit(window)
    span = clusters.select("cluster_id", "host_name", F.explode(slots(F.col("start_epoch") - reach, F.col("end_epoch") + reach)).alias("s")).select("cluster_id", "host_name", "s.*")
    return span.join(by_slot, ["host_name", "level", "slot"]).groupBy("cluster_id").agg(*[g(F.col(c)).alias(c) for c, (_, g) in aggregates.items()])


def _bits(rules: list[str]) -> Column:
    """A number with a bit for each rule that holds."""
    return reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.expr(r), F.lit(1 << k)).otherwise(0).cast("long") for k, r in enumerate(rules)], F.lit(0).cast("long"))


def with_bits(df: DataFrame, name: str, groups: list[list[str]]) -> tuple[DataFrame, list[Column]]:
    """df with more columns, and for each group of rules a number of those that has a bit for each rule that holds.

    A column holds some of the rules and is behind a generator: the code that Spark makes of it is then a method of its own, and short
    enough for the JVM to compile it. One method of all rules is interpreted, byte by byte.
    """
    numbers, made = [], 0
    for rules in groups:
        parts, size = [[]], 0
        for r in rules:
            if parts[-1] and size + len(r) > RULE_TEXT:
                parts, size = [*parts, []], 0
            parts[-1].append(r)
            size += len(r)
        number, before = F.lit(0).cast("long"), 0
        for part in parts:
            df = computed(df, **{f"{name}_{made}": _bits(part)})
            number = number.bitwiseOR(F.shiftleft(f"{name}_{made}", before))
            made, before = made + 1, before + len(part)
        numbers.append(number)
    return df, numbers


def _total(rules: list[tuple[Column, int]]) -> Column:
    return reduce(lambda x, y: x + y, [F.when(applies, points).otherwise(0) for applies, points in rules], F.lit(0))


def with_signals(clusters: DataFrame, events: DataFrame, families: tuple[Family, ...] = FAMILIES, lists: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds support, counter_evidence, counter, score and tier.

    lists: (value) by the name of a counter that wants one. All signals of all families are bits of one number for each event,
    so one join with the context serves them all.
    """
    rows = events if "kind" in events.columns else prepared(events)
    names = [f.name for f in families]
    rules = list(dict.fromkeys(s.when for f in families for s in f.signals if s.on == "context"))
    mine = clusters.where(F.col("constructor").isin(names))
    windows = F.create_map(*[F.lit(x) for f in families for x in (f.name, f.window or 0)])
    outside = F.when(F.expr(EXTERNAL), F.col("ip"))
    seen, (signals, channels) = with_bits(rows.where("epoch IS NOT NULL"), "met", [rules, CHANNELS])
    found = F.struct(signals.alias("signals"), channels.alias("channels"), outside.alias("low_ip"), outside.alias("high_ip"))
    flags = computed(seen, found=found).select("host_name", "epoch", "found.*")  # the filter would else go through all rules once more
    flags = flags.where("signals <> 0 OR channels <> 0 OR low_ip IS NOT NULL")
    near = over_context(mine.withColumn("reach", windows[F.col("constructor")]), flags, "reach", {"signals": (F.bit_or, F.bit_or), "channels": (F.bit_or, F.bit_or), "low_ip": (F.min, F.min), "high_ip": (F.max, F.max)})
    out = mine.select("*", "first.*", "any.*").join(near, "cluster_id", "left").na.fill(0, ["signals", "channels"])
    logons = rows.where("kind = 'AUTHENTICATION' AND usr <> ''").groupBy("host_name", "usr").agg(F.min("epoch").alias("first_logon"))
    out = out.join(logons, ["host_name", "usr"], "left").withColumn("new_target", (F.col("usr") != "") & F.coalesce(F.col("first_logon") >= F.col("epoch") - 86400, F.lit(True)))
    listed = {}
    for f in families:
        for c in f.counters:
            if c.on == "list" and c.name in (lists or {}):
                listed[c.name] = f"listed_{c.name}"
                known = lists[c.name].select(F.lower("value").alias("value")).distinct().withColumn(listed[c.name], F.lit(True))
                out = out.join(known, F.lower(F.col(c.when)) == F.col("value"), "left").drop("value")

    def signal(s) -> Column:
        met = F.col("signals").bitwiseAND(F.lit(1 << rules.index(s.when))) != 0 if s.on == "context" else F.coalesce(F.expr(s.when), F.lit(False))
        return met != F.lit(s.absent)

    def counter(c) -> Column:
        met = (F.col(listed[c.name]) if c.name in listed else F.lit(False)) if c.on == "list" else F.col(c.when if c.when in FLAGS else f"m_{c.name}") if c.on == "member" else F.expr(c.when)
        return F.coalesce(met, F.lit(False))

    by_name = lambda make: F.coalesce(*[F.when(F.col("constructor") == f.name, make(f)) for f in families])
    check = lambda c: F.struct(F.lit(c.name).alias("signal"), counter(c).alias("applies"), F.lit(c.penalty).alias("weight"))
    out = out.withColumn("counter_evidence", by_name(lambda f: F.array(*[check(c) for c in f.counters])))
    out = out.withColumn("supporting", by_name(lambda f: F.array_compact(F.array(*[F.when(signal(s), F.lit(s.name)) for s in f.signals]))))
    out = out.withColumn("support", by_name(lambda f: _total([(signal(s), s.weight) for s in f.signals])))
    out = out.withColumn("counter", F.aggregate(F.filter("counter_evidence", lambda c: c["applies"]), F.lit(0), lambda t, c: t + c["weight"]))
    out = out.select(*clusters.columns, "supporting", "support", "counter_evidence", "counter")
    return out.withColumn("score", cluster_score(F.col("base_score"), F.col("support"), F.col("counter"))).withColumn("tier", cluster_tier(F.col("score")))


def common_processes(rows: DataFrame, least: int = 100) -> DataFrame:
    """(host_name, proc): processes seen more than least times on a host."""
    return rows.where("kind = 'PROCESS_EXECUTION' AND proc <> ''").groupBy("host_name", "proc").count().where(F.col("count") > least).select("host_name", "proc", F.lit(True).alias("common_process"))


def first_accesses(rows: DataFrame, seconds: int = 86400) -> DataFrame:
    """(event_id, first_access): authentications whose user had none on that host in the day before."""
    from pyspark.sql import Window

    before = F.lag("epoch").over(Window.partitionBy("host_name", "user").orderBy("epoch", "event_id"))
    auth = rows.where("kind = 'AUTHENTICATION' AND coalesce(user, '') <> ''").withColumn("gap", F.col("epoch") - before)
    return auth.where(F.col("gap").isNull() | (F.col("gap") > seconds)).select("event_id", F.lit(True).alias("first_access"))


def enriched(events: DataFrame, hash_list: DataFrame | None = None, least: int = 100, path_hashes: DataFrame | None = None) -> DataFrame:
    """prepared() with the flags that need other rows: common_process and known_hash.

    hash_list: (md5) of known files. path_hashes: (path, md5), for processes without a hash of their own.
    """
    processes = events.select("host_name", F.coalesce("canonical_type", F.lit("")).alias("kind"), low("process_name").alias("proc"))
    common = saved(common_processes(processes, least))  # a table, as Spark then knows whether it is small enough to be sent to all tasks
    rows = prepared(spread(events)).join(common, ["host_name", "proc"], "left")
    if hash_list is None:
        return rows.withColumn("known_hash", F.lit(False)).na.fill(False, ["common_process"])
    rows = rows.withColumn("md5_low", F.lower(F.nullif(F.col("md5"), F.lit(""))))
    if path_hashes is not None:
        by_path = path_hashes.select(F.translate(F.lower("path"), "\\", "/").alias("ppath"), F.lower("md5").alias("md5_path")).groupBy("ppath").agg(F.min("md5_path").alias("md5_path"))
        rows = rows.join(by_path, "ppath", "left").withColumn("md5_low", F.coalesce("md5_low", "md5_path")).drop("md5_path")
    known = hash_list.select(F.lower("md5").alias("md5_low")).distinct().withColumn("known_hash", F.lit(True))
    rows = rows.join(known, "md5_low", "left").drop("md5_low").na.fill(False, ["common_process", "known_hash"])
    return rows.withColumn("known_hash", F.col("known_hash") & (F.col("kind") == "PROCESS_EXECUTION"))


def read_by_rules(rows: DataFrame, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """rows with the columns alone that clusters of these families read; a column counts as read if a rule holds its name as a word."""
    rules = [EXTERNAL, *CHANNELS, *(x.when for f in families for x in (*f.triggers, *f.signals, *f.counters))]
    words = {w.lower() for rule in rules for w in re.findall(r"\w+", rule)}.union(OWN)
    return rows.select(*[c for c in rows.columns if c.lower() in words])


def build_clusters(events: DataFrame, families: tuple[Family, ...] = FAMILIES, hash_list: DataFrame | None = None, lists: dict[str, DataFrame] | None = None) -> DataFrame:
    """Scored clusters of all families."""
    # each stage is a table: rules then read plain columns, and the plan of a stage stays small
    rows = saved(read_by_rules(enriched(events, hash_list), families))
    return with_signals(saved(group_hits(trigger_hits(rows, families))), rows, families, lists)


def run_statistics(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("score") >= 70).alias("strong"), F.count_if(F.col("constructor").isin("LogClearing", "Timestomp", "ShadowDeletion")).alias("anti_forensic"))


def upsert(old: DataFrame, new: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Rows of new replace rows of old with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


__all__ = ["BY_NAME", "FAMILIES", "build_clusters", "cluster_members", "enriched", "group_hits", "over_context", "run_statistics", "short_hash", "trigger_hits", "upsert", "with_signals"]
