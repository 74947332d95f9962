"""Fewer findings: noise collapsed, disturbances, seeded hypotheses, rolled-up drafts, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lookups import KEEP, NOISE, TECHNIQUES
from ..functions.exprs import short_hash


def has_keep(triggers: str = "triggers_fired") -> Column:
    return F.exists(triggers, lambda t: t.rlike("|".join(KEEP)))


def all_noise(triggers: str = "triggers_fired") -> Column:
    return F.forall(triggers, lambda t: t.isin(*NOISE))


def is_noise(triggers: str = "triggers_fired") -> Column:
    return ~F.col("tier").isin("STRONG", "MODERATE") & ~has_keep(triggers) & all_noise(triggers)


def collapse_noise(clusters: DataFrame) -> DataFrame:
    """Clusters, with noise replaced by one WEAK aggregate for each case, host and type."""
    noise = clusters.where(is_noise()).groupBy("case_id", "host_name", "constructor").agg(F.count(F.lit(1)).alias("collapsed"), F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"), F.min("score").alias("score"), F.max("score").alias("max_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("triggers_fired")))).alias("triggers_fired"))
    noise = noise.withColumn("cluster_id", F.concat_ws("-", F.lit("aggregate"), "case_id", "host_name", "constructor")).withColumn("tier", F.lit("WEAK"))
    return clusters.where(~is_noise()).unionByName(noise, allowMissingColumns=True)


def disturbances(clusters: DataFrame) -> DataFrame:
    """(case_id, host_name, kind, start, end, cluster_id): when evidence on a host was tampered with."""
    minutes = F.when(F.col("constructor") == "LogClearing", 15).when(F.col("constructor") == "ShadowDeletion", 30)
    rows = clusters.withColumn("m", minutes).where("m IS NOT NULL")
    pad = F.make_dt_interval(mins=F.col("m"))
    return rows.select("case_id", "host_name", F.col("constructor").alias("kind"), (F.col("time_start") - pad).alias("start"), (F.col("time_end") + pad).alias("end"), "cluster_id")


def tampered_files(clusters: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """(host_name, target_file): files in timestamp-tampering clusters. members: (cluster_id, event_id)."""
    ids = members.join(clusters.where("constructor = 'Timestomp'").select("cluster_id"), "cluster_id", "left_semi").select("event_id").distinct()
    return events.join(ids, "event_id", "left_semi").where("coalesce(target_file, '') <> ''").select("host_name", "target_file").distinct()


def technique(trigger: Column) -> Column:
    """The technique of a trigger: equal names first, then the first entry that contains it or is contained."""
    pairs = [x for k, v in TECHNIQUES.items() for x in (F.lit(k), F.lit(v))]
    out = F.try_element_at(F.create_map(*pairs), trigger)
    part = None
    for k, v in TECHNIQUES.items():
        met = trigger.contains(k) | F.lit(k).contains(trigger)
        part = F.when(met, v) if part is None else part.when(met, v)
    return F.coalesce(out, part)


def seed(clusters: DataFrame, seeded: DataFrame | None = None) -> DataFrame:
    """Draft hypotheses for clusters that are worth one."""
    gate = ~F.col("cluster_id").startswith("aggregate-") & (F.col("tier") != "NOISE") & ~all_noise() & (F.col("tier").isin("STRONG", "MODERATE") | has_keep() | (F.size("triggers_fired") >= 2))
    rows = clusters.where(gate)
    if seeded is not None:
        rows = rows.join(seeded.select("cluster_id").distinct(), "cluster_id", "left_anti")
    return rows.select(
        short_hash(F.lit("hypothesis"), F.col("cluster_id")).alias("hypothesis_id"), "case_id", "cluster_id", "host_name", F.col("constructor").alias("cluster_type"), "triggers_fired", "score", F.col("time_start"), F.col("time_end"),
        F.format_string("%s on %s", "constructor", "host_name").alias("title"), F.format_string("%s: %s", "constructor", F.array_join("triggers_fired", ", ")).alias("observation"), F.array_compact(F.array_distinct(F.transform("triggers_fired", technique))).alias("techniques"), F.lit("DRAFT").alias("status"),
    )


def rollup(drafts: DataFrame) -> DataFrame:
    """Drafts with the same type, host and triggers become the earliest one, with all refs and the floor of the mean score."""
    keys = ["case_id", "cluster_type", "host_name", F.array_sort("triggers_fired").alias("triggers_fired")]
    return drafts.groupBy(*keys).agg(F.min_by("hypothesis_id", F.struct("time_start", "hypothesis_id")).alias("hypothesis_id"), F.array_sort(F.collect_set("cluster_id")).alias("cluster_ids"), F.count(F.lit(1)).alias("merged"), F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"), F.floor(F.avg("score")).alias("score"))


def gaps(profile: DataFrame, clusters: DataFrame) -> DataFrame:
    """(case_id, gap): kinds of evidence that a case lacks. profile: (case_id, artifacts array)."""
    wanted = F.explode(F.array(*[F.lit(x) for x in ("evtx", "memory", "pcap", "registry")]))
    missing = profile.select("case_id", "artifacts", wanted.alias("artifact")).where(~F.array_contains("artifacts", F.col("artifact"))).select("case_id", F.concat(F.lit("missing "), "artifact").alias("gap"))
    few = profile.select("case_id").join(clusters.groupBy("case_id").agg(F.count_distinct("constructor").alias("n")), "case_id", "left").where("coalesce(n, 0) <= 1").select("case_id", F.lit("one kind of finding").alias("gap"))
    return missing.unionByName(few)
