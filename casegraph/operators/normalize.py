"""ECS rows to canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import filled, short_hash
from ..functions.lookups import ACTIONS, ARTIFACTS, CATEGORIES, EVENT_IDS, PLUGINS, TYPES
from ..functions.tables import look_up


def canonical_type(preset: Column, code: Column, action: Column, category: Column, artifact: Column, path: Column, plugin: Column, kind: Column) -> Column:
    """The first that says something: a preset type, the event id, the action, the category, the memory plugin, kind = alert."""
    code_ = F.lower(code)
    p = F.lower(F.coalesce(path, F.lit("")))
    by_path = F.when(p.rlike(r"\.(?:evtx|pf|lnk)$"), "FILE_CREATION").when(p.rlike(r"(?:sam|system|software|security|ntuser\.dat)$"), "REGISTRY_MODIFICATION")
    meta = F.when(code_.isin("unknown", "kape_zip", "e01"), F.lit(None)).otherwise(F.coalesce(look_up(ARTIFACTS, code_), by_path))
    by_category = F.when(category == "artifact", meta).otherwise(look_up(CATEGORIES, category))
    short = F.regexp_extract(F.lower(F.coalesce(plugin, F.lit(""))), r"([^.]*)$", 1)
    return F.coalesce(F.when(preset.isin(*TYPES), preset), look_up(EVENT_IDS, code), look_up(ACTIONS, F.lower(action)), by_category, look_up(PLUGINS, short), F.when(kind == "alert", "ALERT"))


def normalize(ecs: DataFrame, case_id: str, mode: str = "default") -> DataFrame:
    """Canonical events of rows that have a type and a time; mode 'strict' wants a host too and uses 64-digit ids."""
    extra = lambda k: F.try_element_at("extra", F.lit(k))
    kind = canonical_type(extra("canonical_type"), F.col("event_code"), F.col("event_action"), F.col("event_category"), F.col("artifact"), F.col("target_file"), extra("plugin"), extra("kind"))
    rows = ecs.withColumn("canonical_type", kind).where("canonical_type IS NOT NULL AND ts IS NOT NULL")
    if mode == "strict":
        rows = rows.where("coalesce(host_name, '') <> ''")
    # without a name, the log's own computer, then the first part of the source file's path that may be one
    parts = F.filter(F.split(F.translate(F.coalesce(extra("source_file"), F.lit("")), "\\", "/"), "/"), lambda p: F.lower(p).rlike("dc|srv|wkstn|pc|host"))
    rows = rows.withColumn("host_name", F.coalesce(filled(F.col("host_name")), filled(extra("computer")), F.get(parts, 0), F.lit("unknown-host")))
    # a field that is empty may be in the event's data
    data = lambda field, *names: F.coalesce(filled(field), *[filled(extra(n)) for n in names])
    user = data(F.when(filled(F.col("user")).isNotNull(), F.concat(F.coalesce(F.concat(filled(extra("user_domain")), F.lit("\\")), F.lit("")), F.col("user"))), "TargetUserName", "SubjectUserName", "AccountName")
    rows = rows.withColumns({"user": user, "command_line": data(F.col("command_line"), "CommandLine", "ProcessCommandLine"), "remote_ip": data(F.col("remote_ip"), "source_ip", "IpAddress", "ClientAddress")})
    ident = [F.lit(case_id), F.col("host_name"), F.col("canonical_type"), F.unix_millis("ts"), F.col("process_name"), F.col("target_file"), F.col("remote_ip"), F.col("registry_key"), F.col("artifact"), F.col("doc_id")]
    return rows.select(
        short_hash(*ident, size=64 if mode == "strict" else 32).alias("event_id"), F.lit(case_id).alias("case_id"), F.coalesce("host_name", F.lit("")).alias("host_name"), F.col("ts").alias("timestamp"), "canonical_type", F.col("artifact").alias("source_index"), F.col("doc_id").alias("source_doc_id"),
        "user", "process_name", "process_path", "pid", "ppid", "command_line", "target_file", "remote_ip", "remote_port", "registry_key", F.coalesce(filled(F.col("alert_name")), F.when(F.col("canonical_type") == "ALERT", F.col("message"))).alias("alert_name"), "alert_level",
        extra("LogonType").alias("logon_type"), extra("parent_name").alias("parent_name"), F.when(F.col("artifact") == "memory", F.create_map(F.lit("plugin"), extra("plugin"), F.lit("PrivateMemory"), F.coalesce(extra("private_memory"), F.lit("1")))).alias("volatility"), F.col("extra").alias("event_data"),
    )


def normalize_stats(ecs: DataFrame, canonical: DataFrame) -> DataFrame:
    """(scanned, created, skipped): one row."""
    n = F.count(F.lit(1))
    both = ecs.agg(n.alias("scanned"), F.lit(0).cast("long").alias("created")).unionByName(canonical.agg(F.lit(0).cast("long").alias("scanned"), n.alias("created")))
    return both.agg(F.sum("scanned").alias("scanned"), F.sum("created").alias("created")).withColumn("skipped", F.col("scanned") - F.col("created"))
