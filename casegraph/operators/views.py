"""Questions to a case: search, timelines, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The fields that free text is looked for in: fixed values.
TEXT = ["command_line", "target_file", "registry_key", "user", "host_name", "alert_name", "process_name", "event_action", "message"]


def search(events: DataFrame, text: str | None = None, *, case_id: str | None = None, kind: str | None = None, host: str | None = None, start: str | None = None, end: str | None = None, fields: list[str] = TEXT) -> DataFrame:
    """Events that meet all the filters; text is 'field:value', or a substring of any field in any case. Sorted by time."""
    rows = events
    for column, value in (("case_id", case_id), ("canonical_type", kind), ("host_name", host)):
        rows = rows.where(F.col(column) == value) if value is not None else rows
    rows = rows.where(F.col("timestamp") >= F.lit(start).cast("timestamp")) if start else rows
    rows = rows.where(F.col("timestamp") <= F.lit(end).cast("timestamp")) if end else rows
    if text and ":" in text and text.split(":", 1)[0] in rows.columns:
        field, value = text.split(":", 1)
        rows = rows.where(F.lower(F.col(field).cast("string")).contains(value.lower()))
    elif text:
        rows = rows.where(any_contains(text, [f for f in fields if f in rows.columns]))
    return rows


def any_contains(text: str, fields: list[str]) -> Column:
    out = F.lit(False)
    for f in fields:
        out = out | F.contains(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit(text.lower()))
    return out


def page(rows: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(size * number).limit(size)


def top_clusters(clusters: DataFrame, least: int = 0, limit: int = 10, constructor: str | None = None, host: str | None = None) -> DataFrame:
    rows = clusters.where(F.col("score") >= least)
    rows = rows.where(F.col("constructor") == constructor) if constructor else rows
    rows = rows.where(F.col("host_name") == host) if host else rows
    return rows.orderBy(F.desc("score"), "cluster_id").limit(limit)


def find_all(clusters: DataFrame, hypotheses: DataFrame, entities: DataFrame, text: str) -> DataFrame:
    """(kind, id, label) of whatever holds the text."""
    part = lambda df, kind, ident, label: df.where(F.contains(F.lower(label), F.lit(text.lower()))).select(F.lit(kind).alias("kind"), F.col(ident).alias("id"), F.col(label).alias("label"))
    return part(clusters, "cluster", "cluster_id", "constructor").unionByName(part(hypotheses, "hypothesis", "hypothesis_id", "title")).unionByName(part(entities, "entity", "entity_id", "entity_key"))


def counts(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def host_rollup(clusters: DataFrame, least: int = 40) -> DataFrame:
    return clusters.groupBy("host_name").agg(F.count(F.lit(1)).alias("clusters"), F.max("end_epoch").alias("last_end"), F.count_if(F.col("score") >= least).alias("notable"))


def host_timeline(events: DataFrame, host: str) -> DataFrame:
    return events.where(F.col("host_name") == host).orderBy("timestamp", "event_id")


def span(events: DataFrame) -> DataFrame:
    return events.groupBy("host_name").agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"), F.count(F.lit(1)).alias("n"))


def file_history(events: DataFrame, name: str) -> DataFrame:
    return events.where(F.contains(F.lower("target_file"), F.lit(name.lower()))).orderBy("timestamp", "event_id")


def network_summary(events: DataFrame) -> DataFrame:
    return events.where("canonical_type = 'NETWORK_CONNECTION'").groupBy("host_name").agg(F.count(F.lit(1)).alias("connections"), F.count_distinct("remote_ip").alias("destinations"))


def registry_summary(events: DataFrame) -> DataFrame:
    return events.where("canonical_type = 'REGISTRY_MODIFICATION'").groupBy("host_name").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("registry_key").alias("keys"))


def service_changes(events: DataFrame) -> DataFrame:
    return events.where("canonical_type = 'SERVICE_INSTALLATION'").groupBy("host_name", "user").agg(F.count(F.lit(1)).alias("n"))


def auth_summary(events: DataFrame, failed: Column) -> DataFrame:
    return events.where("canonical_type = 'AUTHENTICATION'").groupBy("host_name", "user").agg(F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"))


def expand_cluster(members: DataFrame, events: DataFrame) -> DataFrame:
    """(cluster_id, event_id, missing, event columns): members (cluster_id, event_id) as events; those that are gone are reported."""
    return members.join(events.withColumn("_here", F.lit(True)), "event_id", "left").withColumn("missing", F.col("_here").isNull()).drop("_here")


def expand_raw(events: DataFrame, ecs: DataFrame) -> DataFrame:
    return events.join(ecs.withColumnRenamed("doc_id", "source_doc_id"), "source_doc_id")


def case_status(hypotheses: DataFrame, clusters: DataFrame) -> DataFrame:
    """(kind, name, n): hypotheses by status, clusters by tier."""
    a = hypotheses.groupBy(F.lit("hypothesis").alias("kind"), F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(clusters.groupBy(F.lit("cluster").alias("kind"), F.col("tier").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def export(df: DataFrame, path: str, form: str = "json") -> None:
    """json (one object a line) or csv (nested columns as JSON)."""
    if form == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        df.write.option("header", True).csv(path)
    else:
        df.write.json(path)
