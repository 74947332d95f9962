"""Lists and details of a case: events, hypotheses, entities, journal and audit entries, edges, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import short_hash
from .graph import neighbours
from .judge import challenge

TIERS = ["HIGH", "MEDIUM", "LOW", "SPECULATIVE"]


def listed(rows: DataFrame, order: list[Column], limit: int | None, **equal: str | list[str] | None) -> DataFrame:
    """Rows whose columns equal the given values, or are among them, in an order."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column).isin(*value) if isinstance(value, list) else F.col(column) == value)
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def events_by_id(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events whose own id or document id is among ids (id), each once."""
    ids = ids.select("id").distinct()
    own = events.join(ids, events["event_id"] == ids["id"], "left_semi")
    return own.unionByName(events.join(ids, events["event_id"] == ids["id"], "left_anti").join(ids, F.col("source_doc_id") == ids["id"], "left_semi"))


def hypotheses(rows: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Hypotheses (hypothesis_id, status, created_at), the newest first."""
    return listed(rows, [F.desc("created_at"), F.col("hypothesis_id")], limit, status=status)


def worklist(rows: DataFrame, since: str | None = None, tiers: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Drafts to look at: of some confidence tiers, staged since a time; the highest tier first, the newest first within one."""
    rows = rows.where(F.col("created_at") >= F.lit(since).cast("timestamp")) if since else rows
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("confidence"))
    return listed(rows, [rank, F.desc("created_at"), F.col("hypothesis_id")], limit, status="DRAFT", confidence=tiers)


def find_entities(entities: DataFrame, part: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Entities whose key holds part, in any case, last seen first."""
    return listed(entities.where(F.contains(F.lower("entity_key"), F.lit(part.lower()))), [F.desc("last_seen"), F.col("entity_id")], limit, entity_type=kind)


def entity_detail(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id, entity_type, entity_key, neighbour_id, edge_type, direction) of the entities in ids (entity_id); without a neighbour, one row."""
    own = entities.join(ids.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "entity_type", "entity_key")
    return own.join(neighbours(edges, own.select("entity_id")), "entity_id", "left")


def journal(entries: DataFrame, since: str | None = None, until: str | None = None, kinds: list[str] | None = None, newest_first: bool = True, limit: int | None = 50) -> DataFrame:
    """Journal entries (entry_id, kind, at) within a span of time, both ends included."""
    rows = entries.where(F.col("at") >= F.lit(since).cast("timestamp")) if since else entries
    rows = rows.where(F.col("at") <= F.lit(until).cast("timestamp")) if until else rows
    return listed(rows, [F.desc("at") if newest_first else F.col("at"), F.col("entry_id")], limit, kind=kinds)


def audit(entries: DataFrame, case_id: str | None = None, tool: str | None = None, examiner: str | None = None, limit: int | None = 50) -> DataFrame:
    """Audit entries (audit_id, case_id, tool, examiner, at), the newest first."""
    return listed(entries, [F.desc("at"), F.col("audit_id")], limit, case_id=case_id, tool=tool, examiner=examiner)


def is_audit_id(c: Column) -> Column:
    """<tool>-<examiner>-<date>-<number>; tool and examiner may hold digits and hyphens."""
    return c.rlike(r"^[a-z][a-z0-9-]*-[a-z0-9][a-z0-9-]*-[0-9]{8}-[0-9]{3,}$")


def edge_timeline(edges: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = 1000) -> DataFrame:
    rows = edges.where(F.col("timestamp") >= F.lit(start).cast("timestamp")) if start else edges
    rows = rows.where(F.col("timestamp") <= F.lit(end).cast("timestamp")) if end else rows
    return listed(rows, [F.col("timestamp"), F.col("edge_id")], limit)


def cluster_detail(clusters: DataFrame) -> DataFrame:
    """(cluster_id, time_start, time_end, score, tier, signal, weight, applies): a row for each counter that was checked."""
    return clusters.select("cluster_id", "time_start", "time_end", "score", "tier", F.explode_outer("counter_evidence").alias("c")).select("cluster_id", "time_start", "time_end", "score", "tier", "c.*")


def challenge_drafts(drafts: DataFrame, evidence: DataFrame, case_id: str) -> tuple[DataFrame, DataFrame]:
    """(verdicts, journal rows) of all drafts that have no verdict yet: (hypothesis_id, status) and what challenge() wants."""
    rows = drafts.where("status = 'DRAFT'")
    rows = rows.where("verdict IS NULL").drop("verdict") if "verdict" in drafts.columns else rows
    verdicts = challenge(rows, evidence)
    notes = verdicts.select(short_hash(F.lit("challenge"), F.col("hypothesis_id")).alias("entry_id"), F.lit(case_id).alias("case_id"), F.lit("challenge").alias("kind"), "hypothesis_id", F.concat(F.lit("verdict: "), "verdict").alias("note"))
    return verdicts, notes


def digest(hypotheses_: DataFrame, clusters: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, name, n): hypotheses by status, clusters by tier, journal entries by kind; what a resumed session starts from."""
    part = lambda df, kind, name: df.groupBy(F.lit(kind).alias("kind"), F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return part(hypotheses_, "hypothesis", "status").unionByName(part(clusters, "cluster", "tier")).unionByName(part(entries, "journal", "kind"))


def path_hashes(first: DataFrame, second: DataFrame) -> DataFrame:
    """(path, md5) of two tables (path, md5): lower-cased, with '/' between parts; the first table goes before the second."""
    rows = first.select("path", "md5", F.lit(0).alias("rank")).unionByName(second.select("path", "md5", F.lit(1).alias("rank")))
    rows = rows.select(F.translate(F.lower(F.trim("path")), "\\", "/").alias("path"), F.lower(F.trim("md5")).alias("md5"), "rank").where("path <> '' AND length(md5) = 32")
    return rows.groupBy("path").agg(F.min_by("md5", F.struct("rank", "md5")).alias("md5"))


def report(hypotheses_: DataFrame, clusters: DataFrame, gaps: DataFrame, disturbances: DataFrame, entities: DataFrame, edges: DataFrame, profile: DataFrame) -> dict[str, DataFrame]:
    """The tables of a case report, by name. header has a row for each case: profile (case_id, hosts, events, first, last), and how many findings are approved and how many gaps are open."""
    approved = hypotheses_.groupBy("case_id").agg(F.count_if(F.col("status") == "APPROVED").alias("approved"))
    header = profile.join(approved, "case_id", "left").join(gaps.groupBy("case_id").agg(F.count(F.lit(1)).alias("gaps")), "case_id", "left").na.fill(0, ["approved", "gaps"])
    return {
        "header": header,
        "hypotheses": hypotheses_.where(F.col("status").isin("APPROVED", "REJECTED")).orderBy("hypothesis_id"), "clusters": clusters.orderBy(F.desc("score"), "cluster_id"), "gaps": gaps, "disturbances": disturbances,
        "edges": edge_timeline(edges, limit=1000), "entity_counts": entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")),
    }
