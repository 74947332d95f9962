"""Judging hypotheses: profile, confidence, gates, challenge, decisions, root cause, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import claims_cause, confidence_tier, content_hash, is_technique, weakest
from ..functions.lookups import CAUSAL_RANK, CAUSAL_WEIGHTS, GATE_PHRASES, PROVENANCE_WEIGHTS, STRENGTH_WEIGHTS, STRONG_CAUSES
from ..functions.tables import look_up
from .chains import chains, walks
from .graph import saved
from .intervals import overlapping


def case_profile(events: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """(case_id, hosts, events, artifacts, first, last): what a case has."""
    out = events.groupBy("case_id").agg(F.count_distinct("host_name").alias("hosts"), F.count(F.lit(1)).alias("events"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.array_sort(F.collect_set("source_index")).alias("artifacts"))
    if artifacts is not None:
        out = out.drop("artifacts").join(artifacts.groupBy("case_id").agg(F.array_sort(F.collect_set("artifact")).alias("artifacts")), "case_id", "left")
    return out


#: factor: (most points, what a case must have for it to apply, the points that a hypothesis gets); fixed values.
FACTORS = {
    "provenance_tier": (20, "TRUE", lambda: look_up(PROVENANCE_WEIGHTS, F.col("provenance"))),
    "causal_lineage": (15, "TRUE", lambda: look_up(CAUSAL_WEIGHTS, F.col("causal_level"))),
    "cluster_strength": (15, "cluster_strength IS NOT NULL", lambda: look_up(STRENGTH_WEIGHTS, F.col("cluster_strength"))),
    "domain_breadth": (20, "TRUE", "CASE WHEN domain_count >= 3 THEN 20 WHEN domain_count = 2 THEN 12 WHEN domain_count = 1 THEN 5 END"),
    "cross_host_corroboration": (10, "host_count > 1", "least(5 * corroborating_hosts, 10)"),
    "sigma_co_occurrence": (10, "array_contains(artifacts, 'sigma')", "if(sigma_critical, 10, 0)"),
    "threat_intel_match": (5, "size(intel_sources) > 0", "if(intel_match, 5, 0)"),
    "anti_forensic_clear": (5, "anti_forensic_observed", "if(anti_forensic_clear, 5, 0)"),
    "memory_corroboration": (5, "memory_available", "if(memory_corroboration, 5, 0)"),
    "network_corroboration": (5, "network_available", "if(network_corroboration, 5, 0)"),
}
#: What nearness to tampering and a contradicting cluster cost; fixed values.
NEAR_TAMPERING, CONTRADICTED = 15, 20
#: What confidence() takes a missing column for.
ABSENT = {
    "provenance": "'NONE'", "causal_level": "'UNSUPPORTED'", "cluster_strength": "CAST(NULL AS string)", "artifacts": "CAST(array() AS array<string>)", "intel_sources": "CAST(array() AS array<string>)", "host_count": "1", "domain_count": "0", "corroborating_hosts": "0",
} | {c: "false" for c in ("sigma_critical", "intel_match", "anti_forensic_observed", "anti_forensic_clear", "memory_available", "memory_corroboration", "network_available", "network_corroboration", "near_disturbance", "contradicted")}


def confidence(hypotheses: DataFrame) -> DataFrame:
    """Adds score, confidence and applicable: points got of the points that apply, in percent, less penalties, rounded half to even.

    hypotheses has the columns that FACTORS names, of the hypothesis and of its case, and near_disturbance and contradicted for the
    penalties; one that is missing counts as in ABSENT.
    """
    rows = hypotheses.withColumns({c: F.expr(v) for c, v in ABSENT.items() if c not in hypotheses.columns})
    applies = {k: F.coalesce(F.expr(c), F.lit(False)) for k, (_, c, _) in FACTORS.items()}
    total = lambda of: sum((F.when(applies[k], F.coalesce(of(k), F.lit(0))).otherwise(0) for k in FACTORS), F.lit(0))
    points = lambda p: F.expr(p) if isinstance(p, str) else p()
    raw = F.try_divide(total(lambda k: points(FACTORS[k][2])).cast("double"), total(lambda k: F.lit(FACTORS[k][0])).cast("double")) * 100
    less = F.when(F.col("near_disturbance"), NEAR_TAMPERING).otherwise(0) + F.when(F.col("contradicted"), CONTRADICTED).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.rint(raw - less).cast("int")))
    out = rows.withColumns({"score": score, "applicable": F.array_compact(F.array(*[F.when(a, F.lit(k)) for k, a in applies.items()]))})
    return out.withColumn("confidence", confidence_tier(F.col("score")))


def near_disturbance(refs: DataFrame, disturbed: DataFrame) -> DataFrame:
    """refs (id, case_id, host_name, timestamp) that fall into a disturbance (start, end) of their host, to the microsecond, each once."""
    second = lambda c: F.unix_seconds(c)
    points = refs.withColumns({"row_": F.monotonically_increasing_id(), "s_": second("timestamp"), "e_": second("timestamp")})
    points = saved(points)  # the numbers have to stay what they are
    spans = disturbed.select("case_id", "host_name", F.col("start").alias("span_start"), F.col("end").alias("span_end"), second("start").alias("from_s"), second("end").alias("to_s"))
    met = overlapping(points.select("case_id", "host_name", "row_", "timestamp", "s_", "e_"), spans, ["case_id", "host_name"], ("s_", "e_"), ("from_s", "to_s"))
    hit = met.where(F.col("timestamp").between(F.col("span_start"), F.col("span_end"))).select("row_").distinct()
    return points.join(hit, "row_", "left_semi").drop("row_", "s_", "e_")


def gate(hypotheses: DataFrame, tool_prefix: str = "tool-") -> DataFrame:
    """Adds the gate flags and the first status. Wants audit_ids, score, interpretation, levels, near_disturbance."""
    cause_ok = ~claims_cause(F.col("interpretation"), GATE_PHRASES) | F.arrays_overlap("levels", F.array(*[F.lit(x) for x in STRONG_CAUSES]))
    rows = hypotheses.withColumn("provenance", weakest(F.col("audit_ids"), tool_prefix)).withColumn("cause_ok", F.coalesce(cause_ok, F.lit(False)))
    status = F.when((F.col("provenance") == "NONE") | (F.col("score") < 31), "INSUFFICIENT").when((F.col("score") >= 76) & (F.col("provenance") == "MCP") & ~F.col("near_disturbance") & F.col("cause_ok"), "APPROVED").otherwise("DRAFT")
    return rows.withColumn("status", status)


def evidence_domains(*refs: str) -> Column:
    return sum(((F.coalesce(F.size(r), F.lit(0)) > 0).cast("int") for r in refs), F.lit(0))


def challenge(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds a verdict. evidence: (hypothesis_id, cluster_id, counter_evidence); hypotheses: (causal_break, contradictions, near_disturbance, n_sources)."""
    weight = F.aggregate(F.filter("counter_evidence", lambda c: c["applies"]), F.lit(0), lambda s, c: s + F.coalesce(c["weight"], F.lit(10)))
    sums = evidence.groupBy("hypothesis_id").agg(F.sum(weight).alias("counter"), F.count(F.lit(1)).alias("refs"))
    rows = hypotheses.join(sums, "hypothesis_id", "left").na.fill({"counter": 0, "refs": 0})
    verdict = (
        F.when(F.col("causal_break"), "REFUTED").when(F.col("contradictions") > 0, "REFUTED").when(F.col("near_disturbance") & (F.col("n_sources") < 2), "DOWNGRADED")
        .when(5 * F.col("counter") > 60 * F.col("refs"), "REFUTED").when(F.col("counter") > 0, "CAVEATS").otherwise("SUPPORTED")
    )
    return rows.withColumn("verdict", verdict)


def fold(decisions: DataFrame) -> DataFrame:
    """(hypothesis_id, status, decided_at, links): the last valid decision of each hypothesis, and all its causal links.

    decisions: an append-only (hypothesis_id, action, link, decided_at, seq). Approval counts only from DRAFT or INSUFFICIENT, so
    after a rejection or contradiction it is void: the last of those wins, else the last approval, else the last other decision.
    """
    to = F.when(F.col("action") == "approve", "APPROVED").when(F.col("action") == "reject", "REJECTED").when(F.col("action") == "contradict", "CONTRADICTED").when(F.col("action") == "insufficient", "INSUFFICIENT").when(F.col("action") == "draft", "DRAFT")
    rows = decisions.withColumn("to", to).withColumn("final", F.coalesce(F.col("to").isin("REJECTED", "CONTRADICTED"), F.lit(False)))
    last = F.max_by("to", F.when(F.col("to").isNotNull(), F.struct("final", "decided_at", "seq")))
    return rows.groupBy("hypothesis_id").agg(last.alias("status"), F.max("decided_at").alias("decided_at"), F.array_compact(F.array_sort(F.collect_set("link"))).alias("links"))


def strongest_incoming(links: DataFrame, unsupported: bool = False) -> DataFrame:
    """(node, came_from, level): the strongest supported link into each node (source, target, level, at); ties go to the earliest.

    unsupported keeps nodes that no supported link leads into, with nulls.
    """
    rank = look_up(CAUSAL_RANK, F.col("level"))
    order = Window.partitionBy("target").orderBy(F.desc("rank"), "at", "source")
    last = links.withColumn("rank", rank).withColumn("rn", F.row_number().over(order)).where("rn = 1")
    if not unsupported:
        return last.where("rank > 0").select(F.col("target").alias("node"), F.col("source").alias("came_from"), "level")
    is_ = lambda c: F.when(F.col("rank") > 0, F.col(c))
    return last.select(F.col("target").alias("node"), is_("source").alias("came_from"), is_("level").alias("level"))


def _back(links: DataFrame, every: bool) -> DataFrame:
    return strongest_incoming(links, every).select("node", F.col("came_from").alias("parent"))


def root_chains(links: DataFrame, starts: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(node, position, member): from each start (node) back along strongest links, a row a step, until none is left or a node repeats, or depth links where that is given.

    Without starts, from each node that a link leads into.
    """
    return walks(_back(links, starts is None), starts, depth)


def root_causes(links: DataFrame, starts: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(node, chain): the chain of each start as an array, for chains short enough to read; root_chains() has them as rows."""
    short, long = chains(_back(links, starts is None), starts, depth)
    if long is None:
        return short
    steps = F.array_sort(F.collect_list(F.struct("position", "member")))
    return short.unionByName(long.groupBy("node").agg(steps.alias("steps")).select("node", F.transform("steps", lambda s: s["member"]).alias("chain")))


def mutual_links(links: DataFrame) -> DataFrame:
    """(a, b): pairs that each claim to cause the other."""
    x = links.select("source", "target").distinct()
    return x.alias("p").join(x.alias("q"), (F.col("p.source") == F.col("q.target")) & (F.col("p.target") == F.col("q.source")) & (F.col("p.source") < F.col("p.target"))).select(F.col("p.source").alias("a"), F.col("p.target").alias("b"))


def orphans(hypotheses: DataFrame, links: DataFrame) -> DataFrame:
    """Hypotheses without a link in or out."""
    ends = links.select(F.col("source").alias("hypothesis_id")).unionByName(links.select(F.col("target").alias("hypothesis_id"))).distinct()
    return hypotheses.join(ends, "hypothesis_id", "left_anti")


def changed(hypotheses: DataFrame) -> DataFrame:
    """Hypotheses (title, observation, interpretation, techniques, content_hash) whose hash is not that of their content; one without a hash was never staged and is none."""
    now = content_hash(F.col("title"), F.col("observation"), F.col("interpretation"), F.col("techniques"))
    return hypotheses.where(F.col("content_hash") != now)


def readiness(hypotheses: DataFrame) -> DataFrame:
    """(case_id, drafts, approved, without_technique, bad_technique, unsigned): what stands against closing a case."""
    approved = F.col("status") == "APPROVED"
    return hypotheses.groupBy("case_id").agg(
        F.count_if(F.col("status") == "DRAFT").alias("drafts"), F.count_if(approved).alias("approved"), F.count_if(approved & (F.size("techniques") == 0)).alias("without_technique"),
        F.count_if(F.exists("techniques", lambda t: ~is_technique(t))).alias("bad_technique"), F.count_if(approved & ~F.col("signed")).alias("unsigned"),
    )
