"""What a case has come to: its gravest findings and what they add up to, and where a resumed session stands.

Lists of a few rows a case are cut by rank, which Spark does in each task before rows are sent, so a case with most of the rows
sends a few of them from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The assessment by what is among the findings, the first that holds: fixed values.
ASSESSMENTS = [
    (("Impact",), "RANSOMWARE/IMPACT activity detected — critical"),
    (("Lateral", "Beaconing"), "Active APT-style intrusion with C2 and lateral movement"),
    (("Lateral",), "Lateral movement detected — active intrusion"),
    (("Beaconing",), "Command and control beaconing detected"),
    (("Persistence",), "Persistence mechanisms detected — possible foothold"),
]
NOTHING = "No significant threats detected"
STATUSES = ["DRAFT", "INSUFFICIENT", "APPROVED", "REJECTED", "CONTRADICTED", "DOWNGRADED"]
#: Journal entries that end a session: fixed values.
ENDS = ["SESSION_END", "CHECKPOINT_SUMMARY"]


def first_of(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key, with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def findings(clusters: DataFrame, least: int = 40, most: int = 10) -> DataFrame:
    """(case_id, rank, cluster_id, constructor, host_name, score): the clusters of a case with the highest scores, ties by id."""
    top = first_of(clusters.where(F.col("score") >= least), ["case_id"], [F.desc("score"), F.col("cluster_id")], most)
    return top.select("case_id", "rank", "cluster_id", "constructor", "host_name", "score")


def assessment(clusters: DataFrame, least: int = 40, most: int = 10) -> DataFrame:
    """(case_id, assessment, listed): one row for each case, by the families among its findings() alone."""
    top = first_of(clusters, ["case_id"], [F.desc("score"), F.col("cluster_id")], most)
    counts = F.col("score") >= least
    seen = {x: F.coalesce(F.bool_or(F.contains("constructor", F.lit(x)) & counts), F.lit(False)) for parts, _ in ASSESSMENTS for x in parts}
    out = F.lit(NOTHING)
    for parts, text in reversed(ASSESSMENTS):
        met = seen[parts[0]]
        for x in parts[1:]:
            met = met & seen[x]
        out = F.when(met, text).otherwise(out)
    return top.groupBy("case_id").agg(out.alias("assessment"), F.count_if(counts).alias("listed"))


def conclusions(hypotheses: DataFrame) -> DataFrame:
    """Approved hypotheses (case_id, hypothesis_id, title, interpretation, techniques, score), the surest first."""
    rows = hypotheses.where("status = 'APPROVED'").select("case_id", "hypothesis_id", "title", "interpretation", "techniques", "score")
    return rows.orderBy("case_id", F.desc_nulls_last("score"), "hypothesis_id")


def gap_rows(hypotheses: DataFrame, floor: int = 31) -> DataFrame:
    """(gap_id, case_id, question, blocks_hypothesis, registered_at, resolved_at): a gap for each hypothesis that gate() found INSUFFICIENT.

    hypotheses: what gate() returns, with case_id and staged_at. A score that is missing counts as 0.
    """
    score = F.coalesce("score", F.lit(0))
    why = F.when(F.col("provenance") == "NONE", F.lit("no audit id tells where the evidence comes from")).otherwise(F.format_string("confidence %d is below %d", score.cast("int"), F.lit(floor)))
    rows = hypotheses.where("status = 'INSUFFICIENT'")
    return rows.select(F.concat(F.lit("GAP-"), F.col("hypothesis_id").cast("string")).alias("gap_id"), "case_id", why.alias("question"), F.col("hypothesis_id").alias("blocks_hypothesis"), F.col("staged_at").alias("registered_at"), F.lit(None).cast("timestamp").alias("resolved_at"))


def resume_state(journal: DataFrame, hypotheses: DataFrame, gaps: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row for each case that any of the tables names: where a session that resumes it starts from.

    journal: (entry_id, case_id, entry_type, at, summary, details), details being JSON whose next_steps is a list; what isn't
    gives none. hypotheses: (case_id, status); gaps: (case_id, resolved_at); clusters: (case_id, tier). Rows without a case are
    left out.
    """
    end = F.max_by(F.struct("at", "summary", "details"), F.when(F.col("entry_type").isin(*ENDS), F.struct("at", "entry_id")))
    j = journal.groupBy("case_id").agg(F.count_if(F.col("entry_type") == "SESSION_START").alias("sessions"), end.alias("end"))
    h = hypotheses.groupBy("case_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
    g = gaps.groupBy("case_id").agg(F.count_if(F.col("resolved_at").isNull()).alias("gaps_open"))
    c = clusters.groupBy("case_id").agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("tier") == "STRONG").alias("strong"), F.count_if(F.col("tier") == "MODERATE").alias("moderate"))
    out = j
    for other in (h, g, c):
        out = out.join(other, "case_id", "full")
    counts = ["sessions", *[s.lower() for s in STATUSES], "gaps_open", "clusters", "strong", "moderate"]
    steps = F.coalesce(F.from_json("end.details", "next_steps array<string>")["next_steps"], F.array().cast("array<string>"))
    return out.where("case_id IS NOT NULL").na.fill(0, counts).select("case_id", F.col("end.at").alias("last_end"), F.col("end.summary").alias("last_summary"), steps.alias("next_steps"), *counts)


def resume_lists(journal: DataFrame, hypotheses: DataFrame, gaps: DataFrame, entries: int = 10, approvals: int = 5, open_gaps: int = 10) -> DataFrame:
    """(case_id, list, rank, id, at): the newest journal entries, approvals and open gaps of each case; ties by id.

    hypotheses: (hypothesis_id, case_id, status, approved_at); gaps: (gap_id, case_id, registered_at, resolved_at).
    """
    def part(rows: DataFrame, name: str, ident: str, at: str, most: int) -> DataFrame:
        rows = rows.where("case_id IS NOT NULL").select("case_id", F.lit(name).alias("list"), F.col(ident).cast("string").alias("id"), F.col(at).alias("at"))
        return first_of(rows, ["case_id"], [F.desc_nulls_last("at"), F.col("id")], most)

    out = part(journal, "entry", "entry_id", "at", entries).unionByName(part(hypotheses.where("status = 'APPROVED'"), "approval", "hypothesis_id", "approved_at", approvals))
    return out.unionByName(part(gaps.where("resolved_at IS NULL"), "gap", "gap_id", "registered_at", open_gaps)).select("case_id", "list", "rank", "id", "at")
