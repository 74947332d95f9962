"""Registered queries over what a case has come to. Orders stand for the journal, hypotheses and gaps of five cases, their priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cluster as C, judge as J, summary as S
from ..sources import driver as D
from .oracle import over_clusters

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


_TOP = "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, cluster_id) AS rank FROM cl WHERE score >= 40"


@query(over_clusters(f"""SELECT cs.case_id, CASE WHEN bool_or(contains(constructor, 'Impact')) THEN 'RANSOMWARE/IMPACT activity detected — critical' WHEN bool_or(contains(constructor, 'Lateral')) AND bool_or(contains(constructor, 'Beaconing')) THEN 'Active APT-style intrusion with C2 and lateral movement'
  WHEN bool_or(contains(constructor, 'Lateral')) THEN 'Lateral movement detected — active intrusion' WHEN bool_or(contains(constructor, 'Beaconing')) THEN 'Command and control beaconing detected' WHEN bool_or(contains(constructor, 'Persistence')) THEN 'Persistence mechanisms detected — possible foothold'
  ELSE 'No significant threats detected' END AS assessment, count(rank) AS listed FROM (SELECT DISTINCT case_id FROM cl) cs LEFT JOIN (SELECT * FROM ({_TOP}) WHERE rank <= 10) tp ON tp.case_id = cs.case_id GROUP BY cs.case_id"""))
def case_summary(spark, d):
    return S.assessment(C.build_clusters(D.events(spark, d)))


@query(over_clusters(f"SELECT host_name AS case_id, rank::INT AS rank, cluster_id, constructor, score FROM ({_TOP.replace('PARTITION BY case_id', 'PARTITION BY host_name')}) WHERE rank <= 10"))
def case_findings(spark, d):
    """The gravest clusters, with each host taken for a case."""
    cl = C.build_clusters(D.events(spark, d)).withColumn("case_id", F.col("host_name"))
    return S.findings(cl).select("case_id", "rank", "cluster_id", "constructor", "score")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return D.read(spark, d, "orders").withColumns({"case_id": F.col("o_orderpriority"), "at": F.col("o_orderdate").cast("timestamp")})


def journal(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("SESSION_START", "SESSION_END", "CHECKPOINT_SUMMARY", "NOTE")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    details = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"next_steps": ["ask '), "o_custkey", F.lit('", "close"]}'))).otherwise("no list")
    return orders(spark, d).select(F.col("o_orderkey").alias("entry_id"), "case_id", kind.alias("entry_type"), "at", F.concat(F.lit("of "), "o_custkey").alias("summary"), details.alias("details"))


def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "DRAFT").when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("DOWNGRADED")
    return orders(spark, d).select(F.col("o_orderkey").alias("hypothesis_id"), "case_id", status.alias("status"), F.col("at").alias("approved_at"))


def gated(spark: SparkSession, d: str) -> DataFrame:
    """Hypotheses after their gates: every fourth has no provenance, the scores are the customers' keys."""
    o = orders(spark, d)
    ids = F.array(F.when(F.col("o_orderkey") % 4 == 3, "note").otherwise("tool-a-1"))
    return J.gate(o.select(F.col("o_orderkey").alias("hypothesis_id"), "case_id", F.col("at").alias("staged_at"), ids.alias("audit_ids"), (F.col("o_custkey") % 100).alias("score"), F.lit("seen").alias("interpretation"), F.array(F.lit("WRITE")).alias("levels"), F.lit(False).alias("near_disturbance")))


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """The gaps of these, of which urgent ones are closed on the day."""
    found = S.gap_rows(gated(spark, d))
    return found.withColumn("resolved_at", F.when(F.col("case_id") == "1-URGENT", F.col("registered_at")))


_GAPS = "gp AS (SELECT 'GAP-' || o_orderkey AS gap_id, o_orderpriority AS case_id, CASE WHEN o_orderkey % 4 = 3 THEN 'no audit id tells where the evidence comes from' ELSE 'confidence ' || (o_custkey % 100) || ' is below 31' END AS question, o_orderkey AS blocks_hypothesis, o_orderdate AS moment, o_orderpriority = '1-URGENT' AS closed FROM orders WHERE o_orderkey % 4 = 3 OR o_custkey % 100 < 31)"


@query(f"WITH {_GAPS} SELECT gap_id, case_id, question, blocks_hypothesis, epoch(moment)::BIGINT AS registered FROM gp")
def gate_gaps(spark, d):
    """What each hypothesis that fell short of the gates would need."""
    return S.gap_rows(gated(spark, d)).select("gap_id", "case_id", "question", "blocks_hypothesis", F.unix_timestamp("registered_at").alias("registered"))


@query(f"""WITH {_GAPS}, j AS (SELECT o_orderpriority AS case_id, count_if(o_custkey % 4 = 0) AS sessions, arg_max(row(o_orderkey, o_custkey, o_orderdate), row(o_orderdate, o_orderkey)) FILTER (o_custkey % 4 IN (1, 2)) AS e,
  count_if(o_orderstatus = 'O') AS draft, count_if(o_orderstatus = 'F') AS approved, count_if(o_orderstatus NOT IN ('O', 'F')) AS downgraded FROM orders GROUP BY ALL)
SELECT j.case_id, epoch(e[3])::BIGINT AS last_end, 'of ' || e[2] AS last_summary, CASE WHEN e[1] % 2 = 0 THEN 'ask ' || e[2] || ',close' ELSE '' END AS next_steps, sessions, draft, approved, downgraded, (SELECT count(*) FROM gp WHERE gp.case_id = j.case_id AND NOT closed) AS gaps_open FROM j""")
def resume_state(spark, d):
    """Where a session that resumes a case starts from."""
    none = spark.createDataFrame([], "case_id string, tier string")
    out = S.resume_state(journal(spark, d), hypotheses(spark, d), gaps(spark, d), none)
    return out.select("case_id", F.unix_timestamp("last_end").alias("last_end"), "last_summary", F.array_join("next_steps", ",").alias("next_steps"), "sessions", "draft", "approved", "downgraded", "gaps_open")


@query(f"""WITH {_GAPS}, x AS (SELECT o_orderpriority AS case_id, 'entry' AS list, o_orderkey::VARCHAR AS id, o_orderdate AS moment, 10 AS most FROM orders UNION ALL SELECT o_orderpriority, 'approval', o_orderkey::VARCHAR, o_orderdate, 5 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT case_id, 'gap', gap_id, moment, 10 FROM gp WHERE NOT closed)
SELECT case_id, list, rank::INT AS rank, id, epoch(moment)::BIGINT AS at FROM (SELECT *, row_number() OVER (PARTITION BY case_id, list ORDER BY moment DESC, id) AS rank FROM x) WHERE rank <= most""")
def resume_lists(spark, d):
    """The newest entries, approvals and open gaps of each case."""
    return S.resume_lists(journal(spark, d), hypotheses(spark, d), gaps(spark, d)).withColumn("at", F.unix_timestamp("at"))
