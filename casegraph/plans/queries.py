"""The registered queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import exprs as X
from ..functions.lookups import CAUSAL_RANK, KEEP, NOISE
from ..operators import chains as H, cluster as C, coverage as K, detect as T, graph as G, judge as J, quantiles as Q, reduce as R, views as V
from ..operators.intervals import as_of, overlapping_pairs
from ..operators.graph import folder
from ..operators.pages import Pages
from ..operators.path_dag import ShortestPaths
from ..operators.rules import FAMILIES, prepared
from ..sources import driver as D
from . import ingest, lists, rare, summary
from .oracle import GROUPS, HITS, hits_by_trigger, over_clusters, over_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def ev(spark: SparkSession, d: str) -> DataFrame:
    return D.events(spark, d).withColumn("epoch", F.unix_timestamp("timestamp"))


def text(c: str):
    return F.array_join(F.array_sort(c), ",")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """The scored clusters of a case, built anew for each query."""
    return C.build_clusters(D.events(spark, d))


for _f in FAMILIES:
    def _by_trigger(spark, d, f=_f):
        return C.trigger_hits(D.events(spark, d), (f,)).groupBy("host_name", "trigger").agg(F.count(F.lit(1)).alias("n"))

    QUERIES[f"hits_by_trigger_{_f.name.lower()}"] = _by_trigger
    ORACLE_SQL[f"hits_by_trigger_{_f.name.lower()}"] = hits_by_trigger(_f)


@query(over_events("SELECT canonical_type, host_name, count(*) AS n FROM ev GROUP BY ALL"))
def norm_type_counts(spark, d):
    return V.counts(ev(spark, d), "canonical_type", "host_name")


@query("SELECT doc_id, sha256('CASE-1:' || coalesce(source, '') || ':' || coalesce(lang, '') || ':' || doc_id) AS document_id FROM documents")
def doc_ids(spark, d):
    return D.read(spark, d, "documents").select("doc_id", X.doc_id(F.lit("CASE-1"), F.col("source"), F.col("lang"), F.col("doc_id")).alias("document_id"))


@query(over_events("SELECT remote_ip, regexp_matches(remote_ip, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') AS internal, count(*) AS n FROM ev WHERE remote_ip IS NOT NULL GROUP BY ALL"))
def internal_ip_split(spark, d):
    return ev(spark, d).where("remote_ip IS NOT NULL").groupBy("remote_ip", X.is_internal(F.col("remote_ip")).alias("internal")).agg(F.count(F.lit(1)).alias("n"))


@query(over_events("SELECT regexp_extract(target_file, '([^\\\\/]+)$', 1) AS name, count(*) AS n FROM ev WHERE target_file IS NOT NULL GROUP BY ALL"))
def basename(spark, d):
    return ev(spark, d).where("target_file IS NOT NULL").groupBy(X.basename(F.col("target_file")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GROUPS} SELECT cluster_id, constructor, host_name, bucket, array_to_string(triggers, ',') AS triggers, base AS base_score, n_members, start_epoch, end_epoch FROM g")
def cluster_groups(spark, d):
    g = C.group_hits(C.trigger_hits(D.events(spark, d)))
    return g.select("cluster_id", "constructor", "host_name", "bucket", text("triggers_fired").alias("triggers"), "base_score", "n_members", "start_epoch", "end_epoch")


@query(over_clusters("SELECT cluster_id, base AS base_score, support, counter, score FROM cl"))
def cluster_scores(spark, d):
    return clusters(spark, d).select("cluster_id", "base_score", "support", "counter", "score")


@query(over_clusters("SELECT host_name, tier, count(*) AS n FROM cl GROUP BY ALL"))
def cluster_tiers(spark, d):
    """The flagship: canonical events to hits, clusters, signals, scores and tiers."""
    return clusters(spark, d).groupBy("host_name", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(over_clusters("SELECT constructor, sum(counter)::BIGINT AS counter, sum(support)::BIGINT AS support FROM cl GROUP BY ALL"))
def cluster_counters(spark, d):
    return clusters(spark, d).groupBy("constructor").agg(F.sum("counter").alias("counter"), F.sum("support").alias("support"))


@query(f"WITH {GROUPS} SELECT cluster_id, count(*) AS n FROM g JOIN ru ON ru.host_name = g.host_name AND ru.epoch BETWEEN g.start_epoch - 1800 AND g.end_epoch + 1800 WHERE constructor = 'LateralMovement' GROUP BY ALL")
def context_counts(spark, d):
    g = C.group_hits(C.trigger_hits(D.events(spark, d), (C.BY_NAME["LateralMovement"],)))
    return C.over_context(g, ev(spark, d).select("host_name", "epoch", F.lit(1).alias("n")), 1800, {"n": (F.count, F.sum)})


@query(over_events("""SELECT event_id FROM (SELECT event_id, epoch, lag(epoch) OVER (PARTITION BY host_name, "user" ORDER BY epoch, event_id) AS b FROM ev WHERE canonical_type = 'AUTHENTICATION') WHERE b IS NULL OR epoch - b > 86400"""))
def new_access_anti(spark, d):
    return C.first_accesses(prepared(D.events(spark, d))).select("event_id")


@query(over_events("SELECT host_name, hour(timestamp)::INT AS hour, count(*) AS n FROM ev WHERE hour(timestamp) < 9 OR hour(timestamp) >= 17 GROUP BY ALL"))
def outside_hours(spark, d):
    return ev(spark, d).where("hour(timestamp) < 9 OR hour(timestamp) >= 17").groupBy("host_name", F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query(over_events("SELECT host_name, lower(process_name) AS proc FROM ev WHERE process_name IS NOT NULL GROUP BY ALL HAVING count(*) > 20"))
def freq_baseline(spark, d):
    return C.common_processes(prepared(D.events(spark, d)), 20).select("host_name", "proc")


_NOISE = "tier NOT IN ('STRONG', 'MODERATE') AND NOT len(list_filter(triggers, lambda t: regexp_matches(t, '" + "|".join(KEEP) + "'))) > 0 AND len(list_filter(triggers, lambda t: t NOT IN (" + ", ".join(f"'{x}'" for x in NOISE) + "))) = 0"


@query(over_clusters(f"SELECT host_name, constructor, count(*) AS collapsed, min(score) AS score, max(score) AS max_score FROM cl WHERE {_NOISE} GROUP BY ALL"))
def noise_collapse(spark, d):
    return R.collapse_noise(clusters(spark, d)).where("cluster_id LIKE 'aggregate-%'").select("host_name", "constructor", "collapsed", "score", "max_score")


_SEED = "tier <> 'NOISE' AND len(list_filter(triggers, lambda t: t NOT IN (" + ", ".join(f"'{x}'" for x in NOISE) + "))) > 0 AND (tier IN ('STRONG', 'MODERATE') OR len(list_filter(triggers, lambda t: regexp_matches(t, '" + "|".join(KEEP) + "'))) > 0 OR len(triggers) >= 2)"


@query(over_clusters(f"SELECT cluster_id, constructor AS cluster_type, score FROM cl WHERE {_SEED}"))
def seed_gate(spark, d):
    return R.seed(clusters(spark, d)).select("cluster_id", "cluster_type", "score")


@query(over_clusters(f"SELECT constructor AS cluster_type, host_name, array_to_string(triggers, ',') AS triggers, count(*) AS merged, floor(avg(score))::BIGINT AS score FROM cl WHERE {_SEED} GROUP BY ALL"))
def draft_rollup(spark, d):
    return R.rollup(R.seed(clusters(spark, d))).select("cluster_type", "host_name", text("triggers_fired").alias("triggers"), "merged", "score")


@query(over_clusters("SELECT cluster_id, start_epoch - CASE constructor WHEN 'LogClearing' THEN 900 ELSE 1800 END AS start, end_epoch + CASE constructor WHEN 'LogClearing' THEN 900 ELSE 1800 END AS \"end\" FROM cl WHERE constructor IN ('LogClearing', 'ShadowDeletion')"))
def disturbance_windows(spark, d):
    return R.disturbances(clusters(spark, d)).select("cluster_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"))


def evidence_kind():
    return F.when(F.col("canonical_type") == "NETWORK_CONNECTION", "pcap").when(F.col("canonical_type") == "REGISTRY_MODIFICATION", "registry").otherwise("evtx")


_GAPS = """, k AS (SELECT host_name, CASE canonical_type WHEN 'NETWORK_CONNECTION' THEN 'pcap' WHEN 'REGISTRY_MODIFICATION' THEN 'registry' ELSE 'evtx' END AS kind, epoch FROM ev), hs AS (SELECT host_name, min(epoch) AS a, max(epoch) AS b FROM ev GROUP BY ALL),
pt AS (SELECT host_name, kind, epoch FROM k UNION ALL SELECT DISTINCT host_name, kind, a FROM k JOIN hs USING (host_name) UNION ALL SELECT DISTINCT host_name, kind, b FROM k JOIN hs USING (host_name)),
gp AS (SELECT host_name, kind, 'hole' AS gap, p AS start, epoch AS "end" FROM (SELECT *, lag(epoch) OVER (PARTITION BY host_name, kind ORDER BY epoch) AS p FROM pt) WHERE epoch - p > 14400 UNION ALL SELECT host_name, 'memory', 'missing', a, b FROM hs)"""


@query(over_clusters(_GAPS + " SELECT gp.*, EXISTS (SELECT 1 FROM cl WHERE cl.host_name = gp.host_name AND cl.tier = 'STRONG' AND cl.start_epoch <= gp.\"end\" AND cl.end_epoch >= gp.start) AS blocks_report FROM gp"))
def gap_detection(spark, d):
    """What evidence each host lacks, by kind and time, and whether a strong finding lies there."""
    e = ev(spark, d)
    found = K.holes(K.evidence_spans(e, evidence_kind(), 14400), K.expected_by_host(e), 14400)
    return K.blocking(found, clusters(spark, d).where("tier = 'STRONG'")).drop("case_id")


@query(over_events(_GAPS + " SELECT host_name, kind, coalesce(sum(epoch - p) FILTER (epoch - p <= 14400), 0)::BIGINT AS seconds FROM (SELECT DISTINCT host_name, kind FROM gp) LEFT JOIN (SELECT *, lag(epoch) OVER (PARTITION BY host_name, kind ORDER BY epoch) AS p FROM k) USING (host_name, kind) GROUP BY ALL"))
def evidence_coverage(spark, d):
    """Seconds of a host's time that its evidence of each kind covers, for kinds with gaps."""
    e = ev(spark, d)
    spans = K.evidence_spans(e, evidence_kind(), 14400)
    gaps = K.holes(spans, K.expected_by_host(e), 14400).select("host_name", "kind").distinct()
    return K.covered(spans, K.expected_by_host(e)).join(gaps, ["host_name", "kind"]).select("host_name", "kind", "seconds")


_CASES = "h AS (SELECT o_orderstatus AS case_id, o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' THEN 'DRAFT' WHEN o_orderpriority = '5-LOW' THEN 'REJECTED' ELSE 'APPROVED' END AS status, o_orderkey % 3 AS t, o_orderkey - 32 AS against, o_orderkey % 2 = 1 AS signed FROM orders)"


@query(f"""WITH {_CASES} SELECT h.case_id, count_if(status = 'DRAFT') AS drafts, count_if(status = 'APPROVED') AS approved, count_if(status = 'APPROVED' AND t = 0) AS without_technique, count_if(status = 'APPROVED' AND t = 1) AS bad_techniques, count_if(status = 'APPROVED' AND NOT signed) AS unsigned,
count_if(status = 'APPROVED' AND against IN (SELECT g.id FROM h g WHERE g.status = 'APPROVED' AND g.case_id = h.case_id)) AS approved_contradicted, count_if(status = 'DRAFT') = 0 AND count_if(status = 'APPROVED' AND against IN (SELECT g.id FROM h g WHERE g.status = 'APPROVED' AND g.case_id = h.case_id)) = 0 AS ready FROM h GROUP BY h.case_id""")
def case_readiness(spark, d):
    """Orders as hypotheses of three cases, each contradicted by the one 32 before it."""
    k = F.col("o_orderkey")
    tech = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("T1x"))).otherwise(F.array(F.lit("T1003.001")))
    status = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "P"), "DRAFT").when(F.col("o_orderpriority") == "5-LOW", "REJECTED").otherwise("APPROVED")
    h = D.read(spark, d, "orders").select(F.col("o_orderstatus").alias("case_id"), k.alias("hypothesis_id"), status.alias("status"), tech.alias("techniques"), (k - 32).alias("contradicted_by"), (k % 2 == 1).alias("signed"))
    none = lambda s: spark.createDataFrame([], s)
    out = K.case_readiness(h, none("case_id string, source long, target long"), none("case_id string, blocks_report boolean"), none("case_id string, tier string"))
    return out.select("case_id", "drafts", "approved", "without_technique", "bad_techniques", "unsigned", "approved_contradicted", "ready")


@query(over_events("SELECT event_id, epoch, (SELECT count(*) FROM ev) AS total FROM ev ORDER BY epoch, event_id LIMIT 300 OFFSET 2100"))
def page_8(spark, d):
    """Page 8 of all events, by an index of ranges, with the number of all."""
    p = Pages.build(ev(spark, d).select("event_id", "epoch"), ["epoch", "event_id"], f"{folder(spark)}/pages", 16)
    return p.page(300, 7).withColumn("total", F.lit(p.total).cast("long"))


_ENT = """, e AS (SELECT 'host' AS t, host_name AS k, epoch FROM ev UNION ALL SELECT 'user', "user", epoch FROM ev UNION ALL SELECT 'process', host_name || ':' || pid || ':' || epoch, epoch FROM ev WHERE process_name IS NOT NULL
UNION ALL SELECT 'file', host_name || ':' || target_file, epoch FROM ev WHERE target_file IS NOT NULL UNION ALL SELECT 'ip', remote_ip, epoch FROM ev WHERE remote_ip IS NOT NULL UNION ALL SELECT 'registry', host_name || ':' || registry_key, epoch FROM ev WHERE registry_key IS NOT NULL
UNION ALL SELECT 'service', host_name || ':service', epoch FROM ev WHERE canonical_type = 'SERVICE_INSTALLATION')"""


@query(over_events(_ENT + " SELECT sha256('CASE-1:' || t || ':' || k)[1:32] AS entity_id, t AS entity_type, k AS entity_key, min(epoch) AS first_seen, max(epoch) AS last_seen, count(*) AS seen_count FROM e GROUP BY ALL"))
def entity_upsert(spark, d):
    return G.entities(D.events(spark, d)).select("entity_id", "entity_type", "entity_key", F.unix_timestamp("first_seen").alias("first_seen"), F.unix_timestamp("last_seen").alias("last_seen"), "seen_count")


@query(over_events("""SELECT edge_type, count(*) AS n FROM (
SELECT DISTINCT 'authenticated_as' AS edge_type, "user" AS a, host_name AS b, epoch FROM ev WHERE canonical_type = 'AUTHENTICATION' UNION ALL SELECT DISTINCT 'spawned_by', host_name || pid, "user", epoch FROM ev WHERE canonical_type = 'PROCESS_EXECUTION'
UNION ALL SELECT DISTINCT 'accessed', "user", host_name || target_file, epoch FROM ev WHERE target_file IS NOT NULL UNION ALL SELECT DISTINCT 'persists_via', 's', host_name, epoch FROM ev WHERE canonical_type = 'SERVICE_INSTALLATION'
UNION ALL SELECT DISTINCT 'accessed', host_name, remote_ip, epoch FROM ev WHERE remote_ip IS NOT NULL UNION ALL SELECT DISTINCT 'accessed', host_name, target_file, epoch FROM ev WHERE target_file IS NOT NULL
UNION ALL SELECT DISTINCT 'accessed', host_name, registry_key, epoch FROM ev WHERE registry_key IS NOT NULL UNION ALL SELECT DISTINCT 'accessed', host_name, pid::VARCHAR, epoch FROM ev WHERE canonical_type = 'PROCESS_EXECUTION') GROUP BY ALL"""))
def edge_dedup(spark, d):
    # an event carries one edge of the generic kind at most, the specific kinds add theirs
    return G.edges(D.events(spark, d)).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def part_edges(spark, d):
    return D.read(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()


@query("SELECT CASE WHEN x = 0 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS entity_id, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), (SELECT unnest([0, 1]) AS x) GROUP BY ALL")
def neighbours_both(spark, d):
    e = part_edges(spark, d).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("supplied_by").alias("edge_type"))
    ids = e.select(F.col("from_id").alias("entity_id")).unionByName(e.select(F.col("to_id").alias("entity_id"))).distinct()
    return G.neighbours(e, ids).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


_SUPPLIED = "SELECT DISTINCT 'p' || l_partkey AS from_id, 's' || l_suppkey AS to_id FROM lineitem"
_OF_TYPE = "l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY') AND l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"


@query(f"{_SUPPLIED} WHERE {_OF_TYPE}")
def subgraph_by_type(spark, d):
    """The edges between parts of a type and suppliers of a region."""
    e = part_edges(spark, d).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"))
    parts = D.read(spark, d, "part").where("p_type = 'ECONOMY'").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"))
    region = D.read(spark, d, "nation").join(D.read(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = D.read(spark, d, "supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"))
    return G.subgraph(e, parts.unionByName(suppliers).distinct())


def order_events(spark, d):
    return D.read(spark, d, "orders").select(F.col("o_custkey"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("epoch"), F.col("o_orderkey").alias("event_id"))


@query("""SELECT o_custkey, n, round(sd / m, 6) AS jitter FROM (SELECT o_custkey, count(*) AS n, avg(gap) AS m, stddev_samp(gap) AS sd FROM (SELECT o_custkey, epoch - lag(epoch) OVER (PARTITION BY o_custkey ORDER BY epoch, o_orderkey) AS gap FROM (SELECT *, floor(epoch(o_orderdate))::BIGINT AS epoch FROM orders)) GROUP BY o_custkey) WHERE n > 10 AND m > 0 AND sd / m < 0.9""")
def beacon_jitter(spark, d):
    return T.beacon_jitter(order_events(spark, d), ["o_custkey"], 10, 0.9).select("o_custkey", "n", F.round("jitter", 6).alias("jitter"))


@query(over_events("SELECT event_id, n_window FROM (SELECT event_id, count(*) OVER (PARTITION BY host_name ORDER BY epoch RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW) AS n_window FROM ev WHERE canonical_type = 'ALERT') WHERE n_window > 2"))
def failure_burst(spark, d):
    return T.burst(ev(spark, d).where("canonical_type = 'ALERT'"), ["host_name"], 1800, 2).select("event_id", "n_window")


@query(over_events("SELECT host_name, epoch - epoch % 600 AS start, count(*) AS n FROM ev WHERE canonical_type = 'FILE_CREATION' GROUP BY ALL HAVING count(*) > 1"))
def mass_write_minute(spark, d):
    return T.per_window(ev(spark, d).where("canonical_type = 'FILE_CREATION'"), ["host_name"], 600, 1)


@query(over_events("SELECT host_name, s AS start, count(DISTINCT \"user\") AS n FROM (SELECT *, unnest(range(epoch - epoch % 300 - 1500, epoch - epoch % 300 + 1, 300)) AS s FROM ev WHERE canonical_type = 'AUTHENTICATION') GROUP BY ALL HAVING count(DISTINCT \"user\") > 2"))
def lockout_distinct(spark, d):
    return T.sliding(ev(spark, d).where("canonical_type = 'AUTHENTICATION'"), ["host_name"], 1800, 300, 2, "user")


@query(over_events("SELECT host_name, min(epoch) AS start, max(epoch) AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY host_name ORDER BY epoch, event_id) AS s FROM (SELECT *, coalesce((epoch - lag(epoch) OVER (PARTITION BY host_name ORDER BY epoch, event_id) > 900)::INT, 0) AS new FROM ev WHERE canonical_type = 'SERVICE_INSTALLATION')) GROUP BY host_name, s HAVING count(*) > 1"))
def session_stops(spark, d):
    return T.sessions(ev(spark, d).where("canonical_type = 'SERVICE_INSTALLATION'"), ["host_name"], 900, 1)


@query("SELECT l_suppkey, l_orderkey, gap FROM (SELECT l_suppkey, l_orderkey, l_orderkey - lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS gap FROM lineitem) WHERE gap > 50")
def record_gaps(spark, d):
    return T.id_gaps(D.read(spark, d, "lineitem").select("l_suppkey", "l_orderkey"), ["l_suppkey"], "l_orderkey", 50).select("l_suppkey", "l_orderkey", "gap")


@query(over_events("SELECT a.host_name, a.event_id AS first_id, b.event_id AS then_id, b.epoch - a.epoch AS lag FROM ev a JOIN ev b ON a.host_name = b.host_name AND b.epoch BETWEEN a.epoch AND a.epoch + 600 WHERE a.canonical_type = 'AUTHENTICATION' AND b.canonical_type = 'SERVICE_INSTALLATION'"))
def sequence_within(spark, d):
    e = ev(spark, d)
    return T.sequence(e.where("canonical_type = 'AUTHENTICATION'"), e.where("canonical_type = 'SERVICE_INSTALLATION'"), ["host_name"], 600)


@query(over_events("SELECT \"user\", command_line, count(DISTINCT host_name) AS hosts, min(epoch) AS first_seen FROM ev WHERE command_line IS NOT NULL GROUP BY ALL HAVING count(DISTINCT host_name) >= 2"))
def cross_host(spark, d):
    return T.cross_host(ev(spark, d).where("command_line IS NOT NULL"), ["user", "command_line"])


@query(f"WITH {GROUPS} SELECT a.host_name, a.cluster_id AS a, b.cluster_id AS b FROM g a JOIN g b ON a.host_name = b.host_name AND a.start_epoch <= b.end_epoch AND b.start_epoch <= a.end_epoch WHERE a.constructor = 'Impact' AND b.constructor = 'Persistence'")
def contradictions(spark, d):
    g = C.group_hits(C.trigger_hits(D.events(spark, d)))
    return T.contradictions(g, spark.createDataFrame([("Impact", "Persistence")], "type_a string, type_b string"))


_SKETCH = """, v AS (SELECT event_id, host_name, value, epoch // 86400 AS period, CASE WHEN value > 0 THEN ceil(ln(value) / ln(1.01 / 0.99))::BIGINT ELSE -2147483647 END AS bucket FROM ev WHERE canonical_type = 'NETWORK_CONNECTION'),
k AS (SELECT host_name, period + u AS period, bucket, count(*) AS n FROM v, unnest(range(1, 8)) AS t(u) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY host_name, period) AS total, sum(n) OVER (PARTITION BY host_name, period ORDER BY bucket) AS up FROM k),
th AS (SELECT host_name, period, min(bucket) AS bucket, any_value(total)::BIGINT AS n FROM c WHERE up > floor(0.95 * (total - 1)) GROUP BY ALL)"""


@query(over_events(_SKETCH + " SELECT event_id, round(value, 6) AS value FROM v JOIN th USING (host_name, period) WHERE value > CASE WHEN th.bucket = -2147483647 THEN 0 ELSE 2 * pow(1.01 / 0.99, th.bucket) / (1.01 / 0.99 + 1) END"))
def outbound_threshold(spark, d):
    """Transfers above the 95 % quantile of their host's seven days before, by merged sketches with 1 % error."""
    return Q.above_earlier(ev(spark, d).where("canonical_type = 'NETWORK_CONNECTION'"), "value", 0.95, ["host_name"]).select("event_id", F.round("value", 6).alias("value"))


@query(over_events(_SKETCH + " SELECT host_name, period, bucket, n FROM th"))
def outbound_sketch(spark, d):
    """The thresholds themselves: for each host and day, from the sketch of the seven days before."""
    rows = ev(spark, d).where("canonical_type = 'NETWORK_CONNECTION'")
    t = Q.thresholds(Q.sketch(rows, "value", ["host_name"], 86400), 0.95, ["host_name"])
    return t.select("host_name", "period", F.when(F.col("threshold") > 0, Q.bucket_of(F.col("threshold"))).otherwise(Q.ZERO).cast("long").alias("bucket"), "n")


@query(over_events("""SELECT a.event_id, b.alert_name AS last_alert FROM (SELECT event_id, host_name, epoch FROM ev WHERE canonical_type <> 'ALERT') a
ASOF LEFT JOIN (SELECT host_name, epoch, max(alert_name) AS alert_name FROM ev WHERE canonical_type = 'ALERT' GROUP BY ALL) b ON a.host_name = b.host_name AND a.epoch >= b.epoch"""))
def last_alert(spark, d):
    """The last alert of the host at or before each event."""
    e = ev(spark, d)
    rows = e.where("canonical_type <> 'ALERT'").select("event_id", "host_name", "epoch")
    return as_of(rows, e.where("canonical_type = 'ALERT'").select("host_name", "epoch", "alert_name"), ["host_name"], "alert_name").select("event_id", F.col("alert_name").alias("last_alert"))


@query("SELECT a.l_partkey AS l_partkey, a.l_orderkey AS a, a.l_linenumber AS la, b.l_orderkey AS b, b.l_linenumber AS lb FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND (a.l_orderkey, a.l_linenumber) < (b.l_orderkey, b.l_linenumber) AND epoch(a.l_shipdate)::BIGINT <= epoch(b.l_shipdate)::BIGINT + 86400 * b.l_quantity::BIGINT AND epoch(b.l_shipdate)::BIGINT <= epoch(a.l_shipdate)::BIGINT + 86400 * a.l_quantity::BIGINT")
def overlapping_deliveries(spark, d):
    """Pairs of lines of one part and supplier whose delivery times, as many days as pieces, overlap."""
    at = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    rows = D.read(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), at.alias("from"), (at + 86400 * F.col("l_quantity").cast("long")).alias("to"))
    met = overlapping_pairs(rows, ["l_partkey", "l_suppkey"], ("from", "to"), ["order", "line"])
    return met.select("l_partkey", F.col("order_1").alias("a"), F.col("line_1").alias("la"), F.col("order_2").alias("b"), F.col("line_2").alias("lb"))


@query(over_events("SELECT event_id, remote_ip FROM ev WHERE remote_ip IN (SELECT '203.0.113.' || n_nationkey FROM nation)"))
def intel_match(spark, d):
    return T.intel_match(ev(spark, d), D.read(spark, d, "nation").select(F.concat(F.lit("203.0.113."), "n_nationkey").alias("indicator"))).select("event_id", "remote_ip")


@query("SELECT page_id, u AS indicator, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(concat_ws(' ', url, html), 'https?://[^\\s''\"<>]+')) AS u FROM pages) GROUP BY ALL")
def carve_urls(spark, d):
    rows = D.read(spark, d, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("all"))
    return T.carve(rows, "all", ["page_id"], T.URL)


@query("SELECT doc_id, u AS indicator, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{1,3}(?:\\.[0-9]{1,3}){3}\\b')) AS u FROM documents) GROUP BY ALL")
def carve_ips(spark, d):
    return T.carve(D.read(spark, d, "documents"), "text", ["doc_id"], T.IPV4)


@query(over_events("SELECT case_id, count(DISTINCT host_name) AS hosts, count(*) AS events, min(epoch) AS first, max(epoch) AS last FROM ev GROUP BY ALL"))
def profile(spark, d):
    return J.case_profile(D.events(spark, d)).select("case_id", "hosts", "events", F.unix_timestamp("first").alias("first"), F.unix_timestamp("last").alias("last"))


@query(over_clusters("""SELECT cluster_id, greatest(0, least(100, round_even(100.0 * (15 + CASE tier WHEN 'STRONG' THEN 15 WHEN 'MODERATE' THEN 10 WHEN 'WEAK' THEN 4 ELSE 0 END + CASE len(triggers) WHEN 1 THEN 5 WHEN 2 THEN 12 ELSE 20 END
  + CASE score % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 10 END + CASE score % 7 WHEN 0 THEN 15 WHEN 1 THEN 12 WHEN 2 THEN 10 WHEN 3 THEN 6 WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 0 END + CASE WHEN counter = 0 THEN 5 ELSE 0 END) / 85
  - CASE WHEN constructor = 'LogClearing' THEN 15 ELSE 0 END - CASE WHEN counter > 20 THEN 20 ELSE 0 END, 0)::INT)) AS score FROM cl"""))
def confidence_scores(spark, d):
    """Each cluster as a hypothesis of a case with several hosts in which tampering was seen; what clusters don't tell is read off their scores."""
    level = F.element_at(F.array(*[F.lit(x) for x in CAUSAL_RANK]), F.col("score") % 7 + 1)
    rows = clusters(spark, d).select("cluster_id", F.lit("HOOK").alias("provenance"), level.alias("causal_level"), F.col("tier").alias("cluster_strength"), F.size("triggers_fired").alias("domain_count"), F.lit(3).alias("host_count"), (F.col("score") % 3).alias("corroborating_hosts"), F.lit(True).alias("anti_forensic_observed"), (F.col("counter") == 0).alias("anti_forensic_clear"), (F.col("constructor") == "LogClearing").alias("near_disturbance"), (F.col("counter") > 20).alias("contradicted"))
    return J.confidence(rows).select("cluster_id", "score")


@query(over_clusters(", di AS (SELECT host_name, start_epoch - CASE constructor WHEN 'LogClearing' THEN 900 ELSE 1800 END AS s, end_epoch + CASE constructor WHEN 'LogClearing' THEN 900 ELSE 1800 END AS e FROM cl WHERE constructor IN ('LogClearing', 'ShadowDeletion')) SELECT event_id FROM ev WHERE canonical_type = 'AUTHENTICATION' AND EXISTS (SELECT 1 FROM di WHERE di.host_name = ev.host_name AND ev.epoch BETWEEN di.s AND di.e)"))
def proximity_gate(spark, d):
    e = D.events(spark, d).where("canonical_type = 'AUTHENTICATION'").select(F.col("event_id"), "case_id", "host_name", F.date_trunc("second", "timestamp").alias("timestamp"))
    di = R.disturbances(clusters(spark, d)).withColumns({"start": F.date_trunc("second", "start"), "end": F.date_trunc("second", "end")})
    return J.near_disturbance(e, di).select("event_id")


@query(over_clusters(f"SELECT cluster_id, CASE WHEN 5 * counter > 60 THEN 'REFUTED' WHEN counter > 0 THEN 'CAVEATS' ELSE 'SUPPORTED' END AS verdict FROM cl WHERE {_SEED}"))
def challenge_verdicts(spark, d):
    cl = G.saved(clusters(spark, d))  # read twice
    h = R.seed(cl).withColumns({"causal_break": F.lit(False), "contradictions": F.lit(0), "near_disturbance": F.lit(False), "n_sources": F.lit(1)})
    proof = h.select("hypothesis_id", "cluster_id").join(cl.select("cluster_id", "counter_evidence"), "cluster_id")
    return J.challenge(h, proof).select("cluster_id", "verdict")


_DEC = "SELECT user_id AS h, event_id, epoch(ts) AS moment, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'insufficient' ELSE 'draft' END AS act FROM events"


@query(f"WITH x AS ({_DEC}) SELECT h AS hypothesis_id, CASE arg_max(act, row(act = 'reject', moment, event_id)) WHEN 'approve' THEN 'APPROVED' WHEN 'reject' THEN 'REJECTED' WHEN 'insufficient' THEN 'INSUFFICIENT' ELSE 'DRAFT' END AS status FROM x GROUP BY h")
def status_fold(spark, d):
    act = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "signup", "insufficient").otherwise("draft")
    return J.fold(D.read(spark, d, "events").select(F.col("user_id").alias("hypothesis_id"), act.alias("action"), F.lit(None).cast("string").alias("link"), F.col("ts").alias("decided_at"), F.col("event_id").alias("seq"))).select("hypothesis_id", "status")


LEVELS = ["CHAIN", "WRITE", "NET", "TIGHT_TIME", "CO_OCCUR"]


def order_links(spark, d):
    """Causal links between successive orders of a customer, by date and by key; where the two disagree, links oppose each other."""
    o = D.read(spark, d, "orders")
    before = lambda *by: F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy(*by))
    o = o.withColumns({"by_date": before("o_orderdate", "o_orderkey"), "by_key": before("o_orderkey")})
    o = o.select(F.explode(F.array_distinct(F.array("by_date", "by_key"))).alias("source"), F.col("o_orderkey").alias("target"), F.col("o_orderdate").alias("at"))
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), ((F.col("source") + F.col("target")) % 5 + 1).cast("int"))
    return o.where("source IS NOT NULL").select("source", "target", level.alias("level"), "at")


_ORDER_LINKS = """lk AS (SELECT source, target, 5 - (source + target) % 5 AS rank, moment FROM (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS source, o_orderkey AS target, o_orderdate AS moment FROM orders
UNION SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), o_orderkey, o_orderdate FROM orders) WHERE source IS NOT NULL)"""


@query(f"WITH {_ORDER_LINKS} SELECT DISTINCT p.source AS a, p.target AS b FROM lk p JOIN lk q ON p.source = q.target AND p.target = q.source WHERE p.source < p.target")
def causal_contradictions(spark, d):
    return J.mutual_links(order_links(spark, d))


@query(f"WITH {_ORDER_LINKS} SELECT o_orderkey AS hypothesis_id FROM orders WHERE o_orderkey NOT IN (SELECT source FROM lk) AND o_orderkey NOT IN (SELECT target FROM lk)")
def orphan_links(spark, d):
    return J.orphans(D.read(spark, d, "orders").select(F.col("o_orderkey").alias("hypothesis_id")), order_links(spark, d))


@query(f"WITH RECURSIVE {_ORDER_LINKS}, b AS (SELECT target, arg_max(source, row(rank, -epoch_us(moment), -source)) AS source FROM lk GROUP BY target), w AS (SELECT target AS node, [target] AS chain FROM (SELECT DISTINCT target FROM lk) UNION ALL SELECT node, list_append(chain, b.source) FROM w JOIN b ON b.target = chain[-1] WHERE NOT list_contains(chain, b.source)) SELECT node, array_to_string(arg_max(chain, len(chain)), '>') AS chain FROM w GROUP BY node")
def kill_chain_whole(spark, d):
    """A chain for each order that has one before it; to any length."""
    return J.root_causes(order_links(spark, d)).select("node", F.array_join("chain", ">").alias("chain"))


@query(f"WITH RECURSIVE {_ORDER_LINKS}, b AS (SELECT target, arg_max(source, row(rank, -epoch_us(moment), -source)) AS source FROM lk GROUP BY target), w AS (SELECT target AS node, [target] AS chain FROM (SELECT DISTINCT target FROM lk) UNION ALL SELECT node, list_append(chain, b.source) FROM w JOIN b ON b.target = chain[-1] WHERE NOT list_contains(chain, b.source)) SELECT node, unnest(range(len(chain))) AS position, unnest(chain) AS member FROM (SELECT node, arg_max(chain, len(chain)) AS chain FROM w GROUP BY node)")
def kill_chain(spark, d):
    """The same chains as rows, one for each step back from an order."""
    return J.root_chains(order_links(spark, d))


@query("SELECT o_orderstatus AS case_id, count_if(o_orderpriority = '1-URGENT') AS drafts, count_if(o_orderpriority <> '1-URGENT') AS approved, count_if(o_orderpriority <> '1-URGENT' AND o_orderkey % 3 = 0) AS without_technique, count_if(o_orderkey % 3 = 1) AS bad_technique, count_if(o_orderpriority <> '1-URGENT' AND o_orderkey % 2 = 0) AS unsigned FROM orders GROUP BY ALL")
def readiness_counts(spark, d):
    k = F.col("o_orderkey") % 3
    tech = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("T1x"))).otherwise(F.array(F.lit("T1003.001")))
    o = D.read(spark, d, "orders").select(F.col("o_orderstatus").alias("case_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "DRAFT").otherwise("APPROVED").alias("status"), tech.alias("techniques"), (F.col("o_orderkey") % 2 == 1).alias("signed"))
    return J.readiness(o)


@query(over_clusters("SELECT host_name, count(*) AS clusters, max(end_epoch) AS last_end, count_if(score >= 40) AS notable FROM cl GROUP BY ALL"))
def host_rollup(spark, d):
    return V.host_rollup(clusters(spark, d))


@query(over_clusters("SELECT cluster_id, score FROM cl WHERE score >= 40 ORDER BY score DESC, cluster_id LIMIT 10"))
def top_clusters(spark, d):
    return V.top_clusters(clusters(spark, d), 40, 10).select("cluster_id", "score")


@query(over_events("SELECT event_id, epoch FROM ev ORDER BY epoch, event_id LIMIT 50 OFFSET 50"))
def page_2(spark, d):
    return V.page(ev(spark, d).select("event_id", "epoch"), [F.col("epoch"), F.col("event_id")], 50, 1)


@query(over_events("SELECT event_id FROM ev WHERE canonical_type = 'PROCESS_EXECUTION' AND contains(lower(concat_ws(chr(1), command_line, process_name, \"user\", host_name, alert_name, target_file, registry_key)), 'psexec')"))
def search_events(spark, d):
    return V.search(ev(spark, d), "PsExec", kind="PROCESS_EXECUTION").select("event_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'token =')")
def free_text(spark, d):
    return D.read(spark, d, "documents").where(V.any_contains("token =", ["text"])).select("doc_id")


@query(over_events("SELECT host_name, \"user\", count_if(logon_type <> '2') AS ok, count_if(logon_type = '2') AS failed FROM ev WHERE canonical_type = 'AUTHENTICATION' GROUP BY ALL"))
def auth_success_split(spark, d):
    return V.auth_summary(ev(spark, d), F.col("logon_type") == "2")


@query(f"WITH {HITS} SELECT DISTINCT 'cluster-' || sha256(constructor || '|' || host_name || '|' || bucket || coalesce('|' || who, ''))[1:16] AS cluster_id, event_id, false AS missing FROM h")
def expand_cluster(spark, d):
    e = D.events(spark, d)
    return V.expand_cluster(C.cluster_members(C.trigger_hits(e)), e.select("event_id")).select("cluster_id", "event_id", "missing")


@query(over_events("SELECT host_name, count(*) AS connections, count(DISTINCT remote_ip) AS destinations FROM ev WHERE canonical_type = 'NETWORK_CONNECTION' GROUP BY ALL"))
def network_summary(spark, d):
    return V.network_summary(ev(spark, d))


@query(over_events("SELECT host_name, count(*) AS changes, count(DISTINCT registry_key) AS keys FROM ev WHERE canonical_type = 'REGISTRY_MODIFICATION' GROUP BY ALL"))
def registry_summary(spark, d):
    return V.registry_summary(ev(spark, d))


@query(over_events("SELECT host_name, \"user\", count(*) AS n FROM ev WHERE canonical_type = 'SERVICE_INSTALLATION' GROUP BY ALL"))
def service_changes(spark, d):
    return V.service_changes(ev(spark, d))


def neighbours_of_nation(spark, d):
    """All pairs of suppliers of one nation, and the links between suppliers and parts, both ways."""
    e = D.read(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    teams = D.read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_nationkey").alias("team"))
    return ShortestPaths(e, teams, 5, both=True)


_PAIRS = """e AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem), pr AS (SELECT 's' || a.s_suppkey AS src, 's' || b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey),
s2 AS (SELECT a.s AS src, b.s AS dst, count(*) AS n FROM e a JOIN e b ON a.p = b.p AND a.s <> b.s GROUP BY ALL), n2 AS (SELECT pr.src, pr.dst, n FROM pr JOIN s2 USING (src, dst)),
n4 AS (SELECT pr.src, pr.dst, sum(x.n * y.n)::BIGINT AS n FROM (SELECT * FROM pr ANTI JOIN n2 USING (src, dst)) pr JOIN s2 x ON x.src = pr.src JOIN s2 y ON y.src = x.dst AND y.dst = pr.dst GROUP BY ALL)"""


@query(f"WITH {_PAIRS} SELECT src, dst, 2 AS steps, n AS n_paths FROM n2 UNION ALL SELECT src, dst, 4, n FROM n4")
def paths_depth5(spark, d):
    """How many shortest paths lead from each supplier to the others of its nation, and of how many steps."""
    return neighbours_of_nation(spark, d).counts()


@query(f"WITH {_PAIRS} SELECT src, dst, 1 AS position, count(DISTINCT e.p) AS n FROM n2 JOIN e ON e.s = src JOIN e f ON f.p = e.p AND f.s = dst GROUP BY ALL UNION ALL SELECT src, dst, 2, count(DISTINCT e.p) FROM n2 JOIN e ON e.s = src JOIN e f ON f.p = e.p AND f.s = dst GROUP BY ALL")
def path_steps(spark, d):
    """How many different steps the shortest paths of two steps have at each place."""
    return neighbours_of_nation(spark, d).step_counts(only=2)


@query("WITH RECURSIVE lk AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem), r(src, node, depth) AS (SELECT 's' || s_suppkey, 's' || s_suppkey, 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation) UNION SELECT src, b, depth + 1 FROM r JOIN lk ON a = node WHERE depth < 5) SELECT src, node, min(depth) AS depth FROM r GROUP BY src, node")
def paths_from_nation(spark, d):
    """Paths from all suppliers of the first nation by name, so the starts grow with the table."""
    e = D.read(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    nation = D.read(spark, d, "nation")
    first = nation.join(nation.agg(F.min("n_name").alias("n_name")), "n_name").select("n_nationkey")
    start = D.read(spark, d, "supplier").join(first, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.concat(F.lit("s"), "s_suppkey").alias("src"))
    return G.reach(e, start, 5, both=True)


@query("WITH RECURSIVE " + over_events("")[5:].rstrip() + """, p AS (SELECT host_name, substr(event_id, 4)::BIGINT AS pid, nullif(substr(event_id, 4)::BIGINT // 7, substr(event_id, 4)::BIGINT) AS ppid FROM ev WHERE canonical_type = 'PROCESS_EXECUTION'),
t AS (SELECT host_name, pid, 0 AS depth FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.host_name = p.host_name AND q.pid = p.ppid) UNION ALL SELECT p.host_name, p.pid, depth + 1 FROM p JOIN t ON p.host_name = t.host_name AND p.ppid = t.pid)
SELECT p.host_name, p.pid, p.ppid, t.depth FROM p LEFT JOIN t USING (host_name, pid)""")
def process_tree_whole(spark, d):
    """One process for each PROCESS_EXECUTION event, so the tree grows with the table; to any depth."""
    pid = F.col("source_doc_id").cast("long")
    started = D.events(spark, d).where("canonical_type = 'PROCESS_EXECUTION'").withColumns({"pid": pid, "ppid": F.nullif(F.floor(pid / 7), pid)})
    return H.process_tree(started).select("host_name", "pid", "ppid", "depth")


@query("WITH RECURSIVE " + over_events("")[5:].rstrip() + """, p AS (SELECT host_name, substr(event_id, 4)::BIGINT AS pid, nullif(substr(event_id, 4)::BIGINT // 7, substr(event_id, 4)::BIGINT) AS ppid FROM ev WHERE canonical_type = 'PROCESS_EXECUTION'),
t AS (SELECT host_name, pid, pid AS root, pid::VARCHAR AS path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.host_name = p.host_name AND q.pid = p.ppid) UNION ALL SELECT p.host_name, p.pid, t.root, t.path || '/' || p.pid FROM p JOIN t ON p.host_name = t.host_name AND p.ppid = t.pid)
SELECT host_name, pid, root, path FROM t""")
def process_tree(spark, d):
    """The root of each process and the path from there, by pointer doubling."""
    pid = F.col("source_doc_id").cast("long")
    started = D.events(spark, d).where("canonical_type = 'PROCESS_EXECUTION'").withColumns({"pid": pid, "ppid": F.nullif(F.floor(pid / 7), pid)})
    return H.process_tree(started).select("host_name", "pid", "root", "path")


for _more in (ingest, lists, rare, summary):
    QUERIES |= _more.QUERIES
    ORACLE_SQL |= _more.ORACLE_SQL
