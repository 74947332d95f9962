"""Registered queries over lists, details and judgements of a case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import exprs as X
from ..functions.lookups import TECHNIQUES
from ..operators import cluster as C, detect as T, graph as G, judge as J, lists as L, reduce as R
from ..operators.path_dag import ShortestPaths
from ..sources import driver as D
from .oracle import HITS, over_clusters, over_events

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def drafts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as hypotheses."""
    k = F.col("o_orderkey")
    tier = F.element_at(F.array(*[F.lit(t) for t in L.TIERS]), (k % 4 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "O", "DRAFT").when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("REJECTED")
    return D.read(spark, d, "orders").select(k.alias("hypothesis_id"), status.alias("status"), tier.alias("confidence"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderpriority").alias("kind"))


_DRAFTS = "dr AS (SELECT o_orderkey AS hypothesis_id, CASE o_orderstatus WHEN 'O' THEN 'DRAFT' WHEN 'F' THEN 'APPROVED' ELSE 'REJECTED' END AS status, o_orderkey % 4 AS rank, ['HIGH', 'MEDIUM', 'LOW', 'SPECULATIVE'][o_orderkey % 4 + 1] AS confidence, o_orderdate AS created_at, o_orderpriority AS kind FROM orders)"


@query(over_events("SELECT event_id, canonical_type FROM ev WHERE event_id IN (SELECT 'ev-' || o_orderkey FROM orders) OR substr(event_id, 4) IN (SELECT c_custkey::VARCHAR FROM customer)"))
def events_by_id(spark, d):
    ids = D.read(spark, d, "orders").select(F.concat(F.lit("ev-"), "o_orderkey").alias("id")).unionByName(D.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id")))
    return L.events_by_id(D.events(spark, d), ids).select("event_id", "canonical_type")


@query(f"WITH {_DRAFTS} SELECT hypothesis_id FROM dr WHERE status = 'APPROVED' ORDER BY created_at DESC, hypothesis_id LIMIT 50")
def hypotheses_newest(spark, d):
    return L.hypotheses(drafts(spark, d), "APPROVED").select("hypothesis_id")


@query(f"WITH {_DRAFTS} SELECT hypothesis_id, confidence FROM dr WHERE status = 'DRAFT' AND confidence IN ('HIGH', 'LOW') AND created_at >= TIMESTAMP '1996-01-01' ORDER BY rank, created_at DESC, hypothesis_id LIMIT 80")
def hypotheses_worklist(spark, d):
    return L.worklist(drafts(spark, d), "1996-01-01", ["HIGH", "LOW"], 80).select("hypothesis_id", "confidence")


@query(over_events("SELECT entity_id, entity_key FROM (SELECT sha256('CASE-1:file:' || host_name || ':' || target_file)[1:32] AS entity_id, host_name || ':' || target_file AS entity_key, max(timestamp) AS last_seen FROM ev WHERE contains(lower(host_name || ':' || target_file), 'data/x.lock') GROUP BY ALL) ORDER BY last_seen DESC, entity_id LIMIT 20"))
def entities_found(spark, d):
    return L.find_entities(G.entities(D.events(spark, d)), "DATA/x.Lock", "file").select("entity_id", "entity_key")


@query(f"WITH {_DRAFTS} SELECT hypothesis_id AS entry_id FROM dr WHERE created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30' AND kind IN ('1-URGENT', '5-LOW') ORDER BY created_at, hypothesis_id LIMIT 100")
def journal_span(spark, d):
    entries = drafts(spark, d).select(F.col("hypothesis_id").alias("entry_id"), "kind", F.col("created_at").alias("at"))
    return L.journal(entries, "1995-01-01", "1996-06-30", ["1-URGENT", "5-LOW"], False, 100).select("entry_id")


@query("SELECT event_id AS audit_id FROM events WHERE event_type = 'click' AND props = (SELECT min(props) FROM events) ORDER BY ts DESC, event_id LIMIT 50")
def audit_newest(spark, d):
    e = D.read(spark, d, "events").select(F.col("event_id").alias("audit_id"), F.lit("c").alias("case_id"), F.col("event_type").alias("tool"), F.col("props").alias("examiner"), F.col("ts").cast("timestamp").alias("at"))
    first = D.read(spark, d, "events").agg(F.min("props")).first()[0]
    return L.audit(e, "c", "click", first).select("audit_id")


@query(r"SELECT e AS audit_id, regexp_matches(e, '^[a-z][a-z0-9-]*-[a-z0-9][a-z0-9-]*-\d{8}-\d{3,}$') AS valid FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'tool-' || o_custkey || '-20240501-' || lpad(o_orderkey::VARCHAR, 6, '0') WHEN 1 THEN 'tool-x-2024-' || o_orderkey WHEN 2 THEN 't2-scan-ann-lee' || o_custkey || '-20240501-001' WHEN 3 THEN 'tool_a-x-20240501-001' ELSE 'TOOL-x-20240501-001' END AS e FROM orders)")
def audit_id_format(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    made = F.when(k % 5 == 0, F.concat(F.lit("tool-"), c, F.lit("-20240501-"), F.lpad(k.cast("string"), 6, "0"))).when(k % 5 == 1, F.concat(F.lit("tool-x-2024-"), k)).when(k % 5 == 2, F.concat(F.lit("t2-scan-ann-lee"), c, F.lit("-20240501-001"))).when(k % 5 == 3, "tool_a-x-20240501-001").otherwise("TOOL-x-20240501-001")
    return D.read(spark, d, "orders").select(made.alias("audit_id")).select("audit_id", L.is_audit_id(F.col("audit_id")).alias("valid"))


@query(over_events(""", x AS (SELECT DISTINCT sha256('CASE-1:user:' || "user")[1:32] AS from_id, sha256('CASE-1:host:' || host_name)[1:32] AS to_id, epoch FROM ev WHERE canonical_type = 'AUTHENTICATION')
SELECT from_id, to_id, epoch FROM x WHERE epoch BETWEEN epoch(TIMESTAMP '2024-01-05') AND epoch(TIMESTAMP '2024-01-20')"""))
def edges_in_span(spark, d):
    e = G.edges(D.events(spark, d).where("canonical_type = 'AUTHENTICATION'").withColumn("timestamp", F.date_trunc("second", "timestamp")))
    return L.edge_timeline(e, "2024-01-05", "2024-01-20", None).select("from_id", "to_id", F.unix_timestamp("timestamp").alias("epoch"))


@query(over_events(""", x AS (SELECT DISTINCT sha256('CASE-1:user:' || "user")[1:32] AS u, sha256('CASE-1:host:' || host_name)[1:32] AS h, epoch FROM ev WHERE canonical_type = 'AUTHENTICATION') SELECT h AS entity_id, 'host' AS entity_type, u AS neighbour_id, count(*) AS n FROM x GROUP BY ALL"""))
def entity_details(spark, d):
    ev = D.events(spark, d).where("canonical_type = 'AUTHENTICATION'")
    ent = G.entities(ev)
    return L.entity_detail(ent, G.edges(ev), ent.where("entity_type = 'host'").select("entity_id")).groupBy("entity_id", "entity_type", "neighbour_id").agg(F.count(F.lit(1)).alias("n"))


@query(over_clusters(f", {_DRAFTS} SELECT 'hypothesis' AS kind, status AS name, count(*) AS n FROM dr GROUP BY ALL UNION ALL SELECT 'cluster', tier, count(*) FROM cl GROUP BY ALL UNION ALL SELECT 'journal', kind, count(*) FROM dr GROUP BY ALL"))
def status_counts(spark, d):
    h = drafts(spark, d)
    return L.digest(h, C.build_clusters(D.events(spark, d)), h)


@query(over_clusters("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN 5 * counter > 60 THEN 'REFUTED' WHEN counter > 0 THEN 'CAVEATS' ELSE 'SUPPORTED' END AS verdict FROM cl WHERE score >= 40) GROUP BY ALL"))
def challenge_batch(spark, d):
    cl = G.saved(C.build_clusters(D.events(spark, d)).where("score >= 40"))  # read twice
    h = cl.select(F.col("cluster_id").alias("hypothesis_id"), F.lit("DRAFT").alias("status")).withColumns({"causal_break": F.lit(False), "contradictions": F.lit(0), "near_disturbance": F.lit(False), "n_sources": F.lit(1)})
    _, notes = L.challenge_drafts(h, cl.select(F.col("cluster_id").alias("hypothesis_id"), "cluster_id", "counter_evidence"), "CASE-1")
    return notes.groupBy(F.substring("note", 10, 20).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(over_clusters("SELECT cluster_id, counter FROM cl WHERE counter > 0"))
def counter_details(spark, d):
    """What each counter that applied took off, added up again from the details."""
    return L.cluster_detail(C.build_clusters(D.events(spark, d))).where("applies").groupBy("cluster_id").agg(F.sum("weight").alias("counter"))


@query("SELECT o_orderkey AS hypothesis_id, CASE WHEN o_orderkey % 4 = 3 OR o_custkey % 100 < 31 THEN 'INSUFFICIENT' WHEN o_custkey % 100 >= 76 AND o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0 AND (o_orderkey % 3 <> 1 OR o_custkey % 2 = 0) THEN 'APPROVED' ELSE 'DRAFT' END AS status, ['MCP', 'HOOK', 'SHELL', 'NONE'][o_orderkey % 4 + 1] AS provenance FROM orders")
def gate_status(spark, d):
    """Gates of hypotheses: the weakest of their audit ids, the score, tampering near by, and claims of cause that need a strong link."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    extra = F.when(k % 4 == 1, "ingest-7").when(k % 4 == 2, "manual-1").when(k % 4 == 3, "note").otherwise("tool-b-2")
    o = D.read(spark, d, "orders").select(
        k.alias("hypothesis_id"), F.array(F.lit("tool-a-1"), extra).alias("audit_ids"), (c % 100).alias("score"), F.when(k % 3 == 0, "the dropper Spawned a shell").when(k % 3 == 1, "Because of the dropper").otherwise("seen together").alias("interpretation"),
        F.array(F.when(c % 2 == 0, "WRITE").otherwise("TIGHT_TIME")).alias("levels"), (k % 5 == 0).alias("near_disturbance"),
    )
    return J.gate(o).select("hypothesis_id", "status", "provenance")


@query("SELECT t AS technique, regexp_matches(t, '^T[0-9]+([.][0-9]+)?$') AS valid, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'T' || (1000 + o_custkey % 50) WHEN 1 THEN 'T' || (1000 + o_custkey % 50) || '.00' || (1 + o_orderkey % 3) WHEN 2 THEN 'TA' || o_custkey % 9 ELSE 'T1.2.3' END AS t FROM orders) GROUP BY ALL")
def technique_validity(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = F.when(k % 4 == 0, F.concat(F.lit("T"), 1000 + c % 50)).when(k % 4 == 1, F.concat(F.lit("T"), 1000 + c % 50, F.lit(".00"), 1 + k % 3)).when(k % 4 == 2, F.concat(F.lit("TA"), c % 9)).otherwise("T1.2.3")
    return D.read(spark, d, "orders").select(t.alias("technique")).groupBy("technique", X.is_technique(F.col("technique")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def _technique_sql() -> str:
    """The technique of a trigger: of the first entry whose name holds the trigger's, or the other way round."""
    return "CASE " + " ".join(f"WHEN contains(trigger, '{a}') OR contains('{a}', trigger) THEN '{b}'" for a, b in TECHNIQUES.items()) + " END"


@query(f"WITH {HITS} SELECT trigger, {_technique_sql()} AS technique, count(*) AS n FROM h GROUP BY ALL")
def trigger_techniques(spark, d):
    """The techniques of all triggers that fire, and how often they do."""
    hits = C.trigger_hits(D.events(spark, d))
    return hits.groupBy("trigger").agg(F.count(F.lit(1)).alias("n")).select("trigger", R.technique(F.col("trigger")).alias("technique"), "n")


@query("SELECT name AS p_name, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM (SELECT p_name AS name, ch, count(*)::DOUBLE AS c, any_value(length(p_name))::DOUBLE AS n FROM (SELECT p_name, unnest(string_split(p_name, '')) AS ch FROM (SELECT DISTINCT p_name FROM part)) GROUP BY p_name, ch) GROUP BY name")
def name_entropy(spark, d):
    return T.entropy(D.read(spark, d, "part"), "p_name").select("p_name", F.round("entropy", 6).alias("entropy"))


@query("SELECT l_orderkey, l_linenumber, abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) > 300000000 AS mismatch, l_shipdate < o_orderdate AS si_first, epoch_us(l_shipdate) % 1000000 = 0 AS rounded, l_shipdate < TIMESTAMP '1995-01-01' AS before_install FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def timestamp_anomalies(spark, d):
    o = D.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp").alias("fn_created"))
    files = D.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("si_created")).join(o, "l_orderkey")
    return T.timestamp_anomalies(files, F.lit("1995-01-01").cast("timestamp")).select("l_orderkey", "l_linenumber", "mismatch", "si_first", "rounded", "before_install")


@query(over_events("SELECT \"user\", command_line, min(host_name) AS host_name FROM ev WHERE command_line IS NOT NULL GROUP BY ALL HAVING count(DISTINCT host_name) = 1"))
def single_host(spark, d):
    return T.single_host(D.events(spark, d).where("command_line IS NOT NULL"), ["user", "command_line"])


@query("SELECT s1.s AS src, s2.s AS dst, count(DISTINCT p) AS paths FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) s1 JOIN (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) s2 USING (p) WHERE s2.s = s1.s + 1 GROUP BY ALL")
def shortest_paths(spark, d):
    """How many shortest paths lead from each supplier to the next one."""
    e = D.read(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    pairs = D.read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("dst"))
    found = ShortestPaths(e, pairs, 2, both=True).counts()
    return found.select(F.substring("src", 2, 20).cast("long").alias("src"), F.substring("dst", 2, 20).cast("long").alias("dst"), F.col("n_paths").alias("paths"))


@query("SELECT lower(regexp_replace(p_name, '[ ]', '/', 'g')) AS path, md5(p_partkey::VARCHAR) AS md5 FROM part QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(p_name, '[ ]', '/', 'g')) ORDER BY p_type <> 'ECONOMY', md5(p_partkey::VARCHAR)) = 1")
def path_hashes(spark, d):
    k = F.col("p_partkey")
    rows = D.read(spark, d, "part").select("p_type", F.regexp_replace("p_name", " ", r"\\").alias("path"), F.upper(F.md5(k.cast("string").cast("binary"))).alias("md5"))
    return L.path_hashes(rows.where("p_type = 'ECONOMY'"), rows.where("p_type <> 'ECONOMY'"))


#: Paths and what they are, by hand.
COLLECTED = {
    r"C:\w\Security.evtx": "evtx", "/d/disk.E01": "e01", "/d/host-memory-raw.001": "memory", "/p/CMD.EXE-1.pf": "prefetch", "/n/x.pcapng": "pcap", "/u/a.lnk": "lnk", "/u/mail.ost": "outlook", "/u/a.automaticDestinations-ms": "jumplist", "/t/super.csv": "win_timeline", "/t/c.plaso": "plaso_storage",
    "/k/triage.zip": "kape_zip", "/x/tool.exe": "unknown", "/var/log/auth.log": "unknown", "/var/log/secure-2024": "auth_log", "/e/$MFT": "mft", "/e/$J": "usn_journal", "/e/$LogFile": "logfile", "/e/Amcache.hve": "amcache", "/e/COMPONENTS": "registry", "/e/other.hve": "registry",
    "/b/History": "browser_history", "/h/.bash_history": "bash_history", r"C:\$Recycle.Bin\x": "recyclebin", r"C:\inetpub\logs\u_ex": "iis_log", "/var/apache2/access": "apache_log", "/w/Tasks/upd.xml": "scheduled_task_xml", "/w/notes.xml": "unknown", "/none": "unknown",
}


@query(f"SELECT o_orderkey, [{', '.join(repr(v) for v in COLLECTED.values())}][o_orderkey % {len(COLLECTED)} + 1] AS kind FROM orders")
def evidence_kinds(spark, d):
    k = F.col("o_orderkey")
    path = F.element_at(F.array(*[F.lit(p) for p in COLLECTED]), (k % len(COLLECTED) + 1).cast("int"))
    return D.read(spark, d, "orders").select("o_orderkey", X.evidence_type(path).alias("kind"))


@query(over_events("SELECT event_id, logon_type = '2' AS logon_failed, host_name IN (SELECT 'host-' || n_regionkey FROM nation WHERE n_nationkey < 5) AS from_admin_host, hour(timestamp) IN (22, 23, 0, 1, 2, 3) AS in_maintenance FROM ev WHERE canonical_type = 'AUTHENTICATION'"))
def lateral_counters(spark, d):
    admin = D.read(spark, d, "nation").where("n_nationkey < 5").select(F.concat(F.lit("host-"), "n_regionkey").alias("source"))
    rows = T.lateral_counters(D.events(spark, d).where("canonical_type = 'AUTHENTICATION'"), F.col("logon_type") == "2", "host_name", admin, [(22, 4)])
    return rows.select("event_id", "logon_failed", "from_admin_host", "in_maintenance")
