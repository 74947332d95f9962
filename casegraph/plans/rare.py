"""Registered queries over orders as events of the kinds that the event table has none of, and over ids and hashes as the operators make them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exprs import content_hash
from ..operators import cluster as C, detect as T, graph as G, judge as J, lists as L
from ..operators.graph import saved
from ..operators.normalize import normalize
from ..operators.rules import BY_NAME
from ..sources import driver as D, records as R
from .oracle import over_clusters, over_events

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


ALERT, FILE, PROCESS = "ALERT", "FILE_CREATION", "PROCESS_EXECUTION"
#: An event for each remainder of an order's key, and by hand the triggers that it sets off: family, trigger, base.
CASES = [
    ({"canonical_type": ALERT, "alert_name": "Mass File enumeration"}, [("Collection", "mass_file_enumeration", 20)]),
    ({"canonical_type": FILE, "target_file": r"C:\Users\a\AppData\x.7z"}, [("Collection", "archive_creation_unusual_path", 25)]),
    ({"canonical_type": PROCESS, "process_name": "findstr.exe", "command_line": "findstr /s Password *"}, [("Collection", "password_grep_pattern", 35)]),
    ({"canonical_type": ALERT, "alert_name": "Document enumeration by a script"}, [("Collection", "document_recursive_enumeration", 20)]),
    ({"canonical_type": ALERT, "alert_name": "clipboard and keylog"}, [("Collection", "screenshot_or_clipboard_yara", 25)]),
    ({"canonical_type": ALERT, "alert_name": "Outlook PST export"}, [("Collection", "outlook_pst_access_unusual", 20)]),
    ({"canonical_type": ALERT, "alert_name": "Timestomp, SI-FN"}, [("Timestomp", "si_fn_timestamp_mismatch", 25)]),
    ({"canonical_type": ALERT, "alert_name": "impossible timestamp, backdated"}, [("Timestomp", "si_before_fn", 30), ("Timestomp", "backdated_file", 25)]),
    ({"canonical_type": ALERT, "alert_name": "Suspicious Timestamp"}, [("Timestomp", "rounded_second_timestamps", 20)]),
    ({"canonical_type": PROCESS, "process_name": "x.exe", "process_path": r"C:\Users\Public\x.exe"}, [("MemoryAnomaly", "executable_in_writable_path", 35)]),
    ({"canonical_type": ALERT, "alert_name": "memory region", "plugin": "windows.malfind"}, [("MemoryAnomaly", "pe_header_in_private_memory", 60)]),
    ({"canonical_type": FILE, "target_file": r"C:\Temp\a.dll"}, [("MemoryAnomaly", "unsigned_dll_in_writable_path", 50)]),
    ({"canonical_type": ALERT, "alert_name": "Process hollowing seen"}, [("MemoryAnomaly", "sigma_process_injection_alert", 55)]),
    ({"canonical_type": PROCESS, "process_name": "", "plugin": "windows.pslist"}, [("MemoryAnomaly", "process_no_image_path", 55)]),
    ({"canonical_type": ALERT, "alert_name": "benign notice"}, []),
]
RARE = tuple(BY_NAME[n] for n in ("Collection", "Timestomp", "MemoryAnomaly"))


def rare_events(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("o_orderkey") % len(CASES)).cast("int")
    pick = lambda name: F.element_at(F.array(*[F.lit(c.get(name)).cast("string") for c, _ in CASES]), k + 1)
    plugin = pick("plugin")
    names = ["canonical_type", "alert_name", "target_file", "process_name", "process_path", "command_line"]
    return D.read(spark, d, "orders").select(
        F.concat(F.lit("o-"), "o_orderkey").alias("event_id"), F.lit("CASE-2").alias("case_id"), F.concat(F.lit("pc-"), F.col("o_custkey") % 5).alias("host_name"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.lit("u").alias("user"),
        *[pick(n).alias(n) for n in names], *[F.lit(None).cast(t).alias(n) for n, t in (("remote_ip", "string"), ("remote_port", "int"), ("registry_key", "string"), ("pid", "long"), ("ppid", "long"))],
        F.when(plugin.isNotNull(), F.create_map(F.lit("plugin"), plugin, F.lit("PrivateMemory"), F.lit("1"))).alias("volatility"),
    )


_MET = "x AS (SELECT 'pc-' || o_custkey % 5 AS host_name, floor(epoch(o_orderdate))::BIGINT AS epoch, o_orderkey, unnest([" + ", ".join("[" + ", ".join(f"{{'c': '{c}', 't': '{t}', 'b': {b}}}" for c, t, b in met) + "]" for _, met in CASES) + f"][o_orderkey % {len(CASES)} + 1]) AS m FROM orders), m AS (SELECT host_name, epoch, o_orderkey, m.c AS constructor, m.t AS trigger, m.b AS base FROM x)"


@query(f"WITH {_MET} SELECT host_name, constructor, trigger, count(*) AS n FROM m GROUP BY ALL")
def hits_of_rare_kinds(spark, d):
    """Hits of the three families that the event table never meets."""
    return C.trigger_hits(rare_events(spark, d), RARE).groupBy("host_name", "constructor", "trigger").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MET} SELECT constructor, host_name, CASE constructor WHEN 'Timestomp' THEN epoch ELSE epoch - epoch % 1800 END AS bucket, array_to_string(list_sort(list(DISTINCT trigger)), ',') AS triggers, max(base)::INT AS base_score, count(DISTINCT o_orderkey) AS n_members, min(epoch) AS start_epoch, max(epoch) AS end_epoch FROM m GROUP BY ALL")
def groups_of_rare_kinds(spark, d):
    """And their clusters."""
    g = C.group_hits(C.trigger_hits(rare_events(spark, d), RARE))
    return g.select("constructor", "host_name", "bucket", F.array_join(F.array_sort("triggers_fired"), ",").alias("triggers"), "base_score", "n_members", "start_epoch", "end_epoch")


@query(over_events("""SELECT event_id AS source_doc_id, sha256('C9:' || host_name || ':' || canonical_type || ':' || epoch_us(timestamp) // 1000 || ':' || coalesce(process_name, '') || ':' || coalesce(target_file, '') || ':' || CASE WHEN canonical_type = 'SCHEDULED_TASK' THEN '10.7.7.7' ELSE coalesce(remote_ip, '') END || ':' || coalesce(registry_key, '') || ':ecs:' || event_id)[1:32] AS event_id, host_name,
  CASE WHEN canonical_type = 'AUTHENTICATION' THEN 'corp\\' || "user" WHEN canonical_type = 'ALERT' THEN 'sub' ELSE "user" END AS "user", CASE WHEN canonical_type = 'SERVICE_INSTALLATION' THEN 'from data' ELSE command_line END AS command_line,
  CASE WHEN canonical_type = 'SCHEDULED_TASK' THEN '10.7.7.7' ELSE remote_ip END AS remote_ip FROM ev"""))
def norm_event_ids(spark, d):
    """The ids that normalization gives, and fields that come from a domain, or from an event's data where the field is empty."""
    e = D.events(spark, d)
    is_ = lambda k: F.col("canonical_type") == k
    more = [(F.lit("canonical_type"), F.col("canonical_type")), (F.lit("user_domain"), F.when(is_("AUTHENTICATION"), "corp")), (F.lit("SubjectUserName"), F.when(is_("ALERT"), "sub")), (F.lit("CommandLine"), F.when(is_("SERVICE_INSTALLATION"), "from data")), (F.lit("ClientAddress"), F.when(is_("SCHEDULED_TASK"), "10.7.7.7"))]
    fields = {"user": F.when(~is_("ALERT"), F.col("user"))} | {c: F.col(c) for c in ("process_name", "command_line", "target_file", "remote_ip", "remote_port", "registry_key", "alert_name")}
    ecs = e.select(F.col("event_id").alias("doc_id"), "host_name", F.col("timestamp").alias("ts"), F.lit("ecs").alias("artifact"), *[fields.get(f, F.lit(None)).cast(R.KINDS.get(f, "string")).alias(f) for f in R.FIELDS], F.create_map(*[x for p in more for x in p]).alias("extra"))
    return normalize(ecs, "C9").select("source_doc_id", "event_id", "host_name", "user", "command_line", "remote_ip")


@query("SELECT o_orderkey AS hypothesis_id FROM orders WHERE o_orderpriority = '1-URGENT'")
def changed_after_staging(spark, d):
    """Hypotheses whose text is no longer what was hashed when they were staged."""
    was = F.struct(F.col("o_orderstatus").alias("title"), F.concat(F.lit("obs "), "o_custkey").alias("observation"), F.lit("because").alias("interpretation"), F.array(F.lit("T1")).alias("techniques"))
    o = D.read(spark, d, "orders").withColumn("w", was)
    h = o.select(F.col("o_orderkey").alias("hypothesis_id"), "w.title", F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.col("w.observation"), F.lit("!"))).otherwise(F.col("w.observation")).alias("observation"), "w.interpretation", "w.techniques", content_hash(*[F.col(f"w.{x}") for x in ("title", "observation", "interpretation", "techniques")]).alias("content_hash"))
    return J.changed(h).select("hypothesis_id")


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 8 AS k FROM orders) SELECT 's-' || o_orderkey AS event_id, ['encoded,evaluated', 'char_codes,joined', 'back_ticks,evaluated', 'format,evaluated', 'encoded,long_word'][k + 1] AS ways FROM s WHERE k < 5""")
def obfuscated_scripts(spark, d):
    """Script blocks that hide what they do in two ways; one way, or none, is no finding."""
    k = (F.col("o_orderkey") % 8).cast("int")
    texts = [
        "$x = [Convert]::FromBase64String($y); iex $x", "-join ([char]72,[char]101,[char]108,[char]0x6c)", "I`nv`oke-We`b x; iex $a", "&('{2}{0}{1}' -f 'ke','-x','invo')", "powershell -enc " + "QUJD" * 60, "(1..3) -join ','", "Get-ChildItem C:/", "iex (get-content a.ps1)",
    ]
    blocks = D.read(spark, d, "orders").select(F.concat(F.lit("s-"), "o_orderkey").alias("event_id"), F.create_map(F.lit("ScriptBlockText"), F.element_at(F.array(*[F.lit(t) for t in texts]), k + 1)).alias("event_data"))
    return T.obfuscated_scripts(blocks, F.col("event_data")["ScriptBlockText"]).select("event_id", F.array_join("ways", ",").alias("ways"))


@query(over_clusters("""SELECT 'CASE-1' AS case_id, (SELECT count(DISTINCT host_name) FROM ev) AS hosts, (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM cl) AS clusters, (SELECT count(*) FROM cl WHERE constructor IN ('LogClearing', 'ShadowDeletion', 'Timestomp')) AS disturbances,
  (SELECT count_if(tier = 'STRONG') FROM cl) AS approved, (SELECT count(DISTINCT host_name) FROM ev) AS gaps"""))
def report_header(spark, d):
    """The head of a case report, and how long its tables are: strong clusters as approved findings, and each host lacks a memory image."""
    e, cl = D.events(spark, d), saved(C.build_clusters(D.events(spark, d)))
    h = cl.select("case_id", F.col("cluster_id").alias("hypothesis_id"), F.when(F.col("tier") == "STRONG", "APPROVED").otherwise("DRAFT").alias("status"))
    gaps = e.select("case_id", "host_name", F.lit("memory").alias("kind")).distinct()
    tables = L.report(h, cl, gaps, cl.where("constructor IN ('LogClearing', 'ShadowDeletion', 'Timestomp')"), G.entities(e), G.edges(e), J.case_profile(e))
    size = lambda name: tables[name].count()
    return tables["header"].select("case_id", "hosts", "events", F.lit(size("clusters")).cast("long").alias("clusters"), F.lit(size("disturbances")).cast("long").alias("disturbances"), "approved", "gaps")
