"""Registered queries over ingest: given tables written in the shapes of forensic tools, read back by the readers, and normalized."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.exprs import content_hash
from ..functions.paths import host_of_path
from ..operators.graph import spread
from ..operators.normalize import normalize
from ..sources import driver as D, records as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def utc(at: Column, form: str) -> Column:
    return F.date_format(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()), form)


def shown(events: DataFrame, *columns: str) -> DataFrame:
    return events.select(*[F.unix_millis("timestamp").alias("ms") if c == "ms" else F.col("event_data")[c[5:]].alias(c[5:]) if c.startswith("data.") else F.col(c) for c in columns])


CODES = ["4624", "4688", "7045", "4698", "5156", "1102", "4663", "4104", "4660", "4720"]


@query(r"""WITH e AS (SELECT *, ['4624', '4688', '7045', '4698', '5156', '1102', '4663', '4104', '4660', '4720'][event_id % 10 + 1] AS code FROM events WHERE event_id % 50 <> 7)
SELECT 'HOST-' || user_id % 100 AS host_name, ['AUTHENTICATION', 'PROCESS_EXECUTION', 'SERVICE_INSTALLATION', 'SCHEDULED_TASK', 'NETWORK_CONNECTION', 'LOG_CLEARED', 'FILE_MODIFICATION', 'PROCESS_EXECUTION', 'FILE_DELETION'][event_id % 10 + 1] AS canonical_type, epoch_us(ts) // 1000 AS ms,
  'u' || user_id AS "user", event_id AS pid, 'p' || user_id % 7 || '.exe' AS process_name, 'C:\bin\p' || user_id % 7 || '.exe' AS process_path, CASE WHEN event_id % 2 = 1 THEN '10.0.0.' || user_id % 200 END AS remote_ip, event_id::VARCHAR AS record_id, CASE WHEN code = '4624' THEN '3' END AS logon_type
FROM e WHERE code <> '4720'""")
def ingest_event_xml(spark: SparkSession, d: str) -> DataFrame:
    """Event records as XML, some of them cut off, all with a repeated name; ids that only have an action, and one that means nothing."""
    e, u = F.col("event_id"), F.col("user_id")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (e % 10 + 1).cast("int"))
    xml = text(
        '<Event><System><Provider Name="audit"/><EventID>', code, '</EventID><TimeCreated SystemTime="', utc(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), '"/><EventRecordID>', e, "</EventRecordID><Channel>Security</Channel><Computer>HOST-", u % 100,
        '</Computer></System><EventData><Data Name="TargetUserName">old</Data><Data Name="TargetUserName">u', u, '</Data><Data Name="NewProcessId">0x', F.hex(e), '</Data><Data Name="NewProcessName">C:\\bin\\p', u % 7, '.exe</Data><Data Name="IpAddress">', F.when(e % 2 == 1, text("10.0.0.", u % 200)).otherwise("-"),
        '</Data><Data Name="LogonType">', F.when(code == "4624", "3").otherwise(""), "</Data></EventData></Event>",
    )
    rows = spread(D.read(spark, d, "events")).select(F.when(e % 50 == 7, F.substring(xml, 1, 60)).otherwise(xml).alias("xml"))
    return shown(normalize(R.event_xml(rows), "C1"), "host_name", "canonical_type", "ms", "user", "pid", "process_name", "process_path", "remote_ip", "data.record_id", "logon_type")


@query(r"""SELECT 'PC-' || user_id % 9 AS host_name, CASE WHEN event_id % 3 = 0 THEN 'PROCESS_EXECUTION' WHEN event_id % 3 = 1 THEN 'AUTHENTICATION' ELSE 'REGISTRY_MODIFICATION' END AS canonical_type, epoch_us(ts) // 1000 AS ms,
  CASE WHEN event_id % 4 = 0 THEN 'named' ELSE 'u' || user_id END AS "user", CASE WHEN event_id % 3 = 0 THEN 'run ' || event_id END AS command_line, CASE WHEN event_id % 3 = 2 THEN 'HKLM\k' || event_id END AS registry_key FROM events""")
def ingest_event_csv(spark: SparkSession, d: str) -> DataFrame:
    """Event rows with a JSON payload; a user column goes before the payload's."""
    e, k = F.col("event_id"), F.col("event_id") % 3
    field = lambda name, value: text('{"@Name":"', F.lit(name), '","#text":"', value, '"}')
    payload = text('{"EventData":{"Data":[', field("TargetUserName", text("first")), ",", field("TargetUserName", text("u", F.col("user_id"))), ",", F.when(k == 0, field("CommandLine", text("run ", e))).when(k == 2, field("TargetObject", text("HKLM\\\\k", e))).otherwise(field("LogonType", text("3"))), "]}}")
    rows = D.read(spark, d, "events").select(
        text("PC-", F.col("user_id") % 9).alias("Computer"), utc(F.col("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSSXXX").alias("TimeCreated"), F.when(k == 0, "4688").when(k == 1, "4625").otherwise("13").alias("EventId"), F.lit("Security").alias("Channel"), F.lit("p").alias("Provider"),
        F.lit("described").alias("MapDescription"), F.when(e % 4 == 0, "named").otherwise("").alias("UserName"), F.lit("").alias("ExecutableInfo"), payload.alias("Payload"),
    )
    return shown(normalize(R.event_csv(rows), "C1"), "host_name", "canonical_type", "ms", "user", "command_line", "registry_key")


@query(r"""SELECT 'WS1' AS host_name, 'FILE_MODIFICATION' AS canonical_type, epoch_ms(o_orderdate) AS ms, 'C:\data\o' || o_orderkey || '.txt' AS target_file, o_custkey::VARCHAR AS size, CASE WHEN o_orderkey % 3 = 0 THEN 'possible' END AS timestomped FROM orders WHERE o_orderkey % 2 = 0""")
def ingest_file_table(spark: SparkSession, d: str) -> DataFrame:
    """A file table's rows in use; two creation times that differ are marked."""
    k, at = F.col("o_orderkey"), utc(F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
    rows = D.read(spark, d, "orders").select(
        F.when(k % 2 == 0, "True").otherwise("False").alias("InUse"), F.lit("C:\\data").alias("ParentPath"), text("o", k, ".txt").alias("FileName"), F.col("o_custkey").cast("string").alias("FileSize"), at.alias("Created0x10"), at.alias("LastModified0x10"),
        F.when(k % 3 == 0, "2001-01-01 00:00:00").otherwise(at).alias("Created0x30"),
    )
    return shown(normalize(R.file_table(rows, "WS1"), "C1"), "host_name", "canonical_type", "ms", "target_file", "data.size", "data.timestomped")


@query(r"""SELECT 'WS2' AS host_name, 'FILE_MODIFICATION' AS canonical_type, (86400 * (1 + CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 5 END))::BIGINT * 1000 AS ms, '/h/o' || o_orderkey AS target_file, md5(o_orderkey::VARCHAR) AS md5 FROM orders WHERE o_orderkey % 5 <> 4""")
def ingest_bodyfile(spark: SparkSession, d: str) -> DataFrame:
    """Body-file lines: the first positive of four times, none in some."""
    k, day = F.col("o_orderkey"), lambda n: (86400 * (1 + F.col("o_custkey") + n)).cast("string")
    none = k % 5 == 4
    line = text(F.md5(k.cast("string").cast("binary")), "|/h/o", k, "|1|r/r|0|0|12|0|", F.when(none | (k % 3 != 0), "0").otherwise(day(0)), "|0|", F.when(none, "-1").otherwise(day(5)))
    parts = F.split("line", r"\|")
    rows = D.read(spark, d, "orders").select(line.alias("line")).select(*[parts[n].alias(c) for n, c in enumerate(R.BODY)])
    return shown(normalize(R.bodyfile(rows, "WS2"), "C1"), "host_name", "canonical_type", "ms", "target_file", "data.md5")


@query(r"""SELECT 'H' || user_id % 5 AS host_name, CASE WHEN event_id % 4 = 0 THEN 'AUTHENTICATION' ELSE 'ALERT' END AS canonical_type, epoch_us(ts) // 1000 AS ms, 'rule ' || event_type AS alert_name, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'low' END AS alert_level FROM events""")
def ingest_alerts(spark: SparkSession, d: str) -> DataFrame:
    """A rule engine's alerts with spaced names; an event id that means something goes before the alert."""
    e = F.col("event_id")
    rows = D.read(spark, d, "events").select(utc(F.col("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSSXXX").alias("Timestamp"), text("H", F.col("user_id") % 5).alias("Computer"), F.when(e % 4 == 0, "4624").otherwise("").alias("Event ID"), text("rule ", F.col("event_type")).alias("Rule Title"), F.when(e % 2 == 0, "HIGH").otherwise("Low").alias("Rule Level"))
    return shown(normalize(R.alerts(rows), "C1"), "host_name", "canonical_type", "ms", "alert_name", "alert_level")


@query(r"""SELECT 'MEM' AS host_name, 'PROCESS_EXECUTION' AS canonical_type, epoch_ms(TIMESTAMP '2024-01-01' + to_seconds(c_custkey)) AS ms, c_custkey AS pid, c_custkey // 3 AS ppid, 'proc' || c_custkey % 11 || '.exe' AS process_name FROM customer WHERE c_custkey % 7 <> 3""")
def ingest_memory(spark: SparkSession, d: str) -> DataFrame:
    """A memory plugin's rows as maps, with a key twice in another case; rows without a name and a number are none."""
    k = F.col("c_custkey")
    none = k % 7 == 3
    at = utc(F.timestamp_seconds(F.lit(1704067200) + k), "yyyy-MM-dd HH:mm:ssXXX")
    pairs = [("pid", F.when(none, "").otherwise("1")), ("PID", F.when(none, "").otherwise(k.cast("string"))), ("PPID", text("0x", F.hex(F.floor(k / 3)))), ("ImageFileName", F.when(none, "").otherwise(text("proc", k % 11, ".exe"))), ("CreateTime", at)]
    rows = D.read(spark, d, "customer").select(F.create_map(*[x for n, c in pairs for x in (F.lit(n), c)]).alias("row"))
    return shown(normalize(R.memory(rows, "windows.pslist", "MEM"), "C1"), "host_name", "canonical_type", "ms", "pid", "ppid", "process_name")


SOURCES = ["WinPrefetch", "AppCompatCache Registry Entry", "File entry shell item", "MSIE Cache File URL record", "Firefox History", "Firefox Cache", "File stat", "NTFS USN change", "something else"]
TIMELINE_CODES = ["4688", "7045", "1000", "4768", "4624"]


@query(r"""WITH e AS (SELECT *, event_id % 2 = 0 AS is_event, ['4688', '7045', '1000', '4768', '4624'][event_id % 5 + 1] AS code FROM events)
SELECT 'ws' || user_id % 3 AS host_name, CASE WHEN is_event THEN ['PROCESS_EXECUTION', 'SERVICE_INSTALLATION', 'PROCESS_EXECUTION', 'AUTHENTICATION', 'AUTHENTICATION'][event_id % 5 + 1]
    ELSE ['PROCESS_EXECUTION', 'PROCESS_EXECUTION', 'FILE_MODIFICATION', 'NETWORK_CONNECTION', 'NETWORK_CONNECTION', 'NETWORK_CONNECTION', 'FILE_MODIFICATION', 'FILE_MODIFICATION', 'FILE_CREATION'][event_id % 9 + 1] END AS canonical_type,
  (epoch_us(ts) // 1000000) * 1000 AS ms, CASE WHEN event_id % 3 = 0 THEN 'col' WHEN is_event THEN 'u' || user_id END AS "user", CASE WHEN is_event THEN 'go ' || event_id END AS command_line,
  CASE WHEN NOT is_event AND event_id % 9 < 2 THEN 'f' || user_id || '.lnk' END AS process_name, '/x/f' || user_id || '.lnk' AS target_file, CASE WHEN is_event AND event_id % 7 = 0 THEN '10.1.1.1' END AS remote_ip FROM e""")
def ingest_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Timeline rows of 17 columns: event rows typed by the id in their XML, known or not, other rows by each source type, known or not."""
    e = F.col("event_id")
    pick = lambda of: F.element_at(F.array(*[F.lit(x) for x in of]), (e % len(of) + 1).cast("int"))
    extra = text("<EventID Qualifiers='0'>", pick(TIMELINE_CODES), '</EventID><Data Name="TargetUserName">x</Data><Data Name="TargetUserName">u', F.col("user_id"), '</Data><Data Name="CommandLine">go ', e, '</Data><Data Name="IpAddress">', F.when(e % 7 == 0, "10.1.1.1").otherwise("127.0.0.1"), "</Data>")
    rows = D.read(spark, d, "events").select(utc(F.col("ts"), "MM/dd/yyyy").alias("date"), utc(F.col("ts"), "HH:mm:ss").alias("time"), text("ws", F.col("user_id") % 3, ".corp.local").alias("host"), F.when(e % 3 == 0, "col").otherwise("").alias("user"), F.when(e % 2 == 0, "WinEVTX").otherwise(pick(SOURCES)).alias("sourcetype"), F.lit("EVT").alias("source"), extra.alias("extra"), text("TSK:/x/f", F.col("user_id"), ".lnk").alias("filename"), F.lit("d").alias("desc"))
    utc_zone = spark.conf.get("spark.sql.session.timeZone")  # these times have no zone: they are read in the session's
    out = shown(normalize(R.timeline_csv(rows), "C1"), "host_name", "canonical_type", "timestamp", "user", "command_line", "process_name", "target_file", "remote_ip")
    at = F.unix_millis(F.from_utc_timestamp("timestamp", utc_zone) if utc_zone not in ("UTC", "Etc/UTC") else F.col("timestamp"))
    return out.select("host_name", "canonical_type", at.alias("ms"), "user", "command_line", "process_name", "target_file", "remote_ip")


OBJECTS = ["windows:prefetch:execution", "windows:registry:run", "windows:lnk:link", "windows:tasks:job", "msiecf:url", "fs:stat", "not:known"]


@query(r"""WITH e AS (SELECT *, event_id % 2 = 0 AS record FROM events WHERE event_id % 11 <> 3)
SELECT 'pc' || user_id % 4 AS host_name, CASE WHEN record THEN ['AUTHENTICATION', 'PROCESS_EXECUTION', 'SERVICE_INSTALLATION', 'TICKET_REQUEST', 'PROCESS_EXECUTION'][event_id % 5 + 1]
    ELSE ['PROCESS_EXECUTION', 'REGISTRY_MODIFICATION', 'FILE_CREATION', 'SCHEDULED_TASK', 'NETWORK_CONNECTION', 'FILE_MODIFICATION', 'ALERT'][event_id % 7 + 1] END AS canonical_type, epoch_us(ts) // 1000 AS ms,
  CASE WHEN record THEN CASE event_id % 5 WHEN 0 THEN 'u' || user_id WHEN 1 THEN 'sub' WHEN 2 THEN 'acct' WHEN 3 THEN 'k' || user_id END END AS "user", CASE WHEN record AND event_id % 5 = 0 THEN (event_id % 12)::VARCHAR END AS logon_type,
  CASE WHEN record AND event_id % 5 = 1 THEN 'run ' || event_id || ', now' END AS command_line, CASE WHEN record AND event_id % 5 = 2 THEN 'C:/svc/s' || user_id || '.exe' WHEN record AND event_id % 5 = 1 THEN 'C:/p.exe' END AS process_path,
  CASE WHEN record AND event_id % 5 = 0 THEN '10.2.' || user_id % 200 || '.1' WHEN record AND event_id % 5 = 3 THEN '10.3.3.3' END AS remote_ip FROM e""")
def ingest_timeline_json(spark: SparkSession, d: str) -> DataFrame:
    """Timeline objects: strings of event records by position, with missing ones and commas in them, other objects by their data type."""
    e, u = F.col("event_id"), F.col("user_id")
    strings = (
        F.when(e % 5 == 0, text("'S-1', 'sub', 'D', '0x1', 'S-2', 'u", u, "', 'DOM', '0x2', '", e % 12, "', None, None, 'WS', '-', '', None, '0', '0x3', '-', '10.2.", u % 200, ".1', '99'"))
        .when(e % 5 == 1, text("'S-1', 'sub', 'D', '0x1', '0x77', 'C:/p.exe', 'T', '0x2', 'run ", e, ", now', None, '-', None")).when(e % 5 == 2, text("'svc', 'C:/svc/s", u, ".exe', 'x', 'auto', 'acct'"))
        .when(e % 5 == 3, text("'k", u, "', 'DOM', 'svc', 'S', '0x4', '0x17', '10.3.3.3', '88'")).otherwise("'a', 'b'")
    )
    pick = lambda of: F.element_at(F.array(*[F.lit(x) for x in of]), (e % len(of) + 1).cast("int"))
    record = e % 2 == 0
    rows = D.read(spark, d, "events").select(
        F.when(e % 11 == 3, "event_data").otherwise("event").alias("__container_type__"), F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())).alias("timestamp"), F.when(record, "windows:evtx:record").otherwise(pick(OBJECTS)).alias("data_type"),
        F.when(record, pick(["4624", "4688", "7045", "4769", "9999"])).otherwise("").alias("event_identifier"), F.when(record, text("[", e, "] Strings: [", strings, "] Computer Name: x Record Number: 1")).otherwise("plain").alias("message"), text("pc", u % 4).alias("computer_name"),
    )
    return shown(normalize(R.timeline_json(rows), "C1"), "host_name", "canonical_type", "ms", "user", "logon_type", "command_line", "process_path", "remote_ip")


@query(r"""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'dc-' || o_custkey % 30 WHEN 1 THEN 'srv-' || o_custkey % 30 WHEN 2 THEN 'maria' WHEN 3 THEN '10.1.' || o_custkey % 250 || '.7' WHEN 4 THEN 'finance' || o_custkey WHEN 5 THEN '10.9.' || o_custkey % 250 || '.8' ELSE 'the-case' END AS host FROM orders""")
def hosts_of_paths(spark: SparkSession, d: str) -> DataFrame:
    """The hosts of collected files by each rule: before a triage folder, host-like, a word of a folder's name, an address, the first folder, the root."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    path = (
        F.when(k % 7 == 0, text("out/DC-", c % 30, "/C/Windows/System32/winevt/Logs/Security.evtx")).when(k % 7 == 1, text("evidence/SRV_", c % 30, "/Users/a/b.lnk")).when(k % 7 == 2, text("win10-64-maria-10.3.58.", c % 250, "/c/x"))
        .when(k % 7 == 3, text("logs/10.1.", c % 250, ".7/c/f")).when(k % 7 == 4, text("finance", c, "\\", k, ".bin")).when(k % 7 == 5, text("32_10-9-", c % 250, "-8/evtx/", k)).otherwise(text("c/d/", k))
    )
    return D.read(spark, d, "orders").select("o_orderkey", host_of_path(path, F.lit("The Case")).alias("host"))


@query(r"""SELECT o_orderkey, sha256('{"interpretation": "' || o_orderpriority || ' \"\u00e9\" \ud83d\ude00", "observation": "row ' || o_custkey || '\n\\", "technique_ids": [' || CASE WHEN o_orderkey % 2 = 0 THEN '"T2", "T1.002"' ELSE '' END || '], "title": "' || o_orderstatus || '"}')[1:32] AS content_hash FROM orders""")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of hypotheses over sorted JSON with escapes; the order of techniques counts."""
    ids = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("T2"), F.lit("T1.002"))).otherwise(F.array().cast("array<string>"))
    return D.read(spark, d, "orders").select("o_orderkey", content_hash(F.col("o_orderstatus"), text("row ", F.col("o_custkey"), "\n\\"), text(F.col("o_orderpriority"), ' "é" 😀'), ids).alias("content_hash"))


@query(r"""SELECT 'G' AS host_name, CASE o_orderkey % 4 WHEN 0 THEN epoch_ms(o_orderdate) WHEN 1 THEN o_custkey::BIGINT * 1000 + 1700000000000 WHEN 2 THEN o_custkey::BIGINT + 1700000000000 END AS ms, 'note ' || o_orderkey AS message FROM orders""")
def ingest_generic(spark: SparkSession, d: str) -> DataFrame:
    """Any records: the first usable time by the names of fields, as text or as a number of one of three sizes, or none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("long")
    name = F.when(k % 4 == 0, "Last_Run").when(k % 4 == 1, "mtime").when(k % 4 == 2, "EventTime").otherwise("other")
    at = F.when(k % 4 == 0, utc(F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ssXXX")).when(k % 4 == 1, (c + 1700000000).cast("string")).otherwise((c + 1700000000000).cast("string"))
    rows = D.read(spark, d, "orders").select(F.create_map(F.lit("created"), F.lit("unknown"), name, at, F.lit("message"), text("note ", k)).alias("row"))
    return R.generic(rows, "G").select("host_name", F.unix_millis("ts").alias("ms"), "message")


@query(r"""SELECT 'R' AS host_name, 'REGISTRY_MODIFICATION' AS canonical_type, epoch_ms(o_orderdate) AS ms, 'Software\k' || o_custkey AS registry_key, CASE WHEN o_orderkey % 2 = 0 THEN 'v' || o_orderkey END AS "value" FROM orders""")
def ingest_registry(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = D.read(spark, d, "orders").select(utc(F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ssXXX").alias("LastWriteTimestamp"), F.lit("NTUSER").alias("HivePath"), text("Software\\k", F.col("o_custkey")).alias("KeyPath"), F.when(k % 2 == 0, text("v", k)).otherwise("").alias("ValueName"), F.lit("").alias("ValueData"), F.lit("").alias("Description"))
    return shown(normalize(R.registry_csv(rows, "R"), "C1"), "host_name", "canonical_type", "ms", "registry_key", "data.value")


@query(r"""SELECT 'P' AS host_name, 'PROCESS_EXECUTION' AS canonical_type, epoch_ms(o_orderdate) AS ms, 'A' || o_custkey || '.EXE' AS process_name, (o_orderkey % 9)::VARCHAR AS run_count, CASE WHEN o_orderkey % 2 = 0 THEN 'x;y' ELSE 'x' END AS previous_runs FROM orders""")
def ingest_prefetch(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = D.read(spark, d, "orders").select(utc(F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ssXXX").alias("LastRun"), text("A", F.col("o_custkey"), ".EXE").alias("ExecutableName"), (k % 9).cast("string").alias("RunCount"), F.lit("x").alias("PreviousRun0"), F.lit("").alias("PreviousRun1"), F.when(k % 2 == 0, "y").otherwise("").alias("PreviousRun2"), F.lit("h").alias("Hash"))
    return shown(normalize(R.prefetch_csv(rows, "P"), "C1"), "host_name", "canonical_type", "ms", "process_name", "data.run_count", "data.previous_runs")


@query("SELECT (SELECT count(*) FROM events) AS scanned, (SELECT count(*) FROM events WHERE event_id % 10 <> 9 AND event_id % 50 <> 7) AS created, (SELECT count(*) FROM events WHERE event_id % 10 = 9 OR event_id % 50 = 7) AS skipped")
def normalize_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many records were read, and how many became events."""
    from ..operators.normalize import normalize_stats

    e = F.col("event_id")
    code = F.when(e % 50 == 7, F.lit(None)).otherwise(F.element_at(F.array(*[F.lit(c) for c in CODES]), (e % 10 + 1).cast("int")))
    rows = D.read(spark, d, "events").select(F.lit("H").alias("Computer"), utc(F.col("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSSXXX").alias("TimeCreated"), code.alias("EventId"), *[F.lit("").alias(c) for c in ("Channel", "Provider", "MapDescription", "UserName", "ExecutableInfo", "Payload")])
    ecs = R.event_csv(rows)
    return normalize_stats(ecs, normalize(ecs, "C1"))


@query(r"""SELECT 'PROCESS_EXECUTION' AS canonical_type, c_custkey AS pid, 'p' || c_custkey % 9 || '.exe' AS process_name, NULL AS alert_name, 1 AS n FROM customer
UNION ALL SELECT 'ALERT', NULL, 'p' || c_custkey % 9 || '.exe', 'rule ' || o_orderpriority, count(*) FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 4 <> 0 GROUP BY ALL
UNION ALL SELECT 'ALERT', NULL, NULL, 'API Hook Detected', count(*) FROM supplier UNION ALL SELECT 'ALERT', NULL, NULL, CASE WHEN n_regionkey = 0 THEN 'IOC Alert' ELSE 'e' || n_regionkey END, count(*) FROM nation GROUP BY ALL
UNION ALL SELECT 'SERVICE_INSTALLATION', NULL, NULL, NULL, count(*) FROM part UNION ALL SELECT 'REGISTRY_MODIFICATION', NULL, NULL, NULL, count(*) FROM region""")
def ingest_memory_tables(spark: SparkSession, d: str) -> DataFrame:
    """The six tables of a memory image; hits on processes that are gone stay."""
    read = lambda name: D.read(spark, d, name)
    at, none = F.lit("2024-05-01T10:00:00Z"), F.lit(None).cast("string")
    c = F.col("c_custkey")
    processes = read("customer").select(c.alias("ID"), c.alias("PID"), (c + 1).alias("ParentPID"), F.lit("u").alias("Username"), F.lit("C:\\w").alias("Path"), F.when(c % 2 == 0, text("p", c % 9, ".exe")).otherwise("").alias("ProcessName"), text('C:\\w\\p', c % 9, ".exe -x ", c).alias("Arguments"), at.alias("StartTime"), none.alias("Hidden"), none.alias("SID"))
    processes = processes.withColumn("ProcessName", F.when(F.col("ProcessName") == "", text("p", F.col("PID") % 9, ".exe")).otherwise(F.col("ProcessName")))
    hits = read("orders").select(text("rule ", F.col("o_orderpriority")).alias("RuleID"), F.lit("t").alias("HitType"), F.lit(1).alias("ScoreModifier"), text("d", F.col("o_orderkey")).alias("HitDescription"), F.when(F.col("o_orderkey") % 4 == 0, -1).otherwise(F.col("o_custkey")).alias("ProcessID"))
    hooks = read("supplier").select(text("h", F.col("s_suppkey")).alias("HookDescription"), *[none.alias(x) for x in ("HookedFunction", "HookedModule", "HookingModule", "HookingAddress")])
    services = read("part").select(text("s", F.col("p_partkey")).alias("Name"), *[none.alias(x) for x in ("DescriptiveName", "Path", "ServiceType", "Mode", "ServiceStatus", "ServiceDLL", "FromPersistence")])
    registry = read("region").select(none.alias("Hive"), F.col("r_name").alias("KeyPath"), none.alias("TextValue"), none.alias("RegistryType"), at.alias("Modified"), none.alias("FromPersistence"))
    indicators = read("nation").select(F.when(F.col("n_regionkey") == 0, "").otherwise(text("e", F.col("n_regionkey"))).alias("AlertEventType"), F.col("n_nationkey").alias("IndicatorId"), at.alias("MatchTimestamp"))
    rows = normalize(R.memory_tables("M", F.lit("2024-05-02").cast("timestamp"), processes, hooks, services, registry, hits, indicators), "C1")
    return rows.groupBy("canonical_type", "pid", "process_name", "alert_name").agg(F.count(F.lit(1)).alias("n"))
