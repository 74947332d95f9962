"""The driver tables as canonical events: the generated event stream stands for a case's records at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(k, *values: str):
    """values[k % len(values)]"""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


COMMANDS = [
    ("psexec.exe", "cmd.exe", "psexec.exe //srv02 cmd"), ("powershell.exe", "explorer.exe", "powershell -enc SQBFAFgA"), ("vssadmin.exe", "cmd.exe", "vssadmin delete shadows /all"), ("schtasks.exe", "cmd.exe", "schtasks /create /tn upd"),
    ("wmic.exe", "cmd.exe", "wmic /node:srv03 process list"), ("cmd.exe", "winword.exe", "cmd /c whoami"), ("notepad.exe", "explorer.exe", "notepad readme"), ("svchost.exe", "services.exe", "svchost -k netsvcs"), ("chrome.exe", "explorer.exe", "chrome --tab"), ("rclone.exe", "cmd.exe", "rclone copy data remote:x"),
]
ALERTS = ["mimikatz credential", "dns tunnel", "log cleared security", "initial access", "shadow copy delete", "unsigned binary", "lateral movement smb", "benign notice"]
FILES = ["C:/users/a/start menu/programs/startup/u.lnk", "C:/temp/data.zip", "//srv/C$/drop.exe", "C:/data/x.locked", "C:/users/a/appdata/z.dll", "C:/work/notes.md"]
KEYS = ["HKLM/software/microsoft/windows/currentversion/run/upd", "HKLM/software/microsoft/windows defender/disable", "HKLM/software/vendor/a", "HKCU/console/b"]
PORTS = [22, 443, 445, 5985, 8443, 12000]


def canonical(events: DataFrame) -> DataFrame:
    """events (event_id, ts, user_id, event_type, value, props) as canonical events."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    t, e = F.col("event_type"), F.col("event_id")
    view = pick(k, "FILE_CREATION", "REGISTRY_MODIFICATION", "NETWORK_CONNECTION")
    kind = F.when(t == "error", "ALERT").when(t == "click", "PROCESS_EXECUTION").when(t == "view", view).when(t == "signup", pick(k, "SERVICE_INSTALLATION", "SCHEDULED_TASK")).otherwise("AUTHENTICATION")
    rows = events.withColumn("k", k).withColumn("canonical_type", kind)
    c, is_ = F.col("k"), lambda x: F.col("canonical_type") == x
    return rows.select(
        F.concat(F.lit("ev-"), e.cast("string")).alias("event_id"), F.lit("CASE-1").alias("case_id"), F.concat(F.lit("host-"), (F.col("user_id") % 3).cast("string")).alias("host_name"), F.col("ts").cast("timestamp").alias("timestamp"), "canonical_type",
        F.lit("events").alias("source_index"), e.cast("string").alias("source_doc_id"), F.when(F.col("user_id") % 25 == 0, "corp-admin").otherwise(F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("user"),
        F.when(is_("PROCESS_EXECUTION"), pick(c, *[x[0] for x in COMMANDS])).alias("process_name"), F.lit(None).cast("string").alias("process_path"), (e % 500).alias("pid"), (F.floor(e / 7) % 500).alias("ppid"),
        F.when(is_("PROCESS_EXECUTION"), pick(c, *[x[2] for x in COMMANDS])).alias("command_line"), F.when(is_("FILE_CREATION"), pick(c, *FILES)).alias("target_file"),
        F.when(is_("NETWORK_CONNECTION"), F.concat(F.when(c % 2 == 0, "10.0.0.").otherwise("203.0.113."), c.cast("string"))).alias("remote_ip"), F.when(is_("NETWORK_CONNECTION"), F.element_at(F.array(*[F.lit(p) for p in PORTS]), (c % 6 + 1).cast("int"))).alias("remote_port"),
        F.when(is_("REGISTRY_MODIFICATION"), pick(c, *KEYS)).alias("registry_key"), F.when(is_("ALERT"), pick(c, *ALERTS)).alias("alert_name"), F.when(is_("ALERT"), "high").alias("alert_level"), F.when(is_("AUTHENTICATION"), pick(c, "3", "10", "2")).alias("logon_type"),
        F.when(is_("PROCESS_EXECUTION"), pick(c, *[x[1] for x in COMMANDS])).alias("parent_name"), F.col("value"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(read(spark, sf_dir, "events"))


def _list(values) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


def _pick(*values) -> str:
    return f"{_list(values)}[k % {len(values)} + 1]"


#: The same rows in DuckDB's SQL, as a common table expression named ev.
EV = f"""ev AS (
SELECT 'ev-' || event_id AS event_id, 'CASE-1' AS case_id, 'host-' || (user_id % 3) AS host_name, ts AS timestamp, kind AS canonical_type, CASE WHEN user_id % 25 = 0 THEN 'corp-admin' ELSE 'user-' || user_id END AS "user",
  CASE WHEN kind = 'PROCESS_EXECUTION' THEN {_pick(*[x[0] for x in COMMANDS])} END AS process_name, event_id % 500 AS pid, (event_id // 7) % 500 AS ppid, CASE WHEN kind = 'PROCESS_EXECUTION' THEN {_pick(*[x[2] for x in COMMANDS])} END AS command_line,
  CASE WHEN kind = 'FILE_CREATION' THEN {_pick(*FILES)} END AS target_file, CASE WHEN kind = 'NETWORK_CONNECTION' THEN (CASE WHEN k % 2 = 0 THEN '10.0.0.' ELSE '203.0.113.' END) || k END AS remote_ip,
  CASE WHEN kind = 'NETWORK_CONNECTION' THEN {_pick(*PORTS)} END AS remote_port, CASE WHEN kind = 'REGISTRY_MODIFICATION' THEN {_pick(*KEYS)} END AS registry_key, CASE WHEN kind = 'ALERT' THEN {_pick(*ALERTS)} END AS alert_name,
  CASE WHEN kind = 'AUTHENTICATION' THEN {_pick('3', '10', '2')} END AS logon_type, CASE WHEN kind = 'PROCESS_EXECUTION' THEN {_pick(*[x[1] for x in COMMANDS])} END AS parent_name, value, floor(epoch(ts))::BIGINT AS epoch
FROM (SELECT *, CASE event_type WHEN 'error' THEN 'ALERT' WHEN 'click' THEN 'PROCESS_EXECUTION' WHEN 'view' THEN {_pick('FILE_CREATION', 'REGISTRY_MODIFICATION', 'NETWORK_CONNECTION')} WHEN 'signup' THEN {_pick('SERVICE_INSTALLATION', 'SCHEDULED_TASK')} ELSE 'AUTHENTICATION' END AS kind
  FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)))"""
#: The columns that rules read, as ru.
RU = EV + """,
ru AS (SELECT *, canonical_type AS kind, lower(coalesce(alert_name, '')) AS alert, lower(coalesce(command_line, '')) AS cmd, lower(coalesce(process_name, '')) AS proc, '' AS ppath, lower(coalesce(target_file, '')) AS tfile,
  regexp_extract(lower(coalesce(target_file, '')), '([^/]*)$', 1) AS fname, lower(coalesce(registry_key, '')) AS rkey, coalesce(remote_ip, '') AS ip, coalesce(remote_port, 0) AS port, lower("user") AS usr, coalesce(logon_type, '') AS logon,
  lower(coalesce(parent_name, '')) AS parent, '' AS plugin, '1' AS private_memory, '' AS vol_ppid, '' AS vol_parent, CASE WHEN canonical_type = 'FILE_CREATION' THEN lower(coalesce(target_file, '')) ELSE '' END AS dll, '' AS ticket_cipher,
  hour(timestamp) AS hour, minute(timestamp) AS minute FROM ev)"""
