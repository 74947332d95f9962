import os
from dataclasses import replace

from pyspark.sql import functions as F

from casegraph.functions import exprs as X
from casegraph.operators import detect, judge
from casegraph.operators.cluster import build_clusters, group_hits, trigger_hits
from casegraph.operators.rules import BY_NAME, FAMILIES, Trigger
from casegraph.sources import driver, records

EVENT = "event_id string, case_id string, host_name string, timestamp timestamp, canonical_type string, user string, process_name string, process_path string, command_line string, target_file string, remote_ip string, remote_port int, registry_key string, alert_name string, logon_type string, parent_name string"


def event(spark, **f):
    base = {"event_id": "e1", "case_id": "c", "host_name": "h", "user": "u"} | f
    names = [x.strip().split(" ")[0] for x in EVENT.split(",")]
    return spark.createDataFrame([tuple(base.get(n) for n in names)], EVENT.replace("timestamp timestamp", "timestamp string")).withColumn("timestamp", F.lit("2024-05-01 10:00:07").cast("timestamp"))


def fired(df, family):
    return {(r["trigger"], r["base"]) for r in trigger_hits(df, (BY_NAME[family],)).collect()}


def test_rules(spark):
    assert fired(event(spark, canonical_type="PROCESS_EXECUTION", command_line=r"reg save hklm\sam C:\s"), "CredentialAccess") == {("sam_hive_copy", 45)}
    shell = event(spark, canonical_type="PROCESS_EXECUTION", process_name="cmd.exe", parent_name="WINWORD.EXE", command_line="cmd")
    assert fired(shell, "RemoteExecution") == {("office_spawning_shell", 45)} and fired(shell, "SuspiciousLineage") == {("office_spawned_interpreter", 65)}
    assert fired(event(spark, canonical_type="FILE_CREATION", target_file=r"\\DC01\C$\Windows\temp\m.exe"), "LateralMovement") == {("smb_admin_share_write", 35)}


def test_buckets(spark):
    e = event(spark, canonical_type="AUTHENTICATION", logon_type="10")
    r = group_hits(trigger_hits(e, (BY_NAME["LateralMovement"],))).first()
    assert r["bucket"] % 1800 == 0 and r["n_members"] == 1 and r["first_trigger"] == "rdp_logon"


def test_scores(spark):
    df = spark.createDataFrame([(30, 22, 0), (30, 12, 10), (90, 50, 0), (10, 0, 30)], "b int, s int, c int")
    assert [r[0] for r in df.select(X.cluster_score(F.col("b"), F.col("s"), F.col("c"))).collect()] == [52, 32, 100, 0]
    t = spark.createDataFrame([(30,), (31,), (50,), (51,), (75,), (76,)], "s int").select(X.confidence_tier(F.col("s")))
    assert [r[0] for r in t.collect()] == ["SPECULATIVE", "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH"]


def test_event_xml(spark):
    good = '<Event><System><Provider Name="p"/><EventID>4624</EventID><TimeCreated SystemTime="2024-05-01T10:00:00.1234567Z"/><Computer>H</Computer><Channel>Security</Channel></System><EventData><Data Name="LogonType">3</Data><Data Name="IpAddress">-</Data><Data Name="TargetUserName">admin</Data></EventData></Event>'
    out = records.event_xml(spark.createDataFrame([(good,), ("<Event><Sys",)], "xml string")).collect()
    assert len(out) == 1 and out[0]["user"] == "admin" and out[0]["remote_ip"] is None and out[0]["extra"]["LogonType"] == "3"


def test_jitter_and_fold(spark):
    even = spark.range(20).select(F.lit("h").alias("host"), (F.col("id") * 60).alias("epoch"), F.col("id").alias("event_id"))
    assert detect.beacon_jitter(even, ["host"]).first()["jitter"] == 0
    d = spark.createDataFrame([("a", "draft", None, 1, 1), ("a", "reject", None, 2, 2), ("a", "approve", None, 3, 3), ("b", "approve", "L", 1, 4)], "hypothesis_id string, action string, link string, decided_at int, seq int")
    assert {r["hypothesis_id"]: r["status"] for r in judge.fold(d).collect()} == {"a": "REJECTED", "b": "APPROVED"}


def test_lineage_is_by_user(spark):
    """Clusters of suspicious lineage are of a host and user, others of a host."""
    rows = [(f"e{k}", "c", "h", u, "2024-05-01T10:00:00Z", "PROCESS_EXECUTION", "powershell.exe", "winword.exe") for k, u in enumerate(["ann", "ben", "ann", None])]
    e = spark.createDataFrame(rows, "event_id string, case_id string, host_name string, user string, timestamp string, canonical_type string, process_name string, parent_name string").withColumn("timestamp", F.to_timestamp("timestamp"))
    for name, kind in (("process_path", "string"), ("command_line", "string"), ("target_file", "string"), ("remote_ip", "string"), ("remote_port", "int"), ("registry_key", "string"), ("alert_name", "string"), ("pid", "long"), ("ppid", "long")):
        e = e.withColumn(name, F.lit(None).cast(kind))
    got = group_hits(trigger_hits(e, (BY_NAME["SuspiciousLineage"], BY_NAME["RemoteExecution"]))).collect()
    assert sorted((r["constructor"], r["who"] or "", r["n_members"]) for r in got) == [("RemoteExecution", "", 4), ("SuspiciousLineage", "", 1), ("SuspiciousLineage", "ann", 2), ("SuspiciousLineage", "ben", 1)]
    assert len({r["cluster_id"] for r in got}) == 4


def test_clusters_save_only_columns_that_rules_read(spark):
    """A long column that no rule names is not written with the events; one that a family of the caller's names is."""
    base = spark.conf.get("spark.checkpoint.dir")
    events = driver.events(spark, "/root/testdata/sf0.001").withColumns({"raw": F.repeat(F.col("event_id"), 40), "zone": F.lit("dmz")})
    own = replace(BY_NAME["LateralMovement"], triggers=(Trigger("in_zone", 10, "zone = 'dmz' AND kind = 'ALERT'"),))
    for families, more in ((FAMILIES, set()), ((own,), {"zone"})):
        before = set(os.listdir(base))
        found = build_clusters(events, families).count()
        saved = {c for f in set(os.listdir(base)) - before for c in spark.read.parquet(f"{base}/{f}").columns}
        assert found and "event_id" in saved and saved & {"raw", "zone", "source_doc_id", "command_line"} == more
