from pyspark.sql import functions as F

from casegraph.functions import exprs as X, lookups as L, paths as P
from casegraph.operators import judge
from casegraph.operators.normalize import normalize
from casegraph.sources import records as R


def frame(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"`{c}` string" for c in columns))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def ms(row):
    return None if row["ts"] is None else int(row["ts"].timestamp() * 1000)


def test_repeated_names(spark):
    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == "EXCEPTION"
    xml = '<Event><System><EventID>4688</EventID><TimeCreated SystemTime="2024-05-01T10:00:00Z"/><Computer>H</Computer></System><EventData><Data Name="CommandLine">a</Data><Data Name="CommandLine">b</Data><Data>bare</Data></EventData></Event>'
    assert one(R.event_xml(frame(spark, xml=xml)))["command_line"] == "b"
    r = one(R.event_xml(frame(spark, xml=xml)))
    assert (r["event_action"], r["event_category"]) == ("process-created", "process")
    row = spark.range(1).select(F.create_map(*[F.lit(x) for x in ("PID", "1", "pid", "7", "Name", "x")]).alias("row"))
    assert one(R.memory(row, "pslist", "h"))["pid"] == 7


def test_small_readers(spark):
    r = one(R.event_jsonl(frame(spark, Computer="H", TimeCreated="2024-05-01T10:00:00Z", EventId="4624", Channel="S", Provider="p", MapDescription="d", UserName="u", **{f"PayloadData{k}": f"p{k}" for k in range(1, 7)})))
    assert (r["host_name"], r["event_code"], r["user"], r["message"], ms(r)) == ("H", "4624", "u", "p1 p2 p3 p4 p5 p6", 1714557600000)
    r = one(R.amcache_csv(frame(spark, FullPath=r"C:\a\b.exe", SHA1="s", FileKeyLastWriteTimestamp="2024-05-01 10:00:00Z", Publisher="", FileVersion="1", LinkDate="", IsPeFile="True"), "h"))
    assert (r["process_name"], r["extra"]) == ("b.exe", {"sha1": "s", "version": "1", "is_pe": "True"})
    assert R.amcache_csv(frame(spark, FullPath="", SHA1="", FileKeyLastWriteTimestamp="", Publisher="", FileVersion="", LinkDate="", IsPeFile=""), "h").count() == 0
    for columns in ({"Path": r"C:\x.exe", "LastModifiedTimeUTC": "05/01/24 10:00:00", "Executed": "Yes"}, {"Path": r"C:\x.exe", "Last Modified": "2024-05-01 10:00:00Z", "Exec Flag": "Yes"}):
        r = one(R.shimcache_csv(frame(spark, **columns), "h"))
        assert (r["process_name"], r["extra"]["executed"], ms(r)) == ("x.exe", "Yes", 1714557600000)
    r = one(R.srum_csv(frame(spark, Timestamp="bad", ExeInfo=r"\d\y.exe", BytesSent="12", BytesRecvd="x", ForegroundCycleTime="", ProfileName="w"), "h"))
    assert (r["process_name"], r["extra"], r["ts"]) == ("y.exe", {"sent": "12", "profile": "w"}, None)
    lines = spark.createDataFrame([("RULE [ns] /a/b c:77",), ("noise",)], "value string")
    assert (one(R.scan_text(lines, "h"))["alert_name"], one(R.scan_text(lines, "h"))["target_file"]) == ("RULE", "/a/b c")
    r = one(R.timeline_json(frame(spark, timestamp="1714557600000000", message="x", data_type="d", computer_name="C", event_identifier="4624", key_path="", filename="f")))
    assert (r["extra"]["canonical_type"], r["event_code"], ms(r)) == ("ALERT", "4624", 1714557600000)
    r = one(R.timeline_json(frame(spark, filetime="133590312000000000", timestamp="0", message="", data_type="d", computer_name="C", event_identifier="", key_path="k", filename="")))
    assert ms(r) == 1714557600000 and r["registry_key"] == "k"
    assert one(R.carved(frame(spark, Type="url", Offset="5", Hit="http://x"), "h"))["message"] == "http://x"
    beacon = spark.createDataFrame([(["a.b"], [443], "9")], "domains array<string>, ports array<int>, watermark string")
    assert one(R.beacon_config(beacon, "h"))["alert_name"] == "cobalt strike beacon config"


def test_files(spark, tmp_path):
    (tmp_path / "list").write_text("# comment\nD41D8CD98F00B204E9800998ECF8427E\nshort\n\n")
    assert [r["md5"] for r in R.hash_list(spark, f"{tmp_path}/list").collect()] == ["d41d8cd98f00b204e9800998ecf8427e"]
    listed = R.file_listing(spark, f"{tmp_path}/list", "h")
    assert one(listed)["extra"]["size"] == str((tmp_path / "list").stat().st_size)
    assert R.not_yet_ingested(listed, listed).count() == 0
    rows = R.carved(spark.createDataFrame([("url", "5", "a"), ("url", "5", "a"), ("url", "6", "b")], "Type string, Offset string, Hit string"), "h")
    for _ in range(2):  # a second run adds nothing
        R.write_ecs(rows, f"{tmp_path}/ecs")
    assert spark.read.parquet(f"{tmp_path}/ecs").count() == 2


def test_judgement(spark):
    said = spark.createDataFrame([("It SPAWNED a shell",), ("seen near it",), ("moved laterally then",), (None,)], "t string")
    assert [r[0] for r in said.select(X.claims_cause(F.col("t"))).collect()] == [True, False, True, False]
    ids = [(["tool-a-1", "ingest-2"], "HOOK"), (["tool-a-1"], "MCP"), (["auto-seed-1", "cli-9"], "SHELL"), (["tool-a", "what"], "NONE"), ([], "NONE"), (None, "NONE"), (["tool-a", ""], "NONE")]
    got = spark.createDataFrame([(a, b) for a, b in ids], "ids array<string>, want string").select(X.weakest(F.col("ids")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    base = {"provenance": "MCP", "causal_level": "CHAIN", "cluster_strength": "STRONG", "domain_count": 3}
    rich = base | {"host_count": 50, "artifacts": ["sigma"], "intel_sources": ["x"], "anti_forensic_observed": True, "memory_available": True, "network_available": True, "corroborating_hosts": 2, "sigma_critical": True, "intel_match": True, "anti_forensic_clear": True, "memory_corroboration": True, "network_corroboration": True}
    cases = [(base, 100, 4), (rich, 100, 10), (base | {"near_disturbance": True}, 85, 4), (base | {"contradicted": True, "near_disturbance": True}, 65, 4), (base | {"provenance": "SHELL", "causal_level": "TEMPORAL_ONLY", "cluster_strength": "NOISE", "domain_count": 1}, 20, 4), (base | {"cluster_strength": None}, 100, 3), (base | {"host_count": 2}, 88, 5)]
    for given, score, applicable in cases:
        kinds = {str: "string", int: "int", bool: "boolean", list: "array<string>", type(None): "string"}
        df = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in given.items()))
        r = one(judge.confidence(df))
        assert (r["score"], len(r["applicable"])) == (score, applicable), given


def test_one_parse(spark):
    """A record is parsed once, whatever is taken out of it."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    xml = plan(normalize(R.event_xml(spark.createDataFrame([("<a/>",)], "xml string")), "C"))
    csv = plan(normalize(R.event_csv(frame(spark, Computer="", TimeCreated="", EventId="", Channel="", Provider="", MapDescription="", UserName="", ExecutableInfo="", Payload="")), "C"))
    assert xml.count("from_xml") == 1 and csv.count("from_json") == 1


def test_many_names(spark):
    """Names of one record, all alike or all different, in time that does not grow with their square."""
    import time

    data = "".join(f'<Data Name="n{k % 9000}">{k}</Data>' for k in range(20_000))
    began = time.time()
    r = one(spark.createDataFrame([(data,)], "x string").select(X.xml_fields(F.col("x")).alias("m")))
    assert r["m"]["n0"] == "18000" and r["m"]["n1999"] == "19999" and len(r["m"]) == 9000 and time.time() - began < 20


def timeline(spark, **columns):
    base = {"date": "05/01/2024", "time": "10:00:00", "host": "WKS-1.corp.local", "user": "", "sourcetype": "WinEVTX", "source": "EVT", "short": "", "desc": "", "filename": "", "extra": ""}
    return frame(spark, **(base | columns))


def test_timeline_rows(spark):
    data = lambda **kv: "".join(f'<Data Name="{k}">{v}</Data>' for k, v in kv.items())
    event = lambda code, **kv: f"<EventID Qualifiers='0'>{code}</EventID>" + data(**kv)
    get = lambda **c: one(normalize(R.timeline_csv(timeline(spark, **c)), "C"))
    r = get(extra=event(4768, TargetUserName="admin", IpAddress="10.0.0.9"), user="SYSTEM")
    assert (r["canonical_type"], r["user"], r["remote_ip"], r["host_name"]) == ("AUTHENTICATION", "admin", "10.0.0.9", "WKS-1")
    r = get(extra=event(1000, ProcessCommandLine="x" * 3000, ProcessName=r"C:\a\b.exe") + ' ProcessID="77" UserID="S-1-5"', user="-")
    assert (r["canonical_type"], len(r["command_line"]), r["process_name"], r["pid"], r["user"]) == ("PROCESS_EXECUTION", 2048, "b.exe", 77, "S-1-5")
    assert get(extra=event(4624, TargetUserName="t", IpAddress="127.0.0.1"), user="named")["user"] == "named"
    assert get(extra=event(4624, IpAddress="-"))["remote_ip"] is None and get(extra=event(4624, IpAddress="::1"))["remote_ip"] is None
    assert get(extra='<EventID>1102</EventID>')["canonical_type"] == "LOG_CLEARED" and get(extra="<EventID>7036</EventID>")["canonical_type"] == "SERVICE_INSTALLATION"
    assert get(extra="<data name=\"x\">1</data><EventID>4624</EventID><DATA  Name=\"LogonType\" > 3 </DATA>")["logon_type"] == "3"
    r = get(sourcetype="WinPrefetch", filename=r"TSK:/Windows/Prefetch/CMD.EXE-1.pf", extra=data(CommandLine="never"))
    assert (r["canonical_type"], r["process_name"], r["process_path"], r["command_line"]) == ("PROCESS_EXECUTION", "CMD.EXE-1.pf", "/Windows/Prefetch/CMD.EXE-1.pf", None)
    kinds = {"File entry shell item": "FILE_MODIFICATION", "MSIE Cache File URL record": "NETWORK_CONNECTION", "Firefox History": "NETWORK_CONNECTION", "Firefox Cache": "NETWORK_CONNECTION", "File stat": "FILE_MODIFICATION", "NTFS USN change": "FILE_MODIFICATION", "AppCompatCache Registry Entry": "PROCESS_EXECUTION"}
    for source, kind in kinds.items():
        assert get(sourcetype=source, filename="/a/b.exe")["canonical_type"] == kind
    assert normalize(R.timeline_csv(timeline(spark, sourcetype="other", filename="/a/b.xyz")), "C").count() == 0
    assert get(sourcetype="other", filename="/a/b.lnk")["canonical_type"] == "FILE_CREATION"
    assert normalize(R.timeline_csv(timeline(spark, date="", extra=event(4624))), "C").count() == 0
    named = lambda **c: one(R.timeline_csv(timeline(spark), **c))["host_name"]
    assert (named(), named(aliases={"WKS-1": "anna"}), named(aliases={"other": "x"}, host="dflt")) == ("WKS-1", "anna", "dflt")


def test_timeline_objects(spark):
    def get(message="", **c):
        return one(normalize(R.timeline_json(frame(spark, **({"timestamp": "1714557600000000", "data_type": "windows:evtx:record", "computer_name": "C", "message": message} | c))), "K"))

    r = get("[4624] Strings: ['S-1', 'sub', 'D', '0x1', 'S-2', 'it\\'s, me', 'DOM', '0x2', '3', None, 'x', 'WS', None, '-', '', '0', '0x3', 'C:\\\\p.exe', '10.1.1.1', '99'] Computer Name: C", event_identifier="4624")
    assert (r["canonical_type"], r["user"], r["logon_type"], r["remote_ip"]) == ("AUTHENTICATION", "it\\'s, me", "3", "10.1.1.1")
    r = get("Strings: ['S', 'who', 'D', 'L', '0x1', 'C:\\new.exe', 'T', '0x2', 'cmd /c a, b', None, None]", event_identifier="4688")
    assert (r["canonical_type"], r["process_name"], r["command_line"], r["user"]) == ("PROCESS_EXECUTION", "C:\\new.exe", "cmd /c a, b", "who")
    r = get("Strings: ['svc', 'C:\\s.exe', 'x', 'auto', 'acct'] Record Number: 7", event_identifier="7045")
    assert (r["canonical_type"], r["process_path"], r["user"], r["event_data"]["service_name"]) == ("SERVICE_INSTALLATION", "C:\\s.exe", "acct", "svc")
    assert get("IpAddress: 10.9.9.9; TargetUserName=zoe", event_identifier="4625")["user"] == "zoe" and get("no strings", event_identifier="9999")["canonical_type"] == "PROCESS_EXECUTION"
    assert get(event_identifier="4769")["canonical_type"] == "TICKET_REQUEST" and get(event_identifier="4656")["canonical_type"] == "LSASS_ACCESS"
    kinds = {"windows:prefetch:execution": "PROCESS_EXECUTION", "windows:lnk:link": "FILE_CREATION", "windows:tasks:job": "SCHEDULED_TASK", "msiecf:url": "NETWORK_CONNECTION", "fs:stat": "FILE_MODIFICATION", "windows:registry:run": "REGISTRY_MODIFICATION", "never:heard": "ALERT"}
    for kind, want in kinds.items():
        assert get(data_type=kind)["canonical_type"] == want
    assert normalize(R.timeline_json(frame(spark, timestamp="5", data_type="", message="", computer_name="C")), "K").count() == 0
    nested = spark.createDataFrame([("event", (133590312000000000,), 1, "fs:stat", "/f"), ("report", (133590312000000000,), 1, "fs:stat", "/g"), ("event", (0,), 0, "fs:stat", "/h")], "`__container_type__` string, date_time struct<timestamp:long>, timestamp long, data_type string, filename string")
    r = one(normalize(R.timeline_json(nested, "h1"), "K"))
    assert (r["host_name"], r["target_file"], int(r["timestamp"].timestamp())) == ("h1", "/f", 1714557600)


def test_host_of_path(spark):
    want = {
        "DC01/C/Windows/System32/winevt/Logs/Security.evtx": "dc01", "kape/srv_02/filesystem/x": "srv-02", "windows/anna7/registry/SAM": "anna7", "10.0.0.5/c/x": "10-0-0-5", "a/10.0.0.5/x": "10.0.0.5", "finance1/file": "finance1", "evidence/afd4ed01/x": "root-case",
        "win10-32-maria-10.3.58.5_unpacked/c/x": "maria", "x64-10-3-58-5/c/x": "x64", "32_10-3-58-5/c/x": "10.3.58.5", "c/x64-300.1.1.1-10.1.1.2/x": "root-case", "jspgsxnm1/x": "jspgsxnm1", "c/d/e": "root-case", "": "root-case", "Häuser/x.txt": "h-user", "PC": "pc", "ab/c": "ab", "windows\\WS-7\\c\\f": "ws-7",
    }
    want["10.0.0.5/c/x"] = "10.0.0.5"
    rows = spark.createDataFrame(list(want), "string").select("value", P.host_of_path(F.col("value"), F.lit("Root Case"), ("unpacked",)).alias("h")).collect()
    assert {r["value"]: r["h"] for r in rows} == want
    assert [r[0] for r in spark.range(1).select(P.host_of_path(F.lit("DC01/c/x"), F.lit("r"), given=F.lit(" My Host "))).collect()] == ["my-host"]


def test_json_hash_gate_triage(spark):
    import hashlib
    import json

    texts = ["plain", 'q"b\\s', "tab\tnew\nline\r\b\f\x01\x7f", "é ü \u2028", "😀x", ""]
    for t in texts:
        ids = ["T2", "T1.002", "é"]
        body = json.dumps({"title": t, "observation": t + "o", "interpretation": "i" + t, "technique_ids": ids}, sort_keys=True)
        df = spark.createDataFrame([(t, t + "o", "i" + t, ids)], "t string, o string, i string, k array<string>")
        assert one(df.select(X.content_hash(*[F.col(c) for c in "toik"]).alias("h")))["h"] == hashlib.sha256(body.encode()).hexdigest()[:32]
    empty = json.dumps({"title": "", "observation": "", "interpretation": "", "technique_ids": []}, sort_keys=True)
    assert one(spark.range(1).select(X.content_hash(*[F.lit(None).cast("string")] * 3, F.lit(None).cast("array<string>")).alias("h")))["h"] == hashlib.sha256(empty.encode()).hexdigest()[:32]

    gated = spark.createDataFrame([(t, ["tool-a-1"], 90, ["TEMPORAL_ONLY"], False) for t in ("Because of it", "due to x", "it spawned y", "executed via z", "led to")], "interpretation string, audit_ids array<string>, score int, levels array<string>, near_disturbance boolean")
    assert [r["status"] for r in judge.gate(gated).collect()] == ["DRAFT", "DRAFT", "APPROVED", "APPROVED", "DRAFT"]

    from casegraph.operators.lists import is_audit_id

    good = ["a-b-20240501-001", "tool-x2-ann-lee-20240501-1234", "t9-0-00000000-000"]
    bad = ["A-b-20240501-001", "a_b-c-20240501-001", "a-b-20240501-01", "9a-b-20240501-001", "a-20240501-001", "a-b_c-20240501-001"]
    assert [r[0] for r in spark.createDataFrame(good + bad, "string").select(is_audit_id(F.col("value"))).collect()] == [True] * 3 + [False] * 6

    triage = {
        r"C:\Windows\System32\a.exe": False, r"C:\Windows\System32\Temp\a.exe": True, r"C:\Windows\System32\a.ps1": True, r"C:\Program Files\x\a.dll": True, r"C:\Program Files\x\a.exe": False, r"C:\Windows\WinSxS\a.dll": False,
        r"C:\Windows\Fonts\a.ttf": False, r"D:\x\a.ttf": True, r"D:\x\read.md": False, r"D:\x\a.docx": True, r"D:\PerfLogs\a.inf": True, r"C:\Windows\Fonts\a.dll": True, r"C:\Windows\System32\winevt\Security.evtx": True, r"D:\tmp\a.txt": False,
    }
    assert {r["value"]: r["w"] for r in spark.createDataFrame(list(triage), "string").select("value", X.wanted(F.col("value")).alias("w")).collect()} == triage
    assert {t for t in L.TYPES} >= {"PROCESS_TERMINATION", "SHADOW_DELETED", "DEFENDER_EXCLUSION_ADDED"} and len(L.TYPES) == 17
