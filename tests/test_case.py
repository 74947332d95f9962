"""Coverage of evidence, readiness of a case, pages, and the tables of a memory image, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from casegraph.operators import coverage as K
from casegraph.operators.normalize import normalize
from casegraph.operators.pages import Pages
from casegraph.sources import records as R


def seconds(spans):
    return {x for a, b in spans if a is not None and b is not None for x in range(a, b + 1)}


def runs(points):
    out = []
    for x in sorted(points):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("slot", [10, 86400])
def test_union(spark, slot):
    rnd = random.Random(slot)
    rows = [(rnd.choice("ab"), s, s + rnd.choice([0, 1, 3, 9, 25, -2])) for s in (rnd.randrange(-60, 400) for _ in range(70))] + [("c", None, 4), ("c", 4, None)]
    got = sorted(map(tuple, K.union_of(spark.createDataFrame(rows, "k string, start long, end long"), ["k"], slot).select("k", "start", "end").collect()))
    assert got == sorted((k, *r) for k in "ab" for r in runs(seconds([x[1:] for x in rows if x[0] == k])))


def test_holes_and_blocking(spark):
    events = [("c", "h1", f"e{t}", t, "evtx") for t in [*range(0, 1000, 50), *range(2000, 3001, 50)]] + [("c", "h1", "p", 500, "pcap"), ("c", "h2", "x", 70, "evtx"), ("c", "h1", "n", 600, None)]
    df = spark.createDataFrame(events, "case_id string, host_name string, event_id string, epoch long, kind string")
    spans, want = K.evidence_spans(df, F.col("kind"), 60), K.expected_by_host(df, ["evtx", "pcap"])
    got = K.blocking(K.holes(spans, want, 60), spark.createDataFrame([("c", "h1", 1500, 1600), ("c", "h1", 2950, 2960), ("c", "h2", 0, 69)], "case_id string, host_name string, start_epoch long, end_epoch long"))
    assert sorted(map(tuple, got.select("host_name", "kind", "gap", "start", "end", "blocks_report").collect())) == [
        ("h1", "evtx", "hole", 950, 2000, True), ("h1", "pcap", "hole", 0, 500, False), ("h1", "pcap", "hole", 500, 3000, True), ("h2", "pcap", "missing", 70, 70, False),
    ]
    cover = {(r["host_name"], r["kind"]): (r["seconds"], round(r["share"], 3)) for r in K.covered(spans, want).collect()}
    assert cover == {("h1", "evtx"): (1950, 0.65), ("h1", "pcap"): (0, 0.0), ("h2", "evtx"): (0, 0.0), ("h2", "pcap"): (0, 0.0)}


def test_case_readiness(spark):
    h = [
        ("a", "1", "APPROVED", ["T1003"], None, True), ("a", "2", "APPROVED", [], "1", True), ("a", "3", "REJECTED", ["bad"], "1", False), ("a", "4", "APPROVED", ["T1", "x", "T2.y"], "3", None), ("b", "5", "APPROVED", ["T1"], "1", True),
        ("c", "6", "DRAFT", None, None, False), ("d", "7", "REJECTED", [], None, False),
    ]
    links = [("a", "1", "2"), ("a", "2", "1"), ("a", "2", "1"), ("a", "4", "4"), ("b", "5", "6"), ("c", "6", "5")]
    out = K.case_readiness(
        spark.createDataFrame(h, "case_id string, hypothesis_id string, status string, techniques array<string>, contradicted_by string, signed boolean"), spark.createDataFrame(links, "case_id string, source string, target string"),
        spark.createDataFrame([("b", False), ("d", True), ("e", False)], "case_id string, blocks_report boolean"), spark.createDataFrame([("d", "STRONG"), ("d", "WEAK"), ("a", "WEAK")], "case_id string, tier string"),
    )
    rows = {r["case_id"]: r.asDict() for r in out.collect()}
    assert {k: (v["drafts"], v["without_technique"], v["bad_techniques"], v["unsigned"], v["approved_contradicted"], v["opposed_links"], v["gaps_blocking"], v["unsurfaced"], v["ready"]) for k, v in rows.items()} == {
        "a": (0, 1, 2, 1, 1, 1, 0, None, False), "b": (0, 0, 0, 0, 0, 0, 0, None, True), "c": (1, 0, 0, 0, 0, 0, 0, "nothing", False), "d": (0, 0, 0, 0, 0, 0, 1, "clusters", False), "e": (0, 0, 0, 0, 0, 0, 0, "nothing", True),
    }


def test_pages(spark, tmp_path):
    rnd = random.Random(9)
    rows = sorted(((rnd.choice([None, *range(20)]), k) for k in range(500)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    p = Pages.build(spark.createDataFrame(rnd.sample(rows, 500), "at long, id long"), ["at", "id"], f"file://{tmp_path}/p", 7)
    page = lambda df: [tuple(r) for r in df.collect()]
    assert p.total == 500 and len(p.index) > 3
    assert [x for k in range(9) for x in page(p.page(60, k))] == rows and page(p.page(60, 9)) == [] and page(p.page(1000)) == rows
    again, got, key = Pages(spark, p.path, p.order), [], None
    while True:
        more = page(again.page(90)) if key is None else page(again.after(90, key))
        if not more:
            break
        got, key = got + more, more[-1]
    assert got == rows and page(p.after(3, (None, 10**6))) == [r for r in rows if r[0] is not None][:3]
    assert Pages.build(spark.createDataFrame([], "at long, id long"), ["at"], f"file://{tmp_path}/q").page(5).count() == 0


def test_memory_tables(spark):
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in schema.split()))
    processes = frame(
        "ID PID ParentPID Username Path ProcessName Arguments StartTime Hidden SID", ("1", "11", "4", "u", "C:\\d", "a.exe", "", "2024-05-01T10:00:00Z", None, "S"), ("2", "12", "4", "", None, "", '"C:\\p q\\b.exe" -k', "2024-05-01T10:00:01Z", "True", None),
        ("3", "13", "4", "", "", "c", "C:/x/c.exe -a \"b c\"", "bad", None, None), ("4", "14", "4", "", "C:\\e", None, "un\"closed x", "2024-05-01T10:00:02Z", None, None),
    )
    hits = frame("RuleID HitType ScoreModifier HitDescription ProcessID", ("r1", "t", "5", "d", "1"), ("r2", "t", "5", "d", "1"), (None, "t", "5", "d", "9"), ("r4", "t", "5", "d", None))
    hooks = frame("HookDescription HookedFunction HookedModule HookingModule HookingAddress", ("d", "f", "m", "n", "0x1"))
    services = frame("Name DescriptiveName Path ServiceType Mode ServiceStatus ServiceDLL FromPersistence", ("s", "S", "p", "t", "auto", "run", "x.dll", "1"))
    registry = frame("Hive KeyPath TextValue RegistryType Modified FromPersistence", ("HKLM", "k\\Run", "v", "SZ", "2024-05-01T10:00:03Z", None))
    indicators = frame("AlertEventType IndicatorId MatchTimestamp", ("", "i", "2024-05-01T10:00:04Z"))
    at = F.lit("2024-05-02T00:00:00Z").cast("timestamp")
    rows = R.memory_tables("m", at, processes, hooks, services, registry, hits, indicators).collect()
    of = lambda action: [r for r in rows if r["event_action"] == action]
    started = {r["pid"]: (r["process_name"], r["process_path"], r["command_line"], r["extra"]["hidden"]) for r in of("process-started")}
    assert started == {11: ("a.exe", "C:\\d\\a.exe", "C:\\d\\a.exe", "False"), 12: ("b.exe", "C:\\p q\\b.exe", '"C:\\p q\\b.exe" -k', "True"), 13: ("c", "C:/x/c.exe", 'C:/x/c.exe -a "b c"', "False"), 14: ('un"closed', 'un"closed', 'un"closed x', "False")}
    assert sorted((r["alert_name"], r["process_name"] or "") for r in of("malware-risk-index-hit")) == [("MRI Hit", ""), ("r1", "a.exe"), ("r2", "a.exe"), ("r4", "")]
    assert [(r["alert_name"], r["extra"]["address"], r["ts"].isoformat()[:10]) for r in of("api-hook-detected")] == [("API Hook Detected", "0x1", "2024-05-02")]
    assert [(r["registry_key"], r["extra"]["hive"]) for r in of("registry-modified")] == [("k\\Run", "HKLM")] and of("ioc-match")[0]["alert_name"] == "IOC Alert" and of("service-installed")[0]["extra"]["dll"] == "x.dll"
    kinds = {r["canonical_type"]: r["n"] for r in normalize(R.memory_tables("m", at, processes, hooks, services, registry, hits, indicators), "c").groupBy("canonical_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"PROCESS_EXECUTION": 3, "ALERT": 6, "SERVICE_INSTALLATION": 1, "REGISTRY_MODIFICATION": 1}  # one process has no time
    assert R.memory_tables("m", at, hits=hits).count() == 4
