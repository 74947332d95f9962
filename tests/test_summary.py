"""Assessments, gaps of gates and the state of a resumed case, on ties, nulls, missing cases and empty tables."""

from pyspark.sql import functions as F

from casegraph.operators import judge as J, summary as S, views as V

CLUSTER = "case_id string, cluster_id string, constructor string, host_name string, score int, tier string"


def clusters(spark, rows):
    return spark.createDataFrame([(c, f"k{n}", kind, "h", score, "STRONG" if score >= 70 else "MODERATE") for n, (c, kind, score) in enumerate(rows)], CLUSTER)


def test_assessment(spark):
    cases = {
        "impact": [("Impact", 40), ("LateralMovement", 90)], "both": [("LateralMovement", 50), ("Beaconing", 41)], "lateral": [("LateralMovement", 50), ("Beaconing", 39)], "c2": [("Beaconing", 60), ("Persistence", 60)],
        "foothold": [("Persistence", 77)], "none": [("Impact", 39)], "other": [("Exfiltration", 99)], "eleventh": [("Collection", 80)] * 10 + [("Impact", 79)],
    }
    df = clusters(spark, [(c, kind, score) for c, rows in cases.items() for kind, score in rows])
    got = {r["case_id"]: (r["assessment"], r["listed"]) for r in S.assessment(df).collect()}
    text = [t for _, t in S.ASSESSMENTS]
    assert got == {"impact": (text[0], 2), "both": (text[1], 2), "lateral": (text[2], 1), "c2": (text[3], 2), "foothold": (text[4], 1), "none": (S.NOTHING, 0), "other": (S.NOTHING, 1), "eleventh": (S.NOTHING, 10)}
    top = S.findings(df).where("case_id = 'eleventh'").orderBy("rank").collect()
    assert [r["rank"] for r in top] == list(range(1, 11)) and [r["cluster_id"] for r in top] == sorted(r["cluster_id"] for r in top)
    assert S.assessment(df.limit(0)).count() == 0 and S.findings(df.limit(0)).count() == 0


def test_ranks_are_cut_before_the_shuffle(spark):
    plan = S.findings(clusters(spark, [("c", "Impact", 50)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2, plan


def test_gap_rows(spark):
    rows = [("a", ["tool-1"], 30), ("b", ["tool-1"], 31), ("c", ["x"], 90), ("d", None, 90), ("e", ["tool-1"], 80)]
    h = spark.createDataFrame([("case", *r) for r in rows], "case_id string, hypothesis_id string, audit_ids array<string>, score int").withColumns({"interpretation": F.lit("seen"), "levels": F.array(F.lit("WRITE")), "near_disturbance": F.lit(False), "staged_at": F.lit("2024-05-01").cast("timestamp")})
    got = {r["blocks_hypothesis"]: (r["gap_id"], r["question"]) for r in S.gap_rows(J.gate(h)).collect()}
    none = "no audit id tells where the evidence comes from"
    assert got == {"a": ("GAP-a", "confidence 30 is below 31"), "c": ("GAP-c", none), "d": ("GAP-d", none)}


JOURNAL = "entry_id string, case_id string, entry_type string, at string, summary string, details string"
HYPOTHESES = "hypothesis_id string, case_id string, status string, approved_at string"
GAPS = "gap_id string, case_id string, registered_at string, resolved_at string"


def test_resume(spark):
    entries = [
        ("1", "c", "SESSION_START", "2024-05-01 08:00:00", "s", None), ("2", "c", "SESSION_END", "2024-05-01 09:00:00", "first", '{"next_steps": ["x"]}'), ("3", "c", "CHECKPOINT_SUMMARY", "2024-05-01 10:00:00", "tie", "[1, 2]"), ("4", "c", "SESSION_END", "2024-05-01 10:00:00", "last", '{"next_steps": ["y", "z"]}'),
        ("5", "c", "NOTE", "2024-05-02 00:00:00", None, "{"), ("6", "bare", "SESSION_START", "2024-05-01 00:00:00", "", ""), ("7", None, "NOTE", "2024-05-01 00:00:00", "", ""), ("8", "odd", "SESSION_END", "2024-05-01 00:00:00", "odd", "{"),
    ]
    times = lambda df, *cs: df.withColumns({c: F.col(c).cast("timestamp") for c in cs})
    j = times(spark.createDataFrame(entries, JOURNAL), "at")
    h = times(spark.createDataFrame([(f"h{k:02d}", "c", "APPROVED", f"2024-05-{1 + k // 2:02d}") for k in range(8)] + [("x", "c", "REJECTED", None), ("y", "new", "DRAFT", None), ("z", "c", None, None)], HYPOTHESES), "approved_at")
    g = times(spark.createDataFrame([("g1", "c", "2024-05-01", None), ("g2", "c", "2024-05-02", "2024-05-03"), ("g3", "new", None, None)], GAPS), "registered_at", "resolved_at")
    c = clusters(spark, [("c", "Impact", 90), ("c", "Impact", 50), ("solo", "Impact", 71)])
    got = {r["case_id"]: r for r in S.resume_state(j, h, g, c).collect()}
    assert set(got) == {"c", "bare", "odd", "new", "solo"}
    row = got["c"]
    assert (row["last_summary"], row["next_steps"], row["sessions"], row["approved"], row["rejected"], row["draft"], row["gaps_open"], row["clusters"], row["strong"], row["moderate"]) == ("last", ["y", "z"], 1, 8, 1, 0, 1, 2, 1, 1)
    assert (got["bare"]["last_end"], got["bare"]["next_steps"], got["bare"]["sessions"]) == (None, [], 1) and got["odd"]["next_steps"] == [] and (got["new"]["draft"], got["new"]["gaps_open"], got["new"]["sessions"]) == (1, 1, 0) and got["solo"]["strong"] == 1
    lists = S.resume_lists(j, h, g, entries=3).collect()
    ids = lambda case, name: [r["id"] for r in sorted((r for r in lists if (r["case_id"], r["list"]) == (case, name)), key=lambda r: r["rank"])]
    assert ids("c", "entry") == ["5", "3", "4"] and ids("c", "approval") == ["h06", "h07", "h04", "h05", "h02"] and ids("c", "gap") == ["g1"] and ids("new", "gap") == ["g3"] and ids("bare", "entry") == ["6"]
    assert S.resume_lists(j.limit(0), h.limit(0), g.limit(0)).count() == 0 and S.resume_state(j.limit(0), h.limit(0), g.limit(0), c.limit(0)).count() == 0


def test_free_text_fields(spark):
    row = {"event_id": "e", "command_line": "a", "target_file": "b", "remote_ip": "10.9.8.7", "process_path": "C:/needle", "message": "The Needle", "canonical_type": "ALERT"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    assert V.search(df, "needle").count() == 1 and V.search(df.drop("message"), "needle").count() == 0 and V.search(df, "10.9.8").count() == 0 and V.search(df, "remote_ip:10.9.8").count() == 1
