"""Each stream over files, against the same question to the whole table."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from casegraph.operators import detect
from casegraph.operators.cluster import group_hits, trigger_hits
from casegraph.operators.graph import edges, entities
from casegraph.operators.rules import BY_NAME
from casegraph.streaming import graph_table, ordered, streams

SCHEMA = "event_id string, doc_id string, case_id string, host_name string, timestamp timestamp, canonical_type string, user string, process_name string, process_path string, command_line string, target_file string, remote_ip string, remote_port int, registry_key string, alert_name string"
DAY = 1714557600  # 2024-05-01 10:00 UTC


def event(k):
    kinds = [{"canonical_type": "ALERT", "alert_name": "psexec"}, {"canonical_type": "AUTHENTICATION"}, {"canonical_type": "SERVICE_INSTALLATION"}, {"canonical_type": "NETWORK_CONNECTION", "remote_ip": "203.0.113.7", "remote_port": 22}]
    return {"event_id": f"e{k}", "doc_id": f"e{k}", "case_id": "c", "host_name": f"h{k % 3}", "user": "u", "epoch": DAY + 37 * k} | kinds[k % 4]


def stamped(e):
    return {k: v for k, v in e.items() if k != "epoch"} | {"timestamp": f"2024-05-01T{10 + (e['epoch'] - DAY) // 3600:02d}:{(e['epoch'] - DAY) % 3600 // 60:02d}:{(e['epoch'] - DAY) % 60:02d}Z"}


END = stamped(event(0)) | {"event_id": "end", "doc_id": "end", "host_name": "end", "canonical_type": "SERVICE_INSTALLATION", "timestamp": "2024-05-09T00:00:00Z"}


def land(folder, parts):
    """A file for each part. The file source takes files by their times, which are set a minute apart."""
    for n, part in enumerate(parts):
        (folder / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(folder / f"{n}.json", (DAY + 60 * n, DAY + 60 * n))
    return str(folder)


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    """Events in three files, in order of time, some of them twice, and one that is late enough to close all windows."""
    rows = [stamped(event(k)) for k in range(300)]
    return land(tmp_path_factory.mktemp("landing"), (rows[:100], rows[90:200], rows[200:], [END]))


def stream(spark, landed):
    return streams.stream_ingest(spark, landed, SCHEMA, files=1)


def table(spark, landed):
    return spark.read.schema(SCHEMA).json(landed).where("event_id <> 'end'")


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_once(spark, landed, tmp_path):
    got = streams.run_once(streams.once(stream(spark, landed)), f"{tmp_path}/out", f"{tmp_path}/cp").where("event_id <> 'end'")
    assert table(spark, landed).count() == 310 and rows(got) == rows(table(spark, landed).distinct())


def test_hits(spark, landed, tmp_path):
    family = BY_NAME["LateralMovement"]
    got = streams.run_once(streams.stream_hits(stream(spark, landed), (family,)), f"{tmp_path}/out", f"{tmp_path}/cp")
    want = group_hits(trigger_hits(table(spark, landed), (family,)))
    assert rows(got.select("host_name", "bucket", "triggers_fired", "base_score")) == rows(want.select("host_name", "bucket", "triggers_fired", "base_score")) and want.count() > 10
    with pytest.raises(ValueError):
        streams.stream_hits(stream(spark, landed))


def test_burst(spark, landed, tmp_path):
    got = streams.run_once(streams.stream_burst(stream(spark, landed), ["host_name"], "30 minutes", "5 minutes", 4), f"{tmp_path}/out", f"{tmp_path}/cp")
    want = detect.sliding(table(spark, landed).withColumn("epoch", F.unix_timestamp("timestamp")), ["host_name"], 1800, 300, 4)
    assert rows(got) == rows(want) and want.count() > 10


def test_sessions(spark, landed, tmp_path):
    alerts = lambda df: df.where("canonical_type = 'ALERT' OR event_id = 'end'")
    got = streams.run_once(streams.stream_sessions(alerts(stream(spark, landed)), ["host_name"], "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp").where("host_name <> 'end'")
    want = detect.sessions(alerts(table(spark, landed)).withColumn("epoch", F.unix_timestamp("timestamp")), ["host_name"], 600, 0)
    # a session window ends its gap after the last event
    assert rows(got) == rows(want.select("host_name", "start", (F.col("end") + 600).alias("end"), "n"))


def test_merge(spark, landed, tmp_path):
    seen = []
    streams.merge_each_batch(stream(spark, landed), lambda df: seen.append(df.count()), f"{tmp_path}/cp").awaitTermination()
    assert seen == [100, 110, 100, 1]


def net(df):
    return df.where("canonical_type = 'NETWORK_CONNECTION' OR event_id = 'end'")


def jitter_rows(out, tmp_path, name="cp"):
    """The last row of each host, as the stream gives them."""
    last = {}
    out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).foreachBatch(lambda df, _: last.update({r["host_name"]: (r["n"], round(r["mean_gap"], 9), round(r["jitter"], 9)) for r in df.collect()})).start().awaitTermination()
    return last


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_jitter(spark, rocks, tmp_path, order):
    """Files in any order, and events in any order in them, give what the table gives."""
    rnd = random.Random(str(order))
    rows_ = [stamped(event(k)) | {"timestamp": f"2024-05-01T{10 + (37 * k + rnd.randint(0, 9)) // 3600:02d}:{(37 * k) % 3600 // 60:02d}:{(37 * k) % 60:02d}Z"} for k in range(300)]
    parts = [rows_[x::3] for x in range(3)] if order[0] == 0 else [rows_[:100], rows_[100:200], rows_[200:]]
    parts = [rnd.sample(parts[k], len(parts[k])) for k in order]
    (tmp_path / "in").mkdir()
    folder = land(tmp_path / "in", [*parts, [END]])
    got = jitter_rows(ordered.stream_jitter(net(stream(spark, folder)), ["host_name", "remote_ip"], 10, 0.9, late="6 hours"), tmp_path)
    want = detect.beacon_jitter(net(table(spark, folder)).withColumn("epoch", F.unix_timestamp("timestamp")), ["host_name", "remote_ip"], 10, 0.9)
    assert got == {r["host_name"]: (r["n"], round(r["mean_gap"], 9), round(r["jitter"], 9)) for r in want.collect()} and len(got) == 3


def test_jitter_late_and_silent(spark, rocks, tmp_path):
    """What comes after the watermark is left out, and a key that was silent for long starts anew."""
    at = lambda day, minute: {"event_id": f"{day}.{minute}", "doc_id": "d", "case_id": "c", "host_name": "h", "canonical_type": "NETWORK_CONNECTION", "remote_ip": "203.0.113.7", "timestamp": f"2024-05-{day:02d}T10:{minute:02d}:00Z"}
    other = lambda day: END | {"timestamp": f"2024-05-{day:02d}T00:00:00Z"}
    parts = [[at(1, m) for m in range(0, 40, 2)], [other(2)], [at(1, 5)], [other(9)], [at(9, m) for m in range(10, 40, 3)], [other(11)]]
    (tmp_path / "in").mkdir()
    folder = land(tmp_path / "in", parts)
    seen = []
    out = ordered.stream_jitter(net(stream(spark, folder)), ["host_name", "remote_ip"], 5, 0.9, ttl=86400)
    out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda df, _: seen.extend((r["n"], r["mean_gap"]) for r in df.collect())).start().awaitTermination()
    assert seen[0] == (20, 120.0) and seen[-1] == (10, 180.0)
    with pytest.raises(ValueError):
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        ordered.stream_jitter(net(stream(spark, folder)), ["host_name"])


ENTITY = ("entity_id", "case_id", "entity_type", "entity_key", "first_seen", "last_seen", "seen_count", "internal")
EDGE = ("edge_id", "case_id", "from_id", "to_id", "edge_type", "timestamp")


def canonical(df):
    return df.withColumn("pid", F.lit(7).cast("long"))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_graph_table(spark, tmp_path, order):
    """Batch by batch is all at once, in any order of the files, also after a batch that comes again and one that failed."""
    rows_ = [stamped(event(k)) for k in range(300)]
    parts = [rows_[:100], rows_[100:200], rows_[200:]]
    (tmp_path / "in").mkdir()
    folder, path = land(tmp_path / "in", [parts[k] for k in order]), f"file://{tmp_path}/graph"
    graph_table.stream_graph(canonical(stream(spark, folder)), path, f"{tmp_path}/cp", buckets=5).awaitTermination()
    all_ = canonical(table(spark, folder))

    def same():
        assert rows(graph_table.graph_of(spark, path, "entities").select(*ENTITY)) == rows(entities(all_).select(*ENTITY))
        assert rows(graph_table.graph_of(spark, path, "edges").select(*EDGE)) == rows(edges(all_).select(*EDGE))

    same()
    counts = [graph_table.merge_graph(canonical(spark.createDataFrame(parts[order[k]], SCHEMA.replace("timestamp timestamp", "timestamp string")).withColumn("timestamp", F.to_timestamp("timestamp"))), k, path, 5) for k in range(3)]  # again
    same()
    assert sum(c["entities_new"] for c in counts) == entities(all_).count() and sum(c["edges_new"] for c in counts) == edges(all_).count() and counts[1]["entities_seen"] > 0
    entities(all_).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/entities/version=0000000009-dead")  # written, not entered
    same()
    assert graph_table.vacuum(spark, path) > 0
    same()
    # a batch with one new event rewrites the buckets of its ids only
    one = canonical(spark.createDataFrame([stamped(event(2)) | {"host_name": "fresh", "user": None}], SCHEMA.replace("timestamp timestamp", "timestamp string")).withColumn("timestamp", F.to_timestamp("timestamp")))
    assert graph_table.merge_graph(one, 3, path, 5)["entities_new"] == entities(one).count()
    touched = graph_table.log_of(spark, path).where("batch = 3 AND kind = 'entities' AND bucket IS NOT NULL").count()
    assert 0 < touched <= entities(one).count() < 5
    assert rows(graph_table.graph_of(spark, path, "entities").select(*ENTITY)) == rows(entities(all_.unionByName(one)).select(*ENTITY))


def test_graph_table_empty(spark, tmp_path):
    none = canonical(spark.createDataFrame([], SCHEMA))
    assert graph_table.merge_graph(none, 0, f"file://{tmp_path}/g") == {"entities_new": 0, "entities_seen": 0, "edges_new": 0, "edges_seen": 0}
    with pytest.raises(ValueError):
        graph_table.graph_of(spark, f"file://{tmp_path}/g", "edges")
