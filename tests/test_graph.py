import itertools
import math
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casegraph.operators import bits, chains, graph, intervals, judge, quantiles, tiles
from casegraph.operators.path_dag import ShortestPaths
from casegraph.plans import queries

DATA = "/root/testdata/sf0.001"


def agree(spark, name, data=DATA):
    """The rows of a query, held against its SQL."""
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    got = queries.QUERIES[name](spark, data)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    return rows, con


def test_tree_has_no_depth_cap(spark):
    chain = spark.range(22).select(F.lit("h").alias("host_name"), F.col("id").alias("pid"), (F.col("id") - 1).alias("ppid"), F.lit("p").alias("process_name"), F.lit(0).alias("timestamp"), F.col("id").alias("event_id"))
    assert {r["pid"]: r["depth"] for r in chains.process_tree(chain).collect()} == {k: k for k in range(22)}


def test_chain_has_no_length_cap(spark):
    links = spark.range(36).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit("NET").alias("level"), F.lit(0).alias("at"))
    last = spark.createDataFrame([(36,)], "node long")
    assert judge.root_causes(links, last).first()["chain"] == list(range(36, -1, -1))


def test_whole_tree(spark):
    rows, con = agree(spark, "process_tree_whole")
    assert len(rows) == con.execute("SELECT count(*) FROM events WHERE event_type = 'click'").fetchall()[0][0]
    assert all(r[3] is not None for r in rows) and any(r[3] > 0 for r in rows)


@pytest.mark.parametrize("name", ["causal_contradictions", "orphan_links", "kill_chain_whole", "kill_chain"])
def test_whole_links(spark, name):
    rows, con = agree(spark, name)
    if name == "kill_chain_whole":
        assert len(rows) >= con.execute("SELECT count(*) - count(DISTINCT o_custkey) FROM orders").fetchall()[0][0] > 400


def test_subgraph_and_paths_by_attribute(spark):
    rows, con = agree(spark, "subgraph_by_type", DATA.replace("0.001", "0.01"))
    keys = {int(v[1:]) for r in rows for v in r if v[0] == "p"}
    assert any(k % 7 for k in keys) and keys <= {k for k, in con.execute("SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'").fetchall()}
    rows, con = agree(spark, "paths_from_nation", DATA.replace("0.001", "0.01"))
    assert {r[0] for r in rows if r[2] == 0} == {r[0] for r in rows} != set()


def rounds(spark, work):
    """What work gives, and how many tables it saved: the rounds of a loop."""
    base = spark.conf.get("spark.checkpoint.dir")
    before = len(os.listdir(base))
    out = work()
    return out, len(os.listdir(base)) - before


def test_long_chain_takes_few_rounds(spark):
    n = 100_000
    parents = spark.range(n).select(F.col("id").alias("node"), F.nullif(F.col("id") - 1, F.lit(-1)).alias("parent"))
    out, saved = rounds(spark, lambda: chains.depths(parents).agg(F.count("depth"), F.max("depth"), F.sum("depth"), F.max("root")).first())
    assert tuple(out) == (n, n - 1, n * (n - 1) // 2, 0) and saved < 25
    start = spark.createDataFrame([(n - 1,), (5,)], "node long")
    out, saved = rounds(spark, lambda: chains.walks(parents, start).groupBy("node").agg(F.count(F.lit(1)), F.max("position"), F.sum(F.col("position") + F.col("member"))).collect())
    assert {tuple(r) for r in out} == {(n - 1, n, n - 1, n * (n - 1)), (5, 6, 5, 30)} and saved < 50


def test_cycles_take_no_more_rounds_than_the_longest_way(spark):
    """50,000 pairs of nodes that name each other, under each a third node: the number of tables follows the ways of three, not the 150,000 nodes."""
    k = F.col("id")
    parents = spark.range(150_000).select(k.alias("node"), F.when(k % 3 == 0, k + 1).otherwise(F.when(k % 3 == 1, k + 1).otherwise(k - 1)).alias("parent"))
    out, saved = rounds(spark, lambda: chains.walks(parents, parents.select("node")).groupBy((F.col("node") % 3).alias("kind")).agg(F.count(F.lit(1)), F.max("position"), F.sum(F.col("member") - F.col("node"))).collect())
    assert {tuple(r) for r in out} == {(0, 150_000, 2, 150_000), (1, 100_000, 1, 50_000), (2, 100_000, 1, -50_000)} and saved < 20


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_against_plain(spark, seed):
    """Forests with cycles, self-links, missing parents and null ones."""
    rnd = random.Random(seed)
    up = {k: rnd.choice([None, 99, *range(k + 1)]) if k < 25 else rnd.randrange(25, 40) for k in range(40)}
    up |= {k: rnd.randrange(60) for k in range(40, 60)}
    df = spark.createDataFrame(list(up.items()), "node int, parent int")

    def walk(k, most=None):
        out = [k]
        while up.get(out[-1]) is not None and up[out[-1]] not in out and (most is None or len(out) <= most):
            out.append(up[out[-1]])
        return out

    def depth(k):
        path = walk(k)
        last = path[-1]
        if last == 99:  # named as a parent, but no node
            path = path[:-1]
        elif up[last] is not None:
            return None
        return len(path) - 1, path[-1], "/".join(map(str, reversed(path)))

    got = {r["node"]: (r["depth"], r["root"], r["path"]) if r["root"] is not None else None for r in chains.depths(df.withColumn("label", F.col("node")), "label").collect()}
    assert got == {k: depth(k) for k in up}
    starts = spark.createDataFrame([(k,) for k in [*up, 777]], "node int")
    for most in (None, 3):
        found = {}
        for r in chains.walks(df, starts, most).collect():
            found.setdefault(r["node"], {})[r["position"]] = r["member"]
        assert found == {k: dict(enumerate(walk(k, most))) for k in [*up, 777]}


def test_walks_take_a_table_a_round(spark):
    """Cycles of five nodes and chains of five above a node that is none: the arrays double three times, and nothing else is saved."""
    k = F.col("id")
    parents = spark.range(1000).select(k.alias("node"), F.when(k >= 500, F.when(k % 5 == 4, k - 4).otherwise(k + 1)).otherwise(F.when(k % 5 == 4, -k).otherwise(k + 1)).alias("parent"))
    out, saved = rounds(spark, lambda: chains.walks(parents).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("position", "member"))).alias("at")).collect())
    assert {r["node"]: [tuple(x) for x in r["at"]] for r in out} == {
        n: list(enumerate([*range(n, n // 5 * 5 + 5), *(range(n // 5 * 5, n) if n >= 500 else [-(n // 5 * 5 + 4)])])) for n in range(1000)
    }
    assert saved <= 4


@pytest.mark.parametrize("short", [2, 8])
def test_long_walks_are_rows(spark, monkeypatch, short):
    """Walks beyond what one array holds, into cycles and not, together with short ones."""
    monkeypatch.setattr(chains, "SHORT", short)
    up = {k: k + 1 for k in range(30)} | {30: 17, 31: 5, 32: 33, 33: 32, 34: 34, 35: None, 36: 99, 37: 36}
    df = spark.createDataFrame(list(up.items()), "node int, parent int")
    for most in (None, 1, 8, 20):
        for starts in (None, [*range(0, 38, 3), 777]):
            rows = chains.walks(df, None if starts is None else spark.createDataFrame([(k,) for k in starts], "node int"), most).collect()
            found, want = {}, {}
            for k in up if starts is None else starts:
                want[k] = [k]
                while up.get(want[k][-1]) is not None and up[want[k][-1]] not in want[k] and (most is None or len(want[k]) <= most):
                    want[k].append(up[want[k][-1]])
            for r in rows:
                found.setdefault(r["node"], {})[r["position"]] = r["member"]
            assert found == {k: dict(enumerate(v)) for k, v in want.items()} and len(rows) == sum(map(len, want.values()))


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_shortest_paths_against_plain(spark, depth):
    rnd = random.Random(depth)
    links = {(rnd.randrange(14), rnd.randrange(14)) for _ in range(30)}
    pairs = [(a, b) for a, b in itertools.product(range(14), repeat=2) if rnd.random() < 0.6]

    def plain(src, dst):
        front = [[src]]
        for _ in range(depth):
            front = [[*p, b] for p in front for a, b in links if a == p[-1] and b not in p]
            done = [p for p in front if p[-1] == dst]
            if done:
                return done
        return []

    want = {(a, b): plain(a, b) for a, b in pairs if a != b and plain(a, b)}
    found = ShortestPaths(spark.createDataFrame(list(links), "a int, b int"), spark.createDataFrame(pairs, "src int, dst int"), depth)
    assert {(r["src"], r["dst"]): (r["steps"], r["n_paths"]) for r in found.counts().collect()} == {k: (len(v[0]) - 1, len(v)) for k, v in want.items()}
    assert sorted(tuple(r["path"]) for r in found.paths().collect()) == sorted(tuple(p) for v in want.values() for p in v)
    steps = sorted((r["src"], r["dst"], r["position"], r["a"], r["b"]) for r in found.steps().collect())
    assert steps == sorted({(*k, i + 1, p[i], p[i + 1]) for k, v in want.items() for p in v for i in range(len(p) - 1)})


def test_teams_stand_for_their_pairs(spark):
    rnd = random.Random(9)
    links = spark.createDataFrame([(rnd.randrange(16), rnd.randrange(16)) for _ in range(34)], "a int, b int")
    teams = {k: k % 3 for k in range(18)}
    pairs = [(a, b) for a, b in itertools.permutations(teams, 2) if teams[a] == teams[b]]
    by_team = ShortestPaths(links, spark.createDataFrame(list(teams.items()), "node int, team int"))
    by_pair = ShortestPaths(links, spark.createDataFrame(pairs, "src int, dst int"))
    rows = lambda df: sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())
    assert rows(by_team.counts()) == rows(by_pair.counts()) != [] and rows(by_team.steps()) == rows(by_pair.steps())


def test_pairs_without_links_are_not_searched_for(spark):
    """Twenty copies of a graph in which all suppliers are two steps apart: once these are found, no level is added for pairs of different copies."""
    links = [(f"{k}s{x}", f"{k}p{y}") for k in range(20) for x in range(5) for y in range(8)]
    ends = spark.createDataFrame([(f"{k}s{x}",) for k in range(20) for x in range(5)], "node string")
    links = spark.createDataFrame(links + [(b, a) for a, b in links], "a string, b string")
    pairs = ends.select(F.col("node").alias("src")).crossJoin(ends.select(F.col("node").alias("dst")))
    found = ShortestPaths(links, pairs)
    assert found.counts().groupBy("steps", "n_paths").count().collect() == [(2, 8, 20 * 20)] and len(found.forth) == len(found.back) == 2


def supplied(rnd, suppliers, parts, each):
    """Links of suppliers and parts, and how many paths of two and of four steps lead between suppliers that no shorter ones join."""
    has = np.zeros((suppliers, parts), np.int64)
    for k in range(suppliers):
        has[k, rnd.sample(range(parts), each)] = 1
    two = has @ has.T
    np.fill_diagonal(two, 0)
    four = np.where(two == 0, two @ two, 0)
    np.fill_diagonal(four, 0)
    return [(f"s{i}", f"p{j}") for i, j in zip(*map(list, np.nonzero(has)))], two, four


def test_last_level_is_no_table(spark):
    """Suppliers of one team, most of them four steps apart: what reaches other suppliers is summed without a row for each source and node."""
    links, two, four = supplied(random.Random(6), 150, 600, 8)
    teams = spark.createDataFrame([(f"s{k}", 0) for k in range(150)], "node string, team int")
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    got = {(r["src"], r["dst"]): (r["steps"], r["n_paths"]) for r in ShortestPaths(spark.createDataFrame(links, "a string, b string"), teams, 4, both=True).counts().collect()}
    want = {(f"s{i}", f"s{j}"): (k, int(n[i, j])) for k, n in ((2, two), (4, four)) for i, j in zip(*map(list, np.nonzero(n)))}
    assert got == want and (four > 0).sum() > (two > 0).sum() > 0
    levels = [spark.read.parquet(f"{base}/{d}") for d in set(os.listdir(base)) - before]
    assert sum(x.count() for x in levels if x.columns == ["end", "node", "n"]) <= 150 + len(links)


@pytest.mark.parametrize("block, chunk, both", [(4, 40, True), (2048, 1 << 22, False), (7, 1 << 22, False), (2048, 5, True)])
def test_tiles_against_plain(spark, monkeypatch, block, chunk, both):
    """Several blocks a team, nodes whose links go in parts, links both ways or named both ways."""
    monkeypatch.setattr(tiles, "BLOCK", block)
    links, two, four = supplied(random.Random(7), 40, 70, 3)
    df = spark.createDataFrame(links if both else links + [(b, a) for a, b in links], "a string, b string")
    teams = spark.createDataFrame([(f"s{k}", k % 3) for k in range(40)] + [("s99", 1)], "node string, team int")
    got = {(r["src"], r["dst"]): (r["steps"], r["n_paths"]) for r in ShortestPaths(df, teams, 4, both=both).counts().collect()}
    assert got == {(f"s{i}", f"s{j}"): (k, int(n[i, j])) for k, n in ((2, two), (4, four)) for i, j in zip(*map(list, np.nonzero(n))) if i % 3 == j % 3} and {k for k, _ in got.values()} == {2, 4}
    # tasks hold the module's own values, so their parts are tried here
    monkeypatch.setattr(tiles, "CHUNK", chunk)
    rnd = random.Random(chunk)
    rows = [([(rnd.randrange(3), rnd.randrange(5), 3, rnd.choice([1, 1, n])) for _ in range(rnd.randrange(9))], [rnd.randrange(2000) for _ in range(rnd.randrange(9))]) for n in (1, 1, 4, 2, 1)]
    batch = pa.RecordBatch.from_pydict({k: [[e[i] for e in ends] for ends, _ in rows] for i, k in enumerate(("tile", "pos", "kind", "n"))} | {"next": [x for _, x in rows]})
    found = [(t, s * tiles.SLAB + c // tiles.PLACES, c % tiles.PLACES, n) for out in tiles._dealt([batch]) for r in out.to_pylist() for t, s in [(r["tile"], r["slab"])] for c, n in zip(r["cells"], r["ns"] or [1] * len(r["cells"]))]
    assert sorted(found) == sorted((t, x, p, n) for ends, links_ in rows for t, p, _, n in ends for x in links_)


def test_sums_beyond_floats_are_exact():
    """Counts whose products no double holds, dense and not."""
    for many in (1, 40):
        tile = tiles._Tile()
        for side in (tiles.SOURCE, tiles.TARGET):
            tile.take(-5, tiles.IDS + side, np.arange(2), np.array([10, 11]))
            tile.take(0, side, np.arange(many) * tiles.PLACES + (side == tiles.TARGET), np.full(many, 2**28 + 1))
        out = [r for b in tile.result() for r in b.to_pylist()]
        assert out == [{"src": 10, "dst": 11, "n": many * (2**28 + 1) ** 2}]


def test_two_steps_need_no_longer_search(spark):
    """What is asked of pairs two steps apart is answered by two steps, though most pairs of the team are four apart."""
    links, two, _ = supplied(random.Random(8), 60, 200, 6)
    teams = spark.createDataFrame([(f"s{k}", 0) for k in range(60)], "node string, team int")
    found = ShortestPaths(spark.createDataFrame(links, "a string, b string"), teams, 5, both=True)
    got = {(r["src"], r["dst"], r["position"]): r["n"] for r in found.step_counts(only=2).collect()}
    assert got == {(f"s{i}", f"s{j}", k): int(two[i, j]) for k in (1, 2) for i, j in zip(*map(list, np.nonzero(two)))} and found.step == len(found.forth) == 2


def test_components_against_plain(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)] + [(k, k + 1) for k in range(100, 160)]
    part = {v: v for e in links for v in e}
    for _ in part:
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    got = {r["node"]: r["part"] for r in graph.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert set(got) == set(part) and len({(part[k], got[k]) for k in part}) == len(set(part.values())) == len(set(got.values()))


def test_reach_of_many_starts_shares_rows(spark):
    """200 start nodes, each linked to the same 100: the tables have a row for each batch and node, not for each start and node."""
    links = [(f"a{x}", f"b{y}") for x in range(200) for y in range(100)] + [(f"b{y}", f"c{y % 7}") for y in range(100)] + [("c0", "a5"), ("x", "y")]
    start = spark.createDataFrame([(f"a{x}",) for x in range(200)], "src string")
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    got = {tuple(r) for r in graph.reach(spark.createDataFrame(links, "a string, b string"), start, 3).collect()}
    want = {(f"a{x}", n, k) for x in range(200) for k, n in [(0, f"a{x}"), *((1, f"b{y}") for y in range(100)), *((2, f"c{y}") for y in range(7)), *([(3, "a5")] if x != 5 else [])]}
    written = sum(spark.read.parquet(f"{base}/{d}").count() for d in set(os.listdir(base)) - before)
    assert got == want and written < len(links) + 200 + 2 * 200 + 8 * 120


def test_hub_has_no_row_for_each_path(spark):
    """Six layers of twelve nodes, each linked with all of the next: three million paths between the ends, a few hundred rows."""
    layers = [[f"s{k}"] if k in (0, 7) else [f"n{k}.{x}" for x in range(12)] for k in range(8)]
    links = [(a, b) for x, y in zip(layers, layers[1:]) for a in x for b in y]
    found = ShortestPaths(spark.createDataFrame(links, "a string, b string"), spark.createDataFrame([("s0", "s7")], "src string, dst string"), 8)
    assert tuple(found.counts().first()) == ("s0", "s7", 7, 12**6) and found.steps().count() == len(links)


def test_overlapping_against_plain(spark):
    rnd = random.Random(3)
    side = lambda n: [(rnd.choice("xyz"), k, s, s + rnd.choice([0, 0, 1, 7, 8, 9, 64, 65, 500, 5000, 10**6, 10**9, -1])) for k in range(n) for s in [rnd.choice([rnd.randrange(-2000, 2000), 64 * rnd.randrange(-9, 9)])]]
    a, b = side(150), side(150)
    b += [("x", 900, None, 5), (None, 901, 0, 10)]
    got = intervals.overlapping(spark.createDataFrame(a, "k string, a int, s long, e long"), spark.createDataFrame(b, "k string, b int, s2 long, e2 long"), ["k"], ("s", "e"), ("s2", "e2"))
    want = sorted((k, i, j) for k, i, s, e in a for q, j, s2, e2 in b if k == q and None not in (s2, e2) and s <= e and s2 <= e2 and s <= e2 and s2 <= e)
    assert sorted((r["k"], r["a"], r["b"]) for r in got.collect()) == want and len(want) > 500


def test_overlapping_day_of_a_busy_host(spark):
    """A host's day of 20,000 short intervals on each side, and one long one: what meets stays near what overlaps."""
    n = 20_000
    a = spark.range(n).select(F.lit("h").alias("k"), F.col("id").alias("a"), (4 * F.col("id")).alias("s"), (4 * F.col("id") + 1).alias("e"))
    b = spark.range(n).select(F.lit("h").alias("k"), F.col("id").alias("b"), (4 * F.col("id") + 1).alias("s2"), (4 * F.col("id") + 2).alias("e2")).unionByName(spark.createDataFrame([("h", -1, 0, 4 * n)], "k string, b long, s2 long, e2 long"))
    assert intervals.overlapping(a, b, ["k"], ("s", "e"), ("s2", "e2")).count() == 2 * n


def test_as_of_against_plain(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["x", "y", None]), k, rnd.choice([rnd.randrange(-9000, 90_000), 3600 * rnd.randrange(9)])) for k in range(300)] + [("x", 999, None)]
    states = [(rnd.choice(["x", "y", None, "z"]), rnd.choice([rnd.randrange(-9000, 90_000), 3600 * rnd.randrange(9)]), rnd.choice(["a", "b", "c", None])) for _ in range(60)]
    got = intervals.as_of(spark.createDataFrame(rows, "k string, id int, epoch long"), spark.createDataFrame(states, "k string, epoch long, v string"), ["k"], "v")
    want = {i: max(((t, v) for q, t, v in states if q == k and v is not None and e is not None and t <= e), default=(0, None))[1] for k, i, e in rows}
    assert {r["id"]: r["v"] for r in got.collect()} == want and got.columns == ["k", "id", "epoch", "v"]


def test_sketch_error_and_merge(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), 86400 * rnd.randrange(12) + 5, rnd.choice([0.0, -3.0, rnd.lognormvariate(3, 2)])) for _ in range(3000)]
    df = spark.createDataFrame([*rows, ("a", 5, None), ("a", 5, float("nan"))], "h string, epoch long, v double")
    whole = quantiles.sketch(df, "v", ["h"], 86400)
    parts = quantiles.merged(*[quantiles.sketch(df.where(F.pmod(F.hash("v"), F.lit(3)) == k), "v", ["h"], 86400) for k in range(3)])
    assert sorted(map(tuple, whole.select("h", "period", "bucket", "n").collect())) == sorted(map(tuple, parts.select("h", "period", "bucket", "n").collect()))
    seen = 0
    for q in (0.0, 0.5, 0.95, 1.0):
        for r in quantiles.thresholds(whole, q, ["h"], back=4).collect():
            before = sorted(v for h, e, v in rows if h == r["h"] and r["period"] - 4 <= e // 86400 < r["period"])
            exact = max(before[math.floor(q * (len(before) - 1))], 0.0)
            assert r["n"] == len(before) and abs(r["threshold"] - exact) <= 0.0100001 * exact
            seen += 1
    assert seen > 80
    one = spark.createDataFrame([("a", 0, 10.0), ("a", 86400, 11.0), ("a", 86401, 9.0), ("b", 0, 5.0)], "h string, epoch long, v double")
    assert [r["v"] for r in quantiles.above_earlier(one, "v", 0.5, ["h"]).collect()] == [11.0]


def test_rules_are_spread_over_tasks(spark):
    """The events of one file with one row group: the rows that rules read are written by three tasks a core, not by one."""
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    assert queries.clusters(spark, DATA).count() == 1250
    parts = [sum(f.endswith(".parquet") for f in os.listdir(f"{base}/{d}")) for d in set(os.listdir(base)) - before]
    assert max(parts) == 3 * spark.sparkContext.defaultParallelism


def test_records_are_parsed_in_more_tasks_than_row_groups(spark):
    plan = queries.QUERIES["ingest_event_xml"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({3 * spark.sparkContext.defaultParallelism})" in plan


def test_pairs_of_one_table(spark):
    """Short and long spans, busy and single keys, equal ids, nulls, spans that end before they start."""
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, None, 10 + k]), rnd.choice([*range(60), None]), rnd.choice([0, 1]), s, s + rnd.choice([0, 1, 7, 8, 70, 500, 9000, -3])) for k, s in enumerate(rnd.choices(range(-300, 20_000, 7), k=400))]
    before = lambda x, y: x[1] is not None and y[1] is not None and (x[1], x[2]) < (y[1], y[2])
    want = [(x[0], x[1], x[2], y[1], y[2]) for x in rows for y in rows if x[0] is not None and x[0] == y[0] and before(x, y) and x[3] <= x[4] and y[3] <= y[4] and x[3] <= y[4] and y[3] <= x[4]]
    got = intervals.overlapping_pairs(spark.createDataFrame(rows, "k int, id int, line int, a long, b long"), ["k"], ("a", "b"), ["id", "line"])
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500


def test_pairs_of_one_table_leave_single_keys(spark):
    """Lines whose part and supplier no other line has are not written or dealt to slots."""
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    data = DATA.replace("0.001", "0.01")
    rows, con = agree(spark, "overlapping_deliveries", data)
    written = sum(spark.read.parquet(f"{base}/{f}").count() for f in set(os.listdir(base)) - before)
    total, single = con.execute("SELECT sum(n), sum(n) FILTER (n = 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)").fetchall()[0]
    assert rows and single > total / 2 and written <= 2 * (total - single)


@pytest.mark.parametrize("held", [1 << 24, 40])
def test_words_go_along_links(monkeypatch, held):
    """Parts of a node's words, nodes that are seen, nodes that lie in two batches."""
    monkeypatch.setattr(bits, "HELD", held)
    monkeypatch.setattr(bits, "AT_ONCE", 6)
    rnd = random.Random(held)
    rows = [(rnd.randrange(2), [rnd.getrandbits(63), rnd.getrandbits(63)], [rnd.randrange(9) for _ in range(rnd.randrange(5))]) for _ in range(40)]
    table = lambda names, some: [pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in some[k : k + 7]]) for k in range(0, len(some), 7)]
    out = [(r["grp"], r["node"], r["words"]) for b in bits.pushed(table(("grp", "words", "next"), rows)) for r in b.to_pylist()]
    seen = [(rnd.randrange(2), rnd.randrange(9), [rnd.getrandbits(63), 0]) for _ in range(12)]
    want, old = {}, {}
    for g, w, some in rows:
        for v in some:
            want[g, v] = [x | y for x, y in zip(w, want.get((g, v), [0, 0]))]
    for g, v, w in seen:
        old[g, v] = [x | y for x, y in zip(w, old.get((g, v), [0, 0]))]
    want = {k: [x & ~y for x, y in zip(w, old.get(k, [0, 0]))] for k, w in want.items()}
    mixed = sorted([(*x, False) for x in out] + [(*x, True) for x in seen], key=lambda x: x[:2])
    got = [((r["grp"], r["node"]), r["words"]) for b in bits.merged(table(("grp", "node", "words", "seen"), mixed)) for r in b.to_pylist()]
    assert dict(got) == {k: w for k, w in want.items() if any(w)} and len(got) == len(dict(got)) > 10


def test_reach_by_words(spark):
    """300 starts of one graph: a table has one row a node, of words, not one for each 64 starts; nulls are reached and lead nowhere, starts without links stay."""
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300, 400)) for _ in range(700)] + [(7, None), (None, 8), (399, 399)]
    start = spark.createDataFrame([(k,) for k in [*range(300), 999, None]], "src int")
    to = {}
    for a, b in links:
        for x, y in ((a, b), (b, a)):
            if x is not None:
                to.setdefault(x, set()).add(y)
    want = set()
    for s in [*range(300), 999]:
        seen = {s: 0}
        for k in range(1, 4):
            for x in [x for x, d in seen.items() if d == k - 1]:
                for y in to.get(x, ()):
                    seen.setdefault(y, k)
        want |= {(s, x, d) for x, d in seen.items()}
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    got = [tuple(r) for r in graph.reach(spark.createDataFrame(links, "a int, b int"), start, 3, both=True).collect()]
    tables = [spark.read.parquet(f"{base}/{d}") for d in set(os.listdir(base)) - before]
    rows = sum(x.count() for x in tables if "words" in x.columns or "bits" in x.columns)
    assert set(got) == want and len(got) == len(want) and rows <= 4 * 401
