"""Shortest paths between pairs of nodes as a graph of their steps, with the number of paths; the paths themselves only on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .graph import components, numbered, saved
from .tiles import SOURCE, TARGET, cells, members, product


class ShortestPaths:
    """The shortest paths of each pair (src, dst) along links (a, b), of at most depth steps; with both, links go both ways.

    pairs: (src, dst), or (node, team) with one row a node, which stands for all pairs of different nodes of a team, without a row for each.

    Two searches, from the sources along links and from the targets against them, each go half the way, one level a round, and no
    further than what is asked for. A level has one row for each source and node, with the number of shortest paths to it, however many
    those are. A pair is found at the first level at which its two searches meet; they meet by node and team, so only where a pair is asked
    for. A source takes part only while it has a pair that is not found, and from the third level on no pair counts whose nodes no links
    connect. From there on the last level of each search is no table either: its counts go straight into the sums of pairs, by tiles.
    Where links go both ways and pairs are of teams, the two searches are the same one. A pair of a node with itself has no path.
    """

    def __init__(self, links: DataFrame, pairs: DataFrame, depth: int = 5, both: bool = False):
        self.links, self.names = numbered(links, both)
        self.out, self.into = self.links, self.links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        self.depth, self.step, self.same = depth, 0, both and "team" in pairs.columns
        if both:
            self.out = self.into = self.out.unionByName(self.into)
        if "team" in pairs.columns:
            one = self._numbered(pairs.select("node", "team").where("node IS NOT NULL AND team IS NOT NULL").distinct(), "node")
            one = saved(one.select(F.col("node").alias("src"), "team"))
            self.sources, self.targets = one, one.withColumnRenamed("src", "dst")
        else:
            pairs = saved(self._numbered(self._numbered(pairs.select("src", "dst").where("src <> dst").distinct(), "src"), "dst"))
            self.sources, self.targets = pairs.select("src", F.col("src").alias("team")).distinct(), pairs.select("dst", F.col("src").alias("team"))
        #: names of the ends alone, which are few where links are many
        self.ends = [saved(self.names.join(x.select(F.col(c).alias("id")), "id", "left_semi").select(F.col("id").alias(c), "name")) for x, c in ((self.sources, "src"), (self.targets, "dst"))]
        self.forth = [self._start(self.sources, "src")]
        self.back = self.forth if self.same else [self._start(self.targets, "dst")]
        #: of each level, the ends that took part when it was first asked for
        self.live_forth: list[DataFrame | None] = [None]
        self.live_back = self.live_forth if self.same else [None]
        self.found, self.over = None, False

    def _numbered(self, df: DataFrame, c: str) -> DataFrame:
        """df with the number of the node in column c for its name."""
        return df.join(self.names.withColumnRenamed("name", c), c).drop(c).withColumnRenamed("id", c)

    def _search(self, most: int) -> None:
        """Finds the pairs of up to most steps."""
        while self.step < min(most, self.depth) and not self.over:
            self.step += 1
            if self.step == 3:
                self._connected()
            forth = self.step % 2 == 1
            live = saved(self._open("src" if forth else "dst"))
            if live.isEmpty():
                self.over = True
                if self.found is None:
                    self.found = live.sparkSession.createDataFrame([], "src long, dst long, steps int, n_paths long")
                break
            if forth:
                self.live_forth.append(live)
            elif not self.same:
                self.live_back.append(live)
            met = self._joined() if self.step <= 2 else self._multiplied(live)
            if met is None:
                continue
            met = saved(met.select("src", "dst", F.lit(self.step).alias("steps"), F.col("n").alias("n_paths")))
            self.found = met if self.found is None else self.found.unionByName(met)

    def _joined(self) -> DataFrame:
        """(src, dst, n) of this step, by a join: few paths are that short."""
        met = self._met(self._rows("forth", (self.step + 1) // 2), self._rows("back", self.step // 2)).groupBy("src", "dst").agg(F.sum(F.col("n_src") * F.col("n_dst")).alias("n"))
        return met if self.found is None else met.join(self.found.select("src", "dst"), ["src", "dst"], "left_anti")

    def _multiplied(self, live: DataFrame) -> DataFrame | None:
        """(src, dst, n) of this step, by tiles; None where the searches can't meet."""
        i, j = (self.step + 1) // 2, self.step // 2
        before, edge = self._rows("forth", i - 1), self.out
        if i > j:  # in an odd step, the search goes on only to where the other one is
            near = self._rows("back", j).select(F.col("node").alias("b")).distinct()
            edge = edge.join(near, "b", "left_semi").join(before.select(F.col("node").alias("a")).distinct(), "a", "left_semi").select("a", "b")
            if edge.isEmpty():
                return None
        mine, far = ("src", "dst") if i > j else ("dst", "src")
        other = live.withColumnRenamed(live.columns[0], far) if self.same else saved(self._open(far))
        live = {mine: live.toDF(mine), far: other}
        sources = self.sources.join(live["src"], "src", "left_semi").select(F.col("src").alias("end"), "team")
        targets = sources if self.same else self.targets.join(live["dst"], "dst", "left_semi").select(F.col("dst").alias("end"), "team")
        tiles = members(sources, targets, saved)
        if self.same and i == j:
            parts = self._cells("forth", i, tiles, SOURCE | TARGET, edge)
        else:
            parts = [*self._cells("forth", i, tiles, SOURCE, edge), *self._cells("back", j, tiles, TARGET, self.into)]
        return product(parts, tiles, self.found)

    def _cells(self, side: str, k: int, tiles: DataFrame, sides: int, edge: DataFrame) -> list[DataFrame]:
        """Level k of a side for tiles: its table if there is one, else what the level before leads to along edge."""
        levels = getattr(self, side)
        if k < len(levels):
            return [cells(levels[k], tiles, sides)]
        return [cells(self._rows(side, k - 1), tiles, sides, edge), *[cells(x, tiles, sides, seen=True) for x in levels[:k]]]

    def _rows(self, side: str, k: int) -> DataFrame:
        """Level k of a side as a table."""
        levels, live, edge = (self.forth, self.live_forth, self.out) if side == "forth" else (self.back, self.live_back, self.into)
        while len(levels) <= k:
            seen = levels[0]
            for x in levels[1:]:
                seen = seen.unionByName(x)
            ends = live[len(levels)].toDF("end")
            next_ = levels[-1].join(ends, "end", "left_semi").join(edge, F.col("node") == F.col("a")).groupBy("end", F.col("b").alias("node")).agg(F.sum("n").alias("n"))
            levels.append(saved(next_.join(seen.select("end", "node"), ["end", "node"], "left_anti")))
        return levels[k]

    @staticmethod
    def _start(ends: DataFrame, end: str) -> DataFrame:
        return saved(ends.select(F.col(end).alias("end"), F.col(end).alias("node"), F.lit(1).cast("long").alias("n")).distinct())

    def _connected(self) -> None:
        """Cuts teams to what links connect."""
        part = saved(components(self.links))
        self.sources = saved(self.sources.join(part.withColumnRenamed("node", "src"), "src").select("src", F.struct("team", "part").alias("team")))
        self.targets = saved(self.targets.join(part.withColumnRenamed("node", "dst"), "dst").select("dst", F.struct("team", "part").alias("team")))

    def _open(self, end: str) -> DataFrame:
        """(src) or (dst): the sources or targets with a pair that is not found."""
        mine, other, far = (self.sources, self.targets, "dst") if end == "src" else (self.targets, self.sources, "src")
        size = other.groupBy("team").agg(F.count(F.lit(1)).alias("size"))
        own = other.select(F.col(far).alias(end), "team", F.lit(1).alias("own"))
        want = mine.join(size, "team").join(own, [end, "team"], "left").groupBy(end).agg(F.sum(F.col("size") - F.coalesce("own", F.lit(0))).alias("want"))
        if self.found is not None:
            got = self.found.groupBy(end).agg(F.count(F.lit(1)).alias("got"))
            want = want.join(got, end, "left")
            return want.where("want > coalesce(got, 0)").select(end)
        return want.where("want > 0").select(end)

    def _met(self, forth: DataFrame, back: DataFrame) -> DataFrame:
        """(src, dst, node, n_src, n_dst): where the searches of pairs of a team meet."""
        x = forth.join(self.sources.withColumnRenamed("src", "end"), "end").select("team", "node", F.col("end").alias("src"), F.col("n").alias("n_src"))
        y = back.join(self.targets.withColumnRenamed("dst", "end"), "end").select("team", "node", F.col("end").alias("dst"), F.col("n").alias("n_dst"))
        return x.join(y, ["node", "team"]).where("src <> dst").select("src", "dst", "node", "n_src", "n_dst")

    def _named(self, df: DataFrame) -> DataFrame:
        """df with names for the numbers of its ends."""
        for c, names in zip(("src", "dst"), self.ends):
            df = df.join(names, c).drop(c).withColumnRenamed("name", c)
        return df

    def counts(self) -> DataFrame:
        """(src, dst, steps, n_paths) of the pairs that have a path."""
        self._search(self.depth)
        return self._named(self.found).select("src", "dst", "steps", "n_paths")

    def steps(self, only: int | None = None) -> DataFrame:
        """(src, dst, position, a, b): each step that lies on a shortest path of its pair, once; position is its number from 1.

        only: of the pairs with so many steps; then no longer paths are searched for.
        """
        rows = self._named(self._steps(only))
        for c in ("a", "b"):
            rows = rows.join(self.names.withColumnRenamed("id", c), c).drop(c).withColumnRenamed("name", c)
        return rows.select("src", "dst", "position", "a", "b")

    def step_counts(self, only: int | None = None) -> DataFrame:
        """(src, dst, position, n): how many different steps the shortest paths of a pair have at each position."""
        return self._named(self._steps(only).groupBy("src", "dst", "position").agg(F.count(F.lit(1)).alias("n"))).select("src", "dst", "position", "n")

    def _steps(self, only: int | None) -> DataFrame:
        """Steps by number. From where the two searches meet, each half is followed back to its end, over nodes of the level before only."""
        self._search(self.depth if only is None else only)
        pairs = self.found.select("src", "dst", "steps").where(F.lit(only is None) | (F.col("steps") == only))
        most = min(self.step - self.over, self.depth if only is None else only)
        middle = saved(self._middle(pairs, range(1, most + 1) if only is None else range(only, most + 1)))
        parts = []
        for levels, edge, end, half in ((self.forth, self.into, "src", F.ceil(F.col("steps") / 2)), (self.back, self.out, "dst", F.floor(F.col("steps") / 2))):
            count = ((most + 1) // 2 if end == "src" else most // 2) + 1
            level = levels[0].withColumn("at", F.lit(0))
            for k, more in enumerate(levels[1:count], 1):
                level = level.unionByName(more.withColumn("at", F.lit(k)))
            level = level.select(F.col("end").alias(end), "node", F.col("at").cast("long").alias("at"))
            front = middle.withColumn("at", half)
            for k in range(count - 1, 0, -1):
                step = front.where("at = 1").select("src", "dst", "steps", F.col("node").alias("near"), F.col(end).alias("node"), F.lit(0).cast("long").alias("at"))  # the end itself
                if k > 1:
                    far = front.where("at > 1").join(edge, F.col("node") == F.col("a")).select("src", "dst", "steps", F.col("node").alias("near"), F.col("b").alias("node"), (F.col("at") - 1).alias("at")).join(level, [end, "node", "at"], "left_semi")
                    step = far.distinct().unionByName(step)
                if count > 2:
                    step = saved(step)
                place = F.col("at") + 1 if end == "src" else F.col("steps") - F.col("at")
                parts.append(step.select("src", "dst", place.cast("int").alias("position"), F.col("node" if end == "src" else "near").alias("a"), F.col("near" if end == "src" else "node").alias("b")))
                front = step.select("src", "dst", "steps", "node", "at").where("at > 0").distinct() if k > 1 else None
        out = parts[0] if parts else middle.select("src", "dst", F.lit(0).alias("position"), F.col("node").alias("a"), F.col("node").alias("b"))
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _middle(self, pairs: DataFrame, steps: range) -> DataFrame:
        """(src, dst, steps, node): the nodes half way of each pair's paths."""
        out = self._met(self.forth[0], self.back[0]).select("src", "dst", F.lit(0).alias("steps"), "node").where("false")
        for k in steps:
            met = self._met(self._rows("forth", (k + 1) // 2), self._rows("back", k // 2)).select("src", "dst", "node").join(pairs.where(F.col("steps") == k), ["src", "dst"]).select("src", "dst", "steps", "node")
            out = out.unionByName(met)
        return out

    def paths(self) -> DataFrame:
        """(src, dst, path, steps): every shortest path as an array of nodes; as many rows as counts() says."""
        steps, found = saved(self.steps()), self.counts()
        rows = found.select("src", "dst", "steps", F.array("src").alias("path"), F.col("src").alias("a"))
        done = rows.where("false")
        for k in range(1, self.depth + 1):
            rows = saved(rows.join(steps.where(F.col("position") == k).drop("position"), ["src", "dst", "a"]).select("src", "dst", "steps", F.array_append("path", F.col("b")).alias("path"), F.col("b").alias("a")))
            done = done.unionByName(rows.where(F.col("steps") == k))
            if rows.isEmpty():
                break
        return done.select("src", "dst", "path", "steps")
