"""Products of two tables of counts, (end, node, n) each, summed over nodes: tile by tile as matrices, in numpy inside Spark's tasks.

A tile is a block of sources by a block of targets. Counts are dealt to the tiles of their ends in cells of SLAB nodes; a tile's
task takes one slab of nodes after another, so it holds the tile and one slab. Sums are exact: floats are used while they hold all
integers that can come up, longs beyond.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ends of a block on average, places that a block has at most, nodes of a slab.
BLOCK, PLACES, SLAB = 2048, 4096, 512
#: A row is of sources, of targets or of both; counts that are to be left out; pairs of a tile that are to be left out; the ids of a tile's ends.
SOURCE, TARGET, SEEN, DONE, IDS = 1, 2, 4, 8, 16
#: Elements expanded at once.
CHUNK = 1 << 22
CELLS = "tile long, slab long, kind int, cells array<int>, ns array<long>"


def members(sources: DataFrame, targets: DataFrame, save) -> DataFrame:
    """(end, tile, pos, kind) from (end, team) of both sides: each source of a team shares one tile with each target of it."""

    def placed(ends: DataFrame, block: str) -> DataFrame:
        size = ends.groupBy("team").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        rows = ends.join(size, "team").withColumn(block, F.pmod(F.xxhash64("end"), F.col("blocks")))
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy("team", block).orderBy("end")) - 1).select("end", "team", block, "pos")

    x = save(placed(sources, "i"))
    y = x.withColumnRenamed("i", "j") if sources is targets else save(placed(targets, "j"))
    tile = save(x.select("team", "i").distinct().join(y.select("team", "j").distinct(), "team").withColumn("tile", F.monotonically_increasing_id()))
    both = x.join(tile, ["team", "i"]).select("end", "tile", "pos", F.lit(SOURCE).alias("kind")).unionByName(y.join(tile, ["team", "j"]).select("end", "tile", "pos", F.lit(TARGET).alias("kind")))
    return save(both.groupBy("end", "tile", "pos").agg(F.sum("kind").cast("int").alias("kind")))  # equal blocks have equal places


def cells(level: DataFrame, members_: DataFrame, sides: int, edge: DataFrame | None = None, seen: bool = False) -> DataFrame:
    """Rows of CELLS for (end, node, n), with edge (a, b) for (end, b, n) of each of its links from the node."""
    kind = F.col("kind").bitwiseAND(F.lit(sides))
    rows = level.join(members_.where(kind != 0).select("end", "tile", "pos", kind.alias("kind")), "end")
    at = F.collect_list(F.struct("tile", "pos", F.col("kind").bitwiseOR(F.lit(SEEN if seen else 0)).alias("kind"), "n")).alias("at")
    if edge is None:
        rows = rows.groupBy("node").agg(at).withColumn("next", F.array("node"))
    else:
        session = level.sparkSession
        tasks = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))  # a few bytes here lead to many cells
        rows = rows.repartition(tasks, "node").groupBy("node").agg(at)
        rows = rows.join(edge.withColumnRenamed("a", "node").repartition(tasks, "node").groupBy("node").agg(F.collect_list("b").alias("next")), "node")
    return rows.select("at.tile", "at.pos", "at.kind", "at.n", "next").mapInArrow(_dealt, CELLS)


def crossed(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within rows, of lists with left[k] and right[k] elements in row k that lie one after another."""
    row = np.repeat(np.arange(len(left)), left)  # of each left element
    many = right[row]
    first = np.repeat((np.cumsum(right) - right)[row] - (np.cumsum(many) - many), many)
    return np.repeat(np.arange(len(row)), many), np.arange(len(first)) + first


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of lists, and where each list starts and ends."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _dealt(batches):
    for batch in batches:
        (tile, at), (pos, _), (kind, _), (n, _), (next_, to) = (_lists(batch.column(k)) for k in range(5))
        left, right = np.diff(at), np.diff(to)
        # a node's ends go in parts if there are too many with its links; rows are then taken together up to CHUNK elements
        row = np.repeat(np.arange(len(left)), np.maximum(1, -(-left * right // CHUNK)))
        part = np.arange(len(row)) - np.searchsorted(row, row)
        parts = np.bincount(row, minlength=len(left))[row] if len(row) else row
        low, high = at[row] + left[row] * part // np.maximum(parts, 1), at[row] + left[row] * (part + 1) // np.maximum(parts, 1)
        size = np.cumsum((high - low) * right[row])
        tiles, tile = np.unique(tile, return_inverse=True)
        slabs, slab = np.unique(next_ // SLAB, return_inverse=True)
        mine, there = (tile * len(slabs) * 8 + kind) * (SLAB * PLACES) + pos, slab * 8 * (SLAB * PLACES) + next_ % SLAB * PLACES  # kinds of counts are below 8
        k = 0
        while k < len(row):
            stop = k + 1 if parts[k] > 1 else max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + CHUNK, side="right")))
            if stop > k + 1:
                stop = min(stop, k + 1 + int(np.argmax(np.append(parts[k + 1 : stop], 2) > 1)))
            e, b = crossed((high - low)[k:stop], right[row[k:stop]])
            if len(e):
                # rows k to stop are whole ones, or one part of one row
                key, ones = mine[low[k] + e] + there[to[row[k]] + b], n[low[k] : high[stop - 1]]
                if (ones == 1).all():
                    key, count = np.sort(key), None
                else:
                    order = np.argsort(key)
                    key, count = key[order], ones[e][order]
                yield _packed(key, count, tiles, slabs)
            k = stop


def _packed(key, n, tiles, slabs) -> pa.RecordBatch:
    head, cell = key // (SLAB * PLACES), (key % (SLAB * PLACES)).astype(np.int32)
    start = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    at, head = pa.array(np.append(start, len(key)).astype(np.int32)), head[start]
    ns = pa.nulls(len(start), pa.list_(pa.int64())) if n is None else pa.ListArray.from_arrays(at, pa.array(n))
    columns = [pa.array(tiles[head // 8 // len(slabs)]), pa.array(slabs[head // 8 % len(slabs)]), pa.array((head % 8).astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(cell)), ns]
    return pa.RecordBatch.from_arrays(columns, names=["tile", "slab", "kind", "cells", "ns"])


def product(parts: list[DataFrame], members_: DataFrame, done: DataFrame | None) -> DataFrame:
    """(src, dst, n): the sums over nodes of each source's counts times each target's, without pairs in done (src, dst). parts: rows of cells."""
    for side in (SOURCE, TARGET):
        own = members_.where(F.col("kind").bitwiseAND(F.lit(side)) != 0).groupBy("tile").agg(F.collect_list(F.struct("pos", "end")).alias("at"))
        parts = [*parts, own.select("tile", _long(-(1 << 40)), F.lit(IDS + side).alias("kind"), F.col("at.pos").alias("cells"), F.col("at.end").alias("ns"))]
    if done is not None:
        x = members_.where(F.col("kind").bitwiseAND(F.lit(SOURCE)) != 0).select(F.col("end").alias("src"), "tile", F.col("pos").alias("i"))
        y = members_.where(F.col("kind").bitwiseAND(F.lit(TARGET)) != 0).select(F.col("end").alias("dst"), "tile", F.col("pos").alias("j"))
        rows = done.join(x, "src").join(y, ["dst", "tile"]).groupBy("tile", "i").agg(F.collect_list("j").alias("cells"))
        parts = [*parts, rows.select("tile", (-1 - F.col("i")).cast("long").alias("slab"), F.lit(DONE).alias("kind"), "cells", F.lit(None).cast("array<long>").alias("ns"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # many tasks, so that few large tiles share one
    tasks = max(1, min(16 * members_.sparkSession.sparkContext.defaultParallelism, 4 * members_.select("tile").distinct().count()))
    return rows.repartition(tasks, "tile").sortWithinPartitions("tile", "slab").mapInArrow(_multiplied, "src long, dst long, n long")


def _long(value: int) -> Column:
    return F.lit(value).cast("long").alias("slab")


class _Tile:
    def __init__(self):
        self.ids = {SOURCE: np.empty(0, np.int64), TARGET: np.empty(0, np.int64)}
        self.sums, self.done, self.slab, self.parts = None, [], None, {}

    def take(self, slab, kind, cell, n):
        if kind > IDS:
            ids = np.full(int(cell.max()) + 1, -1, np.int64)
            ids[cell] = n
            self.ids[kind - IDS] = ids
        elif kind == DONE:
            self.done.append((-1 - slab, cell))
        else:
            if slab != self.slab:
                self.add()
                self.slab = slab
            self.parts.setdefault(kind, []).append((cell, n))

    def side(self, side):
        """(cells, ns): the counts of a side in this slab, each cell once, in order."""
        mine = [p for k, v in self.parts.items() if k & side and not k & SEEN for p in v]
        if not mine:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if all(n is None for _, n in mine):
            cell, n = np.unique(np.concatenate([c for c, _ in mine]), return_counts=True)
        else:
            cell, back = np.unique(np.concatenate([c for c, _ in mine]), return_inverse=True)
            n = np.zeros(len(cell), np.int64)
            np.add.at(n, back, np.concatenate([np.ones(len(c), np.int64) if m is None else m for c, m in mine]))
        seen = [c for k, v in self.parts.items() if k & side and k & SEEN for c, _ in v]
        if seen:
            new = ~np.isin(cell, np.concatenate(seen))
            cell, n = cell[new], n[new]
        return cell.astype(np.int64), n

    def add(self):
        """Adds the products of the slab."""
        if not self.parts:
            return
        x, y = self.side(SOURCE), None
        if len(x[0]):
            y = x if all(k & SOURCE and k & TARGET for k in self.parts) else self.side(TARGET)
        self.parts = {}
        if y is None or not len(y[0]):
            return
        both = np.intersect1d(x[0] // PLACES, y[0] // PLACES)
        if not len(both):
            return
        shape = len(self.ids[SOURCE]), len(self.ids[TARGET])
        if self.sums is None:
            self.sums = np.zeros(shape, np.int64)
        (xr, xp, xn), (yr, yp, yn) = (self.rows(*s, both) for s in (x, y))
        left, right = np.bincount(xr, minlength=len(both)), np.bincount(yr, minlength=len(both))
        if 32 * int(left @ right) < len(both) * shape[0] * shape[1] and int(left @ right) <= CHUNK:
            i, j = crossed(left, right)
            np.add.at(self.sums, (xp[i], yp[j]), xn[i] * yn[j])
            return
        most = float(xn.max()) * float(yn.max()) * len(both)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        a, b = np.zeros((len(both), shape[0]), kind), np.zeros((len(both), shape[1]), kind)
        a[xr, xp], b[yr, yp] = xn, yn
        self.sums += (a.T @ b).astype(np.int64)

    @staticmethod
    def rows(cell, n, both):
        row = np.searchsorted(both, cell // PLACES)
        mine = both[np.minimum(row, len(both) - 1)] == cell // PLACES
        return row[mine], cell[mine] % PLACES, n[mine]

    def result(self):
        self.add()
        if self.sums is None:
            return
        for i, j in self.done:
            self.sums[i, j] = 0
        step = max(1, CHUNK // max(1, self.sums.shape[1]))
        for low in range(0, len(self.sums), step):
            i, j = np.nonzero(self.sums[low : low + step])
            src, dst = self.ids[SOURCE][i + low], self.ids[TARGET][j]
            other = src != dst
            yield pa.RecordBatch.from_arrays([pa.array(src[other]), pa.array(dst[other]), pa.array(self.sums[i + low, j][other])], names=["src", "dst", "n"])


def _multiplied(batches):
    now, tile = None, _Tile()
    for batch in batches:
        tiles, slab, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        (cell, at), (n, to) = _lists(batch.column(3)), _lists(batch.column(4))
        for r in range(len(tiles)):
            if tiles[r] != now:
                yield from tile.result()
                now, tile = tiles[r], _Tile()
            tile.take(int(slab[r]), int(kind[r]), cell[at[r] : at[r + 1]], n[to[r] : to[r + 1]] if to[r + 1] > to[r] else None)
    yield from tile.result()
