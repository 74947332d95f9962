"""Exact n-gram Jaccard self-join with a count-vector R-tree, and its connected components.

1. Shards hash each document's distinct shingles. Buckets count in how many documents each shingle occurs; a shard tells a
   bucket each distinct hash once, with a count, and hears back which ones other documents have too.
2. A document with more than a fifth of its shingles to itself has no partner at 0.8. For the others, the rarest shingles
   in one global order (count, then hash) form a prefix that any partner must touch.
3. Documents with equal sets form a class; its smallest id represents it, and only representatives are compared.
4. Shingles are also hashed into GROUPS groups; the counts by group are a point. Sum of the coordinate minima of two points
   bounds the overlap of their sets, and the same sum over the maxima of a tree node bounds all points below it.
5. Prefix shingles whose documents have the same smallest and largest id form a bundle. Every point is compared with its
   bundle's smallest one first, which joins large groups of near copies without their pairs. A bundle that still holds
   several components goes into R-trees of bounded blocks; what survives the bound is verified there, on the sets, and only
   links that join two components leave the task. Blocks of the documents outside a bundle's largest component meet blocks
   of all its documents, so the largest component is never compared with itself. No candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bucket_runs, cells, components, hash_words, inside, joined, mixed, owner, pieces, release, rolling, shard_count, sharded, table, written

WORDS, PERCENT, GROUPS = 5, 80, 64
#: Shingles that a block of a bundle should hold (2 MB), and points in a leaf of an R-tree.
BLOCK, LEAF = 262_144, 16
#: While a bundle has so many documents outside its largest component, and the last round found a link, stars are compared again.
AGAIN = 512


def _sets(texts, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted by text and hash; the text of each; the number for each text."""
    h, offsets = hash_words(texts, fold_case=True)
    n = np.diff(offsets)
    at = inside(offsets, words)
    own = owner(offsets)
    hashes, owners = [rolling(h, words, 0x9E3779B97F4A7C15)[at]], [own[at]]
    for size in range(1, words):  # short texts: the whole sequence is the one shingle
        short = np.flatnonzero(n == size)
        if len(short):
            hashes.append(mixed(rolling(h, size, 0x9E3779B97F4A7C15)[offsets[short]] + np.uint64(size)))
            owners.append(short)
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])])
        hashes, owners = hashes[new], owners[new]
    return hashes, owners, np.bincount(owners, minlength=len(n)).astype(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.int32()), pa.array(values, kind))


def near_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, groups: int = GROUPS) -> DataFrame:
    """(doc_id, n, sig1, sig2, live, shared, prefix, vec) for each row of docs; the last three are null where no partner can be."""
    n = shard_count(docs)
    parts = sharded(docs, n)

    def count(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        h, _, _ = _sets(t["text"], words)
        cell, times = np.unique(cells(h, n), return_counts=True)
        buckets, starts = bucket_runs(cell)
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "shard": pa.array(np.full(len(buckets), key[0].as_py()), pa.int32()), "keys": pieces(cell.astype(np.uint32), starts), "times": pieces(np.minimum(times, 255).astype(np.uint8), starts)})

    def total(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keys, sizes = joined(t["keys"], "<u4")
        times, _ = joined(t["times"], "u1")
        uniq, index = np.unique(keys, return_inverse=True)
        df = np.bincount(index, weights=times, minlength=len(uniq)).astype(np.int64)[index]
        hit = df > 1
        row = np.repeat(np.arange(len(sizes)), sizes)[hit]
        rows, first = np.unique(row, return_index=True)
        starts = np.append(first, len(row))
        return pa.table({"shard": pa.array(t["shard"].to_numpy()[rows], pa.int32()), "bucket": pa.array(np.full(len(rows), key[0].as_py()), pa.int32()), "keys": pieces(keys[hit], starts), "df": pieces(np.minimum(df[hit], 2**32 - 1).astype(np.uint32), starts)})

    def profile(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        keys, sizes = joined(replies["keys"], "<u4")
        df, _ = joined(replies["df"], "<u4")
        known = (np.repeat(replies["bucket"].to_numpy().astype(np.uint64), sizes) << np.uint64(32)) | keys.astype(np.uint64)
        order = np.argsort(known)
        known, df = known[order], df[order].astype(np.int64)
        h, own, size = _sets(t["text"], words)
        often = np.ones(len(h), np.int64)
        if len(known) and len(h):
            cell = cells(h, n)
            where = np.minimum(np.searchsorted(known, cell), len(known) - 1)
            often = np.where(known[where] == cell, df[where], 1)
        shared = often > 1
        n_shared = np.bincount(own[shared], minlength=len(size))
        may = (size > 0) & (100 * n_shared >= percent * size)
        need = -(-percent * size // 100)  # least overlap of any pair
        with np.errstate(over="ignore"):
            m = mixed(h ^ np.uint64(0x5851F42D4C957F2D))
            ends = np.append(0, np.cumsum(size))
            add = lambda x: np.append(np.uint64(0), np.cumsum(x))[ends[1:]] - np.append(np.uint64(0), np.cumsum(x))[ends[:-1]]
            sig = [add(h).view(np.int64), add(m).view(np.int64)]
        live = may[own]
        by_rank = np.lexsort((h[live], often[live], own[live]))
        ranked, ranked_own, ranked_often = h[live][by_rank], own[live][by_rank], often[live][by_rank]
        begin = np.append(0, np.cumsum(np.where(may, size, 0)))[:-1]
        place = np.arange(len(ranked)) - begin[ranked_own]
        pick = (place < (size - need + 1)[ranked_own]) & (ranked_often > 1)
        vec = np.bincount(own[live] * groups + (h[live] % np.uint64(groups)).astype(np.int64), minlength=len(size) * groups).reshape(-1, groups)
        sh = live & shared
        yes = pa.array(may)
        null = lambda a: pa.compute.if_else(yes, a, pa.scalar(None, a.type))
        release()
        return pa.table({
            "doc_id": t["doc_id"].combine_chunks(), "n": pa.array(size, pa.int64()), "sig1": pa.array(sig[0], pa.int64()), "sig2": pa.array(sig[1], pa.int64()), "live": yes,
            "shared": null(_lists(h[sh].view(np.int64), np.bincount(own[sh], minlength=len(size)), pa.int64())),
            "prefix": null(_lists(ranked[pick].view(np.int64), np.bincount(ranked_own[pick], minlength=len(size)), pa.int64())),
            "vec": null(_lists(vec.ravel().astype(np.int32), np.full(len(size), groups), pa.int32())),
        })

    counts = parts.groupBy("shard").applyInArrow(count, "bucket int, shard int, keys binary, times binary")
    known = counts.groupBy("bucket").applyInArrow(total, "shard int, bucket int, keys binary, df binary")
    return parts.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(profile, "doc_id long, n long, sig1 long, sig2 long, live boolean, shared array<long>, prefix array<long>, vec array<int>")


def overlap_bound(a: Column, b: Column) -> Column:
    """Sum of the coordinate minima of two count vectors: no two sets with these counts share more."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: bound first, then the exact intersection."""
    side = lambda x, what: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col(what).alias(f"v_{x}"))
    both = lambda rows, what: rows.join(side("a", what), "a").join(side("b", what), "b")
    # inter >= percent/100 * union and union = n_a + n_b - inter
    enough = lambda inter: (100 + percent) * inter >= percent * (F.col("n_a") + F.col("n_b"))
    near = both(pairs, "vec").where(enough(overlap_bound(F.col("v_a"), F.col("v_b")))).select("a", "b").distinct()
    return both(near, "shared").where(enough(F.size(F.array_intersect("v_a", "v_b")))).select("a", "b").distinct()


def _tree(vec: np.ndarray) -> list[np.ndarray]:
    """Leaves of at most LEAF points: cut at the median of the widest coordinate, again and again."""
    todo, leaves = [np.arange(len(vec))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            leaves.append(rows)
            continue
        own = vec[rows]
        order = np.argsort(own[:, np.argmax(own.max(0) - own.min(0))], kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return leaves


class _Joined:
    """Components that links found in one task have joined so far."""

    def __init__(self, comp: np.ndarray) -> None:
        self.names, self.of = np.unique(comp, return_inverse=True)
        self.up = np.arange(len(self.names))

    def roots(self) -> np.ndarray:
        """The root of each row's component."""
        while True:
            higher = self.up[self.up]
            if (higher == self.up).all():
                return self.up[self.of]
            self.up = higher

    def join(self, x: int, y: int) -> None:
        a, b = sorted((int(self.up[self.of[x]]), int(self.up[self.of[y]])))
        while self.up[b] != b:
            b = int(self.up[b])
        while self.up[a] != a:
            a = int(self.up[a])
        self.up[max(a, b)] = min(a, b)


def _tree_links(left: np.ndarray, right: np.ndarray, doc: np.ndarray, n: np.ndarray, comp: np.ndarray, vec: np.ndarray, sets: list[np.ndarray], outside: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Rows x of left and y of right whose sets are similar enough, for pairs in different components: links that join them.

    Two rows that are both outside the largest component meet twice, in either role; the smaller document is then x.
    """
    joined_ = _Joined(comp)
    at = np.append(0, np.cumsum([len(v) for v in sets]))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(codes) and int(codes.max()) + 1, bool)
    one, two = [left[x] for x in _tree(vec[left])], [right[y] for y in _tree(vec[right])]
    top, least = np.array([vec[y].max(0) for y in two]), np.array([n[y].min() for y in two])
    for x in one:
        bound = np.minimum(vec[x].max(0), top).sum(1)  # of the node against all nodes
        for j in np.flatnonzero((100 + percent) * bound >= percent * (n[x].min() + least)):
            y = two[j]
            root = joined_.roots()
            may = (root[x][:, None] != root[y][None, :]) & (~outside[y][None, :] | (doc[x][:, None] < doc[y][None, :]))
            if not may.any():
                continue
            may &= (100 + percent) * np.minimum(vec[x][:, None, :], vec[y][None, :, :]).sum(2) >= percent * (n[x][:, None] + n[y][None, :])
            for p in np.flatnonzero(may.any(1)):
                row, others = x[p], y[may[p]]
                mark[codes[at[row]:at[row + 1]]] = True
                inter = np.array([np.count_nonzero(mark[codes[at[o]:at[o + 1]]]) for o in others])
                mark[codes[at[row]:at[row + 1]]] = False
                for o in others[(100 + percent) * inter >= percent * (n[row] + n[others])]:
                    root = joined_.roots()
                    if root[row] != root[o]:
                        joined_.join(row, o)
                        yield int(doc[row]), int(doc[o])


def _search(t: pa.Table, groups: int, percent: int) -> pa.Table:
    """Links in one pair of blocks: rows with outside_role are of a block outside the largest component, the others of a block of all."""
    doc, n, comp = (t[c].to_numpy() for c in ("doc_id", "n", "comp"))
    role, outside = (t[c].to_numpy(zero_copy_only=False) for c in ("role", "outside"))
    flat = lambda c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vec = flat("vec").astype(np.int64).reshape(-1, groups)
    sets = np.split(flat("shared"), np.cumsum(t["shared"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))[:-1])
    found = list(_tree_links(np.flatnonzero(role), np.flatnonzero(~role), doc, n, comp, vec, sets, outside, percent)) if role.any() and not role.all() else []
    return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, groups: int = GROUPS, block: int = BLOCK, again: int = AGAIN) -> tuple[DataFrame, DataFrame]:
    """Documents linked by Jaccard similarity of their word shingles.

    docs: (doc_id, text), further columns are ignored; doc_id is an integer. Returns two tables. The first has one row for each
    input row: (doc_id, n_shingles, component_id), where component_id is the smallest doc_id reachable by links, itself
    included. The second has links (a, b) between representatives of classes of equal sets, enough to span every component.
    Null, empty and blank texts have no shingle and link with nothing. A text of fewer words than a shingle is one
    shingle. Rows that repeat an id are one node: whatever links one of them links the id. A row without an id links with
    nothing but its class: its component is that of documents with an equal set, else null. An empty table gives empty tables.
    block (shingles in a block) and again (when to repeat the stars) change the plan, not the result.
    """
    rows = written(near_sets(docs, words, percent, groups), "near-sets")
    reps = rows.where("live").groupBy("sig1", "sig2", "n").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("shared", "prefix", "vec"), "doc_id").alias("own"))
    reps = written(reps.where("doc_id IS NOT NULL").select("sig1", "sig2", "doc_id", "n", "own.*"), "near-reps")
    classes = reps.select("sig1", "sig2", "n", F.col("doc_id").alias("rep"))
    sets = reps.select("doc_id", "n", "shared", "vec")
    tokens = reps.select(F.explode("prefix").alias("token"), "doc_id")
    post = tokens.groupBy("token").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    bundles = written(tokens.join(post, "token").groupBy("lo", "hi", "doc_id").agg(F.count(F.lit(1)).alias("votes")), "near-bundles")

    # each document against the smallest one of the bundle that it shares most shingles with; then, where much is left, against another
    star = bundles.where("lo <> doc_id").groupBy(F.col("doc_id").alias("b")).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("lo").alias("a"))).alias("best")).select("best.a", "b")
    links = written(_linked(star, sets, percent), "near-star")
    tried = star
    for k in range(1, 100):
        label = components(links, f"near-comp-{k}")
        named = bundles.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("lo", "hi", "doc_id", "votes", F.coalesce("component", "doc_id").alias("comp"))
        named = written(named, f"near-named-{k}")
        draw = F.min(F.struct(F.xxhash64("doc_id", F.lit(k)).alias("h"), "doc_id")).alias("one")
        parts = named.groupBy("lo", "hi", "comp").agg(F.count(F.lit(1)).alias("docs"), draw)
        main = parts.groupBy("lo", "hi").agg(F.max(F.struct("docs", "comp", "one")).alias("main"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("comps"))
        main = written(main.where("comps > 1").select("lo", "hi", F.col("main.comp").alias("main"), F.col("main.one.doc_id").alias("one"), (F.col("docs") - F.col("main.docs")).alias("outside")), f"near-open-{k}")
        if main.where(F.col("outside") > again).isEmpty():
            break
        star = named.join(main.where(F.col("outside") > again), ["lo", "hi"]).where("comp <> main").groupBy(F.col("doc_id").alias("b")).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("one").alias("a"))).alias("best")).select("best.a", "b")
        star = written(star.join(tried, ["a", "b"], "left_anti"), f"near-star-{k}")
        tried = tried.unionByName(star)
        more = written(_linked(star, sets, percent), f"near-more-{k}")
        if more.isEmpty():
            break
        links = written(links.unionByName(more), f"near-links-{k}")

    # (lo, hi, i, j): block i of all documents of a bundle with block j of those outside its largest component
    open_ = named.join(main, ["lo", "hi"]).select("lo", "hi", "doc_id", "comp", (F.col("comp") != F.col("main")).alias("outside")).join(sets, "doc_id")
    weigh = lambda c: F.ceil(F.sum(c) / block).cast("int")
    blocks = named.join(main, ["lo", "hi"]).join(sets.select("doc_id", "n"), "doc_id").groupBy("lo", "hi").agg(weigh(F.col("n")).alias("all"), weigh(F.when(F.col("comp") != F.col("main"), F.col("n"))).alias("out"))
    open_ = open_.join(written(blocks, "near-blocks"), ["lo", "hi"])
    mine = lambda c: F.pmod(F.xxhash64("doc_id"), F.col(c)).cast("int")
    cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    to = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("out") - 1), lambda j: cell(mine("all"), j, False)),
        F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda i: cell(i, mine("out"), True))).otherwise(F.array().cast("array<struct<i:int,j:int,role:boolean>>")),
    )
    spread = open_.withColumn("to", F.explode(to)).select("lo", "hi", "to.i", "to.j", "to.role", "doc_id", "n", "comp", "outside", "vec", "shared")
    rest = spread.groupBy("lo", "hi", "i", "j").applyInArrow(lambda t: _search(t, groups, percent), "a long, b long")
    rest = written(rest.distinct(), "near-rest")
    if not rest.isEmpty():
        links = links.unionByName(rest)
    member = rows.join(classes, ["sig1", "sig2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("live"), F.col("rep")).alias("rep"))
    member = member.withColumn("node", F.coalesce("rep", "doc_id"))
    again_ = written(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "near-again")
    if not again_.isEmpty():  # rows of one id in several classes
        links = links.unionByName(member.join(again_, "doc_id", "left_semi").where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    final = components(links, "near-final")
    out = member.join(final.select(F.col("id").alias("node"), "component"), "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id")), links


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))[0]


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number_lower(array_to_string(w[i + 1:i + least(len(w), 5)], ' ') || ' ' || least(len(w), 5)) AS g FROM (SELECT doc_id, w, unnest(range(len(w) - least(len(w), 5) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT * FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a)
SELECT reach.a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach.b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY reach.a
"""
