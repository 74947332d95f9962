"""What a case's evidence covers: unions of time, the holes in them, and which holes stand against a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import is_technique
from .detect import sessions
from .intervals import overlapping

#: Kinds of evidence that a host should have.
EXPECTED = ["evtx", "memory", "pcap", "registry"]


def union_of(spans: DataFrame, keys: list[str], slot: int = 86400) -> DataFrame:
    """(keys, start, end): the union of spans (keys, start, end in whole seconds, ends included); spans that touch or leave no second between them become one.

    Spans are cut at slots of time, and united within each; only those at an end of their slot, two for each slot of a key at most, are
    then united with their neighbours. So a busy key is many tasks' work. A span without an end, or that ends before it starts, is none.
    """
    size = F.lit(slot)
    rows = spans.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("start <= end")
    cut = rows.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start") / slot), F.floor(F.col("end") / slot))))
    cut = cut.select(*keys, "slot", F.greatest("start", F.col("slot") * size).alias("start"), F.least("end", (F.col("slot") + 1) * size - 1).alias("end"))
    runs = _united(cut, [*keys, "slot"]).withColumn("edge", (F.col("start") == F.col("slot") * size) | (F.col("end") == (F.col("slot") + 1) * size - 1))
    cols = [*keys, "start", "end"]
    return runs.where("NOT edge").select(*cols).unionByName(_united(runs.where("edge").select(*cols), keys))


def _united(rows: DataFrame, keys: list[str]) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("start") > before + 1).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def evidence_spans(events: DataFrame, kind: Column, slack: int) -> DataFrame:
    """(case_id, host_name, kind, start, end): times of a host in which no two events of a kind are more than slack seconds apart. events: (case_id, host_name, event_id, epoch)."""
    rows = events.select("case_id", "host_name", "event_id", "epoch", kind.alias("kind")).where("kind IS NOT NULL AND epoch IS NOT NULL")
    return sessions(rows, ["case_id", "host_name", "kind"], slack, 0).select("case_id", "host_name", "kind", "start", "end")


def holes(spans: DataFrame, expected: DataFrame, slack: int) -> DataFrame:
    """(case_id, host_name, kind, gap, start, end): expected times without evidence. gap is 'missing' where there is none at all, else 'hole'.

    spans: (case_id, host_name, kind, start, end), apart from each other; expected: the same columns, one row for each host and kind. Holes of at most
    slack seconds are none. A host and kind has a row for each of its spans here, as many as its time has room for at this slack.
    """
    keys = ["case_id", "host_name", "kind"]
    want = expected.select(*keys, F.col("start").alias("want_start"), F.col("end").alias("want_end"))
    met = want.join(spans.select(*keys, F.col("start").alias("s"), F.col("end").alias("e"), F.lit(True).alias("seen")), keys, "left")
    met = met.withColumn("inside", F.coalesce(F.col("seen") & (F.col("s") <= F.col("want_end")) & (F.col("e") >= F.col("want_start")), F.lit(False)))
    some = met.groupBy(*keys, "want_start", "want_end").agg(F.bool_or("inside").alias("any"))
    none = some.where("NOT any").select(*keys, F.lit("missing").alias("gap"), F.col("want_start").alias("start"), F.col("want_end").alias("end"))
    along = Window.partitionBy(*keys).orderBy("s")
    inner = met.where("inside").withColumns({"from": F.coalesce(F.lag("e").over(along), F.col("want_start")), "after": F.lead("s").over(along)})
    before = inner.where(F.col("s") - F.col("from") > slack).select(*keys, F.lit("hole").alias("gap"), F.col("from").alias("start"), F.col("s").alias("end"))
    last = inner.where(F.col("after").isNull() & (F.col("want_end") - F.col("e") > slack)).select(*keys, F.lit("hole").alias("gap"), F.col("e").alias("start"), F.col("want_end").alias("end"))
    return none.unionByName(before).unionByName(last)


def expected_by_host(events: DataFrame, kinds: list[str] = EXPECTED) -> DataFrame:
    """(case_id, host_name, kind, start, end): each kind, from a host's first event to its last."""
    seen = events.groupBy("case_id", "host_name").agg(F.min("epoch").alias("start"), F.max("epoch").alias("end"))
    return seen.select("case_id", "host_name", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"), "start", "end")


def blocking(gaps: DataFrame, findings: DataFrame) -> DataFrame:
    """gaps with blocks_report: whether a finding (case_id, host_name, start_epoch, end_epoch) lies, if only in part, in the gap's time on its host."""
    spans = findings.select("case_id", "host_name", "start_epoch", "end_epoch").distinct()
    ids = ["case_id", "host_name", "kind", "gap", "start", "end"]
    met = overlapping(gaps.select(*ids), spans, ["case_id", "host_name"], ("start", "end"), ("start_epoch", "end_epoch")).select(*ids).distinct().withColumn("blocks_report", F.lit(True))
    return gaps.join(met, ids, "left").na.fill(False, ["blocks_report"])


def covered(spans: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, host_name, kind, seconds, share): how much of the expected time the union of spans covers."""
    keys = ["case_id", "host_name", "kind"]
    want = expected.select(*keys, F.col("start").alias("want_start"), F.col("end").alias("want_end"))
    rows = want.join(union_of(spans, keys), keys, "left")
    part = F.when(F.col("end").isNotNull(), F.greatest(F.least("end", "want_end") - F.greatest("start", "want_start"), F.lit(0)))
    rows = rows.groupBy(*keys, "want_start", "want_end").agg(F.coalesce(F.sum(part), F.lit(0)).alias("seconds"))
    whole = F.col("want_end") - F.col("want_start")
    return rows.select(*keys, "seconds", F.when(whole > 0, F.col("seconds") / whole).otherwise(0.0).alias("share"))


def case_readiness(hypotheses: DataFrame, links: DataFrame, gaps: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row for each case: what stands against closing it, and whether it is ready.

    hypotheses: (case_id, hypothesis_id, status, techniques, contradicted_by, signed); links: (case_id, source, target); gaps: (case_id, blocks_report), those
    that are open; clusters: (case_id, tier). Drafts, links that oppose each other, approved hypotheses that contradict an approved one, and
    blocking gaps stand against it. The rest are warnings: approved ones without techniques, with wrong ones or unsigned, other gaps, and unsurfaced where
    nothing is approved: 'clusters' although there are some, or 'nothing' at all.
    """
    approved = F.col("status") == "APPROVED"
    techniques = F.coalesce("techniques", F.array().cast("array<string>"))
    sums = hypotheses.groupBy("case_id").agg(
        F.count_if(F.col("status") == "DRAFT").alias("drafts"), F.count_if(approved).alias("approved"), F.count_if(approved & (F.size(techniques) == 0)).alias("without_technique"),
        F.sum(F.when(approved, F.size(F.filter(techniques, lambda t: ~F.coalesce(is_technique(t), F.lit(False))))).otherwise(0)).alias("bad_techniques"), F.count_if(approved & ~F.coalesce("signed", F.lit(False))).alias("unsigned"),
    )
    good = hypotheses.where(approved).select("case_id", F.col("hypothesis_id").alias("contradicted_by")).distinct()
    against = hypotheses.where(approved).join(good, ["case_id", "contradicted_by"], "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("approved_contradicted"))
    pair = lambda a, b: links.where("source <> target").select("case_id", F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    opposed = pair("source", "target").join(pair("target", "source"), ["case_id", "a", "b"]).where("a < b").groupBy("case_id").agg(F.count(F.lit(1)).alias("opposed_links"))
    open_ = gaps.groupBy("case_id").agg(F.count(F.lit(1)).alias("gaps_open"), F.count_if(F.col("blocks_report")).alias("gaps_blocking"))
    found = clusters.groupBy("case_id").agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("tier") == "STRONG").alias("strong_clusters"))
    out = sums
    for more in (against, opposed, open_, found):
        out = out.join(more, "case_id", "full")
    numbers = [c for c in out.columns if c != "case_id"]
    out = out.na.fill(0, numbers)
    unsurfaced = F.when((F.col("approved") == 0) & (F.col("clusters") > 0), "clusters").when(F.col("approved") == 0, "nothing")
    ready = (F.col("drafts") == 0) & (F.col("opposed_links") == 0) & (F.col("approved_contradicted") == 0) & (F.col("gaps_blocking") == 0)
    return out.select("case_id", *numbers, unsurfaced.alias("unsurfaced"), ready.alias("ready"))
