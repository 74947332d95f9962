"""Detections over several events: gaps, bursts, sequences, repetition, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .intervals import overlapping


def beacon_jitter(events: DataFrame, keys: list[str], least: int = 10, most_cv: float = 0.25) -> DataFrame:
    """(keys, n, mean_gap, jitter): stddev over mean of the gaps between connections, where it is low over more than least of them."""
    gap = F.col("epoch") - F.lag("epoch").over(Window.partitionBy(*keys).orderBy("epoch", "event_id"))
    out = events.withColumn("gap", gap).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("sd"))
    cv = F.when((F.col("n") < 3) | (F.col("mean_gap") == 0), 1.0).otherwise(F.col("sd") / F.col("mean_gap"))
    return out.withColumn("jitter", cv).where((F.col("n") > least) & (F.col("jitter") < most_cv)).select(*keys, "n", "mean_gap", "jitter")


def burst(events: DataFrame, keys: list[str], seconds: int, least: int) -> DataFrame:
    """Events that end a run of more than least events of their keys within seconds: adds n_window.

    Time is cut into slots of 16 times that span, and the end of a slot is copied to the next one, so that keys with many events
    are counted by many tasks.
    """
    size = 16 * max(seconds, 1)
    slot = F.floor(F.col("epoch") / size)
    copies = F.array_compact(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.when((slot + 1) * size - F.col("epoch") <= seconds, F.struct((slot + 1).alias("slot"), F.lit(False).alias("own")))))
    rows = events.withColumn("s_", F.explode(copies)).select("*", "s_.*").drop("s_")
    frame = Window.partitionBy(*keys, "slot").orderBy("epoch").rangeBetween(-seconds, 0)
    return rows.withColumn("n_window", F.count(F.lit(1)).over(frame)).where(F.col("own") & (F.col("n_window") > least)).drop("slot", "own")


def per_window(events: DataFrame, keys: list[str], every: int, least: int, distinct: str | None = None) -> DataFrame:
    """(keys, start, n): tumbling windows with more than least events, or distinct values."""
    start = (F.col("epoch") - F.pmod(F.col("epoch"), F.lit(every))).alias("start")
    n = F.count_distinct(distinct) if distinct else F.count(F.lit(1))
    return events.groupBy(*keys, start).agg(n.alias("n")).where(F.col("n") > least)


def sliding(events: DataFrame, keys: list[str], size: int, step: int, least: int, distinct: str | None = None) -> DataFrame:
    """(keys, start, n): windows of size seconds that begin every step seconds."""
    last = F.col("epoch") - F.pmod(F.col("epoch"), F.lit(step))
    starts = F.explode(F.sequence(last - size + step, last, F.lit(step)))
    n = F.count_distinct(distinct) if distinct else F.count(F.lit(1))
    return events.withColumn("start", starts).groupBy(*keys, "start").agg(n.alias("n")).where(F.col("n") > least)


def sessions(events: DataFrame, keys: list[str], gap: int, least: int) -> DataFrame:
    """(keys, start, end, n): runs whose neighbours are at most gap seconds apart.

    Runs are built in slots of 64 gaps; only those near an end of their slot, a few for each slot, are then joined to each other.
    """
    size = 64 * max(gap, 1)
    order = Window.partitionBy(*keys, "slot").orderBy("epoch", "event_id")
    new = (F.col("epoch") - F.lag("epoch").over(order) > gap).cast("int")
    rows = events.select(*keys, "epoch", "event_id", F.floor(F.col("epoch") / size).alias("slot")).withColumn("new", F.coalesce(new, F.lit(0)))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "slot", "run").agg(F.min("epoch").alias("start"), F.max("epoch").alias("end"), F.count(F.lit(1)).alias("n"))
    near = (F.col("start") - F.col("slot") * size <= gap) | ((F.col("slot") + 1) * size - F.col("end") <= gap)
    along = Window.partitionBy(*keys).orderBy("start")
    apart = (F.col("start") - F.lag("end").over(along) > gap).cast("int")
    edge = runs.where(near).withColumn("new", F.coalesce(apart, F.lit(0))).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    cols = [*keys, "start", "end", "n"]
    return runs.where(~near).select(*cols).unionByName(edge.select(*cols)).where(F.col("n") > least)


def entropy(values: DataFrame, text: str) -> DataFrame:
    """(text, entropy): Shannon entropy in bits of the characters of each distinct text."""
    chars = values.select(text).where(F.col(text).isNotNull()).distinct().select(text, F.explode(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))).alias("ch"))
    counts = chars.groupBy(text, "ch").agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(text))
    return counts.withColumn("p", p).groupBy(text).agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def id_gaps(rows: DataFrame, keys: list[str], id_col: str, least: int) -> DataFrame:
    """Rows whose id is more than least after the one before."""
    gap = F.col(id_col) - F.lag(id_col).over(Window.partitionBy(*keys).orderBy(id_col))
    return rows.withColumn("gap", gap).where(F.col("gap") > least)


def timestamp_anomalies(files: DataFrame, installed: Column) -> DataFrame:
    """files: (si_created, fn_created). Adds mismatch (over 5 minutes apart), si_first, rounded and before_install."""
    si, fn = F.unix_micros("si_created"), F.unix_micros("fn_created")
    return files.withColumns({"mismatch": F.abs(si - fn) > 300_000_000, "si_first": si < fn, "rounded": si % 1_000_000 == 0, "before_install": F.col("si_created") < installed})


def sequence(first: DataFrame, then: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """(keys, first_id, then_id, lag): pairs where then follows first within seconds. Equi-join on keys and time slot."""
    a = first.select(*keys, F.col("event_id").alias("first_id"), F.col("epoch").alias("at"), F.explode(F.array(F.floor(F.col("epoch") / seconds), F.floor(F.col("epoch") / seconds) + 1)).alias("slot"))
    b = then.select(*keys, F.col("event_id").alias("then_id"), F.col("epoch").alias("next"), F.floor(F.col("epoch") / seconds).alias("slot"))
    return a.join(b, [*keys, "slot"]).where((F.col("next") >= F.col("at")) & (F.col("next") - F.col("at") <= seconds) & (F.col("first_id") != F.col("then_id"))).select(*keys, "first_id", "then_id", (F.col("next") - F.col("at")).alias("lag"))


def cross_host(events: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, hosts, first_seen): what turns up on several hosts."""
    return events.groupBy(*keys).agg(F.count_distinct("host_name").alias("hosts"), F.min("epoch").alias("first_seen")).where(F.col("hosts") >= least)


def single_host(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, host_name): what turns up on one host only."""
    return events.groupBy(*keys).agg(F.count_distinct("host_name").alias("hosts"), F.min("host_name").alias("host_name")).where("hosts = 1").drop("hosts")


def contradictions(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(host_name, a, b): clusters of exclusive families (pairs: type_a, type_b, a short list) on a host whose times overlap."""
    def side(x: str) -> DataFrame:
        return clusters.select("host_name", F.col("cluster_id").alias(x), F.col("constructor").alias(f"type_{x}"), F.col("start_epoch").alias(f"from_{x}"), F.col("end_epoch").alias(f"to_{x}"))

    a, b = side("a").join(pairs.distinct(), "type_a"), side("b")
    return overlapping(a, b, ["host_name", "type_b"], ("from_a", "to_a"), ("from_b", "to_b")).select("host_name", "a", "b")


def intel_match(events: DataFrame, feed: DataFrame, column: str = "remote_ip") -> DataFrame:
    """Events whose column is in the feed (indicator)."""
    return events.join(feed.select(F.col("indicator").alias(column)).distinct(), column, "left_semi")


def carve(rows: DataFrame, text: str, keys: list[str], pattern: str) -> DataFrame:
    """(keys, indicator, n): matches of a pattern in a text column."""
    return rows.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("indicator")).groupBy(*keys, "indicator").agg(F.count(F.lit(1)).alias("n"))


URL = r"https?://[^\s'\"<>]+"
IPV4 = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"
#: Named pipes of known tools: fixed values.
PIPE = r"(?i)\\pipe\\(?:msagent_|postex_|status_|mojo\.|psexesvc|paexec|remcom)"
#: Registry places that persist beyond the run keys: fixed values.
PERSIST = r"(?i)image file execution options.*debugger|appinit_dlls|(?:sethc|utilman|osk|narrator|magnify)\.exe|knowndlls"


#: Ways to hide what a script does: fixed values, by name.
OBFUSCATION = {
    "encoded": r"(?i)frombase64string|(?:^|\s)-e(?:nc|ncodedcommand)?\s+[a-z0-9+/=]{8,}", "char_codes": r"(?i)(?:\[char\]\s*(?:0x[0-9a-f]+|\d+)\W*){3,}", "back_ticks": r"(?:[A-Za-z]`[A-Za-z].*){3,}", "format": r"(?i)(?:\{\d+\}\s*){3,}[\"']\s*-f\b",
    "joined": r"(?i)-join\b|\[array\]::reverse|\.replace\(.*\.replace\(", "evaluated": r"(?i)\biex\b|invoke-expression|&\s*\(\s*[\"'$]", "long_word": r"[A-Za-z0-9+/=]{200,}",
}


def obfuscated_scripts(events: DataFrame, text: Column, least: int = 2) -> DataFrame:
    """Events whose script text (ScriptBlockText of a script-block record, or a command line) hides what it does in least ways: adds ways. One way alone, such as -join, is ordinary."""
    ways = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in OBFUSCATION.items()]))
    return events.select("*", F.explode(F.array(ways)).alias("ways")).where(F.size("ways") >= least)


def pipe_hits(events: DataFrame, column: str = "command_line") -> DataFrame:
    return events.where(F.col(column).rlike(PIPE))


def persistence_extras(events: DataFrame) -> DataFrame:
    return events.where((F.col("canonical_type") == "REGISTRY_MODIFICATION") & F.col("registry_key").rlike(PERSIST))


def service_shells(events: DataFrame) -> DataFrame:
    """Service hosts, services and WMI hosts that start shells; rundll32 without a path or export."""
    parent, proc, cmd = F.lower("parent_name"), F.lower("process_name"), F.lower("command_line")
    shells = parent.isin("svchost.exe", "services.exe", "wmiprvse.exe") & proc.isin("cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe")
    return events.where(F.coalesce(shells, F.lit(False)) | F.coalesce((proc == "rundll32.exe") & ~cmd.rlike(r"rundll32(?:\.exe)?\S*\s+\S+[,\\/]"), F.lit(False)))


def domain_volume(events: DataFrame, domain: str, seconds: int = 60, least: int = 500) -> DataFrame:
    return burst(events, [domain], seconds, least)


def odd_labels(events: DataFrame, domain: str, longest: int = 40) -> DataFrame:
    """Events whose domain has a long, base32- or base64-like first label."""
    label = F.substring_index(domain, ".", 1)
    return events.where((F.char_length(label) >= longest) | label.rlike(r"^[a-z2-7]{24,}$") | label.rlike(r"^[A-Za-z0-9+/_-]{32,}=*$"))


def lateral_counters(logons: DataFrame, failed: Column, source: str, admin_hosts: DataFrame | None = None, maintenance: list[tuple[int, int]] = []) -> DataFrame:  # noqa: B006
    """Adds what speaks against lateral movement: logon_failed, from_admin_host and in_maintenance.

    admin_hosts: (source) of documented workstations. maintenance: spans of hours, the first included, that may go over midnight.
    """
    hour = F.hour("timestamp")
    inside = F.lit(False)
    for x, y in maintenance:
        inside = inside | (((hour >= x) & (hour < y)) if x <= y else ((hour >= x) | (hour < y)))
    rows = logons.withColumns({"logon_failed": F.coalesce(failed, F.lit(False)), "in_maintenance": F.coalesce(inside, F.lit(False))})
    if admin_hosts is None:
        return rows.withColumn("from_admin_host", F.lit(False))
    known = admin_hosts.select(F.col("source").alias(source)).distinct().withColumn("from_admin_host", F.lit(True))
    return rows.join(known, source, "left").na.fill(False, ["from_admin_host"])
