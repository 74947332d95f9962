"""Scalar functions as Columns. Text that can't be read gives null, never an error; nothing depends on the clock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .lookups import BINARIES, CAUSAL_PHRASES, EXTENSIONS, FILE_NAMES, GATE_PHRASES, HARMLESS, HIVES, HOOK_PREFIXES, LIBRARY_FOLDERS, PATH_PARTS, SCRIPTS, SHELL_PREFIXES, SUSPICIOUS_PLACES, SYSTEM_FOLDERS
from .tables import look_up

INTERNAL = r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"


def filled(c: Column) -> Column:
    """'' counts as missing."""
    return F.nullif(c, F.lit(""))


def utc_millis(text: Column, *formats: str) -> Column:
    """A timestamp cut to milliseconds, by the formats in turn, or ISO 8601 where none is given."""
    t = filled(F.trim(text))
    tried = [F.try_to_timestamp(t, F.lit(f)) for f in formats] or [F.try_to_timestamp(t)]
    return F.date_trunc("millisecond", F.coalesce(*tried))


def from_filetime(ft: Column) -> Column:
    """100 ns since 1601."""
    return F.timestamp_micros(F.floor(ft / 10) - F.lit(11644473600000000))


def from_epoch(n: Column) -> Column:
    """Seconds, milliseconds, microseconds or 100 ns, told apart by magnitude."""
    micros = F.when(n > 10**16, n / 10).when(n > 10**14, n).when(n > 10**11, n * 1000).otherwise(n * 1000000)
    return F.timestamp_micros(micros.cast("long"))


def first_positive(*cols: Column) -> Column:
    return F.coalesce(*[F.when(c > 0, c) for c in cols])


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[ /\\]", "-"))


def index_name(case: Column, artifact: Column, host: Column) -> Column:
    return F.concat_ws("-", F.lit("case"), slug(case), slug(artifact), slug(host))


def short_hash(*cols: Column, size: int = 32) -> Column:
    """The first hex digits of the SHA-256 of the parts, joined by ':'."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256), 1, size)


def doc_id(case: Column, artifact: Column, host: Column, *fields: Column) -> Column:
    return short_hash(case, artifact, host, *fields, size=64)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]+)$", 1)


def int_of(text: Column) -> Column:
    """Decimal, or hexadecimal after 0x."""
    t = F.lower(F.trim(text))
    return F.when(t.startswith("0x"), F.conv(F.substring(t, 3, 32), 16, 10)).otherwise(t).try_cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def last_wins(pairs: Column) -> Column:
    """A map of pairs (key, value); the last of equal keys wins, a null key is left out. Sorted by key and place, so that the last of each key is next to another one."""
    numbered = F.filter(F.transform(pairs, lambda p, k: F.struct(p["key"].alias("key"), k.alias("at"), p["value"].alias("value"))), lambda p: p["key"].isNotNull())
    last = let(F.array_sort(numbered), lambda s: F.filter(s, lambda p, k: ~F.get(s, k + 1)["key"].eqNullSafe(p["key"])))
    return F.coalesce(F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"]))), F.create_map().cast("map<string,string>"))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each computed once: the optimizer copies a projection into whatever takes parts of it, but no generator."""
    for name, c in columns.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def xml_fields(xml: Column) -> Column:
    """All <Data Name="k">v</Data> pairs as a map; the last of equal names wins."""
    found = [F.regexp_extract_all(xml, F.lit(r'<Data Name="([^"]+)">([^<]*)</Data>'), F.lit(k)) for k in (1, 2)]
    return last_wins(F.zip_with(*found, lambda k, v: F.struct(k.alias("key"), v.alias("value"))))


def key_value(text: Column, name: str) -> Column:
    return filled(F.regexp_extract(text, rf"(?i)\b{name}\s*[:=]\s*([^\s,;]+)", 1))


def short_host(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def is_internal(ip: Column, loopback: str = "exact", link_local: bool = False) -> Column:
    """Private address. loopback: 'exact' for 127.0.0.1 and ::1, 'any' for all of 127/8."""
    loop = ip.isin("127.0.0.1", "::1") if loopback == "exact" else (ip.startswith("127.") | (ip == "::1"))
    out = ip.rlike(INTERNAL) | loop
    return out | ip.startswith("169.254.") if link_local else out


def cluster_tier(score: Column) -> Column:
    return F.when(score >= 70, "STRONG").when(score >= 40, "MODERATE").when(score >= 20, "WEAK").otherwise("NOISE")


def cluster_score(base: Column, support: Column, counter: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), base + support - counter))


def confidence_tier(score: Column) -> Column:
    return F.when(score >= 76, "HIGH").when(score >= 51, "MEDIUM").when(score >= 31, "LOW").otherwise("SPECULATIVE")


def provenance(audit_id: Column, tool_prefix: str = "tool-") -> Column:
    """MCP for ids that tool calls give (tool_prefix), HOOK and SHELL by their prefixes, NONE for anything else."""
    starts = lambda prefixes: audit_id.rlike("^(?:" + "|".join(prefixes) + ")")
    return F.when(audit_id.startswith(tool_prefix), "MCP").when(starts(HOOK_PREFIXES), "HOOK").when(starts(SHELL_PREFIXES), "SHELL").otherwise("NONE")


def weakest(ids: Column, tool_prefix: str = "tool-") -> Column:
    """The weakest provenance of a list: NONE, SHELL, HOOK, MCP; an empty or missing list is NONE."""
    kinds = F.transform(ids, lambda x: provenance(x, tool_prefix))
    out = F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, "NONE")
    for kind in ("NONE", "SHELL", "HOOK"):
        out = out.when(F.array_contains(kinds, kind), kind)
    return out.otherwise("MCP")


def claims_cause(text: Column, phrases: list[str] = CAUSAL_PHRASES) -> Column:
    """Whether a text claims a cause; where a hypothesis is staged, GATE_PHRASES count instead."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(phrases))


def is_technique(c: Column) -> Column:
    return c.rlike(r"^T\d+(\.\d+)?$")


def json_text(text: Column) -> Column:
    """A text in quotes as JSON writes it in ASCII: two-letter escapes, and four hexadecimal digits for any other character outside of it, two of them beyond U+FFFF."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    short = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}

    def one(c: Column) -> Column:
        n = F.ascii(c)
        out = F.when(n.between(32, 126), c)
        for x, y in short.items():
            out = out.when(c == x, y)
        return out.when(n > 0xFFFF, F.concat(code(55296 + F.shiftright(n - 65536, 10)), code(56320 + (n - 65536).bitwiseAND(1023)))).otherwise(code(n))

    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r'(["\\])', r"\\$1")
    odd = F.array_join(F.transform(F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)), one), "")
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[^ -~]"), odd).otherwise(plain), F.lit('"'))


def content_hash(title: Column, observation: Column, interpretation: Column, techniques: Column) -> Column:
    """The first 32 digits of the SHA-256 of a JSON object with sorted keys and blanks after its marks; techniques stay in their order."""
    ids = F.array_join(F.transform(F.coalesce(techniques, F.array().cast("array<string>")), json_text), ", ")
    parts = [F.lit('{"interpretation": '), json_text(interpretation), F.lit(', "observation": '), json_text(observation), F.lit(', "technique_ids": ['), ids, F.lit('], "title": '), json_text(title), F.lit("}")]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def evidence_type(path: Column) -> Column:
    """What a collected file is: by extension, else by how its name starts, as a registry hive, by a part of its path, or unknown."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    name = F.regexp_extract(p, r"([^/]+)$", 1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    out = F.when(look_up(EXTENSIONS, suffix).isNotNull(), look_up(EXTENSIONS, suffix))
    for start, kind in FILE_NAMES.items():
        out = out.when(name.startswith(start), kind)
    out = out.when(name.isin(*HIVES) | (suffix == ".hve"), "registry")
    for part, kind in PATH_PARTS.items():
        out = out.when(F.contains(p, F.lit(part)), kind)
    return out.when((suffix == ".xml") & F.contains(p, F.lit("tasks")), "scheduled_task_xml").otherwise("unknown")


def wanted(path: Column) -> Column:
    """Triage: known kinds and scripts pass, then programs and documents in suspicious places; system folders don't, fewer of them for libraries; other programs pass, harmless extensions don't."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    suffix = F.regexp_extract(p, r"[^/](\.[^./]+)$", 1)
    holds = lambda parts: F.coalesce(*[F.when(F.contains(p, F.lit(x)), True) for x in parts], F.lit(False))
    system = F.when(suffix == ".dll", holds(LIBRARY_FOLDERS)).otherwise(holds(SYSTEM_FOLDERS))
    known = (evidence_type(path) != "unknown") | suffix.isin(SCRIPTS) | (suffix.isin(BINARIES) & holds(SUSPICIOUS_PLACES))
    return F.when(known, True).when(system, False).when(suffix.isin(BINARIES), True).otherwise(~suffix.isin(HARMLESS))


def summary_line(*parts: Column, size: int = 100) -> Column:
    return F.concat_ws(" | ", *[F.substring(filled(p), 1, size) for p in parts])
