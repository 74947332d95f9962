"""Readers of the tables that forensic tools write, each mapped to one ECS-like row.

A mapped row has doc_id, host_name, ts, artifact, event_code, event_action, event_category and the fields of its kind; what has
no column is in extra. Bad lines and unreadable times give no row, or a null time, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.exprs import basename, computed, doc_id, filled, first_positive, from_epoch, from_filetime, int_of, last_wins, utc_millis, xml_fields
from ..functions.lookups import DATA_TYPES, EVENT_ACTIONS, EVENT_CATEGORIES, LAYOUTS, NAMED_FIELDS, RECORD_TYPES, TIMELINE_EVENTS, TIMELINE_SOURCES
from ..functions.tables import look_up, routed

FIELDS = ["event_code", "event_action", "event_category", "user", "process_name", "process_path", "pid", "ppid", "command_line", "target_file", "remote_ip", "remote_port", "registry_key", "alert_name", "alert_level", "message"]
KINDS = {"pid": "long", "ppid": "long", "remote_port": "int"}
SHIM = "MM/dd/yy HH:mm:ss"


def ecs(df: DataFrame, artifact: str, host: Column, ts: Column, extra: dict[str, Column] | None = None, **fields: Column) -> DataFrame:
    """One row for each of df, all fields in one order, with a deterministic document id."""
    own = {f: fields.get(f, F.lit(None)).cast(KINDS.get(f, "string")) for f in FIELDS}
    own = {f: filled(c) if f not in KINDS else c for f, c in own.items()}
    more = F.lit(None).cast("map<string,string>")
    if extra:
        more = F.map_filter(F.create_map(*[x for k, c in extra.items() for x in (F.lit(k), c.cast("string"))]), lambda _, v: v.isNotNull() & (v != ""))
    out = df.select(host.alias("host_name"), ts.alias("ts"), F.lit(artifact).alias("artifact"), *[c.alias(f) for f, c in own.items()], more.alias("extra"))
    ident = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), *[F.col(f) for f in FIELDS], F.to_json("extra")]
    return out.withColumn("doc_id", doc_id(F.lit(""), F.col("artifact"), F.col("host_name"), *ident))


def csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """All columns as text; absent ones are null, further ones are left out."""
    raw = spark.read.option("header", header).option("sep", sep).option("multiLine", False).option("enforceSchema", False)
    if not header:
        return raw.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    df = raw.csv(path)
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns])


EVENT_XML = "System struct<Provider:struct<_Name:string>,EventID:string,TimeCreated:struct<_SystemTime:string>,Computer:string,Channel:string,EventRecordID:string,Execution:struct<_ProcessID:string>>,EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"


def event_xml(df: DataFrame, column: str = "xml") -> DataFrame:
    """Event records as XML text. What can't be parsed gives no row; an IpAddress of '-' is none."""
    rows = computed(df.select(column), e=F.from_xml(column, EVENT_XML)).where("e.System.EventID IS NOT NULL")
    rows = computed(rows, d=last_wins(F.transform("e.EventData.Data", lambda d: F.struct(d["_Name"].alias("key"), d["_VALUE"].alias("value")))))
    get = lambda *names: F.coalesce(*[filled(F.try_element_at("d", F.lit(n))) for n in names])
    ip = F.nullif(get("IpAddress", "SourceAddress"), F.lit("-"))
    user = F.coalesce(get("TargetUserName"), get("SubjectUserName"))
    out = ecs(rows, "evtx", F.col("e.System.Computer"), utc_millis(F.col("e.System.TimeCreated._SystemTime")), {"channel": F.col("e.System.Channel"), "provider": F.col("e.System.Provider._Name"), "record_id": F.col("e.System.EventRecordID"), "LogonType": get("LogonType")}, event_code=F.col("e.System.EventID"), event_action=look_up(EVENT_ACTIONS, F.col("e.System.EventID")), event_category=look_up(EVENT_CATEGORIES, F.col("e.System.EventID")), user=user, process_path=get("NewProcessName", "Image"), process_name=basename(get("NewProcessName", "Image")), pid=int_of(get("NewProcessId", "ProcessId")), command_line=get("CommandLine"), target_file=get("TargetFilename", "ObjectName"), registry_key=get("TargetObject"), remote_ip=F.coalesce(get("DestinationIp", "DestAddress"), ip), remote_port=get("DestinationPort", "DestPort").try_cast("int"))
    return out


def event_csv(df: DataFrame) -> DataFrame:
    """Event rows with a JSON payload of EventData.Data[{@Name, #text}]."""
    data = F.from_json("Payload", "EventData struct<Data:array<struct<`@Name`:string,`#text`:string>>>")["EventData"]["Data"]
    rows = computed(df, d=last_wins(F.transform(data, lambda x: F.struct(x["@Name"].alias("key"), x["#text"].alias("value")))))
    get = lambda n: filled(F.try_element_at("d", F.lit(n)))
    return ecs(rows, "evtx", F.col("Computer"), utc_millis(F.col("TimeCreated")), {"channel": F.col("Channel"), "provider": F.col("Provider"), "LogonType": get("LogonType")}, event_code=F.col("EventId"), event_action=F.coalesce(look_up(EVENT_ACTIONS, F.col("EventId")), F.col("MapDescription")), event_category=look_up(EVENT_CATEGORIES, F.col("EventId")), user=F.coalesce(filled(F.col("UserName")), get("TargetUserName")), command_line=F.coalesce(get("CommandLine"), filled(F.col("ExecutableInfo"))), process_path=get("NewProcessName"), process_name=basename(get("NewProcessName")), pid=int_of(get("NewProcessId")), remote_ip=get("IpAddress"), registry_key=get("TargetObject"), target_file=get("TargetFilename"))


def event_jsonl(df: DataFrame) -> DataFrame:
    return ecs(df, "evtx", F.col("Computer"), utc_millis(F.col("TimeCreated")), {"channel": F.col("Channel"), "provider": F.col("Provider")}, event_code=F.col("EventId"), event_action=F.col("MapDescription"), user=F.col("UserName"), message=F.concat_ws(" ", *[F.col(f"PayloadData{k}") for k in range(1, 7)]))


def file_table(df: DataFrame, host: str) -> DataFrame:
    """Files in use; timestomped is 'possible' where the two creation times differ."""
    path = F.concat_ws("\\", "ParentPath", "FileName")
    odd = F.when(F.col("Created0x10") != F.col("Created0x30"), "possible")
    return ecs(df.where("InUse = 'True'"), "mft", F.lit(host), utc_millis(F.col("Created0x10")), {"size": F.col("FileSize"), "modified": F.col("LastModified0x10"), "created_fn": F.col("Created0x30"), "timestomped": odd}, target_file=path, event_category=F.lit("file"))


def registry_csv(df: DataFrame, host: str) -> DataFrame:
    return ecs(df, "registry", F.lit(host), utc_millis(F.col("LastWriteTimestamp")), {"hive": F.col("HivePath"), "value": F.col("ValueName"), "data": F.col("ValueData"), "description": F.col("Description")}, registry_key=F.col("KeyPath"), event_category=F.lit("registry"))


def prefetch_csv(df: DataFrame, host: str) -> DataFrame:
    before = F.array_join(F.array_compact(F.array(*[filled(F.col(f"PreviousRun{k}")) for k in range(3)])), ";")
    return ecs(df, "prefetch", F.lit(host), utc_millis(F.col("LastRun")), {"run_count": int_of(F.col("RunCount")), "previous_runs": before, "hash": F.col("Hash")}, process_name=F.col("ExecutableName"), event_category=F.lit("process"))


def amcache_csv(df: DataFrame, host: str) -> DataFrame:
    rows = df.where((F.coalesce("FullPath", F.lit("")) != "") | (F.coalesce("SHA1", F.lit("")) != ""))
    return ecs(rows, "amcache", F.lit(host), utc_millis(F.col("FileKeyLastWriteTimestamp")), {"sha1": F.col("SHA1"), "publisher": F.col("Publisher"), "version": F.col("FileVersion"), "link_date": F.col("LinkDate"), "is_pe": F.col("IsPeFile")}, process_path=F.col("FullPath"), process_name=basename(F.col("FullPath")), event_category=F.lit("process"))


def shimcache_csv(df: DataFrame, host: str) -> DataFrame:
    """Either header: (Path, LastModifiedTimeUTC, Executed) or (Path, Last Modified, Exec Flag)."""
    get = lambda a, b: F.coalesce(*[F.col(f"`{c}`") for c in (a, b) if c in df.columns])
    at = get("LastModifiedTimeUTC", "Last Modified")
    return ecs(df, "shimcache", F.lit(host), F.coalesce(utc_millis(at, SHIM), utc_millis(at)), {"executed": get("Executed", "Exec Flag")}, process_path=F.col("Path"), process_name=basename(F.col("Path")), event_category=F.lit("process"))


def srum_csv(df: DataFrame, host: str) -> DataFrame:
    return ecs(df, "srum", F.lit(host), utc_millis(F.col("Timestamp")), {"sent": F.col("BytesSent").try_cast("long"), "received": F.col("BytesRecvd").try_cast("long"), "foreground": F.col("ForegroundCycleTime").try_cast("long"), "profile": F.col("ProfileName")}, process_path=F.col("ExeInfo"), process_name=basename(F.col("ExeInfo")), event_category=F.lit("network"))


def alerts(df: DataFrame) -> DataFrame:
    """Alerts of rule engines, whatever their field names: flat, spaced, or nested under document.Event."""
    def first(*names: str) -> Column:
        have = [F.col(".".join(f"`{p}`" for p in n.split("/"))).cast("string") for n in names if n.split("/")[0] in df.columns]
        return F.coalesce(*[filled(c) for c in have], F.lit(None).cast("string"))

    return ecs(df, "alert", first("Computer", "computer", "document/Event/System/Computer"), utc_millis(first("Timestamp", "timestamp")), {"details": first("Details", "details"), "author": first("author")}, event_code=first("EventID", "Event ID", "document/Event/System/EventID"), event_action=F.lit("sigma-alert"), event_category=F.lit("intrusion_detection"), alert_name=first("RuleTitle", "Rule Title", "name"), alert_level=F.lower(first("Level", "Rule Level", "level")))


def memory(df: DataFrame, plugin: str, host: str) -> DataFrame:
    """Rows of a memory plugin as maps of text in column row; keys in any case. Without a name and a pid a row is dropped, except connections."""
    low = computed(df, m=last_wins(F.transform(F.map_entries("row"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    get = lambda *names: F.coalesce(*[filled(F.try_element_at("m", F.lit(n))) for n in names])
    name, pid = get("imagefilename", "process", "name", "owner"), int_of(get("pid"))
    rows = low if "netscan" in plugin else low.where(name.isNotNull() | pid.isNotNull())
    return ecs(rows, "memory", F.lit(host), utc_millis(get("createtime", "created")), {"plugin": F.lit(plugin), "private_memory": get("privatememory"), "protection": get("protection"), "hexdump": F.substring(get("hexdump"), 1, 500), "state": get("state")}, process_name=name, pid=pid, ppid=int_of(get("ppid")), command_line=get("args", "cmdline"), remote_ip=get("foreignaddr"), remote_port=get("foreignport").try_cast("int"), process_path=get("path"))


def scan_text(df: DataFrame, host: str) -> DataFrame:
    """Lines 'RULE [namespace] path:offset' of a signature scanner."""
    part = lambda k: F.regexp_extract("value", r"^(\S+) \[([^\]]*)\] (.*):(\d+)$", k)
    return ecs(df.where(part(1) != ""), "yara", F.lit(host), F.lit(None).cast("timestamp"), {"namespace": part(2), "offset": part(4)}, alert_name=part(1), target_file=part(3), event_category=F.lit("malware"))


EVENT_ROWS = "WinEVTX"
CSV_ROUTES = {(EVENT_ROWS, k): (None, *v) for k, v in TIMELINE_EVENTS.items()} | {("", k): v for k, v in TIMELINE_SOURCES.items()}


def timeline_csv(df: DataFrame, aliases: dict[str, str] | None = None, host: str | None = None) -> DataFrame:
    """17-column timelines. Event rows are routed by the event id in their XML, an unknown one to a process; other rows by their source type, an unknown one to an artifact.

    Only event rows have a command line. Hosts are cut at the first dot, and renamed by aliases; one without an alias keeps its name, or becomes
    host where that is given.
    """
    have = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    rows = computed(df, d=F.map_filter(xml_fields(F.regexp_replace(have("extra"), r"(?i)<Data\s+Name=\"([^\"]+)\"\s*>\s*([^<]*?)\s*</Data>", '<Data Name="$1">$2</Data>')), lambda _, v: ~v.isin("", "-")))
    rows = rows.withColumn("is_event", F.trim(have("sourcetype")) == EVENT_ROWS)
    xml = lambda pattern: F.when(F.col("is_event"), filled(F.regexp_extract(have("extra"), pattern, 1)))
    get = lambda *names: F.when(F.col("is_event"), F.coalesce(*[F.try_element_at("d", F.lit(n)) for n in names]))
    rows = rows.withColumn("event_id", xml(r"<EventID(?:\s[^>]*)?>(\d+)</EventID>"))
    rows = routed(rows, CSV_ROUTES, F.when(F.col("is_event"), EVENT_ROWS).otherwise(""), F.when(F.col("is_event"), F.col("event_id")).otherwise(F.trim(have("sourcetype"))), ["r_code", "r_action", "r_category"])
    action = F.coalesce("r_action", F.when(F.col("is_event"), "evtx-unknown").otherwise("artifact"))
    category = F.coalesce("r_category", F.when(F.col("is_event"), "process").otherwise("artifact"))
    code = F.coalesce("event_id", "r_code", action)
    path = filled(F.regexp_replace(have("filename"), "^TSK:", ""))
    program = F.when(F.col("is_event"), get("ProcessName")).when(category == "process", path)
    user, target, sid = F.trim(have("user")), get("TargetUserName", "SubjectUserName"), xml(r'UserID="([^"]+)"')
    user = F.when(target.isNotNull() & user.isin("", "-", "systemprofile", "SYSTEM"), target).when(target.isNull() & sid.isNotNull() & user.isin("", "-", "systemprofile"), sid).otherwise(user)
    ip = get("IpAddress")
    ip = F.when(~ip.isin("::1", "127.0.0.1"), ip)
    bare = F.nullif(F.nullif(F.substring_index(have("host"), ".", 1), F.lit("")), F.lit("-"))
    named = F.coalesce(*([look_up(aliases, bare)] if aliases else []), F.lit(host) if host else bare)
    at = F.date_trunc("millisecond", F.try_to_timestamp(F.concat_ws(" ", F.trim("date"), F.trim("time")), F.lit("MM/dd/yyyy HH:mm:ss")))
    cut = lambda c: F.substring(c, 1, 512)
    more = {"sourcetype": F.trim(have("sourcetype")), "source": have("source"), "short": cut(have("short")), "channel": xml(r"<Channel>([^<]+)</Channel>"), "LogonType": get("LogonType"), "TargetUserName": target, "WorkstationName": get("WorkstationName"), "version": have("version"), "notes": have("notes"), "format": have("format")}
    return ecs(rows, "timeline", named, at, more, event_code=code, event_action=action, event_category=category, user=user, pid=xml(r'ProcessID="(\d+)"'), process_path=program, process_name=basename(program), command_line=F.substring(get("CommandLine", "ProcessCommandLine"), 1, 2048), target_file=cut(path), remote_ip=ip, message=cut(have("desc")))


JSON_ROUTES = {("", k): (v,) for k, v in DATA_TYPES.items()} | {("record", k): (v,) for v, ids in RECORD_TYPES.items() for k in ids}


def positional(message: Column, event_id: Column) -> Column:
    """The items of 'Strings: [...]' under the names that an event id gives to their places; '' and '-' are none, None keeps its place."""
    body = F.regexp_extract(message, r"(?s)Strings:\s*\[(.*?)\](?:\s+Computer Name|\s+Record Number|\s*$)", 1)
    item = lambda t: F.when(t.startswith("'"), F.substring(t, F.lit(2), F.char_length(t) - 2)).when(t == "None", "").otherwise(F.trim(t))
    items = F.transform(F.regexp_extract_all(body, F.lit(r"'(?:[^'\\]|\\.)*'|None|[^,\s][^,]*"), F.lit(0)), item)
    names = F.split(look_up({k: ",".join(v) for k, v in LAYOUTS.items()}, event_id), ",")
    return last_wins(F.filter(F.zip_with(names, items, lambda n, v: F.struct(n.alias("key"), v.alias("value"))), lambda p: ~F.coalesce(p["value"], F.lit("")).isin("", "-")))


def timeline_json(df: DataFrame, host: str | None = None) -> DataFrame:
    """Timeline events of one object a line: FILETIME, else microseconds; typed by data type, event records by their event id.

    Fields of an event record come from its strings by position, else from names in the message. An unknown event record is a
    process, any other unknown type an alert. Containers that are no event give no row.
    """
    have = lambda *names: F.coalesce(*[filled(F.col(c).cast("string")) for c in names if c in df.columns], F.lit(None).cast("string"))
    if "__container_type__" in df.columns:
        df = df.where("`__container_type__` = 'event'")
    ticks = F.col("date_time.timestamp") if "date_time" in df.columns else have("filetime")
    ticks, micros = ticks.try_cast("long"), have("timestamp").try_cast("long")
    at = F.coalesce(F.when(ticks > 0, from_filetime(ticks)), F.when(micros != 0, F.timestamp_micros(micros)))
    code, kind, message = have("event_identifier", "event_id"), F.coalesce(have("data_type"), F.lit("")), have("message", "xml_string", "display_name")
    named = last_wins(F.array(*[F.struct(F.lit(k).alias("key"), filled(F.regexp_extract(message, k + r"[:\s=]+([^\s,;'\"\)]+)", 1)).alias("value")) for k in NAMED_FIELDS]))
    rows = computed(df, named=named, placed=positional(message, code))
    rows = routed(rows, JSON_ROUTES, F.when((kind == "windows:evtx:record") & code.isNotNull(), "record").otherwise(""), F.when((kind == "windows:evtx:record") & code.isNotNull(), code).otherwise(kind), ["r_type"])
    get = lambda *names: F.coalesce(*[F.coalesce(F.try_element_at("placed", F.lit(n)), F.try_element_at("named", F.lit(n))) for n in names])
    type_ = F.coalesce("r_type", F.when((kind == "windows:evtx:record") & code.isNotNull(), "PROCESS_EXECUTION").when(kind != "", "ALERT"))
    category = F.when(F.contains(kind, F.lit("evtx")) | F.contains(kind, F.lit("execution")), "process").otherwise("artifact")
    name = F.coalesce(get("NewProcessName", "ProcessName"), have("process_name"))
    more = {"canonical_type": type_, "data_type": kind, "channel": have("source_name", "channel"), "LogonType": get("LogonType"), "service_name": get("ServiceName"), "strings": F.to_json("placed")}
    return ecs(
        rows, "plaso", F.lit(host) if host else have("computer_name"), at, more, event_code=F.coalesce(code, kind), event_action=kind, event_category=category, user=F.coalesce(get("TargetUserName", "SubjectUserName", "AccountName"), have("user", "username")),
        command_line=get("CommandLine", "ProcessCommandLine"), process_name=name, process_path=F.coalesce(have("process_executable"), get("ImagePath", "ServiceFileName"), name), remote_ip=get("IpAddress", "ClientAddress"), registry_key=have("key_path", "registry_key"),
        target_file=F.coalesce(have("filename"), get("ObjectName"), have("display_name")), message=F.substring(message, 1, 1500),
    )


def _program(args: Column) -> Column:
    """The first word of a command line as a shell reads it: quotes go, and outside of them a backslash stands for the character after it; without a closing quote, what comes before the first blank."""
    word = F.regexp_extract(args, r"^(\S+)", 1)
    return (
        F.when(args.rlike(r'^"(?:[^"\\]|\\.)*"(?:\s|$)'), F.regexp_replace(F.regexp_extract(args, r'^"((?:[^"\\]|\\.)*)"', 1), r'\\(["\\])', "$1")).when(args.rlike(r"^'[^']*'(?:\s|$)"), F.regexp_extract(args, r"^'([^']*)'", 1))
        .when(~word.rlike("[\"']") & (F.regexp_count(args, F.lit("[\"']")) % 2 == 0) & ~args.rlike(r"\\$"), F.regexp_replace(word, r"\\(.)", "$1")).otherwise(F.regexp_replace(F.regexp_extract(args, r"^([^ ]*)", 1), "^[\"']+|[\"']+$", ""))
    )


def memory_tables(host: str, collected: Column, processes: DataFrame | None = None, hooks: DataFrame | None = None, services: DataFrame | None = None, registry: DataFrame | None = None, hits: DataFrame | None = None, indicators: DataFrame | None = None) -> DataFrame:
    """The tables of a memory image, those that there are: a row for each record of each.

    collected is the time of what has none of its own: hooks, services and hits. A hit has the name and folder of its process (ProcessID is the
    ID there), or neither where the process is not in the table; several hits of a process are rows of their own.
    """
    out = []
    if processes is not None:
        args = F.trim(F.coalesce("Arguments", F.lit("")))
        name = F.coalesce(filled(F.col("ProcessName")), filled(F.regexp_replace(F.substring_index(F.substring_index(args, "\\", -1), " ", 1), '^"+|"+$', "")))
        folder = filled(F.col("Path"))
        program = F.coalesce(filled(_program(args)), F.when(name.isNotNull(), F.concat(folder, F.lit("\\"), name)).otherwise(folder))
        more = {"hidden": F.coalesce(filled(F.col("Hidden").cast("string")), F.lit("False")), "working_dir": folder, "sid": F.col("SID")}
        out.append(ecs(processes, "memory_image", F.lit(host), utc_millis(F.col("StartTime").cast("string")), more, event_action=F.lit("process-started"), event_category=F.lit("process"), pid=F.col("PID"), ppid=F.col("ParentPID"), process_name=name, process_path=program, command_line=F.coalesce(filled(args), program), user=F.col("Username")))
    if hooks is not None:
        more = {x: F.col(y) for x, y in (("description", "HookDescription"), ("function", "HookedFunction"), ("module", "HookedModule"), ("by", "HookingModule"), ("address", "HookingAddress"))}
        out.append(ecs(hooks, "memory_image", F.lit(host), collected, more, event_action=F.lit("api-hook-detected"), event_category=F.lit("intrusion_detection"), alert_name=F.lit("API Hook Detected")))
    if services is not None:
        more = {x: F.col(y) for x, y in (("service_name", "Name"), ("display_name", "DescriptiveName"), ("path", "Path"), ("type", "ServiceType"), ("start_type", "Mode"), ("state", "ServiceStatus"), ("dll", "ServiceDLL"), ("from_persistence", "FromPersistence"))}
        out.append(ecs(services, "memory_image", F.lit(host), collected, more, event_action=F.lit("service-installed"), event_category=F.lit("configuration")))
    if registry is not None:
        more = {"hive": F.col("Hive"), "value": F.col("TextValue"), "type": F.col("RegistryType"), "from_persistence": F.col("FromPersistence")}
        out.append(ecs(registry, "memory_image", F.lit(host), utc_millis(F.col("Modified").cast("string")), more, event_action=F.lit("registry-modified"), event_category=F.lit("registry"), registry_key=F.col("KeyPath")))
    if hits is not None:
        of = processes.select(F.col("ID").alias("ProcessID"), "ProcessName", "Path") if processes is not None else hits.sparkSession.createDataFrame([], "ProcessID long, ProcessName string, Path string")
        more = {"hit_type": F.col("HitType"), "score_modifier": F.col("ScoreModifier"), "description": F.col("HitDescription")}
        out.append(ecs(hits.join(of, "ProcessID", "left"), "memory_image", F.lit(host), collected, more, event_action=F.lit("malware-risk-index-hit"), event_category=F.lit("malware"), process_name=F.col("ProcessName"), process_path=F.col("Path"), alert_name=F.coalesce(filled(F.col("RuleID").cast("string")), F.lit("MRI Hit"))))
    if indicators is not None:
        out.append(ecs(indicators, "memory_image", F.lit(host), utc_millis(F.col("MatchTimestamp").cast("string")), {"indicator_id": F.col("IndicatorId")}, event_action=F.lit("ioc-match"), event_category=F.lit("intrusion_detection"), alert_name=F.coalesce(filled(F.col("AlertEventType")), F.lit("IOC Alert"))))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


BODY = ["md5", "name", "inode", "mode", "uid", "gid", "size", "atime", "mtime", "ctime", "crtime"]


def bodyfile(df: DataFrame, host: str) -> DataFrame:
    at = from_epoch(first_positive(*[F.col(c).try_cast("long") for c in ("mtime", "crtime", "atime", "ctime")]))
    return ecs(df, "bodyfile", F.lit(host), at, {"md5": F.col("md5"), "size": F.col("size"), "mode": F.col("mode")}, target_file=F.col("name"), event_category=F.lit("file"))


# fixed values: names of fields that may hold a record's time
TIME_KEYS = ["@timestamp", "timestamp", "time", "date", "datetime", "created", "creation_time", "created_at", "modified", "mtime", "modified_at", "accessed", "atime", "accessed_at", "last_run", "lastrun", "last_seen", "event_time", "eventtime", "log_time", "crtime", "ctime", "birth"]


def generic(df: DataFrame, host: str) -> DataFrame:
    """Any record as a map of text in column row: the first usable time of TIME_KEYS, in any case, the rest kept."""
    low = last_wins(F.transform(F.map_entries("row"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    df = computed(df, m=low)
    at = F.coalesce(*[F.coalesce(utc_millis(F.try_element_at("m", F.lit(k))), from_epoch(F.try_element_at("m", F.lit(k)).try_cast("double"))) for k in TIME_KEYS])
    return ecs(df, "generic", F.lit(host), at, {"record": F.to_json("row")}, message=F.coalesce(F.try_element_at("row", F.lit("message")), F.try_element_at("row", F.lit("msg"))))


def carved(df: DataFrame, host: str) -> DataFrame:
    return ecs(df, "carved", F.lit(host), F.lit(None).cast("timestamp"), {"type": F.col("Type"), "offset": F.col("Offset")}, message=F.col("Hit"))


def beacon_config(df: DataFrame, host: str) -> DataFrame:
    return ecs(df, "beacon", F.lit(host), F.lit(None).cast("timestamp"), {"domains": F.to_json("domains"), "ports": F.to_json("ports"), "watermark": F.col("watermark")}, alert_name=F.lit("cobalt strike beacon config"), event_category=F.lit("malware"))


def file_listing(spark: SparkSession, path: str, host: str) -> DataFrame:
    """A metadata row for each evidence file, without reading contents."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return ecs(df, "file", F.lit(host), F.date_trunc("millisecond", "modificationTime"), {"size": F.col("length")}, target_file=F.col("path"), event_category=F.lit("artifact"))


def hash_list(spark: SparkSession, path: str) -> DataFrame:
    """(md5): lines of 32 hex digits; anything else, comments included, is skipped."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("md5")).where(F.col("md5").rlike("^[0-9a-f]{32}$")).distinct()


def not_yet_ingested(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.join(manifest.select("host_name", "artifact", "target_file"), ["host_name", "artifact", "target_file"], "left_anti")


def write_ecs(df: DataFrame, path: str) -> None:
    """Each document once, in one folder for each artifact and host; documents that path holds already are left out."""
    rows = df.dropDuplicates(["doc_id"])
    try:
        have = df.sparkSession.read.schema(df.schema).parquet(path).select("doc_id")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        rows = rows.join(have, "doc_id", "left_anti")
    rows.write.mode("append").partitionBy("artifact", "host_name").parquet(path)


READERS: dict[str, Callable] = {f.__name__: f for f in (event_xml, event_csv, event_jsonl, file_table, registry_csv, prefetch_csv, amcache_csv, shimcache_csv, srum_csv, alerts, memory, scan_text, timeline_csv, timeline_json, memory_tables, bodyfile, generic, carved, beacon_config)}
