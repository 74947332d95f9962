"""DuckDB SQL of the registered queries.

What triggers test is printed from the rule data, and held against hand-written events by the tests. What signals and counters
test is written here a second time, by hand, so that a wrong word or weight shows.
"""

from __future__ import annotations

from ..operators.rules import FAMILIES, Family
from ..sources.driver import EV, RU


def duck(rule: str) -> str:
    return rule.replace("endswith(", "ends_with(").replace("regexp_like(", "regexp_matches(").replace(", r'", ", '")


def bucket(window: int | None) -> str:
    return "0" if window is None else "epoch" if window <= 0 else f"epoch - epoch % {window}"


def hits(f: Family) -> str:
    who = "coalesce(\"user\", '')" if f.name == "SuspiciousLineage" else "NULL::VARCHAR"
    return " UNION ALL ".join(f"SELECT event_id, case_id, host_name, epoch, \"user\", remote_ip, '{f.name}' AS constructor, {bucket(f.window)} AS bucket, '{t.name}' AS trigger, {t.base} AS base, {who} AS who FROM ru WHERE {duck(t.when)}" for t in f.triggers)


def hits_by_trigger(f: Family) -> str:
    return f"WITH {RU}, h AS ({hits(f)}) SELECT host_name, trigger, count(*) AS n FROM h GROUP BY ALL"


HITS = f"{RU}, h AS ({' UNION ALL '.join(hits(f) for f in FAMILIES)})"
GROUPS = f"""{HITS}, g AS (SELECT case_id, constructor, host_name, bucket, who, list_sort(list(DISTINCT trigger)) AS triggers, max(base) AS base, count(DISTINCT event_id) AS n_members, min(epoch) AS start_epoch, max(epoch) AS end_epoch,
  'cluster-' || sha256(constructor || '|' || host_name || '|' || bucket || coalesce('|' || who, ''))[1:16] AS cluster_id FROM h GROUP BY ALL)"""
COMMON = """,
cp AS (SELECT host_name, proc FROM ru WHERE kind = 'PROCESS_EXECUTION' AND proc <> '' GROUP BY ALL HAVING count(*) > 100),
fl AS (SELECT host_name, usr, min(epoch) AS first_logon FROM ru WHERE kind = 'AUTHENTICATION' AND usr <> '' GROUP BY ALL),
en AS (SELECT ru.*, cp.proc IS NOT NULL AS common_process, first_logon FROM ru LEFT JOIN cp ON ru.host_name = cp.host_name AND ru.proc = cp.proc LEFT JOIN fl ON ru.host_name = fl.host_name AND ru.usr = fl.usr),
mb AS (SELECT DISTINCT g.cluster_id, g.constructor AS family, h.event_id FROM g JOIN h ON g.constructor = h.constructor AND g.host_name = h.host_name AND g.bucket = h.bucket AND g.who IS NOT DISTINCT FROM h.who),
fe AS (SELECT family, cluster_id, arg_min(en, (en.timestamp, en.event_id)) AS f, bool_or(common_process) AS common_member,
  bool_or(kind = 'PROCESS_EXECUTION' AND ends_with(ppath, proc) AND regexp_matches(ppath, '/(windows/(system32|syswow64|winsxs)|program files( \\(x86\\))?)/[^/]*$')
    AND proc IN ('svchost.exe', 'lsass.exe', 'csrss.exe', 'smss.exe', 'wininit.exe', 'services.exe', 'spoolsv.exe', 'winlogon.exe', 'explorer.exe', 'taskhost.exe', 'dwm.exe', 'conhost.exe', 'rundll32.exe', 'taskmgr.exe', 'regedit.exe', 'cmd.exe', 'powershell.exe', 'msiexec.exe', 'wuauclt.exe', 'trustedinstaller.exe')) AS system_member
  FROM mb JOIN en USING (event_id) GROUP BY ALL)"""


def al(*words: str) -> str:
    return "bool_or(kind = 'ALERT' AND (" + " OR ".join(f"alert LIKE '%{w}%'" for w in words) + "))"


def pr(*words: str) -> str:
    return "bool_or(kind = 'PROCESS_EXECUTION' AND (" + " OR ".join(f"contains(cmd, '{w}')" for w in words) + "))"


def fi(*words: str) -> str:
    return "bool_or(" + " OR ".join(f"contains(tfile, '{w}')" for w in words) + ")"


_ip = "CASE WHEN ip NOT IN ('', '127.0.0.1', '::1') AND NOT starts_with(ip, '10.') AND NOT starts_with(ip, '192.168.') AND NOT (starts_with(ip, '172.') AND split_part(ip, '.', 2)::INT BETWEEN 16 AND 31) THEN ip END"
_late = "bool_or(hour NOT BETWEEN 9 AND 16)"
_attack = al("lateral", "persistence", "credential", "defense evasion")
_kept = "bool_or(kind IN ('REGISTRY_MODIFICATION', 'SERVICE_INSTALLATION', 'SCHEDULED_TASK'))"
_by = lambda *names: "f.proc IN (" + ", ".join(f"'{n}'" for n in names) + ")"
_install, _support = _by("msiexec.exe", "setup.exe", "install.exe"), _by("teamviewer.exe", "anydesk.exe", "screenconnect.exe", "bomgar.exe")
_three = [(25, "common_member"), (20, "system_member")]
#: family: (seconds around a cluster, signals over its context and its first event f, counters)
SCORES = {
    "LateralMovement": (1800, [(12, "bool_or(kind = 'ALERT' AND alert LIKE '%new account%' AND alert LIKE '%admin%')"), (14, "bool_or(kind = 'FILE_CREATION' AND regexp_matches(tfile, '[.](exe|dll|ps1|bat|cmd)'))"), (10, "any_value(f.usr <> '' AND coalesce(f.first_logon >= f.epoch - 86400, true))"), (12, al("initial access", "compromise", "execution")), (12, al("persistence", "credential", "defense evasion"))],
        [*_three, (12, "regexp_matches(lower(f.host_name), 'jump|bastion|gateway|rdp-gw')"), (10, _by("ccmexec.exe", "puppet.exe", "chef-client.exe")), (12, _support), (10, "regexp_matches(f.usr, 'admin|it-|helpdesk|support')")]),
    "Persistence": (1800, [(12, al("unsigned")), (10, fi("/temp/", "/tmp/")), (10, al("hidden", "system attribute")), (10, "NOT coalesce(bool_or(kind = 'PROCESS_EXECUTION' AND proc IN ('msiexec.exe', 'setup.exe', 'install.exe')), false)")], [*_three, (10, _install)]),
    "RemoteExecution": (1800, [(12, al("lateral", "smb", "rdp")), (10, al("admin$", "c$", "share")), (14, "any_value(f.usr <> '' AND f.usr NOT LIKE '%admin%')"), (14, pr("-enc", "invoke-expression", "iex", "downloadstring", "net.webclient", "bitsadmin", "certutil"))], [*_three, (12, _by("ccmexec.exe", "smsagenthost.exe")), (10, _by("puppet.exe", "chef-client.exe")), (12, _support)]),
    "DefenseEvasion": (1800, [(12, al("initial access", "lateral", "execution")), (14, "bool_or(kind = 'PROCESS_EXECUTION' AND proc IN ('mimikatz.exe', 'cobaltstrike', 'metasploit', 'powersploit'))"), (10, _kept), (12, pr("virtualalloc", "virtualprotect", "writeprocessmemory", "readprocessmemory"))], [*_three, (10, _install), (12, _by("wuauclt.exe", "usoclient.exe", "trustedinstaller.exe")), (10, _by("psexec.exe", "pskill.exe", "pslist.exe"))]),
    "Beaconing": (0, [(10, f"count(DISTINCT {_ip}) = 1"), (12, al("initial access", "lateral movement")), (12, "bool_or(kind IN ('REGISTRY_MODIFICATION', 'SERVICE_INSTALLATION'))"), (14, al("cobalt strike", "metasploit", "trickbot"))], _three),
    "Collection": (1800, [(12, al("lateral")), (10, fi("/finance/", "/hr/", "/accounting/", "/payroll/", "/source/", "/repo/", "/git/", "/dev/")), (12, pr("-p", "-hp", "-aes")), (8, _late)], [*_three, (12, "regexp_matches(f.proc, 'backup[.]exe|veeam|acronis|backuppc|restic')"), (10, _by("searchindexer.exe", "searchprotocolhost.exe", "msexchange.exe"))]),
    "Exfiltration": (3600, [(12, al("collection", "archive", "file enumeration")), (10, fi(".xlsx", ".docx", ".pdf", ".pst", ".db", ".sql", ".bak")), (8, _late), (12, f"count(DISTINCT {_ip}) >= 2")], [*_three, (10, _by("dropbox.exe", "googledrivesync.exe", "onedrive.exe", "boxsync.exe"))]),
    "Impact": (1800, [(12, al("credential", "lsass", "dump")), (14, "any_value(regexp_matches(lower(f.host_name), 'dc|fileserver|fs|nas|sql|exchange'))"), (10, "bool_or(kind = 'ALERT' AND alert LIKE '%delete%' AND regexp_matches(alert, 'service|task|registry'))"), (12, al("log cleared", "timestomp", "anti-forensic"))], [*_three, (12, _by("msmpeng.exe", "mssense.exe", "ccsvchst.exe", "avastsvc.exe", "bdagent.exe")), (10, _by("msiexec.exe", "setup.exe", "uninstall.exe"))]),
    "LogClearing": (0, [(14, "any_value(f.usr <> '' AND f.usr NOT LIKE '%admin%')"), (12, _attack), (14, " + ".join(f"coalesce(bool_or(kind = 'ALERT' AND alert LIKE '%{w}%' AND regexp_matches(alert, 'cleared|1102|104')), false)::INT" for w in ("security", "system", "application", "powershell", "sysmon")) + " >= 2")], [*_three, (15, "f.hour <= 3 AND f.minute < 10")]),
    "Timestomp": (0, [(14, fi("/windows/system32/", "/windows/syswow64/", "/program files/", "/users/public/", "/startup/", "/run/")), (10, al("unsigned")), (12, fi("/windows/system32/", "/windows/syswow64/")), (10, _attack)], [*_three, (12, _by("msiexec.exe", "setup.exe", "install.exe", "update.exe"))]),
    "ShadowDeletion": (0, [(14, "any_value(f.usr <> '' AND NOT regexp_matches(f.usr, 'admin|system|nt authority'))"), (14, al("mass file", "ransom", "encrypt")), (12, pr("wbadmin delete", "bcdedit", "recoveryenabled"))], [*_three, (12, _by("cleanmgr.exe", "diskcleanup.exe")), (10, "f.hour <= 4")]),
    "MemoryAnomaly": (1800, [(12, "bool_or(proc IN ('rundll32.exe', 'regsvr32.exe', 'mshta.exe', 'wmic.exe', 'cmstp.exe', 'installutil.exe', 'msxsl.exe', 'odbcconf.exe'))"), (10, "bool_or(kind = 'NETWORK_CONNECTION' AND ip <> '')"), (15, "bool_or(kind = 'LSASS_ACCESS' OR kind = 'ALERT' AND alert LIKE '%lsass%')")], [(20, "system_member"), (15, "regexp_matches(f.ppath, '/(windows/+(system32|syswow64|winsxs)|program *files( *\\(x86\\))?)/')")]),
    "SuspiciousLineage": (1800, [(12, "bool_or(proc IN ('rundll32.exe', 'regsvr32.exe', 'mshta.exe', 'wmic.exe', 'cmstp.exe', 'installutil.exe', 'msxsl.exe', 'odbcconf.exe', 'regasm.exe', 'regsvcs.exe', 'msiexec.exe', 'forfiles.exe', 'pcalua.exe', 'scriptrunner.exe', 'wscript.exe', 'cscript.exe'))"),
        (12, "bool_or(kind = 'NETWORK_CONNECTION' AND ip <> '' AND NOT regexp_matches(ip, '^(10|192[.]168|127|169[.]254|172[.](1[6-9]|2[0-9]|3[01]))[.]'))"), (14, _kept)], [(18, "system_member"), (8, "trim(f.usr) IN ('system', 'networkservice', 'localservice', 'trustedinstaller', 'nt authority\\system')"), (12, "contains(f.ppath, '/appdata/roaming/microsoft/')")]),
    "CredentialAccess": (1800, [(14, pr("procdump", "mimikatz", "comsvcs", "nanodump", "lsassy")), (12, "any_value(f.usr LIKE '%admin%')"), (12, "bool_or(kind = 'FILE_CREATION' AND ends_with(tfile, '.dmp'))"), (10, al("lateral")), (10, "any_value(lower(f.host_name) LIKE '%dc%')"), (12, al("pass the hash", "pass the ticket"))], [*_three, (15, _by("msmpeng.exe", "mssense.exe")), (15, _by("sysmon.exe", "sysmon64.exe"))]),
}


def scored(name: str, k: int) -> str:
    """The scored clusters of a family, as k<k>."""
    around, signals, counters = SCORES[name]
    support = " + ".join(f"CASE WHEN coalesce({rule}, false) THEN {w} ELSE 0 END" for w, rule in signals)
    counter = " + ".join(f"CASE WHEN {rule} THEN {w} ELSE 0 END" for w, rule in counters)
    score = "greatest(0, least(100, base + support - counter))"
    return f"""
s{k} AS (SELECT c.cluster_id, {support} AS support FROM (SELECT cluster_id, host_name AS hn, start_epoch AS se, end_epoch AS ee, f FROM g JOIN fe USING (cluster_id) WHERE constructor = '{name}') c JOIN en ON en.host_name = c.hn AND en.epoch BETWEEN c.se - {around} AND c.ee + {around} GROUP BY c.cluster_id),
c{k} AS (SELECT cluster_id, {counter} AS counter FROM fe WHERE family = '{name}'),
k{k} AS (SELECT g.*, support, counter, {score} AS score, CASE WHEN {score} >= 70 THEN 'STRONG' WHEN {score} >= 40 THEN 'MODERATE' WHEN {score} >= 20 THEN 'WEAK' ELSE 'NOISE' END AS tier FROM g JOIN s{k} USING (cluster_id) JOIN c{k} USING (cluster_id))"""


CLUSTERS = GROUPS + COMMON + "," + ",".join(scored(f.name, k) for k, f in enumerate(FAMILIES)) + ", cl AS (" + " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(len(FAMILIES))) + ")"


def over_events(body: str) -> str:
    return f"WITH {EV} {body}"


def over_clusters(body: str) -> str:
    return f"WITH {CLUSTERS} {body}"
