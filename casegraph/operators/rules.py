"""Trigger, signal and counter rules as data: each predicate is SQL over the columns of prepared().

Paths are lower-cased with '/' between their parts, so a rule reads the same whatever the separator was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Trigger:
    name: str
    base: int
    when: str


@dataclass(frozen=True)
class Signal:
    """Raises the score. on: 'context', if it holds for any event near the cluster (or for none, if absent); 'trigger', for the
    cluster's first event; 'cluster', for what was gathered from the context: low_ip and high_ip, the least and greatest address
    outside, channels, a bit for each log that was cleared, and new_target.
    """

    name: str
    weight: int
    when: str
    absent: bool = False
    on: str = "context"


@dataclass(frozen=True)
class Counter:
    """Lowers the score. on: 'trigger', if it holds for the cluster's first event; 'member', for any of its events; 'list', if
    that column of the first event is in the list of this name that a case brings, and never without one.
    """

    name: str
    penalty: int
    when: str
    on: str = "trigger"


@dataclass(frozen=True)
class Family:
    name: str
    window: int | None
    tactic: str
    triggers: tuple[Trigger, ...]
    signals: tuple[Signal, ...] = ()
    counters: tuple[Counter, ...] = ()
    by_user: bool = False  # clusters of a host and user, not of a host


def has(col: str, *words: str) -> str:
    """col contains any of the words."""
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def has_all(col: str, *words: str) -> str:
    return "(" + " AND ".join(f"contains({col}, '{w}')" for w in words) + ")"


def ends(col: str, *words: str) -> str:
    return "(" + " OR ".join(f"endswith({col}, '{w}')" for w in words) + ")"


def like(col: str, pattern: str) -> str:
    return f"regexp_like({col}, r'(?i){pattern}')"


def of(kind: str, rule: str) -> str:
    return f"(kind = '{kind}' AND {rule})"


def alert(*words: str) -> str:
    return of("ALERT", has("alert", *words))


def alert_all(*words: str) -> str:
    return of("ALERT", has_all("alert", *words))


def run(*words: str) -> str:
    return of("PROCESS_EXECUTION", has("cmd", *words))


def run_all(*words: str) -> str:
    return of("PROCESS_EXECUTION", has_all("cmd", *words))


def any_of(*rules: str) -> str:
    return "(" + " OR ".join(rules) + ")"


def of_any(*kinds: str) -> str:
    return f"kind IN ({quoted(kinds)})"


def one_of(col: str, words) -> str:
    return f"{col} IN ({quoted(words)})"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


PROCESS, FILE, NET, AUTH, REG = "PROCESS_EXECUTION", "FILE_CREATION", "NETWORK_CONNECTION", "AUTHENTICATION", "REGISTRY_MODIFICATION"
PRIVATE = like("ip", r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)")
EXTERNAL = f"(ip <> '' AND ip NOT IN ('127.0.0.1', '::1') AND NOT {PRIVATE})"
# fixed values: places and names that the rules look for
ARCHIVES = [".zip", ".rar", ".7z", ".tar.gz", ".tar"]
STAGING = ["/temp/", "/appdata/", "/programdata/", "/users/public/"]
WRITABLE = r"/(?:appdata|users/+(?:public|default|all\s*users)|temp|tmp|programdata|recycle\.?bin|perflogs|windows/temp)/"
WRITABLE_DOWN = r"/(?:appdata|users/+(?:public|default|all\s*users)|temp|tmp|programdata|recycle\.?bin|perflogs|windows/temp|downloads)/"
LOLBINS = ["rundll32.exe", "regsvr32.exe", "mshta.exe", "wmic.exe", "cmstp.exe", "installutil.exe", "msxsl.exe", "odbcconf.exe", "regasm.exe", "regsvcs.exe", "msiexec.exe", "forfiles.exe", "pcalua.exe", "scriptrunner.exe", "wscript.exe", "cscript.exe"]
OFFICE = ["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe"]
DOCUMENT_APPS = [*OFFICE, "msaccess.exe", "visio.exe", "publisher.exe", "onenote.exe", "acrord32.exe", "acrobat.exe", "iexplore.exe", "msedge.exe", "chrome.exe", "firefox.exe", "brave.exe", "thunderbird.exe"]
SHELLS = ["cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe"]
INTERPRETERS = ["powershell.exe", "powershell_ise.exe", "pwsh.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe"]
RANSOM_ENDS = [".locked", ".encrypted", ".crypt", ".crypto", ".enc", ". ransom", ".locky", ".zepto", ".cerber", ".wannacry", ".wncry", ".wncryt", ".gandcrab", ".sodinokibi", ".revil", ".darkside", ".lockbit", ".readme", ".how_to_decrypt", ".recover", ".restore"]
NOTES = ["readme", "how_to_decrypt", "_readme", "recover", "restore", "decrypt", "instructions", "help_decrypt", "about_files"]
CLOUD = ["rclone", "megasync", "dropbox", "google drive", "onedrive", "aws s3", "gsutil"]
RUN_KEYS = ["/run/", "/runonce/", "/runonceex/", "/startupapproved/", "/user shell folders/", "/load/", "/winlogon/shell"]
SYSTEM_NAMES = ["svchost.exe", "lsass.exe", "csrss.exe", "smss.exe", "wininit.exe", "services.exe", "spoolsv.exe", "winlogon.exe", "explorer.exe", "taskhost.exe", "dwm.exe", "conhost.exe", "rundll32.exe", "taskmgr.exe", "regedit.exe", "cmd.exe", "powershell.exe", "msiexec.exe", "wuauclt.exe", "trustedinstaller.exe"]
SYSTEM_FOLDERS = "/(?:windows/(?:system32|syswow64|winsxs)|program files(?: [(]x86[)])?)/[^/]*$"
SYSTEM_ANYWHERE = r"/(?:windows/+system32|windows/+syswow64|windows/+winsxs|program\s*files(?:\s*[(]x86[)])?)/"
INSTALLERS = ["msiexec.exe", "setup.exe", "install.exe"]
SUPPORT_TOOLS = ["teamviewer.exe", "anydesk.exe", "screenconnect.exe", "bomgar.exe"]
MEMORY_LOLBINS = ["rundll32.exe", "regsvr32.exe", "mshta.exe", "wmic.exe", "cmstp.exe", "installutil.exe", "msxsl.exe", "odbcconf.exe"]
SYSTEM_LIBRARIES = ["kernel32.dll", "ntdll.dll", "user32.dll", "advapi32.dll", "ole32.dll", "msvcrt.dll", "shell32.dll", "rpcrt4.dll"]
SYSTEM_USERS = ["system", "networkservice", "localservice", "trustedinstaller", "nt authority/system"]
HIGH_VALUE_FOLDERS = ["/finance/", "/hr/", "/accounting/", "/payroll/", "/source/", "/repo/", "/git/", "/dev/"]
HIGH_VALUE_HOSTS = ["dc", "dc01", "dc02", "fileserver", "fs", "nas", "sql", "exchange"]
SENSITIVE_ENDS = [".xlsx", ".docx", ".pdf", ".pst", ".db", ".sql", ".bak"]
PAYLOADS = ["-enc", "-encodedcommand", "invoke-expression", "iex", "downloadstring", "net.webclient", "bitsadmin", "certutil"]
LOGS = ["security", "system", "application", "powershell", "sysmon"]
RE_AMSI = r"\b(?:amsiinitfailed|amsiutils|amsiscanbuffer|amscontext|\[ref\]\.assembly\.gettype|system\.management\.automation\.amsiutils|amsi\s*(?:bypass|patch|disable|hook)|a[\x27`]?m[\x27`]?s[\x27`]?i)\b"
RE_OBFUSCATED = r"(?:^|\s)-(?:enc|encodedcommand|e)\b|\bfrombase64string\b|\binvoke-expression\s+\(.{40,}\)|\biex\s*\(\s*\["
RE_ETW = r"\b(?:etweventwrite|etweventregister|etwregister|etwreplacefunction|nttraceevent|etwbypass|etwti|(?:patch|disable|hook|bypass|nop|kill)\s+etw|etw\s+(?:patch|disable|hook|bypass|tamper))\b"
RE_EDR = r"\b(?:set-mppreference|add-mppreference|disable\w*\s+(?:windows\s+)?defender|defender\s+(?:disable|stop|exclusion|exclude|tamper)|disablerealtimemonitoring|tamperprotection\s*(?:0|off|false|disable)|real-time\s+protection\s+(?:off|disable)|sc\s+(?:stop|delete|config)\s+(?:windefend|sense|wdnissvc|sentinelagent)|net\s+stop\s+(?:windefend|sense|wdnissvc|sentinelagent)|taskkill[^\n]+(?:msmpeng|sentinelagent|csagent|cyloprotectsvc)|killav|disableav)\b"
RE_EDR_KEY = r"(?:windows\s+defender|securityhealthservice|sense|windefend)\b.*\b(?:disable|tamperprotection)"
RE_INJECT = r"\b(?:virtualallocex|writeprocessmemory|createremotethread|ntunmapviewofsection|setthreadcontext|queueuserapc|ntmapviewofsection|reflectiveloader)\b"
RE_UAC = r"\b(?:fodhelper(?:\.exe)?|computerdefaults(?:\.exe)?|sdclt(?:\.exe)?|eventvwr(?:\.exe)?|cleanmgr(?:\.exe)?|slui(?:\.exe)?|delegateexecute|wsreset(?:\.exe)?|cmstp(?:\.exe)?)\b"
RE_UAC_WITH = r"\b(?:reg\s+add|delegateexecute|hkcu|hkey_current_user|cmd\s+/c)\b"
RE_INJECT_ALERT = r"\b(?:process\s+injection|process\s+hollowing|reflective\s+load|shellcode|inject(?:ion|ed)|apc\s+injection|virtualalloc(?:ex)?|writeprocessmemory|createremotethread)\b"

_archive = of(FILE, f"{ends('tfile', *ARCHIVES)} AND {has('tfile', *STAGING)}")
_office_shell = of(PROCESS, f"parent IN ({quoted(OFFICE)}) AND proc IN ({quoted(SHELLS)})")
_wmi_remote = any_of(run_all("wmic", "/node:"), alert_all("wmi", "remote"))
_winrm_alert = alert("powershell remoting", "winrm")
_persists = of_any(REG, "SERVICE_INSTALLATION", "SCHEDULED_TASK")
_other_attack = alert("lateral", "persistence", "credential", "defense evasion")
_late = "(hour < 9 OR hour >= 17)"

#: A bit for each log that an alert says was cleared.
CHANNELS = [alert_all(x) + " AND " + has("alert", "cleared", "1102", "104") for x in LOGS]
BASELINE = Counter("high_frequency_baseline", 25, "common_process", on="member")
KNOWN_HASH = Counter("known_good_hash", 15, "known_hash", on="member")
SYSTEM_PATH = Counter("system_legitimate_path", 20, of(PROCESS, f"proc IN ({quoted(SYSTEM_NAMES)}) AND {like('ppath', SYSTEM_FOLDERS)} AND endswith(ppath, proc)"), on="member")
SHARED = (BASELINE, KNOWN_HASH, SYSTEM_PATH)
INSTALL = Counter("documented_software_install", 10, one_of("proc", INSTALLERS))
SUPPORT = Counter("help_desk_remote_support", 12, one_of("proc", SUPPORT_TOOLS))

FAMILIES = (
    Family("LateralMovement", 1800, "TA0008", (
        Trigger("network_logon_type3_from_internal", 15, of(AUTH, "logon = '3'")), Trigger("rdp_logon", 25, any_of(of(AUTH, "logon = '10'"), of("ALERT", f"{has('alert', 'rdp')} AND {has('alert', 'logon', 'connection')}"))),
        Trigger("smb_admin_share_write", 35, any_of(alert("admin share", "c$", "admin$"), of(FILE, has("tfile", "admin$", "c$")))), Trigger("wmi_remote_execution", 25, _wmi_remote),
        Trigger("psexec_usage", 40, any_of(run("psexec", "paexec", "csexec", "remcom", "smbexec"), alert("psexec", "smbexec"))), Trigger("powershell_remoting", 25, any_of(run("enter-pssession", "invoke-command", "new-pssession", "icm -computername"), _winrm_alert)),
        Trigger("ssh_lateral", 25, any_of(of(NET, "port = 22"), of("ALERT", f"{has('alert', 'ssh')} AND {has('alert', 'lateral', 'tunnel')}"))), Trigger("pass_the_hash_ticket", 40, any_of(alert("pass the hash", "pass the ticket", "mimikatz"), run("sekurlsa::pth", "sekurlsa::tickets"))),
        Trigger("new_service_remote", 15, any_of("kind = 'SERVICE_INSTALLATION'", alert_all("service", "remote"))), Trigger("scheduled_task_remote", 15, any_of("kind = 'SCHEDULED_TASK'", alert_all("scheduled task", "remote"))),
    ), (
        Signal("new_admin_account", 12, alert_all("new account", "admin")), Signal("tools_dropped_on_target", 14, of(FILE, has("tfile", ".exe", ".dll", ".ps1", ".bat", ".cmd"))), Signal("target_not_previously_accessed", 10, "new_target", on="cluster"),
        Signal("occurred_after_initial_compromise", 12, alert("initial access", "compromise", "execution")), Signal("source_host_has_other_attack_signals", 12, alert("persistence", "credential", "defense evasion")),
    ), (*SHARED, Counter("documented_jump_server", 12, has("lower(host_name)", "jump", "bastion", "gateway", "rdp-gw")), Counter("sccm_puppet_action", 10, one_of("proc", ["ccmexec.exe", "puppet.exe", "chef-client.exe"])), SUPPORT, Counter("user_documented_it_admin", 10, has("usr", "admin", "it-", "helpdesk", "support")))),
    Family("Persistence", 1800, "TA0003", (
        Trigger("registry_run_key", 20, any_of(of(REG, has("rkey", *RUN_KEYS)), alert("run key", "registry run"))), Trigger("scheduled_task_creation", 15, any_of("kind = 'SCHEDULED_TASK'", alert_all("scheduled task", "created"), run_all("schtasks", "/create"))),
        Trigger("wmi_event_subscription", 25, any_of(alert_all("wmi", "subscription"), of(PROCESS, f"{has('cmd', 'wmi')} AND {has('cmd', 'event', 'subscription')}"))), Trigger("service_install", 15, any_of("kind = 'SERVICE_INSTALLATION'", alert_all("service", "install"), run("sc create", "sc config", "new-service"))),
        Trigger("startup_folder", 20, any_of(of(FILE, has("tfile", "/startup/", "/start menu/programs/startup")), alert_all("startup", "folder"))), Trigger("bits_job_persistence", 20, any_of(of(PROCESS, f"{has('cmd', 'bitsadmin')} AND {has('cmd', '/addfile', '/setnotifycmdline')}"), alert_all("bits", "persistence"))),
        Trigger("dll_search_order_hijacking", 25, any_of(alert("dll hijacking", "search order"), of(FILE, f"{ends('tfile', '.dll')} AND {has('tfile', 'system32', 'syswow64')}"))),
    ), (
        Signal("executable_unsigned", 12, alert("unsigned")), Signal("executable_in_temp", 10, has("tfile", "/temp/", "/tmp/")), Signal("hidden_or_system_attribute", 10, alert("hidden", "system attribute")),
        Signal("no_corresponding_installer", 10, of(PROCESS, one_of("proc", INSTALLERS)), absent=True),
    ), (*SHARED, INSTALL, Counter("signed_by_known_publisher", 12, "ppath", on="list"), Counter("gpo_deployment", 10, "host_name", on="list"))),
    Family("RemoteExecution", 1800, "TA0002", (
        Trigger("office_spawning_shell", 45, _office_shell), Trigger("psexec_usage", 40, any_of(run("psexec", "paexec", "csexec", "remcom"), alert("psexec", "remote execution"))), Trigger("wmi_remote_execution", 25, _wmi_remote),
        Trigger("powershell_remoting", 25, any_of(run("enter-pssession", "invoke-command", "new-pssession", "icm"), _winrm_alert)), Trigger("scheduled_task_remote", 15, any_of("kind = 'SCHEDULED_TASK'", alert_all("scheduled task", "remote"))),
        Trigger("service_remote_install", 15, any_of("kind = 'SERVICE_INSTALLATION'", alert_all("service", "remote"))), Trigger("winrm_remote_management", 20, any_of(of(NET, "port IN (5985, 5986)"), alert("winrm"))),
    ), (
        Signal("occurred_after_lateral_movement", 12, alert("lateral", "smb", "rdp")), Signal("new_admin_share_created", 10, alert("admin$", "c$", "share")), Signal("executed_by_non_admin", 14, f"(usr <> '' AND NOT {has('usr', 'admin')})", on="trigger"), Signal("malicious_payload_detected", 14, run(*PAYLOADS)),
    ), (*SHARED, Counter("documented_sccm_activity", 12, one_of("proc", ["ccmexec.exe", "smsagenthost.exe"])), Counter("documented_puppet_chef", 10, one_of("proc", ["puppet.exe", "chef-client.exe"])), SUPPORT)),
    Family("DefenseEvasion", 1800, "TA0005", (
        Trigger("obfuscated_powershell", 30, of(PROCESS, f"{has('proc', 'powershell', 'pwsh')} AND {like('cmd', RE_OBFUSCATED)}")), Trigger("amsi_bypass", 35, any_of(of(PROCESS, like("cmd", RE_AMSI)), of("ALERT", f"{has('alert', 'amsi')} AND {has('alert', 'bypass', 'tamper')}"))),
        Trigger("etw_tamper", 28, any_of(of(PROCESS, like("cmd", RE_ETW)), of("ALERT", f"{has('alert', 'etw')} AND {has('alert', 'tamper', 'disable', 'patch')}"))), Trigger("edr_disable", 35, any_of(of(PROCESS, like("cmd", RE_EDR)), of(REG, like("rkey", RE_EDR_KEY)), alert("edr disable", "defender disable", "antivirus disable", "security tool"))),
        Trigger("process_injection", 30, any_of(of(PROCESS, like("cmd", RE_INJECT)), alert("process injection", "process hollowing", "reflective"))),
        Trigger("process_masquerading", 25, any_of(alert("masquerading", "right-to-left", "spoofed"), of(PROCESS, "ppath <> '' AND ((proc = 'svchost.exe' AND (NOT contains(ppath, 'system32') OR (contains(ppath, '/system32/') AND NOT contains(ppath, '/system32/svchost.exe')))) OR (proc IN ('lsass.exe', 'smss.exe', 'csrss.exe', 'wininit.exe', 'services.exe') AND NOT contains(ppath, 'system32')))"))),
        Trigger("uac_bypass", 28, any_of(of(PROCESS, f"{like('cmd', RE_UAC)} AND {like('cmd', RE_UAC_WITH)}"), alert("uac bypass", "auto elevation"))), Trigger("sigma_defense_evasion", 30, alert("defense evasion", "ta0005")),
    ), (
        Signal("occurred_after_initial_access", 12, alert("initial access", "lateral", "execution")), Signal("malicious_tool_present", 14, of(PROCESS, one_of("proc", ["mimikatz.exe", "cobaltstrike", "metasploit", "powersploit"]))), Signal("persistence_mechanism_present", 10, _persists), Signal("memory_manipulation_apis", 12, run("virtualalloc", "virtualprotect", "writeprocessmemory", "readprocessmemory")),
    ), (*SHARED, INSTALL, Counter("system_update", 12, one_of("proc", ["wuauclt.exe", "usoclient.exe", "trustedinstaller.exe"])), Counter("legitimate_admin_tool", 10, one_of("proc", ["psexec.exe", "pskill.exe", "pslist.exe"])))),
    Family("Beaconing", 0, "TA0011", (
        Trigger("periodic_outbound_low_jitter", 20, of(NET, "ip NOT IN ('', '127.0.0.1', '::1')")), Trigger("dga_dns_pattern", 35, alert("dga", "dns tunnel", "suspicious dns")), Trigger("low_rep_destination", 25, alert("suspicious ip", "malicious domain", "c2")),
        Trigger("cobalt_strike_pipe", 45, alert("cobalt strike", "named pipe")), Trigger("dns_tunnel_pattern", 35, of("ALERT", f"{has('alert', 'dns')} AND {has('alert', 'tunnel', 'exfil')}")), Trigger("user_agent_anomaly", 15, alert("user agent", "user-agent")),
        Trigger("non_standard_port_external", 20, of(NET, f"port > 1024 AND {EXTERNAL}")), Trigger("ja3_known_malicious", 30, alert("ja3", "tls fingerprint")),
    ), (
        Signal("destination_unique_to_one_host", 10, "low_ip = high_ip", on="cluster"), Signal("occurred_after_initial_access", 12, alert("initial access", "lateral movement")), Signal("persistence_present_on_same_host", 12, of_any(REG, "SERVICE_INSTALLATION")), Signal("beacon_interval_known_malicious_family", 14, alert("cobalt strike", "metasploit", "trickbot")),
    ), (*SHARED, Counter("destination_in_corporate_baseline", 15, "ip", on="list"), Counter("destination_is_software_updater", 12, "ip", on="list"), Counter("user_agent_matches_legitimate_app", 10, "user_agent", on="list"))),
    Family("Collection", 1800, "TA0009", (
        Trigger("mass_file_enumeration", 20, alert("mass file", "file enumeration", "recursive read")), Trigger("archive_creation_unusual_path", 25, _archive),
        Trigger("password_grep_pattern", 35, of(PROCESS, f"{has('cmd', 'findstr', 'grep', 'select-string', 'get-childitem')} AND {has('cmd', 'password', 'credential', 'passwd', 'secret', 'apikey', 'api_key')}")), Trigger("document_recursive_enumeration", 20, alert("document enumeration", "file collection")),
        Trigger("screenshot_or_clipboard_yara", 25, alert("screenshot", "clipboard", "keylog", "screen capture")), Trigger("outlook_pst_access_unusual", 20, alert("pst", "outlook")),
    ), (
        Signal("occurred_after_lateral_movement", 12, alert("lateral")), Signal("files_from_high_value_paths", 10, has("tfile", *HIGH_VALUE_FOLDERS)), Signal("encrypted_archive_creation", 12, run("-p", "-hp", "--password", "-aes")), Signal("occurred_outside_business_hours", 8, _late),
    ), (*SHARED, Counter("matched_backup_software_pattern", 12, has("proc", "backup.exe", "veeam", "acronis", "backuppc", "restic")), Counter("within_indexing_service_pattern", 10, one_of("proc", ["searchindexer.exe", "searchprotocolhost.exe", "msexchange.exe"])), Counter("user_documented_data_owner", 8, "usr", on="list"))),
    Family("Exfiltration", 3600, "TA0010", (
        Trigger("large_outbound_transfer", 15, of(NET, EXTERNAL)), Trigger("cloud_upload_tool", 25, any_of(run(*CLOUD), of(PROCESS, has("proc", *CLOUD)), alert("rclone", "megasync", "cloud upload"))), Trigger("archive_before_transfer", 20, _archive),
        Trigger("dns_exfil_pattern", 35, alert("dns exfil", "dns tunnel", "dga")), Trigger("https_non_standard_port", 20, of(NET, "(port = 8443 OR port > 10000)")), Trigger("smb_to_external", 25, of(NET, f"port IN (445, 139) AND {EXTERNAL}")),
    ), (
        Signal("occurred_after_collection", 12, alert("collection", "archive", "file enumeration")), Signal("sensitive_file_types", 10, has("tfile", *SENSITIVE_ENDS)), Signal("occurred_outside_business_hours", 8, _late), Signal("multiple_destinations", 12, "low_ip <> high_ip", on="cluster"),
    ), (*SHARED, Counter("matched_documented_backup_routine", 12, "proc", on="list"), Counter("known_software_sync", 10, one_of("proc", ["dropbox.exe", "googledrivesync.exe", "onedrive.exe", "boxsync.exe"])), Counter("user_documented_travel", 8, "usr", on="list"))),
    Family("Impact", 1800, "TA0040", (
        Trigger("mass_file_modification", 20, of("ALERT", f"{has('alert', 'mass file')} AND {has('alert', 'modify', 'encrypt', 'ransom')}")), Trigger("ransomware_extension_pattern", 45, of(FILE, ends("tfile", *RANSOM_ENDS))), Trigger("shadow_copy_deletion", 40, any_of(alert_all("shadow", "delet"), run_all("vssadmin", "delete", "shadows"))),
        Trigger("backup_destruction", 40, run("wbadmin delete", "bcdedit /set {default} bootstatuspolicy ignoreallfailures", "bcdedit /set {default} recoveryenabled no", "vssadmin resize shadowstorage")),
        Trigger("ransom_note_pattern", 35, of(FILE, f"{has('fname', *NOTES)} AND endswith(fname, '.txt')")), Trigger("mass_service_stop", 20, alert("service stop", "mass service", "stop services")), Trigger("mass_account_lockout", 20, alert("account lockout", "brute force", "mass lockout")),
    ), (
        Signal("occurred_after_credential_access", 12, alert("credential", "lsass", "dump")), Signal("affected_dc_or_file_server", 14, has("lower(host_name)", *HIGH_VALUE_HOSTS), on="trigger"), Signal("persistence_destruction_pattern", 10, of("ALERT", f"{has('alert', 'delete')} AND {has('alert', 'service', 'task', 'registry')}")), Signal("anti_forensic_co_occurrence", 12, alert("log cleared", "timestomp", "anti-forensic")),
    ), (*SHARED, Counter("matched_documented_decommission", 15, "host_name", on="list"), Counter("within_av_quarantine_pattern", 12, one_of("proc", ["msmpeng.exe", "mssense.exe", "ccsvchst.exe", "avastsvc.exe", "bdagent.exe"])), Counter("matched_known_software_uninstall", 10, one_of("proc", ["msiexec.exe", "setup.exe", "uninstall.exe"])))),
    Family("LogClearing", 0, "TA0005", (
        Trigger("evtx_1102_clear", 45, any_of("kind = 'LOG_CLEARED'", alert("1102", "log cleared"), run_all("wevtutil", "cl"))), Trigger("evtx_104_alt_clear", 35, alert_all("104", "log")), Trigger("recordid_gap", 25, alert("recordid gap", "event gap", "missing event")), Trigger("evtx_truncated", 20, of("ALERT", f"{has('alert', 'truncated')} AND {has('alert', 'evtx', 'event log')}")),
    ), (
        Signal("cleared_by_non_admin", 14, f"(usr <> '' AND NOT {has('usr', 'admin')})", on="trigger"), Signal("occurred_during_other_attack_signals", 12, _other_attack), Signal("multiple_logs_cleared_same_window", 14, "bit_count(channels) >= 2", on="cluster"),
    ), (*SHARED, Counter("within_log_rotation_pattern", 15, "(hour < 4 AND minute < 10)"), Counter("performed_by_documented_admin", 10, "usr", on="list"))),
    Family("Timestomp", 0, "TA0005", (
        Trigger("si_fn_timestamp_mismatch", 25, alert("timestomp", "timestamp mismatch", "si-fn")), Trigger("si_before_fn", 30, alert_all("impossible", "timestamp")), Trigger("rounded_second_timestamps", 20, alert("rounded timestamp", "suspicious timestamp")), Trigger("backdated_file", 25, alert("backdated", "future timestamp", "pre-install")),
    ), (
        Signal("affected_file_in_persistence_path", 14, has("tfile", "/windows/system32/", "/windows/syswow64/", "/program files/", "/users/public/", "/startup/", "/run/")), Signal("affected_file_unsigned", 10, alert("unsigned")), Signal("affected_file_in_system32", 12, has("tfile", "/windows/system32/", "/windows/syswow64/")), Signal("occurred_with_other_attack_signals", 10, _other_attack),
    ), (*SHARED, Counter("matched_known_installer_behavior", 12, one_of("proc", [*INSTALLERS, "update.exe"])), Counter("within_file_restore_window", 10, "tfile", on="list"))),
    Family("ShadowDeletion", 0, "TA0040", (
        Trigger("vssadmin_delete_shadows", 45, any_of(run_all("vssadmin", "delete", "shadows"), alert_all("vssadmin", "delete"))), Trigger("wmic_shadowcopy_delete", 40, any_of(run_all("wmic", "shadowcopy", "delete"), alert_all("wmic", "shadowcopy", "delete"))), Trigger("diskshadow_delete", 40, any_of(run_all("diskshadow", "delete"), alert_all("diskshadow", "delete"))),
        Trigger("evtx_524", 25, alert_all("524", "shadow")), Trigger("powershell_remove_wmiobject_shadow", 40, any_of(run_all("powershell", "get-wmiobject", "win32_shadowcopy", "delete"), alert_all("powershell", "shadowcopy", "delete"))),
    ), (
        Signal("executed_by_non_admin", 14, f"(usr <> '' AND NOT {has('usr', 'admin', 'system', 'nt authority')})", on="trigger"), Signal("followed_by_mass_file_modification", 14, alert("mass file", "ransom", "encrypt")), Signal("occurred_with_backup_destruction", 12, run("wbadmin delete", "bcdedit", "recoveryenabled")),
    ), (*SHARED, Counter("matched_documented_disk_cleanup", 12, one_of("proc", ["cleanmgr.exe", "diskcleanup.exe"])), Counter("within_backup_software_window", 10, "hour < 5"))),
    Family("MemoryAnomaly", 1800, "TA0005", (
        Trigger("pe_header_in_private_memory", 60, "(contains(plugin, 'malfind') AND private_memory <> '0')"), Trigger("unsigned_dll_in_writable_path", 50, f"(endswith(dll, '.dll') AND {like('dll', WRITABLE)})"), Trigger("process_no_image_path", 55, of(PROCESS, f"{has('plugin', 'pslist', 'pstree', 'psscan')} AND proc = '' AND ppath = ''")),
        Trigger("sigma_process_injection_alert", 55, of("ALERT", like("alert", RE_INJECT_ALERT))), Trigger("executable_in_writable_path", 35, of(PROCESS, like("ppath", WRITABLE))),
    ), (
        Signal("co_occurs_with_lolbin", 12, one_of("proc", MEMORY_LOLBINS)), Signal("followed_by_network_connection", 10, of(NET, "ip <> ''")), Signal("co_occurs_with_credential_access", 15, any_of("kind = 'LSASS_ACCESS'", alert("lsass"))),
    ), (KNOWN_HASH, SYSTEM_PATH, Counter("dll_in_system_path", 15, like("if(ppath <> '', ppath, vol_path)", SYSTEM_ANYWHERE)), Counter("signed_microsoft_dll", 10, one_of("vol_base", SYSTEM_LIBRARIES)))),
    Family("SuspiciousLineage", 1800, "TA0002", (
        Trigger("office_spawned_interpreter", 65, of(PROCESS, f"proc IN ({quoted(INTERPRETERS)}) AND parent IN ({quoted(DOCUMENT_APPS)})")), Trigger("lolbin_with_http_url", 60, of(PROCESS, f"proc IN ({quoted(LOLBINS)}) AND {like('cmd', r'\bhttps?://[^\s<>]+')}")), Trigger("orphan_or_spoofed_parent", 50, f"({has('plugin', 'pstree', 'pslist')} AND vol_ppid <> '' AND vol_parent = '')"),
        Trigger("long_base64_in_cmdline", 50, of(PROCESS, f"length(cmd) >= 80 AND {like('cmd', r'\b[A-Za-z0-9+/]{60,}={0,2}\b')}")), Trigger("executable_in_writable_dir", 35, of(PROCESS, like("ppath", WRITABLE_DOWN))),
    ), (
        Signal("writable_path_with_lolbin", 12, one_of("proc", LOLBINS)), Signal("followed_by_outbound_network", 12, of(NET, f"ip <> '' AND NOT {PRIVATE} AND NOT {like('ip', r'^(?:127|169[.]254)[.]')}")), Signal("persistence_co_occurs", 14, _persists),
    ), (KNOWN_HASH, Counter("system_legitimate_path", 18, SYSTEM_PATH.when, on="member"), Counter("known_admin_invocation", 8, one_of(r"translate(trim(usr), '\\', '/')", SYSTEM_USERS)), Counter("office_addin_path", 12, has("ppath", "/appdata/roaming/microsoft/"))), True),
    Family("CredentialAccess", 1800, "TA0006", (
        Trigger("lsass_access_or_dump", 30, any_of("kind = 'LSASS_ACCESS'", alert("lsass"), run_all("procdump", "lsass"), run_all("comsvcs", "minidump"))), Trigger("sam_hive_copy", 45, any_of(of(PROCESS, like("cmd", r"reg(?:\.exe)?\s+save\s+hklm.(?:sam|system|security)")), alert("sam hive"))),
        Trigger("ntds_dump", 30, any_of(run("ntds.dit", "ntdsutil"), alert("ntds"))), Trigger("kerberoast", 30, any_of(of("TICKET_REQUEST", "ticket_cipher IN ('0x17', '0x18')"), alert("kerberoast"))), Trigger("dcsync_replication", 30, any_of("kind = 'REPLICATION'", alert("dcsync"))),
        Trigger("credential_tool", 30, any_of(run("mimikatz", "sekurlsa", "lazagne", "rubeus", "secretsdump"), alert("mimikatz"))), Trigger("browser_store_access", 30, of(FILE, has("tfile", "/login data", "/logins.json", "/key4.db"))), Trigger("brute_force", 30, alert("brute force")),
    ), (
        Signal("dumping_tool_in_process_tree", 14, run("procdump", "mimikatz", "comsvcs", "nanodump", "lsassy")), Signal("privileged_user_targeted", 12, has("usr", "admin"), on="trigger"), Signal("memory_dump_file_created", 12, of(FILE, ends("tfile", ".dmp"))),
        Signal("occurred_after_lateral_movement", 10, alert("lateral")), Signal("occurred_on_dc", 10, has("lower(host_name)", "dc"), on="trigger"), Signal("followed_by_pass_the_hash", 12, alert("pass the hash", "pass the ticket")),
    ), (*SHARED, Counter("accessing_process_is_defender", 15, one_of("proc", ["msmpeng.exe", "mssense.exe"])), Counter("accessing_process_is_sysmon", 15, one_of("proc", ["sysmon.exe", "sysmon64.exe"])), Counter("matched_known_av_or_edr_signature", 12, "proc", on="list"), Counter("audit_legitimate_use_window", 10, "usr", on="list"))),
)
BY_NAME = {f.name: f for f in FAMILIES}


def low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def slashed(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def prepared(events: DataFrame) -> DataFrame:
    """The columns that rules read, each computed once; missing canonical columns count as empty."""
    for name, kind in (("volatility", "map<string,string>"), ("event_data", "map<string,string>"), ("md5", "string"), ("user_agent", "string"), ("logon_type", "string"), ("parent_name", "string")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    vol = lambda k: F.coalesce(F.try_element_at("volatility", F.lit(k)), F.lit(""))
    plugin = F.lower(vol("plugin"))
    tfile = slashed(low("target_file"))
    dll = F.when(plugin.contains("dlllist"), slashed(F.lower(F.coalesce(F.nullif(vol("Path"), F.lit("")), vol("BaseName"))))).when(F.col("canonical_type") == FILE, tfile).otherwise("")
    parent = F.coalesce(F.nullif(F.col("parent_name"), F.lit("")), F.nullif(vol("ParentName"), F.lit("")), F.try_element_at("event_data", F.lit("ParentImage")), F.lit(""))
    columns = {
        "kind": F.coalesce("canonical_type", F.lit("")), "alert": low("alert_name"), "cmd": low("command_line"), "proc": low("process_name"), "ppath": slashed(low("process_path")), "tfile": tfile, "fname": F.substring_index(tfile, "/", -1),
        "rkey": slashed(low("registry_key")), "ip": F.coalesce("remote_ip", F.lit("")), "port": F.coalesce(F.col("remote_port"), F.lit(0)), "usr": low("user"), "logon": F.coalesce("logon_type", F.lit("")), "parent": F.substring_index(F.lower(slashed(parent)), "/", -1),
        "plugin": plugin, "vol_path": slashed(F.lower(vol("Path"))), "vol_base": F.lower(vol("BaseName")), "private_memory": F.coalesce(F.try_element_at("volatility", F.lit("PrivateMemory")), F.lit("1")), "vol_ppid": vol("PPID"), "vol_parent": vol("ParentName"), "dll": dll, "ticket_cipher": F.coalesce(F.try_element_at("event_data", F.lit("TicketEncryptionType")), F.lit("")),
        "hour": F.hour("timestamp"), "minute": F.minute("timestamp"), "epoch": F.unix_timestamp("timestamp"),
    }
    # behind a generator, as the optimizer would else put each of them into every rule that reads it
    keep = [c for c in events.columns if c not in columns]
    return events.select(*keep, F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("rule_columns_")).select(*keep, "rule_columns_.*")
