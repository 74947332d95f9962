"""Which event id, action, category or artifact means which canonical type, and what triggers stand for."""

TYPES = ["PROCESS_EXECUTION", "PROCESS_TERMINATION", "NETWORK_CONNECTION", "AUTHENTICATION", "LSASS_ACCESS", "TICKET_REQUEST", "REPLICATION", "LOG_CLEARED", "FILE_CREATION", "FILE_MODIFICATION", "FILE_DELETION", "REGISTRY_MODIFICATION", "SERVICE_INSTALLATION", "SCHEDULED_TASK", "SHADOW_DELETED", "DEFENDER_EXCLUSION_ADDED", "ALERT"]

# fixed values: the type of an event id
EVENT_IDS = {
    "1": "PROCESS_EXECUTION",
    "3": "NETWORK_CONNECTION",
    "11": "FILE_CREATION",
    "12": "REGISTRY_MODIFICATION",
    "13": "REGISTRY_MODIFICATION",
    "22": "NETWORK_CONNECTION",
    "23": "FILE_DELETION",
    "104": "LOG_CLEARED",
    "1102": "LOG_CLEARED",
    "4624": "AUTHENTICATION",
    "4625": "AUTHENTICATION",
    "4634": "AUTHENTICATION",
    "4647": "AUTHENTICATION",
    "4648": "AUTHENTICATION",
    "4656": "LSASS_ACCESS",
    "4657": "REGISTRY_MODIFICATION",
    "4663": "FILE_MODIFICATION",
    "4672": "AUTHENTICATION",
    "4688": "PROCESS_EXECUTION",
    "4689": "PROCESS_EXECUTION",
    "4697": "SERVICE_INSTALLATION",
    "4698": "SCHEDULED_TASK",
    "4702": "SCHEDULED_TASK",
    "4769": "TICKET_REQUEST",
    "4934": "REPLICATION",
    "4935": "REPLICATION",
    "5156": "NETWORK_CONNECTION",
    "5157": "NETWORK_CONNECTION",
    "7036": "SERVICE_INSTALLATION",
    "7045": "SERVICE_INSTALLATION",
    "chainsaw-alert": "ALERT",
    "hayabusa-alert": "ALERT",
    "sigma-alert": "ALERT",
}
# fixed values: the type of an action
ACTIONS = {
    "kerberos-tgs-request": "TICKET_REQUEST",
    "log-cleared": "LOG_CLEARED",
    "logon-failure": "AUTHENTICATION",
    "logon-success": "AUTHENTICATION",
    "network-connection-allowed": "NETWORK_CONNECTION",
    "network-connection-blocked": "NETWORK_CONNECTION",
    "object-access-attempt": "FILE_MODIFICATION",
    "object-deleted": "FILE_DELETION",
    "process-create": "PROCESS_EXECUTION",
    "process-created": "PROCESS_EXECUTION",
    "registry-key-modified": "REGISTRY_MODIFICATION",
    "scheduled-task-created": "SCHEDULED_TASK",
    "script-block-logged": "PROCESS_EXECUTION",
    "service-installed": "SERVICE_INSTALLATION",
    "sigma-alert": "ALERT",
}
# fixed values: the type of a category
CATEGORIES = {"authentication": "AUTHENTICATION", "file": "FILE_MODIFICATION", "intrusion_detection": "ALERT", "malware": "ALERT", "network": "NETWORK_CONNECTION", "process": "PROCESS_EXECUTION", "registry": "REGISTRY_MODIFICATION"}
# fixed values: the type of an artifact code
ARTIFACTS = {
    "apache_log": "NETWORK_CONNECTION",
    "auth_log": "AUTHENTICATION",
    "evtx": "PROCESS_EXECUTION",
    "evtx_folder": "PROCESS_EXECUTION",
    "jumplist": "FILE_CREATION",
    "lnk": "FILE_CREATION",
    "memory": "PROCESS_EXECUTION",
    "mft": "FILE_MODIFICATION",
    "pcap": "NETWORK_CONNECTION",
    "prefetch": "PROCESS_EXECUTION",
    "registry": "REGISTRY_MODIFICATION",
    "win_timeline": "ALERT",
}
# fixed values: the type of a memory plugin
PLUGINS = {
    "cmdline": "PROCESS_EXECUTION",
    "dlllist": "PROCESS_EXECUTION",
    "malfind": "ALERT",
    "netscan": "NETWORK_CONNECTION",
    "netstat": "NETWORK_CONNECTION",
    "pslist": "PROCESS_EXECUTION",
    "psscan": "PROCESS_EXECUTION",
    "pstree": "PROCESS_EXECUTION",
}

# fixed values: what an event id is called, and its category
EVENT_ACTIONS = {
    "1": "process-create", "3": "network-connection", "7": "image-loaded", "8": "create-remote-thread", "10": "process-access", "11": "file-create", "12": "registry-object-added-deleted", "13": "registry-value-set", "15": "file-create-stream-hash",
    "21": "rdp-logon-succeeded", "22": "dns-query", "23": "file-delete", "24": "rdp-session-disconnected", "25": "process-tampering", "4103": "module-logged", "4104": "script-block-logged", "4624": "logon-success", "4625": "logon-failure",
    "4634": "logoff", "4647": "user-initiated-logoff", "4648": "explicit-credentials-logon", "4656": "handle-requested", "4660": "object-deleted", "4663": "object-access-attempt", "4672": "special-privileges-assigned", "4688": "process-created",
    "4689": "process-terminated", "4698": "scheduled-task-created", "4702": "scheduled-task-updated", "4720": "user-account-created", "4722": "user-account-enabled", "4724": "password-reset-attempt", "4725": "user-account-disabled",
    "4726": "user-account-deleted", "4728": "member-added-to-global-group", "4732": "member-added-to-local-group", "4756": "member-added-to-universal-group", "5156": "network-connection-allowed", "5157": "network-connection-blocked",
    "5861": "wmi-activity", "7036": "service-state-changed", "7045": "service-installed",
}
EVENT_CATEGORIES = {
    "1": "process", "3": "network", "11": "file", "22": "network", "4104": "process", "4624": "authentication", "4625": "authentication", "4634": "authentication", "4647": "authentication", "4648": "authentication", "4660": "file",
    "4663": "file", "4672": "authentication", "4688": "process", "4689": "process", "4698": "configuration", "4720": "iam", "4722": "iam", "4724": "iam", "4725": "iam", "4726": "iam", "4728": "iam", "4732": "iam", "4756": "iam",
    "5156": "network", "5157": "network", "7045": "configuration",
}

# fixed values: techniques of a trigger; the first entry whose name contains the trigger's, or the other way round, counts
TECHNIQUES = {
    "sam_hive_copy": "T1003.002", "lsass_access_or_dump": "T1003.001", "ntds_dump": "T1003.003", "process_masquerading": "T1036", "amsi_bypass": "T1562.001", "etw_tamper": "T1562.006", "edr_disable": "T1562.001",
    "process_injection": "T1055", "uac_bypass": "T1548.002", "service_install": "T1543.003", "scheduled_task_creation": "T1053.005", "registry_run_key": "T1547.001", "startup_folder": "T1547.001",
    "dll_search_order_hijacking": "T1574.001", "cloud_upload_tool": "T1567.002", "ransom_note_pattern": "T1486", "archive_creation_unusual_path": "T1560", "shadow_copy_deletion": "T1490", "psexec_usage": "T1569.002",
    "pass_the_hash_ticket": "T1550.002", "new_service_remote": "T1543.003", "service_remote_install": "T1543.003", "scheduled_task_remote": "T1053.005",
}
# fixed values: triggers of ordinary activity, and parts of the names of triggers that are always kept
NOISE = ["new_service_remote", "service_install", "service_remote_install", "scheduled_task_remote", "scheduled_task_creation"]
KEEP = ["lsass_access", "sam_hive", "psexec", "amsi_bypass", "etw_tamper", "edr_disable", "process_injection", "process_masquerad", "uac_bypass", "pass_the_hash", "shadow_copy", "ransom", "cloud_upload", "archive_creation", "ntds_dump", "kerberoast"]
# fixed values: causal levels, what they weigh, and those that may carry a claim of cause
CAUSAL_WEIGHTS = {"CHAIN": 15, "WRITE": 12, "NET": 10, "TIGHT_TIME": 6, "CO_OCCUR": 3, "TEMPORAL_ONLY": 1, "UNSUPPORTED": 0}
CAUSAL_RANK = {"CHAIN": 6, "WRITE": 5, "NET": 4, "TIGHT_TIME": 3, "CO_OCCUR": 2, "TEMPORAL_ONLY": 1, "UNSUPPORTED": 0}
STRONG_CAUSES = ["CHAIN", "WRITE", "NET"]
# fixed values: phrases that claim a cause
CAUSAL_PHRASES = ["caused", "led to", "enabled", "resulted in", "triggered", "launched", "spawned", "executed via", "dropped by", "deployed by", "initiated by", "established by", "pivoted to", "moved laterally", "exfiltrated via", "propagated to", "chained to", "which then"]
# fixed values: words that claim a cause where a hypothesis is staged
GATE_PHRASES = ["caused", "led to", "resulted in", "triggered", "because", "due to"]
# fixed values: what provenance and the strength of a cluster weigh
PROVENANCE_WEIGHTS = {"MCP": 20, "HOOK": 15, "SHELL": 8, "NONE": 0}
STRENGTH_WEIGHTS = {"STRONG": 15, "MODERATE": 10, "WEAK": 4, "NOISE": 0}
# fixed values: prefixes of audit ids
HOOK_PREFIXES = ["hook-", "ingest-", "constructor-", "auto-seed-"]
SHELL_PREFIXES = ["shell-", "manual-", "cli-"]
# fixed values: what a collected file is, by its extension, its name, and a part of its path, in this order
EXTENSIONS = {
    ".e01": "e01", ".ex01": "e01", ".e02": "e01", ".evtx": "evtx", ".evt": "evtx", ".mem": "memory", ".dmp": "memory", ".vmem": "memory", ".raw": "memory", ".lime": "memory", ".001": "memory", ".002": "memory", ".003": "memory", ".004": "memory",
    ".pf": "prefetch", ".pcap": "pcap", ".pcapng": "pcap", ".cap": "pcap", ".lnk": "lnk", ".pst": "outlook", ".ost": "outlook", ".automaticdestinations-ms": "jumplist", ".customdestinations-ms": "jumplist", ".csv": "win_timeline", ".json": "win_timeline",
    ".jsonl": "win_timeline", ".mans": "redline_mans", ".plaso": "plaso_storage", ".zip": "kape_zip",
} | {x: "unknown" for x in (".exe", ".dll", ".sys", ".bat", ".cmd", ".vbs", ".ps1", ".js", ".vbe", ".scr", ".msi", ".dat", ".doc", ".docx", ".xls", ".xlsx", ".pdf", ".txt", ".rtf", ".log")}
FILE_NAMES = {
    "$mft": "mft", "$j": "usn_journal", "$usnjrnl": "usn_journal", "$logfile": "logfile", "amcache.hve": "amcache", "appcompatcache": "shimcache", "srudb.dat": "srum", "activitiescache.db": "win_timeline", "history": "browser_history", "places.sqlite": "browser_history",
    "webcachev01.dat": "browser_history", "auth.log": "auth_log", "secure": "auth_log", "syslog": "syslog", "messages": "syslog", ".bash_history": "bash_history", "audit.log": "auditd", "shellbag": "shellbag",
}
HIVES = ["sam", "security", "system", "software", "ntuser.dat", "usrclass.dat", "default", "components", "schema.dat", "drivers", "elam"]
PATH_PARTS = {
    "$recycle.bin": "recyclebin", "recyclebin": "recyclebin", "/scheduled tasks/": "scheduled_task_xml", "/automaticdestinations/": "jumplist", "/customdestinations/": "jumplist", "/iis/logs/": "iis_log", "/inetpub/logs/": "iis_log", "/apache2/": "apache_log",
    "/httpd/": "apache_log", "/shimcache/": "shimcache", "/volatility/": "memory", "/memory/": "memory", "/timeline/": "win_timeline", "/redline/": "win_timeline",
}

# fixed values: action and category of an event id in a timeline
TIMELINE_EVENTS = {
    "4624": ("logon-success", "authentication"), "4625": ("logon-failure", "authentication"), "4634": ("logoff", "authentication"), "4647": ("logoff", "authentication"), "4648": ("logon-explicit", "authentication"),
    "4672": ("special-privileges", "authentication"), "4768": ("kerberos-tgt-request", "authentication"), "4769": ("kerberos-tgs-request", "authentication"), "4776": ("ntlm-credential-validation", "authentication"),
    "4778": ("session-reconnected", "authentication"), "4779": ("session-disconnected", "authentication"), "4688": ("process-created", "process"), "4689": ("process-terminated", "process"), "1": ("process-created", "process"),
    "5156": ("network-connection-allowed", "network"), "5157": ("network-connection-blocked", "network"), "3": ("network-connection-allowed", "network"), "7045": ("service-installed", "configuration"), "7036": ("service-state-change", "configuration"),
    "4697": ("service-installed", "configuration"), "4698": ("scheduled-task-created", "configuration"), "4702": ("scheduled-task-updated", "configuration"), "4657": ("registry-key-modified", "registry"), "4663": ("object-access-attempt", "file"),
    "4656": ("handle-requested", "file"), "1102": ("log-cleared", "iam"), "104": ("log-cleared", "iam"), "4934": ("ad-replication-attempt", "iam"), "4935": ("ad-replication-failure", "iam"), "4103": ("powershell-pipeline", "process"),
    "4104": ("script-block-logged", "process"), "4105": ("script-block-started", "process"),
}
# fixed values: code, action and category of another source type
TIMELINE_SOURCES = {
    "WinPrefetch": ("prefetch", "prefetch-execution", "process"), "AppCompatCache Registry Entry": ("shimcache", "shimcache-execution", "process"), "File entry shell item": ("shellitem", "file-accessed", "file"),
    "MSIE Cache File URL record": ("webhist", "web-history", "network"), "Firefox History": ("webhist", "web-history", "network"), "Firefox Cache": ("webhist", "web-cache", "network"), "File stat": ("filestat", "file-modified", "file"),
    "NTFS USN change": ("usn", "file-modified", "file"),
}
# fixed values: the canonical type of a data type, and of an event id in an event record
DATA_TYPES = {
    "fs:stat": "FILE_MODIFICATION", "fs:stat:ntfs": "FILE_MODIFICATION", "windows:registry:key_value": "REGISTRY_MODIFICATION", "windows:registry:appcompatcache": "PROCESS_EXECUTION", "windows:registry:bagmru": "FILE_CREATION",
    "windows:registry:run": "REGISTRY_MODIFICATION", "windows:registry:userassist": "PROCESS_EXECUTION", "windows:registry:windows_version": "REGISTRY_MODIFICATION", "windows:lnk:link": "FILE_CREATION", "windows:prefetch:execution": "PROCESS_EXECUTION",
    "windows:shell_item:file_entry": "FILE_CREATION", "windows:tasks:job": "SCHEDULED_TASK", "msie:webcache:container": "NETWORK_CONNECTION", "msiecf:url": "NETWORK_CONNECTION", "firefox:places:bookmark": "NETWORK_CONNECTION", "firefox:places:page_visited": "NETWORK_CONNECTION",
}
RECORD_TYPES = {
    "PROCESS_EXECUTION": ["1", "4688", "4689"], "NETWORK_CONNECTION": ["3", "5156", "5157"], "AUTHENTICATION": ["4624", "4625", "4634", "4647", "4648", "4672", "4768", "4776", "4778", "4779"], "TICKET_REQUEST": ["4769"], "LSASS_ACCESS": ["4656"],
    "FILE_MODIFICATION": ["4663"], "FILE_CREATION": ["11"], "FILE_DELETION": ["23"], "REGISTRY_MODIFICATION": ["12", "13", "4657"], "SERVICE_INSTALLATION": ["7045", "7036", "4697"], "SCHEDULED_TASK": ["4698", "4702"], "LOG_CLEARED": ["1102", "104"], "REPLICATION": ["4934", "4935"],
}
# fixed values: the fields of an event record's strings, by position
_SUBJECT = ["SubjectUserSid", "SubjectUserName", "SubjectDomainName", "SubjectLogonId"]
_TARGET = ["TargetUserSid", "TargetUserName", "TargetDomainName"]
_SESSION = ["AccountName", "AccountDomain", "LogonID", "SessionName", "ClientName", "ClientAddress"]
LAYOUTS = {
    "4624": [*_SUBJECT, *_TARGET, "TargetLogonId", "LogonType", "LogonProcessName", "AuthenticationPackageName", "WorkstationName", "LogonGuid", "TransmittedServices", "LmPackageName", "KeyLength", "ProcessId", "ProcessName", "IpAddress", "IpPort"],
    "4625": [*_SUBJECT, *_TARGET, "Status", "FailureReason", "SubStatus", "LogonType", "LogonProcessName", "AuthenticationPackageName", "WorkstationName", "TransmittedServices", "LmPackageName", "KeyLength", "ProcessId", "ProcessName", "IpAddress", "IpPort"],
    "4634": [*_TARGET, "TargetLogonId", "LogonType"],
    "4647": [*_TARGET, "TargetLogonId"],
    "4648": [*_SUBJECT, "LogonGuid", "TargetUserName", "TargetDomainName", "TargetLogonGuid", "TargetServerName", "TargetInfo", "ProcessId", "ProcessName", "IpAddress", "IpPort"],
    "4672": [*_SUBJECT, "PrivilegeList"],
    "4688": [*_SUBJECT, "NewProcessId", "NewProcessName", "TokenElevationType", "ProcessId", "CommandLine", *_TARGET, "TargetLogonId", "ParentProcessName", "MandatoryLabel"],
    "4697": [*_SUBJECT, "ServiceName", "ServiceFileName", "ServiceType", "ServiceStartType", "ServiceAccount"],
    "7045": ["ServiceName", "ImagePath", "ServiceType", "StartType", "AccountName"],
    "4768": ["TargetUserName", "TargetDomainName", "TargetSid", "ServiceName", "ServiceSid", "TicketOptions", "Status", "TicketEncryptionType", "PreAuthType", "IpAddress", "IpPort", "CertIssuerName", "CertSerialNumber", "CertThumbprint"],
    "4769": ["TargetUserName", "TargetDomainName", "ServiceName", "ServiceSid", "TicketOptions", "TicketEncryptionType", "IpAddress", "IpPort", "Status", "LogonGuid", "TransmittedServices"],
    "4770": ["TargetUserName", "TargetDomainName", "ServiceName", "ServiceSid", "TicketOptions", "TicketEncryptionType"],
    "4776": ["PackageName", "TargetUserName", "Workstation", "Status"],
    "4778": _SESSION,
    "4779": _SESSION,
    "4656": [*_SUBJECT, "ObjectServer", "ObjectType", "ObjectName", "HandleId", "TransactionId", "AccessList", "AccessReason", "AccessMask", "PrivilegeList", "RestrictedSidCount", "ProcessId", "ProcessName", "ResourceAttributes"],
    "4663": [*_SUBJECT, "ObjectServer", "ObjectType", "ObjectName", "HandleId", "AccessList", "AccessMask", "ProcessId", "ProcessName", "ResourceAttributes"],
    "1102": _SUBJECT,
}
# fixed values: fields that a message without positions names
NAMED_FIELDS = ["LogonType", "IpAddress", "TargetUserName", "WorkstationName", "ProcessCommandLine", "ProcessName", "ServiceName", "SubjectUserName"]

# fixed values: triage of files by extension and folder
SCRIPTS = [".bat", ".cmd", ".ps1", ".vbs", ".vbe", ".js", ".jse", ".hta", ".wsf"]
BINARIES = [".exe", ".dll", ".sys", ".scr", ".msi", ".dat", ".doc", ".docx", ".xls", ".xlsx", ".pdf", ".rtf", ".xml", ".cfg", ".ini", ".inf"]
HARMLESS = [".txt", ".log", ".yaml", ".yml", ".md", ".rst", ".ioc"]
SYSTEM_FOLDERS = [
    "windows/system32", "windows/syswow64", "windows/winsxs", "windows/servicing", "windows/assembly", "windows/microsoft.net", "windows/softwaredistribution", "windows/fonts", "windows/globalization", "windows/resources", "windows/csc",
    "program files", "program files (x86)", "programdata/microsoft", "programdata/package cache",
]
LIBRARY_FOLDERS = ["windows/system32", "windows/syswow64", "windows/winsxs", "windows/assembly", "windows/microsoft.net/"]
SUSPICIOUS_PLACES = [
    "/temp/", "/tmp/", "/downloads/", "/appdata/", "/programdata/", "/users/public/", "/recycler/", "/recycle.bin", "/startup/", "/start menu/programs/startup", "/tasks/", "/prefetch/", "/windows/tasks", "/perflogs/", "/system volume information",
]

# fixed values: folders that are no host, parts of names that no host has, folders that stand in a host's, and words of a name that are none
NO_HOSTS = [
    "c", "d", "e", "f", "windows", "system32", "users", "programdata", "program files", "program files (x86)", "appdata", "local", "roaming", "temp", "evidence", "triage", "kape", "output", "results", "logs", "evtx", "registry", "memory", "prefetch",
    "timeline", "filesystem", "winevt", "config", "regback", "bulk", "color", "template", "shadow", "volume", "precooked", "shimcache", "amcache", "c_drive", "exports", "mounted",
]
NO_HOST_PARTS = ["win7", "win10", "winxp", "win2008", "win2012", "win2016", "c_drive", "drive", "32", "64", "x86", "x64", "extracted", "output", "triage"]
IN_HOSTS = ["c", "c_drive", "filesystem", "eventlogs", "registry", "prefetch", "amcache", "shimcache", "srum", "mft", "usnjrnl", "precooked", "timeline", "evtx"]
NO_HOST_WORDS = ["win7", "win", "xp", "c", "drive", "32", "64", "86", "timeline", "template", "shadow", "volume", "color", "bulk", "agent"]
HOST_PATTERN = r"(?i)^(?:wkstn|ws|dc|srv|pc|host|server|desktop|laptop)|^[a-z]{2,10}[-_]\d{1,4}$|^[cdef]_drive$|^\d{1,3}(?:\.\d{1,3}){3}$"
HOST_START = r"(?i)^(?:dc|srv|pc|wkstn|ws|host|server|img|vm)"
