"""One event that meets each trigger, signal and counter, and one that just doesn't; written by hand from the specification."""

from pyspark.sql import functions as F

from casegraph.operators.cluster import build_clusters, trigger_hits, with_bits
from casegraph.operators.graph import saved
from casegraph.operators.rules import BY_NAME, FAMILIES, prepared
from casegraph.sources import driver

COLUMNS = "event_id string, case_id string, host_name string, timestamp string, canonical_type string, user string, process_name string, process_path string, command_line string, target_file string, remote_ip string, remote_port int, registry_key string, alert_name string, logon_type string, parent_name string, user_agent string, md5 string, volatility map<string,string>, event_data map<string,string>"
NAMES = [c.strip().split(" ")[0] for c in COLUMNS.split(", ")]


def A(name):
    return {"canonical_type": "ALERT", "alert_name": name}


def P(cmd="", **f):
    return {"canonical_type": "PROCESS_EXECUTION", "command_line": cmd} | f


def T(path):
    return {"canonical_type": "FILE_CREATION", "target_file": path}


def N(ip="203.0.113.9", port=443):
    return {"canonical_type": "NETWORK_CONNECTION", "remote_ip": ip, "remote_port": port}


def U(logon):
    return {"canonical_type": "AUTHENTICATION", "logon_type": logon}


def K(kind, **f):
    return {"canonical_type": kind} | f


SVC, TASK, LONG64 = K("SERVICE_INSTALLATION"), K("SCHEDULED_TASK"), "A" * 70
#: family: {trigger: (an event that meets it, one that doesn't)}
TRIGGERS = {
    "LateralMovement": {
        "network_logon_type3_from_internal": (U("3"), U("2")), "rdp_logon": (A("RDP logon"), A("RDP policy")), "smb_admin_share_write": (T(r"\\DC01\C$\Windows\m.exe"), T(r"\\DC01\data\m.exe")), "wmi_remote_execution": (P("wmic /node:x process"), P("wmic process")),
        "psexec_usage": (P("PAExec x"), P("exec x")), "powershell_remoting": (P("icm -ComputerName x"), P("icm x")), "ssh_lateral": (N(port=22), N(port=23)), "pass_the_hash_ticket": (P("sekurlsa::tickets"), P("sekurlsa::logon")), "new_service_remote": (SVC, A("service local")), "scheduled_task_remote": (A("Scheduled task, remote"), A("scheduled task")),
    },
    "Persistence": {
        "registry_run_key": (K("REGISTRY_MODIFICATION", registry_key=r"HKLM\x\CurrentVersion\Run\upd"), K("REGISTRY_MODIFICATION", registry_key=r"HKLM\x\Runner\upd")), "scheduled_task_creation": (P("schtasks /create"), P("schtasks /query")), "wmi_event_subscription": (P("wmic event consumer"), P("wmic os")), "service_install": (P("sc create x"), P("sc query")),
        "startup_folder": (T(r"C:\u\Start Menu\Programs\Startup\a.lnk"), T(r"C:\u\Start\a.lnk")), "bits_job_persistence": (P("bitsadmin /addfile x"), P("bitsadmin /list")), "dll_search_order_hijacking": (T(r"C:\Windows\SysWOW64\v.dll"), T(r"C:\app\v.dll")),
    },
    "RemoteExecution": {
        "office_spawning_shell": (P(process_name="CMD.exe", parent_name="WINWORD.EXE"), P(process_name="notepad.exe", parent_name="winword.exe")), "psexec_usage": (A("remote execution"), A("smbexec")), "wmi_remote_execution": (A("WMI remote"), A("WMI local")), "powershell_remoting": (P("icm x"), P("ic x")), "scheduled_task_remote": (TASK, A("task remote")),
        "service_remote_install": (SVC, A("service x")), "winrm_remote_management": (N(port=5986), N(port=5987)),
    },
    "DefenseEvasion": {
        "obfuscated_powershell": (P("powershell -enc AAAA", process_name="powershell.exe"), P("x -enc AAAA", process_name="x.exe")), "amsi_bypass": (P("amsiInitFailed"), P("ams init")), "etw_tamper": (P("patch etw"), P("etw")), "edr_disable": (P("Set-MpPreference x"), P("Get-MpPreference x")), "process_injection": (P("CreateRemoteThread"), P("CreateThread")),
        "process_masquerading": (P(process_name="svchost.exe", process_path=r"C:\Temp\svchost.exe"), P(process_name="svchost.exe", process_path=r"C:\Windows\System32\svchost.exe")), "uac_bypass": (P("fodhelper.exe & reg add hkcu"), P("fodhelper.exe")), "sigma_defense_evasion": (A("TA0005"), A("TA0006")),
    },
    "Beaconing": {
        "periodic_outbound_low_jitter": (N("10.0.0.1"), N("127.0.0.1")), "dga_dns_pattern": (A("dga domain"), A("dns")), "low_rep_destination": (A("suspicious ip"), A("ip")), "cobalt_strike_pipe": (A("named pipe"), A("pipe")), "dns_tunnel_pattern": (A("DNS exfil"), A("DNS")), "user_agent_anomaly": (A("odd user-agent"), A("agent")),
        "non_standard_port_external": (N(port=1025), N(port=1024)), "ja3_known_malicious": (A("JA3"), A("TLS")),
    },
    "Collection": {
        "mass_file_enumeration": (A("recursive read"), A("read")), "archive_creation_unusual_path": (T(r"C:\ProgramData\a.7z"), T(r"C:\data\a.7z")), "password_grep_pattern": (P("findstr /s passwd"), P("findstr /s name")), "document_recursive_enumeration": (A("file collection"), A("file")), "screenshot_or_clipboard_yara": (A("keylogger"), A("key")), "outlook_pst_access_unusual": (A("PST opened"), A("post")),
    },
    "Exfiltration": {
        "large_outbound_transfer": (N(), N("172.16.0.1")), "cloud_upload_tool": (P("gsutil cp"), P("cp")), "archive_before_transfer": (T("/users/public/a.tar.gz"), T("/users/public/a.txt")), "dns_exfil_pattern": (A("dns tunnel"), A("tunnel")), "https_non_standard_port": (N(port=8443), N(port=9000)), "smb_to_external": (N(port=139), N("10.1.1.1", 139)),
    },
    "Impact": {
        "mass_file_modification": (A("mass file encrypt"), A("mass file")), "ransomware_extension_pattern": (T("a.lockbit"), T("a.lock")), "shadow_copy_deletion": (A("Shadow deletion"), A("shadow")), "backup_destruction": (P("wbadmin delete catalog"), P("wbadmin get")), "ransom_note_pattern": (T("/x/help_decrypt.txt"), T("/x/help_decrypt.png")), "mass_service_stop": (A("stop services"), A("stop")),
        "mass_account_lockout": (A("brute force"), A("brute")),
    },
    "LogClearing": {"evtx_1102_clear": (P("wevtutil cl security"), P("wevtutil qe")), "evtx_104_alt_clear": (A("104 log"), A("104")), "recordid_gap": (A("missing event"), A("record id gap")), "evtx_truncated": (A("truncated evtx"), A("truncated"))},
    "Timestomp": {"si_fn_timestamp_mismatch": (A("timestomp"), A("time")), "si_before_fn": (A("impossible timestamp"), A("impossible")), "rounded_second_timestamps": (A("rounded timestamp"), A("rounded")), "backdated_file": (A("backdated"), A("dated"))},
    "ShadowDeletion": {
        "vssadmin_delete_shadows": (P("vssadmin delete shadows"), P("vssadmin list shadows")), "wmic_shadowcopy_delete": (P("wmic shadowcopy delete"), P("wmic shadowcopy")), "diskshadow_delete": (A("diskshadow delete"), A("diskshadow")), "evtx_524": (A("524 shadow"), A("524")),
        "powershell_remove_wmiobject_shadow": (P("powershell Get-WmiObject Win32_ShadowCopy | delete"), P("powershell Win32_ShadowCopy delete")),
    },
    "MemoryAnomaly": {
        "pe_header_in_private_memory": (K("ALERT", volatility={"plugin": "windows.malfind", "PrivateMemory": "1"}), K("ALERT", volatility={"plugin": "windows.malfind", "PrivateMemory": "0"})), "unsigned_dll_in_writable_path": (T(r"C:\Users\a\AppData\z.dll"), T(r"C:\app\z.dll")),
        "process_no_image_path": (P(volatility={"plugin": "psscan"}), P(process_name="a.exe", volatility={"plugin": "psscan"})), "sigma_process_injection_alert": (A("Process  Hollowing"), A("hollow")), "executable_in_writable_path": (P(process_path=r"C:\Windows\Temp\x.exe"), P(process_path=r"C:\x\x.exe")),
    },
    "SuspiciousLineage": {
        "office_spawned_interpreter": (P(process_name="mshta.exe", parent_name=r"C:\o\ACRORD32.EXE"), P(process_name="mshta.exe", parent_name="explorer.exe")), "lolbin_with_http_url": (P("mshta https://x.y/a", process_name="mshta.exe"), P("mshta a", process_name="mshta.exe")), "orphan_or_spoofed_parent": (P(volatility={"plugin": "pstree", "PPID": "4"}), P(volatility={"plugin": "pstree", "PPID": "4", "ParentName": "a"})),
        "long_base64_in_cmdline": (P("run some program " + LONG64), P("run " + LONG64)), "executable_in_writable_dir": (P(process_path=r"C:\Users\a\Downloads\x.exe"), P(process_path=r"C:\Users\a\x.exe")),
    },
    "CredentialAccess": {
        "lsass_access_or_dump": (K("LSASS_ACCESS"), A("sass")), "sam_hive_copy": (P(r"reg save hklm\sam C:\s"), P(r"reg query hklm\sam")), "ntds_dump": (P("ntdsutil"), P("ntds")), "kerberoast": (K("TICKET_REQUEST", event_data={"TicketEncryptionType": "0x17"}), K("TICKET_REQUEST", event_data={"TicketEncryptionType": "0x12"})), "dcsync_replication": (K("REPLICATION"), A("sync")),
        "credential_tool": (P("lazagne all"), P("lasagne")), "browser_store_access": (T(r"C:\u\key4.db"), T(r"C:\u\key.db")), "brute_force": (A("brute force"), A("force")),
    },
}
#: family: {signal: (an event near the cluster that raises it, one that doesn't)}; fields of the first event where it is about that.
SIGNALS = {
    "LateralMovement": {"new_admin_account": (A("new account in admin group"), A("new account")), "tools_dropped_on_target": (T("a.ps1"), T("a.txt")), "occurred_after_initial_compromise": (A("execution"), A("phishing")), "source_host_has_other_attack_signals": (A("persistence"), A("mimikatz"))},
    "Persistence": {"executable_unsigned": (A("unsigned"), A("signed")), "executable_in_temp": (T(r"C:\Temp\x"), T(r"C:\Tempo\x")), "hidden_or_system_attribute": (A("hidden"), A("x")), "no_corresponding_installer": (P(process_name="a.exe"), P(process_name="Setup.exe"))},
    "RemoteExecution": {"occurred_after_lateral_movement": (A("smb"), A("x")), "new_admin_share_created": (A("share"), A("x")), "executed_by_non_admin": ({"user": "bob"}, {"user": "the Admin"}), "malicious_payload_detected": (P("certutil -f"), A("malicious payload"))},
    "DefenseEvasion": {"occurred_after_initial_access": (A("lateral"), A("phishing")), "malicious_tool_present": (P(process_name="Mimikatz.exe"), A("mimikatz")), "persistence_mechanism_present": (TASK, A("task")), "memory_manipulation_apis": (P("VirtualProtect"), P("CreateRemoteThread"))},
    "Beaconing": {"destination_unique_to_one_host": (N("203.0.113.9"), N("203.0.113.10")), "occurred_after_initial_access": (A("lateral movement"), A("lateral")), "persistence_present_on_same_host": (SVC, TASK), "beacon_interval_known_malicious_family": (A("trickbot"), A("beacon"))},
    "Collection": {"occurred_after_lateral_movement": (A("lateral"), A("x")), "files_from_high_value_paths": (T(r"C:\payroll\x"), T(r"C:\legal\x")), "encrypted_archive_creation": (P("7z a -p1"), P("7z a")), "occurred_outside_business_hours": ({"timestamp": "2024-05-01 17:00:00"}, {"timestamp": "2024-05-01 16:59:59"})},
    "Exfiltration": {"occurred_after_collection": (A("archive"), A("x")), "sensitive_file_types": (T("a.bak"), T("a.kdbx")), "multiple_destinations": (N("203.0.113.10"), N("203.0.113.9"))},
    "Impact": {"occurred_after_credential_access": (A("lsass"), A("mimikatz")), "affected_dc_or_file_server": ({"host_name": "NAS1"}, {"host_name": "ws1"}), "persistence_destruction_pattern": (A("delete task"), P("cipher /w")), "anti_forensic_co_occurrence": (A("timestomp"), K("LOG_CLEARED"))},
    "LogClearing": {"cleared_by_non_admin": ({"user": "bob"}, {"user": "administrator"}), "occurred_during_other_attack_signals": (A("defense evasion"), A("exploit")), "multiple_logs_cleared_same_window": (A("sysmon cleared, system"), A("sysmon cleared"))},
    "Timestomp": {"affected_file_in_persistence_path": (T(r"C:\Users\Public\x"), T(r"C:\tasks\x")), "affected_file_unsigned": (A("unsigned"), A("x")), "affected_file_in_system32": (T(r"C:\Windows\SysWOW64\x"), T(r"C:\system32\x")), "occurred_with_other_attack_signals": (A("credential"), A("ransom"))},
    "ShadowDeletion": {"executed_by_non_admin": ({"user": "bob"}, {"user": r"NT AUTHORITY\x"}), "followed_by_mass_file_modification": (A("encrypt"), A("x")), "occurred_with_backup_destruction": (P("bcdedit /set"), P("wbadmin get"))},
    "MemoryAnomaly": {"co_occurs_with_lolbin": (P(process_name="MSXSL.exe"), P(process_name="wscript.exe")), "followed_by_network_connection": (N("10.0.0.1"), N(None)), "co_occurs_with_credential_access": (K("LSASS_ACCESS"), A("mimikatz"))},
    "SuspiciousLineage": {"writable_path_with_lolbin": (P(process_name="forfiles.exe"), P(process_name="a.exe")), "followed_by_outbound_network": (N("8.8.8.8"), N("169.254.1.1")), "persistence_co_occurs": (TASK, A("task"))},
    "CredentialAccess": {"dumping_tool_in_process_tree": (P("procdump x"), P("dump")), "privileged_user_targeted": ({"user": "adminx"}, {"user": "bob"}), "memory_dump_file_created": (T("l.dmp"), T("l.dm")), "occurred_after_lateral_movement": (A("lateral"), A("x")), "occurred_on_dc": ({"host_name": "DC1"}, {"host_name": "ws1"}), "followed_by_pass_the_hash": (A("pass the hash"), A("hash"))},
}
#: family: {counter: (fields of the first event that lower the score, fields that don't)}
COUNTERS = {
    "LateralMovement": {"documented_jump_server": ({"host_name": "RDP-GW"}, {"host_name": "gw"}), "sccm_puppet_action": ({"process_name": "Puppet.exe"}, {"command_line": "puppet"}), "help_desk_remote_support": ({"process_name": "bomgar.exe"}, {"command_line": "anydesk"}), "user_documented_it_admin": ({"user": "helpdesk1"}, {"user": "bob"})},
    "Persistence": {"documented_software_install": ({"process_name": "Install.exe"}, {"command_line": "setup.exe"}), "signed_by_known_publisher": ({"process_path": r"C:\Good\a.exe"}, {"process_path": r"C:\bad\a.exe"}), "gpo_deployment": ({"host_name": "listed"}, {"host_name": "other"})},
    "RemoteExecution": {"documented_sccm_activity": ({"process_name": "smsagenthost.exe"}, {"process_name": "sccm.exe"}), "documented_puppet_chef": ({"process_name": "chef-client.exe"}, {"process_name": "chef.exe"}), "help_desk_remote_support": ({"process_name": "teamviewer.exe"}, {"process_name": "viewer.exe"})},
    "DefenseEvasion": {"documented_software_install": ({"process_name": "setup.exe"}, {"process_name": "set.exe"}), "system_update": ({"process_name": "usoclient.exe"}, {"command_line": "windowsupdate"}), "legitimate_admin_tool": ({"process_name": "pslist.exe"}, {"process_name": "mmc.exe"})},
    "Beaconing": {"destination_in_corporate_baseline": ({"remote_ip": "203.0.113.77"}, {"remote_ip": "203.0.113.78"}), "destination_is_software_updater": ({"remote_ip": "203.0.113.77"}, {"remote_ip": "203.0.113.78"}), "user_agent_matches_legitimate_app": ({"user_agent": "Listed"}, {"user_agent": "x"})},
    "Collection": {"matched_backup_software_pattern": ({"process_name": "veeamagent.exe"}, {"process_name": "tar.exe"}), "within_indexing_service_pattern": ({"process_name": "searchindexer.exe"}, {"process_name": "indexer.exe"}), "user_documented_data_owner": ({"user": "Listed"}, {"user": "x"})},
    "Exfiltration": {"matched_documented_backup_routine": ({"process_name": "listed"}, {"process_name": "x"}), "known_software_sync": ({"process_name": "boxsync.exe"}, {"command_line": "dropbox"}), "user_documented_travel": ({"user": "listed"}, {"user": "x"})},
    "Impact": {"matched_documented_decommission": ({"host_name": "Listed"}, {"host_name": "x"}), "within_av_quarantine_pattern": ({"process_name": "bdagent.exe"}, {"target_file": "quarantine"}), "matched_known_software_uninstall": ({"process_name": "uninstall.exe"}, {"command_line": "uninstall"})},
    "LogClearing": {"within_log_rotation_pattern": ({"timestamp": "2024-05-01 03:09:59"}, {"timestamp": "2024-05-01 03:10:00"}), "performed_by_documented_admin": ({"user": "listed"}, {"user": "x"})},
    "Timestomp": {"matched_known_installer_behavior": ({"process_name": "update.exe"}, {"process_name": "up.exe"}), "within_file_restore_window": ({"target_file": "listed"}, {"target_file": "x"})},
    "ShadowDeletion": {"matched_documented_disk_cleanup": ({"process_name": "diskcleanup.exe"}, {"process_name": "clean.exe"}), "within_backup_software_window": ({"timestamp": "2024-05-01 04:59:59"}, {"timestamp": "2024-05-01 05:00:00"})},
    "MemoryAnomaly": {"dll_in_system_path": ({"process_path": r"C:\Windows\WinSxS\x\a.dll"}, {"process_path": r"C:\x\a.dll"}), "signed_microsoft_dll": ({"volatility": {"BaseName": "NTDLL.dll"}}, {"volatility": {"BaseName": "x.dll"}})},
    "SuspiciousLineage": {"known_admin_invocation": ({"user": r"NT AUTHORITY\SYSTEM"}, {"user": "admin"}), "office_addin_path": ({"process_path": r"C:\Users\a\AppData\Roaming\Microsoft\AddIns\x.exe"}, {"process_path": r"C:\Temp\addins\x.exe"})},
    "CredentialAccess": {"accessing_process_is_defender": ({"process_name": "msmpeng.exe"}, {"process_name": "x"}), "accessing_process_is_sysmon": ({"process_name": "sysmon64.exe"}, {"process_name": "x"}), "matched_known_av_or_edr_signature": ({"process_name": "listed"}, {"process_name": "x"}), "audit_legitimate_use_window": ({"user": "listed"}, {"user": "x"})},
}
#: An event that meets a trigger of the family and neither a signal of the first event nor a counter.
FIRST = {"Beaconing": N(), "Exfiltration": N(), "MemoryAnomaly": A("shellcode"), "SuspiciousLineage": P(process_path="/temp/x.exe", process_name="x.exe"), "CredentialAccess": A("dcsync")}
FIRST |= {f: t for f, t in (("LateralMovement", U("3")), ("Persistence", A("run key")), ("RemoteExecution", A("winrm")), ("DefenseEvasion", A("ta0005")), ("Collection", A("pst")), ("Impact", A("brute force")), ("LogClearing", A("1102")), ("Timestomp", A("timestomp")), ("ShadowDeletion", A("524 shadow")))}
SHARED = {"high_frequency_baseline", "known_good_hash", "system_legitimate_path"}


def events(spark, rows):
    base = {"case_id": "c", "host_name": "h", "user": "", "timestamp": "2024-05-01 10:00:07"}
    return spark.createDataFrame([tuple((base | r).get(n) for n in NAMES) for r in rows], COLUMNS).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def test_every_rule_has_a_case():
    for f in FAMILIES:
        assert set(TRIGGERS[f.name]) == {t.name for t in f.triggers}
        done = set(SIGNALS[f.name]) | {"target_not_previously_accessed"} | ({"occurred_outside_business_hours"} if f.name == "Exfiltration" else set())
        assert {s.name for s in f.signals} - done == set()
        assert {c.name for c in f.counters} - set(COUNTERS[f.name]) <= SHARED


def test_triggers(spark):
    rows = [e | {"event_id": f"{f}/{t}/{sign}"} for f, ts in TRIGGERS.items() for t, pair in ts.items() for sign, e in zip("+-", pair)]
    hits = {(r["event_id"], r["constructor"], r["trigger"]): r["base"] for r in trigger_hits(saved(prepared(events(spark, rows)))).select("event_id", "constructor", "trigger", "base").collect()}
    for f in FAMILIES:
        for t in f.triggers:
            assert hits.get((f"{f.name}/{t.name}/+", f.name, t.name)) == t.base, (f.name, t.name)
            assert (f"{f.name}/{t.name}/-", f.name, t.name) not in hits, (f.name, t.name)


def case(f, name, sign, fields, near):
    """The first event of a case on a host of its own, and an event near it."""
    host = f"{f}.{name}.{sign}"
    if near:
        return host, [FIRST[f] | {"event_id": f"{host}.1", "host_name": host}, fields | {"event_id": f"{host}.2", "host_name": host, "timestamp": "2024-05-01 10:00:07" if BY_NAME[f].window == 0 else "2024-05-01 10:20:00"}]
    host = fields.get("host_name", host)
    return host, [FIRST[f] | {"host_name": host} | fields | {"event_id": f"{f}.{name}.{sign}"}]


def test_signals_and_counters(spark):
    cases = [(f, name, sign, *case(f, name, sign, fields, "canonical_type" in fields)) for f, s in SIGNALS.items() for name, pair in s.items() for sign, fields in zip("+-", pair)]
    cases += [(f, name, sign, *case(f, name, sign, fields, False)) for f, s in COUNTERS.items() for name, pair in s.items() for sign, fields in zip("+-", pair)]
    # cases that share a host name must not see each other
    rows, key = [], {}
    for k, (f, name, sign, host, own) in enumerate(cases):
        day = f"2024-{1 + k % 12:02d}-{1 + k // 12:02d}"
        key[f, name, sign] = (f, host, day)
        rows += [e | {"event_id": f"{e['event_id']}.{k}", "timestamp": day + e.get("timestamp", "2024-05-01 10:00:07")[10:]} for e in own]
    value = lambda c: r"c:/good/a.exe" if c == "ppath" else "203.0.113.77" if c == "ip" else "LISTED"
    lists = {c.name: spark.createDataFrame([(value(c.when),)], "value string") for f in FAMILIES for c in f.counters if c.on == "list"}
    out = {(r["constructor"], r["host_name"], str(r["time_start"])[:10]): r for r in build_clusters(events(spark, rows), lists=lists).collect()}
    weights = {(f.name, s.name): s.weight for f in FAMILIES for s in f.signals}
    for (f, name, sign), at in key.items():
        r = out[at]
        if name in SIGNALS[f]:
            assert (name in r["supporting"]) == (sign == "+"), (f, name, sign, r)
        else:
            assert {c["signal"]: c["applies"] for c in r["counter_evidence"]}[name] == (sign == "+"), (f, name, sign, r)
        assert r["support"] == sum(weights[f, s] for s in r["supporting"]) and r["counter"] == sum(c["weight"] for c in r["counter_evidence"] if c["applies"])
        assert r["score"] == max(0, min(100, r["base_score"] + r["support"] - r["counter"]))


def test_shared_counters_and_first_access(spark):
    hash_ = "d41d8cd98f00b204e9800998ecf8427e"
    rows = [P("psexec", process_name="svchost.exe", process_path=r"C:\Windows\System32\svchost.exe", md5=hash_, host_name="a", event_id="a1")]
    rows += [P("psexec", process_name="svchost.exe", process_path=r"C:\Windows\System32\sub\svchost.exe", md5="0" * 32, host_name="b", event_id="b1")]
    rows += [P(process_name="busy.exe", host_name="n", event_id=f"n{k}") for k in range(101)] + [P("psexec", process_name="busy.exe", host_name="n", event_id="nx", timestamp="2024-06-01 10:00:00")]
    rows += [U("3") | {"host_name": "old", "user": "bob", "event_id": "o1", "timestamp": "2024-04-01 10:00:00"}, U("3") | {"host_name": "old", "user": "bob", "event_id": "o2"}]
    out = build_clusters(events(spark, rows), (BY_NAME["LateralMovement"],), hash_list=spark.createDataFrame([(hash_.upper(),)], "md5 string")).collect()
    met = {(r["host_name"], str(r["time_start"])[:10]): {c["signal"] for c in r["counter_evidence"] if c["applies"]} for r in out}
    assert met["a", "2024-05-01"] == {"known_good_hash", "system_legitimate_path"} and met["b", "2024-05-01"] == set() and met["n", "2024-06-01"] == {"high_frequency_baseline"}
    new = {str(r["time_start"])[:10]: "target_not_previously_accessed" in r["supporting"] for r in out if r["host_name"] == "old"}
    assert new == {"2024-04-01": True, "2024-05-01": False}


def test_rules_are_compiled(spark):
    """Rules run in code that Spark compiles, in pieces of bounded size, and a number has the bits of the rules that hold, also of a group that takes several columns."""
    rows = saved(prepared(driver.events(spark, "/root/testdata/sf0.001")))
    groups = [[f"contains(cmd, '{'x' * 500}')", "kind = 'ALERT'", f"contains(proc, '{'y' * 900}')", "epoch % 2 = 0", "proc = 'cmd.exe'"], [], ["port > 1000"]]
    out, numbers = with_bits(rows, "met", groups)
    assert len([c for c in out.columns if c.startswith("met_")]) > len(groups)
    for rules, number in zip(groups, numbers):
        want = sum((F.when(F.expr(r), 1 << k).otherwise(0) for k, r in enumerate(rules)), F.lit(0))
        assert out.where(number != want).isEmpty()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = trigger_hits(rows)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    with_rules = [line for line in plan if "Generate" in line and ("RLIKE(" in line or "Contains(" in line)]
    assert len(with_rules) > 5 and all("*(" in line for line in with_rules)
