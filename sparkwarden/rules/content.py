"""The built-in rule pack."""

from __future__ import annotations

# Ids, severities, technique ids and conditions that results must agree on.
PRIVATE_PREFIXES = ["10.", "192.168.", *[f"172.{n}." for n in range(16, 32)], "127.", "169.254.", "fe80:", "fc", "fd", "::1"]
POWERSHELL = ["powershell.exe", "pwsh.exe"]
SCRIPT_HOSTS = ["wscript.exe", "cscript.exe"]
SCRIPT_SCHEMES = ["javascript:", "vbscript:"]
WRITABLE = ["\\appdata\\", "\\temp\\", "\\users\\public\\"]


def leaf(field: str, op: str, value=None) -> dict:
    return {"field": field, "op": op} | ({} if op == "exists" else {"value": value})


def every(*nodes: dict) -> dict:
    return {"all": list(nodes)}


def either(*nodes: dict) -> dict:
    return {"any": list(nodes)}


def outside(field: str) -> dict:
    return {"not": leaf(field, "istartswith", PRIVATE_PREFIXES)}


def command(text) -> dict:
    return leaf("process.cmd_line", "icontains", text)


def program(name) -> dict:
    return leaf("process.name", "iin", name) if isinstance(name, list) else leaf("process.name", "iequals", name)


OUTBOUND, TCP = leaf("direction", "equals", "outbound"), leaf("protocol", "equals", "tcp")
FAILED = leaf("activity", "equals", "logon_failed")
LOGGED_ON = [leaf("activity", "equals", "logon"), leaf("status", "equals", "success")]
BY_USER, BY_PEER, BY_HOST = ["host.hostname", "user.name"], ["host.hostname", "dst.ip"], ["host.hostname"]

#: (id, severity, class, entity, techniques, title, condition)
_RULES = [
    ("auth-account-lockout", "medium", "authentication", BY_USER, ["T1110.001"], "Account locked out", every(FAILED, leaf("failure_reason", "equals", "account_locked"))),
    ("auth-builtin-admin-network-logon", "medium", "authentication", BY_USER, ["T1078.003", "T1021.002"], "Built-in administrator logged on over the network", every(*LOGGED_ON, leaf("user.name", "iequals", "administrator"), leaf("logon_type", "in", ["network", "remote_interactive"]))),
    ("auth-external-remote-logon", "high", "authentication", BY_USER, ["T1133", "T1078"], "Remote logon from a public address", every(*LOGGED_ON, leaf("logon_type", "equals", "remote_interactive"), leaf("src_ip", "exists"), outside("src_ip"))),
    ("auth-failed-admin-logon-external", "high", "authentication", BY_USER, ["T1110.001", "T1078.003"], "Failed administrative logon from a public address", every(FAILED, leaf("user.name", "iin", ["administrator", "admin", "root", "sysadmin"]), leaf("src_ip", "exists"), outside("src_ip"))),
    ("auth-failed-logon-disabled-account", "medium", "authentication", BY_USER, ["T1078"], "Logon tried with a disabled account", every(FAILED, leaf("failure_reason", "equals", "account_disabled"))),
    ("gen-hacktool-indicator-in-logs", "high", "generic", BY_HOST, ["T1003.001", "T1071.001"], "Attack tool named in a log", leaf("message", "icontains", ["mimikatz", "meterpreter", "cobalt strike", "cobaltstrike", "bloodhound", "sharphound", "lazagne", "impacket", "brute ratel"])),
    ("gen-ssh-auth-failure", "low", "generic", BY_HOST, ["T1110.001"], "SSH authentication failed", leaf("message", "icontains", ["failed password for", "invalid user", "authentication failure"])),
    ("net-direct-outbound-smtp", "medium", "network_activity", BY_PEER, ["T1071.003"], "Mail sent straight to the internet", every(OUTBOUND, TCP, leaf("dst.port", "equals", 25), outside("dst.ip"))),
    ("net-large-outbound-transfer", "medium", "network_activity", BY_PEER, ["T1048", "T1030"], "Large transfer to the internet", every(leaf("activity", "equals", "connection_closed"), OUTBOUND, leaf("bytes_sent", "gte", 100 * 1024 * 1024), outside("dst.ip"))),
    ("net-lolbin-outbound-connection", "high", "network_activity", BY_PEER, ["T1105", "T1218"], "System tool connects to the internet", every(OUTBOUND, program(["certutil.exe", "mshta.exe", "regsvr32.exe", "rundll32.exe", "bitsadmin.exe", *SCRIPT_HOSTS]), outside("dst.ip"))),
    ("net-outbound-known-c2-port", "medium", "network_activity", BY_PEER, ["T1571"], "Connection to a port of known control servers", every(OUTBOUND, TCP, leaf("dst.port", "in", [1337, 4444, 5555, 6666, 6667, 6697, 31337]), outside("dst.ip"))),
    ("net-rdp-inbound-from-external", "high", "network_activity", ["host.hostname", "src.ip"], ["T1133", "T1021.001"], "Remote desktop opened from a public address", every(leaf("direction", "equals", "inbound"), TCP, leaf("dst.port", "equals", 3389), outside("src.ip"))),
    ("net-smb-to-external", "high", "network_activity", BY_PEER, ["T1187", "T1021.002"], "File sharing with a public address", every(OUTBOUND, TCP, leaf("dst.port", "in", [139, 445]), outside("dst.ip"), {"not": leaf("dst.hostname", "iendswith", ".file.core.windows.net")})),
    ("proc-certutil-download-or-decode", "high", "process_activity", BY_USER, ["T1105", "T1140"], "Certificate tool downloads or decodes", every(program("certutil.exe"), either(every(command(["urlcache", "verifyctl"]), command("http")), command("-decode")))),
    ("proc-lsass-memory-dump", "critical", "process_activity", BY_USER, ["T1003.001"], "Credential process memory dumped", either(every(program(["procdump.exe", "procdump64.exe"]), command("lsass")), every(command("comsvcs"), command("minidump")), every(program("createdump.exe"), command("lsass")))),
    ("proc-mshta-remote-or-inline-script", "high", "process_activity", BY_USER, ["T1218.005"], "HTML application host runs remote or inline script", every(program("mshta.exe"), command(["http://", "https://", *SCRIPT_SCHEMES]))),
    ("proc-office-app-spawns-shell", "high", "process_activity", BY_USER, ["T1566.001", "T1204.002"], "Office program starts a shell", every(leaf("parent.name", "iin", ["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "msaccess.exe", "mspub.exe", "onenote.exe", "visio.exe"]), program(["cmd.exe", *POWERSHELL, *SCRIPT_HOSTS, "mshta.exe", "rundll32.exe", "regsvr32.exe", "bitsadmin.exe", "certutil.exe"]))),
    ("proc-powershell-download-cradle", "high", "process_activity", BY_USER, ["T1059.001", "T1105"], "PowerShell downloads", every(program(POWERSHELL), command(["downloadstring", "downloadfile", "invoke-webrequest", "invoke-restmethod", "iwr ", "net.webclient", "start-bitstransfer", "curl ", "wget "]), command("http"))),
    ("proc-powershell-encoded-command", "high", "process_activity", BY_USER, ["T1059.001", "T1027.010"], "PowerShell runs an encoded command", every(program(POWERSHELL), command([" -e ", " -ec ", " -enc"]))),
    ("proc-rundll32-suspicious-execution", "medium", "process_activity", BY_USER, ["T1218.011"], "DLL host runs from a writable folder or a script", every(program("rundll32.exe"), either(command([*WRITABLE, "\\programdata\\"]), command(SCRIPT_SCHEMES)))),
    ("proc-schtasks-suspicious-task", "medium", "process_activity", BY_USER, ["T1053.005"], "Scheduled task runs a script or from a writable folder", every(program("schtasks.exe"), command("/create"), command(["powershell", "cmd /c", "cmd.exe /c", "wscript", "cscript", "mshta", "rundll32", "regsvr32", "certutil", "bitsadmin", *WRITABLE, "http"]))),
    ("proc-script-host-user-writable-path", "medium", "process_activity", BY_USER, ["T1059.005", "T1059.007"], "Script host runs from a writable folder", every(program(SCRIPT_HOSTS), command([*WRITABLE, "\\downloads\\"]))),
    ("proc-shadow-copy-deletion", "critical", "process_activity", BY_USER, ["T1490"], "Backups or shadow copies deleted", either(
        every(program("vssadmin.exe"), command("delete"), command("shadow")), every(program("wmic.exe"), command("shadowcopy"), command("delete")),
        every(program("bcdedit.exe"), command("recoveryenabled"), command([" no", " off"])), every(program("wbadmin.exe"), command("delete"), command(["catalog", "backup"])))),
    ("proc-wmic-process-create", "medium", "process_activity", BY_USER, ["T1047"], "Process started through WMI", every(program("wmic.exe"), command("process"), command("create"))),
]

RULES = [
    {"id": i, "version": "1.0.0", "title": t, "description": t, "severity": s, "event_class": c, "min_schema_version": "1.0.0", "mitre_technique_ids": m, "entity": e, "detection": {"condition": n}, "false_positives": [], "references": []}
    for i, s, c, e, m, t, n in _RULES
]
