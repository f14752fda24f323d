"""Raw records to event leaves: one expression set per source type.

A source gives native column expressions over ``raw`` (text), ``j`` (the JSON of the source's schema)
and ``meta``. ``_ok`` says whether the record is one of its kind; everything else goes to dead letter.
``_let`` lists steps (name, expression) that are computed once, in order, before the leaves: what several leaves name would
otherwise be copied into each of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from secflow.functions import scalars as S
from secflow.functions.predicates import closed, is_ipv4

INFO, LOW, MEDIUM, HIGH, CRITICAL, FATAL = 1, 2, 3, 4, 5, 6
READ, WRITE, MODIFY, DESTROY, PRIVILEGE = INFO, INFO, MEDIUM, CRITICAL, CRITICAL


@dataclass(frozen=True)
class Source:
    name: str
    sector: str
    fmt: str
    product: tuple[str, str]
    build: Callable[[], dict[str, Column]]
    schema: str | None = None


def _grp(text: Column, regex: str, i: int = 1) -> Column:
    """Regex group, null when it did not match."""
    return F.nullif(F.regexp_extract(text, regex, i), F.lit(""))


def _pick(*cols: str) -> Column:
    return F.coalesce(*[S.non_empty(F.col(c)) for c in cols])


def _case(value: Column, table: dict, default=None) -> Column:
    out = reduce(lambda acc, kv: acc.when(value == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(None)))
    return out.otherwise(F.lit(default))


def _first_word(value: Column, ordered: list[tuple[str, int]], default: int, test: str = "contains") -> Column:
    """Value of the first listed word the text contains (or starts with)."""
    out = F.when(F.lit(False), F.lit(None))
    for word, result in ordered:
        hit = F.contains(value, F.lit(word)) if test == "contains" else F.startswith(value, F.lit(word))
        out = out.when(hit, F.lit(result))
    return out.otherwise(F.lit(default))


def _named(value: Column) -> Column:
    """Host or account text, with the operating system's ``-`` read as absent."""
    return F.when(~F.trim(value).isin("", "-"), value)


def _any(text: Column, regexes: tuple[str, ...]) -> Column:
    return reduce(or_, [closed(text.rlike(r)) for r in regexes])


def _result(*cols: str) -> Column:
    return S.outcome(F.coalesce(*[F.col(c) for c in cols]))


def meta_ip() -> Column:
    return S.valid_ip(F.col("meta.ip"))


# ---- text sources ------------------------------------------------------------------------------

ASA_SEVERITY = {0: CRITICAL, 1: CRITICAL, 2: CRITICAL, 3: HIGH, 4: MEDIUM, 5: LOW, 6: INFO, 7: INFO}
SYSLOG_SEVERITY = {0: FATAL, 1: CRITICAL, 2: CRITICAL, 3: HIGH, 4: MEDIUM, 5: LOW, 6: INFO, 7: INFO}
IP_PORT = r"(?:\S*?:)?(\d{1,3}(?:\.\d{1,3}){3})/(\d+)"


def cisco_asa() -> dict[str, Column]:
    tag = r"%ASA-(\d)-\d+:\s*(.*)$"
    let = [("text", F.regexp_extract("raw", tag, 2)), ("low", F.lower("text"))]
    text, low = F.col("text"), F.col("low")
    deny = F.startswith(low, F.lit("deny")) | F.contains(low, F.lit(" deny ")) | F.contains(low, F.lit("denied"))
    ends = {}
    for side, words in (("src_endpoint", "src|from|for"), ("dst_endpoint", "dst|to")):
        regex = rf"\b(?:{words})\s+{IP_PORT}"
        let.append((f"ip_{side}", _grp(text, regex, 1)))
        ip = F.col(f"ip_{side}")
        ends[f"{side}.ip"] = F.when(is_ipv4(ip), ip)
        ends[f"{side}.port"] = F.when(is_ipv4(ip), S.valid_port(_grp(text, regex, 2)))
    ends["src_endpoint.ip"] = F.coalesce(ends["src_endpoint.ip"], meta_ip())
    return {
        "_let": let, "_ok": F.col("raw").rlike(tag), "class_uid": F.lit(4001), "activity_id": F.when(deny, 6).otherwise(7),
        "status": F.when(deny, "Failure").otherwise("Success"), "message": F.trim(text),
        "severity_id": _case(_grp(F.col("raw"), tag, 1).cast("int"), ASA_SEVERITY, INFO), **ends,
    }


SSH_IP = r"([0-9A-Fa-f:.]+)"


def linux_ssh() -> dict[str, Column]:
    tagged = F.regexp_extract("raw", r"(?:sshd(?:-session)?\[\d+\]:\s*|(?=pam_\w{1,40}\(sshd:))(.*)$", 1)
    let = [("body", F.regexp_replace(F.ltrim(tagged), r"\A\[ID \d+ \w+\.\w+\]\s*", ""))]
    body, rest, login = F.col("body"), F.col("rest"), F.col("login")
    after = F.coalesce(_grp(body, r"\AAccepted\s+\S+\s+for\s+(.*)$"), _grp(body, r"\AFailed\s+\S+\s+for\s+(?:invalid user\s+)?(.*)$"),
                      _grp(body, r"\AInvalid user\s+(.*)$"))
    # The server writes the source after the account, so the last address-shaped clause counts.
    clause = rf"\A(.*)\sfrom\s+(?=\S*(?:\d\.|\.\d|:[^:\s]*:)){SSH_IP}(?:%\S*)?(?:\s+port\s+(\d+))?"
    let += [("rest", after), ("login", F.nullif(F.trim(F.regexp_extract(rest, clause, 1)), F.lit("")))]
    pam = closed(body.rlike(r"\A(?:pam_\w{1,40}\(sshd:auth\):\s+authentication failure|PAM\s+\d+\s+more authentication failures?)"))
    closed_for = _grp(body, r"\Apam_\w{1,40}\(sshd:session\):\s+session\s+closed\s+for user\s+(.*)$")
    closed_for = F.regexp_replace(F.regexp_replace(F.trim(closed_for), r"\s+by \S*\(uid=\d*\)\z", ""), r"\(uid=\d+\)\z", "")
    let += [("pam", pam), ("closed_for", closed_for)]
    pam, closed_for = F.col("pam"), F.col("closed_for")
    accepted = login.isNotNull() & F.startswith(body, F.lit("Accepted"))
    activity = F.when(accepted, 1).when(login.isNotNull() | pam, 4).when(F.length(closed_for) > 0, 2)
    let.append(("activity", activity))
    activity = F.col("activity")
    user = F.when(login.isNotNull(), login).when(pam, F.trim(_grp(body, r"(?<!\S)user=(.*)$"))).otherwise(closed_for)
    ip = F.when(login.isNotNull(), F.regexp_extract(rest, clause, 2)).when(
        pam, _grp(F.regexp_replace(body, r"(?<!\S)user=.*$", ""), rf"(?<!\S)rhost={SSH_IP}"))
    let += [("user", user), ("ip", ip)]
    user, ip = F.col("user"), F.col("ip")
    return {
        "_let": let, "_ok": activity.isNotNull(), "class_uid": F.lit(3002), "activity_id": activity,
        "status": F.when(activity == 4, "Failure").otherwise("Success"),
        "severity_id": F.when(activity == 4, HIGH).otherwise(INFO), "actor.user.name": S.non_empty(user),
        "src_endpoint.ip": F.coalesce(S.valid_ip(ip), meta_ip()),
        "src_endpoint.port": F.when(login.isNotNull(), S.valid_port(_grp(rest, clause, 3))),
        "message": F.concat(F.lit("SSH "), _case(activity, {1: "logon", 2: "logoff", 4: "failed logon"}),
                            F.lit(" for user "), F.coalesce(S.non_empty(user), F.lit("?"))),
    }


SYSLOG_HEADER = (r"\A\s*(?:<(\d{1,3})>)?(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2})\s+"
                 r"(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\s:\[]+)(?:\[(\d+)\])?:\s*(?s:(.*))\z")


def generic_syslog() -> dict[str, Column]:
    """RFC 3164. The year comes from the receipt time, so a replay gives the same event."""
    part = lambda i: _grp(F.col("raw"), SYSLOG_HEADER, i)
    year = F.date_format(F.timestamp_millis(S.magnitude_ms(F.col("meta.received_at"))), "yyyy")
    when = F.try_to_timestamp(F.concat_ws(" ", year, part(2), F.lpad(part(3), 2, "0"), part(4)), F.lit("yyyy MMM dd HH:mm:ss"))
    return {
        "_ok": F.col("raw").rlike(SYSLOG_HEADER), "class_uid": F.lit(1002), "activity_id": F.lit(1),
        "severity_id": F.coalesce(_case(part(1).cast("int").bitwiseAND(7), SYSLOG_SEVERITY), F.lit(INFO)),
        "time": F.unix_millis(when), "message": F.coalesce(part(8), F.col("raw")),
        "src_endpoint.hostname": part(5), "actor.process.name": part(6), "actor.process.pid": part(7).cast("bigint"),
        "_id": content_id(F.col("raw")),
    }


def content_id(text: Column) -> Column:
    """UUID-shaped sha256 of a line: the same line gives the same id."""
    h = F.sha2(text, 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


DENY_WORDS = ("blocked", "denied", "deny", "drop", "dropped", "reject", "rejected")


def cef() -> dict[str, Column]:
    line = F.regexp_replace(F.trim("raw"), r"\A(?:<\d{1,3}>)?[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+(?=CEF:)", "")
    let = [("line", line), ("parts", F.split(F.col("line"), r"\|", 8))]
    line, parts, ext = F.col("line"), F.col("parts"), F.col("ext")
    let.append(("ext", F.split(F.coalesce(F.get(parts, F.lit(7)), F.lit("")), r"\s+")))
    # The last of repeated keys wins.
    field = lambda k: F.substr(F.try_element_at(F.filter(ext, lambda t: F.startswith(t, F.lit(f"{k}="))), F.lit(-1)), F.lit(len(k) + 2))
    let += [(k, field(k)) for k in ("suser", "duser", "outcome", "act", "src", "dst", "spt", "dpt")]
    field = F.col
    user = F.coalesce(S.non_empty(field("suser")), S.non_empty(field("duser")))
    result = S.outcome(F.coalesce(field("outcome"), field("act")))
    deny = closed(F.lower(F.trim(field("act"))).isin(*DENY_WORDS))
    src, dst = S.valid_ip(field("src")), S.valid_ip(field("dst"))
    let += [("user", user), ("result", result), ("deny", deny), ("src_ip", src), ("dst_ip", dst)]
    user, result, deny, src, dst = (F.col(c) for c in ("user", "result", "deny", "src_ip", "dst_ip"))
    ok_login = result == "Success"
    return {
        "_let": let, "_ok": F.startswith(line, F.lit("CEF:")) & (F.size(parts) >= 7),
        "class_uid": F.when(user.isNotNull(), 3002).otherwise(4001),
        "activity_id": F.when(user.isNotNull(), F.when(ok_login, 1).otherwise(4)).when(deny, 6).otherwise(7),
        "severity_id": F.when((user.isNotNull() & ~ok_login) | (user.isNull() & deny), HIGH).otherwise(INFO),
        "status": F.when(user.isNotNull(), result), "actor.user.name": user,
        "message": F.concat(F.get(parts, F.lit(1)), F.lit("/"), F.get(parts, F.lit(2)), F.lit(" "), F.get(parts, F.lit(5))),
        "src_endpoint.ip": src, "src_endpoint.port": F.when(src.isNotNull(), S.valid_port(field("spt"))),
        "dst_endpoint.ip": dst, "dst_endpoint.port": F.when(dst.isNotNull(), S.valid_port(field("dpt"))),
    }


def dns_query() -> dict[str, Column]:
    regex = r"query\[([A-Za-z]+)\]\s+(\S+)\s+from\s+([0-9A-Fa-f:.]+)"
    let = [("name", F.regexp_replace(_grp(F.col("raw"), regex, 2), r"\.+\z", "")), ("client", _grp(F.col("raw"), regex, 3))]
    name = F.col("name")
    return {
        "_let": let, "_ok": F.length(name) > 0, "class_uid": F.lit(4002), "activity_id": F.lit(1), "severity_id": F.lit(INFO),
        "message": F.concat_ws(" ", F.lit("DNS query"), _grp(F.col("raw"), regex, 1), name),
        "src_endpoint.ip": F.coalesce(S.valid_ip(F.col("client")), meta_ip()),
        "dst_endpoint.hostname": name, "unmapped.dns.parent_domain": S.parent_domain(name),
        "unmapped.dns.qtype": _grp(F.col("raw"), regex, 1),
    }


# ---- Windows -----------------------------------------------------------------------------------

WIN_FIELDS = ("EventID TimeCreated TargetUserName TargetDomainName TargetUserSid TargetLogonId SubjectUserName "
              "SubjectDomainName SubjectUserSid SubjectLogonId IpAddress WorkstationName Computer MacAddress Status "
              "SubStatus FailureReason TargetServerName Channel ProviderName ServiceName ImagePath ServiceFileName "
              "NewProcessName NewProcessId ParentProcessName CommandLine ScriptBlockText Payload ContextInfo "
              "HostApplication Data AttributeLDAPDisplayName AttributeValue ObjectDN ObjectClass OperationType "
              "Image ProcessId ProcessGuid ParentImage ParentProcessId ParentProcessGuid User SourceIp SourcePort "
              "SourceHostname DestinationIp DestinationPort DestinationHostname TargetFilename SourceImage TargetImage "
              "GrantedAccess SourceProcessGuid").split()
WIN_SCHEMA = "struct<" + ",".join(f"{f}:string" for f in WIN_FIELDS) + ">"

# Directory event ids to activity.
AD_ACTIVITY = {4624: 1, 4634: 2, 4647: 2, 4625: 4, 4768: 3, 4771: 4}


def active_directory() -> dict[str, Column]:
    activity = _case(F.col("j.EventID").try_cast("int"), AD_ACTIVITY)
    failed = activity == 4
    target, subject = _named(F.col("j.TargetUserName")), _named(F.col("j.SubjectUserName"))
    user = F.coalesce(target, F.when(~failed, subject))
    domain = F.coalesce(_named(F.col("j.TargetDomainName")), F.when(~failed & target.isNull(), _named(F.col("j.SubjectDomainName"))))
    host = _named(F.col("j.Computer"))
    sid = F.col("j.TargetUserSid")
    return {
        "_ok": activity.isNotNull() & F.coalesce("j.TargetUserName", "j.SubjectUserName", "j.IpAddress", "j.WorkstationName").isNotNull(),
        "class_uid": F.lit(3002), "activity_id": activity, "status": F.when(failed, "Failure").otherwise("Success"),
        "severity_id": F.when(failed, HIGH).otherwise(INFO), "time": S.coerce_ms(F.col("j.TimeCreated")),
        "message": F.concat(_case(activity, {1: "Logon", 2: "Logoff", 3: "Auth ticket", 4: "Failed logon"}),
                            F.lit(" for user "), F.coalesce(user, F.lit("?"))),
        "actor.user.name": user, "actor.user.domain": F.when(user.isNotNull(), domain),
        "actor.user.uid": F.when(user.isNotNull() & ~F.trim(sid).isin("", "-", "S-1-0-0"), sid),
        "actor.session.uid": F.when((F.col("j.EventID") == "4624") & host.isNotNull(), S.canon_logon_id(F.col("j.TargetLogonId"))),
        "siem.key_scope.host": F.when(F.col("j.EventID") == "4624", host),
        "src_endpoint.ip": F.coalesce(S.valid_ip(F.col("j.IpAddress")), meta_ip()),
        "src_endpoint.hostname": F.coalesce(_named(F.col("j.WorkstationName")), host),
        "src_endpoint.mac": S.valid_mac(F.col("j.MacAddress")), "dst_endpoint.hostname": host,
        "unmapped.logon_status.status": F.col("j.Status"), "unmapped.logon_status.sub_status": F.col("j.SubStatus"),
        "unmapped.logon_status.failure_reason": F.col("j.FailureReason"),
    }


# Event id -> (class, activity, status, severity, verb).
WIN_EVENTS = {
    4624: (3002, 1, "Success", INFO, "Logon"), 4634: (3002, 2, "Success", INFO, "Logoff"),
    4647: (3002, 2, "Success", INFO, "Logoff"), 4648: (3002, 1, "Success", INFO, "Logon with explicit credentials"),
    4688: (1002, 1, None, INFO, "Process created"), 4672: (1002, 2, "Success", MEDIUM, "Special privileges assigned"),
    4697: (1002, 3, "Success", MEDIUM, "Service installed"), 7045: (1002, 3, "Success", MEDIUM, "Service installed"),
    1102: (1002, 4, "Success", HIGH, "Audit log cleared"), 104: (1002, 4, "Success", HIGH, "Audit log cleared"),
    5136: (3003, 6, "Success", MEDIUM, "Directory object modified"),
    4104: (1002, 6, "Success", INFO, "PowerShell script block"), 4103: (1002, 6, "Success", INFO, "PowerShell module logging"),
    800: (1002, 6, "Success", INFO, "PowerShell pipeline execution"),
    4720: (3003, 1, "Success", MEDIUM, "Account created"), 4722: (3003, 2, "Success", INFO, "Account enabled"),
    4726: (3003, 4, "Success", MEDIUM, "Account deleted"),
    4728: (3003, 5, "Success", HIGH, "Member added to global security group"),
    4732: (3003, 5, "Success", HIGH, "Member added to local security group"),
}
# Ids that count only from their own channel and provider.
WIN_SCOPE = {
    104: ("system", ("microsoft-windows-eventlog", "eventlog")),
    1102: ("security", ("microsoft-windows-eventlog", "eventlog")),
    7045: ("system", ("service control manager",)), 800: ("windows powershell", ("powershell",)),
    4103: ("microsoft-windows-powershell/operational", ("microsoft-windows-powershell",)),
    4104: ("microsoft-windows-powershell/operational", ("microsoft-windows-powershell",)),
}
# Path parts of a suspicious service binary.
SERVICE_PATHS = ("\\temp\\", "\\appdata\\", "\\users\\public\\", "\\programdata\\", "\\windows\\tasks\\", "%comspec%",
                 "cmd.exe /c", "cmd /c", "powershell", "pwsh", "rundll32", "mshta", "wscript", "cscript", "regsvr32",
                 "\\\\", "%temp%", "%tmp%", "%appdata%", "%localappdata%", "%public%", "%programdata%", "%userprofile%")
# Script indicators; one strong or two weak make a script suspicious.
SCRIPT_STRONG = (r"downloadstring", r"downloadfile", r"frombase64string", r"net\.webclient", r"amsiinitfailed", r"amsiutils",
                 r"invoke-mimikatz", r"invoke-shellcode", r"invoke-reflectivepeinjection", r"reflection\.assembly\]::load",
                 r"virtualalloc", r"(?:^|\s)[-/–—](?:e|ec|en[a-z]*)\s+[a-z0-9+/=]{30,}")
SCRIPT_WEAK = (r"\biex\b", r"invoke-expression", r"-exec(utionpolicy)?\s+bypass", r"-nop(rofile)?\b",
               r"-w(indowstyle)?\s+hidden", r"invoke-webrequest|\biwr\b", r"start-process", r"new-object\s+net\.")
SENSITIVE_ATTRIBUTES = ("serviceprincipalname", "msds-allowedtodelegateto", "msds-allowedtoactonbehalfofotheridentity",
                        "msds-keycredentiallink", "gplink", "gpcfilesyspath", "scriptpath", "useraccountcontrol", "sidhistory")
# Document hosts and the shells or script hosts they should not start.
DOCUMENT_HOSTS = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "msaccess.exe", "mspub.exe", "onenote.exe",
                  "acrord32.exe", "acrobat.exe", "foxitreader.exe")
SHELL_HOSTS = ("cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe",
               "regsvr32.exe", "certutil.exe", "bitsadmin.exe", "msiexec.exe")


def base_name(path: Column) -> Column:
    return F.lower(F.substring_index(F.replace(path, F.lit("/"), F.lit("\\")), "\\", -1))


def suspicious_launch(parent: Column, child: Column) -> Column:
    return closed(base_name(parent).isin(*DOCUMENT_HOSTS) & base_name(child).isin(*SHELL_HOSTS))


def suspicious_service(path: Column) -> Column:
    low = F.replace(F.lower(path), F.lit("/"), F.lit("\\"))
    return reduce(or_, [closed(F.contains(low, F.lit(p))) for p in SERVICE_PATHS])


def script_hits(text: Column, regexes: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.when(low.rlike(r), F.lit(r)) for r in regexes]), lambda x: x.isNotNull())


def suspicious_script(text: Column) -> Column:
    return closed((F.size(script_hits(text, SCRIPT_STRONG)) > 0) | (F.size(script_hits(text, SCRIPT_WEAK)) >= 2))


def pid_number(text: Column) -> Column:
    s = F.lower(F.trim(text))
    return F.when(s.rlike(r"\A0x[0-9a-f]+\z"), F.conv(F.substr(s, F.lit(3)), 16, 10).cast("bigint")).otherwise(s.try_cast("bigint"))


def windows_eventlog() -> dict[str, Column]:
    eid = F.col("j.EventID").try_cast("int")
    at = lambda i: _case(eid, {k: v[i] for k, v in WIN_EVENTS.items()})
    channel, provider = F.lower(F.trim("j.Channel")), F.lower(F.trim("j.ProviderName"))
    outside = reduce(or_, [closed((eid == k) & ((channel != ch) | ~provider.isin(*prov))) for k, (ch, prov) in WIN_SCOPE.items()])
    cls = at(0)
    auth, acct = cls == 3002, cls == 3003
    explicit = eid == 4648

    def who(field: str) -> Column:
        subject, target = S.non_empty(F.col(f"j.Subject{field}")), S.non_empty(F.col(f"j.Target{field}"))
        return F.when(explicit, subject).when(auth, F.coalesce(target, subject)).otherwise(F.coalesce(subject, target))

    other = closed(acct | explicit)
    host = F.when(explicit, F.coalesce(_named(F.col("j.TargetServerName")), F.col("j.Computer"))).otherwise(F.col("j.Computer"))
    script = F.when(at(1) == 6, F.when(cls == 1002, _pick("j.ScriptBlockText", "j.Payload", "j.ContextInfo", "j.HostApplication", "j.Data")))
    service = closed(eid.isin(4697, 7045))
    path = F.when(service, _pick("j.ImagePath", "j.ServiceFileName"))
    launch = closed((eid == 4688) & F.col("j.NewProcessName").isNotNull())
    ds = closed(eid == 5136)
    logon = F.when(eid == 4624, F.col("j.TargetLogonId")).when(eid.isin(4672, 4648), F.col("j.SubjectLogonId"))
    user = who("UserName")
    return {
        "_ok": cls.isNotNull() & ~outside, "class_uid": cls, "activity_id": at(1), "status": at(2), "severity_id": at(3),
        "time": S.coerce_ms(F.col("j.TimeCreated")),
        "message": F.concat(at(4), F.lit(" for user "), F.coalesce(user, F.lit("?"))),
        "actor.user.name": user, "actor.user.domain": who("DomainName"), "actor.user.uid": who("UserSid"),
        "actor.process.name": F.when(launch, F.col("j.NewProcessName")),
        "actor.process.pid": F.when(launch, pid_number(F.col("j.NewProcessId"))),
        "actor.session.uid": F.when(F.col("j.Computer").isNotNull(), S.canon_logon_id(logon)),
        "siem.key_scope.host": F.when(logon.isNotNull(), F.col("j.Computer")),
        "src_endpoint.ip": F.coalesce(S.valid_ip(F.col("j.IpAddress")), meta_ip()),
        "src_endpoint.mac": S.valid_mac(F.col("j.MacAddress")),
        "src_endpoint.hostname": F.when(auth, F.col("j.WorkstationName")).otherwise(F.coalesce(host, F.col("j.WorkstationName"))),
        "dst_endpoint.hostname": F.when(auth, host),
        "unmapped.target_user.name": F.when(other, F.col("j.TargetUserName")),
        "unmapped.target_user.domain": F.when(other, F.col("j.TargetDomainName")),
        "unmapped.target_user.uid": F.when(other, F.col("j.TargetUserSid")),
        "unmapped.powershell.script": script, "unmapped.powershell.suspicious": F.when(script.isNotNull(), suspicious_script(script)),
        "unmapped.powershell.indicators": F.concat(script_hits(script, SCRIPT_STRONG), script_hits(script, SCRIPT_WEAK)),
        "unmapped.service.name": F.when(service, F.col("j.ServiceName")), "unmapped.service.path": path,
        "unmapped.service.suspicious_path": F.when(path.isNotNull(), suspicious_service(path)),
        "unmapped.process_launch.parent": F.when(launch, F.col("j.ParentProcessName")),
        "unmapped.process_launch.child": F.when(launch, F.col("j.NewProcessName")),
        "unmapped.process_launch.command_line": F.when(launch, F.col("j.CommandLine")),
        "unmapped.process_launch.suspicious": F.when(launch, suspicious_launch(F.col("j.ParentProcessName"), F.col("j.NewProcessName"))),
        "unmapped.directory.object_dn": F.when(ds, F.col("j.ObjectDN")),
        "unmapped.directory.attribute": F.when(ds, F.col("j.AttributeLDAPDisplayName")),
        "unmapped.directory.value": F.when(ds, F.col("j.AttributeValue")),
        "unmapped.directory.sensitive_attribute": F.when(ds, closed(F.lower("j.AttributeLDAPDisplayName").isin(*SENSITIVE_ATTRIBUTES))),
    }


# Sysmon id -> (class, activity), and rights that allow a memory dump.
SYSMON_EVENTS = {1: (1002, 1), 3: (4001, 7), 5: (1002, 3), 10: (1002, 5), 11: (1001, 1)}
DUMP_RIGHTS = ("0x1010", "0x1410", "0x1438", "0x143a", "0x147a", "0x1fffff", "0x1f1fff", "0x1f3fff", "0x1f0fff")
TRUSTED_CALLERS = (
    "\\windows\\system32\\wininit.exe", "\\windows\\system32\\csrss.exe", "\\windows\\system32\\lsm.exe",
    "\\windows\\system32\\services.exe", "\\windows\\system32\\smss.exe", "\\program files\\windows defender\\msmpeng.exe")
DEFENDER_PLATFORM = "\\programdata\\microsoft\\windows defender\\platform\\"


def dump_capable(access: Column) -> Column:
    low = F.lower(F.trim(access))
    mask = F.conv(F.regexp_replace(F.when(low.rlike(r"\A(0x)?[0-9a-f]{1,8}\z"), low), r"\A0x", ""), 16, 10).cast("bigint")
    return closed(low.isin(*DUMP_RIGHTS)) | closed((mask.bitwiseAND(0x10) != 0) & (mask.bitwiseAND(0x1400) != 0))


def sysmon() -> dict[str, Column]:
    eid = F.col("j.EventID").try_cast("int")
    cls, act = _case(eid, {k: v[0] for k, v in SYSMON_EVENTS.items()}), _case(eid, {k: v[1] for k, v in SYSMON_EVENTS.items()})
    access, net, launch = closed(eid == 10), closed(eid == 3), closed(eid == 1)
    caller = F.regexp_replace(F.lower("j.SourceImage"), r"\A[a-z]:", "")
    caller = F.translate(caller, "/", "\\")
    trusted = closed(caller.isin(*TRUSTED_CALLERS)) | closed(F.startswith(caller, F.lit(DEFENDER_PLATFORM)) & caller.endswith("\\msmpeng.exe"))
    lsass = access & closed(base_name(F.col("j.TargetImage")) == "lsass.exe") & dump_capable(F.col("j.GrantedAccess")) & ~trusted
    parts = F.split("j.User", r"\\", 2)
    user = F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(F.col("j.User"))
    image = F.coalesce("j.Image", "j.SourceImage")
    return {
        "_ok": cls.isNotNull(), "class_uid": cls, "activity_id": act, "status": F.lit("Success"),
        "severity_id": F.when(eid.isin(10, 11), MEDIUM).otherwise(INFO), "time": S.coerce_ms(F.col("j.TimeCreated")),
        "message": F.concat_ws(" ", F.lit("Sysmon event"), F.col("j.EventID"), image),
        "actor.user.name": S.non_empty(user), "actor.user.domain": F.when(F.size(parts) == 2, F.get(parts, F.lit(0))),
        "actor.process.name": image, "actor.process.pid": pid_number(F.col("j.ProcessId")),
        "actor.process.uid": S.canon_guid(F.when(access, F.coalesce("j.SourceProcessGuid", F.get_json_object("raw", "$.SourceProcessGUID"))).otherwise(F.col("j.ProcessGuid"))),
        "actor.process.parent_process.name": F.when(launch, F.col("j.ParentImage")),
        "actor.process.parent_process.pid": F.when(launch, pid_number(F.col("j.ParentProcessId"))),
        "actor.process.parent_process.uid": F.when(launch, S.canon_guid(F.col("j.ParentProcessGuid"))),
        "siem.key_scope.host": F.col("j.Computer"),
        "src_endpoint.ip": F.coalesce(F.when(net, S.valid_ip(F.col("j.SourceIp"))), meta_ip()),
        "src_endpoint.port": F.when(net, S.valid_port(F.col("j.SourcePort"))),
        "src_endpoint.hostname": F.coalesce(F.when(net, S.non_empty(F.col("j.SourceHostname"))), F.col("j.Computer")),
        "dst_endpoint.ip": F.when(net, S.valid_ip(F.col("j.DestinationIp"))),
        "dst_endpoint.port": F.when(net, S.valid_port(F.col("j.DestinationPort"))),
        "dst_endpoint.hostname": F.when(net, S.non_empty(F.col("j.DestinationHostname"))),
        "unmapped.file.path": F.when(eid == 11, F.col("j.TargetFilename")),
        "unmapped.lsass_access_suspicious": F.when(access, lsass),
        "unmapped.process_launch.suspicious": F.when(launch, suspicious_launch(F.col("j.ParentImage"), F.col("j.Image"))),
        "unmapped.process_launch.parent": F.when(launch, F.col("j.ParentImage")),
        "unmapped.process_launch.child": F.when(launch, F.col("j.Image")),
    }
