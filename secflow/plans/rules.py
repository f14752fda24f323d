"""The detection rules: each a null-safe filter and, when stateful, one sliding window."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.functions.predicates import all_of, closed, cmp, eq, exists, isin_, not_in, outside_hours
from secflow.operators.lists import LISTED, Test, test_name, with_lists

# Entries of the shipped allow lists (lists not named here are empty).
ALLOWLISTS: dict[str, tuple[str, ...]] = {
    "corp_ranges": ("10.0.0.0/8", "192.168.0.0/16", "172.16.0.0/12"),
    "dns_high_cardinality_parents": (
        "akamai.net", "akamaiedge.net", "akadns.net", "azureedge.net", "cloudfront.net", "edgekey.net",
        "edgesuite.net", "googlevideo.com", "googleusercontent.com", "windowsupdate.com", "apple.com",
        "google.com", "googleapis.com", "gvt1.com", "icloud.com", "microsoft.com", "sophosxl.net", "spamhaus.org"),
    "non_geographic_country_codes": ("ZZ",),
}
GIB = 1 << 30


#: Where list tests are answered: None for the shipped entries, else the set that takes the tests in, which the column ``_listed`` answers.
LIST_TESTS: ContextVar[set[Test] | None] = ContextVar("list_tests", default=None)


@contextmanager
def lists_from_column() -> Iterator[set[Test]]:
    """Inside, predicates read list tests from the column of ``operators.lists.with_lists``; the set holds the tests that were built."""
    tests: set[Test] = set()
    token = LIST_TESTS.set(tests)
    try:
        yield tests
    finally:
        LIST_TESTS.reset(token)


def shipped_lists(spark: SparkSession) -> DataFrame:
    """The shipped entries as a table (list, entry), to be changed or added to."""
    return spark.createDataFrame([(name, e) for name, entries in ALLOWLISTS.items() for e in entries], "list string, entry string")


def _unlisted(path: str, name: str) -> Column:
    tests = LIST_TESTS.get()
    if tests is not None:
        tests.add((path, name))
        return ~closed(F.array_contains(F.col(LISTED), F.lit(test_name(path, name))))
    entries = ALLOWLISTS.get(name, ())
    return not_in(path, [e for e in entries if "/" not in e], [e for e in entries if "/" in e])


def list_tests(rules: Sequence[Rule]) -> list[Test]:
    """The (path, list) tests that the rules make."""
    with lists_from_column() as tests:
        for r in rules:
            r.where()
    return sorted(tests)


def listed_events(events: DataFrame, rules: Sequence[Rule], lists: DataFrame) -> DataFrame:
    """Events with the answers to all list tests of the rules."""
    tests = list_tests(rules)
    return with_lists(events, tests, lists) if tests else events


@dataclass(frozen=True)
class Rule:
    """One rule. ``where`` is called when a plan is built, so that columns bind to that session."""

    name: str
    id: str
    title: str
    level: str
    weight: int
    class_uid: int
    where: Callable[[], Column]
    tactic: str | None = None
    technique: str | None = None
    framework: str | None = None
    group: str | None = None
    threshold: int = 0
    window_s: int = 0
    distinct: str | None = None
    max_cv: float | None = None
    companion_of: str | None = None
    default_enabled: bool = True
    deep_gate: bool = True
    exposure_gate: bool = True

    @property
    def stateful(self) -> bool:
        return self.group is not None

    @property
    def measure(self) -> str | None:
        if not self.stateful:
            return None
        return "distinct" if self.distinct else "cv" if self.max_cv is not None else "count"

    def predicate(self) -> Column:
        """The full filter. The class test comes first, so it reaches the scan as a pushed filter."""
        return all_of(eq("class_uid", self.class_uid), self.where())


def _on(activity: int | None = None, *more: Callable[[], Column], **equal) -> Callable[[], Column]:
    """Conjunction of activity, dotted-path equalities (``__`` for a dot) and further predicates."""
    def build() -> Column:
        preds = [eq("activity_id", activity)] if activity is not None else []
        preds += [eq(path.replace("__", "."), value) for path, value in equal.items()]
        return all_of(*preds, *[m() for m in more])
    return build


_OFFICE_HOURS = lambda: outside_hours("time")
_AUTH_OK = _on(1, status="Success")
_VM_DELETE = _on(4, siem__source_type="vmware_vsphere", siem__sector="datacenter")
_UNAUTHORISED = {"unmapped__ot__anomaly_type": "unauthorized_write"}


def _large_upload() -> Column:
    sent = [all_of(eq("siem.source_type", src), cmp(path, "gte", GIB)) for src, path in (
        ("suricata_eve", "unmapped.suricata.flow.bytes_toserver"), ("zeek_json", "unmapped.zeek.conn.orig_bytes"))]
    return all_of(eq("activity_id", 2), sent[0] | sent[1], exists("dst_endpoint.ip"),
                  _unlisted("dst_endpoint.ip", "corp_ranges"),
                  _unlisted("dst_endpoint.ip", "large_transfer_destinations"))


def _unlisted_writer() -> Column:
    code, protocol = "unmapped.ot.function_code", "unmapped.ot.protocol"
    modbus = all_of(isin_("siem.source_type", ["suricata_eve", "zeek_json"]), eq(protocol, "modbus_tcp"),
                    isin_(code, [5, 6, 15, 16, 21, 22, 23]))
    dnp3 = all_of(eq("siem.source_type", "suricata_eve"), eq(protocol, "dnp3"), isin_(code, [2, 4, 5, 6]))
    return all_of(modbus | dnp3, ~eq("unmapped.ot.pdu_type", "RESP"), exists("src_endpoint.ip"),
                  _unlisted("src_endpoint.ip", "ot_authorized_writers"))


SRC, DST, USER = "src_endpoint.ip", "dst_endpoint.ip", "actor.user.name"
SRC_HOST, DST_HOST, DST_PORT = "src_endpoint.hostname", "dst_endpoint.hostname", "dst_endpoint.port"

# Ids, titles, levels, weights, windows and techniques of the shipped rules.
RULES: tuple[Rule, ...] = (
    Rule("agent_destructive_command", "5e6f7081-92a3-4bc4-ad2e-4f5a6b7c8d9e",
         "AI agent tool call carries a destructive command pattern", "critical", 85, 6003,
         _on(unmapped__mcp__destructive_command_indicator=True), "TA0040", "T1485"),
    Rule("agent_egress_non_allowlisted_domain", "6f708192-a3b4-4cd5-be3f-5a6b7c8d9e0f",
         "AI agent tool call reached a non-allowlisted domain", "high", 70, 6003,
         _on(None, lambda: _unlisted("unmapped.mcp.egress_domain", "agent_egress_domains"),
             unmapped__mcp__is_egress_call=True), "TA0011", "T1071"),
    Rule("agent_prompt_injection_indicator", "3c4d5e6f-7081-48a9-9b1c-3d4e5f6a7b8d",
         "AI agent tool call carries a prompt-injection indicator", "medium", 50, 6003,
         _on(unmapped__mcp__injection_indicator=True), "AML.TA0004", "AML.T0051", "atlas"),
    Rule("agent_tool_call_burst", "2b3c4d5e-6f70-4899-8a1b-2c3d4e5f6a7c",
         "AI agent tool-call burst (runaway/abused agent session)", "medium", 45, 6003,
         _on(siem__source_type="mcp_agent"), group="unmapped.mcp.session_id", threshold=50, window_s=60),
    Rule("bank_db_priv_esc", "2a9d7b41-5e6c-4f88-bb12-3c0a1e7d4f02",
         "Privileged database operation on a banking DB", "critical", 85, 6005,
         _on(5, siem__sector="bank"), "TA0004", "T1548"),
    Rule("bank_mass_card_read", "d4e5f607-8192-4a31-8b4c-5d6e7f809104",
         "Mass cardholder-data read (one database object hammered, bank)", "high", 65, 6005,
         _on(1, siem__sector="bank"), "TA0009", "T1005", group="unmapped.db.object", threshold=20, window_s=300),
    Rule("cloud_root_console_login", "c3d4e5f6-7081-4920-9a3b-4c5d6e7f8093",
         "AWS root console login without MFA", "critical", 90, 3002,
         _on(1, siem__source_type="cloudtrail", unmapped__cloud__identity_type="Root",
             unmapped__cloud__mfa_used="No"), "TA0001", "T1078.004"),
    Rule("common_after_hours_admin", "9b5f2d18-3c7a-4e61-8f24-5a1d7c3e9b06",
         "Privileged logon outside business hours", "high", 60, 1002,
         _on(2, lambda: _unlisted(USER, "service_accounts"), _OFFICE_HOURS), "TA0004", "T1078"),
    Rule("common_beaconing", "f6071829-a3b4-4c53-9d6e-7f8091a2b526",
         "Regular-interval outbound connections from one source (beaconing)", "medium", 40, 4001,
         _on(7), "TA0011", "T1071", group=SRC, threshold=20, window_s=3600, max_cv=0.25),
    Rule("common_bruteforce", "6f1c8a2e-0d3b-4c11-9a21-7b5e2f9a1c01",
         "Authentication brute-force from single source", "high", 70, 3002,
         _on(4), "TA0006", "T1110", group=SRC, threshold=10, window_s=60),
    Rule("common_bruteforce_by_account", "d83b71c3-93eb-439f-86f9-5985ebcc38cb",
         "Authentication brute-force against one account (any number of sources)", "medium", 0, 3002,
         _on(4), "TA0006", "T1110", group=USER, threshold=10, window_s=60, companion_of="common_bruteforce"),
    Rule("common_bruteforce_sourceless", "8c2f5a91-4d16-4e8b-9c3a-1f6b2e7d5a83",
         "Authentication brute-force against one host (source IP not recorded)", "high", 70, 3002,
         _on(4), "TA0006", "T1110", "attack", group=SRC_HOST, threshold=5, window_s=120, distinct=USER),
    Rule("common_dns_exfil", "a1b2c3d4-5e6f-4708-9a1b-2c3d4e5f6071",
         "DNS query volume to many distinct domains from one source", "medium", 45, 4002,
         _on(1), "TA0011", "T1071.004", group=SRC, threshold=40, window_s=60, distinct=DST_HOST),
    Rule("common_dns_tunnel_by_domain", "5f3c9d18-72a4-4e0b-b6d1-8c2e7a4f1b93",
         "DNS tunnelling shape - many distinct names under one parent domain", "medium", 0, 4002,
         _on(1, lambda: _unlisted("unmapped.dns.parent_domain", "dns_high_cardinality_parents")),
         "TA0011", "T1071.004", group="unmapped.dns.parent_domain", threshold=40, window_s=60,
         distinct=DST_HOST, companion_of="common_dns_exfil"),
    Rule("common_ids_high_severity_alert", "0331c311-7985-47c8-b554-682781ef1069",
         "Suricata IDS alert with signature severity 1 (high)", "high", 55, 4001,
         _on(siem__source_type="suricata_eve", unmapped__ids__engine="suricata", unmapped__ids__severity=1),
         group="unmapped.ids.flow_id", threshold=1, window_s=3600),
    Rule("common_impossible_travel", "7081a2b3-c405-4de3-be5f-6a7b8c9d0e12",
         "Impossible travel (same account, distinct countries in a short window)", "high", 70, 3002,
         _on(1, lambda: _unlisted("src_endpoint.location.country", "non_geographic_country_codes"),
             status="Success"), "TA0001", "T1078", group=USER, threshold=2, window_s=3600,
         distinct="src_endpoint.location.country"),
    Rule("common_large_outbound_flow", "8bde66cd-c1e9-45e5-83d7-fd091eb80f1d",
         "Very large outbound transfer to a non-private destination (Suricata flow / Zeek conn, 1 GiB+)",
         "medium", 35, 4001, _large_upload),
    Rule("common_lateral_movement", "2e3d4c5b-6f70-4819-9b02-1c2d3e4f5061",
         "Lateral movement (one account auth success to many distinct hosts)", "high", 65, 3002,
         _AUTH_OK, "TA0008", "T1021", group=USER, threshold=5, window_s=300, distinct=DST_HOST),
    Rule("common_lateral_movement_by_source", "90561d27-ace4-4138-8cc4-c74569a439c6",
         "Lateral movement from one source host (any number of accounts)", "high", 0, 3002,
         _AUTH_OK, "TA0008", "T1021", group=SRC, threshold=5, window_s=300, distinct=DST_HOST,
         companion_of="common_lateral_movement"),
    Rule("common_password_spray", "4f8a2c61-9e3d-4b57-8a1c-6d2e5f7a8b90",
         "Credential stuffing (one account attempted from many distinct source IPs)", "high", 70, 3002,
         _on(4), "TA0006", "T1110.004", group=USER, threshold=8, window_s=300, distinct=SRC),
    Rule("common_password_spray_by_source", "8c2f6a14-3d97-4e05-b1a8-7f4d9c0e5b26",
         "Password spray (one source failing against many distinct accounts)", "high", 70, 3002,
         _on(4), "TA0006", "T1110.003", group=SRC, threshold=8, window_s=300, distinct=USER),
    Rule("common_port_scan", "1d2c3b4a-5e6f-4708-8a91-0b1c2d3e4f05",
         "Port scan from single source (many distinct destination ports)", "high", 60, 4001,
         _on(6), "TA0007", "T1046", group=SRC, threshold=15, window_s=60, distinct=DST_PORT),
    Rule("common_port_scan_by_target", "aaa9dc23-8550-41ae-acbc-0ae50837d8d6",
         "Port scan against one target (any number of sources)", "low", 0, 4001,
         _on(6), "TA0007", "T1046", group=DST, threshold=15, window_s=60, distinct=DST_PORT,
         companion_of="common_port_scan"),
    Rule("common_port_sweep", "d4a91b7c-62e8-4c3f-95a0-1e8b7d2f6c33",
         "Horizontal sweep (one source denied across many distinct hosts)", "medium", 55, 4001,
         _on(6), "TA0007", "T1046", group=SRC, threshold=15, window_s=60, distinct=DST),
    Rule("common_priv_grant", "7d3e9a52-1f6c-4a88-9b3d-2e5c8f1a6d40",
         "Privileged group membership grant", "high", 65, 3003, _on(5), "TA0003", "T1098"),
    Rule("common_rapid_account_lifecycle", "e5f60718-92a3-4b42-9c5d-6e7f80910415",
         "Rapid account create-then-delete (same target account)", "high", 70, 3003,
         lambda: isin_("activity_id", [1, 4]), "TA0003", "T1136",
         group="unmapped.target_user.name", threshold=2, window_s=3600),
    Rule("common_refused_connection_scan", "7b3e9d51-4c2a-4f86-a1d0-5e8c2b6f9a14",
         "Refused or unanswered connections from one source across many ports (Zeek conn_state S0/REJ)",
         "medium", 45, 4001, lambda: isin_("unmapped.zeek.conn.conn_state", ["S0", "REJ"]), "TA0007", "T1046",
         group=SRC, threshold=15, window_s=60, distinct=DST_PORT),
    Rule("dc_mass_vm_delete", "8c4e1f90-7a2b-4d33-9e55-6f1b2c3a4d03",
         "Mass VM deletion via hypervisor API (ransomware / sabotage pattern)", "critical", 85, 6003,
         _VM_DELETE, "TA0040", "T1485", group=USER, threshold=5, window_s=120),
    Rule("dc_mass_vm_delete_by_source", "9c86195a-8cd6-4b73-b526-a708bbb5299e",
         "Mass VM deletion from one source address (any number of accounts)", "critical", 0, 6003,
         _VM_DELETE, "TA0040", "T1485", group=SRC, threshold=5, window_s=120, companion_of="dc_mass_vm_delete"),
    Rule("dc_privileged_container", "b2c3d4e5-6f70-4819-8a2b-3c4d5e6f7082",
         "Privileged container created via the Kubernetes API", "high", 70, 6003,
         _on(1, siem__source_type="k8s_audit", unmapped__k8s__is_privileged=True), "TA0002", "T1610"),
    Rule("email_macro_attachment_delivered", "b9520921-f098-4f6d-b49e-2691ed51711f",
         "Inbound email with a macro-capable attachment was delivered", "medium", 50, 4009,
         _on(2, unmapped__email__has_macro_attachment=True, unmapped__email__delivered=True),
         "TA0001", "T1566.001"),
    Rule("m365_inbox_rule_external_forward", "0ca6b652-ad3a-470b-8d31-f43f97c11799",
         "Mailbox rule forwards mail to an external address", "high", 75, 6003,
         _on(unmapped__m365__inbox_rule__forwards_external=True), "TA0009", "T1114.003"),
    Rule("n8n_new_webhook_exposed", "8192a3b4-c516-4ef4-9c5f-6a7b8c9d0e13",
         "n8n new webhook exposed", "medium", 40, 6003,
         _on(1, api__operation="webhook.created"), "TA0003", "T1133"),
    Rule("n8n_workflow_modified_after_hours", "92a3b4c5-d627-4f05-ad6f-7a8b9c0d1e24",
         "n8n automation-platform activity outside business hours", "medium", 45, 6003,
         _on(None, _OFFICE_HOURS, siem__source_type="n8n_audit"), "TA0004", "T1078"),
    Rule("ot_config_change", "6f708192-a314-4cd2-ad4e-5f6a7b8c9d01",
         "OT configuration/firmware node changed", "high", 60, 6003,
         _on(unmapped__ot__is_config_node=True), "TA0106", "T0836", "attack-ics"),
    Rule("ot_modbus_unauthorized_write", "9c1d2e3f-4a5b-4c6d-8e7f-1a2b3c4d5e6f",
         "Modbus/TCP write outside the expected address range (unauthorized write)", "high", 75, 4001,
         _on(None, lambda: ~exists("unmapped.ot.change_ticket_id"), **_UNAUTHORISED),
         "TA0106", "T0855", "attack-ics"),
    Rule("ot_modbus_unauthorized_write_ticketed", "bc313d43-588a-47e5-9f79-a4984ae1922c",
         "Modbus/TCP write outside the expected address range, ticketed (authorized change)", "low", 10, 4001,
         _on(None, lambda: exists("unmapped.ot.change_ticket_id"), **_UNAUTHORISED),
         "TA0106", "T0855", "attack-ics", exposure_gate=False),
    Rule("ot_new_device_on_segment", "7f8091a2-b3c4-4d53-9e6f-1a2b3c4d5e6f",
         "New OT device appeared on the OT inventory segment", "high", 55, 4001,
         _on(1, siem__source_type="inventory_diff", siem__sector="datacenter", unmapped__ot__sector="ot"),
         "TA0108", "T0864", "attack-ics"),
    Rule("ot_new_engineering_connection", "5e6f7081-9203-4bc1-9c3d-4e5f6a7b8c9f",
         "Multiple distinct sources connecting to the same PLC (concurrent)", "medium", 45, 3002,
         _on(1, status="Success", siem__source_type="opcua_audit"), "TA0108", "T0864", "attack-ics",
         group="unmapped.ot.server_id", threshold=2, window_s=600, distinct=SRC),
    Rule("ot_opcua_write_unauthorized_node", "e7a14b6d-3c52-4d90-8f1b-5a9c0d2e6b47",
         "OPC UA write to a node not on the authorised-node list", "medium", 0, 6003,
         _on(3, lambda: _unlisted("unmapped.ot.node_id", "opcua_authorized_nodes"),
             siem__source_type="opcua_audit"), "TA0106", "T0855", "attack-ics", default_enabled=False),
    Rule("ot_write_outside_maintenance", "4d5e6f70-8192-49b0-8b2c-3d4e5f6a7b8e",
         "OT control-system write outside the maintenance window", "high", 65, 6003,
         _on(3, _OFFICE_HOURS, siem__source_type="opcua_audit"), "TA0106", "T0836", "attack-ics"),
    Rule("ot_write_unlisted_source", "1256b853-33fb-425a-b954-f19add35285f",
         "OT write command (Modbus/TCP or DNP3) seen on the wire from a source not on the authorised-writer list",
         "high", 70, 4001, _unlisted_writer, "TA0106", "T0855", "attack-ics", default_enabled=False),
    Rule("win_ad_sensitive_attribute_modified", "4243e2e6-8bd0-4c6e-87ec-574d1ec681a5",
         "Sensitive Active Directory attribute modified", "high", 65, 3003,
         _on(6, unmapped__directory__sensitive_attribute=True), "TA0003", "T1098"),
    Rule("win_audit_log_cleared", "17dcc2b9-4d62-4fc2-9833-83954bf1b902",
         "Windows audit log cleared", "high", 75, 1002, _on(4), "TA0005", "T1070.001"),
    Rule("win_lsass_access_suspicious", "ed287553-9e4b-45c1-8189-625dfbad7442",
         "Suspicious process access to lsass.exe", "critical", 90, 1002,
         _on(5, unmapped__lsass_access_suspicious=True), "TA0006", "T1003.001"),
    Rule("win_office_spawns_shell", "5b7e0d3a-91c4-4f6e-8a2d-3c1f9e7b4a10",
         "Document host spawned a shell or script host", "high", 75, 1002,
         _on(1, unmapped__process_launch__suspicious=True), "TA0002", "T1204.002"),
    Rule("win_powershell_suspicious_script", "79a1b4be-2ffb-4aba-8051-f09b4863ffc4",
         "Suspicious PowerShell script content", "high", 70, 1002,
         _on(6, unmapped__powershell__suspicious=True), "TA0002", "T1059.001"),
    Rule("win_service_installed_suspicious_path", "dcddff84-7500-4360-8acc-14768a2ae0b7",
         "Service installed from a suspicious path", "high", 70, 1002,
         _on(3, unmapped__service__suspicious_path=True), "TA0003", "T1543.003"),
)

BY_NAME = {r.name: r for r in RULES}


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rules' attributes as rows (one per rule)."""
    ids = {r.name: r.id for r in RULES}
    rows = [(r.id, r.name, r.title, r.level, r.weight, r.class_uid, r.framework, r.tactic, r.technique,
             ids.get(r.companion_of or ""), r.default_enabled, r.deep_gate, r.exposure_gate,
             r.threshold, r.window_s * 1000, r.measure, r.group, r.distinct) for r in rules]
    return spark.createDataFrame(rows, (
        "rule_id string, rule_name string, rule_title string, level string, weight int, class_uid int,"
        "framework string, tactic string, technique string, companion_of string, default_enabled boolean,"
        "deep_gate boolean, exposure_gate boolean, threshold int, window_ms bigint, measure string,"
        "group_field string, distinct_field string"))


# Score floors per level, route limits and criticality points.
FLOORS = {"informational": 0, "low": 10, "medium": 40, "high": 70, "critical": 80}
ROUTE_DEEP, ROUTE_LIGHT = 60, 20
CRITICALITY_POINTS = {"low": 0, "medium": 5, "high": 10, "critical": 20, "crown_jewel": 15}


def floor_of(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, level), F.lit(0))
