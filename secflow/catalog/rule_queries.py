"""One query per detection rule, and the assembled detection job."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from secflow.catalog.fixture import EV_SQL, security_events
from secflow.catalog.registry import query
from secflow.plans import detect
from secflow.plans.rules import RULES, Rule

DAY_S = 86_400
OUTSIDE = ("NOT ((((t // 60000) // 1440 + 3) % 7) BETWEEN 0 AND 4 AND (t // 60000) % 1440 >= 480 "
           "AND (t // 60000) % 1440 < 1080)")
PRIVATE = "(dst_ip LIKE '10.%' OR dst_ip LIKE '192.168.%' OR regexp_matches(dst_ip, '^172\\.(1[6-9]|2[0-9]|3[01])\\.'))"

# The filter of each rule over the flat fields, written independently of the rule objects.
FILTERS: dict[str, str] = {
    "agent_destructive_command": "class_uid = 6003 AND mcp_destructive",
    "agent_egress_non_allowlisted_domain": "class_uid = 6003 AND mcp_egress",
    "agent_prompt_injection_indicator": "class_uid = 6003 AND mcp_injection",
    "agent_tool_call_burst": "class_uid = 6003 AND source_type = 'mcp_agent'",
    "bank_db_priv_esc": "class_uid = 6005 AND activity_id = 5 AND sector = 'bank'",
    "bank_mass_card_read": "class_uid = 6005 AND activity_id = 1 AND sector = 'bank'",
    "cloud_root_console_login": "class_uid = 3002 AND activity_id = 1 AND source_type = 'cloudtrail'"
                                " AND identity_type = 'Root' AND mfa_used = 'No'",
    "common_after_hours_admin": f"class_uid = 1002 AND activity_id = 2 AND {OUTSIDE}",
    "common_beaconing": "class_uid = 4001 AND activity_id = 7",
    "common_bruteforce": "class_uid = 3002 AND activity_id = 4",
    "common_bruteforce_by_account": "class_uid = 3002 AND activity_id = 4",
    "common_bruteforce_sourceless": "class_uid = 3002 AND activity_id = 4",
    "common_dns_exfil": "class_uid = 4002 AND activity_id = 1",
    "common_dns_tunnel_by_domain": "class_uid = 4002 AND activity_id = 1 AND parent_domain <> 'google.com'",
    "common_ids_high_severity_alert": "class_uid = 4001 AND source_type = 'suricata_eve' AND ids_severity = 1",
    "common_impossible_travel": "class_uid = 3002 AND activity_id = 1 AND status = 'Success' AND country <> 'ZZ'",
    "common_large_outbound_flow": f"class_uid = 4001 AND activity_id = 2 AND bytes_out >= 1073741824 AND NOT {PRIVATE}",
    "common_lateral_movement": "class_uid = 3002 AND activity_id = 1 AND status = 'Success'",
    "common_lateral_movement_by_source": "class_uid = 3002 AND activity_id = 1 AND status = 'Success'",
    "common_password_spray": "class_uid = 3002 AND activity_id = 4",
    "common_password_spray_by_source": "class_uid = 3002 AND activity_id = 4",
    "common_port_scan": "class_uid = 4001 AND activity_id = 6",
    "common_port_scan_by_target": "class_uid = 4001 AND activity_id = 6",
    "common_port_sweep": "class_uid = 4001 AND activity_id = 6",
    "common_priv_grant": "class_uid = 3003 AND activity_id = 5",
    "common_rapid_account_lifecycle": "class_uid = 3003 AND activity_id IN (1, 4)",
    "common_refused_connection_scan": "class_uid = 4001 AND conn_state IN ('S0', 'REJ')",
    "dc_mass_vm_delete": "class_uid = 6003 AND activity_id = 4 AND source_type = 'vmware_vsphere' AND sector = 'datacenter'",
    "dc_mass_vm_delete_by_source": "class_uid = 6003 AND activity_id = 4 AND source_type = 'vmware_vsphere'"
                                   " AND sector = 'datacenter'",
    "dc_privileged_container": "class_uid = 6003 AND activity_id = 1 AND source_type = 'k8s_audit' AND k8s_privileged",
    "email_macro_attachment_delivered": "class_uid = 4009 AND activity_id = 2 AND email_macro AND email_delivered",
    "m365_inbox_rule_external_forward": "class_uid = 6003 AND forwards_external",
    "n8n_new_webhook_exposed": "class_uid = 6003 AND activity_id = 1 AND operation = 'webhook.created'",
    "n8n_workflow_modified_after_hours": f"class_uid = 6003 AND source_type = 'n8n_audit' AND {OUTSIDE}",
    "ot_config_change": "class_uid = 6003 AND ot_config",
    "ot_modbus_unauthorized_write": "class_uid = 4001 AND ot_anomaly = 'unauthorized_write' AND ot_ticket IS NULL",
    "ot_modbus_unauthorized_write_ticketed": "class_uid = 4001 AND ot_anomaly = 'unauthorized_write' AND ot_ticket IS NOT NULL",
    "ot_new_device_on_segment": "class_uid = 4001 AND activity_id = 1 AND source_type = 'inventory_diff'"
                                " AND sector = 'datacenter' AND ot_sector = 'ot'",
    "ot_new_engineering_connection": "class_uid = 3002 AND activity_id = 1 AND status = 'Success' AND source_type = 'opcua_audit'",
    "ot_opcua_write_unauthorized_node": "class_uid = 6003 AND activity_id = 3 AND source_type = 'opcua_audit'",
    "ot_write_outside_maintenance": f"class_uid = 6003 AND activity_id = 3 AND source_type = 'opcua_audit' AND {OUTSIDE}",
    "ot_write_unlisted_source": "class_uid = 4001 AND src_ip IS NOT NULL AND ot_pdu <> 'RESP' AND ("
                                "(source_type IN ('suricata_eve', 'zeek_json') AND ot_protocol = 'modbus_tcp'"
                                " AND ot_function IN (5, 6, 15, 16, 21, 22, 23)) OR (source_type = 'suricata_eve'"
                                " AND ot_protocol = 'dnp3' AND ot_function IN (2, 4, 5, 6)))",
    "win_ad_sensitive_attribute_modified": "class_uid = 3003 AND activity_id = 6 AND sensitive_attribute",
    "win_audit_log_cleared": "class_uid = 1002 AND activity_id = 4",
    "win_lsass_access_suspicious": "class_uid = 1002 AND activity_id = 5 AND lsass_suspicious",
    "win_office_spawns_shell": "class_uid = 1002 AND activity_id = 1 AND launch_suspicious",
    "win_powershell_suspicious_script": "class_uid = 1002 AND activity_id = 6 AND script_suspicious",
    "win_service_installed_suspicious_path": "class_uid = 1002 AND activity_id = 3 AND service_suspicious",
}

ACCOUNT = "lower(trim(user_name))"
FLAT_FIELD = {
    "unmapped.mcp.session_id": "mcp_session", "unmapped.db.object": "db_object", "src_endpoint.ip": "src_ip",
    "actor.user.name": ACCOUNT, "src_endpoint.hostname": "src_host", "unmapped.dns.parent_domain": "parent_domain",
    "unmapped.ids.flow_id": "CAST(flow_id AS VARCHAR)", "dst_endpoint.ip": "dst_ip",
    "unmapped.target_user.name": "lower(trim(target_user))", "unmapped.ot.server_id": "ot_server",
}
FLAT_VALUE = {"actor.user.name": "user_name", "dst_endpoint.hostname": "dst_host", "dst_endpoint.port": "dst_port",
              "src_endpoint.ip": "src_ip", "dst_endpoint.ip": "dst_ip", "src_endpoint.location.country": "country"}


def stretched(rule: Rule) -> Rule:
    """The rule with its window and limit fitted to a table of some events per account and day."""
    if not rule.stateful:
        return rule
    window = min(max(rule.window_s * 1440, DAY_S), 6 * DAY_S)
    limit = {"common_beaconing": 4, "common_ids_high_severity_alert": 1}.get(rule.name, min(rule.threshold, 3))
    return replace(rule, window_s=window, threshold=limit, max_cv=0.8 if rule.max_cv else None)


def members_sql(rule: Rule, alias: str = "m") -> str:
    """Fed events of a stateful rule: (eid, tenant, grp, t, val)."""
    value = FLAT_VALUE[rule.distinct] if rule.distinct else "ingest_id"
    return (f"{alias} AS (SELECT ingest_id AS eid, tenant, {FLAT_FIELD[rule.group]} AS grp, t, CAST({value} AS VARCHAR) AS val"
            f" FROM ev WHERE {FILTERS[rule.name]} AND {FLAT_FIELD[rule.group]} IS NOT NULL AND {value} IS NOT NULL)")


def level_sql(rule: Rule, m: str = "m", out: str = "lv") -> str:
    """Measure of every fed event by a plain self join over its window."""
    window = rule.window_s * 1000
    join = (f"FROM {m} a JOIN {m} b ON a.tenant = b.tenant AND a.grp = b.grp AND b.t BETWEEN a.t - {window} AND a.t")
    if rule.measure == "cv":
        return (f"{out} AS (SELECT eid, tenant, grp, t, count(*) AS n, stddev_pop(gap) / nullif(avg(gap), 0) AS cv FROM ("
                f"SELECT a.eid, a.tenant, a.grp, a.t, b.t - lag(b.t) OVER (PARTITION BY a.eid ORDER BY b.t, b.eid) AS gap {join})"
                " GROUP BY 1, 2, 3, 4)")
    measure = "count(DISTINCT b.val)" if rule.distinct else "count(*)"
    return f"{out} AS (SELECT a.eid, a.tenant, a.grp, a.t, {measure} AS n {join} GROUP BY 1, 2, 3, 4)"


def rule_sql(rule: Rule) -> str:
    if not rule.stateful:
        return (f"WITH {EV_SQL} SELECT concat('{rule.id}:', tenant, ':', ingest_id) AS alert_id, t AS last_t,"
                f" CAST(1 AS BIGINT) AS hits, CAST(NULL AS BIGINT) AS n FROM ev WHERE {FILTERS[rule.name]}")
    window = rule.window_s * 1000
    regular = f" AND cv <= {rule.max_cv} AND n >= 3" if rule.max_cv is not None else ""
    return (f"WITH {EV_SQL}, {members_sql(rule)}, {level_sql(rule)} "
            f"SELECT concat('{rule.id}:', tenant, ':', length(grp), ':', grp, ':', t // {window}) AS alert_id,"
            " max(t) AS last_t, count(*) AS hits, CAST(arg_max(n, (t, eid)) AS BIGINT) AS n"
            f" FROM lv WHERE n >= {rule.threshold}{regular} GROUP BY 1")


def _register(rule: Rule) -> None:
    fitted = stretched(rule)

    @query(f"rule_{rule.name}", rule_sql(fitted))
    def run(spark, sf_dir):
        hits = detect.run_rules(security_events(spark, sf_dir), [fitted], mode="event")
        return detect.collapse(hits).select("alert_id", F.col("t").alias("last_t"), "hits", "n")


for _rule in RULES:
    _register(_rule)
