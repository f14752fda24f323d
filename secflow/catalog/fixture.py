"""The supplied ``events`` table read as security events.

``FLAT`` maps each event to flat security fields with SQL text that means the same in Spark and in
DuckDB, so a check query starts from the same fields without touching any operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.functions.scalars import epoch_ms_of
from secflow.normalize.assemble import assemble, identity_leaves

FLAT: dict[str, str] = {
    "tenant": "concat('t', u % 3)",
    "ingest_id": "concat('e', event_id)",
    "class_uid": "CASE WHEN s < 4 THEN 3002 WHEN s < 10 OR s = 19 THEN 4001 WHEN s = 10 THEN 4002 WHEN s < 15 THEN 6003"
                 " WHEN s = 15 THEN 6005 WHEN s = 16 THEN 1002 WHEN s = 17 THEN 3003 ELSE 4009 END",
    "activity_id": "CASE WHEN s < 2 THEN 4 WHEN s < 4 THEN 1 WHEN s IN (4, 5, 9) THEN 6 WHEN s = 6 THEN 7"
                   " WHEN s = 7 THEN 99 WHEN s = 8 THEN 2 WHEN s = 10 THEN 1 WHEN s = 11 THEN 1 + u % 4"
                   " WHEN s = 12 THEN 4 WHEN s = 13 THEN 1 + u % 3 WHEN s = 14 THEN 3"
                   " WHEN s = 15 THEN CASE WHEN u % 2 = 0 THEN 1 ELSE 5 END WHEN s IN (16, 17) THEN 1 + u % 6"
                   " WHEN s = 18 THEN 1 + u % 2 ELSE 1 + u % 2 END",
    "source_type": "CASE WHEN s < 2 THEN 'linux_ssh' WHEN s = 2 THEN CASE WHEN u % 2 = 0 THEN 'cloudtrail'"
                   " ELSE 'active_directory' END WHEN s IN (3, 14) THEN 'opcua_audit' WHEN s < 7 THEN 'cisco_asa'"
                   " WHEN s = 7 THEN 'suricata_eve' WHEN s = 8 THEN CASE WHEN u % 2 = 0 THEN 'suricata_eve'"
                   " ELSE 'zeek_json' END WHEN s = 9 THEN CASE u % 3 WHEN 0 THEN 'suricata_eve' WHEN 1 THEN 'zeek_json'"
                   " ELSE 'modbus_anomaly' END WHEN s = 10 THEN 'dns_query' WHEN s = 11 THEN 'mcp_agent'"
                   " WHEN s = 12 THEN 'vmware_vsphere' WHEN s = 13 THEN CASE u % 4 WHEN 0 THEN 'k8s_audit'"
                   " WHEN 1 THEN 'n8n_audit' WHEN 2 THEN 'm365_audit' ELSE 'opcua_audit' END"
                   " WHEN s = 15 THEN 'db_audit' WHEN s < 18 THEN 'windows_eventlog' WHEN s = 18 THEN 'mail_gateway'"
                   " WHEN u % 2 = 0 THEN 'inventory_diff' ELSE 'zeek_json' END",
    "sector": "CASE WHEN s IN (9, 12, 14, 19) THEN 'datacenter' WHEN s = 15 AND u % 5 <> 0 THEN 'bank' ELSE 'common' END",
    "status": "CASE WHEN s < 2 THEN 'Failure' WHEN s < 4 AND u % 7 <> 0 THEN 'Success' WHEN s < 4 THEN 'Failure' END",
    "severity_id": "CAST(1 + k % 6 AS INT)",
    "user_name": "CASE WHEN u % 11 <> 0 THEN concat(CASE WHEN event_id % 2 = 0 THEN 'User' ELSE ' user' END, u % 20) END",
    "src_ip": "CASE WHEN u % 13 <> 0 THEN concat('10.', k % 4, '.0.', u % 31) END",
    "src_host": "concat('host', u % 25)",
    "dst_ip": "CASE WHEN k % 3 = 0 THEN concat('203.0.113.', u % 50) ELSE concat('10.9.', k % 5, '.', u % 20) END",
    "dst_host": "CASE WHEN s = 10 THEN concat('n', event_id % 200, CASE WHEN u % 3 = 0 THEN '.google.com'"
                " ELSE '.example.co.uk' END) ELSE concat('srv', (u * k) % 30) END",
    "parent_domain": "CASE WHEN s = 10 THEN CASE WHEN u % 3 = 0 THEN 'google.com' ELSE 'example.co.uk' END END",
    "dst_port": "CASE WHEN s IN (4, 5, 19) THEN CAST((k * 7 + event_id) % 60 AS INT) END",
    "country": "CASE WHEN s IN (2, 3) AND k % 5 <> 1 THEN CASE WHEN k % 5 = 0 THEN 'ZZ' ELSE concat('C', event_id % 4) END END",
    "mcp_session": "CASE WHEN s = 11 THEN concat('m', u % 20) END",
    "mcp_destructive": "s = 11 AND u % 5 = 0",
    "mcp_injection": "s = 11 AND u % 5 = 1",
    "mcp_egress": "s = 11 AND u % 5 = 2",
    "mcp_domain": "CASE WHEN s = 11 AND u % 5 = 2 THEN concat('x', u, '.example') END",
    "db_object": "CASE WHEN s = 15 THEN concat('card', u % 10) END",
    "identity_type": "CASE WHEN s = 2 AND u % 2 = 0 THEN CASE WHEN u % 4 = 0 THEN 'Root' ELSE 'IAMUser' END END",
    "mfa_used": "CASE WHEN s = 2 AND u % 2 = 0 THEN CASE WHEN u % 8 = 0 THEN 'No' ELSE 'Yes' END END",
    "k8s_privileged": "s = 13 AND u % 12 = 0",
    "ids_severity": "CASE WHEN s = 7 THEN CAST(1 + u % 3 AS INT) END",
    "flow_id": "CASE WHEN s IN (7, 8) THEN u * 100 + k END",
    "bytes_out": "CASE WHEN s = 8 THEN CASE WHEN k > 40 THEN 2000000000 ELSE 1000 END END",
    "conn_state": "CASE WHEN s = 19 AND u % 2 = 1 THEN CASE event_id % 3 WHEN 0 THEN 'S0' WHEN 1 THEN 'REJ' ELSE 'SF' END END",
    "ot_anomaly": "CASE WHEN s = 9 THEN CASE WHEN u % 2 = 0 THEN 'unauthorized_write' ELSE 'exception_response' END END",
    "ot_ticket": "CASE WHEN s = 9 AND u % 4 = 0 THEN 'CHG-1' END",
    "ot_protocol": "CASE WHEN s = 9 THEN CASE WHEN u % 6 = 0 THEN 'dnp3' ELSE 'modbus_tcp' END END",
    "ot_function": "CASE WHEN s = 9 THEN CAST(event_id % 24 AS INT) END",
    "ot_pdu": "CASE WHEN s = 9 THEN CASE WHEN event_id % 4 = 0 THEN 'RESP' ELSE 'REQ' END END",
    "ot_address": "CASE WHEN s = 9 THEN CAST(40001 + u % 20 AS INT) END",
    "ot_sector": "CASE WHEN s = 19 AND u % 2 = 0 THEN CASE WHEN u % 4 = 0 THEN 'ot' ELSE 'it' END END",
    "ot_server": "CASE WHEN s = 3 THEN concat('plc', u % 5) END",
    "ot_node": "CASE WHEN s = 14 THEN concat('ns=2;s=', u % 9) END",
    "ot_config": "s IN (13, 14) AND u % 3 = 0",
    "operation": "CASE WHEN s = 13 AND u % 4 = 1 THEN CASE WHEN u % 8 = 1 THEN 'webhook.created' ELSE 'workflow.updated' END END",
    "forwards_external": "s = 13 AND u % 8 = 2",
    "email_macro": "s = 18 AND u % 3 = 0",
    "email_delivered": "s = 18 AND u % 5 <> 0",
    "launch_suspicious": "s = 16 AND u % 12 = 0",
    "service_suspicious": "s = 16 AND u % 12 = 2",
    "lsass_suspicious": "s = 16 AND u % 12 = 4",
    "script_suspicious": "s = 16 AND u % 12 = 5",
    "sensitive_attribute": "s = 17 AND u % 12 = 5",
    "target_user": "CASE WHEN s = 17 THEN concat('acct', u % 15) END",
}

# The event schema path each flat field fills.
PATHS: dict[str, str] = {
    "tenant": "siem.tenant", "ingest_id": "siem.ingest_id", "source_type": "siem.source_type",
    "sector": "siem.sector", "status": "status", "severity_id": "severity_id", "user_name": "actor.user.name",
    "src_ip": "src_endpoint.ip", "src_host": "src_endpoint.hostname", "dst_ip": "dst_endpoint.ip",
    "dst_host": "dst_endpoint.hostname", "dst_port": "dst_endpoint.port",
    "country": "src_endpoint.location.country", "parent_domain": "unmapped.dns.parent_domain",
    "mcp_session": "unmapped.mcp.session_id", "mcp_destructive": "unmapped.mcp.destructive_command_indicator",
    "mcp_injection": "unmapped.mcp.injection_indicator", "mcp_egress": "unmapped.mcp.is_egress_call",
    "mcp_domain": "unmapped.mcp.egress_domain", "db_object": "unmapped.db.object",
    "identity_type": "unmapped.cloud.identity_type", "mfa_used": "unmapped.cloud.mfa_used",
    "k8s_privileged": "unmapped.k8s.is_privileged", "ids_severity": "unmapped.ids.severity",
    "flow_id": "unmapped.ids.flow_id", "conn_state": "unmapped.zeek.conn.conn_state",
    "ot_anomaly": "unmapped.ot.anomaly_type", "ot_ticket": "unmapped.ot.change_ticket_id",
    "ot_protocol": "unmapped.ot.protocol", "ot_function": "unmapped.ot.function_code",
    "ot_pdu": "unmapped.ot.pdu_type", "ot_address": "unmapped.ot.address", "ot_sector": "unmapped.ot.sector",
    "ot_server": "unmapped.ot.server_id", "ot_node": "unmapped.ot.node_id", "ot_config": "unmapped.ot.is_config_node",
    "operation": "api.operation", "forwards_external": "unmapped.m365.inbox_rule.forwards_external",
    "email_macro": "unmapped.email.has_macro_attachment", "email_delivered": "unmapped.email.delivered",
    "launch_suspicious": "unmapped.process_launch.suspicious",
    "service_suspicious": "unmapped.service.suspicious_path",
    "lsass_suspicious": "unmapped.lsass_access_suspicious", "script_suspicious": "unmapped.powershell.suspicious",
    "sensitive_attribute": "unmapped.directory.sensitive_attribute", "target_user": "unmapped.target_user.name",
}

BASE_SQL = """base AS (
  SELECT event_id, epoch_us(ts) // 1000 AS t, user_id AS u, event_type AS etype, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS s FROM events)"""

EV_SQL = (BASE_SQL + ",\nev AS (SELECT event_id, t, u, k, s, etype, value, "
          + ", ".join(f"{sql} AS {name}" for name, sql in FLAT.items()) + " FROM base)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold UTC times without a zone
    # The JVM never compiles a method of over 8,000 bytes of code: wide projections run as many small methods instead.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, t, u, etype, value, k, s) of the events table; t in epoch ms."""
    return typed(table(spark, sf_dir, "events"))


def typed(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "event_id", epoch_ms_of(F.col("ts")).alias("t"), F.col("user_id").alias("u"),
        F.col("event_type").alias("etype"), "value", k.alias("k"), (k % 20).alias("s"))


def flattened(base: DataFrame) -> DataFrame:
    return base.selectExpr("*", *[f"{sql} AS {name}" for name, sql in FLAT.items()])


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flattened(base_events(spark, sf_dir))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by a key. The number of file splits says nothing of where rows lie: a file of one row group is read by one task,
    however often it is split. The rows are narrow and what follows is not, so they are always dealt."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()), key)


def spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`base_events`, dealt out over all cores before anything is computed."""
    return typed(spread(table(spark, sf_dir, "events"), "event_id"))


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as rows of the event schema."""
    return as_security(spread_events(spark, sf_dir))


def as_security(base: DataFrame) -> DataFrame:
    """Rows of :func:`base_events`, in a table or a stream, as rows of the event schema."""
    leaves = {path: F.col(name) for name, path in PATHS.items()}
    leaves |= identity_leaves(F.col("class_uid"), F.col("activity_id"))
    leaves |= {
        "time": F.col("t"),
        "unmapped.ids.engine": F.when(F.col("s") == 7, "suricata"),
        "unmapped.suricata.flow.bytes_toserver": F.when(F.col("source_type") == "suricata_eve", F.col("bytes_out")),
        "unmapped.zeek.conn.orig_bytes": F.when(F.col("source_type") == "zeek_json", F.col("bytes_out")),
    }
    return assemble(flattened(base), leaves)
