"""Bronze to silver: route, parse, sanitise, stamp, validate; the rest goes to dead letter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.functions import scalars as S
from secflow.functions.predicates import closed
from secflow.normalize import json_sources as J
from secflow.normalize import sources as X
from secflow.normalize.assemble import assemble, identity_leaves
from secflow.normalize.enrich import enrich
from secflow.normalize.sources import Source
from secflow.operators import sets
from secflow.schema import EVENT_CLASSES
from secflow.session import staged

SOURCES: dict[str, Source] = {s.name: s for s in (
    Source("cisco_asa", "common", "syslog", ("ASA", "Cisco"), X.cisco_asa),
    Source("linux_ssh", "common", "syslog", ("OpenSSH", "OpenBSD"), X.linux_ssh),
    Source("generic_syslog", "common", "syslog", ("Generic Syslog", "RFC 3164"), X.generic_syslog),
    Source("cef", "common", "cef", ("CEF appliance", "various"), X.cef),
    Source("dns_query", "common", "syslog", ("dnsmasq", "Simon Kelley"), X.dns_query),
    Source("active_directory", "bank", "winevent", ("Active Directory", "Microsoft"), X.active_directory, X.WIN_SCHEMA),
    Source("windows_eventlog", "common", "winevent", ("Windows Event Log", "Microsoft"), X.windows_eventlog, X.WIN_SCHEMA),
    Source("sysmon", "common", "winevent", ("Sysmon", "Microsoft"), X.sysmon, X.WIN_SCHEMA),
    Source("cloudtrail", "common", "json", ("AWS CloudTrail", "Amazon Web Services"), J.cloudtrail, J.CLOUD_SCHEMA),
    Source("k8s_audit", "datacenter", "json", ("Kubernetes API Server", "CNCF"), J.k8s_audit, J.K8S_SCHEMA),
    Source("vmware_vsphere", "datacenter", "api", ("vSphere", "VMware"), J.vmware_vsphere, J.OP_SCHEMA),
    Source("db_audit", "bank", "json", ("DB Audit", "generic"), J.db_audit, J.OP_SCHEMA),
    Source("mcp_agent", "common", "json", ("MCP Agent Gateway", "generic"), J.mcp_agent, J.AGENT_SCHEMA),
    Source("opcua_audit", "datacenter", "json", ("OPC UA Server", "generic"), J.opcua_audit, J.OPCUA_SCHEMA),
    Source("modbus_anomaly", "datacenter", "api", ("Modbus/TCP tap", "generic"), J.modbus_anomaly, J.MODBUS_SCHEMA),
    Source("inventory_diff", "datacenter", "json", ("Inventory diff", "generic"), J.inventory_diff, J.INVENTORY_SCHEMA),
    Source("n8n_audit", "common", "json", ("n8n", "n8n GmbH"), J.n8n_audit, J.N8N_SCHEMA),
    Source("m365_audit", "common", "json", ("Microsoft 365 Unified Audit Log", "Microsoft"), J.m365_audit, J.M365_SCHEMA),
    Source("mail_gateway", "common", "json", ("Secure Email Gateway", "generic"), J.mail_gateway, J.MAIL_SCHEMA),
    Source("suricata_eve", "common", "json", ("Suricata", "OISF"), J.suricata_eve, J.EVE_SCHEMA),
    Source("zeek_json", "common", "json", ("Zeek", "The Zeek Project"), J.zeek_json, J.ZEEK_SCHEMA),
)}
SKEW_FLAG_MS = 300_000
SECTORS = ("bank", "datacenter", "common")
# Operation words that only one of the two operation-log sources uses.
DB_ONLY = ("grant", "revoke", "alter", "select", "insert", "drop", "query")
VM_ONLY = ("deploy", "read", "get", "reconfig", "destroy", "remove", "create", "clone", "migrate", "poweron", "poweroff")
EVE_TYPES = ("alert", "flow", "dns", "modbus", "dnp3", "http", "tls", "fileinfo", "ssh", "smb", "stats", "netflow", "anomaly")


#: Top-level keys that routing looks at.
ROUTE_KEYS = ("eventType", "event_type", "type", "EventID", "operation", "object", "table", "vm", "target", "createdTime", "tool", "tool_name", "name",
              "arguments", "args", "params", "auditID", "eventName", "eventSource", "eventTime", "Operation", "Workload", "CreationTime", "flow_id",
              "src_ip", "dest_ip", "pcap_cnt", "uid", "id.orig_h", "functionCode", "mac", "sector", "device_type", "workflowId", "webhook", "nodeId",
              "sourceName")


def route_source(raw: Column, keys: str) -> Column:
    """Source type of a record that does not name one, by its keys; null when that is ambiguous. ``keys``: struct column of ROUTE_KEYS by position."""
    value = lambda k: F.col(f"{keys}.k{ROUTE_KEYS.index(k)}")
    has = lambda k: value(k).isNotNull()
    kind = F.coalesce(value("eventType"), value("event_type"), value("type"))
    eid, op = value("EventID").try_cast("int"), F.lower(value("operation"))
    any_of = lambda words: X._any(op, tuple(words))
    db = any_of(DB_ONLY) | has("object") | has("table")
    vm = any_of(VM_ONLY) | closed(F.contains(op, F.lit("."))) | has("vm") | has("target") | has("createdTime")
    structured = (
        F.when((has("tool") | has("tool_name") | has("name")) & (has("arguments") | has("args") | has("params")), "mcp_agent")
        .when(has("auditID"), "k8s_audit").when(has("eventName") & has("eventSource") & has("eventTime"), "cloudtrail")
        .when(has("Operation") & has("Workload") & has("CreationTime"), "m365_audit")
        .when(closed(value("event_type").isin(*EVE_TYPES)) & value("flow_id").try_cast("bigint").isNotNull()
              & (has("src_ip") | has("dest_ip") | has("pcap_cnt")), "suricata_eve")
        .when(has("uid") & has("id.orig_h"), "zeek_json").when(has("functionCode"), "modbus_anomaly")
        .when(has("mac") & has("sector") & has("device_type"), "inventory_diff")
        .when(closed(F.startswith(kind, F.lit("Audit"))), "opcua_audit")
        .when(closed(F.contains(kind, F.lit(".")) | kind.isin("login", "logout")) | (kind.isNotNull() & (has("workflowId") | has("webhook"))), "n8n_audit")
        .when(kind.isNotNull() & (has("nodeId") | has("sourceName")), "opcua_audit").when(F.length(kind) > 0, "n8n_audit")
        .when(eid.isin(4624, 4634, 4647, 4625, 4768, 4771), "active_directory").when(eid.isin(1, 3, 5, 11), "sysmon")
        .when(eid.isNotNull(), "windows_eventlog")
        .when(op.isNotNull() & db & ~vm, "db_audit").when(op.isNotNull() & vm & ~db, "vmware_vsphere"))
    text = (F.when(raw.rlike(r"%ASA-\d-\d+:"), "cisco_asa").when(raw.rlike(r"sshd(-session)?\[\d+\]:|pam_\w+\(sshd:"), "linux_ssh")
            .when(raw.rlike(r"(\A|\s)CEF:\d"), "cef").when(raw.rlike(r"query\[[A-Za-z]+\]\s+\S+\s+from\s"), "dns_query")
            .when(raw.rlike(X.SYSLOG_HEADER), "generic_syslog"))
    return F.when(F.startswith(F.ltrim(raw), F.lit("{")), structured).otherwise(text)


def resolved(bronze: DataFrame) -> DataFrame:
    """Bronze plus ``resolved_source``. A record is parsed once for all keys, and only if routing has to look at it."""
    known = F.when(F.col("source_type").isin(*SOURCES), F.col("source_type"))
    names = [f"k{i}" for i in range(len(ROUTE_KEYS))]
    asked = F.when(known.isNull() & F.startswith(F.ltrim("raw"), F.lit("{")), F.col("raw"))
    parsed = bronze.select(*bronze.columns, F.json_tuple(asked, *ROUTE_KEYS).alias(*names))
    keyed = parsed.select(*bronze.columns, F.struct(*names).alias("_keys"))
    return keyed.withColumn("resolved_source", F.coalesce(known, route_source(F.col("raw"), "_keys"))).drop("_keys")


def normalize_source(bronze: DataFrame, name: str) -> DataFrame:
    """Events of one source, plus ``_raw`` and ``_errors``; records that are not of its kind are null events."""
    src = SOURCES[name]
    # Explode of a one-element array keeps the optimizer from copying the parse into every field.
    rows = bronze.select("*", F.explode(F.array(F.from_json("raw", src.schema))).alias("j")) if src.schema else bronze
    leaves = src.build()
    for step, value in leaves.pop("_let", ()):
        rows = rows.withColumn("_step", value).select(*rows.columns, F.explode(F.array("_step")).alias(step))
    ok, given_id, sector = leaves.pop("_ok"), leaves.pop("_id", None), leaves.pop("_sector", None)
    if src.schema:
        # A failed parse is a struct of nulls: the record itself must be a JSON object.
        ok = ok & F.startswith(F.ltrim("raw"), F.lit("{")) & F.get_json_object("raw", "$").isNotNull()
    # Each leaf is finished before anything reads it: what follows names most of them several times, and so would copy their expressions.
    given = [("_ok", ok)] + [(f"_l{i}", c) for i, c in enumerate(leaves.values())]
    given += [(n, c) for n, c in (("_id", given_id), ("_sector", sector), ("_received", S.magnitude_ms(F.col("meta.received_at")))) if c is not None]
    rows = rows.select("source_type", "raw", "meta", F.explode(F.array(F.struct(*[c.alias(n) for n, c in given]))).alias("_given"))
    rows = rows.select("source_type", "raw", "meta", "_given.*")
    leaves = {path: F.col(f"_l{i}") for i, path in enumerate(leaves)}
    ok, given_id, sector = F.col("_ok"), None if given_id is None else F.col("_id"), None if sector is None else F.col("_sector")
    for side in ("src_endpoint.ip", "dst_endpoint.ip"):
        if side in leaves:
            leaves[side] = S.canonical_ip(leaves[side])
    received = F.col("_received")
    time = F.coalesce(leaves.pop("time", F.lit(None).cast("bigint")), received)
    ids = [S.non_empty(F.col("meta.ingest_id"))] + ([S.non_empty(given_id)] if given_id is not None else [])
    sectors = [F.when(F.col("meta.sector").isin(*SECTORS), F.col("meta.sector"))] + ([sector] if sector is not None else [])
    clean = {p: S.strip_control(leaves[p]) for p in ("message", "actor.user.name", "src_endpoint.hostname", "dst_endpoint.hostname", "api.operation",
                                                     "api.request.data") if p in leaves}
    label = lambda c: S.non_empty(F.trim(S.strip_control(F.col(c))))
    leaves |= clean | identity_leaves(leaves["class_uid"], leaves["activity_id"]) | {
        "metadata.version": F.lit("1.1.0"), "metadata.product.name": F.lit(src.product[0]),
        "metadata.product.vendor_name": F.lit(src.product[1]), "metadata.original_format": F.lit(src.fmt),
        "metadata.logged_time": received, "time": time,
        "siem.sector": F.coalesce(*sectors, F.lit(src.sector)), "siem.source_type": F.lit(name),
        # A record without an id gets one from its content, so a replay does not add events.
        "siem.ingest_id": F.coalesce(*ids, F.sha2(F.concat_ws("|", F.lit(name), F.col("raw")), 256)),
        "siem.tenant": F.coalesce(S.non_empty(F.col("meta.tenant_id")), F.lit("default")),
        "siem.trace_id": F.coalesce(F.col("meta.trace_id"), F.substring(F.sha2("raw", 256), 1, 32)),
        "siem.received_ms": received, "siem.clock_skew_ms": F.when(F.abs(time - received) > SKEW_FLAG_MS, time - received),
        "siem.sender.ip": label("meta.shipper_ip"), "siem.sender.source": label("meta.source"),
    }
    parsed = assemble(rows.withColumn("_parsed", F.coalesce(ok, F.lit(False))).withColumn("_raw", F.struct("source_type", "raw", "meta")),
                      leaves, keep=("_raw", "_parsed"))
    # The same for the event: its checks read finished fields instead of repeating their expressions.
    parsed = parsed.select(F.explode(F.array(F.struct("*"))).alias("e")).select("e.*")
    return parsed.withColumn("_errors", F.when(~F.col("_parsed"), F.array(F.lit("not parsed"))).otherwise(contract_errors())).drop("_parsed")


def contract_errors() -> Column:
    """All breaches of the event contract as texts (empty when valid)."""
    bad = {
        "class_uid": ~closed(F.col("class_uid").isin(*EVENT_CLASSES)), "activity_id": F.col("activity_id").isNull(),
        "type_uid": ~closed(F.col("type_uid") == F.col("class_uid") * 100 + F.col("activity_id")),
        "category_uid": ~closed(F.col("category_uid") == F.floor(F.col("class_uid") / F.lit(1000))),
        "severity_id": ~closed(F.col("severity_id").between(0, 6)), "time": ~closed(F.col("time") > 0),
        "siem.sector": ~closed(F.col("siem.sector").isin(*SECTORS)), "siem.source_type": F.col("siem.source_type").isNull(),
        "siem.ingest_id": F.col("siem.ingest_id").isNull(),
    }
    for side in ("src_endpoint", "dst_endpoint"):
        ip, mac, port = (F.col(f"{side}.{x}") for x in ("ip", "mac", "port"))
        bad[f"{side}.ip"] = ip.isNotNull() & S.valid_ip(ip).isNull()
        bad[f"{side}.mac"] = mac.isNotNull() & S.valid_mac(mac).isNull()
        bad[f"{side}.port"] = port.isNotNull() & ~closed(port.between(0, 65535))
    return F.array_compact(F.array(*[F.when(test, F.lit(f"bad {name}")) for name, test in bad.items()]))


def normalize(bronze: DataFrame, sources: Sequence[str] = tuple(SOURCES), cut: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, dead letter). Routing runs once and lays bronze out by source; each branch then reads its own part.

    Records in envelopes of known shippers go through :func:`unwrap_shipper` before. ``cut`` (``enrich.reference_segments``) adds reputation and country to endpoints."""
    routed = staged(resolved(bronze), "resolved_source")
    branches = sets.union_all([normalize_source(routed.where(F.col("resolved_source") == s), s) for s in sources])
    events = branches.where(F.size("_errors") == 0).drop("_raw", "_errors")
    events = events if cut is None else enrich(events, cut)
    failed = branches.where(F.size("_errors") > 0).select("_raw.*", F.col("_errors").alias("errors"))
    unrouted = (routed.where(~closed(F.col("resolved_source").isin(*sources)))
                .select("source_type", "raw", "meta", F.array(F.lit("ambiguous source")).alias("errors")))
    return events, failed.unionByName(unrouted).withColumn("stage", F.lit("normalize"))


# ---- shipper envelopes -------------------------------------------------------------------------

def unwrap_shipper(bronze: DataFrame) -> DataFrame:
    """Records of known log shippers reshaped to what the source jobs read; others unchanged.

    Winlogbeat nests event data under ``winlog``; Fluent Bit's Windows input keeps it flat beside its
    own field names; journald and container logs wrap a text line.
    """
    raw = F.col("raw")
    js = F.from_json(raw, "struct<`@timestamp`:string,winlog:struct<event_id:string,channel:string,provider_name:string,computer_name:string,"
                          "event_data:map<string,string>>,EventID:string,ProviderName:string,Channel:string,Computer:string,TimeCreated:string,"
                          "StringInserts:array<string>,MESSAGE:string,SYSLOG_IDENTIFIER:string,_HOSTNAME:string,_PID:string,"
                          "__REALTIME_TIMESTAMP:string,log:string,stream:string,time:string>")
    rows = bronze.withColumn("_s", F.when(F.startswith(F.ltrim(raw), F.lit("{")), js))
    head = F.map_filter(F.create_map(
        F.lit("EventID"), F.col("_s.winlog.event_id"), F.lit("Channel"), F.col("_s.winlog.channel"), F.lit("ProviderName"), F.col("_s.winlog.provider_name"),
        F.lit("Computer"), F.col("_s.winlog.computer_name"), F.lit("TimeCreated"), F.col("_s.`@timestamp`")), lambda k, v: v.isNotNull())
    # Event data may repeat a name of the envelope; the envelope's value counts.
    data = F.map_filter(F.coalesce(F.col("_s.winlog.event_data"), F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(head, k))
    beat = F.to_json(F.map_concat(data, head))
    stamp = F.date_format(F.timestamp_micros(F.col("_s.__REALTIME_TIMESTAMP").try_cast("bigint")), "MMM d HH:mm:ss")
    journal = F.concat(stamp, F.lit(" "), F.coalesce("_s._HOSTNAME", F.lit("localhost")), F.lit(" "), F.col("_s.SYSLOG_IDENTIFIER"),
                       F.coalesce(F.concat(F.lit("["), F.col("_s._PID"), F.lit("]")), F.lit("")), F.lit(": "), F.col("_s.MESSAGE"))
    docker = F.regexp_replace("_s.log", r"\n\z", "")
    reshaped = (F.when(F.col("_s.winlog.event_id").isNotNull(), beat)
                .when(F.col("_s.MESSAGE").isNotNull() & F.col("_s.SYSLOG_IDENTIFIER").isNotNull(), journal)
                .when(F.col("_s.log").isNotNull() & F.col("_s.stream").isNotNull(), docker))
    return rows.withColumn("raw", F.coalesce(reshaped, raw)).drop("_s")
