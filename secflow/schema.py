"""Row types of the bronze, silver and gold tables."""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql.types import _parse_datatype_string as ddl

RAW_META = ("struct<ip:string,mac:string,received_at:bigint,ingest_id:string,tenant_id:string,trace_id:string,"
            "shipper:string,shipper_ip:string,source:string,sector:string,change_ticket_id:string>")

RAW = f"source_type string, raw string, meta {RAW_META}"

ENDPOINT = ("struct<ip:string,mac:string,hostname:string,port:int,"
            "location:struct<country:string,source:string>,"
            "reputation:struct<score:int,categories:array<string>,source:string>>")

# The open tail of an event. Every part a source job fills has a typed struct here, so Parquet
# prunes to the single leaf a rule reads.
UNMAPPED = {
    "mcp": ("struct<session_id:string,server:string,credential_path_access:boolean,injection_indicator:boolean,"
            "destructive_command_indicator:boolean,is_egress_call:boolean,egress_domain:string>"),
    "db": "struct<object:string>",
    "cloud": "struct<identity_type:string,mfa_used:string,event_source:string>",
    "k8s": "struct<namespace:string,resource:string,verb:string,is_privileged:boolean>",
    "dns": "struct<parent_domain:string,qtype:string,rcode:string,answers:array<string>,tx_id:bigint>",
    "ids": ("struct<engine:string,signature:string,signature_id:bigint,category:string,severity:int,"
            "action:string,flow_id:bigint>"),
    "suricata": ("struct<flow:struct<proto:string,app_proto:string,state:string,bytes_toserver:bigint,"
                 "bytes_toclient:bigint,flow_id:bigint>>"),
    "zeek": ("struct<conn:struct<uid:string,proto:string,service:string,conn_state:string,duration_seconds:double,"
             "orig_bytes:bigint,resp_bytes:bigint>,notice:struct<note:string,sub:string,uid:string>>"),
    "ot": ("struct<protocol:string,function_code:int,function_name:string,pdu_type:string,address:int,unit_id:int,"
           "anomaly_type:string,change_ticket_id:string,server_id:string,node_id:string,is_config_node:boolean,"
           "sector:string,device_type:string,event_type:string>"),
    "email": ("struct<verdict:string,direction:string,sender:string,sender_domain:string,recipients:array<string>,"
              "subject:string,attachments:array<struct<name:string,extension:string,macro_capable:boolean>>,"
              "has_macro_attachment:boolean,delivered:boolean>"),
    "m365": ("struct<workload:string,operation:string,inbox_rule:struct<name:string,forward_to:array<string>,"
             "forwards_external:boolean,hides_mail:boolean>>"),
    "n8n": "struct<workflow_id:string,webhook_path:string>",
    "process_launch": "struct<parent:string,child:string,command_line:string,suspicious:boolean>",
    "powershell": "struct<script:string,suspicious:boolean,indicators:array<string>>",
    "service": "struct<name:string,path:string,suspicious_path:boolean>",
    "directory": ("struct<object_dn:string,object_class:string,attribute:string,value:string,operation:string,"
                  "sensitive_attribute:boolean>"),
    "target_user": "struct<name:string,domain:string,uid:string>",
    "logon_status": "struct<status:string,sub_status:string,failure_reason:string>",
    "file": "struct<path:string>",
    "lsass_access_suspicious": "boolean",
}

EVENT = (
    "metadata struct<version:string,product:struct<name:string,vendor_name:string>,logged_time:bigint,"
    "original_format:string>,"
    "class_uid int, category_uid int, activity_id int, type_uid int, severity_id int, time bigint,"
    "message string, status string,"
    f"src_endpoint {ENDPOINT}, dst_endpoint {ENDPOINT},"
    "actor struct<user:struct<name:string,uid:string,domain:string>,"
    "process:struct<name:string,pid:bigint,uid:string,parent_process:struct<uid:string,pid:bigint,name:string>>,"
    "session:struct<uid:string>>,"
    "api struct<operation:string,request:struct<data:string>>,"
    "connection_info struct<uid:string>,"
    "siem struct<sector:string,source_type:string,ingest_id:string,tenant:string,trace_id:string,score:int,"
    "received_ms:bigint,clock_skew_ms:bigint,time_clamped:boolean,"
    "key_scope:struct<host:string,sensor:string,boot:string>,sender:struct<ip:string,source:string>>,"
    "unmapped struct<" + ",".join(f"{k}:{v}" for k, v in UNMAPPED.items()) + ">"
)

EVENT_CLASSES = (1001, 1002, 3002, 3003, 4001, 4002, 4009, 6003, 6005)

ALERT = (
    "alert_id string, time bigint, rule_id string, rule_title string, level string, score int, sector string,"
    "mitre struct<framework:string,tactic:string,technique:string>, tenant_id string,"
    f"src_endpoint {ENDPOINT}, dst_endpoint {ENDPOINT},"
    "actor struct<user:struct<name:string,uid:string,domain:string>>,"
    "event_ids array<string>, event_ids_omitted bigint, trigger_event_id string,"
    "triage struct<status:string,note:string>,"
    "causal_keys array<struct<ns:string,role:string,h:string,scope_trust:string>>"
)


def event_schema() -> T.StructType:
    return ddl(EVENT)


def raw_schema() -> T.StructType:
    return ddl(RAW)


def alert_schema() -> T.StructType:
    return ddl(ALERT)
