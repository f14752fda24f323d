"""Readers: each gives bronze rows (source_type, raw, meta) or a typed table, in batch or as a stream."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.normalize.sources import content_id
from secflow.schema import alert_schema, raw_schema

META_FIELDS = ("ip", "mac", "trace_id", "shipper", "shipper_ip", "source", "sector", "change_ticket_id")


def envelope(rows: DataFrame, source_type: Column, raw: Column, received_ms: Column, ingest_id: Column, tenant: Column,
             **given: Column) -> DataFrame:
    fields = [given.get(c, F.lit(None).cast("string")).alias(c) for c in META_FIELDS]
    meta = F.struct(*fields, received_ms.alias("received_at"), ingest_id.alias("ingest_id"), tenant.alias("tenant_id"))
    meta = F.struct(*[meta[c].alias(c) for c in ("ip", "mac", "received_at", "ingest_id", "tenant_id", "trace_id", "shipper", "shipper_ip",
                                                 "source", "sector", "change_ticket_id")])
    return rows.select(source_type.alias("source_type"), raw.alias("raw"), meta.alias("meta"))


def _text(spark: SparkSession, path: str, stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.text(path)


def read_raw_json(spark: SparkSession, path: str, source_type: str | None = None, tenant: str = "default", received_ms: int | None = None, stream: bool = False) -> DataFrame:
    """One JSON record (or JSON array of records) per line; a record without an id is named by its content."""
    lines = _text(spark, path, stream).where(F.length(F.trim("value")) > 0)
    # A line that starts like an array and isn't one stays a record, so that it reaches the dead letter.
    many = F.when(F.startswith(F.ltrim("value"), F.lit("[")) & F.get_json_object("value", "$").isNotNull(), F.from_json("value", "array<string>"))
    one = lines.select(F.explode(F.coalesce(many, F.array("value"))).alias("raw"))
    ident = F.coalesce(F.get_json_object("raw", "$.ingest_id"), content_id(F.col("raw")))
    return envelope(one, F.lit(source_type).cast("string"), F.col("raw"), F.lit(received_ms).cast("bigint"), ident, F.lit(tenant))


def read_syslog(spark: SparkSession, path: str, source_type: str | None = None, tenant: str = "default", received_ms: int | None = None, stream: bool = False) -> DataFrame:
    lines = _text(spark, path, stream).where(F.length(F.trim("value")) > 0)
    return envelope(lines, F.lit(source_type).cast("string"), F.col("value"), F.lit(received_ms).cast("bigint"), content_id(F.col("value")), F.lit(tenant))


def read_bronze(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(raw_schema()).parquet(path)


def read_flows(spark: SparkSession, path: str, tenant: str = "default") -> DataFrame:
    """Decoded flow rows as records; ``partition_key`` is the source address."""
    rows = spark.read.text(path)
    return envelope(rows, F.lit("netflow"), F.col("value"), F.lit(None).cast("bigint"), content_id(F.col("value")), F.lit(tenant),
                    ip=F.get_json_object("value", "$.src_ip")).withColumn("partition_key", F.col("meta.ip"))


# Object ids of name and hardware address in a device poll.
OID_NAME, OID_MAC = "1.3.6.1.2.1.1.5.0", "1.3.6.1.2.1.2.2.1.6.1"


def read_device_polls(spark: SparkSession, path: str) -> DataFrame:
    """(ip, oids map, mac, hostname, seen_at) per poll: an asset observation."""
    rows = spark.read.schema("ip string, oids map<string,string>, polled_at string").json(path)
    return rows.select("ip", "oids", F.try_element_at("oids", F.lit(OID_MAC)).alias("mac"), F.try_element_at("oids", F.lit(OID_NAME)).alias("hostname"),
                       F.col("polled_at").alias("seen_at"))


def read_winevent_xml(spark: SparkSession, path: str) -> DataFrame:
    """Windows event XML as flat JSON records (System fields plus named Data)."""
    schema = ("System struct<EventID:string,Channel:string,Computer:string,Provider:struct<_Name:string>,TimeCreated:struct<_SystemTime:string>>,"
              "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>")
    rows = spark.read.format("xml").option("rowTag", "Event").schema(schema).load(path)
    named = F.filter("EventData.Data", lambda d: d["_Name"].isNotNull())
    names = F.array_distinct(F.transform(named, lambda d: d["_Name"]))
    # The last of repeated names wins.
    data = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(named, lambda d: d["_Name"] == n), -1)["_VALUE"]))
    data = F.coalesce(data, F.create_map().cast("map<string,string>"))
    system = F.create_map(F.lit("EventID"), F.col("System.EventID"), F.lit("Channel"), F.col("System.Channel"), F.lit("Computer"), F.col("System.Computer"),
                          F.lit("ProviderName"), F.col("System.Provider._Name"), F.lit("TimeCreated"), F.col("System.TimeCreated._SystemTime"))
    return rows.select(F.to_json(F.map_concat(system, F.map_filter(data, lambda k, v: ~k.isin("EventID", "Channel", "Computer", "ProviderName", "TimeCreated")))).alias("raw"))


# Columns of a resolver log without a header line.
ZEEK_DNS_FIELDS = ("ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "trans_id", "rtt", "query")
DNSMASQ_LINE = r"^(\S+ +\S+ +\S+) .*query\[[A-Za-z]+\] (\S+) from (\S+)"
#: Names of the columns of a CSV log, the first that its header has counts.
CSV_NAME = ("qname", "query", "name", "domain")
CSV_TS = ("ts", "time", "timestamp", "@timestamp", "datetime")
CSV_CLIENT = ("id.orig_h", "client", "client_ip", "src", "src_ip", "source", "orig_h")
CSV_CELL = r',(\s*+"[^"]*+(?:""[^"]*+)*+"\s*+(?=,|$)|[^,]*+)'
BIND_LINE = r"^(\S+ \S+) .*client (?:@\S+ )?([^#\s]+)#\d+.*query: (\S+) "


def csv_cells(line: Column) -> Column:
    """The cells of a CSV line, without their quotes."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CSV_CELL), F.lit(1))
    bare = lambda c: F.replace(F.regexp_extract(c, r'(?s)^"(.*)"$', 1), F.lit('""'), F.lit('"'))
    return F.transform(F.transform(cells, lambda c: F.trim(c)), lambda c: F.when(c.rlike(r'(?s)^".*"$'), bare(c)).otherwise(c))


def read_dns_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((ts, name, client), lines of no known form) of resolver logs. Each line is told by its own form, so files
    of five formats may lie together; a ``#fields`` line names the columns of its file, and so does a first line of
    comma-separated names with one of ``CSV_NAME``; time and client are optional there. CSV lines without a header
    are (ts, name, client)."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    v = F.col("value")
    fields = F.split(F.regexp_replace(v, r"^#fields\t", ""), "\t")
    heads = rows.where(F.startswith(v, F.lit("#fields"))).groupBy("file").agg(F.max(fields).alias("fields"))
    some = ~F.startswith(v, F.lit("#")) & (F.length(F.trim(v)) > 0)
    # lines of a block are read in order
    tops = rows.where(some).withColumn("at", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("top"))
    tops = tops.withColumn("columns", F.transform(csv_cells(F.col("top")), lambda c: F.lower(c)))
    tops = tops.where(F.arrays_overlap("columns", F.array(*[F.lit(c) for c in CSV_NAME])))
    lines = rows.where(some).join(heads, "file", "left").join(tops, "file", "left")
    names = F.coalesce("fields", F.array(*[F.lit(c) for c in ZEEK_DNS_FIELDS]))
    cells = F.split(v, "\t")
    cell = lambda c: F.get(cells, F.array_position(names, c).cast("int") - 1)
    group = lambda pattern, i: F.regexp_extract(v, pattern, i)
    csv = csv_cells(v)
    place = lambda c: F.array_position("columns", F.lit(c))
    named = lambda keys: F.get(csv, F.coalesce(*[F.when(place(c) > 0, place(c)) for c in keys]).cast("int") - 1)
    make = lambda ts, name, client: F.struct(ts.alias("ts"), name.alias("name"), client.alias("client"))
    told = (F.when(F.startswith(F.ltrim(v), F.lit("{")), make(*[F.get_json_object(v, f"$.{c}") for c in ("ts", "name", "client")]))
            .when(F.contains(v, F.lit("\t")), make(cell("ts"), cell("query"), cell("id.orig_h")))
            .when(v.rlike(DNSMASQ_LINE), make(*[group(DNSMASQ_LINE, i) for i in (1, 2, 3)]))
            .when(v.rlike(BIND_LINE), make(group(BIND_LINE, 1), group(BIND_LINE, 3), group(BIND_LINE, 2)))
            .when(F.col("columns").isNotNull(), make(named(CSV_TS), named(CSV_NAME), named(CSV_CLIENT)))
            .when(F.size(csv) == 3, make(F.get(csv, F.lit(0)), F.get(csv, F.lit(1)), F.get(csv, F.lit(2)))))
    out = lines.where(~F.coalesce(F.col("columns").isNotNull() & (v == F.col("top")), F.lit(False))).select("value", told.alias("r"))
    good = F.coalesce(F.length("r.name") > 0, F.lit(False))
    header = F.coalesce(F.col("r.name") == "name", F.lit(False)) & F.coalesce(F.col("r.ts") == "ts", F.lit(False))
    return out.where(good & ~header).select("r.*"), out.where(~good).select("value")


def read_dns_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts text, name, client) of resolver logs in any of five formats; warns of lines of no known form, with their number."""
    good, bad = read_dns_lines(spark, path)
    if n := bad.count():
        warnings.warn(f"{n} lines of no known form in {path}", stacklevel=2)
    return good


REFERENCE_DDL = {
    "allowlist": "list string, entry string", "ioc": "ip string, cidr string, score int, categories array<string>", "geo": "cidr string, country string",
    "ot_points": "wire_address int, criticality string", "tenant_rules": "tenant string, rule_id string, state string",
    "realm_alias": "tenant string, grp bigint, pos bigint, spelling string, is_default boolean",
}


def load_reference(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.schema(REFERENCE_DDL[kind]).json(path)


def read_alert_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(alerts, malformed lines) of a JSON-lines dump."""
    schema = alert_schema().add("_bad", "string")
    rows = spark.read.text(path).select("value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("a"))
    bad = F.col("a._bad").isNotNull() | F.col("a").isNull()
    return rows.where(~bad).select("a.*").drop("_bad"), rows.where(bad).select("value")


def read_table(spark: SparkSession, base: str, family: str, tenant: str | None = None, since_day: str | None = None) -> DataFrame:
    """A routed table; family, tenant and day are partition columns, so filters prune folders."""
    rows = spark.read.parquet(base).where(F.col("family") == family)
    if tenant:
        rows = rows.where(F.col("tenant") == tenant)
    return rows.where(F.col("day") >= since_day) if since_day else rows
