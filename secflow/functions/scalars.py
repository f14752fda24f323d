"""Scalar column functions: time, network, identity, hashing, labels."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.functions.predicates import closed, is_ipv4

# Limits the results depend on.
FUTURE_SKEW_MS = 300_000
CLAMP_SKEW_MS = 600_000
FILETIME_EPOCH_MS = 11_644_473_600_000
ENTITY_VALUE_BYTES = 448
DAY_MS = 86_400_000

# Outcome words.
SUCCESS_WORDS = ("success", "succeeded", "succeed", "ok", "true", "allow", "allowed", "pass", "passed",
                 "complete", "completed", "granted", "200", "201", "204")
FAILURE_WORDS = ("failure", "failed", "fail", "error", "denied", "deny", "false", "invalid", "unauthorized",
                 "forbidden", "reject", "rejected", "401", "403", "500", "blocked", "block", "drop", "dropped")

# Second-level labels under which a country domain registers names.
GENERIC_LABELS = ("com", "net", "org", "gov", "edu")
CC_SECOND_LEVEL = {
    "uk": ("co", "org", "net", "gov", "ac", "ltd", "plc", "sch", "me", "nhs", "police"),
    "au": ("com", "net", "org", "edu", "gov", "id", "asn"),
    "nz": ("co", "org", "net", "ac", "govt", "school"),
    "jp": ("co", "ne", "or", "go", "ac", "ad", "gr", "lg", "ed"),
    "kr": ("co", "ne", "or", "go", "ac", "re", "pe"),
    "in": ("co", "net", "org", "gov", "ac", "edu", "res", "nic"),
    "za": ("co", "org", "net", "gov", "ac", "edu"),
    "il": ("co", "org", "net", "ac", "gov"),
    "id": ("co", "ac", "or", "go", "net", "web"),
    "th": ("co", "ac", "or", "go", "net", "in"),
    "ke": ("co", "or", "ac", "go", "ne"),
    "br": (*GENERIC_LABELS, "mil"),
    "mx": (*GENERIC_LABELS, "gob"),
    "ar": (*GENERIC_LABELS, "gob"),
    "tw": (*GENERIC_LABELS, "idv"),
    "cn": (*GENERIC_LABELS, "ac"),
    "fr": ("gouv", "asso"),
}
GENERIC_CCS = ("tr", "hk", "sg", "my", "ph", "pk", "ng", "eg", "sa", "ua", "vn", "pe", "ve", "uy", "ec", "co",
               "bd", "lk", "np", "kw", "qa", "om", "bh", "jo", "lb")


# ---- time --------------------------------------------------------------------------------------

def epoch_ms_of(ts: Column) -> Column:
    """Timestamp column (with or without zone; session zone UTC) as epoch ms, fraction floored."""
    return F.unix_millis(ts.cast("timestamp"))


def magnitude_ms(value: Column) -> Column:
    """Number of unknown unit as epoch ms: seconds, milliseconds or Windows file time by size."""
    v = value.try_cast("double")
    return (F.when(v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf")), None)
            .when(v < 1e12, (v * 1000).cast("bigint"))
            .when(v < 1e14, v.cast("bigint"))
            .when(v < 1e20, F.floor(v / 10000).cast("bigint") - FILETIME_EPOCH_MS))


def coerce_ms(text: Column) -> Column:
    """Number text or ISO date text as epoch ms, null when it is neither. ISO without zone is UTC."""
    s = F.trim(text.cast("string"))
    numeric = s.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    iso = F.when(s.rlike(r"\A\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(s))
    return F.when(numeric, magnitude_ms(s)).otherwise(F.unix_millis(iso))


def valid_time(ms: Column, now_ms: Column | int) -> Column:
    """``ms`` unless it lies more than the skew limit after ``now_ms``."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return F.when(ms <= now + FUTURE_SKEW_MS, ms)


def window_time(time_ms: Column, received_ms: Column, window_ms: int, mode: str = "clamp",
                periodic: bool = False) -> Column:
    """The clock that drives a window: the record's time unless receipt time contradicts it."""
    if periodic or mode == "event":
        return time_ms
    if mode == "ingest":
        return F.coalesce(received_ms, time_ms)
    limit = min(CLAMP_SKEW_MS, window_ms // 2)
    return F.when(F.abs(time_ms - received_ms) > limit, received_ms).otherwise(time_ms)


def day_of(ms: Column) -> Column:
    """UTC calendar day; values too small to be ms are read as seconds."""
    millis = F.when(F.abs(ms) < 100_000_000_000, ms * 1000).otherwise(ms)
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd")


def bucket(ms: Column, width_ms: int) -> Column:
    return F.floor(ms / F.lit(width_ms)).cast("bigint")


# ---- text and network --------------------------------------------------------------------------

def strip_control(text: Column) -> Column:
    """Free text without terminal escapes, control characters (tab stays) and the RTL override."""
    out = F.regexp_replace(text, "\\x1b\\][^\\x07\\x1b]*(\\x07|\\x1b\\\\)?", "")
    out = F.regexp_replace(out, "\\x1b\\[[0-?]*[ -/]*[@-~]", "")
    out = F.regexp_replace(out, "\\x1b.", "")
    return F.regexp_replace(out, "[\\x00-\\x08\\x0a-\\x1f\\x7f\\x80-\\x9f\\u202e]", "")


def non_empty(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) > 0, text)


@F.pandas_udf(T.StringType())
def _ipv6_text(values: pd.Series) -> pd.Series:
    """Canonical text of IPv6 spellings; null for text that is no address."""
    import ipaddress

    def one(text):
        try:
            addr = ipaddress.ip_address(text.partition("%")[0])
        except ValueError:
            return None
        mapped = getattr(addr, "ipv4_mapped", None)
        return str(mapped or addr)

    table = {v: one(v) for v in values.dropna().unique()}
    return pd.Series([table.get(v) for v in values], dtype=object)


def valid_ip(text: Column) -> Column:
    """IPv4 text as it is, null for anything else but IPv6-looking text, which is lower-cased.

    Native expressions only. ``canonical_ip`` adds the full IPv6 spelling rules.
    """
    s = F.trim(text)
    v6 = F.lower(F.regexp_replace(s, "%.*$", ""))
    return F.when(is_ipv4(s), s).when(closed(v6.rlike(r"\A[0-9a-f:.]*:[0-9a-f:.]*:[0-9a-f:.]*\z")), v6)


def canonical_ip(text: Column) -> Column:
    """One spelling per address: v4 stays native, only IPv6 text goes through the Arrow function."""
    s = F.trim(text)
    return F.when(is_ipv4(s), s).otherwise(_ipv6_text(F.when(F.contains(s, F.lit(":")), s)))


def valid_mac(text: Column) -> Column:
    s = F.lower(F.trim(text))
    return F.when(closed(s.rlike(r"\A[0-9a-f]{2}([:-][0-9a-f]{2}){5}\z")), F.replace(s, F.lit("-"), F.lit(":")))


def valid_port(number: Column) -> Column:
    n = number.try_cast("int")
    return F.when(n.between(0, 65535), n)


def parent_domain(name: Column) -> Column:
    """The registered domain of a queried name; null for addresses, reverse zones and bare labels."""
    n = F.lower(F.regexp_replace(F.trim(name), r"\.+\z", ""))
    labels = F.split(n, r"\.")
    # Labels hold no dot, so the last two joined by one name a registry's suffix: one look-up in a set.
    suffixes = [f"{g}.{cc}" for cc in GENERIC_CCS for g in GENERIC_LABELS] + [f"{g}.{cc}" for cc, gs in CC_SECOND_LEVEL.items() for g in gs]
    registry = F.array_join(F.slice(labels, -2, 2), ".").isin(suffixes)
    last = F.when((F.size(labels) >= 3) & registry, 3).otherwise(2)
    usable = ((F.length(n) > 0) & (F.length(n) <= 253) & ~is_ipv4(n) & ~F.contains(n, F.lit(":"))
              & ~n.endswith(".in-addr.arpa") & ~n.endswith(".ip6.arpa")
              & (F.size(labels) >= 2) & ~F.array_contains(labels, ""))
    return F.when(usable, F.array_join(F.slice(labels, -last, last), "."))


def outcome(value: Column, default: str = "Success") -> Column:
    """Success / Failure from a boolean, an HTTP-like number or a word (all given as text)."""
    s = F.lower(F.trim(value))
    n = s.try_cast("double")
    return (F.when(s.isNull(), default)
            .when(s.isin(*SUCCESS_WORDS), "Success").when(s.isin(*FAILURE_WORDS), "Failure")
            .when(n.isNull() | F.isnan(n), default)
            .when((n >= 200) & (n < 400), "Success").when((n >= 400) & (n < 600), "Failure")
            .when(n.cast("bigint") != 0, "Success").otherwise("Failure"))


# ---- identity and hashing ----------------------------------------------------------------------

def fold_account(name: Column) -> Column:
    """Trimmed, case-folded account. ``lower`` plus the one multi-letter fold that occurs in names."""
    return F.replace(F.lower(F.trim(name)), F.lit("ß"), F.lit("ss"))


def account_realm(folded: Column) -> Column:
    """struct(realm, name) of ``REALM\\name``, ``name@realm`` or a bare name (realm '')."""
    has_slash, has_at = F.contains(folded, F.lit("\\")), F.contains(folded, F.lit("@"))
    slash_realm = F.substring_index(folded, "\\", 1)
    slash_name = F.substr(folded, F.length(slash_realm) + 2, F.length(folded))
    at_realm = F.substring_index(folded, "@", -1)
    at_name = F.substr(folded, F.lit(1), F.greatest(F.length(folded) - F.length(at_realm) - 1, F.lit(0)))
    return F.struct(
        F.when(has_slash, slash_realm).when(has_at, at_realm).otherwise("").alias("realm"),
        F.when(has_slash, slash_name).when(has_at, at_name).otherwise(folded).alias("name"))


def canonical_entity(kind: Column, value: Column) -> Column:
    """Canonical value of an actor, ip or device; null when there is none."""
    return (F.when(kind == "ip", F.lower(valid_ip(value)))
            .when(kind == "actor", fold_account(value))
            .when(kind == "device", F.lower(F.trim(value))))


def entity_id(tenant: Column, kind: Column, canonical: Column) -> Column:
    """sha256 of ``tenant|kind|value``; null without a value (concat_ws would skip it)."""
    return F.when(canonical.isNotNull() & tenant.isNotNull(),
                  F.sha2(F.concat(tenant, F.lit("|"), kind, F.lit("|"), canonical), 256))


def bounded(text: Column, max_bytes: int = ENTITY_VALUE_BYTES) -> Column:
    """Long values cut to ``max_bytes`` with a digest tail, so two long values stay distinct."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), 1, max_bytes - 17), "UTF-8")
    return F.when(F.octet_length(text) > max_bytes,
                  F.concat(head, F.lit(":"), F.substring(F.sha2(text, 256), 1, 16))).otherwise(text)


def member_id(alert_id: Column, time_ms: Column, rule_id: Column, event_ids: Column) -> Column:
    """The alert's id, or a replay-stable stand-in built from what it carries."""
    parts = F.concat_ws(":", time_ms.cast("string"), rule_id,
                        F.when(F.size(event_ids) > 0, F.array_join(event_ids, "|")))
    return F.coalesce(F.when(alert_id != "", alert_id), F.concat(F.lit("anon:"), parts))


def alert_key(rule: Column, tenant: Column, group: Column, time_ms: Column, window_ms: Column | int) -> Column:
    """``rule:tenant:len(group):group:bucket``: one id per rule, group and window-wide bucket."""
    width = window_ms if isinstance(window_ms, Column) else F.lit(window_ms)
    return F.concat_ws(":", rule, tenant, F.length(group).cast("string"), group,
                       F.floor(time_ms / width).cast("bigint").cast("string"))


# Spellings of "no value" in key fields.
NONE_WORDS = ("", "-", "{}", "null", "none")


def _key_text(raw: Column) -> Column:
    s = F.trim(raw)
    bare = F.lower(F.regexp_replace(s, r"\A\{+|\}+\z", ""))
    return F.when(~F.lower(s).isin(*NONE_WORDS) & ~s.rlike(r"\A(0[xX])?0+\z")
                  & (bare != "00000000-0000-0000-0000-000000000000"), s)


def canon_guid(raw: Column) -> Column:
    s = F.lower(F.trim(F.regexp_replace(_key_text(raw), r"\A\{+|\}+\z", "")))
    dashed = F.regexp_replace(s, r"\A([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})\z",
                              "$1-$2-$3-$4-$5")
    return F.when(dashed.rlike(r"\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z")
                  & ~dashed.rlike(r"\A[0-]+\z"), dashed)


def canon_logon_id(raw: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(_key_text(raw)), r"\A0x", ""), r"\A0+", "")
    return F.when(s.rlike(r"\A[0-9a-f]+\z"), s)


def canon_flow_id(raw: Column) -> Column:
    return _key_text(raw)


canon_agent_session = canon_flow_id

CANON = {"proc": canon_guid, "logon": canon_logon_id, "flow": canon_flow_id, "agent": canon_agent_session}


def key_hash(tenant: Column, ns: str, sender: Column, scope: Column, raw: Column) -> Column:
    """16 hex of sha256 over a JSON array, which no field content can forge; null without a value."""
    value = CANON[ns](raw)
    parts = F.array(tenant, F.lit(ns), F.coalesce(sender, F.lit("")), F.coalesce(scope, F.lit("")), value)
    return F.when(value.isNotNull(), F.substring(F.sha2(F.to_json(parts), 256), 1, 16))


# ---- labels ------------------------------------------------------------------------------------

def match_level(label: Column, rule: Column) -> Column:
    """exact / family / none between two technique ids (sub-techniques share the part before the dot)."""
    a, b = F.upper(F.trim(label)), F.upper(F.trim(rule))
    known = a.rlike(r"\AT\d{4}(\.\d{3})?\z") & b.rlike(r"\AT\d{4}(\.\d{3})?\z")
    family = F.substring_index(a, ".", 1) == F.substring_index(b, ".", 1)
    return F.when(known & (a == b), "exact").when(known & family, "family").otherwise("none")


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): Wilson score interval of k of n, null for n = 0."""
    n_d = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n_d
    denom = 1 + z * z / n_d
    centre = (p + z * z / (2 * n_d)) / denom
    half = z * F.sqrt(p * (1 - p) / n_d + z * z / (4 * n_d * n_d)) / denom
    known = n > 0
    return F.struct(F.when(known, F.greatest(centre - half, F.lit(0.0))).alias("low"),
                    F.when(known, F.least(centre + half, F.lit(1.0))).alias("high"))


# Event class to label.
CLASS_LABEL = {1001: "file", 1002: "process", 3002: "authentication", 3003: "account_change", 4001: "network",
               4002: "web_dns", 4009: "email", 6003: "api", 6005: "datastore"}


def light_label(class_uid: Column, severity: Column, score: Column) -> Column:
    """struct(category, priority, confidence) without a model call."""
    sev, sc = F.coalesce(severity, F.lit(0)), F.coalesce(score, F.lit(0))
    category = reduce(lambda acc, kv: acc.when(class_uid == kv[0], kv[1]), CLASS_LABEL.items(),
                      F.when(F.lit(False), "")).otherwise("other")
    priority = (F.when((sc >= 60) | (sev >= 5), "high").when((sc >= 40) | (sev == 4), "medium").otherwise("low"))
    confidence = F.round(F.least(F.lit(1.0), 0.5 + sev / 12 + sc / 200), 2)
    return F.struct(category.alias("category"), priority.alias("priority"), confidence.alias("confidence"))


# Closed verdict and level sets.
VERDICTS = ("benign", "suspicious", "malicious", "unknown")
LEVELS = ("low", "medium", "high", "critical")


def normalise_verdict(verdict: Column, level: Column, summary: Column) -> Column:
    """Free verdict text reduced to the closed sets; anything else becomes the safe default."""
    v, lv = F.lower(F.trim(verdict)), F.lower(F.trim(level))
    v_ok, l_ok = closed(v.isin(*VERDICTS)), closed(lv.isin(*LEVELS))
    return F.struct(F.when(v_ok, v).otherwise("unknown").alias("verdict"),
                    F.when(l_ok, lv).otherwise("low").alias("level"),
                    F.coalesce(summary, F.lit("")).alias("summary"),
                    (~v_ok | ~l_ok).alias("out_of_set"))
