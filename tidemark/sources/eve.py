"""EVE JSON (one object per line, tagged by event_type) as normalized events, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.zeek import as_events

SCHEMA = """timestamp string, flow_id bigint, event_type string, src_ip string, src_port int, dest_ip string, dest_port int, proto string, app_proto string,
flow struct<pkts_toserver: bigint, pkts_toclient: bigint, bytes_toserver: bigint, bytes_toclient: bigint, age: bigint, state: string>,
alert struct<action: string, category: string, signature: string, gid: int, rev: int, severity: int, signature_id: int>,
dns struct<id: int, rrname: string, rrtype: string, rcode: string, answers: array<struct<rdata: string>>, grouped: map<string, array<string>>>,
tls struct<version: string, sni: string, subject: string, issuerdn: string, ja3: string, ja3s: string>,
http struct<http_method: string, hostname: string, url: string, http_user_agent: string, status: int, length: bigint>,
_corrupt string"""
_TYPES = {"flow": "connection", "alert": "alert", "dns": "dns", "tls": "tls", "http": "http"}


def epoch_seconds(text: Column) -> Column:
    """ISO-8601 (zone with or without colon) or a number; null where it is neither, never the present."""
    iso = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.coalesce(F.unix_micros(F.try_to_timestamp(iso)) / 1_000_000, text.try_cast("double"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Raw records; a line that is no object keeps its text in _corrupt."""
    return spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_trigger).json(path)


def events(raw: DataFrame) -> DataFrame:
    """Normalized events of the known types with a readable time; see rejects() for the rest."""
    c = F.col
    table = F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])
    kind = F.try_element_at(table, c("event_type"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    answers = F.coalesce(F.transform("dns.answers", lambda a: a["rdata"]), F.flatten(F.map_values("dns.grouped")))
    when = lambda k, x: F.when(c("kind") == k, x)
    fingerprint = lambda n: F.when(c(n).startswith("{"), F.get_json_object(n, "$.hash")).otherwise(c(n))
    rows = raw.where(c("_corrupt").isNull()).select(
        "*", c("flow_id").alias("raw_flow"), epoch_seconds(c("timestamp")).alias("ts"), kind.alias("kind")
    ).where("ts is not null and kind is not null")
    out = rows.select(
        "ts",
        c("kind").alias("event_type"),
        F.lit("suricata").alias("source_engine"),
        F.coalesce("src_ip", F.lit("0.0.0.0")).alias("src_ip"),
        F.coalesce("dest_ip", F.lit("0.0.0.0")).alias("dst_ip"),
        zero(c("src_port")).alias("src_port"),
        zero(c("dest_port")).alias("dst_port"),
        F.upper(F.coalesce("proto", F.lit("TCP"))).alias("protocol"),
        zero(c("flow.age")).cast("double").alias("duration"),
        zero(c("flow.bytes_toserver")).alias("orig_bytes"),
        zero(c("flow.bytes_toclient")).alias("resp_bytes"),
        zero(c("flow.pkts_toserver")).alias("orig_pkts"),
        zero(c("flow.pkts_toclient")).alias("resp_pkts"),
        c("flow.state").alias("conn_state"),
        c("app_proto").alias("service"),
        F.coalesce("dns.rrname", "tls.sni", "http.hostname").alias("query_name"),
        c("dns.rrtype").alias("query_type"),
        answers.alias("answers"),
        c("tls.version").alias("tls_version"),
        fingerprint("tls.ja3").alias("ja3"),
        fingerprint("tls.ja3s").alias("ja3s"),
        c("tls.subject").alias("subject"),
        c("tls.issuerdn").alias("issuer"),
        when("http", F.upper(F.coalesce("http.http_method", F.lit("GET")))).alias("http_method"),
        when("http", F.coalesce("http.url", F.lit("/"))).alias("uri"),
        c("http.http_user_agent").alias("user_agent"),
        when("http", F.coalesce("http.status", F.lit(200))).alias("status_code"),
        when("http", zero(c("http.length"))).alias("request_body_len"),
        when("alert", F.coalesce("alert.signature", F.lit("Unknown Signature"))).alias("signature"),
        when("alert", F.coalesce("alert.severity", F.lit(3))).alias("severity"),
        when("alert", F.coalesce("alert.category", F.lit("Security Threat"))).alias("category"),
        when("alert", F.coalesce("alert.action", F.lit("allowed"))).alias("action"),
        when("alert", zero(c("alert.signature_id"))).alias("signature_id"),
        when("alert", F.coalesce("alert.gid", F.lit(1))).alias("gid"),
        when("alert", F.coalesce("alert.rev", F.lit(1))).alias("rev"),
        F.concat_ws(
            "_", "kind", F.coalesce(c("raw_flow").cast("string"), F.lit("0")),
            when("alert", zero(c("alert.signature_id")).cast("string"))
        ).alias("source_id"),
    )
    return as_events(out)


def rejects(raw: DataFrame) -> DataFrame:
    """Records that events() leaves out, with the reason."""
    reason = F.when(F.col("_corrupt").isNotNull(), "json_syntax").when(epoch_seconds(F.col("timestamp")).isNull(), "bad_ts").when(
        ~F.coalesce(F.col("event_type").isin(*_TYPES), F.lit(False)), "unknown_type"
    )
    return raw.select("*", reason.alias("reason")).where("reason is not null")


def of_packets(packets: DataFrame, first: int = 50) -> DataFrame:
    """EVE flow records (column value) of the `first` packets in order of time: one per packet, as a sensor's first look."""
    c = F.col
    when = F.date_format(F.timestamp_micros(F.floor(c("ts") * 1_000_000 + 0.5)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    app = F.when(c("dns_query").isNotNull(), "dns").when(c("sni").isNotNull(), "tls").otherwise("failed")
    flow = F.struct(
        F.lit(1).alias("pkts_toserver"), F.lit(0).alias("pkts_toclient"), c("wire_len").alias("bytes_toserver"),
        F.lit(0).alias("bytes_toclient"), F.lit(1).alias("age"), F.lit("established").alias("state")
    )
    rows = packets.orderBy("ts", "src_ip", "src_port", "dst_ip", "dst_port").limit(first)
    record = F.struct(
        when.alias("timestamp"), F.lit("flow").alias("event_type"), "src_ip", "src_port", c("dst_ip").alias("dest_ip"),
        c("dst_port").alias("dest_port"), c("protocol").alias("proto"), app.alias("app_proto"), flow.alias("flow")
    )
    return rows.select(F.to_json(record).alias("value"))


def to_json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text (column value), for text files or a message bus."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
