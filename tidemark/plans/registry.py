"""Queries of the analytics operators on the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import series, text
from tidemark.operators import alerts, detectors, features, metrics, windows
from tidemark.operators.events import normalize
from tidemark.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_EV = """with ev as (
  select row_id as seq, cast(floor("timestamp" * 1000000 + 0.5) as bigint) as us, lower(event_type) as event_type,
    lower(sensor_id) as sensor_id, src_ip, dst_ip,
    coalesce(src_port, 0) as src_port, coalesce(dst_port, 0) as dst_port, upper(protocol) as protocol, flow_id, coalesce(duration, 0.0) as duration,
    coalesce(orig_bytes, 0) as orig_bytes, coalesce(resp_bytes, 0) as resp_bytes, coalesce(orig_pkts, 0) as orig_pkts, coalesce(resp_pkts,
      0) as resp_pkts,
    upper(conn_state) as conn_state, lower(service) as service, lower(query_name) as query_name
  from (select *, row_number() over (partition by event_id order by row_id) as copy from net_events)
  where (event_id is null or copy = 1) and "timestamp" > 0 and src_ip <> '0.0.0.0' and dst_ip <> '0.0.0.0' and flow_id is not null)
"""


def query(sql: str | None = None):
    """Registers a query under its function's name; {ev} in the SQL stands for the normalized events."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{ev}", _EV.rstrip()) if sql.lstrip().startswith("{ev}") else sql
        return f

    return register


def _ev(spark: SparkSession, folder: str) -> DataFrame:
    return normalize(read_table(spark, folder, "net_events"))


def _vec(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "flow_vectors")


def _port(side: int):
    part = F.split_part(F.col("flow_id"), F.lit(" -> "), F.lit(side + 1))
    return F.regexp_extract(part, r":(\d+)(?: \[\w+\])?$", 1).try_cast("int")


_PORTS = "try_cast(regexp_extract(split_part(flow_id, ' -> ', 1), ':(\\d+)$', 1) as int) as sp, try_cast(regexp_extract(split_part(flow_id, ' -> ', 2), ':(\\d+)( \\[\\w+\\])?$', 1) as int) as dp"


# --- projections, flows -----------------------------------------------------------------------
@query("{ev} select * from ev")
def normalized_events(spark, folder):
    return _ev(spark, folder)


@query("""{ev} select seq, src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port || ' [' || protocol || ']' as flow, md5(flow_id) as flow_hash,
  least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || ' <-> ' || greatest(src_ip || ':' || src_port,
    dst_ip || ':' || dst_port) || ' [' || protocol || ']' as both_ways,
  cast(('0x' || right(md5(flow_id), 1))::int % 8 as bigint) as part from ev""")
def flow_identity(spark, folder):
    c = F.col
    five = (c("src_ip"), c("src_port"), c("dst_ip"), c("dst_port"), c("protocol"))
    return _ev(spark, folder).select(
        "seq", text.flow_id(*five).alias("flow"), F.md5("flow_id").alias("flow_hash"),
        text.both_ways_id(*five).alias("both_ways"), text.md5_partition(c("flow_id"), 8).alias("part")
    )


@query("""{ev} select flow_id, count(*) as n_events, cast(sum(orig_bytes) as bigint) as orig_bytes, cast(sum(resp_bytes) as bigint) as resp_bytes, cast(sum(orig_pkts) as bigint) as orig_pkts, cast(sum(resp_pkts) as bigint) as resp_pkts,
  max(duration) as duration, min(us) as first_us, max(us) as last_us, count(*) filter (conn_state = 'S0') as n_s0,
    count(*) filter (conn_state in ('S0','REJ','RSTO','RSTOS0')) as n_failed from ev group by flow_id""")
def flow_rollup(spark, folder):
    return features.flow_totals(_ev(spark, folder))


@query("""{ev} select src_ip, dst_ip, dst_port, protocol, count(*) as n, arg_min(coalesce(conn_state, '-'), (us, seq)) as first_state, arg_max(coalesce(conn_state, '-'), (us, seq)) as last_state, max(service) as service from ev group by all""")
def connection_summary(spark, folder):
    at = F.struct("us", "seq")
    state = F.coalesce("conn_state", F.lit("-"))
    return _ev(spark, folder).groupBy("src_ip", "dst_ip", "dst_port", "protocol").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(state, at).alias("first_state"), F.max_by(state, at).alias("last_state"),
        F.max("service").alias("service")
    )


@query("""{ev} select seq, round(packet_rate, 6) as packet_rate, round(byte_rate, 6) as byte_rate, syn_ratio, round(udp_rate, 6) as udp_rate, round(byte_amplification_ratio, 6) as byte_amplification_ratio, round(out_in_byte_ratio, 6) as out_in_byte_ratio, round(asymmetric_traffic_score, 6) as asymmetric_traffic_score from (
  select seq, greatest(op + rp, n) / greatest(1.0, raw) as packet_rate, (ob + rb) / greatest(1.0, raw) as byte_rate, case when s0 then 1.0
    when syn then 0.5 else 0.0 end as syn_ratio,
    case when protocol = 'UDP' then greatest(op + rp, n) / greatest(0.001, raw) else 0.0 end as udp_rate, rb / greatest(1,
      ob) as byte_amplification_ratio, ob / greatest(1, rb) as out_in_byte_ratio, (ob - rb) / greatest(1, ob + rb) as asymmetric_traffic_score
  from (select *, case when d > 0 then d else (us - f) / 1000000 end as raw from (
    select seq, us, protocol, sum(orig_bytes) over w as ob, sum(resp_bytes) over w as rb, sum(orig_pkts) over w as op,
      sum(resp_pkts) over w as rp, count(case when event_type not in ('http', 'alert') then 1 end) over w as n, max(duration) over w as d,
      min(us) over w as f,
      coalesce(bool_or(conn_state = 'S0') over l, false) as s0, coalesce(bool_or(conn_state in ('S0', 'S1', 'SF')) over l, false) as syn
    from ev window w as (partition by flow_id order by us, seq rows unbounded preceding), l as (partition by flow_id
      order by us, seq rows between 99 preceding and current row))))""")
def features_volume(spark, folder):
    r = lambda c: F.round(c, 6).alias(c)
    return features.flow_running(_ev(spark, folder)).select(
        "seq", r("packet_rate"), r("byte_rate"), "syn_ratio", r("udp_rate"), r("byte_amplification_ratio"),
        r("out_in_byte_ratio"), r("asymmetric_traffic_score")
    )


@query("""{ev} select seq, count(distinct dst_port) over w as unique_dst_ports, count(distinct dst_ip) over w as unique_dst_hosts, count(*) over w as conn_attempts,
  round(coalesce(avg(case when conn_state is not null then (conn_state in ('S0','REJ','RSTO','RSTOS0'))::int end) over w, 0), 6) as failed_conn_ratio
  from ev window w as (partition by src_ip order by us range between 30000000 preceding and current row)""")
def host_windows(spark, folder):
    return features.source_windows(_ev(spark, folder)).select(
        "seq", "unique_dst_ports", "unique_dst_hosts", "conn_attempts", F.round("failed_conn_ratio", 6).alias("failed_conn_ratio")
    )


@query("""{ev} select seq, count(distinct src_ip) over w as unique_src_count, round(entropy(src_ip) over w, 6) + 0.0 as src_ip_entropy
  from ev window w as (partition by dst_ip order by us range between 30000000 preceding and current row)""")
def source_entropy(spark, folder):
    return features.destination_windows(_ev(spark, folder)).select(
        "seq", "unique_src_count", (F.round("src_ip_entropy", 6) + 0.0).alias("src_ip_entropy")
    )


@query("""{ev}, b as (select seq, us, src_ip as host, 'out' as role, dst_ip as peer from ev union all select seq, us, dst_ip, 'in', src_ip from ev),
  c as (select seq, role, count(distinct case when role = 'out' then peer end) over w as o, count(distinct case
    when role = 'in' then peer end) over w as i, count(case when role = 'out' then 1 end) over w as n
    from b window w as (partition by host order by us range between 60000000 preceding and current row))
  select seq, max(case when role = 'out' then o end) as src_out_degree, max(case when role = 'in' then i end) as dst_in_degree, max(case
    when role = 'out' then o + i end) as comm_partner_count,
    round(max(case when role = 'out' then o / greatest(1, n) end), 6) as graph_fanout_ratio from c group by seq""")
def graph_degrees(spark, folder):
    return features.degrees(_ev(spark, folder)).withColumn("graph_fanout_ratio", F.round("graph_fanout_ratio", 6))


@query("""{ev} select seq, round(sum(p) over (partition by dst_ip order by us, seq) / sum(p) over (order by us, seq), 6) as dest_concentration from (select seq, us, dst_ip, greatest(1, orig_pkts + resp_pkts) as p from ev)""")
def dest_concentration(spark, folder):
    return features.destination_share(_ev(spark, folder)).select("seq", F.round("dest_concentration", 6).alias("dest_concentration"))


_GAPS = """, last as (select *, row_number() over (partition by src_ip, dst_ip order by us desc, seq desc) as k from ev), kept as (select *
    from last where k <= 500),
  g as (select src_ip, dst_ip, us, (us - lag(us) over (partition by src_ip, dst_ip order by us, seq)) / 1000000 as gap from kept)"""


@query("{ev}" + _GAPS + """ select src_ip, dst_ip, count(*) as repeated_conn_count, round(count(*) / (greatest(1.0,
    (max(us) - min(us)) / 1000000) / 60), 6) as repeated_dst_freq,
  case when count(case when gap > 0 then 1 end) >= 2 then round(min(case when gap > 0 then gap end), 6) else 0 end as iat_min, case
    when count(case when gap > 0 then 1 end) >= 2 then round(max(case when gap > 0 then gap end), 6) else 0 end as iat_max,
  case when count(case when gap > 0 then 1 end) >= 2 then round(avg(case when gap > 0 then gap end) + 1e-9, 4) else 0 end as iat_mean, case
    when count(case when gap > 0 then 1 end) >= 2 and stddev_pop(case when gap > 0 then gap end) > 0 then round(stddev_pop(case
      when gap > 0 then gap end) + 1e-9, 4) else 0 end as iat_std
  from g group by src_ip, dst_ip""")
def interval_stats(spark, folder):
    t = features.pair_timing(_ev(spark, folder))
    return t.select(
        "src_ip", "dst_ip", "repeated_conn_count", F.round("repeated_dst_freq", 6).alias("repeated_dst_freq"),
        F.round("iat_min", 6).alias("iat_min"), F.round("iat_max", 6).alias("iat_max"),
        *[F.when(F.col(c) > 0, F.round(F.col(c) + 1e-9, 4)).otherwise(0.0).alias(c) for c in ("iat_mean", "iat_std")]
    )


@query("{ev}" + _GAPS + """, m as (select *, avg(gap) over (partition by src_ip, dst_ip) as mean from g where gap > 0)
  select src_ip, dst_ip, count(*) as n, case when count(*) >= 3
    and avg((gap - mean) ** 2) > 1e-12 then round(avg((gap - mean) ** 3) / avg((gap - mean) ** 2) ** 1.5, 5) else 0.0 end as iat_skewness
      from m group by src_ip, dst_ip""")
def interval_skew(spark, folder):
    p = features.pair_series(_ev(spark, folder)).where(F.size("gaps") > 0)
    return p.select("src_ip", "dst_ip", F.size("gaps").cast("bigint").alias("n"), F.round(series.skewness(F.col("gaps")), 5).alias("iat_skewness"))


@query("{ev}" + _GAPS + """, x as (select src_ip, dst_ip, gap, row_number() over (partition by src_ip, dst_ip
    order by us) - 1 as t, count(*) over (partition by src_ip, dst_ip) as n, avg(gap) over (partition by src_ip, dst_ip) as mean from g
      where gap > 0),
  f as (select src_ip, dst_ip, k, sqrt(sum((gap - mean) * cos(2 * pi() * k * t / n)) ** 2 + sum((gap - mean) * sin(2 * pi() * k * t / n)) ** 2) as amp from x, range(1, 251) r(k) where n >= 6 and k <= n // 2 group by src_ip, dst_ip, k)
  select src_ip, dst_ip, round(max(amp) / sum(amp), 4) as periodicity_score from f group by src_ip, dst_ip having sum(amp) > 1e-9""")
def spectral_peak(spark, folder):
    p = features.pair_series(_ev(spark, folder)).where(F.size("gaps") >= 6)
    return p.select("src_ip", "dst_ip", F.round(series.spectral_peak(F.col("gaps")), 4).alias("periodicity_score")).where("periodicity_score > 0")


@query("{ev}" + _GAPS + """, x as (select src_ip, dst_ip, gap, row_number() over (partition by src_ip, dst_ip
    order by us) as t, count(*) over (partition by src_ip, dst_ip) as n, avg(gap) over (partition by src_ip, dst_ip) as mean from g where gap > 0),
  v as (select src_ip, dst_ip, sum((gap - mean) ** 2) as power from x where n >= 6 group by src_ip, dst_ip),
  a as (select p.src_ip, p.dst_ip, q.t - p.t as lag, sum((p.gap - p.mean) * (q.gap - q.mean)) as s from x p join x q on p.src_ip = q.src_ip
    and p.dst_ip = q.dst_ip and q.t - p.t between 1 and 9 where p.n >= 6 group by 1, 2, 3)
  select a.src_ip, a.dst_ip, round(max(s / power), 5) as autocorr_peak from a join v on a.src_ip = v.src_ip and a.dst_ip = v.dst_ip
    where power > 1e-9 group by 1, 2""")
def autocorrelation(spark, folder):
    p = features.pair_series(_ev(spark, folder)).where(F.size("gaps") >= 6)
    return p.select("src_ip", "dst_ip", F.round(series.autocorrelation_peak(F.col("gaps")), 5).alias("autocorr_peak"))


@query("""{ev} select flow_id, count(*) as n, avg(orig_bytes) as mean, round(coalesce(var_samp(orig_bytes), 0), 4) as variance, case when avg(orig_bytes) > 1e-5 then round(coalesce(stddev_samp(orig_bytes), 0) / avg(orig_bytes), 6) else 0 end as cv, min(orig_bytes) as least, max(orig_bytes) as most from ev group by flow_id""")
def welford_stats(spark, folder):
    x = F.col("orig_bytes").cast("double")
    mean = F.avg(x)
    return _ev(spark, folder).groupBy("flow_id").agg(
        F.count(F.lit(1)).alias("n"), mean.alias("mean"), F.round(F.coalesce(F.var_samp(x), F.lit(0.0)), 4).alias("variance"),
        F.when(mean > 1e-5, F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)) / mean, 6)).otherwise(0.0).alias("cv"),
        F.min("orig_bytes").alias("least"), F.max("orig_bytes").alias("most")
    )


# --- names ---------------------------------------------------------------------------------------
_LL = " ".join(f"when '{k}' then ln({v})" for k, v in text.BIGRAMS.items())


@query("""with q as (select distinct lower(query_name) as name from net_events where query_name is not null),
  c as (select name, unnest(string_split(name, '')) as ch from q), f as (select name, ch, count(*) as n from c group by all),
  e as (select name, -sum(n / length(name) * log2(n / length(name))) as h from f group by name)
  select q.name, cast(length(q.name) as bigint) as len, round(coalesce(h, 0), 6) + 0.0 as entropy,
    cast(length(q.name) - length(replace(q.name, '.', '')) as bigint) as depth,
    round(length(regexp_replace(q.name, '[^aeiou]', '', 'g')) / greatest(1, length(regexp_replace(q.name, '[^\\p{L}]', '', 'g'))),
      6) as vowel_ratio, round(length(regexp_replace(q.name, '[^\\p{Nd}]', '', 'g')) / greatest(1, length(q.name)), 6) as digit_ratio
  from q left join e on q.name = e.name""")
def name_statistics(spark, folder):
    names = read_table(spark, folder, "net_events").select(F.lower("query_name").alias("name")).where("name is not null").distinct()
    n, ratios = F.col("name"), text.letter_ratios(F.col("name"))
    return names.select(
        "name", F.length(n).cast("bigint").alias("len"), (F.round(text.shannon_entropy(n), 6) + 0.0).alias("entropy"),
        text.subdomain_depth(n).cast("bigint").alias("depth"), F.round(ratios["vowel_ratio"], 6).alias("vowel_ratio"),
        F.round(ratios["digit_ratio"], 6).alias("digit_ratio")
    )


@query(f"""with q as (select distinct lower(query_name) as name, split_part(lower(query_name), '.', 1) as label from net_events
    where query_name is not null),
  b as (select name, unnest(range(1, cast(length(label) as bigint))) as i, label from q where length(label) >= 2),
  s as (select name, avg(case substr(label, i, 2) {_LL} else ln({text.FLOOR}) end) as ll from b group by name)
  select q.name, round(coalesce(ll, 0), 6) as log_likelihood from q left join s on q.name = s.name""")
def bigram_scores(spark, folder):
    names = read_table(spark, folder, "net_events").select(F.lower("query_name").alias("name")).where("name is not null").distinct()
    return names.select("name", F.round(text.bigram_log_likelihood(F.col("name")), 6).alias("log_likelihood"))


@query("""{ev}, l as (select *, row_number() over (partition by src_ip order by us desc, seq desc) as k from ev where event_type = 'dns' and query_name is not null)
  select src_ip, count(*) as n_queries, round(avg(length(query_name)), 6) as query_len_mean,
    round(avg(length(query_name) - length(replace(query_name, '.', ''))), 6) as subdomain_depth_mean from l where k <= 100 group by src_ip""")
def dns_features(spark, folder):
    return features.name_features(_ev(spark, folder)).select(
        "src_ip", "n_queries", F.round("query_len_mean", 6).alias("query_len_mean"),
        F.round("subdomain_depth_mean", 6).alias("subdomain_depth_mean")
    )


@query("""select row_id, cast(case when query_name <> '' then 1 else 0 end as double) as has_tls_sni from net_events
    where lower(event_type) = 'tls'""")
def tls_names(spark, folder):
    rows = read_table(spark, folder, "net_events").where(F.lower("event_type") == "tls")
    return rows.select("row_id", F.when(F.nullif(F.col("query_name"), F.lit("")).isNotNull(), 1.0).otherwise(0.0).alias("has_tls_sni"))


# --- detectors, gate, fusion, severity ------------------------------------------------------------
_T = detectors.Thresholds()
_DETECT = f"""with v as (select *, {_PORTS} from flow_vectors),
  d as (select *, coalesce(not (sp in (80, 443, 8080, 53) and outbound_bytes < 100000), true)
    and outbound_bytes >= 25000 as big, tls_version_num > 0 and has_tls_sni = 0 as open_tls from v),
  f as (select *,
    (case when syn_ratio >= 0.8 and (src_ip_entropy >= 2.5 or dst_in_degree >= 5) then 0.95 else 0 end) as a1, (case
      when packet_rate >= 50 then 0.85 else 0 end) as a2, (case when udp_rate >= 50 and byte_amplification_ratio > 3 then 0.9 else 0 end) as a3,
    (case when unique_dst_ports >= 10 and dst_port_fanout >= 2 then 0.92 else 0 end) as b1, (case when unique_dst_hosts >= 8
      and dst_host_fanout >= 2 then 0.88 else 0 end) as b2, (case when conn_attempts >= 15 and failed_conn_ratio >= 0.6 then 0.85 else 0 end) as b3,
    (case when (shannon_entropy_mean >= 3.4 or ngram_log_likelihood <= -4.5) and query_len_mean >= 15 then 0.9 else 0 end) as c1, (case
      when txt_record_ratio >= 0.5 then 0.93 else 0 end) as c2, (case when query_frequency >= 5 and query_len_mean >= 15
      and shannon_entropy_mean >= 3 then 0.8 else 0 end) as c3,
    (case when repeated_conn_count >= 5 and (iat_cv <= 0.15 or periodicity_score >= 0.08) and iat_mean >= 0.5 then 0.88
      else 0 end) as d1, (case when repeated_dst_freq >= 2 and repeated_conn_count >= 5 and iat_cv <= 0.3 and periodicity_score >= 0.08
      and iat_mean >= 0.5 then 0.75 else 0 end) as d2,
    (case when big and out_in_byte_ratio >= 8 and asymmetric_traffic_score >= 0.75 then 0.9 else 0 end) as e1, (case when big
      and outbound_rate >= 10000 then 0.85 else 0 end) as e2,
    (case when coalesce(dp in (443, 8443), false) and open_tls then 0.75 else 0 end) as g1, (case when open_tls
      and directionality_ratio >= 0.9 and pkt_size_entropy <= 1 then 0.8 else 0 end) as g2 from d),
  s as (select *, cast(greatest(a1, a2, a3) as double) as ddos, cast(greatest(b1, b2, b3) as double) as scan, cast(greatest(c1, c2,
    c3) as double) as dns, cast(greatest(d1, d2) as double) as c2_, cast(greatest(e1, e2) as double) as exfil, cast(greatest(g1,
      g2) as double) as encrypted from f)"""


def _detected(spark, folder):
    v = _vec(spark, folder)
    return v.withColumn("found", detectors.detect(_port(0), _port(1)))


@query(_DETECT + """ select vec_id, 'ddos' as detector, ddos as score,
    cast((a1 > 0)::int + (a2 > 0)::int + (a3 > 0)::int as int) as n_indicators from s where ddos > 0
  union all select vec_id, 'scan', scan, cast((b1 > 0)::int + (b2 > 0)::int + (b3 > 0)::int as int) from s where scan > 0
  union all select vec_id, 'dns', dns, cast((c1 > 0)::int + (c2 > 0)::int + (c3 > 0)::int as int) from s where dns > 0
  union all select vec_id, 'c2', c2_, cast((d1 > 0)::int + (d2 > 0)::int as int) from s where c2_ > 0
  union all select vec_id, 'exfil', exfil, cast((e1 > 0)::int + (e2 > 0)::int as int) from s where exfil > 0
  union all select vec_id, 'encrypted', encrypted, cast((g1 > 0)::int + (g2 > 0)::int as int) from s where encrypted > 0""")
def detections(spark, folder):
    return _detected(spark, folder).select(
        "vec_id", F.explode(F.filter("found", lambda d: d["triggered"])).alias("d")
    ).select("vec_id", "d.detector", "d.score", "d.n_indicators")


#: model outputs stand in as deterministic columns of the row number
_MODEL_SQL = "case vec_id % 7 when 0 then 'DDOS' when 1 then 'PORT_SCAN' when 2 then 'C2_BEACONING' else 'BENIGN' end as rf, (vec_id * 37 % 100) / 100 as conf, (vec_id * 53 % 100) / 100 - 0.5 as anomaly, (vec_id * 53 % 100) < 50 as odd"


def _model():
    i = F.col("vec_id")
    return F.when(i % 7 == 0, "DDOS").when(i % 7 == 1, "PORT_SCAN").when(
        i % 7 == 2, "C2_BEACONING"
    ).otherwise("BENIGN"), (i * 37 % 100) / 100, (i * 53 % 100) / 100 - 0.5, (i * 53 % 100) < 50


_FUSED = _DETECT + f""", m as (select *, {_MODEL_SQL} from s),
  t as (select *, case when exfil > 0 then 'DATA_EXFILTRATION' when c2_ > 0 then 'C2_BEACONING' when dns > 0 then 'DGA_DNS_TUNNELLING'
    when scan > 0 then 'PORT_SCAN' when encrypted > 0 then 'ENCRYPTED_MALWARE' when ddos > 0 then 'DDOS' end as top,
    case when exfil > 0 then exfil when c2_ > 0 then c2_ when dns > 0 then dns when scan > 0 then scan when encrypted > 0 then encrypted
      when ddos > 0 then ddos end as top_score from m),
  u as (select *, rf <> 'BENIGN' and conf >= 0.75 as known, top is not null and (conf < 0.75 or rf = 'BENIGN' or top = rf) as rule,
    odd and not ((rf <> 'BENIGN' and conf >= 0.75) or (rf = 'BENIGN' and conf >= 0.85 and top is null)) as anomalous,
    (rf = 'DDOS' and ddos > 0) or (rf = 'PORT_SCAN' and scan > 0) or (rf = 'C2_BEACONING' and c2_ > 0) as same from t),
  x as (select *, case when rule then top when known then rf when anomalous then 'UNKNOWN_ANOMALY' else 'BENIGN' end as label, case
    when rule then 'B' when known and (anomalous or same) then 'A' when known then 'B' when anomalous then 'C' else 'D' end as state,
    cast(case when rule then greatest(0.85, top_score) when known and (anomalous or same) then least(1.0, greatest(conf, 0.92))
      when known then conf when anomalous then least(1.0, 0.6 + abs(anomaly) / 0.5) when rf = 'BENIGN' then conf else 1 - conf
      end as double) as confidence from u),
  y as (select *, case label when 'BENIGN' then 'INFO' when 'DDOS' then case when packet_rate >= 500 or dst_in_degree >= 20
    or confidence >= 0.9 then 'CRITICAL' else 'HIGH' end
    when 'DATA_EXFILTRATION' then case when outbound_bytes >= 10000000 or outbound_rate >= 100000 then 'CRITICAL' else 'HIGH' end
      when 'C2_BEACONING' then case when confidence >= 0.85 or periodicity_score >= 0.2 then 'CRITICAL' else 'HIGH' end
    when 'PORT_SCAN' then case when unique_dst_ports >= 25 or dst_port_fanout >= 10 then 'HIGH' else 'MEDIUM' end
      when 'UNKNOWN_ANOMALY' then case when confidence >= 0.7 then 'MEDIUM' else 'LOW' end else case when confidence >= 0.8 then 'HIGH'
      else 'MEDIUM' end end as severity from x)"""


def _fused(spark, folder):
    rf, conf, anomaly, odd = _model()
    v = _detected(spark, folder).withColumns({"rf": rf, "conf": conf, "anomaly": anomaly, "odd": odd})
    out = detectors.fuse(F.col("found"), F.col("rf"), F.col("conf"), F.col("anomaly"), F.col("odd"))
    v = v.withColumns({k: c for k, c in out.items()})
    return v.withColumn("severity", detectors.severity(F.col("label"), F.col("confidence")))


@query(_FUSED + " select vec_id, label, state, round(confidence, 6) as confidence, severity from y")
def fusion_table(spark, folder):
    return _fused(spark, folder).select("vec_id", "label", "state", F.round("confidence", 6).alias("confidence"), "severity")


@query(_FUSED + """ select vec_id, label, cast(case label when 'BENIGN' then 1
  when 'DDOS' then (syn_ratio > 0.5)::int + (packet_rate > 10)::int + (src_ip_entropy > 1.5)::int + (unique_src_count > 5
    or dst_in_degree > 5)::int + (udp_rate > 10)::int
      when 'PORT_SCAN' then (unique_dst_ports > 1)::int + (dst_port_fanout > 0.5)::int + (unique_dst_hosts > 1)::int + (conn_attempts > 1)::int
  when 'DGA_DNS_TUNNELLING' then (shannon_entropy_mean > 2.5)::int + (query_len_mean > 15)::int + (txt_record_ratio > 0.2)::int + (ngram_log_likelihood < -3)::int + (query_frequency > 1)::int when 'C2_BEACONING' then (iat_mean > 0)::int + (iat_cv < 0.3)::int + (periodicity_score > 0.05)::int + (repeated_conn_count > 1)::int
  when 'DATA_EXFILTRATION' then 2 + (outbound_rate > 1000)::int
    when 'ENCRYPTED_MALWARE' then (tls_version_num > 0)::int + (has_tls_sni = 0)::int + (pkt_size_entropy > 0)::int
      else (packet_rate > 10)::int end as int) as n_evidence, cast(case label when 'BENIGN' then 0
  when 'DDOS' then (syn_ratio > 0.5)::int + (packet_rate > 10)::int + (src_ip_entropy > 1.5)::int + (unique_src_count > 5
    or dst_in_degree > 5)::int + (udp_rate > 10)::int
      when 'PORT_SCAN' then (unique_dst_ports > 1)::int + (dst_port_fanout > 0.5)::int + (unique_dst_hosts > 1)::int + 2 * (conn_attempts > 1)::int
  when 'DGA_DNS_TUNNELLING' then (shannon_entropy_mean > 2.5)::int + (query_len_mean > 15)::int + (txt_record_ratio > 0.2)::int + (ngram_log_likelihood < -3)::int + (query_frequency > 1)::int when 'C2_BEACONING' then (iat_mean > 0)::int + (iat_cv < 0.3)::int + (periodicity_score > 0.05)::int + (repeated_conn_count > 1)::int
  when 'DATA_EXFILTRATION' then 3 when 'ENCRYPTED_MALWARE' then (tls_version_num > 0)::int + (has_tls_sni = 0)::int + (pkt_size_entropy > 0)::int else 0 end as int) as n_values from y""")
def alert_evidence(spark, folder):
    texts, values = detectors.evidence(F.col("label"))
    return _fused(spark, folder).select("vec_id", "label", F.size(texts).alias("n_evidence"), F.size(values).alias("n_values"))


@query(f"""with v as (select *, {_PORTS} from flow_vectors),
  g as (select *, repeated_conn_count as n, sp > 1024 and dp in (80, 443, 8080, 22) and outbound_bytes >= 15000 as client from v),
  c as (select *, case when client and out_in_byte_ratio >= 20 then 'DATA_EXFILTRATION' when query_len_mean >= 25
    or txt_record_ratio >= 0.35 then 'DGA_DNS_TUNNELLING' when unique_dst_ports >= 10 or dst_port_fanout >= 10 or unique_dst_hosts >= 8
      or dst_host_fanout >= 8 then 'PORT_SCAN' when syn_ratio >= 0.7 or packet_rate >= 80 then 'DDOS' end as crit,
    cast(greatest(case when syn_ratio >= 0.7 or packet_rate >= 80 then 0.95 when syn_ratio >= 0.45 or packet_rate >= 20 then 0.65 else 0 end,
     case when unique_dst_ports >= 10 or dst_port_fanout >= 10 then 0.92 when unique_dst_hosts >= 8 or dst_host_fanout >= 8 then 0.88
     when unique_dst_ports >= 3 or unique_dst_hosts >= 3 then 0.6 else 0 end,
     case when query_len_mean >= 25 or txt_record_ratio >= 0.35 then 0.93 when query_len_mean >= 15 or txt_record_ratio >= 0.2 then 0.7 else 0 end,
     case when client and out_in_byte_ratio >= 20 then 0.9 when client and out_in_byte_ratio >= 8 then 0.65 else 0 end, case
     when n >= 4 then 0.55 else 0 end,
     case when tls_version_num > 0 and has_tls_sni = 0 and dp in (443, 8443) then 0.75 else 0 end) as double) as urgency from g)
  select vec_id, case when crit is not null then 'CRITICAL_RULE' when urgency > 0 then 'SUSPICIOUS' else 'PASS_NORMAL'
    end as decision, coalesce(crit, case when urgency > 0 then 'none' else 'BENIGN' end) as threat_class, urgency from c""")
def gate_screen(spark, folder):
    g = _gate()
    return _vec(spark, folder).select(
        "vec_id", g["decision"].alias("decision"), F.coalesce(g["threat_class"], F.lit("none")).alias("threat_class"),
        g["urgency"].alias("urgency")
    )


def _gate():
    c = F.col
    return detectors.gate({
        "syn_ratio": c("syn_ratio"), "packet_rate": c("packet_rate"), "ports": c("unique_dst_ports"),
        "port_fanout": c("dst_port_fanout"), "hosts": c("unique_dst_hosts"), "host_fanout": c("dst_host_fanout"),
        "query_length": c("query_len_mean"), "txt_ratio": c("txt_record_ratio"), "out_bytes": c("outbound_bytes"),
        "out_in_ratio": c("out_in_byte_ratio"), "src_port": _port(0), "dst_port": _port(1), "n_times": c("repeated_conn_count"),
        "tls": c("tls_version_num") > 0, "sni": c("has_tls_sni") > 0
    })


_GATE = f"""with v as (select *, {_PORTS} from flow_vectors),
  g as (select *, sp > 1024 and dp in (80, 443, 8080, 22) and outbound_bytes >= 15000 as client from v),
  c as (select *, case when client and out_in_byte_ratio >= 20 then 'DATA_EXFILTRATION' when query_len_mean >= 25
    or txt_record_ratio >= 0.35 then 'DGA_DNS_TUNNELLING' when unique_dst_ports >= 10 or dst_port_fanout >= 10 or unique_dst_hosts >= 8
      or dst_host_fanout >= 8 then 'PORT_SCAN' when syn_ratio >= 0.7 or packet_rate >= 80 then 'DDOS' end as crit,
    cast(greatest(case when syn_ratio >= 0.7 or packet_rate >= 80 then 0.95 when syn_ratio >= 0.45 or packet_rate >= 20 then 0.65 else 0 end,
     case when unique_dst_ports >= 10 or dst_port_fanout >= 10 then 0.92 when unique_dst_hosts >= 8 or dst_host_fanout >= 8 then 0.88
     when unique_dst_ports >= 3 or unique_dst_hosts >= 3 then 0.6 else 0 end,
     case when query_len_mean >= 25 or txt_record_ratio >= 0.35 then 0.93 when query_len_mean >= 15 or txt_record_ratio >= 0.2 then 0.7 else 0 end,
     case when client and out_in_byte_ratio >= 20 then 0.9 when client and out_in_byte_ratio >= 8 then 0.65 else 0 end, case
     when repeated_conn_count >= 4 then 0.55 else 0 end,
     case when tls_version_num > 0 and has_tls_sni = 0 and dp in (443, 8443) then 0.75 else 0 end) as double) as urgency from g)"""
#: fired detectors in list order, and whether the model is confirmed by one
_IN_ORDER = """case when ddos > 0 then 'DDOS' when scan > 0 then 'PORT_SCAN' when dns > 0 then 'DGA_DNS_TUNNELLING'
    when c2_ > 0 then 'C2_BEACONING' when exfil > 0 then 'DATA_EXFILTRATION' when encrypted > 0 then 'ENCRYPTED_MALWARE' end as top,
    case when ddos > 0 then ddos when scan > 0 then scan when dns > 0 then dns when c2_ > 0 then c2_ when exfil > 0 then exfil
      when encrypted > 0 then encrypted end as top_score"""


@query(_DETECT + f""", gate as ({_GATE} select vec_id, crit, urgency from c),
  m as (select s.*, crit, urgency, {_MODEL_SQL.replace("vec_id", "s.vec_id")} from s join gate on s.vec_id = gate.vec_id), t as (select *,
    {_IN_ORDER} from m),
  u as (select *, urgency > 0 and top is not null and (conf < 0.75 or rf = 'BENIGN' or top = rf) as rule, rf <> 'BENIGN'
    and conf >= 0.75 as known, odd and not (rf <> 'BENIGN' and conf >= 0.8) as anomalous from t)
  select vec_id, case when crit is not null then crit when rule then top when known then rf when anomalous then 'UNKNOWN_ANOMALY'
    else 'BENIGN' end as label, case when crit is not null or rule then 'B' when known and anomalous then 'A' when known then 'B'
      when anomalous then 'C' else 'D' end as state,
    round(cast(case when crit is not null then greatest(0.9, urgency) when rule then greatest(0.85, top_score) when known
      and anomalous then least(1.0, greatest(conf, 0.92)) when known then conf when anomalous then least(1.0, 0.6 + 2 * greatest(0,
      -anomaly)) else greatest(0.9, conf) end as double), 6) as confidence from u""")
def fusion_gated(spark, folder):
    rf, conf, anomaly, odd = _model()
    out = detectors.fuse_gated(_gate(), F.col("found"), rf, conf, anomaly, odd)
    return _detected(spark, folder).select(
        "vec_id", out["label"].alias("label"), out["state"].alias("state"), F.round(out["confidence"], 6).alias("confidence")
    )


_UNORDERED = _DETECT + f""", m as (select *, {_MODEL_SQL} from s),
  t as (select *, rf <> 'BENIGN' and conf >= 0.75 as known, ddos > 0 or scan > 0 or dns > 0 or c2_ > 0 or exfil > 0
    or encrypted > 0 as fired, conf < 0.75 or rf = 'BENIGN' as weak from m),
  u as (select *, case when ddos > 0 and (weak or rf = 'DDOS') then 'DDOS' when scan > 0 and (weak or rf = 'PORT_SCAN') then 'PORT_SCAN'
    when dns > 0 and weak then 'DGA_DNS_TUNNELLING' when c2_ > 0 and (weak or rf = 'C2_BEACONING') then 'C2_BEACONING' when exfil > 0
      and weak then 'DATA_EXFILTRATION' when encrypted > 0 and weak then 'ENCRYPTED_MALWARE' end as top,
    case when ddos > 0 and (weak or rf = 'DDOS') then ddos when scan > 0 and (weak or rf = 'PORT_SCAN') then scan when dns > 0
      and weak then dns when c2_ > 0 and (weak or rf = 'C2_BEACONING') then c2_ when exfil > 0 and weak then exfil when encrypted > 0
      and weak then encrypted end as top_score from t),
  x as (select *, case when top is not null then top when known then rf when odd or fired then 'UNKNOWN_ANOMALY' else 'BENIGN' end as label,
    case when top is not null then 'B' when known and odd then 'A' when known then 'B' when odd or fired then 'C' else 'D' end as state,
    round_even(cast(case when top is not null then greatest(0.85, top_score) when known and odd then least(1.0, greatest(conf, 0.92))
      when known then conf when odd or fired then least(1.0, 0.6 + abs(anomaly) / 0.5) when rf = 'BENIGN' then conf else 1 - conf
      end as double), 4) as confidence from u)"""


@query(_UNORDERED + " select vec_id, label, state, confidence from x")
def fusion_unordered(spark, folder):
    """The decision table of side-by-side comparisons."""
    rf, conf, anomaly, odd = _model()
    out = detectors.fuse_unordered(F.col("found"), rf, conf, anomaly, odd)
    return _detected(spark, folder).select("vec_id", *[out[k].alias(k) for k in ("label", "state", "confidence")])


# --- alerts -------------------------------------------------------------------------------------
_DET = """{ev}, d as (select *, src_ip || '>' || dst_ip as pair, (seq * 37 % 100) / 100 as conf, coalesce(conn_state, '-') as st from ev),
  f as (select *, case when us - lag(us) over (partition by src_ip, dst_ip, protocol order by us) > 30000000 then 1 else 0 end as flag from d),
  s as (select *, sum(flag) over (partition by src_ip, dst_ip, protocol order by us) as run from f)"""


@query(_DET + """ select src_ip, dst_ip, protocol, min(us) as first_us, max(us) as last_us, count(*) as occurrence_count,
    max(conf) as max_confidence, arg_min(dst_port, (us, dst_port)) as dst_port from s group by src_ip, dst_ip, protocol, run""")
def alert_dedup(spark, folder):
    d = _ev(spark, folder).withColumn("conf", F.col("seq") * 37 % 100 / 100)
    return alerts.deduplicate(d, ["src_ip", "dst_ip", "protocol"], "us", "conf", ["dst_port"]).drop("alert_id")


_FIRST_ALERT = "with a as (select * from (select *, row_number() over (partition by alert_id order by row_id) as copy from security_alerts) where alert_id is null or copy = 1) "


def _alerts(spark, folder):
    from tidemark.operators.sessions import first_copies

    raw = read_table(spark, folder, "security_alerts")
    keep = [c for c in raw.columns if c not in ("supporting_evidence", "triggered_detectors")]
    return first_copies(raw, "alert_id", "row_id", keep)


@query(_FIRST_ALERT + """ select facet, value, count(*) as n_alerts, cast(sum(occurrence_count) as bigint) as n_events
    from (select 'severity' as facet, coalesce(severity, 'none') as value, occurrence_count from a union all
      select 'threat_class', coalesce(threat_class, 'none'), occurrence_count from a union all
      select 'detection_method', coalesce(detection_method, 'none'), occurrence_count from a union all
      select 'total', 'all', occurrence_count from a) group by facet, value""")
def alert_stats(spark, folder):
    return alerts.statistics(_alerts(spark, folder))


@query(_FIRST_ALERT + " select row_id, alert_id, threat_class, severity from a where upper(threat_class) = 'PORT_SCAN' and upper(threat_class) <> 'BENIGN' order by row_id desc limit 50 offset 10")
def alert_page(spark, folder):
    return alerts.page(
        _alerts(spark, folder), "row_id", 50, 10, threat_class="port_scan", exclude_benign=True
    ).select("row_id", "alert_id", "threat_class", "severity")


@query(_FIRST_ALERT + " select row_id, alert_id, flow_id from a where contains(lower(flow_id), '192.168.10.53') or contains(lower(alert_id), '192.168.10.53')")
def alert_search(spark, folder):
    return alerts.search(_alerts(spark, folder), "192.168.10.53").select("row_id", "alert_id", "flow_id")


@query(_FIRST_ALERT + """ select row_id, alert_id, severity, confidence_score from a order by case upper(severity) when 'CRITICAL' then 4
    when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 when 'INFO' then 0 else -1 end desc, confidence_score desc nulls last,
      row_id limit 20""")
def top_alerts(spark, folder):
    a = _alerts(spark, folder)
    return a.orderBy(
        alerts.severity_rank(F.col("severity")).desc(), F.col("confidence_score").desc_nulls_last(), "row_id"
    ).limit(20).select("row_id", "alert_id", "severity", "confidence_score")


@query("""{ev} select seq, coalesce(case when us - lag(us) over w <= 21600000000 then lag(us) over w end, 0) as previous_us from ev window w as (partition by src_ip, dst_ip, dst_port order by us, seq)""")
def asof_previous(spark, folder):
    found = alerts.previous_within(_ev(spark, folder), ["src_ip", "dst_ip", "dst_port"], "us", 21_600_000_000, "seq")
    return found.select("seq", F.coalesce("previous_us", F.lit(0)).alias("previous_us"))


@query("{ev} select seq, flow_id, us, event_type from (select *, row_number() over (partition by flow_id order by us desc, seq desc) as k from ev) where k = 1")
def latest_snapshot(spark, folder):
    return windows.last_rows(_ev(spark, folder), ["flow_id"], ["us", "seq"], 1).select("seq", "flow_id", "us", "event_type")


@query("""{ev} select f.flow_row_id from flow_keys f where not exists (select 1 from ev where ev.flow_id = f.flow_id)""")
def anti_expired(spark, folder):
    return read_table(spark, folder, "flow_keys").join(_ev(spark, folder).select("flow_id"), "flow_id", "left_anti").select("flow_row_id")


@query("""{ev} select a.seq as seq, count(*) as n_near from ev a join ev b on a.src_ip = b.src_ip and b.us between a.us - 300000000 and a.us group by a.seq""")
def interval_join(spark, folder):
    """Events of the same source in the five minutes up to each event, as a sliding count instead of a join of all pairs."""
    return windows.sliding(
        _ev(spark, folder).select("seq", "src_ip", "us"), ["src_ip"], "us", 300_000_000, {"n_near": F.lit(1)}
    ).select("seq", "n_near")


# --- metrics ------------------------------------------------------------------------------------
@query("""select event_type, count(*) as n, round(quantile_cont(l, 0.5), 4) as p50, round(quantile_cont(l, 0.95), 4) as p95,
    round(quantile_cont(l, 0.99), 4) as p99, round(avg(l), 4) as mean, round(min(l), 4) as least, round(max(l), 4) as most
  from (select lower(event_type) as event_type, epoch_us(received_at) / 1000000 - "timestamp" as l from net_events where "timestamp" > 0
    and received_at is not null) group by event_type""")
def latency_percentiles(spark, folder):
    lag = F.unix_micros("received_at") / 1_000_000 - F.col("timestamp")
    rows = read_table(spark, folder, "net_events").where("timestamp > 0 and received_at is not null").select(
        F.lower("event_type").alias("event_type"), lag.alias("l")
    )
    names = {0.5: "p50", 0.95: "p95", 0.99: "p99"}
    p = metrics.percentiles(rows, "l", list(names), ["event_type"]).groupBy(F.col("event_type").alias("e")).agg(*[
        F.max(F.when(F.col("share") == q, F.col("value"))).alias(n) for q, n in names.items()
    ])
    out = rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l").alias("mean"), F.min("l").alias("least"), F.max("l").alias("most")
    ).join(p, F.col("event_type").eqNullSafe(F.col("e")))
    return out.select("event_type", "n", *[F.round(n, 4).alias(n) for n in (*names.values(), "mean", "least", "most")])


@query("""{ev} select sensor_id, count(*) as n_events, count(distinct flow_id) as n_flows, cast(sum(orig_pkts + resp_pkts) as bigint) as n_packets, round(count(*) / greatest(0.001, (max(us) - min(us)) / 1000000), 6) as events_per_second from ev group by sensor_id""")
def throughput(spark, folder):
    span = F.greatest(F.lit(0.001), (F.max("us") - F.min("us")) / 1e6)
    return _ev(spark, folder).groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("flow_id").alias("n_flows"),
        F.sum(F.col("orig_pkts") + F.col("resp_pkts")).alias("n_packets"),
        F.round(F.count(F.lit(1)) / span, 6).alias("events_per_second")
    )


@query("""select threat_class, cast(least(29, greatest(0, floor((anomaly_score + 0.5) / 1 * 30))) as int) as bin, count(*) as n
    from security_alerts where anomaly_score is not null group by all""")
def score_histogram(spark, folder):
    return metrics.histogram(read_table(spark, folder, "security_alerts"), "anomaly_score", -0.5, 0.5, 30, ["threat_class"])


@query(_FUSED + """, p as (select rf, label, count(*) as n from y group by all), c as (select distinct rf as class from p union
    select distinct label from p),
  r as (select class, coalesce((select sum(n) from p where rf = class), 0) as s, coalesce((select sum(n) from p
    where label = class), 0) as g, coalesce((select sum(n) from p where rf = class and label = class), 0) as h from c)
  select class, cast(s as bigint) as support, round(h / greatest(1, g), 6) as "precision", round(h / greatest(1, s), 6) as recall,
    round(case when h > 0 then 2 * (h / g) * (h / s) / (h / g + h / s) else 0 end, 6) as f1 from r""")
def class_report(spark, folder):
    r = metrics.class_report(_fused(spark, folder), "rf", "label")
    return r.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""with s as (select anomaly_score as s, count(*) filter (if_is_anomalous) as p, count(*) filter (not if_is_anomalous) as q
    from security_alerts where anomaly_score is not null and if_is_anomalous is not null group by 1),
  b as (select *, coalesce(sum(q) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from s)
    select round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6) as auc from b""")
def auc_rank(spark, folder):
    a = read_table(spark, folder, "security_alerts").where("anomaly_score is not null and if_is_anomalous is not null")
    return metrics.auc(a, F.col("if_is_anomalous"), F.col("anomaly_score")).select(F.round("auc", 6).alias("auc"))


@query("select round(quantile_cont(anomaly_score, 0.05), 6) as p05, round(quantile_cont(anomaly_score, 0.5), 6) as p50 from security_alerts where threat_class = 'BENIGN' and anomaly_score is not null")
def threshold_selection(spark, folder):
    a = read_table(spark, folder, "security_alerts").where("threat_class = 'BENIGN' and anomaly_score is not null")
    p = metrics.percentiles(a, "anomaly_score", [0.05, 0.5])
    return p.agg(*[F.round(F.max(F.when(F.col("share") == q, F.col("value"))), 6).alias(n) for q, n in ((0.05, "p05"), (0.5, "p50"))])


@query("""select vec_id, round((packet_rate - (select avg(packet_rate) from flow_vectors)) / (select stddev_pop(packet_rate)
    from flow_vectors), 5) as packet_rate, round((iat_cv - (select avg(iat_cv) from flow_vectors)) / (select stddev_pop(iat_cv)
      from flow_vectors), 5) as iat_cv from flow_vectors""")
def standard_scores(spark, folder):
    return metrics.standardize(_vec(spark, folder), ["packet_rate", "iat_cv"]).select(
        "vec_id", F.round("packet_rate", 5).alias("packet_rate"), F.round("iat_cv", 5).alias("iat_cv")
    )


@query("select threat_class, count(*) as n, round(sum(count(*)) over () / (count(*) over () * count(*)), 6) as weight from security_alerts group by threat_class")
def class_weights(spark, folder):
    return metrics.class_weights(read_table(spark, folder, "security_alerts"), "threat_class").withColumn("weight", F.round("weight", 6))


@query("""with r as (select row_id, threat_class, row_number() over (partition by threat_class
    order by md5('42:' || row_id), row_id) as k, count(*) over (partition by threat_class) as n from security_alerts)
  select row_id, k <= case when n >= 5 then greatest(1, round_even(n * 0.2, 0)) else 1 end as in_test from r""")
def stratified_split(spark, folder):
    return metrics.stratified_split(
        read_table(spark, folder, "security_alerts").select("row_id", "threat_class"), "threat_class", "row_id"
    ).select("row_id", "in_test")


@query("""select count(*) as n_rows, count(*) - count(distinct event_id) - count(*) filter (event_id is null) as repeated_ids,
    count(*) filter (src_ip is null or src_ip = '0.0.0.0') as no_source, count(*) filter ("timestamp" is null
      or "timestamp" = 0) as no_time, count(*) filter (orig_bytes is null) as no_bytes from net_events""")
def data_audit(spark, folder):
    t = read_table(spark, folder, "net_events")
    no = lambda c, n: F.count_if(c).alias(n)
    return t.agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count("event_id") - F.countDistinct("event_id")).alias("repeated_ids"),
        no(F.col("src_ip").isNull() | (F.col("src_ip") == "0.0.0.0"), "no_source"),
        no(F.col("timestamp").isNull() | (F.col("timestamp") == 0), "no_time"), no(F.col("orig_bytes").isNull(), "no_bytes")
    )


@query(_FUSED + " select rf as truth, label as guess, count(*) as n from y group by all")
def confusion_matrix(spark, folder):
    return metrics.confusion(_fused(spark, folder), "rf", "label")


@query(_FUSED + """, p as (select rf, label, count(*) as n from y group by all), r as (select rf, sum(n) as s, coalesce(sum(case
    when rf = label then n end), 0) as h from p group by rf),
  g as (select label, sum(n) as g from p group by label)
  select round(avg(h / greatest(1, coalesce(g, 0))), 6) as macro_precision, round(avg(h / s), 6) as macro_recall, round(avg(case
    when h > 0 then 2 * (h / g) * (h / s) / (h / g + h / s) else 0 end), 6) as macro_f1 from r left join g on r.rf = g.label""")
def macro_averages(spark, folder):
    m = metrics.macro(metrics.class_report(_fused(spark, folder), "rf", "label"))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("""with a as (select threat_class <> 'BENIGN' as pos, if_is_anomalous as flag, anomaly_score as s from security_alerts
    where threat_class is not null and if_is_anomalous is not null and anomaly_score is not null)
  select round(avg(flag::int) filter (pos), 6) as true_positive_rate, round(avg(flag::int) filter (not pos), 6) as false_positive_rate,
    round(avg(s) filter (pos), 6) as positive_mean, round(avg(s) filter (not pos), 6) as negative_mean,
    round(abs(avg(s) filter (pos) - avg(s) filter (not pos)), 6) as separation from a""")
def anomaly_rates(spark, folder):
    a = read_table(spark, folder, "security_alerts").where("threat_class is not null and if_is_anomalous is not null and anomaly_score is not null")
    r = metrics.rates(a, F.col("threat_class") != "BENIGN", F.col("if_is_anomalous"), F.col("anomaly_score"))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("""with c as (select severity, threat_class, count(*) as k from security_alerts group by all), m as (select severity,
    arg_min(threat_class, (-k, threat_class)) as mode from c group by severity)
  select s.severity, count(*) as n, any_value(mode) as mode, round(min(anomaly_score) + 1e-9, 5) as least_score,
    round(avg(anomaly_score) + 1e-9, 5) as mean_score, round(sum(confidence_score) / count(*) + 1e-9, 5) as mean_confidence_score
      from security_alerts s join m on s.severity is not distinct from m.severity group by s.severity""")
def severity_summary(spark, folder):
    r = metrics.class_summary(read_table(spark, folder, "security_alerts"), "severity", "threat_class", "anomaly_score", ["confidence_score"])
    return r.select("severity", "n", "mode", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("least_score", "mean_score", "mean_confidence_score")])


@query("select row_id from security_alerts where threat_class in (select threat_class from security_alerts group by threat_class having count(*) >= 100)")
def trainable_rows(spark, folder):
    return metrics.classes_worth_training(read_table(spark, folder, "security_alerts"), "threat_class", least=100).select("row_id")


@query("""with g as (select src_ip, dst_ip, duration, count(*) as k from net_events group by all)
    select cast(sum(k) as bigint) as n_rows, cast(sum(k - 1) as bigint) as repeated_rows, cast(coalesce(sum(k) filter (src_ip is null),
      0) as bigint) as null_src_ip, cast(coalesce(sum(k) filter (dst_ip is null), 0) as bigint) as null_dst_ip,
  cast(coalesce(sum(k) filter (duration is null), 0) as bigint) as null_duration, cast(coalesce(sum(k) filter (isnan(duration)),
    0) as bigint) as nan_duration, cast(coalesce(sum(k) filter (isinf(duration)), 0) as bigint) as inf_duration from g""")
def row_audit(spark, folder):
    """Rows that repeat in full over three columns, and nulls, NaN and infinite values."""
    return metrics.audit(read_table(spark, folder, "net_events").select("src_ip", "dst_ip", "duration"), ["src_ip", "dst_ip", "duration"])


@query(_FIRST_ALERT + " select row_id, alert_id, threat_class from a where alert_id = (select min(alert_id) from a)")
def alert_by_id(spark, folder):
    a = _alerts(spark, folder)
    first = a.agg(F.min("alert_id")).first()[0]
    return alerts.get(a, first).select("row_id", "alert_id", "threat_class")


@query("{ev} select row_number() over (order by us, event_type, flow_id, seq) as place, seq from ev")
def event_order(spark, folder):
    """The place of each event in the stable order of time."""
    e = _ev(spark, folder).select(
        "seq", "us",
        F.struct(F.coalesce("event_type", F.lit("")).alias("e"), F.coalesce("flow_id", F.lit("")).alias("f"), "seq").alias("tie")
    )
    return windows.running_total(e, "us", "tie", F.lit(1).cast("bigint"), "place").select("place", "seq")


# --- sets, unions and the generic relational extras -------------------------------------------------
@query("""select 'net_events' as source, lower(event_type) as event_type, count(*) as n from net_events group by all union all
    select 'event_feed', lower(event_type), count(*) from event_feed group by all union all select 'security_alerts', 'alert', count(*)
      from security_alerts""")
def union_sources(spark, folder):
    one = lambda t, c: read_table(spark, folder, t).select(F.lit(t).alias("source"), c.alias("event_type"))
    rows = one(
        "net_events", F.lower("event_type")
    ).unionByName(one("event_feed", F.lower("event_type"))).unionByName(one("security_alerts", F.lit("alert")))
    return rows.groupBy("source", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct src_ip from net_events where src_ip is not null intersect select distinct src_ip from flow_keys")
def shared_sources(spark, folder):
    return read_table(
        spark, folder, "net_events"
    ).select("src_ip").where("src_ip is not null").intersect(read_table(spark, folder, "flow_keys").select("src_ip"))


@query("select distinct src_ip from flow_keys where src_ip is not null except select distinct src_ip from net_events")
def unseen_sources(spark, folder):
    return read_table(spark, folder, "flow_keys").select("src_ip").where("src_ip is not null").subtract(read_table(
        spark, folder, "net_events"
    ).select("src_ip"))


@query("""with a as (select feature_name as name from feature_scale), b as (select column_name as name from (describe select *
    from flow_vectors)) select name, 'missing' as side from (select name from a except select name from b) union all select name, 'extra'
      from (select name from b except select name from a)""")
def schema_difference(spark, folder):
    a = read_table(spark, folder, "feature_scale").select(F.col("feature_name").alias("name"))
    b = spark.createDataFrame([(c,) for c in _vec(spark, folder).columns], "name string")
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("extra")))


@query("""select n_name, c_mktsegment, count(*) as n_lines,
    cast(sum(cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) as revenue from lineitem
      join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all""")
def star_join(spark, folder):
    t = lambda n: read_table(spark, folder, n)
    rows = t("lineitem").join(
        t("orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        t("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return rows.groupBy("n_name", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_extendedprice").cast("decimal(15,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("revenue")
    )


@query("""select coalesce(lower(protocol), 'all') as protocol, coalesce(lower(event_type), 'all') as event_type, count(*) as n
    from net_events where protocol is not null and event_type is not null group by rollup(lower(protocol), lower(event_type))""")
def protocol_rollup(spark, folder):
    t = read_table(spark, folder, "net_events").where("protocol is not null and event_type is not null").select(
        F.lower("protocol").alias("p"), F.lower("event_type").alias("e")
    )
    return t.rollup("p", "e").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("p", F.lit("all")).alias("protocol"), F.coalesce("e", F.lit("all")).alias("event_type"), "n"
    )


# --- models, packets and streams: rows only ---------------------------------------------------------
@query()
def anomaly_scores(spark, folder):
    """Isolation-forest scores of all vectors, fitted on those that no detector fires for."""
    from tidemark.operators.models import anomaly_scores as score
    from tidemark.operators.models import isolation_forest

    calm = _detected(spark, folder).where(~F.exists("found", lambda d: d["triggered"] & (d["score"] >= 0.9)))
    names = features.ORDER
    return score(
        _vec(spark, folder).select("vec_id", *names), isolation_forest(calm.select(*names), names, trees=300), names
    ).select("vec_id", "anomaly_score")


@query()
def model_classes(spark, folder):
    """Random-forest classes of all vectors, trained on the detectors' classes."""
    from tidemark.operators.models import classify, random_forest

    rows = _detected(spark, folder).select(
        "vec_id", *features.ORDER, F.coalesce(detectors.first_fired(F.col("found"))["class"], F.lit("BENIGN")).alias("label")
    )
    return classify(random_forest(rows, features.ORDER, "label", trees=300), rows.drop("label")).select("vec_id", "model_class", "model_confidence")


@query("""{ev}, p as (select src_ip, dst_ip, src_port, dst_port, protocol, us, coalesce(starts_with(conn_state, 'S'), false) as syn, coalesce(conn_state = 'SF', false) as ack, coalesce(starts_with(conn_state, 'R'), false) as rst, orig_bytes + resp_bytes as len,
    case when coalesce(event_type, '') <> 'tls' then query_name end as q, case when event_type = 'tls' then query_name end as sni from ev),
  f as (select src_ip, dst_ip, src_port, dst_port, protocol, count(*) as n, sum(len) as bytes, (max(us) - min(us)) / 1000000 as span,
    count(*) filter (syn and not ack) as a, count(*) filter (ack and not syn) as b, count(*) filter (rst) as c, count(*) filter (syn
      and ack) as d, count(*) filter (syn) as syns, max((sni is not null)::int) as sni from p group by all),
  s as (select dst_ip, count(distinct src_ip) as srcs, entropy(src_ip) as h from p group by dst_ip), h as (select src_ip,
    count(distinct dst_port) as ports, count(distinct dst_ip) as hosts from p group by src_ip),
  g as (select f.*, srcs, h, ports, hosts, greatest(0.001, span) as dur, greatest(1.0, span) as whole, greatest(1, case
    when protocol = 'TCP' then n else 0 end) as tcp, (protocol = 'TCP')::int as is_tcp from f join s using (dst_ip) join h using (src_ip))
  select src_ip, dst_ip, src_port, dst_port, protocol, round(n / dur, 4) as packet_rate, round(bytes / dur, 4) as byte_rate,
    round(is_tcp * a / tcp, 6) as syn_ratio, round(is_tcp * b / tcp, 6) as ack_ratio, round(is_tcp * c / tcp, 6) as rst_ratio,
      round(is_tcp * d / tcp, 6) as syn_ack_ratio,
    cast(srcs as double) as unique_src_ips, round(h, 6) + 0.0 as src_ip_entropy, cast(ports as double) as unique_dst_ports,
      cast(hosts as double) as unique_dst_hosts, round(ports / whole, 6) as dst_port_fanout, round(hosts / whole, 6) as dst_host_fanout,
      round(syns / whole, 6) as connection_attempt_rate,
    cast(bytes as double) as outbound_bytes_total, round(dur, 6) as flow_duration_sec, cast(sni as double) as has_tls_sni from g""")
def packet_features(spark, folder):
    """Features of the packet generation, every event taken for a packet."""
    from tidemark.operators import packets

    v = packets.vectors(packets.of_events(_ev(spark, folder)))
    digits = {
        "packet_rate": 4, "byte_rate": 4, "syn_ratio": 6, "ack_ratio": 6, "rst_ratio": 6, "syn_ack_ratio": 6, "unique_src_ips": 0,
        "src_ip_entropy": 6, "unique_dst_ports": 0, "unique_dst_hosts": 0, "dst_port_fanout": 6, "dst_host_fanout": 6,
        "connection_attempt_rate": 6, "outbound_bytes_total": 0, "flow_duration_sec": 6, "has_tls_sni": 0
    }
    return v.select(
        "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        *[(F.round(F.col(n).cast("double"), d) + 0.0).alias(n) for n, d in digits.items()]
    )


@query("""{ev}, t as (select src_ip, dst_ip, src_port, dst_port, protocol, us, (us - lag(us) over (partition by src_ip, dst_ip, src_port, dst_port, protocol order by us)) / 1000000 as gap
    from (select *, row_number() over (partition by src_ip, dst_ip, src_port, dst_port, protocol order by us desc) as k from ev) where k <= 1000),
  g as (select *, avg(gap) over w as mean, count(*) over w as n, row_number() over (partition by src_ip, dst_ip, src_port, dst_port,
    protocol order by us) - 1 as t from t where gap > 0 window w as (partition by src_ip, dst_ip, src_port, dst_port, protocol)),
  a as (select src_ip, dst_ip, src_port, dst_port, protocol, any_value(mean) as m, stddev_pop(gap) as sd from g where n >= 2 group by all),
  f as (select src_ip, dst_ip, src_port, dst_port, protocol, k,
    sqrt(sum((gap - mean) * cos(2 * pi() * k * t / n)) ** 2 + sum((gap - mean) * sin(2 * pi() * k * t / n)) ** 2) as amp
      from g, range(1, 501) r(k) where n >= 8 and k <= n // 2 group by all),
  p as (select src_ip, dst_ip, src_port, dst_port, protocol, max(amp) / sum(amp) as peak from f group by all having sum(amp) > 1e-9),
  r as (select src_ip, dst_ip, src_port, dst_port, protocol, case when sd / m < 0.15 then 1 else 0 end + case when m > 0.1 then 1 else 0
    end + case when coalesce(peak, 0) > 0.05 then 1 else 0 end as holds from a left join p using (src_ip, dst_ip, src_port, dst_port,
      protocol) where m > 1e-5)
  select distinct ev.src_ip, ev.dst_ip, ev.src_port, ev.dst_port, ev.protocol, case when holds = 3 then 'c2_beacon' else 'benign'
    end as prediction, case when holds = 3 then 1.0 else 0.9 end as confidence, case when holds = 3 then 'RULE_BASED' else 'MODEL_BASED' end as method
  from ev left join r on ev.src_ip = r.src_ip and ev.dst_ip = r.dst_ip and ev.src_port = r.src_port and ev.dst_port = r.dst_port
    and ev.protocol is not distinct from r.protocol""")
def packet_predictions(spark, folder):
    """What the packet generation's rules say of each flow beside a model that calls all of them benign at 0.9."""
    from tidemark.operators import packets

    v = packets.vectors(packets.of_events(_ev(spark, folder)).withColumn("dns_query", F.lit(None).cast("string")))
    found = packets.predict(v, F.lit("benign"), F.lit(0.9))
    return found.select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "prediction", "confidence", "method")


@query("""with r as (select threat_class, (row_number() over (partition by threat_class order by cast(('0x' || substr(md5('42:' || row_id),
    1, 2)) as int), md5('42:' || row_id)) - 1) % 5 as fold from security_alerts)
  select threat_class, cast(fold as int) as fold, count(*) as n from r group by all""")
def model_folds(spark, folder):
    """Rows of each class in each of five stratified folds."""
    from tidemark.operators.models import folds

    rows = read_table(spark, folder, "security_alerts").select("row_id", "threat_class")
    return folds(rows, "threat_class", "row_id").groupBy("threat_class", "fold").agg(F.count(F.lit(1)).alias("n"))


@query()
def model_validation(spark, folder):
    """Accuracy and macro averages of forests on five stratified folds of flow_vectors, labelled by the detectors."""
    from tidemark.operators.models import cross_validate, random_forest

    rows = _detected(spark, folder).select(
        "vec_id", *features.ORDER, F.coalesce(detectors.first_fired(F.col("found"))["class"], F.lit("BENIGN")).alias("label")
    )
    return cross_validate(rows, features.ORDER, "label", "vec_id", lambda train: random_forest(train, features.ORDER, "label"))


@query("""with d as (select flow_id, threat_class, epoch_us(received_at) as us, confidence_score from security_alerts where received_at is not null),
  f as (select *, case when us - lag(us) over (partition by flow_id, threat_class order by us) > 30000000 then 1 else 0 end as flag from d),
  s as (select *, sum(flag) over (partition by flow_id, threat_class order by us) as run from f)
  select flow_id, threat_class, min(us) as first_us, max(us) as last_us, count(*) as occurrence_count,
    max(confidence_score) as max_confidence from s group by flow_id, threat_class, run""")
def stream_alert_sessions(spark, folder):
    """Alerts of a stream of deliveries: sessions of one flow and class, 30 seconds apart at most."""
    from tidemark.session import stream_table
    from tidemark.streaming.pipeline import alert_sessions, drain

    s = stream_table(spark, folder, "security_alerts", 24).withColumn("confidence", F.col("confidence_score"))
    found = drain(spark, alert_sessions(s, F.col("received_at"), ["flow_id", "threat_class"]), "alert-sessions", "complete")
    return found.select(
        "flow_id", "threat_class", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"),
        "occurrence_count", "max_confidence"
    )


@query("""select epoch_us(received_at) // 60000000 * 60000000 as start_us, flow_id, count(*) as n, cast(sum(coalesce(orig_bytes,
    0)) as bigint) as orig_bytes from net_events where received_at is not null group by all""")
def stream_flow_windows(spark, folder):
    """Totals per flow and minute from a stream of deliveries."""
    from tidemark.session import stream_table
    from tidemark.streaming.pipeline import drain, flow_windows

    s = stream_table(spark, folder, "net_events", 24)
    found = drain(spark, flow_windows(s, F.col("received_at")), "flow-windows", "complete")
    return found.select(F.unix_micros("start").alias("start_us"), "flow_id", "n", F.coalesce("orig_bytes", F.lit(0)).alias("orig_bytes"))


# --- the flagship: which sources look like scanners -------------------------------------------------
@query("""{ev}, w as (select seq, us, src_ip, count(distinct dst_port) over w as ports, count(distinct dst_ip) over w as hosts, count(*) over w as attempts, coalesce(avg(case when conn_state is not null then (conn_state in ('S0','REJ','RSTO','RSTOS0'))::int end) over w, 0) as failed
    from ev window w as (partition by src_ip order by us range between 3600000000 preceding and current row)),
  d as (select *, cast(greatest(case when ports >= 3 then 0.92 else 0 end, case when hosts >= 3 then 0.88 else 0 end, case
    when attempts >= 5 and failed >= 0.6 then 0.85 else 0 end) as double) as score from w),
  f as (select *, case when us - lag(us) over (partition by src_ip order by us) > 21600000000 then 1 else 0 end as flag from d where score > 0),
  s as (select *, sum(flag) over (partition by src_ip order by us) as run from f)
  select src_ip, min(us) as first_us, max(us) as last_us, count(*) as occurrence_count, max(score) as max_confidence, arg_min(ports, (us,
    ports, hosts)) as ports, arg_min(hosts, (us, ports, hosts)) as hosts from s group by src_ip, run
      order by max_confidence desc, occurrence_count desc, src_ip, first_us""")
def port_scan_alerts(spark, folder):
    c = F.col
    seen = features.source_windows(_ev(spark, folder), 3_600_000_000)
    score = F.greatest(
        F.when(c("unique_dst_ports") >= 3, 0.92).otherwise(0.0), F.when(c("unique_dst_hosts") >= 3, 0.88).otherwise(0.0),
        F.when((c("conn_attempts") >= 5) & (c("failed_conn_ratio") >= 0.6), 0.85).otherwise(0.0)
    )
    fired = seen.select(
        "src_ip", "us", c("unique_dst_ports").alias("ports"), c("unique_dst_hosts").alias("hosts"), score.alias("score")
    ).where("score > 0")
    found = alerts.deduplicate(fired, ["src_ip"], "us", "score", ["ports", "hosts"], gap_us=21_600_000_000, block_us=86_400_000_000)
    return found.drop("alert_id").orderBy(F.desc("max_confidence"), F.desc("occurrence_count"), "src_ip", "first_us")
