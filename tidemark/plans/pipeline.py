"""From events to alerts: feature vectors, decisions, alerts and the report of a run, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import detectors, features, metrics, models, pipeline
from tidemark.operators.events import normalize
from tidemark.plans.registry import _DETECT, _EV
from tidemark.session import cut, read_table

_LL = " ".join(f"when '{k}' then ln({v})" for k, v in text.BIGRAMS.items())

#: CTE v: the 54 features of each flow at its latest event
_VECTORS = _EV.rstrip() + f""",
  le as (select * from (select *, row_number() over (partition by flow_id order by us desc, seq desc) as k from ev) where k = 1),
  tot as (select flow_id, sum(orig_bytes) as ob, sum(resp_bytes) as rb, sum(orig_pkts) as op, sum(resp_pkts) as rp, max(duration) as d, min(us) as f,
      count(case when event_type not in ('http', 'alert') then 1 end) as n, max(case when event_type = 'tls' and query_name <> '' then 1.0
      else 0.0 end) as sni from ev group by flow_id),
  st as (select flow_id, bool_or(conn_state = 'S0') as s0, bool_or(conn_state in ('S0', 'S1', 'SF')) as syn,
    bool_or(conn_state = 'SF') as sf, bool_or(conn_state in ('RSTO', 'RSTR', 'RSTOS0')) as rst,
      avg((conn_state in ('S0', 'REJ', 'RSTO', 'RSTOS0'))::int) as failed
    from (select *, row_number() over (partition by flow_id order by us desc, seq desc) as k from ev where conn_state <> '') where k <= 100
      group by flow_id),
  sz as (select flow_id, v, row_number() over (partition by flow_id order by us desc, seq desc, side desc) as k
    from (select flow_id, us, seq, 0 as side, orig_bytes as v from ev where orig_bytes > 0 union all select flow_id, us, seq, 1, resp_bytes
      from ev where resp_bytes > 0)),
  zs as (select flow_id, avg(v) as mean, stddev_pop(v) as sd, entropy(v) as h from sz where k <= 500 group by flow_id),
  own as (select flow_id, us from (select flow_id, us, row_number() over (partition by flow_id
    order by us desc, seq desc) as k, count(*) over (partition by flow_id) as n from ev where coalesce(event_type, '') <> 'tls')
      where k <= 500 and n >= 3),
  pp as (select src_ip, dst_ip, us, seq, row_number() over (partition by src_ip, dst_ip order by us, seq) as place from ev),
  lp as (select le.flow_id, le.us as now, pp.src_ip, pp.dst_ip, pp.place from le join pp on le.seq = pp.seq),
  ph as (select lp.flow_id, pp.us from lp join pp on lp.src_ip = pp.src_ip and lp.dst_ip = pp.dst_ip and pp.place between lp.place - 499
    and lp.place),
  hist as (select flow_id, us, true as mine from own union all select flow_id, us, false from ph where flow_id not in (select flow_id from own)),
  pf as (select flow_id, min(us) as first_us, count(*) as n from ph group by flow_id),
  gp as (select flow_id, gap, row_number() over (partition by flow_id order by us) - 1 as t, count(*) over (partition by flow_id) as n,
    avg(gap) over (partition by flow_id) as mean
    from (select flow_id, us, (us - lag(us) over (partition by flow_id order by us)) / 1000000 as gap from hist) where gap > 0),
  iat as (select flow_id, min(gap) as least, max(gap) as most, avg(gap) as mean, stddev_pop(gap) as sd from gp where n >= 2 group by flow_id),
  fft as (select flow_id, k, sqrt(sum((gap - mean) * cos(2 * pi() * k * t / n)) ** 2 + sum((gap - mean) * sin(2 * pi() * k * t / n)) ** 2) as amp from gp, range(1, 251) r(k) where n >= 6 and k <= n // 2 group by flow_id, k),
  per as (select flow_id, max(amp) / sum(amp) as score from fft group by flow_id having sum(amp) > 1e-6),
  nm as (select flow_id, query_name as name from (select *, row_number() over (partition by flow_id order by us desc, seq desc) as k from ev
    where event_type = 'dns' and query_name <> '') where k <= 100),
  ch as (select name, c, count(*) as m from (select name, unnest(string_split(name, '')) as c from (select distinct name from nm)) group by all),
  en as (select name, -sum(m / length(name) * log2(m / length(name))) as h from ch group by name),
  bi as (select name, avg(case substr(split_part(name, '.', 1), i, 2) {_LL} else ln({text.FLOOR}) end) as ll
    from (select name, unnest(range(1, length(split_part(name, '.', 1)))) as i from (select distinct name from nm)
      where length(split_part(name, '.', 1)) >= 2) group by name),
  dn as (select flow_id, count(*) as n, avg(length(nm.name)) as len, avg(h) as h, avg(length(nm.name) - length(replace(nm.name, '.',
    ''))) as depth, avg(coalesce(ll, 0)) as ll, lower(string_agg(nm.name, '')) as joined
    from nm join en on nm.name = en.name left join bi on nm.name = bi.name group by flow_id),
  sw as (select seq, count(distinct dst_port) over w as ports, count(distinct dst_ip) over w as hosts, count(*) over w as attempts from ev
    window w as (partition by src_ip order by us range between 30000000 preceding and current row)),
  dw as (select seq, count(distinct src_ip) over w as srcs, entropy(src_ip) over w as h from ev window w as (partition by dst_ip
    order by us range between 30000000 preceding and current row)),
  roles as (select seq, us, src_ip as host, 'out' as role, dst_ip as peer from ev union all select seq, us, dst_ip, 'in', src_ip from ev),
  dg as (select seq, role, count(distinct case when role = 'out' then peer end) over w as o, count(distinct case
    when role = 'in' then peer end) over w as i, count(case when role = 'out' then 1 end) over w as n
    from roles window w as (partition by host order by us range between 60000000 preceding and current row)),
  dd as (select seq, max(case when role = 'out' then o end) as outs, max(case when role = 'in' then i end) as ins, max(case
    when role = 'out' then o + i end) as partners, max(case when role = 'out' then o / greatest(1, n) end) as fanout from dg group by seq),
  dc as (select seq, sum(p) over (partition by dst_ip order by us, seq) / sum(p) over (order by us, seq) as share
    from (select seq, us, dst_ip, greatest(1, orig_pkts + resp_pkts) as p from ev)),
  j as (select le.flow_id, le.us, le.src_ip, le.dst_ip, le.src_port, le.dst_port, le.protocol, tot.*exclude(flow_id), case when d > 0 then d
    else (le.us - f) / 1000000 end as raw, greatest(op + rp, tot.n) as pk, ob + rb as by_,
      coalesce(s0, false) as s0, coalesce(syn, false) as syn, coalesce(sf, false) as sf, coalesce(rst, false) as rst, coalesce(failed, 0) as failed,
      zs.mean as zmean, zs.sd as zsd, zs.h as zh, iat.least, iat.most, iat.mean, iat.sd, per.score, pf.n as npair, case
      when le.flow_id in (select flow_id from own) then f else pf.first_us end as since,
      coalesce(dn.n, 0) as nq, dn.len, dn.h as dh, dn.depth, dn.ll, dn.joined, sw.ports, sw.hosts, sw.attempts, dw.srcs, dw.h as sh,
      dd.outs, dd.ins, dd.partners, dd.fanout, dc.share
    from le join tot on le.flow_id = tot.flow_id left join st on le.flow_id = st.flow_id left join zs on le.flow_id = zs.flow_id left
      join iat on le.flow_id = iat.flow_id left join per on le.flow_id = per.flow_id
      join pf on le.flow_id = pf.flow_id left join dn on le.flow_id = dn.flow_id join sw on le.seq = sw.seq join dw on le.seq = dw.seq
      join dd on le.seq = dd.seq join dc on le.seq = dc.seq),
  w as (select *, greatest(0.001, raw) as dur, greatest(1.0, raw) as rdur, greatest(1, length(regexp_replace(joined, '[^\\p{{L}}]', '',
    'g'))) as letters, length(regexp_replace(joined, '[^aeiou]', '', 'g')) as vowels from j),
  v as (select flow_id, us, src_ip, dst_ip, src_port, dst_port, us / 1000000 as "timestamp", dur as window_duration_sec,
    pk / rdur as packet_rate, by_ / rdur as byte_rate, syn::int / rdur as syn_rate, case when s0 then 1.0 when syn then 0.5 else 0.0
      end as syn_ratio, case when sf then 0.5 else 0.0 end as ack_ratio, rst::int as rst_ratio,
    case when protocol = 'UDP' then pk / dur else 0 end as udp_rate, srcs as unique_src_count, sh as src_ip_entropy,
      share as dest_concentration, rb / greatest(1, ob) as byte_amplification_ratio,
    coalesce(least, 0) as iat_min, coalesce(most, 0) as iat_max, coalesce(mean, 0) as iat_mean, coalesce(sd, 0) as iat_std,
      coalesce(sd / greatest(0.00001, mean), 0) as iat_cv, coalesce(score, 0) as periodicity_score,
    npair / (greatest(1.0, (us - since) / 1000000) / 60) as repeated_dst_freq, dur as flow_duration, npair as repeated_conn_count,
    coalesce(len, 0) as query_len_mean, coalesce(dh, 0) as shannon_entropy_mean, coalesce(vowels / letters, 0) as vowel_ratio,
      coalesce((length(regexp_replace(joined, '[^\\p{{L}}]', '', 'g')) - vowels) / letters, 0) as consonant_ratio,
    coalesce(length(regexp_replace(joined, '[^\\p{{Nd}}]', '', 'g')) / length(joined), 0) as digit_ratio,
      coalesce(len(list_distinct(string_split(joined, ''))) / length(joined), 0) as unique_char_ratio,
    coalesce(depth, 0) as subdomain_depth_mean, nq / dur as query_frequency, 0.0 as txt_record_ratio, coalesce(ll,
      0) as ngram_log_likelihood, 0.0 as tls_version_num, sni as has_tls_sni, 0.0 as ja3_present,
    coalesce(zmean, by_ / greatest(1, pk)) as pkt_size_mean, coalesce(zsd, 0) as pkt_size_std, coalesce(zh, 0) as pkt_size_entropy,
      op / greatest(1, op + rp) as directionality_ratio,
    ports as unique_dst_ports, hosts as unique_dst_hosts, ports / rdur as dst_port_fanout, hosts / rdur as dst_host_fanout,
      attempts as conn_attempts, attempts / rdur as conn_attempt_rate, failed as failed_conn_ratio,
    rb as inbound_bytes, ob as outbound_bytes, ob / greatest(1, rb) as out_in_byte_ratio, by_ as bytes_per_flow, ob / rdur as outbound_rate,
      (ob - rb) / greatest(1, by_) as asymmetric_traffic_score,
    outs as src_out_degree, ins as dst_in_degree, partners as comm_partner_count, fanout as graph_fanout_ratio from w)
"""


#: CTE ov: the 54 features of the selective generation
_OPTIMIZED = _EV.rstrip() + f""",
  kn as (select *, coalesce(event_type in ('connection', 'dns', 'tls'), false) as known from ev),
  pr as (select *, coalesce(last_value(case when known then us end ignore nulls) over b, first_value(us) over b) as prev from kn
    window b as (partition by flow_id order by us, seq rows between unbounded preceding and 1 preceding)),
  gaps as (select *, case when event_type in ('connection', 'dns') and us > prev then (us - prev) / 1000000 end as gap from pr),
  fo as (select flow_id, sum(orig_bytes) as ob, sum(resp_bytes) as rb, sum(orig_pkts) as op, sum(resp_pkts) as rp,
    count(*) filter (known) as n, max(duration) as d, min(us) as f,
      count(*) filter (contains(conn_state, 'S')) as syn, count(*) filter (contains(conn_state, 'A')
      or conn_state in ('SF', 'S1', 'S2')) as ack, count(*) filter (contains(conn_state, 'R')) as rst,
      min(gap) as gmin, max(gap) as gmax, avg(gap) as gmean, stddev_samp(gap) as gsd, max(case when event_type = 'tls'
      and query_name <> '' then 1.0 else 0.0 end) as sni from gaps group by flow_id),
  lo as (select * from (select *, row_number() over (partition by flow_id order by known desc, case when known then us else -us
    end desc, case when known then seq else -seq end desc) as k from kn) where k = 1),
  so as (select flow_id, avg(v) as mean, coalesce(stddev_samp(v), 0) as sd from (select flow_id, orig_bytes as v from ev
    where orig_bytes > 0 union all select flow_id, resp_bytes from ev where resp_bytes > 0) group by flow_id),
  tm as (select flow_id, us from (select flow_id, us, row_number() over (partition by flow_id order by us desc, seq desc) as k from ev
    where event_type in ('connection', 'dns')) where k <= 128),
  go as (select flow_id, gap, row_number() over (partition by flow_id order by us) - 1 as t, count(*) over (partition by flow_id) as n,
    avg(gap) over (partition by flow_id) as mean from (select flow_id, us, (us - lag(us) over (partition by flow_id
      order by us)) / 1000000 as gap from tm) where gap > 0),
  ft as (select flow_id, k, sqrt(sum((gap - mean) * cos(2 * pi() * k * t / n)) ** 2 + sum((gap - mean) * sin(2 * pi() * k * t / n)) ** 2) as amp from go, range(1, 65) r(k) where n >= 6 and k <= n // 2 group by flow_id, k),
  pe as (select flow_id, max(amp) / sum(amp) as score from ft group by flow_id having sum(amp) > 1e-6),
  qn as (select flow_id, query_name as q, row_number() over (partition by flow_id order by us desc, seq desc) as k from ev
    where event_type = 'dns' and query_name <> ''),
  qa as (select flow_id, count(*) as nq, avg(length(q)) as len, avg(length(q) - length(replace(q, '.', ''))) as depth, max(case
    when k = 1 then q end) as q from qn where k <= 50 group by flow_id),
  qc as (select q, c, count(*) as m from (select q, unnest(string_split(q, '')) as c from (select distinct q from qa)) group by all),
  qe as (select q, -sum(m / length(q) * log2(m / length(q))) as h from qc group by q),
  qb as (select q, avg(case substr(split_part(q, '.', 1), i, 2) {_LL} else ln({text.FLOOR}) end) as ll
    from (select q, unnest(range(1, length(split_part(q, '.', 1)))) as i from (select distinct q from qa)
      where length(split_part(q, '.', 1)) >= 2) group by q),
  ic as (select ip, c, count(*) as m from (select ip, unnest(string_split(ip, '')) as c from (select distinct src_ip as ip from ev)) group by all),
  ie as (select ip, -sum(m / length(ip) * log2(m / length(ip))) as h from ic group by ip),
  sp as (select seq, src_ip, dst_ip, dst_port, known, sum(known::int) over (partition by src_ip order by us, seq) as place from kn),
  tp as (select seq, dst_ip, src_ip, known, sum(known::int) over (partition by dst_ip order by us, seq) as place from kn),
  sd as (select lo.seq, greatest(1, count(distinct b.dst_ip)) as hosts, greatest(1, count(distinct b.dst_port)) as ports from lo
    join sp a on lo.seq = a.seq left join sp b on a.src_ip = b.src_ip and b.known and b.place between a.place - 1999 and a.place group by lo.seq),
  td as (select lo.seq, greatest(1, count(distinct b.src_ip)) as srcs from lo join tp a on lo.seq = a.seq left
    join tp b on a.dst_ip = b.dst_ip and b.known and b.place between a.place - 1999 and a.place group by lo.seq),
  oj as (select lo.*, fo.* exclude (flow_id), case when d > 0 then d else (lo.us - f) / 1000000
    end as raw, op + rp as pk, ob + rb as by_, so.mean as zmean, coalesce(so.sd, 0) as zsd, pe.score, qa.* exclude (flow_id), qe.h as qh,
      qb.ll, ie.h as iph, hosts, ports, srcs, split_part(qa.q, '.', 1) as label
    from lo join fo on lo.flow_id = fo.flow_id left join so on lo.flow_id = so.flow_id left join pe on lo.flow_id = pe.flow_id left
      join qa on lo.flow_id = qa.flow_id left join qe on qa.q = qe.q left join qb on qa.q = qb.q
      join ie on lo.src_ip = ie.ip join sd on lo.seq = sd.seq join td on lo.seq = td.seq),
  ow as (select *, greatest(0.001, raw) as dur, greatest(1.0, raw) as whole, greatest(1, length(label)) as ll_, length(regexp_replace(label,
    '[^aeiou]', '', 'g')) as vowels from oj),
  ov as (select flow_id, us, src_ip, dst_ip, src_port, dst_port, us / 1000000 as "timestamp", pk / dur as packet_rate,
    by_ / dur as byte_rate, syn / dur as syn_rate, syn / greatest(1, pk) as syn_ratio, ack / greatest(1, pk) as ack_ratio, rst / greatest(1,
      pk) as rst_ratio,
    case when protocol = 'UDP' then pk / dur else 0 end as udp_rate, srcs as unique_src_count, iph as src_ip_entropy, 1 / greatest(1.0,
      hosts) as dest_concentration, rb / greatest(1, ob) as byte_amplification_ratio,
    coalesce(gmin, 0) as iat_min, coalesce(gmax, 0) as iat_max, coalesce(gmean, 0) as iat_mean, coalesce(gsd, 0) as iat_std, coalesce(case
      when gmean > 0.00001 then coalesce(gsd, 0) / gmean end, 0) as iat_cv, coalesce(score, 0) as periodicity_score,
    n / dur * 60 as repeated_dst_freq, dur as flow_duration, n as repeated_conn_count, coalesce(len, 0) as query_len_mean, coalesce(qh,
      0) as shannon_entropy_mean, coalesce(vowels / ll_, 0) as vowel_ratio, coalesce((length(regexp_replace(label, '[^\\p{{L}}]', '',
      'g')) - vowels) / ll_, 0) as consonant_ratio,
    coalesce(length(regexp_replace(label, '[^\\p{{Nd}}]', '', 'g')) / ll_, 0) as digit_ratio, coalesce(case
      when label <> '' then len(list_distinct(string_split(label, ''))) / ll_ end, 0) as unique_char_ratio, coalesce(depth,
      0) as subdomain_depth_mean, coalesce(nq / dur, 0) as query_frequency,
    0.0 as txt_record_ratio, coalesce(ll, 0) as ngram_log_likelihood, 0.0 as tls_version_num, sni as has_tls_sni, 0.0 as ja3_present,
      coalesce(zmean, 0) as pkt_size_mean, zsd as pkt_size_std, log2(zsd + 1) as pkt_size_entropy, op / greatest(1, pk) as directionality_ratio,
    ports as unique_dst_ports, hosts as unique_dst_hosts, ports / whole as dst_port_fanout, hosts / whole as dst_host_fanout,
      syn as conn_attempts, syn / dur as conn_attempt_rate, rst / greatest(1, syn) as failed_conn_ratio, rb as inbound_bytes,
      ob as outbound_bytes, ob / greatest(1, rb) as out_in_byte_ratio,
    by_ as bytes_per_flow, ob / dur as outbound_rate, (ob - rb) / greatest(1, by_) as asymmetric_traffic_score, hosts as src_out_degree,
      srcs as dst_in_degree, hosts + srcs as comm_partner_count, hosts / greatest(1.0, srcs) as graph_fanout_ratio from ow)
"""


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return features.vectors(normalize(read_table(spark, folder, "net_events")))


def feature_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 54 features of every flow at its latest event, to four digits behind the point."""
    v = _vectors(spark, folder)
    return v.select("flow_id", *features.ENDS, "timestamp", *[F.round(F.col(n) + 1e-9, 4).alias(n) for n in ["window_duration_sec", *features.ORDER]])


def features_optimized(spark: SparkSession, folder: str) -> DataFrame:
    """The 54 features of the selective generation, to four digits behind the point."""
    v = features.optimized(normalize(read_table(spark, folder, "net_events")))
    return v.select("flow_id", *features.ENDS, "timestamp", *[F.round(F.col(n) + 1e-9, 4).alias(n) for n in features.ORDER])


def feature_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How the two generations agree on each feature: mean and largest absolute difference, share of flows that are equal."""
    events = normalize(read_table(spark, folder, "net_events"))
    a, b = (cut(v.select("flow_id", *features.ORDER), "generation") for v in (features.vectors(events), features.optimized(events)))
    return metrics.agreement(a, b, "flow_id", features.ORDER).select(
        "feature", "n", *[F.round(F.col(c) + 1e-9, 3).alias(c) for c in ("mean_difference", "largest_difference", "agreement")]
    )


#: CTEs: sv, the rules' decision on each vector; al, the alerts made of them
_RULES = _VECTORS.rstrip() + ",\n  fv as (select *, src_port as sp, dst_port as dp from v),\n" + _DETECT[_DETECT.index("  d as (") :].replace("from v)", "from fv)") + """,
  r as (select *, round(us) as at, case when exfil > 0 then 'DATA_EXFILTRATION' when c2_ > 0 then 'C2_BEACONING'
    when dns > 0 then 'DGA_DNS_TUNNELLING' when scan > 0 then 'PORT_SCAN' when encrypted > 0 then 'ENCRYPTED_MALWARE'
      when ddos > 0 then 'DDOS' else 'BENIGN' end as label,
    case when exfil > 0 then greatest(0.85, exfil) when c2_ > 0 then greatest(0.85, c2_) when dns > 0 then greatest(0.85, dns)
      when scan > 0 then greatest(0.85, scan) when encrypted > 0 then greatest(0.85, encrypted) when ddos > 0 then greatest(0.85, ddos)
      else 0.9 end as confidence from s),
  sv as (select *, case label when 'BENIGN' then 'INFO' when 'DDOS' then case when packet_rate >= 500 or dst_in_degree >= 20
    or confidence >= 0.9 then 'CRITICAL' else 'HIGH' end
    when 'DATA_EXFILTRATION' then case when outbound_bytes >= 10000000 or outbound_rate >= 100000 then 'CRITICAL' else 'HIGH' end
      when 'C2_BEACONING' then case when confidence >= 0.85 or periodicity_score >= 0.2 then 'CRITICAL' else 'HIGH' end
    when 'PORT_SCAN' then case when unique_dst_ports >= 25 or dst_port_fanout >= 10 then 'HIGH' else 'MEDIUM' end else case
      when confidence >= 0.8 then 'HIGH' else 'MEDIUM' end end as severity from r),
  fl as (select *, case when us - lag(us) over (partition by src_ip, dst_ip, label order by us) > 30000000 then 1 else 0 end as flag from sv),
  ru as (select *, sum(flag) over (partition by src_ip, dst_ip, label order by us) as run from fl),
  al as (select src_ip, dst_ip, label as threat_class, min(us) as first_us, max(us) as last_us, count(*) as occurrence_count,
    round(cast(max(confidence) as double), 6) as max_confidence, arg_min(severity, (us, severity)) as severity from ru
      group by src_ip, dst_ip, label, run)
"""


def _decided_by_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions where the supervised model calls everything benign at 0.9: what the rules alone find."""
    return pipeline.decide(_vectors(spark, folder), F.lit("BENIGN"), F.lit(0.9), F.lit(1.0))


def pipeline_rules(spark: SparkSession, folder: str) -> DataFrame:
    """From deliveries to alerts without fitted models."""
    found = pipeline.to_alerts(_decided_by_rules(spark, folder))
    return found.select(
        "src_ip", "dst_ip", "threat_class", "first_us", "last_us", "occurrence_count",
        F.round("max_confidence", 6).alias("max_confidence"), "severity"
    )


def run_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report of that run."""
    decided = cut(_decided_by_rules(spark, folder), "decided")
    return pipeline.report(normalize(read_table(spark, folder, "net_events")), decided, pipeline.to_alerts(decided))


def pipeline_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """From deliveries to alerts with models: a forest and an anomaly detector are fitted on the vectors of the run, labelled
    by the detectors, and applied to all of them. (flow_vectors has other distributions: a forest fitted there calls nearly
    every flow of net_events a beacon.)"""
    v = cut(_vectors(spark, folder), "run-vectors")
    found = v.withColumn("found", detectors.detect(F.col("src_port"), F.col("dst_port")))
    train = found.select(*features.ORDER, F.coalesce(detectors.first_fired(F.col("found"))["class"], F.lit("BENIGN")).alias("label"))
    forest = models.random_forest(train, features.ORDER, "label")
    calm = train.where("label = 'BENIGN'").select(*features.ORDER)
    odd = models.isolation_forest(calm, features.ORDER, trees=100)
    threshold = models.contamination_threshold(models.anomaly_scores(calm, odd, features.ORDER), 0.01)
    scored = models.anomaly_scores(models.classify(forest, v), odd, features.ORDER)
    names = {"model_class": "m_class", "model_confidence": "m_confidence", "anomaly_score": "m_anomaly"}
    decided = pipeline.decide(scored.withColumnsRenamed(names), F.col("m_class"), F.col("m_confidence"), F.col("m_anomaly"), threshold)
    return pipeline.threats(pipeline.to_alerts(decided))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    feature_vectors, features_optimized, feature_agreement, pipeline_rules, run_report, pipeline_alerts
)}
SQL = {
    "features_optimized": _OPTIMIZED + " select flow_id, src_ip, dst_ip, src_port, dst_port, \"timestamp\", " + ", ".join(f"round(cast({n} as double) + 1e-9, 4) as {n}" for n in features.ORDER) + " from ov",
    "feature_agreement": _VECTORS
    + _OPTIMIZED[len(_EV.rstrip()) :]
    + ", bo as ("
    + " union all ".join(f"select '{n}' as feature, cast(v.{n} as double) as a, cast(ov.{n} as double) as b from v join ov on v.flow_id = ov.flow_id" for n in features.ORDER)
    + ") select feature, count(*) as n, round(avg(abs(a - b)) + 1e-9, 3) as mean_difference, round(max(abs(a - b)) + 1e-9, 3) as largest_difference, round(avg((abs(a - b) <= 1e-6)::int) + 1e-9, 3) as agreement from bo group by feature",
    "pipeline_rules": _RULES + " select * from al",
    "run_report": _RULES
    + """, re as (select count(*) as n_events, count(distinct flow_id) as n_flows, greatest(0.0001,
      (max(us) - min(us)) / 1000000) as seconds from ev),
  rd as (select count(*) as n_decisions, count(*) filter (label <> 'BENIGN') as n_triggered,
    count(*) filter (label = 'BENIGN') as n_bypassed from sv),
  ra as (select count(*) as n_alerts, count(*) filter (threat_class <> 'BENIGN') as n_threats,
    count(*) filter (threat_class not in ('BENIGN', 'UNKNOWN_ANOMALY')) as n_known, count(*) filter (threat_class = 'UNKNOWN_ANOMALY') as n_novel,
    count(*) filter (threat_class <> 'BENIGN' and severity in ('CRITICAL', 'HIGH')) as n_severe from al)
  select * exclude (seconds), round_even(n_events / seconds, 6) as events_per_second, round_even(n_flows / seconds, 6) as flows_per_second,
    round_even(greatest(0.0, 1 - n_alerts / greatest(n_decisions, 1)), 4) as dedup_savings from re, rd, ra""",
    "feature_vectors": _VECTORS + " select flow_id, src_ip, dst_ip, src_port, dst_port, \"timestamp\", " + ", ".join(f"round(cast({n} as double) + 1e-9, 4) as {n}" for n in ["window_duration_sec", *features.ORDER]) + " from v",
}
