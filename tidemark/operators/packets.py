"""Flow features of the packet generation: flags, timing, sizes and names of each flow's packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series, text
from tidemark.operators.windows import last_rows


def ingest_stats(packets: DataFrame) -> DataFrame:
    """One row: packets, valid and malformed ones, bytes, first and last time, packets and megabits a second."""
    span = F.greatest(F.lit(1e-3), F.max("ts") - F.min("ts"))
    ok = F.col("status") == "ok"
    return packets.agg(
        F.count(F.lit(1)).alias("n_packets"), F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_malformed"),
        F.sum("wire_len").alias("n_bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        (F.count(F.lit(1)) / span).alias("packets_per_second"), (F.sum("wire_len") * 8 / span / 1e6).alias("megabits_per_second")
    )


def vectors(packets: DataFrame, keep: int = 1000) -> DataFrame:
    """33 features per flow (source, destination, ports, protocol) from its packets; the last `keep` serve timing and sizes."""
    key = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    c = F.col
    tcp = c("protocol") == "TCP"
    rows = packets.select(
        *key, F.floor(c("ts") * 1_000_000 + 0.5).alias("us"), "syn", "ack", "fin", "rst", "psh", "wire_len", "dns_query",
        "dns_type", "sni", F.monotonically_increasing_id().alias("seq")
    )
    n_tcp = F.greatest(F.lit(1), F.count_if(tcp))
    share = lambda x, n: (F.count_if(tcp & x) / n_tcp).alias(n)
    base = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("wire_len").alias("outbound_bytes_total"), ((F.max("us") - F.min("us")) / 1e6).alias("span"),
        share(
            c("syn") & ~c("ack"), "syn_ratio"
        ), share(c("ack") & ~c("syn"), "ack_ratio"), share(c("rst"), "rst_ratio"), share(c("fin"), "fin_ratio"), share(
            c("syn") & c("ack"), "syn_ack_ratio"
        ), share(c("psh"), "psh_ratio"),
        F.max(c("sni").isNotNull().cast("double")).alias("has_tls_sni"), F.count_if(c("syn")).alias("n_syn"),
    )
    last = last_rows(rows, key, ["us", "seq"], keep).groupBy(*key).agg(
        F.array_sort(F.collect_list("us")).alias("times"), F.collect_list("wire_len").alias("sizes")
    )
    gaps = F.col("gaps")
    timing = last.select(*key, "sizes", series.gaps(c("times")).alias("gaps"))
    m = series.moments(gaps)
    timing = timing.select(
        *key, *[m[k].alias(k) for k in ("iat_mean", "iat_std", "iat_cv")], series.skewness(gaps).alias("iat_skewness"),
        series.spectral_peak(gaps, 8).alias("fft_peak_magnitude"), series.autocorrelation_peak(gaps).alias("autocorr_max_peak"),
        (series.total(F.transform("sizes", lambda x: x.cast("double"))) / F.size("sizes")).alias("pkt_size_mean"),
        series.value_entropy(c("sizes")).alias("pkt_size_entropy")
    )
    sources = rows.groupBy("dst_ip").agg(F.countDistinct("src_ip").alias("unique_src_ips"))
    by_source = rows.groupBy("dst_ip", "src_ip").agg(F.count(F.lit(1)).alias("k"))
    total = by_source.groupBy("dst_ip").agg(
        F.log2(F.sum("k")).alias("h"), (F.sum(c("k") * F.log2("k")) / F.sum("k")).alias("g")
    ).select("dst_ip", (c("h") - c("g")).alias("src_ip_entropy"))
    hosts = rows.groupBy("src_ip").agg(F.countDistinct("dst_port").alias("unique_dst_ports"), F.countDistinct("dst_ip").alias("unique_dst_hosts"))
    q = c("dns_query")
    names = rows.where(q.isNotNull()).groupBy("src_ip").agg(
        F.avg(F.length(q)).alias("dns_query_len_mean"), F.avg(text.shannon_entropy(q)).alias("dns_entropy_mean"),
        F.avg(c("dns_type").isin("TXT", "NULL", "ANY").cast("double")).alias("dns_txt_ratio"),
        F.avg(text.bigram_log_likelihood(q)).alias("dns_ngram"),
        F.avg(text.letter_ratios(q)["consonant_ratio"]).alias("dns_consonant_ratio"),
        F.avg(text.letter_ratios(q)["digit_ratio"]).alias("dns_digit_ratio")
    )
    v = base.join(timing, key).join(sources, "dst_ip").join(total, "dst_ip").join(hosts, "src_ip").join(names, "src_ip", "left")
    dur, whole = F.greatest(F.lit(1e-3), c("span")), F.greatest(F.lit(1.0), c("span"))
    v = v.withColumns({
        "packet_rate": c("n") / dur, "byte_rate": c("outbound_bytes_total") / dur,
        "byte_velocity": c("outbound_bytes_total") / dur, "flow_duration_sec": dur,
        "dst_port_fanout": c("unique_dst_ports") / whole, "dst_host_fanout": c("unique_dst_hosts") / whole,
        "connection_attempt_rate": c("n_syn") / whole
    })
    return v.na.fill(0.0).drop("n", "span", "n_syn")


# Per class three conditions; a class is claimed with the share of them that holds, from two thirds (0.67) on.
RULES = {
    "dns_dga": (("dns_entropy_mean", ">", 3.5), ("dns_txt_ratio", ">", 0.6), ("dns_ngram", "<", -5.0)),
    "c2_beacon": (("iat_cv", "<", 0.15), ("iat_mean", ">", 0.1), ("fft_peak_magnitude", ">", 0.05)),
}


def predict(v: DataFrame, model_class: Column, model_confidence: Column) -> DataFrame:
    """`v` with prediction, confidence and method: a rule overrides the model where it is surer, DNS before beacons."""
    out_class, out_confidence, method = model_class, model_confidence, F.lit("MODEL_BASED")
    for name, rules in reversed(RULES.items()):
        holds = sum(((F.col(f) > t) if op == ">" else (F.col(f) < t)).cast("int") for f, op, t in rules)
        score = F.bround(holds / len(rules), 4)
        wins = (holds / len(rules) >= 0.67) & (score > model_confidence)
        out_class, out_confidence, method = F.when(wins, name).otherwise(out_class), F.when(wins, score).otherwise(out_confidence), F.when(
            wins, "RULE_BASED"
        ).otherwise(method)
    return v.withColumns({"prediction": out_class, "confidence": F.bround(out_confidence, 4), "method": method})


def of_events(events: DataFrame) -> DataFrame:
    """Normalized events seen as packets, one each: flags by connection state, length by the bytes of both directions."""
    c = F.col
    state = F.coalesce("conn_state", F.lit(""))
    tls = c("event_type") == "tls"
    return events.select(
        (c("us") / 1e6).alias("ts"), F.lit("ok").alias("status"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        state.startswith("S").alias("syn"), (state == "SF").alias("ack"), (state == "SF").alias("fin"), state.startswith("R").alias("rst"), (c("resp_bytes") > 0).alias("psh"),
        (c("orig_bytes") + c("resp_bytes")).cast("int").alias("wire_len"), F.when(
            ~F.coalesce(tls, F.lit(False)), c("query_name")
        ).alias("dns_query"), F.lit("A").alias("dns_type"), F.when(tls, c("query_name")).alias("sni"),
    )


def heuristics(v: DataFrame) -> DataFrame:
    """Class by rules of three conditions each (all three must hold), else null."""
    c = F.col
    rules = {
        "DDOS": (c("syn_ratio") > 0.8) & (c("packet_rate") > 100) & (c("src_ip_entropy") > 2),
        "PORT_SCAN": (c("unique_dst_ports") > 10) & (c("syn_ratio") > 0.5) & (c("dst_port_fanout") > 5),
        "DGA_DNS_TUNNELLING": (c("dns_entropy_mean") > 3.5) & (c("dns_query_len_mean") > 20) & (c("dns_txt_ratio") > 0.5),
        "C2_BEACONING": (c("iat_cv") < 0.15) & (c("iat_mean") > 0.5) & (c("autocorr_max_peak") >= 0),
        "DATA_EXFILTRATION": (c("outbound_bytes_total") > 50_000) & (c("byte_rate") > 10_000) & (c("pkt_size_mean") > 1000),
    }
    return v.withColumn("heuristic", F.coalesce(*[F.when(cond, k) for k, cond in rules.items()]))
