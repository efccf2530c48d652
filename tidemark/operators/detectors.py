"""Threshold detectors, the fast gate, the fusion tables, severity and evidence: Column logic over feature columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """The default thresholds of the detectors."""

    ddos_packet_rate: float = 50.0
    ddos_syn_ratio: float = 0.80
    ddos_src_entropy: float = 2.50
    ddos_in_degree: float = 5.0
    ddos_udp_rate: float = 50.0
    ddos_amplification: float = 3.0
    scan_ports: float = 10.0
    scan_port_fanout: float = 2.0
    scan_hosts: float = 8.0
    scan_host_fanout: float = 2.0
    scan_attempts: float = 15.0
    scan_failed_ratio: float = 0.60
    dns_entropy: float = 3.40
    dns_ngram: float = -4.50
    dns_length: float = 15.0
    dns_txt_ratio: float = 0.50
    dns_frequency: float = 5.0
    dns_burst_entropy: float = 3.0
    c2_min_count: float = 5.0
    c2_cv: float = 0.15
    c2_cv_frequent: float = 0.30
    c2_periodicity: float = 0.08
    c2_iat_mean: float = 0.50
    c2_frequency: float = 2.0
    exfil_ratio: float = 8.0
    exfil_asymmetry: float = 0.75
    exfil_bytes: float = 25_000.0
    exfil_rate: float = 10_000.0
    exfil_server_ports: tuple = (80, 443, 8080, 53)
    exfil_server_bytes: float = 100_000.0
    enc_ports: tuple = (443, 8443)
    enc_direction: float = 0.90
    enc_size_entropy: float = 1.0


#: detector -> (class, priority in the fusion)
CLASSES = {
    "ddos": ("DDOS", 6), "scan": ("PORT_SCAN", 4), "dns": ("DGA_DNS_TUNNELLING", 3), "c2": ("C2_BEACONING", 2),
    "exfil": ("DATA_EXFILTRATION", 1), "encrypted": ("ENCRYPTED_MALWARE", 5)
}


def indicators(src_port: Column, dst_port: Column, t: Thresholds = Thresholds()) -> dict[str, list[tuple[Column, float, Column]]]:
    """For each detector its indicators: (condition, score, reason)."""
    c = F.col
    say = F.format_string
    server = src_port.isin(*t.exfil_server_ports) & (c("outbound_bytes") < t.exfil_server_bytes)
    big = ~F.coalesce(server, F.lit(False)) & (c("outbound_bytes") >= t.exfil_bytes)
    open_tls = (c("tls_version_num") > 0) & (c("has_tls_sni") == 0)
    return {
        "ddos": [
            (
                (c("syn_ratio") >= t.ddos_syn_ratio) & ((c("src_ip_entropy") >= t.ddos_src_entropy) | (c("dst_in_degree") >= t.ddos_in_degree)),
                0.95,
                say("SYN flood from many sources: SYN ratio %.2f, source entropy %.2f bits", c("syn_ratio"), c("src_ip_entropy"))
            ),
            (c("packet_rate") >= t.ddos_packet_rate, 0.85, say("packet rate %.1f/s", c("packet_rate"))),
            (
                (c("udp_rate") >= t.ddos_udp_rate) & (c("byte_amplification_ratio") > t.ddos_amplification), 0.90,
                say("UDP amplification %.1fx at %.1f packets/s", c("byte_amplification_ratio"), c("udp_rate"))
            ),
        ],
        "scan": [
            (
                (c("unique_dst_ports") >= t.scan_ports) & (c("dst_port_fanout") >= t.scan_port_fanout), 0.92,
                say("%.0f ports probed, %.2f/s", c("unique_dst_ports"), c("dst_port_fanout"))
            ),
            (
                (c("unique_dst_hosts") >= t.scan_hosts) & (c("dst_host_fanout") >= t.scan_host_fanout), 0.88,
                say("%.0f hosts swept, %.2f/s", c("unique_dst_hosts"), c("dst_host_fanout"))
            ),
            (
                (c("conn_attempts") >= t.scan_attempts) & (c("failed_conn_ratio") >= t.scan_failed_ratio), 0.85,
                say("%.0f attempts, %.2f of them failed", c("conn_attempts"), c("failed_conn_ratio"))
            ),
        ],
        "dns": [
            (
                ((c("shannon_entropy_mean") >= t.dns_entropy) | (c("ngram_log_likelihood") <= t.dns_ngram)) & (c("query_len_mean") >= t.dns_length),
                0.90, say("generated names: entropy %.2f bits, length %.1f", c("shannon_entropy_mean"), c("query_len_mean"))
            ),
            (c("txt_record_ratio") >= t.dns_txt_ratio, 0.93, say("TXT share %.2f", c("txt_record_ratio"))),
            (
                (c("query_frequency") >= t.dns_frequency) & (c("query_len_mean") >= t.dns_length) & (c("shannon_entropy_mean") >= t.dns_burst_entropy),
                0.80, say("%.1f queries/s", c("query_frequency"))
            ),
        ],
        "c2": [
            (
                (c("repeated_conn_count") >= t.c2_min_count) & ((c("iat_cv") <= t.c2_cv) | (c("periodicity_score") >= t.c2_periodicity)) & (c("iat_mean") >= t.c2_iat_mean),
                0.88, say("heartbeat: interval %.3f s, variation %.4f", c("iat_mean"), c("iat_cv"))
            ),
            (
                (c("repeated_dst_freq") >= t.c2_frequency) & (c("repeated_conn_count") >= t.c2_min_count) & (c("iat_cv") <= t.c2_cv_frequent) & (c("periodicity_score") >= t.c2_periodicity) & (c("iat_mean") >= t.c2_iat_mean),
                0.75, say("%.1f check-ins/min", c("repeated_dst_freq"))
            ),
        ],
        "exfil": [
            (
                big & (c("out_in_byte_ratio") >= t.exfil_ratio) & (c("asymmetric_traffic_score") >= t.exfil_asymmetry), 0.90,
                say("%.0f bytes out, ratio %.1f", c("outbound_bytes"), c("out_in_byte_ratio"))
            ),
            (big & (c("outbound_rate") >= t.exfil_rate), 0.85, say("%.0f bytes/s out", c("outbound_rate"))),
        ],
        "encrypted": [
            (dst_port.isin(*t.enc_ports) & open_tls, 0.75, F.lit("TLS without a server name")),
            (
                open_tls & (c("directionality_ratio") >= t.enc_direction) & (c("pkt_size_entropy") <= t.enc_size_entropy), 0.80,
                say("one-sided TLS of uniform sizes (%.2f bits)", c("pkt_size_entropy"))
            ),
        ],
    }


def detect(src_port: Column, dst_port: Column, t: Thresholds = Thresholds()) -> Column:
    """array<struct<detector, class, priority, triggered, score, n_indicators, reason>> in a fixed order."""
    results = []
    for name, found in indicators(src_port, dst_port, t).items():
        flags = [F.coalesce(cond, F.lit(False)) for cond, _, _ in found]
        n = sum((f.cast("int") for f in flags), F.lit(0))
        score = F.greatest(F.lit(0.0), *[F.when(f, s).otherwise(0.0) for f, (_, s, _) in zip(flags, found)])
        reason = F.concat_ws(" | ", *[F.when(f, r) for f, (_, _, r) in zip(flags, found)])
        cls, priority = CLASSES[name]
        results.append(F.struct(
            F.lit(name).alias("detector"), F.lit(cls).alias("class"), F.lit(priority).alias("priority"),
            (n > 0).alias("triggered"), score.alias("score"), n.alias("n_indicators"), reason.alias("reason")
        ))
    return F.array(*results)


@dataclass(frozen=True)
class GateThresholds:
    """The default thresholds of the gate (warn, critical)."""

    syn_ratio: tuple = (0.45, 0.70)
    packet_rate: tuple = (20.0, 80.0)
    ports: tuple = (3.0, 10.0)
    hosts: tuple = (3.0, 8.0)
    exfil_ratio: tuple = (8.0, 20.0)
    exfil_bytes: float = 15_000.0
    query_length: tuple = (15, 25)
    txt_ratio: tuple = (0.20, 0.35)
    c2_count: int = 4
    client_port: int = 1024
    exfil_ports: tuple = (80, 443, 8080, 22)
    tls_ports: tuple = (443, 8443)
    scores: dict = field(default_factory=lambda: {
        "ddos": (0.65, 0.95), "ports": (0.60, 0.92), "hosts": (0.60, 0.88), "dns": (0.70, 0.93), "exfil": (0.65, 0.90),
        "c2": 0.55, "tls": 0.75
    })


def gate(state: dict[str, Column], g: GateThresholds = GateThresholds()) -> dict[str, Column]:
    """decision, threat_class, urgency of a flow's cheap state.

    state: syn_ratio, packet_rate, ports, port_fanout, hosts, host_fanout, query_length (null: no query), txt_ratio,
    out_bytes, out_in_ratio, src_port, dst_port, n_times, tls, sni. Of several critical checks the last names the class.
    """
    s = state
    ddos = [(s["syn_ratio"] >= g.syn_ratio[k]) | (s["packet_rate"] >= g.packet_rate[k]) for k in (0, 1)]
    ports = (s["ports"] >= g.ports[1]) | (s["port_fanout"] >= g.ports[1])
    hosts = (s["hosts"] >= g.hosts[1]) | (s["host_fanout"] >= g.hosts[1])
    probe = (s["ports"] >= g.ports[0]) | (s["hosts"] >= g.hosts[0])
    dns = [s["query_length"].isNotNull() & ((s["query_length"] >= g.query_length[k]) | (s["txt_ratio"] >= g.txt_ratio[k])) for k in (0, 1)]
    client = (s["src_port"] > g.client_port) & s["dst_port"].isin(*g.exfil_ports) & (s["out_bytes"] >= g.exfil_bytes)
    exfil = [client & (s["out_in_ratio"] >= g.exfil_ratio[k]) for k in (0, 1)]
    c2 = s["n_times"] >= g.c2_count
    tls = s["tls"] & ~s["sni"] & s["dst_port"].isin(*g.tls_ports)
    no = F.lit(False)
    f = lambda x: F.coalesce(x, no)
    critical = F.coalesce(
        F.when(f(exfil[1]), "DATA_EXFILTRATION"), F.when(f(dns[1]), "DGA_DNS_TUNNELLING"),
        F.when(f(ports) | f(hosts), "PORT_SCAN"), F.when(f(ddos[1]), "DDOS")
    )
    w = g.scores
    level = lambda pair, hit: F.when(f(hit[1]), pair[1]).when(f(hit[0]), pair[0]).otherwise(0.0)
    recon = F.when(f(ports), w["ports"][1]).when(f(hosts), w["hosts"][1]).when(f(probe), w["ports"][0]).otherwise(0.0)
    urgency = F.greatest(
        level(w["ddos"], ddos), recon, level(w["dns"], dns), level(w["exfil"], exfil), F.when(f(c2), w["c2"]).otherwise(0.0),
        F.when(f(tls), w["tls"]).otherwise(0.0)
    )
    decision = F.when(critical.isNotNull(), "CRITICAL_RULE").when(urgency > 0, "SUSPICIOUS").otherwise("PASS_NORMAL")
    return {"decision": decision, "threat_class": F.when(decision == "PASS_NORMAL", "BENIGN").otherwise(critical), "urgency": urgency}


def first_fired(results: Column) -> Column:
    """The fired detector of the highest priority, null without any."""
    fired = F.filter(results, lambda r: r["triggered"])
    ordered = F.array_sort(F.transform(
        fired, lambda r: F.struct(r["priority"].alias("priority"), r["class"].alias("class"), r["score"].alias("score"))
    ))
    return F.get(ordered, F.lit(0))


def anomaly_bypass(results: Column, model_class: Column, model_confidence: Column) -> Column:
    """Whether the anomaly detector isn't asked: a known threat, or a benign flow that no detector speaks against."""
    calm = (model_class == "BENIGN") & (model_confidence >= 0.85) & first_fired(results).isNull()
    return ((model_class != "BENIGN") & (model_confidence >= 0.75)) | calm


def fuse(
    results: Column, model_class: Column, model_confidence: Column, anomaly: Column, anomalous: Column, threshold: float = 0.0
) -> dict[str, Column]:
    """label, state, confidence, method by the ordered decision table of the production engine."""
    top = first_fired(results)
    known = (model_class != "BENIGN") & (model_confidence >= 0.75)
    odd = anomalous & ~anomaly_bypass(results, model_class, model_confidence)
    rule = top.isNotNull() & ((model_confidence < 0.75) | (model_class == "BENIGN") | (top["class"] == model_class))
    same = F.exists(results, lambda r: r["triggered"] & (r["class"] == model_class))
    confirmed = known & (odd | same)
    label = F.when(rule, top["class"]).when(known, model_class).when(odd, "UNKNOWN_ANOMALY").otherwise("BENIGN")
    state = F.when(rule, "B").when(confirmed, "A").when(known, "B").when(odd, "C").otherwise("D")
    confidence = (
        F.when(rule, F.greatest(F.lit(0.85), top["score"]))
        .when(confirmed, F.least(F.lit(1.0), F.greatest(model_confidence, F.lit(0.92))))
        .when(known, model_confidence)
        .when(odd, F.least(F.lit(1.0), 0.60 + F.abs(anomaly - threshold) / 0.5))
        .otherwise(F.when(model_class == "BENIGN", model_confidence).otherwise(1 - model_confidence))
    )
    method = F.when(rule, "BEHAVIORAL_RULE").when(confirmed, "HYBRID").when(
        known, "MODEL_SUPERVISED"
    ).when(odd, "MODEL_ANOMALY").otherwise("MODEL_SUPERVISED")
    return {"label": label, "state": state, "confidence": confidence, "method": method}


def fuse_gated(
    gated: dict[str, Column], results: Column, model_class: Column, model_confidence: Column, anomaly: Column, anomalous: Column
) -> dict[str, Column]:
    """The selective variant: a critical gate decides alone; detectors count only when the gate isn't passed, in list order."""
    critical = gated["decision"] == "CRITICAL_RULE"
    fired = F.get(F.filter(results, lambda r: r["triggered"]), F.lit(0))
    top = F.when(gated["decision"] != "PASS_NORMAL", fired)
    rule = top.isNotNull() & ((model_confidence < 0.75) | (model_class == "BENIGN") | (top["class"] == model_class))
    known = (model_class != "BENIGN") & (model_confidence >= 0.75)
    bypass = (model_class != "BENIGN") & (model_confidence >= 0.80)
    odd = anomalous & ~bypass
    label = F.when(critical, gated["threat_class"]).when(rule, top["class"]).when(known, model_class).when(odd, "UNKNOWN_ANOMALY").otherwise("BENIGN")
    state = F.when(critical | rule, "B").when(known & odd, "A").when(known, "B").when(odd, "C").otherwise("D")
    confidence = (
        F.when(critical, F.greatest(F.lit(0.90), gated["urgency"]))
        .when(rule, F.greatest(F.lit(0.85), top["score"]))
        .when(known & odd, F.least(F.lit(1.0), F.greatest(model_confidence, F.lit(0.92))))
        .when(known, model_confidence)
        .when(odd, F.least(F.lit(1.0), 0.60 + 2 * F.greatest(F.lit(0.0), -anomaly)))
        .otherwise(F.greatest(F.lit(0.90), model_confidence))
    )
    return {"label": label, "state": state, "confidence": confidence}


def fuse_unordered(
    results: Column, model_class: Column, model_confidence: Column, anomaly: Column, anomalous: Column, threshold: float = 0.0
) -> dict[str, Column]:
    """The variant of side-by-side comparisons: fired detectors in list order, no priorities, and no bypass of the anomaly
    detector; the first of them that may override the model does."""
    fired = F.filter(results, lambda r: r["triggered"])
    top = F.get(F.filter(fired, lambda r: (model_confidence < 0.75) | (model_class == "BENIGN") | (r["class"] == model_class)), F.lit(0))
    known = (model_class != "BENIGN") & (model_confidence >= 0.75)
    confirmed = known & (anomalous | F.exists(fired, lambda r: r["class"] == model_class))
    odd = anomalous | (F.size(fired) > 0)
    rule = top.isNotNull()
    label = F.when(rule, top["class"]).when(known, model_class).when(odd, "UNKNOWN_ANOMALY").otherwise("BENIGN")
    state = F.when(rule, "B").when(confirmed, "A").when(known, "B").when(odd, "C").otherwise("D")
    confidence = (
        F.when(rule, F.greatest(F.lit(0.85), top["score"]))
        .when(confirmed, F.least(F.lit(1.0), F.greatest(model_confidence, F.lit(0.92))))
        .when(known, model_confidence)
        .when(odd, F.least(F.lit(1.0), 0.60 + F.abs(anomaly - threshold) / 0.5))
        .otherwise(F.when(model_class == "BENIGN", model_confidence).otherwise(1 - model_confidence))
    )
    method = F.when(rule, "BEHAVIORAL_RULE").when(confirmed, "HYBRID").when(
        known, "MODEL_SUPERVISED"
    ).when(odd, "MODEL_ANOMALY").otherwise("MODEL_SUPERVISED")
    return {"label": label, "state": state, "confidence": F.bround(confidence, 4), "method": method}


def severity(label: Column, confidence: Column) -> Column:
    """INFO to CRITICAL by class, confidence and volume."""
    c = F.col
    return (
        F.when(label == "BENIGN", "INFO")
        .when(label == "DDOS", F.when((c("packet_rate") >= 500) | (c("dst_in_degree") >= 20) | (confidence >= 0.90), "CRITICAL").otherwise("HIGH"))
        .when(
            label == "DATA_EXFILTRATION",
            F.when((c("outbound_bytes") >= 10_000_000) | (c("outbound_rate") >= 100_000), "CRITICAL").otherwise("HIGH")
        )
        .when(label == "C2_BEACONING", F.when((confidence >= 0.85) | (c("periodicity_score") >= 0.20), "CRITICAL").otherwise("HIGH"))
        .when(label == "PORT_SCAN", F.when((c("unique_dst_ports") >= 25) | (c("dst_port_fanout") >= 10), "HIGH").otherwise("MEDIUM"))
        .when(label.isin("DGA_DNS_TUNNELLING", "ENCRYPTED_MALWARE"), F.when(confidence >= 0.80, "HIGH").otherwise("MEDIUM"))
        .when(label == "UNKNOWN_ANOMALY", F.when(confidence >= 0.70, "MEDIUM").otherwise("LOW"))
        .otherwise("LOW")
    )


#: For each class the evidence as (condition, text, its values, what the snapshot keeps).
_EVIDENCE = {
    "DDOS": [
        ("syn_ratio > 0.5", "SYN share %.3f", ["syn_ratio"], ["syn_ratio"]),
        ("packet_rate > 10", "%.1f packets/s", ["packet_rate"], ["packet_rate"]),
        ("src_ip_entropy > 1.5", "source entropy %.2f bits", ["src_ip_entropy"], ["src_ip_entropy"]),
        ("unique_src_count > 5 or dst_in_degree > 5", "in-degree %.0f", ["dst_in_degree"], ["dst_in_degree"]),
        ("udp_rate > 10", "%.1f UDP packets/s, amplified %.1f times", ["udp_rate", "byte_amplification_ratio"], ["udp_rate"]),
    ],
    "PORT_SCAN": [
        ("unique_dst_ports > 1", "%.0f ports", ["unique_dst_ports"], ["unique_dst_ports"]),
        ("dst_port_fanout > 0.5", "%.2f ports/s", ["dst_port_fanout"], ["dst_port_fanout"]),
        ("unique_dst_hosts > 1", "%.0f hosts, out-degree %.0f", ["unique_dst_hosts", "src_out_degree"], ["unique_dst_hosts"]),
        ("conn_attempts > 1", "%.0f attempts, %.3f of them failed", ["conn_attempts", "failed_conn_ratio"], ["conn_attempts", "failed_conn_ratio"]),
    ],
    "DGA_DNS_TUNNELLING": [
        ("shannon_entropy_mean > 2.5", "entropy %.2f bits", ["shannon_entropy_mean"], ["shannon_entropy_mean"]),
        ("query_len_mean > 15", "length %.1f", ["query_len_mean"], ["query_len_mean"]),
        ("txt_record_ratio > 0.2", "TXT share %.3f", ["txt_record_ratio"], ["txt_record_ratio"]),
        ("ngram_log_likelihood < -3", "log-likelihood %.2f", ["ngram_log_likelihood"], ["ngram_log_likelihood"]),
        ("query_frequency > 1", "%.1f queries/s", ["query_frequency"], ["query_frequency"]),
    ],
    "C2_BEACONING": [
        ("iat_mean > 0", "interval %.3f s", ["iat_mean"], ["iat_mean"]),
        ("iat_cv < 0.30", "variation %.4f", ["iat_cv"], ["iat_cv"]),
        ("periodicity_score > 0.05", "periodicity %.3f", ["periodicity_score"], ["periodicity_score"]),
        ("repeated_conn_count > 1", "%.0f connections, %.1f a minute", ["repeated_conn_count", "repeated_dst_freq"], ["repeated_conn_count"]),
    ],
    "DATA_EXFILTRATION": [
        ("true", "%.0f bytes out, %.0f in", ["outbound_bytes", "inbound_bytes"], ["outbound_bytes"]),
        ("true", "ratio %.1f, asymmetry %+.2f", ["out_in_byte_ratio", "asymmetric_traffic_score"], ["out_in_byte_ratio", "asymmetric_traffic_score"]),
        ("outbound_rate > 1000", "%.0f bytes/s out", ["outbound_rate"], []),
    ],
    "ENCRYPTED_MALWARE": [
        ("tls_version_num > 0", "TLS %.1f", ["tls_version_num"], ["tls_version_num"]),
        ("has_tls_sni = 0", "no server name", [], ["has_tls_sni"]),
        ("pkt_size_entropy > 0", "size entropy %.2f bits, mean size %.1f", ["pkt_size_entropy", "pkt_size_mean"], ["pkt_size_entropy"]),
    ],
    "UNKNOWN_ANOMALY": [("packet_rate > 10", "%.1f packets/s", ["packet_rate"], [])],
}
#: what an alert of each class says first
_REASONS = {
    "DDOS": "flood of traffic at a host", "PORT_SCAN": "ports or hosts probed by a source", "DGA_DNS_TUNNELLING": "generated names or data in DNS queries",
    "C2_BEACONING": "regular check-ins with a host", "DATA_EXFILTRATION": "much more data out than in", "ENCRYPTED_MALWARE": "TLS without a server name",
    "UNKNOWN_ANOMALY": "unlike ordinary traffic, of no known class",
}


def primary_reason(label: Column, confidence: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _REASONS.items() for x in pair])
    return F.coalesce(F.format_string("%s (confidence %.1f%%)", F.try_element_at(table, label), confidence * 100), F.lit("ordinary session"))


def evidence(label: Column, results: Column | None = None, anomaly: Column | None = None, threshold: float = 0.0) -> tuple[Column, Column]:
    """Texts (array) and values (map) that speak for the label, then what each fired detector says, if not said yet."""
    score = F.lit(None).cast("double") if anomaly is None else anomaly
    texts = F.array(F.lit("ordinary two-way traffic"))
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("double").alias("v"))
    values = F.array().cast("array<struct<k: string, v: double>>")
    for name, rules in _EVIDENCE.items():
        said = [F.when(F.expr(cond), F.format_string(words, *[F.col(f) for f in fields])) for cond, words, fields, _ in rules]
        kept = [F.when(F.expr(cond), entry(k, F.col(k))) for cond, _, _, keys in rules for k in keys]
        if name == "UNKNOWN_ANOMALY" and anomaly is not None:
            said.insert(0, F.format_string("anomaly score %.6f, threshold %.6f", score, F.lit(threshold)))
            kept.append(entry("anomaly_score", score))
        texts = F.when(label == name, F.array_compact(F.array(*said))).otherwise(texts)
        values = F.when(
            label == name, F.array_compact(F.array(*kept)) if kept else F.array().cast("array<struct<k: string, v: double>>")
        ).otherwise(values)
    if results is not None:
        fired = F.transform(F.filter(results, lambda r: r["triggered"]), lambda r: F.concat(F.lit("["), r["class"], F.lit("] "), r["reason"]))
        texts = F.array_distinct(F.concat(texts, fired))
    return texts, F.map_from_entries(values)
