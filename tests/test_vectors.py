import json
import math
from collections import Counter, defaultdict, deque

import numpy as np
import pytest

from tidemark.functions.text import BIGRAMS, FLOOR
from tidemark.operators import features
from tidemark.operators.events import FAILED, normalize
from tidemark.session import read_table
from tidemark.sources import eve, zeek

CHECKED = """iat_min iat_max iat_mean iat_std iat_cv periodicity_score repeated_dst_freq repeated_conn_count query_len_mean shannon_entropy_mean
vowel_ratio digit_ratio unique_char_ratio subdomain_depth_mean query_frequency ngram_log_likelihood pkt_size_mean pkt_size_std pkt_size_entropy failed_conn_ratio""".split()


def entropy(values):
    n = len(values)
    return -sum(k / n * math.log2(k / n) for k in Counter(values).values()) if n else 0.0


def likelihood(name):
    label = name.lower().split(".")[0]
    return float(np.mean([math.log(BIGRAMS.get(label[k : k + 2], FLOOR)) for k in range(len(label) - 1)])) if len(label) > 1 else 0.0


def fold(events, keep):
    """Event by event in order of time: the vector of a flow is what is known right after its latest event."""
    pairs, flows, out = defaultdict(lambda: deque(maxlen=keep)), {}, {}
    for r in sorted(events, key=lambda r: (r.us, r.seq)):
        f = flows.setdefault(
            r.flow_id,
            {
                "first": r.us, "times": deque(maxlen=500), "sizes": deque(maxlen=500), "states": deque(maxlen=100),
                "names": deque(maxlen=100), "duration": 0.0, "bytes": 0, "pkts": 0, "n": 0
            }
        )
        pair = pairs[r.src_ip, r.dst_ip]
        pair.append(r.us)
        f["n"] += 1
        f["duration"] = max(f["duration"], r.duration)
        f["bytes"] += r.orig_bytes + r.resp_bytes
        f["pkts"] += r.orig_pkts + r.resp_pkts
        if r.event_type != "tls":
            f["times"].append(r.us)
        f["sizes"].extend(x for x in (r.orig_bytes, r.resp_bytes) if x > 0)
        if r.conn_state:
            f["states"].append(r.conn_state)
        if r.event_type == "dns" and r.query_name:
            f["names"].append(r.query_name)
        out[r.flow_id] = r.us, list(pair), {k: list(v) if isinstance(v, deque) else v for k, v in f.items()}
    return {k: vector(*v) for k, v in out.items()}


def vector(now, pair, f):
    own = len(f["times"]) >= 3
    times = f["times"] if own else pair
    v = dict.fromkeys(CHECKED, 0.0)
    g = np.diff(np.array(times)) / 1e6
    g = g[g > 0]
    if len(times) >= 3 and len(g) >= 2:
        v |= {"iat_min": g.min(), "iat_max": g.max(), "iat_mean": g.mean(), "iat_std": g.std(), "iat_cv": g.std() / max(1e-5, g.mean())}
        if len(g) >= 6:
            a = np.abs(np.fft.rfft(g - g.mean()))[1:]
            v["periodicity_score"] = a.max() / a.sum() if a.sum() > 1e-6 else 0.0
    elapsed = max(1.0, (now - (f["first"] if own else pair[0])) / 1e6)
    v |= {"repeated_conn_count": len(pair), "repeated_dst_freq": len(pair) / (elapsed / 60)}
    names, text = f["names"], "".join(f["names"]).lower()
    dur = max(1e-3, f["duration"] or (now - f["first"]) / 1e6)
    if names:
        letters = [c for c in text if c.isalpha()]
        v |= {
            "query_len_mean": np.mean([len(x) for x in names]), "shannon_entropy_mean": np.mean([entropy(x) for x in names]),
            "subdomain_depth_mean": np.mean([x.count(".") for x in names]),
            "ngram_log_likelihood": np.mean([likelihood(x) for x in names])
        }
        v |= {
            "query_frequency": len(names) / dur, "vowel_ratio": sum(c in "aeiou" for c in letters) / max(1, len(letters)),
            "digit_ratio": sum(c.isdigit() for c in text) / len(text), "unique_char_ratio": len(set(text)) / len(text)
        }
    s = f["sizes"]
    v |= {
        "pkt_size_mean": np.mean(s) if s else f["bytes"] / max(1, f["pkts"], f["n"]),
        "pkt_size_std": np.std(s) if len(s) > 1 else 0.0, "pkt_size_entropy": entropy(s)
    }
    return v | {"failed_conn_ratio": sum(x in FAILED for x in f["states"]) / max(1, len(f["states"]))}


def compare(events, keep=500):
    want = fold(events.collect(), keep)
    got = {r.flow_id: r for r in features.vectors(events, keep).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert {n: got[k][n] for n in CHECKED} == pytest.approx(v, rel=1e-6, abs=1e-9), k


def test_vectors_against_a_fold(spark, data):
    compare(normalize(read_table(spark, data, "net_events")))


def test_long_histories_against_a_fold(spark):
    draw = np.random.default_rng(3)
    rows = []
    for k in range(1500):
        kind = ["connection", "connection", "dns", "tls", "http"][draw.integers(5)]
        conn, flow = kind == "connection", "hot" if k % 2 else f"f{draw.integers(300)}"
        size = [int(draw.integers(3)) * 100 if conn else 0 for _ in range(4)]
        rows.append((f"e{k}", k, 1e9 + int(draw.integers(4000)), kind, "s", "10.0.0.1", f"10.0.1.{k % 2}", 1, 2, "tcp", flow, 0.0, *size, ["S0", "SF", "REJ"][draw.integers(3)] if conn else None, None, f"ab{k}.example" if kind in ("dns", "tls") else None))
    df = spark.createDataFrame(
        rows,
        "event_id string, row_id bigint, timestamp double, event_type string, sensor_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, flow_id string, duration double, orig_bytes bigint, resp_bytes bigint, orig_pkts bigint, resp_pkts bigint, conn_state string, service string, query_name string"
    )
    for keep in (500, 7):
        compare(normalize(df), keep)


def test_records_of_sensors_reach_the_vectors(spark, tmp_path):
    at = lambda *x: "\t".join(map(str, x))
    ends = ["id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p"]
    dns = zeek.header(["ts", *ends, "proto", "query", "qtype_name"], "dns") + [
        at(1724832000 + k, "10.0.0.1", 5000, "10.0.0.2", 53, "udp", "a.example", t) for k,
        t in enumerate(["TXT", "A", "NULL", "A", "A", "TXT", "ANY", "A"])
    ]
    ssl = zeek.header(["ts", *ends, "version", "server_name", "ja3"], "ssl") + [
        at(1724832000, "10.0.0.3", 1, "10.0.0.4", 443, "TLSv1.2", "b.example", "abc"),
        at(1724832001, "10.0.0.3", 1, "10.0.0.4", 443, "TLSv1.3", "-", "-"),
        at(1724832001, "10.0.0.5", 1, "10.0.0.4", 443, "TLSv1.0", "-", "-")
    ]
    conn = zeek.header(["ts", *ends, "proto", "conn_state", "history"], "conn") + [at(
        1724832000, "10.0.0.6", 1, "10.0.0.4", 80, "tcp", "OTH", "ShAD"
    )] * 2
    rows = [(f"{n}{k}", n, k, x) for n, xs in (("d", dns), ("s", ssl), ("c", conn)) for k, x in enumerate(xs)]
    events, _ = zeek.events(spark.createDataFrame(rows, "line_id string, file_name string, line_no int, raw_line string"))
    got = {r.flow_id.split(":")[0]: r for r in features.vectors(normalize(events)).collect()}
    assert got["10.0.0.1"].txt_record_ratio == 0.5
    assert [(got[f"10.0.0.{k}"].tls_version_num, got[f"10.0.0.{k}"].has_tls_sni, got[f"10.0.0.{k}"].ja3_present) for k in (3, 5, 1)] == [(1.3, 1, 1), (1.0, 0, 0), (0, 0, 0)]
    assert (got["10.0.0.6"].ack_ratio, got["10.0.0.6"].syn_ratio, got["10.0.0.6"].conn_attempts) == (1.0, 0.5, 2)
    lines = [{"timestamp": "2024-08-28T08:00:00Z", "event_type": "tls", "src_ip": f"10.0.0.{k}", "dest_ip": "10.0.1.1", "tls": {"version": v, "ja3": j}} for k, v, j in ((1, "TLS 1.2", {"hash": "abc"}), (2, "TLS 1.3", "abc"), (3, "TLS 1.3", {}))]
    lines.append({
        "timestamp": "2024-08-28T08:00:00Z", "event_type": "dns", "src_ip": "10.0.0.4", "dest_ip": "10.0.1.1",
        "dns": {"rrname": "a.b", "rrtype": "TXT"}
    })
    (tmp_path / "eve.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r.flow_id.split(":")[0]: r for r in features.vectors(normalize(eve.events(eve.read(spark, str(tmp_path / "eve.json"))))).collect()}
    assert [(got[f"10.0.0.{k}"].tls_version_num, got[f"10.0.0.{k}"].ja3_present, got[f"10.0.0.{k}"].txt_record_ratio) for k in (1, 2, 3, 4)] == [(1.2, 1, 0), (1.3, 1, 0), (1.3, 0, 0), (0, 0, 1)]
