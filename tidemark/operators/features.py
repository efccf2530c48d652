"""Feature vectors of flows as windowed selects over the normalized events.

Every row of `events` gets the values its flow, host and host pair have right after it
(the row included). A snapshot of each flow is the row with the latest time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series, text
from tidemark.operators.events import FAILED
from tidemark.operators.windows import last_rows, running_total, sliding
from tidemark.session import cut

HALF_MINUTE, MINUTE = 30_000_000, 60_000_000


def flow_totals(events: DataFrame) -> DataFrame:
    """One row per flow: counts, sums, first and last time, longest duration (map-side combined)."""
    failed = F.col("conn_state").isin(*FAILED)
    return events.groupBy("flow_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum("orig_bytes").alias("orig_bytes"),
        F.sum("resp_bytes").alias("resp_bytes"),
        F.sum("orig_pkts").alias("orig_pkts"),
        F.sum("resp_pkts").alias("resp_pkts"),
        F.max("duration").alias("duration"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.count_if(F.col("conn_state") == "S0").alias("n_s0"),
        F.count_if(failed).alias("n_failed"),
    )


# The states that speak for a SYN without answer, any SYN, an orderly end and a reset.
_MARKS = {"has_s0": ["S0"], "has_syn": ["S0", "S1", "SF"], "has_sf": ["SF"], "has_rst": ["RSTO", "RSTR", "RSTOS0"]}


def _counted() -> Column:
    """Whether an event counts as one of its flow: web and alert records don't."""
    return ~F.coalesce(F.col("event_type").isin("http", "alert"), F.lit(False))


def _volume() -> list[Column]:
    """Volume features of a flow from its totals (c_...) and the marks of its last states (has_...)."""
    c = F.col
    raw = F.when(c("c_duration") > 0, c("c_duration")).otherwise((c("us") - c("c_first")) / 1e6)
    dur, rdur = F.greatest(F.lit(1e-3), raw), F.greatest(F.lit(1.0), raw)
    packets, pk = c("c_orig_pkts") + c("c_resp_pkts"), F.greatest(c("c_orig_pkts") + c("c_resp_pkts"), c("c_events"))
    sent, got, by = c("c_orig_bytes"), c("c_resp_bytes"), c("c_orig_bytes") + c("c_resp_bytes")
    one = F.lit(1)
    syn = F.when(c("c_history").contains("S"), 1.0).otherwise(F.coalesce(c("has_syn"), F.lit(0.0)))
    features = {
        "dur": dur,
        "packet_rate": pk / rdur,
        "byte_rate": by / rdur,
        "syn_rate": syn / rdur,
        "syn_ratio": F.when(c("has_s0") == 1, 1.0).when(syn == 1, 0.5).otherwise(0.0),
        "ack_ratio": F.when(c("c_history").contains("A"), 1.0).when(c("has_sf") == 1, 0.5).otherwise(0.0),
        "rst_ratio": F.coalesce(c("has_rst"), F.lit(0.0)),
        "udp_rate": F.when(c("protocol") == "UDP", pk / dur).otherwise(0.0),
        "byte_amplification_ratio": got / F.greatest(one, sent),
        "flow_duration": dur,
        "pkt_size_mean": by / F.greatest(one, pk),
        "directionality_ratio": c("c_orig_pkts") / F.greatest(one, packets),
        "inbound_bytes": got.cast("double"),
        "outbound_bytes": sent.cast("double"),
        "out_in_byte_ratio": sent / F.greatest(one, got),
        "bytes_per_flow": by.cast("double"),
        "outbound_rate": sent / rdur,
        "asymmetric_traffic_score": (sent - got) / F.greatest(one, by),
        "has_tls_sni": F.when(c("c_sni"), 1.0).otherwise(0.0),
        "tls_version_num": text.tls_version_number(c("c_tls_version")),
        "ja3_present": F.when(c("c_ja3").isNotNull(), 1.0).otherwise(0.0),
    }
    return [v.alias(k) for k, v in features.items()]


def flow_running(events: DataFrame) -> DataFrame:
    """The events with the volume features of their flow right after each of them (running totals)."""
    c = F.col
    w = Window.partitionBy("flow_id").orderBy("us", "seq")
    upto, last100 = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-99, 0)
    some = lambda n: F.nullif(c(n), F.lit("")) if n in events.columns else F.lit(None).cast("string")
    rows = events.select(
        "*",
        *[F.last(some(n), ignorenulls=True).over(upto).alias(f"c_{n}") for n in ("history", "tls_version", "ja3")],
        F.coalesce(F.max(F.when(c("event_type") == "tls", some("query_name").isNotNull())).over(upto), F.lit(False)).alias("c_sni"),
        *[F.sum(n).over(upto).alias(f"c_{n}") for n in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")],
        F.count_if(_counted()).over(upto).alias("c_events"),
        F.max("duration").over(upto).alias("c_duration"),
        F.min("us").over(upto).alias("c_first"),
        *[F.max(c("conn_state").isin(*s).cast("double")).over(last100).alias(n) for n, s in _MARKS.items()],
    )
    return rows.select(*events.columns, c("c_first").alias("first_us"), *_volume())


def source_windows(events: DataFrame, reach_us: int = HALF_MINUTE) -> DataFrame:
    """Distinct ports and hosts a source touched, its attempts and failures within reach of each event."""
    c = F.col
    failed = F.when(c("conn_state").isNotNull(), c("conn_state").isin(*FAILED).cast("bigint"))
    sums = {"conn_attempts": F.lit(1), "__failed": failed, "__stated": c("conn_state").isNotNull().cast("bigint")}
    found = sliding(events, ["src_ip"], "us", reach_us, sums, {"unique_dst_ports": c("dst_port"), "unique_dst_hosts": c("dst_ip")})
    ratio = F.when(c("__stated") > 0, c("__failed") / c("__stated")).otherwise(0.0)
    return found.select(*events.columns, "unique_dst_ports", "unique_dst_hosts", "conn_attempts", ratio.alias("failed_conn_ratio"))


def destination_windows(events: DataFrame, reach_us: int = HALF_MINUTE) -> DataFrame:
    """Distinct sources of a destination and their entropy within reach of each event."""
    return sliding(events, ["dst_ip"], "us", reach_us, distinct={"unique_src_count": F.col("src_ip")}, entropy={"src_ip_entropy": F.col("src_ip")})


def degrees(events: DataFrame, reach_us: int = MINUTE) -> DataFrame:
    """Per event: out-degree of the source, in-degree of the destination, partners of the source in both roles, fan-out.

    Each event is seen from both ends (out at its source, in at its destination); one sliding window by host serves all.
    """
    out = events.select("seq", "us", F.col("src_ip").alias("host"), F.lit("out").alias("role"), F.col("dst_ip").alias("peer"))
    into = events.select("seq", "us", F.col("dst_ip").alias("host"), F.lit("in").alias("role"), F.col("src_ip").alias("peer"))
    peers = lambda r: F.when(F.col("role") == r, F.col("peer"))
    both = sliding(
        out.unionByName(into), ["host"], "us", reach_us, {"n_out": (F.col("role") == "out").cast("bigint")},
        {"outs": peers("out"), "ins": peers("in")}
    )
    return both.groupBy("seq").agg(
        F.max(F.when(F.col("role") == "out", F.col("outs"))).alias("src_out_degree"),
        F.max(F.when(F.col("role") == "in", F.col("ins"))).alias("dst_in_degree"),
        F.max(F.when(F.col("role") == "out", F.col("outs") + F.col("ins"))).alias("comm_partner_count"),
        F.max(F.when(F.col("role") == "out", F.col("outs") / F.greatest(F.lit(1), F.col("n_out")))).alias("graph_fanout_ratio"),
    )


def destination_share(events: DataFrame) -> DataFrame:
    """Packets to the event's destination so far among all packets so far; every event counts at least one packet."""
    packets = F.greatest(F.lit(1), F.col("orig_pkts") + F.col("resp_pkts"))
    rows = events.select("seq", "us", "dst_ip", packets.alias("p"))
    both = running_total(running_total(rows, "us", "seq", F.col("p"), "all_p"), "us", "seq", F.col("p"), "dst_p", ["dst_ip"])
    return both.select("seq", (F.col("dst_p") / F.col("all_p")).alias("dest_concentration"))


def pair_series(events: DataFrame, keep: int = 500) -> DataFrame:
    """Per (source, destination) pair the times of its last `keep` events, sorted, and their positive gaps in seconds."""
    last = last_rows(events.select("src_ip", "dst_ip", "us", "seq"), ["src_ip", "dst_ip"], ["us", "seq"], keep)
    times = last.groupBy("src_ip", "dst_ip").agg(F.array_sort(F.collect_list("us")).alias("times"))
    return times.select("*", series.gaps(F.col("times")).alias("gaps"))


def pair_timing(events: DataFrame) -> DataFrame:
    """Interval statistics, periodicity, autocorrelation and frequency of each host pair."""
    pairs = pair_series(events)
    n = F.size("times")
    span = F.greatest(F.lit(1.0), (F.element_at("times", -1) - F.element_at("times", 1)) / 1e6)
    stats = series.moments(F.col("gaps"))
    return pairs.select(
        "src_ip", "dst_ip", *[c.alias(k) for k, c in stats.items()], series.skewness(F.col("gaps")).alias("iat_skewness"),
        series.spectral_peak(F.col("gaps")).alias("periodicity_score"),
        series.autocorrelation_peak(F.col("gaps")).alias("autocorr_peak"), n.cast("bigint").alias("repeated_conn_count"),
        (n / (span / 60)).alias("repeated_dst_freq")
    )


def name_features(events: DataFrame, keep: int = 100) -> DataFrame:
    """Of each source's last `keep` DNS queries: mean length, entropy, depth, log-likelihood; TXT share; letter ratios of all together."""
    queries = last_rows(
        events.where((F.col("event_type") == "dns") & F.col("query_name").isNotNull()).select("src_ip", "us", "seq", "query_name", "service"),
        ["src_ip"], ["us", "seq"], keep
    )
    q = F.col("query_name")
    per = queries.select(
        "src_ip", "us", "seq", q, F.length(q).alias("len"), text.shannon_entropy(q).alias("ent"),
        text.subdomain_depth(q).alias("depth"), text.bigram_log_likelihood(q).alias("ll")
    )
    agg = per.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg("len").alias("query_len_mean"), F.avg("ent").alias("shannon_entropy_mean"),
        F.avg("depth").alias("subdomain_depth_mean"), F.avg("ll").alias("ngram_log_likelihood"),
        F.array_join(F.array_sort(F.collect_list("query_name")), "").alias("joined")
    )
    return agg.select("*", *[c.alias(k) for k, c in text.letter_ratios(F.col("joined")).items()]).drop("joined")


#: how many of its last times, sizes (rows with a size), states and DNS names a flow keeps
KEPT = {"time": 500, "size": 500, "state": 100, "name": 100}


def flow_history(events: DataFrame) -> DataFrame:
    """What each flow has kept at its latest event: its last 500 times (TLS records leave none), 500 sizes, 100 states, 100 DNS names with their types.

    Sizes are the byte counts of the two directions that are not 0, the originator's first. Map tasks keep no more of a
    flow than that, so a flow with very many events is never one task.
    """
    c = F.col
    some = lambda n: F.coalesce(c(n) != "", F.lit(False))
    txt = F.coalesce(F.upper("query_type").isin("TXT", "NULL", "ANY"), F.lit(False)) if "query_type" in events.columns else F.lit(False)
    kinds = {
        "time": ~c("event_type").eqNullSafe("tls"), "size": (c("orig_bytes") > 0) | (c("resp_bytes") > 0),
        "state": some("conn_state"), "name": (c("event_type") == "dns") & some("query_name")
    }
    kind = F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, cond in kinds.items()]))).alias("kind")
    rows = events.select("flow_id", "us", "seq", txt.cast("double").alias("txt"), "orig_bytes", "resp_bytes", "conn_state", "query_name", kind)
    rows = rows.select(
        "flow_id", "us", "seq", "kind",
        *[
            F.when(c("kind") == k, c(v)).alias(v) for k,
            v in (("size", "orig_bytes"), ("size", "resp_bytes"), ("state", "conn_state"), ("name", "query_name"), ("name", "txt"))
        ]
    )
    newest = Window.partitionBy("flow_id", "kind").orderBy(c("us").desc(), c("seq").desc())
    last = rows.select("*", F.row_number().over(newest).alias("nth")).where(c("nth") <= max(KEPT.values()))
    last = last.where(c("nth") <= F.when(c("kind").isin("time", "size"), KEPT["time"]).otherwise(KEPT["state"]))
    sized = (c("orig_bytes") > 0).cast("int") + (c("resp_bytes") > 0).cast("int")
    before = F.coalesce(F.sum(sized).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = KEPT["size"] - c("before")
    q = c("query_name")
    rows = last.select("*", before.alias("before")).select(
        "flow_id",
        F.when(c("kind") == "time", c("us")).alias("time"),
        F.when((c("resp_bytes") > 0) & (room >= 1), c("resp_bytes").cast("double")).alias("got"),
        F.when((c("orig_bytes") > 0) & (room >= 1 + (c("resp_bytes") > 0).cast("int")), c("orig_bytes").cast("double")).alias("sent"),
        c("conn_state").isin(*FAILED).cast("double").alias("failed"),
        *[c("conn_state").isin(*states).cast("double").alias(n) for n, states in _MARKS.items()],
        q.alias("name"),
        "txt",
    )
    q = c("name")
    per = rows.select(
        "*", F.length(q).alias("len"), text.shannon_entropy(q).alias("ent"), text.subdomain_depth(q).alias("depth"),
        F.when(q.isNotNull(), text.bigram_log_likelihood(q)).alias("ll")
    )
    agg = per.groupBy("flow_id").agg(
        F.array_sort(F.collect_list("time")).alias("flow_times"),
        F.concat(F.collect_list("sent"), F.collect_list("got")).alias("sizes"),
        F.avg("failed").alias("failed_conn_ratio"),
        *[F.max(n).alias(n) for n in _MARKS],
        F.count(q).alias("n_queries"),
        F.avg("len").alias("query_len_mean"),
        F.avg("ent").alias("shannon_entropy_mean"),
        F.avg("depth").alias("subdomain_depth_mean"),
        F.avg("ll").alias("ngram_log_likelihood"),
        F.avg("txt").alias("txt_record_ratio"),
        F.array_join(F.array_sort(F.collect_list(q)), "").alias("joined"),
    )
    size = series.moments(c("sizes"), 1)
    return agg.select(
        "*", *[v.alias(k) for k, v in text.letter_ratios(c("joined")).items()],
        F.when(F.size("sizes") > 0, size["iat_mean"]).alias("size_mean"), size["iat_std"].alias("pkt_size_std"),
        series.value_entropy(c("sizes")).alias("pkt_size_entropy")
    ).drop("joined", "sizes")


def flow_snapshots(events: DataFrame) -> DataFrame:
    """Each flow at its latest event: that event's seq, us and ends, and the flow's totals (c_...), combined in the map tasks."""
    c = F.col
    at = [c("us"), c("seq")]
    some = lambda n: F.nullif(c(n), F.lit("")) if n in events.columns else F.lit(None).cast("string")
    latest = lambda n: F.max(F.when(some(n).isNotNull(), F.struct(*at, some(n).alias("v"))))["v"].alias(f"c_{n}")
    known = [n for n in ("history", "tls_version", "ja3") if n in events.columns]
    totals = events.groupBy("flow_id").agg(
        F.max(F.struct(*at, "src_ip", "dst_ip", "src_port", "dst_port", "protocol")).alias("e"),
        *[F.sum(n).alias(f"c_{n}") for n in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")],
        F.count_if(_counted()).alias("c_events"),
        F.max("duration").alias("c_duration"),
        F.min("us").alias("c_first"),
        F.coalesce(F.max(F.when(c("event_type") == "tls", some("query_name").isNotNull())), F.lit(False)).alias("c_sni"),
        *[latest(n) for n in known],
    )
    missing = [F.lit(None).cast("string").alias(f"c_{n}") for n in ("history", "tls_version", "ja3") if n not in known]
    return totals.select("flow_id", "e.*", *[x for x in totals.columns if x.startswith("c_")], *missing)


def pair_places(events: DataFrame) -> DataFrame:
    """src_ip, dst_ip, us, seq, pair_k: the place of each event in its host pair, from 0 on."""
    rows = events.select("src_ip", "dst_ip", "us", "seq")
    return running_total(rows, "us", "seq", F.lit(1).cast("bigint"), "pair_k", ["src_ip", "dst_ip"]).withColumn("pair_k", F.col("pair_k") - 1)


def pair_blocks(ranked: DataFrame, keep: int = 500) -> DataFrame:
    """Times of each pair in blocks of `keep` events, with those of the block before: every last-`keep` frame lies in one row.

    ranked: pair_places(). A hot pair is many rows.
    """
    blocks = ranked.groupBy(
        "src_ip", "dst_ip", F.floor(F.col("pair_k") / keep).alias("pair_block")
    ).agg(F.array_sort(F.collect_list("us")).alias("block_times"))
    before = F.lag("block_times").over(Window.partitionBy("src_ip", "dst_ip").orderBy("pair_block"))
    return blocks.select("*", before.alias("times_before"))


def vectors(events: DataFrame, keep: int = 500) -> DataFrame:
    """The 54 features (baseline semantics) of every flow at its latest event, and the window's length.

    Flow, host and pair (of that event) count with what they have right after it; gaps are the flow's own if it has
    three times or more, else those of the pair's last `keep` events. The events are written to the shared folder first,
    so that every branch reads only its columns and repeats none of what made them.
    """
    c = F.col
    events = cut(events, "events")
    src = source_windows(events.select("seq", "us", "src_ip", "dst_ip", "dst_port", "conn_state")).select(
        "seq", "unique_dst_ports", "unique_dst_hosts", "conn_attempts"
    )
    dst = destination_windows(events.select("seq", "us", "src_ip", "dst_ip")).select("seq", "unique_src_count", "src_ip_entropy")
    ranked = pair_places(events)
    v = flow_snapshots(events).join(src, "seq").join(dst, "seq").join(degrees(events), "seq").join(destination_share(events), "seq")
    v = v.join(ranked.select("seq", "pair_k", F.floor(c("pair_k") / keep).alias("pair_block")), "seq")
    v = v.join(pair_blocks(ranked, keep), ["src_ip", "dst_ip", "pair_block"]).join(flow_history(events), "flow_id", "left")
    v = v.select("*", *_volume())
    n = (c("pair_k") % keep + 1).cast("int")
    inside, before = F.slice("block_times", F.lit(1), n), F.coalesce(F.slice("times_before", n + 1, keep - n), F.array().cast("array<bigint>"))
    own = F.size("flow_times") >= 3
    pair_first = F.coalesce(F.get("times_before", n), F.get("block_times", F.lit(0)))
    elapsed = F.greatest(F.lit(1.0), (c("us") - F.when(own, c("c_first")).otherwise(pair_first)) / 1e6)
    count = F.least(c("pair_k") + 1, F.lit(keep))
    v = v.withColumns({
        "timing": series.timing(F.when(own, c("flow_times")).otherwise(F.concat(before, inside))), "repeated_conn_count": count,
        "repeated_dst_freq": count / (elapsed / 60), "pkt_size_mean": F.coalesce("size_mean", "pkt_size_mean")
    })
    v = v.select("*", "timing.*")
    # of a flow that has kept nothing of the kind
    zeros = [
        "n_queries", "query_len_mean", "shannon_entropy_mean", "subdomain_depth_mean", "ngram_log_likelihood", "txt_record_ratio",
        "failed_conn_ratio"
    ]
    zeros += ["vowel_ratio", "consonant_ratio", "digit_ratio", "unique_char_ratio", "pkt_size_std", "pkt_size_entropy"]
    per_second = lambda c: F.col(c) / F.greatest(F.lit(1.0), F.col("dur"))
    v = v.withColumns({z: F.coalesce(z, F.lit(0.0)) for z in zeros})
    v = v.withColumns({
        "dst_port_fanout": per_second("unique_dst_ports"), "dst_host_fanout": per_second("unique_dst_hosts"),
        "conn_attempt_rate": per_second("conn_attempts"), "query_frequency": c("n_queries") / c("dur")
    })
    return v.select(
        "flow_id", *ENDS, (F.col("us") / 1e6).alias("timestamp"), F.col("dur").alias("window_duration_sec"),
        *[F.col(n).cast("double").alias(n) for n in ORDER]
    )


def optimized(events: DataFrame) -> DataFrame:
    """The 54 features of the selective generation, of every flow after all its events.

    Rates over at least a millisecond; states as counts over packets; gaps and sizes by running moments with the sample's
    deviation; host degrees over the last 2000 events of the host up to the flow's latest; names by the last DNS query alone.
    Web and alert records open a flow but change nothing else.
    """
    c = F.col
    w = Window.partitionBy("flow_id").orderBy("us", "seq")
    kind = F.coalesce("event_type", F.lit(""))
    known = kind.isin("connection", "dns", "tls")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    gap = (c("us") - F.coalesce(F.last(F.when(known, c("us")), ignorenulls=True).over(before), F.first("us").over(before))) / 1e6
    some = lambda n: F.nullif(c(n), F.lit("")) if n in events.columns else F.lit(None).cast("string")
    events = cut(events, "events")
    rows = events.select("*", F.when(kind.isin("connection", "dns") & (gap > 0), gap).alias("gap"))
    state, at = F.coalesce("conn_state", F.lit("")), F.struct("us", "seq")
    ends = F.struct("us", "seq", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")
    sizes = F.array_compact(F.array(
        F.when(c("orig_bytes") > 0, c("orig_bytes").cast("double")), F.when(c("resp_bytes") > 0, c("resp_bytes").cast("double"))
    ))
    n_sizes, sum_sizes, sum_squares = (F.sum(F.aggregate(sizes, F.lit(0.0), f)) for f in (
        lambda a, x: a + 1, lambda a, x: a + x, lambda a, x: a + x * x
    ))
    flows = rows.groupBy("flow_id").agg(
        F.coalesce(F.max(F.when(known, ends)), F.min(ends)).alias("e"),
        *[F.sum(n).alias(n) for n in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")],
        F.count_if(known).alias("n"), F.max("duration").alias("d"), F.min("us").alias("first"),
        F.count_if(state.contains("S")).alias("syn"), F.count_if(state.contains("A") | state.isin(
            "SF", "S1", "S2"
        )).alias("ack"), F.count_if(state.contains("R")).alias("rst"),
        F.min("gap").alias("iat_min"), F.max("gap").alias("iat_max"), F.avg("gap").alias("iat_mean"), F.stddev_samp("gap").alias("iat_std"),
        n_sizes.alias("n_sizes"), sum_sizes.alias("sum_sizes"), sum_squares.alias("sum_squares"),
        F.max(F.when((kind == "tls") & some("query_name").isNotNull(), F.lit(1.0))).alias("sni"),
        F.max(F.when(some("tls_version").isNotNull(), F.struct(at, some("tls_version").alias("v"))))["v"].alias("version"),
        F.max(some("ja3").isNotNull().cast("double")).alias("ja3"),
    )
    times = last_rows(
        rows.where(kind.isin("connection", "dns")).select("flow_id", "us", "seq"), ["flow_id"], ["us", "seq"], 128
    ).groupBy("flow_id").agg(F.array_sort(F.collect_list("us")).alias("times"))
    txt = F.coalesce(F.upper("query_type").isin("TXT", "NULL", "16"), F.lit(False)) if "query_type" in events.columns else F.lit(False)
    names = last_rows(
        rows.where((kind == "dns") & some("query_name").isNotNull()).select("flow_id", "us", "seq", "query_name", txt.cast("double").alias("txt")),
        ["flow_id"], ["us", "seq"], 50
    )
    names = names.groupBy("flow_id").agg(
        F.count(F.lit(1)).alias("nq"), F.avg(F.length("query_name")).alias("len"),
        F.avg(text.subdomain_depth(c("query_name"))).alias("depth"), F.avg("txt").alias("txt"),
        F.max_by("query_name", at).alias("q")
    )

    def recent(host: str, peers: dict[str, str]) -> DataFrame:
        placed = running_total(
            events.select("seq", "us", host, *peers.values(), known.alias("known")), "us", "seq", c("known").cast("bigint"),
            "place", [host]
        )
        # an event that doesn't count stands at the place of the one before it, and sees what that saw
        return sliding(
            placed, [host], "place", 1999, distinct={k: F.when(c("known"), c(p)) for k, p in peers.items()}, block_us=16_000
        ).select("seq", *[F.greatest(F.lit(1), k).alias(k) for k in peers])

    sources, targets = recent("src_ip", {"hosts": "dst_ip", "ports": "dst_port"}), recent("dst_ip", {"srcs": "src_ip"})
    v = flows.select("flow_id", "e.*", *[x for x in flows.columns if x not in ("flow_id", "e")])
    v = v.join(times, "flow_id", "left").join(names, "flow_id", "left").join(sources, "seq").join(targets, "seq")
    raw = F.when(c("d") > 0, c("d")).otherwise((c("us") - c("first")) / 1e6)
    v = v.select(
        "*", F.greatest(F.lit(1e-3), raw).alias("dur"), F.substring_index(F.lower("q"), ".", 1).alias("label"),
        series.spectral_peak(series.gaps(F.coalesce("times", F.array().cast("array<bigint>")))).alias("periodicity")
    )
    pk, by, one = c("orig_pkts") + c("resp_pkts"), c("orig_bytes") + c("resp_bytes"), F.lit(1)
    whole = F.greatest(F.lit(1.0), c("dur"))
    nz = lambda x: F.coalesce(x, F.lit(0.0))
    mean_size = c("sum_sizes") / c("n_sizes")
    var = (c("sum_squares") - c("sum_sizes") * mean_size) / (c("n_sizes") - 1)
    std_size = F.when(c("n_sizes") > 1, F.sqrt(F.greatest(F.lit(0.0), var))).otherwise(0.0)
    letters = F.greatest(F.length("label"), one)
    vowels = F.regexp_count("label", F.lit("[aeiou]"))
    version = F.lower(F.coalesce("version", F.lit("")))
    values = {
        "packet_rate": pk / c("dur"), "byte_rate": by / c("dur"), "syn_rate": c("syn") / c("dur"), "syn_ratio": c("syn") / F.greatest(
            one, pk
        ), "ack_ratio": c("ack") / F.greatest(one, pk), "rst_ratio": c("rst") / F.greatest(one, pk),
        "udp_rate": F.when(
            F.upper("protocol") == "UDP", pk / c("dur")
        ).otherwise(0.0), "unique_src_count": c("srcs"), "src_ip_entropy": text.shannon_entropy(c("src_ip")), "dest_concentration": 1 / F.greatest(
            F.lit(1.0), c("hosts")
        ),
        "byte_amplification_ratio": c("resp_bytes") / F.greatest(
            one, c("orig_bytes")
        ), "iat_min": nz(c("iat_min")), "iat_max": nz(c("iat_max")), "iat_mean": nz(c("iat_mean")), "iat_std": nz(c("iat_std")),
        "iat_cv": nz(F.when(
            c("iat_mean") > 1e-5, nz(c("iat_std")) / c("iat_mean")
        )), "periodicity_score": c("periodicity"), "repeated_dst_freq": c("n") / c("dur") * 60, "flow_duration": c("dur"), "repeated_conn_count": c("n"),
        "query_len_mean": nz(c("len")), "shannon_entropy_mean": nz(text.shannon_entropy(c("q"))), "vowel_ratio": nz(vowels / letters), "consonant_ratio": nz((F.regexp_count(
            "label", F.lit(r"\p{L}")
        ) - vowels) / letters),
        "digit_ratio": nz(F.regexp_count("label", F.lit(r"\p{Nd}")) / letters), "unique_char_ratio": nz(F.when(
            F.length("label") > 0, F.size(F.array_distinct(F.split("label", ""))) / letters
        )), "subdomain_depth_mean": nz(c("depth")),
        "query_frequency": nz(c("nq") / c("dur")), "txt_record_ratio": nz(c("txt")), "ngram_log_likelihood": nz(F.when(
            c("q").isNotNull(), text.bigram_log_likelihood(c("q"))
        )),
        "tls_version_num": F.coalesce(
            *[F.when(version.contains(x), float(x)) for x in ("1.3", "1.2", "1.1", "1.0")], F.lit(0.0)
        ), "has_tls_sni": nz(c("sni")), "ja3_present": nz(c("ja3")),
        "pkt_size_mean": F.when(
            c("n_sizes") > 0, mean_size
        ).otherwise(0.0), "pkt_size_std": std_size, "pkt_size_entropy": F.log2(std_size + 1), "directionality_ratio": c("orig_pkts") / F.greatest(
            one, pk
        ),
        "unique_dst_ports": c("ports"), "unique_dst_hosts": c("hosts"), "dst_port_fanout": c("ports") / whole, "dst_host_fanout": c("hosts") / whole, "conn_attempts": c("syn"), "conn_attempt_rate": c("syn") / c("dur"), "failed_conn_ratio": c("rst") / F.greatest(
            one, c("syn")
        ),
        "inbound_bytes": c("resp_bytes"), "outbound_bytes": c("orig_bytes"), "out_in_byte_ratio": c("orig_bytes") / F.greatest(
            one, c("resp_bytes")
        ), "bytes_per_flow": by, "outbound_rate": c("orig_bytes") / c("dur"),
        "asymmetric_traffic_score": (c("orig_bytes") - c("resp_bytes")) / F.greatest(
            one, by
        ), "src_out_degree": c("hosts"), "dst_in_degree": c("srcs"), "comm_partner_count": c("hosts") + c("srcs"), "graph_fanout_ratio": c("hosts") / F.greatest(
            F.lit(1.0), c("srcs")
        ),
    }
    return v.select("flow_id", *ENDS, (c("us") / 1e6).alias("timestamp"), *[values[n].cast("double").alias(n) for n in ORDER])


#: features that only a suspicious flow is worth, in the selective generation
COSTLY = [
    "src_ip_entropy", "periodicity_score", "shannon_entropy_mean", "vowel_ratio", "consonant_ratio", "digit_ratio",
    "unique_char_ratio", "subdomain_depth_mean", "query_frequency", "txt_record_ratio", "ngram_log_likelihood"
]


def tiered(vectors_: DataFrame, suspicious: Column) -> DataFrame:
    """`vectors_` with the costly features 0 where the gate passes the flow."""
    return vectors_.withColumns({n: F.when(suspicious, F.col(n)).otherwise(0.0) for n in COSTLY})


#: the ends of a flow's latest event
ENDS = ["src_ip", "dst_ip", "src_port", "dst_port"]
# The 54 features in their order.
ORDER = """packet_rate byte_rate syn_rate syn_ratio ack_ratio rst_ratio udp_rate unique_src_count src_ip_entropy dest_concentration byte_amplification_ratio
iat_min iat_max iat_mean iat_std iat_cv periodicity_score repeated_dst_freq flow_duration repeated_conn_count query_len_mean shannon_entropy_mean
vowel_ratio consonant_ratio digit_ratio unique_char_ratio subdomain_depth_mean query_frequency txt_record_ratio ngram_log_likelihood tls_version_num
has_tls_sni ja3_present pkt_size_mean pkt_size_std pkt_size_entropy directionality_ratio unique_dst_ports unique_dst_hosts dst_port_fanout
dst_host_fanout conn_attempts conn_attempt_rate failed_conn_ratio inbound_bytes outbound_bytes out_in_byte_ratio bytes_per_flow outbound_rate
asymmetric_traffic_score src_out_degree dst_in_degree comm_partner_count graph_fanout_ratio""".split()
