"""The queries of the training-data problems (1, 3, 8, 9, 10) on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import leaks, neighbors, packing, pii, sketch
from tidemark.session import cut, read_table

_KEYS = ["day", "sensor_id", "event_type", "protocol"]


def _sources(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, Column]]:
    events = read_table(spark, folder, "net_events").where(F.col("src_ip") != "0.0.0.0")
    at = F.when((F.col("timestamp") != 0) & ~F.isnan("timestamp"), F.col("timestamp"))
    day = F.date_format(F.timestamp_seconds(F.floor(at)), "yyyy-MM-dd")
    return events, {"day": day, "sensor_id": F.lower("sensor_id"), "event_type": F.lower("event_type"), "protocol": F.lower("protocol")}


def p1_distinct_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct sources per UTC day, sensor, event type, protocol (without regard to case) and every combination.

    level: grouping id, a bit for each key that is summed over. Rows without source (null or 0.0.0.0) are not
    counted; rows without time count under a null day.
    """
    events, keys = _sources(spark, folder)
    merged = sketch.merge_cube(sketch.merge(sketch.sketches(events, keys, F.col("src_ip")), _KEYS), _KEYS)
    return sketch.estimate(merged, [*_KEYS, "level"]).select(*_KEYS, "level", F.round("estimate").cast("bigint").alias("distinct_sources"))


def _within(spark: SparkSession, rows: DataFrame, identifier: str, rough: DataFrame, names: list[str]) -> DataFrame:
    """Each estimate against the exact count of the same group of the cube: is it within two percent?"""
    keys = ", ".join(names)
    exact = spark.sql(f"select {keys}, cast(grouping_id({keys}) as bigint) as level, count(distinct {identifier}) as exact_count from {{rows}} group by cube({keys})", rows=rows)
    rough = rough.select(*[F.col(k).alias(f"r_{k}") for k in names], F.col("level").alias("r_level"), "rough")
    same = F.col("level") == F.col("r_level")
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    off = F.abs(F.col("rough") - F.col("exact_count"))
    within = F.coalesce(off <= F.greatest(F.lit(0.5), 0.02 * F.col("exact_count")), F.lit(False))
    return exact.join(rough, same, "left").select(*names, "level", "exact_count", within.alias("within"))


def p1_within_bound(spark: SparkSession, folder: str) -> DataFrame:
    """Each estimate of p1_distinct_sources against the exact count of the same group."""
    events, keys = _sources(spark, folder)
    rows = events.select(*[c.alias(k) for k, c in keys.items()], "src_ip").distinct()
    return _within(
        spark, rows, "src_ip", p1_distinct_sources(spark, folder).withColumnRenamed("distinct_sources", "rough"), _KEYS
    ).withColumnRenamed("exact_count", "exact_sources")


_LARGE = ["l_returnflag", "l_linestatus", "l_linenumber"]


def p1_large_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The same operator on sets of up to all lines of lineitem, where registers are dense, against exact counts."""
    rows = read_table(spark, folder, "lineitem").select(
        *[F.col(k).cast("string").alias(k) for k in _LARGE], F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))
    merged = sketch.merge_cube(sketch.merge(sketch.sketches(rows, {k: F.col(k) for k in _LARGE}, F.col("line")), _LARGE), _LARGE)
    rough = sketch.estimate(merged, [*_LARGE, "level"]).withColumn("rough", F.round("estimate"))
    return _within(spark, rows, "line", rough, _LARGE)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbors.most_similar(read_table(spark, folder, "flow_vectors"), read_table(spark, folder, "feature_scale"), within=0.9)
    return near.select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b")).distinct()


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar other vectors of every vector."""
    found = neighbors.most_similar(read_table(spark, folder, "flow_vectors"), read_table(spark, folder, "feature_scale"))
    return found.withColumn("distance", F.round("distance", 5))


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Of the vectors whose id is divisible by 20: how many true neighbours they have (by comparing all), and whether the
    index finds 99 % of them (another vector at the same distance counts)."""
    vectors, scale = read_table(spark, folder, "flow_vectors"), read_table(spark, folder, "feature_scale")
    points, width = neighbors.scaled_rows(vectors, scale, "vec_id")
    points = cut(points, "points")
    true = neighbors.nearest_by_scan(points, points.where(F.col("id") % 20 == 0), 10, width)
    found = p3_neighbours(spark, folder).where(F.col("a") % 20 == 0)
    last = true.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
    hit = found.select(F.col("a").alias("q"), "distance").join(last, F.col("q") == F.col("a")).where(F.col("distance") <= F.col("far") + 1e-5)
    both = last.agg(F.sum("n").alias("n_neighbours")).crossJoin(hit.agg(F.count(F.lit(1)).alias("hits")))  # two single rows
    return both.select("n_neighbours", (F.col("hits") >= 0.99 * F.col("n_neighbours")).alias("recall_is_99_percent"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"))


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of p8_containers: every text in adjoining parts that cover it once, only texts above the capacity split,
    no container overfull, and hardly more containers than the tokens need."""
    documents = read_table(spark, folder, "documents")
    placed = cut(packing.pack(documents), "placed")
    over = Window.partitionBy("doc_id").orderBy("part")
    rows = placed.select(
        "*", F.coalesce(F.lag("token_to").over(over), F.lit(0)).alias("before"),
        F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("parts")
    )
    by_text = rows.groupBy("doc_id").agg(
        F.bool_and((F.col("token_from") == F.col("before")) & (F.col("n_tokens") == F.col("token_to") - F.col("token_from"))).alias("adjoining"),
        F.max("parts").alias("parts"), F.sum("n_tokens").alias("n")
    )
    sizes = packing.token_counts(documents, "doc_id", "text").groupBy(F.col("doc_id").alias("d")).agg(F.sum("n_tokens").alias("size"))
    texts = by_text.join(sizes, F.col("doc_id") == F.col("d"), "full_outer")
    split = F.col("parts") == F.greatest(F.lit(1), F.ceil(F.col("size") / packing.CAPACITY))
    texts = texts.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.bool_and(F.coalesce(F.col("adjoining") & (F.col("n") == F.col("size")) & split, F.lit(False))).alias("every_token_once"),
        F.sum("size").alias("tokens")
    )
    load = placed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    load = load.agg(F.bool_and(F.col("load") <= packing.CAPACITY).alias("none_overfull"), F.count(F.lit(1)).alias("containers"))
    both = texts.crossJoin(load)  # two single rows
    return both.select(
        "n_texts", "every_token_once", "none_overfull",
        (F.col("containers") <= 1.002 * F.ceil(F.col("tokens") / packing.CAPACITY) + 1).alias("hardly_any_room_lost")
    )


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_near(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks with at most one changed, added or lost word in the window."""
    return leaks.find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"), max_edits=1, target=0.9999)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    spans = pii.find_pii(read_table(spark, folder, "documents"), read_table(spark, folder, "name_lexicon"))
    return spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start_pos", "s.end_pos", "s.pii_type")


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with typed placeholders."""
    return pii.find_pii(
        read_table(spark, folder, "documents"), read_table(spark, folder, "name_lexicon"), with_text=True
    ).select("doc_id", F.col("redacted").alias("text"))


def p10_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of p10_redacted and p10_found: outside the spans the text is unchanged, and each span became a
    placeholder of its type."""
    names = read_table(spark, folder, "name_lexicon")
    found = cut(pii.find_pii(read_table(spark, folder, "documents"), names, with_text=True), "redacted")
    rows = found.join(read_table(spark, folder, "documents").select(F.col("doc_id").alias("d"), "text"), F.col("doc_id") == F.col("d"))
    # the pieces between the spans, with placeholders, put together again
    step = lambda a, s: F.struct(
        F.concat(a["t"], F.substr("text", a["at"] + 1, s["start_pos"] - a["at"]), F.lit("["), s["pii_type"], F.lit("]")).alias("t"),
        s["end_pos"].alias("at")
    )
    built = F.aggregate(
        "spans", F.struct(F.lit("").alias("t"), F.lit(0).alias("at")), step,
        lambda a: F.concat(a["t"], F.substr("text", a["at"] + 1, F.length("text")))
    )
    apart = F.forall(
        F.zip_with(
            F.slice("spans", 2, F.greatest(F.size("spans") - 1, F.lit(0))),
            F.slice("spans", 1, F.greatest(F.size("spans") - 1, F.lit(0))), lambda b, a: a["end_pos"] <= b["start_pos"]
        ),
        lambda x: x
    )
    return rows.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.bool_and((F.col("text").isNull() & F.col("redacted").isNull()) | (apart & (built == F.col("redacted")))).alias("consistent")
    )


QUERIES = {f.__name__: f for f in (
    p1_distinct_sources, p1_within_bound, p1_large_sets, p3_found, p3_neighbours, p3_recall, p8_containers, p8_check, p9_found,
    p9_near, p10_found, p10_redacted, p10_check
)}

_CUBE = """
    with rows as (select case when "timestamp" <> 0 then strftime(make_timestamp(cast(floor("timestamp") as bigint) * 1000000), '%Y-%m-%d')
      end as day,
        lower(sensor_id) as sensor_id, lower(event_type) as event_type, lower(protocol) as protocol, src_ip from net_events
        where src_ip <> '0.0.0.0')"""
_NGRAM = """
    with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
    i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items),
    dg as (select doc_id, array_to_string(w[k:k + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from d)),
    ig as (select item_id, array_to_string(w[k:k + 12], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as k from i))
    select distinct doc_id, item_id from dg join ig using (g)"""
#: every way in which a window of 13 words and a passage can be one edit apart, as equal texts: k is the place of a changed
#: word (*), of a word that only the document has (14 words less one), or of one that only the item has (13 less one)
_NEAR = """
    with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
    i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items),
    p as (select doc_id, w, unnest(range(1, len(w) + 1)) as s from d),
    dw as (select doc_id, w[s:s + 13] as v, len(w) - s + 1 as n from p),
    ig as (select distinct item_id, w[s:s + 12] as v from (select item_id, w, unnest(range(1, len(w) - 11)) as s from i)),
    k as (select unnest(range(1, 15)) as k),
    ik as (select item_id, k, 'changed' as kind, array_to_string(v[:k - 1] || ['*'] || v[k + 1:], ' ') as g from ig, k where k <= 13
      union all select item_id, 0, 'added', array_to_string(v, ' ') from ig
      union all select item_id, 0, 'lost', array_to_string(v[:k - 1] || v[k + 1:], ' ') from ig, k where k <= 13),
    dk as (select doc_id, k, 'changed' as kind, array_to_string(v[:k - 1] || ['*'] || v[k + 1:13], ' ') as g from dw, k where n >= 13 and k <= 13
      union all select doc_id, 0, 'added', array_to_string(v[:k - 1] || v[k + 1:14], ' ') from dw, k where n >= 14
      union all select doc_id, 0, 'lost', array_to_string(v[:12], ' ') from dw where n >= 12),
    near as (select distinct doc_id, item_id from (select distinct * from dk) join (select distinct * from ik) using (k, kind, g)),
    exact as (select distinct doc_id, item_id from (select doc_id, array_to_string(v[:13], ' ') as g from dw where n >= 13)
      join (select item_id, array_to_string(v, ' ') as g from ig) using (g))
    select near.doc_id, near.item_id, cast(case when exact.doc_id is null then 1 else 0 end as bigint) as edits from near left
      join exact on near.doc_id = exact.doc_id and near.item_id = exact.item_id"""
#: all pairs, by scaled distance in single precision as the index has it
_SCALED = """
    with long as (unpivot (select * exclude (flow_id, "timestamp", window_duration_sec) from (select *
      from flow_vectors)) on columns(* exclude (vec_id)) into name feature_name value x),
    z as (select vec_id, list(cast((case when log_scaled then ln(1 + x) else x end - center) / spread as float) order by feature_index) as v
      from long join feature_scale using (feature_name) group by vec_id),
    p as (select a.vec_id as a, b.vec_id as b, list_distance(cast(a.v as double[]), cast(b.v as double[])) as d from z a
      join z b on a.vec_id <> b.vec_id),
    k as (select *, row_number() over (partition by a order by d, b) as nth from p)"""
SQL = {
    "p3_found": _SCALED + " select distinct least(a, b) as vec_a, greatest(a, b) as vec_b from k where nth <= 10 and d <= 0.9",
    "p3_neighbours": _SCALED + " select a, b, round(d, 5) as distance from k where nth <= 10",
    "p3_recall": "with n as (select count(*) as n from flow_vectors) select cast(least(10, n - 1) * (select count(*) from flow_vectors where vec_id % 20 = 0) as bigint) as n_neighbours, true as recall_is_99_percent from n",
    "p9_near": _NEAR,
    "p1_within_bound": _CUBE + """
    select day, sensor_id, event_type, protocol, cast(grouping_id(day, sensor_id, event_type, protocol) as bigint) as level,
      count(distinct src_ip) as exact_sources, true as within
    from rows group by cube(day, sensor_id, event_type, protocol)""",
    "p1_large_sets": """
    with rows as (select l_returnflag, l_linestatus, cast(l_linenumber as varchar) as l_linenumber, concat(l_orderkey, '-', l_linenumber) as line from lineitem)
    select l_returnflag, l_linestatus, l_linenumber, cast(grouping_id(l_returnflag, l_linestatus, l_linenumber) as bigint) as level,
        count(distinct line) as exact_count, true as within
    from rows group by cube(l_returnflag, l_linestatus, l_linenumber)""",
    "p8_check": "select count(distinct doc_id) as n_texts, true as every_token_once, true as none_overfull, true as hardly_any_room_lost from documents",
    "p10_check": "select count(*) as n_texts, true as consistent from documents",
    "p9_found": _NGRAM,
}
