"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .baskets import basket_items, baskets, item_of
from .clusters import compare_clusters, describe_clusters, similarity_clusters
from .heavy_items import bounds, heavy_light, most_frequent
from .mixing import mix_sources, plan_mixture, shares, sized
from .neighbours import nearest_vectors, neighbour_pairs
from .overlap_join import similar_pairs, similar_pairs_between, similar_sets
from .pair_counts import together
from .repetition import find_repetitive, measure_repetition
from .term_index import keyed_term_frequencies, text_term_frequencies
from .tokenizer import encode_corpus
from .vectors import vectors

#: Weights over training time: the record of the higher courts grows, scans fade out; the rest stay even.
CURRICULUM = {
    "law_reports": [(0.0, 0.5), (1.0, 1.5)],
    "scan_archive": [(0.0, 2.0), (0.5, 1.0), (1.0, 0.25)],
    "translation_desk": [(0.0, 1.0), (0.25, 1.0), (0.75, 2.0), (1.0, 2.0)],
}


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    sets = baskets(table(spark, d, "basket_lines"))
    return similar_pairs(sets, "order_id", "items", 0.8, 5)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("id_a").alias("order_id_a"), F.col("id_b").alias("order_id_b"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("id_a").alias("order_id_a"), F.col("id_b").alias("order_id_b"), F.round("similarity", 6).alias("similarity"))


def p1_between(spark: SparkSession, d: str) -> DataFrame:
    """Orders by web against orders by phone."""
    lines = table(spark, d, "basket_lines")
    web, phone = (baskets(lines.where(F.col("channel") == c)) for c in ("web", "phone"))
    pairs = similar_pairs_between(web, phone, "order_id", "items", 0.75, 2)
    return pairs.select(F.col("left_id").alias("web_order"), F.col("right_id").alias("phone_order"), F.round("similarity", 6).alias("similarity"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the class of its set, the copies of that and the number of other sets that are similar to it."""
    classes, links = similar_sets(baskets(table(spark, d, "basket_lines")), "order_id", "items", 0.8, 5)
    classes = cut(classes.select("set_id", "id"))
    ends = links.select(F.explode(F.array("set_a", "set_b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("links"))
    about = classes.groupBy("set_id").agg(F.min("id").alias("first_order_id"), F.count("*").alias("copies")).join(ends, "set_id", "left")
    return classes.join(about, "set_id").select(F.col("id").alias("order_id"), "first_order_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def _clustered(spark: SparkSession, d: str, flow: bool = False) -> DataFrame:
    return cut(similarity_clusters(vectors(table(spark, d, "feature_frame"), table(spark, d, "feature_spec")), flow=flow))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    c = _clustered(spark, d)
    groups = c.groupBy("group_no").agg(F.count("*").alias("size"), F.min("id").alias("first_order_id")).where("size >= 3")
    return c.join(groups, "group_no").select(F.col("id").alias("order_id"), "first_order_id")


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return describe_clusters(_clustered(spark, d, flow=True)).select(F.col("first_id").alias("first_order_id"), "size", "typical")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups of p2_found, each with its size and the members that attract the most flow."""
    told = describe_clusters(_clustered(spark, d, flow=True), "group_no", strength=("flow",))
    return told.where("size >= 3").select(F.col("first_id").alias("first_order_id"), "size", F.array_join("typical", "|").alias("typical"))


def p2_groups_compared(spark: SparkSession, d: str) -> DataFrame:
    c = _clustered(spark, d)
    first = c.groupBy("group_no").agg(F.min("id").alias("first_order_id"))
    told = compare_clusters(c.join(first, "group_no"), table(spark, d, "segment_result"), "order_id", "cluster_id", "first_order_id")
    return told.withColumnRenamed("cluster", "first_order_id")


def p2_compared(spark: SparkSession, d: str) -> DataFrame:
    return compare_clusters(_clustered(spark, d), table(spark, d, "segment_result"), "order_id", "cluster_id")


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "basket_lines")
    items = keyed_term_frequencies(lines.select("order_id", item_of(lines["item_id"]).alias("item")), "order_id", "item")
    words = text_term_frequencies(table(spark, d, "item_names"), "item_index", "item_name")
    return items.withColumn("field_name", F.lit("item_id")).unionByName(words.withColumn("field_name", F.lit("item_name")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).where("mark <> ''").select("field_name", "term", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).select("field_name", "term", "occurrences", "n_records", "mark")


def _top_items(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "basket_lines")
    return lines.select(item_of(lines["item_id"]).alias("item_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return most_frequent(_top_items(spark, d), "item_id", 50).select(F.col("item").alias("item_id"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return most_frequent(_top_items(spark, d), "item_id", 50).select(F.col("item").alias("item_id"), "n")


def p4_sketch(spark: SparkSession, d: str) -> DataFrame:
    return bounds(*heavy_light(_top_items(spark, d), "item_id"))


def p4_outside(spark: SparkSession, d: str) -> DataFrame:
    """Items of the sketch whose exact count is outside of its bounds; how many rows the sketch holds at most."""
    items = _top_items(spark, d)
    heavy, light = map(cut, heavy_light(items, "item_id"))
    exact = items.where("item_id is not null").groupBy(F.col("item_id").alias("item")).agg(F.count("*").alias("n"))
    told = bounds(heavy, light).join(exact, "item", "left")
    held = heavy.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("heavy_n")).crossJoin(light.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("light_n")))  # one row
    return told.agg(F.count_if(F.expr("n is null or n < low or n > high")).alias("outside")).crossJoin(held).select("outside", (F.col("heavy_n") + F.col("light_n")).alias("counted"))


def _neighbours(spark: SparkSession, d: str, radius: float | None = 3.0) -> DataFrame:
    return nearest_vectors(vectors(table(spark, d, "feature_frame"), table(spark, d, "feature_spec")), 5, radius)


def _listed(near: DataFrame) -> DataFrame:
    rows = near.select("id", F.posexplode("neighbours").alias("nth", "n"))
    return rows.select(F.col("id").alias("order_id"), (F.col("nth") + 1).alias("nth"), F.col("n.id").alias("neighbour_id"), F.col("n.dist").alias("distance"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_pairs(_neighbours(spark, d)).select(F.col("id_a").alias("order_id_a"), F.col("id_b").alias("order_id_b"))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Within the radius of p6_found."""
    return _listed(_neighbours(spark, d))


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Of every vector, however far they are."""
    return _listed(_neighbours(spark, d, None))


def _together(spark: SparkSession, d: str) -> DataFrame:
    return together(basket_items(table(spark, d, "basket_lines")), "order_id", "item", 15, 6.0)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _together(spark, d).select(F.col("item_a").alias("item_id_a"), F.col("item_b").alias("item_id_b"))


def p7_lifts(spark: SparkSession, d: str) -> DataFrame:
    return _together(spark, d).select(F.col("item_a").alias("item_id_a"), F.col("item_b").alias("item_id_b"), "n_ab", "n_a", "n_b", F.round("lift", 4).alias("lift"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(sized(table(spark, d, "documents")), table(spark, d, "mix_targets"), CURRICULUM)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_plan(spark: SparkSession, d: str) -> DataFrame:
    """The plan of the mixture by sizes in characters, which the table holds itself."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("bigint").alias("n_tokens"))
    _, plan = plan_mixture(docs, table(spark, d, "mix_targets"))
    return plan.select("source", "documents", "supply", F.round("demand", 4).alias("demand"), F.col("full").alias("full_passes"), F.round("rest", 4).alias("rest"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The cases' share is fixed, so no cutoff may lie above it; the exact check follows for those that lie below."""
    measured, _ = find_repetitive(table(spark, d, "documents"), least_share=0.3)
    return measured.where("rejected").where("10 * n_repeated >= 3 * n_words").select("doc_id")


def p10_repetition(spark: SparkSession, d: str) -> DataFrame:
    measured = measure_repetition(table(spark, d, "documents"), ["doc_id", "lang"])
    return measured.select("doc_id", "lang", "n_words", "n_repeated", F.round("share", 6).alias("share"))


def p10_decisions(spark: SparkSession, d: str) -> DataFrame:
    """By the proven cutoffs alone."""
    measured, _ = find_repetitive(table(spark, d, "documents"))
    return measured.select("doc_id", F.col("stratum").alias("lang"), F.round("share", 6).alias("share"), F.round("sentence_share", 6).alias("sentence_share"), "cutoff", "rejected")


def p10_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return find_repetitive(table(spark, d, "documents"))[1]


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_pairs, p1_classes, p1_between, p2_found, p2_clusters, p2_groups, p2_compared, p2_groups_compared, p3_found, p3_terms, p4_found, p4_counts, p4_sketch, p4_outside, p6_found, p6_neighbours, p6_nearest, p7_found, p7_lifts, p8_ids, p9_mix, p9_plan, p9_shares, p10_found, p10_repetition, p10_decisions, p10_cutoffs)}


#: Items of lines, and baskets, by the definitions of the test data.
_ITEMS = "items AS (SELECT order_id, upper(trim(item_id, ' ' || chr(9))) item FROM basket_lines WHERE upper(trim(item_id, ' ' || chr(9))) <> ''), basket AS (SELECT DISTINCT order_id, item FROM items WHERE order_id IS NOT NULL)"
_PAIRS = f"WITH {_ITEMS}, sized AS (SELECT order_id, count(*) n FROM basket GROUP BY 1 HAVING count(*) >= 5), shared AS (SELECT a.order_id a, b.order_id b, count(*) o FROM (SELECT * FROM basket SEMI JOIN sized USING (order_id)) a JOIN (SELECT * FROM basket SEMI JOIN sized USING (order_id)) b ON a.item = b.item AND a.order_id < b.order_id GROUP BY 1, 2), p AS (SELECT a order_id_a, b order_id_b, o / (x.n + y.n - o) similarity, o, x.n + y.n - o u FROM shared JOIN sized x ON a = x.order_id JOIN sized y ON b = y.order_id)"
_VECTORS = "long AS (UNPIVOT (SELECT DISTINCT * FROM feature_frame) ON COLUMNS('feature_.*') INTO NAME feature_name VALUE v), vec AS (SELECT order_id, list((v - center) / scale ORDER BY feature_name) z FROM long JOIN feature_spec USING (feature_name) WHERE isfinite(v) GROUP BY order_id HAVING count(*) = (SELECT count(*) FROM feature_spec))"
_GROUPS = f"WITH RECURSIVE {_VECTORS}, link AS (SELECT a.order_id a, b.order_id b, round(list_distance(a.z, b.z), 6) dist FROM vec a JOIN vec b ON a.order_id <> b.order_id AND abs(a.z[1] - b.z[1]) <= 1.1 AND abs(a.z[3] - b.z[3]) <= 1.1 WHERE round(list_distance(a.z, b.z), 6) <= 1.0), reach(a, b) AS (SELECT order_id, order_id FROM vec UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a), g AS (SELECT a, min(b) first_order_id FROM reach GROUP BY 1), s AS (SELECT first_order_id, count(*) n FROM g GROUP BY 1 HAVING count(*) >= 3)"
_NEAR = f"WITH {_VECTORS}, d AS (SELECT a.order_id a, b.order_id b, round(list_distance(a.z, b.z), 6) dist FROM vec a JOIN vec b ON a.order_id <> b.order_id AND abs(a.z[1] - b.z[1]) <= 3.1 AND abs(a.z[3] - b.z[3]) <= 3.1), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) nth FROM d WHERE dist <= 3.0)"
_TERMS = f"WITH {_ITEMS}, w AS (SELECT item_index, unnest(regexp_extract_all(lower(item_name), '[a-z0-9]+')) term FROM item_names), t AS (SELECT 'item_id' field_name, item term, count(*) occurrences, count(DISTINCT order_id) n_records, (SELECT count(DISTINCT order_id) FROM basket) n FROM items GROUP BY item UNION ALL SELECT 'item_name', term, count(*), count(DISTINCT item_index), (SELECT count(*) FROM item_names WHERE item_name <> '') FROM w GROUP BY term), m AS (SELECT field_name, term, occurrences, n_records, CASE WHEN n_records BETWEEN 1 AND 2 THEN 'rare' WHEN n_records > 0.2 * n THEN 'common' ELSE '' END mark FROM t)"
_LIFTS = f"WITH {_ITEMS}, m AS (SELECT item, count(*) k FROM basket GROUP BY 1), n AS (SELECT count(DISTINCT order_id) n FROM basket), c AS (SELECT a.item a, b.item b, count(*) n_ab FROM basket a JOIN basket b ON a.order_id = b.order_id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 15), l AS (SELECT a item_id_a, b item_id_b, n_ab, x.k n_a, y.k n_b, n_ab::DOUBLE * n / (x.k::DOUBLE * y.k) lift FROM c JOIN m x ON a = x.item JOIN m y ON b = y.item CROSS JOIN n WHERE n_ab::DOUBLE * n / (x.k::DOUBLE * y.k) >= 6)"
_WORDS = r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') words FROM documents), g AS (SELECT doc_id, i, list_aggregate(words[i:i+7], 'string_agg', ' ') run FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1))) i FROM w)), again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, run) first_i FROM g) WHERE i > first_i), hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) p FROM again), n AS (SELECT doc_id, count(*) n_repeated FROM hit GROUP BY 1), m AS (SELECT doc_id, coalesce(len(words), 0) n_words, coalesce(n_repeated, 0) n_repeated FROM w LEFT JOIN n USING (doc_id))"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_PAIRS} SELECT order_id_a, order_id_b FROM p WHERE 5 * o >= 4 * u",
        "p1_pairs": f"{_PAIRS} SELECT order_id_a, order_id_b, round(similarity, 6) similarity FROM p WHERE 5 * o >= 4 * u",
        "p1_classes": f"{_PAIRS}, k AS (SELECT order_id, string_agg(item, '|' ORDER BY item) s FROM basket SEMI JOIN sized USING (order_id) GROUP BY 1), c AS (SELECT s, min(order_id) first_order_id, count(*) copies FROM k GROUP BY 1), e AS (SELECT x.s s, y.s t FROM p JOIN k x ON x.order_id = order_id_a JOIN k y ON y.order_id = order_id_b WHERE 5 * o >= 4 * u AND x.s <> y.s), l AS (SELECT s, count(DISTINCT t) links FROM (SELECT s, t FROM e UNION ALL SELECT t, s FROM e) GROUP BY 1) SELECT order_id, first_order_id, copies, coalesce(links, 0) links FROM k JOIN c USING (s) LEFT JOIN l USING (s)",
        "p1_between": "WITH i AS (SELECT DISTINCT channel, order_id, upper(trim(item_id, ' ' || chr(9))) item FROM basket_lines WHERE order_id IS NOT NULL AND channel IN ('web', 'phone') AND upper(trim(item_id, ' ' || chr(9))) <> ''), s AS (SELECT channel, order_id, count(*) n FROM i GROUP BY 1, 2 HAVING count(*) >= 2), o AS (SELECT a.order_id a, b.order_id b, count(*) o FROM i a JOIN i b ON a.item = b.item AND a.channel = 'web' AND b.channel = 'phone' GROUP BY 1, 2) SELECT a web_order, b phone_order, round(o / (x.n + y.n - o), 6) similarity FROM o JOIN s x ON x.order_id = a AND x.channel = 'web' JOIN s y ON y.order_id = b AND y.channel = 'phone' WHERE 4 * o >= 3 * (x.n + y.n - o)",
        "p2_found": f"{_GROUPS} SELECT a order_id, first_order_id FROM g SEMI JOIN s USING (first_order_id)",
        "p2_groups": f"{_GROUPS}, w AS (SELECT a, b, exp(-dist * dist) w FROM link UNION ALL SELECT order_id, order_id, 1.0 FROM vec), t AS (SELECT a, sum(w) total FROM w GROUP BY 1), f AS (SELECT w.a, round(sum(w / total), 9) flow FROM w JOIN t ON t.a = w.b GROUP BY 1), r AS (SELECT first_order_id, a, row_number() OVER (PARTITION BY first_order_id ORDER BY flow DESC, a) nth FROM g SEMI JOIN s USING (first_order_id) JOIN f USING (a)) SELECT first_order_id, n size, string_agg(a, '|' ORDER BY nth) FILTER (WHERE nth <= 3) typical FROM r JOIN s USING (first_order_id) GROUP BY 1, 2",
        "p2_groups_compared": f"{_GROUPS}, old AS (SELECT DISTINCT order_id a, cluster_id label FROM segment_result), x AS (SELECT first_order_id, label, count(*) AS \"both\" FROM g LEFT JOIN old USING (a) GROUP BY 1, 2), i AS (SELECT first_order_id, count(*) in_cluster FROM g GROUP BY 1), l AS (SELECT label, count(*) in_label FROM old GROUP BY 1) SELECT first_order_id, label, \"both\", in_cluster, coalesce(in_label, 0) in_label FROM x JOIN i USING (first_order_id) LEFT JOIN l USING (label)",
        "p3_found": f"{_TERMS} SELECT field_name, term, mark FROM m WHERE mark <> ''",
        "p3_terms": f"{_TERMS} SELECT field_name, term, occurrences, n_records, mark FROM m",
        "p4_found": f"WITH {_ITEMS} SELECT item item_id FROM items GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50",
        "p4_counts": f"WITH {_ITEMS} SELECT item item_id, count(*) n FROM items GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
        "p4_outside": f"WITH {_ITEMS} SELECT 0::BIGINT outside, count(*) counted FROM items",
        "p6_found": f"{_NEAR} SELECT DISTINCT least(a, b) order_id_a, greatest(a, b) order_id_b FROM r WHERE nth <= 5",
        "p6_neighbours": f"{_NEAR} SELECT a order_id, nth::INT nth, b neighbour_id, dist distance FROM r WHERE nth <= 5",
        "p6_nearest": f"WITH {_VECTORS}, d AS (SELECT a.order_id a, b.order_id b, round(list_distance(a.z, b.z), 6) dist FROM vec a JOIN vec b ON a.order_id <> b.order_id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) nth FROM d) SELECT a order_id, nth::INT nth, b neighbour_id, dist distance FROM r WHERE nth <= 5",
        "p7_found": f"{_LIFTS} SELECT item_id_a, item_id_b FROM l",
        "p7_lifts": f"{_LIFTS} SELECT item_id_a, item_id_b, n_ab, n_a, n_b, round(lift, 4) lift FROM l",
        "p9_plan": "WITH t AS (SELECT sum(n_chars) total FROM documents), x AS (SELECT source, count(n_chars) documents, coalesce(sum(n_chars), 0) supply FROM documents GROUP BY 1), p AS (SELECT m.source, coalesce(documents, 0) documents, coalesce(supply, 0)::BIGINT supply, target_share * total demand, greatest(max_repeats, 0) most FROM mix_targets m LEFT JOIN x ON x.source = m.source CROSS JOIN t), f AS (SELECT *, CASE WHEN supply > 0 THEN least(most, floor(demand / supply))::BIGINT ELSE 0 END full_passes FROM p) SELECT source, documents, supply, round(demand, 4) demand, full_passes, round(CASE WHEN supply > 0 AND full_passes < most THEN demand - full_passes * supply ELSE 0 END, 4) rest FROM f",
        "p10_repetition": f"{_WORDS} SELECT doc_id, lang, n_words, n_repeated, round(CASE WHEN n_words > 0 THEN n_repeated / n_words ELSE 0 END, 6) share FROM m JOIN documents USING (doc_id)",
        "p10_found": f"{_WORDS} SELECT doc_id FROM m WHERE n_words >= 40 AND 10 * n_repeated >= 3 * n_words",
    }
