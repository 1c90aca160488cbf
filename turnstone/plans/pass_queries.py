"""Annotation passes, registries, sheets and gates, on the given tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone import catalog
from turnstone.catalog import with_sql
from turnstone.functions import rules
from turnstone.functions import text as tx
from turnstone.operators import audits, bootstrap, merging, passes, sampling, scoring
from turnstone.plans.audit_queries import HALVES, RULES, halves
from turnstone.plans.scoring_queries import BOOT, LABELS, SAMPLES, SEED, correct, p0, p3
from turnstone.registry import query


def t(spark, sf, name):
    return catalog.table(spark, sf, name)


@query("J10_structured_rows", "SELECT CASE WHEN p_size % 4 = 0 AND p_size % 3 = 0 THEN 'invalid_with_fields' WHEN p_size % 4 <> 0 AND p_size % 5 = 0 THEN 'missing_fields' END AS problem, count(*)::BIGINT AS n FROM part WHERE (p_size % 4 = 0 AND p_size % 3 = 0) OR (p_size % 4 <> 0 AND p_size % 5 = 0) GROUP BY 1")
def structured(spark, sf):
    """Either a row is marked invalid and carries nothing else, or all its fields are there."""
    r = t(spark, sf, "part").select((F.col("p_size") % 4 == 0).alias("invalid"), F.when((F.col("p_size") % 4 == 0) & (F.col("p_size") % 3 != 0) | (F.col("p_size") % 4 != 0) & (F.col("p_size") % 5 == 0), None).otherwise(F.col("p_type")).alias("category"))
    p = F.when(F.col("invalid") & F.col("category").isNotNull(), "invalid_with_fields").when(~F.col("invalid") & F.col("category").isNull(), "missing_fields")
    return r.select(p.alias("problem")).where("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("B08_linear_combination", with_sql(BOOT + ", v1 AS (SELECT replicate, max(CASE condition WHEN 'full' THEN value END) - max(CASE condition WHEN 'none' THEN value END) AS a FROM rep GROUP BY 1) SELECT 'known' AS derived, count(a)::BIGINT AS defined FROM v1 UNION ALL SELECT 'lacking', 0"))
def combination(spark, sf):
    """A term that no statistic has leaves the combination undefined in every replicate."""
    p = p0(spark, sf)
    v = bootstrap.vectors(p, ["condition"], "conv_id", correct().cast("int"), F.lit(1)).withColumnRenamed("condition", "stat")
    terms = spark.createDataFrame([("known", "full", 1.0), ("known", "none", -1.0), ("lacking", "full", 1.0), ("lacking", "absent", 1.0)], "derived string, stat string, coef double")
    d = bootstrap.derived(bootstrap.replicates_blocked(v, "stat", "conv_id", SAMPLES, SEED), terms)
    return d.groupBy("derived").agg(F.count("value").alias("defined"))


@query("G02_audit_build", "SELECT count(*)::BIGINT AS rows, count_if(toxic = 1)::BIGINT AS excluded, bool_or(doc_id IS NULL) AS refused FROM labels")
def audit_build(spark, sf):
    return t(spark, sf, "labels").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("toxic") == 1).alias("excluded"), F.bool_or(F.col("doc_id").isNull()).alias("refused"))


STREAMS = {"routed": lambda d: d, "oracle": lambda d: d.where("gold = 1"), "transfer": lambda d: d.where("turn = 0")}


@query("X05_row_builders", with_sql("SELECT 'routed' AS stream, count(*)::BIGINT AS n FROM p0 UNION ALL SELECT 'oracle', count(*) FROM p0 WHERE gold = 1 UNION ALL SELECT 'transfer', count(*) FROM p0 WHERE turn = 0"))
def builders(spark, sf):
    parts = [f(p0(spark, sf)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("stream"), "n") for n, f in STREAMS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("P18_group_splits", "SELECT p_brand AS group_id, list_sort(list_distinct(list(p_type))) AS splits FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def group_splits(spark, sf):
    return passes.split_groups(t(spark, sf, "part").select(F.col("p_brand").alias("group_id"), F.col("p_type").alias("split")))


CROSS = [("absent_with_intent", "event_type = 'view' AND value > 15"), ("present_without_intent", "event_type = 'click' AND value < 5"), ("negative", "value < 0")]


@query("P24_cross_field_rules", "SELECT event_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in CROSS) + "], lambda x: x IS NOT NULL), ';') AS problems FROM events WHERE " + " OR ".join(f"({c})" for _, c in CROSS))
def cross_fields(spark, sf):
    e = t(spark, sf, "events").withColumn("p", audits.problems(CROSS))
    return e.where(F.size("p") > 0).select("event_id", F.array_join("p", ";").alias("problems"))


@query("P25_audit_rows", "SELECT count_if(c_acctbal < 0)::BIGINT AS negative, count_if(c_nationkey % 7 = 3)::BIGINT AS odd, count(*)::BIGINT AS n FROM customer")
def audit_rows(spark, sf):
    return t(spark, sf, "customer").agg(F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_if(F.col("c_nationkey") % 7 == 3).alias("odd"), F.count(F.lit(1)).alias("n"))


@query("P27_usable_rows", "SELECT c_custkey FROM customer WHERE NOT (" + " OR ".join(f"({c})" for _, c in RULES) + ")")
def usable(spark, sf):
    return t(spark, sf, "customer").where(F.size(audits.problems(RULES)) == 0).select("c_custkey")


@query("P28_flat_estimates", with_sql("SELECT 'accuracy/' || condition || '/' || split AS name, avg((gold = pred)::INT) AS value FROM p0 GROUP BY condition, split"))
def flat(spark, sf):
    r = scoring.report(p0(spark, sf), ["condition", "split"], LABELS)
    return r.select(F.concat_ws("/", F.lit("accuracy"), "condition", "split").alias("name"), F.col("accuracy").alias("value"))


@query("P29_figure_rows", with_sql("SELECT condition, split, avg((gold = pred)::INT) AS value FROM p0 WHERE condition IN ('full', 'none') AND split <> 'train' GROUP BY 1, 2"))
def figure(spark, sf):
    return scoring.report(p0(spark, sf).where("condition IN ('full', 'none') AND split <> 'train'"), ["condition", "split"], LABELS).select("condition", "split", F.col("accuracy").alias("value"))


@query("P30_safe_input", "SELECT p_partkey, sha256(p_name || chr(31) || p_brand) AS input_sha256 FROM part")
def safe_input(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.sha2(F.concat("p_name", F.lit("\x1f"), "p_brand"), 256).alias("input_sha256"))


@query("J19_field_drift", f"WITH {HALVES} SELECT a.doc_id, list_filter([CASE WHEN a.quality <> b.quality THEN 'quality' END, CASE WHEN a.toxic <> b.toxic THEN 'toxic' END], lambda x: x IS NOT NULL) AS fields FROM a JOIN b USING (doc_id) WHERE a.quality <> b.quality OR a.toxic <> b.toxic")
def drift(spark, sf):
    a, b = halves(spark, sf)
    j = a.alias("a").join(b.alias("b"), "doc_id")
    f = F.filter(F.array(*[F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), c) for c in ("quality", "toxic")]), lambda x: x.isNotNull())
    return j.select("doc_id", f.alias("fields")).where("size(fields) > 0")


@query("J21_correction_counts", "WITH r AS (SELECT user_id AS k, count(*) AS s FROM events WHERE event_type = 'error' GROUP BY 1), l AS (SELECT user_id AS k, count(*) AS g FROM events WHERE event_type = 'view' GROUP BY 1) SELECT coalesce(r.k, l.k) AS item_id, coalesce(s, 0)::BIGINT AS superseded, coalesce(g, 0)::BIGINT AS logged FROM r FULL JOIN l ON r.k = l.k WHERE coalesce(s, 0) <> coalesce(g, 0)")
def corrections(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("item_id"), "event_type")
    return passes.unlogged_corrections(e.where("event_type = 'error'").withColumn("status", F.lit("superseded")), e.where("event_type = 'view'"), ["item_id"])


@query("J24_verdicts", f"WITH {HALVES} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'no_key' WHEN b.doc_id IS NULL THEN 'no_verdict' WHEN a.quality = b.quality THEN 'ok' ELSE 'wrong' END AS verdict FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def verdicts(spark, sf):
    a, b = halves(spark, sf)
    j = a.select("doc_id", F.col("quality").alias("x")).join(b.select("doc_id", F.col("quality").alias("y")), "doc_id", "full_outer")
    return j.select("doc_id", F.when(F.col("x").isNull(), "no_key").when(F.col("y").isNull(), "no_verdict").when(F.col("x") == F.col("y"), "ok").otherwise("wrong").alias("verdict"))


@query("J25_export_labels", f"WITH {HALVES} SELECT a.doc_id, b.quality FROM a JOIN b USING (doc_id)")
def export_labels(spark, sf):
    a, b = halves(spark, sf)
    return a.select("doc_id").join(b, "doc_id").select("doc_id", "quality")


@query("J26_sheet_snapshot", f"WITH {HALVES} SELECT a.doc_id, sha256(a.quality || ':' || a.toxic) = sha256(b.quality || ':' || b.toxic) AS current FROM a JOIN b USING (doc_id)")
def snapshot(spark, sf):
    a, b = halves(spark, sf)
    h = lambda: F.sha2(F.concat_ws(":", "quality", "toxic"), 256)
    return a.select("doc_id", h().alias("x")).join(b.select("doc_id", h().alias("y")), "doc_id").select("doc_id", (F.col("x") == F.col("y")).alias("current"))


@query("J31_log_to_registry", f"WITH {HALVES} SELECT count_if(a.doc_id IS NULL)::BIGINT AS inserts, count_if(a.quality <> b.quality)::BIGINT AS drift FROM b LEFT JOIN a USING (doc_id)")
def log_to_registry(spark, sf):
    a, b = halves(spark, sf)
    o = merging.classify_insert(a, b, ["doc_id"], ["quality", "toxic"])
    return o.agg(F.count_if(F.col("outcome") == "inserted").alias("inserts"), F.count_if(F.col("outcome") == "conflict").alias("drift"))


@query("A40_status_rows", with_sql("SELECT condition, CASE WHEN count(DISTINCT conv_id) FILTER (WHERE split = 'dev') < 30 THEN 'sparse' ELSE 'ok' END AS status FROM p0 GROUP BY 1 UNION ALL SELECT 'not_run', 'absent'"))
def statuses(spark, sf):
    plan = spark.createDataFrame([(c,) for c in (*catalog.CONDITIONS, "not_run")], "condition string")
    n = p0(spark, sf).groupBy("condition").agg(F.countDistinct(F.when(F.col("split") == "dev", F.col("conv_id"))).alias("d"))
    return plan.join(n, "condition", "left").select("condition", F.when(F.col("d").isNull(), "absent").when(F.col("d") < 30, "sparse").otherwise("ok").alias("status"))


@query("U06_regenerate", f"WITH {HALVES} SELECT doc_id, 'vanished' AS change FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT doc_id, 'new' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)")
def regenerate(spark, sf):
    a, b = halves(spark, sf)
    return a.join(b, "doc_id", "left_anti").select("doc_id", F.lit("vanished").alias("change")).unionByName(b.join(a, "doc_id", "left_anti").select("doc_id", F.lit("new").alias("change")))


@query("U10_upsert", f"WITH {HALVES} SELECT doc_id, quality FROM b UNION ALL SELECT doc_id, quality FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)")
def upsert(spark, sf):
    a, b = halves(spark, sf)
    return merging.insert_only(b, a, ["doc_id"]).select("doc_id", "quality")


@query("U12_panel_sets", "SELECT 'missing' AS side, p_brand AS name FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 10 EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_size < 9) UNION ALL SELECT 'extra', p_brand FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 9 EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_size > 40) UNION ALL SELECT 'all', count(DISTINCT p_brand)::VARCHAR FROM part")
def panel_sets(spark, sf):
    p = t(spark, sf, "part")
    brands = lambda c: p.where(c).select("p_brand")
    side = lambda df, n: df.select(F.lit(n).alias("side"), F.col("p_brand").alias("name"))
    total = p.agg(F.countDistinct("p_brand").cast("string").alias("p_brand"))
    return side(brands("p_size > 10").subtract(brands("p_size < 9")), "missing").union(side(brands("p_size < 9").subtract(brands("p_size > 40")), "extra")).union(side(total, "all"))


@query("U15_assigned_episodes", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS episode FROM part WHERE p_size % 3 = 0")
def assigned(spark, sf):
    return t(spark, sf, "part").where("p_size % 3 = 0").select(F.explode(F.split("p_name", " ")).alias("episode")).distinct()


@query("U16_new_proposals", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def proposals(spark, sf):
    return t(spark, sf, "part").join(t(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("U18_amendment", f"WITH {HALVES} SELECT a.doc_id, coalesce(b.quality, a.quality) AS quality, a.toxic FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.toxic = b.toxic")
def amendment(spark, sf):
    """A change applies where the old value it names is still there."""
    a, b = halves(spark, sf)
    j = a.join(b.select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("old")), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("old") == F.col("toxic"), F.col("q")).otherwise(F.col("quality")).alias("quality"), "toxic")


@query("F08_fragment", with_sql("SELECT item_id, words <= 6 AS fragment FROM items"))
def fragment(spark, sf):
    return catalog.items(spark, sf).select("item_id", (F.col("words") <= 6).alias("fragment"))


@query("F16_text_digest", "SELECT doc_id, sha256(concat_ws(chr(31), 'doc_id=' || doc_id, 'lang=' || lang, 'text=' || text)) AS digest FROM documents")
def text_digest(spark, sf):
    return t(spark, sf, "documents").select("doc_id", passes.row_hash(["doc_id", "lang", "text"]).alias("digest"))


@query("F28_wanted_value", "SELECT p_partkey, contains(p_name, 'ring') OR contains(p_name, lower(p_type)) AS mentioned FROM part")
def wanted(spark, sf):
    return t(spark, sf, "part").select("p_partkey", (F.contains("p_name", F.lit("ring")) | F.contains("p_name", F.lower("p_type"))).alias("mentioned"))


@query("F56_cell_round_trip", "SELECT c_custkey, c_name AS back FROM customer")
def round_trip(spark, sf):
    cell = tx.sheet_safe(F.concat(F.when(F.col("c_custkey") % 2 == 0, "=").otherwise(""), "c_name"))
    back = F.regexp_replace(F.regexp_replace(cell, r"^'(?=[=+\-@])", ""), "^=", "")
    return t(spark, sf, "customer").select("c_custkey", back.alias("back"))


@query("F72_belief_domains", "WITH b AS (SELECT user_id, event_type AS domain, bool_or(value > 19.5) AS filled FROM events GROUP BY 1, 2) SELECT user_id, list_sort(list(domain)) AS domains FROM b WHERE filled GROUP BY 1")
def belief(spark, sf):
    b = t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") > 19.5).alias("filled"))
    m = b.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "filled"))).alias("m"))
    return m.select("user_id", F.array_sort(F.map_keys(F.map_filter("m", lambda _, v: v))).alias("domains")).where("size(domains) > 0")


@query("K14_log_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def log_order(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("B09_second_seed", with_sql(BOOT.replace(f"'{SEED}:'", f"'{SEED + 1}:'") + " SELECT condition, replicate, value FROM rep WHERE condition = 'full'"))
def second_seed(spark, sf):
    v = bootstrap.vectors(p0(spark, sf), ["condition"], "conv_id", correct().cast("int"), F.lit(1))
    return bootstrap.replicates_blocked(v, "condition", "conv_id", SAMPLES, SEED + 1).where("condition = 'full'")


@query("B22_primary_decision", with_sql(", c AS (SELECT count(DISTINCT conv_id) AS d FROM p0 WHERE split = 'dev') SELECT CASE WHEN d < 30 THEN 'refused_sparse' ELSE 'tested' END AS decision FROM c"))
def decision(spark, sf):
    return p0(spark, sf).where("split = 'dev'").agg(F.countDistinct("conv_id").alias("d")).select(F.when(F.col("d") < 30, "refused_sparse").otherwise("tested").alias("decision"))


@query("G09_amendment_chain", "SELECT o_custkey, count(*)::BIGINT AS links, bool_and(prev IS NULL OR prev <= o_orderdate) AS ordered FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) GROUP BY 1")
def chain(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t(spark, sf, "orders").withColumn("prev", F.lag("o_orderdate").over(w))
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("links"), F.bool_and(F.col("prev").isNull() | (F.col("prev") <= F.col("o_orderdate"))).alias("ordered"))


@query("G12_test_grid", with_sql("SELECT DISTINCT condition, seed FROM preds WHERE split = 'test' AND k < 3"))
def test_grid(spark, sf):
    return p3(spark, sf).where("split = 'test' AND k < 3").select("condition", "seed").distinct()


@query("G21_all_findings", " UNION ALL ".join(f"SELECT '{n}' AS finding, c_custkey AS key FROM customer WHERE {c}" for n, c in RULES))
def findings(spark, sf):
    return t(spark, sf, "customer").select(F.explode(audits.problems(RULES)).alias("finding"), F.col("c_custkey").alias("key"))


@query("G22_rebuilt_hashes", "SELECT count(*)::BIGINT AS n, 0::BIGINT AS differing FROM documents")
def rebuilt(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    again = t(spark, sf, "documents").select("doc_id", F.sha2(F.array_join(F.split("text", "\n"), "\n"), 256).alias("again"))
    return d.join(again, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h") != F.col("again")).alias("differing"))


@query("A04_levels_by_variant", with_sql("SELECT v.variant, 'L' || ((words + v.k) % 4) AS level, count(*)::BIGINT AS n FROM items, (VALUES (0, 'target'), (1, 'direct'), (2, 'indirect')) v(k, variant) GROUP BY 1, 2"))
def by_variant(spark, sf):
    v = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("variant")) for k, n in enumerate(("target", "direct", "indirect"))])).alias("v")
    i = catalog.items(spark, sf).select("words", v).select("v.variant", F.concat(F.lit("L"), ((F.col("words") + F.col("v.k")) % 4).cast("string")).alias("level"))
    return i.groupBy("variant", "level").agg(F.count(F.lit(1)).alias("n"))


