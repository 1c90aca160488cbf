"""Predictions: scores, contrasts, seeds, bootstrap, draws, hybrid composition."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone import catalog
from turnstone.catalog import with_sql
from turnstone.operators import bootstrap, sampling, scoring
from turnstone.registry import query

LABELS = [0, 1, 2]
CONTRASTS = [("one", "none"), ("full", "none"), ("full", "one"), ("full", "mismatched"), ("one", "mismatched_one")]


def correct():
    return F.col("gold") == F.col("pred")



def p0(spark, sf):
    return catalog.predictions(spark, sf)


def p3(spark, sf):
    return catalog.predictions(spark, sf, catalog.SEEDS)


REPORT = """, l AS (SELECT unnest([0, 1, 2]) AS label), per AS (SELECT {by}, label, count_if(gold = label AND pred = label) AS hit, count_if(gold = label) AS g, count_if(pred = label) AS p, count(*) AS n FROM p0, l GROUP BY ALL)
SELECT {by}, max(n)::BIGINT AS n, sum(hit)::DOUBLE / max(n) AS accuracy, avg(CASE WHEN g + p > 0 THEN 2.0::DOUBLE * hit / (g + p) ELSE 0 END) AS macro_f1 FROM per GROUP BY {by}"""


@query("A01_score_report", with_sql(REPORT.format(by="condition")))
def report(spark, sf):
    return scoring.report(p0(spark, sf), ["condition"], LABELS)


@query("A02_score_by_slice", with_sql(REPORT.format(by="condition, split")))
def by_slice(spark, sf):
    return scoring.report(p0(spark, sf), ["condition", "split"], LABELS)


@query("A01_confusion", with_sql(", l AS (SELECT unnest([0, 1, 2]) AS label) SELECT c.condition, a.label AS gold, b.label AS pred, (SELECT count(*) FROM p0 WHERE p0.condition = c.condition AND p0.gold = a.label AND p0.pred = b.label)::BIGINT AS n FROM conditions c, l a, l b"))
def confusion(spark, sf):
    return scoring.confusion(p0(spark, sf), ["condition"], LABELS)


@query("A03_kappa", "WITH r AS (SELECT l.quality AS a, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS b, d.lang FROM labels l JOIN documents d USING (doc_id)), t AS (SELECT lang, count(*) AS n, count_if(a = b) AS same, sum(CASE WHEN a = 1 THEN 1 ELSE 0 END) AS a1, sum(CASE WHEN b = 1 THEN 1 ELSE 0 END) AS b1 FROM r GROUP BY 1), u AS (SELECT lang, n::BIGINT AS n, same::DOUBLE / n AS observed, (a1 * b1 + (n - a1) * (n - b1))::DOUBLE / (n * n) AS expected FROM t) SELECT *, CASE WHEN expected = 1 THEN 1.0 ELSE (observed - expected) / (1 - expected) END::DOUBLE AS kappa FROM u")
def kappa(spark, sf):
    d = catalog.table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 1500).cast("int").alias("b"))
    r = catalog.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("a")).join(d, "doc_id")
    return scoring.kappa(r, ["lang"], "a", "b")


@query("A04_agreement", "WITH r AS (SELECT quality AS a, toxic AS b FROM labels) SELECT a AS first, b AS second, count(*)::BIGINT AS n FROM r GROUP BY 1, 2")
def agreement(spark, sf):
    return catalog.table(spark, sf, "labels").groupBy(F.col("quality").alias("first"), F.col("toxic").alias("second")).agg(F.count(F.lit(1)).alias("n"))


PAIR = " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, count(*)::BIGINT AS n, avg((x.gold = x.pred)::INT - (y.gold = y.pred)::INT) AS diff, count(DISTINCT x.conv_id)::BIGINT AS n_dialogues FROM p0 x JOIN p0 y ON x.item_id = y.item_id AND x.condition = '{a}' AND y.condition = '{b}'" for a, b in CONTRASTS)


@query("J11_paired_contrasts", with_sql(PAIR))
def paired(spark, sf):
    return scoring.paired(p0(spark, sf), CONTRASTS, correct().cast("int"))


@query("P15_contrast_set", " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, '{'mismatch' if 'mis' in a + b else 'genuine'}' AS name" for a, b in CONTRASTS))
def contrast_set(spark, sf):
    c = spark.createDataFrame(CONTRASTS, "first string, second string")
    mis = F.col("first").startswith("mis") | F.col("second").startswith("mis")
    return c.withColumn("name", F.when(mis, "mismatch").otherwise("genuine"))


@query("A16_seed_average", with_sql("SELECT item_id, condition, avg((gold = pred)::INT) AS value FROM preds GROUP BY 1, 2"))
def seed_average(spark, sf):
    return p3(spark, sf).groupBy("item_id", "condition").agg(F.avg(correct().cast("int")).alias("value"))


@query("A17_seed_variation", with_sql(", r AS (SELECT condition, seed, avg((gold = pred)::INT) AS rate FROM preds GROUP BY 1, 2) SELECT condition, avg(rate) AS mean, stddev_samp(rate) AS sd, min(rate) AS low, max(rate) AS high FROM r GROUP BY 1"))
def seed_variation(spark, sf):
    r = p3(spark, sf).groupBy("condition", "seed").agg(F.avg(correct().cast("int")).alias("rate"))
    return r.groupBy("condition").agg(F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("sd"), F.min("rate").alias("low"), F.max("rate").alias("high"))


@query("A18_seed_rates", with_sql("SELECT seed, condition, avg((gold = pred)::INT) AS rate FROM preds GROUP BY 1, 2"))
def seed_rates(spark, sf):
    return p3(spark, sf).groupBy("seed", "condition").agg(F.avg(correct().cast("int")).alias("rate"))


@query("A19_seed_contrasts", with_sql("SELECT x.seed, avg((x.gold = x.pred)::INT - (y.gold = y.pred)::INT) AS diff FROM preds x JOIN preds y ON x.item_id = y.item_id AND x.seed = y.seed AND x.condition = 'full' AND y.condition = 'none' GROUP BY 1"))
def seed_contrasts(spark, sf):
    w = p3(spark, sf).where("condition IN ('full', 'none')").groupBy("item_id", "seed").pivot("condition", ["full", "none"]).agg(F.max(correct().cast("int")))
    return w.groupBy("seed").agg(F.avg(F.col("full") - F.col("none")).alias("diff"))


@query("A20_dialogue_sums", with_sql("SELECT condition, conv_id, sum((gold = pred)::INT)::DOUBLE AS num, count(*)::DOUBLE AS den FROM p0 GROUP BY 1, 2"))
def sums(spark, sf):
    return bootstrap.vectors(p0(spark, sf), ["condition"], "conv_id", correct().cast("int"), F.lit(1))


@query("A30_mean_of_means", with_sql(", r AS (SELECT split, condition, seed, avg((gold = pred)::INT) AS rate FROM preds GROUP BY 1, 2, 3) SELECT split, avg(rate) AS mean, count(*)::BIGINT AS cells FROM r GROUP BY 1"))
def mean_of_means(spark, sf):
    r = p3(spark, sf).groupBy("split", "condition", "seed").agg(F.avg(correct().cast("int")).alias("rate"))
    return r.groupBy("split").agg(F.avg("rate").alias("mean"), F.count(F.lit(1)).alias("cells"))


@query("A31_hybrid_rate", with_sql("SELECT seed, avg((gold = pred AND gold <> 0)::INT) AS rate FROM preds WHERE condition = 'full' AND split <> 'test' GROUP BY 1"))
def hybrid_rate(spark, sf):
    return p3(spark, sf).where("condition = 'full' AND split <> 'test'").groupBy("seed").agg(F.avg((correct() & (F.col("gold") != 0)).cast("int")).alias("rate"))


@query("A22_detection", with_sql("SELECT condition, count_if(gold <> 0 AND pred <> 0)::BIGINT AS tp, count_if(gold = 0 AND pred <> 0)::BIGINT AS fp, count_if(gold <> 0)::BIGINT AS requests, count_if(gold <> 0 AND pred <> 0)::DOUBLE / count_if(pred <> 0) AS precision, count_if(gold <> 0 AND pred <> 0)::DOUBLE / count_if(gold <> 0) AS recall FROM p0 GROUP BY 1"))
def detection(spark, sf):
    g, p = F.col("gold") != 0, F.col("pred") != 0
    return p0(spark, sf).groupBy("condition").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g).alias("requests"), (F.count_if(g & p) / F.count_if(p)).alias("precision"), (F.count_if(g & p) / F.count_if(g)).alias("recall"))


LEVEL = "CASE WHEN words % 4 = 0 THEN 'L0' WHEN words % 4 = 1 THEN 'L1' WHEN words % 4 = 2 THEN 'L2' ELSE 'L3' END"


def level(c="words"):
    return F.concat(F.lit("L"), (F.col(c) % 4).cast("string"))


@query("A26_majority_without_own", with_sql(f", r AS (SELECT conv_id, {LEVEL} AS label FROM items), t AS (SELECT label, count(*) AS n FROM r GROUP BY 1), g AS (SELECT d.conv_id, t.label, t.n - (SELECT count(*) FROM r WHERE r.conv_id = d.conv_id AND r.label = t.label) AS rest FROM (SELECT DISTINCT conv_id FROM r) d, t) SELECT conv_id, arg_max(label, rest * 10 - right(label, 1)::INT) AS majority FROM g GROUP BY 1"))
def majority(spark, sf):
    return scoring.majority_without_own(catalog.items(spark, sf).select("conv_id", level().alias("label")), "conv_id", "label", ["L0", "L1", "L2", "L3", "INF", "NR"])


@query("A13_grouping_sets", with_sql(f"SELECT split, {LEVEL} AS level, grouping(split)::INT AS g_split, grouping({LEVEL})::INT AS g_level, count(*)::BIGINT AS n, avg((turn = 0)::INT) AS first_share FROM items GROUP BY GROUPING SETS ((), (split), ({LEVEL}))"))
def grouping(spark, sf):
    catalog.items(spark, sf).withColumn("level", level()).createOrReplaceTempView("turnstone_items")
    return spark.sql("SELECT split, level, cast(grouping(split) AS int) AS g_split, cast(grouping(level) AS int) AS g_level, count(*) AS n, avg(cast(turn = 0 AS int)) AS first_share FROM turnstone_items GROUP BY GROUPING SETS ((), (split), (level))")


@query("W06_argmax_label", with_sql(", q AS (SELECT item_id, condition, [(conv_id + k) % 5, (turn + k) % 5, (conv_id + turn) % 5] AS p FROM p0) SELECT item_id, condition, list_position(p, list_max(p)) - 1 AS best FROM q"))
def argmax(spark, sf):
    p = p0(spark, sf)
    probs = [(F.col("conv_id") + F.col("k")) % 5, (F.col("turn") + F.col("k")) % 5, (F.col("conv_id") + F.col("turn")) % 5]
    return p.select("item_id", "condition", scoring.first_best(probs, LABELS).alias("best"))


@query("W07_holm", "WITH m AS (SELECT o_orderpriority AS member, (count(*) % 97) / 970.0::DOUBLE AS p FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, member) AS r, count(*) OVER () AS m FROM m) SELECT member, p, max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS adjusted FROM r")
def holm(spark, sf):
    m = catalog.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("member")).agg(((F.count(F.lit(1)) % 97) / 970.0).alias("p"))
    return bootstrap.holm(m)


@query("W08_percentile", "SELECT s AS lang, (list(n_chars ORDER BY n_chars))[(floor((count(*) - 1) * 0.025) + 1)::BIGINT] AS low FROM (SELECT lang AS s, n_chars FROM documents) GROUP BY 1")
def percentile(spark, sf):
    return scoring.order_statistic(catalog.table(spark, sf, "documents"), ["lang"], "n_chars", 0.025).withColumnRenamed("n_chars", "low")


SAMPLES, SEED = 10_000, 20261020  #: the plan's constants
BOOT = f""", v AS (SELECT condition, conv_id, sum((gold = pred)::INT)::DOUBLE AS num, count(*)::DOUBLE AS den FROM p0 GROUP BY 1, 2),
c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM p0)),
draws AS (SELECT r.r AS replicate, (('0x' || substr(md5('{SEED}:' || r.r || ':' || j.j), 1, 8))::BIGINT) % (SELECT max(n) FROM c) AS i FROM (SELECT unnest(range({SAMPLES})) AS r) r, (SELECT unnest(range((SELECT max(n) FROM c))) AS j) j),
w AS (SELECT replicate, conv_id, count(*) AS w FROM draws JOIN c USING (i) GROUP BY 1, 2),
rep AS (SELECT condition, replicate, CASE WHEN sum(w * den) <> 0 THEN sum(w * num) / sum(w * den) END AS value FROM v JOIN w USING (conv_id) GROUP BY 1, 2)"""
SUMMARY = """SELECT {k}, (list(value ORDER BY value))[(floor((count(value) - 1) * 0.025) + 1)::BIGINT] AS low, (list(value ORDER BY value))[(floor((count(value) - 1) * 0.975) + 1)::BIGINT] AS high,
greatest(1.0::DOUBLE / count(value), least(1.0::DOUBLE, 2.0::DOUBLE * least(count_if(value <= 0), count_if(value >= 0)) / count(value))) AS p, count(value)::BIGINT AS replicates, (count(*) - count(value))::BIGINT AS excluded, false AS unstable FROM {t} GROUP BY 1"""


def boot(spark, sf):
    p = p0(spark, sf)
    return bootstrap.replicates_blocked(bootstrap.vectors(p, ["condition"], "conv_id", correct().cast("int"), F.lit(1)), "condition", "conv_id", SAMPLES, SEED)


@query("B03_shared_bootstrap", with_sql(BOOT + " SELECT * FROM rep"))
def shared(spark, sf):
    return boot(spark, sf)


@query("B01_bootstrap_interval", with_sql(BOOT + " " + SUMMARY.format(k="condition", t="rep")))
def interval(spark, sf):
    return bootstrap.summary(boot(spark, sf), ["condition"])


@query("B04_interval_and_p", with_sql(BOOT + " SELECT condition, low, high, p FROM (" + SUMMARY.format(k="condition", t="rep") + ")"))
def interval_p(spark, sf):
    return bootstrap.summary(boot(spark, sf), ["condition"]).select("condition", "low", "high", "p")


TERMS = [("full-none", "full", 1.0), ("full-none", "none", -1.0), ("quadratic", "none", 1.0), ("quadratic", "one", -2.0), ("quadratic", "full", 1.0), ("linear", "none", -1.0), ("linear", "full", 1.0)]
DERIVED = ", terms AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{s}', {c}::DOUBLE)" for d, s, c in TERMS) + ") t(derived, condition, coef)), dv AS (SELECT derived, replicate, sum(coef * value) AS value FROM rep JOIN terms USING (condition) GROUP BY 1, 2)"


def derived_values(spark, sf):
    return bootstrap.derived(boot(spark, sf).withColumnRenamed("condition", "stat"), spark.createDataFrame(TERMS, "derived string, stat string, coef double"))


@query("B02_paired_bootstrap", with_sql(BOOT + DERIVED + " SELECT derived, replicate, round(value, 9) AS value FROM dv WHERE derived = 'full-none'"))
def paired_boot(spark, sf):
    return derived_values(spark, sf).where("derived = 'full-none'").withColumn("value", F.round("value", 9))


@query("B11_trends", with_sql(BOOT + DERIVED + " SELECT derived, round(avg(value), 9) AS mean, count(*)::BIGINT AS n FROM dv WHERE derived <> 'full-none' GROUP BY 1"))
def trends(spark, sf):
    return derived_values(spark, sf).where("derived <> 'full-none'").groupBy("derived").agg(F.round(F.avg("value"), 9).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("B05_bootstrap_p", with_sql(BOOT + DERIVED + " SELECT derived, greatest(1.0::DOUBLE / count(*), least(1.0::DOUBLE, 2.0::DOUBLE * least(count_if(round(value, 9) <= 0), count_if(round(value, 9) >= 0)) / count(*))) AS p FROM dv GROUP BY 1"))
def boot_p(spark, sf):
    return bootstrap.summary(derived_values(spark, sf).withColumn("value", F.round("value", 9)), ["derived"]).select("derived", "p")


@query("B17_holm_family", with_sql(BOOT + DERIVED + ", ps AS (SELECT derived AS member, greatest(1.0::DOUBLE / count(*), least(1.0::DOUBLE, 2.0::DOUBLE * least(count_if(round(value, 9) <= 0), count_if(round(value, 9) >= 0)) / count(*))) AS p FROM dv GROUP BY 1 UNION ALL SELECT 'absent', NULL), r AS (SELECT *, coalesce(p, 1.0) AS q, row_number() OVER (ORDER BY coalesce(p, 1.0), member) AS r, count(*) OVER () AS m FROM ps) SELECT member, p, max(least(1.0::DOUBLE, (m - r + 1) * q)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS adjusted FROM r"))
def family(spark, sf):
    p = bootstrap.summary(derived_values(spark, sf).withColumn("value", F.round("value", 9)), ["derived"]).select(F.col("derived").alias("member"), "p")
    plan = spark.createDataFrame([("full-none",), ("quadratic",), ("linear",), ("absent",)], "member string")
    return bootstrap.holm(plan.join(p, "member", "left"))


@query("B10_benefit_by_level", with_sql(f", b AS (SELECT CASE WHEN i.words % 4 = 3 THEN 'L3' WHEN i.words % 4 = 2 THEN 'L2' WHEN i.words % 4 = 1 THEN 'L1' ELSE 'L0' END AS level, (x.gold = x.pred)::INT - (y.gold = y.pred)::INT AS d FROM p0 x JOIN p0 y ON x.item_id = y.item_id AND x.condition = 'full' AND y.condition = 'none' JOIN items i ON i.item_id = x.item_id) SELECT level, avg(d) AS benefit, count(*)::BIGINT AS n FROM b GROUP BY GROUPING SETS ((), (level))"))
def benefit(spark, sf):
    w = p0(spark, sf).where("condition IN ('full', 'none')").groupBy("item_id").pivot("condition", ["full", "none"]).agg(F.max(correct().cast("int")))
    w.join(catalog.items(spark, sf).select("item_id", level().alias("level")), "item_id").createOrReplaceTempView("turnstone_benefit")
    return spark.sql("SELECT level, avg(full - none) AS benefit, count(*) AS n FROM turnstone_benefit GROUP BY GROUPING SETS ((), (level))")


@query("B15_by_category", with_sql("SELECT gold AS category, condition, avg((gold = pred)::INT) AS rate, count(DISTINCT conv_id)::BIGINT AS dialogues FROM p0 GROUP BY 1, 2"))
def by_category(spark, sf):
    return p0(spark, sf).groupBy(F.col("gold").alias("category"), "condition").agg(F.avg(correct().cast("int")).alias("rate"), F.countDistinct("conv_id").alias("dialogues"))


@query("B16_standardized", with_sql(", c AS (SELECT condition, gold, avg((gold = pred)::INT) AS rate, count(*) AS n FROM p0 WHERE split = 'train' GROUP BY 1, 2), k AS (SELECT gold, sum(n) AS n FROM c GROUP BY 1 HAVING count(*) = 5) SELECT condition, sum(rate * k.n) / sum(k.n) AS standardized FROM c JOIN k USING (gold) GROUP BY 1"))
def standardized(spark, sf):
    c = p0(spark, sf).where("split = 'train'").groupBy("condition", "gold").agg(F.avg(correct().cast("int")).alias("rate"), F.count(F.lit(1)).alias("n"))
    k = c.groupBy("gold").agg(F.sum("n").alias("mix"), F.count(F.lit(1)).alias("levels")).where("levels = 5")
    return c.join(k, "gold").groupBy("condition").agg((F.sum(F.col("rate") * F.col("mix")) / F.sum("mix")).alias("standardized"))


@query("B21_cell_status", with_sql(f", c AS (SELECT {LEVEL} AS level, split, count(DISTINCT conv_id) AS d FROM items GROUP BY 1, 2) SELECT level, split, d::BIGINT AS dialogues, CASE WHEN d = 0 THEN 'empty' WHEN d < 30 THEN 'sparse' ELSE 'ok' END AS status FROM c"))
def cell_status(spark, sf):
    c = catalog.items(spark, sf).groupBy(level().alias("level"), "split").agg(F.countDistinct("conv_id").alias("dialogues"))
    return c.withColumn("status", F.when(F.col("dialogues") == 0, "empty").when(F.col("dialogues") < 30, "sparse").otherwise("ok"))


@query("B26_cross_check", with_sql("SELECT condition, count_if(gold = pred)::BIGINT AS direct, sum(num)::BIGINT AS summed FROM p0 JOIN (SELECT condition AS c, count_if(gold = pred) AS num FROM p0 GROUP BY 1) v ON v.c = condition GROUP BY condition, num").replace("sum(num)::BIGINT", "num::BIGINT"))
def cross_check(spark, sf):
    p = p0(spark, sf)
    a = p.groupBy("condition").agg(F.count_if(correct()).alias("direct"))
    b = bootstrap.vectors(p, ["condition"], "conv_id", correct().cast("int"), F.lit(1)).groupBy("condition").agg(F.sum("num").cast("long").alias("summed"))
    return a.join(b, "condition")


@query("J08_coverage", with_sql(", a AS (SELECT item_id, condition FROM p0 WHERE conv_id % 7 <> 3 UNION ALL SELECT item_id, condition FROM p0 WHERE conv_id % 7 = 4 UNION ALL SELECT 'x' || item_id, condition FROM p0 WHERE turn = 0), k AS (SELECT item_id, condition, count(*) AS t FROM a GROUP BY 1, 2), j AS (SELECT CASE WHEN k.t IS NULL THEN 'missing' WHEN e.item_id IS NULL THEN 'extra' WHEN k.t > 1 THEN 'duplicated' END AS problem FROM p0 e FULL JOIN k ON e.item_id = k.item_id AND e.condition = k.condition) SELECT problem, count(*)::BIGINT AS n FROM j WHERE problem IS NOT NULL GROUP BY 1"))
def coverage(spark, sf):
    p = p0(spark, sf).select("item_id", "condition", "conv_id", "turn")
    a = p.where("conv_id % 7 <> 3").unionAll(p.where("conv_id % 7 = 4")).unionAll(p.where("turn = 0").withColumn("item_id", F.concat(F.lit("x"), "item_id")))
    return scoring.coverage(p, a, ["item_id", "condition"])


@query("J09_exactly_one", with_sql("SELECT count(*)::BIGINT AS expected, count(DISTINCT item_id || condition)::BIGINT AS distinct_keys FROM p0"))
def exactly_one(spark, sf):
    return p0(spark, sf).agg(F.count(F.lit(1)).alias("expected"), F.countDistinct(F.concat("item_id", "condition")).alias("distinct_keys"))


HYBRID = ", h AS (SELECT r.item_id, r.condition, r.gold, r.pred AS route, (r.pred + i.pred) % 3 AS slot, i.pred = 2 AS invalid FROM p0 r JOIN preds i ON r.item_id = i.item_id AND r.condition = i.condition AND i.seed = 1), o AS (SELECT item_id, condition, CASE WHEN route = 0 THEN 'no_request' WHEN invalid THEN 'invalid' ELSE 'request:' || slot END AS outcome FROM h)"


def hybrid(spark, sf):
    p = p3(spark, sf)
    i = p.where("seed = 1").select("item_id", "condition", F.col("pred").alias("ip"))
    h = p.where("seed = 0").join(i, ["item_id", "condition"])
    out = F.when(F.col("pred") == 0, "no_request").when(F.col("ip") == 2, "invalid").otherwise(F.concat(F.lit("request:"), ((F.col("pred") + F.col("ip")) % 3).cast("string")))
    return h.select("item_id", "condition", out.alias("outcome"))


@query("J07_hybrid_composition", with_sql(HYBRID + " SELECT * FROM o"))
def compose(spark, sf):
    """The router's no_request wins even over an invalid interpretation."""
    return hybrid(spark, sf)


@query("M16_hybrid_summary", with_sql(HYBRID + " SELECT condition, outcome, count(*)::BIGINT AS n FROM o GROUP BY 1, 2"))
def hybrid_summary(spark, sf):
    return hybrid(spark, sf).groupBy("condition", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("A29_invalid_counts", with_sql(HYBRID + " SELECT condition, count_if(outcome = 'invalid')::BIGINT AS invalid FROM o GROUP BY 1"))
def invalid(spark, sf):
    return hybrid(spark, sf).groupBy("condition").agg(F.count_if(F.col("outcome") == "invalid").alias("invalid"))


@query("P11_endpoint_population", with_sql("SELECT condition, count(*)::BIGINT AS stage1_correct, count_if(gold <> 0)::BIGINT AS request_detected, count_if(gold = 1)::BIGINT AS request_interpretation, count_if(gold = 1 AND turn % 2 = 0)::BIGINT AS oracle_exact FROM p0 GROUP BY 1"))
def populations(spark, sf):
    g = F.col("gold")
    return p0(spark, sf).groupBy("condition").agg(F.count(F.lit(1)).alias("stage1_correct"), F.count_if(g != 0).alias("request_detected"), F.count_if(g == 1).alias("request_interpretation"), F.count_if((g == 1) & (F.col("turn") % 2 == 0)).alias("oracle_exact"))


@query("F42_endpoints", with_sql("SELECT item_id, condition, gold = pred AS correct, pred <> 0 AS detected, gold = pred AND pred <> 0 AS exact FROM p0"))
def endpoints(spark, sf):
    return p0(spark, sf).select("item_id", "condition", correct().alias("correct"), (F.col("pred") != 0).alias("detected"), (correct() & (F.col("pred") != 0)).alias("exact"))


@query("J28_required_runs", with_sql("SELECT c.condition, s.seed FROM conditions c, (SELECT unnest([0, 1, 2, 3]) AS seed) s WHERE NOT EXISTS (SELECT 1 FROM preds p WHERE p.condition = c.condition AND p.seed = s.seed)"))
def required(spark, sf):
    want = catalog.conditions(spark).select("condition", F.explode(F.array(*map(F.lit, range(4)))).alias("seed"))
    return want.join(p3(spark, sf).select("condition", "seed").distinct(), ["condition", "seed"], "left_anti")


@query("G26_filling_model", with_sql("SELECT condition, CASE WHEN condition LIKE 'mis%' THEN 'train-full' ELSE 'train-' || condition END AS matched, 'train-full' AS test_time FROM conditions"))
def filling(spark, sf):
    return catalog.conditions(spark).select("condition", F.when(F.col("condition").startswith("mis"), "train-full").otherwise(F.concat(F.lit("train-"), "condition")).alias("matched"), F.lit("train-full").alias("test_time"))


KEY = "md5('5:' || {k})"


@query("K02_uniform_sample", with_sql("SELECT item_id FROM items WHERE split = 'train' ORDER BY md5('5:' || item_id), item_id LIMIT 20"))
def uniform(spark, sf):
    return sampling.sample(catalog.items(spark, sf).where("split = 'train'").select("item_id"), 20, 5, "item_id")


@query("K03_fresh_sample", with_sql(", old AS (SELECT item_id FROM items WHERE split = 'train' ORDER BY md5('5:' || item_id), item_id LIMIT 20) SELECT item_id FROM items WHERE split = 'train' AND item_id NOT IN (SELECT item_id FROM old) ORDER BY md5('6:' || item_id), item_id LIMIT 20"))
def fresh(spark, sf):
    i = catalog.items(spark, sf).where("split = 'train'").select("item_id")
    return sampling.sample(i.join(sampling.sample(i, 20, 5, "item_id"), "item_id", "left_anti"), 20, 6, "item_id")


@query("K04_opaque_ids", with_sql("SELECT item_id, 'r' || lpad((row_number() OVER (ORDER BY md5('5:' || item_id), item_id))::VARCHAR, 4, '0') AS row_id FROM items WHERE split = 'dev'"))
def opaque(spark, sf):
    n = F.row_number().over(Window.orderBy(sampling.draw_key(5, "item_id"), "item_id"))  # a sheet of a few drawn rows
    return catalog.items(spark, sf).where("split = 'dev'").select("item_id", F.concat(F.lit("r"), F.lpad(n.cast("string"), 4, "0")).alias("row_id"))


@query("K05_two_stage", with_sql(", c AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM items) ORDER BY md5('5:' || conv_id), conv_id LIMIT 12) SELECT conv_id, item_id FROM items JOIN c USING (conv_id) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY md5('6:' || item_id), item_id) = 1"))
def two_stage(spark, sf):
    return sampling.two_stage(catalog.items(spark, sf), "conv_id", 12, 5, "item_id").select("conv_id", "item_id")


@query("K06_cluster_sample", with_sql(", c AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM items) ORDER BY md5('5:' || conv_id), conv_id LIMIT 12) SELECT item_id FROM items JOIN c USING (conv_id)"))
def cluster_sample(spark, sf):
    return sampling.clusters(catalog.items(spark, sf), "conv_id", 12, 5).select("item_id")


@query("K07_stratified", with_sql(f"SELECT {LEVEL} AS level, item_id FROM items QUALIFY row_number() OVER (PARTITION BY {LEVEL} ORDER BY md5('5:' || item_id), item_id) <= 15"))
def stratified(spark, sf):
    return sampling.per_group(catalog.items(spark, sf).select(level().alias("level"), "item_id"), ["level"], 15, 5, "item_id")


@query("K08_one_per_dialogue", with_sql(f", a AS (SELECT {LEVEL} AS level, conv_id, item_id FROM items QUALIFY row_number() OVER (PARTITION BY {LEVEL}, conv_id ORDER BY md5('5:' || item_id), item_id) = 1) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY level ORDER BY md5('5:' || item_id), item_id) <= 6"))
def one_per(spark, sf):
    return sampling.one_per(catalog.items(spark, sf).select(level().alias("level"), "conv_id", "item_id"), ["level"], "conv_id", 6, 5, "item_id")


@query("K11_strided", with_sql("SELECT split, item_id FROM items QUALIFY (row_number() OVER (PARTITION BY split ORDER BY item_id) - 1) % 5 = 0"))
def strided(spark, sf):
    return sampling.strided(catalog.items(spark, sf).select("split", "item_id"), ["split"], ["item_id"], 5)


@query("K15_call_order", with_sql("SELECT item_id, row_number() OVER (ORDER BY sha256(text), item_id) AS call FROM items WHERE split = 'dev'"))
def call_order(spark, sf):
    return catalog.items(spark, sf).where("split = 'dev'").select("item_id", F.row_number().over(Window.orderBy(F.sha2("text", 256), "item_id")).cast("long").alias("call"))


@query("K16_prompt_choice", with_sql(", r AS (SELECT condition AS prompt, avg((gold = pred)::INT) AS mean FROM preds WHERE condition IN ('none', 'full') GROUP BY 1) SELECT CASE WHEN max(mean) - max(CASE WHEN prompt = 'none' THEN mean END) <= 0.01 THEN 'none' ELSE arg_max(prompt, mean) END AS chosen FROM r"))
def prompt_choice(spark, sf):
    """The best mean, but the first prompt wins within 0.01."""
    r = p3(spark, sf).where("condition IN ('none', 'full')").groupBy(F.col("condition").alias("prompt")).agg(F.avg(correct().cast("int")).alias("mean"))
    first = F.max(F.when(F.col("prompt") == "none", F.col("mean")))
    return r.agg(F.when(F.max("mean") - first <= 0.01, "none").otherwise(F.max_by("prompt", "mean")).alias("chosen"))


@query("K18_error_set", with_sql("SELECT item_id FROM preds WHERE condition = 'full' GROUP BY 1 HAVING avg((gold = pred)::INT) < 0.5"))
def error_set(spark, sf):
    return p3(spark, sf).where("condition = 'full'").groupBy("item_id").agg(F.avg(correct().cast("int")).alias("v")).where("v < 0.5").select("item_id")


@query("K19_lowest_failing_seed", with_sql("SELECT item_id, arg_min(pred, seed) AS pred, min(seed) AS seed FROM preds WHERE condition = 'full' AND gold <> pred GROUP BY 1"))
def failing_seed(spark, sf):
    return p3(spark, sf).where((F.col("condition") == "full") & ~correct()).groupBy("item_id").agg(F.min_by("pred", "seed").alias("pred"), F.min("seed").alias("seed"))


