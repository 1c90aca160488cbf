"""Composite reports, sensitivity lines, pass labels, prepared inputs and the linear baseline."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone import catalog
from turnstone.catalog import with_sql
from turnstone.functions.text import word_count
from turnstone.operators import bootstrap, contexts, models, passes
from turnstone.plans.context_queries import DONORS, budget_sql
from turnstone.plans.scoring_queries import BOOT, DERIVED, LEVEL, SUMMARY, boot, correct, derived_values, level, p0, p3
from turnstone.registry import query


@query("A11_manifest_counts", with_sql(DONORS + " SELECT i.split, count(*)::BIGINT AS rows, count(d.donor)::BIGINT AS mismatch_set, count(DISTINCT sha256(i.text))::BIGINT AS targets FROM items i LEFT JOIN d USING (conv_id, turn) GROUP BY 1"))
def manifest(spark, sf):
    i = catalog.items(spark, sf).join(contexts.donors(catalog.turns(spark, sf)).select("conv_id", "turn", "donor"), ["conv_id", "turn"], "left")
    return i.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count("donor").alias("mismatch_set"), F.countDistinct(F.sha2("text", 256)).alias("targets"))


@query("A21_stage1_report", with_sql(f"SELECT CASE WHEN grouping(condition) = 0 AND grouping(split) = 0 THEN 'split' WHEN grouping(gold) = 0 THEN 'gold' ELSE 'condition' END AS slice, condition, split, gold, avg((gold = pred)::INT) AS accuracy, count(*)::BIGINT AS n FROM p0 GROUP BY GROUPING SETS ((condition), (condition, split), (condition, gold))"))
def stage1_report(spark, sf):
    p0(spark, sf).createOrReplaceTempView("turnstone_p0")
    return spark.sql("SELECT CASE WHEN grouping(condition) = 0 AND grouping(split) = 0 THEN 'split' WHEN grouping(gold) = 0 THEN 'gold' ELSE 'condition' END AS slice, condition, split, gold, avg(cast(gold = pred AS int)) AS accuracy, count(*) AS n FROM turnstone_p0 GROUP BY GROUPING SETS ((condition), (condition, split), (condition, gold))")


@query("A24_rate_with_interval", with_sql(BOOT + ", s AS (" + SUMMARY.format(k="condition", t="rep") + "), a AS (SELECT condition, avg((gold = pred)::INT) AS rate, count(*)::BIGINT AS n, count(DISTINCT conv_id)::BIGINT AS dialogues FROM p0 GROUP BY 1) SELECT a.*, low, high FROM a JOIN s USING (condition)"))
def rate(spark, sf):
    """Each condition's rate, its cell's sizes and its cluster-bootstrap interval."""
    cells = p0(spark, sf).groupBy("condition").agg(F.avg(correct().cast("int")).alias("rate"), F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("dialogues"))
    return cells.join(bootstrap.summary(boot(spark, sf), ["condition"]).select("condition", "low", "high"), "condition")


@query("A39_slot_states", "WITH s AS (SELECT DISTINCT p_size % 6 AS slot FROM part), i AS (SELECT DISTINCT p_brand AS intent FROM part), f AS (SELECT p_brand AS intent, p_size % 6 AS slot, count(*) AS n, bool_or(p_retailprice > 1000) AS sure FROM part WHERE p_size % 5 > 0 GROUP BY 1, 2) SELECT i.intent, s.slot, CASE WHEN f.n IS NULL THEN 'absent' WHEN sure THEN 'stated' ELSE '?' END AS state FROM i, s LEFT JOIN f ON f.intent = i.intent AND f.slot = s.slot")
def slot_states(spark, sf):
    p = catalog.table(spark, sf, "part").withColumn("slot", F.col("p_size") % 6).withColumnRenamed("p_brand", "intent")
    f = p.where("p_size % 5 > 0").groupBy("intent", "slot").agg(F.bool_or(F.col("p_retailprice") > 1000).alias("sure"))
    grid = p.select("intent").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(5))))  # six slots, a fixed list
    return grid.join(f, ["intent", "slot"], "left").select("intent", "slot", F.when(F.col("sure").isNull(), "absent").when(F.col("sure"), "stated").otherwise("?").alias("state"))


@query("B07_registered_rates", with_sql(f"SELECT {LEVEL} AS level, split, count(*)::BIGINT AS n, count(DISTINCT conv_id)::BIGINT AS dialogues, min(conv_id) AS first FROM items GROUP BY 1, 2"))
def registered(spark, sf):
    return catalog.items(spark, sf).groupBy(level().alias("level"), "split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("dialogues"), F.min("conv_id").alias("first"))


RATES = ", lv AS (SELECT i.item_id, CASE WHEN i.words % 4 = 3 THEN 'L3' WHEN i.words % 4 = 2 THEN 'L2' WHEN i.words % 4 = 1 THEN 'L1' ELSE 'L0' END AS level FROM items i), lr AS (SELECT level, condition, avg((gold = pred)::INT) AS rate FROM p0 JOIN lv USING (item_id) GROUP BY 1, 2)"


def level_rates(spark, sf):
    lv = catalog.items(spark, sf).select("item_id", level().alias("level"))
    return p0(spark, sf).join(lv, "item_id").groupBy("level", "condition").agg(F.avg(correct().cast("int")).alias("rate"))


def at(name):
    return F.max(F.when(F.col("level") == name, F.col("rate")))


@query("B12_rates_and_trends", with_sql(RATES + " SELECT condition, max(CASE level WHEN 'L2' THEN rate END) - max(CASE level WHEN 'L0' THEN rate END) AS linear, max(CASE level WHEN 'L0' THEN rate END) - 2 * max(CASE level WHEN 'L1' THEN rate END) + max(CASE level WHEN 'L2' THEN rate END) AS quadratic FROM lr GROUP BY 1"))
def rates_trends(spark, sf):
    return level_rates(spark, sf).groupBy("condition").agg((at("L2") - at("L0")).alias("linear"), (at("L0") - 2 * at("L1") + at("L2")).alias("quadratic"))


@query("B13_cross_system", with_sql(", d AS (SELECT seed, avg((gold = pred)::INT) FILTER (WHERE condition = 'full') - avg((gold = pred)::INT) FILTER (WHERE condition = 'none') AS benefit FROM preds GROUP BY 1) SELECT max(CASE seed WHEN 1 THEN benefit END) - max(CASE seed WHEN 0 THEN benefit END) AS difference FROM d"))
def cross_system(spark, sf):
    hit = correct().cast("int")
    d = p3(spark, sf).groupBy("seed").agg((F.avg(F.when(F.col("condition") == "full", hit)) - F.avg(F.when(F.col("condition") == "none", hit))).alias("benefit"))
    return d.agg((F.max(F.when(F.col("seed") == 1, F.col("benefit"))) - F.max(F.when(F.col("seed") == 0, F.col("benefit")))).alias("difference"))


@query("B14_identical_examples", with_sql("SELECT x.condition, avg((x.pred <> 0)::INT) AS detection, avg((x.gold = x.pred)::INT) AS oracle, avg((x.gold = x.pred AND y.pred <> 0)::INT) AS routed FROM p0 x JOIN preds y ON x.item_id = y.item_id AND x.condition = y.condition AND y.seed = 2 WHERE x.gold = 1 GROUP BY 1"))
def identical(spark, sf):
    p = p3(spark, sf)
    y = p.where("seed = 2").select("item_id", "condition", F.col("pred").alias("other"))
    j = p.where("seed = 0 AND gold = 1").join(y, ["item_id", "condition"])
    return j.groupBy("condition").agg(F.avg((F.col("pred") != 0).cast("int")).alias("detection"), F.avg(correct().cast("int")).alias("oracle"), F.avg((correct() & (F.col("other") != 0)).cast("int")).alias("routed"))


@query("B19_sensitivity", with_sql("SELECT 'all' AS line, avg((gold = pred)::INT) AS rate, count(*)::BIGINT AS n FROM p0 WHERE condition = 'full' UNION ALL SELECT 'minus_dup', avg((gold = pred)::INT), count(*) FROM p0 WHERE condition = 'full' AND conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def sensitivity(spark, sf):
    p = p0(spark, sf).where("condition = 'full'")
    bad = catalog.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("conv_id"))
    line = lambda df, name: df.agg(F.avg(correct().cast("int")).alias("rate"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("line"), "rate", "n")
    return line(p, "all").unionByName(line(p.join(bad, "conv_id", "left_anti"), "minus_dup"))


@query("B20_seed_trends", with_sql(", r AS (SELECT seed, condition, avg((gold = pred)::INT) AS rate FROM preds WHERE k < 3 GROUP BY 1, 2) SELECT seed, max(CASE condition WHEN 'full' THEN rate END) - max(CASE condition WHEN 'none' THEN rate END) AS linear FROM r GROUP BY 1"))
def seed_trends(spark, sf):
    r = p3(spark, sf).where("k < 3").groupBy("seed").pivot("condition", ["none", "full"]).agg(F.avg(correct().cast("int")))
    return r.select("seed", (F.col("full") - F.col("none")).alias("linear"))


@query("B23_main_effect", with_sql(BOOT + DERIVED + ", s AS (SELECT derived, (list(round(value, 9) ORDER BY value))[(floor((count(value) - 1) * 0.025) + 1)::BIGINT] AS low, (list(round(value, 9) ORDER BY value))[(floor((count(value) - 1) * 0.975) + 1)::BIGINT] AS high FROM dv GROUP BY 1) SELECT (SELECT low > 0 OR high < 0 FROM s WHERE derived = 'full-none') AS main_effect, (SELECT low > 0 OR high < 0 FROM s WHERE derived = 'quadratic') AS interaction"))
def main_effect(spark, sf):
    s = bootstrap.summary(derived_values(spark, sf).withColumn("value", F.round("value", 9)), ["derived"])
    clear = (F.col("low") > 0) | (F.col("high") < 0)
    return s.agg(F.bool_or(F.when(F.col("derived") == "full-none", clear)).alias("main_effect"), F.bool_or(F.when(F.col("derived") == "quadratic", clear)).alias("interaction"))


@query("B27_saved_metrics", with_sql("SELECT condition, count_if(gold = pred)::BIGINT AS correct, count(*)::BIGINT AS n FROM p0 GROUP BY 1"))
def saved_metrics(spark, sf):
    v = bootstrap.vectors(p0(spark, sf), ["condition"], "conv_id", correct().cast("int"), F.lit(1))
    return v.groupBy("condition").agg(F.sum("num").cast("long").alias("correct"), F.sum("den").cast("long").alias("n"))


@query("B29_outcome_records", with_sql("SELECT item_id, condition, gold = pred AS category, gold = pred AND turn % 2 = 0 AS exact FROM p0 WHERE gold <> 0"))
def outcome_records(spark, sf):
    return p0(spark, sf).where("gold <> 0").select("item_id", "condition", correct().alias("category"), (correct() & (F.col("turn") % 2 == 0)).alias("exact"))


@query("F15_row_hash", "SELECT n_nationkey, sha256(concat_ws(chr(31), 'n_name=' || n_name, 'n_nationkey=' || n_nationkey, 'n_regionkey=' || n_regionkey)) AS h FROM nation")
def row_hash(spark, sf):
    n = catalog.table(spark, sf, "nation")
    return n.select("n_nationkey", passes.row_hash(n.columns).alias("h"))


@query("J20_hash_chain", "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'prior_differs' END AS problem FROM customer WHERE c_custkey % 11 = 0")
def hash_chain(spark, sf):
    c = catalog.table(spark, sf, "customer")
    h = passes.row_hash(["c_custkey", "c_name"])
    return passes.broken_chain(c.select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, "x").otherwise(h).alias("prior_sha256")), c.select("c_custkey", "c_name"), ["c_custkey"], ["c_custkey", "c_name"])


@query("F45_primary_endpoint", with_sql("SELECT condition, count_if(pred <> 0 AND gold = pred)::BIGINT AS hits FROM p0 GROUP BY 1"))
def primary_endpoint(spark, sf):
    return p0(spark, sf).groupBy("condition").agg(F.count_if((F.col("pred") != 0) & correct()).alias("hits"))


@query("F46_type_exact", with_sql("SELECT item_id, condition, gold = pred AND (pred <> 0) = (gold <> 0) AS type_exact FROM p0"))
def type_exact(spark, sf):
    return p0(spark, sf).select("item_id", "condition", (correct() & ((F.col("pred") != 0) == (F.col("gold") != 0))).alias("type_exact"))


@query("F47_request_status", "SELECT event_id, CASE event_type WHEN 'click' THEN 'present' WHEN 'error' THEN 'uncertain' ELSE 'absent' END AS status FROM events")
def status(spark, sf):
    f = F.when(F.col("event_type") == "click", "request").when(F.col("event_type") == "error", "uncertain").otherwise("other")
    return catalog.table(spark, sf, "events").select("event_id", passes.request_status(f).alias("status"))


@query("F49_confirmatory", "SELECT event_id, event_id % 4 <> 2 AS eligible, event_id % 4 = 3 AS adjudicate FROM events")
def confirmatory(spark, sf):
    f = F.element_at(F.array(*map(F.lit, ("none", "helpful", "required", "conflicts"))), (F.col("event_id") % 4 + 1).cast("int"))
    return catalog.table(spark, sf, "events").select("event_id", (f != "required").alias("eligible"), (f == "conflicts").alias("adjudicate"))


@query("F64_stream_rows", with_sql("SELECT 'routed' AS stream, item_id, pred FROM p0 WHERE condition = 'full' UNION ALL SELECT 'oracle', item_id, pred FROM p0 WHERE condition = 'full' AND gold = 1"))
def stream_rows(spark, sf):
    p = p0(spark, sf).where("condition = 'full'")
    one = lambda df, name: df.select(F.lit(name).alias("stream"), "item_id", "pred")
    return one(p, "routed").unionByName(one(p.where("gold = 1"), "oracle"))


@query("G11_grid_plan", with_sql("SELECT c.condition, s.seed FROM conditions c, (SELECT unnest([0, 1, 2]) AS seed) s WHERE c.k < 3 AND NOT (c.k = 1 AND s.seed = 2)"))
def grid_plan(spark, sf):
    grid = catalog.conditions(spark).where("k < 3").select("condition", F.explode(F.array(*map(F.lit, range(3)))).alias("seed"))
    done = spark.createDataFrame([("one", 2)], "condition string, seed int")
    return grid.join(F.broadcast(done), ["condition", "seed"], "left_anti")  # a plan's runs


@query("J17_model_inputs", budget_sql(350, "SELECT i.item_id, i.text AS target, w.kept FROM items i JOIN w USING (conv_id, turn) WHERE i.split = 'dev'"))
def model_inputs(spark, sf):
    return catalog.items(spark, sf).where("split = 'dev'").join(contexts.budgeted(catalog.turns(spark, sf)), ["conv_id", "turn"]).select("item_id", F.col("text").alias("target"), "kept")


@query("J29_slices", with_sql(RATES + " SELECT * FROM lr"))
def slices(spark, sf):
    return level_rates(spark, sf)


@query("J30_mismatch_members", with_sql(DONORS + " SELECT i.item_id, contains(t.text, split_part(i.text, ' ', 1)) AS cue_donor FROM items i JOIN d USING (conv_id, turn) JOIN turns t ON t.conv_id = d.donor AND t.turn = d.turn - 1"))
def mismatch_members(spark, sf):
    t = catalog.turns(spark, sf)
    d = contexts.donors(t).where("donor IS NOT NULL").select("conv_id", "turn", "donor")
    last = t.select(F.col("conv_id").alias("donor"), (F.col("turn") + 1).alias("turn"), F.col("text").alias("shown"))
    return catalog.items(spark, sf).join(d, ["conv_id", "turn"]).join(last, ["donor", "turn"]).select("item_id", F.contains("shown", F.split_part("text", F.lit(" "), F.lit(1))).alias("cue_donor"))


@query("J27_run_grid", with_sql("SELECT DISTINCT condition, seed FROM preds WHERE condition IN ('none', 'full') AND seed < 2"))
def run_grid(spark, sf):
    plan = spark.createDataFrame([(c, s) for c in ("none", "full") for s in range(2)], "condition string, seed int")
    return p3(spark, sf).select("condition", "seed").distinct().join(F.broadcast(plan), ["condition", "seed"], "left_semi")  # a plan's runs


@query("M02_prepared_inputs", budget_sql(350, "SELECT split, count(*)::BIGINT AS inputs, sum(kept)::BIGINT AS turns FROM items JOIN w USING (conv_id, turn) GROUP BY 1"))
def prepared(spark, sf):
    return catalog.items(spark, sf).join(contexts.budgeted(catalog.turns(spark, sf)), ["conv_id", "turn"]).groupBy("split").agg(F.count(F.lit(1)).alias("inputs"), F.sum("kept").alias("turns"))


@query("M10_digest_backend", with_sql("SELECT item_id, sha256(text) AS raw FROM items"))
def digest_backend(spark, sf):
    return catalog.items(spark, sf).select("item_id", F.sha2("text", 256).alias("raw"))


@query("M14_prompt_report", with_sql(", r AS (SELECT condition AS prompt, seed, avg((gold = pred)::INT) AS rate FROM preds WHERE condition IN ('none', 'full') GROUP BY 1, 2) SELECT prompt, avg(rate) AS mean, min(rate) AS low, max(rate) AS high FROM r GROUP BY 1"))
def prompt_report(spark, sf):
    r = p3(spark, sf).where("condition IN ('none', 'full')").groupBy(F.col("condition").alias("prompt"), "seed").agg(F.avg(correct().cast("int")).alias("rate"))
    return r.groupBy("prompt").agg(F.avg("rate").alias("mean"), F.min("rate").alias("low"), F.max("rate").alias("high"))


@query("J23_split_groups", "SELECT o_custkey AS group_id, list_sort(list_distinct(list(o_orderstatus))) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def split_groups(spark, sf):
    return passes.split_groups(catalog.table(spark, sf, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderstatus").alias("split")))


@query("W16_superseded_lineage", "SELECT o_orderkey, EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey % 9 = 0 AND p.o_orderkey = o.o_orderkey + 5) AS superseded FROM orders o")
def superseded(spark, sf):
    o = catalog.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderkey") - 5).alias("prior"))
    return passes.lineage(o, "o_orderkey", "prior").select("o_orderkey", "superseded")


@query("K13_row_order", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS place FROM customer")
def row_order(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy("c_mktsegment", "c_custkey")
    return catalog.table(spark, sf, "customer").select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("M01_tfidf_logreg")
def tfidf(spark, sf):
    """Language of held-out texts by the linear baseline; a model, so no SQL."""
    d = catalog.table(spark, sf, "documents").select("doc_id", F.col("text").alias("utterance"), F.col("source").alias("context"), F.when(F.col("lang") == "en", 1).otherwise(0).alias("label"))
    return models.tfidf_logreg(d.where("doc_id % 4 <> 2"), d.where("doc_id % 4 = 2")).select("doc_id", "label", "prediction")
