"""The plan's analysis and its precision report, with 10,000 replicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone import catalog
from turnstone.catalog import with_sql
from turnstone.operators import bootstrap
from turnstone.plans.scoring_queries import LEVEL, SAMPLES, SEED, SUMMARY, correct, level, p0
from turnstone.registry import query

LEAST_DIALOGUES, TOLERANCE = 30, 0.002  #: fewer dialogues in the smallest cell aren't tested; ends of two seeds' intervals agree to this

#: A plan: rates by condition, over all and by level; benefits of two conditions against none; their trends over L0 to L2.
LEVELS = ("ALL", "L0", "L1", "L2", "L3")
PLAN = [(f"benefit:{c}|{x}", f"{s}|{x}", w) for c in ("full", "one") for x in LEVELS for s, w in ((c, 1.0), ("none", -1.0))]
PLAN += [(f"{t}:{c}", f"{s}|{x}", w * k) for c in ("full", "one") for t, ws in (("linear", (-1.0, 1.0)), ("quadratic", (1.0, -2.0, 1.0))) for x, w in zip(("L0", "L2") if t == "linear" else ("L0", "L1", "L2"), ws, strict=True) for s, k in ((c, 1.0), ("none", -1.0))]
PRIMARY = "linear:full"
FAMILY = ("linear:full", "linear:one", "benefit:full|ALL", "benefit:one|ALL", "linear:absent")  # a member that didn't run keeps 1

CELLS = f""", cells AS (SELECT p.conv_id, p.condition || '|' || x.lv AS stat, (gold = pred)::INT AS hit FROM p0 p JOIN (SELECT item_id, {LEVEL} AS lv FROM items) i ON i.item_id = p.item_id, (SELECT unnest({list(LEVELS)}) AS lv) x WHERE x.lv IN ('ALL', i.lv)),
terms AS (SELECT * FROM (VALUES {", ".join(f"('{d}', '{s}', {c}::DOUBLE)" for d, s, c in PLAN)}) t(derived, stat, coef)), want AS (SELECT derived, count(*) AS want FROM terms GROUP BY 1),
v AS (SELECT stat, conv_id, sum(hit)::DOUBLE AS num, count(*)::DOUBLE AS den FROM cells GROUP BY 1, 2),
c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM p0)),
draws AS (SELECT s.s AS seed, r.r AS replicate, (('0x' || substr(md5(s.s || ':' || r.r || ':' || j.j), 1, 8))::BIGINT) % (SELECT max(n) FROM c) AS i FROM (SELECT unnest([{SEED}, {SEED + 1}]) AS s) s, (SELECT unnest(range({SAMPLES})) AS r) r, (SELECT unnest(range((SELECT max(n) FROM c))) AS j) j),
w AS (SELECT seed, replicate, conv_id, count(*) AS w FROM draws JOIN c USING (i) GROUP BY ALL),
made AS (SELECT s.stat, d.seed, d.replicate FROM (SELECT DISTINCT stat FROM v) s, (SELECT DISTINCT seed, replicate FROM draws) d),
drawn AS (SELECT seed, stat, replicate, CASE WHEN sum(w * den) <> 0 THEN sum(w * num) / sum(w * den) END AS value FROM v JOIN w USING (conv_id) GROUP BY ALL),
rep AS (SELECT seed, stat, replicate, value FROM made LEFT JOIN drawn USING (seed, stat, replicate)),
vals AS (SELECT seed, stat, round(value, 9) AS value FROM rep UNION ALL SELECT seed, derived, CASE WHEN count(value) = any_value(want) THEN round(sum(coef * value), 9) END FROM rep JOIN terms USING (stat) JOIN want USING (derived) GROUP BY seed, derived, replicate),
one AS ({SUMMARY.format(k="stat", t=f"(SELECT * FROM vals WHERE seed = {SEED})")}), two AS ({SUMMARY.format(k="stat", t=f"(SELECT * FROM vals WHERE seed = {SEED + 1})")})"""


def vectors(spark, sf):
    """Sums per statistic and dialogue of the plan's cells."""
    p = p0(spark, sf).join(catalog.items(spark, sf).select("item_id", level().alias("level")), "item_id")
    rows = p.select("conv_id", correct().cast("int").alias("hit"), F.explode(F.array(F.lit("ALL"), "level")).alias("x"), "condition")
    return bootstrap.vectors(rows.withColumn("stat", F.concat_ws("|", "condition", "x")), ["stat"], "conv_id", F.col("hit"), F.lit(1))


def terms(spark):
    return spark.createDataFrame(PLAN, "derived string, stat string, coef double")


def summary(spark, v, seed):
    r = bootstrap.replicates_blocked(v, "stat", "conv_id", SAMPLES, seed)
    d = bootstrap.derived(r, terms(spark)).withColumnRenamed("derived", "stat")
    return bootstrap.summary(r.unionByName(d).withColumn("value", F.round("value", 9)), ["stat"])


@query("B24_precision_report", with_sql(CELLS + f" SELECT stat, one.low, one.high, (one.high - one.low) / 2 AS half_width, two.low AS second_low, two.high AS second_high, greatest(abs(one.low - two.low), abs(one.high - two.high)) AS difference, round(greatest(abs(one.low - two.low), abs(one.high - two.high)), 9) <= {TOLERANCE} AS agrees FROM one JOIN two USING (stat) WHERE stat LIKE 'linear:%' OR stat LIKE 'benefit:%|ALL'"))
def precision(spark, sf):
    """Intervals of the trends and the overall benefits, and how far the ends move with a second seed."""
    v = vectors(spark, sf)
    one, two = (summary(spark, v, s).where("stat LIKE 'linear:%' OR stat LIKE 'benefit:%|ALL'") for s in (SEED, SEED + 1))
    j = one.select("stat", "low", "high").join(two.select("stat", F.col("low").alias("second_low"), F.col("high").alias("second_high")), "stat")
    gap = F.greatest(F.abs(F.col("low") - F.col("second_low")), F.abs(F.col("high") - F.col("second_high")))
    return j.select("stat", "low", "high", ((F.col("high") - F.col("low")) / 2).alias("half_width"), "second_low", "second_high", gap.alias("difference"), (F.round(gap, 9) <= TOLERANCE).alias("agrees"))


@query("B25_whole_analysis", with_sql(CELLS + f""", pt AS (SELECT stat, sum(num) / sum(den) AS point, count(*)::BIGINT AS dialogues FROM v GROUP BY 1), pts AS (SELECT * FROM pt UNION ALL SELECT derived, CASE WHEN count(*) = any_value(want) THEN sum(coef * point) END, CASE WHEN count(*) = any_value(want) THEN min(dialogues) ELSE 0 END FROM terms JOIN want USING (derived) JOIN pt USING (stat) GROUP BY 1),
st AS (SELECT stat, round(point, 9) AS point, low, high, p, excluded, dialogues, CASE WHEN dialogues < {LEAST_DIALOGUES} THEN 'sparse' WHEN excluded > 0.01 * (replicates + excluded) THEN 'unstable' ELSE 'ok' END AS status FROM one JOIN pts USING (stat)),
f AS (SELECT unnest({list(FAMILY)}) AS stat), q AS (SELECT stat, CASE WHEN status = 'ok' THEN p END AS p FROM f LEFT JOIN st USING (stat)), r AS (SELECT *, coalesce(p, 1.0) AS q, row_number() OVER (ORDER BY coalesce(p, 1.0), stat) AS r, count(*) OVER () AS m FROM q), h AS (SELECT stat, p, max(least(1.0::DOUBLE, (m - r + 1) * q)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS adjusted FROM r)
SELECT stat, point, low, high, excluded, coalesce(dialogues, 0)::BIGINT AS dialogues, coalesce(status, 'not_run') AS status, h.p, adjusted, coalesce(stat = '{PRIMARY}' AND status = 'ok' AND (low > 0 OR high < 0), false) AS decided FROM st FULL JOIN h USING (stat)"""))
def analysis(spark, sf):
    """All statistics of a plan on one sequence of draws: points, intervals and cells; p and Holm's step-down for the family that is tested."""
    v = vectors(spark, sf)
    pt = v.groupBy("stat").agg((F.sum("num") / F.sum("den")).alias("point"), F.count(F.lit(1)).alias("dialogues"))
    want = terms(spark).groupBy("derived").agg(F.count(F.lit(1)).alias("want"))
    d = terms(spark).join(pt, "stat").groupBy("derived").agg(F.sum(F.col("coef") * F.col("point")).alias("point"), F.min("dialogues").alias("dialogues"), F.count(F.lit(1)).alias("k")).join(want, "derived")
    whole = F.col("k") == F.col("want")
    pts = pt.unionByName(d.select(F.col("derived").alias("stat"), F.when(whole, F.col("point")).alias("point"), F.when(whole, F.col("dialogues")).otherwise(0).alias("dialogues")))
    status = F.when(F.col("dialogues") < LEAST_DIALOGUES, "sparse").when(F.col("unstable"), "unstable").otherwise("ok")
    s = summary(spark, v, SEED).join(pts, "stat").select("stat", F.round("point", 9).alias("point"), "low", "high", "excluded", "dialogues", status.alias("status"), "p")
    members = spark.createDataFrame([(m,) for m in FAMILY], "stat string").join(s.select("stat", F.when(F.col("status") == "ok", F.col("p")).alias("p")), "stat", "left")
    j = s.drop("p").join(bootstrap.holm(members, order="stat"), "stat", "full")
    decided = (F.col("stat") == PRIMARY) & (F.col("status") == "ok") & ((F.col("low") > 0) | (F.col("high") < 0))
    return j.select("stat", "point", "low", "high", "excluded", F.coalesce("dialogues", F.lit(0)).alias("dialogues"), F.coalesce("status", F.lit("not_run")).alias("status"), "p", "adjusted", F.coalesce(decided, F.lit(False)).alias("decided"))
