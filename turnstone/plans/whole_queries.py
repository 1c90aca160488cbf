"""Queries over stand-in acts, dates, sheets and members; variety comes from the ids, no row is left out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone import catalog
from turnstone.functions import rules
from turnstone.operators import bootstrap, passes, sampling
from turnstone.registry import query

#: Acts made from all events: two events make a dialogue, the user decides domain and kind.
ACTS = """acts AS (SELECT dialogue, act, list_sort(list_distinct(list(slot))) AS slots FROM (SELECT event_id // 2 AS dialogue, (['Hotel', 'Train', 'Police', 'Restaurant', 'general'])[user_id % 5 + 1] || '-' || CASE WHEN user_id % 5 = 4 THEN 'thank' ELSE (['Inform', 'Request'])[user_id // 5 % 2 + 1] END AS act,
 (['People', 'Day', 'Area', 'Stay', 'none'])[(json_extract(props, '$.k')::BIGINT) % 5 + 1] AS slot FROM events) GROUP BY 1, 2)"""
BOOKS = "(list_contains(slots, 'People') OR list_contains(slots, 'Stay'))"


def pick(names, i):
    return F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))


def events(spark, sf):
    return catalog.table(spark, sf, "events")


def acts(spark, sf):
    u = F.col("user_id")
    act = F.concat(pick(("Hotel", "Train", "Police", "Restaurant", "general"), u % 5), F.lit("-"), F.when(u % 5 == 4, "thank").otherwise(pick(("Inform", "Request"), F.floor(u / 5) % 2)))
    slot = pick(("People", "Day", "Area", "Stay", "none"), F.get_json_object("props", "$.k").cast("long") % 5)
    one = events(spark, sf).select(F.floor(F.col("event_id") / 2).alias("dialogue"), act.alias("act"), slot.alias("slot")).groupBy("dialogue", "act").agg(F.array_sort(F.collect_set("slot")).alias("slots"))
    return one.groupBy("dialogue").agg(F.map_from_entries(F.collect_list(F.struct("act", "slots"))).alias("acts"))


@query("F38_act_categories", f"WITH {ACTS}, c AS (SELECT dialogue, unnest(list_filter([CASE WHEN act LIKE '%-Request' OR act LIKE 'Police-%' THEN 'info_seeking' END, CASE WHEN act LIKE '%-Inform' AND {BOOKS} THEN 'booking' END, CASE WHEN act = 'Train-Inform' THEN 'travel' END, CASE WHEN act IN ('Hotel-Inform', 'Restaurant-Inform') AND (NOT {BOOKS} OR list_contains(slots, 'Area')) THEN 'recommendation' END], lambda x: x IS NOT NULL)) AS category FROM acts) SELECT dialogue, category FROM c UNION SELECT dialogue, 'no_request' FROM acts GROUP BY 1 HAVING bool_and(act = 'general-thank')")
def act_categories(spark, sf):
    return acts(spark, sf).select("dialogue", F.explode(rules.categories(F.col("acts"))).alias("category"))


@query("F39_primary_category", f"WITH {ACTS}, x AS (SELECT dialogue, bool_and(act = 'general-thank') AS social, bool_or(act LIKE '%-Request' OR act LIKE 'Police-%') AS i, bool_or(act LIKE '%-Inform' AND {BOOKS}) AS b, bool_or(act = 'Train-Inform') AS t, bool_or(act IN ('Hotel-Inform', 'Restaurant-Inform') AND (NOT {BOOKS} OR list_contains(slots, 'Area'))) AS r FROM acts GROUP BY 1) SELECT dialogue, CASE WHEN social THEN 'no_request' WHEN i THEN 'info_seeking' WHEN b THEN 'booking' WHEN t THEN 'travel' WHEN r THEN 'recommendation' END AS category FROM x")
def primary_category(spark, sf):
    return acts(spark, sf).select("dialogue", rules.primary(rules.categories(F.col("acts"))).alias("category"))


@query("A07_category_counts", f"WITH {ACTS} SELECT act, count(*)::BIGINT AS dialogues, sum(len(slots))::BIGINT AS slots FROM acts GROUP BY 1")
def category_counts(spark, sf):
    return acts(spark, sf).select(F.explode("acts").alias("act", "s")).groupBy("act").agg(F.count(F.lit(1)).alias("dialogues"), F.sum(F.size("s")).alias("slots"))


@query("P02_social_only", f"WITH {ACTS} SELECT dialogue, bool_and(act = 'general-thank') AS social FROM acts GROUP BY 1")
def social(spark, sf):
    return acts(spark, sf).select("dialogue", rules.social_only(F.col("acts")).alias("social"))


@query("F71_act_domains", f"WITH {ACTS} SELECT dialogue, coalesce(list_sort(list(DISTINCT lower(split_part(act, '-', 1))) FILTER (WHERE act NOT LIKE 'general%')), []) AS domains FROM acts GROUP BY 1")
def act_domains(spark, sf):
    return acts(spark, sf).select("dialogue", rules.act_domains(F.col("acts")).alias("domains"))


@query("F40_gold_reference", "WITH v AS (SELECT event_id // 4 AS dialogue, event_type AS key, list(DISTINCT json_extract(props, '$.k')::BIGINT % 4) AS vals FROM events GROUP BY 1, 2) SELECT dialogue, bool_or(len(vals) > 1) AS conflicting, CASE WHEN NOT bool_or(len(vals) > 1) THEN array_to_string(list_sort(list(key || '=' || vals[1])), ';') END AS slots FROM v GROUP BY 1")
def gold(spark, sf):
    """A key with two different values voids the whole reference."""
    v = events(spark, sf).groupBy(F.floor(F.col("event_id") / 4).alias("dialogue"), F.col("event_type").alias("key")).agg(F.collect_set(F.get_json_object("props", "$.k").cast("long") % 4).alias("vals"))
    g = v.groupBy("dialogue").agg(F.bool_or(F.size("vals") > 1).alias("conflicting"), F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit("="), F.element_at("vals", 1).cast("string")))), ";").alias("slots"))
    return g.withColumn("slots", F.when(~F.col("conflicting"), F.col("slots")))


@query("F59_iso_date", "SELECT event_id, event_id % 13 > 0 AND event_id % 33 BETWEEN 1 AND (['31', '31', '29', '31', '30', '31', '30', '31', '31', '30', '31', '30', '31'])[event_id % 13 + 1]::INT AS valid FROM events")
def iso_date(spark, sf):
    d = F.format_string("2024-%02d-%02d", F.col("event_id") % 13, F.col("event_id") % 33)
    return events(spark, sf).select("event_id", (d.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(d, "yyyy-MM-dd").isNotNull()).alias("valid"))


@query("B18_holm_status", "WITH m AS (SELECT o_orderpriority || '/' || least(o_custkey % 32, 5) AS member, count(DISTINCT o_custkey) AS d, (count(*) % 89) / 890.0::DOUBLE AS p FROM orders GROUP BY 1), q AS (SELECT member, CASE WHEN d < 75 THEN NULL ELSE p END AS p, CASE WHEN d < 75 THEN 'untestable' ELSE 'tested' END AS status FROM m), r AS (SELECT *, coalesce(p, 1.0) AS q, row_number() OVER (ORDER BY coalesce(p, 1.0), member) AS r, count(*) OVER () AS m FROM q) SELECT member, p, status, max(least(1.0::DOUBLE, (m - r + 1) * q)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS adjusted FROM r")
def holm_status(spark, sf):
    member = F.concat_ws("/", "o_orderpriority", F.least(F.col("o_custkey") % 32, F.lit(5)).cast("string"))
    m = catalog.table(spark, sf, "orders").groupBy(member.alias("member")).agg(F.countDistinct("o_custkey").alias("d"), ((F.count(F.lit(1)) % 89) / 890.0).alias("p"))
    thin = F.col("d") < 75
    return bootstrap.holm(m.select("member", F.when(~thin, F.col("p")).alias("p"), F.when(thin, "untestable").otherwise("tested").alias("status")))


@query("U19_eligible_keys", "WITH e AS (SELECT event_id // 4 AS k, (['form', 'context', 'reveal'])[user_id % 3 + 1] AS p FROM events) SELECT k FROM e GROUP BY 1 HAVING bool_or(p = 'form') AND NOT bool_or(p = 'context')")
def eligible_keys(spark, sf):
    return passes.eligible(events(spark, sf).select(F.floor(F.col("event_id") / 4).alias("k"), pick(passes.PASSES, F.col("user_id") % 3).alias("pass")), "context", ["k"])


@query("K12_shuffled_sheet", "SELECT c_custkey, row_number() OVER (ORDER BY md5('9:' || c_custkey), c_custkey) AS place FROM customer")
def shuffled(spark, sf):
    """Places within the 4,096 values of three digits of the key, after the counts of the values before: no task orders the whole sheet."""
    c = catalog.table(spark, sf, "customer").select("c_custkey", sampling.draw_key(9, "c_custkey").alias("key")).withColumn("part", F.substring("key", 1, 3))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = c.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # 4,096 rows at most
    place = F.row_number().over(Window.partitionBy("part").orderBy("key", "c_custkey"))
    return c.withColumn("within", place).join(F.broadcast(sizes), "part").select("c_custkey", (F.col("first") + F.col("within")).cast("long").alias("place"))
