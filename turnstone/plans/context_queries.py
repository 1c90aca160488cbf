"""Windows, donors, renderings and item predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone import catalog
from turnstone.catalog import with_sql
from turnstone.functions import text as tx
from turnstone.operators import contexts
from turnstone.registry import query

LINE = "CASE WHEN role = 'user' THEN 'User: ' ELSE 'System: ' END || text"


@query("W01_cumulative_mask", with_sql("SELECT conv_id, turn, bit_or(bit) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS mask FROM turns"))
def cumulative_mask(spark, sf):
    return contexts.cumulative_mask(catalog.turns(spark, sf)).select("conv_id", "turn", "mask")


@query("P01_active_domains", with_sql("SELECT conv_id, turn, active FROM (SELECT *, bit_or(bit) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS active FROM turns) WHERE role = 'user'"))
def active(spark, sf):
    return contexts.active_masks(catalog.turns(spark, sf)).where("role = 'user'").select("conv_id", "turn", "active")


FULL = f"SELECT a.conv_id, a.turn, a.text AS target, a.words, list(CASE WHEN b.role = 'user' THEN 'User: ' ELSE 'System: ' END || b.text ORDER BY b.turn) FILTER (WHERE b.turn IS NOT NULL) AS lines FROM items a LEFT JOIN turns b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY 1, 2, 3, 4"


@query("W02_context_slices", with_sql(f", f AS ({FULL}) SELECT conv_id, turn, coalesce(array_to_string(lines, chr(10)), '') AS full_text, coalesce(lines[-1], '') AS one_text, coalesce(len(lines), 0)::BIGINT AS n_full FROM f"))
def slices(spark, sf):
    s = contexts.slices(catalog.turns(spark, sf))
    return s.select("conv_id", "turn", F.array_join("full", "\n").alias("full_text"), F.array_join("one", "\n").alias("one_text"), F.size("full").cast("long").alias("n_full"))


def budget_sql(budget: int, tail: str) -> str:
    return with_sql(f""", later AS (SELECT a.conv_id, a.turn, a.words AS target_words, b.turn AS t, b.words + 1 AS size, sum(b.words + 1) OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS from_here
  FROM items a LEFT JOIN turns b ON a.conv_id = b.conv_id AND b.turn < a.turn),
w AS (SELECT conv_id, turn, count(t) FILTER (WHERE from_here <= {budget} - target_words)::BIGINT AS kept, count(t) FILTER (WHERE from_here > {budget} - target_words)::BIGINT AS dropped,
  coalesce(sum(size) FILTER (WHERE from_here <= {budget} - target_words), 0)::BIGINT AS context_words FROM later GROUP BY 1, 2) {tail}""")


@query("w_context_windows", budget_sql(120, "SELECT * FROM w"))
def windows(spark, sf):
    """The flagship: budgeted context windows, with a budget at which many windows are cut."""
    return contexts.budgeted(catalog.turns(spark, sf), 120)


@query("W03_budgeted_context", budget_sql(350, "SELECT * FROM w"))
def budgeted(spark, sf):
    return contexts.budgeted(catalog.turns(spark, sf))


@query("W04_render_conditions", budget_sql(120, f", f AS ({FULL}) SELECT conv_id, turn, 'none' AS condition, '' AS context FROM items UNION ALL SELECT conv_id, turn, 'one', coalesce(lines[-1], '') FROM f UNION ALL SELECT f.conv_id, f.turn, 'full', coalesce(array_to_string(lines[dropped + 1:], chr(10)), '') FROM f JOIN w USING (conv_id, turn)"))
def render(spark, sf):
    t = catalog.turns(spark, sf)
    s, full = contexts.slices(t), contexts.rendered(t, 120).select("conv_id", "turn", "context")
    pick = F.explode(F.array(F.struct(F.lit("none").alias("condition"), F.lit("").alias("context")), F.struct(F.lit("one").alias("condition"), F.array_join("one", "\n").alias("context")), F.struct(F.lit("full").alias("condition"), F.col("context").alias("context")))).alias("r")
    return s.join(full, ["conv_id", "turn"]).select("conv_id", "turn", pick).select("conv_id", "turn", "r.*")


@query("W05_window_check", budget_sql(120, "SELECT count(*)::BIGINT AS windows, count_if(dropped > 0)::BIGINT AS cut, count_if(context_words > 120)::BIGINT AS over FROM w"))
def window_check(spark, sf):
    b = contexts.budgeted(catalog.turns(spark, sf), 120)
    return b.agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("dropped") > 0).alias("cut"), F.count_if(F.col("context_words") > 120).alias("over"))


@query("W12_prior_turn", with_sql("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM turns"))
def prior(spark, sf):
    return contexts.neighbours(catalog.turns(spark, sf)).select("conv_id", "turn", "previous")


@query("W13_continuation", with_sql("SELECT conv_id, turn, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM turns"))
def following(spark, sf):
    return contexts.neighbours(catalog.turns(spark, sf)).select("conv_id", "turn", "following")


DONORS = """, c AS (SELECT *, bit_or(bit) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS mask,
  bit_or(bit) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS active FROM turns),
cand AS (SELECT a.conv_id, a.turn, b.conv_id AS donor FROM c a JOIN c b ON a.split = b.split AND b.turn + 1 = a.turn AND b.mask & a.active = 0 AND a.conv_id <> b.conv_id WHERE a.role = 'user' AND a.turn > 0),
ordered AS (SELECT cand.*, row_number() OVER (PARTITION BY cand.conv_id, cand.turn ORDER BY c.mask, substr(md5(donor::VARCHAR), 1, 3), donor) - 1 AS k, count(*) OVER (PARTITION BY cand.conv_id, cand.turn) AS n FROM cand JOIN c ON c.conv_id = cand.donor AND c.turn + 1 = cand.turn),
d AS (SELECT i.conv_id, i.turn, any_value(o.donor) FILTER (WHERE o.k = ('0x' || substr(md5('7:' || i.conv_id || ':' || i.turn), 1, 8))::BIGINT % o.n) AS donor, count(o.donor)::BIGINT AS n_candidates
  FROM items i LEFT JOIN ordered o ON o.conv_id = i.conv_id AND o.turn = i.turn WHERE i.turn > 0 GROUP BY 1, 2)"""


@query("J03_donor_candidates", with_sql(DONORS + " SELECT *, CASE WHEN donor IS NULL THEN 'unavailable' ELSE 'ok' END AS status FROM d"))
def donors(spark, sf):
    return contexts.donors(catalog.turns(spark, sf))


@query("K01_donor_choice", with_sql(DONORS + " SELECT conv_id, turn, donor FROM d WHERE donor IS NOT NULL"))
def donor_choice(spark, sf):
    return contexts.donors(catalog.turns(spark, sf)).where("donor IS NOT NULL").select("conv_id", "turn", "donor")


@query("W02_mismatched_windows", with_sql(DONORS + f", l AS (SELECT d.conv_id, d.turn, d.donor, list({LINE.replace('role', 't.role').replace('text', 't.text')} ORDER BY t.turn) AS lines FROM d JOIN turns t ON t.conv_id = d.donor AND t.turn < d.turn GROUP BY 1, 2, 3) SELECT d.conv_id, d.turn, d.donor, array_to_string(lines, chr(10)) AS mismatched, lines[-1] AS mismatched_one FROM d LEFT JOIN l USING (conv_id, turn)"))
def mismatched(spark, sf):
    m = contexts.mismatched(catalog.turns(spark, sf))
    return m.select("conv_id", "turn", "donor", F.when(F.col("mismatched").isNotNull(), F.array_join("mismatched", "\n")).alias("mismatched"), "mismatched_one")


@query("J15_donor_same_split", with_sql(DONORS + " SELECT count(*)::BIGINT AS n, count_if(a.split <> b.split)::BIGINT AS other_split, count_if(d.donor = d.conv_id)::BIGINT AS own FROM d JOIN (SELECT DISTINCT conv_id, split FROM turns) a USING (conv_id) JOIN (SELECT DISTINCT conv_id, split FROM turns) b ON b.conv_id = d.donor"))
def donor_split(spark, sf):
    t = catalog.turns(spark, sf)
    d, s = contexts.donors(t).where("donor IS NOT NULL"), t.select("conv_id", "split").distinct()
    j = d.join(s, "conv_id").join(s.select(F.col("conv_id").alias("donor"), F.col("split").alias("other")), "donor")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") != F.col("other")).alias("other_split"), F.count_if(F.col("donor") == F.col("conv_id")).alias("own"))


@query("J16_donor_rule", with_sql(DONORS + " SELECT CASE WHEN donor IS NULL THEN 'no_donor' WHEN donor = conv_id THEN 'same_dialogue' WHEN (SELECT max(turn) + 1 FROM turns t WHERE t.conv_id = d.donor) < turn THEN 'too_short' ELSE 'ok' END AS rule, count(*)::BIGINT AS n FROM d GROUP BY 1"))
def donor_rule(spark, sf):
    t = catalog.turns(spark, sf)
    n = t.groupBy(F.col("conv_id").alias("donor")).agg((F.max("turn") + 1).alias("turns"))
    rule = F.when(F.col("donor").isNull(), "no_donor").when(F.col("donor") == F.col("conv_id"), "same_dialogue").when(F.col("turns") < F.col("turn"), "too_short").otherwise("ok")
    return contexts.donors(t).join(n, "donor", "left").groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("P03_genuine", with_sql("SELECT item_id, turn > 0 AS genuine FROM items"))
def genuine(spark, sf):
    return catalog.items(spark, sf).select("item_id", (F.col("turn") > 0).alias("genuine"))


@query("P04_mismatch_set", with_sql(DONORS + " SELECT i.item_id, i.turn > 0 AND d.donor IS NOT NULL AS in_set FROM items i LEFT JOIN d USING (conv_id, turn)"))
def mismatch_set(spark, sf):
    t = catalog.turns(spark, sf)
    return catalog.items(spark, sf).join(contexts.donors(t).select("conv_id", "turn", "donor"), ["conv_id", "turn"], "left").select("item_id", ((F.col("turn") > 0) & F.col("donor").isNotNull()).alias("in_set"))


@query("P05_contexts_defined", with_sql(DONORS + " SELECT i.split, count_if(i.turn > 0 AND d.donor IS NOT NULL)::BIGINT AS defined, count(*)::BIGINT AS n FROM items i LEFT JOIN d USING (conv_id, turn) GROUP BY 1"))
def defined(spark, sf):
    t = catalog.turns(spark, sf)
    j = catalog.items(spark, sf).join(contexts.donors(t).select("conv_id", "turn", "donor"), ["conv_id", "turn"], "left")
    return j.groupBy("split").agg(F.count_if((F.col("turn") > 0) & F.col("donor").isNotNull()).alias("defined"), F.count(F.lit(1)).alias("n"))


REASON = "CASE WHEN turn = 0 THEN 'no_prior_context' WHEN words = 0 THEN 'no_user_acts' WHEN words % 5 = 0 THEN 'identical_paraphrases' END"


@query("P06_example_policy", with_sql(f", e AS (SELECT *, {REASON} AS reason FROM items) SELECT item_id || ':' || v.variant AS example_id, split, v.variant, (conv_id + turn + v.k) % 3 = 0 AS social FROM e, (VALUES (0, 'direct'), (1, 'indirect')) v(k, variant) WHERE reason IS NULL AND NOT (v.k = 1 AND words % 7 = 0)"))
def examples(spark, sf):
    """The first reason that applies excludes an item; then each of its two wordings is judged by itself."""
    i = catalog.items(spark, sf)
    reason = F.when(F.col("turn") == 0, "no_prior_context").when(F.col("words") == 0, "no_user_acts").when(F.col("words") % 5 == 0, "identical_paraphrases")
    two = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("variant")) for k, v in enumerate(("direct", "indirect"))])).alias("v")
    e = i.where(reason.isNull()).select("*", two).where(~((F.col("v.k") == 1) & (F.col("words") % 7 == 0)))
    return e.select(F.concat_ws(":", "item_id", "v.variant").alias("example_id"), "split", "v.variant", ((F.col("conv_id") + F.col("turn") + F.col("v.k")) % 3 == 0).alias("social"))


@query("P06_exclusion_counts", with_sql(f"SELECT {REASON} AS reason, count(*)::BIGINT AS n FROM items WHERE {REASON} IS NOT NULL GROUP BY 1"))
def exclusions(spark, sf):
    reason = F.when(F.col("turn") == 0, "no_prior_context").when(F.col("words") == 0, "no_user_acts").when(F.col("words") % 5 == 0, "identical_paraphrases")
    return catalog.items(spark, sf).where(reason.isNotNull()).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("P07_sampling_eligible", with_sql("SELECT item_id FROM items i WHERE split = 'dev' AND turn > 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = i.conv_id)"))
def eligible(spark, sf):
    lab = catalog.table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"))
    return catalog.items(spark, sf).where("split = 'dev' AND turn > 0").join(lab, "conv_id", "left_anti").select("item_id")


@query("P08_dialogue_pool", with_sql("SELECT conv_id, list(turn ORDER BY turn) AS turns FROM items i WHERE split <> 'test' AND turn > 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = i.conv_id) GROUP BY 1"))
def pool(spark, sf):
    lab = catalog.table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"))
    p = catalog.items(spark, sf).where("split <> 'test' AND turn > 0").join(lab, "conv_id", "left_anti")
    return p.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


@query("F12_input_hash", budget_sql(120, f", f AS ({FULL}) SELECT conv_id, turn, sha256(coalesce(array_to_string(lines[dropped + 1:], chr(10)), '') || chr(31) || target) AS input_sha256 FROM f JOIN w USING (conv_id, turn)"))
def hashes(spark, sf):
    r = contexts.rendered(catalog.turns(spark, sf), 120)
    return r.select("conv_id", "turn", contexts.input_hash(F.col("context"), F.col("target")).alias("input_sha256"))


@query("F13_target_hash", with_sql("SELECT item_id, sha256(text) AS target_sha256 FROM items"))
def target_hash(spark, sf):
    return catalog.items(spark, sf).select("item_id", F.sha2("text", 256).alias("target_sha256"))


@query("A34_distinct_inputs", with_sql("SELECT sha256(text) AS h, min(item_id) AS first_id, count(*)::BIGINT AS n FROM items GROUP BY 1"))
def distinct_inputs(spark, sf):
    return catalog.items(spark, sf).groupBy(F.sha2("text", 256).alias("h")).agg(F.min("item_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query("A10_context_lengths", budget_sql(350, "SELECT avg(context_words) AS mean, median(context_words) AS median, max(context_words) AS longest, (list(context_words ORDER BY context_words))[(floor(0.95 * (count(*) - 1)) + 1)::BIGINT] AS p95, count_if(dropped > 0)::BIGINT AS cut FROM w"))
def lengths(spark, sf):
    from turnstone.operators.scoring import order_statistic

    b = contexts.budgeted(catalog.turns(spark, sf)).withColumn("g", F.lit(0))
    s = b.groupBy("g").agg(F.avg("context_words").alias("mean"), F.median("context_words").alias("median"), F.max("context_words").alias("longest"), F.count_if(F.col("dropped") > 0).alias("cut"))
    return s.join(order_statistic(b, ["g"], "context_words", 0.95).withColumnRenamed("context_words", "p95"), "g").drop("g")


@query("A05_dataset_summary", with_sql("SELECT split, count(*)::BIGINT AS items, count(DISTINCT conv_id)::BIGINT AS dialogues, avg(turn) AS mean_history, median(turn) AS median_history, max(turn) AS max_history, count_if(words > 40)::BIGINT AS long_turns FROM items GROUP BY 1"))
def summary(spark, sf):
    return catalog.items(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("conv_id").alias("dialogues"), F.avg("turn").alias("mean_history"), F.median("turn").alias("median_history"), F.max("turn").alias("max_history"), F.count_if(F.col("words") > 40).alias("long_turns"))


@query("A36_one_split", with_sql("SELECT conv_id FROM turns GROUP BY 1 HAVING count(DISTINCT split) > 1 UNION ALL SELECT count(DISTINCT conv_id) FROM turns"))
def one_split(spark, sf):
    t = catalog.turns(spark, sf)
    bad = t.groupBy("conv_id").agg(F.countDistinct("split").alias("k")).where("k > 1").select("conv_id")
    return bad.unionAll(t.agg(F.countDistinct("conv_id").alias("conv_id")))


@query("S04_dialogue_turns", with_sql(f"SELECT conv_id, list(turn ORDER BY turn) AS turns, list(role ORDER BY turn) AS roles FROM turns GROUP BY 1"))
def dialogue_turns(spark, sf):
    t = catalog.turns(spark, sf).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("s"))
    return t.select("conv_id", F.transform("s", lambda x: x["turn"]).alias("turns"), F.transform("s", lambda x: x["role"]).alias("roles"))


@query("S06_parse_dialogue", with_sql("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'system' END AS speaker, bit_or(CASE WHEN role = 'assistant' THEN bit ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS belief FROM turns"))
def parse_dialogue(spark, sf):
    w = catalog.turns(spark, sf).withColumn("bit", F.when(F.col("role") == "assistant", F.col("bit")).otherwise(0))
    return contexts.cumulative_mask(w).select("conv_id", "turn", F.when(F.col("role") == "user", "user").otherwise("system").alias("speaker"), F.col("mask").alias("belief"))


@query("S14_corpus_index", with_sql("SELECT DISTINCT conv_id, split FROM turns"))
def corpus_index(spark, sf):
    return catalog.turns(spark, sf).select("conv_id", "split").distinct()


@query("S15_user_turns", with_sql("SELECT conv_id, array_to_string(list(text ORDER BY turn), chr(10)) AS user_text, count(*)::BIGINT AS n FROM items GROUP BY 1"))
def user_turns(spark, sf):
    g = catalog.items(spark, sf).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("conv_id", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("user_text"), "n")


@query("F09_tagged_lines", with_sql(f"SELECT conv_id, turn, {LINE} AS line FROM turns"))
def tagged(spark, sf):
    return catalog.turns(spark, sf).select("conv_id", "turn", tx.tagged_line(F.col("role"), F.col("text")).alias("line"))


@query("F10_word_count", with_sql("SELECT conv_id, turn, words FROM turns"))
def words(spark, sf):
    return catalog.turns(spark, sf).select("conv_id", "turn", "words")


@query("F11_turn_words", with_sql("SELECT conv_id, turn, words + 1 AS added FROM turns"))
def turn_words(spark, sf):
    return catalog.turns(spark, sf).select("conv_id", "turn", (F.col("words") + 1).alias("added"))


@query("F70_mask_domains", with_sql("SELECT conv_id, turn, bit, list_filter([0, 1, 2, 3, 4, 5, 6], lambda i: bit & (1 << i) <> 0) AS domains FROM turns"))
def mask_domains(spark, sf):
    d = F.expr("filter(sequence(0, 6), i -> bit & shiftleft(1, i) <> 0)")
    return catalog.turns(spark, sf).select("conv_id", "turn", "bit", d.alias("domains"))


@query("P31_export_inputs", with_sql(DONORS + " SELECT i.item_id, c.condition FROM items i CROSS JOIN conditions c LEFT JOIN d USING (conv_id, turn) WHERE c.k < 3 OR d.donor IS NOT NULL"))
def export(spark, sf):
    i = catalog.items(spark, sf).join(contexts.donors(catalog.turns(spark, sf)).select("conv_id", "turn", "donor"), ["conv_id", "turn"], "left")
    c = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("condition")) for k, n in enumerate(catalog.CONDITIONS)])).alias("c")
    return i.select("item_id", "donor", c).where("c.k < 3 OR donor IS NOT NULL").select("item_id", "c.condition")


@query("K10_smoke_sample", with_sql("SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY words DESC, item_id) AS a FROM items) WHERE a = 1 UNION (SELECT item_id FROM items ORDER BY item_id LIMIT 5)"))
def smoke(spark, sf):
    i = catalog.items(spark, sf)
    return i.orderBy(F.desc("words"), "item_id").limit(1).select("item_id").union(i.orderBy("item_id").limit(5).select("item_id")).distinct()
