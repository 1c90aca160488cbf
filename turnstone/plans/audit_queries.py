"""Joins with expectations, registries, duplicates across splits, merges, versions and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone import catalog
from turnstone.catalog import with_sql
from turnstone.operators import audits, merging
from turnstone.registry import query


def lab(spark, sf):
    return catalog.table(spark, sf, "labels")


def docs(spark, sf):
    """Documents with a split by the number in source."""
    d = catalog.table(spark, sf, "documents")
    return d.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (F.regexp_extract("source", r"(\d+)", 1).cast("int") % 3 + 1)))


DOCS = "d AS (SELECT *, (['train', 'dev', 'test'])[regexp_extract(source, '([0-9]+)', 1)::INT % 3 + 1] AS split FROM documents)"


@query("J01_row_turn_lookup", with_sql(", r AS (SELECT conv_id + (turn % 11 = 10)::INT * 1000 AS conv_id, turn + (conv_id % 13 = 5)::INT * 50 AS turn, CASE conv_id % 3 WHEN 0 THEN text WHEN 1 THEN '  ' || text ELSE translate(text, 'abcde', 'ABCDE') END AS text FROM items) SELECT r.conv_id, r.turn, CASE WHEN NOT EXISTS (SELECT 1 FROM turns t WHERE t.conv_id = r.conv_id) THEN 'dialogue_not_found' WHEN t.conv_id IS NULL THEN 'turn_index_out_of_range' WHEN t.role <> 'user' THEN 'not_a_user_turn' WHEN t.text = r.text THEN 'exact' WHEN trim(t.text) = trim(r.text) THEN 'stripped' WHEN lower(trim(t.text)) = lower(trim(r.text)) THEN 'normalized' ELSE 'text_mismatch' END AS outcome FROM r LEFT JOIN turns t ON r.conv_id = t.conv_id AND r.turn = t.turn"))
def lookup(spark, sf):
    i, t = catalog.items(spark, sf), catalog.turns(spark, sf)
    text = F.when(F.col("conv_id") % 3 == 0, F.col("text")).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("  "), "text")).otherwise(F.translate("text", "abcde", "ABCDE"))
    r = i.select((F.col("conv_id") + F.when(F.col("turn") % 11 == 10, 1000).otherwise(0)).alias("conv_id"), (F.col("turn") + F.when(F.col("conv_id") % 13 == 5, 50).otherwise(0)).alias("turn"), text.alias("text"))
    return audits.match_rows(r, t)


@query("J02_split_flag", with_sql("SELECT item_id, conv_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS in_list FROM items"))
def split_flag(spark, sf):
    listed = lab(spark, sf).where("toxic = 1").select(F.col("doc_id").alias("conv_id")).distinct().withColumn("in_list", F.lit(True))
    return catalog.items(spark, sf).join(listed, "conv_id", "left").select("item_id", F.coalesce("in_list", F.lit(False)).alias("in_list"))


@query("J04_labels_join", "SELECT l.doc_id, l.quality, d.lang FROM labels l JOIN documents d USING (doc_id) WHERE l.quality <> 0 UNION ALL SELECT NULL, NULL, 'excluded ' || count(*) FROM labels WHERE quality = 0")
def labels_join(spark, sf):
    kept = lab(spark, sf).where("quality <> 0").join(catalog.table(spark, sf, "documents"), "doc_id").select("doc_id", "quality", "lang")
    out = lab(spark, sf).where("quality = 0").agg(F.concat(F.lit("excluded "), F.count(F.lit(1)).cast("string")).alias("lang"))
    return kept.unionByName(out, allowMissingColumns=True)


@query("J05_unmatched_labels", "SELECT count(*)::BIGINT AS unmatched FROM labels l WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = l.doc_id)")
def unmatched(spark, sf):
    b = catalog.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return lab(spark, sf).join(b, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))


@query("J06_stream_subset", with_sql(", o AS (SELECT item_id, sha256(CASE WHEN conv_id % 9 = 1 THEN text || '!' ELSE text END) AS h FROM items UNION ALL SELECT 'z' || item_id, 'x' FROM items WHERE turn = 0) SELECT count_if(i.item_id IS NULL)::BIGINT AS missing, count_if(i.item_id IS NOT NULL AND sha256(i.text) <> o.h)::BIGINT AS changed FROM o LEFT JOIN items i USING (item_id)"))
def subset(spark, sf):
    i = catalog.items(spark, sf)
    o = i.select("item_id", F.sha2(F.when(F.col("conv_id") % 9 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h")).unionAll(i.where("turn = 0").select(F.concat(F.lit("z"), "item_id"), F.lit("x")))
    j = o.join(i.select("item_id", F.sha2("text", 256).alias("own")), "item_id", "left")
    return j.agg(F.count_if(F.col("own").isNull()).alias("missing"), F.count_if(F.col("own").isNotNull() & (F.col("own") != F.col("h"))).alias("changed"))


@query("J12_registry_flags", f"WITH {DOCS}, t AS (SELECT DISTINCT md5(text) AS h FROM d WHERE split = 'train') SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'inspected:toxic' WHEN t.h IS NOT NULL THEN 'dup' END AS exclusion, t.h IS NOT NULL AS dup_text FROM d LEFT JOIN labels l USING (doc_id) LEFT JOIN t ON t.h = md5(d.text) WHERE d.split = 'test'")
def registry_flags(spark, sf):
    return audits.registry_flags(docs(spark, sf), lab(spark, sf))


@query("J13_exclusion_reason", f"WITH {DOCS}, t AS (SELECT DISTINCT md5(text) AS h FROM d WHERE split = 'train') SELECT coalesce(CASE WHEN l.toxic = 1 THEN 'inspected:toxic' WHEN t.h IS NOT NULL THEN 'dup' END, 'primary') AS reason, count(*)::BIGINT AS n FROM d LEFT JOIN labels l USING (doc_id) LEFT JOIN t ON t.h = md5(d.text) WHERE d.split = 'test' GROUP BY 1")
def exclusion_reason(spark, sf):
    return audits.registry_flags(docs(spark, sf), lab(spark, sf)).groupBy(F.coalesce("exclusion", F.lit("primary")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("J14_cross_split_duplicates", f"WITH {DOCS}, k AS (SELECT md5(text) AS h, bool_or(split = 'train') AS tr, bool_or(split = 'dev') AS dv, bool_or(split = 'test') AS te FROM d GROUP BY 1) SELECT d.doc_id, CASE WHEN tr THEN 'train' ELSE 'dev' END AS also_in FROM d JOIN k ON k.h = md5(d.text) WHERE d.split = 'test' AND (tr OR dv)")
def cross_split(spark, sf):
    return audits.cross_split_duplicates(docs(spark, sf), F.md5("text"))


@query("P09_primary_examples", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def primary(spark, sf):
    return catalog.table(spark, sf, "documents").join(lab(spark, sf).where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("P10_drop_excluded", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def drop_excluded(spark, sf):
    return catalog.table(spark, sf, "documents").join(lab(spark, sf).where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query("P12_members", with_sql("SELECT condition, count(*)::BIGINT AS members, count_if(gold = 1)::BIGINT AS oracle FROM p0 WHERE k < 3 OR turn > 0 GROUP BY 1"))
def members(spark, sf):
    return catalog.predictions(spark, sf).where("k < 3 OR turn > 0").groupBy("condition").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("gold") == 1).alias("oracle"))


@query("P13_restrict", with_sql("SELECT item_id, condition FROM p0 WHERE conv_id IN (SELECT item_id FROM benchmark WHERE item_id % 2 = 0)"))
def restrict(spark, sf):
    ids = catalog.table(spark, sf, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("conv_id"))
    return catalog.predictions(spark, sf).join(ids, "conv_id", "left_semi").select("item_id", "condition")


@query("P14_filter_inputs", with_sql("SELECT item_id, condition FROM p0 WHERE condition IN ('none', 'full') AND split = 'dev'"))
def filter_inputs(spark, sf):
    return catalog.predictions(spark, sf).where("condition IN ('none', 'full') AND split = 'dev'").select("item_id", "condition")


RULES = [("negative_balance", "c_acctbal < 0"), ("no_segment", "c_mktsegment IS NULL"), ("bad_name", "c_name NOT LIKE 'Customer#%'"), ("odd_nation", "c_nationkey % 7 = 3")]


@query("P16_row_problems", "SELECT c_custkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in RULES) + "], lambda x: x IS NOT NULL), ';') AS problems FROM customer")
def row_problems(spark, sf):
    return catalog.table(spark, sf, "customer").select("c_custkey", F.array_join(audits.problems(RULES), ";").alias("problems"))


@query("P17_registry_validation", "SELECT p_name || '/' || p_brand AS key, count(*)::BIGINT AS times FROM part GROUP BY 1 HAVING count(*) > 1")
def registry_validation(spark, sf):
    return audits.repeated(catalog.table(spark, sf, "part").select(F.concat_ws("/", "p_name", "p_brand").alias("key")), ["key"])


@query("A12_rule_failures", " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*)::BIGINT AS failures, min(c_custkey) AS first_offender FROM customer WHERE {c} HAVING count(*) > 0" for n, c in RULES))
def rule_failures(spark, sf):
    return audits.failures(catalog.table(spark, sf, "customer"), RULES, "c_custkey")


@query("A14_split_rules", f"WITH {DOCS} SELECT split, count(*)::BIGINT AS n, count_if(md5(text) IN (SELECT md5(text) FROM d WHERE split = 'train'))::BIGINT AS dup, count_if(md5(text) IN (SELECT md5(text) FROM d WHERE split = 'train')) > 0.01 * count(*) AS needs_decision FROM d WHERE split <> 'train' GROUP BY 1")
def split_rules(spark, sf):
    d = docs(spark, sf).select("split", F.md5("text").alias("h"))
    t = d.where("split = 'train'").select("h").distinct().withColumn("dup", F.lit(1))
    j = d.where("split <> 'train'").join(t, "h", "left")
    return j.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("dup").alias("dup"), (F.count("dup") > 0.01 * F.count(F.lit(1))).alias("needs_decision"))


@query("A15_first_reason", "WITH s AS (SELECT o_custkey AS k, o_orderstatus AS source, o_orderpriority AS reason FROM orders) SELECT k, arg_min(reason, (CASE source WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END)::VARCHAR || reason) AS reason FROM s GROUP BY 1")
def first_reason(spark, sf):
    s = catalog.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("reason"))
    return merging.first_reason(s, "k", ["F", "O", "P"])


@query("A28_error_codes", "SELECT event_type, count_if(event_id % 4 = 0)::BIGINT AS c0, count_if(event_id % 4 = 1)::BIGINT AS c1, count_if(event_id % 4 = 2)::BIGINT AS c2, count_if(event_id % 4 = 3)::BIGINT AS c3 FROM events GROUP BY 1")
def error_codes(spark, sf):
    e = catalog.table(spark, sf, "events").withColumn("c", F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")))
    return e.groupBy("event_type").pivot("c", ["c0", "c1", "c2", "c3"]).agg(F.count(F.lit(1))).na.fill(0)


@query("A38_coverage_cells", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def cells(spark, sf):
    return catalog.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("A41_content_hash", "SELECT lang, count(*)::BIGINT AS n, sha256(array_to_string(list_sort(list(doc_id || ':' || n_chars)), chr(10))) AS hash FROM documents GROUP BY 1")
def content_hash(spark, sf):
    return merging.content_hash(catalog.table(spark, sf, "documents").select("lang", F.concat_ws(":", "doc_id", "n_chars").alias("line")), ["lang"], "line")


@query("A42_sample_hash", "SELECT r_name AS name, sha256(array_to_string(list_sort(list(n_name)), chr(10))) AS hash, count(*)::BIGINT AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def sample_hash(spark, sf):
    n = catalog.table(spark, sf, "nation").join(catalog.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return merging.content_hash(n.select(F.col("r_name").alias("name"), "n_name"), ["name"], "n_name")


@query("U01_union", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def union(spark, sf):
    return catalog.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(catalog.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("U02_labelled_turns", "SELECT doc_id AS id FROM labels UNION SELECT conv_id FROM conversations")
def labelled(spark, sf):
    return lab(spark, sf).select(F.col("doc_id").alias("id")).union(catalog.table(spark, sf, "conversations").select("conv_id")).distinct()


@query("U03_dialogues_read", "SELECT DISTINCT conv_id FROM conversations WHERE turn > 3")
def dialogues_read(spark, sf):
    return catalog.table(spark, sf, "conversations").where("turn > 3").select("conv_id").distinct()


@query("U04_split_sets", "SELECT 'both' AS side, count(*)::BIGINT AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'only_customers', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def split_sets(spark, sf):
    c, o = catalog.table(spark, sf, "customer").select("c_custkey"), catalog.table(spark, sf, "orders").select("o_custkey")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return count(c.intersect(o), "both").unionAll(count(c.subtract(o), "only_customers"))


HALVES = "a AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 3 <> 1)"


def halves(spark, sf):
    x = lab(spark, sf)
    return x.where("doc_id % 3 <> 0"), x.where("doc_id % 3 <> 1").withColumn("quality", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))


@query("U05_insert_only", f"WITH {HALVES} SELECT b.doc_id, CASE WHEN a.doc_id IS NULL THEN 'inserted' WHEN a.quality = b.quality AND a.toxic = b.toxic THEN 'unchanged' ELSE 'conflict' END AS outcome FROM b LEFT JOIN a USING (doc_id)")
def insert_only(spark, sf):
    a, b = halves(spark, sf)
    return merging.classify_insert(a, b, ["doc_id"], ["quality", "toxic"])


@query("U08_new_rows", f"WITH {HALVES} SELECT * FROM a UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)")
def new_rows(spark, sf):
    a, b = halves(spark, sf)
    return merging.insert_only(a, b, ["doc_id"])


@query("U09_append_or_refuse", f"WITH {HALVES} SELECT count_if(a.doc_id IS NOT NULL AND (a.quality <> b.quality OR a.toxic <> b.toxic)) > 0 AS refused FROM b LEFT JOIN a USING (doc_id)")
def append_or_refuse(spark, sf):
    a, b = halves(spark, sf)
    return merging.classify_insert(a, b, ["doc_id"], ["quality", "toxic"]).agg((F.count_if(F.col("outcome") == "conflict") > 0).alias("refused"))


@query("U11_supersede", f"WITH {HALVES} SELECT a.*, CASE WHEN b.doc_id IS NOT NULL AND (a.quality <> b.quality OR a.toxic <> b.toxic) THEN 'superseded' ELSE 'live' END AS status FROM a LEFT JOIN b USING (doc_id) UNION ALL SELECT b.*, 'live' FROM b LEFT JOIN a USING (doc_id) WHERE a.doc_id IS NULL OR a.quality <> b.quality OR a.toxic <> b.toxic")
def supersede(spark, sf):
    a, b = halves(spark, sf)
    return merging.supersede(a, b, ["doc_id"], ["quality", "toxic"])


@query("W09_live_rows", f"WITH {HALVES} SELECT doc_id, quality FROM (SELECT *, 1 AS v FROM a UNION ALL SELECT *, 2 FROM b) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v DESC) = 1")
def live(spark, sf):
    a, b = halves(spark, sf)
    both = a.withColumn("v", F.lit(1)).unionByName(b.withColumn("v", F.lit(2)))
    return both.groupBy("doc_id").agg(F.max_by("quality", "v").alias("quality"))


@query("U07_derived_rows", "SELECT user_id, min(event_type) AS inspector FROM events WHERE event_type <> 'view' GROUP BY 1")
def derived_rows(spark, sf):
    return catalog.table(spark, sf, "events").where("event_type <> 'view'").groupBy("user_id").agg(F.min("event_type").alias("inspector"))


@query("U14_slot_sets", "WITH t AS (SELECT p_partkey, list_distinct([p_size % 3, p_size % 5]) AS need, list_distinct([p_size % 4, p_size % 5]) AS have FROM part) SELECT p_partkey, list_sort(list_filter(need, lambda x: NOT list_contains(have, x))) AS missing, list_sort(list_filter(have, lambda x: NOT list_contains(need, x))) AS undefined FROM t")
def slot_sets(spark, sf):
    s = F.col("p_size")
    p = catalog.table(spark, sf, "part").select("p_partkey", F.array(s % 3, s % 5).alias("need"), F.array(s % 4, s % 5).alias("have"))
    return p.select("p_partkey", F.array_sort(F.array_except("need", "have")).alias("missing"), F.array_sort(F.array_except("have", "need")).alias("undefined"))


@query("U17_pin_diff", "WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 0) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v")
def pin_diff(spark, sf):
    c = catalog.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return merging.diff(c.where("k % 5 <> 0"), c.where("k % 7 <> 0").withColumn("v", F.when(F.col("k") % 4 == 0, "x").otherwise(F.col("v"))), "k", "v")


@query("S30_embedded_ids", r"SELECT DISTINCT regexp_extract(url, '/([0-9]+)', 1) AS id FROM pages WHERE regexp_matches(url, '/[0-9]+')")
def embedded(spark, sf):
    return catalog.table(spark, sf, "pages").where(F.col("url").rlike("/[0-9]+")).select(F.regexp_extract("url", "/([0-9]+)", 1).alias("id")).distinct()


@query("S31_ids_in_test", r"SELECT DISTINCT regexp_extract(url, '/([0-9]+)', 1)::BIGINT AS id FROM pages WHERE regexp_matches(url, '/[0-9]+') AND regexp_extract(url, '/([0-9]+)', 1)::BIGINT IN (SELECT doc_id FROM labels)")
def ids_in_test(spark, sf):
    ids = catalog.table(spark, sf, "pages").where(F.col("url").rlike("/[0-9]+")).select(F.regexp_extract("url", "/([0-9]+)", 1).cast("long").alias("id")).distinct()
    return ids.join(lab(spark, sf).select(F.col("doc_id").alias("id")), "id", "left_semi")


@query("S24_verified_inputs", "SELECT count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS keys, count_if(length(text) <> n_chars)::BIGINT AS damaged FROM documents")
def verified(spark, sf):
    return catalog.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("keys"), F.count_if(F.char_length("text") != F.col("n_chars")).alias("damaged"))


@query("G01_split_check", f"WITH {DOCS}, k AS (SELECT md5(text) AS h, count(DISTINCT split) AS s FROM d GROUP BY 1) SELECT count(*)::BIGINT AS texts, count_if(s > 1)::BIGINT AS in_two_splits FROM k")
def split_check(spark, sf):
    return docs(spark, sf).groupBy(F.md5("text").alias("h")).agg(F.countDistinct("split").alias("s")).agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("s") > 1).alias("in_two_splits"))


@query("G03_rebuild_compare", "SELECT 0::BIGINT AS differing, count(*)::BIGINT AS n FROM nation")
def rebuild(spark, sf):
    n = catalog.table(spark, sf, "nation")
    again = n.repartition(3, "n_name")
    gone = n.exceptAll(again).unionAll(again.exceptAll(n)).agg(F.count(F.lit(1)).alias("differing"))
    return gone.crossJoin(n.agg(F.count(F.lit(1)).alias("n")))  # one row each


@query("M08_distinct_calls", "WITH i AS (SELECT doc_id, sha256(text) AS h, n_chars FROM documents), c AS (SELECT DISTINCT h FROM i WHERE doc_id % 4 = 0) SELECT count(DISTINCT i.h)::BIGINT AS inputs, count(DISTINCT c.h)::BIGINT AS hits, (count(DISTINCT i.h) - count(DISTINCT c.h))::BIGINT AS calls FROM i LEFT JOIN c ON i.h = c.h")
def calls(spark, sf):
    i = catalog.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    cached = i.where("doc_id % 4 = 0").select("h").distinct().withColumn("hit", F.lit(1))
    return i.select("h").distinct().join(cached, "h", "left").agg(F.count(F.lit(1)).alias("inputs"), F.count("hit").alias("hits"), (F.count(F.lit(1)) - F.count("hit")).alias("calls"))

