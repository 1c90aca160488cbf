"""Functions over texts, names, maps and JSON, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone import catalog
from turnstone.functions import rules
from turnstone.functions import text as tx
from turnstone.registry import query


def docs(spark, sf):
    return catalog.table(spark, sf, "documents")


@query("F01_collapse", r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM documents")
def collapse(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(tx.fold(F.col("text")), 256).alias("h"))


@query("F02_apostrophes", r"SELECT p_partkey, lower(trim(regexp_replace(translate(p_name || '’s  ‘x', '‘’', ''''''), '\s+', ' ', 'g'))) AS folded FROM part")
def apostrophes(spark, sf):
    return catalog.table(spark, sf, "part").select("p_partkey", tx.fold_apostrophes(F.concat("p_name", F.lit("’s  ‘x"))).alias("folded"))


@query("F03_ascii_key", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def ascii_key(spark, sf):
    return docs(spark, sf).select("doc_id", tx.ascii_key(F.col("text")).alias("key"))


SLOTS = "SELECT p_partkey, (['hotel.area', 'train.leave', 'hotel.people', 'restaurant.price', 'hotel.name'])[p_partkey % 5 + 1] AS k, CASE p_partkey % 5 WHEN 0 THEN 'City  Centre' WHEN 1 THEN (p_partkey % 26) || ':' || lpad((p_partkey % 61)::VARCHAR, 2, '0') || ' pm' WHEN 2 THEN (['one', 'two', 'twelve', '7'])[p_size % 4 + 1] WHEN 3 THEN (['inexpensive', 'moderately', 'cheap'])[p_size % 3 + 1] ELSE upper(p_name) END AS v FROM part"


def slot_rows(spark, sf):
    p, n = catalog.table(spark, sf, "part"), F.col("p_partkey")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    v = F.when(n % 5 == 0, "City  Centre").when(n % 5 == 1, F.concat((n % 26).cast("string"), F.lit(":"), F.lpad((n % 61).cast("string"), 2, "0"), F.lit(" pm"))).when(n % 5 == 2, pick(("one", "two", "twelve", "7"), F.col("p_size") % 4)).when(n % 5 == 3, pick(("inexpensive", "moderately", "cheap"), F.col("p_size") % 3)).otherwise(F.upper("p_name"))
    return p.select("p_partkey", pick(("hotel.area", "train.leave", "hotel.people", "restaurant.price", "hotel.name"), n % 5).alias("k"), v.alias("v"))


@query("F04_slot_value", f"WITH s AS ({SLOTS}), t AS (SELECT *, lower(trim(regexp_replace(v, '\\s+', ' ', 'g'))) AS f, try_cast(split_part(v, ':', 1) AS INT) AS h, try_cast(substr(split_part(v, ':', 2), 1, 2) AS INT) AS m FROM s) SELECT p_partkey, CASE split_part(k, '.', 2) WHEN 'area' THEN CASE WHEN f IN ('center', 'city centre', 'city center') THEN 'centre' ELSE f END WHEN 'price' THEN CASE f WHEN 'inexpensive' THEN 'cheap' WHEN 'moderately' THEN 'moderate' ELSE f END WHEN 'people' THEN CASE f WHEN 'one' THEN '1' WHEN 'two' THEN '2' WHEN 'twelve' THEN '12' ELSE f END WHEN 'leave' THEN CASE WHEN h BETWEEN 1 AND 12 AND m < 60 THEN lpad((h % 12 + 12)::VARCHAR, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0') ELSE f END ELSE f END AS value FROM t")
def slot_value(spark, sf):
    return slot_rows(spark, sf).select("p_partkey", rules.slot_value(F.col("k"), F.col("v")).alias("value"))


@query("F22_clock", "WITH t AS (SELECT event_id, (event_id % 27) AS h, (event_id % 63) AS m, (['am', 'pm', ''])[event_id % 3 + 1] AS p FROM events) SELECT event_id, CASE WHEN m < 60 AND ((p <> '' AND h BETWEEN 1 AND 12) OR (p = '' AND h < 24)) THEN lpad((CASE WHEN p = '' THEN h ELSE h % 12 + CASE WHEN p = 'pm' THEN 12 ELSE 0 END END)::VARCHAR, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0') END AS clock FROM t")
def clock(spark, sf):
    e, n = catalog.table(spark, sf, "events"), F.col("event_id")
    return e.select("event_id", tx.clock(F.concat((n % 27).cast("string"), F.lit(":"), F.lpad((n % 63).cast("string"), 2, "0"), F.element_at(F.array(*map(F.lit, ("am", "pm", ""))), (n % 3 + 1).cast("int")))).alias("clock"))


@query("F05_closed_set", r"SELECT c_custkey, lower(trim(regexp_replace(c_mktsegment, '\s+', ' ', 'g'))) IN ('building', 'machinery') AS listed FROM customer")
def closed_set(spark, sf):
    return catalog.table(spark, sf, "customer").select("c_custkey", tx.fold(F.col("c_mktsegment")).isin("building", "machinery").alias("listed"))


@query("F06_canonical_id", r"SELECT c_custkey, nullif(regexp_extract(c_name, '^Customer#0*([0-9]+)$', 1), '') AS id FROM customer")
def canonical(spark, sf):
    i = F.regexp_extract("c_name", r"^Customer#0*([0-9]+)$", 1)
    return catalog.table(spark, sf, "customer").select("c_custkey", F.when(i != "", i).alias("id"))


@query("F07_label_key", "SELECT o_orderkey, CASE split_part(o_orderpriority, '-', 1) WHEN '1' THEN 'L0' WHEN '2' THEN 'L1' WHEN '3' THEN 'L2' WHEN '4' THEN 'L3' END AS label FROM orders")
def label_key(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in {"1": "L0", "2": "L1", "3": "L2", "4": "L3"}.items() for x in kv])
    return catalog.table(spark, sf, "orders").select("o_orderkey", F.try_element_at(m, F.substring_index("o_orderpriority", "-", 1)).alias("label"))


@query("F17_span_id", "SELECT doc_id, 'lit-' || substr(sha256(source || ':' || doc_id || ':' || n_chars), 1, 10) AS span_id FROM documents")
def span_id(spark, sf):
    return docs(spark, sf).select("doc_id", F.concat(F.lit("lit-"), F.substring(F.sha2(F.concat_ws(":", "source", "doc_id", "n_chars"), 256), 1, 10)).alias("span_id"))


@query("F18_slug", "SELECT page_id, trim(regexp_replace(lower(replace(url, '''', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slug(spark, sf):
    return catalog.table(spark, sf, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("F26_prefix_artifact", r"SELECT doc_id, regexp_matches(text, '^\s*(USER|User|SYSTEM|System)\s*:') OR regexp_matches(text, '^The ') AS flagged FROM documents")
def prefix(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", (t.rlike(r"^\s*(USER|User|SYSTEM|System)\s*:") | t.rlike("^The ")).alias("flagged"))


@query("F29_cue_flags", "SELECT a.conv_id, a.turn, contains(b.text, split_part(a.text, ' ', 1)) AS cue FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def cue(spark, sf):
    c = catalog.table(spark, sf, "conversations")
    b = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.contains("before", F.split_part("text", F.lit(" "), F.lit(1))).alias("cue"))


@query("F31_quoted_spans", """SELECT page_id, list_transform(list_filter(range(1, len(string_split(html, '"'))), lambda i: i % 2 = 1), lambda i: string_split(html, '"')[i + 1]) AS spans FROM pages""")
def quoted(spark, sf):
    return catalog.table(spark, sf, "pages").select("page_id", tx.quoted_spans(F.col("html")).alias("spans"))


@query("F33_speech_verb", r"SELECT doc_id, regexp_matches(text, '(?i)\b(the|und|les)\b') AS found FROM documents")
def speech(spark, sf):
    return docs(spark, sf).select("doc_id", tx.names_word(F.col("text"), "the", "und", "les").alias("found"))


@query("F34_sentences", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s) <> ''))::BIGINT AS n FROM documents")
def sentences(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n"))


#: Acts made from events: the type and the number decide domain and kind.
ACTS = """acts AS (SELECT user_id, a.act, list_sort(list_distinct(list(a.slot))) AS slots FROM (SELECT user_id, (['Hotel', 'Train', 'Police', 'Restaurant', 'general'])[event_id % 5 + 1] || '-' || CASE WHEN event_id % 5 = 4 THEN 'thank' ELSE (['Inform', 'Request'])[user_id % 2 + 1] END AS act,
 (['People', 'Day', 'Area', 'Stay', 'none'])[(json_extract(props, '$.k')::BIGINT) % 5 + 1] AS slot FROM events WHERE event_id % 97 < 3 OR user_id % 4 = 1 AND event_id % 5 = 4) a GROUP BY 1, 2)"""


def acts(spark, sf):
    e, n = catalog.table(spark, sf, "events").where("event_id % 97 < 3 OR user_id % 4 = 1 AND event_id % 5 = 4"), F.col("event_id")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    act = F.concat(pick(("Hotel", "Train", "Police", "Restaurant", "general"), n % 5), F.lit("-"), F.when(n % 5 == 4, "thank").otherwise(pick(("Inform", "Request"), F.col("user_id") % 2)))
    slot = pick(("People", "Day", "Area", "Stay", "none"), F.get_json_object("props", "$.k").cast("long") % 5)
    one = e.select("user_id", act.alias("act"), slot.alias("slot")).groupBy("user_id", "act").agg(F.array_sort(F.collect_set("slot")).alias("slots"))
    return one.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("act", "slots"))).alias("acts"))


PREDICTED = "WITH t AS (SELECT p_partkey, list_distinct([p_size % 3, p_size % 5, p_size % 7]) AS gold, list_distinct([p_size % 3, p_size % 4, p_size % 7]) AS pred FROM part)"


def sets(spark, sf):
    s = F.col("p_size")
    return catalog.table(spark, sf, "part").select("p_partkey", F.array_distinct(F.array(s % 3, s % 5, s % 7)).alias("gold"), F.array_distinct(F.array(s % 3, s % 4, s % 7)).alias("pred"))


@query("F41_outcome", PREDICTED + " SELECT p_partkey, list_sort(gold) = list_sort(pred) AS exact, len(list_intersect(gold, pred))::INT AS correct, len(gold)::INT AS n_gold, len(pred)::INT AS n_pred FROM t")
def outcome(spark, sf):
    return sets(spark, sf).select("p_partkey", (F.array_sort("gold") == F.array_sort("pred")).alias("exact"), F.size(F.array_intersect("gold", "pred")).alias("correct"), F.size("gold").alias("n_gold"), F.size("pred").alias("n_pred"))


@query("A23_slot_recovery", PREDICTED + " SELECT sum(len(list_intersect(gold, pred)))::DOUBLE / sum(len(gold)) AS recall, sum(len(list_intersect(gold, pred)))::DOUBLE / sum(len(pred)) AS precision FROM t")
def recovery(spark, sf):
    c = F.size(F.array_intersect("gold", "pred"))
    return sets(spark, sf).agg((F.sum(c) / F.sum(F.size("gold"))).alias("recall"), (F.sum(c) / F.sum(F.size("pred"))).alias("precision"))


@query("F23_slot_comparison", PREDICTED + " SELECT p_partkey, CASE WHEN len(list_filter(gold, lambda x: NOT list_contains(pred, x))) = 0 THEN 'kept' WHEN len(list_filter(pred, lambda x: NOT list_contains(gold, x))) > 0 THEN 'substituted' ELSE 'dropped' END AS outcome FROM t")
def comparison(spark, sf):
    lost, new = F.size(F.array_except("gold", "pred")) > 0, F.size(F.array_except("pred", "gold")) > 0
    return sets(spark, sf).select("p_partkey", F.when(~lost, "kept").when(new, "substituted").otherwise("dropped").alias("outcome"))


@query("F24_nested_words", "WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type), ' ') || string_split(p_name, ' ')[:1] AS b FROM part) SELECT p_partkey, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 OR len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS nested FROM t")
def nested(spark, sf):
    p = catalog.table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split(F.lower("p_type"), " ").alias("t"))
    p = p.withColumn("b", F.concat("t", F.slice("a", 1, 1)))
    return p.select("p_partkey", ((F.size(F.array_except("a", "b")) == 0) | (F.size(F.array_except("b", "a")) == 0)).alias("nested"))


@query("F43_stage1_correct", "SELECT d.doc_id, coalesce(l.toxic = 0, false) AS correct FROM documents d LEFT JOIN labels l USING (doc_id)")
def stage1(spark, sf):
    return docs(spark, sf).join(catalog.table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("correct"))


@query("F44_detected", "SELECT d.doc_id, l.quality IS NOT NULL AND l.quality <> 0 AS detected FROM documents d LEFT JOIN labels l USING (doc_id)")
def detected(spark, sf):
    return docs(spark, sf).join(catalog.table(spark, sf, "labels"), "doc_id", "left").select("doc_id", (F.col("quality").isNotNull() & (F.col("quality") != 0)).alias("detected"))


@query("F48_request_type", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'none' WHEN event_type = 'error' THEN 'uncertain' WHEN event_id % 6 = 0 THEN 'direct' WHEN event_id % 6 IN (1, 2, 3) THEN 'indirect' ELSE 'form_unknown' END AS request_type FROM events")
def request_type(spark, sf):
    f = F.col("event_id") % 6
    return catalog.table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "none").when(F.col("event_type") == "error", "uncertain").when(f == 0, "direct").when(f.isin(1, 2, 3), "indirect").otherwise("form_unknown").alias("request_type"))


@query("F50_evidence", "SELECT p_partkey, list_sort(list_distinct(list_filter([p_size % 9, p_size % 4, p_size % 9, 12], lambda x: x < 10))) AS evidence FROM part")
def evidence(spark, sf):
    s = F.col("p_size")
    listed = F.concat_ws(";", (s % 9).cast("string"), (s % 4).cast("string"), (s % 9).cast("string"), F.lit("12"))
    n = F.transform(F.split(listed, ";"), lambda x: x.cast("int"))
    return catalog.table(spark, sf, "part").select("p_partkey", F.array_sort(F.array_distinct(F.filter(n, lambda x: x < 10))).alias("evidence"))


@query("F52_pairs", "SELECT p_partkey, 'a=' || p_size || ';b=x=' || p_brand AS pairs FROM part")
def pairs(spark, sf):
    raw = F.concat(F.lit("b= x="), "p_brand", F.lit(" ; a ="), F.col("p_size").cast("string"), F.lit(";"))
    return catalog.table(spark, sf, "part").select("p_partkey", tx.pairs(raw).alias("pairs"))


@query("F51_read_pairs", "SELECT p_partkey, p_size::VARCHAR AS a, 'x=' || p_brand AS b FROM part")
def read_pairs(spark, sf):
    m = F.str_to_map(F.concat(F.lit("b=x="), "p_brand", F.lit(";a="), F.col("p_size").cast("string")), F.lit(";"), F.lit("="))
    return catalog.table(spark, sf, "part").select("p_partkey", F.element_at(m, "a").alias("a"), F.element_at(m, "b").alias("b"))


@query("F53_bounded_text", r"SELECT doc_id, length(text) <= 800 AND NOT regexp_matches(text, '[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]') AS clean FROM documents")
def bounded(spark, sf):
    return docs(spark, sf).select("doc_id", tx.clean(F.col("text"), 800).alias("clean"))


@query("F55_sheet_escape", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '''' || c_acctbal::INT ELSE c_acctbal::INT::VARCHAR END AS cell FROM customer WHERE round(c_acctbal) <> 0 AND abs(c_acctbal - trunc(c_acctbal)) NOT BETWEEN 0.499 AND 0.501")
def sheet(spark, sf):
    c = catalog.table(spark, sf, "customer").where("round(c_acctbal) <> 0 AND abs(c_acctbal - cast(c_acctbal AS bigint)) NOT BETWEEN 0.499 AND 0.501")
    return c.select("c_custkey", tx.sheet_safe(F.round("c_acctbal").cast("int").cast("string")).alias("cell"))


@query("F57_mask_ids", r"SELECT c_custkey, regexp_replace(c_name || ' and ' || c_custkey, '(^|[^A-Za-z0-9])[0-9]{5,}($|[^A-Za-z0-9])', '\1<id>\2', 'g') AS masked FROM customer")
def mask_ids(spark, sf):
    return catalog.table(spark, sf, "customer").select("c_custkey", tx.masked_ids(F.concat_ws(" and ", "c_name", F.col("c_custkey").cast("string"))).alias("masked"))


@query("F58_phase", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'pre_freeze' ELSE 'post_freeze' END AS phase FROM orders")
def phase(spark, sf):
    return catalog.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp"), "pre_freeze").otherwise("post_freeze").alias("phase"))


@query("F61_nesting", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 3 END AS depth FROM events""")
def nesting(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit('{"x[{[": [['), F.lit("1]], \"y\": "), "props", F.lit("}")))
    return catalog.table(spark, sf, "events").select("event_id", tx.depth(raw).alias("depth"))


@query("F65_defang", r"SELECT page_id, regexp_replace(html, '(?i)<(\s*/?\s*(title|body|nav)\b)', '&lt;\1', 'g') AS safe FROM pages")
def defang(spark, sf):
    return catalog.table(spark, sf, "pages").select("page_id", tx.defang(F.col("html"), ("title", "body", "nav")).alias("safe"))


@query("F69_cache_key", "SELECT event_id, sha256(concat_ws(chr(31), event_type, user_id::VARCHAR, props)) AS key FROM events")
def cache_key(spark, sf):
    return catalog.table(spark, sf, "events").select("event_id", F.sha2(F.concat_ws("\x1f", "event_type", F.col("user_id").cast("string"), "props"), 256).alias("key"))


@query("F73_url_rules", "SELECT page_id, url LIKE 'https://%' AND regexp_matches(url, '^https://[^/?#]*\\.example\\.(com|org)(/|\\?|#|$)') AS allowed FROM pages")
def url_rules(spark, sf):
    u = F.col("url")
    return catalog.table(spark, sf, "pages").select("page_id", ((F.parse_url(u, F.lit("PROTOCOL")) == "https") & F.parse_url(u, F.lit("HOST")).rlike(r"\.example\.(com|org)$")).alias("allowed"))


@query("F76_round_up", "SELECT doc_id, (ceil(n_chars / 512.0) * 512)::BIGINT AS length FROM documents")
def round_up(spark, sf):
    return docs(spark, sf).select("doc_id", (F.ceil(F.col("n_chars") / 512) * 512).cast("long").alias("length"))


@query("A08_vocabulary", "WITH w AS (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) SELECT w, count(*)::BIGINT AS n FROM w WHERE length(w) >= 3 AND w NOT IN ('red', 'small') GROUP BY 1 HAVING count(*) >= 3")
def vocabulary(spark, sf):
    w = catalog.table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).where(F.length("w") >= 3)
    stop = spark.createDataFrame([("red",), ("small",)], "w string")
    return w.join(F.broadcast(stop), "w", "left_anti").groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")  # a fixed list


@query("A32_slot_keys", "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def slot_keys(spark, sf):
    return catalog.table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("key")).distinct()


@query("A33_key_coverage", "SELECT event_type, count(DISTINCT json_extract(props, '$.k')::BIGINT)::BIGINT AS keys, count(DISTINCT CASE WHEN json_extract(props, '$.k')::BIGINT < 50 THEN json_extract(props, '$.k')::BIGINT END)::BIGINT AS covered FROM events GROUP BY 1")
def key_coverage(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return catalog.table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct(k).alias("keys"), F.countDistinct(F.when(k < 50, k)).alias("covered"))


@query("A35_prompt_length", "SELECT max(n_chars) AS longest, count_if(n_chars > 4096)::BIGINT AS over FROM documents")
def prompt_length(spark, sf):
    return docs(spark, sf).agg(F.max("n_chars").alias("longest"), F.count_if(F.col("n_chars") > 4096).alias("over"))


@query("A37_token_lengths", r"WITH t AS (SELECT lang, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS n FROM documents) SELECT lang, count(*)::BIGINT AS docs, max(n) AS longest, count_if(n > 400)::BIGINT AS over FROM t GROUP BY 1")
def token_lengths(spark, sf):
    t = docs(spark, sf).select("lang", tx.word_count(F.col("text")).cast("long").alias("n"))
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.max("n").alias("longest"), F.count_if(F.col("n") > 400).alias("over"))


@query("J18_alias_candidates", "SELECT p_partkey, list_position(['ECONOMY', 'SMALL', 'LARGE'], p_type) AS candidate FROM part")
def alias(spark, sf):
    p = F.array_position(F.array(*map(F.lit, ("ECONOMY", "SMALL", "LARGE"))), F.col("p_type"))
    return catalog.table(spark, sf, "part").select("p_partkey", F.when(p > 0, p.cast("int")).alias("candidate"))


@query("A27_transfer_report", "SELECT CASE WHEN grouping(p_size % 2) = 1 THEN NULL ELSE p_size % 2 END AS ambiguous, avg((p_size % 3 = 0)::INT) AS recall, count(*)::BIGINT AS n FROM part GROUP BY GROUPING SETS ((), (p_size % 2))")
def transfer(spark, sf):
    catalog.table(spark, sf, "part").selectExpr("p_size % 2 AS ambiguous", "cast(p_size % 3 = 0 AS int) AS hit").createOrReplaceTempView("turnstone_transfer")
    return spark.sql("SELECT ambiguous, avg(hit) AS recall, count(*) AS n FROM turnstone_transfer GROUP BY GROUPING SETS ((), (ambiguous))")
