"""Secret scans with DataFrame functions only: base patterns, and credentials whose parts stand in different places.

Base spans come from one pattern per kind. Places of matches are found without any Python: the pieces between the matches
(``split``) and the matches themselves (``regexp_extract_all``) alternate, so running sums of their lengths are offsets.

Multipart credentials: an access identifier alone says little, and neither does a secret-like string or an endpoint. The
parts of a text are put in order and a part that is weak by itself is reported only if complementary parts lie in the same
scope, an interval of ``SCOPE`` code points around it. That is an interval join of parts with identifiers within a text; as
both sides are sorted, the nearest identifier before and after a part decides, so one window pass joins them and no pairs
are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The base patterns, fixed by contract.
ASSIGN = r"""(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"  # a shorter run has no match inside that is long enough
HEX = "[0-9a-f]{16,}"
ASSIGN_LEAST = 12

#: Parts that are weak by themselves. A secret starts where its own alphabet does, so after '=' or ':' too; a run with '-' or '_'
#: and without '+' and '/' is read whole, as URL-safe, and is not the name of an assignment.
_MIXED = "(?={0}*[0-9])(?={0}*[a-z])(?={0}*[A-Z])"
_URL_SAFE = "(?<![A-Za-z0-9+/_-])" + _MIXED.format("[A-Za-z0-9_-]") + "[A-Za-z0-9_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])"
_PLAIN = "(?<![A-Za-z0-9+/])" + _MIXED.format("[A-Za-z0-9+/]") + "[A-Za-z0-9+/]{32,}={0,2}"
SECRET = f"{_URL_SAFE}|{_PLAIN}"
ENDPOINT = r"(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"
SCOPE = 400
CHUNK = 128  #: matches, or spans, that one fold takes; a fold copies its list at each step, so longer ones are folded in two levels

KINDS = ("assign", "access", "hex", "secret", "endpoint")  #: in the order in which spans with the same start are listed
SPAN = "array<struct<start:int,rank:int,stop:int>>"


def bound(value: Column, f) -> Column:
    """f(value), with value computed once: an expression that stands inside a lambda would be computed anew at each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def chunks(items: Column, size: int = CHUNK) -> Column:
    """An array cut into arrays of at most ``size``."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(items, k * size + 1, F.lit(size)))


def carried(values: Column, add) -> Column:
    """For each value what ``add`` makes of those before it, from 0; the last result follows as one more."""
    start = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("all"))
    step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(add(acc["at"], x))).alias("all"))
    return F.aggregate(values, start, step, lambda acc: acc["all"])


def matches(text: Column, pattern: str, rank: int) -> Column:
    """Spans (start, rank, stop) of all matches, leftmost and not overlapping, in code points."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.char_length(x))
    # a running sum over (gap, size) pairs; zip_with pads the last gap, which no match follows, with a null size
    pairs = F.zip_with(gaps, sizes, lambda g, s: F.struct(g.alias("gap"), s.alias("size")))
    after = lambda at, x: at + x["gap"] + F.coalesce(x["size"], F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + x["size"]).alias("stop"))
        return F.struct(after(acc["at"], x).alias("at"), F.when(x["size"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    def fold(items: Column, at: Column) -> Column:
        return F.aggregate(items, F.struct(at.alias("at"), F.array().cast(SPAN).alias("spans")), step, lambda acc: acc["spans"])

    def many(cut: Column) -> Column:
        firsts = carried(F.transform(cut, lambda c: F.aggregate(c, F.lit(0), after)), lambda at, x: at + x)
        return F.flatten(F.zip_with(cut, F.slice(firsts, F.lit(1), F.size(cut)), fold))

    spans = bound(pairs, lambda p: F.when(F.size(p) <= CHUNK, fold(p, F.lit(0))).otherwise(bound(chunks(p), many)))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def assign_spans(text: Column) -> Column:
    """Assignments whose value has 12 code points or more; shorter ones use up their text all the same."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    both = F.zip_with(matches(text, ASSIGN, 0), values, lambda s, v: F.struct(s.alias("span"), F.char_length(v).alias("n")))
    return F.when(text.rlike(ASSIGN), F.transform(F.filter(both, lambda x: x["n"] >= ASSIGN_LEAST), lambda x: x["span"])).otherwise(F.array().cast(SPAN))


def written(spans: Column) -> Column:
    """kind:start:end, in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Every row of docs with ``base`` and ``spans``, arrays of (start, rank, stop) sorted by start, then kind (see ``KINDS``).

    ``base`` has the base spans, ``spans`` also the linked parts: a secret-like string within ``scope`` code points of an
    access identifier, and an endpoint within ``scope`` of an identifier and of a secret (secret-like or assigned). Null and
    empty texts have none. Rows keep their columns; ids may be null or repeat, as parts are linked by text. An empty table
    gives an empty result. Columns named ``base``, ``spans`` or starting with ``_`` in docs are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.drop("base", "spans", "_weak", "_key", "_linked")
    base = F.array_sort(F.concat(assign_spans(text), matches(text, ACCESS, 1), matches(text, HEX, 2)))
    # without an access identifier nothing links: such texts, nearly all, never leave their partition
    plain = docs.where(~text.rlike(ACCESS)).withColumn("base", base).withColumn("spans", F.col("base"))
    named = docs.where(text.rlike(ACCESS)).withColumn("base", base).withColumn("_weak", F.concat(matches(text, SECRET, 3), matches(text, ENDPOINT, 4))).withColumn("_key", F.sha2(text, 256))
    parts = named.where(F.size("_weak") > 0).select("_key", F.explode(F.concat("base", "_weak")).alias("s")).distinct().select("_key", "s.*")
    linked = named.join(link_parts(parts, scope), "_key", "left")
    linked = linked.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("_linked", F.array().cast(SPAN)))))
    return plain.unionByName(linked.select(plain.columns))


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """parts: (_key, start, rank, stop). Returns (_key, _linked): the weak parts that have complementary parts within ``scope``."""
    before = Window.partitionBy("_key").orderBy("start", "rank", "stop").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_key").orderBy("start", "rank", "stop").rowsBetween(0, Window.unboundedFollowing)

    def near(test: Column) -> Column:  # the latest end before, or the first start after, is within the scope
        last, first = F.max(F.when(test, F.col("stop"))).over(before), F.min(F.when(test, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - last <= scope, F.lit(False)) | F.coalesce(first - F.col("stop") <= scope, F.lit(False))

    assigned = F.col("rank") == 0
    step = parts.withColumn("_access", near(F.col("rank") == 1))
    strong = assigned | ((F.col("rank") == 3) & F.col("_access"))
    step = step.withColumn("_secret", near(strong))
    kept = step.where(((F.col("rank") == 3) & F.col("_access")) | ((F.col("rank") == 4) & F.col("_access") & F.col("_secret")))
    return kept.groupBy("_key").agg(F.collect_list(F.struct("start", "rank", "stop")).alias("_linked"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex (long), base_sha256 and spans as text, for every row; see ``scan``."""
    found = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with every found span replaced by ``mark``; overlapping spans are replaced together. Rows and other columns stay."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("text"))  # so no column of docs can clash
    found = scan(rows)
    furthest = lambda at, s: F.greatest(at, s["stop"])

    def replaced(row: Column) -> Column:
        text = row["text"]

        def fold(spans: Column, at: Column) -> Column:  # the text from ``at`` to the furthest end of the spans, cut out once
            start = F.struct(at.alias("at"), F.lit("").alias("out"), F.substring(text, at + 1, F.aggregate(spans, at, furthest) - at).alias("part"))

            def step(acc: Column, s: Column) -> Column:
                fresh = F.concat(acc["out"], F.substring(acc["part"], acc["at"] - at + 1, s["start"] - acc["at"]), F.lit(mark))
                return F.struct(furthest(acc["at"], s).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(fresh).alias("out"), acc["part"].alias("part"))

            return F.aggregate(spans, start, step, lambda acc: acc["out"])

        def pieces(cut: Column) -> Column:
            firsts = carried(F.transform(cut, lambda c: F.array_max(F.transform(c, lambda s: s["stop"]))), lambda at, x: F.greatest(at, x))
            rest = lambda firsts: F.substring(text, F.element_at(firsts, -1) + 1, F.char_length(text))
            return bound(firsts, lambda f: F.concat(F.array_join(F.zip_with(cut, F.slice(f, F.lit(1), F.size(cut)), fold), ""), rest(f)))

        return bound(chunks(row["spans"]), pieces)

    cleaned = F.when(F.size("spans") > 0, bound(F.struct("text", "spans"), replaced)).otherwise(F.col("text"))
    return found.select(*[cleaned.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
