"""Context windows of a target turn: slices, the word budget, donors of unrelated context, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from turnstone.functions.text import tagged_line

BUDGET = 350  #: words of context and target together, speaker tags included (fixed value)


def _rows(last: int) -> WindowSpec:
    """A dialogue's rows from its first to the one ``last`` away from the current."""
    return Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, last)


def cumulative_mask(turns: DataFrame) -> DataFrame:
    """turns with mask, the domain bits of the dialogue up to and with the turn."""
    return turns.withColumn("mask", F.bit_or("bit").over(_rows(0)))


def active_masks(turns: DataFrame) -> DataFrame:
    """turns with active: the mask after turn min(t + 2, n), so with the target and the reply that follows it."""
    return turns.withColumn("active", F.bit_or("bit").over(_rows(1)))


def slices(turns: DataFrame) -> DataFrame:
    """User turns with none (empty), one (the previous turn) and full (all previous turns), as arrays of lines, oldest first."""
    line = tagged_line(F.col("role"), F.col("text"))
    w = turns.withColumn("full", F.collect_list(line).over(_rows(-1)))
    w = w.where("role = 'user'").withColumns({"none": F.array().cast("array<string>"), "one": F.when(F.size("full") > 0, F.slice("full", -1, 1)).otherwise(F.array().cast("array<string>"))})
    return w.select("conv_id", "turn", "none", "one", "full")


def budgeted(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """User turns with the full context under the budget: (conv_id, turn, kept, dropped, context_words).

    Whole oldest turns go while context and target exceed the budget; equal fits. One pass over running sums of words decides
    how many go: turn j of the context stays if the words from j on fit. No pairs of turns are made beyond a dialogue's own.
    """
    sized = turns.withColumn("size", F.col("words") + 1)
    own = sized.withColumn("upto", F.coalesce(F.sum("size").over(_rows(-1)), F.lit(0)))
    # the running sums before each earlier turn, in order: words from turn j on are upto - sums[j]
    own = own.withColumn("sums", F.collect_list("upto").over(_rows(-1)))
    room = F.lit(budget) - F.col("words")
    kept = F.size(F.filter("sums", lambda s: F.col("upto") - s <= room))
    out = own.where("role = 'user'").withColumn("kept", kept.cast("long"))
    start = F.element_at("sums", (F.size("sums") - F.col("kept") + 1).cast("int"))
    words = F.when(F.col("kept") > 0, F.col("upto") - start).otherwise(0).cast("long")
    return out.select("conv_id", "turn", "kept", (F.size("sums") - F.col("kept")).cast("long").alias("dropped"), words.alias("context_words"))


def rendered(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(conv_id, turn, target, context): tagged lines of the budgeted full context joined by line feeds."""
    b = budgeted(turns, budget)
    s = slices(turns).select("conv_id", "turn", "full").join(b, ["conv_id", "turn"]).join(turns.select("conv_id", "turn", F.col("text").alias("target")), ["conv_id", "turn"])
    shown = F.when(F.col("kept") > 0, F.slice("full", -F.col("kept").cast("int"), F.greatest(F.col("kept"), F.lit(1)).cast("int"))).otherwise(F.array().cast("array<string>"))
    return s.select("conv_id", "turn", "target", F.array_join(shown, "\n").alias("context"))


def numbered(prefixes: DataFrame) -> DataFrame:
    """prefixes: (split, t, mask, donor), with rank: the donor's number, from 0, within its class (split, t, mask).

    A class is numbered by parts of three digits of the donors' md5: the parts' sizes are summed first, then each part is
    numbered by itself, so no task orders a whole class.
    """
    cls = ["split", "t", "mask"]
    parts = prefixes.withColumn("part", F.substring(F.md5(F.col("donor").cast("string")), 1, 3))
    before = Window.partitionBy(*cls).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.groupBy(*cls, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(*cls, "part").orderBy("donor")) - 1
    return parts.withColumn("within", within).join(first, [*cls, "part"]).select(*cls, "donor", (F.col("first") + F.col("within")).alias("rank"))


def donors(turns: DataFrame, seed: int = 7) -> DataFrame:
    """Each item with prior context and its donor: (conv_id, turn, donor, n_candidates, status).

    A donor is another dialogue of the same split with at least t turns whose first t turns share no domain with the target's
    active domains. Candidates are never paired with targets: dialogues are counted by class (split, t, mask), of which there
    are few; a target draws a number below the number of its candidates, by the md5 of seed and item; the classes' running
    counts turn it into a class and a rank, and one equi-join on those finds the donor.
    """
    cls = ["split", "t", "mask"]
    prefixes = numbered(cumulative_mask(turns).select("split", (F.col("turn") + 1).alias("t"), "mask", F.col("conv_id").alias("donor")))
    targets = active_masks(turns).where("role = 'user' AND turn > 0").select("conv_id", "turn", "split", F.col("turn").alias("t"), "active")
    sizes = prefixes.groupBy(*cls).agg(F.count(F.lit(1)).alias("n"))
    kinds = targets.select("split", "t", "active").distinct().join(sizes, ["split", "t"]).where("mask & active = 0")
    # at most as many classes as there are masks in one list, with the number of candidates before each
    kinds = kinds.groupBy("split", "t", "active").agg(F.array_sort(F.collect_list(F.struct("mask", "n"))).alias("classes"))
    step = lambda acc, x: F.struct((acc["n"] + x["n"]).alias("n"), F.concat(acc["at"], F.array(F.struct(x["mask"].alias("mask"), acc["n"].alias("first")))).alias("at"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<mask:int,first:bigint>>").alias("at"))
    kinds = kinds.select("split", "t", "active", F.aggregate("classes", start, step).alias("k")).select("split", "t", "active", "k.*")
    # the target's own dialogue, if its class is among the candidates', is stepped over
    own = prefixes.select(F.col("donor").alias("conv_id"), "t", F.col("mask").alias("own_mask"), F.col("rank").alias("own_rank"))
    found = targets.join(kinds, ["split", "t", "active"], "left").join(own, ["conv_id", "t"], "left")
    at = lambda mask: F.try_element_at(F.filter("at", lambda x: x["mask"] == mask), F.lit(1))["first"]
    found = found.withColumn("own", F.when(F.col("own_mask").bitwiseAND(F.col("active")) == 0, at(F.col("own_mask")) + F.col("own_rank")))
    found = found.withColumn("n_candidates", F.coalesce("n", F.lit(0)) - F.col("own").isNotNull().cast("long"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "conv_id", "turn")), 1, 8), 16, 10).cast("long") % F.nullif("n_candidates", F.lit(0))
    found = found.withColumn("draw", draw).withColumn("draw", F.col("draw") + F.coalesce((F.col("draw") >= F.col("own")).cast("long"), F.lit(0)))
    found = found.withColumn("class", F.try_element_at(F.filter("at", lambda x: x["first"] <= F.col("draw")), F.lit(-1)))
    found = found.select("conv_id", "turn", "split", "t", "n_candidates", F.col("class.mask").alias("mask"), (F.col("draw") - F.col("class.first")).alias("rank"))
    out = found.join(prefixes, [*cls, "rank"], "left")
    return out.select("conv_id", "turn", "donor", "n_candidates", F.when(F.col("donor").isNull(), "unavailable").otherwise("ok").alias("status"))


def mismatched(turns: DataFrame, seed: int = 7) -> DataFrame:
    """(conv_id, turn, donor, mismatched, mismatched_one): the donor's first t turns as lines, and the last of them; null without a donor."""
    line = tagged_line(F.col("role"), F.col("text"))
    shown = turns.select(F.col("conv_id").alias("from"), F.col("turn").alias("at"), line.alias("line"))
    d = donors(turns, seed).select("conv_id", "turn", "donor")
    lines = d.join(shown, (F.col("donor") == F.col("from")) & (F.col("at") < F.col("turn")), "left")
    lines = lines.groupBy("conv_id", "turn").agg(F.first("donor").alias("donor"), F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("at", "line")))).alias("s"))
    return lines.select("conv_id", "turn", "donor", F.when(F.col("donor").isNotNull(), F.transform("s", lambda x: x["line"])).alias("mismatched")).withColumn("mismatched_one", F.try_element_at("mismatched", F.lit(-1)))


def input_hash(context, target):
    """Digest of what a model is shown; a separator that neither part can hold keeps the two apart."""
    return F.sha2(F.concat(context, F.lit("\x1f"), target), 256)


def neighbours(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, previous, following): the text before and after each turn, null at a dialogue's ends."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", F.lag("text").over(w).alias("previous"), F.lead("text").over(w).alias("following"))
