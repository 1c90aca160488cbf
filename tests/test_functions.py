import json

from turnstone.functions import answers, levels, mentions
from turnstone.operators import bootstrap


def test_clock_readings():
    found = mentions.mentions("Leave at 18:30, or 18;45, or 13.00", [], [])["time"]
    assert found == [["18:30"], ["18:45"], ["13:00"]]
    assert mentions.mentions("at 6:30pm or 7 p.m. or 9 am or 12 am", [], [])["time"] == [["18:30"], ["19:00"], ["09:00"], ["00:00"]]
    assert mentions.readings("5", "15", None) == ["05:15", "17:15"] and mentions.readings("05", "15", None) == ["05:15"] and mentions.readings("24", "00", None) == ["00:00"]
    assert mentions.readings("5", None, None) == mentions.readings("25", "00", None) == mentions.readings("13", "00", "p") == mentions.readings("5", "60", None) == []
    assert mentions.mentions("it costs £3.50 for 4 people")["time"] == []


def test_leftmost_longest_name():
    found = mentions.mentions("The old mill inns and a mill, then mill road", ["mill", "old mill inn", "mill road north"], ["thai"])
    assert found["place"] == [["old mill inn"], ["mill"], ["mill"]]
    assert mentions.mentions("go to the missing sock b & b or saint john's chop house", ["the missing sock b & b", "saint john's chop house"])["place"] == [["missing sock b & b"], ["saint john's chop house"]]
    found = mentions.mentions("north american or english food in the northern part, cheaply or pricey", [], ["north american"])
    assert (found["food"], found["area"], found["price"]) == ([["north american"], ["british"]], [["north"]], [["expensive"]])


def test_guards_and_coordination():
    find = lambda text, slot: [m[0] for m in mentions.mentions(text)[slot]]
    assert find("not monday, but tuesday", "day") == ["tuesday"] and find("I don’t want cheap or moderate", "price") == []
    assert find("anywhere other than north, east, west", "area") == [] and find("no cheap ones. expensive", "price") == ["expensive"]
    assert find("after monday or tuesday", "day") == [] and find("after monday the hotel on tuesday", "day") == []
    assert find("coming from the north", "area") == [] and find("far from it, north", "area") == ["north"]
    assert find("not one two three four five six monday", "day") == ["monday"] and find("too cheap and nice, moderate", "price") == ["moderate"]
    assert find("never at 18:30 or 19:00; at 20:00", "time") == ["20:00"]


def test_drift(spark):
    from pyspark.sql import functions as F

    rows = [("day", "on monday", "on monday"), ("day", "on monday", "on tuesday"), ("day", "on monday", "soon"), ("day", "soon", "on monday"), ("day", "monday or friday", "friday"), ("time", "at 5:15", "at 17:15"), ("food", "asian food", "asian oriental food"), ("place", "the mill", "mill road"), ("area", "north", "north or south")]
    df = spark.createDataFrame(rows, "slot string, a string, b string").select("slot", *[mentions.extract(F.col(c), ["the mill", "mill road"], ["asian", "asian oriental"]).alias(c) for c in "ab"])
    out = F.lit(None).cast("string")
    for slot in mentions.SLOTS:
        out = F.when(F.col("slot") == slot, mentions.drift(F.col("a"), F.col("b"), slot)).otherwise(out)
    assert [r[0] for r in df.select(out).collect()] == ["kept", "substituted", "dropped", None, "dropped", "kept", "kept", "kept", "kept"]


UTTERANCES = [
    ("I need a train to Ely", "L0", "want_statement", "L0"), ("Yes, please book it", "L0", "command", "L0"), ("I'd like a cheap room", "L0", "would_like", "L0"), ("We’re looking for a pub", "L0", "looking_for", "L0"),
    ("Great. What is the phone number", "L0", "wh_question", "L0"), ("Is there a pool?", "L0", "yes_no_question", "L0"), ("Can you get me a taxi", "L1", "you_formula", "L1"), ("May I have the address", "L1", "i_formula", "L1"),
    ("how about thai", "L1", "how_about", "L1"), ("What about the north?", "L0", "wh_question", "L1"), ("I don't need that", "NR", "decline", "NR"), ("No thanks", "NR", "decline", "NR"), ("It doesn't matter", "INF", "no_preference", "INF"),
    ("yes, sure", "INF", "bare_answer", "INF"), ("thai, in there", "INF", "fragment", "INF"), ("The trip is on friday", "L2", "slot_value", "L2"), ("there are six people", "L2", "party_or_stay", "L2"), ("my day is over at noon", "L2", "clock_word", "L2"),
    ("a museum would be lovely", "L2", "service_word", "L2"), ("It is cold", "L3", "no_detail", "L3"), ("the venue is nice", "L3", "no_detail", "L2"), ("We are off to Ely", "L3", "no_detail", "L2"), ("Thanks, that is all I need for today. Bye!", "L0", "want_statement", "NR"),
    ("That works for me. Thanks!", "L3", "no_detail", "INF"), ("where i am it is cold", "L3", "no_detail", "L3"), ("the trip is never on friday", "L3", "no_detail", "L3"),
]


def test_levels(spark):
    df = spark.createDataFrame([(i, u[0], False) for i, u in enumerate(UTTERANCES)] + [(98, "book it", True), (99, None, False)], "i int, text string, social boolean")
    got = {r.i: r for r in levels.leveled(df, "text", "social", versions=("auto-v1", "auto-v2")).collect()}
    for i, (text, one, rule, two) in enumerate(UTTERANCES):
        assert (got[i].auto_v1.level, got[i].auto_v1.rule, got[i].auto_v2.level) == (one, rule, two), text
    assert tuple(got[98].auto_v1) == ("NR", "social_acts") and tuple(got[99].auto_v2) == (None, None)


GOOD = {"route": "request", "category": "booking", "slots": [{"slot": "hotel.stay", "value": "2"}], "requested_slots": ["hotel.area"]}
KEYS = ["hotel.stay", "hotel.area"]


def test_answers():
    def reason(change=None, raw=None, finish="stop"):
        return answers.read(raw if raw is not None else json.dumps(GOOD | (change or {})), finish, KEYS).get("invalid_reason")

    assert reason() is None
    assert reason(finish="refusal") == "refusal"
    assert reason(finish="length") == "truncated"
    assert reason(raw=" ") == "empty"
    assert reason(raw="x" * 8193) == "too_long"
    assert reason(raw='{"a": 1, "a": 2}') == "parse"
    assert reason(raw="[" * 40 + "]" * 40) == "parse"
    assert reason(raw='{"a": NaN}') == "parse"
    assert reason({"more": 1}) == "schema"
    assert reason({"category": "other"}) == "category"
    assert reason({"slots": [{"slot": "x.y", "value": ""}]}) == "slot_key"
    assert reason({"slots": GOOD["slots"] * 2}) == "slot_duplicate"
    assert reason({"slots": [{"slot": "hotel.stay", "value": "v" * 101}]}) == "too_long"


def test_answers_over_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(json.dumps(GOOD), "stop"), ("", "stop"), (None, None)], "raw string, f string")
    got = df.select(answers.parsed(F.col("raw"), F.col("f"), KEYS).alias("a")).select("a.*").collect()
    assert [r.invalid_reason for r in got] == [None, "empty", "empty"]
    assert got[0].slots == {"hotel.stay": "2"}


def test_mentions_over_a_column(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("thai food in the north",), (None,)], "t string")
    got = [r.m for r in df.select(mentions.extract(F.col("t"), [], ["thai"]).alias("m")).collect()]
    assert got[0]["food"] == [["thai"]] and got[0]["area"] == [["north"]] and got[1]["food"] == []


def test_undefined_replicates_are_excluded(spark):
    v = spark.createDataFrame([("s", 0, 0.5), ("s", 1, None), ("s", 2, -0.5), ("t", 0, None)], "stat string, replicate int, value double")
    got = {r.stat: r for r in bootstrap.summary(v, ["stat"], most_excluded=0.5).collect()}
    assert (got["s"].replicates, got["s"].excluded, got["s"].p, got["s"].unstable) == (2, 1, 1.0, False)
    assert got["t"].unstable and got["t"].p is None and got["t"].low is None


def test_blocked_replicates_equal_joined_ones(spark):
    rows = [(f"s{s}", d, float((s * d) % 3), float(d % 4)) for s in range(3) for d in range(10, 30) if (s + d) % 5]
    stats = spark.createDataFrame(rows, "stat string, dialogue long, num double, den double")
    key = lambda df: sorted((r.stat, r.replicate, None if r.value is None else round(r.value, 9)) for r in df.collect())
    joined = bootstrap.replicates(stats, bootstrap.weights(stats, "dialogue", 30, 5), ["stat"], "dialogue")
    assert key(bootstrap.replicates_blocked(stats, "stat", "dialogue", 30, 5)) == key(joined)
