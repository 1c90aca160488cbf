import pytest

from turnstone.functions import literary
from turnstone.operators import passes

FABLES = "*** START OF X ***\r\n\r\nTHE FOX'S DEN\r\n\r\nA fox ran.\r\nIt hid.\r\n\r\n  Hide well.\r\n\r\n\r\n\r\nTHE CROW\r\n\r\n\"I see,\" said the crow, \"a cheese.\" It ate. \"No.\"\r\n*** END OF X ***\r\n"


def test_fables():
    text = "\r\n\r\n\r\n" + FABLES.replace("*** START OF X ***\r\n", "*** START OF X ***\r\n\r\n\r\n\r\n")
    got = [(u[1], u[3], text[u[4] : u[5]]) for u in literary.fables("s", text)]
    assert got[0] == ("aesop:the-foxs-den:title", "title", "THE FOX'S DEN")
    assert [(k, t) for _, k, t in got[1:4]] == [("narrative", "A fox ran.\r\nIt hid."), ("moral", "Hide well."), ("title", "THE CROW")]


def test_verses_must_follow_one_another():
    text = "Heading\n1:1 In the start. 1:2 And then\nmore.\n***\nother\n2:1 Next."
    assert [(u[1], text[u[4] : u[5]]) for u in literary.verses("s", text, "Book One")] == [("kjv:book-one:1:1", "In the start."), ("kjv:book-one:1:2", "And then\nmore."), ("kjv:book-one:2:1", "Next.")]
    with pytest.raises(ValueError, match="out of order"):
        literary.verses("s", "1:1 a 1:3 b", "B")


def test_interrupted_quotations_merge():
    t = '"I see," said the crow, "a cheese." It ate. "No."'
    assert [t[a:b] for a, b in literary.quotations(t)] == ['"I see," said the crow, "a cheese."', '"No."']


def test_units_over_editions(spark):
    df = spark.createDataFrame([("s", "1:1 a 1:2 b", "B")], "source string, text string, book string")
    assert [r.kind for r in literary.units(df, "verses").collect()] == ["verse", "verse"]


def test_corrections_and_gaps(spark):
    rows = spark.createDataFrame([("a", "superseded"), ("a", ""), ("b", "superseded")], "item_id string, status string")
    log = spark.createDataFrame([("a",), ("c",)], "item_id string")
    assert {(r.item_id, r.superseded, r.logged) for r in passes.unlogged_corrections(rows, log, ["item_id"]).collect()} == {("b", 1, 0), ("c", 0, 1)}
    tax = spark.createDataFrame([("i", ["x"], ["y"])], "intent_id string, required_slots array<string>, optional_slots array<string>")
    lab = spark.createDataFrame([("1", "i", ["x"]), ("2", "i", ["y", "z"]), ("3", "j", [])], "item_id string, intent_id string, slots array<string>")
    got = {r.item_id: (r.unknown_intent, r.missing, r.undefined) for r in passes.slot_gaps(lab, tax).collect()}
    assert got["2"] == (False, ["x"], ["z"]) and got["3"][0] and "1" not in got


def test_eligible_needs_all_earlier_passes(spark):
    e = spark.createDataFrame([("a", "form"), ("b", "form"), ("b", "context"), ("c", "context")], "k string, pass string")
    assert [r.k for r in passes.eligible(e, "context", ["k"]).collect()] == ["a"]
    assert [r.k for r in passes.eligible(e, "reveal", ["k"]).collect()] == ["b"]
