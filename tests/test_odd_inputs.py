"""Queries on small tables of odd rows, compared with their SQL."""

import duckdb
import pytest

from tests.oracle import duck_rows, spark_rows
from turnstone import registry

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def compared(spark, folder, name, **tables):
    """The rows of the SQL on the tables alone, which the query must give."""
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).toPandas().to_parquet(f"{folder}/{table}.parquet")
    con = connect_to(folder, tables)
    mine, theirs = spark_rows(registry.queries()[name](spark, str(folder))), duck_rows(con, registry.oracles()[name])
    assert mine == theirs
    return theirs[1]


def connect_to(folder, tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def test_speech_verb_between_other_letters(spark, tmp_path):
    texts = ["éles ", "THE", "Unde und", "leſ x", "leſx", "LEſé", "naïthe", "the_", "lesé", "9the", "", None, "x\nles\n", "ünd undü"]
    rows = [(k, x, "en", "s", len(x or "")) for k, x in enumerate(texts)]
    assert (0, True) in compared(spark, tmp_path, "F33_speech_verb", documents=(rows, DOCUMENTS))


#: Turns from 100 on, whose ids the SQL cuts to two digits, and first words that are facts: after a denial, beside other letters, in odd cases.
WORDS = ("East", "Friday é", "mondayé x", "_north", "Été cheap", "FRİDAY", "Wests a", "english", "“south”", "north", "cheap's", "moderately", "")
LONG = [(c, t, "user" if t % 2 == 0 else "assistant", WORDS[(c + t // 2) % len(WORDS)]) for c in (2, 4, 7, 8654, 10768) for t in (*range(8), *range(10, 20, 3), *range(100, 131), 398)]


@pytest.mark.parametrize("name", ["F19_slot_mentions", "A09_drift_counts", "F25_item_audit", "S28_drift_flags"])
def test_facts_of_long_dialogues(spark, tmp_path, name):
    assert compared(spark, tmp_path, name, conversations=(LONG + LONG[:3], TURNS))
