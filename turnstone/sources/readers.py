"""Readers with declared schemas. Nothing is inferred; a damaged file fails, and what a reader can't refuse is listed by an expectation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAPHRASES = "_c0 INT, dialogue_id STRING, turn_index INT, target_utterance STRING, direct_utterance STRING, indirect_utterance STRING"
QUALITY = ", isacceptable_direct STRING, isacceptable_indirect STRING, quality STRING"
ITEM = (
    "item_id STRING, dialogue_id STRING, turn_index INT, split STRING, source STRUCT<file: STRING, row: INT>, join_match STRING, target_utterance STRING, direct_utterance STRING, indirect_utterance STRING, "
    "turn_domains ARRAY<STRING>, active_domains ARRAY<STRING>, dialogue_domains ARRAY<STRING>, user_acts MAP<STRING, ARRAY<ARRAY<STRING>>>, "
    "quality_labels STRUCT<isacceptable_direct: BOOLEAN, isacceptable_indirect: BOOLEAN, quality: STRING>, mismatch STRUCT<donor_dialogue_id: STRING, start: INT, length: INT>, mismatch_status STRING"
)
DIALOGUE = "dialogue_id STRING, goal_domains ARRAY<STRING>, turns ARRAY<STRUCT<speaker: STRING, text: STRING, domains: ARRAY<STRING>>>"
LABEL = "item_id STRING, dialogue_id STRING, turn_index INT, variant STRING, label_initial STRING, label_final STRING, fragment STRING, annotator STRING, rubric_version STRING"
REGISTRY = "dialogue_id STRING, source STRING, reason STRING, inspector STRING, inspected_on STRING, phase STRING, registry_version STRING"
ANSWER = "route STRING, category STRING, slots ARRAY<STRUCT<slot: STRING, value: STRING>>, requested_slots ARRAY<STRING>"
TAXONOMY = "taxonomy_version STRING, intent_id STRING, stratum STRING, required_slots STRING, optional_slots STRING, description STRING"
CORPUS = "map<string, struct<goal: map<string, string>, log: array<struct<text: string, dialog_act: map<string, array<array<string>>>, metadata: map<string, struct<semi: map<string, string>, book: map<string, string>>>>>>>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header must match the schema; quotes may span lines; a byte-order mark is dropped; damage fails."""
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False, multiLine=True, escape='"', encoding="UTF-8").csv(path)


def read_paraphrases(spark: SparkSession, path: str, quality: bool = False) -> DataFrame:
    """Paraphrase rows; the first, unnamed column is the row number. Acceptance flags become booleans, other text than True or False fails."""
    schema = PARAPHRASES + (QUALITY if quality else "")
    rows = spark.read.schema(schema).options(header=True, mode="FAILFAST", multiLine=True, escape='"').csv(path)
    if not quality:
        return rows
    flag = lambda c: F.when(F.col(c) == "True", True).when(F.col(c) == "False", False).otherwise(F.raise_error(F.concat(F.lit(f"{c} is neither True nor False: "), F.coalesce(c, F.lit("null")))))
    return rows.withColumns({c: flag(c).cast("boolean") for c in ("isacceptable_direct", "isacceptable_indirect")})


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def unknown_fields(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """(field, n): fields of a JSON lines file that its schema lacks; a reader drops them silently."""
    keys = spark.read.text(path).where(F.trim("value") != "").select(F.explode(F.json_object_keys("value")).alias("field"))
    return keys.where(~F.col("field").isin(*known)).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, ITEM)


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """(dialogue_id, turn, speaker, text, domains): one row a turn."""
    d = read_jsonl(spark, path, DIALOGUE)
    return d.select("dialogue_id", F.posexplode("turns").alias("turn", "t")).select("dialogue_id", "turn", "t.*")


def read_corpus(spark: SparkSession, path: str, keep: list[str] | None = None) -> DataFrame:
    """One object keyed by dialogue: (dialogue_id, dialogue). The file is parsed with a map schema, so dialogues don't become columns."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", CORPUS).alias("m"))
    if keep is not None:
        whole = whole.select(F.map_filter("m", lambda k, _: k.isin(*keep)).alias("m"))
    return whole.select(F.explode("m").alias("dialogue_id", "dialogue"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("id")).where("id <> ''").distinct()


def read_pinned_ids(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """An id list whose bytes must have the digest."""
    found = [r["h"] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).collect()]  # one file, one row
    if found != [sha256]:
        raise ValueError(f"{path} has digest {found}, not {sha256}")
    return read_id_list(spark, path)


def read_labels(spark: SparkSession, path: str, annotator: str = "A1") -> DataFrame:
    """Label rows of one annotator, all rounds; the round is taken from the file's name."""
    rows = read_csv(spark, path, LABEL).withColumn("round", F.regexp_extract(F.input_file_name(), r"levels_([^/.]+)\.csv", 1))
    return rows.where(F.col("annotator") == annotator)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    names = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != "").alias(c)
    t = read_csv(spark, path, TAXONOMY)
    return t.select("taxonomy_version", "intent_id", "stratum", names("required_slots"), names("optional_slots"), "description")


def read_edition(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A whole text as one row, line ends untouched, its bytes checked."""
    f = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h"), F.decode("content", "UTF-8").alias("text"))
    return f.select(F.when(F.col("h") == sha256, F.col("text")).otherwise(F.raise_error(F.lit("the edition's digest differs"))).alias("text"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a response log (key, raw, finish_reason). A torn last line is dropped, other damage fails, so does a key with two contents."""
    schema = "key STRING, raw STRING, finish_reason STRING"
    lines = spark.read.option("lineSep", "\x00").text(path, wholetext=True)  # one log file a row; split keeps the unterminated rest apart
    parts = lines.select(F.split("value", "\n").alias("l")).select(F.explode(F.slice("l", 1, F.size("l") - 1)).alias("line")).where("line <> ''")
    parsed = parts.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*").distinct()
    twice = parsed.groupBy("key").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("a key has conflicting contents")
    return parsed
