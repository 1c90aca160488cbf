import hashlib
import json

import pytest

from turnstone.operators import inference
from turnstone.sources import readers, writers


def test_paraphrases(spark, tmp_path):
    p = tmp_path / "test.csv"
    p.write_text(",dialogue_id,turn_index,target_utterance,direct_utterance,indirect_utterance,isacceptable_direct,isacceptable_indirect,quality\n0,A.json,2,\"a\nb\",c,\"d \"\"q\"\"\",True,False,ok\n")
    r = readers.read_paraphrases(spark, str(p), quality=True).first()
    assert (r.dialogue_id, r.turn_index, r.target_utterance, r.indirect_utterance, r.isacceptable_direct, r.isacceptable_indirect) == ("A.json", 2, "a\nb", 'd "q"', True, False)
    p.write_text(p.read_text().replace("True", "yes"))
    with pytest.raises(Exception, match="neither True nor False"):
        readers.read_paraphrases(spark, str(p), quality=True).collect()


def test_jsonl_skips_blank_lines_and_fails_on_damage(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text(json.dumps({"dialogue_id": "a", "goal_domains": [], "turns": [{"speaker": "user", "text": "x", "domains": []}, {"speaker": "system", "text": "y", "domains": ["taxi"]}]}) + "\n\n")
    rows = readers.read_dialogues(spark, str(p)).orderBy("turn").collect()
    assert [(r.turn, r.speaker, r.text) for r in rows] == [(0, "user", "x"), (1, "system", "y")]
    assert readers.unknown_fields(spark, str(p), ["dialogue_id", "turns"]).collect()[0].field == "goal_domains"
    p.write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.read_dialogues(spark, str(p)).collect()


def test_corpus_as_one_object(spark, tmp_path):
    p = tmp_path / "data.json"
    p.write_text(json.dumps({"A.json": {"goal": {}, "log": [{"text": "hi", "dialog_act": {}, "metadata": {}}]}, "B.json": {"goal": {}, "log": []}}))
    assert [r.dialogue_id for r in readers.read_corpus(spark, str(p), ["A.json"]).collect()] == ["A.json"]


def test_pinned_ids(spark, tmp_path):
    p = tmp_path / "ids.txt"
    p.write_text("a b\n c\n")
    h = hashlib.sha256(p.read_bytes()).hexdigest()
    assert {r.id for r in readers.read_pinned_ids(spark, str(p), h).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        readers.read_pinned_ids(spark, str(p), "0" * 64)


def test_cache_drops_a_torn_line_only(spark, tmp_path):
    p = tmp_path / "cache.jsonl"
    one = json.dumps({"key": "k", "raw": "r", "finish_reason": "stop"})
    p.write_text(one + "\n" + one[:10])
    assert [r.key for r in readers.read_cache(spark, str(p)).collect()] == ["k"]
    p.write_text(one + "\n" + one.replace('"r"', '"q"') + "\n")
    with pytest.raises(ValueError, match="conflicting"):
        readers.read_cache(spark, str(p))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "id int, v string")
    writers.write_jsonl(df, str(tmp_path / "o"), ["id"])
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ['{"id":1,"v":null}', '{"id":2,"v":"b"}']
    assert writers.append_new(df, str(tmp_path / "t"), "id") == 2
    assert writers.append_new(df, str(tmp_path / "t"), "id") == 0


def test_inference_asks_each_input_once(spark, tmp_path):
    asked = str(tmp_path / "cache")
    df = spark.createDataFrame([("k1", "p1"), ("k1", "p1"), ("k2", "p2")], "key string, prompt string")
    first = {(r.key, r.raw) for r in inference.ask(df, asked).collect()}
    assert len(first) == 2 and spark.read.parquet(asked).count() == 2
    assert {(r.key, r.raw) for r in inference.ask(df, asked).collect()} == first and spark.read.parquet(asked).count() == 2


def test_stream_of_results(spark, tmp_path):
    from turnstone.streaming import results

    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"item_id":"a","condition":"full","gold":1,"pred":1,"at":"2024-01-01T00:00:00Z"}\n{"item_id":"b","condition":"full","gold":1,"pred":0,"at":"2024-01-01T00:10:00Z"}\n')
    q = results.running_scores(results.read_log(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.condition, r.n, r.accuracy) for r in spark.table("scores").collect()] == [("full", 2, 0.5)]
