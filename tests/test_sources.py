"""Benchmark readers, service, hooks and streams on small inputs."""

import html
import json
import re
import string

import pytest
from pyspark.sql import functions as F

from lorekeep import plans
from lorekeep.functions.hooks import embedding, extracted
from lorekeep.operators.service import Refused, Service
from lorekeep.sources import dialogues, packages, shards
from lorekeep.streaming import events as S


def test_sessions(spark, tmp_path):
    sample = {
        "conversation": {"session_2": [{"dia_id": "D2:1", "speaker": "B", "text": "later"}], "session_1": [{"dia_id": "D1:1", "speaker": "A", "text": " hi ", "blip_caption": "a cat", "query": "cat"}, {"speaker": "A", "text": "", "blip_caption": "dog"}], "session_1_date_time": "1:30 pm on 7 May, 2023", "speaker_a": "A"},
        "qa": [{"question": "q?", "answer": 2022, "category": 2, "evidence": ["D1:1; D2:1"]}, {"question": "x", "adversarial_answer": "no", "category": 5}],
    }
    (tmp_path / "d.json").write_text(json.dumps([sample]))
    turns, qa = dialogues.sessions(spark, str(tmp_path / "d.json"))
    rows = turns.orderBy("turn_pos").collect()
    assert [r.turn_id for r in rows] == ["D1:1", "session_1:1", "D2:1"]
    assert rows[0].text == "hi [Sharing image - query: cat. The image shows: a cat]" and rows[1].text == "[Sharing image that shows: dog]"
    assert rows[0].occurred_at.hour == 13 and rows[2].occurred_at is None
    asked = qa.orderBy("qa_id").collect()
    assert asked[0].gold_answers == ["2022"] and asked[0].gold_turn_ids == ["D1:1", "D2:1"] and asked[0].category == "temporal"
    assert asked[1].abstention and asked[1].gold_answers == [dialogues.UNANSWERABLE]


def test_histories(spark, tmp_path):
    item = {
        "question_id": "q1_abs", "question_type": "multi-session", "question": "?", "answer": "a", "question_date": "2023/05/30 (Tue) 23:40",
        "haystack_sessions": [[{"role": "user", "content": "x", "has_answer": True}, {"role": "assistant", "content": " "}], [{"role": "user", "content": "y"}]], "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["2023/05/20 (Sat) 02:21", "2023/05/21 (Sun) 10:00"], "answer_session_ids": ["s1", "s2"],
    }
    (tmp_path / "h.json").write_text(json.dumps([item, item | {"question_id": "q2"}]))
    turns, qa = dialogues.histories(spark, str(tmp_path / "h.json"), ["q1_abs"])
    assert [r.turn_id for r in turns.orderBy("turn_pos").collect()] == ["s1:0", "s2:0"]
    q = qa.first()
    assert q.abstention and q.category == "multi_session" and q.gold_turn_ids == ["s1:0", "s2:0"] and q.question_date.hour == 23


def test_long_documents(spark, tmp_path):
    (tmp_path / "qasper.jsonl").write_text(json.dumps({"input": "q", "context": "a\n\nb", "answers": ["x"]}) + "\n")
    turns, qa = dialogues.long_documents(spark, str(tmp_path))
    assert [r.turn_id for r in turns.orderBy("turn_pos").collect()] == ["qasper:0:c0", "qasper:0:c1"]
    assert qa.first().gold_answers == ["x"] and qa.first().category == "qasper"


def test_stepwise(spark, tmp_path):
    flat = {"tid": 0, "message_list": [{"mid": 0, "message": " hello ", "time": "'2024-10-01 08:00' Tuesday"}], "QA": {"qid": 1, "question": "q", "answer": "red", "choices": {"A": "red", "B": ["x", "y"]}, "ground_truth": "A", "target_step_id": [0]}}
    nested = {"tid": 1, "message_list": [[{"mid": 5, "user": "u", "assistant": "a"}]], "QA": {"qid": 2, "question": "q", "answer": "x", "choices": {"A": "red", "B": ["x", "y"]}, "ground_truth": "B", "target_step_id": [[5, 0]]}}
    (tmp_path / "simple.json").write_text(json.dumps({"roles": [flat, nested]}))
    turns, qa = dialogues.stepwise(spark, str(tmp_path))
    rows = turns.orderBy("conversation_id").collect()
    assert [(r.turn_id, r.speaker, r.text) for r in rows] == [("0", "user", "hello"), ("5", "dialogue", "User: u\nAssistant: a")]
    asked = qa.orderBy("conversation_id").collect()
    assert asked[0].gold_answers == ["A. red", "red", "A"] and asked[1].gold_answers == ["B. x; y", "x; y", "x", "B"]
    assert asked[1].gold_turn_ids == ["5"] and "B. x; y" in asked[0].question


def test_shards(spark, tmp_path):
    import pyarrow as pa

    for name, values in (("a.arrow", [0, 1]), ("b.arrow", [1, -2])):
        table = pa.table({"test_idx": values})
        with pa.OSFile(str(tmp_path / name), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
    assert shards.digests(spark, str(tmp_path)).count() == 2
    found = shards.problems(shards.indices(spark, str(tmp_path)))
    assert {tuple(r) for r in found.collect()} == {(1, "repeated"), (-2, "negative")}


def test_service(spark):
    service = Service(spark)
    add = {"request_id": "r", "user_id": "u", "session_id": "s", "messages": [{"role": "user", "content": "I adopted a <cat>", "timestamp": 0}, {"role": "user", "content": "budget talk"}]}
    assert service.add(add) == {"written": 2} and service.add(add) == {"written": 0}
    with pytest.raises(Refused) as e:
        service.add(add | {"session_id": "other"})
    assert e.value.status == 409
    with pytest.raises(Refused):
        service.add(add | {"messages": [{"role": "user", "content": " "}]})
    assert service.search({"user_id": "u", "query": "adopted", "top_k": 1}) == ["[1970-01-01T00:00:00+00:00] I adopted a <cat>"]
    assert service.search({"user_id": "someone", "query": "adopted"}) == []
    assert "&lt;cat&gt;" in service.prompt({"user_id": "u", "query": "adopted", "top_k": 1})


def test_hooks(spark):
    def make():  # by value: the workers don't import tests
        class Length:
            dimensions = 1

            def embed(self, texts):
                return [[float(len(t))] for t in texts]

        return Length()

    rows = spark.createDataFrame([("abc",), ("",), (None,), ("a",)], "t string").coalesce(1)
    assert [r.v for r in rows.select(embedding(make)(F.col("t")).alias("v")).collect()] == [[3.0], None, None, [1.0]]
    assert [r.degraded for r in extracted(rows, "t", None).collect()] == [True] * 4
    found = extracted(rows, "t", lambda t: [{"summary": t}, {"summary": t + "!"}] if t else []).collect()
    assert [r.summary for r in found] == ["abc", "abc!", "a", "a!"]


@pytest.mark.parametrize("of", [S.arrivals, S.sessions], ids=["arrivals", "sessions"])
def test_stream_equals_batch(spark, data, of, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    query = of(S.event_stream(spark, data)).writeStream.outputMode("complete" if of is S.arrivals else "append").format("memory").queryName(f"out_{of.__name__}").option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    found = {tuple(r) for r in spark.table(f"out_{of.__name__}").collect()}
    expected = {tuple(r) for r in of(batch).collect()}
    assert found == expected if of is S.arrivals else found <= expected


def test_hit_counters(spark, data, tmp_path):
    query = S.hit_counters(S.event_stream(spark, data)).writeStream.outputMode("update").format("memory").queryName("out_hits").option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("out_hits").agg(F.sum("hits")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_packages(spark, tmp_path):
    import zipfile

    expected = spark.range(3).selectExpr("id AS index")
    answers = expected.selectExpr("index", "concat('a', index) AS answer")
    assert packages.package(expected, answers, str(tmp_path / "p.zip")) == 3
    with zipfile.ZipFile(tmp_path / "p.zip") as z:
        assert z.read("answers.jsonl").splitlines()[1] == b'{"answer":"a1","index":1}'
    for wrong in (answers.where("index < 2"), answers.unionByName(answers.limit(1)), answers.unionByName(answers.selectExpr("index + 5 AS index", "answer"))):
        with pytest.raises(ValueError):
            packages.package(expected, wrong, str(tmp_path / "q.zip"))
    packages.write_results(answers, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    assert packages.strict_json('{"a": [1, null]}') == {"a": [1, None]}
    for bad in ('{"a": 1, "a": 2}', "[NaN]", "[-Infinity]", "{"):
        with pytest.raises(ValueError):
            packages.strict_json(bad)


def test_all_texts_of_all_rows(spark, data):
    """What comes behind the prefixes, and rows in other languages, are there."""
    documents = spark.read.parquet(f"{data}/documents.parquet").collect()
    named = {r.doc_id: r.normal for r in plans.QUERIES["normalize_text"](spark, data).collect()}
    assert set(named) == {r.doc_id for r in documents}
    drop = str.maketrans("", "", string.punctuation)
    assert named == {r.doc_id: " ".join(w for w in re.split(r"[ \t\n\x0b\f\r]+", r.text.lower().translate(drop)) if w not in ("", "a", "an", "the")) for r in documents}
    labels = {r.doc_id: r.label for r in plans.QUERIES["normalize_label"](spark, data).collect()}
    assert labels == {r.doc_id: re.sub(r"^-+|-+$", "", re.sub("[ _-]+", "-", f" _{r.text}- ".strip(" ").lower())) for r in documents}
    prompts = {r.page_id: r.prompt for r in plans.QUERIES["wrap_prompt"](spark, data).collect()}
    assert prompts == {r.page_id: f"<memory>{html.escape(r.html)}</memory>" for r in spark.read.parquet(f"{data}/pages.parquet").collect()}


def test_long_documents_of_all_languages(spark, data):
    sizes = sum(r.size for r in plans.QUERIES["source_long_documents"](spark, data).collect())
    said = spark.read.parquet(f"{data}/documents.parquet").selectExpr("sum(length(text)) AS every", "sum(CASE WHEN lang = 'en' THEN length(text) END) AS english").first()
    assert said.english < sizes <= 1.01 * said.every
