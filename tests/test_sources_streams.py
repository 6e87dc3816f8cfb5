"""Sources, conforming, validation, and streams with restarts."""

import pytest
from conftest import texts
from pyspark.sql import functions as F

from warywire.operators import conform as C
from warywire.operators import features as FE
from warywire.plans.inputs import derive_messages
from warywire.sources import files as S
from warywire.streaming import jobs as J


def test_csv_round_trip(spark, tmp_path):
    rows = [("T", "g", 'say "hi", ok\nnext', "high"), ("T", "g", " ends ", None), ("D", "g", "🔥 é", "low")]
    df = spark.createDataFrame(rows, S.MESSAGES)
    S.write_csv(df, str(tmp_path / "m"))
    assert {tuple(r) for r in S.read_messages_csv(spark, str(tmp_path / "m"), multi_line=True).collect()} == set(rows)


def test_optional_source(spark, tmp_path):
    assert S.read_optional(spark, str(tmp_path / "none"), S.MESSAGES).count() == 0


def test_lexicons(spark, tmp_path):
    (tmp_path / "l.csv").write_text('slang_term,drug_type,definition\nZorp,general,"a, b"\nzorp,mdma,c\n')
    lex = S.read_lexicon(spark, str(tmp_path / "l.csv"), "slang")
    assert lex.count() == 2 and S.lexicon_terms(lex) == ("zorp",)
    assert S.read_lexicon(spark).count() == 200 and S.read_lexicon(spark, kind="emoji").count() == 200


def test_requests(spark):
    raw = spark.createDataFrame([('{"query": "weed delivery", "limit": 2}',), ('{"query": "cash only", "platform": "Telegram"}',)], "body string")
    got = [tuple(r) for r in S.parse_requests(raw, "search").collect()]
    assert got == [("weed delivery", 2, None, None), ("cash only", 5, "Telegram", None)]
    batch = spark.createDataFrame([('{"messages": ["a", "b"]}',)], "body string")
    assert S.parse_requests(batch, "batch").first()["messages"] == ["a", "b"]
    one = spark.createDataFrame([('{"message": "a"}',)], "body string")
    assert S.parse_requests(one, "predict").first()["message"] == "a"


def test_unusable_requests_are_named(spark):
    bodies = ['{"message": "hi"}', '{"message": null}', '{}', '{"message": ', 'no json', '[1]', '{"message": 5, "more": 1}', None]
    raw = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    out = {r["id"]: (r["message"], r["error"]) for r in S.check_requests(raw, "predict").collect()}
    assert out[0] == ("hi", None) and out[1][1] == out[2][1] == "message is required" and out[6] == ("5", None)
    assert all(out[i] == (None, "invalid JSON") for i in (3, 4, 7))
    assert out[5][1] is not None
    batch = spark.createDataFrame([(0, '{"messages": ["a", "b"]}'), (1, '{"messages": "a"}')], "id long, body string")
    assert [r["error"] for r in S.check_requests(batch, "batch").orderBy("id").collect()] == [None, "invalid JSON"]


def test_conform_without_platform_or_text(spark):
    bare = spark.createDataFrame([(1,), (0,), (None,)], "suspicious int")
    rows = C.conform_source(bare).collect()
    assert [r["risk_level"] for r in rows] == ["high", "low", "low"]
    assert {(r["platform"], r["message_text"]) for r in rows} == {("Telegram", "")}
    assert C.append_negatives(C.conform_source(bare)).count() == 1003
    assert C.append_negatives(C.conform_source(bare.limit(0))).count() == 0


@pytest.mark.parametrize("text, ok", [
    (None, False), ("", False), (" \t ", False), ("x" * 10_000, True), ("x" * 10_001, False), ("<SCRIPT a>b</script>", False),
    ("javascript:x", False), ("onload = 1", False), ("eval (1)", False), ("exec(1)", False), ("fine on a day", True)])
def test_validate(spark, text, ok):
    r = C.validate_messages(texts(spark, text)).first()
    assert r["is_valid"] is ok and (r["reason"] == "") is ok


def test_identity_is_deterministic(spark):
    a = C.with_identity(texts(spark, "x  y")).first()
    b = C.with_identity(texts(spark, "x y")).first()
    assert a["id"] == b["id"] and a["metadata"]["platform"] == "unknown"


@pytest.fixture()
def event_files(spark, sf, tmp_path):
    """The events in six files; a fresh folder per test."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "src")
    events.repartition(6, "event_id").write.parquet(src)
    return events, src


def stream_of(spark, events, src):
    return derive_messages(J.message_stream(spark, src, events.schema, max_files=2))


def test_ingest_resumes_without_copies(spark, event_files, tmp_path):
    events, src = event_files
    dst, cp = str(tmp_path / "dst"), str(tmp_path / "cp")
    J.start_ingest(stream_of(spark, events, src), dst, cp).awaitTermination()
    first = spark.read.parquet(dst).count()
    events.limit(50).withColumn("event_id", F.col("event_id") + 1_000_000).write.mode("append").parquet(src)
    J.start_ingest(stream_of(spark, events, src), dst, cp).awaitTermination()
    out = spark.read.parquet(dst)
    assert first == C.drop_blank(derive_messages(events)).count()
    assert out.count() > first and out.select("id").distinct().count() == out.count()


def test_stream_score_equals_batch(spark, event_files, tmp_path):
    events, src = event_files
    scored = J.stream_score(stream_of(spark, events, src)).select("message_id", "weighted_risk_score", "risk_category")
    J.run_to_parquet(scored, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    batch = FE.final_features(derive_messages(events)).select("message_id", "weighted_risk_score", "risk_category")
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0


def test_last_n_over_many_batches(spark, event_files, tmp_path):
    events, src = event_files
    rows = stream_of(spark, events, src).select("message_id", "ts", "message_text")
    J.stream_last_n(rows, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = {r["message_id"] for r in J.read_last_n(spark, str(tmp_path / "o")).collect()}
    want = {r["event_id"] for r in events.orderBy(F.desc("ts"), F.desc("event_id")).limit(6).collect()}
    assert got == want


def test_stats_windows_add_up(spark, event_files, tmp_path):
    events, src = event_files
    stats = J.stream_stats(stream_of(spark, events, src), "6 hours", "40 days")
    J.run_updates(stats, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    out = J.latest(spark, str(tmp_path / "o"))
    assert out.agg(F.sum("messages")).first()[0] == events.count()
