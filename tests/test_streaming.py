"""Progressive fields, batch and streaming."""

from pyspark.sql import functions as F

from triagelake.streaming import fields


def test_complete_fields():
    known = set()
    assert fields.complete_fields('{"a": "x', known) == []
    assert fields.complete_fields('{"a": "x"', known) == []
    assert fields.complete_fields('{"a": "x", "b": [{"c": 1}', known) == [("a", '"x"'), ("c", "1")]
    assert fields.complete_fields('{"a": "x", "b": [{"c": 1}], "a": 2}', known) == [("b", '[{"c": 1}]')]


def test_stream_equals_batch(spark, tmp_path):
    raw = '{"department": "城管局", "items": [{"quote": "甲"}], "confidence": 0.5}'
    rows = [(f"s{k}", i, raw[i * 7 : i * 7 + 7]) for k in range(3) for i in range(len(raw) // 7 + 1)]
    for part in range(3):
        own = rows[part * len(rows) // 3 : (part + 1) * len(rows) // 3]
        spark.createDataFrame(own, "session string, seq int, chunk string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, seq int, chunk string").json(str(tmp_path / "in"))
    q = fields.field_events(stream).writeStream.format("memory").queryName("events_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session, r.field, r.value) for r in spark.sql("select * from events_out").collect()}
    assert {f for _, f, _ in got} == {"department", "items", "quote", "confidence"} and len(got) == 12


def test_frames_and_fold(spark):
    frames = spark.createDataFrame([("s", 'data: {"a": 1}\n\ndata: {"b": 2}\n: note\n\n')], "session string, frame string")
    assert [r.data for r in fields.frames_to_events(frames).collect()] == ['{"a": 1}', '{"b": 2}']
    events = spark.createDataFrame([("s", "a", "1", 1), ("s", "a", "2", 2), ("t", "a", "3", 1)], "session string, field string, value string, seq int")
    assert {(r.session, r.value) for r in fields.fold_events(events).collect()} == {("s", "2"), ("t", "3")}
    good, bad = fields.error_frames(events.withColumn("error", F.when(F.col("session") == "t", "x")))
    assert good.count() == 2 and bad.count() == 1


def test_scanner_takes_pieces_of_any_size():
    raw = '{"department": "城\\"管{", "items": [{"quote": "甲", "n": -1.5e3}, [1, {"deep_key": null}]], "Bad Key": 1, "x": {}, "z": true}'
    want = fields.complete_fields(raw, set())
    assert [k for k, _ in want] == ["department", "quote", "n", "deep_key", "items", "x", "z"]
    for size in range(1, 12):
        scanner, out = fields.FieldScanner(), []
        for at in range(0, len(raw), size):
            out += scanner.feed(raw[at : at + size])
            scanner = fields.FieldScanner.load(scanner.dump())
        assert out == want and scanner.ended


def test_scanner_is_linear_in_long_values():
    import time

    def seconds(n: int) -> float:
        raw = '{"a": "' + 'x\\"' * (n // 3) + '", "b": [' + '{"c": "y"},' * (n // 11) + '1]}'
        began, scanner, out = time.perf_counter(), fields.FieldScanner(), []
        for at in range(0, len(raw), 4):
            out += scanner.feed(raw[at : at + 4])
        assert [k for k, _ in out] == ["a", "c", "b"] and scanner.ended
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 1 and seconds(320_000) < 8 * max(0.1, seconds(160_000))


def test_scanner_drops_what_nothing_needs():
    scanner = fields.FieldScanner()
    for _ in range(1000):
        scanner.feed('[{"a b": "some text that no field needs"}],')
    assert sum(map(len, scanner.parts)) < 100


def test_failed_sessions_give_nothing(spark, tmp_path):
    rows = [("ok", 1, "field", "a", "1"), ("ok", 2, "field", "b", "2"), ("bad", 1, "field", "a", "9"), ("ok", 4, "done", None, None), ("ok", 3, "field", "a", "3"),
            ("bad", 2, "error", None, "boom"), ("bad", 3, "field", "a", "8"), ("bad", 4, "done", None, None), ("open", 1, "field", "a", "7")]
    schema = "session string, seq int, kind string, field string, value string"
    for part in (rows[:3], rows[3:5], rows[5:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = fields.settled_events(stream).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session, r.kind, r.field, r.value) for r in spark.sql("select * from settled").collect()}
    assert ("bad", "error", None, "boom") in got and ("bad", "field", "a", "8") in got and ("bad", "field", "a", "9") not in got
    assert {r[2:] for r in got if r[0] == "ok"} <= {("a", "3"), ("a", "1"), ("b", "2")} and not any(r[0] == "open" for r in got)
