"""The ordered landing folder, the sink stage of a stream, counters."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from sievegrid.operators import table_functions
from sievegrid.streaming import counters, first_seen, landing, stages


def drop(folder, *numbers, text="x"):
    for i in numbers:
        part = folder / f".part{i}"
        part.write_bytes(f"{text}{i}".encode())
        part.rename(folder / f"frame_{i:05d}.bin")


def consume(spark, folder, seen, state, **trigger):
    def each(batch, i):
        seen.append([(r["index"], bytes(r["content"]).decode()) for r in batch.orderBy("index").collect()])

    return landing.stream(spark, f"file://{folder}", 2).writeStream.foreachBatch(each).option("checkpointLocation", f"file://{state}").trigger(**trigger).start()


def test_files_go_out_in_order_and_once(spark, tmp_path):
    folder, state = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    steps = [((2, 0, 1, 5), [0, 1, 2]), ((4,), []), ((3, 7), [3, 4, 5]), ((6, 12), [6, 7])]
    for numbers, want in steps:  # each go is a new query over the same place in the stream
        drop(folder, *numbers)
        (folder / "notes.txt").write_text("no number")
        seen = []
        assert first_seen.run(consume(spark, folder, seen, state, availableNow=True)) == (True, "done")
        assert [x for batch in seen for x in batch] == [(i, f"x{i}") for i in want]
    landing.finish(f"file://{folder}")  # nothing more will come: what is left goes out over the gap
    seen = []
    assert first_seen.run(consume(spark, folder, seen, state, availableNow=True)) == (True, "done")
    assert [x for batch in seen for x in batch] == [(12, "x12")]


def test_the_end_file_ends_the_query(spark, tmp_path):
    folder, state, seen = tmp_path / "in", tmp_path / "state", []
    folder.mkdir()
    drop(folder, 1, 0)
    query = consume(spark, folder, seen, state, processingTime="200 milliseconds")

    def later():
        time.sleep(3)
        drop(folder, 3, 2)
        landing.finish(f"file://{folder}")

    threading.Thread(target=later).start()
    assert landing.follow(query, f"file://{folder}", 90) == (True, "done")
    assert not query.isActive and [i for batch in seen for i, _ in batch] == [0, 1, 2, 3]
    idle = consume(spark, tmp_path / "none", [], tmp_path / "state2", processingTime="200 milliseconds")
    assert landing.follow(idle, f"file://{tmp_path}/none", 3) == (False, "stopped after 3 s")


def at(day):
    return F.expr(f"timestamp'2024-01-01' + INTERVAL {day} DAY")


def test_sink_stage_of_a_stream(spark, tmp_path):
    """Results before and after their rows, too far away, and not at all."""
    plan = [(1, 1, 0), (2, 1, 1), (3, 3, 2), (4, 1, 40), (5, 5, 3), (6, None, 3)]
    results = [(1, 0, "a"), (5, 4, "late"), (9, 1, "nobody's")]
    folders = {"plan": [plan[3:], plan[:3], [(-1, -1, 400)]], "results": [results[1:], results[:1], [(-2, 400, "end")]]}
    schemas = {"plan": "id long, unique_id long, day int", "results": "unique_id long, day int, value string"}
    streams = {}
    for name, batches in folders.items():
        for k, rows in enumerate(batches):
            df = spark.createDataFrame(rows, schemas[name]).withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)")).drop("day")
            df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}")
            time.sleep(0.05)
        streams[name] = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{name}")
    got = {"originals": [], "copies": [], "missing": []}
    note = lambda rows, kind, i: got[kind].extend((r["id"], r["value"]) for r in rows.collect())
    found = stages.with_results(streams["plan"], streams["results"], "ts", "100 DAY", "5 DAY")
    query = found.writeStream.foreachBatch(stages.split_sink(note, lambda rows, i: note(rows, "missing", i))).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    assert first_seen.run(query) == (True, "done")
    assert sorted(got["originals"]) == [(1, "a"), (5, "late")] and got["copies"] == [(2, "a")]
    assert sorted(got["missing"]) == [(3, None), (4, None), (6, None)]


def test_counters_of_streams_and_jobs(spark, tmp_path):
    seen = []
    listener = counters.Counters(lambda run, rows, rate: seen.append(rows))
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in").observe("a", F.count("*").alias("n"), F.sum(F.when(F.col("id") % 7 == 0, 1)).alias("odd"))
    spark.streams.addListener(listener)
    try:
        query = stream.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        assert first_seen.run(query) == (True, "done")
        assert listener.of(str(query.runId)) == {"n": 30, "odd": 5} and listener.batches[str(query.runId)] > 1 and sum(seen) == 30
    finally:
        spark.streams.removeListener(listener)
    rows, found = counters.counted(spark.range(10), n=F.count("*"), low=F.count_if(F.col("id") < 4))
    rows.where("id > 5").write.format("noop").mode("overwrite").save()
    assert found.get == {"n": 10, "low": 4}


def test_table_functions(spark):
    table_functions.register(spark)
    got = spark.sql("SELECT i, t.* FROM VALUES (1, 5, 7), (2, 3, 3), (3, NULL, 3), (4, 0, 9) AS v(i, h, w), LATERAL tiles(h, w, 4, 1) t").collect()
    assert {tuple(r) for r in got if r["i"] == 1} == {(1, y, x, min(y + 4, 5), min(x + 4, 7)) for y in (0, 3) for x in (0, 3, 6)}
    assert [tuple(r) for r in got if r["i"] != 1] == [(2, 0, 0, 3, 3)]
    with pytest.raises(Exception, match="smaller than the tile"):
        spark.sql("SELECT * FROM tiles(5, 5, 4, 4)").collect()
    rows = "VALUES ('a', 1L), ('a', 0L), ('a', 5L), ('b', 2L), ('b', NULL), ('a', 5L), (NULL, 3L) AS v(k, n)"
    got = spark.sql(f"SELECT * FROM segments(TABLE(SELECT * FROM {rows}), 'k', 'n', 4)").collect()
    assert sorted((r["key"] or "", r["segment"], r["first"], r["last"], r["n"], r["numbers"]) for r in got) == [("", 0, 3, 3, 1, [3]), ("a", 0, 0, 1, 2, [0, 1]), ("a", 1, 5, 5, 2, [5, 5]), ("b", 0, 2, 2, 1, [2])]
    with pytest.raises(Exception, match="no columns"):
        spark.sql(f"SELECT * FROM segments(TABLE(SELECT * FROM {rows}), 'k', 'm', 4)").collect()
