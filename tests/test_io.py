import json

from pyspark.sql import functions as F

from folio.sources import readers, sinks
from folio.streaming import events

SF = "/root/testdata/sf0.001"


def test_slices(spark, tmp_path):
    rows = [{"id": "nap-18000101-1", "date": "1800-01-01", "author": "é", "eventIds": ["x"]}, {"id": "b", "extra": 1}]
    (tmp_path / "nap_a.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf8")
    df = readers.json_slices(spark, str(tmp_path / "nap_*.json"))
    assert {(r.id, r.author, r.slice) for r in df.collect()} == {("nap-18000101-1", "é", "nap_a.json"), ("b", None, "nap_a.json")}
    missing = {r.id: r.missing for r in readers.missing_keys(readers.raw_slices(spark, str(tmp_path))).collect()}
    assert "date" not in missing["nap-18000101-1"] and "author" in missing["b"]


def test_texts_and_lines(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"one\ntwo \xff\n")
    whole = readers.whole_texts(spark, str(tmp_path))
    lines = readers.numbered_lines(whole, "file", "text").collect()
    assert [(r.line_no, r.line, r.before, r.after) for r in lines] == [(1, "one", None, "two �"), (2, "two �", "one", ""), (3, "", "two �", None)]


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([("a", "1790-01-01", "x"), ("b", "1806-01-01", "y"), ("c", None, None)], "id string, date string, displayText string")
    path = str(tmp_path / "shards")
    sinks.write_shards(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 3 and readers.era_pruned(back, F.col("era"), "empire").collect()[0].id == "b"
    plan = readers.era_pruned(back, F.col("era"), "empire")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(era" in plan
    manifest = sinks.shard_manifest(back)
    assert sinks.verify_shards(back, manifest).count() == 0
    assert sinks.verify_shards(back.where("id <> 'b'"), manifest).count() == 1
    sinks.write_manifest(spark, manifest, str(tmp_path / "manifest"))
    assert json.loads(spark.read.text(str(tmp_path / "manifest")).collect()[0].value)[0]["era"]


def test_append_new_resumes(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "k")
    path = str(tmp_path / "t")
    assert sinks.append_new(df.where("k < 3"), path, "k") == 3
    assert sinks.append_new(df, path, "k") == 2
    assert sinks.append_new(df, path, "k") == 0


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"))
    got = _run(events.tumbling(stream, late="60 days"), "tumbling", "complete")
    assert got.exceptAll(events.tumbling(batch)).count() == 0 and got.count() == events.tumbling(batch).count()
    got = _run(events.sessions(stream, late="60 days"), "sessions", "complete")
    assert got.exceptAll(events.sessions(batch)).count() == 0
    assert _run(events.first_deliveries(stream, late="60 days"), "firsts", "append").count() == batch.select("event_id").distinct().count()


def test_arbitrary_state(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    totals = _run(events.running_totals(events.event_stream(spark, str(tmp_path / "in"))), "totals", "update")
    last = totals.groupBy("user_id").agg(F.max("events").alias("n"))
    assert last.exceptAll(batch.groupBy("user_id").agg(F.count("*").alias("n"))).count() == 0


def test_manifest_object(spark, tmp_path):
    rows = [(s, "k", "1") for s in sinks.MANIFEST_KEYS] + [("counts", None, "2"), ("counts", "posts", "3")]
    whole = spark.createDataFrame(rows, "section string, key string, value string")
    sinks.write_object(whole, str(tmp_path / "m"))
    assert sinks.manifest_problems(spark, str(tmp_path / "m")) == []
    sinks.write_object(whole.where("section <> 'shards'"), str(tmp_path / "n"))
    assert sinks.manifest_problems(spark, str(tmp_path / "n")) == ["missing key shards", "no shards"]
    spark.createDataFrame([("no object",)], "value string").coalesce(1).write.text(str(tmp_path / "o"))
    assert sinks.manifest_problems(spark, str(tmp_path / "o")) == ["not an object"]
