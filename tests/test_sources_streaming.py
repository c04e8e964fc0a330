"""Round trips through sources and sinks, and the streams."""

import json

import pytest
from pyspark.sql import functions as F

from chronosieve.sources import tables as R
from chronosieve.streaming import live as L


def test_csv_with_fallback(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v,w\n1,2.5,x\n2,,y\n")
    got = R.read_csv(spark, f"{tmp_path}/a", "id int, v double, w string", ["id", "v"]).collect()
    assert [tuple(r) for r in got] == [(1, 2.5), (2, None)]
    try:
        R.read_csv(spark, f"{tmp_path}/b", "id int")
        raise AssertionError("no error")
    except FileNotFoundError:
        pass


def test_append_new_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    path = f"{tmp_path}/out"
    assert R.append_new(df, path, "id") == 2
    assert R.append_new(df.union(spark.createDataFrame([(3, "c")], df.schema)), path, "id") == 1
    assert sorted(r.id for r in R.read_jsonl(spark, path, df.schema).collect()) == [1, 2, 3]


def test_document_items_and_file_names(spark, tmp_path):
    (tmp_path / "results_a_m1_x.json").write_text(json.dumps({"cases": [{"k": 1}, {"k": 2}]}))
    got = R.read_document(spark, f"{tmp_path}/*.json", "cases array<struct<k int>>", "cases").orderBy("k").collect()
    assert [(r.k, r.file_name) for r in got] == [(1, "results_a_m1_x.json"), (2, "results_a_m1_x.json")]
    names = spark.read.text(f"{tmp_path}/*.json").select(*R.from_file_name(r"results_(\w)_(\w+)_(\w)\.json", ["bench", "model", "cond"])).first()
    assert tuple(names) == ("a", "m1", "x")


def test_sorted_parquet_reuse_and_manifest(spark, tmp_path):
    df = spark.range(100).withColumn("k", F.pmod("id", F.lit(3)))
    R.write_sorted(df, f"{tmp_path}/s", "k")
    assert R.read_parquet(spark, f"{tmp_path}/s", ["k"]).columns == ["k"]
    made = []
    for _ in range(2):
        assert R.reused(spark, f"{tmp_path}/r", lambda: made.append(1) or df).count() == 100
    assert made == [1]
    R.manifest(df, f"{tmp_path}/m", "k")
    got = spark.read.json(f"{tmp_path}/m").first()
    assert got.total == 100 and got["by"]["0"] == 34


def test_stream_counts_equal_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    counts = L.windowed_counts(L.event_stream(spark, f"{tmp_path}/in", batch.schema), "event_type", "1 day", "400 days")
    q = counts.writeStream.format("memory").queryName("live_counts").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.start.date(), r.event_type): (r.n, r.total) for r in spark.table("live_counts").collect()}
    want = {(r.d, r.event_type): (r.n, r.total) for r in batch.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).collect()}
    assert got == want


def test_stream_without_repeats_appends_once(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").limit(200)
    batch.union(batch).repartition(2).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        s = L.without_repeats(L.event_stream(spark, f"{tmp_path}/in", batch.schema), ["event_id"], "400 days")
        assert L.append_to(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200


def test_cases_manifest_and_state(spark, tmp_path):
    import json

    from chronosieve.sources import tables as S

    df = spark.createDataFrame([(1, "a", "f1"), (1, "b", "f2"), (2, "a", "f1"), (3, None, "f3")], "case_id long, kind string, fp string")
    at = str(tmp_path / "cases")
    S.write_cases(df, at, "case_id")
    told = {r.case_id: (r.n_records, r.folder) for r in spark.read.json(f"{at}/manifest").collect()}
    assert told == {1: (2, "cases/case_id=1"), 2: (1, "cases/case_id=2"), 3: (1, "cases/case_id=3")}
    assert spark.read.json(f"{at}/{told[1][1]}").count() == 2

    sink = str(tmp_path / "sink")
    keys, prints, kinds = S.resume_state(spark, sink, df.schema, "case_id", "fp", "kind")
    assert keys.count() == prints.count() == kinds.count() == 0 and S.finished(spark, sink) is None
    df.write.json(sink)
    keys, prints, kinds = S.resume_state(spark, sink, df.schema, "case_id", "fp", "kind")
    assert keys.count() == 3 and prints.count() == 3 and {r.kind: r.n for r in kinds.collect()} == {"a": 2, "b": 1, None: 1}
    S.finish(df, sink)
    assert S.finished(spark, sink) == 4

    S.manifest(df.where("kind is not null"), str(tmp_path / "m"), "kind", records=["case_id", "fp"], seed=7)
    (part,) = [p for p in (tmp_path / "m").iterdir() if p.name.startswith("part-")]
    got = json.loads(part.read_text())
    assert got["total"] == 3 and got["by"] == {"a": 2, "b": 1} and got["seed"] == "7" and [r["case_id"] for r in got["records"]] == [1, 1, 2]

    S.write_readable(df, str(tmp_path / "r"), [("case_id", 4), ("kind", 3)], ["case_id"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "r" / "header")).collect()] == ["case | kin"]
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "r" / "rows")).collect())[0].startswith("1    | a  ")


def test_unreadable_documents_are_skipped(spark, tmp_path):
    from chronosieve.sources import tables as S

    (tmp_path / "a.json").write_text('{"items": [{"x": 1}, {"x": 2}]}')
    (tmp_path / "b.json").write_text('{"items": [{"x": 3}')
    got = S.read_document(spark, str(tmp_path), "items array<struct<x: long>>", "items").collect()
    assert sorted((r.x, r.file_name) for r in got) == [(1, "a.json"), (2, "a.json")]


def test_slices_are_read_without_a_shuffle(spark, sf):
    from chronosieve.plans import bundles
    from chronosieve.sources import slices

    names = bundles.pool_tables(spark, sf)
    df = bundles.of_slices(spark, names)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and df.count() > 0
        # the plan tells of the buckets only while it reads by buckets, which one table alone need not
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        one = slices.of_key(spark, names["labs"], "subject", df.first().subject)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert f"SelectedBucketsCount: 1 out of {slices.BUCKETS}" in plan and "PushedFilters: [IsNotNull(subject), EqualTo(subject" in plan
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    slices.dropped(spark, names)


def test_appends_happen_exactly_once(spark, tmp_path, monkeypatch):
    from chronosieve.sources import commits

    path, schema = str(tmp_path / "sink"), "id long, v string"
    runs = spark.sparkContext.accumulator(0)

    def batch(ids):
        def told(rows):
            for r in rows:
                runs.add(1)
                yield r

        return spark.createDataFrame(spark.sparkContext.parallelize([(i, str(i)) for i in ids], 2).mapPartitions(told), schema)

    held = lambda: sorted(r.id for r in commits.committed(spark, path, schema).collect())
    assert commits.append_batch(batch([1, 2, 2, 3]), path, "id", "a") == 3 and runs.value == 4
    # the same batch again: not even computed
    assert commits.append_batch(batch([1, 2, 2, 3]), path, "id", "a") == 3 and runs.value == 4
    # a crash between the write and the record
    real = commits._record
    monkeypatch.setattr(commits, "_record", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        commits.append_batch(batch([3, 4, 5]), path, "id", "b")
    assert held() == [1, 2, 3] and len(commits.unused(spark, path)) == 1
    monkeypatch.setattr(commits, "_record", real)
    assert commits.append_batch(batch([3, 4, 5]), path, "id", "b") == 2 and held() == [1, 2, 3, 4, 5]
    # another writer takes the number in between, with a key of this batch
    raced = []

    def slow(spark_, path_, number, **about):
        if not raced:
            raced.append(1)
            assert commits.append_batch(batch([6, 7]), path, "id", "fast") == 2
        return real(spark_, path_, number, **about)

    monkeypatch.setattr(commits, "_record", slow)
    runs.value = 0
    assert commits.append_batch(batch([7, 8]), path, "id", "slow") == 1 and runs.value == 4
    assert held() == [1, 2, 3, 4, 5, 6, 7, 8] and [r["batch"] for r in commits.records(spark, path)] == ["a", "b", "fast", "slow"]
