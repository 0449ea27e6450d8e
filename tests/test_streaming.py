import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from floorledger.operators import changelist as cl
from floorledger.streaming import intake

SCHEMA = "id bigint, token string, kind string, ref string, buyer string, name string, payload string, created_at timestamp_ntz"
T0 = datetime(2026, 10, 4, 12)


def rows():
    out = []
    for i in range(60):
        p = json.dumps({"optionId": f"o{i % 3}", "priceDeltaBdt": i % 5})
        out.append((i, f"t{i % 4}", "selection" if i % 7 else "other", f"s{i % 6}", "b", None, p, T0 + timedelta(seconds=i)))
    return out + [(*r[:7], r[7] + timedelta(seconds=5)) for r in out[::5]] + [(None, *out[1][1:])]  # resends, and a row without an id


def land(spark, path, n=3):
    data = sorted(rows(), key=lambda r: r[7])
    for k in range(n):
        spark.createDataFrame(data[k::n] if k else data[::n], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def fixtures(spark):
    links = spark.createDataFrame([("t0", "A", None), ("t1", "B", None), ("t2", "C", None), ("t3", "D", T0)], "token string, unit_name string, revoked_at timestamp")
    catalog = spark.createDataFrame([("o1", "L", "B", "S", 100)], "option_id string, label string, brand string, sku string, delta bigint")
    return links, catalog


def test_intake_equals_batch_and_survives_a_restart(spark, tmp_path):
    p = {k: str(tmp_path / k) for k in ("in", "ok", "aside", "ck")}
    land(spark, p["in"])
    links, _ = fixtures(spark)
    schema = spark.read.parquet(p["in"]).schema
    for _ in range(2):  # the second run finds nothing new
        q = intake.intake(intake.event_stream(spark, p["in"], schema, 1), links, p["ok"], p["aside"], p["ck"])
        q.awaitTermination()
    batch = cl.ingest(spark.read.parquet(p["in"]).withColumn("created_at", F.col("created_at").cast("timestamp")), links)
    want = sorted(r.id for r in batch.where("verdict = 'accepted'").collect())
    assert sorted(r.id for r in spark.read.parquet(p["ok"]).collect()) == want
    refused = {r.rule for r in spark.read.option("mergeSchema", "true").parquet(p["aside"]).withColumn("rule", F.col("verdict")).collect()}
    assert refused == {"kind", "id", "no such link, or it was turned off"}


def test_intake_loses_no_late_row_and_doubles_none(spark, tmp_path):
    p = {k: str(tmp_path / k) for k in ("in", "ok", "aside", "ck")}
    links, _ = fixtures(spark)
    row = lambda i, minutes, kind="selection": (i, "t0", kind, "s", "b", None, "{}", T0 + timedelta(minutes=minutes))
    rounds = [
        [row(1, 0), row(1, 0), row(2, 0, "bad")],  # two arrivals of one time; a refused id
        [row(3, -180), row(2, 1), row(1, 30)],  # three hours late; the refused id valid; a retry with a new time
        [row(4, -5000), row(3, 60), row(5, 2, "bad")],
    ]
    for data in rounds:  # a restart after each
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(p["in"])
        schema = spark.read.parquet(p["in"]).schema
        intake.intake(intake.event_stream(spark, p["in"], schema, 1), links, p["ok"], p["aside"], p["ck"]).awaitTermination()
    got = sorted((r.id, r.created_at) for r in spark.read.parquet(p["ok"]).collect())
    assert [i for i, _ in got] == [1, 2, 3, 4] and got[0][1] == T0 and got[2][1] == T0 - timedelta(minutes=180)
    assert sorted(r.id for r in spark.read.option("mergeSchema", "true").parquet(p["aside"]).collect()) == [2, 5]


def test_newest_choice_forms_agree(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path)
    schema = spark.read.parquet(path).schema
    batch = {(r.token, r.kind, r.ref): r.newest_id for r in cl._newest(spark.read.parquet(path).withColumn("created_at", F.col("created_at").cast("timestamp"))).collect()}
    q = intake.newest_choices(intake.event_stream(spark, path, schema, 1)).writeStream.format("memory").queryName("newest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.token, r.kind, r.ref): r.id for r in spark.table("newest").collect()} == batch
    seen = {}

    def keep(df, batch_id):
        for r in df.collect():
            seen[r.token, r.kind, r.ref] = r.id

    q = intake.current_choice_updates(intake.event_stream(spark, path, schema, 1)).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == batch


def test_live_totals(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path)
    links, catalog = fixtures(spark)
    last = {}
    q = intake.live_totals(intake.event_stream(spark, path, spark.read.parquet(path).schema, 1), links, catalog, lambda df, i: last.update({r.token: r for r in df.collect()}), str(tmp_path / "ck"))
    q.awaitTermination()
    want = {r.token: r for r in cl.by_link(links, spark.read.parquet(path).where("id is not null").withColumn("created_at", F.col("created_at").cast("timestamp")).orderBy("created_at").dropDuplicates(["id"]), catalog).collect()}
    assert last == want


def test_debounce_forms_agree(spark, tmp_path):
    path = str(tmp_path / "in")
    e = [("p", T0 + timedelta(seconds=s), v) for s, v in ((0, "a"), (1, "b"), (10, "b"), (30, "c"), (31, "d"), (4000, "z"))]
    spark.createDataFrame(e, "project string, ts timestamp, snap string").coalesce(1).write.parquet(path)
    edits = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    with intake.state_on_disk(spark):
        q = intake.debounce_stream(edits, "project", "ts", "snap").writeStream.format("memory").queryName("saves").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.snap for r in spark.table("saves").orderBy("saved_at").collect()] == ["b", "d"]
    batch = intake.debounced_saves(spark.read.parquet(path).withColumn("i", F.lit(0)), "project", "ts", "i", "snap", "2 seconds")
    assert [r.snap for r in batch.orderBy("saved_at").collect()] == ["b", "d", "z"]  # an unchanged snapshot is not sent again


def test_a_batch_reads_its_own_rows_however_long_the_history(spark, tmp_path):
    """Fourteen batches of new ids, each with repeats of the very first ones: rows read a batch stay level, and state grows by new ids only."""
    p = {k: str(tmp_path / k) for k in ("in", "ok", "aside", "ck")}
    links, _ = fixtures(spark)
    for n in range(14):
        data = [(100 * n + i, "t0", "selection", "s", "b", None, "{}", T0 + timedelta(seconds=i)) for i in range(40)] + [(i, "t0", "selection", "s", "b", "again", "{}", T0) for i in range(5)]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(p["in"])
    schema = spark.read.parquet(p["in"]).schema
    q = intake.intake(intake.event_stream(spark, p["in"], schema, 1), links, p["ok"], p["aside"], p["ck"])
    q.awaitTermination()
    got = [r.id for r in spark.read.parquet(p["ok"]).collect()]
    assert sorted(got) == [100 * n + i for n in range(14) for i in range(40)]
    steps = [x for x in q.recentProgress if x.numInputRows]
    assert len(steps) == 14 and len({x.numInputRows for x in steps}) == 1
    assert [x.stateOperators[0].numRowsUpdated for x in steps] == [40] * 14
