import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from floorledger.functions import hashing, share
from floorledger.operators import changelist as cl
from floorledger.operators import finishes as fin
from floorledger.operators import ordered
from floorledger.operators import versions as ver

EV = "id string, token string, kind string, ref string, buyer string, name string, payload string, created_at timestamp"


def at(minute):
    return datetime(2026, 10, 4, 12, minute)


def events(spark):
    sel = lambda **k: json.dumps({"slotId": "s_floor", "slotLabel": "Bedroom floors", "label": "Sent label", "brand": "Sent", "sku": "S", **k})
    rows = [
        ("e1", "t1", "selection", "s_floor", "abcdef", "Rahim", sel(optionId="walnut", priceDeltaBdt=1), at(1)),
        ("e2", "t1", "selection", "s_floor", "abcdef", None, sel(optionId="oak", priceDeltaBdt=5), at(0)),
        ("e3", "t1", "comment", "n1", "abcdef", "", json.dumps({"text": 'Say "hi", please', "object": "Door handle · Bed 1"}), at(2)),
        ("e4", "t1", "comment", "n2", "zzzz99", None, json.dumps({"removed": True}), at(3)),
        ("e5", "t2", "selection", "room:r1:floor", "zzzz99", None, sel(optionId="unknown", priceDeltaBdt=10.5, scope="Bed-1 · floor"), at(4)),
        ("e6", "t2", "selection", "s_wall", "zzzz99", None, sel(optionId="walnut", priceDeltaBdt=2), at(5)),
        ("e0", "t2", "selection", "s_wall", "zzzz99", None, sel(optionId="", priceDeltaBdt=0, removed=True), at(5)),
    ]
    return spark.createDataFrame(rows, EV)


def catalog(spark):
    return spark.createDataFrame([("walnut", "Dark walnut wood", "RAK Ceramics", "RAK-WOOD-WALNUT", 45000), ("oak", "Oak wood", "RAK Ceramics", "RAK-WOOD-OAK", 0)], "option_id string, label string, brand string, sku string, delta bigint")


def links(spark):
    return spark.createDataFrame([("t1", "Flat A", None), ("t2", "Flat B", None), ("t3", "Flat C", at(9))], "token string, unit_name string, revoked_at timestamp")


def test_totals_and_ties(spark):
    flags = {r.id: r.superseded for r in cl.superseded(events(spark)).collect()}
    assert flags == {"e1": False, "e2": True, "e3": False, "e4": False, "e5": False, "e6": True, "e0": False}  # a tie goes to the smaller id
    got = {r.token: (r.choices, r.total_bdt, r.open_notes, r["rows"]) for r in cl.by_link(links(spark), events(spark), catalog(spark)).collect()}
    assert got == {"t1": (1, 45000, 1, 4), "t2": (1, 0, 0, 3), "t3": (0, 0, 0, 0)}


def test_csv_bytes(spark, tmp_path):
    ev = events(spark).where("token = 't1'")
    rows = cl.change_rows(ev, links(spark), catalog(spark), "https://x.test")
    path = str(tmp_path / "csv")
    cl.write_change_list_csv(rows.coalesce(1), path)
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.split("\r\n") == [
        cl.csv_header(),
        "2026-10-04T12:03:00.000Z,Flat A,https://x.test/s/t1,Buyer zzzz,zzzz99,Note,Note,Removed this note,,,,no",
        '2026-10-04T12:02:00.000Z,Flat A,https://x.test/s/t1,Rahim,abcdef,Note,Door handle · Bed 1,"Say ""hi"", please",,,,no',
        "2026-10-04T12:01:00.000Z,Flat A,https://x.test/s/t1,Rahim,abcdef,Finish choice,Bedroom floors,Dark walnut wood,RAK Ceramics,RAK-WOOD-WALNUT,45000,no",
        "2026-10-04T12:00:00.000Z,Flat A,https://x.test/s/t1,Rahim,abcdef,Finish choice,Bedroom floors,Oak wood,RAK Ceramics,RAK-WOOD-OAK,0,yes",
        "",
    ]
    assert cl.csv_header().count(",") == 11


def test_ingest_rules(spark):
    ev = events(spark).where("id in ('e1', 'e3')")
    late = ev.withColumn("created_at", F.col("created_at") + F.expr("interval 1 minute"))
    off = ev.where("id = 'e1'").withColumn("id", F.lit("x1")).withColumn("token", F.lit("t3"))
    big = ev.where("id = 'e3'").withColumn("id", F.lit("x2")).withColumn("payload", F.repeat(F.lit("x"), 8001))
    v = [(r.id, r.verdict) for r in cl.ingest(ev.unionByName(late).unionByName(off).unionByName(big), links(spark)).collect()]
    assert sorted(v) == [("e1", "accepted"), ("e1", "repeat"), ("e3", "accepted"), ("e3", "repeat"), ("x1", "no such link, or it was turned off"), ("x2", "payload")]


def test_share_and_money(spark):
    df = spark.createDataFrame([(0,), (185000,), (-40000,), (12500000,), (999,)], "n bigint")
    assert [r[0] for r in df.select(share.format_delta(F.col("n"))).collect()] == ["Included", "+৳1,85,000", "−৳40,000", "+৳1,25,00,000", "+৳999"]
    cfg = spark.range(1).select(F.create_map(F.lit("s"), F.lit("ওক?>")).alias("c")).select(share.encode_config(F.col("c")).alias("e")).select("e", share.decode_config(F.col("e")).alias("d"), share.decode_config(F.lit("%%%")).alias("bad"))
    r = cfg.collect()[0]
    assert r.d == {"s": "ওক?>"} and r.bad == {} and "=" not in r.e and "+" not in r.e
    assert spark.range(1).select(hashing.fnv1a(F.lit("hello"))).collect()[0][0] == "5:4f9f2cab"


def test_finishes(spark):
    slots = spark.createDataFrame([("u", "all", 0, "floor", None), ("u", "beds", 1, "floor", "r1")], "unit_id string, slot_id string, pos int, target string, room_id string")
    rooms = spark.createDataFrame([("u", "r1"), ("u", "r2")], "unit_id string, room_id string")
    assert {r.room_id: r.slot_id for r in fin.slot_for(rooms, slots).collect()} == {"r1": "beds", "r2": "all"}
    faces = spark.createDataFrame([("u", "beds", "wall:w:r1", "room:r1:floor", "d")], "unit_id string, slot_id string, wall_key string, room_key string, default_option_id string")
    opts = spark.createDataFrame([("beds", "d"), ("beds", "x")], "slot_id string, option_id string")
    ch = spark.createDataFrame([("u", "wall:w:r1", "not there"), ("u", "beds", "x")], "unit_id string, key string, option_id string")
    assert fin.resolve_finish(faces, ch, opts).collect()[0].option_id == "x"


def test_replay_matches_a_plain_walk(spark):
    import random

    rnd = random.Random(5)
    reqs, want = [], []
    for p in range(40):
        version, deleted = 0, False
        for s in range(1, rnd.randint(2, 30)):
            op = "create" if s == 1 else rnd.choice(["save"] * 8 + ["delete"])
            base = max(0, version - rnd.choice([0, 0, 0, 1]))
            if op == "create":
                ok, why = version == 0, "exists"
            elif version == 0 or deleted:
                ok, why = False, "gone"
            else:
                ok, why = op == "delete" or base == version, "stale"
            if ok:
                version, deleted = version + 1, op == "delete"
            reqs.append((p, s, op, base))
            want.append((p, s, "accepted" if ok else why, version))
    df = spark.createDataFrame(reqs, "project_id bigint, seq bigint, op string, base_version bigint")
    assert sorted(tuple(r) for r in ver.replay_saves(df.repartition(7)).collect()) == sorted(want)


@pytest.mark.parametrize("chunk", [ordered.CHUNK, 30])
def test_replay_of_wild_logs(spark, monkeypatch, chunk):
    """Saves before a create, bases of the future and of nowhere, creates and deletes again, and one project with half the rows."""
    import random

    monkeypatch.setattr(ordered, "CHUNK", chunk)
    monkeypatch.setattr(ordered, "DRAWS", 4)
    rnd = random.Random(9)
    reqs, want = [], []
    for p in range(14):
        version, deleted, n = 0, False, 400 if p == 3 else rnd.randint(0, 60)
        for s in range(n):
            op = rnd.choice(["save"] * 30 + ["create"] * 3 + ["delete"] * (0 if p == 3 else 1))
            base = rnd.choice([version, version, version, version + 1, version - 1, rnd.randint(0, 9), None])
            if op == "create":
                ok, why = version == 0, "exists"
            elif version == 0 or deleted:
                ok, why = False, "gone"
            else:
                ok, why = op == "delete" or base == version, "stale"
            if ok:
                version, deleted = version + 1, op == "delete"
            reqs.append((p, 10 * s, op, base))
            want.append((p, 10 * s, "accepted" if ok else why, version))
    assert max(v for *_, v in want) > 100 and {w[2] for w in want} == {"accepted", "exists", "gone", "stale"}
    df = spark.createDataFrame(reqs, "project_id bigint, seq bigint, op string, base_version bigint").repartition(5)
    got = ver.replay_saves(df)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
    assert ver.replay_saves(df.limit(0)).count() == 0


def test_links_and_tenants(spark):
    cmd = spark.createDataFrame([("a", "make", 1, at(1)), ("a", "revoke", 2, at(2)), ("a", "revoke", 1, at(3)), ("a", "revoke", 1, at(4)), ("b", "make", None, at(1)), ("b", "adopt", 2, at(2))], "token string, op string, org_id int, ts timestamp")
    got = {r.token: (r.org_id, r.revoked_at) for r in ver.link_states(cmd).collect()}
    assert got == {"a": (1, at(3)), "b": (2, None)}
    members = spark.createDataFrame([(1, "ann"), (2, "bob")], "org_id int, user_id string")
    rows = spark.createDataFrame([(1, "p"), (2, "q")], "org_id int, name string")
    assert [r.name for r in ver.visible(rows, members, "ann").collect()] == ["p"]
