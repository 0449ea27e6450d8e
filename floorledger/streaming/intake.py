"""Streaming forms of the change list: intake, current choices, debounced saves, live totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from floorledger.operators import changelist as cl
from floorledger.operators.ordered import previous
from floorledger.operators.windows import sessions

#: How late an edit or a frame may come; intake of buyer events knows no such limit.
LATE = "10 minutes"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Keyed state on the executors' disks, snapshots in the checkpoint: a batch looks up its own keys and reads nothing else.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Event files as they land; timestamps without a zone are read as UTC instants so that a watermark can follow them."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.parquet(path)
    return s.withColumn("created_at", F.col("created_at").cast("timestamp"))


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their keyed state in RocksDB, which ``transformWithState`` needs; the session's own setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    with state_on_disk(stream.sparkSession):
        return stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _AcceptOnce(StatefulProcessor):
    """State per id: that it is in. Of a batch's rows the first in the total order is accepted, if none was before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        first = None
        for r in rows:
            if first is None or (r["_t"], r["_h"]) < (first["_t"], first["_h"]):
                first = r
        self.seen.update((True,))
        yield Row(**{c: first[c] for c in first.__fields__ if c not in ("_t", "_h")})

    def close(self) -> None:
        pass


def accepted_once(good: DataFrame) -> DataFrame:
    """The first row of each id over the whole life of a stream, rows of a batch in the order (time, hash of the row)."""
    order = {"_t": F.coalesce(F.unix_micros("created_at"), F.lit(-(2**63))), "_h": F.xxhash64(*good.columns)}
    return good.withColumns(order).groupBy("id").transformWithState(_AcceptOnce(), good.schema, "Update", "None")


def intake(events: DataFrame, links: DataFrame, accepted_path: str, quarantine_path: str, checkpoint: str, kinds: tuple[str, ...] = ("comment", "selection")) -> StreamingQuery:
    """Accepted rows to one table, refused ones to another, each id accepted once, however late a row or a retry comes.

    The rules come first: an id refused once may be sent again validly, and a row without an id is refused. Which ids are
    in is keyed state without a watermark; a batch looks up its own ids, whatever the length of the history. Spark commits state
    and offsets together, and a batch that is replayed after a failure meets the state it met before and overwrites its own
    ``batch`` folder: at-least-once in, one copy out.
    """
    e = cl.ruled(events, links, kinds)
    good = accepted_once(e.where(F.col("rule").isNull()).drop("rule")).withColumn("verdict", F.lit("accepted"))
    bad = e.where(F.col("rule").isNotNull()).withColumnRenamed("rule", "verdict")

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        kept.where("verdict = 'accepted'").drop("verdict").write.mode("overwrite").parquet(f"{accepted_path}/batch={batch_id}")
        kept.where("verdict <> 'accepted'").write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        kept.unpersist()

    return _run(good.unionByName(bad), write, checkpoint)


def newest_choices(events: DataFrame) -> DataFrame:
    """Streaming newest row per (token, kind, ref): one struct of state per key (complete or update mode)."""
    order = F.struct((-F.unix_micros("created_at")).alias("t"), F.col("id"))
    g = events.groupBy(*cl.KEY).agg(F.min(F.struct(order.alias("o"), F.col("payload"))).alias("m"))
    return g.select(*cl.KEY, F.col("m.o.id").alias("id"), F.col("m.payload").alias("payload"))


def current_choice_updates(events: DataFrame) -> DataFrame:
    """Update-mode twin with explicit state: emits a key's row only when it changed."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        best = state.get if state.exists else None
        changed = False
        for pdf in batches:
            for t, i, p in zip(pdf.t, pdf.id, pdf.payload):
                if best is None or (-int(t), i) < (-best[0], best[1]):
                    best, changed = (int(t), i, p), True
        if changed:
            state.update(best)
            yield pd.DataFrame({"token": [key[0]], "kind": [key[1]], "ref": [key[2]], "id": [best[1]], "payload": [best[2]]})

    e = events.select(*cl.KEY, F.unix_micros("created_at").alias("t"), F.col("id").cast("bigint").alias("id"), "payload")
    types = dict(e.dtypes)
    out = f"token {types['token']}, kind string, ref string, id bigint, payload string"
    return e.groupBy(*cl.KEY).applyInPandasWithState(step, out, "t bigint, id bigint, payload string", "update", GroupStateTimeout.NoTimeout)


class _Changed(StatefulProcessor):
    """State per key: the snapshot sent last. A burst that ends with the same one is not sent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", "snap string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.sent.get() if self.sent.exists() else None
        for r in sorted(rows, key=lambda r: r["saved_at"]):
            if last is None or last[0] != r["_snap"]:
                last = (r["_snap"],)
                yield Row(**{c: r[c] for c in r.__fields__ if c not in ("_snap", "_key")})
        self.sent.update(last)

    def close(self) -> None:
        pass


def debounce_stream(edits: DataFrame, key: str, ts: str, snapshot: str, quiet: str = "2 seconds", late: str = LATE) -> DataFrame:
    """The last snapshot of each burst of changes once it has been quiet, unless it equals the one sent before it.

    Bursts close in order behind the watermark; what was sent last is keyed state, one snapshot a key. Start it in append mode
    within ``state_on_disk``.
    """
    s = edits.withWatermark(ts, late).groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.max_by(snapshot, ts).alias("snap"), F.max(ts).alias("saved_at"))
    s = s.select(key, "saved_at", "snap")
    # a key of its own brings a shuffle between the two stateful steps, which cannot share a task's state store
    keyed = s.withColumns({"_snap": F.col("snap").cast("string"), "_key": F.to_json(F.struct(key))})
    return keyed.groupBy("_key").transformWithState(_Changed(), s.schema, "Append", "None")


def debounced_saves(edits: DataFrame, key: str, ts: str, ident: str, snapshot: str, quiet: str) -> DataFrame:
    """Batch form: bursts end after ``quiet``, and a snapshot equal to the save before it is not sent."""
    gap = F.col(ts) > F.col(f"_prev.{ts}") + F.expr(f"interval {quiet}")
    s = sessions(edits, [key], [F.col(ts), F.col(ident)], gap, "burst")
    b = s.groupBy(key, "burst").agg(F.max(ts).alias("saved_at"), F.max_by(snapshot, F.struct(ts, ident)).alias("snap"))
    p = previous(b, [key], [F.col("saved_at")], F.struct("snap"), "_was")
    return p.where(F.col("_was").isNull() | ~F.col("_was.snap").eqNullSafe(F.col("snap"))).select(key, "saved_at", "snap")


class _Totals(StatefulProcessor):
    """State per link: its ids, the newest row about each thing and the running totals; a row moves them by what it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "id string", "yes boolean")
        self.newest = handle.getMapState("newest", "about string", "t bigint, id string, num bigint, choice int, note int, delta bigint")
        self.sums = handle.getValueState("sums", "rows bigint, choices bigint, total bigint, notes bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, choices, total, notes = self.sums.get() if self.sums.exists() else (0, 0, 0, 0)
        for r in rows:
            if self.ids.containsKey((r["id"],)):
                continue
            self.ids.updateValue((r["id"],), (True,))
            n += 1
            was = self.newest.getValue((r["about"],)) if self.newest.containsKey((r["about"],)) else None
            if was is not None and (-was[0], was[2], was[1]) < (-r["t"], r["num"], r["id"]):
                continue
            choices += r["choice"] - (was[3] if was else 0)
            notes += r["note"] - (was[4] if was else 0)
            total += r["choice"] * r["delta"] - (was[3] * was[5] if was else 0)
            self.newest.updateValue((r["about"],), (r["t"], r["id"], r["num"], r["choice"], r["note"], r["delta"]))
        self.sums.update((n, choices, total, notes))
        yield Row(token=key[0], rows=n, choices=choices, total_bdt=total, open_notes=notes)

    def close(self) -> None:
        pass


def live_totals(events: DataFrame, links: DataFrame, catalog: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Totals of the links a micro-batch touches, exact whatever the order of arrival: newest per thing, ties to the smaller id.

    A link's ids, newest rows and sums are keyed state, so a batch reads its own rows and their keys' state and no history. An
    id counts once; a retry carries its token. A price is the catalog's when the row arrives. Rows without an id or a token are left out.
    """
    p = F.from_json("payload", cl.PAYLOAD)
    live = ~F.coalesce(p["removed"], F.lit(False))
    chosen = F.col("kind") == "selection"
    numeric = dict(events.dtypes)["id"] in ("int", "bigint", "smallint")
    flat = events.where(F.col("id").isNotNull() & F.col("token").isNotNull()).select(
        "token", F.col("id").cast("string").alias("id"), (F.col("id") if numeric else F.lit(0)).cast("bigint").alias("num"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"),
        F.to_json(F.struct("kind", "ref")).alias("about"), (chosen & live).cast("int").alias("choice"), ((F.col("kind") == "comment") & live).cast("int").alias("note"), F.when(chosen, p["optionId"]).alias("option_id"), p["priceDeltaBdt"].alias("sent"),
    )
    rows = cl.with_price(flat.na.fill(0, ["choice", "note", "t"]), catalog).select("token", "id", "num", "t", "about", "choice", "note", "delta")
    types = dict(rows.dtypes)
    state = rows.groupBy("token").transformWithState(_Totals(), f"token {types['token']}, rows bigint, choices bigint, total_bdt bigint, open_notes bigint", "Update", "None")
    named = links.select("token", "unit_name")
    return _run(state, lambda batch, i: publish(named.join(batch, "token").select("token", "unit_name", "rows", "choices", "total_bdt", "open_notes"), i), checkpoint)


def slow_frame_stream(frames: DataFrame, ts: str = "ts", ms: str = "ms", late: str = LATE) -> DataFrame:
    """Windows of at least 45 frames whose median is over 35 ms, as they close."""
    g = frames.withWatermark(ts, late).groupBy("screen", F.window(ts, "1 minute", "15 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ms) <= 35.0).alias("fast"))
    return g.where((F.col("n") >= 45) & (F.col("fast") <= F.floor(F.col("n") / 2))).select("screen", F.col("w.start").alias("start"), "n")
