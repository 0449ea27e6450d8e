"""Versioned projects and tenancy: saves, history, soft deletes, links, memberships, row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.functions.hashing import fingerprint
from floorledger.operators.ordered import Known, Ordered, Running, down
from floorledger.session import cut_lineage

HISTORY_LIMIT = 50


def replay_saves(requests: DataFrame) -> DataFrame:
    """Replay save requests in order: accepted only when the base version is the current one and it is not deleted.

    ``requests``: project_id, seq (total order within a project), op (create / save / delete), base_version.
    Returns project_id, seq, verdict (accepted / exists / gone / stale) and the version the project has after the request.

    Nothing is folded row by row. The first create and the first delete after it are always accepted, and rows outside the
    two are settled by running counts. In between, the save that follows version v is the first later save of base v: one ordered look-up per
    (project, version). That makes a graph in which every request has one successor; the accepted saves are the path from
    the create, marked by pointer doubling in rounds that grow with the log of the longest path. No step keys on the project alone
    without cutting it, so a project with a third of all rows is spread. A null base is stale.
    """
    k = ["project_id", "seq"]
    op = F.col("op")
    life = Ordered(requests.select(*k, "op", "base_version"), ["project_id"], [F.col("seq")]).add(_made=Running(F.when(op == "create", 1).otherwise(0)))
    life = life.add(_ended=Running(F.when((op == "delete") & (F.col("_made") >= 1), 1).otherwise(0)))
    rows = cut_lineage(life.result())
    made, ended = F.col("_made"), F.col("_ended")
    root, last = (op == "create") & (made == 1), (op == "delete") & (made >= 1) & (ended == 1)
    # requests between create and delete are nodes; one that yields version v looks for the first later save of base v
    saves = rows.where((op == "save") & (made >= 1) & (ended == 0) & F.col("base_version").isNotNull())
    roots = rows.where(root & (ended == 0)).select(*k, F.lit(1).cast("bigint").alias("v"), F.lit(True).alias("holds"), F.lit(True).alias("mark"))
    holders = roots.unionByName(saves.select(*k, (F.col("base_version") + 1).cast("bigint").alias("v"), F.lit(True).alias("holds"), F.lit(False).alias("mark")))
    askers = saves.select(*k, F.col("base_version").cast("bigint").alias("v"), F.lit(False).alias("holds"), F.lit(False).alias("mark"))
    ahead = Ordered(holders.unionByName(askers), ["project_id", "v"], [down(F.col("seq"))]).add(to=Known(F.when(~F.col("holds"), F.col("seq"))))
    path = _marked(ahead.result().where("holds").select(*k, "to", "mark"), k)
    hit = path.where("mark").select(*k, F.lit(True).alias("_on"))
    rows = rows.join(hit, k, "left").withColumn("_on", F.coalesce("_on", root | last))
    why = F.when(op == "create", "exists").when((made == 0) | (ended >= 1), "gone").otherwise("stale")
    verdict = F.when(F.col("_on"), "accepted").otherwise(why)
    counted = Ordered(rows, ["project_id"], [F.col("seq")]).add(version=Running(F.col("_on").cast("bigint")))
    return counted.result().select(*k, verdict.alias("verdict"), "version")


def _marked(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes (project_id, seq, to, mark) with every node marked that a path over ``to`` leads to from a marked one.

    Round by round a marked node marks the node 2ⁱ steps on and every pointer doubles, until no marked node has one.
    """
    s = cut_lineage(nodes)
    while s.where("mark and to is not null").limit(1).count():
        found = s.where("mark and to is not null").select("project_id", F.col("to").alias("seq")).distinct().withColumn("_hit", F.lit(True))
        far = s.select("project_id", F.col("seq").alias("to"), F.col("to").alias("_far"))
        j = s.join(far, ["project_id", "to"], "left").join(found, keys, "left")
        s = cut_lineage(j.select(*keys, F.col("_far").alias("to"), (F.col("mark") | F.col("_hit").isNotNull()).alias("mark")))
    return s


def history(requests: DataFrame, replayed: DataFrame) -> DataFrame:
    """The append-only history: one row per accepted request with its version and delete flag."""
    ok = replayed.where(F.col("verdict") == "accepted").select("project_id", "seq", "version")
    return requests.join(ok, ["project_id", "seq"]).withColumn("deleted", F.col("op") == "delete")


def newest_versions(versions: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The newest ``limit`` saves of each project.

    Versions are dense from 1, so the newest fifty are those above max − 50: an aggregate and a join, no ranked window.
    """
    top = versions.groupBy("project_id").agg(F.max("version").alias("_top"))
    return versions.join(top, "project_id").where(F.col("version") > F.col("_top") - limit).drop("_top")


def as_of(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored copy at a version (``wanted``: project_id, version)."""
    return versions.join(wanted, ["project_id", "version"], "left_semi")


def current_projects(versions: DataFrame, *kept: str) -> DataFrame:
    """The latest row per project; a soft-deleted one is not shown."""
    cols = F.struct("version", "deleted", *kept)
    return versions.groupBy("project_id").agg(F.max(cols).alias("r")).where(~F.col("r.deleted")).select("project_id", "r.version", *[f"r.{k}" for k in kept])


def link_states(commands: DataFrame) -> DataFrame:
    """Command log → one row per link: made, first revoke (for good), the company it belongs to.

    ``commands``: token, op (make / revoke / adopt), org_id, ts. A revoke by another company's member does nothing.
    """
    made = commands.where(F.col("op") == "make").groupBy("token").agg(F.min("ts").alias("created_at"), F.min_by("org_id", "ts").alias("made_org"))
    adopt = commands.where(F.col("op") == "adopt").groupBy("token").agg(F.min_by("org_id", "ts").alias("adopt_org"))
    owned = made.join(adopt, "token", "left").withColumn("org_id", F.coalesce("made_org", "adopt_org"))
    rev = commands.where(F.col("op") == "revoke").select("token", F.col("org_id").alias("_by"), F.col("ts").alias("_ts"))
    off = rev.groupBy("token", "_by").agg(F.min("_ts").alias("_ts"))
    return (
        owned.join(off.withColumnRenamed("token", "_tok"), (F.col("token") == F.col("_tok")) & (F.col("org_id") == F.col("_by")), "left")
        .select("token", "org_id", "created_at", F.col("_ts").alias("revoked_at"))
    )


def memberships(log: DataFrame) -> DataFrame:
    """Membership upsert: the last role per (org, user) wins. ``log``: org_id, user_id, role, ts, seq."""
    return log.groupBy("org_id", "user_id").agg(F.max_by("role", F.struct("ts", "seq")).alias("role"))


def visible(rows: DataFrame, members: DataFrame, user, org: str = "org_id") -> DataFrame:
    """The rows of the caller's companies."""
    mine = members.where(F.col("user_id") == user).select(F.col("org_id").alias("_m")).distinct()
    return rows.join(mine, F.col(org) == F.col("_m"), "left_semi")


def visible_by_member(rows: DataFrame, members: DataFrame, org: str = "org_id") -> DataFrame:
    """Every member beside the rows that member may read."""
    m = members.select("user_id", F.col("org_id").alias("_m")).distinct()
    return rows.join(m, F.col(org) == F.col("_m")).drop("_m")


def events_of_company(events: DataFrame, links: DataFrame, members: DataFrame, user) -> DataFrame:
    """Events a member may read: through links of the own companies."""
    mine = visible(links, members, user).select(F.col("token").alias("_t"))
    return events.join(mine, F.col("token") == F.col("_t"), "left_semi")


def unit_by_token(links: DataFrame, units: DataFrame) -> DataFrame:
    """A link that is on opens its unit."""
    return links.where(F.col("revoked_at").isNull()).join(units, "unit_id")


def changed_units(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Units whose stored copy differs from the copy at hand (compared by fingerprint)."""
    a = stored.select("unit_id", fingerprint(F.col("document")).alias("_was"))
    b = now.select("unit_id", fingerprint(F.col("document")).alias("_now"))
    return a.join(b, "unit_id").where(F.col("_was") != F.col("_now")).select("unit_id")


def answer_agreement(answers: DataFrame) -> DataFrame:
    """Answers kept apart by who gave them, and how often both agree per row kind.

    ``answers``: row_id, row_kind, by (human / model), answer, ts: the last answer of each side counts.
    """
    last = answers.groupBy("row_id", "row_kind").agg(
        F.max_by(F.when(F.col("by") == "human", F.col("answer")), F.when(F.col("by") == "human", F.col("ts"))).alias("human"),
        F.max_by(F.when(F.col("by") == "model", F.col("answer")), F.when(F.col("by") == "model", F.col("ts"))).alias("model"),
    )
    return last.groupBy("row_kind").agg(
        F.count("human").alias("human"), F.count("model").alias("model"),
        F.count_if(F.col("human").isNotNull() & F.col("model").isNotNull()).alias("both"),
        F.count_if(F.col("human") == F.col("model")).alias("agree"),
    )
