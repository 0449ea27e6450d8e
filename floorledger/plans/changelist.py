"""Queries: change list, finishes, tenancy and versions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from floorledger.functions import hashing, share
from floorledger.operators import changelist as cl
from floorledger.operators import finishes as fin
from floorledger.operators import versions as ver
from floorledger.plans import renderings as r
from floorledger.plans.registry import query
from floorledger.session import cut_lineage, ensure_checkpoint_dir
from floorledger.sources.tables import table
from floorledger.streaming import intake

NEWEST = """nw as (select *, row_number() over (partition by token, kind, k order by created_at desc, id) as rn from ev)"""


BY_LINK_SQL = f"""with {r.SQL_EVENTS}, {r.SQL_CATALOG}, {r.SQL_LINKS}, {NEWEST},
    priced as (select token, kind, removed,
        coalesce(c.delta, case when sent = floor(sent) then cast(sent as bigint) else 0 end) as delta
      from nw left join cat c on c.option_id = nw.k where rn = 1),
    t as (select token,
        sum(case when kind = 'selection' and not removed then delta else 0 end) as total,
        count(*) filter (where kind = 'selection' and not removed) as choices,
        count(*) filter (where kind = 'comment' and not removed) as notes from priced group by token),
    n as (select token, count(*) as n from ev group by token)
    select lk.token, unit_name, coalesce(n.n, 0) as rows, coalesce(choices, 0) as choices,
           cast(coalesce(total, 0) as bigint) as total_bdt, coalesce(notes, 0) as open_notes
    from lk left join t using (token) left join n using (token)"""


@query(
    "WIN-1_superseded",
    f"with {r.SQL_EVENTS}, {NEWEST} select id, token, kind, cast(k as varchar) as ref, rn > 1 as superseded from nw",
)
def superseded(spark, base):
    return cl.superseded(r.buyer_events(spark, base)).select("id", "token", "kind", "ref", "superseded")


@query(
    "AGG-1_by_link",
    BY_LINK_SQL,
)
def by_link(spark, base):
    return cl.by_link(r.share_links(spark, base), r.buyer_events(spark, base), r.option_catalog(spark, base))


@query(
    "STR-2_current_choice",
    f"""with {r.SQL_EVENTS}, {r.SQL_CATALOG}, nw as (
      select *, row_number() over (partition by token, kind, k order by created_at desc, id) as rn from ev where kind = 'selection')
    select token, cast(k as varchar) as ref, cast(k as varchar) as option_id,
      coalesce(c.delta, case when sent = floor(sent) then cast(sent as bigint) else 0 end) as delta
    from nw left join cat c on c.option_id = nw.k where rn = 1 and not removed""",
)
def current_choice(spark, base):
    return cl.current_choices(r.buyer_events(spark, base), r.option_catalog(spark, base))


@query(
    "AGG-2_display_names",
    f"""with {r.SQL_EVENTS} select buyer, coalesce(arg_max(name, (created_at, id)) filter (where trim(name) <> ''),
        concat('Buyer ', substr(buyer, 1, 4))) as who from ev group by buyer""",
)
def names(spark, base):
    ev = r.buyer_events(spark, base).withColumn("name", F.nullif(F.trim("name"), F.lit("")))
    return cl.display_names(ev)


DESCRIBED = """said as (select ev.*,
    case when kind = 'selection' then concat('Slot ', cast(k as varchar)) else 'Note' end as what,
    case when kind = 'selection' then coalesce(label, concat('Option ', cast(k as varchar)))
         when removed then 'Removed this note' else 'click' end as detail,
    case when kind = 'selection' then coalesce(brand, 'own') else '' end as brand,
    case when kind = 'selection' then coalesce(sku, 'own-sku') else '' end as sku,
    case when kind = 'selection' and not removed then
      coalesce(c.delta, case when sent = floor(sent) then cast(sent as bigint) else 0 end) end as delta_bdt
  from ev left join cat c on kind = 'selection' and c.option_id = ev.k)"""


@query(
    "FN-31_describe",
    f"with {r.SQL_EVENTS}, {r.SQL_CATALOG}, {DESCRIBED} select id, what, detail, brand, sku, delta_bdt from said",
)
def describe(spark, base):
    d = cl.describe(r.buyer_events(spark, base), r.option_catalog(spark, base))
    return d.select("id", "what", "detail", "brand", "sku", "delta_bdt")


@query(
    "SRC-13_change_rows",
    f"""with {r.SQL_EVENTS}, {r.SQL_CATALOG}, {r.SQL_LINKS}, {DESCRIBED}, {NEWEST},
    w as (select buyer, coalesce(arg_max(name, (created_at, id)) filter (where trim(name) <> ''), concat('Buyer ', substr(buyer, 1, 4))) as who from ev group by buyer)
    select said.id, strftime(said.created_at, '%Y-%m-%dT%H:%M:%S') as "When", unit_name as "Unit",
      concat('https://x.test/s/', cast(said.token as varchar)) as "Link", who as "Who", said.buyer as "Buyer id",
      case when said.kind = 'selection' then 'Finish choice' else 'Note' end as "Type", what as "What", detail as "Comment / choice",
      brand as "Brand", sku as "SKU", delta_bdt as "BDT delta", case when rn > 1 then 'yes' else 'no' end as "Superseded"
    from said join nw on nw.id = said.id join w on w.buyer = said.buyer left join lk on lk.token = said.token""",
)
def change_rows(spark, base):
    ev = r.buyer_events(spark, base).withColumn("name", F.nullif(F.trim("name"), F.lit("")))
    rows = cl.change_rows(ev, r.share_links(spark, base), r.option_catalog(spark, base), "https://x.test")
    return rows.withColumn("When", F.substring("When", 1, 19)).drop("created_at")


@query(
    "SRC-14_ingest",
    f"""with {r.SQL_EVENTS}, {r.SQL_LINKS}, req as (
      select id, token, kind, k, name, removed, created_at from ev
      union all select id, token, kind, k, name, removed, created_at + interval 1 minute from ev where removed
      union all select id, token, kind, k, concat(name, '!'), removed, created_at from ev where removed
      union all select id, token, 'nonsense', k, name, removed, created_at - interval 1 minute from ev where removed),
    ruled as (select req.*, case
        when not exists (select 1 from lk where lk.token = req.token and revoked is null) then 'no such link, or it was turned off'
        when kind not in ('selection') then 'kind' end as rule from req),
    f as (select *, row_number() over (partition by id, rule is null order by created_at, name) as turn from ruled)
    select id, created_at, coalesce(rule, case when turn = 1 then 'accepted' else 'repeat' end) as verdict from f""",
)
def ingest(spark, base):
    ev = r.buyer_events(spark, base)
    again = ev.where(F.get_json_object("payload", "$.removed") == "true").withColumn("created_at", F.col("created_at") + F.expr("interval 1 minute"))
    gone = ev.where(F.get_json_object("payload", "$.removed") == "true")
    tied = gone.withColumn("name", F.concat("name", F.lit("!")))
    early = gone.withColumn("kind", F.lit("nonsense")).withColumn("created_at", F.col("created_at") - F.expr("interval 1 minute"))
    out = cl.ingest(ev.unionByName(again).unionByName(tied).unionByName(early), r.share_links(spark, base), kinds=("selection",))
    return out.select("id", "created_at", "verdict")


# ---- streams run to the end of what has landed --------------------------------------------------------------------------

BATCHES = 4


def _landed(requests, batch):
    """The rows as files of a stream's folder, one a batch number, landed one after the other."""
    path = f"{ensure_checkpoint_dir(requests.sparkSession)}/landed-{uuid.uuid4().hex}"
    rows = cut_lineage(requests.withColumn("_b", batch))
    for n in range(BATCHES):
        rows.where(F.col("_b") == n).drop("_b").coalesce(1).write.mode("append").parquet(path)
    spark = requests.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path, intake.event_stream(spark, f"{path}", spark.read.parquet(path).schema, 1)


def _resent(spark, base):
    """Each event in a batch of its own third; taken-back ones are first sent with a kind that is refused, and again two times after."""
    ev = r.buyer_events(spark, base)
    gone = ev.where(F.get_json_object("payload", "$.removed") == "true")
    third = F.col("id") % 3
    sends = [
        (ev, third + 1), (gone.withColumn("kind", F.lit("nonsense")), third), (gone.withColumn("created_at", F.col("created_at") + F.expr("interval 1 minute")), F.lit(3)),
        (gone.withColumn("name", F.lit("!")), third + 1), (ev.where("id % 50 = 0").withColumn("id", F.lit(None).cast("bigint")), F.lit(0)),
    ]
    parts = [d.withColumn("_b", b.cast("int")) for d, b in sends]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _landed(out.withColumnRenamed("_b", "_n"), F.col("_n"))


@query(
    "STR-1_4_intake",
    f"""with {r.SQL_EVENTS}, {r.SQL_LINKS}, req as (
      select id, token, kind, created_at, true as first from ev
      union all select id, token, 'nonsense', created_at, false from ev where removed
      union all select id, token, kind, created_at + interval 1 minute, false from ev where removed
      union all select id, token, kind, created_at, false from ev where removed
      union all select null, token, kind, created_at, false from ev where id % 50 = 0),
    ruled as (select req.*, case when not exists (select 1 from lk where lk.token = req.token and revoked is null) then 'no such link, or it was turned off' when id is null then 'id' when kind not in ('selection') then 'kind' end as rule from req)
    select id, created_at, coalesce(rule, 'accepted') as verdict from ruled where rule is not null or first""",
)
def stream_intake(spark, base):
    """Resends and refusals over four micro-batches: what the stream accepts and what it sets aside."""
    path, events = _resent(spark, base)
    out = {k: f"{path}-{k}" for k in ("in", "aside", "state")}
    intake.intake(events.drop("_n"), r.share_links(spark, base), out["in"], out["aside"], out["state"], kinds=("selection",)).awaitTermination()
    ok = spark.read.parquet(out["in"]).select("id", "created_at", F.lit("accepted").alias("verdict"))
    return ok.unionByName(spark.read.parquet(out["aside"]).select("id", "created_at", "verdict")).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("STR-6_live_totals", BY_LINK_SQL)
def stream_totals(spark, base):
    """The change list's totals as a stream leaves them after four micro-batches with repeats, beside the links it never touched."""
    ev = r.buyer_events(spark, base)
    path, events = _landed(ev.unionByName(ev.where("id % 7 = 0")), F.col("id") % BATCHES)
    view = f"{path}-view"
    intake.live_totals(events, r.share_links(spark, base), r.option_catalog(spark, base), lambda df, i: df.withColumn("at", F.lit(i)).write.mode("overwrite").parquet(f"{view}/batch={i}"), f"{path}-state").awaitTermination()
    last = spark.read.parquet(view).groupBy("token").agg(F.max(F.struct("at", "rows", "choices", "total_bdt", "open_notes")).alias("m")).select("token", "m.*").drop("at")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("rows", "choices", "total_bdt", "open_notes")]
    return r.share_links(spark, base).join(last, "token", "left").select("token", "unit_name", *zero)


@query(
    "JOIN-24_tombstones",
    f"""with {r.SQL_EVENTS} select id, token, cast(k as varchar) as ref from ev e
      where not exists (select 1 from ev x where x.kind = 'comment' and x.removed and x.token = e.token and x.k = e.k)""",
)
def tombstones(spark, base):
    ev = r.buyer_events(spark, base).withColumn("key", F.concat_ws("/", F.col("token").cast("string"), "ref"))
    gone = ev.where((F.col("kind") == "comment") & (F.get_json_object("payload", "$.removed") == "true"))
    return cl.live_rows(ev, gone, "key").select("id", "token", "ref")


LINES = """ln as (select l_orderkey as token, l_linenumber as slot, l_partkey as option_id, l_extendedprice as sent, l_suppkey as sup from lineitem)"""


@query(
    "JOIN-17_catalog_price",
    f"""with {r.SQL_CATALOG}, {LINES} select token, slot, ln.option_id, sup, sent,
      coalesce(cat.delta, case when sent = floor(sent) then cast(sent as bigint) else 0 end) as delta
      from ln left join cat on cat.option_id = ln.option_id""",
)
def catalog_price(spark, base):
    li = table(spark, base, "lineitem")
    c = li.select(
        F.col("l_orderkey").alias("token"), F.col("l_linenumber").alias("slot"), F.col("l_partkey").cast("string").alias("option_id"),
        F.col("l_suppkey").alias("sup"), F.col("l_extendedprice").alias("sent"),
    )
    return cl.with_price(c, r.option_catalog(spark, base)).select("token", "slot", F.col("option_id").cast("bigint").alias("option_id"), "sup", "sent", "delta")


@query(
    "FN-32_selection_payload",
    f"""with o as (select p_size as slot, p_partkey as opt, p_name as label, p_brand as brand, cast(floor(p_retailprice) as bigint) as delta from part),
    ch as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        case when l_returnflag = 'R' then null else l_partkey end as opt,
        case when l_linestatus = 'O' then concat(case when l_returnflag = 'R' then 'wall:' else 'room:' end, cast(l_linenumber as varchar)) end as key,
        (select p_size from part where p_partkey = l_partkey) as slot from lineitem)
    select l_orderkey, l_linenumber, l_suppkey, l_extendedprice, cast(ch.slot as varchar) as slot,
      coalesce(cast(ch.opt as varchar), '') as option_id,
      case when ch.opt is null then case when key like 'wall:%' then 'Same as the room' else 'Same as the group' end else o.label end as label,
      case when ch.opt is null then '' else o.brand end as brand,
      case when ch.opt is null then 0 else o.delta end as delta, ch.opt is null as removed
    from ch left join o on o.slot = ch.slot and o.opt = ch.opt
    where case when ch.opt is null then key is not null else o.opt is not null end""",
)
def selection_payload(spark, base):
    p = table(spark, base, "part")
    options = p.select(
        F.col("p_size").cast("string").alias("slot_id"), F.concat(F.lit("Slot "), F.col("p_size").cast("string")).alias("slot_label"), F.col("p_partkey").cast("string").alias("option_id"),
        F.col("p_name").alias("label"), F.col("p_brand").alias("brand"), F.lit("").alias("sku"), F.floor("p_retailprice").cast("bigint").alias("delta"),
    )
    li = table(spark, base, "lineitem").join(p.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    back = F.col("l_returnflag") == "R"
    key = F.when(F.col("l_linestatus") == "O", F.concat(F.when(back, "wall:").otherwise("room:"), F.col("l_linenumber").cast("string")))
    ch = li.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.col("p_size").cast("string").alias("slot_id"),
        F.when(~back, F.col("l_partkey").cast("string")).alias("option_id"), key.alias("key"), key.alias("scope"),
    )
    out = cl.selection_payload(ch, options).withColumn("p", F.from_json("payload", cl.PAYLOAD))
    return out.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.col("p.slotId").alias("slot"), F.col("p.optionId").alias("option_id"),
        F.col("p.label").alias("label"), F.col("p.brand").alias("brand"), F.col("p.priceDeltaBdt").cast("bigint").alias("delta"), F.coalesce("p.removed", F.lit(False)).alias("removed"),
    )


# ---- finishes -----------------------------------------------------------------------------------------------------
# unit = customer order, slots 1..7 = line numbers, options = parts grouped by size into slots, one choice per line

SQL_FIN = """opt as (select 1 + p_size % 7 as slot, p_partkey as opt, cast(floor(p_retailprice) as bigint) as delta from part),
  def as (select slot, min(opt) as d from opt group by slot),
  sl as (select o_orderkey as unit, slot, d from orders, def),
  ch0 as (select l_orderkey as unit, case when l_linestatus = 'O' then concat('room:', cast(l_linenumber as varchar)) else cast(l_linenumber as varchar) end as key, l_partkey as opt, l_suppkey from lineitem),
  ch as (select unit, key, max(opt) as opt from ch0 group by unit, key)"""


def _finish_tables(spark, base):
    p = table(spark, base, "part")
    options = p.select((1 + F.col("p_size") % 7).cast("string").alias("slot_id"), F.col("p_partkey").cast("bigint").alias("option_id"), F.floor("p_retailprice").cast("bigint").alias("delta"))
    defaults = options.groupBy("slot_id").agg(F.min("option_id").alias("default_option_id"))
    units = table(spark, base, "orders").select(F.col("o_orderkey").alias("unit_id"))
    slots = units.withColumn("slot_id", F.explode(F.array(*[F.lit(str(i)) for i in range(1, 8)]))).join(F.broadcast(defaults), "slot_id")
    n = F.col("l_linenumber").cast("string")
    choices = (
        table(spark, base, "lineitem")
        .select(F.col("l_orderkey").alias("unit_id"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("room:"), n)).otherwise(n).alias("key"), F.col("l_partkey").alias("option_id"))
        .groupBy("unit_id", "key").agg(F.max("option_id").alias("option_id"))
    )
    return slots, options, choices


@query(
    "AGG-3_options_total",
    f"""with {SQL_FIN}, picked as (select sl.unit, coalesce(opt.delta, 0) as d from sl left join ch on ch.unit = sl.unit and ch.key = cast(sl.slot as varchar)
      left join opt on opt.slot = sl.slot and opt.opt = coalesce(ch.opt, sl.d)),
    own as (select ch.unit, opt.delta as d from ch join opt on opt.opt = ch.opt where ch.key like 'room:%')
    select unit as unit_id, cast(sum(d) as bigint) as total from (select * from picked union all select * from own) group by unit""",
)
def options_total(spark, base):
    slots, options, choices = _finish_tables(spark, base)
    return fin.options_total(slots, options, choices)


@query(
    "JOIN-25_resolve_finish",
    f"""with {SQL_FIN}, f as (select sl.*, concat('room:', cast(slot as varchar)) as rk, cast(slot as varchar) as gk from sl),
    v as (select ch.unit, ch.key, opt.slot, ch.opt from ch join opt on opt.opt = ch.opt)
    select f.unit as unit_id, f.gk as slot_id, coalesce(a.opt, b.opt, f.d) as option_id,
      case when a.opt is not null then 'room' when b.opt is not null then 'slot' else 'default' end as chosen_by
    from f left join v a on a.unit = f.unit and a.key = f.rk and a.slot = f.slot left join v b on b.unit = f.unit and b.key = f.gk and b.slot = f.slot""",
)
def resolve(spark, base):
    slots, options, choices = _finish_tables(spark, base)
    faces = slots.select("unit_id", "slot_id", F.lit(None).cast("string").alias("wall_key"), F.concat(F.lit("room:"), "slot_id").alias("room_key"), "default_option_id")
    return fin.resolve_finish(faces, choices, options).select("unit_id", "slot_id", "option_id", "chosen_by")


KINDS = ["bed", "study", "bath", "lobby", "lawn", "kitchen", "planter", "living"]


@query(
    "JOIN-26_slots_offered",
    f"""with kinds as (select * from (values {",".join(f"({i},'{k}')" for i, k in enumerate(KINDS))}) t(i, kind)),
    rm as (select l_orderkey as unit, l_linenumber as room, kind from lineitem join kinds on i = l_partkey % 8),
    lv as (select unit, bool_or(kind in ('lawn','lobby')) as lvl from rm group by unit),
    ck as (select p_size % 9 as slot, kind, p_type in ('LARGE','PROMO') as lvl from part join kinds on i = p_partkey % 8 group by all)
    select rm.unit as unit_id, slot as slot_id, count(distinct room) as rooms from rm join lv on lv.unit = rm.unit join ck on ck.kind = rm.kind and ck.lvl = lv.lvl group by rm.unit, slot""",
)
def slots_offered(spark, base):
    arr = F.array(*[F.lit(k) for k in KINDS])
    at = lambda c: F.get(arr, (F.col(c) % 8).cast("int"))
    rooms = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("room_id"), at("l_partkey").alias("kind"))
    kinds = table(spark, base, "part").select((F.col("p_size") % 9).alias("slot_id"), at("p_partkey").alias("kind"), F.col("p_type").isin("LARGE", "PROMO").alias("level")).distinct()
    return fin.slots_offered(rooms, kinds)


# ---- tenancy ------------------------------------------------------------------------------------------------------


@query(
    "JOIN-18_tenant_filter",
    """select o_orderkey, s_suppkey as user_id from orders join customer on c_custkey = o_custkey join supplier on s_nationkey = c_nationkey
       where s_suppkey in (select min(s_suppkey) from supplier group by s_nationkey)""",
)
def tenant_filter(spark, base):
    s = table(spark, base, "supplier")
    members = s.groupBy(F.col("s_nationkey").alias("org_id")).agg(F.min("s_suppkey").alias("user_id"))
    links = table(spark, base, "customer").select(F.col("c_custkey").alias("token"), F.col("c_nationkey").alias("org_id"))
    ev = table(spark, base, "orders").select("o_orderkey", F.col("o_custkey").alias("token")).join(links, "token")
    return ver.visible_by_member(ev, members).select("o_orderkey", "user_id")


@query(
    "JOIN-18_events_of_member",
    """select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey in (select s_nationkey from supplier where s_suppkey = 1))""",
)
def events_of_member(spark, base):
    members = table(spark, base, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("org_id"))
    links = table(spark, base, "customer").select(F.col("c_custkey").alias("token"), F.col("c_nationkey").alias("org_id"))
    ev = table(spark, base, "orders").select("o_orderkey", F.col("o_custkey").alias("token"))
    return ver.events_of_company(ev, links, members, 1).select("o_orderkey")


@query("JOIN-19_unit_by_token", "select o_orderkey as token, c_name from orders join customer on c_custkey = o_custkey where o_orderstatus <> 'F'")
def unit_by_token(spark, base):
    links = table(spark, base, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("unit_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"))
    units = table(spark, base, "customer").select(F.col("c_custkey").alias("unit_id"), "c_name")
    return ver.unit_by_token(links, units).select("token", "c_name")


@query(
    "TOP-1_live_projects",
    """with t as (select c_custkey as project_id, c_nationkey as org_id, max(o_orderdate) as updated_at from customer join orders on o_custkey = c_custkey where c_acctbal >= 0 group by all)
       select *, row_number() over (order by updated_at desc, project_id) as place from t""",
)
def live_projects(spark, base):
    from floorledger.operators.ordered import global_rank

    c = table(spark, base, "customer").where(F.col("c_acctbal") >= 0)
    o = table(spark, base, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("updated_at"))
    live = c.join(o, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("org_id"), "updated_at")
    return global_rank(live, [F.col("updated_at").desc(), F.col("project_id").asc()], "place")


# ---- versions: orders of one customer are the saves of one project --------------------------------------------------

SQL_SAVES = """rq as (select o_custkey as project_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as seq,
    o_orderkey, o_orderdate, o_totalprice, case when o_orderkey % 5 = 0 then 2 else 1 end as back, case when o_orderkey % 31 = 0 then 'delete' else 'save' end as op from orders)"""
SQL_REPLAY = """with recursive """ + SQL_SAVES + """, st(project_id, seq, verdict, version, dead) as (
   select project_id, seq, 'accepted', 1, false from rq where seq = 1
   union all select rq.project_id, rq.seq, case when dead then 'gone' when rq.op = 'delete' or rq.seq - rq.back = st.version then 'accepted' else 'stale' end,
     st.version + case when not dead and (rq.op = 'delete' or rq.seq - rq.back = st.version) then 1 else 0 end, dead or rq.op = 'delete'
   from st join rq on rq.project_id = st.project_id and rq.seq = st.seq + 1)"""


def _saves(spark, base):
    """Requests with their place in the project's order; places are ranks."""
    from floorledger.operators.ordered import rank_in_group

    o = table(spark, base, "orders").select(F.col("o_custkey").alias("project_id"), "o_orderkey", "o_orderdate", "o_totalprice")
    o = rank_in_group(o, ["project_id"], [F.col("o_orderdate"), F.col("o_orderkey")], name="seq")
    back = F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1)
    return o.withColumn("op", F.when(F.col("seq") == 1, "create").when(F.col("o_orderkey") % 31 == 0, "delete").otherwise("save")).withColumn("base_version", F.col("seq") - back)


@query("VER-1_replay_saves", SQL_REPLAY + " select project_id, seq, verdict, cast(version as bigint) as version from st")
def replay(spark, base):
    return ver.replay_saves(_saves(spark, base))


@query(
    "VER-2_history",
    SQL_REPLAY + " select st.project_id, cast(st.version as bigint) as version, rq.o_orderkey, rq.op = 'delete' and rq.seq > 1 as deleted from st join rq on rq.project_id = st.project_id and rq.seq = st.seq where verdict = 'accepted'",
)
def history(spark, base):
    rq = _saves(spark, base)
    return ver.history(rq, ver.replay_saves(rq)).select("project_id", "version", "o_orderkey", "deleted")


SQL_VERS = """vs as (select o_custkey as project_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version, o_orderkey, o_orderstatus = 'F' as deleted from orders)"""


def _versions(spark, base):
    from floorledger.operators.ordered import rank_in_group

    o = table(spark, base, "orders").select(F.col("o_custkey").alias("project_id"), "o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("deleted"))
    return rank_in_group(o, ["project_id"], [F.col("o_orderdate"), F.col("o_orderkey")], name="version").drop("o_orderdate")


@query(
    "WIN-13_newest_versions",
    f"with {SQL_VERS}, t as (select *, max(version) over (partition by project_id) - version as age from vs) select project_id, version, o_orderkey from t where age < 50",
)
def newest_versions(spark, base):
    return ver.newest_versions(_versions(spark, base), limit=50).select("project_id", "version", "o_orderkey")


@query(
    "VER-3_soft_delete",
    f"with {SQL_VERS} select project_id, max(version) as version, arg_max(o_orderkey, version) as o_orderkey from vs group by project_id having not arg_max(deleted, version)",
)
def soft_delete(spark, base):
    return ver.current_projects(_versions(spark, base), "o_orderkey")


SQL_CMD = """cmd as (select o_custkey as token, case when o_orderstatus = 'F' then 'make' when o_orderstatus = 'O' then 'revoke' else 'adopt' end as op,
   case when o_orderstatus = 'F' and o_orderkey % 3 = 0 then null else o_orderkey % 4 end as org_id, o_orderdate + to_seconds(cast(o_orderkey as bigint)) as ts from orders)"""


@query(
    "VER-4_link_states",
    f"""with {SQL_CMD}, mk as (select token, min(ts) as created_at from cmd where op = 'make' group by token),
    mo as (select token, arg_min_null(org_id, ts) as o from cmd where op = 'make' group by token),
    ad as (select token, arg_min(org_id, ts) as o from cmd where op = 'adopt' group by token),
    ow as (select mk.token, coalesce(mo.o, ad.o) as org_id, created_at from mk join mo using (token) left join ad using (token))
    select ow.token, ow.org_id, created_at, min(c.ts) as revoked_at from ow left join cmd c on c.op = 'revoke' and c.token = ow.token and c.org_id = ow.org_id group by all""",
)
def link_states(spark, base):
    o = table(spark, base, "orders")
    op = F.when(F.col("o_orderstatus") == "F", "make").when(F.col("o_orderstatus") == "O", "revoke").otherwise("adopt")
    cmd = o.select(
        F.col("o_custkey").alias("token"), op.alias("op"),
        F.when(~((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0)), F.col("o_orderkey") % 4).alias("org_id"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey").cast("decimal(18,6)"))).alias("ts"),
    )
    return ver.link_states(cmd)


@query(
    "VER-5_memberships",
    "select o_custkey as org_id, o_orderkey % 3 as user_id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as role from orders group by o_custkey, o_orderkey % 3",
)
def memberships(spark, base):
    log = table(spark, base, "orders").select(F.col("o_custkey").alias("org_id"), (F.col("o_orderkey") % 3).alias("user_id"), F.col("o_orderpriority").alias("role"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))
    return ver.memberships(log)


@query(
    "VER-6_answer_agreement",
    """with a as (select o_custkey as row_id, c_mktsegment as row_kind, case when o_orderkey % 2 = 0 then 'human' else 'model' end as who, o_orderstatus as answer, (o_orderdate, o_orderkey) as ts
      from orders join customer on c_custkey = o_custkey),
    l as (select row_id, row_kind, arg_max(answer, ts) filter (where who = 'human') as h, arg_max(answer, ts) filter (where who = 'model') as m from a group by all)
    select row_kind, count(h) as human, count(m) as model, count(*) filter (where h is not null and m is not null) as both, count(*) filter (where h = m) as agree from l group by row_kind""",
)
def answers(spark, base):
    o = table(spark, base, "orders").join(table(spark, base, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = o.select(F.col("o_custkey").alias("row_id"), F.col("c_mktsegment").alias("row_kind"), F.when(F.col("o_orderkey") % 2 == 0, "human").otherwise("model").alias("by"), F.col("o_orderstatus").alias("answer"), F.struct("o_orderdate", "o_orderkey").alias("ts"))
    return ver.answer_agreement(a)


@query(
    "SET-2_changed_units",
    "select doc_id as unit_id from documents where rtrim(text, ' .') || '.' <> text",
)
def changed_units(spark, base):
    d = table(spark, base, "documents").select(F.col("doc_id").alias("unit_id"), F.col("text").alias("document"))
    return ver.changed_units(d, d.withColumn("document", F.concat(F.rtrim("document", F.lit(" .")), F.lit("."))))


@query(
    "FN-17_content_hash",
    """select doc_id, concat(length(text), ':', printf('%x', list_reduce(list_transform(string_split(text, ''), lambda c: cast(ord(c) as bigint)),
      lambda h, c: (xor(h, c) * 16777619) & 4294967295, cast(2166136261 as bigint)))) as hash from documents""",
)
def content_hash(spark, base):
    return table(spark, base, "documents").select("doc_id", hashing.fnv1a(F.col("text")).alias("hash"))


@query(
    "FN-16_format_taka",
    """with n as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice * 100) as bigint) - 2000000 as n from lineitem),
    s as (select *, cast(abs(n) as varchar) as s from n),
    h as (select *, case when length(s) > 3 then left(s, length(s) - 3) else '' end as h from s),
    g as (select *, case when length(h) <= 2 then h when length(h) <= 4 then left(h, length(h)-2) || ',' || right(h, 2)
       else left(h, length(h)-4) || ',' || substr(h, length(h)-3, 2) || ',' || right(h, 2) end as gh from h)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, n, case when n = 0 then 'Included' else concat(case when n > 0 then '+' else '−' end, '৳', case when length(s) <= 3 then s else gh || ',' || right(s, 3) end) end as delta from g""",
)
def taka(spark, base):
    li = table(spark, base, "lineitem").withColumn("n", F.floor(F.col("l_extendedprice") * 100).cast("bigint") - 2000000)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n", share.format_delta(F.col("n")).alias("delta"))


@query(
    "SRC-10_encode_config",
    """select p_partkey, concat('https://x.test/u?', case when p_size > 25 then concat('floor=', cast(p_size as varchar), '&') else '' end, 'c=',
      rtrim(replace(replace(base64(encode('{"s_floor":"' || p_name || '","s_wall":"' || p_brand || '"}')), '+', '-'), '/', '_'), '=')) as url from part""",
)
def encode_config(spark, base):
    cfg = F.create_map(F.lit("s_floor"), F.col("p_name"), F.lit("s_wall"), F.col("p_brand"))
    url = share.share_url(F.lit("https://x.test"), F.lit("/u"), F.when(F.col("p_size") > 25, F.col("p_size")), cfg)
    return table(spark, base, "part").select("p_partkey", url.alias("url"))


@query(
    "SRC-9_decode_config",
    """select p_partkey, 's_floor' as slot, p_name as option from part where p_type <> 'PROMO' and p_name not like 'red%' union all
       select p_partkey, 's_wall', p_brand from part where p_type <> 'PROMO'""",
)
def decode_config(spark, base):
    """Round trip with malformed links (every PROMO part) and options that are not in the catalog (red ones)."""
    p = table(spark, base, "part")
    cfg = F.create_map(F.lit("s_floor"), F.col("p_name"), F.lit("s_wall"), F.col("p_brand"), F.lit("unknown"), F.col("p_type"))
    code = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("%"), F.col("p_name"))).otherwise(share.encode_config(cfg))
    rows = p.select("p_partkey", F.explode(share.decode_config(code)).alias("slot", "option"))
    names = p.where(~F.col("p_name").startswith("red")).select(F.lit("s_floor").alias("slot"), F.col("p_name").alias("option"))
    catalog = names.unionByName(p.select(F.lit("s_wall").alias("slot"), F.col("p_brand").alias("option"))).distinct()
    return rows.join(catalog, ["slot", "option"], "left_semi").select("p_partkey", "slot", "option")
