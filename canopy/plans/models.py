"""The content models that the repository queries run on, made of the test tables, with the same in SQL.

Every SQL prefix names common table expressions that hold the rows of the
DataFrame of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators.common import latest_rows
from canopy.operators.tree import derive_nodes, explode_values
from canopy.schema import VALUE_COLUMNS
from canopy.sources.tables import table

NODE_COLUMNS = ["parent_path", "name", "depth", "primary_type"]
PROPERTY_COLUMNS = ["property_type", "multiple", *VALUE_COLUMNS]


def _snapshot(spark: SparkSession, d: str, back: int):
    """Id of the newest snapshot, or of the one before it; a scalar subquery."""
    ids = table(spark, d, "journal_revisions").agg(F.reverse(F.array_sort(F.collect_set("snapshot_id"))).alias("s"))
    return ids.select(F.get("s", F.lit(back))).scalar()


def nodes(spark: SparkSession, d: str, back: int = 0) -> DataFrame:
    """Nodes of a snapshot: the newest, or ``back`` before it."""
    rows = table(spark, d, "node_rows").where(F.col("snapshot_id") == _snapshot(spark, d, back))
    return latest_rows(rows, ["path"], "delivered_at", NODE_COLUMNS)


def properties(spark: SparkSession, d: str, back: int = 0) -> DataFrame:
    rows = table(spark, d, "property_rows").where(F.col("snapshot_id") == _snapshot(spark, d, back))
    kept = latest_rows(rows, ["path", "name", "position"], "delivered_at", PROPERTY_COLUMNS)
    return kept.select("path", "name", "property_type", "multiple", "position", *VALUE_COLUMNS)


def all_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of all snapshots with ``snapshot_id``."""
    return latest_rows(table(spark, d, "node_rows"), ["snapshot_id", "path"], "delivered_at", NODE_COLUMNS)


def all_properties(spark: SparkSession, d: str) -> DataFrame:
    return latest_rows(table(spark, d, "property_rows"), ["snapshot_id", "path", "name", "position"], "delivered_at", PROPERTY_COLUMNS)


def _n(name: str, where: str) -> str:
    return f"{name} as (select * exclude (k, delivered_at) from (select *, row_number() over (partition by snapshot_id, path order by delivered_at desc) as k from node_rows {where}) where k = 1)"


def _p(name: str, where: str) -> str:
    return f"{name} as (select * exclude (k, delivered_at) from (select *, row_number() over (partition by snapshot_id, path, name, position order by delivered_at desc) as k from property_rows {where}) where k = 1)"


_AT = "where snapshot_id = (select snapshot_id from (select distinct snapshot_id from journal_revisions) order by 1 desc limit 1 offset {0})"
TREE_SQL = f"with {_n('n', _AT.format(0))}, {_p('p', _AT.format(0))}"
PAIR_SQL = f"{TREE_SQL}, {_n('n0', _AT.format(1))}, {_p('p0', _AT.format(1))}"
ALL_SQL = f"with {_n('n', '')}, {_p('p', '')}"


# -- segments, archives and references, of orders, parts and their lines

YEAR_ZERO, ARCHIVES = 1995, 50


def _uuid(key, kind: str):
    """An identifier made of a key, with the digit of its kind."""
    h = F.md5(F.concat(F.lit(kind), key.cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit(f"-{kind}"), part(18, 3), F.lit("-"), part(21, 12))


def _uuid_sql(key: str, kind: str) -> str:
    h = f"md5('{kind}' || {key})"
    return f"({h}[1:8] || '-' || {h}[9:12] || '-4' || {h}[14:16] || '-{kind}' || {h}[18:20] || '-' || {h}[21:32])"


def _data_segments(orders: DataFrame) -> DataFrame:
    year = F.year("o_orderdate") - YEAR_ZERO
    return orders.select(
        _uuid(F.col("o_orderkey"), "a").alias("segment"), F.lit("data").alias("kind"), F.format_string("data%05da.tar", F.col("o_orderkey") % ARCHIVES).alias("archive"), F.col("o_orderkey").alias("position"),
        F.floor("o_totalprice").cast("bigint").alias("size"), year.alias("generation"), F.floor(year / 2).cast("int").alias("full_generation"), (F.col("o_orderstatus") == "F").alias("is_compacted"),
    )


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Data segments are orders, bulk segments parts."""
    data = _data_segments(table(spark, d, "orders"))
    bulk = table(spark, d, "part").select(
        _uuid(F.col("p_partkey"), "b").alias("segment"), F.lit("bulk").alias("kind"), F.format_string("data%05da.tar", F.col("p_partkey") % ARCHIVES).alias("archive"), (-1 - F.col("p_partkey")).alias("position"),
        (F.col("p_size") * 1000).cast("bigint").alias("size"), F.lit(0).alias("generation"), F.lit(0).alias("full_generation"), F.lit(False).alias("is_compacted"),
    )
    return data.unionByName(bulk)


def references(spark: SparkSession, d: str) -> DataFrame:
    """Data segments refer to bulk segments."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return lines.select(_uuid(F.col("l_orderkey"), "a").alias("source"), _uuid(F.col("l_partkey"), "b").alias("target"))


def chain(spark: SparkSession, d: str) -> DataFrame:
    """Data segments refer to data segments: each order to that of a third of its key."""
    return table(spark, d, "orders").where("o_orderkey > 0").select(_uuid(F.col("o_orderkey"), "a").alias("source"), _uuid(F.floor(F.col("o_orderkey") / 3).cast("bigint"), "a").alias("target"))


def head(spark: SparkSession, d: str) -> DataFrame:
    """The head segment: the newest order's."""
    orders = table(spark, d, "orders")
    newest = orders.agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("m.o_orderkey")
    return _data_segments(orders.join(F.broadcast(newest), "o_orderkey", "left_semi"))


HEAD_KEY_SQL = "(select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 1)"


SEGMENTS_SQL = f"""with s as (
  select {_uuid_sql("o_orderkey", "a")} as segment, 'data' as kind, printf('data%05da.tar', o_orderkey % {ARCHIVES}) as archive, o_orderkey as position, floor(o_totalprice)::bigint as size,
    (year(o_orderdate) - {YEAR_ZERO})::int as generation, floor((year(o_orderdate) - {YEAR_ZERO}) / 2)::int as full_generation, o_orderstatus = 'F' as is_compacted from orders
  union all select {_uuid_sql("p_partkey", "b")}, 'bulk', printf('data%05da.tar', p_partkey % {ARCHIVES}), -1 - p_partkey, (p_size * 1000)::bigint, 0, 0, false from part),
 r as (select distinct {_uuid_sql("l_orderkey", "a")} as source, {_uuid_sql("l_partkey", "b")} as target from lineitem),
 h as (select * from s where segment = {_uuid_sql(HEAD_KEY_SQL, "a")})"""


# -- version histories and checkpoints

STORAGE = "/jcr:system/jcr:versionStorage"


def _history(key):
    """Name and path of the history of an order."""
    name = F.when(key % 97 == 0, F.concat(F.lit("broken-"), key.cast("string"))).otherwise(_uuid(key, "8"))
    return name, F.concat(F.lit(STORAGE + "/"), F.substring(F.md5(key.cast("string")), 1, 2), F.lit("/"), F.substring(F.md5(key.cast("string")), 3, 1), F.lit("/"), name)


def histories(spark: SparkSession, d: str) -> DataFrame:
    """An order is a history below two intermediate nodes; every 97th has a malformed name."""
    key = F.col("o_orderkey")
    name, path = _history(key)
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    o = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    return o.select(
        name.alias("history"), path.alias("path"),
        F.when(key % 13 != 0, F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("newest"), F.floor("o_totalprice").cast("bigint").alias("bytes"),
        (F.coalesce("lines", F.lit(0)) + 1).cast("bigint").alias("nodes"), (F.col("o_orderpriority") == "1-URGENT").alias("configuration"), key.alias("key"),
    )


def live(spark: SparkSession, d: str) -> DataFrame:
    """Orders that no customer in debt holds are live."""
    customers = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(customers, "o_custkey", "left_semi").select(_uuid(F.col("o_orderkey"), "8").alias("identifier"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """References from lines of few pieces to the history of their order, upper case now and then."""
    u = _uuid(F.col("l_orderkey"), "8")
    return table(spark, d, "lineitem").where("l_quantity <= 2").select(F.when(F.col("l_linenumber") == 1, F.upper(u)).otherwise(u).alias("value"))


def version_storage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and properties of the histories: each line of an order is a version with a date, a binary and a frozen node.

    Both have the order's ``key`` and are partitioned by it: a history's path is made
    once an order, and lines of the same number are one version within their partition.
    """
    no = F.lit(None).cast("bigint")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderpriority") == "1-URGENT").alias("configuration"), _history(F.col("o_orderkey"))[1].alias("h"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_shipdate", "l_quantity").join(orders, "key")
    at = F.concat("h", F.lit("/v"), "l_linenumber")
    frozen = F.concat(at, F.lit("/frozen"))
    node = lambda df, path, kind: df.select("key", path.alias("path"), F.lit(kind).alias("primary_type"))
    versions = lines.select("key", "h", "l_linenumber").distinct()
    entities = node(orders.select("key").distinct(), _history(F.col("key"))[1], "nt:versionHistory").unionByName(node(versions, at, "nt:version")).unionByName(node(versions, frozen, "nt:frozenNode"))
    # the single values of a line in one pass, as each pass would shuffle the lines
    one = lambda path, name, kind, value, length: F.struct(path.alias("path"), F.lit(name).alias("name"), F.lit(kind).alias("property_type"), value.alias("value"), length.alias("binary_length"))
    created = one(at, "jcr:created", "Date", F.date_format("l_shipdate", "yyyy-MM-dd'T00:00:00.000Z'"), no)
    kind = one(frozen, "jcr:frozenPrimaryType", "Name", F.when(F.col("configuration"), "nt:configuration").otherwise("nt:page"), no)
    data = one(frozen, "data", "Binary", F.lit(None).cast("string"), F.octet_length(F.repeat(F.lit("x"), F.col("l_quantity").cast("int"))).cast("bigint"))
    single = lines.select("key", F.inline(F.array(created, kind, data))).where(F.col("value").isNotNull() | F.col("binary_length").isNotNull())
    names = explode_values(lines.select("key", frozen.alias("path"), F.array(F.lit("x"), F.lit("y")).alias("v")), "tags", "String", "v", True, keep=["key"])
    filled = {"multiple": F.lit(False), "position": F.lit(0), "long_value": no, "double_value": F.lit(None).cast("double"), "boolean_value": F.lit(None).cast("boolean"), "binary_reference": F.lit(None).cast("string")}
    return derive_nodes(entities, keep=["key"]), single.withColumns(filled).select(*names.columns).unionByName(names)


HISTORIES_SQL = f"""with lines as (select l_orderkey as o_orderkey, count(*) as lines from lineitem group by 1),
 hi as (select case when o_orderkey % 97 = 0 then 'broken-' || o_orderkey else {_uuid_sql("o_orderkey", "8")} end as history,
    '{STORAGE}/' || md5(o_orderkey::varchar)[1:2] || '/' || md5(o_orderkey::varchar)[3:3] || '/' || history as path,
    case when o_orderkey % 13 <> 0 then epoch(o_orderdate)::bigint end as newest, floor(o_totalprice)::bigint as bytes, (coalesce(lines, 0) + 1)::bigint as nodes, o_orderpriority = '1-URGENT' as configuration, o_orderkey as key
    from orders left join lines using (o_orderkey)),
 live as (select {_uuid_sql("o_orderkey", "8")} as identifier from orders where o_custkey in (select c_custkey from customer where c_acctbal >= 0)),
 links as (select lower({_uuid_sql("l_orderkey", "8")}) as value from lineitem where l_quantity <= 2),
 orphan as (select * from hi where history not like 'broken-%' and history not in (select identifier from live)),
 gone as (select * from orphan where not configuration and newest is not null and 883612800 - newest >= 31536000 and history not in (select value from links))"""


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """A customer is a checkpoint; some never expire."""
    key = F.col("c_custkey")
    created = F.lit(1_700_000_000_000).cast("bigint") + key * 1_000_000
    return table(spark, d, "customer").select(_uuid(key, "9").alias("name"), created.alias("created_ms"), F.when(key % 7 != 0, created + F.floor("c_acctbal").cast("bigint") * 1_000_000).alias("expires_ms"), key.alias("key"))


def async_references(spark: SparkSession, d: str) -> DataFrame:
    """References to checkpoints: of suppliers, some to ones that are gone, some only kept from before."""
    key = F.col("s_suppkey")
    name = F.when(key % 5 == 0, F.concat(F.lit("lane-"), key.cast("string"), F.lit("-temp"))).otherwise(F.concat(F.lit("lane-"), key.cast("string")))
    return table(spark, d, "supplier").select(name.alias("name"), _uuid(F.when(key % 3 == 0, -key - 1).otherwise(key), "9").alias("value"))


CHECKPOINTS_SQL = f"""with c as (select {_uuid_sql("c_custkey", "9")} as name, 1700000000000 + c_custkey * 1000000 as created_ms,
    case when c_custkey % 7 <> 0 then 1700000000000 + c_custkey * 1000000 + floor(c_acctbal)::bigint * 1000000 end as expires_ms from customer),
 a as (select 'lane-' || s_suppkey || case when s_suppkey % 5 = 0 then '-temp' else '' end as name, {_uuid_sql("(case when s_suppkey % 3 = 0 then -s_suppkey - 1 else s_suppkey end)", "9")} as value from supplier)"""


# -- a journal with versions of paths, of events

def journal(spark: SparkSession, d: str) -> DataFrame:
    """Every event is a revision, in the order of their ids, which is that of their times."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("line_no"), F.concat(_uuid(F.col("event_id"), "a"), F.lit(":"), (F.col("event_id") % 1000).cast("string")).alias("revision"), "user_id", "event_type", "value")


JOURNAL_SQL = f"with j as (select event_id as line_no, {_uuid_sql('event_id', 'a')} || ':' || (event_id % 1000) as revision, user_id, event_type, value from events)"
