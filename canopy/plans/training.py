"""Queries of the data-preparation operators in the core: problems 1, 2, 4 and 5."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators.eager import eager_join_aggregate, heavy_keys, roll_up
from canopy.operators.snapshots import snapshot_changes
from canopy.operators.structural import load_lines
from canopy.operators.wide import read_attributes, to_wide
from canopy.sources.tables import table

HEAVY = Decimal("0.04")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Journal lines that can't be read, with the reason."""
    return load_lines(table(spark, d, "gc_journal_lines"), only="rejected").select("line_id", "reason")


def p1_entries(spark: SparkSession, d: str) -> DataFrame:
    """The lines that can, as journal entries."""
    return load_lines(table(spark, d, "gc_journal_lines"), only="valid").drop("reason")


PROPERTY_VALUES = ["property_type", "multiple", "value", "long_value", "double_value", "boolean_value", "binary_length", "binary_reference"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and properties added, removed or changed from snapshot to snapshot."""
    snapshots = table(spark, d, "journal_revisions")
    nodes = snapshot_changes(table(spark, d, "node_rows"), snapshots, ["path"], ["primary_type"], "delivered_at")
    properties = snapshot_changes(table(spark, d, "property_rows"), snapshots, ["path", "name", "position"], PROPERTY_VALUES, "delivered_at")
    return nodes.select(F.lit("node").alias("record_kind"), "snapshot_id", "path", F.lit("").alias("name"), F.lit(-1).alias("position"), "change").unionByName(
        properties.select(F.lit("property").alias("record_kind"), "snapshot_id", "path", "name", F.coalesce("position", F.lit(-1)).alias("position"), "change")
    )


def _wide(spark: SparkSession, d: str) -> DataFrame:
    attributes = read_attributes(table(spark, d, "wide_columns"))
    return to_wide(table(spark, d, "interned_nodes"), table(spark, d, "interned_properties"), table(spark, d, "interned_strings"), attributes)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the wide table that have rows but can't be filled."""
    return _wide(spark, d).select("node_id", F.explode("unfilled").alias("name_id"))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per node with typed columns; dates as milliseconds since the epoch."""
    wide = _wide(spark, d)
    return wide.select(*(F.unix_millis(c).alias(c) if t == "timestamp" else c for c, t in wide.dtypes if c != "unfilled"))


def _children(spark: SparkSession, d: str) -> DataFrame:
    """Nodes joined with their parents, by parent."""
    nodes = table(spark, d, "interned_nodes")
    return eager_join_aggregate(nodes, nodes, "parent_id", "id", how="left")


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Properties joined with the strings that name them, by name."""
    return eager_join_aggregate(table(spark, d, "interned_properties"), table(spark, d, "interned_strings"), "name_id", "id", how="left")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Parents and property names that hold at least 4 % of their table's rows."""
    parents = heavy_keys(_children(spark, d), table(spark, d, "interned_nodes"), HEAVY)
    names = heavy_keys(_names(spark, d), table(spark, d, "interned_properties"), HEAVY)
    pick = lambda df, field: df.select(F.lit(field).alias("field"), F.col("key").alias("key_id"))
    return pick(parents, "parent_id").unionByName(pick(names, "name_id"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per parent its children, per property name its rows, and the rows that these make joined with the parents and the names."""
    columns = F.col("key").alias("key_id"), F.col("left_rows").alias("n_rows"), F.col("right_rows").alias("partners"), F.col("joined_rows").cast("bigint").alias("joined_rows")
    pick = lambda df, field: df.where(F.col("key").isNotNull()).select(F.lit(field).alias("field"), *columns)
    return pick(_children(spark, d), "parent_id").unionByName(pick(_names(spark, d), "name_id"))


def p5_parent_load(spark: SparkSession, d: str) -> DataFrame:
    """Property rows of the children of every parent: joined by node, rolled up by parent."""
    per_node = parent_load(table(spark, d, "interned_nodes"), table(spark, d, "interned_properties"))
    return per_node.select("parent_id", F.col("keys").alias("children"), F.col("property_rows").cast("bigint").alias("property_rows"))


def parent_load(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """``parent_id``, ``keys`` (its different children) and ``property_rows``."""
    per_node = eager_join_aggregate(nodes.where(F.col("parent_id").isNotNull()), properties, "id", "node_id", how="left", left_by=["parent_id"])
    # a node without properties is one row of a left join, but none of theirs
    rows = F.when(F.col("right_rows") > 0, F.col("joined_rows")).otherwise(F.lit(0))
    return roll_up(per_node.withColumn("property_rows", rows), ["parent_id"], ["property_rows"])


QUERIES = {f.__name__: f for f in (p1_found, p1_entries, p2_found, p4_found, p4_wide, p5_found, p5_counts, p5_parent_load)}

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_BARE = r"""regexp_replace(raw_line, '[\r\n]+$', '')"""
_SPLIT = f"""
  with lines as (select line_id, {_BARE} as line from gc_journal_lines),
  quoted as (select *, line is null or regexp_full_match(line, '(?s){_FIELD}(?:,{_FIELD})*') as well from lines),
  parts as (select *, case when well and line is not null
      then list_transform(regexp_extract_all(',' || line, '(?s),({_FIELD})', 1), lambda x: case when x like '"%' then replace(x[2:-2], '""', '"') else x end) else [] end as f
    from quoted),
  fields as (select line_id, well, line is not null as there, len(f) as n, f[1] as rs, f[2] as rc, f[3] as ts, f[4] as g, case when len(f) = 7 then f[5] else f[4] end as fg, f[len(f) - 1] as cn, f[len(f)] as root from parts),
  typed as (select *, {", ".join(f"case when regexp_full_match({c}, '[+-]?[0-9]+') then try_cast({c} as {t}) end as v_{c}" for c, t in (("rs", "bigint"), ("rc", "bigint"), ("ts", "bigint"), ("g", "int"), ("fg", "int"), ("cn", "bigint")))},
      coalesce(regexp_full_match(root, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}(:(0|[1-9][0-9]*)|\\.[0-7][0-9a-f]{{7}})')
        and (root[37] = '.' or coalesce(try_cast(root[38:] as bigint) <= 2147483647, false)), false) as root_ok
    from fields),
  judged as (select *, case when not well then 'quoting' when n not in (6, 7) then 'column_count'
      when v_rs is null or v_rc is null or v_ts is null or v_g is null or v_fg is null or v_cn is null or not root_ok then 'value' end as reason from typed)"""

_VALID_P2 = """
  with ids as (select snapshot_id, lead(snapshot_id) over (order by snapshot_id) as following from (select distinct snapshot_id from journal_revisions)),
  n as (select snapshot_id, path, arg_max(coalesce('v' || primary_type, 'n'), delivered_at) as content from node_rows group by all),
  p as (select snapshot_id, path, name, position, arg_max({'a': property_type, 'b': multiple, 'c': value, 'd': long_value, 'e': double_value, 'f': boolean_value, 'g': binary_length, 'h': binary_reference}, delivered_at) as content
    from property_rows group by all)"""


def _changes(kind: str, t: str, keys: str, on: str, name: str, position: str) -> str:
    return f"""
  select '{kind}' as record_kind, coalesce(a.snapshot_id, b.following) as snapshot_id, coalesce(a.path, b.path) as path, {name} as name, {position} as position,
    case when b.path is null then 'added' when a.path is null then 'removed' else 'changed' end as change
  from (select {t}.* from {t} where snapshot_id in (select following from ids)) a
  full join (select {t}.*, ids.following from {t} join ids using (snapshot_id) where following is not null) b
    on a.snapshot_id = b.following and {on}
  where b.path is null or a.path is null or a.content is distinct from b.content"""


_P4 = r"""
  with v as (select p.*, w.type_name, s.value as string_value from (select *, row_number() over (partition by node_id, name_id, position order by loaded_at desc) as k
      from interned_properties where name_id in (select name_id from wide_columns)) p
    join wide_columns w using (name_id) left join interned_strings s on s.id = p.value_id where k = 1),
  t as (select *, trim(y, ' ') as x from (select *, coalesce(string_value, long_value::varchar, case when isnan(double_value) then 'NaN' when isinf(double_value) then replace(double_value::varchar, 'inf', 'Infinity') else double_value::varchar end,
      case boolean_value when 1 then 'true' when 0 then 'false' end) as y from v)),
  r as (select node_id, name_id, x, y, coalesce(position >= 0 and binary_length is null and binary_reference_id is null and x is not null and case type_name
      when 'Long' then regexp_full_match(x, '[+-]?[0-9]+') and try_cast(x as bigint) is not null
      when 'Double' then regexp_full_match(x, '[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|NaN|-?Infinity')
      when 'Decimal' then regexp_full_match(x, '[+-]?[0-9]+(\.[0-9]+)?')
      when 'Boolean' then lower(x) in ('true', 'false')
      when 'Date' then regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\.[0-9]{3}(Z|[+-][0-9]{2}:[0-9]{2})') and try_cast(x[1:10] as date) is not null
      else true end, false) as reads from t)"""

#: The typed columns wanted, with the ids of their names.
_WIDE = {
    "created_on": (4, "Date"), "last_modified": (5, "Date"), "created_by": (6, "String"), "title": (7, "String"), "width_px": (9, "Long"), "height_px": (10, "Long"),
    "rating": (11, "Double"), "is_published": (12, "Boolean"), "price": (13, "Decimal"), "sort_order": (14, "Long"), "valid_until": (15, "Date"), "quality": (16, "Double"),
}
_READ = {
    "String": "y", "Long": "try_cast(x as bigint)", "Double": "try_cast(ltrim(x, '+') as double)", "Decimal": "try_cast(x as decimal(38,10))", "Boolean": "lower(x) = 'true'",
    "Date": "epoch_ms(try_cast(x[1:10] as date)::timestamp) + x[12:13]::bigint * 3600000 + x[15:16]::bigint * 60000 + x[18:19]::bigint * 1000 + x[21:23]::bigint"
    " - case when x like '%Z' then 0 else (case when x[24:24] = '-' then -1 else 1 end) * (x[25:26]::bigint * 60 + x[28:29]::bigint) * 60000 end",
}


def _cell(column: str, name_id: int, kind: str) -> str:
    return f"max(case when name_id = {name_id} then {_READ[kind]} end) as {column}"


SQL = {
    "p1_found": _SPLIT + " select line_id, reason from judged where reason is not null",
    "p1_entries": _SPLIT
    + """ select line_id, v_rs as repository_size, v_rc as reclaimed_size, v_ts as timestamp_milliseconds, v_g as generation, v_fg as full_generation,
      v_cn as compacted_nodes, root as root_record_identifier_text from judged where reason is null""",
    "p2_found": _VALID_P2
    + _changes("node", "n", "path", "a.path = b.path", "''", "-1")
    + " union all "
    + _changes("property", "p", "path, name, position", "a.path = b.path and a.name = b.name and a.position is not distinct from b.position", "coalesce(a.name, b.name)", "coalesce(a.position, b.position, -1)"),
    "p4_found": _P4 + " select node_id, name_id from r group by 1, 2 having count(*) <> 1 or not bool_and(reads)",
    "p4_wide": _P4
    + f""", one as (select node_id, name_id, max(x) as x, max(y) as y from r group by 1, 2 having count(*) = 1 and bool_and(reads)),
      ids as (select id as node_id from interned_nodes union select node_id from interned_properties where name_id in (select name_id from wide_columns)),
      filled as (select node_id, {", ".join(_cell(c, i, t) for c, (i, t) in _WIDE.items())} from one group by 1)
      select ids.node_id, {", ".join(_WIDE)} from ids left join filled using (node_id) where ids.node_id is not null""",
    "p5_found": """
      select 'parent_id' as field, parent_id as key_id from interned_nodes where parent_id is not null group by parent_id having count(*) >= 0.04 * (select count(*) from interned_nodes)
      union all select 'name_id', name_id from interned_properties where name_id is not null group by name_id having count(*) >= 0.04 * (select count(*) from interned_properties)""",
    "p5_counts": """
      select 'parent_id' as field, a.parent_id as key_id, count(distinct a.id) as n_rows, count(distinct b.id) as partners, count(*) as joined_rows from interned_nodes a left join interned_nodes b on b.id = a.parent_id where a.parent_id is not null group by 2
      union all select 'name_id', a.name_id, count(*), count(distinct b.id), count(*) from interned_properties a left join interned_strings b on b.id = a.name_id where a.name_id is not null group by 2""",
    "p5_parent_load": """
      select n.parent_id, count(distinct n.id) as children, count(p.node_id) as property_rows from interned_nodes n left join interned_properties p on p.node_id = n.id
      where n.parent_id is not null group by 1""",
}
