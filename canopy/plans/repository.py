"""Queries of the repository operators, each with the same question in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.functions import paths, values
from canopy.operators import checkpoints, commits, diff, digest, gc, interned, maintenance, orphans, search, sinks, tree, versions
from canopy.operators.common import lookup, with_places
from canopy.plans import models as m
from canopy.schema import NODES, VALUE_COLUMNS, violations
from canopy.sources.journal import last_gc_entry, parse_gc_line, retention_boundary
from canopy.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
INBOX, SITES = "/content/dam/inbox", "/content/sites"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def T(body: str) -> str:  # noqa: N802
    return m.TREE_SQL + " " + body


NC = "path, parent_path, name, depth, primary_type"
PC = "path, name, property_type, multiple, position, value, long_value, double_value, boolean_value, binary_length, binary_reference"
#: A value's text in SQL; doubles beyond what both engines print alike are left to the digits that they share.
DOUBLE_SQL = "case when isnan(double_value) then 'NaN' when isinf(double_value) then replace(double_value::varchar, 'inf', 'Infinity') else double_value::varchar end"
TEXT_SQL = f"coalesce(value, long_value::varchar, {DOUBLE_SQL}, boolean_value::varchar)"
#: Identities leave doubles out of the text and compare them as numbers.
SEGMENTS_OF = "list_filter(string_split(path, '/'), lambda x: x <> '')"


# ---------------------------------------------------------------- trees


@query(T(f"select {NC} from n"))
def nodes_table(s, d):
    return m.nodes(s, d)


@query(T(f"select {PC} from p"))
def properties_table(s, d):
    return m.properties(s, d)


@query(T(f"select {NC} from n where path = '{INBOX}'"))
def path_lookup(s, d):
    return tree.node_at(m.nodes(s, d), "content//dam/inbox/")


@query(T(f"select {NC} from n where parent_path = '/content' and name = 'dam'"))
def child_lookup(s, d):
    return tree.child(m.nodes(s, d), "/content/", "dam")


@query(T(f"select {NC} from n where parent_path = '{INBOX}'"))
def children_of(s, d):
    return tree.children(m.nodes(s, d), INBOX)


@query(T("select n.path, count(c.path) as children from n left join n c on c.parent_path = n.path group by 1"))
def child_count(s, d):
    return tree.child_counts(m.nodes(s, d))


@query(T(f"select {PC} from p where path = '/'"))
def properties_of_node(s, d):
    return tree.properties_of(m.properties(s, d), "/")


@query(T(f"select {PC} from p where path = '/' and not (name = 'jcr:primaryType' and property_type = 'Name' and not multiple) and not (name = 'jcr:mixinTypes' and property_type = 'Name' and multiple)"))
def stored_properties_of_node(s, d):
    return tree.properties_of(m.properties(s, d), "/", stored_only=True)


@query(T(f"select {PC} from p where path = '/' and name = 'tags'"))
def property_lookup(s, d):
    return tree.property_named(m.properties(s, d), "/", "tags")


@query(T(f"select {NC} from n where (path = '{SITES}' or starts_with(path, '{SITES}/')) and depth <= 4"))
def subtree_depth_limited(s, d):
    return tree.subtree(m.nodes(s, d), SITES, depth_limit=2)


@query(T(f"select {NC} from n where not (path = '{INBOX}' or starts_with(path, '{INBOX}/'))"))
def subtree_excluding(s, d):
    return tree.subtree(m.nodes(s, d), "/", without=[INBOX])


@query(T(f"select path, case when path <> '{SITES}' then parent_path end as parent_path, name, depth - 2 as depth, primary_type from n where path = '{SITES}' or starts_with(path, '{SITES}/')"))
def subtree_as_export(s, d):
    return tree.as_export(m.nodes(s, d), SITES)


@query(T("select path, repeat('  ', depth) || case when path = '/' then '/' else name end || coalesce(' [' || primary_type || ']', '') as line from n where depth <= 5"))
def tree_listing(s, d):
    return tree.listing(m.nodes(s, d), "/", 5)


@query(T(f"select path, row_number() over (order by {SEGMENTS_OF}) as place from n"))
def document_order(s, d):
    return with_places(m.nodes(s, d).select("path"), [paths.document_order(F.col("path"))], "place")


@query(T("select primary_type, count(*) as nodes from n group by 1"))
def inventory_by_type(s, d):
    return tree.inventory(m.nodes(s, d))


@query(T("select primary_type, count(*) as nodes, rank() over (order by count(*) desc) as place from n group by 1 order by nodes desc, primary_type nulls first limit 10"))
def inventory_ranked(s, d):
    counts = tree.inventory(m.nodes(s, d))
    # one row per type is ranked, not one per node
    return counts.withColumn("place", F.rank().over(Window.orderBy(F.desc("nodes"))).cast("bigint")).orderBy(F.desc("nodes"), "primary_type").limit(10)


@query(T("select path, parent_path, name, depth, primary_type from n"))
def derived_nodes(s, d):
    return tree.derive_nodes(m.nodes(s, d).select("path", "primary_type"))


@query("""select '/o' || o_orderkey as path, 'prices' as name, 'Double' as property_type, true as multiple, (row_number() over (partition by o_orderkey order by l_extendedprice) - 1)::int as position,
    null::varchar as value, null::bigint as long_value, l_extendedprice as double_value, null::boolean as boolean_value, null::bigint as binary_length, null::varchar as binary_reference
  from orders join lineitem on l_orderkey = o_orderkey
  union all select '/o' || o_orderkey, 'prices', 'Double', true, null, null, null, null, null, null, null from orders where o_orderkey not in (select l_orderkey from lineitem)""")
def exploded_values(s, d):
    prices = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_extendedprice")).alias("prices"))
    o = table(s, d, "orders").join(prices, "o_orderkey", "left").select(F.concat(F.lit("/o"), "o_orderkey").alias("path"), F.coalesce("prices", F.array().cast("array<double>")).alias("prices"))
    return tree.explode_values(o, "prices", "Double", "prices", multiple=True)


@query("""select '/docs/' || doc_id as path, 'text' as name, 'Binary' as property_type, false as multiple, 0 as position, null::varchar as value, null::bigint as long_value, null::double as double_value,
    null::boolean as boolean_value, octet_length(encode(text))::bigint as binary_length, null::varchar as binary_reference from documents where text is not null""")
def exploded_binaries(s, d):
    docs = table(s, d, "documents").select(F.concat(F.lit("/docs/"), "doc_id").alias("path"), "text")
    return tree.explode_values(docs, "text", "Binary", "text", multiple=False)


_JSON_PATH = "replace(replace(replace(replace(replace(n.path, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"


@query(T(f"""select n.path, '{{"path":"' || {_JSON_PATH} || '"' as start, count(distinct p.name) as properties from n left join p on p.path = n.path group by n.path"""))
def json_lines_shape(s, d):
    lines = sinks.json_lines(m.nodes(s, d), m.properties(s, d))
    n = F.size(F.json_object_keys(F.get_json_object("line", "$.properties")))
    return lines.select("path", F.substring_index("line", ',"properties":', 1).alias("start"), n.cast("bigint").alias("properties"))


@query()
def json_lines(s, d):
    return sinks.json_lines(m.nodes(s, d), m.properties(s, d))


@query(T("""select path, 'missing parent' as problem from n where parent_path is not null and parent_path not in (select path from n)
  union all select distinct path, 'unsuitable value' from p where (value is not null)::int + (long_value is not null)::int + (double_value is not null)::int + (boolean_value is not null)::int + (binary_length is not null)::int
      + (binary_reference is not null)::int <> case when position is null then 0 else 1 end
  union all select distinct path, 'property of a missing node' from p where path not in (select path from n)"""))
def tree_violations(s, d):
    return violations(m.nodes(s, d), m.properties(s, d))


# ---------------------------------------------------------------- search


def A(body: str) -> str:  # noqa: N802
    return m.ALL_SQL + " " + body


KEY = ["snapshot_id", "path"]


@query(A("select snapshot_id, path from n where (snapshot_id, path) in (select (snapshot_id, path) from p where name = 'tags') and (snapshot_id, path) in (select (snapshot_id, path) from p where name = 'weight')"))
def search_has_property(s, d):
    return search.search(m.all_nodes(s, d), m.all_properties(s, d), has_property=["tags", "weight"], key=KEY, limit=0)


@query(A("select snapshot_id, path from n where (snapshot_id, path) in (select (snapshot_id, parent_path) from n where name = 'jcr:content')"))
def search_has_child(s, d):
    return search.search(m.all_nodes(s, d), m.all_properties(s, d), has_child=["jcr:content"], key=KEY, limit=0)


@query(A("select snapshot_id, path from n where (snapshot_id, path) in (select (snapshot_id, path) from p where name = 'hidden' and boolean_value) order by 1, 2 limit 10000"))
def search_value(s, d):
    return search.search(m.all_nodes(s, d), m.all_properties(s, d), values_equal=[search.parse_predicate("hidden=true")], key=KEY)


@query(A("""select snapshot_id, path from n where (snapshot_id, path) in (select (snapshot_id, path) from p where name = 'jcr:title')
  and (snapshot_id, path) in (select (snapshot_id, parent_path) from n where name = 'jcr:content') and (snapshot_id, path) in (select (snapshot_id, path) from p where name = 'tags' and value = 'topic/marble')"""))
def search_combined(s, d):
    return search.search(m.all_nodes(s, d), m.all_properties(s, d), has_property=["jcr:title"], has_child=["jcr:content"], values_equal=[("tags", "topic/marble")], key=KEY, limit=0)


# ---------------------------------------------------------------- functions


@query(T(f"""select path, '/' || array_to_string({SEGMENTS_OF}, '/') as normalized, len({SEGMENTS_OF})::int as levels, array_to_string(list_transform(range(1, len({SEGMENTS_OF})), lambda i: '/' || array_to_string({SEGMENTS_OF}[1:i], '/')), '|') as above,
    case when path <> '/' then '/' || array_to_string({SEGMENTS_OF}[1:-2], '/') end as up from n"""))
def path_functions(s, d):
    p = F.concat(F.col("path"), F.lit("//"))
    return m.nodes(s, d).select("path", paths.normalize(p).alias("normalized"), paths.depth(p).alias("levels"), F.array_join(paths.ancestors(p), "|").alias("above"), paths.parent(p).alias("up"))


@query(T(f"select path, name, position, {TEXT_SQL} as text from p"))
def canonical_text(s, d):
    return m.properties(s, d).select("path", "name", "position", values.canonical_text(*(F.col(c) for c in VALUE_COLUMNS[:4])).alias("text"))


@query(T("select distinct property_type, t.id as tag from p left join property_types t on t.name = p.property_type"))
def type_tags(s, d):
    """Types that aren't known have no tag."""
    return m.properties(s, d).select("property_type").distinct().select("property_type", values.type_tag(F.col("property_type")).alias("tag"))


@query(T("select path, name, position, replace(replace(replace(replace(replace(value, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r'), chr(31), '\\x1F') as escaped from p where value is not null"))
def digest_escape(s, d):
    return m.properties(s, d).where(F.col("value").isNotNull()).select("path", "name", "position", values.escape_digest(F.col("value")).alias("escaped"))


def _units(text: str) -> str:
    """The UTF-16 units of a text in SQL."""
    return f"flatten(list_transform(string_split({text}, ''), lambda c: case when unicode(c) >= 65536 then [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] else [unicode(c)] end))"


_HASH = f"(case when name = '' then 0 else list_reduce(list_prepend(0::bigint, list_transform({_units('name')}, lambda u: u::bigint)), lambda h, u: (h * 31 + u) % 4294967296) end)"


@query(T(f"select distinct name, {_HASH} as unsigned_hash from p"))
def java_string_hash(s, d):
    names = m.properties(s, d).select("name").distinct()
    return names.select("name", F.pmod(values.string_hash(F.col("name")), F.lit(2**32)).alias("unsigned_hash"))


@query(T(f"select distinct name, ((xor({_HASH}, {values.MAP_HASH_FACTOR}::bigint)::hugeint * {values.MAP_HASH_FACTOR} + {values.MAP_HASH_ADDEND}) % 4294967296)::bigint as map_hash from n"))
def child_map_hash(s, d):
    return m.nodes(s, d).select("name").distinct().select("name", values.map_hash(F.col("name")).alias("map_hash"))


@query(T("""select path, name, position, value, case when regexp_full_match(value, '[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]*)?(Z|[+-][0-9]{2}:[0-9]{2})')
    then epoch(try_cast(value[1:7] || '-01' as date))::bigint + (value[9:10]::bigint - 1) * 86400 + value[12:13]::bigint * 3600 + value[15:16]::bigint * 60 + value[18:19]::bigint
      - case when value like '%Z' then 0 else (case when value[-6:-6] = '-' then -1 else 1 end) * (value[-5:-4]::bigint * 3600 + value[-2:-1]::bigint * 60) end end as seconds from p where property_type = 'Date'"""))
def date_epoch_seconds(s, d):
    return m.properties(s, d).where("property_type = 'Date'").select("path", "name", "position", "value", values.epoch_seconds(F.col("value")).alias("seconds"))


@query(T("select path, name, position, case when regexp_full_match(value, '(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') then lower(value) end as identifier from p where name in ('jcr:uuid', 'related', 'successor')"))
def identifier_parse(s, d):
    return m.properties(s, d).where(F.col("name").isin("jcr:uuid", "related", "successor")).select("path", "name", "position", values.identifier(F.col("value")).alias("identifier"))


@query(T("select path, name, position, try_cast(regexp_extract(binary_reference, '#([0-9]+)$', 1) as bigint) as length from p where binary_reference is not null"))
def blob_length_suffix(s, d):
    return m.properties(s, d).where(F.col("binary_reference").isNotNull()).select("path", "name", "position", values.blob_length(F.col("binary_reference")).alias("length"))


@query("""select line_id, case when regexp_full_match(t, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}:(0|[1-9][0-9]{0,9})') and t[38:]::bigint <= 2147483647 then t[38:]::bigint
    when regexp_full_match(t, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\\.[0-9a-f]{8}') and ('0x' || t[38:])::bigint <= 2147483647 then ('0x' || t[38:])::bigint end as record_number
  from (select line_id, string_split(raw_line, ',')[-1] as t from gc_journal_lines where raw_line is not null)""")
def record_identifiers(s, d):
    last = F.element_at(F.split("raw_line", ",", -1), -1)
    return table(s, d, "gc_journal_lines").where("raw_line is not null").select("line_id", values.record_number(last).alias("record_number"))


@query("""select o_orderkey, case when b = 1 then '1 byte' when b < 1024 then b || ' bytes' when b < 1048576 then ((b * 10) // 1024) // 10 || '.' || ((b * 10) // 1024) % 10 || ' KiB'
    when b < 1073741824 then ((b * 10) // 1048576) // 10 || '.' || ((b * 10) // 1048576) % 10 || ' MiB' else ((b * 10) // 1073741824) // 10 || '.' || ((b * 10) // 1073741824) % 10 || ' GiB' end as size,
    format('{:,}', b) as grouped from (select o_orderkey, floor(o_totalprice)::bigint * (o_orderkey % 5) * (o_orderkey % 1000) as b from orders)""")
def byte_sizes(s, d):
    b = F.floor("o_totalprice").cast("bigint") * (F.col("o_orderkey") % 5) * (F.col("o_orderkey") % 1000)
    return table(s, d, "orders").select("o_orderkey", values.byte_size(b).alias("size"), values.grouped_count(b).alias("grouped"))


@query("""select snapshot_id, revision_text, case when timestamp_milliseconds < 0 then 'unknown' else strftime(make_timestamp(timestamp_milliseconds * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' end as at from journal_revisions""")
def timestamps(s, d):
    return table(s, d, "journal_revisions").select("snapshot_id", "revision_text", values.instant_text(F.col("timestamp_milliseconds")).alias("at"))


@query("select event_id, lower(hex(encode(props))) as bytes, md5(props) as digest from events")
def content_bytes(s, d):
    return table(s, d, "events").select("event_id", F.lower(F.hex(F.encode("props", "UTF-8"))).alias("bytes"), F.md5("props").alias("digest"))


@query()
def crc32_of_values(s, d):
    return m.properties(s, d).where(F.col("value").isNotNull()).select("path", "name", "position", F.lpad(F.lower(F.hex(F.crc32("value"))), 8, "0").alias("crc32"))


@query(T(f"select path, name, position, row_number() over (order by {_units('value')}, path, name, position) as place from p where value is not null"))
def utf16_order(s, d):
    p = m.properties(s, d).where(F.col("value").isNotNull()).select("path", "name", "position", "value")
    return with_places(p, [F.encode("value", "UTF-16BE"), F.col("path"), F.col("name"), F.col("position")], "place").select("path", "name", "position", "place")


@query(m.SEGMENTS_SQL + """ select segment, (case when v >= 9223372036854775808 then v - 18446744073709551616 else v end)::bigint as upper_half from
  (select segment, ('0x' || replace(segment, '-', '')[1:16])::uhugeint::hugeint as v from s)""")
def signed_uuid_order(s, d):
    return m.segments(s, d).select("segment", values.signed_half(F.col("segment"), upper=True).alias("upper_half"))


# ---------------------------------------------------------------- revisions


def P(body: str) -> str:  # noqa: N802
    return m.PAIR_SQL + " " + body


_NODE_CHANGES = "(select coalesce(n.path, n0.path) as path, coalesce(n.parent_path, n0.parent_path) as parent_path, case when n0.path is null then 'added' else 'removed' end as change from n full join n0 on n.path = n0.path where n.path is null or n0.path is null)"
_TOP = f"(select path, change from {_NODE_CHANGES} c where (parent_path, change) not in (select (path, change) from {_NODE_CHANGES}))"
_GROUPED = """(select path, name, max(property_type) as t, bool_or(multiple) as m, coalesce(list({'v': value, 'l': long_value, 'd': double_value, 'b': boolean_value, 'n': binary_length, 'r': binary_reference} order by position) filter (position is not null), []) as v from %s group by 1, 2)"""
_PROPERTY_CHANGES = f"""(select coalesce(a.path, b.path) as path, coalesce(a.name, b.name) as name, case when a.path is null then 'added' when b.path is null then 'removed' else 'changed' end as change,
    a.t as old_type, b.t as new_type from {_GROUPED % 'p0'} a full join {_GROUPED % 'p'} b on a.path = b.path and a.name = b.name
    where (a.path is null or b.path is null or a.t <> b.t or a.m <> b.m or a.v is distinct from b.v) and coalesce(a.path, b.path) in (select path from n) and coalesce(a.path, b.path) in (select path from n0))"""


def _pair(s, d):
    old, new = (m.nodes(s, d, 1), m.properties(s, d, 1)), (m.nodes(s, d), m.properties(s, d))
    return old, new


def _differences(s, d):
    old, new = _pair(s, d)
    return diff.node_changes(old[0], new[0]), diff.property_changes(old[1], new[1], old[0], new[0])


@query(P(f"select path, change from {_TOP}"))
def revision_diff_nodes(s, d):
    return _differences(s, d)[0]


@query(P(f"select path, name, change, old_type, new_type from {_PROPERTY_CHANGES}"))
def revision_diff_properties(s, d):
    return _differences(s, d)[1].select("path", "name", "change", "old_type", "new_type")


@query(P(f"select path, name, old_type, new_type from {_PROPERTY_CHANGES} where old_type <> new_type"))
def revision_diff_typed_only(s, d):
    return _differences(s, d)[1].where("old_type <> new_type").select("path", "name", "old_type", "new_type")


@query()
def revision_diff_rendered(s, d):
    return diff.rendered(*_differences(s, d))


@query(m.JOURNAL_SQL + " select j.line_no, j.revision, md5(v.event_type) as record from j left join (select revision, event_type from j where user_id = 7) v on v.revision = j.revision")
def node_history(s, d):
    j = m.journal(s, d)
    at = j.select("revision", F.concat(F.lit("/u"), "user_id").alias("path"), F.md5("event_type").alias("record"))
    return versions.node_history(j, at, "/u7")


@query(m.JOURNAL_SQL + """, r as (select user_id, line_no, event_type as record, lag(event_type) over w as before, row_number() over w as k from j window w as (partition by user_id order by line_no))
  select '/u' || user_id as path, line_no, record, sum((k = 1 or record <> before)::int) over (partition by user_id order by line_no)::bigint as run from r""")
def history_runs(s, d):
    j = m.journal(s, d).select(F.concat(F.lit("/u"), "user_id").alias("path"), "line_no", F.col("event_type").alias("record"))
    return versions.history_runs(j).select("path", "line_no", "record", "run")


@query(m.JOURNAL_SQL + """ select line_no, revision, case when line_no % 11 = 0 then 'unparseable' when line_no % 7 = 0 then 'segment missing' else 'ok' end as state from
  (select line_no, case when line_no % 11 = 0 then 'x' || revision else revision end as revision from j)""")
def journal_validity(s, d):
    j = m.journal(s, d)
    known = j.where("line_no % 7 <> 0").select(values.record_segment(F.col("revision")).alias("segment"))
    broken = j.select("line_no", F.when(F.col("line_no") % 11 == 0, F.concat(F.lit("x"), "revision")).otherwise(F.col("revision")).alias("revision"))
    return versions.validity(broken, known).select("line_no", "revision", "state")


@query(m.JOURNAL_SQL + " select line_no, coalesce(sum((event_type <> 'error')::int) over (order by line_no desc rows between unbounded preceding and 1 preceding), 0) >= 100 as beyond_retention from j")
def journal_retention(s, d):
    return retention_boundary(m.journal(s, d).withColumn("readable", F.col("event_type") != "error"), 100).select("line_no", "beyond_retention")


_RAW = "select line_no, line_no % 13 <> 0 as has_space, line_no % 11 <> 0 as valid_id, line_no % 7 <> 0 as segment_exists, event_type <> 'error' as readable from j"


@query(m.JOURNAL_SQL + f""" select line_no, case when not has_space then 'ParserSkippedNoSpace' when not valid_id then 'InvalidRecordIdentifier' when not segment_exists then 'MissingSegment'
    when coalesce(sum((has_space and valid_id and segment_exists and readable)::int) over (order by line_no desc rows between unbounded preceding and 1 preceding), 0) >= 50 then 'BeyondRetention' when not readable then 'UnreadableRevision' end as reason from ({_RAW})""")
def journal_prune_reasons(s, d):
    n = F.col("line_no")
    raw = m.journal(s, d).select("line_no", (n % 13 != 0).alias("has_space"), (n % 11 != 0).alias("valid_id"), (n % 7 != 0).alias("segment_exists"), (F.col("event_type") != "error").alias("readable"))
    return versions.prune_reasons(raw, 50).select("line_no", "reason")


def _checks(s, d):
    j = m.journal(s, d)
    return j.select(F.concat(F.lit("/u"), "user_id").alias("path"), "line_no", "revision", (F.col("event_type") != "error").alias("good"))


_GOOD = "(select '/u' || user_id as path, max(line_no) filter (event_type <> 'error') as line_no, max_by(revision, line_no) filter (event_type <> 'error') as revision from j group by 1)"


@query(m.JOURNAL_SQL + f" select path, line_no, revision from {_GOOD}")
def consistency_newest_good(s, d):
    return versions.newest_good(_checks(s, d))


@query(m.JOURNAL_SQL + " select '/u' || user_id as path, max(line_no) filter (event_type <> 'error') as line_no, max_by(revision, line_no) filter (event_type <> 'error') as revision from j where line_no > (select max(line_no) from j) - 500 group by 1")
def consistency_limited(s, d):
    return versions.newest_good(_checks(s, d), revision_limit=500)


@query(m.JOURNAL_SQL + f" select case when bool_and(line_no is not null) then min(line_no) end as line_no, count(*) as paths from {_GOOD}")
def consistency_overall(s, d):
    return versions.overall_good(versions.newest_good(_checks(s, d)))


@query()
def consistency_corrupt_memory(s, d):
    j = m.journal(s, d)
    sound = F.array_compact(F.array(*(F.when(F.col("event_id_hash") % k != 0, F.lit(f"/p{k}")) for k in (2, 3, 5))))
    checks = j.select(F.concat(F.lit("/u"), "user_id").alias("path"), "line_no", "revision", F.col("event_type"), (F.col("line_no") * 7 + F.col("user_id")).alias("event_id_hash"))
    corrupt = F.when(F.col("event_type") == "error", F.concat(F.lit("/p"), F.element_at(F.array(F.lit("2"), F.lit("3"), F.lit("5")), (F.col("line_no") % 3 + 1).cast("int"))))
    return versions.newest_good_remembering(checks.select("path", "line_no", "revision", corrupt.alias("corrupt_at"), sound.alias("sound")))


@query("select c_custkey, row_number() over (order by c_acctbal desc, c_custkey desc) as place from customer")
def recovery_order(s, d):
    """Candidates by time, then by identifier, newest first."""
    candidates = table(s, d, "customer").select("c_custkey", "c_acctbal")
    return with_places(candidates, [-F.col("c_acctbal"), -F.col("c_custkey")], "place").select("c_custkey", "place")


@query(m.JOURNAL_SQL + " select line_no, line_no > (select max(line_no) from j where event_type <> 'error') as dropped from j")
def journal_recovery(s, d):
    """Only the inconsistent newest prefix goes; older candidates stay unverified."""
    j = m.journal(s, d)
    newest = j.where("event_type <> 'error'").agg(F.max("line_no")).scalar()
    return j.select("line_no", (F.col("line_no") > newest).alias("dropped"))


# ---------------------------------------------------------------- digests and refresh

def _escaped(text: str) -> str:
    return f"replace(replace(replace(replace(replace({text}, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r'), chr(31), '\\x1F')"


_SHOWN = _escaped(TEXT_SQL)
_LINES = f"""select n.path, {_escaped('n.path')} || coalesce(chr(9) || x.text, '') as line from n left join (
    select path, string_agg({_escaped('name')} || '=' || t || case when m then '[]' else '' end || ':' || coalesce(v, ''), chr(9) order by name) as text from (
      select path, name, max(property_type) as t, bool_or(multiple) as m,
        string_agg(coalesce({_SHOWN}, binary_length || '/' || binary_length, 'external:' || binary_reference, ''), chr(31) order by position) filter (position is not null) as v from p group by 1, 2) group by 1) x on x.path = n.path"""


@query(T(f"select path, md5(line) as digest from ({_LINES})"))
def digest_lines(s, d):
    return digest.digest_lines(m.nodes(s, d), m.properties(s, d)).select("path", F.md5("line").alias("digest"))


@query(T("""select (select count(*) from n) as nodes, count(distinct (path, name)) as properties, count(*) filter (binary_length is not null or binary_reference is not null) as binaries, coalesce(sum(binary_length), 0)::bigint as binary_bytes from p"""))
def digest_summary(s, d):
    return digest.digest_summary(m.nodes(s, d), m.properties(s, d))


@query(P("""select path, change from (select coalesce(n.path, n0.path) as path, case when n0.path is null then 'added' when n.path is null then 'removed' end as change from n full join n0 on n.path = n0.path)
  where change is not null union all
  select path, 'changed' from (select coalesce(a.path, b.path) as path from %s a full join %s b on a.path = b.path and a.name = b.name
    where a.path is null or b.path is null or a.t <> b.t or a.m <> b.m or a.v is distinct from b.v) where path in (select path from n) and path in (select path from n0) group by 1""" % (_GROUPED % "p0", _GROUPED % "p")))
def digest_compare(s, d):
    old, new = _pair(s, d)
    return digest.compare_digests(digest.digest_lines(*old), digest.digest_lines(*new))


@query()
def subtree_hashes(s, d):
    return digest.subtree_hashes(m.nodes(s, d), m.properties(s, d))


_RANGES = f"(select path, bool_or(subtree) as subtree, bool_or(reexport) as reexport from (select path, true as subtree, change = 'added' as reexport from {_TOP} union all select path, false, true from {_PROPERTY_CHANGES}) group by 1)"


@query(P(f"select path, subtree, reexport from {_RANGES}"))
def refresh_dirty_ranges(s, d):
    return diff.dirty_ranges(*_differences(s, d), "/").select("path", "subtree", "reexport")


@query(P(f"select {NC} from n"))
def refresh_merge_nodes(s, d):
    """The published nodes, refreshed: equal to a full export of the newer revision."""
    old, new = _pair(s, d)
    ranges = diff.dirty_ranges(*_differences(s, d), "/")
    return diff.refresh(old[0], new[0], ranges)


@query(P(f"select {PC} from p"))
def refresh_merge_properties(s, d):
    old, new = _pair(s, d)
    ranges = diff.dirty_ranges(*_differences(s, d), "/")
    return diff.refresh(old[1], new[1], ranges)


@query("""select count(*) as required, count(distinct s.revision_text) as revisions, coalesce(count(*) = count(s.revision_text) and count(distinct s.revision_text) = 1, false) as consistent
  from (values ('nodes'), ('properties')) k(name) left join (select 'nodes' as name, revision_text from journal_revisions where snapshot_id = (select max(snapshot_id) from journal_revisions)
    union all select 'properties', revision_text from journal_revisions where snapshot_id = (select min(snapshot_id) from journal_revisions)) s using (name)""")
def provenance_consistent_pair(s, d):
    """Whether both tables of a pair bear the same stamp; here they don't."""
    r = table(s, d, "journal_revisions")
    stamps = r.agg(F.max_by("revision_text", "snapshot_id").alias("nodes"), F.min_by("revision_text", "snapshot_id").alias("properties"))
    stamps = stamps.select(F.explode(F.create_map(F.lit("nodes"), "nodes", F.lit("properties"), "properties")).alias("name", "revision"))
    required = s.createDataFrame([("nodes",), ("properties",)], "name string")
    j = required.join(stamps, "name", "left").agg(F.count(F.lit(1)).alias("required"), F.countDistinct("revision").alias("revisions"), F.count("revision").alias("n"))
    return j.select("required", "revisions", ((F.col("n") == F.col("required")) & (F.col("revisions") == 1)).alias("consistent"))


# ---------------------------------------------------------------- the interned form


@query(T("select distinct value from (select name as value from n union all select primary_type from n union all select name from p union all select value from p union all select binary_reference from p) where value is not null"))
def interned_dictionary(s, d):
    return interned.dictionary(m.nodes(s, d), m.properties(s, d))


@query(T("select row_number() over (order by value) as id, value from (select distinct value from (select name as value from n union all select primary_type from n union all select name from p union all select value from p union all select binary_reference from p) where value is not null)"))
def interned_ids(s, d):
    return interned.with_ids(interned.dictionary(m.nodes(s, d), m.properties(s, d)))


_WALK = "w(id, path) as (select id, '/' from interned_nodes where parent_id is null union all select n.id, case when w.path = '/' then '' else w.path end || '/' || s.value from interned_nodes n join w on n.parent_id = w.id join interned_strings s on s.id = n.name_id)"


@query(f"with recursive {_WALK} select id, path from w")
def node_paths(s, d):
    return interned.node_paths(table(s, d, "interned_nodes"), table(s, d, "interned_strings"))


@query(f"""with recursive {_WALK} select w.path, n.value as name, t.name as property_type, p.multiple, p.position, v.value, p.long_value, p.double_value, p.boolean_value, p.binary_length, b.value as binary_reference
  from interned_properties p join w on w.id = p.node_id join interned_strings n on n.id = p.name_id join property_types t on t.id = p.type_id
  left join interned_strings v on v.id = p.value_id left join interned_strings b on b.id = p.binary_reference_id""")
def properties_expanded(s, d):
    strings = table(s, d, "interned_strings")
    node = interned.node_paths(table(s, d, "interned_nodes"), strings)
    out = interned.expand(table(s, d, "interned_properties"), strings, table(s, d, "property_types"), node)
    return out.select("path", "name", "property_type", "multiple", "position", "value", "long_value", "double_value", "boolean_value", "binary_length", "binary_reference")


@query("select n.id, s.value as name, t.value as primary_type from interned_nodes n left join interned_strings s on s.id = n.name_id left join interned_strings t on t.id = n.primary_type_id")
def interned_names(s, d):
    strings, nodes = table(s, d, "interned_strings"), table(s, d, "interned_nodes").select("id", "name_id", "primary_type_id")
    named = lookup(nodes, strings, "name_id", "id", "value", "name", ["id"])
    return lookup(named, strings, "primary_type_id", "id", "value", "primary_type", ["id"], count_on=nodes).select("id", "name", "primary_type")


@query("select parent_id, count(distinct primary_type_id) as types, count(*) as children from interned_nodes where parent_id is not null group by 1")
def children_by_parent(s, d):
    return table(s, d, "interned_nodes").where("parent_id is not null").groupBy("parent_id").agg(F.countDistinct("primary_type_id").alias("types"), F.count(F.lit(1)).alias("children"))


# ---------------------------------------------------------------- collection journal, segments, planning

_JAVA = "case when raw_line = '' then [''] else list_slice(string_split(raw_line, ','), 1, coalesce(list_max(list_transform(string_split(raw_line, ','), lambda x, i: case when x <> '' then i else 0 end)), 0)) end"


def _lenient(k: str, t: str) -> str:
    return f"coalesce(case when regexp_full_match({k}, '[+-]?[0-9]+') then try_cast({k} as {t}) end, -1)"


def _gc_sql(source: str, key: str) -> str:
    return f"""with f as (select {key}, {_JAVA} as f from {source} where raw_line is not null),
  g as (select {key}, f[1] as a, f[2] as b, f[3] as c, f[4] as g, case when len(f) = 7 then f[5] else f[4] end as h, case when len(f) = 7 then f[6] else f[5] end as n, case when len(f) = 7 then f[7] else f[6] end as r from f)
  select {key}, {_lenient('a', 'bigint')} as repository_size, {_lenient('b', 'bigint')} as reclaimed_size, {_lenient('c', 'bigint')} as timestamp_milliseconds, {_lenient('g', 'int')} as generation, {_lenient('h', 'int')} as full_generation,
    {_lenient('n', 'bigint')} as compacted_nodes, coalesce(r, '00000000-0000-0000-0000-000000000000:0') as root_record_identifier_text from g"""


@query(_gc_sql("gc_journal_lines", "line_id"))
def gc_log_parse(s, d):
    return table(s, d, "gc_journal_lines").where("raw_line is not null").select("line_id", *parse_gc_line())


@query(_gc_sql("(select * from (select *, row_number() over (partition by store_name order by file_line desc, raw_line desc) as k from gc_journal_lines where raw_line is not null) where k = 1)", "store_name"))
def gc_log_last(s, d):
    return last_gc_entry(table(s, d, "gc_journal_lines"), "store_name", "file_line")


def G(body: str) -> str:  # noqa: N802
    return m.SEGMENTS_SQL + body


@query(G(" select archive, count(*) filter (kind = 'data') as data_segments, count(*) filter (kind = 'bulk') as bulk_segments, sum(size)::bigint as bytes from s group by 1"))
def segment_summary(s, d):
    return m.segments(s, d).groupBy("archive").agg(F.count_if(F.col("kind") == "data").alias("data_segments"), F.count_if(F.col("kind") == "bulk").alias("bulk_segments"), F.sum("size").alias("bytes"))


@query("select l_shipdate::date as day, l_linenumber as record_type, count(*) as records from lineitem group by 1, 2")
def record_histogram(s, d):
    return table(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").alias("record_type")).agg(F.count(F.lit(1)).alias("records"))


_FILES = "(select printf('data%05d%s.tar', o_orderkey % 300, chr(97 + (o_orderkey % 7)::int)) as file_name, o_orderstatus = 'F' as index_valid from orders union all select printf('data%05d.tar', p_partkey % 40), false from part union all select 'notes-' || p_partkey || '.tar', true from part)"


def _files(s, d):
    k = F.col("o_orderkey")
    a = table(s, d, "orders").select(F.format_string("data%05d%s.tar", k % 300, F.chr(97 + k % 7)).alias("file_name"), (F.col("o_orderstatus") == "F").alias("index_valid"))
    p = F.col("p_partkey")
    b = table(s, d, "part").select(F.explode(F.array(F.struct(F.format_string("data%05d.tar", p % 40).alias("file_name"), F.lit(False).alias("index_valid")), F.struct(F.concat(F.lit("notes-"), p, F.lit(".tar")).alias("file_name"), F.lit(True).alias("index_valid")))).alias("x")).select("x.*")
    return a.unionByName(b)


_LETTERS = f"(select *, regexp_extract(file_name, '^data([0-9]{{5,}})', 1)::bigint as archive_number, coalesce(nullif(regexp_extract(file_name, '^data[0-9]{{5,}}([a-z])', 1), ''), 'a') as letter from {_FILES} where regexp_full_match(file_name, 'data[0-9]{{5,}}[a-z]?\\.tar'))"


@query(f"select archive_number, letter, file_name from (select *, row_number() over (partition by archive_number order by letter desc, file_name desc) as k from {_LETTERS}) where k = 1")
def archive_letter_selection(s, d):
    return gc.newest_letters(_files(s, d))


@query(f"select archive_number, letter, file_name from (select *, row_number() over (partition by archive_number order by index_valid desc, letter desc, file_name desc) as k from {_LETTERS}) where k = 1")
def archive_valid_selection(s, d):
    return gc.newest_letters(_files(s, d), "index_valid")


@query(G(" select segment, min_by(archive, source) as archive from (select segment, archive, source from r join s on s.segment = r.target) group by 1"))
def distinct_segments(s, d):
    entries = m.references(s, d).join(m.segments(s, d).select(F.col("segment").alias("target"), "archive"), "target").select(F.col("target").alias("segment"), "archive", "source")
    return gc.first_locations(entries, "source")


def _mark_sql(full: bool, retained: int) -> str:
    old = f"h.generation - s.generation >= {retained}"
    rule = f"(h.full_generation - s.full_generation >= {retained} or ({old} and not s.is_compacted))" if full else f"({old} and not (s.is_compacted and s.full_generation = h.full_generation))"
    return f""", f as (select s.*, case when s.segment = h.segment then false when s.is_compacted and (s.archive, s.position) > (h.archive, h.position) then true when s.kind = 'data' then {rule} end as first from s, h),
      mk as (select segment, archive, kind, size, coalesce(first, segment not in (select target from r where source in (select segment from f where kind = 'data' and not first))) as reclaimable from f)"""


def _marked(s, d, full=True, retained=2):
    return gc.mark(m.segments(s, d), m.references(s, d), m.head(s, d), full, retained)


@query(G(_mark_sql(True, 2) + " select segment, archive, kind, size, reclaimable from mk"))
def reclaim_mark(s, d):
    return _marked(s, d)


@query(G(_mark_sql(False, 2) + " select segment, archive, kind, size, reclaimable from mk"))
def reclaim_mark_tail(s, d):
    return _marked(s, d, full=False)


@query(G(_mark_sql(True, 2) + " select segment from mk where kind = 'bulk' and not reclaimable"))
def bulk_survivors(s, d):
    return _marked(s, d).where("kind = 'bulk' and not reclaimable").select("segment")


_SWEEP = """, sw as (select archive, entries, segments, before, after, 'a' as letter, (archive[5:9])::int as k from (select archive, count(*) as entries, count(*) filter (reclaimable) as segments, sum(512 + ceil(size / 512)::bigint * 512)::bigint as before,
      coalesce(sum(512 + ceil(size / 512)::bigint * 512) filter (not reclaimable), 0)::bigint as after from mk group by 1) where segments > 0),
    w as (select *, (((before * 3 + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648 as wrapped from sw),
    de as (select archive, case when segments = entries and k % 5 = 0 then 'BlockedByOccupiedGeneration' when segments = entries then 'Remove' when after >= trunc(wrapped / 4) then 'DeferredBySavings'
      when k % 5 = 0 then 'BlockedByOccupiedGeneration' else 'Rewrite' end as decision, segments, before - after as eligible_bytes from w)"""


def _swept(s, d, full=True, retained=2):
    marked = _marked(s, d, full, retained)
    files = m.segments(s, d).select(F.col("archive").alias("file_name")).distinct()
    number = F.substring("file_name", 5, 5).cast("int")
    occupied = files.where(number % 5 == 0).select(F.format_string("data%05db.tar", number).alias("file_name"))
    return gc.sweep(marked, files.unionByName(occupied), savings_gate=True)


@query(G(_mark_sql(True, 2) + _SWEEP + " select archive, decision, segments, eligible_bytes, case when decision in ('Remove', 'Rewrite') then eligible_bytes else 0 end as freed_bytes from de"))
def sweep_decision(s, d):
    return _swept(s, d)


@query(G(_mark_sql(True, 2) + _SWEEP + " select decision, count(*) as archives, sum(segments)::bigint as segments, sum(eligible_bytes)::bigint as eligible_bytes, sum(case when decision in ('Remove', 'Rewrite') then eligible_bytes else 0 end)::bigint as freed_bytes from de group by 1"))
def sweep_totals(s, d):
    return gc.sweep_totals(_swept(s, d))


@query("select o_orderkey, a >= trunc((((b * 3 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) / 4) as defers from (select o_orderkey, floor(o_totalprice)::bigint * (o_orderkey % 9000) as b, floor(o_totalprice)::bigint * 3000 as a from orders)")
def savings_gate(s, d):
    price = F.floor("o_totalprice").cast("bigint")
    return table(s, d, "orders").select("o_orderkey", values.sweep_defers(price * (F.col("o_orderkey") % 9000), price * 3000).alias("defers"))


@query(G(_mark_sql(True, 1) + ", mk2 as (select * from mk) select (select sum(size) from mk2 where reclaimable)::bigint as without_veto, (select sum(size) from mk2 where reclaimable and segment not in (select segment from s where kind = 'data' and position % 10 = 0))::bigint as with_veto"))
def history_veto_price(s, d):
    """What segments that histories veto would free: the plan twice, with and without them."""
    marked = _marked(s, d, retained=1)
    vetoed = m.segments(s, d).where("kind = 'data' and position % 10 = 0").select("segment")
    with_veto = marked.where("reclaimable").join(vetoed.withColumn("v", F.lit(True)), "segment", "left")
    return with_veto.agg(F.sum("size").alias("without_veto"), F.sum(F.when(F.col("v").isNull(), F.col("size"))).alias("with_veto"))


@query(f"with recursive c(k) as (select {m.HEAD_KEY_SQL} union all select k // 3 from c where k > 0) select distinct {m._uuid_sql('k', 'a')} as segment from c")
def segment_closure(s, d):
    return gc.closure(m.head(s, d).select("segment"), m.chain(s, d))


@query(f"with recursive c(k) as (select {m.HEAD_KEY_SQL} union all select k // 3 from c where k > 0), cl as (select distinct {m._uuid_sql('k', 'a')} as segment from c), " + m.SEGMENTS_SQL.removeprefix("with ") + _mark_sql(True, 2) + " select segment from mk where reclaimable and segment in (select segment from cl)")
def reclaim_invariant(s, d):
    """Segments that the head reaches but the mark would free: they must be protected."""
    reached = gc.closure(m.head(s, d).select("segment"), m.chain(s, d))
    return _marked(s, d).where("reclaimable").join(reached, "segment", "left_semi").select("segment")


@query(G(" select count(*) as segments, coalesce(bool_and((s.generation, s.full_generation, s.is_compacted) = (h.generation, h.full_generation, h.is_compacted) and h.is_compacted), false) as uniform from s, h where s.kind = 'data'"))
def convergence_gate(s, d):
    return gc.convergence(m.segments(s, d), m.head(s, d))


@query(G(" select segment, generation + 1 as tail_generation, full_generation as tail_full, generation + 1 as full_run_generation, full_generation + 1 as full_run_full from s"))
def target_generations(s, d):
    """The generation that a tail and a full compaction would write after each segment's."""
    of = lambda full: maintenance.target_generation(F.col("generation"), F.col("full_generation"), full)
    tail, full = of(False), of(True)
    return m.segments(s, d).select("segment", tail["generation"].alias("tail_generation"), tail["full_generation"].alias("tail_full"), full["generation"].alias("full_run_generation"), full["full_generation"].alias("full_run_full"))


@query(f"""select distinct file_name, case when best is null then 'undecided' when letter || file_name = best then 'active' when letter || file_name < best then 'stale' else 'unusable' end as state
  from (select *, max(case when index_valid then letter || file_name end) over (partition by archive_number) as best from (select file_name, archive_number, letter, bool_or(index_valid) as index_valid from {_LETTERS} group by all))""")
def archive_states(s, d):
    files = _files(s, d).groupBy("file_name").agg(F.max("index_valid").alias("index_valid"))
    return maintenance.archive_states(files.withColumn("size", F.lit(1)))


@query("""select distinct 'journal.log.cleaning.' || lpad((p_partkey % 1200)::varchar, 3, '0') as file_name, 'journal' as kind from part where p_partkey % 1200 < 1000
  union select distinct printf('data%05da.tar.recovering', p_partkey % 40), 'archive' from part""")
def temporary_files(s, d):
    k = F.col("p_partkey")
    counter = F.lpad((k % 1200).cast("string"), F.greatest(F.lit(3), F.length((k % 1200).cast("string"))), F.lit("0"))
    names = F.array(F.concat(F.lit("journal.log.cleaning."), counter), F.format_string("data%05da.tar.recovering", k % 40), F.format_string("data%05da.tar", k % 40))
    return maintenance.temporaries(table(s, d, "part").select(F.explode(names).alias("file_name")).distinct())


@query(G(" select s.generation, count(*) as segments from s, h where s.kind = 'data' and s.generation > h.generation group by 1"))
def interrupted_residue(s, d):
    newest = m.head(s, d).agg(F.max("generation")).scalar()
    return m.segments(s, d).where((F.col("kind") == "data") & (F.col("generation") > newest)).groupBy("generation").agg(F.count(F.lit(1)).alias("segments"))


@query(G(" select segment, (select count(distinct target) from r where r.source = s.segment) as \"references\" from s"))
def graph_totalization(s, d):
    return gc.totalized_graph(m.segments(s, d), m.references(s, d))


@query(G(" select kind, sum(size)::bigint as bytes from s where segment in (select target from r) or kind = 'data' group by 1"))
def index_bytes_by_kind(s, d):
    s0 = m.segments(s, d)
    held = m.references(s, d).select(F.col("target").alias("segment")).distinct().unionByName(s0.where("kind = 'data'").select("segment"))
    return s0.join(held, "segment", "left_semi").groupBy("kind").agg(F.sum("size").alias("bytes"))


@query(G(_mark_sql(True, 2) + """ select case when m.kind = 'bulk' then 'bulk without referrers' when s.is_compacted and (s.archive, s.position) > (h.archive, h.position) then 'ahead of the head' when s.is_compacted then 'old full generation'
    else 'old generation' end as reason, count(*) as segments, sum(m.size)::bigint as bytes from mk m join s using (segment), h where m.reclaimable group by 1"""))
def reclaimable_by_reason(s, d):
    head = m.head(s, d).agg(F.max(F.struct("archive", "position"))).scalar()
    marked = _marked(s, d).where("reclaimable").join(m.segments(s, d).select("segment", "is_compacted", "position"), "segment")
    ahead = F.col("is_compacted") & (F.struct("archive", "position") > head)
    reason = F.when(F.col("kind") == "bulk", "bulk without referrers").when(ahead, "ahead of the head").when(F.col("is_compacted"), "old full generation").otherwise("old generation")
    return marked.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("segments"), F.sum("size").alias("bytes"))


@query(G(_mark_sql(True, 2) + " select target as segment, count(*) as kept_referrers from r join mk on mk.segment = r.source where not mk.reclaimable group by 1 having count(*) > 1"))
def shared_bulk(s, d):
    """Bulk segments that more than one data segment that stays refers to."""
    kept = _marked(s, d).where("kind = 'data' and not reclaimable").select(F.col("segment").alias("source"))
    n = m.references(s, d).join(kept, "source", "left_semi").groupBy(F.col("target").alias("segment")).agg(F.count(F.lit(1)).alias("kept_referrers"))
    return n.where("kept_referrers > 1")


@query(G(_mark_sql(True, 2) + " select target as segment from r where source in (select segment from mk where kind = 'data' and reclaimable) except select target from r where source in (select segment from mk where kind = 'data' and not reclaimable)"))
def released_bulk(s, d):
    """What only segments that go refer to."""
    marked, r = _marked(s, d).where("kind = 'data'"), m.references(s, d)
    of = lambda goes: r.join(marked.where(F.col("reclaimable") == goes).select(F.col("segment").alias("source")), "source", "left_semi").select(F.col("target").alias("segment"))
    return of(True).distinct().join(of(False).distinct(), "segment", "left_anti")


@query(A("select count(*) as rows, count(distinct (path, primary_type)) as distinct_nodes from n where primary_type is not null"))
def distinct_verified(s, d):
    """Rows of all snapshots, and the different nodes among them, each verified once."""
    n = m.all_nodes(s, d).where("primary_type is not null").groupBy("path", "primary_type").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_nodes"))


@query(T(f"select {NC} from n where not (path = '{INBOX}' or starts_with(path, '{INBOX}/')) union all select '{INBOX}', '/content/dam', 'inbox', 3, 'nt:folder'"))
def committed_nodes(s, d):
    """The tree after a commit that removes a subtree and puts an empty node in its place."""
    put = s.createDataFrame([(INBOX, "/content/dam", "inbox", 3, "nt:folder")], NODES)
    n, p = m.nodes(s, d), m.properties(s, d)
    return commits.edited(n, p, put.select("path"), put, p.limit(0))[0]


# ---------------------------------------------------------------- histories, checkpoints, binaries


def H(body: str) -> str:  # noqa: N802
    return m.HISTORIES_SQL + body


NOW, YEAR = 883_612_800, 31_536_000


@query(T("select count(*) as binaries, coalesce(sum(try_cast(regexp_extract(r, '#([0-9]+)$', 1) as bigint)), 0)::bigint as measured_bytes, count(*) filter (try_cast(regexp_extract(r, '#([0-9]+)$', 1) as bigint) is null) as unmeasured from (select distinct binary_reference as r from p where r is not null)"))
def external_binary_footprint(s, d):
    return orphans.external_footprint(m.properties(s, d))


@query(T("select distinct lower(value) as identifier from p where name = 'jcr:uuid' and property_type = 'String' and not multiple and regexp_full_match(value, '(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}')"))
def live_identifiers(s, d):
    return orphans.live_identifiers(m.properties(s, d), m.STORAGE)


@query(H(""" select hi.path, hi.history, max(epoch(l_shipdate::date))::bigint as newest, coalesce(sum(l_quantity::int), 0)::bigint as bytes, 1 + 2 * count(distinct l_linenumber) as nodes, 0::bigint as external_references,
    hi.configuration and count(l_orderkey) > 0 as configuration from hi left join lineitem on l_orderkey = hi.key group by hi.path, hi.history, hi.configuration"""))
def history_facts(s, d):
    """What the content of version storage says of each history."""
    return orphans.history_facts(*m.version_storage(s, d), m.STORAGE, "key")


@query("select o_orderkey, case when a > 0 then (a // a1) * 0 + (b // a) * n + ((b % a) * n) // a else 0 end as estimate from (select o_orderkey, o_orderkey % 9 as a, greatest(o_orderkey % 9, 1) as a1, floor(o_totalprice)::bigint as b, o_custkey as n from orders)")
def record_bytes_estimate(s, d):
    return table(s, d, "orders").select("o_orderkey", orphans.record_bytes(F.floor("o_totalprice").cast("bigint"), F.col("o_orderkey") % 9, F.col("o_custkey")).alias("estimate"))


@query(H(" select history from orphan"))
def orphan_histories(s, d):
    return orphans.orphans(m.histories(s, d), m.live(s, d)).select("history")


@query(H(" select count(*) as histories, count(*) filter (history like 'broken-%') as malformed, (select count(*) from orphan) as orphans, (select sum(nodes) from orphan)::bigint as orphan_nodes, (select sum(bytes) from orphan)::bigint as orphan_bytes, (select count(*) from orphan where configuration) as orphan_configurations from hi"))
def orphan_report(s, d):
    return orphans.report(m.histories(s, d), m.live(s, d))


@query(H(" select distinct history from orphan where history in (select value from links)"))
def inbound_demotions(s, d):
    lost = orphans.orphans(m.histories(s, d), m.live(s, d))
    return orphans.inbound(m.links(s, d), lost.select("history", "identifier"))


def _purgeable(s, d):
    lost = orphans.orphans(m.histories(s, d), m.live(s, d))
    return orphans.purgeable(lost, orphans.inbound(m.links(s, d), lost.select("history", "identifier")), NOW, YEAR)


@query(H(" select history from gone"))
def purge_selection(s, d):
    return _purgeable(s, d).select("history")


_UP = "(select path, count(*) as {0} from (select unnest(list_transform(range(1, len({1})), lambda i: '/' || array_to_string({1}[1:i], '/'))) as path from {2}) group by 1)"


@query(H(f" select path, histories from {_UP.format('histories', SEGMENTS_OF, 'hi')}"))
def histories_under_intermediate(s, d):
    return orphans.under_intermediates(m.histories(s, d))


@query(H(f" select path from {_UP.format('total', SEGMENTS_OF, 'hi')} join {_UP.format('gone', SEGMENTS_OF, 'gone')} using (path) where total = gone and starts_with(path, '{m.STORAGE}/')"))
def empty_intermediates(s, d):
    return orphans.empty_intermediates(m.histories(s, d), _purgeable(s, d), m.STORAGE)


def C(body: str) -> str:  # noqa: N802
    return m.CHECKPOINTS_SQL + body


AT = 1_702_000_000_000


@query(C(f" select name, coalesce({AT} > expires_ms, false) as expired, coalesce({AT} > expires_ms, true) as purged from c"))
def expired_checkpoints(s, d):
    return m.checkpoints(s, d).select("name", checkpoints.expired(AT).alias("expired"), checkpoints.expired(AT, missing_counts=True).alias("purged"))


@query(C(" select name from c where name not in (select value from a)"))
def unreferenced_checkpoints(s, d):
    return checkpoints.unreferenced(m.checkpoints(s, d), m.async_references(s, d)).select("name")


@query(C(" select distinct value from a where name not like '%-temp' and value not in (select name from c)"))
def dangling_async(s, d):
    return checkpoints.dangling(m.async_references(s, d), m.checkpoints(s, d))


@query("select c_custkey, (least(created::hugeint + life, 9223372036854775807))::bigint as expires from (select c_custkey, 9223372036854000000 + c_custkey as created, floor(c_acctbal * 1000)::bigint as life from customer)")
def checkpoint_expiry(s, d):
    """Sums that go beyond 64 bits, those of the times of creation as well, and are cut off at the end."""
    created = F.lit(9223372036854000000).cast("decimal(20,0)") + F.col("c_custkey").cast("decimal(20,0)")
    return table(s, d, "customer").select("c_custkey", checkpoints.expiry(created, F.floor(F.col("c_acctbal") * 1000).cast("bigint")).alias("expires"))


@query("""select target, name, (mtime > 5000 or 5000 - mtime < 1000 or rank() over (partition by target order by mtime desc) <= 3) as kept
  from (select 'data' || l_suppkey as target, l_orderkey || '-' || l_linenumber as name, (l_partkey * 37 + l_linenumber) % 6000 as mtime from (select distinct l_suppkey, l_orderkey, l_linenumber, l_partkey from lineitem))""")
def backup_retention(s, d):
    lines = table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").distinct()
    backups = lines.select(F.concat(F.lit("data"), "l_suppkey").alias("target"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("name"), ((F.col("l_partkey") * 37 + F.col("l_linenumber")) % 6000).alias("mtime"))
    return versions.kept_backups(backups, 5000, 1000, 3).select("target", "name", "kept")


@query("select distinct md5(text) as record, length(text)::int as size from documents where text is not null")
def dag_dedup(s, d):
    """A deep copy keeps shared content shared: one record per distinct content."""
    return table(s, d, "documents").where("text is not null").select(F.md5("text").alias("record"), F.length("text").alias("size")).distinct()
