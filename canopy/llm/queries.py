"""Queries of the text operators: problems 3, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.bpe import decode, encode
from canopy.llm.frequency import count_terms, mark_terms
from canopy.llm.leaks import leaked_items
from canopy.llm.truncation import judge_texts, truncated_share
from canopy.operators.common import latest_rows
from canopy.sources.tables import table

RARE_BELOW, COMMON_ABOVE = 3, 0.4
NEAR_EDITS, LONGEST = 3, 3


def p3_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Rows and paths of every property name, primary type and property type, with marks.

    A property's name and type are one sequence: the counts of a name are those of
    a prefix, added up over the types behind it.
    """
    node_rows, property_rows = table(spark, d, "node_rows"), table(spark, d, "property_rows")
    nodes = latest_rows(node_rows, ["snapshot_id", "path"], "delivered_at", ["primary_type"])
    properties = latest_rows(property_rows, ["snapshot_id", "path", "name", "position"], "delivered_at", ["property_type"])
    told = lambda field, term: F.concat(F.lit(f"{field}="), F.col(term))
    rows = properties.select("path", F.lit("property").alias("field"), F.array(told("property_name", "name"), told("property_type", "property_type")).alias("terms"))
    rows = rows.unionByName(nodes.where(F.col("primary_type").isNotNull()).select("path", F.lit("node").alias("field"), F.array(told("primary_type", "primary_type")).alias("terms")))
    # a path's rows of a sequence, over all snapshots, travel as one
    per_path = rows.groupBy("field", "terms", F.col("path").alias("record")).agg(F.count(F.lit(1)).alias("n_rows"))
    # paths with properties are nodes: their rows bound the number of records, well enough for the shares
    counted = count_terms(per_path, longest=2, most_records=node_rows.count()).where(F.size("term") == 1)
    counted = counted.select(F.substring_index(F.col("term")[0], "=", 1).alias("field"), F.expr("substring(term[0], instr(term[0], '=') + 1)").alias("term"), "n_rows", "n_records")
    marked = mark_terms(counted, node_rows.select("path").distinct(), RARE_BELOW, COMMON_ABOVE)
    return marked.select("field", "term", "n_rows", F.col("n_records").alias("n_paths"), "mark")


def p3_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Rows and paths of every sequence of up to three names along the paths of nodes, with marks."""
    node_rows = table(spark, d, "node_rows")
    paths = node_rows.groupBy(F.col("path").alias("record")).agg(F.countDistinct("snapshot_id").alias("n_rows"))
    sequences = paths.select(F.lit("names").alias("field"), F.filter(F.split("record", "/"), lambda n: n != "").alias("terms"), "record", "n_rows")
    counted = count_terms(sequences, longest=LONGEST, most_records=node_rows.count())
    marked = mark_terms(counted, node_rows.select("path").distinct(), RARE_BELOW, COMMON_ABOVE)
    return marked.select(F.array_join("term", "/").alias("term"), F.size("term").alias("names"), "n_rows", F.col("n_records").alias("n_paths"), "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The terms too rare or too common to help."""
    return p3_frequency(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether every document's ids decode to its text; those of a null one to an empty text."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    texts = decode(encode(documents)).withColumnRenamed("text", "decoded")
    return documents.join(texts, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold twelve consecutive words of a test item."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold twelve words of a test item with at most three edits."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), edits=NEAR_EDITS)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that their source stored only in part."""
    return judge_texts(table(spark, d, "documents")).where("truncated").select("doc_id")


def p8_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The same with the evidence that decided, as one text."""
    return judge_texts(table(spark, d, "documents")).where("truncated").select("doc_id", "source", F.array_join("evidence", "+").alias("evidence"))


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncated_share(judge_texts(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p3_found, p3_frequency, p3_ngrams, p6_ids, p6_round_trip, p7_found, p7_near, p8_found, p8_evidence, p8_sources)}

_P3 = """
  with n as (select snapshot_id, path, arg_max(coalesce('v' || primary_type, 'n'), delivered_at) as t from node_rows group by all),
  p as (select snapshot_id, path, name, position, arg_max(property_type, delivered_at) as t from property_rows group by all),
  terms as (select 'property_name' as field, name as term, path from p union all select 'property_type', t, path from p union all select 'primary_type', t[2:], path from n where t like 'v%'),
  counted as (select field, term, count(*) as n_rows, count(distinct path) as n_paths from terms where term is not null group by 1, 2),
  marked as (select *, case when n_paths < 3 then 'rare' when n_paths > 0.4 * (select count(distinct path) from node_rows) then 'common' end as mark from counted)"""
SQL = {
    "p3_found": _P3 + " select field, term, mark from marked where mark is not null",
    "p3_ngrams": """
      with n as (select path, count(distinct snapshot_id) as c, list_filter(string_split(path, '/'), lambda x: x <> '') as t from node_rows group by 1),
      g as (select path, c, t, unnest(range(1, len(t) + 1)) as i from n), k as (select path, c, t, i, unnest(range(1, least(3, len(t) - i + 1) + 1)) as w from g),
      s as (select array_to_string(t[i:i + w - 1], '/') as term, w::int as names, sum(c)::bigint as n_rows, count(distinct path) as n_paths from k group by 1, 2)
      select *, case when n_paths < 3 then 'rare' when n_paths > 0.4 * (select count(distinct path) from node_rows) then 'common' end as mark from s""",
    "p3_frequency": _P3 + " select field, term, n_rows, n_paths, mark from marked",
}
