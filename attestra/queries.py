"""Registered queries over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.positions import scratch, with_position
from attestra.harness import score
from attestra.model import ORD, All, AnyOf, ColumnRef, Condition, Dataset, Leaf, Literal, Not, Values
from attestra.operators import joins, operations
from attestra.operators.conditions import violations
from attestra.plans import post
from attestra.plans.batch import batch_issues
from attestra.plans.engine import Knowledge, validate
from attestra.plans.rules import parse_condition, parse_rule
from attestra.plans.tables import dataset_metadata, value_metadata, variable_metadata
from attestra.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

ORDERS = {
    "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"],
    "events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"], "nation": ["n_nationkey"], "region": ["r_regionkey"],
}


def dataset(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    """A test table; its rows' order is that of its key columns, as a struct where there are several."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    keys = ORDERS[name]
    return Dataset(name, df.withColumn(ORD, F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)), name.upper())


def dated(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders with texts of whole, partial and impossible dates, d and e, and of durations, p."""
    ds = dataset(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    d = F.when(k % 9 == 1, F.substring(day, 1, 4)).when(k % 9 == 2, F.substring(day, 1, 7)).when(k % 9 == 3, F.concat(F.substring(day, 1, 8), F.lit("31"))).when(k % 9 == 4, F.concat(day, F.lit("T10:30")))
    d = d.when(k % 9 == 5, F.lit("")).when(k % 9 == 6, F.lit(None)).when(k % 9 == 7, F.concat(day, F.lit("T25:00"))).when(k % 9 == 8, F.concat(day, F.lit("T07"))).otherwise(day)
    p = F.element_at(F.array(*map(F.lit, ["P1D", "PT5M", "P", "1D", "P1Y2M3DT4H", "P3W", "P1W2D", "P1DT", "PT", "-P1D", "+P1D"])), (k % 11 + 1).cast("int"))
    return ds.with_df(ds.df.select("o_orderkey", "o_custkey", "o_orderdate", d.alias("d"), F.concat(F.substring(day, 1, 5), F.lit("07-01")).alias("e"), p.alias("p"), ORD))


DATED = """(SELECT o_orderkey, o_custkey, substr(day, 1, 5) || '07-01' AS e, CASE o_orderkey % 9 WHEN 1 THEN substr(day, 1, 4) WHEN 2 THEN substr(day, 1, 7) WHEN 3 THEN substr(day, 1, 8) || '31'
 WHEN 4 THEN day || 'T10:30' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN day || 'T25:00' WHEN 8 THEN day || 'T07' ELSE day END AS d,
 ['P1D', 'PT5M', 'P', '1D', 'P1Y2M3DT4H', 'P3W', 'P1W2D', 'P1DT', 'PT', '-P1D', '+P1D'][CAST(o_orderkey % 11 + 1 AS INT)] AS p
 FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders))"""
DATE_KEY = "CASE WHEN try_cast(substr({0}, 1, 10) AS DATE) IS NOT NULL AND length({0}) = 10 THEN {0} || 'T00:00' WHEN try_cast(substr({0}, 1, 10) AS DATE) IS NOT NULL AND regexp_matches({0}, 'T([01][0-9]|2[0-3]):[0-5][0-9]') THEN {0} WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}') THEN {0} || '-01T00:00' WHEN regexp_full_match({0}, '[0-9]{{4}}') THEN {0} || '-01-01T00:00' END"


def listed(spark: SparkSession, sf_dir: str) -> Dataset:
    """Users with the list of their event types in order, and a second list."""
    ds = dataset(spark, sf_dir, "events")
    lists = ds.df.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("value") > 120, F.col("event_type")))), "|").alias("high"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("value") < 2, F.col("event_type")))), "|").alias("low"))
    return Dataset("lists", lists.withColumn(ORD, F.col("user_id")), "L")


LISTED = "(SELECT user_id, coalesce(string_agg(DISTINCT event_type, '|' ORDER BY event_type) FILTER (value > 120), '') AS high, coalesce(string_agg(DISTINCT event_type, '|' ORDER BY event_type) FILTER (value < 2), '') AS low FROM events GROUP BY user_id)"
SPLIT = "list_filter(string_split({0}, '|'), lambda x: x <> '')"


def padded(spark: SparkSession, sf_dir: str) -> Dataset:
    """Events with a text column that is empty or null in places, and enumerated columns."""
    ds = dataset(spark, sf_dir, "events")
    k = F.col("event_id")
    text = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit("")).otherwise(F.col("event_type"))
    return ds.with_df(ds.df.withColumns({"note": text, "x": F.col("event_type"), "x1": F.when(k % 3 > 0, F.lit("a")), "x2": F.when(k % 4 > 1, F.lit("b"))}))


PADDED = "(SELECT *, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END AS note, event_type AS x, CASE WHEN event_id % 3 > 0 THEN 'a' END AS x1, CASE WHEN event_id % 4 > 1 THEN 'b' END AS x2 FROM events)"


def flagged(source: Callable[[SparkSession, str], Dataset] | str, keys: list[str], condition: Condition, presence: bool | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = dataset(spark, sf_dir, source) if isinstance(source, str) else source(spark, sf_dir)
        return violations(ds, condition, presence).where("__mask").select(*keys)

    return run


def leaf(target: str, operator: str, value: object = None, **options: object) -> Leaf:
    comparator = value if isinstance(value, (Literal, ColumnRef, Values)) else Values(tuple(value)) if isinstance(value, list) else Literal(value)
    return Leaf(target, operator, comparator, options)


FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
COUNTED = "SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE n {0}"

#: name: (table, key columns, condition, SQL)
CONDITIONS: dict[str, tuple] = {
    "exists": (padded, ["event_id"], leaf("note", "exists"), f"SELECT event_id FROM {PADDED} WHERE note IS NOT NULL"),
    "not_exists": (padded, ["event_id"], leaf("note", "not_exists"), f"SELECT event_id FROM {PADDED} WHERE note IS NULL"),
    "is_empty": (padded, ["event_id"], leaf("note", "empty"), f"SELECT event_id FROM {PADDED} WHERE note IS NULL OR note = ''"),
    "is_not_empty": (padded, ["event_id"], leaf("note", "non_empty"), f"SELECT event_id FROM {PADDED} WHERE NOT (note IS NULL OR note = '')"),
    "equal_to": ("orders", ["o_orderkey"], leaf("o_orderstatus", "equal_to", "F"), "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'F'"),
    "not_equal_to": (padded, ["event_id"], leaf("note", "not_equal_to", ColumnRef("event_type")), f"SELECT event_id FROM {PADDED} WHERE note IS DISTINCT FROM event_type"),
    "equal_to_case_insensitive": ("customer", ["c_custkey"], leaf("c_mktsegment", "equal_to_case_insensitive", "Building"), f"SELECT c_custkey FROM customer WHERE {FOLD.format('c_mktsegment')} = 'building'"),
    "not_equal_to_case_insensitive": ("customer", ["c_custkey"], leaf("c_mktsegment", "not_equal_to_case_insensitive", "Building"), f"SELECT c_custkey FROM customer WHERE {FOLD.format('c_mktsegment')} IS DISTINCT FROM 'building'"),
    "equal_to_membership": ("orders", ["o_orderkey"], leaf("o_orderstatus", "equal_to", "F| P"), "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "equal_to_type_insensitive": ("part", ["p_partkey"], leaf("p_size", "equal_to", "7.0", type_insensitive=True), "SELECT p_partkey FROM part WHERE p_size = 7"),
    "contains": ("part", ["p_partkey"], leaf("p_name", "contains", "ring"), "SELECT p_partkey FROM part WHERE contains(p_name, 'ring')"),
    "does_not_contain": (padded, ["event_id"], leaf("note", "does_not_contain", "ch"), f"SELECT event_id FROM {PADDED} WHERE NOT coalesce(contains(note, 'ch'), false)"),
    "contains_case_insensitive": ("part", ["p_partkey"], leaf("p_type", "contains_case_insensitive", "mo"), f"SELECT p_partkey FROM part WHERE contains({FOLD.format('p_type')}, 'mo')"),
    "does_not_contain_case_insensitive": ("part", ["p_partkey"], leaf("p_type", "does_not_contain_case_insensitive", "mo"), f"SELECT p_partkey FROM part WHERE NOT contains({FOLD.format('p_type')}, 'mo')"),
    "contains_in_list": (listed, ["user_id"], leaf("high", "contains", "view"), f"SELECT user_id FROM {LISTED} WHERE CASE WHEN contains(high, '|') THEN list_contains(string_split(high, '|'), 'view') ELSE contains(high, 'view') END"),
    "is_contained_by": ("orders", ["o_orderkey"], leaf("o_orderpriority", "is_contained_by", ["1-URGENT", "2-HIGH"]), "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "is_not_contained_by": (padded, ["event_id"], leaf("note", "is_not_contained_by", ["view", "click"]), f"SELECT event_id FROM {PADDED} WHERE NOT coalesce(note IN ('view', 'click'), false)"),
    "is_contained_by_case_insensitive": ("orders", ["o_orderkey"], leaf("o_orderpriority", "is_contained_by_case_insensitive", ["1-urgent", "2-High"]), f"SELECT o_orderkey FROM orders WHERE {FOLD.format('o_orderpriority')} IN ('1-urgent', '2-high')"),
    "is_not_contained_by_case_insensitive": ("orders", ["o_orderkey"], leaf("o_orderpriority", "is_not_contained_by_case_insensitive", ["1-urgent", "2-High"]), f"SELECT o_orderkey FROM orders WHERE {FOLD.format('o_orderpriority')} NOT IN ('1-urgent', '2-high')"),
    "contains_all": (listed, ["user_id"], leaf("high", "contains_all", ["click", "view"]), f"SELECT user_id FROM {LISTED} WHERE list_has_all(list_append(string_split(high, '|'), high), ['click', 'view'])"),
    "not_contains_all": (listed, ["user_id"], leaf("high", "not_contains_all", ColumnRef("low")), f"SELECT user_id FROM {LISTED} WHERE NOT list_has_all(list_append(string_split(high, '|'), high), {SPLIT.format('low')})"),
    "shares_no_elements_with": (listed, ["user_id"], leaf("high", "shares_no_elements_with", ColumnRef("low")), f"SELECT user_id FROM {LISTED} WHERE NOT list_has_any({SPLIT.format('high')}, {SPLIT.format('low')})"),
    "is_not_ordered_subset_of": (listed, ["user_id"], leaf("low", "is_not_ordered_subset_of", ColumnRef("high")), f"SELECT user_id FROM {LISTED} WHERE NOT list_has_all({SPLIT.format('high')}, {SPLIT.format('low')})"),
    "less_than": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], leaf("l_quantity", "less_than", 5), "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity < 5"),
    "less_than_or_equal_to": ("part", ["p_partkey"], leaf("p_size", "less_than_or_equal_to", "9"), "SELECT p_partkey FROM part WHERE p_size <= 9"),
    "greater_than": ("orders", ["o_orderkey"], leaf("o_orderpriority", "greater_than", "3"), "SELECT o_orderkey FROM orders WHERE o_orderpriority > '3'"),
    "greater_than_or_equal_to": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], leaf("l_discount", "greater_than_or_equal_to", ColumnRef("l_tax")), "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount >= l_tax"),
    "matches_regex": ("part", ["p_partkey"], leaf("p_brand", "matches_regex", "#1[0-5]$"), "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#1[0-5]$')"),
    "does_not_match_regex": (padded, ["event_id"], leaf("note", "does_not_match_regex", "^[a-p]"), f"SELECT event_id FROM {PADDED} WHERE NOT coalesce(regexp_matches(note, '^[a-p]'), false)"),
    "not_matches_regex": ("supplier", ["s_suppkey"], leaf("s_name", "not_matches_regex", "Supplier#0+[1-9]"), "SELECT s_suppkey FROM supplier WHERE NOT regexp_full_match(s_name, 'Supplier#0+[1-9]')"),
    "longer_than": ("documents", ["doc_id"], leaf("text", "longer_than", 3000), "SELECT doc_id FROM documents WHERE length(text) > 3000"),
    "starts_with": ("part", ["p_partkey"], leaf("p_name", "starts_with", "small"), "SELECT p_partkey FROM part WHERE starts_with(p_name, 'small')"),
    "prefix_not_equal_to": (padded, ["event_id"], leaf("note", "prefix_not_equal_to", "v"), f"SELECT event_id FROM {PADDED} WHERE note <> '' AND NOT starts_with(note, 'v')"),
    "prefix_equal_to": ("part", ["p_partkey"], leaf("p_type", "prefix_equal_to", "ST", prefix=2), "SELECT p_partkey FROM part WHERE left(p_type, 2) = 'ST'"),
    "not_prefix_matches_regex": (padded, ["event_id"], leaf("note", "not_prefix_matches_regex", "^[a-e]i", prefix=3), f"SELECT event_id FROM {PADDED} WHERE note <> '' AND NOT regexp_matches(left(note, 3), '^[a-e]i')"),
    "prefix_is_not_contained_by": ("part", ["p_partkey"], leaf("p_type", "prefix_is_not_contained_by", ["PRO", "SMA"], prefix=3), "SELECT p_partkey FROM part WHERE left(p_type, 3) NOT IN ('PRO', 'SMA')"),
    "suffix_is_not_contained_by": ("part", ["p_partkey"], leaf("p_type", "suffix_is_not_contained_by", ["MO", "RD"], suffix=2), "SELECT p_partkey FROM part WHERE right(p_type, 2) NOT IN ('MO', 'RD')"),
    "ends_with": ("part", ["p_partkey"], leaf("p_name", "ends_with", "ring"), "SELECT p_partkey FROM part WHERE ends_with(p_name, 'ring')"),
    "suffix_matches_regex": ("supplier", ["s_suppkey"], leaf("s_name", "suffix_matches_regex", "^[0-4]5$", suffix=2), "SELECT s_suppkey FROM supplier WHERE regexp_matches(right(s_name, 2), '^[0-4]5$')"),
    "not_suffix_matches_regex": ("supplier", ["s_suppkey"], leaf("s_name", "not_suffix_matches_regex", "^[0-4]5$", suffix=2), "SELECT s_suppkey FROM supplier WHERE NOT regexp_matches(right(s_name, 2), '^[0-4]5$')"),
    "is_complete_date": (dated, ["o_orderkey"], leaf("d", "is_complete_date"), f"SELECT o_orderkey FROM {DATED} WHERE try_cast(substr(d, 1, 10) AS DATE) IS NOT NULL AND (length(d) = 10 OR regexp_matches(d, 'T([01][0-9]|2[0-3]):[0-5][0-9]'))"),
    "is_incomplete_date": (dated, ["o_orderkey"], leaf("d", "is_incomplete_date"), f"SELECT o_orderkey FROM {DATED} WHERE d = '' OR length(d) IN (4, 7) OR (length(d) = 13 AND try_cast(substr(d, 1, 10) AS DATE) IS NOT NULL)"),
    "invalid_date": (dated, ["o_orderkey"], leaf("d", "invalid_date"), f"SELECT o_orderkey FROM {DATED} WHERE length(d) > 7 AND (try_cast(substr(d, 1, 10) AS DATE) IS NULL OR regexp_matches(d, 'T25'))"),
    "invalid_duration": (dated, ["o_orderkey"], leaf("p", "invalid_duration"), f"SELECT o_orderkey FROM {DATED} WHERE p IN ('P', '1D', 'P1W2D', 'PT', '-P1D', '+P1D')"),
    "target_is_not_sorted_by": (
        "events", ["event_id"], leaf("value", "target_is_not_sorted_by", [{"name": "event_type"}], within="user_id"),
        "SELECT event_id FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi, min(value) OVER (PARTITION BY user_id ORDER BY b RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lo FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS b FROM events)) WHERE hi > value OR lo < value",
    ),
    "empty_within_except_last_row": (padded, ["event_id"], leaf("note", "empty_within_except_last_row", ColumnRef("user_id"), ordering="event_id"), f"SELECT event_id FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM {PADDED}) WHERE event_id <> last AND (note IS NULL OR note = '')"),
    "does_not_have_next_corresponding_record": ("events", ["event_id"], leaf("event_type", "does_not_have_next_corresponding_record", ColumnRef("event_type"), ordering="event_id", within="user_id"), "SELECT event_id FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS e FROM events) WHERE e IS NOT NULL AND e <> event_type"),
    "not_present_on_multiple_rows_within": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], leaf("l_returnflag", "not_present_on_multiple_rows_within", None, within="l_orderkey"), "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS n FROM lineitem) WHERE n = 1"),
    "inconsistent_enumerated_columns": (padded, ["event_id"], leaf("x", "inconsistent_enumerated_columns"), f"SELECT event_id FROM {PADDED} WHERE x1 IS NULL AND x2 IS NOT NULL"),
    "is_not_unique_set": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], leaf("l_orderkey", "is_not_unique_set", ["l_linenumber"]), "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1"),
    "is_unique_set": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], leaf("l_orderkey", "is_unique_set", ["l_linenumber"]), "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1"),
    "is_not_unique_relationship": ("supplier", ["s_suppkey"], leaf("s_nationkey", "is_not_unique_relationship", ColumnRef("s_name"), direction="target_to_comparator"), "SELECT s_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE n > 1"),
    "is_inconsistent_across_dataset": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], leaf("l_linestatus", "is_inconsistent_across_dataset", ["l_orderkey"]), "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, min(l_linestatus) OVER (PARTITION BY l_orderkey) AS a, max(l_linestatus) OVER (PARTITION BY l_orderkey) AS b FROM lineitem) WHERE a <> b"),
    "does_not_equal_string_part": ("pages", ["page_id"], leaf("url", "does_not_equal_string_part", ColumnRef("url"), regex="^(https?://[^?#]*)"), "SELECT page_id FROM pages WHERE regexp_matches(url, '^(https?://[^?#]*)') AND url <> regexp_extract(url, '^(https?://[^?#]*)', 1)"),
    "all_any_not": (
        "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], All((AnyOf((leaf("l_returnflag", "equal_to", "R"), leaf("l_quantity", "greater_than", 45))), Not(leaf("l_linestatus", "equal_to", "O")))),
        "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_returnflag = 'R' OR l_quantity > 45) AND NOT l_linestatus = 'O'",
    ),
    "expression_text": ("customer", ["c_custkey"], parse_condition('c_mktsegment in ["BUILDING", "MACHINERY"] and (c_nationkey > 20 or $not(c_acctbal >= 0))'), "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND (c_nationkey > 20 OR NOT c_acctbal >= 0)"),
}
for _name, _sign in (("equal_to", "="), ("not_equal_to", "<>"), ("less_than", "<"), ("less_than_or_equal_to", "<="), ("greater_than", ">"), ("greater_than_or_equal_to", ">=")):
    CONDITIONS[f"date_{_name}"] = (dated, ["o_orderkey"], leaf("d", f"date_{_name}", ColumnRef("e")), f"SELECT o_orderkey FROM {DATED} WHERE {DATE_KEY.format('d')} {_sign} {DATE_KEY.format('e')}")


def operated(source: Callable[[SparkSession, str], Dataset] | str, columns: list[str], *specs: dict, others: tuple[str, ...] = ()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = dataset(spark, sf_dir, source) if isinstance(source, str) else source(spark, sf_dir)
        context = operations.Context([ds, *[dataset(spark, sf_dir, o) for o in others]], parse_condition)
        for spec in specs:
            ds = operations.apply(ds, spec, context)
        return ds.df.select(*[F.round(c, 4).alias(c) if ds.df.schema[c].dataType.typeName() == "double" else F.col(c) for c in columns])

    return run


OPEN = {"operator": "filter", "where": {"name": "o_orderstatus", "operator": "equal_to", "value": "O", "value_is_literal": True}}
LINES = ["l_orderkey", "l_linenumber", "l_partkey"]
LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"

OPERATED: dict[str, tuple[Query, str]] = {
    "filter": (operated("orders", ["o_orderkey", "o_totalprice"], OPEN), "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_orderstatus = 'O'"),
    "derive": (operated("part", ["p_partkey", "flag", "kind", "said"], {"operator": "derive", "target": "flag", "value": "Y"}, {"operator": "derive", "target": "kind", "from": "p_type"}, {"operator": "derive", "target": "said", "expression": '$concat($lowercase(p_type), "-", $uppercase(p_name))'}), "SELECT p_partkey, 'Y' AS flag, p_type AS kind, lower(p_type) || '-' || upper(p_name) AS said FROM part"),
    "aggregate_count": (operated("lineitem", [*LINES, "n"], {"operator": "aggregate", "by": ["l_orderkey"], "as": "n"}), "SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"),
    "aggregate_count_filtered": (operated("lineitem", [*LINES, "n"], {"operator": "aggregate", "by": ["l_orderkey"], "as": "n", "filter": {"l_returnflag": "R"}}), "SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS BIGINT) AS n FROM lineitem"),
    "aggregate_sum": (operated("lineitem", [*LINES, "s"], {"operator": "aggregate", "function": "sum", "source_column": "l_quantity", "by": ["l_orderkey"], "as": "s"}), "SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) OVER (PARTITION BY l_orderkey), 4) AS s FROM lineitem"),
    "aggregate_mean": (operated("orders", ["o_orderkey", "m"], {"operator": "aggregate", "function": "avg", "source_column": "o_custkey", "by": ["o_orderpriority"], "as": "m"}), "SELECT o_orderkey, round(avg(o_custkey) OVER (PARTITION BY o_orderpriority), 4) AS m FROM orders"),
    "aggregate_min_max": (operated("events", ["event_id", "lo", "hi"], {"operator": "aggregate", "function": "min", "source_column": "value", "by": ["user_id"], "as": "lo"}, {"operator": "aggregate", "function": "max", "source_column": "value", "by": ["user_id"], "as": "hi"}), "SELECT event_id, round(min(value) OVER (PARTITION BY user_id), 4) AS lo, round(max(value) OVER (PARTITION BY user_id), 4) AS hi FROM events"),
    "aggregate_count_distinct": (operated("events", ["event_id", "n"], {"operator": "aggregate", "function": "distinct_count", "source_column": "event_type", "by": ["user_id"], "as": "n"}), "SELECT event_id, n FROM events JOIN (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id) USING (user_id)"),
    "min_group": (operated("events", ["event_id", "first"], {"operator": "min", "name": "event_type", "by": ["user_id"], "as": "first"}), "SELECT event_id, min(event_type) OVER (PARTITION BY user_id) AS first FROM events"),
    "max_external": (operated("customer", ["c_custkey", "latest"], {"operator": "max", "name": "o_orderpriority", "dataset": "orders", "group": ["o_custkey"], "group_aliases": ["c_custkey"], "as": "latest"}, others=("orders",)), "SELECT c_custkey, latest FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS latest FROM orders GROUP BY 1) ON o_custkey = c_custkey"),
    "record_count_external": (operated("nation", ["n_nationkey", "n"], {"operator": "record_count", "dataset": "customer", "group": ["c_nationkey"], "group_aliases": ["n_nationkey"], "as": "n"}, others=("customer",)), "SELECT n_nationkey, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey"),
    "sort": (operated("customer", ["c_custkey", "place"], {"operator": "sort", "by": ["c_mktsegment", "c_nationkey"], "descending": True}, {"operator": "row_number", "as": "place"}), "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_nationkey DESC, c_custkey) AS place FROM customer"),
    "select_drop_rename": (operated("supplier", ["id", "s_acctbal"], {"operator": "select", "columns": ["s_suppkey", "s_name", "s_acctbal"]}, {"operator": "drop", "columns": ["S_NAME"]}, {"operator": "rename", "mapping": {"s_suppkey": "id"}}), "SELECT s_suppkey AS id, round(s_acctbal, 4) AS s_acctbal FROM supplier"),
    "distinct_rows": (operated("orders", ["o_custkey", "o_orderkey"], {"operator": "distinct", "by": ["o_custkey"]}), "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1"),
    "distinct_values": (operated("events", ["event_id", "types"], {"operator": "distinct", "name": "event_type", "by": ["user_id"], "id": "types"}), "SELECT event_id, types FROM events JOIN (SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types FROM events GROUP BY 1) USING (user_id)"),
    "distinct_reference": (operated("customer", ["c_custkey", "said"], {"operator": "distinct", "name": "o_orderstatus", "dataset": "orders", "group": ["o_custkey"], "group_aliases": ["c_custkey"], "id": "said"}, others=("orders",)), "SELECT c_custkey, coalesce(said, '') AS said FROM customer LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS said FROM orders GROUP BY 1) ON o_custkey = c_custkey"),
    "row_number": (operated("lineitem", [*LINES, "k"], {"operator": "row_number", "by": ["l_suppkey"], "as": "k"}), f"SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY {LINE_ORDER}) AS k FROM lineitem"),
    "study_day": (operated(dated, ["o_orderkey", "dy"], {"operator": "dy", "name": "d", "reference": "e", "id": "dy"}), f"SELECT o_orderkey, CAST(CASE WHEN n >= 0 THEN n + 1 ELSE n END AS INT) AS dy FROM (SELECT o_orderkey, CAST(date_diff('day', try_cast(e AS DATE), CASE WHEN length(d) >= 10 THEN try_cast(substr(d, 1, 10) AS DATE) END) AS INT) AS n FROM {DATED})"),
    "map": (operated("orders", ["o_orderkey", "speed"], {"operator": "map", "id": "speed", "map": [{"o_orderpriority": "1-URGENT", "o_orderstatus": "O", "output": "now"}, {"o_orderpriority": "1-URGENT", "output": "soon"}, {"o_orderpriority": "5-LOW", "output": "later"}]}), "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'now' WHEN o_orderpriority = '1-URGENT' THEN 'soon' WHEN o_orderpriority = '5-LOW' THEN 'later' ELSE '' END AS speed FROM orders"),
    "split_by": (operated("part", ["p_partkey", "words"], {"operator": "split_by", "name": "p_name", "delimiter": " ", "id": "words"}), "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), '|') AS words FROM part"),
    "metadata_columns": (operated("nation", ["n_nationkey", "domains", "counted", "title"], {"operator": "study_domains", "id": "domains"}, {"operator": "variable_count", "name": "n_name", "id": "counted"}, {"operator": "extract_metadata", "name": "dataset_name", "id": "title"}, others=("region",)), "SELECT n_nationkey, 'NATION|REGION' AS domains, 1 AS counted, 'nation' AS title FROM nation"),
}


def joined(how: str, left: str, right: str, left_by: list[str], right_by: list[str], columns: dict[str, str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = joins.join(dataset(spark, sf_dir, left), dataset(spark, sf_dir, right), how, left_by, right_by)
        return ds.df.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()])

    return run


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a join in left order, then right order, with their place."""
    ds = joins.join(dataset(spark, sf_dir, "nation"), dataset(spark, sf_dir, "supplier"), "left_join", ["n_nationkey"], ["s_nationkey"])
    return with_position(ds.df, [ORD], "place").select("n_nationkey", F.col("`supplier.s_suppkey`").alias("s_suppkey"), "place")


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lookups in turn."""
    ds = joins.join(joins.join(dataset(spark, sf_dir, "customer"), dataset(spark, sf_dir, "nation"), "lookup", ["c_nationkey"], ["n_nationkey"]), dataset(spark, sf_dir, "region"), "lookup", ["nation.n_regionkey"], ["r_regionkey"])
    return ds.df.select("c_custkey", F.col("`nation.n_name`").alias("n_name"), F.col("`region.r_name`").alias("r_name"))


JOINED: dict[str, tuple[Query, str]] = {
    "left_join": (joined("left_join", "documents", "labels", ["doc_id"], ["doc_id"], {"doc_id": "doc_id", "labels.toxic": "toxic"}), "SELECT d.doc_id, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "inner_join": (joined("inner_join", "orders", "customer", ["o_custkey"], ["c_custkey"], {"o_orderkey": "o_orderkey", "customer.c_mktsegment": "segment"}), "SELECT o_orderkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey"),
    "semi_join": (joined("semi_join", "documents", "labels", ["doc_id"], ["doc_id"], {"doc_id": "doc_id"}), "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "anti_join": (joined("anti_join", "documents", "labels", ["doc_id"], ["doc_id"], {"doc_id": "doc_id"}), "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    "join_positions": (positions, "SELECT n_nationkey, s_suppkey, row_number() OVER (ORDER BY n_nationkey, s_suppkey) AS place FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey"),
    "match_datasets": (matched, "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"),
}

#: Rules in the loader's own form, as a rule file would hold them.
LINE_RULES = [
    {"Core": {"Id": "LINE-1"}, "Rule Type": "Record Data", "Sensitivity": "Record", "Outcome": {"Message": "unknown flag"}, "Check": {"all": [{"name": "l_returnflag", "operator": "is_not_contained_by", "value": ["A", "N"]}, {"name": "l_quantity", "operator": "less_than", "value": 10}]}},
    {"Core": {"Id": "LINE-2"}, "Rule Type": "Record Data", "Sensitivity": "Record", "Outcome": {"Message": "high tax"}, "Check": {"all": [{"name": "l_tax", "operator": "greater_than", "value": 0.07}]}},
    {"Core": {"Id": "LINE-3"}, "Rule Type": "Record Data", "Sensitivity": "Record", "Outcome": {"Message": "open and returned"}, "Check": {"any": [{"all": [{"name": "l_linestatus", "operator": "equal_to", "value": "O", "value_is_literal": True}, {"name": "l_returnflag", "operator": "equal_to", "value": "R", "value_is_literal": True}]}]}},
]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of several rules on one table, found in one scan."""
    ds = dataset(spark, sf_dir, "lineitem")
    issues = batch_issues(ds, [parse_rule(r) for r in LINE_RULES])
    return issues.select("rule_id", "dataset", F.col("row").cast("long").alias("row"), F.array_join("variables", "|").alias("variables"), "message")


FLAGSHIP_SQL = f"""
WITH placed AS (SELECT *, row_number() OVER (ORDER BY {LINE_ORDER}) AS row FROM lineitem)
SELECT 'LINE-1' AS rule_id, 'lineitem' AS dataset, row, 'l_returnflag|l_quantity' AS variables, 'unknown flag' AS message FROM placed WHERE l_returnflag NOT IN ('A', 'N') AND l_quantity < 10
UNION ALL SELECT 'LINE-2', 'lineitem', row, 'l_tax', 'high tax' FROM placed WHERE l_tax > 0.07
UNION ALL SELECT 'LINE-3', 'lineitem', row, 'l_linestatus|l_returnflag', 'open and returned' FROM placed WHERE l_linestatus = 'O' AND l_returnflag = 'R'
"""


def value_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text values of customers, one row for each variable."""
    return value_metadata(dataset(spark, sf_dir, "customer")).df.select(F.col(f"{ORD}.__row_ord").alias("c_custkey"), "variable_name", "variable_value")


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of some tables."""
    found = dataset_metadata(spark, [dataset(spark, sf_dir, n) for n in ("region", "nation", "supplier")])
    return found.df.select("dataset_name", "DOMAIN", "record_count", "dataset_names")


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose sixty days meet another order of the same customer."""
    ds = dataset(spark, sf_dir, "orders")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    timed = ds.with_df(ds.df.select("o_orderkey", "o_custkey", ORD, day("o_orderdate").alias("a"), day(F.date_add("o_orderdate", 60)).alias("b")))
    return post.overlapping(timed, ["o_custkey"], "a", "b").df.select("o_orderkey", "o_custkey")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name a row of another table by a column's name and value, and whether it is there."""
    docs = dataset(spark, sf_dir, "documents")
    named = docs.df.select("doc_id", F.lit("LABELS").alias("RDOMAIN"), F.lit(None).cast("string").alias("USUBJID"), F.lit("doc_id").alias("IDVAR"), F.col("doc_id").cast("string").alias("IDVARVAL"), ORD)
    found = joins.related_rows(docs.with_df(named), [dataset(spark, sf_dir, "labels")])
    return found.df.select("doc_id", F.col("__found").alias("found"))


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose number of issues differs between two rules that nearly agree."""
    ds = dataset(spark, sf_dir, "lineitem")

    def issues(limit: int) -> DataFrame:
        rows = violations(ds, leaf("l_quantity", "less_than", limit)).where("__mask")
        return rows.select(F.lit("R").alias("rule_id"), F.lit("LINEITEM").alias("dataset"), F.col("l_suppkey").cast("int").alias("row"))

    return score.difference(issues(5), issues(6), ("rule_id", "dataset", "row"))


#: Rules with operations, match tables, groups and another rule type, as a rule file would hold them.
STUDY_RULES = [
    {"Core": {"Id": "S-1"}, "Rule Type": "Record Data", "Scope": {"Domains": {"Include": ["ORDERS"]}}, "Outcome": {"Message": "order of a customer in debt"}, "Match Datasets": [{"Name": "customer", "Keys": [{"left": "o_custkey", "right": "c_custkey"}]}], "Check": {"all": [{"name": "customer.c_acctbal", "operator": "less_than", "value": 0}]}},
    {"Core": {"Id": "S-2"}, "Rule Type": "Record Data", "Scope": {"Domains": {"Include": ["ORDERS"]}}, "Outcome": {"Message": "largest order of a busy customer"}, "Operations": [{"operator": "aggregate", "by": ["o_custkey"], "as": "n"}, {"operator": "aggregate", "by": ["o_custkey"], "function": "max", "source_column": "o_totalprice", "as": "most"}], "Check": {"all": [{"name": "n", "operator": "greater_than", "value": 15}, {"name": "o_totalprice", "operator": "equal_to", "value": "most"}]}},
    {"Core": {"Id": "S-3"}, "Rule Type": "Record Data", "Scope": {"Domains": {"Include": ["CUSTOMER"]}}, "Outcome": {"Message": "customer without an urgent order"}, "Operations": [{"operator": "anti_join", "right": "orders", "left_by": ["c_custkey"], "right_by": ["o_custkey"]}], "Check": "$exists(c_custkey)"},
    {"Core": {"Id": "S-4"}, "Rule Type": "Record Data", "Scope": {"Domains": {"Include": ["CUSTOMER"]}}, "Outcome": {"Message": "segment by name"}, "Check": '$uppercase(c_mktsegment) = "building" and c_nationkey in [1, 2, 3]'},
    {"Core": {"Id": "S-5"}, "Rule Type": "Domain Presence Check", "Sensitivity": "Dataset", "Outcome": {"Message": "no such table"}, "Check": {"all": [{"name": "LINEITEM", "operator": "not_exists"}]}},
    {"Core": {"Id": "S-6"}, "Rule Type": "Record Data", "Scope": {"Domains": {"Include": ["CUSTOMER"]}}, "Outcome": {"Message": "customer of a large order"}, "Match Datasets": [{"Name": "orders", "Keys": [{"left": "c_custkey", "right": "o_custkey"}]}], "Check": {"all": [{"name": "o_totalprice", "operator": "greater_than", "value": 300000}]}},
    {"Core": {"Id": "S-7"}, "Rule Type": "Record Data", "Scope": {"Domains": {"Include": ["CUSTOMER"]}}, "Outcome": {"Message": "segment outside the dictionary"}, "Check": {"all": [{"name": "c_mktsegment", "operator": "is_not_contained_by", "dictionary": "SEGMENTS"}]}},
    {"Core": {"Id": "S-8"}, "Rule Type": "Record Data", "Sensitivity": "Group", "Scope": {"Domains": {"Include": ["ORDERS"]}}, "Outcome": {"Message": "first dear order of its kind", "Output Variables": ["o_orderpriority", "o_orderstatus"]}, "Check": {"all": [{"name": "o_totalprice", "operator": "greater_than", "value": 200000}]}},
]


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over two tables: the issues of all rules."""
    segments = spark.createDataFrame([("SEGMENTS", w) for w in ("BUILDING", "MACHINERY", "HOUSEHOLD")], "dictionary string, term string")
    report = validate(spark, [parse_rule(r) for r in STUDY_RULES], [dataset(spark, sf_dir, "orders"), dataset(spark, sf_dir, "customer")], Knowledge(dictionaries=segments))
    return report.issues.select("rule_id", "dataset", F.col("row").cast("long").alias("row"), "message")


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders whose lines differ in status."""
    return post.conflicting(dataset(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linestatus").df.select(*LINES)


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' variables with their labels in a library."""
    found = variable_metadata(spark, dataset(spark, sf_dir, "orders"), library={"ORDERS": {"labels": {"O_ORDERKEY": "Key", "o_totalprice": "Price"}}})
    return found.df.select("variable_name", F.col("variable_order").cast("int").alias("variable_order"), "variable_type", "library_variable_name", "library_variable_label")


def library_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a library says of a table, beside its rows, in the context of a run."""
    ds = dataset(spark, sf_dir, "region")
    context = operations.Context([ds], parse_condition, library={"REGION": {"required": ["r_regionkey", "r_name"], "columns": ["r_regionkey", "r_name", "r_comment"]}})
    for spec in ({"operator": "required_variables", "id": "required"}, {"operator": "get_column_order_from_library", "id": "columns"}, {"operator": "domain_is_custom", "id": "custom"}, {"operator": "expected_variables", "id": "expected"}):
        ds = operations.apply(ds, spec, context)
    return ds.df.select("r_regionkey", "required", "columns", "custom", "expected")


def codelists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations by code, from a codelist of nations, and whether it is extensible."""
    nations = dataset(spark, sf_dir, "nation").df.select(F.lit("NAT").alias("code"), F.lit(True).alias("extensible"), F.col("n_nationkey").cast("string").alias("term_code"), F.col("n_name").alias("value"), F.lower("n_name").alias("pref_term"), F.lit(None).cast("string").alias("version"))
    ds = dataset(spark, sf_dir, "customer")
    ds = ds.with_df(ds.df.select("c_custkey", F.col("c_nationkey").cast("string").alias("nation_code"), ORD))
    context = operations.Context([ds], parse_condition, nations)
    for spec in ({"operator": "codelist_terms", "codelists": ["NAT"], "term_code": "nation_code", "returntype": "value", "id": "name"}, {"operator": "codelist_terms", "codelists": ["NAT"], "returntype": "pref_term", "id": "every"}, {"operator": "codelist_extensible", "codelist_code": "NAT", "id": "open"}):
        ds = operations.apply(ds, spec, context)
    return ds.df.select("c_custkey", "name", "every", "open")


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV in the checkpoint folder and read back with inferred types, numbered in file order."""
    source = dataset(spark, sf_dir, "customer").df
    path = f"{scratch(spark)}/customer.csv"
    source.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").write.csv(path, header=True)
    read = tables.read_csv(spark, path)
    return with_position(read.df, [ORD], "place").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "place")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose issues agree with what is expected, and how they differ otherwise."""
    lines = dataset(spark, sf_dir, "lineitem").df
    issue = lambda rule: lines.where("l_quantity < 3").select(F.lit(rule).alias("rule_id"), F.lit("LINEITEM").alias("dataset"), F.col("l_suppkey").cast("int").alias("row"), F.array(F.lit("L_QUANTITY")).alias("variables"), F.lit(None).cast("string").alias("usubjid"), F.lit(None).cast("string").alias("seq"))
    found = issue("SAME").unionByName(issue("FEWER").where("row % 2 = 0")).unionByName(issue("NEW"))
    wanted = issue("SAME").unionByName(issue("FEWER")).unionByName(issue("LOST"))
    return score.score(found, wanted).select("rule_id", "bucket")


MADE: dict[str, tuple[Query, str]] = {
    "conflicting": (conflicts, "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, min(l_linestatus) OVER (PARTITION BY l_orderkey) AS a, max(l_linestatus) OVER (PARTITION BY l_orderkey) AS b FROM lineitem) WHERE a < b"),
    "variable_metadata": (variables, "SELECT column_name AS variable_name, CAST(row_number() OVER () AS INT) AS variable_order, CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'Num' ELSE 'Char' END AS variable_type, CASE column_name WHEN 'o_orderkey' THEN 'O_ORDERKEY' WHEN 'o_totalprice' THEN 'o_totalprice' END AS library_variable_name, CASE column_name WHEN 'o_orderkey' THEN 'Key' WHEN 'o_totalprice' THEN 'Price' END AS library_variable_label FROM (DESCRIBE orders)"),
    "library_lists": (library_lists, "SELECT r_regionkey, 'r_regionkey|r_name' AS required, 'r_regionkey|r_name|r_comment' AS columns, false AS custom, '' AS expected FROM region"),
    "codelist_terms": (codelists, "SELECT c_custkey, n_name AS name, (SELECT string_agg(lower(n_name), '|' ORDER BY lower(n_name)) FROM nation) AS every, true AS open FROM customer JOIN nation ON n_nationkey = c_nationkey"),
    "csv_source": (csv_source, "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS place FROM customer"),
    "score": (scores, "SELECT * FROM (VALUES ('SAME', 'match'), ('FEWER', 'missing'), ('NEW', 'no_expectation'), ('LOST', 'missing')) AS t(rule_id, bucket)"),
    "value_metadata": (value_rows, "SELECT c_custkey, 'c_name' AS variable_name, c_name AS variable_value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer"),
    "dataset_metadata": (table_rows, "SELECT 'region' AS dataset_name, 'REGION' AS DOMAIN, count(*) AS record_count, 'region|nation|supplier' AS dataset_names FROM region UNION ALL SELECT 'nation', 'NATION', count(*), 'region|nation|supplier' FROM nation UNION ALL SELECT 'supplier', 'SUPPLIER', count(*), 'region|nation|supplier' FROM supplier"),
    "overlapping": (overlaps, "SELECT o_orderkey, o_custkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey <> a.o_orderkey AND CAST(b.o_orderdate AS DATE) <= CAST(a.o_orderdate AS DATE) + 60 AND CAST(a.o_orderdate AS DATE) <= CAST(b.o_orderdate AS DATE) + 60)"),
    "related_rows": (relations, "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS found FROM documents"),
    "issue_difference": (differences, "SELECT 'R' AS rule_id, 'LINEITEM' AS dataset, CAST(l_suppkey AS VARCHAR) AS row, count(*) FILTER (l_quantity < 5) AS n_found, count(*) FILTER (l_quantity < 6) AS n_expected FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (l_quantity < 5) <> count(*) FILTER (l_quantity < 6)"),
    "validate": (
        study,
        """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM orders),
        c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS row FROM customer)
        SELECT 'S-1' AS rule_id, 'orders' AS dataset, row, 'order of a customer in debt' AS message FROM o JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0
        UNION ALL SELECT 'S-2', 'orders', row, 'largest order of a busy customer' FROM o WHERE n > 15 AND o_totalprice = most
        UNION ALL SELECT 'S-3', 'customer', row_number() OVER (ORDER BY c_custkey), 'customer without an urgent order' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL SELECT 'S-4', 'customer', row, 'segment by name' FROM c WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3)
        UNION ALL SELECT 'S-5', 'STUDY', 1, 'no such table'
        UNION ALL SELECT 'S-6', 'customer', c.row, 'customer of a large order' FROM c JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000
        UNION ALL SELECT 'S-7', 'customer', row, 'segment outside the dictionary' FROM c WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
        UNION ALL SELECT 'S-8', 'orders', min(row), 'first dear order of its kind' FROM o WHERE o_totalprice > 200000 GROUP BY o_orderpriority, o_orderstatus""",
    ),
}


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {"rule_batch": flagship}
    found |= {f"check_{n}": flagged(source, keys, condition) for n, (source, keys, condition, _) in CONDITIONS.items()}
    found |= {f"do_{n}": q for n, (q, _) in OPERATED.items()}
    found |= {f"do_{n}": q for n, (q, _) in JOINED.items()}
    found |= {f"do_{n}": q for n, (q, _) in MADE.items()}
    return found


def oracle_sql() -> dict[str, str]:
    found = {"rule_batch": FLAGSHIP_SQL}
    found |= {f"check_{n}": sql for n, (*_, sql) in CONDITIONS.items()}
    found |= {f"do_{n}": sql for n, (_, sql) in OPERATED.items()}
    found |= {f"do_{n}": sql for n, (_, sql) in JOINED.items()}
    found |= {f"do_{n}": sql for n, (_, sql) in MADE.items()}
    return found
