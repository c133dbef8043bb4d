"""Registered queries of the analytics operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .functions.formula import with_formulas
from .operators import delta, group, history, ioc, joins, profile, search, zones
from .plans import predicate
from .scratch import scratch
from .sources.dataset import with_row_idx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, places: int = 2, columns: tuple[str, ...] = ("sum", "mean", "min", "max")) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns if c in df.columns})


_GROUP = "count(*) AS count, round(sum({v}), 2) AS sum, round(avg({v}), {p}) AS mean, round(min({v}), 2) AS min, round(max({v}), 2) AS max"


def _grouped(key: str, value: str, table: str, more: str = "", places: int = 2) -> str:
    return f"SELECT {key} AS category, {_GROUP.format(v=value, p=places)} FROM {table} {more} GROUP BY {key}"


# --- group-by and top-N -------------------------------------------------------------------------------------------


@query(_grouped("l_returnflag", "l_extendedprice", "lineitem"))
def group_by_basic(spark, sf_dir):
    return _rounded(group.group_by(_t(spark, sf_dir, "lineitem"), 8, 5))


@query(_grouped("l_linestatus", "l_extendedprice", "lineitem", "WHERE l_quantity > 10 AND lower(l_returnflag) = 'r'"))
def group_by_filtered(spark, sf_dir):
    return _rounded(group.group_by(_t(spark, sf_dir, "lineitem"), 9, 5, "$4 > 10 AND $8 == 'R'"))


# means of few prices often end in half a cent, which engines round differently, so they keep six places
@query(_grouped("CAST(o_custkey AS VARCHAR)", "o_totalprice", "orders", places=6) + " ORDER BY sum(o_totalprice) DESC, 1 LIMIT 50")
def group_top50_by_sum(spark, sf_dir):
    top = group.top_by_sum(group.group_by(_t(spark, sf_dir, "orders"), "o_custkey", "o_totalprice"), 50)
    return _rounded(_rounded(top, columns=("sum", "min", "max")), 6, ("mean",))


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n_desc(spark, sf_dir):
    return group.top_n(_t(spark, sf_dir, "orders"), 3, 10, True, tie=["o_orderkey"])


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 10")
def top_n_asc_filtered(spark, sf_dir):
    return group.top_n(_t(spark, sf_dir, "orders"), 3, 10, False, "$2 = 'f'", tie=["o_orderkey"])


# --- predicates ---------------------------------------------------------------------------------------------------


@query("SELECT * FROM orders WHERE o_totalprice >= 100000")
def filter_dsl_numeric(spark, sf_dir):
    return predicate.where(_t(spark, sf_dir, "orders"), "$3 >= 100000")


@query("SELECT * FROM lineitem WHERE abs(l_quantity - 10) < 1e-9")
def filter_dsl_eq_tol(spark, sf_dir):
    return predicate.where(_t(spark, sf_dir, "lineitem"), "$4 = 10")


@query("SELECT * FROM lineitem WHERE abs(l_discount - 0.05) >= 1e-9 AND lower(l_linestatus) <> 'o'")
def filter_dsl_not_equal(spark, sf_dir):
    return predicate.where(_t(spark, sf_dir, "lineitem"), "$6 != 0.05 && $9 != 'O'")


@query("SELECT * FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice < 50000")
def filter_dsl_or_parens(spark, sf_dir):
    return predicate.where(_t(spark, sf_dir, "orders"), "($2='f' OR $2='P') AND $3<50000")


@query("SELECT * FROM customer WHERE c_acctbal BETWEEN 1000 AND 2500.5")
def filter_range(spark, sf_dir):
    return predicate.in_range(_t(spark, sf_dir, "customer"), "c_acctbal", 1000, 2500.5)


@query("SELECT * FROM orders WHERE year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) BETWEEN 19950101 AND 19961231")
def filter_date_range(spark, sf_dir):
    return predicate.in_dates(_t(spark, sf_dir, "orders"), "o_orderdate", 19950101, "1996-12-31")


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'licensed under')")
def filter_text(spark, sf_dir):
    return predicate.contains_text(_t(spark, sf_dir, "documents"), "text", "Licensed UNDER").select("doc_id", "lang", "source")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '/[a-z]{2}/[0-9]+')")
def filter_regex(spark, sf_dir):
    return predicate.matches(_t(spark, sf_dir, "pages").select("page_id", "url"), "/[a-z]{2}/[0-9]+")


@query("SELECT * FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice BETWEEN 1000 AND 200000 AND year(o_orderdate) = 1995 AND contains(lower(o_orderstatus), 'o')")
def filter_conjunction(spark, sf_dir):
    return predicate.select_rows(
        _t(spark, sf_dir, "orders"),
        number_range=("o_totalprice", 1000, 200000),
        date_range=("o_orderdate", 19950101, 19951231),
        text=("o_orderstatus", "O"),
        regex=",1-?[A-Z]*",
    ).where(F.startswith("o_orderpriority", F.lit("1")))


# --- search -------------------------------------------------------------------------------------------------------


@query("SELECT * FROM customer WHERE contains(c_name || ',' || c_mktsegment, 'BUILD')")
def search_rows_any(spark, sf_dir):
    return search.search_rows(_t(spark, sf_dir, "customer"), "BUILD")


@query("SELECT * FROM customer WHERE lower(c_mktsegment) = 'building'")
def search_rows_col_ci_equal(spark, sf_dir):
    return search.search_rows(_t(spark, sf_dir, "customer"), "Building", "c_mktsegment", ignore_case=True)


@query("SELECT doc_id, CAST(len(string_split(lower(text), 'the')) - 1 AS INT) AS n FROM documents WHERE contains(lower(text), 'the')")
def search_occurrences(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", search.occurrence_count(F.col("text"), "the").alias("n")).where("n > 0")


@query("SELECT doc_id, count(*) AS n, sum(place) AS places FROM (SELECT doc_id, unnest(range(length(text))) AS place, text FROM documents) WHERE substr(lower(text), CAST(place + 1 AS INT), 5) = 'token' GROUP BY doc_id")
def search_offsets(spark, sf_dir):
    found = search.occurrences(_t(spark, sf_dir, "documents"), "text", "token", ["doc_id"])
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("offset").alias("places"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'all rights reserved')")
def search_distinct_rows(spark, sf_dir):
    return search.distinct_rows(_t(spark, sf_dir, "documents"), "text", "All rights reserved", "doc_id")


@query("SELECT source AS file_name, doc_id AS row_index, text AS content FROM documents WHERE contains(text, 'token = ') ORDER BY 1, 2 LIMIT 20")
def search_dataset(spark, sf_dir):
    return search.dataset_search(_t(spark, sf_dir, "documents"), "token = ", 20, "source", "doc_id", "text")


_IOCS = ("token =", "MIT License", "mail1.example.com")


@query(
    "SELECT indicator, doc_id, len(string_split(lower(text), lower(indicator))) - 1 AS hits FROM documents, "
    "(VALUES ('token ='), ('MIT License'), ('mail1.example.com')) AS p(indicator) WHERE contains(lower(text), lower(indicator))"
)
def ioc_multi(spark, sf_dir):
    return search.indicators(_t(spark, sf_dir, "documents"), "text", _IOCS, ["doc_id"])


# --- joins --------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner(spark, sf_dir):
    both = joins.join(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), "c_custkey", "o_custkey")
    return both.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def join_left(spark, sf_dir):
    right = predicate.where(_t(spark, sf_dir, "region"), "$0 < 3")
    return joins.join(_t(spark, sf_dir, "nation"), right, "n_regionkey", "r_regionkey", "left").select("n_name", "r_name")


@query("SELECT coalesce(s_name, '') AS s_name, n_name FROM (SELECT * FROM supplier WHERE s_nationkey < 10) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right_filled(spark, sf_dir):
    left = predicate.where(_t(spark, sf_dir, "supplier"), "$2 < 10")
    return joins.join(left, _t(spark, sf_dir, "nation"), "s_nationkey", "n_nationkey", "right", fill="").select("s_name", "n_name")


@query("SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_by_name(spark, sf_dir):
    both = joins.join(_t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region"), " N_RegionKey", "R_REGIONKEY ")
    return both.select("n_nationkey", "n_name", "r_regionkey", "r_name")


@query(
    "SELECT l.i AS left_idx, o.i AS right_idx FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 AS i FROM lineitem) l "
    "JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS i FROM orders) o ON l.l_orderkey = o.o_orderkey"
)
def join_index_pairs(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("at"))
    left = with_row_idx(lines, "at").select(F.col("l_orderkey").alias("k"), "row_idx")
    right = with_row_idx(_t(spark, sf_dir, "orders").select("o_orderkey", (-F.col("o_orderkey")).alias("at")), "at")
    return joins.index_pairs(left, right.select(F.col("o_orderkey").alias("k"), "row_idx"), "k", "row_idx")


_RANGES = ((0x01000000, 0x3FFFFFFF, "AA", "Aland"), (0x40000000, 0x7EFFFFFF, "BB", "Bland"), (0x80000000, 0xBFFFFFFF, "CC", "Cland"))


def _geo(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_RANGES), "range_start bigint, range_end bigint, code string, name string")


@query(
    "SELECT event_id, code FROM (SELECT event_id, event_id * 9973 % 3000000000 AS v FROM events) LEFT JOIN (VALUES "
    + ", ".join(f"({a}, {b}, '{c}')" for a, b, c, _ in _RANGES)
    + ") AS g(range_start, range_end, code) ON v BETWEEN range_start AND range_end"
)
def range_join_geo(spark, sf_dir):
    points = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 9973 % 3000000000).alias("v"))
    return joins.range_join(points, _geo(spark), "v", "range_start", "range_end").select("event_id", "code")


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (2, 7) THEN 'renamed ' || n_nationkey ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (0, 5)")
def delta_overlay(spark, sf_dir):
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "row_idx bigint")
    edits = delta.Delta.empty(spark, "struct<n_name:string>").delete(ids(0, 5, 7))
    new = ids(2, 7).withColumn("content", F.struct(F.concat(F.lit("renamed "), F.col("row_idx")).alias("n_name")))
    return delta.overlay(_t(spark, sf_dir, "nation"), edits.update(new), "n_nationkey")


# --- profiles -----------------------------------------------------------------------------------------------------

_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_MOMENTS = (
    "count({c}) AS count, round(avg({c}), 4) AS mean, min({c}) AS min, max({c}) AS max, round(var_samp({c}), 4) AS variance, "
    "round(stddev_samp({c}), 4) AS std_dev, round(skewness({c}), 4) + 0 AS skewness, round(kurtosis({c}), 4) AS kurtosis, "
    "count(*) - count({c}) AS null_count"
)


def _rounded_profile(df: DataFrame) -> DataFrame:
    for c in ("mean", "variance", "std_dev", "skewness", "kurtosis"):
        df = df.withColumn(c, F.round(c, 4) + F.lit(0.0))
    return df


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {_MOMENTS.format(c=c)}, CAST(1 AS DOUBLE) AS filling_ratio, false AS is_constant, CAST(100 AS DOUBLE) AS health_score, '' AS warnings FROM lineitem"
        for c in _PROFILED
    )
)
def profile_numeric(spark, sf_dir):
    return _rounded_profile(profile.numeric_profile(_t(spark, sf_dir, "lineitem"), _PROFILED))


@query(
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS \"column\", count(*) AS count, round(avg({c}), 4) AS mean, min({c}) AS min, max({c}) AS max FROM lineitem GROUP BY l_returnflag"
        for c in _PROFILED
    )
)
def profile_segmented(spark, sf_dir):
    out = _rounded_profile(profile.numeric_profile(_t(spark, sf_dir, "lineitem"), _PROFILED, by=["l_returnflag"]))
    return out.select("l_returnflag", "column", "count", "mean", "min", "max")


@query("SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10")
def profile_categorical(spark, sf_dir):
    return profile.top_categories(_t(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    "SELECT 'o_orderpriority' AS \"column\", count(*) AS count, CAST(0 AS BIGINT) AS null_count, count(DISTINCT o_orderpriority) AS distinct_count, "
    "round(count(DISTINCT o_orderpriority) / count(*), 6) AS unique_ratio, round(sum(strlen(o_orderpriority)) / 1024.0, 3) AS text_kb FROM orders "
    "UNION ALL SELECT 'o_orderstatus', count(*), 0, count(DISTINCT o_orderstatus), round(count(DISTINCT o_orderstatus) / count(*), 6), round(sum(strlen(o_orderstatus)) / 1024.0, 3) FROM orders"
)
def profile_text(spark, sf_dir):
    out = profile.profile(_t(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])
    return out.select("column", "count", "null_count", "distinct_count", F.round("unique_ratio", 6).alias("unique_ratio"), F.round("text_kb", 3).alias("text_kb"))


@query("SELECT 'discounted' AS \"column\", " + _MOMENTS.format(c="(l_extendedprice * l_discount)") + " FROM lineitem")
def profile_formula(spark, sf_dir):
    df = with_formulas(_t(spark, sf_dir, "lineitem"), {"discounted": "l_extendedprice * l_discount"})
    out = _rounded_profile(profile.numeric_profile(df, ["discounted"]))
    return out.select("column", "count", "mean", "min", "max", "variance", "std_dev", "skewness", "kurtosis", "null_count")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount ELSE 0 END, 2) AS ratio FROM lineitem")
def formula_div_zero(spark, sf_dir):
    df = with_formulas(_t(spark, sf_dir, "lineitem"), {"ratio": "l_extendedprice / l_discount"})
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("ratio", 2).alias("ratio"))


@query("SELECT round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders")
def quartiles(spark, sf_dir):
    return profile.quartiles(_t(spark, sf_dir, "orders"), "o_totalprice").select(*[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")])


@query("SELECT CAST(least(floor((l_quantity - 0) / 5.0), 9) AS INT) AS bin, count(*) AS count FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def histogram(spark, sf_dir):
    return profile.histogram(_t(spark, sf_dir, "lineitem"), "l_quantity", 0, 50, 10)


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) + 0 AS value FROM lineitem" for k, a in enumerate(_PROFILED) for b in _PROFILED[k + 1 :]
    )
)
def correlations(spark, sf_dir):
    return profile.correlations(_t(spark, sf_dir, "lineitem"), _PROFILED).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("SELECT bool_and(coalesce(o_totalprice >= p, true)) AS increasing, bool_and(coalesce(o_totalprice <= p, true)) AS decreasing FROM (SELECT o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS p FROM orders)")
def monotonic_flags(spark, sf_dir):
    return profile.monotonic(_t(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


@query(
    "WITH a AS (SELECT 'acctbal' AS \"column\", count(*) AS n, round(avg(c_acctbal), 2) AS mean FROM customer UNION ALL SELECT 'custkey', count(*), round(avg(c_custkey), 2) FROM customer), "
    "b AS (SELECT 'acctbal' AS \"column\", count(*) AS n, round(avg(s_acctbal), 2) AS mean FROM supplier UNION ALL SELECT 'suppkey', count(*), round(avg(s_suppkey), 2) FROM supplier) "
    "SELECT coalesce(a.\"column\", b.\"column\") AS \"column\", CASE WHEN b.\"column\" IS NULL THEN 'OnlyInA' WHEN a.\"column\" IS NULL THEN 'OnlyInB' ELSE 'Changed' END AS status, "
    "a.n AS count_a, b.n AS count_b, a.mean AS mean_a, b.mean AS mean_b FROM a FULL JOIN b ON a.\"column\" = b.\"column\""
)
def profile_diff(spark, sf_dir):
    a = profile.numeric_profile(_t(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("acctbal"), F.col("c_custkey").alias("custkey")))
    b = profile.numeric_profile(_t(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("suppkey")))
    return history.compare(a, b).select("column", "status", "count_a", "count_b", F.round("mean_a", 2).alias("mean_a"), F.round("mean_b", 2).alias("mean_b"))


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def union_by_name(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("Name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("KEY"), F.col("s_name").alias("name"), F.col("s_acctbal").alias(" acctbal"))
    return profile.union_columns([a, b]).withColumnRenamed("Name", "name")


# --- row numbers and zones ----------------------------------------------------------------------------------------

_NUMBERED = "SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders"


@query(f"SELECT * FROM ({_NUMBERED}) WHERE row_idx >= 100 AND row_idx < 150")
def row_range(spark, sf_dir):
    from .sources.dataset import rows_between

    return rows_between(with_row_idx(_t(spark, sf_dir, "orders"), "o_orderkey"), 100, 150).withColumn("row_idx", F.col("row_idx").cast("long"))


@query(
    f"SELECT row_idx // 4096 AS zone, min(row_idx) AS start_row, max(row_idx) + 1 AS end_row, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM ({_NUMBERED}) GROUP BY 1"
)
def zone_map(spark, sf_dir):
    rows = with_row_idx(_t(spark, sf_dir, "orders"), "o_orderkey")
    return zones.zone_map(rows, ["o_totalprice"], size=4096)


@query("SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 5000")
def zone_pruned_filter(spark, sf_dir):
    rows = with_row_idx(_t(spark, sf_dir, "orders"), "o_orderkey")
    return zones.pruned(rows, zones.zone_map(rows, ["o_totalprice"], size=4096), "o_totalprice", 1000, 5000, size=4096).drop("row_idx")


# --- addresses ----------------------------------------------------------------------------------------------------

_OCT = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
# RE2 has no look-around: a boundary character is matched on each side, after every character between is doubled up
_IPS = (
    "SELECT doc_id, regexp_replace(regexp_extract(m, '[0-9].*[0-9]'), '(^|\\.)0+([0-9])', '\\1\\2', 'g') AS ip FROM (SELECT doc_id, unnest(regexp_extract_all("
    f"' ' || replace(text, ' ', '  ') || ' ', '[^0-9A-Za-z]{_OCT}\\.{_OCT}\\.{_OCT}\\.{_OCT}[^0-9A-Za-z.]')) AS m FROM documents)"
)


@query(f"SELECT doc_id, ip, count(*) AS hits FROM ({_IPS}) GROUP BY doc_id, ip")
def ip_extract(spark, sf_dir):
    found = ioc.extract_ips(_t(spark, sf_dir, "documents"), "text", ["doc_id"], "v4")
    return found.groupBy("doc_id", "ip").agg(F.count("*").alias("hits"))


@query(f"SELECT ip, count(*) AS count, count(DISTINCT source) AS n_files FROM (SELECT source, ip FROM ({_IPS}) JOIN documents USING (doc_id)) GROUP BY ip")
def ip_rank(spark, sf_dir):
    found = ioc.extract_ips(_t(spark, sf_dir, "documents"), "text", ["source"], "both")
    ranked = ioc.rank(ioc.frequencies(found, "source"), _geo(spark))
    return ranked.select("ip", "count", "n_files")


@query(f"SELECT count(*) AS total_unique, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_hits, count(*) > 1000 AS truncated FROM (SELECT ip, count(*) AS n FROM ({_IPS}) GROUP BY ip)")
def ip_summary(spark, sf_dir):
    found = ioc.extract_ips(_t(spark, sf_dir, "documents"), "text", ["source"], "both")
    return ioc.summary(ioc.rank(ioc.frequencies(found, "source")))[0]


# --- scalar functions ---------------------------------------------------------------------------------------------


@query(
    "SELECT event_id, CAST(nullif(regexp_extract(json_extract_string(props, '$.k'), '^[ \\t\\r\\n\\f]*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') AS DOUBLE) AS k FROM events"
)
def numeric_prefix_parse(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", scalar.numeric_prefix(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_fields(spark, sf_dir):
    from .sources.dataset import json_fields as fields

    return fields(_t(spark, sf_dir, "events"), "props").select("event_id", F.col("fields")["k"].alias("k"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", scalar.content_hash(F.col("text")).alias("sha256"))


@query(
    "SELECT page_id, ((length(url) - length(replace(url, '.', '')) = 3) OR (length(url) - length(replace(url, ':', '')) >= 2)) AND length(regexp_replace(url, '[^0-9A-Fa-f]', '', 'g')) >= 3 AS ip_like, "
    "regexp_matches(url, '^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$') AS mac_like FROM pages"
)
def address_like(spark, sf_dir):
    url = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", scalar.looks_like_ip(url).alias("ip_like"), scalar.looks_like_mac(url).alias("mac_like"))


@query("SELECT o_orderkey, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS day FROM orders")
def date_keys(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return _t(spark, sf_dir, "orders").select("o_orderkey", scalar.date_key(text).cast("long").alias("day"))


# --- streaming ----------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from .streaming.ingest import read_stream

    path = f"{sf_dir}/{name}.parquet"
    return read_stream(spark, path, spark.read.parquet(path).schema)


@query("SELECT event_type, count(*) AS count, round(sum(value), 2) AS sum FROM events GROUP BY event_type")
def stream_group(spark, sf_dir):
    from .streaming.ingest import stream_group as run

    return run(_stream(spark, sf_dir, "events"), "event_type", "value", scratch(spark, "stream-group")).withColumn("sum", F.round("sum", 2))


@query("SELECT 'value' AS \"column\", count(value) AS count, round(avg(value), 4) AS mean, round(var_samp(value), 3) AS variance, count(*) - count(value) AS null_count FROM events")
def stream_profile(spark, sf_dir):
    from .streaming.ingest import analyse_stream
    from .streaming.ingest import stream_profile as finish

    sums = scratch(spark, "stream-sums") + "/sums"
    analyse_stream(_stream(spark, sf_dir, "events"), ["value"], sums, scratch(spark, "stream-profile")).awaitTermination()
    return finish(spark, sums).select("column", "count", F.round("mean", 4).alias("mean"), F.round("variance", 3).alias("variance"), "null_count")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered group-by over lineitem."""
    return group.by_count(group_by_filtered(spark, sf_dir))
