"""Test inputs derived from the driver's tables, spelled for Spark and for a
SQL oracle (DuckDB) alike, so both engines profile the same values.

A derived table is a base table plus a list of (name, spark expr, sql expr,
spark type); the sql expr is ``None`` when it is spelled the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column layouts of the driver's tables (Spark type names).
TABLES = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}


def plain(table: str) -> tuple[str, list]:
    return table, [(n, n, None, t) for n, t in TABLES[table]]


# lineitem with NULLs in a text and a numeric column
LI_NULLS = (
    "lineitem",
    [(n, n, None, t) for n, t in TABLES["lineitem"] if n not in ("l_returnflag",)]
    + [
        ("l_returnflag", "nullif(l_returnflag, 'N')", None, "string"),
        ("tax_nulls", "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END", None, "double"),
    ],
)

# lineitem turned into text columns that hide numbers and dates
LI_TEXT = (
    "lineitem",
    [
        ("linenumber_s", "CAST(l_linenumber AS STRING)", None, "string"),
        ("mixed_s", "CASE WHEN l_linenumber > 4 THEN l_returnflag ELSE CAST(l_linenumber AS STRING) END", None,
         "string"),
        ("real_s", "concat(CAST(l_linenumber AS STRING), '.5')", None, "string"),
        ("quantity_s", "CAST(l_quantity AS STRING)", None, "string"),
        ("empty_s", "CASE WHEN l_linenumber = 1 THEN '' ELSE l_linestatus END", None, "string"),
        ("flag_null", "nullif(l_returnflag, 'N')", None, "string"),
        ("date_s", "date_format(l_shipdate, 'yyyy-MM-dd')", "strftime(l_shipdate, '%Y-%m-%d')", "string"),
        ("us_date_s", "date_format(l_shipdate, 'MM/dd/yyyy')", "strftime(l_shipdate, '%m/%d/%Y')", "string"),
        ("const_s", "'k'", None, "string"),
        ("l_returnflag", "l_returnflag", None, "string"),
    ],
)

# one text column that holds every kind of value
LI_KITCHEN = (
    "lineitem",
    [
        ("kitchen", (
            "CASE l_linenumber WHEN 1 THEN date_format(l_shipdate, 'yyyy-MM-dd') "
            "WHEN 2 THEN concat(CAST(l_suppkey AS STRING), '.5') "
            "WHEN 3 THEN date_format(l_shipdate, 'MM/dd/yyyy') "
            "WHEN 4 THEN l_returnflag WHEN 5 THEN concat(' ', CAST(l_linenumber AS STRING), ' ') "
            "ELSE CAST(l_partkey AS STRING) END"),
         ("CASE l_linenumber WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') "
          "WHEN 2 THEN concat(CAST(l_suppkey AS STRING), '.5') "
          "WHEN 3 THEN strftime(l_shipdate, '%m/%d/%Y') "
          "WHEN 4 THEN l_returnflag WHEN 5 THEN concat(' ', CAST(l_linenumber AS STRING), ' ') "
          "ELSE CAST(l_partkey AS STRING) END"),
         "string"),
    ],
)

# events.ts as text, in each layout that counts as a date
EVENT_DATES = (
    "events",
    [
        ("iso_space", "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')", "string"),
        ("iso_t", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\")", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')", "string"),
        ("iso_zulu", "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z')", "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')", "string"),
        ("iso_offset", "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), '+05:30')",
         "concat(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '+05:30')", "string"),
        ("minutes", "date_format(ts, 'yyyy-MM-dd HH:mm')", "strftime(ts, '%Y-%m-%d %H:%M')", "string"),
        ("slashes", "date_format(ts, 'yyyy/MM/dd HH:mm:ss')", "strftime(ts, '%Y/%m/%d %H:%M:%S')", "string"),
        ("month_first", "date_format(ts, 'MM/dd/yyyy HH:mm')", "strftime(ts, '%m/%d/%Y %H:%M')", "string"),
        ("dotted", "date_format(ts, 'dd.MM.yyyy HH:mm:ss')", "strftime(ts, '%d.%m.%Y %H:%M:%S')", "string"),
        ("as_cast", "CAST(ts AS STRING)", "CAST(ts AS VARCHAR)", "string"),
    ],
)

# numbers with a NaN, a constant and a perfectly correlated column
LI_NUM = (
    "lineitem",
    [(n, n, None, t) for n, t in TABLES["lineitem"] if t in ("bigint", "int", "double")]
    + [
        ("qty2", "2 * l_quantity + 1", None, "double"),
        ("nan_tax", "CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) ELSE l_tax END", None, "double"),
        ("const_n", "CAST(7 AS BIGINT)", None, "bigint"),
    ],
)

# documents with NULL labels from a left join
DOCS_LABELS_SQL = (
    "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
DOCS_LABELS_COLS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
                    ("quality", "int"), ("toxic", "int")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def spark_table(spark: SparkSession, sf_dir: str, spec) -> DataFrame:
    base, cols = spec
    return read(spark, sf_dir, base).selectExpr(*[f"{e} AS `{n}`" for n, e, _, _ in cols])


def sql_table(spec) -> str:
    base, cols = spec
    return "(SELECT " + ", ".join(f'{d or e} AS "{n}"' for n, e, d, _ in cols) + f" FROM {base})"


def columns(spec) -> list[tuple[str, str]]:
    return [(n, t) for n, _, _, t in spec[1]]


def docs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    lab = read(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(*[n for n, _ in DOCS_LABELS_COLS])
