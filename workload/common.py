"""Tables, derived inputs and SQL fragments shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_TEXTS = ["l_returnflag", "l_linestatus"]
LINEITEM = [*LINEITEM_NUMBERS, *LINEITEM_TEXTS, "l_shipdate"]
EVENTS_NUMBERS = ["event_id", "user_id", "value"]


class Registry:
    """Queries and SQL twins under one name each."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = query
        if sql is not None:
            self.oracles[name] = sql


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(name: str, work: Callable[[DataFrame], DataFrame]) -> Query:
    """A query that applies ``work`` to one table (or derived input)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        build = DERIVED.get(name)
        return work(build(spark, sf_dir) if build else load(spark, sf_dir, name))
    return run


# ---- derived inputs: the given tables hold no missing values, constants or strong correlations ----

def lineitem_nulls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    return load(spark, d, "lineitem").withColumns({
        "l_tax": F.when(k % 7 != 0, F.col("l_tax")),
        "l_discount": F.when(k % 5 != 0, F.col("l_discount")),
        "l_returnflag": F.when(k % 35 != 0, F.col("l_returnflag")),
    })


def lineitem_corr(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").withColumns({
        "q2": F.col("l_quantity") * 2 + F.col("l_linenumber"), "neg_tax": -F.col("l_tax"),
    })


def lineitem_const(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").withColumns({
        "one": F.lit(1), "nothing": F.lit(None).cast("double"),
    })


def orders_tokens(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 11 == 0, "N/A").when(k % 13 == 0, " - ").when(k % 17 == 0, "na").otherwise(
        F.col("o_orderstatus"))
    return load(spark, d, "orders").withColumn("o_orderstatus", status)


def orders_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"), "o_orderpriority",
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cust_text"))


def documents_nokey(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").drop("doc_id")


def lineitem_pred(spark: SparkSession, d: str) -> DataFrame:
    """Labels from the table, predictions and scores from arithmetic on its keys."""
    k = F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber")
    binary = F.when(F.col("l_linestatus") == "F", "1").otherwise("0")
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"),
        F.when(k % 5 < 3, F.col("l_returnflag")).when(k % 2 == 0, "A").otherwise("R").alias("flag_pred"),
        binary.alias("label"), F.when(k % 4 < 3, binary).otherwise("1").alias("prediction"),
        ((k % 1000) / F.lit(1000.0) + F.when(binary == "1", 0.25).otherwise(0.0)).alias("score"))


def orders_pred(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("y"),
        (F.col("o_totalprice") * 0.9 + F.col("o_custkey")).alias("prediction"))


def conversations_code(spark: SparkSession, d: str) -> DataFrame:
    """Turns with a fenced block or a JSON object written into the text."""
    t, k = F.col("text"), F.col("turn") + F.col("conv_id")
    n = F.col("turn").cast("string")
    python = F.concat(t, F.lit("\n```python\nx = "), n, F.lit("\nprint(x)\n```\nthen\n```python\ny = 2\n```"))
    plain = F.concat(t, F.lit("\n```\nSELECT "), n, F.lit("\n```"))
    fenced = F.concat(t, F.lit('\n```json\n{"turn": '), n, F.lit(', "ok": true}\n```'))
    whole = F.concat(F.lit('  {"turn": '), n, F.lit(', "tags": [1, 2]}\n'))
    braces = F.concat(t, F.lit(" {not json} and {\"a\": "), n, F.lit("} end"))
    return load(spark, d, "conversations").withColumn(
        "text", F.when(k % 6 == 0, python).when(k % 6 == 1, plain).when(k % 6 == 2, fenced)
        .when(k % 6 == 3, whole).when(k % 6 == 4, braces).otherwise(t))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a dataset catalog: first line as title, text as description, length as stars."""
    docs = load(spark, d, "documents")
    return docs.select(
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.col("doc_id") % 50 != 0, F.col("text")).alias("description"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
        "source", F.col("lang").alias("type"), F.col("n_chars").alias("stars"))


DERIVED: dict[str, Query] = {
    "lineitem_pred": lineitem_pred, "orders_pred": orders_pred, "conversations_code": conversations_code,
    "catalog": catalog,
    "lineitem_nulls": lineitem_nulls, "lineitem_corr": lineitem_corr, "lineitem_const": lineitem_const,
    "orders_tokens": orders_tokens, "orders_text": orders_text, "documents_nokey": documents_nokey,
}

_K = "(l_orderkey * 7 + l_partkey * 3 + l_linenumber)"
_B = "(CASE WHEN l_linestatus = 'F' THEN '1' ELSE '0' END)"
SQL_DERIVED = {
    "lineitem_pred": f"""SELECT l_orderkey, l_linenumber, l_returnflag AS flag,
        CASE WHEN {_K} % 5 < 3 THEN l_returnflag WHEN {_K} % 2 = 0 THEN 'A' ELSE 'R' END AS flag_pred,
        {_B} AS label, CASE WHEN {_K} % 4 < 3 THEN {_B} ELSE '1' END AS prediction,
        CAST({_K} % 1000 AS DOUBLE) / 1000.0::DOUBLE + CASE WHEN {_B} = '1' THEN 0.25::DOUBLE ELSE 0 END AS score
        FROM lineitem""",
    "orders_pred": """SELECT o_orderkey, o_totalprice AS y,
        o_totalprice * 0.9::DOUBLE + o_custkey AS prediction FROM orders""",
    "conversations_code": """SELECT * REPLACE (CASE (turn + conv_id) % 6
        WHEN 0 THEN text || E'\\n```python\\nx = ' || turn || E'\\nprint(x)\\n```\\nthen\\n```python\\ny = 2\\n```'
        WHEN 1 THEN text || E'\\n```\\nSELECT ' || turn || E'\\n```'
        WHEN 2 THEN text || E'\\n```json\\n{"turn": ' || turn || E', "ok": true}\\n```'
        WHEN 3 THEN '  {"turn": ' || turn || E', "tags": [1, 2]}\\n'
        WHEN 4 THEN text || ' {not json} and {"a": ' || turn || '} end' ELSE text END AS text) FROM conversations""",
    "catalog": """SELECT split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 50 <> 0 THEN text END AS description,
        'doc/' || doc_id AS url, source, lang AS type, n_chars AS stars FROM documents""",
    "lineitem_nulls": """SELECT * REPLACE (
        CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS l_tax,
        CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END AS l_discount,
        CASE WHEN l_orderkey % 35 <> 0 THEN l_returnflag END AS l_returnflag) FROM lineitem""",
    "lineitem_corr": "SELECT *, l_quantity * 2 + l_linenumber AS q2, -l_tax AS neg_tax FROM lineitem",
    "lineitem_const": "SELECT *, CAST(1 AS INTEGER) AS one, CAST(NULL AS DOUBLE) AS nothing FROM lineitem",
    "orders_tokens": """SELECT * REPLACE (
        CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' WHEN o_orderkey % 13 = 0 THEN ' - '
             WHEN o_orderkey % 17 = 0 THEN 'na' ELSE o_orderstatus END AS o_orderstatus) FROM orders""",
    "orders_text": """SELECT CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_totalprice AS VARCHAR) AS price_text,
        strftime(o_orderdate, '%Y-%m-%d') AS date_text, o_orderpriority,
        'c' || CAST(o_custkey AS VARCHAR) AS cust_text FROM orders""",
    "documents_nokey": "SELECT text, lang, source, n_chars FROM documents",
}


def source(name: str) -> str:
    """The table, or the derived input as a subquery."""
    return f"({SQL_DERIVED[name]}) AS {name}" if name in SQL_DERIVED else name


# ---- SQL fragments ----

def rnd(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits} + 0.0)"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return rnd(f"CAST({part} AS DOUBLE) / greatest({whole}, 1) * 100.0", digits)


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def per_column(table: str, cols: list[str], body: Callable[[str], str], tail: str = "") -> str:
    """One SELECT per column, each over the whole table."""
    return union([f"SELECT '{c}' AS \"column\", {body(c)} FROM {source(table)}{tail}" for c in cols])


def long_sql(table: str, cols: list[str], kind: str = "DOUBLE") -> str:
    """``(column, value)`` with missing values dropped."""
    return "SELECT * FROM (" + per_column(table, cols, lambda c: f"CAST({c} AS {kind}) AS value") + \
        ") WHERE value IS NOT NULL"
