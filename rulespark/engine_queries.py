"""Queries over decision tables, each with the SQL it must equal, written by hand from the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.model import Schema
from rulespark.operators.lifecycle import CompileOptions, compile_rules
from rulespark.operators.score import load, match_all, rule_hits, score, score_bulk
from rulespark.operators.sql_text import to_sql
from rulespark.sources.paths import shared_dir
from rulespark.sources.rules_csv import CsvText


def rules_of(text: str, selection: str = "AUTO", priority: str = "PRIORITY", **types):
    return compile_rules(CsvText(text.strip()), CompileOptions(Schema.of(**types), selection=selection, priority_column=priority))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def scored(name, tbl, key, text, sql, outs=("OUT",), prepare=None, strategy=None, selection="AUTO", priority="PRIORITY", **types) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, tbl)
        df = prepare(df) if prepare else df
        out = score(rules_of(text, selection, priority, **types), df, strategy)
        return out.select(key, "rule_id", *[F.col(o).cast("string").alias(o.lower()) for o in outs])

    register(name, run, sql)


def one_column(name, tbl, key, col, op, operand, kind, when) -> None:
    """One rule on one column, and a fallback."""
    text = f"RULE_ID,{col.upper()},OUT\nRULE_ID,{op},SET\nR1,{operand},hit\nR2,,rest"
    sql = f"SELECT {key}, CASE WHEN {when} THEN 'R1' ELSE 'R2' END AS rule_id, CASE WHEN {when} THEN 'hit' ELSE 'rest' END AS out FROM {tbl}"
    scored(name, tbl, key, text, sql, **{col.upper(): kind, "OUT": "STRING"})


for _name, _op, _cell, _when in (
    ("pred_gt", "GT", "25", "p_size > 25"),
    ("pred_gte", ">=", "25", "p_size >= 25"),
    ("pred_lt", "<", "25", "p_size < 25"),
    ("pred_lte", "LTE", "25", "p_size <= 25"),
    ("pred_between_incl", "BETWEEN", "(10,20)", "p_size BETWEEN 10 AND 20"),
    ("pred_between_excl", "BETWEEN_EXCLUSIVE", "(10,20)", "p_size > 10 AND p_size < 20"),
    ("pred_not_between_incl", "NOT BETWEEN", "(10,20)", "p_size < 10 OR p_size > 20"),
    ("pred_not_between_excl", "NOT_BETWEEN_EXCLUSIVE", "(10,20)", "p_size <= 10 OR p_size >= 20"),
    ("operator_aliases", "  not   in ", "(1,2,3)", "p_size NOT IN (1, 2, 3)"),
):
    one_column(_name, "part", "p_partkey", "p_size", _op, _cell, "INTEGER", _when)
one_column("pred_eq", "orders", "o_orderkey", "o_orderstatus", "=", "F", "STRING", "o_orderstatus = 'F'")
one_column("pred_ne", "orders", "o_orderkey", "o_orderstatus", "!=", "F", "STRING", "o_orderstatus <> 'F'")
one_column("pred_in", "orders", "o_orderkey", "o_orderpriority", "IN", "(1-URGENT,2-HIGH)", "STRING", "o_orderpriority IN ('1-URGENT', '2-HIGH')")
one_column("pred_not_in", "customer", "c_custkey", "c_mktsegment", "NOT_IN", "(BUILDING,MACHINERY)", "STRING", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
one_column("type_decimal", "customer", "c_custkey", "c_acctbal", "BETWEEN", "(0.50,5000.25)", "DECIMAL", "c_acctbal BETWEEN 0.50::DOUBLE AND 5000.25::DOUBLE")
one_column("type_date", "orders", "o_orderkey", "o_orderdate", "GTE", "1996-01-01", "DATE", "o_orderdate::DATE >= DATE '1996-01-01'")
one_column("type_timestamp", "events", "event_id", "ts", "LT", "2024-01-15T12:00:00", "TIMESTAMP", "ts < TIMESTAMP '2024-01-15 12:00:00'")
scored("type_boolean", "customer", "c_custkey", "RULE_ID,RICH,OUT\nRULE_ID,EQ,SET\nR1,yes,a\nR2,no,b", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'R1' ELSE 'R2' END AS rule_id, CASE WHEN c_acctbal > 0 THEN 'a' ELSE 'b' END AS out FROM customer", prepare=lambda d: d.withColumn("RICH", F.col("c_acctbal") > 0), RICH="BOOLEAN", OUT="STRING")
_PRICE = "CAST(trunc(o_totalprice) AS BIGINT)"
_MAIN = "RULE_ID,PRIORITY,O_ORDERSTATUS,O_TOTALPRICE,O_ORDERPRIORITY,SURCHARGE\nRULE_ID,PRIORITY,EQ,BETWEEN,NOT IN,SET\nR1,5,,,,0.00\nR2,20,O,(100000,300000),(5-LOW),0.10\nR3,10,F,(200000,499999),,0.07\nR4,30,,(450000,600000),(1-URGENT,2-HIGH),0.15"
_MAIN_TYPES = {"O_ORDERSTATUS": "STRING", "O_TOTALPRICE": "INTEGER", "O_ORDERPRIORITY": "STRING", "SURCHARGE": "DECIMAL"}
_MAIN_CASE = f"CASE WHEN {_PRICE} BETWEEN 450000 AND 600000 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'R4' WHEN o_orderstatus = 'O' AND {_PRICE} BETWEEN 100000 AND 300000 AND o_orderpriority <> '5-LOW' THEN 'R2' WHEN o_orderstatus = 'F' AND {_PRICE} BETWEEN 200000 AND 499999 THEN 'R3' ELSE 'R1' END"
_MAIN_SQL = f"SELECT o_orderkey, rule_id, CASE rule_id WHEN 'R1' THEN '0.00' WHEN 'R2' THEN '0.10' WHEN 'R3' THEN '0.07' ELSE '0.15' END AS surcharge FROM (SELECT o_orderkey, {_MAIN_CASE} AS rule_id FROM orders)"
# strategies, all on the same table; the equi join needs a column that most rules test, so it has a table of its own
for _name in ("case", "nested_loop", "kernel"):
    scored(f"strategy_{_name}", "orders", "o_orderkey", _MAIN, _MAIN_SQL, outs=("SURCHARGE",), strategy=_name, **_MAIN_TYPES)
scored("select_priority_unsorted", "orders", "o_orderkey", _MAIN, _MAIN_SQL, outs=("SURCHARGE",), selection="PRIORITY", **_MAIN_TYPES)

_SEGMENT = "RULE_ID,O_ORDERPRIORITY,O_ORDERSTATUS,O_TOTALPRICE,LANE\nRULE_ID,EQ,NE,LT,SET\nE1,1-URGENT,P,90000,fast\nE2,2-HIGH,,150000,quick\nE3,1-URGENT,,,express\nE4,3-MEDIUM,F,,plain\nE5,,O,20000,small"
_SEGMENT_SQL = f"""SELECT o_orderkey, rule_id, CASE rule_id WHEN 'E1' THEN 'fast' WHEN 'E2' THEN 'quick' WHEN 'E3' THEN 'express' WHEN 'E4' THEN 'plain' WHEN 'E5' THEN 'small' END AS lane
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' AND {_PRICE} < 90000 THEN 'E1'
  WHEN o_orderpriority = '2-HIGH' AND {_PRICE} < 150000 THEN 'E2' WHEN o_orderpriority = '1-URGENT' THEN 'E3'
  WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus <> 'F' THEN 'E4'
  WHEN o_orderstatus <> 'O' AND {_PRICE} < 20000 THEN 'E5' END AS rule_id FROM orders)"""
_SEGMENT_TYPES = {"O_ORDERPRIORITY": "STRING", "O_ORDERSTATUS": "STRING", "O_TOTALPRICE": "INTEGER", "LANE": "STRING"}
scored("strategy_equi", "orders", "o_orderkey", _SEGMENT, _SEGMENT_SQL, outs=("LANE",), strategy="equi", **_SEGMENT_TYPES)

_BRANDS = "RULE_ID,P_BRAND,P_SIZE,SHELF\nRULE_ID,IN,BETWEEN_EXCLUSIVE,SET\nI1,(Brand#11,Brand#12,Brand#13),(5,30),7\nI2,(Brand#13,Brand#21),,8\nI3,(Brand#31,Brand#32),(0,51),9\nI4,(Brand#11),(29,40),10"
_BRANDS_SQL = """SELECT p_partkey, rule_id, CASE rule_id WHEN 'I1' THEN '7' WHEN 'I2' THEN '8' WHEN 'I3' THEN '9' WHEN 'I4' THEN '10' END AS shelf
FROM (SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size > 5 AND p_size < 30 THEN 'I1'
  WHEN p_brand IN ('Brand#13', 'Brand#21') THEN 'I2' WHEN p_brand IN ('Brand#31', 'Brand#32') AND p_size > 0 AND p_size < 51 THEN 'I3'
  WHEN p_brand = 'Brand#11' AND p_size > 29 AND p_size < 40 THEN 'I4' END AS rule_id FROM part)"""
for _name in ("equi", "kernel"):
    scored(f"in_key_{_name}", "part", "p_partkey", _BRANDS, _BRANDS_SQL, outs=("SHELF",), strategy=_name, P_BRAND="STRING", P_SIZE="INTEGER", SHELF="INTEGER")

scored(
    "conjunction", "customer", "c_custkey",
    "RULE_ID,C_MKTSEGMENT,C_ACCTBAL,C_NATIONKEY,OUT\nRULE_ID,NE,GT,NOT BETWEEN,SET\nC1,BUILDING,1000,(5,15),far\nC2,MACHINERY,5000,(0,20),edge",
    "SELECT c_custkey, CASE WHEN a THEN 'C1' WHEN b THEN 'C2' END AS rule_id, CASE WHEN a THEN 'far' WHEN b THEN 'edge' END AS out FROM (SELECT c_custkey, c_mktsegment <> 'BUILDING' AND trunc(c_acctbal) > 1000 AND (c_nationkey < 5 OR c_nationkey > 15) AS a, c_mktsegment <> 'MACHINERY' AND trunc(c_acctbal) > 5000 AND (c_nationkey < 0 OR c_nationkey > 20) AS b FROM customer)",
    C_MKTSEGMENT="STRING", C_ACCTBAL="INTEGER", C_NATIONKEY="INTEGER", OUT="STRING",
)
scored(
    "wildcard_fallback", "events", "event_id",
    "RULE_ID,EVENT_TYPE,VALUE,OUT\nRULE_ID,EQ,GTE,SET\nW1,click,50,hot\nW2,click,,warm\nW3,,80,big\nW4,,,other",
    "SELECT event_id, CASE WHEN event_type = 'click' AND trunc(value) >= 50 THEN 'W1' WHEN event_type = 'click' THEN 'W2' WHEN trunc(value) >= 80 THEN 'W3' ELSE 'W4' END AS rule_id, CASE WHEN event_type = 'click' AND trunc(value) >= 50 THEN 'hot' WHEN event_type = 'click' THEN 'warm' WHEN trunc(value) >= 80 THEN 'big' ELSE 'other' END AS out FROM events",
    EVENT_TYPE="STRING", VALUE="INTEGER", OUT="STRING",
)
scored(
    "select_auto", "supplier", "s_suppkey",
    "RULE_ID,S_NATIONKEY,PRIORITY,S_ACCTBAL,OUT\nRULE_ID,LTE,PRIORITY,LT,SET\nA1,,1,,1\nA2,9,3,,2\nA3,,2,2500.5,3",
    "SELECT s_suppkey, CASE WHEN s_nationkey <= 9 THEN 'A2' WHEN s_acctbal < 2500.5::DOUBLE THEN 'A3' ELSE 'A1' END AS rule_id, CASE WHEN s_nationkey <= 9 THEN '2' WHEN s_acctbal < 2500.5::DOUBLE THEN '3' ELSE '1' END AS out FROM supplier",
    S_NATIONKEY="INTEGER", S_ACCTBAL="DECIMAL", OUT="INTEGER",
)
scored("custom_priority_column", "orders", "o_orderkey", _MAIN.replace(",PRIORITY,O_", ",RANK,O_", 1), _MAIN_SQL, outs=("SURCHARGE",), priority="RANK", **_MAIN_TYPES)
scored("select_first_match", "orders", "o_orderkey", _MAIN, "SELECT o_orderkey, 'R1' AS rule_id, '0.00' AS surcharge FROM orders", outs=("SURCHARGE",), selection="FIRST_MATCH", **_MAIN_TYPES)
_TIES = "RULE_ID,PRIORITY,P_SIZE,OUT\nRULE_ID,PRIORITY,GT,SET\nA,7,40,x\nB,,10,y\nC,7,20,z\nD,-1,,w"
scored("priority_ties_and_blank", "part", "p_partkey", _TIES, "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'A' WHEN p_size > 20 THEN 'C' WHEN p_size > 10 THEN 'B' ELSE 'D' END AS rule_id, CASE WHEN p_size > 40 THEN 'x' WHEN p_size > 20 THEN 'z' WHEN p_size > 10 THEN 'y' ELSE 'w' END AS out FROM part", P_SIZE="INTEGER", OUT="STRING")
scored("no_match_null", "orders", "o_orderkey", "RULE_ID,O_ORDERSTATUS,OUT\nRULE_ID,EQ,SET\nR1,P,1", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'R1' END AS rule_id, CASE WHEN o_orderstatus = 'P' THEN '1' END AS out FROM orders", O_ORDERSTATUS="STRING", OUT="INTEGER")
scored("multi_output_blank_and_test_columns", "customer", "c_custkey", "RULE_ID,C_MKTSEGMENT,TEST_X,OUT,DAY,TEST_EXPECT\nRULE_ID,EQ,EQ,SET,SET,SET\nR1,BUILDING,never,5,1970-01-01,t\nR2,,,,2020-02-29,t", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'R1' ELSE 'R2' END AS rule_id, CASE WHEN c_mktsegment = 'BUILDING' THEN '5' END AS out, CASE WHEN c_mktsegment = 'BUILDING' THEN '1970-01-01' ELSE '2020-02-29' END AS day FROM customer", outs=("OUT", "DAY"), C_MKTSEGMENT="STRING", TEST_X="STRING", OUT="INTEGER", DAY="DATE", TEST_EXPECT="STRING")
_NULLED = lambda d: d.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("V"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("T"))
scored("missing_inputs", "events", "event_id", "RULE_ID,V,T,ABSENT,OUT\nRULE_ID,LT,NE,NOT IN,SET\nR1,10,view,(x),a\nR2,,click,,b\nR3,,,,c", "SELECT event_id, CASE WHEN v < 10 AND t <> 'view' THEN 'R1' WHEN t <> 'click' THEN 'R2' ELSE 'R3' END AS rule_id, CASE WHEN v < 10 AND t <> 'view' THEN 'a' WHEN t <> 'click' THEN 'b' ELSE 'c' END AS out FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(trunc(value) AS BIGINT) ELSE 0 END AS v, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS t FROM events)", prepare=_NULLED, V="INTEGER", T="STRING", ABSENT="STRING", OUT="STRING")


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/rules-{uuid.uuid4().hex}"
    rules_of(_MAIN, **_MAIN_TYPES).save(spark, path)
    loaded = load(spark, path)
    return loaded.score(read(spark, sf_dir, "orders")).select("o_orderkey", "rule_id", F.col("SURCHARGE").alias("surcharge"))


register("artifact_roundtrip", _roundtrip, _MAIN_SQL)


def _to_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = f"orders_{uuid.uuid4().hex}"
    read(spark, sf_dir, "orders").createOrReplaceTempView(view)
    return spark.sql(to_sql(rules_of(_MAIN, **_MAIN_TYPES), view)).select("o_orderkey", "rule_id", F.col("SURCHARGE").alias("surcharge"))


register("rules_as_sql", _to_sql, _MAIN_SQL)

# parts laid over a base part: half of them take the base's brand, a third its size
_BULK = "RULE_ID,P_SIZE,P_BRAND,PRIORITY,BIN\nRULE_ID,BETWEEN,NOT IN,PRIORITY,SET\nV1,(1,12),(Brand#11),4,a-1\nV2,(8,40),,3,b-2\nV3,,(Brand#44,Brand#55),2,c-3"
_BULK_CASE = "CASE WHEN size BETWEEN 1 AND 12 AND brand <> 'Brand#11' THEN 'V1' WHEN size BETWEEN 8 AND 40 THEN 'V2' WHEN brand NOT IN ('Brand#44', 'Brand#55') THEN 'V3' END"
_BULK_ROWS = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Brand#44' END AS brand, CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 45 END AS size FROM part"
_BULK_BINS = "CASE rule_id WHEN 'V1' THEN 'a-1' WHEN 'V2' THEN 'b-2' WHEN 'V3' THEN 'c-3' END AS bin"


def _bulk_rules():
    return rules_of(_BULK, P_SIZE="INTEGER", P_BRAND="STRING", BIN="STRING")


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    variants = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("P_BRAND"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("P_SIZE"))
    return score_bulk(_bulk_rules(), {"P_BRAND": "Brand#44", "P_SIZE": 45}, variants).select("p_partkey", "rule_id", F.col("BIN").alias("bin"))


register("bulk_base_variants", _bulk, f"SELECT p_partkey, rule_id, {_BULK_BINS} FROM (SELECT p_partkey, {_BULK_CASE} AS rule_id FROM ({_BULK_ROWS}))")


def _bulk_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants in the order of a sorted list, numbered; a null key comes last, as in the SQL."""
    variants = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant"), F.col("p_size").alias("P_SIZE")).orderBy(F.asc_nulls_last("variant"))
    return score_bulk(_bulk_rules(), {"P_BRAND": "Brand#55"}, variants, ordinal="variant_ord").select("variant_ord", "variant", "rule_id")


register("bulk_ordinal", _bulk_ordered, f"SELECT variant_ord, variant, rule_id FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS variant_ord, p_partkey AS variant, {_BULK_CASE} AS rule_id FROM (SELECT p_partkey, p_size AS size, 'Brand#55' AS brand FROM part))")
register("null_policy_unmatched", lambda spark, d: score(_bulk_rules(), read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("P_BRAND"), F.col("p_size").alias("P_SIZE")), null_policy="unmatched").select("p_partkey", "rule_id"),
    f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {_BULK_CASE} END AS rule_id FROM (SELECT p_partkey, p_brand AS brand, p_size AS size FROM part)")
_ALL = f"SELECT o_orderkey, rule_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY ord) AS rank FROM (SELECT o_orderkey, 'R4' AS rule_id, 0 AS ord FROM orders WHERE {_PRICE} BETWEEN 450000 AND 600000 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') UNION ALL SELECT o_orderkey, 'R2', 1 FROM orders WHERE o_orderstatus = 'O' AND {_PRICE} BETWEEN 100000 AND 300000 AND o_orderpriority <> '5-LOW' UNION ALL SELECT o_orderkey, 'R3', 2 FROM orders WHERE o_orderstatus = 'F' AND {_PRICE} BETWEEN 200000 AND 499999 UNION ALL SELECT o_orderkey, 'R1', 3 FROM orders)"
register("match_all", lambda spark, d: match_all(rules_of(_MAIN, **_MAIN_TYPES), read(spark, d, "orders"), "o_orderkey"), _ALL)
register("top_k", lambda spark, d: match_all(rules_of(_MAIN, **_MAIN_TYPES), read(spark, d, "orders"), "o_orderkey", 1), f"SELECT * FROM ({_ALL}) WHERE rank <= 1")
register("rule_hits", lambda spark, d: rule_hits(rules_of(_MAIN, **_MAIN_TYPES), read(spark, d, "orders")), f"SELECT r.rule_id, count(s.rule_id) AS hits FROM (VALUES ('R1'), ('R2'), ('R3'), ('R4')) r(rule_id) LEFT JOIN ({_MAIN_SQL}) s USING (rule_id) GROUP BY r.rule_id")
_BIG = "RULE_ID,P_BRAND,P_SIZE,OUT\nRULE_ID,EQ,GTE,SET\n" + "\n".join(f"S{i},Brand#{11 + i % 25},{50 - i // 25},{i}" for i in range(1000))
for _name in ("equi", "nested_loop", "kernel"):
    register(f"thousand_rules_{_name}", lambda spark, d, s=_name: score(rules_of(_BIG, P_BRAND="STRING", P_SIZE="INTEGER", OUT="INTEGER"), read(spark, d, "part"), s).select("p_partkey", "rule_id", F.col("OUT").cast("string").alias("out")),
        "WITH r AS (SELECT i, 'Brand#' || (11 + i % 25) AS brand, 50 - i // 25 AS size FROM range(1000) t(i)) SELECT p_partkey, 'S' || min(i) AS rule_id, CAST(min(i) AS VARCHAR) AS out FROM part LEFT JOIN r ON p_brand = brand AND p_size >= size GROUP BY p_partkey")


register("thousand_rules_match_all", lambda spark, d: match_all(rules_of(_BIG, P_BRAND="STRING", P_SIZE="INTEGER", OUT="INTEGER"), read(spark, d, "part"), "p_partkey", 3),
    "WITH r AS (SELECT i, 'Brand#' || (11 + i % 25) AS brand, 50 - i // 25 AS size FROM range(1000) t(i)) SELECT * FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS rank, 'S' || i AS rule_id FROM part JOIN r ON p_brand = brand AND p_size >= size) WHERE rank <= 3")
# only ranges: no column that an input could be looked up by
_RANGES = "RULE_ID,P_SIZE,P_RETAILPRICE,OUT\nRULE_ID,NOT_BETWEEN_EXCLUSIVE,BETWEEN,SET\n" + "\n".join(f"G{i},({10 + i % 7},{35 + i % 11}),({800 + 3 * i},{1100 + 4 * i}),{i}" for i in range(200))
for _name in ("kernel", "nested_loop"):
    register(f"range_rules_{_name}", lambda spark, d, s=_name: score(rules_of(_RANGES, P_SIZE="INTEGER", P_RETAILPRICE="DECIMAL", OUT="INTEGER"), read(spark, d, "part"), s).select("p_partkey", "rule_id"),
        "WITH r AS (SELECT i, 10 + i % 7 AS a, 35 + i % 11 AS b, 800 + 3 * i AS low, 1100 + 4 * i AS high FROM range(200) t(i)) SELECT p_partkey, 'G' || min(i) AS rule_id FROM part LEFT JOIN r ON (p_size <= a OR p_size >= b) AND p_retailprice BETWEEN low::DOUBLE AND high::DOUBLE GROUP BY p_partkey")


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = score(rules_of("RULE_ID,C_ACCTBAL,TIER\nRULE_ID,GTE,SET\nA,5000,gold\nB,0,silver\nC,,iron", C_ACCTBAL="INTEGER", TIER="STRING"), read(spark, sf_dir, "customer")).drop("rule_id")
    second = score(rules_of("RULE_ID,TIER,C_MKTSEGMENT,RATE\nRULE_ID,IN,EQ,SET\nX,(gold,silver),BUILDING,0.20\nY,(gold),,0.10\nZ,,,0.00", TIER="STRING", C_MKTSEGMENT="STRING", RATE="DECIMAL"), first)
    return second.select("c_custkey", "rule_id", F.col("RATE").alias("rate"))


register("chained_rulesets", _chained, "SELECT c_custkey, CASE WHEN t >= 0 AND c_mktsegment = 'BUILDING' THEN 'X' WHEN t >= 5000 THEN 'Y' ELSE 'Z' END AS rule_id, CASE WHEN t >= 0 AND c_mktsegment = 'BUILDING' THEN '0.20' WHEN t >= 5000 THEN '0.10' ELSE '0.00' END AS rate FROM (SELECT c_custkey, c_mktsegment, CAST(trunc(c_acctbal) AS BIGINT) AS t FROM customer)")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["select_priority_unsorted"](spark, sf_dir)
