import datetime as dt
import itertools

import pytest

from rulespark.functions.predicates import holds
from rulespark.model import Column, ColumnType, CompileError, EvaluationError, Op, Schema, operator_of
from rulespark.operators.lifecycle import CompileOptions, compile_rules, load_rules, validate
from rulespark.operators.score import evaluate, evaluate_bulk, score, score_bulk
from rulespark.sources.rules_csv import CsvText, operand, read_rows
from rulespark.streaming.score_stream import score_stream


def rules(text, selection="AUTO", **types):
    return compile_rules(CsvText(text), CompileOptions(Schema.of(**types), selection=selection))


def test_operators():
    assert operator_of(" not   between ") is Op.NOT_BETWEEN_INCLUSIVE
    assert operator_of("not_equal") is Op.NE
    for bad in ("EQUALS", "<>", "NOT_BETWEEN"):
        with pytest.raises(ValueError, match="Unsupported operator token"):
            operator_of(bad)
    with pytest.raises(ValueError, match="must not be null"):
        operator_of(None)


def test_rows():
    assert list(read_rows(CsvText("A,,C\n  \n A , (B, C) ,  D  "))) == [(1, ["A", "", "C"]), (3, ["A", "(B, C)", "D"])]
    for bad in ("A,(B,C", "A,B),C"):
        with pytest.raises(OSError, match="Unbalanced parentheses at row 1"):
            list(read_rows(CsvText(bad)))


def test_set_cells():
    c = Column("X", Op.IN, ColumnType.STRING)
    assert operand("()", c) == ()
    assert operand("(A,)", c) == ("A",)
    assert operand("(A,,B)", c) == ("A", None, "B")
    assert operand("", c) is None


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("", "Missing header"),
        ("RULE_ID,A,O", "Missing operator row"),
        ("RULE_ID,A,O\nRULE_ID,EQ", "operators for"),
        ("RULE_ID,A,O\nRULE_ID,LIKE,SET\nR,1,1", "unsupported"),
        ("RULE_ID,B,O\nRULE_ID,EQ,SET\nR,1,1", "not declared"),
        ("A,O\nEQ,SET\n1,1", "No RULE_ID"),
        ("RULE_ID,A\nRULE_ID,EQ\nR,1", "No SET"),
        ("RULE_ID,A,O\nRULE_ID,EQ,SET\nR,1", "cells for"),
        ("RULE_ID,A,O\nRULE_ID,EQ,SET\n,1,1", "blank RULE_ID"),
        ("RULE_ID,A,O\nRULE_ID,EQ,SET\nR,1,", "sets no output"),
        ("RULE_ID,A,O\nRULE_ID,BETWEEN,SET\nR,(1),1", "two bounds"),
        ("RULE_ID,A,O\nRULE_ID,IN,SET\nR,1,1", "not in parentheses"),
        ("RULE_ID,A,O\nRULE_ID,EQ,SET", "No rules"),
    ],
)
def test_validation(text, said):
    assert any(said in x for x in validate(CsvText(text), Schema.of(A="INTEGER", O="STRING")).issues)


def test_order_and_errors():
    text = "RULE_ID,PRIORITY,A,O\nRULE_ID,PRIORITY,GT,SET\nX,5,1,x\nY,20,3,y\nZ,20,2,z"
    assert [r.rule_id for r in rules(text, A="INTEGER", O="STRING").rules] == ["Y", "Z", "X"]
    assert [r.rule_id for r in rules(text, "FIRST_MATCH", A="INTEGER", O="STRING").rules] == ["X", "Y", "Z"]
    with pytest.raises(CompileError):
        rules(text.replace("20,3", "high,3"), A="INTEGER", O="STRING")
    with pytest.raises(EvaluationError, match="No matching rule"):
        evaluate(rules(text, A="INTEGER", O="STRING"), {"A": 0})


def test_bulk_overlay():
    """Cells of a variant go before those of the base; results keep the order of the variants."""
    r = rules("RULE_ID,SIZE,BRAND,PRIORITY,TEST_NOTE,BIN\nRULE_ID,LT,NOT IN,PRIORITY,EQ,SET\nsmall,10,,2,x,a\nodd,,(Brand#11),1,,b", SIZE="INTEGER", BRAND="STRING", TEST_NOTE="STRING", BIN="STRING")
    got = evaluate_bulk(r, {"BRAND": "Brand#55", "SIZE": 44}, [{}, {"SIZE": 3}, {"BRAND": "Brand#11", "SIZE": 9}])
    assert [(d.rule_id, d.outputs) for d in got] == [("odd", {"BIN": "b"}), ("small", {"BIN": "a"}), ("small", {"BIN": "a"})]
    with pytest.raises(EvaluationError):
        evaluate_bulk(r, {"BRAND": "Brand#11"}, [{"SIZE": 50}])


VALUES = {
    "STRING": [None, "", "a", "b", "c"],
    "INTEGER": [None, -1, 0, 5, 9],
    "DECIMAL": [None, 0.0, 0.5, 2.5],
    "BOOLEAN": [None, True, False],
    "DATE": [None, dt.date(1970, 1, 1), dt.date(2020, 5, 5)],
    "TIMESTAMP": [None, dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc), dt.datetime(2021, 1, 1, tzinfo=dt.timezone.utc)],
}
CELLS = {"STRING": ("b", "c"), "INTEGER": ("0", "5"), "DECIMAL": ("0.5", "2.5"), "BOOLEAN": ("false", "true"), "DATE": ("1970-01-01", "2020-05-05"), "TIMESTAMP": ("2020-06-01T00:00:00", "2021-01-01T00:00:00")}


@pytest.mark.parametrize("kind", list(VALUES))
@pytest.mark.parametrize("strategy", ["case", "nested_loop", "kernel"])
def test_every_operator_and_type(spark, kind, strategy):
    """All predicates on a type, missing inputs too, against the plain evaluation."""
    ops = [o for o in Op if o.role == "input"]
    low, high = CELLS[kind]
    columns = [Column(f"X{i}", o, ColumnType[kind]) for i, o in enumerate(ops)]
    cell = lambda o: f"({low},{high})" if o.is_range else f"({low},,{high})" if o.is_set else low
    sql = {"DECIMAL": "double"}.get(kind, ColumnType[kind].value)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES[kind])], f"id int, v {sql}")
    for c in columns:
        r = rules(f"RULE_ID,V,O\nRULE_ID,{c.op.name},SET\nR,{cell(c.op)},1", V=kind, O="STRING")
        got = {row["id"]: row["rule_id"] == "R" for row in score(r, df, strategy).collect()}
        assert got == {i: holds(c, v, operand(cell(c.op), c)) for i, v in enumerate(VALUES[kind])}, c.op


def test_strategies_agree(spark):
    lines = [f"R{i},{'' if i % 7 == 0 else 'ABCDE'[i % 5]},{'' if i % 3 else f'({i % 20},{i % 20 + 9})'},{i}" for i in range(150)]
    r = rules("RULE_ID,K,N,O\nRULE_ID,EQ,BETWEEN,SET\n" + "\n".join(lines), K="STRING", N="INTEGER", O="INTEGER")
    rows = [(i, k, n) for i, (k, n) in enumerate(itertools.product([None, "", "A", "C", "Z"], [None, 0, 7, 15, 99]))]
    df = spark.createDataFrame(rows, "id int, K string, N int")
    want = {i: evaluate(r, {"K": k, "N": n}).rule_id for i, k, n in rows}
    for s in ("case", "nested_loop", "equi", "kernel"):
        assert {x["id"]: x["rule_id"] for x in score(r, df, s).collect()} == want, s


def test_roundtrip_no_match_and_stream(spark, tmp_path):
    r = rules("RULE_ID,K,O\nRULE_ID,EQ,SET\nR,x,1", K="STRING", O="INTEGER")
    r.save(spark, f"file://{tmp_path}/rules")
    again = load_rules(spark, f"file://{tmp_path}/rules")
    assert again.rules == r.rules and again.metadata == r.metadata
    df = spark.createDataFrame([("x",), ("y",)], "K string")
    assert sorted((x["K"], x["O"]) for x in score(again, df).collect() if x["O"]) == [("x", 1)]
    with pytest.raises(Exception, match="No matching rule"):
        score(r, df, on_no_match="error").collect()
    assert {x["rule_id"] for x in score_bulk(r, {"K": "x"}, spark.range(2)).collect()} == {"R"}
    df.write.parquet(f"file://{tmp_path}/in")
    q = score_stream(r, spark.readStream.schema("K string").parquet(f"file://{tmp_path}/in")).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").where("rule_id = 'R'").count() == 1
