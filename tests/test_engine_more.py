import datetime as dt
import io
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rulespark import engine_queries
from rulespark.functions.predicates import holds
from rulespark.model import ColumnType, CompileError, EvaluationError, LoadError, Op, Schema
from rulespark.operators import score as scoring
from rulespark.operators.lifecycle import CompileOptions, LoadOptions, compile_rules, load_rules, validate
from rulespark.operators.score import LoadedRules, activate, active, evaluate, load, match_all, numbered, rule_hits, score, score_bulk
from rulespark.operators.sql_text import to_sql
from rulespark.plans import kernel, strategies
from rulespark.sources.rules_csv import CsvFile, CsvText, frame_rules, json_rules, read_rows
from rulespark.streaming.score_stream import score_stream


def rules(text, selection="AUTO", **types):
    return compile_rules(CsvText(text), CompileOptions(Schema.of(**types), selection=selection))


TYPES = {"S": "STRING", "N": "INTEGER", "D": "DECIMAL", "B": "BOOLEAN", "A": "DATE", "T": "TIMESTAMP", "O": "INTEGER"}
POOL = {
    "S": ["", "a", "b", "c", "é", "zz"],
    "N": ["-3", "0", "4", "7", "12"],
    "D": ["0.5", "0.50", "1.25", "9"],
    "B": ["true", "false"],
    "A": ["1970-01-01", "2020-02-29", "2021-07-01"],
    "T": ["2020-01-01T00:00:00", "2020-06-01T12:30:00", "2021-01-01T00:00:00"],
}
INPUTS = {
    "S": [None, "", "a", "c", "d", "é"],
    "N": [None, -4, 0, 4, 5, 12],
    "D": [None, Decimal("0.5"), Decimal("1"), Decimal("9")],
    "B": [None, True, False],
    "A": [None, dt.date(1970, 1, 1), dt.date(2020, 2, 29), dt.date(2030, 1, 1)],
    "T": [None, dt.datetime(2020, 6, 1, 12, 30, tzinfo=dt.timezone.utc), dt.datetime(2022, 1, 1, tzinfo=dt.timezone.utc)],
}


def random_rules(seed, n):
    """Rules of all types with random operators and cells, half of them blank."""
    rng = random.Random(seed)
    ops = [o for o in Op if o.role == "input"]
    columns = [(k, rng.choice(ops)) for k in "SNDBAT"]
    lines = []
    for i in range(n):
        cells = []
        for k, o in columns:
            pool = POOL[k][1:] if k == "S" else POOL[k]
            some = rng.sample(pool, min(len(pool), rng.randint(1, 3)))
            two = sorted(rng.choices(pool, k=2))
            cells.append("" if rng.random() < 0.5 else f"({','.join([*some, *([''] if rng.random() < 0.2 else []), some[0]])})" if o.is_set else f"({two[0]},{two[1]})" if o.is_range else rng.choice(pool))
        lines.append(",".join([f"R{i}", *cells, str(i)]))
    head = ",".join(["ID", *[k for k, _ in columns], "O"]) + "\n" + ",".join(["RULE_ID", *[o.name for _, o in columns], "SET"])
    return rules(head + "\n" + "\n".join(lines), **TYPES)


@pytest.mark.parametrize("seed", range(3))
def test_strategies_agree_on_random_tables(spark, seed):
    r, rng = random_rules(seed, 90), random.Random(seed)
    rows = [(i, *(rng.choice(INPUTS[k]) for k in "SNDBAT")) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, S string, N int, D decimal(10,2), B boolean, A date, T timestamp")
    want = {}
    for i, *cells in rows:
        record = dict(zip("SNDBAT", cells, strict=True))
        want[i] = next((x.rule_id for x in r.rules if all(holds(c, record[c.name], x.operands[c.name]) for c in r.inputs)), None)
    for strategy in ("case", "nested_loop", "kernel"):
        assert {x["id"]: x["rule_id"] for x in score(r, df, strategy).collect()} == want, strategy
    df.createOrReplaceTempView("random_inputs")
    assert {x["id"]: x["rule_id"] for x in spark.sql(to_sql(r, "random_inputs")).collect()} == want
    # all matches, by the kernel and one by one
    every = {(x["id"], x["rank"]): x["rule_id"] for x in match_all(r, df, "id").collect()}
    for i, *cells in rows:
        record = dict(zip("SNDBAT", cells, strict=True))
        hits = [x.rule_id for x in r.rules if all(holds(c, record[c.name], x.operands[c.name]) for c in r.inputs)]
        assert [every.get((i, k + 1)) for k in range(len(hits) + 1)] == [*hits, None]


def test_kernel_in_rounds(spark, monkeypatch):
    """Few candidates at a time, rules by several keys, and rules that no key finds."""
    monkeypatch.setattr(kernel, "FIRST", 1)
    monkeypatch.setattr(kernel, "PAIRS", 64)
    lines = [f"R{i},{'' if i % 3 else 'ABCDEFGH'[i % 8]},{'' if i % 5 else f'({i % 4},{i % 6})'},{'' if i % 2 else i % 50},{i}" for i in range(300, 0, -1)]
    r = rules("RULE_ID,K,L,N,O\nRULE_ID,EQ,IN,GTE,SET\n" + "\n".join(lines), K="STRING", L="INTEGER", N="INTEGER", O="INTEGER")
    rows = [(i, "ABCDEFGHIJ"[i % 10], i % 7, i % 60) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, K string, L int, N int")
    assert {x["id"]: x["rule_id"] for x in score(r, df, "kernel").collect()} == {i: evaluate(r, {"K": k, "L": m, "N": n}).rule_id for i, k, m, n in rows}


def test_equi_needs_a_key_and_joins_by_hash(spark, capsys):
    with pytest.raises(EvaluationError, match="hash join"):
        score(rules("ID,N,O\nRULE_ID,LT,SET\nR,5,1", N="INTEGER", O="INTEGER"), spark.range(3).withColumnRenamed("id", "N"), "equi")
    for text, types in ((engine_queries._SEGMENT, engine_queries._SEGMENT_TYPES), (engine_queries._BRANDS, {"P_BRAND": "STRING", "P_SIZE": "INTEGER", "SHELF": "INTEGER"})):
        r = engine_queries.rules_of(text, **types)
        df = spark.createDataFrame([("1-URGENT", "O", 5.0, "Brand#11", 9)], "O_ORDERPRIORITY string, O_ORDERSTATUS string, O_TOTALPRICE double, P_BRAND string, P_SIZE int")
        score(r, df, "equi").explain()
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "SortMergeJoin" not in plan


def test_rules_in_parts(spark, monkeypatch):
    """Tables beyond the size of a broadcast: the joins take the rules in parts, outputs are looked up by the workers."""
    lines = [f"R{i},{'ABCDE'[i % 5]},{i % 9},{i}" for i in range(200)]
    r = rules("RULE_ID,K,N,O\nRULE_ID,EQ,GTE,SET\n" + "\n".join(lines), K="STRING", N="INTEGER", O="INTEGER")
    df = spark.createDataFrame([(i, "ABCDEF"[i % 6], i % 4) for i in range(60)], "id int, K string, N int")
    want = sorted(map(tuple, score(r, df, "kernel").collect()))
    monkeypatch.setattr(strategies, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 1000)
    for strategy in ("equi", "nested_loop", "kernel"):
        assert sorted(map(tuple, score(r, df, strategy).collect())) == want
    monkeypatch.setattr(strategies, "KERNEL_BYTES", 1000)
    assert strategies.choose(r, df) == "equi"


def test_odd_numbers_and_clashing_columns(spark):
    r = rules("RULE_ID,N,O\nRULE_ID,GT,SET\nR1,100,1\nR2,-1,2\nR3,,3", N="INTEGER", O="INTEGER")
    rows = [(0, float("nan")), (1, 1e30), (2, -1e30), (3, None), (4, 100.9), (5, float("inf")), (6, -0.5)]
    want = {0: "R2", 1: "R1", 2: "R3", 3: "R2", 4: "R2", 5: "R1", 6: "R2"}
    df = spark.createDataFrame(rows, "id int, N double")
    for s in ("case", "nested_loop", "kernel"):
        assert {x["id"]: x["rule_id"] for x in score(r, df, s).collect()} == want
    assert {i: evaluate(r, {"N": v}).rule_id for i, v in rows} == want
    clash = spark.createDataFrame([(7, 5, "a", "b", 1, {"m": 1}, "old")], "rule_ord int, N int, __ord string, __row string, __id int, __x0 map<string,int>, rule_id string")
    for s in ("case", "nested_loop", "kernel"):
        got = score(r, clash, s).first().asDict()
        assert got == {"rule_ord": 7, "N": 5, "__ord": "a", "__row": "b", "__id": 1, "__x0": {"m": 1}, "rule_id": "R2", "O": 2}, s


def test_sources(spark, tmp_path):
    text = "RULE_ID,K,O\nRULE_ID,IN,SET\nR1,(x, y),1\nR2,,2\n"
    want = [(1, ["RULE_ID", "K", "O"]), (2, ["RULE_ID", "IN", "SET"]), (3, ["R1", "(x, y)", "1"]), (4, ["R2", "", "2"])]
    (tmp_path / "r.csv").write_text(text)
    for source in (CsvFile(str(tmp_path / "r.csv")), CsvFile(f"file://{tmp_path}/r.csv", spark)):
        assert source.name == "r.csv" and list(read_rows(source)) == want
    doc = {"columns": ["RULE_ID", "K", "O"], "operators": ["RULE_ID", "IN", "SET"], "rules": [["R1", "(x, y)", 1], ["R2", None, 2]]}
    assert list(read_rows(json_rules(json.dumps(doc)))) == want
    table = spark.createDataFrame([(2, "R2", None, 2), (1, "R1", "(x, y)", 1)], "at int, RULE_ID string, K string, O int")
    source = frame_rules(table, {"RULE_ID": "RULE_ID", "K": "IN", "O": "SET"}, "at")
    schema = Schema.of(K="STRING", O="INTEGER")
    assert list(read_rows(source)) == want and validate(source, schema).ok
    assert compile_rules(source, CompileOptions(schema)).rules == compile_rules(CsvText(text), CompileOptions(schema)).rules

    class Own:
        name, format = "own", "CSV"

        def open(self):
            return io.StringIO(text)

    assert compile_rules(Own(), CompileOptions(schema)).metadata.row_count == 2
    with pytest.raises(CompileError):
        compile_rules(CsvFile(f"file://{tmp_path}/none.csv", spark), CompileOptions(schema))
    assert not validate(CsvFile(str(tmp_path / "none.csv")), schema).ok
    Own.format = "XML"
    assert validate(Own(), schema).issues == ("Unsupported format: XML",)


def test_empty_names_and_tokens():
    assert any("no operator for column" in x for x in validate(CsvText("ID,A,O\nRULE_ID,,SET\nR,1,1"), Schema.of(A="INTEGER", O="STRING")).issues)
    assert "Empty column name" in validate(CsvText("ID,,O\nRULE_ID,EQ,SET\nR,1,1"), Schema.of(O="STRING")).issues


def test_saved_rules_of_all_types(spark, tmp_path):
    r = random_rules(5, 40)
    path = f"file://{tmp_path}/rules"
    r.save(spark, path)
    again = load_rules(spark, path)
    assert again.rules == r.rules and again.metadata == r.metadata and again.columns == r.columns
    assert [f.name for f in spark.read.parquet(f"{path}/rules").schema.fields][:3] == ["rule_ord", "rule_id", "priority"]
    with pytest.raises(LoadError):
        load_rules(spark, f"file://{tmp_path}/none")
    spark.createDataFrame([('{"format_version": 99}',)], "value string").write.text(f"file://{tmp_path}/odd/metadata")
    with pytest.raises(LoadError, match="format version"):
        load_rules(spark, f"file://{tmp_path}/odd")


def test_load_options_and_close(spark, tmp_path):
    lines = "\n".join(f"R{i},{i},{i}" for i in range(100))
    r = rules("RULE_ID,K,O\nRULE_ID,EQ,SET\n" + lines, K="INTEGER", O="INTEGER")
    df = spark.range(5).withColumnRenamed("id", "K")
    want = [(i, f"R{i}", i) for i in range(5)]
    with LoadedRules(spark, r) as held:
        assert sorted(map(tuple, held.score(df).collect())) == sorted(map(tuple, held.score(df).collect())) == want
        assert len(held._shared) == 1
        assert held.evaluate({"K": 7}).rule_id == "R7"
    held.close()
    with pytest.raises(EvaluationError, match="closed"):
        held.score(df)
    assert sorted(map(tuple, LoadedRules(spark, r, LoadOptions(prewarm=False)).score(df).collect())) == want
    base = f"file://{tmp_path}/versions"
    activate(spark, base, "v1", r)
    activate(spark, base, "v2", rules("RULE_ID,K,O\nRULE_ID,GTE,SET\nall,0,9", K="INTEGER", O="INTEGER"))
    assert {x["rule_id"] for x in active(spark, base).score(df).collect()} == {"all"}
    activate(spark, base, "v1")
    assert sorted(map(tuple, active(spark, base).score(df).collect())) == want
    assert load(spark, f"{base}/v2").metadata.row_count == 1


def test_ordinals_and_null_policy(spark):
    df = spark.range(100).repartition(7).sortWithinPartitions("id")
    order = [r["id"] for r in df.collect()]
    assert [r["id"] for r in sorted(numbered(df, "at").collect(), key=lambda r: r["at"])] == order
    assert numbered(df.limit(0), "at").count() == 0
    r = rules("RULE_ID,N,O\nRULE_ID,LT,SET\nR1,5,1\nR2,,2", N="INTEGER", O="INTEGER")
    got = score_bulk(r, {"N": 3}, spark.createDataFrame([(9,), (None,), (1,)], "N int").coalesce(1), ordinal="at").collect()
    assert [x["rule_id"] for x in sorted(got, key=lambda x: x["at"])] == ["R2", "R1", "R1"]
    some = spark.createDataFrame([(None,), (3,)], "N int")
    assert [x["rule_id"] for x in score(r, some, null_policy="unmatched").collect()] == [None, "R1"]
    assert {x["rule_id"] for x in score(r, spark.range(2), null_policy="unmatched").collect()} == {None}
    hits = {x["rule_id"]: x["hits"] for x in rule_hits(r, some).collect()}
    assert hits == {"R1": 2, "R2": 0}


def test_ordinals_of_sorted_variants_in_many_partitions(spark, tmp_path):
    """Each plan of a sort samples its own bounds; numbers must not depend on them. A null key is the last, as in the SQL."""
    n = 20_000
    keys = F.when(F.col("id") != 7, F.col("id") * 7919 % n)
    spark.range(n, numPartitions=3).select(keys.alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    size = {None if i == 7 else i * 7919 % n: i % 50 for i in range(n)}
    want = [(at, k, "V1" if 1 <= size[k] <= 12 else "V2" if 8 <= size[k] <= 40 else None) for at, k in enumerate([*sorted(k for k in size if k is not None), None])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = engine_queries.QUERIES["bulk_ordinal"](spark, str(tmp_path))
        for _ in range(2):
            assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
        few = numbered(spark.read.parquet(f"{tmp_path}/part.parquet").orderBy(F.desc("p_size"), "p_partkey"), "at")
        assert [r["at"] for r in few.orderBy("at").select("at").collect()] == list(range(n))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_stream_of_many_rules(spark, tmp_path):
    r = rules("RULE_ID,K,O\nRULE_ID,EQ,SET\n" + "\n".join(f"R{i},{i},{i}" for i in range(200)), K="INTEGER", O="INTEGER")
    spark.range(50).withColumnRenamed("id", "K").write.parquet(f"file://{tmp_path}/in")
    q = score_stream(r, spark.readStream.schema("K long").parquet(f"file://{tmp_path}/in")).writeStream.format("memory").queryName("many").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("many").where("rule_id = concat('R', K) AND O = K").count() == 50


def test_types_of_outputs(spark):
    r = rules("RULE_ID,K,D,T,B,P\nRULE_ID,EQ,SET,SET,SET,SET\nR,x,2020-02-29,2020-01-01T00:00:00,yes,1.50", K="STRING", D="DATE", T="TIMESTAMP", B="BOOLEAN", P="DECIMAL")
    got = score(r, spark.createDataFrame([("x",)], "K string")).first()
    assert (got["D"], got["B"], got["P"]) == (dt.date(2020, 2, 29), True, "1.50")
    assert dict(score(r, spark.createDataFrame([("x",)], "K string")).dtypes)["T"] == "timestamp"
    assert ColumnType.DECIMAL.value == "decimal(38,18)"
