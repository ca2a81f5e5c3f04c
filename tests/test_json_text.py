"""JSON held in text: nothing is lost, types are exact."""

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StringType, StructType

from shredkit import FlattenOptions, IngestConfig, flatten
from shredkit.operators.ingest import ingest_json_column
from shredkit.plans.jsoncols import infer_json_schemas, variant_type
from shredkit.sources.json import parse_json_column


def test_variant_types_are_read_by_structure():
    t = variant_type("OBJECT<VOID: BIGINT, VARIANT: STRING, `a-b`: ARRAY<OBJECT<`x``:y`: DOUBLE>>, "
                     "big: DECIMAL(20,0), frac: DECIMAL(3,1), none: VOID, mixed: VARIANT, empty: OBJECT<>>")
    assert t.names == ["VOID", "VARIANT", "a-b", "big", "frac", "none", "mixed"]
    assert t["a-b"].dataType == ArrayType(StructType().add("x`:y", DoubleType()))
    assert t["big"].dataType == DecimalType(20, 0) and t["frac"].dataType == DoubleType()
    assert t["VOID"].dataType == LongType() and t["mixed"].dataType == StringType()
    assert variant_type(None) is variant_type("VOID") is variant_type("OBJECT<>") is None


def test_good_bad_and_scalar_texts_side_by_side(spark):
    texts = ['{"id":1,"a":2}', "5", '"x"', "true", "{broken", '[{"id":2},{"id":3,"a":4}]', None, "", "[1,2]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    got = sorted(((r.n, r.id, r.a, r._corrupt_record) for r in parse_json_column(df, "t").collect()), key=str)
    assert {g for g in got if g[1]} == {(0, 1, 2, None), (5, 2, None, None), (5, 3, 4, None)}
    assert {(g[0], g[3]) for g in got if g[3]} == {(1, "5"), (2, '"x"'), (3, "true"), (4, "{broken"), (8, "[1,2]")}


def test_mixed_objects_and_arrays_lose_no_row(spark):
    df = spark.createDataFrame([(1, '{"k":1}'), (2, '[{"k":2},{"m":"x"}]'), (3, "nope"), (4, None), (5, '{"k":5}')],
                               "id int, j string")
    got = sorted((r.parent_id, r.k, r.m) for r in flatten(df, "id", "m")["m_j"].collect() if r.k)
    assert got == [(1, 1, None), (2, 2, None), (5, 5, None)]
    assert flatten(df, "id", "m")["m_j"].count() == 4
    deep = spark.createDataFrame([(1, [('{"k":1}',), ('[{"k":2}]',)])], "id int, a array<struct<j:string>>")
    assert sorted(r.k for r in flatten(deep, "id", "m")["m_a_j"].collect()) == [1, 2]


def test_big_integers_stay_exact(spark):
    a, b = 12345678901234567890, 12345678901234567891
    df = spark.createDataFrame([(1, f'{{"k":{a}}}'), (2, f'{{"k":{b}}}')], "id int, j string")
    assert sorted(int(r.k) for r in flatten(df, "id", "m")["m_j"].collect()) == [a, b]


def test_names_that_look_like_types_and_empty_objects(spark):
    df = spark.createDataFrame([(1, '{"VOID":1,"VARIANT":2,"e":{},"OBJECT":{"ARRAY":3}}')], "id int, j string")
    t = flatten(df, "id", "m")
    assert set(t) == {"m", "m_j", "m_j_object"}
    assert [(r.VOID, r.VARIANT) for r in t["m_j"].collect()] == [(1, 2)]


def test_keys_that_differ_in_case_stay_text(spark):
    df = spark.createDataFrame([(1, '{"A":1,"a":2}', '{"k":1}')], "id int, j string, ok string")
    assert set(infer_json_schemas(df)) == {"ok"}
    t = flatten(df, "id", "m")
    assert set(t) == {"m", "m_ok"} and t["m"].first().j == '{"A":1,"a":2}'


def test_corrupt_texts_go_to_a_side_table_once(spark, tmp_path):
    name = f"corrupt_{uuid.uuid4().hex[:8]}"
    texts = [json.dumps({"id": i, "arr": [{"k": i}]}) for i in range(5)] + ["5", "{broken", "{broken"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cfg = IngestConfig(table=name, id_field="id", location=str(tmp_path), options=FlattenOptions(promote_json=False))
    for _ in range(2):
        written = ingest_json_column(df, "t", cfg)
        assert written == [name, f"{name}_arr", f"{name}_corrupt"]
        assert spark.table(name).count() == 5
        assert spark.table(name).where(F.col("id").isNull()).count() == 0
        assert sorted(r._corrupt_record for r in spark.table(f"{name}_corrupt").collect()) == ["5", "{broken"]
