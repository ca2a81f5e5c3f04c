"""Edge rows (FIXTURES.md section 4) through ``flatten``."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from shredkit import FlattenOptions, flatten
from shredkit.sources.json import parse_json_column


def _docs(spark, *objs):
    df = spark.createDataFrame([(json.dumps(o),) for o in objs], "doc string")
    return parse_json_column(df, "doc", keep_corrupt=False)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_main_and_children(spark):
    d = _docs(spark, {"id": 1, "name": "a", "s": {"x": 1, "y": "p"}, "arr": [{"k": 1}, {"k": 2}],
                      "vals": [3, 4]})
    t = flatten(d, "id", "m")
    assert list(t) == ["m", "m_arr", "m_s", "m_vals"]
    assert set(t["m"].columns) == {"id", "name", "id_hash_col"}
    assert rows(t["m_arr"], "parent_id", "k") == [(1, 1), (1, 2)]
    assert rows(t["m_s"], "parent_id", "x", "y") == [(1, 1, "p")]
    assert rows(t["m_vals"], "parent_id", "value") == [(1, 3), (1, 4)]
    for name in ("m_arr", "m_s", "m_vals"):
        assert {"content_hash_id", "parent_id_hash_col"} <= set(t[name].columns)


def test_null_struct_gives_no_row_and_inner_same_name_kept(spark):
    df = spark.createDataFrame([(1, None), (2, Row(a=None, q="y"))], "id int, a struct<a:string,q:string>")
    t = flatten(df, "id", "m", FlattenOptions(promote_json=False))
    assert rows(t["m_a"], "parent_id", "q") == [(2, "y")]


def test_null_and_empty_arrays_and_null_elements(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1, None]), (4, [1, 1])], "id int, v array<int>")
    t = flatten(df, "id", "m")
    assert rows(t["m_v"], "parent_id", "value") == [(3, 1), (4, 1)]
    t2 = flatten(df, "id", "m", FlattenOptions(keep_ordinal=True))
    assert rows(t2["m_v"], "parent_id", "value") == [(3, 1), (4, 1), (4, 1)]


def test_only_nested_record_gets_row_index(spark):
    d = _docs(spark, {"id": 7, "r": [{"x": {"k": 1}}, {"x": {"k": 2}}]})
    t = flatten(d, "id", "m")
    assert rows(t["m_r"], "parent_id", "_row_idx") == [(7, 1), (7, 2)]
    assert rows(t["m_r_x"], "parent_id", "k") == [(7, 1), (7, 2)]


def test_row_index_spreads_large_parent(spark):
    import importlib

    fl = importlib.import_module("shredkit.plans.flatten")

    n = fl.ROW_INDEX_CHUNK * 2 + 5
    df = spark.range(n).select(F.lit(1).alias("id"), F.struct(F.struct(F.col("id").alias("k")).alias("x")).alias("r"))
    docs = df.groupBy("id").agg(F.collect_list("r").alias("r"))
    t = flatten(docs, "id", "m", FlattenOptions(promote_json=False))["m_r"]
    got = [r[0] for r in t.select("_row_idx").collect()]
    assert sorted(got) == list(range(1, n + 1))


def test_single_array_wrapper_keeps_root_id(spark):
    d = _docs(spark, {"id": 5, "w": {"items": [{"k": 1}]}})
    t = flatten(d, "id", "m")
    assert rows(t["m_w_items"], "parent_id", "k") == [(5, 1)]


def test_root_array_of_scalars(spark):
    df = spark.createDataFrame([([1, 2],)], "a array<int>")
    t = flatten(df, None, "m")
    assert rows(t["m"], "value") == [(1,), (2,)]


def test_root_array_of_records_is_keyed_by_content(spark):
    df = spark.createDataFrame([([Row(k=1, v="a"), Row(k=2, v="b")],)], "a array<struct<k:int,v:string>>")
    t = flatten(df, None, "m")
    got = t["m"].collect()
    assert sorted((r.k, r.v) for r in got) == [(1, "a"), (2, "b")]
    again = flatten(df, None, "m")["m"].collect()
    assert sorted(r.parent_id for r in got) == sorted(r.parent_id for r in again)


def test_mixed_json_text(spark):
    df = spark.createDataFrame([(1, '{"k":1}'), (2, "nope"), (3, None), (4, '{"k":3}')], "id int, j string")
    t = flatten(df, "id", "m")
    assert rows(t["m_j"], "parent_id", "k") == [(1, 1), (4, 3)]
    assert "j" in t["m"].columns  # the raw text stays in the parent table


def test_json_array_of_records_and_of_text(spark):
    df = spark.createDataFrame([(1, '[{"k":2},{"k":3}]', '["a:b","c"]')], "id int, j string, t string")
    t = flatten(df, "id", "m")
    assert rows(t["m_j"], "parent_id", "k") == [(1, 2), (1, 3)]
    assert rows(t["m_t"], "parent_id", "value") == [(1, "a:b"), (1, "c")]


def test_quoted_names_and_inner_parent_id(spark):
    d = _docs(spark, {"id": 1, "a-b": 3, "x.y": {"parent_id": 2, "c-d": "z"}})
    t = flatten(d, "id", "m")
    assert rows(t["m"], "a-b") == [(3,)]
    child = t["m_x.y"]
    assert rows(child, "parent_id", "_parent_id", "c-d") == [(1, 2, "z")]


def test_map_column_stays_in_main(spark):
    df = spark.createDataFrame([(1, {"a": 1})], "id int, m map<string,int>")
    t = flatten(df, "id", "t")
    assert list(t) == ["t"]
    assert "m" in t["t"].columns


def test_name_collision_raises(spark):
    d = _docs(spark, {"id": 1, "a_b": [1], "a": {"b": [2]}})
    d = d.select("id", "a_b", "a")
    with pytest.raises(ValueError, match="same child table"):
        flatten(d, "id", "m")


def test_two_levels_use_root_id(spark):
    d = _docs(spark, {"id": 9, "o": [{"ok": 1, "it": [{"q": 5}, {"q": 6}]}, {"ok": 2, "it": [{"q": 5}]}]})
    t = flatten(d, "id", "m")
    assert rows(t["m_o_it"], "parent_id", "q") == [(9, 5), (9, 6)]  # set per root id


def test_max_depth(spark):
    d = _docs(spark, {"id": 1, "o": [{"it": [{"q": 1}]}]})
    t = flatten(d, "id", "m", FlattenOptions(max_depth=1))
    assert list(t) == ["m", "m_o"]


def test_include_list(spark):
    d = _docs(spark, {"id": 1, "a": [{"x": 1, "b": [{"y": 2}]}], "c": {"z": 3}})
    t = flatten(d, "id", "m", FlattenOptions(include=("a.b",)))
    assert list(t) == ["m", "m_a", "m_a_b"]
    assert rows(t["m_a_b"], "parent_id", "y") == [(1, 2)]


def test_skip_empty_drops_empty_children(spark):
    df = spark.createDataFrame([(1, [], None)], "id int, a array<int>, s struct<x:int>")
    t = flatten(df, "id", "m", FlattenOptions(skip_empty=True, promote_json=False))
    assert list(t) == ["m"]


def test_map_inside_child_records(spark):
    df = spark.createDataFrame([(1, [(1, {"a": 1}), (1, {"a": 1})])],
                               "id int, arr array<struct<k:int,m:map<string,int>>>")
    t = flatten(df, "id", "m", FlattenOptions(promote_json=False, dedup_main=True))
    got = t["m_arr"].collect()
    assert len(got) == 1 and got[0].m == {"a": 1}
    assert t["m"].count() == 1


def test_json_in_json_is_promoted_level_by_level(spark):
    inner = json.dumps({"b": 1})
    outer = json.dumps({"a": inner, "c": 5})
    df = spark.createDataFrame([(1, outer)], "id int, j string")
    t = flatten(df, "id", "m")
    assert list(t) == ["m", "m_j", "m_j_a"]
    assert rows(t["m_j"], "parent_id", "a", "c") == [(1, inner, 5)]
    assert rows(t["m_j_a"], "parent_id", "b") == [(1, 1)]
