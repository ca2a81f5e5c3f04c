import os
import uuid

import pytest
from pyspark.sql import functions as F

from shredkit.config import FlattenOptions, IngestConfig
from shredkit.operators import (
    append_table,
    create_table,
    ingest_batch,
    merge_upsert,
    save_table,
    table_exists,
    upsert_table,
)
from shredkit.operators.upsert import DuplicateKeyError, dedup_source
from shredkit.plans.flatten import flatten
from shredkit.plans.schema import Mapping, align_schema, missing_fields, project_mapping
from shredkit.session import scratch_path


def _name(p):
    return f"{p}_{uuid.uuid4().hex[:8]}"


def test_merge_null_keys_never_match(spark):
    t = spark.createDataFrame([(None, "old"), (1, "old")], "k int, v string")
    s = spark.createDataFrame([(None, "new"), (1, "new")], "k int, v string")
    got = sorted((r.k if r.k is not None else -1, r.v) for r in merge_upsert(t, s, ["k"]).collect())
    assert got == [(-1, "new"), (-1, "old"), (1, "new")]


def test_duplicate_source_keys(spark):
    s = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "x", 1), (None, "y", 1)],
                              "k int, v string, ts int")
    with pytest.raises(DuplicateKeyError):
        dedup_source(s, ["k"], "error")
    latest = dedup_source(s, ["k"], "latest", latest_by="ts")
    assert sorted((r.k or -1, r.v) for r in latest.collect()) == [(-1, "x"), (-1, "y"), (1, "b")]


def test_align_is_case_insensitive_and_null_fills(spark):
    target = spark.createDataFrame([], "name string, n int, extra double").schema
    df = spark.createDataFrame([("a", 1)], "NAME string, n int")
    out = align_schema(df, target)
    assert out.columns == ["name", "n", "extra"]
    assert out.first().asDict() == {"name": "a", "n": 1, "extra": None}
    assert [f.name for f in missing_fields(target, df.schema)] == []


def test_project_mapping_missing_path_and_bad_timestamp(spark):
    df = spark.createDataFrame([("x", "bad", ["a"])], "WorkStatus string, pxUpdateDateTime string, h array<string>")
    m = [("WorkStatus", "WorkStatus", "STRING"), ("pxUpdateDateTime", "pxUpdateDateTime", "TIMESTAMP"),
         ("h", "CustomStageHistory", "ARRAY"), ("AppId", "AppId", "STRING")]
    r = project_mapping(df, m).first()
    assert r.WorkStatus == "x" and r.pxUpdateDateTime is None and r.AppId is None
    assert r.CustomStageHistory == ["a"]


def test_save_create_evolve_upsert(spark):
    name = _name("t_save")
    loc = scratch_path(spark, "tables")
    b1 = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    save_table(b1, name, ["id"], file_key="f1", location=loc)
    assert table_exists(spark, name)
    b2 = spark.createDataFrame([(2, "B", 1.5), (3, "c", 2.5)], "id bigint, v string, w double")
    save_table(b2, name, ["id"], file_key="f2", location=loc)
    got = sorted(tuple(r) for r in spark.table(name).select("id", "v", "w", "filekey").collect())
    assert got == [(1, "a", None, "f1"), (2, "B", 1.5, "f2"), (3, "c", 2.5, "f2")]


def test_case_change_between_batches_keeps_data(spark):
    name = _name("t_case")
    loc = scratch_path(spark, "tables")
    save_table(spark.createDataFrame([(1, "a")], "id bigint, name string"), name, ["id"], location=loc)
    save_table(spark.createDataFrame([(2, "b")], "id bigint, NAME string"), name, ["id"], location=loc)
    t = spark.table(name)
    assert "name" in t.columns and "NAME" not in [c for c in t.columns if c != "name"]
    assert sorted(tuple(r) for r in t.select("id", "name").collect()) == [(1, "a"), (2, "b")]


def test_incompatible_type_raises(spark):
    name = _name("t_type")
    loc = scratch_path(spark, "tables")
    save_table(spark.createDataFrame([(1, 5)], "id bigint, n int"), name, ["id"], location=loc)
    with pytest.raises(TypeError):
        save_table(spark.createDataFrame([(2, "x")], "id bigint, n array<int>"), name, ["id"],
                   location=loc)


def test_append_with_new_column(spark):
    name = _name("t_app")
    loc = scratch_path(spark, "tables")
    create_table(spark.createDataFrame([(1, "a")], "id bigint, v string"), name, "id", location=loc)
    append_table(spark.createDataFrame([(2, "b", 7)], "id bigint, v string, z int"), name)
    got = sorted(tuple(r) for r in spark.table(name).select("id", "v", "z").collect())
    assert got == [(1, "a", None), (2, "b", 7)]


def test_date_partition_and_bad_date(spark):
    name = _name("t_date")
    loc = scratch_path(spark, "tables")
    df = spark.createDataFrame([(1, "20240102T030405.678 GMT"), (2, "bad")], "id bigint, d string")
    save_table(df, name, ["id"], date_field="d", date_format="yyyyMMdd'T'HHmmss.SSS 'GMT'",
               location=loc)
    rows = {r.id: r for r in spark.table(name).collect()}
    assert rows[2].d is None
    assert str(rows[1].d) == "2024-01-02 03:04:05.678000"
    assert "d_day" not in spark.table(name).columns  # the layout stays out of sight


def test_ingest_twice_is_idempotent(spark):
    import json

    from shredkit.sources.json import parse_json_column

    docs = [{"id": 1, "items": [{"k": 1}, {"k": 2}], "s": {"a": "x"}}, {"id": 2, "items": [{"k": 3}]}]
    df = parse_json_column(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string"),
                           "doc", keep_corrupt=False)
    name = _name("t_ing")
    cfg = IngestConfig(table=name, id_field="id", location=scratch_path(spark, "tables"))
    first = ingest_batch(df, cfg)
    counts = {t: spark.table(t).count() for t in first}
    ingest_batch(df, cfg)
    assert {t: spark.table(t).count() for t in first} == counts
    assert counts == {name: 2, f"{name}_items": 3, f"{name}_s": 1}


def test_replace_children_drops_vanished_records(spark):
    import json

    from shredkit.config import FlattenOptions
    from shredkit.sources.json import parse_json_column

    def load(docs):
        return parse_json_column(
            spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string"), "doc",
            keep_corrupt=False)

    name = _name("t_rep")
    cfg = IngestConfig(table=name, id_field="id", location=scratch_path(spark, "tables"),
                       replace_children=True, options=FlattenOptions(promote_json=False))
    ingest_batch(load([{"id": 1, "items": [{"k": 1}, {"k": 2}]}]), cfg)
    ingest_batch(load([{"id": 1, "items": [{"k": 5}]}]), cfg)
    assert [r.k for r in spark.table(f"{name}_items").collect()] == [5]


def test_old_versions_are_dropped_with_their_files(spark):
    name = _name("t_snap")
    loc = scratch_path(spark, "tables")
    for i in range(4):
        save_table(spark.createDataFrame([(1, f"v{i}")], "id bigint, v string"), name, ["id"],
                   location=loc)
    assert [r.v for r in spark.table(name).collect()] == ["v3"]
    # one row, so one file a version: the current and the previous one; older ones are gone
    assert len(_files(loc)) == 2


def test_key_set_bytes_bounds_the_keys(spark):
    from shredkit.operators.upsert import key_set_bytes

    df = spark.createDataFrame([(1, "abc"), (2, "de")], "id bigint, h string")
    assert key_set_bytes(df, ["id", "h"]) == 2 * (16 + 8 + 4 * 3)
    t = spark.createDataFrame([(1, "x"), (3, "y")], "id bigint, h string")
    plan = merge_upsert(t, df, ["id"], broadcast_keys=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_empty_batch_and_json_column_ingest(spark):
    from shredkit.operators import ingest_json_column

    name = _name("t_json")
    cfg = IngestConfig(table=name, id_field="id", location=scratch_path(spark, "tables"))
    empty = spark.createDataFrame([], "id bigint, items array<struct<k:int>>")
    assert ingest_batch(empty, cfg) == []
    assert not table_exists(spark, name)
    texts = spark.createDataFrame([('[{"id": 1, "tags": ["a", "b"]}, {"id": 2, "tags": []}]',)], "doc string")
    assert ingest_json_column(texts, "doc", cfg) == [name, f"{name}_tags"]
    assert sorted((r.parent_id, r.value) for r in spark.table(f"{name}_tags").collect()) == [(1, "a"), (1, "b")]


def test_non_recursive_mode_saves_the_nested_frame(spark):
    name = _name("t_flat")
    cfg = IngestConfig(table=name, id_field="id", use_recursive=False,
                       location=scratch_path(spark, "tables"))
    df = spark.createDataFrame([(1, [(1, "a")])], "id bigint, arr array<struct<k:int,v:string>>")
    assert ingest_batch(df, cfg) == [name]
    r = spark.table(name).first()
    assert r.arr[0].v == "a" and r.filekey == "default_file_path"


def test_command_line_ingest(spark, tmp_path):
    from shredkit.__main__ import main

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('[{"doc_id": 1, "tags": ["a", "b"]}]')
    name = _name("cli")
    assert main(["ingest", str(src), "--table", name, "--id", "doc_id",
                 "--location", scratch_path(spark, "tables")]) == 0
    assert sorted(r.value for r in spark.table(f"{name}_tags").collect()) == ["a", "b"]


def test_save_keeps_latest_duplicate(spark):
    name = _name("t_latest")
    df = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 1)], "id bigint, v string, ts int")
    save_table(df, name, ["id"], on_duplicate="latest", latest_by="ts",
               location=scratch_path(spark, "tables"))
    assert sorted((r.id, r.v) for r in spark.table(name).collect()) == [(1, "new"), (2, "x")]


def test_catalog_path_choice(spark):
    from shredkit.operators.tables import _is_v2

    assert not _is_v2(spark, "db.t")
    assert not _is_v2(spark, "spark_catalog.db.t")
    assert not _is_v2(spark, "nocat.db.t")
    spark.conf.set("spark.sql.catalog.lake", "org.example.Catalog")
    try:
        assert _is_v2(spark, "lake.db.t")
    finally:
        spark.conf.unset("spark.sql.catalog.lake")


def test_children_append_only(spark):
    import json

    from shredkit.config import FlattenOptions
    from shredkit.sources.json import parse_json_column

    def load(docs):
        return parse_json_column(
            spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string"), "doc",
            keep_corrupt=False)

    name = _name("t_app_only")
    base = dict(table=name, id_field="id", location=scratch_path(spark, "tables"),
                children_append_only=True, options=FlattenOptions(promote_json=False))
    ingest_batch(load([{"id": 1, "items": [{"k": 1}, {"k": 2}]}]), IngestConfig(file_path="f1", **base))
    ingest_batch(load([{"id": 1, "items": [{"k": 2}, {"k": 3}]}]), IngestConfig(file_path="f2", **base))
    got = sorted((r.k, r.filekey) for r in spark.table(f"{name}_items").collect())
    assert got == [(1, "f1"), (2, "f1"), (3, "f2")]
    assert [r.filekey for r in spark.table(name).collect()] == ["f2"]  # main is still upserted


def test_a_small_batch_neither_shuffles_nor_rewrites_the_table(spark):
    from shredkit.operators.tables import _known_keys

    name = _name("t_big")
    loc = scratch_path(spark, "tables")
    table = spark.range(5000).select(F.col("id").alias("parent_id"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash_id"))
    keys = ["parent_id", "content_hash_id"]
    save_table(table, name, keys, location=loc, append_only=True)
    before = {f: os.path.getmtime(f) for f in _files(loc)}
    batch = table.where("parent_id < 2").unionByName(spark.createDataFrame([(9001, "new"), (9002, "new")], table.schema))
    known = _known_keys(batch, name, keys, 1 << 20)
    plan = known._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan parquet"):]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert "_shredkit_bucket" in scan[scan.index("PartitionFilters"):][:300]
    save_table(batch, name, keys, location=loc, append_only=True)
    assert spark.table(name).count() == 5002
    after = {f: os.path.getmtime(f) for f in _files(loc)}
    assert all(after.get(f) == t for f, t in before.items())


def _files(root):
    return [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")]


def test_latest_keeps_rows_without_a_date(spark):
    df = spark.createDataFrame([(1, "keep", None), (2, "x", None), (2, "y", 5), (3, "a", 7), (3, "b", 7)],
                               "id int, v string, at int")
    got = sorted(tuple(r) for r in dedup_source(df, ["id"], "latest", "at").collect())
    assert got == [(1, "keep", None), (2, "y", 5), (3, "b", 7)]


def test_assignment_casts_and_equal_array_types(spark):
    name = _name("t_cast")
    loc = scratch_path(spark, "tables")
    first = spark.range(4).groupBy((F.col("id") % 2).alias("k")).agg(
        F.collect_list("id").alias("ids"), F.lit("a").alias("note"))
    save_table(first, name, ["k"], location=loc)
    save_table(first, name, ["k"], location=loc)  # the same frame again
    save_table(spark.createDataFrame([(5, 77)], "k bigint, note bigint"), name, ["k"], location=loc)
    assert {r.k: r.note for r in spark.table(name).collect()} == {0: "a", 1: "a", 5: "77"}
    with pytest.raises(TypeError):
        save_table(spark.createDataFrame([(5, "x")], "k bigint, ids string"), name, ["k"], location=loc)


def test_append_creates_an_absent_table(spark):
    name = _name("t_new")
    append_table(spark.createDataFrame([(1, "a")], "id int, v string"), name)
    append_table(spark.createDataFrame([(2, "b")], "id int, v string"), name)
    assert sorted(r.v for r in spark.table(name).collect()) == ["a", "b"]


def test_user_columns_named_like_layout_and_managed_ones(spark):
    name = _name("t_user")
    loc = scratch_path(spark, "tables")
    df = spark.createDataFrame([(1, 99, "d")], "id int, _bucket int, at_day string")
    save_table(df, name, ["id"], location=loc)
    assert spark.table(name).drop("filekey").first().asDict() == {"id": 1, "_bucket": 99, "at_day": "d"}
    doc = spark.createDataFrame([(1, [("mine", "f", "x")])],
                                "id int, a array<struct<parent_id_hash_col:string,filekey:string,v:string>>")
    t = flatten(doc, "id", "m", FlattenOptions(promote_json=False))["m_a"]
    assert t.first()._parent_id_hash_col == "mine" and t.first()._filekey == "f"


def test_names_of_one_two_and_three_parts(spark):
    from shredkit.functions.names import quote_name, split_name
    from shredkit.operators.tables import _is_v2, qualified_name, table_names

    assert split_name("a.`b.c`.d") == ["a", "b.c", "d"] and quote_name("a.`b.c`") == "`a`.`b.c`"
    spark.conf.set("spark.sql.catalog.lake", "not.loaded.Here")
    try:
        assert _is_v2(spark, qualified_name("t", "lake")) and _is_v2(spark, "lake.db.t")
        assert not _is_v2(spark, "t") and not _is_v2(spark, "db.t") and not _is_v2(spark, "spark_catalog.db.t")
        assert table_names(spark, "lake.m", ["lake.m", "lake.m_x.y"]) == {"lake.m": "`lake`.`m`", "lake.m_x.y": "`lake`.`m_x.y`"}
        with pytest.raises(ValueError, match="replace_keys"):
            upsert_table(spark.range(1), "lake.db.t", ["id"], replace_keys=["id"])
    finally:
        spark.conf.unset("spark.sql.catalog.lake")
    assert table_names(spark, "db.m", ["db.m", "db.m_a-b"]) == {"db.m": "`db`.m", "db.m_a-b": "`db`.m_a_b"}
    with pytest.raises(ValueError, match="clash"):
        table_names(spark, "m", ["m", "m_a-b", "m_a.b"])


def test_main_dedup_compares_maps(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 1}), (1, {"a": 3})], "id int, m map<string,int>")
    t = flatten(df, "id", "m", FlattenOptions(promote_json=False, dedup_main=True))["m"]
    assert t.count() == 2


def test_identical_root_array_elements_ingest(spark):
    from pyspark.sql import Row

    name = _name("t_root")
    df = spark.createDataFrame([([Row(k=1), Row(k=1), Row(k=2)],)], "a array<struct<k:int>>")
    cfg = IngestConfig(table=name, id_field=None, location=scratch_path(spark, "tables"),
                       options=FlattenOptions(promote_json=False))
    ingest_batch(df, cfg)
    assert sorted(r.k for r in spark.table(name).collect()) == [1, 2]


def test_mapping_of_document_dates_bad_values_and_arrays(spark):
    df = spark.createDataFrame([("20240102T030405.678 GMT", "abc", [("x",), ("y",)])],
                               "d string, n string, recs array<struct<v:string>>")
    r = project_mapping(df, [Mapping("d", "at", "TIMESTAMP"), Mapping("n", "n", "INT"),
                             Mapping("recs.v", "vs", "ARRAY"), Mapping("recs.none", "none", "STRING")]).first()
    assert str(r["at"]) == "2024-01-02 03:04:05.678000" and r.n is None and r.vs == ["x", "y"] and r.none is None


def test_hex_text_is_trimmed_and_not_cut(spark):
    from shredkit.functions import decode_hex

    df = spark.createDataFrame([("\t\x01pre48 \r\n\t656C6C6F\n\n",)], "h string")
    assert bytes(df.select(decode_hex(F.col("h"), 3)).first()[0]) == b"Hello"


def test_files_are_sorted_by_the_bucket_column(spark):
    import pyarrow.parquet as pq

    name = _name("t_sorted")
    loc = scratch_path(spark, "tables")
    rows = spark.range(400).select((F.col("id") * 7919 % 400).alias("id"), F.lit("x").alias("v"))
    create_table(rows.where("id < 300"), name, "id", location=loc)
    append_table(rows.where("id >= 300"), name)
    files = _files(loc)
    ids = [pq.ParquetFile(f).read(["id"])["id"].to_pylist() for f in files]
    assert sorted(i for x in ids for i in x) == list(range(400))
    assert all(x == sorted(x) for x in ids)
