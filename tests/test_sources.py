import os

import pytest
from pyspark.sql import functions as F

from shredkit.functions.names import snake_case, snake_case_str
from shredkit.session import scratch_path
from shredkit.sources import decode_hex_column, parse_json_column, read_hex_files, read_json_files


def test_multiline_json_file_with_top_level_array(spark):
    d = scratch_path(spark, "j")
    os.makedirs(d)
    with open(os.path.join(d, "a.json"), "w") as fh:
        fh.write('[\n {"id": 1, "x": {"k": 1}},\n {"id": 2, "x": {"k": 2}}\n]\n')
    df = read_json_files(spark, d)
    assert sorted(r.id for r in df.collect()) == [1, 2]
    whole = read_json_files(spark, d, wholetext=True)
    assert sorted(r.id for r in whole.collect()) == [1, 2]


def test_parse_json_column_keeps_corrupt_text(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "oops")], "n int, doc string")
    out = {r.n: r for r in parse_json_column(df, "doc").collect()}
    assert out[1].a == 1 and out[1]._corrupt_record is None
    assert out[2].a is None and out[2]._corrupt_record == "oops"


def test_hex_decoding(spark):
    df = spark.createDataFrame([("4F4B\n  21 ",), ("4F4",)], "h string")
    ok = decode_hex_column(df.where(F.length("h") > 3), "h").first().h
    assert bytes(ok) == b"OK!"
    with pytest.raises(Exception):
        decode_hex_column(df.where(F.length("h") == 3), "h").collect()
    lenient = decode_hex_column(df.where(F.length("h") == 3), "h", strict=False).first().h
    assert lenient is None


def test_hex_files_with_prefix(spark):
    d = scratch_path(spark, "hex")
    os.makedirs(d)
    with open(os.path.join(d, "p.txt"), "w") as fh:
        fh.write("HDR:4142\n4344\n")
    r = read_hex_files(spark, d, prefix_len=4).first()
    assert bytes(r.payload) == b"ABCD"


def test_snake_case_forms_agree(spark):
    names = ["My-FileName", "orders.json", ".hidden", "ABCTable", "a--b", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = [r[0] for r in df.select(snake_case(F.col("s"))).collect()]
    assert got == [snake_case_str(n) for n in names]
    assert snake_case_str("My-FileName") == "my__file_name"


def test_catalog_conf_sets_one_kind():
    from shredkit.operators.tables import qualified_name
    from shredkit.session import table_catalog_conf

    glue = table_catalog_conf("cat", "glue", "s3://b/w")
    assert "spark.sql.catalog.cat.catalog-impl" in glue and "spark.sql.catalog.cat.type" not in glue
    path = table_catalog_conf("cat", "hadoop", "s3a://b/w")
    assert path["spark.sql.catalog.cat.type"] == "hadoop"
    assert "spark.sql.catalog.cat.catalog-impl" not in path
    assert qualified_name("My-Table.json", "cat", "db") == "cat.db.my__table"
    assert qualified_name(None, "cat") == "cat.main"


def test_mapping_file(spark, tmp_path):
    from shredkit.plans.schema import load_mappings, project_mapping

    path = tmp_path / "mapping.yaml"
    path.write_text(
        "orders:\n"
        "  - {sourcePath: id, targetColumn: order_id, dataType: BIGINT}\n"
        "  - {sourcePath: who.name, targetColumn: name, dataType: STRING}\n"
    )
    df = spark.createDataFrame([("7", ("x",))], "id string, who struct<name:string>")
    r = project_mapping(df, load_mappings(str(path))["orders"]).first()
    assert (r.order_id, r["name"]) == (7, "x")


# ------------------------------------------------------------------ documents beside bad ones


def _parsed(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    out = parse_json_column(df, "t", **options)
    return out.columns, sorted((r.asDict(recursive=True) for r in out.collect()), key=lambda r: (r["n"], str(r)))


def test_case_only_keys_make_one_document_corrupt(spark):
    cols, rows = _parsed(spark, ['{"A":1,"a":2}', '{"id":7}'])
    assert [(r["n"], r.get("id"), r["_corrupt_record"]) for r in rows] == [(0, None, '{"A":1,"a":2}'), (1, 7, None)]


def test_case_variants_of_different_documents_are_one_column(spark):
    texts = ['{"Id": 1, "sub": {"K": 1}}', '{"id": 2, "sub": {"k": 2}, "s": "\\"id\\": {x"}', '{"ID" : 3}',
             '{"id": 4, "sub": {"K": 1, "k": 2}}', '[{"iD": 5}, {"id": 6, "ID": 7}]']
    cols, rows = _parsed(spark, texts)
    assert [c for c in cols if c.lower() == "id"] == ["ID"]
    assert [(r["n"], r["ID"], r["_corrupt_record"] is None) for r in rows] == [
        (0, 1, True), (1, 2, True), (2, 3, True), (3, None, False), (4, None, False)]
    assert rows[0]["sub"] == {"K": 1} and rows[1]["sub"] == {"K": 2} and rows[1]["s"] == '"id": {x'


def test_elements_that_are_no_documents_leave_the_others(spark):
    _, rows = _parsed(spark, ['[{"id":1}, 5, null, [1], {"id":2}]', '{"id":3}', "[1, 2]", '[{"id":4}', "null"])
    got = [(r["n"], r["id"], r["_corrupt_record"]) for r in rows]
    assert sorted(got, key=str) == sorted([
        (0, 1, None), (0, None, "5"), (0, None, "null"), (0, None, "[1]"), (0, 2, None), (1, 3, None),
        (2, None, "[1, 2]"), (3, None, '[{"id":4}'), (4, None, "null")], key=str)


def test_texts_without_documents(spark):
    _, rows = _parsed(spark, [None, "[]", '{"id": 1}', ""])
    assert [(r["n"], r["id"], r["_corrupt_record"]) for r in rows] == [(2, 1, None), (3, None, "")]
    _, rows = _parsed(spark, [None, "[]", '{"id": 1}'], keep_empty=True)
    assert [(r["n"], r["id"], r["_corrupt_record"]) for r in rows] == [(0, None, None), (1, None, None), (2, 1, None)]


def test_malformed_text_gives_no_child_row(spark):
    from shredkit.plans.flatten import flatten

    for more in ([], [(9, '[{"k": 5}]')]):  # an array elsewhere changes nothing
        df = spark.createDataFrame([(1, '{"k":1}'), (2, '{"k":'), (3, "{x:1}"), (4, None), *more], "id int, j string")
        got = sorted((r.parent_id, r.k) for r in flatten(df, "id", "m")["m_j"].collect())
        assert got == [(1, 1), *([(9, 5)] if more else [])]


# ------------------------------------------------------------------ maps


def test_objects_keyed_by_data_are_maps(spark):
    from shredkit.plans.flatten import flatten
    from shredkit.plans.jsoncols import infer_json_schemas

    n = 100_000
    texts = spark.range(n).select("id", F.format_string(
        '{"by_user": {"u%d": {"n": %d, "tags": {"t%d": 1.5}}}, "plain": {"a": 1}}', "id", "id", "id").alias("t"))
    out = parse_json_column(texts, "t")
    assert out.drop("id", "_corrupt_record").schema.simpleString() == (
        "struct<by_user:map<string,struct<n:bigint,tags:map<string,double>>>,plain:struct<a:bigint>>")
    r = out.where("id = 77777").first()
    assert r.by_user["u77777"].n == 77777 and r.by_user["u77777"].tags == {"t77777": 1.5}
    assert infer_json_schemas(texts, ["t"])["t"].simpleString() == (
        "struct<by_user:map<string,struct<n:bigint,tags:map<string,double>>>,plain:struct<a:bigint>>")
    few = flatten(texts.limit(50), "id", "m")
    assert "m_t_by_user_u1" in few or any(k.startswith("m_t_by_user_u") for k in few)  # few keys: records
    assert parse_json_column(texts.limit(50), "t", map_keys=5).schema["by_user"].dataType.typeName() == "map"


def test_merged_types_follow_the_reader(spark):
    from shredkit.plans.jsontypes import VOID, merge, read_tree, to_type

    def merged(*texts, limit=1000):
        out = VOID
        for t in texts:
            out = merge(out, read_tree(t), limit)
        return to_type(out).simpleString()

    assert merged("OBJECT<a: BIGINT>", "OBJECT<a: DECIMAL(3,1), b: VOID>") == "struct<a:double,b:string>"
    assert merged("DECIMAL(20,0)", "BIGINT") == "decimal(20,0)" and merged("BIGINT", "BOOLEAN") == "string"
    assert merged("ARRAY<VOID>", "ARRAY<OBJECT<`a b`: BIGINT>>") == "array<struct<a b:bigint>>"
    assert merged("OBJECT<a: BIGINT, b: BIGINT>", "OBJECT<c: STRING>", limit=2) == "map<string,string>"
    assert merged("OBJECT<a: BIGINT, b: BIGINT, c: BIGINT>", "OBJECT<d: DOUBLE>", limit=2) == "map<string,double>"


# ------------------------------------------------------------------ giant arrays


def _nasty(n):
    import random

    r = random.Random(3)

    def value(depth=0):
        kind = r.randrange(6)
        if kind == 0:
            return r.choice(["}{", 'a "q" \\ b', "][", "\\", '","', '{"a":1},', "é中 ", "", "\\\\"])
        if kind == 1:
            return r.randrange(1000)
        if kind == 2 and depth < 3:
            return [value(depth + 1) for _ in range(r.randrange(3))]
        if kind == 3 and depth < 3:
            return {f"k{i}": value(depth + 1) for i in range(r.randrange(3))}
        return r.choice([None, True, 1.5])

    import json
    return [{"id": i, "s": str(value(9)), "t": json.dumps(value())} for i in range(n)]


@pytest.mark.parametrize("indent,ascii_", [(None, False), (2, True)])
def test_a_giant_array_is_read_in_many_tasks(spark, indent, ascii_):
    import json

    from shredkit.sources import read_json_arrays

    d = scratch_path(spark, "arr")
    os.makedirs(d)
    docs = _nasty(1500)
    docs[17]["s"] = "x" * 20000 + '\\"}'  # a record longer than several blocks
    path = os.path.join(d, "a.json")
    with open(path, "w", encoding="utf-8") as fh:
        json.dump(docs, fh, indent=indent, ensure_ascii=ascii_)
    got = read_json_arrays(spark, path, block_bytes=4096)
    want = spark.read.option("multiLine", True).json(path)
    assert sorted(map(tuple, got.drop("_corrupt_record").collect())) == sorted(map(tuple, want.collect()))
    from shredkit.sources.arrays import _summaries
    from shredkit.session import scoped_conf
    with scoped_conf(spark, {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.maxPartitionBytes": "4096"}):
        cut = spark.read.option("lineSep", "}").text(path).select(
            "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
        assert cut.rdd.getNumPartitions() > 10
        assert cut.select("block").distinct().count() > 10
    assert _summaries  # the scan of every block is one summary


@pytest.mark.parametrize("block", [1, 2, 3, 5, 8, 13, 50, 1000])
def test_array_records_at_any_block_border(spark, block):
    import json

    from shredkit.sources import read_array_records

    d = scratch_path(spark, "arr")
    os.makedirs(d)
    docs = [{"a": "}", "b": [1, {"c": '"]}'}]}, 5, None, "}{", [{"id": 3}], {}, "x" * 60, '\\"']
    for name, text in (("a", json.dumps(docs)), ("b", " [\n ] \n"), ("c", "[" + json.dumps(docs[0]) + "]\n")):
        with open(os.path.join(d, f"{name}.json"), "w") as fh:
            fh.write(text)
    got = [json.loads(r.value) for r in read_array_records(spark, d, block_bytes=block).collect()]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, [*docs, docs[0]]))


# ------------------------------------------------------------------ JDBC


def test_jdbc_reader_finds_its_bounds(spark):
    import uuid

    from shredkit.sources import read_jdbc_query

    url = f"jdbc:derby:memory:bounds_{uuid.uuid4().hex[:8]};create=true"
    drv = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(500).select(
        F.when(F.col("id") % 10 != 0, F.col("id") * 3 - 400).alias("k"), (F.col("id") / 7).alias("x"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id)").alias("at"),
        F.expr("date'2024-01-01' + cast(id as int)").alias("day"), F.col("id").cast("string").alias("s"), F.lit(1).alias("one"))
    rows.write.format("jdbc").option("url", url).option("driver", drv).option("dbtable", "t").save()
    for column in ("k", "x", "at", "day", "one"):
        df = read_jdbc_query(spark, url, "SELECT * FROM t", drv, partition_column=column, num_partitions=4)
        assert sorted(map(str, df.collect())) == sorted(map(str, spark.read.format("jdbc").option("url", url).option(
            "driver", drv).option("dbtable", "t").load().collect())), column
        assert df.rdd.getNumPartitions() == {"k": 5, "one": 1}.get(column, 4)
    with pytest.raises(ValueError, match="numbers, dates"):
        read_jdbc_query(spark, url, "SELECT * FROM t", drv, partition_column="s", num_partitions=4)
    none = read_jdbc_query(spark, url, 'SELECT * FROM t WHERE "k" IS NULL', drv, partition_column="k", num_partitions=4)
    assert none.count() == 50
    assert read_jdbc_query(spark, url, 'SELECT * FROM t WHERE "k" > 9999', drv, partition_column="k").count() == 0
