"""Layers, merges of matched partitions, family commits, the stream ledger, nested evolution."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from shredkit.config import FlattenOptions, IngestConfig
from shredkit.operators import (
    append_table,
    evolve_schema,
    finish_commit,
    ingest_batch,
    ingest_json_column,
    save_table,
    stage_table,
    stream_ledger,
    upsert_table,
)
from shredkit.operators import tables as T
from shredkit.plans.schema import align_schema, nested_additions, widened_schema
from shredkit.session import scratch_path
from shredkit.sources.json import parse_json_column
from shredkit.streaming import ingest_text_stream, stream_key

NO_JSON = FlattenOptions(promote_json=False)


def _name(p):
    return f"{p}_{uuid.uuid4().hex[:8]}"


def _files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def _docs(spark, docs):
    texts = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")
    return parse_json_column(texts, "doc", keep_corrupt=False)


# ------------------------------------------------------------------ merge


def test_merge_leaves_untouched_partitions_alone(spark):
    name, loc = _name("t_part"), scratch_path(spark, "tables")
    save_table(spark.range(4000).select("id", F.lit("old").alias("v")), name, ["id"], location=loc)
    before = _files(loc)
    batch = spark.createDataFrame([(7, "new"), (5000, "new")], "id bigint, v string")
    save_table(batch, name, ["id"], location=loc)
    assert before <= _files(loc)  # the version before keeps its files
    dead = T.current_version(spark, name).dead
    hit = spark.createDataFrame([(7,)], "id bigint").select(T._bucket_of("id", 16)).first()[0]
    assert [(unit, version) for _, unit, version in dead] == [(str(hit), 2)]  # one bucket of 16 is rewritten
    rows = {r.id: r.v for r in spark.table(name).collect()}
    assert len(rows) == 4001 and rows[7] == rows[5000] == "new" and rows[8] == "old"
    save_table(batch, name, ["id"], location=loc)
    after = _files(loc)
    assert {f for f in before if f"{T.BUCKET}={hit}/" not in f} <= after
    assert not any(f"{T.BUCKET}={hit}/" in f for f in before & after)  # nobody reads it any more


def test_dead_partitions_are_pruned_not_filtered(spark):
    name, loc = _name("t_plan"), scratch_path(spark, "tables")
    save_table(spark.range(1000).select("id", F.lit("x").alias("v")), name, ["id"], location=loc)
    save_table(spark.createDataFrame([(1, "y")], "id bigint, v string"), name, ["id"], location=loc)
    v = T.current_version(spark, name)
    assert len(v.dead) == 1
    df = spark.table(name)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan.replace("PartitionFilters", "").replace("PushedFilters", "")
    gone = f"{T.LAYER}={v.dead[0][0]}/{T.BUCKET}={v.dead[0][1]}/"
    assert any(gone in f for f in _files(loc)) and not any(gone in f for f in df.inputFiles())
    some = v.rows(spark).where(T._among(v, [(v.dead[0][0], "0"), (v.dead[0][0], "1")]))
    assert {f.split(f"{T.BUCKET}=")[1].split("/")[0] for f in some.inputFiles()} <= {"0", "1"}


def test_dated_merge_touches_matched_days(spark):
    name, loc = _name("t_days"), scratch_path(spark, "tables")
    rows = [(i, f"2024010{1 + i % 5}T000000.000 GMT") for i in range(50)] + [(99, "bad")]
    form = dict(date_field="at", date_format="yyyyMMdd'T'HHmmss.SSS 'GMT'", location=loc)
    save_table(spark.createDataFrame(rows, "id bigint, at string"), name, ["id"], **form)
    assert {u for _, u in T.current_version(spark, name).partitions(spark)} == \
        {*(f"2024-01-0{d}" for d in range(1, 6)), "none"}
    # 3 moves from the 4th to the 9th of January; 99 gets a date
    new = [(3, "20240109T000000.000 GMT"), (99, "20240101T000000.000 GMT"), (100, "20240102T000000.000 GMT")]
    save_table(spark.createDataFrame(new, "id bigint, at string"), name, ["id"], **form)
    assert {u for _, u, _ in T.current_version(spark, name).dead} == {"2024-01-04", "none"}
    got = {r.id: str(r["at"])[:10] for r in spark.table(name).collect()}
    assert len(got) == 52 and got[3] == "2024-01-09" and got[99] == "2024-01-01" and got[8] == "2024-01-04"


def test_many_small_layers_are_merged(spark, monkeypatch):
    monkeypatch.setattr(T, "CROWDED", 3)
    name, loc = _name("t_crowd"), scratch_path(spark, "tables")
    for i in range(7):
        save_table(spark.createDataFrame([(i, "v")], "id bigint, v string"), name, ["id"], location=loc, buckets=1)
    v = T.current_version(spark, name)
    shown = set(v.partitions(spark)) - {d[:2] for d in v.dead}
    assert len(shown) <= 3
    assert sorted(r.id for r in spark.table(name).collect()) == list(range(7))


def test_a_write_that_never_committed_is_not_seen(spark):
    name, loc = _name("t_lost"), scratch_path(spark, "tables")
    base = spark.createDataFrame([(1, "a")], "id bigint, v string")
    save_table(base, name, ["id"], location=loc)
    more = spark.createDataFrame([(1, "b"), (2, "b")], "id bigint, v string")
    stage_table(more, name, ["id"], location=loc)  # and the process dies
    assert [(r.id, r.v) for r in spark.table(name).collect()] == [(1, "a")]
    save_table(spark.createDataFrame([(3, "c")], "id bigint, v string"), name, ["id"], location=loc)
    assert sorted((r.id, r.v) for r in spark.table(name).collect()) == [(1, "a"), (3, "c")]
    assert len({layer for layer, _ in T.current_version(spark, name).partitions(spark)}) == 2


# ------------------------------------------------------------------ family


def _family(spark, name):
    return (sorted((r.id, r.v) for r in spark.table(name).collect()),
            sorted((r.parent_id, r.k) for r in spark.table(f"{name}_items").collect()))


FIRST = [{"id": 1, "v": "a", "items": [{"k": 1}]}]
SECOND = [{"id": 1, "v": "b", "items": [{"k": 2}]}, {"id": 2, "v": "b", "items": [{"k": 3}]}]
OLD = ([(1, "a")], [(1, 1)])
NEW = ([(1, "b"), (2, "b")], [(1, 1), (1, 2), (2, 3)])


class Killed(Exception):
    pass


@pytest.mark.parametrize("at", ["second write", "record", "first switch", "second switch", "record dropped"])
def test_a_killed_ingest_leaves_one_family(spark, monkeypatch, at):
    name = _name("t_fam")
    cfg = IngestConfig(table=name, id_field="id", location=scratch_path(spark, "tables"), options=NO_JSON)
    ingest_batch(_docs(spark, FIRST), cfg)
    calls = {"write": 0, "switch": 0}
    write, switch, sql = T._write_layer, T._switch, type(spark).sql

    def dying_write(*a, **k):
        calls["write"] += 1
        if at == "second write" and calls["write"] == 2:
            raise Killed
        return write(*a, **k)

    def dying_switch(*a, **k):
        calls["switch"] += 1
        if at == "first switch" and calls["switch"] == 1 or at == "second switch" and calls["switch"] == 2:
            raise Killed
        return switch(*a, **k)

    def dying_sql(self, text, *a, **k):
        if at == "record" and "__commit" in text and "CREATE" in text or at == "record dropped" and "DROP VIEW" in text:
            raise Killed
        return sql(self, text, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(T, "_write_layer", dying_write)
        m.setattr(T, "_switch", dying_switch)
        m.setattr(type(spark), "sql", dying_sql)
        with pytest.raises(Killed):
            ingest_batch(_docs(spark, SECOND), cfg)
    committed = at not in ("second write", "record")
    if not committed:
        assert _family(spark, name) == OLD  # readers stay on the old family
    assert finish_commit(spark, name) is committed
    assert _family(spark, name) == (NEW if committed else OLD)
    ingest_batch(_docs(spark, SECOND), cfg)  # the rerun
    assert _family(spark, name) == NEW
    assert not finish_commit(spark, name)


def test_the_next_ingest_finishes_a_commit(spark, monkeypatch):
    name = _name("t_next")
    cfg = IngestConfig(table=name, id_field="id", location=scratch_path(spark, "tables"), options=NO_JSON)
    ingest_batch(_docs(spark, FIRST), cfg)
    with monkeypatch.context() as m:
        m.setattr(T, "_switch", lambda *a: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            ingest_batch(_docs(spark, SECOND), cfg)
    assert _family(spark, name) == OLD
    ingest_batch(_docs(spark, [{"id": 3, "v": "c", "items": [{"k": 9}]}]), cfg)
    assert _family(spark, name) == (NEW[0] + [(3, "c")], NEW[1] + [(3, 9)])


# ------------------------------------------------------------------ ledger


def test_a_replayed_batch_changes_nothing(spark):
    name = _name("t_replay")
    cfg = IngestConfig(table=name, id_field="id", location=scratch_path(spark, "tables"), options=NO_JSON,
                       on_duplicate="allow")
    texts = spark.createDataFrame([('{"id": 1, "items": [{"k": 1}]}',), ('{"id": null, "items": [{"k": 2}]}',),
                                   ('{"v": "no id"}',), ("{broken",), ("5",)], "t string")
    tables = [name, f"{name}_items", f"{name}_corrupt"]
    assert ingest_json_column(texts, "t", cfg, {"s": 0}) == tables
    counts = {t: spark.table(t).count() for t in tables}
    assert counts == {name: 3, f"{name}_items": 2, f"{name}_corrupt": 2}
    assert ingest_json_column(texts, "t", cfg, {"s": 0}) == []  # replayed
    assert {t: spark.table(t).count() for t in tables} == counts
    assert all(stream_ledger(spark, t) == {"s": 0} for t in tables)
    ingest_json_column(texts.limit(0).unionByName(spark.createDataFrame([('{"id": 9}',)], "t string")), "t", cfg, {"s": 1})
    assert stream_ledger(spark, name) == {"s": 1} and spark.table(name).count() == 4
    assert ingest_json_column(texts, "t", cfg, {"s": 0}) == []  # an older one
    ingest_batch(spark.createDataFrame([(10,)], "id bigint"), cfg, {"other": 0})
    assert stream_ledger(spark, name) == {"s": 1, "other": 0}


def test_a_batch_of_bad_texts_alone_is_replayed_once(spark):
    name = _name("t_bad")
    cfg = IngestConfig(table=name, id_field="id", location=scratch_path(spark, "tables"), options=NO_JSON)
    texts = spark.createDataFrame([("{broken",)], "t string")
    assert ingest_json_column(texts, "t", cfg, {"s": 0}) == [f"{name}_corrupt"]
    assert ingest_json_column(texts, "t", cfg, {"s": 0}) == []


def _write(d, name, lines):
    with open(os.path.join(d, name), "w") as fh:
        fh.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def _canonical(spark, name):
    out = {}
    for kind in ["", "_items", "_s", "_more", "_corrupt"]:
        df = spark.table(name + kind)
        out[kind] = (sorted(df.columns), sorted(
            json.dumps({k: v for k, v in r.asDict(recursive=True).items() if v is not None}, default=str, sort_keys=True)
            for r in df.collect()))
    return out


def test_drifting_documents_stream_like_one_batch(spark):
    one = [{"id": 1, "a": 5, "late": None, "s": {"x": 1}, "items": [{"k": 1}]}, {"id": 2}, "{broken"]
    two = [{"id": 3, "b": "new", "late": 7, "s": {"x": 2, "y": "deep"}, "items": [{"k": 2, "w": 1.5}], "more": [1, 2]},
           {"id": 1, "a": 6}, '"text"']
    src = scratch_path(spark, "drift-in")
    os.makedirs(src)
    name, whole = _name("t_drift"), _name("t_whole")
    ckpt = scratch_path(spark, "drift-ckpt")
    cfg = IngestConfig(table=name, id_field="id", location=scratch_path(spark, "tables"), options=NO_JSON)
    for f, lines in (("a.json", one), ("b.json", two)):
        _write(src, f, lines)
        q = ingest_text_stream(spark, src, cfg, checkpoint=ckpt, multiline=False)
        q.awaitTermination()
        assert q.exception() is None
    assert stream_ledger(spark, name) == {stream_key(ckpt): 1}
    batch = IngestConfig(table=whole, id_field="id", location=scratch_path(spark, "tables"), options=NO_JSON,
                         on_duplicate="latest", latest_by="a")
    texts = spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in one + two], "t string")
    ingest_json_column(texts, "t", batch)
    assert _canonical(spark, name) == _canonical(spark, whole)
    assert dict(spark.table(name).dtypes)["late"] == "bigint"


def test_a_stream_batch_without_any_id(spark):
    src = scratch_path(spark, "noid-in")
    os.makedirs(src)
    name = _name("t_noid")
    cfg = IngestConfig(table=name, id_field="id", location=scratch_path(spark, "tables"), options=NO_JSON)
    ckpt = scratch_path(spark, "noid-ckpt")
    for f, lines in (("a.json", [{"id": 1, "v": "a"}]), ("b.json", [{"v": "b"}, {"id": None, "v": "c"}])):
        _write(src, f, lines)
        ingest_text_stream(spark, src, cfg, checkpoint=ckpt, multiline=False).awaitTermination()
    assert sorted((r.id or 0, r.v) for r in spark.table(name).collect()) == [(0, "b"), (0, "c"), (1, "a")]


# ------------------------------------------------------------------ nested evolution


def test_nested_fields_are_added(spark):
    name, loc = _name("t_nest"), scratch_path(spark, "tables")
    old = spark.sql("""SELECT 1L AS id, named_struct('x', 1) AS s, array(named_struct('k', 1), null) AS a,
                       map('m', named_struct('p', 1)) AS m""")
    save_table(old, name, ["id"], location=loc)
    new = spark.sql("""SELECT 2L AS id, named_struct('y', 'new', 'X', 2) AS s,
                       array(named_struct('k', 2, 'deep', named_struct('z', 1))) AS a,
                       map('m', named_struct('p', 2, 'q', true)) AS m""")
    save_table(new, name, ["id"], location=loc)
    assert dict(spark.table(name).drop("filekey").dtypes) == {
        "id": "bigint", "s": "struct<x:int,y:string>", "a": "array<struct<k:int,deep:struct<z:int>>>",
        "m": "map<string,struct<p:int,q:boolean>>"}
    r = {x.id: x.asDict(recursive=True) for x in spark.table(name).collect()}
    assert r[1]["s"] == {"x": 1, "y": None} and r[2]["s"] == {"x": 2, "y": "new"}
    assert r[1]["a"] == [{"k": 1, "deep": None}, None] and r[2]["a"] == [{"k": 2, "deep": {"z": 1}}]
    assert r[1]["m"] == {"m": {"p": 1, "q": None}} and r[2]["m"] == {"m": {"p": 2, "q": True}}
    save_table(old, name, ["id"], location=loc)  # a batch that lacks the new fields again
    assert {x.id: x.s.y for x in spark.table(name).collect()} == {1: None, 2: "new"}
    append_table(spark.sql("SELECT 3L AS id, named_struct('w', 9) AS s"), name)
    assert dict(spark.table(name).dtypes)["s"] == "struct<x:int,y:string,w:int>"
    assert {x.id: x.s.w for x in spark.table(name).collect()} == {1: None, 2: None, 3: 9}
    with pytest.raises(TypeError, match="s.x"):
        save_table(spark.sql("SELECT 4L AS id, named_struct('x', array(1)) AS s"), name, ["id"], location=loc)


def test_evolve_schema_reports_what_it_added(spark):
    name, loc = _name("t_evo"), scratch_path(spark, "tables")
    save_table(spark.sql("SELECT 1 AS id, named_struct('x', 1) AS s"), name, ["id"], location=loc)
    wider = spark.sql("SELECT 1 AS id, named_struct('y', 1) AS s, 2 AS n").schema
    assert evolve_schema(spark, name, wider) == ["n", "s"]
    assert evolve_schema(spark, name, wider) == []
    assert spark.table(name).drop("filekey").first().asDict(recursive=True) == {"id": 1, "s": {"x": 1, "y": None}, "n": None}


def test_widened_schema_and_alignment_are_pure(spark):
    a = spark.sql("SELECT named_struct('x', 1, 'in', named_struct('p', 1)) AS s, array(1) AS n").schema
    b = spark.sql("SELECT named_struct('IN', named_struct('q', 2L)) AS S, array(2L) AS n, 'z' AS t").schema
    w = widened_schema(a, b)
    assert w.simpleString() == "struct<s:struct<x:int,in:struct<p:int,q:bigint>>,n:array<int>,t:string>"
    assert nested_additions(a, w) == [(("s", "in", "q"), b["S"].dataType["IN"].dataType["q"].dataType)]
    df = spark.sql("SELECT CAST(null AS struct<in:struct<q:bigint>>) AS S, array(2L) AS n, 'z' AS t")
    assert align_schema(df, w).first().asDict(recursive=True) == {"s": None, "n": [2], "t": "z"}
    assert widened_schema(w, a) == w


def test_upsert_into_a_nested_table_keeps_other_rows(spark):
    name, loc = _name("t_nup"), scratch_path(spark, "tables")
    save_table(spark.sql("SELECT id, named_struct('x', id) AS s FROM range(100)"), name, ["id"], location=loc)
    upsert_table(spark.sql("SELECT 5L AS id, named_struct('x', 5L, 'y', 'n') AS s"), name, ["id"])
    got = {r.id: (r.s.x, r.s.y) for r in spark.table(name).collect()}
    assert len(got) == 100 and got[5] == (5, "n") and got[6] == (6, None)


# ------------------------------------------------------------------ counts in the writes


def _jobs(spark, run):
    """Number of jobs that ``run`` starts."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "count")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_empty_tables_cost_no_job_of_their_own(spark):
    df = spark.createDataFrame([(1, [(1,)], [], [])],
                               "id bigint, a array<struct<k:int>>, b array<struct<k:int>>, c array<int>").repartition(4)
    loc = scratch_path(spark, "tables")

    def cfg(skip):
        return IngestConfig(table=_name("t_jobs"), id_field="id", location=loc, on_duplicate="allow",
                            options=FlattenOptions(promote_json=False, skip_empty=skip))

    keep, drop = cfg(False), cfg(True)
    ingest_batch(df, cfg(True))  # warm
    with_all = _jobs(spark, lambda: ingest_batch(df, keep))
    without = _jobs(spark, lambda: ingest_batch(df, drop))
    assert without <= with_all  # no isEmpty per child, no count of the batch
    assert not spark.catalog.tableExists(f"{drop.table}_b") and spark.catalog.tableExists(f"{keep.table}_b")
    assert spark.table(f"{drop.table}_a").count() == 1
    ingest_batch(df.withColumn("b", F.col("a")), drop)
    assert spark.table(f"{drop.table}_b").count() == 1


def test_an_idle_batch_leaves_no_table_behind(spark):
    loc = scratch_path(spark, "tables")
    cfg = IngestConfig(table=_name("t_idle"), id_field="id", location=loc, options=NO_JSON)
    empty = spark.createDataFrame([], "id bigint, a array<struct<k:int>>")
    assert ingest_batch(empty, cfg) == [] and not _files(loc)
    ingest_batch(spark.createDataFrame([(1, [(1,)])], empty.schema), cfg)
    before = T.current_version(spark, cfg.table)
    assert ingest_batch(empty, cfg) == []
    assert T.current_version(spark, cfg.table) == before


# ------------------------------------------------------------------ mappings


def test_mapped_ingest_and_its_command(spark, tmp_path):
    from shredkit.__main__ import main
    from shredkit.operators import ingest_mapped

    a, b = _name("map_a"), _name("map_b")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text('[{"Key": 1, "who": {"name": "n"}, "at": "20240102T000000.000 GMT"}, {"Key": 2}]')
    (tmp_path / "m.yaml").write_text(
        f"{a}:\n  - {{sourcePath: Key, targetColumn: id, dataType: BIGINT}}\n"
        "  - {sourcePath: at, targetColumn: at, dataType: TIMESTAMP}\n"
        f"{b}:\n  - {{sourcePath: key, targetColumn: k, dataType: STRING}}\n"
        "  - {sourcePath: who.name, targetColumn: name, dataType: STRING}\n")
    loc = scratch_path(spark, "tables")
    assert main(["ingest", str(tmp_path / "in"), "--table", a, "--id", "key", "--date-field", "at", "--arrays",
                 "--mapping", str(tmp_path / "m.yaml"), "--location", loc]) == 0
    assert sorted((r.id, str(r["at"])[:10]) for r in spark.table(a).collect()) == [(1, "2024-01-02"), (2, "None")]
    assert sorted((r.k, r["name"]) for r in spark.table(b).collect()) == [("1", "n"), ("2", None)]
    assert T.current_version(spark, a).day == "at" and T.current_version(spark, b).day is None
    with pytest.raises(ValueError, match="no column for the id"):
        ingest_mapped(spark.range(1), {"t": [("v", "v", "STRING")]}, IngestConfig(table="t", id_field="id"))
