"""Plan properties: no jobs while flattening, pruned nested reads, shared shuffles."""

from shredkit import FlattenOptions, flatten
from shredkit.session import scratch_path


def _jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup())


def test_flatten_launches_no_job(spark):
    df = spark.createDataFrame([(1, [(1, "a")], (2, "b"))],
                               "id int, arr array<struct<k:int,v:string>>, s struct<x:int,y:string>")
    spark.sparkContext.setJobGroup("flatten-plan", "plan only")
    before = _jobs(spark)
    tables = flatten(df, "id", "m", FlattenOptions(promote_json=False))
    assert _jobs(spark) == before
    assert len(tables) == 3
    spark.sparkContext.setJobGroup("other", "other")


def test_deeper_tables_prune_sibling_fields(spark):
    path = scratch_path(spark, "nested")
    spark.createDataFrame([(1, [(1, "q", [(2, "x")])])],
                          "id int, orders array<struct<a:int,b:string,items:array<struct<k:int,v:string>>>>") \
        .write.parquet(path)
    t = flatten(spark.read.parquet(path), "id", "m", FlattenOptions(promote_json=False))
    plan = t["m_orders_items"]._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int,orders:array<struct<items:array<struct<k:int,v:string>>>>>" in plan
    main_plan = t["m"]._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int>" in main_plan
    assert sorted((r.parent_id, r.k, r.v) for r in t["m_orders_items"].collect()) == [(1, 2, "x")]


def test_dedup_shares_one_shuffle(spark):
    df = spark.createDataFrame([(1, [(1, "a"), (1, "a"), (2, None)])], "id int, arr array<struct<k:int,v:string>>")
    t = flatten(df, "id", "m", FlattenOptions(promote_json=False))["m_arr"]
    assert sorted((r.k, r.v) for r in t.collect()) == [(1, "a"), (2, None)]
    plan = t._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "content_hash_id" in plan


def test_no_static_broadcast_of_estimated_sides(spark):
    from shredkit.plans import nest

    doc = nest.nested_orders(spark, "/root/testdata/sf0.001")
    plan = doc._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan  # decided later by AQE on measured sizes


def _jobs_for(spark, group, fn):
    spark.sparkContext.setJobGroup(group, group)
    out = fn()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    return n, out


def test_json_inference_is_one_aggregate_for_all_depths(spark):
    flat = spark.createDataFrame([(1, '{"a": 1}')], "id int, j string")
    one, _ = _jobs_for(spark, "infer-flat", lambda: flatten(flat, "id", "m"))
    df = spark.createDataFrame(
        [(1, '{"a": 1}', [('{"b": 2}', ('{"c": 3}',))])],
        "id int, j string, arr array<struct<s:string,t:struct<u:string>>>")
    deep, tables = _jobs_for(spark, "infer-deep", lambda: flatten(df, "id", "m"))
    assert deep == one  # the same single aggregate, however deep the text sits
    assert {"m_j", "m_arr", "m_arr_s", "m_arr_t", "m_arr_t_u"} <= set(tables)
    assert [r.c for r in tables["m_arr_t_u"].collect()] == [3]
