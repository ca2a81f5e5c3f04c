"""Property tests: flatten against a plain-Python model on random documents."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shredkit import FlattenOptions, flatten

vals = st.one_of(st.none(), st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=6))
recs = st.one_of(st.none(), st.lists(
    st.one_of(st.none(), st.tuples(st.one_of(st.none(), st.integers(0, 3)),
                                   st.one_of(st.none(), st.sampled_from(["a", "b"])))),
    max_size=5))
docs = st.lists(st.tuples(vals, recs), min_size=1, max_size=8)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs)
def test_flatten_matches_model(spark, ds):
    rows = [(i, v, r) for i, (v, r) in enumerate(ds)]
    df = spark.createDataFrame(rows, "id int, v array<int>, r array<struct<k:int,s:string>>")
    t = flatten(df, "id", "m", FlattenOptions(promote_json=False, null_marker="\\N"))
    want_v = {(i, x) for i, v, _ in rows for x in (v or []) if x is not None}
    assert {(row.parent_id, row.value) for row in t["m_v"].collect()} == want_v
    want_r = {(i, e[0], e[1]) for i, _, r in rows for e in (r or []) if e is not None}
    got_r = t["m_r"].collect()
    assert {(row.parent_id, row.k, row.s) for row in got_r} == want_r
    assert len(got_r) == len(want_r)  # one row per distinct record and parent
    # keep_ordinal keeps every non-null element
    t2 = flatten(df, "id", "m", FlattenOptions(promote_json=False, keep_ordinal=True))
    n = sum(1 for _, _, r in rows for e in (r or []) if e is not None)
    assert t2["m_r"].count() == n
