"""Reference SQL (DuckDB dialect) for every registered query.

Each statement reads the pre-registered views over the parquet test tables and
must give the same rows, column names and types as the Spark query of the same
name in :mod:`shredkit.registry`. Hash columns are recomputed in SQL:

* ``content_hash_id`` -- ``sha256(concat_ws('||', text, ...))``.
* ``*_hash_col``      -- Spark's ``hash`` (Murmur3 x86 32-bit, seed 42) of a
  bigint, spelled out as integer arithmetic in nested selects (one step per
  level so no expression is repeated).
"""

from __future__ import annotations

from shredkit.constants import DATE_FORMAT

M = 4294967296
C1, C2 = 3432918353, 461845907  # Murmur3 x86_32 block constants
H_ADD = 3864292196
F1, F2 = 2246822507, 3266489909  # Murmur3 finalizer constants
SEED = 42


def _rotl(x: str, r: int) -> str:
    return f"(({x} * {2 ** r}) % {M} + {x} // {2 ** (32 - r)})"


def murmur3_bigint(src: str, key: str, out: str) -> str:
    """Wrap ``src`` (a SELECT) adding ``out`` = Spark ``hash(key)`` for a bigint key."""
    steps: list[tuple[str, str]] = [
        ("__u", f"(CAST({key} AS HUGEINT) + 18446744073709551616)"),
    ]
    steps += [("__lo", f"__u % {M}"), ("__hi", f"(__u // {M}) % {M}")]
    h = str(SEED)
    for i, word in enumerate(("__lo", "__hi")):
        steps += [
            (f"__ka{i}", f"({word} * {C1}) % {M}"),
            (f"__kb{i}", _rotl(f"__ka{i}", 15)),
            (f"__k{i}", f"(__kb{i} * {C2}) % {M}"),
            (f"__ha{i}", f"xor(CAST({h} AS HUGEINT), __k{i})"),
            (f"__hb{i}", _rotl(f"__ha{i}", 13)),
            (f"__h{i}", f"(__hb{i} * 5 + {H_ADD}) % {M}"),
        ]
        h = f"__h{i}"
    steps += [
        ("__f1", f"xor({h}, CAST(8 AS HUGEINT))"),
        ("__f2", "xor(__f1, __f1 // 65536)"),
        ("__f3", f"(__f2 * {F1}) % {M}"),
        ("__f4", "xor(__f3, __f3 // 8192)"),
        ("__f5", f"(__f4 * {F2}) % {M}"),
        ("__f6", "xor(__f5, __f5 // 65536)"),
    ]
    sql = src
    for name, expr in steps:
        sql = f"SELECT *, {expr} AS {name} FROM ({sql})"
    temps = ", ".join(n for n, _ in steps)
    final = (f"CAST(CASE WHEN __f6 >= 2147483648 THEN __f6 - {M} ELSE __f6 END AS INTEGER)")
    return f"SELECT * EXCLUDE ({temps}), {final} AS {out} FROM ({sql})"


def sha(*parts: str) -> str:
    return "sha256(concat_ws('||', " + ", ".join(parts) + "))"


def _v(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


def _child(src: str) -> str:
    """Child-table oracle: add parent_id_hash_col."""
    return murmur3_bigint(src, "parent_id", "parent_id_hash_col")


# ------------------------------------------------------------------ fixtures in SQL

ORDERS_B1 = ("SELECT * FROM orders WHERE o_orderpriority IN "
             "('1-URGENT', '2-HIGH', '3-MEDIUM')")
ORDERS_B2 = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1.0 AS o_totalprice, "
             "o_orderdate, o_orderpriority, 'changed' AS o_flag FROM orders WHERE o_orderpriority IN "
             "('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')")
ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _merged(extra_b1: str = "", extra_b2: str = "") -> str:
    return (
        f"SELECT {ORDER_COLS}, CAST(NULL AS VARCHAR) AS o_flag{extra_b1} FROM ({ORDERS_B1}) b1 "
        f"WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({ORDERS_B2})) "
        f"UNION ALL SELECT {ORDER_COLS}, o_flag{extra_b2} FROM ({ORDERS_B2})"
    )


def _snake(x: str) -> str:
    s = f"regexp_replace({x}, '^(.+)\\.[^.]*$', '\\1', 's')"
    s = f"regexp_replace({s}, '-+', '_', 'g')"
    s = f"lower(regexp_replace({s}, '([A-Z]+)', '_\\1', 'g'))"
    return f"coalesce(regexp_replace({s}, '^_', ''), '')"


_DUCK_DATE = "%Y%m%dT%H%M%S.%g GMT"
PATH_TEXT = "('My-File' || p_type || '.' || p_name)"
assert DATE_FORMAT == "yyyyMMdd'T'HHmmss.SSS 'GMT'"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    q["flatten_struct_array"] = _child(
        "SELECT DISTINCT l_orderkey AS parent_id, l_linenumber, l_returnflag, l_quantity, "
        "l_shipdate, " + sha(_v("l_orderkey"), _v("l_linenumber"), "l_returnflag",
                             _v("l_quantity"), _v("l_shipdate")) + " AS content_hash_id "
        "FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")

    q["flatten_struct"] = _child(
        "SELECT DISTINCT o_orderkey AS parent_id, c_name, c_mktsegment, "
        + sha(_v("o_orderkey"), "c_name", "c_mktsegment") + " AS content_hash_id "
        "FROM orders JOIN customer ON o_custkey = c_custkey")

    q["flatten_main"] = murmur3_bigint(f"SELECT {ORDER_COLS} FROM orders", "o_orderkey",
                                       "id_hash_col")

    q["flatten_value_array"] = _child(
        "SELECT DISTINCT parent_id, value, " + sha(_v("parent_id"), "value")
        + " AS content_hash_id FROM (SELECT doc_id AS parent_id, "
        "unnest(string_split(text, chr(10))) AS value FROM documents)")

    q["flatten_float_array"] = _child(
        "SELECT DISTINCT vec_id AS parent_id, unnest(embedding) AS value FROM embeddings")

    q["flatten_two_levels"] = _child(
        "SELECT DISTINCT o_custkey AS parent_id, l_linenumber, l_returnflag, l_quantity, "
        + sha(_v("o_custkey"), _v("l_linenumber"), "l_returnflag", _v("l_quantity"))
        + " AS content_hash_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
        "JOIN customer ON c_custkey = o_custkey")

    q["flatten_nested_parent"] = _child(
        "SELECT DISTINCT o_custkey AS parent_id, o_orderkey, o_orderstatus, o_totalprice, "
        "o_orderdate, " + sha(_v("o_custkey"), _v("o_orderkey"), "o_orderstatus",
                              _v("o_totalprice"), _v("o_orderdate"))
        + " AS content_hash_id FROM orders JOIN customer ON c_custkey = o_custkey")

    q["flatten_row_index"] = _child(
        "SELECT parent_id, _row_idx, " + sha(_v("parent_id"), _v("_row_idx"))
        + " AS content_hash_id FROM (SELECT conv_id AS parent_id, CAST(row_number() OVER "
        "(PARTITION BY conv_id) AS INTEGER) AS _row_idx FROM conversations)")

    q["flatten_threads"] = _child(
        "SELECT DISTINCT conv_id AS parent_id, turn, role, text, "
        + sha(_v("conv_id"), _v("turn"), "role", "text") + " AS content_hash_id "
        "FROM conversations")

    q["promote_json"] = _child(
        "SELECT DISTINCT parent_id, k, " + sha(_v("parent_id"), _v("k"))
        + " AS content_hash_id FROM (SELECT event_id AS parent_id, "
        "CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events "
        "WHERE trim(props) LIKE '{%' AND props LIKE '%:%')")

    q["json_text_parse"] = (
        "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, "
        "CAST(NULL AS VARCHAR) AS _corrupt_record FROM events")

    q["content_hash"] = (
        "SELECT l_orderkey, l_linenumber, "
        + sha(*[_v(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                "l_quantity", "l_extendedprice", "l_discount", "l_tax")],
              "l_returnflag", "l_linestatus", _v("l_shipdate"))
        + " AS content_hash_id FROM lineitem")

    q["murmur_hash"] = murmur3_bigint(
        murmur3_bigint("SELECT o_orderkey, o_custkey FROM orders", "o_orderkey", "key_hash"),
        "o_custkey", "cust_hash")

    q["parse_date"] = (
        f"SELECT event_id, strftime(ts, '{_DUCK_DATE}') AS ts_text, "
        f"try_strptime(strftime(ts, '{_DUCK_DATE}'), '{_DUCK_DATE}') AS ts_parsed FROM events")

    q["align_schema"] = (
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
        "CAST(NULL AS TIMESTAMP) AS o_orderdate, o_orderpriority, "
        "CAST(NULL AS VARCHAR) AS o_clerk, CAST(NULL AS VARCHAR) AS o_comment FROM orders")

    q["merge_upsert"] = _merged()
    q["save_and_upsert"] = _merged(", 'batch1' AS filekey", ", 'batch2' AS filekey")
    q["append_evolve"] = (
        f"SELECT {ORDER_COLS}, CAST(NULL AS VARCHAR) AS o_flag FROM ({ORDERS_B1}) "
        f"UNION ALL SELECT {ORDER_COLS}, o_flag FROM ({ORDERS_B2})")

    q["project_mapping"] = (
        "SELECT o_orderkey AS order_id, CAST(o_totalprice AS VARCHAR) AS total, "
        "o_orderdate AS order_ts, c_name AS customer_name, "
        "CAST(NULL AS VARCHAR) AS comment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")

    q["snake_case"] = (
        f"SELECT p_partkey, {_snake('p_name')} AS name_sc, {_snake('p_brand')} AS brand_sc, "
        f"{_snake(PATH_TEXT)} AS path_sc FROM part")

    q["hex_decode"] = (
        "SELECT p_partkey, regexp_replace(hex(p_name), '(.{16})', '\\1' || chr(10), 'g') "
        "AS hex_text, p_name AS decoded FROM part")

    q["dedup_children"] = _child(
        "SELECT DISTINCT l_orderkey AS parent_id, l_returnflag, l_linestatus, "
        + sha(_v("l_orderkey"), "l_returnflag", "l_linestatus")
        + " AS content_hash_id FROM lineitem")

    q["json_roundtrip"] = "SELECT * FROM customer"

    q["stream_ingest"] = q["flatten_struct_array"]
    q["stream_upsert"] = q["flatten_struct_array"]
    q["ingest_append_only"] = q["flatten_struct_array"]

    q["jdbc_query"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation"

    q["with_file_key"] = "SELECT o_orderkey, 'default_file_path' AS filekey FROM orders"

    customer_json = ("'{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"c_nationkey\":' "
                     "|| c_nationkey || ',\"c_acctbal\":' || c_acctbal || ',\"c_mktsegment\":\"' "
                     "|| c_mktsegment || '\"}'")
    customer = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
    q["root_array"] = f"SELECT sha256({customer_json}) AS parent_id, {customer} FROM customer"
    q["json_array_files"] = q["json_whole_files"] = f"SELECT {customer} FROM customer"
    q["hash_json"] = (
        "SELECT o_orderkey, " + sha(
            _v("o_orderkey"), "'{\"c_name\":\"' || c_name || '\",\"c_mktsegment\":\"' || c_mktsegment || '\"}'")
        + " AS content_hash_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
    q["dedup_separator"] = _child(
        "SELECT o_orderkey AS parent_id, " + sha(_v("o_orderkey"), "o_orderpriority", "o_orderstatus", "'z'")
        + " AS content_hash_id FROM orders")
    for name, n in (("flatten_null_elements", 2), ("flatten_null_struct", 3)):
        q[name] = _child(
            "SELECT o_orderkey AS parent_id, o_custkey, o_orderstatus, "
            + sha(_v("o_orderkey"), _v("o_custkey"), "o_orderstatus")
            + f" AS content_hash_id FROM orders WHERE o_orderkey % {n} = 0")
    k = "CAST(json_extract(props, '$.k') AS BIGINT)"
    q["promote_mixed"] = _child(
        f"SELECT event_id AS parent_id, {k} AS k, CAST(NULL AS VARCHAR) AS m, "
        + sha(_v("event_id"), _v(k)) + " AS content_hash_id FROM events UNION ALL "
        "SELECT event_id, NULL, 'm' || event_id, " + sha(_v("event_id"), "('m' || event_id)")
        + " FROM events WHERE event_id % 2 = 1")
    big = "CAST(event_id + 12345678901234500000::HUGEINT AS VARCHAR)"
    q["promote_big_ints"] = (f"SELECT event_id AS parent_id, {big} AS k, " + sha(_v("event_id"), big)
                             + " AS content_hash_id FROM events")
    q["upsert_latest"] = (
        "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'keep' ELSE 'b' END AS v, "
        "CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS at FROM orders")
    q["save_dated"] = (f"SELECT event_id, try_strptime(strftime(ts, '{_DUCK_DATE}'), '{_DUCK_DATE}') AS ts, "
                       "'default_file_path' AS filekey FROM events")
    q["ingest_quoted_names"] = (
        "SELECT o_orderkey AS parent_id, " + _v("o_custkey") + " AS v, " + sha(_v("o_orderkey"), _v("o_custkey"))
        + " AS content_hash_id FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, "
        + sha(_v("o_orderkey"), "o_orderstatus") + " FROM orders")
    q["merge_matched"] = (
        f"SELECT {ORDER_COLS.replace('o_totalprice', 'CASE WHEN o_orderkey % 97 = 0 THEN 1.0::DOUBLE ELSE o_totalprice END AS o_totalprice')}, "
        "CASE WHEN o_orderkey % 97 = 0 THEN 'second' ELSE 'first' END AS filekey FROM orders UNION ALL "
        f"SELECT {ORDER_COLS.replace('o_orderkey', '-o_orderkey - 1').replace('o_totalprice', '1.0::DOUBLE')}, 'second' "
        "FROM orders WHERE o_orderkey % 97 = 0")
    q["merge_dated"] = (f"SELECT event_id, try_strptime(strftime(ts + CASE WHEN event_id % 50 = 0 THEN INTERVAL 40 DAY "
                        f"ELSE INTERVAL 0 DAY END, '{_DUCK_DATE}'), '{_DUCK_DATE}') AS ts FROM events")
    q["family_commit"] = (
        "SELECT 'before' AS state, o_orderkey, o_orderstatus, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey "
        "UNION ALL SELECT 'after', o_orderkey, 'new', name FROM (SELECT o_orderkey, c_name, upper(c_name) AS up FROM orders "
        "LEFT JOIN customer ON o_custkey = c_custkey), LATERAL (SELECT unnest(CASE WHEN c_name = up THEN [c_name] "
        "ELSE [c_name, up] END) AS name)")
    q["stream_replay"] = (
        "SELECT CASE WHEN event_id % 10 <> 0 THEN event_id END AS event_id, user_id, CAST(NULL AS VARCHAR) AS _corrupt_record "
        "FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT NULL, NULL, 'no document ' || event_id FROM events "
        "WHERE event_id % 7 = 0")
    q["stream_drift"] = (
        "SELECT event_id, event_type, CASE WHEN event_id % 2 = 1 THEN user_id END AS user_id, "
        "CASE WHEN event_id % 2 = 1 THEN user_id END AS who FROM events")
    q["nested_evolution"] = (
        "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, "
        "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS c_mktsegment, c_nationkey AS nation, "
        "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment FROM customer")
    q["json_text_case"] = (
        f"SELECT event_id, CASE WHEN event_id % 5 IN (1, 2, 4) THEN {k} END AS K, CASE WHEN event_id % 5 = 0 THEN "
        f"'{{\"K\": ' || {k} || ', \"k\": 1}}' END AS _corrupt_record FROM events WHERE event_id % 5 <> 3 "
        "UNION ALL SELECT event_id, NULL, '5' FROM events WHERE event_id % 5 = 2")
    q["promote_malformed"] = (
        f"SELECT unnest(['objects', 'mixed']) AS variant, event_id AS parent_id, {k} AS k FROM events WHERE event_id % 3 <> 0")
    q["json_maps"] = "SELECT event_id, 'user ' || event_id AS who, user_id, event_type FROM events"
    q["json_giant_array"] = q["json_array_files"]
    q["rebuild_documents"] = (
        "SELECT o_orderkey, o_custkey, o_totalprice, c_name, n_items, quantity FROM orders LEFT JOIN customer "
        "ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*)::INT AS n_items, sum(l_quantity) AS quantity "
        "FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_shipdate FROM lineitem) "
        "GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
    q["skip_empty"] = (
        "SELECT '' AS child, count(*) AS n FROM orders UNION ALL SELECT '_items', count(*) FROM (SELECT DISTINCT l_orderkey, "
        "l_linenumber, l_returnflag, l_quantity, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey) "
        "UNION ALL SELECT '_customer', count(*) FROM orders JOIN customer ON o_custkey = c_custkey")
    q["managed_columns"] = (
        "SELECT o_orderkey AS parent_id, c_name, 'orders,orders_customer' AS tables FROM orders "
        "JOIN customer ON o_custkey = c_custkey")
    q["ingest_mapped"] = (
        "SELECT o_orderkey AS order_id, CAST(o_totalprice AS VARCHAR) AS total, CAST(NULL AS VARCHAR) AS note, "
        "CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status, c_name AS buyer "
        "FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
    q["catalog_names"] = ("SELECT c_custkey, c_name, 'my__customers' AS prefix, false AS before, true AS after "
                          "FROM customer")
    q["sorted_files"] = (
        "SELECT 'main' AS part, count(*) AS n, 0::BIGINT AS out_of_order FROM orders UNION ALL "
        "SELECT 'items', count(*), 0 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_shipdate "
        "FROM lineitem JOIN orders ON o_orderkey = l_orderkey)")
    q["jdbc_bounds"] = "SELECT CASE WHEN c_custkey % 9 <> 0 THEN c_custkey END AS k, c_custkey, c_nationkey FROM customer"
    q["json_text_mixed"] = (
        f"SELECT event_id, CASE WHEN event_id % 5 IN (2, 4) THEN {k} END AS k, "
        "CASE event_id % 5 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN CAST(event_id AS VARCHAR) "
        "WHEN 3 THEN '\"x\"' END AS _corrupt_record FROM events "
        f"UNION ALL SELECT event_id, {k}, NULL FROM events WHERE event_id % 5 = 2")
    q["ingest_batch_children"] = (
        "SELECT parent_id, content_hash_id, parent_id_hash_col, 'default_file_path' AS filekey, 'items' AS child "
        f"FROM ({q['flatten_struct_array']}) UNION ALL SELECT parent_id, content_hash_id, parent_id_hash_col, "
        f"'default_file_path', 'customer' FROM ({q['flatten_struct']})")
    q["stream_family"] = (
        f"SELECT m.*, c_name, c_mktsegment, content_hash_id FROM ({q['flatten_main']}) m "
        f"LEFT JOIN ({q['flatten_struct']}) c ON c.parent_id = m.o_orderkey")

    q["ingest_batch"] = murmur3_bigint(
        f"SELECT {ORDER_COLS}, 'default_file_path' AS filekey FROM orders", "o_orderkey",
        "id_hash_col")

    q["keep_ordinal"] = _child(
        "SELECT parent_id, value, _ordinal, " + sha(_v("parent_id"), "value", "_ordinal")
        + " AS content_hash_id FROM (SELECT parent_id, value, CAST(pos AS VARCHAR) AS _ordinal "
        "FROM (SELECT doc_id AS parent_id, unnest(string_split(text, chr(10))) AS value, "
        "unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))")

    labelled = ("SELECT d.doc_id AS parent_id, CAST(l.quality AS VARCHAR) AS quality, "
                "CAST(l.toxic AS VARCHAR) AS toxic, d.lang FROM documents d "
                "LEFT JOIN labels l ON d.doc_id = l.doc_id")
    q["flatten_with_nulls"] = _child(
        "SELECT parent_id, quality, toxic, lang, "
        + sha(_v("parent_id"), _v("quality"), _v("toxic"), "lang")
        + f" AS content_hash_id FROM ({labelled})")
    nm = "'\\N'"
    q["null_marker"] = _child(
        "SELECT parent_id, quality, toxic, lang, "
        + sha(_v("parent_id"), f"coalesce({_v('quality')}, {nm})",
              f"coalesce({_v('toxic')}, {nm})", f"coalesce(lang, {nm})")
        + f" AS content_hash_id FROM ({labelled})")

    return q
