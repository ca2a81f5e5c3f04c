"""Registered queries: one Spark job per operator family, over the test tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose rows,
column names and types equal the SQL of the same name in
:mod:`shredkit.oracles`. Queries that write (tables, JSON files, streams) do
so under a fresh folder of the shared scratch root (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shredkit.config import FlattenOptions, IngestConfig
from shredkit.constants import CONTENT_HASH, DATE_FORMAT, DEFAULT_BUCKETS, PARENT_ID
from shredkit.functions.hashing import content_hash, key_hash
from shredkit.functions.names import snake_case
from shredkit.functions.text import parse_date
from shredkit.operators.ingest import ingest_batch, ingest_json_column, ingest_mapped, stage_family
from shredkit.operators.rebuild import rebuild_documents
from shredkit.operators.tables import (
    append_table,
    commit,
    create_table,
    qualified_name,
    save_table,
    table_exists,
    with_file_key,
)
from shredkit.operators.upsert import merge_upsert
from shredkit.plans import nest
from shredkit.plans.flatten import dedup_children, flatten
from shredkit.plans.schema import Mapping, align_schema, project_mapping
from shredkit.session import safe_planning, scoped_conf, scratch_path
from shredkit.sources.arrays import read_json_arrays
from shredkit.sources.hex import decode_hex_column
from shredkit.sources.jdbc import read_jdbc_query
from shredkit.sources.json import parse_json_column, read_json_files
from shredkit.streaming.ingest import ingest_stream, ingest_text_stream

Query = Callable[[SparkSession, str], DataFrame]

NO_JSON = FlattenOptions(promote_json=False)
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
              "o_orderpriority"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return nest.table(spark, d, name)


# ------------------------------------------------------------------ flatten family


def flatten_struct_array(spark, d):
    """array<struct> of line items becomes the ``orders_items`` table."""
    doc = nest.nested_orders(spark, d)
    return flatten(doc, "o_orderkey", "orders", NO_JSON)["orders_items"]


def flatten_struct(spark, d):
    """Struct ``customer`` becomes ``orders_customer``."""
    doc = nest.orders_with_customer(spark, d)
    return flatten(doc, "o_orderkey", "orders", NO_JSON)["orders_customer"]


def flatten_main(spark, d):
    """Top-level scalars + ``id_hash_col``."""
    return flatten(nest.orders_with_customer(spark, d), "o_orderkey", "orders", NO_JSON)["orders"]


def flatten_value_array(spark, d):
    """array<string> (lines of each whole document) becomes a value table."""
    doc = nest.doc_lines(spark, d)
    return flatten(doc, "doc_id", "documents", NO_JSON)["documents_lines"]


def flatten_float_array(spark, d):
    """R4 on floats: embedding vectors; compared by value (float text differs by engine)."""
    doc = _t(spark, d, "embeddings").select("vec_id", "embedding")
    t = flatten(doc, "vec_id", "embeddings", NO_JSON)["embeddings_embedding"]
    return t.drop(CONTENT_HASH)


def flatten_two_levels(spark, d):
    """Q1: items two levels down keep the *root* id (customer) as parent_id."""
    doc = nest.nested_customers(spark, d)
    return flatten(doc, "c_custkey", "customers", NO_JSON)["customers_orders_items"]


def flatten_nested_parent(spark, d):
    """R3 at depth 1 of the customer documents: ``customers_orders``."""
    doc = nest.nested_customers(spark, d)
    return flatten(doc, "c_custkey", "customers", NO_JSON)["customers_orders"]


def _dialog(spark, d):
    th = nest.threads(spark, d)
    # Each element holds only a struct: a record with no scalar field.
    return th.select("conv_id", F.transform("turns", lambda t: F.struct(t.alias("turn_info")))
                     .alias("dialog"))


def flatten_row_index(spark, d):
    """A record without scalar fields gets ``_row_idx`` 1..n per parent."""
    return flatten(_dialog(spark, d), "conv_id", "conversations", NO_JSON)["conversations_dialog"]


def flatten_threads(spark, d):
    """R3 below a row-index record: ``conversations_dialog_turn_info``."""
    t = flatten(_dialog(spark, d), "conv_id", "conversations", NO_JSON)
    return t["conversations_dialog_turn_info"]


def promote_json(spark, d):
    """JSON text in ``events.props`` is inferred on the cluster and flattened."""
    ev = _t(spark, d, "events")
    return flatten(ev, "event_id", "events")["events_props"]


def root_array(spark, d):
    """R2/Q2: documents that are a bare array of records, with no id of their own."""
    cust = _t(spark, d, "customer")
    docs = nest.nest_rows(cust, ["c_nationkey"],
                          ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                          "customers", "c_custkey").select("customers")
    main = flatten(docs, None, "customers", NO_JSON)["customers"]
    return main.select(PARENT_ID, "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def dedup_children_q(spark, d):
    """A1: child rows with many repeats collapse to one per (parent_id, hash)."""
    li = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias(PARENT_ID), "l_returnflag", "l_linestatus")
    types = {f.name: f.dataType for f in li.schema.fields}
    li = li.withColumn(CONTENT_HASH, content_hash([(c, types[c]) for c in li.columns]))
    out = dedup_children(li)
    return out.withColumn("parent_id_hash_col", key_hash(F.col(PARENT_ID)))


def dedup_separator(spark, d):
    """A1: two different records whose hash text is the same (the separator inside a
    value) are one row per key."""
    o = _t(spark, d, "orders")
    first = F.struct(F.concat("o_orderpriority", F.lit("||"), "o_orderstatus").alias("a"), F.lit("z").alias("b"))
    second = F.struct(F.col("o_orderpriority").alias("a"), F.concat("o_orderstatus", F.lit("||z")).alias("b"))
    doc = o.select("o_orderkey", F.array(first, second).alias("pairs"))
    t = flatten(doc, "o_orderkey", "orders", NO_JSON)["orders_pairs"]
    return t.select(PARENT_ID, CONTENT_HASH, "parent_id_hash_col")


def _with_nulls(spark, d):
    o = _t(spark, d, "orders")
    rec = F.struct("o_custkey", "o_orderstatus")
    return o.select("o_orderkey", F.array(F.when(F.col("o_orderkey") % 2 == 0, rec), F.lit(None)).alias("recs"),
                    F.when(F.col("o_orderkey") % 3 == 0, rec).alias("rec"),
                    F.array(F.lit(None), F.col("o_orderpriority")).alias("vals"))


def flatten_null_elements(spark, d):
    """P5: null array elements give no child row."""
    return flatten(_with_nulls(spark, d), "o_orderkey", "orders", NO_JSON)["orders_recs"]


def flatten_null_struct(spark, d):
    """P5: a null struct gives no child row."""
    return flatten(_with_nulls(spark, d), "o_orderkey", "orders", NO_JSON)["orders_rec"]


def promote_mixed(spark, d):
    """One text column holds objects and arrays of objects; no record is lost."""
    ev = _t(spark, d, "events")
    many = F.concat(F.lit("["), "props", F.lit(',{"m":"m'), F.col("event_id").cast("string"), F.lit('"}]'))
    ev = ev.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(many).alias("props"))
    return flatten(ev, "event_id", "events")["events_props"]


BIG = "12345678901234500000"


def promote_big_ints(spark, d):
    """Whole numbers beyond 64 bits stay exact."""
    ev = _t(spark, d, "events")
    big = (F.col("event_id").cast("decimal(30,0)") + F.lit(BIG).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")
    ev = ev.select("event_id", F.concat(F.lit('{"k":'), big, F.lit("}")).alias("props"))
    t = flatten(ev, "event_id", "events")["events_props"]
    return t.select(PARENT_ID, F.col("k").cast("string").alias("k"), CONTENT_HASH)


# ------------------------------------------------------------------ functions


def hash_json(spark, d):
    """nested values hash by their JSON text."""
    doc = nest.orders_with_customer(spark, d)
    fields = [(c, doc.schema[c].dataType) for c in ("o_orderkey", "customer")]
    return doc.select("o_orderkey", content_hash(fields).alias(CONTENT_HASH))


def content_hash_q(spark, d):
    """SHA-256 of all line item columns joined with ``||``."""
    li = _t(spark, d, "lineitem")
    fields = [(f.name, f.dataType) for f in li.schema.fields]
    return li.select("l_orderkey", "l_linenumber", content_hash(fields).alias(CONTENT_HASH))


def murmur_hash(spark, d):
    """Murmur3 key hash of bigint keys."""
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", key_hash(F.col("o_orderkey")).alias("key_hash"),
                    key_hash(F.col("o_custkey")).alias("cust_hash"))


def parse_date_q(spark, d):
    """document date text (``yyyyMMdd'T'HHmmss.SSS 'GMT'``) parsed back."""
    ev = nest.events_dated(spark, d)
    return ev.select("event_id", "ts_text",
                     parse_date(F.col("ts_text"), DATE_FORMAT).cast("timestamp_ntz")
                     .alias("ts_parsed"))


def snake_case_q(spark, d):
    """Snake-cased names."""
    p = _t(spark, d, "part")
    path = F.concat(F.lit("My-File"), F.col("p_type"), F.lit("."), F.col("p_name"))
    return p.select("p_partkey", snake_case(F.col("p_name")).alias("name_sc"),
                    snake_case(F.col("p_brand")).alias("brand_sc"),
                    snake_case(path).alias("path_sc"))


def hex_decode(spark, d):
    """Wrapped hex text decoded back to the original text."""
    p = _t(spark, d, "part")
    wrapped = F.regexp_replace(F.hex(F.col("p_name")), "(.{16})", "$1\n")
    x = p.select("p_partkey", wrapped.alias("hex_text"))
    x = decode_hex_column(x, "hex_text", out="decoded")
    return x.select("p_partkey", "hex_text", F.col("decoded").cast("string").alias("decoded"))


def with_file_key_q(spark, d):
    """Provenance literal."""
    return with_file_key(_t(spark, d, "orders").select("o_orderkey"), None)


# ------------------------------------------------------------------ schema / merge


def _batches(spark, d):
    o = _t(spark, d, "orders")
    b1 = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    b2 = (o.where(F.col("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
           .withColumn("o_totalprice", F.col("o_totalprice") + F.lit(1.0))
           .withColumn("o_flag", F.lit("changed")))
    return b1, b2


def align_schema_q(spark, d):
    """A batch with fewer (and differently cased) columns aligned to a table schema."""
    o = _t(spark, d, "orders")
    target = (o.withColumn("o_clerk", F.lit(None).cast("string"))
               .withColumn("o_comment", F.lit(None).cast("string"))).schema
    batch = o.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("O_ORDERSTATUS"),
                     "o_totalprice", "o_orderpriority")
    return align_schema(batch, target)


def merge_upsert_q(spark, d):
    """Anti join + union by name, the second batch carrying a new column."""
    b1, b2 = _batches(spark, d)
    return merge_upsert(b1, b2, ["o_orderkey"]).select(*ORDER_COLS, "o_flag")


@contextmanager
def _orders_kept(spark: SparkSession, d: str) -> Iterator[DataFrame]:
    """Nested orders to ingest, built once and joined over a multiple of the tables' buckets, so
    that the ingest finds them dealt."""
    tasks = nest.ingest_tasks(spark, d, DEFAULT_BUCKETS)
    with scoped_conf(spark, {"spark.sql.shuffle.partitions": str(tasks)}):
        doc = nest.nested_orders(spark, d, tasks).persist(StorageLevel.MEMORY_AND_DISK)
        doc.count()  # fills the cache while this width holds
    try:
        yield doc
    finally:
        doc.unpersist()


def _table_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:10]}"


def save_and_upsert(spark, d):
    """Create a bucketed table, then evolve + upsert a second batch."""
    b1, b2 = _batches(spark, d)
    name = _table_name("orders_saved")
    loc = scratch_path(spark, "tables")
    save_table(b1, name, ["o_orderkey"], file_key="batch1", on_duplicate="error", location=loc)
    save_table(b2, name, ["o_orderkey"], file_key="batch2", on_duplicate="error", location=loc)
    return spark.table(name).select(*ORDER_COLS, "o_flag", "filekey")


def append_evolve(spark, d):
    """K2: append a batch with a new column to an existing table."""
    b1, b2 = _batches(spark, d)
    name = _table_name("orders_appended")
    loc = scratch_path(spark, "tables")
    create_table(b1, name, "o_orderkey", location=loc)
    append_table(b2, name)
    return spark.table(name).select(*ORDER_COLS, "o_flag")


def upsert_latest(spark, d):
    """K4: of rows with one key the latest is saved; rows without a date and ties are kept
    deterministically."""
    o = _t(spark, d, "orders")
    keep = o.where("o_orderkey % 3 = 0").select(
        "o_orderkey", F.lit("keep").alias("v"), F.lit(None).cast("timestamp_ntz").alias("at"))
    at = F.col("o_orderdate").cast("timestamp_ntz")
    rest = o.where("o_orderkey % 3 <> 0")
    versions = [rest.select("o_orderkey", F.lit(v).alias("v"), a.alias("at"))
                for v, a in (("a", at), ("b", at), ("c", F.lit(None).cast("timestamp_ntz")),
                             ("z", at - F.expr("INTERVAL 1 DAY")))]
    for v in versions:
        keep = keep.unionByName(v)
    name = _table_name("orders_latest")
    save_table(keep, name, ["o_orderkey"], on_duplicate="latest", latest_by="at",
               location=scratch_path(spark, "tables"))
    return spark.table(name).select("o_orderkey", "v", "at")


def save_dated(spark, d):
    """K1/K4: date text is parsed on save and the table is partitioned by its day."""
    ev = nest.events_dated(spark, d).select("event_id", "ts_text")
    name = _table_name("events_dated")
    save_table(ev, name, ["event_id"], date_field="ts_text", date_format=DATE_FORMAT,
               location=scratch_path(spark, "tables"))
    return spark.table(name).select("event_id", F.col("ts_text").cast("timestamp_ntz").alias("ts"), "filekey")


def ingest_quoted_names(spark, d):
    """K5: fields whose names need quoting, as child tables and as columns."""
    o = _t(spark, d, "orders")
    doc = o.select("o_orderkey", F.array(F.struct(F.col("o_custkey").alias("v-1"))).alias("a-b"),
                   F.struct(F.col("o_orderstatus").alias("parent_id_hash_col")).alias("x.y"))
    name = _table_name("orders_quoted")
    cfg = IngestConfig(table=name, id_field="o_orderkey", location=scratch_path(spark, "tables"), options=NO_JSON)
    ingest_batch(doc, cfg)
    ingest_batch(doc, cfg)
    a = spark.table(f"{name}_a_b").select(PARENT_ID, F.col("`v-1`").cast("string").alias("v"), CONTENT_HASH)
    b = spark.table(f"{name}_x_y").select(PARENT_ID, F.col("_parent_id_hash_col").alias("v"), CONTENT_HASH)
    return a.unionByName(b)


MAPPING = [
    Mapping("o_orderkey", "order_id", "BIGINT"),
    Mapping("o_totalprice", "total", "STRING"),
    Mapping("o_orderdate", "order_ts", "TIMESTAMP_NTZ"),
    Mapping("customer.c_name", "customer_name", "STRING"),
    Mapping("o_comment", "comment", "STRING"),
]


def project_mapping_q(spark, d):
    """Declared (source path, target column, type) mapping, nested path included."""
    o = _t(spark, d, "orders")
    cust = _t(spark, d, "customer").select(
        "c_custkey", F.struct("c_name", "c_mktsegment").alias("customer"))
    doc = o.join(cust, o.o_custkey == cust.c_custkey, "left")
    return project_mapping(doc, MAPPING)


# ------------------------------------------------------------------ sources / streams


def json_roundtrip(spark, d):
    """Rows written as JSON files and read back with the table's schema."""
    cust = _t(spark, d, "customer")
    path = scratch_path(spark, "json")
    cust.write.json(path)
    return read_json_files(spark, path, schema=cust.schema, multiline=False)


def _array_files(spark, d):
    """Customers as JSON files over several lines, each one top-level array."""
    cust = _t(spark, d, "customer")
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    docs = nest.nest_rows(cust, ["c_nationkey"], cols, "customers", "c_custkey")
    lines = F.regexp_replace(F.to_json("customers"), r"\},\{", "},\n  {")
    path = scratch_path(spark, "json-arrays")
    docs.select(lines.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path, cust.select(cols).schema


def json_array_files(spark, d):
    """Files over several lines with a top-level array: one row per element."""
    path, schema = _array_files(spark, d)
    return read_json_files(spark, path, schema=schema)


def json_whole_files(spark, d):
    """S3: whole files as one text each, parsed as a column, schema inferred."""
    path, schema = _array_files(spark, d)
    return read_json_files(spark, path, wholetext=True).select(schema.names)


def json_text_mixed(spark, d):
    """Good documents, arrays of documents, malformed and scalar texts side by side."""
    ev = _t(spark, d, "events")
    kind = F.col("event_id") % 5
    t = (F.when(kind == 0, F.expr("substring(props, 1, length(props) - 1)"))
          .when(kind == 1, F.col("event_id").cast("string"))
          .when(kind == 2, F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]")))
          .when(kind == 3, F.lit('"x"')).otherwise(F.col("props")))
    return parse_json_column(ev.select("event_id", t.alias("t")), "t")


def json_text_parse(spark, d):
    """A text column of JSON documents parsed with an inferred schema."""
    ev = _t(spark, d, "events").select("event_id", "props")
    return parse_json_column(ev, "props")


def stream_ingest(spark, d):
    """ST1/K5: nested documents arrive as JSON files; a file stream ingests them."""
    doc = nest.nested_orders(spark, d)
    src = scratch_path(spark, "stream-src")
    doc.write.json(src, compression="gzip")
    name = _table_name("orders_stream")
    cfg = IngestConfig(table=name, id_field="o_orderkey", on_duplicate="allow",
                       location=scratch_path(spark, "tables"), options=NO_JSON)
    q = ingest_stream(spark, src, doc.schema, cfg, multiline=False)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.table(f"{name}_items").select(
        "parent_id", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate",
        CONTENT_HASH, "parent_id_hash_col")


def ingest_batch_q(spark, d):
    """K4/K5: flatten and save the whole table family, twice; the second run is a
    keyed upsert of identical rows and must leave the tables unchanged."""
    name = _table_name("orders_ingest")
    cfg = IngestConfig(table=name, id_field="o_orderkey", location=scratch_path(spark, "tables"),
                       options=FlattenOptions(promote_json=False, dedup_main=True))
    with _orders_kept(spark, d) as doc:
        ingest_batch(doc, cfg)
        ingest_batch(doc, cfg)
    return spark.table(name).select(*ORDER_COLS, "id_hash_col", "filekey")


def ingest_append_only(spark, d):
    """K5 with append-only child tables: the second ingest of the same documents
    finds every child key present and writes nothing to them."""
    name = _table_name("orders_append")
    cfg = IngestConfig(table=name, id_field="o_orderkey", location=scratch_path(spark, "tables"),
                       children_append_only=True,
                       options=FlattenOptions(promote_json=False, dedup_main=True))
    with _orders_kept(spark, d) as doc:
        ingest_batch(doc, cfg)
        ingest_batch(doc, cfg)
    return spark.table(f"{name}_items").select(
        "parent_id", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate",
        CONTENT_HASH, "parent_id_hash_col")


def ingest_batch_children(spark, d):
    """K5: both child tables of the family after two ingests of the same documents."""
    name = _table_name("orders_family")
    cfg = IngestConfig(table=name, id_field="o_orderkey", location=scratch_path(spark, "tables"),
                       children_append_only=False, options=NO_JSON)
    with _orders_kept(spark, d) as doc:
        ingest_batch(doc, cfg)
        ingest_batch(doc, cfg)
    cols = [PARENT_ID, CONTENT_HASH, "parent_id_hash_col", "filekey"]
    items, customer = (spark.table(f"{name}_{c}").select(*cols, F.lit(c).alias("child")) for c in ("items", "customer"))
    return items.unionByName(customer)


def stream_family(spark, d):
    """ST1: main and struct child written by a file stream."""
    doc = nest.orders_with_customer(spark, d)
    src = scratch_path(spark, "stream-src")
    doc.write.json(src)
    name = _table_name("orders_streamed")
    cfg = IngestConfig(table=name, id_field="o_orderkey", on_duplicate="allow",
                       location=scratch_path(spark, "tables"), options=NO_JSON)
    q = ingest_stream(spark, src, doc.schema, cfg, multiline=False)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    main = spark.table(name).select(*ORDER_COLS, "id_hash_col")
    child = spark.table(f"{name}_customer").select(PARENT_ID, "c_name", "c_mktsegment", CONTENT_HASH)
    return main.join(child, main.o_orderkey == child.parent_id, "left").drop(PARENT_ID)


def keep_ordinal(spark, d):
    """Q4 option: repeated lines of a document are kept apart by their position."""
    doc = nest.doc_lines(spark, d)
    opts = FlattenOptions(promote_json=False, keep_ordinal=True)
    return flatten(doc, "doc_id", "documents", opts)["documents_lines"]


def flatten_with_nulls(spark, d):
    """Q3 default: nulls are skipped in the hash text (rows with nulls take the
    keyed dedup branch)."""
    doc = nest.labelled_documents(spark, d)
    return flatten(doc, "doc_id", "documents", NO_JSON)["documents_label"]


def null_marker(spark, d):
    """Q3 option: nulls hash as a marker text of their own."""
    doc = nest.labelled_documents(spark, d)
    opts = FlattenOptions(promote_json=False, null_marker="\\N")
    return flatten(doc, "doc_id", "documents", opts)["documents_label"]


def stream_upsert(spark, d):
    """ST1 over several micro-batches: each batch upserts into the tables the
    previous ones wrote (the file list is split in two triggers)."""
    doc = nest.nested_orders(spark, d)
    src = scratch_path(spark, "stream-src")
    doc.write.json(src, compression="gzip")
    files = len(spark.read.text(src).inputFiles())  # a listing: nothing is read
    name = _table_name("orders_stream2")
    cfg = IngestConfig(table=name, id_field="o_orderkey", on_duplicate="allow",
                       location=scratch_path(spark, "tables"), options=NO_JSON)
    q = ingest_stream(spark, src, doc.schema, cfg, multiline=False,
                      max_files_per_trigger=max(1, -(-files // 2)))
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.table(f"{name}_items").select(
        "parent_id", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate",
        CONTENT_HASH, "parent_id_hash_col")


def merge_matched(spark, d):
    """A small batch merged into a large table; only the partitions that hold its keys
    are rewritten, in one further layer."""
    o = _t(spark, d, "orders").select(*ORDER_COLS)
    name = _table_name("orders_merged")
    save_table(o, name, ["o_orderkey"], file_key="first", location=scratch_path(spark, "tables"))
    changed = o.where("o_orderkey % 97 = 0").withColumn("o_totalprice", F.lit(1.0))
    new = changed.withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    save_table(changed.unionByName(new), name, ["o_orderkey"], file_key="second")
    return spark.table(name).select(*ORDER_COLS, "filekey")


def merge_dated(spark, d):
    """K3 on a table by day: rows that move to another day leave their old one."""
    ev = nest.events_dated(spark, d).select("event_id", "ts_text", "ts")
    name = _table_name("events_merged")
    form = dict(date_field="ts_text", date_format=DATE_FORMAT)
    save_table(ev.drop("ts"), name, ["event_id"], location=scratch_path(spark, "tables"), **form)
    moved = ev.where("event_id % 50 = 0").select(
        "event_id", F.date_format(F.col("ts") + F.expr("INTERVAL 40 DAYS"), DATE_FORMAT).alias("ts_text"))
    save_table(moved, name, ["event_id"], **form)
    return spark.table(name).select("event_id", F.col("ts_text").cast("timestamp_ntz").alias("ts"))


def family_commit(spark, d):
    """K5: a family that is written but not committed leaves readers on the old one; the
    commit switches all its tables."""
    name = _table_name("orders_staged")
    cfg = IngestConfig(table=name, id_field="o_orderkey", location=scratch_path(spark, "tables"), options=NO_JSON)
    with _orders_kept(spark, d) as doc:
        ingest_batch(doc, cfg)
        newer = doc.withColumn("o_orderstatus", F.lit("new")).withColumn(
            "customer", F.struct(F.upper("customer.c_name").alias("c_name"), F.col("customer.c_mktsegment").alias("c_mktsegment")))
        with scoped_conf(spark, safe_planning(spark)):
            staged = stage_family(newer, cfg)
    states = []
    for state in ("before", "after"):
        main, child = spark.table(name), spark.table(f"{name}_customer")
        row = main.select("o_orderkey", "o_orderstatus").join(
            child.select(PARENT_ID, "c_name"), F.col("o_orderkey") == F.col(PARENT_ID), "left").drop(PARENT_ID)
        states.append(row.select(F.lit(state).alias("state"), "*"))
        commit(spark, staged, name)
    return states[0].unionByName(states[1])


def stream_replay(spark, d):
    """ST1: a micro-batch delivered twice counts once, documents without an id and texts that
    are no documents included."""
    ev = _t(spark, d, "events")
    doc = F.to_json(F.struct(F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("event_id"), "user_id"))
    texts = ev.select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("no document "), F.col("event_id").cast("string")))
                       .otherwise(doc).alias("t"))
    name = _table_name("events_replayed")
    cfg = IngestConfig(table=name, id_field="event_id", location=scratch_path(spark, "tables"), options=NO_JSON)
    for batch in (0, 0):
        ingest_json_column(texts, "t", cfg, {"events": batch})
    good = spark.table(name).select("event_id", "user_id", F.lit(None).cast("string").alias("_corrupt_record"))
    bad = spark.table(f"{name}_corrupt").select(F.lit(None).cast("long").alias("event_id"),
                                                F.lit(None).cast("long").alias("user_id"), "_corrupt_record")
    return good.unionByName(bad)


def stream_drift(spark, d):
    """ST1: documents that gain fields (one nested) between two micro-batches; every batch infers
    its own schema and the tables grow."""
    ev = _t(spark, d, "events")
    src = scratch_path(spark, "drift-src")
    first = ev.where("event_id % 2 = 0").select(F.to_json(F.struct("event_id", "event_type")))
    then = ev.where("event_id % 2 = 1").select(F.to_json(F.struct(
        "event_id", "event_type", "user_id", F.struct(F.col("user_id").alias("who")).alias("extra"))))
    first.write.text(src)
    files = len(spark.read.text(src).inputFiles())  # a listing: nothing is read
    then.write.mode("append").text(src)
    name = _table_name("events_drifted")
    cfg = IngestConfig(table=name, id_field="event_id", location=scratch_path(spark, "tables"), options=NO_JSON)
    q = ingest_text_stream(spark, src, cfg, multiline=False, max_files_per_trigger=files)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    child = spark.table(f"{name}_extra").select(PARENT_ID, "who")
    main = spark.table(name).select("event_id", "event_type", "user_id")
    return main.join(child, F.col("event_id") == F.col(PARENT_ID), "left").drop(PARENT_ID)


def nested_evolution(spark, d):
    """A batch brings fields inside a struct and inside an array of structs; rows that were
    there before have typed nulls in them."""
    c = _t(spark, d, "customer")
    name = _table_name("customers_evolved")
    old = c.select("c_custkey", F.struct("c_name").alias("info"),
                   F.array(F.struct(F.col("c_nationkey").alias("nation"))).alias("places"))
    save_table(old, name, ["c_custkey"], location=scratch_path(spark, "tables"))
    new = c.where("c_custkey % 3 = 0").select(
        "c_custkey", F.struct("c_mktsegment", F.upper("c_name").alias("c_name")).alias("info"),
        F.array(F.struct(F.col("c_nationkey").alias("nation"), F.struct("c_mktsegment").alias("more"))).alias("places"))
    save_table(new, name, ["c_custkey"])
    return spark.table(name).select(
        "c_custkey", "info.c_name", "info.c_mktsegment", F.col("places")[0]["nation"].alias("nation"),
        F.col("places")[0]["more"]["c_mktsegment"].alias("segment"))


def json_text_case(spark, d):
    """Keys that differ only in case, null texts, and arrays with elements that are no
    documents; none of them changes what its neighbours give."""
    ev = _t(spark, d, "events")
    kind = F.col("event_id") % 5
    k = F.regexp_extract("props", r"(\d+)", 1)
    t = (F.when(kind == 0, F.concat(F.lit('{"K": '), k, F.lit(', "k": 1}')))
          .when(kind == 1, F.concat(F.lit('{"K": '), k, F.lit("}")))
          .when(kind == 2, F.concat(F.lit("["), "props", F.lit(", 5]")))
          .when(kind == 3, F.lit(None)).otherwise(F.col("props")))
    return parse_json_column(ev.select("event_id", t.alias("t")), "t")


def promote_malformed(spark, d):
    """Malformed texts of a promoted column give no child row, with or without an array
    elsewhere in the column."""
    ev = _t(spark, d, "events")
    bad = F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)"))
    objects = ev.select("event_id", bad.otherwise(F.col("props")).alias("props"))
    mixed = ev.select("event_id", bad.when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit("]")))
                                     .otherwise(F.col("props")).alias("props"))
    parts = [flatten(x, "event_id", "events")["events_props"].select(F.lit(n).alias("variant"), PARENT_ID, "k")
             for n, x in (("objects", objects), ("mixed", mixed))]
    return parts[0].unionByName(parts[1])


def json_maps(spark, d):
    """Objects keyed by ids become maps, so the inferred type does not grow."""
    ev = _t(spark, d, "events")
    t = F.to_json(F.struct("event_id", F.create_map(
        F.concat(F.lit("user "), F.col("event_id").cast("string")), F.struct("user_id", "event_type")).alias("seen")))
    seen = parse_json_column(ev.select(t.alias("t")), "t", keep_corrupt=False, map_keys=100)
    seen = seen.select("event_id", F.explode("seen").alias("who", "what"))
    return seen.select("event_id", "who", "what.user_id", "what.event_type")


def json_giant_array(spark, d):
    """Files that hold one array each, read in byte ranges by many tasks."""
    path, schema = _array_files(spark, d)
    return read_json_arrays(spark, path, block_bytes=64 << 10).select(schema.names)


def rebuild_documents_q(spark, d):
    """Parent/child reader: documents put together again from the family, bucket by bucket."""
    name = _table_name("orders_rebuilt")
    cfg = IngestConfig(table=name, id_field="o_orderkey", location=scratch_path(spark, "tables"), options=NO_JSON)
    with _orders_kept(spark, d) as doc:
        ingest_batch(doc, cfg)
    out = rebuild_documents(spark, name, "o_orderkey", doc.schema)
    return out.select("o_orderkey", "o_custkey", "o_totalprice", "customer.c_name", F.size("items").alias("n_items"),
                      F.aggregate("items", F.lit(0.0), lambda a, i: a + i["l_quantity"]).alias("quantity"))


def skip_empty_q(spark, d):
    """L2: child tables without rows are not created; the counts come from the writes."""
    name = _table_name("orders_some")
    cfg = IngestConfig(table=name, id_field="o_orderkey", location=scratch_path(spark, "tables"),
                       options=FlattenOptions(promote_json=False, skip_empty=True))
    with _orders_kept(spark, d) as doc:
        tables = ingest_batch(doc.withColumn("none", F.filter("items", lambda i: F.lit(False))), cfg)
    out = [spark.table(t).agg(F.lit(t[len(name):]).alias("child"), F.count(F.lit(1)).alias("n")) for t in tables]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def managed_columns(spark, d):
    """Columns at the root that are named like managed ones are not walked."""
    doc = nest.orders_with_customer(spark, d)
    doc = doc.withColumn(CONTENT_HASH, F.array(F.lit(1))).withColumn(PARENT_ID, F.struct(F.lit(2).alias("x")))
    tables = flatten(doc, "o_orderkey", "orders", NO_JSON)
    names = F.lit(",".join(sorted(tables)))
    return tables["orders_customer"].select(PARENT_ID, "c_name", names.alias("tables"))


def ingest_mapped_q(spark, d):
    """Two tables by declared mappings, in two batches; the second updates by key and brings
    a further column."""
    doc = nest.orders_with_customer(spark, d)
    names = [_table_name(n) for n in ("orders_mapped", "buyers_mapped")]
    cfg = IngestConfig(table=names[0], id_field="o_orderkey", location=scratch_path(spark, "tables"))
    orders = [("o_orderkey", "order_id", "BIGINT"), ("o_totalprice", "total", "STRING"), ("no.such", "note", "STRING")]
    buyers = [("o_orderkey", "order_id", "BIGINT"), ("customer.c_name", "buyer", "STRING")]
    ingest_mapped(doc, dict(zip(names, (orders, buyers))), cfg)
    more = [*orders, ("o_orderstatus", "status", "STRING")]
    ingest_mapped(doc.where("o_orderkey % 3 = 0"), dict(zip(names, (more, buyers))), cfg)
    main, child = (spark.table(n).drop("filekey") for n in names)
    return main.join(child, "order_id")


def catalog_names(spark, d):
    """A table under its qualified, snake-cased name does not exist, is saved, exists."""
    name = qualified_name(f"My-Customers{uuid.uuid4().hex[:8]}.json")
    before = table_exists(spark, name)
    save_table(_t(spark, d, "customer").select("c_custkey", "c_name"), name, ["c_custkey"],
               location=scratch_path(spark, "tables"))
    prefix = name[:len("my__customers")]
    return spark.table(name).select("c_custkey", "c_name", F.lit(prefix).alias("prefix"), F.lit(before).alias("before"),
                                    F.lit(table_exists(spark, name)).alias("after"))


def sorted_files(spark, d):
    """O1/O2: every file of a saved main and child table is sorted by its key, over two layers."""
    name = _table_name("orders_sorted")
    cfg = IngestConfig(table=name, id_field="o_orderkey", location=scratch_path(spark, "tables"), options=NO_JSON)
    with _orders_kept(spark, d) as doc:
        ingest_batch(doc.where("o_orderkey % 4 <> 0"), cfg)
        ingest_batch(doc.where("o_orderkey % 4 = 0"), cfg)
    out = []
    for table, key in ((name, "o_orderkey"), (f"{name}_items", PARENT_ID)):
        files = spark.read.parquet(*spark.table(table).inputFiles()).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), F.col(key).alias("key"))
        below = F.col("key") < F.lag("key").over(Window.partitionBy("file").orderBy("at"))
        out.append(files.withColumn("below", below.cast("int")).agg(
            F.lit("main" if table == name else "items").alias("part"), F.count(F.lit(1)).alias("n"),
            F.sum(F.coalesce("below", F.lit(0))).alias("out_of_order")))
    return out[0].unionByName(out[1])


def jdbc_bounds(spark, d):
    """The reader finds the key's bounds itself; rows without a key are read too."""
    url = f"jdbc:derby:memory:shredkit_{uuid.uuid4().hex[:8]};create=true"
    drv = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    customers = _t(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey")).alias("k"), "c_custkey", "c_nationkey")
    customers.write.format("jdbc").option("url", url).option("driver", drv).option("dbtable", "customer").save()
    return read_jdbc_query(spark, url, "SELECT * FROM customer", drv, partition_column="k", num_partitions=4)


def jdbc_query(spark, d):
    """A SQL query run over JDBC (embedded in-memory Derby, this process only),
    read in parallel range partitions."""
    url = f"jdbc:derby:memory:shredkit_{uuid.uuid4().hex[:8]};create=true"
    drv = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    nation = _t(spark, d, "nation")
    nation.write.format("jdbc").option("url", url).option("driver", drv) \
        .option("dbtable", "nation").mode("overwrite").save()
    q = 'SELECT "n_nationkey", "n_name", "n_regionkey" FROM nation'
    return read_jdbc_query(spark, url, q, drv, partition_column="n_nationkey",
                           lower_bound=0, upper_bound=25, num_partitions=4)


def queries() -> dict[str, Query]:
    return {
        "flatten_struct_array": flatten_struct_array,
        "flatten_struct": flatten_struct,
        "flatten_main": flatten_main,
        "flatten_value_array": flatten_value_array,
        "flatten_float_array": flatten_float_array,
        "flatten_two_levels": flatten_two_levels,
        "flatten_nested_parent": flatten_nested_parent,
        "flatten_row_index": flatten_row_index,
        "flatten_threads": flatten_threads,
        "promote_json": promote_json,
        "json_text_parse": json_text_parse,
        "content_hash": content_hash_q,
        "murmur_hash": murmur_hash,
        "parse_date": parse_date_q,
        "align_schema": align_schema_q,
        "merge_upsert": merge_upsert_q,
        "save_and_upsert": save_and_upsert,
        "append_evolve": append_evolve,
        "project_mapping": project_mapping_q,
        "snake_case": snake_case_q,
        "hex_decode": hex_decode,
        "dedup_children": dedup_children_q,
        "json_roundtrip": json_roundtrip,
        "stream_ingest": stream_ingest,
        "stream_upsert": stream_upsert,
        "jdbc_query": jdbc_query,
        "with_file_key": with_file_key_q,
        "root_array": root_array,
        "ingest_batch": ingest_batch_q,
        "ingest_append_only": ingest_append_only,
        "keep_ordinal": keep_ordinal,
        "flatten_with_nulls": flatten_with_nulls,
        "null_marker": null_marker,
        "dedup_separator": dedup_separator,
        "flatten_null_elements": flatten_null_elements,
        "flatten_null_struct": flatten_null_struct,
        "promote_mixed": promote_mixed,
        "promote_big_ints": promote_big_ints,
        "hash_json": hash_json,
        "upsert_latest": upsert_latest,
        "save_dated": save_dated,
        "ingest_quoted_names": ingest_quoted_names,
        "json_array_files": json_array_files,
        "json_whole_files": json_whole_files,
        "json_text_mixed": json_text_mixed,
        "ingest_batch_children": ingest_batch_children,
        "stream_family": stream_family,
        "merge_matched": merge_matched,
        "merge_dated": merge_dated,
        "family_commit": family_commit,
        "stream_replay": stream_replay,
        "stream_drift": stream_drift,
        "nested_evolution": nested_evolution,
        "json_text_case": json_text_case,
        "promote_malformed": promote_malformed,
        "json_maps": json_maps,
        "json_giant_array": json_giant_array,
        "rebuild_documents": rebuild_documents_q,
        "skip_empty": skip_empty_q,
        "managed_columns": managed_columns,
        "jdbc_bounds": jdbc_bounds,
        "ingest_mapped": ingest_mapped_q,
        "catalog_names": catalog_names,
        "sorted_files": sorted_files,
    }
