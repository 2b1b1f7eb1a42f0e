"""The driver's queries on keyed tables and on SQL over them, each with the same
query for DuckDB where SQL can express it."""

from __future__ import annotations

import atexit
import re
import shutil
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .errors import StoreError
from .functions.encoding import lognormal_cdf, long_digest, row_digest
from .functions.text import glob, julian_day
from .model import ROW_ID, KeyedSchema, parse_key_columns
from .operators.diff import snapshot_diff
from .operators.keyed import compare_keys, duplicate_keys, key_of, max_key
from .operators.merge import insert_rows, merge_changes
from .plans.access import select_access_path
from .plans.shape import inspect_node, snapshot_chunks, table_info, tree_edges, tree_nodes
from .sources.csvio import read_csv
from .sources.memory import MemoryTable
from .sql import explain, query
from .store import Snapshot, Store, with_row_ids
from .streaming.merge import merge_stream

#: Key columns of the test tables; lines of an order repeat, so they are numbered.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_regionkey", "n_nationkey"], "customer": ["c_nationkey", "c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_row"], "events": ["user_id", "event_id"],
}

_STORES: dict[tuple[str, str], Store] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> Store:
    """One store per session and folder; each test table is loaded when it is
    first named, so the last commit has all that were."""
    at = (spark.sparkContext.applicationId, str(sf_dir))
    if at not in _STORES:
        root = files.work_folder(spark)
        if not spark.conf.get("spark.checkpoint.dir", None):
            atexit.register(shutil.rmtree, root, True)
        _STORES[at] = Store(spark, root)
    store = _STORES[at]
    for name in names:
        if store.head() is None or name not in store.commit().tables:
            rows = _read(spark, sf_dir, name)
            if name == "lineitem":
                rows = with_row_ids(rows).withColumn("l_row", F.col(ROW_ID))
            store.write_table(name, rows, KEYS[name])
    return store


def table(spark: SparkSession, sf_dir: str, name: str) -> Snapshot:
    """A test table as a keyed table."""
    return catalog(spark, sf_dir, [name]).snapshot(name)


def _scratch(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> Store:
    """A store of its own for a query that writes."""
    root = files.work_folder(spark)
    store = Store(spark, root)
    store.write_table(name, _read(spark, sf_dir, name), KEYS[name], partitions=partitions)
    return store


def _orders(*constraints: tuple[str, str, object]):
    return lambda spark, sf_dir: table(spark, sf_dir, "orders").scan(constraints)


def _customers(*constraints: tuple[str, str, object]):
    return lambda spark, sf_dir: table(spark, sf_dir, "customer").scan(constraints)


def _top(name: str, order: str, n: int, *constraints):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, name).scan(constraints).orderBy(*[F.expr(o.strip().rsplit(" ", 1)[0]).desc_nulls_last() if o.strip().endswith(" DESC") else F.expr(o.strip()).asc_nulls_first() for o in order.split(",")]).limit(n)

    return run


def _changes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Changes by key: deletes where the key modulo 10 is 0, updates at 1,
    inserts of key + 1,000,000 at 2."""
    rows = with_row_ids(_read(spark, sf_dir, "customer"))
    columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    pick = lambda m: rows.where(F.col("c_custkey") % 10 == m)
    deleted = pick(0).select(F.lit("D").alias("op"), ROW_ID, *columns)
    updated = pick(1).withColumn("c_acctbal", F.col("c_acctbal") + 1.0).withColumn("c_mktsegment", F.lit("CHANGED")).select(F.lit("U").alias("op"), ROW_ID, *columns)
    inserted = pick(2).withColumn("c_custkey", F.col("c_custkey") + 1_000_000).select(F.lit("I").alias("op"), (F.col(ROW_ID) + 1_000_000).alias(ROW_ID), *columns)
    return {"I": inserted, "U": updated, "D": deleted}


def _merge(ops: str, partitions: int | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store, changes = _scratch(spark, sf_dir, "customer", partitions), _changes(spark, sf_dir)
        batch = None
        for op in ops:
            batch = changes[op] if batch is None else batch.unionByName(changes[op])
        merge_changes(store, "customer", batch)
        return store.snapshot("customer").scan()

    return run


_KEPT = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
_MERGED = {
    "I": "{k} UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 2",
    "U": "{k} WHERE c_custkey % 10 <> 1 UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1.0::DOUBLE, 'CHANGED' FROM customer WHERE c_custkey % 10 = 1",
    "D": "{k} WHERE c_custkey % 10 <> 0",
    "UD": "{k} WHERE c_custkey % 10 NOT IN (0, 1) UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1.0::DOUBLE, 'CHANGED' FROM customer WHERE c_custkey % 10 = 1",
    "IUD": "{k} WHERE c_custkey % 10 NOT IN (0, 1) UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1.0::DOUBLE, 'CHANGED' FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 2",
}

_PLANS = [
    ("full_scan", 1, []),
    ("key_eq", 1, [("k0", "=")]),
    ("key_range", 1, [("k0", ">=")]),
    ("eq_over_range", 1, [("k0", ">"), ("k0", "=")]),
    ("non_key", 1, [("v", "=")]),
    ("prefix_eq", 2, [("k0", "=")]),
    ("prefix_range", 2, [("k0", "="), ("k1", ">")]),
    ("whole_key", 2, [("k0", "="), ("k1", "=")]),
    ("skipped_part", 2, [("k1", "=")]),
]


def access_plan_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for total in (table(spark, sf_dir, "orders").row_count(), 0, 7, 15, 25):
        for case, n, candidates in _PLANS:
            names = [f"k{i}" for i in range(n)]
            schema = KeyedSchema.of(T.StructType([T.StructField(c, T.LongType()) for c in [*names, "v"]]), names)
            plan = select_access_path(schema, candidates, total)
            rows.append((case, total, len(plan.search), plan.estimated_rows, round(plan.estimated_cost, 6)))
    return spark.createDataFrame(rows, "plan_case string, total long, slots int, estimated_rows long, estimated_cost double")


_PLANS_SQL = """
WITH n AS (SELECT count(*) AS total FROM orders UNION ALL SELECT unnest([0, 7, 15, 25])),
c AS (SELECT * FROM (VALUES ('full_scan', 0, 0, false, false), ('key_eq', 1, 1, false, true), ('key_range', 1, 0, true, false), ('eq_over_range', 1, 1, false, true),
  ('non_key', 0, 0, false, false), ('prefix_eq', 1, 1, false, false), ('prefix_range', 2, 1, true, false), ('whole_key', 2, 2, false, true),
  ('skipped_part', 0, 0, false, false)) AS c(plan_case, slots, eq, rng, full_key)),
x AS (SELECT *, greatest(total, 1)::DOUBLE AS t FROM n, c),
y AS (SELECT *, CASE WHEN full_key THEN greatest(log2(t), 1) WHEN slots = 0 THEN t ELSE greatest(t / pow(10, eq) * CASE WHEN rng THEN 0.5 ELSE 1 END, 1) END AS cost FROM x)
SELECT plan_case, total, CAST(slots AS INTEGER) AS slots, CASE WHEN full_key THEN 1 ELSE CAST(round(cost) AS BIGINT) END AS estimated_rows, round(cost, 6) AS estimated_cost FROM y
"""


def duplicate_key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of three commits of one table, read back by commit."""
    store, changes = _scratch(spark, sf_dir, "customer"), _changes(spark, sf_dir)
    commits = [store.head(), merge_changes(store, "customer", changes["D"]), merge_changes(store, "customer", changes["I"])]
    parts = [store.snapshot("customer", tx).scan().agg(F.lit(i).alias("version"), F.count(F.lit(1)).alias("n")) for i, tx in enumerate(commits)]
    return parts[0].union(parts[1]).union(parts[2])


def key_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").scan().select("o_orderkey", long_digest(F.col("o_orderkey")).alias("digest"))


def typed_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests over columns of all seven types, nulls among them."""
    rows = table(spark, sf_dir, "supplier").scan().select(
        "s_suppkey", "s_name", "s_nationkey", "s_acctbal",
        (F.col("s_nationkey") > 10).alias("flag"), (F.col("s_nationkey") / 4).cast("float").alias("real"), F.encode("s_name", "UTF-8").alias("raw"),
        F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")).alias("some"),
    )
    return rows.select("s_suppkey", row_digest(rows.schema, rows.columns).alias("digest"))


_TYPED_SQL = """
WITH x AS (SELECT *, s_nationkey > 10 AS flag, CAST(s_nationkey / 4 AS FLOAT) AS rl, CASE WHEN s_nationkey % 2 = 0 THEN s_name END AS txt FROM supplier)
SELECT s_suppkey, sha256(unhex(
  '03' || {suppkey} || '06' || {size} || hex(encode(s_name)) || '02' || {nation} || '05' || {acctbal} ||
  CASE WHEN flag THEN '0101' ELSE '0100' END || '04' || {rl} || '07' || {size} || hex(encode(s_name)) ||
  CASE WHEN txt IS NULL THEN '00' ELSE '06' || {size} || hex(encode(txt)) END)) AS digest FROM x
""".format(
    **{
        k: f"array_to_string(list_reverse(regexp_extract_all(hex(CAST(CAST({v} AS BIT) AS BLOB)), '..')), '')"
        for k, v in {"suppkey": "s_suppkey::BIGINT", "nation": "s_nationkey::INTEGER", "acctbal": "s_acctbal::DOUBLE", "rl": "rl", "size": "octet_length(encode(s_name))::BIGINT"}.items()
    }
)


def _tree(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, DataFrame, DataFrame]:
    """The tree over the keys of orders; made once per session and folder."""
    snapshot = table(spark, sf_dir, "orders")
    at = (snapshot.store.root, snapshot.tx_id)
    if at not in _TREES:
        path = files.work_folder(spark)
        leaves = snapshot_chunks(snapshot, [], 300, 60)
        leaves.write.parquet(f"{path}/leaves")
        leaves = spark.read.parquet(f"{path}/leaves")
        tree_nodes(leaves, 300, 60).write.parquet(f"{path}/nodes")
        _TREES[at] = (leaves, spark.read.parquet(f"{path}/nodes"))
    return (snapshot, *_TREES[at])


_TREES: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _leaf_bounds(leaves: DataFrame) -> DataFrame:
    key = lambda c: F.get_json_object(c, "$[0]").cast("long")
    return leaves.select("node_id", "row_count", key("min_key").alias("low"), key("max_key").alias("high"))


def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all leaves together must agree with: every row is in one, none is
    empty, and the mean chunk is within 15 % of the target."""
    return _leaf_bounds(_tree(spark, sf_dir)[1]).agg(
        F.sum("row_count").alias("total_rows"), F.min("low").alias("first_key"), F.max("high").alias("last_key"),
        F.count_if(F.col("row_count") < 1).alias("empty_leaves"), (F.abs(F.sum("row_count") * 9 / F.count(F.lit(1)) - 300) < 45).alias("near_target"),
    )


def leaf_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of every order, found by key range, against what they say of
    themselves. Ranges are cut at multiples of 1000, so that the join has a key."""
    snapshot, leaves, _ = _tree(spark, sf_dir)
    bounds = _leaf_bounds(leaves)
    cell = lambda c: F.floor(F.col(c) / 1000)
    cells = bounds.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    orders = snapshot.scan().select(F.col("o_orderkey").alias("k")).withColumn("cell", cell("k"))
    found = orders.join(cells, "cell").where((F.col("k") >= F.col("low")) & (F.col("k") <= F.col("high")))
    found = found.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("a"), F.max("k").alias("b"))
    right = (F.col("n") == F.col("row_count")) & (F.col("a") == F.col("low")) & (F.col("b") == F.col("high"))
    return bounds.join(found, "node_id", "left").agg(F.sum("n").alias("members"), F.count_if(~F.coalesce(right, F.lit(False))).alias("wrong_leaves"))


def tree_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the same rows in other files, and of rows that came by merges,
    against the leaves of the loaded table: none differs."""
    snapshot, leaves, _ = _tree(spark, sf_dir)
    store = Store(spark, files.work_folder(spark))
    rows = snapshot.stored()
    store.write_table("orders", rows.where("o_orderkey % 3 <> 0"), ["o_orderkey"], partitions=5)
    merge_changes(store, "orders", rows.where("o_orderkey % 3 = 0").withColumn("op", F.lit("I")))
    other = snapshot_chunks(store.snapshot("orders"), [], 300, 60)
    ours, theirs = leaves.select("node_id"), other.select(F.col("node_id").alias("other"))
    both = ours.join(theirs, ours["node_id"] == theirs["other"], "full_outer")
    return both.agg(F.count_if(F.col("node_id").isNull() | F.col("other").isNull()).alias("different"), F.lit(store.snapshot("orders").row_count()).cast("long").alias("total_rows"))


def tree_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, _, nodes = _tree(spark, sf_dir)
    info = table_info(spark, [snapshot], nodes)
    root = nodes.where("parent_id is null").select(F.col("node_id").alias("root_node"), "row_count", "level")
    return info.join(root, "root_node").select("name", "columns", "key_columns", "total_rows", "row_count", (F.col("tree_depth") == F.col("level")).alias("depth_of_root"), (F.col("tree_depth") > 0).alias("deep"))


def tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge leads from a node to one a level lower, and a node's rows are its children's."""
    nodes = _tree(spark, sf_dir)[2]
    end = lambda side: nodes.select(F.col("node_id").alias(side), F.col("level").alias(f"{side}_level"), F.col("row_count").alias(f"{side}_rows"))
    edges = tree_edges(nodes).join(end("source"), "source").join(end("target"), "target")
    sums = edges.groupBy("source").agg(F.first("source_rows").alias("own"), F.sum("target_rows").alias("below"), F.count_if(F.col("target_level") != F.col("source_level") - 1).alias("skips"))
    total = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("parent_id").isNull()).alias("roots"), F.sum(F.when(F.col("level") == 0, F.col("row_count"))).alias("leaf_rows"))
    edge_count = tree_edges(nodes).agg(F.count(F.lit(1)).alias("edges"))
    wrong = sums.agg(F.count_if(F.col("own") != F.col("below")).alias("wrong_sums"), F.sum("skips").alias("skips"))
    return total.join(edge_count).join(wrong).select("leaf_rows", "roots", (F.col("nodes") - F.col("edges")).alias("nodes_less_edges"), "wrong_sums", "skips")


def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and key bounds of a table from its manifest alone."""
    return table(spark, sf_dir, "orders").manifest().agg(F.sum("rows").alias("n"), F.min("min_key.o_orderkey").alias("low"), F.max("max_key.o_orderkey").alias("high"))


def csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through CSV: written, read with inference, loaded and scanned."""
    root = files.work_folder(spark)
    _read(spark, sf_dir, "supplier").write.option("header", True).csv(f"{root}/csv")
    rows = read_csv(spark, f"{root}/csv")
    store = Store(spark, f"{root}/store")
    store.write_table("supplier", rows, parse_key_columns("0", rows.columns))
    return store.snapshot("supplier").scan()


def insert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of new keys appended without row numbers; they go on from the table's."""
    store = _scratch(spark, sf_dir, "nation")
    more = _read(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey") + 100)
    insert_rows(store, "nation", more)
    return store.snapshot("nation").stored().select("n_nationkey", "n_name", "n_regionkey", (F.col(ROW_ID) >= 25).alias("new_row"))


def diff_of_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merged batch changed, found from the two snapshots."""
    store, changes = _scratch(spark, sf_dir, "customer"), _changes(spark, sf_dir)
    before = store.snapshot("customer")
    merge_changes(store, "customer", changes["I"].unionByName(changes["U"]).unionByName(changes["D"]))
    return snapshot_diff(before, store.snapshot("customer")).select("op", "c_custkey", "c_mktsegment")


def csv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file without a header: whole numbers, reals, booleans, text with quotes
    and commas, empty fields; keyed by place, then scanned by generated names."""
    root = files.work_folder(spark)
    rows = _read(spark, sf_dir, "nation").select(
        F.concat(F.col("n_name"), F.lit(', "the')).alias("a"), "n_nationkey", (F.col("n_nationkey") / 4).alias("b"), F.when(F.col("n_regionkey") < 2, "true").otherwise("false").alias("c"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("d"),
    )
    rows.write.option("escape", '"').option("emptyValue", "").csv(f"{root}/csv")
    loaded = read_csv(spark, f"{root}/csv", header=False)
    store = Store(spark, f"{root}/store")
    store.write_table("people", loaded, parse_key_columns("1,col_0", loaded.columns))
    kinds = ",".join(t for _, t in loaded.dtypes)
    return store.snapshot("people").scan().select("col_0", "col_1", "col_2", "col_3", "col_4", F.lit(kinds).alias("kinds"))


def stream_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two change feeds merged by Structured Streaming, each with a checkpoint of
    its own; the first is started again at the end and has nothing left to do."""
    store, changes = _scratch(spark, sf_dir, "customer"), _changes(spark, sf_dir)
    for op in ("U", "D", "U"):
        feed = f"{store.root}/feed-{op}"
        if not files.exists(spark, feed):
            changes[op].write.parquet(feed)
        stream = spark.readStream.schema(changes[op].schema).parquet(feed)
        merge_stream(store, "customer", stream, f"{store.root}/offsets-{op}").awaitTermination()
    return store.snapshot("customer").scan()


def replayed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that comes again under its mark changes nothing; under the mark of
    another stream it is a batch like any other."""
    store, changes = _scratch(spark, sf_dir, "nation"), _read(spark, sf_dir, "nation")
    batch = with_row_ids(changes).withColumn("op", F.lit("U")).withColumn("n_name", F.lower("n_name"))
    commits = [merge_changes(store, "nation", batch, mark) for mark in (("a", 0), ("a", 0), ("b", 0), ("b", 1), ("a", 0))]
    new = [i == 0 or c != commits[i - 1] for i, c in enumerate(commits)]
    return spark.createDataFrame(list(enumerate(new)), "step long, commits boolean")


def memory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table without a store: constrained, merged, and read in key order."""
    held = MemoryTable.of(_read(spark, sf_dir, "nation"), KEYS["nation"])
    changes = held.stored().withColumn("op", F.when(F.col("n_nationkey") % 5 == 0, "D").otherwise("U")).withColumn("n_name", F.lower("n_name"))
    return held.merge(changes).ordered([("n_regionkey", ">=", 1), ("n_regionkey", "<", 4)])


def key_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's key against a fixed one, and the greater of the two."""
    fixed = F.struct(F.lit(12).alias("c_nationkey"), F.lit(70).cast("long").alias("c_custkey"))
    own = key_of(["c_nationkey", "c_custkey"])
    both = table(spark, sf_dir, "customer").scan().select("c_custkey", compare_keys(own, fixed).alias("sign"), max_key(own, fixed).alias("most"))
    return both.select("c_custkey", "sign", F.col("most.c_nationkey").alias("most_nation"), F.col("most.c_custkey").alias("most_cust"))


def lognormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution function of chunk lengths at every size of a part."""
    cdf = F.udf(lambda x: round(lognormal_cdf(x, 3.0, 0.5), 6), "double")
    return table(spark, sf_dir, "part").scan().select("p_size").distinct().select("p_size", cdf("p_size").alias("p"))


_LOGNORMAL_SQL = """
WITH x AS (SELECT DISTINCT p_size, (ln(p_size) - 3.0) / 0.5 AS z FROM part WHERE p_size > 0),
s AS (SELECT p_size, z, unnest(generate_series(0, 2000)) AS i FROM x),
w AS (SELECT p_size, z, i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * i / 2000, 2) / 2) AS y FROM s)
SELECT p_size, round(0.5 + any_value(z) / 2000 / 3 * sum(y ORDER BY i) / sqrt(2 * pi()), 6) AS p FROM w GROUP BY p_size
"""


def error_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each wrong call is refused with; the store stays as it was."""
    store, nation = _scratch(spark, sf_dir, "nation"), _read(spark, sf_dir, "nation")
    before = store.head()
    change = lambda op, key: with_row_ids(nation.where("n_nationkey = 3").withColumn("n_nationkey", F.lit(key).cast("int"))).withColumn("op", F.lit(op))
    nested = nation.select("n_nationkey", F.array("n_name").alias("names"))
    calls = {
        "absent table": lambda: store.snapshot("none"),
        "absent commit": lambda: store.commit("F00"),
        "key twice": lambda: store.write_table("t", nation.union(nation), ["n_nationkey"]),
        "null key": lambda: store.write_table("t", nation.withColumn("n_nationkey", F.lit(None).cast("int")), ["n_nationkey"]),
        "no rows": lambda: store.write_table("t", nation.where("false"), ["n_nationkey"]),
        "absent key column": lambda: store.write_table("t", nation, ["none"]),
        "nested column": lambda: store.write_table("t", nested, ["n_nationkey"]),
        "insert stored": lambda: merge_changes(store, "nation", change("I", 3)),
        "update absent": lambda: merge_changes(store, "nation", change("U", 333)),
        "delete absent": lambda: merge_changes(store, "nation", change("D", 333)),
        "two changes": lambda: merge_changes(store, "nation", change("U", 3).union(change("D", 3))),
        "wrong op": lambda: merge_changes(store, "nation", change("X", 3)),
        "null in change": lambda: merge_changes(store, "nation", change("D", None)),
        "column lacking": lambda: merge_changes(store, "nation", change("U", 3).drop("n_name")),
        "stale commit": lambda: store.publish(store.table("nation"), "F00"),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
            rows.append((name, "none"))
        except StoreError as e:
            rows.append((name, type(e).__name__))
    rows.append(("nothing changed", str(store.head() == before)))
    return spark.createDataFrame(rows, "wrong_call string, error string")


_ERRORS_SQL = """SELECT * FROM (VALUES ('absent table', 'NoSuchTable'), ('absent commit', 'NoSuchTransaction'), ('key twice', 'DuplicateKey'), ('null key', 'NullKey'),
  ('no rows', 'InvalidArgs'), ('absent key column', 'MissingKeyColumn'), ('nested column', 'UnsupportedFieldType'), ('insert stored', 'DuplicateKey'), ('update absent', 'KeyNotFound'),
  ('delete absent', 'KeyNotFound'), ('two changes', 'DuplicateKey'), ('wrong op', 'InvalidArgs'), ('null in change', 'NullKey'), ('column lacking', 'SchemaMismatch'),
  ('stale commit', 'CommitConflict'), ('nothing changed', 'True')) AS t(wrong_call, error)"""


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the plan of a lookup says: its predicate reaches the Parquet scan and
    only the columns asked for are read."""
    store = catalog(spark, sf_dir, ["orders"])
    plan = explain(query(store, "SELECT o_totalprice FROM orders WHERE o_orderkey = 77"))
    pushed = re.search(r"PushedFilters: \[.*EqualTo\(o_orderkey,77\)", plan) is not None
    read = sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)))
    return spark.createDataFrame([(pushed, ";".join(read))], "pushed boolean, read_schema string")


def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").scan()
    return names.where(glob(F.col("c_name"), "Customer#*[13579]?[^0-4]")).select("c_custkey", "c_name")


def julian_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").scan().select("o_orderkey", F.round(julian_day(F.col("o_orderdate")), 5).alias("jd"))


def commit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each commit is from the current one, and what it lists."""
    store, changes = _scratch(spark, sf_dir, "customer"), _changes(spark, sf_dir)
    store.write_table("nation", _read(spark, sf_dir, "nation"), KEYS["nation"])
    merge_changes(store, "customer", changes["D"])
    order = W.orderBy(F.desc("ts_us"))
    return store.history().select(F.row_number().over(order).alias("age"), F.array_join("tables", ",").alias("tables"), F.col("prev_id").isNull().alias("is_first"))


def node_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of the digest tree with its children."""
    _, _, nodes = _tree(spark, sf_dir)
    root = inspect_node(nodes, nodes.where("parent_id is null").first()["node_id"])
    return root.select("node_type", "row_count", "min_key", "max_key", (F.size("children") == F.col("num_keys") + 1).alias("all_children"))


_O = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
_C = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"

NATIVE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "full_scan": (_orders(), _O),
    "count_rows": (lambda s, d: table(s, d, "orders").scan().agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM orders"),
    "manifest_counts": (manifest_counts, "SELECT count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders"),
    "key_eq": (_orders(("o_orderkey", "=", 77)), f"{_O} WHERE o_orderkey = 77"),
    "key_eq_absent": (_orders(("o_orderkey", "=", -100)), f"{_O} WHERE o_orderkey = -100"),
    "key_gt": (_orders(("o_orderkey", ">", 700)), f"{_O} WHERE o_orderkey > 700"),
    "key_ge": (_orders(("o_orderkey", ">=", 700)), f"{_O} WHERE o_orderkey >= 700"),
    "key_lt": (_orders(("o_orderkey", "<", 300)), f"{_O} WHERE o_orderkey < 300"),
    "key_le": (_orders(("o_orderkey", "<=", 300)), f"{_O} WHERE o_orderkey <= 300"),
    "key_between": (_orders(("o_orderkey", ">=", 100), ("o_orderkey", "<", 200)), f"{_O} WHERE o_orderkey >= 100 AND o_orderkey < 200"),
    "composite_prefix_eq": (_customers(("c_nationkey", "=", 3)), f"{_C} WHERE c_nationkey = 3"),
    "composite_full_eq": (_customers(("c_nationkey", "=", 17), ("c_custkey", "=", 42)), f"{_C} WHERE c_nationkey = 17 AND c_custkey = 42"),
    "composite_prefix_range": (_customers(("c_nationkey", "=", 7), ("c_custkey", ">", 50)), f"{_C} WHERE c_nationkey = 7 AND c_custkey > 50"),
    "composite_skip_leading": (_customers(("c_custkey", "<=", 40)), f"{_C} WHERE c_custkey <= 40"),
    "nonkey_filter": (_customers(("c_mktsegment", "=", "BUILDING")), f"{_C} WHERE c_mktsegment = 'BUILDING'"),
    "last_row": (lambda s, d: table(s, d, "customer").last(), f"{_C} ORDER BY c_nationkey DESC NULLS LAST, c_custkey DESC NULLS LAST LIMIT 1"),
    "order_key_asc_topk": (_top("customer", "c_nationkey, c_custkey", 20), f"{_C} ORDER BY c_nationkey NULLS FIRST, c_custkey NULLS FIRST LIMIT 20"),
    "order_key_desc_topk": (_top("orders", "o_orderkey DESC", 20), f"{_O} ORDER BY o_orderkey DESC NULLS LAST LIMIT 20"),
    "order_nonkey_topk": (_top("orders", "o_totalprice DESC, o_orderkey", 20), f"{_O} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 20"),
    "order_range_topk": (_top("orders", "o_orderkey", 15, ("o_orderkey", ">", 500)), f"{_O} WHERE o_orderkey > 500 ORDER BY o_orderkey NULLS FIRST LIMIT 15"),
    "duplicate_keys": (duplicate_key_report, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "merge_insert": (_merge("I"), _MERGED["I"].format(k=_KEPT)),
    "merge_update": (_merge("U"), _MERGED["U"].format(k=_KEPT)),
    "merge_delete": (_merge("D"), _MERGED["D"].format(k=_KEPT)),
    "merge_mixed": (_merge("IUD"), _MERGED["IUD"].format(k=_KEPT)),
    "time_travel": (
        time_travel,
        "SELECT 0 AS version, count(*) AS n FROM customer UNION ALL SELECT 1, count(*) FILTER (c_custkey % 10 <> 0) FROM customer "
        "UNION ALL SELECT 2, count(*) FILTER (c_custkey % 10 <> 0) + count(*) FILTER (c_custkey % 10 = 2) FROM customer",
    ),
    "access_plan_estimates": (access_plan_estimates, _PLANS_SQL),
    "row_digest": (key_digest, "SELECT o_orderkey, sha256(unhex('03' || array_to_string(list_reverse(regexp_extract_all(lpad(to_hex(o_orderkey::BIGINT), 16, '0'), '..')), ''))) AS digest FROM orders"),
    "typed_digest": (typed_digest, _TYPED_SQL),
    "chunk_summary": (chunk_summary, "SELECT count(*) AS total_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, 0::BIGINT AS empty_leaves, true AS near_target FROM orders"),
    "leaf_members": (leaf_members, "SELECT count(*) AS members, 0::BIGINT AS wrong_leaves FROM orders"),
    "tree_history": (tree_history, "SELECT 0::BIGINT AS different, count(*) AS total_rows FROM orders"),
    "csv_types": (
        csv_types,
        "SELECT n_name || ', \"the' AS col_0, CAST(n_nationkey AS BIGINT) AS col_1, n_nationkey / 4 AS col_2, n_regionkey < 2 AS col_3, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS col_4, "
        "'string,bigint,double,boolean,string' AS kinds FROM nation",
    ),
    "merge_many_files": (_merge("IUD", 64), _MERGED["IUD"].format(k=_KEPT)),
    "replayed_batch": (replayed_batch, "SELECT step::BIGINT AS step, commits FROM (VALUES (0, true), (1, false), (2, true), (3, true), (4, false)) AS t(step, commits)"),
    "memory_table": (memory_rows, "SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey FROM nation WHERE n_nationkey % 5 <> 0 AND n_regionkey >= 1 AND n_regionkey < 4"),
    "key_comparison": (
        key_comparison,
        "SELECT c_custkey, CASE WHEN (c_nationkey, c_custkey) < (12, 70) THEN -1 WHEN (c_nationkey, c_custkey) > (12, 70) THEN 1 ELSE 0 END AS sign, "
        "CASE WHEN (c_nationkey, c_custkey) > (12, 70) THEN c_nationkey ELSE 12 END AS most_nation, CASE WHEN (c_nationkey, c_custkey) > (12, 70) THEN c_custkey ELSE 70 END AS most_cust FROM customer",
    ),
    "lognormal_cdf": (lognormal, _LOGNORMAL_SQL),
    "error_cases": (error_cases, _ERRORS_SQL),
    "sql_explain": (explained, "SELECT true AS pushed, 'o_orderkey:bigint,o_totalprice:double' AS read_schema"),
    "glob_filter": (glob_filter, "SELECT c_custkey, c_name FROM customer WHERE c_name GLOB 'Customer#*[13579]?[!0-4]'"),
    "julian_days": (julian_days, "SELECT o_orderkey, round(julian(o_orderdate) - 0.5, 5) AS jd FROM orders"),
    "csv_load": (csv_load, "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"),
    "insert_rows": (
        insert_batch,
        "SELECT n_nationkey, n_name, n_regionkey, false AS new_row FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey, true FROM nation",
    ),
    "snapshot_diff": (
        diff_of_merge,
        "SELECT 'D' AS op, c_custkey, c_mktsegment FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'U', c_custkey, 'CHANGED' FROM customer WHERE c_custkey % 10 = 1 "
        "UNION ALL SELECT 'I', c_custkey + 1000000, c_mktsegment FROM customer WHERE c_custkey % 10 = 2",
    ),
    "stream_merge": (stream_of_changes, _MERGED["UD"].format(k=_KEPT)),
    "commit_history": (commit_history, "SELECT * FROM (VALUES (1, 'customer,nation', false), (2, 'customer,nation', false), (3, 'customer', true)) AS t(age, tables, is_first)"),
    "inspect_root": (
        node_inspection,
        "SELECT 'branch' AS node_type, count(*) AS row_count, '[\"' || min(o_orderkey) || '\"]' AS min_key, '[\"' || max(o_orderkey) || '\"]' AS max_key, true AS all_children FROM orders",
    ),
    "tree_info": (tree_info, "SELECT 'orders' AS name, 6 AS columns, 1 AS key_columns, count(*) AS total_rows, count(*) AS row_count, true AS depth_of_root, true AS deep FROM orders"),
    "tree_edges": (tree_links, "SELECT count(*) AS leaf_rows, 1::BIGINT AS roots, 1::BIGINT AS nodes_less_edges, 0::BIGINT AS wrong_sums, 0::BIGINT AS skips FROM orders"),
}

#: SQL that both engines run as it is; views are the test tables.
_DEC = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
SHARED_SQL = {
    "sql_projection_expr": "SELECT o_orderkey, o_totalprice * 2 AS doubled, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice IS NULL THEN 'none' ELSE 'small' END AS size_class, COALESCE(o_orderpriority, 'none') AS priority, CAST(o_custkey AS STRING) AS cust FROM orders",
    "sql_in_list": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_mktsegment NOT IN ('BUILDING')",
    "sql_like": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1' OR c_name LIKE '%00__'",
    "sql_is_null": "SELECT event_id, user_id FROM events WHERE value IS NULL OR props IS NOT NULL AND NOT (user_id > 20)",
    "sql_between_or_not": "SELECT o_orderkey FROM orders WHERE (o_totalprice BETWEEN 1000 AND 50000 OR o_orderkey < 10) AND NOT o_orderstatus = 'F' AND o_orderkey <> 4",
    "sql_join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 2",
    "sql_join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000",
    "sql_join_right": "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000",
    "sql_join_full": "SELECT a.c_custkey AS c1, b.s_suppkey AS s1 FROM customer a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey AND a.c_acctbal > 0",
    "sql_join_theta": "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_semi": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')",
    "sql_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "sql_in_subquery": "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')",
    "sql_group_having": f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_DEC.format('l_quantity')} AS sum_qty, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top_price FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "sql_avg": "SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(c_acctbal) AS avg_bal, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY c_mktsegment",
    "sql_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "sql_rollup": "SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(grouping(c_nationkey) AS INT) AS g FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "sql_window_rank": "SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rk, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS rn FROM orders",
    "sql_window_frame": "SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_event, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3 FROM events",
    "sql_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000",
    "sql_except_all": "SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation",
    "sql_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "sql_join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "sql_total": "SELECT c_nationkey, COALESCE(CAST(sum(CASE WHEN c_acctbal > 9000 THEN CAST(c_acctbal AS DECIMAL(18,2)) END) AS DOUBLE), 0.0) AS total FROM customer GROUP BY c_nationkey",
    "sql_cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 8) SELECT c.c_custkey, c.c_name, big.n FROM big JOIN customer c ON c.c_custkey = big.o_custkey",
    "sql_recursive": "WITH RECURSIVE t(k, total) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT k + 1, total + k + 1 FROM t WHERE k < 20) SELECT k, total FROM t",
    "sql_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.9 FROM orders)",
    "sql_correlated": "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c",
    "sql_limit_offset": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_partkey LIMIT 10 OFFSET 25",
    "sql_strings": "SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, substr(c_name, 1, 5) AS head, length(c_name) AS len, replace(c_name, 'Customer', 'C') AS rep, trim(concat('  ', c_name, ' ')) AS trimmed, c_name || '-' || c_mktsegment AS glued, CAST(instr(c_name, '#') AS INT) AS at FROM customer",
    "sql_math": "SELECT p_partkey, abs(p_size - 25) AS away, floor(p_retailprice) AS low, ceil(p_retailprice) AS high, greatest(p_size, 10) AS g, least(p_size, 10) AS l, p_size % 7 AS m, sqrt(p_size) AS root FROM part",
    "sql_dates": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(o_orderdate AS DATE) AS day_only, CAST(quarter(o_orderdate) AS INT) AS q FROM orders",
    "sql_star_join": f"SELECT n.n_name, {_DEC.format('l.l_extendedprice')} AS revenue, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
}

#: Host SQL whose spelling differs: (Spark, DuckDB).
SPLIT_SQL = {
    "sql_regexp": ("SELECT c_custkey, c_name FROM customer WHERE c_name RLIKE '#0*[1-9][0-9]?5$'", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '#0*[1-9][0-9]?5$')"),
    "sql_printf": (
        "SELECT p_partkey, format_string('%05d|%s|%.2f|%x', p_size, p_brand, p_retailprice, p_partkey) AS line FROM part",
        "SELECT p_partkey, printf('%05d|%s|%.2f|%x', p_size, p_brand, p_retailprice, p_partkey) AS line FROM part",
    ),
    "sql_json": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "sql_group_concat": (
        "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "sql_hex": ("SELECT c_custkey, hex(c_custkey) AS h, sha2(c_name, 256) AS digest FROM customer", "SELECT c_custkey, to_hex(c_custkey) AS h, sha256(c_name) AS digest FROM customer"),
    "sql_date_arith": (
        "SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), 30) AS due, datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS days, date_format(o_orderdate, 'yyyy-MM') AS ym FROM orders",
        "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS days, strftime(o_orderdate, '%Y-%m') AS ym FROM orders",
    ),
    "sql_order_nulls": (
        "SELECT event_id, value FROM events ORDER BY value NULLS FIRST, event_id LIMIT 25",
        "SELECT event_id, value FROM events ORDER BY value NULLS FIRST, event_id LIMIT 25",
    ),
}


def _sql(text: str):
    """Run SQL over the test tables as one commit has them."""
    names = [n for n in KEYS if re.search(rf"\b{n}\b", text)]
    return lambda spark, sf_dir: query(catalog(spark, sf_dir, names or ["region"]), text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: fn for name, (fn, _) in NATIVE.items()}
    found |= {name: _sql(text) for name, text in SHARED_SQL.items()}
    return found | {name: _sql(text) for name, (text, _) in SPLIT_SQL.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: text for name, (_, text) in NATIVE.items() if text}
    found |= {name: text.replace("AS STRING", "AS VARCHAR") for name, text in SHARED_SQL.items()}
    return found | {name: text for name, (_, text) in SPLIT_SQL.items()}
