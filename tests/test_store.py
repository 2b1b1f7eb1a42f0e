import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import CommitConflict, DuplicateKey, InvalidArgs, KeyNotFound, MissingKeyColumn, NoSuchTable, NoSuchTransaction, NullKey, SchemaMismatch, UnsupportedFieldType
from tessella.model import KeyedSchema, parse_key_columns
from tessella.operators.diff import snapshot_diff
from tessella.operators.keyed import compare_keys, max_key, top_by_key
from tessella.operators.merge import insert_rows, merge_changes
from tessella.sql import explain, query, register
from tessella.store import Store, with_row_ids

KV = "k int, v int, row_id long"


def kv(spark, n, value=lambda i: i * 10):
    return spark.createDataFrame([(i, value(i), i) for i in range(n)], KV)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_round_trip_and_counts(spark, store):
    store.write_table("t", kv(spark, 50), ["k"], partitions=4)
    t = store.snapshot("t")
    assert t.row_count() == 50 and t.scan().count() == 50 and t.manifest().agg(F.sum("rows")).first()[0] == 50
    assert rows(t.ordered()) == [(i, i * 10) for i in range(50)]
    assert rows(t.ordered(descending=True))[0] == (49, 490) and rows(t.last()) == [(49, 490)]
    assert t.scan().columns == ["k", "v"] and "row_id" in t.stored().columns


@pytest.mark.parametrize(
    "constraints, expected",
    [
        ([("k", "=", 17)], [17]),
        ([("k", "=", -100)], []),
        ([("k", "=", 9999)], []),
        ([("k", ">=", 9999)], []),
        ([("k", ">=", 10), ("k", "<", 20)], list(range(10, 20))),
        ([("k", ">", 47)], [48, 49]),
        ([("k", "<=", 1)], [0, 1]),
        ([("k", "<", 0)], []),
        ([("k", ">", 5), ("k", "<", 5)], []),
        ([("v", "=", 30)], [3]),
    ],
)
def test_key_constraints(spark, store, constraints, expected):
    store.write_table("t", kv(spark, 50), ["k"], partitions=3)
    assert [r[0] for r in rows(store.snapshot("t").ordered(constraints))] == expected


def test_absent_keys_give_no_rows(spark, store):
    store.write_table("t", spark.createDataFrame([(2 * i, i, i) for i in range(50)], KV), ["k"], partitions=4)
    t = store.snapshot("t")
    for k in (-1, 1, 33, 97, 99):
        assert t.scan([("k", "=", k)]).count() == 0


def test_two_part_keys(spark, store):
    data = [(a, b, 100 * a + b, 10 * a + b) for a in range(5) for b in range(4)]
    store.write_table("t", spark.createDataFrame(data, "a int, b int, v int, row_id long"), ["a", "b"])
    t = store.snapshot("t")
    assert sorted(r["row_id"] for r in t.stored([("a", "=", 3)]).collect()) == [30, 31, 32, 33]
    assert rows(t.scan([("a", "=", 2), ("b", "=", 1)])) == [(2, 1, 201)]
    assert sorted(rows(t.scan([("a", "=", 2), ("b", ">", 1)]))) == [(2, 2, 202), (2, 3, 203)]
    assert t.scan([("b", "=", 1)]).count() == 5


def test_pruning_reads_few_files(spark, store):
    store.write_table("t", kv(spark, 1000), ["k"], partitions=8)
    t = store.snapshot("t")
    assert t.manifest().count() == 8
    assert len(t.scan([("k", "=", 500)]).inputFiles()) == 1
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,500)]" in explain(t.scan([("k", "=", 500)]))


def test_rejects(spark, store):
    with pytest.raises(InvalidArgs):
        store.write_table("t", kv(spark, 0), ["k"])
    with pytest.raises(DuplicateKey):
        store.write_table("t", spark.createDataFrame([(5, 1, 0), (5, 2, 1)], KV), ["k"])
    with pytest.raises(NullKey):
        store.write_table("t", spark.createDataFrame([(None, 1, 0)], KV), ["k"])
    with pytest.raises(MissingKeyColumn):
        store.write_table("t", kv(spark, 2), ["nope"])
    with pytest.raises(MissingKeyColumn):
        store.write_table("t", kv(spark, 2), [])
    with pytest.raises(UnsupportedFieldType):
        store.write_table("t", spark.createDataFrame([(1, [1])], "k int, xs array<int>"), ["k"])
    assert store.head() is None
    with pytest.raises(NoSuchTable):
        store.snapshot("t")
    with pytest.raises(NoSuchTransaction):
        store.commit("ABC")


def test_key_specs():
    assert parse_key_columns("0,name", ["id", "name"]) == ["id", "name"]
    for bad, error in ((" ,", InvalidArgs), ("7", MissingKeyColumn), ("x", MissingKeyColumn)):
        with pytest.raises(error):
            parse_key_columns(bad, ["id", "name"])


def test_all_types_round_trip(spark, store):
    schema = "i int, l long, s string, d double, f float, b boolean, x binary, day date, ts timestamp, m decimal(10,2)"
    import datetime
    from decimal import Decimal

    row = (1, 2, "é", 1.5, 0.5, True, bytearray(b"\0\1"), datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 2, 3, 4, 5), Decimal("1.25"))
    store.write_table("t", spark.createDataFrame([row, (2, *[None] * 9)], schema), ["i"])
    assert rows(store.snapshot("t").ordered()) == [row, (2, *[None] * 9)]


def test_catalog_history_and_time_travel(spark, store):
    first = store.write_table("a", kv(spark, 3), ["k"])
    second = store.write_table("b", kv(spark, 4), ["k"])
    third = store.write_table("a", kv(spark, 5), ["k"])
    assert store.commit(third).prev_id == second and store.commit(second).prev_id == first
    assert sorted(store.commit().tables) == ["a", "b"]
    assert [r["tx_id"] for r in store.history().collect()] == [third, second, first]
    assert [store.snapshot("a", t).row_count() for t in (first, second, third)] == [3, 3, 5]
    with pytest.raises(CommitConflict):
        store.publish(store.table("a"), first)
    with pytest.raises(InvalidArgs):
        store.write_table("a", kv(spark, 1), ["k"], mode="create")


def test_table_ids_follow_content(spark, store):
    store.write_table("t", kv(spark, 20), ["k"], partitions=2)
    one = store.table("t").table_id
    store.write_table("t", kv(spark, 20).orderBy(F.desc("k")), ["k"], partitions=2)
    assert store.table("t").table_id == one
    store.write_table("t", kv(spark, 20).withColumn("row_id", F.col("row_id") + 1), ["k"], partitions=2)
    assert store.table("t").table_id != one


def change(spark, *items):
    return spark.createDataFrame(list(items), "op string, k int, v int, row_id long")


def test_merge_truth_table(spark, store):
    store.write_table("t", kv(spark, 10), ["k"])
    before = store.head()
    assert merge_changes(store, "t", change(spark)) == before
    merge_changes(store, "t", change(spark, ("I", 100, 999, 100), ("U", 5, 7777, 55), ("D", 3, None, None)))
    t = store.snapshot("t")
    assert rows(t.stored([("k", "=", 5)]))[0] == (5, 7777, 55)
    assert [r[0] for r in rows(t.ordered())] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 100] and t.row_count() == 10
    assert store.snapshot("t", before).scan().count() == 10
    at = store.head()
    for bad, error in (
        (("I", 2, 0, 0), DuplicateKey),
        (("U", 999, 0, 0), KeyError),
        (("D", 999, 0, 0), KeyError),
        (("X", 2, 0, 0), InvalidArgs),
        (("D", None, 0, 0), NullKey),
    ):
        from tessella.errors import KeyNotFound

        with pytest.raises(KeyNotFound if error is KeyError else error):
            merge_changes(store, "t", change(spark, bad))
    with pytest.raises(DuplicateKey):
        merge_changes(store, "t", change(spark, ("D", 2, 0, 0), ("I", 2, 0, 0)))
    with pytest.raises(SchemaMismatch):
        merge_changes(store, "t", change(spark, ("D", 2, 0, 0)).drop("v"))
    assert store.head() == at


def test_merge_to_nothing_and_back(spark, store):
    store.write_table("t", kv(spark, 5), ["k"])
    merge_changes(store, "t", change(spark, *[("D", i, None, None) for i in range(5)]))
    t = store.snapshot("t")
    assert t.row_count() == 0 and t.scan().count() == 0 and t.scan().columns == ["k", "v"] and t.manifest().count() == 0
    insert_rows(store, "t", spark.createDataFrame([(7, 70)], "k int, v int"))
    assert rows(store.snapshot("t").scan()) == [(7, 70)]


def test_merge_carries_untouched_files(spark, store):
    store.write_table("t", kv(spark, 1000), ["k"], partitions=10)
    before = {r["path"] for r in store.snapshot("t").manifest().collect()}
    merge_changes(store, "t", change(spark, ("U", 501, -1, 501), ("D", 520, None, None)))
    t = store.snapshot("t")
    assert len({r["path"] for r in t.manifest().collect()} & before) >= 8
    assert t.row_count() == 999 and t.scan().count() == 999
    merge_changes(store, "t", change(spark, ("I", 5000, 1, 1)))
    assert store.snapshot("t").scan().count() == 1000
    assert rows(store.snapshot("t").scan([("k", "=", 501)])) == [(501, -1)]


def test_random_merges_match_a_dict(spark, store):
    import random

    rng = random.Random(4)
    model = {i: i * 10 for i in range(40)}
    store.write_table("t", kv(spark, 40), ["k"], partitions=3)
    for _ in range(3):
        batch = []
        for k in rng.sample(range(80), 15):
            op = rng.choice("UD") if k in model else "I"
            v = rng.randint(0, 999)
            batch.append((op, k, v, k))
            if op == "D":
                model.pop(k)
            else:
                model[k] = v
        old = store.snapshot("t")
        merge_changes(store, "t", change(spark, *batch))
        assert dict(rows(store.snapshot("t").scan())) == model
        diff = snapshot_diff(old, store.snapshot("t"))
        undone = {r["k"]: r["op"] for r in diff.collect()}
        assert all(undone[k] == op for op, k, *_ in batch if k in undone)


def test_row_numbers_follow_the_scan(spark):
    df = with_row_ids(spark.range(0, 100, 1, 7).withColumnRenamed("id", "x"))
    assert sorted((r["x"], r["row_id"]) for r in df.collect()) == [(i, i) for i in range(100)]


def test_key_helpers(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (0, 9)], "a int, b int")
    low = F.struct("a", "b")
    got = df.select(compare_keys(low, F.struct(F.lit(1), F.lit(2))).alias("c"), max_key(low, F.struct(F.lit(1).alias("a"), F.lit(1).alias("b"))).alias("m")).collect()
    assert [r["c"] for r in got] == [-1, 0, -1]
    assert rows(top_by_key(df, ["a", "b"], 2)) == [(0, 9), (1, None)]


def test_schema_helpers():
    s = KeyedSchema.of(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.LongType())]), ["b"])
    assert s.key_part("b") == 0 and s.key_part("a") is None and s.values == ["a"]
    assert KeyedSchema.from_json(s.to_json()) == s
    with pytest.raises(SchemaMismatch):
        KeyedSchema.of(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("A", T.LongType())]), ["a"])


def test_sql_over_a_snapshot(spark, store):
    store.write_table("kv_table", kv(spark, 20, lambda i: i % 5), ["k"])
    assert [r[0] for r in query(store, "SELECT k FROM kv_table WHERE v = 3 ORDER BY k").collect()] == [3, 8, 13, 18]
    pinned = store.head()
    store.write_table("kv_table", kv(spark, 2), ["k"])
    assert register(store, pinned, "old_") == ["old_kv_table"]
    assert spark.sql("SELECT count(*) FROM old_kv_table").first()[0] == 20


def test_change_stream(spark, store, tmp_path):
    from tessella.streaming.merge import merge_stream

    store.write_table("t", kv(spark, 3), ["k"])
    change(spark, ("I", 9, 90, 9), ("D", 0, None, None)).write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema("op string, k int, v int, row_id long").parquet(str(tmp_path / "feed"))
    merge_stream(store, "t", feed, str(tmp_path / "offsets")).awaitTermination()
    assert [r[0] for r in rows(store.snapshot("t").ordered())] == [1, 2, 9]


def test_feeds_have_their_own_marks(spark, store, tmp_path):
    from tessella.streaming.merge import merge_stream

    store.write_table("t", kv(spark, 3), ["k"])
    schema = "op string, k int, v int, row_id long"

    def feed(name, *items):
        if items:
            change(spark, *items).write.mode("append").parquet(str(tmp_path / name))
        merge_stream(store, "t", spark.readStream.schema(schema).parquet(str(tmp_path / name)), str(tmp_path / f"{name}-offsets")).awaitTermination()
        return [r[0] for r in rows(store.snapshot("t").ordered())]

    assert feed("one", ("I", 9, 90, 9)) == [0, 1, 2, 9]
    assert feed("two", ("D", 9, 0, 0)) == [0, 1, 2]
    assert feed("one", ("I", 10, 90, 10)) == [0, 1, 2, 10]
    at = store.head()
    assert feed("two") == [0, 1, 2, 10] and store.head() == at
    assert len(store.commit().marks) == 2


def test_a_batch_is_applied_once_under_its_mark(spark, store):
    """Also after a crash between the commit and what the stream remembers of it."""
    store.write_table("t", kv(spark, 3), ["k"])
    batch = change(spark, ("I", 9, 90, 9))
    once = merge_changes(store, "t", batch, ("s", 4))
    assert merge_changes(store, "t", batch, ("s", 4)) == once and store.head() == once
    with pytest.raises(DuplicateKey):
        merge_changes(store, "t", batch, ("s", 5))
    assert store.commit().marks == {"s": 4}


def everything(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if "_delta" not in str(p))


def test_failed_batches_leave_no_trace(spark, store, tmp_path, monkeypatch):
    store.write_table("t", kv(spark, 100), ["k"], partitions=4)
    before = everything(tmp_path)
    for bad in (change(spark, ("I", 2, 0, 0)), change(spark, ("U", 999, 0, 0), ("I", 200, 0, 0)), change(spark, ("U", 3, 0, 0), ("D", 3, 0, 0))):
        with pytest.raises((DuplicateKey, KeyNotFound)):
            merge_changes(store, "t", bad)
        assert [p for p in everything(tmp_path) if p not in before and not p.endswith("_drafts")] == []

    def refuse(*args):
        raise CommitConflict("refused")

    monkeypatch.setattr(Store, "publish", refuse)
    with pytest.raises(CommitConflict):
        merge_changes(store, "t", change(spark, ("U", 3, 0, 0)))
    assert [p for p in everything(tmp_path) if p not in before and not p.endswith("_drafts")] == []


def test_merges_of_many_files(spark, store):
    """Every file is carried on once, whatever the number of files and of merges."""
    store.write_table("t", kv(spark, 300), ["k"], partitions=60)
    want = {i: i * 10 for i in range(300)}
    for k in (5, 150, 299):
        merge_changes(store, "t", change(spark, ("U", k, -k, k), ("I", 1000 + k, 1, 1)))
        want |= {k: -k, 1000 + k: 1}
        assert dict(rows(store.snapshot("t").scan())) == want and store.snapshot("t").row_count() == len(want)
    assert store.snapshot("t").manifest().agg({"rows": "sum"}).first()[0] == len(want)


def test_two_writers_on_one_commit(spark, store):
    store.write_table("t", kv(spark, 3), ["k"])
    base, version = store.head(), store.table("t")
    first = store.publish(version, base)
    other = Store(spark, store.root)
    other.head = lambda: base  # looked before the first one committed
    with pytest.raises(CommitConflict):
        other.publish(version, base)
    assert Store(spark, store.root).head() == first and store.commit().prev_id == base


def test_head_is_found_without_its_file(spark, store, tmp_path):
    """A crash after the commit and before HEAD is written loses nothing."""
    store.write_table("t", kv(spark, 3), ["k"])
    old = (tmp_path / "HEAD").read_text() if (tmp_path / "HEAD").exists() else None
    new = store.write_table("t", kv(spark, 4), ["k"])
    if old:
        from tessella import files

        files.write_text(spark, f"{store.root}/HEAD", old, replace=True)
    assert Store(spark, store.root).head() == new


def test_one_join_in_a_merge(spark, store):
    from tessella.operators.merge import joined, merged

    store.write_table("t", kv(spark, 30), ["k"])
    t = store.snapshot("t")
    plan = merged(joined(t.stored(), change(spark, ("U", 1, 1, 1)), t.schema), t.schema)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_memory_tables(spark):
    from tessella.sources.memory import MemoryTable

    t = MemoryTable.of_rows(spark, [(2, "b"), (1, "a"), (3, None)], "k int, s string", ["k"])
    assert rows(t.ordered()) == [(1, "a"), (2, "b"), (3, None)] and rows(t.scan([("k", ">", 2)])) == [(3, None)] and t.row_count() == 3
    after = t.merge(spark.createDataFrame([("D", 1, None, 0), ("I", 4, "d", 9)], "op string, k int, s string, row_id long"))
    assert rows(after.ordered()) == [(2, "b"), (3, None), (4, "d")] and rows(after.last()) == [(4, "d")] and t.row_count() == 3
    with pytest.raises(DuplicateKey):
        MemoryTable.of_rows(spark, [(1, "a"), (1, "b")], "k int, s string", ["k"])
    with pytest.raises(NullKey):
        MemoryTable.of_rows(spark, [(None, "a")], "k int, s string", ["k"])
    with pytest.raises(KeyNotFound):
        from tessella.errors import checked_rows

        with checked_rows():
            t.merge(spark.createDataFrame([("D", 7, None, 0)], "op string, k int, s string, row_id long")).scan().collect()


def test_glob_patterns():
    import re

    from tessella.functions.text import glob_pattern

    fits = lambda p, t: re.search(glob_pattern(p).replace(r"\z", r"\Z"), t) is not None
    assert fits("a*c", "abbc") and fits("*", "") and fits("a?c", "abc") and not fits("a?c", "ac") and not fits("A*", "abc")
    assert fits("[a-c]x", "bx") and not fits("[^a-c]x", "bx") and fits("[]]", "]") and fits("a[", "a[") and fits("a.b", "a.b") and not fits("a.b", "axb") and fits("*\n*", "a\nb")


def test_digests_tell_rows_apart(spark):
    import datetime

    from tessella.functions.encoding import text_digest

    t = datetime.datetime(2020, 1, 1, 1, 1, 1, 1)
    rows_ = [("a", "b", t, b"x"), ("a|1:b", None, t, b"x"), (None, "a|1:b", t, b"x"), ("a", "b", t.replace(microsecond=2), b"x"), ("a", "b", t, None), ("a", "b", None, b"x"), ("a", "-", t, b""), ("a", None, t, b"")]
    df = spark.createDataFrame(rows_, "a string, b string, c timestamp, d binary")
    assert df.select(text_digest(df.schema, df.columns)).distinct().count() == len(rows_)
