import hashlib
import math
import random

import pytest
from pyspark.sql import types as T

from tessella.errors import InvalidArgs, SchemaMismatch
from tessella.functions.encoding import canonical_bytes, encoder, long_digest, lognormal_cdf
from tessella.model import KeyedSchema
from tessella.plans.access import order_matches_key, select_access_path
from tessella.plans.shape import Splitter, inspect_node, leaf_chunks, snapshot_chunks, table_info, tree_edges, tree_nodes
from tessella.store import Store


def schema(*keys):
    return KeyedSchema.of(T.StructType([T.StructField(c, T.LongType()) for c in [*keys, "v"]]), keys)


N = 1_000_000


@pytest.mark.parametrize(
    "keys, candidates, search, rows",
    [
        (["k0"], [], [], N),
        (["k0"], [("k0", "=")], ["="], 1),
        (["k0"], [("v", "=")], [], N),
        (["k0"], [("k0", "like")], [], N),
        (["k0", "k1"], [("k0", "="), ("k1", ">")], ["=", ">"], 50_000),
        (["k0", "k1"], [("k1", "=")], [], N),
        (["k0", "k1"], [("k0", ">="), ("k1", "=")], [">="], 500_000),
        (["k0"], [("k0", ">"), ("k0", "=")], ["="], 1),
        (["k0"], [("k0", ">"), ("k0", "<")], [">"], 500_000),
        (["k0", "k1"], [("k0", "=")], ["="], 100_000),
    ],
)
def test_access_paths(keys, candidates, search, rows):
    plan = select_access_path(schema(*keys), candidates, N)
    assert [s.op for s in plan.search] == search and plan.estimated_rows == rows
    assert [s.argument for s in plan.search] == list(range(1, len(search) + 1))


def test_costs_form_a_gradient():
    s = schema("k0", "k1")
    costs = [select_access_path(s, c, N).estimated_cost for c in ([("k0", "="), ("k1", "=")], [("k0", "="), ("k1", ">")], [("k0", "=")], [])]
    assert costs == sorted(costs) and len(set(costs)) == 4 and costs[0] == math.log2(N)
    assert select_access_path(s, [], 0).estimated_rows == 1


def test_order_by_key_prefix():
    s = schema("k0", "k1")
    assert order_matches_key(s, []) and order_matches_key(s, [("k0", False)]) and order_matches_key(s, [("k0", False), ("k1", False)])
    assert not order_matches_key(s, [("k1", False)]) and not order_matches_key(s, [("k0", True)]) and not order_matches_key(s, [("k0", False), ("v", False)])


def test_splits_are_deterministic_and_near_the_target():
    rng = random.Random(1)
    items = [rng.randbytes(8) for _ in range(60_000)]

    def spans(spread):
        s, out, n = Splitter(200, spread), [], 0
        for item in items:
            n += len(item)
            if s.ends(item):
                out.append(n)
                n = 0
                s.reset()
        return out

    one = spans(80)
    assert one == spans(80)
    mean = sum(one) / len(one)
    assert abs(mean - 200) < 30
    width = lambda x: (sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x)) ** 0.5
    assert width(spans(20)) < width(one)
    with pytest.raises(InvalidArgs):
        Splitter(0, 1)


def test_lognormal():
    assert lognormal_cdf(0, 1, 1) == 0 and abs(lognormal_cdf(math.e, 1, 1) - 0.5) < 1e-12


def test_encodings(spark):
    assert encoder(T.IntegerType())(1) == b"\x02\x01\0\0\0" and encoder(T.BooleanType())(True) == b"\x01\x01"
    assert encoder(T.StringType())("é") == b"\x06" + (2).to_bytes(8, "little") + "é".encode()
    assert encoder(T.LongType())(None) == b"\0" and encoder(T.BinaryType())(b"x") == b"\x07" + (1).to_bytes(8, "little") + b"x"
    with pytest.raises(SchemaMismatch):
        encoder(T.ArrayType(T.LongType()))
    values = [0, 1, -1, 2**62, -(2**63)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(v,) for v in values], "x long").select("x", long_digest("x")).collect()}
    assert got == {v: hashlib.sha256(encoder(T.LongType())(v)).hexdigest() for v in values}


def test_canonical_bytes_in_the_jvm(spark):
    """All seven types, nulls among them, as the encoder has them."""
    import struct

    f32 = lambda x: struct.unpack("<f", struct.pack("<f", x))[0]
    rows = [
        (True, 1, 2**40, f32(1.5), -0.1, "é\U0001f600", b"\x00\xff"),
        (False, -1, -(2**63), f32(-0.0), float("nan"), "", b""),
        (None, -(2**31), 2**63 - 1, f32(3.4e38), float("-inf"), None, None),
        (None, None, None, None, None, "x" * 300, b"y" * 300),
    ]
    schema = "a boolean, b int, c long, d float, e double, f string, g binary"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + schema)
    got = {r["id"]: bytes(r["x"]) for r in df.select("id", canonical_bytes(df.schema, df.columns[1:]).alias("x")).collect()}
    encoders = [encoder(df.schema[c].dataType) for c in df.columns[1:]]
    assert got == {i: b"".join(e(v) for e, v in zip(encoders, r)) for i, r in enumerate(rows)}


def test_rounding_and_cost_of_estimates():
    assert [(p.estimated_rows, p.estimated_cost) for p in (select_access_path(schema("k0", "k1"), [("k0", "=")], n) for n in (15, 14, 25, 4))] == [(2, 1.5), (1, 1.4), (3, 2.5), (1, 1.0)]
    assert select_access_path(schema("k0"), [("k0", ">")], 5).estimated_rows == 3


def tree(spark, n, target=300, stddev=60, shift=0):
    df = spark.createDataFrame([(i, i + shift) for i in range(n)], "value long, row_id long")
    leaves = leaf_chunks(df, KeyedSchema.of(df.schema, ["value"]), target, stddev)
    return leaves, tree_nodes(leaves, target, stddev)


def test_tree_shape(spark):
    leaves, nodes = tree(spark, 15_000)
    rows = nodes.collect()
    assert max(r["level"] for r in rows) == 2
    root = [r for r in rows if r["parent_id"] is None]
    assert len(root) == 1 and root[0]["row_count"] == 15_000
    assert sum(r["row_count"] for r in rows if r["level"] == 0) == 15_000
    assert len({r["node_id"] for r in rows}) == len(rows)
    assert tree_edges(nodes).count() == len(rows) - 1
    one = inspect_node(nodes, root[0]["node_id"].lower()).first()
    assert one["node_type"] == "branch" and len(one["children"]) == one["num_keys"] + 1


def test_tree_is_history_independent_and_covers_row_numbers(spark):
    ids = lambda nodes: {r["node_id"] for r in nodes.collect()}
    same = ids(tree(spark, 500)[1])
    assert same == ids(tree(spark, 500)[1]) and same.isdisjoint(ids(tree(spark, 500, shift=1)[1]))


def brute_leaves(rows, target, stddev):
    """(node id, first key, last key, rows) of the chunks of (value, row_id) rows."""
    splitter, out, held = Splitter(target, stddev), [], []

    def close():
        digest = hashlib.sha256(b"leaf" + b"".join(i + n.to_bytes(8, "little") for i, _, n in held)).hexdigest().upper()
        out.append((digest, f'["{held[0][1]}"]', f'["{held[-1][1]}"]', len(held)))
        splitter.reset()
        held.clear()

    for value, n in rows:
        item = encoder(T.LongType())(value)
        held.append((item, value, n))
        if splitter.ends(item):
            close()
    if held:
        close()
    return out


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_stretches_meet(spark, tmp_path, partitions):
    """Chunked in parallel, files give the chunks of the sequential rule."""
    rows = [(3 * i, i + 5) for i in range(4000)]
    store = Store(spark, str(tmp_path))
    store.write_table("t", spark.createDataFrame(rows, "value long, row_id long"), ["value"], partitions=partitions)
    made = snapshot_chunks(store.snapshot("t"), target=300, stddev=60)
    got = [(r["node_id"], r["min_key"], r["max_key"], r["row_count"]) for r in sorted(made.collect(), key=lambda r: (r["part"], r["at"]))]
    assert got == brute_leaves(rows, 300, 60)
    assert store.snapshot("t").manifest().count() == partitions


def test_levels_match_brute_force(spark):
    leaves, nodes = tree(spark, 3000)
    want = {r["node_id"]: None for r in leaves.collect()}
    level, depth = [(r["node_id"], r["key_bytes"]) for r in sorted(leaves.collect(), key=lambda r: (r["part"], r["at"]))], 0
    while len(level) > 1:
        depth += 1
        splitter, above, held = Splitter(300, 60), [], []

        def close(held=held, above=above, splitter=splitter, depth=depth):
            node = hashlib.sha256("|".join([f"branch-{depth}", *[i for i, _ in held]]).encode()).hexdigest().upper()
            want.update({i: node for i, _ in held})
            want[node] = None
            above.append((node, held[-1][1]))
            held.clear()
            splitter.reset()

        for child in level:
            held.append(child)
            if splitter.ends(bytes(child[1])) and len(held) > 1:
                close()
        if held:
            close()
        level = above
    assert {r["node_id"]: r["parent_id"] for r in nodes.collect()} == want


def test_tree_of_long_keys_shrinks(spark):
    df = spark.createDataFrame([(f"{i:0205}", i) for i in range(50)], "k string, row_id long")
    nodes = tree_nodes(leaf_chunks(df, KeyedSchema.of(df.schema, ["k"]), 64, 16), 64, 16)
    assert nodes.agg({"level": "max"}).first()[0] <= 6


def test_table_info(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write_table("t", spark.createDataFrame([(i, i) for i in range(10)], "k long, v long"), ["k"])
    row = table_info(spark, [store.snapshot("t")], tree(spark, 10)[1]).first()
    assert (row["name"], row["columns"], row["key_columns"], row["total_rows"], row["tree_depth"]) == ("t", 2, 1, 10, 0)
