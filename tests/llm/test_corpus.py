"""Operators that look across documents: 5, 6, 8, 9, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tessella.llm import decontam, line_dedup, near_dedup, quality, sharding
from tessella.llm.queries import ORACLES, QUERIES

from .cases import PROSE, empty_docs, odd_docs, odd_rows, table_folder


def loaded(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


# -- 5 ----------------------------------------------------------------------


def check_shards(rows, source, n=24):
    size = lambda t: len((t or "").encode()) + 8
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, size(t), crc(t)) for i, t in source)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        homes[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and 0 <= r["shard"] < n and r["grown_shard"] in (r["shard"], n)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_shards(spark, duck):
    rows = QUERIES["op5_sharding"](spark, "/root/testdata/sf0.01").collect()
    source = [(r["doc_id"], r["text"]) for r in loaded(spark, "/root/testdata/sf0.01").collect()]
    check_shards(rows, source)
    moved = sum(r["grown_shard"] == 24 for r in rows)
    assert 0 < moved < 3 * len(rows) / 25
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard_digest(loaded(spark, "/root/testdata/sf0.01"), 25).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in rows)


def test_shards_of_odd_rows(spark):
    check_shards(sharding.shard_digest(odd_docs(spark)).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert sharding.shard_digest(empty_docs(spark)).count() == 0
    assert sharding.shard_digest(odd_docs(spark, 1)).exceptAll(sharding.shard_digest(odd_docs(spark, 5))).isEmpty()


def test_hot_repeats_get_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    rows = sharding.shard_digest(spark.range(100).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text"))).collect()
    check_shards(rows, [(None, "x")] * 100)


def test_weighted_shares(spark):
    rows = spark.range(20_000).select(sharding.shard_of(F.col("id"), 3, [1, 1, 2]).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 20_000 for r in rows}
    assert abs(share[2] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    assert {r[0] for r in spark.range(10).select(sharding.shard_of(F.col("id"), 1)).collect()} == {0}
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), 2, [1])


def test_write_shards(spark, tmp_path):
    sharding.write_shards(loaded(spark), str(tmp_path / "out"), 4, 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == loaded(spark).count() and back.select("shard").distinct().count() == 4


# -- 8 ----------------------------------------------------------------------


def brute_lines(rows, least, once=False):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    texts = [t or "" for _, t in rows]
    seen = Counter(k for t in (set(texts) if once else texts) for k in {key(x) for x in t.split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def digests(rows):
    return Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in rows)


@pytest.mark.parametrize("block", [48 << 20, 1])
def test_line_dedup_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 5 if block == 1 else 250_000)
    rows = [(r["doc_id"], r["text"]) for r in loaded(spark).collect()] + [(r[0], r[1]) for r in odd_rows()] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for least in (3, 10):
        want = brute_lines(rows, least)
        assert digests(want) == Counter(tuple(r) for r in line_dedup.line_digest(docs, least).collect())
    assert sum(d for _, _, d, _ in brute_lines(rows, 3)) > 0


def test_line_dedup_matches_sql(spark, duck):
    got = Counter(tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in QUERIES["op8_line_dedup"](spark, SF).collect())
    cursor = duck.execute(ORACLES["op8_line_dedup"])
    names = [d[0] for d in cursor.description]
    assert got == Counter(tuple(r[names.index(c)] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in cursor.fetchall())


def test_line_dedup_keeps_columns(spark):
    docs = odd_docs(spark)
    out = line_dedup.drop_repeated_lines(docs, 4)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = Counter((i, None if t is None else kept) for (i, t), (_, _, _, kept) in zip([(r[0], r[1]) for r in odd_rows()], brute_lines([(r[0], r[1]) for r in odd_rows()], 4)))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    assert line_dedup.drop_repeated_lines(empty_docs(spark)).count() == 0


def test_counts_of_the_arrays_decide(spark):
    """One index serves any least count: what its count array holds tells."""
    docs = spark.createDataFrame([(i, "\n".join(f"line {k}" for k in range(1, 9) if i < k)) for i in range(9)], "doc_id long, text string")
    index = line_dedup.build_index(docs)
    assert sum(r["lines"] for r in index.select("lines").collect()) == 7  # line 1 is in one document
    for least in range(2, 9):

        def dropped(batch, drops):
            import pyarrow as pa

            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in drops], pa.int64())], names=["doc_id", "n"])

        rows = line_dedup.with_drops(docs, index, dropped, "doc_id long, n long", least).collect()
        assert {r["doc_id"]: r["n"] for r in rows} == {i: sum(i < k and k >= least for k in range(1, 9)) for i in range(9)}


def test_copies_count_once_where_asked(spark):
    """Ten copies of a text keep its lines; ten texts with a line lose it."""
    rows = [(i, "a first line\na second one") for i in range(10)] + [(100 + i, f"shared by many\nown {i}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs, 10, distinct_texts=True).collect()}
    assert got == {i: t if i < 100 else f"own {i - 100}" for i, t in rows}
    assert {r["text"] for r in line_dedup.drop_repeated_lines(docs.where("doc_id < 100"), 10).collect()} == {""}


@pytest.mark.parametrize("block", [48 << 20, 1])
def test_columns_of_any_name_stay(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 2)
    names = ["__drop", "__drop_", "__t", "__label", "__gone_t", "__gone_id", "salt", "key"]
    lines = [f"this is line number {k} of the text" for k in range(8)]
    rows = [(i, "\n".join(lines) + f"\nown {i % 7 * 111}", *range(8)) for i in range(12)] + [(None, "a b c", *range(8))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for out, n in ((line_dedup.drop_repeated_lines(docs, 10), 14), (near_dedup.keep_one(docs), 2)):
        got = out.collect()
        assert out.columns == docs.columns and len(got) == n
        assert all([r[c] for c in names] == list(range(8)) for r in got)


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 100, 30_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        hash_ = line_dedup.PerfectHash.build(keys)
        assert hash_.n == len(keys) and sorted(hash_.number(keys)) == list(range(len(keys)))
    keys = np.array([7, 7, 9], dtype=np.uint64)
    shard = line_dedup.LineShard.load(line_dedup.LineShard.build(keys, np.array([1, 2, 3]), np.array([10, 20, 30])).dump())
    assert list(shard.count(np.array([7, 7, 9, 9, 8], dtype=np.uint64), np.array([1, 2, 3, 1, 1], dtype=np.uint64))) == [10, 20, 30, 0, 0]


# -- 6 ----------------------------------------------------------------------


def brute_align(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, now[j] - 1))
        best = max(best, *now)
        row = now
    return best


def test_alignment_matches_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.randint(1, 5) for _ in range(rng.randint(1, 25))]
        b = [rng.randint(0, 5) for _ in range(rng.randint(0, 40))]
        assert decontam.align(np.array(a), np.array(b, dtype=np.int64))[0] == brute_align(a, b)


def edited(words, rng, every):
    out = []
    for i, w in enumerate(words):
        out += [w] if i % every or not i else rng.choice([[], [w, "inserted"], ["changed"]])
    return out


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_leaks_found_and_clean_left(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 30
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(15, 50)))) for i in range(12)]
    items += [(100, items[0][1]), (101, None), (102, ""), (103, "too short here"), (None, items[1][1])]
    docs, want = [], set()
    for d in range(120):
        words = rng.choices(vocab, k=rng.randint(0, 200))
        if d % 3 == 0:
            item, text = items[d % 12]
            piece = text.split() if d % 2 else edited(text.split(), rng, 9)
            words[len(words) // 2 : len(words) // 2] = [w.upper() + "!!" for w in piece] if d % 4 == 0 else piece
            want.add((d, item))
            want |= {(d, 100)} if item == 0 else {(d, None)} if item == 1 else set()
        docs.append((d, " ".join(words)))
    docs += [(None if r[0] is None else r[0] + 1000, r[1]) for r in odd_rows()]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.leak_rows(frame, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    own = dict(docs)
    lists = {i: decontam.words_of(t) for i, t in items}
    for r in rows:
        a, b = lists[r["item_id"]], decontam.words_of(own[r["doc_id"]])
        assert abs(r["score"] - brute_align(a, b) / (2 * len(a))) < 1e-9
        assert brute_align(a, b[r["first_word"] : r["end_word"]]) == brute_align(a, b)
    kept = decontam.drop_leaks(frame, benchmark)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(d) for d, _ in docs if d not in {x for x, _ in want})


def test_leaks_of_odd_tables(spark):
    benchmark = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    rows = decontam.leak_rows(odd_docs(spark), benchmark).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows() if r[1] and PROSE.casefold() in r[1].casefold())
    assert decontam.leak_rows(empty_docs(spark), benchmark).count() == 0
    assert decontam.leak_rows(odd_docs(spark), benchmark.where("false")).count() == 0
    assert decontam.drop_leaks(odd_docs(spark), benchmark.where("false")).count() == len(odd_rows())
    assert decontam.drop_leaks(odd_docs(spark), benchmark).columns == odd_docs(spark).columns


def test_leaks_in_the_test_tables(spark, duck):
    words = lambda t: " ".join(decontam.words_of(t))
    items = duck.execute("select item_id, text from benchmark").fetchall()
    want = {(d, i) for d, t in duck.execute("select doc_id, text from documents").fetchall() for i, x in items if words(x) in words(t)}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_decontamination"](spark, SF).collect()}
    assert want and want <= got and len(got - want) <= 2


# -- 9 ----------------------------------------------------------------------


def words_in(text):
    return re.findall(r"[^\W_]+", (text or "").casefold())


def brute_similarity(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
        row = now
    return row[-1] / (len(a) + len(b) - row[-1]) if a and b else 0.0


def brute_classes(rows, least=0.8):
    """Classes as a partition of row places: all pairs that have a candidate key
    in common, aligned in full."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = [words_in(t) for _, t in rows]
    keys = [set(near_dedup.candidate_keys(w, least).tolist()) for w in near_dedup.word_hashes([t for _, t in rows])]
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a is None or b is None or find(i) == find(j):
                continue
            common = sum((Counter(lists[i]) & Counter(lists[j])).values())
            near = keys[i] & keys[j] and common >= least * (len(lists[i]) + len(lists[j]) - common)
            if a == b or near and brute_similarity(lists[i], lists[j]) >= least:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return list(groups.values())


def near_rows(seed=1, families=6, members=14):
    """Families of edited copies, exact copies, reordered copies, and others."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(800)]
    rows = []
    for f in range(families):
        base = rng.choices(vocab, k=rng.randint(60, 220))
        for m in range(members):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = rng.choices(vocab, k=rng.randint(0, 2))
            if m == 3:
                half = len(words) // 2
                words = words[half:] + words[:half]
            rows.append(" ".join(words))
        rows += [rows[-1]] * 2
    rows += [" ".join(rng.choices(vocab, k=rng.randint(1, 80))) for _ in range(30)]
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(None if r[0] is None else r[0] + 1000, r[1]) for r in odd_rows()]


def check_classes(got, rows, want):
    expected = Counter()
    for group in want:
        ids = [rows[i][0] for i in group]
        least = min((x for x in ids if x is not None), default=None)
        expected.update((x, least, len(ids)) for x in ids)
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == expected


@pytest.mark.parametrize("texts", [4096, 3])
def test_near_classes_match_brute_force(spark, monkeypatch, texts):
    """With a small bound the components go bucket by bucket and by hubs."""
    monkeypatch.setattr(near_dedup, "TASK_TEXTS", texts)
    monkeypatch.setattr(near_dedup, "TASK_EDGES", 500_000 if texts > 3 else 10)
    rows = near_rows(families=6 if texts > 3 else 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_classes(rows)
    check_classes(near_dedup.near_classes(docs).collect(), rows, want)
    kept = near_dedup.keep_one(docs).collect()
    least = [min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for g in want]
    assert Counter(r["doc_id"] for r in kept) == Counter(least)


def test_near_classes_of_odd_tables(spark):
    docs = odd_docs(spark)
    rows = [(r[0], r[1]) for r in odd_rows()]
    want = brute_classes(rows)
    check_classes(near_dedup.near_classes(docs).collect(), rows, want)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)
    assert near_dedup.near_classes(empty_docs(spark)).count() == 0 and near_dedup.keep_one(empty_docs(spark)).count() == 0
    none = spark.createDataFrame([(None, PROSE), (None, PROSE.upper()), (None, "other text")], "doc_id long, text string")
    assert near_dedup.keep_one(none).count() == 2


def hashed(values):
    return near_dedup._mix(np.array(values, dtype=np.uint64))


@pytest.mark.parametrize("least", [0.8, 0.6])
def test_similarity_matches_brute_force(least):
    rng = random.Random(9)
    for _ in range(150):
        a = [rng.randint(0, 40) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = [rng.randint(0, 40)] * rng.randint(0, 2)
        if rng.random() < 0.2:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        if not b:
            continue
        want = brute_similarity(a, b)
        got = near_dedup.similarity(near_dedup.Sequenced(hashed(a)), near_dedup.Sequenced(hashed(b)), least)
        assert got == pytest.approx(want) if want >= least else got < least
        assert near_dedup.aligned(hashed(a), hashed(b), len(a) + len(b)) == pytest.approx(want * (len(a) + len(b)) / (1 + want))


def test_short_texts_lose_no_candidate():
    """Every pair of a short text and another at the least similarity shares a key."""
    rng = random.Random(4)
    for _ in range(400):
        a = [f"w{rng.randint(0, 60) ** 2}" for _ in range(rng.randint(1, 24))]
        b = list(a)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [f"x{rng.randint(0, 9)}"] * rng.randint(0, 1)
        if b and brute_similarity(a, b) >= 0.8:
            x, y = (set(near_dedup.candidate_keys(w).tolist()) for w in near_dedup.word_hashes([" ".join(a), " ".join(b)]))
            assert x & y


@pytest.mark.parametrize("edits, recall", [(0.02, 0.995), (0.05, 0.9)])
def test_recall_of_edited_copies(edits, recall):
    """Copies of 60 to 300 words with that share of the words changed, anywhere."""
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(5000)]
    caught = 0
    for _ in range(200):
        a = rng.choices(vocab, k=rng.randint(60, 300))
        b = [rng.choice(vocab) if rng.random() < edits else w for w in a]
        x, y = near_dedup.word_hashes([" ".join(a), " ".join(b)])
        caught += bool({*near_dedup.candidate_keys(x).tolist()} & {*near_dedup.candidate_keys(y).tolist()}) and near_dedup.similarity(near_dedup.Sequenced(x), near_dedup.Sequenced(y)) >= 0.8
    assert caught >= recall * 200


def test_words_are_hashed_alike_anywhere():
    one = near_dedup.word_hashes(["Alpha beta, GAMMA_delta straße"])[0]
    many = near_dedup.word_hashes(["x", None, "zz alpha BETA gamma delta STRASSE", ""])
    assert list(one) == list(many[2][1:]) and len(many[1]) == len(many[3]) == 0
    assert len(set(near_dedup.word_hashes([" ".join(f"w{i}" for i in range(5000))])[0].tolist())) == 5000


@pytest.mark.parametrize("edges", [500_000, 0])
def test_components(spark, monkeypatch, edges):
    """In one task, and spread over the cluster."""
    monkeypatch.setattr(near_dedup, "TASK_EDGES", edges)
    chain = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 3), (100, 200)]
    got = {r["node"]: r["label"] for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: i // 10 * 10 for i in range(40)}, 100: 0, 200: 0}


def test_size_estimate_of_many_rounds(spark, monkeypatch):
    """A long chain takes many rounds, whose size estimates don't multiply."""
    monkeypatch.setattr(near_dedup, "TASK_EDGES", 10)
    rounds, cut = [], near_dedup.checkpoint
    monkeypatch.setattr(near_dedup, "checkpoint", lambda df: rounds.append(cut(df)) or rounds[-1])
    nodes = random.Random(4).sample(range(10**6), 300)
    got = near_dedup.components(spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long"))
    assert {(r["node"], r["label"]) for r in got.collect()} == {(x, min(nodes)) for x in nodes}
    bits = [df._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length() for df in rounds]
    assert len(bits) > 7 and max(bits) <= 64


# -- pipeline ---------------------------------------------------------------


def test_pipeline_matches_brute_force(spark, tmp_path):
    from .test_text_maps import brute_keeps

    from tessella.llm import byte_bpe

    rows = [(i, t, None, None, len(t or "")) for i, t in near_rows(seed=3, families=3, members=6)]
    rows += [(5000 + i, f"a common line of boilerplate here\nsome very own words {i} {i * 7} {i * i} tell apart what number {i + 3} is about here", "en", "s", 1) for i in range(12)]
    items = [(0, rows[0][1]), (1, "an item that no document has in it")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = table_folder(tmp_path, documents=spark.createDataFrame(rows, schema), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    references = quality.fit_references(*quality.measure(spark.read.parquet(f"{folder}/documents.parquet")))
    docs = [(i, t) for i, t, *_ in rows if brute_keeps(t or "", references)[1]]
    docs = [(i, kept) for i, _, _, kept in brute_lines(docs, 10, once=True)]
    docs = [min(((docs[k][0] is None, docs[k][0], docs[k][1]) for k in group))[1:] for group in brute_classes(docs)]
    texts = [decontam.words_of(t) for _, t in items]
    docs = [(i, t) for i, t in docs if all(brute_align(x, decontam.words_of(t)) < 0.5 * 2 * len(x) for x in texts)]
    encode = byte_bpe.coder(*byte_bpe.vocabulary()).encode
    want = Counter((i, len(encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs)
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == want and len(want) > 20


def test_pipeline_keeps_one_of_many_copies(spark, tmp_path):
    """Ten and more copies of a text lose nothing: one of them stays, whole."""
    text = PROSE + "\nMost of them had come a long way on foot and were glad of the fire\nNo one spoke for a while, and then all of them did"
    rows = [(i, text, "en", "s", 1) for i in range(12)] + [(50, "It was late when he left the inn, and the road was as dark as it had ever been in that part of the land", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = table_folder(tmp_path, documents=spark.createDataFrame(rows, schema), benchmark=spark.createDataFrame([(1, "none holds these words at all")], "item_id long, text string"))
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert got[0] == hashlib.sha256(text.encode()).hexdigest() and set(got) == {0, 50}


def test_pipeline_of_odd_tables(spark, tmp_path):
    benchmark = spark.createDataFrame([(1, "an item that no document has in it"), (2, None)], "item_id long, text string")
    folder = table_folder(tmp_path, documents=empty_docs(spark), benchmark=benchmark)
    assert corpus_pipeline.run(spark, folder).count() == 0
    (tmp_path / "odd").mkdir()
    folder = table_folder(tmp_path / "odd", documents=odd_docs(spark), benchmark=benchmark)
    got = corpus_pipeline.run(spark, folder).collect()
    kept = {r["doc_id"]: r["decoded_sha256"] for r in got}
    assert kept[6] == hashlib.sha256(PROSE.encode()).hexdigest() and 7 not in kept and len(got) == len(kept)


def test_pipeline_stages_keep_columns(spark):
    docs = loaded(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert dict(out.dtypes) == dict(docs.dtypes), name
    assert corpus_pipeline.ORACLE_SQL is None
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "byte-level bpe"]
