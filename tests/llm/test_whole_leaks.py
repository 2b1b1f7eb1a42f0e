"""Edited copies that hold no long run of their item, and short items."""

from __future__ import annotations

import random

import pytest

from tessella.llm import decontam

from .test_corpus import brute_align


@pytest.mark.parametrize("every", [3, 4, 5, 6])
@pytest.mark.parametrize("edit", ["change", "insert", "drop"])
def test_copies_edited_every_few_words(spark, every, edit):
    rng = random.Random(every)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(12, 50)))) for i in range(30)]
    docs = []
    for d in range(60):
        words = rng.choices(vocab, k=rng.randint(0, 120))
        piece = items[d % 30][1].split()
        new = {"change": ["changed"], "insert": ["inserted"], "drop": []}[edit]
        piece = [x for i, w in enumerate(piece) for x in ([w] if (i + 1) % every else [w, *new] if edit == "insert" else new)]
        words[len(words) // 2 : len(words) // 2] = piece
        docs.append((d, " ".join(words)))
    lists = [decontam.words_of(t) for _, t in items]
    want = {(d, i): brute_align(x, decontam.words_of(t)) / (2 * len(x)) for d, t in docs for i, x in enumerate(lists)}
    want = {k: s for k, s in want.items() if s >= 0.5}
    assert len(want) >= 60
    rows = decontam.leak_rows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in rows} == pytest.approx(want)


@pytest.mark.parametrize("pairs", [3, 2_000_000])
def test_any_alignment_that_reaches_the_score(monkeypatch, pairs):
    monkeypatch.setattr(decontam, "MAX_PAIRS", pairs)
    rng = random.Random(1)
    for size in (3, 12, 40):
        vocab = [f"v{i}" for i in range(size)]
        items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 14)))) for i in range(12)]
        texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 40))) for _ in range(40)]
        for least in (0.3, 0.5, 0.8):
            got = {(d, i): s for d, i, s, _, _ in decontam.Block(items, least).matches(texts)}
            want = {(d, i): brute_align(x.split(), t.split()) / (2 * len(x.split())) for d, t in enumerate(texts) for i, x in items}
            assert got == pytest.approx({k: s for k, s in want.items() if s >= least})


def test_short_items_count_whole():
    items = [(0, "Prague"), (1, "forty two"), (2, "yes of course not"), (3, "...")]
    texts = ["It is PRAGUE.", "forty-two", "forty or two", "well, yes, of course not!", "yes of course", None, ""]
    assert {(d, i, a, b) for d, i, _, a, b in decontam.Block(items).matches(texts)} == {(0, 0, 2, 3), (1, 1, 0, 2), (3, 2, 1, 5)}
