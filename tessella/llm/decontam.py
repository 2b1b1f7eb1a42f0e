"""Benchmark decontamination: passages that hold enough of an item's rarer words
are candidates, Smith-Waterman alignment of words scores them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

#: Items of fewer words count where they stand whole, word for word.
WHOLE = 5
#: Scores of the alignment, and the least share of an item's best possible score.
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
#: Text bytes of test items that are broadcast at once; more are taken in blocks.
BLOCK_BYTES = 16 << 20
#: Characters of documents that are looked through at once.
CHUNK_CHARS = 1_000_000
#: Pairs of a document's word and an item that holds it, worked on at once.
MAX_PAIRS = 2_000_000

_words = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, case folded."""
    return _words((text or "").casefold())


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and the ends (exclusive) in item and text."""
    steps = np.arange(len(text) + 1, dtype=np.int32) * -GAP
    row = np.zeros(len(text) + 1, dtype=np.int32)
    best, at_item, at_text = 0, 0, 0
    for i, word in enumerate(item):
        now = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP, out=now[1:])
        np.maximum(now, 0, out=now)
        row = np.maximum.accumulate(now + steps) - steps
        j = int(row.argmax())
        if row[j] > best:
            best, at_item, at_text = int(row[j]), i + 1, j
    return best, at_item, at_text


def common_length(item: np.ndarray, text: np.ndarray, marked: np.ndarray) -> int:
    """Longest common subsequence of two sequences of words; ``marked`` are the item's."""
    places: dict[int, int] = {}
    at = np.flatnonzero(marked[text])
    for k, word in enumerate(text[at].tolist()):
        places[word] = places.get(word, 0) | 1 << k
    every = row = (1 << len(at)) - 1
    for word in item.tolist():
        same = row & places.get(word, 0)
        row = ((row + same) | (row - same)) & every
    return len(at) - row.bit_count()


class Block:
    """Test items of one block: their word ids, and what a passage must hold of
    each to reach its least score.

    An alignment with M matches and E errors scores MATCH * M - E at most, so one
    of ``min_score`` has M >= min_score * n matches of an item's n words, in at
    most n + MATCH * n * (1 - min_score) words of text. Whatever those matches
    are, leaving out x of the item's words, the commonest, leaves M - x: passages
    with fewer of the other words are no leak, and no leak is lost.
    """

    def __init__(self, items: list[tuple[object, str | None]], min_score: float = MIN_SCORE):
        self.names = [name for name, _ in items]
        lists = [words_of(text) for _, text in items]
        self.vocab = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for words in lists for w in words))}
        self.ids = [np.fromiter(map(self.vocab.__getitem__, words), dtype=np.int64, count=len(words)) for words in lists]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        self.share = np.where(sizes < WHOLE, 1.0, min_score)
        least = np.maximum(1, np.ceil(self.share * sizes - 1e-9).astype(np.int64))
        self.span = np.floor(sizes + MATCH * sizes * (1 - self.share) + 1e-9).astype(np.int64)
        holders = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *map(np.unique, self.ids)]), minlength=len(self.vocab) + 1)
        self.least, self.need, words, owners = least.copy(), MATCH * self.share * sizes, [], []
        for i, own in enumerate(self.ids):
            word, times = np.unique(own, return_counts=True)
            order = np.lexsort((word, holders[word]))[::-1]
            out = np.cumsum(times[order]) <= least[i] // 2
            self.least[i] -= int(times[order][out].sum())
            self.need[i] -= (1 + MATCH) * int(times[order][out].sum())
            words.append(word[order][~out])
            owners.append(np.full(len(words[-1]), i))
        word, owner = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (words, owners))
        #: Items by word: those of word w are ``items[first[w] : first[w + 1]]``.
        self.items = owner[np.argsort(word, kind="stable")].astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(self.vocab) + 1))])

    def _held(self, ids: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, places): the last of an item's rarer words in every passage of
        ``ids`` that holds enough of them."""
        count = self.first[ids + 1] - self.first[ids]
        place = np.flatnonzero(count)
        if not len(place):
            return
        ends = np.cumsum(count[place])
        reach = int(self.span.max())
        start = 0
        while start < len(place):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MAX_PAIRS)))
            # Passages that begin before the next slice may end in it.
            until = int(np.searchsorted(place, place[stop - 1] + reach, side="right"))
            own = place[start:until]
            n = count[own]
            at = np.repeat(own, n)
            item = self.items[np.arange(len(at)) + np.repeat(self.first[ids[own]] - (np.cumsum(n) - n), n)]
            order = np.argsort(item, kind="stable")
            item, at = item[order], at[order]
            rank = np.arange(len(item))
            # M matches in L words leave L - M errors at least: with 1 + MATCH for
            # a match and -1 for a word, some run of words reaches the score.
            group = np.cumsum(np.concatenate([[0], (item[1:] != item[:-1]) | (owner[at[1:]] != owner[at[:-1]])]))
            value = (1 + MATCH) * rank - at - group * ((2 + MATCH) * len(ids) + MAX_PAIRS)
            ok = value - np.minimum.accumulate(value) + MATCH >= self.need[item] - 1e-9
            before = rank - self.least[item] + 1
            ok &= before >= 0
            before = np.maximum(before, 0)
            ok &= (group[before] == group) & (at - at[before] < self.span[item])
            yield item[ok], at[ok]
            start = stop

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, end word) of every item that a text
        holds; an item's best place in the text counts."""
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars < CHUNK_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            yield from self._matches(texts[start:stop], start)
            start = stop

    def _matches(self, texts: list[str | None], first: int) -> Iterator[tuple[int, int, float, int, int]]:
        lists = [words_of(t) for t in texts]
        sizes = np.array([len(x) for x in lists])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.zeros(int(begins[-1]), dtype=np.int64)
        for a, words in zip(begins.tolist(), lists):
            ids[a : a + len(words)] = np.fromiter(map(self.vocab.get, words, repeat(0)), dtype=np.int64, count=len(words))
        owner = np.repeat(np.arange(len(texts)), sizes)
        found: dict[tuple[int, int], list[list[int]]] = {}
        for items, places in self._held(ids, owner):
            docs = owner[places]
            lows, highs = np.maximum(places - self.span[items] + 1, begins[docs]), np.minimum(places + self.span[items], begins[docs + 1])
            for doc, item, low, high in zip(docs.tolist(), items.tolist(), lows.tolist(), highs.tolist()):
                windows = found.setdefault((doc, item), [])
                if windows and low <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], high)
                else:
                    windows.append([low, high])
        marked = np.zeros(len(self.vocab) + 1, dtype=bool)
        for (doc, item), windows in sorted(found.items()):
            own, best = self.ids[item], (0, 0, 0, 0)
            least = self.share[item] * MATCH * len(own) - 1e-9
            marked[own] = True
            for low, high in windows:
                # The same bound with all of the item's words, then with their order.
                value = np.cumsum(np.where(marked[ids[low:high]], MATCH, -1))
                ends = np.flatnonzero(value - np.minimum.accumulate(value) + MATCH >= least)
                if not len(ends):
                    continue
                low, high = max(low, low + int(ends[0] - self.span[item]) + 1), low + int(ends[-1]) + 1
                if common_length(own, ids[low:high], marked) < self.share[item] * len(own) - 1e-9:
                    continue
                score, end_item, end = align(own, ids[low:high])
                if score > best[0]:
                    best = (score, low, end_item, low + end)
            marked[own] = False
            score, low, end_item, end = best
            if score >= least:
                back = align(own[:end_item][::-1], ids[low:end][::-1])
                yield first + doc, item, score / (MATCH * len(own)), int(end - back[2] - begins[doc]), int(end - begins[doc])


def item_blocks(items: DataFrame, item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE) -> Iterator[Block]:
    """The test items in blocks of about BLOCK_BYTES."""
    rows = items.select(F.col(f"`{item_id}`").alias("name"), F.col(f"`{item_text}`").alias("value"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("name", "value"), F.lit(blocks)) == k)
        yield Block(sorted(((r["name"], r["value"]) for r in own.collect()), key=lambda x: (x[0] is None, x[0], x[1] or "")), min_score)


def find_leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: one row per document row
    and test item of which it holds a copy, exact or edited.

    The score is the best local alignment's over that of the whole item;
    ``min_score`` and more is a leak, wherever the edits are; of items of fewer
    than WHOLE words only a whole copy is, even of a single word. Null and empty
    texts hold nothing, and items without words match nothing; items with equal
    texts each match; repeated rows repeat. Without items or documents there are no rows. The
    items are broadcast in blocks of bounded size and documents never move.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("value"))
    kind = items.schema[item_id].dataType
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("item_id", kind), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]
    )
    out = None
    for block in item_blocks(items, item_id, item_text, min_score):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            own = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = list(own.matches(batch.column(1).to_pylist()))
                if found:
                    yield pa.RecordBatch.from_pylist([{"doc_id": ids[d], "item_id": own.names[i], "score": s, "first_word": a, "end_word": b} for d, i, s, a, b in found], schema=to_arrow(schema))

        part = map_batches(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The documents that hold no test item, all columns as they were."""
    at = docs.columns.index(text)
    out = docs
    for block in item_blocks(items, item_id, item_text, min_score):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            own = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[d for d, *_ in own.matches(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        out = map_batches(out, run, docs.schema)
    return out


def leak_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The leaks of ``documents``, one row per document and item."""
    return find_leaks(docs.select("doc_id", "text"), items.select("item_id", "text"))
