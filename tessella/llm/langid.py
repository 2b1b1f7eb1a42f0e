"""Language identification: averaged hashed subword embeddings and a linear
softmax, trained by stochastic gradient descent, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

#: Subwords: n-grams of letters with a mark on either side of a word.
GRAMS = (2, 3, 4)
BITS = 14
DIM = 16
#: Bounds on the labelled sample: texts of each language, and of all languages.
#: With many languages each has fewer texts, one at least.
ROWS_PER_LANG = 400
SAMPLE_ROWS = 25_600
#: Words of the pieces that the sample's whole texts are cut into for training,
#: and the most pieces that are taken of one text.
PIECE_WORDS = (4, 12, 40)
MAX_PIECES_PER_TEXT = 60
#: Share of held-back training pieces whose accepted prediction may be wrong.
ACCEPTED_ERROR = 0.02
#: Characters whose n-grams are hashed at once.
CHUNK_CHARS = 400_000

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        table = np.zeros(0x110000, dtype=bool)
        table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
        _LETTER.append(table)
    return _LETTER[0]


def subwords(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every subword, and whether each text has a letter.
    All in one vectorised pass: non-letters become marks, and n-grams with a
    mark inside (not at an end) are left out."""
    points = [np.frombuffer(t.lower().encode("utf-32-le"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(p) + 2 for p in points], dtype=np.int64)
    flat = np.zeros(int(sizes.sum()), dtype=np.uint32)
    ends = np.cumsum(sizes)
    for p, end, size in zip(points, ends, sizes):
        flat[end - size + 1 : end - 1] = p
    inside = letters()[flat]
    flat[~inside] = 0
    owner = np.repeat(np.arange(len(texts)), sizes)
    has = np.bincount(owner[inside], minlength=len(texts)) > 0
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            m = len(flat) - n + 1
            if m <= 0:
                continue
            ok = inside[: len(inside) - n + 1] | inside[n - 1 :]
            for k in range(1, n - 1):
                ok &= inside[k : k + m]
            at = np.flatnonzero(ok)
            h = np.full(len(at), 0x51ED27 + n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ flat[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            buckets.append((h >> np.uint64(64 - 32 - BITS) & np.uint64((1 << BITS) - 1)).astype(np.int32))
            owners.append(owner[at])
    if not buckets:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), has
    return np.concatenate(buckets), np.concatenate(owners), has


class LanguageModel:
    """Mean of bucket embeddings, then a linear softmax.

    The layers are linear, so ``table`` holds each bucket's class scores and a
    text's scores are the mean over its subwords.
    """

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.langs, self.table, self.bias, self.temperature, self.least = langs, table, bias, temperature, least

    @classmethod
    def fit(cls, rows: Sequence[tuple[str, str]], epochs: int = 4, rate: float = 0.5, batch: int = 32, seed: int = 3) -> LanguageModel:
        """(text, language) rows. A tenth of the texts is held back to fit the
        temperature and the least score of an accepted prediction."""
        langs = sorted({lang for _, lang in rows})
        if not langs:
            return cls([], np.zeros((1 << BITS, 0), dtype=np.float32), np.zeros(0), 1.0, 0.0)
        number = {lang: i for i, lang in enumerate(langs)}
        rng = np.random.default_rng(seed)
        pieces: list[tuple[str, int, bool]] = []
        for k, (text, lang) in enumerate(rows):
            words, own = text.split(), []
            at, j = 0, k
            while at < len(words):
                size = PIECE_WORDS[j % len(PIECE_WORDS)]
                own.append(" ".join(words[at : at + size]))
                at, j = at + size, j + 1
            step = max(1, -(-len(own) // MAX_PIECES_PER_TEXT))
            pieces += [(p, number[lang], k % 10 == 9) for p in own[::step]]
        bucket, owner, has = subwords([p for p, _, _ in pieces])
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
        starts = np.searchsorted(owner, np.arange(len(pieces) + 1))
        y = np.array([p[1] for p in pieces])
        train = np.array([i for i, p in enumerate(pieces) if not p[2] and has[i]], dtype=np.int64)
        held = np.array([i for i, p in enumerate(pieces) if p[2] and has[i]], dtype=np.int64)
        emb = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        out, bias = np.zeros((DIM, len(langs)), dtype=np.float32), np.zeros(len(langs), dtype=np.float32)
        weight = 1 / np.bincount(y[train], minlength=len(langs)).clip(1)
        weight = weight / weight[y[train]].mean() if len(train) else weight
        steps = max(1, epochs * -(-len(train) // batch))
        done = 0
        for _ in range(epochs):
            rng.shuffle(train)
            for a in range(0, len(train), batch):
                own = train[a : a + batch]
                parts = [bucket[starts[i] : starts[i + 1]] for i in own]
                sizes = np.array([len(p) for p in parts])
                ids, row = np.concatenate(parts), np.repeat(np.arange(len(own)), sizes)
                bounds = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                mean = np.add.reduceat(emb[ids], bounds, axis=0) / sizes[:, None]
                z = mean @ out + bias
                z = np.exp(z - z.max(axis=1, keepdims=True))
                g = z / z.sum(axis=1, keepdims=True)
                g[np.arange(len(own)), y[own]] -= 1
                g *= weight[y[own]][:, None]
                lr = rate * (1 - done / steps)
                back = (g @ out.T) / sizes[:, None]
                out -= (lr * mean.T @ g).astype(np.float32)
                bias -= (lr * g.sum(axis=0) / len(own)).astype(np.float32)
                place = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.diff(ids[place], prepend=-1))
                emb[ids[place][first]] -= np.add.reduceat((lr * 8 * back[row[place]]).astype(np.float32), first, axis=0)
                done += 1
        model = cls(langs, np.ascontiguousarray(emb @ out), bias, 1.0, 0.0)
        if not np.isfinite(model.table).all():  # steps too long for this sample
            return cls.fit(rows, epochs, rate / 2, batch, seed)
        if len(held):
            model._calibrate([pieces[i][0] for i in held], y[held])
        return model

    def _calibrate(self, texts: list[str], y: np.ndarray) -> None:
        """Temperature of least log-loss, then the least score from which on
        accepted predictions are wrong in ACCEPTED_ERROR of cases at most."""
        z = self.scores(texts)[0]

        def p(t: float) -> np.ndarray:
            e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(np.maximum(p(t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        q = p(self.temperature)
        top, wrong = q.max(axis=1), q.argmax(axis=1) != y
        order = np.argsort(-top, kind="stable")
        errors = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(errors <= ACCEPTED_ERROR)
        self.least = float(top[order[good[-1]]]) if len(good) else 1.0

    def scores(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class scores per text, and whether it has a letter. Texts are taken
        in groups of about CHUNK_CHARS, and a longer one in pieces that overlap
        by the longest n-gram, so memory doesn't follow the text's length."""
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        has = np.zeros(len(texts), dtype=bool)
        group: list[tuple[int, str]] = []
        size = 0

        def take() -> None:
            bucket, owner, some = subwords([t for _, t in group])
            at = np.array([i for i, _ in group])
            np.logical_or.at(has, at, some)
            np.add.at(counts, at, np.bincount(owner, minlength=len(group)))
            for k in range(len(self.langs)):
                np.add.at(sums[:, k], at, np.bincount(owner, weights=self.table[bucket, k], minlength=len(group)))

        for i, text in enumerate(texts):
            at = 0
            while True:
                stop = at + CHUNK_CHARS
                while stop < len(text) and text[stop - 1].isalpha() and stop < at + 2 * CHUNK_CHARS:
                    stop += 1
                group.append((i, text[at:stop]))
                size += stop - at if stop < len(text) else len(text) - at
                at = stop
                if size >= CHUNK_CHARS:
                    take()
                    group, size = [], 0
                if at >= len(text):
                    break
        if group:
            take()
        return sums / np.maximum(counts, 1)[:, None] + self.bias, has

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (``und`` without a letter), score, and whether it is accepted."""
        if not self.langs or not len(texts):
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        z, has = self.scores([t or "" for t in texts])
        e = np.exp((z - z.max(axis=1, keepdims=True)) / self.temperature)
        p = e / e.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = np.where(has, p[np.arange(len(best)), best], 0.0)
        return [self.langs[b] if h else "und" for b, h in zip(best, has)], score, has & (score >= self.least)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as an empty
    text, whose remainder is 0: it is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """(text, lang) of the labelled rows that are not held out: of every language
    the ``rows_per_lang`` texts of least hash (fewer, if all languages together
    would go beyond ``sample_rows``; only of more languages than that, the rarest
    have none). Repeated texts count once, so that no group of copies crowds out
    others. One scan finds, per language, about how many texts there are; the
    next one groups only the texts under a hash limit that leaves three times as
    many as wanted.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    own = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    found = own.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).orderBy(F.desc("n"), "lang").limit(sample_rows).collect()
    if not found:
        return []
    wanted = max(1, min(rows_per_lang, sample_rows // len(found)))
    #: Hashes are uniform over 64 bits; a small language is ranked whole.
    limits = [(r["lang"], max(r["least"], min(2**63 - 1, int(2**64 * min(1.0, (3 * wanted + 30) / max(1, r["n"]))) - 2**63))) for r in found]
    table = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, top long"))
    some = own.join(table, "lang").where("h <= top").groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = some.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= wanted)
    return [(r["text"], r["lang"]) for r in ranked.orderBy("lang", "k").collect()]


def train(docs: DataFrame) -> LanguageModel:
    return LanguageModel.fit(training_sample(docs.select("doc_id", "text", "lang")))


def predict_languages(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row.

    Learned from text and lang of the rows that are not held out; predicted
    from the text alone, read whole. A null text or one without a letter is
    ``und`` with score 0, not accepted; so is every text if nothing could be
    learned. ``accepted`` is the calibrated rejection. Repeated rows repeat; an
    empty table gives no rows; extra columns are not read.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    )

    def run(batches):
        own = shared.value
        for batch in batches:
            lang, score, accepted = own.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=schema.names)

    return map_batches(rows, run, schema)
