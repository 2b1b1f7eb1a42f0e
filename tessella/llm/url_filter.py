"""URL filter: host and path rules, and a logistic regression on hashed
character n-grams of host and path."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, unused, without

#: Fixed rules of the contract: verdict, then host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: n-gram lengths in bytes, and the bits of their hash.
GRAMS = (3, 4, 5)
BITS = 16
#: Rows of the made training table: the bound on the labelled sample.
TRAIN_ROWS = 4000
#: Share of the ordinary rows held back from training that may be blocked; the
#: probability to block from is read off them, and is at least LEAST_BLOCK.
FALSE_RATE = 0.004
LEAST_BLOCK = 0.6

#: Words of unwanted sites, by what they offer: the labelled side of the table.
UNWANTED = {
    "gambling": "casino poker bet bets betting slot slots jackpot roulette blackjack bingo baccarat bookie sportsbook lottery wetten spielbank spielautomat spielautomaten gluecksspiel apuestas ruleta tragaperras paris-sportifs",
    "adult": "porn porno xxx sex sexy sexcam adult adults nude nudes escort escorts camgirl camgirls hotgirl erotik erotica fetish milf hentai",
    "pharmacy": "viagra cialis pills levitra xanax tramadol steroids",
    "money": "payday replica replicas forex-bonus quick-loan",
    "malware": "warez crack cracks keygen torrent torrents phish phishing malware spyware spam adware",
    "adverts": "ads adserver clickbait popup popunder ad-track click-track",
}
#: Words of ordinary sites that hold the letters of unwanted ones: hard negatives.
ORDINARY = (
    "essex sussex wessex middlesex unisex sextant sextet asexual alphabet alphabets better betty elizabeth tibet diabetes beta between bethlehem abetting timeslot "
    "specialist socialist specialised artificial pillow pillar caterpillar spillway papillon nutcracker downloads uploads roads threads leads heads beads loads broads adsorption "
    "analysis analytics cocktail peacock scorn popcorn acorn unicorn corner explore exxon maxx torrential lotterer winter window wintergarden winery twinning freedom freeport freelance "
    "cheapside hotel hotels hotline photo photos clubhouse megabyte omega nightlife livery liverpool deliver alive library bookstore bookings racetrack soundtrack backtrack clicker popular population "
    "denude prelude include conclude resort resorts fisher farmhouse farmers pharmacy pharmacist pokhara milford wettbewerb wetter spielplatz spielzeug spielfilm schauspiel gluecklich rulebook paris sports"
)


def labelled_urls(rows: int = TRAIN_ROWS, seed: int = 11) -> list[tuple[str, int]]:
    """(url, 1 = unwanted) by rule, for want of labelled pages: hosts and paths
    around the words of UNWANTED against ordinary ones in the same shapes, with
    the words of ORDINARY among them."""
    rng = random.Random(seed)
    bad = [w for words in UNWANTED.values() for w in words.split()]
    good = ORDINARY.split()
    tails = "win online free best vip bonus club now cheap hot live 24 777 mega x top farm track".split()
    parts = "th er ing tion the re st nd in on es at ou ha he or en an ly sh wh ed be ti ble news shop blog book art city home data tech food green river stone light craft garden".split()
    tops = ["com", "net", "org", "example.com", "example.net", "example.org", "info", "de", "fr", "es", "tv", "io", "co.uk", "ac.uk", "edu"]
    plain_paths = "about contact article story archive category docs help faq product search user wiki".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(2, 4)))
    glue = lambda: rng.choice(["-", "-", ""])

    def unwanted() -> str:
        w, t = rng.choice(bad), rng.choice(tails)
        return rng.choice([w, f"{w}{glue()}{t}", f"{t}{glue()}{w}", f"{rng.choice(bad)}-{w}", f"{word()}-{w}", f"{w}{rng.randint(1, 999)}"])

    def ordinary() -> str:
        if rng.random() < 0.45:
            w = rng.choice(good)
            return rng.choice([w, w, f"{w}{glue()}{word()}", f"{word()}-{w}", f"{w}-{rng.choice(good)}"])
        return rng.choice([word(), word(), f"{word()}-{word()}", f"{word()}-{word()}", f"{word()}-{rng.choice(tails)}"])

    out = []
    for i in range(rows):
        label = i % 2
        sub = rng.choice(["", "", "www.", "m.", "blog.", "en."])
        in_path = label and rng.random() < 0.15
        host = unwanted() if label and not in_path else ordinary()
        path = [rng.choice(["en", "de", "fr", "es", "p", *plain_paths, word(), rng.choice(good)]) for _ in range(rng.randint(0, 2))]
        path += [str(rng.randint(1, 9999)) + rng.choice(["", "", ".html", "/"])]
        if in_path:
            path.insert(rng.randint(0, len(path) - 1), unwanted())
        out.append((f"{rng.choice(['http', 'https'])}://{sub}{host}.{rng.choice(tops)}/{'/'.join(path)}{rng.choice(['', '?page=2&ref=x', '#top', '?utm_source=feed'])}", label))
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null without one.
    A rule is a host, then a path from ``/`` on; among rules of one length the
    first given counts."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    out = None
    for verdict, rule in ordered:
        of_host, slash, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def gram_rows(keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of each key, all lengths; vectorised over
    the joined bytes, with n-grams that cross two keys left out."""
    raw = [k.encode() for k in keys]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(raw)), sizes)
    buckets, rows = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(flat) < n:
                continue
            h = np.full(len(flat) - n + 1, 0xCBF29CE484222325 + n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ flat[k : len(flat) - n + 1 + k]) * np.uint64(0x100000001B3)
            whole = row[: len(h)] == row[n - 1 :]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((h[whole] >> np.uint64(64 - BITS)).astype(np.int64))
            rows.append(row[: len(h)][whole])
    if not buckets:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(buckets), np.concatenate(rows)


def key_of(host: str, path: str) -> tuple[str, str]:
    """What the n-grams are of: host and path, each with marks around it."""
    return f"^{host}$", f"|{path}$"


class UrlModel:
    """Logistic regression; a URL's features are the n-gram counts of its host
    and of its path, each over the square root of their sum of squares, so that
    a long path doesn't thin out what the host says."""

    def __init__(self, weights: np.ndarray, bias: float, block_at: float = LEAST_BLOCK):
        self.weights, self.bias, self.block_at = weights, bias, block_at

    @staticmethod
    def _scaled(keys: Sequence[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bucket, part = gram_rows([x for key in keys for x in key])
        code, count = np.unique(part << BITS | bucket, return_counts=True)
        part, bucket = code >> BITS, code & ((1 << BITS) - 1)
        norm = np.sqrt(np.bincount(part, weights=count.astype(float) ** 2, minlength=2 * len(keys)))
        return bucket, part >> 1, count / np.maximum(norm[part], 1e-9)

    @classmethod
    def fit(cls, rows: Sequence[tuple[str, int]], epochs: int = 150, rate: float = 0.3, decay: float = 3e-5) -> UrlModel:
        """Full-batch steps, scaled per weight by the root of its summed squared
        gradients, on four fifths of the labelled table; the
        rest, every fifth pair of rows, sets the probability to block from."""
        keys = [key_of(*split_url(u)) for u, _ in rows]
        label = np.array([y for _, y in rows], dtype=float)
        held = np.arange(len(rows)) // 2 % 5 == 4
        bucket, row, value = cls._scaled([k for k, h in zip(keys, held) if not h])
        y = label[~held]
        w, b, square = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8)
        for _ in range(epochs if len(y) else 0):
            z = np.bincount(row, weights=w[bucket] * value, minlength=len(y)) + b
            g = 1 / (1 + np.exp(-z)) - y
            step = np.bincount(bucket, weights=g[row] * value, minlength=1 << BITS) / len(y) + decay * w
            square += step * step
            w -= rate * step / np.sqrt(square)
            b -= rate * g.mean()
        model = cls(w, b)
        p = np.sort(model.probability([k for k, h, y in zip(keys, held, label) if h and not y]))
        if len(p):
            model.block_at = min(0.95, max(LEAST_BLOCK, float(p[int((len(p) - 1) * (1 - FALSE_RATE))])))
        return model

    def probability(self, keys: Sequence[tuple[str, str]]) -> np.ndarray:
        if not len(keys):
            return np.zeros(0)
        bucket, row, value = self._scaled(keys)
        z = np.bincount(row, weights=self.weights[bucket] * value, minlength=len(keys)) + self.bias
        return 1 / (1 + np.exp(-z))


def split_url(url: str | None) -> tuple[str, str]:
    """``url_parts`` for one URL, for the training table."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[ends:]
    for c in "?#":
        path = path.partition(c)[0]
    return rest[:ends].translate(str.maketrans(UPPER, LOWER)), path


_MODEL: list[UrlModel] = []


def default_model() -> UrlModel:
    """Trained on the made table; once per process."""
    if not _MODEL:
        _MODEL.append(UrlModel.fit(labelled_urls()))
    return _MODEL[0]


def judge_urls(
    pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, model: UrlModel | None = None, labelled: Sequence[tuple[str, int]] | None = None
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and p_block.

    The longest fitting rule decides; else the model, which blocks from its
    calibrated probability on. ``labelled`` (url, 1 = unwanted) trains one in
    place of the made table. A null URL or one without ``://`` has empty host
    and path; no rule fits it and the model judges the empty key. Input columns
    of these five names are replaced, all others kept, whatever they are called;
    rows stay as they are, repeated or not. No shuffle.
    """
    model = model or (UrlModel.fit(labelled) if labelled is not None else default_model())
    shared = pages.sparkSession.sparkContext.broadcast(model)
    host, path = url_parts(F.col(f"`{url}`"))
    at_host, at_path, at_rule, at_p = unused(pages, "host", "path", "rule", "p")
    rows = pages.withColumns({at_host: host, at_path: path})
    rows = rows.withColumn(at_rule, rule_of(F.col(at_host), F.col(at_path), rules)).withColumn(at_p, F.lit(None).cast("double"))
    at = [rows.columns.index(c) for c in (at_host, at_path, at_p)]

    def run(batches):
        own = shared.value
        for batch in batches:
            keys = [key_of(h, p) for h, p in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist())]
            arrays = list(batch.columns)
            arrays[at[2]] = pa.array(own.probability(keys), type=pa.float64())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    scored = map_batches(rows, run, rows.schema)
    verdict = F.coalesce(F.col(at_rule)["verdict"], F.when(F.col(at_p) >= model.block_at, "block").otherwise("allow"))
    kept = without(pages, ["host", "path", "rule", "verdict", "p_block"]).columns
    return scored.select(
        *[F.col(f"`{c}`") for c in kept], F.col(at_host).alias("host"), F.col(at_path).alias("path"), F.col(at_rule)["rule"].alias("rule"), verdict.alias("verdict"), F.col(at_p).alias("p_block")
    )


def url_verdicts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block per page; the HTML is not read."""
    return judge_urls(pages.select("page_id", "url"))
