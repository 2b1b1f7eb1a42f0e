"""Secret scan: fixed patterns, and probabilistic automata inferred from
labelled credentials by merging compatible prefix-tree states."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches

#: The base patterns, and the least characters of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "format")
#: Runs that may hold a credential: at least so many characters of its alphabet.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
_WORDS = ("passw", "secret", "token", "api")

#: Labelled credentials per format that are made for training: the bound on the sample.
SAMPLES = 150
#: Confidence of the compatibility test; a smaller value merges more.
ALPHA = 0.001
#: Least gain in nats over the best account of a span as something ordinary.
MIN_GAIN = 7.0
#: A span goes on to a farther end while that costs no more nats of gain than
#: this, and than this many for each symbol more.
SLACK, SLACK_EACH = 5.0, 1.0
#: Steps of this probability or more are a format's literal prefix.
LITERAL = math.log(0.2)
#: Least characters of a format span, and the most that an automaton walks from
#: one start (longer tokens are no credentials to it).
MIN_CHARS, MAX_CHARS = 16, 8192
#: Alphabets of ordinary random strings: counters, hashes, identifiers, base64.
_DIGITS, _HEX, _LOW, _UP = string.digits, string.digits + "abcdef", string.ascii_lowercase, string.ascii_uppercase
ALPHABETS = tuple(frozenset(x) for x in (_DIGITS, _HEX, _LOW, _UP, _DIGITS + "ABCDEF", _LOW + _DIGITS, _UP + _DIGITS, _LOW + _UP + _DIGITS, _LOW + _UP + _DIGITS + "+/_.=-"))


def labelled_credentials(samples: int = SAMPLES, seed: int = 7) -> list[tuple[str, str]]:
    """(text, label) rows by rule: credentials in publicly documented formats,
    and under the label ``plain`` words, identifiers, paths, numbers and dates.
    Hashes and random identifiers need no rows: ``ALPHABETS`` accounts for them."""
    rng = random.Random(seed)
    low, up, dig = _LOW, _UP, _DIGITS
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    made = {
        "access": lambda: rng.choice(["AKIA", "ASIA"]) + some(up + dig, 16),
        "hub": lambda: rng.choice(["ghp_", "gho_", "ghs_"]) + some(low + up + dig, 36),
        "lab": lambda: "glpat-" + some(low + up + dig + "_-", 20),
        "chat": lambda: rng.choice(["xoxb-", "xoxp-"]) + some(dig, 12) + "-" + some(dig, 12) + "-" + some(low + up + dig, 24),
        "maps": lambda: "AIza" + some(low + up + dig + "_-", 35),
        "pay": lambda: rng.choice(["sk_live_", "sk_test_", "pk_live_"]) + some(low + up + dig, 24),
        "packages": lambda: "npm_" + some(low + up + dig, 36),
        "web": lambda: "eyJ" + some(low + up + dig + "_-", rng.randint(20, 40)) + ".eyJ" + some(low + up + dig + "_-", rng.randint(40, 80)) + "." + some(low + up + dig + "_-", 43),
    }
    rows = [(f(), label) for label, f in made.items() for _ in range(samples)]
    parts = "the er tion ing ch en sch eau ment os cion que an re st un ver lich able ful data net page news item view list user file main heit keit ein be ge do ar as es mi ga bo ja ha he nd sh wh ou on in at ed ly ai oi vi com org mail www example site blog get set by name type config registry token key test live".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    forms = [
        lambda: "".join(rng.choice(parts) for _ in range(rng.randint(6, 12))),
        lambda: "".join(rng.choice(parts) for _ in range(rng.randint(6, 12))).capitalize(),
        lambda: "".join(rng.choice(parts) for _ in range(rng.randint(6, 12))).upper(),
        lambda: "".join(word().capitalize() for _ in range(rng.randint(3, 7))),
        lambda: word() + "".join(word().capitalize() for _ in range(rng.randint(3, 6))),
        lambda: "/".join(word() for _ in range(rng.randint(3, 6))),
        lambda: rng.choice("-._").join(word() for _ in range(rng.randint(3, 7))),
        lambda: "_".join(word() for _ in range(rng.randint(3, 7))).upper(),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" + rng.choice(["-", "_", "/"]) + word(),
        lambda: f"{word()}{rng.randint(0, 99)}.{word()}.{rng.choice(['com', 'org', 'net'])}",
        lambda: rng.choice("=-._+/") * rng.randint(16, 60),
    ]
    rows += [(forms[i % len(forms)](), "plain") for i in range(samples * len(made))]
    return rows


class Automaton:
    """Probabilistic deterministic automaton, merged from a prefix tree.

    A state on the border is merged into the nearest kept state, the latest
    first, whose frequencies of ends, steps and classes of steps, and those of
    all states below, differ by less than the Hoeffding bound at ``alpha``; if
    none is compatible it is kept. Merging folds the subtrees together, so that
    random symbols after a literal prefix become a loop at its end.
    """

    def __init__(self, samples: Iterable[str], alpha: float = ALPHA):
        self.count, self.ends, self.next = [0], [0], [{}]
        #: How often each step was taken; a merged state is entered by several.
        self.taken: list[dict[str, int]] = [{}]
        for text in samples:
            at = 0
            self.count[0] += 1
            for symbol in text:
                step = self.next[at].get(symbol)
                if step is None:
                    step = len(self.count)
                    self.count.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.taken.append({})
                    self.next[at][symbol] = step
                self.taken[at][symbol] = self.taken[at].get(symbol, 0) + 1
                at = step
                self.count[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.seen = [dict.fromkeys(n, 0.0) for n in self.next]

    def _apart(self, fa: int, na: int, fb: int, nb: int) -> bool:
        return abs(fa / na - fb / nb) > self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.count[a], self.count[b]
            if self._apart(self.ends[a], na, self.ends[b], nb):
                return False
            for kind in (_DIGITS, _LOW, _UP):
                fa, fb = (sum(n for x, n in self.taken[s].items() if x in kind) for s in (a, b))
                if self._apart(fa, na, fb, nb):
                    return False
            for symbol in {*self.next[a], *self.next[b]}:
                x, y = self.next[a].get(symbol), self.next[b].get(symbol)
                if self._apart(self.taken[a].get(symbol, 0), na, self.taken[b].get(symbol, 0), nb):
                    return False
                if x is not None and y is not None and x != y:
                    todo.append((x, y))
        return True

    def _kindred(self, a: int, b: int) -> bool:
        """Whether a takes the steps of b, or several of their class: what is
        seen too seldom to be told apart must not end up in a literal prefix."""
        kinds = [k for k in (_DIGITS, _LOW, _UP) if sum(x in k for x in self.next[a]) >= 3]
        return all(x in self.next[a] or any(x in k for k in kinds) for x in self.next[b])

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.ends[a] += self.ends[b]
            for symbol, y in self.next[b].items():
                self.taken[a][symbol] = self.taken[a].get(symbol, 0) + self.taken[b][symbol]
                x = self.next[a].get(symbol)
                if x is None:
                    self.next[a][symbol] = y
                else:
                    todo.append((x, y))

    def _merge(self) -> None:
        kept = [0]
        held = {0}
        while True:
            border = [(s, symbol, step) for s in kept for symbol, step in self.next[s].items() if step not in held]
            if not border:
                break
            parent, symbol, state = max(border, key=lambda x: (self.count[x[2]], -x[0], x[1]))
            for into in reversed(kept):
                if self._kindred(into, state) and self._compatible(into, state):
                    self.next[parent][symbol] = into
                    self._fold(into, state)
                    break
            else:
                kept.append(state)
                held.add(state)
        number = {s: i for i, s in enumerate(kept)}
        self.count = [self.count[s] for s in kept]
        self.ends = [self.ends[s] for s in kept]
        self.next = [{symbol: number[t] for symbol, t in self.next[s].items()} for s in kept]

    def _logs(self, s: int) -> tuple[dict[str, tuple[float, int]], float]:
        """Log-probabilities of steps and of the end, by what left the state.
        A class of characters with steps lends an unseen one of its kind the
        mean step's probability, halved, and its commonest target."""
        left = self.seen[s]
        total = sum(left.values()) + self.ends[s] + 0.5
        out = {x: (math.log(max(left[x], 0.05) / total), t) for x, t in self.next[s].items()}
        for alphabet in (string.ascii_lowercase, string.ascii_uppercase, string.digits):
            own = [x for x in alphabet if x in left]
            if len(own) >= 4:
                lent = (math.log(sum(left[x] for x in own) / len(own) / total / 2 + 1e-6), self.next[s][max(own, key=lambda x: (left[x], x))])
                out |= {x: lent for x in alphabet if x not in left}
        return out, math.log((self.ends[s] + 0.05) / total)

    def refit(self, samples: Iterable[str]) -> Automaton:
        """Step frequencies of the merged automaton, counted on the samples."""
        self.seen = [dict.fromkeys(n, 0.0) for n in self.next]
        self.ends = [0] * len(self.next)
        for text in samples:
            at = 0
            for symbol in text:
                if symbol not in self.next[at]:
                    break
                self.seen[at][symbol] += 1
                at = self.next[at][symbol]
            else:
                self.ends[at] += 1
        self.logs = [self._logs(s) for s in range(len(self.next))]
        return self

    def ends_from(self, text: str, start: int) -> Iterator[tuple[int, float, int, float]]:
        """(end, log-probability, end of the literal prefix, log-probability after
        it) of all substrings from ``start`` that the automaton accepts. A symbol
        without a step ends the walk."""
        at, total, logs = 0, 0.0, self.logs
        literal, before = start, 0.0
        for end in range(start, min(len(text), start + MAX_CHARS)):
            step = logs[at][0].get(text[end])
            if step is None:
                return
            total, at = total + step[0], step[1]
            if literal == end and step[0] >= LITERAL:
                literal, before = end + 1, total
            if self.ends[at]:
                yield end + 1, total + logs[at][1], literal, total + logs[at][1] - before

    def score(self, text: str) -> float:
        """Log-probability of the whole text, -inf where it isn't accepted."""
        return max((s for end, s, *_ in self.ends_from(text, 0) if end == len(text)), default=-math.inf)


class FormatModel:
    """One automaton per label, and what a span may be instead.

    A span's gain is the log-likelihood of its best format over that of the best
    ordinary account: character pairs of words, identifiers and paths, or
    symbols drawn at random from the smallest of ALPHABETS that holds them all.
    """

    def __init__(self, rows: Sequence[tuple[str, str]], alpha: float = ALPHA):
        groups: dict[str, list[str]] = {}
        for text, label in rows:
            groups.setdefault(label, []).append(text)
        plain = groups.pop("plain", [])
        self.formats = {label: Automaton(x, alpha).refit(x) for label, x in sorted(groups.items())}
        #: Formats by first symbol: where none begins, nothing is walked.
        self.begins: dict[str, list[str]] = {}
        for label, automaton in self.formats.items():
            for symbol in automaton.logs[0][0]:
                self.begins.setdefault(symbol, []).append(label)
        self.pairs: dict[str, dict[str, int]] = {}
        for text in plain:
            for a, b in zip("\0" + text, text):
                self.pairs.setdefault(a, {}).setdefault(b, 0)
                self.pairs[a][b] += 1
        self.sums = {a: sum(x.values()) for a, x in self.pairs.items()}
        letters = "".join(plain)
        self.single = {x: (letters.count(x) + 0.3) / (len(letters) + 0.3 * 68) for x in {*letters}}

    def _pair(self, a: str, b: str) -> float:
        single = self.single.get(b, 0.3 / 1000)
        return math.log((self.pairs.get(a, {}).get(b, 0) + 20 * single) / (self.sums.get(a, 0) + 20))

    def find(self, run: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, gain) of the credentials in a run, leftmost first.

        All are tried that begin at the run's start or after a symbol that is no
        letter or digit, and end likewise: a prefix such as ``NAME=`` or a path
        neither hides a credential nor belongs to it. What follows a format's
        literal prefix must be likelier by the format than as words, so that
        placeholders made of words are none."""
        found, at = [], 0
        sums: list[float] = []

        def words(start: int, end: int) -> float:
            """Log-likelihood as words, identifiers or paths, from sums over the run."""
            if not sums:
                sums.extend(accumulate(map(self._pair, run, run[1:]), initial=0.0))
            return self._pair("\0", run[start]) + sums[end - 1] - sums[start] if end > start else 0.0

        while at < len(run):
            ends = []
            if run[at] in self.begins and not (at and run[at - 1].isalnum()):
                for label in self.begins[run[at]]:
                    held, seen = ALPHABETS, at
                    for end, score, literal, rest in self.formats[label].ends_from(run, at):
                        if end - at < MIN_CHARS or end < len(run) and run[end].isalnum() or rest < words(literal, end):
                            continue
                        held, seen = [x for x in held if x.issuperset(run[seen:end])], end
                        ordinary = max([words(at, end), *[-(end - at) * math.log(len(x)) for x in held]])
                        if score - ordinary >= MIN_GAIN:
                            ends.append((score - ordinary, end, label))
            if ends:
                most, best, _ = max(ends)
                end, gain, label = max((end, gain, label) for gain, end, label in ends if gain >= most - SLACK - SLACK_EACH * max(0, end - best))
                found.append((at, end, label, gain))
                at = end
            else:
                at += 1
        return found

    def is_credential(self, text: str) -> bool:
        """Whether the whole text is one."""
        return any((start, end) == (0, len(text)) for start, end, _, _ in self.find(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping per kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found


def scan(text: str, model: FormatModel) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str]]]:
    """Base spans, and (start, kind, end, label) of all that the automata find:
    every run of 16 credential characters or more is searched, whatever the
    fixed patterns say of it."""
    base = base_spans(text)
    found = []
    for m in CANDIDATE.finditer(text):
        start, run = m.start(), m[0]
        if len(run) >= 32:  # a hexadecimal run of 32 lies inside one of these
            base += [(start + h.start(), 2, start + h.end()) for h in HEX.finditer(run) if h.end() - h.start() >= 32]
        found += [(start + a, 3, start + b, label) for a, b, label, _ in model.find(run)]
    base.sort()
    return base, found


def added_spans(base: list[tuple[int, int, int]], found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int]]:
    """The found spans that no base span meets: the method's own additions."""
    return [(a, k, b) for a, k, b, _ in found if not any(s < b and a < e for s, _, e in base)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_MODELS: dict[tuple, FormatModel] = {}


def default_model() -> FormatModel:
    """Trained on the made table; once per process."""
    key = (SAMPLES, ALPHA)
    if key not in _MODELS:
        _MODELS[key] = FormatModel(labelled_credentials())
    return _MODELS[key]


def scan_secrets(docs: DataFrame, model: FormatModel | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format and
    format_spans per row.

    ``spans`` are the base spans and those format spans that no base span meets,
    ``n_format`` the number of the latter; ``format_spans`` has all that the
    automata find, as label:start:end. Places are code points, ends exclusive. A
    null text is empty: no spans, and the digest of an empty string. Every text
    is scanned whole; rows stand for themselves, so repeated rows repeat. Extra
    columns are not read. An empty table gives no rows. No shuffle.
    """
    model = model or default_model()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    long, words = T.LongType(), T.StringType()
    kinds = {"n_assign": long, "n_access": long, "n_hex": long, "base_sha256": words, "spans": words, "n_format": long, "format_spans": words}
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), *[T.StructField(n, k) for n, k in kinds.items()]])

    def run(batches):
        own = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for value in batch.column(1).to_pylist():
                base, found = scan(value or "", own)
                added = added_spans(base, found)
                row = [sum(s[1] == k for s in base) for k in range(3)]
                row += [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted([*base, *added])), len(added)]
                row.append(",".join(f"{label}:{a}:{b}" for a, _, b, label in found))
                for column, x in zip(out, row):
                    column.append(x)
            arrays = [pa.array(x, pa.int64() if k is long else pa.string()) for x, k in zip(out, kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return map_batches(docs.select(id_column, text), run, schema)
