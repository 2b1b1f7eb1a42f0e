"""Byte-level BPE as a lazily determinised transducer; streaming UTF-8 decode."""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import drops_when_idle, map_batches, map_values

#: Determinised steps, checked pairs and encoded pieces that a worker keeps; what
#: comes later is worked out each time, so memory is bounded and results are the same.
MAX_STEPS = 400_000
MAX_PAIRS = 200_000
MAX_PIECES = 250_000
MAX_CHUNKS = 300_000
#: The fixed pattern whose matches never cross a single space between two
#: characters that aren't white space; texts are then split there first.
SPACE_SAFE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Token ids that one step of the streaming decoder takes.
DECODE_IDS = 8192


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_all(piece: bytes, ranks: dict[bytes, int], parts_left: int = 1) -> list[bytes]:
    """The definition: join the adjacent pair of least rank, leftmost first,
    while any joins and more than ``parts_left`` parts are left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > parts_left:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class MergeTransducer:
    """Reads a piece byte by byte and writes tokens as soon as they are sure.

    The merges are compiled into a relation on token pairs: (a, b) may stand
    side by side if merging their joint bytes gives back a and b. A sequence is
    the encoding of its bytes if each token gives back itself and each pair may
    stand. The nondeterministic machine guesses where tokens end; its state is
    the last token and the bytes read since. A determinised state is the set of
    such states that are still open, each with the tokens written since the
    states parted. It is made when first reached and kept. The common first
    tokens of all open states are emitted; the bytes still open are less than
    the longest token, so lookahead is bounded.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        if not all(bytes([i]) in ranks for i in range(256)):
            raise ValueError("every single byte needs a rank")
        #: The tokens as a trie: node * 256 + byte to a node; the token at a node.
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.tokens: dict[int, bytes] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                at = self.trie.get(node << 8 | byte)
                if at is None:
                    at = self.trie[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                node = at
            self.token_at[node] = rank
            self.tokens[rank] = token
        #: Stands for the last token at the start of a piece.
        self.none = max(ranks.values()) + 1
        self.pairs: dict[int, bool] = {}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        start = (((), self.none, 0),)
        self.states: list[tuple] = [start]
        self.ids: dict[tuple, int] = {start: 0}
        #: State * 256 + byte to the next state, with what is emitted if anything is.
        self.steps: dict[int, int | tuple] = {}

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the token's last merge joins; None for a byte."""
        known = self.halves.get(token, 0)
        if known == 0:
            if len(token) == 1:
                known = None
            else:
                known = tuple(merge_all(token, self.ranks, 2))
                if len(known) != 2:
                    raise ValueError("the ranks give no encoding")
            self.halves[token] = known
        return known

    def _join(self, last: int, token: int) -> bool:
        """``may_stand`` by ranks, kept."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        stands = self.may_stand(b"", self.tokens[token]) and (last == self.none or self.may_stand(self.tokens[last], self.tokens[token]))
        self.pairs[last << 24 | token] = stands
        return stands

    def may_stand(self, a: bytes, b: bytes) -> bool:
        """Whether b may follow a (a empty: whether b may stand at all).

        The last merges on either side are undone from the latest to the
        earliest; the parts that then touch must not join earlier than that.
        """
        if not a:
            return len(b) == 1 or self._halves(b) is not None and merge_all(b, self.ranks) == [b]
        rank, left, right, latest = self.ranks.get, a, b, 1 << 60
        while True:
            if rank(left + right, 1 << 60) < latest:
                return False
            ends, begins = self._halves(left), self._halves(right)
            if ends and (not begins or rank(left) > rank(right)):
                latest, left = rank(left), ends[1]
            elif begins:
                latest, right = rank(right) + 1, begins[0]
            else:
                return True

    def _step(self, state: int | tuple, byte: int) -> tuple:
        """Emitted ids and next state, made when first asked for. With the
        table full, a new state is passed on as it is instead of its number."""
        known = type(state) is int
        emitted, after = self._move(self.states[state] if known else state, byte)
        at = self.ids.get(after)
        if len(self.steps) >= MAX_STEPS:
            return emitted, after if at is None else at
        if at is None:
            at = self.ids[after] = len(self.states)
            self.states.append(after)
        if known:
            self.steps[state << 8 | byte] = (emitted, at) if emitted else at
        return emitted, at

    def _move(self, open_: tuple, byte: int) -> tuple:
        after, ended = [], None
        trie, pairs, token_at = self.trie.get, self.pairs.get, self.token_at
        for written, last, node in open_:
            now = trie(node << 8 | byte)
            if now is not None:
                after.append((written, last, now))
                if ended is None and (token := token_at[now]) >= 0:
                    stands = pairs(last << 24 | token)
                    if self._join(last, token) if stands is None else stands:
                        ended = ((*written, token), token, 0)
        if ended is None:
            raise ValueError("the ranks give no encoding")
        after.append(ended)
        first = after[0][0]
        if not first:
            return (), tuple(after)
        same = len(first)
        for written, _, _ in after[1:]:
            same = min(same, len(written))
            while first[:same] != written[:same]:
                same -= 1
        return first[:same], tuple([(w[same:], last, node) for w, last, node in after]) if same else tuple(after)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece. A piece that is a token stays whole."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        steps, state = self.steps, 0
        for byte in piece:
            step = steps.get(state << 8 | byte) if type(state) is int else None
            if type(step) is int:
                state = step
                continue
            emitted, state = step or self._step(state, byte)
            if emitted:
                out += emitted
        out += (self.states[state] if type(state) is int else state)[-1][0]
        return out


class Utf8Stream:
    """Incremental UTF-8 decoder: the state is the sequence that is still open
    (three bytes at most). Bad bytes become U+FFFD, or raise if ``strict``."""

    def __init__(self, strict: bool = False):
        self.errors = "strict" if strict else "replace"
        self.open = b""

    @staticmethod
    def _tail(data: bytes) -> int:
        """Bytes at the end that begin a sequence which needs more."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
                if need <= back:
                    return 0
                if back > 1:  # the second byte's range depends on the first
                    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                    if not low <= data[1 - back if back > 1 else -1] <= high:
                        return 0
                return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        back = self._tail(data)
        self.open = data[len(data) - back :]
        return data[: len(data) - back].decode("utf-8", self.errors)

    def finish(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", self.errors)


_EVERY = None


def _ranges(kind: str) -> str:
    """The code points that ``kind`` matches, as the inside of a character class."""
    global _EVERY
    if _EVERY is None:
        _EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    runs = [(m[0][0], m[0][-1]) for m in regex.finditer(f"{kind}+", _EVERY)]
    return "".join(re.escape(a) if a == b else f"{re.escape(a)}-{re.escape(b)}" for a, b in runs)


def splitter(pattern: str):
    """``findall`` of ``pattern`` with its Unicode classes written out, which
    the plain engine scans several times faster; where that engine can't take
    the pattern, the one that knows the classes."""
    global _EVERY
    out, inside, at = [], False, 0
    while at < len(pattern):
        m = re.compile(r"\\p\{\w+\}|\\s|\\S|\\.|.", re.S).match(pattern, at)
        at, part = m.end(), m[0]
        if part == "[" and not inside:
            inside = True
        elif part == "]" and inside:
            inside = False
        elif part == "\\S" and not inside:
            part = f"[^{_ranges(chr(92) + 's')}]"
        elif part == "\\s" or part.startswith("\\p"):
            part = _ranges(part) if inside else f"[{_ranges(part)}]"
        out.append(part)
    _EVERY = None
    try:
        return re.compile("".join(out)).findall
    except re.error:
        return regex.compile(pattern).findall


def _raw(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


class _Pieces(dict):
    """Piece to its ids as little-endian 32-bit bytes."""

    def __init__(self, machine: MergeTransducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> bytes:
        ids = _raw(self.machine.encode(piece.encode()))
        if len(self) < MAX_PIECES and len(piece) <= 64:
            self[piece] = ids
        return ids


class _Odd(Exception):
    """A chunk that can't be encoded by itself."""


class _Chunks(dict):
    """What stands between two single spaces to the ids of a space and it."""

    def __init__(self, whole, pieces: _Pieces):
        super().__init__()
        self.whole, self.pieces = whole, pieces
        letters, numbers, white = (_ranges(k) for k in (r"\p{L}", r"\p{N}", r"\s"))
        #: Letters, then marks: two pieces, the first with the space.
        self.plain = re.compile(f"([{letters}]+)([^{white}{letters}{numbers}]*)").fullmatch

    def __missing__(self, chunk: str) -> bytes:
        if found := self.plain(chunk):
            word, marks = found.groups()
            ids = self.pieces[" " + word]
            if marks:
                ids += self.pieces[marks]
        elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Odd
        else:
            ids = self.whole(" " + chunk)
        if len(self) < MAX_CHUNKS and len(chunk) <= 64:
            self[chunk] = ids
        return ids


class ByteBpe:
    """Whole texts to ids and back, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = splitter(pattern)
        self.pieces = _Pieces(MergeTransducer(ranks))
        self.chunks = _Chunks(self._whole, self.pieces) if pattern == SPACE_SAFE else None
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode_raw(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if self.chunks is not None:
            first, *rest = text.split(" ")
            if not first or not first[-1].isspace():
                try:
                    return self._whole(first) + b"".join(map(self.chunks.__getitem__, rest))
                except _Odd:
                    pass
        return self._whole(text)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_raw(text), dtype="<u4").tolist()

    def decode_stream(self, ids: Iterable[int] | np.ndarray) -> Iterator[str]:
        """Text as the ids come, DECODE_IDS at a time."""
        ids = np.asarray(ids)
        stream = Utf8Stream()
        for at in range(0, len(ids), DECODE_IDS):
            yield stream.feed(b"".join(map(self.tokens.__getitem__, ids[at : at + DECODE_IDS].tolist())))
        yield stream.finish()


_CODERS: dict[tuple[str, str], ByteBpe] = {}
drops_when_idle(_CODERS.clear)


def coder(path: str, pattern: str) -> ByteBpe:
    """The worker's coder for a vocabulary file; made once per process."""
    made = _CODERS.get((path, pattern))
    if made is None:
        gc.set_threshold(100_000, 50, 100)  # the tables hold no cycles
        made = ByteBpe(load_ranks(path), pattern)
        _CODERS.clear()
        _CODERS[path, pattern] = made
    return made


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path and split pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int). One narrow map, no shuffle. A null
    text gives no ids. An input column of that name is replaced."""
    def make():
        encode = coder(path, pattern).encode
        return lambda values: [[encode(v or "") for v in values]]

    return map_values(docs, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], make)


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded`` from its ids; null ids give an empty text."""
    def make():
        decode = coder(path, pattern).decode_stream
        return lambda values: [["".join(decode(v or [])) for v in values]]

    return map_values(docs, ids, [T.StructField("decoded", T.StringType())], make)


def bpe_digest(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row.

    Each text is split by ``pattern``, each match encoded by itself, and the ids
    decoded again; characters that no match covers have no ids. A null text is
    empty: no tokens and the digests of nothing. Rows are independent of each
    other, so repeated rows repeat; an empty table gives no rows. Texts go
    through whole, one at a time, whatever their length.
    """
    rows = docs.select("doc_id", text)

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            counts, digests, back = [], [], []
            for value in batch.column(1).to_pylist():
                raw = own.encode_raw(value or "")
                counts.append(len(raw) // 4)
                digests.append(hashlib.sha256(raw).hexdigest())
                held = hashlib.sha256()
                for part in own.decode_stream(np.frombuffer(raw, dtype="<u4")):
                    held.update(part.encode())
                back.append(held.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )
    return map_batches(rows, run, schema)
