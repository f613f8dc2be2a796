"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode (operator 6).

The merges (token ranks) compile into a byte trie. A transducer state is the set of trie nodes that
an unfinished token may be at, each with the number of bytes already read in it. For every prefix of the input BPE
has one last token, found among the tokens that end here whose predecessor is the last token where
they begin and which BPE keeps apart from that predecessor (compatible pairs are worked out once).
Tokens are emitted as soon as all live hypotheses share them; the lookahead is bounded by the
longest token. Decoding runs over id chunks of any size with an incremental UTF-8 machine.

Edge cases: null or empty text gives no ids; every byte is a token, so every text round-trips.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, slices


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Plain BPE of a short piece: merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Transducer:
    """Encodes pieces in one pass over their bytes; states are made when first met and kept up to a bound."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000, max_pairs: int = 1_000_000):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.token = {v: k for k, v in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.id_at: list[int] = [-1]
        for word, rank in ranks.items():
            node = 0
            for b in word:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.id_at.append(-1)
                node = nxt
            self.id_at[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        """Start over with the initial state alone."""
        begin = ((0, -1, 0),)
        self.number, self.states = {begin: 0}, [begin]
        self.moves: list[dict[int, int]] = [{}]
        self.last: list[tuple[int, int]] = [(-1, 0)]  # on arrival: the last token and its length

    def _forget_but(self, at: int) -> int:
        """Start over in the middle of a piece, keeping the state reached; its new number."""
        state, last = self.states[at], self.last[at]
        self._forget()
        to = self.number[state, last[1]] = len(self.states)
        self.states.append(state)
        self.moves.append({})
        self.last.append(last)
        return to

    def made_of(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge is t; None for a single byte. A token that merging never builds maps to (-1, -1)."""
        if t not in self.halves:
            word = self.token[t]
            below = {}
            for i in range(len(word)):  # only merges below t's own may come before it
                for j in range(i + 1, len(word) + 1):
                    if (r := self.ranks.get(word[i:j], t)) < t:
                        below[word[i:j]] = r
            parts = merge_by_rank(word, below)
            self.halves[t] = None if len(word) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self.halves[t]

    def compatible(self, left: int, right: int) -> bool:
        """Does BPE leave these neighbours as they are? Undo the merges beside the seam, newest first: a merge
        across the seam that came before the one being undone would have won."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            known, before = True, 1 << 60
            a, b = left, right
            while True:
                across = self.ranks.get(self.token[a] + self.token[b], 1 << 60)
                if across < before and self.made_of(across) == (a, b):
                    known = False
                    break
                split_a, split_b = self.made_of(a), self.made_of(b)
                if split_a is None and split_b is None:
                    break
                # equal ranks merge from the left, so a seam merge ties with the right token's own and loses to the left's
                if split_b is None or split_a is not None and a > b:
                    before, a = a, split_a[1]
                else:
                    before, b = b + 1, split_b[0]
            self.pairs[key] = known
        return known

    def _move(self, at: int, byte: int) -> int:
        """Make the state that follows: every hypothesis reads the byte, and a new token may begin after it."""
        live, found, length = [], -1, 0
        for node, before, n in self.states[at]:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            if self.children[nxt]:
                live.append((nxt, before, n + 1))
            t = self.id_at[nxt]
            if found < 0 and t >= 0 and self.made_of(t) != (-1, -1) and (before < 0 or self.compatible(before, t)):
                found, length = t, n + 1
        state = (*live, (0, found, 0))
        key = (state, length)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.last.append((found, length))
        self.moves[at][byte] = to
        return to

    def encode(self, piece: bytes, lookahead: int = 4096) -> list[int]:
        """Ids of one piece. Every `lookahead` bytes, tokens that all live hypotheses share leave the buffer."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        at, out, due = 0, [], lookahead
        last: list[tuple[int, int]] = []  # (last token, its length) at each position not settled
        moves, arrive = self.moves, self.last
        for byte in piece:
            to = moves[at].get(byte)
            if to is None:
                to = self._move(at, byte)
                if len(self.states) > self.max_states:
                    to = self._forget_but(to)
                    moves, arrive = self.moves, self.last
            at = to
            last.append(arrive[at])
            if len(last) >= due:
                settled = self._settled(last, [len(last) - n for _, _, n in self.states[at]])
                out += self._chain(last, settled)
                del last[:settled]
                due = len(last) + lookahead
        return out + self._chain(last, len(last))

    @staticmethod
    def _settled(last: list[tuple[int, int]], begins: list[int]) -> int:
        """The last boundary that the token chains before every live hypothesis have in common."""
        common: set[int] | None = None
        for end in begins:
            own = {end}
            while end > 0:
                end -= last[end - 1][1]
                own.add(end)
            common = own if common is None else common & own
        return max(common or {0})

    @staticmethod
    def _chain(last: list[tuple[int, int]], end: int) -> list[int]:
        """Tokens of the prefix that ends at `end`, following last tokens backwards."""
        tokens = []
        while end > 0:
            t, n = last[end - 1]
            tokens.append(t)
            end -= n
        return tokens[::-1]


class Utf8Stream:
    """Incremental UTF-8: feed bytes in any chunks, get whole characters; ill-formed bytes become U+FFFD."""

    def __init__(self):
        self.rest = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
                if need <= back:
                    return 0
                if back > 1:  # the second byte's range depends on the first
                    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                    if not low <= data[-back + 1] <= high:
                        return 0
                return back
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.rest + chunk
        cut = len(data) - self.open_tail(data)
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        data, self.rest = self.rest, b""
        return data.decode("utf-8", "replace")


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(load_ranks(path))


@lru_cache(2)
def encoder_of(ranks_path: str, pattern: str) -> "Encoder":
    """One encoder a worker process, so what it has learnt outlives the task."""
    return Encoder(ranks_path, pattern)


class Pieces(dict):
    """piece -> ids, worked out when first asked for; forgotten beyond a bound. Long pieces are never kept."""

    def __init__(self, machine: Transducer, bound: int):
        super().__init__()
        self.machine, self.bound = machine, bound

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.machine.encode(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= 32:
            if len(self) >= self.bound:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Text to ids: pieces by the pattern, each through the transducer."""

    def __init__(self, ranks_path: str, pattern: str, bound: int = 500_000):
        self.machine, self.find = transducer(ranks_path), regex.compile(pattern).findall
        self.seen = Pieces(self.machine, bound)

    def encode(self, text: str) -> np.ndarray:
        return np.array(list(chain.from_iterable(map(self.seen.__getitem__, self.find(text)))), "<u4")

    def decode(self, ids: np.ndarray, chunk: int = 4096):
        """Bytes of the ids, a chunk at a time."""
        token = self.machine.token
        for i in range(0, len(ids), chunk):
            yield b"".join(map(token.__getitem__, ids[i : i + chunk].tolist()))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids array<long> (null unless keep_ids), n_tokens, ids_sha256, decoded_sha256, decoded_text_ok."""

    def run(batches):
        encoder = encoder_of(ranks_path, pattern)
        for part in (part for batch in batches for part in slices(batch)):
            rows = []
            for text in part.column("text").to_pylist():
                ids = encoder.encode(text)
                digest, stream, ok, at = hashlib.sha256(), Utf8Stream(), True, 0
                for some in encoder.decode(ids):
                    digest.update(some)
                    piece = stream.feed(some)
                    ok, at = ok and text.startswith(piece, at), at + len(piece)
                piece = stream.close()
                ok = ok and text[at:] == piece
                rows.append((ids.tolist() if keep_ids else None, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), digest.hexdigest(), ok))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_text_ok"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<long>, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_text_ok boolean")
