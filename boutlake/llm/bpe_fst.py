"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly if each token
encodes to itself and each adjacent pair encodes to that pair. So the encoding of
every prefix of a text ends in the one vocabulary token that fits behind the
encoding of what precedes it. The transducer's state is the automaton node of the
longest suffix read that some token begins with, and the last tokens of the
prefixes that reach back as far as that suffix. The nondeterministic choice of
where the running token starts is determinised arc by arc, when an arc is first
taken. No later token can start before that suffix, so what all starts within it
agree on is emitted: output lags behind input by a bounded number of bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from boutlake.llm.common import Recent, id_and_text

NEVER = 1 << 60


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The token ranks of a ``.tiktoken`` file's bytes."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


def merge_all(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """BPE by definition (lowest rank first, then leftmost): the parts, and the pair merged last. Used to compile, and by tests."""
    parts, last = [piece[i : i + 1] for i in range(len(piece))], None
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1)), default=(NEVER, 0))
        if best[0] == NEVER:
            break
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


class Transducer:
    """The transducer of one vocabulary. ``max_arcs`` bounds the lazily made arcs; beyond it they are made anew."""

    def __init__(self, ranks: dict[bytes, int], max_arcs: int = 1_000_000):
        self.ranks, self.max_arcs = ranks, max_arcs
        self.text = {r: t for t, r in ranks.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.whole: set[int] = set()
        self.plain: set[int] = set()
        for token, rank in sorted(ranks.items(), key=lambda x: len(x[0])):
            parts, last = merge_all(token, ranks)
            if len(parts) != 1:
                continue
            self.whole.add(rank)
            if last is None:
                self.plain.add(rank)
                continue
            a, b = ranks[last[0]], ranks[last[1]]
            self.left[rank], self.right[rank] = a, b
            if a in self.plain and b in self.plain and all(len(self.text[x]) == 1 or x < rank for x in (a, b)):
                self.plain.add(rank)
        self.trie: dict[int, int] = {}
        self.parent, self.ends, self.depth = [(0, 0)], [-1], [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                to = self.trie.get(key)
                if to is None:
                    to = self.trie[key] = len(self.ends)
                    self.parent.append((node, byte))
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = to
            if rank in self.whole:
                self.ends[node] = rank
        self.arcs = dict(self.trie)
        self.fallback: dict[int, int] = {0: 0}
        self.endings: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.ends)
        self.endings[0] = ()
        self.size = {r: len(t) for t, r in ranks.items()}
        self.number = {r: r.to_bytes(4, "little") for r in self.text}
        self.edges: dict[int, tuple[list[int], list[int]]] = {}
        self.pairs: dict[int, bool] = {}

    def _arc(self, node: int, byte: int) -> int:
        """Determinises the arc of ``byte`` at ``node``: the longest suffix of what is read that a token begins with."""
        key = node << 8 | byte
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > self.max_arcs:
                self.arcs = dict(self.trie)
            known = self.arcs[key] = self._arc(self._fall(node), byte) if node else 0
        return known

    def _fall(self, node: int) -> int:
        """The node of the longest proper suffix of a node's bytes that a token begins with."""
        known = self.fallback.get(node)
        if known is None:
            before, byte = self.parent[node]
            known = self.fallback[node] = self._arc(self._fall(before), byte) if before else 0
        return known

    def _endings(self, node: int) -> tuple[tuple[int, int], ...]:
        """(token, length) of the tokens that end at a node, longest first."""
        known = self.endings[node]
        if known is None:
            own = ((self.ends[node], self.depth[node]),) if self.ends[node] >= 0 else ()
            known = self.endings[node] = own + self._endings(self._fall(node))
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of token ``a`` followed by those of ``b`` encode to just these two."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._seam(a, b) if a in self.plain and b in self.plain else merge_all(self.text[a] + self.text[b], self.ranks)[0] == [self.text[a], self.text[b]]
        return known

    def _seam(self, a: int, b: int) -> bool:
        """Replays the merges at the seam: a token at the edge lasts until the merge that uses it."""
        rank, text = self.ranks.get, self.text
        if rank(text[a] + text[b]) is not None:
            return False
        edge_a, edge_b = self._edges(a)[0], self._edges(b)[1]
        i, j = len(edge_a) - 1, len(edge_b) - 1
        while i or j:
            ends_a, ends_b = edge_a[i - 1] if i else NEVER, edge_b[j - 1] if j else NEVER
            across = rank(text[edge_a[i]] + text[edge_b[j]])
            if across is not None and across < ends_a and across <= ends_b:
                return False
            if ends_a <= ends_b:
                i -= 1
            else:
                j -= 1
        return True

    def _edges(self, token: int) -> tuple[list[int], list[int]]:
        """The tokens at the right and at the left edge of a token, from the whole to the single byte."""
        known = self.edges.get(token)
        if known is None:
            known = self.edges[token] = ([token], [token])
            for chain, part in zip(known, (self.right, self.left)):
                while chain[-1] in part:
                    chain.append(part[chain[-1]])
        return known

    def encode(self, piece: bytes) -> bytes:
        """Token ids of one pre-tokenised piece as little-endian 32-bit integers; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return self.number[whole]
        return b"".join(self.emit(piece))

    def emit(self, piece: bytes, lag: int = 1024):
        """The ids in parts, the later ones while bytes are still to be read: every ``lag`` bytes what is certain goes out."""
        node, last, base = 0, [-1], 0
        pairs, endings, size = self.pairs, self.endings, self.size
        for byte in piece:
            to = self.arcs.get(node << 8 | byte)
            node = self._arc(node, byte) if to is None else to
            n = len(last)
            for token, length in endings[node] or self._endings(node):
                before = last[n - length]
                if before < 0:
                    break
                fits = pairs.get(before << 32 | token)
                if fits is None:
                    fits = self.fits(before, token)
                if fits:
                    break
            else:
                raise ValueError("a byte of the text is no token of the vocabulary")
            last.append(token)
            if n > lag:
                starts = set(range(len(last) - 1 - self.depth[node], len(last)))
                while len(starts) > 1:
                    top = max(starts)
                    starts.remove(top)
                    starts.add(top - size[last[top]])
                cut = starts.pop()
                if cut > base:
                    yield self._chain(last, cut, base)
                    last, base = last[cut:], 0
                lag = max(lag, 2 * len(last))
        yield self._chain(last, len(last) - 1, base)

    def _chain(self, last: list[int], at: int, stop: int) -> bytes:
        out, size, number = [], self.size, self.number
        while at > stop:
            out.append(number[last[at]])
            at -= size[last[at]]
        return b"".join(reversed(out))


def utf8_step(state: tuple[int, int, int] | None, byte: int) -> tuple[int, int, int] | None:
    """The incremental UTF-8 machine. A state is (bytes still due, least and greatest next byte); None: not UTF-8."""
    if state is None:
        return None
    due, low, high = state
    if due:
        return (due - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return START
    if 0xC2 <= byte < 0xE0:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte < 0xF0:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte < 0xF5:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


START = (0, 0x80, 0xBF)


class StreamingDecoder:
    """Token ids in, text out as soon as its code points are whole. What isn't UTF-8 raises ``UnicodeDecodeError`` at the end."""

    def __init__(self, text: dict[int, bytes]):
        self.text, self.moves = text, {}
        self.state, self.held = START, b""

    def move(self, state, token: int):
        key = (state, token)
        if key not in self.moves:
            at, whole = state, 0
            for i, byte in enumerate(self.text[token], 1):
                at = utf8_step(at, byte)
                whole = i if at == START else whole
            self.moves[key] = (at, whole)
        return self.moves[key]

    def feed(self, token: int) -> str:
        self.state, whole = self.move(self.state, token)
        raw = self.held + self.text[token]
        if self.state is None or not whole:
            self.held = raw
            return ""
        cut = len(self.held) + whole
        self.held = raw[cut:]
        return raw[:cut].decode("utf-8")

    def feed_all(self, tokens: np.ndarray, closed: np.ndarray, strings: list[str]) -> str:
        """What ``feed`` gives for each token in turn. ``closed`` marks the tokens that take the machine from its start to
        its start and ``strings`` has what these emit, so a run of them in the start state is one step."""
        numbers, out, at, n = tokens.tolist(), [], 0, len(tokens)
        breaks = np.flatnonzero(~closed[tokens]).tolist()
        for i in [*breaks, n]:
            while at < i and self.state != START:
                out.append(self.feed(numbers[at]))
                at += 1
            if at < i:
                out += [strings[t] for t in numbers[at:i]]
                at = i
            if at < n and at == i:
                out.append(self.feed(numbers[at]))
                at += 1
        return "".join(out)

    def close(self) -> str:
        raw, bad = self.held, self.state != START
        self.state, self.held = START, b""
        return raw.decode("utf-8") if bad or raw else ""


class Codec:
    """Encoding and decoding of whole texts with a bounded memory of the pieces met."""

    def __init__(self, raw: bytes, pattern: str, max_pieces: int = 400_000):
        self.fst, self.find = Transducer(read_ranks(raw)), regex.compile(pattern).findall
        self.known = Recent(max_pieces)
        top = max(self.fst.text) + 1
        self.tokens = [self.fst.text.get(i, b"") for i in range(top)]
        self.decoder = StreamingDecoder(self.fst.text)
        self.closed = np.array([self._closed(t) for t in self.tokens])
        self.strings = [t.decode("utf-8") if c else "" for t, c in zip(self.tokens, self.closed.tolist())]

    @staticmethod
    def _closed(token: bytes) -> bool:
        state = START
        for byte in token:
            state = utf8_step(state, byte)
        return state == START

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.fst.encode(piece.encode("utf-8"))
            if len(piece) <= 64:
                self.known.put(piece, ids)
        return ids

    def encode(self, text: str) -> bytes:
        get, new = self.known.new.get, self._piece
        return b"".join([get(p) or new(p) for p in self.find(text)])

    def decode(self, ids: bytes) -> tuple[bytes, bool]:
        """The bytes that the streaming decoder emits for the ids, and whether they are UTF-8. What it still holds at the end, or after a fault, follows as it is."""
        d = self.decoder
        d.state, d.held = START, b""
        text = d.feed_all(np.frombuffer(ids, "<u4"), self.closed, self.strings)
        return text.encode("utf-8") + d.held, d.state == START


@lru_cache(maxsize=2)
def _codec(raw: bytes, pattern: str) -> Codec:
    return Codec(raw, pattern)


def encode_column(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every whole text encoded and decoded again: id, n_tokens, ids_sha256, decoded_sha256, valid_utf8 and, if asked for, the ids.

    One row per row, repeated rows and null ids too; a null text counts as empty (no
    token). Only the two named columns are read. The vocabulary (bounded by its file)
    is sent to the executors; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern))

    def run(batches):
        codec = _codec(*shared.value)
        for b in batches:
            n, sha, back, valid, all_ids = [], [], [], [], []
            for text in b.column(1):
                ids = codec.encode(text.as_py() or "")
                raw, ok = codec.decode(ids)
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(raw).hexdigest())
                valid.append(ok)
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), pa.array(valid, pa.bool_())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "valid_utf8"]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []), names=names + (["ids"] if with_ids else []))

    plain, id_type = id_and_text(docs, id_col, text_col)
    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean" + (", ids array<int>" if with_ids else "")
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_col)
