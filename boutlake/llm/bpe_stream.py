"""BPE by its merge list, as a streaming transducer of bounded lookahead, and incremental decoding to text.

Merging runs through the rules in order, so what lies to the right of a place can
change what lies to its left only through a chain of rules: a rule (a, b) takes the
token a that ends at the place if b stands behind it, and the next rule of the chain
(c, d) takes the token in front of a if d begins with that a. So rules of a chain
rise, and d has a on its left edge. The longest such chain, in bytes of the tokens
taken, is the merge list's sufficient lookahead: boundaries that have this many bytes
behind them never move again, and the tokens before them are emitted.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlake.llm.common import Recent, quoted

# The pattern of the byte-level pre-tokeniser; printable bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"  # the same for ASCII texts
PLAIN = "!-~\xa1-\xac\xae-\xff"

NEVER, NONE = 1 << 60, np.iinfo(np.int32).max
FEW, PART, TOGETHER = 48, 1 << 21, 4096


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: the printable ones themselves, the others from 256 on in order."""
    plain = re.compile(f"[{PLAIN}]")
    out, extra = {}, 256
    for byte in range(256):
        if plain.match(chr(byte)):
            out[chr(byte)] = byte
        else:
            out[chr(extra)] = byte
            extra += 1
    return out


class MergeList:
    """Merge rules over token ids, in order, and what follows from them. ``rules``: (left, right, result); ``size``: bytes of each token."""

    def __init__(self, rules: list[tuple[int, int, int]], size: dict[int, int]):
        self.rank = {(a, b): (i, c) for i, (a, b, c) in reversed(list(enumerate(rules)))}
        self.size = size
        pairs = np.array([a << 32 | b for a, b, _ in rules], np.int64)
        self._pairs, self._rules = np.unique(pairs, return_index=True)
        self._results = np.array([c for _, _, c in rules], np.int32)
        self.lookahead = self._sufficient(rules, size)

    @staticmethod
    def _sufficient(rules, size) -> int:
        """The sufficient lookahead in bytes. Needs rules whose parts are made before them, each token by one rule only."""
        left: dict[int, int] = {}
        longest: dict[int, int] = {}  # by the token that the chain's last rule takes
        made, parts = set(), set()
        for a, b, c in rules:
            parts |= {a, b}
            if c in made or c in parts:
                raise ValueError("a token of the merge list is made twice, or after its use")
            made.add(c)
            edge, before = b, longest.get(b, 0)
            while edge in left:
                edge = left[edge]
                before = max(before, longest.get(edge, 0))
            longest[a] = max(longest.get(a, 0), size[a] + before)
            left[c] = a
        return max(longest.values(), default=0)

    def merge(self, tokens: list[int]) -> list[int]:
        """The tokens with all merges made: lowest rule first, then leftmost."""
        if len(tokens) > FEW:
            return self._merge_many(tokens)
        get = self.rank.get
        none = (NEVER, 0)
        found = [get(pair, none) for pair in zip(tokens, tokens[1:])]
        while found:
            best = min(found)
            if best is none or best[0] == NEVER:
                break
            i = found.index(best)
            tokens[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((tokens[i - 1], best[1]), none)
            if i < len(found):
                found[i] = get((best[1], tokens[i + 1]), none)
        return tokens

    def _merge_many(self, tokens: list[int]) -> list[int]:
        """The same with a heap over a linked list, for long runs."""
        n, get = len(tokens), self.rank.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(tokens)
        heap = [(r[0], i, a, b) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if (r := get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] == a else n
            if j >= n or alive[j] != b:
                continue
            alive[i], alive[j], after[i] = self.rank[a, b][1], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if r := get((alive[i], alive[after[j]])):
                    heapq.heappush(heap, (r[0], i, alive[i], alive[after[j]]))
            if before[i] >= 0 and (r := get((alive[before[i]], alive[i]))):
                heapq.heappush(heap, (r[0], before[i], alive[before[i]], alive[i]))
        return [t for t in alive if t >= 0]


    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rule of each pair, or NONE."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._pairs, key), max(0, len(self._pairs) - 1))
        return np.where(self._pairs[at] == key, self._rules[at], NONE).astype(np.int32) if len(self._pairs) else np.full(len(a), NONE, np.int32)

    def merge_each(self, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many pieces at once, which lie one behind the other: tokens and lengths.

        A round makes every piece's lowest rule wherever it applies; as a rule's result is only used by later rules, nothing lower can turn up in between.
        """
        piece = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        rank = np.full(len(tokens), NONE, np.int32)
        rank[:-1] = self._ranks(tokens[:-1], tokens[1:])
        rank[:-1][piece[1:] != piece[:-1]] = NONE
        done = []
        while len(tokens):
            start = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            size = np.diff(np.r_[start, len(tokens)])
            least = np.minimum.reduceat(rank, start)
            if (least == NONE).any():
                over = np.repeat(least == NONE, size)
                done.append((piece[over], tokens[over]))
                tokens, rank, piece, size, least = tokens[~over], rank[~over], piece[~over], size[least != NONE], least[least != NONE]
                if not len(tokens):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            nth = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) != 1], nth, 0))
            hit = hit[(nth - run) % 2 == 0]  # of pairs that overlap (one token again and again) the first, third, ...
            tokens[hit] = self._results[rank[hit]]
            kept = np.ones(len(tokens), bool)
            kept[hit + 1] = False
            at = hit - np.arange(len(hit))
            tokens, piece = tokens[kept], piece[kept]
            rank = rank[kept]
            near = np.zeros(len(tokens), bool)
            near[at] = near[at[at > 0] - 1] = True
            again = np.flatnonzero(near[:-1])
            rank[at[at == len(tokens) - 1]] = NONE
            rank[again] = np.where(piece[again] == piece[again + 1], self._ranks(tokens[again], tokens[again + 1]), NONE)
        piece = np.concatenate([p for p, _ in done]) if done else piece
        out = np.concatenate([t for _, t in done]) if done else tokens
        return out[np.argsort(piece, kind="stable")], np.bincount(piece, minlength=len(lengths))


class Transducer:
    """Bytes in, token ids out once they are stable. Holds at most ``held`` bytes, whatever the length of the input."""

    def __init__(self, merges: MergeList, byte_ids: list[int]):
        self.merges, self.byte_ids, self._table = merges, byte_ids, np.array(byte_ids, np.int32)
        self.held = max(256, 8 * merges.lookahead)
        self.tail = b""

    def feed(self, part: bytes):
        """Takes bytes of a piece, in lists of ids emitted meanwhile."""
        tail, at = self.tail, 0
        while len(tail) + len(part) - at > self.held:
            take = self.held - len(tail)
            tail, at = tail + part[at : at + take], at + take
            ids, stable = self._merged(tail), len(tail) - self.merges.lookahead
            n = size = 0
            for t in ids:
                if size + self.merges.size[t] > stable:
                    break
                n, size = n + 1, size + self.merges.size[t]
            yield ids[:n]
            tail = tail[size:]
        self.tail = tail + part[at:]

    def finish(self) -> list[int]:
        """The ids of what is held at the end of the piece."""
        tail, self.tail = self.tail, b""
        return self._merged(tail)

    def _merged(self, raw: bytes) -> list[int]:
        return self.merges.merge(list(map(self.byte_ids.__getitem__, raw)))

    def encode(self, piece: bytes) -> list[int]:
        return [*chain.from_iterable(self.feed(piece)), *self.finish()]

    def encode_each(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece as little-endian 32-bit integers. Pieces that fit what is held end before any of them must be emitted; they are merged together, some at a time."""
        out: list[bytes] = [b""] * len(pieces)
        short = [i for i, p in enumerate(pieces) if len(p) <= self.held]
        for i, p in enumerate(pieces):
            if len(p) > self.held:
                out[i] = np.array(self.encode(p), "<u4").tobytes()
        for lo in range(0, len(short), TOGETHER):
            some = short[lo : lo + TOGETHER]
            tokens = self._table[np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)]
            tokens, lengths = self.merges.merge_each(tokens, np.array([len(pieces[i]) for i in some], np.int64))
            raw, ends = tokens.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(4 * lengths)]).tolist()
            for i, a, b in zip(some, ends, ends[1:]):
                out[i] = raw[a:b]
        return out


class TextMachine:
    """Token ids in, text out: an incremental machine from bytes to code points.

    Its state is the bytes of a code point that isn't whole yet, three at most. Bytes that
    can't become UTF-8 are U+FFFD, one for each longest part that might have gone on.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.whole = [self._scan(t) for t in tokens]
        self.closed = np.array([not held for _, held in self.whole], bool)
        self.strings = [s for s, _ in self.whole]
        self.state = b""

    @staticmethod
    def _scan(raw: bytes) -> tuple[str, bytes]:
        """The text of the whole code points of ``raw``, and the bytes of the one that is still open."""
        for back in range(1, min(3, len(raw)) + 1):
            lead = raw[-back]
            if lead & 0xC0 == 0x80:
                continue
            due = 4 if 0xF0 <= lead < 0xF5 else 3 if 0xE0 <= lead < 0xF0 else 2 if 0xC2 <= lead < 0xE0 else 1
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
            if due > back and (back == 1 or low <= raw[1 - back] <= high):
                return raw[:-back].decode("utf-8", "replace"), raw[-back:]
            break
        return raw.decode("utf-8", "replace"), b""

    def feed(self, token: int) -> str:
        key = (self.state, token)
        move = self.moves.get(key)
        if move is None:
            if len(self.moves) > 1_000_000:
                self.moves.clear()
            move = self.moves[key] = self._scan(self.state + self.tokens[token])
        text, self.state = move
        return text

    def finish(self) -> str:
        rest, self.state = self.state.decode("utf-8", "replace"), b""
        return rest

    def decode(self, ids: np.ndarray) -> str:
        """The text of all ids. Runs of tokens that leave no code point open are taken at once."""
        numbers, out, at = ids.tolist(), [], 0
        strings, feed = self.strings, self.feed
        for i in [*np.flatnonzero(~self.closed[ids]).tolist(), len(numbers)]:
            while at < i and self.state:
                out.append(feed(numbers[at]))
                at += 1
            if at < i:
                out += map(strings.__getitem__, numbers[at:i])
                at = i
            if at == i < len(numbers):
                out.append(feed(numbers[at]))
                at += 1
        return "".join(out) + self.finish()


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each id of a parsed tokenizers file, special tokens included."""
    letters, ids, special = byte_letters(), spec["model"]["vocab"], {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    out = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in ids.items():
        out[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode("utf-8")
    for token, i in special.items():
        out[i] = token.encode("utf-8")
    return out


class Encoder:
    """Encoding of whole texts by a byte-level BPE file of the tokenizers library.

    Special strings in a text are their token, found first; between them the pattern cuts
    pieces, each encoded on its own. Ids of pieces met before are remembered, in bounded memory.
    """

    def __init__(self, vocabulary: str, max_pieces: int = 200_000):
        spec = json.loads(vocabulary)
        model, added = spec["model"], spec.get("added_tokens") or []
        before = spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if not plain or odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("not a plain byte-level BPE file")
        letters, ids = byte_letters(), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rules = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in added}
        self.tokens = token_bytes(spec)
        by_byte = {b: ids[c] for c, b in letters.items()}
        self.fst = Transducer(MergeList(rules, dict(enumerate(map(len, self.tokens)))), [by_byte[b] for b in range(256)])
        self.find, self.find_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else lambda t: [t]
        self.known = Recent(max_pieces)

    def pieces(self, text: str) -> list[str]:
        """The text cut into special strings and pieces of the pattern."""
        parts = self.cut(text)
        find = self.find_ascii if text.isascii() else self.find
        return find(text) if len(parts) == 1 else [p for i, part in enumerate(parts) for p in ([part] if i % 2 else find(part))]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; pieces that are new are encoded together."""
        cut = [self.pieces(t) for t in texts]
        met = set().union(*cut)
        known = self.known
        if len(known.new) + len(met) > known.most:
            known.new, known.old = {}, known.new
        missing = met.difference(known.new, self.special)
        long = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        new = []
        for p in missing:
            ids = known.old.get(p)
            if ids is None:
                new.append(p)
            else:
                known.new[p] = ids
        for p, ids in zip(new, self.fst.encode_each([p.encode("utf-8") for p in new])):
            (known.new if len(p) <= 64 else long)[p] = ids
        get, rest = known.new.get, long.__getitem__
        return [b"".join([get(p) or rest(p) for p in pieces]) for pieces in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


@lru_cache(maxsize=1)
def _machine(vocabulary: str) -> TextMachine:
    return TextMachine(token_bytes(json.loads(vocabulary)))


def parts_of(sizes: list[int], most: int = PART):
    """(from, to) of runs of rows of about ``most`` in all."""
    at = total = 0
    for i, size in enumerate(sizes, 1):
        total += size
        if total >= most or i == len(sizes):
            yield at, i
            at, total = i, 0


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and ids (little-endian unsigned 32-bit integers, as binary) of every whole text.

    ``vocabulary`` is the content of a tokenizers file; it is sent to the executors, and
    nothing is shuffled. One row per row, repeated rows and null ids too; a null text
    counts as empty and has no token. Only the two named columns are read. An empty table
    gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder = _encoder(shared.value)
        for b in batches:
            for lo, hi in parts_of(pc.binary_length(b.column(1)).fill_null(0).to_pylist()):
                ids = encoder.encode_all([t or "" for t in b.column(1)[lo:hi].to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["k", "n_tokens", "ids"])

    plain = docs.select(F.col(quoted(id_col)).alias("k"), F.col(quoted(text_col)).alias("x"))
    return plain.mapInArrow(run, f"k {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary").withColumnRenamed("k", id_col)


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with the column text that its ids stand for, special tokens included; null ids give a null text. A column text is replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kept = encoded.drop("text")
    at = kept.columns.index("ids")
    names = [f"k{i}" for i in range(len(kept.columns))]
    plain = kept.toDF(*names)

    def run(batches):
        machine = _machine(shared.value)
        for b in batches:
            for lo, hi in parts_of(pc.binary_length(b.column(at)).fill_null(0).to_pylist()):
                texts = [None if i is None else machine.decode(np.frombuffer(i, "<u4")) for i in b.column(at)[lo:hi].to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(texts, pa.string())], names=[*names, "text"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, text string").toDF(*kept.columns, "text")
