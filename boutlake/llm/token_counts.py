"""Token counts in Arrow functions: lengths only, batches balanced by bytes, long texts split at safe boundaries.

A safe boundary is where white space follows a character that is none: the
byte-level pattern always starts a piece there, and no special token of the
vocabulary holds white space. Segments that are still long are also cut between an
ASCII letter and an ASCII digit, which no piece and no special token holds side by
side. A longer run of one kind is a single piece of the pattern, which can't be cut.
So a text's count is the sum over its segments, and each distinct segment of a batch
is encoded once.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from boutlake.llm.common import Recent, id_and_text

# Unicode's White_Space, which the pattern's \s means.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEGMENT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
WITHIN = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
LONG = 4096


@lru_cache(maxsize=2)
def _counter(vocabulary: str, batch_bytes: int) -> SegmentCounter:
    return SegmentCounter(vocabulary, batch_bytes)


class SegmentCounter:
    """Counts of segments by the tokenizers library, with a bounded memory of the segments met."""

    def __init__(self, vocabulary: str, batch_bytes: int = 1 << 18, max_known: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.batch_bytes = batch_bytes
        self.known = Recent(max_known)

    def lengths(self, segments: list[str]) -> list[int]:
        """Token counts of distinct segments, encoded in batches of near-equal bytes."""
        out, batch, size = [], [], 0
        for s in segments:
            batch.append(s)
            size += len(s.encode("utf-8"))
            if size >= self.batch_bytes:
                out += [len(e) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
                batch, size = [], 0
        return out + [len(e) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        split = [self.segments(t) for t in texts]
        found: dict[str, int] = {}
        new = []
        for s in set(chain.from_iterable(split)):
            n = self.known.get(s)
            if n is None:
                new.append(s)
            else:
                found[s] = n
        new.sort(key=len)
        for s, n in zip(new, self.lengths(new)):
            found[s] = n
            if len(s) <= 64:
                self.known.put(s, n)
        get = found.__getitem__
        return [sum(map(get, s)) for s in split]

    @staticmethod
    def segments(text: str) -> list[str]:
        """The text cut at its safe boundaries: white space and what follows up to the next."""
        found = SEGMENT.findall(text)
        if max(map(len, found), default=0) > LONG:
            return [s for long in found for s in (WITHIN.split(long) if len(long) > LONG else [long])]
        return found


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, batch_bytes: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every whole text. ``vocabulary`` is the content of a tokenizers file.

    One row per row, repeated rows and null ids too; a null text counts as empty, with
    no token. Only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, batch_bytes))

    def run(batches):
        counter = _counter(*shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n_bytes = [len(t.encode("utf-8")) for t in texts]
            counts: list[int] = []
            at = size = 0
            for i, n in enumerate(n_bytes, 1):
                size += n
                if size >= 16 * batch_bytes or i == len(texts):
                    counts += counter.count(texts[at:i])
                    at, size = i, 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    plain, id_type = id_and_text(docs, id_col, text_col)
    return plain.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
