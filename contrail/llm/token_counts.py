"""Exact token counts by overlapping chunks that are spliced where the tokenizer provably cannot look across.

A huge text is encoded in overlapping chunks with character offsets. Two neighbouring chunks are joined at a position that
both cut and at which no vocabulary piece holds the two characters around it next to each other. Merging never makes
anything but vocabulary pieces, so no merge crosses such a position: what lies before it does not depend on what follows,
and the reverse. When the overlap holds no such position it is doubled, and at last the left chunk is grown.

Defined cases: a null or empty text has no tokens and no bytes; repeated rows are counted one by one; other columns of the
input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.shared import arrow_rows, map_texts

CHUNK = 32_768
OVERLAP = 256
LIMIT = 4096
SPACE = "▁"


class SplicedTokenizer:
    """A sentencepiece model with the bigrams that its pieces hold."""

    def __init__(self, model: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0
        self.joined: set[tuple[str, str]] = set()
        for i in range(self.processor.get_piece_size()):
            if not (self.processor.is_byte(i) or self.processor.is_control(i)):
                piece = self.processor.id_to_piece(i)
                self.joined.update(zip(piece, piece[1:], strict=False))

    def stable(self, before: str, after: str) -> bool:
        """No merge crosses from one character to the next, and normalising leaves both as they are."""
        a, b = (SPACE if c == " " else c for c in (before, after))
        return (a, b) not in self.joined and self.processor.normalize(f"{before}{after}").endswith(f"{a}{b}")

    def starts(self, text: str, begin: int, end: int) -> list[int]:
        """First character of each token of text[begin:end], counted in the whole text."""
        return [begin + a for a, _ in self.processor.encode(text[begin:end], return_type="offset_mapping")["offsets"]]

    def common(self, text: str, left: list[int], right: list[int], begin: int, floor: int, end: int) -> int | None:
        """Last stable position that both encodings cut, after the first character of the right one."""
        both = {p for p in left if p >= floor} & set(right[: end - begin + 8])
        for p in sorted(both, reverse=True):
            if max(begin + 1, floor) <= p < end and self.stable(text[p - 1], text[p]):
                return p
        return None

    def count(self, text: str) -> int:
        """Tokens of one text, holding the offsets of two chunks at a time."""
        size = len(text)
        if size <= self.chunk:
            return len(self.processor.encode(text))
        total, done, begin, end = 0, 0, 0, self.chunk
        left = self.starts(text, begin, end)
        while end < size:
            width, cut = self.overlap, None
            while cut is None and (start := end - width) > begin:
                stop = min(size, start + width + self.chunk)
                right = self.starts(text, start, stop)
                cut = self.common(text, left, right, start, done + 1, end)
                width *= 2
                self.widened += cut is None
            if cut is None:  # nothing to splice at in the whole left chunk: take a longer one
                end = min(size, end + (end - begin))
                left = self.starts(text, begin, end)
                continue
            total += sum(done <= p < cut for p in left)
            done, begin, end, left = cut, start, stop, right
        return total + sum(p >= done for p in left)

    def counts(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        out = [0] * len(texts)
        for i, ids in zip(short, self.processor.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.count(t)
        return out


@lru_cache(maxsize=4)
def tokenizer(model: str, chunk: int, overlap: int) -> SplicedTokenizer:
    """One loaded model for each worker process."""
    return SplicedTokenizer(model, chunk, overlap)


def over_limit(tokens: Column, limit: int = LIMIT) -> Column:
    return tokens > F.lit(limit)


def token_counts(
    df: DataFrame, model: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row per input row: key, n_bytes (UTF-8), n_tokens. `model` is a path that every worker has."""
    arrow_rows(df.sparkSession, 128)

    def compute(texts: list[str | None]) -> list[pa.Array]:
        plain = [t or "" for t in texts]
        counts = tokenizer(model, chunk, overlap).counts(plain)
        return [pa.array([len(t.encode()) for t in plain], pa.int64()), pa.array(counts, pa.int64())]

    fields = [T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)]
    return map_texts(df, [key], text, fields, compute)
