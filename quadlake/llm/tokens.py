"""Byte-level BPE of every document.

Method: two-tier look-up. Text is split into pre-tokens; a minimal perfect hash
resolves those that are vocabulary entries as a whole, all others are merged
with a heap over linked bytes. A bounded memo keeps both kinds of answers.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadlake.llm.perfect_hash import PerfectHash
from quadlake.session import ship

#: Where the rank files lie; a parameter of every function below.
FOLDER = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Pre-tokens kept in a worker's memo, and the longest of them.
MEMO, MEMO_LENGTH = 200_000, 64
#: Bytes of the largest rank file that is sent to executors.
MAX_FILE = 32 << 20
#: Characters from which the pieces of a text are not held all at once.
LONG_TEXT = 1_000_000
#: Characters of text after which a record batch is cut.
BATCH_CHARS = 8_000_000
#: The characters with the White_Space property.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The endings that are pre-tokens of their own.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _ranges(wanted: str) -> str:
    """A character class of all code points whose category begins so."""
    out, first = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i)).startswith(wanted)
        if inside and first is None:
            first = i
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{i - 1:08x}")
            first = None
    return "".join(out)


def _pattern(space: str, letter: str, number: str) -> str:
    other = f"[^{space}{letter}{number}]"
    return "|".join([*ENDINGS, f" ?[{letter}]+", f" ?[{number}]+", f" ?{other}+", f"[{space}]+(?![^{space}])", f"[{space}]+"])


@lru_cache(maxsize=1)
def split_pattern() -> str:
    """Splitting pattern of the rank files, for the standard library's re."""
    return _pattern(WHITE_SPACE, _ranges("L"), _ranges("N"))


#: The same for text in ASCII, where it finds the same pieces in less time.
ASCII_PATTERN = _pattern("\t-\r ", "A-Za-z", "0-9")


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary entries of a rank file in order of their ids 0, 1, ..."""
    ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ids are not 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


class Encoder(dict):
    """Ids of texts. The mapping itself is the memo: pre-token to the bytes of
    its int32 ids."""

    def __init__(self, entries: list[bytes], pattern: str | None = None, whole: PerfectHash | None = None):
        super().__init__()
        self.entries, self.pattern = entries, pattern or split_pattern()
        self.whole = whole or PerfectHash(entries)
        self.ranks = {t: i for i, t in enumerate(entries)}
        self.longest = max(map(len, entries), default=0)
        self.split, self.split_ascii = re.compile(self.pattern), re.compile(ASCII_PATTERN)

    def __reduce__(self):
        return Encoder, (self.entries, self.pattern, self.whole)  # the tables travel, the memo does not

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        found = self.whole.find(raw)
        ids = array("i", [found] if found >= 0 else self.merge(raw)).tobytes()
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a pre-token: the pair of neighbours with the lowest rank, the
        first of equals, is joined until no pair is an entry."""
        size, ranks, longest = len(raw), self.ranks, self.longest
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = after[i]
            # stale: i was joined to its left, or the pair has grown
            if middle < 0 or middle >= end or after[middle] != end:
                continue
            after[i], after[middle] = end, -1
            if end < size:
                before[end] = i
                if (far := after[end]) - i <= longest and (r := ranks.get(raw[i:far])) is not None:
                    heapq.heappush(heap, (r, i, far))
            if (left := before[i]) >= 0 and end - left <= longest and (r := ranks.get(raw[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        out, i = [], 0
        while i < size:
            out.append(ranks[raw[i : after[i]]])
            i = after[i]
        return out

    def encode_raw(self, text: str) -> bytes:
        pattern = self.split_ascii if text.isascii() else self.split
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.__getitem__, pattern.findall(text)))
        pieces = (m[0] for m in pattern.finditer(text))  # not all of them at once
        return b"".join(b"".join(map(self.__getitem__, part)) for part in iter(lambda: list(islice(pieces, LONG_TEXT // 8)), []))

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.encode_raw(text or "")).cast("i").tolist()

    def count(self, text: str | None) -> int:
        return len(self.encode_raw(text or "")) // 4


@lru_cache(maxsize=4)
def load_encoder(path: str) -> Encoder:
    return Encoder(read_ranks(path))


def shared_encoder(df: DataFrame, path: str | None = None) -> Callable[[], Encoder]:
    """A function that gives a worker its encoder. It is built once and sent
    once to each executor; a rank file over MAX_FILE bytes is refused."""
    ship(df.sparkSession)
    path = path or f"{FOLDER}/{BYTE_BPE}"
    if (size := Path(path).stat().st_size) > MAX_FILE:
        raise ValueError(f"a rank file of {size} bytes is too large to be sent to every executor")
    sent = df.sparkSession.sparkContext.broadcast(load_encoder(path))
    return lambda: sent.value


def text_batches(batches: Iterable[pa.RecordBatch], column: int, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that their texts hold about so many characters."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
        first = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > chars:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < len(sizes):
            yield batch.slice(first)


def encode_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """id_column and ids (array of int) of every row, without special tokens.

    Empty and null texts give an empty list. Texts are encoded whole, however
    long. Equal rows give equal rows; null ids stay null; other columns are not
    read. Empty input gives no rows. No shuffle.
    """
    rows = df.select(df[id_column], df[text_column])
    kind = rows.schema[0].dataType
    get = shared_encoder(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for batch in text_batches(batches, 1):
            ids = [encoder.encode_raw(t) if t else b"" for t in batch.column(1).to_pylist()]
            offsets = array("i", [0])
            for x in ids:
                offsets.append(offsets[-1] + len(x) // 4)
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_column, "ids"])

    return rows.mapInArrow(run, T.StructType([T.StructField(id_column, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_documents(df: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", path: str | None = None) -> DataFrame:
    """id_column and text, put together from the entries of the ids.

    Null and empty lists give the empty text; bytes that are no UTF-8 (of ids
    that no text has) become replacement characters. No shuffle.
    """
    rows = df.select(df[id_column], df[ids_column].cast("array<int>").alias("ids"))
    kind = rows.schema[0].dataType
    get = shared_encoder(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = get().entries
        for batch in batches:
            texts = [b"".join([entries[i] for i in ids or ()]).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return rows.mapInArrow(run, T.StructType([T.StructField(id_column, kind), T.StructField("text", T.StringType())]))
