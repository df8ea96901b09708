"""Operator 9: harmonic packing of tokenised documents into fixed-length sequences.

A document is its byte-pair ids and a closing id 0.  Lengths fall into
reciprocal-capacity classes: class k holds pieces of (capacity/(k+1), capacity/k]
tokens and each of its bins takes exactly k of them, so a bin needs no view of the
others and every worker fills its own bins.  A document is cut into whole sequences,
and what is left stays whole if k of its length fill a bin of its class but for
``slack`` of the capacity.  Otherwise the largest reciprocal of the capacity in it,
capacity // (k+1), is cut off, and the same holds for the rest.

What a worker has left open at its end is closed without padding: its pieces are
joined end to end and cut at the capacity and at the powers of two of the last stretch.
A worker keeps only the open bins, less than k pieces in class k, whatever the size of
its input.

Nulls: a null text counts as empty (one piece, id 0); a null id is kept as null.
Repeated rows are packed as often as they occur.  Other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.base import read, tune, worker_cache

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary_path() -> str:
    """The rank file of the public 50k byte-pair vocabulary (the one of ``byte_bpe_50k.json``)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str | None = None, pattern: str | None = None):
    """A ``tiktoken`` encoding over a rank file: the ids of ``byte_bpe_50k.json``, about seven times faster."""
    import public_tokenizers
    import tiktoken

    with open(path or vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space as the pre-tokeniser sees it, so long that its look-ahead would run out of stack.
_LONG_GAP = re.compile(r"[^\S\x1C-\x1F]{4096,}")


def ids_of(text: str, encoding) -> list[int]:
    """The ids of a text.

    A long run of white space is one piece of the pre-tokeniser but for its last character
    before a word; such pieces are encoded by themselves, which gives the same ids.
    """
    if len(text) < 4096:
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for gap in _LONG_GAP.finditer(text):
        end = gap.end() - (gap.end() < len(text))
        ids += encoding.encode_ordinary(text[at : gap.start()])
        ids += encoding._encode_single_piece(text[gap.start() : end])
        at = end
    ids += encoding.encode_ordinary(text[at:])
    return ids


def cuts(length: int, capacity: int, slack: int):
    """Lengths of the pieces of a document of ``length`` tokens, in order; slack in tokens."""
    while length:
        k = max(1, capacity // length)
        if length >= capacity or capacity - k * length > slack:
            piece = capacity if length >= capacity else capacity // (k + 1)
            yield piece
            length -= piece
        else:
            yield length
            return


class Bins:
    """The open bins of one worker; ``place`` returns finished sequences as lists of pieces."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, {}

    def place(self, piece: tuple) -> list | None:
        """piece: (doc, start, length, bytes, doc_tokens)."""
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) < k:
            return None
        del self.open[k]
        return held

    def close(self):
        """The sequences left: each full, or a power of two long."""
        rests = [piece for _, held in sorted(self.open.items()) for piece in held]
        self.open = {}
        total, at = sum(p[2] for p in rests), 0
        room, row = 0, []
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if (total % self.capacity) >> b & 1]
        for doc, start, length, raw, whole in rests:
            while length:
                if not room:
                    room, at = sizes[at], at + 1
                n = min(room, length)
                row.append((doc, start, n, raw[: 4 * n], whole))
                start, length, raw, room = start + n, length - n, raw[4 * n :], room - n
                if not room:
                    yield row
                    row = []


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = 1024, slack: float = 1 / 16, path: str | None = None) -> DataFrame:
    """One row per piece; capacity is a power of two."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def work(batches):
        from pyspark import TaskContext

        encoding = worker_cache(("encoder", path), lambda: encoder(path))
        base, n_sequences = TaskContext.get().partitionId() << 40, 0
        bins, rows = Bins(capacity), []
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

        def put(sequence):
            nonlocal n_sequences
            offset, number = 0, base + n_sequences
            n_sequences += 1
            for doc, start, length, raw, whole in sequence:
                rows.append((doc, start, length, zlib.crc32(raw), whole, number, offset))
                offset += length

        def flush():
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(names))
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text, encoding) if text else []
                ids.append(0)
                raw, start, whole = np.array(ids, "<u4").tobytes(), 0, len(ids)
                for length in cuts(whole, capacity, int(slack * capacity)):
                    if done := bins.place((doc, start, length, raw[4 * start : 4 * (start + length)], whole)):
                        put(done)
                    start += length
                if len(rows) > 20_000:
                    yield flush()
        for sequence in bins.close():
            put(sequence)
        yield flush()

    tune(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(work, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, packed into sequences of 1024."""
    return pack(read(spark, sf_dir, "documents"))
