"""Token ids of whole texts, as the tokenizers library gives them for a byte-level BPE file.

White space cuts a text into chunks that tokenize independently of each other, so a
chunk's ids are kept in a bounded memory of the task. New chunks are encoded from the same
vocabulary's ranks, several times faster than by the library itself; texts that hold the
special token go to the library. ``tests/llm`` holds the two equal.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL = "<|endoftext|>"
END = array("I", [2]).tobytes()
#: Unicode's white space, which is what the tokenizer's pattern calls white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Chunks that a task remembers at most; beyond it starts anew.
REMEMBERED = 300_000


class Memory(dict):
    """Chunk -> its ids as little-endian 32-bit numbers."""

    def __init__(self, ranks: str) -> None:
        import tiktoken

        pairs = (line.split() for line in open(ranks, "rb"))
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = ids = array("I", self.coder.encode_ordinary(chunk)).tobytes()
        return ids


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _memory(path: str) -> Memory:
    return Memory(path)


def encode(text: str, library: str, ranks: str) -> bytes:
    """Ids of a text, four little-endian bytes each, without special tokens added."""
    if SPECIAL in text:
        return array("I", _library(library).encode(text, add_special_tokens=False).ids).tobytes()
    return b"".join(map(_memory(ranks).__getitem__, CHUNK.findall(text)))


def pieces(docs: DataFrame, capacity: int = 1024, text: str = "text", id: str = "doc_id", library: str | None = None, ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of each document's ids and a closing 2.

    Documents of more than ``capacity`` ids are cut into pieces of ``capacity``; only the first
    may be shorter. A null text counts as empty and gives one piece, the closing id. The two
    paths name the same vocabulary and are looked up on the executors.
    """
    named, coded = library or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, start, length, crc, held = [], [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                ids = encode(t, named, coded) + END
                n = len(ids) // 4
                first = n % capacity or capacity
                for i, end in enumerate(range(min(first, n), n + 1, capacity)):
                    begin = max(0, end - capacity) if i else 0
                    part = ids[4 * begin : 4 * end]
                    at.append(row)
                    number.append(i)
                    start.append(begin)
                    length.append(end - begin)
                    crc.append(zlib.crc32(part))
                    held.append(part if keep_ids else None)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(held, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = f"`{id}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return docs.select(id, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, out)
