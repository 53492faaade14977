"""Token counts under a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Directory of the public vocabulary files.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer cuts text before merging (the published pattern of its byte-level BPE).
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: No token runs from a non-blank into a blank, so a text's count is the sum over these pieces, most of which recur.
PIECE = re.compile(r"\s*\S+|\s+")
#: Pieces remembered by a worker; then it starts anew.
REMEMBERED = 400_000


class Counter(dict):
    """Piece to token count, counted when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counted", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) < 60:
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self) > REMEMBERED:
            self.clear()
        return sum(map(self.__getitem__, PIECE.findall(text)))


def with_token_counts(docs: DataFrame, text: str = "text", column: str = "tokens", path: str | None = None) -> DataFrame:
    """The table with the text replaced by its number of tokens; null and empty texts have 0. The text leaves the plan here."""
    path = path or f"{TOKENIZER_DIR}/{VOCABULARY}"
    kept = [c for c in docs.columns if c not in (text, column)]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add(column, T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(path)
            counts = [counter.count(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(counts, pa.int32())], names=[*kept, column])

    return docs.mapInArrow(run, schema)
