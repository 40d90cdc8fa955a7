"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed value: the split pattern that belongs to the byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT = "byte_bpe_multi_50k.tiktoken"

_loaded: dict = {}


def tokenizer_path(name: str = DEFAULT) -> str:
    """Where the installed public tokenizers lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The byte-level BPE whose ranks lie in `path`, loaded once a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(df: DataFrame, *, text: str = "text", keep: list[str], path: str | None = None) -> DataFrame:
    """(keep..., tokens int): each row's number of tokens; null text has none. Whole texts are read, in Arrow batches."""
    where = path or tokenizer_path()
    schema = df.select(*keep).schema.add("tokens", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        for b in batches:
            texts = b.column(b.schema.get_field_index("_text")).to_pylist()
            counts = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], counts], names=[*keep, "tokens"])

    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, schema)
