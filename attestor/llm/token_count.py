"""Token counts of whole texts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.tokenizer_io import by_bytes, encoder, n_bytes, split_text

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16


def token_lengths(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> list[int]:
    """Number of tokens of each text; batches hold at most ``batch_bytes``, long texts are cut where it is safe."""
    encode = encoder(path)
    pieces, owner = [], []
    for i, text in enumerate(texts):
        for piece in split_text(text, path, piece_chars):
            pieces.append(piece)
            owner.append(i)
    out = [0] * len(texts)
    for a, b in by_bytes([n_bytes(p) for p in pieces], batch_bytes):
        for i, ids in zip(owner[a:b], encode(pieces[a:b]), strict=True):
            out[i] += len(ids)
    return out


def count_tokens(
    df: DataFrame,
    model_path: str,
    text_col: str = "text",
    out_col: str = "n_tokens",
    limit: int | None = None,
    batch_bytes: int = BATCH_BYTES,
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """Add ``out_col`` (long), the tokens of ``text_col`` as the library for ``model_path`` gives them.

    ``model_path`` ends in .json (tokenizers) or .model (sentencepiece) and must exist on every executor.
    Only lengths leave the Python workers. With ``limit``, also adds boolean ``over_limit``.
    Null and empty texts have 0 tokens; rows, ties, repeats and other columns are kept as they are; a
    column named ``out_col`` is replaced; an empty table gives an empty table. Needs no shuffle.
    """
    if os.path.splitext(model_path)[1] not in (".json", ".model"):
        raise ValueError(f"no library for {model_path}")

    @F.arrow_udf(T.LongType())
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = pc.fill_null(batch, "")
            yield pa.array(token_lengths(texts.to_pylist(), model_path, batch_bytes, piece_chars), pa.int64())

    out = df.withColumn(out_col, lengths(F.col(text_col)))
    return out if limit is None else out.withColumn("over_limit", F.col(out_col) > limit)
