"""SentencePiece encoding whose pieces keep their byte spans in the source text, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestor.llm.char_map import CharMap, normalise
from attestor.llm.tokenizer_io import by_bytes, model_proto, sentencepiece_model, split_text

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16


@lru_cache(maxsize=4)
def _parts(path: str):
    proto = model_proto(path)
    widths = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
    return CharMap(proto.normalizer_spec.precompiled_charsmap), proto.normalizer_spec, widths, proto.trainer_spec.unk_id


def piece_ends(text: str, ids: np.ndarray, path: str, pieces: list[str] | None = None) -> np.ndarray:
    """Source byte offset at which each piece ends; a piece begins where the one before it ends.

    The pieces tile the normalised text. Where a model has an unknown piece without byte fallback,
    ``pieces`` gives the surface of each.
    """
    char_map, spec, widths, unk = _parts(path)
    if not len(ids):
        return np.zeros(0, dtype=np.int64)
    text_bytes = text.encode()
    plain, source = normalise(text_bytes, char_map, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    sizes = widths[ids]
    if pieces is not None:
        at = np.flatnonzero(ids == unk)
        sizes[at] = [len(pieces[i].encode()) for i in at]
    ends = np.cumsum(sizes)
    if ends[-1] != len(plain):
        raise ValueError("the pieces do not tile the normalised text")
    return source[ends]


def encode_texts(texts: list[str], path: str, spans: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """(ids, ends, decoded text) of each text."""
    model = sentencepiece_model(path)
    unk = _parts(path)[3]
    chunks = [split_text(t, path, PIECE_CHARS) for t in texts]
    coded = iter(model.encode([c for cs in chunks for c in cs], num_threads=1))
    lists = [[i for _ in cs for i in next(coded)] if len(cs) > 1 else next(coded) for cs in chunks]
    for text, ids, decoded in zip(texts, lists, model.decode(lists, num_threads=1), strict=True):
        array = np.array(ids, dtype=np.int64)
        pieces = model.id_to_piece(ids) if spans and (array == unk).any() else None
        if pieces is not None:
            pieces = model.encode(text, out_type=str)
        yield array, piece_ends(text, array, path, pieces) if spans else array[:0], decoded


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32), pa.int32()))


def encode_pieces(df: DataFrame, model_path: str, text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Add ``piece_ids``, ``piece_ends`` (arrays of int) and ``decoded`` (string) to each row.

    Ids are those of the sentencepiece library for the whole text without begin or end ids; piece i covers
    source bytes ``[piece_ends[i-1], piece_ends[i])`` (0 before the first), found by normalising with the
    model's compiled character map while recording the source of every byte. ``decoded`` is the library's
    decode of the ids. Null and empty texts give empty arrays and ''. Existing columns of these three
    names are replaced, others pass through unread; rows, ties and repeats stay; no shuffle. Long texts
    are encoded in chunks where the vocabulary proves that safe, and each output batch holds at most
    ``batch_bytes`` of text or one document.
    """
    added = ("piece_ids", "piece_ends", "decoded")
    df = df.drop(*added)
    names = df.columns
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.schema.fields, T.StructField("piece_ids", ints), T.StructField("piece_ends", ints), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(text_col))
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for a, b in by_bytes(sizes, batch_bytes):
                texts = pc.fill_null(column.slice(a, b - a), "").to_pylist()
                coded = list(encode_texts(texts, model_path))
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, b - a) for c in batch.columns]
                    + [_lists([x[0] for x in coded]), _lists([x[1] for x in coded]), pa.array([x[2] for x in coded], pa.string())],
                    names=[*names, *added],
                )

    return df.mapInArrow(run, schema)
