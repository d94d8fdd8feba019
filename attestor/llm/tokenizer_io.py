"""Tokenizer handles cached per Python worker, and texts cut into batches of bounded bytes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

#: A space between two ASCII letters or digits: no token of a proven vocabulary crosses it.
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")
MARK = "▁"


@lru_cache(maxsize=4)
def sentencepiece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def json_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def model_proto(path: str):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto


@lru_cache(maxsize=4)
def splits_at_spaces(path: str) -> bool:
    """Whether a .model encodes ``a b`` as ``a`` followed by ``b`` on its own.

    True if its normaliser maps nothing and keeps white space, puts a mark before the first word,
    and no piece holds the mark after another character.
    """
    proto = model_proto(path)
    spec = proto.normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
    return bool(
        plain
        and not proto.trainer_spec.treat_whitespace_as_suffix
        and not any(MARK in p.piece.lstrip(MARK) or p.type == p.USER_DEFINED for p in proto.pieces)
    )


#: Fixed value: the pattern of a word tokenizer whose words, kept while all else is dropped, never hold white space.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_HARMLESS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})


@lru_cache(maxsize=4)
def json_splits_at_spaces(path: str) -> bool:
    """Whether a .json tokenizer encodes a text as it encodes the two parts at a single space between ASCII letters or digits.

    Proven for two makes whose words never hold white space behind anything else: bytes with the regular expression
    that lets a word begin with its space, without normaliser; and the word pattern _WORDS, behind normalisers
    that work character by character. No added token may hold, or swallow, white space.
    """
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    if any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in made.get("added_tokens", [])):
        return False
    pre, normalizer = made.get("pre_tokenizer") or {}, made.get("normalizer")
    if pre.get("type") == "ByteLevel":
        return normalizer is None and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    steps = pre.get("pretokenizers", []) if pre.get("type") == "Sequence" else [pre]
    first = steps[0] if steps else {}
    words = first.get("type") == "Split" and first.get("pattern") == {"Regex": _WORDS} and first.get("behavior") == "Removed" and first.get("invert") is True
    norms = [] if normalizer is None else normalizer.get("normalizers", [normalizer])
    return bool(words and all(n in _HARMLESS for n in norms) and all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space", True) and not s.get("use_regex", True) for s in steps[1:]))


def split_text(text: str, path: str, limit: int) -> list[str]:
    """Cut a text of over ``limit`` characters at single spaces between ASCII letters or digits, if that is proven safe for this tokenizer.

    A tokenizer without proof, and a text without such spaces (as in scripts without them), stays whole. Pieces
    of a .json tokenizer keep the space that leads them, those of a .model lose it to the mark that the library puts
    before each piece.
    """
    proven = splits_at_spaces if path.endswith(".model") else json_splits_at_spaces
    if len(text) <= limit or not proven(path):
        return [text]
    skip = 1 if path.endswith(".model") else 0
    parts, start = [], 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.start() + skip
    return [*parts, text[start:]]


def encoder(path: str) -> Callable[[list[str]], list]:
    """Texts to lists of ids, without begin, end or added special tokens."""
    if path.endswith(".model"):
        model = sentencepiece_model(path)
        return lambda texts: model.encode(texts, num_threads=1)
    tokenizer = json_tokenizer(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of at most ``limit`` bytes together, or of one larger item."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
