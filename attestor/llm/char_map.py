"""The compiled character map of a SentencePiece normaliser, and normalisation that keeps byte offsets."""

from __future__ import annotations

import struct

import numpy as np

MARK = "▁".encode()
_SPACE = 0x20


class CharMap:
    """Longest-prefix rewriting by a double-array trie followed by a block of null-ended replacements.

    The trie is a public format: units of 32 bits hold a label, an offset to the children and a flag for
    a leaf, whose value is the place of the replacement.
    """

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.strings = blob[4 + size :]
        self._memo: dict[bytes, tuple[int, bytes] | None] = {}

    def __bool__(self) -> bool:
        return bool(self.units)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes consumed and their replacement for the longest key that starts at ``at``."""
        units, node, found = self.units, 0, None
        node ^= self._offset(units[0])
        for i in range(at, len(data)):
            byte = data[i]
            if byte == 0:
                break
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[start : self.strings.index(b"\0", start)])
        return found


def _char_len(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def rewrite(data: bytes, char_map: CharMap) -> tuple[bytes, np.ndarray]:
    """Rewritten bytes, and for each of them plus the end the offset in ``data`` it came from."""
    if not char_map:
        return data, np.arange(len(data) + 1, dtype=np.int64)
    out, source, at = bytearray(), [], 0
    while at < len(data):
        hit = char_map.longest(data, at)
        used, new = hit if hit else (_char_len(data[at]), data[at : at + _char_len(data[at])])
        out += new
        source += [at] * len(new)
        at += used
    return bytes(out), np.array([*source, len(data)], dtype=np.int64)


def normalise(data: bytes, char_map: CharMap, dummy_prefix: bool, squeeze: bool, escape: bool) -> tuple[bytes, np.ndarray]:
    """Normalised bytes and their alignment (one entry more than bytes; entry i is the source offset of byte i).

    ``squeeze`` drops leading and trailing spaces and all but one of a run; ``dummy_prefix`` puts a space
    first unless nothing is left; ``escape`` writes each space as U+2581.
    """
    if not data:
        return b"", np.zeros(1, dtype=np.int64)
    text, source = rewrite(data, char_map)
    if squeeze:
        raw = np.frombuffer(text, np.uint8)
        space = raw == _SPACE
        keep = ~(space & np.concatenate(([True], space[:-1])))
        if len(raw):
            last = len(raw) - 1
            while last >= 0 and space[last]:
                keep[last] = False
                last -= 1
            end = source[last + 1] if last >= 0 else source[-1]
            text, source = raw[keep].tobytes(), np.append(source[:-1][keep], end)
    if not text:
        return b"", source[-1:]
    if dummy_prefix:
        text, source = b" " + text, np.concatenate((source[:1], source))
    if not escape:
        return text, source
    raw = np.frombuffer(text, np.uint8)
    widths = np.where(raw == _SPACE, len(MARK), 1)
    return text.replace(b" ", MARK), np.append(np.repeat(source[:-1], widths), source[-1])
