"""Content-defined anchors of byte strings: in every window the substring of least hash."""

from __future__ import annotations

import numpy as np

#: Bytes of a repeated string that counts, of an anchor, and of the context that a window can hold beside it.
WINDOW, ANCHOR = 200, 64
SIDE = WINDOW - ANCHOR
CHUNK = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MULT
    return h ^ (h >> np.uint64(29))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least (or greatest) of every ``width`` consecutive values, by doubling."""
    size, out = 1, x
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def _chunk_anchors(raw: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows that start in [first, last) of ``raw``: positions, hashes and hashes with context."""
    lo, hi = max(0, first - SIDE), min(len(raw), last - 1 + WINDOW + SIDE)
    data = raw[lo:hi]
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:-1], out=sums[1:])

    def spans(a, b):
        return (sums[b] - sums[a]) * inverse[a]

    a, b = first - lo, last - lo  # window starts, within data
    at = slice(a, b - 1 + WINDOW - ANCHOR + 1)
    hashes = _mix((sums[at.start + ANCHOR : at.stop + ANCHOR] - sums[at]) * inverse[at])
    order = (hashes >> np.uint64(32)).astype(np.uint32)
    least = _slide(order, SIDE + 1, np.minimum)
    pad = np.zeros(SIDE, np.uint32)
    chosen = _slide(np.concatenate([pad, least, pad]), SIDE + 1, np.maximum) == order
    spot = np.flatnonzero(chosen)
    here = spot + a
    left, right = np.maximum(here - SIDE, 0), np.minimum(here + WINDOW, len(data))
    context = _mix(spans(left, right) + ((right - left) * 1024 + here - left).astype(np.uint64) * _MULT)
    return here + lo, hashes[spot].view(np.int64), context.view(np.int64)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, anchor hashes, and hashes of each anchor with up to SIDE bytes of context on either side.

    Every window of WINDOW bytes has an anchor inside, chosen by its content alone, so that equal windows have equal
    anchors at the same place. Long texts are taken in chunks of windows with equal results.
    """
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [_chunk_anchors(raw, a, min(n, a + CHUNK)) for a in range(0, n, CHUNK)]
    if len(parts) == 1:
        return parts[0]
    position, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
    return position, np.concatenate([p[1] for p in parts])[first], np.concatenate([p[2] for p in parts])[first]
