"""Word hashes of many texts at once with numpy, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
#: Texts are hashed in buffers of about so many bytes, which bounds memory.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F) + np.uint64(1))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        n = max(n, CHUNK + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base & _MASK, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def _buffer(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one buffer."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SPACE[data], out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    up, down = _tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts


def _segments(raw: bytes) -> Iterator[bytes]:
    """Pieces of a long text, cut at white space; a longer word stays whole."""
    at = 0
    while len(raw) - at > CHUNK:
        cut = next((k for k in range(at + CHUNK, at, -1) if _SPACE[raw[k]]), None) or next((k for k in range(at + CHUNK, len(raw)) if _SPACE[raw[k]]), len(raw))
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order. Words are runs of bytes other than ASCII white space."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if held:
            hashes, starts = _buffer(b" ".join(held))
            edges = np.cumsum([0, *(len(x) + 1 for x in held)])
            cuts = np.searchsorted(starts, edges)
            for i in range(len(held)):
                yield hashes[cuts[i] : cuts[i + 1]]
            held.clear()

    for text in texts:
        if len(text) > CHUNK:
            yield from flush()
            size = 0
            yield np.concatenate([_buffer(x)[0] for x in _segments(text)])
            continue
        if size + len(text) > CHUNK:
            yield from flush()
            size = 0
        held.append(text)
        size += len(text) + 1
    yield from flush()
