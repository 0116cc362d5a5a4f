"""Words of many texts at once: byte offsets and 64-bit hashes as numpy arrays.

A polynomial hash of every word comes from one running sum over the bytes, so no Python
code runs per word.  Texts are handled in chunks of bounded size; a single text longer than
that makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE, WORD, MARK = 0, 1, 2
_KIND = np.full(256, MARK, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
for _low, _high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _KIND[_low : _high + 1] = WORD

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(str(base))
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[str(base)] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """UTF-8 forms of the texts (null: empty), in lists of about `limit` bytes."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        raw = t.encode("utf-8", "replace") if isinstance(t, str) else b""
        if held and size + len(raw) > limit:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def tokens(blobs: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(text number, kind, hash) of each token, in order, and its hashes cut to `prefixes`.

    A token is a run of letters, digits and non-ASCII bytes (WORD) or a run of other
    visible bytes (MARK).  A-Z count as a-z.  The prefixes are given in bytes; a token that
    is not longer has its own hash there.
    """
    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs))
    joined = np.frombuffer(b"\n".join(blobs).lower() + b"\n", np.uint8)
    kind = _KIND[joined]
    change = np.empty(len(kind), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    edges = np.flatnonzero(change)
    ends = np.append(edges[1:], len(kind))
    kinds = kind[edges]
    seen = kinds != SPACE
    starts, ends, kinds = edges[seen], ends[seen], kinds[seen]
    running = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(joined)), out=running[1:])
    shift = _power(_INVERSE, len(joined))[starts]
    cut = [mix((running[np.minimum(ends, starts + p)] - running[starts]) * shift) for p in prefixes]
    hashes = mix((running[ends] - running[starts]) * shift)
    offsets = np.cumsum(lengths + 1)
    return np.searchsorted(offsets, starts, "right"), kinds, hashes, *cut


def counted(owner: np.ndarray, buckets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, count) of the distinct buckets of each text."""
    keys, counts = np.unique((owner.astype(np.int64) << bits) | buckets.astype(np.int64), return_counts=True)
    return keys >> bits, keys & ((1 << bits) - 1), counts
