"""Content-defined chunks: where a rolling hash of the last 32 bytes says so, whatever stands around."""

from __future__ import annotations

import numpy as np

from skytally.llm.words import randoms

BITS, LEAST, MOST = 9, 128, 4096
_GEAR = (randoms(256, 31) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte a hash of it and the 31 before it; a byte's share moves up one bit a step and then out."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return h


def chunk_ends(data: bytes, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Where the chunks of UTF-8 text end; the last end is its length, an empty text has none.

    A chunk ends where the rolling hash begins with `bits` zeros, after `least`
    bytes, and after `most` bytes in any case; no character is parted.
    """
    ends, start = [], 0
    if len(data) > least:
        codes = np.frombuffer(data, np.uint8)
        found = np.flatnonzero(rolling(codes) < np.uint32(1 << (32 - bits))) + 1
        found = found[found < len(data)]
        found = found[(codes[found] & 0xC0) != 0x80]
        for end in [*found.tolist(), len(data)]:
            while end - start > most:
                cut = start + most
                while data[cut] & 0xC0 == 0x80 and cut > start + most - 4:
                    cut -= 1
                ends.append(cut)
                start = cut
            if end - start >= least:
                ends.append(end)
                start = end
    if start < len(data):
        ends.append(len(data))
    return ends
