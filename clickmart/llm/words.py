"""The words of many texts at once, as arrays: where they start and end, whose they are, and their XXH64."""

from __future__ import annotations

import numpy as np
import xxhash

ONE, TWO, THREE, FOUR, FIVE = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\v\f\r")] = True
#: Words of more bytes are hashed one by one.
SHORT = 31


def turned(values: np.ndarray, bits: int) -> np.ndarray:
    return (values << np.uint64(bits)) | (values >> np.uint64(64 - bits))


def xxh64(octets: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the words of ``octets``, which goes on for 8 octets or more behind the last."""
    eight = np.ndarray(len(octets) - 7, "<u8", octets, strides=(1,))  # from each octet on
    found, at = size.astype(np.uint64) + FIVE, start.copy()
    for read in range(8, min(int(size.max(initial=0)), SHORT) + 1, 8):
        on = np.flatnonzero(size >= read)
        found[on] = turned(found[on] ^ turned(eight[at[on]] * TWO, 31) * ONE, 27) * ONE + FOUR
        at[on] += 8
    on = np.flatnonzero(size & 4)
    found[on] = turned(found[on] ^ (eight[at[on]] & np.uint64(2**32 - 1)) * ONE, 23) * TWO + THREE
    at[on] += 4
    left, last = size & 3, eight[at]
    for k in range(3):
        on = np.flatnonzero(left > k)
        found[on] = turned(found[on] ^ (last[on] >> np.uint64(8 * k) & np.uint64(255)) * FIVE, 11) * ONE
    found = (found ^ found >> np.uint64(33)) * TWO
    found = (found ^ found >> np.uint64(29)) * THREE
    found ^= found >> np.uint64(32)
    for i in np.flatnonzero(size > SHORT):
        found[i] = xxhash.xxh64_intdigest(octets[start[i] : start[i] + size[i]].tobytes())
    return found


class Words:
    """The words of ``texts``, lower-cased (A-Z): their hashes, the text of each, and whether it is the first of its line."""

    def __init__(self, texts: list[bytes]):
        octets = np.frombuffer(b"\n".join([b"", *texts, b" " * 8]).lower(), np.uint8)
        inside = ~SPACE[octets]  # both ends are white space
        start, end = (np.flatnonzero(np.diff(inside.astype(np.int8)) == step) + 1 for step in (1, -1))
        self.hashes = xxh64(octets, start, end - start)
        begins = np.cumsum([1, *(len(text) + 1 for text in texts)])
        self.sizes = np.diff(np.searchsorted(start, begins))
        self.of = np.repeat(np.arange(len(texts)), self.sizes)
        line = np.searchsorted(np.flatnonzero(octets == 10), start)
        self.new_line = np.diff(line, prepend=-1) > 0
