"""Words of Arrow text columns as NumPy arrays, inside tasks.

A word is a run of ASCII letters and digits and of bytes beyond ASCII; A-Z
counts as a-z. All work is on whole slices of a batch: the bytes of many texts
are classified, cut and hashed together.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
# Another law for words: whatever stands between ASCII blanks.
NO_BLANK = np.ones(256, dtype=bool)
NO_BLANK[32] = NO_BLANK[9:14] = False


def slices(batch, column="text", max_bytes=SLICE_BYTES):
    """Cut a record batch so that each part holds at most `max_bytes` of text, or one row."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def lengths(array):
    """Bytes of each text; null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(array):
    """All bytes of a text column and the offsets of its texts; null is empty."""
    import pyarrow.compute as pc

    array = pc.fill_null(array, "").cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset: array.offset + len(array) + 1]
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice: `hashes` of all, and `bounds[i]:bounds[i + 1]` those of text `i`."""

    hashes: np.ndarray
    bounds: np.ndarray

    def text_of(self):
        """The number of the text of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def scramble(x):
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_spans(data, starts, ends):
    """A 64-bit hash of every span, eight bytes at a time over all spans at once."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live, at = np.arange(len(starts)), starts
    while len(live):
        left = ends[live] - at
        lane = lanes[at]
        short = np.minimum(left, 8).astype(np.uint64)
        lane &= ~np.uint64(0) >> ((np.uint64(8) - short) * np.uint64(8))
        out[live] = (out[live] ^ lane) * np.uint64(0xD6E8FEB86659FD93)
        out[live] ^= out[live] >> np.uint64(32)
        more = left > 8
        live, at = live[more], at[more] + 8
    return scramble(out)


def words_of(array, in_word=_IN_WORD) -> Words:
    data, offsets = text_bytes(array)
    data = _LOWER[data]
    inside = in_word[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    # Texts touch in the buffer: a word ends where its text ends.
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.nonzero(inside & ~before)[0]
    ends = np.nonzero(inside & ~after)[0] + 1
    return Words(_hash_spans(data, starts, ends), np.searchsorted(starts, offsets))
