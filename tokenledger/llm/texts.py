"""Whole texts as number arrays: code points, words and their hashes.

A slice holds whole rows of about ``SLICE`` bytes, or one longer row, so a task
holds a few slices' worth of arrays however many rows its partition has.
"""

from __future__ import annotations

import sys
from types import ModuleType

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits."""
    x = x ^ (x >> _S)
    x = x * _M1
    x ^= x >> _S
    x = x * _M2
    x ^= x >> _S
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE):
    """Cut a batch into runs of whole rows of about ``size`` bytes."""
    array = batch.column(batch.schema.get_field_index(column))
    _, offsets = raw(array)
    start, n = 0, len(array)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield batch.slice(start, min(stop, n) - start)
        start = stop


def codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string column and the offsets of its rows in them."""
    data, offsets = raw(column)
    sizes = [np.count_nonzero((data[a:b] & 0xC0) != 0x80) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


_PLANE = 0x33480  # no letter is assigned above
_HELD = "tokenledger_code_point_tables"


def tables() -> dict[str, np.ndarray]:
    """Per code point: lower case, and whether it is a letter, digit, capital or space.

    Built once per Python worker; functions shipped by value have no module of
    their own to keep them in.
    """
    if _HELD not in sys.modules:
        holder = ModuleType(_HELD)
        holder.tables = _tables()
        sys.modules[_HELD] = holder
    return sys.modules[_HELD].tables


def _tables() -> dict[str, np.ndarray]:
    chars = [chr(i) for i in range(_PLANE)]
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
    flags = {
        "letter": np.array([c.isalpha() for c in chars]),
        "digit": np.array([c.isdigit() for c in chars]),
        "upper": np.array([c.isupper() for c in chars]),
        "space": np.array([c.isspace() for c in chars]),
    }
    return {"lower": lower, **flags}


def look(table: np.ndarray, points: np.ndarray) -> np.ndarray:
    """``table`` at ``points``; code points beyond it share its last entry."""
    return table[np.minimum(points, _PLANE - 1)]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true entries that stay within a row: starts, ends, row."""
    if not mask.size:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = np.zeros(mask.size, bool)
    first[offsets[:-1][offsets[:-1] < mask.size]] = True
    before = np.concatenate([[False], mask[:-1]])
    starts = np.flatnonzero(mask & (first | ~before))
    after = np.concatenate([mask[1:], [False]])
    last = np.concatenate([first[1:], [True]])
    ends = np.flatnonzero(mask & (last | ~after)) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Spans:
    """Sums over spans of a sequence that comes piece by piece; starts and ends ascend."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.bounds = (starts, ends)
        self.sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, name: str, total: np.ndarray, at: int) -> None:
        """``total``: running sums before each place of the piece that begins ``at``, and behind it."""
        sums = self.sums.setdefault(name, tuple(np.zeros(where.size, total.dtype) for where in self.bounds))
        for where, out in zip(self.bounds, sums):
            i, j = np.searchsorted(where, at, "left"), np.searchsorted(where, at + total.size - 1, "right")
            out[i:j] = total[where[i:j] - at]

    def __getitem__(self, name: str) -> np.ndarray:
        low, high = self.sums[name]
        return high - low


# Word bytes and their hashes. Spaces are U+0020 and U+0009 to U+000D; A to Z
# are lower-cased, all other bytes stay.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SEEDED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEEDED.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, _BASE)]), dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, piece: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every row: hash, start byte, end byte, row.

    ``space`` tells for each byte value whether it stands between words. Bytes are
    looked at in pieces, so a long text holds arrays of its words only."""
    starts, ends, row = runs(~space[data], offsets)
    if not starts.size:
        return np.zeros(0, np.uint64), starts, ends, row
    words = Spans(starts, ends)
    carried = np.uint64(0)
    for at in range(0, data.size, piece):
        part = data[at : at + piece]
        i, j = np.searchsorted(starts, (at, at + part.size))
        # Place of a byte in its word; the first word here may have begun in an earlier piece.
        begun = np.concatenate([[starts[i - 1] if i else at], starts[i:j]])
        place = np.arange(at, at + part.size) - np.repeat(begun, np.diff(np.concatenate([[at], starts[i:j], [at + part.size]])))
        value = _BYTE[part] * _POWERS[place & 4095]
        far = place > 4095  # later blocks of a very long word count under other powers
        value[far] = mix(value[far] + (place[far] >> 12).astype(np.uint64))
        value[space[part]] = 0
        total = np.zeros(part.size + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        total += carried
        carried = total[-1]
        words.add("value", total, at)
    return mix(words["value"] + (ends - starts).astype(np.uint64) * _BASE), starts, ends, row


def shingles(words: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of a row: hash, row, first word.

    A row with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    if not words.size:
        return words, row, row
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    n = words.size
    total = np.zeros(n, np.uint64)
    for i in range(min(size, n)):
        total[: n - i] = (total[: n - i] * _BASE) + mix(words[i:] + np.uint64(i + 1))
    place = np.arange(n) - first[row]
    full = place + size <= count[row]
    out, where, begin = mix(total[full] + np.uint64(size)), row[full], np.flatnonzero(full)
    short = np.flatnonzero((count > 0) & (count < size))
    if short.size:
        extra = np.zeros(short.size, np.uint64)
        for i in range(size - 1):
            has = count[short] > i
            extra[has] = (extra[has] * _BASE) + mix(words[first[short[has]] + i] + np.uint64(i + 1))
        out = np.concatenate([out, mix(extra + count[short].astype(np.uint64))])
        where = np.concatenate([where, short])
        begin = np.concatenate([begin, first[short]])
        order = np.argsort(where, kind="stable")
        out, where, begin = out[order], where[order], begin[order]
    return out, where, begin
