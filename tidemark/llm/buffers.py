"""Whole texts as byte buffers: slices of Arrow batches, word bounds and prefix polynomial hashes.

A string column arrives as one buffer of UTF-8 bytes with row offsets. The helpers work on slices of such
a buffer, so that a few megabytes of many short texts, or one long text, are handled by one numpy call.
No text is cut: a row that is larger than a slice is a slice of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
SPACES = b" \t\n\v\f\r"

_rng = np.random.default_rng(20240229)
_MULTIPLIER = int(_rng.integers(1 << 62, 1 << 63)) | 5
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
TABLES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def flags(chars: bytes) -> np.ndarray:
    """A table that is true for the given bytes."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) < n:
        size = len(_powers[0])
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            step = np.uint64(pow(base, size, 1 << 64))
            _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    return _powers[0], _powers[1]


class Hashes:
    """Prefix polynomial hashes of a byte buffer modulo 2**64; any range is hashed in constant time."""

    def __init__(self, data: np.ndarray, table: int = 0):
        n = len(data)
        up, self.down = _power(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLES[table][data] * up[:n], out=self.prefix[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start])


#: Ranges of more bytes than this are hashed one by one.
LONGEST = 64


def _fold(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, step: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Fold the bytes of each range into its state, one place of all ranges at a time. Returns the states and which ranges are too long."""
    sizes = end - start
    long = np.flatnonzero(sizes > LONGEST)
    sizes = np.where(sizes > LONGEST, 0, sizes)
    order = np.argsort(-sizes, kind="stable")
    begin, folded = start[order], state[order]
    left = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
    for k, n in enumerate(left.tolist()):
        folded[:n] = step(folded[:n], data[begin[:n] + k])
    state[order] = folded
    return state, long


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: a table value for each byte is mixed into the state, so no run of bytes cancels another."""
    first = mix((end - start).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))

    def step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        state = (state ^ TABLES[0][byte]) * np.uint64(0x9FB21C651E98DF25)
        return state ^ (state >> np.uint64(29))

    state, long = _fold(data, start, end, first, step)
    for i in long.tolist():
        state[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(state)


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table of CRC-32, and ``shift[n, j, b]``: byte ``b`` at place ``j`` of a checksum after ``n`` zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    shift = np.zeros((LONGEST + 1, 4, 256), np.uint32)
    shift[0] = np.arange(256, dtype=np.uint32) << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(LONGEST):
        shift[n + 1] = table[shift[n] & np.uint32(255)] ^ (shift[n] >> np.uint32(8))
    return table, shift


CRC, CRC_SHIFT = _crc_tables()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges."""

    def step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))

    state, long = _fold(data, start, end, np.full(len(start), 0xFFFFFFFF, np.uint32), step)
    state ^= np.uint32(0xFFFFFFFF)
    for i in long.tolist():
        state[i] = zlib.crc32(data[start[i] : end[i]])
    return state


def crc32_joined(data: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, second: np.ndarray, between: int = 32) -> np.ndarray:
    """CRC-32 of texts of checksum ``first``, one byte ``between``, and the ranges, whose own checksums are ``second``."""
    state = first ^ np.uint32(0xFFFFFFFF)
    state = CRC[(state ^ np.uint32(between)) & np.uint32(255)] ^ (state >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
    sizes = end - start
    out, n = second.copy(), np.minimum(sizes, LONGEST)
    for j in range(4):
        out ^= CRC_SHIFT[n, j, (state >> np.uint32(8 * j)) & np.uint32(255)]
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]], int(state[i]))
    return out


class Texts:
    """Rows of a slice: ``data`` holds their bytes, row ``i`` lies in ``offsets[i]:offsets[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.rows = len(offsets) - 1
        self.sizes = np.diff(offsets)

    def words(self, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every word, in order; words never cross rows."""
        inside = ~between[self.data]
        n = len(inside)
        begin, finish = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            finish[:-1] &= ~inside[1:]
            cut = self.offsets[:-1][self.sizes > 0]
            begin[cut] = inside[cut]
            last = self.offsets[1:][self.sizes > 0] - 1
            finish[last] = inside[last]
        return np.flatnonzero(begin), np.flatnonzero(finish) + 1

    def split(self, positions: np.ndarray) -> np.ndarray:
        """Offsets by row into sorted byte positions."""
        return np.searchsorted(positions, self.offsets)

    def sum(self, values: np.ndarray) -> np.ndarray:
        """Row sums of a value for each byte."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Cut a string column into runs of whole rows: first row, end row, their bytes. Null counts as empty."""
    if column.null_count or not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    # The batch is not copied, only its offsets are.
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, Texts(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])
        first = end


def sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive cuts; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column whose row ``i`` holds ``values[cuts[i]:cuts[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def give_back() -> None:
    """Return free memory to the system, which allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(fn, schema)``; workers, which wait for later tasks, do not hold on to what they no longer use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, fn: Callable[[pa.Array, Texts], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn(ids, texts)`` to slices of (doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, end, texts in slices(batch.column(1)):
                out = fn(ids.slice(first, end - first), texts)
                if out is not None and out.num_rows:
                    yield out

    return map_batches(df.select("doc_id", "text"), run, schema)


def map_strings(df: DataFrame, fn: Callable[[str], tuple], schema: str) -> DataFrame:
    """Apply ``fn(text)`` to each whole text; ``schema`` names doc_id first, then what ``fn`` returns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_type = _parse_datatype_string(schema)
    names, kinds = spark_type.names, [f.type for f in to_arrow_schema(spark_type)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                rows = [fn(text or "") for text in piece.column(1).to_pylist()]
                columns = [piece.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(df.select("doc_id", "text"), run, schema)


def pieces(batch: pa.RecordBatch, size: int = 8 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about ``size`` bytes of text, so that Python holds few strings at a time."""
    for first, end, _ in slices(batch.column(1), size):
        yield batch.slice(first, end - first)


def shingles(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, sorted within the row, and the offsets by row."""
    lower = Texts(LOWER[texts.data], texts.offsets)
    start, end = lower.words()
    words = word_hashes(lower.data, start, end)
    cuts = lower.split(start)
    counts = np.diff(cuts)
    # One entry for each shingle; a row with fewer words has one that ends with its last word.
    entries = np.where(counts >= size, counts - size + 1, counts > 0)
    row = np.repeat(np.arange(texts.rows), entries)
    place = np.arange(len(row)) - np.repeat(np.cumsum(entries) - entries, entries)
    first = cuts[row]
    at = first + place
    key = np.full(len(at), np.uint64(size))
    for j in range(size):
        inside = at + j < cuts[row + 1]
        key = np.where(inside, mix(key ^ words[np.minimum(at + j, max(len(words) - 1, 0))]), key)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    return key, np.searchsorted(row, np.arange(texts.rows + 1))
