"""Suffix-array deduplication: bytes covered by a ``SPAN``-byte string that also starts earlier in the corpus.

A position repeats when the ``SPAN`` bytes from it on equal those from an earlier position (smaller doc_id, or same
document and smaller start). Finding them is sorting all suffixes by their first ``SPAN`` bytes and keeping the first
of each run of equal ones. Three steps make that a distributed sort that ships little:

1. **Dealing.** Every ``SPAN``-byte window names its anchor, the leftmost ``ANCHOR``-byte string in it with the smallest
   hash. Equal windows have equal anchors at equal offsets, so suffixes that could be equal are dealt by the anchor's
   hash. Consecutive windows with one anchor form a segment, which travels as one row: two independent 64-bit
   polynomial hashes, no text. Equal segments are settled at once; within a task before the shuffle already, so that
   even a very frequent segment sends one row per block of ``FLUSH`` segments.
2. **Sorting.** Only different segments around equal anchors (the rims of copies) need their text. Their suffixes are
   dealt once more by the hash of a longer core (the anchor with ``SIDE`` bytes on one side), and every group is
   mergesorted. A comparison takes the longest common extension by prefix polynomial hashes and binary search, so
   it costs the logarithm of ``SPAN``; suffixes found equal are verified byte by byte.
3. **Hot cores.** Groups of more than ``LIMIT`` rows are cut into blocks by document. Every block is sorted for itself,
   and the first suffix of each of its runs goes to a last match by 128-bit hashes, a row per block and run.

Segments and the runs of hot cores are matched by 128 bits of independent hashes without looking at the bytes again.

Texts are treated as UTF-8 bytes, null as empty; matches never cross documents. A null doc_id counts as the smallest.
Rows that repeat a doc_id with the same text are one document and get the same result; different texts under one
doc_id are documents of their own, ordered by a hash of the text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import buffers
from tidemark.llm.buffers import Hashes, Texts, slices
from tidemark.session import materialise, shuffle_partitions

SPAN, ANCHOR = 100, 32
SIDE = (SPAN - ANCHOR) // 2
FLUSH, LIMIT, CHUNK = 500_000, 2048, 200_000
NO_ID = -(1 << 63)

# A place is one number: which of the texts under a doc_id (16 bits), first byte (32), windows (8), anchor offset (8).
Batches = Iterator[pa.RecordBatch]


def _place(version, start, n=0, offset=0):
    return (version << 48) | (start << 16) | (n << 8) | offset


def _minima(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def segments(texts: Texts) -> tuple[np.ndarray, ...] | None:
    """Runs of windows with one anchor: row, first window, end, anchor position, hashes of anchor and segment."""
    data, n = texts.data, len(texts.data)
    if n < SPAN:
        return None
    hashes = Hashes(data)
    width, windows = SPAN - ANCHOR + 1, n - SPAN + 1
    at = np.arange(n - ANCHOR + 1)
    anchors = hashes.ranges(at, at + ANCHOR)
    least = _minima(anchors, width)
    long = texts.sizes >= SPAN
    first, last = texts.offsets[:-1][long], texts.offsets[1:][long] - SPAN + 1
    inside = np.zeros(windows + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    inside = np.cumsum(inside[:-1]) > 0
    # The anchor changes where the minimum does, and where the window leaves an anchor that occurs again.
    new = np.ones(windows, bool)
    new[1:] = (least[1:] != least[:-1]) | (anchors[: windows - 1] == least[:-1]) | (inside[1:] != inside[:-1])
    new[first] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], windows)
    start, end = start[inside[start]], end[inside[start]]
    anchor = np.empty(len(start), np.int64)
    for k in range(0, len(start), 16384):
        seen = end[k : k + 16384, None] - 1 + np.arange(width)
        anchor[k : k + 16384] = end[k : k + 16384] - 1 + (anchors[seen] == least[start[k : k + 16384], None]).argmax(1)
    shape = ((end - start) << 8 | (anchor - start)).astype(np.uint64)
    whole = buffers.mix(Hashes(data, 1).ranges(start, end - 1 + SPAN) ^ buffers.mix(shape))
    row = np.searchsorted(texts.offsets, start, "right") - 1
    return row, start, end, anchor, least[start], whole


def _runs(doc: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge windows that follow each other in a document; ``place`` without windows and offset."""
    order = np.lexsort((place, doc))
    doc, start, n = doc[order], place[order] >> 16, n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])
    heads = np.flatnonzero(new)
    return doc[heads], start[heads] << 16, np.add.reduceat(n, heads) if len(heads) else n


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], names)


DEALT = ["anchor", "segment", "doc", "place", "n"]


def _deal(batches: Batches) -> Batches:
    """Segments to be shuffled (n = 0), and runs of windows that repeat one of the same block (n > 0)."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        anchor, whole, doc, place = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((place, doc, whole, anchor))
        anchor, whole, doc, place = anchor[order], whole[order], doc[order], place[order]
        again = np.zeros(len(anchor), bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1])
        d, p, n = _runs(doc[again], place[again] >> 16 << 16, place[again] >> 8 & 255)
        spread = buffers.mix((d ^ p).astype(np.uint64)).view(np.int64)  # settled rows only pass through
        columns = zip((anchor[~again], whole[~again], doc[~again], place[~again], np.zeros((~again).sum(), np.int64)), (spread, spread, d, p, n), strict=True)
        return _batch(DEALT, *(np.concatenate(c) for c in columns))

    for batch in batches:
        ids = batch.column("doc").to_numpy()
        versions = batch.column("version").to_numpy()
        for first, end, texts in slices(batch.column("text")):
            if (found := segments(texts)) is None:
                continue
            row, start, stop, anchor, least, whole = found
            place = _place(versions[first + row], start - texts.offsets[row], stop - start, anchor - start)
            held.append((least.view(np.int64), whole.view(np.int64), ids[first + row], place))
            if sum(len(h[0]) for h in held) >= FLUSH:
                yield flush()
    if held:
        yield flush()


SETTLED = ["doc", "place", "n"]


def _settle(batches: Batches) -> Batches:
    """Rows sorted by anchor, segment, doc, place: windows that repeat (n > 0) and segments still open (n = 0)."""
    last_anchor = last_segment = None
    waiting: tuple[int, int] | None = None  # the first segment of an anchor that has no other one so far
    for batch in batches:
        anchor, segment, doc, place, n = (batch.column(c).to_numpy() for c in DEALT)
        done = n > 0
        if done.any():
            yield _batch(SETTLED, doc[done], place[done], n[done])
            anchor, segment, doc, place = anchor[~done], segment[~done], doc[~done], place[~done]
        if not len(anchor):
            continue
        new_anchor = np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_anchor[0] = anchor[0] != last_anchor
        new_segment = new_anchor.copy()
        new_segment[1:] |= segment[1:] != segment[:-1]
        new_segment[0] |= segment[0] != last_segment
        other = new_segment & ~new_anchor
        group = np.cumsum(new_anchor)
        others = np.bincount(group, other, minlength=group[-1] + 1) > 0
        opened = new_segment & others[group]
        again = ~new_segment
        yield _batch(SETTLED, doc[again], place[again] >> 16 << 16, place[again] >> 8 & 255)
        yield _batch(SETTLED, doc[opened], place[opened], np.zeros(opened.sum(), np.int64))
        if waiting and others[0]:
            yield _batch(SETTLED, *(np.array([x]) for x in (*waiting, 0)))
        if others[0] or new_anchor.any():
            waiting = None
        final = np.flatnonzero(new_anchor)
        if len(final) and not others[group[-1]]:
            waiting = (doc[final[-1]], place[final[-1]])
        last_anchor, last_segment = anchor[-1], segment[-1]


def _binary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """A binary column of ranges of a buffer."""
    sizes = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)
    kind = pa.large_binary()
    return pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes())]).cast(pa.binary())


def _cores(batches: Batches) -> Batches:
    """Texts with the places of their open segments: each segment's windows by the longer core that they hold."""
    for batch in batches:
        places = batch.column("places")
        cuts = places.offsets.to_numpy()
        values = places.values.to_numpy()
        ids = batch.column("doc").to_numpy()
        for first, end, texts in slices(batch.column("text")):
            place = values[cuts[first] : cuts[end]]
            row = np.repeat(np.arange(end - first), np.diff(cuts[first : end + 1]))
            start = (place >> 16 & 0xFFFFFFFF) + texts.offsets[row]
            stop = start + (place >> 8 & 255)
            anchor = start + (place & 255)
            hashes = Hashes(texts.data)
            # Windows that begin within SIDE bytes before the anchor hold SIDE bytes after it, the others SIDE before it.
            cut = np.clip(anchor - SIDE, start, stop)
            for a, b, lead in ((cut, stop, 0), (start, cut, SIDE)):
                some = b > a
                a, b, core = a[some], b[some], anchor[some] - lead
                key = hashes.ranges(core, core + ANCHOR + SIDE)
                version = place[some] >> 48
                where = _place(version, a - texts.offsets[row[some]], b - a, anchor[some] - a)
                columns = [pa.array(key.view(np.int64)), pa.array(ids[first + row[some]]), pa.array(where), _binary(texts.data, a, b - 1 + SPAN)]
                yield pa.RecordBatch.from_arrays(columns, ["core", "doc", "place", "bytes"])


class Suffixes:
    """Suffixes of a buffer, compared by their first ``SPAN`` bytes through prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data, self.hashes = data, Hashes(data)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes of the suffixes at ``a`` and ``b``, at most ``SPAN``, by binary search."""
        prefix, down = self.hashes.prefix, self.hashes.down
        common = np.zeros(len(a), np.int64)
        step = 64
        while step:
            size = np.minimum(step, SPAN - common)
            i, j = a + common, b + common
            equal = (prefix[i + size] - prefix[i]) * down[i] == (prefix[j + size] - prefix[j]) * down[j]
            common += np.where(equal, size, 0)
            step //= 2
        return common

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        common = self.extension(a, b)
        ends = common >= SPAN
        at = np.minimum(common, SPAN - 1)
        return np.where(ends, or_equal, self.data[a + at] < self.data[b + at])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order that mergesorts the suffixes of each group (groups are contiguous); equal ones keep their order.

        All groups are merged at once, bottom up: every suffix finds its rank in the neighbouring run by binary search.
        """
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(begin, len(at)))
        first, size = np.repeat(begin, size), np.repeat(size, size)
        order = np.arange(len(at))
        width = 1
        while width < size.max(initial=0):
            index = np.flatnonzero(size > width)
            local = index - first[index]
            run = local // width
            left = run % 2 == 0
            other = np.where(left, run + 1, run - 1) * width
            low = np.minimum(other, size[index])
            high = np.minimum(other + width, size[index])
            mine, origin = at[order[index]], low.copy()
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                middle = (low[k] + high[k]) // 2
                theirs = at[order[first[index[k]] + middle]]
                # A left suffix passes smaller ones, a right suffix also equal ones.
                before = self.less(theirs, mine[k], ~left[k])
                low[k] = np.where(before, middle + 1, low[k])
                high[k] = np.where(before, high[k], middle)
            target = first[index] + run // 2 * 2 * width + local % width + (low - origin)
            merged = order.copy()
            merged[target] = order[index]
            order = merged
            width *= 2
        return order

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the first ``SPAN`` bytes at ``a`` and ``b`` are equal, byte by byte."""
        out = np.empty(len(a), bool)
        for k in range(0, len(a), 32768):
            reach = np.arange(SPAN)
            out[k : k + 32768] = (self.data[a[k : k + 32768, None] + reach] == self.data[b[k : k + 32768, None] + reach]).all(1)
        return out


SORTED = ["doc", "place", "n", "hash1", "hash2"]


def _sort_groups(batches: Batches) -> Batches:
    """Rows sorted by core and block: windows that repeat (n > 0); for cores of many blocks, the first of each run (n = 0)."""

    def work(rows: pa.RecordBatch) -> Batches:
        core, block, blocks, doc, place = (rows.column(c).to_numpy() for c in ("core", "block", "blocks", "doc", "place"))
        column = rows.column("bytes").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        n, start = place >> 8 & 255, place >> 16 << 16
        row = np.repeat(np.arange(len(doc)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[row] - offsets[0] + step
        offset = (place[row] & 255) - step
        where = start[row] + (step << 16)
        order = np.lexsort((where, doc[row], offset, block[row], core[row]))
        row, at, offset, where = row[order], at[order], offset[order], where[order]
        new = np.ones(len(row), bool)
        new[1:] = (core[row[1:]] != core[row[:-1]]) | (block[row[1:]] != block[row[:-1]]) | (offset[1:] != offset[:-1])
        group = np.cumsum(new)
        suffixes = Suffixes(data)
        order = suffixes.sort(at, group)
        row, at, where, group = row[order], at[order], where[order], group[order]
        again = np.zeros(len(row), bool)
        again[1:] = (group[1:] == group[:-1]) & (suffixes.extension(at[1:], at[:-1]) >= SPAN)
        check = np.flatnonzero(again)
        wrong = check[~suffixes.same(at[check], at[check - 1])]
        if len(wrong):  # unequal strings with equal hashes: settle their groups by the bytes themselves
            for g in np.unique(group[wrong]):
                members = np.flatnonzero(group == g)
                members = members[np.lexsort((where[members], doc[row[members]]))]
                seen: set[bytes] = set()
                for m in members:
                    text = data[at[m] : at[m] + SPAN].tobytes()
                    again[m] = text in seen
                    seen.add(text)
        d, p, count = _runs(doc[row[again]], where[again], np.ones(again.sum(), np.int64))
        nothing = np.zeros(len(d), np.int64)
        yield _batch(SORTED, d, p, count, nothing, nothing)
        many = ~again & (blocks[row] > 1)
        if many.any():
            a = at[many]
            h1, h2 = (Hashes(data, t).ranges(a, a + SPAN).view(np.int64) for t in (0, 1))
            yield _batch(SORTED, doc[row[many]], where[many], np.zeros(len(a), np.int64), h1, h2)

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        # Whole groups are worked off as soon as there are enough of them.
        if held.num_rows * SIDE >= CHUNK:
            core, block = held.column("core").to_numpy(), held.column("block").to_numpy()
            ends = np.flatnonzero((core[1:] != core[:-1]) | (block[1:] != block[:-1])) + 1
            if len(ends):
                for part in _chunks(held, ends):
                    yield from work(part)
                held = held.slice(int(ends[-1]))
    if held is not None and held.num_rows:
        core, block = held.column("core").to_numpy(), held.column("block").to_numpy()
        ends = np.append(np.flatnonzero((core[1:] != core[:-1]) | (block[1:] != block[:-1])) + 1, held.num_rows)
        for part in _chunks(held, ends):
            yield from work(part)


def _chunks(table: pa.Table, ends: np.ndarray) -> Batches:
    """Runs of whole groups with about ``CHUNK`` suffixes."""
    begin = 0
    while begin < ends[-1]:
        end = int(ends[min(np.searchsorted(ends, begin + CHUNK // SIDE), len(ends) - 1)])
        yield table.slice(begin, end - begin).combine_chunks().to_batches()[0]
        begin = end


def _match(batches: Batches) -> Batches:
    """Rows sorted by both hashes, doc, place: all but the first of each run repeat."""
    last = None
    for batch in batches:
        h1, h2, doc, place = (batch.column(c).to_numpy() for c in ("hash1", "hash2", "doc", "place"))
        again = np.zeros(len(h1), bool)
        again[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        again[0] = (h1[0], h2[0]) == last
        last = (h1[-1], h2[-1])
        yield _batch(SETTLED, doc[again], place[again], np.ones(again.sum(), np.int64))


def _remove(batches: Batches) -> Batches:
    """Texts with the runs of repeated windows in them: bytes removed and what is left."""
    for batch in batches:
        runs = batch.column("runs")
        cuts = runs.offsets.to_numpy()
        place, n = (runs.values.field(k).to_numpy() for k in (0, 1))
        for first, end, texts in slices(batch.column("text")):
            part = slice(cuts[first], cuts[end])
            row = np.repeat(np.arange(end - first), np.diff(cuts[first : end + 1]))
            start = (place[part] >> 16 & 0xFFFFFFFF) + texts.offsets[row]
            edges = np.zeros(len(texts.data) + 1, np.int64)
            np.add.at(edges, start, 1)
            np.add.at(edges, start + n[part] - 1 + SPAN, -1)
            gone = np.cumsum(edges[:-1]) > 0
            rises = gone.copy()
            rises[1:] &= ~gone[:-1]
            heads = texts.offsets[:-1][texts.sizes > 0]
            rises[heads] = gone[heads]
            falls = gone.copy()
            falls[:-1] &= ~gone[1:]
            tails = texts.offsets[1:][texts.sizes > 0] - 1
            falls[tails] = gone[tails]
            begin, finish = np.flatnonzero(rises), np.flatnonzero(falls) + 1
            by_row = np.searchsorted(begin, texts.offsets)
            owner = np.repeat(np.arange(texts.rows), np.diff(by_row))
            spans = pa.StructArray.from_arrays(
                [pa.array(begin - texts.offsets[owner], pa.int64()), pa.array(finish - texts.offsets[owner], pa.int64())], ["start", "end"]
            )
            left = texts.sum(~gone)
            offsets = np.append(0, np.cumsum(left))
            kept = pa.Array.from_buffers(pa.large_binary(), texts.rows, [None, pa.py_buffer(offsets), pa.py_buffer(texts.data[~gone].tobytes())])
            columns = [
                batch.column("doc").slice(first, end - first),
                pa.array(texts.sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(by_row, pa.int32()), spans),
                kept.cast(pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_bytes", "removed", "kept"])


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``doc, version, text`` of all rows without nulls, and which ``own`` id a ``doc`` stands for, if doc_ids repeat.

    Where they do, the different texts of all documents are numbered in the order of doc_id and a digest of the text, by ranges, so that each is
    a document of its own, however many share an id. Equal rows share a number.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    repeated = rows.groupBy("doc").count().where("count > 1")
    zero = F.lit(0).cast("long").alias("version")
    if repeated.isEmpty():
        return rows.select("doc", zero, "text"), None
    hashed = rows.select(F.col("doc").alias("own"), F.md5("text").alias("hash"), "text")
    order = ["own", "hash"]
    pairs = hashed.select(*order).distinct().repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    numbers = materialise(pairs.withColumn("doc", F.monotonically_increasing_id()), "numbers")
    return hashed.join(numbers, order).select("doc", zero, "text"), numbers.select("doc", "own")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, removed, kept``: for each row the byte ranges removed (start, end) and the bytes left."""
    rows, owners = _numbered(docs)
    once = rows if owners is None else rows.dropDuplicates(["doc"])
    longs = lambda names: ", ".join(f"{n} long" for n in names)
    dealt = once.where(F.octet_length("text") >= SPAN)
    dealt = dealt.mapInArrow(_deal, longs(DEALT)).repartition("anchor").sortWithinPartitions("anchor", "segment", "doc", "place")
    settled = materialise(dealt.mapInArrow(_settle, longs(SETTLED)), "settled")

    version = F.shiftright("place", 48).alias("version")
    places = settled.where("n = 0").groupBy("doc", version).agg(F.collect_list("place").alias("places"))
    texts = once.join(places, ["doc", "version"])
    cores = materialise(texts.select("doc", "text", "places").mapInArrow(_cores, "core long, doc long, place long, bytes binary"), "cores")
    shared = cores.groupBy("core").count().where("count > 1")
    blocks = F.ceil(F.col("count") / LIMIT).cast("long")
    grouped = cores.join(shared, "core").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc"), "blocks")).drop("count")
    grouped = grouped.repartition("core", "block").sortWithinPartitions("core", "block")
    ordered = materialise(grouped.mapInArrow(_sort_groups, longs(SORTED)), "ordered")
    firsts = ordered.where("n = 0").repartition("hash1").sortWithinPartitions("hash1", "hash2", "doc", "place")
    matched = firsts.mapInArrow(_match, longs(SETTLED))

    found = settled.where("n > 0").union(ordered.where("n > 0").select(*SETTLED)).union(matched)
    runs = found.groupBy("doc", version).agg(F.collect_list(F.struct("place", "n")).alias("runs"))
    nothing = F.array().cast("array<struct<place:long,n:long>>")
    whole = rows.join(runs, ["doc", "version"], "left").select("doc", "text", F.coalesce("runs", nothing).alias("runs"))
    out = whole.mapInArrow(_remove, "doc long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    out = out.withColumn("own", F.col("doc")) if owners is None else out.join(owners, "doc")
    return out.select(F.when(F.col("own") != NO_ID, F.col("own")).alias("doc_id"), "n_bytes", "removed", "kept")
