"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are queries against passages of all documents:

1. Words (runs of letters and digits, lower case) that few items share are terms. One pass over the texts turns each
   document into the terms it holds and their word positions; later steps read only that table.
2. Passages of ``PASSAGE`` words and the items are TF-IDF rows of a matrix, with document frequencies over all
   passages. A randomised SVD finds its first ``RANK`` right singular vectors: tasks multiply their rows with a random
   matrix and add up the products by term, twice (one power iteration); items weigh as much as all passages
   together, so that their directions are there whatever the corpus holds. Only matrices of terms by rank come to
   the driver.
3. Windows of ``PASSAGE`` words, every ``STEP`` words, are projected and compared with all items by cosine. A basis of
   ``RANK`` directions blurs items once a block holds more of them, and a short item is little of a window, so cosines
   alone would lose copies. Windows are candidates, too, whatever their cosine, when as many of an item's terms as step 4
   asks for at least lie together: anywhere around the window, or, for items too short for a rewording, within
   ``CLOSE`` times the words of the item.
4. Around each candidate the longest common subsequence of the item's terms and the document's is taken, also for
   the item's answer (its last sentence, or the last third of a single one). A document is contaminated when it has
   ``COPIED`` of an item's terms in order, or ``REWORDED`` of them, ``ENOUGH`` at least, and of its answer's.

Items come in blocks of about ``ITEMS``, so the driver and the tasks hold one block at a time; a block's vocabulary
is hashed to ``VOCABULARY`` terms if it is larger.

Null and empty texts, and items with fewer than two words, match nothing. Rows are searched one by one, so repeated
rows give repeated results; a null doc_id or item_id is kept. Repeated items are searched once. An empty benchmark
or corpus gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import buffers
from tidemark.llm.buffers import LOWER, Hashes, Texts, lists
from tidemark.session import materialise

PASSAGE, STEP, RANK, EXTRA = 64, 16, 96, 8
ITEMS, VOCABULARY = 2048, 1 << 16
COSINE, COPIED, REWORDED = 0.3, 0.8, 0.5
#: So many terms of an item must be there to call a passage a rewording.
ENOUGH = 6
#: Terms of a short item lie together within so many times its words.
CLOSE = 4
#: Words in more than this share of the items (and in more than three) are no terms.
COMMON = 0.03
ROWS = 64
#: More than the words of any text: places of different rows do not mix.
WIDE = 1 << 36

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
Batches = Iterator[pa.RecordBatch]


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, words by row, and first byte of each word. A-Z and accented Latin capitals count as small."""
    data = LOWER[texts.data]
    if len(data):
        accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[accented] += 32
    start, end = texts.words(~_WORD)
    return Hashes(data).ranges(start, end), texts.split(start), start


class Items:
    """One block of benchmark items as sequences of terms."""

    def __init__(self, ids: list, texts: list[str]):
        column = pa.array(texts, pa.large_string())
        words, answers = [], []
        for first, _, part in buffers.slices(column):
            hashes, cuts, start = _words(part)
            for i in range(part.rows):
                words.append(hashes[cuts[i] : cuts[i + 1]])
                text = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes()
                where = start[cuts[i] : cuts[i + 1]] - part.offsets[i]
                stop = max(text.rstrip(b" .!?\n\r\t").rfind(m) for m in (b". ", b"! ", b"? ", b".\n", b"!\n", b"?\n"))
                answers.append(int((where < stop).sum()) if stop >= 0 else len(where) * 2 // 3)
        shared, count = np.unique(np.concatenate([np.unique(w) for w in words] or [np.zeros(0, np.uint64)]), return_counts=True)
        common = shared[count > max(3, COMMON * len(words))]
        keep = [~np.isin(w, common) for w in words]
        keep = [k if k.sum() >= 4 else np.ones(len(k), bool) for k in keep]
        full = [i for i, w in enumerate(words) if len(w) > 1]
        self.ids = [ids[i] for i in full]
        self.words = np.array([len(words[i]) for i in full])
        self.hashes = np.unique(np.concatenate([words[i][keep[i]] for i in full] or [np.zeros(0, np.uint64)]))
        self.terms = min(len(self.hashes), VOCABULARY)
        self.sequences = [self.term(words[i][keep[i]]) for i in full]
        self.answers = [self.term(words[i][answers[i] :][keep[i][answers[i] :]]) for i in full]
        self.least = min((-(-len(s) * REWORDED // 1) for s in self.sequences), default=0)

    def term(self, words: np.ndarray) -> np.ndarray:
        """Term numbers of words that are known to be terms."""
        return np.searchsorted(self.hashes, words) % max(self.terms, 1)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and their numbers."""
        at = np.minimum(np.searchsorted(self.hashes, words), max(len(self.hashes) - 1, 0))
        hit = np.flatnonzero(self.hashes[at] == words) if len(self.hashes) else np.zeros(0, int)
        return hit, at[hit] % max(self.terms, 1)


def term_positions(docs: DataFrame, items: Items) -> DataFrame:
    """``doc_id, n_words, terms, positions`` for each whole text."""

    def run(ids: pa.Array, texts: Texts) -> pa.RecordBatch:
        words, cuts, _ = _words(texts)
        hit, term = items.find(words)
        row = np.searchsorted(cuts, hit, "right") - 1
        by_row = np.searchsorted(hit, cuts)
        columns = [ids, pa.array(np.diff(cuts), pa.int64()), lists(term, by_row, pa.int32()), lists(hit - cuts[row], by_row, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "terms", "positions"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return buffers.map_texts(docs, run, f"doc_id {kind}, n_words long, terms array<int>, positions array<int>")


class Tokens:
    """Terms of a run of documents: term, word position and document of each, in order."""

    def __init__(self, batch: pa.RecordBatch):
        self.rows = batch.num_rows
        self.n_words = batch.column("n_words").to_numpy()
        terms, positions = batch.column("terms"), batch.column("positions")
        self.cuts = terms.offsets.to_numpy() - terms.offsets[0].as_py()
        self.term = terms.flatten().to_numpy().astype(np.int64)
        self.position = positions.flatten().to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.cuts))

    def passages(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the passage of each token over all rows, and the first passage of each row."""
        n = -(-self.n_words // size)
        first = np.append(0, np.cumsum(n))
        return first[self.row] + self.position // size, first


def _runs(batches: Batches, words: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Runs of rows with about so many words."""
    for batch in batches:
        total = np.cumsum(batch.column("n_words").to_numpy())
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + words)) + 1
            part = batch.slice(begin, end - begin)
            yield part, Tokens(part)
            begin = end


def _frequencies(tokens: DataFrame, terms: int) -> tuple[int, np.ndarray]:
    """Passages of the corpus, and in how many of them each term occurs."""

    def run(batches: Batches) -> Batches:
        total, count = 0, np.zeros(terms, np.int64)
        for _, t in _runs(batches):
            passage, first = t.passages(PASSAGE)
            total += int(first[-1])
            count += np.bincount(np.unique(passage * terms + t.term) % terms, minlength=terms)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, some)), pa.array(np.append(total, count[some]))], ["term", "n"])

    rows = buffers.map_batches(tokens, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(terms, np.int64)
    for r in rows:
        if r.term >= 0:
            count[r.term] = r.n
    return next((r.n for r in rows if r.term < 0), 0), count


def _gram(tokens: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``A' (A right)`` for the TF-IDF passages ``A``: products by task, added up by blocks of terms."""
    terms, width = right.shape
    scaled = (idf[:, None] * right).astype(np.float32)

    def multiply(batches: Batches) -> Batches:
        out = np.zeros((terms, width), np.float64)
        for _, t in _runs(batches, 1 << 17):
            if not len(t.term):
                continue
            passage, _ = t.passages(PASSAGE)
            new = np.append(True, passage[1:] != passage[:-1])
            left = np.add.reduceat(scaled[t.term], np.flatnonzero(new), axis=0)
            order = np.argsort(t.term, kind="stable")
            term = t.term[order]
            heads = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            out[term[heads]] += np.add.reduceat(left[np.cumsum(new)[order] - 1], heads, axis=0)
        out *= idf[:, None]
        for block in range(-(-terms // ROWS)):
            part = out[block * ROWS : (block + 1) * ROWS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()])], ["block", "part"])

    def add(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(part)
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([total.tobytes()])], ["block", "part"])

    kind = "block long, part binary"
    rows = buffers.map_batches(buffers.map_batches(tokens, multiply, kind).repartition("block"), add, kind).collect()
    out = np.zeros((terms, width))
    for r in rows:
        out[r.block * ROWS : (r.block + 1) * ROWS] = np.frombuffer(r.part).reshape(-1, width)
    return out


def latent_basis(tokens: DataFrame, items: Items, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Projection of terms to the latent space (idf included), and the items in it, with length 1."""
    passages, frequency = _frequencies(tokens, items.terms)
    idf = np.log((passages + 1) / (frequency + 1)) + 1
    own = np.zeros((len(items.ids), items.terms))
    for i, sequence in enumerate(items.sequences):
        np.add.at(own[i], sequence, idf[sequence])
    weight = max(1.0, passages / max(len(own), 1))
    width = min(RANK + EXTRA, items.terms)
    basis = np.random.default_rng(seed).standard_normal((items.terms, width))
    for _ in range(2):
        basis = np.linalg.qr(basis)[0]
        product = _gram(tokens, idf, basis) + weight * (own.T @ (own @ basis))
        small, start, basis = basis.T @ product, basis, product
    # Within the range found, the eigenvectors of Q'A'A Q are the singular vectors; the largest come last.
    vectors = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]
    orthogonal = start @ vectors
    projection = idf[:, None] * orthogonal[:, : min(RANK, width)]
    latent = np.stack([projection[s].sum(0) for s in items.sequences]) if items.sequences else np.zeros((0, width))
    return projection.astype(np.float32), (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def common_subsequence(masks: dict[int, int], sequence: list[int], length: int) -> int:
    """Length of the longest common subsequence, bit-parallel: ``masks`` has a bit for each place of a term."""
    state = (1 << length) - 1
    for term in sequence:
        if mask := masks.get(term):
            hit = state & mask
            state = (state + hit) | (state - hit)
    return length - (state & ((1 << length) - 1)).bit_count()


def _masks(sequence: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for place, term in enumerate(sequence.tolist()):
        out[term] = out.get(term, 0) | 1 << place
    return out


FOUND = "cosine double, lcs double, answer double, start_word long, end_word long"


def search(tokens: DataFrame, items: Items, projection: np.ndarray, latent: np.ndarray, item_type: str = "long") -> DataFrame:
    """``doc_id, item_id`` and what was found, for each contaminated pair of a document and an item."""
    masks = [_masks(s) for s in items.sequences]
    answer_masks = [_masks(a) for a in items.answers]
    kind = tokens.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "item_id", "cosine", "lcs", "answer", "start_word", "end_word"]

    lengths = np.array([len(s) for s in items.sequences])
    need = np.minimum(np.ceil(COPIED * lengths - 1e-9), np.maximum(np.ceil(REWORDED * lengths), ENOUGH)).astype(np.int64)
    reach = np.where(need >= ENOUGH, PASSAGE + 4 * lengths, CLOSE * items.words)
    distinct = [np.unique(s) for s in items.sequences]
    owner, own_terms = np.repeat(np.arange(len(distinct)), [len(d) for d in distinct]), np.concatenate(distinct)
    member = np.zeros((len(items.ids), items.terms), bool)
    for i, s in enumerate(items.sequences):
        member[i, s] = True

    def near(t: Tokens, row: np.ndarray, item: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First token and end of the surroundings of each candidate: its window, and twice the item on both sides."""
        order = t.row * WIDE + t.position
        low = np.searchsorted(order, row * WIDE + np.maximum(begin - 2 * lengths[item], 0))
        return low, np.searchsorted(order, row * WIDE + begin + PASSAGE + 2 * lengths[item])

    def shared(t: Tokens, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Tokens of the surroundings that are terms of the item; no common subsequence is longer."""
        size = high - low
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + size, size)
        return buffers.sums(member[np.repeat(item, size), t.term[at]], np.append(0, ends))

    def together(t: Tokens, pairs: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, item and first word of each window that touches ``need`` terms of an item within ``reach`` words."""
        by_term = np.argsort(t.term, kind="stable")
        count = np.bincount(t.term, minlength=items.terms)
        start = np.cumsum(count) - count
        size = count[own_terms]
        total = np.bincount(owner, size, len(distinct)).astype(np.int64)
        size[total[owner] < need[owner]] = 0
        piece = np.cumsum(np.where(total < need, 0, total)) // pairs  # items by turns, so that few pairs are held
        for turn in np.unique(piece):
            some = np.flatnonzero((piece[owner] == turn) & (size > 0))
            ends = np.cumsum(size[some])
            if not len(some):
                continue
            at = np.arange(ends[-1]) + np.repeat(start[own_terms[some]] - ends + size[some], size[some])
            hit = np.sort(np.repeat(owner[some], size[some]) * len(t.term) + by_term[at])
            item, token = np.divmod(hit, len(t.term))
            last = np.arange(len(hit)) + need[item] - 1
            j = np.flatnonzero(last < len(hit))
            last = last[j]
            row, low, high = t.row[token[j]], t.position[token[j]], t.position[token[last]]
            found = (item[last] == item[j]) & (t.row[token[last]] == row) & (high - low < reach[item[j]])
            item, row, low, high = item[j][found], row[found], low[found], high[found]
            side = 2 * lengths[item]
            begin = -(-np.maximum(np.maximum(low - PASSAGE, high - PASSAGE - side) + 1, 0) // STEP)
            end = np.minimum(high, low + side) // STEP + 1
            # Both ends grow within an item and a row: windows that the run of terms before has are left out.
            again = np.flatnonzero((item[1:] == item[:-1]) & (row[1:] == row[:-1])) + 1
            begin[again] = np.maximum(begin[again], end[again - 1])
            many = np.maximum(end - begin, 0)
            if total_windows := int(many.sum()):
                block = np.arange(total_windows) + np.repeat(begin - np.cumsum(many) + many, many)
                yield np.repeat(row, many), np.repeat(item, many), block * STEP

    def check(t: Tokens, item: int, low: int, high: int) -> tuple[float, float]:
        length = len(items.sequences[item])
        sequence = t.term[low:high].tolist()
        lcs = common_subsequence(masks[item], sequence, length) / length
        answer = len(items.answers[item])
        return lcs, common_subsequence(answer_masks[item], sequence, answer) / answer if answer else lcs

    def run(batches: Batches) -> Batches:
        for part, t in _runs(batches, 1 << 17):
            if not len(t.term):
                continue
            block, first = t.passages(STEP)
            span = PASSAGE // STEP
            total = int(first[-1])
            # Sums over blocks of STEP words; a window is a few blocks, cut off at the end of its document.
            sums = np.zeros((total + 1, projection.shape[1]), np.float32)
            heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            sums[block[heads]] = np.add.reduceat(projection[t.term], heads, axis=0)
            hits = np.bincount(block, minlength=total + 1)
            end = np.repeat(first[1:], np.diff(first))
            windows, counted = sums[:total].copy(), hits[:total].copy()
            for j in range(1, span):
                more = np.flatnonzero(np.arange(total) + j < end)
                windows[more] += sums[more + j]
                counted[more] += hits[more + j]
            # Half of the terms of an item that is longer than a window need not lie in one.
            enough = counted >= max(1, min(items.least, PASSAGE // 4))
            chosen = np.flatnonzero(enough)
            norm = np.maximum(np.linalg.norm(windows, axis=1), 1e-9)
            best: dict[tuple[int, int], tuple] = {}

            def confirm(rows: np.ndarray, item: np.ndarray, begins: np.ndarray, cosines: np.ndarray) -> None:
                for j in range(0, len(item), 1 << 16):
                    r, i, g, c = (x[j : j + (1 << 16)] for x in (rows, item, begins, cosines))
                    low, high = near(t, r, i, g)
                    bound = shared(t, i, low, high)
                    some = np.flatnonzero(bound >= need[i])
                    values = (c[some], bound[some], r[some], i[some], g[some], low[some], high[some])
                    for cosine, most, row, one, begin, start, stop in zip(*(v.tolist() for v in values), strict=True):
                        seen = best.get((row, one))
                        if seen and (min(most / lengths[one], 1.0), cosine) <= (seen[1], seen[0]):
                            continue
                        lcs, answer = check(t, one, start, stop)
                        reworded = min(lcs, answer) >= REWORDED and round(lcs * lengths[one]) >= ENOUGH
                        if lcs >= COPIED or reworded:
                            if not seen or (lcs, cosine) > (seen[1], seen[0]):
                                best[row, one] = (cosine, lcs, answer, begin, min(begin + PASSAGE, int(t.n_words[row])))

            for k in range(0, len(chosen), 4096):
                cosine = windows[chosen[k : k + 4096]] @ latent.T / norm[chosen[k : k + 4096], None]
                which, item = np.nonzero(cosine >= COSINE)
                where = chosen[k + which]
                rows = np.searchsorted(first, where, "right") - 1
                confirm(rows, item, (where - first[rows]) * STEP, cosine[which, item])
            for rows, item, begins in together(t):
                for j in range(0, len(item), 1 << 16):
                    r, i, g = (x[j : j + (1 << 16)] for x in (rows, item, begins))
                    where = first[r] + g // STEP
                    cosine = np.einsum("ij,ij->i", windows[where], latent[i]) / norm[where]
                    new = (cosine < COSINE) | ~enough[where]
                    confirm(r[new], i[new], g[new], cosine[new])
            if best:
                ids = part.column("doc_id").take(pa.array([row for row, _ in best]))
                columns = [pa.array(c) for c in zip(*best.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[i] for _, i in best], ids_type), *columns], names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    ids_type = to_arrow_type(_parse_datatype_string(item_type))
    return buffers.map_batches(tokens, run, f"doc_id {kind}, item_id {item_type}, {FOUND}")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, lcs, answer, start_word, end_word`` for each document that holds an item."""
    spark = docs.sparkSession
    known = benchmark.select("item_id", "text").where("text is not null").distinct()
    blocks = -(-known.count() // ITEMS)
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"doc_id {kind}, item_id {item_type}, {FOUND}")
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = Items([r.item_id for r in rows], [r.text for r in rows])
        if not items.ids:
            continue
        tokens = materialise(term_positions(docs, items), "terms")
        projection, latent = latent_basis(tokens, items)
        out = out.union(search(tokens, items, projection, latent, item_type))
    return out
