"""Benchmark decontamination with suffix arrays over the training documents (operator 9)."""

from __future__ import annotations

from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.llm._common import Scratch, hash_spans, in_slices, word_bounds

#: Contract words: ASCII letters and digits, and everything beyond ASCII.
IS_ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
WINDOW = 13
#: Words of one shard's suffix array, and of one block of benchmark words; both bound a worker's memory.
SHARD_WORDS, BLOCK_WORDS = 1 << 18, 1 << 20


def contract_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    return hash_spans(data, *word_bounds(data, IS_ALNUM))


class SuffixArray:
    """The suffixes of a word sequence in the order of their first 13 words; 0 in ids ends a document."""

    def __init__(self, hashes: np.ndarray, ends: np.ndarray):
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        ids = ids.astype(np.int64) + 1
        ids[ends] = 0
        self.ids = np.concatenate([ids, np.zeros(WINDOW, np.int64)])
        n = len(ids)
        one = self.ids
        three = self._ranks((one[:n] << 42) | (one[1 : n + 1] << 21) | one[2 : n + 2])
        nine = self._ranks((three[:n] << 42) | (three[3 : n + 3] << 21) | three[6 : n + 6])
        self.order = np.argsort((nine[:n] << 42) | (three[9 : n + 9] << 21) | one[12 : n + 12], kind="stable")

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        _, rank = np.unique(key, return_inverse=True)
        return np.concatenate([rank.astype(np.int64), np.zeros(WINDOW, np.int64)])

    def _bound(self, queries: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
        """For each query the first place in the order whose suffix is not below (or is above) its prefix."""
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            at, less, todo = self.order[mid], np.full(len(open_), upper), np.arange(len(open_))
            for k in range(queries.shape[1]):
                todo = todo[lengths[open_[todo]] > k]
                if not todo.size:
                    break
                have, want = self.ids[at[todo] + k], queries[open_[todo], k]
                less[todo[have < want]], less[todo[have > want]] = True, False
                todo = todo[have == want]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    def find(self, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, location) of every occurrence of every query prefix, by binary search."""
        place = np.searchsorted(self.vocabulary, queries)
        known = (place < len(self.vocabulary)) & (self.vocabulary[np.minimum(place, len(self.vocabulary) - 1)] == queries)
        inside = np.arange(queries.shape[1])[None, :] < lengths[:, None]
        live = np.flatnonzero((known | ~inside).all(axis=1))
        if not live.size:
            return live, live
        q, n = place[live] + 1, lengths[live]
        lo, hi = self._bound(q, n, False), self._bound(q, n, True)
        count = hi - lo
        which = np.repeat(np.arange(len(live)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return live[which], self.order[lo[which] + offset]


class QueryBlock:
    """Windows of a bounded block of benchmark items: the first words of every suffix, and what items have it where."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]]):
        windows, owner = {}, []
        rows: list[np.ndarray] = []
        lengths: list[int] = []
        texts: dict[bytes, int] = {}
        #: The ids of the items of each distinct text; copies of an item are searched once.
        self.items: list[list[str | None]] = []
        for item, w in items:
            k = texts.setdefault(w.tobytes(), len(self.items))
            if k < len(self.items):
                self.items[k].append(item)
                continue
            self.items.append([item])
            n = min(WINDOW, len(w))
            for p in range(len(w) - n + 1 if n else 0):
                piece = w[p : p + n]
                row = windows.setdefault((n, piece.tobytes()), len(rows))
                if row == len(rows):
                    rows.append(np.concatenate([piece, np.zeros(WINDOW - n, np.uint64)]))
                    lengths.append(n)
                owner.append((row, k, p))
        self.queries = np.array(rows, np.uint64).reshape(-1, WINDOW)
        self.lengths = np.array(lengths, np.int64)
        own = np.array(sorted(owner), np.int64).reshape(-1, 3)
        self.owners, self.places = own[:, 1].copy(), own[:, 2].copy()
        self.first = np.searchsorted(own[:, 0], np.arange(len(rows) + 1))


def _blocks(benchmark: DataFrame):
    """Blocks of items of at most BLOCK_WORDS words (one item at least), streamed through the driver."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        w = contract_words(text)
        if block and size + len(w) > BLOCK_WORDS:
            yield QueryBlock(block)
            block, size = [], 0
        block.append((item, w))
        size += len(w)
    if block:
        yield QueryBlock(block)


def _pieces(words: np.ndarray):
    """(first word, words) of a document in runs that overlap by a window less one word, so none is cut."""
    step = SHARD_WORDS - (WINDOW - 1)
    for at in range(0, max(1, len(words) - (WINDOW - 1)), step):
        yield at, words[at : at + SHARD_WORDS]


def _united(spans: np.ndarray) -> np.ndarray:
    """The union of [start, end) spans as disjoint spans in order."""
    s = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(s[:, 1])
    first = np.flatnonzero(np.concatenate([[True], s[1:, 0] > reach[:-1]]))
    return np.stack([s[first, 0], np.concatenate([reach[first[1:] - 1], reach[-1:]])], axis=1)


class _Found:
    """What one document has of a block: per hit the text of the block, its word, the document's word, the length."""

    def __init__(self, n: int):
        self.n, self.hits = n, []

    def row(self, block: QueryBlock) -> tuple:
        """n_words, n_hit, item ids, merged hit spans in words, longest matches."""
        if not self.hits:
            return self.n, 0, [], [], []
        h = np.unique(np.concatenate(self.hits), axis=0)  # pieces of a long text overlap, and a short item may lie in both
        spans = _united(np.stack([h[:, 2], h[:, 2] + h[:, 3]], axis=1))
        items = sorted({i for k in np.unique(h[:, 0]) for i in block.items[k] if i is not None})
        # Hits of one text that follow each other on a diagonal are one match, which no further word extends.
        shift = h[:, 2] - h[:, 1]
        by = np.lexsort((h[:, 1], shift, h[:, 0]))
        h, shift = h[by], shift[by]
        new = (np.diff(h[:, 0]) != 0) | (np.diff(shift) != 0) | (np.diff(h[:, 1]) != 1)
        first = np.concatenate([[0], np.flatnonzero(new) + 1])
        last = np.concatenate([first[1:], [len(h)]]) - 1
        longest = [(int(h[a, 2]), min((i for i in block.items[h[a, 0]] if i is not None), default=""), int(h[a, 1]), int(h[b, 1] - h[a, 1] + h[b, 3])) for a, b in zip(first, last, strict=True)]
        return self.n, int((spans[:, 1] - spans[:, 0]).sum()), items, [f"{a}:{b}" for a, b in spans], [f"{item}:{p}:{at}:{n}" for at, item, p, n in sorted(longest)]


def _search(shard: list[tuple[_Found, int, np.ndarray]], block: QueryBlock) -> None:
    """Builds the suffix array of one shard and looks every window of the block up in it."""
    if not shard:
        return
    sizes = np.array([len(w) + 1 for _, _, w in shard])
    begins = np.cumsum(sizes) - sizes
    hashes = np.zeros(sizes.sum(), np.uint64)
    for (_, _, w), b in zip(shard, begins, strict=True):
        hashes[b : b + len(w)] = w
    which, where = SuffixArray(hashes, begins + sizes - 1).find(block.queries, block.lengths)
    if not which.size:
        return
    owner = np.searchsorted(begins, where, "right") - 1
    by = np.argsort(owner, kind="stable")
    which, where, owner = which[by], where[by], owner[by]
    cut = np.flatnonzero(np.diff(owner)) + 1
    for w, at, k in zip(np.split(which, cut), np.split(where, cut), owner[np.concatenate([[0], cut])], strict=True):
        found, offset, _ = shard[k]
        start = at - begins[k] + offset
        count = block.first[w + 1] - block.first[w]
        each = np.repeat(np.arange(len(w)), count)
        own = block.first[w][each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        found.hits.append(np.stack([block.owners[own], block.places[own], start[each], block.lengths[w][each]], axis=1))


def _scan(texts, block: QueryBlock) -> list[_Found]:
    found, shard, size = [], [], 0
    for text in texts:
        words = contract_words(text)
        one = _Found(len(words))
        found.append(one)
        if not len(words):
            continue
        for at, piece in _pieces(words):
            if size + len(piece) > SHARD_WORDS:
                _search(shard, block)
                shard, size = [], 0
            shard.append((one, at, piece))
            size += len(piece) + 1
    _search(shard, block)
    return found


def _contaminated(n: int, hit: int) -> bool:
    return hit > 0 and 20 * hit >= n


_FOUND = "n_words long, n_hit long, items array<string>, spans array<string>, matches array<string>"


def _found(key: pa.Array, rows: list[tuple], name: str) -> pa.RecordBatch:
    n, hit, *lists = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays([key.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), *(pa.array(x, pa.list_(pa.string())) for x in lists)], names=[name, "n_words", "n_hit", "items", "spans", "matches"])


def _pass(docs: DataFrame, held) -> DataFrame:
    """One pass over docs, a key and the text, with one block."""
    key = docs.columns[0]

    def run(batches):
        for batch in batches:
            yield _found(batch.column(0), [f.row(held.value) for f in _scan((t.as_py() for t in batch.column(1)), held.value)], key)

    return docs.mapInArrow(in_slices(run), f"{key} long, {_FOUND}")


def _unite(batches):
    for batch in batches:
        rows = []
        for n, items, spans, matches in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
            both = _united(np.array([x.split(":") for x in spans], np.int64)) if spans else np.zeros((0, 2), np.int64)
            rows.append((n, int((both[:, 1] - both[:, 0]).sum()), sorted(set(items)), [f"{a}:{b}" for a, b in both], sorted(matches, key=lambda m: int(m.rsplit(":", 2)[1]))))
        yield _found(batch.column(0), rows, "row")


def _rounds(docs: DataFrame, blocks, scratch: Scratch) -> DataFrame:
    """row and what is found of all blocks: a pass over docs (row, text) for each, so that only one is held at a time."""
    for k, block in enumerate(blocks):
        held = docs.sparkSession.sparkContext.broadcast(block)
        some = _pass(docs, held)
        scratch.write(some.where("n_hit > 0") if k else some, f"rounds/round={k}")
        held.destroy()
    found = scratch.read("rounds", f"row long, {_FOUND}")
    every = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return found.groupBy("row").agg(F.max("n_words").alias("n_words"), every("items"), every("spans"), every("matches")).mapInArrow(in_slices(_unite), f"row long, {_FOUND}")


def _peek(benchmark: DataFrame) -> tuple:
    """The only block, or None and all blocks."""
    blocks = _blocks(benchmark)
    first, second = next(blocks, QueryBlock([])), next(blocks, None)
    return (first, None) if second is None else (None, chain((first, second), blocks))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document what it has verbatim of the benchmark: doc_id, n_words, n_hit, items, spans, matches, contaminated.

    Needs doc_id and text, item_id and text; other columns are ignored. Each task packs its documents into shards
    of bounded size, sorts the suffixes of a shard by their first 13 words (prefix tripling, three sorts) and finds
    the first 13 words of every benchmark suffix by binary search; an item of fewer words is one window. Hits that
    follow each other in both texts are joined, which gives the longest matches. The benchmark is streamed through
    the driver in blocks of at most 2^20 words (one item at least). One block is broadcast and there is no shuffle:
    a hot source or a lost executor costs its own tasks only. A benchmark of more blocks takes one pass over the
    documents for each, so never more than one block is held; the findings of a document are then united.
    items has the ids, as strings in order, of the items with a window in the document; spans the merged hits as
    start:end in words; matches the longest matches of 13 words or more, or of a whole shorter item, as
    item:item_word:document_word:words in order of place (of items of equal text, the least id stands for all).
    contaminated: n_hit > 0 and n_hit at least a twentieth of n_words. Null or blank texts have no words; repeated
    rows give repeated rows; a null item_id counts towards hits, not towards items, and is named "" in matches.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one, many = _peek(benchmark)
    if many is None:
        found = _pass(docs, docs.sparkSession.sparkContext.broadcast(one))
    else:
        scratch = Scratch(docs.sparkSession, "contamination")
        keyed = scratch.write(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
        found = keyed.select("row", "doc_id").join(_rounds(keyed.select("row", "text"), many, scratch), "row")
    return found.select("doc_id", "n_words", "n_hit", "items", "spans", "matches", ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents, all columns, whose text is not contaminated; with one block decided and filtered in one pass."""
    one, many = _peek(benchmark)
    at = documents.columns.index("text")
    if many is None:
        held = documents.sparkSession.sparkContext.broadcast(one)

        def run(batches):
            for batch in batches:
                each = [f.row(held.value) for f in _scan((t.as_py() for t in batch.column(at)), held.value)]
                yield batch.filter(pa.array([not _contaminated(n, hit) for n, hit, *_ in each], pa.bool_()))

        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in documents.schema])
        return documents.mapInArrow(in_slices(run), schema)
    scratch = Scratch(documents.sparkSession, "decontamination")
    row = next(name for k in count() if (name := f"row{k}") not in documents.columns)
    keyed = scratch.write(documents.withColumn(row, F.monotonically_increasing_id()), "docs")
    found = _rounds(keyed.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")), many, scratch)
    gone = scratch.write(found.where((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).select(F.col("row").alias(row)), "gone")
    return keyed.join(gone, row, "left_anti").select(*documents.columns)
