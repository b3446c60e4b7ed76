"""Ranked lexical search: the best documents for each item of a query set, over range-maximum tables of posting lists.

1. The items' terms are hashed; items are taken in blocks of ``BLOCK_TERMS`` terms at most (one item at least), each with
   one pass over the documents. Only a block's terms go to the tasks.
2. Documents are read into segments of ``SEGMENT_DOCS`` documents or ``SEGMENT_POSTINGS`` postings, written as a table: of
   each asked term, the documents that hold it, sorted, with counts. Sums over the segments give the statistics of the
   whole collection, and so each term's weight.
3. In a segment each posting list gets a sparse table of the places of range maxima of its impacts. For an item, intervals
   of documents are taken best first: the sum of its terms' range maxima bounds any document inside. An interval is
   split at the document with the greatest single impact, which is scored there and then; one of ``LEAF`` documents at
   most is scored as a whole. The search ends when no interval can beat the last of the best documents so far.
4. The best of each segment are ranked for each item over all segments; Spark limits each task's rows before its shuffle.

A segment's documents are ordered by key, so equal scores prune by key as well and thousands of copies cost no more than
``top``. Terms are told apart by hashes of 64 bits.

Edge cases: null and empty texts hold no term; documents without a term aren't counted. An item without a known term gets
no rows, one with few matching documents gets as many as there are. Rows that share an item's key are one item, their
terms together. Each row of the documents is a document, also one that repeats a key; null keys rank after others of the
same score. Empty tables give an empty result; other columns don't matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import Workspace
from .common import arrow_map, slices, whole_key, word_hashes

BLOCK_TERMS, SEGMENT_DOCS, SEGMENT_POSTINGS, LEAF, BATCH = 1 << 20, 1 << 13, 1 << 19, 64, 32
#: Bytes that no term holds: all of ASCII but digits and letters.
BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item, term, repeats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, "text"):
                words, rows = word_hashes(data, offs, BREAK)
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(rows)))), pa.array(words.view(np.int64))], ["item", "term"])

    found = arrow_map(items.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")), run, "item long, term long")
    return found.groupBy("item", "term").agg(F.count("*").alias("repeats"))


class _Segment:
    """Postings of a run of documents, gathered slice by slice."""

    def __init__(self) -> None:
        self.keys: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.postings = 0

    def add(self, keys: pa.Array, words: np.ndarray, rows: np.ndarray, terms: np.ndarray) -> None:
        slot = np.searchsorted(terms, words)
        slot[slot == len(terms)] = 0
        doc = np.repeat(np.arange(len(keys)), np.diff(rows))
        known = terms[slot] == words
        pair, tf = np.unique(doc[known] * len(terms) + slot[known], return_counts=True)
        self.parts.append((self.docs + pair // len(terms), pair % len(terms), tf))
        self.keys.append(keys)
        self.lengths.append(np.diff(rows))
        self.docs += len(keys)
        self.postings += len(pair)

    def row(self) -> pa.RecordBatch:
        """Documents by key (null last), postings by term and document."""
        keys, lengths = pa.concat_arrays(self.keys), np.concatenate(self.lengths)
        order = pc.array_sort_indices(keys, null_placement="at_end").to_numpy().astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, slot, tf = (np.concatenate(x) for x in zip(*self.parts))
        doc = place[doc]
        by = np.lexsort((doc, slot))
        some = lengths[lengths > 0]
        return pa.RecordBatch.from_pydict({
            "docs": pa.array([keys.take(pa.array(order))], pa.list_(pa.int64())), "lengths": [lengths[order].astype(np.int64).tobytes()],
            "doc": [doc[by].astype(np.int32).tobytes()], "slot": [slot[by].astype(np.int32).tobytes()], "tf": [tf[by].astype(np.int32).tobytes()], "n": [len(some)], "total": [int(some.sum())],
        })


def segments(docs: DataFrame, terms: np.ndarray, key: str, text: str) -> DataFrame:
    """The postings of ``terms`` (sorted hashes, not empty), a row for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Segment()
        for batch in batches:
            for part, data, offs in slices(batch, "text"):
                own.add(part.column("key"), *word_hashes(data, offs, BREAK), terms)
                if own.docs >= SEGMENT_DOCS or own.postings >= SEGMENT_POSTINGS:
                    yield own.row()
                    own = _Segment()
        if own.docs:
            yield own.row()

    schema = "docs array<long>, lengths binary, doc binary, slot binary, tf binary, n long, total long"
    return arrow_map(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), run, schema)


def _weights(index: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """The weight of each term, and the numbers of documents and of terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            for slot in batch.column(0):
                df += np.bincount(np.frombuffer(slot.as_buffer(), np.int32), minlength=terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["slot", "df"])

    n, total = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    counts = arrow_map(index.select("slot"), run, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(terms, np.int64)
    for slot, df in zip(counts.column("slot").to_pylist(), counts.column("df").to_pylist()):
        out[slot] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    return out, n, total


class Ranges:
    """Posting lists one after the other, with sparse tables of the places of range maxima."""

    def __init__(self, lists: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> None:
        """``lists`` and ``doc``: the list of each posting and its document, sorted by both; ``docs``: how many there are."""
        self.docs, self.impact, self.doc = docs, impact, doc
        self.known, first = np.unique(lists, return_index=True)
        self.ends = np.append(first, len(lists))
        self.place = np.repeat(np.arange(len(self.known)), np.diff(self.ends)) * docs + doc
        longest = int(np.diff(self.ends).max(initial=1))
        self.table, step = [np.arange(len(lists), dtype=np.int32)], 1
        while 2 * step <= longest:
            a, b = self.table[-1][:-step], self.table[-1][step:]
            self.table.append(np.where(impact[a] >= impact[b], a, b))
            step *= 2

    def best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first place of the greatest impact in [a, b); where that is empty, any."""
        out = np.minimum(a, max(len(self.impact) - 1, 0))
        level = np.frexp(np.maximum(b - a, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[b > a]):
            at = np.nonzero((level == k) & (b > a))
            left, right = self.table[k][a[at]], self.table[k][b[at] - (1 << int(k))]
            out[at] = np.where(self.impact[left] >= self.impact[right], left, right)
        return out


def search_segment(ranges: Ranges, lists: np.ndarray, repeats: np.ndarray, top: int) -> list[tuple[int, int]]:
    """The best ``top`` documents for one item: score and number of the document, best first, lower numbers first."""
    at = np.searchsorted(ranges.known, lists)
    at[at == len(ranges.known)] = 0
    found = ranges.known[at] == lists if len(ranges.known) else np.zeros(len(lists), bool)
    at, repeats = at[found], repeats[found]
    if not len(at):
        return []
    base, impact = at * ranges.docs, ranges.impact
    best: list[tuple[int, int]] = []  # a heap of (score, -document), the worst first

    def open_(bound: int, lo: int) -> bool:
        return bound > 0 and (len(best) < top or (bound, -lo) > best[0])

    def offer(score: int, doc: int) -> None:
        if open_(score, doc):
            (heapq.heappush if len(best) < top else heapq.heapreplace)(best, (score, -doc))

    def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of range maxima, and the documents of the greatest of these."""
        places = ranges.best(a, b)
        most = np.where(b > a, impact[places], 0) * repeats
        pick = most.argmax(1)
        return most.sum(1), ranges.doc[places[np.arange(len(a)), pick]]

    heap: list[tuple[int, int, int, int, np.ndarray, np.ndarray]] = []

    def push(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        bound, split = bounds(a, b)
        for i in range(len(lo)):
            if lo[i] < hi[i] and open_(int(bound[i]), int(lo[i])):
                heapq.heappush(heap, (-int(bound[i]), int(lo[i]), int(hi[i]), int(split[i]), a[i], b[i]))

    push(np.array([0]), np.array([ranges.docs]), ranges.ends[at][None, :], ranges.ends[at + 1][None, :])
    while heap:
        wide = []
        while heap and len(wide) < BATCH:
            bound, lo, hi, split, a, b = heapq.heappop(heap)
            if not open_(-bound, lo):
                if not best or -bound < best[0][0]:
                    heap.clear()
                continue
            if hi - lo > LEAF:
                wide.append((lo, hi, split, a, b))
                continue
            size = b - a
            place = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            scores = np.zeros(hi - lo, np.int64)
            np.add.at(scores, ranges.doc[place] - lo, impact[place] * np.repeat(repeats, size))
            for i in np.flatnonzero(scores >= (best[0][0] if len(best) == top else 1)).tolist():
                offer(int(scores[i]), lo + i)
        if not wide:
            continue
        lo, hi, split = (np.array([w[i] for w in wide]) for i in range(3))
        a, b = (np.stack([w[i] for w in wide]) for i in (3, 4))
        cut = np.searchsorted(ranges.place, base[None, :] + split[:, None])
        holds = (cut < b) & (ranges.place[np.minimum(cut, len(ranges.place) - 1)] == base[None, :] + split[:, None])
        scores = (np.where(holds, impact[np.minimum(cut, len(impact) - 1)], 0) * repeats).sum(1)
        for s, d in zip(scores.tolist(), split.tolist()):
            offer(s, d)
        push(np.concatenate([lo, split + 1]), np.concatenate([split, hi]), np.concatenate([a, cut + holds]), np.concatenate([cut, b]))
    return sorted(((s, -d) for s, d in best), key=lambda x: (-x[0], x[1]))


def _best(index: DataFrame, weights: np.ndarray, n: int, total: int, asked: list[tuple[int | None, np.ndarray, np.ndarray]], top: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc, slot, tf = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in ("doc", "slot", "tf"))
                keys, lengths = batch.column("docs")[row].values, np.frombuffer(batch.column("lengths")[row].as_buffer(), np.int64)
                if not len(doc):
                    continue
                m, tf = 100 - 25 + 25 * lengths[doc] * n // total, tf.astype(np.int64)
                ranges = Ranges(slot.astype(np.int64), doc.astype(np.int64), weights[slot] * (1_000_000_000 * tf // (1000 * tf + 12 * m)), len(keys))
                items, docs, scores = [], [], []
                for item, lists, repeats in asked:
                    for score, d in search_segment(ranges, lists, repeats, top):
                        items.append(item)
                        docs.append(d)
                        scores.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), keys.take(pa.array(docs, pa.int64())), pa.array(scores, pa.int64())], ["item", "doc", "score"])

    return arrow_map(index.drop("n", "total"), run, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item, rank, key, score``: for each item its ``top`` documents with the highest scores above 0."""
    whole_key(docs, key)
    whole_key(items, item)
    spark, work = docs.sparkSession, Workspace(docs.sparkSession)
    terms = work.write(_item_terms(items, item, item_text))
    blocks = -(-terms.count() // BLOCK_TERMS)
    out = spark.createDataFrame([], "item long, doc long, score long")
    for b in range(blocks):
        own = terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item").toArrow()
        if not own.num_rows:
            continue
        known, slot = np.unique(own.column("term").to_numpy().view(np.uint64), return_inverse=True)
        ids, repeats = own.column("item").to_pylist(), own.column("repeats").to_numpy()
        cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
        asked = [(ids[x], slot[x:y], repeats[x:y]) for x, y in zip(cuts, cuts[1:])]
        index = work.write(segments(docs, known, key, text))
        weights, n, total = _weights(index, len(known))
        if total:
            out = out.unionByName(_best(index, weights, n, total, asked, top))
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")
