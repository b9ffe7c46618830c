"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Passages of a document that share a seed with a benchmark item are aligned with it word by word; local
alignment finds paraphrased or edited copies, and its score decides. Seeds of long items are all their 3-grams
(word 3-grams of an item are rare in other texts). A copy of a short item may keep no 3-gram, but it keeps at least
half of its words, so the rarest half of a short item's words, and one more, are its seeds: none is missed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.llm.common import Scratch, ngram_hashes, text_slices, word_hashes

#: Words of a long item's seeds; items of at most SHORT words have words as seeds, those under WHOLE only match whole.
SEED_WORDS, SHORT, WHOLE = 3, 12, 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Score of an alignment, as a share of the item's best possible, from which a passage counts as a copy.
LEAST_SCORE = 0.5
#: Items that go through the documents at once: a bounded broadcast (under 20 MB); more items make more blocks.
BLOCK_WORDS = 1_000_000
#: Cells of alignments made at once, and pairs of a text's seed and an item's (a single text's may be more).
CELLS, PAIRS = 4_000_000, 1_000_000
#: Bytes of text hashed at once (a longer text alone), and rows.
HASH_BYTES, HASH_ROWS = 500_000, 1000


@dataclass
class Seeds:
    """n-grams of one length, as sorted distinct hashes with the items that hold them."""

    length: int
    grams: np.ndarray
    item: np.ndarray  # item of each (gram, item, place) entry, ordered by gram
    place: np.ndarray
    first: np.ndarray  # first entry of each gram

    @staticmethod
    def of(length: int, entries: list[tuple[np.ndarray, int, np.ndarray]]) -> Seeds:
        flat = np.concatenate([g for g, _, _ in entries])
        order = np.argsort(flat, kind="stable")
        grams, first = np.unique(flat[order], return_index=True)
        item = np.concatenate([np.full(len(g), k) for g, k, _ in entries])[order]
        return Seeds(length, grams, item, np.concatenate([p for _, _, p in entries])[order], np.append(first, len(flat)))

    def hits(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word place, gram) of each n-gram of the texts that is a seed."""
        ends = np.cumsum(counts)
        found = ngram_hashes(hashes, self.length)
        if not len(found):
            none = np.empty(0, int)
            return none, none, none
        at = np.searchsorted(self.grams, found)
        at[at == len(self.grams)] = 0
        hit = np.flatnonzero(self.grams[at] == found)
        text = np.searchsorted(ends, hit, side="right")
        whole = hit + self.length <= ends[text]  # not across two texts
        hit, text = hit[whole], text[whole]
        return text, hit - (ends - counts)[text], at[hit]


@dataclass
class Items:
    """A block of benchmark items: their words, and their seeds by length."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: list[Seeds]
    sizes: np.ndarray  # words of each item

    @staticmethod
    def of(ids: list[int], texts: list[str | None]) -> Items:
        hashes, starts, ends, counts = word_hashes(texts, plain=True)
        cuts = np.cumsum(counts)[:-1]
        words, lengths = (np.split(x, cuts) if len(texts) else [] for x in (hashes, ends - starts))
        known = Counter(hashes.tolist())
        entries: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = {}
        for k, w in enumerate(words):
            n = len(w)
            if not n:
                continue
            length = n if n < WHOLE else 1 if n <= SHORT else SEED_WORDS
            place = np.arange(n - length + 1)
            if WHOLE <= n <= SHORT:
                place = np.array(sorted(range(n), key=lambda p: (known[int(w[p])], -lengths[k][p], p))[: n // 2 + 1])
            entries.setdefault(length, []).append((ngram_hashes(w, length)[place], k, place))
        return Items(ids, words, [Seeds.of(n, e) for n, e in sorted(entries.items())], counts)


def smith_waterman(items: np.ndarray, item_sizes: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of pairs, and the passage word after each alignment's end.

    items: (pairs, words) padded with 1; passages: (pairs, words) padded with 0. One row of all pairs' matrices
    is made at a time; gaps along the row come from a running maximum.
    """
    n, width = passages.shape
    slope = (np.arange(width + 1) * -GAP).astype(np.int32)
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for k in range(items.shape[1]):
        same = passages == items[:, k : k + 1]
        row = np.zeros_like(above)
        np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP, out=row[:, 1:])
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        row[k >= item_sizes] = 0
        top = row.argmax(axis=1)
        value = row[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        above = row
    return best, end


def _windows(text: np.ndarray, place: np.ndarray, gram: np.ndarray, seeds: Seeds, items: Items, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, item, first word, end word): passages with a seed of an item, as wide as an alignment may be."""
    reps = seeds.first[gram + 1] - seeds.first[gram]
    entry = np.repeat(seeds.first[gram], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    if not len(entry):
        return np.empty((0, 4), int)
    t, item, at = np.repeat(text, reps), seeds.item[entry], np.repeat(place, reps)
    diagonal = at - seeds.place[entry]
    order = np.lexsort((at, item, t))
    t, item, at, diagonal = t[order], item[order], at[order], diagonal[order]
    size = items.sizes[item]
    begin = np.append(0, np.flatnonzero((np.diff(t) != 0) | (np.diff(item) != 0) | (np.diff(at) > size[1:])) + 1)
    last = np.append(begin[1:], len(t)) - 1
    low, high = np.minimum.reduceat(diagonal, begin), np.maximum.reduceat(diagonal, begin)
    t, item, size, first, stop = t[begin], item[begin], size[begin], at[begin], at[last]
    slack = np.where(size <= SHORT, size, size // 2 + 4)  # a score of a half leaves room for as many added words
    lo = np.maximum(0, np.maximum(low - slack, first - size - slack))
    hi = np.minimum(np.minimum(sizes[t], np.maximum(high + size + slack, stop + seeds.length)), stop + size + slack)
    return np.column_stack([t, item, lo, hi])


def least_score(n: int) -> float:
    """The score that an item of n words asks for."""
    return 1.0 if n < WHOLE else LEAST_SCORE


def align(hashes: np.ndarray, counts: np.ndarray, items: Items) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, end word) of the passages that score enough; best per text and item."""
    begins = np.cumsum(counts) - counts
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    windows = []
    for seeds in items.seeds:
        text, place, gram = seeds.hits(hashes, counts)
        pairs = np.append(0, np.cumsum(seeds.first[gram + 1] - seeds.first[gram]))
        at = 0
        while at < len(text):  # whole texts, with at most PAIRS pairs if there is more than one
            end = np.searchsorted(pairs, pairs[at] + PAIRS, side="right") - 1
            end = max(np.searchsorted(text, text[min(end, len(text) - 1)]) if end < len(text) else end, np.searchsorted(text, text[at], side="right"))
            for t, i, lo, hi in _windows(text[at:end], place[at:end], gram[at:end], seeds, items, counts).tolist():
                # a score counts MATCH for no more words than the item has of the passage's
                if np.isin(items.words[i], hashes[begins[t] + lo : begins[t] + hi]).sum() >= least_score(len(items.words[i])) * len(items.words[i]):
                    windows.append((t, i, lo, hi))
            at = end
    windows.sort(key=lambda w: w[3] - w[2])
    at = 0
    while at < len(windows):
        end, width = at, 0
        while end < len(windows) and (end == at or (end + 1 - at) * max(width, windows[end][3] - windows[end][2]) * 8 <= CELLS):
            width = max(width, windows[end][3] - windows[end][2])
            end += 1
        block = windows[at:end]
        at = end
        sizes = np.array([len(items.words[i]) for _, i, _, _ in block])
        wanted = np.ones((len(block), sizes.max()), np.uint64)
        passages = np.zeros((len(block), width), np.uint64)
        for k, (t, i, lo, hi) in enumerate(block):
            wanted[k, : sizes[k]] = items.words[i]
            passages[k, : hi - lo] = hashes[begins[t] + lo : begins[t] + hi]
        score, stop = smith_waterman(wanted, sizes, passages)
        for (t, i, lo, _), size, s, e in zip(block, sizes, score, stop):
            share = s / (MATCH * size)
            if share >= least_score(size) and share > best.get((t, i), (0.0,))[0]:
                best[t, i] = (float(share), max(lo, lo + int(e) - int(size)), lo + int(e))
    return [(t, i, *found) for (t, i), found in sorted(best.items())]


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Passages of documents that copy benchmark items: doc_id, item_id, score, first_word, end_word.

    Words are runs of characters other than the six separators, without case and ASCII punctuation. score: the
    best local alignment's share of the item's perfect score, at least LEAST_SCORE; items under WHOLE words only
    match word for word. The best passage per document and item is given. A passage is aligned if it shares a
    seed with the item: no copy of an item of at most SHORT words is missed, and of longer ones those without any
    common 3-gram. Null and empty texts and items match nothing; rows with a null doc_id are searched, items with a
    null id aren't; repeated rows match each for itself; empty tables give an empty result. Very long texts are
    hashed alone. The benchmark passes through the documents in blocks of at most BLOCK_WORDS words. Other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    kinds = [docs.schema[doc_id].dataType, benchmark.schema[item_id].dataType, T.DoubleType(), T.LongType(), T.LongType()]
    names = ["doc_id", "item_id", "score", "first_word", "end_word"]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    id_type, out = to_arrow_type(kinds[1]), None
    for ids, texts in _blocks(benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").orderBy("i", "t")):
        shared = docs.sparkSession.sparkContext.broadcast(Items.of(ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            own_ids = pa.array(items.ids, id_type)
            for piece, raw in text_slices(batches, HASH_BYTES, HASH_ROWS):
                hashes, _, _, n = word_hashes(raw, plain=True)
                found = align(hashes, n, items)
                t, i, score, lo, hi = ([f[k] for f in found] for k in range(5))
                columns = [piece.column(0).take(pa.array(t, pa.int64())), own_ids.take(pa.array(i, pa.int64())), pa.array(score, pa.float64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return scratch.keep(out, "found", shuffled=False)


def _blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():  # one partition at a time
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t.split())
        if size >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
