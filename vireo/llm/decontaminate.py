"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, and exact edit verification.

A document is contaminated by an item if some passage of it is within floor(EDIT_PERCENT * n / 100) word edits of the item's n
words. Windows of the item's size are embedded by the CGK random walk (Chakraborty, Goldenberg & Koucky, STOC 2016), which turns
edit distance into Hamming distance: at step j the walk copies the word it stands on and moves on if a random bit of
(j, word) is set. Each walk is a hash table of its own: the words at SAMPLES of its steps are a key by which windows meet items.
Whatever is met so, and nothing else, is verified by bit-parallel edit distance around the window.

Two walks that an insertion has put out of step need a while to meet again, so steps agree ever less the longer walks go on: at
the edit limit one walk over 400 words finds next to nothing. So a window is embedded in pieces of PIECE words and up to twice
that, at each of which the walk starts anew, with tables of its own. A piece that lies at another place than in the item, as there are
insertions before it, is met by the window that begins as much later, since there is one at each place. Of the pieces of a match
one has at most its share of the edits. Longer items have more pieces, and need fewer tables for each: TABLES is chosen by the number of
pieces, from recall measured at the edit limit (tests hold it at 0.9 or more for items of 5 to 400 words, from keys alone).

A window is embedded only if it shares as many word pairs with items of its size as every match must (n - 1 - 2 * edits: one edit
spoils two pairs), a bound that loses nothing; where that number isn't positive, all windows are.

Items are taken in blocks of a bounded size, each one pass over the documents. Words are runs of letters and digits, ASCII
case folded; all else ASCII separates.

Defined cases: null and empty texts and items match nothing; items of fewer than five words must match exactly; repeated
rows of a doc_id give one row per item with the least edits; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import keyed, materialize, mix, read_table, small_batches, text_bytes, word_hashes

EDIT_PERCENT = 20
PIECE = 20  # words of a piece, at least, where an item has as many
TABLES = {1: 28, 2: 20, 3: 14, 4: 12, 5: 10, 6: 8}  # walks for each piece, by the number of pieces; with more pieces as with the most
SAMPLES = 3
BLOCK_BYTES = 4 << 20  # of items' text that a task holds
WINDOWS = 4096  # embedded at a time
_TABLE_BITS = 20

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SCHEMA = "doc_id long, item_id long, n_words int, edits int, end_word long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("edits", pa.int32()), ("end_word", pa.int64())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def edits_allowed(n: int, percent: int = EDIT_PERCENT) -> int:
    return n * percent // 100


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edits between item and any passage of text, and the first end of such a passage (Myers 1999, on words)."""
    m = len(item)
    masks: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        masks[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def pieces_of(n: int) -> list[tuple[int, int]]:
    """Begin and length of the pieces of a window of n words: all of one length, PIECE to twice that where n allows; some words may be left at the end."""
    number = max(1, n // PIECE)
    return [(p * (n // number), n // number) for p in range(number)]


def tables_of(pieces: int) -> int:
    return TABLES[min(pieces, max(TABLES))]


class Index:
    """A block of items, ready to meet windows. Built alike on the driver and in every task."""

    def __init__(self, items: list[tuple[int | None, bytes]], percent: int = EDIT_PERCENT, samples: int = SAMPLES) -> None:
        vocabulary: dict[bytes, int] = {}
        self.items = []
        for item_id, text in items:
            found = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            if found:
                self.items.append((item_id, found))
        self.vocabulary, self.percent = vocabulary, percent
        self.sizes = sorted({len(x) for _, x in self.items})
        self.longest = max(self.sizes, default=0)
        # hashes of the words, not of their numbers: walks are the same for every block
        self.hash = np.concatenate([np.zeros(1, np.uint64), word_hashes(vocabulary, len(vocabulary))])
        # lengths of pieces, and the tables that the items with pieces of a length ask for
        self.lengths: dict[int, int] = {}
        for size in self.sizes:
            cut = pieces_of(size)
            self.lengths[cut[0][1]] = max(self.lengths.get(cut[0][1], 0), tables_of(len(cut)))
        most, widest = max(self.lengths.values(), default=0), max(self.lengths, default=0)
        rng = np.random.Generator(np.random.PCG64(7))
        self.walk = rng.integers(0, 1 << 63, (2 * 2 * PIECE, max(TABLES.values())), dtype=np.uint64)[: 2 * widest, :most]
        place = rng.random((max(TABLES.values()), samples))[:most]
        # a walk leaves its piece after twice the piece's length, on average: steps are sampled up to there
        self.sampled = {n: (place[:t] * 2 * n).astype(np.int64) for n, t in self.lengths.items()}
        # word pairs -> the groups of sizes whose items hold them; 64 groups at most
        self.group = {n: k * 64 // max(len(self.sizes), 1) for k, n in enumerate(self.sizes)}
        self.pairs = np.zeros(1 << _TABLE_BITS, np.uint64)
        self.single = np.zeros(len(vocabulary) + 1, bool)
        for _, x in self.items:
            if len(x) == 1:
                self.single[x[0]] = True
            else:
                x = np.array(x)
                np.bitwise_or.at(self.pairs, self._pair(x[:-1], x[1:]), np.uint64(1 << self.group[len(x)]))
        # by length and table: key -> items and where their piece begins
        self.buckets: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {(n, t): defaultdict(list) for n, tables in self.lengths.items() for t in range(tables)}
        cut: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, (_, x) in enumerate(self.items):
            for begin, n in pieces_of(len(x)):
                cut[n].append((at, begin))
        for n, places in cut.items():
            for lo in range(0, len(places), WINDOWS):
                part = places[lo : lo + WINDOWS]
                keys = self.embed(np.array([self.items[at][1][begin : begin + n] for at, begin in part], np.int64))
                for k, (at, begin) in enumerate(part):
                    for t in range(tables_of(len(pieces_of(len(self.items[at][1]))))):
                        self.buckets[n, t][int(keys[k, t])].append((at, begin))
        self.known = {k: np.array(sorted(b), np.uint64) for k, b in self.buckets.items()}

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(self.hash[a] * np.uint64(3) + self.hash[b]) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def embed(self, pieces: np.ndarray) -> np.ndarray:
        """A key per piece (row, all of one length) and table: the words of the walk at the table's sampled steps."""
        n, width = pieces.shape
        sampled = self.sampled[width]
        t = len(sampled)
        key = np.full((n, t), mix(np.array([width], np.uint64))[0])
        # a column of zeros is where a walk waits that has left its piece; hashes instead of words
        hashes = self.hash[np.concatenate([pieces, np.zeros((n, 1), np.int64)], axis=1)].ravel()
        begin = np.repeat((np.arange(n) * (width + 1))[:, None], t, axis=1)
        at, end = begin.copy(), begin + width
        for j in range(int(sampled.max(initial=-1)) + 1):
            h = hashes[np.minimum(at, end)]
            for c in np.flatnonzero((sampled == j).any(axis=1)):
                key[:, c] = mix(key[:, c] + h[:, c] * np.uint64(5) + np.uint64(j))
            x = (h ^ self.walk[j, :t]) * np.uint64(0x9E3779B97F4A7C15)
            at += ((x ^ (x << np.uint64(29))) >> np.uint64(63)).astype(np.int64)
        return key

    def starts(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each size of item, the places where a window may lie within the edits allowed."""
        n = len(ids)
        if 1 in self.sizes:
            yield 1, np.flatnonzero(self.single[ids])
        mask = np.zeros(n, np.uint64)
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        mask[both] = self.pairs[self._pair(ids[both], ids[both + 1])]
        hits = np.flatnonzero(mask)
        marks = mask[hits]
        for size in self.sizes:
            if size < 2:
                continue
            k = edits_allowed(size, self.percent)
            need = size - 1 - 2 * k
            if need < 1:
                yield size, np.arange(n)
                continue
            own = hits[(marks >> np.uint64(self.group[size])) & np.uint64(1) > 0]
            if len(own) < need:
                continue
            # pairs own[i] .. own[i + need - 1] must fit a passage of size + k words
            first, final = own[: len(own) - need + 1], own[need - 1 :]
            fits = final - first <= size + k - 2
            if not fits.any():
                continue
            low, high = np.maximum(final[fits] - (size + k - 2), 0), first[fits]
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, low, 1)
            np.add.at(edge, high + 1, -1)
            yield size, np.flatnonzero(np.cumsum(edge)[:n] > 0)

    def met(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Item and begin of the windows that have a key in common with the item."""
        asked: dict[int, np.ndarray] = {}
        for size, starts in self.starts(ids):
            cut = pieces_of(size)
            marks = asked.setdefault(cut[0][1], np.zeros(len(ids), bool))
            for begin, _ in cut:
                marks[np.minimum(starts + begin, len(ids) - 1)] = True
        for length, marks in asked.items():
            places, reach = np.flatnonzero(marks), np.arange(length)
            for lo in range(0, len(places), WINDOWS):
                at = places[lo : lo + WINDOWS]
                keys = self.embed(ids[np.minimum(at[:, None] + reach, len(ids) - 1)])
                for t in range(self.lengths[length]):
                    known = self.known[length, t]
                    place = np.searchsorted(known, keys[:, t])
                    for r in np.flatnonzero(known[np.minimum(place, len(known) - 1)] == keys[:, t]) if len(known) else ():
                        for item, begin in self.buckets[length, t].get(int(keys[r, t]), ()):
                            yield item, int(at[r]) - begin

    def matches(self, docs: list[tuple[int | None, bytes]]) -> list[tuple]:
        """Rows of SCHEMA for a few documents."""
        get = self.vocabulary.get
        gap = self.longest + edits_allowed(self.longest, self.percent) + 1
        parts, begins, at = [np.zeros(gap, np.int64)], [], gap
        for _, text in docs:
            w = words_of(text)
            begins.append((at, len(w)))
            parts += [np.fromiter(map(get, w, repeat(0)), np.int64, len(w)), np.zeros(gap, np.int64)]
            at += len(w) + gap
        ids = np.concatenate(parts)
        froms = np.array([b for b, _ in begins])
        found: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for item, begin in self.met(ids):
            n = len(self.items[item][1])
            k = edits_allowed(n, self.percent)
            doc = max(0, int(np.searchsorted(froms, begin + n // 2, side="right")) - 1)
            found[doc, item].add((begin - k, begin + n + 2 * k))
        out = []
        for (doc, item), near in found.items():
            item_id, words = self.items[item]
            k = edits_allowed(len(words), self.percent)
            begin, length = begins[doc]
            best = None
            merged: list[list[int]] = []
            for a, b in sorted(near):
                a, b = max(begin, a), min(begin + length, b)
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                edits, end = best_match(words, ids[a:b].tolist())
                if edits <= k and (best is None or edits < best[0]):
                    best = edits, a - begin + end
            if best:
                out.append((docs[doc][0], item_id, len(words), *best))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = EDIT_PERCENT) -> DataFrame:
    """doc_id, item_id, n_words, edits and end_word of every contaminated document and the item it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text")).filter(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    out = None
    for block in range(blocks):
        # about BLOCK_BYTES come to the driver, whatever the benchmark's size
        held = [(r[0], bytes(r[1])) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index(held, percent)
            for batch in batches:
                found = index.matches(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))) if index.items else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _ARROW, strict=True)], schema=_ARROW)

        part = texts.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionAll(part)
    best = F.min(F.struct("edits", "end_word", "n_words")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_words", "best.edits", "best.end_word")


def clean_documents(docs: DataFrame, benchmark: DataFrame, percent: int = EDIT_PERCENT) -> DataFrame:
    """docs without the contaminated ones, told apart by doc_id and text."""
    key = F.xxhash64("doc_id", "text")
    hits = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, percent).select(F.col("doc_id").alias("hit")).distinct()
    rows = keyed(docs).withColumn("m_key", F.xxhash64("row.doc_id", "row.text"))
    return rows.join(materialize(hits), F.col("m_key") == F.col("hit"), "left_anti").select("row.*")


def op2_cgk_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_words, edits and end_word of all documents that hold an item of the benchmark. Awkward cases: see the module."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
