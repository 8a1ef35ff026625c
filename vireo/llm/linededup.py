"""Fuzzy line deduplication by MinHash.

Lines (case folded, runs of white space as one space) are sets of character shingles. One-permutation minhashing gives
every line a signature; BANDS bands of BAND_ROWS slots each put similar lines into common buckets; buckets link lines whose
sketches agree; links are verified by exact Jaccard similarity within closed clusters; and a distributed union-find keeps,
of each component of similar lines, the one that comes first by (doc_id, text hash, line number). At similarity 0.8 the
bands find a pair with probability 0.991, at 0.9 with 0.9998.

Defined cases: a line of fewer than SHINGLE characters is one shingle, so it is like its exact copies (after folding) only; an
empty line (or one of white space) has no shingles and always stays; a null text has no lines;
a null doc_id comes last; rows that repeat doc_id and text are one document, and each of them keeps the same lines; an
empty table gives an empty result; other columns pass through clean_documents() and are not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import keyed, materialize, mix, read_table, sieve, small_batches
from vireo.operators.components import connected_components
from vireo.llm.setjoin import MUL, SLOTS, XOR, compare_nodes, sketches, verify_clusters

SHINGLE = 8  # characters
BANDS, BAND_ROWS = 9, 4
PERCENT = 80
HALF_DIFFERENT = 13  # of the first 32 slots of a sketch: what similar lines stay within; links are held against all 64
#: Up to so many shingles, slots that are borrowed tell too little: bands read signatures of independent hashes, and verification
#: compares a bit for each shingle instead of sketches, which loses no pair.
SMALL = 52
SMALL_PAIR = SMALL * 100 // PERCENT  # what a line of SMALL shingles may be similar to
CACHED = 1 << 16  # characters whose shingles are worked on at a time, within a processor's cache
SEEN = 200_000  # lines that a task remembers, to pass copies over
HOT = 1000

_EMPTY = np.uint32(0xFFFFFFFF)
_POW = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4)]


def normal(line: str) -> str:
    return " ".join(line.lower().split())


#: White space of str.split() beside the blank and the line's end.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def normal_lines(text: str | None) -> list[str]:
    """normal() of each line. A text whose words all stand one blank apart needs no splitting into words."""
    if not text:
        return []
    lines = text.lower().split("\n")
    if "  " in text or any(c in text for c in _OTHER_SPACE):
        return [" ".join(x.split()) for x in lines]
    return [x.strip(" ") for x in lines]


def line_digests(lines: list[str]) -> np.ndarray:
    """Two signed 64-bit halves of a 128-bit digest of each line."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode()) for x in lines]), "<i8").reshape(-1, 2)


def _shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of lines (each at least SHINGLE long), and the line of each."""
    sizes = np.array([len(x) for x in lines])
    cp = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64)
    h = cp
    for width, power in zip((1, 2, 4), _POW):
        h = h[:-width] * power + h[width:]
    line = np.repeat(np.arange(len(lines)), sizes)[: len(h)]
    ends = np.cumsum(sizes)
    inside = np.arange(len(h)) + SHINGLE <= ends[line]
    return mix(h[inside]), line[inside]


def _signatures(lines: list[str]) -> np.ndarray:
    h, line = _shingles(lines)
    out = np.full(len(lines) * SLOTS, _EMPTY, np.uint32)
    slot = line * SLOTS + (h & np.uint64(SLOTS - 1)).astype(np.int64)
    np.minimum.at(out, slot, np.minimum(h >> np.uint64(32), np.uint64(0xFFFFFFFE)).astype(np.uint32))
    out = out.reshape(len(lines), SLOTS)
    full = out.copy()
    gaps = np.flatnonzero(out == _EMPTY)
    flat, given = full.ravel(), out.ravel()
    for step in range(1, SLOTS):
        if not len(gaps):
            break
        from_ = given[(gaps & ~(SLOTS - 1)) | ((gaps + step) & (SLOTS - 1))]
        fill = from_ != _EMPTY
        flat[gaps[fill]] = from_[fill] * np.uint32(0x85EBCA6B) + np.uint32(step)
        gaps = gaps[~fill]
    return full


def _in_parts(lines: list[str], signatures) -> np.ndarray:
    parts, begin, held = [], 0, 0
    for k, x in enumerate(lines, 1):
        held += len(x)
        if held >= CACHED or k == len(lines):
            parts.append(signatures(lines[begin:k]))
            begin, held = k, 0
    return np.concatenate(parts)


def line_signatures(lines: list[str]) -> np.ndarray:
    """SLOTS values per line: the least hash of each of SLOTS parts of its shingles; empty parts borrow from the next that is not."""
    return _in_parts(lines, _signatures)


def _independent(lines: list[str]) -> np.ndarray:
    h, line = _shingles(lines)
    starts = np.searchsorted(line, np.arange(len(lines)))
    h = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    return np.stack([np.minimum.reduceat((h ^ x) * m, starts) for x, m in zip(XOR, MUL)], axis=1)


def short_signatures(lines: list[str]) -> np.ndarray:
    """SLOTS values per line, each by a hash function of its own: nothing is borrowed, however few the shingles."""
    return _in_parts(lines, _independent)


def line_sets(items: list[bytes]) -> list[np.ndarray]:
    """The shingles of each of some normal lines: sorted distinct hashes of 52 bits."""
    out = []
    for lo in range(0, len(items), 1 << 12):
        h, line = _shingles([x.decode() for x in items[lo : lo + (1 << 12)]])
        h = np.sort(line.astype(np.uint64) << np.uint64(52) | h >> np.uint64(12))
        h = h[np.diff(h, prepend=~h[:1]) != 0]
        ends = np.searchsorted(h, np.arange(1, len(items[lo : lo + (1 << 12)]), dtype=np.uint64) << np.uint64(52))
        out += np.split(h & np.uint64((1 << 52) - 1), ends)
    return out


def line_set(line: str) -> np.ndarray:
    return np.unique(_shingles([line])[0])


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, numbers, found, ends = [], [], [], [0]
        for text in batch.column(2).to_pylist():
            lines = normal_lines(text)
            own = [k for k, x in enumerate(lines) if x]
            numbers += own
            found += [lines[k] for k in own]
            counts.append(len(lines))
            ends.append(len(numbers))
        d = line_digests(found)
        entries = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))], names=["line_no", "d1", "d2"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), lists], names=["doc_id", "rk", "n_lines", "lines"])


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    seen: set[str] = set()
    for batch in batches:
        lines = [x for text in batch.column(0).to_pylist() for x in normal_lines(text) if len(x) >= SHINGLE]
        lines = [x for x in dict.fromkeys(lines) if hash(x) not in seen]
        if not lines:
            continue
        if len(seen) > SEEN:
            seen.clear()
        seen.update(map(hash, lines))
        ids = line_digests(lines)[:, 0]
        n = np.array([len(x) - SHINGLE + 1 for x in lines])
        # lines that may be similar meet by signatures of one kind: both are short enough, or both are long enough
        for kind, (use, signatures) in enumerate(((n > SMALL, line_signatures), (n <= SMALL_PAIR, short_signatures))):
            own = np.flatnonzero(use)
            if not len(own):
                continue
            sig = signatures([lines[k] for k in own])
            key = np.repeat(band[None, :] + np.uint64(kind), len(own), axis=0)
            for r in range(BAND_ROWS):
                key = mix(key + sig[:, r : BANDS * BAND_ROWS : BAND_ROWS].astype(np.uint64))
            sk = sketches(sig).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(ids[own], BANDS)), pa.array(np.repeat(sk[:, 0], BANDS)), pa.array(np.repeat(sk[:, 1], BANDS))], names=["key", "id", "s1", "s2"])


def _member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["cluster", "d1", "d2", "least_doc", "n", "s1", "s2", "items"]
    types = [pa.int64()] * 7 + [pa.binary()]
    for batch in batches:
        rows, lines = [], []
        for doc_id, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = (text or "").split("\n")
            for a in asked:
                rows.append((a["cluster"], a["d1"], a["d2"], doc_id))
                lines.append(normal(own[a["line_no"]]))
        if not rows:
            continue
        sk = sketches(line_signatures(lines)).view(np.int64)
        cols = [*zip(*rows), [len(x) - SHINGLE + 1 for x in lines], sk[:, 0], sk[:, 1], [x.encode() for x in lines]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def duplicate_lines(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Every document (doc_id, rk, n_lines, lines), rk being a hash of its text, and the lines that go: doc_id, rk, line_no, d1, group.

    Both come from written tables and can be read again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rk"), F.col("text").cast("string").alias("text"))
    index = materialize(texts.select("doc_id", "rk", "text").mapInArrow(_index_rows, "doc_id long, rk long, n_lines long, lines array<struct<line_no:int,d1:long,d2:long>>"))
    lines = index.select("doc_id", "rk", F.explode("lines").alias("l")).select("doc_id", "rk", "l.*")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("at"), "rk", "line_no", F.col("doc_id").alias("doc_id"))
    kinds = materialize(lines.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("copies")))
    found = materialize(compare_nodes(texts.select("text").mapInArrow(_bucket_rows, "key long, id long, s1 long, s2 long"), last=True))
    clusters = materialize(connected_components(found.select("a", "b"))).select(F.col("node").alias("d1"), F.col("root").alias("cluster"))
    # sorted at every size: what is joined grows with the input
    asked = kinds.hint("merge").join(clusters, "d1").select(F.col("first.doc_id").alias("q_doc"), F.col("first.rk").alias("q_rk"), F.struct(F.col("first.line_no").alias("line_no"), "cluster", "d1", "d2").alias("q"))
    asked = asked.groupBy("q_doc", "q_rk").agg(F.collect_list("q").alias("asked"))
    # repeated rows would bring the same lines again: verification takes a line once
    asked = materialize(asked)
    texts = sieve(texts, ["doc_id", "rk"], asked, ["q_doc", "q_rk"])
    with_text = texts.hint("merge").join(asked, texts["doc_id"].eqNullSafe(F.col("q_doc")) & (F.col("rk") == F.col("q_rk"))).select("doc_id", "text", "asked")
    members = with_text.mapInArrow(_member_rows, "cluster long, d1 long, d2 long, least_doc long, n long, s1 long, s2 long, items binary")
    linked = verify_clusters(materialize(members), percent, line_sets, SMALL).select(F.col("node").alias("d1"), "root")
    groups = kinds.hint("merge").join(linked, "d1", "left").filter("root IS NOT NULL OR copies > 1").withColumn("group", F.coalesce("root", "d1"))
    groups = materialize(groups)
    least = groups.groupBy("group").agg(F.min("first").alias("keep"), F.count("*").alias("share"))
    of_line = _joined(groups.select("d1", "d2", "group", "copies"), least, ["group"])
    of_line = materialize(of_line.select("d1", "d2", "group", F.col("copies").alias("share"), F.col("keep.at").alias("k_at"), F.col("keep.rk").alias("k_rk"), F.col("keep.line_no").alias("k_line")))
    gone = _joined(lines, of_line, ["d1", "d2"]).filter(
        (F.coalesce("doc_id", F.lit((1 << 63) - 1)) != F.col("k_at")) | (F.col("rk") != F.col("k_rk")) | (F.col("line_no") != F.col("k_line"))
    )
    return index, materialize(gone.select("doc_id", "rk", "line_no", "d1", "group"))


def _joined(rows: DataFrame, named: DataFrame, key: list[str]) -> DataFrame:
    """The inner join of rows with named, which has a row for each key and in ``share`` how many of rows have it.

    Keys with more than one in HOT of all rows are HOT at most, whatever the input: they go to every task. The others are
    dealt by key, and no task meets a key of a large share.
    """
    named = materialize(named)
    total = named.agg(F.sum("share")).first()[0] or 0
    hot, rest = (named.filter(c).drop("share") for c in (F.col("share") * HOT > total, F.col("share") * HOT <= total))
    found = rows.join(F.broadcast(hot), key)
    left = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return found.unionByName(left.hint("merge").join(rest, key))


def _by_document(gone: DataFrame) -> DataFrame:
    return gone.groupBy(F.col("doc_id").alias("g_doc"), F.col("rk").alias("g_rk")).agg(F.array_sort(F.collect_set("line_no")).alias("g_lines"))


def clean_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without their duplicate lines (text and n_chars change, other columns pass). A document that loses all its lines goes."""
    _, gone = duplicate_lines(docs, percent)
    names = docs.columns
    row = keyed(docs)
    by = _by_document(gone)
    joined = row.hint("merge").join(by, row["m_doc"].eqNullSafe(by["g_doc"]) & (F.col("m_rk") == F.col("g_rk")), "left")
    left = F.filter(F.split(F.col("row.text"), "\n", -1), lambda x, k: ~F.array_contains(F.col("g_lines"), k))
    text = F.when(F.col("g_lines").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    joined = joined.withColumn("new_text", text).filter((F.col("g_lines").isNull()) | (F.length("new_text") > 0))
    out = {"text": F.col("new_text"), "n_chars": F.when(F.col("g_lines").isNull(), F.col("row.n_chars")).otherwise(F.length("new_text").cast("long")) if "n_chars" in names else None}
    return joined.select(*((out[c] if c in ("text", "n_chars") else F.col(f"row.`{c}`")).alias(c) for c in names))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awkward cases: see the module. doc_id, n_lines, n_kept_lines and removed_lines (their numbers, from 0) of every document."""
    index, gone = duplicate_lines(read_table(spark, sf_dir, "documents"))
    by = _by_document(gone)
    rows = index.select("doc_id", "rk", "n_lines")
    out = rows.hint("merge").join(by, rows["doc_id"].eqNullSafe(by["g_doc"]) & (F.col("rk") == F.col("g_rk")), "left")
    lines = F.coalesce("g_lines", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size(lines)).alias("n_kept_lines"), lines.alias("removed_lines"))
