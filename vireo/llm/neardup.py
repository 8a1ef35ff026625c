"""Near-duplicate documents by a chosen-path set similarity join (Christiani & Pagh, STOC 2017; Christiani, Pagh & Sivertsen, 2018).

Documents are sets of word shingles. Each of TREES independent trees branches every document recursively: at a tree node,
each minwise slot is selected with probability 1 / (BRANCH * SLOTS) by a hash of the node's path, and the document goes to one
child for each selected slot, named by its minwise value there. Documents with similarity at or above BRANCH share children
faster than paths die out, others part at every level. Nodes of up to NODE_LIMIT members are compared exhaustively (on
sketches); larger ones are branched further. At similarity 0.8 a pair meets in a leaf of depth 3 with probability 0.4 a tree,
so all 16 trees miss it with probability 0.0004. Links are then decided on full sets.

Exact copies (equal shingle sets) are one member throughout. Defined cases: null and empty texts have an empty set and are
linked with nothing; a text with fewer words than a shingle is one shingle; component ids ignore null doc_ids, unless all
are null; repeated rows are copies and each gets its row; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import digest128, keyed, materialize, mix, read_table, shingle_set, sieve, small_batches, text_bytes
from vireo.operators.components import connected_components
from vireo.llm.setjoin import SLOTS, compare_nodes, signature, sketches, verify_clusters

TREES = 16
BRANCH = 0.75
MORE_LEVELS = 2  # levels by which an overfull node is branched further,
MORE_ROUNDS = 3  # so many times
PERCENT = 80

_SLOT = np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_CHOSEN = np.uint64(int((1 << 64) / (BRANCH * SLOTS)))


def branch(signatures: np.ndarray, member: np.ndarray, path: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Members (rows of signatures) and paths after so many more levels."""
    for _ in range(levels):
        row, slot = np.nonzero(mix(path[:, None] ^ _SLOT[None, :]) < _CHOSEN)
        member, path = member[row], path[row]
        value = signatures[member, slot].astype(np.uint64)
        path = mix(path + _SLOT[slot] * np.uint64(3) + mix(value + np.uint64(1)))
    return member, path


def start_levels(n: int) -> int:
    """Levels before nodes are first compared: more members need more branching."""
    return max(2, round(math.log2(max(n, 2)) / 6))


def _set_rows(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, size)
                found.append((*digest128(s), len(s), signature(s).tobytes() if len(s) else None))
            cols = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, schema.field(k + 2).type) for k, c in enumerate(cols))], schema=schema)

    return run


def _node_rows(levels: int, from_root: bool):
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, SLOTS)
            sk = sketches(sig).view(np.int64)
            if from_root:
                member = np.tile(np.arange(n), TREES)
                path = np.repeat(mix(np.arange(1, TREES + 1, dtype=np.uint64)), n)
            else:
                member, path = np.arange(n), batch.column(2).to_numpy().view(np.uint64)
            member, path = branch(sig, member, path, levels)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[member]), pa.array(sk[member, 0]), pa.array(sk[member, 1])], schema=schema)

    return run


def candidate_links(sets: DataFrame) -> DataFrame:
    """Links a, b of d1 values that connect a superset of all similar sets; sets (a written table) has d1 and sig."""
    spark = sets.sparkSession
    small_batches(spark, 2048)
    members = sets.filter("n > 0").select("d1", "sig")
    nodes = members.mapInArrow(_node_rows(start_levels(members.count()), True), "key long, id long, s1 long, s2 long")
    links = None
    for k in range(MORE_ROUNDS + 1):
        found = materialize(compare_nodes(nodes, last=k == MORE_ROUNDS))
        pairs = found.filter("kind = 0").select("a", "b")
        links = pairs if links is None else links.unionAll(pairs)
        over = found.filter("kind = 1").select(F.col("b").alias("d1"), F.col("a").alias("path"))
        if k == MORE_ROUNDS or not over.limit(1).count():
            return links
        nodes = over.join(members, "d1").select("d1", "sig", "path").mapInArrow(_node_rows(MORE_LEVELS, False), "key long, id long, s1 long, s2 long")
    return links


def _member_sets(size: int):
    """Full sets and sketches of the rows whose text has the digest that was asked for."""
    names = ["cluster", "d1", "d2", "least_doc", "n", "s1", "s2", "items"]
    types = [pa.int64()] * 7 + [pa.binary()]
    schema = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, cluster, d1, d2, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(text, size)
                if digest128(s) == (d1, d2):
                    a, b = sketches(signature(s)[None, :]).view(np.int64)[0]
                    found.append((cluster, d1, d2, least, len(s), int(a), int(b), s.tobytes()))
            cols = list(zip(*found)) if found else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema=schema)

    return run


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, rk (a hash of the text), n_shingles, component_id, kept, and root (a group's number; null where a document is alone) for every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rk"), text_bytes().alias("text"))
    rows = materialize(texts.mapInArrow(_set_rows(size), "doc_id long, rk long, d1 long, d2 long, n long, sig binary"))
    sets = materialize(rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least_doc"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("at"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    clusters = materialize(connected_components(candidate_links(sets))).select(F.col("node").alias("d1"), F.col("root").alias("cluster"))
    asked = materialize(sets.join(clusters, "d1").select(F.col("at.doc_id").alias("q_doc"), F.col("at.rk").alias("q_rk"), "least_doc", "cluster", "d1", "d2"))
    small_batches(spark)
    # texts that are asked for are sorted by id and text hash at every size, never a list of ids sent to all tasks
    some = sieve(texts, ["doc_id", "rk"], asked, ["q_doc", "q_rk"])
    with_text = some.hint("merge").join(asked, some["doc_id"].eqNullSafe(asked["q_doc"]) & (some["rk"] == asked["q_rk"])).select("text", "cluster", "d1", "d2", "least_doc")
    members = with_text.mapInArrow(_member_sets(size), "cluster long, d1 long, d2 long, least_doc long, n long, s1 long, s2 long, items binary")
    linked = verify_clusters(materialize(members), percent)
    # the least doc_id of each component of sets, then back to the rows
    roots = sets.select("d1", "d2", "least_doc", "copies").join(linked.select(F.col("node").alias("d1"), "root"), "d1", "left")
    roots = materialize(roots.filter("root IS NOT NULL OR copies > 1").withColumn("root", F.coalesce("root", "d1")))
    least = roots.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    grouped = roots.join(least, "root").select("d1", "d2", "component_id", "root")
    out = rows.drop("sig").join(grouped, ["d1", "d2"], "left")
    out = out.withColumn("component_id", F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "rk", "root", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """docs without near duplicates: of each group the row with the least (doc_id, text hash) stays, once; a null doc_id is the greatest."""
    found = materialize(near_duplicates(docs, size, percent).select("doc_id", "rk", "root")).filter("root IS NOT NULL")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("at"), "rk")
    first = found.groupBy("root").agg(F.min(place).alias("first"))
    gone = found.join(first, "root").filter(place != F.col("first")).select(F.col("doc_id").alias("g_doc"), F.col("rk").alias("g_rk")).distinct()
    rows = keyed(docs)
    same = lambda x: rows["m_doc"].eqNullSafe(x["g_doc"]) & (rows["m_rk"] == x["g_rk"])
    left = rows.join(gone, same(gone), "left_anti")
    again = found.groupBy(F.col("doc_id").alias("g_doc"), F.col("rk").alias("g_rk")).agg(F.count("*").alias("k")).filter("k > 1").drop("k")
    if again.limit(1).count():  # rows that repeat doc_id and text
        again = materialize(again)
        once = rows.join(again, same(again), "left_semi").dropDuplicates(["m_doc", "m_rk"])
        rows = left
        left = left.join(again, same(again), "left_anti").unionAll(once.join(gone, once["m_doc"].eqNullSafe(gone["g_doc"]) & (once["m_rk"] == gone["g_rk"]), "left_anti"))
    return left.select("row.*")


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, at two-word shingles and a similarity of 0.8. Awkward cases: see the module."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
