"""A Merkle manifest of a dataset: a digest for each row, source and table, and for each row a proof that folds to the root.

Leaves of a source ascend by doc_id; every ``FAN`` consecutive nodes become one, until one is left, the source's subroot. The
subroots, by source, become the root in the same way. H(x, y, ...) is the lower-case hex SHA-256 of the inputs one after the other.

For each parent its **preimage** is stored: its children's 64-character digests one after the other. A leaf's proof is then cut
out of the preimages of its ancestors: without its own 64 characters a preimage is the siblings, and with another digest spliced
into that slot it hashes to what the parent would have been. So nobody searches for siblings, and folding needs no tree.

A pass takes ``LEVELS`` levels at once: a block is FAN^LEVELS consecutive nodes, a row keyed by source and number, with all
preimages within it. Going down again, a block takes over the path above it from the block that it is a node of (or from its
source's place in the tree of subroots, if it is the last), and each leaf joins its block once. All joins are by (source, number of
a block), FAN^LEVELS rows to a key, so a source with a third of all rows is no hot key; its leaves get their places from a range
partitioning with one count per partition and source. Only the root comes to the driver.

Defined cases: nulls hash as ``-``; null doc_ids stand first and a null source is a source of its own, before all others; rows
of equal source and doc_id are ordered by their leaf, and then they are the same; a null doc_id is never tampered with; an empty
table gives an empty result; columns but the five are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vireo.llm.common import materialize, read_table

FAN = 3
LEVELS = 3  # of the tree in a pass
WIDE = FAN**LEVELS
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<pre:string,slot:int>>"


def framed(value: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    """H over the fields of a row, some of them replaced."""
    return F.sha2(F.concat(*(framed(replaced.get(c, F.col(f"`{c}`"))) for c in FIELDS)), 256)


def source_key(source: Column) -> Column:
    """A key that is never null and orders as sources do: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with ``at`` (place within the group, from 0) and ``size`` (rows of the group).

    One range shuffle by group and order; a place is the place in the partition plus what the group has in partitions before.
    Rows that group and order hold equal are spread by a number of their own, so that many copies of a row are no hot range.
    """
    tie = F.monotonically_increasing_id()
    rows = rows.withColumn("_tie", tie)
    sort = [group, *order, "_tie"]
    rows = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows)
    part = F.shiftright("_at", 33).cast("int")
    runs = materialize(rows.groupBy(part.alias("_part"), F.col(group)).agg(F.count("*").alias("_n"), F.min("_at").alias("_first")))
    of_group = Window.partitionBy(group)  # a row per partition that holds any of the group
    runs = runs.withColumn("_before", F.sum("_n").over(of_group.orderBy("_part")) - F.col("_n")).withColumn("size", F.sum("_n").over(of_group))
    rows = rows.withColumn("_part", part).join(runs.drop("_n"), ["_part", group])
    return rows.withColumn("at", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def depth(size: Column) -> Column:
    """Levels above the leaves of a tree of so many leaves: the least d with FAN^d >= size."""
    powers = F.array(*(F.lit(FAN**d).cast("long") for d in range(40) if FAN**d < 1 << 62))
    return F.size(F.filter(powers, lambda p: p < size))


def _chunks(hashes: Column) -> Column:
    """Preimages of a run of nodes: each FAN digests one after the other."""
    last = F.floor((F.size(hashes) - 1) / FAN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(hashes, k * FAN + 1, F.lit(FAN)), ""))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (g, at, hash, left: levels to go, 1 at least) to blocks: g, at, left, p0, p1 ...: preimages level by level, and hash."""
    grouped = nodes.groupBy("g", F.floor(F.col("at") / WIDE).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("held"), F.first("left").alias("left"))
    out = grouped.select("g", F.col("block").alias("at"), "left", F.transform("held", lambda x: x["hash"]).alias("row"))
    for k in range(LEVELS):
        out = out.withColumn(f"p{k}", F.when(F.col("left") > k, _chunks(F.col("row"))))
        out = out.withColumn("row", F.when(F.col("left") > k, F.transform(f"p{k}", lambda x: F.sha2(x, 256))).otherwise(F.col("row")))
    return out.select("g", "at", F.greatest(F.col("left") - LEVELS, F.lit(0)).alias("left"), *(f"p{k}" for k in range(LEVELS)), F.element_at("row", 1).alias("hash"))


def _own_path(at: Column, pre: str) -> Column:
    """Preimages (of the struct column pre of a block), and the slots in them, of the ancestors that a node has within its block."""
    within = F.pmod(at, F.lit(WIDE))
    steps = []
    for k in range(LEVELS):
        slot = F.pmod(F.floor(within / FAN**k), F.lit(FAN)).cast("int")
        steps.append(F.struct(F.get(F.col(f"{pre}.p{k}"), F.floor(within / FAN ** (k + 1)).cast("int")).alias("pre"), slot.alias("slot")))
    return F.filter(F.array(*steps), lambda s: s["pre"].isNotNull()).cast(_PATH)


@dataclass
class Forest:
    """Trees over placed nodes: passes (written tables of blocks, the lowest first) and tops (g, hash: the digest that remains of each tree)."""

    passes: list[DataFrame]
    tops: DataFrame


def grow(nodes: DataFrame) -> Forest:
    """The trees of nodes (g, at, size, hash). Each pass is a written table of a WIDE-th of the rows before it."""
    current = nodes.select("g", "at", "hash", depth(F.col("size")).alias("left"))
    passes, tops = [], current.filter("left = 0").select("g", "hash")
    while not (growing := current.filter("left > 0")).isEmpty():
        current = materialize(_blocks(growing))
        passes.append(current)
        tops = tops.unionByName(current.filter("left = 0").select("g", "hash"))
    return Forest(passes, tops)


def paths(forest: Forest, nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes (g, at, size and others) with path, the preimages of all ancestors, the lowest first, and the node's slot in each, and top.

    above: g, path and top of each tree: how its top goes on, and its digest.
    """
    pre = F.struct(*(f"p{k}" for k in range(LEVELS))).alias("_pre")

    def climbed(rows: DataFrame, is_top: Column, parents: DataFrame | None) -> DataFrame:
        # a tree has one top, so the first join has a row to a key
        out = rows.filter(is_top).join(above, "g")
        if parents is not None:
            blocks = parents.select("g", F.col("at").alias("_block"), pre, F.col("path").alias("_up"), "top")
            met = rows.filter(~is_top).withColumn("_block", F.floor(F.col("at") / WIDE).cast("long")).join(blocks, ["g", "_block"])
            out = out.unionByName(met.withColumn("path", F.concat(_own_path(F.col("at"), "_pre"), "_up")).drop("_block", "_pre", "_up"))
        return out

    parents = None
    for blocks in reversed(forest.passes):
        parents = materialize(climbed(blocks, F.col("left") == 0, parents))
    return climbed(nodes, F.col("size") <= 1, parents)


def siblings(path: Column) -> Column:
    """The digests beside a leaf and its ancestors, level by level and left to right: each preimage without the own slot."""
    rest = lambda s: F.concat(F.substring(s["pre"], F.lit(1), s["slot"] * HEX), F.substring(s["pre"], s["slot"] * HEX + HEX + 1, F.lit(FAN * HEX)))
    return F.array_join(F.transform(path, rest), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf's digest leads to: spliced into its slot of each preimage, and hashed."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.overlay(s["pre"], digest, s["slot"] * HEX + 1, F.lit(HEX)), 256))


@dataclass
class Manifest:
    """proofs: doc_id, g (see source_key), leaf, top (the source's subroot), path and what was asked for besides. root: None of an empty table."""

    proofs: DataFrame
    root: str | None

    def save(self, path: str) -> None:
        """The proofs and the root as tables below path."""
        self.proofs.write.parquet(f"{path}/proofs")
        self.proofs.sparkSession.createDataFrame([(self.root,)], "root string").coalesce(1).write.parquet(f"{path}/root")


def manifest(docs: DataFrame, **more: Column) -> Manifest:
    """The manifest of documents (doc_id, source, lang, n_chars, text); more: further columns of the proofs, as expressions over docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("g"), leaf_digest().alias("leaf"), *(c.alias(n) for n, c in more.items()))
    leaves = placed(rows, "g", ["doc_id", "leaf"])
    sources = grow(leaves.withColumnRenamed("leaf", "hash"))
    subroots = placed(sources.tops.select(F.lit("").alias("all"), F.col("g").alias("source"), "hash"), "all", ["source"]).withColumnRenamed("all", "g")
    table = grow(subroots)
    top = table.tops.first()
    root = top["hash"] if top else None
    whole = docs.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast(_PATH).alias("path"), F.lit(root).alias("top"))
    above = paths(table, subroots, whole).select(F.col("source").alias("g"), "path", F.col("hash").alias("top"))
    return Manifest(paths(sources, leaves, materialize(above)).drop("at", "size"), root)


def changed(docs: DataFrame, kept: Manifest) -> DataFrame:
    """doc_id of rows whose leaf no longer folds to the manifest's root, and of rows that the manifest lacks. doc_id must be a key of both."""
    now = docs.select(F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("now"))
    met = now.join(kept.proofs.select("doc_id", "path"), "doc_id", "left")
    return met.filter(F.col("path").isNull() | (folded(F.col("path"), F.col("now")) != F.lit(kept.root))).select("doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with the proofs of every second one (by crc32 of its doc_id) checked against a text without line ends."""
    docs = read_table(spark, sf_dir, "documents")
    asked = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    made = manifest(docs, seen=F.when(asked, leaf_digest(text=F.replace(F.col("text"), F.lit("\n"), F.lit("")))))
    root, to = F.lit(made.root), folded(F.col("path"), F.coalesce("seen", "leaf"))
    out = made.proofs.select("doc_id", "leaf", F.col("top").alias("subroot"), root.alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), to.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree(name: str, base: str, levels: int) -> str:
    """SQL that adds the lists h1, h2 ... of a tree's levels to base, whose h0 is the list of its leaves."""
    out, before = [], base
    for k in range(levels):
        out.append(f"{name}{k + 1} AS (SELECT *, CASE WHEN len(h{k}) > 1 THEN list_transform(range(0, len(h{k}), 3), lambda i: sha256(array_to_string(h{k}[i + 1:i + 3], ''))) ELSE h{k} END AS h{k + 1} FROM {before})")
        before = f"{name}{k + 1}"
    return ",\n".join(out)


def _climb(name: str, base: str, levels: int) -> str:
    """SQL that takes sib, fold and pos of each row of base up the lists h0, h1 ... level by level."""
    out, before = [], base
    for k in range(levels):
        left, right = f"array_to_string(h{k}[pos // 3 * 3 + 1:pos], '')", f"array_to_string(h{k}[pos + 2:pos // 3 * 3 + 3], '')"
        up = f"CASE WHEN len(h{k}) > 1 THEN sha256({left} || fold || {right}) ELSE fold END"
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (sib, fold, pos), CASE WHEN len(h{k}) > 1 THEN sib || {left} || {right} ELSE sib END AS sib, {up} AS fold, pos // 3 AS pos FROM {before})")
        before = f"{name}{k + 1}"
    return ",\n".join(out)


def oracle_sql(levels: int = 11, upper: int = 6) -> str:
    """The manifest in SQL, for sources of up to 3^levels rows, and 3^upper sources."""
    cat = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in (*FIELDS[:-1], text)) + ")"
    table = "range(256)"
    for _ in range(8):  # CRC-32 of each byte; 3988292384 is its polynomial
        table = f"list_transform({table}, lambda x: xor(x >> 1, (x & 1) * 3988292384))"
    crc = "list_reduce([ord(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')], lambda a, b: xor(a >> 8, crctab[(xor(a, b) & 255)::INT + 1]), 4294967295::BIGINT)"
    return f"""WITH t AS MATERIALIZED (SELECT {table} AS crctab),
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS g, {cat("text")} AS leaf, CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN {cat("replace(text, chr(10), '')")} END AS seen FROM documents, t),
n0 AS (SELECT g, list(leaf ORDER BY doc_id NULLS FIRST, leaf) AS h0 FROM d GROUP BY g),
{_tree("n", "n0", levels)},
m0 AS (SELECT list(h{levels}[1] ORDER BY g) AS h0 FROM n{levels}),
{_tree("m", "m0", upper)},
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
a0 AS (SELECT l.*, n.* EXCLUDE (g), '' AS sib, coalesce(seen, leaf) AS fold FROM l JOIN n{levels} n ON n.g = l.g),
{_climb("a", "a0", levels)},
r AS (SELECT g, h{levels}[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM n{levels}),
b0 AS (SELECT doc_id, leaf, subroot, r.pos, sib, fold, m.* FROM a{levels} a JOIN r ON r.g = a.g, m{upper} m),
{_climb("b", "b0", upper)}
SELECT doc_id, leaf, subroot, h{upper}[1] AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = h{upper}[1] AS verified FROM b{upper}"""


ORACLE = oracle_sql()
