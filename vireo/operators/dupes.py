"""Near-duplicate families over 64-bit perceptual hashes: thresholded Hamming self-join, components, statistics and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vireo.functions.scalar import hamming
from vireo.operators.cells import met_in_cells
from vireo.operators.components import connected_components
from vireo.plans.tables import materialize

MAX_DIST = 40
BANDS = 4
CELL = 400_000  # hashes of a block, where those of alike bands are compared: 16 bytes each, and as much for looking up
BRUTE_ROWS = 20_000  # distinct hashes up to which all pairs are compared on a broadcast side of 1 MB at most (counted first), some 3 ns a pair
SHARE_ROWS = 2_000  # of them that a task compares with all
TILE_ROWS = 20_000  # hashes of a block, where all pairs are compared in blocks


def choose_pair_strategy(distinct: int, threshold: int) -> str:
    """``broadcast`` for hashes few enough to be sent to every task (counted first). Beyond, ``banded`` compares hashes that are alike in
    one band, in cells of two blocks; where a quarter of the bits may differ by more than 3, that is nearly all, and ``tiled`` compares all hashes in blocks."""
    return "broadcast" if distinct <= BRUTE_ROWS else "banded" if threshold // BANDS <= 3 else "tiled"


def _distance(hashes: list[str]) -> Column:
    each = [hamming(F.col(f"x.{h}"), F.col(f"y.{h}")) for h in hashes]
    return F.least(*each) if len(each) > 1 else each[0]


def _tiled(x: DataFrame, y: DataFrame, columns: list[str], threshold: int, tiles: int) -> DataFrame:
    """Pairs of group numbers within threshold bits, by equal joins on pairs of blocks: a task holds one block of each side. Their number is the product of both sides'."""
    block = lambda df: df.withColumn("t", F.pmod(F.xxhash64("g"), F.lit(tiles)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    x, y = block(x).withColumn("u", every).alias("x"), block(y).withColumn("u", every).alias("y")
    meet = (F.col("x.t") == F.col("y.u")) & (F.col("x.u") == F.col("y.t")) & (F.col("x.g") != F.col("y.g"))
    return x.hint("shuffle_hash").join(y, meet & (_distance(columns) <= threshold)).select(F.col("x.g").alias("g"), F.col("y.g").alias("g2"))


def _met(x: DataFrame, y: DataFrame, threshold: int, columns: list[str], strategy: str, tiles: int) -> DataFrame:
    """a < b and d of groups of x and of y (each g and columns; a group may be of both) within threshold."""
    if strategy == "broadcast":
        x, y = x.alias("x"), F.broadcast(y).alias("y")  # BRUTE_ROWS at most, unless a caller asks for it
        pairs = x.join(y, (F.col("x.g") != F.col("y.g")) & (_distance(columns) <= threshold)).select(F.least("x.g", "y.g").alias("a"), F.greatest("x.g", "y.g").alias("b"), _distance(columns).alias("d"))
        return pairs.distinct()
    pairs = _tiled(x, y, columns, threshold, tiles)
    pairs = pairs.select(F.least("g", "g2").alias("g"), F.greatest("g", "g2").alias("g2")).distinct()
    both = x.unionByName(y).dropDuplicates(["g"])
    x, y = both.alias("x"), both.alias("y")
    found = x.join(pairs.alias("p"), F.col("x.g") == F.col("p.g")).join(y, F.col("y.g") == F.col("p.g2")).select(F.col("x.g").alias("a"), F.col("y.g").alias("b"), _distance(columns).alias("d"))
    return found.filter(F.col("d") <= threshold)


def _tiles(n: int) -> int:
    return max(1, -(-n // TILE_ROWS))


def pair_edges(hashes: DataFrame, threshold: int, columns: list[str], strategy: str | None = None) -> DataFrame:
    """a < b and d: links that stand for all pairs of keys within threshold, d being the least distance over the hash columns.

    hashes (read twice: best a written table) has key and the columns. Keys of equal hashes are one group, named by its least
    key. Groups are compared with each other, and each further key of a group is linked with its group's name, at distance 0:
    so a group of n copies costs n - 1 links, not n squared. The cost is the square of the number of distinct hashes, dealt to many
    tasks; up to threshold 15 most pairs are passed over by their bands.
    """
    groups = materialize(hashes.groupBy(*columns).agg(F.min("key").alias("g")))
    distinct = groups.count()
    strategy = strategy or choose_pair_strategy(distinct, threshold)
    if strategy == "broadcast":
        met = _halved(groups.repartition(max(1, distinct // SHARE_ROWS)), groups, threshold, columns)
    elif strategy == "banded":
        met = met_in_cells(groups, None, columns, threshold, distinct, block_rows=CELL)
    else:
        met = _met(groups, groups, threshold, columns, strategy, _tiles(distinct))
    copies = hashes.select("key", *columns).join(groups, columns).filter("key <> g").select(F.col("g").alias("a"), F.col("key").alias("b"), F.lit(0).alias("d"))
    return met.unionAll(copies)


def _halved(x: DataFrame, y: DataFrame, threshold: int, columns: list[str]) -> DataFrame:
    """Pairs of few groups, each looked at once. x and y are the same groups, x dealt to tasks."""
    x, y = x.alias("x"), F.broadcast(y).alias("y")
    return x.join(y, (F.col("x.g") < F.col("y.g")) & (_distance(columns) <= threshold)).select(F.col("x.g").alias("a"), F.col("y.g").alias("b"), _distance(columns).alias("d"))


def new_edges(fresh: DataFrame, known: DataFrame, threshold: int, columns: list[str], strategy: str | None = None) -> DataFrame:
    """Links (a < b, d) that fresh keys add to those of known: with pair_edges(known) they give the families of pair_edges() over both.

    fresh and known: key and the columns, without keys in common. Hashes that known has already are linked with one of its keys, and
    compared no further; only new hashes are compared, with all others. So the cost is that of the new ones.
    """
    held = materialize(known.groupBy(*columns).agg(F.min("key").alias("g")))
    groups = materialize(fresh.groupBy(*columns).agg(F.min("key").alias("g")).join(held.withColumnRenamed("g", "old"), columns, "left"))
    new = groups.filter("old IS NULL").drop("old")
    n = new.count()
    old, new = held.select("g", *columns), new.select("g", *columns)
    strategy = strategy or choose_pair_strategy(n, threshold)
    if strategy == "banded":
        met = met_in_cells(old, new, columns, threshold, held.count(), n, CELL).unionAll(met_in_cells(new, None, columns, threshold, n, block_rows=CELL))
    else:
        met = _met(old.unionByName(new), new, threshold, columns, strategy, _tiles(n) if strategy == "tiled" else 1)
    name = F.coalesce("old", "g")
    copies = fresh.select("key", *columns).join(groups.select(*columns, name.alias("g")), columns).filter("key <> g")
    return met.unionAll(copies.select(F.least("key", "g").alias("a"), F.greatest("key", "g").alias("b"), F.lit(0).alias("d")))


def merged_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node and root of all components after links (a, b) have come to those of roots (node, root: the least node of each).

    Links are put between roots, and only these are joined into components: known nodes are read once, and not searched again.
    """
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    between = materialize(between.filter("a <> b").distinct())
    moved = materialize(connected_components(between).select(F.col("node").alias("_old"), F.col("root").alias("_new")))
    kept = roots.join(moved, roots["root"] == moved["_old"], "left").select("node", F.coalesce("_new", "root").alias("root"))
    single = moved.select(F.col("_old").alias("node"), F.col("_new").alias("root")).join(roots.select("node"), "node", "left_anti")
    return kept.unionByName(single)


def members_of(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """family_id, key and min_dist, as families() has them, from roots and all edges."""
    ends = edges.select(F.col("a").alias("key"), "d").unionAll(edges.select(F.col("b").alias("key"), "d")).groupBy("key").agg(F.min("d").alias("min_dist"))
    return roots.select(F.col("node").alias("key"), F.col("root").alias("family_id")).join(ends, "key").select("family_id", "key", "min_dist")


def perceptual_matches(fresh: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """key and matches: of each fresh key whose hashes another key has too (of known, or of fresh), the sorted list of those keys.

    A list is of one fresh key's copies; where copies are many, take groups by perceptual_exact() instead.
    """
    every = fresh.select("key", *columns).unionByName(known.select("key", *columns)).withColumnRenamed("key", "other")
    return fresh.join(every, columns).filter("key <> other").groupBy("key").agg(F.array_sort(F.collect_set("other")).alias("matches"))


def perceptual_exact(hashes: DataFrame, columns: list[str]) -> DataFrame:
    """Groups of two or more keys with equal hashes, each with its least key."""
    return hashes.groupBy(*columns).agg(F.min("key").alias("first_key"), F.count("*").alias("size")).filter("size > 1")


def families(edges: DataFrame, threshold: int) -> DataFrame:
    """family_id (least key), key and min_dist of every member of a component of two or more, by edges within threshold.

    edges: of pair_edges(). A member's least distance within its family is that over its own edges: copies of it are at 0, and
    all others are met through their group's name.
    """
    near = materialize(edges.filter(F.col("d") <= threshold).select("a", "b", "d"))
    roots = connected_components(near).select(F.col("node").alias("key"), F.col("root").alias("family_id"))
    ends = near.select(F.col("a").alias("key"), "d").unionAll(near.select(F.col("b").alias("key"), "d")).groupBy("key").agg(F.min("d").alias("min_dist"))
    return roots.join(ends, "key").select("family_id", "key", "min_dist")


def family_stats(members: DataFrame, total: int) -> DataFrame:
    sizes = members.groupBy("family_id").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("families"), F.coalesce(F.sum("size"), F.lit(0)).alias("images_in_families"), F.coalesce(F.max("size"), F.lit(0)).alias("max_family_size")).withColumn("isolated", F.lit(total).cast("long") - F.col("images_in_families"))


def family_page(members: DataFrame, page: int = 1, per_page: int = 10) -> DataFrame:
    """Members of a page of families, largest first (ties by family_id); families are never split. The page of families is the only thing that is ranked."""
    per_page = max(1, min(per_page, 50))
    sizes = members.groupBy("family_id").agg(F.count("*").alias("size"))
    pages = max(1, -(-sizes.count() // per_page))
    page = max(1, min(page, pages))
    top = sizes.orderBy(F.desc("size"), "family_id").offset((page - 1) * per_page).limit(per_page)
    ranked = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("size"), "family_id")))  # per_page rows
    return members.join(F.broadcast(ranked), "family_id").select("position", "family_id", "size", "key", "min_dist")


def family_page_info(members: DataFrame, page: int = 1, per_page: int = 10) -> DataFrame:
    """One row: page and per_page as they are applied, total_families and total_pages (1 at least)."""
    total = members.select("family_id").distinct().agg(F.count("*").alias("total_families"))
    size = max(1, min(per_page, 50))
    pages = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total_families") / size))
    return total.select(F.greatest(F.lit(1).cast("long"), F.least(F.lit(page).cast("long"), pages)).alias("page"), F.lit(size).cast("long").alias("per_page"), "total_families", pages.alias("total_pages"))


def with_catalog(page: DataFrame, images: DataFrame) -> DataFrame:
    """Page rows with the id and score of the catalog's image at the member's path (column filepath), null where there is none."""
    return page.join(images.select("filepath", "id", "quality_score"), "filepath", "left")


def live_hashes(hashes: DataFrame, listing: DataFrame) -> DataFrame:
    """Hashes of files that still exist."""
    return hashes.join(listing.select("rel"), "rel", "left_semi")


def pruned_hashes(hashes: DataFrame, gone: DataFrame) -> DataFrame:
    return hashes.join(gone.select("rel"), "rel", "left_anti")
