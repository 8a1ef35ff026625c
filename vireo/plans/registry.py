"""Queries of the catalog engine by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import graphs, pixels, scalar, tables
from vireo.operators import catalog, dupes, pool, pull, review, vault
from vireo.operators.components import connected_components
from vireo.plans import adapters
from vireo.plans.store import Table
from vireo.plans.tables import materialize, read_table, scratch_dir
from vireo.sources.files import scannable

THRESHOLD = 12
PAGE_COLUMNS = ("id", "filename", "directory", "rating", "rejected", "quality_score", "filesize")

_IMAGES = """images AS (SELECT d.doc_id AS id, '/vault/' || source || '/' || lang AS directory,
  'img_' || d.doc_id || (['.png', '.JPG', '.jpeg', '.webp', '.bmp', '.txt'])[(d.doc_id % 6)::INT + 1] AS filename, n_chars AS filesize, text AS prompt,
  source AS model, (coalesce(quality, 0) * (d.doc_id % 6))::INT AS rating, (d.doc_id % 7 = 0)::INT AS flag, coalesce(toxic, 0) AS rejected,
  CASE WHEN quality IS NOT NULL THEN (n_chars % 1000) / 10 END AS quality_score, d.doc_id * 60.0::DOUBLE AS file_modified, CASE WHEN quality IS NOT NULL THEN d.doc_id * 1.0::DOUBLE END AS analyzed_at,
  (n_chars % 11 = 0)::INT AS file_corrupt FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_LOW = f"translate(%s, '{scalar.UPPER}', '{scalar.LOWER}')"
_PART = "substr(t, (%s * n // {0} + 1)::INT, ((%s + 1) * n // {0} - %s * n // {0})::INT)"
_HELD = "255 * (length(%s) - length(translate(%s, '{0}', ''))) // greatest(1, length(%s))"


def _sql(pattern: str, value: str, *more: object) -> str:
    return pattern.format(*more).replace("%s", value)


_HASHES = f"""hashes AS (SELECT doc_id AS key, CASE WHEN b >= 9223372036854775808::HUGEINT THEN (b - 18446744073709551616::HUGEINT)::BIGINT ELSE b::BIGINT END AS dh FROM (
  SELECT doc_id, list_sum([CASE WHEN g[(k // 8) * 9 + k % 8 + 2] > g[(k // 8) * 9 + k % 8 + 1] THEN 1::HUGEINT << (63 - k)::INT ELSE 0::HUGEINT END for k in range(0, 64)])::HUGEINT AS b FROM (
    SELECT doc_id, list({_sql(_HELD, "p", adapters.GREY)} ORDER BY i) AS g FROM (
      SELECT doc_id, i, {_sql(_PART, "i", 72)} AS p FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents), range(0, 72) r(i)) GROUP BY doc_id)))"""
_EDGES = f"""{_HASHES}, rep AS (SELECT dh, min(key) AS g FROM hashes GROUP BY dh),
edges AS (SELECT least(x.g, y.g) AS a, greatest(x.g, y.g) AS b, bit_count(xor(x.dh, y.dh))::INT AS d FROM rep x JOIN rep y ON x.g < y.g AND bit_count(xor(x.dh, y.dh)) <= {THRESHOLD}
  UNION ALL SELECT g, key, 0 FROM hashes JOIN rep ON hashes.dh = rep.dh WHERE key <> g)"""
_FAMILIES = f"""{_EDGES}, u AS (SELECT a AS x, b AS y, d FROM edges UNION ALL SELECT b, a, d FROM edges),
r(v, c) AS (SELECT DISTINCT x, x FROM u UNION SELECT u.y, r.c FROM r JOIN u ON u.x = r.v),
roots AS (SELECT v AS key, min(c) AS family_id FROM r GROUP BY v), near AS (SELECT x AS key, min(d) AS min_dist FROM u GROUP BY x),
fam AS (SELECT family_id, roots.key, min_dist FROM roots JOIN near ON roots.key = near.key)"""

LISTING = catalog.CatalogQuery(min_rating=1, max_rating=5, prompt="the", sort="quality_score", limit=50, offset=10)
UNRATED = catalog.CatalogQuery(unrated=True, include_rejected=True, directory="SRC1", sort="filename", direction="asc", limit=500)
QUALITY = catalog.CatalogQuery(min_quality=40, max_quality=90, include_rejected=True, model="src_", sort="no such column", limit=30, offset=5)


def _page(query: catalog.CatalogQuery):
    return lambda spark, d: query.page(adapters.images(spark, d)).select(*PAGE_COLUMNS)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return dupes.pair_edges(materialize(adapters.text_hashes(spark, d)), THRESHOLD, ["dh"])


def _members(spark: SparkSession, d: str) -> DataFrame:
    return dupes.families(_edges(spark, d), THRESHOLD)


def _family_stats(spark: SparkSession, d: str) -> DataFrame:
    return dupes.family_stats(materialize(_members(spark, d)), read_table(spark, d, "documents").count())


def _family_page(spark: SparkSession, d: str) -> DataFrame:
    return dupes.family_page(materialize(_members(spark, d)), page=2, per_page=10)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return adapters.source_files(spark, d)


def _pull_plan(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    manifest = files.filter("doc_id % 10 = 0").select("origin", F.concat(F.lit("/pool/old/"), F.col("doc_id").cast("string")).alias("pool_path"), "sha256")
    plan = pull.pull_plan(files.drop("doc_id"), manifest, "/pool")
    return plan.select("origin", "action", "dest", "exact_dupe_of")


def _changed(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).select(F.col("origin").alias("rel"), F.col("doc_id").cast("double").alias("mtime"), "size")
    cache = files.withColumn("v", F.when(F.col("mtime") % 3 == 0, 1).otherwise(2)).withColumn("size", F.when(F.col("mtime") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return catalog.changed_files(files, cache)


SIDE = 16


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each document as an image of SIDE x SIDE pixels."""
    packed = F.transform(adapters.text_pixels(F.col("text"), SIDE * SIDE), lambda p: (F.shiftleft(p["r"], 16) + F.shiftleft(p["g"], 8) + p["b"]).cast("int"))
    docs = read_table(spark, d, "documents").select("doc_id", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), packed.alias("px"))
    return pixels.metrics(docs, "doc_id")


def _graphs(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as node graphs: each turn is a node, of a kind that follows from its number."""
    t, at = F.col("turn"), F.concat_ws("-", "conv_id", "turn")
    kind = F.element_at(F.array(*map(F.lit, ("CLIPTextEncode", "CheckpointLoaderSimple", "LoraLoader", "KSamplerAdvanced", "a model of mine"))), (t % 5 + 1).cast("int"))
    lists = F.array(F.lit("s"), F.lit(None).cast("string"), at)
    inputs = F.when(t % 5 == 0, F.to_json(F.struct(F.col("text")))).when(t % 5 == 1, F.to_json(F.struct(at.alias("ckpt_name")))).when(t % 5 == 2, F.to_json(F.struct(at.alias("lora_name"))))
    inputs = inputs.when(t % 5 == 3, F.to_json(F.struct(F.col("conv_id").alias("noise_seed")))).otherwise(F.to_json(F.struct(at.alias("unet_name"), lists.alias("seed")), {"ignoreNullFields": "false"}))
    node = F.concat(F.lit('"'), t.cast("string"), F.lit('":{"class_type":"'), kind, F.lit('","inputs":'), inputs, F.lit("}"))
    # the last node of every third graph is no object, and of every seventh has inputs that are none, which spoils the whole
    extra = F.when(F.col("conv_id") % 7 == 0, ',"x":{"class_type":"LoraLoader","inputs":5}').when(F.col("conv_id") % 3 == 0, ',"x":[1]').otherwise("")
    nodes = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", node.alias("n")))), lambda x: x["n"]), ",").alias("body"))
    return nodes.select("conv_id", F.concat(F.lit("{"), "body", extra, F.lit("}")).alias("graph"))


def _graph_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _graphs(spark, d).select("conv_id", graphs.graph_metadata(F.col("graph")).alias("m")).select("conv_id", "m.prompt", "m.model", "m.seed")


def _prompt_longest(spark: SparkSession, d: str) -> DataFrame:
    turns = read_table(spark, d, "conversations")
    return turns.groupBy("conv_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("turn"))).alias("prompt"))


def _review_fold(spark: SparkSession, d: str) -> DataFrame:
    log = read_table(spark, d, "events").select(F.col("user_id").alias("id"), review.rating_of(F.col("value")).alias("rating"), "ts", "event_id")
    return review.fold(log, "id", "rating", "ts", "event_id")


def _session_fold(spark: SparkSession, d: str) -> DataFrame:
    log = read_table(spark, d, "events").select(F.col("event_type").alias("key"), F.coalesce("props", F.lit("")).alias("value"), "ts", "event_id")
    return review.fold(log, "key", "value", "ts", "event_id")


def _move_rated(spark: SparkSession, d: str) -> DataFrame:
    # names of which some are others with a number: f3.png, f3_1.png
    name = F.concat(F.lit("f"), (F.col("id") % 40).cast("string"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("_"), (F.col("id") % 2 + 1).cast("string"))).otherwise(""), F.lit(".png"))
    return review.move_rated_plan(adapters.images(spark, d).withColumn("filename", name), "/dest").select("id", "origin", "dest")


def _resolve(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).select(F.concat_ws("/", "source", F.col("rel")).alias("rel"), "doc_id")
    keep = files.filter("doc_id % 4 = 0").select("rel")
    return review.resolve_plan(files, keep, "/pool", "/pool_curated").select("rel", "action", "dest")


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a file; the size of some couldn't be read."""
    return adapters.images(spark, d).select("id", "filepath", F.when(F.col("id") % 13 != 0, F.col("filesize")).alias("size"))


def _indexed(spark: SparkSession, d: str, force: bool) -> DataFrame:
    return catalog.index_plan(_listing(spark, d), adapters.images(spark, d).filter("id % 4 <> 1"), force)


def _new_ids(spark: SparkSession, d: str) -> DataFrame:
    fresh = catalog.new_files(_listing(spark, d).select("filepath"), adapters.images(spark, d).filter("id % 4 <> 1"))
    return catalog.with_ids(fresh, 1_000_000)


def _status(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return pool.pool_status(files.filter("doc_id % 10 <> 0"), files.filter("doc_id % 10 = 0"), adapters.text_hashes(spark, d), None)


def _family_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Members of families with the catalog's row at their path; some paths aren't in the catalog."""
    images = adapters.images(spark, d)
    members = materialize(_members(spark, d))
    paths = images.select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("/gone"), F.col("filepath"))).otherwise(F.col("filepath")).alias("filepath"))
    return dupes.with_catalog(members.join(paths, "key"), images).select("family_id", "key", "filepath", "id", "quality_score")


def _state(spark: SparkSession, d: str) -> DataFrame:
    """The catalog under the last rating and flag of each image in the log."""
    log = read_table(spark, d, "events").select(F.col("user_id").alias("id"), review.rating_of(F.col("value")).alias("rating"), review.flag_of(F.col("event_type") == "click").alias("flag"), "ts", "event_id")
    state = log.groupBy("id").agg(*(F.max_by(c, F.struct("ts", "event_id")).alias(c) for c in ("rating", "flag")))
    return review.apply_state(adapters.images(spark, d), state).select("id", "rating", "flag", "rejected")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """The catalog with scores from a side table of metrics."""
    scores = _grid(spark, d).filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("contrast").alias("quality_score"))
    return catalog.merge_metrics(adapters.images(spark, d), scores).select("id", "quality_score")


def _synced(spark: SparkSession, d: str) -> DataFrame:
    """The catalog after a plan of which some rows failed."""
    images = adapters.images(spark, d)
    k = F.col("id") % 5
    done = images.filter(k < 3).select(F.col("filepath").alias("origin"), F.concat(F.lit("/new/"), "filename").alias("dest"), F.when(k == 0, "keep").when(k == 1, "trash").otherwise("move").alias("action"), (F.col("id") % 7 != 0).alias("ok"))
    return review.synced_catalog(images, done).select("id", "filepath", "filename", "directory")


def _pruned(spark: SparkSession, d: str) -> DataFrame:
    """Cached hashes of files that are still listed, less those that were resolved."""
    hashes = adapters.text_hashes(spark, d).select(F.col("key").alias("rel"), "dh")
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("rel"))
    return dupes.pruned_hashes(dupes.live_hashes(hashes, docs.filter("rel % 3 <> 0")), docs.filter("rel % 5 = 0"))


def _asked(spark: SparkSession, d: str, n: int, less: int) -> DataFrame:
    """A whole number from -less on for each document."""
    return read_table(spark, d, "documents").select("doc_id", (F.col("n_chars") % n - less).cast("int").alias("asked"))


def _page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """The listing's page and the number of all rows that match, of one scan."""
    return LISTING.answer_rows(adapters.images(spark, d)).select("place", F.get_json_object("row", "$.filename").alias("filename"), "total")


def _families_in_steps(spark: SparkSession, d: str) -> DataFrame:
    """Families over two thirds of the documents, and then over what the rest adds to their edges and components."""
    hashes = materialize(adapters.text_hashes(spark, d))
    known, fresh = hashes.filter("key % 3 <> 0"), hashes.filter("key % 3 = 0")
    edges = materialize(dupes.pair_edges(known, THRESHOLD, ["dh"]))
    links = materialize(dupes.new_edges(fresh, known, THRESHOLD, ["dh"]))
    roots = dupes.merged_roots(materialize(connected_components(edges)), links)
    return dupes.members_of(roots, edges.unionByName(links))


def _families_function(spark: SparkSession, d: str) -> DataFrame:
    return tables.all_families(materialize(_edges(spark, d)), THRESHOLD)


def _compacted(spark: SparkSession, d: str) -> DataFrame:
    """Ratings as an append-only log of three writes, of which the first two are compacted: base and log give the last rating of each image."""
    log = read_table(spark, d, "events").select(F.col("user_id").alias("id"), review.rating_of(F.col("value")).alias("rating"), "ts", "event_id")
    table = Table(spark, scratch_dir(spark), log.schema)
    fold = lambda rows: rows.groupBy("id").agg(F.max_by(F.struct("rating", "ts", "event_id"), F.struct("ts", "event_id")).alias("e")).select("id", "e.*")
    for part in (0, 1):
        table.append(log.filter(F.col("event_id") % 3 == part))
    table.compact(fold)
    table.append(log.filter("event_id % 3 = 2"))
    return fold(table.read()).select("id", "rating")


def _path_lookup(spark: SparkSession, d: str) -> DataFrame:
    """An image by its path from a table laid out for that: ranged by path, with Bloom filters."""
    rows = adapters.images(spark, d).select(*PAGE_COLUMNS, "filepath")
    table = Table(spark, scratch_dir(spark), rows.schema, vault.by_path_layout, vault.LOOKUP_OPTIONS)
    table.replace(rows)
    return catalog.by_path(table.read(), "/vault/src2/en/img_2.jpeg").select(*PAGE_COLUMNS)


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Of each new document the others with its hash."""
    hashes = adapters.text_hashes(spark, d)
    return dupes.perceptual_matches(hashes.filter("key % 4 = 0"), hashes.filter("key % 4 <> 0"), ["dh"]).select("key", F.array_join(F.transform("matches", lambda k: k.cast("string")), ",").alias("matches"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """What a plan of which some moves failed adds to the manifest."""
    plan = _pull_plan(spark, d).withColumn("sha256", F.sha2("origin", 256)).withColumn("size", F.length("origin").cast("long")).withColumn("ok", ~F.col("origin").endswith("7"))
    return pull.manifest_rows(plan, 5.0)


QUERIES = {
    "catalog_page": _page(LISTING),
    "catalog_total": lambda s, d: LISTING.total(adapters.images(s, d)),
    "unrated_page": _page(UNRATED),
    "quality_page": _page(QUALITY),
    "scan_extension_filter": lambda s, d: adapters.images(s, d).withColumn("rel", F.concat_ws("/", F.when(F.col("id") % 9 == 0, ".trash").otherwise("_in"), "filename")).filter(scannable(F.col("rel"))).select("id", "rel"),
    "image_by_id": lambda s, d: catalog.by_id(adapters.images(s, d), 42).select(*PAGE_COLUMNS),
    "image_by_path": lambda s, d: catalog.by_path(adapters.images(s, d), "/vault/src2/en/img_2.jpeg").select(*PAGE_COLUMNS),
    "work_list": lambda s, d: catalog.work_list(adapters.images(s, d)),
    "top_scores": lambda s, d: catalog.top_scores(adapters.images(s, d)).select("filename", "quality_score"),
    "vault_stats": lambda s, d: catalog.vault_stats(adapters.images(s, d)),
    "distinct_models": lambda s, d: catalog.distinct_models(adapters.images(s, d)),
    "distinct_directories": lambda s, d: catalog.distinct_directories(adapters.images(s, d)),
    "threshold_map": lambda s, d: _asked(s, d, 121, 10).select("doc_id", F.col("asked").alias("confidence"), scalar.threshold_for_confidence(F.col("asked")).alias("threshold")),
    "confidence_map": lambda s, d: _asked(s, d, 41, 0).select("doc_id", F.col("asked").alias("threshold"), scalar.confidence_for_threshold(F.col("asked")).alias("confidence")),
    "text_dhash": lambda s, d: adapters.text_hashes(s, d),
    "vec_phash": lambda s, d: adapters.vector_hashes(s, d),
    "text_phash": lambda s, d: read_table(s, d, "documents").select(F.col("doc_id").alias("key"), pixels.phash_grid(adapters.text_grid(F.col("text"), pixels.GRID * pixels.GRID)).alias("ph")),
    "pair_edges": _edges,
    "families": _members,
    "family_stats": _family_stats,
    "family_members_page": _family_page,
    "perceptual_exact": lambda s, d: dupes.perceptual_exact(adapters.text_hashes(s, d), ["dh"]),
    "exact_dupes": lambda s, d: pull.exact_dupes(_files(s, d)),
    "pull_plan": _pull_plan,
    "changed_files": _changed,
    "review_fold": _review_fold,
    "session_fold": _session_fold,
    "move_rated_plan": _move_rated,
    "resolve_plan": _resolve,
    "without_rejected": lambda s, d: review.without_rejected(adapters.images(s, d)).select("id", "filename"),
    "metrics_signal": _grid,
    "quality_score": lambda s, d: _grid(s, d).select("doc_id", scalar.quality_score(F.col("sharpness"), F.col("contrast"), F.col("entropy"), F.col("saturation"), F.col("doc_id") % 10 == 0).alias("score")),
    "prompt_longest": _prompt_longest,
    "graph_metadata": _graph_metadata,
    "index_plan": lambda s, d: _indexed(s, d, False).select("filepath", "action"),
    "index_counts": lambda s, d: catalog.index_counts(_indexed(s, d, False)).unionAll(catalog.index_counts(_indexed(s, d, True))),
    "new_ids": _new_ids,
    "pool_status": _status,
    "family_page_info": lambda s, d: dupes.family_page_info(_members(s, d), page=10_000, per_page=7),
    "family_catalog": _family_catalog,
    "review_state": _state,
    "metrics_merge": _measured,
    "synced_catalog": _synced,
    "pruned_hashes": _pruned,
    "manifest_rows": _manifest,
    "pasted_paths": lambda s, d: adapters.images(s, d).select("id", scalar.pasted_path(F.concat(F.lit("  '"), "filepath", F.lit("\" "))).alias("path"), scalar.curated_dir(F.concat("directory", F.lit("/"))).alias("curated")),
    "page_with_total": _page_with_total,
    "families_in_steps": _families_in_steps,
    "families_function": _families_function,
    "review_compacted": _compacted,
    "path_lookup": _path_lookup,
    "perceptual_matches": _matches,
    "keys": lambda s, d: adapters.images(s, d).select("id", scalar.thumbnail_key(F.col("filepath")).alias("thumb_key"), scalar.vault_key(F.col("directory")).alias("vault_key")),
}

_COLS = ", ".join(PAGE_COLUMNS)
_GRID = f"""s AS (SELECT doc_id, k, {_sql(_PART, "k", 256)} AS p FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents), range(0, 256) r(k)),
p AS (SELECT doc_id, k // 16 AS y, k % 16 AS x, k, {", ".join(f"{_sql(_HELD, 'p', letters)} AS {name}" for name, letters in zip("rgb", adapters.COLOURS))} FROM s),
l AS (SELECT doc_id, list(r + g + b ORDER BY k) AS m FROM p GROUP BY doc_id),
px AS (SELECT p.*, r + g + b AS v, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS spread, m[greatest(y - 1, 0) * 16 + x + 1] + m[least(y + 1, 15) * 16 + x + 1] + m[y * 16 + greatest(x - 1, 0) + 1] + m[y * 16 + least(x + 1, 15) + 1] - 4 * (r + g + b) AS lap FROM p JOIN l ON l.doc_id = p.doc_id),
b AS (SELECT doc_id, round((256 * sum(lap * lap) - sum(lap) * sum(lap)) / (9 * 65536), 1) AS sharpness, round(sum(v) / (3 * 256) / 255, 3) AS brightness, round(sqrt((256 * sum(v * v) - sum(v) * sum(v)) / (9 * 65536)) / 128, 3) AS contrast,
  CASE WHEN max(spread) < 10 THEN 0.0::DOUBLE ELSE round(sum(spread / (top + 1e-8) ORDER BY k) / 256, 3) END AS saturation, (max(spread) < 10)::INT AS is_grayscale, (sum(r) // 256)::INT AS mean_r, (sum(g) // 256)::INT AS mean_g, (sum(b) // 256)::INT AS mean_b,
  count(DISTINCT r // 16 * 256 + g // 16 * 16 + b // 16)::INT AS unique_colors FROM px GROUP BY doc_id),
h AS (SELECT doc_id, least(63, floor(v / (3 * 255) * 64)) AS bin, count(*) / (256 + 1e-8) AS q FROM px GROUP BY doc_id, bin),
e AS (SELECT doc_id, round(-sum(q * log2(q + 1e-8)) / 6, 3) AS entropy FROM h GROUP BY doc_id),
metrics AS (SELECT b.*, entropy FROM b JOIN e ON b.doc_id = e.doc_id)"""
_SRC = """files AS (SELECT '/src/' || source || '/' || lpad(doc_id::VARCHAR, 9, '0') AS origin, source, lang || '/f' || (doc_id % 50) || '.png' AS rel, sha256(text) AS sha256, n_chars AS size, doc_id FROM documents)"""

ORACLE_SQL = {
    "catalog_page": f"WITH {_IMAGES} SELECT {_COLS} FROM images WHERE rejected = 0 AND rating >= 1 AND rating <= 5 AND {_LOW % 'prompt'} LIKE '%the%' ORDER BY quality_score DESC NULLS LAST, id LIMIT 50 OFFSET 10",
    "catalog_total": f"WITH {_IMAGES} SELECT count(*) AS total FROM images WHERE rejected = 0 AND rating >= 1 AND rating <= 5 AND {_LOW % 'prompt'} LIKE '%the%'",
    "unrated_page": f"WITH {_IMAGES} SELECT {_COLS} FROM images WHERE rating = 0 AND rejected = 0 AND {_LOW % 'directory'} LIKE '%src1%' ORDER BY filename ASC, id LIMIT 200",
    "quality_page": f"WITH {_IMAGES} SELECT {_COLS} FROM images WHERE quality_score >= 40 AND quality_score <= 90 AND {_LOW % 'model'} LIKE '%src_%' ORDER BY file_modified DESC, id LIMIT 30 OFFSET 5",
    "scan_extension_filter": f"WITH {_IMAGES} SELECT id, '_in/' || filename AS rel FROM images WHERE id % 9 <> 0 AND id % 6 <> 5",
    "image_by_id": f"WITH {_IMAGES} SELECT {_COLS} FROM images WHERE id = 42",
    "image_by_path": f"WITH {_IMAGES} SELECT {_COLS} FROM images WHERE directory || '/' || filename = '/vault/src2/en/img_2.jpeg'",
    "work_list": f"WITH {_IMAGES} SELECT id, directory || '/' || filename AS filepath FROM images WHERE analyzed_at IS NULL AND file_corrupt = 0",
    "top_scores": f"WITH {_IMAGES} SELECT filename, quality_score FROM images WHERE quality_score IS NOT NULL ORDER BY quality_score DESC, filename LIMIT 20",
    "vault_stats": f"WITH {_IMAGES} SELECT count(*) AS total, count(*) FILTER (rating > 0) AS rated, count(*) FILTER (rejected = 1) AS rejected, count(*) FILTER (flag = 1) AS flagged, count(*) FILTER (rating = 0 AND rejected = 0) AS unrated FROM images",
    "distinct_models": f"WITH {_IMAGES} SELECT DISTINCT model FROM images WHERE model <> ''",
    "distinct_directories": f"WITH {_IMAGES} SELECT DISTINCT directory FROM images",
    "threshold_map": "SELECT doc_id, i::INT AS confidence, round((100 - greatest(0, least(100, i))) * 0.4::DOUBLE)::INT AS threshold FROM (SELECT doc_id, n_chars % 121 - 10 AS i FROM documents)",
    "confidence_map": "SELECT doc_id, i::INT AS threshold, trunc(100 - i / 0.4::DOUBLE)::INT AS confidence FROM (SELECT doc_id, n_chars % 41 AS i FROM documents)",
    "text_dhash": f"WITH {_HASHES} SELECT key, dh FROM hashes",
    "vec_phash": """WITH v AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings), m AS (SELECT vec_id, e, list_sort(e) AS s FROM v),
b AS (SELECT vec_id, list_sum([CASE WHEN e[k + 1] > (s[32] + s[33]) / 2 THEN 1::HUGEINT << (63 - k)::INT ELSE 0::HUGEINT END for k in range(0, 64)])::HUGEINT AS b FROM m)
SELECT vec_id, CASE WHEN b >= 9223372036854775808::HUGEINT THEN (b - 18446744073709551616::HUGEINT)::BIGINT ELSE b::BIGINT END AS ph FROM b""",
    # whole numbers below 2^53, so that sums of doubles are exact
    "text_phash": f"""WITH c AS (SELECT {pixels.cosines()}::DOUBLE[][] AS cos),
g AS (SELECT doc_id, list({_sql(_HELD, "p", adapters.GREY)} ORDER BY i)::DOUBLE[] AS g FROM (
  SELECT doc_id, i, {_sql(_PART, "i", 1024)} AS p FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents), range(0, 1024) r(i)) GROUP BY doc_id),
l AS (SELECT doc_id, cos, [[list_inner_product(g[y * 32 + 1:y * 32 + 32], cos[v + 1]) for y in range(0, 32)] for v in range(0, 8)] AS l FROM g, c),
f AS (SELECT doc_id, flatten([[list_inner_product(l[v + 1], cos[u + 1]) for v in range(0, 8)] for u in range(0, 8)]) AS f FROM l), o AS (SELECT *, list_sort(f) AS o FROM f),
b AS (SELECT doc_id, list_sum([CASE WHEN 2 * f[k + 1] > o[32] + o[33] THEN 1::HUGEINT << (63 - k)::INT ELSE 0::HUGEINT END for k in range(0, 64)])::HUGEINT AS b FROM o)
SELECT doc_id AS key, CASE WHEN b >= 9223372036854775808::HUGEINT THEN (b - 18446744073709551616::HUGEINT)::BIGINT ELSE b::BIGINT END AS ph FROM b""",
    "pair_edges": f"WITH {_EDGES} SELECT a, b, d FROM edges",
    "families": f"WITH RECURSIVE {_FAMILIES} SELECT family_id, key, min_dist FROM fam",
    "family_stats": f"WITH RECURSIVE {_FAMILIES}, s AS (SELECT family_id, count(*) AS size FROM fam GROUP BY family_id) SELECT count(*) AS families, coalesce(sum(size), 0)::BIGINT AS images_in_families, coalesce(max(size), 0) AS max_family_size, (SELECT count(*) FROM documents) - coalesce(sum(size), 0)::BIGINT AS isolated FROM s",
    "family_members_page": f"WITH RECURSIVE {_FAMILIES}, s AS (SELECT family_id, count(*) AS size FROM fam GROUP BY family_id), t AS (SELECT * FROM s ORDER BY size DESC, family_id LIMIT 10 OFFSET 10), q AS (SELECT *, row_number() OVER (ORDER BY size DESC, family_id)::INT AS position FROM t) SELECT position, q.family_id, size, key, min_dist FROM fam JOIN q ON q.family_id = fam.family_id",
    "perceptual_exact": f"WITH {_HASHES} SELECT dh, min(key) AS first_key, count(*) AS size FROM hashes GROUP BY dh HAVING count(*) > 1",
    "exact_dupes": f"WITH {_SRC}, f AS (SELECT sha256, min(origin) AS exact_dupe_of FROM files GROUP BY sha256 HAVING count(*) > 1) SELECT origin, files.sha256, exact_dupe_of FROM files JOIN f ON f.sha256 = files.sha256 WHERE origin <> exact_dupe_of",
    "pull_plan": f"""WITH {_SRC}, known AS (SELECT origin, sha256, '/pool/old/' || doc_id AS pool_path FROM files WHERE doc_id % 10 = 0), held AS (SELECT sha256, min(pool_path) AS pool FROM known GROUP BY sha256),
r AS (SELECT f.*, k.origin IS NOT NULL AS already, pool FROM files f LEFT JOIN known k ON k.origin = f.origin LEFT JOIN held h ON h.sha256 = f.sha256),
w AS (SELECT *, min(CASE WHEN NOT already AND pool IS NULL THEN origin END) OVER (PARTITION BY sha256) AS first FROM r),
a AS (SELECT *, CASE WHEN already THEN 'already' WHEN pool IS NOT NULL OR first <> origin THEN 'exact_dupe' ELSE 'move' END AS action FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY action, source, rel ORDER BY origin) - 1 AS k FROM a)
SELECT origin, action, CASE WHEN action = 'move' THEN '/pool/' || source || '/' || CASE WHEN k = 0 THEN rel ELSE replace(rel, '.png', '') || '_' || k || '.png' END END AS dest, CASE WHEN action = 'exact_dupe' THEN coalesce(pool, first) END AS exact_dupe_of FROM n""",
    "changed_files": f"WITH {_SRC} SELECT origin AS rel, doc_id::DOUBLE AS mtime, size FROM files WHERE doc_id % 3 = 0 OR doc_id % 5 = 0",
    "review_fold": "SELECT user_id AS id, arg_max(greatest(0, least(5, trunc(value)::INT)), (ts, event_id)) AS rating FROM events GROUP BY user_id",
    "session_fold": "SELECT event_type AS key, arg_max(coalesce(props, ''), (ts, event_id)) AS value FROM events GROUP BY event_type",
    # name after name: the first of the name itself and its numbered forms that is neither given away nor another row's own name
    "move_rated_plan": f"""WITH RECURSIVE {_IMAGES}, p AS (SELECT id, directory || '/' || filename AS origin, '/dest/r' || rating || '_f' || (id % 40) || CASE WHEN id % 3 = 0 THEN '_' || (id % 2 + 1) ELSE '' END AS stem FROM images WHERE rating >= 1),
o AS (SELECT *, row_number() OVER (ORDER BY origin) AS n, (SELECT list(DISTINCT stem) FROM p) AS own FROM p),
w(n, id, origin, dest, used) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[] UNION ALL
  SELECT o.n, o.id, o.origin, c.dest, list_append(w.used, c.dest) FROM w JOIN o ON o.n = w.n + 1, LATERAL (SELECT CASE WHEN NOT list_contains(w.used, o.stem) THEN o.stem ELSE
    (SELECT o.stem || '_' || min(i) FROM range(1, 2000) r(i) WHERE NOT list_contains(w.used, o.stem || '_' || i) AND NOT list_contains(o.own, o.stem || '_' || i)) END AS dest) c)
SELECT id, origin, dest || '.png' AS dest FROM w WHERE n > 0""",
    "resolve_plan": f"""WITH {_SRC}, f AS (SELECT source || '/' || rel AS rel, bool_or(doc_id % 4 = 0) AS keep, max(source || '/' || split_part(rel, '/', 1)) AS folder, max(split_part(rel, '/', 2)) AS name FROM files GROUP BY 1),
g AS (SELECT *, CASE WHEN keep THEN '/pool_curated/' || folder ELSE '/pool/.dupe-trash' END AS target FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY target, name ORDER BY rel) - 1 AS k FROM g)
SELECT rel, CASE WHEN keep THEN 'keep' ELSE 'trash' END AS action, target || '/' || CASE WHEN k = 0 THEN name ELSE replace(name, '.png', '') || '_' || k || '.png' END AS dest FROM n""",
    "without_rejected": f"WITH {_IMAGES} SELECT id, filename FROM images WHERE rejected = 0",
    "metrics_signal": f"WITH {_GRID} SELECT * FROM metrics",
    "quality_score": f"WITH {_GRID} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0.0 ELSE round((least(1.0::DOUBLE, log10(greatest(1.0::DOUBLE, sharpness)) / 4.5) * 35 + contrast * 20 + least(1.0::DOUBLE, entropy) * 25 + least(1.0::DOUBLE, saturation * 2) * 20)::VARCHAR::DECIMAL(38, 20), 1)::DOUBLE END AS score FROM metrics",
    "prompt_longest": "SELECT conv_id, arg_max(text, (length(text), -turn)) AS prompt FROM conversations GROUP BY conv_id",
    "keys": f"WITH {_IMAGES} SELECT id, substr(md5(directory || '/' || filename), 1, 12) AS thumb_key, substr(md5(directory), 1, 16) AS vault_key FROM images",
    "graph_metadata": """WITH t AS (SELECT *, conv_id || '-' || turn AS spot FROM conversations),
g AS (SELECT conv_id, arg_max(text, (length(text), -turn)) FILTER (turn % 5 = 0 AND text <> '') AS prompt, arg_max(spot, turn) FILTER (turn % 5 IN (1, 4)) AS main, arg_min(spot, turn) FILTER (turn % 5 = 2) AS lora,
  arg_max(CASE WHEN turn % 5 = 3 THEN conv_id::VARCHAR ELSE 's, , ' || spot END, turn) FILTER (turn % 5 IN (3, 4)) AS seed FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN '' ELSE coalesce(prompt, '') END AS prompt, CASE WHEN conv_id % 7 = 0 THEN '' ELSE coalesce(main, lora, '') END AS model, CASE WHEN conv_id % 7 = 0 THEN '' ELSE coalesce(seed, '') END AS seed FROM g""",
    "index_plan": f"WITH {_IMAGES} SELECT directory || '/' || filename AS filepath, CASE WHEN id % 4 <> 1 THEN 'skipped' WHEN id % 13 = 0 OR filesize IS NULL THEN 'error' ELSE 'new' END AS action FROM images",
    "index_counts": f"""WITH {_IMAGES}, x AS (SELECT id % 4 <> 1 AS known, id % 13 = 0 OR filesize IS NULL AS bad FROM images)
SELECT count(*) FILTER (NOT known AND NOT bad) AS indexed, count(*) FILTER (known) AS skipped, count(*) FILTER (NOT known AND bad) AS errors FROM x UNION ALL SELECT count(*) FILTER (NOT bad), 0, count(*) FILTER (bad) FROM x""",
    "new_ids": f"WITH {_IMAGES} SELECT directory || '/' || filename AS filepath, 999999 + row_number() OVER (ORDER BY directory || '/' || filename) AS id FROM images WHERE id % 4 = 1",
    "pool_status": "SELECT count(*) FILTER (doc_id % 10 <> 0) AS images_on_disk, true AS has_manifest, count(*) FILTER (doc_id % 10 = 0) AS manifest_files, count(*) AS hashed, false AS has_edges FROM documents",
    "family_page_info": f"WITH RECURSIVE {_FAMILIES}, n AS (SELECT count(DISTINCT family_id) AS total FROM fam) SELECT greatest(1, least(10000, (total + 6) // 7)) AS page, 7::BIGINT AS per_page, total AS total_families, greatest(1, (total + 6) // 7) AS total_pages FROM n",
    "family_catalog": f"""WITH RECURSIVE {_FAMILIES}, {_IMAGES}, p AS (SELECT id AS key, CASE WHEN id % 3 = 0 THEN '/gone' ELSE '' END || directory || '/' || filename AS filepath FROM images)
SELECT family_id, fam.key, p.filepath, id, quality_score FROM fam JOIN p ON p.key = fam.key LEFT JOIN images ON directory || '/' || filename = p.filepath""",
    "review_state": f"""WITH {_IMAGES}, s AS (SELECT user_id, arg_max(greatest(0, least(5, trunc(value)::INT)), (ts, event_id)) AS rating, arg_max((event_type = 'click')::INT, (ts, event_id)) AS flag FROM events GROUP BY user_id)
SELECT id, coalesce(s.rating, images.rating) AS rating, coalesce(s.flag, images.flag) AS flag, rejected FROM images LEFT JOIN s ON s.user_id = id""",
    "metrics_merge": f"WITH {_IMAGES}, {_GRID} SELECT id, coalesce(contrast, quality_score) AS quality_score FROM images LEFT JOIN metrics ON metrics.doc_id = id AND id % 2 = 0",
    "synced_catalog": f"""WITH {_IMAGES}, x AS (SELECT *, id % 5 < 3 AND id % 7 <> 0 AS ok FROM images)
SELECT id, CASE WHEN ok THEN '/new/' || filename ELSE directory || '/' || filename END AS filepath, filename, CASE WHEN ok THEN '/new' ELSE directory END AS directory FROM x WHERE NOT (ok AND id % 5 = 1)""",
    "pruned_hashes": f"WITH {_HASHES} SELECT key AS rel, dh FROM hashes WHERE key % 3 <> 0 AND key % 5 <> 0",
    "pasted_paths": f"WITH {_IMAGES} SELECT id, directory || '/' || filename AS path, directory || '_curated' AS curated FROM images",
}
ORACLE_SQL["families_in_steps"] = ORACLE_SQL["families_function"] = ORACLE_SQL["families"]
ORACLE_SQL["review_compacted"] = ORACLE_SQL["review_fold"]
ORACLE_SQL["path_lookup"] = ORACLE_SQL["image_by_path"]
ORACLE_SQL["page_with_total"] = f"""WITH p AS ({ORACLE_SQL["catalog_page"]}), t AS ({ORACLE_SQL["catalog_total"]})
SELECT (row_number() OVER (ORDER BY quality_score DESC NULLS LAST, id) - 1)::INT AS place, filename, total FROM t LEFT JOIN p ON true"""
ORACLE_SQL["perceptual_matches"] = f"""WITH {_HASHES} SELECT x.key, string_agg(y.key::VARCHAR, ',' ORDER BY y.key) AS matches FROM hashes x JOIN hashes y ON x.dh = y.dh AND x.key <> y.key
WHERE x.key % 4 = 0 GROUP BY x.key"""
ORACLE_SQL["manifest_rows"] = f"""WITH plan AS ({ORACLE_SQL["pull_plan"]})
SELECT CASE WHEN action = 'move' THEN 'moved' ELSE 'dupe' END AS kind, origin, dest AS pool_path, exact_dupe_of, sha256(origin) AS sha256, length(origin)::BIGINT AS size, 5.0::DOUBLE AS at FROM plan
WHERE action = 'exact_dupe' OR (action = 'move' AND NOT ends_with(origin, '7'))"""
