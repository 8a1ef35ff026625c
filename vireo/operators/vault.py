"""A vault: the catalog of a tree of images and what becomes of it, as tables that change by whole steps (see plans.store).

images holds a row for each file (ids never change or come back), log the review events that were given by hand, metrics what was
measured. What a user sees is images under the folded log and the metrics; compaction makes it the base of images. Nothing is
updated in place, and no step needs more of the driver than its size in rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.operators import catalog, review
from vireo.plans import schema
from vireo.plans.store import Table
from vireo.plans.tables import materialize
from vireo.sources.files import with_content

#: Parquet settings under which a look-up by path or id reads few row groups: Bloom filters, and page and group statistics over sorted paths.
LOOKUP_OPTIONS = {"parquet.bloom.filter.enabled#filepath": "true", "parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
REVIEWED = {"rating": "int", "flag": "int", "rejected": "int", "tags": "string", "notes": "string"}


def by_path_layout(rows: DataFrame) -> DataFrame:
    """Rows ranged and sorted by path: a path is in one file, and in one row group of it."""
    return rows.repartitionByRange("filepath").sortWithinPartitions("filepath")


class Vault:
    """The tables below path. Made with the first use; the schema is that of plans.schema.IMAGES."""

    def __init__(self, spark: SparkSession, path: str, options: Mapping[str, str] | None = None) -> None:
        self.spark = spark
        self.images = Table(spark, f"{path}/images", schema.IMAGES, by_path_layout, {**LOOKUP_OPTIONS, **(options or {})})
        self.log = Table(spark, f"{path}/log", schema.REVIEW_LOG)
        self.metrics = Table(spark, f"{path}/metrics", schema.IMAGES_METRICS)
        for table in (self.images, self.log, self.metrics):
            table.create()

    # what there is

    def catalog(self) -> DataFrame:
        """The images as they are now."""
        out = review.apply_state(self.images.read(), self.state())
        return catalog.merge_metrics(out, self._last_metrics())

    def state(self) -> DataFrame:
        """id and rating, flag, rejected, tags and notes as last given (null: never given)."""
        order = F.struct("at", "batch")  # of events of one moment the later write counts
        last = lambda c, t: F.max_by(F.when(F.col("field") == c, F.col("value")), F.when(F.col("field") == c, order)).cast(t).alias(c)
        return self.log.changes().groupBy("id").agg(*(last(c, t) for c, t in REVIEWED.items()))

    def _last_metrics(self) -> DataFrame:
        rows = self.metrics.changes()
        held = F.struct(*(c for c in rows.columns if c not in ("id", "batch")))
        return rows.groupBy("id").agg(F.max_by(held, F.struct("analyzed_at", "batch")).alias("m")).select("id", "m.*")

    def by_path(self, path: str) -> DataFrame:
        return catalog.by_path(self.images.read(), path)

    def full_images(self, ids: DataFrame) -> DataFrame:
        """id, filepath and content of images by id (column id): null content where the file is gone, null filepath too where there is no such image."""
        asked = ids.select("id").distinct()
        found = with_content(asked.join(self.images.read().select("id", "filepath"), "id")).select("id", "filepath", "content")
        return asked.join(found, "id", "left")

    # changes

    def index(self, listing: DataFrame, read: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
        """Take in the files of listing (filepath, size, mtime, ctime) that the catalog lacks; indexed, skipped and errors.

        read: adds what is read from the files (width, height, prompt, workflow, model, seed), asked for new ones only.
        """
        plan = materialize(catalog.index_plan(listing, self.images.read()))
        fresh = plan.filter("action = 'new'")
        first = self.images.notes().get("next_id", 1)
        rows = catalog.with_ids(read(fresh) if read else fresh, first)
        name, folder = F.element_at(F.split("filepath", "/"), -1), F.regexp_replace("filepath", "/[^/]*$", "")
        known = {"filename": name, "directory": folder, "filesize": F.col("size"), "file_modified": F.col("mtime"), "file_created": F.col("ctime"), "indexed_at": F.lit(time.time())}
        known |= {c: F.lit(0) for c in ("rating", "flag", "rejected", "is_grayscale", "file_corrupt")} | {c: F.lit("") for c in ("tags", "notes")}
        given = [c for c in ("width", "height", "prompt", "workflow", "model", "seed") if c in rows.columns]
        row = [known.get(f.name, F.col(f.name) if f.name in ("id", "filepath", *given) else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.IMAGES.fields]
        if n := fresh.count():
            self.images.append(rows.select(*row), next_id=first + n)
        return catalog.index_counts(plan).first().asDict()

    def give(self, events: DataFrame) -> None:
        """Review events: id, field (of REVIEWED), value (text) and at. Ratings are held within 0 to 5 (what is no number is 0), and flags made 0 or 1."""
        value = F.when(F.col("field") == "rating", review.rating_of(F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))).cast("string"))
        value = value.when(F.col("field").isin("flag", "rejected"), review.flag_of(F.col("value")).cast("string")).otherwise(F.coalesce("value", F.lit("")))
        self.log.append(events.filter(F.col("field").isin(*REVIEWED)).select("id", "field", value.alias("value"), "at"))

    def set(self, image_id: int, name: str, value: object) -> None:
        """One event, now. Unknown ids are taken down too, and mean nothing until there is such an image."""
        if name not in REVIEWED:
            raise ValueError(f"{name} isn't reviewed by hand")
        row = (image_id, name, None if value is None else str(value), time.time())
        self.give(self.spark.createDataFrame([row], schema.REVIEW_LOG))

    def measured(self, metrics: DataFrame) -> None:
        """Metrics by id; columns that are missing are null."""
        have = set(metrics.columns)
        row = [(F.col(f.name) if f.name in have else F.lit(time.time() if f.name == "analyzed_at" else None)).cast(f.dataType).alias(f.name) for f in schema.IMAGES_METRICS.fields]
        self.metrics.append(metrics.select(*row))

    def apply(self, done: DataFrame) -> None:
        """Carry the outcome of a plan of moves (origin, dest, action, ok) into the catalog."""
        at = self.images.number()
        self.images.replace(review.synced_catalog(self.images.read(), done), at)

    def drop_rejected(self) -> DataFrame:
        """Take rejected images out of the catalog; their files (id, filepath), for a plan of deletions."""
        at = self.images.number()
        now = materialize(self.catalog())
        self.images.replace(review.without_rejected(now), at)
        return review.rejected_files(now)

    def compact(self) -> None:
        """The catalog as it is becomes the base of images. Log and metrics are forgotten up to what it holds after that: a driver that
        dies between loses nothing, as they say the same again."""
        at, log, metrics = (t.number() for t in (self.images, self.log, self.metrics))
        self.images.replace(self.catalog(), at)
        self.log.forget(log)
        self.metrics.forget(metrics)
