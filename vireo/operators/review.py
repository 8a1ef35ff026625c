"""Review state as a fold over an append-only log, and plans of file moves. Plans are data; execute() alone touches files, on the driver, once."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from vireo.functions.scalar import clamp, stem, suffix
from vireo.plans.tables import materialize, scratch_dir


def fold(log: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last value of each key by the given order: aggregated before the shuffle."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def rating_of(value: Column) -> Column:
    return clamp(value.cast("int"), 0, 5)


def flag_of(value: Column) -> Column:
    """1 for what is true of a request's value; missing means true."""
    text = F.lower(F.coalesce(value.cast("string"), F.lit("true")))
    return F.when(text.isin("", "0", "false", "null", "none", "0.0"), 0).otherwise(1)


def apply_state(images: DataFrame, state: DataFrame) -> DataFrame:
    """images with rating, flag, rejected, tags and notes from the folded log (columns id and any of these) where it has them."""
    names = [c for c in state.columns if c != "id"]
    joined = images.join(state.select("id", *(F.col(c).alias(f"_s_{c}") for c in names)), "id", "left")
    return joined.select(*(F.coalesce(F.col(f"_s_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in images.columns))


def _numbered(path: Column, k: Column) -> Column:
    return F.concat(stem(path), F.lit("_"), k.cast("string"), suffix(path))


def _numbers(paths: DataFrame) -> DataFrame:
    """Of paths (_full) that are others with a number before the extension: the other path (_full) and the number (_num)."""
    full, cut = F.col("_full"), r"(?s)^(.*)_([1-9][0-9]{0,17})$"
    ways = [F.struct(F.concat(F.regexp_extract(x, cut, 1), y).alias("base"), F.regexp_extract(x, cut, 2).alias("num")) for x, y in ((stem(full), suffix(full)), (full, F.lit("")))]
    found = paths.select("_full", F.explode(F.array(*ways)).alias("w")).filter("w.num <> ''").filter(_numbered(F.col("w.base"), F.col("w.num")) == full)
    return found.select(F.col("w.base").alias("_full"), F.col("w.num").try_cast("long").alias("_num")).distinct()


def uniquified(plan: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """plan (origin, folder, name) with dest: the first taker by origin keeps the name, others get _1, _2, ... before the extension.

    Names present in existing (dest) count as taken first. Numbers whose names exist, or are the plain name of another row, are
    passed over. A suffixed name can meet no other suffixed one, since its last number and the name before it tell it apart;
    so one pass finds what trying number after number would.
    """
    full = F.concat_ws("/", "folder", "name")
    todo = plan.withColumn("_full", full)
    rank = F.row_number().over(Window.partitionBy("_full").orderBy("origin")).cast("long")
    names = todo.select("_full")
    k = rank - 1
    if existing is not None:
        taken = existing.select(F.col("dest").alias("_dest")).distinct()
        todo = todo.join(taken, F.col("_full") == F.col("_dest"), "left")
        k = k + F.col("_dest").isNotNull().cast("long")
        names = names.unionAll(taken)
    todo = todo.withColumn("_k", k).withColumn("_held", F.lit(0)).drop("_dest")
    # the i-th held number (from 0) moves up all from the (number - i)-th on
    place = F.row_number().over(Window.partitionBy("_full").orderBy("_num")) - 1
    held = _numbers(names.distinct()).select("_full", (F.col("_num") - place).alias("_k"), F.lit(1).alias("_held"))
    up = F.sum("_held").over(Window.partitionBy("_full").orderBy("_k", F.desc("_held")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    todo = todo.unionByName(held, allowMissingColumns=True).withColumn("_up", up).filter("_held = 0")
    dest = F.when(F.col("_k") == 0, F.col("_full")).otherwise(_numbered(F.col("_full"), F.col("_k") + F.col("_up")))
    return todo.withColumn("dest", dest).drop("_full", "_k", "_held", "_up")


def move_rated_plan(images: DataFrame, dest: str) -> DataFrame:
    """Where rated images go: r<rating>_<filename>, made unique. filepath, filename and directory all follow."""
    rated = images.filter("rating >= 1").select("id", F.col("filepath").alias("origin"), F.lit(dest).alias("folder"), F.concat(F.lit("r"), F.col("rating").cast("string"), F.lit("_"), F.col("filename")).alias("name"))
    return uniquified(rated)


def without_rejected(images: DataFrame) -> DataFrame:
    return images.filter("rejected = 0")


def rejected_files(images: DataFrame) -> DataFrame:
    return images.filter("rejected = 1").select("id", "filepath")


def resolve_plan(members: DataFrame, keep: DataFrame, pool: str, curated: str, delete: bool = False) -> DataFrame:
    """members: rel; keep: rel of those to keep. Keepers go to the curated folder under their relative path, others to a flat .dupe-trash (or are deleted)."""
    marked = members.select("rel").distinct().join(keep.select("rel").distinct().withColumn("_keep", F.lit(True)), "rel", "left")
    kept = F.coalesce("_keep", F.lit(False))
    folder = F.regexp_replace(F.col("rel"), "/?[^/]*$", "")
    plan = marked.select(
        "rel", F.when(kept, "keep").when(F.lit(delete), "delete").otherwise("trash").alias("action"), F.concat(F.lit(pool + "/"), "rel").alias("origin"),
        F.when(kept, F.concat_ws("/", F.lit(curated), F.when(folder != "", folder))).otherwise(F.lit(f"{pool}/.dupe-trash")).alias("folder"), F.element_at(F.split("rel", "/"), -1).alias("name"),
    )
    return uniquified(plan).withColumn("dest", F.when(F.col("action") != "delete", F.col("dest")))


def synced_catalog(images: DataFrame, done: DataFrame) -> DataFrame:
    """The catalog after a plan (origin, dest, action, ok): successes only, joined by the old path; kept images move, others go."""
    d = done.filter("ok").select(F.col("origin").alias("_o"), F.col("dest").alias("_d"), F.col("action").alias("_a"))
    joined = images.join(d, images["filepath"] == d["_o"], "left").filter("_a IS NULL OR _a = 'keep' OR _a = 'move'")
    moved = F.col("_d").isNotNull()
    new = {"filepath": F.col("_d"), "filename": F.element_at(F.split("_d", "/"), -1), "directory": F.regexp_replace("_d", "/[^/]*$", "")}
    return joined.select(*(F.when(moved, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in images.columns))


JOURNAL_ROWS = 1_000  # outcomes that are written down at a time


def execute(plan: DataFrame, journal: str | None = None) -> DataFrame:
    """Carry a plan (origin, dest, and others; dest null means delete) out on the driver, file by file, and return it with ok and error.

    Outcomes are written down in portions below journal (by default a new scratch folder), and never held as a whole. A run that died
    is taken up by another one with the same plan and journal: what is written down isn't done again, and of what was done but not
    written down the files tell, as a dest that exists where the origin is gone has been moved. A dest that was there before is an error.
    """
    spark = plan.sparkSession
    journal = journal or scratch_dir(spark)
    schema = StructType([StructField("origin", StringType()), StructField("ok", BooleanType()), StructField("error", StringType())])
    os.makedirs(journal, exist_ok=True)
    plan = materialize(plan)
    written = spark.read.schema(schema).json(journal)
    todo = plan.join(written.select("origin"), "origin", "left_anti").select("origin", "dest")
    portion: list[dict] = []
    for row in todo.toLocalIterator():
        error = _carried_out(row["origin"], row["dest"])
        portion.append({"origin": row["origin"], "ok": error is None, "error": error})
        if len(portion) >= JOURNAL_ROWS:
            _write_down(journal, portion)
            portion = []
    if portion:
        _write_down(journal, portion)
    return plan.join(spark.read.schema(schema).json(journal).dropDuplicates(["origin"]), "origin", "left").select(*plan.columns, "ok", "error")


def _carried_out(origin: str, dest: str | None) -> str | None:
    """Move or delete one file; what went wrong, if anything did."""
    try:
        if dest is None:
            try:
                os.unlink(origin)
            except FileNotFoundError:
                pass  # deleted by a run before
        elif not os.path.exists(origin) and os.path.exists(dest):
            pass  # moved by a run before
        elif os.path.exists(dest):
            raise FileExistsError(dest)
        else:
            os.makedirs(os.path.dirname(dest), exist_ok=True)
            shutil.move(origin, dest)
    except OSError as e:
        return str(e)
    return None


def _write_down(journal: str, portion: list[dict]) -> None:
    """A portion of outcomes as one file, put in place whole."""
    name = uuid.uuid4().hex
    part = os.path.join(journal, f".{name}")
    with open(part, "w") as f:
        f.writelines(json.dumps(row) + "\n" for row in portion)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, os.path.join(journal, f"{name}.json"))
