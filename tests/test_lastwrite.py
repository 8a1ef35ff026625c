"""Last write wins as a stream: late, repeated and null events, and a restart from the checkpoint, against the batch fold."""

import random

from pyspark.sql import functions as F

from vireo.operators import review
from vireo.streaming import lastwrite

SCHEMA = "id long, rating int, ts timestamp, event_id long"


def run(spark, source, sink, checkpoint):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "2").parquet(str(source))
    found = lastwrite.last_writes(events, "id", "rating", ["ts", "event_id"])

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(str(sink))

    query = found.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(str(sink))
    return {r["id"]: r["rating"] for r in rows.groupBy("id").agg(F.max_by("rating", "batch").alias("rating")).collect()}, rows.count()


def test_equals_the_batch_fold(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lastwrite.PROVIDER)
    r = random.Random(2)
    drawn = [(r.randint(0, 40), r.randint(0, 5), r.randint(0, 50), k) for k in range(600)]
    drawn += [(None, 3, 5, 1000), (None, 1, 6, 1001), (7, None, 10_000, 1002), (8, 4, None, 1003), (99, 2, None, 1004)]
    r.shuffle(drawn)
    drawn += drawn[:50]  # events that come again
    rows = spark.createDataFrame(drawn, "id long, rating int, t long, event_id long").select("id", "rating", F.timestamp_seconds("t").alias("ts"), "event_id")
    source = tmp_path / "in"
    for k, part in enumerate(rows.randomSplit([1.0] * 6, 3)):
        part.coalesce(1).write.mode("append").parquet(str(source))
        if k == 3:  # a first run over a part, the rest after a restart
            run(spark, source, tmp_path / "out", tmp_path / "cp")
    got, n = run(spark, source, tmp_path / "out", tmp_path / "cp")
    fold = review.fold(rows.filter("rating IS NOT NULL"), "id", "rating", "ts", "event_id")
    assert got == {x["id"]: x["rating"] for x in fold.collect()} and got[99] == 2 and got[None] == 1
    assert run(spark, source, tmp_path / "out", tmp_path / "cp") == (got, n)  # nothing new
