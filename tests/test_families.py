import random

from vireo.functions import tables
from vireo.operators import components, dupes
from vireo.plans.tables import materialize


def test_pairs_are_thinned_before_stars(spark):
    draw = random.Random(4)
    pairs = materialize(spark.createDataFrame([(draw.randrange(900), draw.randrange(900)) for _ in range(700)], "a long, b long").repartition(5))
    whole = sorted(map(tuple, components.connected_components(pairs).collect()))
    assert sorted(map(tuple, components.connected_components(pairs, 0).collect())) == whole
    assert sorted(map(tuple, components.connected_components(pairs, 690).collect())) == whole


def test_families_in_sql_of_more_edges_than_a_task_takes(spark):
    tables.register(spark)
    draw = random.Random(5)
    rows = [(a, b, draw.randrange(16)) for a, b in ((draw.randrange(800), draw.randrange(800)) for _ in range(600))]
    edges = materialize(spark.createDataFrame(rows, "a long, b long, d int"))
    got = sorted(map(tuple, tables.all_families(edges, 12, share=100).collect()))
    assert got == sorted(tuple(r) for r in dupes.families(edges.filter("a <> b"), 12).collect()) and len(got) > 500
    dealt = edges.selectExpr("*", "pmod(a, 7) AS share")
    assert spark.sql("SELECT * FROM families(TABLE({t}), 12)", t=dealt).select("key").distinct().count() == len(got)
