"""Streams with state: what they give out in the end is what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from sparkscrub.operators.rows import repeated_cells, repeated_rows
from sparkscrub.operators import steps as S
from sparkscrub.plans import recipe
from sparkscrub.session import fresh_path
from sparkscrub.streaming import repeats, replay

TABLE = "/root/testdata/sf0.001/events.parquet"


def split(df, folder, files):
    df.repartition(files).write.mode("append").parquet(folder)


def hot(spark, rows=2000):
    """A third of all rows share one key; ids run against the order of the files."""
    i = F.col("id")
    return spark.range(rows).select(i.alias("i"), (rows - i).alias("fila"), F.when(i % 3 == 0, "hot").when(i % 7 == 0, " ").otherwise((i % 150).cast("string")).alias("a"),
                                    F.when(i % 5 != 0, i % 40).cast("double").alias("b"))


@pytest.mark.parametrize("whole", [False, True])
def test_repeats_equal_batch_with_a_restart(spark, whole):
    df, source, target, checkpoint = hot(spark), fresh_path(spark, "in"), fresh_path(spark, "out"), fresh_path(spark, "check")
    split(df.filter("i % 20 < 11"), source, 11)
    start = lambda: repeats.find_repeats(spark, source, df.schema, ["a", "b"], "fila", target, checkpoint, whole_rows=whole, files_per_trigger=6).awaitTermination()
    start()
    split(df.filter("i % 20 >= 11"), source, 9)
    start()  # goes on with the keys of the first run
    got = sorted(map(tuple, spark.read.schema("columna string, fila long").parquet(target).collect()))
    if whole:
        want = [(repeats.WHOLE_ROW, r[0]) for r in repeated_rows(df, ["a", "b"], "fila").collect()]
    else:
        want = [(r["columna"], r["fila"]) for r in repeated_cells(df, ["a", "b"], "fila").collect()]
    assert got == sorted(want) and len(got) > 1000


def test_recipe_with_duplicates_on_a_stream(spark):
    events = spark.read.parquet(TABLE).select("user_id", "event_type", "value")
    events = events.union(events.limit(300)).withColumn("i", F.monotonically_increasing_id())
    plain = events.drop("i")
    steps = [{"tipo": "duplicados", "ignorar": []}, S.fit_rule(plain, "value", "mediana")]
    source, target, checkpoint = fresh_path(spark, "in"), fresh_path(spark, "out"), fresh_path(spark, "check")
    schema = plain.schema
    for part in ("i % 2 = 0", "i % 2 = 1"):
        split(events.filter(part).drop("i"), source, 10)
        replay.replay_files(spark, source, schema, steps, target, checkpoint, files_per_trigger=5).awaitTermination()
    got = spark.read.parquet(target)
    want = recipe.apply(plain, steps)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() < plain.count()
    with pytest.raises(ValueError):
        replay.replay(plain, [{"tipo": "duplicados", "ignorar": ["value"]}])


def test_timers_forget_keys(spark):
    import time

    df = spark.createDataFrame([(1, "k")], "fila long, a string")
    source, target, checkpoint = fresh_path(spark, "in"), fresh_path(spark, "out"), fresh_path(spark, "check")
    query = None
    for done, (wait, row) in enumerate(((0, 1), (0, 2), (22, 3)), 1):
        time.sleep(wait)
        spark.createDataFrame([(row, "k")], df.schema).coalesce(1).write.mode("append").parquet(source)
        query = query or repeats.find_repeats(spark, source, df.schema, ["a"], "fila", target, checkpoint, keep=14)
        end = time.time() + 40  # the clock of the timers never stands still, so the query is never idle
        while sum(p["numInputRows"] for p in query.recentProgress) < done and time.time() < end:
            time.sleep(0.3)
    query.stop()
    found = {r.fila for r in spark.read.schema("columna string, fila long").parquet(target).collect()}
    assert 2 in found and 3 not in found  # row 3 came after the key was forgotten
