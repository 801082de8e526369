"""Listing operators on small rows: ties, nulls and empty input."""

from pyspark.sql import functions as F

from sparkloom.operators import listing as L


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_occurrences_overlap_and_begin_at_zero(spark):
    df = spark.createDataFrame([(1, "aAa x aa"), (2, None), (3, ""), (4, "none"), (5, "aa")], "id int, t string")
    assert found(L.occurrences(df, "id", "t", "AA")) == [(1, 0), (1, 1), (1, 6), (5, 0)]


def test_reserved_rows_stand_first(spark):
    df = spark.createDataFrame([(1, "a", 0.9, False), (1, "b", 0.1, True), (1, "c", 0.8, None), (2, "d", 0.1, True), (2, "e", 0.2, True), (2, "f", 0.3, True)], "q int, id string, s double, r boolean")
    assert [r[1] for r in found(L.reserved_first(df, "q", F.col("r"), [F.desc("s")], 2))] == ["a", "b", "e", "f"]


def test_drill_down_keeps_the_best_parent(spark):
    hits = spark.createDataFrame([(1, 10, 0.8), (1, 11, 0.4), (1, 12, 0.2)], "query_id int, chunk_id int, score double")
    children = spark.createDataFrame([(10, 1), (11, 1), (11, 2), (12, 3)], "chunk_id int, child_id int")
    assert found(L.drill_down(hits, children, 2).select("child_id", "score")) == [(1, 0.76), (2, 0.38)]
    assert found(L.drill_down(hits.limit(0), children, 2)) == []


def test_append_keeps_known_numbers(spark):
    schema = "run int, cid string, id int"
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], schema)
    new = spark.createDataFrame([(1, "b", 3), (1, "c", 4), (1, "c", 5), (1, "d", 6), (2, "a", 7)], schema)
    assert found(L.append_sequence(old, new, "run", "cid", "id").select("id", "seq")) == [(3, 2), (4, 3), (5, 3), (6, 4), (7, 1)]


def test_recovery_of_running_jobs(spark):
    rows = [(1, "2024-01-01 11:30:00", 9), (2, "2024-01-01 10:00:00", 1), (3, "2024-01-01 10:00:00", 3), (4, None, 0)]
    jobs = spark.createDataFrame(rows, "id int, b string, n int").withColumn("b", F.col("b").cast("timestamp"))
    done = L.recovery(jobs, F.lit("2024-01-01 12:00:00").cast("timestamp"), "b", "n", 3)
    assert found(done.select("id", "action")) == [(1, "keep"), (2, "requeue"), (3, "close"), (4, "requeue")]


def test_context_of_several_seeds(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 2), (9, 8)], "src int, dst int")
    seeds = spark.createDataFrame([(1,), (9,)], "seed int")
    assert found(L.context_batch(seeds, edges).select("seed", "depth", "node")) == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (9, 0, 9), (9, 1, 8)]
    assert L.context_batch(seeds, edges, most=2).count() == 2


def test_induced_links(spark):
    nodes, edges = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")
    assert found(L.induced(nodes, edges, "id")) == [(1, 2)]
