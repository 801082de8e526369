"""Compare-and-swap commits, claims with fencing, and the query cache as a maintained table."""

import pytest

from sparkloom.sources.versioned import JobClaims, QueryCache, StaleVersion, VersionedTable


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", "x int")
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    assert table.version() == 0 and table.read().count() == 0
    assert table.commit(rows(1), 0) == 1
    with pytest.raises(StaleVersion):
        table.commit(rows(2), 0)
    assert [r.x for r in table.read().collect()] == [1]
    rows(9).write.parquet(f"{tmp_path}/t/rows/left-behind")  # a writer that died before its commit
    assert table.update(lambda old: old.union(rows(3))) == 2 and sorted(r.x for r in table.read().collect()) == [1, 3]
    assert [r.x for r in table.read(1).collect()] == [1]


def test_an_update_goes_on_from_the_winner(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", "x int")
    rows = lambda x: spark.createDataFrame([(x,)], "x int")
    raced = []

    def change(old):
        if not raced:
            raced.append(table.commit(rows(7), table.version()))  # another writer is first
        return old.union(rows(8))

    table.update(change)
    assert sorted(r.x for r in table.read().collect()) == [7, 8]


def test_two_claimants_and_a_late_writer(spark, tmp_path):
    a, b = JobClaims(spark, f"{tmp_path}/jobs"), JobClaims(spark, f"{tmp_path}/jobs")
    a.submit(spark.createDataFrame([(1,), (2,), (3,)], "job_id long"))
    a.submit(spark.createDataFrame([(3,)], "job_id long"))
    assert a.claim("a", "2024-01-01 00:00:00", 2) == [(1, 1), (2, 1)]
    assert b.claim("b", "2024-01-01 00:10:00", 2) == [(3, 1)]
    assert b.claim("b", "2024-01-01 00:20:00", 2) == []  # nothing waits, nobody is lost
    assert a.report([(1, 1)], "running", "2024-01-01 00:50:00") == []  # a sign of life for job 1 only
    assert b.claim("b", "2024-01-01 01:05:00", 5) == [(2, 2)]
    assert a.report([(1, 1), (2, 1)], "done", "2024-01-01 01:06:00") == [2]  # late for job 2: refused, job 1 is done
    assert b.report([(2, 2), (3, 1)], "done", "2024-01-01 01:07:00") == []
    assert {(r.job_id, r.status, r.owner, r.generation) for r in a.table.read().collect()} == {(1, "done", "a", 1), (2, "done", "b", 2), (3, "done", "b", 1)}
    assert a.report([(1, 1)], "running", "2024-01-01 02:00:00") == [1]


ASKED = "query_id long, user_id long, scope string, query string, embedding array<double>, payload string"


def test_the_cache_serves_counts_expires_and_evicts_in_one_version(spark, tmp_path):
    cache = QueryCache(spark, f"{tmp_path}/cache", threshold=0.9, ttl_hours=2, most=2)
    ask = lambda now, *rows: {r.query_id: (r.payload, r.similarity) for r in cache.turn(spark.createDataFrame(list(rows), ASKED), now).collect()}
    state = lambda: {(r.user_id, r.scope, r.query): (r.payload, r.hits) for r in cache.table.read().collect()}
    assert ask("2024-01-01 00:00:00", (1, 1, "s", "one", [1.0, 0.0], "A"), (2, 2, "s", "one", [1.0, 0.0], "B")) == {}
    assert cache.table.version() == 1 and state() == {(1, "s", "one"): ("A", 0), (2, "s", "one"): ("B", 0)}
    got = ask("2024-01-01 01:00:00", (3, 1, "s", "near", [1.0, 0.1], "C"), (4, 1, "s", "near too", [1.0, 0.2], None), (5, 1, "t", "other scope", [1.0, 0.0], "D"), (6, 3, "s", "other user", [1.0, 0.0], None), (7, 1, "s", "far", [0.0, 1.0], None))
    assert {q: p for q, (p, _) in got.items()} == {3: "A", 4: "A"} and 0.99 < got[3][1] < 1
    assert state() == {(1, "s", "one"): ("A", 2), (1, "t", "other scope"): ("D", 0), (2, "s", "one"): ("B", 0)}
    # a third entry of user 1: the one never hit goes; the entry of user 2 has expired when its owner asks
    got = ask("2024-01-01 02:30:00", (8, 1, "s", "new", [0.0, 1.0], "E"), (9, 2, "s", "again", [1.0, 0.0], None))
    assert got == {} and state() == {(1, "s", "one"): ("A", 2), (1, "s", "new"): ("E", 0)}
    assert ask("2024-01-01 02:40:00", (10, 1, "s", "x", [1.0, 0.0], None)) == {10: ("A", 1.0)}  # alive by its last hit
    assert cache.table.version() == 4 and ask("2024-01-01 02:50:00", (12, 1, "s", "y", None, None)) == {}
    cache.turn(spark.createDataFrame([(13, 1, "s", "new", [-1.0, 0.0], "G")], ASKED), "2024-01-01 03:00:00")
    assert state() == {(1, "s", "one"): ("A", 3), (1, "s", "new"): ("G", 0)}  # the same question: replaced, not added
