"""Tables that several writers change at once: nothing is lost, half a commit isn't seen, merges change no row."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import landing
from gaugeworks.operators import ledger as L


@pytest.fixture
def book(spark):
    return L.Ledger(spark, landing.new_folder(spark, "ledger"), "key string, n long", ("key",), fan=3)


def rows(spark, *values):
    return spark.createDataFrame(list(values), "key string, n long")


def seen(book):
    return {r.key: r.n for r in book.read().collect()}


def test_put_replace_remove(spark, book):
    assert seen(book) == {}
    book.put(rows(spark, ("a", 1), ("b", 2), (None, 3)))
    book.put(rows(spark, ("a", 5)))
    book.remove(rows(spark, ("b", None), ("never", None)))
    assert seen(book) == {"a": 5, None: 3}
    book.put(rows(spark, ("b", 7), ("b", 9)))  # a key twice: the greatest
    book.put(rows(spark))
    assert seen(book) == {"a": 5, None: 3, "b": 9}


def test_missing_columns_are_null_and_others_are_left_out(spark, book):
    book.put(spark.createDataFrame([("a", 4, "x")], "KEY string, N int, other string"))
    book.put(spark.createDataFrame([("b",)], "key string"))
    assert seen(book) == {"a": 4, "b": None}


def test_a_name_is_committed_once(spark, book):
    assert book.put(rows(spark, ("a", 1)), name="run-1") == "run-1"
    book.put(rows(spark, ("a", 2)), name="run-1")
    assert seen(book) == {"a": 1}


def test_entries_without_a_note_are_not_seen_and_can_be_written_again(spark, book):
    book._write(book._stamped(rows(spark, ("a", 1)), 1, "run-1", False), "run-1")  # the writer died here
    assert seen(book) == {}
    book.put(rows(spark, ("a", 2)), name="run-1")
    assert seen(book) == {"a": 2}


def test_writers_at_once_lose_nothing(spark, book):
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: book.put(rows(spark, (f"k{k}", k))), range(8)))
    assert seen(book) == {f"k{k}": k for k in range(8)}


def test_updates_at_once_all_count(spark, book):
    book.put(rows(spark, ("a", 0), ("b", 10)))
    add = lambda now: now.where("key = 'a'").withColumn("n", F.col("n") + 1)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: book.update(add), range(5)))
    assert seen(book) == {"a": 5, "b": 10}


def test_an_update_sees_what_came_between(spark, book):
    book.put(rows(spark, ("a", 1)))
    calls = []

    def change(now):
        calls.append(1)
        if len(calls) == 1:  # someone commits after this one has read
            book.put(rows(spark, ("a", 100)))
        return now.withColumn("n", F.col("n") + 1)

    book.update(change)
    assert len(calls) == 2
    assert seen(book) == {"a": 101}
    assert book.superseded().count() == 1  # the one that gave way


def test_an_update_gives_up_while_another_is_open(spark, book):
    book._note("other", "open", 1)
    with pytest.raises(L.Conflict):
        book.update(lambda now: now, tries=2)


def test_a_dead_writer_does_not_hold_the_table(spark, book, monkeypatch):
    book._note("other", "open", 1)
    monkeypatch.setattr(L, "PATIENCE_S", 0)
    assert book._state().open == {}


def test_of_two_open_changes_the_smaller_name_goes_on(spark, book):
    before = book._state()
    for name in ("a", "b"):
        book._note(name, "open", 1)
    assert not book._may_commit("b", before, L.time.time())
    book._note("b", "withdrawn", 1)
    assert book._may_commit("a", before, L.time.time())
    book._note("a", "done", 1)
    assert not book._may_commit("c", before, L.time.time())  # the table is newer than what it read


def test_merging_changes_no_row(spark, book):
    for k in range(7):
        book.put(rows(spark, (f"k{k % 4}", k)))
    book.remove(rows(spark, ("k0", None)))
    before = seen(book)
    assert before == {"k1": 5, "k2": 6, "k3": 3}
    live = book._state().live
    while book.merge():
        assert seen(book) == before
    assert len(book._state().live) < len(live)
    # a merge that two do at once: both stay, and say the same
    tier = list(live)[:2]
    book._note("twice", "done", 2, book._write(book._newest(book._read(tier)), "twice"), ())
    assert seen(book) == before
    book.put(rows(spark, ("k0", 8)))
    assert seen(book) == before | {"k0": 8}
