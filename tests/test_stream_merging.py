"""Statements merged from keyed state: late rows, several sessions a key, several runs, and what stays open."""

from datetime import datetime

import pytest

from querysentry.streaming import merging

COLUMNS = "stmt_id long, seq int, query_id long, n_terminal long, n_nonterminal long, is_syntax_error int, semantic_tree string, depth long, ts timestamp"


class Feed:
    def __init__(self, spark, root):
        self.spark, self.root = spark, root

    def arrive(self, rows):
        """Rows (key, number, time of day or None), as one file."""
        made = [
            (k, n, n, None if n % 2 else 2, 1, 0, f"n{n}|||-||{n}>1: ", 1, at and datetime.fromisoformat(f"2024-01-01 {at}")) for k, n, at in rows
        ]
        self.spark.createDataFrame(made, COLUMNS).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def run(self, flush=False):
        stream = self.spark.readStream.schema(COLUMNS).parquet(f"{self.root}/in")
        merged = merging.stream_merge_invocations(stream, f"{self.root}/work", flush=flush)
        return sorted((str(r.stmt_id), r.start.strftime("%H:%M"), r.n_parser_invoc, r.n_terminal, r.semantic_tree.split("|||-||")[0]) for r in merged.collect())

    def late(self):
        return sorted((str(r.stmt_id), r.seq) for r in merging.late_invocations(self.spark, f"{self.root}/work").collect())


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, str(tmp_path))


def test_late_rows_are_a_table(feed):
    feed.arrive([(1, 1, "08:00:00"), (1, 2, "08:30:00"), (2, 3, "14:00:00"), (3, 4, None)])
    assert feed.run() == [("1", "08:00", 2, 2, "n1|n2")]
    assert feed.late() == [("3", 4)]
    # One comes after its statement was merged, one of a key not seen before is long over, one is still in time.
    feed.arrive([(1, 5, "08:45:00"), (4, 6, "09:00:00"), (1, 7, "13:20:00")])
    assert feed.run() == [("1", "08:00", 2, 2, "n1|n2")]
    assert feed.late() == [("1", 5), ("3", 4), ("4", 6)]
    assert feed.run(flush=True) == [("1", "08:00", 2, 2, "n1|n2"), ("1", "13:20", 1, 0, "n7"), ("2", "14:00", 1, 0, "n3")]


def test_rows_behind_the_watermark_join_what_is_open(feed):
    """The watermark has passed the row's own time, but its statement is open: it is no late row."""
    feed.arrive([(1, 1, "10:00:00"), (1, 2, "10:50:00"), (9, 3, "11:20:00")])
    assert feed.run() == []
    feed.arrive([(1, 4, "10:05:00")])
    assert feed.run() == [] and feed.late() == []
    feed.arrive([(9, 5, "15:00:00")])
    assert feed.run() == [("1", "10:00", 3, 4, "n1|n2|n4"), ("9", "11:20", 1, 0, "n3")]


def test_flush_leaves_statements_open(feed):
    """What was flushed goes on, and is neither lost nor given twice."""
    feed.arrive([(None, 1, "10:00:00"), (5, 2, "10:00:00")])
    assert feed.run(flush=True) == [("5", "10:00", 1, 2, "n2"), ("None", "10:00", 1, 0, "n1")]
    feed.arrive([(None, 3, "10:40:00")])
    assert feed.run(flush=True) == [("5", "10:00", 1, 2, "n2"), ("None", "10:00", 2, 0, "n1|n3")]
    feed.arrive([(7, 4, "18:00:00")])
    assert feed.run() == [("5", "10:00", 1, 2, "n2"), ("None", "10:00", 2, 0, "n1|n3")]


def test_several_sessions_of_a_key_in_one_batch(feed):
    feed.arrive([(1, n, f"{n:02d}:{m:02d}:00") for n, m in ((1, 0), (2, 30), (3, 10), (5, 0), (6, 0), (8, 0))])
    got = feed.run(flush=True)
    # Pauses of an hour or more end a statement.
    assert [(start, n) for _, start, n, _, _ in got] == [("01:00", 1), ("02:30", 2), ("05:00", 1), ("06:00", 1), ("08:00", 1)]


def test_nothing_has_arrived(feed):
    feed.arrive([])
    assert feed.run(flush=True) == [] and feed.late() == []


def test_runs():
    assert merging.runs([], 5) == []
    assert merging.runs([1, 5, 9, 14, 20], 5) == [(0, 3), (3, 4), (4, 5)]
