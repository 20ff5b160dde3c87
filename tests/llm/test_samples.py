import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from squallframe.functions.cleaning import letters_key, plain_id
from squallframe.llm import queries as Q
from squallframe.llm import quota_sample as QS
from squallframe.llm import stable_sample as SS

LEDGER = [("A", 0.3), ("B", 0.1), (None, 0.2), ("B", 0.05), ("A", 0.5)]


def sample(spark, rows, ledger=LEDGER, parts=3):
    df = spark.createDataFrame(rows, "id string, c string, key string, stratum string, key_hash string").repartition(parts)
    return {(r.key, r.stratum) for r in SS.stable_sample(df, plain_id(F.col("id")), F.col("c"), [*ledger, (SS.OTHER, 0.05)], "s").collect()}


def rows(n, c="A"):
    return [(f"S{i:05d}", c if i % 3 else "B", "x", "y", "z") for i in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.floats(0, 1), st.floats(0, 1))
def test_thresholds_rise_with_rates(a, b):
    if a <= b:
        assert SS.threshold(a) <= SS.threshold(b)
    with pytest.raises(ValueError):
        SS.threshold(float("nan"))


def test_ledger_keeps_the_highest_rate():
    assert SS.highest_rates(LEDGER) == {"A": 0.5, "B": 0.1, None: 0.2, SS.OTHER: 0.0}
    assert SS.highest_rates([*LEDGER, (SS.OTHER, 0.15), (SS.OTHER, 0.1)]) == {"A": 0.5, "B": 0.15, None: 0.2, SS.OTHER: 0.15}


def test_no_entry_can_lose_a_member(spark):
    before = sample(spark, rows(900, "Z"), [(SS.OTHER, 0.3)])
    assert any(c == "Z" for _, c in before)
    for entry in (("Z", 0.02), ("Z", 0.0), (SS.OTHER, 0.01), (None, 0.01), ("B", 0.9)):
        assert before <= sample(spark, rows(900, "Z"), [(SS.OTHER, 0.3), entry])


def test_the_ledger_table_only_grows(spark, tmp_path):
    at = f"file://{tmp_path}/ledger"
    assert dict(SS.keep_rates(spark, at, [("A", 0.3), (None, 0.1)])) == {"A": 0.3, None: 0.1}
    assert dict(SS.keep_rates(spark, at, [("A", 0.1), ("B", 0.2)])) == {"A": 0.3, None: 0.1, "B": 0.2}
    assert dict(SS.keep_rates(spark, at, [])) == {"A": 0.3, None: 0.1, "B": 0.2}
    assert SS.keep_rates(spark, f"file://{tmp_path}/empty", []) == []
    with pytest.raises(ValueError):
        SS.keep_rates(spark, at, [("A", -0.1)])

def test_same_members_for_any_partitioning_and_growth(spark):
    small = sample(spark, rows(400))
    assert small == sample(spark, rows(400), parts=1)
    later = rows(900) + [(" s00001 ", "B", "", "", ""), ("S00002_sweep", None, "", "", ""), *rows(50)] + [(f"S{i:05d}", "C", "", "", "") for i in range(0, 400, 2)]
    big = sample(spark, later)
    assert small <= big
    assert small <= sample(spark, rows(400), [*LEDGER, ("A", 0.01), ("B", 0.0), ("A", 0.6)])


def test_rates_hold_and_odd_keys_are_left_out(spark):
    got = sample(spark, rows(3000) + [(None, "A", "", "", ""), ("", "A", "", "", ""), ("  ", None, "", "", "")])
    a = sum(1 for _, c in got if c == "A")
    assert abs(a / 2000 - 0.5) < 0.05 and all(k for k, _ in got)
    assert sample(spark, []) == set()
    assert sample(spark, [("S1", "Z" * 100_000, "", "", "")], [("A", 0.1)], 1) in (set(), {("S1", "Z" * 100_000)})


def test_members_stay_through_the_batches(spark, data):
    cat = spark.read.parquet(f"{data}/event_catalogue.parquet")
    before = set()
    for b in range(1, 9):
        got = SS.stable_sample(cat.where(F.col("batch_no") <= b), plain_id(F.col("id")), Q.plain_class(F.col("lifecycle_class")), list(Q.RATE_LEDGER), Q.SALT)
        now = {(r.key, r.stratum) for r in got.collect()}
        assert before <= now
        before = now


def draw(spark, events, targets, parts=2):
    e = spark.createDataFrame(events, "id string, c string, at timestamp, b int").repartition(parts)
    t = spark.createDataFrame(targets, "r int, c string, n bigint, s double, m bigint, available string, quota string")
    latest = QS.latest_category(e, plain_id(F.col("id")), letters_key(F.col("c")), "at", "b")
    asked = QS.quotas(t, "r", letters_key(F.col("c")), "n", "s", "m")
    got, report = QS.quota_sample(latest, asked, "r", "salt")
    return {(x.r, x.category, x.key) for x in got.collect()}, {(x.r, x.c): (x.quota, x.available, x.sampled, x.deficit) for x in report.collect()}


def test_latest_class_and_ties(spark):
    import datetime as dt

    t1, t2 = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
    e = [("S1", "A", t1, 1), (" s1", "B", t2, 1), ("S2", "A", t1, 1), ("S2", None, t2, 2), ("S3", "A", None, 9), ("S3", "B", t1, 1), ("S4", "a ", t1, 1), ("S4", "b", t1, 2), (None, "A", t1, 1), ("", "A", t1, 1)]
    df = spark.createDataFrame(e, "id string, c string, at timestamp, b int")
    got = {r.key: r.category for r in QS.latest_category(df, plain_id(F.col("id")), letters_key(F.col("c")), "at", "b").collect()}
    assert got == {"S1": "b", "S2": None, "S3": "b", "S4": "b"}


def test_exact_counts_minimum_and_deficits(spark):
    events = [(f"S{i:04d}", "A" if i < 900 else "B", None, 1) for i in range(1000)] + [(f"S{i:04d}", "A", None, 1) for i in range(50)]
    targets = [(1, "A", 200, 0.5, 0, "", ""), (1, "B", 200, 0.25, 80, "", ""), (1, "C", 200, 0.1, 5, "", ""), (2, "B", 1000, 0.5, 1, "", ""), (2, " a", 10, 0.25, 0, "", ""), (3, None, 10, 0.5, 1, "", ""), (4, "A", None, None, None, "", ""), (1, "A", 100, 0.5, 0, "", "")]
    got, report = draw(spark, events, targets)
    n = lambda r, c: sum(1 for x in got if x[:2] == (r, c))
    assert n(1, "a") == 100 and n(1, "b") == 80 and n(2, "b") == 100 and n(2, "a") == 3 and n(4, "a") == 0
    assert report[1, "B"] == (80, 100, 80, 0) and report[1, "C"] == (20, 0, 0, 20) and report[2, "B"] == (500, 100, 100, 400) and report[3, None][3] == 5
    assert draw(spark, events, targets, 5)[0] == got


def test_empty_tables(spark):
    assert draw(spark, [], []) == (set(), {})
    assert draw(spark, [], [(1, "A", 10, 0.5, 1, "", "")])[1] == {(1, "A"): (5, 0, 0, 5)}
    assert draw(spark, [("S1", "A", None, 1)], [])[0] == set()


def test_the_deficit_is_what_the_sample_lacks(spark, monkeypatch):
    monkeypatch.setattr(QS, "availability", lambda latest, asked: asked.withColumn("available", F.lit(30).cast("bigint")))
    events = [(f"S{i:04d}", "A", None, 1) for i in range(20)]
    assert draw(spark, events, [(1, "A", 40, 1.0, 0, "", "")])[1] == {(1, "A"): (40, 30, 20, 20)}


def test_a_short_draw_is_repaired(spark, monkeypatch):
    monkeypatch.setattr(QS, "SLACK", -3.0)  # accept far too few at first
    events = [(f"S{i:04d}", "A", None, 1) for i in range(500)]
    got, report = draw(spark, events, [(1, "A", 400, 1.0, 0, "", "")])
    assert len(got) == 400 and report[1, "A"] == (400, 500, 400, 0)
