import random

import pytest
from pyspark.sql import functions as F

from stalemark.operators import matching
from stalemark.operators.slices import NO_SLICES, measure_slices

SCHEMA = "key bigint, attribute string, start_ns bigint, end_ns bigint, seq_id bigint"


def intervals(seed, n):
    """Lengths over many powers of two, times below zero too."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(-500, 3000)
        rows.append((rng.randrange(4), rng.choice("AB"), start, start + rng.choice([0, 1, 3, 17, 80, 900, 5000]), i))
    return rows


def overlap(a, b, closed):
    if closed:
        return a[2] <= b[3] and b[2] <= a[3]
    return a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3]


@pytest.mark.parametrize("closed", [True, False])
def test_overlap_join_and_any_overlap(spark, closed):
    left, right = intervals(1, 300), intervals(2, 200)
    l_df, r_df = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    want = sorted((a[4], b[4]) for a in left for b in right if a[:2] == b[:2] and overlap(a, b, closed))
    slices = measure_slices([l_df, r_df], rows_per_slice=20)
    assert slices
    for s in (NO_SLICES, slices):
        pairs = matching.overlap_join(l_df, r_df, closed, slices=s).select("seq_id", "update_seq_id").collect()
        assert sorted(map(tuple, pairs)) == want
        found = matching.search_overlap(l_df, r_df, closed, s).collect()
        ends = {a[:4]: [(b[3], b[2]) for b in right if a[:2] == b[:2] and overlap(a, b, closed)] for a in left}
        latest = {span: max(e, default=(None, None)) for span, e in ends.items()}
        assert {tuple(r)[:4]: (r.found_end, r.found_start) for r in found} == latest
        hit = matching.any_overlap(l_df, r_df, closed, s).select("seq_id").collect()
        assert sorted(r.seq_id for r in hit) == sorted({a for a, _ in want})


def test_contains_point(spark):
    points, spans = intervals(3, 200), intervals(4, 200)
    want = sorted((p[4], s[4]) for p in points for s in spans if p[:2] == s[:2] and s[2] <= p[2] <= s[3])
    p_df = spark.createDataFrame(points, SCHEMA).selectExpr("key", "attribute", "start_ns as at", "seq_id as point")
    s_df = spark.createDataFrame(spans, SCHEMA)
    for slices in (NO_SLICES, measure_slices([s_df], rows_per_slice=20)):
        got = matching.contains_point(p_df, "at", s_df, slices=slices).select("point", "seq_id").collect()
        assert sorted(map(tuple, got)) == want


def test_overlap_of_extreme_lengths(spark):
    left = [(1, "A", -(2**62), 2**62 - 1, 0), (1, "A", 5, 5, 1)]
    right = [(1, "A", 0, 2**60, 0), (1, "A", -7, -7, 1)]
    l_df, r_df = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    got = matching.overlap_join(l_df, r_df, True).select("seq_id", "update_seq_id").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (0, 1), (1, 0)]


def test_lookup_delete_dedup(spark):
    rows = spark.createDataFrame(
        [(1, "A", 1, 5, 10, 1), (1, "A", 1, 5, 11, 2), (1, "A", 2, 3, 12, 3)],
        "key bigint, attribute string, start_ns bigint, end_ns bigint, value bigint, seq_id bigint",
    )
    states = matching.dedup_interval_last(rows).cache()
    assert sorted((r.start_ns, r.value) for r in states.collect()) == [(1, 11), (2, 12)]
    wanted = spark.createDataFrame([(1, "A", 1, 5), (1, "A", 1, 4), (2, "A", 1, 5)], "key bigint, attribute string, start_ns bigint, end_ns bigint")
    found = {(r.key, r.end_ns): r.value for r in matching.interval_lookup(wanted, states).collect()}
    assert found == {(1, 5): 11, (1, 4): None, (2, 5): None}
    assert [r.value for r in matching.interval_delete(states, wanted).collect()] == [12]


def test_bounds_count_and_order(spark):
    rows = spark.createDataFrame(
        [(1, "A", 3, 9, 0), (1, "A", 1, 9, 1), (1, "A", 1, 4, 2), (1, "A", 1, 4, 3), (2, "A", 0, 0, 4)], SCHEMA
    )
    bounds = {r.key: tuple(r)[2:] for r in matching.interval_bounds(rows).collect()}
    assert bounds == {1: (1, 4, 3, 9), 2: (0, 0, 0, 0)}
    assert {r.key: r.n_intervals for r in matching.interval_count(rows).collect()} == {1: 3, 2: 1}
    ordered = matching.sort_intervals(rows).where(F.col("key") == 1).orderBy("position").collect()
    assert [(r.start_ns, r.end_ns, r.position, r.max_end) for r in ordered] == [(1, 4, 1, 4), (1, 9, 2, 9), (3, 9, 3, 9)]


def test_merged_runs_do_not_change_values(spark):
    spans, stored = intervals(6, 150), intervals(7, 300)
    cells = spark.createDataFrame(
        [(*r[:4], 0, r[4] % 3) for r in stored],
        "key bigint, attribute string, start_ns bigint, end_ns bigint, level int, cell bigint",
    )
    s_df = spark.createDataFrame(spans, SCHEMA)
    want = {}
    for a in spans:
        values = {b[4] % 3 for b in stored if a[:2] == b[:2] and overlap(a, b, True)}
        if values:
            want[a[:4]] = sorted(values)
    for slices in (NO_SLICES, measure_slices([cells], rows_per_slice=25)):
        got = matching.values_at(s_df, cells, slices, closed=True).collect()
        assert {tuple(r)[:4]: r.possible for r in got} == want
    assert matching.merge_runs(cells, NO_SLICES).count() < cells.count()
