import random

from pyspark.sql import functions as F

from stalemark.operators import states
from stalemark.operators.slices import NO_SLICES, measure_slices
from stalemark.operators.states import cell_of, cell_values, state_values
from stalemark.plans.validate import INTERVAL
from tests import brute

SCHEMA = "key bigint, attribute string, start_ns bigint, end_ns bigint, op string, seq_id bigint"


def updates_with_many_mixed(seed):
    rng = random.Random(seed)
    rows = []
    for key in range(12):
        attribute = rng.choice(["ACCEPTFRND", "PENDFRND"])
        up, span = rng.choice([0.3, 0.5, 0.7]), rng.choice([10, 40])
        for _ in range(rng.choice([1, 30, 120])):
            start = 5 + rng.randrange(span)
            rows.append((key, attribute, start, start + rng.randrange(1, 4), "I" if rng.random() < up else "D", len(rows)))
    return rows


def test_possible_sets_and_cells(spark):
    rows = updates_with_many_mixed(5)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(*item, *i): sorted(v) for item, s in brute.possible_states(rows).items() for i, v in s.items()}
    assert max(map(len, want.values())) > 5
    for slices in (NO_SLICES, measure_slices([df], rows_per_slice=15)):
        after = states.possible_set_states(df, slices)
        got = {tuple(r[c] for c in INTERVAL): r.v for r in after.select("*", state_values().alias("v")).collect()}
        assert got == want

    cells = states.set_cells(after.withColumn("spread", states.spread_level()))
    rows = cells.select("*", cell_values(F.col("level"), F.col("cell")).alias("v")).collect()
    covered = {}
    for r in rows:
        assert r.level <= r.spread
        covered.setdefault(tuple(r[c] for c in INTERVAL), []).extend(r.v)
    assert {k: sorted(v) for k, v in covered.items()} == want  # each value in exactly one cell
    # A value finds the cell it is in by its own cell number of that level.
    found = cells.withColumn("v", F.explode(cell_values(F.col("level"), F.col("cell"))))
    assert found.where(cell_of(F.col("v"), F.col("level")) != F.col("cell")).count() == 0


def test_possible_sets_of_long_walks_near_zero(spark):
    """One contradictory item of many slices, and many short ones: values are born at 0, die there, and are born again."""
    for seed in range(3):
        rng = random.Random(seed)
        rows = []
        for key, n in [(0, 500)] + [(k, rng.randrange(2, 25)) for k in range(1, 150)]:
            mixed = rng.choice([0.1, 0.4])
            for turn in range(n):
                ops = "ID" if rng.random() < mixed else rng.choice(["D", "D", "I"] if rng.random() < 0.5 else ["D", "I", "I"])
                rows += [(key, rng.choice(["PENDFRND"] * 9 + ["ACCEPTFRND"]) if key else "PENDFRND", 2 * turn, 2 * turn + 1, op, len(rows)) for op in ops]
        df = spark.createDataFrame(rows, SCHEMA)
        want = {(*item, *i): sorted(v) for item, s in brute.possible_states(rows).items() for i, v in s.items()}
        slices = measure_slices([df], rows_per_slice=20)
        assert slices
        for cut in (NO_SLICES, slices):
            after = states.possible_set_states(df, cut)
            assert {tuple(r[c] for c in INTERVAL): r.v for r in after.select("*", state_values().alias("v")).collect()} == want


def test_running_value_may_go_below_zero_and_keeps_the_last(spark):
    rows = [
        (1, "PENDFRND", 1, 5, "D", 1),
        (1, "PENDFRND", 2, 4, "D", 2),
        (1, "PENDFRND", 2, 4, "I", 3),
        (1, "PENDFRND", 2, 4, "I", 4),
        (1, "PENDFRND", 3, 3, "?", 5),
    ]
    after = states.running_value(spark.createDataFrame(rows, SCHEMA), NO_SLICES).orderBy("start_ns").collect()
    assert [(r.start_ns, r.end_ns, r.value, r.max_end) for r in after] == [(1, 5, -1, 5), (2, 4, 0, 5), (3, 3, 0, 5)]


def test_other_starting_values(spark):
    df = spark.createDataFrame([(1, "LIKES", 1, 5, "I", 1)], SCHEMA)
    assert states.running_value(df, NO_SLICES, {"LIKES": 5}).collect()[0].value == 6
    assert states.possible_set_states(df, NO_SLICES, {"LIKES": 5}).collect()[0].lowest == 6


def test_slices_split_a_hot_item_evenly(spark):
    hot = spark.range(20_000).select(F.lit(7).cast("bigint").alias("key"), F.lit("ACCEPTFRND").alias("attribute"), (F.col("id") * F.col("id")).alias("start_ns"))
    cold = spark.range(500).select((F.col("id") + 100).alias("key"), F.lit("PENDFRND").alias("attribute"), F.col("id").alias("start_ns"))
    df = hot.unionByName(cold)
    slices = measure_slices([df], rows_per_slice=100)
    assert [(r.key, r.attribute) for r in slices.coarse.collect()] == [(7, "ACCEPTFRND")] and slices.fine is None
    counts = slices.assign(df, F.col("start_ns")).groupBy("key", "hot", "slice").count().collect()
    assert all(r.slice == 0 and not r.hot for r in counts if r.key != 7)
    sizes = [r["count"] for r in counts if r.key == 7]
    assert sum(sizes) == 20_000 and len(sizes) == 200 and max(sizes) < 200
    # Slices rise with time.
    ordered = slices.assign(hot, F.col("start_ns")).orderBy("start_ns").select("slice").collect()
    assert [r.slice for r in ordered] == sorted(r.slice for r in ordered)


def test_every_hot_item_is_cut_however_many_there_are(spark):
    df = spark.range(1500 * 40).selectExpr("id % 1500 as key", "'PENDFRND' as attribute", "id as start_ns")
    slices = measure_slices([df], rows_per_slice=10)
    sizes = slices.assign(df, F.col("start_ns")).groupBy("key", "slice").count()
    assert sizes.count() >= 1500 * 4 and sizes.agg(F.max("count")).first()[0] <= 20


def test_slices_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr("stalemark.operators.slices.FAN", 8)
    df = spark.range(4000).selectExpr("id % 2 as key", "'PENDFRND' as attribute", "id * id as start_ns")
    slices = measure_slices([df], rows_per_slice=20)
    assert slices.fine is not None
    placed = slices.assign(df, F.col("start_ns"))
    sizes = placed.groupBy("key", "slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2000 / 64 * 2
    ordered = placed.where("key = 0").orderBy("start_ns").select("slice").collect()
    assert [r.slice for r in ordered] == sorted(r.slice for r in ordered)


def test_states_do_not_depend_on_slices_cut_again(spark, monkeypatch):
    monkeypatch.setattr("stalemark.operators.slices.FAN", 4)
    rows = updates_with_many_mixed(9)
    df = spark.createDataFrame(rows, SCHEMA)
    slices = measure_slices([df], rows_per_slice=5)
    assert slices.fine is not None
    for make in (states.running_value, states.possible_set_states):
        assert sorted(make(df, slices).collect()) == sorted(make(df, NO_SLICES).collect())


def test_run_encoded_sets(spark):
    rng = random.Random(3)
    sets = [{rng.randrange(-6, 14) for _ in range(rng.randrange(12))} for _ in range(60)] + [set(), {10**12}, set(range(0, 40, 2))]
    blocks = []
    for members in sets:
        own = [(v, v) for v in members for _ in range(rng.randrange(1, 3))]
        own += [(v, v + 2) for v in members if v + 2 in members] + [(v, v + 4) for v in members if {v + 2, v + 4} <= members]
        rng.shuffle(own)
        blocks.append((own, sorted(members), rng.randrange(-6, 14)))
    df = spark.createDataFrame(blocks, "b array<struct<low: bigint, high: bigint>>, v array<bigint>, x bigint")
    df = df.withColumn("r", states.runs_of("b")).withColumn("u", states.run_union("r", F.array(F.struct(F.col("x").alias("low"), F.col("x").alias("high")))))
    for row in df.select("*", states.run_values("r").alias("got"), states.run_size("r").alias("n"), states.run_holds("r", F.col("x")).alias("holds"), states.run_values("u").alias("both")).collect():
        members = set(row.v)
        assert (row.got, row.n, row.holds, row.both) == (row.v, len(members), row.x in members, sorted(members | {row.x}))
        starts = [v for parity in (0, 1) for v in sorted(members) if v % 2 == parity and v - 2 not in members]
        assert [r.low for r in row.r] == starts


def test_cells_are_blocks(spark):
    df = spark.range(6).crossJoin(spark.range(-9, 9).withColumnRenamed("id", "cell")).selectExpr("CAST(id AS INT) AS level", "cell")
    for r in df.select(cell_values(F.col("level"), F.col("cell")).alias("v"), states.block_of(F.col("level"), F.col("cell")).alias("b")).collect():
        assert (r.v[0], r.v[-1]) == tuple(r.b)
