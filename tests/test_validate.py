import random

import pytest
from pyspark.sql import functions as F

from stalemark.operators.slices import NO_SLICES, measure_slices
from stalemark.plans import validate
from tests import brute

LOGS = "key bigint, attribute string, start_ns bigint, end_ns bigint"


def random_logs(seed, n_items=25, odd=True):
    rng = random.Random(seed)
    updates, reads = [], []
    names = ["ACCEPTFRND", "PENDFRND"]
    for key in range(n_items):
        for attribute in names:
            span = rng.choice([6, 20, 200])
            up = rng.choice([0.2, 0.5, 0.8])
            origin = rng.choice([-5, 0, 1, 50])
            for i in range(rng.choice([0, 2, 15, 60])):
                start = origin + rng.randrange(span)
                end = start + rng.randrange(0 if odd else 1, rng.choice([2, 4, span + 2]) + 1)
                op = "I" if rng.random() < up else "D"
                updates.append((key, attribute, start, end, op, len(updates)))
            for _ in range(rng.choice([1, 8, 25])):
                start = origin - 5 + rng.randrange(span + 15)
                end = start + rng.randrange(0, rng.choice([2, 5, span + 1]))
                value = rng.choice([10 if attribute == "ACCEPTFRND" else 0]) + rng.randrange(-3, 6)
                reads.append((key, attribute, start, end, value))
    reads += rng.sample(reads, 20)  # copies
    return reads, updates


def frames(spark, reads, updates):
    return (
        spark.createDataFrame(reads, f"{LOGS}, value int").repartition(3),
        spark.createDataFrame(updates, f"{LOGS}, op string, seq_id bigint").repartition(5),
    )


def expected(reads, updates, semantics, **options):
    if semantics == "running_value":
        states = brute.running_states(updates)
        return [brute.running_values(r, states, **options) for r in reads]
    states = brute.possible_states([u for u in updates if u[2] < u[3]])
    return [brute.possible_values(r, states, **options) for r in reads]


@pytest.mark.parametrize("semantics", validate.SEMANTICS)
@pytest.mark.parametrize("seed,rows_per_slice", [(1, 10**9), (2, 12)])
def test_random_logs(spark, semantics, seed, rows_per_slice):
    reads, updates = random_logs(seed)
    read_df, update_df = frames(spark, reads, updates)
    slices = measure_slices([read_df, update_df], rows_per_slice=rows_per_slice)
    assert bool(slices) == (rows_per_slice < 10**9)

    want = dict(zip(reads, expected(reads, updates, semantics)))
    verdicts = validate.judge_spans(read_df, update_df, semantics, slices=slices).collect()
    got = {(r.key, r.attribute, r.start_ns, r.end_ns, r.value): (r.valid, r.n_reads) for r in verdicts}
    assert got == {r: (r[4] in values, reads.count(r)) for r, values in want.items()}

    values = validate.possible_values(read_df, update_df, semantics, slices=slices).collect()
    got = {(r.key, r.attribute, r.start_ns, r.end_ns): r.possible_values for r in values}
    assert got == {r[:4]: sorted(v) for r, v in want.items()}

    columns = ["key", "attribute", "start_ns", "end_ns", "value", "valid"]
    forms = [validate.validate_reads(read_df, update_df, semantics, slices=slices, with_values=w).select(*columns) for w in (False, True)]
    assert sorted(forms[0].collect()) == sorted(forms[1].collect()) and forms[0].count() == len(reads)


@pytest.mark.parametrize("semantics", validate.SEMANTICS)
def test_state_before(spark, semantics):
    reads, updates = random_logs(3)
    read_df, update_df = frames(spark, reads, updates)
    options = {"own": False, "rules": False} if semantics == "running_value" else {"own": False}
    want = dict(zip(reads, expected(reads, updates, semantics, **options)))
    values = validate.state_before(read_df, update_df, semantics, slices=NO_SLICES).collect()
    got = {(r.key, r.attribute, r.start_ns, r.end_ns): r.possible_values for r in values}
    assert got == {r[:4]: sorted(v) for r, v in want.items()}


A, P = "ACCEPTFRND", "PENDFRND"
BOTH = validate.SEMANTICS

# name, semantics, updates (attribute, start, end, op), read (attribute, start, end), values a read may return
CASES = [
    ("no updates, accept", BOTH, [], (A, 5, 6), [10]),
    ("no updates, pending", BOTH, [], (P, 5, 6), [0]),
    ("before all updates", BOTH, [(A, 10, 20, "I")], (A, 2, 5), [10]),
    ("over one update", BOTH, [(A, 10, 20, "I")], (A, 12, 15), [10, 11]),
    ("over two updates", BOTH, [(A, 10, 20, "I"), (A, 15, 25, "I")], (A, 16, 30), [10, 11, 12]),
    ("after all updates", BOTH, [(A, 10, 20, "I"), (A, 15, 25, "I")], (A, 40, 50), [11, 12]),
    ("in a gap", BOTH, [(A, 10, 20, "I"), (A, 50, 60, "I")], (A, 30, 40), [11]),
    ("touching an end, half-open", ["possible_set"], [(A, 10, 20, "I")], (A, 20, 30), [10]),
    ("touching an end, closed", ["running_value"], [(A, 10, 20, "I")], (A, 20, 30), [11]),
    ("touching a start, half-open", ["possible_set"], [(A, 10, 20, "I")], (A, 5, 10), [10]),
    ("touching a start, closed", ["running_value"], [(A, 10, 20, "I")], (A, 5, 10), [10, 11]),
    # The long first update has not ended, so the finished ones after it do not count as before the read.
    ("long update hides", ["running_value"], [(A, 1, 99, "I"), (A, 5, 6, "I"), (A, 10, 20, "I")], (A, 30, 40), [10, 11]),
    ("long update, latest end", ["possible_set"], [(A, 2, 99, "I"), (A, 5, 6, "I"), (A, 10, 20, "I")], (A, 30, 40), [11, 13]),
    ("two inserts at once are one", ["possible_set"], [(A, 10, 20, "I"), (A, 10, 20, "I")], (A, 30, 40), [11]),
    ("two inserts at once, last value", ["running_value"], [(A, 10, 20, "I"), (A, 10, 20, "I")], (A, 30, 40), [12]),
    ("insert and delete at once", ["possible_set"], [(A, 10, 20, "I"), (A, 10, 20, "D")], (A, 30, 40), [9, 11]),
    ("delete at zero, floor", ["possible_set"], [(P, 10, 20, "D"), (P, 30, 40, "I")], (P, 50, 60), [1]),
    ("delete at zero, no floor", ["running_value"], [(P, 10, 20, "D"), (P, 30, 40, "I")], (P, 50, 60), [0]),
    ("mixed at zero", ["possible_set"], [(P, 10, 20, "D"), (P, 10, 20, "I"), (P, 30, 40, "D")], (P, 50, 60), [0]),
    ("unknown op goes down", ["possible_set"], [(A, 10, 20, "N")], (A, 30, 40), [9]),
    ("unknown op does nothing", ["running_value"], [(A, 10, 20, "N")], (A, 30, 40), [10]),
    ("empty read overlaps nothing", ["possible_set"], [(A, 10, 20, "I")], (A, 15, 15), [10]),
    ("empty read, closed", ["running_value"], [(A, 10, 20, "I")], (A, 15, 15), [10, 11]),
    ("empty update is refused", ["possible_set"], [(A, 10, 10, "I")], (A, 30, 40), [10]),
    ("empty update counts, closed", ["running_value"], [(A, 10, 10, "I")], (A, 10, 40), [10, 11]),
    ("backwards update is refused", BOTH, [(A, 20, 10, "I")], (A, 30, 40), [10]),
    ("ends up to 1 are out of reach", ["possible_set"], [(A, 0, 1, "I")], (A, 30, 40), [10]),
    ("an early end is out of reach before, but overlaps", ["possible_set"], [(A, 0, 1, "I"), (A, 0, 1, "D")], (A, 0, 5), [9, 10, 11]),
    ("attribute by substring", ["possible_set"], [("X" + A, 10, 20, "I")], (A, 30, 40), [11]),
    ("attribute by equality", ["running_value"], [("X" + A, 10, 20, "I")], (A, 30, 40), [10]),
    ("other attributes start at 0", ["running_value"], [("POSTCOMMENT", 10, 20, "I")], ("POSTCOMMENT", 12, 14), [0, 1]),
    ("other attributes are not judged", ["possible_set"], [], ("POSTCOMMENT", 12, 14), None),
    # Both the last update in start order and the one that ends last are looked around, though they do not overlap.
    (
        "late read sees the highest",
        ["running_value"],
        [(A, 1, 9, "I"), (A, 2, 3, "I"), (A, 5, 6, "I")],
        (A, 10, 11),
        [11, 12, 13],
    ),
]


@pytest.mark.parametrize("semantics", validate.SEMANTICS)
def test_hand_made_cases(spark, semantics):
    """Every case is an item of its own; read values 0..20 are all tried, so verdicts and values must agree."""
    cases = [c for c in CASES if semantics in c[1]]
    updates, reads, spans = [], [], []
    for key, (_, _, ups, read, _) in enumerate(cases):
        updates += [(key, *u, i) for i, u in enumerate(ups)]
        spans.append((key, *read, 0))
        reads += [(key, *read, value) for value in range(-2, 21)]
    update_df = spark.createDataFrame(updates, f"{LOGS}, op string, seq_id bigint")
    read_df = spark.createDataFrame(reads, f"{LOGS}, value int")
    found = validate.possible_values(read_df, update_df, semantics, slices=NO_SLICES).collect()
    listed = {r.key: r.possible_values for r in found}
    valid = {}
    for r in validate.valid_only(validate.validate_reads(read_df, update_df, semantics)).collect():
        valid.setdefault(r.key, []).append(r.value)
    for key, (name, _, _, _, want) in enumerate(cases):
        assert (name, listed.get(key)) == (name, want)
        assert (name, sorted(valid.get(key, [])) or None) == (name, want)


@pytest.mark.parametrize("semantics", validate.SEMANTICS)
def test_result_does_not_depend_on_partitioning(spark, semantics):
    reads, updates = random_logs(4, n_items=6)
    results = []
    for partitions, order in (("1", 1), ("23", -1)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        read_df, update_df = frames(spark, reads[::order], updates[::order])
        results.append(sorted(validate.judge_spans(read_df, update_df, semantics).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_report(spark, tmp_path):
    updates = [(1, A, 10, 20, "I", 1), (1, A, 30, 40, "I", 2), (9, A, 10, 20, "I", 3)]
    reads = [(1, A, 22, 25, 11), (1, A, 22, 25, 7), (1, A, 22, 25, 7), (2, P, 1, 2, 0), (2, P, 1, 2, 5)]
    read_df, update_df = frames(spark, reads, updates)

    def report(r, u):
        verdicts = validate.judge_spans(r, u, "running_value")
        return validate.staleness_report(verdicts, validate.update_counts(r, u))

    assert report(read_df, update_df).collect()[0].asDict() == {
        "total_reads": 5,
        "total_updates": 3,
        "processed_updates": 2,
        "correct_reads": 2,
        "stale_reads": 3,
        "stale_reads_with_updates": 2,
        "correct_fraction": 0.4,
        "stale_fraction": 0.6,
        "correct_percent": 40.0,
    }
    empty = report(read_df.limit(0), update_df).collect()[0]
    assert (empty.total_reads, empty.total_updates, empty.processed_updates) == (0, 3, 0)
    assert empty.correct_fraction is None and empty.correct_percent is None
    lines = validate.report_lines(report(read_df, update_df)).orderBy("line").collect()
    assert (lines[0].figure, lines[0].amount) == ("total_reads", "5") and len(lines) == 9
    validate.write_report(report(read_df, update_df), str(tmp_path / "report"))
    written = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert "stale_reads: 3" in written and len(written) == 9


def test_unknown_semantics(spark):
    read_df, update_df = frames(spark, [(1, A, 1, 2, 3)], [(1, A, 1, 2, "I", 1)])
    with pytest.raises(ValueError):
        validate.judge_spans(read_df, update_df, "newest")


def test_filters_and_rejects(spark):
    logs = spark.createDataFrame(
        [(1, A, 1, 2), (1, "X" + P, 1, 2), (1, "POSTCOMMENT", 1, 2), (2, A, 3, 3), (3, A, 5, 4)], LOGS
    )
    assert validate.filter_validatable(logs).count() == 4
    assert validate.filter_attribute(logs, P).count() == 1
    for closed, kept in ((True, 4), (False, 3)):
        ok, rejects = validate.split_intervals(logs, closed)
        assert ok.count() == kept
        assert rejects.where(F.col("key") == 3).collect()[0].reason == "start_after_end"


@pytest.mark.parametrize("semantics", validate.SEMANTICS)
@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_reads_without_a_verdict(spark, semantics, kind):
    """Both forms leave out the same reads, split_reads gives them, and the report adds up without them."""
    update_df = spark.createDataFrame([(1, A, 10, 20, "I", 1)], f"{LOGS}, op string, seq_id bigint")
    large = 2**40 if kind == "bigint" else 99
    reads = [(1, A, 12, 15, 11), (1, A, 12, 15, None), (1, A, 12, 15, large), (1, A, 9, 5, 11), (1, A, None, 5, 1), (None, A, 1, 2, 10)]
    read_df = spark.createDataFrame(reads + [(1, "POSTCOMMENT", 1, 2, 0)], f"{LOGS}, value {kind}")
    forms = [validate.validate_reads(read_df, update_df, semantics, with_values=w) for w in (False, True)]
    want = [(11, True), (large, False)] + ([(0, True)] if semantics == "running_value" else [])
    for form in forms:
        assert sorted((r.value, r.valid) for r in form.collect()) == sorted(want)
        assert dict(form.dtypes)["value"] == kind
    ok, refused = validate.split_reads(read_df, semantics)
    assert ok.count() == len(want)
    unknown = ["unknown_attribute"] if semantics == "possible_set" else []
    assert sorted(r.reason for r in refused.collect()) == sorted(["no_value", "start_after_end", "missing_field", "missing_field", *unknown])
    report = validate.report_of(read_df, update_df, semantics).first()
    assert report.total_reads == len(want) == report.correct_reads + report.stale_reads


@pytest.mark.parametrize("semantics", validate.SEMANTICS)
def test_collapsed_logs_give_the_same(spark, semantics):
    """Copies by the hundred, rows without an interval or a value, other attributes: counted once or collapsed first."""
    reads, updates = random_logs(11, n_items=8)
    updates += updates[:5] * 100 + [(1, "ACCEPTFRND", 5, None, "I", 0), (None, "PENDFRND", 1, 2, None, 0), (1, "OTHER", 1, 2, "D", 0)]
    reads += reads[:3] * 100 + [(1, "ACCEPTFRND", 9, 2, 10), (2, "PENDFRND", 1, 2, None), (None, "PENDFRND", 1, 2, 0), (1, "OTHER", 1, 2, 0)]
    raw = frames(spark, reads, updates)
    collapsed = validate.collapse_logs(*raw)
    assert collapsed[0].count() < len(reads) and collapsed[1].count() < len(updates)
    for question in (
        lambda r, u: validate.judge_spans(r, u, semantics),
        lambda r, u: validate.update_counts(r, u),
        lambda r, u: validate.possible_values(r, u, semantics),
        lambda r, u: validate.update_states(u.where(validate.usable(semantics == "running_value")), semantics, NO_SLICES, validate.INITIAL),
    ):
        assert sorted(map(repr, question(*raw).collect())) == sorted(map(repr, question(*collapsed).collect()))
    report = validate.report_of(*raw, semantics)
    direct = validate.staleness_report(validate.judge_spans(*raw, semantics), validate.update_counts(*raw))
    assert report.collect() == direct.collect()


def test_verdicts_deal_each_log_by_item_once(spark):
    """From collapsed logs to verdicts: one exchange for the reads, one for the updates, whatever windows follow."""
    reads, updates = validate.collapse_logs(*frames(spark, *random_logs(4)))
    for semantics in validate.SEMANTICS:
        judged = validate.judge_spans(reads, updates, semantics, slices=NO_SLICES)
        plan = judged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(key") == plan.count("Exchange") == 2
