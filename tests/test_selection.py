"""Exact order statistics, splits and AUC against brute force."""

import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phasegrid.functions.hashing import hash_hex
from phasegrid.operators import metrics as M
from phasegrid.operators import runs as R
from phasegrid.operators import selection as S
from phasegrid.operators import splitting as X

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def numbers(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")


@few
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0])), min_size=1, max_size=40))
def test_exact_median(spark, values):
    known = [v for v in values if v is not None]
    want = statistics.median(known) if known else None
    got = S.exact_median(numbers(spark, values), "v")
    assert got == want or math.isclose(got, want, rel_tol=1e-15)


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [1e-12, 1.0, 1e12], [7.0] * 50 + [1.0] * 20, list(range(10_001)), [i / 7 for i in range(10_000)],
])
def test_exact_median_cases(spark, values):
    assert S.exact_median(numbers(spark, values), "v") == pytest.approx(statistics.median(values), rel=1e-15)


def test_median_of_a_hot_value(spark):
    values = [3.0] * 400 + [float(i) for i in range(600)]
    assert S.exact_median(numbers(spark, values), "v") == statistics.median(values)


def keyed(spark, n, groups=2):
    rows = [(f"k{i}", i % groups) for i in range(n)]
    return spark.createDataFrame(rows, "key string, label int")


@pytest.mark.parametrize("n", [1, 7, 500])
def test_exact_split_sizes_and_order(spark, n):
    split = X.exact_split(keyed(spark, n), ["key"], "label", 0.25, 42)
    rows = split.withColumn("h", hash_hex(F.col("key"), 42)).collect()
    assert len(rows) == n and set(split.columns) == {"key", "label", "is_test"}
    groups = [0, 1] if n > 1 else [None]
    for g in groups:
        mine = sorted([r for r in rows if g is None or r["label"] == g], key=lambda r: (r["h"], r["key"]))
        want = math.floor(len(mine) * 0.25 + 0.5)
        assert [r["is_test"] for r in mine] == [True] * want + [False] * (len(mine) - want)


def lowest(df, wanted):
    """Rows of (g, h, k) that are among the lowest of their group."""
    cuts = S.lowest_cuts(df, S.digit_counts(df), wanted)
    return S.among_lowest(df, "g", "h", "k", cuts, "taken").where("taken")


def test_tied_hashes_are_cut_by_key(spark):
    rows = [(f"k{i:03d}", 0, "0000000a") for i in range(50)] + [("z", 0, "00000001")]
    df = spark.createDataFrame(rows, "k string, g int, h string")
    assert {r["k"] for r in lowest(df, F.lit(11)).collect()} == {"z", *[f"k{i:03d}" for i in range(10)]}


def test_equal_keys_stay_together(spark):
    df = spark.createDataFrame([("same", 0, "00000001")] * 40 + [("other", 0, "0000000f")], "k string, g int, h string")
    assert lowest(df, F.lit(5)).count() == 40


def test_cut_larger_than_the_group_and_groups_without_one(spark):
    df = keyed(spark, 15, 3).select(F.col("label").alias("g"), hash_hex(F.col("key"), 1).alias("h"), F.col("key").alias("k"))
    df = df.unionByName(spark.createDataFrame([(None, "00000000", "n")], "g int, h string, k string"))
    kept = lowest(df, F.when(F.col("g") == 0, 99).when(F.col("g") == 1, 2).otherwise(0)).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in kept} == {0: 5, 1: 2}


@few
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40)), max_size=80), st.integers(0, 9))
def test_lowest_equals_a_sort(spark, cells, wanted):
    rows = [(g, f"{h * 104_729:08x}", f"k{i:02d}") for i, (g, h) in enumerate(cells)]
    got = sorted(map(tuple, lowest(spark.createDataFrame(rows, "g int, h string, k string"), F.lit(wanted)).select("g", "h", "k").collect()))
    assert got == sorted(r for g in range(4) for r in sorted(x for x in rows if x[0] == g)[:wanted])


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_thousands_of_classes_share_one_plan(spark):
    few_classes, many = keyed(spark, 12_000, 3), keyed(spark, 12_000, 5000)
    sample = X.balanced_sample(many, ["key"], "label", 10_007)
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    whole = {g: (12_000 - g + 4999) // 5000 for g in range(5000)}
    assert counts == {g: min(whole[g], 2 + (g < 7)) for g in range(5000)}
    same = X.balanced_sample(few_classes, ["key"], "label", 10_007)
    assert abs(plan_size(sample) - plan_size(same)) < 200
    hashed = {r["key"]: r["h"] for r in many.select("key", hash_hex(F.col("key"), 42).alias("h")).collect()}
    first = {r["label"]: r["key"] for r in X.balanced_sample(many, ["key"], "label", 5000).collect()}
    assert all(hashed[first[g]] == min(hashed[f"k{i}"] for i in range(g, 12_000, 5000)) for g in (0, 17, 4999))


def reads(spark, tmp_path, name, rows, act):
    """How many times ``act`` reads all rows of a written table."""
    path = f"{tmp_path}/{name}"
    rows.write.parquet(path)
    source = spark.read.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    act(source.mapInArrow(count, source.schema)).collect()
    return seen.value / source.count()


def test_how_often_tables_are_read(spark, tmp_path):
    df = keyed(spark, 3000).withColumn("s", F.col("key").substr(2, 9).cast("double"))
    assert reads(spark, tmp_path, "split", df, lambda d: X.exact_split(d, ["key"], "label")) <= 3.01 + 1  # a tie pass at most
    assert reads(spark, tmp_path, "auc", df, lambda d: M.roc_auc(d, "label", "s")) == 1
    runs = df.selectExpr("key as run_id", "s / 3000 as accuracy", "0.5 as f1", "0.5 as roc_auc", "0.4 as baseline_accuracy")
    assert reads(spark, tmp_path, "runs", runs, R.compare_runs) == 1


def test_balanced_sample(spark):
    rows = [(f"k{i}", int(i < 30)) for i in range(1000)]
    sample = X.balanced_sample(spark.createDataFrame(rows, "key string, label int"), ["key"], "label", 300)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 150, 1: 30}


def test_sample_hands_out_the_remainder(spark):
    assert X.balanced_sample(keyed(spark, 700, 7), ["key"], "label", 300).count() == 300


def test_many_classes_split_as_one_group(spark):
    assert X.exact_split(keyed(spark, 3000, 1500), ["key"], "label").where("is_test").count() == 750


def test_splits_cover_the_keys_and_repeat(spark):
    df = keyed(spark, 2000)
    first = X.hash_split(df, ["key"], 0.3, 7).select("key", "is_test")
    again = X.hash_split(df.repartition(5), ["key"], 0.3, 7).select("key", "is_test")
    assert first.count() == 2000 and first.exceptAll(again).isEmpty()
    assert 0.25 < first.where("is_test").count() / 2000 < 0.35
    assert X.hash_split(df, ["key"], 1.0).where("is_test").count() == 2000
    assert X.hash_split(df, ["key"], 0.0).where("is_test").count() == 0


def brute_auc(pairs):
    pos, neg = [s for y, s in pairs if y == 1], [s for y, s in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def auc(spark, pairs):
    return M.roc_auc(spark.createDataFrame(pairs, "y int, s double"), "y", "s").first()[0]


@few
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12).map(lambda i: i / 12)), min_size=1, max_size=60))
def test_auc_with_ties(spark, pairs):
    got, want = auc(spark, pairs), brute_auc(pairs)
    assert (got is None and want is None) or math.isclose(got, want, abs_tol=1e-12)


def test_auc_in_many_chunks_with_a_hot_score(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 1), 0.5 if i % 3 == 0 else rng.random()) for i in range(1500)]
    got = auc(spark, pairs)
    assert math.isclose(got, brute_auc(pairs), abs_tol=1e-12)
    assert math.isclose(auc(spark, [(y, -s) for y, s in pairs]), 1 - got, abs_tol=1e-12)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_ranges(spark, descending):
    rows = [(float(i * 7919 % 4001), i % 13, 1) for i in range(4001)]
    got = S.running_totals(spark.createDataFrame(rows, "v double, a int, b int"), "v", {"x": "a", "y": "b"}, descending).collect()
    ordered = sorted(rows, reverse=descending)
    want, x = {}, 0
    for y, (v, a, _) in enumerate(ordered):
        want[v] = (x, y)
        x += a
    assert len(got) == 4001 and all((r["x"], r["y"]) == want[r["v"]] for r in got)


def test_rank_of_runs(spark):
    rows = [(i, 0.0 if i % 3 else (i * 37 % 50) / 50, 0.5, None, 0.4) for i in range(120)]
    runs = spark.createDataFrame(rows, "run_id int, accuracy double, f1 double, roc_auc double, baseline_accuracy double")
    got = {r["run_id"]: r["accuracy_rank"] for r in R.compare_runs(runs).collect()}
    assert got == {i: 1 + sum(o[1] > a for o in rows) for i, a, *_ in rows}


def test_scores_that_are_no_number_are_left_out(spark):
    assert auc(spark, [(1, 0.9), (0, 0.1), (0, float("nan")), (1, float("nan")), (1, None), (None, 0.5)]) == 1.0
    assert auc(spark, [(1, float("nan")), (0, 0.1)]) is None


def test_readiness_of_large_gains_with_a_middling_f1(spark):
    gate = lambda a, f, b: spark.range(1).select(R.readiness(F.lit(a), F.lit(f), F.lit(b))).first()[0]
    assert gate(0.80, 0.70, 0.70) == "screening" and gate(0.80, 0.70, 0.75) == "screening" and gate(0.80, 0.73, 0.70) == "strong"
    assert gate(0.80, 0.62, 0.70) == "borderline"


def test_grid_of_very_many_classes_raises(spark):
    df = spark.createDataFrame([(5000, 1), (3, 3)], "y int, p int")
    with pytest.raises(ValueError, match="dense=False"):
        M.confusion_matrix(df, "y", "p")
    assert sorted(map(tuple, M.confusion_matrix(df, "y", "p", dense=False).collect())) == [(3, 3, 1), (5000, 1, 1)]


def test_keys_of_different_rows_differ(spark):
    from phasegrid.functions.hashing import row_key

    rows = [("a-b", "c"), ("a", "b-c"), ("a", None), (None, "a"), ("", "a"), ("a", ""), ("1:a", "b"), ("1", "a1:b")]
    assert spark.createDataFrame(rows, "x string, y string").select(row_key(["x", "y"])).distinct().count() == len(rows)


def jobs(spark, act):
    group = f"count-{act.__name__}-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    out = act()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup(None, None)
    return out, found


def test_median_needs_few_passes_at_any_scale(spark, monkeypatch):
    decades = [10.0**e for e in range(-200, 200)]

    def median():
        return S.exact_median(numbers(spark, decades), "v")

    got, wide = jobs(spark, median)
    assert got == statistics.median(decades)
    decades = [float(e) for e in range(400)]
    assert jobs(spark, median) == (199.5, wide) and wide <= 6
    monkeypatch.setattr(S, "LISTED", 20)
    rng = random.Random(2)
    for values in ([rng.gauss(0, 1) ** 9 for _ in range(30_000)], [float(i // 900) for i in range(30_001)], [-math.inf, *range(5000), math.inf, math.inf]):
        assert S.exact_median(numbers(spark, values), "v") == statistics.median(values)
    assert S.exact_median(numbers(spark, [math.nan, 1.0, None, 3.0]), "v") == 2.0


def test_fast_split_is_stable_and_close_to_the_share(spark):
    df = keyed(spark, 4000)
    first = X.hash_split(df, ["key"], 0.3, 7, "xxhash64").select("key", "is_test")
    again = X.hash_split(df.repartition(5), ["key"], 0.3, 7, "xxhash64").select("key", "is_test")
    assert first.exceptAll(again).isEmpty() and 0.27 < first.where("is_test").count() / 4000 < 0.33
    assert X.hash_split(df, ["key"], 1.0, 7, "xxhash64").where("NOT is_test").isEmpty()
    with pytest.raises(ValueError):
        X.hash_split(df, ["key"], 0.3, 7, "sha")


def test_a_large_group_is_marked_by_many_tasks(spark):
    """The marking join does not put all rows of one class in one task, and still marks the lowest."""
    df = spark.range(8000).select((F.col("id") < 0).cast("int").alias("g"), hash_hex(F.col("id").cast("string"), 3).alias("h"), F.col("id").cast("string").alias("k"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = S.digit_counts(df)
        marked = S.among_lowest(df, "g", "h", "k", S.lowest_cuts(df, counts, F.lit(2000)), "taken")
        per_task = marked.groupBy(F.spark_partition_id()).count().collect()
        rows = sorted(map(tuple, marked.select("h", "k", "taken").collect()))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert max(r["count"] for r in per_task) < 4000
    assert [t for _, _, t in rows] == [True] * 2000 + [False] * 6000
