import time
from itertools import combinations, product
from math import comb, prod

import pytest
from pyspark.sql import functions as F

from rarespark import RarityConfig, RarityDetector, session
from rarespark.operators import cells, codes
from rarespark.operators.encode import bin_edges
from rarespark.plans import detector, results

from .tables import PLANTED, random_codes, staff

COUNTS = [f"{d}d Counts" for d in range(1, 7)]


@pytest.fixture(scope="module")
def staff_run(spark):
    return RarityDetector(threshold=0.05).fit_predict(staff(spark), id_cols=["row_id"])


def brute_force(rows, threshold, max_dims, marginal, cap=100_000):
    """Rare cells by the step-by-step rule: a cell counts unless a smaller flagged one is inside."""
    n, width = len(rows), len(rows[0])
    sizes = [len({r[i] for r in rows}) for i in range(width)]
    mean = sum(sizes) / width
    flagged, common, rare = set(), {}, {}
    share = [{} for _ in range(width)]
    for r in rows:
        for i, v in enumerate(r):
            share[i][v] = share[i].get(v, 0) + 1 / n
    for d in range(1, max_dims + 1):
        if d > 1 and (d > width or comb(width, d) * mean ** d > cap):
            break
        common[d] = rare[d] = 0
        new = set()
        for s in combinations(range(width), d):
            expected = 1.0 / prod(sizes[i] for i in s)
            if d > 2 and n * expected < 10:
                continue
            counts = {}
            for r in rows:
                key = tuple(r[i] for i in s)
                counts[key] = counts.get(key, 0) + 1
            for values in product(*[sorted(share[i]) for i in s]):
                f = counts.get(values, 0) / n
                is_rare = f < expected * threshold and f < 0.01
                if marginal and d > 1:
                    is_rare = is_rare and f < prod(round(share[i][v] * n) / n for i, v in zip(s, values)) * threshold
                inside = any((tuple(s[i] for i in t), tuple(values[i] for i in t)) in flagged
                             for k in range(1, d) for t in combinations(range(d), k))
                if is_rare and not inside:
                    new.add((s, values))
                    rare[d] += 1
                else:
                    common[d] += 1
        flagged |= new
    scores = []
    for r in rows:
        hits = [0] * 6
        for s, values in flagged:
            hits[len(s) - 1] += all(r[i] == v for i, v in zip(s, values))
        scores.append(hits)
    return scores, common, rare


@pytest.mark.parametrize("seed,sizes,threshold,marginal,dims,group", [
    (1, (4, 5, 6), 0.5, False, 3, 1 << 20),
    (2, (4, 5, 6), 0.9, True, 3, 1 << 20),
    (3, (3, 4, 3, 2), 0.6, False, 4, 1 << 20),
    (4, (2, 3, 2, 3, 2, 2), 0.9, False, 6, 1 << 20),
    (5, (2, 3, 2, 3, 2, 2), 0.9, True, 6, 40),
    (6, (3, 4, 3, 2, 3), 0.8, False, 3, 30),
])
def test_matches_brute_force(spark, seed, sizes, threshold, marginal, dims, group):
    df = random_codes(spark, 700, sizes, seed)
    names = [c for c in df.columns if c != "row_id"]
    rows = [tuple(r[c] for c in names) for r in df.orderBy("row_id").collect()]
    run = RarityDetector(threshold=threshold, max_dimensions=dims, check_marginal_probs=marginal,
                         max_group_patterns=group).fit_predict(df, id_cols=["row_id"])
    got = [[r[c] for c in COUNTS] for r in run.scored_rows().orderBy("row_id").select(*COUNTS).collect()]
    want, common, rare = brute_force(rows, threshold, dims, marginal)
    assert got == want
    assert sum(map(sum, want)) > 0
    assert len(run.plan.groups()) > 1 or group == 1 << 20
    counted = {r["dim"]: (r["common"], r["rare"]) for r in run.combination_counts().collect()}
    assert counted == {d: (common[d], rare[d]) for d in common}
    weighted = run.weighted_scores().groupBy("TOTAL SCORE").agg(F.sum("cnt")).collect()
    assert dict(map(tuple, weighted)) == {k: sum(1 for w in want if sum(w) == k) for k in {sum(w) for w in want}}


@pytest.mark.parametrize("group", [1 << 20, 30])
def test_many_hit_sets_are_joined_by_pattern(spark, monkeypatch, group):
    """Beyond a number of column sets, rows look their hits up by pattern; the results are the same."""
    df = random_codes(spark, 700, (3, 4, 3, 2, 3), 6)
    def run():
        return RarityDetector(threshold=0.8, max_group_patterns=group).fit_predict(df, id_cols=["row_id"])
    few = run()
    monkeypatch.setattr(detector, "LITERAL_SETS", 0)
    many = run()
    assert few.hits is None and many.hits is not None
    assert few.breakdown_all().exceptAll(many.breakdown_all()).isEmpty()
    assert few.flagged_summary().collect() == many.flagged_summary().collect()
    assert many.scores().where(F.col("TOTAL SCORE") > 0).count() > 0


def test_planted_rows_are_flagged_and_few_others(staff_run):
    scores = {r["row_id"]: r["TOTAL SCORE"] for r in staff_run["Scores"].collect()}
    assert all(scores[600 - k] > 0 for k in range(1, PLANTED + 1))
    assert 0 < sum(s > 0 for s in scores.values()) / len(scores) < 0.10


def test_runs_repeat(spark, staff_run):
    again = RarityDetector(threshold=0.05, run_parallel=True).fit_predict(staff(spark).repartition(7), id_cols=["row_id"])
    assert again.scores().exceptAll(staff_run.scores()).isEmpty()


def test_most_flagged_is_sorted_and_keeps_all_columns(spark):
    df = staff(spark).withColumn("note", F.col("row_id").cast("string"))  # too many values to analyse
    top = RarityDetector().fit_predict(df, id_cols=["row_id"]).most_flagged()
    assert top.columns[0] == "TOTAL SCORE" and "note" in top.columns
    scores = [r[0] for r in top.collect()]
    assert scores and scores == sorted(scores, reverse=True) and min(scores) > 0


def test_reasons_use_original_labels(staff_run):
    row = staff_run.breakdown_all().where("row_id = 597").first()
    assert (["Department", "Region"], ["Legal", "APAC"]) in [(r["cols"], r["vals"]) for r in row["2d Explanations"]]
    assert row["4d Explanations"] is None and row["Any up to 2d"] and row["Any Scored"]
    salary = staff_run.breakdown_flagged().where("row_id = 599").first()
    assert [(r["cols"], r["vals"]) for r in salary["1d Explanations"]] == [(["Salary"], ["Very High"])]


def test_no_flagged_cell_contains_another(spark):
    run = RarityDetector(n_bins=4, max_dimensions=6, threshold=0.2, max_num_combinations=10_000_000).fit_predict(
        staff(spark), id_cols=["row_id"])
    cells = [frozenset(zip(r["cols"], r["vals"])) for r in run.rare_cells().collect()]
    assert len(cells) == len(set(cells)) > 0
    assert not any(a < b for a in cells for b in cells)


def test_date_text_stays_categorical_and_number_text_becomes_numeric(spark):
    df = spark.range(200).select(
        F.col("id").alias("row_id"), F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("when"),
        F.format_string("%.2f", F.col("id") * 1.37).alias("number"), (F.col("id") % 3).cast("string").alias("a"),
        F.sqrt("id").alias("b"), F.when(F.col("id") == 7, "12 apples").otherwise(F.col("id").cast("string")).alias("mixed"))
    run = RarityDetector(max_dimensions=2).fit_predict(df, id_cols=["row_id"])
    assert run.domains.kinds == {"when": "-", "number": "N", "a": "C", "b": "N", "mixed": "-"}
    assert run.scores().count() == 200


def test_numbers_spelled_in_many_ways(spark):
    """Few numbers in many spellings: kept as categories, one per spelling, whatever their number."""
    df = spark.range(400).select(F.col("id").alias("row_id"), F.concat(
        (F.col("id") % 3).cast("string"), F.lit("."), F.repeat(F.lit("0"), (F.col("id") % 30).cast("int"))).alias("s"),
        (F.col("id") % 2).cast("string").alias("t"))
    run = RarityDetector(max_dimensions=1).fit_predict(df, id_cols=["row_id"])
    assert run.domains.kinds["s"] == "C"
    assert run.columns[0].size == 30


@pytest.mark.parametrize("broadcast", [True, False])
def test_labels_of_numbers_in_many_spellings_stay_off_the_driver(spark, monkeypatch, broadcast):
    """The same table with labels listed and with labels in a dictionary gives the same cells, scores and reasons."""
    if not broadcast:
        monkeypatch.setattr(cells, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(detector, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(results, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(codes, "RANK_IN_ONE_TASK", 10)
    i = F.col("id")
    spelled = F.concat((i % 3).cast("string"), F.lit("."), F.repeat(F.lit("0"), F.when(i < 900, i % 40).otherwise(40 + i % 60).cast("int")))
    df = spark.range(1000).select(i.alias("row_id"), F.when(i % 50 != 7, spelled).alias("s"),
                                  F.when(i == 77, "odd").otherwise((i % 2).cast("string")).alias("t"), (i % 5).cast("string").alias("u"))
    listed = df.withColumn("s", F.concat(F.lit("x"), F.coalesce("s", F.lit("nan"))))  # no numbers: up to 400 values are listed
    made = RarityDetector(threshold=0.5, max_dimensions=3, check_marginal_probs=True).fit_predict(df, id_cols=["row_id"])
    plain = RarityDetector(threshold=0.5, max_dimensions=3, check_marginal_probs=True, max_values_per_column=400).fit_predict(listed, id_cols=["row_id"])
    assert made.columns[0].dictionary is not None and not made.columns[0].labels and plain.columns[0].dictionary is None
    assert made.columns[0].size == plain.columns[0].size > 100

    def seen(run, spell):
        label = lambda c, v: spell(v) if c == "s" else v
        reasons = lambda r: [[(c, label(c, v)) for c, v in zip(e["cols"], e["vals"])] for d in (1, 2, 3) for e in r[f"{d}d Explanations"] or []]
        rows = sorted((r["row_id"], r["TOTAL SCORE"], reasons(r)) for r in run.breakdown_all().collect())
        rare = sorted((r["dim"], [label(c, v) for c, v in zip(r["cols"], r["vals"])], r["cnt"]) for r in run.rare_cells().collect())
        return rows, rare, results.threshold_sweep(run, [0.9, 0.1, 0.5]).collect(), sorted(map(tuple, run.combination_counts().collect()))
    assert seen(made, lambda v: v) == seen(plain, lambda v: v[1:])


def test_a_dictionary_of_labels_and_nothing_flagged(spark):
    """All rows score 0 where a column has a dictionary and no combination is rare."""
    i = F.col("id")
    spelled = F.concat((i % 3).cast("string"), F.lit("."), F.repeat(F.lit("0"), (i % 120).cast("int")))
    df = spark.range(960).select(i.alias("row_id"), spelled.alias("s"), (i % 2).cast("string").alias("t"))
    run = RarityDetector(threshold=0.01, max_dimensions=2).fit_predict(df, id_cols=["row_id"])
    assert run.columns[0].dictionary is not None and run.rare_cells().count() == 0
    rows = run.scored_rows().collect()
    assert len(rows) == 960 and all((r["TOTAL SCORE"], r["2d Counts"], r["1d Explanations"], r["Any Scored"]) == (0, 0, [], False) for r in rows)
    assert run.flagged_summary().first()["Percent Flagged"] == 0


def test_sweep_of_many_thresholds_and_groups(spark, staff_run):
    """Each share is that of a run of its own, also where rows are counted in several groups of columns."""
    some = [0.25, 0.003, 0.05]
    grouped = RarityDetector(threshold=0.05, max_dimensions=2, max_group_patterns=60).fit_predict(staff(spark), id_cols=["row_id"])
    assert len(grouped.groups) > 1
    swept = {r["threshold"]: r["flagged_pct"] for r in results.threshold_sweep(staff_run, [k / 500 for k in range(200)] + some).collect()}
    assert len(swept) == 201 and [r["flagged_pct"] for r in results.threshold_sweep(grouped, some).collect()] == [swept[t] for t in some]
    assert results.threshold_sweep(staff_run, []).count() == 0


def test_missing_values(spark):
    """Missing categories are a value of their own; missing numbers go where the median is."""
    df = spark.range(300).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 10 > 0, (F.col("id") % 3).cast("string")).alias("c"),
        F.when(F.col("id") == 1, float("nan")).when(F.col("id") == 3, float("inf")).when(F.col("id") == 5, float("-inf"))
        .when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("x"))
    run = RarityDetector(max_dimensions=1).fit_predict(df, id_cols=["row_id"])
    labels = {x.name: dict(zip(x.labels, x.counts)) for x in run.columns}
    assert set(labels["c"]) == {"0", "1", "2", "nan"} and labels["c"]["nan"] == 30
    # 150 even numbers 0..298 plus the two infinities at the ends; 148 missing values fall on the median bin.
    assert sum(labels["x"].values()) == 300
    assert labels["x"]["Med"] == sum(1 for v in range(0, 299, 2) if 3 * 298 / 7 <= v < 4 * 298 / 7) + 148


def test_median_between_two_bins(spark):
    values = [0.0] * 8 + [100.0] * 7 + [float(v) for v in range(1, 16)] + [99.0, 98.0, 97.0, 96.0] + [90.0 + v / 10 for v in range(4)] * 3
    values = sorted(values)
    df = spark.createDataFrame([(i, v, "a" if i % 2 else "b") for i, v in enumerate(values + [None] * 5)], "row_id long, x double, c string")
    run = RarityDetector(max_dimensions=1).fit_predict(df, id_cols=["row_id"])
    n = len(values)
    median = (values[(n - 1) // 2] + values[n // 2]) / 2
    bins = [sum(v >= e for e in bin_edges(0.0, 100.0, 7)) for v in values + [median] * 5]
    names = RarityConfig().bin_names
    assert dict(zip(run.columns[0].labels, run.columns[0].counts)) == {names[b]: bins.count(b) for b in sorted(set(bins))}


def test_time_budget_keeps_one_dimension(spark):
    run = RarityDetector(max_dimensions=6, max_execution_seconds=1e-6, max_num_combinations=10_000_000).fit_predict(
        staff(spark), id_cols=["row_id"])
    assert run.truncated and run.dimensions_examined == 1
    assert "time budget" in run.run_summary()
    assert run.scores().count() == 600


def test_time_budget_keeps_finished_column_sets(spark, monkeypatch):
    """What was counted before the time was up stays; a set that was not counted flags nothing."""
    whole = RarityDetector(threshold=0.5, max_dimensions=3).fit_predict(staff(spark), id_cols=["row_id"])
    calls = []
    real = detector.stage_until
    monkeypatch.setattr(detector, "stage_until", lambda df, deadline: calls.append(1) or (real(df, deadline) if len(calls) < 4 else None))
    run = RarityDetector(threshold=0.5, max_dimensions=3, max_execution_seconds=3600).fit_predict(staff(spark), id_cols=["row_id"])
    kept = {s.members for s in run.plan.sets}
    assert run.truncated and len(calls) == 4 and 5 < len(kept) < len(whole.plan.sets) and run.dimensions_examined == 2
    assert f"Column sets examined: {len(kept)} of {len(whole.plan.sets)}" in run.run_summary()
    names = [x.name for x in run.columns]
    cells = lambda r: {(tuple(x["cols"]), tuple(x["vals"])) for x in r.rare_cells().collect()}
    assert cells(run) == {x for x in cells(whole) if tuple(names.index(n) for n in x[0]) in kept} != cells(whole)


def test_jobs_over_the_deadline_are_cancelled(spark):
    def sleepy(batches):
        for b in batches:
            time.sleep(60)
            yield b
    started = time.monotonic()
    assert session.stage_until(spark.range(8).mapInPandas(sleepy, "id bigint"), started + 2) is None
    assert time.monotonic() - started < 30
    assert session.stage_until(spark.range(8), time.monotonic() - 1) is None
    assert session.stage_until(spark.range(8), time.monotonic() + 60).count() == 8
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        session.stage_until(spark.range(8).selectExpr("1 div (id - id) AS x"), time.monotonic() + 60)


def test_generous_time_budget_changes_nothing(spark, staff_run):
    run = RarityDetector(max_execution_seconds=3600).fit_predict(staff(spark), id_cols=["row_id"])
    assert not run.truncated
    assert run.scores().exceptAll(staff_run.scores()).isEmpty()


def test_one_usable_column(spark):
    df = spark.range(40).select((F.col("id") % 2).cast("string").alias("only"))
    run = RarityDetector().fit_predict(df)
    assert {r["TOTAL SCORE"] for r in run.scores().collect()} == {0}
    assert run.flagged_summary().count() == 0 and run.breakdown_flagged().count() == 0
    assert "Less than two columns" in run.run_summary()


def test_without_ids_results_keep_the_input(spark, staff_run):
    df = staff(spark).drop("row_id")
    scores = RarityDetector().fit_predict(df, id_cols=[]).scores()
    assert scores.columns == [*df.columns, "TOTAL SCORE"]
    want = staff_run.most_flagged().select(*scores.columns)
    assert scores.where(F.col("TOTAL SCORE") > 0).exceptAll(want).isEmpty() and scores.count() == 600


def test_no_rows(spark):
    run = RarityDetector().fit_predict(staff(spark).limit(0), id_cols=["row_id"])
    assert run.scores().count() == 0


def test_gate_stops_higher_dimensions(spark):
    run = RarityDetector(max_dimensions=4, max_num_combinations=500).fit_predict(staff(spark), id_cols=["row_id"])
    checked = run.plan.checked
    assert checked[1] and checked[2] and not checked[3] and not checked[4]
    assert run.plan.estimates[3] / run.plan.estimates[2] > comb(5, 3) / comb(5, 2)


def test_cells_of_a_dimension_stay_within_the_gate(spark, staff_run):
    for d in (2, 3):
        cells = sum(s.product for s in staff_run.plan.sets if s.dim == d)
        assert cells <= staff_run.plan.estimates[d] <= staff_run.cfg.max_num_combinations


def test_refusals(spark):
    df = staff(spark)
    with pytest.raises(ValueError, match="at least 1"):
        RarityConfig(max_dimensions=0)
    with pytest.raises(ValueError, match="TOTAL SCORE"):
        RarityDetector().fit_predict(df.withColumn("TOTAL SCORE", F.lit(1)), id_cols=["row_id"])
    with pytest.raises(TypeError, match="nested"):
        RarityDetector().fit_predict(df.withColumn("v", F.array("Salary")), id_cols=["row_id"])
    with pytest.raises(ValueError, match="feature"):
        RarityDetector().fit_predict(df, features=[], id_cols=["row_id"])
    assert RarityConfig(n_bins=1).n_bins == 2 and RarityConfig(max_dimensions=9).max_dimensions == 6
    assert RarityConfig(n_bins=9).bin_names[8] == "Bin 8" and RarityConfig(n_bins=3, bin_names=("a",)).bin_names[1] == "Med"


def test_odd_column_names(spark):
    df = staff(spark).toDF("row_id", "a.b", "c d", "e`f", "Total $", "it's")
    run = RarityDetector().fit_predict(df, id_cols=["row_id"])
    assert run.breakdown_all().where("row_id = 597").first()["2d Explanations"][0]["cols"] == ["a.b", "c d"]


def test_many_categories_are_joined_not_listed(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.concat(F.lit("k"), (F.col("id") % 200).cast("string")).alias("many"),
                                  F.when(F.col("id") == 77, "odd").otherwise((F.col("id") % 2).cast("string")).alias("few"))
    run = RarityDetector(max_values_per_column=300, max_dimensions=1).fit_predict(df, id_cols=["row_id"])
    assert [x.size for x in run.columns] == [200, 3]
    assert [r["row_id"] for r in run.scores().where(F.col("TOTAL SCORE") > 0).collect()] == [77]


def test_sweep_equals_separate_runs(spark, staff_run):
    swept = {r["threshold"]: r["flagged_pct"] for r in results.threshold_sweep(staff_run).collect()}
    assert list(swept) == [0.005, 0.01, 0.02, 0.05, 0.1, 0.25]
    for t in (0.02, 0.25):
        run = RarityDetector(threshold=t, max_dimensions=2).fit_predict(staff(spark), id_cols=["row_id"])
        alone = run.scores().agg(F.avg((F.col("TOTAL SCORE") > 0).cast("int")) * 100).first()[0]
        assert swept[t] == pytest.approx(alone)


def test_scores_need_no_shuffle(staff_run):
    plan = staff_run.scores()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_breakdown_dump(spark, tmp_path):
    RarityDetector(max_dimensions=2, results_folder=str(tmp_path), results_name="staff").fit_predict(staff(spark), id_cols=["row_id"])
    written = list(tmp_path.glob("staff_results_*.csv"))
    assert len(written) == 1
    back = spark.read.csv(str(written[0]), header=True)
    assert back.count() == 600 and back.where("row_id = 597").first()["2d Explanations"].startswith("Department = Legal AND Region = APAC")


def test_result_views(staff_run):
    assert results.result_cards(staff_run).first()["rows"] == 600
    tables = results.audit_tables(staff_run)
    assert set(tables) == {"parameters", "cards", "score_distribution", "top_rows", "reasons", "summary"}
    assert tables["reasons"].where("row_id = 597").first()["reason"].startswith("2d: Department = Legal AND Region = APAC")
    pairs = results.row_pair_tables(staff_run, {"row_id": 597})
    assert ("Department", "Region") in pairs
    legal = pairs["Department", "Region"].where("Department = 'Legal'").first()
    assert legal["APAC"] == 2
    assert results.inspect_row(staff_run, {"row_id": 597}).count() > 0
    assert "Number of rows: 600" in staff_run.run_summary()


def test_zero_has_one_sign(spark):
    """Minus zero is zero, whether values are listed or patterns are grouped."""
    df = spark.createDataFrame([(i, [0.0, -0.0, 1.0, 2.0][i % 4], "ab"[i % 2]) for i in range(80)], "row_id bigint, x double, y string")
    scores = []
    for limit in (1, 1 << 20):
        result = RarityDetector(max_group_patterns=limit, threshold=0.5).fit_predict(df, features=["x", "y"], id_cols=["row_id"])
        assert {c.name: c.size for c in result.columns}["x"] == 3
        scores.append(sorted(map(tuple, result["Scores"].collect())))
    assert scores[0] == scores[1]
