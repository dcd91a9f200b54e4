import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rarespark import FeatureEngineeringConfig, PreprocessConfig
from rarespark.functions.columns import col
from rarespark.operators import codes, prep, profile
from rarespark.operators.features import apply_feature_engineering, encode_for_model
from rarespark.operators.quantiles import exact_quantiles

from .tables import uniform


@pytest.fixture
def frame(spark):
    rows = [(1.0, "a", 1, "2024-01-01"), (2.0, "b", 1, "2024-02-01"), (float("nan"), None, 1, "2024-03-01"),
            (4.0, "b", 1, "2024-04-01"), (100.0, "b", 1, "2024-05-01")]
    return spark.createDataFrame(rows, "num double, cat string, const int, when string")


def only(**cfg):
    return PreprocessConfig(**{"numeric_impute": "none", "categorical_impute": "none", **cfg})


def test_drops(frame):
    out, log = prep.apply_preprocessing(frame, PreprocessConfig(drop_columns=["when", "absent"], drop_constant_columns=True))
    assert out.columns == ["num", "cat"]
    assert log[0] == "Dropped 1 user-selected columns: ['when']"
    assert log[1] == "Dropped constant columns: ['const']"


def test_median_and_mode(frame):
    out, log = prep.apply_preprocessing(frame, PreprocessConfig())
    assert sorted(r["num"] for r in out.collect()) == [1.0, 2.0, 3.0, 4.0, 100.0]
    assert sorted(r["cat"] for r in out.collect()) == ["a", "b", "b", "b", "b"]
    assert log == ["Numeric imputation: median", "Categorical imputation: mode"]


def test_constant_fill_and_zero(frame):
    out, _ = prep.apply_preprocessing(frame, PreprocessConfig(numeric_impute="zero", categorical_impute="constant", categorical_fill_value="MISSING"))
    assert out.where("cat = 'MISSING'").first()["num"] == 0.0


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("b",)], "c string")
    assert prep.column_modes(df, ["c"]) == {"c": "a"}


def test_clipping(frame):
    iqr, _ = prep.apply_preprocessing(frame, only(outlier_treatment="iqr_clip"))
    q1, q3 = np.quantile([1, 2, 4, 100], [0.25, 0.75])
    assert iqr.agg(F.max("num")).first()[0] == pytest.approx(q3 + 1.5 * (q3 - q1))
    assert iqr.where("num is null").count() == 1  # clipping fills nothing
    z, _ = prep.apply_preprocessing(frame, only(outlier_treatment="zscore_clip", zscore_threshold=1.0))
    values = pd.Series([1, 2, 4, 100])
    assert z.agg(F.max("num")).first()[0] == pytest.approx(values.mean() + values.std())


def test_scaling_leaves_columns_without_spread(frame):
    for how in ("standard", "minmax", "robust"):
        out, _ = prep.apply_preprocessing(frame, only(scaling=how))
        assert {r["const"] for r in out.collect()} == {1}


def test_row_drops_and_counts(frame):
    out, log = prep.apply_preprocessing(frame, PreprocessConfig(numeric_impute="drop_rows", categorical_impute="drop_rows"))
    assert out.count() == 4 and log == ["Dropped 1 rows with missing numeric values", "Dropped 0 rows with missing categorical values"]


def test_duplicates_with_and_without_ids(spark):
    df = spark.createDataFrame([(3, "a", float("nan")), (1, "a", float("nan")), (2, "b", 1.0), (4, "b", None)], "id long, c string, x double")
    out, log = prep.apply_preprocessing(df, only(drop_duplicates=True), ["id"])
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 4] and log[0] == "Dropped duplicate rows: 1"
    assert prep.apply_preprocessing(df.drop("id"), only(drop_duplicates=True))[0].count() == 3


@pytest.mark.parametrize("ids", [["id"], ["id", "c"], []])
def test_duplicates_whatever_the_digests(spark, monkeypatch, ids):
    """Equal digests of unlike rows cost work, not rows; missing values are told from each other by column."""
    rows = [(i, f"t{i % 7}" if i % 5 else None, float(i % 3) if i % 4 else None) for i in range(200)] + [(500, None, 0.0), (501, None, -0.0)]
    df = spark.createDataFrame(rows, "id long, c string, x double").repartition(4)
    values = [n for n in df.columns if n not in ids]
    want = {}
    for row in rows:
        row = dict(zip(df.columns, row))
        key = tuple(row[n] for n in values)
        want[key] = min(want.get(key, (1 << 40, "~")), tuple("" if row[n] is None else row[n] for n in ids)) if ids else ()

    def distinct():
        got = prep.drop_duplicates(df, ids).collect()
        assert len(got) == len(want) and {tuple(r[n] for n in values) for r in got} == set(want)
        if ids == ["id"]:
            assert all(want[r["c"], r["x"]] == (r["id"],) for r in got)
    distinct()
    monkeypatch.setattr(prep, "BROADCAST_BYTES", 0)
    distinct()
    monkeypatch.setattr(prep, "row_digest", lambda df, columns: [F.lit(1).cast("bigint").alias("__a"), F.lit(2).cast("bigint").alias("__b")])
    distinct()


def test_duplicates_shuffle_no_texts(spark, tmp_path):
    spark.range(1000).select("id", F.repeat(F.col("id").cast("string"), 50).alias("text")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = prep.drop_duplicates(df.unionByName(df.where("id = 5").withColumn("id", F.lit(2000).cast("bigint"))), ["id"])._jdf.queryExecution().executedPlan().toString()
    hashed = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(hashed) == 1 and "BroadcastHashJoin" in plan  # the copies only


@pytest.mark.parametrize("fill", ["none", "mean", "median", "zero", "drop_rows"])
@pytest.mark.parametrize("texts", ["none", "drop_rows"])
def test_quantiles_carried_through_the_chain(spark, fill, texts):
    """Fill, clip and scale as one plan give what three separate looks at the rows give."""
    i = F.col("id")
    df = spark.range(997).select("id", F.when(i % 9 > 2, (i * i) % 611).cast("double").alias("x"), F.when(i % 10 > 0, (i % 4).cast("int")).alias("few"),
                                 F.when(i % 7 > 0, i % 13 - 6).alias("whole"), F.lit(None).cast("double").alias("none"), F.when(i == 5, 2.5).alias("one"),
                                 F.when(i % 6 > 0, "c").alias("c"))
    numbers = ["x", "few", "whole"] if fill == "drop_rows" else ["x", "few", "whole", "none", "one"]
    df = df.select("id", *numbers, "c")
    cfg = PreprocessConfig(numeric_impute=fill, categorical_impute=texts, outlier_treatment="iqr_clip", iqr_factor=0.5, scaling="robust")
    got = prep.apply_preprocessing(df, cfg, ["id"])[0]
    want = prep.drop_missing_rows(df, numbers) if fill == "drop_rows" else prep.impute_numeric(df, numbers, fill) if fill != "none" else df
    want = prep.drop_missing_rows(want, ["c"]) if texts == "drop_rows" else want
    want = prep.scale_robust(prep.clip_iqr(want, numbers, 0.5), numbers)
    assert got.dtypes == want.dtypes
    rows = lambda d: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.orderBy("id").collect()]
    assert rows(got) == rows(want) and got.count() > 400


def test_chain_with_infinities(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(math.inf,), (None,)], "x double")
    out = prep.apply_preprocessing(df, PreprocessConfig(outlier_treatment="iqr_clip", scaling="robust"))[0]
    want = prep.scale_robust(prep.clip_iqr(prep.impute_numeric(df, ["x"], "median"), ["x"], 1.5), ["x"])
    assert sorted(r["x"] for r in out.collect()) == sorted(r["x"] for r in want.collect())


def test_high_missing(spark):
    df = spark.range(10).select("id", F.when(F.col("id") == 0, 1).alias("x"), F.when(F.col("id") < 2, 1).alias("y"))
    out, log = prep.apply_preprocessing(df, only(drop_high_missing=True))
    assert out.columns == ["id", "y"] and log == ["Dropped 1 columns with >= 90% missing: ['x']"]


def test_encodings(frame):
    hot, _ = prep.apply_preprocessing(frame.drop("when"), only(categorical_encoding="onehot"))
    assert hot.columns == ["num", "const", "cat_a", "cat_b"]
    assert [(r["cat_a"], r["cat_b"]) for r in hot.where("num is null").collect()] == [(False, False)]
    coded, _ = prep.apply_preprocessing(frame.drop("when"), only(categorical_encoding="ordinal"))
    assert sorted(r["cat"] for r in coded.collect()) == [-1, 0, 1, 1, 1]
    with pytest.raises(ValueError, match="one-hot"):
        prep.one_hot(frame, ["when"], limit=3)
    assert len(prep.one_hot(frame, ["when"]).columns) == 3 + 5
    with pytest.raises(ValueError, match="scaling must be one of"):
        PreprocessConfig(scaling="log")


def test_parallel_ranks_equal_sorted_ranks(spark, monkeypatch):
    monkeypatch.setattr(codes, "RANK_IN_ONE_TASK", 10)
    monkeypatch.setattr(codes, "BROADCAST_BYTES", 0)
    df = spark.range(500).select("id", F.concat(F.lit("x"), F.sha2(F.col("id").cast("string"), 256)).alias("c"),
                                 (F.col("id") % 4).cast("string").alias("d"))
    got = prep.ordinal(df, ["c", "d"]).toPandas().sort_values("id")
    want = df.toPandas().sort_values("id")
    for c in ("c", "d"):
        assert list(got[c]) == list(pd.Categorical(want[c]).codes)


@pytest.mark.parametrize("limit", [4, 100, 1 << 16])
def test_exact_quantiles(spark, limit):
    u = uniform("u")
    df = spark.range(3000).withColumnRenamed("id", "row_id").select(
        u.alias("flat"), F.exp(u * 600 - 300).alias("wide"), F.when(u < 0.4, 5.0).otherwise(F.floor(u * 50)).alias("hot"),
        F.when(u < 0.3, None).otherwise((u - 0.6) * 1e9).alias("gaps"), F.lit(2.0).alias("same"), F.lit(None).cast("double").alias("none"))
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, {c: col(c) for c in df.columns}, probabilities, limit)
    values = df.toPandas().astype(float)
    assert got["none"] is None
    for c in df.columns[:-1]:
        np.testing.assert_allclose(got[c], values[c].dropna().quantile(probabilities), rtol=1e-12)


def test_quantiles_with_infinities(spark):
    df = spark.createDataFrame([(float(v),) for v in (-math.inf, 1, 2, 3, math.inf)], "x double")
    assert exact_quantiles(df, {"x": col("x")}, [0.0, 0.5, 1.0], 2)["x"] == [-math.inf, 2.0, math.inf]


def test_features(frame):
    cfg = FeatureEngineeringConfig(parse_datetimes=["when", "absent"], datetime_parts=["year", "month", "era"], log_transform=["num", "cat"],
                                   bin_columns=["num", "const"], bin_count=2, interactions=[("num", "num_log")], ratios=[("num", "const")])
    out, log = apply_feature_engineering(frame, cfg)
    rows = out.orderBy("when_month").collect()
    assert "when" not in out.columns and [r["when_month"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r["num_bin"] for r in rows] == [0, 0, None, 1, 1] and {r["const_bin"] for r in rows} == {None}
    assert rows[4]["num_x_num_log"] == pytest.approx(100 * math.log1p(100)) and rows[2]["num_log"] is None
    assert "log1p('num')" in log and not any("cat" in line for line in log)


def test_ratio_with_zero_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 4.0)], "a double, b double")
    out, _ = apply_feature_engineering(df, FeatureEngineeringConfig(ratios=[("a", "b")]))
    assert [r["a_div_b"] for r in out.orderBy("a").collect()] == [None, 0.5]


def test_bins_match_the_usual_quantile_cut(spark):
    df = spark.range(100).select("id", (F.col("id") % 5 * 4 + F.col("id") % 3).cast("double").alias("x"))
    out, _ = apply_feature_engineering(df, FeatureEngineeringConfig(bin_columns=["x"], bin_count=4))
    got = out.toPandas().sort_values("id")
    assert list(got["x_bin"]) == list(pd.qcut(got["x"], 4, duplicates="drop", labels=False))


def test_bad_dates_become_missing(spark):
    df = spark.createDataFrame([("2024-02-29 13:00:00",), ("no date",), (None,)], "t string")
    out, _ = apply_feature_engineering(df, FeatureEngineeringConfig(parse_datetimes=["t"], datetime_parts=["hour", "weekday", "quarter"]))
    assert {tuple(r) for r in out.collect()} == {(13, 3, 1), (None, None, None)}


def test_encode_for_model(frame):
    out = encode_for_model(frame).toPandas()
    assert not out.isna().any().any() and all(np.issubdtype(t, np.number) for t in out.dtypes) and out.shape == (5, 4)


def test_column_summary(frame):
    rows = {r["Column"]: r for r in profile.column_summary(frame).collect()}
    assert rows["num"]["Missing"] == 1 and rows["num"]["Missing %"] == 20.0 and rows["num"]["Unique"] == 4
    assert rows["cat"]["Sample"] == "a, b, b" and rows["cat"]["Non-null"] == 4


def test_sample_found_past_the_head(spark):
    df = spark.range(100).select("id", F.when(F.col("id") > 90, F.col("id")).alias("late"))
    sample = {r["Column"]: r["Sample"] for r in profile.column_summary(df, ["id"]).collect()}
    assert sample == {"id": "0, 1, 2", "late": "91, 92, 93"}


def test_datetime_suggestions(spark):
    df = spark.createDataFrame([("x", 1, datetime.date(2024, 1, 1), "y", "z")], "event_date string, width int, d date, plain string, Timestep string")
    assert profile.suggest_datetime_columns(df) == ["event_date", "width", "d", "Timestep"]


def test_long_values_are_ranked_once_and_joined_by_key(spark, monkeypatch):
    """Ranks of long texts with common beginnings; past the table of values no staged table holds a long text."""
    monkeypatch.setattr(codes, "RANK_IN_ONE_TASK", 10)
    monkeypatch.setattr(codes, "BROADCAST_BYTES", 0)
    tables, stage = [], codes.stage
    monkeypatch.setattr(codes, "stage", lambda df: tables.append(stage(df)) or tables[-1])
    long = "x" * 500
    texts = [None, "", "a" * 32, "a" * 33, "é" * 16, "é" * 17, *[f"{long}{i}" for i in range(60)], *[f"{i}" for i in range(30)], f"{long}7", None]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, t string").withColumn("u", F.when(F.col("row_id") % 3 > 0, F.concat(F.lit(long), F.col("row_id") % 5)))
    rows = {r["row_id"]: (r["t"], r["u"]) for r in df.collect()}
    rank = [{v: i for i, v in enumerate(sorted({r[k] for r in rows.values()} - {None}, key=str.encode))} | {None: -1} for k in (0, 1)]
    got = {r["row_id"]: (r["t"], r["u"]) for r in prep.ordinal(df, ["t", "u"]).collect()}
    assert got == {i: (rank[0][t], rank[1][u]) for i, (t, u) in rows.items()}
    assert len(tables) > 1 and all(t.agg(F.max(F.octet_length("value"))).first()[0] <= 64 for t in tables[1:])
