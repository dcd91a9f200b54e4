import os
import subprocess
import sys

from pyspark.sql import functions as F

from rarespark.operators import iforest

from .tables import uniform


def test_planted_points_score_highest(spark):
    n = 2000
    df = spark.range(n).withColumnRenamed("id", "row_id").select(
        "row_id", F.when(F.col("row_id") >= n - 3, 50.0 + F.col("row_id")).otherwise(uniform("x") + uniform("y")).alias("x"),
        F.when(F.col("row_id") >= n - 3, -40.0).otherwise(uniform("z")).alias("y"), F.when(uniform("c") < 0.9, "a").otherwise("b").alias("c"))
    out = iforest.isolation_scores(df, ["x", "y", "c"], ["row_id"])
    top = out.orderBy(F.desc("score")).limit(3).collect()
    assert {r["row_id"] for r in top} == {n - 1, n - 2, n - 3} and all(r["flagged"] for r in top)
    assert out.count() == n and out.where("score <= 0 or score >= 1").count() == 0


def test_extremes_that_no_tree_has_seen_score_highest(spark):
    """One row far out and three less far, among so many that the samples miss them."""
    n = 20000
    far = F.when(F.col("row_id") == n, 1e7).when(F.col("row_id") > n, 3000.0)
    df = spark.range(n + 4).withColumnRenamed("id", "row_id").select(
        "row_id", F.coalesce(far, -10 * F.log(1 - uniform("x"))).alias("x"), F.coalesce(far, 60 * uniform("y")).alias("y"))
    for seed in (0, 1, 2):
        out = iforest.isolation_scores(df, ["x", "y"], ["row_id"], trees=40, size=64, seed=seed)
        assert {r["row_id"] for r in out.orderBy(F.desc("score"), "row_id").limit(4).collect()} == {n, n + 1, n + 2, n + 3}
        assert out.where("score > 0 and score < 1").count() == n + 4


def test_samples_hold_the_asked_number_of_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("f0"))
    sizes = {r["tree"]: (r["n"], r["d"]) for r in iforest.tree_samples(df, 5000, 20, 64, 0).groupBy("tree").agg(
        F.count("*").alias("n"), F.count_distinct("f0").alias("d")).collect()}
    assert set(sizes.values()) == {(64, 64)} and len(sizes) == 20
    few = iforest.tree_samples(spark.range(200000).select(F.col("id").alias("f0")), 200000, 10, 16, 0).groupBy("tree").count()
    assert {r["count"] for r in few.collect()} == {16} and few.count() == 10


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Run from another folder, with the package on the driver's path only."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from rarespark.session import build_session\nfrom rarespark.operators import iforest\n"
            "spark = build_session(master='local[2]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'})\n"
            "df = spark.range(300).selectExpr('id AS row_id', 'CAST(id AS DOUBLE) AS x')\n"
            "print('rows', iforest.isolation_scores(df, ['x'], ['row_id']).where('score > 0 AND score < 1').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 300" in out.stdout, out.stderr[-2000:]


def test_fewer_rows_than_the_sample(spark):
    df = spark.range(30).select(F.col("id").alias("row_id"), F.when(F.col("id") == 29, 900.0).otherwise(F.col("id").cast("double")).alias("x"))
    out = iforest.isolation_scores(df, ["x"], ["row_id"])
    assert out.orderBy(F.desc("score")).first()["row_id"] == 29
