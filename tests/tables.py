"""Test tables, built from ``spark.range`` and hashes so that they do not depend on partitioning."""

from pyspark.sql import functions as F

PLANTED = 3


def uniform(name, seed=0):
    """A number in [0, 1) per row and name."""
    return F.pmod(F.xxhash64("row_id", F.lit(name), F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)


def pick(name, shares, seed=0):
    u, total, out = uniform(name, seed), 0.0, None
    for value, share in shares.items():
        total += share
        out = F.when(u < total, value) if out is None else out.when(u < total, value)
    return out.otherwise(list(shares)[-1])


def staff(spark, n=600):
    """Staff table: the last rows are two (Legal, APAC) pairs, found nowhere else, and one huge salary."""
    last = F.col("row_id") - (n - PLANTED)
    rows = spark.range(n).withColumnRenamed("id", "row_id").select(
        "row_id",
        pick("dept", {"Sales": 0.40, "Engineering": 0.30, "Support": 0.22, "Legal": 0.08}).alias("Department"),
        pick("region", {"NA": 0.5, "EMEA": 0.3, "APAC": 0.2}).alias("Region"),
        pick("seniority", {"Junior": 0.4, "Mid": 0.4, "Senior": 0.2}).alias("Seniority"),
        (F.round((uniform("s1") + uniform("s2") + uniform("s3")) * 20000) + 40000).alias("Salary"),
        F.round((uniform("t1") + uniform("t2")) * 6, 1).alias("TenureYears"))
    return rows.select(
        "row_id", F.when(last.isin(0, 1), "Legal").otherwise(F.col("Department")).alias("Department"),
        F.when(last.isin(0, 1), "APAC").when((F.col("Department") == "Legal") & (F.col("Region") == "APAC"), "NA")
        .otherwise(F.col("Region")).alias("Region"),
        "Seniority", F.when(last == 2, 950000.0).otherwise(F.col("Salary")).alias("Salary"), "TenureYears")


def random_codes(spark, n, sizes, seed):
    """Skewed categorical columns ``a, b, ...``: low values are far more frequent."""
    columns = [F.concat(F.lit("v"), F.floor(F.pow(uniform(f"c{i}", seed), 3.0) * u).cast("string")).alias(chr(97 + i))
               for i, u in enumerate(sizes)]
    return spark.range(n).withColumnRenamed("id", "row_id").select("row_id", *columns)
