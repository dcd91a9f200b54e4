"""All queries with workers that cannot import this package: started in an empty folder, without ``PYTHONPATH``."""

import os
import random
import subprocess
import sys

from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import rarespark.llm.registry as registry
from rarespark.session import build_session
spark = build_session("workers", "local[3]", **{"spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false"})
spark.sparkContext.setLogLevel("OFF")
def probe(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("rarespark") is None
        yield b
spark.range(1).mapInArrow(probe, "id bigint").collect()
for name, query in registry.QUERIES.items():
    print(name, len(query(spark, sys.argv[2]).collect()), flush=True)
"""


def test_all_queries_without_the_package_on_workers(spark, tmp_path):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdefgh" if k else "stuvwxyz") for _ in range(rng.randint(2, 6)))
    docs = [(i, " ".join(word(i % 2) for _ in range(70)) + "." + (" idiot" if i % 3 == 0 else ""), "xy"[i % 2], "s") for i in range(90)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint")),
        "labels": spark.createDataFrame([(i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int"),
        "pages": spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i % 5}</p>") for i in range(9)], "page_id bigint, url string, html string"),
        "embeddings": spark.createDataFrame([(i, [rng.random() for _ in range(8)], i % 2) for i in range(40)], "vec_id bigint, embedding array<float>, label int"),
        "conversations": spark.createDataFrame([(i // 4, i % 4, ("user", "assistant")[i % 2], "Yes.") for i in range(40)],
                                               "conv_id bigint, turn bigint, role string, text string")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/in/{name}.parquet")
    (tmp_path / "empty").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("SPARK_", "PYSPARK_"))}
    run = subprocess.run([sys.executable, "-c", SCRIPT, REPO, f"{tmp_path}/in"], cwd=tmp_path / "empty", env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    seen = dict(line.rsplit(" ", 1) for line in run.stdout.splitlines() if line.startswith("op"))
    rows = {"op3": 9, "op4": 40, "op13": 10}
    assert len(seen) == 13 and all(int(n) == rows.get(q.split("_")[0], 90) for q, n in seen.items())
