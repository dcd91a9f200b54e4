"""Stored datasets and runs: Parquet folders and a log of changes below one root."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import col, is_nested
from ..plans.compare import score_column

LOG = ("version bigint, op string, dataset_id bigint, name string, content_hash string, n_rows bigint, n_cols int, columns_json string, created_at string, "
       "run_id bigint, label string, params_json string, summary_json string, n_flagged bigint, run_summary string, place string")
RUN = ("run_id", "dataset_id", "label", "created_at", "params_json", "summary_json", "n_flagged", "run_summary", "place")


def table_fingerprint(df: DataFrame) -> str:
    """Content hash of a table that does not depend on row order or file layout.

    Sums of two row hashes, so duplicates count; one aggregate, no shuffle of rows.
    """
    def seen(i: int, f: T.StructField):
        """A hash that tells the column, and a missing value from none: Spark's own hashes pass over missing values."""
        value = F.to_json(F.struct(col(f.name)), {"ignoreNullFields": "false"}) if is_nested(f.dataType) else col(f.name)
        return F.when(col(f.name).isNull(), F.lit(-1 - i).cast("bigint")).otherwise(F.xxhash64(F.lit(i), value))

    columns = [seen(i, f) for i, f in enumerate(df.schema)]
    total = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    row = df.agg(F.count("*").alias("n"), total(F.xxhash64(*columns)).alias("a"),
                 total(F.xxhash64(F.lit(1), *columns, F.hash(*columns))).alias("b"))
    digest = F.sha2(F.concat_ws("|", F.lit(df.schema.json()), F.col("n").cast("string"), "a", "b"), 256)
    return row.select(digest).first()[0]


class Conflict(Exception):
    """Another writer has committed the version first."""


class Catalog:
    """Datasets and detector runs below ``root``, for any number of writers.

    What is stored is told by a log: one small file per change, numbered without gaps, never changed. A writer stores its data under a name of its own, looks at
    the log, and commits by making the next file, which only one writer can do; whoever comes second looks again and retries. So ids are neither
    lost nor given twice, equal content is stored once however many save it together, and readers see whole changes only. A
    deletion is a record too; the data go after it. The file system must refuse to rename onto a file that exists, as HDFS does; on a local
    disk a hard link does the same.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- files ------------------------------------------------------------------------------------

    def _path(self, *parts) -> str:
        return "/".join([self.root, *map(str, parts)])

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    # -- log --------------------------------------------------------------------------------------

    def _last_version(self) -> int:
        fs, folder = self._fs(self._path("log"))
        return max((int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(folder)
                    if not f.getPath().getName().startswith("_")), default=0) if fs.exists(folder) else 0

    def _publish(self, version: int, entry: dict) -> None:
        """Make file ``version`` of the log, if nobody has."""
        fs, draft = self._fs(self._path("log", f"_{uuid.uuid4().hex}"))
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({**entry, "version": version}), "utf-8"))
        out.close()
        target = self._fs(self._path("log", f"{version:012d}.json"))[1]
        try:
            if fs.getScheme() == "file":
                jvm = self.spark._jvm
                at = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
                try:
                    jvm.java.nio.file.Files.createLink(at(target), at(draft))
                except Py4JJavaError as e:
                    if "FileAlreadyExistsException" in str(e.java_exception):
                        raise Conflict from None
                    raise
            elif not fs.rename(draft, target):
                raise Conflict
        finally:
            fs.delete(draft, False)

    def _commit(self, change):
        """Commit the entry that ``change(log)`` makes of the log's present state, again until nobody was faster; without an entry nothing is committed.

        ``change`` returns the entry (or ``None``) and the result of the call.
        """
        while True:
            version = self._last_version()
            entry, result = change(self._log(version))
            if entry is None:
                return result
            try:
                self._publish(version + 1, entry)
                return result
            except Conflict:
                continue

    def _log(self, version: int | None = None) -> DataFrame:
        """All entries up to ``version``."""
        version = self._last_version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(self._path("log", "*.json")).where(F.col("version") <= version)

    @staticmethod
    def _alive(log: DataFrame, kind: str) -> DataFrame:
        """Entries of a kind that no later entry has deleted."""
        purged = F.max(F.when(F.col("op") == "purge", F.col("version")))
        gone = log.agg(F.coalesce(purged, F.lit(0)).alias("purged"), F.collect_set(F.when(F.col("op") == f"delete_{kind}", F.col(f"{kind}_id"))).alias("gone"),
                       F.collect_set(F.when(F.col("op") == "delete_dataset", F.col("dataset_id"))).alias("gone_datasets"))
        row = gone.first()
        rows = log.where((F.col("op") == kind) & (F.col("version") > row["purged"]))
        return rows.where(~F.col(f"{kind}_id").isin(*row["gone"]) & ~F.col("dataset_id").isin(*row["gone_datasets"]))

    @staticmethod
    def _next(log: DataFrame, kind: str) -> int:
        return (log.where(F.col("op") == kind).agg(F.max(f"{kind}_id")).first()[0] or 0) + 1

    # -- datasets ---------------------------------------------------------------------------------

    def save_dataset(self, df: DataFrame, name: str) -> int:
        """Store a table; one with the same content is not stored again, its id is returned."""
        digest = table_fingerprint(df)
        stored: list = []

        def change(log: DataFrame):
            known = self._alive(log, "dataset").where(F.col("content_hash") == digest).select("dataset_id").first()
            if known:
                return None, known["dataset_id"]
            if not stored:
                place = uuid.uuid4().hex
                df.write.parquet(self._path("data", place))
                stored.extend([place, self.spark.read.parquet(self._path("data", place)).count()])
            number = self._next(log, "dataset")
            return {"op": "dataset", "dataset_id": number, "name": name, "content_hash": digest, "n_rows": stored[1], "n_cols": len(df.columns),
                    "columns_json": json.dumps(df.columns), "created_at": _now(), "place": stored[0]}, number

        number = self._commit(change)
        if stored and self._dataset(number)["place"] != stored[0]:
            self._delete(self._path("data", stored[0]))  # somebody saved the same content meanwhile
        return number

    def _dataset(self, dataset_id: int):
        row = self._alive(self._log(), "dataset").where(F.col("dataset_id") == dataset_id).first()
        if row is None:
            raise KeyError(f"No dataset with id={dataset_id}")
        return row

    def list_datasets(self) -> DataFrame:
        return (self._alive(self._log(), "dataset").select("dataset_id", "name", "n_rows", "n_cols", "created_at")
                .orderBy(F.desc("created_at"), F.desc("dataset_id")))

    def load_data(self, dataset_id: int) -> DataFrame:
        return self.spark.read.parquet(self._path("data", self._dataset(dataset_id)["place"]))

    load_dataset = load_data

    def delete_dataset(self, dataset_id: int) -> None:
        """Remove a dataset with its runs and their results."""
        def change(log: DataFrame):
            data = self._alive(log, "dataset").where(F.col("dataset_id") == dataset_id).select("place").collect()
            runs = self._alive(log, "run").where(F.col("dataset_id") == dataset_id).select("place").collect()
            return ({"op": "delete_dataset", "dataset_id": dataset_id} if data else None), [("data", r["place"]) for r in data] + [("results", r["place"]) for r in runs]
        for folder, place in self._commit(change):
            self._delete(self._path(folder, place))

    # -- runs -------------------------------------------------------------------------------------

    def save_run(self, dataset_id: int, label: str, params: dict, summary: list | dict, results: DataFrame,
                 run_summary: str = "") -> int:
        """Store a run with its breakdown of all rows."""
        place = uuid.uuid4().hex
        results.write.parquet(self._path("results", place))
        stored = self.spark.read.parquet(self._path("results", place))
        flagged = stored.where(score_column(stored) > 0).count()

        def change(log: DataFrame):
            number = self._next(log, "run")
            return {"op": "run", "run_id": number, "dataset_id": dataset_id, "label": label, "created_at": _now(), "params_json": json.dumps(params, default=str),
                    "summary_json": json.dumps(summary, default=str), "n_flagged": flagged, "run_summary": run_summary, "place": place}, number
        return self._commit(change)

    def list_runs(self, dataset_id: int | None = None) -> DataFrame:
        log = self._log()
        runs = self._alive(log, "run")
        if dataset_id is not None:
            runs = runs.where(F.col("dataset_id") == dataset_id)
        names = self._alive(log, "dataset").select("dataset_id", F.col("name").alias("dataset_name"))
        return (runs.select("run_id", "label", "created_at", "n_flagged", "dataset_id").join(names, "dataset_id")
                .select("run_id", "label", "created_at", "n_flagged", "dataset_name", "dataset_id")
                .orderBy(F.desc("created_at"), F.desc("run_id")))

    def load_run(self, run_id: int) -> dict:
        """Metadata and results of a run."""
        row = self._alive(self._log(), "run").where(F.col("run_id") == run_id).select(*RUN).first()
        if row is None:
            raise KeyError(f"No run with id={run_id}")
        run = row.asDict()
        run["params"], run["summary"] = json.loads(run.pop("params_json")), json.loads(run.pop("summary_json"))
        run["results"] = self.spark.read.parquet(self._path("results", run.pop("place")))
        return run

    def reload(self, run_id: int) -> dict:
        """A stored run as result tables: scores, flagged rows, all rows by score, the dataset."""
        run = self.load_run(run_id)
        rows = run["results"]
        score = score_column(rows)
        try:
            data = self.load_dataset(run["dataset_id"])
        except KeyError:
            data = None
        return {**run, "dataset": data, "scores": rows.withColumn("score", score),
                "flagged": rows.where(col("Any Scored")) if "Any Scored" in rows.columns else rows,
                "most_flagged": rows.orderBy(score.desc(), *[col(c) for c in rows.columns[:1]])}

    def delete_run(self, run_id: int) -> None:
        def change(log: DataFrame):
            found = self._alive(log, "run").where(F.col("run_id") == run_id).select("place").collect()
            return ({"op": "delete_run", "run_id": run_id} if found else None), [r["place"] for r in found]
        for place in self._commit(change):
            self._delete(self._path("results", place))

    def purge_all(self) -> None:
        """Remove every dataset, run and result; ids are not given again."""
        def change(log: DataFrame):
            places = [(f, r["place"]) for kind, f in (("dataset", "data"), ("run", "results")) for r in self._alive(log, kind).select("place").collect()]
            return ({"op": "purge"} if places else None), places
        for folder, place in self._commit(change):
            self._delete(self._path(folder, place))


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")
