"""The rarity detector: find rare values and combinations, score rows, explain scores."""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from ..config import RarityConfig
from ..functions.columns import balanced_sum, col
from ..functions.text import reason_text
from ..operators import cells as c
from ..operators.encode import Domains, discover
from ..session import stage, stage_until, with_row_id
from ..sources.writers import KEEP_BLANKS

REASONS = "array<struct<cols:array<string>,vals:array<string>>>"
DIMS = range(1, 7)
LITERAL_SETS = 128  # column sets whose bitmaps are written into the score projection
BROADCAST_BYTES = 256 << 20  # measured size of all tables of hit patterns together that may be broadcast
TOTAL = "TOTAL SCORE"
# What the profile and the value patterns of a table depend on.
ENCODING_FIELDS = ("n_bins", "bin_names", "min_values_per_column", "max_values_per_column", "max_group_patterns")


class RarityDetector:
    """Scores every row by the number of rare value combinations it holds.

    >>> RarityDetector(threshold=0.05).fit_predict(df, id_cols=["event_id"])["Scores"]
    """

    def __init__(self, config: RarityConfig | None = None, **params):
        self.config = config or RarityConfig(**params)
        self.result: RarityResult | None = None

    def fit_predict(self, df: DataFrame, features: Sequence[str] | None = None,
                    id_cols: Sequence[str] | None = None, like: RarityResult | None = None) -> RarityResult:
        """Run on ``features`` (default: all columns that are not ids).

        ``like`` is an earlier run on the same table: if features and encoding are the same too, its profile and value
        patterns are taken over instead of being made again.

        Rows are identified by ``id_cols``. By default a ``row_id`` is assigned, and the table stored
        once with it; ``id_cols=[]`` does without ids, and result tables then keep the input columns.
        """
        if len(set(df.columns)) < len(df.columns):
            raise ValueError("column names must be unique")
        if TOTAL in df.columns:
            raise ValueError(f"the input already has a column called {TOTAL!r}")
        ids = list(id_cols or [])
        features = list(features) if features is not None else [n for n in df.columns if n not in ids]
        if not features:
            raise ValueError("select at least one feature")
        if id_cols is None:
            df, ids = with_row_id(df), ["row_id"]
        elif self.config.stage_input:
            df = stage(df)
        self.result = RarityResult(df, features, ids, self.config, like)
        return self.result

    def get_most_flagged_rows(self) -> DataFrame:
        if self.result is None:
            raise ValueError("run fit_predict first")
        return self.result.most_flagged()


class RarityResult:
    """Outcome of one run.

    The driver holds only bounded metadata (cardinalities and one bit per possible combination);
    every table below is a lazy DataFrame. Scores are a projection of the input rows: no shuffle, no
    join, no row ids needed.
    """

    def __init__(self, df: DataFrame, features: list[str], ids: list[str], cfg: RarityConfig, like: RarityResult | None = None):
        started = time.monotonic()
        self.df, self.features, self.cfg = df, features, cfg
        self.ids = ids or df.columns
        self.spark = df.sparkSession
        same = like is not None and like.features == features and all(getattr(like.cfg, f) == getattr(cfg, f) for f in ENCODING_FIELDS)
        self.domains: Domains = like.domains if same else discover(df, features, cfg)
        self.columns = self.domains.columns
        self.rows = self.domains.rows
        self.truncated = False
        self.plan: c.CellPlan | None = None
        self.words: dict[int, dict[int, int]] = {}
        if len(self.columns) >= 2:
            self.plan = c.CellPlan(self.columns, self.rows, cfg)
            self._count()
            self._find(started)
        #: Where the breakdown was written, if the settings name a folder.
        self.dump_path = self.save_breakdown() if cfg.results_folder else None

    def __getitem__(self, key: str) -> DataFrame:
        tables = {"Scores": self.scores, "Breakdown All Rows": self.breakdown_all,
                  "Breakdown Flagged Rows": self.breakdown_flagged, "Flagged Summary": self.flagged_summary}
        return tables[key]()

    # -- counting ---------------------------------------------------------------------------------

    def _count(self) -> None:
        self.groups = self.plan.groups()
        if self.domains.patterns is not None:
            self.patterns = c.count_groups(self.domains.code_patterns(), self.groups, weight="cnt")
        else:
            used = self.df.select(*[col(p.name) for p in self.domains.used])
            self.patterns = stage(c.count_groups(self.domains.code_rows(used), self.groups))

    def cells(self) -> DataFrame:
        """Observed cells ``(pos, key, cnt)`` of every examined column set."""
        return self.observed.where(F.col("pos") < len(self.plan.sets))

    def _find(self, started: float) -> None:
        budget = self.cfg.max_execution_seconds
        self.planned_sets = len(self.plan.sets)
        if not budget:
            self.observed = stage(c.count_cells(self.patterns, self.groups, self.plan))
        else:  # single columns are always counted; then batch by batch, until the time is up
            self.observed, done = None, 0
            for batch in self.plan.batches():
                counted = c.count_cells(self.patterns, self.groups, self.plan, batch)
                part = stage(counted) if not done else stage_until(counted, started + budget)
                if part is None:
                    self.truncated = True
                    self.plan.keep_first(done)
                    break
                self.observed, done = part if not done else self.observed.unionByName(part), batch.stop
        low = c.low_cells(self.cells(), self.plan)
        self.flagged, self.hits = c.minimal_cells(low), None
        dictionaries = any(x.dictionary is not None for x in self.columns)
        if dictionaries:  # bits would grow with the labels, so only the sets that hold flagged cells are known here
            self.words = {r["pos"]: {} for r in self.flagged.select("pos").distinct().collect()}
        else:
            for r in c.bit_words(self.flagged.select("pos", "key")).collect():
                self.words.setdefault(r["pos"], {})[r["word"]] = r["bits"]
        if dictionaries or len(self.words) > LITERAL_SETS:
            self.hits = stage(c.pattern_hits(self.patterns, self.groups, self.plan, self.flagged))
            self.hit_rows = {r["grp"]: r["bytes"] for r in self.hits.groupBy("grp").agg(
                F.sum(F.size("hits") * 4 + 32).alias("bytes")).collect()}

    # -- scoring ----------------------------------------------------------------------------------

    def _hits(self, coded: DataFrame) -> DataFrame:
        """Adds what was hit: a 0/1 column per column set, or one array where there are many sets."""
        if self.hits is None:
            return coded.select("*", *[F.expr(c.hit_sql(self.plan.sets[pos], words)).alias(f"__hit{pos}")
                                       for pos, words in sorted(self.words.items())])
        found, left = [], BROADCAST_BYTES
        for g, size in sorted(self.hit_rows.items(), key=lambda x: (x[1], x[0])):
            left -= size
            one = self.hits.where(F.col("grp") == g).select(F.col("key").alias(f"__key{g}"), F.col("hits").alias(f"__found{g}"))
            one = F.broadcast(one) if left >= 0 else one
            key = F.expr(self.groups[g].key_sql()).alias(f"__key{g}")
            coded = coded.select("*", key).join(one, f"__key{g}", "left")
            found.append(F.coalesce(F.col(f"__found{g}"), F.array().cast("array<int>")))
        if not found:  # no pattern holds a flagged cell
            return coded.withColumn("__hits", F.array().cast("array<int>"))
        return coded.withColumn("__hits", F.array_sort(F.concat(*found)) if len(found) > 1 else found[0])

    def _dim_hits(self, d: int) -> Column:
        """Positions hit among the sets of ``d`` columns, in order (sets are listed by size)."""
        first = sum(s.dim < d for s in self.plan.sets)
        last = first + sum(s.dim == d for s in self.plan.sets)
        if self.hits is not None:
            return F.filter("__hits", lambda p: (p >= first) & (p < last))
        marks = [F.when(F.col(f"__hit{pos}") == 1, pos) for pos in sorted(self.words) if first <= pos < last]
        return F.array_compact(F.array(*marks))

    def _counts(self) -> dict[int, Column]:
        if self.hits is not None:
            return {d: F.when(F.size("__hits") > 0, F.size(self._dim_hits(d))).otherwise(0).cast("bigint") for d in DIMS}
        by_dim: dict[int, list[Column]] = {d: [] for d in DIMS}
        for pos in sorted(self.words):
            by_dim[self.plan.sets[pos].dim].append(F.col(f"__hit{pos}"))
        return {d: (balanced_sum(hits) if hits else F.lit(0)).cast("bigint") for d, hits in by_dim.items()}

    def _scored(self, coded: DataFrame) -> DataFrame:
        """Adds ``{d}d Counts`` and the total score to coded rows or patterns."""
        if self.plan is None:
            counts = {d: F.lit(0).cast("bigint") for d in DIMS}
        else:
            coded, counts = self._hits(coded), self._counts()
        out = coded.withColumns({f"{d}d Counts": counts[d] for d in DIMS})
        return out.withColumn(TOTAL, balanced_sum([F.col(f"{d}d Counts") for d in DIMS]))

    def _reasons(self, d: int) -> Column:
        if self.plan is None or not self.plan.checked[d]:
            return F.lit(None).cast(REASONS)
        none = F.array().cast(REASONS)
        used = [pos for pos in sorted(self.words) if self.plan.sets[pos].dim == d]
        if not used:
            return none
        # Literal: which columns a set position stands for, for the positions in use.
        members = F.expr("array(" + ", ".join(f"array({', '.join(map(str, self.plan.sets[p].members))})" for p in used) + ")")
        index = F.expr("array(" + ", ".join(map(str, used)) + ")")

        def reason(p: Column) -> Column:
            columns = F.get(members, (F.array_position(index, p) - 1).cast("int"))
            return F.struct(F.transform(columns, lambda m: F.get(F.col("__names"), m)).alias("cols"),
                            F.transform(columns, lambda m: F.get(F.col("__labels"), m)).alias("vals"))

        return F.when(F.col(f"{d}d Counts") > 0, F.transform(self._dim_hits(d), reason)).otherwise(none)

    def scored_rows(self) -> DataFrame:
        """Input rows with counts per dimension, reasons, flags and the total score."""
        rows = self.df
        if self.plan is not None:
            rows = self.domains.code_rows(rows)
        rows = self._scored(rows)
        if self.plan is not None:
            rows = rows.withColumns({"__labels": self.domains.labels(),
                                     "__names": F.lit([x.name for x in self.columns])})
        rows = rows.withColumns({f"{d}d Explanations": self._reasons(d) for d in DIMS})
        rows = rows.withColumns({f"Any at {d}d": F.col(f"{d}d Counts") > 0 for d in DIMS})
        upto = {}
        for d in DIMS:
            upto[f"Any up to {d}d"] = balanced_sum([F.col(f"{k}d Counts") for k in range(1, d + 1)]) > 0
        rows = rows.withColumns({**upto, "Any Scored": F.col(TOTAL) > 0})
        return rows.drop(*[n for n in rows.columns if n.startswith("__")])

    def coded_counts(self) -> DataFrame:
        """Coded patterns with their row counts ``cnt``, or coded rows where patterns are too many."""
        if self.plan is None:
            return self.df.select(F.lit(1).cast("bigint").alias("cnt"))
        if self.domains.patterns is not None:
            return self.domains.code_patterns()
        used = self.df.select(*[col(p.name) for p in self.domains.used])
        return self.domains.code_rows(used).withColumn("cnt", F.lit(1).cast("bigint"))

    def weighted_scores(self) -> DataFrame:
        """Counts per dimension with ``cnt`` rows each."""
        return self._scored(self.coded_counts()).select("cnt", *[f"{d}d Counts" for d in DIMS], TOTAL)

    # -- result tables ----------------------------------------------------------------------------

    def scores(self) -> DataFrame:
        return self.scored_rows().select(*map(col, self.ids), col(TOTAL))

    def breakdown_all(self) -> DataFrame:
        return self.scored_rows().select(
            *map(col, self.ids), *[col(f"{d}d Counts") for d in DIMS],
            *[col(f"{d}d Explanations") for d in DIMS], *[col(f"Any at {d}d") for d in DIMS],
            *[col(f"Any up to {d}d") for d in DIMS], col("Any Scored"), col(TOTAL))

    def breakdown_flagged(self) -> DataFrame:
        dims = range(1, max(self.dimensions_examined, 1) + 1)
        return self.scored_rows().where(col("Any Scored")).select(
            *map(col, self.ids), *[col(f"{d}d Explanations") for d in dims])

    def most_flagged(self) -> DataFrame:
        """Flagged rows with all their input columns, highest score first."""
        rows = self.scored_rows().where(col(TOTAL) > 0)
        return rows.select(col(TOTAL), *map(col, self.df.columns)).orderBy(col(TOTAL).desc(), *map(col, self.ids))

    def flagged_summary(self) -> DataFrame:
        """One row: examined dimensions and percentages of rows flagged (no row if nothing could run)."""
        def share(where: Column) -> Column:
            return F.sum(F.when(where, F.col("cnt")).otherwise(0)) * 100.0 / F.sum("cnt")

        def upto(d: int) -> Column:
            return balanced_sum([F.col(f"{k}d Counts") for k in range(1, d + 1)]) > 0

        checked = self.plan.checked if self.plan else {d: False for d in DIMS}
        table = self.weighted_scores().agg(
            *[F.lit(checked[d]).alias(f"Checked_{d}d") for d in DIMS if d > 1],
            *[share(F.col(f"{d}d Counts") > 0).alias(f"Percent Flagged as {d}d") for d in DIMS],
            *[share(upto(d)).alias(f"Percent Flagged up to {d}d") for d in DIMS],
            share(F.col(TOTAL) > 0).alias("Percent Flagged"))
        return table if self.plan else table.limit(0)

    @property
    def dimensions_examined(self) -> int:
        return self.plan.examined if self.plan else 0

    # -- rare values and run metrics --------------------------------------------------------------

    def cell_table(self, cells: DataFrame, dim: int | None = None) -> DataFrame:
        """Cells ``(pos, key, cnt)`` in readable form: dim, columns, values, rows, fraction."""
        labels = F.lit([list(x.labels) or [""] for x in self.columns])
        names = F.lit([x.name for x in self.columns])
        sets = c.set_table(self.spark, self.plan)
        placed = cells.join(sets if dim is None else sets.where(F.col("dim") == dim), "pos")
        label = c.item_value(self.columns, lambda it: F.get(F.get(labels, c.item_column(it)), c.item_code(it)), lambda m: F.col(f"__label{m}"))
        return c.look_up(c.with_items(placed, self.plan), self.columns, "label").select(
            "dim", F.transform("items", lambda it: F.get(names, c.item_column(it))).alias("cols"),
            F.transform("items", label).alias("vals"),
            "cnt", (F.col("cnt") / F.lit(float(self.rows))).alias("frac"))

    def rare_cells(self, dim: int | None = None) -> DataFrame:
        """Flagged combinations with their row counts."""
        return self.cell_table(self.flagged.select("pos", "key", "cnt"), dim)

    def fractions(self, dim: int) -> DataFrame:
        """Observed combinations of ``dim`` columns with their fractions."""
        return self.cell_table(self.cells(), dim)

    def combination_counts(self) -> DataFrame:
        """Common and rare combinations per dimension, over all that are possible, seen or not.

        A combination that no row holds is below every limit, so the rare ones of a column set are those of clean parts only, less
        the clean ones. Neither the possible nor the unseen ones are listed.
        """
        plan, spark = self.plan, self.spark
        totals: dict[int, int] = {}
        for s in plan.sets:
            totals[s.dim] = totals.get(s.dim, 0) + s.product
        table = spark.createDataFrame([(d, totals.get(d, 0)) for d in range(1, plan.examined + 1)],
                                      "dim int, total bigint")
        clean = stage(c.clean_cells(self.cells(), c.low_cells(self.cells(), plan), plan))
        single = spark.createDataFrame([(pos, s.product) for pos, s in enumerate(plan.sets) if s.dim == 1], "pos int, n bigint")
        possible = single.unionByName(c.count_supported(clean, plan)) if plan.examined > 1 else single
        kept = clean.groupBy("pos").agg(F.count("*").alias("clean"))
        sets = F.broadcast(spark.createDataFrame([(pos, s.dim) for pos, s in enumerate(plan.sets)], "pos int, dim int"))
        counted = possible.join(kept, "pos", "left").join(sets, "pos").groupBy("dim").agg(F.sum(F.col("n") - F.coalesce("clean", F.lit(0))).alias("rare"))
        rare = F.coalesce("rare", F.lit(0)) if self.cfg.threshold > 0 else F.lit(0)  # nothing is below a limit of 0
        return table.join(counted, "dim", "left").select("dim", (F.col("total") - rare).alias("common"), rare.cast("bigint").alias("rare"))

    def score_histogram(self) -> DataFrame:
        """Rows per score value and dimension."""
        entries = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"{d}d Counts").alias("score"))
                            for d in range(1, self.dimensions_examined + 1)])
        return (self.weighted_scores().select("cnt", F.explode(entries).alias("e"))
                .groupBy("e.dim", "e.score").agg(F.sum("cnt").alias("rows")))

    def gate(self) -> DataFrame:
        """Estimated combinations per dimension and whether it was examined."""
        return self.spark.createDataFrame(
            [(d, float(self.plan.estimates[d]), self.plan.checked[d]) for d in DIMS],
            "dim int, estimate double, examined boolean")

    def cardinality(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(x.name, x.kind, x.size) for x in self.columns], "column string, kind string, uniques int")

    def run_summary(self) -> str:
        """The run's metrics as text."""
        lines = ["", f"Number of rows: {self.rows}", f"Number of columns: {len(self.columns)}"]
        if self.plan is None:
            return "\n".join(lines + [SUMMARY_TOO_FEW])
        lines.append(f"Cardinality of the columns (after binning numeric columns): {[x.size for x in self.columns]}")
        combos = {r["dim"]: r for r in self.combination_counts().collect()}
        scores = sorted((r["dim"], r["score"], r["rows"]) for r in self.score_histogram().collect())
        for d in range(1, self.dimensions_examined + 1):
            what = "values" if d == 1 else "combinations"
            common, rare = combos[d]["common"], combos[d]["rare"]
            lines += ["", f"{d}d: Number of common {what} (over all columns): {common if d == 1 else format(common, ',')}",
                      f"{d}d: Number of rare {what}: {rare}"]
            lines += [f"Number of rows given score: {s:2}: {n:5}" for k, s, n in scores if k == d]
        if self.truncated:
            lines += ["", f"NOTE: the time budget (max_execution_seconds={self.cfg.max_execution_seconds}) "
                          "was reached; higher dimensions were skipped.",
                      f"Column sets examined: {len(self.plan.sets)} of {self.planned_sets}"]
        lines.append("")
        for d in range(1, self.cfg.max_dimensions + 1):
            n = sum(rows for k, s, rows in scores if k == d and s > 0)
            lines.append(f"Number of rows flagged as outliers examining {d}d: {n:3} ({round(n * 100.0 / self.rows, 3)}%)")
        return "\n".join(lines)

    def save_breakdown(self) -> str:
        """Write the full breakdown as CSV, reasons as text, below the configured folder."""
        stamp = datetime.now(timezone.utc).strftime("%d_%m_%Y_%H_%M_%S")
        path = f"{self.cfg.results_folder}/{self.cfg.results_name}_results_{stamp}.csv"
        flat = self.breakdown_all().withColumns(
            {f"{d}d Explanations": reason_text(col(f"{d}d Explanations")) for d in DIMS})
        flat.write.csv(path, header=True, **KEEP_BLANKS)
        return path


# Fixed value: the note of a run without two usable columns.
SUMMARY_TOO_FEW = ("Less than two columns found (after dropping columns with too few or too many unique values). "
                   "Cannot determine outliers.")
