"""Independent SQL for the detector: cells as rows of one long table, with the rule spelled out.

The engine counts coded keys, finds minimal cells with joins and looks rows up in bitmaps; this
formulation sums cells of text over a window and tests subsets per row, so they share nothing.
"""

from __future__ import annotations

import math
from itertools import combinations

BIN_LIST = "['Very Low', 'Low', 'Med-Low', 'Med', 'Med-High', 'High', 'Very High']"
N_BINS = 7


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


class RareSql:
    """SQL of one detector run over ``source`` (a SELECT) with features of known kinds (N or C)."""

    def __init__(self, source: str, ids: list[str], features: list[tuple[str, str]], threshold: float = 0.05,
                 max_dims: int = 3, marginal: bool = False, cap: int = 100_000):
        self.source, self.ids, self.features = source, ids, features
        self.threshold, self.marginal, self.cap = threshold, marginal, cap
        self.n = len(features)
        self.dims = range(1, min(max_dims, self.n) + 1)
        self.sets = [s for d in self.dims for s in combinations(range(self.n), d)]

    @staticmethod
    def tag(s: tuple) -> str:
        return "_".join(map(str, s))

    def subsets(self, s: tuple) -> list[tuple]:
        return [t for d in range(1, len(s)) for t in combinations(s, d)]

    def gate(self, d: int) -> str:
        """Whether dimension d is examined, from the cardinalities."""
        if d == 1:
            return "TRUE"
        mean = f"(({' + '.join(f'u{i}' for i in range(self.n))}) / {self.n}e0)"
        tests = [f"{math.comb(self.n, k)} * pow({mean}, {k}) <= {self.cap}" for k in range(2, d + 1)]
        return "(" + " AND ".join(tests) + ")"

    def low(self, s: tuple, k: str, share=lambda i: f"k_{i} / CAST(n AS DOUBLE)") -> str:
        product = " * ".join(f"u{i}" for i in s)
        f = f"({k} / CAST(n AS DOUBLE))"
        out = [f"{f} < (1e0 / ({product})) * {dbl(self.threshold)}", f"{f} < 0.01e0"]
        if len(s) > 2:
            out.append(f"NOT (n * (1e0 / ({product})) < 10)")
        if len(s) > 1:
            out.append(self.gate(len(s)))
            if self.marginal:
                out.append(f"{f} < " + " * ".join(f"({share(i)})" for i in s) + f" * {dbl(self.threshold)}")
        return "(" + " AND ".join(out) + ")"

    def coded(self) -> str:
        """``coded``: ids, c{i} (value), l{i} (label); ``sizes``: n, u{i}."""
        numbers = [(i, f) for i, (f, kind) in enumerate(self.features) if kind == "N"]
        stats = ", ".join(f"min({f}) AS lo{i}, (max({f}) - min({f})) / {N_BINS}e0 AS st{i}, "
                          f"quantile_cont({f}, 0.5) AS md{i}" for i, f in numbers) or "count(*) AS one"
        parts = []
        for i, (f, kind) in enumerate(self.features):
            if kind == "N":
                steps = " + ".join(f"CAST(coalesce(CAST({f} AS DOUBLE), md{i}) >= {j} * st{i} + lo{i} AS INTEGER)"
                                   for j in range(1, N_BINS))
                parts.append(f"({steps}) AS c{i}")
            else:
                parts.append(f"coalesce(CAST({f} AS VARCHAR), 'nan') AS c{i}")
        labels = ", ".join(f"{BIN_LIST}[c{i} + 1] AS l{i}" if kind == "N" else f"c{i} AS l{i}"
                           for i, (_, kind) in enumerate(self.features))
        sizes = ", ".join(f"count(DISTINCT c{i}) AS u{i}" for i in range(self.n))
        return (f"src AS ({self.source}), stats AS (SELECT {stats} FROM src), "
                f"coded0 AS (SELECT src.*, {', '.join(parts)} FROM src, stats), "
                f"coded AS (SELECT *, {labels} FROM coded0), "
                f"sizes AS (SELECT count(*) AS n, {sizes} FROM coded0)")

    @staticmethod
    def mask(s: tuple) -> int:
        return sum(1 << i for i in s)

    def rare(self, threshold: float) -> str:
        """The rule, over one pattern's cell: k rows of n, in a column set of ``dim`` and ``product``."""
        f = "(k / CAST(n AS DOUBLE))"
        out = [f"{f} < (1e0 / product) * {dbl(threshold)}", f"{f} < 0.01e0", "gate",
               "(dim < 3 OR NOT (n * (1e0 / product) < 10))"]
        if self.marginal:
            out.append(f"(dim = 1 OR {f} < expected * {dbl(threshold)})")
        return "(" + " AND ".join(out) + ")"

    def counted_ctes(self) -> str:
        """``pats``: distinct value patterns; ``counted``: their cells, one row per column set."""
        cs, ls = (", ".join(f"{x}{i}" for i in range(self.n)) for x in "cl")
        shares = ", ".join(f"sum(cnt) OVER (PARTITION BY c{i}) / CAST(n AS DOUBLE) AS p{i}" for i in range(self.n))
        cells = " UNION ALL ".join(
            f"SELECT pid, cnt, n, {self.mask(s)} AS s, {len(s)} AS dim, {' * '.join(f'u{i}' for i in s)} AS product, "
            f"{' * '.join(f'p{i}' for i in s)} AS expected, {self.gate(len(s))} AS gate, "
            f"concat_ws('|', {', '.join(f'c{i}' for i in s)}) AS cell FROM pats" for s in self.sets)
        return (f"WITH {self.coded()}, grouped AS (SELECT {cs}, {ls}, count(*) AS cnt, row_number() OVER () AS pid "
                f"FROM coded GROUP BY {cs}, {ls}), "
                f"pats AS MATERIALIZED (SELECT grouped.*, sizes.*, {shares} FROM grouped, sizes), "
                f"counted AS MATERIALIZED (SELECT *, sum(cnt) OVER (PARTITION BY s, cell) AS k FROM ({cells}))")

    def pattern_ctes(self) -> str:
        """``pf``: patterns with their row count and f_S (flagged) per column set S."""
        flags = ", ".join(f"list_contains(fs, {self.mask(s)}) AS f_{self.tag(s)}" for s in self.sets)
        return (f"{self.counted_ctes()}, lows AS (SELECT pid, list(s) AS ws FROM counted WHERE {self.rare(self.threshold)} GROUP BY pid), "
                "minimal AS (SELECT pid, list_filter(ws, lambda s: len(list_filter(ws, lambda t: t <> s AND (t & s) = t)) = 0) AS fs FROM lows), "
                "listed AS (SELECT pats.*, coalesce(fs, []) AS fs FROM pats LEFT JOIN minimal USING (pid)), "
                f"pf AS MATERIALIZED (SELECT *, {flags} FROM listed)")

    def ctes(self) -> str:
        """``flags``: input rows with the columns of their pattern."""
        cs = ", ".join(f"c{i}" for i in range(self.n))
        own = ", ".join(f"coded.{x}" for x in dict.fromkeys([*self.ids, *(f for f, _ in self.features)]))
        return f"{self.pattern_ctes()}, flags AS (SELECT {own}, pf.* FROM coded JOIN pf USING ({cs}))"

    def count(self, d: int) -> str:
        """Flagged combinations of d columns in the row."""
        terms = [f"CAST(f_{self.tag(s)} AS BIGINT)" for s in self.sets if len(s) == d]
        return f"CAST({' + '.join(terms)} AS BIGINT)" if terms else "CAST(0 AS BIGINT)"

    def total(self) -> str:
        return "(" + " + ".join(self.count(d) for d in self.dims) + ")"

    def text(self, s: tuple) -> str:
        return " || ' AND ' || ".join(f"'{self.features[i][0]} = ' || l{i}" for i in s)

    def reasons(self, d: int) -> str:
        """Reasons of d columns as text, in column order."""
        terms = [f"CASE WHEN f_{self.tag(s)} THEN {self.text(s)} END" for s in self.sets if len(s) == d]
        return f"concat_ws('; ', {', '.join(terms)})" if terms else "CAST(NULL AS VARCHAR)"

    def id_list(self) -> str:
        return ", ".join(self.ids)

    def cells(self, d: int, flag: str = "f", extra: str = "") -> str:
        """Cells of d columns: cols, vals, cnt, frac; flagged ones, or all for ``flag=''``."""
        parts = []
        for s in (s for s in self.sets if len(s) == d):
            names = "|".join(self.features[i][0] for i in s)
            vals = " || '|' || ".join(f"l{i}" for i in s)
            where = f"WHERE {flag}_{self.tag(s)}" if flag else ""
            parts.append(f"SELECT '{names}' AS cols, {vals} AS vals, CAST(sum(cnt) AS BIGINT) AS cnt, "
                         f"round(sum(cnt) / CAST(max(n) AS DOUBLE), 6) AS frac FROM pf {where} GROUP BY {vals}")
        return f"{self.pattern_ctes()} " + " UNION ALL ".join(parts) + extra

    def combination_counts(self) -> str:
        """Common and rare combinations over all possible ones, seen or not."""
        out = [self.coded()]
        out += [f"dom{i} AS (SELECT c{i}, count(*) AS m{i} FROM coded GROUP BY c{i})" for i in range(self.n)]
        for s in self.sets:
            tag, cs = self.tag(s), [f"c{i}" for i in s]
            out.append(f"obs_{tag} AS (SELECT {', '.join(cs)}, count(*) AS k FROM coded GROUP BY {', '.join(cs)})")
            cross = " CROSS JOIN ".join(f"dom{i}" for i in s)
            low = self.low(s, "coalesce(k, 0)", lambda i: f"m{i} / CAST(n AS DOUBLE)")
            out.append(f"cell_{tag} AS (SELECT {', '.join(cs)}, {low} AS low FROM {cross} CROSS JOIN sizes "
                       f"LEFT JOIN obs_{tag} USING ({', '.join(cs)}))")
        picks = []
        for s in self.sets:
            joins = "".join(f" JOIN cell_{self.tag(t)} AS t{j} USING ({', '.join(f'c{i}' for i in t)})"
                            for j, t in enumerate(self.subsets(s)))
            clean = "".join(f" AND NOT t{j}.low" for j in range(len(self.subsets(s))))
            examined = f"(SELECT NOT (n * (1e0 / ({' * '.join(f'u{i}' for i in s)})) < 10) FROM sizes)" if len(s) > 2 else "TRUE"
            picks.append(f"SELECT {len(s)} AS dim, count(*) FILTER (WHERE me.low{clean}) AS rare, count(*) AS total "
                         f"FROM cell_{self.tag(s)} AS me{joins} WHERE {examined}")
        return (f"WITH {', '.join(out)}, picked AS ({' UNION ALL '.join(picks)}) "
                "SELECT CAST(dim AS INTEGER) AS dim, CAST(sum(total) - sum(rare) AS BIGINT) AS common, "
                "CAST(sum(rare) AS BIGINT) AS rare FROM picked GROUP BY dim")
