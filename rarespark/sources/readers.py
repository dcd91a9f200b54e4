"""Reading files: the extension picks the format, text formats get types inferred."""

from __future__ import annotations

import codecs
import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import col
from ..session import stage

# File types that can be read, and cell texts that mean "missing".
READABLE = (".csv", ".parquet", ".txt")
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                  "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Python's names for encodings that Spark spells differently.
SPARK_ENCODINGS = {"iso8859-1": "iso-8859-1", "ascii": "us-ascii"}

WHOLE_PATTERN = r"^\s*[+-]?\d{1,38}\s*$"
DECIMAL_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|Infinity)\s*$"
BOOLEAN_PATTERN = r"^(True|False|TRUE|FALSE|true|false)$"


def load(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "utf-8",
         schema: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """Read a CSV, delimited TXT or Parquet file, or a folder named like one.

    TXT files have their delimiter detected unless ``sep`` is given. Types are inferred in a pass of
    its own unless ``schema`` is given.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    extension = name[name.rfind("."):] if "." in name else ""
    if extension not in READABLE:
        raise ValueError(f"Unsupported file type '{extension}'. Supported: {list(READABLE)}")
    if extension == ".parquet":
        return spark.read.parquet(path)
    if sep is None:
        sep = sniff_separator(spark, path) if extension == ".txt" else ","
    return read_delimited(spark, path, sep, encoding, schema, multi_line)


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Delimiter of a text file, from its first lines."""
    lines = [r[0] for r in spark.read.text(path).head(20)]
    for sample in ("\n".join(lines), lines[0] if lines else ""):
        try:
            return csv.Sniffer().sniff(sample).delimiter
        except csv.Error:
            continue
    raise ValueError(f"could not detect the delimiter of {path}; give it as sep")


def files_with_line_breaks(spark: SparkSession, path: str) -> set[str]:
    """Files of which some record may hold a line break: a line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    odd = spark.read.text(path).where(quotes % 2 == 1).select(F.input_file_name().alias("file")).distinct()
    return {r["file"] for r in odd.collect()}


def quoted_after(line: str, quoted: bool, sep: str) -> bool:
    """Whether the end of a line lies inside a quoted field, if its start does or not."""
    at = 0
    while '"' in line[at:]:
        if not quoted and line[at] != '"':  # an open field, where quotes mean nothing
            at = line.find(sep, at)
            if at < 0:
                return False
            at += len(sep)
            continue
        at += not quoted
        quoted = True
        end = line.find('"', at)
        while end >= 0 and line.startswith('""', end):
            end = line.find('"', end + 2)
        if end < 0:
            return True
        # A quote that no separator follows ends the quoting too; the field goes on to the next separator.
        quoted, at = False, line.find(sep, end + 1)
        if at < 0:
            return False
        at += len(sep)
    return quoted


def _block_effects(sep: str):
    """Per block of a file: whether its end is quoted, if its start is not and if it is; and whether its first line ends with CR."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[bool]] = {}
        returns: dict[tuple, bool] = {}
        for batch in batches:
            for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
                state = seen.setdefault((file, block), [False, True])
                returns.setdefault((file, block), line.endswith("\r"))
                if '"' in line:
                    state[:] = [quoted_after(line, q, sep) for q in state]
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
                                          pa.array([seen[k][0] for k in keys], pa.bool_()), pa.array([seen[k][1] for k in keys], pa.bool_()),
                                          pa.array([returns[k] for k in keys], pa.bool_())], names=["file", "block", "open", "quoted", "returns"])
    return work


def _block_starts(table: pa.Table) -> pa.Table:
    """Whether each block of a file starts inside quotes, and whether the file's lines end with CR and LF: the first one tells."""
    state, out, rows = False, [], sorted(table.to_pylist(), key=lambda r: r["block"])
    for r in rows:
        out.append({"file": r["file"], "block": r["block"], "inside": state, "returns": rows[0]["returns"]})
        state = r["quoted"] if state else r["open"]
    return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("returns", pa.bool_())]))


RECORDS = "file string, block bigint, part int, text string"
WHOLE, HEAD, TAIL = range(3)


def _block_records(sep: str):
    """Records of each block: whole ones, the rest of one that an earlier block began (head), and one that goes on behind it (tail).

    The first record of a file, its header, is left out where it is whole.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, quoted, lines, part = None, False, [], WHOLE
        for batch in batches:
            out: list[tuple] = []
            for file, block, inside, returns, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "inside", "returns", "value"))):
                if (file, block) != now:
                    if lines:
                        out.append((*now, TAIL if part == WHOLE else HEAD, "\n".join(lines)))
                    now, quoted, lines, part, header = (file, block), inside, [], HEAD if inside else WHOLE, block == 0
                if returns and line.endswith("\r"):
                    line = line[:-1]
                lines.append(line)
                quoted = quoted_after(line, quoted, sep) if '"' in line else quoted
                if not quoted:
                    if not header:
                        out.append((*now, part, "\n".join(lines)))
                    header, lines, part = False, [], WHOLE
            yield _rows(out)
        if lines:
            yield _rows([(*now, TAIL if part == WHOLE else HEAD, "\n".join(lines))])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int32(), pa.string()]
        columns = zip(*out) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "block", "part", "text"])
    return work


def _join_pieces(sep: str):
    def work(table: pa.Table) -> pa.Table:
        """The records of one file that cross the ends of blocks, and those cut there."""
        rows, out, lines, quoted = sorted(table.to_pylist(), key=lambda r: (r["block"], r["part"])), [], [], False
        for r in rows:
            lines.append(r["text"])
            for line in r["text"].split("\n"):
                quoted = quoted_after(line, quoted, sep)
            if not quoted or r is rows[-1]:  # what a file leaves open ends with it
                out.append({"file": r["file"], "block": r["block"], "part": WHOLE, "text": "\n".join(lines)})
                lines, quoted = [], False
        return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("text", pa.string())]))
    return work


#: Bytes that the table of blocks may take in every task.
BLOCK_TABLE_BYTES = 64 << 20


def spanning_records(spark: SparkSession, files: list[str], sep: str) -> DataFrame | None:
    """``file, text`` of every record but the headers of files with line breaks inside quotes, whose blocks are read by as many tasks as those of any file.

    Whether a block starts inside quotes follows from what the blocks before it do to that state. So a first pass takes each
    block's effect on both states, these are chained per file, and a second pass cuts each block into records. Only the records that
    cross the end of a block are put together in a task of their own. ``None`` if the table of blocks would be too large to send to every task.
    """
    lines = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    effects = lines.mapInArrow(_block_effects(sep), "file string, block bigint, open boolean, quoted boolean, returns boolean")
    starts = stage(effects.groupBy("file").applyInArrow(_block_starts, "file string, block bigint, inside boolean, returns boolean"))
    if (starts.agg(F.sum(F.octet_length("file") + 16)).first()[0] or 0) > BLOCK_TABLE_BYTES:
        return None
    cut = lines.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "inside", "returns", "value").mapInArrow(_block_records(sep), RECORDS)
    pieces = stage(cut.where(F.col("part") != WHOLE))
    joined = pieces.groupBy("file").applyInArrow(_join_pieces(sep), RECORDS)
    return cut.where(F.col("part") == WHOLE).unionByName(joined).select("file", "text").where("text != ''")


SURPLUS, FILE = "__surplus", "__file"


def read_delimited(spark: SparkSession, path: str, sep: str, encoding: str = "utf-8",
                   schema: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """Read delimited text; ``multi_line`` (line breaks inside quotes) is found out per file if not given.

    Rows shorter than the header end in missing values; a longer row is an error that names its file.
    """
    encoding = codecs.lookup(encoding).name
    encoding = SPARK_ENCODINGS.get(encoding, encoding)
    options = dict(header=True, sep=sep, encoding=encoding, escape='"', inferSchema=False)
    names = spark.read.csv(path, multiLine=True if multi_line is None else multi_line, **options).columns
    wide = T.StructType([T.StructField(c, T.StringType()) for c in [*names, SURPLUS]])

    def read(files: str | list[str], spanning: bool) -> DataFrame:
        return spark.read.schema(wide).csv(files, multiLine=spanning, **options).withColumn(FILE, F.input_file_name())

    if multi_line is None and encoding.startswith(("utf-16", "utf-32")):
        multi_line = True
    if multi_line is None:
        spanning = files_with_line_breaks(spark, path)
        every = spark.read.text(path).inputFiles() if spanning else []
        plain = [f for f in every if f not in spanning]
        records = spanning_records(spark, sorted(spanning), sep) if spanning and encoding in ("utf-8", "us-ascii") else None
        if records is not None:
            fields = [f"c{i} string" for i in range(len(wide))]
            parsed = records.select("file", F.from_csv("text", ", ".join(fields), {"sep": sep, "escape": '"', "multiLine": "true"}).alias("r"))
            text = parsed.select(*[F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(wide)], F.col("file").alias(FILE))
        else:
            text = read(sorted(spanning), True) if spanning else read(path, False)
        text = text.unionByName(read(plain, False)) if plain else text
    else:
        text = read(path, multi_line)
    wrong = F.raise_error(F.concat(F.lit("a row has more fields than the header in "), F.col(FILE))).cast("string")
    checked = lambda c: F.when(F.col(SURPLUS).isNotNull(), wrong).otherwise(col(c))
    text = text.select(*[F.when(~col(c).isin(*MISSING_TOKENS), checked(c) if i == 0 else col(c)).alias(c) for i, c in enumerate(names)])
    if schema is None:
        return infer_types(text)
    types = {f.name: f.dataType for f in T.StructType.fromDDL(schema)}
    return text.select(*[F.trim(col(c)).cast(types[c]).alias(c) if not isinstance(types[c], T.StringType) else col(c)
                         for c in text.columns if c in types])


def infer_types(text: DataFrame) -> DataFrame:
    """Whole numbers, numbers, booleans or text: the narrowest type that every value of a column has.

    Whole numbers beyond ``bigint`` become ``decimal(38,0)``, so that no digit is lost.
    """
    tests = {"bigint": lambda v: v.rlike(WHOLE_PATTERN) & F.trim(v).try_cast("bigint").isNotNull(),
             "decimal(38,0)": lambda v: v.rlike(WHOLE_PATTERN), "double": lambda v: v.rlike(DECIMAL_PATTERN),
             "boolean": lambda v: v.rlike(BOOLEAN_PATTERN)}

    def all_match(value: Column, test) -> Column:
        return F.coalesce(F.bool_and(F.when(value.isNotNull(), test(value))), F.lit(False))

    row = text.agg(*[all_match(col(c), p).alias(f"{t}{i}")
                     for i, c in enumerate(text.columns) for t, p in tests.items()],
                   F.count("*").alias("rows")).first()

    def typed(i: int, c: str) -> Column:
        for t in tests:
            if row[f"{t}{i}"]:
                return F.trim(col(c)).cast(t).alias(c)
        return col(c)

    return text.select(*[typed(i, c) for i, c in enumerate(text.columns)])
