import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from checks import registry
from rarespark import session
from rarespark.functions.text import reason_lines, safe_label, sanitize_for_spreadsheet
from rarespark.plans import compare
from rarespark.sources.catalog import Catalog, table_fingerprint
from rarespark.sources.readers import files_with_line_breaks, load, spanning_records
from rarespark.sources.writers import export, export_result
from rarespark import RarityDetector

from .tables import staff


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'n,x,t,flag,when\n1,1.5,"a, ""q""\nline",True,2024-01-01\n,NA,b,False,\n3,1e3,null,True,2024-01-02\n')
    df = load(spark, path)
    assert df.dtypes == [("n", "bigint"), ("x", "double"), ("t", "string"), ("flag", "boolean"), ("when", "string")]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, 'a, "q"\nline', True, "2024-01-01"), (None, None, "b", False, None), (3, 1000.0, None, True, "2024-01-02")]


def test_split_reading_and_given_types(spark, tmp_path):
    plain = write(tmp_path / "p.csv", 'a,b\n1,"x, y"\n2,"say ""hi"""\n')
    broken = write(tmp_path / "q.csv", 'a,b\n1,"x\ny"\n')
    assert not files_with_line_breaks(spark, plain) and len(files_with_line_breaks(spark, broken)) == 1
    assert load(spark, plain).orderBy("a").collect()[1]["b"] == 'say "hi"'
    assert load(spark, broken).first()["b"] == "x\ny"
    assert load(spark, plain, schema="a double, b string").dtypes == [("a", "double"), ("b", "string")]


def test_only_files_with_broken_lines_are_read_whole(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    write(folder / "a.csv", 'a,b\n1,x\n2,y\n')
    write(folder / "b.csv", 'a,b\n3,"x\ny"\n')
    df = load(spark, str(folder))
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (2, "y"), (3, "x\ny")]


def test_rows_that_do_not_fit_the_header(spark, tmp_path):
    with pytest.raises(Exception, match="more fields than the header.*long.csv"):
        load(spark, write(tmp_path / "long.csv", "a,b\n1,2\n3,4,5\n"))
    assert [tuple(r) for r in load(spark, write(tmp_path / "short.csv", "a,b\n1,2\n3\n")).collect()] == [(1, 2), (3, None)]


def test_long_whole_numbers(spark, tmp_path):
    df = load(spark, write(tmp_path / "n.csv", "id,huge\n1234567890123456789,12345678901234567890123\n1234567890123456788,-1\n"))
    assert df.dtypes == [("id", "bigint"), ("huge", "decimal(38,0)")]
    assert [int(v) for v in df.first()] == [1234567890123456789, 12345678901234567890123]


def test_blanks_survive_csv(spark, tmp_path):
    rows = [(1, "  lead"), (2, "trail "), (3, " ")]
    export(spark.createDataFrame(rows, "n bigint, t string"), str(tmp_path / "blank.csv"), "csv")
    assert sorted(map(tuple, load(spark, str(tmp_path / "blank.csv")).collect())) == rows


def test_fingerprints_see_where_values_are_missing(spark, tmp_path):
    a, b = (spark.createDataFrame([r], "x bigint, y bigint, z array<bigint>") for r in ((None, 5, [None, 5]), (5, None, [None, 5])))
    c = spark.createDataFrame([(None, 5, [5, None])], a.schema)
    assert len({table_fingerprint(t) for t in (a, b, c)}) == 3
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    ids = [catalog.save_dataset(t, "t") for t in (a, b, c)]
    assert len(set(ids)) == 3 and [tuple(catalog.load_dataset(i).first()) for i in ids] == [tuple(t.first()) for t in (a, b, c)]


def test_separators_and_encodings(spark, tmp_path):
    assert load(spark, write(tmp_path / "e.csv", "a\n“€”\n", "cp1252"), encoding="cp1252").first()[0] == "“€”"
    assert load(spark, write(tmp_path / "b.csv", "a;b\n1;x\n"), sep=";").first() == (1, "x")
    assert load(spark, write(tmp_path / "c.TXT", "a|b\n1|x\n2|y\n")).columns == ["a", "b"]
    assert load(spark, write(tmp_path / "d.csv", "a\nÄ\n", "latin-1"), encoding="latin-1").first()[0] == "Ä"


@pytest.mark.parametrize("name", ["a.pdf", "a.xls", "plain"])
def test_unknown_types_are_refused(spark, name):
    with pytest.raises(ValueError, match="Unsupported file type"):
        load(spark, name)


def test_spreadsheet_safety(spark):
    df = spark.createDataFrame([("=cmd|' /C calc'!A0", 1), ("+SUM(A1)", 2), ("@evil", 3), ("-1+1", 4), ("\tx", 5), ("safe", -6), (None, 7)],
                               "name string, `=bad_header` int")
    out = sanitize_for_spreadsheet(df)
    assert out.columns == ["name", "'=bad_header"]
    assert [r[0] for r in out.collect()] == ["'=cmd|' /C calc'!A0", "'+SUM(A1)", "'@evil", "'-1+1", "'\tx", "safe", None]
    assert [r[1] for r in out.collect()][5] == -6


def test_safe_labels(spark):
    want = {"Run @ 2026-06-11 10:30": "Run_2026-06-11_10_30", "../../etc/passwd": "etc_passwd", "": "results", "///": "results"}
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "raw string")
    assert {r[0]: r[1] for r in df.select("raw", safe_label(F.col("raw"))).collect()} == {**want, None: "results"}


def test_reason_text(spark):
    df = spark.sql("SELECT array(named_struct('cols', array('A', 'B'), 'vals', array('x', 'y')), "
                   "named_struct('cols', array('C'), 'vals', array('z')), named_struct('cols', array('D'), 'vals', array('p', 'q'))) AS e")
    assert df.select(reason_lines(F.col("e"))).first()[0] == ["A = x AND B = y", "C = z"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (2, "b")], "a long, b string")
    assert load(spark, export(df, str(tmp_path / "p.parquet"), "PARQUET")).orderBy("a").collect() == df.collect()
    assert spark.read.json(export(df, str(tmp_path / "j"), "json")).orderBy("a").first()["b"] == "=x"
    assert load(spark, export(df, str(tmp_path / "c.csv"), "csv")).orderBy("a").first()["b"] == "'=x"
    with pytest.raises(ValueError, match="Unknown export format"):
        export(df, str(tmp_path / "x"), "pdf")


def test_export_targets(spark, tmp_path):
    run = RarityDetector(max_dimensions=2).fit_predict(staff(spark), id_cols=["row_id"])
    everything = load(spark, export_result(run, str(tmp_path / "all.csv"), "csv", "all"))
    assert everything.count() == 600
    assert load(spark, export_result(run, str(tmp_path / "s.parquet"), "parquet", "summary")).first()["Checked_2d"]
    flagged = load(spark, export_result(run, str(tmp_path / "f.csv"), "csv"))
    assert flagged.count() == everything.where(F.col("TOTAL SCORE") > 0).count() > 0


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


@pytest.fixture
def scored(spark):
    return spark.createDataFrame([(0, "x", 0), (1, "y", 2), (2, "z", 0), (3, "w", 1)], "a int, b string, `TOTAL SCORE` int")


def test_datasets_are_stored_once(spark, catalog, scored):
    first = catalog.save_dataset(scored, "one")
    assert catalog.save_dataset(scored.orderBy(F.desc("a")), "another name") == first
    other = catalog.save_dataset(scored.where("a > 0"), "fewer")
    assert other != first and catalog.list_datasets().count() == 2
    assert catalog.load_dataset(first).orderBy("a").collect() == scored.collect()
    row = catalog.list_datasets().where(F.col("dataset_id") == first).first()
    assert (row["name"], row["n_rows"], row["n_cols"]) == ("one", 4, 3) and row["created_at"].endswith("+00:00")


def test_fingerprint_sees_duplicates_and_types(spark, scored):
    prints = {table_fingerprint(d) for d in (scored, scored.union(scored), scored.withColumn("a", F.col("a").cast("long")), scored.limit(3))}
    assert len(prints) == 4


def test_runs_round_trip_and_cascade(catalog, scored):
    data = catalog.save_dataset(scored, "d")
    run = catalog.save_run(data, "first", {"threshold": 0.05}, [{"Percent Flagged": 50.0}], scored, "text")
    loaded = catalog.load_run(run)
    assert loaded["n_flagged"] == 2 and loaded["params"] == {"threshold": 0.05} and loaded["summary"][0]["Percent Flagged"] == 50.0
    assert [r["TOTAL SCORE"] for r in catalog.reload(run)["most_flagged"].collect()] == [2, 1, 0, 0]
    assert catalog.list_runs().first()["dataset_name"] == "d" and catalog.list_runs(data + 1).count() == 0
    catalog.delete_dataset(data)
    assert catalog.list_runs().count() == 0 and catalog.list_datasets().count() == 0
    for missing in (lambda: catalog.load_run(run), lambda: catalog.load_dataset(data)):
        with pytest.raises(KeyError):
            missing()
    assert catalog.save_dataset(scored, "again") > data  # ids are not reused


def test_delete_run_and_purge(catalog, scored):
    data = catalog.save_dataset(scored, "d")
    a, b = (catalog.save_run(data, x, {}, {}, scored) for x in "ab")
    catalog.delete_run(a)
    assert [r["run_id"] for r in catalog.list_runs().collect()] == [b]
    catalog.purge_all()
    assert catalog.list_runs().count() == 0 and catalog.list_datasets().count() == 0


def test_old_score_name_and_no_score(spark):
    df = spark.createDataFrame([(1, "2"), (2, "x"), (3, None)], "id int, TOTAL_SCORE string")
    assert [r["flagged"] for r in compare.flag_rows(df, ["id"]).orderBy("id").collect()] == [True, False, False]
    assert not compare.flag_rows(df.drop("TOTAL_SCORE"), ["id"]).where("flagged").count()


def test_comparison_of_runs(spark, scored):
    other = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (9, 5)], "a int, `TOTAL SCORE` int")
    a, b = {"dataset_id": 1, "results": scored}, {"dataset_id": 2, "results": other}
    assert tuple(compare.compare_runs(a, b, ["a"]).first()) == (1, 0, 1)  # rows 3 and 9 have no partner
    b["dataset_id"] = 1
    assert tuple(compare.compare_runs(a, b, ["a"]).first()) == (1, 1, 2)
    diff = compare.compare_diff_rows(a, b, scored.drop("TOTAL SCORE"), ["a"]).collect()
    assert [(r["a"], r["in_a"], r["in_b"], r["b"]) for r in diff] == [(0, False, True, "x"), (3, True, False, "w"), (9, False, True, None)]
    params = compare.compare_params(spark, {"t": 0.05, "z": 1}, {"t": 0.5, "a": None})
    assert [tuple(r) for r in params.collect()] == [("a", "—", "None"), ("t", "0.05", "0.5"), ("z", "1", "—")]


def test_row_ids_of_files_need_no_copy(spark, tmp_path, monkeypatch):
    """Rows of Parquet files are told by their place; what is not a plain read of files is stored."""
    path = str(tmp_path / "rows with space%20.parquet")
    spark.range(1000).select(F.col("id").alias("v"), F.lit("x").alias("__file")).repartition(3).write.parquet(path)
    stored = []
    monkeypatch.setattr(session, "stage", lambda df: stored.append(df.columns) or df)
    rows = spark.read.parquet(path)
    read = rows.where("v % 2 = 0").withColumn("w", F.col("v") + 1)
    first, second = ({r["v"]: r["row_id"] for r in session.with_row_id(read).collect()} for _ in range(2))
    assert first == second and len(set(first.values())) == 500 and all("v" not in s for s in stored)  # but names of files
    assert {r["v"]: r["row_id"] for r in session.with_row_id(rows).collect()}.items() >= first.items()
    one = spark.read.parquet(str(next((tmp_path / "rows with space%20.parquet").glob("*.parquet"))))
    assert sorted(r["row_id"] for r in session.with_row_id(one).collect()) == list(range(one.count()))
    stored.clear()
    for df in (rows.unionByName(rows), rows.select(F.explode(F.array(F.lit(1), "v")).alias("v")), rows.join(rows.select("v"), "v"), rows.distinct(),
               rows.withColumn("r", F.rand()), spark.range(3).withColumnRenamed("id", "v"), rows.limit(5)):
        ids = [r["row_id"] for r in session.with_row_id(df).collect()]
        assert len(set(ids)) == len(ids) == df.count()
    assert [s[:2] for s in stored].count(["row_id", "v"]) == 7
    monkeypatch.undo()
    detector = RarityDetector(max_dimensions=1)
    assert detector.fit_predict(rows.select("v", (F.col("v") % 3).cast("string").alias("c"))).scores().count() == 1000


def test_records_with_line_breaks_are_read_by_many_tasks(spark, tmp_path):
    """Small blocks, so that records begin and end anywhere; the same rows as the reader of whole files gives."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rng = random.Random(4)
        quote = lambda t: '"' + t.replace('"', '""') + '"' if any(c in t for c in ',"\n\r') or rng.random() < 0.3 else t
        folder = tmp_path / "many.csv"
        folder.mkdir()
        for k, eol in enumerate(("\n", "\r\n")):
            lines = [",".join([str(k * 1000 + i), *(quote("".join(rng.choice(["a", "é", " ", ",", '"', "\n", "x y"]) for _ in range(rng.randrange(7))))
                                                   for _ in range(2))]) for i in range(100)]
            lines += [f'{k * 1000 + 500},5" pipe,plain', f'{k * 1000 + 501},"closed" early,"{"long " * 300}{eol}end"', "", f'{k * 1000 + 502},x,y']
            (folder / f"{k}.csv").write_bytes((eol.join(["id,a,b", *lines]) + eol * k).encode())
        path = str(folder)
        records = spanning_records(spark, [f"{path}/0.csv", f"{path}/1.csv"], ",")
        assert len(files_with_line_breaks(spark, path)) == 2 and records.count() == 206
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        whole = load(spark, path, multi_line=True).collect()
        assert sorted(load(spark, path).collect(), key=repr) == sorted(whole, key=repr) and len(whole) == 206
        write(tmp_path / "open.csv", 'a,b\n1,"never closed\nx\n')
        assert [(r.a, r.b) for r in load(spark, str(tmp_path / "open.csv")).collect()] == [(1, "never closed\nx")]  # what is open ends with the file
        write(tmp_path / "wide.csv", 'a,b\n1,"x\ny",3\n')
        with pytest.raises(Exception, match="more fields than the header in .*wide.csv"):
            load(spark, str(tmp_path / "wide.csv"), schema="a int, b string").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_eight_writers_at_once(spark, tmp_path):
    """No id is lost or given twice, equal content is stored once, and what one deletes stays deleted."""
    root = str(tmp_path / "shared")
    table = lambda i: spark.range(4).select(F.col("id").alias("a"), F.lit(i % 5).alias("TOTAL SCORE"))

    def work(i):
        own = Catalog(spark, root)
        data = own.save_dataset(table(i), f"t{i}")
        run = own.save_run(data, f"r{i}", {}, {}, table(i))
        if i == 7:
            own.delete_run(run)
        return i, data, run
    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(work, range(8)))
    catalog = Catalog(spark, root)
    assert sorted(r for _, _, r in done) == list(range(1, 9)) and {d for _, d, _ in done} == set(range(1, 6))
    assert all(d == e for i, d, _ in done for j, e, _ in done if i % 5 == j % 5)
    assert catalog.list_datasets().count() == 5 and catalog.list_runs().count() == 7
    assert {r["label"] for r in catalog.list_runs().collect()} == {f"r{i}" for i in range(7)}
    assert all(catalog.load_dataset(d).first()["TOTAL SCORE"] == i % 5 for i, d, _ in done)
    assert len(list((tmp_path / "shared" / "data").iterdir())) == 5  # what lost the race is gone
    names = sorted(p.name for p in (tmp_path / "shared" / "log").iterdir() if p.name.endswith(".json"))
    assert names == [f"{v:012d}.json" for v in range(1, len(names) + 1)] and len(names) == 5 + 8 + 1


def test_texts_are_written_to_csv_by_several_tasks(spark, tmp_path, monkeypatch):
    """The query over a table of many files writes more than one CSV file, each from four parts at most, and finds every text again."""
    docs = spark.range(48).select(F.col("id").alias("doc_id"), F.concat(F.lit('a "q", \n'), F.col("id").cast("string")).alias("text"))
    docs.repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(registry, "scratch_path", lambda spark, name: str(tmp_path / name))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a part per file
    try:
        got = registry.scan_csv_line_breaks(spark, str(tmp_path))
        parts = spark.read.parquet(str(tmp_path / "documents.parquet")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert parts >= 12 and len(list((tmp_path / "texts.csv").glob("part-*"))) * 4 >= parts
    want = {(r.doc_id, r.t, len(r.text)) for r in docs.select("*", F.md5("text").alias("t")).collect()}
    assert {(r.doc_id, r.text, r.n_chars) for r in got.collect()} == want
