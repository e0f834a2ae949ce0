"""Readers and writers: quoted multi-line CSV cells, positional columns, modes."""

from pyspark.sql import functions as F

from postlens.sources.readers import read_labeled
from postlens.sources.sinks import scratch_path, write_table


def test_csv_roundtrip_multiline_and_positions(spark):
    rows = [("line one\nline \"two\"", "1"), ("plain, with comma", ""), (None, "0")]
    df = spark.createDataFrame(rows, "text string, label string").coalesce(1)
    path = scratch_path(spark, "csv-test")
    write_table(df, path, "csv", mode="overwrite")
    by_name = read_labeled(spark, path, "csv")
    by_pos = read_labeled(spark, path, "csv", text_col=0, label_col=1)
    got = sorted((r.text or "", r.label or "") for r in by_name.collect())
    want = sorted((t or "", lab or "") for t, lab in rows)
    assert got == want
    assert by_pos.select("text", "label").exceptAll(by_name.select("text", "label")).count() == 0
    assert by_name.select("doc_id").distinct().count() == len(rows)


def test_append_mode_accumulates(spark):
    df = spark.createDataFrame([("a", "1")], "text string, label string")
    path = scratch_path(spark, "append-test")
    write_table(df, path, "csv", mode="append")
    write_table(df, path, "csv", mode="append")
    assert read_labeled(spark, path, "csv").filter(F.col("text") == "a").count() == 2


def test_one_file_of_long_cells_is_read_by_many_tasks(spark):
    """Splits of a few hundred bytes: inside cells, inside records, and whole splits inside one cell."""
    import random
    rng = random.Random(1)
    rows = []
    for i in range(300):
        words = rng.choices(['plain', 'a "quoted" one', "two\nlines", "", '"', "\n\n", "comma, and", "x" * rng.choice([5, 900]), "\n".join(["l"] * 400)],
                            k=rng.randint(1, 3), weights=[9, 4, 4, 2, 2, 2, 4, 2, 1])
        rows.append((rng.choice(["", None, " ".join(words)]), str(i % 2)))
    path = scratch_path(spark, "long-cells")
    write_table(spark.createDataFrame(rows, "text string, label string").coalesce(1), path, "csv", mode="overwrite")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\x00").csv(path)
    want = sorted(map(str, plain.collect()))
    try:
        for n in names:
            spark.conf.set(n, "700")
        df = read_labeled(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 15
        assert sorted(map(str, df.select("text", "label").collect())) == want
        assert len(want) == len(rows)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_columns_go_by_the_header(spark):
    import pytest
    path = scratch_path(spark, "header")
    df = spark.createDataFrame([("1", "hello", "7", "x")], ["label", "text", "my id", "note"])
    write_table(df, path, "csv", mode="overwrite")
    assert [tuple(r) for r in read_labeled(spark, path).select("text", "label").collect()] == [("hello", "1")]
    assert [tuple(r) for r in read_labeled(spark, path, text_col=3, label_col=0).select("text", "label").collect()] == [("x", "1")]
    assert [tuple(r) for r in read_labeled(spark, path, multi_line=False).select("text", "label").collect()] == [("hello", "1")]
    with pytest.raises(ValueError, match="no column"):
        read_labeled(spark, path, label_col="toxic")
    write_table(df.select("text", "label"), path, "csv", mode="append")
    with pytest.raises(ValueError, match="unlike header"):
        read_labeled(spark, path)


def test_a_run_appends_once_and_a_failed_one_shows_nothing(spark):
    import pytest

    from postlens.sources.sinks import append_run, committed_runs
    path = scratch_path(spark, "runs")
    df = spark.createDataFrame([("a", "1"), ("b", "0")], "text string, label string")
    for run in ("one", "one", "two"):
        append_run(df, path, run)
    broken = df.select(F.when(F.col("text") == "b", F.raise_error(F.lit("stop"))).otherwise(F.col("text")).alias("text"), "label")
    with pytest.raises(Exception, match="stop"):
        append_run(broken, path, "three")
    assert len(committed_runs(spark, path)) == 2
    assert sorted(r.text for r in read_labeled(spark, committed_runs(spark, path)).collect()) == ["a", "a", "b", "b"]


def test_read_labeled_columns_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from postlens.plans import io_queries
    texts = [(i, f"row {i},\n\"quoted\"" if i % 3 else None) for i in range(300)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(0, 300, 5)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder = str(tmp_path / "columns")
    monkeypatch.setattr(io_queries, "scratch_path", lambda *_: folder)
    rows = io_queries.q_read_labeled_columns(spark, str(tmp_path)).collect()
    assert len([f for f in (tmp_path / "columns").iterdir() if f.name.endswith(".csv")]) > 1
    want = sorted((t or "", str(i % 2 if i % 5 == 0 else 2)) for i, t in texts)
    assert sorted((r.text or "", r.label) for r in rows) == want


def test_appended_twice_and_preprocessed_once(spark, monkeypatch):
    """Both runs of the append write rows that were tokenized before."""
    from postlens.plans import io_queries
    from postlens.sources.sinks import append_run, scratch_path
    d = scratch_path(spark, "tables")
    texts = [(1, "Hello there, good people"), (2, "second\nmessage"), (3, ""), (4, None), (5, "Hello there, good people")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    plans = []

    def kept(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return append_run(df, *args)
    monkeypatch.setattr(io_queries, "append_run", kept)
    got = sorted((r.text, r.label) for r in io_queries.q_write_preprocessed(spark, d).collect())
    want = sorted((r.text, str(r.label)) for r in io_queries.q_preprocess_job(spark, d).collect())
    assert got == want and len(got) == 3
    assert len(plans) == 2 and not any("regexp" in p or "transform(" in p for p in plans)
