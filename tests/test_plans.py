"""Physical-plan properties of the headline operators (what ``explain`` shows)."""

import contextlib
import io

from conftest import SF01


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def q(spark, name):
    import __spark_entry__ as ent
    return ent.queries()[name](spark, SF01)


def test_vocab_single_shuffle_with_partial_agg_and_topk(spark):
    p = plan(q(spark, "vocab_fit"))
    assert p.count("partial_sum") >= 1                 # map-side combine before the term shuffle
    assert "TakeOrderedAndProject(limit=11024" in p   # top-k without a global sort
    assert p.count("Exchange hashpartitioning(_groupingexpression") == 1
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_tfidf_broadcasts_bounded_vocabulary(spark):
    p = plan(q(spark, "tfidf_transform"))
    assert "BroadcastHashJoin" in p
    assert "SortMergeJoin" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    # count per (doc, idx) and collect per doc reuse the doc_id partitioning of
    # the input: every doc_id exchange is the input spread, none is added for
    # the aggregations
    lines = [ln for ln in p.splitlines() if "Exchange hashpartitioning(doc_id" in ln]
    assert lines and all("REPARTITION_BY_NUM" in ln for ln in lines)


def test_confusion_computed_once(spark):
    p = plan(q(spark, "class_report"))
    assert p.count("partial_count(1)") == 1
    assert "SortMergeJoin" not in p


def test_filters_pushed_to_scan(spark):
    p = plan(q(spark, "preprocess_job"))
    assert "PushedFilters: [IsNotNull(text), Not(EqualTo(text,))]" in p


def test_running_loss_has_no_per_key_window(spark):
    p = plan(q(spark, "running_loss"))
    # windows are keyed by (user_id, chunk) or run over per-chunk totals; the one by
    # user_id alone reads only the rows next to chunk borders
    lines = p.splitlines()
    windows = [i for i, ln in enumerate(lines) if "Window [" in ln]
    alone = [i for i in windows if "_chunk" not in lines[i]]
    assert len(alone) <= 1
    assert all(any("Filter (_head" in ln and "_tail" in ln for ln in lines[i:i + 6]) for i in alone)
    assert "SortMergeJoin" not in p and "BroadcastNestedLoopJoin" not in p  # no self-join of the log


def test_no_python_udf_in_tokenizer(spark):
    p = plan(q(spark, "tokenize_set"))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_no_cross_joins_in_catalogue(spark):
    """No catalogue query with an oracle plans a cross join or a nested-loop join."""
    import __spark_entry__ as ent
    qs, sql = ent.queries(), ent.oracle_sql()
    bad = []
    for name in sorted(sql):
        p = plan(qs[name](spark, SF01))
        if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p:
            bad.append(name)
    assert not bad, bad


def test_building_a_frame_runs_nothing(spark):
    """Building a tokenizer query starts jobs for file schemas only, one per table read."""
    import __spark_entry__ as ent
    tables = {"tokenize_set": 1, "lex_tokens": 1, "split_hashtag": 1, "preprocess_job": 2, "vocab_fit": 1}
    sc = spark.sparkContext
    for name, reads in tables.items():
        sc.setJobGroup(f"building {name}", name)
        ent.queries()[name](spark, SF01)
        jobs = sc.statusTracker().getJobIdsForGroup(f"building {name}")
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert len(jobs) <= reads, (name, jobs)
