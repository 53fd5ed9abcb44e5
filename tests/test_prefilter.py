"""The filter that goes to a scan, and what it keeps out of exchanges."""

from __future__ import annotations

import pytest
from conftest import SMALL_DIR
from pyspark.sql import functions as F

from checks.queries import BINDINGS
from fleetgauge import REPORTS, report
from fleetgauge.operators.prefilter import may_be_among
from fleetgauge.sources.adapters import telemetry

TOP_STATEMENTS = ["top_queries_by_worker_time", "top_queries_by_total_cpu", "top_queries_by_avg_cpu",
                  "top_statements_by_avg_io", "top_statements_of_database"]


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("words", [1, 64, 1 << 15])
@pytest.mark.parametrize("keys", [0, 1, 3000])
def test_no_match_is_lost(spark, words, keys):
    df = spark.range(20_000).selectExpr("id", "CONCAT('k', id) AS name", "IF(id % 7 = 0, NULL, id) AS other")
    found = spark.range(keys).selectExpr("CONCAT('k', id * 5) AS name", "id * 5 AS id", "id AS more")
    passed = {r["id"] for r in may_be_among(df, found, ["id", "name"], words).select("id").collect()}
    wanted = {5 * i for i in range(keys)} & set(range(20_000))
    assert wanted <= passed
    if words > 64:
        assert len(passed - wanted) <= 20
    if not keys:
        assert not passed


def test_collated_keys_are_not_filtered(spark):
    df = spark.sql("SELECT CAST(n AS STRING COLLATE UTF8_LCASE) AS n FROM VALUES ('A'), ('a'), ('b') AS t(n)")
    assert may_be_among(df, df.where("n = 'a'").limit(1), ["n"]).count() == 3


def test_few_others_pass(spark):
    df = spark.range(400_000)
    found = spark.range(100_000).selectExpr("-1 - id AS id")
    assert may_be_among(df, found, ["id"]).count() < 1000  # 0.2 percent, measured


def nodes(plan):
    yield plan
    below = plan.children()
    for i in range(below.size()):
        yield from nodes(below.apply(i))
    if plan.nodeName().endswith("QueryStage"):
        yield from nodes(plan.plan())


def exchanges(df):
    """Rows written by every exchange of an executed plan, by the names of its columns."""
    final = df._jdf.queryExecution().executedPlan().executedPlan()
    for node in nodes(final):
        if node.nodeName() == "Exchange":
            names = [node.output().apply(i).name() for i in range(node.output().size())]
            yield names, node.metrics().apply("shuffleRecordsWritten").value()


@pytest.mark.parametrize("name", TOP_STATEMENTS)
def test_texts_of_winners_only(spark, no_broadcast, name):
    """Fifty times the texts and wide ones: the exchange of texts has at most twice the rows of the winners."""
    fn, params = BINDINGS[name]
    tables = telemetry(spark, SMALL_DIR, REPORTS[fn].tables)
    more = tables["sql_text"].crossJoin(spark.range(50).withColumnRenamed("id", "n")).selectExpr(
        "* EXCEPT (handle, text, n)", "IF(n = 0, handle, concat(handle, '-', n)) AS handle", "concat(text, repeat(' wide', 50)) AS text"
    )
    wide = {**tables, "sql_text": more.select(*tables["sql_text"].columns)}
    got = report(fn, wide, **params)
    rows = got.collect()
    plain = report(fn, {**tables, "sql_text": tables["sql_text"].withColumn("text", F.expr("concat(text, repeat(' wide', 50))"))}, **params)
    assert sorted(map(repr, rows)) == sorted(map(repr, plain.collect())) and rows
    # Winners before other inner joins: the exchange that takes them to their texts carries no more.
    sent = [n for names, n in exchanges(got) if names[-1] == "text" and "row_rank" not in names and "total_worker_time" not in names]
    winners = len(rows)
    assert sent and sent[0] <= 2 * winners, (sent, winners)


@pytest.mark.parametrize("name", TOP_STATEMENTS)
def test_text_is_read_by_one_scan_and_nothing_runs_early(spark, no_broadcast, tmp_path, name):
    from fleetgauge.sources.snapshots import read_tables, write_table

    fn, params = BINDINGS[name]
    for table, df in telemetry(spark, SMALL_DIR, REPORTS[fn].tables).items():
        write_table(df, str(tmp_path), table)
    tables = read_tables(spark, str(tmp_path), REPORTS[fn].tables)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(name, "")
    got = report(fn, tables, **params)
    assert not tracker.getJobIdsForGroup(name)
    got.collect()
    spark.sparkContext._jsc.clearJobGroup()
    final = got._jdf.queryExecution().executedPlan().executedPlan()
    scans = [n.output() for n in nodes(final) if n.nodeName().startswith("Scan parquet")]
    named = [[o.apply(i).name() for i in range(o.size())] for o in scans]
    assert sum("text" in names for names in named) == 1
    direct = report(fn, telemetry(spark, SMALL_DIR, REPORTS[fn].tables), **params)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, direct.collect()))
