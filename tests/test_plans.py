"""What the physical plans must and must not contain."""

from pyspark.sql import functions as F

from helpers import chat, prompts, requests
from promptledger.operators import detect, ledger, normalise, pricing, stats
from promptledger.plans.chain import REDACT, live_chain
from promptledger.schemas import LEDGER

AWS = r"AKIA[0-9A-Z]"
# One expression for a rule names its pattern twice: extract and split.
ONCE = 2


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_filter_on_findings_does_not_scan_twice(spark):
    df = detect.scan_secrets(prompts(spark, "a", "b"))
    assert optimised(df).count(AWS) == ONCE
    assert optimised(df.where(F.size("findings") > 0)).count(AWS) == ONCE
    assert optimised(detect.explode_findings(df, "arrival_seq").where("kind = 'jwt'")).count(AWS) == ONCE


def test_a_filter_on_decisions_repeats_nothing(spark):
    df = normalise.normalise(requests(spark, [("/v1/messages", chat("m", "x"))]))
    chain = live_chain(None, REDACT, token_column="n")
    out = chain.decide(df.withColumn("n", F.length("content")))
    records = ledger.build_ledger(out, chain.names)
    for plan in (
        out.where("verdict = 'rejected'"), records.where("model = 'gpt-4o'"),
        stats.summary(records.where("token_count > 5")),
    ):
        assert optimised(plan).count(AWS) == ONCE
    parsed_once = optimised(df.where("model = 'gpt-4o' AND content <> ''"))
    assert parsed_once.count("parseJson") == optimised(df).count("parseJson")


def test_filters_on_input_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS arrival_seq", "CAST(id AS STRING) AS content", "1 AS other").write.parquet(
        str(tmp_path / "t")
    )
    df = detect.scan_secrets(spark.read.parquet(str(tmp_path / "t")).drop("other"))
    plan = physical(df.where("arrival_seq > 50").select("arrival_seq", "findings"))
    assert "GreaterThan(arrival_seq,50)" in plan and "other" not in plan.split("ReadSchema")[1]


def ledger_table(spark, tmp_path):
    spark.createDataFrame([], LEDGER).write.parquet(str(tmp_path / "ledger"))
    return spark.read.parquet(str(tmp_path / "ledger"))


def test_statistics_combine_before_the_shuffle_and_read_few_columns(spark, tmp_path):
    records = ledger_table(spark, tmp_path)
    plan = physical(stats.summary(records))
    assert "partial_count" in plan and "findings" not in plan.split("ReadSchema")[1]
    plan = physical(stats.breakdown(records, stats.BY_MODEL))
    assert "partial_count" in plan and "latency_ms" not in plan.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in physical(stats.recent(records))


def test_copies_of_one_id_collapse_before_the_shuffle(spark, tmp_path):
    plan = physical(ledger.first_per_request(ledger_table(spark, tmp_path)))
    assert plan.index("partial_min_by") > plan.index("Exchange")
    assert "Window" not in plan


def test_no_cross_joins(spark, tmp_path):
    records = ledger_table(spark, tmp_path)
    counted = stats.breakdown(records, stats.BY_MODEL, ordered=False)
    named = records.select("arrival_seq", "model", F.lit(1).alias("token_count"))
    for df in (stats.shares(counted), pricing.evaluate(named), pricing.unknown_models(named)):
        plan = physical(df)
        assert "Cartesian" not in plan and "NestedLoop" not in plan
