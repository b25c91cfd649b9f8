"""The plans used beyond broadcast size: no broadcast joins, and salting forced on."""

import pytest
from oracle import connect, difference

import __spark_entry__ as entry_module
from gradewell.plans import skew

SF = "/root/testdata/sf0.001"
JOINED = (
    "A3_binary_metrics", "A12_containment_open_label_set", "A13_open_counts", "A14_distribution_bias", "A15_allowed_bias",
    "A20_share_of_total", "C9_repair_labels", "C10_bias_report", "C13_preference_pairs_chat", "C14_questionnaire_vote",
    "J1_override_join", "J1_override_strict", "J2_semi_join_gold_labels", "J3_positional_zip", "R2_wide_metrics",
    "T1_rouge_n", "T5_greedy_token_match", "U2_fallback_labeller",
)

BOUNDED = {name: 1 for name in ("A13_open_counts", "A15_allowed_bias", "A20_share_of_total", "C9_repair_labels")}


@pytest.fixture
def large(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", JOINED)
def test_without_broadcast(large, name):
    df = entry_module.queries()[name](large, SF)
    assert difference(df, connect(SF), entry_module.oracle_sql()[name]) is None
    plan = executed(df)
    # Only tables bounded by configuration may still be broadcast.
    assert plan.count("BroadcastHashJoin") <= BOUNDED.get(name, 0)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hot_texts_are_salted(large):
    """With many tasks a text of a few hundredths of the rows is more than half a fair share; with few it is not."""
    before = large.conf.get("spark.sql.shuffle.partitions")
    large.conf.set("spark.sql.shuffle.partitions", "512")
    try:
        assert "_salt" in executed(entry_module.queries()["J1_override_join"](large, SF))
    finally:
        large.conf.set("spark.sql.shuffle.partitions", before)


def test_small_lookups_are_broadcast_and_the_rows_stay_in_place(spark):
    plan = executed(entry_module.queries()["J1_override_join"](spark, SF))
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") <= 1


@pytest.mark.parametrize("name", ["A11_exact_allowed_counts", "A12_containment_counts", "A13_open_counts", "A14_distribution_bias",
                                  "C8_label_audit", "C10_bias_report", "C10_bias_table", "C11_distribution_report"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_distributions_scan_once(spark, large, name, broadcast):
    """Counts feed shares, totals and scores without reading the rows again, in any form of join."""
    session = spark if broadcast else large
    store = session.sparkContext._jsc.sc().statusStore()

    def jobs():
        found = store.jobsList(None)
        return {found.apply(i).jobId(): found.apply(i).stageIds() for i in range(found.size())}

    before = set(jobs())
    plan = executed(entry_module.queries()[name](session, SF))
    assert plan.count("FileScan") == 0 and "ExistingRDD" in plan
    session.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = {ids.apply(k) for job, ids in jobs().items() if job not in before for k in range(ids.size())}
    read = sum(store.lastStageAttempt(stage).inputRecords() for stage in stages)
    rows = session.read.parquet(f"{SF}/documents.parquet").count()
    assert read <= rows + 2000  # the documents once, and some counts


def test_head_per_group_limits_before_the_shuffle(spark):
    plan = executed(entry_module.queries()["K4_head_per_dataset"](spark, SF))
    assert plan.count("WindowGroupLimit") == 2


def test_scans_read_only_needed_columns(spark):
    plan = executed(entry_module.queries()["C6_score_numeric_answers"](spark, SF))
    schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert set(part.split(":")[0] for part in schema.removeprefix("struct<").split(",")) == {
        "l_orderkey", "l_linenumber", "l_quantity"}
