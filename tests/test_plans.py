"""What plans must not do, whatever the tables' size."""

import pytest

from tidelog.plans import catalog

#: Queries that join pulled messages, which are twenty times as many as the pulls that Spark takes their size from.
EXPLODED = [
    "a21_consumer_latency",
    "a21_consumer_metrics",
    "j1_pull_translation",
    "j3_payload_lookup",
    "j4_ack_records",
    "j5_h5_trail",
    "k11_record_decode",
    "p12_silent_to_retry",
    "p2_redelivery",
    "p7_lost_to_retry",
    "snk12_record_history",
]


def broadcast_rows(plan):
    """The nodes whose rows a plan broadcasts, down to the next aggregate."""
    depth, below, skipped = (lambda line: len(line) - len(line.lstrip(" :+-"))), None, None
    for line in plan.splitlines():
        if below is not None and depth(line) <= below:
            below = skipped = None
        if skipped is not None and depth(line) <= skipped:
            skipped = None
        if below is None and "BroadcastExchange" in line:
            below = depth(line)
        elif below is not None and skipped is None:
            if "Aggregate" in line:
                skipped = depth(line)
            else:
                yield line.strip(" :+-")


@pytest.mark.parametrize("name", EXPLODED)
def test_exploded_rows_are_not_broadcast(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan
    assert not [x for x in broadcast_rows(plan) if x.startswith("Generate explode")]


def test_pulls_again_are_found_by_sorting(spark, sf_dir):
    plan = catalog.QUERIES["src17_p1_pull"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "leftHint=(strategy=merge)" in plan


@pytest.mark.parametrize("name", ["p2_redelivery", "src17_p1_pull"])
def test_readable_messages_are_not_broadcast(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
    lines = plan.splitlines()  # broadcasts stand below the aggregates of others, too
    each = [x for i, line in enumerate(lines) if "BroadcastExchange" in line for x in broadcast_rows("\n".join(lines[i:]))]
    assert not [x for x in each if x.startswith("FileScan")]
