"""The decision table over its full input grid."""

import itertools

from tideline.functions.clock import followup_due
from tideline.functions.decision import contract_guard, decide, pick_evidence
from tideline.streaming.conversation import Opinion, reply_verdict
from pyspark.sql import functions as F

LABELS = ("leaf_rust", "phoma", "healthy", "other")


def expected(label, proba, llm, sure, second):
    """The table as plain rules."""
    confident = proba >= 0.8
    if label == "other":
        agreed = llm is None or (llm == "other" and sure is not False)
        return ("escalate", "other") if second or (confident and agreed) else ("clarify", "unclear")
    if confident and llm in (label, None):
        return ("answer", "agree" if llm else "llm_unavailable")
    return ("escalate" if second else "clarify", "disagree" if confident else "low_confidence")


def test_full_grid(spark):
    grid = list(itertools.product(LABELS, (0.5, 0.8, 0.95), (*LABELS, None), (True, False, None), (True, False)))
    df = spark.createDataFrame(grid, "label string, proba double, llm string, sure boolean, second boolean")
    rows = df.select("*", decide("label", "proba", "llm", "sure", "second", question=F.lit("ask_leaf_look")).alias("v")).collect()
    assert len(rows) == len(grid) == 360
    for r in rows:
        assert (r.v.decision, r.v.reason) == expected(r.label, r.proba, r.llm, r.sure, r.second), r
        assert not (r.label == "other" and r.v.decision == "answer")
        assert not (r.second and r.v.decision == "clarify")
        want = {"answer": f"adv_{r.label}", "escalate": "unsure", "clarify": "ask_leaf_look" if r.llm else "clarify"}[r.v.decision]
        assert r.v.template_id == want
        if r.second:
            mine = Opinion(r.label, r.proba, r.llm, r.sure, False)
            got = reply_verdict(mine._replace(proba=0.0), mine)
            assert (got.decision, got.template_id) == (r.v.decision, r.v.template_id)


def test_pick_evidence(spark):
    cases = [("phoma", 0.9, "other", 0.5, "phoma"), ("other", 0.9, "phoma", 0.5, "phoma"), ("phoma", 0.9, "healthy", 0.9, "healthy"),
             ("phoma", 0.7, "healthy", 0.1, "healthy"), (None, None, "healthy", 0.1, "healthy")]
    df = spark.createDataFrame(cases, "al string, ap double, cl string, cp double, want string")
    assert all(r[0] == r[1] for r in df.select("want", pick_evidence(("al", "ap"), ("cl", "cp"))["label"]).collect())


def test_guard_sends_half_filled_verdicts_to_a_human(spark):
    df = spark.createDataFrame([("phoma", 0.9, "answer", "adv", "agree"), ("phoma", 0.9, "reply", "adv", ""), ("phoma", 0.9, "answer", "", ""),
                                ("phoma", 0.9, None, None, None)], "l string, p double, d string, t string, r string")
    got = [r[0].decision for r in df.select(contract_guard("l", "p", "d", "t", "r")).collect()]
    assert got == ["answer", "escalate", "escalate", "escalate"]


def test_followup_due_is_local_evening_three_days_on(spark):
    # 22:30 UTC is 01:30 of the next day at +03:00.
    df = spark.sql("SELECT explode(array(timestamp'2026-10-01 10:00:00 UTC', timestamp'2026-10-01 22:30:00 UTC')) AS ts")
    got = [r[0] for r in df.select(followup_due("ts").cast("string")).collect()]
    assert got == ["2026-10-04 15:00:00", "2026-10-05 15:00:00"]
