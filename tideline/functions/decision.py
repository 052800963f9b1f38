"""Decision tables as CASE expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.text import _col, has_any_phrase, hint_score
from tideline.functions.vector import let

# The names of the decision contract.
DECISIONS = ("answer", "clarify", "escalate")
REJECT_TEMPLATE = "unsure"
ASK_TEMPLATE = "clarify"
OTHER = "other"
THRESHOLD = 0.8
KEYWORD_PROBA = 0.9


def _verdict(label, proba, decision, template, reason) -> Column:
    return F.struct(label.alias("label"), proba.cast("double").alias("proba"), decision.alias("decision"),
                    template.alias("template_id"), reason.alias("reason"))


def keyword_decide(text, hints: dict[str, Sequence[str]], out_of_scope: Sequence[str], second=False,
                   prefix: str = "adv_") -> Column:
    """Verdict without a model: phrase hits answer, out-of-scope words go to a human, else ask once."""
    second = F.lit(second) if isinstance(second, bool) else second

    def verdict(best, outside):
        hit, handed = best["hits"] > 0, outside | second
        return _verdict(
            F.when(hit, best["label"]).otherwise(F.lit(OTHER)), F.when(hit, KEYWORD_PROBA).otherwise(0.0),
            F.when(hit, "answer").when(handed, "escalate").otherwise("clarify"),
            F.when(hit, F.concat(F.lit(prefix), best["label"])).when(handed, REJECT_TEMPLATE).otherwise(ASK_TEMPLATE),
            F.when(hit, "").when(outside, "out_of_scope").when(second, "still_unclear").otherwise("unreadable"))

    # Each text is searched once, and for out-of-scope words only where no hint was found.
    return let(hint_score(text, hints), lambda best: let(
        (best["hits"] == 0) & has_any_phrase(text, out_of_scope), lambda outside: verdict(best, outside)))


def decide(label, proba, llm_label, llm_sure, second, threshold: float = THRESHOLD, question=None,
           prefix: str = "adv_") -> Column:
    """Answer, ask or hand over, from two opinions.

    ``other`` is never answered, and a reply to our own question never leads to another one.
    """
    label, proba, llm = _col(label), _col(proba), _col(llm_label)
    second = F.lit(second) if isinstance(second, bool) else _col(second)
    confident = proba >= threshold
    other = label == OTHER
    sure_other = (llm == OTHER) & F.coalesce(_col(llm_sure), F.lit(True))
    hand_over_other = second | (confident & (llm.isNull() | F.coalesce(sure_other, F.lit(False))))
    agree = confident & F.coalesce(llm == label, F.lit(False))
    alone = confident & llm.isNull()
    decision = (F.when(other & hand_over_other, "escalate").when(other, "clarify")
                 .when(agree | alone, "answer")
                 .when(second, "escalate").otherwise("clarify"))
    reason = (F.when(other & hand_over_other, "other").when(other, "unclear")
               .when(agree, "agree").when(alone, "llm_unavailable")
               .when(confident, "disagree").otherwise("low_confidence"))
    asked = F.coalesce(_col(question), F.lit(ASK_TEMPLATE)) if question is not None else F.lit(ASK_TEMPLATE)
    template = (F.when(decision == "answer", F.concat(F.lit(prefix), label))
                 .when(decision == "escalate", REJECT_TEMPLATE)
                 .when(llm.isNotNull(), asked).otherwise(ASK_TEMPLATE))
    return _verdict(label, F.bround(proba, 3), decision, template, reason)


def pick_evidence(answer: tuple, combined: tuple, threshold: float = THRESHOLD) -> Column:
    """Of a reply alone and both texts together, each a (label, probability) pair, the verdict to use."""
    (al, ap), (cl, cp) = ((_col(a), _col(b)) for a, b in (answer, combined))
    alone = F.coalesce((al != OTHER) & (ap >= threshold) & (ap > cp), F.lit(False))
    return F.struct(F.when(alone, al).otherwise(cl).alias("label"), F.when(alone, ap).otherwise(cp).alias("proba"),
                    F.when(alone, "answer").otherwise("combined").alias("evidence"))


def is_usable(decision, template) -> Column:
    return F.coalesce(_col(decision).isin(*DECISIONS) & (_col(template) != ""), F.lit(False))


def contract_guard(label, proba, decision, template, reason) -> Column:
    """A half-filled verdict goes to a human instead of sending a blank reply."""
    ok = is_usable(decision, template)
    return _verdict(F.when(ok, _col(label)).otherwise(OTHER), F.when(ok, _col(proba)).otherwise(0.0),
                    F.when(ok, _col(decision)).otherwise("escalate"),
                    F.when(ok, _col(template)).otherwise(REJECT_TEMPLATE),
                    F.when(ok, _col(reason)).otherwise("unusable_verdict"))


def label_guard(label, allowed: Sequence[str], fallback: str | None = None) -> Column:
    """The value if the schema allows it, else the fallback (null by default)."""
    c = _col(label)
    return F.when(c.isin(*allowed), c).otherwise(F.lit(fallback))


def short_reason(reason, longest: int = 80) -> Column:
    return F.substring(_col(reason), 1, longest)
