"""Whole decision rules over columns: label trust, form identity, next action, field disposition, and the gates of a shadow run.

A condition that isn't known counts as not met. Thresholds are parameters, with
the usual values as defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import wilson
from ..sources.staging import staged
from .decisions import ladder
from .policies import next_action

#: Traits of a form and the least score of each; those at which a form can't be told without it.
FORM_TRAITS = {
    "PAGE_GEOMETRY": 0.70, "PATIENT_INSURED_RELATIONSHIP": 0.55, "CLAIM_DIAGNOSIS_LAYOUT": 0.45, "SERVICE_LINE_GRID": 0.65, "PROVIDER_BILLING_LAYOUT": 0.45, "HIGH_VALUE_ANCHORS": 0.55, "SPATIAL_RELATIONSHIPS": 0.45, "TEMPLATE_REGISTRATION": 0.70,
}
FORM_ESSENTIAL = ("SERVICE_LINE_GRID", "SPATIAL_RELATIONSHIPS")
#: Words of a field's name and the route they send it on, in order.
FIELD_ROUTES = (
    ("npi", ("npi",)), ("member_id", ("member_id", "subscriber_id", "patient_id")), ("name", ("name",)), ("address", ("address", "addr", "city", "state", "zip")), ("date", ("date", "dob")), ("amount", ("amount", "charge", "total", "quantity", "units")), ("code", ("code", "cpt", "hcpcs", "icd")),
)


def _yes(condition: Column) -> Column:
    return F.coalesce(condition.cast("boolean"), F.lit(False))


def _listed(*checks: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(_yes(c), F.lit(name)) for c, name in checks))))


def label_trust(reviewer: Column, approver: Column, validated: Column, revalidated: Column, visible: Column, crop_approved: Column, correction: Column, holdout: Column, split: Column, retunes: Column) -> Column:
    """Struct (eligible, reasons): whether a corrected label may be learned from, and all that speaks against it."""
    why = _listed(
        (reviewer.eqNullSafe(approver), "INDEPENDENT_APPROVER_REQUIRED"), (~_yes(validated), "DETERMINISTIC_VALIDATION_REQUIRED"), (~_yes(revalidated), "CLAIM_REVALIDATION_REQUIRED"), (~_yes(visible), "VISIBLE_CROP_EVIDENCE_REQUIRED"),
        (~_yes(crop_approved), "CROP_QUALITY_NOT_APPROVED"), (F.trim(F.coalesce(correction, F.lit(""))) == "", "EMPTY_CORRECTION"), (_yes(holdout) | _yes(split == "holdout"), "HOLDOUT_FEEDBACK_EXCLUDED"), (retunes, "AUTOMATIC_PRODUCTION_RETUNING_PROHIBITED"),
    )
    return F.struct((F.size(why) == 0).alias("eligible"), why.alias("reasons"))


def form_identity(scores: dict[str, Column], contradictions: Column, family: str = "CMS", other: tuple[str, ...] = ("UB", "INSTITUTIONAL"), least: dict[str, float] | None = None, essential: tuple[str, ...] = FORM_ESSENTIAL, verified_from: int = 3, ambiguous_from: int = 2) -> Column:
    """Struct (status, score, support, reason, fixed): whether a page is the form it is taken for.

    A trait supports it from its least score on. A form is VERIFIED with enough
    traits, all essential ones among them, and no contradiction (an array of
    codes; those that name the ``other`` form tell why); only then may the fixed
    extractor take it.
    """
    least = FORM_TRAITS if least is None else least
    support = _listed(*((scores[name] >= limit, name) for name, limit in least.items()))
    against = F.coalesce(contradictions, F.array().cast("array<string>"))
    none, n = F.size(against) == 0, F.size(support)
    verified = (n >= verified_from) & none
    for name in essential:
        verified = verified & F.array_contains(support, name)
    ambiguous = (n >= ambiguous_from) & none
    named = F.exists(against, lambda c: ladder_any(c, other))
    reason = ladder((verified, f"{family}_VERIFIED_IDENTITY"), (named, f"{family}_{other[0]}_CONTRADICTION"), (~none, f"{family}_LAYOUT_CONTRADICTION"), (ambiguous, f"{family}_AMBIGUOUS"), otherwise=f"{family}_INSUFFICIENT_EVIDENCE")
    status = ladder((verified, "VERIFIED"), (ambiguous, "AMBIGUOUS"), otherwise="NOT_VERIFIED")
    return F.struct(status.alias("status"), (n / float(len(least))).alias("score"), support.alias("support"), reason.alias("reason"), verified.alias("fixed"))


def ladder_any(code: Column, words: tuple[str, ...]) -> Column:
    """Whether a code holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(code, F.lit(w))
    return out


def field_route(field: Column, is_table: Column) -> Column:
    """The route a field goes, by the words in its name."""
    low = F.lower(field)
    return ladder((_yes(is_table), "table"), *((ladder_any(low, words), route) for route, words in FIELD_ROUTES), otherwise="default")


def adaptive_action(
    route: Column, routes: dict[str, list[dict]], registration: Column, crop_safe: Column, validated: Column, evidence: Column, contradicted: Column, confidence: Column, critical: Column, image_quality: Column, tried: Column, budget: Column, time_left: Column, cloud_allowed: Column, reference_available: Column,
    reject_below: float = 0.60, normal_at: float = 0.80, retry_below: float = 0.60, accept_critical: float = 0.95, accept_other: float = 0.90, reader: str = "RAPIDOCR",
) -> Column:
    """Struct (action, stage, reasons): the next step for a field.

    In order: what isn't registered goes to a person; an unsafe crop, or a doubtful
    registration, is cut wider once; complete, uncontradicted evidence that is
    sure enough is accepted; a poor image that ``reader`` has read is prepared
    anew once; else the first step of the field's route that is left and allowed.
    ``routes`` has for each route the dicts of ``next_action``. ``validated`` is
    whether there are validations and all passed.
    """
    been = lambda a: F.array_contains(tried, a)
    sure = confidence >= F.when(_yes(critical), accept_critical).otherwise(accept_other)
    steps = [
        (~_yes(registration >= reject_below), "HITL", "registration", "registration_rejected"), (~_yes(crop_safe) & ~been("EXPAND_CROP"), "EXPAND_CROP", "crop_safety", "wrong_crop_suspected"), (~_yes(crop_safe), "HITL", "crop_safety", "wrong_crop_suspected"),
        (~_yes(registration >= normal_at) & ~been("EXPAND_CROP"), "EXPAND_CROP", "registration", "bounded_registration_uncertainty"),
        (_yes(evidence) & _yes(validated) & ~F.coalesce(contradicted, F.lit(True)) & _yes(sure) & _yes(registration >= normal_at), "ACCEPT", "accept", "evidence_policy_satisfied"),
        (_yes(image_quality < retry_below) & been(reader) & ~been("RETRY_PREPROCESSING"), "RETRY_PREPROCESSING", "image_quality", "low_image_quality"),
    ]
    walk = None
    for name, own in routes.items():
        step = next_action(own, tried, budget, time_left, cloud_allowed, reference_available)
        walk = step if walk is None else F.when(route == name, step).otherwise(walk)
    walked = F.concat(F.array(F.when(walk["exhausted"], "automated_routes_exhausted").otherwise("needs_more_evidence")), walk["skipped"])
    action, stage, reasons = walk["action"], route, walked
    for condition, a, s, why in reversed(steps):
        action, stage, reasons = F.when(condition, a).otherwise(action), F.when(condition, s).otherwise(stage), F.when(condition, F.array(F.lit(why))).otherwise(reasons)
    return F.struct(action.alias("action"), stage.alias("stage"), reasons.alias("reasons"))


def field_disposition(
    configured: Column, wrong_crop: Column, registration: Column, contradicted: Column, hard_valid: Column, has_value: Column, critical: Column, calibrated: Column, decision: Column, satisfied: Column, blocks: Column, reviews: Column, gap_action: Column, least_registration: float = 0.60
) -> Column:
    """Struct (disposition, action, reason) of a field, down the whole ladder.

    ``decision``: what reconciling the candidates gave (ACCEPT,
    REFERENCE_CONFIRMED, ESCALATE, ABSTAIN or else). ``satisfied``: the evidence
    policy is met; ``gap_action``: what would fill the gap if it isn't.
    ``critical`` fields are only accepted by a calibrated confidence. ``blocks``
    and ``reviews``: the claim waits for the field; it goes to a person when
    unresolved. ``has_value``: a candidate that may speak has a value.
    """
    review = lambda a: F.when(a == "HUMAN_REVIEW", "HUMAN_REVIEW_REQUIRED").otherwise("ESCALATE")
    optional = ~_yes(blocks) & ~_yes(reviews)
    accepted, confirmed, escalates = _yes(decision == "ACCEPT"), _yes(decision == "REFERENCE_CONFIRMED"), _yes(decision == "ESCALATE")
    met, valid, gap = _yes(satisfied), _yes(hard_valid), F.coalesce(gap_action, F.lit("HUMAN_REVIEW"))
    lit = F.lit
    steps = (
        (~_yes(configured), lit("HUMAN_REVIEW_REQUIRED"), lit("HUMAN_REVIEW"), "FIELD_POLICY_NOT_CONFIGURED"), (_yes(wrong_crop), lit("ESCALATE"), lit("CROP_RECOVERY"), "WRONG_CROP_SUSPECTED"),
        (_yes(registration < least_registration), lit("ESCALATE"), lit("CROP_RECOVERY"), "LOW_REGISTRATION_CONFIDENCE"), (_yes(contradicted), lit("HUMAN_REVIEW_REQUIRED"), lit("HUMAN_REVIEW"), "REFERENCE_CONTRADICTION"),
        (~valid & optional, lit("UNRESOLVED_NON_BLOCKING"), lit("NONE"), "NON_BLOCKING_FIELD"), (~valid & ~_yes(has_value), lit("ESCALATE"), lit("CROP_RECOVERY"), "EMPTY_CROP"), (~valid, lit("ESCALATE"), gap, "INVALID_FORMAT"),
        (_yes(critical) & ~_yes(calibrated), lit("HUMAN_REVIEW_REQUIRED"), lit("HUMAN_REVIEW"), "CALIBRATION_REQUIRED_FOR_CRITICAL_ACCEPTANCE"), (accepted & met, lit("AUTO_ACCEPTED"), lit("NONE"), "ACCEPTED"), (confirmed & met, lit("REFERENCE_CONFIRMED"), lit("NONE"), "CONFIRMED"),
        (accepted | confirmed, review(gap), gap, "EVIDENCE_GAP"), (optional, lit("UNRESOLVED_NON_BLOCKING"), lit("NONE"), "NON_BLOCKING_FIELD"), (escalates & met, lit("HUMAN_REVIEW_REQUIRED"), lit("HUMAN_REVIEW"), "CALIBRATION_OR_AMBIGUITY_REQUIRES_REVIEW"),
        (escalates, review(gap), gap, "EVIDENCE_GAP"), (_yes(decision == "ABSTAIN"), lit("INSUFFICIENT_EVIDENCE"), lit("HUMAN_REVIEW"), "ABSTAINED"),
    )
    disposition, action, reason = lit("HUMAN_REVIEW_REQUIRED"), lit("HUMAN_REVIEW"), lit("UNDECIDED")
    for condition, d, a, why in reversed(steps):
        disposition, action, reason = F.when(condition, d).otherwise(disposition), F.when(condition, a).otherwise(action), F.when(condition, why).otherwise(reason)
    return F.struct(disposition.alias("disposition"), action.alias("action"), reason.alias("reason"))


@dataclass(frozen=True)
class ShadowPolicy:
    """What a shadow run must reach before it may serve."""

    minimum_claims: int = 1000
    minimum_accepted_critical: int = 3000
    maximum_review: float = 0.08
    maximum_review_upper: float = 0.10
    maximum_segment_review: float = 0.15
    maximum_false_accept_rate: float = 0.001
    maximum_critical_false_accepts: int = 0
    minimum_accuracy: float = 0.95
    minimum_critical_accuracy: float = 0.98
    minimum_accepted_precision: float = 0.995
    minimum_critical_accepted_precision: float = 0.995
    minimum_wrong_crop_recall: float = 0.95


#: Columns of a claim's observation that are added up.
SUMS = ("evaluated", "correct", "evaluated_critical", "correct_critical", "accepted", "correct_accepted", "accepted_critical", "correct_accepted_critical", "false_accepts", "critical_false_accepts", "wrong_crops", "wrong_crops_detected")
FLAGS = ("locked_holdout", "runtime_parity", "route_governance", "shadow_only")


def shadow_gates(claims: DataFrame, run: str, policy: ShadowPolicy = ShadowPolicy(), prohibited: list[str] | None = None) -> DataFrame:
    """run, claims, review_rate, review_upper, worst_segment, accuracy, false_accept_rate, failed of every run: all gates, the failed ones listed in order.

    ``claims``: run, claim, segment, source_group, review, the counts in
    ``SUMS`` and the flags in ``FLAGS``, a row for each claim. A claim that
    occurs twice, sources the run was trained on (``prohibited``), and claims
    that have served fail their gates. A rate of nothing is unknown and fails.
    Sums per run and segment come first, so one row for each of these is all
    that is shuffled.
    """
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    taught = F.col("source_group").isin(*prohibited) if prohibited else F.lit(False)
    per = claims.groupBy(run, "segment").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(yes("review")).alias("r"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in SUMS), *(F.bool_and(yes(c)).alias(c) for c in FLAGS), F.count_if(_yes(taught)).alias("taught")
    )
    twice = claims.groupBy(run, "claim").agg(F.count(F.lit(1)).alias("k")).groupBy(run).agg(F.max("k").alias("most"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b))
    s = per.groupBy(run).agg(F.sum("n").alias("claims"), F.sum("r").alias("r"), F.max(F.col("r").cast("double") / F.col("n")).alias("worst_segment"), *(F.sum(c).alias(c) for c in SUMS), *(F.bool_and(c).alias(c) for c in FLAGS), F.sum("taught").alias("taught")).join(twice, run)
    s = s.withColumns({"review_rate": share("r", "claims"), "review_upper": wilson(F.col("r"), F.col("claims"), True), "accuracy": share("correct", "evaluated"), "critical_accuracy": share("correct_critical", "evaluated_critical"), "precision": share("correct_accepted", "accepted"), "critical_precision": share("correct_accepted_critical", "accepted_critical"), "false_accept_rate": share("false_accepts", "accepted"), "recall": share("wrong_crops_detected", "wrong_crops")})
    c, p = F.col, policy
    gates = (
        (c("locked_holdout"), "LOCKED_HOLDOUT"), (c("taught") == 0, "SOURCE_DISJOINT"), (c("most") == 1, "DISTINCT_CLAIMS"), (c("claims") >= p.minimum_claims, "MINIMUM_CLAIMS"), (c("accepted_critical") >= p.minimum_accepted_critical, "MINIMUM_ACCEPTED_CRITICAL_FIELDS"), (c("accuracy") >= p.minimum_accuracy, "OVERALL_RAW_ACCURACY"),
        (c("critical_accuracy") >= p.minimum_critical_accuracy, "CRITICAL_RAW_ACCURACY"), (c("precision") >= p.minimum_accepted_precision, "ACCEPTED_PRECISION"), (c("review_rate") <= p.maximum_review, "CLAIM_HITL"), (c("review_upper") < p.maximum_review_upper, "CLAIM_HITL_UPPER_95"),
        (c("worst_segment") <= p.maximum_segment_review, "SEGMENT_CLAIM_HITL"), (c("false_accept_rate") <= p.maximum_false_accept_rate, "FALSE_ACCEPT_RATE"), (c("critical_false_accepts") <= p.maximum_critical_false_accepts, "CRITICAL_FALSE_ACCEPTS"), (c("critical_precision") >= p.minimum_critical_accepted_precision, "CRITICAL_ACCEPTED_PRECISION"),
        (c("recall") >= p.minimum_wrong_crop_recall, "WRONG_CROP_RECALL"), (c("runtime_parity"), "RUNTIME_PARITY"), (c("route_governance"), "ROUTE_GOVERNANCE"), (c("shadow_only"), "SHADOW_ONLY"),
    )
    failed = _listed(*((~_yes(ok), name) for ok, name in gates))
    return s.select(run, "claims", "review_rate", "review_upper", "worst_segment", "accuracy", "false_accept_rate", failed.alias("failed"))


#: Sections of a document whose values for a field vouch for each other.
COMPATIBLE_SECTIONS = {
    "member_id": [("subscriber", "claim_header")], "provider_npi": [("billing_provider", "service_facility")], "federal_tax_no": [("billing_provider", "tax_summary")], "service_date": [("service_line", "certification")], "patient_name": [("patient", "subscriber")],
}


def pair_assessment(field: Column, left: Column, right: Column, sections: dict[str, list[tuple[str, str]]] | None = None, left_form: Column | None = None, right_form: Column | None = None) -> Column:
    """Struct (independent, compatible, agreeing, conflicting, different_page, different_document, reasons): what two readings of a field are to each other.

    Readings are structs of value, section, invocation, crop, region, page,
    document, shared (array). They are independent if invocation, crop and region
    are all known and all differ, nothing is shared, and their sections are two;
    compatible if such sections vouch for each other for this field. Only
    compatible ones agree or conflict, by their normal forms (the values, if not given).
    """
    sections = COMPATIBLE_SECTIONS if sections is None else sections
    apart = F.lit(True)
    for name in ("invocation", "crop", "region"):
        apart = apart & _yes((left[name] != "") & (right[name] != "") & (left[name] != right[name]))
    none = F.array().cast("array<string>")
    apart = apart & ~F.arrays_overlap(F.coalesce(left["shared"], none), F.coalesce(right["shared"], none))
    two = _yes(left["section"] != right["section"])
    fits = F.lit(False)
    for name, pairs in sections.items():
        for a, b in pairs:
            fits = fits | _yes((field == name) & (((left["section"] == a) & (right["section"] == b)) | ((left["section"] == b) & (right["section"] == a))))
    independent = apart & two
    compatible = independent & fits
    x, y = (F.coalesce(v, F.lit("")) for v in (left["value"] if left_form is None else left_form, right["value"] if right_form is None else right_form))
    agreeing, conflicting = compatible & (x != "") & (x == y), compatible & (x != "") & (y != "") & (x != y)
    why = _listed((left["crop"].eqNullSafe(right["crop"]), "SAME_CROP_SHA256"), (left["region"].eqNullSafe(right["region"]), "SAME_LOCALIZATION_REGION"), (~two, "SEMANTIC_SECTION_NOT_DISTINCT"), (two & ~fits, "SEMANTIC_SECTIONS_INCOMPATIBLE"), (conflicting, "MATERIAL_VALUE_CONFLICT"))
    differ = lambda name: ~left[name].eqNullSafe(right[name])
    return F.struct(independent.alias("independent"), compatible.alias("compatible"), agreeing.alias("agreeing"), conflicting.alias("conflicting"), differ("page").alias("different_page"), differ("document").alias("different_document"), why.alias("reasons"))


def challenge_refusal(scope: Column, source: Column, family: Column, blocker: Column, unlocks: Column, crop_safe: Column, resolved: Column, failure: Column, failures: tuple[str, ...], sources: tuple[str, ...] = ("SOURCE_B",), families: tuple[str, ...] = ("CMS1500", "UB04")) -> Column:
    """Why a field may not be put to a challenger, the first reason; null if it may, within the budget."""
    steps = (
        (~_yes(scope == "FIELD_CROP"), "FULL_PAGE_REJECTED"), (~_yes(source.isin(*sources)), "SOURCE_NOT_ELIGIBLE"), (~_yes(family.isin(*families)), "FAMILY_NOT_ELIGIBLE"), (~_yes(blocker) & ~_yes(unlocks), "NO_CLAIM_UNLOCK_IMPACT"), (~_yes(crop_safe), "UNSAFE_CROP"), (_yes(resolved), "VALID_PRIMARY_BYPASS"),
        (~_yes(failure.isin(*failures)), "FAILURE_REASON_NOT_ELIGIBLE"),
    )
    return F.nullif(ladder(*steps, otherwise=""), F.lit(""))


def challenges(requests: DataFrame, refusal: str, blocker: Column, order: list[str], rate: float = 0.30, parts: int = 200) -> DataFrame:
    """``requests`` with granted and reason: of those without a refusal the first in ``order``, as many as the budget has.

    The budget is ``rate`` of all blockers, rounded down, and one at least where
    there is a blocker. ``order`` must leave no ties. Requests are put in ranges
    of that order; counts of the ranges say in which one the budget ends, and
    only inside a range are rows numbered.
    """
    if not 0 < rate <= 0.30:
        raise ValueError("a challenger's rate is over 0 and at most 0.30")
    ranged = staged(requests.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "requests")
    open_ = F.col(refusal).isNull()
    counts = ranged.groupBy("__part").agg(F.count_if(open_).alias("__n"), F.count_if(_yes(blocker)).alias("__b"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blockers = F.sum("__b").over(Window.partitionBy())
    limit = F.when(blockers == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1), F.floor(blockers * F.lit(rate))).cast("long"))
    places = counts.select("__part", (limit - before).alias("__left"))
    number = F.sum(open_.cast("int")).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = ranged.withColumn("__number", number).join(F.broadcast(places), "__part")
    granted = open_ & (F.col("__number") <= F.col("__left"))
    reason = F.coalesce(F.col(refusal), F.when(granted, "BLOCKER_CHALLENGE").otherwise("INVOCATION_BUDGET_EXHAUSTED"))
    return rows.select(*requests.columns, granted.alias("granted"), reason.alias("reason"))
