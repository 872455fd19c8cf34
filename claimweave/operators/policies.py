"""Policies over columns and tables of one's own: routes, acceptances, gates, tiers and what keeps a claim open.

Every condition that isn't known counts as not met, so an undefined value never
accepts anything. Thresholds are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decisions import ladder

#: States in which a critical field needs nothing more.
TERMINAL = ("VALIDATED_AUTOMATICALLY", "VERIFIED_BY_HUMAN")
#: Attributes of an address that must have been matched.
ADDRESS_ATTRIBUTES = ("po_box", "postal_code", "city", "state")


def _yes(condition: Column) -> Column:
    return F.coalesce(condition.cast("boolean"), F.lit(False))


def processing_route(top_class: Column, verification: Column, family: Column, structured: Column, claim_related: Column, authorized: Column) -> Column:
    """Struct (route, reason): what stops, what a verified form's extractor takes, and what goes by layout or as free text.

    A form that is verified without leave for the fixed extractor is refused: its route is null.
    """
    verified = _yes(verification == "VERIFIED")
    steps = (
        (_yes(top_class == "NON_CLAIM"), "STOP_NON_CLAIM", "TOP_LEVEL_NON_CLAIM"), (verified & ~_yes(authorized), "", "VERIFIED_WITHOUT_LEAVE_FOR_FIXED_EXTRACTOR"), (verified & _yes(family == "CMS1500"), "CMS_STANDARD_EXTRACTOR", "STANDARD_FORM_VERIFIED"), (verified, "UB_STANDARD_EXTRACTOR", "STANDARD_FORM_VERIFIED"),
        (_yes(structured), "LAYOUT_STRUCTURED_EXTRACTOR", "STRUCTURED_WITHOUT_STANDARD_VERIFICATION"), (_yes(claim_related), "UNSTRUCTURED_EXTRACTOR", "UNSTRUCTURED_CLAIM_RELATED"),
    )
    route = F.nullif(ladder(*((c, name) for c, name, _ in steps), otherwise="SAFE_UNKNOWN"), F.lit(""))
    return F.struct(route.alias("route"), ladder(*((c, why) for c, _, why in steps), otherwise="INSUFFICIENT_SAFE_ROUTE_EVIDENCE").alias("reason"))


def reference_accepted(member_id: Column, birth_date: Column, name_score: Column, npi: Column, provider_score: Column, name_from: float = 0.90, provider_from: float = 0.85) -> Column:
    """Whether exact identifiers with a similar name vouch for a critical field; a name alone never does."""
    return (_yes(member_id) & _yes(birth_date) & _yes(name_score >= name_from)) | (_yes(npi) & _yes(provider_score >= provider_from))


def address_accepted(authorized: Column, verified: Column, permitted: Column, matched: Column, contradictions: Column, address: Column, needed: tuple[str, ...] = ADDRESS_ATTRIBUTES) -> Column:
    """Whether a verified address may be taken: all needed attributes (an array) matched, none contradicted."""
    all_matched = F.size(F.array_except(F.array(*map(F.lit, needed)), F.coalesce(matched, F.array().cast("array<string>")))) == 0
    return _yes(authorized) & _yes(verified) & _yes(permitted) & all_matched & (F.coalesce(F.size(contradictions), F.lit(0)) <= 0) & address.isNotNull()


def signal_rule(any_of: Column, signals: Column) -> Column:
    """Struct (passed, missing): some alternative (array of arrays) lies within the signals, or there is none to meet; all unmet ones are listed either way."""
    unmet = F.filter(any_of, lambda o: F.size(F.array_except(o, signals)) > 0)
    return F.struct(((F.size(any_of) == 0) | (F.size(unmet) < F.size(any_of))).alias("passed"), F.transform(unmet, lambda o: F.array_join(o, "+")).alias("missing"))


def table_reader_due(heavy: Column, table: Column, template_failed: Column, regions_tried: Column) -> Column:
    """Whether a page goes to the reader of tables: full of them, or one that template and regions have failed on."""
    return _yes(heavy) | (_yes(table) & _yes(template_failed) & _yes(regions_tried))


def fixed_geometry_refusal(identity: Column, compatibility: Column, registered: Column, geometry_valid: Column, corners_valid: Column, template_id: Column, template_version: Column) -> Column:
    """Why fixed regions may not be used, the first reason; null if they may."""
    named = lambda c: F.coalesce(c, F.lit("")) != ""
    steps = (
        (~_yes(identity == "VERIFIED"), "REGISTERED_FIXED_REQUIRES_VERIFIED_FORM_IDENTITY"), (~_yes(compatibility != "INCOMPATIBLE"), "REGISTERED_FIXED_REQUIRES_COMPATIBLE_TEMPLATE"), (~_yes(registered), "REGISTERED_FIXED_REQUIRES_ACCEPTED_REGISTRATION"),
        (~(_yes(geometry_valid) & _yes(corners_valid)), "REGISTERED_FIXED_REQUIRES_VALID_TRANSFORMED_GEOMETRY"), (~(named(template_id) & named(template_version)), "REGISTERED_FIXED_REQUIRES_TEMPLATE_LINEAGE"),
    )
    return F.nullif(ladder(*steps, otherwise=""), F.lit(""))


def adjudication_tier(enabled: Column, resolved: Column, blocking: Column, conflict: Column, text_failed: Column, crop_safe: Column, visible: Column) -> Column:
    """Struct (tier, reason): nothing beyond what is local, the text, or the field's crop."""
    out_of_reach = _yes(text_failed) & ~(_yes(crop_safe) & _yes(visible))
    steps = ((~_yes(enabled) | _yes(resolved) | ~_yes(blocking), "LOCAL_ONLY", "TIER0_LOCAL_RESULT"), (_yes(conflict), "LOCAL_ONLY", "AUTHORITATIVE_CONFLICT_PROTECTED"), (out_of_reach, "LOCAL_ONLY", "TIER2_INELIGIBLE"), (_yes(text_failed), "FIELD_CROP", "ROUTED"))
    return F.struct(ladder(*((c, t) for c, t, _ in steps), otherwise="TEXT").alias("tier"), ladder(*((c, r) for c, _, r in steps), otherwise="ROUTED").alias("reason"))


def adjudication_order(distance: Column, critical: Column, localized: Column) -> list[Column]:
    """Sorting columns: claims that lack least first, critical fields, then what is located best."""
    return [F.greatest(F.lit(1), distance), F.when(_yes(critical), 0).otherwise(1), -localized]


def next_action(route: list[dict], tried: Column, budget: Column, time_left: Column, cloud_allowed: Column, reference_available: Column, last: str = "HITL", none: str = "ABSTAIN") -> Column:
    """Struct (action, skipped, exhausted): the first action of a route that wasn't tried and that its limits allow.

    ``route``: dicts of action, cost, seconds, and cloud or reference if it is
    or needs one, in order. ``skipped`` names the limits, each once, that ruled
    actions before it out. When all are ruled out: ``last``, or ``none`` if that was tried.
    """
    done, skipped = F.lit(None).cast("string"), []
    for step in route:
        fresh = done.isNull() & ~F.array_contains(tried, step["action"])
        limits = [
            (F.lit(bool(step.get("reference"))) & ~_yes(reference_available), "reference_unavailable"), (F.lit(bool(step.get("cloud"))) & ~_yes(cloud_allowed), "cloud_processing_disallowed"),
            (~_yes(budget >= step["cost"]), "budget_exceeded"), (~_yes(time_left >= step["seconds"]), "sla_exceeded"),
        ]
        why = ladder(*limits, otherwise="")
        skipped.append(F.when(fresh & (why != ""), why))
        done = F.when(fresh & (why == ""), step["action"]).otherwise(done)
    end = F.when(F.array_contains(tried, last), none).otherwise(last)
    return F.struct(F.coalesce(done, end).alias("action"), F.array_sort(F.array_distinct(F.array_compact(F.array(*skipped)))).alias("skipped"), done.isNull().alias("exhausted"))


def finalizable(dispositions: DataFrame, claims: DataFrame, critical: list[str], claim: str, field: str, disposition: str, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """claim, can_finalize, open: whether all critical fields of each claim are terminal, and how many aren't or are missing.

    Of several rows of a field one that is open keeps it open. One small row a
    claim is joined, whatever a claim's number of rows.
    """
    rows = dispositions.filter(F.col(field).isin(critical)).groupBy(claim, field).agg(F.bool_and(F.coalesce(F.col(disposition).isin(*terminal), F.lit(False))).alias("__ok"))
    closed = rows.groupBy(claim).agg(F.count_if(F.col("__ok")).alias("__closed"))
    out = claims.select(claim).distinct().join(closed, claim, "left")
    open_ = F.lit(len(set(critical))) - F.coalesce("__closed", F.lit(0))
    return out.select(claim, (open_ == 0).alias("can_finalize"), open_.cast("long").alias("open"))


def declared_gates(declared: DataFrame, names: list[str], key: str, gate: str, value: str) -> DataFrame:
    """key, decision, failed, untested: PROMOTABLE if every named gate is declared PASS or TESTED, else BLOCKED."""
    said = F.upper(F.trim(F.col(value)))
    status = F.when(said.isin("PASS", "TESTED"), "PASS").when(said.isin("FAIL", "BLOCKED"), "FAIL").otherwise("NOT_TESTED")
    worst = declared.filter(F.col(gate).isin(names)).withColumn("__s", status).groupBy(key, gate).agg(F.min("__s").alias("__s"))  # FAIL, NOT_TESTED, PASS: the least is the worst
    counts = worst.groupBy(key).agg(F.count_if(F.col("__s") == "PASS").alias("__pass"), F.count_if(F.col("__s") == "FAIL").alias("failed"))
    out = declared.select(key).distinct().join(counts, key, "left").withColumn("failed", F.coalesce("failed", F.lit(0)))
    passed = F.coalesce("__pass", F.lit(0))
    return out.select(key, F.when(passed == len(names), "PROMOTABLE").otherwise("BLOCKED").alias("decision"), "failed", (F.lit(len(names)).cast("long") - passed - F.col("failed")).alias("untested"))


def extraction_failure(outcome: Column, raw: Column, selected: Column, expected: Column, normalized: Column, oracle_has_it: Column, span_has_it: Column, similarity: Column, alike_from: float = 0.70) -> Column:
    """What went wrong with a value, the first cause; ``similarity`` is that of the selected (else the raw) and the expected value."""
    wrong = F.coalesce(selected != expected, F.lit(True))
    return ladder(
        (outcome.isin("WRONG_NEIGHBOR", "WRONG_REGION", "EMPTY_REGION"), "LOCALIZATION_WRONG"), (outcome == "UNDER_CROP", "UNDER_CROP"), (F.trim(F.coalesce(raw, F.lit(""))) == "", "OCR_EMPTY"),
        (_yes(oracle_has_it) & wrong, "CANDIDATE_RANKING_ERROR"), (_yes(span_has_it) & wrong, "SPAN_SELECTION_ERROR"), ((normalized == expected) & wrong, "NORMALIZATION_ERROR"),
        (similarity >= alike_from, "OCR_CHARACTER_ERROR"), otherwise="OCR_WORD_ERROR",
    )


def challenger_limit(blockers: Column, rate: float) -> Column:
    """How many blocked fields a challenger may look at: none of none, else one at least and ``rate`` of them at most."""
    return F.when(blockers == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1), F.floor(blockers * F.lit(rate))).cast("long"))


def region_usable(outcome: Column, ownership: Column, label_contaminated: Column, ambiguous: Column, text_empty: Column) -> Column:
    """Whether a located region can be used as it is."""
    clean = ~(F.coalesce(label_contaminated, F.lit(True)) | F.coalesce(ambiguous, F.lit(True)) | F.coalesce(text_empty, F.lit(True)))
    return _yes(outcome.isin("GEOMETRIC_MATCH", "VALUE_CONTAINED")) & _yes(ownership == "REGION_OWNED") & clean


def region_ownership(foreign_labels: Column, own_labels: Column, extra_values: Column, margin: Column, tokens: Column, geometry: Column, span: Column, cross_field: Column, semantic: Column, least_margin: float = 0.025) -> Column:
    """Struct (ownership, confidence) of a region from counts of labels, of other fitting values and of its own tokens, and its scores."""
    part = lambda c: F.coalesce(c, F.lit(0.0))
    owned = F.least(F.lit(0.99), F.lit(0.50) + part(geometry) * 0.25 + part(span) * 0.15 + part(cross_field) * 0.10)
    owned = F.when(part(semantic) < 0.20, F.least(owned, F.lit(0.72))).otherwise(owned)
    steps = (
        (foreign_labels > 0, "WRONG_NEIGHBOR", 0.98), (own_labels > 0, "LABEL_CONTAMINATED", 0.96), (extra_values > 0, "MULTI_FIELD_CROP", 0.94), (margin < least_margin, "REGION_AMBIGUOUS", 0.90),
        (~_yes(tokens > 0), "UNKNOWN", 0.25), (~_yes(geometry >= 0.50), "UNKNOWN", 0.40),
    )
    confidence = owned
    for c, _, value in reversed(steps):
        confidence = F.when(_yes(c), F.lit(value)).otherwise(confidence)
    return F.struct(ladder(*((c, n) for c, n, _ in steps), otherwise="REGION_OWNED").alias("ownership"), confidence.alias("confidence"))


def chosen_template(scores: DataFrame, page: str, template: str, score: str, least: float = 0.75, margin: float = 0.10) -> DataFrame:
    """page, template, score, status: the best template of a page, SELECTED if it is good and far enough ahead of the next, else UNRESOLVED. Ties by name."""
    top = scores.groupBy(page).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(template).alias("t")))), 1, 2).alias("top"))  # a page's templates are few
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    ahead = -first["s"] + F.coalesce(second["s"], F.lit(0.0))
    good = (-first["s"] >= least) & (ahead >= margin)
    return top.select(page, first["t"].alias(template), (-first["s"]).alias(score), F.when(good, "SELECTED").otherwise("UNRESOLVED").alias("status"))


def page_evidence(confidence: Column, family_confidence: Column, page_relevance: Column, crop_quality: Column) -> Column:
    """What a reading on a page is worth as evidence."""
    return 0.35 * confidence + 0.25 * family_confidence + 0.25 * page_relevance + 0.15 * crop_quality


def routed_fields(candidates: DataFrame, required: DataFrame, document: str, field: str, critical: str, score: str, page: str, value: str, valid: Column, least: float = 0.70, margin: float = 0.08) -> DataFrame:
    """document, field, page, value, reason, review of every required field, over all pages of a document.

    Of the candidates that pass hard validation (``valid``, and a value that
    isn't empty) a page counts with its best one, so several readings of one
    page don't stand against each other. The best page is selected if its score
    is at least ``least`` and, where there is another page, ahead of it by
    ``margin``; else a critical field is up for review. Ties: the smaller page,
    then the smaller value. ``required`` has a row for each field.
    """
    good = candidates.filter(_yes(valid) & (F.coalesce(F.col(value).cast("string"), F.lit("")) != ""))
    best_of_page = good.groupBy(document, field, page).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(value).alias("v"))).alias("m"))
    w = Window.partitionBy(document, field).orderBy("m.s", page)
    ranked = best_of_page.withColumn("__k", F.row_number().over(w)).withColumn("__next", F.lead("m.s").over(w)).filter("__k = 1")
    wanted = candidates.select(document).distinct().crossJoin(F.broadcast(required.select(field, critical)))  # a policy table
    out = wanted.join(ranked, [document, field], "left")
    top, second = -F.col("m.s"), -F.col("__next")
    named = F.concat(F.lit("selected_page_"), F.col(page).cast("string"), F.lit("_for_"), F.col(field))
    reason = F.when(top.isNull(), "no_page_candidate_passed_hard_validation").when(top < least, "best_page_evidence_below_threshold").when(F.round(top - second, 9) < margin, "winning_page_margin_below_threshold").otherwise(named)
    chosen = _yes(reason == named)
    return out.select(document, field, F.when(chosen, F.col(page)).alias(page), F.when(chosen, F.col("m.v")).alias(value), reason.alias("reason"), (~chosen & _yes(F.col(critical))).alias("review"))


def claim_quality(fields: DataFrame, claim: str, confidence: str, critical: str, present: str, least_critical: float = 0.95, least_complete: float = 1.0) -> DataFrame:
    """claim, completeness, weakest_critical, quality, reasons: a claim is as good as its weakest part.

    ``reasons`` lists what keeps it from being processed without a person.
    """
    crit = _yes(F.col(critical))
    n = F.count(F.lit(1))
    agg = fields.groupBy(claim).agg(
        (F.count_if(_yes(F.col(present))).cast("double") / n).alias("completeness"), F.min(F.when(crit, F.coalesce(F.when(_yes(F.col(present)), F.col(confidence)), F.lit(0.0)))).alias("weakest_critical"), F.min(F.when(_yes(F.col(present)), F.col(confidence))).alias("__any")
    )
    weakest = F.coalesce("weakest_critical", F.lit(1.0))
    reasons = F.array_compact(F.array(F.when(F.col("completeness") < least_complete, "INCOMPLETE"), F.when(weakest < least_critical, "CRITICAL_CONFIDENCE_LOW")))
    return agg.select(claim, "completeness", "weakest_critical", F.least("completeness", weakest, F.coalesce("__any", F.lit(0.0))).alias("quality"), F.array_join(reasons, ",").alias("reasons"))


def with_criticality(rows: DataFrame, levels: DataFrame, field: str, level: str, default: str = "C1") -> DataFrame:
    """``rows`` with the level of their field; fields that the policy table (field, level; a row each) doesn't name have the default."""
    return rows.join(F.broadcast(levels.select(field, level)), field, "left").withColumn(level, F.coalesce(level, F.lit(default)))


def finalisation_gate(stored: DataFrame, recomputed: DataFrame, claim: str, decision: str, accepted: str = "STP") -> DataFrame:
    """claim, outcome of every stored claim: RELEASED if decided anew it is the same and accepted, else why not."""
    again = recomputed.select(claim, F.col(decision).alias("__again"))
    same = F.col(decision) == F.col("__again")
    outcome = ladder((F.col("__again").isNull(), "NOT_RECOMPUTED"), (~_yes(same), "PARITY_FAILED"), (F.col(decision) == accepted, "RELEASED"), otherwise="NOT_STP")
    return stored.join(again, claim, "left").select(claim, outcome.alias("outcome"))
