"""The analytical surface: a plan of allowed operations, checked, rewritten and run as one DataFrame lineage.

A plan names an intent, filters, a unit and operations.  Anything not on the
lists is rejected, SQL text too.  Candidates are found, gated by trust, kept as
one frame, and every operation aggregates that frame.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import aggregate, retrieval, timeline, trust
from marginalia.plans.records import records, sql

# What a plan may hold.
INTENTS = ("search", "count", "breakdown", "compare", "timeline", "coverage")
UNITS = ("parent_comments", "searchable_units", "projects", "canonical_issues")
GROUPS = ("city", "discipline", "project", "review_round", "response_status", "code_section", "canonical_issue")
OPERATIONS = ("smart_search", "keyword_search", "load_issue_timelines", "load_filtered_comments", "load_previous_result_set", "count_parent_comments", "count_projects", "count_review_rounds", "count_canonical_issues", "summarize_confirmed_responses", *[f"group_by_{g}" for g in GROUPS])
_SQL = re.compile(r"\b(select|insert|update|delete|drop|union|alter)\b.*\b(from|into|table|set)\b", re.I | re.S)


@dataclass
class Plan:
    intent: str = "search"
    subject: str = ""
    filters: dict[str, str] = field(default_factory=dict)
    unit: str = "parent_comments"
    operations: list[str] = field(default_factory=list)
    eligible_only: bool = False


def validate(raw: dict) -> Plan:
    """A plan of allowed parts; raises for anything else."""
    for value in [raw.get("subject", ""), *raw.get("filters", {}).values()]:
        if _SQL.search(str(value)):
            raise ValueError("a plan may not hold SQL")
    plan = Plan(**raw)
    if plan.intent not in INTENTS or plan.unit not in UNITS:
        raise ValueError(f"unknown intent or unit: {plan.intent}, {plan.unit}")
    unknown = [o for o in plan.operations if o not in OPERATIONS]
    if unknown:
        raise ValueError(f"unknown operations: {unknown}")
    return rewrite(plan)


def rewrite(plan: Plan) -> Plan:
    """The intent decides the unit and drops operations that contradict it; repetitions go, order stays."""
    wanted = list(dict.fromkeys(plan.operations))
    if plan.intent == "count":
        wanted = [o for o in wanted if not o.startswith("group_by_")] or ["count_parent_comments"]
    if plan.intent == "breakdown":
        wanted = [o for o in wanted if o.startswith("group_by_")] or ["group_by_city"]
    if plan.intent == "timeline":
        plan.unit, wanted = "canonical_issues", ["load_issue_timelines"]
    return Plan(plan.intent, plan.subject, plan.filters, plan.unit, wanted, plan.eligible_only)


def route(message: str) -> Plan:
    """A plan from a question by fixed rules, with no model."""
    t = message.casefold()
    subject = " ".join(w for w in re.findall("[a-z0-9-]+", t) if w not in {"how", "many", "count", "number", "show", "list", "per", "by", "compare", "timeline", "history", "breakdown"} and w not in ("city", "project", "discipline", "comments"))
    if re.search(r"\bhow many\b|\bcount\b|\bnumber of\b", t):
        return validate({"intent": "count", "subject": subject})
    if m := re.search(r"\b(?:by|per) (city|discipline|project|round)\b", t):
        return validate({"intent": "breakdown", "subject": subject, "operations": [f"group_by_{m[1].replace('round', 'review_round')}"]})
    if re.search(r"\bhistory\b|\btimeline\b|\brecurring\b", t):
        return validate({"intent": "timeline", "subject": subject})
    return validate({"intent": "search", "subject": subject, "operations": ["smart_search"]})


def candidates(df: DataFrame, plan: Plan, previous: DataFrame | None = None) -> DataFrame:
    """The records a plan speaks about."""
    scope = trust.matches_filters(trust.chat_eligible(df) if plan.eligible_only else df, plan.filters)
    if "load_previous_result_set" in plan.operations and previous is not None:
        return scope.join(previous.select("comment_id").distinct(), "comment_id", "left_semi")
    if plan.subject and "keyword_search" in plan.operations:
        return scope.join(retrieval.keyword_ids(scope, plan.subject), "comment_id", "left_semi")
    if plan.subject and "smart_search" in plan.operations:
        return scope.join(retrieval.hybrid(scope, plan.subject).select("comment_id"), "comment_id", "left_semi")
    return scope


def run(df: DataFrame, plan: Plan, previous: DataFrame | None = None) -> dict[str, DataFrame]:
    """The plan's frames by name: rows, metrics, breakdowns, timelines as asked."""
    rows = candidates(df, plan, previous)
    out = {"rows": rows, "metrics": aggregate.metrics(rows)}
    groups = [o.removeprefix("group_by_") for o in plan.operations if o.startswith("group_by_")]
    if groups:
        out["breakdowns"] = aggregate.breakdowns(rows).where(F.col("kind").isin(groups))
    if "load_issue_timelines" in plan.operations:
        out["timelines"] = timeline.recurring(rows)
    return out


QUERIES = {
    "plan_breakdown": (
        lambda s, d: run(records(s, d), validate({"intent": "breakdown", "filters": {"trust": "verified"}, "operations": ["group_by_discipline", "count_projects"]}))["breakdowns"],
        sql("SELECT 'discipline' AS kind, discipline AS key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lower(discipline)) AS place FROM records WHERE trust = 'verified' GROUP BY discipline QUALIFY place <= 12"),
    ),
    "plan_timeline": (
        lambda s, d: run(records(s, d), validate({"intent": "timeline", "filters": {"discipline": "en"}}))["timelines"].select("issue_id", "rounds", "events"),
        sql("SELECT issue_id, count(DISTINCT review_round) AS rounds, count(*) AS events FROM records WHERE discipline = 'en' GROUP BY issue_id HAVING count(DISTINCT review_round) >= 2"),
    ),
    "plan_count": (
        lambda s, d: run(records(s, d), validate({"intent": "count", "filters": {"response_status": "missing"}}))["metrics"].select("parent_comments", "projects", "canonical_issues"),
        sql("SELECT count(DISTINCT comment_id) AS parent_comments, count(DISTINCT project_id) AS projects, count(DISTINCT issue_id) AS canonical_issues FROM records WHERE response_id IS NULL"),
    ),
}
