"""Reports over runs: task and case matrices, cohorts, queues, candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.names import floor_percent

PER_SOURCE = 64


def task_matrix(runs: DataFrame) -> DataFrame:
    """One row over runs (task, lines, selected, tokens)."""
    return runs.agg(
        F.count("*").alias("tasks"), F.sum("lines").alias("lines"), F.sum("selected").alias("selected"), F.max("selected").alias("max_selected"),
        floor_percent(F.sum("lines") - F.sum("selected"), F.sum("lines")).alias("reduction"),
    )


def case_matrix(runs: DataFrame, least_reduction: float) -> DataFrame:
    """One row for each case of runs (case_name, lines, selected, hit): floored reduction and quality gate."""
    own = runs.groupBy("case_name").agg(F.count("*").alias("tasks"), F.sum("lines").alias("lines"), F.sum("selected").alias("selected"), F.count_if("hit").alias("hits"))
    own = own.withColumn("reduction", floor_percent(F.col("lines") - F.col("selected"), F.col("lines")))
    gate = F.when((F.col("hits") == F.col("tasks")) & (F.col("reduction") >= least_reduction), "pass").otherwise("fail")
    return own.withColumn("gate", gate)


def status_cohort(reports: DataFrame, states: list[str], group: str) -> DataFrame:
    """Counts of each state by group, in columns, zeros included, with the floored share of the first state."""
    own = reports.groupBy(group).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in states])
    return own.withColumn("rate", floor_percent(F.col(states[0]), F.col("total")))


def outcome_cohort(reports: DataFrame, outcomes: list[str]) -> DataFrame:
    """(outcome, n) of every outcome of the domain, those without a report at zero."""
    domain = reports.sparkSession.createDataFrame([(o,) for o in outcomes], "outcome string")
    counted = reports.groupBy("outcome").agg(F.count("*").alias("_n"))
    return domain.join(counted, "outcome", "left").select("outcome", F.coalesce("_n", F.lit(0)).alias("n"))


def fix_queue(reports: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most pressing reports (report, priority), numbered."""
    best = reports.orderBy("priority", "report").limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy("priority", "report")))


def dedup_candidates(candidates: DataFrame, cap: int = PER_SOURCE) -> DataFrame:
    """First occurrence of each file by position, then at most ``cap`` files of a source.

    ``candidates`` has source, file and pos; gives them with the rank in the source.
    """
    first = candidates.groupBy("file").agg(F.min_by(F.struct("source", "pos"), F.struct("pos", "source")).alias("_f")).select("file", "_f.source", "_f.pos")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("pos", "file")))
    return ranked.filter(F.col("rank") <= cap)


def source_evidence(candidates: DataFrame, cap: int = PER_SOURCE) -> DataFrame:
    """(source, files, omitted, latency): distinct files of each source, how many go beyond the cap, and the sum of latency_ms if there is one."""
    latency = F.coalesce(F.sum("latency_ms"), F.lit(0)) if "latency_ms" in candidates.columns else F.lit(0)
    own = candidates.groupBy("source").agg(F.count_distinct("file").alias("_n"), latency.cast("long").alias("latency"))
    return own.select("source", F.least("_n", F.lit(cap)).alias("files"), F.greatest(F.col("_n") - cap, F.lit(0)).alias("omitted"), "latency")


def benchmark_totals(runs: DataFrame, least_files: int, most_tokens: int) -> DataFrame:
    """One row over runs (repository, files, lines, tokens): sums, the most, and how many break a guardrail."""
    broken = (F.col("files") < least_files) | (F.col("tokens") > most_tokens)
    return runs.agg(
        F.count("*").alias("repositories"), F.sum("files").alias("files"), F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most_tokens"),
        F.count_if(broken).alias("failures"),
    )


def coverage(expected: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows that were not selected."""
    return expected.join(selected.select(*keys).distinct(), keys, "left_anti")


def expectation_status(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(task, status) of expectations (task, first_file, strategy?, seed?) against runs; absent checks pass."""
    a = actual.select("task", F.col("first_file").alias("_f"), F.col("strategy").alias("_s"), F.col("seed").alias("_v"))
    ok = lambda want, got: F.col(want).isNull() | F.col(want).eqNullSafe(F.col(got))
    joined = expected.join(a, "task", "left")
    status = F.when(ok("first_file", "_f") & ok("strategy", "_s") & ok("seed", "_v"), "pass").otherwise("fail")
    return joined.select("task", status.alias("status"))


# --- decisions ---------------------------------------------------------------------------

# What is done next about a route, by how its first file stands to a backend's candidates. Fixed values.
ROUTE_ACTIONS = {
    "agree": ("read_selected_context", "use_agent_route_selected_context"),
    "overlap": ("read_selected_context_then_compare_backend_rank", "review_backend_order_vs_local_route"),
    "conflict": ("compare_backend_route_before_edits", "investigate_backend_local_conflict"),
}
# Outcomes of trials that call for work, most pressing first, with the work. Fixed values.
TRIAL_ACTIONS = (
    ("needs_triage", "triage_needs_triage_reports"),
    ("workflow_friction", "fix_workflow_friction"),
    ("route_quality_below_threshold", "fix_low_quality_routes"),
    ("route_miss", "fix_route_miss"),
    ("overtrust_risk", "fix_overtrust_risk"),
    ("route_near_miss", "improve_route_near_miss"),
)


def bridge_reports(routes: DataFrame) -> DataFrame:
    """How each route (first_file, selected, candidates) stands to a backend: flags, common files, ratio, agreement and actions."""
    candidates = F.coalesce("candidates", F.array().cast("array<string>"))
    first = F.coalesce("first_file", F.lit(""))
    top = (first != "") & (first == F.coalesce(F.get(candidates, F.lit(0)), F.lit("")))
    inside = (first != "") & F.array_contains(candidates, first)
    common = F.filter(F.coalesce("selected", F.array().cast("array<string>")), lambda f: F.array_contains(F.col("_candidates"), f))
    known = routes.withColumn("_candidates", candidates).withColumn("matches_top", top).withColumn("in_candidates", inside)
    own = known.withColumn("common_files", common).withColumn("agreement", F.when(F.col("matches_top"), "agree").when(F.col("in_candidates"), "overlap").otherwise("conflict"))
    n = F.size("_candidates")
    action = lambda i: F.create_map(*[F.lit(x) for k, v in ROUTE_ACTIONS.items() for x in (k, v[i])])[F.col("agreement")]
    return own.withColumn("candidate_count", n).withColumn("common_count", F.size("common_files")).withColumn(
        "ratio", F.when(n > 0, F.size("common_files") / n).otherwise(0.0)
    ).withColumn("recommended_action", action(0)).withColumn("next_action", action(1)).drop("_candidates")


def conflicts(reports: DataFrame) -> DataFrame:
    """Reports (status, agreement) that did not pass or do not agree."""
    return reports.filter((F.col("status") != "pass") | (F.col("agreement") != "agree"))


def bridge_decision(reports: DataFrame, least_reports: int, least_rate: float) -> DataFrame:
    """One row over reports (status, agreement, common_count, candidate_count): counts, rates, status and next action of the cohort."""
    counted = lambda s: F.count_if(F.col("agreement") == s)
    one = reports.agg(
        F.count("*").alias("reports"), F.count_if(F.col("status") == "pass").alias("passed"), *[counted(s).alias(s) for s in ("agree", "overlap", "conflict", "backend_only", "no_local_route")],
        F.count_if((F.col("status") != "pass") | (F.col("agreement") != "agree")).alias("conflicts"), F.coalesce(F.sum("common_count"), F.lit(0)).alias("common"), F.coalesce(F.sum("candidate_count"), F.lit(0)).alias("candidates"),
    )
    rate = lambda part, whole: F.coalesce(floor_percent(F.col(part), F.col(whole)), F.lit(0.0))
    few, low = F.col("reports") < least_reports, F.col("rate") < least_rate
    return one.withColumn("rate", rate("agree", "reports")).withColumn("candidate_rate", rate("common", "candidates")).withColumn(
        "status", F.when(few, "insufficient_reports").when(low | (F.col("conflicts") > 0), "needs_review").otherwise("pass")
    ).withColumn(
        "next_action",
        F.when(few, "collect_more_bridge_reports")
        .when((F.col("backend_only") > 0) | (F.col("no_local_route") > 0), "review_backend_only_routes")
        .when(F.col("conflict") > 0, "review_backend_local_conflicts")
        .when(F.col("overlap") > 0, "review_backend_order_vs_local_route")
        .when(low, "raise_backend_agreement_rate")
        .otherwise("run_more_real_backend_tasks"),
    )


def trial_decision(reports: DataFrame, least_reports: int, least_quality: float | None = None) -> DataFrame:
    """One row over reports (outcome, quality): counts, status, next action and the outcome that it is about."""
    poor = (F.col("quality").isNull() | (F.col("quality") < least_quality)) if least_quality is not None else F.lit(False)
    one = reports.agg(
        F.count("*").alias("reports"), *[F.count_if(poor if o == "route_quality_below_threshold" else F.col("outcome") == o).alias(o) for o, _ in TRIAL_ACTIONS]
    )
    few = F.col("reports") < least_reports
    action, about = F.lit("publish_external_beta_summary"), F.lit("")
    for outcome, work in reversed(TRIAL_ACTIONS):
        action, about = F.when(F.col(outcome) > 0, work).otherwise(action), F.when(F.col(outcome) > 0, outcome).otherwise(about)
    status = F.when(few, "insufficient_reports").when(F.col("needs_triage") > 0, "needs_triage").when(F.col("route_quality_below_threshold") > 0, "quality_gate_failed").otherwise("complete")
    return one.withColumn("status", status).withColumn("next_action", F.when(few, "collect_more_external_beta_reports").otherwise(action)).withColumn("about", F.when(few, "").otherwise(about))


def priority_reports(reports: DataFrame, decision: DataFrame, least_quality: float | None = None) -> DataFrame:
    """The reports that the decision's next action is about."""
    poor = (F.col("quality").isNull() | (F.col("quality") < least_quality)) if least_quality is not None else F.lit(False)
    about = F.broadcast(decision.select("about"))  # one row
    return reports.join(about, (F.col("outcome") == F.col("about")) | ((F.col("about") == "route_quality_below_threshold") & poor)).drop("about")
