"""Commands and read routes by name, as queries of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.plans import catalogue

COMMANDS: dict[str, list[str]] = {
    "run": ["d01_page_profiles", "d02_source_classes", "d36_normalized", "d36_provenance", "u01_chapter_upsert"],
    "run-request": ["k07_source_resolution", "d46_crawl_rounds"],
    "run-request-worker": ["k01_claim_head", "u07_claim"],
    "run-field-job-worker": ["u07_claim", "d38_job_outcomes"],
    "process-field-jobs": ["d37_triage", "u07_claim", "d38_job_outcomes"],
    "search-preflight": ["a52_provider_health", "w12_provider_order"],
    "search-provider-smoke": ["a36_smoke_metrics", "a33_rounded_index_percentile"],
    "doctor": ["a09_worker_liveness", "a37_queue_health"],
    "system-baseline": ["a01_accuracy_kpis", "a03_system_baseline", "a04_queue_by_field", "a05_reason_lane_topk", "a06_field_reason_lane_topk", "a07_source_lane_topk", "a08_age_buckets", "a10_reason_codes_topk"],
    "provenance-audit": ["a11_audit_counts"],
    "enrichment-policy-shadow": ["a29_shadow_diff"],
    "enrichment-export-observations": ["a54_filtered_export"],
    "enrichment-replay-policy": ["a26_agreement_matrix"],
    "enrichment-compare-report": ["a27_policy_compare"],
    "enrichment-promote-verify-school": ["a28_promotion_candidates"],
    "health": ["a22_run_status_counts"],
    "discover-source": ["k07_source_resolution", "k08_existing_choice"],
    "bootstrap": ["s02_active_sources"],
    "revalidate": ["a21_source_status"],
    "crawl-export-observations": ["a54_filtered_export"],
    "crawl-replay-policy": ["a25_crawl_replay", "d14_policy_replay"],
    "crawl-policy-report": ["a13_reward_by_action", "a13_context_summary", "a17_action_leaderboard"],
    "adaptive-train-eval": ["a51_epoch_kpis"],
    "adaptive-train-loop": ["a51_epoch_kpis", "a34_kpi_slope", "a35_balanced_score"],
    "adaptive-replay-window": ["a25_crawl_replay", "w10_delayed_credit"],
    "adaptive-policy-diff": ["j17_snapshot_diff"],
}
ROUTES: dict[str, list[str]] = {
    "chapters": ["j04_consensus_join", "a18_list_metadata", "f11_display_sanitizer", "k04_page_offset"],
    "chapters/map-summary": ["a20_map_summary"],
    "runs": ["j24_runs_list", "j11_preaggregated_join"],
    "review-items": ["j07_latest_audit", "a48_review_reasons"],
    "field-jobs": ["w09_log_dedupe", "ub_event_log"],
    "benchmarks": ["a41_benchmark_gates", "a30_family_comparison"],
    "adaptive/insights": ["a17_action_leaderboard", "a17_delayed_attribution"],
    "adaptive/epochs": ["a51_epoch_kpis"],
    "campaign-runs": ["a42_campaign_scorecards", "a56_campaign_summary", "a57_promotion_decision", "a59_failure_reasons"],
    "crm/campaigns": ["f14_crm_recipients", "u20_outreach", "a24_recipient_rollup"],
    "nationals": ["j01_dimension_join"],
    "agent-ops": ["a53_ops_summary"],
    "health": ["a23_alert_summary"],
}


def answer(spark: SparkSession, sf_dir: str, name: str) -> dict[str, DataFrame]:
    """The frames that a command or route reports."""
    queries = catalogue.queries()
    return {q: queries[q](spark, sf_dir) for q in COMMANDS.get(name) or ROUTES[name]}
