"""The catalogue of relational reports: queue, accuracy, coverage, replay, comparison, gates and listings.

Every entry is portable SQL over the relations of ``analogs``; Spark plans it from Parquet scans, DuckDB checks it.
Null order is always written out, ties are broken by a unique key, and "now" is a parameter.
"""

from __future__ import annotations

from quillmesh.operators.organisations import OFFICE_MARKERS, OFFICE_PREFIXES

REASON = "coalesce(nullif(trim(blocked_reason), ''), 'unknown')"
STATE = "coalesce(queue_state, 'actionable')"
REPAIR = "('queued_for_entity_repair', 'identity_semantically_incomplete', 'repair_exhausted')"
#: F09: the lane of a queued job, repair first (as SQL reports have it).
LANE = f"""case when {STATE} = 'blocked_repairable' or {REASON} in {REPAIR} then 'repair_backlog'
    when {STATE} = 'blocked_provider' then 'provider_dependent_search' when {STATE} = 'blocked_dependency' then 'dependency_blocked'
    when {REASON} in ('provider_degraded', 'transient_network', 'provider_low_signal') then 'provider_dependent_search'
    when {REASON} in ('dependency_wait', 'website_required') then 'dependency_blocked' else 'authoritative_resolution' end"""
#: F09: its twin in the health payload, provider and dependency first.
LANE_STATE_FIRST = f"""case when {STATE} = 'blocked_provider' then 'provider_dependent_search' when {STATE} = 'blocked_dependency' then 'dependency_blocked'
    when {STATE} = 'blocked_repairable' or {REASON} in {REPAIR} then 'repair_backlog'
    when {REASON} in ('provider_degraded', 'transient_network', 'provider_low_signal') then 'provider_dependent_search'
    when {REASON} in ('dependency_wait', 'website_required') then 'dependency_blocked' else 'authoritative_resolution' end"""
WAITING = f"status = 'queued' and {STATE} in ('deferred', 'blocked_repairable', 'blocked_provider', 'blocked_dependency')"
AGE = "case when scheduled_at > {now} - interval '1' hour then 'lt_1h' when scheduled_at > {now} - interval '6' hour then '1h_to_6h' when scheduled_at > {now} - interval '24' hour then '6h_to_24h' when scheduled_at > {now} - interval '72' hour then '1d_to_3d' else 'gte_3d' end"
#: F12: whole names of office mailboxes, and parts of them.
OFFICE = "^(" + "|".join(OFFICE_PREFIXES) + ")$|" + "|".join(m.replace(".", "[.]") for m in OFFICE_MARKERS)
TRUSTED = "('chapter_specific', 'school_specific', 'national_specific_to_chapter')"


def n(cond: str, name: str) -> str:
    return f"count(*) filter (where {cond}) as {name}"


def queued(state: str) -> str:
    return n(f"status = 'queued' and {STATE} = '{state}'", f"{state}_jobs")


STATES = ", ".join(queued(s) for s in ("actionable", "deferred", "blocked_provider", "blocked_dependency", "blocked_repairable"))
LATEST = "select * from (select *, row_number() over (partition by chapter_id, field_name order by created_at desc nulls last, id desc) as rn from evidence) x where rn = 1"
GOOD_EMAIL, GOOD_INSTAGRAM = f"(contact_email is not null and email_specificity in {TRUSTED})", f"(instagram_url is not null and instagram_specificity in {TRUSTED})"
COVERAGE = f"count(*) as chapters, {n('website_url is not null or instagram_url is not null or contact_email is not null', 'any_contact')}, {n('website_url is not null', 'with_website')}, {n('instagram_url is not null', 'with_instagram')}, {n('contact_email is not null', 'with_email')}, {n('website_url is not null and instagram_url is not null and contact_email is not null', 'all_three')}"
COUNTED = ["chapters", "any_contact", "with_website", "with_instagram", "with_email", "all_three"]
CONSENSUS = "select lower(trim(university)) as school, min(state) as state, count(state) as known_rows, count(distinct state) as distinct_states from chapters where university is not null group by lower(trim(university))"

#: [A55] A campaign item's scorecard: event sums, contacts beyond the baseline, six ratios.
_CARD = (
    "with e as (select job_id, sum(case when reason_code = 'accepted' then 1 else 0 end) as processed, sum(case when reason_code is null then 1 else 0 end) as requeued, sum(case when reason_code = 'rejected' then 1 else 0 end) as failed_terminal, sum(case when field_name = 'website_url' then 1 else 0 end) as websites, sum(case when field_name = 'contact_email' then 1 else 0 end) as emails, "
    "sum(case when field_name = 'instagram_url' then 1 else 0 end) as instagrams, sum(case when field_name <> 'chapter_status' then 1 else 0 end) as any_, sum(case when source_id % 5 = 0 then 1 else 0 end) as three, count(*) as total from evidence group by 1), "
    "b as (select r.id, r.source_id, r.status, r.records % 9 as chapters_discovered, r.pages % 12 as field_jobs_created, processed, requeued, failed_terminal, greatest(0, websites - r.id % 3) as websites_found, greatest(0, emails - r.id % 2) as emails_found, greatest(0, instagrams - r.id % 4) as instagrams_found, greatest(0, any_ - r.id % 5) as any_contact, greatest(0, three - r.id % 2) as all_three, "
    "greatest(r.records % 9, greatest(0, total - r.id % 6), 1) as total_chapters, greatest(processed + requeued + failed_terminal, 1) as job_events from crawl_runs r join e on e.job_id = r.id) "
    "select id, source_id, status, chapters_discovered, field_jobs_created, processed, requeued, failed_terminal, websites_found, emails_found, instagrams_found, any_contact, all_three, least(1e0, chapters_discovered * 1e0 / greatest(field_jobs_created, chapters_discovered, 1)) as source_native_yield, (websites_found + emails_found + instagrams_found) * 1e0 / job_events as search_efficiency, "
    "any_contact * 1e0 / greatest(requeued, 1) as retry_efficiency, any_contact * 1e0 / total_chapters as confidence_quality, case status when 'succeeded' then 1e0 when 'running' then 65e-2 else 35e-2 end as provider_resilience, processed * 1e0 / job_events as queue_efficiency from b"
)

SQL: dict[str, str] = {
    # 2.4 aggregations
    "a01_accuracy_kpis": f"""with latest as ({LATEST}), enriched as (select c.*, coalesce(c.email_specificity, e.contact_specificity) as es, coalesce(c.instagram_specificity, i.contact_specificity) as isp, s.reason_code as status_source
        from chapters c left join latest e on e.chapter_id = c.id and e.field_name = 'contact_email' left join latest i on i.chapter_id = c.id and i.field_name = 'instagram_url' left join latest s on s.chapter_id = c.id and s.field_name = 'chapter_status'),
        f as (select *, (contact_email is not null and coalesce(es in {TRUSTED}, false)) as good_e, (instagram_url is not null and coalesce(isp in {TRUSTED}, false)) as good_i from enriched)
        select count(*) as total_chapters, {n("chapter_status = 'active' and (good_e or good_i)", "complete_rows")}, {n("chapter_status = 'active' and (good_e or good_i)", "chapter_specific_contact_rows")},
        {n("(contact_email is not null or instagram_url is not null) and (contact_email is null or es = 'national_generic') and (instagram_url is null or isp = 'national_generic')", "nationals_only_contact_rows")},
        {n("chapter_status = 'inactive' and status_source = 'accepted'", "inactive_validated_rows")}, {n("coalesce(website_state, '') = 'confirmed_absent'", "confirmed_absent_website_rows")},
        {n("chapter_status = 'active' and good_e", "active_rows_with_chapter_specific_email")}, {n("chapter_status = 'active' and good_i", "active_rows_with_chapter_specific_instagram")},
        {n("chapter_status = 'active' and (website_url is not null or contact_email is not null or instagram_url is not null)", "active_rows_with_any_contact")} from f""",
    "a02_queue_counts": f"select {n("status = 'queued'", 'queued_jobs')}, {STATES}, {n("status = 'running'", 'running_jobs')} from field_jobs",
    "a03_system_baseline": f"""select {n("status = 'queued'", 'queued_jobs')}, {STATES}, {n("status = 'running'", 'running_jobs')}, {n("status = 'done'", 'done_jobs')}, {n("status = 'failed'", 'failed_jobs')},
        {n("status = 'done' and coalesce(terminal_outcome, '') = 'updated'", 'updated_jobs')}, {n("status = 'done' and coalesce(terminal_outcome, '') = 'review_required'", 'review_jobs')}, {n("status = 'done' and coalesce(terminal_outcome, '') = 'terminal_no_signal'", 'terminal_no_signal_jobs')} from field_jobs""",
    "a04_queue_by_field": f"select field_name, {STATES}, {n("status = 'done'", 'done_jobs')}, {n("status = 'failed'", 'failed_jobs')} from field_jobs group by field_name",
    "a05_reason_lane_topk": f"select {REASON} as blocked_reason, {LANE} as queue_lane, count(*) as n from field_jobs where {WAITING} group by 1, 2 order by n desc, 1, 2 limit 20",
    "a06_field_reason_lane_topk": f"select field_name, {REASON} as blocked_reason, {LANE} as queue_lane, count(*) as n from field_jobs where {WAITING} group by 1, 2, 3 order by n desc, 1, 2, 3 limit 20",
    "a07_source_lane_topk": f"select coalesce(s.slug, 'unknown') as source_slug, {LANE} as queue_lane, count(*) as n from field_jobs j left join crawl_runs r on r.id = j.crawl_run_id left join sources s on s.id = r.source_id where j.{WAITING} group by 1, 2 order by n desc, 1, 2 limit 20",
    "a08_age_buckets": f"select {AGE} as age_bucket, count(*) as n from field_jobs where {WAITING} group by 1",
    "a09_worker_liveness": f"select {n("status = 'active' and lane = 'contact_resolution' and (lease_expires_at is null or lease_expires_at > {now})", 'active_workers')}, {n("lane = 'contact_resolution' and lease_expires_at is not null and lease_expires_at <= {now}", 'stale_workers')} from workers",
    "a10_reason_codes_topk": "select coalesce(reason_code, 'unknown') as reason_code, count(*) as n from evidence group by 1 order by n desc, 1 limit 12",
    "a11_audit_counts": f"""select issue, count(*) as n from (select id, 'generic_email' as issue from chapters where contact_email is not null and coalesce(email_specificity, '') not in {TRUSTED}
        union all select id, 'generic_instagram' from chapters where instagram_url is not null and coalesce(instagram_specificity, '') not in {TRUSTED} union all select id, 'website_state_conflict' from chapters where website_url is null and website_state = 'found') x group by issue""",
    "a12_provider_summary": f"select provider, endpoint, count(*) as attempts, {n("status = 'success'", 'successes')}, {n("status = 'failed'", 'failures')}, {n("status = 'empty'", 'empties')}, {n('result_count > 0', 'with_results')}, avg(cast(latency_ms as double)) as avg_latency_ms from attempts group by provider, endpoint",
    "a13_reward_by_action": "select action_type, reward_stage, count(*) as n, avg(reward_value) as avg_reward, sum(reward_value * discount_factor) as discounted from rewards group by action_type, reward_stage",
    "a13_context_summary": "select o.context_bucket, o.selected_action, count(*) as n, avg(o.risk_score) as avg_risk, avg(r.reward_value) as avg_reward from observations o join rewards r on r.id = o.id group by 1, 2",
    "a14_coverage_for_runs": f"select {COVERAGE} from (select distinct chapter_id from field_jobs where status = 'done') j join chapters c on c.id = j.chapter_id",
    "a15_source_snapshot": f"select s.slug, j.field_name, {STATES}, {n("status = 'done'", 'done_jobs')}, {n("status = 'running'", 'running_jobs')} from (select j.*, r.source_id from field_jobs j join crawl_runs r on r.id = j.crawl_run_id) j join sources s on s.id = j.source_id group by s.slug, j.field_name",
    "a16_queue_depth": "select coalesce(s.slug, 'unknown') as source_slug, count(*) as depth, min(j.scheduled_at) as oldest from field_jobs j left join crawl_runs r on r.id = j.crawl_run_id left join sources s on s.id = r.source_id where j.status = 'queued' group by 1 order by depth desc, 1 limit 20",
    "a17_action_leaderboard": f"select o.selected_action, count(*) as n, sum(r.reward_value) as total_reward, {n('o.n_flags > 0', 'guarded')}, avg(case when o.n_flags > 0 then 1e0 else 0e0 end) as guardrail_rate from observations o left join rewards r on r.id = o.id group by 1",
    "a17_delayed_attribution": "select o.selected_action, count(*) as credits, sum(r.reward_value * r.discount_factor) as credit from rewards r join observations o on o.id = r.attributed_id where r.reward_stage = 'delayed' group by 1",
    "a18_list_metadata": f"select count(*) as total, count(distinct state) as n_states, count(distinct chapter_status) as n_statuses, {n(GOOD_EMAIL, 'guarded_email')}, {n(GOOD_INSTAGRAM, 'guarded_instagram')} from chapters",
    "a18_distinct_values": "select array_sort(array_agg(distinct chapter_status)) as statuses from chapters",
    "a19_state_consensus": CONSENSUS,
    "a20_map_summary": f"with consensus as ({CONSENSUS}) select coalesce(c.state, k.state, 'unknown') as state, count(*) as n from chapters c left join (select * from consensus where known_rows > 0 and distinct_states = 1) k on k.school = lower(trim(c.university)) group by 1",
    "a21_source_status": """with x as (select *, row_number() over (partition by source_id order by started_at desc, id desc) as rn from crawl_runs)
        select s.slug, max(case when rn = 1 then x.status end) as last_status, max(case when x.status = 'succeeded' then started_at end) as last_success,
        greatest(0e0, least(9.9e-1, case max(case when rn = 1 then x.status end) when 'succeeded' then 9e-1 when 'partial' then case when max(case when x.status = 'succeeded' then started_at end) is not null then 7.5e-1 else 4e-1 end
        when 'failed' then case when max(case when x.status = 'succeeded' then started_at end) is not null then 5e-1 else 2.5e-1 end else 6e-1 end - case when s.active then 0e0 else 2e-1 end)) as confidence
        from sources s join x on x.source_id = s.id group by s.slug, s.active""",
    "a22_run_status_counts": f"select {', '.join(n(f"status = '{s}'", s) for s in ('succeeded', 'partial', 'failed', 'running'))}, count(*) as total from crawl_runs",
    "a23_alert_summary": f"select {n("status = 'open'", 'open_alerts')}, {n("status = 'open' and severity = 'critical'", 'critical')}, {n("status = 'open' and severity = 'warning'", 'warning')}, min(created_at) filter (where status = 'open') as oldest_open from alerts",
    "a24_recipient_rollup": f"select chapter_id, count(*) as recipients, {n("status = 'resolved'", 'sent')}, {n("status = 'open'", 'pending')}, case when count(*) filter (where status = 'open') = count(*) then 'draft' when count(*) filter (where status = 'resolved') = count(*) then 'completed' when count(*) filter (where status = 'resolved') > 0 then 'partial' else 'running' end as campaign_status from review_items group by chapter_id",
    "a25_crawl_replay": "select o.selected_action as action, count(*) as n, avg(o.risk_score) as avg_risk, avg(r.reward_value) as avg_reward, sum(case when r.reward_stage = 'terminal' then r.reward_value else 0 end) as terminal_reward from observations o left join rewards r on r.id = o.id group by 1",
    "a26_agreement_matrix": "select predicted || '->' || actual as transition, count(*) as n, avg(case when predicted = actual then 1e0 else 0e0 end) as agreement from observations group by 1",
    "a27_policy_compare": "select context_bucket, selected_action, predicted, count(*) as n, avg(case when predicted = actual then 1e0 else 0e0 end) as agreement, avg(risk_score) as avg_risk from observations group by 1, 2, 3",
    "a28_promotion_candidates": "select context_bucket, selected_action, count(*) as n, avg(case when predicted = actual then 1e0 else 0e0 end) as precision_ from observations where predicted = 'found' group by 1, 2 having count(*) >= 5 and avg(case when predicted = actual then 1e0 else 0e0 end) >= 0.3",
    "a29_shadow_diff": f"select count(*) as observed, {n('predicted <> actual', 'mismatches')}, avg(case when predicted <> actual then 1e0 else 0e0 end) as mismatch_rate from observations",
    "a30_family_comparison": f"""with f as (select family, count(*) as runs, avg(cast(pages as double)) as avg_pages, avg(cast(records as double)) as avg_records, avg(case when status = 'succeeded' then 1e0 else 0e0 end) as success_rate from crawl_runs group by family)
        select a.runs as adaptive_runs, l.runs as legacy_runs, a.avg_pages - l.avg_pages as d_pages, a.avg_records - l.avg_records as d_records, a.success_rate - l.success_rate as d_success from f a join f l on a.family = 'adaptive' and l.family = 'legacy'""",
    "a31_comparison_gates": """with f as (select avg(case when family = 'adaptive' and status = 'succeeded' then 1e0 when family = 'adaptive' then 0e0 end) as a, avg(case when family = 'legacy' and status = 'succeeded' then 1e0 when family = 'legacy' then 0e0 end) as l, avg(case when family = 'adaptive' then cast(pages as double) end) as ap, avg(case when family = 'legacy' then cast(pages as double) end) as lp from crawl_runs)
        select 'success' as gate, a - l as observed, a >= l as passed from f union all select 'pages', ap - lp, ap <= lp * 1.05 from f""",
    "a32_p95_nearest_rank": "select provider, percentile_disc(0.95) within group (order by latency_ms) as p95 from attempts group by provider",
    "a33_rounded_index_percentile": """with r as (select provider, latency_ms, row_number() over (partition by provider order by latency_ms, id) - 1 as i, count(*) over (partition by provider) as c from attempts),
        k as (select *, (c - 1) * 5e-1 as x from r) select provider, max(latency_ms) as p50 from k where i = case when x - floor(x) = 0.5 then case when cast(floor(x) as bigint) % 2 = 0 then floor(x) else floor(x) + 1 end else floor(x + 0.5) end group by provider""",
    "a34_kpi_slope": "with d as (select date_trunc('day', created_at) as day, avg(reward_value) as y from rewards group by 1), k as (select y, row_number() over (order by day) - 1 as x from d) select coalesce(regr_slope(y, x), 0e0) as slope from k",
    "a35_balanced_score": "select family, avg(cast(records as double)) / 10 - avg(cast(pages as double) / greatest(records, 1)) - avg(case when status = 'failed' then 1e0 else 0e0 end) as balanced_score from crawl_runs group by family",
    "a36_smoke_metrics": "with q as (select provider, id % 400 as query, max(case when status = 'success' then 1 else 0 end) as good, max(case when result_count = 5 then 1 else 0 end) as official, max(case when result_count = 4 then 1 else 0 end) as national, max(case when latency_ms > 600 then 1 else 0 end) as accepted, max(case when latency_ms between 300 and 600 then 1 else 0 end) as review, max(case when latency_ms < 50 then 1 else 0 end) as unsafe from attempts group by 1, 2), "
    "r as (select provider, latency_ms, row_number() over (partition by provider order by latency_ms, id) - 1 as i, count(*) over (partition by provider) - 1 as n from attempts), x as (select provider, latency_ms, i, n, cast(floor(n * 50 / 100e0) as bigint) as f50, n * 50 % 100 as r50, cast(floor(n * 95 / 100e0) as bigint) as f95, n * 95 % 100 as r95 from r), "
    "p as (select provider, max(case when i = f50 + case when r50 > 50 or r50 = 50 and f50 % 2 = 1 then 1 else 0 end then latency_ms end) as median_latency_ms, max(case when i = f95 + case when r95 > 50 or r95 = 50 and f95 % 2 = 1 then 1 else 0 end then latency_ms end) as p95_latency_ms from x group by 1), "
    "a as (select provider, count(*) as attempt_count, sum(case when status = 'failed' then 1 else 0 end) as errors, sum(case when status = 'empty' and result_count = 0 then 1 else 0 end) as gone, sum(case when status = 'empty' and result_count > 3 then 1 else 0 end) as challenged, sum(case when result_count = 1 then 1 else 0 end) as low from attempts group by 1), "
    "k as (select provider, count(*) as query_count, sum(good) as good, sum(official) as official, sum(national) as national, sum(accepted) as accepted, sum(review) as review, sum(unsafe) as unsafe, case provider when 'tavily' then 8e0 when 'brave' then 5e0 else 0e0 end as cost_per_1000_queries from q group by 1) "
    "select k.provider, " + ", ".join(f"floor({n} * 10000e0 / {d} + 5e-1) / 10000e0 as {c}" for c, n, d in [("raw_success_rate", "good", "query_count"), ("request_error_rate", "errors", "attempt_count"), ("unavailable_rate", "gone", "attempt_count"), ("challenge_anomaly_rate", "challenged", "attempt_count"), ("low_signal_rate", "low", "attempt_count"), ("official_school_result_rate", "official", "query_count"), ("national_directory_result_rate", "national", "query_count"), ("accepted_evidence_rate", "accepted", "query_count"), ("review_required_rate", "review", "query_count"), ("unsafe_candidate_rate", "unsafe", "query_count")])
    + ", median_latency_ms, p95_latency_ms, cost_per_1000_queries, case when accepted > 0 then floor(cost_per_1000_queries * query_count * 10e0 / accepted + 5e-1) / 10000e0 end as cost_per_accepted_evidence, query_count, attempt_count from k join a on a.provider = k.provider join p on p.provider = k.provider",
    "a37_queue_health": f"""with top as (select {LANE_STATE_FIRST} as lane, {REASON} as reason, count(*) as n from field_jobs where {WAITING} group by 1, 2 order by n desc, 2, 1 limit 20), q as (select count(*) as queued from field_jobs where status = 'queued')
        select lane, sum(n) as jobs, case when max(queued) > 0 then sum(n) * 1e0 / max(queued) else 0 end as ratio from top cross join q group by lane""",
    "a38_goldset_metrics": f"select count(*) as cases, {n('expected = predicted', 'correct')}, avg(case when expected = predicted then 1e0 else 0e0 end) as accuracy, {n('predicted = 1 and expected = 0', 'false_active')}, count(*) filter (where predicted = 1 and expected = 1) * 1e0 / greatest(count(*) filter (where predicted = 1), 1) as precision_ from goldset",
    "a39_reason_diversity": f"select reasons, count(*) as chapters from (select chapter_id, count(distinct {REASON}) as reasons from field_jobs group by chapter_id) x group by reasons",
    "a40_hourly_completions": f"select date_trunc('hour', created_at) as hour, count(*) as n, {n("outcome = 'records'", 'completed')} from observations group by 1",
    "a41_benchmark_gates": """with s as (select family, count(*) as total, sum(case when status = 'succeeded' then 1 else 0 end) as ok, sum(case when status = 'failed' then 1 else 0 end) as retried, percentile_disc(0.95) within group (order by pages) as p95 from crawl_runs group by family)
        select 'uplift' as gate, (a.ok - b.ok) * 1e2 / b.ok as observed, (a.ok - b.ok) * 1e2 / b.ok >= 30 as passed from s a join s b on a.family = 'adaptive' and b.family = 'legacy' union all
        select 'retry', (b.retried - a.retried) * 1e2 / b.retried, (b.retried - a.retried) * 1e2 / b.retried >= 60 from s a join s b on a.family = 'adaptive' and b.family = 'legacy' union all
        select 'p95', (b.p95 - a.p95) * 1e2 / b.p95, (b.p95 - a.p95) * 1e2 / b.p95 >= 25 from s a join s b on a.family = 'adaptive' and b.family = 'legacy'""",
    "a42_campaign_scorecards": "select f.region_id as cohort, count(*) as items, sum(r.records) as records, sum(r.pages) as pages, avg(case when r.status = 'succeeded' then 1e0 else 0e0 end) as success_rate from crawl_runs r join sources s on s.id = r.source_id join fraternities f on f.id = s.fraternity_id group by 1",
    "a43_distinct_filtered": f"select count(distinct chapter_id) filter (where {REASON} = 'provider_degraded') as degraded, count(distinct chapter_id) filter (where {REASON} = 'website_required') as waiting, count(distinct chapter_id) as all_chapters from field_jobs",
    "a44_chunk_merge": "select priority as chunk, count(*) as processed, sum(attempts) as attempts, bool_or(status = 'failed') as any_failed, min(scheduled_at) as first_at from field_jobs group by priority",
    "a45_summary_counts": "select reason, status, count(*) as n from review_items group by reason, status",
    "a46_workers_by_lane": "select lane, count(*) as n from workers where status = 'active' and (lease_expires_at is null or lease_expires_at >= {now}) group by lane",
    "a47_isolation_snapshot": "select 'jobs' as what, status, count(*) as n from field_jobs group by status union all select 'runs', status, count(*) from crawl_runs group by status union all select 'alerts', status, count(*) from alerts group by status",
    "a48_review_reasons": "select reason, count(*) as n, sum(case when status = 'open' then 1 else 0 end) as open_items from review_items group by reason order by n desc, reason limit 10",
    "a49_job_status_snapshot": "select status, count(*) as n from field_jobs where field_name = 'find_email' group by status",
    "a50_field_status_pivot": f"select field_name, {', '.join(n(f"status = '{s}'", s) for s in ('queued', 'running', 'done', 'failed'))} from field_jobs group by field_name",
    "a51_epoch_kpis": """with e as (select date_trunc('month', started_at) as epoch, family, sum(records) as records, sum(pages) as pages, avg(case when status = 'succeeded' then 1e0 else 0e0 end) as coverage from crawl_runs group by 1, 2)
        select a.epoch, a.records * 1e0 / greatest(a.pages, 1) as train_records_per_page, l.records * 1e0 / greatest(l.pages, 1) as eval_records_per_page, a.coverage - l.coverage as d_coverage from e a join e l on a.epoch = l.epoch and a.family = 'adaptive' and l.family = 'legacy'""",
    "a52_provider_health": "select provider, avg(case when status = 'success' then 1e0 else 0e0 end) as success_rate, avg(case when status = 'success' then 1e0 else 0e0 end) >= 0.5 as healthy from attempts group by provider",
    "a53_ops_summary": "select (select count(*) from field_jobs where status = 'queued') as queued, (select count(*) from crawl_runs where status = 'running') as running, (select count(*) from alerts where status = 'open') as open_alerts, (select count(*) from workers where status = 'active') as workers",
    "a54_filtered_export": "select id, session_id, selected_action, created_at from observations where selected_action = 'click' and risk_score > 50 order by created_at desc nulls last, id desc limit 100",
    "a55_item_scorecard": _CARD,
    "a55_failure_histogram": "with f as (select job_id as id, 'rejected ' || field_name as reason from evidence where reason_code = 'rejected' union all select crawl_run_id, trim(blocked_reason) from field_jobs where status = 'failed' and trim(coalesce(blocked_reason, '')) <> '') select id, reason, count(*) as n from f group by 1, 2",
    "a56_campaign_summary": "with card as (" + _CARD + "), t as (select source_id, count(*) as item_count, sum(case when status = 'succeeded' then 1 else 0 end) as completed_count, sum(case when status = 'failed' then 1 else 0 end) as failed_count, sum(case when status = 'running' then 1 else 0 end) as active_count, sum(greatest(chapters_discovered, any_contact, all_three)) as chapters, sum(any_contact) as a, sum(all_three) as b, sum(websites_found) as w, sum(emails_found) as e, sum(instagrams_found) as g, sum(processed) as total_processed, sum(requeued) as total_requeued, sum(failed_terminal) as total_failed_terminal from card group by 1), "
    "q as (select r.source_id, sum(case when j.status in ('queued', 'running') then 1 else 0 end) as queue_depth_start, sum(case when j.status = 'queued' then 1 else 0 end) as queue_depth_end from field_jobs j join crawl_runs r on r.id = j.crawl_run_id group by 1) "
    "select t.source_id, item_count, completed_count, failed_count, active_count, a * 1e0 / greatest(chapters, 1) as any_contact_success_rate, b * 1e0 / greatest(chapters, 1) as all_three_success_rate, w * 1e0 / greatest(chapters, 1) as website_coverage_rate, e * 1e0 / greatest(chapters, 1) as email_coverage_rate, g * 1e0 / greatest(chapters, 1) as instagram_coverage_rate, "
    "queue_depth_start, queue_depth_end, queue_depth_start - queue_depth_end as queue_depth_delta, total_processed, total_requeued, total_failed_terminal, case when total_processed > 0 or total_requeued > 0 or total_failed_terminal > 0 or queue_depth_start > queue_depth_end or completed_count > 0 then 'progressed' else 'no_business_progress' end as business_status from t join q on q.source_id = t.source_id",
    "a57_promotion_decision": "with s as (select chapter_id % 60 as round, avg(case when status = 'done' then 1e0 else 0e0 end) as score, sum(case when status = 'queued' and attempts < 2 then 1 else 0 end) as queue_now, sum(case when status = 'queued' and attempts >= 2 then 1 else 0 end) as queue_before, sum(case when blocked_reason = 'website_required' and attempts < 2 then 1 else 0 end) as placeholder_now, sum(case when blocked_reason = 'website_required' and attempts >= 2 then 1 else 0 end) as placeholder_before, "
    "sum(case when blocked_reason = 'transient_network' and attempts < 2 then 1 else 0 end) as overlong_now, sum(case when blocked_reason = 'transient_network' and attempts >= 2 then 1 else 0 end) as overlong_before from field_jobs group by 1), g as (select round, score > 31e-2 + 1e-4 as improved, queue_now <= queue_before as queue_ok, placeholder_now <= placeholder_before and overlong_now <= overlong_before as review_ok from s) "
    "select round, improved and queue_ok and review_ok as promoted, case when improved and queue_ok and review_ok then 'balanced_score_queue_and_review_gates_passed' when not improved then 'balanced_score_not_improved' when not queue_ok then 'queue_efficiency_regressed' else 'precision_safety_regressed' end as reason from g",
    "a57_acceptance_gate": "with r as (select id % 100 as campaign, case when id % 100 % 3 = 0 and status in ('failed', 'running') then 'succeeded' else status end as status, records % 40 as records from crawl_runs), i as (select campaign, count(*) as n, sum(case when status <> 'running' then 1 else 0 end) as terminal, sum(case when status = 'succeeded' then 1 else 0 end) as succeeded, sum(case when status = 'failed' then 1 else 0 end) as failed, sum(greatest(records, 0)) as records from r group by 1), "
    "q as (select crawl_run_id % 100 as campaign, sum(case when j.status in ('queued', 'running') then 1 else 0 end) as before, sum(case when j.status = 'running' then 1 else 0 end) as queued, sum(case when j.blocked_reason in ('website_required', 'transient_network') then 1 else 0 end) as low from field_jobs j group by 1), d as (select session_id % 100 as campaign, sum(case when reward_stage = 'delayed' and session_id % 3 > 0 then 1 else 0 end) as delayed from rewards group by 1), "
    "c as (select i.campaign, terminal = n as terminal_requests, succeeded >= 18 as succeeded_requests, failed = 0 as failed_requests, case when records > 0 then low * 1e0 / records else 0e0 end < 3e-2 as low_confidence_rate, case when before > 0 then (before - queued) * 1e0 / before else 0e0 end >= 5e-1 as queue_improvement, coalesce(delayed, 0) > 0 as delayed_rewards from i join q on q.campaign = i.campaign left join d on d.campaign = i.campaign) "
    "select campaign, terminal_requests, succeeded_requests, failed_requests, low_confidence_rate, queue_improvement, delayed_rewards, terminal_requests and succeeded_requests and failed_requests and low_confidence_rate and queue_improvement and delayed_rewards as passed from c",
    "a58_reason_drift": f"with a as (select {REASON} as reason, count(*) as n from field_jobs where attempts < 2 group by 1), b as (select {REASON} as reason, count(*) as n from field_jobs where status = 'failed' group by 1) select coalesce(a.reason, b.reason) as reason, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full outer join b on a.reason = b.reason",
    "a59_failure_reasons": f"select {REASON} as reason, count(*) as n from field_jobs where status = 'failed' group by 1 order by n desc, 1 limit 10",
    # 2.3 joins
    "j01_dimension_join": "select c.id, c.name, f.slug from chapters c join fraternities f on f.id = c.fraternity_id",
    "j02_left_enrichment": "select j.id, coalesce(s.slug, 'unknown') as source_slug from field_jobs j left join crawl_runs r on r.id = j.crawl_run_id left join sources s on s.id = r.source_id",
    "j03_evidence_pivot": f"with l as ({LATEST}) select chapter_id, max(case when field_name = 'contact_email' then field_value end) as email, max(case when field_name = 'instagram_url' then field_value end) as instagram, max(case when field_name = 'website_url' then field_value end) as website from l group by chapter_id",
    "j04_consensus_join": f"with k as ({CONSENSUS}) select c.id, coalesce(c.state, k.state) as inferred_state from chapters c left join k on k.school = lower(trim(c.university)) and k.known_rows > 0 and k.distinct_states = 1",
    "j05_lateral_latest_source": "select c.id, p.source_id from chapters c left join (select chapter_id, source_id, row_number() over (partition by chapter_id order by created_at desc nulls last, id desc) as rn from evidence) p on p.chapter_id = c.id and p.rn = 1",
    "j06_lateral_two": "select f.id, s.source_id, r.run_id from fraternities f left join (select fraternity_id, max(id) as source_id from sources where active group by fraternity_id) s on s.fraternity_id = f.id left join (select s.fraternity_id, max(r.id) as run_id from crawl_runs r join sources s on s.id = r.source_id group by 1) r on r.fraternity_id = f.id",
    "j07_latest_audit": "select chapter_id, id, status from (select *, row_number() over (partition by chapter_id order by turn desc, id desc) as rn from review_items) x where rn = 1",
    "j08_semi_scoped_jobs": "select j.id from field_jobs j where exists (select 1 from crawl_runs r join sources s on s.id = r.source_id where r.id = j.crawl_run_id and s.active)",
    "j09_anti_sources": "select s.id, s.slug from sources s where not exists (select 1 from evidence e where e.source_id = s.id and e.confidence >= 0.10 and e.weight >= 49)",
    "j10_semi_derived_key": "select c.id from chapters c where exists (select 1 from (select distinct regexp_replace(lower(university), '[^a-z0-9]+', '-'{g}) as k from chapters where chapter_status = 'inactive') x where x.k = regexp_replace(lower(c.university), '[^a-z0-9]+', '-'{g}))",
    "j11_preaggregated_join": "select r.id, coalesce(x.n, 0) as jobs from crawl_runs r left join (select crawl_run_id, count(*) as n from field_jobs group by 1) x on x.crawl_run_id = r.id",
    "j12_double_aggregate_join": "select o.session_id, o.n as observations, coalesce(r.n, 0) as delayed from (select session_id, count(*) as n from observations group by 1) o left join (select session_id, count(*) as n from rewards where reward_stage = 'delayed' group by 1) r on r.session_id = o.session_id",
    "j13_donor_fill": "with d as (select fraternity_id, university, min(instagram_url) as donor from chapters where instagram_url is not null and university is not null group by 1, 2 having count(distinct instagram_url) = 1) select c.id, d.donor from chapters c join d on d.fraternity_id = c.fraternity_id and d.university = c.university where c.instagram_url is null",
    # chapters are counted by fraternity and sources by slug and fraternity before they meet
    "j14_source_coverage": f"with s as (select slug, fraternity_id, count(*) as n from sources group by slug, fraternity_id), c as (select fraternity_id, {COVERAGE} from chapters group by fraternity_id) select s.slug, {', '.join(f'sum(s.n * c.{k}) as {k}' for k in COUNTED)} from s join c on c.fraternity_id = s.fraternity_id group by s.slug",
    "j15_handle_assignments": "select c.id, h.n - 1 as others from chapters c join (select instagram_url, count(*) as n from chapters where instagram_url is not null group by 1) h on h.instagram_url = c.instagram_url",
    "j16_replay_join": "with o as (select selected_action as action, count(*) as n from observations group by 1), r as (select action_type as action, sum(reward_value) as reward from rewards where reward_stage <> 'immediate' group by 1) select o.action, o.n, coalesce(r.reward, 0) as reward from o left join r on r.action = o.action",
    "j17_snapshot_diff": "with a as (select selected_action as k, count(*) as n from observations where session_id % 2 = 0 group by 1), b as (select selected_action as k, count(*) as n from observations where outcome = 'records' group by 1) select coalesce(a.k, b.k) as action, coalesce(a.n, 0) as before_n, coalesce(b.n, 0) as after_n, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full outer join b on a.k = b.k",
    "j19_decision_window": "select o.id, j.status from observations o join rewards r on r.id = o.id and r.created_at between o.created_at - interval '1' hour and o.created_at + interval '1' hour left join field_jobs j on j.id = o.id",
    "j20_nearest_baseline": """with d as (select source_id, session_id, started_at, max(case when status = 'succeeded' then id end) as s from crawl_runs group by 1, 2, 3),
        w as (select source_id, session_id, started_at, max(cast(started_at as varchar(30)) || '|' || cast(s as varchar(20))) over (partition by source_id, session_id order by started_at rows between unbounded preceding and 1 preceding) as latest from d)
        select r.id, cast(split_part(w.latest, '|', 2) as bigint) as base from crawl_runs r join w on w.source_id = r.source_id and w.session_id = r.session_id and w.started_at = r.started_at where r.status = 'failed' and w.latest is not null""",
    "j21_tiered_lookup": "select chapter_id, field_value from (select chapter_id, field_value, row_number() over (partition by chapter_id order by tier, case when reason_code is null then 1 else 0 end, created_at desc nulls last, id desc) as rn from (select *, case when reason_code = 'accepted' then 0 else 1 end as tier from evidence) t) x where rn = 1",
    "j22_transient_probe": "select c.id, exists (select 1 from field_jobs j where j.chapter_id = c.id and (j.blocked_reason ilike '%network%' or j.attempts >= 3)) as transient from chapters c",
    "j23_provenance_context": "select chapter_id, source_id, field_name, confidence from (select *, row_number() over (partition by chapter_id order by created_at desc nulls last, id desc) as rn from evidence) x where rn = 1",
    "j24_runs_list": "select r.id, s.slug, f.name from crawl_runs r left join sources s on s.id = r.source_id left join fraternities f on f.id = s.fraternity_id order by r.started_at desc nulls last, r.id desc limit 50",
    # 2.2 filters
    "f01_dynamic_filters": "select id from observations where session_id = 7 and created_at >= timestamp '2024-01-05 00:00:00' order by id limit 500",
    "f02_visibility": "select id from chapters where not (coalesce(website_state, '') = 'confirmed_absent' and contact_email is null and instagram_url is null)",
    "f03_search": "select id from chapters where name ilike '%00001%' or university ilike '%school 1%'",
    "f04_url_shaped": "select id, website_url is not null and regexp_matches(website_url, '^https?://') as url_shaped from chapters",
    "f05_guarded_cast": "select reason, sum(coalesce(try_cast(case when turn % 2 = 0 then cast(size as varchar(20)) else 'n/a' end as int), 0)) as total from review_items group by reason",
    "f06_blank_to_null": f"select {REASON} as reason, count(*) as n from field_jobs group by 1",
    "f07_membership": "select id from field_jobs where field_name in ('find_email', 'find_website') and status not in ('done', 'failed')",
    "f09_queue_lanes": f"select {LANE} as lane, {LANE_STATE_FIRST} as lane_state_first, count(*) as n from field_jobs where {WAITING} group by 1, 2",
    "f10_age": f"select id, {AGE} as age_bucket from field_jobs",
    "f11_display_sanitizer": "select id, case when email_specificity = 'national_generic' then null else contact_email end as contact_email, case when instagram_specificity = 'national_generic' then null else instagram_url end as instagram_url from chapters",
    "f12_office_mailbox": f"select id, regexp_matches(l, '{OFFICE}') as generic_office from (select id, case id % 9 when 0 then 'info' when 1 then 'student.life' when 2 then 'ifc2024' when 3 then 'office.of.x' when 4 then 'infos' when 5 then 'studentxlife' else lower(split_part(contact_email, '@', 1)) end as l from chapters where contact_email is not null) c",
    "f13_national_handle": "select id, regexp_matches(h, 'hq|national') as national from (select id, case id % 5 when 0 then 'sigmachihq' when 1 then 'nationals_office' when 2 then 'the.h.q' else '' end || regexp_replace(lower(instagram_url), '^.*/', '') as h from chapters where instagram_url is not null) c",
    "f14_crm_recipients": f"select id, contact_email from chapters where chapter_status = 'active' and {GOOD_EMAIL} and contact_email not like 'info@%'",
    "f15_degraded_claim": "select j.id from field_jobs j where j.status = 'queued' and (j.field_name = 'verify_school_match' or (j.field_name = 'find_email' and exists (select 1 from chapters c where c.id = j.chapter_id and c.website_url is not null)) or (j.field_name = 'find_website' and exists (select 1 from evidence e where e.job_id = j.id and e.field_name = 'website_url')))",
    # 2.5 windows
    "w01_latest_evidence": LATEST.replace("select *", "select id, chapter_id, field_name, field_value", 1),
    "w02_best_provenance": "select chapter_id, field_value, id from (select *, row_number() over (partition by chapter_id, field_value order by confidence desc nulls last, created_at desc nulls last, id desc) as rn from evidence) x where rn = 1",
    "w03_single_donor": "select fraternity_id, university, id from (select *, row_number() over (partition by fraternity_id, university order by id desc) as rn from chapters where instagram_url is not null) x where rn = 1",
    "w04_chapters_of_run": "select job_id, chapter_id, id from (select *, row_number() over (partition by job_id, chapter_id order by created_at desc nulls last, id desc) as rn from evidence) x where rn = 1",
    "w05_best_of": "select id from (select id, row_number() over (partition by lower(trim(university)), fraternity_id order by score desc nulls last, case when website_url is null then 0 else 1 end + case when contact_email is null then 0 else 1 end + case when instagram_url is null then 0 else 1 end desc, id) as rn from chapters) x where rn = 1",
    "w07_stub_dedupe": "select context_bucket, selected_action, risk_score, id from (select *, row_number() over (partition by context_bucket, selected_action, session_id order by risk_score desc, id) as rn from observations) x where rn = 1",
    "w08_handle_conflicts": "select instagram_url, count(*) as chapters, min(id) as kept from chapters where instagram_url is not null group by 1 having count(*) > 1",
    "w09_log_dedupe": "select id from (select id, selected_action as sig, lag(selected_action) over (partition by session_id order by created_at, id) as before_sig from observations) x where before_sig is null or before_sig <> sig",
    "w11_running_mean": "select signature, count(*) as n, avg(mean_yield) as mean_yield, sum(visits) as visits from templates group by signature",
    "w12_provider_order": "select provider, row_number() over (order by success desc, empties, latency, provider) as rank_ from (select provider, avg(case when status = 'success' then 1e0 else 0e0 end) as success, sum(case when status = 'empty' then 1 else 0 end) as empties, avg(cast(latency_ms as double)) as latency from attempts group by provider) x",
    # 2.6 sorts and limits
    "k01_claim_head": "select id from field_jobs where status = 'queued' and coalesce(queue_state, 'actionable') = 'actionable' order by priority desc, scheduled_at nulls last, case field_name when 'verify_school_match' then 0 when 'verify_website' then 1 when 'find_website' then 2 when 'find_instagram' then 3 else 4 end, id limit 25",
    "k02_frontier_head": "select session_id, id from (select session_id, id, row_number() over (partition by session_id order by risk_score desc, n_flags, created_at, id) as rn from observations) x where rn = 1",
    "k03_severity_order": "select id, severity from alerts where status = 'open' order by case severity when 'critical' then 0 when 'warning' then 1 else 2 end, created_at desc nulls last, id desc limit 50",
    "k04_page_offset": "select id, started_at from crawl_runs order by started_at desc nulls last, id desc limit 50 offset 100",
    # runs are counted by source before they meet the sources
    "k05_cohort": "with runs as (select source_id, count(*) as n from crawl_runs group by source_id), fresh as (select s.id, 0 as tier, s.health as rank_ from sources s where not exists (select 1 from runs r where r.source_id = s.id)), known as (select s.id, 1 as tier, cast(sum(r.n) as double) as rank_ from sources s join runs r on r.source_id = s.id group by s.id) select id, tier from (select * from fresh union all select * from known) x order by tier, rank_ desc, id limit 12",
    "k07_source_resolution": "select fraternity_id, id from (select *, row_number() over (partition by fraternity_id order by case when source_type = 'html_directory' then 0 when active then 1 else 2 end, id) as rn from sources) x where rn = 1",
    "k08_existing_choice": "select fraternity_id, id from (select *, row_number() over (partition by fraternity_id order by health desc nulls last, slug desc, id) as rn from sources) x where rn = 1",
    # 2.7 set operations
    "ub_event_log": "select id, created_at, selected_action as what, risk_score as score, cast(null as double) as reward from observations union all select id, created_at, action_type, cast(null as double), reward_value from rewards",
    "uc_rollout_rows": "select 'queued' as part, field_name, count(*) as n from field_jobs where status = 'queued' group by field_name union all select 'failed', field_name, count(*) from field_jobs where status = 'failed' group by field_name",
    # 2.10 rewrites and 2.1 lookups
    "s02_active_sources": "select s.id, s.slug, f.slug as fraternity_slug from sources s join fraternities f on f.id = s.fraternity_id where s.active",
    "u10_stale_recovery": "select id, case when status = 'running' and scheduled_at < {now} - interval '365' day then 'queued' else status end as status, case when status = 'running' and scheduled_at < {now} - interval '365' day then greatest(attempts - 1, 0) else attempts end as attempts from field_jobs",
    "u11_fail_stale_runs": "select id, case when status = 'running' and started_at < {now} - interval '30' day then 'failed' else status end as status from crawl_runs",
    "u13_state_backfill": f"select id, {STATE} as queue_state, {REASON} as blocked_reason from field_jobs",
    "d55_priority_bump": "select j.id, case when s.active and j.status = 'queued' then greatest(j.priority, 5) else j.priority end as priority from field_jobs j join crawl_runs r on r.id = j.crawl_run_id join sources s on s.id = r.source_id",
}
#: DuckDB replaces the first match unless told otherwise.
DUCK_GLOBAL, SPARK_GLOBAL = ", 'g'", ""

#: The plain joins that stand for reports whose plan avoids them: what they are checked against.
PLAIN: dict[str, str] = {
    "k05_cohort": "with fresh as (select s.id, 0 as tier, s.health as rank_ from sources s where not exists (select 1 from crawl_runs r where r.source_id = s.id)), known as (select s.id, 1 as tier, cast(count(*) as double) as rank_ from sources s join crawl_runs r on r.source_id = s.id group by s.id) select id, tier from (select * from fresh union all select * from known) x order by tier, rank_ desc, id limit 12",
    "j14_source_coverage": f"select s.slug, {COVERAGE} from sources s join chapters c on c.fraternity_id = s.fraternity_id group by s.slug",
    "j15_handle_assignments": "select c.id, count(o.id) as others from chapters c left join chapters o on o.instagram_url = c.instagram_url and o.id <> c.id where c.instagram_url is not null group by c.id",
    "j20_nearest_baseline": "select id, base from (select r.id, b.id as base, row_number() over (partition by r.id order by b.started_at desc, b.id desc) as rn from (select * from crawl_runs where status = 'failed') r join crawl_runs b on b.source_id = r.source_id and b.session_id = r.session_id and b.status = 'succeeded' and b.started_at < r.started_at) x where rn = 1",
}
