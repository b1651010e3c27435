"""Queries of contracts before the sink, the clean-up log, provider rechecks and breakers, each with SQL of the whole rule."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import contracts as K
from quillmesh.operators import organisations as O
from quillmesh.operators import patches as P
from quillmesh.operators import rechecks as R
from quillmesh.plans.analogs import duck_sql, run_sql
from quillmesh.plans.decisions import _ALL_GREEK, _FIRSTS, _host, _list, _own, _pick, _plain, _split, _telling
from quillmesh.streaming import breakers as T
from quillmesh.streaming.events import run_available

Query = Callable[[SparkSession, str], DataFrame]

# Contracts ------------------------------------------------------------------------------------------------------------

#: Chapters as they come to the sink; some break a rule, some several.
INCOMING = """select id, case when id % 9 = 0 then '' when id % 10 = 1 then null else 'f' || cast(fraternity_id as varchar(20)) end as fraternity_slug, case when id % 41 <> 0 then 's' end as source_slug, case when id % 3 = 0 then 'x' end as external_id,
    case when id % 13 <> 0 then 'c' || cast(id as varchar(20)) else '' end as slug, case when id % 17 <> 0 then name end as name, university as university_name, state as city, state, case when id % 19 = 0 then '' else 'USA' end as country, website_url,
    case when id % 23 = 0 then 'closed' else chapter_status end as chapter_status from chapters"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, f"select * from ({INCOMING}) i").withColumns({
        "missing_optional_fields": F.when(F.col("id") % 31 != 0, F.array(F.lit("city"), F.when(F.col("id") % 29 != 0, F.lit("state")))),
        "field_states": F.when(F.col("id") % 43 != 0, F.create_map(F.lit("website_url"), F.when(F.col("id") % 37 != 0, F.lit("found")))),
    })
    rows = K.checked(rows, K.CHAPTER, "id")
    return rows.select("id", F.when(F.size("reasons") == 0, "sink").otherwise("quarantine").alias("side"), F.array_join("reasons", ",").alias("reasons"))


_BREAKS = [
    ("fraternity_slug is null", "type:fraternity_slug"), ("len(fraternity_slug) < 1", "min_length:fraternity_slug"), ("source_slug is null", "type:source_slug"), ("len(slug) < 1", "min_length:slug"), ("name is null", "type:name"), ("len(country) < 1", "min_length:country"),
    ("chapter_status not in ('active', 'inactive', 'unknown')", "enum:chapter_status"), ("id % 31 = 0", "type:missing_optional_fields"), ("id % 31 <> 0 and id % 29 = 0", "items:missing_optional_fields"), ("id % 43 = 0", "type:field_states"), ("id % 43 <> 0 and id % 37 = 0", "values:field_states"),
]
_CONTRACT_SQL = f"""with i as ({INCOMING}), r as (select id, array_to_string(list_filter([{", ".join(f"case when {test} then '{name}' end" for test, name in _BREAKS)}], lambda x: x is not null), ',') as reasons from i)
    select id, case when reasons = '' then 'sink' else 'quarantine' end as side, reasons from r"""

# Clean-up -------------------------------------------------------------------------------------------------------------

#: Chapters with contacts of their own, of the nationals, of offices, of schools and of others.
CONTACTS = f"""select id, {_pick(4, "Beta Rho", "Texas Tech Chapter", "Zeta Chapter", of="id")} as name, {_pick(3, "sigma-chi", "kappa-sigma", "tau-kappa-epsilon", of="(id + 1)")} as slug, {_pick(5, "Texas Tech University", "Rice University", "University of Texas", "State College", of="(id + 2)")} as school,
    {_pick(4, "https://ttusigchi.org/", "https://www.x.org", "", of="id")} as website_url, {_pick(11, "info@sigmachi.org", "office.sigmachi@ttu.edu", "greeklife@ttu.edu", "betarho@gmail.com", " HQ@tke.org", "jane@x.org", "studentlife.ttu@gmail.com", "kappasigma.advisor@rice.edu", "", of="(id + 3)")} as contact_email,
    {_pick(13, "https://instagram.com/sigmachihq/", "https://instagram.com/ttusigmachi", "https://www.instagram.com/texastechuniversity", "https://instagram.com/riceu", "https://instagram.com/kappasigma_rice", "https://instagram.com/tke.zeta/", "https://instagram.com/random.person", "https://instagram.com/sigmachi", "https://instagram.com/ttu", "https://instagram.com/Kappa.Sigma.National", "", of="(id + 4)")} as instagram_url,
    {_pick(3, "https://sigmachi.org/chapters", "https://ttu.edu/x", of="id")} as source_url, {_pick(2, "hq@tke.org ", of="id")} as national_email, {_pick(2, "https://instagram.com/SigmaChi/", of="id")} as national_instagram,
    id % 20 = 0 as all_invalid, case when id % 11 = 3 then 'award_or_honor_row' end as invalid_reason, case when id % 7 = 2 then 'blocked_host' end as website_rejection, {_pick(8, "contact_email", "instagram_url", "website_url", of="id")} as trusted from chapters"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, f"select * from ({CONTACTS}) c", {"customer": "c_custkey"}).withColumns({
        "specificity": F.when(F.col("trusted").isNotNull(), F.create_map("trusted", F.lit("school_specific"))), "patched_pass": F.lit(None).cast("int"),
        "field_states": F.when(F.col("all_invalid"), F.map_from_arrays(F.array(*map(F.lit, P.FIELDS)), F.array(*(F.lit("invalid_entity") for _ in P.FIELDS)))),
    })
    after = P.applied(rows, P.proposals(rows))
    missing = F.array_join(F.array_sort(F.map_keys(F.map_filter("field_states", lambda _, v: v == "missing"))), ",")
    return after.select("id", *P.FIELDS, missing.alias("missing"), F.array_join("reasons", ",").alias("reasons"), "patched_pass")


_HOLDS = "len({0}) >= {1} and contains(h, {0})"
_CLEAN_SQL = f"""with c as ({CONTACTS}), n as (select *, {_plain("replace(coalesce(slug, ''), '-', ' ')")} as shown, {_plain("coalesce(school, '')")} as sch, {_plain("coalesce(name, '')")} as cha, lower(split_part(contact_email, '@', 1)) as local_, case when contains(contact_email, '@') then lower(trim(split_part(contact_email, '@', 2))) else '' end as dom,
        {_plain("coalesce(contact_email, '')")} as near, regexp_replace(lower(coalesce(regexp_extract(regexp_replace(trim(instagram_url), '/+$', ''), '[^/]*$'), '')), '[^a-z0-9]+', '', 'g') as h from c),
    o as (select *, shown as phrase, {_split("shown", "len(w) >= 3 and w not in ('the', 'and', 'of', 'for')")} as own_words, {_telling("sch")} as sw, {_telling("cha")} as cw, regexp_replace(local_, '[^a-z0-9]+', '', 'g') as lj, {_FIRSTS.format("shown")} as ini, {_FIRSTS.format("sch")} as sini, {_FIRSTS.format("cha")} as cini from n),
    p as (select *, own_words as tokens, list_filter(cw, lambda w: not list_contains(sw, w) and not list_contains(own_words, w) and not list_contains({_list(O.CHAPTER_STOPWORDS)}, w)) as signal_,
        list_filter([phrase, case when len(replace(phrase, ' ', '')) >= 6 then replace(phrase, ' ', '') else '' end, case when len(ini) >= 2 then ini else '' end, array_to_string({_split("phrase", "true")}[1:2], ' ')], lambda a: a <> '') as aliases, {_split("regexp_replace(cha, '( (chapter|colony))+$', '')", "true")} as letters,
        starts_with(sch, 'university of ') as of_, regexp_replace(sch, '^university of | state university$', '') as core, case when sch <> '' then regexp_extract(near, '\\b([a-z0-9]+) ' || sch || '\\b', 1) else '' end as pre from o),
    q as (select *, {_own("near")} as own, sch <> '' and (of_ and pre <> '' and not list_contains({_list(O.PREFIXES_ALLOWED)}, pre) and not list_contains(own_words, pre) or of_ and core <> '' and contains(near, core || ' state')) as clash,
        lj <> '' and (shown <> '' and contains(lj, replace(shown, ' ', '')) or len(sini) >= 3 and contains(lj, sini) or len(list_filter(cw, lambda w: len(w) >= 4 and contains(lj, w))) > 0 or len(ini) >= 3 and contains(lj, ini)) as identity, list_contains({_list(O.OFFICE_PREFIXES)}, local_) or len(list_filter({_list(O.OFFICE_MARKERS)}, lambda m: contains(local_, m))) > 0 as office,
        dom <> '' and (ends_with(dom, '.edu') or {" or ".join(f"coalesce({x} <> '' and (dom = {x} or ends_with(dom, '.' || {x})), false)" for x in (_host("website_url"), _host("source_url")))}) as known,
        shown <> '' and contains(h, replace(shown, ' ', '')) or len(list_filter(aliases, lambda a: len(replace(a, ' ', '')) >= 3 and contains(h, replace(a, ' ', '')))) > 0 as named, {_HOLDS.format("ini", 3)} as short,
        not (len(letters) between 1 and 4 and len(list_filter(letters, lambda w: not list_contains({_ALL_GREEK}, w))) = 0) and len(signal_) > 0 as telling, {_HOLDS.format("sini", 3)} as by_school, len(list_filter(sw, lambda w: len(w) >= 5 and contains(h, w))) > 0 as by_word from p),
    r as (select *, telling and ({_HOLDS.format("replace(cha, ' ', '')", 4)} or {_HOLDS.format("cini", 2)}) as by_chapter, h <> '' and (sch <> '' and (starts_with(h, replace(sch, ' ', '')) or len(h) >= 5 and starts_with(replace(sch, ' ', ''), h)) or len(sini) >= 3 and h = sini) as brand, h <> '' and (named or short) as org,
        case when office and not identity then false else identity and (known or own) or own and not clash and (sch <> '' and contains(near, sch) or len(sw) > 0 and len(list_filter(sw, lambda w: contains(near, w))) >= least(len(sw), 2)) end as alone from q),
    s as (select *, (case when named then 2 when short then 1 else 0 end) + (case when by_school then 2 when by_word then 1 else 0 end) + by_chapter::int as score from r),
    t as (select *, case when coalesce(trim(website_url), '') <> '' and coalesce(trusted, '') <> 'website_url' and website_rejection is not null then 'legacy_website_failed_official_verification' end as w,
        case when coalesce(trim(contact_email), '') <> '' and coalesce(trusted, '') <> 'contact_email' then case when trim(national_email) <> '' and lower(trim(contact_email)) = lower(trim(national_email)) then 'legacy_nationals_generic_contact' when office and not alone then 'legacy_email_failed_chapter_specificity' end end as e,
        case when coalesce(trim(instagram_url), '') <> '' and coalesce(trusted, '') <> 'instagram_url' then case when trim(national_instagram) <> '' and lower(regexp_replace(trim(instagram_url), '/+$', '')) = lower(regexp_replace(trim(national_instagram), '/+$', '')) or org and not (h <> '' and (by_school or by_word or by_chapter)) and regexp_matches(h, 'hq|national') then 'legacy_nationals_generic_contact'
          when not (not brand and (score >= 4 or score >= 3 and telling and org)) and (brand or not org) then 'legacy_instagram_failed_chapter_specificity' end end as g from s)
    select id, case when w is null then website_url end as website_url, case when e is null then contact_email end as contact_email, case when g is null then instagram_url end as instagram_url, concat_ws(',', case when e is not null then 'contact_email' end, case when g is not null then 'instagram_url' end, case when w is not null then 'website_url' end) as missing,
        concat_ws(',', 'website_url:' || w, 'contact_email:' || e, 'instagram_url:' || g) as reasons, case when w is not null or e is not null or g is not null then 2 end as patched_pass from t where not all_invalid and invalid_reason is null"""

# Rechecks -------------------------------------------------------------------------------------------------------------

ORDER = ["searxng", "brave", "bing", "tavily", "other"]
JOBS = "select id, id % 5 as worker_id, priority, scheduled_at from field_jobs"
#: What each worker's stretches tried: the providers' rates differ by worker and stretch.
TRIED = """select id % 5 as worker_id, cast(floor(id / 5) as bigint) % 8 as stretch, provider, id % 5 <> 4 and (status = 'success' or cast(floor(id / 40) as bigint) % (2 + id % 5) = 0) and not (provider = 'searxng' and id % 5 < 2) as succeeded from attempts where cast(floor(id / 5) as bigint) % 8 <> 3"""


def rechecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = R.claimed_batches(run_sql(spark, sf_dir, JOBS), [F.col("priority").desc(), F.col("scheduled_at"), F.col("id")], 160)
    plan = R.planned(jobs, run_sql(spark, sf_dir, TRIED), ORDER)
    return plan.select("worker_id", "id", "rank", "stretch", F.array_join("order", ",").alias("order"), "degraded")


_RATE = "(map_extract(h, {0})[1][2] / map_extract(h, {0})[1][1]::double)"
_GROUP = f"case when coalesce(map_extract(h, ord[i])[1][1] >= {R.ENOUGH}, false) then case when {_RATE.format('ord[i]')} >= {R.LEAST} then 0 when i <= 2 then 2 else 1 end else 1 end"
_RECHECK_SQL = f"""with recursive j as (select worker_id, id, row_number() over (partition by worker_id order by priority desc, scheduled_at, id) - 1 as rank from ({JOBS}) b), b as (select *, rank // {R.EVERY} as stretch from j where rank < 160),
    a as (select worker_id, stretch, provider, count(*)::bigint as n, count(*) filter (succeeded)::bigint as s from ({TRIED}) t group by all), h as (select worker_id, stretch, map(list(provider), list([n, s])) as h from a group by all),
    r(worker_id, k, ord, degraded) as (select distinct worker_id, 0::bigint, {_list(ORDER)}, false from b union all
      select r.worker_id, k + 1, case when degraded or h is null then ord else list_transform(list_sort(list_transform(range(1, len(ord) + 1), lambda i: {{'g': {_GROUP}, 'r': case when {_GROUP} = 0 then -{_RATE.format('ord[i]')} else 0e0 end, 'i': i}})), lambda x: ord[x.i]) end,
        degraded or h is not null and len(list_filter(ord, lambda p: coalesce(map_extract(h, p)[1][1] >= {R.ENOUGH}, false))) > 0 and len(list_filter(ord, lambda p: coalesce(map_extract(h, p)[1][1] >= {R.ENOUGH} and {_RATE.format('p')} >= {R.LEAST}, false))) = 0
      from r left join h on h.worker_id = r.worker_id and h.stretch = r.k where k < 8)
    select b.worker_id, id, rank, stretch, array_to_string(ord, ',') as order, degraded from b join r on r.worker_id = b.worker_id and r.k = b.stretch"""

# Breakers -------------------------------------------------------------------------------------------------------------

COOLDOWN = 3600


def _folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one; a temporary one only where none is set, as in tests."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or os.path.join(tempfile.gettempdir(), 'quillmesh')}/breakers-{uuid.uuid4().hex}"


def breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts table as a stream: its rows' own time, and all of what is there at once, as files have no order."""
    schema, path = spark.read.parquet(f"{sf_dir}/events.parquet").schema, _folder(spark)
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    provider = F.when(F.col("user_id") % 4 == 0, "searxng").when(F.col("user_id") % 4 == 1, "bing").when(F.col("user_id") % 4 == 2, "brave").otherwise("tavily")
    rows = events.select(provider.alias("key"), F.col("event_id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    run_available(T.breakers(rows, 3, COOLDOWN, "1 hour"), lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/state")
    return spark.read.parquet(f"{path}/out").where("id is not null").select("key", "id", "state", "streak", F.unix_millis("open_until").alias("open_until"))


_BREAKER_SQL = f"""with recursive e as (select provider as key, id, epoch_ns(created_at) // 1000000 as ms, status = 'failed' as failed, row_number() over (partition by provider order by created_at, id) as n from attempts),
    r as (select key, n, id, 'closed' as state, failed::bigint as streak, 0::bigint as til from e where n = 1 union all
      select e.key, e.n, e.id, case when til > ms then 'refused' when failed and streak + 1 >= 3 then 'open' else 'closed' end, case when til > ms then streak when failed then streak + 1 else 0 end, case when til > ms then til when failed and streak + 1 >= 3 then ms + {COOLDOWN * 1000} when failed then til else 0 end
      from r join e on e.key = r.key and e.n = r.n + 1)
    select key, id, state, streak, nullif(til, 0) as open_until from r"""

QUERIES: dict[str, Query] = {"d54_cleaned_contacts": cleaned, "s14_chapter_contracts": contracts, "t03_breaker_states": breakers, "t09_mid_batch_rechecks": rechecked}
ORACLE_SQL: dict[str, str] = {"d54_cleaned_contacts": duck_sql(_CLEAN_SQL), "s14_chapter_contracts": duck_sql(_CONTRACT_SQL), "t03_breaker_states": duck_sql(_BREAKER_SQL), "t09_mid_batch_rechecks": duck_sql(_RECHECK_SQL)}
