"""An ordered patch log over contacts: passes propose changes with reasons, the log decides what rows become.

A patch is a row: id, pass_no, seq, field, previous, value, reason. Passes come in order of pass_no, patches of a pass in order of
seq. A patch changes a field only from the value that it was made for, and a row only if its pass is later than the last
one that went over the row (``patched_pass``); so applying a log again changes nothing, and a log in two parts gives what
it gives as a whole. The field ``*`` takes the row out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.operators import organisations as O

FIELDS = ["website_url", "contact_email", "instagram_url"]

# Provenance that is trusted, and marks of an organisation's own handles.
TRUSTED = ["chapter_specific", "school_specific", "national_specific_to_chapter"]
NATIONAL_HANDLE_MARKERS = ["hq", "ihq", "national", "nationals", "officialhq"]
INVALID_PASS, QUARANTINE_PASS = 1, 2


def applied(rows: DataFrame, log: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """[D54] rows after the log: fields, field_states (``missing`` or ``found`` where a patch changed a field), reasons and patched_pass.

    rows: id (unique), the fields, field_states (a map, may be null), patched_pass (null: none yet). A row has a few
    patches a pass and field, so one array holds them.
    """
    patch = F.struct("pass_no", "seq", "field", "previous", "value", "reason")
    per_row = log.groupBy("id").agg(F.array_sort(F.collect_list(patch)).alias("_patches"))
    j = rows.join(per_row, "id", "left")
    fresh = F.filter(F.coalesce("_patches", F.expr("cast(array() as array<struct<pass_no:int,seq:int,field:string,previous:string,value:string,reason:string>>)")), lambda p: p["pass_no"] > F.coalesce("patched_pass", F.lit(0)))
    start = F.struct(*(F.col(f).cast("string").alias(f) for f in fields), F.lit(False).alias("gone"), F.expr("cast(array() as array<string>)").alias("reasons"), F.expr("cast(array() as array<string>)").alias("touched"))

    def step(now: Column, p: Column) -> Column:
        hits = [~now["gone"] & (p["field"] == f) & now[f].eqNullSafe(p["previous"]) for f in fields]
        any_hit = hits[0]
        for h in hits[1:]:
            any_hit = any_hit | h
        out = ~now["gone"] & (p["field"] == "*")
        return F.struct(
            *(F.when(h, p["value"]).otherwise(now[f]).alias(f) for f, h in zip(fields, hits, strict=True)),
            (now["gone"] | out).alias("gone"),
            F.when(any_hit | out, F.concat(now["reasons"], F.array(F.concat_ws(":", p["field"], p["reason"])))).otherwise(now["reasons"]).alias("reasons"),
            F.when(any_hit, F.array_union(now["touched"], F.array(p["field"]))).otherwise(now["touched"]).alias("touched"),
        )

    j = j.withColumn("_fresh", fresh).withColumn("_now", F.aggregate("_fresh", start, step)).where("not _now.gone")
    states = F.coalesce("field_states", F.expr("cast(map() as map<string,string>)"))
    kept = F.map_filter(states, lambda k, _: ~F.array_contains("_now.touched", k))
    value = F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f"_now.{f}"))))
    changed = F.map_from_arrays("_now.touched", F.transform("_now.touched", lambda f: F.when(F.element_at(value, f).isNull(), "missing").otherwise("found")))
    new = {f: F.col(f"_now.{f}") for f in fields} | {"field_states": F.map_concat(kept, changed), "patched_pass": F.greatest("patched_pass", F.array_max(F.transform("_fresh", lambda p: p["pass_no"])))}
    return j.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in rows.columns), F.col("_now.reasons").alias("reasons"))


# Passes ---------------------------------------------------------------------------------------------------------------


def handle_facts(df: DataFrame, handle: Column, job: Column) -> DataFrame:
    """df with h_organisation, h_local, h_brand, h_score: what a handle (letters and digits) holds of the job."""
    df = df.withColumns({"_h": handle, "_j": job})
    h, j = F.col("_h"), F.col("_j")
    holds = lambda x, least: (F.length(x) >= least) & h.contains(x)
    squeezed = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    named, short = holds(j["compact"], 1) | F.exists(j["aliases"], lambda a: holds(squeezed(a), 3)), holds(j["initials"], 3)
    letters = F.filter(F.split(F.regexp_replace(j["chapter"], "( (chapter|colony))+$", ""), " "), lambda w: w != "")
    generic = F.size(letters).between(1, 4) & F.forall(letters, lambda w: w.isin([*S.GREEK.values()]))
    telling = ~generic & (F.size(j["chapter_signal"]) > 0)
    own = telling & (holds(squeezed(j["chapter"]), 4) | holds(j["chapter_initials"], 2))
    school, word = holds(j["school_initials"], 3), F.exists(j["school_words"], lambda w: holds(w, 5))
    campus = squeezed(j["school"])
    brand = ((campus != "") & (h.startswith(campus) | ((F.length(h) >= 5) & campus.startswith(h)))) | ((F.length(j["school_initials"]) >= 3) & (h == j["school_initials"]))
    df = df.withColumns({"h_organisation": (h != "") & (named | short), "h_local": (h != "") & (school | word | own), "h_brand": (h != "") & brand, "_telling": telling})
    score = F.when(named, 2).when(short, 1).otherwise(0) + F.when(school, 2).when(word, 1).otherwise(0) + F.when(own, 1).otherwise(0)
    return df.withColumn("h_score", score)


def proposals(chapters: DataFrame) -> DataFrame:
    """[D54] The patch log of the accuracy clean-up: invalid rows go, contacts that aren't the chapter's are cleared.

    chapters: id, name, slug (of the organisation), school, the fields, source_url, national_email, national_instagram,
    field_states, specificity (a map from field to the type of its provenance), invalid_reason (null: a chapter) and
    website_rejection (null: verified).
    """
    job = O.job_facts(F.col("slug"), F.col("name"), F.lit(None).cast("string"), F.col("school"))
    df = handle_facts(chapters.withColumn("job", job), F.regexp_replace(F.lower(F.substring_index(F.regexp_replace(F.trim(F.coalesce("instagram_url", F.lit(""))), "/+$", ""), "/", -1)), "[^a-z0-9]+", ""), F.col("job"))
    none = F.lit(None).cast("string")
    df, mail = O.mail_facts(df, F.col("contact_email"), F.col("job"), none, none, none, none, F.lit("unknown"), F.expr("cast(array() as array<string>)"), F.col("source_url"), F.col("website_url"))
    df = df.withColumn("_alone", O.mail_alone(F.col("contact_email"), F.col("job"), mail))
    trusted = lambda f: F.coalesce(F.try_element_at("specificity", F.lit(f)).isin(TRUSTED), F.lit(False))
    filled = lambda f: F.coalesce(F.trim(f) != "", F.lit(False)) & ~trusted(f)
    same = lambda a, b: F.coalesce((b != "") & (a == b), F.lit(False))
    plain = lambda c: F.lower(F.regexp_replace(F.trim(c), "/+$", ""))
    mark = F.lit(False)
    for m in NATIONAL_HANDLE_MARKERS:
        mark = mark | F.col("_h").contains(m)
    relevant = ~F.col("h_brand") & ((F.col("h_score") >= 4) | ((F.col("h_score") >= 3) & F.col("_telling") & F.col("h_organisation")))
    by_email = F.when(same(F.lower(F.trim("contact_email")), F.lower(F.trim("national_email"))), "legacy_nationals_generic_contact").when(mail.office & ~F.col("_alone"), "legacy_email_failed_chapter_specificity")
    by_handle = (
        F.when(same(plain("instagram_url"), plain("national_instagram")) | (F.col("h_organisation") & ~F.col("h_local") & mark), "legacy_nationals_generic_contact")
        .when(~relevant & (F.col("h_brand") | ~F.col("h_organisation")), "legacy_instagram_failed_chapter_specificity")
    )
    state = lambda f: F.lower(F.trim(F.coalesce(F.try_element_at("field_states", F.lit(f)), F.lit("")))) == "invalid_entity"
    invalid = F.when(state("website_url") & state("contact_email") & state("instagram_url"), "invalid_entity_legacy").otherwise(F.col("invalid_reason"))

    def patch(pass_no: int, seq: int, field: str, reason: Column) -> Column:
        value = F.col(field) if field != "*" else none
        return F.when(reason.isNotNull(), F.struct(F.lit(pass_no).alias("pass_no"), F.lit(seq).alias("seq"), F.lit(field).alias("field"), value.alias("previous"), none.alias("value"), reason.alias("reason")))

    keep = lambda f, reason: F.when(invalid.isNull() & filled(f), reason)
    made = F.array(
        patch(INVALID_PASS, 1, "*", invalid), patch(QUARANTINE_PASS, 1, "website_url", keep("website_url", F.when(F.col("website_rejection").isNotNull(), "legacy_website_failed_official_verification"))),
        patch(QUARANTINE_PASS, 2, "contact_email", keep("contact_email", by_email)), patch(QUARANTINE_PASS, 3, "instagram_url", keep("instagram_url", by_handle)),
    )
    return df.select("id", F.explode(F.array_compact(made)).alias("p")).select("id", "p.*")
