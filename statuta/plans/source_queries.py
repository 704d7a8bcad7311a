"""Candidates, scores and the selected source of each law."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import selection as S
from .base import query

_TOKENS = "list_filter(regexp_extract_all(lower(%s), '[a-z][a-z0-9''-]{2,}'), lambda w: w not in (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"
_points = lambda c, terms: " + ".join(f"(case when contains({c}, '{t}') then {n} else 0 end)" for t, n in terms)
_matches = ", ".join(f"case when contains(low, '{p}') then '{p}' end" for p, _ in S.PHRASES)
# The fixtures' texts have single spaces and line ends already, so that only their ends are trimmed.
_POOL = f"""raw as (select law_id, trim(description) as text, 'card description' as name, 'card-description.txt' as file, url, 'selected from canonical card description rather than attachment' as note, 0 as place, true as is_description from {{sourced}} where length(trim(description)) >= 120
 union all select law_id, trim(description), 'duplicate card description: ' || coalesce(card_name, card_id), 'duplicate-card-description.txt', url, 'selected from duplicate card ' || card_id, 1, true from {{alternates}} where length(trim(description)) >= 120
 union all select law_id, trim(text), name, file, url, null, 2, false from {{papers}}),
 parts as (select r.*, s.congress, s.number, lower(r.text) as low, lower(r.name || ' ' || r.file) as lname, list_filter({_TOKENS % 's.title'}, lambda t: length(t) >= 4) as tokens, length(r.text) as characters from raw r join {{sourced}} s using (law_id)),
 signs as (select *, (contains(low, 'public law ' || congress || '-' || number) or contains(low, 'pub. l. ' || congress || '-' || number) or contains(low, 'pl ' || congress || '-' || number)) as numbered, len(list_filter(tokens, lambda t: contains(low, t))) / len(list_distinct(tokens)) as ratio,
  (contains(low, 'access denied') or contains(left(low, 1000), 'sign in') or contains(left(low, 1000), 'javascript is disabled')) as login, len(list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) < 20 as poor, contains(low, 'be it enacted') as formula,
  len(regexp_extract_all(text, '(?im)^\\s*(?:SEC(?:TION)?\\.?)\\s+\\d+[A-Za-z]?\\s*[.\\-—:]')) as heads, {" + ".join(f"(length(low) - length(replace(low, '{s}', ''))) // {len(s)}" for s in S.SIGNALS)} as signals from parts),
 pool as (select *, case when characters >= 500 then 10 when characters >= 180 then 4 else -12 end + case when numbered then 25 else 0 end + ratio * 30 + {_points('low', S.PHRASES)} + {_points('lname', S.NAME_TERMS)} - case when login then 60 else 0 end - case when poor then 20 else 0 end - case when is_description then 3 else 0 end as score,
  list_filter([case when numbered then '{S.NUMBER}' end, case when ratio >= 0.5 then '{S.TITLE}' end, {_matches}], lambda x: x is not null) as matches,
  list_filter([case when ratio < 0.2 then '{S.FEW_WORDS}' end, case when login then '{S.LOGIN}' end, case when poor then '{S.VARIETY}' end, note], lambda x: x is not null) as warnings from signs),
 ready as (select *, score >= 8 and len(matches) > 0 and (formula or heads >= 2) as enacted, characters >= 120 and score >= 8 and (len(matches) > 0 or score >= 45) and (not is_description or (formula and signals >= 2 and numbered) or (characters >= 500 and (formula or heads >= 2))) as usable from pool),
 best as (select * from ready where usable qualify row_number() over (partition by law_id order by score desc, characters desc, place, name, sha256(text)) = 1)"""
_SAID = "array_to_string(matches, ' | ') as matches, array_to_string(warnings, ' | ') as warnings"


def _pool(sourced, alternates, papers):
    return S.pool(sourced, alternates, papers)


def _joined(df):
    return df.withColumns({c: F.array_join(c, " | ") for c in ("matches", "warnings")})


@query(f"with {_POOL} select law_id, name, place, characters, {_SAID}, is_description from pool")
def st1_candidate_pool(sourced, alternates, papers):
    return _joined(_pool(sourced, alternates, papers)).select("law_id", "name", "place", "characters", "matches", "warnings", "is_description")


@query(f"with {_POOL} select law_id, name, place, round(score::double, 6) as score, characters from pool")
def wn4_score_text(sourced, alternates, papers):
    return _pool(sourced, alternates, papers).select("law_id", "name", "place", F.round("score", 6).alias("score"), "characters")


@query(f"with {_POOL} select law_id, name, place, characters, usable from ready")
def fl4_usable_candidate(sourced, alternates, papers):
    return _pool(sourced, alternates, papers).select("law_id", "name", "place", "characters", S.usable().alias("usable"))


@query(f"with {_POOL} select law_id, name, place, characters, enacted from ready")
def fl3_looks_enacted(sourced, alternates, papers):
    return _pool(sourced, alternates, papers).select("law_id", "name", "place", "characters", S.looks_enacted().alias("enacted"))


_COUNTED = "(select law_id, count(*) as n from ready group by law_id)"
_FIELDS = "coalesce(b.name, '') as selected_name, coalesce(b.url, '') as selected_url, coalesce(sha256(b.text), '') as source_sha256, coalesce(b.characters, 0) as characters, round(coalesce(b.score, 0)::double, 6) as score, coalesce(array_to_string(b.matches, ' | '), '') as matches, coalesce(array_to_string(b.warnings, ' | '), '') as warnings"


@query(f"with {_POOL} select s.law_id, {_FIELDS}, case when b.law_id is null then '{S.NO_SOURCE}' else '' end as error, coalesce(n, 0) as candidate_count, coalesce(b.enacted, false) as looks_enacted from {{sourced}} s left join best b using (law_id) left join {_COUNTED} c using (law_id)")
def wn2_select_source(sourced, alternates, papers):
    out = _joined(S.select_source(sourced, _pool(sourced, alternates, papers), text=False))
    return out.withColumn("score", F.round("score", 6))


@query(f"with {_POOL} select s.law_id, s.title, s.status, {_FIELDS}, case when s.status = 'active' and b.law_id is null then '{S.NO_SOURCE}' else '' end as error, case when s.status = 'active' then coalesce(n, 0) else 0 end as candidate_count from {{sourced}} s left join (select * from best where law_id in (select law_id from {{sourced}} where status = 'active')) b using (law_id) left join {_COUNTED} c using (law_id)")
def snk2_source_register(sourced, alternates, papers):
    active = sourced.where("status = 'active'")
    selected = S.select_source(active, S.pool(active, alternates, papers), text=False)
    return S.source_register(sourced, selected).withColumn("score", F.round("score", 6))


_TITLE = "coalesce(nullif(ltrim(t, '0'), ''), '0')"
_PLACES = """(select p_partkey as place_id, case when p_size % 5 = 0 then '0' || p_size when p_partkey % 31 = 0 then '00' else p_size::varchar end as t, case when p_partkey % 4 = 0 then null when p_partkey % 4 = 1 then ' 12' || lower(left(p_type, 1)) || '~1 ' when p_partkey % 4 = 2 then p_name || '/*é' else p_partkey::varchar end as s,
 case when p_partkey % 3 = 0 then '/a/1' when p_partkey % 3 = 1 then '' end as rest, p_partkey % 7 = 0 as repealed, case when p_partkey % 2 = 0 then '/us/usc/t' || p_size || '/s 1/' || p_brand end as identifier from {part})"""


@query(f"""select place_id, coalesce(identifier, '/us/usc/t' || {_TITLE} || coalesce('/s' || trim(s) || coalesce(rest, ''), '')) as identifier, {_TITLE} as title, trim(s) as section,
 case when s is not null then {_TITLE} || ' U.S.C. § ' || trim(s) || case when rest = '/a/1' then '(a)(1)' else '' end else 'Title ' || {_TITLE} || ', United States Code (title-wide material)' end as citation,
 case when s is not null and not repealed then 'cite/' || {_TITLE} || '/' || replace(url_encode(trim(s)), '%2F', '/') || '/' || case when identifier is not null and rest <> '' then '?p=' || url_encode(identifier) else '' end end as href, repealed as historical, false as inferred from {_PLACES}""")
def fn23_make_target(part):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    rows = part.select(
        k.alias("place_id"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("0"), size)).when(k % 31 == 0, "00").otherwise(size).alias("t"),
        F.when(k % 4 == 1, F.concat(F.lit(" 12"), F.lower(F.left("p_type", F.lit(1))), F.lit("~1 "))).when(k % 4 == 2, F.concat("p_name", F.lit("/*é"))).when(k % 4 == 3, k.cast("string")).alias("s"),
        F.when(k % 3 == 0, "/a/1").when(k % 3 == 1, "").alias("rest"), (k % 7 == 0).alias("repealed"), F.when(k % 2 == 0, F.concat(F.lit("/us/usc/t"), size, F.lit("/s 1/"), "p_brand")).alias("identifier"),
    )
    return rows.select("place_id", T.make_target(*[F.col(c) for c in ("t", "s", "rest", "repealed", "identifier")]).alias("x")).select("place_id", "x.*")


@query("select idx, 'reviewer ' || (idx % 4) as reviewer, 'manifest-' || idx || '.json' as source_manifest, 'review-' || idx || '.json' as output_path, case when idx % 3 = 0 then 'kept' else 'manifest-' || idx || '.json,validation,main' end as reviewed_against from {reports}")
def fn34_stamp_defaults(reports):
    name = lambda prefix: F.concat(F.lit(prefix), F.col("idx").cast("string"), F.lit(".json"))
    against = F.when(F.col("idx") % 3 == 0, F.array(F.lit("kept"))).when(F.col("idx") % 3 == 1, F.array().cast("array<string>"))
    out = T.stamp_defaults(reports.select("idx", against.alias("reviewed_against")), F.concat(F.lit("reviewer "), (F.col("idx") % 4).cast("string")), name("manifest-"), name("review-"), ["validation", "main"])
    return out.withColumn("reviewed_against", F.array_join("reviewed_against", ","))


@query("""select p_partkey as block_id, case p_partkey % 5 when 0 then p_name when 1 then p_name when 2 then 'On ' || p_name when 3 then 'Text' else 'Text' end as heading,
 case p_partkey % 5 when 0 then lower(p_type) || chr(10) || 'more' when 1 then lower(p_type) when 2 then lower(p_type) when 3 then '(a) ' || p_name || chr(10) || lower(p_type) else '' end as body from {part}""")
def fn32_heading_body_split(part):
    k, name, kind, nl = F.col("p_partkey"), F.col("p_name"), F.lower("p_type"), F.lit("\n")
    block = (
        F.when(k % 5 == 0, F.concat(F.lit("“SEC. "), k.cast("string"), F.lit(". "), name, F.lit(".—"), nl, kind, nl, F.lit("more”"))).when(k % 5 == 1, F.concat(F.lit("  §§ 4a-1: "), name, nl, kind, nl))
        .when(k % 5 == 2, F.concat(F.lit("On "), name, F.lit("."), nl, nl, kind)).when(k % 5 == 3, F.concat(F.lit("(a) "), name, nl, kind)).otherwise("")
    )
    return part.select(k.alias("block_id"), T.heading_body_split(block, "Text").alias("x")).select("block_id", "x.heading", "x.body")


@query("select p_partkey as file_id, p_name || chr(10) || lower(p_type) || '  ' || p_brand as said from {part}")
def fn13_rtf_to_text(part):
    rtf = F.concat(F.lit("{\\rtf1\\ansi {\\b "), "p_name", F.lit("}\\par"), F.lower("p_type"), F.lit("\\'e9 "), "p_brand", F.lit("\\fs-24 }"))
    # A control word ends where its letters do, so that the text follows at once.
    return part.select(F.col("p_partkey").alias("file_id"), T.rtf_to_text(F.regexp_replace(rtf, "par([a-z])", "par{}$1")).alias("said"))


@query("select action_id, identifier, case when ends_with(identifier, '/a/1') then 'a.1' else '' end as pin, identifier as back from {actions}")
def fn24_pinpoints(actions):
    base = F.regexp_extract("identifier", "^(/us/usc/t[^/]+/s[^/]+)", 1)
    rows = actions.select("action_id", "identifier", T.pinpoint(F.col("identifier")).alias("pin"), base.alias("base"))
    return rows.select("action_id", "identifier", "pin", T.pinpoint_absolute(F.col("base"), F.col("pin")).alias("back"))
