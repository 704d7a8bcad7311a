"""Closest headings and the places of laws, against scoring every section."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import headings, phrases
from .base import query

_TOKENS = "list_filter(regexp_extract_all(lower(%s), '[a-z][a-z0-9''-]{2,}'), lambda w: w not in (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"
#: A subject's titles may not exist; one subject is outside the Code.
CATALOGUE = '{"promotions": {"titles": [4], "keywords": ["promo"], "non_code": true}, "economy": {"titles": [900, 3, 4], "defaults": ["DEFAULTS"], "keywords": ["economy"]}, "standards": {"titles": [901], "keywords": ["standard"]}, "widgets": {"titles": [11, 12], "keywords": ["widget", "on every"]}, "gear": {"titles": [20], "defaults": ["7"], "keywords": ["gear"]}}'.replace("DEFAULTS", '", "'.join(str(i) for i in range(1, 90, 4)))
_LIVE = f"live as (select title, section, cast(section as bigint) as ord, lower(heading) as heading, unnest({_TOKENS % 'heading'}) as token from {{sections}} where not reserved), h as (select title, section, ord, heading, token, count(*) as nh from live group by all)"


def _scored(asked: str, tokens: str) -> str:
    """Every live section of the asked titles with its points. asked: (query_id, title, query, preferred)."""
    return f"""{_LIVE}, q as ({asked}), t as (select query_id, title, token, count(*) as nq from (select query_id, title, unnest({tokens}) as token from q) group by all),
 shared as (select query_id, title, section, ord, sum(least(nq, nh)) * 12 + sum(least(5.0, length(token) / 2)) as points from t join h using (title, token) group by all),
 every as (select q.query_id, q.title, s.section, cast(s.section as bigint) as ord, coalesce(points, 0) + case when contains(query, lower(s.heading)) or contains(lower(s.heading), query) then 20 else 0 end + case when list_contains(preferred, s.section) then 3 else 0 end as score
  from q join {{sections}} s on s.title = q.title and not s.reserved left join shared x on x.query_id = q.query_id and x.title = q.title and x.section = s.section),
 best as (select query_id, title, section, cast(score as double) as score from every qualify row_number() over (partition by query_id, title order by score desc, ord) = 1)"""


@query(f"with {_scored('select identifier as query_id, title, lower(heading) as query, []::varchar[] as preferred from {sections}', _TOKENS % 'query')} select query_id, title, section, score from best")
def jn2_best_section(sections):
    asked = sections.select(F.col("identifier").alias("query_id"), "title", F.col("heading").alias("query"))
    return headings.best_sections(asked, sections.withColumn("ord", F.col("section").cast("long"))).drop("candidates")


_PREFERRED = "list_transform(generate_series(1, 89, 4), lambda x: x::varchar)"
_COUNT = lambda p: f"(length(t) - length(replace(t, '{p}', ''))) // {len(p)}"
_POINTS = [("economy", 1, [3, 4], f"least(12, 3 * {_COUNT('economy')})"), ("widgets", 3, [11, 12], f"least(12, 3 * {_COUNT('widget')}) + least(12, 5 * {_COUNT('on every')})"), ("gear", 4, [20], f"least(12, 3 * {_COUNT('gear')})")]
_CHOICES = " union all ".join(f"select law_id, '{s}' as subject, {rank} as rank, {place} as place, {title} as title, {points} as points from said where {points} > 0 and {title} in (select title from {{sections}})" for s, rank, titles, points in _POINTS for place, title in enumerate(titles))
_LAWS = f"""said as (select law_id, lower(name || chr(10) || left(text, 12000)) as query, lower(name || chr(10) || text) as t, text from {{petitions}}),
 named as (select law_id, generate_subscripts(s, 1) as spot, unnest(s)::varchar as section, unnest(u)::int as title from (select law_id, regexp_extract_all(text, 'Section ([0-9]+) of title', 1) as s, regexp_extract_all(text, 'Section [0-9]+ of title ([0-9]+)', 1) as u from {{petitions}})),
 cites as (select law_id, title, section, count(*) as n, min(spot) as spot from named where (title, section) in (select title, section from {{sections}}) group by all),
 most as (select * from cites qualify row_number() over (partition by law_id order by n desc, spot, title, section) = 1),
 chosen as (select * from ({_CHOICES}) qualify row_number() over (partition by law_id order by points desc, rank, place) = 1)"""
_ASKED = f"select said.law_id as query_id, coalesce(c.title, 1) as title, query, case c.subject when 'economy' then {_PREFERRED} when 'gear' then ['7'] when 'widgets' then []::varchar[] else ['1'] end as preferred from said left join chosen c using (law_id) where law_id not in (select law_id from most)"


@query(f"""with {_LAWS}, {_scored(_ASKED, _TOKENS % 'query')} select law_id, title, section, 'cited' as branch, n::bigint as cited, null as subject, null::double as score from most
 union all select b.query_id, b.title, b.section, case when c.subject is null then 'general' else 'subject' end, 0, c.subject, b.score from best b left join chosen c on c.law_id = b.query_id""")
def jn3_choose_anchor(petitions, sections):
    spark = petitions.sparkSession
    rules = phrases.subject_rules(spark.createDataFrame([(CATALOGUE,)], "text string"))
    subjects = phrases.subjects(petitions, phrases.subject_phrases(rules), "law_id", "text", "name", top=100)
    pairs = F.arrays_zip(*[F.regexp_extract_all("text", F.lit("Section ([0-9]+) of title ([0-9]+)"), F.lit(k)).alias(n) for k, n in ((1, "s"), (2, "t"))])
    cited = petitions.select("law_id", F.posexplode(pairs).alias("ord", "c")).select("law_id", F.col("c.t").cast("int").alias("title"), F.col("c.s").alias("section"), "ord")
    return headings.anchors(petitions, cited, sections.withColumn("ord", F.col("section").cast("long")), subjects, rules).drop("candidates")
