"""Rule tables, phrase catalogues and decision tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phrases, rules
from .base import query


@query(r"""select config_id, lower(p_type) as subject, 0 as rank, case when p_size % 2 = 0 then p_size || ',54' else p_size::varchar end as titles, case when p_size % 3 = 0 then p_partkey::varchar else '' end as defaults,
 case when p_partkey % 7 = 0 then '' else p_name || ',' || p_brand end as keywords, p_size % 5 = 0 as non_code from {configs} join {part} on p_partkey = config_id where p_partkey % 13 <> 0
 union all select config_id, lower(p_brand), 1, '', '', p_name, false from {configs} join {part} on p_partkey = config_id where p_partkey % 13 <> 0""")
def src12_rule_tables(configs, part):
    rows = phrases.subject_rules(configs, source_cols=["config_id"])
    return rows.select("config_id", "subject", "rank", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("titles", "defaults", "keywords")], "non_code")


#: A catalogue as its file holds it; words that the documents have.
CATALOGUE = '{"licence": {"titles": [1], "keywords": ["license", "all rights reserved", "the"]}, "spanish": {"keywords": ["ción", "de la"]}, "english": {"keywords": ["the", "of the", "and", "in the", "to the"]}, "french": {"keywords": ["eau", "de la", "et le"]}, "german": {"keywords": ["heit", "und die", "der"]}, "junk": {"keywords": ["|", "$$$", "sign in"]}}'
_SUBJECTS = [("licence", 0, ["license", "all rights reserved", "the"]), ("spanish", 1, ["ción", "de la"]), ("english", 2, ["the", "of the", "and", "in the", "to the"]), ("french", 3, ["eau", "de la", "et le"]), ("german", 4, ["heit", "und die", "der"]), ("junk", 5, ["|", "$$$", "sign in"])]
_count = lambda p, t="t": f"(length({t}) - length(replace({t}, '{p}', ''))) // {len(p)}"
_subject = lambda words: " + ".join(f"least(12, {_count(w)} * {5 if ' ' in w else 3})" for w in words)
_EVERY = " union all ".join(f"select doc_id, '{s}' as subject, {rank} as place, {_subject(words)} as score from t" for s, rank, words in _SUBJECTS)


@query(f"with t as (select doc_id, lower(left(text, 16000)) as t from {{documents}}) select doc_id, subject, score::bigint as score, r::int as rank from (select *, row_number() over (partition by doc_id order by score desc, place) as r from ({_EVERY}) where score > 0) where r <= 4")
def ex3_subject_scores(documents):
    spark = documents.sparkSession
    catalogue = phrases.subject_phrases(phrases.subject_rules(spark.createDataFrame([(CATALOGUE,)], "text string")))
    return phrases.subjects(documents, catalogue, "doc_id", "text", top=4)


@query("""select law_id, coalesce(sum(least(12, n * 5)), 0)::bigint as score from (select law_id, (length(t) - length(replace(t, k, ''))) // length(k) as n from (select law_id, lower(text) as t from {acts}), (select distinct lower(p_type) as k from {part})) group by law_id""")
def ex3_catalogue_of_parts(acts, part):
    rows = part.select(F.lit("subject").alias("list"), F.lit("part").alias("category"), F.lit(0).alias("rank"), F.lower("p_type").alias("phrase"), F.lit(5).alias("weight"), F.lit(12).alias("most")).distinct()
    return phrases.found(acts, rows, ["law_id"]).select("law_id", phrases.of_list("subject").alias("score"))


_weighted = lambda ws: " + ".join(f"least(20, {_count(p)} * {w})" for p, w in ws)
_present = lambda ws: " + ".join(f"contains(t, '{p}')::int" for p in ws)
_ALL_NON_CODE = _present([p for _, ps in rules.NON_CODE for p in ps])


@query(f"select law_id, ({_weighted(rules.PERMANENT)})::bigint as permanent, ({_weighted(rules.TEMPORARY)})::bigint as temporary, (5 * ({_ALL_NON_CODE}))::bigint as non_code from (select law_id, lower(text) as t from {{acts}})")
def ex4_character_scores(acts):
    return phrases.characters(acts, phrases.built_in(acts.sparkSession), ["law_id"]).select("law_id", "permanent", "temporary", "non_code")


_MONEY = r"(regexp_matches(t, '\$\s*\d') or contains(t, 'fiscal year') or contains(t, 'appropriated, out of'))"
_CATEGORY = " ".join(f"when ({' or '.join(f'contains(t, {chr(39)}{p}{chr(39)})' for p in ps)}){f' and {_MONEY}' if c == 'appropriation' else ''} then '{c}'" for c, ps in rules.NON_CODE)
_EVIDENCE = " ".join(f"when category = '{c}' then array_to_string(list_slice(list_filter([{', '.join(chr(39) + p + chr(39) for p in ps)}], lambda p: contains(t, p)), 1, 5), ', ')" for c, ps in rules.NON_CODE)


@query(f"select law_id, category, case {_EVIDENCE} else '' end as evidence from (select *, case {_CATEGORY} else '' end as category from (select law_id, lower(text) as t from {{tempered}}))")
def ex5_non_code_category(tempered):
    return phrases.characters(tempered, phrases.built_in(tempered.sparkSession), ["law_id"]).select("law_id", "category", "evidence")


@query(f"select law_id, ({_present(rules.RIDER)}) >= 2 as rider, ({_present(rules.RESIDUAL)}) > 0 as residual from (select law_id, lower(text) as t from {{acts}})")
def ex6_permanent_rider(acts):
    return phrases.characters(acts, phrases.built_in(acts.sparkSession), ["law_id"]).select("law_id", "rider", "residual")


@query(f"select doc_id, n >= 2 as enough, n::bigint as n from (select doc_id, {_present([' the ', 'license', ' and ', 'all rights reserved', ' de la '])} as n from (select doc_id, lower(text) as t from {{documents}}))")
def ex24_source_gates(documents):
    spark = documents.sparkSession
    needed = spark.createDataFrame([("needed", "needed", 0, p, 1, 1) for p in (" the ", "license", " and ", "all rights reserved", " de la ")], phrases.RULES)
    return phrases.found(documents, needed, ["doc_id"]).select("doc_id", (phrases.of_list("needed", "n") >= 2).alias("enough"), phrases.of_list("needed", "n").alias("n"))
