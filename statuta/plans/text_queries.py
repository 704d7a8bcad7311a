"""Column functions and extraction over texts, pages and enactments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, rules
from .base import query

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(r"select doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(65279), ''), chr(160), ' '), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) as digest from {documents}")
def fn1_normalize_whitespace(documents):
    return documents.select("doc_id", F.sha2(T.normalize_whitespace(F.col("text")), 256).alias("digest"))


@query(r"select doc_id, length(regexp_replace(text, '[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}]', '', 'g')) as n from {documents}")
def fn2_clean_xml_text(documents):
    return documents.select("doc_id", F.length(T.clean_xml_text(F.col("text"))).cast("long").alias("n"))


_LAW = r"regexp_extract(name, '(?i)(?:Public\s+Law|Pub\.?\s*L\.?|P\.?L\.?)\s*(\d{1,3})\s*[-–—]\s*(\d{1,4})', %d)"
_LAW_ID = f"case when {_LAW % 1} <> '' then 'PL-' || lpad({_LAW % 1}, 3, '0') || '-' || (case when length({_LAW % 2}) >= 3 then {_LAW % 2} else lpad({_LAW % 2}, 3, '0') end) end"


@query(f"select card_id, {_LAW_ID} as law_id, try_cast({_LAW % 1} as int) as congress, try_cast({_LAW % 2} as int) as number from {{cards}}")
def fn3_law_number(cards):
    return cards.withColumn("l", T.extract_law_number(F.col("name"))).select("card_id", "l.law_id", "l.congress", "l.number")


@query("select card_id, try_cast(regexp_extract(law_id, 'PL-(\\d+)-(\\d+)', 1) as int) as congress, try_cast(regexp_extract(law_id, 'PL-(\\d+)-(\\d+)', 2) as int) as number from (select card_id, " + _LAW_ID + " as law_id from {cards})")
def fn4_parse_law_id(cards):
    laws = cards.withColumn("l", T.extract_law_number(F.col("name"))).withColumn("p", T.parse_law_id(F.col("l.law_id")))
    return laws.select("card_id", "p.congress", "p.number")


@query(r"""select card_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '(?i)(?:Public\s+Law|Pub\.?\s*L\.?|P\.?L\.?)\s*(\d{1,3})\s*[-–—]\s*(\d{1,4})', '', 'g'),
 '(?i)^\s*(?:P\.?L\.?\s*)?\d{1,3}\s*[-–—]\s*\d{1,4}\s*(?:[|:—-]\s*)?', ''), '^[\s|:–—-]+|[\s|:–—-]+$', '', 'g'), '\s+', ' ', 'g'), ''), trim(name)) as title from {cards}""")
def fn5_card_title(cards):
    return cards.select("card_id", T.title_from_card_name(F.col("name")).alias("title"))


@query(f"select token, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9''-]{{2,}}')) as token from {{documents}}) where token not in ({_STOP}) group by token".replace("{2,}", "{2,}"))
def fn6_token_counts(documents):
    return documents.select(F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("select doc_id, sha256(text) as digest from {documents}")
def fn7_sha256_text(documents):
    return documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("select identifier, 'rp-' || left(sha1(concat_ws('|', identifier, heading)), 20) as node_id from {sections}")
def fn8_deterministic_id(sections):
    return sections.select("identifier", T.deterministic_id(F.col("identifier"), F.col("heading")).alias("node_id"))


@query("select card_id, coalesce(nullif(trim(regexp_replace(name, '[^A-Za-z0-9._-]+', '-', 'g'), '-.'), ''), 'item') as slug from {cards}")
def fn9_safe_slug(cards):
    return cards.select("card_id", T.safe_slug(F.col("name")).alias("slug"))


@query("select doc_id, count(distinct w) as n_words from (select doc_id, unnest(string_split(text, ' ')) as w from {documents}) group by doc_id")
def fn10_distinct_words(documents):
    return documents.select("doc_id", F.size(F.array_distinct(F.split("text", " "))).cast("long").alias("n_words"))


_UNESCAPE = "replace(replace(replace(replace(replace(replace(%s, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(%s, chr(65279), ''), chr(160), ' '), '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]+', chr(10), 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query("select page_id, sha256(" + _NORMAL % (_UNESCAPE % "regexp_replace(html, '<[^>]+>', ' ', 'g')") + ") as digest from {pages}")
def fn11_strip_tags(pages):
    return pages.select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("digest"))


@query("select page_id, sha256(" + _UNESCAPE % r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?i)<br\s*/?>|</p>|</div>|</li>|</tr>|</h[0-9]>', chr(10), 'g'), '<[^>]+>', ' ', 'g')" + ") as digest from {pages}")
def fn12_html_to_text(pages):
    return pages.select("page_id", F.sha2(T.html_to_text(F.col("html")), 256).alias("digest"))


@query(r"select doc_key, seq, count(*) as n from (select doc_key, seq, unnest(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: trim(p)), lambda p: p <> '')) as p from {enactments}) group by doc_key, seq")
def fn14_paragraph_counts(enactments):
    return enactments.select("doc_key", "seq", F.explode(T.paragraphs(F.col("text")))).groupBy("doc_key", "seq").agg(F.count("*").alias("n"))


@query("select treatment, replace(lower(trim(treatment)), '-', '_') as dash, replace(replace(lower(trim(treatment)), '-', '_'), ' ', '_') as space, regexp_replace(lower(trim(treatment)), '[ -]+', '_', 'g') as runs, count(*) as n from {actions} group by treatment")
def fn16_normalize_text(actions):
    one = actions.groupBy("treatment").agg(F.count("*").alias("n"))
    return one.select("treatment", *[T.normalize_text(F.col("treatment"), m).alias(m) for m in ("dash", "space", "runs")], "n")


@query("select law_id, ord, coalesce(nullif(trim(treatment), ''), nullif(trim(status), ''), '') as said from {reviews}")
def fn17_first_nonempty(reviews):
    return reviews.select("law_id", "ord", T.first_nonempty(F.col("treatment"), F.col("status")).alias("said"))


@query("select identifier, lower(regexp_replace(identifier, '[^A-Za-z0-9]', '', 'g')) as key from {sections}")
def fn18_section_key(sections):
    return sections.select("identifier", T.section_key(F.col("identifier")).alias("key"))


@query(r"""select p_partkey, regexp_replace(replace(trim(string_split_regex(trim(said), '\s+')[1], '"''“”.,;:()[]'), '?', '-'), '(?i)(?:-(?:note|notes|prec|nt|new|et-seq|preceding|proposed|added))+$', '') as section
 from (select p_partkey, '(' || p_partkey || case p_partkey % 4 when 0 then '-note-new' when 1 then '?a' when 2 then '-Prec.' else ').' end || ' ' || p_name as said from {part})""")
def fn19_normalize_section(part):
    tail = F.when(F.col("p_partkey") % 4 == 0, "-note-new").when(F.col("p_partkey") % 4 == 1, "?a").when(F.col("p_partkey") % 4 == 2, "-Prec.").otherwise(").")
    said = F.concat(F.lit("("), F.col("p_partkey").cast("string"), tail, F.lit(" "), F.col("p_name"))
    return part.select("p_partkey", T.normalize_section(said).alias("section"))


@query(r"select doc_id, case when length(flat) <= 180 then flat else rtrim(left(flat, 179), ' .,;:') || '…' end as said from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat from {documents})")
def fn20_compact(documents):
    return documents.select("doc_id", T.compact(F.col("text"), 180).alias("said"))


@query("select law_id, congress || '–' || number as display, '/us/pl/' || congress || '/' || number as href, count(*) as n from (select law_id, cast(regexp_extract(law_id, 'PL-(\\d+)-(\\d+)', 1) as int) as congress, cast(regexp_extract(law_id, 'PL-(\\d+)-(\\d+)', 2) as int) as number from {enactments}) group by all")
def fn21_law_display(enactments):
    return enactments.groupBy("law_id").agg(F.count("*").alias("n")).select("law_id", T.law_display(F.col("law_id")).alias("display"), T.law_href(F.col("law_id")).alias("href"), "n")


_T, _S = (f"regexp_extract(identifier, '^/us/usc/t([0-9A-Za-z]+)/s([^/]+)', {i})" for i in (1, 2))
_PIN = "regexp_extract(identifier, '^/us/usc/t[0-9A-Za-z]+/s[^/]+/(.*)$', 1)"


@query(f"select action_id, ord, 'https://example.test/cite/' || {_T} || '/' || {_S} || '/' as url, {_T} || ' U.S.C. § ' || {_S} || case when {_PIN} = '' then '' else '(' || replace({_PIN}, '/', ')(') || ')' end as citation, replace({_PIN}, '/', '.') as pinpoint, 'usc' || (case when length({_T}) < 2 then lpad({_T}, 2, '0') else {_T} end) || '.xml' as file from {{actions}}")
def fn22_citations_of_targets(actions):
    c = F.col("identifier")
    return actions.select("action_id", "ord", T.citation_url(c).alias("url"), T.citation(c).alias("citation"), T.pinpoint(c).alias("pinpoint"), T.xml_file_for(c).alias("file"))


@query(r"select page_id, nullif(regexp_extract(url, '[?&]p=([^&#]*)', 1), '') as pin, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page, coalesce(nullif(regexp_extract(url, '[?&]title=([^&#]*)', 1), ''), nullif(regexp_extract(url, '/cite/([^/?#]+)/([^/?#]+)', 1), '')) as title from {pages}")
def fn25_citation_route(pages):
    r = T.route(F.col("url"))
    return pages.select("page_id", r["pin"].alias("pin"), F.nullif(F.regexp_extract("url", "[?&]page=([^&#]*)", 1), F.lit("")).alias("page"), r["title"].alias("title"))


@query("select identifier, section as label, case when regexp_matches(trim(heading), '[.!?]$') then trim(heading) else trim(heading) || '.' end as heading from (select identifier, heading, section from {sections})")
def fn26_section_labels(sections):
    number = F.concat(F.lit("[§ "), F.col("section"), F.lit("."))
    return sections.select("identifier", T.section_label(number).alias("label"), T.heading_label(F.col("heading")).alias("heading"))


@query("select card_id, ordinal, part_no, name, coalesce(nullif(lower(regexp_extract(url, '(\\.[A-Za-z0-9]+)$', 1)), ''), '.bin') as kind from {attachments}")
def fn27_file_kind(attachments):
    return attachments.select("card_id", "ordinal", "part_no", "name", T.file_kind(F.col("url"), F.lit(""), F.lit("")).alias("kind"))


@query("""select doc_id, spot, (case when lo > 1 then '…' else '' end) || substring(text, lo, hi - lo + 1) || (case when hi < length(text) then '…' else '' end) as snippet
 from (select *, greatest(spot - 160, 1) as lo, least(spot + 5 + 160 - 1, length(text)) as hi from (select doc_id, text, cast(instr(lower(text), ' and ') as int) as spot from {documents}) where spot > 0)""")
def fn29_snippet(documents):
    hit = documents.withColumn("spot", F.instr(F.lower("text"), F.lit(" and "))).where("spot > 0")
    return hit.select("doc_id", "spot", T.snippet(F.col("text"), F.col("spot"), F.lit(5)).alias("snippet"))


@query("select node_id, regexp_matches(node_id, '^[A-Za-z_][A-Za-z0-9_.-]*$') and not ends_with(node_id, '.xml') as valid, starts_with(node_id, 'rp-') as own, count(*) as n from {results} group by node_id")
def fn31_node_id(results):
    one = results.groupBy("node_id").agg(F.count("*").alias("n"))
    return one.select("node_id", T.valid_node_id(F.col("node_id")).alias("valid"), F.col("node_id").startswith("rp-").alias("own"), "n")


@query(r"select doc_id, case when length(flat) <= 420 then flat else rtrim(left(flat, 417)) || '...' end as said from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat from {documents})")
def fn33_excerpt(documents):
    return documents.select("doc_id", T.excerpt(F.col("text")).alias("said"))


@query(r"select distinct doc_key, cast(regexp_extract(text, '(?i)sections?\s+([0-9A-Za-z][0-9A-Za-z.\-]*)\s+of\s+title\s+(\d{1,2})', 2) as int) as title, rtrim(regexp_extract(text, '(?i)sections?\s+([0-9A-Za-z][0-9A-Za-z.\-]*)\s+of\s+title\s+(\d{1,2})', 1), '.,;:)') as section from {enactments}")
def ex1_citations(enactments):
    return extract.citations(enactments, "doc_key", "text")


@query("""select distinct law_id, named as target, r.relation, r.confidence from {citings} join (values (0, 'repeals', 'high'), (1, 'amends', 'medium'), (2, 'supersedes', 'high'), (3, 'overrides', 'medium'), (4, 'repeals', 'high'), (5, 'references', 'low'), (6, 'references', 'low'), (7, 'repeals', 'high'), (8, 'supersedes', 'high')) as r(form, relation, confidence) using (form) where law_id <> named""")
def ex2_dependencies(citings):
    return extract.dependencies(citings, "law_id", "text").drop("context")


@query(r"""select distinct doc_key, regexp_extract(text, 'striking "(.*?)" and inserting "(.*?)"', 1) as old_text, regexp_extract(text, 'striking "(.*?)" and inserting "(.*?)"', 2) as new_text from {enactments} where regexp_matches(text, 'striking "(.*?)" and inserting')""")
def ex9_strike_inserts(enactments):
    return extract.strike_inserts(enactments, "doc_key", "text")


_TAGS = ", ".join(f"case when regexp_matches(lower(text), '{p}') then '{n}' end" for n, p in extract.OPERATIVE)


@query(f"select tags, count(*) as n from (select array_to_string(list_sort(list_filter([{_TAGS}], lambda x: x is not null)), ',') as tags from {{enactments}}) group by tags")
def ex13_operative_tags(enactments):
    return enactments.select(F.array_join(extract.operative_tags(F.col("text")), ",").alias("tags")).groupBy("tags").agg(F.count("*").alias("n"))


@query(r"select doc_id, n, trim(line) as line from (select doc_id, generate_subscripts(l, 1) as n, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from {documents})) where regexp_matches(line, '(?i)licen[sc]e') and regexp_matches(line, '(?i)under')")
def ex19_license_lines(documents):
    return extract.line_filter(documents, "doc_id", "text", "(?i)licen[sc]e", "(?i)under").select("doc_id", F.col("n").cast("long").alias("n"), "line")


@query("select doc_id, count(distinct w) < 20 as low_variety, min(debris) as debris from (select doc_id, unnest(string_split(text, ' ')) as w, regexp_matches(left(text, 1000), '(?i)sign in|access denied|<html') as debris from {documents}) group by doc_id")
def ex25_debris(documents):
    return documents.select("doc_id", (F.size(F.array_distinct(F.split("text", " "))) < 20).alias("low_variety"), F.left("text", F.lit(1000)).rlike("(?i)sign in|access denied|<html").alias("debris"))


@query("select page_id, href, count(*) as n from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as href from {pages}) group by page_id, href")
def ex27_links(pages):
    return extract.links(pages).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(r"select law_id, count(*) as n from {enactments} where regexp_matches(text, 'Public Law 7-') group by law_id")
def ex28_mentions_in_texts(enactments):
    return enactments.where(F.col("text").rlike("Public Law 7-")).groupBy("law_id").agg(F.count("*").alias("n"))


@query("""select doc_id, cast(length(text) - length(replace(text, chr(65533), '')) as bigint) as replaced, cast((length(text) - length(replace(text, 'Ã©', ''))) / 2 as bigint) as mojibake, cast(length(text) - length(replace(text, '?', '')) as bigint) as question from {documents}""")
def ag6_encoding_audit(documents):
    t = F.col("text")
    n = lambda s: T.count_text(t, F.lit(s)).cast("long")
    return documents.select("doc_id", n("�").alias("replaced"), n("Ã©").alias("mojibake"), n("?").alias("question"))


@query("select doc_id, cast(instr(lower(text), ' the ') as bigint) as spot from {documents} where instr(lower(text), ' the ') > 0")
def fl6_keyword_search(documents):
    return documents.select("doc_id", F.instr(F.lower("text"), F.lit(" the ")).cast("long").alias("spot")).where("spot > 0")
