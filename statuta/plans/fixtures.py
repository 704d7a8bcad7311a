"""Tables shaped like boards, enactments, statute sections and ledgers, derived from the given tables.

Each is one SQL text that Spark and DuckDB both run; `{name}` stands for a given table or another of
these, so its rows grow with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    "cards": """
select concat('c', cast(o_orderkey as varchar(20))) as card_id,
       concat(case when o_orderkey % 20 = 7 then '' when o_orderkey % 3 = 0 then 'Pub. L. ' else 'Public Law ' end,
              case when o_orderkey % 20 = 7 then '' else concat(cast(1 + o_custkey % 50 as varchar(20)), '-', cast(1 + o_orderkey % 100 as varchar(20)), ' | ') end,
              c_mktsegment, ' Act ', cast(o_custkey as varchar(20))) as name,
       case o_orderstatus when 'F' then 'Active Public Laws' when 'O' then 'Congress Archive' else 'Repealed Laws' end as list_name,
       o_orderpriority as label,
       cast(o_orderdate as date) as last_activity,
       concat('Status: ', case when o_orderkey % 17 = 0 then 'expired' else 'current' end, '. See https://example.test/doc/', cast(o_orderkey as varchar(20)), '.pdf, for text.') as description
from {orders} join {customer} on c_custkey = o_custkey""",
    "attachments": """
select concat('c', cast(l_orderkey as varchar(20))) as card_id, cast(l_linenumber as bigint) as ordinal,
       concat('https://example.test/', cast(l_partkey % 50 as varchar(20)), case when l_partkey % 3 = 0 then '.txt' when l_partkey % 3 = 1 then '.pdf' else '.png' end) as url,
       concat(case l_returnflag when 'A' then 'Signed ' when 'N' then 'Draft ' else 'Final ' end, case l_linestatus when 'O' then 'bill' else 'act image' end) as name,
       cast(l_shipdate as date) as added,
       case when l_linenumber % 2 = 0 then 'board' else 'action' end as source, l_suppkey as part_no
from {lineitem}""",
    "enactments": """
select concat('PL-', lpad(cast(1 + l_suppkey % 50 as varchar(20)), 3, '0'), '-', lpad(cast(1 + l_orderkey % 999 as varchar(20)), 3, '0')) as law_id,
       l_orderkey as doc_key, l_linenumber as seq,
       concat('Be it enacted. Section ', cast(case when l_orderkey % 5 = 0 then l_partkey + 1000000 else l_partkey end as varchar(20)),
              ' of title ', cast(p_size as varchar(20)), ', United States Code, is ',
              case l_linenumber % 3 when 0 then 'repealed. ' when 1 then concat('amended by striking "', lower(p_type), '" and inserting "', lower(p_type), ' ', lower(p_brand), '". ')
                   else 'amended to read as follows: "New text." ' end,
              case when l_returnflag = 'R' then concat('Public Law ', cast(1 + l_partkey % 50 as varchar(20)), '-', cast(1 + l_suppkey % 999 as varchar(20)), ' is hereby repealed. ') else '' end,
              case when l_returnflag = 'N' then 'There is appropriated, out of the Treasury, for fiscal year 2026. ' else 'There is established an office. The office shall report. ' end) as text
from {lineitem} join {part} on p_partkey = l_partkey""",
    "sections": """
select p_size as title, cast(p_partkey as varchar(20)) as section,
       concat('/us/usc/t', cast(p_size as varchar(20)), '/s', cast(p_partkey as varchar(20))) as identifier,
       p_name as heading, p_partkey % 40 = 0 as reserved,
       concat('A ', lower(p_type), ' item shall be kept', case when p_partkey % 7 = 0 then concat(' with another ', lower(p_type)) else '' end, '.') as body
from {part}""",
    "actions": """
select concat('ACTION-', cast(l_orderkey * 10 + l_linenumber as varchar(20))) as action_id,
       concat('PL-', lpad(cast(1 + l_suppkey % 50 as varchar(20)), 3, '0'), '-', lpad(cast(1 + l_orderkey % 999 as varchar(20)), 3, '0')) as law_id,
       case l_returnflag when 'A' then 'amendment' when 'N' then 'statutory_note' else 'repeal' end as action_type,
       case concat(l_returnflag, l_linestatus) when 'AF' then 'direct amendment' when 'NO' then 'Note Only' when 'NF' then 'new-section' else 'no_code_action' end as treatment,
       concat('/us/usc/t', cast(1 + l_suppkey % 54 as varchar(20)), '/s', cast(l_partkey as varchar(20)), case when l_linenumber % 4 = 0 then '/a/1' else '' end) as identifier,
       case when l_linenumber % 5 = 0 then '' else concat('Provision ', cast(l_linenumber as varchar(20))) end as evidence,
       l_linenumber as ord
from {lineitem}""",
    "results": """
select concat('ACTION-', cast(l_orderkey * 10 + l_linenumber as varchar(20))) as action_id,
       case l_returnflag when 'A' then 'applied' when 'N' then 'documented-no-code-action' else 'superseded-by-later-action' end as result_status,
       concat('rp-', left(sha1(concat(cast(l_partkey as varchar(20)), '|', cast(l_suppkey as varchar(20)))), 20)) as node_id
from {lineitem}""",
    "reviews": """
select concat('PL-', lpad(cast(1 + user_id % 50 as varchar(20)), 3, '0'), '-001') as law_id,
       cast(event_id % 40 as int) as group_index, event_id as ord,
       case event_type when 'error' then 'incomplete' when 'signup' then 'schema-invalid' else 'valid' end as status,
       case when value > 10 then 'note-only' when value > 5 then 'new-section' else '' end as treatment
from {events}""",
    "bills": """
select distinct concat('B', cast(l_orderkey as varchar(20)), '.', cast(l_linenumber as varchar(20)), '.', cast(l_partkey as varchar(20)), '.', cast(l_suppkey as varchar(20))) as law_id,
  concat('SEC. 1. SHORT TITLE. The ', lower(p_type), ' Act.', chr(10),
         'SEC. 2. RULES. Chapter ', cast(l_suppkey % 10 as varchar(20)), ' of title ', cast(p_size as varchar(20)), ', United States Code, is amended by adding at the end the following:', chr(10),
         '"§ ', cast(case when l_orderkey % 4 = 0 then l_partkey else l_partkey + 1000000 end as varchar(20)), '. ', p_name, chr(10),
         'An agency shall keep a list of every ', lower(p_type), ' and of its makers, and shall print it on the first working day of each year.".', chr(10),
         'SEC. 3. EDITS. Section ', cast(case when l_orderkey % 5 = 0 then l_partkey + 1000000 else l_partkey end as varchar(20)), case when l_linenumber % 2 = 0 then '(b)' else '' end,
         ' of title ', cast(p_size as varchar(20)), ', United States Code, ', case when l_orderkey % 7 = 2 then 'subsection (c), which concerns the lists, is ' else 'which concerns the lists of items that an agency keeps, is ' end,
         case l_linenumber % 3 when 0 then 'hereby repealed.'
              when 1 then concat('amended to read as follows: "§ ', cast(l_partkey as varchar(20)), '. ', p_name, chr(10), 'A list shall name every ', lower(p_type), ', its makers, its sellers and the year of its making.".')
              else concat('amended by adding at the end the following: "(z) ', p_name, '.".') end, chr(10),
         'SEC. 4. LAWS. Public Law ', cast(1 + l_partkey % 50 as varchar(20)), '-', cast(1 + l_suppkey % 999 as varchar(20)),
         case l_orderkey % 3 when 0 then ' shall be postponed.' when 1 then ' is reauthorized.' else ' stays.' end) as text
from {lineitem} join {part} on p_partkey = l_partkey""",
    "citings": """
select concat('PL-', lpad(cast(1 + l_suppkey % 50 as varchar(20)), 3, '0'), '-', lpad(cast(1 + l_orderkey % 999 as varchar(20)), 3, '0')) as law_id,
       concat('PL-', lpad(cast(1 + l_partkey % 50 as varchar(20)), 3, '0'), '-', lpad(cast(1 + l_suppkey % 999 as varchar(20)), 3, '0')) as named, (l_linenumber + l_partkey) % 9 as form,
       concat('An agency shall keep a list of every item. ',
              case (l_linenumber + l_partkey) % 9 when 1 then 'This Act amends ' when 2 then 'A rule that supersedes ' when 3 then 'Notwithstanding any provision of ' when 4 then 'Repealing all the provisions of '
                   when 5 then 'No provision of ' when 6 then 'An amendment to a rule under ' else '' end,
              'Public Law ', cast(1 + l_partkey % 50 as varchar(20)), '-', cast(1 + l_suppkey % 999 as varchar(20)),
              case (l_linenumber + l_partkey) % 9 when 0 then ' is hereby repealed.' when 5 then ' shall be read to repeal another act.' when 7 then ', and is hereby  repealed.' when 8 then ' are superseded.' else ' stands.' end) as text
from {lineitem}""",
    "treated": """
select p_partkey as provision_id,
       case p_partkey % 24 when 0 then 'new-section' when 1 then 'New Subsection' when 2 then 'amend existing text' when 3 then 'repeal-marking' when 4 then 'redesignation' when 5 then 'transfer' when 6 then 'substitution'
            when 7 then 'statutory note' when 8 then 'statutory-note-only' when 9 then 'note-only' when 10 then 'historical-note-only' when 11 then 'historical-note' when 12 then 'history-only' when 13 then 'source-limited-historical-note'
            when 14 then 'amendment-note' when 15 then 'effective-date-note' when 16 then 'savings-note' when 17 then 'transfer-note' when 18 then 'exclude-from-code' when 19 then 'already-incorporated' when 20 then ' Transfer ' else 'other' end as treatment,
       case p_size % 5 when 0 then 'new-permanent-general' when 1 then 'short-title' when 2 then 'effective-date' when 3 then 'findings-or-sense' else 'temporary' end as class,
       concat(case p_size % 3 when 0 then 'Definitions of a ' when 1 then 'The purpose of a ' else 'Rules on a ' end, lower(p_type)) as summary
from {part}""",
    "operations": """
select distinct concat('O', cast(l_orderkey as varchar(20)), '.', cast(l_linenumber as varchar(20)), '.', cast(l_partkey as varchar(20)), '.', cast(l_suppkey as varchar(20))) as op_id, l_linenumber as op_no,
       concat('PL-', lpad(cast(1 + l_suppkey % 50 as varchar(20)), 3, '0'), '-', lpad(cast(1 + l_orderkey % 999 as varchar(20)), 3, '0')) as law_id, (1 + l_suppkey % 50) * 10000 + 1 + l_orderkey % 999 as law_order,
       concat('/us/usc/t', cast(p_size as varchar(20)), '/s', cast(p_partkey as varchar(20)), case when (l_orderkey + l_linenumber) % 8 = 4 or l_orderkey % 5 = 0 then '/n' else '' end) as identifier,
       case when l_orderkey % 13 = 0 then null else p_size end as title,
       case (l_orderkey + l_linenumber) % 8 when 0 then 'STRIKE_INSERT' when 1 then 'APPEND_TEXT' when 2 then 'REPEAL_SECTION' when 3 then 'REPLACE_SECTION' when 4 then 'ADD_NEW_SECTION' when 5 then 'STATUTORY_NOTE' when 6 then 'STRIKE_INSERT' else 'MOVE' end as kind,
       case when l_linenumber % 2 = 0 then 'kept' else lower(p_type) end as old_text,
       concat('A list of ', lower(p_type), ' shall be kept by ', cast(l_suppkey as varchar(20))) as new_text, concat('M', cast(l_suppkey % 5 as varchar(20))) as marker,
       case when l_suppkey % 3 = 0 then 'medium' else 'high' end as confidence
from {lineitem} join {part} on p_partkey = l_partkey""",
    "acts": """
select distinct concat('B', cast(l_orderkey as varchar(20)), '.', cast(l_linenumber as varchar(20)), '.', cast(l_partkey as varchar(20)), '.', cast(l_suppkey as varchar(20))) as law_id,
  (l_orderkey + l_linenumber) % 11 as form, l_partkey % 4 as variant, case when l_suppkey % 13 = 3 then 'A commemorative act' else p_name end as name, p_size as title, cast(case when l_orderkey % 5 = 0 then l_partkey + 1000000 else l_partkey end as varchar(20)) as section,
  case when l_suppkey % 11 = 0 then 'repealed' when l_suppkey % 11 = 1 then 'pending' else 'active' end as status, l_orderkey % 10 = 3 as incorporated,
  case when (l_orderkey + l_linenumber) % 11 = 8 and l_partkey % 4 = 0 then '' else concat('An Act on every ', lower(p_type), '. ',
    case (l_orderkey + l_linenumber) % 11
      when 0 then concat('Section ', cast(case when l_orderkey % 5 = 0 then l_partkey + 1000000 else l_partkey end as varchar(20)), ' of title ', cast(p_size as varchar(20)), ', United States Code, is hereby repealed.')
      when 1 then concat('Section ', cast(case when l_orderkey % 5 = 0 then l_partkey + 1000000 else l_partkey end as varchar(20)), ' of title ', cast(p_size as varchar(20)), ', United States Code, is amended by adding at the end the following: "(z) A list shall be kept.".')
      when 2 then 'There is established an office. The office shall report.'
      when 3 then 'There is appropriated, out of the Treasury, a sum for fiscal year 2026.'
      when 4 then 'A commemorative coin shall be struck.'
      when 5 then 'An act for the relief of a maker.'
      when 6 then 'This temporary act shall expire in one year, and the temporary office shall terminate within 90 days of the expiration of this temporary act.'
      when 7 then concat('Section ', cast(case when l_orderkey % 5 = 0 then l_partkey + 1000000 else l_partkey end as varchar(20)), ' of title ', cast(p_size as varchar(20)), ', United States Code, is hereby repealed. There is appropriated, out of the Treasury, a sum for fiscal year 2026.')
      when 9 then concat('Section ', cast(case when l_orderkey % 5 = 0 then l_partkey + 1000000 else l_partkey end as varchar(20)), ' of title ', cast(p_size as varchar(20)), ', United States Code, is amended by striking "old item" and inserting "new item".')
      when 10 then concat('Section ', cast(case when l_orderkey % 5 = 0 then l_partkey + 1000000 else l_partkey end as varchar(20)), '(b) of title ', cast(p_size as varchar(20)), ', United States Code, is amended by striking “one” and inserting in lieu thereof “two”, by striking "one" and inserting "two", and by striking "" and inserting "x".')
      else 'There is appropriated, out of the Treasury, a sum for fiscal year 2026. There is established an office, and no person may not report.' end,
    case l_partkey % 4 when 1 then ' The agency shall issue regulations.' else '' end) end as text
from {lineitem} join {part} on p_partkey = l_partkey""",
    "tempered": """
select p_partkey as law_id, concat('An Act on every ', lower(p_type), '. ',
  case p_partkey % 20 when 0 then 'A constitutional amendment is proposed.' when 1 then 'A supplemental appropriation of $ 500 is made.' when 2 then 'A supplemental appropriation is made.' when 3 then 'The sum is appropriated, out of the Treasury.'
    when 4 then 'A commemorative coin and a Congressional Gold Medal.' when 5 then 'The confirmation of a judge.' when 6 then 'Consent to ratification is given.' when 7 then 'An act for the relief of a maker, a private law.'
    when 8 then 'The Rules of the House are set.' when 9 then 'A single payment is made.' when 10 then 'A continuing resolution for fiscal year 2026, which shall remain available until expended.'
    when 11 then 'A continuing resolution and a commendation.' when 12 then 'A nomination of a judge for the relief of a maker.' else 'An agency shall keep a list.' end) as text
from {part}""",
    "drafts": """
select p_partkey as provision_id,
       case p_partkey % 9 when 0 then 'short-title' when 1 then 'effective-date' when 5 then 'findings-or-sense,new-permanent-general' when 6 then '' when 7 then 'direct-amendment' when 8 then 'new-permanent-general,effective-date' else 'new-permanent-general' end as classes,
       case p_size % 4 when 0 then 'effective-date' when 1 then 'new-permanent-general' when 2 then 'short-title,effective-date' else '' end as source_classes,
       case p_partkey % 5 when 0 then 'Definitions of an item' when 1 then 'The PURPOSE of an item' when 2 then '' else p_name end as summary, case when p_partkey % 2 = 0 then 'A definition' else 'A rule' end as source_summary,
       case when p_partkey % 4 = 0 then '' else 'own-treatment' end as treatment, case when p_partkey % 7 < 3 then concat('s', cast(p_partkey as varchar(20))) else '' end as target, case when p_partkey % 11 < 4 then p_brand else '' end as source_target,
       case when p_partkey % 6 = 0 then concat('change to ', p_name) else '' end as exact_change, case when p_partkey % 13 = 1 then 'source change' else '' end as source_change,
       case p_size % 6 when 0 then 'Repealed' when 1 then 'fully-repealed' when 2 then 'historical-note-only' else 'active' end as law_status,
       case p_size % 11 when 0 then 'operative-text-required' when 1 then 'Amend-existing-text' when 2 then 'new-section' when 3 then 'new-subsection' when 4 then 'repeal-marking' when 5 then 'transfer' when 6 then 'redesignation' when 7 then 'substitution' when 8 then '' else 'note-only' end as law_treatment,
       case when p_partkey % 3 = 0 then 'title 28' else '' end as law_target, case when p_partkey % 8 = 3 then 'by command' else '' end as law_command, case when p_partkey % 10 = 4 then 'by review' else '' end as law_change
from {part}""",
    "report_laws": """
select 1 + o_custkey % 40 as idx, o_orderkey as ord, case when o_orderkey % 97 = 5 then '' else concat('PL-', lpad(cast(1 + o_orderkey % 300 as varchar(20)), 3, '0'), '-', lpad(cast(1 + o_custkey % 40 as varchar(20)), 3, '0')) end as law_id,
       not (o_orderkey % 401 = 7) as is_object,
       case when o_custkey % 4 = 1 then 'active' when o_orderkey % 37 = 0 then '' when o_orderkey % 37 = 1 then 'N-A' when o_orderkey % 37 = 2 then 'Unknown' when o_orderkey % 37 = 3 then 'unresolved' when o_orderkey % 37 = 4 then 'source defect-unresolved'
            when o_orderkey % 37 = 5 and o_custkey % 3 = 0 then 'source unavailable' when o_orderkey % 37 = 6 and o_custkey % 3 = 1 then 'unsupported-source' when o_orderkey % 37 = 7 then 'operative-text-required-but-target-unresolved' else 'active' end as status,
       case when o_custkey % 4 <> 1 and o_orderkey % 29 = 1 then '' else 'by date' end as chronology, case when o_custkey % 4 <> 1 and o_orderkey % 31 = 2 then ' ' else 'note' end as treatment, case when o_custkey % 4 <> 1 and o_orderkey % 41 = 3 then '' else 'keep' end as recommendation,
       case when o_custkey % 4 <> 1 and o_orderkey % 43 = 4 then '' else 'page 1' end as evidence, case when o_custkey % 4 <> 1 and o_orderkey % 47 = 5 then '' else 'same' end as comparison, case when o_custkey % 4 <> 1 and o_orderkey % 53 = 6 then '' else 'high' end as confidence
from {orders}""",
    "report_provisions": """
select 1 + o_custkey % 40 as idx, o_orderkey as ord, not (o_custkey % 4 = 2 and l_partkey % 211 = 9) as is_object,
       case when o_custkey % 4 = 1 then 'short-title' else case l_partkey % 8 when 0 then 'direct-amendment' when 1 then 'repeal' when 2 then 'transfer,short-title' when 3 then 'redesignation' when 4 then 'new-permanent-general' when 5 then 'substitution' when 6 then '' else 'short-title' end end as classes,
       case when o_custkey % 4 = 1 then 'note' when l_suppkey % 5 = 0 then '' when l_suppkey % 5 = 1 then 'Statutory-note' when l_suppkey % 5 = 2 then 'historical preservation' else 'new-section' end as treatment,
       case when l_partkey % 3 = 0 then '' else 's1' end as target, case when o_custkey % 4 <> 1 and l_partkey % 17 = 0 then '' else 'page 2' end as evidence, case when l_partkey % 7 = 0 then '' else 'strike' end as change
from {lineitem} join {orders} on o_orderkey = l_orderkey""",
    "manifest_laws": """
select 1 + o_custkey % 40 as idx, concat('PL-', lpad(cast(1 + o_orderkey % 300 as varchar(20)), 3, '0'), '-', lpad(cast(1 + o_custkey % 40 as varchar(20)), 3, '0')) as law_id
from {orders} where not (o_custkey % 8 = 3 and o_orderkey % 19 = 0) and o_orderkey % 97 <> 5 and o_orderkey % 401 <> 7 group by 1, 2
union all select 1 + o_custkey % 40, concat('PL-900-', cast(min(o_orderkey) as varchar(20))) from {orders} where o_custkey % 8 = 7 group by 1""",
    "reports": """
select 1 + o_custkey % 40 as idx, case when 1 + o_custkey % 40 = 14 then 0 else count(*) end as law_count, case when 1 + o_custkey % 40 = 18 then 'same' else 'report' end as digest from {orders} where 1 + o_custkey % 40 <> 7 group by 1
union all select 90, 0, 'report' from {orders} group by 1, 2, 3""",
    "manifests": """
select 1 + o_custkey % 40 as idx, count(*) as law_count, case when 1 + o_custkey % 40 = 18 then 'same' else 'manifest' end as digest from {orders} where 1 + o_custkey % 40 <> 9 group by 1
union all select 91, 0, 'manifest' from {orders} group by 1, 2, 3""",
    "outlines": """
select p_partkey as act_id, p_partkey % 7 as variant, case p_partkey % 5 when 0 then '' when 1 then '1' when 2 then '1,2' when 3 then '2,1' else '2,9' end as wanted, p_name as said,
  case p_partkey % 7
    when 0 then concat('An Act', chr(10), 'SEC. 1. Title', chr(10), 'On ', p_name, chr(10), 'SEC. 2. Rules', chr(10), 'Body two')
    when 1 then concat('Section I - Title', chr(10), 'On ', p_name, chr(10), chr(10), '§ 2. Rules', chr(10), 'Body two', chr(10))
    when 2 then concat('SEC. 1. Title', chr(10), 'x', chr(10), 'SEC. 1. Title again', chr(10), 'On ', p_name, chr(10), 'SEC 3: Other', chr(10), 'Body three')
    when 3 then concat('Just text on ', p_name, ' of sec. 1. of an act')
    when 4 then concat('  sec. ii. Rules', chr(10), 'Body two', chr(10), 'SECTION 1.', chr(10), chr(10), 'On ', p_name, chr(10))
    when 5 then ''
    else concat('SEC. IX. Ninth', chr(10), 'Body nine', chr(10), 'SEC. 2) Rules', chr(10), 'Body two', chr(10), 'SEC. 2A. More', chr(10), p_name) end as text
from {part}""",
    "bodies": """
select p_partkey as act_id, p_partkey % 5 as variant,
  case p_partkey % 5
    when 0 then concat('Lead', chr(10), chr(10), '(a) A one', chr(10), 'goes on', chr(10), chr(10), '(1) n one', chr(10), chr(10), '(2) n two', chr(10), chr(10), 'more', chr(10), chr(10), '(b) ', p_name)
    when 1 then concat('(g) x', chr(10), chr(10), '(h) y', chr(10), ' ', chr(10), '(i) z', chr(10), chr(10), '(j) ', p_name)
    when 2 then concat('(h) y', chr(10), chr(10), '(i) one', chr(10), chr(10), '(ii) two', chr(10), chr(10), '(i) ', p_name)
    when 3 then concat('(a) x', chr(10), chr(10), '(1) y', chr(10), chr(10), '(A) z', chr(10), chr(10), '(i) r', chr(10), chr(10), '(I) R', chr(10), chr(10), '(II) S', chr(10), chr(10), '(B) t', chr(10), chr(10), '(2) ', p_name)
    else '' end as text
from {part}""",
    "petitions": """
select p_partkey as law_id, case when p_partkey % 3 = 0 then p_name else 'An Act' end as name,
       concat('On every ', lower(p_type), ' ', p_name, ' and bolt. ', case when p_partkey % 5 = 0 then concat('Section ', cast(p_partkey as varchar(20)), ' of title ', cast(p_size as varchar(20)), ' and Section ', cast(p_partkey as varchar(20)), ' of title ', cast(p_size as varchar(20)), ' and Section 1 of title 1.')
         when p_partkey % 5 = 1 then 'Section 99999999 of title 2 stays.' when p_partkey % 5 = 2 and p_partkey % 2 = 0 then 'A rule for promo and economy goods.' else 'No section is named.' end) as text
from {part}""",
    "sourced": """
select concat('PL-', cast(p_partkey as varchar(20))) as law_id, 1 + p_partkey % 50 as congress, p_partkey as number, concat(p_name, ' keeping act on every ', lower(p_type), ' ', p_name) as title, case when p_partkey % 9 = 0 then 'repealed' else 'active' end as status,
  concat('https://example.test/c/', cast(p_partkey as varchar(20))) as url, p_partkey % 8 as variant,
  case p_partkey % 8 when 0 then 'A note.' when 1 then concat('Public Law ', cast(1 + p_partkey % 50 as varchar(20)), '-', cast(p_partkey as varchar(20)), '. Be it enacted, that the office shall keep a list, and that each maker shall send it one in a month.')
    when 2 then concat('SEC. 1. SHORT TITLE. The ', p_name, ' act.', chr(10), 'SEC. 2. Effective date. ', repeat('An office keeps all lists of items that its makers and sellers send in each month of the year. ', 6))
    when 3 then repeat('A synopsis of what the act on every item would do for makers and sellers in the coming years. ', 3) when 4 then 'Access denied. Please sign in to read this page, as it is not open to the public, and javascript is disabled in your browser at this time.'
    when 5 then repeat('word ', 60) when 6 then concat('PL ', cast(1 + p_partkey % 50 as varchar(20)), '-', cast(p_partkey as varchar(20)), ' ', repeat('Section 1 of the United States Code on which all offices rely for lists of makers and sellers and what they send. ', 5))
    else concat('Be it enacted. ', repeat('There is established an office of lists that makers, sellers, agents and others may not leave out or alter in any way at all. ', 3)) end as description
from {part}""",
    "alternates": """
select concat('PL-', cast(p_partkey as varchar(20))) as law_id, concat('d', cast(p_partkey as varchar(20))) as card_id, case when p_partkey % 4 = 0 then null else concat('Old ', p_name) end as card_name, 'https://example.test/d' as url,
  case when p_partkey % 3 = 0 then 'short' else concat('Be it enacted. Pub. L. ', cast(1 + p_partkey % 50 as varchar(20)), '-', cast(p_partkey as varchar(20)), ' on ', lower(p_type), '. ', repeat('The short title and the effective date of this act are kept by an office that shall print them for all who ask. ', 5)) end as description
from {part} where p_partkey % 5 < 3""",
    "papers": """
select concat('PL-', cast(l_partkey as varchar(20))) as law_id, case l_linenumber % 4 when 0 then 'Enrolled final bill' when 1 then 'old draft' when 2 then 'Signed act' else 'veto message' end as name, concat('f', cast(l_linenumber as varchar(20)), '.txt') as file, 'https://example.test/a' as url,
  case l_suppkey % 4 when 0 then concat('Public Law ', cast(1 + l_partkey % 50 as varchar(20)), '-', cast(l_partkey as varchar(20)), ' ', repeat('Section 1. Each office of this union keeps a record on every item that makers and sellers bring to it in a given year. ', 5))
    when 1 then concat('On ', p_name, ' keeping. ', repeat('A law of general kind that offices and agents read, print and send to all who make or sell an item in the land. ', 4)) when 2 then 'sign in' else repeat('Nothing of note is said about the law here, only that it was once read aloud in a room by some member of the house. ', 2) end as text
from {lineitem} join {part} on p_partkey = l_partkey where l_orderkey % 20 = 3""",
    "configs": """
select p_partkey as config_id, case when p_partkey % 13 = 0 then 'not a configuration' else concat(chr(123), '"', lower(p_type), '": ', chr(123), '"titles": [', cast(p_size as varchar(20)), case when p_size % 2 = 0 then ', 54' else '' end, ']',
       case when p_size % 3 = 0 then concat(', "defaults": ["', cast(p_partkey as varchar(20)), '"]') else '' end, case when p_size % 5 = 0 then ', "non_code": true' else '' end,
       case when p_partkey % 7 = 0 then '' else concat(', "keywords": ["', p_name, '", "', p_brand, '"]') end, chr(125), ', "', lower(p_brand), '": ', chr(123), '"titles": [], "keywords": ["', p_name, '"]', chr(125), chr(125)) end as text
from {part}""",
    "nodes": """
select file, node_id, law_id, min(part) as part, max(identifier) as identifier, max(tag) as tag, max(said) as text, max(num) as num
from (select concat('usc', lpad(cast(l_suppkey % 54 as varchar(20)), 2, '0'), '.xml') as file, l_partkey as part,
             concat('PL-', lpad(cast(1 + l_orderkey % 50 as varchar(20)), 3, '0'), '-001') as law_id,
             concat('rp-pl', lpad(cast(1 + l_orderkey % 50 as varchar(20)), 3, '0'), '001-', case when l_linenumber = 1 and l_orderkey % 4 = 0 then 'codification' else cast(l_partkey as varchar(20)) end) as node_id,
             concat('/us/usc/t', cast(l_suppkey % 54 as varchar(20)), '/s', cast(l_partkey as varchar(20))) as identifier,
             case l_linenumber % 4 when 0 then 'note' when 1 then 'content' when 2 then 'subsection' else 'p' end as tag,
             case when l_orderkey % 7 = 0 then '' when l_orderkey % 11 = 0 then 'Text: todo' else 'A list shall be kept.' end as said,
             case when l_orderkey % 3 = 0 then '' else '(a)' end as num
      from {lineitem}) as n
group by file, node_id, law_id""",
    "provisions": """
select 'final' as side, l_orderkey as law_key, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos,
       case when l_partkey % 5 = 0 then '' else concat('p', cast(l_partkey % 4 as varchar(20))) end as ref, concat(l_returnflag, cast(l_linenumber as varchar(20))) as note
from {lineitem} where l_returnflag <> 'R'
union all
select 'review', l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1,
       case when l_suppkey % 5 = 0 then '' else concat('p', cast(l_suppkey % 4 as varchar(20))) end, concat(l_returnflag, cast(l_linenumber as varchar(20)))
from {lineitem} where l_linestatus = 'O'
union all
select 'source', l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1,
       concat('p', cast(l_linenumber % 4 as varchar(20))), concat(l_returnflag, cast(l_linenumber as varchar(20)))
from {lineitem}""",
    "markup_parts": """
select concat('usc', lpad(cast(p_size as varchar(20)), 2, '0'), '-', cast(p_partkey - p_partkey % 50 as varchar(20)), '.xml') as file, p_partkey as ord, p_size as title, p_name as heading,
       case when p_partkey % 9 = 0 then cast(null as varchar(50)) else concat('/us/usc/t', cast(p_size as varchar(20)), '/s', cast(p_partkey as varchar(20))) end as identifier,
       1 + p_partkey % 50 as c, 1 + p_partkey % 7 as n, case when p_partkey % 4 = 0 then 2 + p_partkey % 50 else 1 + p_partkey % 50 end as cited,
       concat(cast(1 + p_partkey % 5 as varchar(20)), case when p_partkey % 2 = 0 then 'a' else 'A' end) as other,
       p_partkey % 3 = 0 as noted, p_partkey % 3 = 1 as added, p_partkey % 5 = 0 as dump, p_partkey % 7 = 0 as linked, p_partkey % 6 = 0 as digested, p_partkey % 13 = 0 as inner_id, p_partkey % 2 = 0 as by_href, p_partkey % 12 <> 7 as by_name,
       concat('https://board.example.test/c/', cast(p_partkey as varchar(20))) as link, lpad(cast(p_partkey as varchar(20)), 64, '0') as digest, p_partkey % 10 as tint
from {part}""",
    "markup_pieces": """
select file, ord, concat('<section id="s', cast(ord as varchar(20)), '"', case when identifier is null then '' else concat(' identifier="', identifier, '"') end, '><num>', cast(ord as varchar(20)), '</num><heading>', heading, '</heading><content>See /us/usc/t', cast(title as varchar(20)), '/s', other, '. Of it.</content>',
       case when noted then concat('<notes><note topic="x" id="rp-pl', lpad(cast(c as varchar(20)), 3, '0'), lpad(cast(n as varchar(20)), 3, '0'), '-codification"><heading>Pub. L. ', cast(cited as varchar(20)), case when by_href then '-' else '–' end, cast(n as varchar(20)), '. <i>', heading, '</i></heading><p><b>Status.</b> active ', cast(tint as varchar(20)), '</p>',
              case when by_href then concat('<ref href="/us/pl/', cast(c as varchar(20)), '/', cast(n as varchar(20)), '">law</ref>') else '' end, case when dump then '<quotedContent>Whole text.</quotedContent>' else '' end, case when linked then concat('<p>', link, '</p>') else '' end,
              case when digested then concat('<p>SHA-256 ', digest, '</p>') else '' end, case when inner_id then '<ref identifier="/us/usc/t1/s1"/>' else '' end, '</note></notes>') else '' end,
       case when added then concat('<subsection id="rp-', cast(ord as varchar(20)), '"><p id="rp-', cast(ord as varchar(20)), '-a">Added', case when by_name then concat(' by Pub. L. ', cast(cited as varchar(20)), '-', cast(n as varchar(20))) else '' end, '.<br/></p>',
              case when by_href then concat('<ref href="/us/pl/', cast(c as varchar(20)), '/', cast(n as varchar(20)), '"/>') else '' end, '</subsection>') else '' end, '</section>') as piece
from {markup_parts}""",
    "claim_keys": """
select k, kind, v, concat('n', ks) as node, concat('/us/usc/t1/s', ks) as identifier, concat('rp-pl', lpad(ks, 6, '0'), '-codification') as note, concat('ACTION-', ks) as action_id,
       concat('usc', case when kind = 0 and v = 3 or kind = 2 and v = 10 then concat('-own-', ks) else cast(k - k % 20 as varchar(20)) end, '.xml') as file,
       concat('fresh wording shall govern every listed item under number', ks) as said
from (select p_partkey as k, cast(p_partkey as varchar(20)) as ks, p_partkey % 4 as kind, (p_partkey - p_partkey % 4) / 4 % 25 as v from {part}) as p""",
    "claim_before": """
select file, k as ord, concat('<section id="s', cast(k as varchar(20)), '" identifier="', identifier, '"><p id="', node, '">old wording stands here</p></section>', case when kind = 2 and v = 10 then concat('<note id="', note, '">', said, '</note>') else '' end, chr(10)) as piece
from {claim_keys}""",
    "claim_after": """
select file, k as ord, concat('<section id="s', cast(k as varchar(20)), '" identifier="', identifier, '"><p id="', node, '">', case when kind = 0 and v <> 3 then said else 'old wording stands here' end, '</p>', case when kind = 0 and v = 2 then concat('<q id="x', node, '"/>') else '' end, '</section>',
       case when kind = 1 then concat('<section id="a', node, '" identifier="', identifier, 'A">', said, '</section>') else '' end,
       case when kind = 2 then concat('<note id="', note, '">', said, case v when 4 then ' board.example' when 7 then ' manifest-7' when 8 then concat(' C:', chr(92), chr(92), 'work') when 9 then '<quotedContent origin="/us/pl/1/2">x</quotedContent>' else '' end, '</note>') else '' end,
       case when kind = 2 and v = 11 then 'Authenticated statutory text was unavailable or the supplied attachment yielded only viewer' else '' end, chr(10)) as piece
from {claim_keys}""",
    "claim_plan": """
select action_id, case kind when 0 then 'amend existing text' when 1 then 'insert new section' when 2 then 'add statutory note' else case when v = 1 then 'monitor' else 'no Code action' end end as action_type, case when kind = 2 then 'statutory_note' else 'plain' end as treatment,
       case when kind = 1 then concat(identifier, 'A') else identifier end as identifier, case when kind = 2 then note else '' end as node_ids
from {claim_keys} where not (kind = 0 and v = 24)""",
    "claim_results": """
select cast(k as bigint) as nr, action_id, case when kind = 3 or kind = 2 and v = 1 then 'documented-no-code-action' when kind = 2 and v = 6 then 'weird' when kind = 0 and v = 6 then 'done' when kind = 0 and v = 7 then 'blocked'
              when kind = 0 and v between 8 and 11 then 'already-satisfied-with-baseline-proof' when kind = 0 and v between 18 and 21 then 'superseded-by-later-action' else 'applied' end as status,
       case when v % 2 = 0 then concat('usc/', file) else file end as file,
       case when kind = 1 and v = 1 then '/us/usc/t1' when kind = 1 and v = 4 then '' when kind = 1 then concat(identifier, 'A') when kind = 0 and v in (12, 21) then concat(identifier, 'Z') else identifier end as identifier,
       case when kind = 1 then concat('a', node) when kind = 2 and v <> 10 then note when kind = 0 and v = 22 then concat('s', cast(k as varchar(20))) when kind = 0 and v = 23 then concat('gone', node) else '' end as added,
       case when kind <> 0 or v between 8 and 11 or v between 18 and 21 then '' when v = 1 then concat('gone', node) when v = 2 then concat('x', node) else node end as changed,
       case when kind = 0 and v = 4 then node when kind = 0 and v = 5 then concat('never', node) else '' end as removed,
       case when kind = 0 and v = 13 or kind = 3 then '' when kind = 0 and v = 14 then 'unrelated phrases nobody wrote anywhere inside these files' when kind = 0 and v = 15 then concat('No operative text; ', said) else said end as said,
       case when kind = 0 and v = 16 then cast(null as varchar(10)) else 'credit added' end as credit, case when kind = 0 and v = 17 then ' ' else 'note added' end as amendment,
       case when kind = 1 and v = 2 then 'No TOC change' when kind = 1 and v = 3 then cast(null as varchar(10)) else 'entry added' end as contents, case when kind = 3 and v <> 2 then 'nothing to do' else '' end as explanation,
       case when kind = 0 and v between 18 and 21 and v <> 19 then 'Superseded' else 'checked' end as validation, case when kind = 2 and v = 2 then 'rp-pl000000-codification' when kind = 2 and v % 2 = 1 then note else '' end as note_id,
       case when kind = 2 and v = 3 then 'usc/other.xml' when kind = 2 then file else '' end as note_file, case when kind = 2 and v = 5 then 'unrelated phrases nobody wrote anywhere inside these files' else '' end as excerpt,
       case when kind = 0 and v between 8 and 11 and v <> 9 then case when v = 11 then 'base0' else 'base1' end else '' end as proof_base, case when v = 10 then 'nowhere' else node end as proof_node, identifier as proof_identifier, concat('usc/', file) as proof_file,
       case when kind = 0 and v between 18 and 21 and v <> 20 then 'told' else '' end as later
from {claim_keys} where not (kind = 1 and v = 5)""",
    "draft_requests": """
select concat('P', cast(p_partkey as varchar(20))) as law_id, case when p_partkey % 3 = 0 then cast(null as varchar(10)) when p_partkey % 4 = 0 then 'other' else concat('sha', cast(p_partkey as varchar(20))) end as confirmed from {part}""",
    "draft_plans": """
select concat('P', cast(p_partkey as varchar(20))) as law_id, case when p_partkey % 7 = 0 then 'approved' else 'draft' end as status, case when p_partkey % 5 = 0 then ' ' else p_name end as summary, concat('sha', cast(p_partkey as varchar(20))) as source_sha256
from {part} where p_partkey % 11 <> 0""",
    "draft_operations": """
select concat('P', cast(l_partkey as varchar(20))) as law_id, concat('/us/usc/t', cast(p_size as varchar(20)), '/s', cast(p_partkey as varchar(20)), case when l_linenumber = 6 then 'x' else '' end) as identifier
from {lineitem} join {part} on p_partkey = l_partkey where l_partkey % 13 <> 0""",
    "later_sections": """
select case when cast(section as int) % 6 = 1 then concat(identifier, 'x') else identifier end as identifier, case when cast(section as int) % 4 = 1 then concat(body, ' Or not.') else body end as body from {sections}""",
    "published_laws": """
select concat('PL-', lpad(cast(c as varchar(20)), 3, '0'), '-', lpad(cast(n as varchar(20)), 3, '0')) as law_id, case when ord % 8 = 0 then 'No such title' else heading end as title, file,
       case when ord % 5 = 0 then concat('gone-', cast(ord as varchar(20))) when ord % 3 = 1 then concat('rp-', cast(ord as varchar(20))) else concat('m', cast(ord as varchar(20))) end as marker, ord, ord % 3 = 1 and ord % 5 <> 0 as marked
from {markup_parts}""",
    "gate_keys": """
select o_custkey % 6 as run_id, o_orderkey as k, case when o_custkey % 6 = 0 then 0 else o_orderkey end as d from {orders}""",
    "gate_laws": """
select run_id, concat('L-', cast(k as varchar(20))) as law_id, case when d % 31 = 1 then '' else concat('r', cast(k % 40 as varchar(20)), '.json') end as report,
       case when d % 37 = 2 then 'incomplete' else 'valid' end as report_status, case when d % 41 = 3 then 'missing target' else '' end as issues,
       case when d % 43 = 4 then '' else 'active' end as status, case when d % 47 = 5 then cast(null as varchar(20)) else 'by date' end as chronology, case when d % 29 = 6 then '' else 'note' end as treatment, case when d % 23 = 7 then ' ' else 'keep' end as action,
       case when d % 19 = 8 then '' else 'page 1' end as evidence, case when d % 53 = 9 then '' else 'same' end as comparison, case when d % 17 = 10 then '' else 'high' end as confidence,
       case when k % 3 = 0 then 'title 28' else '' end as law_target, case when k % 4 = 0 then 'by command' else '' end as law_command
from {gate_keys}""",
    "gate_index": """
select run_id, concat('L-', cast(k as varchar(20))) as law_id, case when d % 29 = 3 then 'other.json' else concat('r', cast(k % 40 as varchar(20)), '.json') end as selected,
       case when k % 7 = 1 and not d % 5 = 1 then 'early.json,late.json' else '' end as superseded
from {gate_keys} where not d % 23 = 2
union all select run_id, concat('L-', cast(k as varchar(20))), 'zz.json', '' from {gate_keys} where d % 101 = 50""",
    "gate_candidates": """
select run_id, concat('L-', cast(k as varchar(20))) as law_id, 1 as group_index, concat('r', cast(k % 40 as varchar(20)), '.json') as report from {gate_keys}
union all select run_id, concat('L-', cast(k as varchar(20))), 2, 'late.json' from {gate_keys} where k % 7 = 1""",
    "gate_reports": """
select run_id, concat('r', cast(k % 40 as varchar(20)), '.json') as report, 'full' as kind, case when d % 40 = 5 then 'incomplete' else 'valid' end as status
from {gate_keys} where not d % 40 in (4, 17) group by 1, 2, 3, 4
union all select run_id, concat('r', cast(k % 40 as varchar(20)), '.json'), 'canonical', case when k % 40 = 6 then 'incomplete' else 'valid' end from {gate_keys} where not d % 40 = 4 group by 1, 2, 3, 4""",
    "gate_lines": """
select run_id, k, cast(l_linenumber as varchar(20)) as ref, k * 7 + l_linenumber as v, case when run_id = 0 then 0 else k * 7 + l_linenumber end as e
from {gate_keys} join {lineitem} on l_orderkey = k group by 1, 2, 3, 4, 5""",
    "gate_provisions": """
select run_id, concat('L-', cast(k as varchar(20))) as law_id, ref, case v % 8 when 0 then 'direct-amendment' when 5 then 'repeal,short-title' when 6 then 'transfer' when 2 then 'short-title' when 3 then 'repeal' else '' end as classes,
       case when e % 61 = 1 then '' else case v % 9 when 0 then 'Amend existing-text' when 1 then 'new-section' when 2 then 'statutory-note' when 3 then 'historical-note-only' when 4 then 'exclude-from-code' when 5 then 'repeal-marking' when 6 then 'transfer' when 7 then 'effective-date-note' else 'operative-text-required' end end as treatment,
       case when e % 11 = 2 then '' else 's 1' end as target, case when e % 59 = 3 then '' else 'page 2' end as evidence, case when e % 13 = 4 then '' else 'strike' end as exact_change
from {gate_lines}""",
    "gate_plan": """
select run_id, concat('L-', cast(k as varchar(20))) as law_id, ref, 1 as ord, case when e % 53 = 5 then '' else concat('A-', cast(v as varchar(20))) end as action_id,
       case when e % 47 = 6 then cast(null as varchar(60)) when e % 17 = 7 then 'amend existing text' else case v % 9 when 0 then 'amend existing text' when 1 then 'insert new section' when 2 then 'add statutory note' when 3 then 'add historical note' when 5 then 'repeal or remove project-added text' when 6 then 'transfer' when 7 then 'add historical note' else 'no Code action' end end as action_type,
       case when e % 19 = 8 then '' else 'usc28.xml' end as file, case when e % 7 = 2 then '' else '/us/usc/t28/s1' end as identifier,
       case when e % 10 = 9 then '' when e % 29 = 10 then 'Retain as repeal history only.' else 'strike and insert' end as command,
       case when e % 31 = 11 then 'rp-1,/us/usc/t1/s1' when e % 31 = 12 then 'rp-2, ' when e % 31 = 13 then 'usc01.XML' when v % 2 = 0 then 'rp-3,rp-4' else '' end as node_ids
from {gate_lines} where not e % 43 = 14
union all select run_id, concat('L-', cast(k as varchar(20))), ref, 2, '', cast(null as varchar(60)), '', '', '', '/us/usc/t1' from {gate_lines} where e % 71 = 20""",
    "gate_mappings": """
select run_id, concat('L-', cast(k as varchar(20))) as law_id, ref, 1 as batch, v as idx from {gate_lines}
union all select run_id, concat('L-', cast(k as varchar(20))), ref, 1, v from {gate_lines} where v % 3 = 0
union all select run_id, concat('L-', cast(k as varchar(20))), ref, 2, v from {gate_lines} where run_id = 2 and v % 5 = 0""",
    "gate_unresolved": """
select run_id, case when k % 2 = 0 then 'law' else 'provision' end as kind from {gate_keys} where d % 50 = 7 or d % 50 = 8""",
    "gate_stated": """
select l.run_id, laws + case when l.run_id = 5 then 1 else 0 end as expected_laws, lines + case when l.run_id = 5 then 1 else 0 end as expected_provisions, lines + thirds + case when l.run_id = 4 then 1 else 0 end as expected_mappings,
       laws as total_laws, case when l.run_id = 1 then cast(null as bigint) else laws end as reviewed_laws, case when l.run_id = 1 then cast(null as bigint) else laws end as audit_complete_laws,
       case when l.run_id = 2 then cast(null as bigint) else laws - 3 end as primary_complete, case when l.run_id = 3 then 4 else 3 end as high_risk, case when l.run_id = 3 then cast(null as int) else 3 end as high_risk_reviewed,
       case when l.run_id = 4 then laws - 1 else laws end as progress_total, laws - 3 as progress_completed,
       case when l.run_id = 1 then 2 else 0 end as treatment_action_conflicts, case when l.run_id = 2 then 1 else 0 end as invalid_node_identifiers, case when l.run_id = 3 then cast(null as int) else 0 end as executables_without_target, case when l.run_id = 4 then 1 else 0 end as executables_without_command,
       case when l.run_id = 1 then 1 when l.run_id = 2 then cast(null as int) else 0 end as controlling_invalid_reports, case when l.run_id = 2 then 1 else 0 end as controlling_laws_with_issues, case when l.run_id = 3 then 1 else 0 end as controlling_provisions_with_issues,
       case when l.run_id = 2 then lines else lines + thirds end as source_provisions, lines as consolidated_provisions, case when l.run_id = 5 then 1 else 0 end as actions_without_target
from (select run_id, count(*) as laws from {gate_keys} group by run_id) l join (select run_id, count(*) as lines, sum(case when v % 3 = 0 then 1 else 0 end) as thirds from {gate_lines} group by run_id) p on l.run_id = p.run_id""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def derived(sql: str) -> list[str]:
    """The derived tables that a text needs, each after those it is made of."""
    out: list[str] = []
    for n in names(sql):
        if n in FIXTURES:
            out += [m for m in [*derived(FIXTURES[n]), n] if m not in out]
    return out


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = FIXTURES[name]
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in names(sql)})


def oracle(sql: str) -> str:
    """The DuckDB text of a query that refers to derived tables as {name}."""
    used = derived(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    if not used:
        return plain(sql)
    ctes = ", ".join(f"{n} as ({plain(FIXTURES[n])})" for n in used)
    body = plain(sql).strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes}, {body[15:]}"
    return f"with {ctes}, {body[5:]}" if body.lower().startswith("with ") else f"with {ctes} {body}"
