"""SQL that DuckDB can run, equal to the registered queries of this subpackage."""

from __future__ import annotations

import string

from tidewatch.llm.common import WORD
from tidewatch.llm.mixing import MAX_EPOCHS
from tidewatch.llm.ranking import BEST as RANKED
from tidewatch.llm.ranking import TERM
from tidewatch.llm.url_rules import RULES

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
RULE_VALUES = ", ".join(str(rule) for rule in RULES)

# Sources sorted by the ratio of limit to weight are capped from the front while the share per unit
# of weight, taken over the rest, is above their ratio.
MIXING = rf"""
with sized as (
    select doc_id, source,
           coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
           ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as k
    from documents
), totals as (
    select source, sum(size)::bigint as source_size,
           (row_number() over (order by source is null, source collate "C") - 1) % 3 + 1 as weight
    from sized group by source
), ranked as (
    select *, row_number() over (order by {MAX_EPOCHS} * source_size / weight, source) as n,
           sum(source_size) over () as total, sum(weight) over () as weights
    from totals
), running as (
    select *, total - coalesce(sum({MAX_EPOCHS} * source_size) over before, 0) as rest,
           weights - coalesce(sum(weight) over before, 0) as rest_weight
    from ranked
    window before as (order by n rows between unbounded preceding and 1 preceding)
), level as (
    select coalesce(min(n), 0) as first_open from running
    where rest / rest_weight <= {MAX_EPOCHS} * source_size / weight
), plan as (
    select r.source, r.source_size,
           case when r.n < l.first_open then ({MAX_EPOCHS} * r.source_size)::double
                else o.rest::double * r.weight / o.rest_weight::double end as target
    from running r, level l, running o where o.n = l.first_open
), budget as (
    select *, round(target)::bigint as budget from plan
), walked as (
    select s.doc_id, s.size, b.source_size, b.target,
           case when b.source_size = 0 then 0 else b.budget // b.source_size end as epochs,
           case when b.source_size = 0 then 0 else b.budget % b.source_size end as rest,
           sum(s.size) over (partition by s.source order by s.k, s.doc_id
                             rows unbounded preceding) - s.size as before
    from sized s join budget b on s.source is not distinct from b.source
)
select doc_id, size, source_size::bigint as source_size, target,
       (epochs * size + least(greatest(rest - before, 0), size))::bigint as taken
from walked
"""


RANKING = rf"""
with texts as (
    select doc_id, row_number() over () as row,
           regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') as terms
    from documents where text is not null
), held as (
    select *, len(terms)::bigint as n from texts where len(terms) > 0
), size as (
    select count(*)::bigint as docs, sum(n)::bigint as total from held
), counted as (
    select row, term, count(*)::bigint as tf
    from (select row, unnest(terms) as term from held) group by row, term
), weights as (
    select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w
    from counted, size group by term, docs
), norms as (
    select row, doc_id, 100 - 50 + ((50 * n * docs) // total) as m from held, size
), asked as (
    select distinct item_id, unnest(regexp_extract_all(
        translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term
    from benchmark
), scored as (
    select a.item_id, c.row,
           sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * d.m)))::bigint as score
    from asked a join counted c using (term) join weights w using (term) join norms d using (row)
    group by a.item_id, c.row
), ranked as (
    select item_id, doc_id, score,
           row_number() over (partition by item_id order by score desc, doc_id) as rank
    from scored join norms using (row) where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= {RANKED}
"""

# Phrases by their four possible lengths, counted within pieces.
COLLOCATIONS = rf"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), worded as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), totals as (
    select lang, sum(len(w))::bigint as n from worded group by lang
), placed as (
    select lang, size, unnest(list_transform(range(1, len(w) - size + 2),
        lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase
    from worded, (select unnest([1, 2, 3, 4])::bigint as size) where len(w) >= size
), f as (
    select lang, size, phrase, count(*)::bigint as f from placed
    group by lang, size, phrase having count(*) >= 30
), split as (
    select *, string_split(phrase, ' ') as w from f where size > 1
), cuts as (
    select s.lang, s.phrase, s.size, s.f as a, k,
           array_to_string(s.w[1:k], ' ') as first_part, array_to_string(s.w[k + 1:], ' ') as rest
    from split s, (select unnest([1, 2, 3])::bigint as k) where k < s.size
), scored as (
    select c.lang, c.phrase, c.a, c.k, l.f as l, r.f as r,
           ((2000000::hugeint * c.a) // (l.f + r.f))::bigint as score
    from cuts c join f l on l.lang = c.lang and l.phrase = c.first_part
                join f r on r.lang = c.lang and r.phrase = c.rest
), worst as (
    select * from scored
    qualify row_number() over (partition by lang, phrase order by score, k) = 1
), parts as (
    select lang, f, array_to_string(w[pos:pos + part - 1], ' ') as phrase
    from split, (select unnest([2, 3])::bigint as part), (select unnest([1, 2, 3])::bigint as pos)
    where part < size and pos + part - 1 <= size
), cover as (
    select lang, phrase, max(f) as cover from parts group by lang, phrase
), kept as (
    select w.* from worst w left join cover c using (lang, phrase)
    where 100::hugeint * coalesce(c.cover, 0) < 80::hugeint * w.a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
       phrase, a, l, r, n, score
from kept join totals using (lang) qualify rank <= 2000
"""

# Links with a whole address only; the tables hold none of another kind.
URL_FILTER = rf"""
with rules(verdict, host, path) as (values {RULE_VALUES}),
cut as (
    select page_id, coalesce(html, '') as html, url,
           case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as tail
    from pages
), placed as (
    select row_number() over () as row, page_id, html, url,
           translate(regexp_extract(tail, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
           regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) as path
    from cut
), tags as (
    select url, unnest(regexp_extract_all(html, '(?i)<link\s[^<>]*>')) as tag, 'href' as name
    from placed where instr(url, '://') > 0
    union all
    select url, unnest(regexp_extract_all(html, '(?i)<meta\s[^<>]*>')), 'url'
    from placed where instr(url, '://') > 0
), links as (
    select regexp_replace(url, '#.*', '') as a,
           regexp_extract(tag, '(?i)' || name || '=\s*["'']?([^"''#>\s]+://[^"''#>\s]*)', 1) as b
    from tags where regexp_matches(tag, '(?i)rel=["'']?canonical|http-equiv=["'']?refresh')
), edges as (
    select a, b from links where b != '' union select b, a from links where b != ''
), ends as (
    select distinct a as url,
           translate(regexp_extract(a, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
           regexp_extract(a, '://[^/?#]*([^?#]*)', 1) as path
    from edges
), told as (
    select url, r.verdict from ends p join rules r
    on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
    qualify row_number() over (partition by url order by length(r.host || r.path) desc) = 1
), tainted as (
    with recursive reached(url) as (
        select url from told where verdict = 'block'
        union select e.b from reached t join edges e on t.url = e.a
    ) select url from reached
), ruled as (
    select p.row, r.host || r.path as rule, r.verdict from placed p join rules r
    on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
    qualify row_number() over (partition by p.row order by length(r.host || r.path) desc) = 1
)
select page_id, host, path, rule, coalesce(verdict,
       case when regexp_replace(p.url, '#.*', '') in (select url from tainted) then 'block' end,
       'allow') as verdict
from placed p left join ruled using (row)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": MIXING,
        "op11_ranking": RANKING,
        "op12_collocations": COLLOCATIONS,
        "op13_url_filter": URL_FILTER,
    }
