"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Words of a text as a list.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_QUALITY = rf"""
with d as (
  select doc_id, coalesce(text, '') as body, {_WORDS} as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
),
g as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s
  from d, unnest(range(1, len(w) - 1)) as r(i) where len(w) >= 3
),
c as (select doc_id, i, count(*) over (partition by doc_id, s) as n from g),
p as (select distinct doc_id, i + k as spot from c, unnest([0, 1, 2]) as o(k) where n > 1),
r as (select doc_id, count(*) as n_repeat_words from p group by doc_id),
m as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) as n_lettered,
         length(body) - length(regexp_replace(body, '\p{{Lu}}', '', 'g')) as n_upper,
         length(body) - length(regexp_replace(body, '\p{{L}}', '', 'g')) as n_letters
  from d left join r on d.doc_id = r.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines
            or word_chars < 2 * n_words or word_chars > 15 * n_words or 10 * n_lettered < 7 * n_words or 2 * n_upper > n_letters) as kept
from m
"""

_URLS = r"""
with p as (
  select page_id, coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
),
rules(verdict, rh, rp) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
),
h as (
  select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(verdict, length(rh || rp)) as verdict
  from p, rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id
)
select p.page_id, host, path, rule, coalesce(h.verdict, 'allow') as verdict from p left join h on p.page_id = h.page_id
"""

_SUBSTRINGS = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
g as (select doc_id, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) as s from d, unnest(range(1, len(w) - 33)) as r(i) where len(w) >= 35),
c as (select doc_id, i, count(*) over (partition by s) as n from g),
gone as (select doc_id, list_distinct(flatten(list(range(i, i + 35)))) as spot from c where n > 1 group by doc_id),
k as (
  select d.doc_id, len(w)::bigint as n_words, coalesce(len(spot), 0)::bigint as n_removed,
         case when spot is null then array_to_string(w, ' ')
              else (select coalesce(string_agg(w[i], ' ' order by i), '') from unnest(range(1, len(w) + 1)) as r(i) where not exists (select 1 from unnest(spot) as a(j) where a.j = r.i)) end as kept
  from d left join gone on d.doc_id = gone.doc_id
)
select doc_id, n_words, n_removed, sha256(kept) as kept_sha256 from k
"""

_LINES = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as l from documents),
g as (
  select doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] as s from d, unnest(range(1, len(l) - 1)) as r(i) where len(l) >= 3
),
c as (select doc_id, i, row_number() over (partition by s order by doc_id nulls last, i) as n from g where regexp_matches(s, '\S')),
gone as (select doc_id, list_distinct(flatten(list(range(i, i + 3)))) as spot from c where n > 1 group by doc_id),
k as (
  select d.doc_id, coalesce(len(l), 0)::bigint as n_lines, coalesce(len(spot), 0)::bigint as n_removed,
         case when spot is null then coalesce(text, '')
              else (select coalesce(string_agg(l[i], chr(10) order by i), '') from unnest(range(1, len(l) + 1)) as r(i) where not exists (select 1 from unnest(spot) as a(j) where a.j = r.i)) end as kept
  from d left join gone on d.doc_id = gone.doc_id
)
select doc_id, n_lines, n_removed, sha256(kept) as kept_sha256 from k
"""

_LEAKS = r"""
with b as (select item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') as w from benchmark),
s as (
  select distinct item_id, array_to_string(list_slice(w, i, i + 4), ' ') as s from b, unnest(range(1, len(w) - 3)) as r(i) where len(w) >= 5
),
n as (select item_id, count(*) as n_shingles from s group by item_id),
d as (select doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') as w from documents),
t as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s from d, unnest(range(1, len(w) - 3)) as r(i) where len(w) >= 5),
m as (select doc_id, item_id, count(*) as contained from t join s on t.s = s.s group by doc_id, item_id)
select doc_id, m.item_id, contained::bigint as contained, n_shingles::bigint as n_shingles, contained / n_shingles as containment
from m join n on m.item_id = n.item_id where contained >= 0.8 * n_shingles
"""

_WARC = r"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as sha from pages),
f as (select sha as s, min(page_id) as first from p group by sha having count(*) > 1),
b as (select *, cast(from_hex(sha) as bit)::varchar as bits from p)
select page_id, payload_bytes::bigint as payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([substr(bits, 5 * i + k, 1)::int * (2 ** (5 - k))::int for k in range(1, 6)])::int, 1) for i in range(0, 32)], '') as payload_digest,
       case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from b left join f on sha = s
"""

#: Redirects from each page whose id isn't divisible by 5 to the one before it, so chains of up to five pages; verdicts by a walk along them.
_ALIASES = r"""
with recursive u as (
  select page_id, coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') as path,
         case when url like '%://%' then regexp_replace(lower(regexp_extract(url, '^[\s\S]*?://[^/?#]*', 0)) || regexp_extract(url, '^[\s\S]*?://[^/?#]*([\s\S]*)$', 1), '#[\s\S]*$', '') end as node
  from pages
),
rules(verdict, rh, rp) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
),
h as (
  select page_id, arg_max(verdict, length(rh || rp)) as own
  from u, rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id
),
j as (select u.page_id, node, own from u left join h on u.page_id = h.page_id),
e as (select a.node as x, b.node as y from j a join j b on b.page_id = a.page_id - 1 where a.page_id % 5 <> 0 and a.node <> b.node),
ways as (select x, y from e union select y as x, x as y from e),
r(x, y) as (select x, x from ways union select r.x, ways.y from r join ways on r.y = ways.x),
w as (select r.x as node, count(*) filter (own = 'block') as blocked, count(*) filter (own = 'allow') as allowed from r join j on j.node = r.y group by r.x)
select page_id, coalesce(own, case when blocked > 0 and allowed = 0 then 'block' else 'allow' end) as verdict from j left join w on j.node = w.node
"""



def _best(state: int) -> str:
    """The cheapest way from a state, ties ASCII-least, before any insertion: delete, keep or rerole the row `o`."""
    role, after = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)][state]
    way = lambda cost, edit, to, said: f"{{'c': {cost} + s{to}.c, 'a': '{edit}' || s{to}.a, 'r': {said} || s{to}.r}}"
    keep = f"when initial = '{role[0]}' then {way('more', 'K', after, 'chr(10) || role || chr(58) || text')}"
    if state == 0:
        keep += f" when initial = 's' then {way('more', 'K', 1, 'chr(10) || role || chr(58) || text')}"
    rerole = way("3 + more", "R", after, f"chr(10) || '{role}:' || text")
    return f"list_sort(list_filter([{way(4, 'D', state, chr(39) * 2)}, case when must then null {keep} end, case when not must then {rerole} end], lambda x: x is not null))[1]"


def _inserted(state: str, to: str) -> str:
    role = "assistant" if state == "2" else "user"
    return f"list_sort([b{state}, {{'c': 3 + {to}.c, 'a': 'I' || {to}.a, 'r': chr(10) || '{role}:' || {to}.r}}])[1]"


#: CRC-32 bit by bit; then a walk over each conversation's rows from the last to the first, with the best way from each of four states.
_CONVERSATIONS = rf"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations
),
c as (
  select conv_id, turn, role, text,
         xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(key, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
                         lambda a, e: case when e >= 0 then xor(a, e) else xor(a >> 1, 3988292384::bigint * (a & 1)) end), 4294967295::bigint) % 20 as code
  from k
),
d as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
         case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from c, unnest(case when code = 3 then [1, 2] else [1] end) where code <> 0
),
n as (
  select *, row_number() over (partition by conv_id, role, text order by i) as nth,
         substr(role, 1, 1) as initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last
  from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d)
),
o as (
  select *, last = '' as blank, last <> '' and nth > 1 as duplicate, last not in ('', '.', '!', '?') and nth = 1 as truncated,
         last = '' or nth > 1 as must, case when last not in ('.', '!', '?') then 3 else 0 end as more,
         lag(initial) over (partition by conv_id order by i) || initial not in ('su', 'ua', 'au') as illegal
  from n
),
w(conv_id, i, s0, s1, s2, s3) as (
  select conv_id, max(i) + 1, {{'c': 0::bigint, 'a': '', 'r': ''}}, {{'c': 6::bigint, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}},
         {{'c': 3::bigint, 'a': 'I', 'r': chr(10) || 'assistant:'}}, {{'c': 0::bigint, 'a': '', 'r': ''}}
  from o group by conv_id
  union all
  select conv_id, i, {_inserted('0', 'v2')}, {_inserted('1', 'v2')}, v2, {_inserted('3', 'b2')}
  from (
    select *, {_inserted('2', 'b3')} as v2
    from (
      select w.conv_id, o.i, {_best(0)} as b0, {_best(1)} as b1, {_best(2)} as b2, {_best(3)} as b3
      from w join o on w.conv_id is not distinct from o.conv_id and o.i = w.i - 1
    )
  )
),
f as (select conv_id, s0 from w where i = 1),
g as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
         count(*) filter (truncated) as truncated, count(*) filter (illegal) as illegal
  from o group by conv_id
),
a as (select distinct conv_id from conversations)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(s0.c, 0)::bigint as cost, coalesce(s0.a, '') as audit, sha256(coalesce(substr(s0.r, 2), '')) as repaired_sha256
from a left join g on a.conv_id is not distinct from g.conv_id left join f on a.conv_id is not distinct from f.conv_id
"""

ORACLES: dict[str, str] = {
    "op7_warc": _WARC,
    "url_alias_verdicts": _ALIASES,
    "op1_line_dedup": _LINES,
    "op3_decontamination": _LEAKS,
    "op8_quality_rules": _QUALITY,
    "op9_url_filters": _URLS,
    "op10_substring_dedup": _SUBSTRINGS,
    "op11_conversation_repair": _CONVERSATIONS,
}
