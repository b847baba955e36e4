"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from tarnwick.llm.sharding import lookup_table

_DECONTAMINATE = r"""
with item as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
item_window as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as words
  from item, lateral (select unnest(range(1, len(w) - least(10, len(w)) + 2)) as i) where len(w) > 0),
doc as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
doc_window as (
  select r, i, k, array_to_string(w[i:i + k - 1], ' ') as words
  from doc, (select distinct k from item_window) ks, lateral (select unnest(range(1, len(w) - k + 2)) as i)),
hit as (select r, i, h.k, item_id from doc_window h join item_window t on h.k = t.k and h.words = t.words),
covered as (select r, count(distinct i + j) as n_hit from (select r, i, unnest(range(0, k)) as j from hit) group by r),
owner as (
  select r, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
  from (select distinct r, item_id from hit where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join covered using (r) left join owner using (r)
"""

_PASSAGES = r"""
with doc as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, i, array_to_string(w[i:i + 34], ' ') as words from doc, lateral (select unnest(range(1, len(w) - 33)) as i)),
again as (select words from win group by words having count(*) > 1),
gone as (select distinct r, i + j as p from (select r, i, unnest(range(0, 35)) as j from win semi join again using (words))),
word as (select r, unnest(range(1, len(w) + 1)) as p, unnest(w) as x from doc),
kept as (
  select word.r, count(*) filter (where gone.p is not null) as n_removed, coalesce(string_agg(x, ' ' order by word.p) filter (where gone.p is null), '') as text
  from word left join gone on word.r = gone.r and word.p = gone.p group by word.r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from doc left join kept using (r)
"""

_WARC = """
with page as (select page_id, sha1(coalesce(html, '')) as digest, cast(octet_length(encode(coalesce(html, ''))) as bigint) as n from pages),
held as (select *, max(page_id) over (partition by digest) as holder from page)
select page_id, n as payload_bytes, digest as payload_digest,
  case when n >= 1000 and page_id is distinct from holder then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id is distinct from holder then holder end as refers_to
from held
"""

_CHAT = """
with turn as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as pos
  from (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null)),
whole as (select conv_id, count(*) as n, string_agg(role || chr(31) || text || chr(30), '' order by pos) as log, min(case when pos = 1 then role || chr(31) || text end) as head from turn group by conv_id),
kept as (
  select conv_id, n from whole a
  where not exists (select 1 from whole b where b.head = a.head and starts_with(b.log, a.log) and (b.n > a.n or (b.n = a.n and b.conv_id < a.conv_id))))
select conv_id, cast(turn // 256 as bigint) as part, cast(n as bigint) as n_turns, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by pos) as text
from turn join kept using (conv_id) group by conv_id, turn // 256, n
"""


_INFILL = r"""
with doc as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as d from documents),
drawn as (
  select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
    cast('0x' || d[1:8] as bigint) as h1, cast('0x' || d[9:16] as bigint) as h2, cast('0x' || d[17:24] as bigint) as h3, cast('0x' || d[25:32] as bigint) as h4 from doc),
cut as (
  select doc_id, t, len(u) as n,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form,
    array_to_string(u[1:least(h1 % (len(u) + 1), h2 % (len(u) + 1))], '') as prefix,
    array_to_string(u[least(h1 % (len(u) + 1), h2 % (len(u) + 1)) + 1:greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))], '') as middle,
    array_to_string(u[greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) + 1:], '') as suffix from drawn)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then t else prefix || middle || suffix end) as restored_sha256
from cut
"""

_LINES = r"""
with doc as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
line as (
  select r, doc_id, p, x, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select r, doc_id, unnest(range(1, len(l) + 1)) as p, unnest(l) as x from doc)),
again as (
  select key, min(doc_id) as keeper from line where length(key) >= 10
  group by key having count(distinct doc_id) + cast(bool_or(doc_id is null) as bigint) >= 2),
marked as (select r, p, x, keeper is not null and doc_id is distinct from keeper as gone from line left join again using (key)),
kept as (select r, count(*) filter (where gone) as n_dropped, coalesce(string_agg(x, chr(10) order by p) filter (where not gone), '') as text from marked group by r)
select doc_id, cast(len(l) as bigint) as n_lines, cast(n_dropped as bigint) as n_dropped, sha256(kept.text) as kept_sha256 from doc join kept using (r)
"""


def _crc_table() -> str:
    """The 256 remainders of the reflected polynomial 0xEDB88320."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return f"cast([{','.join(map(str, out))}] as bigint[])"


def spelling_sql() -> str:
    return rf"""
with run as (
  select doc_id, word, count(*) as n
  from (select coalesce(cast(doc_id as varchar), '') as doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) as word from documents)
  where length(word) >= 7 group by all),
coded as (select word, n, hex(encode(doc_id || ':' || word)) as x from run),
hashed as (
  select word, n, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: cast('0x' || x[2 * i + 1:2 * i + 2] as bigint)),
    lambda c, b: xor(list_extract({_crc_table()}, (xor(c, b) & 255) + 1), c >> 8), cast(4294967295 as bigint)), 4294967295) as h from coded),
slipped as (select case when h % 31 = 0 then word[:h % length(word)] || word[h % length(word) + 2:] else word end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from slipped where length(word) >= 7 group by word having sum(n) >= 2),
cut as (select word, i, word[:i] || word[i + 2:] as rest from (select word, unnest(range(0, length(word))) as i from words)),
link as (
  select a.word, b.word as near from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select cut.word, words.word from cut join words on cut.rest = words.word
  union select words.word, cut.word from cut join words on cut.rest = words.word),
best as (select link.word, count(*) as n_near, first(near order by n desc, near) as near, max(n) as near_n from link join words on link.near = words.word group by link.word),
form as (select words.word, n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * n then near end as form, case when near_n >= 10 * n then near_n end as form_n from words left join best using (word)),
chain as (
  with recursive step as (
    select word, form as last from form where form is not null
    union all select step.word, form.form from step join form on step.last = form.word where form.form is not null)
  select step.word, last as root from step join form on step.last = form.word where form.form is null)
select word, n, cast(n_near as bigint) as n_near, form, cast(form_n as bigint) as form_n, coalesce(root, word) as root from form left join chain using (word)
"""


def sharding_sql(shards: list[str], table_size: int) -> str:
    """The table is data here: the tests check how it is filled."""
    held = ",".join(map(str, lookup_table(shards, table_size)))
    names = ",".join(f"'{s}'" for s in shards)
    return f"""
with doc as (select doc_id, cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), md5(coalesce(text, '')))), 1, 15)) as bigint) % {table_size} as slot from documents),
held as (select string_split('{held}', ',') as codes, [{names}] as names)
select doc_id, slot, names[cast(codes[slot + 1] as integer) + 1] as shard from doc, held
"""


def oracle_sql(shards: list[str]) -> dict[str, str]:
    return {"op1_decontaminate": _DECONTAMINATE, "op2_sharding": sharding_sql(shards, 65_537), "op4_passages": _PASSAGES, "op6_warc": _WARC, "op7_chat": _CHAT, "op11_infill": _INFILL, "op12_lines": _LINES, "op13_spelling": spelling_sql()}
