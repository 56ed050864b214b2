"""contaminated() over `documents` and `benchmark` as SQL for DuckDB. Windows are compared as texts, not by hashes."""

from .decontaminate import NUMBERS, UNITS

#: A name starts after a space, so it is at the start of one of the parts between spaces.
LEAKS_SQL = rf"""
with src as (select 0 as side, row_number() over () as key, doc_id as id, replace(coalesce(text, ''), chr(1), ' ') as text from (select distinct doc_id, text from documents)
  union all select 1, row_number() over (), item_id, replace(coalesce(text, ''), chr(1), ' ') from (select distinct item_id, text from benchmark)),
parts as (select *, string_split(text, ' ') as tk from src),
marked as (select *, list_transform(range(1, len(tk) + 1), lambda k: case when k > 1 and regexp_matches(tk[k - 1], '[\p{{L}}\p{{N}},;]$') then nullif(regexp_extract(tk[k], '^\p{{Lu}}\p{{Ll}}+'), '') end) as nm from parts),
named as (select side, key, id, text, list_filter(nm, lambda x: x is not null) as names,
  array_to_string(list_transform(range(1, len(tk) + 1), lambda k: case when nm[k] is null then tk[k] else regexp_replace(tk[k], '^\p{{Lu}}\p{{Ll}}+', ' ' || chr(1) || 'n ') end), ' ') as u from marked),
canon as (select side, key, id, names, regexp_extract_all(text, '{NUMBERS}') as numbers,
  regexp_replace(lower(regexp_replace(u, '{NUMBERS}', ' ' || chr(1) || 'd ', 'g')), chr(1) || 'd ?[\s\x0B]?(?:{UNITS})([^\p{{L}}\p{{N}}]|$)', chr(1) || 'd ' || chr(1) || 'u \1', 'g') as u from named),
tmpl as (select side, key, id, names, numbers, list_filter(string_split_regex(u, '[^\p{{L}}\p{{N}}\x01]+'), lambda x: x <> '') as t from canon),
short as (select distinct len(t) as m from tmpl where side = 1 and len(t) between 2 and 4),
win as (select side, key, unnest(range(len(t) - 4)) as pos, t, 5 as m from tmpl where len(t) >= 5 union all select side, key, unnest(range(len(t) - m + 1)), t, m from tmpl join short on len(t) >= m where side = 0 or len(t) = m),
grams as (select side, key, pos, array_to_string(t[pos + 1 : pos + m], ' ') as w, len(list_filter(t[pos + 1 : pos + m], lambda x: not starts_with(x, chr(1)))) as plain from win),
item as (select key as ikey, pos as ipos, w from grams where side = 1 and plain >= 2),
wanted as (select distinct ikey, w from item),
of_item as (select ikey, count(*) as n_windows from wanted group by ikey),
met as (select key, ikey, count(*) as n from (select distinct key, w from grams where side = 0) join wanted using (w) group by all),
near as (select key, ikey, n_windows, n / n_windows as similarity from met join of_item using (ikey) where n >= 0.8::double * n_windows),
found as (select key, pos, w from grams where side = 0 and key in (select key from near)),
lined as (select near.key, near.ikey, found.pos - item.ipos as shift, count(*) as n from near join found on found.key = near.key join item on item.ikey = near.ikey and item.w = found.w group by all),
best as (select key, ikey, shift from lined qualify row_number() over (partition by key, ikey order by n desc, shift) = 1),
used as (select * from tmpl where side = 1 or key in (select key from near)),
places as (select side, key, 'n' as kind, names as vals, list_filter(range(len(t)), lambda k: t[k + 1] = chr(1) || 'n') as spots from used
  union all select side, key, 'd', numbers, list_filter(range(len(t)), lambda k: t[k + 1] = chr(1) || 'd') from used),
slot as (select side, key, kind, spots[k] as pos, vals[k] as value from (select *, unnest(range(1, least(len(spots), len(vals)) + 1)) as k from places)),
pairs as (select best.key, best.ikey, a.kind, a.value as a, b.value as b from best join slot a on a.side = 1 and a.key = best.ikey join slot b on b.side = 0 and b.key = best.key and b.kind = a.kind and b.pos = a.pos + best.shift),
told as (select key, ikey, count(*) as n_slots, count(*) filter (where a <> b) as n_changed, count(distinct row(kind, a)) as ka, count(distinct row(kind, b)) as kb, count(distinct row(kind, a, b)) as kab from pairs group by all)
select d.id as doc_id, i.id as item_id, near.similarity, near.n_windows, coalesce(n_slots, 0)::bigint as n_slots, coalesce(n_changed, 0)::bigint as n_changed
from near join tmpl d on d.side = 0 and d.key = near.key join tmpl i on i.side = 1 and i.key = near.ikey left join told on told.key = near.key and told.ikey = near.ikey
where (told.key is null or (ka = kab and kb = kab)) and (len(i.t) >= 5 or coalesce(n_changed, 0) = 0)
"""
