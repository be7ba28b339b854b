"""SQL (DuckDB) for the rows of the registered queries that SQL can express on whole tables."""

from __future__ import annotations

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""with recursive w as (select doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') words from documents),
s as (select distinct doc_id, array_to_string(words[i : i + 4], ' ') sh from w, unnest(range(1, greatest(2, len(words) - 3))) t(i) where len(words) > 0),
n as (select doc_id, count(*) n, md5(string_agg(sh, chr(10) order by sh)) name from s group by 1),
common as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select doc_id, doc_id from w union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
least as (select a doc_id, min(b) component_id from reach group by 1),
class as (select name, min(doc_id) class_id from n group by 1)
select w.doc_id, coalesce(n.n, 0) n_shingles, component_id, coalesce(class_id, w.doc_id) class_id
from w join least using (doc_id) left join n using (doc_id) left join class using (name)"""

#: Texts as hexadecimal digits, in chunks of 4,096 starts with their windows.
OP2_SQL = """with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
chunks as (select doc_id, c, substr(h, 2 * c + 1, 2 * 4096 + 398) part, length(h) // 2 - 199 - c windows from d, unnest(range(0, length(h) // 2, 4096)) t(c)),
win as (select doc_id, c + j i, md5(substr(part, 2 * j + 1, 400)) m from chunks, unnest(range(0, least(4096, windows))) t(j) where windows > 0),
often as (select m from win group by 1 having count(*) > 1),
hit as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i) + 200, -1) begins from win semi join often using (m)),
numbered as (select doc_id, i, sum(begins::int) over (partition by doc_id order by i) run from hit),
runs as (select doc_id, run, min(i) a, max(i) + 200 b from numbered group by 1, 2),
pieces as (select doc_id, coalesce(lag(b) over w, 0) a, a b from runs window w as (partition by doc_id order by a)
  union all select doc_id, max(b), null from runs group by 1),
kept as (select doc_id, string_agg(case when pieces.b is null then substr(h, 2 * a + 1) else substr(h, 2 * a + 1, 2 * (b - a)) end, '' order by a) h from pieces join d using (doc_id) group by 1),
removed as (select doc_id, sum(b - a) n, count(*) spans from runs group by 1)
select doc_id, length(d.h) // 2 n_bytes, cast(coalesce(n, 0) as bigint) n_removed, coalesce(spans, 0) n_spans, sha256(unhex(coalesce(kept.h, d.h))) kept_sha256
from d left join kept using (doc_id) left join removed using (doc_id)"""

ITEM_WORDS = rf"regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""with i as (select item_id, {ITEM_WORDS} words from benchmark),
iw as (select distinct item_id, least(13, len(words)) n, array_to_string(words[k : k + least(13, len(words)) - 1], ' ') win
  from i, unnest(range(1, greatest(2, len(words) - 11))) t(k) where len(words) > 0),
w as (select doc_id, {ITEM_WORDS} words from documents),
dw as (select doc_id, k, n, array_to_string(words[k : k + n - 1], ' ') win from w, (select distinct n from iw), unnest(range(1, len(words) - n + 2)) t(k)),
hits as (select doc_id, k, n, item_id from dw join iw using (n, win)),
places as (select doc_id, count(distinct p) n_hit from (select distinct doc_id, k, n from hits), unnest(range(k, k + n)) t(p) group by 1),
items as (select doc_id, list_sort(list(distinct cast(item_id as varchar)) filter (item_id is not null)) x from hits group by 1)
select doc_id, len(words) n_words, coalesce(n_hit, 0) n_hit, coalesce(len(x), 0) n_items, sha256(array_to_string(coalesce(x, []), ',')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) contaminated
from w left join places using (doc_id) left join items using (doc_id)"""
