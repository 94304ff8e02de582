"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from . import quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP7 = rf"""
with sized as materialized (
  select doc_id, source, cast(len({WORDS}) as bigint) size from documents),
ranked as (
  select *, case when size > 0 then length(bin(size)) else 0 end k,
    (cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 12) as bigint) + 0.5::double) / 281474976710656::double u
  from sized),
src as (select source, cast(sum(size) as bigint) source_size from sized group by source),
w as (select *, (row_number() over (order by source is null, encode(source)) - 1) % 3 + 1 w from src),
fill as (
  select *, sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by source_size::double / w, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0) rest,
    sum(w) over () - coalesce(sum(w) over (order by source_size::double / w, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0) rest_w
  from w),
full_ as (select *, 3 * source_size * rest_w < rest * w is_full from fill),
lvl as (select rest, rest_w from full_ where not is_full order by rest_w desc limit 1),
tgt as (
  select f.source, f.source_size, case when is_full then (3 * source_size)::double else lvl.rest::double * f.w / lvl.rest_w end target
  from full_ f, lvl),
cls as (select source, k, sum(size) words from ranked group by source, k),
cls2 as (
  select c.*, t.source_size, t.target,
    target - 3 * coalesce(sum(words) over (partition by c.source order by k desc rows between unbounded preceding and 1 preceding), 0)::double l,
    (sum((16 + k) * words) over (partition by c.source) - coalesce(sum((16 + k) * words) over (partition by c.source order by k desc rows between unbounded preceding and 1 preceding), 0))::double la
  from cls c join tgt t on c.source is not distinct from t.source),
cls3 as (select *, l * (16 + k) > 3.0::double * la is_full from cls2),
lam as (select source, arg_max(l, la) l, max(la) la from cls3 where not is_full group by source),
ex as (
  select c.*, case when c.is_full then 3.0::double else least(3.0::double, greatest(0.0::double, (case when lam.la > 0 then lam.l / lam.la else 0.0::double end) * (16 + k))) end e
  from cls3 c left join lam on c.source is not distinct from lam.source),
pr as (select *, floor(e) whole, e - floor(e) p from ex),
need as (select source, any_value(target) - sum(whole * words)::double need from pr group by source),
key as (
  select r.doc_id, r.source, r.size, p.whole, p.source_size, p.target, n.need,
    case when p.p > 0 then ((u / (1 - u)) / (p.p / (1 - p.p))) / (1 + (u / (1 - u)) / (p.p / (1 - p.p))) end t
  from ranked r join pr p on r.source is not distinct from p.source and r.k = p.k
  join need n on r.source is not distinct from n.source),
cum as (
  select *, sum(case when t is not null then size else 0 end) over (partition by source order by t nulls last, doc_id, size rows between unbounded preceding and current row) upto
  from key)
select doc_id, size, cast(source_size as bigint) source_size, target,
  cast((whole + case when t is not null and (upto + upto - size)::double < 2 * need then 1 else 0 end) * size as bigint) taken,
  cast(whole + case when t is not null and (upto + upto - size)::double < 2 * need then 1 else 0 end as bigint) copies
from cum
"""


# Robust outliers by L D L' elimination, with concentration as a recursion. Fixed values, as in quality: 0.75 and 0.975
# shares of chi-squared with 4 degrees of freedom (and the factors that make their scatter consistent), floors, cutoff.
_LDL = """
  c00 d0, c10 / d0 a10, c20 / d0 a20, c30 / d0 a30, c11 - a10 * c10 d1, c21 - a20 * c10 e21, c31 - a30 * c10 e31, e21 / d1 a21, e31 / d1 a31,
  c22 - a20 * c20 - a21 * e21 d2, c32 - a30 * c20 - a31 * e21 e32, e32 / d2 a32, c33 - a30 * c30 - a31 * e31 - a32 * e32 d3, ln(d0) + ln(d1) + ln(d2) + ln(d3) ld"""
_DISTANCE = """
  x0 - m0 z0, x1 - m1 - a10 * z0 z1, x2 - m2 - a20 * z0 - a21 * z1 z2, x3 - m3 - a30 * z0 - a31 * z1 - a32 * z2 z3,
  z0 * z0 / d0 + z1 * z1 / d1 + z2 * z2 / d2 + z3 * z3 / d3 far"""
_EST = "m0, m1, m2, m3, d0, d1, d2, d3, a10, a20, a21, a30, a31, a32"


def _scatter(scale: float) -> str:
    floors = [f ** 2 for f in quality.FLOORS]
    means = ", ".join(f"sum(x{i})::double / count(*) m{i}" for i in range(4))
    return means + ", " + ", ".join(f"{scale!r}::double * (sum(x{i} * x{j})::double / count(*) - m{i} * m{j}) + {floors[i] if i == j else 0.0!r}::double c{i}{j}" for i in range(4) for j in range(i + 1))


OP10 = rf"""
with recursive w as materialized (
  select doc_id, lang, source, coalesce(text, '') txt, {WORDS} ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls from documents),
wins as (select doc_id, i, ws[i] a, ws[i + 1] b, ws[i + 2] c from (select doc_id, unnest(range(1, len(ws) - 1)) i, ws from w where len(ws) >= 3)),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, a, b, c) n from wins) where n > 1),
cov as (select doc_id, cast(count(distinct j) as bigint) n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) j from rep) group by doc_id),
base as (
  select w.doc_id, lang, source, cast(len(ws) as bigint) n_words, cast(length(array_to_string(ws, '')) as bigint) word_chars,
    cast(length(regexp_replace(txt, '[^#*$%&|<>]+', '', 'g')) as bigint) n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words, cast(len(ls) as bigint) n_lines
  from w left join cov on w.doc_id = cov.doc_id),
st as materialized (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from base),
xs as materialized (
  select *, coalesce('s' || lang, 'n') || ' ' || coalesce('s' || source, 'n') own, '*' || coalesce('s' || lang, 'n') wide,
    case when not base_failed then least(floor(64 * word_chars::double / n_words), {quality.LONGEST})::bigint end x0,
    case when not base_failed then floor(1024 * sqrt(n_symbols::double / word_chars))::bigint end x1,
    case when not base_failed then floor(1024 * sqrt(n_dup_lines::double / n_lines))::bigint end x2,
    case when not base_failed then floor(1024 * sqrt(n_repeat_words::double / n_words))::bigint end x3 from st),
v0 as (select unnest([own, wide]) g, x0, x1, x2, x3 from xs where not base_failed),
sizes as materialized (select g from v0 group by g having count(*) >= {quality.LEAST}),
v as materialized (select v0.* from v0 join sizes on v0.g = sizes.g),
mid as materialized (
  select g, {', '.join(f'quantile_cont(x{i}, 0.5) m{i}, greatest((quantile_cont(x{i}, 0.75) - quantile_cont(x{i}, 0.25)) / 1.349, {quality.FLOORS[i]!r}::double) l{i}' for i in range(4))} from v group by g),
off as (select v.*, least(floor(16 * greatest({', '.join(f'abs(x{i} - m{i}) / l{i}' for i in range(4))})), 65535) b from v join mid on v.g = mid.g),
half as (select g, quantile_cont(b, 0.5) most from off group by g),
inner_ as (select off.* from off join half on off.g = half.g where b <= most),
est as (
  select 0 step, g, 0 k, m0, m1, m2, m3, l0 ** 2 d0, l1 ** 2 d1, l2 ** 2 d2, l3 ** 2 d3, 0.0::double a10, 0.0::double a20, 0.0::double a21, 0.0::double a30, 0.0::double a31, 0.0::double a32, 0.0::double ld from mid
  union all select 0, g, 1, {_EST}, ld from (select *, {_LDL} from (select g, {_scatter(1.0)} from v group by g))
  union all select 0, g, 2, {_EST}, ld from (select *, {_LDL} from (select g, {_scatter(1.0)} from inner_ group by g))),
run as (
  select * from est
  union all
  select step + 1, g, k, {_EST}, ld from (
    select *, {_LDL} from (
      select step, g, k, before, {_scatter(quality.consistency(quality.CORE))} from (
        select *, quantile_cont(b, {quality.CORE}) over (partition by g, k) most from (
          select step, v.g, k, ld before, x0, x1, x2, x3, {_DISTANCE}, least(floor(16 * far), 65535) b from v join run on v.g = run.g where step < {quality.STEPS}))
      where b <= most group by step, g, k, before))
  where step = 0 or ld < before - 0.001),
last_ as (select * from run qualify row_number() over (partition by g, k order by step desc) = 1),
pick as (select * from last_ qualify row_number() over (partition by g order by ld, k) = 1),
near as (select v.g, x0, x1, x2, x3, {_DISTANCE} from v join pick on v.g = pick.g),
fin as materialized (select *, {_LDL} from (select g, {_scatter(quality.consistency(0.975))} from near where far <= {quality.CHI_975} group by g)),
every as (select xs.*, case when own in (select g from sizes) then own else wide end g from xs),
judged as (select every.*, {_DISTANCE} from every left join fin on every.g = fin.g)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(far <= {quality.CUTOFF}, true) kept from judged"""


OP5 = r"""
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
c as (
  select conv_id, list({'role': role, 'text': text} order by turn, role, text) turns,
    string_agg('<|' || replace(coalesce(role, 'unknown'), '|', '\|') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<\|') || chr(10) || '<|end|>' || chr(10), '' order by turn, role, text) text
  from t group by conv_id),
g as (select turns, min(conv_id) conv_id, count(*) n_same from c group by turns),
p as (select distinct turns[1:n] turns from (select turns, unnest(range(1, len(turns))) n from g))
select g.conv_id, cast(len(g.turns) as bigint) n_turns, cast(g.n_same as bigint) n_same, c.text
from g join c on g.conv_id = c.conv_id where g.turns not in (select turns from p)
"""

OP3 = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) at_ from documents),
s0 as (select doc_id, at_, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) ws from l),
s as materialized (select * from s0 where len(ws) >= 1),
c as materialized (select ws, len(ws) n, min(doc_id * 1000000 + at_) f from s group by ws),
t as (select f, n, unnest(ws) w from c where n >= 4),
df as (select w, count(*) df from t group by w),
r as (select f, n, t.w, row_number() over (partition by f order by df, t.w) k from t join df on t.w = df.w),
p as materialized (select f, n, w from r where k <= n - ceil(n * 4 / 5.0) + 1),
cand as (select distinct a.f x, b.f y from p a join p b on a.w = b.w and a.f < b.f and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n),
pair as materialized (
  select x, y from cand join c a on a.f = x join c b on b.f = y
  where 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n)),
link as (select y f, min(x) m from pair group by y),
cls as (select c.ws, c.f, coalesce(m, c.f) first_, m is not null linked from c left join link on c.f = link.f),
per as (
  select s.doc_id, count(*) n_removed, count(*) filter (where linked) n_links, string_agg(at_ || '>' || (first_ // 1000000) || ':' || (first_ % 1000000), ',' order by at_) removed
  from s join cls on s.ws = cls.ws where s.doc_id * 1000000 + at_ > first_ group by s.doc_id)
select d.doc_id, cast(len(string_split(coalesce(text, ''), chr(10))) as bigint) n_lines, coalesce(n_removed, 0) n_removed, coalesce(n_links, 0) n_links, coalesce(removed, '') removed
from documents d left join per on d.doc_id = per.doc_id
"""

OP8 = rf"""
with w as materialized (select doc_id, {WORDS} ws from documents),
win as materialized (
  select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) i from w where len(ws) >= 50)),
early as (select h, min(doc_id) first_ from win group by h having count(distinct doc_id) > 1),
gone as (
  select win.doc_id, list_distinct(flatten(list(range(i, i + 50)))) at_ from win join early on win.h = early.h where win.doc_id > first_ group by win.doc_id),
kept as (
  select w.doc_id, ws, case when at_ is null then ws else list_transform(list_sort(list_filter(range(1, len(ws) + 1), lambda k: not list_contains(at_, k))), lambda k: ws[k]) end left_
  from w left join gone on w.doc_id = gone.doc_id)
select doc_id, cast(len(ws) as bigint) n_words, cast(len(ws) - len(left_) as bigint) n_removed, sha256(array_to_string(left_, ' ')) kept_sha256 from kept
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12 = rf"""
with d as materialized (select row_number() over () r, doc_id, {_ALNUM} ws from documents),
b as (select item_id, {_ALNUM} ws from benchmark),
bw as (
  select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') w
  from (select *, unnest(range(1, len(ws) - n + 2)) i from (select *, least(len(ws), 10) n from b where len(ws) > 0))),
dw as (
  select r, i, n, array_to_string(ws[i:i + n - 1], ' ') w
  from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) i from d, (select distinct n from bw) where len(ws) >= n)),
hit as materialized (select dw.* from dw where (n, w) in (select n, w from bw)),
places as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from hit) group by r),
items as (
  select r, count(*) n_items, sha256(string_agg(item, ',' order by item)) items_sha256
  from (select distinct r, cast(item_id as varchar) item from (select distinct r, n, w from hit) h join bw using (n, w)) group by r)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(items_sha256, sha256('')) items_sha256, n_hit is not null contaminated
from d left join places using (r) left join items using (r)
"""

#: CRC-32 of a string of characters up to U+00FF: its table of 256 entries (by the polynomial, reflected), and the fold over bytes.
_CRC = """crc as materialized (
  select list(c order by i) tb from (select i, list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i) c from range(256) t(i)))"""


def _crc32(of: str) -> str:
    bytes_ = f"flatten(list_transform(string_split({of}, ''), lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [195::bigint, ord(x)::bigint - 64] end))"
    return f"xor(list_reduce({bytes_}, lambda a, k: xor(a >> 8, tb[(xor(a, k) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"


OP11 = rf"""
with recursive {_CRC},
runs as (select coalesce(cast(doc_id as varchar), '') d, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) w from documents),
per as (select d, w, count(*) n from runs group by d, w),
hashed as (select w, n, {_crc32("d || ':' || w")} h from per, crc),
typed as (select case when h % 97 = 0 then w[:h % length(w)] || w[h % length(w) + 2:] else w end w, n from hashed),
v as materialized (select w, cast(sum(n) as bigint) n from typed where length(w) >= 5 group by w having sum(n) >= 3),
del as materialized (select w, n, i, w[:i - 1] || w[i + 1:] s from (select w, n, unnest(range(1, length(w) + 1)) i from v)),
near as (
  select a.w, b.w o, b.n m from del a join del b on a.s = b.s and a.i = b.i and a.w <> b.w
  union select d.w, v.w, v.n from del d join v on d.s = v.w
  union select v.w, d.w, d.n from del d join v on d.s = v.w),
best as (select w, count(*) n_near, (list(o order by m desc, o))[1] o, max(m) m from near group by w),
f as materialized (select v.w, n, coalesce(n_near, 0) n_near, case when m >= 2 * n then o end form, case when m >= 2 * n then m end form_n from v left join best using (w)),
path as (
  select w, w at_ from f
  union all select path.w, f.form from path join f on path.at_ = f.w where f.form is not null),
ends as (select path.w, at_ root from path join f on path.at_ = f.w where f.form is null)
select f.w word, form, root, n, n_near, form_n from f join ends using (w)
"""

OP13 = rf"""
with {_CRC},
t as (
  select conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) x, len({WORDS}) words,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) at_
  from conversations where conv_id is not null),
c as (select conv_id, {_crc32("cast(conv_id as varchar)")} % 4 h from (select distinct conv_id from t), crc),
r as (
  select c.conv_id, 0 part, at_, x, words from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and at_ <= h
  union all select c.conv_id, 1, at_, x, words from c join t on t.conv_id = c.conv_id and at_ > h),
path as materialized (
  select c.conv_id, coalesce(xs, []) xs, coalesce(ws, []) ws
  from c left join (select conv_id, list(x order by part, at_) xs, list(words order by part, at_) ws from r group by conv_id) p on c.conv_id = p.conv_id),
mem as materialized (
  select conv_id, d, md5(array_to_string(xs[1:d], '')) k, case when d > 0 then md5(array_to_string(xs[1:d - 1], '')) end up, case when d > 0 then ws[d] else 0 end words, d = len(xs) ends
  from (select *, unnest(range(0, len(xs) + 1)) d from path)),
node as materialized (
  select k, any_value(d) d, any_value(up) up, any_value(words) words, count(*) n, min(conv_id) low, string_agg(conv_id, ',' order by conv_id) filter (where ends) ids from mem group by k),
kids as (select up k, count(*) n_children from node where up is not null group by up),
below as (
  select mem.k, count(*) filter (where n_children is null) n_leaves, sum((node.n - 1) * node.words) saved
  from node left join kids using (k) join mem on mem.conv_id = node.low and mem.d <= node.d group by mem.k)
select node.low conv_id, cast(node.d as bigint) depth, up.low parent_conv_id, node.n n_convs, coalesce(n_children, 0) n_children, n_leaves, cast(saved as bigint) saved_tokens, sha256(coalesce(node.ids, '')) ends_sha256
from node left join node up on node.up = up.k left join kids on node.k = kids.k join below on node.k = below.k
"""

ORACLES = {"op13_conversation_prefix_trie": OP13, "op11_spelling_variants": OP11, "op12_benchmark_decontamination": OP12, "op8_substring_dedup": OP8, "op3_line_dedup": OP3, "op5_chat_formatting": OP5, "op7_mix_sources": OP7, "op10_quality_rules": OP10}
