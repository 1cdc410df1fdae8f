"""DuckDB SQL for the queries of this subpackage that SQL can express."""

CURRENT = """
cur as (
  select * from scan_split where uid is not null
  qualify row_number() over (partition by uid order by run_at desc) = 1)"""

# The letters and digits of full width, the only ones in the captions that NFKC changes.
WIDE = "".join(chr(c) for r in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(*r))
PLAIN = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)

ORACLES: dict[str, str] = {
    "p1_found": f"""
with recursive {CURRENT},
clean as (
  select uid, dup_group, upper(regexp_replace(bag_tag, '[^\\p{{L}}\\p{{N}}]', '', 'g')) as c from cur),
node as (
  select uid, case when regexp_matches(c, '[1-9]') then 't' || c end as t, case when dup_group >= 0 then 'g' || dup_group end as g from clean),
edge as (
  select distinct t as a, g as b from node where t is not null and g is not null
  union select distinct g, t from node where t is not null and g is not null),
reach(n, r) as (
  select coalesce(t, g), coalesce(t, g) from node where coalesce(t, g) is not null
  union select edge.b, reach.r from reach join edge on edge.a = reach.n),
root as (select n, min(r) filter (r like 't%') as r, min(r) as any_r from reach group by n),
member as (
  select uid, any_r, root.r from node join root on root.n = coalesce(t, g))
select uid, substr(r, 2) as group_tag from member
where any_r in (select any_r from member group by any_r having count(*) > 1)
""",
    "p2_found": f"""
with {CURRENT},
ok as (select uid, part, labels from cur where cache_ok and labels is not null),
has as (
  select distinct uid, part, c from (select uid, part, unnest(labels) as c from ok) where c between 0 and 19
  union all select uid, part, -1 from ok where len(labels) = 0),
supply as (select part, c, count(*) as n from has group by part, c)
select t.part, t.class_id from sample_targets t left join supply s on s.part = t.part and s.c = t.class_id
where greatest(t.min_rows, (t.share_permille * t.sample_rows + 999) // 1000) > coalesce(s.n, 0)
""",
    "p6_found": f"""
with {CURRENT},
plain as (select uid, part, sig_d, sig_a, lower(replace(url_decode(replace(img_path, '+', '%2B')), chr(92), '/')) as p from cur),
dots as (select *, regexp_replace(regexp_replace(p, '/(\\./)*/*', '/', 'g'), '/+(\\./+)*', '/', 'g') as q from plain),
named as (select uid, part, sig_d, sig_a, regexp_extract(regexp_replace(q, '/[^/]+/\\.\\./', '/', 'g'), 'stcray_.*$') as f from dots),
tr as (select * from named where part = 'train'),
ev as (select * from named where part in ('val', 'test')),
pairs as (
  select tr.uid as a, ev.uid as b from tr join ev on tr.f = ev.f and tr.f <> ''
  union
  select tr.uid, ev.uid from tr, ev
  where bit_count(xor(tr.sig_d, ev.sig_d)) + bit_count(xor(tr.sig_a, ev.sig_a)) <= 12
    and not (tr.sig_d = 0 and tr.sig_a = 0) and not (ev.sig_d = 0 and ev.sig_a = 0))
select least(a, b) as uid_a, greatest(a, b) as uid_b from pairs
""",
    "p3_found": f"""
with recursive cur as (
  select uid, caption from scan_index where uid is not null qualify row_number() over (partition by uid order by indexed_at desc) = 1),
sets as (
  select uid, list_distinct(regexp_extract_all(lower(translate(caption, '{WIDE}', '{PLAIN}')), '[\\p{{L}}\\p{{N}}]+')) as w from cur where caption is not null),
long as (select uid, w, len(w) as n from sets where len(w) >= 15),
word as (select uid, n, unnest(w) as x from long),
shared as (select a.uid as a, b.uid as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from word a join word b on a.x = b.x and a.uid < b.uid group by a.uid, b.uid),
link as (select a, b from shared where 10 * c >= 7 * (na + nb - c)),
way as (select a, b from link union select b, a from link),
reach(n, r) as (select a, a from way union select way.b, reach.r from reach join way on way.a = reach.n),
grp as (select n, min(r) as g from reach group by n)
select x.n as uid_a, y.n as uid_b from grp x join grp y on x.g = y.g and x.n < y.n
""",
    "p3_groups": f"""
with recursive cur as (
  select uid, caption from scan_index where uid is not null qualify row_number() over (partition by uid order by indexed_at desc) = 1),
sets as (
  select uid, list_distinct(regexp_extract_all(lower(translate(caption, '{WIDE}', '{PLAIN}')), '[\\p{{L}}\\p{{N}}]+')) as w from cur where caption is not null),
long as (select uid, w, len(w) as n from sets where len(w) >= 15),
word as (select uid, n, unnest(w) as x from long),
shared as (select a.uid as a, b.uid as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from word a join word b on a.x = b.x and a.uid < b.uid group by a.uid, b.uid),
link as (select a, b from shared where 10 * c >= 7 * (na + nb - c)),
way as (select a, b from link union select b, a from link),
reach(n, r) as (select a, a from way union select way.b, reach.r from reach join way on way.a = reach.n),
grp as (select n, min(r) as g from reach group by n),
deg as (select a as n, count(*) as links from way group by a)
select grp.n as uid, g as "group", links from grp join deg using (n)
""",
}
