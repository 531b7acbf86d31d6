"""SQL for the queries of this folder that SQL can express."""

_HITS = """
  select rid, {rank} as rank, '{kind}' as kind, k, m, part, least, sum(gap + len(m)) over (partition by rid order by k)::bigint as e from (
    select rid, unnest(range(1, len(ms) + 1)) as k, unnest(ms) as m, unnest(parts) as part, {least} as least,
           unnest(list_transform(gaps[1:len(ms)], lambda g: len(g))) as gap from (
      select rid, regexp_extract_all(text, '{regex}', 0) as ms, regexp_extract_all(text, '{regex}', {group}) as parts, string_split_regex(text, '{regex}') as gaps from d))"""

_HIGH = """
  select rid, {rank} as rank, '{kind}' as kind, s + min(i) as s, s + max(i) + {window} as e, substr(any_value(m), min(i) + 1, max(i) - min(i) + {window}) as m from (
    select *, sum(apart) over (partition by rid, k order by i) as island from (
      select *, coalesce((i - lag(i) over (partition by rid, k order by i) > {window})::int, 1) as apart from (
        select rid, k, m, e - len(m) as s, unnest(range(0, len(m) - {window} + 1)) as i from runs{rank})
      where list_entropy(string_split(substr(m, i + 1, {window}), '')) >= {bits} - 1e-9))
  group by rid, k, s, island"""


def secrets(patterns: tuple, classes: tuple, allowed: tuple[str, ...]) -> str:
    """Each window's entropy is taken from scratch here."""
    quoted = lambda x: x.replace("'", "''")
    base = "\n  union all".join(_HITS.format(rank=k, kind=p.kind, regex=quoted(p.regex), group=p.group, least=p.least) for k, p in enumerate(patterns))
    runs = ",\n".join(f"runs{k} as ({_HITS.format(rank=k, kind=c.kind, regex=f'[{c.alphabet}]{{{c.window},}}', group=0, least=0)})" for k, c in enumerate(classes, len(patterns)))
    high = "\n  union all".join(_HIGH.format(rank=k, kind=c.kind, window=c.window, bits=c.bits) for k, c in enumerate(classes, len(patterns)))
    harmless = " or ".join(f"regexp_matches(m, '{quoted(a)}')" for a in allowed)
    counts = ", ".join(f"count(*) filter (kind = '{p.kind}') as n_{p.kind}" for p in patterns)
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
base as (select rid, rank, kind, e - len(m) as s, e from ({base}) where len(part) >= least),
{runs},
high as (select rid, rank, kind, s, e from ({high}) where not ({harmless})),
found as (select *, kind || ':' || s || ':' || e as span from (select * from base union all select * from high)),
told as (
  select rid, {counts}, string_agg(span, ',' order by s, rank) as spans,
         string_agg(span, ',' order by s, rank) filter (rank < {len(patterns)}) as base from found group by rid)
select doc_id, {", ".join(f"coalesce(n_{p.kind}, 0) as n_{p.kind}" for p in patterns)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join told using (rid)
"""


DIALOGUES = r"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
  from conversations where conv_id is not null),
ids as (select distinct conv_id from t),
-- crc32 of the decimal digits, bit by bit
bits as (
  select conv_id, flatten(list_transform(string_split(conv_id::varchar, ''), lambda d: [ascii(d)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as steps from ids),
c as (
  select conv_id, conv_id - conv_id % 20 as base,
         xor(4294967295, list_reduce(list_prepend(4294967295::bigint, steps), lambda v, s: case when s >= 0 then xor(v, s) when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)) % 4 as h
  from bits),
seq as (
  select conv_id, row_number() over (partition by conv_id order by part, place) as depth, role, text from (
    select c.conv_id, 0 as part, t.place, t.role, t.text from c join t on t.conv_id = c.base and t.place <= c.h
    union all
    select conv_id, 1, place, role, text from t join c using (conv_id) where place > h)),
path as (
  select conv_id, depth, string_agg(md5(role) || md5(text), '') over (partition by conv_id order by depth) as node,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from seq
  union all
  select conv_id, 0, '', 0 from ids),
nodes as (select node, depth, count(*) as n_convs, min(conv_id) as conv_id, max(words) as words from path group by all),
kids as (select left(node, 64 * (depth - 1)) as node, count(*) as n_children from nodes where depth > 0 group by 1),
above as (select left(node, 64 * up) as node, (n_convs - 1) * words as gain, (node not in (select node from kids))::int as leaf from (select *, unnest(range(0, depth + 1)) as up from nodes)),
sums as (select node, sum(gain) as saved_tokens, sum(leaf) as n_leaves from above group by 1),
ends as (select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from path p where depth = (select max(depth) from path q where q.conv_id = p.conv_id) group by 1)
select n.conv_id, n.depth::bigint as depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children,
       s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from nodes n
left join nodes up on n.depth > 0 and up.node = left(n.node, 64 * (n.depth - 1))
left join kids k on k.node = n.node
join sums s on s.node = n.node
left join ends e on e.node = n.node
"""

PHRASES = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
ws as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, 1 as k, unnest(w) as phrase from ws
  union all
  select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from ws
  union all
  select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from ws),
f as (select lang, k, phrase, count(*)::hugeint as a from grams group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
cand as (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1 and a >= 10),
cuts as (
  select lang, k, phrase, a, w, unnest(range(1, k)) as c from cand),
scored as (
  select u.lang, u.k, u.phrase, u.a, u.c, x.a as l, y.a as r, (1000000::hugeint * u.a * u.a) // (x.a * y.a) as score
  from cuts u
  join f x on x.lang = u.lang and x.k = u.c and x.phrase = array_to_string(u.w[1:u.c], ' ')
  join f y on y.lang = u.lang and y.k = u.k - u.c and y.phrase = array_to_string(u.w[u.c + 1:u.k], ' ')),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
longer as (
  select lang, phrase, max(a) as longer from (
    select lang, array_to_string(w[1:2], ' ') as phrase, a from cand where k = 3
    union all select lang, array_to_string(w[2:3], ' '), a from cand where k = 3) group by all),
kept as (
  select w.* from weakest w left join longer g on g.lang = w.lang and g.phrase = w.phrase and w.k = 2
  where g.longer is null or 100 * g.longer < 50 * w.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank::int as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join n using (lang) where rank <= 2000
"""
