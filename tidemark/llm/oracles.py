"""DuckDB twins of the queries that SQL can say."""

from __future__ import annotations

from tidemark.llm import ngram_join, secrets, substring_dedup

WORD = r"[^\x20\x09-\x0D]+"

NGRAM_JOIN = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws from documents),
g as (select distinct doc_id, case when len(ws) >= {ngram_join.WORDS} then array_to_string(ws[i : i + {ngram_join.WORDS - 1}], ' ') else array_to_string(ws, ' ') end as s
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {ngram_join.WORDS - 2}, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by 1),
o as (select a.doc_id as x, b.doc_id as y, count(*) as o from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from o join n p on p.doc_id = x join n q on q.doc_id = y where 100 * o >= {ngram_join.PERCENT} * (p.n + q.n - o)),
c as (select doc_id as x, doc_id as r from documents union select l.y, c.r from c join l on l.x = c.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(c.r) as component_id from documents d left join n on n.doc_id = d.doc_id join c on c.x = d.doc_id group by 1, 2
"""

SUBSTRING_DEDUP = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
s as (select doc_id, i, array_to_string(ws[i : i + {substring_dedup.WINDOW - 1}], ' ') as t from (select doc_id, ws, unnest(range(1, len(ws) - {substring_dedup.WINDOW - 2})) as i from w where len(ws) >= {substring_dedup.WINDOW})),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by hash(t), t) as c from s) where c > 1),
x as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from w),
f as (select x.doc_id, x.i, x.word, max(r.i) over (partition by x.doc_id order by x.i rows unbounded preceding) as last from x left join r on r.doc_id = x.doc_id and r.i = x.i),
k as (select doc_id, count(*) as n_words, count(*) filter (where last is not null and i < last + {substring_dedup.WINDOW}) as n_removed, string_agg(word, ' ' order by i) filter (where last is null or i >= last + {substring_dedup.WINDOW}) as kept from f group by 1)
select w.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k on k.doc_id = w.doc_id
"""

_NIBBLE = "(instr('0123456789abcdef', substr(h, cast({} as int) + 1, 1)) - 1)"
_BASE32 = f"array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_NIBBLE.format('i * 5 // 4')} * 16 + {_NIBBLE.format('i * 5 // 4 + 1')}) >> (3 - i * 5 % 4)) & 31)::int + 1, 1) for i in range(32)], '')"

WARC = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h, min(page_id) over (partition by sha1(coalesce(html, ''))) as first from pages)
select page_id, payload_bytes, {_BASE32} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from p
"""

CRC32 = "xor(list_reduce(list_concat([4294967295], list_transform(range(len({0})), lambda i: ascii(substr({0}, i + 1, 1)))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _field(x: str) -> str:
    return f"coalesce(strlen(cast({x} as varchar)) || ':' || cast({x} as varchar), '-')"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_STEP = "select tree, level + 1, pos // 16, sha256(string_agg(digest, '' order by pos)), (n + 15) // 16 from {0} where n > 1 group by tree, level, pos // 16, n"
_RUN = "select l.tree, l.pos, {1} as stage, t.level, string_agg(t.digest, '' order by t.pos) filter (where t.pos < l.at // (16 ** t.level)::bigint) as a, string_agg(t.digest, '' order by t.pos) filter (where t.pos > l.at // (16 ** t.level)::bigint) as b from {2} l join {0} t on t.tree = l.{3} and t.n > 1 and t.pos // 16 = l.at // (16 ** (t.level + 1))::bigint group by 1, 2, 3, 4"

MERKLE = f"""
with recursive d as (select doc_id, coalesce('s' || source, '') as tree, {_LEAF.format('text')} as leaf, case when {CRC32.format('cast(doc_id as varchar)')} % 5 = 0 then {_LEAF.format(_LOWERED)} end as tampered from documents),
l as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from d),
t(tree, level, pos, digest, n) as (select tree, 0, pos, leaf, n from l union all {_STEP.format('t')}),
s as (select tree as source, digest as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as n from t where n = 1),
u(tree, level, pos, digest, n) as (select '', 0, pos, subroot, n from s union all {_STEP.format('u')}),
lower_leaf as (select tree, pos, pos as at from l),
upper_leaf as (select l.tree, l.pos, s.pos as at, '' as top from l join s on s.source = l.tree),
p as (select *, row_number() over (partition by tree, pos order by stage, level) as k from ({_RUN.format('t', 0, 'lower_leaf', 'tree')} union all {_RUN.format('u', 1, 'upper_leaf', 'top')})),
f(tree, pos, k, acc) as (select tree, pos, 0, coalesce(tampered, leaf) from l union all select f.tree, f.pos, f.k + 1, sha256(coalesce(p.a, '') || f.acc || coalesce(p.b, '')) from f join p on p.tree = f.tree and p.pos = f.pos and p.k = f.k + 1),
e as (select tree, pos, arg_max(acc, k) as folded_root from f group by 1, 2),
g as (select tree, pos, string_agg(coalesce(a, '') || coalesce(b, ''), '' order by k) as sib from p group by 1, 2)
select l.doc_id, l.leaf, s.subroot, r.digest as root, sha256(coalesce(g.sib, '')) as proof_sha256, e.folded_root, e.folded_root = r.digest as verified
from l join s on s.source = l.tree cross join (select digest from u where n = 1) r join e on e.tree = l.tree and e.pos = l.pos left join g on g.tree = l.tree and g.pos = l.pos
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _kind(k: int) -> str:
    """Matches of a kind: gaps, texts and values by place, and which count."""
    pattern = _quoted(secrets.PATTERNS[secrets.KINDS[k]])
    ok = {0: f"length(value) >= {secrets.LEAST}", 4: "regexp_matches(value, '[0-9]') and regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]')"}.get(k, "true")
    lists = f"regexp_extract_all(text, {pattern}, 0) as ms, regexp_extract_all(text, {pattern}, {0 if k else 2}) as vs, string_split_regex(text, {pattern}) as gs"
    return f"select doc_id, source, lang, {k} as kind, i, length(gs[i]) as gap, length(ms[i]) as size, vs[i] as value, {ok} as ok from (select *, unnest(range(1, len(ms) + 1)) as i, vs[i] as value from (select doc_id, source, lang, {lists} from d))"


_FREE = "not exists (select 1 from {} b where b.doc_id = p.doc_id and b.kind < p.kind and b.s < p.e and b.e > p.s)"
_SPANS = "coalesce(string_agg(list_extract([{0}], kind + 1) || ':' || s || ':' || e, ',' order by s, kind{1}, '')"

SECRETS = f"""
with d as (select doc_id, coalesce(text, '') as text, source, lang from documents),
m as ({" union all ".join(_kind(k) for k in range(len(secrets.KINDS)))}),
o as (select value, count(distinct coalesce('s' || source, '')) as owners, count(distinct coalesce('s' || source, '') || chr(0) || coalesce('s' || lang, '')) as repositories from m where ok group by 1),
p as (select * from (select *, cast(sum(gap + size) over (partition by doc_id, kind order by i) as bigint) as e, cast(sum(gap + size) over (partition by doc_id, kind order by i) as bigint) - size as s from m) where ok),
q as (select * from p where kind < 3 or kind = 3 and {_FREE.format('p')}),
r as (select * from q union all select * from p where kind = 4 and {_FREE.format('q')}),
j as (select r.*, kind < 3 as base, case when owners >= {secrets.WIDE_OWNERS} or repositories >= {secrets.WIDE_REPOSITORIES} then 'example' when owners = 1 then 'own' else 'shared' end as class, class = 'own' and not regexp_matches(value, {_quoted(secrets.PLACEHOLDER)}) as live from r join o using (value)),
c as (select doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex, count(*) filter (where base and live) as n_live, count(*) filter (where base and class = 'shared') as n_shared, count(*) filter (where base and class = 'example') as n_example,
  {_SPANS.format(", ".join(_quoted(k) for k in secrets.KINDS), ") filter (where base)")} as base, {_SPANS.format(", ".join(_quoted(k) for k in secrets.KINDS), ") filter (where base or live)")} as spans from j group by 1)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_shared, 0) as n_shared, coalesce(n_example, 0) as n_example from d left join c using (doc_id)
"""

SQL = {"op3_ngram_join": NGRAM_JOIN, "op5_substring_dedup": SUBSTRING_DEDUP, "op6_warc": WARC, "op11_merkle": MERKLE, "op13_secrets": SECRETS}
