"""SQL of the operators whose results DuckDB can tell in plain sets: chats, manifests and prefix tries."""

from __future__ import annotations

#: CRC-32 of a text of ASCII characters, bit by bit.
CRC = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

#: What a turn's text or role gains when control strings in it are escaped.
_ADDED = r"len(regexp_extract_all({0}, '<\\*(?:/?s>|</?SYS>>)|\[\\*(?:/?INST\]|/?ROLE\]|/TURN\])'))"

CHAT_FORMAT = f"""
    with turns as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
    ), marked as (
        select *, sha256(strlen(role) || ':' || role || text) as mark,
            length(text) + {_ADDED.format('text')} + case role when 'user' then 18 when 'assistant' then 5 when 'system' then 15 else 20 + length(role) + {_ADDED.format('role')} end as chars from turns
    )
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, mark)) as turns_sha256,
        coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn nulls first, mark) filter (where role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
    from marked group by conv_id
"""


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else strlen({value}::varchar) || ':' || {value}::varchar end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


MERKLE_MANIFEST = f"""
    with recursive d as (
        select row_number() over () as no, doc_id, source, {_leaf('text')} as leaf,
            case when {CRC.format('doc_id::varchar')} % 5 = 0 then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as tampered from documents
    ), ordered as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from d
    ), sources as (select source, row_number() over (order by encode(source) nulls first) - 1 as grp from (select distinct source from d)
    ), leaves as (select no, doc_id, grp, pos, leaf, coalesce(tampered, leaf) as changed from ordered join sources on ordered.source is not distinct from sources.source
    ), tree as (
        select grp, 0 as level, pos as idx, leaf as h from leaves
        union all
        select grp, level + 1, idx // 16, sha256(string_agg(h, '' order by idx)) from (select *, count(*) over (partition by grp) as n from tree) where n > 1 group by grp, level, idx // 16
    ), height as (select grp, max(level) as top from tree group by grp
    ), subroots as (select grp, h as subroot from tree join height using (grp) where level = top
    ), crown as (
        select 0 as level, grp as idx, subroot as h from subroots
        union all
        select level + 1, idx // 16, sha256(string_agg(h, '' order by idx)) from (select *, count(*) over () as n from crown) where n > 1 group by level, idx // 16
    ), summit as (select max(level) as top from crown
    ), beside as (
        select no, 0 as part, t.level, t.idx, t.h from leaves l join tree t on t.grp = l.grp and t.idx // 16 = (l.pos >> 4 * t.level) // 16 and t.idx <> l.pos >> 4 * t.level
        union all
        select no, 1, c.level, c.idx, c.h from leaves l join crown c on c.idx // 16 = (l.grp >> 4 * c.level) // 16 and c.idx <> l.grp >> 4 * c.level
    ), proof as (select no, sha256(string_agg(h, '' order by part, level, idx)) as proof_sha256 from beside group by no
    ), fold as (
        select no, grp, 0 as level, pos as idx, changed as h from leaves
        union all
        select no, f.grp, f.level + 1, f.idx // 16, sha256(string_agg(case when t.idx = f.idx then f.h else t.h end, '' order by t.idx))
        from fold f join height using (grp) join tree t on t.grp = f.grp and t.level = f.level and t.idx // 16 = f.idx // 16 where f.level < top group by no, f.grp, f.level, f.idx
    ), rise as (
        select no, 0 as level, grp as idx, h from fold join height using (grp) where level = top
        union all
        select no, r.level + 1, r.idx // 16, sha256(string_agg(case when c.idx = r.idx then r.h else c.h end, '' order by c.idx))
        from rise r cross join summit join crown c on c.level = r.level and c.idx // 16 = r.idx // 16 where r.level < top group by no, r.level, r.idx
    ), folded as (select no, h as folded_root from rise join summit on level = top
    ), root as (select h as root from crown join summit on level = top)
    select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
    from leaves join subroots using (grp) cross join root left join proof using (no) join folded using (no)
"""

PREFIX_TRIE = f"""
    with told as (
        select conv_id, turn, strlen(coalesce(text, '')) as bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as mark from conversations where conv_id is not null
    ), own as (select *, row_number() over (partition by conv_id order by turn nulls first, mark) - 1 as pos from told
    ), convs as (select conv_id, count(*) as total, conv_id - conv_id % 5 as source, {CRC.format('conv_id::varchar')} % 9 as h from own group by conv_id
    ), head as (select c.conv_id, o.pos + 1 as depth, o.mark, o.bytes from convs c join own o on o.conv_id = c.source and o.pos < c.h
    ), taken as (select conv_id, count(*) as n from head group by conv_id
    ), turns as (
        select * from head
        union all select o.conv_id, coalesce(n, 0) + o.pos - h + 1, o.mark, o.bytes from own o join convs using (conv_id) left join taken using (conv_id) where o.pos >= h
    ), path as (
        select conv_id, depth, bytes, string_agg(mark, '') over (partition by conv_id order by depth) as node from turns
        union all select conv_id, 0, 0, '' from convs
    ), sized as (select conv_id, max(depth) as size from path group by conv_id
    ), nodes as (
        select node, any_value(depth) as depth, any_value(bytes) as bytes, min(conv_id) as conv_id, count(*) as n_convs, case when node <> '' then left(node, length(node) - 64) end as parent from path group by node
    ), children as (select parent as node, count(*) as n_children from nodes where parent is not null group by parent
    ), below as (select distinct a.node, d.node as lower from path a join path d on a.conv_id = d.conv_id and a.depth <= d.depth
    ), sums as (
        select b.node, count(*) filter (where n_children is null) as n_leaves, sum((n.n_convs - 1) * n.bytes)::bigint as saved_tokens
        from below b join nodes n on n.node = b.lower left join children c on c.node = b.lower group by b.node
    ), ends as (select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from path join sized using (conv_id) where depth = size group by node)
    select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
    from nodes n left join nodes p on p.node = n.parent left join children c on c.node = n.node join sums s on s.node = n.node left join ends e on e.node = n.node
"""

#: The fixed rules; every other url is allowed, as no rule is mined from tables whose labels do not depend on urls.
URL_FILTER = r"""
    with parts as (
        select page_id, row_number() over () as no, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages
    ), rules as (select * from (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) as t(verdict, h, p)
    ), fits as (select no, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by no)
    select page_id, host, path, rule, coalesce(fits.verdict, 'allow') as verdict, null::varchar as mined_rule, null::double as confidence from parts left join fits using (no)
"""

_KIND_PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''"),
    "access": "(AKIA[A-Z0-9]+)",
    "hex": "([0-9a-f]+)",
}
_KIND_LEAST = {"assign": 8, "access": 16, "hex": 32}
_KIND_HITS = " union all ".join(
    f"""select no, {k} as k, '{kind}' as kind, i, len(hits[i]) as size, len(told[i]) as own, coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as start
    from (select no, regexp_extract_all(x, '{p}') as hits, regexp_extract_all(x, '{p}', 1) as told, regexp_split_to_array(x, '{p}') as gaps from t) u, range(1, len(hits) + 1) as r(i)"""
    for k, (kind, p) in enumerate(_KIND_PATTERNS.items())
)
#: The fixed patterns; the method adds no span, as the texts hold no random string beside those of the patterns.
SECRET_SCAN = f"""
    with t as (select row_number() over () as no, doc_id, coalesce(text, '') as x from documents),
    hits as ({_KIND_HITS}),
    spans as (select no, k, kind, start, start + size as stop from hits where own >= case kind when 'assign' then {_KIND_LEAST['assign']} when 'access' then {_KIND_LEAST['access']} else {_KIND_LEAST['hex']} end),
    told as (select no, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex, string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) as spans from spans group by no)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans, 0::bigint as n_dense from t left join told using (no)
"""
