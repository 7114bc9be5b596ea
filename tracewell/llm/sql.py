"""DuckDB SQL that the registered queries must equal, where SQL can express it."""

from __future__ import annotations

#: CRC-32's table of 256 values by its rule: eight steps of the reversed polynomial.
CRC_TABLE = "select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as crcs"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, with the table `crcs` at hand."""
    code = f"hex(encode({text}))"
    octets = f"list_transform(range(0, length({code}), 2), lambda i: strpos('0123456789ABCDEF', {code}[i + 1]) * 16 + strpos('0123456789ABCDEF', {code}[i + 2]) - 17)"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295))"


EXACT_TOPK = """
    with v as (
        select row_number() over () as own, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
        from embeddings
        where vec_id is not null and len(embedding) > 0
          and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    scored as (
        select q.own, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
        from v q join v c on q.vec_id % 50 = 0 and q.own <> c.own and len(q.e) = len(c.e)),
    ranked as (select *, cast(row_number() over (partition by own order by score desc, vec_id) as integer) as rank from scored)
    select query_id, rank, vec_id, score from ranked where rank <= 5
"""

SPELLING = f"""
    with recursive z as ({CRC_TABLE}),
    runs as (
        select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) as run
        from documents),
    own as (select id, run, count(*) as k from runs group by all),
    digests as (select run, k, {crc32("id || ':' || run")} as h from own, z),
    results as (select case when h % 31 = 0 then substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) else run end as word, k from digests),
    words as (select word, cast(sum(k) as bigint) as n from results where length(word) >= 7 group by word having sum(k) >= 2),
    cut as (select word, n, i, substring(word, 1, i) || substring(word, i + 2) as rest from words, lateral (select unnest(range(length(word))) as i)),
    shorter as (select distinct c.word, w.word as other from cut c join words w on w.word = c.rest),
    pairs as (
        select a.word, b.word as other from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
        union select word, other from shorter union select other, word from shorter),
    near as (select p.word, count(*) as n_near, arg_min(struct_pack(w := p.other, n := o.n), (-o.n, p.other)) as best from pairs p join words o on o.word = p.other group by p.word),
    forms as (
        select w.word, w.n, coalesce(n_near, 0) as n_near, case when best.n >= 10 * w.n then best.w end as form, case when best.n >= 10 * w.n then best.n end as form_n
        from words w left join near using (word)),
    chains as (select word, word as root, form as next from forms union all select c.word, f.word, f.form from chains c join forms f on f.word = c.next)
    select f.word, f.form, c.root, f.n, f.n_near, f.form_n from forms f join chains c on c.word = f.word and c.next is null
"""

PREFIX_TRIE = f"""
    with z as ({CRC_TABLE}),
    t as (
        select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as txt, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
        from conversations where conv_id is not null),
    counts as (select c, count(*) as n from t group by c),
    heads as (select c, c - c % 20 as first, {crc32("cast(c as varchar)")} % 4 as h from counts, z),
    taken as (select k.c, first, h, least(h, coalesce(n, 0)) as taken from heads k left join counts m on m.c = k.first),
    rebuilt as (
        select c, pos - h + taken as pos, role, txt from t join taken using (c) where pos > h
        union all select k.c, t.pos, role, txt from taken k join t on t.c = k.first and t.pos <= k.taken),
    turns as (select c, 0 as d, '' as own, 0 as words from counts union all select c, pos, sha256(length(role) || ':' || role || txt), len(regexp_extract_all(txt, '[^\\x20\\x09-\\x0D]+')) from rebuilt),
    paths as (select c, d, words, string_agg(own, '') over (partition by c order by d) as path, max(d) over (partition by c) as n from turns),
    ways as (select *, lag(path) over (partition by c order by d) as up from paths),
    nodes as (select path, min(c) as conv_id, max(d) as depth, count(*) as n_convs, max(words) as words, min(up) as up from ways group by path),
    children as (select up, count(*) as k from nodes where up is not null group by up),
    full_nodes as (select n.*, coalesce(k, 0) as n_children from nodes n left join children c on c.up = n.path),
    below as (
        select w.path, count(*) filter (v.n_children = 0) as n_leaves, cast(sum((v.n_convs - 1) * v.words) as bigint) as saved_tokens
        from full_nodes v join ways w on w.c = v.conv_id and w.d <= v.depth group by w.path),
    ends as (select path, sha256(string_agg(cast(c as varchar), ',' order by c)) as digest from ways where d = n group by path)
    select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, coalesce(digest, sha256('')) as ends_sha256
    from full_nodes n join below using (path) left join ends using (path) left join nodes p on p.path = n.up
"""
