"""SQL for DuckDB that gives what the registered queries give."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Letters of two bytes in UTF-8, and as many of one byte that lower-cased words do not hold.
WIDE = "".join(chr(c) for c in range(0xC0, 0x100))
NARROW = "".join(c for c in map(chr, range(0x20, 0x7F)) if not c.islower() and c not in "'\\")[: len(WIDE)]


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text: the reversed polynomial, bit by bit."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::bigint)"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], {data}), lambda c, b: {step}))"


ORACLES = {
    "op1_ngram_jaccard_join": f"""
    with recursive words as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents
    ), sets as (
        select doc_id, case when len(w) = 0 then []
            when len(w) < 4 then [array_to_string(w, ' ')]
            else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
        from words
    ), tokens as (
        select doc_id, len(s) as n, unnest(s) as token from sets
    ), shared as (
        select a.doc_id as a, b.doc_id as b, a.n + b.n - count(*) as in_all, count(*) as in_both
        from tokens a join tokens b on a.token = b.token and a.doc_id < b.doc_id
        group by a.doc_id, b.doc_id, a.n, b.n
    ), links as (
        select a, b from shared where 100 * in_both >= 85 * in_all
        union all
        select b, a from shared where 100 * in_both >= 85 * in_all
    ), reached(doc_id, other) as (
        select doc_id, doc_id from documents
        union
        select reached.doc_id, links.b from reached join links on reached.other = links.a
    )
    select sets.doc_id, len(s)::bigint as n_shingles, min(other) as component_id
    from sets join reached using (doc_id) group by sets.doc_id, s
    """,
    "op2_source_mixture": f"""
    with sizes as (
        select doc_id, coalesce(source, '') as source, source is null as last, md5(doc_id::varchar) as place,
            len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size
        from documents
    ), sources as (
        select source, last, sum(size)::bigint as total,
            [5.0, 2.0, 1.0][(row_number() over (order by last, source) - 1) % 3 + 1]::double as weight,
            [1.5, 1.0, 0.5][(row_number() over (order by last, source) - 1) % 3 + 1]::double as slope
        from sizes group by source, last
    ), ordered as (
        select *, (3 * total)::double as most, sum(total) over ()::double as all_words,
            row_number() over (order by (3 * total)::double / weight, last, source) as nth
        from sources
    ), shares as (
        select *, (all_words - coalesce(sum(most) over (order by nth rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by nth rows between current row and unbounded following) as share
        from ordered
    ), targets as (
        select *, most <= share * weight as is_full, max(case when most > share * weight then share end) over () as final
        from shares
    ), placed as (
        select s.*, t.total, t.weight, t.slope, case when t.is_full then t.most else t.final * t.weight end as target,
            sum(s.size) over (partition by s.source, s.last order by s.place, s.doc_id) - s.size + s.size / 2.0 as middle
        from sizes s join targets t on s.source = t.source and s.last = t.last
    ), copies as (
        select *, middle + e * total as at_word from placed, (select unnest([0, 1, 2]) as e)
        where middle + e * total < target and (size > 0 or e = 0)
    ), timed as (  -- the schedule goes from slope to 2 - slope, times the weight; its integral is inverted
        select doc_id, at_word / target * weight as area, weight * slope as a, weight * (2 - slope) as b from copies
    ), positions as (
        select doc_id, case when area > 0 then least(2.0::double * area / (a + sqrt(greatest(a * a + 2.0::double * ((b - a) / 1.0::double) * area, 0))), 1) else 0 end as position
        from timed
    ), places as (
        select doc_id, count(*) as n, min(place) as first_place, max(place) as last_place
        from (select doc_id, row_number() over (order by position, doc_id) as place from positions) group by doc_id
    )
    select doc_id, size, total as source_size, target, (size * coalesce(n, 0))::bigint as taken, first_place, last_place
    from placed left join places using (doc_id)
    """,
    "op4_stratified_shards": f"""
    with ranked as (
        select doc_id, coalesce(octet_length(encode(text)), 0)::bigint + 1 as size, {crc32("coalesce(text, '')")} as text_crc32,
            coalesce(source, '') as source, source is null as last, md5(doc_id::varchar) as place,
            count(*) over (partition by source) as n,
            row_number() over (partition by source order by md5(doc_id::varchar), doc_id) as r
        from documents
    ), numbered as (
        select *, row_number() over (order by (2 * r - 1) / (2.0::double * n), last, source, place, doc_id) - 1 as spot,
            count(*) over () as total
        from ranked
    )
    select doc_id, size, text_crc32, 'rows' as law, (spot * 8 // total)::int as shard,
        (spot - ceil((spot * 8 // total) * total / 8.0))::bigint as slot, null::int as grown_shard
    from numbered
    """,
    "op9_exact_dedup": """
    select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
        doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window same as (partition by coalesce(text, ''))
    """,
    "op11_spelling_variants": f"""
    with recursive runs as (
        select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) as run
        from documents
    ), coded as (
        select run, {crc32("doc_id || ':' || run")} as h from runs where length(run) >= 7
    ), counted as (
        select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word,
            count(*) as n
        from coded group by 1
    ), words as (
        select word, n, translate(word, '{WIDE}', '{NARROW}') as narrow from counted where length(word) >= 7 and n >= 2
    ), less as (
        select word, n, unnest(range(1, length(word) + 1)) as i from words
    ), masked as (
        select word, n, i, left(word, i - 1) as head, substr(word, i + 1) as tail from less
    ), pairs as (
        select a.word, b.word as near, b.n as near_n from masked a join masked b
            on a.i = b.i and a.head = b.head and a.tail = b.tail and a.word <> b.word
        union
        select w.word, m.word, m.n from words w join masked m on w.word = m.head || m.tail
        union
        select m.word, w.word, w.n from words w join masked m on w.word = m.head || m.tail
    ), best as (
        select word, count(*) as n_near, (array_agg({{'near': near, 'n': near_n}} order by near_n desc, near))[1] as b
        from pairs group by word
    ), forms as (
        select w.word, w.n, coalesce(n_near, 0) as n_near,
            case when b.n >= 10 * w.n then b.near end as form, case when b.n >= 10 * w.n then b.n end as form_n
        from words w left join best using (word)
    ), steps(word, root) as (
        select word, word from forms
        union all
        select steps.word, forms.form from steps join forms on steps.root = forms.word where forms.form is not null
    ), ends as (
        select steps.word, steps.root from steps join forms on steps.root = forms.word where forms.form is null
    )
    select word, form, root, n, n_near, form_n from forms join ends using (word)
    """,
    "op12_exact_top_k": """
    with vectors as (
        select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as ints
        from embeddings
        where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
        select q.vec_id as query_id, v.vec_id, list_inner_product(q.ints, v.ints)::bigint as score
        from vectors q, vectors v
        where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id
    ), ranked as (
        select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score
        from scored
    )
    select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
    """,
    "op13_conversation_trie": f"""
    with turns as (
        select conv_id, row_number() over (partition by conv_id order by turn nulls first) as r,
            {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as t
        from conversations where conv_id is not null
    ), own as (
        select conv_id, array_agg(t order by r) as all_turns from turns group by conv_id
    ), shared as (
        select *, ({crc32("conv_id::varchar")} % 6)::int as h from own
    ), built as (
        select s.conv_id, list_concat(coalesce(b.all_turns[1:s.h], []), s.all_turns[s.h + 1:]) as turns
        from shared s left join own b on b.conv_id = s.conv_id - s.conv_id % 100
    ), steps as (
        select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from built
    ), nodes as (
        select turns[1:depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs,
            coalesce(string_agg(case when len(turns) = depth then conv_id::varchar end, ',' order by conv_id), '') as ends
        from steps group by turns[1:depth], depth
    ), sized as (
        select n.*, (select count(*) from nodes c where c.depth = n.depth + 1 and c.path[1:n.depth] = n.path) as n_children,
            (n_convs - 1) * coalesce(length(path[depth].text), 0) as own_saved
        from nodes n
    )
    select n.conv_id, n.depth, (select p.conv_id from nodes p where p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1]) as parent_conv_id,
        n.n_convs, n.n_children, count(*) filter (where d.n_children = 0) as n_leaves, sum(d.own_saved)::bigint as saved_tokens,
        sha256(n.ends) as ends_sha256
    from sized n join sized d on d.depth >= n.depth and d.path[1:n.depth] = n.path
    group by n.conv_id, n.depth, n.path, n.n_convs, n.n_children, n.ends
    """,
}
