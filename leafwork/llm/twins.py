"""DuckDB's SQL for the queries it can express."""

from __future__ import annotations

from leafwork.llm.chat_format import CODES, FRAMES, ROLE, ROLE_END, TURN_END


def _escaped(text: str) -> str:
    out = f"replace({text}, '~', '~0')"
    for mark, code in CODES.items():
        out = f"replace({out}, '{mark}', '~{code}')"
    return out


def _frame_size() -> str:
    cases = " ".join(f"when '{role}' then {len(a) + len(z)}" for role, (a, z) in FRAMES.items())
    return f"case role {cases} else {len(ROLE) + len(ROLE_END) + len(TURN_END)} + len({_escaped('role')}) end"


def _centroids_sql() -> str:
    """Five rounds of assignment and exact means, one after the other."""
    steps = []
    for r in range(6):
        steps.append(f"""
        near{r} as materialized (
          select rid, c, distance from (
            select rid, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::bigint as distance
            from kept, mean{r}) pairs
          qualify row_number() over (partition by rid order by distance, c) = 1)""")
        if r < 5:
            steps.append(f"""
        mean{r + 1} as materialized (
          select c, coalesce(moved, m) as m from mean{r} left join (
            select c, list((s - ((s % n) + n) % n) // n order by i) as moved from (
              select c, i, sum(v[i])::bigint as s, count(*)::bigint as n
              from near{r} join kept using (rid), (select unnest(range(1, 65)) as i) dims group by c, i) sums
            group by c) means using (c))""")
    return f"""
        with kept as materialized (
          select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
          from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        mean0 as materialized (
          select row_number() over (order by sha256('2:' || coalesce(vec_id::varchar, '')), v) - 1 as c, v as m
          from kept order by c limit 40),{",".join(steps)}
        select vec_id, c::int as cluster, distance, sum(distance) over (partition by c)::bigint as cluster_inertia,
          sum(distance) over ()::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
        from near5 join kept using (rid) join mean5 using (c)
    """


SQL = {
    "op2_exact_dedup": r"""
        with rows as (
          select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
          doc_id is not distinct from min(doc_id) over same as kept, sha256(norm) as text_sha256
        from rows window same as (partition by norm)
    """,
    "op4_chat_format": f"""
        with given as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
          union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized as (select *, {_frame_size()} + len({_escaped('text')}) as size from given)
        select conv_id, count(*) as n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
          coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
          sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
          sum(size)::bigint as formatted_chars, 0::bigint as n_attachments, 0::bigint as expanded_tokens
        from sized group by conv_id
    """,
    "op8_minhash": r"""
        with recursive
        split as (
          select doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
          from documents),
        shingles as (
          select distinct doc_id, unnest(case when len(words) < 5 then [array_to_string(words, ' ')]
            else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) end) as shingle
          from split where len(words) > 0),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        common as (
          select a.doc_id as a, b.doc_id as b, count(*) as c
          from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
        links as (
          select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
          where 100 * c >= 85 * (x.n + y.n - c)),
        edges as (select a, b from links union select b, a from links),
        reach(node, other) as (
          select doc_id, doc_id from split union select reach.node, edges.b from reach join edges on edges.a = reach.other),
        lowest as (select node, min(other) as component_id from reach group by node)
        select split.doc_id, coalesce(sizes.n, 0) as n_shingles, component_id, split.doc_id = component_id as kept
        from split join lowest on lowest.node = split.doc_id left join sizes on sizes.doc_id = split.doc_id
    """,
    "op11_collocations": r"""
        with pieces as (
          select row_number() over () as piece, lang, words from (
            select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as words from (
              select coalesce(lang, 'und') as lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) as piece
              from documents) cut) split where len(words) > 0),
        grams as (
          select lang, k, array_to_string(words[i : i + k - 1], ' ') as phrase from (
            select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from pieces, (select unnest([1, 2, 3]) as k) ks) runs),
        counts as materialized (select lang, k, phrase, count(*)::hugeint as f from grams group by all),
        totals as (select lang, sum(f) as n from counts where k = 1 group by lang),
        candidates as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from counts where k > 1 and f >= 10),
        cuts as (
          select c.*, j, x.f as l, y.f as r, 1000000 * a * a // (x.f * y.f) as score
          from (select *, unnest(range(1, k)) as j from candidates) c
          join counts x on x.lang = c.lang and x.phrase = array_to_string(w[1 : j], ' ')
          join counts y on y.lang = c.lang and y.phrase = array_to_string(w[j + 1 : c.k], ' ')),
        scored as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
        inner_ as (
          select lang, array_to_string(w[i : i + 1], ' ') as phrase, a as longer
          from (select *, unnest([1, 2]) as i from candidates where k = 3) t),
        kept as (
          select * from scored s where not exists (
            from inner_ i where i.lang = s.lang and i.phrase = s.phrase and 100 * longer >= 50 * s.a))
        select lang, row_number() over best as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
        from kept join totals using (lang)
        window best as (partition by lang order by score desc, a desc, phrase)
        qualify row_number() over best <= 2000
    """,
    "op13_centroids": _centroids_sql(),
}
