"""DuckDB SQL for the queries that SQL can express."""

DECONTAMINATE = r"""
with words as (
    select 'd' as kind, row_number() over () as rid, doc_id as id, w from (
        select doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from documents)
), items as (
    select item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark where item_id is not null
), sized as (
    select item_id, w, least(10, len(w)) as n from items where len(w) > 0
), wanted as (
    select distinct item_id, n, array_to_string(w[p : p + n - 1], ' ') as grams
    from (select *, unnest(range(1, len(w) - n + 2)) as p from sized)
), lengths as (
    select distinct n from wanted
), grams as (
    select rid, n, p, array_to_string(w[p : p + n - 1], ' ') as grams
    from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as p from words, lengths where len(w) >= n)
), hits as (
    select distinct rid, n, p, item_id from grams join wanted using (n, grams)
), covered as (
    select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + n)) as q from hits) group by rid
), named as (
    select rid, count(*) as n_items, string_agg(i, ',' order by i) as ids
    from (select distinct rid, item_id::varchar as i from hits) group by rid
)
select id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
    coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (rid) left join named using (rid)
"""

WARC = """
with payloads as (
    select page_id, coalesce(html, '') as payload from pages
), firsts as (
    select payload, min(page_id) as first from payloads
    where strlen(payload) >= 100 and page_id is not null group by payload
)
select page_id, strlen(payload)::bigint as payload_bytes, sha256(payload) as payload_digest,
    case when page_id <> first then 'revisit' else 'response' end as record_type,
    case when page_id <> first then first end as refers_to
from payloads left join firsts using (payload)
"""

QUALITY = r"""
with docs as (
    select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents
), words as (
    select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs
), grams as (
    select rid, p, array_to_string(w[p : p + 7], ' ') as g
    from (select rid, w, unnest(range(1, len(w) - 6)) as p from words where len(w) >= 8)
), twice as (
    select rid, g from grams group by rid, g having count(*) > 1
), repeats as (
    select rid, count(distinct q) as n from (
        select rid, unnest(range(p, p + 8)) as q from grams join twice using (rid, g)) group by rid
), lines as (
    select rid, count(*) as n, count(*) - count(distinct x) as dup from (
        select rid, unnest(string_split(text, chr(10))) as x from docs)
    where regexp_matches(x, '[^\x20\x09-\x0D]') group by rid
), counted as (
    select rid, doc_id, lang, source, len(w)::bigint as n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')))::bigint as n_capitals,
        coalesce(l.n, 0) as n_lines, coalesce(l.dup, 0)::bigint as n_dup_lines,
        coalesce(r.n, 0)::bigint as n_repeat_words
    from docs join words using (rid) left join lines l using (rid) left join repeats r using (rid)
), facts as (
    select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
        word_chars * 1000 // greatest(n_words, 1) as word_length, n_symbols * 1000 // greatest(n_words, 1) as symbols,
        n_capitals * 1000 // greatest(n_words, 1) as capitals, n_repeat_words * 1000 // greatest(n_words, 1) as repeated,
        n_dup_lines * 1000 // greatest(n_lines, 1) as duplicate_lines
    from counted
), measured as (
    select rid, lang, source, unnest([
        {'m': 'word_length', 'v': word_length, 's': 500, 'o': 1}, {'m': 'symbols', 'v': symbols, 's': 50, 'o': 2},
        {'m': 'capitals', 'v': capitals, 's': 100, 'o': 3}, {'m': 'repeated', 'v': repeated, 's': 50, 'o': 4},
        {'m': 'duplicate_lines', 'v': duplicate_lines, 's': 50, 'o': 5}], recursive := true)
    from facts where not base_failed
), sketch as (
    select lang, source, m, s, case when v > 0 then ceil(ln(v) / ln(1.02)) else -1 end::int as b, count(*) as n
    from measured group by all
), merged as (
    select 1 as level, lang, source, m, s, b, sum(n) as n from sketch group by all
    union all select 2, lang, null, m, s, b, sum(n) from sketch group by all
    union all select 3, null, null, m, s, b, sum(n) from sketch group by all
), ranked as (
    select *, case when b < 0 then 0 else 2 * pow(1.02, b) / 2.02 end as v,
        sum(n) over (partition by level, lang, source, m order by b) as upto,
        sum(n) over (partition by level, lang, source, m) as rows
    from merged
), quartiles as (
    select level, lang, source, m, s, max(rows) as rows, min(v) filter (upto >= rows * 0.25) as q1,
        min(v) filter (upto >= rows * 0.75) as q3
    from ranked group by all
), fences as (
    select *, q1 - 4 * greatest(q3 - q1, s) as low, q3 + 4 * greatest(q3 - q1, s) as high from quartiles
), limits as (
    select f.lang, f.source, f.m,
        case when f.rows >= 200 then f.low when l.rows >= 200 then l.low else e.low end as low,
        case when f.rows >= 200 then f.high when l.rows >= 200 then l.high else e.high end as high
    from fences f join fences l on l.level = 2 and f.lang is not distinct from l.lang and f.m = l.m
        join fences e on e.level = 3 and e.m = f.m
    where f.level = 1
), broken as (
    select rid, string_agg(x.m, ',' order by x.o) as rules
    from measured x join limits l
        on x.lang is not distinct from l.lang and x.source is not distinct from l.source and x.m = l.m
    where v > high or (x.m = 'word_length' and v < low) group by rid
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and rules is null as kept, coalesce(rules, '') as failed_rules
from facts left join broken using (rid)
"""

LINES = r"""
with texts as (
    select distinct text from documents where text is not null
), split as (
    select text, unnest(string_split(text, chr(10))) as line,
        unnest(range(len(string_split(text, chr(10))))) as p from texts
), cut as (
    select text, p, line, raw, list_transform(raw,
        lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as masked
    from (select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as raw from split)
), lines as (
    select text, p, length(line) as size, struct_pack(n := len(raw), h := masked[1:3]) as leaf,
        case when len(list_filter(raw, lambda t: not regexp_matches(t, '[0-9]'))) >= 0.6 * len(raw)
            then masked else raw end as tokens
    from cut where len(raw) >= 1
), leaves as (
    select leaf from lines group by leaf having count(distinct text) >= 5
), often as (
    select * from lines semi join leaves using (leaf)
), kinds as (
    select leaf, tokens, count(distinct text) as docs from often group by leaf, tokens
), spread as (
    select leaf, tokens, docs, unnest(tokens) as token, unnest(range(len(tokens))) as q from kinds
), constant as (
    select leaf, q, token from spread where token <> '<*>' group by all having sum(docs) >= 5
), shapes as (
    select leaf, tokens, list({'q': q, 't': token} order by q) as shape
    from spread join constant using (leaf, q, token) group by leaf, tokens
), templates as (
    select leaf, tokens, coalesce(len(shape), 0) >= 0.6 * len(tokens) as shared,
        case when coalesce(len(shape), 0) >= 0.6 * len(tokens) then shape::varchar else tokens::varchar end as template
    from kinds left join shapes using (leaf, tokens)
), placed as (
    select text, p, size, leaf, template, shared from often join templates using (leaf, tokens)
), recur as (
    select leaf, template, shared from placed group by all having count(distinct text) >= 5
), first as (
    select * from placed semi join recur using (leaf, template, shared)
), copied as (
    select text from first group by text having sum(size) > 0.5 * length(text)
), final as (
    select leaf, template, shared from first anti join copied using (text)
    group by all having count(distinct text) >= 5
), dropped as (
    select text, p from first semi join final using (leaf, template, shared)
), result as (
    select text, count(*) as n_lines, count(d.p) as n_dropped,
        case when count(d.p) = 0 then text
            else coalesce(string_agg(line, chr(10) order by p) filter (d.p is null), '') end as kept_text
    from split left join dropped d using (text, p) group by text
)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped,
    kept_text as text
from documents left join result using (text)
"""


def mixing(topics: dict[str, tuple[str, ...]], other: str, powers: dict[str, float], share: float, sweeps: int, seed: str) -> str:
    """The raking unrolled: one step for each sweep and dimension."""
    listed = ", ".join(f"('{w}', '{t}', {i})" for i, (t, words) in enumerate(topics.items()) for w in words)
    steps, last = [], "start"
    for sweep in range(sweeps):
        for dimension in powers:
            name = f"s{sweep}_{dimension}"
            steps.append(
                f"{name} as materialized (select source, lang, topic, tokens, case when now > 0 then"
                f" weight * coalesce(target, 0) / now else 0 end as weight from (select *, sum(weight) over"
                f" (partition by {dimension}) as now from {last}) left join target_{dimension} on {dimension} = value)"
            )
            last = name
    targets = ", ".join(
        f"target_{d} as materialized (select {d} as value, pow(sum(tokens), {p}) / sum(pow(sum(tokens), {p})) over () as target"
        f" from cells where tokens > 0 group by {d})"
        for d, p in powers.items()
    )
    return rf"""
with topic_words(word, topic, rank) as (
    values {listed}
), docs as (
    select row_number() over () as rid, doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
    from documents
), hits as (
    select rid, topic, rank, count(*) as n
    from (select rid, lower(regexp_replace(unnest(w), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g')) as word from docs)
    join topic_words using (word) group by all
), topical as (
    select rid, arg_max(topic, (n, -rank)) as topic from hits group by rid
), facts as (
    select doc_id, source, lang, coalesce(topic, '{other}') as topic, len(w)::bigint as n_tokens
    from docs left join topical using (rid)
), cells as materialized (
    select source, lang, topic, sum(n_tokens) as tokens from facts group by all
), {targets}, start as (
    select *, tokens::double as weight from cells
), {", ".join(steps)}, scale as (
    select least(1 / max(weight / tokens) filter (tokens > 0), {share} * sum(tokens) / sum(weight)) as scale from {last}
), rates as (
    select source, lang, topic, round(weight, 7) as weight,
        round(case when tokens > 0 then least(weight / tokens * scale, 1) else 0 end, 7) as probability
    from {last}, scale
)
select doc_id, source, lang, topic, n_tokens, weight, probability,
    n_tokens > 0 and (('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5)
        / 4503599627370496 < probability as sampled
from facts join rates using (source, lang, topic)
"""

CHAT = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role = 'assistant' as learned
    from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]', false
    union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', true
), sized as (
    select *, length(text) + length(role) + 17 + len(regexp_extract_all(text, '<\\*(\||/?s>)|\[\\*/?INST\]'))
        + len(regexp_extract_all(role, '<\\*(\||/?s>)|\[\\*/?INST\]'))
        + 5 * (length(role) - length(replace(role, chr(10), ''))) as chars
    from turns
)
select conv_id, count(*)::bigint as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (learned), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (learned), '')) as loss_sha256,
    sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""


def vector_codes(parts: int, entries: int, rounds: int) -> str:
    """Every part against every entry of its codebook, each round."""

    def nearest(books: str) -> str:
        return f"""
    select rid, p, v, min({{'far': list_sum(list_transform(range(1, len(v) + 1), lambda j: (v[j] - b[j]) * (v[j] - b[j]))),
        'e': e}}) as best
    from parts join {books} using (p) group by rid, p, v"""

    steps = []
    for r in range(rounds):
        steps.append(f"near{r} as materialized ({nearest(f'books{r}')})")
        steps.append(f"""books{r + 1} as materialized (
    select p, e, coalesce(m, b) as b from books{r} left join (
        select p, e, list(c order by j) as m from (
            select p, best.e as e, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as c
            from (select p, best, unnest(v) as x, unnest(range(len(v))) as j from near{r}) group by p, e, j
        ) group by p, e
    ) using (p, e)
)""")
    return f"""
with kept as (
    select row_number() over (order by vec_id, embedding) - 1 as rid, vec_id, label,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
    select rid, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as v
    from kept, (select unnest(range({parts})) as p)
), books0 as materialized (
    select p, rid as e, v as b from parts where rid < {entries}
), {", ".join(steps)}, final as materialized ({nearest(f"books{rounds}")}),
coded as (
    select rid, string_agg(lower(printf('%02x', best.e)), '' order by p) as code, sum(best.far)::bigint as error
    from final group by rid
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
    (select sha256(string_agg(array_to_string(b, ','), ',' order by p, e)) from books{rounds}) as codebooks_sha256
from coded join kept using (rid)
"""


def sharding(shards: int) -> str:
    """Equal weights, so the cheapest shard is the one with the largest hash; CRC-32 bit by bit for its table."""

    def unit(seed: str) -> str:
        return f"('0x' || substr(md5({seed} || ':' || coalesce(doc_id::varchar, '')), 1, 13))::bigint"

    return f"""
with rule as (
    select list_transform(range(256), lambda i: list_reduce(
        list_concat([i], range(8)),
        lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), sized as (
    select doc_id, row_number() over () as rid, strlen(coalesce(text, '')) + 1 as size,
        list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
            lambda b: ('0x' || b)::bigint)) as bytes
    from documents
), summed as (
    select doc_id, rid, size, xor(list_reduce(bytes,
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc
    from sized, rule
), bids as (
    select rid, s, {unit("'shard-' || s")} as bid
    from sized, (select unnest(range({shards + 1})) as s)
), placed as (
    select rid, arg_max(s, {{'bid': bid, 's': -s}}) filter (s < {shards}) as shard,
        arg_max(s, {{'bid': bid, 's': -s}}) as grown
    from bids group by rid
)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'key' as law, shard::int as shard,
    row_number() over (partition by shard order by {unit("'slot'")}, doc_id nulls first, size, crc) - 1 as slot,
    grown::int as grown_shard
from summed join placed using (rid)
"""


SEARCH = r"""
with words as (
    select row_number() over () as rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
    from documents
), totals as (
    select count(*) as docs, sum(len(w))::bigint as terms from words where len(w) > 0
), sized as (
    select rid, doc_id, 100 - 75 + ((75 * len(w) * docs) // terms) as m from words, totals where len(w) > 0
), tfs as (
    select rid, term, count(*) as tf from (select rid, unnest(w) as term from words) group by rid, term
), weights as (
    select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as weight
    from tfs, totals group by term, docs
), wanted as (
    select item_id, term, count(*) as repeats from (
        select item_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from benchmark)
    group by item_id, term
), scored as (
    select item_id, rid, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
    from wanted join weights using (term) join tfs using (term) join sized using (rid)
    group by item_id, rid
), ranked as (
    select item_id, doc_id, score, row_number() over (
        partition by item_id order by score desc, doc_id nulls last) as rank
    from scored join sized using (rid) where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
