"""The registered queries that SQL can express, for a second engine."""

from __future__ import annotations

from .quality import QualityRules

SAYING = "<|im_end|><|im_start|>assistant ok"
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

CHAT = rf"""
with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '{SAYING}' union all select -1, 1, 'assistant', '{SAYING}'),
shown as (select *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') as body from said)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, body)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, body) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(length('<|im_start|>') + length(role) + 1 + length(body) + length('<|im_end|>') + 1) as bigint) as formatted_chars
from shown group by conv_id"""

REPEATS = rf"""
with docs as (select row_number() over () as rid, doc_id, {WORDS.format(text="coalesce(text, '')")} as w from documents),
windows as (
    select rid, i, array_to_string(w[i:i + 34], ' ') as said
    from (select rid, w, unnest(range(1, len(w) - 33)) as i from docs where len(w) >= 35)),
again as (select rid, i from windows where said in (select said from windows group by said having count(*) > 1)),
gone as (select distinct rid, i + k as i from again, range(0, 35) t(k)),
spelled as (select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from docs),
kept as (
    select rid, string_agg(word, ' ' order by i) as said, count(*) as n
    from spelled anti join gone using (rid, i) group by rid)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(said, '')) as kept_sha256
from docs left join kept using (rid)"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NEAR = rf"""
with recursive docs as (select doc_id, {WORDS.format(text=LOWER)} as w from documents),
shingles as (
    select distinct doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as said
    from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from docs where len(w) >= 3)
    union all select doc_id, array_to_string(w, ' ') from docs where len(w) between 1 and 2),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
near as (
    select a.doc_id as a, b.doc_id as b, count(*) as both_
    from shingles a join shingles b on a.said = b.said and a.doc_id <> b.doc_id group by all),
links as (
    select a, b from near join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * both_ >= 90 * (x.n + y.n - both_)),
reached as (
    select doc_id as a, doc_id as b from docs
    union select r.a, l.b from reached r join links l on l.a = r.b)
select d.doc_id, coalesce(n, 0) as n_shingles, (select min(b) from reached r where r.a = d.doc_id) as component_id
from docs d left join sizes s on s.doc_id = d.doc_id"""


def _quality(rule: QualityRules) -> str:
    grid = ", ".join(f"('{name}', {k}, {cut!r}::double)" for name, cuts in rule.cutoffs.items() for k, cut in enumerate(cuts))
    risk, rules = rule.risk / len(rule.cutoffs), len(rule.cutoffs)
    return rf"""
with docs as (
    select row_number() over () as rid, doc_id, lang, coalesce(text, '') as text, {WORDS.format(text="coalesce(text, '')")} as w from documents),
windows as (
    select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as n
    from (select rid, w, unnest(range(1, len(w) - 1)) as i from docs where len(w) >= 3)),
again as (select rid, count(distinct i + k) as n from windows, range(0, 3) t(k) where windows.n > 1 group by rid),
lines as (
    select rid, count(*) as n, count(distinct line) as different
    from (select rid, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
measured as (
    select docs.rid, doc_id, lang, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        coalesce(lines.n - different, 0) as n_dup_lines, coalesce(again.n, 0) as n_repeat_words, coalesce(lines.n, 0) as n_lines
    from docs left join lines using (rid) left join again using (rid)),
judged as (
    select *, n_words < {rule.least_words} or 100 * n_repeat_words > {rule.most_repeated} * n_words as base_failed from measured),
value as (
    select rid, unnest([
        {{'rule': 'symbols_per_char', 'x': coalesce(n_symbols::double / nullif(word_chars::double, 0), 0)}},
        {{'rule': 'dup_lines_per_line', 'x': coalesce(n_dup_lines::double / nullif(n_lines::double, 0), 0)}},
        {{'rule': 'repeats_per_word', 'x': coalesce(n_repeat_words::double / nullif(n_words::double, 0), 0)}},
        {{'rule': 'chars_per_word', 'x': coalesce(word_chars::double / nullif(n_words::double, 0), 0)}}], recursive := true) from judged),
good as (select doc_id from labels group by doc_id having min(quality) = 1),
held as (select rid, lang from judged join good using (doc_id) where not base_failed),
strata as (select lang, count(*) as n from held group by lang),
cuts(rule, k, cut) as (values {grid}),
rejected as (
    select strata.lang, strata.n, cuts.rule, cuts.k, cuts.cut, count(*) filter (value.x > cuts.cut) as r
    from strata join held on held.lang is not distinct from strata.lang join value on value.rid = held.rid
    join cuts on cuts.rule = value.rule group by all),
tails as (
    select *, case when r >= n * {risk!r} then 1.0 else (
        select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk!r}) + (n - j) * ln(1 - {risk!r})))
        from range(0, r + 1) t(j)) end <= {rule.error!r} / ({rules} * (select count(*) from strata)) as stands from rejected),
standing as (
    select lang, rule, min(cut) as cut
    from (select *, min(case when stands then 1 else 0 end) over (partition by lang, rule order by k) as so_far from tails) where so_far = 1
    group by lang, rule),
over_ as (
    select distinct judged.rid from judged join value on value.rid = judged.rid
    join standing on standing.rule = value.rule and standing.lang is not distinct from judged.lang where value.x > standing.cut)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and judged.rid not in (select rid from over_) as kept from judged"""


MIDDLE = """
with docs as (
    select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
    from documents),
drawn as (
    select *, cast('0x' || h[1:8] as bigint) % (n + 1) as a, cast('0x' || h[9:16] as bigint) % (n + 1) as b,
        case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
            or cast('0x' || h[17:24] as bigint) % 100 >= 90 then 'plain'
            when cast('0x' || h[25:32] as bigint) % 100 < 20 then 'spm' else 'psm' end as form
    from docs),
cut as (
    select *, substr(text, 1, least(a, b)) as p, substr(text, least(a, b) + 1, abs(a - b)) as m, substr(text, greatest(a, b) + 1) as s
    from drawn)
select doc_id, n, form, case when form <> 'plain' then least(a, b) end as prefix_chars,
    case when form <> 'plain' then abs(a - b) end as middle_chars,
    sha256(case form when 'plain' then text when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m
        else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
    sha256(text) as restored_sha256
from cut"""


# CRC-32 by a table made in the query; letters beyond ASCII take two bytes
SPELLING = rf"""
with recursive crc_table as (
    select list(list_reduce([i::ubigint, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end) order by i) as t from range(256) r(i)),
runs as (
    select rid, doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run
    from (select row_number() over () as rid, * from documents)),
said as (select rid, doc_id, run, count(*) as n from runs where length(run) >= 7 group by all),
drawn as (
    select run, n, xor(list_reduce(
        list_prepend(4294967295::ubigint, flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''),
            lambda c: case when unicode(c) < 128 then [unicode(c)::ubigint] else [195::ubigint, (unicode(c) - 64)::ubigint] end))),
        lambda a, b: xor(a >> 8, t[(1 + (xor(a, b) & 255))::int])), 4294967295::ubigint) as h
    from said, crc_table),
words as (
    select word, sum(n)::bigint as n
    from (select n, case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from drawn)
    where length(word) >= 7 group by word having sum(n) >= 2),
cut as (
    select word, n, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) as gap, substr(word, 1, i - 1) || substr(word, i + 1) as less
    from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
    select a.word, b.word as other, b.n as other_n from cut a join cut b on a.gap = b.gap and a.word <> b.word
    union select l.word, s.word, s.n from cut l join words s on s.word = l.less
    union select s.word, l.word, l.n from cut l join words s on s.word = l.less),
best as (
    select word, count(*) as n_near, arg_min(struct_pack(other, other_n), struct_pack(m := -other_n, other)) as top from near group by word),
forms as (
    select words.word, words.n, coalesce(n_near, 0) as n_near, case when top.other_n >= 10 * n then top.other end as form,
        case when top.other_n >= 10 * n then top.other_n end as form_n
    from words left join best using (word)),
walk as (
    select word, coalesce(form, word) as here, 0 as step from forms
    union all select walk.word, forms.form, step + 1 from walk join forms on forms.word = walk.here where forms.form is not null)
select word, form, arg_max(here, step) as root, n, n_near, form_n from forms join walk using (word) group by all"""


ORACLES: dict[str, str] = {
    "op1_chat": CHAT,
    "op5_quality": _quality(QualityRules()),
    "op7_repeats": REPEATS,
    "op9_near_duplicates": NEAR,
    "op11_fill_in_middle": MIDDLE,
    "op13_spelling": SPELLING,
}
