"""SQL that the native operators must agree with."""

from . import chat_windows, license_rules, url_vocabulary
from .quality_table import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _licence_sql() -> str:
    """Sentences in one list per document, then one step per rule, each claiming what it matches."""
    known = ", ".join(f"{_text(s)}: {_text(k)}" for k, all_ in license_rules.SENTENCES.items() for s in all_)
    clean = lambda x: f"regexp_replace(regexp_replace({x}, '[^a-z0-9.+-]+', ' ', 'g'), '^[ .+-]+|[ .+-]+$', '', 'g')"
    steps, last = [], "s0"
    for n, rule in enumerate(license_rules.RULES, 1):
        ids = _text(f",{','.join(rule.sentences)},")
        steps.append(f"s{n} as (select *exclude (rest, names), replace(rest, {ids}, ',~,') as rest, case when contains(rest, {ids}) "
                     f"then list_append(names, {_text(rule.licence)}) else names end as names from {last})")
        last = f"s{n}"
    family = " ".join(
        f"when list_has_any(names, [{', '.join(sorted({_text(r.licence) for r in license_rules.RULES if r.family == f}))}]) then {_text(f)}"
        for f in license_rules.FAMILIES)
    lower = f"translate(coalesce(text, ''), '{license_rules.UPPER}', '{license_rules.LOWER}')"
    for pattern, to in license_rules.TAG_STEPS:
        groups = to.replace("{1}", "\\1").replace("{2}", "\\2")
        lower = f"regexp_replace({lower}, {_text(pattern)}, {_text(groups)}, 'g')"
    return f"""
with k as materialized (select map {{{known}}} as m),
d as (select row_number() over () as r, doc_id, {lower} as t from documents),
p as (select r, doc_id, regexp_split_to_array(t, '[.;:!?]+[\\x20\\x09-\\x0D]+|\\n[\\x20\\x09\\x0D]*\\n') as parts from d),
q as (
    select r, doc_id, flatten(list_transform(parts, lambda x: case when map_contains(m, {clean('x')}) then [{clean('x')}]
        else list_transform(string_split(x, chr(10)), lambda y: {clean('y')}) end)) as found from p, k),
s0 as (
    select r, doc_id, list_transform(list_filter(found, lambda x: map_contains(m, x)), lambda x: m[x]) as ids,
        ',' || array_to_string(list_transform(list_filter(found, lambda x: map_contains(m, x)), lambda x: m[x]), ',') || ',' as rest,
        []::varchar[] as names from q, k),
{", ".join(steps)}
select doc_id, len(ids)::bigint as n_sentences, array_to_string(ids, ',') as sentences,
    case when len(ids) > 0 and len(names) = 0 then '{license_rules.UNRECOGNISED}' else coalesce(array_to_string((
        select list(x order by i) from (select x, min(i) as i from (select unnest(names) as x, unnest(range(len(names))) as i) group by x)), ','), '')
        end as licences,
    case {family} when len(ids) > 0 then 'unknown' end as family
from {last}"""


def _url_sql() -> str:
    u = url_vocabulary
    low = f"translate(coalesce(url, ''), '{u.UPPER}', '{u.LOWER}')"
    split = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    hits = lambda terms: " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::int" for t in terms)
    fits = lambda r: f"(host = {_text(r.host)} or ends_with(host, {_text('.' + r.host)})) and starts_with(path, {_text(r.path)})"
    rules = sorted(u.RULES, key=lambda r: (-len(r.name), r.name))
    name = " ".join(f"when {fits(r)} then {_text(r.name)}" for r in rules)
    allow = " ".join(f"when {fits(r)} then {str(r.allow).lower()}" for r in rules)
    return f"""
with p as (
    select page_id, {low} as low, regexp_extract({low}, {split}, 1) as host, regexp_extract(coalesce(url, ''), {split}, 2) as path from pages),
h as (select *, {hits(u.STRICT)} as n_strict, {hits(u.SOFT)} as n_soft, case {name} end as rule, case {allow} end as allowed from p)
select page_id, host, path, rule, n_strict, n_soft,
    case when coalesce(allowed, n_strict < 1 and n_soft < {u.SOFT_LIMIT}) then 'allow' else 'block' end as verdict
from h"""


def _chat_sql() -> str:
    c = chat_windows
    escaped = "replace({0}, chr(92), chr(92) || chr(92))"
    for control in c._CONTROL:
        escaped = f"regexp_replace({escaped}, {_text(control)}, '\\1\\\\\\2', 'g')"
    marks = len(c.START) + len(c.END) + 2
    chars = f"{marks} + length(replace({escaped.format('role')}, chr(10), '<\\n')) + length({escaped.format('text')})"
    return f"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (
    select *, {c.OVERHEAD} + (strlen(text) + 3) // 4 as tokens, {chars} as chars,
        row_number() over (partition by conv_id order by turn nulls first, role, text) as no, count(*) over (partition by conv_id) as n from c),
y as (select conv_id, tokens as sys_tokens, chars as sys_chars from t where no = 1 and role = 'system' and n > 1),
s as (
    select t.*, greatest({c.BUDGET - c.HISTORY} - coalesce(sys_tokens, 0), {max(1, c.BUDGET // 4)}) as fresh,
        sum(tokens) over (partition by conv_id order by no) as e
    from t left join y using (conv_id) where sys_tokens is null or no > 1),
w as (select *, (e - tokens)::bigint // fresh as a, (e - 1)::bigint // fresh as b, (e - tokens)::bigint as s from s),
heads as (select conv_id, a, b, min(s) as start from w group by all),
repeated as (
    select h.conv_id, sum(p.chars) as chars from heads h join w p on p.conv_id = h.conv_id and p.e <= h.start and h.start - p.s <= {c.HISTORY}
    group by 1),
system as (select h.conv_id, sum(sys_chars) as chars from heads h join y using (conv_id) group by 1),
own as (select conv_id, sum(chars) as chars from w group by 1),
told as (
    select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by no)) as turns_sha256,
        coalesce(string_agg(text, '' order by no) filter (where role = 'assistant'), '') as loss from t group by 1)
select conv_id, n_turns, turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256,
    (own.chars + coalesce(repeated.chars, 0) + coalesce(system.chars, 0))::bigint as formatted_chars
from told join own using (conv_id) left join repeated using (conv_id) left join system using (conv_id)"""


def _resampling_sql() -> str:
    """CRC-32 as a sum of the effects of single bytes: it is linear but for its start and end masks."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with recursive tab as (
    select b, list_reduce(list_concat([b], range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from range(256) t(b)),
d as (select row_number() over () as r, doc_id, {words} as w from documents),
q as (select {words} as w from benchmark),
fd as (select r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from d),
fq as (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from q),
u as materialized (select distinct f, strlen(f) as n, hex(encode(f)) as h from (select f from fd union all select f from fq)),
longest as (select max(n) as n from u),
effect as (
    select 0::bigint as k, b, v from tab
    union all select e.k + 1, e.b, xor(e.v >> 8, t.v) from effect e join tab t on t.b = e.v & 255 where e.k + 1 < (select n from longest)),
start as (
    select 0::bigint as k, 4294967295::bigint as z
    union all select s.k + 1, xor(s.z >> 8, t.v) from start s join tab t on t.b = s.z & 255 where s.k < (select n from longest)),
bytes as (select f, n, n - 1 - i as k, ('0x' || substr(h, 2 * i + 1, 2))::bigint as b from (select f, n, h, unnest(range(n)) as i from u)),
mixed as (select f, any_value(n) as n, bit_xor(e.v) as v from bytes join effect e using (k, b) group by f),
bucket as materialized (select f, xor(xor(m.v, s.z), 4294967295) % 10000 as b from mixed m join start s on s.k = m.n),
cd as (select b, count(*) as s from fd join bucket using (f) group by b),
cq as (select b, count(*) as t from fq join bucket using (f) group by b),
total as (select (select count(*) from fd)::double as have, (select count(*) from fq)::double as want),
gain as (
    select b, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * (have + 10000) / ((s + 1.0::double) * (want + 10000))))::bigint as g
    from cd left join cq using (b), total),
own as (select r, count(*) as n, sum(g)::bigint as g from fd join bucket using (f) join gain using (b) group by r),
scored as (
    select r, doc_id, len(w) as n_words, coalesce(n, 0)::bigint as n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::bigint as weight,
        floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as noise
    from d left join own using (r)),
placed as (
    select r, row_number() over (order by weight + noise desc, doc_id, n_features desc) as place, count(*) over () as n
    from scored where n_words >= 20 and doc_id is not null)
select doc_id, n_features, weight, weight + noise as score, case when place <= 25 * n // 100 then place end as rank
from scored left join placed using (r)"""


_HARD_NEGATIVES = """
with e as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select vec_id as anchor_id, label as own, x as y from e where vec_id % 100 = 0),
s as (
    select anchor_id, vec_id, own = label as same, list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * y[i]))::bigint as score
    from a join e on e.vec_id <> a.anchor_id),
p as (
    select anchor_id, vec_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank,
    vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5"""


SQL = {
    "op11_importance_resampling": _resampling_sql(),
    "op13_hard_negatives": _HARD_NEGATIVES,
    "op1_license_sentences": _licence_sql(),
    "op4_url_vocabulary": _url_sql(),
    "op5_chat_windows": _chat_sql(),
    "op8_quality_rules": f"""
with d as (
    select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (
    select r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
g as (
    select r, i, array_to_string(w[i:i + 7], ' ') as g from (select r, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
twice as (select r, g from g group by r, g having count(*) > 1),
covered as (
    select r, count(distinct p) as n from (
        select g.r, unnest(range(g.i, g.i + 8)) as p from g join twice using (r, g)) group by r),
m as (
    select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
        len(l) as n_lines, len(list_filter(w, lambda x: x in ({_STOP}))) as n_stop,
        len(list_filter(w, lambda x, i: i > 1 and x = w[i - 1])) as n_stutter,
        len(list_filter(l, lambda x: length(x) < 12)) as n_short,
        len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) as n_bullets,
        len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) as n_ellipses
    from w left join covered using (r)),
v as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and n_words >= 20 and word_chars / n_words between 2.0 and 14.0 and n_symbols / n_words <= 0.10
    and n_stop / n_words >= 0.02 and n_stutter / n_words <= 0.30 and n_dup_lines / n_lines <= 0.50 and n_short / n_lines <= 0.90
    and n_bullets / n_lines <= 0.90 and n_ellipses / n_lines <= 0.30 as kept
from v""",
}
