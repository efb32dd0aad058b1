"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from .common import LOWER, UPPER
from .license_scan import PHRASES, SEPARATORS, TEMPLATES, _template_words


def _values(rows: Sequence[tuple]) -> str:
    def literal(x: object) -> str:
        return "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


def op10_licenses(
    templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.8
) -> str:
    """Every block against every template, without the filters of the join.

    Phrases have three or four words.  Rows are told apart by their number, as
    ids may repeat.
    """
    vocabulary = [(n, label, w) for n, (label, text) in enumerate(templates) for w in _template_words(text)]
    spoken = [(label, *p.split(), *[None] * (4 - len(p.split()))) for p, label in phrases.items()]

    def words(text: str) -> str:
        return f"[x for x in regexp_split_to_array(translate({text}, '{UPPER}', '{LOWER}'), '{SEPARATORS}') if x <> '']"

    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
listed as (select r, {words('t')} as ws from d),
w as (select r, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as spot from listed),
s as (select r, spot, word as w0, lead(word, 1) over p as w1, lead(word, 2) over p as w2, lead(word, 3) over p as w3
      from w window p as (partition by r order by spot)),
phrase(label, p0, p1, p2, p3) as (values {_values(spoken)}),
place as (select r, spot, label from s join phrase
          on w0 = p0 and w1 = p1 and w2 = p2 and (p3 is null or w3 = p3)),
base as (select r, count(*) as n_base, min(spot) as first_word, max(spot) as last_word from place group by r),
cut as (select r, regexp_split_to_array(regexp_replace(t, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), '[\\r\\n]+') as bs from d),
block as (select r, unnest(bs) as b, generate_subscripts(bs, 1) as nr from cut),
held as (select distinct r, nr, word from (select r, nr, unnest({words('b')}) as word from block)),
v(template, label, word) as (values {_values(vocabulary)}),
whole as (select template, label, count(*) as size from v group by template, label),
met as (select r, nr, template, count(*) as shared from held join v using (word) group by r, nr, template),
hit as (select r, label, shared / size as containment from met join whole using (template)
        where shared >= ceil({threshold} * size - 1e-9)),
best as (select r, max(containment) as best from hit group by r),
own as (select r, string_agg(distinct label, ',' order by label) as base_labels from place group by r),
both_kinds as (select r, string_agg(distinct label, ',' order by label) as labels
               from (select r, label from place union all select r, label from hit) group by r)
select d.doc_id, len(listed.ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       cast(case when n_base > 0 then 1.0 else coalesce(best, 0.0) end as double) as score
from d join listed using (r) left join base using (r) left join own using (r)
left join both_kinds using (r) left join best using (r)
"""


def _words(text: str) -> str:
    """SQL for the list of words of ``text``."""
    lowered = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    return f"[x for x in regexp_split_to_array({lowered}, '{SEPARATORS}') if x <> '']"


def op11_decontaminate(size: int = 10) -> str:
    """Every window of every document against every window of the items.

    Rows are told apart by their number, as ids may repeat.
    """
    return f"""
with d as (select row_number() over () as r, doc_id, {_words('text')} as ws from documents),
b as (select cast(item_id as varchar) as item, {_words('text')} as ws from benchmark),
item_window as (select distinct item, least(len(ws), {size}) as size,
                       unnest([array_to_string(ws[i:i + least(len(ws), {size}) - 1], ' ')
                               for i in range(1, greatest(len(ws) - {size}, 0) + 2)]) as w
                from b where len(ws) > 0),
sizes as (select distinct size from item_window),
doc_window as (select r, size, unnest(range(0, len(ws) - size + 1)) as spot,
                      unnest([array_to_string(ws[i:i + size - 1], ' ') for i in range(1, len(ws) - size + 2)]) as w
               from d cross join sizes where len(ws) >= size),
hit as (select r, spot, size, item from doc_window join item_window using (size, w)),
word as (select distinct r, unnest(range(spot, spot + size)) as spot from (select distinct r, spot, size from hit)),
n as (select r, count(*) as n_hit from word group by r),
listed as (select r, count(distinct item) as n_items, coalesce(string_agg(distinct item, ',' order by item), '') as items from hit group by r)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join listed using (r)
"""


def op12_lexical(k: int = 10) -> str:
    """The score of every document that shares a term with an item, ranked."""
    return f"""
with d as (select row_number() over () as r, doc_id, {_words('text')} as ws from documents),
b as (select row_number() over () as q, item_id, {_words('text')} as ws from benchmark),
total as (select cast(count(*) as bigint) as docs, cast(sum(len(ws)) as bigint) as words from d where len(ws) > 0),
tf as (select r, term, count(*) as tf from (select r, unnest(ws) as term from d) group by r, term),
df as (select term, count(*) as df from tf group by term),
weight as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from df, total),
asked as (select distinct q, item_id, unnest(ws) as term from b),
m as (select r, doc_id, 10 + (90 * cast(len(ws) as bigint) * docs) // words as m from d, total where len(ws) > 0),
scored as (select q, item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
           from asked join weight using (term) join tf using (term) join m using (r) group by q, item_id, r, doc_id),
ranked as (select *, row_number() over (partition by q order by score desc, doc_id nulls first) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= {k}
"""


def op13_conversations() -> str:
    """The same program as a recursion over the rows of a conversation, last first.

    It carries the cheapest edits of each grammar state as text and compares
    (cost, text), so that no walk is needed.
    """
    key = "coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"
    steps = f"flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split({key}, '')])"
    crc = (f"xor(4294967295, list_reduce(list_prepend(4294967295, [cast(x as bigint) for x in {steps}]), "
           "lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end))")
    white = "' ' || " + " || ".join(f"chr({i})" for i in range(9, 14))
    into, kept = {0: 2, 1: 2, 2: 3, 3: 2}, {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def edit(letter: str, cost: str, state: str) -> str:
        return f"{{'c': {cost} + {state}.c, 's': '{letter}' || {state}.s}}"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def before(q: int) -> str:
        keep = " ".join(f"when letter = '{i}' then [{edit('K', 't', f'z[{to + 1}]')}]" for i, to in kept[q].items())
        return (f"list_sort([{edit('D', '3', f'z[{q + 1}]')}] || case when gone then [] else [{edit('R', '2 + t', f'z[{into[q] + 1}]')}] end "
                f"|| case when gone then [] {keep} else [] end)[1]")

    insert = {2: least("y[3]", edit("I", "2", "y[4]")), 3: least("y[4]", edit("I", "2", "y[3]"))}
    return f"""
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as f from conversations),
damaged as (select conv_id, turn, case when f = 4 then 'user' else role end as role,
                   case when f = 1 then '' when f = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                   unnest(range(case when f = 3 then 2 else 1 end)) as copy
            from raw where f <> 0),
conv as (select conv_id, row_number() over () as k from (select distinct conv_id from conversations)),
placed as (select k, turn, role, text, left(role, 1) as initial, rtrim(text, {white}) as ended,
                  row_number() over (partition by k order by turn nulls first, role, sha256(text), copy) as i
           from damaged join conv on damaged.conv_id is not distinct from conv.conv_id),
seen as (select *, row_number() over (partition by k, role, text order by i) > 1 as again from placed),
fault as (select *, ended = '' as blank, ended <> '' and again as duplicate,
                 ended <> '' and not again and right(ended, 1) not in ('.', '!', '?') as truncated from seen),
letter as (select k, i, initial as letter, blank or duplicate as gone, cast(truncated as bigint) as t, role, text from fault),
adjacent as (select k, i, lag(initial) over (partition by k order by i) || initial as pair from fault),
bad as (select k, count(*) as illegal from adjacent where i > 1 and pair not in ('su', 'ua', 'au') group by k),
sums as (select k, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated
         from fault group by k),
dp(k, i, z) as (
  select k, n + 1, [{{'c': cast(0 as bigint), 's': ''}}, {{'c': cast(4 as bigint), 's': 'II'}}, {{'c': cast(2 as bigint), 's': 'I'}}, {{'c': cast(0 as bigint), 's': ''}}] from sums
  union all
  select k, i, [{least('y[1]', edit('I', '2', 'two'))}, {least('y[2]', edit('I', '2', 'two'))}, two, three]
  from (select k, i, y, {insert[2]} as two, {insert[3]} as three
        from (select dp.k, dp.i - 1 as i, [{before(0)}, {before(1)}, {before(2)}, {before(3)}] as y
              from dp join letter on letter.k = dp.k and letter.i = dp.i - 1))),
solved as (select k, z[1].c as cost, z[1].s as audit from dp where i = 1),
edit as (select k, unnest(string_split(audit, '')) as e, unnest(range(1, len(audit) + 1)) as p from solved where audit <> ''),
spot as (select k, p, e, count(*) filter (e <> 'I') over (partition by k order by p) as i, count(*) filter (e <> 'D') over (partition by k order by p) as j from edit),
turn as (select spot.k, p, e, j, role, text, left(first_value(case when e = 'K' then role else 'user' end) over (partition by spot.k order by p), 1) = 's' as opened
         from spot left join letter on letter.k = spot.k and letter.i = spot.i where e <> 'D'),
rebuilt as (select k, string_agg(case when e = 'K' then role when (j % 2 = 1) <> opened then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end,
                                 chr(10) order by p) as whole from turn group by k)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from conv left join sums using (k) left join bad using (k) left join solved using (k) left join rebuilt using (k)
"""
