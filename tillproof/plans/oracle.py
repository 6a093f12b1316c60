"""DuckDB SQL that says the same as the queries, built from shared common table expressions."""

from __future__ import annotations

from ..operators import reconcile as told
from .queries import LINES, LITERALS

LINE = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
CENTS = "cast(floor(l_extendedprice * 100 + cast(0.5 as double)) as bigint)"
ITEMS = f"items as (select l_orderkey as receipt_id, cast(row_number() over (partition by l_orderkey order by {LINE}) - 1 as int) as item_idx, {CENTS} as price from lineitem)"
BILLS = f"""own as (select l_orderkey as receipt_id, count(*) as n, cast(sum({CENTS}) as bigint) as s, cast(sum({CENTS} * cast(floor(l_tax * 100 + cast(0.5 as double)) as bigint)) as bigint) as t from lineitem group by 1),
b0 as (select o_orderkey as receipt_id, o_custkey as custkey, coalesce(n, 0) as n_items, coalesce(s, 0) as items_sum, (coalesce(t, 0) + 50) // 100 as tax from orders left join own on o_orderkey = receipt_id),
b1 as (select *, items_sum as subtotal, items_sum * (receipt_id % 5 * 5) // 100 as tip from b0),
bills as (select *, subtotal + tax + tip as total, cast(1 + custkey % 5 as int) as n_people from b1)"""
PEOPLE = "people as (select receipt_id, subtotal, tax, tip, total, n_people, cast(unnest(range(n_people)) as int) as k from bills)"
#: Who shares an item: those named, in the order of naming, or everybody.
SHARED = """named as (select i.receipt_id, i.item_idx, i.price, p.k, p.n_people, (i.item_idx * 7 + p.k + i.receipt_id) % 3 = 0 as hit from items i join people p using (receipt_id)),
counted as (select *, sum(cast(hit as int)) over (partition by receipt_id, item_idx) as hits from named),
seated as (select *, row_number() over (partition by receipt_id, item_idx order by case when hits > 0 and item_idx % 2 = 1 then -k else k end) - 1 as pos, count(*) over (partition by receipt_id, item_idx) as n from counted where hit or hits = 0),
cents as (select receipt_id, k, cast(floor(cast(price as double) / n) as bigint) + case when pos < price - cast(floor(cast(price as double) / n) as bigint) * n then 1 else 0 end as cents from seated),
eaten as (select p.receipt_id, p.k, p.n_people, p.tax, p.tip, p.total, coalesce(cast(sum(c.cents) as bigint), 0) as items from people p left join cents c using (receipt_id, k) group by all)"""


def shares(amount: str) -> str:
    """Steps that divide an amount by the column items."""
    a = amount
    return f"""{a}1 as (select receipt_id, k, case when sum(items) over w = 0 then cast({a} as double) / count(*) over w else cast({a} as double) * items / sum(items) over w end as exact, {a} from eaten window w as (partition by receipt_id)),
{a}2 as (select *, cast(floor(exact) as bigint) as low, exact - floor(exact) as frac from {a}1),
{a}3 as (select receipt_id, k, low + case when row_number() over (partition by receipt_id order by frac desc, k) <= {a} - sum(low) over (partition by receipt_id) then 1 else 0 end as share from {a}2)"""


SPLIT = f"with {ITEMS}, {BILLS}, {PEOPLE}, {SHARED}, {shares('tax')}, {shares('tip')}, done as (select e.receipt_id as bill_id, e.k as person_idx, 'p' || e.k as person_id, e.items, cast(x.share as bigint) as tax, cast(p.share as bigint) as tip, cast(e.items + x.share + p.share as bigint) as total, e.total as printed from eaten e join tax3 x using (receipt_id, k) join tip3 p using (receipt_id, k))"

LITERAL_ROWS = ", ".join(f"(-1, {i}, '{s}')" for i, s in enumerate(LITERALS))
PLAIN = "cast(price // 100 as varchar) || '.' || lpad(cast(price % 100 as varchar), 2, '0')"
RAW = f"""with {ITEMS}, made as (select *, {PLAIN} as s from items),
raws as (select receipt_id, item_idx, case receipt_id % 6 when 0 then s when 1 then ' $' || s when 2 then replace(s, '.', ',') when 3 then split_part(s, '.', 1) when 4 then substr(s, 1, 1) || ',' || substr(s, 2, 20) else s || '9' end as raw from made
union all select * from (values {LITERAL_ROWS})), bare as (select *, regexp_replace(raw, '[$\\s]', '', 'g') as x from raws)"""
CLEAN = "case when regexp_matches(x, '^\\d{1,3}(,\\d{3})+\\.\\d{2}$') then replace(x, ',', '') else regexp_replace(x, '^([^,]*),', '\\1.') end"
TYPED = "case when regexp_matches(x, '^\\d+,\\d{1,2}$') then replace(x, ',', '.') else replace(x, ',', '') end"

STREAK = """ef as (select user_id as session_id, row_number() over (partition by user_id order by ts, event_id) as frame_no, case when event_type <> 'error' then cast(floor(value / 100) as bigint) end as value from events),
isl as (select *, sum(case when value is null or value is distinct from before then 1 else 0 end) over (partition by session_id order by frame_no) as i from (select *, lag(value) over (partition by session_id order by frame_no) as before from ef)),
st as (select session_id, frame_no, value, case when value is null then 0 else row_number() over (partition by session_id, i order by frame_no) end as streak from isl)"""

FIELDS = ("subtotal", "tax", "tip", "total")
NULL = "cast(null as bigint)"


def each(text: str, sep: str = ", ") -> str:
    """The text for each of the four totals, which it calls {f}."""
    return sep.join(text.replace("{f}", f) for f in FIELDS)


def money(c: str) -> str:
    return f"(case when {c} < 0 then '-' else '' end || cast(abs({c}) // 100 as varchar) || '.' || lpad(cast(abs({c}) % 100 as varchar), 2, '0'))"


def plausible(s: str, x: str, p: str, t: str) -> str:
    return f"coalesce({s} > 0 and {t} > 0 and {t} >= {s} and ({x} is null or ({x} >= 0 and cast({x} as double) <= cast({s} as double) * cast(0.3 as double))) and ({p} is null or ({p} >= 0 and cast({p} as double) <= cast({s} as double))), false)"


def those(items: str) -> str:
    """A list without its nulls."""
    return f"list_filter([{items}], lambda x: x is not null)"


def judged(name: str, source: str, prefix: str = "") -> str:
    """Steps that end in the table `name`: source with status, v_*, backed, fixes (structs of field, old, new, why) and problems.

    prefix begins the names of the six columns that are judged. Steps are materialised: written out in each other they grow exponentially.
    """
    n, now = name, ("g_sub", "g_tax", "g_tip1", "g_total")
    own = f"{prefix}n_items as g_n, {prefix}items_sum as g_i, " + each(f"{prefix}{{f}} as g_{{f}}")
    hole = "case when g_sub is null then 'subtotal' when g_tax is null then 'tax' when g_tip1 is null then 'tip' when g_total is null then 'total' end"
    answer = "case hole when 'subtotal' then g_total - g_tax - g_tip1 when 'tax' then g_total - g_sub - g_tip1 when 'tip' then g_total - g_sub - g_tax when 'total' then g_sub + g_tax + g_tip1 end"
    trial = [f"case when hole = '{f}' then answer else {c} end" for f, c in zip(FIELDS, now, strict=True)]
    filled = ", ".join(f"case when fit and hole = '{f}' then answer else {c} end as w_{f}" for f, c in zip(FIELDS, now, strict=True))
    can = {f: plausible(*(f"d_{g}" if g == f else f"w_{g}" for g in FIELDS)) for f in FIELDS}
    cans = ", ".join(f"coalesce(gap and d_{f} <> w_{f} and {can[f]}{' and not backed' if f == 'subtotal' else ''}, false) as can_{f}" for f in FIELDS)

    def fix(when: str, field: str, old: str, new: str, why: str) -> str:
        return f"case when {when} then {{'field': {field}, 'old': {old}, 'new': cast({new} as bigint), 'why': {why}}} end"

    fixes = [
        fix("derived", "'subtotal'", NULL, "g_i", f"'{told.SUMMED[0]}' || g_n || '{told.SUMMED[1]}'"),
        fix("notip", "'tip'", NULL, "0", f"'{told.NO_TIP}'"),
        fix("fit", "hole", NULL, "answer", f"'{told.REQUIRED}' || {money('answer')}"),
    ]
    for f in FIELDS:
        why = f"'{told.CORRECTED[0]}{f}{told.CORRECTED[1]}' || {money('w_' + f)} || '{told.CORRECTED[2]}' || {money('d_' + f)} || '{told.CORRECTED[3]}'"
        fixes.append(fix(f"ways = 1 and can_{f}", f"'{f}'", f"w_{f}", f"d_{f}", why))
    lost = f"array_to_string({those(each("case when w_{f} is null then '{f}' end"))}, ', ')"
    names = f"array_to_string({those(each("case when can_{f} then '{f}' end"))}, ', ')"
    problems = [
        f"case when gap and ways = 0 then '{told.NO_WAY}' end",
        f"case when gap and ways > 1 then '{told.MANY_WAYS[0]}' || ways || '{told.MANY_WAYS[1]}' || {names} || '{told.MANY_WAYS[2]}' end",
        f"case when not whole and not disputed then '{told.MISSING[0]}' || {lost} || '{told.MISSING[1]}' end",
        f"case when g_n > 0 and w_subtotal is not null and not backed then '{told.DISPUTED[0]}' || {money('g_i')} || '{told.DISPUTED[1]}' || {money('w_subtotal')} || '{told.DISPUTED[2]}' end",
    ]
    made = "g_n, g_i, " + each("g_{f}") + ", derived, g_sub, disputed, notip, g_tip1, gaps, hole, answer, fit, " + each("w_{f}, d_{f}, can_{f}") + ", whole, closes, gap, ways"
    return f"""{n}1 as materialized (select *, {own} from {source}),
{n}2 as materialized (select *, g_subtotal is null and g_n > 0 as derived, case when g_subtotal is null and g_n > 0 then g_i else g_subtotal end as g_sub from {n}1),
{n}3 as materialized (select *, coalesce(g_n > 0 and g_i <> g_sub, false) as disputed, coalesce(g_n > 0 and g_i = g_sub, false) as backed from {n}2),
{n}4 as materialized (select *, g_tip is null and coalesce(g_sub + g_tax = g_total, false) and not disputed as notip from {n}3),
{n}5 as materialized (select *, case when notip then 0 else g_tip end as g_tip1 from {n}4),
{n}6 as materialized (select *, cast(g_sub is null as int) + cast(g_tax is null as int) + cast(g_tip1 is null as int) + cast(g_total is null as int) as gaps, {hole} as hole from {n}5),
{n}7 as materialized (select *, case when gaps = 1 and not disputed then {answer} end as answer from {n}6),
{n}8 as materialized (select *, answer is not null and {plausible(*trial)} as fit from {n}7),
{n}9 as materialized (select *, {filled} from {n}8),
{n}a as materialized (select *, {each('w_{f} is not null', ' and ')} as whole, w_total - w_tax - w_tip as d_subtotal, w_total - w_subtotal - w_tip as d_tax, w_total - w_subtotal - w_tax as d_tip, w_subtotal + w_tax + w_tip as d_total from {n}9),
{n}b as materialized (select *, whole and not disputed and coalesce(d_total = w_total, false) as closes, whole and not disputed and coalesce(d_total <> w_total, false) as gap from {n}a),
{n}c as materialized (select *, {cans} from {n}b),
{n}d as materialized (select *, {each('cast(can_{f} as int)', ' + ')} as ways from {n}c),
{n}e as materialized (select *, {those(', '.join(fixes))} as fixes, {each('case when ways = 1 and can_{f} then d_{f} else w_{f} end as v_{f}')} from {n}d),
{n}f as materialized (select *, case when closes and len(fixes) = 0 then 'reconciled' when closes or ways = 1 then 'repaired' else 'unresolved' end as status from {n}e),
{n}g as materialized (select *, case when status = 'unresolved' then {those(', '.join(problems))} else [] end as problems from {n}f),
{n} as materialized (select * exclude ({made}) from {n}g)"""


MISREAD = f"""{ITEMS}, {BILLS},
firsts as (select receipt_id, price as first_price from items where item_idx = 0),
ms as (select b.*, coalesce(first_price, 0) as first_price, receipt_id % 16 as m from bills b left join firsts using (receipt_id)),
misread as (select receipt_id, m, subtotal as true_subtotal, tax as true_tax, tip as true_tip, total as true_total,
 case when m in (11, 14) then 0 when m = 8 and n_items > 0 then n_items - 1 else n_items end as n_items,
 case when m in (11, 14) then 0 when m = 8 then items_sum - first_price else items_sum end as items_sum,
 case when m = 5 or (m = 11 and receipt_id // 16 % 2 = 1) then null when m = 14 then total else subtotal end as subtotal,
 case when m in (3, 9) then null when m in (6, 12) then tax * 100 + 9 else tax end as tax,
 case when m in (4, 9, 13) then null when m = 12 then 3 * subtotal else tip end as tip,
 case when m = 15 then null when m = 4 then total - tip when m = 7 then total + 7 when m = 10 then total // 10 else total end as total from ms)"""
RECON = f"with {MISREAD}, {judged('rec', 'misread')}"
WRONG = each("v_{f} is distinct from true_{f}", " or ")
NO_TIP = "coalesce(status = 'repaired' and tip is null and len(fixes) = 1 and fixes[1].field = 'tip' and fixes[1].new = 0, false)"
SETTLES = f"(status = 'reconciled' or {NO_TIP})"


def verdict(percent: str, cents: str) -> str:
    """Steps that end in verdict: rec with settles, added_tip, pay_tip and pay_total."""
    extra = f"cast(coalesce({cents}, cast(floor(cast(v_subtotal as double) * {percent} / 100 + cast(0.5 as double)) as bigint), 0) as bigint)"
    return f"{RECON}, ver as (select *, {NO_TIP} as no_tip_printed, {SETTLES} as settles, {extra} as extra from rec), verdict as (select *, case when settles then extra else 0 end as added_tip, case when settles then v_tip + extra end as pay_tip, case when settles then v_total + extra end as pay_total from ver)"


FRAMES = f"""{ITEMS}, {BILLS},
own_prices as (select receipt_id, list(price) as prices from items group by 1),
fr0 as (select b.*, coalesce(prices, cast([] as bigint[])) as ps, cast(unnest(range(1, 7)) as int) as frame_no from bills b left join own_prices using (receipt_id)),
fr1 as (select *, receipt_id // 10 % 4 as profile, (receipt_id * 31 + frame_no * 17) % 7 as c from fr0),
fr2 as (select *, case profile when 0 then c when 1 then case when c < 2 then c + 2 else c end when 2 then 2 else 7 end as k from fr1),
fr3 as (select receipt_id as session_id, frame_no, list_sort(list_concat(ps, case when k = 4 then [cast(999 as bigint)] when k = 7 then [cast(100 + frame_no as bigint)] else cast([] as bigint[]) end)) as prices,
 case when k = 6 then subtotal + 100 when k = 7 then subtotal + frame_no * 3 else subtotal end as subtotal,
 case when k = 2 then null when k = 7 then tax + frame_no * 5 else tax end as tax,
 case when k in (5, 7) then null else tip end as tip,
 case when k = 3 then total + 7 when k = 7 then total + 7 * frame_no else total end as total,
 subtotal as true_subtotal, tax as true_tax, tip as true_tip, total as true_total from fr2),
frames as (select *, cast(len(prices) as bigint) as n_items, cast(coalesce(list_sum(prices), 0) as bigint) as items_sum, coalesce(array_to_string(prices, ','), '') as items_key from fr3)"""


def streak(name: str, source: str, value: str, out: str) -> str:
    """Steps that add out: how many frames in a row have held the value; 0 where it is null."""
    w = "partition by session_id order by frame_no"
    return f"""{name}1 as (select *, case when {value} is null or {value} is distinct from lag({value}) over ({w}) then 1 else 0 end as s_new from {source}),
{name}2 as (select *, sum(s_new) over ({w}) as s_island from {name}1),
{name} as (select * exclude (s_new, s_island), case when {value} is null then 0 else row_number() over (partition by session_id, s_island order by frame_no) end as {out} from {name}2)"""


def observed(source: str) -> str:
    """Steps that end in obs: streaks, confirmations needed, confirmed values and disagreements in a row."""
    w = "partition by session_id order by frame_no"
    steps, before = [f"ob0 as (select *, case when n_items > 0 then items_key end as ikey from {source})"], "ob0"
    for f in FIELDS:
        steps.append(streak(f"ob_{f}", before, f, f"streak_{f}"))
        before = f"ob_{f}"
    steps.append(streak("ob_i", before, "ikey", "streak_items"))
    tokens = "n_items + " + each("cast({f} is not null as int)", " + ")
    most = "greatest(" + each("streak_{f}") + ", streak_items)"
    steps.append(f"ob1 as (select *, case when max(cast({tokens} >= 25 as int)) over ({w}) = 1 then 3 else 2 end as needed, row_number() over ({w}) as frames_seen, {most} = 1 as differs from ob_i)")
    steps.append(f"ob2 as (select *, sum(cast(not differs as int)) over ({w}) as d_island from ob1)")
    held = each("case when streak_{f} >= needed then {f} end as c_{f}")
    steps.append(f"obs as (select *, sum(cast(differs as int)) over (partition by session_id, d_island order by frame_no) as disagreements, {held}, case when streak_items >= needed then n_items else 0 end as c_n_items, case when streak_items >= needed then items_sum else 0 end as c_items_sum from ob2)")
    return ", ".join(steps)


def settled(source: str) -> str:
    """Steps that end in ses: each frame alone, then the confirmed view, then the accept policy."""

    def kept(p: str) -> str:
        return f"* exclude (status, fixes, problems, backed, {each('v_{f}')}), status as {p}_status, {each(f'v_{{f}} as {p}_v_{{f}}')}"

    pick = each("case when via = 'consensus' then b_v_{f} else a_v_{f} end as v_{f}")
    values = each("coalesce(cast(v_{f} as varchar), 'x')", " || '/' || ")
    return f"""{observed(source)}, {judged('al', 'obs')}, alone as (select {kept('a')} from al), {judged('bo', 'alone', 'c_')}, both_views as (select {kept('b')} from bo),
ways_seen as (select *, case when a_status <> 'unresolved' then 'frame' when b_status <> 'unresolved' then 'consensus' end as via from both_views),
views as (select *, case when via = 'consensus' then b_status else a_status end as status, {pick} from ways_seen),
rep0 as (select *, case when via = 'frame' and status = 'repaired' then {values} || '|' || items_key end as rkey from views),
{streak('rep', 'rep0', 'rkey', 'repeats')},
ses as (select *, via is not null and (status = 'reconciled' or via = 'consensus' or repeats >= 2) as accepted, n_items > 0 or {each('{f} is not null', ' or ')} as saw_money from rep)"""


ACCEPT = f"""first_accepted as (select session_id, count(*) as n_frames, min(case when accepted then frame_no end) as settled_frame from ses group by 1),
told as (select a.session_id, n_frames, settled_frame, via, status, {each('v_{f}')} from first_accepted a left join (select session_id, frame_no, via, status, {each('v_{f}')} from ses) s on s.session_id = a.session_id and s.frame_no = settled_frame)"""

TOTAL_LINES = " union all ".join(f"select receipt_id, n_items + {3 + k}, '{f.upper()}', {f} from bills" for k, f in enumerate(FIELDS))
PRINTED = f"""{ITEMS}, {BILLS},
named_items as (select l_orderkey as receipt_id, cast(row_number() over (partition by l_orderkey order by {LINE}) - 1 as int) as item_idx, {CENTS} as price, p_name from lineitem left join part on l_partkey = p_partkey),
printed as (select receipt_id, 0 as line, 'SHOP ' || receipt_id % 97 as label, {NULL} as price from bills union all select receipt_id, 1, '----------', null from bills union all
select receipt_id, item_idx + 2, p_name, price from named_items union all select receipt_id, n_items + 2, '----------', null from bills union all {TOTAL_LINES} union all select receipt_id, n_items + 7, 'THANK YOU', null from bills),
texts as (select receipt_id, cast(row_number() over (partition by receipt_id order by line) - 1 as int) as row_idx, label, price, label || case when price is null then '' else ' ' || {PLAIN} end as text from printed)"""

LEVELS = "list_transform(embedding, lambda x: greatest(0, least(255, cast(floor(cast(x as double) * 64 + 128) as int))))"


def normal(c: str) -> str:
    """Upper case, one space for white space, none at the ends."""
    return f"regexp_replace(regexp_replace(upper({c}), '\\s+', ' ', 'g'), '^ | $', '', 'g')"


def half_up(x: str) -> str:
    return f"cast(floor(({x}) + cast(0.5 as double)) as bigint)"


def repaired_value(f: str) -> str:
    own = f"list_filter(fixes, lambda x: x.field = '{f}')"
    return f"case when len({own}) > 0 then {own}[-1].new else {f} end as {f}"


def right(prefix: str) -> str:
    return f"not ({each(prefix + '{f} is distinct from true_{f}', ' or ')})"


def policies(profile: str) -> str:
    """Steps on ses that count what each policy of accepting settles, and the final selection."""
    tries = " union all ".join(f"select session_id, frame_no, '{name}' as policy, {ok} as ok, {right(p)} as good from ses" for name, ok, p in (("single", "a_status <> 'unresolved'", "a_v_"), ("streak", "b_status <> 'unresolved'", "b_v_"), ("combined", "accepted", "v_")))
    return f"""tries as ({tries}), best as (select session_id, policy, arg_min(good, frame_no) filter (where ok) as good from tries group by all)
select {profile} as profile, policy, count(*) as sessions, count(good) as settled, cast(coalesce(sum(cast(good as int)), 0) as bigint) as correct from best group by all"""


#: Frames whose amounts are lost by the rule of sources.words.degraded().
POOR = f"""{PRINTED}, looks as (select receipt_id as session_id, cast(unnest(range(1, 5)) as int) as frame_no, line, label, price, n_items as dishes from printed join bills using (receipt_id) where price is not null),
reads as (select *, case when (session_id * 31 + line * 7 + frame_no * 13) % 17 > 1 then price end as read from looks),
seen as (select session_id, frame_no, list_sort(list(read) filter (where line < dishes + 2 and read is not null)) as prices, {each("max(read) filter (where line >= dishes + 3 and label = upper('{f}')) as {f}")} from reads group by all),
frames as (select s.*, cast(coalesce(len(prices), 0) as bigint) as n_items, cast(coalesce(list_sum(prices), 0) as bigint) as items_sum, coalesce(array_to_string(prices, ','), '') as items_key, {each("b.{f} as true_{f}")} from seen s join bills b on b.receipt_id = session_id)"""
TONE = f"case when n_items = 0 and coalesce({each('{f}')}) is null then 'idle' when {SETTLES} then 'ok' when status = 'repaired' then 'warn' else 'bad' end"
TEXTS = ", ".join(f"'{x}'" for x in LINES)


#: Areas of the planes, as sums over the cells that they cover.
AVERAGED = f"""with l as (select vec_id, {LEVELS} as v from embeddings), sizes as (select * from (values (5, 8, 8, 5, 5), (3, 8, 6, 3, 2)) s(longest, ww, hh, w, h)),
cells as (select vec_id, v, longest, ww, hh, w, h, cast(unnest(range(w * h)) as int) as p from l, sizes),
sums as (select vec_id, longest, w, h, p, list_sum(list_transform(range(ww * hh), lambda c: v[c % ww + c // ww * 8 + 1]
 * greatest(0, least((c % ww + 1) * w, (p % w + 1) * ww) - greatest(c % ww * w, p % w * ww)) * greatest(0, least((c // ww + 1) * h, (p // w + 1) * hh) - greatest(c // ww * h, p // w * hh)))) / cast(ww * hh as double) as x from cells)"""
SESSION_RESET = f"with {FRAMES}, two as (select * exclude (session_id), session_id * 2 + cast(frame_no > 3 as int) as session_id from frames), {settled('two')}, {ACCEPT} select * from told"
SQL: dict[str, str] = {
    "q01_split_shares": f"{SPLIT} select bill_id, person_idx, person_id, items, tax, tip, total from done",
    "q02_split_sum_check": f"{SPLIT}, sums as (select bill_id, sum(total) as shared, count(*) as n, any_value(printed) as printed from done group by 1) select count(*) as bills, cast(sum(n) as bigint) as shares, cast(sum(cast(shared <> printed as int)) as bigint) as mismatches, cast(sum(shared) as bigint) as shared from sums",
    "q04_even_split": f"with {BILLS}, {PEOPLE} select receipt_id as bill_id, k as person_idx, cast(floor(cast(total as double) / n_people) as bigint) + case when k < total - cast(floor(cast(total as double) / n_people) as bigint) * n_people then 1 else 0 end as total from people",
    "q12_parse_cents": f"{RAW} select receipt_id, item_idx, raw, case when regexp_matches({CLEAN}, '^\\d+\\.\\d{{2}}$') then try_cast(replace({CLEAN}, '.', '') as bigint) end as cents from bare",
    "q13_parse_typed": f"{RAW}, t as (select *, {TYPED} as y from bare) select receipt_id, item_idx, raw, case when regexp_matches(y, '^\\d+(\\.\\d{{0,2}})?$') then cast(split_part(y, '.', 1) as bigint) * 100 + cast(rpad(split_part(y, '.', 2), 2, '0') as bigint) end as cents from t",
    "q14_format_cents": f"with {ITEMS}, c as (select receipt_id, item_idx, case when item_idx % 2 = 0 then price else -(price % 1000) end as c from items), a as (select *, cast(abs(c) // 100 as varchar) || '.' || lpad(cast(abs(c) % 100 as varchar), 2, '0') as plain from c) select receipt_id, item_idx, plain, case when c < 0 then '-' else '' end || plain as signed from a",
    "q18_parse_roundtrip": f"with {ITEMS}, {BILLS}, texts as (select l_orderkey as receipt_id, cast(row_number() over (partition by l_orderkey order by {LINE}) - 1 as int) as item_idx, {CENTS} as price, p_name from lineitem join part on l_partkey = p_partkey), told as (select receipt_id, string_agg(p_name || '=' || price, ';' order by item_idx) as items from texts group by 1) select receipt_id, subtotal, tax, tip, total, n_items, items_sum, coalesce(items, '') as items from bills left join told using (receipt_id)",
    "q21_field_streaks": f"with {STREAK} select session_id, frame_no, value, streak, streak >= 2 as confirmed from st",
    "q24_unsteady": f"with {STREAK}, g as (select *, sum(cast(streak <> 1 as int)) over (partition by session_id order by frame_no) as j from st), r as (select *, sum(cast(streak = 1 as int)) over (partition by session_id, j order by frame_no) as run from g) select session_id, frame_no, cast(run as int) as run, run >= 6 as unsteady from r",
    "q40_snapshot_gate": f"with {BILLS} select receipt_id, subtotal, tax, tip, total, case when receipt_id % 3 <> 0 then 'a.png' end as image from bills where receipt_id % 2 = 0",
    "q03_apportion_ties": f"""with {ITEMS},
rows1 as (select receipt_id - 30 as g, item_idx as i, receipt_id * 37 % 1501 - 300 as amount, case when receipt_id % 9 = 0 then 0 else receipt_id * (item_idx + 3) % 7 end as w from items),
x as (select *, case when sum(w) over p = 0 then cast(amount as double) / count(*) over p else cast(amount as double) * w / sum(w) over p end as exact from rows1 window p as (partition by g)),
y as (select *, cast(floor(exact) as bigint) as low, exact - floor(exact) as frac from x)
select g, i, amount, w, cast(low + case when row_number() over (partition by g order by frac desc, i) <= amount - sum(low) over (partition by g) then 1 else 0 end as bigint) as share from y""",
    "q05_reconcile": f"{RECON} select receipt_id, status, {each('v_{f}')}, array_to_string(list_transform(fixes, lambda x: x.field || '=' || x.new), ';') as fixes, backed as corroborated from rec",
    "q06_reconcile_status_counts": f"{RECON} select m, status, count(*) as n, cast(sum(items_sum) as bigint) as items_sum from rec group by all",
    "q07_repairs_exploded": f"{RECON}, x as (select receipt_id, unnest(fixes) as r, unnest(range(len(fixes))) as pos from rec where status <> 'unresolved') select receipt_id, cast(pos as int) as pos, r.field as field, r.old as from_cents, r.new as to_cents, r.why as reason from x",
    "q08_problem_texts": f"{RECON} select receipt_id, array_to_string(problems, ' / ') as problems from rec where status = 'unresolved'",
    "q09_apply_repairs": f"{RECON}, fixed as (select receipt_id, n_items, items_sum, {', '.join(map(repaired_value, FIELDS))} from rec where status = 'repaired'), {judged('again', 'fixed')} select receipt_id, {each('{f}')}, status from again",
    "q10_verdict_added_tip": f"{verdict('case receipt_id % 4 when 1 then cast(18 as double) when 2 then cast(12.5 as double) end', 'case receipt_id % 4 when 3 then 250 end')} select receipt_id, settles, settles and n_items = 0 as evenly, added_tip, pay_tip, pay_total from verdict",
    "q11_no_tip_printed": f"{verdict('cast(null as double)', NULL)} select receipt_id, v_tip, pay_total from verdict where no_tip_printed",
    "q15_label_classify": rf"""with t as (select distinct text from (select unnest([{TEXTS}]) as text union all select upper(p_name) from part)), u as (select text, upper(text) as u, regexp_replace(upper(text), '^\s+|\s+$', '', 'g') as s from t)
select text, case when regexp_matches(u, '\b(SUB\s?-?\s?TOTAL|SUBTTL)\b') then 'subtotal' when regexp_matches(u, '\b(TAX|VAT|GST|HST|PST|SALES\s?TAX)\b') then 'tax' when regexp_matches(u, '\b(TIP|GRATUITY|SERVICE(\s?(CHARGE|CHG))?)\b') then 'tip' when regexp_matches(u, '\b(GRAND\s?TOTAL|TOTAL|BALANCE(\s?DUE)?|AMOUNT\s?DUE)\b') then 'total' end as label,
regexp_matches(s, '^(?:(?s:.{{0,14}})[^A-Z])?(?:SUB\s?-?\s?TOTAL|SUBTTL|GRAND\s?TOTAL|TOTAL|BALANCE(?:\s?DUE)?|AMOUNT\s?DUE)\b') as opens,
regexp_matches(u, '\b(CASH|CHANGE|VISA|MASTERCARD|MC|AMEX|DEBIT|CREDIT|CARD|TENDER|AUTH|APPROVED|REF|ACCT)\b') as payment, regexp_full_match(text, '[-_=~*.\s]+') as divider from u""",
    "q16_row_cluster": f"with {PRINTED} select receipt_id, row_idx, text from texts",
    "q17_price_column": f"with {PRINTED} select receipt_id, cast(575 as double) as column_x, count(price) as n_priced, cast(sum(price) as bigint) as price_sum from texts group by 1",
    "q19_unreadable": f"with {BILLS} select receipt_id, case receipt_id % 3 when 0 then 'tax' when 1 then 'total' else '' end as unreadable, subtotal, case when receipt_id % 3 <> 0 then tax end as tax, case when receipt_id % 3 <> 1 then total end as total from bills",
    "q20_slope": "select o_orderkey as receipt_id, cast(15 as double) as line_height, cast(o_orderkey % 7 - 3 as double) / 100 as slope from orders",
    "q22_items_streak": f"with {FRAMES}, {streak('st', 'frames', 'items_key', 'streak')} select session_id, frame_no, items_key, streak from st",
    "q23_dense_latch": f"with {FRAMES}, dense as (select * exclude (n_items), case when frame_no >= 3 then n_items * 4 else n_items end as n_items from frames), {observed('dense')} select session_id, frame_no, needed, c_total, frames_seen from obs",
    "q25_settle_frames": f"with {FRAMES}, {settled('frames')} select session_id, frame_no, via, status, {each('v_{f}')} from ses",
    "q26_session_accept": f"with {FRAMES}, {settled('frames')}, {ACCEPT} select * from told",
    "q27_policy_compare": f"with {FRAMES}, {settled('frames')}, {policies('cast(session_id // 10 % 4 as int)')}",
    "q28_multiset_recall": f"""with {FRAMES}, seen as (select session_id, frame_no, price, count(*) as n from (select session_id, frame_no, unnest(prices) as price from frames) group by all),
true_items as (select receipt_id as session_id, price, count(*) as n from items group by all),
hit as (select session_id, frame_no, cast(sum(least(s.n, t.n)) as bigint) as hits from seen s join true_items t using (session_id, price) group by all),
total_items as (select session_id, cast(sum(n) as bigint) as n_true from true_items group by 1)
select session_id, frame_no, n_true, coalesce(hits, 0) as hits, {each('cast(list_contains(prices, true_{f}) or coalesce(true_{f} in (subtotal, tax, tip, total), false) as int)', ' + ')} as fields_found from frames join total_items using (session_id) left join hit using (session_id, frame_no)""",
    "q29_char_accuracy": f"""with d as (select p_partkey, concat_ws(' ', p_name, p_brand, p_type) as t from part), x as (select p_partkey, {normal('t')} as a, {normal("translate(t, 'aeo', 'o0')")} as b from d)
select p_partkey, levenshtein(a, b) as distance, round(greatest(0, 1 - cast(levenshtein(a, b) as double) / greatest(1, length(a))), 9) as accuracy from x""",
    "q30_variant_rollup": f"{RECON} select m, count(*) as n, count(*) filter (where status <> 'unresolved') as settled, count(*) filter (where not ({WRONG})) as all_right, round(cast(count(*) filter (where status <> 'unresolved') as double) / count(*), 9) as rate from rec group by grouping sets ((m), ())",
    "q31_safety_property": f"{RECON} select m, count(*) as settled, count(*) filter (where {WRONG}) as wrong from rec where status <> 'unresolved' group by m",
    "q32_bill_edits": f"""with {ITEMS}, {BILLS}, dishes as (select receipt_id, item_idx, price from items union all select receipt_id, n_items, 250 from bills),
kept as (select receipt_id, case when item_idx = 1 then 100 else price end as price from dishes where item_idx <> 2)
select receipt_id as bill_id, cast(500 as bigint) as tip, cast(count(k.price) as int) as n_items, cast(sum(k.price) as bigint) as items_sum, 'P0,Zoe,Friend' as people, 'p2' as first_assignees, 'Soup' as first_desc, cast(15 as double) as tip_percent, any_value(b.n_items) + 3 as next_id from bills b join kept k using (receipt_id) group by receipt_id""",
    "q33_placeholder_names": """with c as (select c_nationkey, case when c_custkey % 7 = 0 then 'friend' else 'friend ' || (c_custkey % 7 + c_nationkey % 3) end as name, case when c_custkey % 5 = 0 then 0 else c_custkey end as number from customer),
g as (select c_nationkey, count(*) as n, list(distinct name) as taken, max(number) as most from c group by 1), tries as (select c_nationkey, most, unnest(range(1, n + 2)) as k, taken from g)
select c_nationkey, arg_min(case when k = 1 then 'Friend' else 'Friend ' || k end, k) as name, cast(greatest(1, any_value(most) + 1) as bigint) as next_id from tries where not list_contains(taken, case when k = 1 then 'friend' else 'friend ' || k end) group by 1""",
    "q36_stream_session": f"with {FRAMES}, {settled('frames')}, {ACCEPT} select session_id, settled_frame, via, status, {each('v_{f}')} from told",
    "q37_status_and_tone": f"""with {FRAMES}, {settled('frames')}, lines as (select session_id, frame_no, n_items, items_sum, {each('{f}')}, via as via_seen, disagreements >= 6 as unsteady, repeats >= 1 and not accepted as again, saw_money, session_id % 70 as k from ses),
said as (select *, case when k = 0 then 'Couldn’t load the reader. Reload the page to try again.' when k = 20 then 'Reading the receipt…' when k = 10 then 'Loading the reader. About 4.5 MB, first time only.' when k = 30 then null when k = 40 then 'Fill the frame with the receipt.' when unsteady then 'Hold steady.' when again then 'Almost there. Hold still.' when not saw_money then 'No prices yet. Move closer or add light.' else 'Reading… keep the whole receipt in frame.' end as line,
case when k = 50 then 'Read from your photo' when via_seen = 'consensus' then 'Confirmed across ' || frame_no || ' frames' when frame_no = 1 then 'Read and verified in one frame' else 'Verified on frame ' || frame_no end as origin from lines), {judged('ton', 'said')}
select session_id, frame_no, line, origin, {TONE} as tone from ton""",
    "q38_geometry_scalars": f"""with a as (select i, i * 7 % 4001 as fw, i * 13 % 3001 as fh, i * 3 % 801 as ew, i * 5 % 601 as eh from (select p_partkey as i from part)),
b as (select *, ew > 0 and eh > 0 and fw > 0 and fh > 0 as known, cast(ew as double) / nullif(eh, 0) as e, cast(fw as double) / nullif(fh, 0) as r from a),
c as (select *, coalesce(known and r > e, false) as wide, coalesce(known and r < e, false) as tall, greatest(1, {half_up('fh * e')}) as narrow, greatest(1, {half_up('fw / nullif(e, 0)')}) as low from b),
d as (select *, case when wide then narrow else fw end as w, case when tall then low else fh end as h, case when wide then cast(floor((fw - narrow) / cast(2 as double)) as bigint) else 0 end as x, case when tall then cast(floor((fh - low) / cast(2 as double)) as bigint) else 0 end as y, least(cast(1 as double), cast(3000 as double) / nullif(greatest(fw, fh), 0)) as s from c)
select i, round(least(cast(6 as double), greatest(cast(1.5 as double), cast(fw as double) / 900 * cast(1.5 as double))), 9) as sigma, x + {half_up('w * cast(0.1 as double)')} as sx, y + {half_up('h * cast(0.05 as double)')} as sy, greatest(1, {half_up('w * cast(0.8 as double)')}) as sw, greatest(1, {half_up('h * cast(0.9 as double)')}) as sh,
case when fw > 0 and fh > 0 then greatest(1, {half_up('fw * s')}) end as width, case when fw > 0 and fh > 0 then greatest(1, {half_up('fh * s')}) end as height from d""",
    "q39_flatten_words": f"with {PRINTED} select receipt_id, string_agg(text, ' ' order by row_idx) as text, cast(sum(len(string_split(text, ' '))) as bigint) as n, cast(90 as double) as confidence, cast(575 as double) as width from texts group by 1",
    "q41_fixture_discovery": "with stems as (select c_custkey as k, 'r' || c_custkey as stem from customer where c_custkey % 7 <> 3) select stem, stem || case when k % 11 = 5 then null when k % 5 = 0 then '.png' when k % 4 = 1 then '.jpg' when k % 3 = 0 then '.jpeg' when k % 2 = 0 then '.webp' end as path from stems",
    "q42_still_policy": f"{RECON} select receipt_id, status <> 'unresolved' as settled, status, n_items > 0 or {each('{f} is not null', ' or ')} as saw_money from rec",
    "q43_session_reset": SESSION_RESET,
    "q55_stream_reset": SESSION_RESET,
    "q44_ghost_assignees": f"""with {ITEMS}, {BILLS}, {PEOPLE}, named as (select i.receipt_id, i.item_idx, i.price, p.k, i.item_idx > 0 and (i.item_idx * 7 + p.k + i.receipt_id) % 3 = 0 as hit from items i join people p using (receipt_id)),
counted as (select *, sum(cast(hit as int)) over (partition by receipt_id, item_idx) as hits from named),
seated as (select *, row_number() over (partition by receipt_id, item_idx order by case when hits > 0 and item_idx % 2 = 1 then -k else k end) - 1 as pos, count(*) over (partition by receipt_id, item_idx) as n from counted where hit or hits = 0)
select receipt_id as bill_id, 'p' || k as person_id, cast(sum(cast(floor(cast(price as double) / n) as bigint) + case when pos < price - cast(floor(cast(price as double) / n) as bigint) * n then 1 else 0 end) as bigint) as cents, count(*) as n from seated group by all""",
    "q45_correlated_walk": """with a as (select o_orderkey as receipt_id, case when o_orderkey % 5 = 0 then cast(1 as double) else exp(-cast(o_orderkey % 5 as double) * 40 / 100) end as rho from orders),
b as (select receipt_id, rho, sqrt(1 - rho * rho) as part from a)
select receipt_id, round(list_reduce(list_prepend(cast(0.25 as double), list_transform(range(1, 13), lambda k: cast((receipt_id * 31 + k * 17) % 101 as double) / 100 - cast(0.5 as double))), lambda x, d: rho * x + part * d), 9) as x from b""",
    "q47_text_folds": f"""with s as (select p_partkey, p_name, '<' || p_name || '&''> 10' as s from part) select p_partkey, translate(s, '01', 'OI') as folded, replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(39), '&apos;') as escaped, {normal("'  ' || p_name || ' ' || chr(9) || ' x '")} as normal from s""",
    "q48_pgm_encode": f"select vec_id as image_id, hex(encode('P5' || chr(10) || '8 8' || chr(10) || '255' || chr(10))) || array_to_string(list_transform({LEVELS}, lambda v: printf('%02X', v)), '') as pgm from embeddings",
    "q49_verdict_split": f"""{verdict('case receipt_id % 4 when 1 then cast(18 as double) when 2 then cast(12.5 as double) end', 'case receipt_id % 4 when 3 then 250 end')},
seats as (select receipt_id, case when receipt_id % 23 = 0 then 0 else n_people end as n_people from bills),
due as materialized (select receipt_id, n_items = 0 as evenly, v_tax as tax, pay_tip as tip, pay_total as total, n_people, cast(unnest(range(n_people)) as int) as k from verdict join seats using (receipt_id) where settles),
own_items as (select receipt_id, item_idx, price from items where receipt_id % 16 not in (11, 14) and (receipt_id % 16 <> 8 or item_idx > 0)),
named as (select i.receipt_id, i.item_idx, i.price, d.k, (i.item_idx * 7 + d.k + i.receipt_id) % 3 = 0 as hit from own_items i join due d using (receipt_id) where not evenly),
counted as (select *, sum(cast(hit as int)) over (partition by receipt_id, item_idx) as hits from named),
seated as (select *, row_number() over (partition by receipt_id, item_idx order by case when hits > 0 and item_idx % 2 = 1 then -k else k end) - 1 as pos, count(*) over (partition by receipt_id, item_idx) as n from counted where hit or hits = 0),
cents as (select receipt_id, k, cast(floor(cast(price as double) / n) as bigint) + case when pos < price - cast(floor(cast(price as double) / n) as bigint) * n then 1 else 0 end as cents from seated),
eaten as materialized (select d.receipt_id, d.k, d.tax, d.tip, coalesce(cast(sum(c.cents) as bigint), 0) as items from due d left join cents c using (receipt_id, k) where not d.evenly group by all),
{shares('tax')}, {shares('tip')},
parts as (select e.receipt_id, e.k, e.items, cast(x.share as bigint) as tax, cast(p.share as bigint) as tip, cast(e.items + x.share + p.share as bigint) as total from eaten e join tax3 x using (receipt_id, k) join tip3 p using (receipt_id, k)
 union all select receipt_id, k, cast(floor(cast(total as double) / n_people) as bigint) + case when k < total - cast(floor(cast(total as double) / n_people) as bigint) * n_people then 1 else 0 end as items, 0, 0, cast(floor(cast(total as double) / n_people) as bigint) + case when k < total - cast(floor(cast(total as double) / n_people) as bigint) * n_people then 1 else 0 end from due where evenly)
select v.receipt_id as bill_id, status, no_tip_printed, settles and n_items = 0 and k is not null as evenly, case when k is null then 0 else added_tip end as added_tip, k as person_idx, 'p' || k as person_id, items, d.tax, d.tip, d.total from verdict v left join parts d using (receipt_id)""",
    "q50_pgm_decode": f"select vec_id as image_id, 8 as width, 8 as height, array_to_string(list_transform({LEVELS}, lambda v: printf('%02X', v)), '') as pixels from embeddings",
    "q51_crop": f"with l as (select vec_id, {LEVELS} as v from embeddings) select vec_id as image_id, 4 as width, 5 as height, array_to_string(list_transform(range(20), lambda i: printf('%02X', v[(1 + i // 4) * 8 + 2 + i % 4 + 1])), '') as pixels from l",
    "q52_empty_bills": f"select c_custkey as bill_id, {NULL} as subtotal, c_custkey * 7 as total, 2 as people, 'i1' as item, c_custkey % 500 as price, 2 as next_id from customer",
    "q53_degraded_sessions": f"with {POOR}, {settled('frames')}, {ACCEPT} select * from told",
    "q54_degraded_policies": f"with {POOR}, {settled('frames')}, {policies('0')}",
    "q57_area_average": f"{AVERAGED} select vec_id as image_id, longest, w as width, h as height, string_agg(printf('%02X', cast(round_even(x, 0) as int)), '' order by p) as pixels from sums group by all",
    "q58_turned_and_paled": f"with l as (select vec_id, {LEVELS} as v from embeddings) select vec_id as image_id, 6 as width, 8 as height, array_to_string(list_transform(range(48), lambda i: printf('%02X', cast(round_even(v[(5 - i % 6) * 8 + i // 6 + 1] * cast(0.5 as double) + 40, 0) as int))), '') as pixels from l",
    "q59_jump_draws": "with l as (select o_orderkey as receipt_id, list_reduce(list_prepend(cast(o_orderkey as bigint), range(k)), lambda s, i: (s * 1103515245 + 12345) & 2147483647) as s, k from orders, (values (1), (7), (40), (1000)) t(k)) select receipt_id, max(s) filter (k = 1) as draw_1, max(s) filter (k = 7) as draw_7, max(s) filter (k = 40) as draw_40, max(s) filter (k = 1000) as draw_1000 from l group by 1",
    "q60_live_frames": f"with {STREAK}, n as (select (coalesce(max(frame_no), 1) + 3) // 4 as admitted from ef), t as (select ef.*, (frame_no - 1) // admitted as tick from ef, n) select session_id, tick, max(frame_no) as frame_no, max_by(value_or, frame_no)[1] as value from (select *, [value] as value_or from t) group by 1, 2",
    "q61_rgba_gray": f"with l as (select vec_id, {LEVELS} as v from embeddings) select vec_id as image_id, 4 as width, 4 as height, array_to_string(list_transform(range(16), lambda i: printf('%02X', cast(round_even((299 * v[4 * i + 1] + 587 * v[4 * i + 2] + 114 * v[4 * i + 3]) / cast(1000 as double), 0) as int))), '') as pixels from l",
    "q62_files_prepared": f"{AVERAGED} select vec_id as image_id, w as width, h as height, string_agg(printf('%02X', cast(round_even(round_even(x, 0) * cast(0.5 as double) + 40, 0) as int)), '' order by p) as pixels from sums where longest = 3 group by all",
}
