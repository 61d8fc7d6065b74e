"""SQL for the queries whose statements are built from parts."""

from __future__ import annotations


def _repair() -> str:
    """The row-by-row form of the repair: four states a conversation, each its cheapest edits, least audit and text."""

    def way(origin: str, price: str, edit: str, turns: str) -> str:
        return f"case when {origin} is not null then {{'c': {origin}.c + {price}, 'a': {origin}.a || '{edit}', 't': {origin}.t || {turns}}} end"

    def line(name: str) -> str:
        return f"chr(10) || {name} || ':' || r.text"

    def into(state: str) -> str:
        gap = {"u": {"n": "", "s": "", "a": "", "u": "assistant"}, "a": {"u": "", "n": "user", "s": "user", "a": "user"}, "s": {"n": ""}}[state]
        ways = [f"case when {state} is not null then {{'c': {state}.c + 3, 'a': {state}.a || 'D', 't': {state}.t}} end"]
        for edit, name, price, when in (("K", "r.role", 0, f"r.initial = '{state}'"), ("R", "'user'" if state == "u" else "'assistant'", 2, "true")):
            if edit == "R" and state == "s":
                continue
            for origin, empty in gap.items():
                turns = (f"chr(10) || '{empty}:' || " if empty else "") + line(name)
                found = way(origin, f"{price + (2 if empty else 0)} + r.flaw", ("I" if empty else "") + edit, turns)
                ways.append(f"case when r.alive and {when} then {found} end")
        return f"list_min([{', '.join(ways)}])"

    crc = """list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: list_reduce(range(8), lambda d, i: case when d & 1 = 1 then xor(d >> 1, 3988292384::bigint) else d >> 1 end, xor(c, b)))"""
    start = "{'c': 0::bigint, 'a': '', 't': ''}"
    none = "case when n is not null then {'c': n.c + 3, 'a': n.a || 'D', 't': n.t} end"
    empty = f"case when false then {start} end"
    white = r"[\x20\x09-\x0D]"
    return rf"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key
  from conversations
), acts as (select *, xor({crc}, 4294967295::bigint) % 20 as act from keyed),
damaged as (
  select conv_id, turn, case when act = 4 then 'user' else role end as role,
         case when act = 1 then '' when act = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case when act = 3 then 2 else 1 end)) as copy
  from acts where act <> 0
), seen as (
  select *, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth,
         row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k,
         substr(role, 1, 1) as initial,
         lag(substr(role, 1, 1)) over (partition by conv_id order by turn nulls first, role, text, copy) as before
  from damaged
), judged as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when nth > 1 then 2
                 when not regexp_matches(text, '[.!?]{white}*\z') then 3 else 0 end as fault
  from seen
), steps as (
  select conv_id, k, role, text, initial, fault in (0, 3) as alive, case when fault = 3 then 1 else 0 end as flaw from judged
), walk(conv_id, k, n, s, u, a) as (
  select distinct conv_id, 0::bigint, {start}, {empty}, {empty}, {empty} from conversations
  union all
  select w.conv_id, r.k, {none}, {into("s")}, {into("u")}, {into("a")}
  from walk w join steps r on r.conv_id is not distinct from w.conv_id and r.k = w.k + 1
), ended as (
  select conv_id, list_min([n,
           case when s is not null then {{'c': s.c + 4, 'a': s.a || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'}} end,
           case when u is not null then {{'c': u.c + 2, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}} end, a]) as best
  from walk qualify row_number() over (partition by conv_id order by k desc) = 1
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
         count(*) filter (k > 1 and before || initial not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id
)
select e.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate,
       cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal,
       cast(best.c as bigint) as cost, best.a as audit, sha256(substr(best.t, 2)) as repaired_sha256
from ended e left join counts c on c.conv_id is not distinct from e.conv_id
"""


REPAIR = _repair()
