"""The generator's events in SQL (DuckDB)."""

from __future__ import annotations

from rillmark.sources import generator as g


def double(x: float) -> str:
    return f"'{x!r}'::double"


def digits(n: int, text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, {n}))::bigint"


def uniform(seed: int, name: str, key: str) -> str:
    return f"({digits(13, f"'{seed}:{name}:' || {key}::varchar")}::double / 4503599627370496e0)"


def ranked(u: str, n: int, alpha: float) -> str:
    edges, share, low, high = g.law(n, alpha)
    head = f"len(list_filter([{', '.join(map(double, edges))}], lambda e: {u} >= e))"
    if n == len(edges):
        return f"cast(case when {u} < {double(share)} then {head} else {n - 1} end as integer)"
    rest = f"({u} - {double(share)}) / {double(max(1 - share, 1e-12))}"
    tail = f"least(floor(pow({double(low)} + {rest} * {double(high - low)}, {double(1 / (1 - alpha))}) - 0.5::double), {n - 1})"
    return f"cast(case when {u} < {double(share)} then {head} else {tail} end as integer)"


def by_share(u: str, shares: dict[str, float]) -> str:
    names = list(shares)
    whens = "".join(f" when {u} < {double(x)} then '{name}'" for name, x in list(zip(names, g.cumulative(list(shares.values())), strict=True))[:-1])
    return f"case{whens} else '{names[-1]}' end"


def pick(seed: int, name: str, values: tuple[str, ...], key: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[cast(floor({uniform(seed, name, key)} * {len(values)}) as integer) + 1]"


def events(n: int, seed: int, rate: int, users: int, items: int) -> str:
    def u(name: str, key: str) -> str:
        return uniform(seed, name, key)

    return f"""with x as (select range id, {ranked(u("user", "range"), users, 1.5)} u, {ranked(u("item", "range"), items, 1.2)} v, {by_share(u("type", "range"), g.EVENT_SHARES)} event_type from range({n})),
  y as (select *, {u("bot", "u")} < {double(g.BOT_SHARE)} bot from x),
  z as (select *, case when bot then cast(floor({u("anywhere", "id")} * {g.ADDRESSES}) as bigint) else ({digits(8, "'home:' || u::varchar")} + cast(floor({u("address", "id")} * 3) as bigint)) % {g.ADDRESSES} end number from y),
  w as (select *, {digits(8, "'address:' || number::varchar")} a from z)
  select id, make_timestamp(1735689600000000 + cast(floor(id * {double(1_000_000 / rate)}) as bigint)) "timestamp", printf('user_%05d', u) user_id, event_type,
    case when event_type <> 'search' then printf('video_%04d', v) end video_id, concat_ws('.', a % 254 + 1, (a // 254) % 256, (a // {254 << 8}) % 256, (a // {254 << 16}) % 254 + 1) ip,
    {u("premium", "u")} < {double(g.PREMIUM_SHARE)} is_premium,
    printf('sess_%07d', cast(floor(case when bot then {u("session", "id")} else {u("session", "u")} end * 10000000) as bigint)) session_id,
    case when event_type = 'search' then 'query=' || {pick(seed, "query", g.SEARCHES, "id")} when event_type = 'quality_change' then 'quality=' || {pick(seed, "quality", g.QUALITIES, "id")}
      when event_type in ('purchase', 'subscription') then 'amount=' || printf('%.2f', {double(4.99)} + 15e0 * {u("amount", "id")}) || ';plan=' || {pick(seed, "plan", g.PLANS, "id")} else '' end payload
  from w"""
