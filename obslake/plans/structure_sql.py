"""The structure of a table of unknown fields and the hypotheses on it, as SQL for DuckDB."""

from __future__ import annotations

from obslake.operators import profile
from obslake.plans.reference_sql import NUMERIC

AIR = ["row_id", "location_name", "lat", "lon", "timestamp_hour_start", "pm1_raw", "pm10_raw", "pm2point5_raw", "nitrogen_dioxide_raw", "largest_pollutant_name", "vendor"]
PFAS = ["row_id", "systemname", "wssn", "locname", "sysloccode", "sampledate", "pfoaresult", "pfosresult", "pfoaflags", "pfosflags"]


def _named(name: str, terms: tuple[str, ...]) -> str:
    """Fields named like the terms, the best match of each: same, at an end, within; in order of the terms."""
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    match = "case when field = t then 0 when starts_with(field, t || '_') or ends_with(field, '_' || t) then 1 when length(t) > 3 and contains(field, t) then 2 end"
    return f"{name} as (select field, row_number() over (order by m, lower(field)) as r from (select field, min({match} * 1000 + i) as m from own, (values {values}) v(i, t) where ({match}) is not null group by 1))"


def _structure(table: str, fields: list[str]) -> str:
    cells = " union all ".join(f"select {i} as pos, '{f}' as field, rid, {f}::varchar as v from (select *, row_number() over () as rid from {table})" for i, f in enumerate(fields))
    own = ", ".join(f"({i}, '{f}')" for i, f in enumerate(fields) if f not in profile.HELPER_NAMES)
    stations = ", ".join(f"'{t}'" for t in profile.STATION_NAMES)
    hierarchy = "[" + ", ".join(f"'{t}'" for t in profile.HIERARCHY_TERMS) + "]"
    once = lambda name, parts: f"{name} as (select field, row_number() over (order by min(g * 100000 + o)) as r from (" + " union all ".join(f"select field, {g} as g, {o} as o from {q}" for g, (o, q) in enumerate(parts)) + ") group by field)"
    return f"""
    with own as (select * from (values {own}) v(pos, field)), raw as ({cells}), cells as (select * from raw where v is not null and v <> ''),
    s as (select own.field, own.pos, count(v) as non_null, count(distinct v) as k, coalesce(avg(case when v is null then null when regexp_full_match(v, '{NUMERIC}') then 1.0 else 0 end), 0) as num,
        coalesce(avg(case when v is null then null when length(trim(v)) >= 8 and regexp_full_match(trim(v), '\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}.*') then 1.0 else 0 end), 0) as tmp from own left join cells on cells.field = own.field group by 1, 2),
    n as (select max(non_null) as n from s), temporal as (select field, pos from s where non_null > 0 and tmp >= 0.7),
    {_named('ids', profile.IDENTIFIER_TERMS)}, {_named('shows', profile.DISPLAY_TERMS)}, {_named('times', profile.TIME_TERMS)}, {_named('places', profile.LOCATION_TERMS)},
    pairs as (select a.field as t, b.field as p, a.v as tv, b.v as pv, count(*) as c from cells a join cells b on a.rid = b.rid, n where n >= 4 and a.field in (select field from temporal) and b.field not in (select field from temporal) and b.field in (select field from own) group by all),
    bt as (select t, p, avg(case when k >= 2 then 1.0 else 0 end) as shared, count(*) as times, sum(k) as d, sum(c) as pairs from (select t, p, tv, count(*) as k, sum(c) as c from pairs group by 1, 2, 3) group by 1, 2),
    bp as (select t, p, avg(case when k >= 2 then 1.0 else 0 end) as repeated, count(*) as places from (select t, p, pv, count(*) as k from pairs group by 1, 2, 3) group by 1, 2),
    grid as (select t, p, 0.45 * shared + 0.35 * repeated + 0.2 * d / pairs as score from bt join bp using (t, p) where pairs >= 4 and times >= 2 and places >= 2),
    best as (select p as field, max(score) as score, row_number() over (order by max(score) desc, p) as r from grid group by 1),
    {once('identity', [('pos', f"(select * from s where field in ({stations}) and k >= 2)"), ('r', "(select ids.* from ids join s using (field), n where n < 2 or k >= 2)"), ('r', "(select * from best where score >= 0.55)")])},
    {once('time', [('r', 'times'), ('pos', 'temporal')])}, {once('location', [('r', 'places'), ('r', "(select * from best where score >= 0.45)")])},
    a as (select (select field from identity where r = 1) as i, (select field from time where r = 1) as w, n from n),
    b as (select a.*, coalesce(s.k, 0) as size, coalesce(s.non_null, 0) as whole from a left join s on s.field = i),
    c as (select b.*, case when w is not null and n > 0 and (i is null or size = whole or size <= 1)
        then coalesce((select arg_min(x.field, x.r) from shows x join s on s.field = x.field where s.k < s.non_null and s.k > case when i is null or (size = whole and size > 1) then 0 else size end and x.field is distinct from i), i) else i end as prime from b),
    d as (select c.*, (select arg_min(field, r) from shows where field is distinct from prime) as shown from c),
    hier as (select own.field, row_number() over (order by pos) as r from own, d where len(list_filter({hierarchy}, lambda x: contains(own.field, x))) > 0 and own.field is distinct from prime and own.field is distinct from shown and own.field is distinct from w),
    measures as (select s.field, row_number() over (order by pos) as r from s, d where num >= 0.6 and non_null > 0 and s.field is distinct from prime and s.field is distinct from shown and s.field is distinct from w
        and s.field not in (select field from hier) and s.field not in (select field from places) and s.field not in (select field from ids) and s.field not in (select field from time)),
    e as (select d.*, round(least(1.0, 0.15 * (prime is not null)::int + 0.15 * (w is not null)::int + 0.1 * coalesce((select score >= 0.55 from best where field = prime), false)::int + 0.1 * coalesce((select bool_or(score >= 0.55) from grid where t = w), false)::int), 3) as confidence from d)"""


def _list(name: str) -> str:
    return f"coalesce((select string_agg(field, '|' order by r) from {name}), '')"


def oracle_sql() -> dict[str, str]:
    parts = [
        ("kind", "case when w is not null and prime is not null and (select count(*) from measures) > 0 then 'time_series' when w is not null then 'events' when prime is not null then 'records' else 'table' end"),
        ("confidence", "confidence::double::varchar"), ("identity", "coalesce(prime, 'None')"), ("display", "coalesce(shown, 'None')"), ("time", "coalesce(w, 'None')"), ("geometry", "'None'"),
        ("location", _list("location")), ("hierarchy", _list("hier")), ("metrics", _list("measures")), ("ignored", "''"), ("identity_candidates", _list("identity")), ("time_candidates", _list("time")),
    ]
    roles = [("identity", "identity"), ("time", "time"), ("location", "location"), ("hierarchy", "hier"), ("metric", "measures")]
    return {
        "dataset_structure": f"{_structure('ann_arbor_air_quality', AIR)} " + " union all ".join(f"select '{p}' as part, {x} as found from e" for p, x in parts),
        "role_hypotheses": f"{_structure('michigan_pfas', PFAS)} " + " union all ".join(f"select field, '{role}' as role, round(greatest(0.35, 0.92 - 0.08 * (r - 1)), 3)::double as confidence from {q}" for role, q in roles),
    }
