"""Problems 1 and 6 as SQL for DuckDB: time texts of many layouts as instants, and the slots of deployments."""

from __future__ import annotations

DATE = r"(?:(\d{4})([-/.])(\d{1,2})([-/.])(\d{1,2})|(\d{4})(\d{2})(\d{2})|(\d{1,2})/(\d{1,2})/(\d{4})|([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})|(\d{1,2})[ -]([A-Za-z]{3,9})\.?[ -](\d{4}))"
TIME = r"(?:[Tt]|,? )(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])\.?[Mm]\.?)? ?((?:[A-Za-z]{1,5})?(?:[+-]\d{2}(?::?\d{2})?)?(?:\[[A-Za-z0-9_/+\-]+\])?)"
WHOLE = r"(?:[A-Za-z]{3,9},? )?" + DATE + TIME
GROUPS = "'y1', 'sa', 'm1', 'sb', 'd1', 'y2', 'm2', 'd2', 'm3', 'd3', 'y3', 'm4', 'd4', 'y4', 'd5', 'm5', 'y5', 'h', 'mi', 's', 'f', 'ap', 'z'"
ABBREVIATIONS = "case word when 'z' then 0 when 'utc' then 0 when 'gmt' then 0 when 'ut' then 0 when 'est' then -300 when 'edt' then -240 when 'cst' then -360 when 'cdt' then -300 when 'mst' then -420 when 'mdt' then -360 when 'pst' then -480 when 'pdt' then -420 end"


def _first(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(g.{n}, '')" for n in names) + ")"


def instants(rows: str) -> str:
    """Rows with utc_us. ``rows`` is a query with t, the text, and zone, that of texts without one."""
    month = f"case when regexp_full_match({_first('m1', 'm2', 'm3', 'm4', 'm5')}, '\\d+') then {_first('m1', 'm2', 'm3', 'm4', 'm5')}::int else nullif((instr('jan feb mar apr may jun jul aug sep oct nov dec', lower(substr({_first('m1', 'm2', 'm3', 'm4', 'm5')}, 1, 3))) + 3) // 4, 0) end"
    hour = "case lower(g.ap) when '' then g.h::int else case when g.h::int between 1 and 12 then g.h::int % 12 + case when lower(g.ap) = 'p' then 12 else 0 end end end"
    return f"""
    select * exclude (local_us, off, region, solo, back, other), case when off is not null then local_us - off::bigint * 60000000 when solo is not null and back = local_us and not other then solo end as utc_us from (
      select *, epoch_us(timezone(z, make_timestamp(local_us))) as solo,
        epoch_us(timezone(z, timezone(z, make_timestamp(local_us)))) as back,
        list_bool_or(list_transform([-180, -120, -60, -30, 30, 60, 120, 180], lambda k: epoch_us(timezone(z, timezone(z, make_timestamp(local_us)) + to_minutes(k))) = local_us)) as other from (
      select * exclude (g, n, word, signed, mins, epoch, digits, y, mo, dd, hh, ss, bad),
        case when epoch then floor(n::decimal(38, 9) * case when digits <= 11 then 1000000 when digits <= 14 then 1000 when digits <= 17 then 1 else 0.001 end)::bigint
          when not bad and g.sa = g.sb and hh < 24 and ss::int < 60 then epoch_us(try_cast(y || '-' || lpad(mo::varchar, 2, '0') || '-' || lpad(dd, 2, '0') || ' ' || lpad(hh::varchar, 2, '0') || ':' || g.mi || ':' || lpad(ss, 2, '0') || '.' || substr(g.f || '000000', 1, 6) as timestamp)) end as local_us,
        case when epoch then 0 when not bad then off0 end as off, case when not bad and off0 is null and word = '' then region0 end as region,
        coalesce(case when not epoch and not bad and off0 is null and word = '' then region0 end, zone) as z
      from (select *, (word <> '' and (named is null or (signed <> '' and named <> 0))) as bad, coalesce(case when signed <> '' then signed::int * 60 + case when mins = '' then 0 else mins::int * case when starts_with(signed, '-') then -1 else 1 end end end, named) as off0
      from (select *, {ABBREVIATIONS} as named from (
        select *, n is not null and regexp_full_match(n, '[+-]?\\d{{1,19}}(\\.\\d{{1,9}})?') as epoch, length(regexp_extract(n, '^[+-]?(\\d+)', 1)) as digits, {_first('y1', 'y2', 'y3', 'y4', 'y5')} as y, {month} as mo, {_first('d1', 'd2', 'd3', 'd4', 'd5')} as dd,
          {hour} as hh, case when g.s = '' then '0' else g.s end as ss, lower(regexp_extract(g.z, '^([A-Za-z]*)', 1)) as word, regexp_extract(g.z, '([+-]\\d{{2}}):?\\d{{0,2}}(?:\\[|$)', 1) as signed, regexp_extract(g.z, '[+-]\\d{{2}}:?(\\d{{2}})(?:\\[|$)', 1) as mins,
          nullif(regexp_extract(g.z, '\\[(.+)\\]$', 1), '') as region0
        from (select *, case when regexp_full_match(n, '{WHOLE}') then regexp_extract(n, '^{WHOLE}$', [{GROUPS}]) end as g from (select *, trim(regexp_replace(t, '[\\s\\x{{00a0}}]+', ' ', 'g')) as n from ({rows}))))))))"""


def _source_rows(table: str, text: str, source: str, more: str = "") -> str:
    return f"select '{table}' as table_name, row_id, {source} as source_name, {text} as t, zone_name as zone{more} from {table} left join (select source_name, min(zone_name) as zone_name from source_registry where source_table = '{table}' group by 1) r on r.source_name = {source}"


def _grid(table: str, text: str, source: str, value: str, bare: bool) -> str:
    """The slots of a table's deployments with what is in them and around them."""
    return f"""
    select '{table}' as table_name, source_name, slot * step as slot_ms, readings, value, last * step as last_ms, next * step as next_ms, coalesce(value, carried) as filled,
      case when readings > 0 then 'observed' when coalesce(value, carried) is not null then 'filled' else 'empty' end as status from (
      select *, max(case when readings > 0 then slot end) over up as last, min(case when readings > 0 then slot end) over down as next, last_value(value ignore nulls) over up as carried from (
        select g.*, coalesce(r.readings, 0) as readings, r.value from (
          select distinct source_name, step, unnest(range(a, b)) as slot from (
            select d.source_name, step, ceil(epoch_us(active_from) / 1000.0 / step)::bigint as a, ceil(epoch_us(active_to) / 1000.0 / step)::bigint as b
            from source_deployment d join (select source_name, min(cadence_minutes)::bigint * 60000 as step from source_registry where source_table = '{table}' and cadence_minutes >= 1 group by 1) c using (source_name) where source_table = '{table}') where a < b) g
        left join (select source_name, utc_us // (step * 1000) as slot, count(*) as readings, avg(v) as value
          from ({instants(_source_rows(table, text, source, f", {value}::double as v"))}) join (select source_name, min(cadence_minutes)::bigint * 60000 as step from source_registry where source_table = '{table}' and cadence_minutes >= 1 group by 1) using (source_name)
          where utc_us is not null {"" if bare else "and v is not null"} group by 1, 2) r on r.source_name = g.source_name and r.slot = g.slot)
      window up as (partition by source_name order by slot), down as (partition by source_name order by slot rows between current row and unbounded following))"""


def oracle_sql() -> dict[str, str]:
    usual = {"chicago_beach_weather": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}", "michigan_pfas": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z"}
    tables = [
        _source_rows("chicago_beach_weather", "measurement_timestamp", "station_name"),
        _source_rows("ann_arbor_air_quality", "timestamp_hour_start", "location_name"),
        _source_rows("ann_arbor_rainfall", "period", "site"),
        "select 'michigan_pfas' as table_name, row_id, null as source_name, sampledate as t, 'America/Detroit' as zone from michigan_pfas",
    ]
    layout = "case table_name " + " ".join(f"when '{k}' then '{v}'" for k, v in usual.items()) + r" else '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}' end"
    series = " union all ".join([_grid("chicago_beach_weather", "measurement_timestamp", "station_name", "air_temperature", True), _grid("ann_arbor_rainfall", "period", "site", "rainfall", False)])
    weather = f"({instants(_source_rows('chicago_beach_weather', 'measurement_timestamp', 'station_name', ', air_temperature, humidity'))})"
    air = f"({instants(_source_rows('ann_arbor_air_quality', 'timestamp_hour_start', 'location_name', ', pm2point5_raw'))})"
    beyond = [("air_temperature", weather, -60, 60), ("humidity", weather, 0, 100), ("pm2point5_raw", air, 0, 1000)]
    return {
        "p3_impossible": " union all ".join(f"select table_name, row_id, '{f}' as field_name from {q} where utc_us is not null and source_name is not null and not {f} between {lo} and {hi}" for f, q, lo, hi in beyond),
        "p1_found": f"select table_name, row_id, coalesce(strftime(make_timestamp(utc_us // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%gZ'), '') as utc_text from ({instants(' union all '.join(tables))}) where t <> '' and (not regexp_full_match(t, {layout}) or utc_us is null)",
        "p6_found": f"select table_name, source_name, slot_ms from ({series}) where status <> 'observed'",
        "p6_series": series,
    }
