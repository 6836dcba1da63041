"""The queries of records.py, and some of the problems, as SQL for DuckDB."""

from __future__ import annotations

from obslake.operators.catalog import DERIVED_MARKERS, ENVIRONMENT_TERMS, FIELD_TERMS, OFFICIAL_MARKERS
from obslake.operators.roles import CONTEXT_WORDS, MEASURE_WORDS, TIME_NAMES
from obslake.plans.records import TERMS
from obslake.plans.reference import PROFILES
from obslake.plans.reference_sql import LINE_POINTS, LINE_SEQ, MAPPING, SCORE, SEARCHABLE, any_of, changes, raw_records, sum_terms

ARRIVALS = "(select 'chicago_beach_weather' as source_table, station_name as source_name, ingested_at from chicago_beach_weather union all select 'ann_arbor_air_quality', location_name, ingested_at from ann_arbor_air_quality union all select 'ann_arbor_rainfall', site, ingested_at from ann_arbor_rainfall)"


def _listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _token(*parts: str) -> str:
    """v1: and unpadded URL-safe base64 of a JSON array of texts."""
    array = "'[' || " + " || ',' || ".join(f"to_json({p}::varchar)::varchar" for p in parts) + " || ']'"
    whole = "'v1:' || rtrim(translate(base64(encode(" + array + ")), '+/', '-_'), '=')"
    return "case when " + " and ".join(f"{p} is not null and {p}::varchar <> ''" for p in parts) + f" then {whole} end"


IDENT = "trim(regexp_replace(lower(translate(replace({}, 'ß', 'ss'), '²³µ', '23μ')), '[^\\pL\\pM\\pN]+', '_', 'g'), '_')"
ISO = "^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}([.,]\\d+)?)?)?\\s*([Zz]|[+-]\\d{2}:?\\d{2})?$"
NUMBER = "\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*"


def _columns() -> str:
    """The consistent column of every field: lifespans along renames, from the fields and renames of the changes."""
    fields = changes().split("select * from renamed")[0].replace("with own", "with recursive own", 1).rstrip()
    return f"""{fields},
    i as (select dataset_id, name, snapshot_no, cls, snapshot_no - row_number() over (partition by dataset_id, name order by snapshot_no) as island from f),
    spans as (select *, min(snapshot_no) over (partition by dataset_id, name, island) as since, max(snapshot_no) over (partition by dataset_id, name, island) as until from i),
    nodes as (select distinct dataset_id, name, since, until from spans),
    links as (select r.dataset_id, r.new_name as name, r.snapshot_no as since, o.name as old_name, o.since as old_since from renamed r join nodes o on o.dataset_id = r.dataset_id and o.name = r.old_name and o.until = r.snapshot_no - 1),
    roots as (select dataset_id, name, since, name as root, since as begun from nodes n where not exists (select 1 from links l where l.dataset_id = n.dataset_id and l.name = n.name and l.since = n.since)
      union all select l.dataset_id, l.name, l.since, r.root, r.begun from links l join roots r on r.dataset_id = l.dataset_id and r.name = l.old_name and r.since = l.old_since),
    tagged as (select s.*, root, begun from spans s join roots r using (dataset_id, name, since)),
    c as (select dataset_id, root, begun, arg_max(name, (snapshot_no, name)) as column_name, list_sort(list(distinct cls)) as classes from tagged group by 1, 2, 3),
    d as (select *, row_number() over (partition by dataset_id, column_name order by begun desc, root desc) as k from c)
    select dataset_id, snapshot_no, name, case when k > 1 then column_name || '@' || begun else column_name end as column_name,
      case when len(classes) = 1 then classes[1] when len(list_filter(classes, lambda x: x not in ('integer', 'number'))) = 0 then 'number' else 'text' end as column_class from tagged join d using (dataset_id, root, begun)"""


def oracle_sql() -> dict[str, str]:
    haversine = "2 * 6371.0088 * asin(sqrt(pow(sin((radians(lat) - radians(42.28)) / 2), 2) + cos(radians(42.28)) * cos(radians(lat)) * pow(sin(radians(lon - (-83.74)) / 2), 2)))"
    holds = lambda c, words: f"len(list_filter({_listed(words)}, lambda w: contains({c}, w))) > 0"
    role_of = lambda n: f"case when list_contains({_listed(TIME_NAMES)}, {n}) then 'time' when {holds(n, CONTEXT_WORDS)} then 'descriptive' when {holds(n, MEASURE_WORDS)} then 'data' else 'unassigned' end"
    ascii_ident = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_')"
    dirty = "case when lower(trim(v)) not in ('', 'na', 'n/a', 'nan', 'none', 'null', 'nd', '-', '--') then try_cast(case when regexp_full_match(regexp_replace(replace(trim(v), ',', ''), '^<\\s*', ''), '" + NUMBER + "') then trim(regexp_replace(replace(trim(v), ',', ''), '^<\\s*', '')) end as double) end"
    pfas = ["systemname", "wssn", "locname", "sysloccode", "sampledate", "pfoaresult", "pfosresult", "pfoaflags", "pfosflags"]
    cells = " union all ".join(f"select '{c}' as field, {c}::varchar as v from michigan_pfas" for c in pfas)
    iso_us = f"""case when regexp_full_match(trim(t), '{ISO[1:-1]}') then case when regexp_matches(trim(t), '([Zz]|[+-]\\d{{2}}:?\\d{{2}})$') and regexp_matches(trim(t), '\\d{{2}}:\\d{{2}}')
            then epoch_us(try_cast(regexp_replace(regexp_replace(regexp_replace(replace(trim(t), ',', '.'), '[Zz]$', '+00:00'), '([+-]\\d{{2}}):?(\\d{{2}})$', '\\1:\\2'), '\\s+([+-]\\d{{2}}:\\d{{2}})$', '\\1') as timestamptz))
            else epoch_us(try_cast(replace(trim(t), ',', '.') as timestamp)) end end"""
    number = f"case when regexp_full_match(t, '{NUMBER}') then try_cast(trim(t) as double) end"
    described = """select dataset_id, snapshot_no, array_to_string(list_sort(list(distinct lower(name))), ' ') as fields, coalesce(array_to_string(list_sort(list(distinct lower(description)) filter (description is not null)), ' '), '') as description, max(captured_at) as captured_at
        from open_data_field where name is not null group by 1, 2 qualify row_number() over (partition by dataset_id order by snapshot_no desc) = 1"""
    profiles = ", ".join(f"('{a}', {o}, '{k}', '{m}')" for a, o, k, m in PROFILES)
    terms = ", ".join(f"('{a}', '{t}')" for a, t in TERMS)
    profiled = f"""
        with pr(profile_id, o, kind, metric_id) as (values {profiles}), te(profile_id, term) as (values {terms}),
        z as (select profile_id, o, count(*) filter (kind = 'core') as cores, count(*) filter (kind = 'support') as supports from pr group by 1, 2),
        h as (select dataset_id, profile_id, count(*) filter (kind = 'core') as c, count(*) filter (kind = 'support') as s from (select distinct dataset_id, metric_id from ({MAPPING})) join pr using (metric_id) group by 1, 2),
        m as (select dataset_id, profile_id, least(count(*), 2) as m, bool_or(fields <> '') as has from ({described}) join te on contains(description, term) group by 1, 2),
        x as (select coalesce(h.dataset_id, m.dataset_id) as dataset_id, coalesce(h.profile_id, m.profile_id) as profile_id, coalesce(c, 0) as c, coalesce(s, 0) as s, coalesce(m, 0) as m, (c is not null or has) as has from h full join m on h.dataset_id = m.dataset_id and h.profile_id = m.profile_id),
        y as (select dataset_id, profile_id, o, case when not has then 0.35 * m / 2 else least(1.0, 0.65 * c / greatest(cores, 1) + 0.2 * s / greatest(supports, 1) + 0.15 * m / 2) * case when c > 0 then 1.0 else 0.45 end end as confidence from x join z using (profile_id))
        select dataset_id, profile_id, confidence from y where confidence >= 0.15 qualify row_number() over (partition by dataset_id order by confidence desc, o) = 1"""
    return {
        "record_points": f"""select unit_id, m as metric, unit, value as value_text, record_id, record_label from (
            select unit_id, coalesce({_squeeze('metric')}, '') as m, unit, value, {_token('unit_id', 'stream_id')} as record_id, coalesce({_squeeze('record_label')}, '') as record_label, observed_at, obs_id from semantic_observation where unit_id <> '' and value is not null)
            qualify row_number() over (partition by unit_id, m, unit order by observed_at desc nulls last, obs_id desc) = 1""",
        "stream_snapshot": """with l as (select user_id, event_type, ts, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1),
            h as (select user_id, event_type, ts from (select distinct user_id, event_type, ts from events where value is not null) qualify row_number() over (partition by user_id, event_type order by ts desc) <= 250)
            select l.*, min(h.ts) as history_start, max(h.ts) as history_end, count(h.ts) as history_points from l left join h using (user_id, event_type) group by all""",
        "wide_states": f"select l_suppkey, metric, value from ({LINE_POINTS}) qualify row_number() over (partition by l_suppkey, metric order by l_shipdate desc, {LINE_SEQ}) = 1",
        "source_status": f"select r.source_table, r.source_name, case when count(a.source_table) > 0 then 'data_available' else 'no_data' end as status, count(a.source_table) as rows, epoch_us(max(a.ingested_at)) as latest_us from (select distinct source_table, source_name from source_registry) r left join {ARRIVALS} a using (source_table, source_name) group by 1, 2",
        "snapshot_tick": f"select source_table as source, count(*) as rows, count(distinct source_name) as names from {ARRIVALS} group by 1",
        "csv_scan": "select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, length(coalesce(text, '')) as length, md5(coalesce(text, '')) as digest from documents",
        "json_scan": "select event_id, (props->>'k')::bigint as k from events",
        "gtfs_check": """with r as (select portal_id, provider, length(portal_id) as n, ['agency.txt', 'stops.txt', 'routes.txt', 'trips.txt', 'stop_times.txt'] as t from portal)
            select portal_id, case when n % 6 = 5 then '' else t[n % 6 + 1] end as missing, n % 2 = 0 as has_calendar, coalesce(provider = 'ckan', false) as nested, n % 6 = 5 and n % 2 = 0 as is_valid from r""",
        "distinct_records": "select distinct location_name, lat, lon from ann_arbor_air_quality order by location_name nulls first, lat nulls first, lon nulls first limit 1000",
        "language_packs": "select metric_label as alias, quantity as metric_id, case when regexp_matches(metric_label, '[^ -~]') then 'international' else 'base' end as language from metric_alias",
        "international_mapping": f"""select dataset_id, name, quantity as metric_id, conf as confidence, how as matched_by from (
            select f.dataset_id, f.name, a.quantity, w.conf, w.how, row_number() over (partition by f.dataset_id, f.name order by w.conf desc, a.quantity) as rn
            from (select distinct dataset_id, name, label, description from open_data_field) f, lateral (values (f.name, 1.0::double, 'name'), (f.label, 0.96::double, 'label'), (f.description, 0.88::double, 'description')) w(t, conf, how)
            join metric_alias a on {IDENT.format('a.metric_label')} = {IDENT.format('w.t')} where {IDENT.format('a.metric_label')} <> '') where rn = 1""",
        "unicode_names": f"select distinct label, {IDENT.format('label')} as folded from open_data_field",
        "retained_roles": f"""with f as (select distinct dataset_id, snapshot_no, name, lower(trim(data_type)) as t, dense_rank() over (partition by dataset_id order by snapshot_no desc) as k from open_data_field where name is not null),
            r as (select dataset_id, name, min(case when regexp_matches(t, 'date|time') then 'time' when regexp_matches(t, 'number|double|int|float|numeric|decimal') then 'data' else 'descriptive' end) as role from f where k = 2 group by 1, 2),
            c as (select distinct dataset_id, name, {ascii_ident('name')} as n from f where k = 1)
            select dataset_id, name, coalesce(role, {role_of('n')}) as role, role is not null as reviewed from c left join r using (dataset_id, name)""",
        "role_classification": f"""with m as (select field, avg(case when ({dirty}) is not null then 1.0 else 0 end) as share from ({cells}) where v <> '' group by 1)
            select field, case when field = 'systemname' then 'location' when field = 'sampledate' or list_contains({_listed(TIME_NAMES)}, field) then 'time'
                when not ({holds('field', CONTEXT_WORDS)}) and share >= case when {holds('field', MEASURE_WORDS)} then 0.2 else 0.8 end then 'data' when {holds('field', CONTEXT_WORDS)} then 'descriptive' else 'unassigned' end as role from m""",
        "candidate_labels": f"""with s as (select doc_id, concat_ws(' ', source, doc_id::varchar) as title, t, {SCORE} as score from (select doc_id, source, {SEARCHABLE} as t from documents)),
            r as (select *, list_filter({_listed(tuple(ENVIRONMENT_TERMS))}, lambda x: contains(t, x))[1:3] as why from s where score >= 20)
            select doc_id, substr(lpad(score::varchar, greatest(3, length(score::varchar))::int, '0') || ' · ' || substr(title, 1, 100) || case when len(why) > 0 then ' — ' || array_to_string(why, ', ') else '' end, 1, 150) as label from r""",
        "described_profiles": f"select dataset_id, profile_id, round(confidence, 6)::double as confidence from ({profiled})",
        "scored_datasets": f"""with p as (select dataset_id, round(confidence, 6) as confidence from ({profiled})), r as (select distinct dataset_id, true as resource from open_data_row),
            x as (select *, regexp_replace(lower(concat_ws(' ', dataset_id, description)), '[^a-z0-9.]+', ' ', 'g') as t from ({described}) left join p using (dataset_id) left join r using (dataset_id))
            select dataset_id, {SCORE} + case when resource then 15 else 0 end + case when fields <> '' then 10 + {sum_terms('lower(fields)', FIELD_TERMS)} else 0 end
                + case when {any_of('lower(description)', OFFICIAL_MARKERS)} then 10 else 0 end + case when {any_of('lower(description)', DERIVED_MARKERS)} then -30 else 0 end
                + case when length(fields) % 2 = 0 then 12 else -18 end + case when snapshot_no % 3 = 0 then -14 else 0 end + case when captured_at is not null then 4 else 0 end + case when fields <> '' then 6 else 0 end
                + coalesce(round_even(confidence * case when fields <> '' then 55 else 30 end, 0)::int, 0) as score from x""",
        "geometry_types": """select row_id, case when row_id % 5 <> 0 then case when row_id % 4 = 0 then 'polygon' else 'point' end end as kind,
            case when row_id % 5 <> 0 and row_id % 4 <> 0 and lat between -90 and 90 and lon between -180 and 180 then lat end as lat, case when row_id % 5 <> 0 and row_id % 4 <> 0 and lat between -90 and 90 and lon between -180 and 180 then lon end as lon from ann_arbor_air_quality""",
        "metadata_texts": """select r.dataset_id, r.snapshot_no, r.row_no, concat_ws('|', 'first', r.file_name, string_agg(j.value->>'$', '|' order by j.id)) as texts from open_data_row r left join json_each(r.payload) j on j.type = 'VARCHAR' group by r.dataset_id, r.snapshot_no, r.row_no, r.file_name""",
        "normal_lists": "select row_id, concat_ws('|', a, case when b is distinct from a then b end) as codes from (select row_id, nullif(trim(pfoaflags), '') as a, nullif(trim(pfosflags), '') as b from michigan_pfas)",
        "entity_keys": "select row_id, nullif(concat_ws('|', nullif(trim(wssn), ''), nullif(trim(sysloccode), ''), nullif(trim(pfoaflags), '')), '') as entity from michigan_pfas",
        "query_values": "select portal_id, title as q, null::varchar as sort, null::varchar as none from portal",
        "parsed_times": f"""with x as (select row_id, measurement_timestamp as t from chicago_beach_weather), y as (select row_id, {iso_us} as iso, {number} as n from x)
            select row_id, coalesce(iso, case when n > 1e10 then trunc(n * 1e3)::bigint else trunc(n * 1e6)::bigint end) as any_us, case when n is null then iso end as iso_us from y""",
        "coordinate_modes": """with f as (select distinct dataset_id, label, lower(label) as l from open_data_field)
            select dataset_id, case when coalesce(bool_or(l in ('latitude', 'lat', 'y_wgs84')), false) and coalesce(bool_or(l in ('longitude', 'lon', 'lng', 'x_wgs84')), false) then 'wgs84_fields'
                when coalesce(bool_or(l in ('geometry', 'geom', 'geolocation', 'location')), false) then 'geometry' else 'none' end as coordinate_mode,
                coalesce(string_agg(label, '|' order by label) filter (l in ('latitude', 'lat', 'y_lat', 'y_latitude', 'longitude', 'lon', 'lng', 'long', 'x_lon', 'x_longitude', 'geometry', 'geom', 'the_geom', 'location')), '') as coordinate_fields from f group by 1""",
        "resource_lookup": "select file_name as resource_id, min(dataset_id) as package_id, count(*) as rows from open_data_row group by 1",
        "catalog_preparation": f"""with e as (select portal_id, source, text, min(doc_id) as doc_id from documents where portal_id is not null group by 1, 2, 3),
            s as (select portal_id, doc_id, {SCORE} as score from (select portal_id, doc_id, {SEARCHABLE} as t from e)),
            o as (select portal_id, count(*) as entries, count(*) filter (score >= 20) as candidates from s group by 1),
            b as (select portal_id, doc_id as best from s where score >= 20 qualify row_number() over (partition by portal_id order by score desc, doc_id) = 1)
            select portal_id, coalesce(entries, 0) as entries, coalesce(candidates, 0) as candidates, best, case when candidates > 0 then 'ready' else 'failed' end as status from portal left join o using (portal_id) left join b using (portal_id)""",
        "selection_pipeline": f"""with p as (select location_name, min(lat) as lat, min(lon) as lon from ann_arbor_air_quality where location_name is not null group by 1),
            s as (select distinct source_name from source_registry where source_table = 'ann_arbor_air_quality' and cadence_minutes is not null)
            select location_name, round({haversine}, 6) as distance_km, {_token('location_name')} as token, source_name is not null as selected from p left join s on source_name = location_name""",
        "reanalysis_states": """with f as (select *, ascii(right(dataset_id, 1)) as code, row_number() over (partition by dataset_id order by snapshot_no desc) as rn from analysis_fingerprint),
            j as (select n.dataset_id, n.code, case when n.code % 7 = 0 then null else o.digest end as old, n.digest, 4 * 3600 * (n.code % 9) as ago, n.code % 2 = 1 as failed,
                n.schema_json is distinct from o.schema_json as sc, n.metrics is distinct from o.metrics as me, n.coordinate_mode is distinct from o.coordinate_mode as co, n.ordering is distinct from o.ordering as od
                from f n left join f o on o.dataset_id = n.dataset_id and o.rn = 2 where n.rn = 1),
            d as (select dataset_id, case when code % 11 = 0 then 'manual_request' when old is null then 'initial_analysis' when old = digest then 'unchanged' when ago < case when failed then 6 else 24 end * 3600 then 'cooldown'
                when sc then 'schema_changed' when me then 'metric_coverage_changed' when co then 'coordinate_interpretation_changed' when od then 'physical_ordering_changed' end as reason from j)
            select dataset_id, reason not in ('unchanged', 'cooldown') as should_run, reason from d""",
        "corpus_fields": """with p as (select field_name, count(*) as n from (select distinct dataset_id, snapshot_no, name, trim(regexp_replace(lower(name), '[^\\pL\\pM\\pN_]+', '_', 'g'), '_') as field_name from open_data_field where name is not null) group by 1)
            select field_name, n, (select count(*) from p) as unique_field_names from p order by n desc, field_name limit 50""",
        "p5_columns": _columns(),
        "p2_loaded": raw_records(loaded=True),
    }
