"""The same queries as SQL for DuckDB, over the same tables as views."""

from __future__ import annotations

from obslake.operators.catalog import DERIVED_MARKERS, ENVIRONMENT_TERMS, LOW_VALUE_TERMS, OFFICIAL_MARKERS

PEOPLE = "customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
STREAM = "substr(sha1(concat_ws('|', user_id::varchar, lower(event_type), 'value')), 1, 20)"
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_POINTS = " union all ".join(f"select *, '{m}' as metric, {m} as value from lineitem" for m in MEASURES)
LINE_SEQ = "l_orderkey desc, l_partkey desc, l_linenumber desc, l_quantity desc, l_extendedprice desc, l_discount desc, l_tax desc"
GAP = "select median(g) as c from (select epoch_us(t) / 1e6 - epoch_us(lag(t) over (order by t)) / 1e6 as g from (select distinct ts as t from events order by t desc limit 51))"


def sum_terms(text: str, terms: dict[str, int]) -> str:
    return " + ".join(f"case when contains({text}, '{t}') then {w} else 0 end" for t, w in terms.items())


def any_of(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


SEARCHABLE = "regexp_replace(lower(concat_ws(' ', source, text)), '[^a-z0-9.]+', ' ', 'g')"
SCORE = sum_terms("t", ENVIRONMENT_TERMS | LOW_VALUE_TERMS)


def _buckets(width: str) -> str:
    return f"select event_type, time_bucket(interval '{width}', ts) as bucket, count(*) as n, round(avg(value), 6) as mean_value, min(value) as min_value, max(value) as max_value from events group by 1, 2"


def _stratified(columns: str) -> str:
    return f"""
    with r as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as a, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as b from events)
    select {columns} from r order by least(a, b), user_id::varchar, case when b <= a then 0 else 1 end limit 200"""


def _pairs(fields: dict[str, str]) -> str:
    return " union all ".join(f"select '{a}' as det, '{b}' as dep, ({x})::varchar as v, ({y})::varchar as w from {PEOPLE}" for a, x in fields.items() for b, y in fields.items() if a != b)


NUMERIC = r"\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|nan|NaN|inf|Infinity)\s*"
BEHAVED = ["event_id", "ts", "user_id", "event_type", "value"]


def _behaviour(rounded: bool = True) -> str:
    """Measures and roles of the fields of events, unrounded for further use."""
    cells = " union all ".join(f"select '{f}' as field, {i} as position, user_id as e, {f}::varchar as v from events" for i, f in enumerate(BEHAVED))
    r = lambda c: f"round({c}, 6)" if rounded else c
    return f"""
    with cells as (select * from ({cells}) where v is not null and v <> ''),
    m as (select field, position, count(*) as non_null, count(distinct v) as distinct_values, avg(case when regexp_full_match(v, '{NUMERIC}') then 1.0 else 0 end) as num,
        avg(case when length(trim(v)) >= 8 and regexp_full_match(trim(v), '\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}.*') then 1.0 else 0 end) as tmp, count(distinct v) / count(*) as uni from cells group by 1, 2),
    w as (select field, avg(case when k = 1 then 1.0 else 0 end) as stab, max(k) > 1 as chg from (select field, e, count(distinct v) as k from cells where field <> 'user_id' group by 1, 2) group by 1),
    j as (select m.*, stab, coalesce(chg, false) as chg, coalesce(stab >= 0.95, false) as steady from m left join w using (field))
    select field, position, non_null, distinct_values, {r('num')}::double as numeric_ratio, {r('tmp')}::double as temporal_ratio, {r('uni')}::double as uniqueness, {r('stab')}::double as stability, chg as changes,
        case when tmp >= 0.7 then 'timestamp' when field in ('row_id', 'objectid', 'record_id', 'created_at', 'updated_at') or uni >= 0.98 then 'administrative'
            when num >= 0.8 and not steady then 'metric' when steady then 'stable_context' when chg then 'changing_nominal' else 'context' end as role from j"""


PREVIEW = "select count(*) as names, count(*) filter (c >= 2) as repeated, count(*) filter (c >= 2) > 0 and count(*) <= 50 and count(*) filter (c >= 2) / count(*) >= 0.5 as accepted from (select trim(event_type) as m, count(*) as c from events where event_type <> '' and value is not null group by 1)"
#: Events with whether they are in the second half of the time.
HALVES = "(select *, coalesce(ts >= (select make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) from events), false) as late from events)"


def changes() -> str:
    return """
    with own as (
      select dataset_id, snapshot_no, name, min(label) as label, min(description) as description, min(data_type) as data_type from open_data_field where name is not null group by 1, 2, 3),
    spare as (
      select f.dataset_id, f.snapshot_no, j.value->>0 as name, min(j.value->>1) as data_type
      from analysis_fingerprint f, json_each(f.schema_json) j
      where not exists (select 1 from own o where o.dataset_id = f.dataset_id and o.snapshot_no = f.snapshot_no) group by 1, 2, 3),
    f as (
      select a.*, coalesce(t.type_class, lower(trim(a.data_type))) as cls
      from (select * from own union all select dataset_id, snapshot_no, name, null, null, data_type from spare) a
      left join (select lower(trim(data_type)) as k, any_value(type_class) as type_class from type_alias group by 1) t on t.k = lower(trim(a.data_type))),
    snaps as (select distinct dataset_id, snapshot_no from f),
    steps as (select b.dataset_id, b.snapshot_no from snaps b join snaps a on a.dataset_id = b.dataset_id and a.snapshot_no = b.snapshot_no - 1),
    gone as (select s.dataset_id, s.snapshot_no, o.name, o.label, o.description from steps s join f o on o.dataset_id = s.dataset_id and o.snapshot_no = s.snapshot_no - 1
      where not exists (select 1 from f n where n.dataset_id = s.dataset_id and n.snapshot_no = s.snapshot_no and n.name = o.name)),
    come as (select s.dataset_id, s.snapshot_no, n.name, n.label, n.description from steps s join f n on n.dataset_id = s.dataset_id and n.snapshot_no = s.snapshot_no
      where not exists (select 1 from f o where o.dataset_id = s.dataset_id and o.snapshot_no = s.snapshot_no - 1 and o.name = n.name)),
    renamed as (select g.dataset_id, g.snapshot_no, g.name as old_name, c.name as new_name from gone g join come c using (dataset_id, snapshot_no) where g.label = c.label or g.description = c.description)
    select * from renamed
    union select dataset_id, snapshot_no, '' as old_name, name as new_name from come c where not exists (select 1 from renamed r where r.dataset_id = c.dataset_id and r.snapshot_no = c.snapshot_no and r.new_name = c.name)
    union select dataset_id, snapshot_no, name, '' from gone g where not exists (select 1 from renamed r where r.dataset_id = g.dataset_id and r.snapshot_no = g.snapshot_no and r.old_name = g.name)
    union select n.dataset_id, n.snapshot_no, n.name, n.name from f n join f o on o.dataset_id = n.dataset_id and o.snapshot_no = n.snapshot_no - 1 and o.name = n.name where o.cls is distinct from n.cls"""


def raw_records(loaded: bool = False) -> str:
    """Records that can't be loaded with their reason, or the typed rows of the others."""
    plain, quoted = '[^",\\r\\n]*', '"(?:[^"]|"")*"'
    field = f"(?:{plain}|{quoted})"
    nine = ",".join([f"({field})"] * 9)
    number = r"^<?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?(?:[eE][+-]?\d+)?$"
    bare = lambda c: f"trim(case when {c} like '\"%' then replace(substr({c}, 2, length({c}) - 2), '\"\"', '\"') else {c} end)"
    bad = lambda c: f"({bare(c)} <> '' and (not regexp_matches({bare(c)}, '{number}') or isinf(try_cast(regexp_replace({bare(c)}, '[<,]', '', 'g') as double))))"
    flag = bare("x.h").replace("trim(", "(", 1)
    text = lambda c: f"case when {c} like '\"%' then replace(substr({c}, 2, length({c}) - 2), '\"\"', '\"') else {c} end"
    value = lambda c: f"try_cast(regexp_replace({bare(c)}, '[<,+\\s]', '', 'g') as double)"
    columns = dict(zip("abcdeghi", ("systemname", "wssn", "locname", "sysloccode", "sampledate", "pfosresult", "pfoaflags", "pfosflags"))) | {"f": "pfoaresult"}
    typed = ", ".join(f"{value(f'x.{k}') if n in ('pfoaresult', 'pfosresult') else text(f'x.{k}')} as {n}" for k, n in columns.items())
    below = ", ".join(f"starts_with({bare(f'x.{k}')}, '<') as {columns[k]}_below" for k in "fg")
    wrong = f"""not ok or k <> 9 or {bad("x.f")} or {bad("x.g")} or ({flag} <> '' and not regexp_matches({flag}, p))"""
    chosen = f"record_id, file_name, line_no, {typed}, {below} from s, codes where not ({wrong})" if loaded else f"record_id, case when not ok then 'broken_quoting' when k <> 9 then 'column_count' else 'invalid_value' end as reason from s, codes where {wrong}"
    return f"""
    with w as (select record_id, file_name, line_no, raw_record as r, regexp_full_match(raw_record, '{field}(?:,{field})*') as ok from michigan_pfas_raw),
    n as (select *, length(regexp_replace(r, '{quoted}', '', 'g')) - length(replace(regexp_replace(r, '{quoted}', '', 'g'), ',', '')) + 1 as k from w),
    s as (select *, case when ok and k = 9 then regexp_extract(r, '^{nine}$', ['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i']) end as x from n),
    codes as (select '^(' || string_agg(flag_code, '|') || ')( (' || string_agg(flag_code, '|') || '))*$' as p from pfas_flag)
    select {chosen}"""


def _ident(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_')"


MAPPING = f"""
      select dataset_id, name, metric_id, max(conf) as confidence, arg_max(how, conf) as matched_by from (
        select f.dataset_id, f.name, a.quantity as metric_id, w.conf, w.how, row_number() over (partition by f.dataset_id, f.name order by w.conf desc, a.quantity) as rn
        from (select distinct dataset_id, name, label, description from open_data_field) f,
        lateral (values (f.name, 1.0::double, 'name'), (f.label, 0.96::double, 'label'), (f.description, 0.88::double, 'description')) w(t, conf, how)
        join metric_alias a on {_ident("a.metric_label")} = {_ident("w.t")} where {_ident("a.metric_label")} <> '')
      where rn = 1 group by 1, 2, 3"""


def oracle_sql() -> dict[str, str]:
    people = {"c_custkey": "c_custkey", "n_name": "n_name", "r_name": "r_name", "c_mktsegment": "c_mktsegment"}
    b64 = "rtrim(translate(base64(encode({})), '+/', '-_'), '=')"
    url = r"regexp_extract({}, '^([A-Za-z]+)://', 1)"
    links = "select doc_id, unnest(regexp_extract_all(text, '(https?://\\S+)', 1)) as url from documents"
    clean = "select doc_id, regexp_replace(regexp_replace(regexp_replace(u, '[?#].*$', ''), '/+$', ''), '[.,;:]+$', '') as link from (select doc_id, unnest(regexp_extract_all(text, '(https?://[^\\s\"''<>\\\\)]+)', 1)) as u from documents)"
    haversine = "2 * 6371.0088 * asin(sqrt(pow(sin((radians(lat) - radians(42.28)) / 2), 2) + cos(radians(42.28)) * cos(radians(lat)) * pow(sin(radians(lon - (-83.74)) / 2), 2)))"
    canon = lambda c: f"case when try_cast({c} as double) is not null then (try_cast({c} as double))::bigint::varchar else lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) end"
    return {
        "latest_per_stream": f"select {STREAM} as stream_id, user_id, event_type as metric, ts, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
        "wide_to_streams_latest": f"select l_suppkey, metric, l_shipdate as ts, value from ({LINE_POINTS}) qualify row_number() over (partition by l_suppkey, metric order by l_shipdate desc, {LINE_SEQ}) = 1",
        "selected_metrics": "select l_suppkey, 'l_quantity' as metric, count(*) as n, round(sum(l_quantity), 2) as total from lineitem group by 1",
        "point_history_dedup": f"""select l_suppkey, metric, count(*) as points, min(l_shipdate) as first_ts, max(l_shipdate) as last_ts, round(sum(value), 2) as total from (
            select * from ({LINE_POINTS}) qualify row_number() over (partition by l_suppkey, metric, l_shipdate order by {LINE_SEQ}) = 1) group by 1, 2""",
        "top_k_latest_per_unit": "select o_custkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn, o_orderkey, o_orderdate, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') qualify rn <= 3",
        "filtered_tail": "select event_id, user_id, value from events where event_type = 'error' order by event_id desc limit 20",
        "cadence_median_gap": f"select round(c, 4) as cadence_seconds from ({GAP})",
        "cadence_window30": """select round(median(c), 4) as cadence_seconds from (select (epoch_us(max(t)) - epoch_us(min(t))) / 1e6 / 30 as c, count(*) as n from (
            select user_id, event_type, t from (select distinct user_id, event_type, ts as t from events) qualify row_number() over (partition by user_id, event_type order by t desc) <= 30) group by user_id, event_type) where n >= 2 and c > 0""",
        "freshness_staleness": f"select latest, round(epoch_us(timestamp '2024-02-01') / 1e6 - epoch_us(latest) / 1e6, 3) as lag_seconds, epoch_us(timestamp '2024-02-01') / 1e6 - epoch_us(latest) / 1e6 >= greatest(1800, 5 * c) as stale from (select max(ts) as latest from events), ({GAP})",
        "bucket_stats_5min": _buckets("5 minutes"),
        "bucket_stats_hourly": _buckets("1 hour"),
        "streaming_buckets": _buckets("1 hour").replace("group by", "where time_bucket(interval '1 hour', ts) + interval '1 hour' <= (select max(ts) - interval '1 hour' from events) group by"),
        "latest_sink": "select user_id, event_type, ts, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
        "stream_discovery": "select distinct user_id, event_type from events",
        "chao1_population": """with g as (select o_custkey, count(*) as c from orders group by 1),
            s as (select count(*) as o, count(*) filter (c = 1) as f1, count(*) filter (c = 2) as f2, coalesce(sum(c), 0)::bigint as n from g),
            u as (select *, case when o = 0 then 0.0 when f2 > 0 then f1 * f1 / (2.0 * f2) else f1 * greatest(f1 - 1, 0) / 2.0 end as unseen from s)
            select o as observed, greatest(o, ceil(o + unseen)::bigint) as estimated, f1 as singletons, f2 as doubletons, n as sample_rows, round_even(unseen, 3) as unseen, round_even(greatest(0.0, least(1.0, 1.0 - f1 / greatest(n, 1))), 3) as confidence from u""",
        "physical_ordering": """with p as (select ts, lag(ts) over (order by event_id) as pt, user_id, lag(user_id) over (order by event_id) as pu from events),
            s as (select count(*) as row_count, round(avg(case when pt <= ts then 1.0 when pt is not null then 0 end), 6) as ascending, round(avg(case when pt >= ts then 1.0 when pt is not null then 0 end), 6) as descending, round(avg(case when pu = user_id then 1.0 when pu is not null then 0 end), 6) as adjacent_same from p)
            select *, case when row_count < 4 then 'unknown' when ascending >= 0.9 then 'time_ascending' when descending >= 0.9 then 'time_descending' when adjacent_same >= 0.6 then 'entity_grouped' when adjacent_same <= 0.2 then 'effectively_random' else 'unknown' end as ordering from s""",
        "retrieval_plan": """with g as (select user_id, count(*) as c from events group by 1), s as (select count(*) as o, count(*) filter (c = 1) as f1, count(*) filter (c = 2) as f2 from g),
            e as (select greatest(1, o, ceil(o + case when f2 > 0 then f1 * f1 / (2.0 * f2) else f1 * greatest(f1 - 1, 0) / 2.0 end))::bigint as e, (select count(distinct event_type) from events) as m from s)
            select e as estimated_entities, m as dimension_multiplier, least(100000, e * 50 * m)::bigint as target_rows, ceil(least(100000, e * 50 * m) / e)::bigint as observations_per_entity from e""",
        "stratified_sample": _stratified("event_id, user_id, ts"),
        "sampling_evidence": f"select 200 as requested, (select count(*) from events) as source_rows, count(*) as sampled_rows, count(distinct user_id) as entities, count(distinct ts) as times, min(ts) as first_time, max(ts) as last_time, (select count(*) from events) > count(*) as truncated from ({_stratified('*')})",
        "functional_dependencies": f"""with g as (select det, dep, v, count(distinct w) as k from ({_pairs(people)}) group by 1, 2, 3),
            p as (select det, dep, count(*) as k, avg(case when k = 1 then 1.0 else 0 end) as c from g group by 1, 2)
            select a.det as determinant, a.dep as dependent, a.k as determinant_values, b.k as dependent_values, round(a.c, 6) as confidence from p a join p b on b.det = a.dep and b.dep = a.det where a.k >= 2 and a.c >= 0.95 and b.k > 1""",
        "dimension_relationships": f"""with g as (select det, dep, v, count(distinct w) as k, min(w) as w, count(*) as n from ({_pairs({k: v for k, v in people.items() if k != 'c_mktsegment'})}) group by 1, 2, 3),
            p as (select det, dep, count(*) as k, avg(case when k = 1 then 1.0 else 0 end) as s, sum(n) as n from g group by 1, 2),
            m as (select det, dep, max(c) as most from (select det, dep, w, count(*) as c from g where k = 1 group by 1, 2, 3) group by 1, 2),
            r as (select a.det as child, a.dep as parent, round_even(a.s, 3) as confidence, 1.0::double as coverage, b.k as parent_values, a.k as child_values from p a join p b on b.det = a.dep and b.dep = a.det join m on m.det = a.det and m.dep = a.dep where a.k >= 2 and a.n >= 3 and b.k < a.k and most > 1 and a.s >= 0.8)
            select * from r where not exists (select 1 from r x join r y on x.parent = y.child where x.child = r.child and y.parent = r.parent and least(x.confidence, y.confidence) >= r.confidence - 0.05)""",
        "field_behaviour": f"select * exclude (position) from ({_behaviour()})",
        "long_metric_preview": PREVIEW,
        "observation_shape": f"""with b as ({_behaviour(False)}), k as (select string_agg(field, '|' order by position) as metrics, count(*) as n from b where role = 'metric'), p as ({PREVIEW})
            select case when accepted then 'long' when n >= 2 then 'wide' else 'event_or_single_metric' end as shape, case when accepted then 0.9 when n >= 2 then 0.85 else 0.65 end::double as confidence, coalesce(metrics, '') as metrics from k, p""",
        "grid_scores": " union all ".join(
            f"""select 'month' as time_field, '{f}' as place_field, sum(c)::bigint as pairs, round(0.45 * (select avg(case when k >= 2 then 1.0 else 0 end) from (select t, count(distinct p) as k from g group by 1))
            + 0.35 * (select avg(case when k >= 2 then 1.0 else 0 end) from (select p, count(distinct t) as k from g group by 1)) + 0.2 * count(*) / sum(c), 6) as score from g"""
            .replace("from g", f"from (select strftime(l_shipdate, '%Y-%m') as t, {f}::varchar as p, count(*) as c from lineitem group by 1, 2) g")
            for f in ("l_suppkey", "l_returnflag")
        ),
        "unit_selections": f"select n_name, c_mktsegment, min(c_custkey) as c_custkey, n_name || ' / ' || c_mktsegment as label from {PEOPLE} group by 1, 2",
        "disambiguated_labels": "select p_partkey, case when count(*) over (partition by p_name) > 1 then p_name || ' — ' || p_brand || ' / ' || p_type else p_name end as unique_label from part",
        "unit_key_tokens": "select c_custkey, 'v1:' || " + b64.format("'[\"' || c_custkey || '\",\"' || c_mktsegment || '\"]'") + " as token, c_custkey || '|' || c_mktsegment as parts from customer",
        "stream_ids": f"select distinct {STREAM} as stream_id, user_id, event_type as metric from events",
        "new_streams": f"select distinct user_id, event_type from {HALVES} where late except select user_id, event_type from {HALVES} where not late",
        "reconcile_selection": "select case when c_custkey % 2 = 0 then 'v1:' || " + b64.format("'[\"' || c_custkey || '\"]'") + " else c_custkey::varchar end as saved, c_custkey from customer",
        "score_catalog": f"select doc_id, {SCORE} as score from (select doc_id, {SEARCHABLE} as t from documents)",
        "catalog_quality": f"select doc_id, case when {any_of('t', OFFICIAL_MARKERS)} then 10 else 0 end + case when {any_of('t', DERIVED_MARKERS)} then -30 else 0 end + case when source = 'catalog_description' then 12 else -18 end as adjustment from (select doc_id, source, lower(concat_ws(' ', source, text)) as t from documents)",
        "rank_catalog": f"select doc_id, score from (select doc_id, {SCORE} as score from (select doc_id, {SEARCHABLE} as t from documents)) where score >= 20 order by score desc, doc_id limit 10",
        "search_catalog": "select doc_id from documents where contains(lower(text), 'ozone') and contains(lower(text), 'sensor')",
        "ontology_mapping": MAPPING,
        "profile_match": f"""with pr(profile_id, o, kind, metric_id) as (values ('weather', 1, 'core', 'air_temperature'), ('weather', 1, 'core', 'relative_humidity'), ('weather', 1, 'support', 'wind_speed'), ('weather', 1, 'support', 'air_pressure'), ('air', 2, 'core', 'pm2_5'), ('air', 2, 'core', 'nitrogen_dioxide'), ('water', 3, 'core', 'water_level'), ('water', 3, 'support', 'streamflow')),
            z as (select profile_id, o, count(*) filter (kind = 'core') as cores, count(*) filter (kind = 'support') as supports from pr group by 1, 2),
            h as (select dataset_id, profile_id, count(*) filter (kind = 'core') as c, count(*) filter (kind = 'support') as s from (select distinct dataset_id, metric_id from ({MAPPING})) join pr using (metric_id) group by 1, 2),
            x as (select dataset_id, h.profile_id, o, (0.65 * c / greatest(cores, 1) + 0.2 * s / greatest(supports, 1)) * case when c > 0 then 1.0 else 0.45 end as confidence from h join z using (profile_id))
            select dataset_id, profile_id, round(confidence, 6)::double as confidence from x where confidence >= 0.15 qualify row_number() over (partition by dataset_id order by confidence desc, o) = 1""",
        "url_normalize": f"select distinct url, lower({url.format('url')}) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') as normal, lower({url.format('url')}) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) as origin from ({links})",
        "parse_reference": f"""with u as (select distinct link as url, regexp_extract(link, '^(https?://[^/?#]+)', 1) as o, list_filter(string_split(regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') as p from ({clean})),
            v as (select *, list_position(p, 'dataset') as d, list_position(p, 'resource') as r, p[1:3] = ['api', '3', 'action'] as api, p[1:3] = ['api', 'catalog', 'v1'] as cat, list_filter(list_transform(p, lambda x: lower(string_split(x, '.')[1])), lambda x: regexp_full_match(x, '[a-z0-9]{{4}}-[a-z0-9]{{4}}')) as ids,
                api and p[4] in ('datastore_search', 'datastore_search_sql') as store from u),
            w as (select *, d > 0 as has, coalesce(list_filter([lower(p[nullif(list_position(p, m), 0) + 1]) for m in ['resource', 'views', 'd']], lambda x: regexp_full_match(x, '[a-z0-9]{{4}}-[a-z0-9]{{4}}'))[1], ids[-1]) as soc from v)
            select url, case when has or api then 'ckan' when soc is not null or cat then 'socrata' end as ref_provider,
                case when has or api or soc is not null or cat or len(p) = 0 then o else regexp_replace(url, '/+$', '') end as ref_portal,
                case when has then p[d + 1] when api then null else soc end as ref_dataset, case when has and r > 0 then p[r + 1] end as ref_resource,
                (case when has then p[d + 1] when api then null else soc end) is null and not coalesce(store, false) as ref_is_portal from w""",
        "candidate_roots": """with a as (select portal_id, 'https://www.' || portal_id || '.example' as o, case provider when 'ckan' then ['city', 'dataset', 'rain'] when 'socrata' then ['Browse'] when 'arcgis' then [] else ['city', 'datasets', 'list'] end as p from portal),
            b as (select *, (select min(i) from unnest(range(1, len(p) + 1)) t(i) where lower(p[i]) in ('dataset', 'datasets', 'data', 'catalog', 'catalogue', 'explore', 'browse', 'search', 'group', 'organization', 'api')) as i from a),
            c as (select *, case when i > 1 then o || '/' || array_to_string(p[1:i - 1], '/') else o end as prefix, case when len(p) > 0 then o || '/' || array_to_string(p, '/') else o end as whole from b)
            select portal_id, o || case when prefix <> o then ' ' || prefix else '' end || case when whole not in (o, prefix) then ' ' || whole else '' end as roots,
                (select string_agg('https://' || s || '.' || portal_id || '.example', ' ' order by k) from (values (1, 'ckan'), (2, 'data'), (3, 'opendata'), (4, 'catalog'), (5, 'geodata')) z(k, s)) as siblings from c""",
        "html_links": f"select distinct doc_id, link from ({clean})",
        "json_envelope": "select event_id, (props->>'k')::bigint as k from events",
        "location_rank": f"select location_name, round({haversine}, 6) as distance_km from (select location_name, min(lat) as lat, min(lon) as lon from ann_arbor_air_quality where location_name is not null group by 1)",
        "coordinate_evidence": "select count(*) filter (lat is not null or lon is not null) as present, count(*) filter (lat between -90 and 90 and lon between -180 and 180) as valid_pairs, count(*) filter (lat is not null or lon is not null) = count(*) filter (lat between -90 and 90 and lon between -180 and 180) as trusted from ann_arbor_air_quality",
        "fingerprint_events": """with v as (select 'event_type' as f, v from (select distinct lower(event_type) as v from events order by v limit 64) union all select 'user_id', v from (select distinct user_id::varchar as v from events order by v limit 64)),
            p as (select string_agg(s, ';' order by s) as dimensions from (select f || '=' || string_agg(v, '|' order by v) as s from v group by f)),
            q as (select 'event_id:bigint|event_type:string|props:string|ts:timestamp_ntz|user_id:bigint|value:double' as schema, 'user_id:entity' as roles, 'value' as metrics, dimensions, 'none' as coordinates, 'unknown' as ordering from p)
            select *, sha256(concat_ws(chr(10), schema, roles, metrics, dimensions, coordinates, ordering)) as digest from q""",
        "reanalysis_decisions": """with r as (select *, row_number() over (partition by dataset_id order by snapshot_no desc) as rn from analysis_fingerprint),
            j as (select n.dataset_id, o.digest is null as fresh, n.digest = o.digest as same, n.schema_json <> o.schema_json as sc, n.metrics <> o.metrics as me, n.coordinate_mode <> o.coordinate_mode as co, n.ordering <> o.ordering as od from r n left join r o on o.dataset_id = n.dataset_id and o.rn = 2 where n.rn = 1),
            d as (select dataset_id, case when fresh then 'initial_analysis' when same then 'unchanged' when sc then 'schema_changed' when me then 'metric_coverage_changed' when co then 'coordinate_interpretation_changed' when od then 'physical_ordering_changed' end as reason from j)
            select dataset_id, reason <> 'unchanged' as should_run, reason from d""",
        "resource_choice": "select portal_id, resource_id, kind from (select portal_id, doc_id::varchar as resource_id, case when doc_id % 3 = 0 and doc_id % 2 = 0 then 3 when doc_id % 3 = 1 then 2 when doc_id % 2 = 0 then 1 else 0 end as kind, collected_at as m from documents) where kind > 0 qualify row_number() over (partition by portal_id order by kind desc, m desc nulls last, resource_id desc) = 1",
        "canonical_text": f"select {canon('a')} as category, {canon('b')} as size, count(*) as n from (select '  ' || upper(p_type) || '  ' || p_brand as a, p_size || '.0' as b from part) group by 1, 2",
        "corpus_summary": "select source, lang, count(*) as n, count(distinct k) as ids, max(length(substr(text, 1, 160)))::int as longest, min(k) as first_id from (select source, lang, text, substr(sha256(coalesce(portal_id, '') || chr(10) || coalesce(source, '') || chr(10) || doc_id), 1, 20) as k from documents) group by 1, 2",
        "field_names": "select distinct name, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') as ascii_form, trim(regexp_replace(lower(label), '[^\\pL\\pN]+', '_', 'g'), '_') as word_form, trim(regexp_replace(lower(label), '[^\\pL\\pM\\pN_]+', '_', 'g'), '_') as corpus_form from open_data_field",
        "dirty_numbers": """select obs_id, case when regexp_full_match(value, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') then try_cast(trim(value) as double) end as finite,
            case when lower(trim(value)) not in ('', 'na', 'n/a', 'nan', 'none', 'null', 'nd', '-', '--') and regexp_full_match(regexp_replace(replace(trim(value), ',', ''), '^<\\s*', ''), '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') then try_cast(trim(regexp_replace(replace(trim(value), ',', ''), '^<\\s*', '')) as double) end as dirty,
            coalesce(length(trim(value)) >= 8 and regexp_full_match(trim(value), '\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}.*'), false) as temporal from semantic_observation""",
        "stale_sources": """select source_table, source_name as site from source_registry except (select 'ann_arbor_rainfall', site from ann_arbor_rainfall
            union all select 'ann_arbor_air_quality', location_name from ann_arbor_air_quality union all select 'chicago_beach_weather', station_name from chicago_beach_weather)""",
        "statistics_once": """with m as (select time_bucket(interval '1 hour', make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2)) as m from events)
            select event_type, time_bucket(interval '1 hour', ts) as bucket, count(*) as n from events, m group by 1, 2 having count(*) filter (ts < m) = 0""",
        "attribute_projection": """select p_partkey, '{"p_name":"' || p_name || '","p_brand":"' || p_brand || '","p_type":"' || p_type || '","p_size":"' || p_size || '"}' as attributes from part""",
        "unsent_reports": "select a.dataset_id, a.snapshot_no, sha256(a.schema_json) as digest from analysis_fingerprint a left join analysis_fingerprint b on b.dataset_id = a.dataset_id and b.snapshot_no = a.snapshot_no - 1 where b.schema_json is null or b.schema_json <> a.schema_json",
        "pruned_sources": "select source_table, source_name from source_registry except select source_table, source_name from source_deployment",
        "prepared_catalogs": "select portal_id, 'https://' || lower(portal_id) as portal_key, case when provider = 'ckan' then 'failed' else 'ready' end as status from portal",
        "source_route": f"select a as api_latest, f as file_latest, case when a is null or f is null or epoch_us(f) - epoch_us(a) >= 1800e6 then 'file' else 'api' end as source from (select max(ts) filter (not late) as a, max(ts) as f from {HALVES})",
        "record_selections": "select 'v1:' || " + b64.format("'[\"' || wssn || '\",\"' || sysloccode || '\"]'") + " as token, systemname || ' / ' || locname as label from (select wssn, sysloccode, arg_min(systemname, row_id) as systemname, arg_min(locname, row_id) as locname from michigan_pfas where wssn <> '' and sysloccode <> '' group by 1, 2)",
        "p2_found": raw_records(),
        "p5_found": changes(),
    }
