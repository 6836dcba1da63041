"""Portal and dataset addresses: normal form, provider references, candidate roots, links in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOCRATA_ID = r"^[a-z0-9]{4}-[a-z0-9]{4}$"
# Path parts of catalogs and prefixes of sibling hosts.
PORTAL_PATHS = ["dataset", "datasets", "data", "catalog", "catalogue", "explore", "browse", "search", "group", "organization", "api"]
SIBLINGS = ["ckan", "data", "opendata", "catalog", "geodata"]
ALIAS_PREFIXES = ["data", "opendata", "open", "catalog", "portal", "ckan", "geodata"]
ATTRIBUTE_URL = r"""(?i)(?:href|src|action)\s*=\s*["']([^"'<>\s]+)["']"""
BARE_URL = r"""(https?://[^\s"'<>\\)]+)"""
ESCAPED_URL = r"""(https?:\\/\\/[^\s"'<>]+)"""


def normal_url(c: Column) -> Column:
    """Scheme (https if none) and host in lower case, path without final /, no query, no fragment; null without a host."""
    raw = F.trim(c)
    full = F.when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    scheme = F.lower(F.regexp_extract(full, "^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(full, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(full, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, path))


def origin(c: Column) -> Column:
    return F.regexp_extract(normal_url(c), "^(https?://[^/]+)", 1)


def _segments(c: Column) -> Column:
    path = F.regexp_extract(F.trim(c), r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _after(parts: Column, marker: str) -> Column:
    at = F.array_position(parts, marker)
    return F.when(at > 0, F.get(parts, at.cast("int")))


def parse_reference(df: DataFrame, url: str) -> DataFrame:
    """Adds ref_provider, ref_portal, ref_dataset, ref_resource, ref_is_portal of an address; null portal if it is none."""
    c = F.trim(F.col(url))
    parts = _segments(c)
    is_url = c.rlike(r"^https?://[^/?#]+")
    portal = F.when(is_url, F.regexp_extract(c, "^(https?://[^/?#]+)", 1))
    low = F.transform(parts, lambda x: F.lower(F.split_part(x, F.lit("."), F.lit(1))))
    ids = F.filter(low, lambda x: x.rlike(SOCRATA_ID))
    marked = F.filter(F.array(*[F.lower(F.split_part(_after(parts, m), F.lit("."), F.lit(1))) for m in ("resource", "views", "d")]), lambda x: x.isNotNull() & x.rlike(SOCRATA_ID))
    api = F.slice(parts, 1, 3) == F.array(F.lit("api"), F.lit("3"), F.lit("action"))
    catalog = F.slice(parts, 1, 3) == F.array(F.lit("api"), F.lit("catalog"), F.lit("v1"))
    action = F.get(parts, F.lit(3))
    query = lambda k: F.nullif(F.regexp_extract(c, rf"[?&]{k}=([^&#]*)", 1), F.lit(""))
    ckan = F.array_contains(parts, "dataset")
    store = api & action.isin("datastore_search", "datastore_search_sql")
    first = F.get(marked, F.lit(0))
    last = F.get(F.reverse(ids), F.lit(0))
    socrata = F.coalesce(first, last)
    provider = F.when(ckan | api, "ckan").when(socrata.isNotNull() | catalog, "socrata")
    dataset = F.when(ckan, _after(parts, "dataset")).when(api, F.when(action == "package_show", query("id"))).otherwise(socrata)
    resource = F.when(ckan, _after(parts, "resource")).when(store, query("resource_id"))
    home = F.when(ckan | api | socrata.isNotNull() | catalog | (F.size(parts) == 0), portal).otherwise(F.regexp_replace(F.regexp_replace(c, r"#.*$", ""), r"/+$", ""))
    return df.select(
        "*",
        F.when(is_url, provider).alias("ref_provider"),
        F.when(is_url, home).alias("ref_portal"),
        F.when(is_url, dataset).alias("ref_dataset"),
        F.when(is_url, resource).alias("ref_resource"),
        F.when(is_url, dataset.isNull() & ~F.coalesce(store, F.lit(False))).alias("ref_is_portal"),
    )


def candidate_roots(c: Column) -> Column:
    """Array of likely API roots: origin, the path before a catalog part, the address itself."""
    n, o = normal_url(c), origin(c)
    parts = _segments(n)
    hits = F.filter(F.transform(parts, lambda x, i: F.when(F.lower(x).isin(PORTAL_PATHS), i)), lambda x: x.isNotNull())
    at = F.array_min(hits)
    prefix = F.when(at > 0, F.concat_ws("/", o, F.array_join(F.slice(parts, F.lit(1), F.greatest(at, F.lit(0)).cast("int")), "/"))).otherwise(o)
    return F.when(n.isNotNull(), F.array_distinct(F.filter(F.array(o, prefix, n), lambda x: x.isNotNull())))


def sibling_hosts(c: Column) -> Column:
    """Array of conventional catalog hosts beside an address's host."""
    host = F.regexp_replace(F.regexp_extract(normal_url(c), "^https?://([^/]+)", 1), "^www[.]", "")
    head = F.substring_index(host, ".", 1)
    base = F.when(head.isin(ALIAS_PREFIXES) & F.contains(host, F.lit(".")), F.regexp_replace(host, r"^[^.]+\.", "")).otherwise(host)
    return F.filter(F.array(*[F.concat(F.lit(f"https://{s}."), base) for s in SIBLINGS]), lambda x: x != F.concat(F.lit("https://"), host))


def page_links(html: Column) -> Column:
    """Array of the distinct absolute addresses in a page: in attributes, bare, or with escaped slashes."""
    page = html
    for a, b in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        page = F.replace(page, F.lit(a), F.lit(b))
    attr = F.filter(F.regexp_extract_all(page, F.lit(ATTRIBUTE_URL), F.lit(1)), lambda x: x.rlike("^https?://"))
    bare = F.regexp_extract_all(page, F.lit(BARE_URL), F.lit(1))
    escaped = F.transform(F.regexp_extract_all(page, F.lit(ESCAPED_URL), F.lit(1)), lambda x: F.replace(x, F.lit("\\/"), F.lit("/")))
    return F.array_distinct(F.filter(F.transform(F.concat(attr, bare, escaped), lambda x: F.regexp_replace(normal_url(x), "[.,;:]+$", "")), lambda x: x.isNotNull()))


def query_value(c: Column, key: str) -> Column:
    """The first value of a key in an address's query, decoded; null without one or for what is no address."""
    raw = F.regexp_extract(F.trim(c), rf"^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*\?(?:[^#]*?&)??{key}=([^&#]+)", 1)
    return F.when(raw != "", F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%20"))))
