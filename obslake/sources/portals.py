"""Readers of open-data portals as Spark data sources: datasets and catalogs, paged, with equality filters pushed down.

    spark.dataSource.register(PortalDataSource)
    spark.read.format("portal").option("provider", "ckan").option("portal", url).option("dataset", resource_id).load()

A partition is a page, so pages are fetched in parallel by the executors, at most as many at a time as there are cores.
All columns of records are texts. With option ``recorded`` answers are read from a folder of JSON files (see recorded_name())
instead of the network, which is how the readers are tested.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
import os
import socket
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

PAGE_ROWS = 500
ANSWER_BYTES = 2 << 20
DISTINCT_ROWS = 1000
# Fixed value: the catalog of all portals of one kind, which is asked where a portal's own doesn't answer.
REGIONAL_CATALOG = "https://api.us.socrata.com"
CATALOG_FIELDS = ["dataset_id", "title", "description", "raw"]


@dataclass(frozen=True)
class Capabilities:
    """What a provider's interface offers; require() refuses what it doesn't."""

    catalog_list: bool = True
    catalog_search: bool = True
    schema: bool = True
    sample: bool = True
    filter: bool = True
    order: bool = True
    distinct: bool = True
    timeseries: bool = True
    files: bool = False
    geometry: bool = False

    def require(self, name: str) -> None:
        if name not in {f.name for f in fields(self)} or not getattr(self, name):
            raise NotImplementedError(f"the provider does not offer {name}")


def public_url(url: str, resolve: bool = True) -> str:
    """The address if it is HTTP(S) and its host is public; ValueError if not."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.username:
        raise ValueError("not a public HTTP address")
    try:
        hosts = [ipaddress.ip_address(parts.hostname)]
    except ValueError:
        if parts.hostname == "localhost" or parts.hostname.endswith((".local", ".localhost", ".internal")):
            raise ValueError("not a public host") from None
        hosts = [ipaddress.ip_address(x[4][0]) for x in socket.getaddrinfo(parts.hostname, None)] if resolve else []
    if any(not h.is_global for h in hosts):
        raise ValueError("not a public host")
    return url


def recorded_name(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()[:20] + ".json"


class _Refuse(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *a: Any) -> None:
        return None


def get_json(url: str, recorded: str | None = None, timeout: float = 15) -> Any:
    """A JSON answer of bounded size, without following redirects."""
    if recorded:
        with open(os.path.join(recorded, recorded_name(url)), encoding="utf-8") as f:
            return json.load(f)
    request = urllib.request.Request(public_url(url), headers={"Accept": "application/json"})
    with urllib.request.build_opener(_Refuse).open(request, timeout=timeout) as answer:
        body = answer.read(ANSWER_BYTES + 1)
    if len(body) > ANSWER_BYTES:
        raise ValueError("the answer is too large")
    return json.loads(body)


def _query(base: str, **params: Any) -> str:
    return base + "?" + urllib.parse.urlencode({k.replace("S_", "$"): v for k, v in params.items() if v is not None})


def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _name(c: str) -> str:
    if not c.replace("_", "").replace(":", "").replace("@", "").isalnum():
        raise ValueError(f"not a field name: {c}")
    return c


class Provider:
    """The interface of one kind of portal: addresses to ask and how to read the answers."""

    capabilities = Capabilities()

    def __init__(self, portal: str, dataset: str | None):
        self.portal, self.dataset = portal.rstrip("/"), dataset

    def schema_url(self) -> str: ...
    def schema(self, a: Any) -> list[tuple[str, str, str, str | None]]: ...
    def count_url(self, where: dict[str, str]) -> str: ...
    def count(self, a: Any) -> int: ...
    def rows_url(self, offset: int, limit: int, where: dict[str, str], order: str | None) -> str: ...
    def rows(self, a: Any) -> list[dict]: ...
    def catalog_url(self, offset: int, limit: int, query: str | None) -> str: ...
    def catalog(self, a: Any) -> tuple[int, list[dict]]: ...
    def distinct_url(self, fields: list[str], limit: int) -> str: ...

    def other_catalog_url(self, offset: int, limit: int, query: str | None) -> str | None:
        """Where the catalog is asked for if the portal itself doesn't answer."""
        return None

    def other_catalog(self, a: Any) -> tuple[int, list[dict]]:
        return self.catalog(a)


class Ckan(Provider):
    capabilities = Capabilities(files=True)

    def _action(self, name: str, **params: Any) -> str:
        return _query(f"{self.portal}/api/3/action/{name}", **params)

    def schema_url(self) -> str:
        return self._action("datastore_search", resource_id=self.dataset, limit=0)

    def schema(self, a: Any) -> list[tuple[str, str, str, str | None]]:
        return [(f["id"], (f.get("info") or {}).get("label") or f["id"], f.get("type", "text"), (f.get("info") or {}).get("notes")) for f in a["result"]["fields"] if f["id"] != "_id"]

    def count_url(self, where: dict[str, str]) -> str:
        return self._action("datastore_search", resource_id=self.dataset, limit=0, filters=json.dumps(where, sort_keys=True) if where else None)

    def count(self, a: Any) -> int:
        if not a.get("success", True):
            raise ValueError("the portal reports a failure")
        return int(a["result"].get("total", 0))

    def rows_url(self, offset: int, limit: int, where: dict[str, str], order: str | None) -> str:
        return self._action("datastore_search", resource_id=self.dataset, limit=limit, offset=offset, filters=json.dumps(where, sort_keys=True) if where else None, sort=f'"{_name(order)}" desc' if order else "_id")

    def rows(self, a: Any) -> list[dict]:
        return a["result"]["records"]

    def catalog_url(self, offset: int, limit: int, query: str | None) -> str:
        return self._action("package_search", q=query, rows=limit, start=offset)

    def catalog(self, a: Any) -> tuple[int, list[dict]]:
        return int(a["result"]["count"]), [{"dataset_id": p.get("name") or p.get("id"), "title": p.get("title"), "description": p.get("notes"), "raw": p} for p in a["result"]["results"]]


    def distinct_url(self, fields: list[str], limit: int) -> str:
        names = ", ".join(f'"{_name(f)}"' for f in fields)
        return self._action("datastore_search_sql", sql=f'SELECT DISTINCT {names} FROM "{self.dataset}" ORDER BY "{fields[0]}" LIMIT {limit}')

    def package_url(self, resource: str) -> str:
        return self._action("resource_show", id=resource.strip())

    def package(self, a: Any) -> str:
        """The dataset that a resource belongs to."""
        found = (a.get("result") or {}).get("package_id")
        if not isinstance(found, str) or not found.strip():
            raise ValueError("the resource names no dataset")
        return found.strip()


class Socrata(Provider):
    def schema_url(self) -> str:
        return f"{self.portal}/api/views/{self.dataset}.json"

    def schema(self, a: Any) -> list[tuple[str, str, str, str | None]]:
        return [(c["fieldName"], c.get("name") or c["fieldName"], c.get("dataTypeName", "text"), c.get("description")) for c in a["columns"] if not c["fieldName"].startswith(":@")]

    def _where(self, where: dict[str, str]) -> str | None:
        return " AND ".join(f"{_name(k)}={_quoted(v)}" for k, v in sorted(where.items())) or None

    def count_url(self, where: dict[str, str]) -> str:
        return _query(f"{self.portal}/resource/{self.dataset}.json", S_select="count(*) as n", S_where=self._where(where))

    def count(self, a: Any) -> int:
        return int(a[0]["n"])

    def rows_url(self, offset: int, limit: int, where: dict[str, str], order: str | None) -> str:
        return _query(f"{self.portal}/resource/{self.dataset}.json", S_limit=limit, S_offset=offset, S_where=self._where(where), S_order=f"{_name(order)} DESC" if order else ":id")

    def rows(self, a: Any) -> list[dict]:
        return a

    def catalog_url(self, offset: int, limit: int, query: str | None) -> str:
        return _query(f"{self.portal}/api/catalog/v1", domains=urllib.parse.urlsplit(self.portal).hostname, only="datasets", q=query, limit=limit, offset=offset)

    def catalog(self, a: Any) -> tuple[int, list[dict]]:
        return int(a["resultSetSize"]), [{"dataset_id": r["resource"]["id"], "title": r["resource"].get("name"), "description": r["resource"].get("description"), "raw": r} for r in a["results"]]


    def distinct_url(self, fields: list[str], limit: int) -> str:
        names = ",".join(map(_name, fields))
        return _query(f"{self.portal}/resource/{self.dataset}.json", S_select=f"distinct {names}", S_order=fields[0], S_limit=limit)

    def other_catalog_url(self, offset: int, limit: int, query: str | None) -> str | None:
        return _query(f"{REGIONAL_CATALOG}/api/catalog/v1", domains=urllib.parse.urlsplit(self.portal).hostname, only="datasets", q=query, limit=limit, offset=offset)


class ArcGis(Provider):
    capabilities = Capabilities(geometry=True)

    def schema_url(self) -> str:
        return _query(str(self.dataset), f="json")

    def schema(self, a: Any) -> list[tuple[str, str, str, str | None]]:
        own = [(f["name"], f.get("alias") or f["name"], f.get("type", ""), None) for f in a["fields"]]
        return [*own, ("geometry", "geometry", a.get("geometryType", ""), None)] if a.get("geometryType") else own

    def _where(self, where: dict[str, str]) -> str:
        return " AND ".join(f"{_name(k)}={_quoted(v)}" for k, v in sorted(where.items())) or "1=1"

    def count_url(self, where: dict[str, str]) -> str:
        return _query(f"{self.dataset}/query", where=self._where(where), returnCountOnly="true", f="json")

    def count(self, a: Any) -> int:
        return int(a["count"])

    def rows_url(self, offset: int, limit: int, where: dict[str, str], order: str | None) -> str:
        return _query(f"{self.dataset}/query", where=self._where(where), outFields="*", resultOffset=offset, resultRecordCount=limit, orderByFields=f"{_name(order)} DESC" if order else None, f="json")

    def rows(self, a: Any) -> list[dict]:
        return [{**f.get("attributes", {}), **({"geometry": f["geometry"]} if "geometry" in f else {})} for f in a["features"]]

    def catalog_url(self, offset: int, limit: int, query: str | None) -> str:
        return _query(f"{self.portal}/api/search/v1/collections/dataset/items", limit=limit, startindex=offset + 1, q=query)

    def catalog(self, a: Any) -> tuple[int, list[dict]]:
        items = [(f.get("properties") or f) | {"id": f.get("id")} for f in a["features"]]
        return int(a["numberMatched"]), [{"dataset_id": i.get("id"), "title": i.get("title"), "description": i.get("description"), "raw": i} for i in items]


    def distinct_url(self, fields: list[str], limit: int) -> str:
        return _query(f"{self.dataset}/query", where="1=1", outFields=",".join(map(_name, fields)), returnDistinctValues="true", returnGeometry="false", orderByFields=fields[0], resultRecordCount=limit, f="json")

    def other_catalog_url(self, offset: int, limit: int, query: str | None) -> str | None:
        return f"{self.portal}/api/feed/dcat-us/1.1.json"

    def other_catalog(self, a: Any) -> tuple[int, list[dict]]:
        """A DCAT feed, which is one page of all datasets."""
        items = [d for d in a.get("dataset", []) if isinstance(d, dict)]
        return len(items), [{"dataset_id": d.get("identifier"), "title": d.get("title"), "description": d.get("description"), "raw": d} for d in items]


class Opendatasoft(Provider):
    def _base(self) -> str:
        return f"{self.portal}/api/explore/v2.1/catalog/datasets"

    def schema_url(self) -> str:
        return f"{self._base()}/{self.dataset}"

    def schema(self, a: Any) -> list[tuple[str, str, str, str | None]]:
        return [(f["name"], f.get("label") or f["name"], f.get("type", "text"), f.get("description")) for f in a["fields"]]

    def _where(self, where: dict[str, str]) -> str | None:
        return " and ".join(f"{_name(k)} = {json.dumps(v)}" for k, v in sorted(where.items())) or None

    def count_url(self, where: dict[str, str]) -> str:
        return _query(f"{self._base()}/{self.dataset}/records", limit=0, where=self._where(where))

    def count(self, a: Any) -> int:
        return int(a["total_count"])

    def rows_url(self, offset: int, limit: int, where: dict[str, str], order: str | None) -> str:
        return _query(f"{self._base()}/{self.dataset}/records", limit=limit, offset=offset, where=self._where(where), order_by=f"{_name(order)} desc" if order else None)

    def rows(self, a: Any) -> list[dict]:
        return a["results"]

    def catalog_url(self, offset: int, limit: int, query: str | None) -> str:
        return _query(self._base(), limit=limit, offset=offset, where=f"search({json.dumps(query)})" if query else None)

    def catalog(self, a: Any) -> tuple[int, list[dict]]:
        out = []
        for r in a["results"]:
            meta = (r.get("metas") or {}).get("default") or {}
            out.append({"dataset_id": r["dataset_id"], "title": meta.get("title"), "description": meta.get("description"), "raw": r})
        return int(a["total_count"]), out


    def distinct_url(self, fields: list[str], limit: int) -> str:
        return _query(f"{self._base()}/{self.dataset}/records", group_by=",".join(map(_name, fields)), order_by=fields[0], limit=min(limit, 100))


def clamped(limit: int, most: int) -> int:
    """A limit between one and ``most``."""
    return min(max(limit, 1), most)


def distinct_catalog(entries: DataFrame, most: int = 1000) -> DataFrame:
    """Catalog entries, one per dataset_id, at most ``most`` in order of it; entries without an id are left out."""
    rest = [c for c in entries.columns if c != "dataset_id"]
    once = entries.where("dataset_id is not null").groupBy("dataset_id").agg(F.min(F.struct(*rest)).alias("__e"))
    return once.orderBy("dataset_id").limit(most).select("dataset_id", "__e.*")


PROVIDERS: dict[str, type[Provider]] = {"ckan": Ckan, "socrata": Socrata, "arcgis": ArcGis, "opendatasoft": Opendatasoft}


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class PortalReader(DataSourceReader):
    """Records or catalog entries of a portal, a page per partition."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.options, self.where = [f.name for f in schema], dict(options), {}

    def _provider(self) -> Provider:
        return PROVIDERS[self.options["provider"]](self.options["portal"], self.options.get("dataset"))

    def _get(self, url: str) -> Any:
        return get_json(url, self.options.get("recorded"))

    def _catalog(self, p: Provider, offset: int, size: int) -> tuple[int, list[dict]]:
        """A page of the portal's catalog, or of the one that stands in for it."""
        query = self.options.get("query")
        try:
            return p.catalog(self._get(p.catalog_url(offset, size, query)))
        except (OSError, ValueError, KeyError, TypeError):
            other = p.other_catalog_url(offset, size, query)
            if other is None:
                raise
            total, items = p.other_catalog(self._get(other))
            return total, items[offset : offset + size] if len(items) > size else items

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, str) and self.options.get("dataset") and f.attribute[0] not in self.where:
                self.where[f.attribute[0]] = f.value
            yield f  # compared again by Spark: portals differ in what they call equal

    def partitions(self) -> list[InputPartition]:
        p, size = self._provider(), int(self.options.get("pagerows", PAGE_ROWS))
        if self.options.get("distinct"):
            return [Page(0, clamped(int(self.options.get("maxrows", DISTINCT_ROWS)), DISTINCT_ROWS))]
        if self.options.get("dataset"):
            total = p.count(self._get(p.count_url(self.where)))
        else:
            total = self._catalog(p, 0, size)[0]
        most = self.options.get("maxrows")
        total = min(total, int(most)) if most else total
        return [Page(i, min(size, total - i)) for i in range(0, total, size)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.limit <= 0:
            return
        p = self._provider()
        if self.options.get("distinct"):
            rows = p.rows(self._get(p.distinct_url(self.options["distinct"].split(","), partition.limit)))
        elif self.options.get("dataset"):
            rows = p.rows(self._get(p.rows_url(partition.offset, partition.limit, self.where, self.options.get("order"))))
        else:
            rows = self._catalog(p, partition.offset, int(self.options.get("pagerows", PAGE_ROWS)))[1][: partition.limit]
        for r in rows:
            yield tuple(None if r.get(c) is None else r[c] if isinstance(r[c], str) else json.dumps(r[c], ensure_ascii=False, sort_keys=True) for c in self.names)


class PortalDataSource(DataSource):
    """Options: provider (ckan, socrata, arcgis, opendatasoft), portal, dataset (without it: the catalog), query, order (a
    field, newest first), distinct (fields joined by commas: their distinct values, in order of the first, at most 1,000),
    pageRows, maxRows, recorded."""

    @classmethod
    def name(cls) -> str:
        return "portal"

    def schema(self) -> StructType:
        if not self.options.get("dataset"):
            return StructType([StructField(c, StringType()) for c in CATALOG_FIELDS])
        p = PROVIDERS[self.options["provider"]](self.options["portal"], self.options["dataset"])
        p.capabilities.require("schema")
        listed = p.schema(get_json(p.schema_url(), self.options.get("recorded")))
        if self.options.get("distinct"):
            wanted = self.options["distinct"].split(",")
            by_name = {x[0]: x for x in listed}
            if not set(wanted) <= set(by_name):
                raise ValueError(f"no such fields: {sorted(set(wanted) - set(by_name))}")
            listed = [by_name[n] for n in wanted]
        return StructType([StructField(n, StringType(), True, {"label": lab, "source_type": t, "description": de}) for n, lab, t, de in listed])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PortalReader(schema, self.options)
