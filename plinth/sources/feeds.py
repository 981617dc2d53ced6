"""Open-data permit feeds of two kinds, from stored pages or live, as permit records.

Rows arrive as maps of strings; a field map says which source field feeds which column.
``PermitFeed`` is a Python data source that reads pages in order, stops where the feed
ends, and takes date filters and a limit down into the request.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition

from plinth.functions import dates

RECORD = (
    "locality string, permit_number string, permit_type string, description string, applicant_name_raw string, mention_field string, address string, parcel_id string, "
    "lat double, lon double, valuation_usd double, filed_date date, issued_date date, status string, source_url string, raw string"
)
DATE_COLUMNS, FLOAT_COLUMNS = ("filed_date", "issued_date"), ("valuation_usd", "lat", "lon")
_TARGETS = {c.split()[0]: c.split()[1] for c in RECORD.split(", ")}
_MAPPED = [c for c in _TARGETS if c not in ("locality", "mention_field", "raw")]


class Adapter:
    """What the two kinds of feed share."""

    name = ""
    page_size, max_pages = 0, 40
    default_map: dict[str, str] = {}

    def __init__(self, locality: str, config: dict):
        self.locality, self.config = locality, dict(config)

    @property
    def field_map(self) -> dict[str, str]:
        return dict(self.config.get("field_map") or self.default_map)

    def validate(self) -> None:
        raise NotImplementedError

    def _need(self, *keys: str) -> None:
        for key in keys:
            if self.config.get(key) in (None, ""):
                raise ValueError(f"{self.locality}: a source of kind {self.name} needs config.{key}")

    def params(self, since: date | None, page: int, limit: int | None = None) -> dict[str, str]:
        raise NotImplementedError

    def date_of(self, value: Column) -> Column:
        raise NotImplementedError

    def records(self, rows: DataFrame) -> DataFrame:
        """Permit records of ``rows`` (attributes map<string,string>, x and y doubles); those without a permit number are left out.

        Blank fields are null, unknown targets are passed over, and of several fields with
        one target the last that isn't blank counts.
        """
        out: dict[str, Column] = {}
        mention = F.lit(None).cast("string")
        for source, target in self.field_map.items():
            if target not in _MAPPED:
                continue
            raw = F.nullif(F.try_element_at("attributes", F.lit(source)), F.lit(""))
            value = self.date_of(raw) if target in DATE_COLUMNS else dates.to_float(raw) if target in FLOAT_COLUMNS else F.trim(raw)
            out[target] = F.coalesce(value, out[target]) if target in out else value
            if target == "applicant_name_raw":
                mention = F.when(raw.isNotNull(), F.lit(source)).otherwise(mention)
        if "x" in rows.columns:
            out["lat"], out["lon"] = F.col("y"), F.col("x")
        out |= {"locality": F.lit(self.locality), "mention_field": mention, "raw": F.to_json("attributes")}
        place = ["position"] if "position" in rows.columns else []
        got = rows.select(*[out.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _TARGETS.items()], *place)
        return got.where("permit_number IS NOT NULL AND permit_number <> ''")

    def read(self, spark: SparkSession, path: str, since: date | None = None, limit: int | None = None) -> DataFrame:
        """The records of pages stored as JSON files, as a crawl would have read them, with each one's position in the feed; the first ``limit`` of them."""
        self.validate()
        got = self.records(self.stored_rows(spark, path))
        got = got.where(F.col("filed_date") >= F.lit(since)) if since and self.config.get("date_field") else got
        return got.orderBy("position").limit(limit) if limit is not None else got

    def stored_rows(self, spark: SparkSession, path: str) -> DataFrame:
        raise NotImplementedError

    def read_pages(self, pages: DataFrame, rows: str, more: Column) -> DataFrame:
        """position and row: the items of the array column ``rows`` of stored pages (file, …), in the order of the files' names.

        Reading stops at a page that is empty, or short unless ``more``, and after max_pages.
        """
        n = F.greatest(F.coalesce(F.size(rows), F.lit(0)), F.lit(0))
        last = (n == 0) | (~F.coalesce(more, F.lit(False)) & (n < self.page_size))
        # One row of metadata for each page: a window over all of them is right.
        order = Window.orderBy("file")
        kept = pages.select("file", last.alias("last")).withColumns({"ended": F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)), "page": F.row_number().over(order)})
        kept = kept.where(f"NOT ended AND page <= {self.max_pages}").select("file", "page")
        found = pages.join(kept, "file").select("page", F.posexplode(rows).alias("place", "row"))
        return found.select((F.col("page").cast("long") * (1 << 20) + F.col("place")).alias("position"), "row")


class ArcGIS(Adapter):
    """Feature layers: pages of features with attributes and a geometry, dates in milliseconds."""

    name, page_size = "arcgis", 500
    default_map = {
        "RECORDID": "permit_number", "APPTYPEALIAS": "permit_type", "PROJECT_NAME": "applicant_name_raw", "PARCEL_ID": "parcel_id", "RECORD_STATUS": "status",
        "ESTIMATED_COST": "valuation_usd", "SUBMITTED_DATE": "filed_date", "ISSUED_DATE": "issued_date", "MAR_ADDRESS": "address", "LINK_URL": "source_url",
    }
    PAGE = "features array<struct<attributes map<string,string>, geometry struct<x double, y double>>>, exceededTransferLimit boolean, error map<string,string>"

    def validate(self) -> None:
        self._need("service_url")
        if self.config.get("layer_id") is None:  # layer 0 is one
            raise ValueError(f"{self.locality}: a source of kind {self.name} needs config.layer_id")

    @property
    def url(self) -> str:
        return f"{str(self.config['service_url']).rstrip('/')}/{self.config['layer_id']}/query"

    def where(self, since: date | None) -> str:
        clauses = [str(self.config.get("where") or "1=1")]
        if since and self.config.get("date_field"):
            clauses.append(f"{self.config['date_field']} >= DATE '{since.isoformat()}'")
        return " AND ".join(clauses)

    def params(self, since: date | None, page: int, limit: int | None = None) -> dict[str, str]:
        out = {"where": self.where(since), "outFields": "*", "f": "json", "returnGeometry": "true", "outSR": "4326", "resultOffset": str(page * self.page_size), "resultRecordCount": str(self.page_size)}
        if self.config.get("date_field"):
            out["orderByFields"] = f"{self.config['date_field']} ASC"
        return out

    def date_of(self, value: Column) -> Column:
        return dates.epoch_millis_to_date(value)

    def stored_rows(self, spark: SparkSession, path: str) -> DataFrame:
        """Pages in the order of their file names, up to the first that is empty, or short without more to come; an error page fails."""
        pages = spark.read.schema(self.PAGE).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
        failed = F.raise_error(F.concat(F.lit(f"{self.locality}: error in a page: "), F.to_json("error"))).cast("array<struct<attributes map<string,string>, geometry struct<x double, y double>>>")
        pages = pages.withColumn("features", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("features")))
        return self.read_pages(pages, "features", F.col("exceededTransferLimit")).select("position", "row.attributes", "row.geometry.x", "row.geometry.y")

    @staticmethod
    def page_rows(payload) -> tuple[list[dict], bool]:
        """The rows of a page as plain dicts, and whether more may follow."""
        if "error" in payload:
            raise RuntimeError(f"error in a page: {payload['error']}")
        rows = [{"attributes": f.get("attributes") or {}, **(f.get("geometry") or {})} for f in payload.get("features") or []]
        return rows, bool(rows) and (bool(payload.get("exceededTransferLimit")) or len(rows) >= ArcGIS.page_size)


class Socrata(Adapter):
    """Row pages: plain objects with ISO dates."""

    name, page_size = "socrata", 1000
    default_map = {
        "permit_number": "permit_number", "permit_type": "permit_type", "description": "description", "applicant_name": "applicant_name_raw", "address": "address",
        "parcel_id": "parcel_id", "valuation": "valuation_usd", "filed_date": "filed_date", "issued_date": "issued_date", "status": "status",
    }

    def validate(self) -> None:
        self._need("domain", "dataset_id")
        if "permit_number" not in self.field_map.values():
            raise ValueError(f"{self.locality}: field_map must map a field to permit_number")

    @property
    def url(self) -> str:
        return f"https://{self.config['domain']}/resource/{self.config['dataset_id']}.json"

    def params(self, since: date | None, page: int, limit: int | None = None) -> dict[str, str]:
        out = {"$limit": str(self.page_size), "$offset": str(page * self.page_size)}
        field = self.config.get("date_field")
        if field:
            out["$order"] = f"{field} ASC"
            if since:
                out["$where"] = f"{field} >= '{since.isoformat()}T00:00:00'"
        return out

    def date_of(self, value: Column) -> Column:
        return dates.iso_date(value)

    def stored_rows(self, spark: SparkSession, path: str) -> DataFrame:
        """Pages in the order of their file names, up to the first short one."""
        pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "array<map<string,string>>").alias("rows"))
        return self.read_pages(pages, "rows", F.lit(False)).select("position", F.col("row").alias("attributes"))

    @staticmethod
    def page_rows(payload) -> tuple[list[dict], bool]:
        return [{"attributes": row} for row in payload], len(payload) >= Socrata.page_size


ADAPTERS: dict[str, type[Adapter]] = {a.name: a for a in (ArcGIS, Socrata)}


def available_adapters() -> list[str]:
    return sorted(ADAPTERS)


def get_adapter(name: str, locality: str, config: dict) -> Adapter:
    if name not in ADAPTERS:
        raise ValueError(f"unknown feed {name!r}; there are {', '.join(available_adapters())}")
    return ADAPTERS[name](locality, config)


class _Pages(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _FeedReader(DataSourceReader):
    def __init__(self, adapter: Adapter, base: str | None, pages: int, since: date | None, limit: int | None = None, ranges: int = 1):
        self.adapter, self.base, self.pages, self.since, self.limit, self.ranges = adapter, base, pages, since, limit, ranges

    def pushFilters(self, filters) -> Iterator:
        """Lower bounds on filed_date go into the request; Spark applies them too."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("filed_date",) and isinstance(f.value, date):
                self.since = max(self.since or f.value, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        each = -(-self.pages // self.ranges)
        return [_Pages(k, min(k + each, self.pages)) for k in range(0, self.pages, each)]

    def _page(self, number: int):
        from urllib.request import urlopen

        url = f"{self.base}/page-{number}.json" if self.base else f"{self.adapter.url}?{urlencode(self.adapter.params(self.since, number, self.limit))}"
        try:
            with urlopen(url, timeout=45) as reply:
                return json.loads(reply.read())
        except OSError as e:
            missing = isinstance(e, FileNotFoundError) or isinstance(getattr(e, "reason", None), FileNotFoundError)
            if self.base and missing:
                return None
            raise

    def read(self, partition: _Pages) -> Iterator[tuple]:
        """A range of pages, one after the other, up to the one after which the feed has no more."""
        for number in range(partition.first, partition.end):
            payload = self._page(number)
            if payload is None:
                return
            rows, more = self.adapter.page_rows(payload)
            for k, row in enumerate(rows):
                if self.limit is not None and number * self.adapter.page_size + k >= self.limit:
                    return
                yield number * (1 << 20) + k, {a: None if v is None else str(v) for a, v in row["attributes"].items()}, row.get("x"), row.get("y")
            if not more:
                return


class PermitFeed(DataSource):
    """``spark.read.format("permit_feed")``: raw rows with their positions in the feed.

    Options: adapter, locality, config (JSON), pages (at most max_pages), base (a URL below
    which pages are stored as page-N.json; without it the feed's own address is asked),
    since (ISO date), limit (rows), ranges (of pages that are read in parallel, 1 unless
    told: a range stops at its first short page, so one range asks for no page too many).
    """

    @classmethod
    def name(cls) -> str:
        return "permit_feed"

    def schema(self) -> str:
        return "position long, attributes map<string,string>, x double, y double"

    def reader(self, schema) -> _FeedReader:
        o = self.options
        adapter = get_adapter(o["adapter"], o["locality"], json.loads(o.get("config", "{}")))
        adapter.validate()
        since = date.fromisoformat(o["since"]) if o.get("since") else None
        limit = int(o["limit"]) if o.get("limit") else None
        pages = min(int(o.get("pages", adapter.max_pages)), adapter.max_pages, *([max(1, -(-limit // adapter.page_size))] if limit is not None else []))
        return _FeedReader(adapter, o.get("base"), pages, since, limit, max(1, int(o.get("ranges", 1))))


def live_records(spark: SparkSession, name: str, locality: str, config: dict, since: date | None = None, pages: int | None = None, base: str | None = None, limit: int | None = None) -> DataFrame:
    """Permit records read through the data source, with each one's position."""
    from plinth.session import workers_find_package

    workers_find_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PermitFeed)
    adapter = get_adapter(name, locality, config)
    adapter.validate()
    options = {"adapter": name, "locality": locality, "config": json.dumps(config), "pages": str(pages or adapter.max_pages)}
    options |= {"since": since.isoformat()} if since else {}
    options |= {"base": base} if base else {}
    options |= {"limit": str(limit)} if limit is not None else {}
    return adapter.records(spark.read.format("permit_feed").options(**options).load())
