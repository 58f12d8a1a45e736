"""Provider pages as a data source: filters and lookups pushed to the scan, and a stream that resumes at its cursor.

A provider's answer is a chain of pages, each with the cursor of the next. ``write_pages`` lays records out in that form, with an
index that holds the chain and, for every page, the extent of its ids and years, the types, DOI prefixes and open-access flags on it.
The reader takes filters on these columns from the plan, leaves out pages that cannot match without opening them, and applies the
filters to the records of the others, so Spark has no filter left to run. The stream's offsets are cursors.

Executors open pages as files, so the folder must be one that they all see as such (``file://`` or a mounted path).
"""

from __future__ import annotations

import glob
import json
import operator
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

RECORD = "id string, doi string, title string, year int, type string, is_open_access boolean"
FIRST, LAST = "*", ""
_COMPARED: dict[type, Callable] = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"pages are opened as files; {path} is not a path of the file system")
    return path.removeprefix("file://").removeprefix("file:")


def cursor(page: int) -> str:
    return f"c{page:09d}"


def write_pages(records: DataFrame, path: str, page: str = "page") -> None:
    """Lay out records (id, doi, title, year, type, is_open_access) with their page numbers as pages and an index of them.

    Rows of one page go to one file; a null page is not written. Pages are expected to be of a bounded size, 200 records, say.
    """
    records = records.where(F.col(page).isNotNull())
    kept = records.select(F.col(page).cast("int").alias("page"), "id", "doi", "title", "year", "type", "is_open_access")
    kept.repartition("page").write.mode("overwrite").partitionBy("page").json(f"{path}/pages")
    prefix = F.split_part("doi", F.lit("/"), F.lit(1))
    index = kept.groupBy("page").agg(
        F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.min("year").alias("low_year"), F.max("year").alias("high_year"), F.collect_set("type").alias("types"), F.collect_set(prefix).alias("prefixes"), F.collect_set("is_open_access").alias("open"), F.count("*").alias("n")
    )
    index.write.mode("overwrite").json(f"{path}/index")


def index_of(path: str) -> list[dict]:
    """The index's entries in order of page, each with its cursor and that of the next."""
    rows = []
    for name in glob.glob(f"{local(path)}/index/part-*"):
        with open(name, encoding="utf-8") as f:
            rows += [json.loads(line) for line in f]
    rows.sort(key=lambda r: r["page"])
    for k, r in enumerate(rows):
        r["cursor"], r["next"] = cursor(r["page"]), cursor(rows[k + 1]["page"]) if k + 1 < len(rows) else LAST
    return rows


@dataclass
class Page(InputPartition):
    number: int
    value: int = field(init=False)

    def __post_init__(self) -> None:
        self.value = self.number


def records_of(path: str, page: int, names: list[str], wanted: list[Filter]) -> Iterator[tuple]:
    for name in sorted(glob.glob(f"{local(path)}/pages/page={page}/part-*")):
        with open(name, encoding="utf-8") as f:
            for line in f:
                row = json.loads(line)
                if all(holds(w, row) for w in wanted):
                    yield tuple(row.get(n) for n in names)


def holds(wanted: Filter, row: dict) -> bool:
    """Whether a record passes a filter; as in SQL, a null passes none."""
    value = row.get(wanted.attribute[0])
    if value is None:
        return False
    if isinstance(wanted, In):
        return value in wanted.value
    if isinstance(wanted, StringStartsWith):
        return value.startswith(wanted.value)
    return isinstance(wanted, IsNotNull) or _COMPARED[type(wanted)](value, wanted.value)


def possible(wanted: Filter, entry: dict) -> bool:
    """Whether a page can hold a record that passes a filter, by the index alone."""
    name = wanted.attribute[0]
    if name in ("id", "year"):
        low, high = entry.get(f"low_{name}"), entry.get(f"high_{name}")
        if low is None:
            return False
        if isinstance(wanted, EqualTo):
            return low <= wanted.value <= high
        if isinstance(wanted, In):
            return any(v is not None and low <= v <= high for v in wanted.value)
        if isinstance(wanted, (GreaterThan, GreaterThanOrEqual)):
            return _COMPARED[type(wanted)](high, wanted.value)
        if isinstance(wanted, (LessThan, LessThanOrEqual)):
            return _COMPARED[type(wanted)](low, wanted.value)
        return not isinstance(wanted, StringStartsWith) or (low[: len(wanted.value)] <= wanted.value <= high)
    if name == "doi":
        asked = wanted.value.split("/")[0] if isinstance(wanted, (EqualTo, StringStartsWith)) else ""
        whole = isinstance(wanted, EqualTo) or (isinstance(wanted, StringStartsWith) and "/" in wanted.value)
        return any(p == asked if whole else p.startswith(asked) for p in entry["prefixes"]) if isinstance(wanted, (EqualTo, StringStartsWith)) else bool(entry["prefixes"])
    found = entry["types"] if name == "type" else entry["open"] if name == "is_open_access" else None
    if found is None:
        return True
    return any(holds(wanted, {name: v}) for v in found)


def supported(wanted: Filter) -> bool:
    """Filters on a column of the record that compare it with constants that are not null."""
    if getattr(wanted, "attribute", ()) not in ((n,) for n in ("id", "doi", "title", "year", "type", "is_open_access")):
        return False
    if isinstance(wanted, IsNotNull):
        return True
    if isinstance(wanted, In):
        return all(v is not None for v in wanted.value)
    return isinstance(wanted, (*_COMPARED, StringStartsWith)) and wanted.value is not None


class ProviderPages(DataSource):
    """Format ``provider_pages``: option ``path``, the folder of ``write_pages``; option ``record``, the columns to read."""

    @classmethod
    def name(cls) -> str:
        return "provider_pages"

    def schema(self) -> str:
        return self.options.get("record", RECORD)

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options["path"], schema.fieldNames())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(self.options["path"], schema.fieldNames())


class PageReader(DataSourceReader):
    """One partition a page that can match."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if supported(one):
                self.wanted.append(one)
            else:
                yield one

    def partitions(self) -> list[InputPartition]:
        return [Page(e["page"]) for e in index_of(self.path) if all(possible(w, e) for w in self.wanted)] or [Page(-1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return records_of(self.path, partition.number, self.names, self.wanted)


class PageStream(DataSourceStreamReader):
    """Pages after a cursor, as they are added; one partition a page."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def initialOffset(self) -> dict:
        return {"cursor": FIRST}

    def latestOffset(self) -> dict:
        entries = index_of(self.path)
        return {"cursor": entries[-1]["cursor"] if entries else FIRST}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after = "" if start["cursor"] == FIRST else start["cursor"]
        return [Page(e["page"]) for e in index_of(self.path) if after < e["cursor"] <= end["cursor"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return records_of(self.path, partition.number, self.names, [])

    def commit(self, end: dict) -> None:
        """Nothing is held between batches."""


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderPages)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder of pages; filters on them reach the scan."""
    register(spark)
    return spark.read.format("provider_pages").option("path", path).load()


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of the pages that come after the query's last cursor."""
    register(spark)
    return spark.readStream.format("provider_pages").option("path", path).load()


def resolve_doi(spark: SparkSession, path: str, doi: str) -> DataFrame:
    """Records of a DOI: pages without its prefix are not opened."""
    return read_pages(spark, path).where(F.col("doi") == doi)


def by_ids(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """Records of some ids: pages whose ids end before or begin after them are not opened."""
    return read_pages(spark, path).where(F.col("id").isin(*ids))


def of_prefix(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Records of a registrant, a preprint server, say, by the prefix of their DOIs."""
    return read_pages(spark, path).where(F.col("doi").startswith(f"{prefix}/"))
