"""Result pages of a search service as a data source: one partition for each cached page."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evidex.sources.records import RECORD

PAGE = f"file string, query string, start int, pos int, rec struct<{RECORD.replace(' ', ':').replace(',:', ',')}>"
_LISTS = {"authors": ("name", "sequence"), "publications": ("publicationDate", "issuePublicationDate", "doi"), "downloads": ("mimetype", "link")}
_FIELDS = ("id", "title", "abstract", "center", "stiType")


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _page(path: str, file: str) -> dict:
    """A page: {"query", "from", "response": {"results": [...], "stats": {"total"}}}."""
    fs, _ = _open(path)
    with fs.open_input_stream(file) as f:
        return json.loads(f.read())


def _record(raw: dict) -> tuple:
    """A record's fields in the order of RECORD; ids are texts, whatever they were."""
    text = lambda v: None if v is None else str(v)
    return (*(text(raw.get(f)) for f in _FIELDS), *(None if raw.get(name) is None else [tuple(x.get(f) for f in fields) for x in raw[name]] for name, fields in _LISTS.items()))


class Page(InputPartition):
    def __init__(self, file: str, most: int | None):
        self.file, self.most = file, most


#: Where a page's query and offset stand in its path: "slug__from00100.json", or "slug=.../start=100/....json" as Spark writes it.
_PLACE = re.compile(r"([^/]+?)(?:__from|/start=)(\d+)(?:/[^/]*)?\.json$")


def slug(query: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", query.lower()).strip("_")


class PageReader(DataSourceReader):
    """Plans the pages of each query in the order of their offsets, as a client would ask for them: up to the total, or the limit.

    Offsets are read from paths, a query's total from its first page: no other page is opened to plan.
    """

    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options["limit"]) if "limit" in options else None
        self.query = slug(options["query"]) if "query" in options else None

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.path)
        by_query: dict[str, list[tuple[int, str]]] = {}
        for info in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)):
            if info.type == pyarrow.fs.FileType.File and (m := _PLACE.search(info.path)):
                by_query.setdefault(m[1].removeprefix("slug="), []).append((int(m[2]), info.path))
        out: list[InputPartition] = []
        for query in sorted(by_query):
            if self.query not in (None, query):
                continue
            pages = sorted(by_query[query])
            total = (_page(self.path, pages[0][1])["response"].get("stats") or {}).get("total", 0)
            end = total if self.limit is None else min(total, pages[0][0] + self.limit)
            out += [Page(file, end - start if self.limit is not None else None) for start, file in pages if start < end]
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        page = _page(self.path, partition.file)
        for pos, raw in enumerate((page["response"].get("results") or [])[: partition.most]):
            yield partition.file, page["query"], int(page["from"]), pos, _record(raw)


class ResultPages(DataSource):
    """``spark.read.format("result_pages").load(folder)``; options ``limit``: records of each query at most, ``query``: that one's pages only."""

    @classmethod
    def name(cls) -> str:
        return "result_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


def read_result_pages(spark: SparkSession, path: str, limit: int | None = None, query: str | None = None) -> DataFrame:
    """(file, query, start, pos, rec) of every record of the pages cached below a folder that all executors see."""
    spark.dataSource.register(ResultPages)
    options = {k: str(v) for k, v in (("limit", limit), ("query", query)) if v is not None}
    return spark.read.format("result_pages").options(path=path, **options).load()
