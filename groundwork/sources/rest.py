"""A paged literature service as a Spark data source.

One partition keeps the service's request gap, whatever the cluster's size. What answers requests is a transport named by
`module:function`, so that fixtures and recorded answers serve as well as a network.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GAP_S, RETRIES, BATCH = 0.34, 3, 100
Transport = Callable[[str, dict], tuple[int, str]]


class RequestFailed(RuntimeError):
    """The service refused a request for good."""


class Client:
    """Requests with a gap between them; overload and server errors are tried again after 1, 2, ... seconds."""

    def __init__(self, transport: Transport, gap_s: float = GAP_S, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.transport, self.gap_s, self.retries, self.sleep, self.clock, self.last = transport, gap_s, retries, sleep, clock, None

    def get(self, path: str, parameters: dict) -> str:
        for attempt in range(self.retries):
            if self.last is not None and (left := self.gap_s - (self.clock() - self.last)) > 0:
                self.sleep(left)
            self.last = self.clock()
            status, body = self.transport(path, parameters)
            if status < 400:
                return body
            if status != 429 and status < 500:
                break
            self.sleep(2**attempt)
        raise RequestFailed(f"{path}: status {status}")

    def search(self, query: str, max_pages: int = 1) -> Iterator[str]:
        """Ids in the service's order, until a page is empty or the last."""
        for page in range(1, max_pages + 1):
            body = json.loads(self.get("search", {"text": query, "page": page}))
            found = [str(x["pmid"]) for x in body.get("results", []) if x.get("pmid")]
            yield from found
            if not found or page >= int(body.get("total_pages") or 1):
                return

    def fetch(self, ids: list[str], batch: int = BATCH) -> Iterator[str]:
        """Payloads of ids, a hundred at a time."""
        for at in range(0, len(ids), batch):
            yield self.get("export", {"pmids": ",".join(ids[at : at + batch])})


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.options["transport"].partition(":")
        client = Client(getattr(importlib.import_module(module), name), float(self.options.get("gap_s", GAP_S)))
        if "query" in self.options:
            for i, x in enumerate(client.search(self.options["query"], int(self.options.get("max_pages", 1)))):
                yield (i, x)
        else:
            yield from enumerate(client.fetch([x for x in self.options.get("ids", "").split(",") if x]))


class Literature(DataSource):
    """format("literature"): with option query, ids by position; with option ids, payloads by number."""

    @classmethod
    def name(cls) -> str:
        return "literature"

    def schema(self) -> str:
        return "position int, pmid string" if "query" in self.options else "payload_no int, payload string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def search(spark: SparkSession, transport: str, query: str, max_pages: int = 1, gap_s: float = GAP_S) -> DataFrame:
    spark.dataSource.register(Literature)
    return spark.read.format("literature").options(transport=transport, query=query, max_pages=str(max_pages), gap_s=str(gap_s)).load()


def fetch(spark: SparkSession, transport: str, ids: list[str], gap_s: float = GAP_S) -> DataFrame:
    spark.dataSource.register(Literature)
    return spark.read.format("literature").options(transport=transport, ids=",".join(ids), gap_s=str(gap_s)).load()
