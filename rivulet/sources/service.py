"""A service of books as a Spark data source (S12, S14): ``spark.read.format("book_service").option("url", ...)``, and the same for streams.

The service lists its books at ``/allbooks`` and gives the records of one at ``/<bookId>``. A book is a partition; filters on book_id, book, translator and volume are pushed to the
list, so that only the books asked for are fetched. A stream's offset is the number of books listed so far: new books are appended to the list, and a restart goes on behind the last
committed one. Pushing filters needs ``spark.sql.python.filterPushdown.enabled``.

Options: url; least, characters that both texts must have (15); tries (3) and wait (seconds, doubled each time) for failed requests, where the service's own Retry-After wins;
timeout (seconds). A book that can't be fetched gives one row with its error and no texts; a list that can't be fetched fails the read.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "book_id string, book string, volume int, translator string, hadith_id string, ar string, en string, matn_ar string, sanad_ar string, chapter string, category string, url string, error string"
#: Columns of a book, by which partitions are pruned.
OF_BOOK = ("book_id", "book", "volume", "translator")


class Service:
    """Requests with retries. It holds options only, so it goes to tasks."""

    def __init__(self, options):
        self.base = options.get("url", "").rstrip("/")
        if not self.base:
            raise ValueError("set the option url")
        self.least, self.tries = int(options.get("least", 15)), int(options.get("tries", 3))
        self.wait, self.timeout = float(options.get("wait", 0.5)), float(options.get("timeout", 120))

    def get(self, path: str):
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(f"{self.base}/{urllib.parse.quote(path)}", timeout=self.timeout) as r:
                    return json.loads(r.read())
            except (OSError, ValueError) as e:  # of the network, of HTTP, or a reply that is no JSON
                if attempt + 1 == self.tries or (isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code != 429):
                    raise
                after = e.headers.get("Retry-After") if isinstance(e, urllib.error.HTTPError) else None
                time.sleep(float(after) if after and after.replace(".", "", 1).isdigit() else self.wait * 2**attempt)

    def books(self) -> list[dict]:
        found = self.get("allbooks")
        return [{"book_id": str(b["bookId"]), "book": b.get("BookName") or str(b["bookId"]), "volume": int(b.get("volume") or 1), "translator": b.get("translator") or ""} for b in found]

    def records(self, book: dict) -> Iterator[tuple]:
        head = (book["book_id"], book["book"], book["volume"], book["translator"])
        try:
            found = self.get(book["book_id"])
        except (OSError, ValueError) as e:
            yield (*head, *[None] * 8, f"{type(e).__name__}: {e}")
            return
        text = lambda r, k: (r.get(k) or "").strip()
        for r in found if isinstance(found, list) else []:
            ar, en = text(r, "arabicText"), text(r, "englishText")
            if len(ar) >= self.least and len(en) >= self.least:
                number = r.get("id")
                yield (*head, None if number is None else str(number), ar, en, text(r, "thaqalaynMatn"), text(r, "thaqalaynSanad"), r.get("chapter") or "", r.get("category") or "", r.get("URL") or "", None)


class Book(InputPartition):
    def __init__(self, book: dict):
        super().__init__(book["book_id"])
        self.book = book


class BookReader(DataSourceReader):
    def __init__(self, service: Service):
        self.service, self.wanted = service, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in OF_BOOK:
                self.wanted.append((column, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f  # Spark applies it

    def partitions(self) -> list[Book]:
        return [Book(b) for b in self.service.books() if all(b[c] in values for c, values in self.wanted)]

    def read(self, partition: Book) -> Iterator[tuple]:
        return self.service.records(partition.book) if partition is not None else iter(())


class BookStream(DataSourceStreamReader):
    def __init__(self, service: Service):
        self.service = service

    def initialOffset(self) -> dict:
        return {"books": 0}

    def latestOffset(self) -> dict:
        return {"books": len(self.service.books())}

    def partitions(self, start: dict, end: dict) -> list[Book]:
        return [Book(b) for b in self.service.books()[start["books"] : end["books"]]]

    def read(self, partition: Book) -> Iterator[tuple]:
        return self.service.records(partition.book)

    def commit(self, end: dict) -> None:
        """Spark's checkpoint holds the offset."""


class BookService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "book_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BookReader:
        return BookReader(Service(self.options))

    def streamReader(self, schema) -> BookStream:
        return BookStream(Service(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BookService)
