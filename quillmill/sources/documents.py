"""Documents as a partitioned data source: pages are extracted where and when a query wants them.

    register(spark)
    spark.read.format("quillmill_pages").option("path", folder).option("extract", "package.module:function").load()

`extract` names a function that opens a document: function(content) gives a sequence whose length is the
number of pages and whose items are their texts; an item is worked out when it is asked for. A file is read
by as many tasks as its size is worth, each of which takes its stripes of pages, so no page count is needed
to plan. Conditions on path and page_no are pushed down: files are left out of the plan, stripes that hold
none of the pages aren't read, and only the pages that are asked for are extracted.

What can't be read is data: a document that can't be opened gives one row, page 0, with the error (its kind
first: Damaged, PasswordNeeded, ...), a page that can't be extracted gives its own row with one.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as filesystems
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from .readers import BINARY, fault_of, suffix

PAGES = "path string, page_no int, native string, error string"
#: Pages of a stripe, and bytes of a file for each task that reads it.
STRIPE, TASK_BYTES, MOST_TASKS = 16, 32 << 20, 64


@dataclass
class Share(D.InputPartition):
    """A task's part of a file: stripes number, number + of, number + 2 * of, ..."""

    path: str
    number: int
    of: int

    def __post_init__(self):
        super().__init__(self.number)


@dataclass
class Wanted:
    """Which pages conditions leave: the range that they span, and the pages listed, if any are."""

    first: int = 0
    last: int = 1 << 31
    listed: frozenset[int] | None = None

    def has(self, page: int) -> bool:
        return self.first <= page <= self.last and (self.listed is None or page in self.listed)

    def narrowed(self, f: D.Filter) -> Wanted | None:
        """With one more condition; None if it isn't of a kind that is understood."""
        match f:
            case D.EqualTo(_, int(v)):
                return Wanted(max(self.first, v), min(self.last, v), self.listed)
            case D.In(_, values) if all(isinstance(v, int) for v in values):
                return Wanted(self.first, self.last, frozenset(values) & self.listed if self.listed is not None else frozenset(values))
            case D.GreaterThan(_, int(v)):
                return Wanted(max(self.first, v + 1), self.last, self.listed)
            case D.GreaterThanOrEqual(_, int(v)):
                return Wanted(max(self.first, v), self.last, self.listed)
            case D.LessThan(_, int(v)):
                return Wanted(self.first, min(self.last, v - 1), self.listed)
            case D.LessThanOrEqual(_, int(v)):
                return Wanted(self.first, min(self.last, v), self.listed)
        return None


class PageReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.where, self.extract = options["path"], options["extract"]
        self.stripe, self.task_bytes = int(options.get("stripe", STRIPE)), int(options.get("taskbytes", TASK_BYTES))
        self.wanted, self.paths = Wanted(), None

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            name = getattr(f, "attribute", ())
            if name == ("page_no",) and (narrowed := self.wanted.narrowed(f)) is not None:
                self.wanted = narrowed
            elif name == ("path",) and isinstance(f, (D.EqualTo, D.In)):
                values = frozenset([f.value] if isinstance(f, D.EqualTo) else f.value)
                self.paths = values if self.paths is None else self.paths & values
            else:
                yield f

    def partitions(self) -> list[Share]:
        found, root = filesystems.FileSystem.from_uri(self.where)
        info = found.get_file_info(root)
        files = [info] if info.is_file else found.get_file_info(filesystems.FileSelector(root, recursive=True))
        out = []
        for f in sorted((f for f in files if f.is_file and suffix(f.path) in BINARY), key=lambda f: f.path):
            if self.paths is None or f.path in self.paths:
                n = min(MOST_TASKS, max(1, -(-f.size // self.task_bytes)))
                # page 0 tells of a file that can't be opened; the first task has it
                out += [Share(f.path, k, n) for k in range(n) if self._any(k, n)]
        return out or [Share("", 0, 1)]

    def _any(self, k: int, n: int) -> bool:
        """Whether a task has any stripe with pages that are wanted."""
        w = self.wanted
        if w.first > w.last or w.listed is not None and not w.listed:
            return False
        pages = [p for p in w.listed if w.has(p)] if w.listed is not None else range(w.first, min(w.last, w.first + n * self.stripe) + 1)
        return any((max(p, 1) - 1) // self.stripe % n == k for p in pages)

    def read(self, share: Share) -> Iterator[tuple]:
        if not share.path:
            return
        module, _, name = self.extract.partition(":")
        found, _ = filesystems.FileSystem.from_uri(self.where)
        try:
            with found.open_input_file(share.path) as f:
                content = f.read()
            if wrong := fault_of(share.path, content):
                raise wrong
            pages = getattr(importlib.import_module(module), name)(content)
            count = len(pages)
        except Exception as e:  # of any parser; kept as data
            if share.number == 0 and self.wanted.has(0):
                yield share.path, 0, None, f"{type(e).__name__}: {e}"
            return
        for stripe in range(share.number, -(-count // self.stripe), share.of):
            for page in range(stripe * self.stripe + 1, min(count, (stripe + 1) * self.stripe) + 1):
                if self.wanted.has(page):
                    try:
                        yield share.path, page, pages[page - 1], None
                    except Exception as e:  # one page's fault leaves the others
                        yield share.path, page, None, f"{type(e).__name__}: {e}"


class PageSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillmill_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PageReader:
        return PageReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the sources and sinks of this package known to a session."""
    from .archives import ArchiveSink

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    spark.dataSource.register(ArchiveSink)
