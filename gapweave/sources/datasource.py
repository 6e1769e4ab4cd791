"""Text formats as Spark data sources: ``register(spark)``, then ``spark.read.format("core_alleles").load(path)``.

A source plans partitions by ranges of bytes, reads the lines that begin in its range, and takes the filters on positions that Spark
pushes to it.  Files are opened by Arrow's file systems, so paths may lie in any store that these reach.  The classes
go to the workers by value, so executors need not have this package."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a range unless the option ``bytes`` says otherwise, and bytes read at once.
RANGE, BUFFER = 64 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder by name, without those that begin with a dot or underscore."""
    from pyarrow import fs

    store, inner = _store(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else path.split(":", 1)[0] + "://"
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def lines_in(path: str, start: int, end: int) -> Iterator[str]:
    """The lines that begin within a range of bytes."""
    store, inner = _store(path)
    with store.open_input_file(inner) as f:
        at, rest = start, b""
        if start:
            # A line begins behind a line end; the byte before the range may be one.
            f.seek(start - 1)
            at, skipping = start - 1, True
        else:
            skipping = False
        while True:
            block = f.read(BUFFER)
            if not block:
                break
            rest += block
            if skipping:
                cut = rest.find(b"\n")
                if cut < 0:
                    at += len(rest)
                    rest = b""
                    continue
                at, rest, skipping = at + cut + 1, rest[cut + 1 :], False
            *whole, rest = rest.split(b"\n")
            for line in whole:
                if at >= end:
                    return
                yield line.decode("utf-8", "replace").rstrip("\r")
                at += len(line) + 1
            if at >= end:
                return
        if rest and not skipping and at < end:
            yield rest.decode("utf-8", "replace").rstrip("\r")


class Reader(DataSourceReader):
    """Reads lines of the given source; ``low`` and ``high`` bound the positions that are wanted."""

    def __init__(self, source: LineSource):
        self.path, self.parse = source.options["path"], source.parser()
        self.bytes = int(source.options.get("bytes", RANGE))
        self.low, self.high = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of ``pos`` with a number; Spark keeps the others."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("pos",) or not isinstance(value, int):
                yield f
            elif isinstance(f, EqualTo):
                self._bound(value, value)
            elif isinstance(f, GreaterThanOrEqual):
                self._bound(value, None)
            elif isinstance(f, GreaterThan):
                self._bound(value + 1, None)
            elif isinstance(f, LessThanOrEqual):
                self._bound(None, value)
            elif isinstance(f, LessThan):
                self._bound(None, value - 1)
            else:
                yield f

    def _bound(self, low, high) -> None:
        self.low = low if self.low is None else self.low if low is None else max(low, self.low)
        self.high = high if self.high is None else self.high if high is None else min(high, self.high)

    def partitions(self) -> list[Range]:
        return [Range(p, at, min(at + self.bytes, size)) for p, size in files(self.path) for at in range(0, size, self.bytes)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for line in lines_in(partition.path, partition.start, partition.end):
            yield from self.parse(line.split("\t"), self.low, self.high)


class LineSource(DataSource):
    """A format of lines cut by tabs: its schema, and a function (fields, low, high) -> rows."""

    def reader(self, schema) -> Reader:
        return Reader(self)

    def parser(self):
        raise NotImplementedError


def _position(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() else None


@dataclass
class CoreRows:
    samples: list[str]

    def __call__(self, f: list[str], low, high):
        if len(f) < 4 or f[0] == "CHR":
            return
        p = _position(f[1])
        if not p or (low is not None and p - 1 < low) or (high is not None and p - 1 > high):
            return
        for i, (sample, allele) in enumerate(zip(self.samples, f[3:], strict=False)):
            yield f[0], p - 1, f[2], sample, allele, i


@dataclass
class DepthRows:
    def __call__(self, f: list[str], low, high):
        if len(f) < 3:
            return
        p, d = _position(f[1]), _position(f[2])
        if p is not None and d is not None and (low is None or p >= low) and (high is None or p <= high):
            yield f[0], p, d


class CoreAlleles(LineSource):
    """Core-allele tables: (chrom, pos 0-based, ref, sample, allele, i) with i the column."""

    @classmethod
    def name(cls) -> str:
        return "core_alleles"

    def schema(self) -> str:
        return "chrom string, pos long, ref string, sample string, allele string, i int"

    def parser(self) -> CoreRows:
        path, size = files(self.options["path"])[0]
        head = next(lines_in(path, 0, max(1, size)), "")
        if not head.startswith("CHR\t"):
            raise ValueError(f"{path} has no CHR header parted by tabs")
        names = head.split("\t")[3:]
        while any(x.endswith("_snippy") for x in names):
            names = [x.removesuffix("_snippy") for x in names]
        return CoreRows(names)


class DepthText(LineSource):
    """Depth lines: (contig, pos 1-based, depth)."""

    @classmethod
    def name(cls) -> str:
        return "depth_text"

    def schema(self) -> str:
        return "contig string, pos long, depth long"

    def parser(self) -> DepthRows:
        return DepthRows()


#: The formats by name; further ones are added here or registered with Spark directly.
FORMATS: dict[str, type[LineSource]] = {x.name(): x for x in (CoreAlleles, DepthText)}


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session; filters are pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    for kind in FORMATS.values():
        spark.dataSource.register(kind)
