"""Python data sources: delimited files of any dialect, and stored response pages as a table or a stream.

Both list a folder once, on the driver, and read on executors. They open files by Arrow's file systems (local paths and the URIs
that these know); for a store that only Hadoop's file systems reach, tables.read_delimited reads one dialect at a time.
"""

from __future__ import annotations

import csv
import fnmatch
import hashlib
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .tables import sniff_delimiter

#: Bytes of a file that the delimiter is told from; bytes of small files that one partition reads, and what opening a file counts as.
HEAD_BYTES, PARTITION_BYTES, OPEN_BYTES = 4096, 16_000_000, 200_000
#: Rows handed on at once.
BATCH_ROWS = 5_000
#: Most names of columns that a family's headers may have together.
MOST_NAMES = 1_000


def _open(path: str):
    from pyarrow import fs

    at, rest = fs.FileSystem.from_uri(path)
    return at.open_input_stream(rest)


def _listing(folder: str, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder whose names fit, by path; names that begin with _ or a dot are hidden, here and on the way."""
    from pyarrow import fs

    at, root = fs.FileSystem.from_uri(folder)
    scheme = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
    if at.get_file_info(root).type == fs.FileType.File:
        return [(folder, at.get_file_info(root).size)]
    found = at.get_file_info(fs.FileSelector(root, recursive=True))
    shown = lambda p: not any(x.startswith(("_", ".")) for x in p[len(root) :].split("/"))
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and shown(f.path) and fnmatch.fnmatchcase(f.base_name, pattern))


@dataclass
class Files(InputPartition):
    paths: list[str]


def _packed(files: list[tuple[str, int]], most: int) -> list[Files]:
    """Small files share a partition, in order."""
    out, size = [], most
    for path, n in files:
        if size + n + OPEN_BYTES > most:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(path)
        size += n + OPEN_BYTES
    return out


_CONVERT = {
    "string": str, "int": int, "bigint": int, "double": float,
    "boolean": lambda v: {"true": True, "false": False}[v.strip().lower()],
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _converted(values: list, kind: str) -> pa.Array:
    """Texts as a column; what is no value of the type is null."""
    if kind != "string":
        convert, most = _CONVERT[kind], {"int": 2**31, "bigint": 2**63}.get(kind)

        def one(v):
            try:
                x = None if v is None else convert(v)
                return None if most and x is not None and not -most <= x < most else x
            except (ValueError, KeyError):
                return None

        values = [one(v) for v in values]
    return pa.array(values, _ARROW[kind])


def header_of(head: str) -> tuple[str, list[str]]:
    """The delimiter and the normalized names of a file's first line; where one name comes out, other delimiters are tried."""
    first = sniff_delimiter(head)
    names: list[str] = []
    for d in dict.fromkeys([first, *";\t|,"]):
        tried = [c.strip().lstrip("﻿").lower() for c in next(csv.reader(io.StringIO(head, newline=""), delimiter=d), [])]
        names = names or tried
        if len(tried) > 1:
            return d, tried
    return first, names


class DelimitedFiles(DataSource):
    """Delimited files with headers below a folder, each in a dialect of its own: delimiter, byte order mark, names in any case and order.

    Options: path; pattern (of file names, default *); required (names that every file must have, else an error that tells the
    file); partitionBytes; pushdown (true to take filters, where spark.sql.python.filterPushdown.enabled is set). A schema of
    string, int, bigint, double and boolean columns takes columns by name; a column that a file lacks, empty values and what is no value of
    the type are null; source_file is the file's name. Without a schema a row is (source_file, line, fields), fields a map. Of equal names in a
    header the first counts; short rows end in nulls, values beyond the header are left out, blank lines and files without a line give no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "delimited_files"

    def schema(self) -> str:
        return "source_file string, line bigint, fields map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PushedReader if self.options.get("pushdown", "").lower() == "true" else DelimitedReader
        return kind(dict(self.options), schema)


class DelimitedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options = {k.lower(): v for k, v in options.items()}
        self.as_map = [f.name for f in schema] == ["source_file", "line", "fields"] and schema["fields"].dataType.typeName() == "map"
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema]
        if not self.as_map and (bad := [k for _, k in self.columns if k not in _ARROW]):
            raise ValueError(f"columns of {sorted(set(bad))}: read texts and cast them")
        self.required = [c.strip().lower() for c in self.options.get("required", "").split(",") if c.strip()]
        self.tests: list[tuple[str, object]] = []

    def partitions(self) -> list[Files]:
        files = _listing(self.options["path"], self.options.get("pattern", "*"))
        if not files:
            raise FileNotFoundError(f"no {self.options.get('pattern', '*')} below {self.options['path']}")
        named = [test for c, test in self.tests if c == "source_file"]
        return _packed([f for f in files if all(test(f[0].rsplit("/", 1)[-1]) for test in named)], int(self.options.get("partitionbytes", PARTITION_BYTES)))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for path in partition.paths:
            yield from self._file(path)

    def _rows(self, path: str) -> Iterator[tuple[list[str], int, list[str]]]:
        """(names, line, values): one file as a stream, so its size does not matter."""
        with _open(path) as stream:
            head = stream.read(HEAD_BYTES).decode("utf-8-sig", "ignore")
        d, names = header_of(head)
        if missing := [c for c in self.required if c not in names]:
            raise ValueError(f"{path}: missing columns {missing}; there are {names}")
        with _open(path) as stream:
            rows = csv.reader(io.TextIOWrapper(stream, "utf-8-sig", "replace", newline=""), delimiter=d)
            next(rows, None)
            for row in rows:
                if row:
                    yield names, rows.line_num, row

    def _file(self, path: str) -> Iterator[pa.RecordBatch]:
        file, held = path.rsplit("/", 1)[-1], []
        places = None
        for names, line, row in self._rows(path):
            if self.as_map:
                held.append((line, [(n, v or None) for n, v in {n: v for n, v in reversed([*zip(names, row)])}.items()][::-1]))
            else:
                if places is None:
                    places = [names.index(c.lower()) if c.lower() in names else -1 for c, _ in self.columns]
                values = [(row[k] or None) if 0 <= k < len(row) else None for k in places]
                if all(test(values[k]) for k, test in self._row_tests()):
                    held.append(values)
            if len(held) >= BATCH_ROWS:
                yield self._batch(file, held)
                held = []
        if held:
            yield self._batch(file, held)

    def _row_tests(self) -> list[tuple[int, object]]:
        names = [c for c, _ in self.columns]
        return [(names.index(c), test) for c, test in self.tests if c != "source_file"]

    def _batch(self, file: str, held: list) -> pa.RecordBatch:
        if self.as_map:
            kind = pa.map_(pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array([x for x, _ in held], pa.int64()), pa.array([x for _, x in held], kind)], ["source_file", "line", "fields"])
        made = [pa.array([file] * len(held), pa.string()) if c == "source_file" else _converted([r[k] for r in held], kind) for k, (c, kind) in enumerate(self.columns)]
        return pa.RecordBatch.from_arrays(made, [c for c, _ in self.columns])


class PushedReader(DelimitedReader):
    """Filters on source_file leave files out, those on texts leave rows out before they become columns; all others stay with Spark."""

    def pushFilters(self, filters):
        if self.as_map:
            return filters
        left, text = [], {c for c, kind in self.columns if kind == "string"}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            test = _test(f) if name in text else None
            if test:
                self.tests.append((name, test))
            else:
                left.append(f)
        return left


@dataclass
class _Test:
    kind: str
    value: object = None

    def __call__(self, v: str | None) -> bool:
        if self.kind == "null":
            return v is None
        if v is None:
            return False
        return {"set": lambda: True, "equal": lambda: v == self.value, "in": lambda: v in self.value, "starts": lambda: v.startswith(self.value), "ends": lambda: v.endswith(self.value), "has": lambda: self.value in v}[self.kind]()


def _test(f) -> _Test | None:
    kinds = {IsNull: "null", IsNotNull: "set", EqualTo: "equal", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}
    kind = kinds.get(type(f))
    return _Test(kind, getattr(f, "value", None)) if kind else None


def read_files(spark: SparkSession, path: str, schema: str | None = None, pattern: str = "*", required: tuple[str, ...] = (), **options) -> DataFrame:
    """Delimited files as a table; see DelimitedFiles. One job, whatever the number of files and dialects."""
    spark.dataSource.register(DelimitedFiles)
    pushed = (spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") or "false").lower()
    reader = spark.read.format("delimited_files").option("path", path).option("pattern", pattern).option("required", ",".join(required)).option("pushdown", pushed).options(**options)
    return (reader.schema(schema) if schema else reader).load()


def read_family(spark: SparkSession, path: str, pattern: str = "cleaned_*.csv", most: int = MOST_NAMES) -> DataFrame:
    """All files of a pattern below a folder as one table of texts, their columns together by name, with source_file. Names are
    gathered by one pass over the files; more than `most` of them are an error."""
    raw = read_files(spark, path, pattern=pattern)
    names = [r[0] for r in raw.select(F.explode(F.map_keys("fields")).alias("name")).distinct().orderBy("name").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} columns in {path}")
    quoted = [f"`{n.replace('`', '``')}` string" for n in names if n and n != "source_file"]
    return read_files(spark, path, ", ".join([*quoted, "source_file string"]), pattern)


# Stored response pages


@dataclass
class Page(InputPartition):
    path: str
    page: int
    take: int | None


@dataclass
class Pages(InputPartition):
    """Pages that follow one another, the first of them with its number."""

    paths: list[str]
    first: int


def _text(node, tag: str) -> str | None:
    found = next((c for c in node if c.tag.rsplit("}", 1)[-1] == tag), None)
    return None if found is None else "".join(found.itertext())


def _flat(v) -> str | None:
    return None if v is None else re.sub(r"\s+", " ", str(v)).strip()


def items_of(data: bytes) -> list[dict]:
    """The items of one response: Atom entries, a JSON list, {items: []}, a listing {data: {children: [{data: {}}]}} with comments in
    its second part, or an article query {query: {pages: {}}}. A response that is none of these, or broken, has none."""
    head = data.lstrip()[:1]
    try:
        if head == b"<":
            root = ElementTree.fromstring(data)
            found = [e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "entry"]
            return [{"id": _flat(_text(e, "id")), "title": _flat(_text(e, "title")), "text": _flat(_text(e, "summary")), "published": _flat(_text(e, "published"))} for e in found]
        made = json.loads(data)
    except (ElementTree.ParseError, ValueError):
        return []
    if isinstance(made, list) and made and isinstance(made[-1], dict) and isinstance(made[-1].get("data"), dict):
        made = made[-1]  # a post and its comments
    if isinstance(made, dict):
        if isinstance(made.get("query"), dict):
            made = [p for p in made["query"].get("pages", {}).values() if "missing" not in p]
        elif isinstance(made.get("data"), dict):
            made = [c.get("data", {}) for c in made["data"].get("children", [])]
        else:
            made = made.get("items", [])
    pick = lambda d, *names: next((d[n] for n in names if d.get(n) is not None), None)
    return [
        {"id": pick(d, "id", "pageid"), "title": _flat(pick(d, "title")), "text": pick(d, "text", "body", "selftext", "extract", "summary"), "published": pick(d, "published", "created_utc"), "score": pick(d, "score")}
        for d in made if isinstance(d, dict)
    ]


class StoredPages(DataSource):
    """Stored responses of a paged service below a folder, a page a file in the order of the numbers in their paths, read until enough items are kept.

    Options: path; pattern; target (stop when so many items are kept; 0: never); until (last day of publication), leastWords,
    leastScore: what an item must have to be kept. A page without any item ends the feed, as the service would have said that there is no more.
    Pages are counted one after another where the table is planned, as a client has to that stops at a target; their items are read by a task a page.
    Without a target a table's pages are read by tasks that share small ones, and none is read where it is planned; the option ends (true) gives
    instead a row for each page without items, of which read_pages takes the first as the end.
    As a stream, pages that arrive later go on from where the offset stands, also after a restart.
    """

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return "page bigint, place bigint, id string, title string, text string, published string, score double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageStream(dict(self.options))


class Paging:
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.pattern = o["path"], o.get("pattern", "*")
        self.target = int(o.get("target", 0))
        self.until, self.words = o.get("until"), int(o.get("leastwords", 0))
        self.score = float(o["leastscore"]) if "leastscore" in o else None
        self.ends = o.get("ends", "").lower() == "true"
        self.counts: list[int] = []

    def sized(self) -> list[tuple[str, int]]:
        number = lambda f: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", f[0])]
        return sorted(_listing(self.path, self.pattern), key=number)

    def pages(self) -> list[str]:
        return [p for p, _ in self.sized()]

    def items(self, path: str) -> list[dict]:
        with _open(path) as stream:
            return items_of(stream.read())

    def keeps(self, item: dict) -> bool:
        day = str(item.get("published") or "")[:10]
        return (
            item.get("text") is not None and (not self.until or bool(day) and day <= self.until) and len(str(item["text"]).split()) >= self.words
            and (self.score is None or float(item.get("score") or 0) > self.score)
        )

    def plan(self) -> list[Page]:
        """The pages up to the target, with how many items to take of each; counts of pages seen before are kept."""
        out, kept = [], 0
        for k, path in enumerate(self.pages()):
            if self.target and kept >= self.target:
                break
            if k == len(self.counts):
                items = self.items(path)
                self.counts.append(sum(map(self.keeps, items)) if items else -1)
            n = self.counts[k]
            if n < 0:
                break
            take = min(n, self.target - kept) if self.target else n
            out.append(Page(path, k, take))
            kept += take
        return out

    def whole(self) -> list[Pages]:
        """All pages, small ones together."""
        files = self.sized()
        first, out = 0, []
        for part in _packed(files, PARTITION_BYTES):
            out.append(Pages(part.paths, first))
            first += len(part.paths)
        return out

    def rows(self, page: Page) -> Iterator[tuple]:
        items = self.items(page.path)
        if self.ends:
            if not items:
                yield page.page, None, None, None, None, None, None
            return
        kept = [(k, x) for k, x in enumerate(items) if self.keeps(x)][: page.take]
        text = lambda v: None if v is None else str(v)
        for k, x in kept:
            score = x.get("score")
            yield page.page, k, text(x.get("id")), text(x.get("title")), text(x.get("text")), text(x.get("published")), None if score is None else float(score)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paging = Paging(options)

    def partitions(self) -> list[Page] | list[Pages]:
        return (self.paging.plan() if self.paging.target else self.paging.whole()) or [Page("", 0, 0)]

    def read(self, partition: Page | Pages) -> Iterator[tuple]:
        if isinstance(partition, Pages):
            return (row for k, path in enumerate(partition.paths) for row in self.paging.rows(Page(path, partition.first + k, None)))
        return self.paging.rows(partition) if partition.take else iter(())


class PageStream(DataSourceStreamReader):
    """The offset is a number of pages. A page's place never changes, so batches that are planned again read the same."""

    def __init__(self, options: dict):
        self.paging = Paging(options)

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(self.paging.plan())}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.paging.plan()[start["pages"] : end["pages"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.paging.rows(partition) if partition.take else iter(())


def _paged(spark: SparkSession, reader, path: str, target: int, until: str | None, least_words: int, least_score: float | None, pattern: str, ends: str | None = None) -> DataFrame:
    spark.dataSource.register(StoredPages)
    given = {"ends": ends, "path": path, "pattern": pattern, "target": target, "leastWords": least_words, "until": until, "leastScore": least_score}
    return reader.format("stored_pages").options(**{k: v for k, v in given.items() if v is not None}).load()


def read_pages(spark: SparkSession, path: str, target: int = 0, until: str | None = None, least_words: int = 0, least_score: float | None = None, pattern: str = "*") -> DataFrame:
    """Items of stored response pages; see StoredPages. Without a target the pages are read in parallel, twice, as the first one without items,
    which ends the feed, must be known."""
    found = _paged(spark, spark.read, path, target, until, least_words, least_score, pattern)
    if target:
        return found
    ends = _paged(spark, spark.read, path, 0, None, 0, None, pattern, ends="true").agg(F.min("page").alias("__end"))
    return found.crossJoin(F.broadcast(ends)).where("__end is null or page < __end").drop("__end")


def stream_pages(spark: SparkSession, path: str, target: int = 0, until: str | None = None, least_words: int = 0, least_score: float | None = None, pattern: str = "*") -> DataFrame:
    """The same as a stream."""
    return _paged(spark, spark.readStream, path, target, until, least_words, least_score, pattern)


# Digests of whole files


class FileDigests(DataSource):
    """(path, bytes, sha256) of the files below a folder: a partition a file, read in blocks, so files may be of any size.

    Options: path; pattern. Files whose names begin with _ or a dot are hidden."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes bigint, sha256 string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DigestReader(dict(self.options))


class DigestReader(DataSourceReader):
    BLOCK = 1 << 20

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Files]:
        # small files share a partition, a large one has its own
        return _packed(_listing(self.options["path"], self.options.get("pattern", "*")), PARTITION_BYTES) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            digest, n = hashlib.sha256(), 0
            with _open(path) as stream:
                while block := stream.read(self.BLOCK):
                    digest.update(block)
                    n += len(block)
            yield path, n, digest.hexdigest()


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The digests of files of any size; see FileDigests."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").option("path", path).option("pattern", pattern).load()
