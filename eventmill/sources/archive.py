"""Landed pages in web archive files (S1): many records in one file, WARC 1.1.

`save_archive` writes pages as `response` records, one file per task, and notes a place to
start reading every SPLIT_BYTES or so, always at a record's first byte. `read_archive`
plans its tasks from these places, so one large file is read by many tasks and no task
has to guess from the bytes where a record begins: page text may itself hold archive
records. Archives of other makers, without such notes, are read file by file; those in
`.gz` are unpacked while they are read. Only one record is held in memory at a time.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from eventmill.sources.manifest import (
    Written,
    drop_files,
    drop_manifest,
    manifests,
    new_name,
    open_folder,
    put_manifest,
)

SCHEMA = "page_id long, url string, headers map<string, string>, html string"
SPLIT_BYTES = 128 * 1024 * 1024
#: Records name their page in a field of this library's own.
PAGE_FIELD = "X-Page-Id"
_END = b"\r\n"
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.IGNORECASE)


# -- one record ---------------------------------------------------------------
def _line(text: str) -> str:
    """A field's value: what would end its line is written as in an address."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: int | None, url: str | None, headers: dict | None, html: str | None) -> bytes:
    """A page as a `response` record. No html is the answer 204, which has no content."""
    body = (html or "").encode()
    answer = ["HTTP/1.1 204 No Content" if html is None else "HTTP/1.1 200 OK"]
    given = {k: v for k, v in (headers or {}).items() if v is not None}
    # Text is written as UTF-8 and unpacked, whatever it came as.
    ours = {"content-type", "content-length", "content-encoding", "transfer-encoding"}
    answer += [f"{_line(k)}: {_line(v)}" for k, v in given.items() if k.lower() not in ours]
    if html is not None:
        answer += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    content = "\r\n".join(answer).encode() + _END * 2 + body
    fields = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        fields.append(f"{PAGE_FIELD}: {page_id}")
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(content)}"]
    return "\r\n".join(fields).encode() + _END * 2 + content + _END * 2


def _fields(stream) -> dict[str, str]:
    """Header lines up to the empty one; a line that begins with a blank goes on with its field."""
    found, name = {}, None
    while (line := stream.readline()) not in (b"", b"\r\n", b"\n"):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if name and text[0] in " \t":
            found[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        found[name] = value.removeprefix(" ")
    return found


def _get(fields: dict[str, str], name: str) -> str | None:
    return next((v for k, v in fields.items() if k.lower() == name), None)


def _page(fields: dict[str, str], content: bytes) -> tuple:
    """(page_id, url, headers, html) of a response."""
    stream = io.BytesIO(content)
    status = stream.readline().split()
    headers = _fields(stream)
    body = stream.read()
    if (_get(headers, "content-encoding") or "").lower() in ("gzip", "x-gzip"):
        body = gzip.decompress(body)
    named = _CHARSET.search(_get(headers, "content-type") or "")
    try:
        html = body.decode(named.group(1) if named else "utf-8", "replace")
    except LookupError:  # a charset that nobody knows
        html = body.decode("utf-8", "replace")
    number = _get(fields, PAGE_FIELD.lower())
    empty = len(status) > 1 and status[1] == b"204"
    return int(number) if number else None, _get(fields, "warc-target-uri"), headers, None if empty else html


def read_records(stream, size: int | None = None) -> Iterator[tuple]:
    """Pages of the records that begin within the next `size` bytes; other records are passed over."""
    start = stream.tell()
    while size is None or stream.tell() - start < size:
        first = stream.readline()
        if not first:
            return
        if not first.strip():
            continue  # the blank lines after a record
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no archive record at byte {stream.tell() - len(first)}: {first[:40]!r}")
        fields = _fields(stream)
        length = int(_get(fields, "content-length") or 0)
        content = stream.read(length)
        if len(content) < length:
            raise ValueError(f"archive ends within a record of {length} bytes")
        if _get(fields, "warc-type") == "response":
            yield _page(fields, content)


# -- the data source ------------------------------------------------------------
@dataclass
class Stretch(InputPartition):
    """Bytes of one file that hold whole records; to its end where `size` is None."""

    name: str
    start: int = 0
    size: int | None = None


def stretches(told: dict) -> list[Stretch]:
    """A written file's parts: from each noted place to the next one."""
    ends = [*told["cuts"][1:], told["bytes"]]
    return [Stretch(told["name"], lo, hi - lo) for lo, hi in zip(told["cuts"], ends)]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        noted = manifests(self.path)
        if noted:
            found = [s for told in noted.values() for f in told["files"] for s in stretches(f)]
        else:
            files, root = open_folder(self.path)
            infos = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=False))
            kinds = (".warc", ".warc.gz")
            names = sorted(i.path[len(root) + 1 :] for i in infos if i.is_file and i.base_name.endswith(kinds))
            found = [Stretch(name) for name in names]
        return found or [Stretch("")]  # an empty archive is read by a task without work

    def read(self, partition: Stretch):
        if not partition.name:
            return
        files, root = open_folder(self.path)
        with files.open_input_file(f"{root}/{partition.name}") as raw:
            if partition.name.endswith(".gz"):
                yield from read_records(gzip.GzipFile(fileobj=raw))
                return
            raw.seek(partition.start)
            yield from read_records(io.BufferedReader(raw, 1024 * 1024), partition.size)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, split_bytes: int, overwrite: bool):
        self.path, self.split_bytes, self.overwrite = path, split_bytes, overwrite

    def write(self, iterator) -> Written:
        files, root = open_folder(self.path)
        files.create_dir(root, recursive=True)
        name, at, cuts, n = new_name(".warc"), 0, [], 0
        out = None
        for row in iterator:
            out = out or files.open_output_stream(f"{root}/{name}")
            if not cuts or at - cuts[-1] >= self.split_bytes:
                cuts.append(at)
            record = record_bytes(row["page_id"], row["url"], row["headers"], row["html"])
            out.write(record)
            at, n = at + len(record), n + 1
        if out is None:
            return Written([])
        out.close()
        return Written([{"name": name, "bytes": at, "records": n, "cuts": cuts}])

    def commit(self, messages) -> None:
        earlier = list(manifests(self.path)) if self.overwrite else []
        put_manifest(self.path, uuid.uuid4().hex, {"files": [f for m in messages for f in m.files]})
        for key in earlier:
            drop_manifest(self.path, key)

    def abort(self, messages) -> None:
        drop_files(self.path, messages)


class PageArchive(DataSource):
    """``spark.read.format("page_archive").load(folder)`` and the writer of it."""

    @classmethod
    def name(cls) -> str:
        return "page_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        split = int(self.options.get("splitbytes", SPLIT_BYTES))
        return _Writer(self.options["path"], split, overwrite)


def save_archive(pages: DataFrame, path: str, split_bytes: int = SPLIT_BYTES, mode: str = "append") -> None:
    """Write pages (page_id, url, html and, if there, headers) as archive files.

    Null ids, addresses and texts stay null, and empty texts empty; line ends within an
    address become %0D and %0A; repeated rows stay; other columns are left out.
    """
    spark = pages.sparkSession
    spark.dataSource.register(PageArchive)
    have = "headers" if "headers" in pages.columns else "cast(null as map<string, string>) as headers"
    rows = pages.selectExpr("cast(page_id as long) as page_id", "url", have, "html")
    rows.write.format("page_archive").mode(mode).option("splitBytes", split_bytes).save(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, headers, html) of all responses in a folder of archive files."""
    spark.dataSource.register(PageArchive)
    return spark.read.format("page_archive").load(path)
