"""WARC files: a data source that reads headers first, and a writer."""

from __future__ import annotations

import gzip
import re
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .common import col, fresh, load, shared_dir

#: Files are packed into a partition up to so many bytes.
PARTITION_BYTES = 64 << 20
#: So many bytes of payload make up a batch of rows.
BATCH_BYTES = 4 << 20
#: Bytes read of a packed file at once, and of another, where much may be passed over.
CHUNK, PLAIN = 1 << 16, 1 << 14
#: A longer payload is passed over first, to see that its length is right before it is held.
TRUSTED = 16 << 20

SCHEMA = "file string, offset long, warc_type string, record_id string, target_uri string, date string, content_type string, content_length long, http_status int, http_content_type string, headers map<string,string>, payload string, damaged boolean"
#: Column -> header. These can be judged before a payload is touched.
HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type"}


class WarcPartition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option ``payload`` = ``false`` leaves payloads null.

    Defined results: damaged files give what can be read of them, and no
    error; see :func:`records`. A file that isn't there or can't be opened is one.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))


class WarcReader(DataSourceReader):
    """Predicates on record type and other headers are answered here; others stay with Spark.

    A record's WARC headers are parsed first; if they or the HTTP headers
    don't fit, the payload is skipped by a seek (or, in compressed members,
    inflated without being kept), and never decoded.
    """

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields, self.options = schema.names, options
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = getattr(f, "attribute", (None,))[0]
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and (name in HEADERS or name in ("http_status", "content_length")):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[WarcPartition]:
        fs, root = _fs(self.options["path"])
        found = fs.get_file_info(root)
        files = fs.get_file_info(pa.fs.FileSelector(root, recursive=True)) if found.type == pa.fs.FileType.Directory else [found]
        warcs = sorted((i.size, i.path) for i in files if i.is_file and i.path.endswith((".warc", ".warc.gz")) and not i.base_name.startswith(("_", ".")))
        out: list[WarcPartition] = []
        held, size = [], 0
        most = int(self.options.get("partitionbytes", PARTITION_BYTES))
        for n, path in warcs:
            if held and size + n > most:
                out.append(WarcPartition(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, WarcPartition(held)]

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(self.options["path"])
        want = self.options.get("payload", "true").lower() != "false"
        kinds = {"offset": pa.int64(), "content_length": pa.int64(), "http_status": pa.int32(), "damaged": pa.bool_(), "headers": pa.map_(pa.string(), pa.string())}
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                for row in records(f, path.endswith(".gz"), self.fits, want):
                    row["file"] = path
                    rows.append(row)
                    size += len(row["payload"] or "") + 1000
                    if size > BATCH_BYTES:
                        yield self._batch(rows, kinds)
                        rows, size = [], 0
        yield self._batch(rows, kinds)

    def _batch(self, rows: list[dict], kinds: dict) -> pa.RecordBatch:
        arrays = [pa.array([list(r[n].items()) if n == "headers" else r[n] for r in rows], kinds.get(n, pa.string())) for n in self.fields]
        return pa.RecordBatch.from_arrays(arrays, names=self.fields)

    def fits(self, row: dict, known: tuple[str, ...]) -> bool:
        return all(_holds(f, row) for f in self.filters if f.attribute[0] in known)


def _holds(f: Filter, row: dict) -> bool:
    value = row[f.attribute[0]]
    if value is None:
        return False
    match f:
        case IsNotNull():
            return True
        case EqualTo():
            return value == f.value
        case In():
            return value in f.value
        case StringStartsWith():
            return value.startswith(f.value)
        case StringEndsWith():
            return value.endswith(f.value)
        case StringContains():
            return f.value in value
    raise TypeError(type(f))


FIRST = (*HEADERS, "content_length")


def _head(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:  # a folded line
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            name, value = line.split(b":", 1)
            last = name.strip().decode("latin-1").lower()
            out[last] = value.strip().decode("utf-8", "replace")
    return out


MAGIC = b"\x1f\x8b\x08"
_LENGTH, _STATUS = re.compile("[0-9]{1,18}"), re.compile(b"[0-9]{3}")


class _Tape:
    """The bytes of a file in order, inflated if it is packed.

    What lies between gzip members is passed over. Where one is damaged or
    cut off, what it holds before that is given, then a blank line, and the
    next member is looked for; ``faults`` are the members' begins and the
    places of such lines.
    """

    def __init__(self, f, packed: bool):
        self.f, self.faults = f, []
        head = f.read(5)
        self.packed = head[:2] == MAGIC[:2] or packed and not head.startswith(b"WARC/")
        self.members: deque[tuple[int, int]] = deque()  # where members begin in the file, and in what is given
        self._restart(0, 0)

    def _restart(self, raw: int, at: int) -> None:
        self.f.seek(raw)
        self.buf, self.i, self.base, self.end = b"", 0, at, at
        self.z, self.begun, self.began, self.left, self.left_at = None, at, raw, b"", raw

    def tell(self) -> int:
        return self.base + self.i

    def _next(self) -> bytes:
        if not self.packed:
            out = self.f.read(PLAIN)
            self.end += len(out)
            return out
        while True:
            if self.z is None:
                while (k := self.left.find(MAGIC)) < 0:
                    more = self.f.read(CHUNK)
                    if not more:
                        return b""
                    self.left_at += max(0, len(self.left) - 2)
                    self.left = self.left[-2:] + more
                self.left, self.left_at = self.left[k:], self.left_at + k
                self.z, self.begun, self.began = zlib.decompressobj(31), self.end, self.left_at
                if not self.members or self.members[-1][1] < self.end:
                    self.members.append((self.left_at, self.end))
            last = not self.left and not (more := self.f.read(CHUNK))
            if not self.left and not last:
                self.left = more
            before = self.z.copy()
            try:
                out = self.z.decompress(self.left, CHUNK)
                rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
                bad = last and not out and not self.z.eof
            except zlib.error:
                out, rest, bad = _salvage(before, self.left), b"", True
            self.left_at += len(self.left) - len(rest)
            self.left, eof = rest, self.z.eof
            if bad:  # the next member may begin before the place where this one's fault shows
                self.faults.append((self.begun, self.end + len(out)))
                out += b"\r\n\r\n"
                self.left_at = self.began + len(MAGIC)
                self.f.seek(self.left_at)
            if bad or eof:
                self.z = None
            if out:
                self.end += len(out)
                return out

    def more(self) -> bool:
        got = self._next()
        self.buf, self.base, self.i = self.buf[self.i :] + got, self.base + self.i, 0
        return bool(got)

    def line(self, most: int = CHUNK) -> bytes:
        """Up to a line's end, or so many bytes of a longer one."""
        while (j := self.buf.find(b"\n", self.i, self.i + most)) < 0 and len(self.buf) - self.i < most and self.more():
            pass
        return self._cut(j + 1 if j >= 0 else self.i + most)

    def _cut(self, to: int) -> bytes:
        out = self.buf[self.i : to]
        self.i += len(out)
        return out

    def take(self, n: int, keep: bool) -> bytes:
        """The next ``n`` bytes, or fewer at the end; if they needn't be kept, an unpacked file is only sought through."""
        parts = []
        while n > 0:
            if self.i == len(self.buf):
                if not keep and not self.packed:
                    here = self.tell()
                    self.goto(min(here + n, self.f.seek(0, 2)))
                    break
                if not self.more():
                    break
            got = self._cut(self.i + n)
            n -= len(got)
            if keep:
                parts.append(got)
        return b"".join(parts)

    def goto(self, at: int) -> None:
        """To a place given before: at the current record, or behind."""
        if self.base <= at <= self.base + len(self.buf):
            self.i = at - self.base
        elif not self.packed:
            self._restart(at, at)
        else:
            raw, out = next(m for m in reversed(self.members) if m[1] <= at)
            self._restart(raw, out)
            self.faults = [x for x in self.faults if x[1] < out]
            self.take(at - out, False)

    def forget(self, before: int) -> None:
        while len(self.members) > 1 and self.members[1][1] <= before:
            self.members.popleft()
        self.faults = [x for x in self.faults if x[1] >= before]

    def record_ends(self) -> bool:
        """Whether nothing but line ends lies before the next version line, member or end; they are passed."""
        begin = self.tell()
        while True:
            while len(self.buf) - self.i < 16 and self.more():
                pass
            ahead = self.buf[self.i : self.i + 16]
            self.i += len(ahead) - len(ahead.lstrip(b"\r\n"))
            if not ahead or ahead.strip(b"\r\n"):
                return not ahead or self.buf.startswith(b"WARC/", self.i) or any(begin <= at <= self.tell() for _, at in self.members)

    def next_version(self) -> int:
        """The place of the next version line that follows a blank one, or of the end."""
        blank = False
        while got := self.line():
            if blank and got.startswith(b"WARC/"):
                return self.tell() - len(got)
            blank = not got.strip()
        return self.tell()


def _salvage(z, data: bytes) -> bytes:
    """What can be inflated of damaged data."""
    out, at = b"", 0
    for step in (4096, 64, 1):
        while at < len(data):
            before = z.copy()
            try:
                out += z.decompress(data[at : at + step])
            except zlib.error:
                z = before
                break
            at += step
    return out


def records(f, packed: bool, fits, payload: bool = True) -> Iterator[dict]:
    """The records of an open file that fit.

    Whether the file is packed shows in its first bytes, ``packed`` decides
    where they don't tell. A record is ``damaged`` if its Content-Length
    doesn't lead to the next version line or the end, or if its gzip member
    is broken or cut off. Its payload ends before the next version line that
    follows a blank one, and reading goes on there. Bytes between records or
    members, padding too, are passed over; what has no length isn't a record.
    """
    tape = _Tape(f, packed)
    while got := tape.line():
        if not got.startswith(b"WARC/"):
            continue
        offset = tape.tell() - len(got)
        tape.forget(offset)
        lines = []
        while (got := tape.line()).strip():
            lines.append(got)
        head = _head(lines)
        if not _LENGTH.fullmatch(head.get("content-length", "")):
            continue
        length, begin = int(head["content-length"]), tape.tell()
        row = {name: head.get(h) for name, h in HEADERS.items()} | {"offset": offset, "content_length": length, "http_status": None, "http_content_type": None, "headers": head, "payload": None}
        wanted = fits(row, FIRST)
        if wanted and (row["content_type"] or "").startswith("application/http"):
            http = []
            while (left := begin + length - tape.tell()) > 0 and (got := tape.line(left)).strip():
                http.append(got)
            status = http[0].split() if http else []
            row["http_status"] = int(status[1]) if len(status) > 1 and _STATUS.fullmatch(status[1]) else None
            row["http_content_type"] = _head(http[1:]).get("content-type")
        wanted = wanted and fits(row, ("http_status",))
        inner = tape.tell()
        keep = wanted and payload
        body = tape.take(begin + length - inner, keep and length <= TRUSTED)
        damaged = tape.tell() < begin + length or not tape.record_ends()
        if keep and not damaged and length > TRUSTED:
            ahead = tape.tell()
            tape.goto(inner)
            body = tape.take(begin + length - inner, True)
            tape.goto(ahead)
        if damaged:
            tape.goto(begin)
            ahead = tape.next_version()
            if keep:
                tape.goto(inner)
                body = tape.take(min(begin + length, ahead) - inner, True)
            tape.goto(ahead)
        if wanted:
            row["damaged"] = damaged or any(a < inner + len(body) and offset < b <= tape.tell() for a, b in tape.faults)
            if keep:
                row["payload"] = body.decode("utf-8", "replace")
            yield row


def record(kind: str, uri: str | None, number: str, content_type: str, body: bytes) -> bytes:
    """One WARC record."""
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:depweave:" + number.encode() + b">", b"WARC-Date: 2024-01-01T00:00:00Z"]
    if uri is not None:
        lines.append(b"WARC-Target-URI: " + " ".join(uri.split()).encode())
    lines += [b"Content-Type: " + content_type.encode(), b"Content-Length: " + str(len(body)).encode(), b"", b""]
    return b"\r\n".join(lines) + body + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, compress: bool = True) -> DataFrame:
    """Files (path, n) of the folder ``path`` with ``pages`` (page_id, url, html) as request and response records.

    A task writes one file aside, then moves it to the name of its partition,
    so a lost, repeated or speculative task leaves one whole file. Rows with
    a null html become records of type ``revisit`` without a payload.

    Defined results: a null id or url is null again when read; white space in
    a url becomes one space; null and empty pages differ; repeated rows stand
    twice; pages of any length are one record; extra columns are left out. An
    empty table gives files without pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.warc{'.gz' if compress else ''}"
        aside = f"{root}/_{context.taskAttemptId()}-{name}"
        pack = (lambda r: gzip.compress(r, 1)) if compress else (lambda r: r)
        n = 0
        with fs.open_output_stream(aside, compression=None) as f:
            f.write(pack(record("warcinfo", None, f"info-{context.partitionId()}", "application/warc-fields", b"software: depweave\r\n")))
            for batch in batches:
                for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    number = "" if page is None else str(page)
                    ask = b"GET " + " ".join((url or "").split()).encode() + b" HTTP/1.1\r\n\r\n"
                    f.write(pack(record("request", url, f"{number}-request", "application/http; msgtype=request", ask)))
                    if html is None:
                        f.write(pack(record("revisit", url, number, "application/http; msgtype=response", b"HTTP/1.1 304 Not Modified\r\n\r\n")))
                    else:
                        f.write(pack(record("response", url, number, "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html.encode())))
                    n += 1
        fs.move(aside, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"path": pa.array([f"{root}/{name}"]), "n": pa.array([n], pa.int64())})

    slim = pages.select(col("page_id").alias("page_id"), col("url").cast("string").alias("url"), col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "path string, n long")


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records of the WARC files below ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def pages_of(records_: DataFrame) -> DataFrame:
    """(page_id, url, html) of the successful HTML responses among ``records_``."""
    number = fresh(records_, "number")[0]
    good = records_.where((F.col("warc_type") == "response") & (F.col("http_status") == 200) & F.col("content_type").startswith("application/http"))
    good = good.withColumn(number, F.regexp_extract("record_id", "depweave:(-?[0-9]+)>", 1))
    return good.select(F.expr(f"try_cast({number} as bigint)").alias("page_id"), F.col("target_uri").alias("url"), F.col("payload").alias("html"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_warc(load(spark, sf_dir, "pages"), path).agg(F.sum("n")).collect()
    return pages_of(read_warc(spark, path))


QUERIES = {"op5_warc": op5_warc}
ORACLES = {"op5_warc": "SELECT page_id, url, html FROM pages WHERE html IS NOT NULL"}
