"""WARC archives as a Spark data source.

Reading: the driver lists the archives and plans partitions of up to ``partitionBytes``, or of one file if it is larger
and nothing tells where its records begin. Predicates on the columns that come from a record's headers are pushed down.
A task parses a record's headers first; where they do not meet the predicates, or no payload is asked for, it seeks
past the payload without inflating or decoding it.

Writing: every task writes archives of its own under names of their own, straight into the folder. What Spark commits
is named by one manifest, which appears at once and as a whole; readers take archives named so by this writer only if a
manifest lists them, so a task that runs twice, or is lost, leaves nothing that is read. No file is moved or copied.
The manifest also says where records begin, every ``SPLIT_BYTES`` or so, so large archives are read in parts. Headers
and content of a record are gzip members of their own, and the first says in its extra field how long the second is:
any gzip or WARC reader can read the archive, and this one can skip.

Archives of other writers are read too: plain or gzip, with ids, addresses and digests of any kind. Ids that are not
this writer's give a null page_id, addresses come as they stand, digests of other kinds as the headers state them.

Options of the reader: ``payload`` is ``bytes`` (a column with the payloads), ``digest`` (payloads are read and hashed
where they are, not returned; the default) or ``none`` (length and digest as the headers state them, null where they do
not). ``verify`` is ``own`` (a payload of this writer that does not match its digest is an error; the default), ``all``
(any payload with a SHA-256, SHA-1 or MD5 digest) or ``none``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import urllib.parse
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from . import common

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string"
HEADER_COLUMNS = ("page_id", "target_uri", "record_type", "refers_to")
ROWS_A_BATCH, BYTES_A_BATCH, SPLIT_BYTES, ROWS_AT_ONCE = 2000, 16 << 20, 16 << 20, 64
OWN_NAME, MANIFEST = re.compile(r"part-[0-9a-f]{32}\.warc\.gz"), "_manifest-"


def member(data: bytes, extra: bytes = b"", level: int = 3) -> bytes:
    """A gzip member, with an extra field if there is one."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    head = b"\x1f\x8b\x08" + (b"\x04" if extra else b"\x00") + b"\0\0\0\0\0\xff"
    if extra:
        head += struct.pack("<H", len(extra)) + extra
    return head + c.compress(data) + c.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _line(value: str) -> str:
    """A value fit for one header line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, uri, payload: bytes, kind: str, refers_to, n_bytes: int, digest: str, date: str) -> bytes:
    """One record: a response with its payload, or a revisit without."""
    block = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    name = lambda i: f"<urn:x-page:{i}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_line(uri)}")
        if uri != _line(uri).strip():  # what a header line can't hold is said again, escaped
            lines.append(f"X-Target-URI: {urllib.parse.quote(uri, safe='')}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    body = member(block + b"\r\n\r\n")
    return member("\r\n".join(lines).encode(), b"WL" + struct.pack("<HQ", 8, len(body))) + body


class _Archive:
    """A buffered file of gzip members, or of plain records."""

    def __init__(self, f, start: int = 0, size: int = 1 << 20):
        self.f, self.size, self.buffer, self.at, self.begin = f, size, b"", 0, start
        if start:
            f.seek(start)

    @property
    def place(self) -> int:
        """Where in the file the next byte is."""
        return self.begin + self.at

    def more(self) -> bool:
        got = self.f.read(self.size)
        self.buffer = self.buffer[self.at :] + got
        self.begin += self.at
        self.at = 0
        return bool(got)

    def has(self, n: int) -> bool:
        while len(self.buffer) - self.at < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.has(n):
            raise ValueError("the archive ends within a record")
        self.at += n
        return self.buffer[self.at - n : self.at]

    def skip(self, n: int) -> None:
        held = len(self.buffer) - self.at
        if n <= held:
            self.at += n
        else:
            self.f.seek(n - held, 1)
            self.begin = self.place + n
            self.buffer, self.at = b"", 0

    def line_block(self) -> bytes:
        """Up to the empty line that ends headers."""
        while (i := self.buffer.find(b"\r\n\r\n", self.at)) < 0:
            if not self.more():
                raise ValueError("the archive ends within headers")
        return self.take(i + 4 - self.at)

    def member(self) -> tuple[bytes, bytes]:
        """Extra field and data of the gzip member that begins here."""
        head = self.take(10)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        extra = self.take(struct.unpack("<H", self.take(2))[0]) if head[3] & 4 else b""
        for flag in (8, 16):  # name, comment
            while head[3] & flag and self.take(1) != b"\0":
                pass
        if head[3] & 2:
            self.take(2)
        d, out = zlib.decompressobj(-15), []
        while not d.eof:
            if not self.has(1):
                raise ValueError("the archive ends within a member")
            try:
                out.append(d.decompress(self.buffer[self.at :]))
            except zlib.error as e:
                raise ValueError(f"a member of the archive is damaged: {e}") from e
            self.at = len(self.buffer) - len(d.unused_data)
        data = b"".join(out)
        if struct.unpack("<I", self.take(8)[:4])[0] != zlib.crc32(data):
            raise ValueError("a member of the archive is damaged: its digest differs")
        return extra, data


class _Inflated:
    """The content of a gzip file, whose members need not be records, as a file to be read onwards."""

    def __init__(self, f):
        self.f, self.d, self.held, self.over = f, zlib.decompressobj(31), b"", False

    def read(self, n: int) -> bytes:
        while not self.over:
            if not self.held and not (got := self.f.read(1 << 16)):
                if not self.d.eof:
                    raise ValueError("the archive ends within a member")
                self.over = True
                break
            if self.d.eof:
                self.d = zlib.decompressobj(31)
            try:
                out = self.d.decompress(self.held or got, n)
            except zlib.error as e:
                raise ValueError(f"a member of the archive is damaged: {e}") from e
            self.held = self.d.unused_data if self.d.eof else self.d.unconsumed_tail
            if out:
                return out
        return b""

    def seek(self, n: int, whence: int) -> None:
        while n and (got := self.read(min(n, 1 << 20))):
            n -= len(got)


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}


def _page(name: str | None) -> int | None:
    """The page_id in a record's name; null for names that other writers gave."""
    found = re.fullmatch(r"<?urn:x-page:(-?[0-9]{1,19})>?", name or "")
    return int(found[1]) if found and -(2**63) <= int(found[1]) < 2**63 else None


def header_values(h: dict[str, str]) -> dict:
    exact = h.get("x-target-uri")
    return {
        "page_id": _page(h.get("warc-record-id")), "target_uri": h.get("warc-target-uri") if exact is None else urllib.parse.unquote(exact),
        "record_type": h.get("warc-type"), "refers_to": _page(h.get("warc-refers-to")),
    }


def stated_digest(h: dict[str, str]) -> tuple[str | None, str | None]:
    """(hash name, hex digest) of the payload as the headers state it, in hex or base32; (None, None) if in neither."""
    kind, _, value = h.get("warc-payload-digest", "").partition(":")
    kind, bits = kind.lower().replace("-", ""), {"sha256": 256, "sha1": 160, "md5": 128}
    if kind not in bits:
        return None, None
    if re.fullmatch(r"[0-9A-Fa-f]+", value) and 4 * len(value) == bits[kind]:
        return kind, value.lower()
    try:
        raw = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None, None
    return (kind, raw.hex()) if 8 * len(raw) == bits[kind] else (None, None)


def records(f, wanted, payload: bool, start: int = 0, end: int | None = None):
    """(header values, headers, payload or None) of the records whose header values are wanted, of those that begin
    from ``start``, where a record begins, to before ``end``."""
    a = _Archive(f, start)
    if a.has(14) and a.buffer[:2] == b"\x1f\x8b" and not (a.buffer[3] & 4 and a.buffer[12:14] == b"WL"):
        f.seek(start)
        a, end = _Archive(_Inflated(f)), None  # not this writer's: whatever its members are
    while (end is None or a.place < end) and a.has(1):
        packed = a.buffer[a.at : a.at + 2] == b"\x1f\x8b" if a.has(2) else False
        rest, length = b"", None
        if packed:
            extra, data = a.member()
            head, sep, rest = data.partition(b"\r\n\r\n")
            if extra[:2] == b"WL" and not rest:
                length = struct.unpack("<HQ", extra[2:12])[1]
        else:
            head = a.line_block()[:-4]
        h = parse_headers(head)
        values = header_values(h)
        n = int(h.get("content-length", 0))
        want = wanted(values)
        if want and payload and n:
            block = (a.member()[1] if length is not None else rest if packed else a.take(n))[:n]
            if len(block) != n:
                raise ValueError("a record is shorter than its Content-Length")
            body = block.partition(b"\r\n\r\n")[2] if "http" in h.get("content-type", "") else block
        else:
            body = b"" if payload else None
            if length is not None:
                a.skip(length)
            elif not packed:
                a.skip(n)
        if not packed:
            a.take(4)
        if want:
            yield values, h, body


def _compare(f):
    """A test on header values for a pushed filter, or None if it has to stay with Spark."""
    column = getattr(f, "attribute", ())
    if len(column) != 1 or column[0] not in HEADER_COLUMNS:
        return None
    c = column[0]
    known = lambda test: lambda v: v[c] is not None and test(v[c])
    if isinstance(f, EqualTo):
        return known(lambda x: x == f.value)
    if isinstance(f, In):
        among = set(f.value)
        return known(lambda x: x in among)
    if isinstance(f, GreaterThan):
        return known(lambda x: x > f.value)
    if isinstance(f, GreaterThanOrEqual):
        return known(lambda x: x >= f.value)
    if isinstance(f, LessThan):
        return known(lambda x: x < f.value)
    if isinstance(f, LessThanOrEqual):
        return known(lambda x: x <= f.value)
    if isinstance(f, StringStartsWith):
        return known(lambda x: x.startswith(f.value))
    if isinstance(f, IsNotNull):
        return lambda v: v[c] is not None
    if isinstance(f, IsNull):
        return lambda v: v[c] is None
    return None


@dataclass
class Archives(InputPartition):
    parts: tuple[tuple[str, int, int | None], ...]  # path, first byte, byte before which the last record begins


def committed(system, root: str) -> list[tuple[str, int, list[int]]]:
    """(path, size, places where records begin) of the archives of a folder: those that manifests list, and those that
    this writer has not named."""
    found = system.get_file_info(fs.FileSelector(root, recursive=False))
    files = {f.base_name: f for f in found if f.is_file}
    listed: dict[str, list[int]] = {}
    for name in files:
        if name.startswith(MANIFEST):
            with system.open_input_stream(files[name].path) as f:
                listed |= {x["name"]: x["splits"] for x in json.loads(f.read())}
    keep = lambda n: n in listed or (n[0] not in "._" and not OWN_NAME.fullmatch(n))
    return sorted((f.path, f.size, listed.get(n, [])) for n, f in files.items() if keep(n))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.mode, self.verify = options["path"], options.get("payload", "digest"), options.get("verify", "own")
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))
        self.pushed: list = []

    def pushFilters(self, filters):
        for f in filters:
            if _compare(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def partitions(self):
        out, now, held = [], [], 0
        for path, size, splits in committed(*fs.FileSystem.from_uri(self.path)):
            cuts = [0, *splits, size]
            for a, b in zip(cuts, cuts[1:]):
                if now and held + b - a > self.partition_bytes:
                    out.append(Archives(tuple(now)))
                    now, held = [], 0
                held += b - a
                if now and now[-1][0] == path and now[-1][2] == a:
                    a = now.pop()[1]
                now.append((path, a, b))
        return [*out, Archives(tuple(now))] if now or not out else out

    def _row(self, v: dict, h: dict, body: bytes | None) -> tuple:
        kind, stated = stated_digest(h)
        own = "x-payload-length" in h
        if body is None or v["record_type"] == "revisit":
            digest = stated if kind == "sha256" else h.get("warc-payload-digest")
            return v["page_id"], v["target_uri"], v["record_type"], v["refers_to"], int(h["x-payload-length"]) if own else None, digest
        digest = hashlib.sha256(body).hexdigest()
        if kind and (self.verify == "all" or (self.verify == "own" and own)):
            if stated != (digest if kind == "sha256" else hashlib.new(kind, body).hexdigest()):
                raise ValueError(f"the payload of {h.get('warc-record-id')} does not match its digest")
        return v["page_id"], v["target_uri"], v["record_type"], v["refers_to"], len(body), digest

    def read(self, partition):
        if not partition.parts:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        tests = [_compare(f) for f in self.pushed]
        wanted = lambda v: all(t(v) for t in tests)
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        if self.mode == "bytes":
            names, types = [*names, "payload"], [*types, pa.binary()]
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for path, start, end in partition.parts:
            with system.open_input_file(path) as f:
                for v, h, body in records(f, wanted, self.mode != "none", start, end):
                    row = self._row(v, h, body)
                    rows.append((*row, body) if self.mode == "bytes" else row)
                    held += len(body or b"") if self.mode == "bytes" else 0
                    if len(rows) >= ROWS_A_BATCH or held > BYTES_A_BATCH:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, tuple[int, ...]], ...]  # name, places where records begin


class WarcWriter(DataSourceArrowWriter):
    """Takes page_id, url, html, record_type, refers_to, payload_bytes and payload_digest."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.file_bytes, self.split_bytes = int(options.get("fileBytes", 256 << 20)), int(options.get("splitBytes", SPLIT_BYTES))
        self.date = options.get("date", "2000-01-01T00:00:00Z")

    def write(self, iterator):
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        files, out = [], None
        try:
            for batch in iterator:
                for i in range(0, batch.num_rows, ROWS_AT_ONCE):  # a batch is made into Python's objects bit by bit
                    for r in batch.slice(i, ROWS_AT_ONCE).to_pylist():
                        if out is not None and out.tell() > self.file_bytes:
                            out.close()
                            out = None
                        if out is None:
                            files.append((f"part-{uuid.uuid4().hex}.warc.gz", []))
                            out = system.open_output_stream(f"{root}/{files[-1][0]}", compression=None)
                        splits = files[-1][1]
                        if out.tell() - (splits[-1] if splits else 0) > self.split_bytes:
                            splits.append(out.tell())
                        out.write(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], self.date))
        finally:
            if out is not None:
                out.close()
        return Written(tuple((name, tuple(splits)) for name, splits in files))

    def commit(self, messages):
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        rows = [{"name": name, "splits": list(splits)} for m in messages if m for name, splits in m.files]
        name = f"{MANIFEST}{uuid.uuid4().hex}"
        with system.open_output_stream(f"{root}/.{name}", compression=None) as f:
            f.write(json.dumps(rows).encode())
        system.move(f"{root}/.{name}", f"{root}/{name}")  # one small file: all archives of the write are there, or none

    def abort(self, messages):
        system, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                system.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return COLUMNS + (", payload binary" if self.options.get("payload") == "bytes" else "")

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def planned(pages: DataFrame, least: int = 100) -> DataFrame:
    """Pages with payload_bytes, payload_digest, record_type and refers_to; html is null for revisits.

    Of pages with equal payloads of ``least`` bytes or more, those with the smallest page_id are responses, the others
    revisit it; pages without a page_id come after all others. A null html is an empty payload. Copies are counted
    before the shuffle; only digests that occur twice are joined back, by broadcast while they are a million or fewer,
    and else by hash, when each html moves once.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"),
    )
    copies = p.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = common.staged(copies.filter("n > 1 and first is not null").select("payload_digest", "first"), "copies")
    p = p.join(common.few(copies), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"), "payload_bytes", "payload_digest",
    )


def write(pages: DataFrame, path: str, least: int = 100) -> None:
    """A record for every row of pages (page_id, url, html) in archives under path, besides what is there already.

    An empty table writes none. A null url has no address in its record, an empty one an empty one; a null page_id gets
    a random name. Repeated rows have a record each; of rows with one page_id the first is the response for all and
    these are no revisits of themselves. Very long pages are written whole. Further columns are not looked at.
    """
    register(pages.sparkSession)
    common.bounded_batches(pages.sparkSession)
    planned(pages, least).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: str = "digest") -> DataFrame:
    """The records of all archives under path; filters on page_id, target_uri, record_type, refers_to are pushed down."""
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back; payloads are hashed again where they are read."""
    path = common.new_path(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (d)
"""
