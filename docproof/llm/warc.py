"""WARC records in ZIP-packaged archives: a writer, and a reader that works by ranges.

An archive is a ZIP with stored (not compressed) members: WARC files under ``archive/``, plain or with a gzip member for
each record, and under ``indexes/`` CDXJ lines (``key time {json}``, plain or in gzip) that name each record's file, offset
and length. The reader never extracts: it reads the end record - the ZIP64 one where sizes or counts need it - and the
central directory, takes each member's place from its local header, reads every index, and then the records by the
ranges that the indexes name. Archives are listed as rows; a task locates the records of an archive and deals them out as
spans of neighbours, up to ``CHUNK`` bytes, which tasks all over the cluster read in one go and cut at the named places.

What is read is checked: an index by the directory's CRC, a record by its gzip CRC, a payload by the SHA-1 that its record
states. Any mismatch raises, so a broken archive gives no rows instead of wrong ones. (A revisit holds no payload; its
size and digest are those that it states.)

Writer: a record's payload digest decides its kind. Of equal payloads the row with the largest page_id is a response, the
others are revisits that name it; digests are grouped with a partial aggregate and joined back from a written table.
Each task writes archives of at most ``ARCHIVE_RECORDS`` records under a name of its own attempt and then renames, so a
repeated task leaves one archive; the list of archives is a written table.

Defined results: null html is an empty payload; empty payloads are equal to each other; null urls become an empty target;
rows with a null page_id are revisits of an equal payload that has one, and else responses; rows that repeat a page_id are
written each, and those equal to the response in id and payload are responses too; an empty table writes no archives.
Records of other writers have no page_id, but their record_id; those that are neither response nor revisit (warcinfo,
request, metadata) count if an index names them, with their block as payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.llm.common import plain, save, shared_dir

ARCHIVE_RECORDS = 50_000
CHUNK = 4 << 20
GAP = 64 << 10
DATA, INDEX = "data.warc.gz", "indexes/index.cdxj"
#: Signatures of the ZIP format (fixed values).
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
#: The upper half of the record ids; the lower one is the page_id, or for pages without one the task and a number.
SPACE_ID, LONE_ID = (uuid.uuid5(uuid.NAMESPACE_URL, f"https://example.org/{x}").int >> 64 for x in ("records", "lone-records"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(number: int, space: int = SPACE_ID) -> str:
    return f"<urn:uuid:{uuid.UUID(int=space << 64 | number & (1 << 64) - 1)}>"


def page_of(record: str | None) -> int | None:
    """The page_id in a record id of this writer's, else None."""
    found = re.fullmatch(r"<?urn:uuid:([0-9a-fA-F-]{36})>?", record or "")
    value = uuid.UUID(found[1]).int if found else 0
    low = value & (1 << 64) - 1
    return (low - (1 << 64) if low >> 63 else low) if found and value >> 64 == SPACE_ID else None


def record(name: str, url: str, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit holds the response's headers alone, whose Content-Length tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url)), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    """Field names are lower-cased; a line that starts with space goes on with the one before."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload in the record)."""
    head, rest = data.split(b"\r\n\r\n", 1)
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    if len(block) < int(warc["content-length"]):
        raise ValueError("a record is shorter than it states")
    if not warc.get("content-type", "").startswith("application/http"):
        return warc, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _headers(http), payload


def row_of(data: bytes) -> tuple:
    """record_id, page_id, url, record_type, payload_digest, payload_bytes, refers_to and payload of a record. A payload
    that is not what its digest says raises."""
    warc, http, payload = parse(data)
    kind, stated = warc["warc-type"], warc.get("warc-payload-digest", "").partition(":")
    name, target, refers = warc.get("warc-record-id"), warc.get("warc-target-uri"), page_of(warc.get("warc-refers-to"))
    if kind == "revisit":
        size = http.get("content-length")
        return name, page_of(name), target, kind, stated[2] or None, int(size) if size else None, refers, None
    found = digest(payload)
    if stated[0].lower() == "sha1" and len(stated[2]) == 32 and stated[2].upper() != found:
        raise ValueError(f"the payload of {name} is not what its digest says")
    return name, page_of(name), target, kind, found, len(payload), refers, payload


class ZipWriter:
    """Writes stored members one after another to a stream, with ZIP64 records for all that 32 bits cannot hold."""

    def __init__(self, out, force64: bool = False) -> None:
        self.out, self.at, self.directory, self.count, self.force64 = out, 0, b"", 0, force64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, chunks: Iterator[bytes], size: int, crc: int) -> None:
        start, raw = self.at, name.encode()
        long = self.force64 or size >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if long else b""
        short = FULL32 if long else size
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra)
        for chunk in chunks:
            self._put(chunk)
        far = self.force64 or start >= FULL32
        body = (struct.pack("<QQ", size, size) if long else b"") + (struct.pack("<Q", start) if far else b"")
        extra = struct.pack("<HH", 1, len(body)) + body if body else b""
        self.directory += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, FULL32 if far else start) + raw + extra
        self.count += 1

    def close(self) -> None:
        start, size = self.at, len(self.directory)
        self._put(self.directory)
        long = self.force64 or self.count >= FULL16 or start >= FULL32 or size >= FULL32
        if long:
            place = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, self.count, self.count, size, start))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, place, 1))
        count = FULL16 if long else self.count
        self._put(END + struct.pack("<HHHHIIH", 0, 0, count, count, FULL32 if long else size, FULL32 if long else start, 0))


class ZipDirectory:
    """The members of a ZIP file: name -> (offset of its data, size, CRC). Stored members only; others raise."""

    def __init__(self, file) -> None:
        self.file, self.size = file, file.size()
        tail_at = max(0, self.size - FULL16 - 22 - 20)
        tail = self._read(tail_at, self.size - tail_at)
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("no end of central directory")
        count, size, start = struct.unpack_from("<HII", tail, at + 10)
        if FULL16 == count or FULL32 in (size, start):
            if tail[at - 20 : at - 16] != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            (place,) = struct.unpack_from("<Q", tail, at - 12)
            end = self._read(place, 56)
            if end[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, size, start = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        directory, at = self._read(start, size), 0
        for _ in range(count):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, _, _, crc, packed, plain_size, n, m, k = struct.unpack_from("<HHHIIIHHH", directory, at + 10)
            (local,) = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + n].decode("utf-8", "replace")
            packed, local = self._wide(directory[at + 46 + n : at + 46 + n + m], plain_size, packed, local)
            if method != 0:
                raise ValueError(f"{name} is not stored")
            head = self._read(local, 30)
            if head[:4] != LOCAL:
                raise ValueError(f"{name} has no local header")
            a, b = struct.unpack_from("<HH", head, 26)
            self.members[name] = local + 30 + a + b, packed, crc
            at += 46 + n + m + k

    @staticmethod
    def _wide(extra: bytes, plain_size: int, packed: int, local: int) -> tuple[int, int]:
        """(packed size, local offset) with the ZIP64 field applied: it holds only what the header leaves full."""
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
                if plain_size == FULL32:
                    next(values)
                packed = next(values) if packed == FULL32 else packed
                local = next(values) if local == FULL32 else local
            at += 4 + size
        return packed, local

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)


def _write_archive(path: str, records: list[tuple[str, str, str, bytes]], data_crc: int, data_size: int) -> None:
    """``records``: target, kind, digest and gzip member of each."""
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    lines, at = [], 0
    for url, kind, sha1, packed in records:
        entry = {"url": url, "mime": "text/html" if kind == "response" else "warc/revisit", "status": "200", "digest": f"sha1:{sha1}", "length": str(len(packed)), "offset": str(at), "filename": DATA}
        lines.append(f"{re.sub(r'[^!-~]', '', url) or '-'} 20240101000000 {json.dumps(entry)}\n")
        at += len(packed)
    index = "".join(sorted(lines)).encode()
    part = f"{place}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        archive = ZipWriter(out)
        archive.member(f"archive/{DATA}", (x[-1] for x in records), data_size, data_crc)
        archive.member(INDEX, iter([index]), len(index), zlib.crc32(index))
        archive.close()
    store.move(part, place)


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Writes a record for each row; returns the written list of archives: path, records."""
    payload = F.encode(plain(html_col), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), plain(F.col(url_col).cast("string")).alias("url"), payload.alias("payload"))
    keys = save(rows.select("page", F.sha1("payload").alias("sha")), "payload-digests")
    last = save(keys.groupBy("sha").agg(F.max("page").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").select("sha", "last"), "repeated-payloads")
    marked = rows.withColumn("sha", F.sha1("payload")).join(last, "sha", "left")
    marked = marked.withColumn("refers_to", F.when(~F.col("last").eqNullSafe(F.col("page")), F.col("last"))).select("page", "url", "payload", "sha", "refers_to")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, lone, held, crc, size = TaskContext.get().partitionId(), 0, 0, [], 0, 0

        def done() -> pd.DataFrame:
            nonlocal number, held, crc, size
            path = f"{folder}/part-{task:05d}-{number:05d}.wacz"
            _write_archive(path, held, crc, size)
            out = pd.DataFrame({"path": [path], "records": [len(held)]})
            number, held, crc, size = number + 1, [], 0, 0
            return out

        for batch in batches:
            for page, url, body, sha, refers in zip(batch["page"].astype("Int64"), batch["url"], batch["payload"], batch["sha"], batch["refers_to"].astype("Int64"), strict=True):
                sha1, lone = base64.b32encode(bytes.fromhex(sha)).decode(), lone + (page is pd.NA)
                name = record_id(task << 32 | lone, LONE_ID) if page is pd.NA else record_id(int(page))
                packed = gzip_member(record(name, url, bytes(body), sha1, None if refers is pd.NA else int(refers)))
                held.append((url, "response" if refers is pd.NA else "revisit", sha1, packed))
                crc, size = zlib.crc32(packed, crc), size + len(packed)
                if len(held) >= archive_records or size >= 64 << 20:
                    yield done()
        if held:
            yield done()

    return save(marked.mapInPandas(write, "path string, records long"), "archives")


def records_of(file) -> list[tuple[bool, int, int]]:
    """(whether it is packed, offset in the file, length) of the records that a package's indexes name, by offset."""
    members, found = ZipDirectory(file).members, set()
    for name, (at, size, crc) in members.items():
        if not re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", name):
            continue
        file.seek(at)
        index = file.read(size)
        if zlib.crc32(index) != crc:
            raise ValueError(f"{name} is not what its CRC says")
        for line in (gzip.decompress(index) if name.endswith(".gz") else index).splitlines():
            if b"{" in line:  # other lines are headers
                entry = json.loads(line[line.index(b"{") :])
                start, room, _ = members[f"archive/{entry['filename']}"]
                offset, length = int(entry["offset"]), int(entry["length"])
                if offset + length > room:
                    raise ValueError(f"{name} names a place beyond {entry['filename']}")
                found.add((start + offset, length, entry["filename"].endswith(".gz")))
    return [(packed, at, length) for at, length, packed in sorted(found)]


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives in ``path``: record_id, page_id, url, record_type, payload_digest,
    payload_bytes, refers_to and payload (null for revisits)."""

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, place = fs.FileSystem.from_uri(path)
                with closing(store.open_input_file(place)) as file:
                    spans: list[list] = []
                    for packed, at, length in records_of(file):
                        if not spans or spans[-1][3] != packed or at - sum(spans[-1][1:3]) > GAP or at + length - spans[-1][1] > CHUNK or len(spans[-1][4]) >= 4_000:
                            spans.append([path, at, 0, packed, []])
                        span = spans[-1]
                        span[2] = max(span[2], at + length - span[1])
                        span[4] += [at - span[1], length]
                yield pd.DataFrame(spans, columns=["path", "at", "size", "packed", "cuts"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["record_id", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        for batch in batches:
            for path, at, size, packed, cuts in zip(*(batch[c] for c in ("path", "at", "size", "packed", "cuts")), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                with closing(store.open_input_file(place)) as file:
                    file.seek(at)
                    data = memoryview(file.read(size))
                out = []
                for a, n in zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True):
                    out.append(row_of(gzip.decompress(data[a : a + n]) if packed else bytes(data[a : a + n])))
                yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    schema = "record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    spark = archives.sparkSession
    slots = max(1, spark.sparkContext.defaultParallelism)
    spans = archives.select("path").repartition(slots).mapInPandas(locate, "path string, at long, size long, packed boolean, cuts array<long>")
    return spans.repartition(slots * 2).mapInPandas(read, schema)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/docproof/archives-{uuid.uuid4().hex}"
