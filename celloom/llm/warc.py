"""WARC archives: a writer with deduplicated payloads and a salvage reader that resynchronises after damage."""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from celloom.session import ship, small, stored

VERSION = b"WARC/1.1"
#: Bytes of records after which a writing task starts another file.
FILE_BYTES = 64 << 20
#: Bytes read at once by the reader.
BLOCK = 1 << 20
#: Bytes of a header line among which its name ends.
NAME = 1 << 10

RECORD_SCHEMA = "file string, offset long, kind string, record_id string, target_uri string, refers_to string, payload_digest string, page_id long, full_bytes long, payload binary, reason string, gap_bytes long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(kind: str, record_id: str, uri: str, payload: bytes, payload_digest: str, page_id: str | None, full_bytes: int, refers_to: str | None) -> bytes:
    """One record. A revisit carries no payload; its digest and length are those of the full one."""
    block = b"" if kind == "revisit" else payload
    head = [
        VERSION,
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: <" + record_id.encode() + b">",
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass"),
        b"WARC-Payload-Digest: sha1:" + payload_digest.encode(),
        b"WARC-Block-Digest: sha1:" + digest(block).encode(),
        b"X-Page-ID: " + (page_id or "").encode(),
        b"X-Payload-Length: " + str(full_bytes).encode(),
    ]
    if refers_to is not None:
        head += [b"WARC-Refers-To: <" + refers_to.encode() + b">", b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(b"Content-Length: " + str(len(block)).encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record as one gzip member."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def record_urn(page_id: str | None) -> str:
    """A page's name in the archive; its id can be read from it."""
    return f"urn:x-page:{'' if page_id is None else page_id}"


def urn_page(urn: Column) -> Column:
    """The id in a name that record_urn gave; null if there is none."""
    return F.regexp_extract(urn, r"^urn:x-page:(-?\d+)$", 1).try_cast("bigint")


def plan_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """pages with payload, payload_bytes, sha1 (hex), record_type and refers_to (an id, null for responses).

    Of records with equal payloads of at least `least` bytes the one with the largest id is the response and the others revisit it.
    Only digests and ids are shuffled to find it. Null html is an empty payload, a null url an empty one; a null id stays
    null and is a response. Rows with equal ids and payloads are all responses or all revisits. An empty table gives no file.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    held = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumns(
        {"payload_bytes": F.length("payload").cast("long"), "sha1": F.sha1("payload")}
    )
    firsts = (
        held.where(F.col("payload_bytes") >= least)
        .groupBy("sha1", "payload_bytes")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha1", "payload_bytes", "keeper")
    )
    return (
        held.join(small(stored(firsts, "warc-repeats")), ["sha1", "payload_bytes"], "left")
        .withColumn("refers_to", F.when(F.col("keeper") != F.col("page_id"), F.col("keeper")))
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
        .drop("keeper")
    )


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of plan_records as .warc.gz files of one member a record; lazily returns (file, records, bytes).

    A task writes under names with its attempt and renames at the end, so a task that is run again or twice leaves whole files
    under the same final names. An empty partition writes nothing.
    """
    ship(records.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get()
        filesystem, base = _filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        made, out, name, size, n = 0, None, "", 0, 0

        def close():
            out.close()
            final = f"{base}/part-{at.partitionId():06d}-{made:04d}.warc.gz"
            if filesystem.get_file_info(final).is_file:  # of an earlier attempt; not every file system moves onto a file
                filesystem.delete_file(final)
            filesystem.move(name, final)
            return pd.DataFrame({"file": [final], "records": [n], "bytes": [size]})

        for batch in batches:
            for page_id, uri, payload, total, kind, keeper in zip(batch.page_id, batch.url, batch.payload, batch.payload_bytes, batch.record_type, batch.refers_to, strict=True):
                if out is None:
                    name = f"{base}/.writing-{at.partitionId()}-{at.taskAttemptId()}-{made}"
                    out, size, n = filesystem.open_output_stream(name), 0, 0
                refers = None if kind != "revisit" else record_urn(keeper)
                data = member(build_record(kind, record_urn(page_id), uri or "", bytes(payload), digest(bytes(payload)), page_id, int(total), refers))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    yield close()
                    out, made = None, made + 1
        if out is not None:
            yield close()

    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]
    return records.select(*ids, "url", "payload", "payload_bytes", "record_type").mapInPandas(run, "file string, records long, bytes long")


class Stream:
    """Bytes of a file by absolute position, holding only what lies between keep() and the read position."""

    def __init__(self, raw: io.RawIOBase):
        self.raw, self.data, self.start, self.ended = raw, bytearray(), 0, False

    def more(self) -> bool:
        got = b"" if self.ended else self.raw.read(BLOCK)
        self.ended = not got
        self.data += got
        return bool(got)

    def get(self, at: int, n: int) -> bytes:
        while len(self.data) < at - self.start + n and self.more():
            pass
        return bytes(self.data[at - self.start : at - self.start + n])

    def find(self, marks: tuple[bytes, ...], at: int) -> tuple[int, bytes] | None:
        """The first place of any of the marks from at on; what lies before a searched block is let go."""
        longest = max(map(len, marks))
        while True:
            found = [(p + self.start, m) for m in marks if (p := self.data.find(m, at - self.start)) >= 0]
            if found and (min(found)[0] + longest <= self.start + len(self.data) or self.ended):
                return min(found)
            at = max(at, self.start + len(self.data) - longest + 1)
            self.keep(at)
            if not self.more():
                return min(found, default=None)

    def keep(self, at: int) -> None:
        cut = min(max(at - self.start, 0), len(self.data))
        del self.data[:cut]
        self.start += cut


class Member:
    """The plain bytes of the gzip member at a position, read in steps; ended once its checksum is verified at `at`, where it ends."""

    def __init__(self, stream: Stream, at: int):
        self.stream, self.at, self.z, self.ended = stream, at, zlib.decompressobj(31), False

    def read(self, n: int) -> bytes:
        out = b""
        while not out and not self.ended:
            chunk = self.z.unconsumed_tail or self.stream.get(self.at, 1 << 16)
            if not chunk:
                raise ValueError("truncated member")
            try:
                out = self.z.decompress(chunk, n)
            except zlib.error as error:
                raise ValueError(f"bad member: {error}") from None
            self.at += len(chunk) - len(self.z.unconsumed_tail) - len(self.z.unused_data)
            self.ended = self.z.eof
        return out


def _in_member(stream: Stream, here: int) -> Iterator[dict | int]:
    """The records of the gzip member at a position, gaps between them as rows of kind "gap" (in plain bytes), and last the position
    behind it. ValueError if the member is damaged, behind what was given.

    A record with a block digest, which it has passed, is given at once; one without only after the next record or the member's
    checksum proved right.
    """
    member = Member(stream, here)
    plain, at, ready, given, gap, why = Stream(member), 0, None, False, None, ""
    while True:
        if given:
            stream.keep(member.at)
        found = plain.find((b"WARC/",), at)
        start = found[0] if found else plain.start + len(plain.data)
        if start > at and gap is None:
            gap, why = at, why or "no record starts here"
        record = None
        if found:
            try:
                data, end = _plain(plain, start)
                headers, block, _ = parse_record(data)
                record = {"offset": here, "kind": headers.get("warc-type", ""), "headers": headers, "payload": block}
            except Damage as error:
                if not plain.ended and start == 0:
                    raise
                gap, why, at = (start if gap is None else gap), why or str(error), start + 1
                continue
        if (record or not found) and ready is not None:
            yield ready
            ready, given = None, True
        if gap is not None and start > gap and (record or not found):
            if record is None and gap == 0:
                raise ValueError(why)
            yield {"offset": here, "kind": "gap", "gap_bytes": start - gap, "reason": f"in a member: {why}"}
            gap, why = None, ""
        if record is None:
            yield member.at
            return
        gap, why, at = None, "", end
        if "warc-block-digest" in headers:
            yield record
            given = True
        else:
            ready = record
        plain.keep(end)


class Damage(ValueError):
    """A record that fails a check, in bytes that could be read."""


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers by lower-cased name, block and length of the record at the start of data; ValueError if a check fails."""
    if not data.startswith(b"WARC/"):
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damage("headers do not end")
    headers = {}
    for line in data[:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damage("bad header line")
        headers[key.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "surrogatepass")
    if not headers.get("content-length", "").isdigit():
        raise Damage("no content length")
    size = int(headers["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) < size:
        raise Damage("truncated block")
    if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise Damage("record does not end in two line ends")
    told = headers.get("warc-block-digest", "").removeprefix("sha1:")
    if told and told != digest(block):
        raise Damage("block digest differs")
    return headers, block, end + 8 + size


def _plain(stream: Stream, at: int) -> tuple[bytes, int]:
    """An uncompressed record at a position and where it ends. Headers of any size are read as long as they look like headers."""
    head, n = b"", 4096
    while (end := (head := stream.get(at, n)).find(b"\r\n\r\n")) < 0:
        *lines, last = head.split(b"\r\n")
        if len(head) < n or any(b":" not in x[:NAME] for x in lines[1:]) or len(last) > NAME and b":" not in last[:NAME]:
            raise Damage("headers do not end")
        n *= 2
    length = next((v.strip() for k, _, v in (x.partition(b":") for x in head[:end].split(b"\r\n")) if k.strip().lower() == b"content-length"), b"")
    if not length.isdigit():
        raise Damage("no content length")
    whole = end + 8 + int(length)
    return stream.get(at, whole), at + whole


def salvage(raw: io.RawIOBase) -> Iterator[dict]:
    """Records of one archive in order, and a row of kind "gap" for each stretch of bytes that no valid record covers.

    After a failed check the search goes on one byte behind the failed start, for the next gzip member or version line that holds
    a whole valid record; so later records are recovered whatever the damage before them. A gzip member may hold any number of
    records, each found and checked like an uncompressed one, and is inflated in steps.
    """
    stream, at, gap, why = Stream(raw), 0, None, ""
    marks = (b"\x1f\x8b\x08", b"WARC/")
    while True:
        found = stream.find(marks, at)
        here = found[0] if found else None
        if here is None or here > at:
            gap, why = (at if gap is None else gap), why or "no record starts here"
        if here is None:
            end = stream.start + len(stream.data)
            if gap is not None and end > gap:
                yield {"offset": gap, "kind": "gap", "gap_bytes": end - gap, "reason": why}
            return
        given = 0
        try:
            if found[1] == marks[0]:
                for row in _in_member(stream, here):
                    if isinstance(row, int):
                        end = row
                        break
                    if not given and gap is not None and here > gap:
                        yield {"offset": gap, "kind": "gap", "gap_bytes": here - gap, "reason": why}
                    given, gap, why = given + 1, None, ""
                    yield row
            else:
                data, end = _plain(stream, here)
                headers, block, _ = parse_record(data)
        except ValueError as error:
            if given:  # what the member held before the damage is recovered; the search goes on where the rest was being read
                gap, why, at = here, f"after {given} rows of this member: {error}", max(stream.start, here + 1)
                continue
            if gap is None or not why or why == "no record starts here":
                gap, why = (here if gap is None else gap), str(error)
            at = here + 1
            continue
        if found[1] != marks[0]:
            if gap is not None and here > gap:
                yield {"offset": gap, "kind": "gap", "gap_bytes": here - gap, "reason": why}
            yield {"offset": here, "kind": headers.get("warc-type", ""), "headers": headers, "payload": block}
        gap, why = None, ""
        at = end
        stream.keep(at)


def checked(rows: DataFrame, records: int, folder: str) -> DataFrame:
    """The records among the rows of read(), stored. Gaps go to a quarantine table in the folder, and a number of sound records other
    than the number written raises."""
    held = stored(rows, "warc-rows")
    bad = held.where("kind = 'gap' or reason is not null")
    bad.write.mode("overwrite").parquet(f"{folder}/quarantine")
    found = held.where("kind != 'gap' and reason is null")
    n = found.count()
    if n != records:
        raise RuntimeError(f"{n} sound records of {records} written; see {folder}/quarantine")
    return found


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def read(spark: SparkSession, files: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORD_SCHEMA rows of the archives named in files(file): a path or URI each. Gaps are rows of kind "gap".

    Files are read in blocks; memory is bounded by the largest record, and by the rest of the file while a damaged stretch is tried.
    A record whose payload does not have the digest its header gives comes with a reason. Empty files give no rows.
    """
    ship(spark)
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for file in batch.file:
                filesystem, path = _filesystem(file)
                with filesystem.open_input_stream(path, compression=None) as raw:
                    for r in salvage(raw):
                        h = r.get("headers", {})
                        own = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        strip = lambda x: x.strip("<>") if x else None
                        payload = r.get("payload") if payloads else None
                        reason = r.get("reason")
                        if r["kind"] == "response" and own and own != digest(r["payload"]):
                            reason = "payload digest differs"
                        rows.append((file, r["offset"], r["kind"], strip(h.get("warc-record-id")), h.get("warc-target-uri"), strip(h.get("warc-refers-to")), own, _number(h.get("x-page-id")), _number(h.get("x-payload-length")), payload, reason, r.get("gap_bytes")))
                        held += len(payload or b"")
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
        if rows:
            yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype({"offset": "int64", "page_id": "Int64", "full_bytes": "Int64", "gap_bytes": "Int64"})

    return files.select("file").mapInPandas(run, RECORD_SCHEMA)
