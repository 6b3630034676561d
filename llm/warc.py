"""Monolithic gzip WARC normaliser.

A WARC file that was compressed as one gzip stream can't be read from the middle.
``normalise`` inflates such a file once, in a stream of constant memory, writes each record
as a gzip member of its own to a new file, and writes a sidecar index of the members'
offsets (``<file>.index.tsv``); the index rows are also returned. ``read_records`` fetches
records by (file, offset, length) alone, as bytes.

A copy is named by a hash of the whole path and the file's name, so files of one name in
several folders don't meet. Files go to the shared folder under a temporary name and are renamed when complete, and
the bytes depend on the input only, so a task that runs again puts the same file there.

Defined results for odd input: a file of several gzip members, one per record or not, is
read as their concatenation; an empty file has no records; records without a target URI
have a null one; blank lines between records are skipped; where the stream ends or breaks
inside a record, the records before it are kept and one index row with null offset and
length and ``problem`` set tells so; a malformed header gives such a row too, and reading
goes on at the next line that begins with ``WARC/``; header lines may end in LF alone;
records that are alike are all kept; null paths are skipped. ``read_pages`` gives a null
page_id for a record id that the table writer didn't make, and replacement characters for
bytes that aren't UTF-8. In the table writer a null html makes a record of type ``metadata``, an empty one an empty record; line
ends in a URL are percent-encoded; null ids and URLs are left out of the header; an empty
table gives no files and an empty result; columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common

READ = 1 << 20
INDEX_SCHEMA = "file string, record long, offset long, length long, type string, uri string, id string, payload_bytes long, sha256 string, problem string"
_INDEX_TYPES = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 3, pa.int64(), pa.string(), pa.string()]
_INDEX_NAMES = [part.split()[0] for part in INDEX_SCHEMA.split(", ")]


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


class _Output:
    """A file that appears under its name only when it is complete."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = filesystem(path)
        context = TaskContext.get()
        self.temporary = f"{self.path}.{context.taskAttemptId() if context else 0}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream, self.at = self.fs.open_output_stream(self.temporary), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.stream.close()
        if not isinstance(self.fs, fs.LocalFileSystem) and self.fs.get_file_info(self.path).type != fs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.temporary, self.path)


class _Inflated:
    """The bytes of a gzip file's members one after another, with line and block reads from a place in a buffer."""

    def __init__(self, path: str) -> None:
        system, name = filesystem(path)
        self.source = system.open_input_stream(name, compression=None)
        self.engine, self.buffer, self.at, self.broken = zlib.decompressobj(31), b"", 0, False
        self.fresh = True

    def _more(self) -> bool:
        pending = self.engine.unused_data
        if self.engine.eof:
            self.engine, self.fresh = zlib.decompressobj(31), True
        data = self.engine.unconsumed_tail or pending or self.source.read(READ)
        if not data:
            self.broken |= not self.fresh
            return False
        try:
            self.fresh = False
            self.buffer, self.at = self.buffer[self.at :] + self.engine.decompress(data, READ), 0
        except zlib.error:
            self.broken = True
            return False
        if self.engine.eof and not self.engine.unused_data:
            self.fresh = True
        return True

    def rest(self) -> bytes:
        return self.buffer[self.at :]

    def line(self) -> bytes | None:
        searched = self.at
        while (end := self.buffer.find(b"\n", searched)) < 0:
            held = len(self.buffer) - self.at
            if self.broken or not self._more():
                return None
            searched = held
        out, self.at = self.buffer[self.at : end + 1], end + 1
        return out

    def seek_record(self, pushed_back: bytes) -> bool:
        """Goes to the next line that begins with WARC/, in what is pushed back first."""
        self.buffer, self.at = b"\n" + pushed_back + self.rest(), 0
        while (at := self.buffer.find(b"\nWARC/", self.at)) < 0:
            self.at = max(self.at, len(self.buffer) - 5)
            if self.broken or not self._more():
                return False
        self.at = at + 1
        return True

    def blocks(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.buffer) and (self.broken or not self._more()):
                return
            out = self.buffer[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out


def normalise_file(path: str, target: str, level: int = 6) -> Iterator[tuple]:
    """Writes ``target`` and its sidecar index; yields the index rows."""
    source, out = _Inflated(path), _Output(target)
    index = _Output(target + ".index.tsv")
    number, problem = 0, None
    while True:
        while (line := source.line()) is not None and not line.strip():
            pass
        if line is None:
            problem = "truncated" if source.broken or source.rest().strip() else None
            break
        header, fields = [line], {}
        while (line := source.line()) is not None and line.strip():
            header.append(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        if line is None:
            problem = "truncated"
            break
        if not header[0].startswith(b"WARC/") or not re.fullmatch("[0-9]+", size):
            yield (target, number, None, None, None, None, None, None, None, "malformed")
            if source.seek_record(b"".join(header[1:]) + line):
                continue
            problem = "truncated" if source.broken else None
            break
        start, member, digest, left = out.at, zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha256(), int(size)
        held = [member.compress(b"".join(header) + b"\r\n")]
        spilled = 0
        for block in source.blocks(left):
            left -= len(block)
            digest.update(block)
            held.append(member.compress(block))
            if (spilled := spilled + len(held[-1])) > READ and left:
                out.write(b"".join(held))
                held, spilled = [], 0
        if left:
            problem = "truncated"
            if out.at > start:  # a part of the record is out already: end its member, outside the index
                out.write(b"".join(held) + member.flush())
            break
        out.write(b"".join(held) + member.compress(b"\r\n\r\n") + member.flush())
        row = (target, number, start, out.at - start, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-record-id"), int(size), digest.hexdigest(), None)
        index.write(("\t".join("" if v is None else str(v).replace("\t", "%09") for v in row[1:]) + "\n").encode())
        number += 1
        yield row
    out.close()
    index.close()
    if problem:
        yield (target, number, None, None, None, None, None, None, None, problem)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_INDEX_TYPES)], names=_INDEX_NAMES)


def target_name(path: str) -> str:
    """The name of a file's copy: of one path always the same, of different paths different."""
    return f"{hashlib.sha256(path.encode()).hexdigest()[:16]}-{path.rpartition('/')[2]}"


def normalise(files: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """The index rows of the normalised copies, in ``folder``, of the files that the column ``path`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for row in normalise_file(path, f"{folder}/{target_name(path)}", level) if path else ():
                    rows.append(row)
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.select("path").mapInArrow(run, INDEX_SCHEMA)


def read_record(handle, offset: int, length: int) -> tuple[dict, bytes]:
    """The header fields and payload of one member, which must be one whole record."""
    handle.seek(offset)
    engine = zlib.decompressobj(31)
    data = engine.decompress(handle.read(length))
    if not engine.eof or engine.unused_data:
        raise ValueError(f"no single gzip member at {offset}, {length}")
    head, rest = re.split(rb"\r?\n\r?\n", data, maxsplit=1)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in re.split("\r?\n", head.decode("utf-8", "replace"))[1:])}
    return fields, rest[: int(fields["content-length"])]


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[dict, bytes]]]]:
    """Batches of (file, offset, length, ...) with the fields and payloads of their records, a file being opened once in a row."""
    name, handle = None, None
    for batch in batches:
        records = []
        for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if file != name:
                system, path = filesystem(file)
                name, handle = file, system.open_input_file(path)
            records.append(read_record(handle, offset, length))
        yield batch, records


def read_records(index: DataFrame) -> DataFrame:
    """file, record, headers (names in lower case) and payload of the records that index rows name, each fetched by its offset alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, records in _fetched(batches):
            headers = pa.array([list(fields.items()) for fields, _ in records], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), headers, pa.array([payload for _, payload in records], pa.binary())], names=["file", "record", "headers", "payload"])

    return index.where("problem IS NULL").select("file", "offset", "length", "record").mapInArrow(run, "file string, record long, headers map<string, string>, payload binary")


def read_pages(index: DataFrame) -> DataFrame:
    """page_id, url and html of the records that index rows name, each fetched by its offset alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, records in _fetched(batches):
            ids, urls, texts = [], [], []
            for kind, (fields, payload) in zip(batch.column(3).to_pylist(), records):
                own = re.fullmatch(r"<urn:page:(-?[0-9]{1,18})>", fields.get("warc-record-id", ""))
                ids.append(int(own[1]) if own else None)
                urls.append(fields.get("warc-target-uri"))
                texts.append(None if kind == "metadata" else payload.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "html"])

    return index.where("problem IS NULL").select("file", "offset", "length", "type").mapInArrow(run, "page_id long, url string, html string")


def write_monolithic(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """One gzip stream of WARC records for each partition of ``pages``; the column path names the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for number, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
                    out, engine = _Output(path), zlib.compressobj(level, zlib.DEFLATED, 31)
                payload = (html or "").encode()
                head = ["WARC/1.0", f"WARC-Type: {'metadata' if html is None else 'resource'}"]
                head += [f"WARC-Record-ID: <urn:page:{number}>"] if number is not None else []
                head += [f"WARC-Target-URI: {url}".replace("\r", "%0D").replace("\n", "%0A")] if url is not None else []
                head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
                out.write(engine.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"))
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "path string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as whole-file gzip streams, normalised, and read back by the sidecar's offsets."""
    root = common.new_path(spark, "warc")
    index = common.saved(normalise(write_monolithic(common.table(spark, sf_dir, "pages"), f"{root}/whole"), f"{root}/members"), "warc-index")
    pages = read_pages(index)
    return pages.selectExpr("page_id", "url", "sha2(html, 256) AS html_sha256", "CAST(length(html) AS BIGINT) AS n_chars", "html")


SQL = """
SELECT page_id, url, sha256(html) AS html_sha256, length(html)::BIGINT AS n_chars, html FROM pages
"""
