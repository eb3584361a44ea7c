"""WARC archives, compressed record by record with a Zstandard dictionary made from archived records.

A file starts with a skippable frame (magic number 0x184D2A5D) that holds the
dictionary, itself compressed; then comes one Zstandard frame a record. Records
with equal payloads are revisits of the one with the least page id.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, hashed_sample, lookup, new_file, qualified, saved, text_of
from .token_files import make_dictionary

DICTIONARY_FRAME = 0x184D2A5D
#: Records that the dictionary is made from at most, and bytes of each; its own size is bounded by token_files.DICTIONARY_BYTES.
SAMPLE_RECORDS, SAMPLE_BYTES = 1000, 8192
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f1d2c0a-7f0b-4c53-9a39-5f0f7f1b2a77")
CAPTURED = "2020-01-01T00:00:00Z"  # pages carry no date; a fixed one keeps equal input equal
READ_BYTES = 1 << 20


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or with refers_to a revisit that keeps the HTTP head only."""
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {CAPTURED}",
        "WARC-Target-URI: " + " ".join((url or f"urn:page:{page_id}").split()),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def assign_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses.

    Of rows with equal payloads of min_bytes or more, those with the least
    page_id are responses; smaller payloads, payloads whose ids are all null, and
    a repeated row of the least id are responses, too. A null html is empty.
    """
    html = text_of(pages, "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("payload", F.sha1("html"))
    eligible = rows.where(F.octet_length("html") >= min_bytes)
    firsts = saved(eligible.groupBy("payload").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "firsts")
    found = lookup(rows, firsts.where("n > 1"), "payload", "n")
    return found.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def train_dictionary(pages: DataFrame) -> bytes:
    """Made from a bounded sample: the records of the SAMPLE_RECORDS pages with the least hashes of id and address, SAMPLE_BYTES of each from a place set by the hash.

    Where they are too few or too alike to train on, their content itself; empty only for an empty table.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of(pages, "html").alias("html"))
    chosen = hashed_sample(rows, F.xxhash64("page_id", "url", F.lit("dictionary")), SAMPLE_RECORDS)

    def pieces(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                whole = record(r["page_id"], r["url"], r["html"].encode(), None)
                at = r["h"] % max(1, len(whole) - SAMPLE_BYTES + 1) if r["h"] % 2 else 0
                out.append(whole[at : at + SAMPLE_BYTES])
            yield pa.RecordBatch.from_pydict({"piece": pa.array(out, pa.binary())})

    found = [bytes(r[0]) for r in chosen.mapInArrow(pieces, "piece binary").collect()]
    return make_dictionary(found, 128)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3) -> DataFrame:
    """Writes every page (page_id, url, html; other columns are ignored) as a record, a file a task; returns the table (file, n_records) of what was written.

    An empty table writes no file. The dictionary is at most DICTIONARY_BYTES.
    """
    import zstandard

    folder = qualified(pages.sparkSession, folder)
    dictionary = train_dictionary(pages)
    packed = zstandard.ZstdCompressor().compress(dictionary) if dictionary else b""
    head = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed if packed else b""

    def write(batches):
        made = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        name, n = f"pages-{TaskContext.get().partitionId():06d}.warc.zst", 0
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        with new_file(folder, name) as out:
            out.write(head)
            for batch in (b for part in ([first], batches) for b in part):
                for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                    out.write(made.compress(record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py())))
                n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([n], pa.int64())})

    return saved(assign_revisits(pages, min_bytes).mapInArrow(write, "file string, n_records long"), "archives")


class _Records:
    """The records of one archive, decompressed and parsed as a stream: (headers, block)."""

    def __init__(self, source):
        import zstandard

        magic, size = struct.unpack("<II", source.read(8).ljust(8, b"\0"))
        dictionary = b""
        if magic == DICTIONARY_FRAME:
            dictionary = zstandard.ZstdDecompressor().decompress(source.read(size))
        else:
            source.seek(0)
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.stream, self.buffer = codec.stream_reader(source, read_across_frames=True), bytearray()

    def _more(self) -> bool:
        got = self.stream.read(READ_BYTES)
        self.buffer += got
        return bool(got)

    def _take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def __iter__(self):
        while self.buffer or self._more():
            while (end := self.buffer.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    raise ValueError("an archive ends within a head")
            first, *lines = self._take(end + 4)[:-4].decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = dict(x.split(": ", 1) for x in lines)
            yield headers, self._take(int(headers["Content-Length"]) + 4)[:-4]


def read_archives(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of the files.

    Sizes and digests of responses are those of the payload read; a digest that
    its head contradicts is an error. Revisits tell theirs in their heads and
    have no payload.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def parse(headers: dict, block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split(b": ")[1])
        told, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
        if kind == "response":
            if (size, told) != (len(payload), _digest(payload)):
                raise ValueError(f"the payload of {headers['WARC-Record-ID']} is not the one that was archived")
        page_id, refers_to = headers.get("Page-Id"), headers.get("Refers-To-Page-Id")
        return page_id and int(page_id), headers["WARC-Target-URI"], size, told, kind, refers_to and int(refers_to), payload if kind == "response" else None

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found, held = [], 0
                fs, path = file_system(folder)
                with fs.open_input_file(f"{path}/{name}") as f:
                    for headers, block in _Records(f):
                        found.append(parse(headers, block))
                        held += len(block)
                        if held > 8 << 20 or len(found) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
                            found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(read, schema)
