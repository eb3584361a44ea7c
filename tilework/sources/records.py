"""Shards of length-prefixed, checksummed records (the TFRecord format) whose fields are named lists, as a data source and sink."""

from __future__ import annotations

import functools
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

from .tiled_images import files_of

# Fixed values of the format: the reversed polynomial of CRC-32C, and what masks a checksum.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8


def _shifted(value: int, steps: int) -> int:
    for _ in range(steps):
        value = (value >> 1) ^ (POLYNOMIAL if value & 1 else 0)
    return value


_TABLE = np.array([_shifted(i, 8) for i in range(256)], "u4")
#: Bytes of records that are read or written together; their checksums are summed beside each other.
TOGETHER = 4 << 20


@functools.cache
def _zeros(k: int) -> tuple[np.ndarray, np.ndarray]:
    """What the lower and the upper half of a sum become by 2 ** k zero bytes behind it."""
    if k == 0:
        ends = [1 << b for b in range(32)]
        ends = [int(_TABLE[v & 0xFF]) ^ v >> 8 for v in ends]
    else:
        low, high = _zeros(k - 1)
        once = [*(low[1 << b] for b in range(16)), *(high[1 << b] for b in range(16))]
        ends = [int(low[v & 0xFFFF] ^ high[v >> 16]) for v in once]
    halves = []
    for half in (ends[:16], ends[16:]):
        made = np.zeros(1, "u4")
        for v in half:
            made = np.concatenate([made, made ^ np.uint32(v)])
        halves.append(made)
    return halves[0], halves[1]


def _behind(sums: np.ndarray, k: int) -> np.ndarray:
    low, high = _zeros(k)
    return low[sums & 0xFFFF] ^ high[sums >> 16]


def _before_ones() -> bytes:
    """Four bytes that a sum of 0 becomes all ones by, which is what a checksum begins with."""
    at, crc = {int(v) >> 24: i for i, v in enumerate(_TABLE)}, 0xFFFFFFFF
    for _ in range(4):
        i = at[crc >> 24]
        crc = (crc ^ int(_TABLE[i])) << 8 & 0xFFFFFFFF | i
    return struct.pack("<I", crc)


_BEGIN = _before_ones()


def checksums(data: bytes, starts: list[int], stops: list[int], k: int = 8) -> np.ndarray:
    """CRC-32C of each data[start:stop]. All lanes of 2 ** k bytes are summed at once, a word of each at a time, and put together in pairs; zeros in front of a sum of 0 change nothing."""
    if not starts:
        return np.zeros(0, "u4")
    lanes = -(-(np.array(stops, "i8") - np.array(starts, "i8") + 4) >> k)
    ends = np.cumsum(lanes) << k
    padded, given = bytearray(int(ends[-1])), memoryview(data)
    for start, stop, end in zip(starts, stops, ends.tolist(), strict=True):
        at = end - stop + start
        padded[at - 4 : at] = _BEGIN
        padded[at:end] = given[start:stop]
    sums = np.zeros(len(padded) >> k, "u4")
    for word in np.frombuffer(padded, "<u4").reshape(-1, 1 << k - 2).T.copy():
        sums = _behind(sums ^ word, 2)
    while (lanes > 1).any():
        sums = np.insert(sums, (np.cumsum(lanes) - lanes)[lanes % 2 == 1], 0).reshape(-1, 2)
        sums = _behind(sums[:, 0], k) ^ sums[:, 1]
        lanes, k = lanes + 1 >> 1, k + 1
    return ~sums


def crc32c(data: bytes) -> int:
    return int(checksums(data, [0], [len(data)])[0])


def _masked(sums: np.ndarray) -> np.ndarray:
    return (sums >> 15 | sums << 17) + np.uint32(MASK_DELTA)


def masked(data: bytes) -> int:
    return int(_masked(checksums(data, [0], [len(data)]))[0])


def _places(sizes: list[int]) -> tuple[list[int], list[int]]:
    stops = np.cumsum(sizes).tolist()
    return [0, *stops[:-1]] if stops else [], stops


def framed_all(bodies: list[bytes]) -> list[bytes]:
    """Records with their lengths and checksums."""
    heads = np.array([len(x) for x in bodies], "<u8").tobytes()
    of_heads = _masked(checksums(heads, *_places([8] * len(bodies)), 4)).astype("<u4").tobytes()
    of_bodies = _masked(checksums(b"".join(bodies), *_places([len(x) for x in bodies]))).astype("<u4").tobytes()
    return [b"".join((heads[8 * i : 8 * i + 8], of_heads[4 * i : 4 * i + 4], x, of_bodies[4 * i : 4 * i + 4])) for i, x in enumerate(bodies)]


def framed(data: bytes) -> bytes:
    return framed_all([data])[0]


def unframed(file, name: str) -> Iterator[bytes]:
    """The records of an open file; a torn or changed one is an error."""
    rest = b""
    while data := rest + file.read(TOGETHER):
        at, starts, stops = 0, [], []
        while len(data) - at >= 12:
            end = at + 12 + struct.unpack_from("<Q", data, at)[0]
            if end + 4 > len(data):
                break
            starts.append(at + 12)
            stops.append(end)
            at = end + 4
        sums = lambda places: np.array([struct.unpack_from("<I", data, x)[0] for x in places], "u4")  # noqa: E731, B023
        if (_masked(checksums(data, [x - 12 for x in starts], [x - 4 for x in starts], 4)) != sums([x - 4 for x in starts])).any():
            raise ValueError(f"{name}: a record's length is damaged")
        if (_masked(checksums(data, starts, stops)) != sums(stops)).any():
            raise ValueError(f"{name}: a record is torn or damaged")
        for start, stop in zip(starts, stops, strict=True):
            yield data[start:stop]
        rest = data[at:]
        if not starts:  # one that is longer than what was read
            rest += file.read(max(0, 12 - len(rest)))
            if len(rest) < 12 or struct.unpack("<I", rest[8:12])[0] != masked(rest[:8]):
                raise ValueError(f"{name}: a record's length is damaged")
            missing = struct.unpack("<Q", rest[:8])[0] + 16 - len(rest)
            if len(more := file.read(missing)) < missing:
                raise ValueError(f"{name}: a record is torn or damaged")
            rest += more


def _varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def encode_fields(values: dict) -> bytes:
    """Named lists of bytes, numbers or integers as one message; a null field is left out."""
    out = b""
    for name in sorted(values):
        value = values[name]
        if value is None:
            continue
        some = list(value) if isinstance(value, list | tuple) else [value]
        first = next((x for x in some if x is not None), b"")
        if isinstance(first, float):
            kind = _field(2, _field(1, struct.pack(f"<{len(some)}f", *some)))
        elif isinstance(first, int):
            kind = _field(3, _field(1, b"".join(_varint(int(x)) for x in some)))
        else:
            kind = _field(1, b"".join(_field(1, x.encode() if isinstance(x, str) else bytes(x)) for x in some))
        out += _field(1, _field(1, name.encode()) + _field(2, kind))
    return _field(1, out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _parts(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire kind, value) of a message's fields."""
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _read_varint(data, at)
            yield tag >> 3, kind, value
            continue
        if kind == 2:
            n, at = _read_varint(data, at)
        else:
            n = {1: 8, 5: 4}[kind]
        yield tag >> 3, kind, data[at : at + n]
        at += n


def decode_fields(message: bytes) -> dict[str, list]:
    """The lists of encode_fields() by name; packed and single numbers are both read."""
    out: dict[str, list] = {}
    for _, _, features in _parts(message):
        for _, _, entry in _parts(features):
            name, found = "", []
            for number, _, value in _parts(entry):
                if number == 1:
                    name = value.decode()
                    continue
                for which, _, values in _parts(value):
                    for _, kind, x in _parts(values):
                        if which == 1:
                            found.append(x)
                        elif which == 2:
                            found += struct.unpack(f"<{len(x) // 4}f", x)
                        elif kind == 0:
                            found.append(x - (1 << 64) if x >> 63 else x)
                        else:
                            at = 0
                            while at < len(x):
                                v, at = _read_varint(x, at)
                                found.append(v - (1 << 64) if v >> 63 else v)
            out[name] = found
    return out


_INTEGERS, _NUMBERS = (ByteType, ShortType, IntegerType, LongType), (FloatType, DoubleType)


def _as(found: list | None, kind):
    if isinstance(kind, ArrayType):
        return None if found is None else [_as([x], kind.elementType) for x in found]
    if not found:
        return None
    if isinstance(kind, StringType):
        return found[0].decode()
    return bytes(found[0]) if isinstance(kind, BinaryType) else found[0]


class Shard(InputPartition):
    def __init__(self, path: str):
        super().__init__(None)
        self.path = path


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.wanted = options, schema

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = files_of(self.options["path"])
        scheme = self.options["path"].split("://")[0] + "://" if "://" in self.options["path"] else ""
        if files.get_file_info(root).type != fs.FileType.Directory:
            return [Shard(scheme + root)]
        found = sorted(f.path for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".tfrecords") and not os.path.basename(f.path).startswith("."))
        return [Shard(scheme + p) for p in found] or [Shard("")]

    def read(self, partition: Shard):
        if not partition.path:
            return
        files, path = files_of(partition.path)
        with files.open_input_stream(path) as f:
            for message in unframed(f, path):
                found = decode_fields(message)
                yield tuple(_as(found.get(c.name), c.dataType) for c in self.wanted.fields)


@dataclass
class Written(WriterCommitMessage):
    drafts: list[tuple[str, str]]


class RecordWriter(DataSourceWriter):
    """Tasks write drafts, which no reader sees; the job's commit gives them their names, its abort removes them."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, schema.names
        self.job = uuid.uuid4().hex

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        files, root = files_of(self.options["path"])
        split, part, open_now, drafts = self.options.get("split"), TaskContext.get().partitionId() if TaskContext.get() else 0, {}, []
        kinds, held, size = [c for c in self.names if c != split], [], 0

        def put():
            for (where, _), record in zip(held, framed_all([x for _, x in held]), strict=True):
                open_now[where].write(record)
            held.clear()

        try:
            for row in rows:
                where = f"{root}/{row[split]}" if split else root
                if where not in open_now:
                    files.create_dir(where, recursive=True)
                    draft = f"{where}/.{self.job}-{part}-{uuid.uuid4().hex}"
                    drafts.append((draft, f"{where}/{part}-{self.job[:8]}.tfrecords"))
                    open_now[where] = files.open_output_stream(draft)
                held.append((where, encode_fields({c: row[c] for c in kinds})))
                if (size := size + len(held[-1][1])) >= TOGETHER:
                    put()
                    size = 0
            put()
            for out in open_now.values():
                out.close()
        except BaseException:
            for out in open_now.values():
                out.close()
            for draft, _ in drafts:
                files.delete_file(draft)
            raise
        return Written(drafts)

    def commit(self, messages) -> None:
        files, root = files_of(self.options["path"])
        files.create_dir(root, recursive=True)
        for m in messages:
            for draft, name in m.drafts if m else []:
                files.move(draft, name)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        """Removes drafts of this job, also those of attempts that were lost."""
        from pyarrow import fs

        files, root = files_of(self.options["path"])
        for f in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if os.path.basename(f.path).startswith(f".{self.job}-"):
                files.delete_file(f.path)


class Records(DataSource):
    """format("records"): reading takes the schema of the fields; writing takes the option split, a column that names the folder of a row's shard."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "image binary, name string, dims long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RecordWriter(dict(self.options), schema)


def read_records(spark: SparkSession, path: str, schema: str = "image binary, name string, dims long") -> DataFrame:
    spark.dataSource.register(Records)
    return spark.read.format("records").schema(schema).load(path)


def write_records(rows: DataFrame, path: str, n_shards: int, split: str | None = None) -> None:
    """Appends rows as n_shards shards, in a folder for each value of `split` if given; rows are dealt by the hash of all they hold, so none of a split's or slide's rows make a shard large."""
    rows.sparkSession.dataSource.register(Records)
    dealt = rows.repartition(n_shards, F.xxhash64(*[F.col(c) for c in rows.columns]))
    dealt.write.format("records").mode("append").options(**({"split": split} if split else {})).save(path)
