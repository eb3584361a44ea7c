"""Token-id files: documents' ids compressed one by one with a shared zstandard dictionary.

A shard holds `MAGIC`, the SHA-256 of the dictionary, one zstandard frame a
document (its ids as little-endian unsigned 16-bit integers), then the index:
arrays of id, whether the id is null, the frame's offset and its number of
tokens; the file's last 16 bytes are the index' place and number of documents.
A short document is read with two seeks. The dictionary lies beside the shards,
named by its hash.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, hashed_sample, new_file, qualified, shuffle_partitions, text_of
from .words import default_path, encoder

MAGIC = b"TWIDS\x01\x00\x00"
#: Documents and bytes that a dictionary is trained on at most, the pieces' size, and its own size.
SAMPLE_DOCS, PIECE_BYTES, DICTIONARY_BYTES = 1000, 8192, 65_536
_INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("n_tokens", "<u8")])
FRAMES_A_BATCH = 2000


def make_dictionary(pieces: list[bytes], segment: int) -> bytes:
    """A zstandard dictionary trained on the pieces, or where training finds too little, of their content itself."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, pieces)) // 8), pieces, k=segment, d=8).as_bytes()
    except (ValueError, zstandard.ZstdError):
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def train_dictionary(docs: DataFrame, id_column: str = "doc_id", tokenizer: str | None = None) -> bytes:
    """A dictionary trained on a bounded sample: of the SAMPLE_DOCS documents with the least hashes of id and text, a window of at most PIECE_BYTES of the serialized ids, at a place set by the hash.

    Where the pieces are too few or too alike to train on, their last
    DICTIONARY_BYTES are the dictionary as they stand; it is empty only where
    there are no ids at all.
    """
    path = tokenizer or default_path()
    rows = docs.select(F.col(id_column).cast("string").alias("id"), text_of(docs).alias("text"))
    chosen = hashed_sample(rows, F.xxhash64("id", "text", F.lit("dictionary")), SAMPLE_DOCS).select("h", "text")

    def pieces(batches):
        for batch in batches:
            out = []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder(path).encode(text)
                at = 2 * (h % max(1, (len(ids) - PIECE_BYTES) // 2 + 1))
                out.append(ids[at : at + PIECE_BYTES])
            yield pa.RecordBatch.from_pydict({"piece": pa.array(out, pa.binary())})

    found = [bytes(r[0]) for r in chosen.mapInArrow(pieces, "piece binary").collect() if r[0]]
    return make_dictionary(found, 64)


def _compressor(dictionary: bytes, level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)


@functools.lru_cache(4)
def _decompressor(folder: str, digest: str):
    import zstandard

    files, path = file_system(folder)
    with files.open_input_file(f"{path}/dictionary-{digest}.zdict") as f:
        dictionary = f.read()
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"the dictionary in {folder} is not the one that its name tells")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_token_files(docs: DataFrame, folder: str, end_id: int = 1, id_column: str = "doc_id", tokenizer: str | None = None, level: int = 3) -> list[dict]:
    """Encodes every whole text (null: empty), adds end_id, and writes shards in ascending id order; returns the manifest, which also lies in the folder.

    Ids that are null come first; equal ids are ordered by their text. Other
    columns are ignored; an empty table writes a manifest without shards. Texts
    are dealt by ranges of (id, hash of text), so repeated ids may be any number,
    and each task encodes and writes one shard as a stream.
    """
    spark, path = docs.sparkSession, tokenizer or default_path()
    folder = qualified(spark, folder)
    dictionary = train_dictionary(docs, id_column, path)
    digest = hashlib.sha256(dictionary).hexdigest()
    with new_file(folder, f"dictionary-{digest}.zdict") as f:
        f.write(dictionary)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("tie", F.xxhash64("text"))
    end = np.array([end_id], "<u2").tobytes()

    def write(batches):
        made, index, name = _compressor(dictionary, level), [], f"shard-{TaskContext.get().partitionId():06d}.tids"
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        with new_file(folder, name) as out:
            at = out.write(MAGIC) + out.write(bytes.fromhex(digest))
            for batch in (b for part in ([first], batches) for b in part):
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                    ids = encoder(path).encode(text.as_py()) + end
                    doc_id = doc_id.as_py()
                    index.append((doc_id or 0, doc_id is None, at, len(ids) // 2))
                    at += out.write(made.compress(ids))
            table = np.array(index, _INDEX)
            out.write(table.tobytes())
            out.write(np.array([at, len(index)], "<u8").tobytes())
        row = {"shard": name, "n_docs": len(index), "n_tokens": int(table["n_tokens"].sum()), "n_bytes": at + table.nbytes + 16, **_range(table)}
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if k == "shard" else pa.int64()) for k, v in row.items()], list(row))

    dealt = rows.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    shards, start = [], 0
    for r in sorted(dealt.mapInArrow(write, "shard string, n_docs long, n_tokens long, n_bytes long, first_id long, last_id long").collect()):  # a row a shard
        shards.append({**r.asDict(), "start": start})
        start += r.n_tokens
    with new_file(folder, "manifest.json") as f:
        f.write(json.dumps({"dictionary": digest, "shards": shards}).encode())
    return shards


def _range(index: np.ndarray) -> dict[str, int | None]:
    """A shard's least and greatest id, by which documents are found; nulls if it has none."""
    ids = index["doc_id"][index["is_null"] == 0]
    return {"first_id": int(ids[0]) if len(ids) else None, "last_id": int(ids[-1]) if len(ids) else None}


def _open(folder: str, shard: str):
    files, path = file_system(folder)
    f = files.open_input_file(f"{path}/{shard}")
    head = f.read(len(MAGIC) + 32)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError(f"{shard} is not a token-id file")
    f.seek(f.size() - 16)
    at, n = np.frombuffer(f.read(16), "<u8")
    f.seek(int(at))
    return f, np.frombuffer(f.read(int(n) * _INDEX.itemsize), _INDEX), int(at), _decompressor(folder, head[len(MAGIC) :].hex())


def _ids(codec, frame: bytes, n_tokens: int) -> np.ndarray:
    ids = np.frombuffer(codec.decompress(frame), "<u2")
    if len(ids) != n_tokens:
        raise ValueError("a frame does not hold as many ids as the index says")
    return ids


def read_document(folder: str, doc_id: int) -> np.ndarray | None:
    """Ids of the first document with this id, by the manifest's ranges and one shard's offset index; None if there is none."""
    files, path = file_system(folder)
    with files.open_input_file(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    for s in manifest["shards"]:
        if s["first_id"] is None or not s["first_id"] <= doc_id <= s["last_id"]:
            continue
        f, index, end, codec = _open(folder, s["shard"])
        with f:
            k = np.flatnonzero((index["doc_id"] == doc_id) & (index["is_null"] == 0))
            if len(k):
                at = int(index["offset"][k[0]])
                f.seek(at)
                to = int(index["offset"][k[0] + 1]) if k[0] + 1 < len(index) else end
                return _ids(codec, f.read(to - at), int(index["n_tokens"][k[0]]))
    return None


def read_token_files(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary as little-endian unsigned 32-bit) of every document of the shards, a task a shard; start: the ids of all documents before."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not shards:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                f, index, end, codec = _open(folder, shard)
                with f:
                    starts = start + np.concatenate([[0], np.cumsum(index["n_tokens"].astype("i8"))])
                    f.seek(len(MAGIC) + 32)
                    ends = np.append(index["offset"][1:], np.uint64(end)).astype("i8")
                    for k in range(0, len(index), FRAMES_A_BATCH):
                        part = index[k : k + FRAMES_A_BATCH]
                        ids = [_ids(codec, f.read(int(to) - int(at)), int(n)).astype("<u4").tobytes() for at, to, n in zip(part["offset"], ends[k : k + FRAMES_A_BATCH], part["n_tokens"], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], mask=part["is_null"] == 1), pa.array(starts[k : k + len(part)]), pa.array(part["n_tokens"].astype("i8")), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    named = spark.createDataFrame([(s["shard"], s["start"]) for s in shards], "shard string, start long")
    return named.repartition(len(shards)).mapInArrow(read, schema)


def round_trip(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the documents' token-id files and reads them back."""
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder))


