"""Scores of two language models learnt from the corpus: words alone, and prediction by partial matching over bytes.

The byte model is a trie of contexts of up to ORDER bytes, kept as two tables:
how often each byte follows each context, and each context's totals. All
contexts of all training texts are in them, so they grow with the corpus; no
worker ever holds them. A context predicts the bytes seen after it, and escapes
(method C: its number of different followers against all it saw) to the context
one byte shorter, where the bytes already ruled out are excluded; below the
empty context all bytes left are alike. Every text ends with the byte END and
begins after ORDER bytes BEGIN, neither of which is valid in UTF-8.

Texts are dealt in blocks of about BLOCK_BYTES. A block asks for each of its
different words and grams (a context and the byte after it) once, and meets its
own answers only: grams' probabilities by joins, and how often a word was seen,
unless no other block's training texts have it.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import in_small_batches, saved, text_of

ORDER = 4
BEGIN, END = 0xFE, 0xFF
BLOCK_BYTES = 16 << 20
#: Positions whose grams are counted at once (and looked up at once: a worker holds some ten arrays of as many numbers then); longer words go by a digest, led by a space, which no word has.
STEP, LOOKED_UP, WORD_BYTES = 1 << 20, 1 << 17, 64
MODULUS, HELD_OUT = 7, 2


def is_held_out(id_column: Column) -> Column:
    """crc32 of the id as text, modulo MODULUS, is HELD_OUT; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(MODULUS)) == HELD_OUT


def _lower(text: str) -> bytes:
    return text.encode().lower()


def _words(data: bytes) -> list[bytes]:
    words = data.split()
    if len(data) > WORD_BYTES and max(map(len, words), default=0) > WORD_BYTES:
        words = [w if len(w) <= WORD_BYTES else b" " + xxhash.xxh128_digest(w) for w in words]
    return words


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each after ORDER times BEGIN and with END, and where each begins in that."""
    lead, tail = bytes([BEGIN] * ORDER), bytes([END])
    sizes = np.fromiter(map(len, texts), "i8", len(texts)) + ORDER + 1
    return np.frombuffer(b"".join([x for t in texts for x in (lead, t, tail)]), "u1"), np.cumsum(sizes) - sizes


def grams(stream: np.ndarray, first: int, last: int) -> np.ndarray:
    """For each position from first to last: the ORDER bytes before it and its own, as one number; first is at least ORDER."""
    s = stream[first - ORDER : last].astype("i8")
    out = s[: last - first]
    for k in range(1, ORDER + 1):
        out = (out << 8) | s[k : k + last - first]
    return out


def in_blocks(rows: DataFrame) -> DataFrame:
    """Adds `block` to (doc_id, text, held_out): about BLOCK_BYTES of neighbouring texts, or one longer text, have one number."""

    def add(batches):
        at, base = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype("i8") + 16
            ends = at + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + (ends - sizes) // BLOCK_BYTES)], [*batch.schema.names, "block"])
            at = int(ends[-1]) if len(ends) else at

    return rows.mapInArrow(add, "doc_id long, text string, held_out boolean, block long")


# -- training ---------------------------------------------------------------


class _Block:
    """What the texts of one block ask for, and what its training texts teach."""

    def __init__(self):
        self.words: dict[bool, Counter] = {False: Counter(), True: Counter()}
        self.codes, self.counts = np.zeros(0, "i8"), np.zeros(0, "i8")
        self.waiting: list[bytes] = []
        self.waiting_held: list[bool] = []
        self.size = 0

    def add(self, data: bytes, held: bool) -> None:
        self.words[held].update(_words(data))
        self.words[held][b""] += 1
        self.waiting.append(data)
        self.waiting_held.append(held)
        self.size += len(data)
        if self.size >= STEP:
            self._count()

    def _count(self) -> None:
        for held in (False, True):
            stream, _ = _stream([d for d, h in zip(self.waiting, self.waiting_held, strict=True) if h == held])
            for at in range(ORDER, len(stream), STEP):
                to = min(at + STEP, len(stream))
                found, n = np.unique(grams(stream, at, to)[stream[at:to] != BEGIN], return_counts=True)
                codes, where = np.unique(np.concatenate([self.codes, found]), return_inverse=True)
                self.counts = np.bincount(where, np.concatenate([self.counts, n * (not held)]), len(codes)).astype("i8")
                self.codes = codes
        self.waiting, self.waiting_held, self.size = [], [], 0

    def asked(self, block: int):
        """Batches (block, code, word, trained); the end of a text is the word ''."""
        if self.waiting:
            self._count()
        names = ["block", "code", "word", "trained"]
        for at in range(0, len(self.codes), 1 << 17):
            c, n = self.codes[at : at + (1 << 17)], self.counts[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), block)), pa.array(c), pa.nulls(len(c), pa.binary()), pa.array(n)], names)
        taught = self.words[False]
        words = list(taught.keys() | self.words[True].keys())
        for at in range(0, len(words), 1 << 16):
            some = words[at : at + (1 << 16)]
            n = np.array([taught[w] for w in some], "i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.nulls(len(some), pa.int64()), pa.array(some, pa.binary()), pa.array(n)], names)


def asked(blocks: DataFrame) -> DataFrame:
    """(block, code, word, trained): each block's different grams (code) and words, with their numbers in its training texts."""

    def count(batches):
        now, block = None, None
        for batch in batches:
            for text, held, b in zip(batch.column("text"), batch.column("held_out").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if b != block:
                    if now is not None:
                        yield from now.asked(block)
                    now, block = _Block(), b
                now.add(_lower(text.as_py() or ""), held)
        if now is not None:
            yield from now.asked(block)

    return blocks.select("text", "held_out", "block").mapInArrow(count, "block long, code long, word binary, trained long")


def _suffix(code: Column, n: int) -> Column:
    """The last n bytes of a gram."""
    return code.bitwiseAND(F.lit((1 << 8 * n) - 1))


def count_trie(grams_counted: DataFrame) -> DataFrame:
    """(k, code, n) out of (code, n): how often each byte follows each context of k bytes, k from 0 to ORDER."""
    levels = F.array(*[F.struct(F.lit(k).alias("k"), _suffix(F.col("code"), k + 1).alias("code")) for k in range(ORDER + 1)])
    return grams_counted.where("n > 0").select("n", F.inline(levels)).groupBy("k", "code").agg(F.sum("n").alias("n"))


def contexts_of(trie: DataFrame) -> DataFrame:
    """(k, context, seen, kinds, below): how often each context was seen, its different followers, and how often those followed the context one byte shorter."""
    shorter = trie.select((F.col("k") + 1).alias("k"), F.col("code").alias("end"), F.col("n").alias("m"))
    mask = F.shiftleft(F.lit(1).cast("long"), 8).cast("long")
    for k in range(2, ORDER + 1):
        mask = F.when(F.col("k") == k, F.lit(1 << 8 * k)).otherwise(mask)
    with_end = trie.withColumn("end", F.when(F.col("k") > 0, F.col("code").bitwiseAND(mask - 1)).otherwise(F.lit(-1)))
    return with_end.join(shorter, ["k", "end"], "left").groupBy("k", F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("seen"), F.count("*").alias("kinds"), F.coalesce(F.sum("m"), F.lit(0)).alias("below"))


def _escapes(kinds: Column, left: Column) -> Column:
    """The weight of an escape: none where all bytes that are left are among the followers."""
    return F.when(kinds < left, kinds).otherwise(F.lit(0))


def probabilities(codes: DataFrame, trie: DataFrame, contexts: DataFrame) -> DataFrame:
    """(code, log10) of each of `codes` (code, n): by its longest context where it was seen (n > 0), else down the chain of escapes."""
    at = lambda k: contexts.where(F.col("k") == k).drop("k")
    top = codes.join(at(ORDER), F.shiftright("code", 8) == F.col("context"), "left").drop("context")
    seen = top.where("n > 0").select("code", F.log10(F.col("n") / (F.col("seen") + _escapes(F.col("kinds"), F.lit(256)))).alias("log10"))
    # Of bytes not found yet: log10 of the escapes, followers excluded, and how often those followed the next shorter context.
    out = top.where("n = 0").select(
        "code", F.lit(None).cast("double").alias("found"), F.coalesce(F.log10(_escapes(F.col("kinds"), F.lit(256)) / (F.col("seen") + _escapes(F.col("kinds"), F.lit(256)))), F.lit(0.0)).alias("escaped"),
        F.coalesce("kinds", F.lit(0)).alias("excluded"), F.coalesce("below", F.lit(0)).alias("ruled_out"),
    )
    for k in range(ORDER - 1, -1, -1):
        here, followers = at(k), trie.where(F.col("k") == k).select(F.col("code").alias("gram"), "n")
        if k < 2:  # at most 256 contexts and 65,536 grams
            here, followers = F.broadcast(here), F.broadcast(followers)
        met = out.join(here, F.shiftright(_suffix(F.col("code"), k + 1), 8) == F.col("context"), "left").join(followers, _suffix(F.col("code"), k + 1) == F.col("gram"), "left")
        kinds, total = F.coalesce("kinds", F.lit(0)) - F.col("excluded"), F.coalesce("seen", F.lit(0)) - F.col("ruled_out")
        escapes = _escapes(kinds, 256 - F.col("excluded"))
        known = F.when(F.col("found").isNotNull(), F.col("found")).when(F.col("n").isNotNull(), F.col("escaped") + F.log10(F.col("n") / (total + escapes)))
        out = met.select(
            "code", known.alias("found"), (F.col("escaped") + F.when(kinds > 0, F.log10(escapes / (total + escapes))).otherwise(0.0)).alias("escaped"),
            F.coalesce("kinds", "excluded").alias("excluded"), F.coalesce("below", F.lit(0)).alias("ruled_out"),
        )
    rest = out.select("code", F.coalesce("found", F.col("escaped") - F.log10(F.greatest(256 - F.col("excluded"), F.lit(1)))).alias("log10"))
    return seen.unionByName(rest)


# -- scoring ----------------------------------------------------------------


class _Answers:
    """A block's grams and their log10, looked up by arrays of grams: most by a table of slots, others by bisection."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order]
        self.shift = np.uint64(64 - max(8, (4 * len(codes)).bit_length()))
        slots = self._slots(self.codes)
        self.table = np.full(1 << int(64 - self.shift), -1, "i4")  # a block's grams are fewer than its bytes
        self.table[slots] = np.arange(len(slots))

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (codes.view("u8") * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype("i8")

    def get(self, codes: np.ndarray) -> np.ndarray:
        at = self.table[self._slots(codes)]
        miss = np.flatnonzero(self.codes[at] != codes)
        at[miss] = np.searchsorted(self.codes, codes[miss])
        return self.values[at]


def code_lengths(texts: list[bytes], answers: _Answers) -> np.ndarray:
    """log10 probability of each text and its end."""
    stream, starts = _stream(texts)
    out = np.zeros(len(texts))
    step = min(STEP, LOOKED_UP)
    for at in range(ORDER, len(stream), step):
        to = min(at + step, len(stream))
        real = np.flatnonzero(stream[at:to] != BEGIN)
        got = np.zeros(to - at)
        got[real] = answers.get(grams(stream, at, to)[real])
        first, last = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, to, "left")
        out[first:last] += np.add.reduceat(got, np.maximum(starts[first:last] - at, 0))
    return out


def score(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of each row of docs, over whole texts.

    A null text counts as empty (its end is still scored), a null id as the text
    ''; repeated rows are scored each; other columns are ignored; an empty table
    gives no rows. With no training text at all every byte is as likely as any
    other.
    """
    rows = in_small_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("held_out", is_held_out(F.col("doc_id")))
    blocks = saved(in_blocks(rows), "blocks")
    wanted = saved(asked(blocks), "asked")
    of_words, of_grams = wanted.where("word is not null"), wanted.where("word is null")
    by_word = Window.partitionBy("word")
    summed = of_words.select("block", "word", "trained", F.sum("trained").over(by_word).alias("total"), F.row_number().over(by_word.orderBy("block")).alias("place"))
    totals = Observation()
    words = saved(summed.observe(totals, F.sum("trained").alias("n"), F.count_if((F.col("place") == 1) & (F.col("total") > 0)).alias("v")).where("total <> trained").select("block", "word", "total"), "words")
    n_train, v = (totals.get[x] or 0 for x in "nv")
    codes = saved(of_grams.groupBy("code").agg(F.sum("trained").alias("n")), "grams")
    trie = saved(count_trie(codes), "trie")
    values = saved(probabilities(codes, trie, saved(contexts_of(trie), "contexts")), "probabilities")
    answers = of_grams.select("block", "code").join(values, "code").select("block", "code", F.lit(None).cast("binary").alias("word"), F.col("log10").alias("value"))
    answers = answers.unionByName(words.select("block", F.lit(None).cast("long").alias("code"), "word", F.log10(F.col("total") + 1).alias("value")))
    share = math.log10(n_train + v + 1)

    def scored(texts: pa.Table, found: pa.Table) -> pa.Table:
        is_word = found.column("word").is_valid()
        by_word = found.select(["word", "value"]).filter(is_word)
        taught: Counter = Counter()
        for text, held in zip(texts.column("text"), texts.column("held_out").to_pylist(), strict=True):
            if not held:
                taught.update(_words(_lower(text.as_py() or "")))
                taught[b""] += 1
        logs_of: dict = taught  # the same keys, so one dictionary does
        for w, n in taught.items():
            logs_of[w] = math.log10(n + 1)
        for batch in by_word.to_batches(1 << 14):
            dict.update(logs_of, zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        by_code = found.select(["code", "value"]).filter(pc.invert(is_word))
        known = _Answers(by_code.column("code").to_numpy(), by_code.column("value").to_numpy())
        del found, by_word, by_code
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "n_bytes": []}
        scores, waiting, size = [], [], 0
        of_word = logs_of.get
        for text in texts.column("text"):
            data = _lower(text.as_py() or "")
            logs = [of_word(w, 0.0) for w in (*_words(data), b"")]
            out["n_tokens"].append(len(logs))
            out["n_known"].append(len(logs) - logs.count(0.0))
            out["base_score"].append(math.fsum(logs) - len(logs) * share)
            out["n_bytes"].append(len(data))
            waiting.append(data)
            size += len(data)
            if size >= STEP:
                scores.append(code_lengths(waiting, known))
                waiting, size = [], 0
        scores.append(code_lengths(waiting, known))
        n = texts.num_rows
        columns = {"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": out["n_tokens"], "n_known": out["n_known"], "train_tokens": np.full(n, n_train), "base_score": out["base_score"], "score": np.concatenate(scores), "n_bytes": out["n_bytes"]}
        return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v) for k, v in columns.items()})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)
