"""SentencePiece BPE with seeded merge dropout, and its lossless decoding.

A word is merged by an agenda of candidate pairs, best score first and then
leftmost, as the library does; with dropout, a candidate taken from the agenda
is skipped if the keyed hash of (seed, text, occurrence, place, merged piece)
falls below the rate, and comes back when its neighbourhood changes. Texts are
cut where no piece of the vocabulary could join the sides, into parts (words,
runs of signs), and every occurrence of a part draws for itself.

What follows from a part and the decisions made so far (which candidate comes
next, or the pieces left at the end) is the same for all its occurrences, so
workers keep it as a tree of decisions: occurrences walk down their parts' trees
together, in arrays. Those that leave the tree, and parts without one, are
merged many at once, a row of an array each, whose agendas go on in step; a way
that enough occurrences left by is added. The tree holds no draws, and its
size bounds memory, not what can come out.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with, text_of

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: Parts, words and decisions that a worker remembers at most; the longest part merged in arrays; characters of text cut at once.
PARTS_KEPT, WORDS_KEPT, NODES_KEPT, ROW_LENGTH, STEP_CHARS = 500_000, 500_000, 2_000_000, 24, 2_000_000
#: The table of pairs: its size, and the factor its places are made by.
SLOT_BITS, PAIR_HASH = 20, 0x9E3779B97F4A7C15
#: Where a way of the tree leads: nowhere yet (each occurrence that went there counts one down from NEW; at GROWN it is added), or to pieces (LEAVES - number).
NEW, GROWN, LEAVES = -1, -12, -13
#: Documents that are encoded together.
ROWS_AT_ONCE = 1000
#: Marks a word that is not led by one space (no text has this code): what follows is the word with its spaces.
NOT_LED = "\ud800"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class MergeDropout:
    """encode(text) gives ids as little-endian unsigned 16-bit integers, decode(ids) the text."""

    def __init__(self, path: str, rate: float, seed: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if n > 65_536:
            raise ValueError("ids of this vocabulary do not fit in 16 bits")
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.costs = {p: -sp.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.rate, self.seed = int(rate * 2**32), seed
        self.words: dict[str, int | list[int]] = {}  # the numbers of a word's parts
        self.part_numbers: dict[str, int] = {}
        self.part_texts: list[str] = []
        self.roots = np.full(1024, NEW, "i4")
        self.salts, self.ways, self.n_nodes = np.zeros(1024, "u8"), np.full((1024, 2), NEW, "i4"), 0
        self.leaves: list[bytes] = [b""]
        # Spaces lead pieces or make them up, so no merge crosses the start of a run of spaces.
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("this vocabulary has pieces with inner spaces; words can't be encoded one by one")
        # Nor does one cross from a letter to a sign that follows no letter in any piece, nor into a sign of no piece.
        signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"
        met = {p[i + 1] for p in self.ids for i in range(len(p) - 1) if re.match(f"[{letters}]", p[i])}
        self.cut = re.compile(f"(?<=[^{SPACE}])(?={SPACE})|(?<=[{letters}])(?=[{''.join(map(re.escape, [c for c in signs if c not in met] or ['\n']))}])" + "|(?<=\n)|(?=\n)" * ("\n" not in "".join(self.ids))).split
        text = [b""] * n
        for p, i in self.ids.items():
            text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            text[i] = bytes([b])
        self.text = text
        # For arrays: the symbol of each character, and what two symbols next to each other merge into.
        self.symbol = np.arange(0x110000, dtype="i8") + (1 << 20)
        for c in {c for p in self.ids for c in p}:
            self.symbol[ord(c)] = self.ids.get(c, ord(c) + (1 << 20))
        symbol_of = lambda p: int(self.symbol[ord(p)]) if len(p) == 1 else self.ids.get(p)
        joins = {(a << 22) | b: i for p, i in self.ids.items() for k in range(1, len(p)) if (a := symbol_of(p[:k])) is not None and (b := symbol_of(p[k:])) is not None}
        self.slots = np.full(1 << SLOT_BITS, -1, "i8")  # open addressing: pairs of symbols, and the ids they merge into
        self.slot_ids = np.full(1 << SLOT_BITS, n, "i4")
        if len(joins) * 4 > len(self.slots):
            raise ValueError("this vocabulary has too many merges for the table of pairs")
        for pair, i in joins.items():
            h = (pair * PAIR_HASH & 0xFFFFFFFFFFFFFFFF) >> (64 - SLOT_BITS)
            while self.slots[h] >= 0:
                h = (h + 1) % len(self.slots)
            self.slots[h], self.slot_ids[h] = pair, i
        self.cost = np.full(n + 1, np.inf, "f4")  # the last entry: no merge
        self.cost[normal] = [-sp.get_score(i) for i in normal]
        self.literal = [np.array([b], "<u2").tobytes() for b in self.bytes]

    def _salt(self, place: int, piece: str) -> int:
        return (place * 0x9E3779B1 + self.ids[piece] * 0x85EBCA77) & 0xFFFFFFFFFFFFFFFF

    def _skipped(self, key: int, salt: int) -> bool:
        x = (key ^ salt) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF
        return (x ^ x >> 29) * 0x165667B19E3779F9 >> 32 & 0xFFFFFFFF < self.rate

    def merge(self, word: str, key: int, met: list[tuple[int, bool]] | None = None) -> list[str]:
        """The pieces of a part (spaces as SPACE) under an occurrence's key; `met` gets the candidates' salts and whether they were skipped."""
        n = len(word)
        piece, before, after = list(word), list(range(-1, n - 1)), [*range(1, n), -1]
        cost = self.costs.get
        agenda = [(c, i, i + 1, word[i : i + 2]) for i in range(n - 1) if (c := cost(word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            if not piece[left] or not piece[right] or after[left] != right or len(piece[left]) + len(piece[right]) != len(both):
                continue
            salt = self._salt(left, both)
            skipped = self._skipped(key, salt)
            if met is not None:
                met.append((salt, skipped))
            if skipped:
                continue
            piece[left], piece[right] = both, ""
            after[left] = then = after[right]
            if then >= 0:
                before[then] = left
                if (c := cost(more := both + piece[then])) is not None:
                    heapq.heappush(agenda, (c, left, then, more))
            if (first := before[left]) >= 0 and (c := cost(more := piece[first] + both)) is not None:
                heapq.heappush(agenda, (c, first, left, more))
        return [p for p in piece if p]

    def _serialized(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            found = self.ids.get(p)
            out += [self.bytes[b] for b in p.encode()] if found is None else [found]
        return np.array(out, "<u2").tobytes()

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids that pairs of symbols merge into, or len(text) for none; symbols below 0 are gaps."""
        pair = np.where((left >= 0) & (right >= 0), (left.astype("i8") << 22) | right, -2)
        with np.errstate(over="ignore"):
            h = (pair.view("u8") * np.uint64(PAIR_HASH) >> np.uint64(64 - SLOT_BITS)).astype("i8")
        met = self.slots[h]
        out = np.where(met == pair, self.slot_ids[h], len(self.text)).astype("i4")
        on = np.flatnonzero((met != pair) & (met >= 0))
        while len(on):
            h[on] = (h[on] + 1) % len(self.slots)
            met = self.slots[h[on]]
            found = met == pair[on]
            out[on[found]] = self.slot_ids[h[on[found]]]
            on = on[~found & (met >= 0)]
        return out

    def merge_many(self, parts: list[str], keys: np.ndarray) -> list[bytes]:
        """merge() of parts of up to ROW_LENGTH characters, serialized: in each round every row takes the best candidate off its agenda.

        A row has a place for each character and one more, which stays a gap; the
        symbols left are chained by `before` and `after`.
        """
        n, width, none = len(parts), max(map(len, parts)) + 1, len(self.text)
        size = np.fromiter(map(len, parts), "i8", n)
        code = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        symbols = np.full(n * width, -1, "i4")
        spot = np.repeat(np.arange(n) * width, size) + place
        symbols[spot] = self.symbol[code]
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        into = np.full(n * width, none, "i4")
        into[:-1] = self._join(symbols[:-1], symbols[1:])
        costs = self.cost[into].reshape(n, width)
        flat = costs.reshape(-1)
        rows = np.arange(n)
        while len(rows):
            j = costs[rows].argmin(1)
            at = rows * width + j
            live = np.isfinite(flat[at])
            rows, at, j = rows[live], at[live], j[live]
            new = into[at]
            with np.errstate(over="ignore"):
                skipped = self._draw(keys[rows], j.astype("u8") * np.uint64(0x9E3779B1) + new.astype("u8") * np.uint64(0x85EBCA77))
            flat[at[skipped]] = np.inf
            at, new = at[~skipped], new[~skipped]
            gone = after[at]
            then = after[gone]
            symbols[at], symbols[gone], flat[gone] = new, -1, np.inf
            after[at], before[then] = then, at
            into[at] = self._join(new, symbols[then])
            flat[at] = self.cost[into[at]]
            first = at % width > 0
            at, left = at[first], before[at[first]]
            into[left] = self._join(symbols[left], symbols[at])
            flat[left] = self.cost[into[left]]
        done = symbols.reshape(n, width)
        out, kept = [], done >= 0
        plain = (done < (1 << 20)) | ~kept
        serial, ends, fine = done[kept].astype("<u2").tobytes(), np.cumsum(kept.sum(1)) * 2, plain.all(1)
        start = 0
        for i, (end, ok) in enumerate(zip(ends.tolist(), fine.tolist(), strict=True)):
            out.append(serial[start:end] if ok else b"".join([self.text_bytes(x) for x in done[i][kept[i]].tolist()]))
            start = end
        return out

    def text_bytes(self, symbol: int) -> bytes:
        """The id of a symbol; of a character that is no piece, those of its bytes."""
        if symbol < (1 << 20):
            return np.array([symbol], "<u2").tobytes()
        return self._literal(chr(symbol - (1 << 20)))

    def _draw(self, keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """_skipped() of arrays."""
        x = (keys ^ salts) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) >> np.uint64(32)) < np.uint64(self.rate)

    def _literal(self, part: str) -> bytes:
        return b"".join([self.literal[b] for b in part.encode()])

    def _cut_word(self, word: str) -> list[str]:
        """The parts of a word; a run of the sign itself keeps its mark."""
        if word.isalpha():  # nothing to cut at
            return [SPACE + word]
        if word[:2] == NOT_LED + SPACE:
            return [word]
        return [p for p in self.cut(SPACE + word if word[:1] != NOT_LED else word[1:].replace(" ", SPACE)) if p]

    def _number(self, part: str, strangers: list[str]) -> int:
        """A part's number; one that is not remembered gets a negative one, of this batch."""
        found = self.part_numbers.get(part)
        if found is None:
            if len(part) > 64 or len(self.part_texts) >= PARTS_KEPT:
                strangers.append(part)
                return -len(strangers)
            self.part_numbers[part] = found = len(self.part_texts)
            self.part_texts.append(part)
            if found >= len(self.roots):
                self.roots = np.concatenate([self.roots, np.full(len(self.roots), NEW, "i4")])
        return found

    def _numbers(self, word: str, strangers: list[str]) -> int | list[int]:
        found = [self._number(p, strangers) for p in self._cut_word(word)]
        out = found[0] if len(found) == 1 else found
        if len(self.words) < WORDS_KEPT and len(word) <= 64 and min(found, default=0) >= 0:
            self.words[word] = out
        return out

    def _grow(self, part: int, key: int) -> None:
        """Adds the way of one occurrence to its part's tree."""
        met: list[tuple[int, bool]] = []
        pieces = self.merge(self.part_texts[part], key, met)
        where, way = -1, 0  # -1: the root
        for salt, skipped in met:
            node = int(self.ways[where, way]) if where >= 0 else int(self.roots[part])
            if node < 0:
                node = self.n_nodes
                self.n_nodes += 1
                if node >= len(self.salts):
                    self.salts, self.ways = np.concatenate([self.salts, self.salts]), np.concatenate([self.ways, np.full_like(self.ways, NEW)])
                self.salts[node] = salt
                self.ways[node] = NEW
                if where >= 0:
                    self.ways[where, way] = node
                else:
                    self.roots[part] = node
            where, way = node, int(skipped)
        leaf = LEAVES - len(self.leaves)
        self.leaves.append(self._serialized(pieces))
        if where >= 0:
            self.ways[where, way] = leaf
        else:
            self.roots[part] = leaf

    def encode(self, text: str, key: int = 0) -> bytes:
        return self.encode_many([text], [key])[0]

    def _words_of(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACE in text or "  " in text or text[0] == " ":  # words are what runs of spaces lead; a run of the sign itself stands alone
            words = [w for k, run in enumerate(re.split(f"({SPACE}+)", text)) for w in ([run] if run[:1] == SPACE else re.findall(" +[^ ]*|[^ ]+", " " * (k == 0) + run))]
            return [w[1:] if w[:1] == " " and w[1:2] != " " else NOT_LED + w for w in words]
        return text.split(" ")

    def encode_many(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Of each text; the key varies its draws.

        A leading space is added, as the library does to texts that are not empty;
        the sign for a space, in the text itself, goes as bytes.
        """
        flat: list[int] = []
        strangers: list[str] = []
        ends, known = [0], self.words.get
        for text in texts:
            for word in self._words_of(text):
                x = known(word)
                if x is None:
                    x = self._numbers(word, strangers)
                if type(x) is int:
                    flat.append(x)
                else:
                    flat += x
            ends.append(len(flat))
        sizes = np.diff(ends)
        part = np.array(flat, "i8")
        with np.errstate(over="ignore"):
            start = np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], "u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed & 0xFFFFFFFFFFFFFFFF)
            drawn = _mixed(np.repeat(start, sizes) + (np.arange(len(part)) - np.repeat(ends[:-1], sizes)).astype("u8"))
            at, left = self._walk(part, drawn)
        pieces = list(map(self.leaves.__getitem__, np.maximum(LEAVES - at, 0).tolist()))
        gone = np.flatnonzero(at > LEAVES)
        texts_of = [self.part_texts[p] if p >= 0 else strangers[-p - 1] for p in part[gone].tolist()]
        for i, got in zip(gone.tolist(), self._merged(texts_of, drawn[gone]), strict=True):
            pieces[i] = got
        known_part = part[gone] >= 0
        self._learn(part[gone][known_part], drawn[gone][known_part], left[gone][known_part])
        return [b"".join(pieces[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _walk(self, part: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each occurrence gets to (a leaf, or from NEW down), and the way (node * 2 + skipped) it last took; -1: none."""
        at, left = np.where(part >= 0, self.roots[np.maximum(part, 0)], NEW).astype("i4"), np.full(len(part), -1, "i8")
        on = np.flatnonzero(at >= 0)
        while len(on):
            node = at[on]
            way = self._draw(keys[on], self.salts[node]).astype("i8")
            then = self.ways[node, way]
            at[on], left[on] = then, node * 2 + way
            on = on[then >= 0]
        return at, left

    def _learn(self, part: np.ndarray, keys: np.ndarray, left: np.ndarray) -> None:
        """Adds the ways that occurrences left the trees by, once enough did."""
        if not len(part) or self.n_nodes >= NODES_KEPT:
            return
        ways = self.ways.reshape(-1)
        exits, first, counts = np.unique(np.where(left >= 0, left, -1 - part), return_index=True, return_counts=True)
        states = np.where(exits >= 0, ways[np.maximum(exits, 0)], self.roots[np.maximum(-1 - exits, 0)])
        states = np.maximum(states - counts, GROWN)
        ways[exits[exits >= 0]] = states[exits >= 0]
        self.roots[-1 - exits[exits < 0]] = states[exits < 0]
        again = states == GROWN
        for i in first[again].tolist():
            self._grow(int(part[i]), int(keys[i]))

    def _merged(self, parts: list[str], keys: np.ndarray) -> list[bytes]:
        """merge(), serialized, of each part under its key."""
        out: list[bytes] = [b""] * len(parts)
        short = sorted((i for i, p in enumerate(parts) if len(p) <= ROW_LENGTH and p[:1] != NOT_LED), key=lambda i: len(parts[i]))
        for at in range(0, len(short), 20_000):
            some = short[at : at + 20_000]
            for i, got in zip(some, self.merge_many([parts[i] for i in some], keys[some]), strict=True):
                out[i] = got
        for i, p in enumerate(parts):
            if p[:1] == NOT_LED:
                out[i] = self._literal(p[1:])
            elif len(p) > ROW_LENGTH:
                out[i] = self._serialized(self.merge(p, int(keys[i])))
        return out

    def decode(self, ids: bytes) -> str:
        whole = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u2").tolist()))
        return whole[1:].decode() if whole[:1] == b" " else whole.decode()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@functools.lru_cache(2)
def coder(path: str, rate: float, seed: int) -> MergeDropout:
    return MergeDropout(path, rate, seed)


def encode(df: DataFrame, text: str = "text", ids: str = "piece_ids", rate: float = 0.1, seed: int = 7, path: str | None = None) -> DataFrame:
    """Adds `ids` (binary, little-endian unsigned 16-bit): the whole text's pieces under merge dropout.

    A null text gives null, an empty one no pieces; equal texts are cut alike
    under one seed, their words' occurrences each by itself. Rate 0 gives the library's own segmentation. A column already
    called `ids` is an error; other columns and repeated rows pass through, an
    empty table stays empty.
    """
    if ids.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {ids}")
    where, at = path or default_path(), df.columns.index(text)

    def add(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            made: list[bytes | None] = []
            some: list[str] = []
            held = 0
            for k, x in enumerate(texts):
                some.append(x or "")
                if k == len(texts) - 1 or len(some[-1]) + held > STEP_CHARS:
                    made += coder(where, rate, seed).encode_many(some, [xxhash.xxh64_intdigest(t, 0) for t in some])
                    some, held = [], 0
                else:
                    held += len(some[-1])
            made = [None if x is None else m for x, m in zip(texts, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, ids])

    return df.mapInArrow(add, schema_with(df, **{ids: "binary"}))


def decode(df: DataFrame, ids: str = "piece_ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds `text`: what the pieces spell; null for null. A column already called `text` is an error."""
    if text.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {text}")
    where, at = path or default_path(), df.columns.index(ids)

    def add(batches):
        for batch in batches:
            made = [None if x is None else coder(where, 0.0, 0).decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, text])

    return df.mapInArrow(add, schema_with(df, **{text: "string"}))


def documents_round_trip(docs: DataFrame, id_column: str = "doc_id", rate: float = 0.1, seed: int = 7, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_pieces, ids_crc32, decoded_sha256, lossless) of each row's whole text (null: empty).

    Encodes and decodes in one pass, so a task holds one vocabulary and texts
    cross to Python once. Repeated rows and null ids stay, other columns are
    ignored, an empty table gives no rows.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs).alias("text"))
    where = path or default_path()
    names = ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def both(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part, coded = batch.slice(at, ROWS_AT_ONCE), coder(where, rate, seed)
                texts = part.column(1).to_pylist()
                rows = []
                for doc_id, text, ids in zip(part.column(0).to_pylist(), texts, coded.encode_many(texts, [xxhash.xxh64_intdigest(t, 0) for t in texts]), strict=True):
                    back = coded.decode(ids).encode()
                    data = text.encode()
                    rows.append((doc_id, len(data), len(ids) // 2, zlib.crc32(ids), hashlib.sha256(back).hexdigest(), back == data))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return source.mapInArrow(both, "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
