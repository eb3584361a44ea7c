"""Packing by cutting stock: column generation over the length histogram decides patterns, ranked documents fill them.

The linear program has a row for each class of lengths, which are rounded up to
a grain. Its patterns are then taken
back to true lengths (a class' pieces go in ascending order of length, so each
pattern falls into few kinds of sequences), and what rounding left free is
filled with short pieces held back for that, and with what the rounding down of
the program's solution left over.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_of
from .words import default_path, encoder

#: Lengths are rounded up for the linear program to a multiple of the first of these that adds at most ROUNDED to all tokens.
GRAINS, ROUNDED = (8, 4, 2, 1), 0.01
#: The share of all tokens, in the shortest pieces, that is kept to fill what rounding leaves free.
HELD_BACK = 0.02
#: Pieces that one ranking group holds on average at most, if it holds all lengths.
BUCKET_ROWS = 2_000
#: The linear program stops within this share of its optimum (by Farley's bound from priced columns), or after so many steps.
GAP, MAX_COLUMNS = 0.0002, 6000
#: Steps of the simplex after which its inverse is made anew, or half as many as it has rows.
REFRESH = 50
#: Differences below this are rounding.
NOISE = 1e-6

Pattern = dict[int, int]  # length -> pieces of it


class Plan(NamedTuple):
    """patterns and how often each is used; how many knapsacks were solved, and how many of the columns in use they priced."""

    patterns: list[tuple[Pattern, int]]
    knapsacks: int
    priced: int


def grain_for(demand: np.ndarray, size: int) -> int:
    """The coarsest grain that divides the size and adds little enough to these pieces (by length)."""
    lengths = np.arange(len(demand))
    for g in GRAINS:
        if size % g == 0 and float(demand @ (-lengths % g)) <= ROUNDED * float(demand @ lengths):
            return g
    return 1


def _fill(left: np.ndarray, capacity: int) -> Pattern:
    """The first-fit-decreasing pattern out of what is left (by length)."""
    pattern, room, longest = {}, capacity, capacity
    while len(c := np.flatnonzero(left[: min(room, longest) + 1])):
        best = int(c[-1])
        pattern[best] = k = min(int(left[best]), room // best)
        room, longest = room - k * best, best - 1
    return pattern


def greedy_patterns(demand: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """First fit decreasing over a histogram: each pattern is repeated while its pieces last."""
    left, out = demand.copy(), []
    left[0] = 0
    while left.any():
        p = _fill(left, capacity)
        times = min(int(left[c]) // a for c, a in p.items())
        for c, a in p.items():
            left[c] -= a * times
        out.append((p, times))
    return out


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the capacity; sizes ascend."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            got = values[:k] + best[c - sizes[:k]]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], took[c] = got[j], j
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            column[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), column


def inverted(square: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots, without BLAS, whose threads can hang in a process that has forked."""
    n = len(square)
    both = np.hstack([square, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        if pivot != k:
            both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        rows = np.flatnonzero(factors)  # few: patterns hold few lengths
        both[rows] -= factors[rows, None] * both[k]
    return both[:, n:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", matrix, vector)


def column_generation(demand: np.ndarray, capacity: int) -> Plan:
    """Patterns that hold at most the demand (by length, index 0 unused), out of the linear program's solution rounded down.

    A revised simplex on the patterns' program; every column but the first ones
    (each of a single length) is priced by the knapsack. Prices are drawn towards
    the lengths, which keeps them from swinging, and any prices over their best
    pattern's worth bound the optimum from below (Farley): within GAP of that
    bound the program stops. It has one row a length, so its size does not depend
    on the corpus.
    """
    sizes = np.flatnonzero(demand)
    m, need = len(sizes), demand[sizes].astype(float)
    if not m:
        return Plan([], 0, 0)
    columns = np.diag((capacity // sizes).astype(float))
    inverse, cost, priced = np.diag(1 / np.diag(columns)), np.ones(m), np.zeros(m, bool)
    by_size = sizes / capacity
    bound, draw, knapsacks = 0.0, 0.9, 0
    for step in range(MAX_COLUMNS):
        if step % max(REFRESH, m // 2) == REFRESH - 1:
            inverse = inverted(columns)
        x = _times(inverse, need)
        prices = np.einsum("i,ij->j", cost, inverse)
        if prices.min() < -NOISE:  # a surplus column: more of a length than asked for
            new, price = np.zeros(m), 0.0
            new[prices.argmin()] = -1
        else:
            while True:
                drawn = draw * by_size + (1 - draw) * prices
                value, new = best_pattern(drawn, sizes, capacity)
                knapsacks += 1
                bound = max(bound, float(drawn @ need) / max(value, 1e-12))
                if prices @ new > 1 + NOISE or draw == 0:
                    break
                draw = draw - 0.1 if draw > 0.15 else 0.0
            if prices @ new <= 1 + NOISE or cost @ np.maximum(x, 0) <= bound * (1 + GAP):
                break
            price = 1.0
        way = _times(inverse, new)
        ratio = np.where(way > NOISE, np.maximum(x, 0) / np.where(way > NOISE, way, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        r = int(np.where(ratio <= ratio.min() + NOISE, way, 0).argmax())  # of equals the largest pivot keeps the basis sound
        columns[:, r], cost[r], priced[r] = new, price, price > 0
        row = inverse[r] / way[r]
        inverse -= np.outer(way, row)
        inverse[r] = row
    x, left, out, used = _times(inverted(columns), need), demand.copy(), [], 0
    for i in np.flatnonzero(cost):
        p = {int(sizes[k]): int(columns[k, i]) for k in np.flatnonzero(columns[:, i] > 0.5)}
        times = min([int(max(x[i], 0) + 1e-6), *(int(left[c]) // a for c, a in p.items())])
        if times > 0:
            for c, a in p.items():
                left[c] -= a * times
            out.append((p, times))
            used += bool(priced[i])
    return Plan(out, knapsacks, used)


def _split(pattern: Pattern, times: int, runs: dict[int, list[tuple[int, int]]]) -> list[tuple[Pattern, int]]:
    """A pattern of classes as patterns of true lengths, taken off the front of the classes' runs (length, pieces)."""
    out = []
    while times:
        now = times
        for c, a in pattern.items():  # as many sequences as have all their pieces of a class out of one run; or one sequence
            now = min(now, max(1, runs[c][0][1] // a))
        true: Pattern = {}
        for c, a in pattern.items():
            left = a * now
            while left:
                length, n = runs[c][0]
                taken = min(left, n)
                true[length] = true.get(length, 0) + taken
                left -= taken
                runs[c][0] = (length, n - taken)
                if n == taken:
                    runs[c].pop(0)
        if now > 1:
            true = {length: n // now for length, n in true.items()}
        out.append((true, now))
        times -= now
    return out


def _fillers(left: np.ndarray, room: int) -> Pattern:
    """What is to be put into the room: one or two pieces that fill it, or the longest that fits; nothing if none does."""
    fits = np.flatnonzero(left[: room + 1])
    if not len(fits) or fits[-1] == room:
        return {room: 1} if len(fits) else {}
    rest = room - fits
    pairs = fits[(left[rest] > (rest == fits)) & (rest <= fits)]
    if len(pairs):
        a = int(pairs[0])
        return {a: 2} if 2 * a == room else {a: 1, room - a: 1}
    return {int(fits[-1]): 1}


def _exchange(left: np.ndarray, room: int, pattern: Pattern) -> Pattern:
    """A piece to take out (-1) and one to put in for it that leave the least room, where nothing more fits; nothing if none helps."""
    best: tuple[int, int] | None = None
    for c in pattern:
        longer = np.flatnonzero(left[c + 1 : c + room + 1])
        if len(longer) and (best is None or longer[-1] + 1 > best[0]):
            best = int(longer[-1]) + 1, c
    return {} if best is None else {best[1]: -1, best[1] + best[0]: 1}


def _subset(left: np.ndarray, room: int) -> Pattern:
    """Of what is left, pieces whose sum comes closest to the room, long ones before short ones, by a dynamic program over the sums that can be reached (as bits of a number)."""
    whole, reached = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int]] = []  # a length, and the sums reached before one more piece of it
    for c in np.flatnonzero(left[: room + 1])[::-1].tolist():
        for _ in range(min(int(left[c]), room // c)):
            more = reached | (reached << c) & whole
            if more == reached:
                break
            steps.append((c, reached))
            reached = more
        if reached >> room:
            break
    pattern: Pattern = {}
    at = reached.bit_length() - 1
    for c, before in reversed(steps):
        if not before >> at & 1:
            pattern[c] = pattern.get(c, 0) + 1
            at -= c
    return pattern


def subset_patterns(demand: np.ndarray, size: int) -> list[tuple[Pattern, int]]:
    """Sequences filled as far as can be around the longest piece that is left; each pattern is repeated while its pieces last."""
    left, out = demand.copy(), []
    left[0] = 0
    while len(known := np.flatnonzero(left)):
        longest = int(known[-1])
        left[longest] -= 1
        p = _subset(left, size - longest)
        left[longest] += 1
        p[longest] = p.get(longest, 0) + 1
        times = min(int(left[c]) // a for c, a in p.items())
        for c, a in p.items():
            left[c] -= a * times
        out.append((p, times))
    return out


def _repacked(full: list[tuple[Pattern, int]], roomy: list[tuple[Pattern, int]], left: np.ndarray, size: int, spare: int) -> list[tuple[Pattern, int]]:
    """The full sequences, the roomy ones (fullest first) as far as their rooms add up to `spare` at most, and what is in the others packed anew with what is left."""
    out, left = list(full), left.copy()
    for pattern, times in roomy:
        room = size - sum(c * a for c, a in pattern.items())
        kept = min(times, spare // room)
        spare -= kept * room
        if kept:
            out.append((pattern, kept))
        for c, a in pattern.items():
            left[c] += a * (times - kept)
    return out + min(subset_patterns(left, size), greedy_patterns(left, size), key=lambda p: sum(n for _, n in p))


def make_plan(demand: np.ndarray, size: int) -> Plan:
    """Patterns of true lengths, and how often each is used, that hold the demand (by length, index 0 unused) exactly.

    Sequences that could not be filled stay while their rooms add up to no more than
    nothing, what the last sequence of all has free, or half of that and of one
    sequence (whichever needs fewest); what is in the others is packed by subset
    sums, or first fit, with what the program's patterns leave over.
    """
    lengths = np.arange(size + 1)
    held, budget = np.zeros_like(demand), int(HELD_BACK * (demand @ lengths))
    for c in np.flatnonzero(demand[:size]):
        held[c] = min(int(demand[c]), budget // int(c))
        budget -= int(held[c]) * int(c)
        if held[c] < demand[c]:
            break
    rest = demand - held
    rest[size] = 0
    grain = grain_for(rest, size)
    classes = -(-lengths // grain)
    found = column_generation(np.bincount(classes, rest, size // grain + 1).astype("i8"), size // grain)
    runs: dict[int, list[tuple[int, int]]] = {}
    for length in np.flatnonzero(rest):
        runs.setdefault(int(classes[length]), []).append((int(length), int(rest[length])))
    todo = [x for p, times in found.patterns for x in _split(p, times, runs)]
    left = held.copy()
    for some in runs.values():
        for length, n in some:
            left[length] += n
    out: list[tuple[Pattern, int]] = [({size: 1}, int(demand[size]))] if demand[size] else []
    roomy: list[tuple[Pattern, int]] = []
    todo.sort(key=lambda x: sum(c * a for c, a in x[0].items()))  # the fullest, which only the shortest pieces fit, come off first
    while todo:
        pattern, times = todo.pop()
        room = size - sum(c * a for c, a in pattern.items())
        more = _fillers(left, room) or _exchange(left, room, pattern)
        if not more:
            (roomy if room else out).append((pattern, times))
            continue
        now = min([times, *(int(left[c]) // a for c, a in more.items() if a > 0)])
        for c, a in more.items():
            left[c] -= a * now
        both = {c: pattern.get(c, 0) + more.get(c, 0) for c in {**pattern, **more}}
        todo.append(({c: a for c, a in both.items() if a}, now))
        if now < times:
            todo.append((pattern, times - now))
    roomy.sort(key=lambda x: -sum(c * a for c, a in x[0].items()))
    free = -int(demand @ lengths) % size
    plans = [_repacked(out, roomy, left, size, spare) for spare in (0, free, (size + free) // 2)]
    return Plan(min(plans, key=lambda p: sum(times for _, times in p)), found.knapsacks, found.priced)


def cut_documents(docs: DataFrame, size: int, end_id: int = 2, id_column: str = "doc_id", tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): every document's ids and end_id, cut into full pieces and a rest."""
    path = tokenizer or default_path()
    end = np.array([end_id], "<u2").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(encoder(path).encode(text.as_py()) + end, "<u2")
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size].astype("<u4").tobytes()
                    out.append((doc_id, at, len(piece) // 4, zlib.crc32(piece), len(ids), *[piece] * keep_ids))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(cut, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))


def _places(batches, size: int):
    """The patterns' table out of the batches (length, n): which ranks of a length go to which sequences, `each` of them to one.

    A length with many entries has its ranks in blocks of `width`, and an entry
    for each block that its ranks meet, so that a piece is held against few.
    """
    demand = np.zeros(size + 1, "i8")
    for batch in batches:
        demand[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    used, first = np.zeros(size + 1, "i8"), 0
    entries: dict[int, list[tuple[int, int, int, int]]] = {}
    for pattern, times in make_plan(demand, size).patterns:
        for c, a in pattern.items():
            entries.setdefault(c, []).append((int(used[c]), int(used[c]) + a * times, a, first))
            used[c] += a * times
        first += times
    table = []
    for c, some in entries.items():
        width = -(-int(demand[c]) // len(some))
        table += [(c, width, block, *e) for e in some for block in range(e[0] // width, (e[1] - 1) // width + 1)]
    for at in range(0, max(1, len(table)), 10_000):
        columns = list(zip(*table[at : at + 10_000], strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["class", "width", "block", "rank_from", "rank_to", "each", "first"])


def pack(docs: DataFrame, size: int = 4096, end_id: int = 2, id_column: str = "doc_id", tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Packs whole documents into sequences of at most `size` tokens; a row a piece, with sequence_id and offset.

    A null text is the end id alone, repeated rows and ids are packed each, null
    ids stay null, other columns are ignored, an empty table gives no rows.
    Documents over `size` are cut into full pieces, which fill sequences alone,
    and a rest. One task solves the linear program: it gets the histogram of
    lengths, at most `size` rows whatever the corpus. Within a length, pieces are
    ranked by a hashed bucket, which the pieces' numbers (written with them) are
    part of, and then by id, so a length that many share, or one row repeated, is
    dealt over many tasks; ranks look up their place in the patterns' table, whose
    size depends on `size` alone.
    """
    pieces = saved(cut_documents(docs, size, end_id, id_column, tokenizer, keep_ids).withColumn("class", F.col("length")).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counted = pieces.groupBy("class").agg(F.count("*").alias("n"))
    places = saved(counted.repartition(1).mapInArrow(lambda batches: _places(batches, size), "class long, width long, block long, rank_from long, rank_to long, each long, first long"), "places")

    buckets = max(1, pieces.count() // BUCKET_ROWS)
    order = ["doc_id", "start", "ids_crc32", "row"]
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    local = bucketed.withColumn("rank", F.row_number().over(Window.partitionBy("class", "bucket").orderBy(*order)) - 1)
    before = bucketed.groupBy("class", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = local.join(before, ["class", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    widths = places.groupBy("class").agg(F.first("width").alias("width"))  # at most `size` rows
    blocks = ranked.join(F.broadcast(widths), "class").withColumn("block", F.floor(F.col("rank") / F.col("width")))
    put = blocks.join(F.broadcast(places.drop("width")), ["class", "block"]).where("rank >= rank_from and rank < rank_to").withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("each")))
    w = Window.partitionBy("sequence_id").orderBy(F.col("class").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return put.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"), *["ids"] * keep_ids)
