"""Runs of repeated word sequences: suffix array and LCP give the longest-previous-factor array, whose LZ blocks Main's extensions and copying need.

Documents of a task are taken together, each with a sign of its own behind it, up
to GROUP_WORDS words; no run crosses such a sign, and blocks may refer to earlier
documents, so a copy of a document is one block, whose runs are copied.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of documents that are handled together; a longer document is handled alone.
GROUP_WORDS = 200_000


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order, ranks): ranks[k] has equal numbers just where the next 2**k signs are equal.

    Prefix doubling; only suffixes that share their rank are sorted again. The
    last sign occurs once.
    """
    n = len(t)
    order = np.argsort(t, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = t[order[1:]] != t[order[:-1]]
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, "i4")
    rank[order] = start
    ranks, h = [rank], 1
    while True:
        shared = ~(fresh & np.append(fresh[1:], True))
        slots = np.flatnonzero(shared)
        if not len(slots):
            return order, ranks
        at = order[slots]
        key = rank[at].astype("i8") * n + rank[at + h]
        by = np.argsort(key, kind="stable")
        order[slots], key = at[by], key[by]
        fresh[slots[1:]] |= key[1:] != key[:-1]
        rank = rank.copy()
        firsts = np.maximum.accumulate(np.where(fresh[slots], slots, 0))
        rank[order[slots]] = firsts
        ranks.append(rank)
        h *= 2


def ahead(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many signs from i on are those from j on (i and j differ)."""
    a, b = i.copy(), j.copy()
    for k in range(len(ranks) - 1, -1, -1):
        step = (ranks[k][a] == ranks[k][b]).astype(a.dtype) << k
        a += step
        b += step
    return a - i


def behind(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many signs up to i, and it, are those up to j; the first sign of all occurs once."""
    a, b = i.copy(), j.copy()
    for k in range(len(ranks) - 1, -1, -1):
        p, q = a - (1 << k) + 1, b - (1 << k) + 1
        fits = (p >= 0) & (q >= 0)
        step = (fits & (ranks[k][np.maximum(p, 0)] == ranks[k][np.maximum(q, 0)])).astype(a.dtype) << k
        a -= step
        b -= step
    return i - a


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """(lengths, places): the longest factor from each place on that also begins earlier, and where; lcp[k] is that of suffixes k - 1 and k in order.

    Places are taken out of the list of sorted suffixes from the last to the
    first, so a place's neighbours are the nearest suffixes that begin earlier.
    """
    n = len(order)
    before, after = np.full(n + 1, n), np.full(n + 1, n)
    before[order[1:]], after[order[:-1]] = order[:-1], order[1:]
    shared = np.zeros(n + 1, "i8")
    shared[order] = lcp
    prev, nxt, common = before.tolist(), after.tolist(), shared.tolist()
    length, place = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        p, q = prev[i], nxt[i]
        a, b = common[i], common[q]
        if a >= b:
            length[i], place[i] = a, p
        else:
            length[i], place[i] = b, q
            common[q] = a
        nxt[p], prev[q] = q, p
        common[n] = 0  # that of the list's end
    return length, place


def _at_borders(t: np.ndarray, ranks: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of stretches with a period that touch a block's start, by Main's extensions in both directions.

    With four periods at least, a run that reaches a period into the block of its
    last border has a period of at most the block's length; any other has a whole
    period, and more than half of the block, before the border.
    """
    n, found = len(t), []
    twos = ranks[1] if len(ranks) > 1 else ranks[0]
    for widths, sign in ((sizes, 1), (np.append(0, sizes[:-1] // 2), -1)):
        border = np.repeat(starts, widths)
        period = np.arange(len(border)) - np.repeat(np.cumsum(widths) - widths, widths) + 1
        i = border if sign > 0 else border - period
        fits = (i >= 1) & (i + period < n)
        i, period = i[fits], period[fits]
        # one direction has half of what lies beyond one period, so two signs at least
        near = (twos[i] == twos[i + period]) | ((i >= 2) & (twos[np.maximum(i - 2, 0)] == twos[i + period - 2]))
        i, period = i[near], period[near]
        forth, back = ahead(ranks, i, i + period), behind(ranks, i - 1, i + period - 1)
        found.append((i - back, i + period + forth, period))
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    kept = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    return start[kept], end[kept], period[kept]


def all_runs(t: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, by start, then period; the first and the last sign occur once.

    Runs at borders of blocks are found there; all others lie within a block and
    are copied from where the block occurred before, left to right.
    """
    order, ranks = suffix_array(t)
    lcp = np.zeros(len(t), "i8")
    lcp[1:] = ahead(ranks, order[:-1], order[1:])
    length, place = previous_factors(order, lcp)
    starts, i = [], 0
    while i < len(t):
        starts.append(i)
        i += length[i] or 1
    sizes = np.diff(np.append(starts, len(t)))
    least: dict[tuple[int, int], int] = {}
    for s, e, p in zip(*(x.tolist() for x in _at_borders(t, ranks, np.array(starts), sizes)), strict=True):
        if p < least.get((s, e), p + 1):
            least[s, e] = p
    if not least:
        return []
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)  # start -> ends and periods
    for (s, e), p in least.items():
        buckets[s].append((e, p))
    known = sorted(buckets)
    for h, size in zip(starts, sizes.tolist(), strict=True):
        if size < LEAST_WORDS + 2:
            continue
        source = place[h]
        shift, k = h - source, bisect_right(known, source)
        while k < len(known) and known[k] < source + size:
            s = known[k]
            for e, p in list(buckets[s]):
                if e < source + size and (s + shift, e + shift) not in least:
                    least[s + shift, e + shift] = p
                    if s + shift not in buckets:
                        insort(known, s + shift)
                    buckets[s + shift].append((e + shift, p))
            k += 1
    return sorted(((s, e, p) for (s, e), p in least.items()), key=lambda r: (r[0], r[2]))


def repeated_tail(words: list[bytes], key: int) -> list[bytes]:
    """The words with a tail that repeats its beginning, where and how long by the key (see the contract of op12)."""
    n, g = len(words), key // 10
    if key % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _group(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every document's runs."""
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    parts, starts, at = [], [], 1
    for words in documents:
        starts.append(at)
        parts.append(np.fromiter((ids[w] for w in words), "i8", len(words)))
        at += len(words) + 1
    signs = len(ids)
    t = np.empty(at, "i8")
    t[0] = signs
    for k, (s, part) in enumerate(zip(starts, parts, strict=True)):
        t[s : s + len(part)] = part
        t[s + len(part)] = signs + 1 + k
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for s, e, p in all_runs(t):
        d = bisect_right(starts, s) - 1
        out[d].append((s - starts[d], e - s, p))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those behind the first period of any run."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for s, n, p in runs:
        kept[s + p : s + n] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def detect(docs: DataFrame, text: str = "text", id_column: str = "doc_id", repeat_tails: bool = False) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed): every document's runs, by start, then period, and its text without their repeats.

    A run is a stretch of words with smallest period q, of at least 6 words and
    4 * q, that no neighbouring word extends. Null texts are empty: no words, no
    runs, an empty text; repeated rows give a row each, a null id stays null (its
    key is that of the empty text), other columns are ignored, and an empty table
    gives no rows. `repeat_tails` first repeats tails by the crc32 of the id.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")).alias("key"), text_of(docs, text).cast("binary").alias("text"))

    def found(batches):
        for batch in batches:
            group: list[tuple[int | None, list[bytes]]] = []
            size = 0
            for doc_id, key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = data.as_py().split()  # of bytes: at spaces and the signs 9 to 13
                if repeat_tails:
                    words = repeated_tail(words, key)
                if group and size + len(words) > GROUP_WORDS:
                    yield put(group)
                    group, size = [], 0
                group.append((doc_id, words))
                size += len(words)
            if group:
                yield put(group)

    def put(group):
        runs = _group([w for _, w in group])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in group], pa.int64()), pa.array([len(w) for _, w in group], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], _RUNS),
                pa.array([collapsed(w, r).decode() for (_, w), r in zip(group, runs, strict=True)], pa.string()),
            ],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    return rows.mapInArrow(found, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the one of smallest start, then period; null without runs."""
    first = F.get(runs, F.lit(0))
    better = lambda a, r: r["length"].cast("decimal(19,0)") * a["period"].cast("decimal(19,0)") > a["length"].cast("decimal(19,0)") * r["period"].cast("decimal(19,0)")
    return F.aggregate(runs, first, lambda a, r: F.when(better(a, r), r).otherwise(a))


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): digests of detect()."""
    best = F.col("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    rows = detect(docs, **options).withColumn("best", most_repeated(F.col("runs")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(best["length"].cast("decimal(19,0)") * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
