"""SimHash near duplicates at a wide radius: wide fingerprints find candidates, five-word shingles verify them.

Texts with the same set of shingles collapse first. Fingerprints are those of
the set of neighbouring pairs of words: at a shingle similarity of 0.8 about one
word in 45 is another, which changes one pair in 22 but one shingle in 9, so
pairs' fingerprints differ in a share of DIFFERING of their bits, those of
shingles in 0.15. Bits that go together are grouped into partitions and
thresholds allocated as for any SimHash (`simhash.allocate`), so all pairs up to
`parts - 1` bits apart meet; a pair further apart, as most at 0.8 are, meets in
one of the partitions with probability RECALL. Width and number of the
partitions follow from the number of documents, so a bucket's chance members
stay few and that recall stays the same at every size.

Members of a bucket are candidates if CHECK_BITS further bits agree well enough
and their sizes can reach the similarity; candidates count only if their sets of
shingles do reach it. Where pairs are many, sets are first folded to FOLD bits
each, which show many unlike pairs and never a similar one (`_folds_fit`). Each member of a bucket is first compared with one other
that is like it, in a large bucket with a leader, another one in each round; what
verified pairs connect needs no further look, and all other pairs of members that
are alike are compared then. Members of large buckets that are still of two
classes, unlike ones whose texts have much in common, go by their rarest shingles
instead of their bucket: two sets of that similarity share one of those
(`rarest`), so all their pairs are found and others hardly meet.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, few, file_system, hashed_sample, in_small_batches, lookup, new_folder, saved, text_of
from .simhash import SAMPLE, SEED, allocate, bits_of, components, flips, part_keys

SIMILARITY, WORDS = 0.8, 5
#: The share of bits in which fingerprints of that similarity differ, and the share of such pairs that meet in a bucket.
DIFFERING, RECALL = 0.095, 0.97
#: A partition is so many bits wider than the number of documents needs, so chance members of a bucket are few.
SPARE_BITS = 3
#: Bits beside the partitions' that candidates are looked at by, and in how many they may differ (at 0.8: 12 on average, by chance: 64).
CHECK_BITS, CHECK_RADIUS = 128, 28
#: Bits that a set of shingles is folded to (a multiple of 64).
FOLD = 256
#: Buckets beyond this go by leaders and are never seen whole; rounds of leaders before all pairs that are left; members of a block of those.
LARGE, ROUNDS, BLOCK = 64, 1, 64
#: Shingles of the pairs of a family that are verified in one place, and how many pairs of small families share a place.
CELL, PAIRS = 1 << 20, 64
#: monotonically_increasing_id has the number of the partition from this bit on.
PARTITION_BIT = 33
#: Words whose hashes a worker remembers.
HASHES_KEPT = 100_000
_FACTOR, _GOLDEN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_hashes: dict[bytes, int] = {}


def layout(n: int) -> tuple[int, int]:
    """(partitions, bits of each) for n documents."""
    width = max(14, math.ceil(math.log2(max(n, 2))) + SPARE_BITS)
    return math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - DIFFERING) ** width)), width


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: bytes) -> int:
    found = xxhash.xxh64_intdigest(word, SEED)
    if len(_hashes) < HASHES_KEPT and len(word) <= 64:
        _hashes[word] = found
    return found


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: ASCII lower case, what ASCII white space parts."""
    known = _hashes.get
    return np.array([known(w) or _word_hash(w) for w in text.encode().lower().split()], "u8")


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """The set of runs of so many words, as ascending 64-bit hashes; fewer words are one run, none are none."""
    if not len(words):
        return words
    k = min(length, len(words))
    with np.errstate(over="ignore"):
        out = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            out = out * _FACTOR + words[i : len(words) - k + 1 + i]
        return np.unique(_mixed(out + np.uint64(k)))


def shingles(words: np.ndarray) -> np.ndarray:
    """The set of shingles as ascending 32-bit integers."""
    return np.unique((runs(words, WORDS) >> np.uint64(32)).astype("u4")).view("i4")


def fingerprint(words: np.ndarray, n_bits: int) -> np.ndarray:
    """The SimHash of n_bits (a multiple of 64) of the set of pairs of words, as 64-bit numbers: a bit is 1 if set in over half the pairs' hashes."""
    pairs = runs(words, 2)
    ones = np.zeros(n_bits, "i8")
    with np.errstate(over="ignore"):
        salts = np.arange(1, n_bits // 64 + 1, dtype="u8") * _GOLDEN
        for at in range(0, len(pairs), 255):
            bits = bits_of(_mixed(pairs[at : at + 255, None] + salts))
            ones += bits.sum(0, dtype="u1")  # 255 at most
    return np.packbits(2 * ones > len(pairs), bitorder="little").view("<u8")


def fold(found: np.ndarray) -> np.ndarray:
    """Whether the number of shingles that fall on each of FOLD places is odd, as 64-bit numbers: two sets' folds differ in as many bits as the shingles that only one has, or fewer."""
    odd = np.bincount(found.view("u4") % FOLD, minlength=FOLD).astype("u1") & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def sketches(rows: DataFrame, n_bits: int) -> DataFrame:
    """(row, doc_id, node: hash of the set of shingles, size of the set, c1, c2: the bits looked at besides, fp: fingerprint) of (row, doc_id, text)."""

    def add(batches):
        for batch in batches:
            nodes, sizes, fps, checks = [], [], [], []
            for text in batch.column(2):
                words = word_hashes(text.as_py())
                found = shingles(words)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) - 2**63)
                sizes.append(len(found))
                made = fingerprint(words, n_bits + CHECK_BITS)
                fps.append(made[: n_bits // 64].tobytes())
                checks.append(made[n_bits // 64 :].view("i8"))
            c1, c2 = (pa.array([c[i] for c in checks], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), c1, c2, pa.array(fps, pa.binary())], ["row", "doc_id", "node", "size", "c1", "c2", "fp"])

    return rows.mapInArrow(add, "row long, doc_id long, node long, size int, c1 long, c2 long, fp binary")


Probed = list[tuple[int, list[int], np.ndarray]]


def keys_of(bits: np.ndarray, probed: Probed) -> np.ndarray:
    """The buckets of each row of bits, one for each partition (its number, bits and changes) and change: the key, and the partition's number above all keys' bits, so that numbers are small and no two buckets have the same."""
    width = np.uint64(max((len(g) for _, g, _ in probed), default=0))
    return np.concatenate([(part_keys(bits, g)[:, None] ^ f) | (np.uint64(i) << width) for i, g, f in probed], 1).view("i8")


def probes(nodes: DataFrame, n_bits: int, probed: Probed) -> DataFrame:
    """(bucket, row) of (row, fp): a row for each partition and each key within its threshold."""

    def add(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                keys = keys_of(bits_of(np.frombuffer(b"".join(part.column("fp").to_pylist()), "<u8").reshape(part.num_rows, -1)), probed)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column("row").to_numpy(), keys.shape[1]))], ["bucket", "row"])

    return nodes.select("row", "fp").mapInArrow(add, "bucket long, row long")


def shared(rows: DataFrame, often: list[int]) -> DataFrame:
    """(bucket, row, met: the bucket's number of rows) of those rows (bucket, row) whose bucket has others.

    Rows move once, to be counted by bucket. Those of the buckets named in `often`
    stay where they are and learn their number by a broadcast; any may be named,
    which decides only the cost.
    """
    hot = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in often], "bucket long"))
    dealt = rows.join(hot, "bucket", "left_anti").withColumn("met", F.count("*").over(Window.partitionBy("bucket")))
    stay = rows.join(hot, "bucket", "left_semi")
    sizes = stay.groupBy("bucket").agg(F.count("*").alias("met"))
    return dealt.unionByName(stay.join(F.broadcast(sizes), "bucket")).where("met > 1")


@functools.lru_cache(16)
def _listed(folder: str, part: int) -> np.ndarray:
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, path = file_system(folder)
    found = files.get_file_info(fs.FileSelector(f"{path}/part={part}", allow_not_found=True))
    rows = [pq.ParquetFile(files.open_input_file(f.path)).read().column("row").to_numpy() for f in found if f.path.endswith(".parquet")]
    return np.sort(np.concatenate(rows)) if rows else np.empty(0, "i8")


def only(held: DataFrame, rows: DataFrame, change=None, schema=None) -> DataFrame:
    """The rows of held (written, numbered by partition in `row`) that `rows` names, through `change` (a function of a batch that gives `schema`): each task reads the list of the partitions it meets, and no text is dealt out."""
    folder = new_folder(held.sparkSession, "listed")
    rows.select("row", F.shiftright("row", PARTITION_BIT).alias("part")).repartition("part").write.partitionBy("part").parquet(folder)

    def keep(batches):
        for batch in batches:
            row = batch.column("row").to_numpy()
            parts = row >> PARTITION_BIT
            wanted = np.zeros(len(row), bool)
            for part in np.unique(parts).tolist():
                here = parts == part
                wanted[here] = np.isin(row[here], _listed(folder, part))
            left = batch.filter(pa.array(wanted))
            yield change(left) if change else left

    return held.mapInArrow(keep, schema or held.schema)


@functools.lru_cache(16)
def _asked(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a partition that a list (row, place) names, ascending, and their places."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, path = file_system(folder)
    found = files.get_file_info(fs.FileSelector(f"{path}/part={part}", allow_not_found=True))
    tables = [pq.ParquetFile(files.open_input_file(f.path)).read() for f in found if f.path.endswith(".parquet")]
    row, place = (np.concatenate([np.empty(0, "i8"), *[t.column(c).to_numpy() for t in tables]]) for c in ("row", "place"))
    order = np.argsort(row, kind="stable")
    return row[order], place[order]


def placed(pairs: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """(a, b, place) of n pairs (a, b): pairs with much the same members have one place, which has about CELL shingles at most.

    A pair goes by the least partner of its b, which is the same one throughout a
    family of texts that are all alike. A family of more is cut both ways, by a
    and by b, in proportion to how many of either it has. sizes: (node, size).
    """
    partner = pairs.groupBy("b").agg(F.min("a").alias("cell"), F.count("*").alias("n"))
    celled = lookup(pairs.select("a", "b"), partner, "b", "n", n)
    cells = celled.groupBy("cell").agg(F.count("*").alias("n"), F.approx_count_distinct("a").alias("of_a"), F.approx_count_distinct("b").alias("of_b")).join(sizes.withColumnRenamed("node", "cell"), "cell")
    cells = cells.withColumn("parts", F.ceil(F.col("n") * F.col("size") / CELL)).withColumn("by_a", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("parts") * F.col("of_a") / F.col("of_b")))))
    cells = cells.select("cell", "n", "by_a", F.ceil(F.col("parts") / F.col("by_a")).alias("by_b"))
    at = F.xxhash64("cell", F.pmod(F.xxhash64("a"), F.col("by_a")), F.pmod(F.xxhash64("b"), F.col("by_b")))
    return lookup(celled, cells, "cell", "n", n).select("a", "b", F.pmod(at, F.lit(math.ceil(max(n, 1) / PAIRS))).alias("place"))


def verified(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Those of n pairs (a, b) whose sets (row, node, size, shingles; written, numbered by partition in `row`) have at least SIMILARITY in common.

    A set is sent to each place that has pairs of it once, not with each pair.
    """
    at = saved(few(placed(pairs, sets.select("node", "size"), n), n), "placed")
    folder = new_folder(sets.sparkSession, "asked")
    wanted = at.select("place", F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", "row"), "node")
    wanted.select("row", "place", F.shiftright("row", PARTITION_BIT).alias("part")).repartition("part").write.partitionBy("part").parquet(folder)

    def send(batches):
        for batch in batches:
            row = batch.column("row").to_numpy()
            for part in np.unique(row >> PARTITION_BIT).tolist():
                here = np.flatnonzero(row >> PARTITION_BIT == part)
                rows, places = _asked(folder, part)
                first, last = np.searchsorted(rows, row[here], "left"), np.searchsorted(rows, row[here], "right")
                times = last - first
                which = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
                every = pa.array(np.repeat(here, times))
                yield pa.RecordBatch.from_arrays([pa.array(places[which]), batch.column("node").take(every), batch.column("shingles").take(every)], ["place", "node", "shingles"])

    def check(held: pa.Table, asked: pa.Table) -> pa.Table:
        node, a, b = held.column("node").to_numpy(), asked.column("a").to_numpy(), asked.column("b").to_numpy()
        known = {x: i for i, x in enumerate(node.tolist())}
        found = held.column("shingles").combine_chunks()
        values, ends = found.values.to_numpy(), found.offsets.to_numpy()
        good = np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = (values[ends[known[z]] : ends[known[z] + 1]] for z in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            good[k] = both >= SIMILARITY * (len(x) + len(y) - both)
        return pa.table({"a": a[good], "b": b[good]})

    sent = sets.mapInArrow(send, "place long, node long, shingles array<int>")
    return sent.groupBy("place").cogroup(at.groupBy("place")).applyInArrow(check, "a long, b long")


def _alike(x: Column, y: Column) -> Column:
    """Whether two members (node, size, c1, c2) can be similar, by their sizes and bits."""
    differ = F.bit_count(x["c1"].bitwiseXOR(y["c1"])) + F.bit_count(x["c2"].bitwiseXOR(y["c2"]))
    return (F.least(x["size"], y["size"]) >= SIMILARITY * F.greatest(x["size"], y["size"])) & (differ <= CHECK_RADIUS)


def _folds_fit(x: Column, y: Column) -> Column:
    """Whether two members (size, fold) can be similar: of sets that share SIMILARITY of both, no more shingles are in one alone than this share of their sizes' sum."""
    differ = sum((F.bit_count(x["fold"][f"f{i}"].bitwiseXOR(y["fold"][f"f{i}"])) for i in range(FOLD // 64)), F.lit(0))
    return differ * (1 + SIMILARITY) <= (1 - SIMILARITY) * (x["size"] + y["size"]) + 1e-6


def _folded_alike(x: Column, y: Column) -> Column:
    return _alike(x, y) & _folds_fit(x, y)


def ordered(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, each once, of those pairs of members (m, other) that can be similar."""
    fit = pairs.where(_folded_alike(F.col("m"), F.col("other")))
    return fit.select(F.least("m.node", "other.node").alias("a"), F.greatest("m.node", "other.node").alias("b")).where("a < b").distinct()


def links(nodes: DataFrame, held: DataFrame, text: str, n_bits: int, parts: int) -> DataFrame:
    """(node, root): the nodes (node, row, size, c1, c2, fp; written) that verified pairs connect with others."""
    spark, some = nodes.sparkSession, nodes.where("size > 0")
    sample = hashed_sample(some.select("node", "fp"), F.xxhash64("node"), SAMPLE).collect()
    none = spark.createDataFrame([], "node long, root long")
    if len(sample) < 2:
        return none
    bits = bits_of(np.frombuffer(b"".join(r.fp for r in sample), "<u8").reshape(len(sample), -1))
    groups, thresholds, _ = allocate(bits, some.count(), parts - 1, (parts,), 1)
    probed = [(i, g, np.array(flips(len(g), t), "u8")) for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]
    buckets, seen = np.unique(keys_of(bits, probed), return_counts=True)
    often = buckets[(seen > 1) & (seen * HOT_SHARE > len(sample))].tolist()
    meeting = saved(shared(saved(probes(some, n_bits, probed), "probes"), often), "meeting")
    joined = meeting.count()
    member = F.struct("node", "size", "c1", "c2").alias("m")
    met = saved(few(meeting.join(some.select("row", "node", "size", "c1", "c2"), "row").select("bucket", "met", member), joined), "met")

    members = met.where(F.col("met") <= LARGE).groupBy("bucket").agg(F.collect_list("m").alias("all"))
    alike = F.transform("all", lambda x: F.struct(x["node"].alias("b"), F.transform(F.filter("all", lambda y: (y["node"] < x["node"]) & _alike(x, y)), lambda y: y["node"]).alias("before")))
    some_alike = members.select("bucket", "all", F.filter(alike, lambda x: F.size(x["before"]) > 0).alias("found")).where(F.size("found") > 0)
    more = F.exists("found", lambda x: F.size(x["before"]) > 1)  # pairs are left in these
    first = saved(few(some_alike.select("bucket", F.when(more, F.col("all")).alias("all"), F.transform("found", lambda x: F.struct(F.array_min(x["before"]).alias("a"), x["b"].alias("b"))).alias("pairs")), joined, 20_000), "first")
    near = saved(few(first.select(F.inline("pairs")).distinct(), joined), "candidates")
    small = first.where("all is not null").select("bucket", F.explode("all").alias("m"))
    large = met.where(F.col("met") > LARGE).select("bucket", "m")

    wanted = near.select("a").unionByName(near.select(F.col("b").alias("a"))).unionByName(large.select(F.col("m.node").alias("a"))).unionByName(small.select(F.col("m.node").alias("a"))).distinct().withColumnRenamed("a", "node")

    def sets_of(batch):
        found = [shingles(word_hashes(x.as_py())) for x in batch.column(1)]
        folds = np.array([fold(x) for x in found], "i8").reshape(-1, FOLD // 64)
        folded = pa.StructArray.from_arrays([pa.array(folds[:, i]) for i in range(FOLD // 64)], [f"f{i}" for i in range(FOLD // 64)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) - 2**63 for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int32()), folded, pa.array(found, pa.list_(pa.int32()))], ["row", "node", "size", "fold", "shingles"])

    chosen = nodes.join(wanted, "node", "left_semi").select("row")
    fold_type = ", ".join(f"f{i}: long" for i in range(FOLD // 64))
    sets = saved(only(held.select("row", text_of(held, text).alias("text")), chosen, sets_of, f"row long, node long, size int, fold struct<{fold_type}>, shingles array<int>"), "sets")

    def with_folds(rows: DataFrame) -> DataFrame:
        return rows.join(sets.select("node", "fold"), F.col("m.node") == F.col("node")).select("bucket", F.col("m").withField("fold", F.col("fold")).alias("m"))

    active, small = (saved(few(with_folds(x), joined), name) for x, name in ((large, "large"), (small, "small")))
    tried, roots, chains = near, none, none

    def joined_by(pairs: DataFrame, n: int) -> None:
        """Takes those of n pairs that are verified into the classes known so far."""
        nonlocal roots, chains
        found = saved(few(verified(pairs, sets, n), n, 2000), "verified")
        if not found.isEmpty():
            chains = components(found.unionByName(chains.select(F.col("node").alias("a"), F.col("root").alias("b"))))
            roots = saved(few(chains.unionByName(chains.select(F.col("root").alias("node"), "root")).distinct(), 2 * chains.count()), "roots")

    joined_by(near, near.count())

    def mixed(rows: DataFrame) -> DataFrame:
        """Members (bucket, m) with their class and `of`, the bucket's number of members, of those buckets that have members of two classes: others have no further pairs."""
        weighted = roots.join(rows.groupBy(F.col("m.node").alias("node")).agg(F.count("*").alias("n")), "node")
        n = rows.count()
        classed = lookup(rows.select("bucket", "m", F.col("m.node").alias("node")), weighted, "node", "n").select("bucket", "m", F.coalesce("root", "node").alias("class"))
        now = saved(few(classed, n), "classed")  # read twice: to find the buckets, and to keep their members
        two = now.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
        return saved(few(lookup(now, two.select("bucket", "n", F.col("n").alias("of")), "bucket", "n", n).where("of is not null"), n), "active")

    for k in range(ROUNDS + 1):
        classed = mixed(active)
        rest = mixed(small) if k == 0 else None
        done = classed.isEmpty()
        if done and (rest is None or rest.isEmpty()):
            break
        if k < ROUNDS:
            leader = classed.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "m.node", F.lit(k)).alias("h"), "m", "class")).alias("l"), F.count("*").alias("n"))
            asked = lookup(classed, leader.select("bucket", "n", F.col("l.m").alias("other"), F.col("l.class").alias("other_class")), "bucket", "n", classed.count()).select("m", "class", "other", "other_class")
        else:
            under = mixed(saved(few(rarest(classed, sets), 20 * classed.count()), "rarest"))
            asked = crossed(under, lambda x, y: _can_share(x, y) & _folds_fit(x, y)).select("class", "other_class", *[F.col(c).dropFields("before").alias(c) for c in ("m", "other")])
        if rest is not None:
            asked = asked.unionByName(crossed(rest, _folded_alike))
        new = saved(few(ordered(asked.where("class <> other_class")).join(tried, ["a", "b"], "left_anti"), classed.count() + (rest.count() if rest else 0)), "candidates")
        n = new.count()
        if n:
            tried = tried.unionByName(new)
            joined_by(new, n)
        if done:
            break
        active = classed.select("bucket", "m")
    return roots


def rarest(active: DataFrame, sets: DataFrame) -> DataFrame:
    """The members m of active, each once, (bucket, m with `before`) under those of their shingles of which two sets of SIMILARITY must share one; before: how many shingles come before that one.

    Whatever order shingles have, sets x and y that share SIMILARITY of both share
    one of the first |x| - SIMILARITY * |x| + 1 of x and as many of y. The order is
    that of how many members have a shingle, so what many texts share comes last;
    shingles of one member alone are counted in, but lead to nothing.
    """
    members = active.select("m").distinct().withColumn("node", F.col("m.node"))
    rows = saved(sets.join(members.select("node"), "node", "left_semi").select("node", F.explode("shingles").alias("shingle")), "shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("n")).withColumn("often", F.col("n"))
    ranked = lookup(rows, often, "shingle", "n", rows.count()).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("all"))
    needed = F.size("all") - F.ceil(SIMILARITY * F.size("all") - 1e-6).cast("int") + 1
    placed = F.transform(F.slice("all", F.lit(1), needed), lambda x, i: F.struct(x["shingle"].cast("long").alias("bucket"), i.alias("before"), x["often"].alias("often")))
    first = ranked.select("node", F.inline(F.filter(placed, lambda x: x["often"] > 1)))
    return first.join(members, "node").select("bucket", F.col("m").withField("before", F.col("before")).alias("m"))


def _can_share(x: Column, y: Column) -> Column:
    """Whether two members that are alike and share this shingle can be similar if it is the first that they share: what they share is it and others after it."""
    most = F.least(x["size"] - x["before"], y["size"] - y["before"])
    return _alike(x, y) & (most * (1 + SIMILARITY) >= SIMILARITY * (x["size"] + y["size"]) - 1e-6)


def crossed(active: DataFrame, like: Callable[[Column, Column], Column] = _alike) -> DataFrame:
    """Pairs of members (bucket, m, class, and `of`, the bucket's number of members, where it is known) of a bucket that are of two classes and can be similar, each once a bucket: blocks of about BLOCK members meet in groups, so no task has a whole bucket's."""
    if "of" not in active.columns:
        sizes = active.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("of", F.col("n"))
        active = lookup(active, sizes, "bucket", "n")
    dealt = active.withColumn("blocks", F.ceil(F.col("of") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("m.node"), F.col("blocks")).cast("int"))
    sent = dealt.select("bucket", "block", "m", "class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    groups = sent.groupBy("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j")).agg(F.collect_list(F.struct("block", "m", "class")).alias("all"))

    def fit(x: Column) -> Column:
        return F.filter("all", lambda y: F.when(F.col("i") == F.col("j"), x["m"]["node"] < y["m"]["node"]).otherwise(x["block"] < y["block"]) & (x["class"] != y["class"]) & like(x["m"], y["m"]))

    found = F.flatten(F.transform("all", lambda x: F.transform(fit(x), lambda y: F.struct(x["m"].alias("m"), x["class"].alias("class"), y["m"].alias("other"), y["class"].alias("other_class")))))
    return groups.select("i", "j", F.inline(found)).drop("i", "j")


def keep_one(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """docs with one row of each class of near duplicates: that of the least id, of a null one only where a class has no other.

    A class is what pairs of similarity SIMILARITY or more connect. Texts without
    words, null ones too, are one class; repeated rows count as copies; an empty
    table gives no rows; other columns stay. Texts are written once with a number,
    and neither their pairs nor what is kept moves them.
    """
    names = docs.columns
    text, id_at = f"c{names.index('text')}", f"c{names.index(id_column)}"
    held = saved(in_small_batches(docs).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("row")), "numbered", "zstd")
    n = held.count()
    parts, width = layout(n)
    n_bits = -(-parts * width // 64) * 64
    sketched = saved(sketches(held.select("row", F.col(id_at).cast("long").alias("doc_id"), text_of(held, text).alias("text")), n_bits), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    firsts = saved(few(sketched.groupBy("node").agg(first), n), "firsts")
    nodes = saved(only(sketched.select("row", "node", "size", "c1", "c2", "fp"), firsts.select("first.row")), "nodes")
    roots = links(nodes, held, text, n_bits, parts)
    linked = firsts.join(roots, "node", "left")
    alone = linked.where("root is null").select("first.row")
    kept = alone.unionByName(linked.where("root is not null").groupBy("root").agg(F.min("first").alias("first")).select("first.row"))
    return only(held, kept).select(*[F.col(c).alias(names[i]) for i, c in enumerate(held.columns[:-1])])
