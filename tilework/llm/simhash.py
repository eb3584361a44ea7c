"""SimHash near-duplicates by the generalised pigeonhole principle.

Equal fingerprints collapse first. The 64 bits are grouped into partitions of
bits that go together, each with a threshold of its own: if thresholds t_i (-1:
not probed) add up to radius - partitions + 1, two fingerprints within the
radius differ in at most t_i bits of some partition i. Dynamic programming
allocates them so that the estimated probes and candidates are fewest.
Fingerprints meet others in the buckets of a partition and are verified.
Buckets with more fingerprints than paying all pairs is worth go another exact
way: two 64-bit values are within 2 bits if and only if some value is within 1
bit of both, so each member names itself and its 64 neighbours, and all that
name the same value are linked to the least of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, fresh, hashed_sample, lookup, saved, schema_with, text_of

RADIUS = 2
SEED = 42
#: Fingerprints that bit correlations and candidate counts are estimated on at most (those of the least hashes); only costs depend on them.
SAMPLE = 4096
#: Pairs of a bucket of n are n * (n - 1) / 2, its midpoints 65 * n: beyond this n the latter are fewer.
LARGE_BUCKET, MIDPOINTS = 130, 65
#: A probe is a row that is shuffled and sorted, and costs as much as so many comparisons.
PROBE_COST = 20


def fingerprint(text: str, words: int = 3) -> int:
    """The SimHash of a whole text: ASCII lower case, shingles of `words` words, repeats included."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, parts), "i8", len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns named, and `fp` (the 64 bits as a signed long) of each row's whole text; a null text has no words."""
    kept = docs.select(*[F.col(f"`{c}`") for c in columns])
    fp, words = fresh(kept, "fp"), fresh(kept, "text_")
    source = docs.select(*[F.col(f"`{c}`") for c in columns], text_of(docs, text).alias(words))

    def add(batches):
        for batch in batches:
            made = np.array([fingerprint(x.as_py()) for x in batch.column(batch.num_columns - 1)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.int64())], [*batch.schema.names[:-1], fp])

    return source.mapInArrow(add, schema_with(source.drop(words), **{fp: "long"}))


def bits_of(fingerprints: np.ndarray) -> np.ndarray:
    """The bits of fingerprints (n x words of 64 bits), lowest first: n x bits."""
    return np.unpackbits(np.ascontiguousarray(fingerprints, "<u8").view("u1").reshape(len(fingerprints), -1), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """The columns of bits in groups of about equal size, correlated ones together: each group grows by the bit that goes best with it."""
    n = bits.shape[1]
    spread = bits - bits.mean(0)
    norm = np.sqrt((spread**2).sum(0))
    tie = np.abs(np.stack([np.einsum("i,ij->j", column, spread) for column in spread.T])) / np.maximum(np.outer(norm, norm), 1e-9)
    left, out = np.ones(n, bool), []
    for k in range(parts):
        size = n * (k + 1) // parts - n * k // parts
        group = [int(np.where(left, tie[:, left].sum(1), -1).argmax())]
        left[group[0]] = False
        score = tie[:, group[0]].copy()
        while len(group) < size:
            group.append(int(np.where(left, score, -1).argmax()))
            left[group[-1]] = False
            score += tie[:, group[-1]]
        out.append(sorted(group))
    return out


def part_keys(bits: np.ndarray, group: list[int]) -> np.ndarray:
    """The group's bits (63 at most) of each row as a number, the group's first bit lowest."""
    return np.einsum("ij,j->i", bits[:, group].astype("u8"), np.uint64(1) << np.arange(len(group), dtype="u8"))


def flips(width: int, radius: int) -> list[int]:
    """What to change, bit by bit, to get to each key within the radius; 0 first."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _cost(keys: np.ndarray, width: int, radius: int, n: int) -> float:
    """Estimated probes and candidates of n fingerprints, if this partition is probed within `radius` bits; keys are a sample's."""
    if radius < 0:
        return 0.0
    found, counts = np.unique(keys, return_counts=True)
    met, scale, changes = 0.0, n / max(1, len(keys)), flips(width, radius)
    for f in changes:
        other = found ^ np.uint64(f)
        at = np.minimum(np.searchsorted(found, other), len(found) - 1)
        partners = np.where(found[at] == other, counts[at] - (f == 0), 0) * scale
        met += float(np.minimum(counts * scale * partners / 2, MIDPOINTS * counts * scale).sum())  # large buckets go by midpoints
    met += n**2 * len(changes) / 2.0**width / 2  # what the sample is too small to show
    return PROBE_COST * n * len(changes) + met


def allocate(bits: np.ndarray, n: int, radius: int = RADIUS, choices: tuple[int, ...] | None = None, most: int | None = None) -> tuple[list[list[int]], list[int], float]:
    """(bits of each partition, their thresholds, estimated cost) for a sample's bits: the cheapest over `choices` of how many partitions (one to radius + 1), thresholds up to `most` (radius)."""
    best = None
    for parts in choices or range(1, radius + 2):
        groups = group_bits(bits, parts)
        want = radius - parts + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # sum of thresholds so far -> cheapest
        for g in groups:
            keys = part_keys(bits, g)
            costs = {t: _cost(keys, len(g), t, n) for t in range(-1, (radius if most is None else most) + 1)}
            new: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, chosen) in table.items():
                for t, c in costs.items():
                    if total + t not in new or cost + c < new[total + t][0]:
                        new[total + t] = (cost + c, [*chosen, t])
            table = new
        if want in table and (best is None or table[want][0] < best[2]):
            best = (groups, table[want][1], table[want][0])
    return best


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: links between different fingerprints (column fp, each once) of at most `radius` bits.

    All links are found within ordinary buckets; of those that meet in a large
    one, enough that linked fingerprints stay connected through links found.
    """
    if radius != 2:
        raise ValueError("the way around large buckets is made for a radius of 2")
    n = distinct.count()
    sample = np.array([r[0] for r in hashed_sample(distinct.select("fp"), F.xxhash64("fp"), SAMPLE).collect()], "i8").view("u8")
    if len(sample) < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a < b")
    groups, thresholds, _ = allocate(bits_of(sample.reshape(-1, 1)), n, radius)

    def masks(value: Column, bits: list[int], r: int) -> Column:
        mask = np.uint64(sum(1 << b for b in bits)).view("i8").item()
        flips = [()] + [c for k in range(1, r + 1) for c in combinations(bits, k)]
        return F.array(*[F.struct(F.lit(f == ()).alias("home"), value.bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(np.array([sum(1 << b for b in f)], "u8").view("i8")[0].item())).alias("key")) for f in flips])

    probed = [(i, g, t) for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]
    rows = None
    for i, g, t in probed:
        got = distinct.select("fp", F.inline(masks(F.col("fp"), g, t))).select("fp", "home", F.struct(F.lit(i).alias("part"), "key").alias("bucket"))
        rows = got if rows is None else rows.unionByName(got)
    rows = saved(rows, "probes")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.count_if("home").alias("homes"), F.count("*").alias("n")).where("homes > 0 and size > 1")
    met = saved(lookup(rows, sizes, "bucket", "n").where("size is not null"), "met")

    members = met.where(F.col("size") <= LARGE_BUCKET).groupBy("bucket").agg(F.collect_list(F.struct("fp", "home")).alias("members"))
    pairs = F.expr(f"flatten(transform(members, x -> transform(filter(members, y -> x.fp < y.fp and (x.home or y.home) and bit_count(x.fp ^ y.fp) <= {radius}), y -> struct(x.fp as a, y.fp as b))))")
    found = members.select(F.inline(pairs))

    crowd = met.where(F.col("size") > LARGE_BUCKET).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(np.array([1 << b], "u8").view("i8")[0].item())) for b in range(64)])
    star = crowd.select("fp", F.explode(near).alias("middle")).groupBy("middle").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    edges = star.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return found.unionByName(edges).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches, by alternating large and small stars.

    Each round's edges are written to the shared folder, in few files where they
    are few; rounds grow with the logarithm of the longest chain. The end is where
    a large star changes nothing (then all that a node is linked to below it is
    linked to nothing lower) and no node has two roots.
    """
    now = saved(edges.where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = saved(few(lookup(both.where("b > a"), least, "a", "n", 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), state[0]), "stars")
        stars = _state(large)
        if stars == state and large.select("a").distinct().count() == stars[0]:
            break
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = lookup(large, low, "a", "n", stars[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = saved(few(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), 2 * stars[0]), "edges")
        state = _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(fps: DataFrame, id_column: str, radius: int = RADIUS) -> DataFrame:
    """fps (written; with fp and the id) and `component_id`: the least id reachable over links of its fingerprint.

    Ids that are null count for a class only where it has no other, which then is
    null.
    """
    distinct = saved(fps.groupBy("fp").agg(F.min(id_column).alias("least"), F.count("*").alias("n")), "distinct")
    chains = components(links(distinct.select("fp"), radius))
    roots = chains.unionByName(chains.select(F.col("root").alias("node"), "root")).distinct()
    grouped = saved(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "grouped")
    best = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("w"))
    labels = saved(lookup(grouped.select("fp", "n", "root"), best, "root", "w"), "labels")
    return lookup(fps, labels.select("fp", "n", "component_id"), "fp", "n")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of each row of docs.

    Texts without words, null ones too, have fingerprint zero and are linked like
    any other. Repeated rows and ids stay; other columns are ignored; an empty
    table gives no rows.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs).alias("text"))
    fps = saved(fingerprints(source, ["doc_id"]), "fingerprints")
    return classes(fps, "doc_id", radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
