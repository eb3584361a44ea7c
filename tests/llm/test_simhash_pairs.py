"""The pipeline's near duplicates against all pairs of five-word shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tilework.llm import common, simhash, simhash_pairs

SCHEMA = "doc_id long, text string, lang string"


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    sets = [grams(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for k, (i, t, _) in zip(label, rows, strict=True):
        least[k] = min(least.get(k, (True, 0)), (i is None, i or 0))
    return sorted(least.values())


def corpus(seed, groups, copies):
    rng = np.random.default_rng(seed)
    rows = [(None, None, "x"), (3_000, "", "x"), (3_001, " \n", "x"), (3_002, "one two", "x"), (None, "One TWO", "x"), (None, "alone", "x")]
    for g in range(groups):
        base = rng.integers(0, 5000, 400)
        for c in range(copies):
            words = base.copy()
            at = rng.integers(0, len(words), int(rng.integers(0, 12)))
            words[at] = rng.integers(5000, 9000, len(at))
            rows.append((g * 100 + c, " ".join(f"w{w}" for w in words), "y"))
    return [*rows, rows[-1]]


@pytest.mark.parametrize(("groups", "copies", "rounds", "block", "large"), [(25, 5, 3, 64, 64), (2, 40, 0, 7, 2), (1, 60, 1, 7, 5)])
def test_near_duplicates(spark, monkeypatch, groups, copies, rounds, block, large):
    monkeypatch.setattr(simhash_pairs, "ROUNDS", rounds)
    monkeypatch.setattr(simhash_pairs, "BLOCK", block)
    monkeypatch.setattr(simhash_pairs, "LARGE", large)
    monkeypatch.setattr(simhash_pairs, "RECALL", 0.9999)  # so that chance decides nothing here
    rows = corpus(groups, groups, copies)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == brute(rows)


def test_no_rows(spark):
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_recall_of_buckets():
    """Of pairs of similarity 0.8 to 0.85, those that share a bucket, at the layouts of a small and of a large table."""
    rng = np.random.default_rng(9)
    for n in (10_000, 10_000_000):
        parts, width = simhash_pairs.layout(n)
        n_bits = -(-parts * width // 64) * 64
        groups = [list(range(i * n_bits // parts, (i + 1) * n_bits // parts)) for i in range(parts)]
        found = total = 0
        while total < 150:
            words = rng.integers(0, 3000, 300)
            other = words.copy()
            at = rng.integers(0, 300, int(rng.integers(4, 9)))
            other[at] = rng.integers(3000, 9000, len(at))
            a, b = (simhash_pairs.word_hashes(" ".join(f"w{x}" for x in w)) for w in (words, other))
            x, y = set(simhash_pairs.shingles(a).tolist()), set(simhash_pairs.shingles(b).tolist())
            if not 0.8 <= similarity(x, y) < 0.85:
                continue
            total += 1
            f, g = (simhash_pairs.bits_of(simhash_pairs.fingerprint(w, n_bits)[None]) for w in (a, b))
            found += any((f[0, k] == g[0, k]).all() for k in groups)
        assert found >= 0.93 * total


def test_wide_lookup_copies_hot_keys(spark):
    """A key of most rows is repeated and dealt, no row is lost or doubled, and keys without a value go."""
    left = spark.createDataFrame([(1, i) for i in range(200)] + [(2, i) for i in range(7)] + [(9, 1)], "k long, other long")
    table = spark.createDataFrame([(1, [1, 2]), (2, []), (3, [4])], "k long, v array<int>")
    got = common.lookup_wide(left, table, "k", "other", hot_share=10).collect()
    assert sorted((r.k, r.other, tuple(r.v)) for r in got) == sorted([(1, i, (1, 2)) for i in range(200)] + [(2, i, ()) for i in range(7)])
    assert common.lookup_wide(left.limit(0), table, "k", "other").count() == 0


def test_rarest_shingles_find_all_similar_pairs(spark):
    """Sets that share a long common part, of sizes 1 to 60: every pair of similarity 0.8 meets under a rare shingle, few others do."""
    rng = np.random.default_rng(4)
    common = rng.choice(10_000, 40, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(common, int(rng.integers(1, 41)), replace=False), rng.integers(10_000, 90_000, int(rng.integers(0, 20)))])) for _ in range(60)]
    for s in sets[:30]:  # partners about as similar as needed
        sets.append(np.unique(np.concatenate([s[: len(s) - len(s) // 9], rng.integers(90_000, 99_000, len(s) // 9)])))
    made = {tuple(s.tolist()) for s in sets}
    sets = [set(s) for s in sorted(made)]
    m = [(7, (i, len(s), 0, 0)) for i, s in enumerate(sets)]
    active = spark.createDataFrame(m + m[:9], "bucket long, m struct<node: long, size: int, c1: long, c2: long>")
    held = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "node long, shingles array<int>")
    rows = simhash_pairs.rarest(active, held).withColumn("class", simhash_pairs.F.col("m.node"))
    met = {tuple(sorted((r.m.node, r.other.node))) for r in simhash_pairs.crossed(rows, simhash_pairs._can_share).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if similarity(sets[i], sets[j]) >= 0.8}
    assert len(want) >= 10 and want <= met and len(met) < len(sets) * (len(sets) - 1) / 8
    assert simhash_pairs.rarest(active.limit(0), held).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_a_walk(spark, seed):
    """Chains, stars, loops and repeated edges in either direction."""
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 230)] + [(230 + i, 200 + i) for i in range(3)] + [(5, 5)]
    edges += [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(45)]
    edges += edges[:9]
    least = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((n, m) for n, m in least.items() if n != m)
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_families_are_verified_where_each_set_is_once(spark, tmp_path, monkeypatch):
    """A family of texts all alike, a star, a chain and a long pair: the pairs verified are those of brute force, and a family's sets are sent far less often than it has pairs."""
    rng = np.random.default_rng(3)
    sets = {}
    for i in range(60):  # a family of close and less close sets
        sets[i] = np.unique(np.concatenate([np.arange(100 + 5 * (i % 7)), rng.integers(1_000, 9_000, int(rng.integers(0, 25)))]))
    for i in range(100, 140):
        sets[i] = np.arange(int(rng.integers(1, 9)))
    sets[200], sets[201] = np.arange(50_000), np.arange(9_000, 50_000)
    pairs = [(i, j) for j in range(60) for i in range(j)] + [(100, i) for i in range(101, 120)] + [(i, i + 1) for i in range(120, 139)] + [(200, 201)]
    rows = [((i % 3 << simhash_pairs.PARTITION_BIT) + i, i, len(x), x.tolist()) for i, x in sets.items()]
    spark.createDataFrame(rows, "row long, node long, size int, shingles array<int>").write.parquet(f"{tmp_path}/sets")
    held, asked = spark.read.parquet(f"{tmp_path}/sets"), spark.createDataFrame(pairs, "a long, b long")
    want = {(i, j) for i, j in pairs if similarity(set(sets[i].tolist()), set(sets[j].tolist())) >= simhash_pairs.SIMILARITY}
    assert 20 < len(want) < len(pairs) - 20
    for cell, size in ((simhash_pairs.CELL, simhash_pairs.PAIRS), (3_000, 5), (1, 1)):
        monkeypatch.setattr(simhash_pairs, "CELL", cell)
        monkeypatch.setattr(simhash_pairs, "PAIRS", size)
        got = [(r.a, r.b) for r in simhash_pairs.verified(asked, held, len(pairs)).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        at = simhash_pairs.placed(asked, held.select("node", "size"), len(pairs)).collect()
        assert sorted((r.a, r.b) for r in at) == sorted(pairs)
        if cell == simhash_pairs.CELL and cell > 3_000:
            assert len({(r.place, x) for r in at for x in (r.a, r.b)}) < len(pairs) / 5
    assert simhash_pairs.verified(asked.limit(0), held, 0).count() == 0


def test_texts_go_to_python_in_small_batches(spark):
    """Both stages that hand whole texts to Python bound a batch by its bytes, not by 10,000 rows of any length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        common.in_small_batches(spark.range(1))
        assert int(spark.conf.get(key).rstrip("b")) == common.BATCH_BYTES
        rows = spark.range(600, numPartitions=1).selectExpr("id", "repeat('x', 100000) text")

        def count(batches):
            for batch in batches:
                yield type(batch).from_pydict({"n": [batch.nbytes]})

        assert max(r.n for r in rows.mapInArrow(count, "n long").collect()) < 2 * common.BATCH_BYTES
        spark.conf.set(key, "1000")
        common.in_small_batches(rows)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.unset(key)


def test_folds_never_part_similar_sets(spark):
    """Of sets at and about the similarity all that reach it stay, and most of short ones far below it go; their folds differ in no more bits than they have shingles apart."""
    rng = np.random.default_rng(8)
    rows, apart = [], 0
    for k in range(300):
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 32, size, dtype="u8").astype("u4"))
        b = np.unique(np.concatenate([a[int(rng.integers(0, len(a) // 3 + 1)) :], rng.integers(0, 1 << 32, int(rng.integers(0, 1 + size // 6)), dtype="u8").astype("u4")]))
        x, y = (simhash_pairs.fold(z.view("i4")) for z in (a, b))
        one = len(set(a.tolist()) ^ set(b.tolist()))
        assert np.bitwise_count((x ^ y).view("u8")).sum() <= one
        rows.append((k, similarity(set(a.tolist()), set(b.tolist())), *[(len(z), tuple(f.tolist())) for z, f in ((a, x), (b, y))]))
    member = f"struct<size: int, fold: struct<{', '.join(f'f{i}: long' for i in range(simhash_pairs.FOLD // 64))}>>"
    table = spark.createDataFrame(rows, f"k int, similarity double, x {member}, y {member}")
    got = {r.k for r in table.where(simhash_pairs._folds_fit(simhash_pairs.F.col("x"), simhash_pairs.F.col("y"))).collect()}
    want = {k for k, s, *_ in rows if s >= 0.8}
    short = {k for k, s, x, _ in rows if s < 0.7 and 20 < x[0] < 150}
    assert len(want) > 50 and want <= got
    assert len(short) > 10 and len(short & got) < len(short) / 4


def test_unlike_members_of_a_family_are_not_paired(spark, monkeypatch):
    """Short texts that share much, no two of them enough: few of their pairs are asked for, and the documents kept are those of brute force."""
    monkeypatch.setattr(simhash_pairs, "RECALL", 0.9999)
    asked = []
    plain = simhash_pairs.verified

    def counted(pairs, sets, n):
        asked.append(n)
        return plain(pairs, sets, n)

    monkeypatch.setattr(simhash_pairs, "verified", counted)
    monkeypatch.setattr(simhash_pairs, "LARGE", 8)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 5000, 100)
    rows = []
    for k in range(120):
        words = base.copy()
        at = rng.choice(20, 3, replace=False) * 5
        words[at] = 10_000 + 3 * k + np.arange(3)
        rows.append((k, " ".join(f"w{w}" for w in words), "x"))
    kept = simhash_pairs.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((False, r.doc_id) for r in kept) == brute(rows)
    assert sum(asked) < len(rows) * (len(rows) - 1) / 2 / 5


@pytest.mark.parametrize("often", [[], [7, 9, 1000], list(range(40))])
def test_shared_buckets_are_the_same_whatever_is_named(spark, often):
    """Rows of buckets of one, two and most rows, with and without the large ones named."""
    rows = [(7, i) for i in range(500)] + [(9, 1), (9, 2), (10, 3), (11, 1), (11, 2), (11, 3), (12, 9)]
    got = simhash_pairs.shared(spark.createDataFrame(rows, "bucket long, row long"), often).collect()
    size = {b: sum(x == b for x, _ in rows) for b, _ in rows}
    assert sorted((r.bucket, r.row, r.met) for r in got) == sorted((b, i, size[b]) for b, i in rows if size[b] > 1)


def test_no_stage_writes_a_copy_of_rejected_texts(spark, monkeypatch):
    """Quality rules write no text on the way."""
    from tilework.llm import quality

    monkeypatch.setattr(quality, "saved", lambda *a: pytest.fail("a copy is written"))
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x")], SCHEMA)
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs).count() == 0


def test_members_ask_for_their_class_once(spark, monkeypatch):
    """Members of large and of small buckets and those under rare shingles go through the join with their classes once each time, and the classes stay those of brute force."""
    monkeypatch.setattr(simhash_pairs, "BLOCK", 7)
    monkeypatch.setattr(simhash_pairs, "LARGE", 5)
    monkeypatch.setattr(simhash_pairs, "RECALL", 0.9999)  # so that chance decides nothing here
    seen, asked = spark.sparkContext.accumulator(0), []

    def counted(left, table, key, weight, total=None):
        if key == "node":
            asked.append(left.count())

            def count(batches):
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            left = left.mapInArrow(count, left.schema)
        return common.lookup(left, table, key, weight, total)

    monkeypatch.setattr(simhash_pairs, "lookup", counted)
    rows = corpus(1, 1, 60)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == brute(rows)
    assert sum(asked) > 60 and seen.value == sum(asked)
