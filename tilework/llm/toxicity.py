"""Toxicity by multiple-instance learning: sentences' scores are combined by noisy-or, and trained from documents' labels alone.

A document is toxic if one of its sentences is: 1 - product of (1 - p) over its
sentences, where p is logistic in the sentence's different words. A word counts
by itself and by its first and last letters, so that unseen forms of a word are
known by what they share with seen ones.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.optimise import minimise
from .common import saved, text_of

#: Labelled documents that are trained on at most, half of each label: those of the least hashed ids. The only bound there is.
TRAIN_DOCS = 16_000
#: Weights; features share them by hash.
BUCKETS = 1 << 20
#: Features of fewer training documents than this, or than this share of them, are not used.
LEAST_DOCS, LEAST_SHARE = 3, 0.001
#: Beginnings and ends of words that count.
STARTS, ENDS = (4, 5, 6), (4,)
#: Share of the squared weights in the loss, rounds of the fit, and the sentence's score without any word.
PENALTY, ROUNDS, BASE = 1e-4, 80, -5.0
#: What a toxic document weighs in the loss: a missed one costs more, and shrunk weights would else miss documents with one toxic word.
TOXIC_WEIGHT = 3.0
#: Words whose score a worker remembers.
WORDS_KEPT = 400_000

_SENTENCE, _WORD = re.compile(r"[^.!?。！？\n]+"), re.compile(r"\w+")


def features(word: str) -> list[int]:
    """The buckets of a lower-case word."""
    parts = ["w" + word, *[f"{k}<{word[:k]}" for k in STARTS if len(word) >= k], *[f"{k}>{word[-k:]}" for k in ENDS if len(word) >= k]]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def sentences(text: str):
    """(start, end, words) of every sentence: what stands between full stops, question and exclamation marks, and line ends."""
    for m in _SENTENCE.finditer(text):
        if words := set(_WORD.findall(m[0].lower())):
            yield m.start(), m.end(), words


def is_held_out(id_column: Column, parts: int = 5) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % parts == 0


def training_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, text: str = "text", id_column: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(text, toxic, weight): at most `most` labelled documents that are not held out; a weight makes up for what its label lost.

    Ids are drawn out of the labels, so texts are not moved: the drawn ids are few
    by their bound and are broadcast. Labels other than 0 and 1, null ids and ids
    without a document are not drawn; of an id's several labels the greatest
    counts, of its several documents the least text.
    """
    known = labels.select(F.col(id_column).cast("long").alias("_id"), F.col(label).cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    known = known.where(~is_held_out(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("_id", F.lit(11)))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for toxic, n in sorted(counts.items()):
        some = known.where(F.col("toxic") == toxic)
        if n > most // 2:
            some = some.where(F.col("h") <= min(2**63 - 1, int(-(2**63) + 2**64 * (2 * (most // 2) / n)))).orderBy("h", "_id").limit(most // 2)
        some = some.withColumn("weight", F.lit(max(1.0, n / (most // 2))))
        drawn = some if drawn is None else drawn.unionByName(some)
    if drawn is None:
        return docs.select(F.lit("").alias("text"), F.lit(0).alias("toxic"), F.lit(1.0).alias("weight")).limit(0)
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), text_of(docs, text).alias("text"))
    return rows.join(F.broadcast(drawn), "_id").groupBy("_id", "toxic", "weight").agg(F.min("text").alias("text")).select("text", "toxic", "weight")


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of all buckets, and last the base: the minimum of the weighted log loss of noisy-or, by L-BFGS.

    Arrays hold each different word once; sentences hold words, documents
    sentences. Nothing is learnt without documents of both labels: the base is
    then that of their share.
    """
    weights = np.zeros(BUCKETS + 1)
    weights[-1] = BASE
    if not len(toxic) or toxic.min() == toxic.max():
        weights[-1] = BASE if not len(toxic) or not toxic.max() else 2.0
        return weights
    ids: dict[str, int] = {}
    words: list[np.ndarray] = []
    per_sentence, per_doc, doc_words = [], [], []
    for text in texts:
        n, seen = 0, []
        for _, _, found in sentences(text):
            part = np.fromiter((ids.setdefault(w, len(ids)) for w in sorted(found)), "i4", len(found))
            words.append(part)
            per_sentence.append(len(part))
            seen.append(part)
            n += 1
        per_doc.append(n)
        doc_words.append(np.unique(np.concatenate(seen)) if seen else np.zeros(0, "i4"))
    word = np.concatenate(words) if words else np.zeros(0, "i4")
    sentence_of = np.repeat(np.arange(len(per_sentence)), per_sentence)
    doc_of = np.repeat(np.arange(len(per_doc)), per_doc)
    buckets = [features(w) for w in ids]
    owner = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    bucket = np.fromiter((x for b in buckets for x in b), "i4", len(owner))
    ends = np.cumsum([0, *[len(b) for b in buckets]])
    in_docs = np.zeros(BUCKETS, "i4")
    for some in doc_words:  # how many documents hold each bucket
        at = np.concatenate([bucket[ends[w] : ends[w + 1]] for w in some.tolist()]) if len(some) else np.zeros(0, "i4")
        in_docs[np.unique(at)] += 1
    kept = in_docs[bucket] >= max(LEAST_DOCS, LEAST_SHARE * len(texts))
    owner, bucket = owner[kept], bucket[kept]
    used, bucket = np.unique(bucket, return_inverse=True)
    has = np.bincount(owner, minlength=len(ids)) > 0  # words without a known feature add nothing
    shown = has[word]
    word, sentence_of = word[shown], sentence_of[shown]
    weight = weight * np.where(toxic == 1, TOXIC_WEIGHT, 1.0)
    share, total = weight / weight.sum(), len(per_sentence)
    size = len(used)

    def loss(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, base = at[0, :size], at[0, size]
        by_word = np.bincount(owner, w[bucket], len(ids))
        z = base + np.bincount(sentence_of, by_word[word], total)
        doubt = np.bincount(doc_of, np.logaddexp(0, z), len(per_doc))  # -log of the chance that no sentence is toxic
        clean = np.maximum(-np.expm1(-doubt), 1e-12)
        value = float((share * np.where(toxic == 1, -np.log(clean), doubt)).sum()) + PENALTY / 2 * float((w * w).sum())
        slope = share * np.where(toxic == 1, -np.exp(-doubt) / clean, 1.0)
        dz = slope[doc_of] / (1 + np.exp(-np.clip(z, -500, 500)))
        dword = np.bincount(word, dz[sentence_of], len(ids))
        return np.array([value]), np.append(np.bincount(bucket, dword[owner], size) + PENALTY * w, dz.sum())[None]

    found = minimise(loss, np.append(np.zeros(size), BASE)[None], rounds, 1e-6)[0]
    weights[used], weights[-1] = found[:size], found[size]
    return weights


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, **columns) -> np.ndarray:
    """The weights, learnt in one task from the training sample, which is bounded by `most`."""

    def learn(batches):
        texts, toxic, weight = [], [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
            weight += batch.column(2).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (texts[i], toxic[i]))
        made = train([texts[i] for i in order], np.array(toxic, int)[order], np.array(weight, float)[order])
        yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()], pa.binary())], ["weights"])

    sample = training_sample(docs, labels, most, **columns)
    row = saved(sample.repartition(1).mapInArrow(learn, "weights binary"), "weights").first()
    return train([], np.zeros(0, int), np.zeros(0)) if row is None else np.frombuffer(row[0])


class _Scores(dict):
    """A word's score, remembered."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = found = float(self.weights[features(word)].sum())
        return found


@lru_cache(1)
def _scores(data: bytes) -> _Scores:
    return _Scores(np.frombuffer(data))


def judge_text(text: str, scores: _Scores) -> tuple[float, list[tuple[int, int, float]]]:
    """(score, offending sentences as (start, end, score)): offending are those of 0.5 or more, and the highest, if the document is toxic."""
    base, doubt, found = float(scores.weights[-1]), 0.0, []
    for start, end, words in sentences(text):
        z = base + sum([scores[w] for w in words])
        doubt += z + np.log1p(np.exp(-z)) if z > 0 else np.log1p(np.exp(z)) if z > -30 else 0.0
        if z > base:
            found.append((z, start, end))
    score = -float(np.expm1(-doubt))
    top = max((z for z, _, _ in found), default=0.0)
    offending = [(s, e, 1 / (1 + float(np.exp(-z)))) for z, s, e in found if z >= 0 or (score >= 0.5 and z == top)]
    return score, offending


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences array<struct<start, end, score>>): every document's chance of being toxic and its offending sentences, in code points.

    Null and empty texts, and those without a word, have score 0; repeated rows
    and null ids stay; other columns are ignored, and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), is_held_out(F.col(id_column)).alias("held_out"), text_of(docs, text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(weights.tobytes())  # BUCKETS numbers
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def put(batches):
        scores = _scores(shared.value)
        for batch in batches:
            made = [judge_text(t.as_py(), scores) for t in batch.column(2)]
            found = [[{"start": s, "end": e, "score": p} for s, e, p in offending] for _, offending in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s for s, _ in made], pa.float64()), pa.array([int(s >= 0.5) for s, _ in made], pa.int32()), pa.array(found, kind)],
                ["doc_id", "held_out", "score", "predicted", "sentences"],
            )

    return rows.mapInArrow(put, "doc_id long, held_out boolean, score double, predicted int, sentences array<struct<start:long,end:long,score:double>>")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """score() with weights fitted on the labels of documents that are not held out."""
    return score(docs, fit(docs, labels, **options))
