"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, and a posterior decides.

Votes of a document: one of 3 ** len(RULES) patterns at most, so the counts of
patterns are all that the estimation needs: Spark counts them, the driver
iterates over that bounded table, and patterns look up their posterior.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, saved, schema_with, text_of

_SYMBOL = re.compile(r"[#*$%&|<>]")
#: The commonest function words of the corpus' languages (de, en, es, fr).
FUNCTION_WORDS = frozenset(
    "the of and to in that is was for with der die das und den von mit ist ein eine de la el y en que los las un una por le les des et du dans une est pour a as are be by on at it this not zu im auf nicht sich con para al del il qui sur"
    .split()
)


class Signals(NamedTuple):
    """What the rules see of a text; the first five are also results."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_letters: int
    n_capitals: int
    n_adjacent_repeats: int
    n_shouts: int
    n_function_words: int
    top_word: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def signals(text: str) -> Signals:
    """Counts over the whole text; words are what lies between ASCII white space."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), "i8", n)
    repeats = 0
    if n > 3:
        pair = ids[:-1] * len(place) + ids[1:]
        _, pair = np.unique(pair, return_inverse=True)
        _, which, count = np.unique(pair[:-1] * len(place) + ids[2:], return_inverse=True, return_counts=True)
        twice = count[which] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeats = int(covered.sum())
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    counts = np.bincount(ids, minlength=1) if n else np.zeros(1, "i8")
    function = sum(int(counts[i]) for w, i in place.items() if len(w) < 6 and w.lower().decode("utf-8", "replace") in FUNCTION_WORDS)
    code = np.frombuffer(data, "u1")
    capital = int(((code >= 65) & (code <= 90)).sum())
    letters = capital + int(((code >= 97) & (code <= 122)).sum())
    blanks = int(((code == 32) | ((code >= 9) & (code <= 13))).sum())
    return Signals(n, len(text) - blanks, len(_SYMBOL.findall(text)), dup, repeats, letters, capital, int((ids[1:] == ids[:-1]).sum()), data.count(b"!!"), function, int(counts.max()))


#: name -> rule: 1 votes for the text, -1 against it, 0 abstains.
RULES: dict[str, Callable[[Signals], int]] = {
    "symbols": lambda s: -1 if 20 * s.n_symbols > s.n_words else 1 if s.n_symbols == 0 else 0,
    "repeats": lambda s: -1 if 5 * s.n_repeat_words > s.n_words else 1 if 50 * s.n_repeat_words <= s.n_words else 0,
    "lines": lambda s: -1 if s.n_dup_lines >= 4 else 1 if s.n_dup_lines == 0 else 0,
    "capitals": lambda s: -1 if 10 * s.n_capitals > 3 * s.n_letters else 1 if 10 * s.n_capitals < s.n_letters else 0,
    "stutter": lambda s: -1 if 10 * s.n_adjacent_repeats > s.n_words else 1 if 25 * s.n_adjacent_repeats <= s.n_words else 0,
    "shouts": lambda s: -1 if 10 * s.n_shouts > s.n_words else 0,
    "function_words": lambda s: -1 if 50 * s.n_function_words < s.n_words else 1 if 12 * s.n_function_words >= s.n_words else 0,
    "word_length": lambda s: -1 if s.word_chars > 9 * s.n_words or s.word_chars < 3 * s.n_words else 1 if 4 * s.n_words <= s.word_chars <= 7 * s.n_words else 0,
    "one_word": lambda s: -1 if 3 * s.top_word > s.n_words else 1 if 8 * s.top_word <= s.n_words else 0,
}

#: Rows that every rule is taken to have voted on before: against, abstaining, for; of bad and of good texts.
PRIOR_VOTES = np.array([[6.0, 6.0, 3.0], [0.3, 6.0, 9.0]])
PRIOR_GOOD, PRIOR_WEIGHT = 0.85, 20.0  # of the share of good texts
ROUNDS, TOLERANCE = 500, 1e-9
KEEP_AT = 0.5


def estimate(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each pattern, how each rule votes: rules x (bad, good) x (against, abstains, for), share of good texts) by expectation-maximisation.

    votes: patterns x rules of -1, 0, 1; counts: rows of each pattern. Rules vote
    independently given the class, each class having its own rates, so a rule
    that misses most bad texts weighs little when it votes for one and much when
    it votes against. The start takes patterns with votes against as likely bad.
    """
    against = (votes < 0).sum(1)
    posterior = np.where(against == 0, 0.95, np.where(against == 1, 0.4, 0.05))
    shown = np.stack([votes == v for v in (-1, 0, 1)], -1).astype("f8")  # patterns x rules x votes
    rates = np.zeros((votes.shape[1], 2, 3))
    share = PRIOR_GOOD
    for _ in range(ROUNDS):
        by_class = np.stack([(1 - posterior) * counts, posterior * counts])
        new = np.einsum("cp,prv->rcv", by_class, shown) + PRIOR_VOTES
        new /= new.sum(-1, keepdims=True)
        share = float((by_class[1].sum() + PRIOR_GOOD * PRIOR_WEIGHT) / (counts.sum() + PRIOR_WEIGHT))
        share = min(max(share, 0.01), 0.99)
        logit = np.log(share / (1 - share)) + np.einsum("prv,rv->p", shown, np.log(new[:, 1] / new[:, 0]))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        done, rates = np.abs(new - rates).max(initial=0) < TOLERANCE, new
        if done:
            break
    return posterior, rates, share


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def vote(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, the counts of FIELDS, base_failed and `votes` (a string of -, 0, + in the order of RULES) of every whole text; a null text has no words."""
    kept = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    source = docs.select(*kept, text_of(docs, text).alias("text"))

    def count(batches):
        for batch in batches:
            found = [signals(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            votes = ["".join("-0+"[rule(s) + 1] for rule in RULES.values()) for s in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array([getattr(s, f) for s in found], pa.int64()) for f in FIELDS], pa.array([s.base_failed for s in found], pa.bool_()), pa.array(votes, pa.string())],
                [*batch.schema.names[:-1], *FIELDS, "base_failed", "votes"],
            )

    return source.mapInArrow(count, schema_with(source.drop("text"), **dict.fromkeys(FIELDS, "long"), base_failed="boolean", votes="string"))


def posteriors(voted: DataFrame) -> DataFrame:
    """(votes, quality): the posterior probability of each pattern of votes among the documents that pass the base rules; under 3 ** len(RULES) rows."""
    found = voted.groupBy("votes").agg(F.sum(F.when(~F.col("base_failed"), 1).otherwise(0)).alias("n")).orderBy("votes").collect()
    matrix = np.array([["-0+".index(c) - 1 for c in r.votes] for r in found], "i8").reshape(-1, len(RULES))
    quality, _, _ = estimate(matrix, np.array([r.n for r in found], "f8"))
    return voted.sparkSession.createDataFrame([(r.votes, float(q)) for r, q in zip(found, quality, strict=True)], "votes string, quality double")


def judge(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, counts, base_failed, votes, quality, kept: a row for each row of docs.

    Null and empty texts fail the base rules; repeated rows and ids are judged
    each; null ids and an empty table pass through; other columns are ignored.
    Texts are counted once: the counts are written to the shared folder, then
    estimated over, then joined with the bounded table of patterns.
    """
    voted = saved(vote(docs, [id_column]).withColumnRenamed("k0", "doc_id"), "votes")
    return voted.join(F.broadcast(posteriors(voted)), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that `judge` would keep; the text column may be of any name.

    Texts vote twice, since the patterns' weights are known only after all have
    voted: once to be counted, once to be kept or not. That takes the time of
    reading them again, and no copy of them is written in between.
    """
    names = docs.columns
    renamed = in_small_batches(docs).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(text)

    def mark(batches):
        for batch in batches:
            found = [signals(x.as_py() or "") for x in batch.column(at)]
            votes = ["".join("-0+"[rule(s) + 1] for rule in RULES.values()) for s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(votes, pa.string()), pa.array([s.base_failed for s in found], pa.bool_())], [*batch.schema.names, "votes", "base_failed"])

    voted = renamed.mapInArrow(mark, schema_with(renamed, votes="string", base_failed="boolean"))
    good = voted.join(F.broadcast(posteriors(vote(renamed, [], f"c{at}"))), "votes").where(~F.col("base_failed") & (F.col("quality") >= KEEP_AT))
    return good.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
