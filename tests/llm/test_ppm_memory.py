"""What a worker of the byte model holds while it looks grams up."""

import tracemalloc

import numpy as np

from tilework.llm import lm


def test_lookups_hold_little_beside_the_text():
    """3 MB of text: the arrays of one step are small, whatever the text's length, and the sums stay those of single grams."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 103, n).astype("u1")) for n in (1_500_000, 0, 7, 1_500_000)]
    stream, starts = lm._stream(texts)
    grams = lm.grams(stream, lm.ORDER, len(stream))
    codes = np.unique(grams)
    answers = lm._Answers(codes, -(codes % 97) / 10)
    tracemalloc.start()
    got = lm.code_lengths(texts, answers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    real = np.where(stream[lm.ORDER :] != lm.BEGIN, -(grams % 97) / 10, 0.0)
    ends = [*(starts[1:] - lm.ORDER), len(real)]
    assert np.allclose(got, [real[max(0, a - lm.ORDER) : b].sum() for a, b in zip(starts, ends, strict=True)])
    assert peak < 5 * len(stream)  # the stream is written twice
