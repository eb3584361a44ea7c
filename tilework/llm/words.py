"""Token ids of whole texts by the word-BPE tokenizer of the tokenizers library, remembered by pre-token.

That tokenizer drops white space and joins no two pre-tokens, so the ids of a
text are those of its pre-tokens in a row. Texts of ASCII and Latin-1 letters
are cut into pre-tokens here, and each pre-token goes through the library's BPE
model once; any other text goes through the library word by word. A text that
may hold an added token ('<|endoftext|>') goes through the library whole.
Memories are bounded and live as long as the worker.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: Pre-tokens and words that a worker remembers at most; those met later are encoded anew each time.
PIECES_KEPT, WORDS_KEPT = 400_000, 200_000
#: Texts of these characters alone are in normal form C once in lower case, and the pattern below cuts them as the library does.
_PLAIN = re.compile("[\t-\r -~ß-öø-ÿÀ-ÖØ-Þ]*").fullmatch
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+").findall
#: Python takes these for white space, the library does not.
_SEPARATORS = re.compile("[\x1c-\x1f]").search


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordEncoder:
    """encode(text) gives the ids as bytes of little-endian unsigned 16-bit integers; the vocabulary has under 65,536 entries."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65_535:
            raise ValueError("ids of this vocabulary do not fit in 16 bits")
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What all added tokens start with, up to the first letter: few texts hold it, so few are searched. Case is ignored, as the library may match in normal form.
        self.lead = re.match(r"[^\w\s]*", os.path.commonprefix(added))[0]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE).search
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        bytes_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows these as themselves, the others from 256 on
        others = [b for b in range(256) if b not in bytes_shown]
        self.shown = {b: chr(b) for b in bytes_shown} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join(map(self.shown.__getitem__, piece.encode()))
        got = np.array([t.id for t in self.model.tokenize(text)], "<u2").tobytes()
        if len(self.pieces) < PIECES_KEPT and len(piece) <= 64:
            self.pieces[piece] = got
        return got

    def _word(self, word: str, plain: bool) -> bytes:
        if plain:
            known, new = self.pieces.get, self._piece
            got = b"".join([known(x) or new(x) for x in _PIECES(word)])
        else:
            got = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u2").tobytes()
        if len(self.words) < WORDS_KEPT and len(word) <= 64:
            self.words[word] = got
        return got

    def encode(self, text: str) -> bytes:
        if self.lead in text and self.added(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        known, new = self.words.get, self._word
        if _PLAIN(text):
            return b"".join([known(w) or new(w, True) for w in text.lower().split()])
        if _SEPARATORS(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return b"".join([known(w) or new(w, False) for w in text.split()])


@functools.lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker process."""
    return WordEncoder(path)
