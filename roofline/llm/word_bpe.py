"""Word-wise encoding with a public BPE file: a bounded memo in front of the library.

The tokenizer splits at white space and at the ends of letter runs, so the ids of a text
are those of its words in turn.  Words repeat, so the library sees each distinct word of
a batch at most once.  A batch has more rare words than the memo has places: a word takes
one if the batch has it twice, and without the punctuation behind it.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._words import Memo, encode_distinct

PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes Arrow arrays of texts to little-endian ids, as the library does without special tokens added."""

    def __init__(self, path: str, memo: int = 24 << 20):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        small = self.tok.get_vocab_size() <= 1 << 16
        self.dtype, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        # Whether the file lower-cases, splits at letter runs and has special tokens in angle brackets only.
        self.wordwise = ("[\\\\p{L}]+" in json.dumps(spec.get("pre_tokenizer")) and '"ByteLevel"' in json.dumps(spec.get("pre_tokenizer"))
                         and "Lowercase" in json.dumps(spec.get("normalizer"))
                         and all(t["content"].startswith("<|") for t in spec["added_tokens"]))
        self.letters = _byte_letters()
        self.memo = Memo(self._new, memo)

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _new(self, word: str) -> bytes:
        if not word:
            return b""
        if word.isalpha():
            if word.isascii():
                return self._bytes([t.id for t in self.tok.model.tokenize(word)])
            if word == word.lower() and unicodedata.is_normalized("NFC", word):
                return self._bytes([t.id for t in self.tok.model.tokenize(
                    word.encode("utf-8").decode("latin-1").translate(self.letters))])
        return self.direct(word)

    def _distinct(self, chunks: pa.DictionaryArray) -> list[bytes]:
        """Ids of each distinct word; a run of letters and the punctuation behind it are encoded on their own."""
        words = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        cores = [w.rstrip(PUNCTUATION) for w in words]
        cores = [c if c.isalpha() else w for w, c in zip(words, cores)]
        times: dict[str, int] = {}
        for core, n in zip(cores, np.bincount(chunks.indices, minlength=len(words)).tolist()):
            times[core] = times.get(core, 0) + n
        ids = {core: self.memo[core] if n > 1 else self.memo.once(core) for core, n in times.items()}
        return [ids[c] if len(c) == len(w) else ids[c] + self.memo[w[len(c):]] for w, c in zip(words, cores)]

    def direct(self, text: str) -> bytes:
        return self._bytes(self.tok.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.wordwise:
            return [self.direct(t) for t in texts.to_pylist()]
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        out = encode_distinct(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), self._distinct)
        for i in np.flatnonzero(special).tolist():  # a special token's text, as written
            out[i] = self.direct(texts[i].as_py())
        return out


@functools.lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
