"""Token ids of whole texts by the tokenizers library.

The word tokenizer drops white space before it merges, so no token spans two
white-space words and a text's ids are those of its words in a row.  Each task
keeps the ids of words that it has met; a new word goes to the library.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array

import numpy as np
from tokenizers import Tokenizer

#: Words of which a task keeps the ids. Beyond, it forgets all and starts anew.
KEPT_WORDS = 1_000_000
#: Longer words are not kept.
KEPT_LENGTH = 48

# Latin letters in lower case that normalisation leaves alone, then plain punctuation
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?]*)\Z")
# control characters that str.split takes for white space and the tokenizer does not
_NO_SPACE = re.compile("[\x1c-\x1f]")
# beyond these letters, case folding is left to the library
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


class WordIds(dict):
    """``encode(text)``: little-endian unsigned 32-bit ids of a text, no special tokens added."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        folds = [n["type"] for n in (parts.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (
            steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
            and folds == ["NFC", "Replace", "Lowercase"] and parts.get("post_processor") is None
        )
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        plain = _PLAIN.match(word)
        if not plain:
            return self._keep(word, self.whole(word))
        letters, marks = plain.groups()
        if marks:
            tail = self.get(marks) or self._keep(marks, self.whole(marks))
            return self._keep(word, self[letters] + tail)
        piece = letters if letters.isascii() else "".join(map(self.letters.__getitem__, letters.encode()))
        return self._keep(word, array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes())

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_word or _NO_SPACE.search(text):
            return self.whole(text)
        # lower case first makes fewer words; not where it could make a special token of ordinary text
        if "<|" not in text and not _BEYOND_LATIN.search(text):
            text = unicodedata.normalize("NFC", text).lower()
        return b"".join(map(self.__getitem__, text.split()))


@functools.cache
def word_ids(path: str) -> WordIds:
    """The encoder of a Python worker: its tasks share the vocabulary and the words met."""
    return WordIds(path)
