"""Pre-tokens of the word-end BPE and their ids, by the tokenizers library.

No pre-token reaches over a space or line end, and neither do composition and lower case, so texts are cut there and each distinct
stretch is encoded once per worker cache. Stretches whose characters, in lower case too, all lie below U+0300 are split by one pattern:
there NFC changes nothing, lower case works character by character, and the classes of letters, digits and white space are fixed. Other
stretches go through the library's own normalizer and pre-tokenizer. Either way the library's model merges the pre-tokens.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np
import public_tokenizers
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Most distinct stretches, and pre-tokens, that a worker remembers.
CACHE_WORDS = 400_000
LETTERS = "".join(c for c in map(chr, range(0x300)) if regex.match(r"\p{L}", c))
DIGITS = "".join(c for c in map(chr, range(0x300)) if regex.match(r"\p{N}", c))
SPACES = "\t-\r \x85\xa0"
#: The library's pattern for characters below U+0300, with the classes written out: `re` runs it several times faster.
PLAIN = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")
#: Characters beyond the pattern's, and those below whose lower case is (such as U+023A): texts with them go the library's way.
OTHER = re.compile("[^\x00-\u02ff]|[" + "".join(c for c in map(chr, range(0x300)) if max(c.lower()) >= "\u0300") + "]")


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=2)
def words_of(path: str) -> "Words":
    return Words(path)


class Words:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.letters = dict(zip(range(256), byte_letters(), strict=True))
        self.type = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.type).type
        #: Ids of a pre-token, and of a stretch without a space or line end, as bytes.
        self.ids = Remembered(lambda word: array(self.type, self.merge(word)).tobytes())
        self.stretches = Remembered(self.stretch)

    def spell(self, word: str) -> str:
        """The word in the vocabulary's letters, one a byte."""
        if word.isascii() and word.isprintable():
            return word
        return "".join(map(self.letters.__getitem__, word.encode("utf-8", "replace")))

    def merge(self, word: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(self.spell(word))]

    def stretch(self, part: str) -> bytes:
        if part.isascii() or not OTHER.search(part):
            if part.isalpha():
                return self.ids[part.lower()]
            word, last = part[:-1], part[-1:]
            if last in ".,;:!?" and word.isalpha():
                return self.ids[word.lower()] + self.ids[last]
        return b"".join(map(self.ids.__getitem__, self.words(part)))

    def parts(self, text: str):
        """Special strings as ids, the texts between them as stretches without a space or line end."""
        pieces = self.split_special.split(text) if self.split_special and "<" in text else [text]
        for piece in pieces:
            if piece in self.special:
                yield self.special[piece]
            elif piece:
                yield piece.replace("\n", " ").split(" ")

    def words(self, piece: str) -> list[str]:
        if piece.isascii() or not OTHER.search(piece):
            return PLAIN.findall(piece.lower())
        back = self.unspell
        return [back(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]

    def unspell(self, spelled: str) -> str:
        return bytes(map(self.bytes_of.__getitem__, spelled)).decode("utf-8")

    @functools.cached_property
    def bytes_of(self) -> dict[str, int]:
        return {c: b for b, c in self.letters.items()}

    def encode(self, text: str) -> list[int]:
        return self.id_array(text).tolist()

    def id_array(self, text: str) -> np.ndarray:
        out = [np.array([p], self.kind).tobytes() if isinstance(p, int) else b"".join(map(self.stretches.__getitem__, p)) for p in self.parts(text)]
        return np.frombuffer(b"".join(out), self.kind)


class Remembered(dict):
    """Answers by word. The first words to come stay, as frequent ones come early; when many others were asked for, it starts anew."""

    def __init__(self, answer, lasting=()):
        super().__init__(lasting)
        self.answer, self.lasting, self.passed = answer, lasting, 0

    def __missing__(self, word: str):
        got = self.answer(word)
        if len(self) < CACHE_WORDS + len(self.lasting):
            self[word] = got
            return got
        self.passed += 1
        if self.passed > 4 * CACHE_WORDS:
            self.clear()
            self.update(self.lasting)
            self.passed = 0
        return got


def byte_letters() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    letters = {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]
