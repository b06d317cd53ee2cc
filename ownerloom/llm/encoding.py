"""Token ids of whole texts by public tokenizers, with the ids of frequent words kept per worker.

The ids are those of the library's plain call on the whole text. Both vocabularies split at white
space and between kinds of characters before they merge, so a text's ids are its words' ids in a row:
the library's model merges each part of a word once, and the answer is kept for the next time the word is
met. Texts that hold a special token's string, and words with characters whose class depends on
the Unicode version, go through the library's whole call.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable

import numpy as np

from ownerloom.llm._common import worker_keeps

#: A worker keeps the ids of about so many words and as many again that it met before those (memory bound, not a
#: limit of results; one text's words come on top).
WORDS_KEPT = 120_000

#: Unicode's white space, on which both vocabularies split (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space other than the space and the line feed.
_OTHER = re.compile("[\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: White space with the word after it; no part of a word reaches over the places between these.
_SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_SEVERAL = re.compile(f"[{WHITE}]{{2}}")
#: Beyond these characters the library itself classifies, composes and lowers.
_FAR = re.compile("[^\\x00-\\x1b\\x20-\\x7f\\xa0-\\u024f]")
#: ASCII signs but the apostrophe, which may stand within a word's part.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 as it
    is, the other bytes counted up from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class OddSpace(Exception):
    """A text has white space that does not part its words one by one."""


class Kept(dict):
    """Ids by word: a word that is missing is learned, or moved over from the words kept before."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn, self.before = learn, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word) or self.learn(word)
        self[word] = ids
        return ids

    def turn(self) -> None:
        """Keep what was met since the last turn, so that rare words go and frequent ones stay."""
        self.before = dict(self)
        self.clear()


class WordEncoder:
    """Encodes texts to packed little-endian unsigned 32-bit ids.

    A vocabulary either keeps the space before a word as part of it (byte-level BPE) or drops white space
    before it merges (word-end BPE, lower case). Keys of kept words: in the first kind a key stands for
    itself after a space, unless it begins with a line feed (it stands as it is) or a carriage return (it stands
    as it is, without that). In the second kind a key stands for itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.leading_space = told["normalizer"] is None
        if self.leading_space:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        else:
            pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(pattern).findall
        self.special = re.compile("|".join(re.escape(t["content"]) for t in told["added_tokens"]) or r"(?!)", re.IGNORECASE)
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = byte_alphabet()
        self.space = self.alphabet[0x20]
        self.packed = [struct.pack("<I", k) for k in range(self.tokenizer.get_vocab_size())]
        self.odd = False
        self.kept = Kept(self._learn_spaced if self.leading_space else self._learn_bare)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _bytes(self, part: str) -> str:
        """A part in the vocabulary's letters for bytes."""
        return part.encode().decode("latin-1").translate(self.alphabet)

    def _merged(self, shown: str) -> bytes:
        """The ids of one part, as the library's model merges it."""
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merge(shown)])

    def _learn_spaced(self, word: str) -> bytes:
        """The ids of a key of the first kind. Letters and a run of ASCII signs after them never merge, so such
        a word takes the ids of both; other words are parted by the vocabulary's own pattern."""
        if word.isascii():
            if word.isalpha():
                packed = self.packed
                return b"".join([packed[t.id] for t in self.merge(self.space + word)])
            near = True
        else:
            near = not _FAR.search(word)
            if near and word.isalpha():
                return self._merged(self.space + self._bytes(word))
        base = word.rstrip(_SIGNS)
        if near and base.isalpha():
            return self.kept[base] + self.kept["\r" + word[len(base) :]]
        mark = word[:1]
        if not self.odd and (not word or word in ("\n", "\r") or mark == "\r" and word[1] == "\n" or _OTHER.search(word, mark == "\r")):
            raise OddSpace
        shown = word[1:] if mark == "\r" else word if mark == "\n" else " " + word
        if not near:
            return self._whole(shown)
        parts = self.parts(shown)
        if len(parts) == 1:
            return self._merged(self._bytes(shown))
        return b"".join([self.kept[p[1:]] if p[:1] == " " and p[1:].isalpha() else self.kept["\r" + p] for p in parts])

    def _learn_bare(self, word: str) -> bytes:
        """The same for a key of the second kind."""
        ascii_ = word.isascii()
        if not ascii_ and _FAR.search(word):
            return self._whole(word)
        lower = word.lower()
        if lower.isalpha():
            if lower != word:
                return self.kept[lower]
            packed = self.packed
            return b"".join([packed[t.id] for t in self.merge(word if ascii_ else self._bytes(word))])
        base = lower.rstrip(_SIGNS)
        if base.isalpha():
            return self.kept[base] + self.kept[lower[len(base) :]]
        parts = self.parts(lower)
        if len(parts) == 1:
            return self._merged(self._bytes(parts[0]))
        return b"".join(map(self.kept.__getitem__, parts))

    def _segments(self, text: str) -> list[str]:
        """Keys of a text whose white space is not one space or line feed between words."""
        first, *rest = _SEGMENT.findall(text)
        # A key without a carriage return has one space or line feed and then a word.
        keys = ["\r" + s if s[0] not in " \n" or len(s) == 1 or _SEVERAL.match(s) else s[s[0] == " " :] for s in rest]
        return ["\r" + first, *keys]

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text; an empty one has none."""
        if not text:
            return b""
        if "<" in text and self.special.search(text):
            return self._whole(text)
        kept = self.kept
        if len(kept) > WORDS_KEPT:
            kept.turn()
        if not self.leading_space:
            return b"".join(map(kept.__getitem__, _OTHER.sub(" ", text).replace("\n", " ").split(" ")))
        if "\r" not in text:
            words = text.replace("\n", " \n").split(" ")
            words[0] = "\r" + words[0]
            try:
                return b"".join(map(kept.__getitem__, words))
            except OddSpace:
                pass
        self.odd = True
        packed = b"".join(map(kept.__getitem__, self._segments(text)))
        self.odd = False
        return packed


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; it goes when another operator uses the worker."""
    kept = worker_keeps("encoding")
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on this machine; looked up where it is used, as it may differ."""
    import public_tokenizers

    return public_tokenizers.path(name)
