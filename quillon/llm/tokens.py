"""Ids of whole texts by a word-level BPE tokenizer, word by word.

The tokenizer splits at white space and drops it, so a text's ids are those of
its words one after the other.  Words repeat; a bounded table of their ids does
nearly all the work, and only words not in it reach the tokenizer library.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words whose ids the BPE model gives alone: letters that one code point holds
#: in every normal form and that have one lower-case letter, then marks.  Marks
#: leave out the apostrophe, which may go with letters, and those of special tokens.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=?-@\\[-`{}~]*)")


_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class _Known(dict):
    """Ids of words; one that is missing is worked out, and kept if short."""

    def __init__(self, owner: WordTokenizer) -> None:
        super().__init__({"": b""})
        self.owner = owner

    def __missing__(self, word: str) -> bytes:
        owner = self.owner
        ids = owner._word(word)
        if len(word) <= owner.longest:
            if len(self) > owner.most_words:
                self.clear()
                self[""] = b""
            self[word] = ids
        return ids


class WordTokenizer:
    """``ids``: little-endian unsigned 32-bit ids of texts, as bytes.

    Valid for tokenizers that lower-case, treat the space and the line feed as
    white space that separates words and leaves no trace in the ids, and part
    letters from marks.  ``most_words`` bounds each of two tables, of words and
    of their letters; a full table is emptied.  Words over ``longest``
    characters are not kept."""

    def __init__(self, path: str, most_words: int = 500_000, longest: int = 64) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Known(self)
        self.letters: dict[str, bytes] = {}
        self.most_words, self.longest = most_words, longest
        # Bytes as the characters that stand for them in the vocabulary.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.as_text = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))

    def _word(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain is None:
            return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        letters, marks = plain.groups()
        letters = letters.lower()
        ids = self.letters.get(letters)
        if ids is None:
            if len(self.letters) > self.most_words:
                self.letters.clear()
            shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.as_text)
            ids = self._packed([t.id for t in self.model.tokenize(shown)])
            if len(letters) <= self.longest:
                self.letters[letters] = ids
        return ids + self.known[marks] if marks else ids

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and path, as processes serve many tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def chunks(items: list, sizes: list[int], most: int) -> Iterator[list]:
    """Items in runs whose sizes add up to ``most`` at most, or single ones."""
    out, total = [], 0
    for x, n in zip(items, sizes):
        if out and total + n > most:
            yield out
            out, total = [], 0
        out.append(x)
        total += n
    if out:
        yield out
