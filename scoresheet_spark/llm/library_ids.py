"""Ids by the tokenizers and sentencepiece libraries, remembered by words.

A byte-level tokenizer cuts a text into words by a fixed pattern and gives each word its ids by itself. So the
library's model encodes each distinct word once for a worker; texts that hold special tokens, and files with other
steps, go through the library whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from .bpe import byte_chars
from .common import ragged

#: Words, and characters of them, that a worker remembers; beyond, the table starts anew.
MAX_WORDS, MAX_CHARS = 300_000, 16_000_000
#: The words of byte-level tokenizers, of texts in ASCII, in Latin letters up to U+02AF, and of all; fixed values.
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII).findall
_LETTERS, _NUMBERS, _BLANK = r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u02AF", r"0-9\xB2\xB3\xB9\xBC-\xBE", r" \t\n\v\f\r\x85\xA0"
_LATIN = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANK}{_LETTERS}{_NUMBERS}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+").findall
_BEYOND = re.compile(r"[^\x00-\u02AF]").search
_RUNS = re.compile(r" +[^ ]+").findall
_WORDS = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall


class _Remembered:
    """Ids of texts from those of their parts, which `_parts` cuts and `_lists` encodes."""

    def _forget(self) -> None:
        self.known = _Numbers()
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has."""
        gc.disable()  # many small lists, none of them in a cycle
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        found: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            before = len(found)
            found.extend(map(known.__getitem__, self._parts(text)))
            counts[i] = len(found) - before
        if known.new:
            lists = self._lists(known.new)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.starts = np.r_[self.starts, self.flat.size + np.cumsum(sizes) - sizes]
            self.lengths = np.r_[self.lengths, sizes]
            self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))]
            known.chars += sum(len(x[0] if isinstance(x, tuple) else x) for x in known.new)
            known.new = []
        words = np.array(found, np.int64)
        lengths = self.lengths[words]
        ids = self.flat[ragged(self.starts[words], lengths)]
        sizes = np.diff(np.r_[0, np.r_[0, np.cumsum(lengths)][np.cumsum(counts)]])
        if len(known) > MAX_WORDS or known.chars > MAX_CHARS:
            self._forget()
        return ids, sizes


class LibraryIds(_Remembered):
    """A tokenizer file. `plain`: the strings of special tokens are ordinary text."""

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.lib.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.special = [] if plain else [x["content"] for x in spec["added_tokens"]]
        plain_words = all(x["special"] for x in spec["added_tokens"])
        self.by_words = not spec["normalizer"] and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and spec["model"]["type"] == "BPE" and plain_words
        self.chars = {b: c for b, c in enumerate(byte_chars()) if chr(b) != c}
        self.space = self.chars[32]
        self.size = self.lib.get_vocab_size()
        self.model = self.lib.model
        self._forget()

    def _lists(self, new: list) -> list[list[int]]:
        return list(map(self._ids, new))

    def _ids(self, entry: str | tuple[str]) -> list[int]:
        """Ids of a word, or of a text in a tuple."""
        if isinstance(entry, tuple):
            return self.lib.encode(entry[0], add_special_tokens=False).ids
        plain = entry.isascii() and entry.isprintable()
        return [x.id for x in self.model.tokenize(entry.replace(" ", self.space) if plain else entry.encode().decode("latin-1").translate(self.chars))]

    def _parts(self, text: str) -> list:
        """The words of a text; the text itself, in a tuple, where the library takes it whole."""
        if not self.by_words or any(x in text for x in self.special):
            return [(text,)] if text else []
        if text.isascii():
            return _ASCII(text)
        return _WORDS(text) if _BEYOND(text) else _LATIN(text)


class PieceIds(_Remembered):
    """A file of pieces (sentencepiece), which puts a space before each text.

    Where no piece holds a space behind another character, none crosses from a word to the next space. Then runs from
    spaces to spaces are encoded once each; texts that end in a space, and files that change texts, go through whole.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.lib.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(map(self.lib.id_to_piece, range(self.size)))]
        self.lossy = False  # whether some run was not given back byte by byte
        probe = " \u2460\ufb01  A\u030a x"
        self.by_runs = not any(re.search("[^\u2581]\u2581", self.lib.id_to_piece(i)) for i in range(self.size)) and self.lib.decode(self.lib.encode(probe)) == probe
        self._forget()

    def whole(self, text: str) -> bool:
        return not self.by_runs or text.endswith(" ") or "\u2581" in text

    def _parts(self, text: str) -> list:
        if self.whole(text):
            return [(text,)] if text else []
        return _RUNS(f" {text}") if text else []

    def _lists(self, new: list) -> list[list[int]]:
        lists = self.lib.encode([x[0] if isinstance(x, tuple) else x[1:] for x in new], num_threads=1)
        look = self.bytes.__getitem__
        self.lossy |= any(not isinstance(x, tuple) and b"".join(map(look, ids)) != x.encode() for x, ids in zip(new, lists, strict=True))
        return lists


class _Numbers(dict):
    """Numbers of words in order of appearance; `new` lists those not yet encoded."""

    def __init__(self) -> None:
        self.new: list = []
        self.chars = 0

    def __missing__(self, word) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


@lru_cache(maxsize=4)
def library_ids(path: str, plain: bool = False) -> LibraryIds | PieceIds:
    """The tokenizer of a file, made once per process."""
    made = PieceIds(path) if path.endswith(".model") else LibraryIds(path, plain)
    gc.freeze()  # the tables live as long as the worker
    return made
