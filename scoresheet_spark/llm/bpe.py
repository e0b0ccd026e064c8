"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks every adjacent pair up by binary search
over the sorted pair keys, finds each word's lowest rank, and merges all places of that pair from left to
right; words without a mergeable pair leave the array. Words are encoded once and remembered in a table
of bounded size, so running text costs a dictionary lookup a word.

The vocabulary is read from a tokenizer file (a parameter) once per Python worker. Texts are processed
whole, in slices of bounded size, without a shuffle; a lost executor costs only its own slices.

Edge cases: a null text is '' and has no ids; null ids decode to ''; a word of any length is one word;
repeated rows give repeated rows; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from .common import offsets, ragged, slices, table, texts

#: Words that a worker remembers; beyond that the table starts anew.
MAX_WORDS = 250_000
_NONE = np.int32(2**31 - 1)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _lowered(pattern: str):
    """Of chunks without ASCII white space: their words (NFC, lower case by single characters, then the pattern's matches), with a space behind each chunk."""
    words = regex.compile(pattern + r"|\x20")

    def pieces(chunks: Sequence[bytes]) -> list[str]:
        text = b" ".join(chunks).decode("utf-8", "surrogatepass") + " "
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return words.findall(text.lower())

    return pieces


def _chunks(text: str) -> list[bytes]:
    """What stands between ASCII white space: no word of a pattern that drops white space crosses it."""
    return text.encode("utf-8", "surrogatepass").split()


def _check(spec: dict) -> None:
    """An error for what a tokenizer file asks for and the codec does not do."""
    model, pre, normal = spec["model"], spec["pre_tokenizer"], spec["normalizer"]
    steps = pre.get("pretokenizers", [pre])
    kinds = [x["type"] for x in steps], [x["type"] for x in normal.get("normalizers", [normal])] if normal else []
    bad = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    bad += [k for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if x.get(k)]
    bad += [k for x in steps for k in ("add_prefix_space",) if x.get(k)]
    if kinds not in ((["ByteLevel"], []), (["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"])):
        bad.append(f"steps {kinds}")
    if bad:
        raise ValueError(f"the tokenizer file has unsupported settings: {', '.join(bad)}")


class BpeCodec:
    """A vocabulary with its merges, for byte-level BPE files with or without word-end marks. Other settings are an error."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.chars = byte_chars()
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.base = np.array([vocab[c] for c in self.chars], np.int32)
        self.last = np.array([vocab[c + self.end] for c in self.chars], np.int32)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])], np.int64)
        keys = pairs[:, 0] * size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.ranks, self.merged = size, keys[order], order.astype(np.int32), pairs[order, 2].astype(np.int32)
        # ranks of all pairs of bytes, and of those that end a word
        left, right = np.divmod(np.arange(65536), 256)
        self.first, self.tail = self._look_up(self.base[left], self.base[right]), self._look_up(self.base[left], self.last[right])
        back = {c: b for b, c in enumerate(self.chars)}
        self.bytes = [b""] * size
        for token, i in vocab.items():
            if self.end and token.endswith(self.end):
                self.bytes[i] = bytes(back[c] for c in token[: -len(self.end)]) + b" "
            else:
                self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        pre = spec["pre_tokenizer"]
        self.pieces = None
        if pre["type"] == "ByteLevel":
            self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        else:
            found = next(p for p in pre["pretokenizers"] if p["type"] == "Split")
            self.split, self.pieces = _chunks, _lowered(found["pattern"]["Regex"])
        self.forget()

    def forget(self) -> None:
        self.words = _Words()
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has. Words are not empty."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.base[raw]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        pair = raw[:-1].astype(np.int32) << 8 | raw[1:]
        rank, merged = np.append(self.first[0][pair], _NONE), np.append(self.first[1][pair], np.int32(0))
        if self.end and pair.size:
            tail = ends[sizes > 1] - 1
            rank[tail], merged[tail] = self.tail[0][pair[tail]], self.tail[1][pair[tail]]
        rank[ends] = _NONE
        done_sym, done_word = [], []
        while sym.size:
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            spread = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.r_[heads, sym.size]))
            over = spread == _NONE
            where = np.flatnonzero((rank == spread) & ~over)
            keep = np.ones(sym.size, bool)
            stale = np.zeros(sym.size, bool)
            if where.size:
                # of places side by side (the pair is one symbol twice) every second one merges
                fresh = np.r_[True, np.diff(where) > 1]
                run = np.maximum.accumulate(np.where(fresh, where, 0))
                where = where[(where - run) % 2 == 0]
                sym[where] = merged[where]
                keep[where + 1] = False
                stale[where] = True
                stale[np.maximum(where - 1, 0)] = True
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep &= ~over
            sym, word, rank, merged, stale = sym[keep], word[keep], rank[keep], merged[keep], stale[keep]
            if sym.size:
                inner = np.append(word[1:] == word[:-1], False)
                rank[stale] = _NONE
                again = np.flatnonzero(stale & inner)
                rank[again], merged[again] = self._look_up(sym[again], sym[again + 1])
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        all_word, all_sym = np.concatenate(done_word), np.concatenate(done_sym)
        return all_sym[np.argsort(all_word, kind="stable")], np.bincount(all_word, minlength=len(words))

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; the rank is _NONE where no merge has it."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == self.keys.size] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def encode(self, docs: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has."""
        if len(self.words) > MAX_WORDS:
            self.forget()
        known, split = self.words, self.split
        look = known.__getitem__
        found: list[int] = []
        counts = np.zeros(len(docs), np.int64)
        for i, text in enumerate(docs):
            before = len(found)
            if any(x in text for x in self.special):
                at = 0
                for m in self.special_re.finditer(text):
                    found.extend(map(look, split(text[at : m.start()])))
                    found.append(look(("special", self.special[m.group()])))
                    at = m.end()
                found.extend(map(look, split(text[at:])))
            else:
                found.extend(map(look, split(text)))
            counts[i] = len(found) - before
        if known.new:
            self._learn(known.new)
            known.new = []
        words = np.array(found, np.int64)
        ids = self.flat[ragged(self.starts[words], self.lengths[words])]
        ends = np.r_[0, np.cumsum(self.lengths[words])][np.cumsum(counts)] if len(docs) else np.zeros(0, np.int64)
        return ids, np.diff(np.r_[0, ends])

    def _learn(self, new: list) -> None:
        """Ids of new table entries: words, chunks of several words, or special tokens."""
        marks = [i for i, x in enumerate(new) if isinstance(x, tuple)]
        plain = [x for x in new if not isinstance(x, tuple)] if marks else new
        if self.pieces is None:
            ids, sizes = self.merge([x.encode("utf-8", "surrogatepass") for x in plain])
        else:
            number = _Words()
            number[" "] = 0
            found = np.array(list(map(number.__getitem__, self.pieces(plain))), np.int64)
            words, lengths = self.merge([x.encode("utf-8", "surrogatepass") for x in number.new])
            starts, lengths = np.r_[0, np.cumsum(lengths) - lengths], np.r_[0, lengths]
            sizes = np.diff(np.r_[0, np.cumsum(lengths[found])[found == 0]])
            ids = words[ragged(starts[found], lengths[found])]
        starts = self.flat.size + np.cumsum(sizes) - sizes
        if marks:
            at = np.setdiff1d(np.arange(len(new)), marks)
            all_starts, all_sizes = np.empty(len(new), np.int64), np.ones(len(new), np.int64)
            all_starts[at], all_sizes[at] = starts, sizes
            all_starts[marks] = self.flat.size + ids.size + np.arange(len(marks))
            starts, sizes, ids = all_starts, all_sizes, np.r_[ids, np.array([new[i][1] for i in marks], np.int32)]
        self.starts, self.lengths, self.flat = np.r_[self.starts, starts], np.r_[self.lengths, sizes], np.r_[self.flat, ids]

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Words(dict):
    """Numbers of words in order of appearance; `new` lists those not yet encoded."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, word) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


@lru_cache(maxsize=4)
def codec(path: str) -> BpeCodec:
    """The codec of a tokenizer file, made once per process."""
    made = BpeCodec(path)
    gc.freeze()  # the tables live as long as the worker
    return made


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _decoded(bpe: BpeCodec, lists: pa.ListArray) -> pa.Array:
    """The text of every list of ids, '' for null."""
    flat, bounds = lists.flatten().to_numpy(), offsets(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return pa.array([bpe.decode(flat[s:e].tolist()) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())


def encode_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids[, decoded]) of every row: the ids of its whole text, and with `decoded` what those ids decode to, in one pass."""
    rows = df.select(F.col(key), F.col(text).alias("text"))
    schema = StructType([rows.schema[0], StructField("ids", ArrayType(IntegerType())), *[StructField("decoded", StringType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in slices(batches):
            ids, counts = bpe.encode(texts(b))
            lists = pa.ListArray.from_arrays(pa.array(offsets(counts)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, *([_decoded(bpe, lists)] if decoded else [])], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode_documents(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded) of every row."""
    rows = df.select(F.col(key), F.col(ids).alias("ids"))
    schema = StructType([*rows.schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _decoded(bpe, b.column(1))], names=schema.names)

    return rows.mapInArrow(run, schema)


#: Vocabulary of the registered query.
BYTE_BPE = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), decoded=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast(BinaryType()), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast(BinaryType()), 256).alias("decoded_sha256"),
    )


QUERIES = {"op1_bpe": op1_bpe}
ORACLE: dict[str, str] = {}
