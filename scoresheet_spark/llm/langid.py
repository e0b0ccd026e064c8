"""Language identification by segmentation-marginalised unigrams.

Each language is a distribution over the pieces of a fixed public vocabulary. A word's probability is the
sum over all its segmentations into pieces, which a forward pass computes; a text's is the product over its
words. Piece probabilities are learned by expectation maximisation: expected counts from forward and
backward passes over training words, summed by language and piece. The best language wins; the score is its
posterior under equal priors.

Training draws about `TRAIN_DOCS` documents of each language by a hash of their key, so what reaches the
driver is at most languages x vocabulary numbers. Prediction reads every text whole where it lies; words are
scored once and remembered in a table of bounded size.

Edge cases: a null text or one without a letter is `und` with score 0; rows with a null key train nothing
and are predicted; a null language trains nothing; without training rows all is `und`; more than
`MAX_LANGUAGES` languages are an error; ties go to the alphabetically first language; repeated rows give
repeated rows; words of any length are learned from and scored whole, and no word changes what another gets;
letters outside the vocabulary count as an unknown piece; further columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .bpe import _Words, vocabulary
from .common import U64, cut, mix64, slices, table, texts

#: Documents of each language to train on, about; rounds of expectation maximisation; languages at most.
TRAIN_DOCS, ROUNDS, MAX_LANGUAGES = 1500, 3, 200
#: Share of a piece that is added to every count.
SMOOTHING = 0.05
#: Chunks of text that a worker remembers, and their bytes; beyond that the table starts anew.
MAX_CHUNKS, MAX_BYTES = 300_000, 32_000_000
_WORD = regex.compile(r"\p{L}+|\x20")
_LETTER = regex.compile(r"\p{L}")
_BASE = U64(0x9E3779B97F4A7C15)
MARK = "▁"


class Pieces:
    """The pieces of a vocabulary that consist of lower-case letters, found by hash."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        letters = regex.compile(MARK + r"?\p{L}+|" + MARK)
        words = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        words = sorted({w for w in words if letters.fullmatch(w) and w == w.lower()})
        self.words, self.longest, self.size = words, max(map(len, words)), len(words)
        keys = np.concatenate([self._hashes(_codes([w]), len(w))[:, 0] for w in words])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)

    @staticmethod
    def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
        n = codes.shape[1] - length + 1
        h = np.zeros((codes.shape[0], n), U64)
        for k in range(length):
            h = h * _BASE + codes[:, k : k + n]
        return mix64(h + U64(length))

    def find(self, codes: np.ndarray) -> list[np.ndarray | None]:
        """By length: the piece that begins at each position, `size + 1` for none; a lone letter outside the vocabulary is piece `size`."""
        found, h = [None], np.zeros(codes.shape, U64)
        for length in range(1, min(self.longest, codes.shape[1]) + 1):
            n = codes.shape[1] - length + 1
            h = h[:, :n] * _BASE + codes[:, length - 1 : length - 1 + n]
            key = mix64(h + U64(length))
            at = np.minimum(np.searchsorted(self.keys, key), self.size - 1)
            ids = np.where(self.keys[at] == key, self.ids[at], self.size + 1)
            if length == 1:
                ids[ids == self.size + 1] = self.size
            found.append(ids if (ids <= self.size).any() else None)
        return found


def _codes(words: Sequence[str]) -> np.ndarray:
    """Code points of words of equal length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(U64)


#: Letters that a word may have before its sums are scaled: up to there nothing underflows.
PLAIN = 24


def _forward(found: list, n: int, probs: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums at every position, and the logs of their scale factors: each row and language has its own."""
    alpha = np.ones((n + 1, rows, probs.shape[1]))
    scale = np.zeros_like(alpha)
    for j in range(1, n + 1):
        total = np.zeros_like(alpha[0])
        for length in range(1, min(j, len(found) - 1) + 1):
            if found[length] is not None:
                step = alpha[j - length] * probs[found[length][:, j - length]]
                total += step * np.exp(scale[j - length] - scale[j - 1]) if j > PLAIN else step
        if j >= PLAIN:
            scale[j] = scale[j - 1] + np.log(total)
        else:
            alpha[j] = total
    return alpha, scale


def _batches(words: Sequence[str], width: int) -> Iterator[tuple[int, list[int]]]:
    """Numbers of words of equal length, in batches of a bounded number of letters times `width`."""
    by_length = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w)].append(i)
    for n, rows in by_length.items():
        step = max(1, 200_000 // (n * width))
        for s in range(0, len(rows), step):
            yield n, rows[s : s + step]


def score_words(pieces: Pieces, probs: np.ndarray, words: Sequence[str]) -> np.ndarray:
    """Log probability of each word in each language; `probs` has a row for each piece, the unknown one and none."""
    out = np.zeros((len(words), probs.shape[1]))
    for n, rows in _batches(words, probs.shape[1]):
        alpha, scale = _forward(pieces.find(_codes([words[i] for i in rows])), n, probs, len(rows))
        out[rows] = np.log(alpha[n]) + scale[n]
    return out


def expect(pieces: Pieces, probs: np.ndarray, words: Sequence[str], weights: np.ndarray) -> np.ndarray:
    """Expected counts of pieces over weighted words of one language (`probs` has one column)."""
    counts = np.zeros(pieces.size + 2)
    for n, rows in _batches(words, 1):
        found = pieces.find(_codes([words[i] for i in rows]))
        alpha, scale = _forward(found, n, probs, len(rows))
        # backward sums, scaled by what the forward ones are not
        beta = np.zeros_like(alpha)
        beta[n] = weights[rows][:, None] / alpha[n]
        seen, mass = [], []
        for i in range(n - 1, -1, -1):
            for length in range(1, min(n - i, len(found) - 1) + 1):
                if found[length] is None:
                    continue
                ids = found[length][:, i]
                step = probs[ids] * beta[i + length]
                if i + length >= PLAIN:
                    step *= np.exp(scale[i] - scale[i + length])
                beta[i] += step
                seen.append(ids)
                mass.append((alpha[i] * step)[:, 0])
        counts += np.bincount(np.concatenate(seen), np.concatenate(mass), minlength=counts.size)
    return counts


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def chunk_words(chunks: Sequence[bytes]) -> list[str]:
    """Words of all chunks, with a space behind each chunk."""
    return _WORD.findall((b" ".join(chunks).decode("utf-8", "surrogatepass") + " ").lower())


class Model:
    """Languages and, by piece, their probabilities."""

    def __init__(self, path: str, languages: Sequence[str], probs: np.ndarray) -> None:
        self.path, self.languages, self.probs = path, list(languages), probs

    def __getstate__(self):
        return self.path, self.languages, self.probs

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def begin(self) -> None:
        self.known, self.sums, self.held = _Words(), np.zeros((0, len(self.languages))), 0

    def predict(self, docs: Sequence[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(docs), [0.0] * len(docs)
        if not hasattr(self, "known") or len(self.known) > MAX_CHUNKS or self.held > MAX_BYTES:
            self.begin()
        look = self.known.__getitem__
        rows = [np.fromiter(map(look, t.encode("utf-8", "surrogatepass").split()), np.int64) for t in docs]
        if self.known.new:
            self.held += sum(map(len, self.known.new))
            number = _Words()
            number[" "] = 0
            found = np.array(list(map(number.__getitem__, chunk_words(self.known.new))), np.int64)
            self.known.new = []
            scores = np.vstack([np.zeros((1, len(self.languages))), score_words(pieces_of(self.path), self.probs, [MARK + w for w in number.new])])
            ends = np.flatnonzero(found == 0)  # each chunk's sum is its own: none depends on its neighbours
            self.sums = np.vstack([self.sums, np.add.reduceat(scores[found], np.r_[0, ends[:-1] + 1], axis=0)])
        names, odds = [], []
        for text, row in zip(docs, rows, strict=True):
            if not _LETTER.search(text):
                names.append("und")
                odds.append(0.0)
                continue
            log = self.sums[row].sum(axis=0)
            best = int(np.argmax(log))
            names.append(self.languages[best])
            odds.append(float(1 / np.exp(log - log[best]).sum()))
        return names, odds


def train(df: DataFrame, path: str, lang: str = "lang", key: str = "doc_id", text: str = "text") -> Model:
    """A model of every language of `df`, from about TRAIN_DOCS documents of each."""
    spark = df.sparkSession
    rows = df.filter(F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in sizes)
    pieces = pieces_of(path)
    if not languages:
        return Model(path, [], np.zeros((pieces.size + 2, 0)))
    shares = {r["lang"]: min(1.0, TRAIN_DOCS / r["count"]) for r in sizes}
    quota = F.broadcast(spark.createDataFrame(list(shares.items()), "lang string, share double"))
    drawn = rows.join(quota, "lang").filter(F.pmod(F.xxhash64("key", F.lit(20)), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            tally: Counter = Counter()
            for name, t in zip(b.column("lang").to_pylist(), texts(b), strict=True):
                for w in chunk_words(t.encode("utf-8", "surrogatepass").split()):
                    if w != " ":
                        tally[name, w] += 1
            if tally:
                names, words = zip(*tally, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(words), pa.array(list(tally.values()), pa.int64())], names=["lang", "word", "n"])

    words = drawn.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = cut(words)
    probs = np.zeros((pieces.size + 2, len(languages)))
    probs[:-1] = 1 / (pieces.size + 1)
    place = {name: i for i, name in enumerate(languages)}
    for _ in range(ROUNDS):
        shipped = spark.sparkContext.broadcast(probs)

        def expected(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            table_, sums = pieces_of(path), {}
            for b in batches:
                names = np.array([place[x] for x in b.column("lang").to_pylist()])
                all_words, n = b.column("word").to_pylist(), b.column("n").to_numpy().astype(float)
                for g in np.unique(names).tolist():
                    mine = np.flatnonzero(names == g)
                    got = expect(table_, shipped.value[:, [g]], [MARK + all_words[i] for i in mine], n[mine])
                    sums[g] = sums.get(g, 0) + got
            for g, got in sums.items():
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, g, np.int32)), pa.array(at.astype(np.int32)), pa.array(got[at])], names=["g", "piece", "mass"])

        masses = words.mapInArrow(expected, "g int, piece int, mass double").groupBy("g", "piece").agg(F.sum("mass").alias("mass"))
        counts = np.full((pieces.size + 2, len(languages)), SMOOTHING)
        sums = masses.toArrow()  # languages x vocabulary at most
        np.add.at(counts, (sums.column("piece").to_numpy(), sums.column("g").to_numpy()), sums.column("mass").to_numpy())
        counts[-1] = 0
        probs = counts / counts.sum(axis=0)
        shipped.unpersist()
    return Model(path, languages, probs)


def predict(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` columns of `df` with lang_pred and score."""
    rows = df.select(*keep, F.col(text).alias("text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shipped.value
        for b in slices(batches):
            names, odds = here.predict(texts(b))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(odds, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


#: Vocabulary of the registered query, and its folds.
PIECE_BPE, FOLDS = "piece_bpe_32k.model", 5


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    model = train(docs.filter(fold != 0), vocabulary(PIECE_BPE))
    found = predict(docs.withColumn("held_out", F.coalesce(fold == 0, F.lit(False))), model, ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op8_langid": op8_langid}
ORACLE: dict[str, str] = {}
