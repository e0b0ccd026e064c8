"""Token files, alignment of tokenizers, divergence of sources."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scoresheet_spark.llm import alignment, divergence, library_ids, token_files
from scoresheet_spark.llm.bpe import byte_chars, vocabulary

from .test_text_operators import EDGES, ODD, edges

SF = "/root/testdata/sf0.001"
BYTES, PIECES = vocabulary(alignment.BYTE_BPE), vocabulary(alignment.PIECE_BPE)


def odd_texts(rng, n):
    letters = list(" \n\t\x0b\x1c\x1f\x85\xa0ab1'sé½²ªº×ǅʼ漢٣ⅷ😀▁.,") + ["<|endoftext|>", "<s>", "'ll", "  ", "the", "<0x41>", "\x00"]
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("plain", [False, True])
def test_remembered_ids_equal_the_library(monkeypatch, plain):
    monkeypatch.setattr(library_ids, "MAX_WORDS", 500)
    for path in (BYTES, vocabulary("word_bpe_49k.json"), PIECES):
        ours = library_ids.PieceIds(path) if path == PIECES else library_ids.LibraryIds(path, plain)
        texts = odd_texts(random.Random(2), 1500)
        expected = ours.lib.encode(texts, num_threads=1) if path == PIECES else [x.ids for x in ours.lib.encode_batch(texts, add_special_tokens=False)]
        for i in range(0, len(texts), 300):
            ids, counts = ours.encode(texts[i : i + 300])
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == expected[i : i + 300]


def stored(rows):
    """What the query returns, by the library alone; rows are (doc_id, text) in order."""
    library, out, start = Tokenizer.from_file(BYTES), [], 0
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_file_query_equals_the_library(spark):
    got = token_files.op11_token_files(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in got) == stored(sorted((r[0], r[1]) for r in docs))


@pytest.mark.parametrize("size", [1, 60, 2**20])
def test_token_files_on_edges(spark, tmp_path, size):
    path = str(tmp_path / "store")
    df = edges(spark, "key").repartition(3)
    token_files.write_token_files(df, path, BYTES, segment_bytes=size)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == [0, *accumulate(r.n_tokens for r in got)][:-1]
    assert [r.key for r in got] == sorted((x[0] for x in EDGES), key=lambda k: (k is not None, k or 0))
    library = Tokenizer.from_file(BYTES)
    expected = Counter((k, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for k, t, _ in EDGES)
    assert Counter((r.key, tuple(r.ids)) for r in got) == expected
    some = token_files.read_token_files(spark, path, keys=[3, None, 99]).collect()
    assert Counter((r.key, r.start) for r in some) == Counter((r.key, r.start) for r in got if r.key in (3, None))
    assert token_files.read_token_files(spark, path, keys=[99]).collect() == []


def test_a_key_of_most_rows_fills_many_segments(spark, tmp_path):
    df = spark.range(400).select(F.when(F.col("id") % 10 > 0, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    token_files.write_token_files(df, str(tmp_path), BYTES, segment_bytes=500)
    listed = token_files.segments(spark, str(tmp_path)).collect()
    assert max(r.docs for r in listed) < 100 and sum(r.docs for r in listed) == 400
    assert token_files.read_token_files(spark, str(tmp_path), keys=[5]).count() == 360


def test_empty_store_and_segment_format(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), BYTES)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).collect() == []
    blob = token_files.pack_segment([None, -3], [1, 2], [b"ab", b"cde"], b"d" * 32, 2) + b"\n"
    digest, width, keys, there, counts, ends = token_files.open_segment(blob)
    assert (digest, width, keys.tolist(), there.tolist(), counts.tolist(), ends.tolist()) == (b"d".hex() * 32, 2, [0, -3], [False, True], [1, 2], [2, 5])
    with pytest.raises(ValueError):
        token_files.open_segment(blob[:-1] + b"x")


def brute_alignment(docs):
    """Rows of the query by sets of ends, from the libraries alone."""
    lib, pieces = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    lib.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_chars())}
    rows, linked, counts = [], [], Counter()
    for key, text in docs:
        sides = [[], []]
        if text:
            a = [(i, bytes(back[c] for c in lib.id_to_token(i))) for i in lib.encode(f" {text}", add_special_tokens=False).ids]
            b = [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()) for i in pieces.encode(text)]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == f" {text}".encode():
                sides = [a, b]
        ends = [list(accumulate(len(x) for _, x in s)) for s in sides]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = [["" for _ in both], ["" for _ in both]]
        for k in (0, 1):
            at = {e: i for i, e in enumerate(both)}
            g = 0
            for (i, _), e in zip(sides[k], ends[k], strict=True):
                groups[k][g] += f"{',' if groups[k][g] else ''}{i}"
                g += e in at
        said = ";".join(f"{x}|{y}" for x, y in zip(*groups, strict=True))
        last = [dict(zip(e, (i for i, _ in s), strict=True)) for e, s in zip(ends, sides, strict=True)]
        linked.append([(last[0][e], last[1][e]) for e in both])
        counts.update(linked[-1])
        rows.append((key, len(sides[0]), len(sides[1]), len(both), len(both), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return Counter((*r[:5], sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), r[5]) for r, pairs in zip(rows, linked, strict=True))


def test_alignment_query_equals_brute_force(spark, tmp_path):
    texts = odd_texts(random.Random(5), 300)
    docs = [*((i, t) for i, t in enumerate(texts)), (7, None), (None, "again again"), (7, "again again")]
    spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, groups string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in alignment.op12_alignment(spark, str(tmp_path)).collect())
    assert got == brute_alignment(docs)


def test_alignment_of_fixture_and_of_nothing(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in alignment.op12_alignment(spark, SF).collect()) == brute_alignment(docs)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert alignment.op12_alignment(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("size", [1, 7, 100])
def test_blocks_are_cut_where_both_end(monkeypatch, size):
    monkeypatch.setattr(alignment, "BLOCK_TOKENS", size)
    rng = np.random.default_rng(size)
    docs = [0, 3, 50, 0, 400, 1]
    total = sum(docs)
    stops = np.cumsum(docs)
    cut = lambda p: np.unique(np.r_[np.flatnonzero(rng.random(total) < p) + 1, stops[stops > 0], total])
    a, b = cut(0.5), cut(0.3)
    per_doc = np.diff(np.r_[0, np.searchsorted(b, stops, "right")])
    blocks = list(alignment._blocks(a, b, per_doc))
    assert [x.start for x, _ in blocks] == [0, *(x.stop for x, _ in blocks)][:-1] and blocks[-1][0].stop == len(a)
    assert [y.start for _, y in blocks] == [0, *(y.stop for _, y in blocks)][:-1] and blocks[-1][1].stop == len(b)
    assert all(a[x.stop - 1] == b[y.stop - 1] for x, y in blocks)


def test_overlaps_are_all_pairs_that_share_bytes(spark):
    text = "Donaudampfschifffahrt naïve 漢字 tokenization unbelievably"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = alignment.align_documents(df, BYTES, PIECES, link="overlap").collect()
    a, b = alignment._side(BYTES), alignment._side(PIECES)
    spans = []
    for side in (a, b):
        ids = side.encode([text])[0].tolist()
        ends = list(accumulate(len(side.bytes[i]) for i in ids))
        spans.append(list(zip(ids, [0, *ends], ends, strict=False)))
    expected = Counter((i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e)
    assert [Counter({(x.a, x.b): x.n for x in r.links}) for r in rows] == [expected, expected]
    with pytest.raises(ValueError):
        alignment.align_documents(df, BYTES, PIECES, link="begin")


def divergence_by_sql(spark, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    return Counter(con.execute(divergence.ORACLE["op13_divergence"]).fetchall())


def test_divergence_equals_sql_on_edges(spark, tmp_path):
    rng = random.Random(4)
    words = ["Haus", "haus", "naïve", "ÉCOLE", "école", "x1y", "漢字", "a", "b", "İ", "w" * 3000]
    rows = [(rng.choice([1, 2, None]), rng.choice(["de", None, "", "en"]), rng.choice(["s1", "s2", "s3", None]), rng.choice([None, "", "12 !", " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))])) for _ in range(300)]
    rows += [(5, "only", s, "rare words") for s in ("s1", "s2")] + [(6, "lone", "s9", "one one")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, lang string, source string, text string, term int").repartition(5)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = divergence.op13_divergence(spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == divergence_by_sql(spark, f"{tmp_path}/documents.parquet/*.parquet")


def test_divergence_leaves_in_parts_and_of_nothing(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(tuple(r) for r in divergence.audit(docs.repartition(7)).collect()) == divergence_by_sql(spark, f"{SF}/documents.parquet")
    assert divergence.audit(docs.limit(0)).collect() == []


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    counts, totals = rng.integers(0, 2**50, 2000), rng.integers(2**50, 2**53, 2000)
    exact = [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, totals, strict=True)]
    assert divergence._shares(counts, totals).tolist() == exact
