"""Near duplicates, substrings, quality, languages, top-k, and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoresheet_spark.llm import common, langid, neardup, quality, substring, topk

from .test_text_operators import EDGES, edges

ROWS = "doc_id long, text string"


def words_of(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- near duplicates


def shingle_counts(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    """Least key of each connected component of pairs with weighted Jaccard similarity of 0.8 or more."""
    sets = [shingle_counts(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = sum((sets[i] & sets[j]).values())
                if both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return [(k, least[find(i)]) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("ratio", [0.3, 0.6, 0.8, 0.95])
def test_signatures_agree_as_sets_are_similar(ratio):
    rng = np.random.default_rng(1)
    total, shared = 1000, int(1000 * ratio)
    pool = rng.integers(0, 2**63, total).astype(np.uint64)
    a, b = pool[: shared + (total - shared) // 2], np.r_[pool[:shared], pool[shared + (total - shared) // 2 :]]
    s = neardup.dart_signatures(np.r_[a, b], np.ones(len(a) + len(b)), np.array([len(a), len(b)]), 3000)
    assert (s[0] == s[1]).mean() == pytest.approx(ratio, abs=0.04)


def test_signatures_follow_weights_and_not_the_batch():
    e = np.random.default_rng(2).integers(0, 2**63, 30).astype(np.uint64)
    s = neardup.dart_signatures(np.r_[e, e], np.r_[np.full(30, 2.5), np.full(30, 1.5)], np.array([30, 30]), 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(0.6, abs=0.04)
    assert (neardup.dart_signatures(e, np.full(30, 1.5), np.array([30]), 4000)[0] == s[1]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 5), (200, 201), (201, 202), (202, 200)]
    got = {r[0]: r[1] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: i // 10 * 10 for i in range(40)}, 100: 0, 200: 200, 201: 200, 202: 200}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 3)  # so that buckets part
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        base = words_of(rng, rng.choice([30, 80, 200]))
        for _ in range(rng.choice([1, 3, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
            rows.append(" ".join(w))
    rows += ["short text", "short  text", "short", "one two three four", "x " * 300, "x " * 290, "x " * 100, "", " \n"]
    passage = " ".join(words_of(rng, 60))
    rows += [passage + " " + " ".join(words_of(rng, 40)) for _ in range(25)]
    rng.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)] + [(9999, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_classes(rows))


def family(n, size, edits, rng):
    """A text of `size` words and `n` copies with `edits` words replaced, `size` / `edits` apart."""
    base = words_of(rng, size)
    out = [base]
    for i in range(n):
        w = list(base)
        for j in range(edits):
            w[j * size // edits + 7] = f"e{i}x{j}"
        out.append(w)
    return out


def one_bucket(monkeypatch):
    """All texts share one band and no other: what a leader turns down has no second chance there."""
    true_sign = neardup.sign

    def sign(docs, *a, **k):
        hashed = F.xxhash64("key")
        return true_sign(docs, *a, **k).withColumn("bands", F.when(F.size("bands") > 0, F.array(F.lit(1).cast("bigint"), *(hashed + i for i in range(1, 25)))))

    monkeypatch.setattr(neardup, "sign", sign)


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    one_bucket(monkeypatch)
    rng = random.Random(11)
    rows = [" ".join(w) for _ in range(20) for w in family(1, 100, 1, rng)]
    rows = list(enumerate(rows))
    got = neardup.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_classes(rows))


def test_turned_down_members_meet_accepted_ones(spark, monkeypatch):
    one_bucket(monkeypatch)
    rng = random.Random(12)
    base = words_of(rng, 200)
    # a chain: each text has three more words edited than the one before, its ends are not similar
    chain = [list(base)]
    for i in range(12):
        w = list(chain[-1])
        for j in range(3):
            w[(i * 3 + j) * 5 + 4] = f"c{i}x{j}"
        chain.append(w)
    rows = list(enumerate(" ".join(w) for w in chain))
    want = brute_classes(rows)
    assert {c for _, c in want} == {0}
    got = neardup.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_near_duplicates_on_edges(spark):
    got = Counter((r[0], r[1]) for r in neardup.near_duplicates(edges(spark, "class_id")).collect())
    assert got == Counter({(1, 1): 1, (None, None): 2, (2, 2): 1, (3, 3): 2, (4, 4): 1, (5, 5): 1})
    assert neardup.near_duplicates(edges(spark, "class_id", [])).count() == 0
    kept = neardup.keep_first(spark.createDataFrame([(1, "a b c d e f", "z"), (2, "a b c d  e f", "y"), (3, "other", None)], "doc_id long, text string, class_id string"))
    assert sorted((r.doc_id, r.class_id) for r in kept.collect()) == [(1, "z"), (3, None)] or len(kept.collect()) == 2


def test_repeated_keys_and_dotted_columns(spark):
    shape = "doc_id long, text string, `a.b` string, key string, content_a long, row string, `n.` long"
    more = ("x", "k", 1, "r", 2)
    a, b, c = (" ".join(words_of(random.Random(i), 40)) for i in range(3))
    rows = [(5, a, *more), (5, b, *more), (3, b, *more), (None, a, *more), (None, c, *more), (None, c, *more), (7, c + " more", *more), (8, None, *more), (8, None, *more), (8, a + " b", *more), (8, a + " b", *more)]
    docs = spark.createDataFrame(rows, shape)
    got = Counter((r[0], r[1]) for r in neardup.near_duplicates(docs).collect())
    assert got == Counter({(5, 5): 1, (5, 3): 1, (3, 3): 1, (None, 5): 1, (None, 7): 2, (7, 7): 1, (8, 8): 2, (8, 5): 2})
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter([(5, a, *more), (3, b, *more), (7, c + " more", *more), (8, None, *more), (8, None, *more)])
    # rows that are equal, key and all: one stays
    twice = neardup.keep_first(docs.filter("doc_id = 8 AND text IS NOT NULL"))
    assert [tuple(r) for r in twice.collect()] == [(8, a + " b", *more)]


def test_rows_are_kept_without_a_second_pass_of_python(spark):
    a, b = (" ".join(words_of(random.Random(i), 40)) for i in range(2))
    rows = [(1, a), (1, f"  {a} "), (1, a), (2, a.replace(" ", "\n")), (None, b), (None, f"{b}\t"), (3, ""), (3, None), (3, " ")]
    kept = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    found = Counter((k, t if t is None else " ".join(t.split())) for k, t in kept.collect())
    assert found == Counter({(1, a): 1, (None, b): 1, (3, ""): 2, (3, None): 1})
    assert not re.search("Python|Pandas|Arrow", kept._jdf.queryExecution().executedPlan().toString())


# --- substrings


def test_cuts_resist_insertions():
    rng = random.Random(7)
    text = " ".join(words_of(rng, 800)).encode()
    _, b, e, d = substring.chunk([text])
    at = len(text) // 2
    _, _, _, moved = substring.chunk([b"unrelated start " + text[:at] + b"INSERTED" + text[at:]])
    known = d[d != 0]
    assert (np.isin(known, moved)).mean() > 0.97
    assert b"".join(text[s:t] for s, t in zip(b, e, strict=True)) == text


def test_chunks_do_not_depend_on_the_batch():
    docs = ["é😀 ü".encode() * 50, b"", b"abc " * 200, "日本語テキスト\n".encode() * 40]
    of, b, e, d = substring.chunk(docs)
    for i, doc in enumerate(docs):
        _, b1, e1, d1 = substring.chunk([doc])
        mine = of == i
        assert (b[mine] == b1).all() and (e[mine] == e1).all() and (d[mine] == d1).all()
        for s, t in zip(b1, e1, strict=True):
            doc[s:t].decode()


def test_planted_passages_go_and_the_rest_stays(spark):
    rng = random.Random(11)
    line = " ".join(words_of(rng, 13)) + "."
    docs = {i: [" ".join(words_of(rng, 120)), line, " ".join(words_of(rng, 90))] for i in range(60)}
    planted = []
    for _ in range(20):
        passage = " ".join(words_of(rng, rng.randint(55, 90)))
        where = sorted(rng.sample(range(40), 3))
        for i in where:
            docs[i].insert(rng.randrange(4), passage)
        planted.append((passage, where))
    rows = [(i, "\n".join(p)) for i, p in docs.items()]
    got = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame([(*r, len(r[1]), "k") for r in rows], ROWS + ", n_chars long, repeats string")).collect()}
    for passage, where in planted:
        assert passage in got[where[0]].text
        assert all(passage not in got[i].text for i in where[1:])
        assert all(" ".join(passage.split()[10:-10]) not in got[i].text for i in where[1:])
    assert all(got[i].text == "\n".join(docs[i]) for i in range(40, 60))
    assert all(r.n_chars == len(r.text) and r.repeats == "k" for r in got.values())


def brute_chunks(raw):
    """Chunks by the definition, a byte at a time."""
    places = []
    for i in range(len(raw)):
        h = sum(int(substring.GEAR[raw[i - k]]) << k for k in range(min(16, i + 1))) % 2**64
        inside = i + 1 < len(raw) and raw[i + 1] & 0xC0 == 0x80
        if (raw[i] == 10 or h >> 60 == 0) and not inside:
            mixed = int(common.mix64(np.array([h], np.uint64))[0])
            places.append((i, (raw[i] == 10, mixed >> 1)))
    beaten = lambda i, r: any(j != i and abs(j - i) < 16 and (q > r or (q == r and j < i)) for j, q in places)
    ends = sorted({i + 1 for i, r in places if not beaten(i, r)} | ({len(raw)} if raw else set()))
    return list(zip([0, *ends], ends, strict=False))


def brute_repeats(rows):
    """(key, text without repeats) of every row with a key."""
    owner = {}
    cut_ = {i: [(s, e, raw[s:e] if e - s >= 16 else None) for s, e in brute_chunks(raw)] for i, raw in rows.items()}
    for i, chunks in cut_.items():
        for _, _, said in chunks:
            owner[said] = min(owner.get(said, i), i)
    out = {}
    for i, chunks in cut_.items():
        kept, run = b"", []

        def close(i=i):
            nonlocal kept, run
            said = rows[i][run[0][0] : run[-1][1]] if run else b""
            kept += said if len(said.split()) < substring.MIN_WORDS else b""
            run = []

        for c in chunks:
            if c[2] is not None and owner[c[2]] < i:
                run.append(c)
            else:
                close()
                kept += rows[i][c[0] : c[1]]
        close()
        out[i] = kept.decode()
    return out


def test_substring_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(17)
    passages = [rng.choice([" ", "\n"]).join(words_of(rng, rng.randint(10, 90))) for _ in range(8)]
    rows = {}
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(["é", "漢字", "a", "\n", "w%d" % rng.randrange(300)]) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(5))]
        rows[i] = rng.choice(["\n", " "]).join(parts)
    spark.createDataFrame(list(rows.items()), ROWS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in substring.op10_substring(spark, str(tmp_path)).collect()}
    want = brute_repeats({i: t.encode() for i, t in rows.items()})
    assert got == want and sum(len(want[i]) < len(rows[i]) for i in rows) > 10


def test_passages_of_short_lines_are_found(spark):
    rng = random.Random(19)
    verse = "\n".join(words_of(rng, 60))
    rows = [(i, " ".join(words_of(rng, 50)) + "\n" + (verse if i < 3 else "") + "\n" + " ".join(words_of(rng, 40))) for i in range(5)]
    # a value that differs between lines which repeat stays
    form = [(10 + i, "\n".join(f"line {k} of the form says this\n{'x%d%d' % (i, k)}" for k in range(12))) for i in range(2)]
    got = {r.doc_id: r.text for r in substring.dedup_substrings(spark.createDataFrame(rows + form, ROWS)).collect()}
    assert all(len(got[i]) < len(rows[i][1]) - len(verse) * 0.7 for i in (1, 2)) and all(got[i] == rows[i][1] for i in (0, 3, 4))
    assert all(f"x1{k}" in got[11] for k in range(12))


def test_repeats_within_a_document(spark):
    rng = random.Random(23)
    passage = " ".join(words_of(rng, 80))
    rows = [(1, f"{passage}\n{passage}\nend"), (2, f"begin\n{passage}\n{passage}\nend")]
    docs = spark.createDataFrame(rows, ROWS)
    got = {r.doc_id: r.text for r in substring.dedup_substrings(docs).collect()}
    assert got[1] == rows[0][1] and len(got[2]) < 0.3 * len(passage)
    got = {r.doc_id: r.text for r in substring.dedup_substrings(docs, within=True).collect()}
    assert len(got[1]) < 1.4 * len(passage)


def test_substrings_on_edges(spark, tmp_path):
    edges(spark, "chunk").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.text, r.removed_chars > 0) for r in substring.op10_substring(spark, str(tmp_path)).collect())
    assert sum(got.values()) == len(EDGES)
    long_ = "the quick brown fox " * 4000
    changed = [k for k in got if k[2]]
    assert {k[0] for k in changed} <= {3, 4} and all(len(k[1]) < len(long_) for k in changed)
    assert got[(None, "secret: abcdefgh words", False)] == 1 and got[(1, None, False)] == 1
    assert substring.dedup_substrings(edges(spark, "x", [])).count() == 0


def test_a_passage_that_most_documents_hold_is_no_single_task(spark):
    """Two thirds of all documents hold one passage; their chunks meet the first one's in all tasks."""
    passage = " ".join(f"{w}{i}" for i in range(30) for w in ("shared", "passage"))
    rows = [(i, f"{passage if i % 3 else ''} {' '.join(f'own{i}x{j}' for j in range(12))}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(held, ("-1", "false", "8"), strict=True):
            spark.conf.set(k, v)
        found = substring.repeat_chunks(docs)
        sizes = [r.n for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*found.columns))).collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4] and sum(sizes) >= 1999 * 3



def test_spans_are_code_points(spark, tmp_path):
    rng = random.Random(3)
    passage = " ".join(f"é{w}" for w in words_of(rng, 70))
    texts = {1: passage, 2: "😀 start\n" + passage + "\nrest of it"}
    spark.createDataFrame(list(texts.items()), ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in substring.op10_substring(spark, str(tmp_path)).collect()}
    assert got[1].spans == ""
    s, e = map(int, got[2].spans.split(":"))
    assert texts[2][:s] + texts[2][e:] == got[2].text and got[2].removed_chars == e - s > len(passage) * 0.6


# --- quality


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a ", "b ", "é\n", "#", "\t", "x y z ", " ", "\n\n", "|<"]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)] + [(1000 + i, t, None, 2) for i, (_, t, _) in enumerate(EDGES)]
    spark.createDataFrame(rows, ROWS + ", lang string, n_words long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in quality.op6_quality(spark, str(tmp_path)).collect()}
    for doc, text, _, _ in rows:
        n, *_, repeat = expected = brute_counts(text)
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and r.kept == (not r.base_failed)


def test_binomial_tail_is_exact():
    for n, p in ((20, 0.1), (300, 0.01), (5000, 0.004)):
        for k in (0, 1, 5, int(n * p), int(n * p * 2) + 3):
            exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(min(k, n) + 1))
            assert quality.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_cutoffs_hold_the_risk():
    """Over many holdouts drawn from one population, a cutoff rejects more than the risk about as often as delta allows."""
    rng = np.random.default_rng(5)
    risk, delta, broken = 0.05, 0.1, 0
    steps = rng.beta(2, 3, 200_000)
    population = np.minimum(quality.GRID, np.floor((1 - steps) * quality.GRID) + 1).astype(int)
    for _ in range(200):
        holdout = rng.choice(population, 600)
        cut = quality.certified_step(Counter(holdout.tolist()), dict.fromkeys(range(65), 10**6), 600, risk, delta)
        broken += cut >= 1 and (population <= cut).mean() > risk
    assert broken <= 200 * delta * 1.5
    assert quality.certified_step({}, {1: 5}, 0, risk, delta) == -1 and quality.certified_step({64: 20}, {1: 5}, 20, risk, delta) == -1
    assert quality.certified_step({64: 900}, {}, 900, risk, delta) == -1 and quality.certified_step({9: 2, 64: 900}, {3: 5, 9: 1}, 902, risk, delta) == 3


def test_rules_reject_what_labels_tell_apart(spark):
    rng = random.Random(8)
    good = [(i, " ".join(words_of(rng, 60)), "en") for i in range(2500)]
    bad = [(5000 + i, " ".join(w + "###" for w in words_of(rng, 60)), "en") for i in range(50)]
    docs = spark.createDataFrame(good + bad, ROWS + ", lang string").repartition(4)
    labels = spark.createDataFrame([(d, 1, 0) for d, *_ in good] + [(d, 0, 0) for d, *_ in bad], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep_documents(docs, labels).collect()}
    assert not kept & {d for d, *_ in bad} and len(kept) >= 2500 * (1 - quality.RISK)
    assert quality.keep_documents(docs.limit(0), labels).columns == docs.columns


@pytest.mark.parametrize("good, bad", [({"en": 300, "de": 250}, {"en": 30, "de": 20}), ({"en": 120, "de": 90, "fr": 60}, {"en": 9, "de": 6, "fr": 5}), ({"en": 300, "de": 40}, {"en": 10, "de": 4})])
def test_few_labels_suffice(spark, good, bad):
    """Some 230 good labels certify a stratum; strata with fewer are judged as a pool, if that has enough."""
    rng = random.Random(3)
    rows = [(" ".join(words_of(rng, 60)), g, 1) for g, n in good.items() for _ in range(n)] + [(" ".join(w + "###" for w in words_of(rng, 60)), g, 0) for g, n in bad.items() for _ in range(n)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    docs = spark.createDataFrame([(i, t, g, "x", 1) for i, t, g, _ in rows] + [(-1, rows[-1][1], "other", "x", 1)], ROWS + ", stratum string, `a.b` string, n_words int")
    kept = {r.doc_id for r in quality.keep_documents(docs, spark.createDataFrame([(i, q) for i, _, _, q in rows], "doc_id long, quality int"), "stratum").collect()}
    judged = {n for n, k in good.items() if k >= 230}
    if sum(k for n, k in good.items() if n not in judged) >= 230:
        judged = set(good)
    assert kept == {-1} | {i for i, _, g, q in rows if q == 1 or g not in judged}


# --- languages


def brute_score(pieces, probs, word):
    index = {w: i for i, w in enumerate(pieces.words)}
    alpha = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - pieces.longest), j):
            k = index.get(word[i:j], pieces.size if j - i == 1 else None)
            if k is not None:
                alpha[j] += alpha[i] * probs[k, 0]
    return math.log(alpha[-1])


def test_forward_sums_all_segmentations():
    pieces = langid.pieces_of(common_vocabulary())
    probs = np.r_[np.random.default_rng(0).random((pieces.size + 1, 1)), np.zeros((1, 1))]
    probs /= probs.sum()
    words = ["▁the", "▁einschließlich", "▁a", "▁ȹx", "▁" + "ha" * 40]
    got = langid.score_words(pieces, probs, words)[:, 0]
    assert got == pytest.approx([brute_score(pieces, probs, w) for w in words])
    counts = langid.expect(pieces, probs, words[:4], np.ones(4))
    lengths = np.array([len(w) for w in pieces.words] + [1, 0])
    assert (counts * lengths).sum() == pytest.approx(sum(map(len, words[:4])))  # expected pieces cover each letter once


def segmentations(pieces, index, word):
    """All ways to cut a word into pieces, as lists of piece numbers."""
    if not word:
        yield []
    for j in range(1, min(len(word), pieces.longest) + 1):
        k = index.get(word[:j], pieces.size if j == 1 else None)
        if k is not None:
            for rest in segmentations(pieces, index, word[j:]):
                yield [k, *rest]


def brute_expect(pieces, index, probs, words):
    """Expected counts of pieces by enumeration; `probs` by piece, `words` with their counts."""
    counts = np.zeros(pieces.size + 2)
    for w, n in words.items():
        ways = [(s, math.prod(probs[k] for k in s)) for s in segmentations(pieces, index, w)]
        total = sum(p for _, p in ways)
        for s, p in ways:
            for k in s:
                counts[k] += n * p / total
    return counts


def test_expected_counts_equal_enumeration():
    pieces = langid.pieces_of(common_vocabulary())
    index = {w: i for i, w in enumerate(pieces.words)}
    probs = np.r_[np.random.default_rng(1).random((pieces.size + 1, 1)), np.zeros((1, 1))]
    probs /= probs.sum()
    words = {"▁the": 3, "▁haus": 1, "▁quelque": 2, "▁ȹx": 5, "▁a": 1}
    got = langid.expect(pieces, probs, list(words), np.array(list(words.values()), float))
    assert got == pytest.approx(brute_expect(pieces, index, probs[:, 0], words))


@pytest.mark.parametrize("length", [40, 64, 65, 1000, 20_000])
def test_long_words_are_learned_from_and_scored(length):
    pieces = langid.pieces_of(common_vocabulary())
    rng = np.random.default_rng(length)
    # languages far apart, so that a common scale would lose one of them
    probs = np.r_[np.maximum(rng.random((pieces.size + 1, 3)) ** np.array([1, 8, 30]), 1e-7), np.zeros((1, 3))]
    probs /= probs.sum(axis=0)
    word = "▁" + "".join(rng.choice(list("abcdefgh漢字"), length))
    got = langid.score_words(pieces, probs, [word])
    assert np.isfinite(got).all()
    counts = langid.expect(pieces, probs[:, [2]], [word], np.array([2.0]))
    lengths = np.array([len(w) for w in pieces.words] + [1, 0])
    assert (counts * lengths).sum() == pytest.approx(2 * len(word))


def brute_languages(train, docs, rounds, smoothing):
    """Predictions from models that are learned by enumerating all segmentations of words."""
    pieces = langid.pieces_of(common_vocabulary())
    index = {w: i for i, w in enumerate(pieces.words)}
    cut = lambda t: ["▁" + w for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
    probs = {}
    for name in sorted({g for _, g in train}):
        words = Counter(w for t, g in train if g == name for w in cut(t))
        p = np.r_[np.full(pieces.size + 1, 1 / (pieces.size + 1)), 0]
        for _ in range(rounds):
            counts = brute_expect(pieces, index, p, words) + smoothing
            counts[-1] = 0
            p = counts / counts.sum()
        probs[name] = p
    out = []
    for t in docs:
        logs = {g: sum(math.log(sum(math.prod(p[k] for k in s) for s in segmentations(pieces, index, w))) for w in cut(t)) for g, p in probs.items()}
        best = max(logs, key=logs.get)
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    said = {"en": "the cat and the dog were on the mat", "de": "der Hund und die Katze auf dem Dach", "fr": "le chat et le chien dans la rue"}
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lang = rng.choice(sorted(said))
        rows.append((i, " ".join(rng.choices(said[lang].split(), k=rng.randrange(1, 6))) + rng.choice(["", " 12, und", " the"]), lang))
    spark.createDataFrame(rows, ROWS + ", lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in langid.op8_langid(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    want = brute_languages([(t, g) for i, t, g in rows if not held[i]], [t for _, t, _ in rows], langid.ROUNDS, langid.SMOOTHING)
    for (i, *_), (name, score) in zip(rows, want, strict=True):
        assert got[i].held_out == held[i] and got[i].lang_pred == name and got[i].score == pytest.approx(score)


def test_no_text_changes_what_another_gets(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").orderBy("doc_id").limit(30).collect()]
    model = langid.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), common_vocabulary())
    alone = []
    for t in docs:
        model.begin()
        alone += list(zip(*model.predict([t]), strict=True))
    model.begin()
    odd = ["q" * 1000 + " x", "漢字" * 500 + "\n" + "ไทย" * 300, "e" * 20_000, "Zz" * 700 + " the end"]
    names, scores = model.predict(odd + docs)
    assert all(0 <= s <= 1 for s in scores)
    assert names[len(odd) :] == [n for n, _ in alone] and scores[len(odd) :] == pytest.approx([s for _, s in alone])
    names, scores = model.predict(docs)  # with what the worker remembers by now
    assert names == [n for n, _ in alone] and scores == pytest.approx([s for _, s in alone])
    rows = spark.createDataFrame(list(enumerate(odd + docs)), ROWS)
    one, many = (sorted(map(tuple, langid.predict(rows.repartition(n), model).collect())) for n in (1, 7))
    assert [r[:2] for r in one] == [r[:2] for r in many] and [r[2] for r in one] == pytest.approx([r[2] for r in many])


def common_vocabulary():
    from scoresheet_spark.llm.bpe import vocabulary

    return vocabulary(langid.PIECE_BPE)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    got = langid.op8_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_on_edges(spark, tmp_path):
    rows = [(d, t, None) for d, t, _ in EDGES] + [(10, "der die das und", "de"), (11, "the and of to", "en"), (12, "the cat", "en"), (13, "das haus", "de"), (14, "12 34", "en"), (15, "ȹ", None)]
    spark.createDataFrame([(*r, 1) for r in rows], ROWS + ", lang string, score long").write.parquet(str(tmp_path / "documents.parquet"))
    got = langid.op8_langid(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == by[2].lang_pred == by[5].lang_pred == by[14].lang_pred == "und" and by[1].score == 0
    assert {by[15].lang_pred, by[4].lang_pred} <= {"de", "en"}
    spark.createDataFrame([], ROWS + ", lang string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert langid.op8_langid(spark, str(tmp_path / "none")).count() == 0


# --- top-k


def brute_top(rows, k):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, (q, v) in enumerate(usable):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for c, (i, w) in enumerate(usable) if c != r)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [64, 32_768])
def test_top_k_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 0.2, 16).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)] + [(50, rows[3][1]), (100, rows[100][1]), (100, rows[100][1]), (700, [2.0**33, -3.0e9]), (750, [0.0, 0.0, 1.0e10]), (None, rows[1][1]), (400, None), (450, [None, 1.0]), (500, [float("nan")] * 16), (550, [float("inf")]), (600, [0.5, -0.25]), (650, [])]
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = topk.op9_topk(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(rows, 5)


def test_scores_beyond_a_long_are_errors(spark, tmp_path):
    for n, rows in enumerate(([(50, [5.0e7, 1.0]), (1, [5.0e7, 1.0])], [(50, [1.0]), (1, [1.0e30])])):
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / str(n) / "embeddings.parquet"))
        with pytest.raises(Exception, match="a long can't hold|a quantised component"):
            topk.op9_topk(spark, str(tmp_path / str(n))).collect()
    # a query's own product may be of any size
    spark.createDataFrame([(50, [5.0e7, 1.0]), (1, [0.5, 1.0])], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "own" / "embeddings.parquet"))
    assert list(map(tuple, topk.op9_topk(spark, str(tmp_path / "own")).collect())) == [(50, 1, 1, 256 * 256 * 25_000_001)]


def test_top_k_of_few_rows_and_none(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (50, [1.0, -2.0]), (1, [0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "a" / "embeddings.parquet"))
    assert sorted(map(tuple, topk.op9_topk(spark, str(tmp_path / "a")).collect())) == brute_top(rows, 5)
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "b" / "embeddings.parquet"))
    assert topk.op9_topk(spark, str(tmp_path / "b")).count() == 0


def test_slices_hold_values_and_scores():
    rng = np.random.default_rng(1)
    vectors, ids = rng.integers(-300, 300, (130, 7)), np.arange(130)
    index = topk.Index.load(*topk.Index.build(ids, vectors))
    assert (index.values(np.arange(130)) == vectors).all()
    query = rng.integers(-300, 300, 7)
    slices = index.scores(query)
    total = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << i) for i, s in enumerate(slices))
    assert len(set((total - vectors @ query).tolist())) == 1


# --- pipeline and shared parts


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs, steps = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = stage(spark, docs, sf)
        docs = common.cut(steps[name])
        if name != "packing":
            assert docs.columns == documents.columns
            steps[name] = {r.doc_id: r for r in docs.collect()}
    failed = {r.doc_id for r in quality.op6_quality(spark, sf).collect() if not r.kept}
    assert failed and set(steps["quality"]) == {r.doc_id for r in documents.collect()} - failed
    classes = brute_classes([(r.doc_id, r.text) for r in steps["quality"].values()])
    assert set(steps["near_duplicates"]) == {c for _, c in classes}
    assert set(steps["repeats"]) == set(steps["secrets"]) == set(steps["near_duplicates"])
    assert all(len(steps["repeats"][d].text) <= len(r.text) for d, r in steps["near_duplicates"].items())
    ran = corpus_pipeline.run(spark, sf)
    assert ran.columns == docs.columns and ran.drop("sequence_id", "offset").exceptAll(docs.drop("sequence_id", "offset")).count() == 0
    assert ran.count() == docs.count() and ran.select("doc_id").distinct().count() == len(steps["secrets"])


def test_pipeline_of_no_rows_and_edges(spark):
    import corpus_pipeline

    for rows in ([], [(d, t, None, None, None, n) for d, t, n in EDGES]):
        docs = spark.createDataFrame(rows, ROWS + ", lang string, source string, n_chars long, row long")
        for name, stage in corpus_pipeline.STAGES:
            docs = common.cut(stage(spark, docs, "/root/testdata/sf0.001"))
            assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]


def test_sizes_are_checked_before_broadcast(spark):
    few, many = spark.range(3), spark.range(50)
    assert "broadcast" in common.small(few, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in common.small(many, 10)._jdf.queryExecution().logical().toString().lower()
    assert few.select(F.lit(1)).count() == 3
