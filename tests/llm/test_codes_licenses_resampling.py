"""Vector codes, license scans and resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from popweave.llm import licenses, resampling, vector_codes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# ---------------------------------------------------------------- vector codes


def by_hand(vectors, parts, entries, rounds):
    """Codes, errors and codebooks of (id, ints) rows, every entry tried for every part."""
    order = sorted(vectors, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(order[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    book = [[cut(v, p) for _, v in order[:entries]] for p in range(parts)]
    nearest = lambda v, p: min(range(len(book[p])), key=lambda e: (far(cut(v, p), book[p][e]), e))
    for _ in range(rounds):
        new = [list(b) for b in book]
        for p in range(parts):
            of = {}
            for _, v in vectors:
                of.setdefault(nearest(v, p), []).append(cut(v, p))
            for e, members in of.items():
                new[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        book = new
    codes = [[nearest(v, p) for p in range(parts)] for _, v in vectors]
    errors = [sum(far(cut(v, p), book[p][c[p]]) for p in range(parts)) for (_, v), c in zip(vectors, codes, strict=True)]
    return codes, errors, book


def table(spark, rows, kind="vec_id long, label int, embedding array<double>, code string, error long"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], kind)


@pytest.mark.parametrize("seed,entries,rounds", [(1, 8, 2), (2, 5, 4), (3, 64, 2), (4, 1, 2)])
def test_codes_equal_a_full_search(spark, seed, entries, rounds):
    r = random.Random(seed)
    centres = [[r.uniform(-3, 3) for _ in range(8)] for _ in range(6)]
    rows = [(i, i % 3 if i % 7 else None, [round(x + r.gauss(0, 0.2 if seed < 3 else 1.0), 1 if seed == 2 else 6) for x in r.choice(centres)]) for i in range(60)]
    rows += [(7, 1, rows[7][2]), (None, None, rows[3][2]), (None, 2, rows[4][2])]  # repeated and null ids
    got, history = vector_codes.compressed(table(spark, rows), 4, entries, rounds)
    codes, errors, book = by_hand([(i, [math.floor(256 * x) for x in v]) for i, _, v in rows], 4, entries, rounds)
    assert history[-1].tolist() == book and len(history) == rounds + 1
    want = sorted(str((i, "".join(f"{c:02x}" for c in k), e)) for (i, _, _), k, e in zip(rows, codes, errors, strict=True))
    assert sorted(str((x.vec_id, x.code, x.error)) for x in got.collect()) == want


def test_bounds_spare_scans_and_never_err():
    r = np.random.default_rng(5)
    x = r.integers(-2000, 2000, (400, 3, 4)) + r.integers(0, 4, (400, 1, 1)) * 8000
    history = [x[:20].transpose(1, 0, 2)]
    found = [vector_codes.scan(x[:, p], history[0][p]) for p in range(3)]
    code, low, stamp = np.stack([c for c, _ in found], 1), np.stack([b for _, b in found], 1), np.zeros((400, 3), np.int64)
    spared = 0
    for step in range(6):  # entries wander out and back: net displacement stays small while drifts add up
        history.append(history[0] + (r.integers(-40, 40, history[0].shape) if step % 2 else r.integers(-400, 400, history[0].shape)))
        code, low, stamp, error, scanned = vector_codes.reassigned(x, history, code, low, stamp)
        d = ((x[:, :, None] - history[-1][None]) ** 2).sum(axis=3)
        assert (code == d.argmin(axis=2)).all() and (error == d.min(axis=2)).all()
        assert (stamp[scanned] == len(history) - 1).all()
        spared += (~scanned).sum()
    assert spared > 2000


def test_codes_of_odd_tables(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    v = [0.5, -0.25, 1.0, 3.0]
    rows = [(1, None, v), (2, None, None), (3, 1, [0.1, None, 0.2, 0.3]), (4, 1, [nan, 0.0, 0.0, 0.0]), (5, 1, [0.0, -inf, 0.0, 0.0]), (6, 1, []), (7, 1, [1.0, 2.0]), (8, 1, v), (9, 2, [-0.001] * 4)]
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 0)  # labels joined by salted keys
    got, history = vector_codes.compressed(table(spark, rows), 2, 64, 2)
    got = {r.vec_id: r for r in vector_codes.with_label_error(got).collect()}
    assert sorted(got) == [1, 8, 9] and got[1].code == got[8].code and got[1].error == got[9].error == 0
    assert got[9].code == "0202" and history[-1][0][2].tolist() == [-1, -1]  # floors go down
    assert [got[k].label_error for k in (1, 8, 9)] == [0, 0, 0]
    none, books = vector_codes.compressed(table(spark, rows[1:3]), 2)
    assert none.count() == 0 and vector_codes.digest(books[-1]) == hashlib.sha256(b"").hexdigest()
    big = [(1, 1, [1e300, 0.0, 0.0, 0.0]), (2, 1, [-1e300, 0.0, 0.0, 0.0])]
    assert sorted(r.error for r in vector_codes.compressed(table(spark, big), 2, 1, 1)[0].collect())[0] > 0


def test_label_errors(spark):
    codes = spark.createDataFrame([(1, None, "0", 2, 0), (2, None, "0", 3, 0), (3, 7, "0", 5, 0)], "vec_id long, label int, code string, error long, rescans int")
    assert sorted((r.vec_id, r.label_error) for r in vector_codes.with_label_error(codes).collect()) == [(1, 5), (2, 5), (3, 5)]


# ---------------------------------------------------------------- license scans


def fewest_edits(phrase, text):
    """The least edit distance of the phrase to any part of the text."""
    row = list(range(len(phrase) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(phrase, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row, best = new, min(best, new[-1])
    return best


def edited(r, phrase, n):
    out = list(phrase)
    for _ in range(n):
        k = r.randrange(len(out))
        kind = r.randrange(3)
        out[k : k + 1] = [] if kind == 0 else [r.choice("abcxyz ")] if kind == 1 else [out[k], r.choice("abcxyz")]
    return "".join(out)


def test_notices_with_edits_equal_an_edit_distance_table(spark):
    r = random.Random(11)
    wanted = licenses.notices()
    texts = []
    for k in range(140):
        filler = lambda: " ".join(r.choice(["lorem", "license", "of the", "any", "Software", "é", "gnu", "permission"]) for _ in range(r.randrange(12)))
        notice = wanted[k % len(wanted)]
        texts.append(f"{filler()} {edited(r, notice.phrase.strip(), r.randrange(7))}, {filler()}\n{edited(r, r.choice(wanted).phrase.strip(), r.randrange(3)).upper()}")
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, places string")
    for got in licenses.scanned(rows).collect():
        plain = f" {' '.join(words(texts[got.doc_id]))} "
        want = {}
        for notice in wanted:
            e = fewest_edits(notice.phrase, plain)
            if e <= notice.edits:
                want[notice.label] = max(want.get(notice.label, 0), 1 - e / len(notice.phrase.strip()))
        found = {}
        for p in got.places:
            found[p.label] = max(found.get(p.label, 0), p.score)
            assert p.text in plain and words(texts[got.doc_id])[p.word].endswith(p.text.split(" ")[0][-1:])
        assert found == pytest.approx(want), texts[got.doc_id]


def test_base_places(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t", "MIT License", "mit-license MIT_LICENSE mit  license!", "permit license mit licenses", "General Public License general public license", "émit license", "mit license " * 3]
    texts += [" ".join(r.choice(["mit", "License", "apache", "general", "PUBLIC", "x"]) for _ in range(60)) for _ in range(30)]
    texts.append("lorem ipsum " * 400_000 + "Apache License")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scanned(rows).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        w = words(text)
        want = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        assert got[i].n_words == len(w) and sorted((p.word, p.label) for p in got[i].places if p.base) == want
    assert licenses.scanned(rows.where("false")).count() == 0


def test_licenses_query(spark):
    from popweave.llm.queries import QUERIES

    rows = QUERIES["op12_licenses"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        w = words(docs[r.doc_id])
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and (r.score == 1) >= bool(at)


# ---------------------------------------------------------------- resampling


def weights_by_hand(docs, target, n, buckets):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for b in features(t):
                out[b] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = features(text)
        out.append((i, len(words(text)), len(f), sum(gain[b] for b in f) // len(f) if f else 0))
    return out


@pytest.mark.parametrize("n,hot", [(1, 10_000), (1, 3), (2, 3), (3, 10_000)])
def test_weights_equal_plain_counts(spark, monkeypatch, n, hot):
    monkeypatch.setattr(resampling, "HOT", hot)
    r = random.Random(n + hot)
    line = lambda: " ".join(r.choice(["Aa", "bb", "çç", "d-e", "f", "G", "hh", ""]) for _ in range(r.randrange(6)))
    shared = [line() for _ in range(6)] + ["", " ", "boiler plate line"]
    docs = [(i, "\n".join(r.choice(shared) if r.random() < 0.6 else line() for _ in range(r.randrange(1, 9)))) for i in range(50)]
    docs += [(3, docs[3][1]), (3, docs[3][1]), (3, "other"), (None, "a b\nc"), (None, "a b\nc"), (90, None), (91, ""), (92, "\n\n"), (93, "aa " * 300_000)]
    target = ["aa bb\ncc", "hh hh", None, "boiler plate"]
    d = spark.createDataFrame([(*x, "q", 1) for x in docs], "doc_id long, text string, line string, n long")
    got = resampling.weighed(d, spark.createDataFrame([(x,) for x in target], "text string"), n, 97)
    assert sorted(map(str, [(x.doc_id, x.n_words, x.n_features, x.weight) for x in got.collect()])) == sorted(map(str, weights_by_hand(docs, target, n, 97)))


def test_draw(spark):
    rows = [(i, 1, 2, 1, 30 if i % 4 else 5, 30, -700 + i % 3) for i in range(400)] + [(None, 1, 2, c, 40, 40, 0) for c in (1, 2, 3)]
    d = spark.createDataFrame(rows, "doc_id long, h1 long, h2 long, copy long, n_words long, n_features long, weight long")
    got = resampling.drawn(d).collect()

    def score(i, weight):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        return weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    fit = sorted(((-score(i, w), i is None, i or 0, c) for i, _, _, c, words_, _, w in rows if words_ >= 20))
    most = len(fit) * 10 // 100
    want = {(None if none else i, c): k + 1 for k, (_, none, i, c) in enumerate(fit[:most])}
    assert len(got) == len(rows) and {(x.doc_id, x.copy): x.rank for x in got if x.rank is not None} == want
    assert all(x.score == score(x.doc_id, x.weight) for x in got)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert resampling.resampled(docs.where("false"), docs.select("text")).count() == 0
    assert [(r.n_features, r.rank) for r in resampling.resampled(docs, none).collect()] == [(2, None)]
