"""Text operators on small fixtures: brute force, round trips, and the defined odd cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from popweave.llm import decontamination, jaccard_join, line_dedup, lm_scoring, mixing, token_files, toxicity, winnowing
from popweave.llm.common import hash_strings, shingles, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def made(spark, texts, source=lambda i: f"s{i % 3}", start=0):
    return spark.createDataFrame([(start + i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = []
    for i in range(90):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 9))]
        texts.append("\n".join(lines).capitalize())
    for i in range(25):  # exact copies, near copies, shared lines
        w = texts[i].split(" ")
        texts.append(texts[i])
        if len(w) > 30:
            w[rng.randrange(len(w))] = "Changed"
        texts.append(" ".join(w))
        texts.append(texts[i].split("\n")[0] + "\n" + texts[i + 30])
    return [*texts, None, "", " \n\t ", "one", "One", "two words", "x" * 5000 + " tail", "ten " * 12]


ODD = [None, "", " ", "a", "a", "Ä ß \U0001f600 é", "w " * 3000]


def clashing(df):
    names = ["_key", "_u", "size", "copies", "rate", "target", "h", "score", "predicted", "_gone", "_leak", "class_id", "key", "rank", "_copy", "words"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def operators(spark):
    bench = spark.createDataFrame([(1, "b c d e f g h i j k l m n o p"), (2, None), (3, "a"), (4, "b c d e f g h i j k l m n o p")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    return {
        "mix": lambda d: mixing.mix(d),
        "mixed": lambda d: mixing.mixed(d),
        "near": lambda d: jaccard_join.near_duplicates(d),
        "dedup": lambda d: jaccard_join.deduplicated(d),
        "leaks": lambda d: decontamination.overlaps(d, bench),
        "clean": lambda d: decontamination.decontaminated(d, bench),
        "toxic": lambda d: toxicity.without_toxic(d, toxicity.learnt(d, labels)),
        "lm": lambda d: lm_scoring.scored(d),
        "tokens": lambda d: token_files.encoded(d),
        "lines": lambda d: line_dedup.deduplicated(d),
        "next": lambda d: winnowing.with_fingerprints(winnowing.with_next(winnowing.placed(d), {"text": "next_text"}), {"text": "f"}),
    }


ROWS = {"mix": None, "near": None, "lm": None, "tokens": None, "lines": None, "next": None}


@pytest.mark.parametrize("name", ["mix", "mixed", "near", "dedup", "leaks", "clean", "toxic", "lm", "tokens", "lines", "next"])
def test_odd_tables(spark, name):
    f = operators(spark)[name]
    odd = made(spark, ODD, source=lambda i: None if i % 2 else "s")
    odd = odd.unionByName(odd.limit(2)).unionByName(spark.createDataFrame([(None, "no id here at all", None, None, None), (None, None, None, None, None)], SCHEMA))
    n = odd.count()
    got = f(clashing(odd)).collect()
    if name in ROWS:
        assert len(got) == n
    if name in ("mixed", "dedup", "clean", "toxic"):
        assert set(f(clashing(odd)).columns) == set(clashing(odd).columns)
    assert f(odd.limit(0)).collect() == []


def test_word_hashes():
    texts = pa.array([" a b\tA", None, "", "b", "ü a"])
    w, offsets = words_of(texts)
    assert w.to_pylist() == ["a", "b", "a", "b", "ü", "a"] and offsets.tolist() == [0, 3, 3, 3, 4, 6]
    h = hash_strings(w)
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3
    long_ = pa.array(["x" * 3_000_000, "y", "x" * 3_000_000])
    assert hash_strings(long_)[0] == hash_strings(long_)[2]
    sliced = pa.array(["skip me", *texts.to_pylist()]).slice(1)
    assert words_of(sliced)[0].to_pylist() == w.to_pylist()
    s, cut = shingles(h, offsets, 2)
    assert np.diff(cut).tolist() == [2, 0, 0, 1, 1]


def test_near_duplicates_against_all_pairs(spark, corpus):
    def grams(t):
        w = words(t)
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for t in corpus]
    n, root = len(sets), list(range(len(sets)))
    links = [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {(i, find(i), links[i]) for i in range(n)}
    assert sum(links) > 50
    docs = made(spark, corpus)
    for block in (256, 4):  # small blocks: pairs of blocks are separate tasks
        assert {tuple(r) for r in jaccard_join.near_duplicates(docs, block=block).collect()} == want
    kept = {r.doc_id for r in jaccard_join.deduplicated(docs).collect()}
    assert kept == {c for _, c, _ in want}


def test_rows_of_one_id_keep_their_own_links(spark):
    rng = random.Random(21)
    text = lambda n=60: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    one, two = text(), text()
    rows = [(5, one), (5, two), (7, two + " end"), (9, two), (9, one + " more"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(docs).collect())
    # by text: one ~ one + " more"; two = two ~ two + " end"; the least ids of both groups are 5
    assert got == Counter([(5, 5, 1), (5, 5, 2), (7, 5, 2), (9, 5, 2), (9, 5, 1), (9, 9, 0)])


def test_very_long_texts(spark):
    rng = random.Random(22)
    long_ = " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(10**5)) for _ in range(300_000))  # some 2 MB
    docs = made(spark, [long_, long_ + " end", "x" * 3_000_000, "one\n" * 200_000, "short"])
    bench = spark.createDataFrame([(1, " ".join(long_.split()[1000:1040]))], "item_id long, text string")
    assert [r.class_id for r in jaccard_join.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 0, 2, 3, 4]
    assert sorted(r.doc_id for r in decontamination.overlaps(docs, bench).collect()) == [0, 1]
    assert [r.size for r in mixing.mix(docs).orderBy("doc_id").collect()] == [300_000, 300_001, 1, 200_000, 1]
    assert [r.n_tokens for r in lm_scoring.scored(docs).orderBy("doc_id").collect()] == [300_001, 300_002, 2, 200_001, 2]
    lines = {r.doc_id: r.n_lines for r in line_dedup.deduplicated(docs).select("doc_id", "n_lines").collect()}
    assert lines[3] == 200_001 and lines[0] == 1


def test_repeated_words_stay_bounded(spark):
    bench = spark.createDataFrame([(i, f"w{i} " * 200) for i in range(5)], "item_id long, text string")
    docs = made(spark, ["w1 " * 16_000, "w9 " * 16_000, "w3 " * 12])
    got = {(r.doc_id, r.item_id): r.n_matches for r in decontamination.overlaps(docs, bench).collect()}
    assert got == {(0, 1): 200, (2, 3): 12}


def test_rates_are_the_tilt_that_meets_the_targets(spark, corpus):
    import math

    rows = mixing.mix(made(spark, corpus * 3, source=lambda i: ["b", "a", "c"][0 if i % 3 == 0 else i % 3])).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        sizes, target = [r.size for r in rs], rs[0].target
        if target >= 2 * sum(sizes) * (1 - 1e-9):
            assert all(r.rate == 2 for r in rs)
            continue
        mean = sum(sizes) / len(sizes)
        rate = lambda x, z, m=mean: min(2.0, math.exp(max(-700.0, min(700.0, x * z / m))))
        low, high = -1e4, 1e4
        for _ in range(200):  # the dual by bisection
            mid = (low + high) / 2
            low, high = (low, mid) if sum(rate(mid, z) * z for z in sizes) > target else (mid, high)
        assert all(abs(r.rate - rate(low, r.size)) < 5e-3 for r in rs)


def test_pruning_table():
    need = jaccard_join.needed_matches()
    assert len(need) == 8 and need == sorted(need) and 0 < need[0] and need[-1] < 0.8 * 128


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(120):
        w = list(base)
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    got = jaccard_join.near_duplicates(made(spark, texts), block=16).collect()
    assert {r.class_id for r in got} == {0}
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    want = {i: sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for i, a in enumerate(sets)}
    assert {r.doc_id: r.n_links for r in got} == want


def test_mix_targets_and_rounding(spark, corpus):
    docs = made(spark, corpus * 3, source=lambda i: ["b", "a", None, "c"][0 if i % 3 == 0 else i % 4])
    rows = mixing.mix(docs).collect()
    size = Counter()
    for r in rows:
        assert r.size == len(words(r.text)) and 0 <= r.copies <= 2 and (r.size or not r.copies)
        size[r.source] += r.size
    order = ["a", "b", "c", None]
    weight = dict(zip(order, [3, 1, 2, 3], strict=True))
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        for s in over or free:
            target[s] = 2 * size[s] if over else level * weight[s]
            left -= target[s]
        free -= over or set(free)
    taken = Counter()
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 * r.target and r.source_size == size[r.source]
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 20 for s in order)
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    assert mixing.mixed(docs).count() == sum(r.copies for r in rows)


def test_leaks_tolerate_substitutions(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    items = [[word() for _ in range(n)] for n in (40, 25, 15, 6, 3)]
    bench = spark.createDataFrame([(i, " ".join(x).capitalize() + ".") for i, x in enumerate(items)], "item_id long, text string")
    filler = lambda n: [word() for _ in range(n)]
    swapped = list(items[0])
    for k in (9, 19, 29):
        swapped[k] = "other"
    texts = [
        filler(50) + items[0] + filler(9), filler(20) + swapped + filler(5), [x.upper() + "," for x in items[1]],
        filler(30) + items[2], filler(4) + items[3] + filler(4), items[4] + filler(30), filler(200), items[1][:14] + filler(9), items[1][:6] + filler(60),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontamination.overlaps(made(spark, [" ".join(t) for t in texts]), bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (7, 1)}
    assert (got[0, 0].doc_start, got[0, 0].item_start, got[0, 0].n_words, got[0, 0].n_matches) == (50, 0, 40, 40)
    assert (got[1, 0].doc_start, got[1, 0].n_words, got[1, 0].n_matches) == (20, 40, 37)
    sliced = decontamination.overlaps(made(spark, [" ".join(t) for t in texts]), bench, slice_words=30).collect()
    assert {(r.doc_id, r.item_id) for r in sliced} == set(got)


def test_decisions_are_about_rows_not_ids(spark):
    rng = random.Random(8)
    text = lambda n=40: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage, one, two, three, four = text(20), text(), text(), text(), text()
    leak = f"{text(9)} {passage}"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(None, leak), (None, one), (None, None), (5, leak), (5, two), (6, three)], "doc_id long, text string")
    kept = [tuple(r) for r in decontamination.decontaminated(docs, bench).collect()]
    assert Counter(kept) == Counter([(None, one), (None, None), (5, two), (6, three)])
    rows = [(None, one), (None, one), (None, one + " more"), (3, two), (3, two), (None, two), (7, three), (2, three), (2, four), (7, four + " end"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter(tuple(r) for r in jaccard_join.deduplicated(docs).collect())
    ones = [r for r in kept.elements() if r[1] and r[1].startswith(one)]
    assert len(ones) == 1
    kept.subtract(ones)
    assert +kept == Counter([(3, two), (2, three), (2, four), (None, None), (None, "")])


def test_leaks_every_substitution(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    items = {n: [word() for _ in range(n)] for n in range(5, 21)}
    texts, want = [], {}
    for n, item in items.items():
        most = n // 5
        for changes in range(most + 2 if n < 12 or n == 15 else most + 1):
            for places in itertools.combinations(range(n), changes):
                text = [word() if k in places else x for k, x in enumerate(item)]
                want[len(texts), n] = n - changes if changes <= most else None  # one more is under 80 %
                texts.append(" ".join([word(), *text, word()]))
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matches for r in decontamination.overlaps(made(spark, texts), bench).collect()}
    wrong = {k: (n, got.get(k)) for k, n in want.items() if got.get(k) != n}
    assert not wrong, (len(wrong), list(wrong.items())[:3])


def test_best_segment_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(300):
        equal = rng.random(rng.integers(1, 40)) < 0.75
        begin, end, n = decontamination.best_segment(equal)
        most = max((int(equal[a:b].sum()) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if 5 * equal[a:b].sum() >= 4 * (b - a)), default=0)
        assert n >= most and n == equal[begin:end].sum()
        assert n == most or n - decontamination.PENALTY * (end - begin - n) > 0


def test_short_items_word_for_word(spark):
    rng = random.Random(21)
    word = lambda: rng.choice(["red", "green", "blue", "Cyan", "pink"])
    items = [[word() for _ in range(n)] for n in (1, 2, 2, 3, 3, 4, 4, 4)] + [["..."]]
    texts = [" ".join(word() + rng.choice(["", ",", "."]) for _ in range(rng.randrange(14))) for _ in range(80)] + [None, "", "... !"]
    bench = spark.createDataFrame([(n, " ".join(x) + "!") for n, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_matches) for r in decontamination.overlaps(made(spark, texts), bench).collect()}
    want = {}
    for d, text in enumerate(texts):
        w = [x for x in (y.strip(".,!") for y in words(text)) if x]
        for n, x in enumerate(items[:-1]):
            x = [y.lower() for y in x]
            if any(w[k : k + len(x)] == x for k in range(len(w) - len(x) + 1)):
                want[d, n] = (len(x), len(x))
    assert got == want


def test_leaks_against_brute_force(spark, corpus):
    rng = random.Random(11)
    long_ = [t for t in corpus if t and len(t.split()) > 25]
    passages = [" ".join(long_[i].split()[3 : 3 + rng.randint(13, 20)]) for i in range(0, 30, 3)]
    bench = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.overlaps(made(spark, corpus), bench).collect()}
    for d, text in enumerate(corpus):
        plain = " " + " ".join(words(text)) + " "
        for i, p in enumerate(passages):
            if f" {' '.join(words(p))} " in plain:
                assert (d, i) in found
    assert len(found) >= len(passages)


def test_line_dedup_against_brute_force(spark, corpus):
    docs = [(i, (t or "").split("\n")) for i, t in enumerate(corpus)]
    count = [[len(words(x)) for x in ls] for _, ls in docs]
    seen, gone = {}, set()
    for d, ls in docs:
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                run = tuple(ls[a : b + 1])
                if sum(count[d][a : b + 1]) >= 10:
                    if run in seen:
                        gone |= {(d, i) for i in range(a, b + 1)}
                    seen.setdefault(run, (d, a))
    rows = {r.doc_id: r for r in line_dedup.deduplicated(made(spark, corpus)).collect()}
    assert len(gone) > 20
    for d, ls in docs:
        assert rows[d].text == "\n".join(x for i, x in enumerate(ls) if (d, i) not in gone), d
        assert rows[d].n_lines == len(ls) and rows[d].deleted_lines == sorted(i for e, i in gone if e == d)


def test_suffix_ranks_are_ordered(spark):
    lined = line_dedup.with_lines(made(spark, ["a\nb\na\nb\nc", "a\nb\nc\nq", "b\nc\nb\nc"]))
    lines = line_dedup.repeated_lines(lined)
    ranks = line_dedup.suffix_ranks(lines, 4).collect()
    name = {(r.level, r.doc_id, r.line_no): r["rank"] for r in ranks}
    assert name[1, 0, 0] == name[1, 0, 2] == name[1, 1, 0] and name[1, 0, 3] == name[1, 1, 1] == name[1, 2, 0]
    first = {r.line_no: r["rank"] for r in lines.where("doc_id = 0").collect()}
    assert (name[1, 0, 0] < name[1, 0, 3]) == (first[0] < first[1])  # the order of pairs follows the order of first lines


def test_winnowing_against_brute_force(spark, corpus):
    k, w = winnowing.K, winnowing.WINDOW
    docs = winnowing.with_next(winnowing.placed(made(spark, corpus)), {"text": "next_text"})
    rows = {r.doc_id: r for r in winnowing.with_fingerprints(docs, {"text": "f"}).withColumn("p", winnowing.positions("f")).withColumn("d", winnowing.digest("f")).collect()}
    grams = winnowing.with_fingerprints(docs, {"text": "f"}, k=k, w=1).withColumn("p", winnowing.positions("f")).collect()
    for r in grams:
        hashes = [x >> winnowing.POSITION_BITS for x in r.f]
        n = len(hashes)
        assert r.p == list(range(n)) and n == (max(1, len(words(r.text)) - k + 1) if words(r.text) else 0)
        want = set()
        for i in range(max(1, n - w + 1)) if n else ():
            window = hashes[i : i + w]
            want.add(max(j for j in range(i, i + len(window)) if hashes[j] == min(window)))
        assert set(rows[r.doc_id].p) == want
    order = sorted(rows)
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        assert rows[a].next_text == (corpus[b] or "")
    assert rows[0].d == rows[90].d and rows[0].d != rows[1].d


def test_next_documents_over_many_buckets(spark, corpus, monkeypatch):
    monkeypatch.setattr(winnowing, "DOCS_PER_BUCKET", 7)
    rows = {r.doc_id: r.next_text for r in winnowing.with_next(winnowing.placed(made(spark, corpus)), {"text": "next_text"}).collect()}
    assert all(rows[i] == (corpus[(i + 1) % len(corpus)] or "") for i in range(len(corpus)))


def test_token_files_round_trip(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    texts = [*corpus, "<|endoftext|>", "x <|endoftext|>", "ab<|endoftext|>cd ef", "long " * 700_000, "a  b", " lead", "trail ", "a \n b", "x <|endoftext|> y", "\n\n z", "don't 12 34a", "日本 語 です", "a\u00a0 b"]
    files = token_files.write_tokens(made(spark, texts).repartition(3), f"file://{tmp_path}/t", token_files.default_tokenizer())
    rows = sorted(token_files.read_tokens(files, with_ids=True).collect())
    start = 0
    for r, text in zip(rows, texts, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert r.ids == ids and r.start == start and r.n_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    one = token_files.TokenFile(files.orderBy("shard", "part").first().path)
    k = len(one.doc_ids) - 1
    assert one.ids(k).tolist() == rows[one.doc_ids[k]].ids
    import zstandard  # an ordinary reader gets the same stream

    raw = open(files.orderBy("shard", "part").first().path.removeprefix("file://"), "rb").read()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read(len(one.ids(0)) * 4) == one.ids(0).tobytes()


def test_token_file_damage_is_seen(spark, tmp_path):
    files = token_files.write_tokens(made(spark, ["some text here to be damaged"] * 3), f"file://{tmp_path}/d", token_files.default_tokenizer())
    path = files.first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[12] ^= 0x55
    open(path, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017 - the frame's own reader or the checksum
        token_files.TokenFile(f"file://{path}").ids(0)


@pytest.mark.parametrize(("block", "fan"), [(1_000_000, 256), (300, 64), (250, 2)])  # the last one over several levels
def test_lm_scores(spark, corpus, monkeypatch, block, fan):
    import math

    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm_scoring, "FAN", fan)
    monkeypatch.setattr("popweave.llm.common.slices.__defaults__", ("text", 2000, 20))
    rows = {r.doc_id: r for r in lm_scoring.scored(made(spark, corpus)).collect()}
    tokens = {i: [*words(t), "\0"] for i, t in enumerate(corpus)}
    part = {i: zlib.crc32(str(i).encode()) % 10 for i in tokens}
    c = Counter(x for i, w in tokens.items() if part[i] for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (part[i] == 0, len(w), sum(x in c for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6 * len(w)
    # the same model by hand
    pairs = lambda ps: Counter((a, b) for i, w in tokens.items() if part[i] in ps for a, b in zip(["\1", *w], w, strict=False))
    bucket = lambda x: min(1 + int(math.log2(x)), 63) if x else 0
    floor = 1 / (v + 1)

    def parts(ps, own):
        uni, bi = Counter(x for i, w in tokens.items() if part[i] in ps for x in w), pairs(ps)
        uni["\1"] = sum(part[i] in ps for i in tokens)
        total = sum(uni.values()) - uni["\1"]
        return [[(uni[b] / total, bucket(total), bi[a, b] / uni[a] if uni[a] else 0.0, bucket(uni[a])) for a, b in zip(["\1", *w], w, strict=False)] for i, w in tokens.items() if own(i)]

    held = [x for t in parts(range(2, 10), lambda i: part[i] == 1) for x in t]
    l1, l2 = [0.5] * 64, [0.5] * 64
    for _ in range(lm_scoring.ROUNDS):
        won, all_ = [[0.0] * 64 for _ in range(2)], [[0.0] * 64 for _ in range(2)]
        for p1, b1, p2, b2 in held:
            low = l1[b1] * p1 + (1 - l1[b1]) * floor
            w2 = l2[b2] if b2 else 0
            top = w2 * p2 + (1 - w2) * low
            r2 = w2 * p2 / top
            won[1][b2] += r2
            all_[1][b2] += 1
            won[0][b1] += (1 - r2) * l1[b1] * p1 / low
            all_[0][b1] += 1 - r2
        for l, w_, a_ in ((l1, won[0], all_[0]), (l2, won[1], all_[1])):
            for b in range(64):
                if a_[b]:
                    l[b] = min(max((w_[b] + 0.5) / (a_[b] + 1), 1e-6), 1 - 1e-6)
    for i, t in enumerate(parts(range(1, 10), lambda i: True)):
        want = 0.0
        for p1, b1, p2, b2 in t:
            w2 = l2[b2] if b2 else 0
            want += math.log10(w2 * p2 + (1 - w2) * (l1[b1] * p1 + (1 - l1[b1]) * floor))
        assert abs(rows[i].score - want) < 1e-4 * max(1, abs(want)), i


def test_toxicity_learns_gapped_insults(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    vocabulary, insults = [word() for _ in range(600)], ["zanker", "quobbit", "wixpal"]
    texts, toxic = [], []
    for i in range(300):
        w = [rng.choice(vocabulary) for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = rng.choice(insults)
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    extra = ["You z.a.n.k.e.r there", "such a quob-bit today", "w i x p a l and more", "Zanxker", "a plain and clean text", ""]
    docs = made(spark, texts + extra)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    model = toxicity.learnt(docs, labels)
    rows = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(rows[i].predicted == toxic[i] for i in held) >= 0.95 * len(held)
    assert [rows[300 + i].predicted for i in range(6)] == [1, 1, 1, 1, 0, 0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())


def _kernel(a, b):
    """By the definition: common subsequences of three characters within the span, decayed in both strings, scaled."""

    def grams(x):
        x = "\2" + x + "\3"
        out = Counter()
        for i, j, k in itertools.combinations(range(len(x)), 3):
            if k - i < toxicity.SPAN:
                out[x[i], x[j], x[k]] += toxicity.DECAY ** (k - i + 1)
        n = len(x)
        gaps = [(j, k) for k in range(2, toxicity.SPAN) for j in range(1, k)]
        norm = sum(max(n - k, 0) * toxicity.DECAY ** (2 * k + 2) for _, k in gaps) ** 0.5
        return {g: v / max(norm, 1e-9**0.5) for g, v in out.items()}

    x, y = grams(a), grams(b)
    return sum(v * y.get(g, 0) for g, v in x.items())


def test_kernel_and_landmarks_against_the_definition():
    rng = random.Random(6)
    word = lambda chars: "".join(rng.choice(chars) for _ in range(rng.randint(1, 9)))
    latin, han = "abcdefghij", [chr(0x4E00 + k) for k in range(300)]
    strings = [word(latin) for _ in range(25)] + [word(han) for _ in range(25)]
    row, feature, value = toxicity.Alphabet(strings).features(strings)
    basis = np.zeros((len(strings), 1 << toxicity.TABLE_BITS), np.float32)
    basis[row, feature] = value
    kernel = basis @ basis.T
    want = np.array([[_kernel(a, b) for b in strings] for a in strings])
    off = np.abs(kernel - want)
    assert off.max() < 0.2 and (off > 1e-5).mean() < 0.02  # about 8 pairs of 4000 subsequences share a hash
    positive, negative = strings[::5], [x for i, x in enumerate(strings) if i % 5]
    model = toxicity._machine(positive, negative, {})
    direct = [sum(a * _kernel(m, x) for a, m in zip(model.alpha, model.marks, strict=True)) + model.bias for x in strings]
    off = np.abs(model.words(strings) - np.array(direct))
    assert np.median(off) < 1e-3 and off.max() < 0.3


def test_margin_holds_for_all_pieces_and_long_words():
    long_ = "".join(chr(0x4E00 + k) for k in range(100))
    assert "".join(x[: toxicity.STRIDE] for x in toxicity.windows_of(long_))[:72] == long_[:72] and toxicity.windows_of(long_)[-1] == long_[-24:]
    p = toxicity.pieces([long_, "abc"])
    assert len(p.begin) == len(toxicity.windows_of(long_)) + 1
    texts = [np.array([0, 1, 2]), np.array([2, 3]), np.array([0, 1]), np.array([3, 4])]
    assert toxicity.witnesses(texts, np.zeros(4)) == [0, 3] and toxicity.witnesses(texts, np.array([2.0, 0, 0, 0])) == [1, 2]


def test_toxicity_in_a_script_without_spaces(spark):
    rng = random.Random(12)
    chars = [chr(0x4E00 + k) for k in range(1100)]
    insults = ["".join(rng.choice(chars) for _ in range(4)) for _ in range(12)]
    texts, toxic = [], []
    for i in range(400):
        t = "".join(rng.choice(chars) for _ in range(60))
        if i % 4 == 0:
            k = rng.randrange(56)
            t = t[:k] + insults[i // 4 % 12] + t[k:]
        texts.append(t)
        toxic.append(int(i % 4 == 0))
    docs = made(spark, texts)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    model = toxicity.learnt(docs, labels)
    assert model is None or {r.predicted for r in toxicity.scored(docs, model).collect()} <= {0, 1}
    spaced = made(spark, [" ".join(t[k : k + 4] for k in range(0, 60, 4)) + " " + insults[i // 4 % 12] * y for i, (t, y) in enumerate(zip(texts, toxic, strict=True))])
    rows = {r.doc_id: r.predicted for r in toxicity.scored(spaced, toxicity.learnt(spaced, labels)).collect()}
    assert sum(rows[i] == y for i, y in enumerate(toxic)) >= 0.97 * len(toxic)


def test_edited_texts(spark, corpus, tmp_path):
    made(spark, corpus).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in winnowing.op10_fingerprints(spark, str(tmp_path)).collect()}
    edited = []
    for i, t in enumerate(corpus):
        t, nxt = t or "", corpus[(i + 1) % len(corpus)] or ""
        cut = len(t) // 4
        edited.append(t[: len(t) - cut] + nxt[:cut])
        assert rows[i].edited_sha256 == hashlib.sha256(edited[-1].encode()).hexdigest()
        assert rows[i].n_chars == len(t)
    # likeness by hand, from the fingerprints of texts and edited texts as documents of their own
    alone = winnowing.with_fingerprints(made(spark, [*corpus, *edited]), {"text": "f"}).withColumn("d", winnowing.digest("f")).collect()
    f = {r.doc_id: {x >> winnowing.POSITION_BITS for x in r.f} for r in alone}
    digests = {r.doc_id: r.d for r in alone}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    n = len(corpus)
    for i in range(n):
        assert rows[i].fingerprint == digests[i] and rows[i].edited_fingerprint == digests[n + i]
        assert abs(rows[i].near_edited - near(f[i], f[n + i])) < 1e-12 and abs(rows[i].near_next - near(f[i], f[(i + 1) % n])) < 1e-12
