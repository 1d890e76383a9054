"""Operators against brute force, on small fixtures with nulls, repeats, ties and clashing names."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import chat, licences, mixing, packing, pstable, quality, repeats, simhash, toxicity, warc
from corpusmill.llm.components import components
from corpusmill.llm.registry import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id bigint, text string, source string"
VOCAB = [f"w{i}" for i in range(400)] + ["Élan", "naïve", "漢字", "Áb", "it's", "3.14", "…", "a b", "　x"]


def words(rng, n):
    return " ".join(rng.choice(VOCAB, n))


@pytest.fixture(scope="module")
def texts():
    """Texts with exact and near copies, shared passages, repetition inside, and edge cases."""
    rng = np.random.default_rng(5)
    out = [words(rng, int(n)) for n in rng.integers(1, 300, 60)]
    passage = words(rng, 90)
    out += [words(rng, 40) + " " + passage + " " + words(rng, 30) for _ in range(12)]
    long = words(rng, 400)
    out += [long, long, long.replace("w1 ", "w2 ", 1), long + " end", long.upper()]
    out += [None, "", "   \n\t", "x", "ab " * 400, "a" * 1000, words(rng, 20_000), "\n".join([words(rng, 12)] * 9), "Z\u001cY one two", None, ""]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, f"s{i % 4}" if i % 9 else None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], "s1"), (None, None, None)]
    return spark.createDataFrame(rows, DOC).repartition(5)


def empty(spark, schema=DOC):
    return spark.createDataFrame([], schema)


def reach(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def least_id(ids, roots):
    return [min((ids[j] for j in range(len(ids)) if roots[j] == roots[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7), (1, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    nodes = sorted({x for p in pairs if None not in p and p[0] != p[1] for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    edges = {(at[a], at[b]) for a, b in pairs if b is not None and a != b}
    roots = reach(len(nodes), lambda a, b: (a, b) in edges or (b, a) in edges)
    assert got == {x: nodes[r] for x, r in zip(nodes, roots, strict=True)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_packing_holds_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs.withColumn("start", F.lit("clash")), tokenizer_path(), with_ids=True).collect()
    got, want = Counter(), Counter()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for r in docs.collect():
        want[(r.doc_id, *t.encode(r.text or "", add_special_tokens=False).ids, 2)] += 1
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.start):
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, pieces in by_doc.items():
        if doc_id is not None and doc_id != 3:
            assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
            got[(doc_id, *(x for p in pieces for x in p.ids))] += 1
    assert all(want[k] == n for k, n in got.items())
    assert sum(r.length for r in rows) == sum((len(k) - 1) * n for k, n in want.items())
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(p.length for p in pieces)
        assert [p.offset for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        assert total <= 4096 and total & (total - 1) == 0 and {p.tier for p in pieces} == {total}
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0


def test_step_groups_are_balanced():
    groups = packing.step_groups([4096] * 40 + [512] * 64, 8 * 4096)
    loads = Counter()
    for g, n in zip(groups, [4096] * 40 + [512] * 64, strict=True):
        loads[g] += n
    assert len(loads) == 6 and max(loads.values()) - min(loads.values()) <= 4096


def brute_repeats(bodies, depth):
    n = Counter(b[p : p + depth] for b in bodies for p in range(len(b) - depth + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - depth + 1):
            if n[b[p : p + depth]] > 1:
                gone[p : p + depth] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize(("depth", "anchor", "digit", "group_rows", "stretch"), [(200, 40, 50, 20_000, 400_000), (200, 40, 50, 1, 400_000), (60, 9, 7, 3, 900)])
def test_repeats_equal_brute_force(spark, docs, monkeypatch, depth, anchor, digit, group_rows, stretch):
    rows = docs.collect()
    want = Counter(zip([r.doc_id for r in rows], brute_repeats([(r.text or "").encode() for r in rows], depth), strict=True))
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    got = repeats.remove_repeats(docs.withColumn("span", F.lit(1)), depth, anchor, digit, group_rows).collect()
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_repeats_keep_text_and_columns(docs):
    got = repeats.remove_repeats(docs, with_text=True)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "source"]
    for r in got.collect():
        assert len(r.kept.encode()) <= r.n_bytes - r.n_removed


def brute_fingerprint(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("cap", [2048, 5])
def test_simhash_equals_brute_force(spark, docs, cap):
    rows = docs.collect()
    prints = [brute_fingerprint(r.text, 3) for r in rows]
    roots = reach(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    want = Counter(zip([r.doc_id for r in rows], prints, least_id([r.doc_id for r in rows], roots), strict=True))
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit("clash")), words=3, cap=cap).collect()
    assert Counter((r.doc_id, int.from_bytes(r.fp, "big"), r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_bk_tree_finds_all_within_radius():
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**62, 20)]
    fps = base + [b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (20, 2))]
    tree = simhash.BKTree()
    for i, fp in enumerate(fps):
        tree.add(fp, i)
    for fp in fps[::7]:
        assert sorted(tree.search(fp, 3)) == [i for i, x in enumerate(fps) if (x ^ fp).bit_count() <= 3]


def test_wide_fingerprints_group_copies_of_similarity_above_08(spark):
    rng = np.random.default_rng(8)
    rows, expected = [], {}
    for g in range(30):
        w = words(rng, 300).split()
        for c in range(4):
            v = list(w)
            for at in rng.choice(300, c, replace=False):
                v[at] = f"new{g}x{c}x{at}"
            expected[len(rows)] = 4 * g
            rows.append((len(rows), " ".join(v), "s"))
    docs = spark.createDataFrame(rows, DOC)
    groups = simhash.near_duplicates(docs, words=5, lanes=4, radius=48, similarity=0.8)
    assert {r.doc_id: r.component_id for r in groups.collect()} == expected
    kept = simhash.keep_one(docs, groups)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4 * g for g in range(30)]


@pytest.mark.parametrize("cap", [3, 512])
def test_pipeline_links_are_of_jaccard_08(spark, monkeypatch, cap):
    monkeypatch.setattr(simhash.verified, "__defaults__", (cap,))
    rng = np.random.default_rng(12)
    rows = []
    for _ in range(25):
        w = words(rng, 200).replace("a b", "ab").split()
        for c in (0, 2, 3, 4, 5, 6, 8, 10, 12):  # from 1 to about 0.55
            v = list(w)
            for at in np.linspace(5, 190, c).astype(int):
                v[at] = f"new{len(rows)}x{at}"
            rows.append(" ".join(v))
    rows += [rows[0], rows[0] + " " + " ".join(["same five words come again"] * 200), None, "", "a b c", "A  b c", "a b d", "p q r s t u v w", "p q r s t u v w x"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)] + [(3, rows[3], "s")], DOC)
    sets = [{tuple(p[k : k + 5]) for k in range(max(len(p) - 4, 1))} if (p := WORD.findall((t or "").lower())) else set() for t in rows]
    want = least_id(list(range(len(rows))), reach(len(rows), lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])))
    groups = simhash.near_duplicates(docs, **corpus_pipeline.NEAR)
    assert {r.doc_id: r.component_id for r in groups.collect()} == dict(enumerate(want)) and 25 < len(set(want)) < len(rows) - 25
    assert sorted(r.doc_id for r in simhash.keep_one(docs, groups).collect()) == sorted(set(want))
    assert simhash.near_duplicates(empty(spark), **corpus_pipeline.NEAR).count() == 0


def test_keep_one_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, "a b c", "s"), (None, "p q r s t u", "s"), (5, None, "s"), (6, "", "t")], DOC)
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 5), (True, 0)]


def brute_counts(text):
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {p for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_and_scores(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = docs.collect()
    got = quality.quality(docs.withColumn("n_words", F.lit(0)), labels, buckets=512).collect()
    want = Counter((r.doc_id, *brute_counts(r.text or "")) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.score >= quality.THRESHOLD)
        assert (r.score is None) == (r.n_words == 0)
    # The score against plain sums over the same buckets.
    weights = quality.bucket_weights(docs, labels, 512, 100, quality.PRIOR).first().w
    grams = docs.select("doc_id", quality.let(quality.word_hashes(F.col("text")), lambda h: quality.gram_buckets(h, 512)).alias("g")).collect()
    raw, good = Counter(b for r in grams for b in r.g), Counter(b for r in grams if r.doc_id is not None and (r.doc_id < 40 and r.doc_id % 2 or r.doc_id == 3) for b in r.g)
    share = good.total() / raw.total()
    assert weights == pytest.approx([np.log((good[b] + 10 * share) / (share * (raw[b] + 10))) for b in range(512)])
    scores = {r.doc_id: np.mean([weights[b] for b in r.g]) for r in grams if r.g}
    assert all(r.score == pytest.approx(scores[r.doc_id]) for r in got if r.score is not None and r.doc_id is not None)
    assert quality.quality(empty(spark), labels).count() == 0
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.0, None}


def test_mixing_meets_targets(spark, docs):
    got = mixing.mix(docs.withColumn("rank", F.lit("clash"))).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    weight = {s: w for s, w in zip(sorted(s for s in sizes if s is not None) + [None], itertools.cycle([5, 2, 1]), strict=False)}
    left, share, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        share |= {s: 2 * sizes[s] for s in over} if over else {s: level * weight[s] for s in free}
        free = free - over if over else set()
        left = 1.5 * sum(sizes.values()) - sum(share.values())
    assert target == pytest.approx(share)
    assert all(taken[s] == int(target[s] + 1e-6) for s in sizes)
    first = [r.positions[0] for r in got if r.positions]
    assert first == sorted(first) and all(0 <= p <= 1 for r in got for p in r.positions)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix(docs.where("text is null")).where("taken > 0").count() == 0


def test_mixed_documents_repeat_whole_documents(docs):
    stream = mixing.mixed_documents(docs)
    assert stream.columns == docs.columns
    words_out = sum(len(WORD.findall(r.text or "")) for r in stream.collect())
    words_in = sum(len(WORD.findall(r.text or "")) for r in docs.collect())
    assert words_out == pytest.approx(1.5 * words_in, rel=0.1)


@pytest.mark.parametrize("cap", [2048, 4])
def test_embedding_links_equal_brute_force(spark, cap):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 48))
    v = [*base, *(base[0] + 0.02 * rng.standard_normal((25, 48))), *(base[1:9] + 0.03 * rng.standard_normal((8, 48))), base[0], base[0], 1e-200 * base[3], 1e200 * base[4]]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    ids = list(range(len(rows)))
    unit = np.array([r / np.linalg.norm(r / np.abs(r).max()) / np.abs(r).max() for r in v])
    roots = reach(len(rows), lambda a, b: unit[a] @ unit[b] >= 0.95)
    want = {i: (int((unit @ unit[i] >= 0.95).sum()) - 1, roots[i], roots[i] == i) for i in ids}
    odd = [(100, None), (101, []), (102, [0.0] * 48), (103, [float("nan")] + [1.0] * 47), (104, [None] + [1.0] * 47), (105, [float("inf")] + [1.0] * 47), (106, [1.0, 0.0]), (107, [0.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("node", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pstable.embedding_links(df, cap=cap).collect()}
    assert got == want | {i: (0, i, True) for i, _ in odd}
    assert pstable.embedding_links(df.limit(0)).count() == 0


def test_toxicity_on_held_out_texts(spark):
    rng = np.random.default_rng(4)
    bad = ["zounds", "blight", "vermin"]
    rows, labels = [], []
    for i in range(600):
        w = words(rng, int(rng.integers(30, 200))).split()
        toxic = i % 3 == 0
        if toxic:
            for b in rng.choice(bad, 3):
                w.insert(int(rng.integers(0, len(w))), b + rng.choice(["", "ly", "ish", "!"]))
        rows.append((i, " ".join(w), "s"))
        if i < 300:
            labels.append((i, int(toxic)))
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "zounds blights vermin zounds", "s")]
    docs = spark.createDataFrame(rows, DOC)
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs.withColumn("row", F.lit(1)), known).collect()}
    wrong = sum(got[i].toxic != (i % 3 == 0) for i in range(300, 600))
    assert wrong <= 6 and got[None].toxic and not got[1000].toxic and not got[1001].toxic
    assert all(0 <= r.severity <= 2 for r in got.values())
    assert toxicity.toxicity(empty(spark), known).count() == 0
    assert toxicity.toxicity(docs, known.limit(0)).where("toxic").count() == 0


def test_licences(spark):
    plain = "one two three four five six seven eight"
    rows = [(1, f"{plain}\nReleased under the MIT License.\n{plain}", "s"), (2, "licensed  under the APACHE license version 2.0", "s"), (3, plain, "s"), (4, None, "s"), (5, "", "s"), (6, "All rights reserved.\nAll rights reserved", "s"), (7, "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "s"), (None, "Licensed under CC BY-NC 4.0.", "s")]
    got = {r.doc_id: (r.best_licence, r.n_licences) for r in licences.scan_licences(spark.createDataFrame(rows, DOC).withColumn("licences", F.lit(0))).collect()}
    assert got == {1: ("MIT", 1), 2: ("Apache-2.0", 1), 3: (None, 0), 4: (None, 0), 5: (None, 0), 6: ("all-rights-reserved", 1), 7: ("ISC", 1), None: ("CC-BY-NC-4.0", 1)}
    assert licences.scan_licences(empty(spark)).count() == 0


def test_licences_inside_other_words():
    m, plain = licences.Matcher(licences.TEMPLATES, 0.8), "one two three four five six seven eight nine ten " * 30
    for notice, name in (("Copyright 2020 Foo. Licensed under the MIT License.", "MIT"), ("Copyright (c) 2020 Foo. All rights reserved.", "all-rights-reserved"), ("Except where noted, this text is licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), *((t, n) for n, t in licences.TEMPLATES)):
        for text in (notice, f"{plain} {notice} {plain}", f"{plain}\n{plain} {notice.replace(' ', chr(10), 3)} {plain}"):
            assert dict(m.scan(text)).get(name) == 1, (name, text)
    assert {"BSD-2-Clause", "BSD-3-Clause"} <= {n for n, _ in m.scan(licences.BSD + licences.BSD_NAMES + licences.BSD_AS_IS)}
    rng, small = np.random.default_rng(4), licences.Matcher((("A", "a b c d e"), ("B", "b c b d"), ("C", "e a")), 0.8)
    for _ in range(60):
        w = list(rng.choice(list("abcdefg"), int(rng.integers(2, 25))))
        runs = [licences.bigrams(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1)]
        want = {n: d for n, g in zip(small.names, small.grams, strict=True) if (d := max(2 * len(g & r) / (len(g) + len(r)) for r in runs)) >= 0.8}
        assert dict(small.scan(" ".join(w))) == want
    assert m.scan(plain) == []


def test_whole_licences():
    """Whole texts are found as they are, among other words and with some words changed; runs passed by lose nothing."""
    whole, rng = dict(licences.whole_texts()), np.random.default_rng(8)
    m, long = licences.Matcher(licences.TEMPLATES + licences.whole_texts(), 0.8), licences.Matcher(licences.whole_texts(), 0.8)
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"} <= set(whole)
    for name, text in whole.items():
        assert dict(m.scan(f"{words(rng, 300)} {text} {words(rng, 300)}"))[name] == 1
        w = licences.WORD.findall(text.lower())
        for at in rng.choice(len(w), len(w) // 40, replace=False):
            w[at] = f"w{at}"
        got = dict(long.scan("\n".join([words(rng, 300), " ".join(w), words(rng, 300)])))
        assert 0.8 <= got[name] < 1
    assert m.scan(words(rng, 200_000)) == []
    for _ in range(150):
        small = licences.Matcher(tuple((x, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 14))))) for x in "ABCD"), 0.8)
        w = list(rng.choice(list("abcdefgh"), int(rng.integers(2, 45))))
        runs = [licences.bigrams(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1)]
        want = {n: d for n, g in zip(small.names, small.grams, strict=True) if (d := max(2 * len(g & r) / (len(g) + len(r)) for r in runs)) >= 0.8}
        assert dict(small.scan(" ".join(w))) == want


def test_licence_size_bounds_lose_nothing():
    rng = np.random.default_rng(6)
    m = licences.Matcher(licences.TEMPLATES, 0.8)
    grams = [(n, licences.bigrams(licences.WORD.findall(t.lower()))) for n, t in licences.TEMPLATES]
    for _, t in licences.TEMPLATES:
        for _ in range(20):
            w = licences.WORD.findall(t.lower())
            for _ in range(int(rng.integers(0, 4))):
                w.insert(int(rng.integers(0, len(w) + 1)), "x")
            mine = licences.bigrams(w)
            best = max(2 * len(mine & g) / (len(mine) + len(g)) for _, g in grams)
            assert (m.best(w) or (0,))[0] == (best if best >= 0.8 else 0)


def test_warc_round_trip(spark):
    big, same = "<p>" + "x y " * 5000, "<html>" + "same " * 40
    rows = [(9, "http://a/1", same), (4, "http://a/2", same), (7, None, same), (1, "http://a b/3", "tiny"), (2, "u", "tiny"), (3, "u", None), (5, "u", ""), (6, "u", big), (8, "u", "é" * 50), (10, "u", "é" * 50), (4, "u", same), (None, "u", same), (None, "u", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "").encode() == b and j is not None), default=None)
        revisit = len(b) >= 100 and i != first
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None)] += 1
    got = warc.round_trip(pages).collect()
    assert Counter(map(tuple, got)) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_archive_format(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html>{'text ' * 50}{i}" + "<p>more</p>" * (i % 7)) for i in range(400)], "page_id bigint, url string, html string")
    d = warc.train_dictionary(pages)
    assert d
    listed = warc.write_archives(pages, f"file://{tmp_path}", d, archive_bytes=4000)
    assert listed.count() > 1 and sum(r.records for r in listed.collect()) == 400
    found = warc.archives_in(spark, f"file://{tmp_path}")
    assert {r.path.removeprefix("file:").lstrip("/") for r in found.collect()} == {r.path.removeprefix("file:").lstrip("/") for r in listed.collect()}
    back = {r.page_id: (r.url, r.payload.decode()) for r in warc.read_archives(found, with_payload=True).collect()}
    assert back == {r.page_id: (r.url, r.html) for r in pages.collect()}
    raw = next(tmp_path.glob("*.warc.zst")).read_bytes()
    assert raw[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18])

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[: min(n, 1000)], self.data[min(n, 1000) :]
            return out

    records = list(warc.read_records(Stream(raw)))
    for bad in (records[0].replace(b"WARC/1.1", b"WARC/9"), records[0][:-2], records[0].replace(b"text text", b"texT text", 1), records[0].replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(Stream(raw[:-5])))


def test_chat_links_quotations(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nI tried twice."), (1, 1, "assistant", "Use the sort function."), (1, 2, "user", "On Monday A wrote:\n> how do  I sort?\n> I tried TWICE.\nStill stuck here"),
        (1, 3, "user", "> Use the sort function.\nThanks!"), (1, 4, "user", ">> use the sort function.\n> Thanks!\nMe too"), (1, 5, "user", "> nobody said this\nok"),
        (2, 0, "user", "> Use the sort function.\nother conversation"), (2, 1, "user", None), (2, 2, "user", ""), (None, 0, "user", "> Thanks!"), (3, None, "user", "> x"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 1, "user", "> same\nyes"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("key", F.lit(0))
    got = chat.link_quotations(df).collect()
    links = {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.depth) for r in got}
    assert links[1, 2] == (0, 0, 1) and links[1, 3] == (1, 1, 1) and links[1, 4] == (3, 1, 2) and links[1, 5] == (None, 5, 0)
    assert links[2, 0] == (None, 0, 0) and links[4, 1] == (0, 0, 1) and len(got) == len(rows)
    body = {(r.conv_id, r.turn): r.body for r in got}
    assert body[1, 2] == "Still stuck here" and body[1, 4] == "Me too" and body[2, 1] == "" == body[2, 2]
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.reply_order)]
    assert order == [0, 2, 1, 3, 4, 5]
    assert {r.turn: r.n_passages for r in got if r.conv_id == 1} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 1}
    assert chat.link_quotations(df.limit(0)).count() == 0
