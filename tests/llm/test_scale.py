"""Hot groups, equal rows, long keys and order: operators against brute force where one key holds most rows."""

import hashlib
import time
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import chat, licences, mixing, packing, pstable, quality, registry, repeats, simhash, toxicity, warc
from corpusmill.llm.components import components
from corpusmill.llm.registry import tokenizer_path
from corpusmill.operators.blocks import in_blocks
from corpusmill.sources.store import table

DOC = "doc_id bigint, text string, source string"


def words(rng, n, kinds=300):
    return " ".join(f"w{i}" for i in rng.integers(0, kinds, n))


def test_giant_component(spark):
    rng = np.random.default_rng(2)
    star = [(0, k) for k in range(1, 3000)]
    pairs = star + [(int(a) + 5000, int(b) + 5000) for a, b in rng.integers(0, 50, (40, 2))]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert all(got[k] == 0 for k in range(3000)) and all(r >= 5000 for n, r in got.items() if n >= 5000)


@pytest.mark.parametrize("n", [1, 10**6, 10**8, 10**10, 10**12])
def test_exact_keys_lose_no_pair(n):
    picks = simhash.exact_layout(n)
    rng = np.random.default_rng(int(np.log10(n)))
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    b = a.copy()
    for k in range(3):
        b[k * 500 :] ^= np.uint64(1) << rng.integers(0, 64, len(b) - k * 500).astype(np.uint64)
    same = simhash.shard_keys(a[:, None], picks) == simhash.shard_keys(b[:, None], picks)
    assert same.any(axis=1).all()
    bits = min(map(len, picks))
    assert n / 2**bits < 2048 and (bits > 16 or n < 10**8)
    # Keys of different tables never meet.
    assert len({int(k) % len(picks) for k in simhash.shard_keys(a[:5, None], picks).ravel()}) == len(picks)


@pytest.mark.parametrize("n", [10**8, 10**10])
def test_simhash_with_long_keys(spark, monkeypatch, n):
    whole = simhash.exact_layout
    monkeypatch.setattr(simhash, "exact_layout", lambda _, radius: whole(n, radius))
    rng = np.random.default_rng(9)
    rows = []
    for g in range(12):
        w = words(rng, 60).split()
        for c in range(8):
            v = list(w)
            for at in rng.choice(60, c // 3, replace=False):
                v[at] = f"n{g}x{c}"
            rows.append((len(rows), " ".join(v), "s"))
    rows += [(1000 + k, rows[0][1], "s") for k in range(300)]
    docs = spark.createDataFrame(rows, DOC)
    prints = [int.from_bytes(simhash.fingerprints([t.encode()], 3)[0].astype(">u8").tobytes(), "big") for _, t, _ in rows]
    root = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= 3 and root[x] != root[y]:
                lo, hi = sorted((root[x], root[y]))
                root = [lo if r == hi else r for r in root]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=3).collect()}
    assert got == {rows[k][0]: rows[r][0] for k, r in enumerate(root)}


def test_equal_documents_cost_in_proportion(spark):
    rng = np.random.default_rng(1)
    body = words(rng, 250)

    def seconds(n):
        rows = [(7, body, "s")] * n + [(k + 10, words(rng, 100), "s") for k in range(20)]
        docs = spark.createDataFrame(rows, DOC)
        began = time.perf_counter()
        got = repeats.remove_repeats(docs).collect()
        return time.perf_counter() - began, got

    seconds(50)
    few, _ = seconds(500)
    many, got = seconds(2000)
    assert many < 4 * few + 2
    copies = [r for r in got if r.doc_id == 7]
    assert len(copies) == 2000 and all(r.n_removed == r.n_bytes and r.n_spans == 1 for r in copies)
    assert all(r.n_removed == 0 for r in got if r.doc_id != 7)


def test_equal_documents_beside_a_variant(spark):
    """Equal rows share windows with a text that differs elsewhere, whose own windows stay."""
    rng = np.random.default_rng(3)
    a, b, c = words(rng, 80), words(rng, 80), words(rng, 80)
    rows = [(1, f"{a} {b}", "s")] * 5 + [(2, f"{b} {c}", "s"), (3, f"{c}", "s"), (4, words(rng, 90), "s")]
    got = Counter((r.doc_id, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOC)).collect())
    bodies = [t.encode() for _, t, _ in rows]
    n = Counter(x[p : p + 200] for x in bodies for p in range(len(x) - 199))
    want = Counter()
    for (i, _, _), x in zip(rows, bodies, strict=True):
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 199):
            if n[x[p : p + 200]] > 1:
                gone[p : p + 200] = True
        want[i, int(gone.sum())] += 1
    assert got == want


def test_repeats_keep_columns_of_clashing_names(spark):
    rows = spark.createDataFrame([(1, "x y", 5, "e", 9), (2, None, 6, "f", 8)], "doc_id bigint, text string, n_bytes int, extra string, kept int")
    got = repeats.remove_repeats(rows, with_text=True)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_bytes_", "extra", "kept_"]
    assert sorted((r.doc_id, r.n_bytes, r.kept, r.n_bytes_, r.extra, r.kept_) for r in got.collect()) == [(1, 3, "x y", 5, "e", 9), (2, 0, "", 6, "f", 8)]


def test_mixing_splits_one_id(spark):
    """Null ids and one repeated id hold most rows; parts stay small and starts are those of one long sum."""
    rng = np.random.default_rng(4)
    rows = [(None, words(rng, int(n)), "a") for n in rng.integers(1, 9, 300)] + [(5, "x y z", "a")] * 200 + [(k, words(rng, 5), "b") for k in range(100, 140)]
    docs = spark.createDataFrame(rows, DOC)
    small, large = (mixing.mixture(mixing.numbered(docs, F.col("doc_id"), F.col("source")), part_rows=p).collect() for p in (7, 10**6))
    key = lambda r: (r.doc_id or -1, r.source, r.size, r.taken, tuple(r.positions))
    assert Counter(map(key, small)) == Counter(map(key, large))
    order = sorted((r for r in small if r.source == "a"), key=lambda r: (hashlib.md5(b"" if r.doc_id is None else str(r.doc_id).encode()).hexdigest(), r.size, r._tie, r._row))
    start, target = 0, order[0].target
    for r in order:
        if r.positions:
            u = start / target
            assert r.positions[0] == pytest.approx(2 * u / (1.5 + (2.25 - 2 * u) ** 0.5))
        start += r.size
    stream = mixing.mixed_documents(docs)
    assert sum(len(r.text.split()) for r in stream.collect()) == pytest.approx(sum(r.taken for r in small), rel=0.05)


def test_sequences_follow_the_order_given(spark, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_TOKENS", 1 << 13)
    rng = np.random.default_rng(6)
    rows = [(k, words(rng, int(n)), "s") for k, n in enumerate(rng.integers(20, 900, 400))]
    docs = spark.createDataFrame(rows, DOC).orderBy(F.rand(3)).repartition(7)
    got = packing.pack(docs, tokenizer_path(), order=[F.col("doc_id")]).collect()
    first = {}
    for r in got:
        first.setdefault(r.sequence_id, []).append(r.doc_id)
    at = [np.mean(first[s]) for s in sorted(first)]
    assert len(at) > 40 and np.corrcoef(np.arange(len(at)), at)[0, 1] > 0.98
    assert sum(r.length for r in got) == sum(d for d in {r.doc_id: r.doc_tokens for r in got}.values())


def test_step_groups_of_a_query_are_balanced(spark):
    rng = np.random.default_rng(7)
    docs = spark.createDataFrame([(k, words(rng, 700), "s") for k in range(600)], DOC).coalesce(1)
    loads = Counter()
    for r in packing.pack(docs, tokenizer_path(), step_tokens=32 * 4096).collect():
        loads[r.step_group] += r.length
    # A batch's groups are even; only the last batch of a task may be short of a group.
    inner = sorted(loads.values())[1:]
    assert len(loads) > 5 and max(inner) <= 1.5 * 32 * 4096 and min(inner) >= 32 * 4096 / 1.5


def test_one_payload_on_most_pages(spark):
    hot = "<p>" + "same " * 50
    rows = [(k, f"u{k}", hot) for k in range(500, 0, -1)] + [(1000 + k, "u", f"<p>{k}" + "x" * 200) for k in range(50)] + [(2000 + k, "u", None) for k in range(200)] + [(7, "u7", hot)] * 3
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert Counter((r.record_type, r.refers_to) for r in got) == {("response", None): 1 + 50 + 200, ("revisit", 1): 499 + 3}


def test_blocks_of_a_hot_bucket(spark):
    rows = spark.range(1000).select(F.lit(1).cast("bigint").alias("bucket"), F.col("id").alias("node"))
    dealt = in_blocks(rows, ["bucket"], "node", 50)
    assert max(r["count"] for r in dealt.groupBy("block_i", "block_j").count().collect()) < 200


def test_one_vector_many_times(spark):
    rng = np.random.default_rng(3)
    v = [float(x) for x in rng.standard_normal(16)]
    rows = [(k, v) for k in range(400)] + [(1000 + k, [float(x) for x in rng.standard_normal(16)]) for k in range(30)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pstable.embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert all(got[k] == (399, 0) for k in range(400))


def conversation_rows(rng):
    """Threads whose replies quote: whole messages, wrapped anew, single paragraphs, nested, edited, and lines that two messages share."""
    rows, truth = [], {}
    for conv in range(30):
        said = []
        for turn in range(int(rng.integers(3, 14))):
            paragraphs = [f"c{conv}t{turn}p{p} " + words(rng, int(rng.integers(4, 25))) for p in range(int(rng.integers(1, 4)))]
            body, quote = "\n\n".join(paragraphs), ""
            if said and rng.random() < 0.8:
                at = int(rng.integers(0, len(said)))
                how = int(rng.integers(0, 5))
                source = said[at][int(rng.integers(0, len(said[at])))] if how in (1, 2) else "\n\n".join(said[at])
                if how == 1:  # wrapped anew
                    w = source.split()
                    source = "\n".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5))
                if how == 3:  # white space and case changed
                    source = source.upper().replace(" ", "  ")
                quote = "On Monday X wrote:\n" + "\n".join("> " + x for x in source.split("\n")) + "\n"
                if how == 4 and turn > 1:  # nested: an older message at the second level
                    older = int(rng.integers(0, len(said)))
                    quote = "\n".join(">> " + x for x in said[older][0].split("\n")) + "\n" + quote
                truth[conv, turn] = at
            elif rng.random() < 0.2:
                quote = "> nobody ever said this\n"
            rows.append((conv, turn, "user" if turn % 2 else "assistant", quote + body))
            said.append(paragraphs)
    shared = [(100, t, "user", "ok thanks" if t in (0, 2) else "> OK   thanks\nfine") for t in range(6)]
    hot = [(101, t, "user", f"> common line\nmessage {t}" if t else "common line") for t in range(400)]
    odd = [(None, t, "user", "> common line\nx") for t in range(50)] + [(102, None, "user", "> x"), (102, 1, None, None), (102, 1, None, None), (102, 2, "a", ""), (102, 3, "a", "> \n>\n"), (102, 4, "a", "q\n\n" * 2000)]
    return rows + shared + hot + odd, truth


def test_quotations_equal_sql_and_truth(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_BITS", 3)
    monkeypatch.setattr(chat.places, "__defaults__", (20,))
    rows, truth = conversation_rows(np.random.default_rng(11))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("row", F.lit("clash"))
    got = chat.link_quotations(df)
    con = duckdb.connect()
    con.register("conversations", df.drop("row").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    sql = con.execute(registry.ORACLE_SQL["op5_chat"])
    names = [c[0] for c in sql.description]
    assert Counter(map(str, got.select(*names).collect())) == Counter(str(T.Row(**dict(zip(names, r, strict=True)))) for r in sql.fetchall())
    parents = {(r.conv_id, r.turn): r.parent_turn for r in got.collect()}
    assert len(truth) > 120 and all(parents[k] == at for k, at in truth.items())
    assert [parents[100, t] for t in range(6)] == [None, 0, None, 2, 2, 2] and all(parents[101, t] == 0 for t in range(1, 400))
    places = sorted(r.reply_order for r in got.where("conv_id = 101").collect())
    assert places == list(range(1, 401)) and all(r.reply_order is None for r in got.where("conv_id is null").collect())


def test_toxicity_gradient_and_severity():
    rng = np.random.default_rng(5)
    n, v, k = 60, 12, 2
    row, flat, value = rng.integers(0, n, 300), rng.integers(0, v, 300), rng.random(300)
    y, share = rng.integers(0, k + 1, n), rng.random(n) / n
    p = np.concatenate([rng.standard_normal(v), [-0.3, 0.9]])
    _, g = toxicity.likelihood(p, k, flat, value, row, y, share)
    for i in range(len(p)):
        step = np.zeros(len(p))
        step[i] = 1e-6
        up, down = (toxicity.likelihood(p + s, k, flat, value, row, y, share)[0] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-8)
    weights, cuts = {"": 0.1, "bad": 0.7, "bad-": 0.2, "good": -0.5}, [0.2, 1.5]
    text = "Bad badly good Bad " + "x " * 70
    score = 0.1 * np.log(74) + 0.7 * np.log(3) + 0.2 * np.log(4) - 0.5 * np.log(2)
    assert toxicity.expected_severity(toxicity.text_words(text), weights, cuts) == pytest.approx(sum(1 / (1 + np.exp(t - score)) for t in cuts))


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LONGEST_SAMPLED", 400)
    rng = np.random.default_rng(8)
    rows = [(1, words(rng, 20), "s") for _ in range(500)] + [(2, words(rng, 5000), "s"), (3, "calm words", "s"), (4, None, "s")]
    texts, toxic = toxicity.sampled(spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (None, 1)], "doc_id bigint, toxic int"), 100)
    assert len(texts) == 3 and sorted(toxic) == [0, 0, 1]
    got = toxicity.toxicity(spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, 1), (3, 0)], "doc_id bigint, toxic int")).collect()
    assert len(got) == len(rows)


def test_licence_query_equals_brute_force(spark, tmp_path):
    """Every run of words of every document against every template."""
    rng = np.random.default_rng(12)
    templates = [(n, t) for n, t in licences.TEMPLATES if len(t.split()) < 16]
    rows = []
    for k in range(60):
        parts = [words(rng, int(rng.integers(0, 8)))]
        if k % 3:
            w = templates[k % len(templates)][1].split()
            for _ in range(k % 4):
                w[int(rng.integers(0, len(w)))] = "other"
            parts += [" ".join(w), words(rng, int(rng.integers(0, 8)))]
        rows.append((k, rng.choice([" ", "\n", "\n\n"]).join(parts), "s"))
    rows += [rows[1], rows[1], (None, rows[2][1], "s"), (100, None, "s"), (101, "", "s"), (102, words(rng, 60_000) + " Licensed under CC BY 4.0. " + words(rng, 60_000), "s"), (103, "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;", "s"), (104, "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "s")]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    grams = [(n, licences.bigrams(licences.WORD.findall(t.lower()))) for n, t in licences.TEMPLATES]

    def best(text):
        w = licences.WORD.findall((text or "").lower())
        out = {}
        for n, g in grams:
            far = int(len(g) * 1.5) + 3
            for i in range(len(w)):
                for j in range(i + 2, min(len(w), i + far) + 1):
                    r = licences.bigrams(w[i:j])
                    if (d := 2 * len(r & g) / (len(r) + len(g))) >= 0.8:
                        out[n] = max(out.get(n, 0), d)
        return out

    got = registry.op7_licences(spark, str(tmp_path)).collect()
    for r in got:
        if r.doc_id is None or r.doc_id < 100:
            text = rows[2 if r.doc_id is None else r.doc_id][1]
            assert {x.licence: x.dice for x in r.licences} == pytest.approx(best(text)), text
    found = {r.doc_id: [x.licence for x in r.licences] for r in got}
    assert len(got) == len(rows) and found[100] == found[101] == [] and found[102] == ["CC-BY-4.0"]
    assert found[103] == ["Apache-2.0", "MIT"] and found[104] == ["Classpath-exception-2.0", "GPL-2.0-only"]


def test_near_duplicates_recall_by_similarity(spark):
    """Of pairs from similarity 0.8 up nearly all are linked, of pairs below none."""
    rng = np.random.default_rng(21)
    rows, pairs = [], []
    for g in range(150):
        w = [f"g{g}w{i}" for i in range(300)]
        v = list(w)
        for at in np.linspace(3, 296, int(rng.integers(1, 14))).astype(int):
            v[at] = f"new{g}x{at}"
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(w), "s"), (len(rows) + 1, " ".join(v), "s")]
    sets = [{tuple(p[k : k + 5]) for k in range(len(p) - 4)} for p in (r[1].split() for r in rows)]
    similarity = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOC), **corpus_pipeline.NEAR).collect()}
    linked = [got[a] == got[b] for a, b in pairs]
    for lo, hi in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        band = [x for x, s in zip(linked, similarity, strict=True) if lo <= s < hi]
        assert len(band) > 10 and np.mean(band) >= 0.97
    assert not any(x for x, s in zip(linked, similarity, strict=True) if s < 0.8)


@pytest.mark.parametrize("cap", [40, 2048])
def test_search_rows_of_a_group_do_not_grow_with_tables_and_blocks(spark, monkeypatch, cap):
    rng = np.random.default_rng(33)
    w = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(400):
        v = list(w)
        v[int(rng.integers(5, 195))] = f"new{k}"
        rows.append((k, " ".join(v), "s"))
    rows += [(k, words(rng, 60, 3000), "s") for k in range(400, 500)]
    found, links = [], simhash.links

    def counted(*args, **named):
        edges = links(*args, **named)
        found.append(edges.count())
        return edges

    monkeypatch.setattr(simhash, "links", counted)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOC), **corpus_pipeline.NEAR, cap=cap).collect()}
    assert got == {k: 0 if k < 400 else k for k in range(500)}
    assert 399 <= sum(found) < 15 * 400


def test_blocks_of_one_root_do_not_meet(spark):
    rows = spark.createDataFrame([(1, n) for n in range(2003)] + [(2, n) for n in range(3000, 3020)] + [(3, 1)], "bucket bigint, node bigint")
    root_of = spark.createDataFrame([(n, 0 if n < 2000 else n) for n in [*range(2003), *range(3000, 3020)]], "node bigint, root bigint")
    dealt = in_blocks(rows, ["bucket"], "node", 50, root_of).collect()
    groups = {}
    for r in dealt:
        groups.setdefault((r.bucket, r.block_i, r.block_j), set()).add(r.node)
    met = {n: set().union(*(g for (b, _, _), g in groups.items() if b == 1 and n in g)) for n in (2000, 2001, 2002)}
    assert all(m == set(range(2003)) for m in met.values())
    assert groups[2, 0, 0] == set(range(3000, 3020)) and not any(b == 3 for b, _, _ in groups)
    assert len(dealt) < 2003 * 10 and max(map(len, groups.values())) <= 2 * 90


def test_quality_of_very_long_and_repeated_rows(spark):
    rng = np.random.default_rng(13)
    long = words(rng, 40_000, 2000)
    rows = [(1, long, "s"), (1, long, "s"), (2, "x" * 200_000, "s"), (3, "\n" * 5000, "s"), (4, None, "s")]
    got = quality.quality(spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars) for r in got) == {(1, 40_000, len(long.replace(" ", ""))): 2, (2, 1, 200_000): 1, (3, 0, 0): 1, (4, 0, 0): 1}


def pipeline_folder(spark, path, rows, extra=""):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint" + extra).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1 if k % 2 else 0, int(k % 5 == 0)) for k in range(0, 200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_pipeline_against_stages_by_hand(spark, tmp_path):
    rng = np.random.default_rng(17)
    rows = []
    for k in range(300):
        w = words(rng, int(rng.integers(30, 160)), 5000).split()
        if k % 5 == 0:
            w[3:3] = ["zounds", "blight", "vermin"]
        rows.append((k, " ".join(w), "en", f"s{k % 3}", 0))
    passage = words(rng, 80, 5000)
    rows += [(400 + k, f"{words(rng, 40, 5000)} {passage} {words(rng, 40, 5000)}", "en", "s1", 0) for k in range(6)]
    rows += [(500 + k, rows[1][1] if k % 2 else rows[1][1] + " end", "en", "s0", 0) for k in range(40)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (600, "", "en", None, 0), rows[2], rows[2], (601, words(rng, 30_000, 5000), "de", "s2", 0)]
    pipeline_folder(spark, tmp_path, [(*r, f"n{k}", k) for k, r in enumerate(rows)], ", n_bytes string, row int")
    d = str(tmp_path)
    docs = table(spark, d, "documents")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        path = f"{tmp_path}/stage{len(kept)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
    clean, single, cut, mixed = kept
    # Toxicity: those with the words go; clean ones and empty ones stay.
    gone = {r[0] for r in rows} - {r.doc_id for r in clean}
    assert len(gone & set(range(0, 300, 5))) >= 57 and len(gone - set(range(0, 300, 5))) <= 3
    # Near duplicates: one of each group of Jaccard 0.8, of empty texts and of repeated rows.
    sets = {r.doc_id: {tuple(p[i : i + 5]) for i in range(max(len(p) - 4, 1))} if (p := (r.text or "").lower().split()) else set() for r in clean}
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    left = [r.doc_id for r in single]
    assert len(left) == len(set(left)) and all(not alike(sets[a], sets[b]) for n, a in enumerate(left) for b in left[:n])
    assert all(any(alike(sets[r.doc_id], sets[x]) for x in left) for r in clean) and 1 in left and not {500 + k for k in range(40)} & set(left)
    # Repeats: what 200 bytes share goes everywhere, the rest stays as it was.
    bodies = {r.doc_id: (r.text or "").encode() for r in single}
    n = Counter(b[p : p + 200] for b in bodies.values() for p in range(len(b) - 199))
    for r in cut:
        b = bodies[r.doc_id]
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if n[b[p : p + 200]] > 1:
                mask[p : p + 200] = True
        assert r.text.encode() == np.frombuffer(b, np.uint8)[~mask].tobytes() and r.n_chars == len(r.text) and r.n_bytes.startswith("n")
    assert len(cut) == len(single) and sum(400 <= (r.doc_id or 0) < 410 and passage not in r.text for r in cut) == 6
    # Mixing: targets by source in whole documents.
    sizes, taken = Counter(), Counter()
    for r in cut:
        sizes[r.source] += len(r.text.split())
    for r in mixed:
        taken[r.source] += len(r.text.split())
    targets = {r.source: r.target for r in mixing.mix(spark.read.parquet(f"{tmp_path}/stage2")).select("source", "target").distinct().collect()}
    assert all(abs(taken[s] - t) <= max(60, 0.05 * t) or s == "s2" for s, t in targets.items())
    # Packing: sequences rise along the curriculum, and every document of the mix is there.
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert sum(r.length for r in pieces if r.start == 0 and r.length == r.doc_tokens) > 0 and len({r.sequence_id for r in pieces}) > 5
    assert sum(1 for r in pieces if r.start + r.length == r.doc_tokens) == len(mixed)
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).drop("sequence_id", "offset", "tier", "step_group", "start", "length", "ids_crc32").distinct().collect())) == sorted({(r.doc_id, r.doc_tokens) for r in pieces})


def test_packing_follows_the_written_order_whatever_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_TOKENS", 1 << 13)
    rng = np.random.default_rng(23)
    for part, (lo, hi) in enumerate(((0, 10), (10, 300), (300, 320), (320, 700))):
        rows = [(k, words(rng, 60), "s") for k in range(lo, hi)]
        spark.createDataFrame(rows, DOC).coalesce(1).write.parquet(f"{tmp_path}/x{part}")
        (tmp_path / "docs").mkdir(exist_ok=True)
        next((tmp_path / f"x{part}").glob("part-*.parquet")).rename(tmp_path / "docs" / f"part-{part:05d}-abc-c000.snappy.parquet")
    docs = spark.read.parquet(str(tmp_path / "docs"))
    pieces = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append(r.doc_id)
    at = [np.mean(by_sequence[s]) for s in sorted(by_sequence)]
    assert len(at) > 15 and np.corrcoef(np.arange(len(at)), at)[0, 1] > 0.97
    assert corpus_pipeline.written_order(spark.createDataFrame([(1, "a", "s")], DOC)) is None


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline_folder(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
