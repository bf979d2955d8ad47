"""Operators that compare documents or vectors with each other, against brute force."""

import hashlib
import math
import os
import pickle
import random

import numpy as np
import pytest

import corpus_pipeline
from phasegrid import session
from phasegrid.llm import covertree, decontaminate, neardup, phrases
from phasegrid.llm.graph import components


def same_rows(got, expected):
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def made_texts(seed=1, n=60):
    """Texts with exact copies, near copies, shared passages and inner repeats."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    shared = [[word() for _ in range(60)] for _ in range(3)]
    texts = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([3, 12, 25, 80, 200]))]
        if i % 4 == 1:
            at = rng.randrange(len(words))
            words[at:at] = rng.choice(shared)[: rng.choice([19, 20, 45, 60])]
        if i % 5 == 2 and texts:
            words = texts[-1].split()
            words[rng.randrange(len(words))] = word()
        if i % 7 == 3:
            words = words + words[:30]
        texts.append(rng.choice([" ", "\n"]).join(words) if i % 9 else (texts[-1] if texts else ""))
    return list(enumerate([*texts, "x " * 70, None, "", "Five little WORDS are here", "five LITTLE words are here"]))


# repeated phrases

def plain_phrases(rows):
    seen, out = {}, []
    listed = sorted((i, (t or "").encode().split()) for i, t in rows)
    for i, w in listed:
        for k in range(len(w) - 19):
            seen.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, w in listed:
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if seen[tuple(w[k : k + 20])] < (i, k):
                gone[k : k + 20] = [True] * 20
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_equal_brute_force(docs, seed, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_PASSAGES", 5)
    rows = made_texts(seed)
    same_rows(phrases.remove_repeats(docs(rows)).collect(), plain_phrases(rows))


def test_phrases_odd_cases(odd):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in phrases.remove_repeats(odd).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[4] == (30000, 29999) and got[None] == (4, 0)
    assert phrases.remove_repeats(odd.where("false")).count() == 0
    kept = phrases.remove_repeats(odd.where("doc_id = 4"), kept=True).first()["kept_text"]
    assert kept == "word"


def test_texts_that_share_an_id_lose_their_own_words(docs):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"a b {passage}"), (1, f"{passage} c"), (1, f"{passage} c"), (2, f"x {passage} " + "y " * 40), (2, "short text"), (None, f"n {passage}")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in phrases.remove_repeats(docs(rows, 1)).collect()), key=repr)
    assert {g for g in got if g[0] != 1} == {(2, 71, 30 + 39), (2, 2, 0), (None, 31, 0)}
    assert [g for g in got if g[0] == 1] in ([(1, 31, 0), (1, 31, 0), (1, 32, 30)], [(1, 31, 30), (1, 31, 30), (1, 32, 0)])


# near duplicates

def plain_near(rows):
    sets = {}
    for i, t in rows:
        w = neardup.text_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [(i, len(s), label[i], label[i] == i) for i, s in sets.items()]


def test_near_duplicates_equal_brute_force(docs):
    rows = made_texts(3, 80)
    same_rows(neardup.near_duplicates(docs(rows)).collect(), plain_near(rows))


def template_cluster(n=160, shared=262, own=40):
    """Pages on one template just under the threshold, of which each of the second half but a few has a true pair."""
    word = lambda *x: hashlib.md5(repr(x).encode()).hexdigest()[:8]
    pages = []
    for i in range(n):
        twin, page = i % (n // 2), [word("t", k) for k in range(shared)]
        page += [word("o", twin if twin % 8 else i, k) for k in range(own + twin % 5)]
        page[3 * (i % 50)] = word("x", i)
        pages.append(" ".join(page))
    return list(enumerate(pages))


def test_near_pairs_of_a_template_cluster(docs):
    rows = template_cluster()
    expected = plain_near(rows)
    assert sum(own for *_, own in expected) > 80
    same_rows(neardup.near_duplicates(docs(rows)).collect(), expected)


def test_prefix_pairs_lose_no_pair(docs):
    rows = [(i, t) for i, t in made_texts(9, 60) if t]
    frame = docs(rows)
    got = {tuple(r) for r in neardup.prefix_pairs(frame.selectExpr("doc_id as rep", "doc_id as component"), frame.select("doc_id", "text")).collect()}
    sets = {i: set(neardup.shingle_set(np.array([hash(w) & (2**64 - 1) for w in neardup.text_words(t)], np.uint64)).tolist()) for i, t in rows}
    assert got >= {(a, b) for a in sets for b in sets if a < b and sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}


def test_near_duplicates_odd_cases(odd):
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd).collect()]
    assert len(got) == 11 and (None, None, True) in got and got.count((6, 5, False)) == 2 and (1, 1, True) in got
    assert neardup.near_duplicates(odd.where("false")).count() == 0


def test_sketch_agreement_follows_similarity():
    rng = np.random.default_rng(5)
    for size, share in ((400, 0.75), (400, 0.9), (9, 0.8)):
        found = []
        for _ in range(60):
            both = rng.integers(0, 1 << 62, size).astype(np.uint64)
            more = round(size * (1 - share) / share / 2)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 62, more).astype(np.uint64)])) for _ in "ab")
            found.append((neardup.sketch(a) == neardup.sketch(b)).mean())
        assert np.mean(found) == pytest.approx(size / (size + 2 * round(size * (1 - share) / share / 2)), abs=0.05)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


# cover tree

def plain_links(rows, least=0.9):
    ok = {k: v for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    width = max(map(len, ok.values()), default=1)
    vec = {k: np.array([*v, *[0.0] * (width - len(v))]) for k, v in ok.items()}
    links = {k: [m for m in vec if m != k and vec[k] @ vec[m] / np.linalg.norm(vec[k]) / np.linalg.norm(vec[m]) >= least] for k in vec}
    label = {k: i for k, (i, _) in enumerate(rows)}
    for _ in rows:
        for k, near in links.items():
            for m in near:
                label[k] = label[m] = min(label[k], label[m])
    return [(i, len(links.get(k, [])), label[k], i is None or label[k] == i) for k, (i, _) in enumerate(rows)]


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF_ROWS", 4)
    monkeypatch.setattr(covertree, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.5]))]) for i in range(150)]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None]), (204, [float("nan")] * 8), (205, [float("inf")] * 8), (None, [1.0] * 8), (206, [1.0]), (207, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rep", "2 as v", "3 as leaf")
    same_rows(covertree.near_pairs(frame).collect(), plain_links(rows))
    assert covertree.near_pairs(frame.where("false")).count() == 0


def brute_links(ids, vectors, least=0.9):
    """(id, links, component) of usable vectors by one product."""
    units = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hit = units @ units.T >= least
    np.fill_diagonal(hit, False)
    label = np.array(ids)
    while True:
        low = np.minimum(label, np.where(hit, label[None, :], label[:, None]).min(axis=1))
        if (low == label).all():
            return list(zip(ids, hit.sum(axis=1).tolist(), label.tolist()))
        label = low


def spread_and_grouped(n=2048, width=64, seed=6):
    """Evenly spread vectors, among them a chain, a dense group, pairs of near copies and exact copies."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, width))
    vectors[100:400] = vectors[100] + 0.1 * rng.normal(size=(300, width))
    vectors[500:700:2] = vectors[501:701:2] + 0.3 * rng.normal(size=(100, width))
    for k in range(800, 860):
        vectors[k] = vectors[k - 1] + 0.4 * rng.normal(size=width)
    vectors[900:910] = vectors[899]
    return [int(i) for i in rng.permutation(n)], vectors.astype(np.float32)


def bytes_on_disk(spark):
    """Of shuffle files and of what the application stores."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size())) + sum(
        os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(session._own_folder(spark)) for f in names
    )


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_that_nothing_prunes_are_moved_once(spark, monkeypatch, kind):
    monkeypatch.setattr(covertree, "BLOCK_ROWS", 32)
    ids, vectors = spread_and_grouped()
    monkeypatch.setattr(covertree, "PANEL_BYTES", vectors.nbytes // 4, raising=False)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], f"vec_id long, embedding array<{kind}>")
    began, seen, keep = bytes_on_disk(spark), [], covertree.stored

    def watched(*args):
        out = keep(*args)
        seen.append(bytes_on_disk(spark) - began)
        return out

    monkeypatch.setattr(covertree, "stored", watched)
    got = covertree.near_pairs(frame).collect()
    same_rows([tuple(r)[:3] for r in got], brute_links(ids, vectors))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert max(seen) < 20 * vectors.nbytes  # every pair of blocks together would be 128 times that


def test_blocks_compared_in_one_process_equal_brute_force(monkeypatch):
    monkeypatch.setattr(covertree, "STRIP_ROWS", 32)
    monkeypatch.setattr(covertree, "WAITING_LINKS", 500)
    ids, vectors = spread_and_grouped(1200, 48)
    rng = np.random.default_rng(8)
    vectors[600:1200] = np.float32(np.eye(48)[rng.integers(0, 4, 600)] + 0.03 * rng.normal(size=(600, 48)))
    basis = covertree.head_basis(covertree.unit(vectors), 0.9)
    packed = []
    for k in range(4):
        own = slice(300 * k, 300 * k + 300)
        order, tree = covertree.lower_tree(covertree.unit(vectors[own]))
        packed.append({
            "number": k, "leaf": 0, "ids": np.array(ids[own])[order].tobytes(), "copies": np.ones(300, np.int64).tobytes(),
            "points": vectors[own][order].tobytes(), "tree": pickle.dumps(tree),
        })
    assert basis is not None and len(covertree.leaves_of(tree)) == 4
    counts, edges = dict.fromkeys(ids, 0), []
    for held in (packed[:2], packed[2:]):
        panel = covertree.Blocks(held, 48, "float32", basis).prepare()
        found = covertree.Links(panel)
        for row in packed[held[0]["number"] :]:
            block = covertree.Blocks([row], 48, "float32", basis).prepare()
            covertree.compare(found, block, panel, np.array([0]), panel.toward(block), 0.9)
        for i, n, near in zip(*(x.tolist() for x in found.result())):
            counts[i] += n
            edges.append((i, near))
    label = covertree.least_labels(max(ids) + 1, *np.array(edges).T)
    assert [(i, counts[i], int(label[i])) for i in ids] == brute_links(ids, vectors)


def test_dual_traversal_prunes_far_leaves():
    rng = np.random.default_rng(3)
    centres = np.eye(16)
    points = np.repeat(centres, 100, axis=0) + rng.normal(size=(1600, 16)) * 0.01
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    root, leaves = covertree.build(points)
    pairs = covertree.dual_traversal(root, root, 0.447)
    assert len(leaves) == 16 and sorted(pairs) == [(i, i) for i in range(16)]


# decontamination

ITEMS = [(1, "What is the tallest mountain on the whole wide earth today\nmount everest it surely is"), (2, "one two three four five six seven eight nine ten eleven twelve"), (3, None), (4, ""), (5, "lonely")]


def test_leaks_are_found_and_clean_texts_left(spark, docs):
    filler = " ".join(f"w{i}" for i in range(300))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [
        (1, f"{filler} WHAT is the tallest mountain, on the whole wide earth today: Mount Everest it surely is {filler}"),
        (2, f"{filler} what is the tallest mountain on the whole wide earth today {filler}"),
        (3, filler), (4, None), (5, ""), (6, "one two three four five six seven eight nine ten eleven twelve"), (7, f"{filler} is the of on"),
    ]
    got = decontaminate.find_leaks(docs(rows), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (6, 2)}
    assert all(r["score"] > 0.99 for r in got)
    assert decontaminate.find_leaks(docs(rows), items.where("false")).count() == 0
    assert decontaminate.find_leaks(docs(rows).where("false"), items).count() == 0


@pytest.mark.parametrize("size", [65, 150, 300, 1000])
def test_long_items_are_found(spark, docs, size, monkeypatch):
    rng = random.Random(size)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    long = [(i, f"{words(size - 5)}\n{words(5)}") for i in range(3)]
    items = spark.createDataFrame([*long, *ITEMS[1:2]], "item_id long, text string")
    half = " ".join(long[2][1].split()[: size // 4])
    rows = [(10, f"{words(37)} {long[0][1]} {words(900)}"), (11, f"{words(500)} {long[1][1]}"), (12, f"{words(90)} {half} {words(300)}"), (13, words(2000))]
    for part in (1024, 5):
        monkeypatch.setattr(decontaminate, "PART_ITEMS", part)
        got = decontaminate.find_leaks(docs(rows), items).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(10, 0), (11, 1)]
        assert all(0.9 < r["score"] < 1.001 and r["question_share"] == r["answer_share"] == 1 for r in got)


def test_index_parts_give_the_same(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(6, ITEMS[1][1]), (7, ITEMS[0][1])]
    monkeypatch.setattr(decontaminate, "PART_ITEMS", 1)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(rows), items).collect()} == {(6, 2), (7, 1)}


def test_wand_equals_scoring_every_item():
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 12)))) for i in range(120)]
    words = [decontaminate.item_words(t) for _, t in items]
    frequency = {}
    for w in words:
        for t in set(w):
            frequency[t] = frequency.get(t, 0) + 1
    index = decontaminate.build_index(items, len(items), frequency, sum(map(len, words)) / len(words))
    for _ in range(200):
        terms = [t for t in {v.encode() for v in rng.choices(vocabulary, k=8)} if t in index.postings]
        for least in (0.2, 0.5, 0.8):
            scores = {}
            for t in terms:
                for o, w in zip(*index.postings[t]):
                    scores[o] = scores.get(o, 0.0) + w
            expected = {o for o, s in scores.items() if s >= least - 1e-9}
            assert {o for o, _ in decontaminate.search(index, terms, least)} == expected
            assert {o for o, _ in decontaminate.search(index, terms, least, 30, 70)} == {o for o in expected if 30 <= o < 70}


# pipeline

def test_leaking_rows_without_id_are_taken_out(spark, docs, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, ITEMS[1][1]), (None, "a clean text without id"), (None, None), (1, ITEMS[1][1]), (2, "a clean text")]
    got = corpus_pipeline.without_benchmark(spark, docs(rows), str(tmp_path)).collect()
    same_rows([(r["doc_id"], r["text"]) for r in got], [rows[1], rows[2], rows[4]])


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(900001, None, "en", "s", 0), (900002, "123 !!", "en", "s", 6), (900003, "the token = abcdef0123456789abcdef01 of the and that is in the house of", "en", "s", 1)], docs.schema)
    kept = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, data).cache()
        assert out.schema.names == docs.schema.names, name
        before, after = ({r["doc_id"]: r["text"] for r in f.collect()} for f in (kept, out))
        assert set(after) <= set(before)
        if name == "language_id":
            assert set(before) - set(after) == {900001, 900002}
        if name == "minhash_near_dedup":
            assert set(after) == {i for i, _, label, own in plain_near(list(before.items())) if own}
        if name == "benchmark_decontamination":
            items = [b" " + b" ".join(decontaminate.item_words(r["text"])) + b" " for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            assert set(before) - set(after) == {i for i, t in before.items() if any(x in b" " + b" ".join(decontaminate.item_words(t)) + b" " for x in items)}
        if name == "secret_scan":
            assert set(after) == set(before) and "abcdef0123456789" not in after[900003] and "[secret]" in after[900003]
        kept = out
    assert corpus_pipeline.STAGES[-1][1](spark, kept, data).count() == len(after)


def test_texts_that_share_an_id_stay_in_the_pipeline(spark, docs):
    one, other = "words of one text that stand here for the test of ids", "quite different sentences under the same number of a row"
    rows = docs([(1, one), (1, other), (1, other), (2, one), (3, "a third text with its own words and id for the table")])
    kept = corpus_pipeline.one_of_each_group(spark, rows.select("doc_id", "text", "lang", "source", "n_chars"), "")
    got = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    assert [g for g in got if g[0] == 1] == sorted([(1, one), (1, other)]) and got[-1][0] == 3
