import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from iontide.llm import embedding_dedup, jaccard_join
from iontide.llm.components import components

from .conftest import WORDS


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected(rows):
    """class_id, n_links and n_copies of each (doc_id, text), by all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    least = {}
    for i, s in sets:
        if s:
            least[s] = min(i, least.get(s, i))
    distinct = list(least)
    near = {s: [t for t in distinct if t is not s and 5 * len(s & t) >= 4 * len(s | t)] for s in distinct}
    label = {}
    for s in sorted(distinct, key=least.get):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = least[s]
                todo += near[x]
    out = []
    for i, t in rows:
        s = shingle_set(t)
        out.append((i, label[s], len(near[s]), sum(u == s for _, u in sets) - 1) if s and i is not None else (i, i, 0, 0))
    return sorted(out, key=str)


def variants(seed, groups, copies):
    draw = random.Random(seed)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    rows = []
    for _ in range(groups):
        words = draw.choices(vocabulary, k=80)
        rows.append(" ".join(words))
        for _ in range(copies):
            own = list(words)
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(80)] = draw.choice(vocabulary)
            rows.append(" ".join(own))
    return list(enumerate(rows))


def joined(spark, rows, **options):
    out = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    return sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in out), key=str)


def test_join_against_all_pairs(spark, texts):
    rows = variants(0, 25, 5) + [(1000 + i, t) for i, t in enumerate(texts)] + [(None, "one two three four five six"), (3000, "One  two three"), (3001, "one two\nthree")]
    rows += [rows[3], rows[4]]
    assert joined(spark, rows, target=0.9999) == expected(rows)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    monkeypatch.setattr(jaccard_join, "SMALL", 5)
    monkeypatch.setattr(jaccard_join, "PART", 10)
    rows = variants(1, 2, 40)
    assert joined(spark, rows, target=0.9999) == expected(rows)


def test_sparse_large_buckets_go_on_to_the_last_depth(spark, monkeypatch):
    """Texts that share most of a passage but aren't near copies, with near copies among them."""
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    monkeypatch.setattr(jaccard_join, "PART", 8)
    draw = random.Random(8)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    passage = draw.choices(vocabulary, k=60)
    texts = [passage + draw.choices(vocabulary, k=40) for _ in range(60)]
    texts += [t[:-1] + ["x"] for t in texts[:20]]
    rows = list(enumerate(" ".join(t) for t in texts))
    found = joined(spark, rows, target=0.9999)
    assert found == expected(rows) and sum(r[2] for r in found) == 40


def test_recall_against_all_pairs_at_the_default_target(spark):
    """1,200 pairs of texts with similarities from 0.8 to 0.85, each text of 200 words and 20 or so changed."""
    draw = random.Random(6)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    rows, links = [], 0
    for i in range(1200):
        words = draw.choices(vocabulary, k=200)
        other = list(words)
        at = draw.randrange(150)
        other[at : at + draw.randint(13, 18)] = draw.choices(vocabulary, k=15)
        sets = [shingle_set(" ".join(t)) for t in (words, other)]
        similar = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        links += similar >= 0.8
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        assert 0.7 < similar < 0.9
    found = sum(r[2] for r in joined(spark, rows)) // 2
    assert links > 600 and 0.98 * links <= found <= links


def test_texts_of_two_letters_that_many_hashes_confuse(spark):
    letters = lambda n, first: "".join("ab"[(bin(i).count("1") + first) % 2] for i in range(n))
    rows = [(i, " ".join([letters(2048, i), "b", "c", "d", "e"])) for i in range(2)]
    assert joined(spark, rows) == [(0, 0, 0, 0), (1, 1, 0, 0)]


def test_pairs_at_the_threshold_meet_with_the_target_at_the_last_depth():
    """Planted pairs of similarity 0.8 and more and the production's runs and depths, as in buckets that stay large."""
    draw, runs = np.random.default_rng(2), jaccard_join.runs_for()
    assert jaccard_join.recall(runs) >= jaccard_join.TARGET > jaccard_join.recall(runs - 1)
    start = np.repeat(jaccard_join.A.mix(np.arange(1, runs + 1, dtype=np.uint64)), 2)
    for common in (160, 165):  # of 180
        met = []
        for _ in range(700):
            keys = draw.integers(0, 1 << 63, 360 - common, dtype=np.uint64)
            pair = np.concatenate((keys[:180], keys[-180:]))
            tokens = jaccard_join.sketches(pair, np.array([180, 180]))
            nodes, rows = start, np.tile(np.arange(2), runs)
            for above, depth, follow in zip((0, *jaccard_join.DEPTHS), jaccard_join.DEPTHS, jaccard_join.FOLLOW):
                nodes, rows = jaccard_join.descend(nodes, rows, tokens, depth - above, follow)
            met.append(bool(np.intersect1d(nodes[rows == 0], nodes[rows == 1]).size))
        assert np.mean(met) >= jaccard_join.TARGET - 0.008, (common, np.mean(met))


def test_density_of_buckets(spark):
    draw = np.random.default_rng(4)
    base, rows, means = draw.integers(0, 1 << 32, (1, jaccard_join.TOKENS), dtype=np.uint64), [], {}
    for bucket, keep in ((1, 0.95), (2, 0.8), (3, 0.3)):
        tokens = np.where(draw.random((200, jaccard_join.TOKENS)) < keep, base, draw.integers(0, 1 << 32, (200, jaccard_join.TOKENS), dtype=np.uint64)).astype(np.uint32)
        means[bucket] = np.mean([(tokens[i] == tokens[j]).mean() for i in range(60) for j in range(i)])
        rows += [(bucket, 200, int(b)) for b in jaccard_join.low_bits(tokens)]
    dense = {r.bucket for r in jaccard_join._dense(spark.createDataFrame(rows, "bucket long, members long, bits long")).collect()}
    assert dense == {1, 2} == {b for b, m in means.items() if m > jaccard_join.DENSE}


def test_candidates_are_all_close_pairs():
    draw = np.random.default_rng(3)
    tokens = np.repeat(draw.integers(0, 99, (40, jaccard_join.TOKENS)), 3, 0)
    tokens[draw.random(tokens.shape) < 0.15] = 7
    order = draw.permutation(120)
    task, side = np.sort(draw.integers(0, 5, 120)), np.full(120, 2)
    side[task == 3] = draw.integers(0, 2, (task == 3).sum())
    tokens = tokens[order].astype(np.uint32)
    label = draw.integers(0, 60, 120)
    close = lambda i, j: label[i] != label[j] and task[i] == task[j] and (side[i] == 2 or side[i] != side[j]) and (tokens[i] == tokens[j]).sum() >= jaccard_join.CLOSE
    expected = {(i, j) for j in range(120) for i in range(j) if close(i, j)}
    for most in (1, 50, 1 << 18):
        assert set(zip(*map(np.ndarray.tolist, jaccard_join.candidates(tokens, task, side, label, most)))) == expected != set()


def test_a_large_cluster_with_few_others_is_dealt_once(spark, monkeypatch):
    """After the first runs, rows for the comparisons of one cluster with a few sets grow with the cluster, not with its square."""
    monkeypatch.setattr(jaccard_join, "PART", 60)
    draw, deal, dealt = np.random.default_rng(6), jaccard_join._tasks, []
    base = draw.integers(0, 1 << 32, jaccard_join.TOKENS)
    keep = np.where(np.arange(300) < 290, 0.95, 0.5)[:, None]
    tokens = np.where(draw.random((300, jaccard_join.TOKENS)) < keep, base, draw.integers(0, 1 << 32, (300, jaccard_join.TOKENS))).astype(np.uint32)
    rows = [(i, 0 if i < 290 else i, int(b), r.tobytes()) for i, (b, r) in enumerate(zip(jaccard_join.low_bits(tokens), tokens))]

    def counted(rows, *args):
        dealt.append((rows.count(), (out := deal(rows, *args)).count()))
        return out

    monkeypatch.setattr(jaccard_join, "_tasks", counted)
    labelled = spark.createDataFrame(rows, "node long, label long, bits long, tokens binary")
    merged = (True,) if "merged" in jaccard_join._met.__code__.co_varnames else ()
    found = {(r.node, r.group) for r in jaccard_join._met(labelled, range(10), *merged).collect()}
    near = {i for i in range(290, 300) if ((tokens[:290] == tokens[i]).sum(1) >= jaccard_join.CLOSE).any()}
    assert {n for n, g in found if n != g} <= near
    (before, after), = dealt
    assert before > 5000 and after < 1.5 * before


def test_tasks_of_a_main_part_hold_every_pair_once(spark):
    rows = [(i, 7, 4, i >= 20) for i in range(200)]
    dealt = jaccard_join._tasks(spark.createDataFrame(rows, "node long, bucket long, blocks int, main boolean"), "bucket", F.col("main")).collect()
    assert len(dealt) == 180 + 4 * 20
    tasks, met = {}, []
    for r in dealt:
        tasks.setdefault(r.task, []).append((r.node, r.side))
    for own in tasks.values():
        met += [(min(a, b), max(a, b)) for k, (a, s) in enumerate(own) for b, t in own[:k] if s != t or s == 2]
    assert sorted(met) == [(a, b) for a in range(20) for b in range(a + 1, 200)]


def test_join_of_empty_tables(spark, empty):
    assert jaccard_join.join(empty).count() == 0
    assert joined(spark, [(1, None), (2, "")]) == [(1, 1, 0, 0), (2, 2, 0, 0)]


def test_stage_keeps_one_of_each_group(spark):
    rows = variants(2, 5, 3)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = jaccard_join.near_duplicates_stage(spark, docs.unionByName(docs.limit(2)), "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _, _ in expected(rows)})


def test_stage_keeps_rows_not_ids(spark):
    """Different texts under one id, repeated rows, null ids, texts without words, and columns of any name."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1), 7.0, "a"), (1, text(2), 7.0, "a"), (2, text(1), 8.0, "b"), (3, text(3), 1.0, "d"), (3, text(3), 1.0, "c"), (None, text(1), 2.0, "e"), (4, "", 3.0, "f"), (4, None, 3.0, "f"), (4, None, 3.0, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node double, class_id string")
    kept = jaccard_join.near_duplicates_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[1], rows[4], *rows[5:]], key=str)
    assert jaccard_join.near_duplicates_stage(spark, docs.limit(0), "").count() == 0


def test_components_against_plain_search(spark):
    draw = random.Random(1)
    rows = [(draw.randrange(200), 1000 + draw.randrange(120)) for _ in range(220)] + [(k, 5000) for k in range(300, 400)]
    label = {n: n for n, _ in rows}
    for _ in rows:
        least = {}
        for n, g in rows:
            least[g] = min(label[n], least.get(g, label[n]))
        for n, g in rows:
            label[n] = min(label[n], least[g])
    assert {r.node: r.label for r in components(spark.createDataFrame(rows, "node long, group long")).frame.collect()} == label
    assert components(spark.createDataFrame([], "node long, group long")).frame.count() == 0


def test_components_of_long_chains(spark):
    chain = spark.range(40).select(F.col("id").alias("group"), F.explode(F.array("id", F.col("id") + 1)).alias("node"))
    found = components(chain.unionByName(spark.createDataFrame([(99, 99)], "group long, node long"))).frame.collect()
    assert {r.node: r.label for r in found} == {i: 0 for i in range(41)} | {99: 99}


def linked(spark, rows, kind="float"):
    return {(r.vec_id, tuple(r)[1:]) for r in embedding_dedup.link(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()}


def all_pairs(rows):
    good = [k for k, (_, v, _) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(rows[k][1]) for k in good}
    for a in good:
        for b in good:
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                near[a].add(b)
    out = set()
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        least = min(rows[b][0] for b in seen)
        out.add((i, (len(near[k]), least, i == least)))
    return out


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "LEAF", 4)
    monkeypatch.setattr(embedding_dedup, "TILE", 2)
    draw = np.random.default_rng(0)
    centres = draw.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + draw.normal(size=6) * (0.3 if i % 3 else 0.05)).astype(np.float32).tolist(), i % 2) for i in range(300)]
    rows += [(400 + k, rows[0][1], 0) for k in range(30)]
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 6, 0), (503, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (504, [float("nan")] * 6, 0), (505, [1.0, 2.0], 0), (506, [2.0, 4.0], 1), (507, [float("inf")] + [0.0] * 5, 0)]
    assert linked(spark, rows) == all_pairs(rows)
    assert linked(spark, rows[:40], "double") == all_pairs(rows[:40])


def test_embeddings_of_an_empty_table(spark):
    assert linked(spark, []) == set()
    assert linked(spark, [(1, None, 0)]) == {(1, (0, 1, True))}


def test_cover_tree_bounds():
    p = embedding_dedup.units(np.random.default_rng(2).normal(size=(300, 5))).astype(np.float32)
    tree = embedding_dedup.CoverTree(p)

    def below(node):
        own = [tree.center[node]] if not tree.count[node] else []
        return own + [x for c in (tree.children(node) if tree.count[node] else []) for x in below(c)]

    assert sorted(below(0)) == list(range(300))
    for node in range(len(tree.center)):
        gap = embedding_dedup.distances(p[below(node)], p[tree.center[node] : tree.center[node] + 1])
        assert gap.max() <= tree.radius[node] + 1e-5
