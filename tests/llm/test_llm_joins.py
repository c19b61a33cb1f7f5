"""Prefix-tree join, ball k-means and fill-in-middle against plain loops, with their cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdoc.llm import balls, middle, ngram_join
from loomdoc.llm.clusters import Joined
from loomdoc.llm.prefix_tree import Member, PrefixTree, candidates, similar

WHITE = " \t\n\x0b\x0c\r"


def set_of(text, k=4):
    own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE:
        own = own.replace(c, " ")
    words = [w for w in own.split(" ") if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_components(rows):
    """``(doc_id, n, component)`` of ``(doc_id, text)``, all pairs compared."""
    sets = [set_of(t) for _, t in rows]
    joined = Joined(len(rows))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                joined.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[joined.root(i)] = min(d, least.get(joined.root(i), d))
    return sorted(((d, len(sets[i]), least.get(joined.root(i))) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def near_texts(seed=5):
    """A large group of near copies around the threshold, a passage that many share, short texts, ties and the rest."""
    rng = random.Random(seed)
    word = lambda n=4000: f"w{rng.randrange(n)}"
    base, passage = [word() for _ in range(80)], " ".join(word() for _ in range(30))
    texts = [edited(rng, base, rng.randrange(6)) for _ in range(90)]
    texts += [f"{passage} {' '.join(word() for _ in range(rng.randrange(3, 40)))}" for _ in range(60)]
    texts += [" ".join(word(3) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts += [" ".join(word() for _ in range(50)) for _ in range(30)]
    texts += [edited(rng, t.split(), 1) for t in texts[-30:]]
    texts += ["", None, "   \t", "one", "ONE", "one　", "a b\x0bc", "A\nB C", " ".join(base), " ".join(base)]
    return texts


@pytest.mark.parametrize("common,most", [(100, 400), (5, 20)])
def test_join_against_all_pairs(spark, monkeypatch, common, most):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    rows = [(i * 7 % 10007, t) for i, t in enumerate(near_texts())] + [(None, "alone in the whole table of texts"), (None, "one"), (3, "three words only"), (3, "three words only")]
    names = ["row", "node", "n", "id", "root", "first", "bands", "low", "n_shingles", "component_id"]
    docs = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names)).repartition(5)
    got = ngram_join.link_documents(docs, most=most)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(rows)
    assert ngram_join.link_documents(docs.limit(0)).count() == 0


def test_second_step_finds_what_bands_miss(spark, monkeypatch):
    """Without shards of bands, the prefixes alone find every link."""
    shards = ngram_join.shards
    monkeypatch.setattr(ngram_join, "shards", lambda pairs, most: shards(pairs.limit(0), most))
    monkeypatch.setattr(ngram_join, "COMMON", 5)
    rows = list(enumerate(near_texts(8)))
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), most=20)
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(rows)


def random_sets(rng, n):
    base = rng.sample(range(300), 60)
    out = []
    for _ in range(n):
        own = set(base if rng.random() < 0.6 else rng.sample(range(300), rng.randrange(1, 80)))
        for _ in range(rng.randrange(12)):
            own.discard(rng.choice(sorted(own)))
            own.add(rng.randrange(300))
        out.append(sorted(own))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tree_against_all_pairs(seed):
    rng = random.Random(seed)
    sets = random_sets(rng, 60)
    near = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(set(a) & set(b)) >= 85 * len(set(a) | set(b))}
    members = [Member(i, len(s), s) for i, s in enumerate(sets)]
    tree, found = PrefixTree(members, Joined(len(sets)), 85, 100), set()
    for i, m in enumerate(members):
        for j, overlap in tree.near(m, i):
            assert overlap == len(set(sets[i]) & set(sets[j]))
            found.add((i, j))
        tree.add(i)
    assert found == near
    joined = Joined(len(sets))
    for i, j in near:
        joined.join(i, j)
    links = Joined(len(sets))
    for i, j in similar(members, 85, 100):
        links.join(i, j)
    assert [links.root(i) for i in range(60)] == [joined.root(i) for i in range(60)]
    # of prefixes: no similar pair that shares an element there is lost
    lengths = [ngram_join.prefix_length(len(s), 85, 100) for s in sets]
    parts = [ngram_join.packed(np.array(s[: p + 1], np.uint64) << np.uint64(39)) for s, p in zip(sets, lengths)]
    known = [Member(i, len(s), *ngram_join.known_part(x, len(s))) for i, (s, x) in enumerate(zip(sets, parts))]
    assert all(m.known == s[:p] for m, s, p in zip(known, sets, lengths))
    open_ = {(max(x), min(x)) for x in candidates(known, list(range(60)), 85, 100)}
    assert near <= open_ and all(set(sets[i][: lengths[i]]) & set(sets[j][: lengths[j]]) for i, j in near)
    apart = candidates(known, [0] * 60, 85, 100)
    assert apart == []


def test_sizes_that_allow_the_similarity():
    rows = [(k, n) for k, n in enumerate([100, 84, 50, 85, 43, 42, 7])]
    assert [n for _, n in ngram_join.comparable(rows, 85, 100)] == [42, 43, 50, 84, 85, 100]
    assert ngram_join.comparable([(1, 5)], 85, 100) == []


def test_tree_leaves_unlike_subtrees():
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(10**6), 400)) for _ in range(200)]
    tree = PrefixTree([Member(i, 400, s) for i, s in enumerate(sets)], Joined(200), 85, 100)
    for i, m in enumerate(tree.members):
        assert not list(tree.near(m, i))
        tree.add(i)
    assert tree.visited < 200 * 200 * 3  # of 25 runs each


def plain_kmeans(rows, k=8, rounds=10, dims=64, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 32768 for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        to = [min((far(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if r < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, x) in zip(kept, to) if x == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own)]
    inertia = [sum(d for d, x in to if x == j) for j in range(len(centres))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia), marks[j]) for (i, _), (d, j) in zip(kept, to)), key=str)


def test_kmeans_against_plain_rounds(spark):
    rng = random.Random(11)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(middles)]) for i in range(250)]
    rows += [(i, [0.5] * 64) for i in range(250, 330)]  # a group of equal vectors
    rows += [(7, rows[7][1]), (None, [0.25] * 64), (400, None), (401, [1.0] * 63), (402, [1.0] * 65), (403, [None] + [1.0] * 63), (404, [math.nan] * 64), (405, [math.inf] * 64), (406, [40000.0] * 64), (407, [])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, v string, cluster int").repartition(5)
    assert sorted(map(tuple, balls.cluster(table).collect()), key=str) == plain_kmeans(rows)
    few = rows[:5]
    assert sorted(map(tuple, balls.cluster(table.filter("vec_id < 5")).collect()), key=str) == plain_kmeans(few)
    assert balls.cluster(table.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert balls.cluster(table.limit(0)).count() == 0


def test_balls_make_fewer_distances():
    rng = np.random.default_rng(2)
    centres = rng.integers(-9000, 9000, (20, 16))
    rows = centres[rng.integers(0, 20, 4000)] + rng.integers(-300, 300, (4000, 16))
    best, least, made = balls.assign_all(rows, centres)
    for before in (best, rng.integers(0, 20, 4000)):
        to, d, n = balls.assign_balls(rows, before, centres)
        assert (to == best).all() and (d == least).all()
    assert balls.assign_balls(rows, best, centres)[2] == 4000 < made == 80000
    # ties go to the smaller number, from either side
    rows, centres = np.array([[0, 0]] * 3), np.array([[2, 0], [-2, 0], [0, 2]])
    assert balls.assign_balls(rows, np.array([0, 1, 2]), centres)[0].tolist() == [0, 0, 0]


@pytest.mark.parametrize("text", ["", "plain text", "é", "日本語 und ünïcode 🙂🙂", "🙂" * 300, "a" * 5000 + "é" + "b" * 5000])
def test_boundaries(text):
    data = text.encode()
    index = middle.boundaries(data)
    assert index.n == len(text) + 1
    assert [index[i] for i in range(index.n)] == [len(text[:i].encode()) for i in range(index.n)]
    if len(text) > 1000:
        assert index.words.nbytes + len(index.low) + index.before.nbytes < 8 * len(text) / 8 + 64


def test_elias_fano_of_any_rising_list():
    rng = np.random.default_rng(4)
    for top in (1, 10, 1000, 10**7):
        values = np.sort(rng.integers(0, top, 500))
        index = middle.EliasFano(values)
        assert [index[i] for i in range(500)] == values.tolist()


def plain_cut(doc_id, text):
    t = text or ""
    n, h = len(t), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", i, j - i, f"<S>{t[j:]}<P>{t[:i]}<M>{t[i:j]}"
    return n, "psm", i, j - i, f"<P>{t[:i]}<S>{t[j:]}<M>{t[i:j]}"


@pytest.mark.parametrize("share", [2000, 10])
def test_fill_in_middle_against_its_definition(spark, monkeypatch, share):
    monkeypatch.setattr(middle, "SHARE", share)
    rng = random.Random(6)
    pool = "ab é日🙂\n\t<>PSM"
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(300)] + [(i, "the same hot text é🙂 of a third") for i in range(300, 480)]
    rows += [(None, "no number"), (1, None), (2, ""), (3, "with <M> mark"), (5, "five"), (5, "five"), (6, "x" * 200_000 + "é")]
    names = ["n", "form", "output", "_bytes", "_key", "_share", "_doc", "_hot", "_shares", "prefix_chars"]
    docs = spark.createDataFrame([(*r, *["y"] * len(names)) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    out = middle.fill_in_middle(docs)
    assert out.columns == [*docs.columns, "n_", "form_", "prefix_chars_", "middle_chars", "output_"]
    back = out.withColumn("back", middle.restored(F.col("form_"), F.col("output_")))
    got = [(r["doc_id"], r["text"], r["n_"], r["form_"], r["prefix_chars_"], r["middle_chars"], r["output_"], r["back"]) for r in back.collect()]
    assert all(r["n"] == "y" for r in out.select("n").collect())
    want = [(d, t or "", *plain_cut(d, t), t or "") for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


def test_clustered_fingerprints_keep_the_plan_small(spark):
    """All values of the ten lowest bits, in shards of 64 at most: only hot masks are dealt again."""
    from loomdoc.llm import simhash

    fps = spark.createDataFrame([(i,) for i in range(1024)], "fp bigint")
    joined = Joined(1024)
    for r in simhash.near_links(fps, 2, 64).collect():
        assert (r["a"] ^ r["b"]) < 1024
        joined.join(r["a"], r["b"])
    assert {joined.root(i) for i in range(1024)} == {0}
