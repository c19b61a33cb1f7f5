"""Nulls, repeated rows, ties, empty tables and clashing columns of each operator, and the stages of the pipeline against plain loops."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomdoc.llm import digest, mixing, mjpeg, ordinal, packing, passages, pieces, simhash


def plain_counts(rows, alpha=0.5, seed="mix-1"):
    """Poisson counts of ``(doc_id, source)`` by their definition."""
    sources = Counter(s for _, s in rows)
    total = sum(n**alpha for n in sources.values())
    out = []
    for doc_id, source in rows:
        rate = sources[source] ** alpha / total * len(rows) / sources[source]
        u = int(hashlib.md5(f"{seed}|{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        cumulative = p
        while cumulative <= u:
            k += 1
            p *= rate / k
            cumulative += p
        out.append(k)
    return out


@pytest.mark.parametrize("steps", [2_000_000, 0])
def test_mixing_against_its_definition(spark, monkeypatch, steps):
    monkeypatch.setattr(mixing, "BROADCAST_STEPS", steps)
    rng = random.Random(2)
    # a third of all rows in one source, null sources and ids, repeated rows
    rows = [(i, "hot") for i in range(200)] + [(i, f"s{rng.randrange(9)}") for i in range(200, 560)] + [(i, None) for i in range(560, 600)] + [(None, "hot"), (7, "hot"), (7, "hot")]
    names = ["_at", "_count", "_steps", "_source", "_rate", "_salt", "_dealt", "_k", "_c", "copy", "mix_key"]
    docs = spark.createDataFrame([(*r, *[f"{n}{k}" for n in names]) for k, r in enumerate(rows)], "doc_id bigint, source string, " + ", ".join(f"{n} string" for n in names)).repartition(4)
    out = mixing.replicate(docs)
    assert out.columns == [*docs.columns, "copy_", "mix_key_"]
    got = out.collect()
    want = Counter()
    for k, (row, n) in enumerate(zip(rows, plain_counts(rows))):
        want[(*row, f"copy{k}")] = n
    assert Counter((r["doc_id"], r["source"], r["copy"]) for r in got) == +want
    keys = [r["mix_key_"] for r in got]
    assert keys == sorted(keys) and len(got) > 400
    assert mixing.replicate(docs.limit(0)).count() == 0


def test_steps_of_large_rates(spark):
    rates = spark.createDataFrame([("a", 0.0), ("b", 0.3), ("c", 3000.0)], "_source string, _rate double")
    got = {r["_source"]: r["_steps"] for r in mixing.poisson_steps(rates).collect()}
    assert got["a"] == [1.0] * 31 and got["b"][0] == pytest.approx(math.exp(-0.3)) and got["b"][2] == pytest.approx(math.exp(-0.3) * (1 + 0.3 + 0.045))
    assert len(got["c"]) == 3000 + math.ceil(12 * math.sqrt(3000)) + 31 and got["c"][-1] == pytest.approx(1.0) and 0.49 < got["c"][3000] < 0.52 and got["c"] == sorted(got["c"])


def test_packing_cases(spark):
    docs = spark.createDataFrame([(None, "one two", 1, "x"), (None, "one two", 1, "x"), (5, None, 2, "y"), (6, "word " * 3000, 3, "z")], "doc_id bigint, text string, n_tokens int, ids string")
    rows = packing.pack(docs, size=64, fill=True).collect()
    tokens = packing.Tokens(packing.default_ranks())
    held = Counter()
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert len(ids) == 64 and set(ids[r["n_tokens"] :]) <= {tokens.end} and r["cu_lengths"][-1] == r["n_tokens"]
        assert r["position_resets"] == r["cu_lengths"][:-1] + [r["n_tokens"]] * (r["n_tokens"] < 64)
        for a, z, owner, start in zip(r["cu_lengths"], r["cu_lengths"][1:], r["doc_ids"], r["starts"]):
            held[(owner, start, tuple(ids[a:z]))] += 1
    want = Counter()
    for doc_id, text, _, _ in docs.collect():
        own = tokens.encode(text or "") + [tokens.end]
        want.update((doc_id, k, tuple(own[k : k + 64])) for k in range(0, len(own), 64))
    assert held == want


def test_media_cases(spark):
    docs = spark.createDataFrame([(None, "a", "x"), (3, "b", "y"), (3, "b", "y"), (3, None, "z")], "doc_id bigint, text string, media string")
    got = mjpeg.read_back(mjpeg.store_texts(docs)).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter({(None, 1): 1, (3, 1): 2, (3, 0): 1})
    want = {t: hashlib.sha256(t.encode() + bytes(64 - len(t))).hexdigest() for t in ("a", "b", "")}
    assert {r["payload_sha256"] for r in got} == set(want.values()) and all(r["tail_crc32"] == zlib.crc32(t.encode() + bytes(64 - len(t))) for r in got for t, w in want.items() if r["payload_sha256"] == w)
    assert mjpeg.read_back(mjpeg.store_texts(docs.limit(0))).count() == 0


def test_digest_cases(spark):
    rows = [(None, "null one", "x"), (None, "null one", "x"), (2, None, "y")] + [(7, f"hot text {k}", "z") for k in range(30)] + [(9, "last", "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string").repartition(3)
    got = digest.fingerprints(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert {r["fingerprint"] for r in got if r["doc_id"] is None} == {digest.digest("null one")} and all(0 <= r["near_next"] <= 1 for r in got)
    assert digest.fingerprints(docs.limit(0)).count() == 0


def test_pieces_cases(spark):
    docs = spark.createDataFrame([(None, "text one", "x"), (4, "text one", "y"), (4, "text one", "y"), (5, None, "z")], "doc_id bigint, text string, decoded string")
    got = pieces.decode(pieces.encode(docs)).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in got) == Counter({(None, "text one"): 1, (4, "text one"): 2, (5, ""): 1})
    assert pieces.decode(pieces.encode(docs.limit(0))).count() == 0


def loss(features, grades, weights, thresholds, penalty):
    """Penalised mean log-likelihood of cumulative-link regression, by its definition."""
    total = 0.0
    for own, g in zip(features, grades):
        score = sum(weights.get(int(f), 0.0) for f in own)
        tail = lambda k: 1.0 if k == 0 else 0.0 if k == 3 else 1 / (1 + math.exp(thresholds[k - 1] - score))  # noqa: B023, E731
        total += math.log(tail(g) - tail(g + 1))
    return total / len(grades) - penalty / 2 * sum(w * w for w in weights.values())


def test_the_fit_is_the_best_there_is():
    rng = np.random.default_rng(7)
    grades = rng.integers(0, 3, 240)
    features = [np.unique(np.concatenate([rng.integers(0, 12, 4), [20 + int(g)] * int(rng.random() < 0.6)])).astype(np.int32) for g in grades]
    penalty = 0.02
    model = ordinal.fit(features, grades, rounds=8000, rate=0.002, penalty=penalty, least=1, deviations=0.0)
    weights, thresholds = dict(zip(model.buckets.tolist(), model.weights.tolist())), model.thresholds
    best = loss(features, grades, weights, thresholds, penalty)
    # the likelihood is concave, so no small step in any direction may gain
    for k in weights:
        for step in (-0.02, 0.02):
            assert loss(features, grades, weights | {k: weights[k] + step}, thresholds, penalty) < best + 1e-6
    for k in range(2):
        for step in (-0.02, 0.02):
            moved = thresholds.copy()
            moved[k] += step
            assert loss(features, grades, weights, moved, penalty) < best + 1e-6


def plain_grades(docs, model):
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    out = []
    for doc_id, text in docs:
        score = sum((weights.get(f, 0.0) for f in {f for w in set((text or "").split()) for f in ordinal.word_features(w)}), 0.0)
        tails = [1 / (1 + math.exp(-max(-30, min(30, score - t)))) for t in model.thresholds]
        out.append((doc_id, round(score, 6), round(sum(tails), 6), round(tails[-1], 6), tails[-1] >= ordinal.SELECT))
    return out


def test_grades_against_a_loop(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(None, None), (-1, ""), (-2, "word " * 50_000), (0, docs.filter("doc_id = 0").first()["text"])], "doc_id bigint, text string"))
    model = ordinal.train(docs, labels)
    got = [(r["doc_id"], round(r["score"], 6), round(r["expected_grade"], 6), round(r["tail_probability"], 6), r["selected"]) for r in ordinal.grade_documents(docs, labels).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_grades([tuple(r) for r in docs.collect()], model)))


class Sets(dict):
    def root(self, i):
        while self.setdefault(i, i) != i:
            i = self[i]
        return i


def shingles(text):
    w = text.lower().split()
    return frozenset(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else frozenset([tuple(w)])


def test_stages_against_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = docs.filter("doc_id % 17 = 0").withColumn("doc_id", F.col("doc_id") + 100_000)
    odd = spark.createDataFrame([(None, None, None, None, None), (900_000, "", "en", None, 0)], docs.schema)
    names = {n: n for n in ("_row", "_gone", "_steps", "copy", "mix_key", "_tail", "key", "line")}
    docs = docs.union(copies).union(odd).withColumns({n: F.lit(v) for n, v in names.items()})
    kept = corpus_pipeline.written(corpus_pipeline.quality(spark, docs, sf), "stage")
    assert kept.columns == docs.columns
    model = ordinal.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(g[0] for g in plain_grades(rows, model) if g[-1])
    # near-duplicates: at a similarity of 0.8 on five words, by components
    have = sorted(((r["doc_id"] is not None, r["doc_id"], r["text"] or "") for r in kept.collect()), key=lambda x: (x[0], x[1] or 0))
    sets, own = Sets(), [shingles(t) for _, _, t in have]
    for i in range(len(have)):
        for j in range(i):
            if min(len(own[i]), len(own[j])) >= 0.8 * max(len(own[i]), len(own[j])) and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
                a, b = sorted((sets.root(i), sets.root(j)))
                sets[b] = a
    single = corpus_pipeline.written(corpus_pipeline.near_duplicates(spark, kept, sf), "stage")
    assert Counter(r["doc_id"] for r in single.collect()) == Counter(have[i][1] for i in {sets.root(i) for i in range(len(have))}) and single.columns == docs.columns
    # repeated passages: no 25 words that an earlier document has stay; what is not repeated stays as it is
    cut = corpus_pipeline.written(corpus_pipeline.repeated_passages(spark, single, sf), "stage")
    assert cut.columns == docs.columns
    grams = lambda t: [tuple(w[k : k + 25]) for w in [t.lower().split()] for k in range(len(w) - 24)]
    seen, again = set(), set()
    for r in sorted(single.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        for g in grams(r["text"] or ""):
            again |= {r["doc_id"]} if g in seen else set()
            seen.add(g)
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (single, cut))
    near = {r["doc_id"] for r in passages.repeats(single).filter("not keep").collect()}
    assert again <= near and all(after[d] == t for d, t in before.items() if d not in near)
    seen = set()
    for d in sorted(after, key=lambda d: (d is not None, d or 0)):
        new = grams(after[d] or "")
        assert not seen & set(new)
        seen |= set(new)
    mix = corpus_pipeline.mixed(spark, cut, sf)
    plain = [(r["doc_id"], r["source"]) for r in cut.collect()]
    want = Counter({d: n for (d, _), n in zip(plain, plain_counts(plain)) if n})
    assert Counter(r["doc_id"] for r in mix.collect()) == want and mix.columns == docs.columns
    found = pieces.decode(corpus_pipeline.encoded(spark, cut, sf)).collect()
    assert {r["doc_id"]: r["decoded"] for r in found} == {d: t or "" for d, t in after.items()}


def test_pipeline_of_empty_tables(spark, sf):
    now = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        assert now.count() == 0


def test_rows_with_the_same_hash_of_words_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a  b c d e f g"), (1, "A b c d e f g"), (1, "x y z")], "doc_id bigint, text string")
    assert sorted(r["text"] for r in simhash.drop_near_duplicates(docs).collect()) in (["a  b c d e f g", "x y z"], ["A b c d e f g", "x y z"])
