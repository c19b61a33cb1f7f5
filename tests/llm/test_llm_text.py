import math
import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdoc.llm import mixing, ordinal, pieces, queries


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load(pieces.default_model())


def brute_force(p, text):
    if not text:
        return []
    text = "▁" + text.replace(" ", "▁")
    known = {p.pieces[i]: (p.scores[i], i) for i in range(len(p.pieces)) if p.kinds[i] == "normal"}
    best = [(0.0, 0, [])] + [(-math.inf, 0, [])] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            if (found := known.get(text[start:end])) and best[start][0] + found[0] > best[end][0]:
                best[end] = (best[start][0] + found[0], start, [found[1]])
        if best[end - 1][0] + p.lowest > best[end][0]:
            best[end] = (best[end - 1][0] + p.lowest, end - 1, [p.bytes[v] for v in text[end - 1].encode()])
    out, at = [], len(text)
    while at:
        out, at = best[at][2] + out, best[at][1]
    return out


TEXTS = [" a  b   c ", "漢字 kana ", "a\n\nb", "  ", "🙂x", "don't, (foo)... -- \"x\",y", "x\ty z\n", "naïve Straße çà", "a" * 100, "\x01a \x01", "l'été\nde l'an"]


def test_pieces_are_the_best(model, spark, sf):
    texts = TEXTS + [r["text"][:400] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    flat, sizes = model.encode_all(texts)
    at = 0
    for t, n in zip(texts, sizes.tolist()):
        assert flat[at : at + n].tolist() == brute_force(model, t) == model.encode(t)
        assert model.decode(flat[at : at + n].tolist()) == t
        at += n


def test_small_vocabularies():
    p = pieces.Pieces(["<unk>", "a", "ab", "b▁a", "▁"], [0.0, -1.0, -1.5, -0.5, -2.0], ["unknown", *["normal"] * 4])
    assert p.parts is None and p.encode("ab a") == [4, 1, 3, 4, 1][:0] + list(p.best_path("▁ab▁a"))
    assert p.decode(p.encode("ab a")) == "ab a" and p.encode("z") == [4, 0]
    assert pieces.Pieces(["<unk>"], [0.0], ["unknown"]).encode("ab") == [0, 0, 0]


def test_pieces_of_rows(spark):
    rows = spark.createDataFrame([(1, "hello there", 1), (2, None, 2), (2, "", 2)], "doc_id bigint, text string, n_pieces int")
    got = pieces.decode(pieces.encode(rows)).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["decoded"]) for r in got) == [(1, 11, "hello there"), (2, 0, ""), (2, 0, "")]
    assert pieces.encode(rows.limit(0)).count() == 0


def test_mixing_follows_the_sql(spark, sf):
    rows = mixing.replicate(spark.read.parquet(f"{sf}/documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(queries.ORACLE_SQL["op7_mixing"]).select("doc_id, copy, mix_key").fetchall()
    got = [(r["doc_id"], r["copy"], r["mix_key"]) for r in rows.collect()]
    assert sorted(got) == sorted(want) and [x[2] for x in got] == sorted(x[2] for x in got)


def test_mixing_rates_and_edges(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit(1).alias("copy"))
    rows = mixing.replicate(docs, weights={"a": 0.75, "b": 0.25}, size=2.0)
    assert rows.columns == ["doc_id", "source", "copy", "copy_", "mix_key"]
    counts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    assert set(counts) == {"a", "b"} and abs(counts["a"] - 9000) < 400 and abs(counts["b"] - 3000) < 250
    own = rows.filter("source = 'a'").groupBy("doc_id").count().groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect()
    for r in own:  # Poisson with mean 4.5
        want = 2000 * math.exp(-4.5) * 4.5 ** r["count"] / math.factorial(r["count"])
        assert abs(r["n"] - want) < 5 * math.sqrt(want + 1) + 5
    nulls = mixing.replicate(docs.filter("source is null"), alpha=1.0).count()
    assert abs(nulls - 2000) < 250
    assert mixing.replicate(docs.limit(0)).count() == 0 and mixing.replicate(docs, weights={}).count() == 0


def test_ordinal_regression():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 600)
    features = [np.unique(np.concatenate([rng.integers(100, 5000, 20), [int(g)], [10 + int(g)]])) for g in grades]
    model = ordinal.fit(features, grades)
    assert (np.diff(model.thresholds) > 0).all()
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    tails = model.tails(np.array([sum(weights.get(int(f), 0.0) for f in x) for x in features]))
    assert ((tails > 0.5).sum(axis=1) == grades).mean() > 0.97 and (tails[:, 0] >= tails[:, 1]).all()
    assert ordinal.fit([], np.zeros(0, int)) is None and ordinal.fit([np.zeros(0, np.int64)], np.array([1])) is not None


def test_grades_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = ordinal.train(docs, labels.filter("doc_id % 4 != 0"))
    held = ordinal.graded(docs.join(labels.filter("doc_id % 4 = 0"), "doc_id").select("doc_id", "text", "quality", "toxic"), model)
    rates = {(r["quality"], r["toxic"]): r["s"] for r in held.groupBy("quality", "toxic").agg(F.avg((F.col("_tail") >= ordinal.SELECT).cast("int")).alias("s")).collect()}
    assert rates[(1, 0)] > 0.97 and rates[(1, 1)] < 0.15 and rates[(0, 0)] < 0.3


def test_grades_without_labels(spark):
    docs = spark.createDataFrame([(1, "text"), (None, None), (1, "text")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0), (77, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert [r["selected"] for r in ordinal.grade_documents(docs, labels).collect()] == [True] * 3
    assert ordinal.select_documents(docs, labels).count() == 3
    assert ordinal.grade_documents(docs.limit(0), labels.union(spark.createDataFrame([(1, 1, 0)], labels.schema))).count() == 0
    clash = docs.withColumn("_tail", F.lit("x")).withColumn("a b", F.lit(1))
    assert ordinal.select_documents(clash, spark.createDataFrame([(1, 1, 0)], labels.schema)).columns == clash.columns


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, counts = docs, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.dtypes == docs.dtypes
            now = corpus_pipeline.written(now, "stage")
        counts.append(now.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] and counts[4] == counts[5] > 0
    assert corpus_pipeline.run(spark, sf).count() == counts[5]


def test_the_rest_does_without_these_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys; sys.modules['loomdoc.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')]; assert e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
