"""JSON merges and containment, stored tables with a key, tagging batches and answers, and absorption over many chunks, against plain loops."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import vector
from loomdoc.functions import verdicts as V
from loomdoc.operators import blocks, export, tagging
from loomdoc.operators import json_objects as J
from loomdoc.operators.keyed_table import KeyedTable
from loomdoc.operators.stages import shared_folder


def random_value(rng, depth=3):
    k = rng.randrange(8 if depth else 5)
    if k < 5:
        return [None, True, rng.randrange(4), rng.choice(["a", "b", "1"]), 1.5][k]
    if k == 5:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["x", "y", "k.z", "q'"]): random_value(rng, depth - 1) for _ in range(rng.randrange(4))}


def slow_merged(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **b}
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def slow_deep(a, b, depth):
    if depth and isinstance(a, dict) and isinstance(b, dict):
        return {k: slow_deep(a[k], b[k], depth - 1) if k in a and k in b else (b if k in b else a)[k] for k in {**a, **b}}
    return b


def slow_contains(a, b, top=True):
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and slow_contains(a[k], v, False) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(slow_contains(x, y, False) for x in a) for y in b)
    same = lambda x: not isinstance(x, (dict, list)) and isinstance(x, bool) == isinstance(b, bool) and x == b
    return same(a) or (top and isinstance(a, list) and any(same(x) for x in a))


def test_merges_against_loops(spark):
    rng = random.Random(1)
    pairs = [(random_value(rng), random_value(rng)) for _ in range(150)] + [({"a": {"b": {"c": {"d": {"e": 1}}}}}, {"a": {"b": {"c": {"d": {"f": 2}}}}}), ({}, {}), ([], {"a": None})]
    rows = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)] + [(-1, None, "{}"), (-2, "{}", None)], "i int, a string, b string")
    a, b = F.try_parse_json("a"), F.try_parse_json("b")
    got = {r["i"]: r for r in rows.select("i", F.to_json(J.merged(a, b)).alias("m"), F.to_json(J.merged_deeply(a, b, 3)).alias("d")).collect()}
    for i, (x, y) in enumerate(pairs):
        assert json.loads(got[i]["m"]) == slow_merged(x, y)
        assert json.loads(got[i]["d"]) == slow_deep(x, y, 3)
    assert got[-1]["m"] is None and got[-2]["m"] is None and got[-1]["d"] == "{}" and got[-2]["d"] == "{}"


@pytest.mark.parametrize("wanted", [{}, [], {"x": {}}, {"x": [1]}, {"k.z": None}, "a", 1, True, None, 1.5, [[]], [{"y": "b"}], {"q'": {"x": "1"}}, {"x": 1.0, "y": True}])
def test_containment_against_a_loop(spark, wanted):
    rng = random.Random(2)
    values = [random_value(rng) for _ in range(200)] + [wanted, {"x": wanted, "y": 0}, [wanted, "a"], {"x": [2, 1, 1]}, {"x": 1, "y": True, "z": 0}]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, None), (-2, "{broken")], "i int, v string")
    got = {r["i"]: r["c"] for r in rows.select("i", J.contains(F.try_parse_json("v"), wanted).alias("c")).collect()}
    assert got == {**{i: slow_contains(v, wanted) for i, v in enumerate(values)}, -1: False, -2: False}
    assert got[len(values) - 5]


def files_of(table):
    folder = table.path.removeprefix("file://")
    return {d: sorted(f for f in os.listdir(f"{folder}/{d}") if f.endswith(".parquet")) for d in os.listdir(folder) if d.startswith("_bucket")}


def test_writes_touch_only_their_buckets(spark):
    table = KeyedTable(shared_folder(spark, "keyed"), ("k", "s"), 16)
    rows = spark.createDataFrame([(i, "s", i * 1.0, f"n{i}") for i in range(300)], "k int, s string, x double, n string")
    table.create(rows)
    want = {i: (i * 1.0, f"n{i}") for i in range(300)}
    state = lambda: {r["k"]: (r["x"], r["n"]) for r in table.read(spark).collect()}
    before = files_of(table)
    assert len(before) == 16 and all(len(f) == 1 for f in before.values())
    touched = table.upsert(spark.createDataFrame([(5, "s", None, "new"), (1000, "s", 7.0, None)], "k int, s string, x double, n string"))
    want.update({5: (5.0, "new"), 1000: (7.0, None)})
    after = files_of(table)
    assert state() == want and 1 <= len(touched) <= 2
    assert {d for d in before if before[d] != after[d]} == {f"_bucket={b}" for b in touched}
    assert table.upsert(spark.createDataFrame([(6, "s")], "k int, s string").withColumn("x", F.lit(None).cast("double"))) and state() == want
    touched = table.patch(spark.createDataFrame([(7, "s", None), (5000, "s", "no")], "k int, s string, n string"), ["n"])
    want[7] = (7.0, None)
    assert state() == want and len(touched) == 1
    first = next(iter(table.read(spark).filter("k = 7").select("k", "s").collect()))
    bucket = table._touched(spark.createDataFrame([first], "k int, s string"))[0]
    going = table.read(spark, [bucket]).select("k", "s")
    gone = {r["k"] for r in going.collect()}
    assert table.delete(spark.createDataFrame([(k, "s") for k in gone] + [(9999, "s")], "k int, s string")) == [bucket]
    assert state() == {k: v for k, v in want.items() if k not in gone}
    assert table.delete(spark.createDataFrame([(9999, "s")], "k int, s string")) == []
    assert table.upsert(spark.createDataFrame([], "k int, s string, x double, n string")) == []
    for bad in ([(1, "s", 1.0, "a"), (1, "s", 2.0, "b")], [(None, "s", 1.0, "a")]):
        with pytest.raises(ValueError):
            table.upsert(spark.createDataFrame(bad, "k int, s string, x double, n string"))


def slow_answer(size, answer):
    """idx to levels, or nothing where the answer fails."""
    out = {}
    try:
        items = json.loads(answer)
        if not isinstance(items, list):
            return {}
        for item in items:
            i, h = item.get("idx"), item.get("hierarchy", {})
            if type(i) is not int or i >= size:
                continue
            if i < -size:
                return {}
            out[i % size] = tuple(None if h.get(k) is None else str(h.get(k)) for k in ("h1", "h2", "h3"))
    except (ValueError, TypeError, AttributeError):
        return {}
    return out


def test_answers_against_a_loop(spark):
    h = '{"h1":"A","h2":7,"h3":null}'
    texts = ["", "x", "{}", "null", "[]", "[1]", "[null]", '[{"idx":0,"hierarchy":%s}]' % h, '[{"idx":"0","hierarchy":%s}]' % h, '[{"idx":3,"hierarchy":null}]', '[{"idx":2,"hierarchy":null},{"idx":0}]', '[{"idx":0,"hierarchy":[]}]', '[{"idx":-3,"hierarchy":%s}]' % h, '[{"idx":0},{"idx":-4}]', '[{"idx":1},{"idx":1,"hierarchy":%s}]' % h, '[{"idx":1.0}]', '[{"hierarchy":%s}]' % h, '[{"idx":2,"hierarchy":{}},"x"]']
    rows = spark.createDataFrame([(i, 3, t) for i, t in enumerate(texts)] + [(-1, 3, None)], "k int, size int, answer string")
    got = {}
    for r in tagging.answers(rows, "size", "answer", ["k"]).collect():
        got.setdefault(r["k"], {})[r["idx"]] = (r["h1"], r["h2"], r["h3"])
    assert got == {i: w for i, t in enumerate(texts) if (w := slow_answer(3, t))} and len(got) == 3


def test_batches_of_hot_and_null_files(spark):
    chunks = spark.createDataFrame([("hot", i, f"c{i}", "a", "b", "c") for i in range(203)] + [(None, i, f"n{i}", "a", "b", "c") for i in range(7)] + [("one", 0, "o", None, None, None)], "file string, at int, content string, h1 string, h2 string, h3 string")
    rows = tagging.batches(chunks.repartition(3), "file", ["at"])
    assert {(r["file"], r["at"]): (r["batch"], r["idx"]) for r in rows.collect()} == {(f, i): (i // 5, i % 5) for f, n in (("hot", 203), (None, 7), ("one", 1)) for i in range(n)}
    found = spark.createDataFrame([(None, 1, 1, "x", None, None), ("hot", 40, 2, None, "y", None)], "file string, batch bigint, idx int, h1 string, h2 string, h3 string")
    changed = {(r["file"], r["at"]): (r["h1"], r["h2"], r["h3"]) for r in tagging.tagged(rows, found, "file").collect() if (r["h1"], r["h2"], r["h3"]) not in (("a", "b", "c"), (None, None, None))}
    assert changed == {(None, 6): ("x", None, None), ("hot", 202): (None, "y", None)}
    assert tagging.batches(chunks.limit(0), "file", ["at"]).count() == 0
    sent = tagging.requests(rows.filter("file = 'one'"), "file", tagging.entry(F.col("idx"), F.col("content"), F.lit(None).cast("string"), F.lit(" "))).collect()[0]
    assert json.loads(sent["entries"]) == [{"idx": 0, "content": "o", "chunk_type": "body", "char_length": 1}]


def test_absorption_over_many_chunks():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(20_000):
        texts.append(" ".join(rng.sample(words, 12)) if not texts or rng.random() < 0.7 else texts[rng.randrange(len(texts))] + " more")
    start = time.monotonic()
    kept = blocks.absorbed(texts, 0.5)
    # all pairs would take minutes
    assert time.monotonic() - start < 30 and 10_000 < len(kept) < 16_000
    for threshold in (0.0, 0.3, 0.5, 0.8):
        own = [" ".join(rng.choices("abcdefgh", k=rng.randrange(5))) for _ in range(120)]
        slow = []
        for i, t in enumerate(own):
            share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
            x = next((x for x in slow if share(set(t.split()), set(own[x[1]].split())) > threshold), None)
            if x is None:
                slow.append([i, i])
            elif len(t) > len(own[x[1]]):
                x[1] = i
        assert blocks.absorbed(own, threshold) == [(p, own[i]) for p, i in slow]


def test_counts_of_vectors_and_caps(spark):
    rows = spark.createDataFrame([(["a", "b"], [[3.0, 4.0], [0.0, 0.0]])], "t array<string>, v array<array<double>>")
    pairs = rows.select(vector.paired(F.col("t"), F.col("v")).alias("p")).collect()[0]["p"]
    assert [(x["item"], x["vector"]) for x in pairs] == [("a", [0.6, 0.8]), ("b", [0.0, 0.0])]
    with pytest.raises(Exception, match="2 vectors for 3 items"):
        rows.select(vector.paired(F.array_append("t", "c"), F.col("v"))).collect()
    caps = spark.createDataFrame([(x,) for x in (30, 31, 40, 41)], "n int").select(V.output_cap(F.col("n")).alias("c")).collect()
    assert [r["c"] for r in caps] == [8192, 12288, 12288, 16384]


def test_detail_of_missing_values(spark):
    rows = spark.createDataFrame([(1, "odd", None, "q", None, None, 0.9, None, ["poor_context"])], "qa_id int, intent string, context string, q string, a string, avg_quality double, rag double, pass boolean, types array<string>")
    r = export.detail(rows.withColumn("pass", F.lit(False)), F.lit("now")).collect()[0]
    assert (r["intent"], r["context"], r["answer"], r["quality"], r["triad"], r["status"], r["failure"]) == ("odd", "", "", None, "0.90", "보류", "문맥부족")


def test_word_files_as_a_data_source(spark, tmp_path):
    from loomdoc.sources.files import docx_file, read_docx
    from loomdoc.sources.word import Files, WordReader, register

    (tmp_path / "in").mkdir()
    for i in range(7):
        (tmp_path / "in" / f"f{i}.docx").write_bytes(docx_file([(f"title {i}", "Heading2"), (" ", None), ("text\x01 <&>", None)]))
    (tmp_path / "bad.DOCX").write_bytes(b"PK no archive")
    (tmp_path / "empty.docx").write_bytes(docx_file([]))
    (tmp_path / "note.txt").write_text("not read")
    register(spark)
    load = lambda path, **o: spark.read.format("word_blocks").options(**o).load(path)
    rows = {(r["path"], r["block_idx"]): (r["text"], r["font_size"], r["is_table"], r["error"]) for r in load(str(tmp_path), partitionFiles="3").collect()}
    want = {(f"{tmp_path}/in/f{i}.docx", k): x for i in range(7) for k, x in enumerate([(f"title {i}", 16.0, False, None), ("text <&>", 11.0, False, None)])}
    error = rows.pop((f"{tmp_path}/bad.DOCX", None))
    assert rows == want and error[:3] == (None, None, None) and error[3].startswith("BadZipFile")
    assert {(r["path"].removeprefix("file:").replace("///", "/"), r["block_idx"]) for r in read_docx(spark, str(tmp_path / "in")).collect()} == set(want)
    one = f"{tmp_path}/in/f4.docx"
    assert load(one).count() == 2 and load(f"file://{tmp_path}").select("text").filter("text like 'title%'").count() == 7
    reader = WordReader(str(tmp_path), 1 << 20, 3)
    assert [len(p.paths) for p in reader.partitions()] == [3, 3, 3]
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    rest = list(reader.pushFilters([In(("path",), (one, "other")), GreaterThan(("block_idx",), 0), EqualTo(("path",), one)]))
    assert reader.partitions() == [Files([one])] and rest == [GreaterThan(("block_idx",), 0)]
    with pytest.raises(Exception, match="nowhere"):
        load(str(tmp_path / "nowhere")).collect()


def test_filters_spare_what_new_batches_need_not_read(spark, tmp_path):
    import shutil

    from loomdoc.functions.text import content_hash
    from loomdoc.streaming import seen
    from loomdoc.streaming.ingest import append_new

    path = f"file://{tmp_path}/table"
    chunks = lambda ids, d: spark.createDataFrame([(d, i, f"chunk number {x}") for i, x in enumerate(ids)], "document_id bigint, chunk_index int, content string").withColumn("content_hash", content_hash(F.col("content")))
    state = lambda: sorted((r["batch"], r["document_id"], r["content"]) for r in spark.read.parquet(f"{path}/batches").collect())
    assert append_new(chunks(range(2000), 1), path, 0) == []
    want = sorted((0, 1, f"chunk number {x}") for x in range(2000))
    assert state() == want
    # new chunks: hardly a prefix is read, of the 150 or more that they have
    assert len(append_new(chunks(range(5000, 5300), 1), path, 1)) < 20
    want = sorted(want + [(1, 1, f"chunk number {x}") for x in range(5000, 5300)])
    # stored ones are all found; under another document they are new
    read = append_new(chunks([*range(1990, 2000), 5000, 7000], 1), path, 2)
    assert 5 <= len(read) < 30
    append_new(chunks(range(5), 2), path, 3)
    want = sorted(want + [(2, 1, "chunk number 7000")] + [(3, 2, f"chunk number {x}") for x in range(5)])
    assert state() == want
    # a batch tried again comes to the same, also one larger than before
    append_new(chunks([*range(1990, 2000), 5000, 7000], 1), path, 2)
    append_new(chunks(range(5), 2), path, 3)
    assert state() == want
    append_new(chunks(range(200), 2), path, 3)
    assert len(list((tmp_path / "table" / "filters" / "batch=3").glob("words=*"))) == 1
    append_new(chunks(range(5), 2), path, 3)
    assert state() == want
    assert append_new(chunks([], 1), path, 4) == [] and state() == want
    # without the filter of an earlier batch all prefixes are compared
    shutil.rmtree(tmp_path / "table" / "filters" / "batch=0")
    assert len(append_new(chunks(range(100), 1), path, 5)) > 60 and state() == want
    keys = spark.range(20_000).select(F.col("id").alias("k"))
    seen.add(keys.filter("k < 10000"), ["k"], f"{path}/other", 0)
    got = seen.possible(keys, ["k"], f"{path}/other", 1)
    assert got.filter("k < 10000").count() == 10_000 and got.filter("k >= 10000").count() < 150
    assert seen.possible(keys, ["k"], f"{path}/other", 0).count() == 0
