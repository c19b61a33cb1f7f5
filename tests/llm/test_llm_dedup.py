import random

import numpy as np
import pytest
import xxhash

from loomdoc.llm import clusters, common, edited, graph, passages, simhash
from loomdoc.llm.bktree import BKTree


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) > len(hs) / 2)


def test_bk_tree_finds_what_a_scan_finds():
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(50)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(3)]
    tree = BKTree()
    for i, v in enumerate(values):
        tree.add(v, i)
    for v in values:
        for r in (0, 2, 5):
            assert sorted(tree.near(v, r)) == sorted(((v ^ w).bit_count(), i) for i, w in enumerate(values) if (v ^ w).bit_count() <= r)
    assert BKTree().near(1, 64) == []


@pytest.mark.parametrize("most", [512, 3])
def test_links_of_documents(spark, sf, most):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(1000, None), (1001, ""), (1002, "One"), (1003, "one"), (1004, "ONE two\x0bthree x four"), (1005, " \n"), (1005, " \n")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("fp", docs["doc_id"]).repartition(3)
    rows = docs.collect()
    marks = {r["doc_id"]: slow_fingerprint(r["text"] or "") for r in rows}
    sets, ids = Sets(marks), sorted(marks)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                sets.join(a, b)
    got = simhash.link_documents(docs, most=most).collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], f"{marks[r['doc_id']]:016x}", sets.root(r["doc_id"])) for r in rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, n_chars bigint")
    assert simhash.link_documents(docs).count() == simhash.drop_near_duplicates(docs).count() == passages.repeats(docs).count() == passages.drop_repeats(docs).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (-5, 3)] + [(500, k) for k in range(501, 600)]
    sets = Sets({x for e in edges for x in e})
    for a, b in edges:
        sets.join(a, b)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: sets.root(x) for e in edges if e[0] != e[1] for x in e}


def near_copies(rng, n, words=260):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def shingle_set(text):
    w = text.lower().split()
    return frozenset(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else frozenset([tuple(w)])


@pytest.mark.parametrize("most", [400, 6])
def test_one_document_of_each_group_stays(spark, most, monkeypatch):
    rng = random.Random(11)
    texts = near_copies(rng, 30) + near_copies(rng, 8) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(20)] + ["same text", "Same  text", "", "", None, "a b"]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id bigint, text string, _row string, n_chars bigint").repartition(4)
    monkeypatch.setattr(simhash.near_duplicate_groups, "__defaults__", (5, 0.8, 24, most))
    sets, own = Sets(range(len(texts))), [shingle_set(t or "") for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if own[a] == own[b] or len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
                sets.join(a, b)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({sets.root(i) for i in range(len(texts))})


def test_bands_meet_at_high_similarity():
    rng = random.Random(2)
    met = 0
    for _ in range(200):
        a = {rng.getrandbits(64) for _ in range(90)}
        b = set(list(a)[:85]) | {rng.getrandbits(64) for _ in range(5)}  # similarity about 0.89
        keys = clusters.band_keys([np.array(sorted(x), dtype=np.uint64) for x in (a, b)])
        met += bool((keys[0] == keys[1]).any())
    assert met >= 198


def test_repeated_passages(spark):
    rng = random.Random(9)
    para = lambda n: " ".join(f"p{rng.randrange(10**6)}" for _ in range(n)) + "."
    line, sentences = para(60), [para(14) for _ in range(5)]
    passage, near = " ".join(sentences), line.split()
    near[30] = "changed"
    clean = [para(40), para(70)]
    before = [para(60)[:-1], para(50)[:-1]]
    docs = spark.createDataFrame(
        [(1, f"{line}\n{clean[0]}", 0, "a"), (2, f"{clean[1]}\n{' '.join(near)}", 0, "a"), (3, f"{before[0]} {passage} and after.", 0, "b"), (4, f"{before[1]} {passage} the end", 0, "b"), (5, line.upper(), 0, "c"), (6, None, 0, "c"), (7, "short. line", 0, "c")],
        "doc_id bigint, text string, n_chars bigint, row string",
    )
    found = passages.repeats(docs).collect()
    whole = {(r["doc_id"], r["line"], r["keep"], r["first_doc_id"]) for r in found if r["from_unit"] < 0}
    assert whole == {(1, 0, True, 1), (2, 1, False, 1), (5, 0, False, 1)}
    inner = [r for r in found if r["from_unit"] >= 0]
    assert [(r["doc_id"], r["first_doc_id"]) for r in inner] == [(4, 3)] and 56 <= inner[0]["n_words"] <= 70
    left = {r["doc_id"]: r for r in passages.drop_repeats(docs).collect()}
    assert {i: left[i]["text"] for i in (1, 2, 3)} == {1: f"{line}\n{clean[0]}", 2: clean[1], 3: f"{before[0]} {passage} and after."}
    assert 5 not in left and left[6]["text"] is None and left[7]["text"] == "short. line"
    assert not any(s in left[4]["text"] for s in sentences[1:]) and left[4]["text"].startswith(before[1][:200]) and left[4]["text"].endswith("the end") and left[4]["n_chars"] == len(left[4]["text"])


def test_edit_distance_within_a_band():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(9))] for _ in range(2))
        rows = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        for most in range(5):
            assert edited.distance(a, b, most) == min(rows[-1][-1], most + 1)
        # ends: the longest start of one that ends in a word equal to its counterpart, a fifth changed at most
        a, b = ([rng.randrange(1, 4) for _ in range(12)] for _ in range(2))
        b[:7] = a[rng.randrange(2) :][:7]
        rows = {(i, j): max(i, j) if not i * j else 0 for i in range(13) for j in range(13)}
        for i in range(1, 13):
            for j in range(1, 13):
                rows[i, j] = min(rows[i - 1, j] + 1, rows[i, j - 1] + 1, rows[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        good = [(i, -rows[i - 1, j - 1]) for i in range(1, 13) for j in range(1, 13) if abs(i - j) <= edited.GAP and a[i - 1] == b[j - 1] and 5 * rows[i - 1, j - 1] <= i]
        length, changed = edited.ends(np.array([a, a], np.uint16), np.array([b, [0] * 12], np.uint16))
        assert (int(length[0]), -int(changed[0])) == max(good, default=(0, 0)) and length[1] == 0


def planted(changes, kind, n, rng):
    """Pairs of documents with a passage of 60 words, in the second with words replaced, dropped or put in, and the places of it there."""
    words = lambda k: [f"e{rng.randrange(10**6)}" for _ in range(k)]
    texts, places = [], []
    for _ in range(n):
        passage = words(60)
        near = [[w] for w in passage]
        for j in rng.sample(range(1, 59), changes):
            near[j] = words(1) if kind == "replaced" else [] if kind == "dropped" else near[j] + words(1)
        near = [w for x in near for w in x]
        texts += [words(100) + passage + words(100), words(100) + near + words(100)]
        places.append(range(100, 100 + len(near)))
    return texts, places


def test_edited_passages(spark):
    rng = random.Random(77)
    cases = [(c, kind) for c in (0, 1, 2, 3, 4) for kind in (("replaced", "dropped", "put in") if c else ("replaced",))]
    texts, places = [], []
    for c, kind in cases:
        own, at = planted(c, kind, 30, rng)
        texts += own
        places += at
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    rows = passages.repeats(docs).filter("from_unit >= 0").collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], set()).update(range(r["from_unit"], r["to_unit"] + 1))
        assert r["first_doc_id"] == r["doc_id"] - 1 and r["n_words"] == r["to_unit"] + 1 - r["from_unit"] and r["line"] == 0
    for k, case in enumerate(cases):
        own = range(30 * k, 30 * (k + 1))
        share = sum(len(found.get(2 * i + 1, set()) & set(places[i])) for i in own) / sum(len(places[i]) for i in own)
        assert share >= (1 if case[0] == 0 else 0.9), case
        assert all(found.get(2 * i + 1, set()) <= set(places[i]) for i in own)


def test_edited_passages_do_not_depend_on_the_batches(spark):
    rng = random.Random(5)
    texts, _ = planted(2, "replaced", 12, rng)
    texts = [" ".join(t[:90]) + "\n" + " ".join(t[90:]) for t in texts]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)] * 2, "doc_id bigint, text string")
    got = []
    for size, parts in ((1, 1), (7, 5), (10_000, 2)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got.append(sorted(tuple(r) for r in passages.repeats(docs.repartition(parts)).filter("from_unit >= 0").select("doc_id", "line", "from_unit", "to_unit").collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] == got[2] and len(got[0]) >= 10 and all(line == 1 for _, line, _, _ in got[0])


def test_passages_are_exact_wherever_they_are_cut(spark):
    # passages of 25 words and more, cut anywhere in long and in unpunctuated sentences, against a plain loop over all places
    rng = random.Random(21)
    prose = lambda n: [f"q{rng.randrange(10**6)}" + ("." if j % 20 == 19 else "") for j in range(n)]
    sources = [prose(150) for _ in range(6)] + [[f"z{rng.randrange(10**6)}" for _ in range(150)] for _ in range(6)]
    texts = [" ".join(x) for x in sources]
    for x in sources:
        for n in (24, 25, 40, 51):
            at = rng.randrange(150 - n)
            texts.append(" ".join(prose(rng.randrange(30, 60)) + x[at : at + n] + prose(rng.randrange(30, 60))))
    # the first copy of the start of a passage is not in the first copy of the passage; and places that overlap each other
    other = [f"v{rng.randrange(10**6)}" for _ in range(30)]
    texts += [" ".join(other[:10] + prose(40)), " ".join(prose(40) + other), " ".join(other + prose(50)), " ".join(["same"] * 60)]
    seen, want = set(), set()
    for i, t in enumerate(texts):
        w, covered = t.split(), set()
        for j in range(len(w) - 24):
            if (g := tuple(w[j : j + 25])) in seen:
                covered |= set(range(j, j + 25))
            seen.add(g)
        want |= {(i, p) for p in covered}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {(r["doc_id"], p) for r in passages.repeats(docs).filter("from_unit >= 0").collect() for p in range(r["from_unit"], r["to_unit"] + 1)}
    assert got == want and len({i for i, _ in want}) >= 38


def test_passages_in_short_lines_and_over_line_breaks(spark):
    rng = random.Random(4)
    words = lambda n: [f"s{rng.randrange(10**6)}" for _ in range(n)]
    passage, ends = words(60), [words(12) for _ in range(4)]
    wrap = lambda w, n: "\n".join(" ".join(w[j : j + n]) for j in range(0, len(w), n))
    docs = spark.createDataFrame(
        [(1, f"{' '.join(ends[0])}\n{wrap(passage, 7)}\n\n{' '.join(ends[1])}", 0), (2, f"{' '.join(ends[2])}\n\n{wrap(passage, 9)} {' '.join(ends[3])}", 0), (3, wrap(passage[:24], 5), 0), (4, wrap(passage[30:55], 5), 0)],
        "doc_id bigint, text string, n_chars bigint",
    )
    found = {(r["doc_id"], r["line"], r["n_words"], r["first_doc_id"], r["from_unit"], r["to_unit"]) for r in passages.repeats(docs).collect()}
    assert found == {(2, 2, 60, 1, 12, 71), (4, 0, 25, 1, 0, 24)}
    left = {r["doc_id"]: r["text"] for r in passages.drop_repeats(docs).collect()}
    assert left == {1: docs.first()["text"], 2: f"{' '.join(ends[2])}\n\n{' '.join(ends[3])}", 3: wrap(passage[:24], 5)}


def test_a_passage_outlives_a_paragraph_that_goes(spark):
    # the paragraph of document 2 goes as a near copy; the words in which it differs stay once, in document 3
    rng = random.Random(6)
    words = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    line, start = words(400), words(40)
    near = line[:200] + words(20) + line[200:]
    kept = " ".join(start + near[198:224])
    docs = spark.createDataFrame([(1, " ".join(line)), (2, " ".join(near)), (3, kept)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in passages.drop_repeats(docs).collect()} == {1: " ".join(line), 3: kept}


def test_near_copies_that_repeat_a_line_differently_often(spark):
    rng = random.Random(8)
    texts = []
    for n in (10, 30, 100) * 14:
        body, line = ([f"y{rng.randrange(10**6)}" for _ in range(k)] for k in (200, 10))
        texts += [" ".join(body + line), " ".join(body + line * n)]
    own = [shingle_set(t) for t in texts]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(own[::2], own[1::2]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == list(range(0, len(texts), 2))


def test_a_changed_word_does_not_split_a_passage(spark):
    rng = random.Random(33)
    words = lambda n: [f"g{rng.randrange(10**6)}" for _ in range(n)]
    passage, other = words(70), words(60)
    near, far = list(passage), list(passage)
    near[34:35] = ["new", "words"]  # one word for two
    far[30:40] = words(10)
    texts = [words(40) + passage + words(30), words(33) + near + words(20), words(20) + far + words(20), words(30) + other[:30] + words(40), words(35) + other[30:] + words(20), words(11) + other[:30] + ["x"] + other[30:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = sorted((r["doc_id"], r["from_unit"], r["to_unit"], r["first_doc_id"]) for r in passages.repeats(docs).filter("from_unit >= 0").collect())
    # two passages of two documents stay two, though a word apart
    assert got == [(1, 33, 103, 0), (2, 20, 49, 0), (2, 60, 89, 0), (5, 11, 40, 3), (5, 42, 71, 4)]


def test_runs_do_not_depend_on_the_batches(spark):
    rng = random.Random(8)
    rows = []
    for d in range(6):
        at = 0
        for _ in range(60):
            at += rng.choice([1, 1, 1, 5, 25, 26, 27, 28, 29, 40])
            rows.append((d * 7 - 9, at, 0, 7, d if d else None, 0, rng.randrange(2), rng.choice([0, 0, 0, 2, 9])))
    later = spark.createDataFrame(rows, "row bigint, at int, line int, gram bigint, doc_id bigint, first_doc_id bigint, of bigint, shift int")
    want, now = [], None
    for row, at, _, _, d, _, of, shift in rows:
        if now and now[0] == row and (at <= now[2] + 25 or at <= now[2] + 28 and of == now[3] and abs(shift - now[4]) <= 3):
            now[2:] = [at, of, shift]
        else:
            now = [row, at, at, of, shift]
            want.append(now)
    for size in (1, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = sorted((r["row"], r["from_unit"], r["to_unit"]) for r in passages.joined_runs(later).collect())
        assert got == sorted((d, a, z + 24) for d, a, z, _, _ in want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_copies_of_whole_texts(spark):
    rng = random.Random(14)
    words = lambda n: [f"c{rng.randrange(10**6)}" for _ in range(n)]
    lines = [words(10), words(40), words(20), words(20), words(12), words(30)]
    text = "\n".join(" ".join(x) for x in lines)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([text, text, "short text", "short text", text + " more", text])], "doc_id bigint, text string").repartition(2)
    got = [(r["doc_id"], r["line"], r["keep"], r["first_doc_id"], r["from_unit"], r["to_unit"]) for r in passages.repeats(docs).collect()]
    whole = [(d, k, d == 0, 0, -1, -1) for d in (0, 1, 4, 5) for k in (1, 5)]
    # lines that go hold words 10 to 49 and 102 to 131
    assert sorted(got) == sorted(whole + [(d, 0, False, 0, 0, 125) for d in (1, 4, 5)])
    assert {r["doc_id"]: r["text"] for r in passages.drop_repeats(docs).collect()} == {0: text, 2: "short text", 3: "short text"}


def test_nulls_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(12)
    text = " ".join(f"k{rng.randrange(10**6)}" for _ in range(80))
    rows = [(None, text, 1), (None, text, 2), (4, text + " end", 3), (4, text + " end", 3), (None, None, 4), (9, "", 5), (9, "", 5), (7, text.upper(), 6)]
    names = ["_row", "_gone", "row", "line", "_own", "key", "node", "again", "count"]
    docs = spark.createDataFrame([(*r, *[f"{c}{r[2]}" for c in names]) for r in rows], "doc_id bigint, text string, n_chars bigint, " + ", ".join(f"{c} string" for c in names))
    kept = simhash.drop_near_duplicates(docs)
    # null ids come first; one row stays of rows that are repeated, and of texts without words one
    assert kept.columns == docs.columns and sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in kept.collect()) == [("None", ""), ("None", text[:5])]
    left = passages.drop_repeats(docs)
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:5], r["_gone"]) for r in left.collect()) == [("9", "", "_gone5"), ("9", "", "_gone5"), ("None", "", "_gone4"), ("None", text[:5], "_gone1"), ("None", text[:5], "_gone2")]
    assert simhash.link_documents(docs).count() == len(rows)


def test_tables_of_a_block_are_cleared_but_the_one_taken_out(spark):
    with common.cleared() as made:
        gone, kept = (common.written(spark.range(n), "block") for n in (3, 5))
        assert made.pop() is kept
    outside = common.written(spark.range(2), "block")
    assert kept.count() == 5 and outside.count() == 2
    with pytest.raises(Exception):
        spark.read.schema(gone.schema).parquet(gone._written_at).count()
