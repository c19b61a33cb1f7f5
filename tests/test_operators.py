"""Operators on small tables of their own."""

import io
import json
import zipfile
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdoc.functions import text as T
from loomdoc.functions import vector as V
from loomdoc.operators import blocks, evaluate, export, sampling, similarity, store
from loomdoc.sources import files
from loomdoc.streaming import ingest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


def test_hash_keeps_circled_digits(spark):
    want = "d06f163387be4dae60d5217bb4f25ef48861b371"
    assert one(spark, "제1조 (목적) ① 이 법은", T.content_hash) == one(spark, "제1조(목적)①이 법은!", T.content_hash) == want
    assert one(spark, "ABC  def.", T.content_hash) == "1f8ac10f23c5b5bc1167bda84b833e5c057a77d2"


def test_contents_predicate(spark):
    for text, want in [
        ("제1장 총칙 ···· 1\n제2장 개인정보 보호 ···· 9", True),
        ("서론 ........ 3\n본론 ........ 12", True),
        ("목 차 1.1 배경 1.2 범위 2.1 방법 2.2 결과 3.1 결론", True),
        ("이 법은 개인정보의 처리 및 보호에 관한 사항을 정한다.", False),
        ("짧은 글 ····", False),
    ]:
        assert one(spark, text, T.is_contents) is want, text


def test_symbol_noise(spark):
    assert one(spark, "□" * 16, T.is_symbol_noise) is True
    assert one(spark, "| | | | | | | |", T.is_symbol_noise) is True
    assert one(spark, "■ a ■ ■ ■ ■", T.is_symbol_noise) is False


def failures(spark, g, r, c, n, quality=1.0):
    rows = spark.createDataFrame([(g, r, c, "x" * n, quality)], "groundedness double, relevance double, context_relevance double, context string, avg_quality double")
    return rows.select(evaluate.failure_types().alias("t")).select("t", evaluate.primary_failure(F.col("t")).alias("p")).first()


def test_failure_classes(spark):
    for args, types, primary in [
        ((0.3, 0.9, 1.0, 200), ["hallucination", "faithfulness_error", "retrieval_miss"], "hallucination"),
        ((0.3, 0.5, 1.0, 200), ["hallucination", "retrieval_miss"], "hallucination"),
        ((0.5, 0.9, 1.0, 200), ["faithfulness_error"], "faithfulness_error"),
        ((0.5, 0.5, 1.0, 200), ["retrieval_miss"], "retrieval_miss"),
        ((1.0, 1.0, 0.5, 200), ["poor_context"], "poor_context"),
        ((1.0, 1.0, 0.5, 50), ["poor_context", "bad_chunk"], "bad_chunk"),
        ((1.0, 1.0, 1.0, 200, 0.65), ["low_quality"], "low_quality"),
        ((0.6, 0.6, 0.6, 100), [], None),
        ((0.4, 0.6, 1.0, 200), ["faithfulness_error"], "faithfulness_error"),
    ]:
        row = failures(spark, *args)
        assert (row["t"], row["p"]) == (types, primary), args


def test_final_scores(spark):
    rows = spark.createDataFrame([(100.0, 5.0, 1.0, 1.0), (100.0, 5.0, 0.87, 0.6), (100.0, 5.0, 0.993, 0.967), (0.0, 5.0, 0.65, 0.65), (100.0, 5.0, 0.5, 0.5), (None, None, None, None)], "s double, t double, r double, q double")
    score = evaluate.final_score(F.col("s"), F.col("t"), F.col("r"), F.col("q"))
    got = [(round(x["v"], 4), x["g"]) for x in rows.select(score.alias("v")).select("v", evaluate.grade(F.col("v")).alias("g")).collect()]
    assert got == [(0.975, "A+"), (0.7905, "B+"), (0.9622, "A+"), (0.61, "C"), (0.525, "C"), (0.66, "B")]


def test_entropy_of_known_counts(spark):
    intents = [k for k, n in {"fact": 11, "how": 5, "list": 3, "purpose": 2, "condition": 2, "comparison": 1}.items() for _ in range(n)]
    assert evaluate.entropy(spark.createDataFrame([(x,) for x in intents], "i string"), "i").first()[0] == 2.151
    assert evaluate.entropy(spark.createDataFrame([], "i string"), "i").first()[0] == 0.0


def test_stride(spark):
    for n, total, numbers in [(30, 100, list(range(1, 89, 3))), (30, 29, list(range(1, 30))), (30, 61, list(range(1, 60, 2))), (10, 95, list(range(1, 83, 9)))]:
        rows = spark.range(total).select(F.lit(1).alias("g"), "id")
        assert sorted(r["rn"] for r in sampling.stride(rows, "g", "id", n).collect()) == numbers


def test_near_pairs_are_those_of_brute_force(spark):
    texts = ["tide", "diet", "", "", "수출액 1위 국가는 어디입니까?", "수출액 1위 국가는 무엇입니까?", "제1조의 목적은 무엇입니까?", "제2조의 목적은 무엇입니까?", "abc", "xyz", "abcabcabc"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "k int, i int, t string")
    for newer in (False, True):
        want = {(i, j) for j in range(len(texts)) for i in range(j) if SequenceMatcher(None, *((texts[j], texts[i]) if newer else (texts[i], texts[j]))).ratio() >= 0.5}
        assert {(r["older"], r["newer"]) for r in similarity.near_pairs(rows, "k", "i", "t", 0.5, newer).collect()} == want


def test_leaders_do_not_chain(spark):
    rows = spark.createDataFrame([(1, i) for i in range(4)], "k int, i int")
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3)], "k int, older int, newer int")
    assert {(r["i"], r["leader"]) for r in similarity.leaders(rows, pairs, "k", "i").collect()} == {(0, None), (1, 0), (2, None), (3, 2)}


@given(st.lists(st.text(min_size=1, max_size=50), max_size=20), st.integers(1, 60), st.integers(1, 120))
@settings(max_examples=60, deadline=None)
def test_merging_keeps_all_text(texts, least, most):
    found = blocks.merged(texts, least, most)
    assert "".join(t for _, t in found).replace("\n", "") == "".join(texts).replace("\n", "")


@given(st.lists(st.integers(0, 5000), max_size=40))
@settings(max_examples=60, deadline=None)
def test_batches_hold_their_limits(sizes):
    numbers = blocks.batched(sizes, 5, 4000)
    assert len(numbers) == len(sizes) and numbers == sorted(numbers)
    for b in set(numbers):
        own = [s for s, n in zip(sizes, numbers) if n == b]
        assert len(own) <= 5 and (len(own) == 1 or sum(own) <= 4000)


def test_absorbing_takes_the_longer_text():
    assert blocks.absorbed(["a b c", "a b c d", "x y"], 0.5) == [(0, "a b c d"), (2, "x y")]


def test_store_operators(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "b", None)], "id int, x string, y string")
    new = spark.createDataFrame([(2, None, "q"), (3, "c", "r")], "id int, x string, y string")
    assert {tuple(r) for r in store.upsert(old, new, ["id"]).collect()} == {(1, "a", "p"), (2, "b", "q"), (3, "c", "r")}
    assert {tuple(r) for r in store.patch(old, new.filter("id = 2"), "id", ["x"]).collect()} == {(1, "a", "p"), (2, None, None)}
    nulls = spark.createDataFrame([(None, "z")], "id int, x string")
    assert store.new_rows(nulls, nulls, ["id"]).count() == 1


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in rows.select(V.normalised(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r[0] for r in rows.select(V.cosine(F.col("v"), F.array(F.lit(3.0), F.lit(4.0)))).collect()] == [1.0, None]


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_word_documents(spark, tmp_path):
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    cell = lambda t: f"<w:tc><w:p>{run(t)}</w:p></w:tc>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run("Title")}</w:p><w:p>{run("Some ")}{run("text")}</w:p><w:tbl><w:tr>{cell("a")}{cell("a")}{cell("b")}</w:tr><w:tr>{cell("c")}</w:tr></w:tbl>'
    (tmp_path / "a.docx").write_bytes(docx(body))
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = files.read_docx(spark, str(tmp_path)).orderBy("path", "block_idx").collect()
    assert [(r["text"], r["font_size"], r["is_table"]) for r in rows[:3]] == [("Title", 18.0, False), ("Some text", 11.0, False), ("| a | b |\n\n| c |", 11.0, True)]
    assert rows[3]["error"].startswith("BadZipFile")
    assert files.unsupported(spark.createDataFrame([("x/a.docx",), ("x/b.exe",)], "path string")).collect()[0]["kind"] == "exe"


def test_page_blocks(spark):
    rows = [(1, 1, 100.0, 10.0, 20.0, 30.0, 22.0, "left", 10.0), (1, 1, 100.0, 60.0, 20.0, 80.0, 22.0, "right", 10.0), (1, 1, 100.0, 10.0, 40.0, 30.0, 42.0, "next", 12.0), (1, 1, 100.0, 10.0, 1.0, 30.0, 3.0, "header", 9.0), (1, 1, 100.0, 10.0, 95.0, 30.0, 97.0, "foot", 9.0)]
    spans = spark.createDataFrame(rows, "document_id int, page int, height double, x0 double, y0 double, x1 double, y1 double, text string, font_size double")
    assert [(r["block_idx"], r["text"]) for r in files.page_blocks(spans).orderBy("block_idx").collect()] == [(0, "left | right"), (1, "next")]


def test_texts_and_json(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first()["text"] == "one\ntwo"
    (tmp_path / "d.json").write_text(json.dumps({"documents": [{"id": 2, "t": "b"}, {"id": 1, "t": "a"}]}))
    assert [r["t"] for r in files.read_json(spark, str(tmp_path / "d.json"), 1).collect()] == ["a"]


def test_incremental_ingest(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for texts in ([(1, "a\nb\na"), (2, "a")], [(1, "b\nc"), (3, None)]):
        spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark.readStream.schema("doc_id bigint, text string").parquet(source), table, str(tmp_path / "marks")).awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{table}/batches").collect()
    assert sorted((r["document_id"], r["content"]) for r in rows) == [(1, "a"), (1, "b"), (1, "c"), (2, "a")]


def test_exports(spark):
    rows = spark.createDataFrame([("x", 0.8765, None), ("y", 0.5, 1.0)], "id string, a double, b double")
    assert [json.loads(r["json"]) for r in export.json_rows(rows, ["a", "b"]).collect()] == [{"id": "x", "a": "0.88"}, {"id": "y", "a": "0.50", "b": "1.00"}]
    plan = export.deletion_plan(rows.select("id"), "id", "t").collect()
    assert [r["statement"] for r in plan] == ["DELETE FROM t WHERE id IN ('x', 'y');"]


def test_line_joining(spark):
    def plain(text):
        out = []
        for line in (x.strip() for x in text.split("\n")):
            last = out[-1] if out else ""
            if line and last and last[-1] not in ".!?。" and line[0] not in "-•|[#" and not line[0].isdigit():
                out[-1] = f"{last} {line}"
            else:
                out.append(line)
        return "\n".join(out).strip()

    for text in ["a\nb.\nc\n\n d\n- e\nf\n1 g", "", "x\n\n\ny", "•  item\n* two\nl three\n□ box ☑ on ⋮"]:
        got = one(spark, text, T.join_lines)
        assert got.strip() == plain(text)
    assert one(spark, "•  item\n□  box ☑ on⋮", T.normalised) == "- item\n[ ] box [v] on"


def test_sections(spark):
    texts = [("intro", 10.0), ("1.1 Scope", 11.0), ("body", 10.0), ("Big title", 16.0), ("more", 10.0), ("Bigger", 18.0), ("x", 10.0), ("제3조(목적) text", 10.0), ("(가) no", 20.0), ("2023", 30.0)]
    rows = spark.createDataFrame([(1, i, t, f) for i, (t, f) in enumerate(texts)], "d int, i int, t string, f double")
    got = [(r["section_id"], r["level"], r["heading"]) for r in blocks.sections(rows, "d", "i", "t", "f").orderBy("i").collect()]
    assert got == [(0, 0, "Root"), (1, 2, "1.1 Scope"), (1, 2, "1.1 Scope"), (2, 3, "Big title"), (2, 3, "Big title"), (3, 4, "Bigger"), (3, 4, "Bigger"), (4, 2, "제3조(목적) text"), (4, 2, "제3조(목적) text"), (4, 2, "제3조(목적) text")]


def test_block_folds():
    assert blocks.paired(["1", "작성 배경", "text", "-", "2"]) == [(0, "1 작성 배경"), (2, "text"), (3, "- 2")]
    assert blocks.chunked(["제1조 a", "b", "제2조 c"]) == ["제1조 a\nb", "제2조 c"]
    assert blocks.chunked(["x" * 880, "y" * 30, "말한다."]) == ["x" * 880, "y" * 30 + "\n말한다."]
    assert blocks.chunked(["x" * 895, "말한다."]) == ["x" * 895 + "\n말한다."]
    assert blocks.chunked(["p" * 160, "① q", "② r"]) == ["p" * 160, "① q\n② r"]
    assert blocks.merged_forward([("a", [2]), ("b" * 200, [1]), ("c", [3])]) == [("a\n" + "b" * 200 + "\nc", [1, 2, 3])]
    assert blocks.merged_forward([("a", [1])]) == [("a", [1])]
    assert blocks.conjunctions_moved(["앞 문장. 또한", "뒤 문장, 그러나", "끝 따라서"]) == ["앞 문장.", "또한 뒤 문장", "그러나 끝 따라서"]
    assert blocks.table_text([["a", "b"], ["1", None], [None, "2"], [None, None]]) == "[표]\n| a | b |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |"
    assert blocks.table_text([["Title", None], [None, None]]) == "Title" and blocks.table_text([]) == ""


@given(st.lists(st.text(alphabet="ab 제1조①.", max_size=300), max_size=12))
@settings(max_examples=60, deadline=None)
def test_chunking_keeps_all_blocks(texts):
    found = blocks.chunked(texts)
    assert "\n".join(found).split() == "\n".join(texts).split()


def test_titles_and_footers(spark):
    rows = spark.createDataFrame([("T\nrest", "T"), ("T", "T"), ("7. x\nrest", "7. x"), ("a\n12\nhead\nb", "z")], "t string, s string")
    assert [r[0] for r in rows.select(T.without_title(F.col("t"), F.col("s"))).collect()] == ["rest", "T", "7. x\nrest", "a\n12\nhead\nb"]
    assert one(spark, "a\n12\nhead\nb\n1234", lambda t: T.without_footers(t, F.array(F.lit("head")))) == "a\nb\n1234"
    assert one(spark, "이 법은 개인정보의 처리에 관한 사항을 정한다", T.is_admin) is False and one(spark, "2023-01-01 AB-12", T.is_admin) is True


def test_verdicts(spark):
    from loomdoc.functions import verdicts

    rows = ['{"relevance": 8.9, "groundedness": 12, "context_relevance": -1}', '```json\n{"relevance": 3}\n```', "no json", "", '{"completeness": 7.5, "coverage": 1.4}']
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    assert [tuple(r[0]) for r in df.select(verdicts.triad(F.col("t"))).collect()] == [(0.8, 1.0, 0.0), (0.3, 0.6, 0.6), (0.65,) * 3, (0.65,) * 3, (0.6,) * 3]
    assert [tuple(r[0]) for r in df.select(verdicts.completeness(F.col("t"))).collect()] == [(0.5, 0.5)] * 4 + [(0.75, 1.4)]
    answers = ['{"qa_list": [{"q": "a?", "a": "b", "x": 1}]}', '[{"q": "c?"}]', 'Sure: {"qa_list": [{"q": "d?", "a": "e"}]} done', "nothing"]
    df = spark.createDataFrame([(x,) for x in answers], "t string")
    assert [[(p["q"], p["a"]) for p in r[0]] for r in df.select(verdicts.qa_list(F.col("t"))).collect()] == [[("a?", "b")], [("c?", None)], [("d?", "e")], []]
    assert one(spark, "Gemini-2.5", verdicts.provider) == "google"


def test_equal_questions_are_resolved_as_one(spark, monkeypatch):
    texts = ["what is a loom", "what is the loom", "who wove it", "what is a loom", None, "", "who wove this", "what was a loom", ""] * 3
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(None, 100, "x"), (None, 101, "x"), (2, 102, "who wove it")], "k bigint, i bigint, t string")
    for newer in (False, True):
        want = similarity.leaders(rows, similarity.near_pairs(rows, "k", "i", "t", 0.7, newer), "k", "i")
        seen, whole = [], similarity.near_pairs
        monkeypatch.setattr(similarity, "near_pairs", lambda own, *rest: seen.append(own.count()) or whole(own, *rest))
        got = similarity.near_leaders(rows, "k", "i", "t", 0.7, newer)
        monkeypatch.undo()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert seen == [9]
