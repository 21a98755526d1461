"""Line-list operators on small tables with known results."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from casegrid.functions import nulls, text
from casegrid.operators import client, compare, dedupe, extract, graph, match, metrics, prompt, provenance
from casegrid.plans import pipeline
from casegrid.schema import COLUMNS, LINELIST, align
from casegrid.sources import files


def one(df):
    return df.collect()[0].asDict()


def cell(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "a, b, column, want",
    [
        ("ABC001, ABC002", "ABC002; ABC001", "contacts", True),
        ("ABC001", "ABC002", "contacts", False),
        ("[]", "", "contacts", True),
        ("unknown", "none", "contacts", True),
        ("abc001", "ABC001", "contacts", False),
        ("Jane Doe", "Doe Jane", "name", True),
        ("Jane Doe", "Alice Smith", "name", False),
        ("doe", "john doe smith", "name", True),
        ("Village-A", "village a", "residence_village", True),
        ("Village-A", "Village-B", "residence_village", False),
        ("Bénin", "benin", "province", True),
        (None, "x", "sex", False),
        (None, " NULL ", "sex", True),
    ],
)
def test_cells_match(spark, a, b, column, want):
    assert cell(spark, text.cells_match("a", "b", column), a=a, b=b) is want


def test_null_kinds(spark):
    rows = [(None,), ("",), (" null ",), ("null",), ("NULL",), ("[]",), ("NA",), ("x",)]
    df = spark.createDataFrame(rows, "v string")
    got = [tuple(bool(x) for x in r) for r in df.select(nulls.null_like("v"), nulls.no_name("v"), nulls.no_key_name("v"), nulls.no_reference("v"), nulls.no_value("v"), F.coalesce(nulls.some("v"), F.lit(False))).collect()]
    assert got == [
        (True, True, True, True, True, False), (True, True, True, True, True, False), (True, False, False, True, True, True), (True, True, True, True, True, False),
        (True, False, True, True, True, False), (True, False, False, True, False, True), (False, False, False, True, True, True), (False, False, False, False, False, True),
    ]


def sellers(p, x, k):
    row = [0] * (len(x) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(x):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row) <= k


def test_near_is_approximate_substring(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))), "".join(rng.choice("abc ") for _ in range(rng.randint(1, 12)))) for _ in range(300)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.near(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r["x"] == sellers(r["a"], r["b"], -(-len(r["a"]) // 5)) for r in got)


def test_alignment_first_alias_wins(spark):
    df = align(spark.createDataFrame([("A", "B", "v", 1)], "ID string, Case_ID string, Village string, Other int"))
    assert df.columns == ["case_id", "residence_village", "Other"] and df.first()["case_id"] == "A"


def lists(spark):
    llm = spark.createDataFrame([(0, "ABC001", "Doe Jane", "V1"), (1, "ABC002", "Smith John", "V2")], "row_idx int, case_id string, name string, residence_village string")
    gt = spark.createDataFrame([(0, "ABC001", "Jane Doe", "V1"), (1, "ABC002", "John Smith", "V9")], "row_idx int, Case_ID string, patient_name string, village string")
    return llm, gt


def test_compare(spark):
    out = compare.compare_linelists(*lists(spark))
    assert out["structure"]["shared"] == ["case_id", "name", "residence_village"]
    d = one(out["case_detection"])
    assert (d["true_positives"], d["false_positives"], d["false_negatives"], d["f1_score"]) == (2, 0, 0, 1.0)
    by = {r["column"]: r for r in out["column_metrics"].collect()}
    assert by["residence_village"]["f1_score"] == 0.5 and by["name"]["f1_score"] == 1 and one(out["overall"])["n_columns_compared"] == 3
    assert [tuple(r) for r in out["error_breakdown"].collect()] == [("residence_village", "Content Mismatch", 1)]


def test_extra_and_missed_cases(spark):
    llm = spark.createDataFrame([(0, "Jane Doe"), (1, "xy"), (2, None), (3, "Someone Else")], "row_idx int, name string")
    gt = spark.createDataFrame([(0, "Jane Doe"), (1, "Missing Person"), (2, "")], "row_idx int, name string")
    m = match.greedy_match(llm, gt)
    assert {r["llm_idx"]: r["category"] for r in compare.fp_analysis(llm, m).collect()} == {1: "Noise/Fragment", 2: "Empty/Null Name", 3: "Hallucination / Extra Extraction"}
    assert {r["gt_idx"]: r["category"] for r in compare.fn_analysis(gt, m).collect()} == {1: "Missed Case", 2: "Empty GT Name"}


def test_empty_cells_agree_in_every_column(spark):
    base = {c: None for c in COLUMNS} | {"name": "Jane Doe", "case_id": "ABC001", "age": 3.0}
    lists_ = ("potential_infector", "most_probable_infector", "contacts", "secondary_cases")
    a, b = base | {c: "[]" for c in lists_}, base | {c: "" for c in lists_}
    make = lambda r: spark.createDataFrame([tuple(r[c] for c in COLUMNS)], LINELIST).withColumn("row_idx", F.lit(0))
    out = compare.compare_linelists(make(a), make(b))["column_metrics"].collect()
    assert len(out) == 19 and all(r["f1_score"] == 1 for r in out)


def greedy(llm, gt):
    tok = lambda n: {w for w in n.split() if len(w) > 2}
    used, out = set(), []
    for i, a in enumerate(llm):
        best = max(((len(tok(a) & tok(b)) / len(tok(a) | tok(b)), -j) for j, b in enumerate(gt) if j not in used and tok(a) and tok(b)), default=(0, 0))
        if best[0] >= 0.5:
            used.add(-best[1])
            out.append((i, -best[1]))
    return out


def test_greedy_order_and_runs(spark):
    rng = random.Random(3)
    names = "ann bob cyd dee eve fay".split()
    runs = {r: ([" ".join(rng.sample(names, rng.randint(1, 3))) for _ in range(25)], [" ".join(rng.sample(names, rng.randint(1, 3))) for _ in range(20)]) for r in "pq"}
    frame = lambda k: spark.createDataFrame([(r, i, n) for r, x in runs.items() for i, n in enumerate(x[k])], "run string, row_idx int, name string")
    got = sorted((r["run"], r["llm_idx"], r["gt_idx"]) for r in match.greedy_match(frame(0), frame(1), by=("run",)).collect())
    assert got == sorted((r, i, j) for r, x in runs.items() for i, j in greedy(*x))


def test_case_metrics(spark):
    gt = spark.createDataFrame([(0, "A1", "Ann", "2026-01-01"), (1, "A2", "Bob", None)], "row_idx int, case_id string, name string, onset_date string")
    llm = spark.createDataFrame([(0, "A1", "Ann", "2026-01-01"), (1, "A9", "Cyd", None)], gt.schema)
    got = one(metrics.case_metrics(llm, gt))
    assert (got["n_matched_cases"], got["n_gt_cases"], got["n_llm_cases"], got["case_f1"], got["date_accuracy"]) == (1, 2, 2, 0.5, 1.0)
    other = llm.withColumn("case_id", F.concat(F.lit("z"), "case_id"))
    by_name = one(metrics.case_metrics(other, gt))
    assert by_name["n_matched_cases"] == 1 and by_name["date_accuracy"] == 1.0
    none = one(metrics.case_metrics(llm.limit(0), gt))
    assert none["case_f1"] == 0 and none["date_accuracy"] is None
    assert one(metrics.case_metrics(llm, gt, ["A1"]))["n_gt_cases"] == 1


def test_variable_metrics(spark):
    s = "row_idx int, case_id string, name string, residence_village string, potential_infector string, secondary_cases string"
    gt = spark.createDataFrame([(0, "ABC001", "Jane Doe", "V1", None, "ABC002"), (1, "ABC002", "John Roe", "V2", "ABC001", None)], s)
    llm = spark.createDataFrame([(0, "ABC001", "Jane Doe", "V1", None, "John Roe")], s)
    out = {r["variable"]: r for r in metrics.variable_metrics(llm, gt, variables=("name", "residence_village", "potential_infector", "secondary_cases")).collect()}
    assert out["name"]["recall"] == 0.5 and out["name"]["precision"] == 1
    assert out["secondary_cases"]["f1"] == 1 and out["secondary_cases"]["n_match"] == 1  # a name stands for its case's id
    assert out["potential_infector"]["recall"] == 0.5 and out["potential_infector"]["precision"] == 1


@pytest.mark.parametrize("g, x, want", [(None, "[]", (1, 1, 1)), (None, "ABC001", (0, 1, 0)), ("ABC001", None, (1, 0, 0)), ("ABC001, ABC002", "abc001", (1, 0.5, 2 / 3)), ("ABC001", "ABC002", (0, 0, 0))])
def test_list_metrics(spark, g, x, want):
    df = spark.createDataFrame([(g, x)], "g string, x string")
    r = one(metrics.with_list_metrics(df, "g", "x"))
    assert (r["list_precision"], r["list_recall"]) == want[:2] and abs(r["list_f1"] - want[2]) < 1e-12


def test_replicates(spark):
    rows = [("m", "p", True, i, s, 1, f, 0.5, 20.0, n) for i, (s, f, n) in enumerate([("Success", 0.4, 10), ("Success", 0.8, 0), ("Error", None, 5)])]
    runs = spark.createDataFrame(rows, "model string, provider string, use_chunking boolean, replicate int, status string, attempts int, case_f1 double, case_recall double, time_total_sec double, n_llm_cases int")
    table = metrics.metrics_rows(runs)
    got = table.orderBy("replicate").collect()
    assert len(table.columns) == 21 and got[0]["strategy"] == "Chunked" and got[0]["time_per_case_sec"] == 2 and got[1]["time_per_case_sec"] is None and got[2]["time_total_sec"] is None
    agg = one(metrics.aggregate_replicates(table))
    assert len(agg) == 77 and agg["n_replicates"] == 2 and abs(agg["case_f1_q25"] - 0.5) < 1e-9 and agg["case_f1_range"] == "60% (40-80)" and agg["secondary_f1_range"] == "NA% (NA-NA)"
    assert agg["case_f1_iqr_str"] == "60% [IQR: 50-70]"


@pytest.mark.parametrize(
    "response, want",
    [
        ('x <linelist>[{"case_id":"abc001","contacts":["abc002","ABC002",null,"null"]}]</linelist>', [("ABC001", "ABC002")]),
        ('```json\n[{"case_id":"a1"}]\n``` and ```json\n{"linelist":[{"case_id":"a2"}]}\n```', [("A2", None)]),
        ('<linelist>{"case_id":"a1"},{"case_id":"a2"}]</linelist>', [("A1", None), ("A2", None)]),
        ('<linelist>[{"case_id":"a1"}</linelist>', [("A1", None)]),
        ('<linelist>{"case_id":"a1"}</linelist>', []),
        ('<linelist></linelist> ```json\n[{"case_id":"a1"}]\n```', []),
        ("nothing", []),
        (None, []),
    ],
)
def test_parse(spark, response, want):
    df = spark.createDataFrame([(1, response)], "doc_id int, response string")
    assert [(r["case_id"], r["contacts"]) for r in extract.parse_responses(df).orderBy("row_idx").collect()] == want


def test_merge_duplicates(spark):
    rows = [(0, None, "Jane Doe", "01/01/2026", "null"), (1, "abc001", "doe jane", "01/01/2026", "f"), (2, "ABC001", "Jane  DOE", "01/01/2026", None), (3, "X1", None, None, "m"), (4, " x1 ", "", None, None), (5, None, None, None, "q")]
    got = sorted((str(r["case_id"]), r["sex"]) for r in dedupe.merge_duplicates(spark.createDataFrame(rows, "row_idx int, case_id string, name string, onset_date string, sex string")).collect())
    assert got == [("ABC001", "f"), ("None", "q"), ("X1", "m")]


def test_graph(spark):
    df = spark.createDataFrame([("A", "Ann", "F", "B, C", '["D"]', "E", None), ("B", None, None, None, None, None, "A")], "case_id string, name string, sex string, contacts string, secondary_cases string, potential_infector string, most_probable_infector string")
    rel = graph.relationships(df)
    assert {tuple(r) for r in rel.collect()} == {("A", "B", "contact"), ("A", "C", "contact"), ("A", "D", "secondary_case"), ("E", "A", "potential_infector"), ("A", "B", "most_probable_infector")}
    nodes = {r["id"]: r["group"] for r in graph.nodes(df, rel).collect()}
    assert nodes == {"A": "Female", "B": "Referenced only", "C": "Referenced only", "D": "Referenced only", "E": "Referenced only"}
    assert {(r["arrows"], r["dashes"]) for r in graph.edges(rel).collect()} == {("", True), ("to", False)}
    assert graph.edges(rel.limit(0)).count() == 0 and graph.link_closure(rel).count() == 8 and graph.missing_mirrors(rel).count() == 2


def test_source_index(spark):
    content = "SYN0 first\n- SYN001 (Ann) met SYNSYN2.\n\n  - Secondary: SYN003x saw SYN001\nend é😀 SYN9"
    docs = spark.createDataFrame([(1, content), (2, ""), (3, "no header SYN1")], "doc_id int, content string")
    rec = provenance.source_records(docs).orderBy("start").collect()
    assert [r["case_id"] for r in rec] == ["SYN001", "SYN003X"] and rec[0]["end"] + 1 == rec[1]["start"] and rec[1]["end"] == len(content)
    men = provenance.source_mentions(docs, provenance.source_records(docs)).orderBy("start").collect()
    assert [content[m["start"] - 1 : m["end"]].upper() for m in men] == [m["case_id"] for m in men] == ["SYN001", "SYNSYN2", "SYN003X", "SYN001", "SYN9"]
    assert [m["record_case_id"] for m in men] == ["SYN001", "SYN001", "SYN003X", "SYN003X", "SYN003X"]


def test_cells_are_located(spark):
    content = "- SYN1 (Ann Lee), female, onset 5 March 2026, met SYN2 and SYN3.\n- SYN2 (Bob)"
    docs = spark.createDataFrame([(1, content)], "doc_id int, content string")
    cases = spark.createDataFrame([(1, 0, "SYN1", "Ann Lee", "female", "05/03/2026", "SYN2, SYN3", "SYN2, SYN9", None)], "doc_id int, row_idx int, case_id string, name string, sex string, onset_date string, contacts string, secondary_cases string, outcome string")
    got = {}
    for r in provenance.cell_matches(cases, docs, ["name", "sex", "onset_date", "contacts", "secondary_cases", "outcome"]).orderBy("start").collect():
        got.setdefault(r["field"], []).append(content[r["start"] - 1 : r["end"]])
    assert got == {"name": ["Ann Lee"], "sex": ["female"], "onset_date": ["5 March 2026"], "contacts": ["SYN2", "SYN3"], "outcome": ["SYN1"]}


def test_case_spans_and_blocks(spark):
    content = "intro\n\nCase ABC001 is here. " + "x" * 3000
    docs = spark.createDataFrame([(1, content)], "doc_id int, content string")
    cases = spark.createDataFrame([(1, 0, "ABC001", None), (1, 1, "zz", "CASE"), (1, 2, None, "absent")], "doc_id int, row_idx int, case_id string, name string")
    got = {r["row_idx"]: r for r in provenance.case_spans(cases, docs).collect()}
    assert set(got) == {0, 1} and content[got[0]["start_char_index"] :].startswith("Case ABC001") and got[0]["cited_text"].startswith("ABC001") and len(got[0]["cited_text"]) == 401
    blocks = spark.createDataFrame([(1, 0, "abc"), (1, 1, None), (1, 2, "de")], "doc_id int, pos int, text string")
    assert [(r["start"], r["end"]) for r in provenance.block_offsets(blocks).orderBy("pos").collect()] == [(0, 3), (3, 3), (3, 5)]


def test_highlight(spark):
    df = spark.createDataFrame([("a<b>&cd", [(2, 3), (3, 4), (6, 6)])], "t string, s array<struct<start:int,end:int>>")
    assert df.select(provenance.highlight(F.col("t"), F.col("s")).alias("h")).first()["h"] == "a<mark>&lt;b</mark>&gt;&amp;<mark>c</mark>d"


def test_prompts(spark):
    assert cell(spark, prompt.bind("a {{content}} b {content}", "c"), c=r"x\1{{content}}") == r"a x\1{{content}} b {content}"
    assert cell(spark, prompt.insert_examples(F.col("t"), F.col("e")), t="p <outbreak_report> q", e="EX") == "p EX\n<outbreak_report> q"
    assert cell(spark, prompt.insert_examples(F.col("t"), F.col("e")), t="p", e=" ") == "p"
    assert cell(spark, prompt.sample_words("c", 2), c="  a \n b  c ") == "a b"
    assert cell(spark, prompt.instructions("c"), c="Rules\n\nHere is the outbreak narrative to analyse:\nx") == "Rules"
    row = spark.createDataFrame([("gpt-4o", 1_000_000, 100_000), ("none", 1, 1)], "m string, a bigint, b bigint").select(prompt.cost(F.col("m"), F.col("a"), F.col("b")).alias("x")).collect()
    assert row[0]["x"] == 3.5 and row[1]["x"] is None


def test_clients():
    http = client.HttpClient("claude", "m")
    assert http.request("hi")[2]["messages"][0]["content"] == "hi" and "temperature" not in client.HttpClient("azure").request("x")[2]
    assert http.answer("abcde", {"content": [{"text": "t"}], "usage": {"input_tokens": 3, "output_tokens": 4}}) == {"text": "t", "prompt_tokens": 3, "completion_tokens": 4}
    assert client.HttpClient("ollama").answer("abcde", {"response": "abcd"})["prompt_tokens"] == 2
    assert client.HttpClient("gemini").answer("a", {"candidates": [{"content": {"parts": [{"text": "x"}, {"text": "y"}]}}]})["text"] == "xy"
    assert client.CommandClient(["echo"]).call("p")["text"].startswith("@")
    with pytest.raises(RuntimeError):
        client.CommandClient(["false"]).call("p")
    with pytest.raises(ValueError, match="AZURE_OPENAI_ENDPOINT, AZURE_OPENAI_API_KEY"):
        client.require_env("azure")
    assert client.blocks([{"type": "text", "text": "ab", "citations": [{"cited_text": "q"}]}, {"type": "x"}, {"type": "text", "text": "c"}])[1]["start"] == 2


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, "- SYN1 (Ann Lee)\n- SYN2 (Bob)"), (2, "nothing")], "doc_id int, content string")
    fake = client.FakeClient({"SYN1": '<linelist>[{"case_id":"syn1","name":"Ann Lee","contacts":["SYN2"]},{"case_id":"syn1","name":"Lee Ann"},{"case_id":"SYN2","name":"Bob"}]</linelist>'})
    out = pipeline.run(docs, "t {{content}}", fake, model="gpt-4o")
    assert sorted(r["case_id"] for r in out["linelist"].collect()) == ["SYN1", "SYN2"]
    assert out["relationships"].count() == 1 and out["nodes"].count() == 2 and out["mentions"].count() == 2
    assert {(r["doc_id"], r["value"]) for r in out["metadata"].filter("metric = 'cases_extracted'").collect()} == {(1, "2"), (2, "0")}


def test_files(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in (" one", "", "two ")) + "</w:body></w:document>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.docx").write_bytes(raw.getvalue())
    (folder / "b.TXT").write_text("plain é")
    (folder / "c.pdf").write_bytes(b"p1|p2")
    got = {r["label"]: (r["content"], r["content_type"]) for r in files.read_documents(spark, str(folder), pdf=lambda b: b.decode().split("|")).collect()}
    assert got == {"a.docx": ("one\n\ntwo", "markdown"), "b.TXT": ("plain é", "text"), "c.pdf": ("p1\np2", "text")}
    with pytest.raises(Exception, match="no PDF reader"):
        files.read_documents(spark, str(folder), pdf=None).collect()
    with pytest.raises(ValueError):
        files.pasted_document(spark, "  ")
    df = spark.createDataFrame([("A", 'x "q", y', None, ["u", "v"])], "case_id string, name string, sex string, ids array<string>")
    files.write_csv(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first()
    assert (back["name"], back["sex"], back["ids"]) == ('x "q", y', "NA", "u, v")
    assert files.cached_result(spark, str(tmp_path / "none")) is None
    assert files.cached(df, str(tmp_path / "cache")).count() == 1 and files.cached_result(spark, str(tmp_path / "cache")) is not None


def test_stream(spark, tmp_path):
    from casegrid.streaming.responses import write_stream

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, '<linelist>[{"case_id":"a1","contacts":["b1"]}]</linelist>')], "doc_id int, response string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, response string").parquet(str(tmp_path / "in"))
    write_stream(stream, str(tmp_path / "rows"), str(tmp_path / "links"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1 and spark.read.parquet(str(tmp_path / "links")).count() == 1


def test_templates_and_prompt_files(spark, tmp_path):
    assert "{{content}}" in files.template()
    with pytest.raises(FileNotFoundError):
        files.template_path("none.txt")
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id int, content string")
    first = files.write_prompt(docs, str(tmp_path / "p"), "azure", words=2).first()["prompt"]
    assert "a b" in first and "a b c" not in first and "gpt-5" in first
    assert files.write_prompt(docs, str(tmp_path / "p"), "openai").first()["prompt"] == first
    assert files.write_prompt(docs, str(tmp_path / "p"), "openai", again=True).first()["prompt"] != first


def test_fill_citations_and_approval(spark):
    docs = spark.createDataFrame([(1, "Case A1 and case B2")], "doc_id int, content string")
    cases = spark.createDataFrame([(1, 0, "A1", None), (1, 1, "B2", None)], "doc_id int, row_idx int, case_id string, name string")
    cited = spark.createDataFrame([(1, 0, "given", 0, 3)], "doc_id int, row_idx int, cited_text string, start_char_index int, end_char_index int")
    got = {r["row_idx"]: r["cited_text"] for r in provenance.fill_citations(cited, cases, docs).collect()}
    assert got == {0: "given", 1: "B2"}
    client.require_approval("ollama", False)
    with pytest.raises(PermissionError):
        client.require_approval("claude", False)


def test_variable_metrics_by_name_and_without_true_cases(spark):
    s = "row_idx int, case_id string, name string, sex string"
    gt = spark.createDataFrame([(0, "ABC001", "Jane Doe", "f"), (1, "ABC002", "John Roe", "m"), (2, "ABC003", None, "f")], s)
    llm = spark.createDataFrame([(0, "X1", "Doe Jane", "f"), (1, "X2", "john ROE", "f"), (2, None, None, "f")], s)
    out = {r["variable"]: r for r in metrics.variable_metrics(llm, gt, variables=("name", "sex")).collect()}
    assert (out["name"]["n_match"], out["sex"]["n_match"], out["sex"]["n_compared"]) == (2, 1, 2)
    none = metrics.variable_metrics(llm, gt.limit(0), variables=("name", "sex")).collect()
    assert [tuple(r)[1:] for r in none] == [(0, 0, None, None, None, None, None)] * 2
    half = metrics.variable_metrics(llm.withColumn("case_id", F.when(F.col("row_idx") == 0, "ABC001").otherwise(F.col("case_id"))), gt, variables=("sex",)).first()
    assert half["n_compared"] == 1  # an id matches, so no name does


def test_citations_are_searched_first_and_ids_are_whole(spark):
    content = "- SYN1 (Ann) met SYN20 and SYN2. Ann was ill.\nSYN1 died in Kessi. Kessi is far."
    docs = spark.createDataFrame([(1, content)], "doc_id int, content string")
    cases = spark.createDataFrame([(1, 0, "syn1", "Ann", "SYN2", "Upper Kessi", None)], "doc_id int, row_idx int, case_id string, name string, contacts string, residence_village string, outcome string")
    at = content.index("\n") + 1
    cited = spark.createDataFrame([(1, 0, 5, 3), (1, 0, at, at + 25), (1, 0, 0, 9999)], "doc_id int, row_idx int, start_char_index int, end_char_index int")
    fields = ["contacts", "residence_village", "outcome"]
    place = lambda c: {r["field"]: (r["start"] - 1, content[r["start"] - 1 : r["end"]]) for r in provenance.cell_matches(cases, docs, fields, c).collect()}
    assert place(None) == {"contacts": (content.index("SYN2."), "SYN2"), "residence_village": (content.index("Kessi"), "Kessi"), "outcome": (2, "SYN1")}
    assert place(cited)["outcome"] == (at, "SYN1") and place(cited)["residence_village"] == (content.index("Kessi"), "Kessi")


def test_documents_keep_their_ids_apart(spark):
    df = spark.createDataFrame([(1, "A", "Ann", "B"), (2, "A", "Otto", "B"), (2, "B", "Bob", None)], "doc_id int, case_id string, name string, contacts string")
    rel = graph.relationships(df, ("doc_id",))
    assert rel.count() == 2 and graph.link_closure(rel, ("doc_id",)).count() == 4 and graph.degree(rel, ("doc_id",)).count() == 0
    assert {(r["doc_id"], r["id"], r["label"]) for r in graph.nodes(df, rel, ("doc_id",)).collect()} == {(1, "A", "Ann"), (1, "B", "B"), (2, "A", "Otto"), (2, "B", "Bob")}
    assert [r["doc_id"] for r in graph.arranged(graph.edges(rel, ("doc_id",)).selectExpr("doc_id", "`from` as source_case_id", "`to` as target_case_id", "label as relationship_type"), ("doc_id",)).collect()] == [1, 2]


def test_components(spark):
    from casegrid.operators.components import components

    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (999, 999)]
    parent = {v: v for e in links for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for v, w in links:
        a, b = sorted((find(v), find(w)))
        parent[b] = a
    got = [(r["v"], r["root"]) for r in components(spark.createDataFrame(links, "v bigint, w bigint")).collect()]
    assert sorted(got) == sorted((v, find(v)) for v in parent)


def test_run_metadata(spark):
    from casegrid.plans.pipeline import run

    docs = spark.createDataFrame([(1, "SYN9 text", "a.txt", "text")], "doc_id int, content string, label string, content_type string")
    fake = client.FakeClient({"SYN9": '<linelist>[{"case_id":"z9","name":"Zoe"},{"case_id":"a1","name":"Ann","contacts":["Z9"]},{"case_id":"z9","name":"zoe"}]</linelist>'})
    out = run(docs, "t {{content}}", fake, model="gpt-4o")
    got = {r["metric"]: r["value"] for r in out["metadata"].collect()}
    assert len(got) == 9 and (got["document"], got["content_type"], got["deduplication"], got["cases_extracted"], got["relationships_extracted"]) == ("a.txt", "text", "enabled", "2", "1")
    assert [(r["row_idx"], r["case_id"]) for r in out["linelist"].orderBy("row_idx").collect()] == [(0, "Z9"), (1, "A1")]  # as extracted


def test_model_calls_are_checked_first(spark, monkeypatch):
    prompts = spark.createDataFrame([("hello",)], "prompt string")
    with pytest.raises(PermissionError):
        client.call_model(prompts, client.HttpClient("openai"), "openai")
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ValueError, match="OPENAI_API_KEY"):
        client.call_model(prompts, client.HttpClient("openai"), "openai", approved=True)
    with pytest.raises(ValueError, match="unknown kind"):
        client.call_model(prompts, client.FakeClient(), "ollama", raw=False, prompt_type="x")
    fake = client.FakeClient({"hello": "found"})
    assert client.call_model(prompts, fake, "ollama", raw=False, prompt_type="msf").first()["prompt"].count("hello") == 1


def test_http_client_tries_again_and_cites(monkeypatch):
    import json as json_
    import urllib.error

    seen, pauses = [], []

    def opened(request, timeout):
        seen.append((json_.loads(request.data), timeout))
        if len(seen) < 3:
            raise urllib.error.URLError("down")
        return io.BytesIO(json_.dumps({"content": [{"type": "text", "text": "ab", "citations": [{"cited_text": "q", "start_char_index": 1, "end_char_index": 2}]}, {"type": "text", "text": "c"}], "usage": {"input_tokens": 5, "output_tokens": 2}}).encode())

    monkeypatch.setattr(client.urllib.request, "urlopen", opened)
    monkeypatch.setattr(client.time, "sleep", pauses.append)
    got = client.HttpClient("claude", "m").call_cited("rules", "document")
    assert got["text"] == "abc" and got["blocks"][1]["start"] == 2 and got["prompt_tokens"] == 5 and pauses == [2, 4]
    body, timeout = seen[0]
    assert timeout == client.TIMEOUT and body["system"] == "rules" and body["messages"][0]["content"][0]["citations"] == {"enabled": True}
    with pytest.raises(ValueError):
        client.HttpClient("openai").cited_request("r", "d")
    seen.clear()
    monkeypatch.setattr(client.urllib.request, "urlopen", lambda *a, **k: (_ for _ in ()).throw(urllib.error.URLError("down")))
    with pytest.raises(urllib.error.URLError):
        client.HttpClient("ollama").call("p")


def test_records_and_sinks(spark, tmp_path):
    from datetime import datetime

    from casegrid.operators import records

    df = spark.createDataFrame([(0, "A1", "Ann", ["x", "y"]), (1, "B2", None, None), (2, "A1", "", [])], "row_idx int, case_id string, name string, tags array<string>")
    assert [r["label"] for r in records.row_labels(df).orderBy("row_idx").collect()] == ["A1 - Ann", "B2", "A1"]
    assert {(r["row_idx"], r["field"], r["value"]) for r in records.unpivoted(df).collect()} >= {(0, "tags", "x, y"), (1, "name", ""), (1, "tags", "")}
    assert {r["case_id"]: r["place"] for r in records.first_place(spark.createDataFrame([("A1",), ("Z",)], "case_id string"), df).collect()} == {"A1": 0, "Z": None}
    assert [r["row_idx"] for r in records.page(df, 2, 2).collect()] == [2]
    null = spark.createDataFrame([(None,), ("B2",)], "case_id string")
    assert records.matched(df.unionByName(df.withColumn("case_id", F.lit(None).cast("string"))), null).count() == 4
    assert files.stamped("/x/", "linelist", datetime(2026, 3, 4, 5, 6, 7)) == "/x/linelist_20260304_050607"
    rel = spark.createDataFrame([("B", "C", "contact"), ("A", "C", "contact")], "source_case_id string, target_case_id string, relationship_type string")
    files.write_relationships(rel, str(tmp_path / "rel"))
    assert spark.read.csv(str(tmp_path / "rel"), header=True).count() == 2
    files.write_responses(spark.createDataFrame([("a\nb",), ("c",)], "response string").coalesce(1), str(tmp_path / "raw"))
    assert sorted(r["response"] for r in files.read_responses(spark, str(tmp_path / "raw")).collect()) == ["a\nb", "c"]
    demo = spark.read.csv(files.demo_path("demo_linelist.csv"), header=True)
    assert demo.count() == 6 and "SYN006" in files.template("demo_narrative.md")


def test_plain_letters(spark):
    assert cell(spark, text.plain("c"), c="Straße Ærø Łódź Benín 東") == "Strasse AEro Lodz Benin 東"
