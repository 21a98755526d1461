"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.functions import nulls, text
from casegrid.operators import compare, dedupe, extract, graph, joins, match, metrics, prompt, provenance, records, similar
from casegrid.operators.client import FakeClient, call_model
from casegrid.plans import pipeline
from casegrid.plans.fixtures import COLUMNS, gt, lists, llm, table
from casegrid.plans.tables import new_path, written
from casegrid.schema import align
from casegrid.streaming import merge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TEMPLATE = "Extract the cases.\n<outbreak_narrative>\n{{content}}\n</outbreak_narrative>"
SHARED = list(COLUMNS)
VARIABLES = ("name", "sex", "onset_date", "secondary_cases", "potential_infector")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r9(df: DataFrame) -> DataFrame:
    """Doubles to nine places, so that the order of a sum does not show."""
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query
def case_metrics(s, d):
    return r9(metrics.case_metrics(*lists(s, d, True)))


@query
def case_metrics_by_name(s, d):
    a, b = lists(s, d, True)
    other = a.withColumn("case_id", F.concat(F.lit("X"), F.col("case_id")))
    return r9(metrics.case_metrics(other, b))


@query
def variable_metrics(s, d):
    return r9(metrics.variable_metrics(*lists(s, d, True), variables=VARIABLES))


@query
def variable_metrics_by_name(s, d):
    """No id matches, so names lead extracted cases to true ids."""
    a, b = lists(s, d, True)
    other = a.withColumn("case_id", F.concat(F.lit("X"), F.col("case_id")))
    return r9(metrics.variable_metrics(other, b, variables=VARIABLES))


@query
def variable_metrics_without_true_cases(s, d):
    a, b = lists(s, d, True)
    return r9(metrics.variable_metrics(a, b.filter("row_idx < 0"), variables=VARIABLES))


@query
def per_case_list_metrics(s, d):
    return r9(metrics.per_case_list_metrics(*lists(s, d, True)))


@query
def few_shot_exclusion(s, d):
    return metrics.without_ids(gt(s, d), ["SAA001", "SAA002", "SAA003"]).select("row_idx", "case_id")


@query
def semi_join(s, d):
    a, b = lists(s, d, True)
    return records.matched(b, a).select("row_idx", "case_id")


@query
def anti_join(s, d):
    a, b = lists(s, d, True)
    return records.unmatched(b, a).select("row_idx", "case_id")


@query
def first_per_key(s, d):
    return metrics.first_per_case(gt(s, d).withColumn("case_id", text.name_key("name"))).select("case_id", "row_idx")


@query
def first_place(s, d):
    true = written(gt(s, d))
    return records.first_place(true.select(F.col("row_idx").alias("asked"), "name"), true, "name").select("asked", "place")


@query
def record_page(s, d):
    return records.page(gt(s, d).select("row_idx", "case_id"), 3)


@query
def schema_align(s, d):
    odd = gt(s, d).select("row_idx", F.col("case_id").alias("Patient_ID"), F.col("name").alias("patient_name"), F.col("sex").alias("GENDER"), F.col("onset_date").alias("symptom_onset"), F.col("potential_infector").alias("source_case"), F.lit("other").alias("id"))
    return align(odd)


@query
def null_like_flags(s, d):
    v = F.when(F.col("conv_id") % 7 == 0, F.lit(" NULL ")).when(F.col("conv_id") % 7 == 1, F.lit("null")).when(F.col("conv_id") % 7 == 2, F.lit("[]")).when(F.col("conv_id") % 7 == 3, F.lit("")).when(F.col("conv_id") % 7 == 4, F.lit("NA")).when(F.col("conv_id") % 7 == 5, F.lit(None)).otherwise(F.col("role"))
    rows = table(s, d, "conversations").select("conv_id", "turn", v.alias("v"))
    kinds = {"n1": nulls.null_like, "n2": nulls.no_name, "n3": nulls.no_key_name, "n4": nulls.no_reference, "n5": nulls.no_value, "n6": nulls.some}
    return rows.select("conv_id", "turn", *(F.coalesce(f("v"), F.lit(False)).alias(c) for c, f in kinds.items()))


@query
def case_ids_extract(s, d):
    return gt(s, d).select("row_idx", F.explode(text.case_ids("secondary_cases")).alias("id"))


@query
def name_tokens(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(text.name_tokens("text"), " ").alias("tokens"))


@query
def name_keys(s, d):
    return gt(s, d).select("row_idx", text.name_key("name").alias("name_key"))


@query
def transliterate(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(text.plain("text"), 256).alias("plain_sha256"))


@query
def json_props(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object(extract.repaired(F.col("props")), "$.k").cast("bigint").alias("k"))


@query
def malformed_responses(s, d):
    """Lists that lost a bracket, and one inside an object."""
    item = F.concat(F.lit('{"case_id":"a'), F.col("event_id").cast("string"), F.lit('"}'))
    forms = ("<linelist>[%s]</linelist>", "<linelist>%s]</linelist>", "<linelist>[%s</linelist>", 'text ```json\n{"linelist":[%s]}\n```', "no list %s")
    parts = [f.split("%s") for f in forms]
    text_ = F.element_at(F.array(*(F.concat(F.lit(a), item, F.lit(b)) for a, b in parts)), (F.col("event_id") % 5 + 1).cast("int"))
    out = extract.parse_responses(table(s, d, "events").select(F.col("event_id").alias("doc_id"), text_.alias("response")))
    return out.select("doc_id", F.col("row_idx").cast("bigint").alias("row_idx"), "case_id")


def _responses(s, d) -> DataFrame:
    rows = llm(gt(s, d)).withColumn("doc_id", F.floor(F.col("row_idx") / 20).cast("bigint"))
    lists = F.when(F.col("secondary_cases").isNull() | (F.col("secondary_cases") == "[]"), F.array().cast("array<string>")).otherwise(F.split("secondary_cases", ", "))
    item = F.to_json(F.struct("case_id", "name", "sex", "onset_date", lists.alias("secondary_cases"), "potential_infector"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", item.alias("j")))), lambda x: x["j"]), ",")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("Here it is:\n<linelist>["), body, F.lit("]</linelist>")).alias("response"))


@query
def linelist_parse(s, d):
    return extract.parse_responses(_responses(s, d)).select("doc_id", F.col("row_idx").cast("bigint").alias("row_idx"), "case_id", "name", "sex", "onset_date", "secondary_cases", "potential_infector")


@query
def list_column_normalize(s, d):
    return llm(gt(s, d)).select("row_idx", extract.list_cell(F.when(F.col("secondary_cases") == "[]", F.col("secondary_cases")).otherwise(F.to_json(F.split("secondary_cases", ", ")))).alias("secondary_cases"))


@query
def dedupe_linelist(s, d):
    a, _ = lists(s, d)
    both = a.unionByName(a.withColumn("row_idx", F.col("row_idx") + 10_000_000).withColumn("sex", F.lit("null")))
    return dedupe.merge_duplicates(both)


def _matched(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, b = lists(s, d)
    return a, b, match.greedy_match(a, b)


@query
def greedy_match(s, d):
    return r9(_matched(s, d)[2])


@query
def similar_names(s, d):
    """Sets of name words of either list with a Jaccard similarity of a half or more."""
    sets = lambda df: df.select(F.array_distinct(text.name_tokens("name")).alias("words")).filter(F.size("words") > 0).distinct().select(F.array_join("words", " ").alias("key"), F.lit("").alias("run"), "words")
    a, b = lists(s, d)
    return r9(similar.similar_sets(sets(a), sets(b), 0.5))


@query
def approximate_name_join(s, d):
    """Names of either list of which one is in the other up to a fifth of its letters in edits."""
    a, b = lists(s, d)
    return similar.approximate_join(a.select("name"), b.select("name"))


@query
def case_detection(s, d):
    return r9(compare.case_detection(*_matched(s, d)))


@query
def case_names(s, d):
    return compare.case_names(*_matched(s, d))


@query
def fp_analysis(s, d):
    a, _, m = _matched(s, d)
    return compare.fp_analysis(a, m)


@query
def fn_analysis(s, d):
    _, b, m = _matched(s, d)
    return compare.fn_analysis(b, m)


def _by_case(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows matched by case id in place of the greedy order."""
    a, b = lists(s, d, True)
    m = a.select(F.col("row_idx").alias("llm_idx"), "case_id").join(b.select(F.col("row_idx").alias("gt_idx"), "case_id"), "case_id").select("llm_idx", "gt_idx")
    return a, b, m


@query
def column_metrics(s, d):
    a, b, m = _by_case(s, d)
    return r9(compare.column_metrics(a, b, compare.compared_cells(a, b, m, SHARED), SHARED))


@query
def linelist_comparison(s, d):
    """Column metrics of the whole comparison, with rows matched by name."""
    out = compare.compare_linelists(*lists(s, d))
    return r9(out["column_metrics"])


@query
def overall_metrics(s, d):
    a, b, m = _by_case(s, d)
    return r9(compare.overall(compare.column_metrics(a, b, compare.compared_cells(a, b, m, SHARED), SHARED)))


@query
def error_breakdown(s, d):
    a, b, m = _by_case(s, d)
    return compare.error_breakdown(compare.compared_cells(a, b, m, SHARED))


@query
def unmatched_overlap_metrics(s, d):
    return r9(compare.unmatched_overlap(*lists(s, d), SHARED))


@query
def agrep_names(s, d):
    a, b, m = _by_case(s, d)
    pairs = m.join(a.select(F.col("row_idx").alias("llm_idx"), F.col("name").alias("a")), "llm_idx").join(b.select(F.col("row_idx").alias("gt_idx"), F.col("name").alias("b")), "gt_idx")
    return pairs.select("llm_idx", F.coalesce(text.near_either_way(F.col("a"), F.col("b")), F.lit(False)).alias("near"))


@query
def relationships(s, d):
    return graph.relationships(written(gt(s, d)))


@query
def nodes(s, d):
    cases = written(gt(s, d)).withColumns({"age": F.lit(None).cast("string"), "outcome": F.lit(None).cast("string")})
    return graph.nodes(cases, graph.relationships(cases))


def _by_document(s, d) -> DataFrame:
    """Every second case in another document."""
    return written(gt(s, d)).withColumns({"doc_id": F.col("row_idx") % 2, "age": F.lit(None).cast("string"), "outcome": F.lit(None).cast("string")})


@query
def relationships_by_document(s, d):
    return graph.relationships(_by_document(s, d), ("doc_id",))


@query
def nodes_by_document(s, d):
    cases = _by_document(s, d)
    return graph.nodes(cases, graph.relationships(cases, ("doc_id",)), ("doc_id",)).select("doc_id", "id", "label", "group")


@query
def edges(s, d):
    return graph.edges(graph.relationships(written(gt(s, d))))


@query
def link_closure(s, d):
    return graph.link_closure(graph.relationships(written(gt(s, d))))


@query
def missing_mirror_edges(s, d):
    return graph.missing_mirrors(graph.relationships(written(gt(s, d))))


@query
def transmission_degree(s, d):
    return graph.degree(graph.relationships(written(gt(s, d))))


@query
def metrics_rows(s, d):
    e = table(s, d, "events")
    runs = e.select(
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"), F.col("event_type").alias("provider"), (F.col("user_id") % 2 == 0).alias("use_chunking"),
        F.col("event_id").alias("replicate"), F.when(F.col("event_id") % 9 == 0, "Failed").otherwise("Success").alias("status"), F.lit(1).alias("attempts"),
        F.when(F.col("event_id") % 9 != 0, F.col("value") / 1000).alias("case_f1"), (F.col("value") / 2000).alias("case_recall"), F.col("value").alias("time_total_sec"), (F.col("event_id") % 4).alias("n_llm_cases"),
        (F.col("value") / 4000).alias("case_precision"), (F.col("value") / 5000).alias("date_accuracy"), F.when(F.col("event_id") % 9 == 0, "failed").alias("error"),
        F.concat(F.lit("job"), F.col("event_id").cast("string")).alias("slurm_job_id"), (F.col("value") / 7).alias("slurm_exec_time_sec"),
    )
    kind = F.explode(F.array(F.lit("secondary_cases"), F.lit("potential_infector"), F.lit("name"))).alias("variable")
    each = runs.filter("replicate % 3 = 0").select(*metrics.RUN, kind, "time_total_sec").withColumn("x", F.col("time_total_sec") * F.length("variable"))
    variables = each.select(*metrics.RUN, "variable", (F.col("x") / 1000).alias("f1"), (F.col("x") / 2000).alias("precision"), (F.col("x") / 3000).alias("recall"))
    return r9(metrics.metrics_rows(runs, variables))


def _replicates(s, d) -> DataFrame:
    value = lambda k: F.round((F.col("event_id") * k % 1009) / 1009, 6)
    figures = [c for c in metrics.STATS]
    return table(s, d, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"), F.col("event_type").alias("provider"), F.lit("Unchunked").alias("strategy"),
        F.when(F.col("event_id") % 9 == 0, "Failed").otherwise("Success").alias("status"), *(value(7 + 2 * i).alias(c) for i, c in enumerate(figures)),
    )


@query
def replicate_aggregate(s, d):
    return r9(metrics.aggregate_replicates(_replicates(s, d)))


@query
def replicate_strings(s, d):
    """Percent strings of shares with three places."""
    p = metrics.percent
    return table(s, d, "events").select("event_id", F.concat(p((F.col("event_id") % 1000) / 1000.0), F.lit("% ("), p(F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 100) / 100.0)), F.lit(")")).alias("s"))


def _narrative(s, d) -> DataFrame:
    """Documents with a header for every line: "- SYNnnn (text)", each also naming another id."""
    i = F.col("doc_id").cast("string")
    content = F.concat(F.lit("Intro about SYN9.\n- SYN"), i, F.lit(" ("), "text", F.lit(") met SYN"), (F.col("doc_id") + 1).cast("string"), F.lit(".\n- Secondary: SYNx"), i, F.lit(" saw SYN"), i, F.lit(" end"))
    return table(s, d, "documents").select("doc_id", content.alias("content"))


@query
def source_records(s, d):
    out = provenance.source_records(_narrative(s, d))
    return out.select("doc_id", "case_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query
def source_mentions(s, d):
    docs = _narrative(s, d)
    out = provenance.source_mentions(docs, provenance.source_records(docs))
    return out.select(*(F.col(c).cast("bigint").alias(c) if c in ("record_start", "start", "end") else c for c in out.columns))


@query
def cited_mentions(s, d):
    """Ids inside three citations of each document that overlap."""
    docs = _narrative(s, d)
    n = F.length("content")
    ends = ((F.lit(0), F.floor(n / 2) + 40), (F.floor(n / 3), n), (F.floor(n / 2), F.least(n, F.floor(n / 2) + 200)))
    spans = F.array(*(F.struct(F.lit(i).alias("row_idx"), a.cast("bigint").alias("start_char_index"), b.cast("bigint").alias("end_char_index")) for i, (a, b) in enumerate(ends)))
    cited = docs.select("doc_id", F.explode(spans).alias("x")).select("doc_id", "x.*")
    out = provenance.cited_mentions(provenance.source_mentions(docs, provenance.source_records(docs)), cited)
    return out.select("doc_id", "row_idx", "span_start", "span_end", "case_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def _injected(s, d) -> tuple[DataFrame, DataFrame]:
    cases = gt(s, d).withColumn("doc_id", F.col("row_idx"))
    docs = table(s, d, "documents").join(cases.select("doc_id", "case_id"), "doc_id").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n\nCase "), "case_id", F.lit(" here. "), "text")).otherwise(F.col("text")).alias("content"))
    return cases, docs


@query
def case_spans(s, d):
    out = provenance.case_spans(*_injected(s, d))
    return out.select("doc_id", F.col("row_idx"), F.sha2("cited_text", 256).alias("cited_sha256"), F.col("start_char_index").cast("bigint").alias("start_char_index"), F.col("end_char_index").cast("bigint").alias("end_char_index"))


@query
def cell_matches(s, d):
    """Ids that begin other ids, words inside words, a list with an id that is nowhere, and an empty cell."""
    i, j = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    sex = F.when(F.col("doc_id") % 2 == 0, "female").otherwise("male")
    other = F.when(F.col("doc_id") % 2 == 0, "male").otherwise("female")
    content = F.concat(F.lit("Report.\n- SYN"), i, F.lit(" not "), other, F.lit("s is "), sex, F.lit(", met SYN"), j, F.lit("0 and SYN"), j, F.lit(". Died.\n- SYN"), i, F.lit("9 is other."))
    rows = table(s, d, "documents")
    cases = rows.select("doc_id", F.lit(0).alias("row_idx"), F.concat(F.lit("syn"), i).alias("case_id"), F.lit(None).cast("string").alias("name"), sex.alias("sex"), F.lit("Died").alias("outcome"), F.concat(F.lit("SYN"), j).alias("contacts"),
        F.concat(F.lit("SYN"), j, F.lit(", SYNnone")).alias("secondary_cases"), F.lit("").alias("onset_date"))
    out = provenance.cell_matches(cases, rows.select("doc_id", content.alias("content")), ["sex", "outcome", "contacts", "secondary_cases", "onset_date"])
    return out.select("doc_id", "row_idx", "field", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query
def date_search_variants(s, d):
    return gt(s, d).select("row_idx", F.array_join(text.date_variants("onset_date"), "|").alias("variants"))


@query
def reference_id_lists(s, d):
    return llm(gt(s, d)).select("row_idx", F.array_join(text.reference_ids(F.when(F.col("row_idx") % 2 == 0, F.col("secondary_cases")).otherwise(F.to_json(F.split("secondary_cases", ", ")))), "|").alias("ids"))


@query
def prompt_bind(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(prompt.bind(TEMPLATE, "text"), 256).alias("prompt_sha256"))


@query
def few_shot_insert(s, d):
    filled = prompt.bind(TEMPLATE, F.lit("x"))
    return table(s, d, "conversations").select("conv_id", "turn", F.sha2(prompt.insert_examples(filled, F.when(F.col("turn") % 3 == 0, F.lit("  ")).otherwise(F.col("text"))), 256).alias("prompt_sha256"))


@query
def auto_prompt_sample(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(prompt.sample_words("text", 400), 256).alias("sample_sha256"))


@query
def token_cost(s, d):
    model = F.element_at(F.array(*map(F.lit, ("gpt-5", "gpt-4o", "unknown"))), (F.col("conv_id") % 3 + 1).cast("int"))
    n = prompt.token_estimate("text")
    return r9(table(s, d, "conversations").select("conv_id", "turn", n.alias("tokens"), prompt.cost(model, n, n * 2).alias("cost")))


@query
def record_unpivot(s, d):
    return records.unpivoted(gt(s, d).select("row_idx", *COLUMNS))


@query
def row_labels(s, d):
    return records.row_labels(gt(s, d)).select("row_idx", "label")


@query
def block_offsets(s, d):
    blocks = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text")
    return provenance.block_offsets(blocks).select("doc_id", "pos", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query
def citations_for_case(s, d):
    blocks = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text", F.array(F.struct(F.col("role").alias("cited_text"), F.col("turn").cast("int").alias("start_char_index"), F.lit(9).alias("end_char_index"))).alias("citations"))
    cases = blocks.filter("pos = 0").select("doc_id", F.lit(0).alias("row_idx"), F.lit("").alias("case_id"), F.split("text", " ")[0].alias("name"))
    return provenance.citations_for_cases(cases, blocks).select("doc_id", "pos", "cited_text", F.col("start_char_index").cast("bigint").alias("start_char_index"))


@query
def names_in_id_columns(s, d):
    """Infectors that every third extracted row names in place of an id are led to the first true case of that name."""
    a, b = lists(s, d, True)
    named = F.when(F.col("row_idx") % 3 == 0, F.concat_ws(", ", "name", F.lit("Nobody Known"))).when(F.col("row_idx") % 3 == 1, F.col("name")).otherwise(F.col("potential_infector"))
    return metrics.names_to_ids(a.select("row_idx", named.alias("potential_infector")), b, "potential_infector")


@query
def highlighted_documents(s, d):
    """Every document with three marks, of which the second begins inside the first and is left out."""
    mark = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    content = F.concat(F.lit("<b>&amp; "), F.col("doc_id").cast("string"), F.lit("</b> "), "text")
    html = provenance.highlight(content, F.array(mark(20, 29), mark(2, 6), mark(5, 12)))
    return table(s, d, "documents").select("doc_id", F.sha2(html, 256).alias("html_sha256"))


@query
def longest_word_cells(s, d):
    """Cells of several words that are nowhere as a whole are shown by their longest word, dates by the form in which they are written."""
    i = F.col("doc_id").cast("string")
    day, month = (F.col("doc_id") % 27 + 1).cast("string"), F.when(F.col("doc_id") % 2 == 0, "March").otherwise("may")
    content = F.concat(F.lit("- SYN"), i, F.lit(" of Betalong"), i, F.lit(", fell ill on "), day, F.lit(" "), month, F.lit(" 2026 at Alphaxx.\n"))
    rows = table(s, d, "documents")
    date = F.concat(F.lpad(day, 2, "0"), F.lit("/"), F.when(F.col("doc_id") % 2 == 0, "03").otherwise("05"), F.lit("/2026"))
    cases = rows.select("doc_id", F.lit(0).alias("row_idx"), F.concat(F.lit("syn"), i).alias("case_id"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("Alphaxx of betalong"), i).alias("residence_village"), F.lit("none such").alias("profession"), date.alias("onset_date"))
    out = provenance.cell_matches(cases, rows.select("doc_id", content.alias("content")), ["residence_village", "profession", "onset_date"])
    return out.select("doc_id", "row_idx", "field", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query
def cited_cells(s, d):
    """Values are found in a case's citations, in their order, before the rest of the document."""
    i = F.col("doc_id").cast("string")
    content = F.concat(F.lit("- SYN"), i, F.lit(" male here. One says female, and Died. Two says male and Died."))
    at = lambda word: F.instr("content", word)
    rows = table(s, d, "documents").select("doc_id", content.alias("content"))
    cases = rows.select("doc_id", F.lit(0).alias("row_idx"), F.concat(F.lit("SYN"), F.col("doc_id").cast("string")).alias("case_id"), F.lit(None).cast("string").alias("name"), F.lit("male").alias("sex"), F.lit("died").alias("outcome"), F.lit("here").alias("profession"))
    span = lambda a, b: F.struct((at(a) - 1).alias("start_char_index"), (at(b) - 1).alias("end_char_index"))
    whole = F.struct((at("Two") - 1).alias("start_char_index"), F.length("content").alias("end_char_index"))
    spans = rows.select("doc_id", F.lit(0).alias("row_idx"), F.explode(F.array(whole, span("One", "Two"))).alias("x")).select("doc_id", "row_idx", "x.*")
    out = provenance.cell_matches(cases, rows, ["sex", "outcome", "profession"], spans)
    return out.select("doc_id", "row_idx", "field", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query
def filled_citations(s, d):
    """Cases of even numbers have a citation; the others get the passage in which they are named."""
    cases, docs = _injected(s, d)
    cited = cases.filter("row_idx % 2 = 0").select("doc_id", "row_idx", F.lit("quoted").alias("cited_text"), F.lit(3).alias("start_char_index"), F.lit(9).alias("end_char_index"))
    out = provenance.fill_citations(cited, cases, docs)
    return out.select("doc_id", "row_idx", F.sha2("cited_text", 256).alias("cited_sha256"), F.col("start_char_index").cast("bigint").alias("start_char_index"), F.col("end_char_index").cast("bigint").alias("end_char_index"))


@query
def auto_prompt(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(prompt.auto_prompt(TEMPLATE, "text", "azure", "gpt-5", 25), 256).alias("prompt_sha256"))


@query
def prompt_instructions(s, d):
    """The part of a prompt before the narrative; every second has none."""
    tail = F.when(F.col("turn") % 2 == 0, F.lit("\n\nHere is the outbreak narrative to analyse:\nCases.")).otherwise(F.lit(" end"))
    return table(s, d, "conversations").select("conv_id", "turn", F.sha2(prompt.instructions(F.concat("text", tail)), 256).alias("prompt_sha256"))


@query
def arranged_relationships(s, d):
    """The table of relationships in its order, and each row's place in it."""
    rows = graph.relationships(written(gt(s, d)))
    first = graph.arranged(rows).limit(50)
    return first.select("relationship_type", "source_case_id", "target_case_id")


@query
def run_metadata(s, d):
    """A whole run over the conversations' first turns, answered by a table in place of a model: what it says about itself."""
    docs = table(s, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("- SYN1 "), "text").alias("content"), F.lit("first turn").alias("label"))
    answer = '<linelist>[{"case_id":"syn1","name":"Ann Lee","contacts":["SYN2"]},{"case_id":"syn2","name":"Bob Ray"},{"case_id":"","name":"lee ann"}]</linelist>'
    out = pipeline.run(docs, TEMPLATE, FakeClient(default=answer), provider="ollama", model="gpt-4o")
    return out["metadata"].filter("metric <> 'processing_time_sec'").select("doc_id", "metric", F.coalesce("value", F.lit("-")).alias("value"))


@query
def stable_first_rows(s, d):
    """Of each name the first true case, by a join on names in which missing ones are equal."""
    a, b = lists(s, d)
    firsts = b.groupBy(F.col("name").alias("k")).agg(F.min("row_idx").alias("true_idx"))
    return joins.null_safe_join(a.select("row_idx", "name"), firsts, "name", "k").select("row_idx", "true_idx")


@query
def merged_stream(s, d):
    """The duplicates of ``dedupe_linelist``, merged as they arrive: a stream of several files, one a micro-batch."""
    a, _ = lists(s, d)
    both = a.unionByName(a.withColumn("row_idx", F.col("row_idx") + 10_000_000).withColumn("sex", F.lit("null"))).withColumn("doc_id", F.col("row_idx") % 2)
    source, out, state = (new_path(s) for _ in range(3))
    both.repartition(2, F.col("row_idx")).write.parquet(source)
    rows = s.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(source)
    merge.write_merged(rows, out, state).awaitTermination()
    return merge.read_merged(s, out).select("doc_id", *COLUMNS)


@query
def ledger_calls(s, d):
    """Every turn as a prompt, in two runs with one ledger: the second asks only what the first has not; blank prompts fail."""
    prompts = table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, F.lit("  ")).otherwise(F.concat(F.col("role"), F.lit(": "), "text")).alias("prompt"))
    ledger = new_path(s)
    call_model(prompts.filter("turn < 2"), FakeClient(), "ollama", "gpt-4o", ledger=ledger)
    out = call_model(prompts, FakeClient(), "ollama", "gpt-4o", ledger=ledger)
    return r9(out.fillna(0, ["prompt_tokens", "total_tokens", "cost"]).select("conv_id", "turn", "status", "prompt_tokens", "total_tokens", "cost"))
