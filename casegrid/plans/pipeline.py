"""From documents to line lists, relationships and source places, for many documents at once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.operators.client import Client, call_model, cited_answers
from casegrid.operators.dedupe import merge_duplicates
from casegrid.operators.extract import parse_responses
from casegrid.operators.graph import edges, nodes, relationships
from casegrid.operators.prompt import DEFAULT_MODELS, bind, insert_examples
from casegrid.operators.provenance import case_spans, cell_matches, citations_for_cases, fill_citations, source_mentions, source_records
from casegrid.plans.tables import written
from casegrid.schema import COLUMNS


def answers(docs: DataFrame, template: str, client: Client, provider: str = "azure", model: str | None = None, examples: str | None = None, approved: bool = False, ledger: str | None = None) -> DataFrame:
    """doc_id, response, status, error and usage of each document; see ``call_model``."""
    full = insert_examples(F.lit(template), F.lit(examples).cast("string"))
    prompts = docs.select("doc_id", bind(full, "content").alias("prompt"))
    return call_model(prompts, client, provider, model, approved=approved, ledger=ledger)


def extract_linelists(docs: DataFrame, template: str, client: Client, provider: str = "azure", model: str | None = None, examples: str | None = None, approved: bool = False, ledger: str | None = None) -> DataFrame:
    """doc_id, row_idx and the line-list columns of each document's cases."""
    return parse_responses(answers(docs, template, client, provider, model, examples, approved, ledger).select("doc_id", "response"))


def located_citations(rows: DataFrame, answered: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, row_idx, cited_text, start_char_index, end_char_index: what the cited answers quote for each case, and for cases
    without a quote the passage where they are named."""
    blocks = answered.select("doc_id", F.posexplode("blocks").alias("pos", "b")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "b.text", "b.citations")
    cited = citations_for_cases(rows, blocks).select("doc_id", "row_idx", "cited_text", "start_char_index", "end_char_index")
    return fill_citations(cited.filter("start_char_index is not null and end_char_index is not null").distinct(), rows, docs)


def run(
    docs: DataFrame, template: str, client: Client, provider: str = "azure", model: str | None = None, examples: str | None = None, merge: bool = True, prompt_name: str = "linelist_prompt.txt",
    approved: bool = False, cited: bool = False, ledger: str | None = None,
) -> dict[str, DataFrame]:
    """All tables of a run: linelist, relationships, nodes, edges, records, mentions, spans, cells (doc_id, row_idx, field, start, end),
    calls (doc_id, status, error), metadata (doc_id, metric, value).  Ids of different documents are kept apart.  A merged row keeps
    the place of its first row.  An external provider needs ``approved``.  With ``cited`` the client's answers cite the document,
    spans are the citations of each case, and cells are searched there first.  With a ``ledger`` a stopped run goes on."""
    began, by = time.monotonic(), ("doc_id",)
    if cited:
        told = insert_examples(F.lit(template), F.lit(examples).cast("string"))
        instructions = docs.sparkSession.range(1).select(bind(told, F.lit(""))).first()[0]
        answered = cited_answers(docs, client, instructions, approved, ledger)
    else:
        answered = answers(docs, template, client, provider, model, examples, approved, ledger)
    rows = parse_responses(answered.select("doc_id", "response"))
    if merge:
        order = F.row_number().over(W.partitionBy("doc_id").orderBy("row_idx"))
        rows = merge_duplicates(rows, by, numbered=True).withColumn("row_idx", order - 1)
    rows = written(rows)
    links = relationships(rows, by)
    records = source_records(docs)
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("cases")).join(links.groupBy("doc_id").agg(F.count("*").alias("links")), "doc_id", "left")
    own = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    metrics = {
        "document": own("label"), "content_type": own("content_type"), "provider": F.lit(provider), "model": F.lit(model or DEFAULT_MODELS.get(provider)), "system_prompt": F.lit(prompt_name),
        "deduplication": F.lit("enabled" if merge else "disabled"), "cases_extracted": n("cases"), "relationships_extracted": n("links"), "processing_time_sec": F.lit(f"{time.monotonic() - began:.1f}"),
    }
    facts = docs.join(counts, "doc_id", "left").select("doc_id", F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("string").alias("value")) for k, v in metrics.items())).alias("m"))
    spans = written(located_citations(rows, answered, docs) if cited else case_spans(rows, docs))
    return {
        "cells": cell_matches(rows, docs, list(COLUMNS[1:]), spans), "calls": answered.select("doc_id", "status", "error"),
        "linelist": rows, "relationships": links, "nodes": nodes(rows, links, by), "edges": edges(links, by), "records": records,
        "mentions": source_mentions(docs, records), "spans": spans, "metadata": facts.select("doc_id", F.inline("m")),
    }
