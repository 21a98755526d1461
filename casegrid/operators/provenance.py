"""Where in a document each case and each cell comes from.  Offsets count code points from 1, ends included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.functions.nulls import no_value, trim
from casegrid.functions.text import date_variants
from casegrid.operators.intervals import contained
from casegrid.operators.needles import search, search_rows

_MARK = "\ue000"
ID = r"SYN[\p{Alnum}_-]+"
HEADER = r"(?m)^\s*-\s*(?:Secondary:\s*)?SYN[\p{Alnum}_-]+"
REFERENCE_FIELDS = ("contacts", "secondary_cases", "potential_infector", "most_probable_infector")
DATE_FIELDS = ("onset_date", "outcome_date")


def _found(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, n (length of the content), s and start of each match: the text is cut at the matches, which are every second
    piece, and places are running sums of the pieces' lengths."""
    clean = F.replace("content", F.lit(_MARK), F.lit(" "))
    parts = F.split(F.regexp_replace(clean, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
    rows = docs.select("doc_id", F.length("content").alias("n"), F.posexplode(parts).alias("i", "s"))
    rows = rows.select("doc_id", "n", "i", F.length("s").alias("len"), F.when(F.col("i") % 2 == 1, F.col("s")).alias("s"))
    before = F.sum("len").over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("start", (F.coalesce(before, F.lit(0)) + 1).cast("int")).filter("s is not null").select("doc_id", "n", "s", "start")


def source_records(docs: DataFrame) -> DataFrame:
    """doc_id, case_id, start, end of each record: from its header to before the next one."""
    nxt = F.lead("start").over(W.partitionBy("doc_id").orderBy("start"))
    return _found(docs, HEADER).select("doc_id", "n", F.upper(F.regexp_extract("s", ID, 0)).alias("case_id"), "start").select("doc_id", "case_id", "start", F.coalesce(nxt - 1, "n").alias("end"))


def source_mentions(docs: DataFrame, records: DataFrame) -> DataFrame:
    """doc_id, record_start, record_case_id, case_id, start, end of each id written inside a record.  Both sides are keyed by
    document, so the containment test never leaves it."""
    found = _found(docs, ID).select("doc_id", F.upper("s").alias("case_id"), "start", (F.col("start") + F.length("s") - 1).alias("end"))
    # the record of a mention is the last header at or before it: one sorted pass over both instead of a range join
    both = found.select("doc_id", "case_id", "start", "end", F.lit(1).alias("kind")).unionByName(records.select("doc_id", "case_id", "start", F.lit(0).alias("end"), F.lit(0).alias("kind")))
    before = W.partitionBy("doc_id").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, 0)
    head = F.when(F.col("kind") == 0, F.struct(F.col("start").alias("s"), F.col("case_id").alias("c")))
    tagged = both.withColumn("head", F.last(head, True).over(before)).filter("kind = 1 and head is not null")
    return tagged.select("doc_id", F.col("head.s").alias("record_start"), F.col("head.c").alias("record_case_id"), "case_id", "start", "end")


def locate(value: Column, content: Column) -> Column:
    """Place of ``value`` in ``content`` without regard to case; 0 if absent."""
    return F.when(F.length(value) > 0, F.instr(F.lower(content), F.lower(value))).otherwise(F.lit(0))


def whole_word(value: Column, content: Column) -> Column:
    """Place of ``value`` as a whole word, without regard to case; 0 if absent."""
    escaped = F.regexp_replace(value, r"([\\.+*?\[\]^${}()|])", r"\\$1")
    hit = F.regexp_instr(content, F.concat(F.lit(r"(?i)\b"), escaped, F.lit(r"\b")))
    return F.when(F.length(value) > 0, hit).otherwise(F.lit(0))


def search_value(value: Column, content: Column, field: str) -> Column:
    """Struct (start, len) of a cell's value in a text, or null: the first written form of a date, or the whole value, or, if
    it has several words with more than two letters, the longest of them that is there (the first of equally long ones)."""
    if field in DATE_FIELDS:
        forms = F.transform(date_variants(value), lambda v: F.struct(F.instr(F.lower(content), F.lower(v)).alias("start"), F.length(v).alias("len")))
        return F.try_element_at(F.filter(forms, lambda x: x["start"] > 0), F.lit(1))
    whole = whole_word(value, content)
    words = F.filter(F.split(value, r"\s+"), lambda w: F.length(w) > 2)
    hits = F.filter(F.transform(words, lambda w: F.struct(whole_word(w, content).alias("start"), F.length(w).alias("len"))), lambda x: x["start"] > 0)
    longest = F.aggregate(hits, F.lit(None).cast("struct<start:int,len:int>"), lambda acc, x: F.when(acc.isNull() | (x["len"] > acc["len"]), x).otherwise(acc))
    return F.when(whole > 0, F.struct(whole.alias("start"), F.length(value).alias("len"))).when(F.size(words) > 1, longest)


def _needles(cases: DataFrame, id_: Column, name: Column) -> DataFrame:
    """Two needles of each case: its id under an even number, its name under the next."""
    both = F.array(F.struct((F.col("row_idx") * 2).alias("needle"), id_.alias("word")), F.struct((F.col("row_idx") * 2 + 1).alias("needle"), name.alias("word")))
    return cases.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.*")


def _forms(place: Column, id_text: Column, name_text: Column) -> Column:
    """The two forms of a text that ids and names are looked for in."""
    return F.array(F.struct((place * 2).alias("part"), id_text.alias("text")), F.struct((place * 2 + 1).alias("part"), name_text.alias("text")))


def _own_hits(hits: DataFrame, place: str) -> DataFrame:
    """doc_id, place, row_idx, by_id, first: ids that were found in the first form, and names in the second."""
    hits = hits.filter(F.pmod("part", F.lit(2)) == F.pmod("needle", F.lit(2)))
    half = lambda c: F.floor(F.col(c) / 2)
    return hits.select("doc_id", half("part").alias(place), half("needle").alias("row_idx"), (F.pmod("needle", F.lit(2)) == 0).alias("by_id"), "first")


def case_spans(cases: DataFrame, docs: DataFrame, quote: int = 400, around: int = 2000) -> DataFrame:
    """doc_id, row_idx, cited_text, start_char_index, end_char_index (from 0) of the passage of each case: where its id is
    written, else its name in any case; from the paragraph's start, or 200 characters before.  Each text is searched once for all
    its document's cases, and cut once for all that are found."""
    texts = docs.select("doc_id", _forms(F.lit(0).cast("bigint"), F.col("content"), F.lower("content")).alias("texts"))
    hits = _own_hits(search_rows(texts, _needles(cases, F.col("case_id"), F.lower("name"))), "place")
    kind = dict(cases.dtypes)["row_idx"]
    places = hits.groupBy("doc_id", "row_idx").agg(F.coalesce(F.min(F.when(F.col("by_id"), F.col("first"))), F.min("first")).cast("int").alias("pos"))
    places = places.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("row_idx").cast(kind).alias("row_idx"), "pos")).alias("found"))
    text, n = F.col("content"), F.length("content")

    def span(h: Column) -> Column:
        pos = h["pos"]
        low = F.greatest(F.lit(1), pos - around)
        head = F.length(F.regexp_extract(F.substring(text, low, pos - low), r"(?s)^(.*(?:\n\n|\n>))", 1))
        start = F.when(head > 0, low + head).otherwise(F.greatest(F.lit(1), pos - 200))
        cited = F.substring(text, pos, F.least(n, pos + quote) - pos + 1)
        return F.struct(h["row_idx"].alias("row_idx"), cited.alias("cited_text"), (start - 1).alias("start_char_index"), (F.least(n, pos + around) - 1).alias("end_char_index"))

    return docs.join(places, "doc_id").select("doc_id", F.explode(F.transform("found", span)).alias("s")).select("doc_id", "s.*")


def fill_citations(cited: DataFrame, cases: DataFrame, docs: DataFrame) -> DataFrame:
    """``cited`` (doc_id, row_idx, cited_text, start_char_index, end_char_index) and, for cases without any, their spans."""
    without = cases.join(cited.select("doc_id", "row_idx").distinct(), ["doc_id", "row_idx"], "left_anti")
    return cited.unionByName(case_spans(without, docs).select(*(F.col(c).cast(t).alias(c) for c, t in cited.dtypes)))


def block_offsets(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, text, start, end (from 0, end exclusive) of successive text blocks."""
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.length(F.coalesce("text", F.lit("")))).over(before)
    return blocks.select("doc_id", "pos", "text", (end - F.length(F.coalesce("text", F.lit("")))).alias("start"), end.alias("end"))


def citations_for_cases(cases: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, row_idx, cited_text, start, end: citations of the blocks of a case's document that hold its id or its name.  Each
    block is searched once for all cases of its document."""
    kind = dict(cases.dtypes)["row_idx"]
    forms = blocks.select("doc_id", F.explode(_forms(F.col("pos").cast("bigint"), F.upper("text"), F.lower("text"))).alias("x")).select("doc_id", "x.*")
    hits = _own_hits(search(forms, _needles(cases, F.upper("case_id"), F.lower("name"))), "pos")
    named = hits.select("doc_id", "pos", F.col("row_idx").cast(kind).alias("row_idx")).distinct()
    return named.join(blocks.select("doc_id", "pos", "citations"), ["doc_id", "pos"]).select("doc_id", "row_idx", "pos", F.posexplode("citations").alias("i", "c")).select("doc_id", "row_idx", "pos", "i", "c.*")


def cited_mentions(mentions: DataFrame, citations: DataFrame) -> DataFrame:
    """doc_id, row_idx, span_start, span_end, case_id, start, end of each id that is written inside a citation of a case
    (doc_id, row_idx, start_char_index from 0, end_char_index).  Citations may overlap; one that begins and ends where another of
    its case does counts once."""
    spans = citations.select("doc_id", "row_idx", (F.col("start_char_index") + 1).alias("low"), F.col("end_char_index").alias("high")).distinct()
    met = contained(mentions.select("doc_id", "case_id", "start", "end"), spans, ["doc_id"])
    return met.select("doc_id", "row_idx", F.col("low").alias("span_start"), F.col("high").alias("span_end"), "case_id", "start", "end")


def cell_matches(cases: DataFrame, docs: DataFrame, fields: list[str], citations: DataFrame | None = None) -> DataFrame:
    """doc_id, row_idx, field, start, end of each cell in its document.

    The spans of a case's ``citations`` (doc_id, row_idx, start_char_index from 0, end_char_index; in the order of
    their places) are searched first: the first one that holds the value, or of an empty cell the case id, shows it.  Else
    the window is the first record of the case, or the whole document.  Ids of a reference field are found among the record's
    mentions, as whole ids, and only count if all are there.  A value that is nowhere, and an empty cell, show the case id's place.
    Records, mentions and spans are joined by their keys first, and the text last."""
    records = source_records(docs)
    mentions = source_mentions(docs, records).groupBy("doc_id", F.col("record_start").alias("w0")).agg(F.array_sort(F.collect_list(F.struct("case_id", "start", "end"))).alias("mentions"))
    first = records.groupBy("doc_id", F.col("case_id").alias("cid")).agg(F.min(F.struct(F.col("start").alias("w0"), F.col("end").alias("w1"))).alias("w")).select("doc_id", "cid", "w.*")
    rows = cases.withColumn("cid", F.nullif(F.upper(trim("case_id")), F.lit(""))).withColumn("who", F.nullif(trim("name"), F.lit("")))
    rows = rows.join(first, ["doc_id", "cid"], "left").withColumn("w0", F.coalesce("w0", F.lit(1))).join(mentions, ["doc_id", "w0"], "left")
    if citations is not None:
        spans = citations.select("doc_id", "row_idx", F.struct((F.col("start_char_index") + 1).alias("s"), F.col("end_char_index").alias("e")).alias("x")).groupBy("doc_id", "row_idx").agg(F.array_sort(F.collect_list("x")).alias("cited"))
        rows = rows.join(spans, ["doc_id", "row_idx"], "left")
    else:
        rows = rows.withColumn("cited", F.lit(None).cast("array<struct<s:int,e:int>>"))
    rows = rows.join(docs.select("doc_id", "content"), "doc_id").withColumn("view", F.substring("content", F.col("w0"), F.coalesce("w1", F.length("content")) - F.col("w0") + 1))
    at_id, at_name = F.instr("content", F.col("cid")), F.instr(F.lower("content"), F.lower("who"))
    anchor = F.when(at_id > 0, at_id).when(at_name > 0, at_name)
    span = lambda hit, base: F.struct((hit["start"] + base - 1).alias("start"), (hit["start"] + base - 2 + hit["len"]).alias("end"))
    own = F.when(anchor.isNotNull() & F.col("cid").isNotNull(), F.array(F.struct(anchor.alias("start"), (anchor + F.length("cid") - 1).alias("end"))))

    def found(value: Column, text: Column, base: Column, f: str) -> Column:
        """The spans of a value in a text that begins at ``base``; null if there are none."""
        parts = F.filter(F.transform(F.split(value, "[,;|]"), lambda x: trim(x)), lambda x: x != "") if f in REFERENCE_FIELDS else F.array(value)
        hits = F.filter(F.transform(parts, lambda x: search_value(x, text, f)), lambda x: x.isNotNull())
        return F.when(F.size(hits) > 0, F.transform(hits, lambda x: span(x, base)))

    def spans(f: str) -> Column:
        value = F.when(~no_value(f), trim(f))
        part = lambda x: F.substring(F.col("content"), x["s"], x["e"] - x["s"] + 1)
        ok = F.filter("cited", lambda x: (x["s"] >= 1) & (x["e"] <= F.length("content")) & (x["s"] < x["e"]))
        cited = F.transform(ok, lambda x: F.when(value.isNotNull(), found(value, part(x), x["s"], f)).otherwise(found(F.col("cid"), part(x), x["s"], "case_id")))
        cited = F.try_element_at(F.filter(cited, lambda x: x.isNotNull()), F.lit(1))
        ids = F.transform(F.split(value, "[,;|]"), lambda x: F.upper(trim(x)))
        hits = F.filter(F.coalesce("mentions", F.array().cast("array<struct<case_id:string,start:int,end:int>>")), lambda m: F.array_contains(ids, m["case_id"]))
        each = F.transform(F.array_distinct(F.transform(hits, lambda m: m["case_id"])), lambda i: F.filter(hits, lambda m: m["case_id"] == i)[0])  # sorted: the first place of each id
        every = F.when(F.size(each) == F.size(ids), F.transform(each, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
        local = F.coalesce(found(value, F.col("view"), F.col("w0"), f), own)
        return F.coalesce(cited, F.when(value.isNotNull() & F.col("cid").isNotNull(), every).otherwise(local) if f in REFERENCE_FIELDS else local)

    cells = F.array(*(F.struct(F.lit(f).alias("field"), spans(f).alias("spans")) for f in fields))
    return rows.select("doc_id", "row_idx", F.explode(cells).alias("c")).select("doc_id", "row_idx", "c.field", F.explode("c.spans").alias("s")).select("doc_id", "row_idx", "field", "s.start", "s.end")


def highlight(content: Column, spans: Column) -> Column:
    """HTML of a text with spans (ascending structs start, end) marked; a span that begins before the last one's end is left out."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    zero = F.struct(F.lit("").alias("html"), F.lit(1).alias("at"))
    mark = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(F.concat(acc["html"], safe(F.substring(content, acc["at"], s["start"] - acc["at"])), F.lit("<mark>"), safe(F.substring(content, s["start"], s["end"] - s["start"] + 1)), F.lit("</mark>")).alias("html"), (s["end"] + 1).alias("at"))
    )
    return F.aggregate(F.array_sort(spans), zero, mark, lambda acc: F.concat(acc["html"], safe(F.substring(content, acc["at"], F.length(content)))))
