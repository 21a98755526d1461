"""The same results as ``queries``, as SQL for DuckDB over the driver's tables."""

from __future__ import annotations

import unicodedata

from casegrid.plans.fixtures import COLUMNS, SQL

VARIABLES = ("name", "sex", "onset_date", "secondary_cases", "potential_infector")


def null_like(c: str) -> str:
    return f"coalesce(trim(lower({c}), ' ' || chr(9) || chr(10) || chr(13)) IN ('', 'null', '[]'), true)"


def plain(c: str) -> str:
    """Accents of Latin letters removed, by the same rule as in Spark."""
    pairs = [(ch, d[0]) for ch in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", ch)) > 1 and d[0].isascii()] + [*zip("øØłŁđĐħĦŧŦðÐı", "oOlLdDhHtTdDi", strict=True)]
    out = f"translate({c}, '{''.join(p[0] for p in pairs)}', '{''.join(p[1] for p in pairs)}')"
    for one, two in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "TH")):
        out = f"replace({out}, '{one}', '{two}')"
    return out


def letters(c: str) -> str:
    return f"lower(regexp_replace({c}, '[^a-zA-Z ]', '', 'g'))"


def words(c: str, least: int) -> str:
    return f"list_sort(list_filter(regexp_split_to_array(trim({c}), '\\s+'), lambda w: length(w) >= {least}))"


def name_key(c: str) -> str:
    trimmed = f"trim(lower({c}), ' ' || chr(9) || chr(10) || chr(13))"
    return f"CASE WHEN {c} IS NULL OR {c} = '' OR lower({c}) = 'null' THEN NULL ELSE nullif(array_to_string({words(plain(trimmed), 2)}, ' '), '') END"


def tokens(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} IN ('', 'null') THEN CAST([] AS VARCHAR[]) ELSE {words(letters(c), 3)} END"


def ids(c: str) -> str:
    """Case ids in order of appearance, each once."""
    found = f"regexp_extract_all(coalesce({c}, ''), '\\b[A-Z]{{3}}[0-9]{{3}}\\b')"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


def near(p: str, x: str) -> str:
    k = f"CAST(ceil(length({p}) * 0.2) AS INT)"
    inner = f"list_bool_or(list_transform(range(greatest(length({p}) - {k}, 1), length({p}) + {k} + 1), lambda n: levenshtein({p}, substring({x}, CAST(i AS INT), CAST(n AS INT))) <= {k}))"
    return f"({p} = {x} OR (length({p}) > 0 AND length({x}) > 0 AND length({x}) + {k} >= length({p}) AND coalesce(list_bool_or(list_transform(range(1, greatest(length({x}), 1) + 1), lambda i: {inner})), false)))"


def near_either(a: str, b: str) -> str:
    return f"({near(f'lower({a})', f'lower({b})')} OR {near(f'lower({b})', f'lower({a})')})"


def same_set(a: str, b: str) -> str:
    return f"(list_sort({a}) = list_sort({b}))"


def cells_match(a: str, b: str, column: str) -> str:
    if column in ("contacts", "secondary_cases", "potential_infector", "most_probable_infector"):
        x, y = ids(a), ids(b)
        same = f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN true ELSE {same_set(x, y)} END"
    elif column == "name":
        x, y = (f"array_to_string({words(letters(c), 2)}, ' ')" for c in (a, b))
        same = f"({x} <> '' AND {y} <> '' AND {near_either(x, y)})"
    else:
        x, y = (f"lower(trim(regexp_replace({plain(c)}, '[-_\\s]+', ' ', 'g')))" for c in (a, b))
        same = f"({x} = {y})"
    return f"CASE WHEN {null_like(a)} AND {null_like(b)} THEN true WHEN {null_like(a)} OR {null_like(b)} THEN false ELSE coalesce({same}, false) END"


def values_agree(a: str, b: str, column: str) -> str:
    if column == "name":
        x, y = (f"array_to_string({words(letters(c), 2)}, ' ')" for c in (a, b))
        same = f"CASE WHEN {x} = '' AND {y} = '' THEN true ELSE {x} <> '' AND {y} <> '' AND {near_either(x, y)} END"
    else:
        x, y = (f"lower(trim(regexp_replace({c}, '[^a-zA-Z0-9/ ]', '', 'g')))" for c in (a, b))
        same = f"({x} = {y})"
    return f"CASE WHEN {null_like(a)} AND {null_like(b)} THEN true WHEN {null_like(a)} OR {null_like(b)} THEN false ELSE coalesce({same}, false) END"


_EDGES = """, parts AS (
  SELECT case_id, 'secondary_case' AS kind, unnest(string_split(secondary_cases, ', ')) AS x FROM gt WHERE secondary_cases IS NOT NULL
  UNION ALL SELECT case_id, 'potential_infector', unnest(string_split(potential_infector, ', ')) FROM gt WHERE potential_infector IS NOT NULL
), rel AS (
  SELECT DISTINCT CASE WHEN kind = 'secondary_case' THEN case_id ELSE x END AS source_case_id,
    CASE WHEN kind = 'secondary_case' THEN x ELSE case_id END AS target_case_id, kind AS relationship_type FROM parts
)"""
_DOC_EDGES = """, parts AS (
  SELECT row_idx % 2 AS doc_id, case_id, 'secondary_case' AS kind, unnest(string_split(secondary_cases, ', ')) AS x FROM gt WHERE secondary_cases IS NOT NULL
  UNION ALL SELECT row_idx % 2, case_id, 'potential_infector', unnest(string_split(potential_infector, ', ')) FROM gt WHERE potential_infector IS NOT NULL
), rel AS (
  SELECT DISTINCT doc_id, CASE WHEN kind = 'secondary_case' THEN case_id ELSE x END AS source_case_id,
    CASE WHEN kind = 'secondary_case' THEN x ELSE case_id END AS target_case_id, kind AS relationship_type FROM parts
)"""
_RATES = "CASE WHEN {l} > 0 THEN {m} / {l} ELSE 0 END AS {p}, CASE WHEN {g} > 0 THEN {m} / {g} ELSE 0 END AS {r}"
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"


def _case_metrics(key: str, by_name: bool) -> str:
    where = " WHERE k IS NOT NULL" if by_name else ""
    first = " QUALIFY row_number() OVER (PARTITION BY k ORDER BY row_idx) = 1" if by_name else ""
    rows = lambda t: f"(SELECT * FROM (SELECT {key} AS k, onset_date, row_idx FROM {t}){where}{first})"
    return f"""{SQL}, g AS (SELECT DISTINCT k FROM {rows('gt')}), l AS (SELECT DISTINCT k FROM {rows('llmu')}), n AS (
  SELECT (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM l) AS nl, (SELECT count(*) FROM g JOIN l ON g.k IS NOT DISTINCT FROM l.k) AS nm
), q AS (SELECT *, nm / nl AS p, nm / ng AS r FROM n), d AS (
  SELECT avg(CAST(a.onset_date = b.onset_date OR (a.onset_date IS NULL AND b.onset_date IS NULL) AS INT)) AS date_accuracy
  FROM {rows('gt')} a JOIN {rows('llmu')} b ON a.k IS NOT DISTINCT FROM b.k
)
SELECT round({_F1}, 9) AS case_f1, round(r, 9) AS case_recall, round(p, 9) AS case_precision, round(date_accuracy, 9) AS date_accuracy,
  ng AS n_gt_cases, nl AS n_llm_cases, nm AS n_matched_cases FROM q, d"""


def _list_columns(g: str, x: str) -> str:
    return f"CASE WHEN {null_like(g)} THEN CAST([] AS VARCHAR[]) ELSE {ids(f'upper({g})')} END AS a, CASE WHEN {null_like(x)} THEN CAST([] AS VARCHAR[]) ELSE {ids(f'upper({x})')} END AS b"


_LIST = """SELECT *, CASE WHEN n_gt = 0 AND n_llm = 0 THEN 1.0 WHEN n_gt = 0 THEN 0.0 WHEN n_llm = 0 THEN 1.0 ELSE n_matched / n_llm END AS p,
  CASE WHEN n_gt = 0 AND n_llm = 0 THEN 1.0 WHEN n_gt = 0 THEN 1.0 WHEN n_llm = 0 THEN 0.0 ELSE n_matched / n_gt END AS r
  FROM (SELECT *, CAST(len(a) AS INT) AS n_gt, CAST(len(b) AS INT) AS n_llm, CAST(len(list_filter(a, lambda x: list_contains(b, x))) AS INT) AS n_matched FROM {t})"""


def _variable_metrics(by_name: bool = False) -> str:
    lists, others = ("secondary_cases", "potential_infector"), ("name", "sex", "onset_date")
    rows = ", ".join(f"g.{v} AS {v}_g, l.{v} AS {v}_l" for v in VARIABLES)
    parts = []
    for v in others:
        g, x = f"{v}_g", f"{v}_l"
        parts.append(f"""SELECT '{v}' AS variable, CAST(both_ AS INT) AS n_compared, CAST(tp AS INT) AS n_match, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END AS f1, p AS precision, r AS recall, n_llm / nullif(n_hit, 0) AS completeness_llm, n_gt / n_all AS completeness_gt
  FROM (SELECT *, tp / nullif(n_llm, 0) AS p, tp / nullif(n_gt, 0) AS r FROM (SELECT count(*) FILTER (WHERE hit AND NOT {null_like(g)} AND NOT {null_like(x)}) AS both_,
    count(*) FILTER (WHERE hit AND NOT {null_like(g)} AND NOT {null_like(x)} AND {values_agree(g, x, v)}) AS tp,
    count(*) FILTER (WHERE hit AND NOT {null_like(x)}) AS n_llm, count(*) FILTER (WHERE NOT {null_like(g)}) AS n_gt, count(*) FILTER (WHERE hit) AS n_hit, count(*) AS n_all FROM j))""")
    for v in lists:
        g, x = f"{v}_g", f"{v}_l"
        inner = _LIST.format(t=f"(SELECT *, {_list_columns(g, x)} FROM j)")
        parts.append(f"""SELECT '{v}', CAST(count(*) FILTER (WHERE n_gt > 0 OR n_llm > 0) AS INT), CAST(sum(n_matched) AS INT), avg({_F1}), avg(p), avg(r),
  count(*) FILTER (WHERE hit AND NOT {null_like(x)}) / nullif(count(*) FILTER (WHERE hit), 0), count(*) FILTER (WHERE NOT {null_like(g)}) / count(*) FROM ({inner})""")
    key = name_key("name")
    remap = "SELECT * FROM llmu"
    if by_name:
        remap = f"SELECT l.* REPLACE (coalesce(t.case_id, concat('X', l.case_id)) AS case_id) FROM llmu l LEFT JOIN (SELECT {key} AS k, arg_min(case_id, row_idx) AS case_id FROM gt WHERE {key} IS NOT NULL GROUP BY 1) t ON t.k = {name_key('l.name')}"
    return f"""{SQL}, g1 AS (SELECT * FROM gt QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY row_idx) = 1),
l0 AS ({remap}),
l1 AS (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY row_idx) = 1),
j AS (SELECT l.case_id IS NOT NULL AS hit, {rows} FROM g1 g LEFT JOIN l1 l ON g.case_id = l.case_id),
u AS ({' UNION ALL '.join(parts)})
SELECT variable, n_compared, n_match, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall, round(completeness_llm, 9) AS completeness_llm, round(completeness_gt, 9) AS completeness_gt FROM u"""


def _per_case() -> str:
    rows = " UNION ALL ".join(f"SELECT g.case_id, '{v}' AS variable, {_list_columns(f'g.{v}', f'l.{v}')} FROM gt g JOIN llmu l ON g.case_id IS NOT DISTINCT FROM l.case_id" for v in ("secondary_cases", "potential_infector"))
    only = lambda a, b, inside: f"array_to_string(list_filter({a}, lambda x: {'' if inside else 'NOT '}list_contains({b}, x)), ', ')"
    return f"""{SQL}, t AS ({rows}), m AS ({_LIST.format(t='t')})
SELECT case_id, variable, array_to_string(a, ', ') AS gt_ids, array_to_string(b, ', ') AS llm_ids, {only('a', 'b', True)} AS matched_ids, {only('a', 'b', False)} AS missed_ids, {only('b', 'a', False)} AS invented_ids,
  n_gt, n_llm, n_matched, round(p, 9) AS precision, round(r, 9) AS recall, round({_F1}, 9) AS f1 FROM m"""


_CELLS = ", cells AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col_, NOT {null_like(f'l.{c}')} AS hl, NOT {null_like(f'g.{c}')} AS hg, {cells_match(f'l.{c}', f'g.{c}', c)} AS same FROM llmu l JOIN gt g ON l.case_id = g.case_id" for c in COLUMNS
) + ")"
_MATCHED_CELLS = ", cells AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col_, NOT {null_like(f'l.{c}')} AS hl, NOT {null_like(f'g.{c}')} AS hg, {cells_match(f'l.{c}', f'g.{c}', c)} AS same FROM m JOIN llm l ON l.row_idx = m.llm_idx JOIN gt g ON g.row_idx = m.gt_idx" for c in COLUMNS
) + ")"
_COLUMN_METRICS = f"""{_CELLS}, sums AS (
  SELECT col_, count(*) FILTER (WHERE same AND hl AND hg) AS tp, count(*) FILTER (WHERE hl) AS nl, count(*) FILTER (WHERE hg) AS ng, count(*) FILTER (WHERE hl AND hg) AS nb FROM cells GROUP BY col_
), rates AS (
  SELECT *, {_RATES.format(l='nl', g='ng', m='tp', p='p', r='r')}, CASE WHEN nb > 0 THEN tp / nb ELSE 0 END AS acc FROM sums
), compl AS ({' UNION ALL '.join(f"SELECT '{c}' AS col_, (SELECT avg(CAST(NOT {null_like(c)} AS INT)) FROM llmu) AS cl, (SELECT avg(CAST(NOT {null_like(c)} AS INT)) FROM gt) AS cg" for c in COLUMNS)}),
cm AS (
  SELECT col_, CASE WHEN nl + ng = 0 THEN 1.0 ELSE p END AS precision, CASE WHEN nl + ng = 0 THEN 1.0 ELSE r END AS recall, CASE WHEN nl + ng = 0 THEN 1.0 ELSE {_F1} END AS f1_score,
    CASE WHEN nl + ng = 0 THEN 1.0 ELSE acc END AS accuracy, cl AS completeness_llm, cg AS completeness_gt FROM rates JOIN compl USING (col_)
)"""
_SIX = ("precision", "recall", "f1_score", "accuracy", "completeness_llm", "completeness_gt")
_OVERLAP = " UNION ALL ".join(
    f"SELECT '{c}' AS col_, (SELECT count(DISTINCT {c}) FROM llm WHERE NOT {null_like(c)}) AS nl, (SELECT count(DISTINCT {c}) FROM gt WHERE NOT {null_like(c)}) AS ng, "
    f"(SELECT count(*) FROM (SELECT {c} FROM llm WHERE NOT {null_like(c)} INTERSECT SELECT {c} FROM gt WHERE NOT {null_like(c)})) AS tp" for c in COLUMNS
)

#: Serial choice in row order: each step takes the next extracted row and its best true row that is free.
_GREEDY = f"""{SQL}, a AS (SELECT row_idx, name, list_distinct({tokens('name')}) AS w FROM llm), b AS (SELECT row_idx, list_distinct({tokens('name')}) AS w FROM gt),
cand AS MATERIALIZED (
  SELECT x.l, x.g, x.n / (la + lb - x.n) AS sim FROM (
    SELECT p.row_idx AS l, q.row_idx AS g, any_value(p.la) AS la, any_value(q.lb) AS lb, count(*) AS n
    FROM (SELECT row_idx, len(w) AS la, unnest(w) AS t FROM a) p JOIN (SELECT row_idx, len(w) AS lb, unnest(w) AS t FROM b) q USING (t) GROUP BY 1, 2
  ) x WHERE x.n / (la + lb - x.n) >= 0.5
), ord AS MATERIALIZED (
  SELECT dense_rank() OVER (ORDER BY l) AS i, l, list({{'g': g, 's': sim}} ORDER BY sim DESC, g) AS c FROM cand GROUP BY l
), step AS (
  SELECT 0 AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS g, CAST(NULL AS DOUBLE) AS s
  UNION ALL
  SELECT o.i, CASE WHEN h IS NULL THEN used ELSE list_append(used, h.g) END, o.l, h.g, h.s
  FROM (SELECT o.i, o.l, step.used, list_filter(o.c, lambda x: NOT list_contains(step.used, x.g))[1] AS h FROM step JOIN ord o ON o.i = step.i + 1) o
), m AS (SELECT l AS llm_idx, g AS gt_idx, s AS similarity FROM step WHERE g IS NOT NULL)"""
_MONTHS = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"
_NARRATIVE = "concat('Intro about SYN9.', chr(10), '- SYN', doc_id, ' (', text, ') met SYN', doc_id + 1, '.', chr(10), '- Secondary: SYNx', doc_id, ' saw SYN', doc_id, ' end')"
_PROMPT = "concat('Extract the cases.', chr(10), '<outbreak_narrative>', chr(10), {}, chr(10), '</outbreak_narrative>')"
_FIGURES = ("case_f1", "case_recall", "case_precision", "secondary_f1", "secondary_recall", "secondary_precision", "infector_f1", "infector_recall", "infector_precision", "date_accuracy", "time_total_sec", "time_per_case_sec")


def _replicates() -> str:
    from casegrid.operators.metrics import STATS

    short = {"time_total_sec": "time_total", "time_per_case_sec": "time_per_case"}
    form = {"median": "median({c})", "q25": "quantile_cont({c}, 0.25)", "q75": "quantile_cont({c}, 0.75)", "iqr": "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", "min": "min({c})", "max": "max({c})", "sd": "stddev_samp({c})"}
    stats = ", ".join(f"round({form[s].format(c=c)}, 9) AS {short.get(c, c)}_{s}" for c, ss in STATS.items() for s in ss)
    of = lambda m, s: _percent(form[s].format(c=m))
    figures = [m for m in STATS if not m.startswith("time")]
    stats += "".join(f", concat({of(m, 'median')}, '% (', {of(m, 'min')}, '-', {of(m, 'max')}, ')') AS {m}_range" for m in figures)
    stats += "".join(f", concat({of(m, 'median')}, '% [IQR: ', {of(m, 'q25')}, '-', {of(m, 'q75')}, ']') AS {m}_iqr_str" for m in figures if "iqr" in STATS[m])
    cols = ", ".join(f"round((event_id * {7 + 2 * i} % 1009) / 1009, 6) AS {c}" for i, c in enumerate(STATS))
    return f"SELECT model, provider, strategy, count(*) AS n_replicates, {stats} FROM (SELECT concat('m', user_id % 5) AS model, event_type AS provider, 'Unchunked' AS strategy, event_id, {cols} FROM events WHERE event_id % 9 <> 0) GROUP BY 1, 2, 3"


#: Every id that the narrative of a document mentions inside a record, written by its places.
_MENTIONS = f"""d AS (SELECT doc_id, {_NARRATIVE} AS c FROM documents), h AS (
        SELECT doc_id, strpos(c, concat(') met SYN', doc_id + 1, '.', chr(10), '- Secondary: SYNx')) AS m FROM d),
      p AS (SELECT doc_id, m, m + length(concat(') met SYN', doc_id + 1, '.')) + 1 AS s2 FROM h),
      u AS (SELECT doc_id, 19 AS record_start, concat('SYN', doc_id) AS record_case_id, concat('SYN', doc_id) AS case_id, 21 AS s FROM p
        UNION ALL SELECT doc_id, 19, concat('SYN', doc_id), concat('SYN', doc_id + 1), m + 6 FROM p
        UNION ALL SELECT doc_id, s2, concat('SYNX', doc_id), concat('SYNX', doc_id), s2 + 13 FROM p
        UNION ALL SELECT doc_id, s2, concat('SYNX', doc_id), concat('SYN', doc_id), s2 + 13 + length(concat('SYNX', doc_id)) + 5 FROM p)"""


def _html(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _percent(x: str) -> str:
    return f"coalesce(regexp_replace(CAST(CAST(round({x} * 100, 1) AS DOUBLE) AS VARCHAR), '\\.0$', ''), 'NA')"


_FLAG = "CASE conv_id % 7 WHEN 0 THEN ' NULL ' WHEN 1 THEN 'null' WHEN 2 THEN '[]' WHEN 3 THEN '' WHEN 4 THEN 'NA' WHEN 5 THEN NULL ELSE role END"
ORACLE: dict[str, str] = {
    "case_metrics": _case_metrics("case_id", False),
    "case_metrics_by_name": _case_metrics(name_key("name"), True),
    "variable_metrics": _variable_metrics(),
    "variable_metrics_by_name": _variable_metrics(True),
    "variable_metrics_without_true_cases": " UNION ALL ".join(f"SELECT '{v}' AS variable, CAST(0 AS INT) AS n_compared, CAST(0 AS INT) AS n_match, {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in ('f1', 'precision', 'recall', 'completeness_llm', 'completeness_gt'))}" for v in VARIABLES),
    "first_place": f"{SQL} SELECT row_idx AS asked, (SELECT min(b.row_idx) FROM gt b WHERE b.name IS NOT DISTINCT FROM a.name) AS place FROM gt a",
    "record_page": f"{SQL} SELECT row_idx, case_id FROM gt ORDER BY row_idx LIMIT 10 OFFSET 20",
    "malformed_responses": "SELECT event_id AS doc_id, CAST(0 AS BIGINT) AS row_idx, concat('A', event_id) AS case_id FROM events WHERE event_id % 5 < 4",
    "per_case_list_metrics": _per_case(),
    "few_shot_exclusion": f"{SQL} SELECT row_idx, case_id FROM gt WHERE coalesce(case_id NOT IN ('SAA001', 'SAA002', 'SAA003'), true)",
    "semi_join": f"{SQL} SELECT row_idx, case_id FROM gt WHERE case_id IN (SELECT case_id FROM llmu)",
    "anti_join": f"{SQL} SELECT row_idx, case_id FROM gt WHERE case_id NOT IN (SELECT case_id FROM llmu)",
    "first_per_key": f"{SQL} SELECT {name_key('name')} AS case_id, min(row_idx) AS row_idx FROM gt GROUP BY 1",
    "schema_align": f"{SQL} SELECT row_idx, case_id, name, sex, onset_date, potential_infector FROM gt",
    "null_like_flags": f"""SELECT conv_id, turn, {null_like('v')} AS n1, coalesce(v IN ('', 'null'), true) AS n2, coalesce(v = '' OR lower(v) = 'null', true) AS n3,
      coalesce(lower(trim(v)) IN ('', 'null', 'na', 'none', '[]'), true) AS n4, coalesce(trim(v) IN ('', 'NA', 'NULL', 'null'), true) AS n5, coalesce(trim(v) <> '' AND lower(v) <> 'null', false) AS n6
      FROM (SELECT conv_id, turn, {_FLAG} AS v FROM conversations)""",
    "case_ids_extract": f"{SQL} SELECT row_idx, unnest({ids('secondary_cases')}) AS id FROM gt",
    "name_tokens": f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens FROM documents",
    "name_keys": f"{SQL} SELECT row_idx, {name_key('name')} AS name_key FROM gt",
    "transliterate": f"SELECT doc_id, sha256({plain('text')}) AS plain_sha256 FROM documents",
    "json_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "linelist_parse": f"""{SQL} SELECT row_idx // 20 AS doc_id, row_number() OVER (PARTITION BY row_idx // 20 ORDER BY row_idx) - 1 AS row_idx, upper(case_id) AS case_id, name, sex, onset_date,
      CASE WHEN secondary_cases = '[]' THEN NULL ELSE secondary_cases END AS secondary_cases, potential_infector FROM llm""",
    "list_column_normalize": f"{SQL} SELECT row_idx, CASE WHEN secondary_cases = '[]' THEN NULL ELSE secondary_cases END AS secondary_cases FROM llm",
    "dedupe_linelist": f"""{SQL}, both_ AS (SELECT * FROM llm UNION ALL SELECT row_idx + 10000000, case_id, name, 'null', onset_date, secondary_cases, potential_infector FROM llm),
      k AS (SELECT * REPLACE (nullif(trim(upper(case_id)), '') AS case_id), coalesce({name_key('name')} || ' ' || coalesce(onset_date, 'NA'), nullif(trim(upper(case_id)), ''), 'row_' || row_idx) AS k FROM both_)
      SELECT {', '.join(f"coalesce(arg_min({c}, row_idx) FILTER (WHERE {c} IS NOT NULL AND trim({c}) <> '' AND lower({c}) <> 'null'), arg_min_null({c}, row_idx)) AS {c}" for c in COLUMNS)} FROM k GROUP BY k""",
    "greedy_match": f"{_GREEDY} SELECT llm_idx, gt_idx, llm.name AS case_name, round(similarity, 9) AS similarity FROM m JOIN llm ON llm.row_idx = llm_idx",
    "similar_names": f"""{SQL}, a AS (SELECT DISTINCT list_distinct({tokens('name')}) AS w FROM llm), b AS (SELECT DISTINCT list_distinct({tokens('name')}) AS w FROM gt),
      p AS (SELECT a.w AS a, b.w AS b, len(list_intersect(a.w, b.w)) AS n FROM a JOIN b ON list_has_any(a.w, b.w))
      SELECT array_to_string(list_sort(a), ' ') AS a, array_to_string(list_sort(b), ' ') AS b, round(n / (len(a) + len(b) - n), 9) AS similarity FROM p WHERE n / (len(a) + len(b) - n) >= 0.5""",
    "approximate_name_join": f"""{SQL}, a AS (SELECT DISTINCT name AS a FROM llm WHERE name IS NOT NULL), b AS (SELECT DISTINCT name AS b FROM gt WHERE name IS NOT NULL)
      SELECT a, b FROM a, b WHERE {near_either('a', 'b')}""",
    "case_detection": f"""{_GREEDY}, n AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM llm) AS nl, (SELECT count(*) FROM gt) AS ng), q AS (SELECT *, {_RATES.format(l='nl', g='ng', m='tp', p='p', r='r')} FROM n)
      SELECT tp AS true_positives, nl - tp AS false_positives, ng - tp AS false_negatives, round(p, 9) AS precision, round(r, 9) AS recall, round({_F1}, 9) AS f1_score FROM q""",
    "case_names": f"""{_GREEDY} SELECT CASE WHEN row_idx IN (SELECT llm_idx FROM m) THEN 'detected' ELSE 'extra' END AS status, row_idx, name FROM llm
      UNION ALL SELECT 'missed', row_idx, name FROM gt WHERE row_idx NOT IN (SELECT gt_idx FROM m)""",
    "linelist_comparison": f"{_GREEDY}{_COLUMN_METRICS.replace(_CELLS, _MATCHED_CELLS).replace('FROM llmu)', 'FROM llm)')} SELECT col_ AS \"column\", {', '.join(f'round({c}, 9) AS {c}' for c in _SIX)} FROM cm",
    "fp_analysis": f"{_GREEDY} SELECT row_idx AS llm_idx, name, CASE WHEN name IS NULL OR name IN ('', 'null') THEN 'Empty/Null Name' WHEN length(name) < 3 THEN 'Noise/Fragment' ELSE 'Hallucination / Extra Extraction' END AS category FROM llm WHERE row_idx NOT IN (SELECT llm_idx FROM m)",
    "fn_analysis": f"{_GREEDY} SELECT row_idx AS gt_idx, name, CASE WHEN name IS NULL OR name IN ('', 'null') THEN 'Empty GT Name' ELSE 'Missed Case' END AS category FROM gt WHERE row_idx NOT IN (SELECT gt_idx FROM m)",
    "column_metrics": f"{SQL}{_COLUMN_METRICS} SELECT col_ AS \"column\", {', '.join(f'round({c}, 9) AS {c}' for c in _SIX)} FROM cm",
    "overall_metrics": f"{SQL}{_COLUMN_METRICS} SELECT {', '.join(f'round(avg({c}), 9) AS {c}' for c in _SIX)}, count(precision) AS n_columns_compared FROM cm",
    "error_breakdown": f"""{SQL}{_CELLS} SELECT col_ AS "column", CASE WHEN hg AND NOT hl THEN 'False Negative (Missing Value)' WHEN hl AND NOT hg THEN 'False Positive (Hallucinated Value)' WHEN hl AND hg THEN 'Content Mismatch' ELSE 'Other' END AS error_type, count(*) AS n
      FROM cells WHERE NOT same GROUP BY 1, 2""",
    "unmatched_overlap_metrics": f"""{SQL}, o AS ({_OVERLAP}), q AS (SELECT *, {_RATES.format(l='nl', g='ng', m='tp', p='p', r='r')} FROM o)
      SELECT col_ AS "column", CASE WHEN nl + ng = 0 THEN 1.0 ELSE round(p, 9) END AS precision, CASE WHEN nl + ng = 0 THEN 1.0 ELSE round(r, 9) END AS recall, CASE WHEN nl + ng = 0 THEN 1.0 ELSE round({_F1}, 9) END AS f1_score,
      CASE WHEN nl + ng = 0 THEN 1.0 ELSE round(tp / (nl + ng - tp), 9) END AS accuracy FROM q""",
    "agrep_names": f"{SQL} SELECT l.row_idx AS llm_idx, coalesce({near_either('l.name', 'g.name')}, false) AS near FROM llmu l JOIN gt g ON l.case_id = g.case_id",
    "relationships": f"{SQL}{_EDGES} SELECT * FROM rel",
    "nodes": f"""{SQL}{_EDGES}, i AS (SELECT case_id AS id FROM gt UNION SELECT source_case_id FROM rel UNION SELECT target_case_id FROM rel),
      j AS (SELECT i.id, name, sex, CASE WHEN name IS NULL AND sex IS NULL THEN 'Referenced only' WHEN sex = 'female' THEN 'Female' WHEN sex = 'male' THEN 'Male' ELSE 'Unknown' END AS "group" FROM i LEFT JOIN gt ON i.id = gt.case_id)
      SELECT id, coalesce(name, id) AS label, "group", concat('<b>', id, '</b><br>Name: ', coalesce(name, 'Unknown'), '<br>Sex: ', coalesce(sex, 'Unknown'), '<br>Age: Unknown<br>Outcome: Unknown') AS title,
      CASE "group" WHEN 'Female' THEN '#d95f5f' WHEN 'Male' THEN '#2c7fb8' WHEN 'Referenced only' THEN '#bdbdbd' ELSE '#756bb1' END AS color_background, '#ffffff' AS color_border FROM j""",
    "relationships_by_document": f"{SQL}{_DOC_EDGES} SELECT * FROM rel",
    "nodes_by_document": f"""{SQL}{_DOC_EDGES}, i AS (SELECT row_idx % 2 AS doc_id, case_id AS id FROM gt UNION SELECT doc_id, source_case_id FROM rel UNION SELECT doc_id, target_case_id FROM rel)
      SELECT i.doc_id, i.id, coalesce(name, i.id) AS label, CASE WHEN name IS NULL AND sex IS NULL THEN 'Referenced only' WHEN sex = 'female' THEN 'Female' WHEN sex = 'male' THEN 'Male' ELSE 'Unknown' END AS "group"
      FROM i LEFT JOIN gt ON i.id = gt.case_id AND i.doc_id = gt.row_idx % 2""",
    "edges": f"""{SQL}{_EDGES} SELECT source_case_id AS "from", target_case_id AS "to", relationship_type AS label, relationship_type AS title, relationship_type = 'contact' AS dashes, 'to' AS arrows,
      CASE relationship_type WHEN 'secondary_case' THEN '#1b9e77' ELSE '#7570b3' END AS color FROM rel""",
    "link_closure": f"{SQL}{_EDGES} SELECT source_case_id AS case_id, target_case_id AS contact_id FROM rel UNION SELECT target_case_id, source_case_id FROM rel",
    "missing_mirror_edges": f"""{SQL}{_EDGES}, a AS (SELECT source_case_id, target_case_id FROM rel WHERE relationship_type = 'secondary_case'), b AS (SELECT source_case_id, target_case_id FROM rel WHERE relationship_type = 'potential_infector')
      SELECT *, 'potential_infector' AS missing FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'secondary_case' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "transmission_degree": f"""{SQL}{_EDGES}, p AS (SELECT DISTINCT source_case_id AS s, target_case_id AS t FROM rel)
      SELECT case_id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT s AS case_id, 1 AS o, 0 AS i FROM p UNION ALL SELECT t, 0, 1 FROM p) GROUP BY case_id""",
    "metrics_rows": """WITH r AS (SELECT concat('m', user_id % 5) AS model, event_type AS provider, CASE WHEN user_id % 2 = 0 THEN 'Chunked' ELSE 'Unchunked' END AS strategy, event_id AS replicate, CASE WHEN event_id % 9 = 0 THEN 'Failed' ELSE 'Success' END AS status,
        CASE WHEN event_id % 9 <> 0 THEN value END AS v, CASE WHEN event_id % 9 <> 0 AND event_id % 3 = 0 THEN value END AS w FROM events)
      SELECT model, provider, strategy, replicate, status, CASE WHEN status = 'Failed' THEN 'failed' END AS error, 1 AS attempts, round(v / 1000, 9) AS case_f1, round(v / 2000, 9) AS case_recall, round(v / 4000, 9) AS case_precision,
        round(w * 15 / 1000, 9) AS secondary_f1, round(w * 15 / 3000, 9) AS secondary_recall, round(w * 15 / 2000, 9) AS secondary_precision, round(w * 18 / 1000, 9) AS infector_f1, round(w * 18 / 3000, 9) AS infector_recall, round(w * 18 / 2000, 9) AS infector_precision,
        round(v / 5000, 9) AS date_accuracy, round(v, 9) AS time_total_sec, round(CASE WHEN replicate % 4 > 0 THEN v / (replicate % 4) END, 9) AS time_per_case_sec,
        CASE WHEN v IS NOT NULL THEN concat('job', replicate) END AS slurm_job_id, round(v / 7, 9) AS slurm_exec_time_sec FROM r""",
    "replicate_aggregate": _replicates(),
    "replicate_strings": f"SELECT event_id, concat({_percent('(event_id % 1000) / 1000')}, '% (', {_percent('CASE WHEN event_id % 5 > 0 THEN (event_id % 100) / 100 END')}, ')') AS s FROM events",
    "source_records": f"""WITH d AS (SELECT doc_id, {_NARRATIVE} AS c FROM documents), h AS (
        SELECT doc_id, length(c) AS n, 19 AS s1, strpos(c, concat(') met SYN', doc_id + 1, '.', chr(10), '- Secondary: SYNx')) + length(concat(') met SYN', doc_id + 1, '.')) + 1 AS s2 FROM d)
      SELECT doc_id, concat('SYN', doc_id) AS case_id, CAST(s1 AS BIGINT) AS start, CAST(s2 - 1 AS BIGINT) AS "end" FROM h UNION ALL SELECT doc_id, concat('SYNX', doc_id), CAST(s2 AS BIGINT), CAST(n AS BIGINT) FROM h""",
    "source_mentions": f"""WITH {_MENTIONS}
      SELECT doc_id, CAST(record_start AS BIGINT) AS record_start, record_case_id, case_id, CAST(s AS BIGINT) AS start, CAST(s + length(case_id) - 1 AS BIGINT) AS "end" FROM u""",
    "cited_mentions": f"""WITH {_MENTIONS}, n AS (SELECT doc_id, length(c) AS n FROM d),
      x AS (SELECT doc_id, 0 AS row_idx, 1 AS low, n // 2 + 40 AS high FROM n UNION ALL SELECT doc_id, 1, n // 3 + 1, n FROM n UNION ALL SELECT doc_id, 2, n // 2 + 1, least(n, n // 2 + 200) FROM n)
      SELECT doc_id, row_idx, CAST(low AS BIGINT) AS span_start, CAST(high AS BIGINT) AS span_end, case_id, CAST(s AS BIGINT) AS start, CAST(s + length(case_id) - 1 AS BIGINT) AS "end"
      FROM u JOIN x USING (doc_id) WHERE s >= low AND s + length(case_id) - 1 <= high""",
    "cell_matches": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'female' ELSE 'male' END AS sex, CASE WHEN doc_id % 2 = 0 THEN 'male' ELSE 'female' END AS other FROM documents),
      c AS (SELECT *, concat('Report.', chr(10), '- SYN', doc_id, ' not ', other, 's is ', sex, ', met SYN', doc_id + 1, '0 and SYN', doc_id + 1, '. Died.', chr(10), '- SYN', doc_id, '9 is other.') AS c FROM d),
      u AS (SELECT doc_id, 'sex' AS field, strpos(c, concat('s is ', sex)) + 5 AS s, length(sex) AS n FROM c
        UNION ALL SELECT doc_id, 'outcome', strpos(c, 'Died'), 4 FROM c
        UNION ALL SELECT doc_id, 'contacts', strpos(c, ' and SYN') + 5, length(concat('SYN', doc_id + 1)) FROM c
        UNION ALL SELECT doc_id, 'onset_date', 11, length(concat('SYN', doc_id)) FROM c)
      SELECT doc_id, 0 AS row_idx, field, CAST(s AS BIGINT) AS start, CAST(s + n - 1 AS BIGINT) AS "end" FROM u""",
    "date_search_variants": f"""{SQL} SELECT row_idx, coalesce(CASE WHEN onset_date IS NOT NULL THEN concat(onset_date, '|', d, ' ', m, ' ', y, '|', d, ' ', lower(m), ' ', y, '|', d, ' ', m) END, '') AS variants
      FROM (SELECT *, CAST(split_part(onset_date, '/', 1) AS INT) AS d, {_MONTHS}[CAST(split_part(onset_date, '/', 2) AS INT)] AS m, split_part(onset_date, '/', 3) AS y FROM gt)""",
    "reference_id_lists": f"{SQL} SELECT row_idx, coalesce(CASE WHEN secondary_cases = '[]' AND row_idx % 2 = 0 THEN '' ELSE replace(secondary_cases, ', ', '|') END, '') AS ids FROM llm",
    "prompt_bind": f"SELECT doc_id, sha256({_PROMPT.format('text')}) AS prompt_sha256 FROM documents",
    "few_shot_insert": f"""SELECT conv_id, turn, sha256(CASE WHEN turn % 3 = 0 OR trim(text) = '' THEN {_PROMPT.format("'x'")} ELSE concat('Extract the cases.', chr(10), text, chr(10), '<outbreak_narrative>', chr(10), 'x', chr(10), '</outbreak_narrative>') END) AS prompt_sha256 FROM conversations""",
    "auto_prompt_sample": "SELECT doc_id, sha256(array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 400), ' ')) AS sample_sha256 FROM documents",
    "token_cost": """SELECT conv_id, turn, CAST(n AS BIGINT) AS tokens, round(CASE conv_id % 3 WHEN 0 THEN (n * 1.25 + 2 * n * 10) / 1e6 WHEN 1 THEN (n * 2.5 + 2 * n * 10) / 1e6 END, 9) AS cost FROM (SELECT *, ceil(length(text) / 4) AS n FROM conversations)""",
    "record_unpivot": f"{SQL}, u AS ({' UNION ALL '.join(f"SELECT row_idx, '{c}' AS field, {c} AS value FROM gt" for c in COLUMNS)}) SELECT row_idx, field, coalesce(value, '') AS value FROM u",
    "row_labels": f"{SQL} SELECT row_idx, CASE WHEN coalesce(name, '') = '' THEN case_id ELSE concat(case_id, ' - ', name) END AS label FROM gt",
    "block_offsets": """SELECT conv_id AS doc_id, turn AS pos, CAST("end" - n AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM (SELECT *, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS "end" FROM conversations)""",
    "citations_for_case": """SELECT b.conv_id AS doc_id, b.turn AS pos, b.role AS cited_text, b.turn AS start_char_index FROM (SELECT conv_id, split_part(text, ' ', 1) AS name FROM conversations WHERE turn = 0) c JOIN conversations b USING (conv_id)
      WHERE length(name) > 0 AND contains(lower(b.text), lower(name))""",
    "case_spans": f"""{SQL}, d AS (SELECT doc_id, case_id, name, CASE WHEN doc_id % 2 = 0 THEN concat(text, chr(10), chr(10), 'Case ', case_id, ' here. ', text) ELSE text END AS c FROM documents JOIN gt ON row_idx = doc_id),
      p AS (SELECT *, CASE WHEN strpos(c, case_id) > 0 THEN strpos(c, case_id) WHEN length(name) > 0 THEN strpos(lower(c), lower(name)) ELSE 0 END AS pos FROM d),
      q AS (SELECT *, length(c) AS n, greatest(1, pos - 2000) AS low, substring(c, greatest(1, pos - 2000), pos - greatest(1, pos - 2000)) AS b FROM p WHERE pos > 0),
      r AS (SELECT *, length(regexp_extract(b, '(?s)^(.*(?:\\n\\n|\\n>))', 1)) AS head FROM q)
      SELECT doc_id, doc_id AS row_idx, sha256(substring(c, pos, least(n, pos + 400) - pos + 1)) AS cited_sha256, CAST(CASE WHEN head > 0 THEN low + head ELSE greatest(1, pos - 200) END - 1 AS BIGINT) AS start_char_index, CAST(least(n, pos + 2000) - 1 AS BIGINT) AS end_char_index FROM r""",
    "names_in_id_columns": f"""{SQL}, k AS (SELECT {name_key('name')} AS k, arg_min(case_id, row_idx) AS id FROM gt WHERE {name_key('name')} IS NOT NULL GROUP BY 1),
      r AS (SELECT row_idx, CASE row_idx % 3 WHEN 0 THEN concat_ws(', ', name, 'Nobody Known') WHEN 1 THEN name ELSE potential_infector END AS v, CASE WHEN row_idx % 3 < 2 THEN name END AS n FROM llmu)
      SELECT row_idx, CASE WHEN row_idx % 3 < 2 AND NOT {null_like('n')} AND len({ids('upper(v)')}) = 0 THEN coalesce(id, v) ELSE v END AS potential_infector FROM r LEFT JOIN k ON k.k = {name_key('n')}""",
    "highlighted_documents": f"""WITH c AS (SELECT doc_id, concat('<b>&amp; ', doc_id, '</b> ', text) AS c FROM documents)
      SELECT doc_id, sha256(concat({_html('substring(c, 1, 1)')}, '<mark>', {_html('substring(c, 2, 5)')}, '</mark>', {_html('substring(c, 7, 13)')}, '<mark>', {_html('substring(c, 20, 10)')}, '</mark>', {_html('substring(c, 30)')})) AS html_sha256 FROM c""",
    "longest_word_cells": """WITH c AS (SELECT doc_id, concat('- SYN', doc_id, ' of Betalong', doc_id, ', fell ill on ', doc_id % 27 + 1, ' ', CASE WHEN doc_id % 2 = 0 THEN 'March' ELSE 'may' END, ' 2026 at Alphaxx.') AS c, CASE WHEN doc_id % 2 = 0 THEN 'March' ELSE 'may' END AS m FROM documents),
      u AS (SELECT doc_id, 'residence_village' AS field, strpos(c, 'Betalong') AS s, length(concat('Betalong', doc_id)) AS n FROM c
        UNION ALL SELECT doc_id, 'profession', 3, length(concat('SYN', doc_id)) FROM c
        UNION ALL SELECT doc_id, 'onset_date', strpos(c, ' ill on ') + 8, length(concat(doc_id % 27 + 1, ' ', m, ' 2026')) FROM c)
      SELECT doc_id, 0 AS row_idx, field, CAST(s AS BIGINT) AS start, CAST(s + n - 1 AS BIGINT) AS "end" FROM u""",
    "cited_cells": """WITH c AS (SELECT doc_id, concat('- SYN', doc_id, ' male here. One says female, and Died. Two says male and Died.') AS c FROM documents),
      u AS (SELECT doc_id, 'sex' AS field, strpos(c, 'Two says ') + 9 AS s, 4 AS n FROM c
        UNION ALL SELECT doc_id, 'outcome', strpos(c, 'Died'), 4 FROM c
        UNION ALL SELECT doc_id, 'profession', strpos(c, 'here'), 4 FROM c)
      SELECT doc_id, 0 AS row_idx, field, CAST(s AS BIGINT) AS start, CAST(s + n - 1 AS BIGINT) AS "end" FROM u""",
    "auto_prompt": "SELECT doc_id, sha256(concat('Extract the cases.', chr(10), '<outbreak_narrative>', chr(10), '{{content}}', chr(10), '</outbreak_narrative>', chr(10), chr(10), 'Document sample:', chr(10), array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 25), ' '), chr(10), chr(10), 'Provider: azure. Model: gpt-5.')) AS prompt_sha256 FROM documents",
    "prompt_instructions": "SELECT conv_id, turn, sha256(CASE WHEN turn % 2 = 0 THEN text ELSE concat(text, ' end') END) AS prompt_sha256 FROM conversations",
    "arranged_relationships": f"{SQL}{_EDGES} SELECT relationship_type, source_case_id, target_case_id FROM rel ORDER BY ALL LIMIT 50",
    "run_metadata": """SELECT conv_id AS doc_id, unnest(['document', 'content_type', 'provider', 'model', 'system_prompt', 'deduplication', 'cases_extracted', 'relationships_extracted']) AS metric,
      unnest(['first turn', '-', 'ollama', 'gpt-4o', 'linelist_prompt.txt', 'enabled', '2', '1']) AS value FROM conversations WHERE turn = 0""",
    "stable_first_rows": f"{SQL} SELECT l.row_idx, (SELECT min(g.row_idx) FROM gt g WHERE g.name IS NOT DISTINCT FROM l.name) AS true_idx FROM llm l WHERE EXISTS (SELECT 1 FROM gt g WHERE g.name IS NOT DISTINCT FROM l.name)",
}
ORACLE["merged_stream"] = f"""{SQL}, both_ AS (SELECT * FROM llm UNION ALL SELECT row_idx + 10000000, case_id, name, 'null', onset_date, secondary_cases, potential_infector FROM llm),
  k AS (SELECT * REPLACE (nullif(trim(upper(case_id)), '') AS case_id), row_idx % 2 AS doc_id, coalesce({name_key('name')} || ' ' || coalesce(onset_date, 'NA'), nullif(trim(upper(case_id)), ''), 'row_' || row_idx) AS k FROM both_)
  SELECT doc_id, {', '.join(f"coalesce(arg_min({c}, row_idx) FILTER (WHERE {c} IS NOT NULL AND trim({c}) <> '' AND lower({c}) <> 'null'), arg_min_null({c}, row_idx)) AS {c}" for c in COLUMNS)} FROM k GROUP BY doc_id, k"""
ORACLE["ledger_calls"] = """WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '  ' ELSE concat(role, ': ', text) END AS p FROM conversations),
  n AS (SELECT conv_id, turn, trim(p) <> '' AS ok, CAST(ceil(length(p) / 4) AS BIGINT) AS n, CAST(ceil(length('<linelist>[]</linelist>') / 4) AS BIGINT) AS m FROM p)
  SELECT conv_id, turn, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, CASE WHEN ok THEN n ELSE 0 END AS prompt_tokens, CASE WHEN ok THEN n + m ELSE 0 END AS total_tokens, CASE WHEN ok THEN round((n * 2.5 + m * 10) / 1e6, 9) ELSE 0 END AS cost FROM n"""
#: The passages of the cases with odd numbers, and the given ones of the others.
ORACLE["filled_citations"] = f"""SELECT doc_id, row_idx, cited_sha256, start_char_index, end_char_index FROM ({ORACLE['case_spans']}) WHERE row_idx % 2 = 1
  UNION ALL SELECT doc_id, doc_id, sha256('quoted'), 3, 9 FROM documents WHERE doc_id % 2 = 0"""
