"""DuckDB oracle SQL: the same results computed independently over the flat fixtures.

Spark builds nested records and folds over arrays; the oracle scores from the long tables with
pair joins (one-to-one by construction of the fixtures), so the two paths share only the
fixture text. Helpers return SQL text fragments; ``with_ctes`` prepends the fixture CTEs.
"""
from __future__ import annotations

from .constants import DEFAULT_MODEL, FIELD_LABELS, MODEL_SHORT, PRICES, SCORED_FIELDS
from .functions.text import CASEFOLD_EXTRA
from .sources.fixtures import duckdb_ctes

NUM_RE = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def casefold(x: str) -> str:
    out = f"lower({x})"
    for a, b in CASEFOLD_EXTRA:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


def norm(x: str) -> str:
    return f"trim(regexp_replace({casefold(f"coalesce({x}, '')")}, '[^a-z0-9]+', ' ', 'g'))"


def num(x: str) -> str:
    """Trimmed plain number to DOUBLE, else NULL."""
    return f"(CASE WHEN regexp_full_match({strip(x)}, '{NUM_RE}') THEN TRY_CAST({strip(x)} AS DOUBLE) END)"


def score_num(x: str) -> str:
    return num(f"regexp_replace({x}, '[,$]', '', 'g')")


def price(model: str, which: int) -> str:
    whens = " ".join(f"WHEN {q(m)} THEN {p[which]}" for m, p in PRICES.items())
    return f"(CASE {model} {whens} ELSE {PRICES[DEFAULT_MODEL][which]} END)"


def model_short(model: str) -> str:
    whens = " ".join(f"WHEN {q(m)} THEN {q(s)}" for m, s in MODEL_SHORT.items())
    return f"(CASE {model} {whens} ELSE {model} END)"


def field_label(field: str) -> str:
    whens = " ".join(f"WHEN {q(f)} THEN {q(lab)}" for f, lab in FIELD_LABELS.items())
    return f"(CASE {field} {whens} ELSE {field} END)"


def b2d(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)"


def r9(x: str) -> str:
    return f"CAST(round({x}, 9) AS DOUBLE)"


WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {WHITE})"


def pct(x: str) -> str:
    return (f"(CASE WHEN abs({x} * 100 - round_even({x} * 100, 0)) < 0.05 THEN printf('%.0f%%', round_even({x} * 100, 0)) "
            f"ELSE printf('%.1f%%', {x} * 100) END)")


def fixed(x: str, places: int) -> str:
    return f"printf('%.{places}f', {x})"


def field_score_sql(f: str, p: str, t: str) -> str:
    if f in ("subtotal", "tax", "total"):
        return b2d(f"coalesce({score_num(p)} IS NOT NULL AND abs({score_num(p)} - CAST({t} AS DOUBLE)) < 0.011, false)")
    if f in ("invoice_date", "due_date"):
        return b2d(f"coalesce(substr(coalesce({p}, ''), 1, 10) = {t}, false)")
    if f == "currency":
        return b2d(f"coalesce({strip(f"upper(coalesce({p}, ''))")} = {t}, false)")
    return b2d(f"{norm(p)} = {norm(t)}")


# Scored rows of the fixture runs: o_scored(run_id, dataset, file, k, layout, format, meta,
# prediction columns, tokens, cost_usd, seconds, model, note, error, s_<field>..., overall)
SCORED_CTES = f"""
o_pcount AS (SELECT run_id, file, count(*) AS n_pred FROM run_items GROUP BY run_id, file),
o_tcount AS (SELECT k, count(*) AS n_true FROM inv_lines GROUP BY k),
o_match AS (
  -- equal lines of a document pair off as often as both sides have them
  SELECT i.run_id, i.file, CAST(sum(least(i.n, l.n)) AS BIGINT) AS n_match
  FROM (SELECT run_id, file, {score_num('quantity')} AS q, {score_num('amount')} AS a, count(*) AS n FROM run_items GROUP BY ALL) i
  JOIN run_calls c ON c.run_id = i.run_id AND c.file = i.file
  JOIN (SELECT k, quantity, amount, count(*) AS n FROM inv_lines GROUP BY ALL) l ON l.k = c.k
  WHERE i.q = l.quantity AND abs(i.a - CAST(l.amount AS DOUBLE)) < 0.011
  GROUP BY i.run_id, i.file
),
o_base AS (
  SELECT r.run_id, t.dataset, t.file, t.k, t.layout, t.format, t.due_date_from_terms_only,
         coalesce(c.has_fields, false) AS has_fields,
         c.vendor_name AS p_vendor_name, c.invoice_number AS p_invoice_number, c.invoice_date AS p_invoice_date,
         c.due_date AS p_due_date, c.bill_to AS p_bill_to, c.currency AS p_currency,
         c.subtotal AS p_subtotal, c.tax AS p_tax, c.total AS p_total,
         c.needs_review, c.review_reason, c.model, c.note, c.error,
         CAST(coalesce(c.input_tokens, 0) AS BIGINT) AS input_tokens,
         CAST(coalesce(c.output_tokens, 0) AS BIGINT) AS output_tokens,
         coalesce(c.seconds, 0.0) AS seconds,
         t.vendor_name AS t_vendor_name, t.invoice_number AS t_invoice_number, t.invoice_date AS t_invoice_date,
         t.due_date AS t_due_date, t.bill_to AS t_bill_to, t.currency AS t_currency,
         CAST(t.subtotal AS DOUBLE) AS t_subtotal, CAST(t.tax AS DOUBLE) AS t_tax, CAST(t.total AS DOUBLE) AS t_total,
         coalesce(tc.n_true, 0) AS n_true,
         CASE WHEN c.has_items THEN coalesce(pc.n_pred, 0) ELSE 0 END AS n_pred,
         coalesce(m.n_match, 0) AS n_match
  FROM inv_truth t
  JOIN runs r ON r.dataset = t.dataset
  LEFT JOIN run_calls c ON c.run_id = r.run_id AND c.file = t.file
  LEFT JOIN o_pcount pc ON pc.run_id = r.run_id AND pc.file = t.file
  LEFT JOIN o_match m ON m.run_id = r.run_id AND m.file = t.file
  LEFT JOIN o_tcount tc ON tc.k = t.k
),
o_scored0 AS (
  SELECT *,
    (CAST(input_tokens AS DOUBLE) / 1000000.0 * {price('model', 0)}
     + CAST(output_tokens AS DOUBLE) / 1000000.0 * {price('model', 1)}) AS cost_usd,
    {field_score_sql('vendor_name', 'p_vendor_name', 't_vendor_name')} AS s_vendor_name,
    {field_score_sql('invoice_number', 'p_invoice_number', 't_invoice_number')} AS s_invoice_number,
    {field_score_sql('invoice_date', 'p_invoice_date', 't_invoice_date')} AS s_invoice_date,
    {field_score_sql('due_date', 'p_due_date', 't_due_date')} AS s_due_date,
    {field_score_sql('bill_to', 'p_bill_to', 't_bill_to')} AS s_bill_to,
    {field_score_sql('currency', 'p_currency', 't_currency')} AS s_currency,
    {field_score_sql('subtotal', 'p_subtotal', 't_subtotal')} AS s_subtotal,
    {field_score_sql('tax', 'p_tax', 't_tax')} AS s_tax,
    {field_score_sql('total', 'p_total', 't_total')} AS s_total,
    CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END
         ELSE CAST(n_match AS DOUBLE) / CAST(greatest(n_true, n_pred) AS DOUBLE) END AS s_line_items
  FROM o_base
),
o_scored AS (
  SELECT *,
    (s_vendor_name + s_invoice_number + s_invoice_date + s_due_date + s_bill_to + s_currency
     + s_subtotal + s_tax + s_total + s_line_items) / 10.0 AS overall,
    coalesce(needs_review, false) AS is_flagged,
    coalesce(error, '') <> '' AS is_failed
  FROM o_scored0
)"""

SUMMARY_CTE = """
o_summary AS (
  SELECT run_id,
    count(*) AS documents,
    sum(overall) / greatest(count(*), 1) AS overall_accuracy,
    count(*) FILTER (WHERE overall = 1.0) AS perfect_documents,
""" + ",\n".join(f"    sum(s_{f}) / greatest(count(*), 1) AS acc_{f}" for f in SCORED_FIELDS) + """,
    count(*) FILTER (WHERE is_flagged) AS flagged_for_review,
    count(*) FILTER (WHERE is_failed) AS errors,
    coalesce(sum(cost_usd), 0.0) AS total_cost_usd,
    coalesce(sum(cost_usd), 0.0) / greatest(count(*), 1) AS avg_cost_usd,
    coalesce(max(cost_usd), 0.0) AS max_cost_usd,
    sum(seconds) / greatest(count(*), 1) AS avg_seconds,
    sum(input_tokens) AS input_tokens,
    sum(output_tokens) AS output_tokens,
    count(*) FILTER (WHERE overall < 1.0 AND NOT is_flagged AND NOT is_failed) AS silent,
    count(*) FILTER (WHERE is_flagged AND overall = 1.0) AS false_alarms
  FROM o_scored GROUP BY run_id
)"""


def with_ctes(fixtures: list[str], extra_ctes: list[str], select: str) -> str:
    parts = [p for p in [duckdb_ctes(fixtures)] + [c.strip() for c in extra_ctes] if p]
    return ("WITH " + ",\n".join(parts) + "\n" + select) if parts else select


SCORED_FIXTURES = ["inv_truth", "inv_lines", "runs", "run_calls", "run_items"]


def scored_query(select: str, extra: list[str] | None = None) -> str:
    return with_ctes(SCORED_FIXTURES, [SCORED_CTES] + (extra or []), select)


def summary_query(select: str, extra: list[str] | None = None) -> str:
    return with_ctes(SCORED_FIXTURES, [SCORED_CTES, SUMMARY_CTE] + (extra or []), select)


# Gate: consecutive model runs per dataset, paired metrics and headers.
GATE_CTES = """
o_pairs AS (
  SELECT before_run_id || ' -> ' || run_id AS pair_id, before_run_id, run_id AS after_run_id, dataset
  FROM (SELECT run_id, dataset, lag(run_id) OVER (PARTITION BY dataset ORDER BY run_at, run_id) AS before_run_id
        FROM runs WHERE method = 'claude') x
  WHERE before_run_id IS NOT NULL
),
o_pm AS (
  SELECT p.pair_id, p.before_run_id, p.after_run_id,
    b.overall_accuracy AS b_accuracy, a.overall_accuracy AS a_accuracy,
    b.perfect_documents AS b_perfect, a.perfect_documents AS a_perfect,
    b.documents AS b_documents, a.documents AS a_documents,
    b.silent AS b_silent, a.silent AS a_silent,
    b.flagged_for_review AS b_flagged, a.flagged_for_review AS a_flagged,
    b.false_alarms AS b_false_alarms, a.false_alarms AS a_false_alarms,
    b.avg_cost_usd AS b_cost, a.avg_cost_usd AS a_cost,
    b.total_cost_usd AS b_total_cost, a.total_cost_usd AS a_total_cost,
    b.avg_seconds AS b_seconds, a.avg_seconds AS a_seconds,
    b.errors AS b_failed, a.errors AS a_failed,
""" + ",\n".join(f"    b.acc_{f} AS b_acc_{f}, a.acc_{f} AS a_acc_{f}" for f in SCORED_FIELDS) + """,
    rb.model AS b_model, ra.model AS a_model, rb.prompt AS b_prompt, ra.prompt AS a_prompt,
    rb.prompt_version AS b_prompt_version, ra.prompt_version AS a_prompt_version,
    rb.schema_hash AS b_schema_hash, ra.schema_hash AS a_schema_hash, ra.dataset AS a_dataset
  FROM o_pairs p
  JOIN o_summary b ON b.run_id = p.before_run_id JOIN o_summary a ON a.run_id = p.after_run_id
  JOIN runs rb ON rb.run_id = p.before_run_id JOIN runs ra ON ra.run_id = p.after_run_id
),
o_changes AS (
  SELECT p.pair_id, sa.file,
    CASE WHEN sb.overall < 1.0 AND sa.overall >= 1.0 THEN 'fixed'
         WHEN sb.overall = 1.0 AND sa.overall < 1.0 THEN 'newly broken' END AS change,
    sa.missed AS missed
  FROM o_pairs p
  JOIN o_scored sb ON sb.run_id = p.before_run_id
  JOIN (SELECT *, """ + "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN s_{f} < 1.0 THEN {q(FIELD_LABELS[f])} END" for f in SCORED_FIELDS) + """], lambda x: x IS NOT NULL), ', ') AS missed
        FROM o_scored) sa ON sa.run_id = p.after_run_id AND sa.file = sb.file
)"""


def gate_query(select: str) -> str:
    return with_ctes(SCORED_FIXTURES, [SCORED_CTES, SUMMARY_CTE, GATE_CTES], select)


def review_norm(x: str) -> str:
    v = strip(f"replace(coalesce({x}, ''), ',', '')")
    return (f"(CASE WHEN regexp_full_match({v}, '{NUM_RE}') THEN 'n:' || CAST(CAST(printf('%.2f', CAST({v} AS DOUBLE)) AS DOUBLE) + 0.0 AS VARCHAR) "
            f"ELSE 's:' || {strip(f"coalesce({x}, '')")} END)")


def money_clean(x: str) -> str:
    return strip(f"regexp_replace({x}, '[,$€]', '', 'g')")


def _item_key(desc, q, u, a):
    def n(x):
        return f"(CASE WHEN coalesce({x}, '') = '' THEN 0.0 ELSE TRY_CAST(trim({x}) AS DOUBLE) END)"
    return (f"struct_pack(d := trim(coalesce({desc}, '')), q := {n(q)} + 0.0, u := CAST(printf('%.2f', {n(u)}) AS DOUBLE) + 0.0, "
            f"a := CAST(printf('%.2f', {n(a)}) AS DOUBLE) + 0.0)")


REVIEW_CTES = f"""
o_mrows AS (SELECT c.* FROM run_calls c JOIN runs r ON r.run_id = c.run_id WHERE r.method = 'claude'),
o_un AS (
  SELECT c.run_id, c.file, md5(strftime(r.run_at, '%Y-%m-%dT%H:%M:%S') || '|' || c.file) AS h
  FROM o_mrows c JOIN runs r ON r.run_id = c.run_id
  WHERE NOT (coalesce(c.needs_review, false) OR coalesce(c.error, '') <> '')
),
o_n AS (
  SELECT run_id, count(*) AS unflagged,
         CASE WHEN count(*) > 0 THEN least(greatest(1, CAST(round_even(count(*) * 10.0 / 100.0, 0) AS BIGINT)), count(*))
              ELSE 0 END AS n
  FROM o_un GROUP BY run_id
),
o_spot AS (
  SELECT run_id, file FROM (
    SELECT u.run_id, u.file, n.n, row_number() OVER (PARTITION BY u.run_id ORDER BY u.h, u.file) AS rn
    FROM o_un u JOIN o_n n ON n.run_id = u.run_id) x
  WHERE rn <= n
),
o_queue AS (
  SELECT run_id, file, 'flagged' AS queue FROM o_mrows
  WHERE coalesce(needs_review, false) OR coalesce(error, '') <> ''
  UNION ALL
  SELECT run_id, file, 'spot_check' AS queue FROM o_spot
),
o_subs AS (
  SELECT s.*,
    {money_clean('in_subtotal')} AS c_subtotal, {money_clean('in_tax')} AS c_tax, {money_clean('in_total')} AS c_total
  FROM review_submissions s
),
o_subs2 AS (
  SELECT *,
    action = 'save' AND ((c_subtotal <> '' AND NOT regexp_full_match(c_subtotal, '{NUM_RE}'))
                      OR (c_tax <> '' AND NOT regexp_full_match(c_tax, '{NUM_RE}'))
                      OR (c_total <> '' AND NOT regexp_full_match(c_total, '{NUM_RE}'))) AS rejected,
    CASE WHEN c_subtotal = '' THEN 0.0 ELSE TRY_CAST(c_subtotal AS DOUBLE) END AS f_subtotal,
    CASE WHEN c_tax = '' THEN 0.0 ELSE TRY_CAST(c_tax AS DOUBLE) END AS f_tax,
    CASE WHEN c_total = '' THEN 0.0 ELSE TRY_CAST(c_total AS DOUBLE) END AS f_total
  FROM o_subs
),
o_okeys AS (
  SELECT run_id, file, count(*) AS n_items,
         list({_item_key('description', 'quantity', 'unit_price', 'amount')} ORDER BY item_no) AS key
  FROM run_items GROUP BY run_id, file
),
o_tkeys AS (
  SELECT k, count(*) AS n_items,
         list({_item_key('description', 'CAST(quantity AS VARCHAR)', 'CAST(CAST(unit_price AS DOUBLE) AS VARCHAR)', 'CAST(CAST(amount AS DOUBLE) AS VARCHAR)')} ORDER BY line_no) AS key
  FROM inv_lines GROUP BY k
),
o_events AS (
  SELECT s.run_id, s.file, s.event_seq, s.reviewed_at, s.queue, s.note, s.action = 'clear' AS deleted,
    {strip('s.in_vendor_name')} AS f_vendor_name, {strip('s.in_invoice_number')} AS f_invoice_number,
    {strip('s.in_invoice_date')} AS f_invoice_date, {strip('s.in_due_date')} AS f_due_date, {strip('s.in_bill_to')} AS f_bill_to,
    {strip('s.in_currency')} AS f_currency, s.f_subtotal, s.f_tax, s.f_total,
    CASE WHEN s.items_from_truth THEN coalesce(tk.n_items, 0)
         WHEN c.has_items THEN coalesce(ok.n_items, 0) WHEN c.has_fields THEN 0 ELSE 0 END AS n_items,
    list_filter([
""" + ",\n".join(
    f"      CASE WHEN {review_norm('c.' + f)} <> {review_norm(strip('s.in_' + f))} THEN '{f}' END"
    for f in ["vendor_name", "invoice_number", "invoice_date", "due_date", "bill_to", "currency"]) + ",\n" + ",\n".join(
    f"      CASE WHEN {review_norm('c.' + f)} <> {review_norm('CAST(s.f_' + f + ' AS VARCHAR)')} THEN '{f}' END"
    for f in ["subtotal", "tax", "total"]) + """,
      CASE WHEN s.items_from_truth AND (CASE WHEN c.has_items THEN coalesce(ok.key, []) ELSE [] END)
                IS DISTINCT FROM coalesce(tk.key, []) THEN 'line_items' END
    ], lambda x: x IS NOT NULL) AS changed
  FROM o_subs2 s
  LEFT JOIN run_calls c ON c.run_id = s.run_id AND c.file = s.file
  LEFT JOIN o_okeys ok ON ok.run_id = s.run_id AND ok.file = s.file
  LEFT JOIN o_tkeys tk ON tk.k = s.k
  WHERE NOT s.rejected
),
o_latest AS (
  SELECT *, CASE WHEN len(changed) > 0 THEN 'corrected' ELSE 'approved' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, file ORDER BY reviewed_at DESC, event_seq DESC) AS rn
        FROM o_events) x
  WHERE rn = 1 AND NOT deleted
)"""

REVIEW_FIXTURES = SCORED_FIXTURES + ["review_submissions"]


def review_query(select: str) -> str:
    return with_ctes(REVIEW_FIXTURES, [REVIEW_CTES], select)


# Document text (D7) and the rule-based reader (E1) in DuckDB.
def _doc_ctes() -> str:
    from .constants import LAYOUTS
    from .operators.documents import render_sql
    item_cases, text_cases = [], []
    for lay in LAYOUTS:
        item_expr, text_expr = render_sql(lay)
        item_cases.append(f"WHEN '{lay}' THEN {item_expr}")
        text_cases.append(f"WHEN '{lay}' THEN {text_expr}")
    return f"""
o_items_text AS (
  SELECT l.k, string_agg(CASE t.layout {' '.join(item_cases)} END, chr(10) ORDER BY l.line_no) AS items_text
  FROM inv_lines l JOIN inv_truth t ON t.k = l.k GROUP BY l.k
),
o_doctext AS (
  SELECT t.dataset, t.file, t.k, t.layout, t.format,
         CASE WHEN t.format = 'digital PDF' THEN CASE t.layout {' '.join(text_cases)} END ELSE '' END AS text
  FROM inv_truth t LEFT JOIN o_items_text it ON it.k = t.k
)"""


def _fg(pattern: str, ci: bool = True) -> str:
    opt = ", 'i'" if ci else ""
    return f"nullif(trim(regexp_extract(text, {q(pattern)}, 1{opt})), '')"


def _date(x: str) -> str:
    fmts = ["%m/%d/%Y", "%Y-%m-%d", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d.%m.%Y"]
    return "CAST(coalesce(" + ", ".join(f"try_strptime(trim({x}), '{f_}')" for f_ in fmts) + ") AS DATE)"


def _e1_ctes() -> str:
    from . import constants as K
    split_pat = "^" + K.PAT_LEFT_NAME
    return f"""
o_e1a AS (
  SELECT dataset, file, k, layout, format, text,
    lower(file) LIKE '%.pdf' AND regexp_matches(coalesce(text, ''), '\\S') AS readable,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
                lambda x: x <> '' AND upper(x) NOT IN ('INVOICE', 'RECEIPT'))[1] AS vendor_name,
    {_fg(K.PAT_INVOICE_NUMBER)} AS invoice_number,
    {_date(_fg(K.PAT_INVOICE_DATE))} AS inv_d,
    {_date(_fg(K.PAT_DUE_DATE))} AS due_d,
    TRY_CAST({_fg(K.PAT_NET_DAYS)} AS INTEGER) AS net,
    {_fg(K.PAT_BILL_TO)} AS bill_lab,
    nullif(regexp_extract(text, {q(K.PAT_BILL_SHIP_HEADER)}, 1), '') AS bill_hdr,
    CASE WHEN regexp_matches(text, {q(K.PAT_EUR)}) THEN 'EUR' ELSE 'USD' END AS currency,
    replace({_fg(K.PAT_SUBTOTAL)}, ',', '') AS subtotal,
    replace({_fg(K.PAT_TAX)}, ',', '') AS tax0,
    replace({_fg(K.PAT_TOTAL)}, ',', '') AS total
  FROM o_doctext
),
o_e1 AS (
  SELECT dataset, file, k, layout, format, readable,
    CASE WHEN readable THEN vendor_name END AS vendor_name,
    CASE WHEN readable THEN invoice_number END AS invoice_number,
    CASE WHEN readable THEN strftime(inv_d, '%Y-%m-%d') END AS invoice_date,
    CASE WHEN readable THEN strftime(coalesce(due_d, CASE WHEN net IS NOT NULL AND inv_d IS NOT NULL
                                                       THEN CAST(inv_d + net AS DATE) END), '%Y-%m-%d') END AS due_date,
    CASE WHEN readable THEN coalesce(bill_lab, CASE WHEN bill_hdr IS NOT NULL THEN
         coalesce(nullif(regexp_extract(bill_hdr, {q(split_pat)}, 1), ''), bill_hdr) END) END AS bill_to,
    CASE WHEN readable THEN currency END AS currency,
    CASE WHEN readable THEN subtotal END AS subtotal,
    CASE WHEN readable THEN CASE WHEN TRY_CAST(tax0 AS DOUBLE) IS NULL OR TRY_CAST(tax0 AS DOUBLE) = 0 THEN '0.0'
                                 ELSE tax0 END END AS tax,
    CASE WHEN readable THEN total END AS total,
    CASE WHEN readable THEN '' ELSE {q(K.NO_TEXT_NOTE)} END AS note
  FROM o_e1a
),
o_e1_scored AS (
  SELECT t.dataset, t.file, t.layout,
    ({' + '.join(field_score_sql(f_, 'e.' + f_, 't.' + f_ if f_ not in ('subtotal', 'tax', 'total') else f'CAST(t.{f_} AS DOUBLE)') for f_ in SCORED_FIELDS if f_ != 'line_items')}
     + CASE WHEN t.n_lines = 0 THEN 1.0 ELSE 0.0 END) / 10.0 AS overall,
""" + ",\n".join(
        f"    {field_score_sql(f_, 'e.' + f_, 't.' + f_ if f_ not in ('subtotal', 'tax', 'total') else f'CAST(t.{f_} AS DOUBLE)')} AS s_{f_}"
        for f_ in SCORED_FIELDS if f_ != 'line_items') + """,
    CASE WHEN t.n_lines = 0 THEN 1.0 ELSE 0.0 END AS s_line_items
  FROM inv_truth t LEFT JOIN o_e1 e ON e.file = t.file
)"""


DOC_FIXTURES = ["inv_truth", "inv_lines"]


def doc_query(select: str) -> str:
    return with_ctes(DOC_FIXTURES, [_doc_ctes()], select)


def e1_query(select: str) -> str:
    return with_ctes(DOC_FIXTURES, [_doc_ctes(), _e1_ctes()], select)


def fmt_value(field: str, x: str) -> str:
    if field in ("subtotal", "tax", "total"):
        shown = (f"CASE WHEN regexp_full_match(trim(CAST({x} AS VARCHAR)), '{NUM_RE}') THEN "
                 f"format('{{:,.2f}}', CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE)) ELSE CAST({x} AS VARCHAR) END")
    else:
        shown = f"CAST({x} AS VARCHAR)"
    return f"(CASE WHEN {x} IS NULL OR CAST({x} AS VARCHAR) = '' THEN '—' ELSE {shown} END)"


MISSED_SQL = ("array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN s_{f} < 1.0 THEN {q(FIELD_LABELS[f])} END" for f in SCORED_FIELDS) + "], lambda x: x IS NOT NULL), ', ')")

LATEST_PRACTICE_CTE = """
o_w2 AS (SELECT arg_max(run_id, (run_at, run_id)) AS run_id FROM runs WHERE method = 'claude' AND dataset = 'practice')"""


def field_rows_sql() -> str:
    """One row per (document, field) of the latest practice model run: expected, got, current, score."""
    parts = []
    for f in SCORED_FIELDS:
        if f == "line_items":
            exp = "CAST(n_true AS VARCHAR) || ' rows'"
            got = (f"CAST(n_pred AS VARCHAR) || ' rows, ' || printf('%.0f', round_even(s_line_items * 100, 0)) "
                   f"|| '% matched'")
            cur = "CAST(n_pred AS VARCHAR) || ' rows'"
        else:
            exp = fmt_value(f, f"t_{f}")
            got = fmt_value(f, f"p_{f}")
            cur = got
        parts.append(f"SELECT run_id, file, layout, is_flagged, '{f}' AS field, {q(FIELD_LABELS[f])} AS field_label, "
                     f"{exp} AS expected, {got} AS got, {cur} AS current, s_{f} AS score "
                     f"FROM o_scored WHERE run_id = (SELECT run_id FROM o_w2)")
    return "o_fields AS (" + " UNION ALL ".join(parts) + ")"
