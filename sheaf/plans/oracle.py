"""DuckDB statements that compute each registered query from the same tables.

Shared fragments are Python strings so that every statement stays one plain
SQL text.
"""

from __future__ import annotations

PAGE_CHARS = 1800
SIZE_CAP = 16384

DOC_FILES = """
  SELECT doc_id AS file_id, source AS bucket, lang || '/' || doc_id::VARCHAR || '.txt' AS key,
         'text/plain' AS content_type, strlen(text)::BIGINT AS size_bytes, text
  FROM documents"""

DOC_PAGES = f"""
  SELECT doc_id, p::BIGINT AS page_no,
         substring(text, ((p - 1) * {PAGE_CHARS} + 1)::BIGINT, {PAGE_CHARS}) AS page_text
  FROM documents,
       unnest(range(1, greatest(1, ceil(length(text) / {PAGE_CHARS}.0)::BIGINT) + 1)) AS r(p)
  WHERE text IS NOT NULL"""

ORDER_INPUTS = """
  SELECT o_orderkey::VARCHAR AS job_id, 0 AS input_index, 'src' AS name,
         CASE o_orderstatus WHEN 'F' THEN 'archive' WHEN 'O' THEN 'inbox' ELSE '' END AS bucket,
         'orders/' || o_orderkey::VARCHAR || '.txt' AS key, 'text/plain' AS content_type
  FROM orders
  UNION ALL
  SELECT o_orderkey::VARCHAR, 1,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'att' ELSE 'src' END, 'inbox',
         CASE WHEN o_totalprice > 300000 THEN 'att/../' || o_orderkey::VARCHAR
              ELSE 'att/' || o_orderkey::VARCHAR || '.bin' END,
         'application/octet-stream'
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""


def ref_error(bucket: str, key: str, allowed: list[str] | None = None) -> str:
    allow = ""
    if allowed is not None:
        lst = ", ".join(f"'{a}'" for a in allowed)
        allow = f"WHEN {bucket} NOT IN ({lst}) THEN 'BUCKET_NOT_ALLOWED' "
    return (f"CASE WHEN {bucket} IS NULL OR {bucket} = '' THEN 'BUCKET_REQUIRED' {allow}"
            f"WHEN {key} IS NULL OR {key} = '' THEN 'KEY_REQUIRED' "
            f"WHEN contains({key}, '..') THEN 'KEY_TRAVERSAL' END")


ALLOWED = ["archive", "inbox", "src0", "src1", "src2"]

SQL: dict[str, str] = {}

SQL["files_sized"] = f"""
SELECT file_id, bucket, key, size_bytes,
       CASE WHEN size_bytes > {SIZE_CAP} THEN 'TOO_LARGE' END AS error,
       CASE WHEN size_bytes <= {SIZE_CAP} THEN sha256(text) END AS content_sha256
FROM ({DOC_FILES}) f"""

SQL["check_refs"] = f"""
WITH r AS (
  SELECT 'doc-' || file_id::VARCHAR AS ref_id, bucket, key FROM ({DOC_FILES}) f
  UNION ALL
  SELECT 'in-' || job_id || '-' || input_index::VARCHAR, bucket, key FROM ({ORDER_INPUTS}) i)
SELECT ref_id, bucket, key, {ref_error('bucket', 'key', ALLOWED)} AS ref_error FROM r"""

SQL["paginate"] = f"""
SELECT doc_id, page_no, page_text, length(page_text)::BIGINT AS page_chars FROM ({DOC_PAGES}) p"""

SQL["page_counts"] = f"""
SELECT doc_id, count(*)::BIGINT AS n_pages, sum(strlen(page_text))::BIGINT AS size_bytes
FROM ({DOC_PAGES}) p GROUP BY doc_id"""


# ---- E: extraction ------------------------------------------------------------


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {_lit(pattern)}, {_lit(to)}, 'g')"


def clean_sql(x: str) -> str:
    """Closed stretches by lazy patterns (RE2 is linear), then what is left of unclosed ones."""
    x = _re(_re(x, r"(?s)<!--.*?-->"), "<!--")
    for t in ("script", "style"):
        x = _re(x, rf"(?is)<{t}\b[^<>]*>.*?(?:</{t}[^<>]*>|\z)")
    for t in ("head", "nav", "footer"):
        x = _re(_re(x, rf"(?is)<{t}\b[^<>]*>.*?</{t}\b[^<>]*>"), rf"(?i)</?{t}\b[^<>]*>")
    return _re(_re(x, r'(?is)<div class="ad">.*?</div\b[^<>]*>'), '(?i)<div class="ad">')


def trim_sql(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10))"


def images_sql(x: str, mode: str, placeholder: str) -> str:
    if mode == "placeholder":
        return _re(x, r"(?i)<img\b[^<>]*>", placeholder)
    if mode == "referenced":
        uri = _lit(r'(?i)src="data:image/[a-z0-9.+\-]+;base64,[^"<>]*"')
        return (f"array_to_string(list_transform(string_split_regex({x}, {uri}), "
                f"lambda p, i: CASE WHEN i = 1 THEN p ELSE 'src=\"image_' || (i - 1)::VARCHAR || '\"' || p END), '')")
    return x


def html_sql(x: str, mode: str = "placeholder") -> str:
    return trim_sql(images_sql(clean_sql(x), mode, "<!-- image -->"))


def markdown_sql(x: str, mode: str = "placeholder") -> str:
    """A placeholder is one control character until all tags are gone."""
    x = images_sql(clean_sql(x), mode, "\x01")
    x = _re(x, r'(?i)<img\b[^<>]*?\ssrc\s*=\s*"([^"<>]*)"[^<>]*>', r"![image](\1)")
    for n in range(1, 7):
        x = _re(x, rf"(?i)<h{n}\b[^<>]*>", "\n" + "#" * n + " ")
    for tag, to in (("</h[1-6]", "\n\n"), (r"</?(?:ul|ol)\b", "\n\n"), (r"<li\b", "\n- "), (r"<p\b", "\n\n"),
                    (r"<br\b", "\n"), (r"</?(?:b|strong)\b", "**")):
        x = _re(x, rf"(?i){tag}[^<>]*>", to)
    x = _re(x, r"(?i)<(?:[^/a<>]|/[^a<>]|/?a\w)[^<>]*>|</?>")
    x = _re(x, r'(?i)<a\b[^<>]*?\shref\s*=\s*"([^"<>]*)"[^<>]*>([^<>]*)</a\b[^<>]*>', r"[\2](\1)")
    x = _re(x, r"(?i)</?a\b[^<>]*>")
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("#39", "'"),
                       ("nbsp", " "), ("amp", "&")):
        x = f"replace({x}, '&{name};', {_lit(char)})"
    x = _re(_re(x, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return f"replace({trim_sql(x)}, chr(1), '<!-- image -->')"


NL2 = "chr(10) || chr(10)"
PAGE_MD = f"SELECT page_id, {markdown_sql('html')} AS markdown FROM pages"

BLOCKS = f"""
  WITH md AS ({PAGE_MD}),
  s AS (SELECT page_id, string_split(markdown, {NL2}) AS arr FROM md),
  b AS (SELECT page_id, (generate_subscripts(arr, 1) - 1)::BIGINT AS pos, unnest(arr) AS raw FROM s),
  l AS (
    SELECT page_id, pos, raw,
      CASE WHEN regexp_matches(raw, '^#{{1,6}} ') THEN 'section_header'
           WHEN regexp_matches(raw, '^- ') THEN 'list_item' ELSE 'text' END AS label,
      CASE WHEN regexp_matches(raw, '^#{{1,6}} ') THEN regexp_replace(raw, '^#{{1,6}} ', '')
           WHEN regexp_matches(raw, '^- ') THEN regexp_replace(raw, '^- ', '') ELSE raw END AS text
    FROM b)
  SELECT page_id, pos, label, text,
    last_value(CASE WHEN label = 'section_header' THEN text END IGNORE NULLS) OVER (
      PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading,
    (floor(coalesce(sum(length(raw) + 2) OVER (
      PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      / {PAGE_CHARS}) + 1)::BIGINT AS page_no
  FROM l"""

SQL["extract_markdown"] = PAGE_MD

SQL["extract_html"] = f"SELECT page_id, {html_sql('html')} AS clean_html FROM pages"

SQL["structure_blocks"] = f"SELECT * FROM ({BLOCKS}) x"

SQL["structure_json"] = f"""
WITH b AS ({BLOCKS})
SELECT page_id, to_json({{'texts': list({{'text': text, 'label': label,
    'prov': [{{'page_no': page_no::INTEGER}}],
    'headings': CASE WHEN heading IS NULL THEN []::VARCHAR[] ELSE [heading] END}} ORDER BY pos)}})::VARCHAR
  AS structure_json
FROM b GROUP BY page_id"""

SQL["write_structure"] = SQL["structure_json"]

SQL["read_files"] = """
SELECT doc_id, sha256(text) AS content_sha256, NULL::VARCHAR AS error FROM documents"""

SQL["write_artifacts"] = """
SELECT source AS bucket, lang || '/' || doc_id::VARCHAR || '.txt' AS key, sha256(text) AS content_sha256
FROM documents
WHERE lang = 'en' OR source NOT IN ('src0', 'src1', 'src2')
   OR source NOT IN (SELECT source FROM documents WHERE lang = 'en')"""

SQL["parse_chunks"] = f"""
SELECT page_id, pos AS chunk_index, label AS chunk_type, page_no AS page_number,
       coalesce(heading, '') AS heading, text AS chunk_text
FROM ({BLOCKS}) b WHERE text <> ''"""

_IMG = ('<img src="data:image/png;base64,iVBORw0KGgo=" alt="logo">'
        '<img src="/static/figure.jpg" alt="figure"><a href="/more"><img src="data:image/gif;base64,R0lGOD=="></a>'
        '</article>')
_BASE = f"SELECT page_id, replace(html, '</article>', {_lit(_IMG)}) AS html FROM pages"
SQL["image_modes"] = " UNION ALL ".join(
    f"SELECT page_id, '{m}' AS mode, {html_sql('html', m)} AS clean_html, {markdown_sql('html', m)} AS markdown "
    f"FROM ({_BASE}) b" for m in ("placeholder", "embedded", "referenced"))


# ---- F: scanning --------------------------------------------------------------

HITS = """
  SELECT d.doc_id AS file_id, b.item_id AS sig_id
  FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, b.text)"""

VERDICTS = f"""
  WITH h AS ({HITS}),
  pf AS (SELECT file_id, min(sig_id) AS sig, count(*) AS n FROM h GROUP BY file_id)
  SELECT d.doc_id AS file_id, pf.sig IS NULL AS clean,
         CASE WHEN pf.sig IS NOT NULL THEN 'Bench.Passage-' || pf.sig::VARCHAR END AS detail,
         coalesce(pf.n, 0)::BIGINT AS n_hits
  FROM documents d LEFT JOIN pf ON pf.file_id = d.doc_id"""

_WS = r"[\t\n\x0B\f\r \x{85}\p{Z}]"
REPLIES = f"""
  SELECT v.file_id,
    CASE WHEN d.lang = 'en' THEN base || chr(0)
         WHEN d.lang = 'fr' THEN '  ' || base || ' ' || chr(10)
         WHEN d.lang = 'de' AND d.n_chars > 20000 THEN 'stream: INSTREAM size limit exceeded ERROR'
         ELSE base END AS response
  FROM (SELECT *, CASE WHEN clean THEN 'stream: OK' ELSE 'stream: ' || detail || ' FOUND' END AS base
        FROM ({VERDICTS}) x) v
  JOIN documents d ON d.doc_id = v.file_id"""

CLASSIFIED = f"""
  WITH r AS (SELECT file_id, response,
      regexp_replace(regexp_replace(regexp_replace(coalesce(response, ''),
        '^{_WS}+', '', 'g'), '{_WS}+\\z', '', 'g'), '\\x00+\\z', '', 'g') AS t
    FROM ({REPLIES}) y),
  s AS (SELECT *, substring(t, 9) AS d1 FROM r)
  SELECT file_id, response, t = 'stream: OK' AS clean,
    CASE WHEN t = 'stream: OK' THEN NULL
         WHEN starts_with(t, 'stream: ') AND ends_with(t, ' FOUND') THEN
           CASE WHEN ends_with(d1, ' FOUND') THEN substring(d1, 1, length(d1) - 6) ELSE d1 END
         ELSE 'unexpected scan response: ' || t END AS detail
  FROM s"""

SQL["scan_corpus"] = VERDICTS
SQL["scan_hits"] = HITS
SQL["scan_hashes"] = """
WITH bad AS (SELECT sha256(d.text) AS sha256, min(d.doc_id) AS match_id
             FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1 GROUP BY 1)
SELECT d.doc_id AS file_id, sha256(d.text) AS sha256, bad.match_id, bad.match_id IS NOT NULL AS matched
FROM documents d LEFT JOIN bad ON bad.sha256 = sha256(d.text)"""
SQL["scan_disabled"] = """
SELECT doc_id AS file_id, false AS clean, 'scanning disabled: no antivirus configured' AS detail,
       0::BIGINT AS n_hits FROM documents"""
SQL["classify_scans"] = CLASSIFIED
SQL["threat_counts"] = f"""
SELECT clean, detail, count(*)::BIGINT AS n_files FROM ({CLASSIFIED}) c GROUP BY clean, detail"""
SQL["scan_gate"] = """
WITH f AS (SELECT user_id, min(event_id) AS ff FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT e.user_id AS job_id, e.event_id AS seq, e.event_type, coalesce(e.event_id > f.ff, false) AS gated
FROM events e LEFT JOIN f ON f.user_id = e.user_id"""


# ---- A2 / B3 / G: jobs --------------------------------------------------------

ORDER_OPS = """
  SELECT job_id, op_index, op_name, op_type,
    CASE WHEN n = 1 THEN ['src']
         WHEN l_quantity >= 49 THEN ['s' || (n + 1)::VARCHAR]
         WHEN op_type = 'merge_pdfs' THEN ['src', 's' || (n - 1)::VARCHAR]
         ELSE ['s' || (n - 1)::VARCHAR] END AS inputs
  FROM (
    SELECT l_orderkey::VARCHAR AS job_id, (l_linenumber - 1)::INTEGER AS op_index, l_linenumber AS n,
      l_quantity,
      CASE WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN 'src'
           WHEN l_linenumber = 4 AND l_returnflag = 'A' THEN 's3'
           ELSE 's' || l_linenumber::VARCHAR END AS op_name,
      CASE WHEN l_linenumber = 1 THEN 'scan' WHEN l_discount >= 0.095 THEN NULL
           WHEN l_returnflag = 'R' THEN 'convert_to_pdf' WHEN l_returnflag = 'A' THEN 'thumbnail'
           WHEN l_linestatus = 'O' THEN 'extract_markdown' ELSE 'merge_pdfs' END AS op_type
    FROM lineitem) x"""

ORDER_DESTS = """
  SELECT o_orderkey::VARCHAR AS job_id, 's1' AS name, 'out' AS bucket,
         'out/' || o_orderkey::VARCHAR || '.pdf' AS key, 'application/pdf' AS content_type FROM orders
  UNION ALL
  SELECT o_orderkey::VARCHAR, 'report', 'out', 'out/' || o_orderkey::VARCHAR || '.md', 'text/markdown'
  FROM orders WHERE o_orderpriority = '3-MEDIUM'"""

SQL["check_jobs"] = f"""
WITH i AS ({ORDER_INPUTS}), o AS ({ORDER_OPS}), d AS ({ORDER_DESTS}),
ids AS (SELECT o_orderkey::VARCHAR AS job_id FROM orders UNION SELECT job_id FROM i
        UNION SELECT job_id FROM o UNION SELECT job_id FROM d),
fi AS (SELECT job_id, name, min(input_index) AS first_in FROM i GROUP BY ALL),
in_err AS (
  SELECT i.job_id, 3 AS stage, i.input_index AS idx, '' AS dname,
    CASE WHEN i.name IS NULL OR i.name = '' THEN 'INPUT_NAME_REQUIRED'
         WHEN i.input_index > fi.first_in THEN 'DUPLICATE_INPUT'
         ELSE {ref_error('i.bucket', 'i.key')} END AS code
  FROM i LEFT JOIN fi ON fi.job_id = i.job_id AND fi.name = i.name),
known AS (SELECT job_id, name, min(k) AS known_at FROM (
  SELECT job_id, name, -1 AS k FROM i UNION ALL SELECT job_id, op_name, op_index FROM o) z GROUP BY ALL),
refs AS (
  SELECT r.job_id, r.op_index,
    max(CASE WHEN k.known_at IS NULL OR k.known_at >= r.op_index THEN 1 ELSE 0 END) AS bad_ref
  FROM (SELECT job_id, op_index, unnest(inputs) AS name FROM o) r
  LEFT JOIN known k ON k.job_id = r.job_id AND k.name = r.name GROUP BY ALL),
isin AS (SELECT DISTINCT job_id, name AS op_name FROM i),
ofirst AS (SELECT job_id, op_name, min(op_index) AS first_op FROM o GROUP BY ALL),
op_err AS (
  SELECT o.job_id, 4 AS stage, o.op_index AS idx, '' AS dname,
    CASE WHEN o.op_name IS NULL OR o.op_name = '' THEN 'OP_NAME_REQUIRED'
         WHEN isin.op_name IS NOT NULL THEN 'OP_NAME_IS_INPUT'
         WHEN o.op_index > ofirst.first_op THEN 'DUPLICATE_OP'
         WHEN o.op_type IS NULL THEN 'OP_TYPE_MISSING'
         WHEN refs.bad_ref = 1 THEN 'UNKNOWN_REF'
         WHEN len(o.inputs) = 0 THEN 'OP_INPUTS_REQUIRED' END AS code
  FROM o LEFT JOIN isin ON isin.job_id = o.job_id AND isin.op_name = o.op_name
  LEFT JOIN ofirst ON ofirst.job_id = o.job_id AND ofirst.op_name = o.op_name
  LEFT JOIN refs ON refs.job_id = o.job_id AND refs.op_index = o.op_index),
d_err AS (
  SELECT d.job_id, 5 AS stage, 0 AS idx, d.name AS dname,
    CASE WHEN k.name IS NULL THEN 'UNKNOWN_DEST' ELSE {ref_error('d.bucket', 'd.key')} END AS code
  FROM d LEFT JOIN known k ON k.job_id = d.job_id AND k.name = d.name),
no_in AS (SELECT job_id, 1 AS stage, 0 AS idx, '' AS dname, 'NO_INPUTS' AS code FROM ids
          WHERE job_id NOT IN (SELECT job_id FROM i)),
no_ops AS (SELECT job_id, 2 AS stage, 0 AS idx, '' AS dname, 'NO_OPERATIONS' AS code FROM ids
           WHERE job_id NOT IN (SELECT job_id FROM o)),
e AS (SELECT * FROM (SELECT * FROM no_in UNION ALL SELECT * FROM no_ops UNION ALL SELECT * FROM in_err
      UNION ALL SELECT * FROM op_err UNION ALL SELECT * FROM d_err) u WHERE code IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY stage, idx, dname, code) AS rn FROM e)
SELECT ids.job_id, r.code AS error, r.stage::BIGINT AS stage,
  CASE WHEN r.stage = 5 THEN r.dname WHEN r.stage IN (3, 4) THEN r.idx::VARCHAR END AS item
FROM ids LEFT JOIN r ON r.job_id = ids.job_id AND r.rn = 1"""

SQL["dispatch_ops"] = f"""
SELECT job_id, op_index::BIGINT AS op_index, op_name, coalesce(op_type, 'error') AS dispatch,
  CASE WHEN op_type IS NULL THEN 'unknown operation type' END AS dispatch_error
FROM ({ORDER_OPS}) o"""

ORDER_USES = f"""
  SELECT job_id, unnest(inputs) AS ref, op_index FROM ({ORDER_OPS}) o
  UNION ALL SELECT job_id, name, NULL FROM ({ORDER_DESTS}) d"""

SQL["artifact_refs"] = f"""
SELECT job_id, ref, count(*)::BIGINT AS n_uses, max(op_index)::BIGINT AS last_op_index
FROM ({ORDER_USES}) u GROUP BY job_id, ref"""

SQL["unused_inputs"] = f"""
SELECT i.job_id, i.input_index::BIGINT AS input_index, i.name, i.bucket, i.key
FROM ({ORDER_INPUTS}) i
WHERE NOT EXISTS (SELECT 1 FROM ({ORDER_USES}) u WHERE u.job_id = i.job_id AND u.ref = i.name)"""

SQL["jobs_exploded"] = """
WITH d AS (SELECT doc_id, 'doc-' || doc_id::VARCHAR AS job_id, lang, source, lang = 'de' AS allp FROM documents)
SELECT job_id, 'input' AS part, 0::BIGINT AS idx, 'doc' AS name, NULL AS op_type, NULL AS refs,
       source AS bucket, lang || '/' || doc_id::VARCHAR || '.txt' AS key, 'text/plain' AS content_type,
       NULL::BIGINT AS width, NULL::BIGINT AS dpi, NULL AS format, NULL AS pages FROM d
UNION ALL SELECT job_id, 'op', 0, 'scan', 'scan', 'doc', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT job_id, 'op', 1, 'pdf', 'convert_to_pdf', 'doc', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT job_id, 'op', 2, 'thumb', 'thumbnail', 'pdf', NULL, NULL, NULL,
       CASE WHEN allp THEN 200 ELSE 400 END, 150, CASE WHEN allp THEN 'png' ELSE 'jpg' END,
       CASE WHEN allp THEN 'all' ELSE 'first' END FROM d
UNION ALL SELECT job_id, 'op', 3, 'text', 'extract_markdown', 'pdf', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT job_id, 'dest', NULL, 'pdf', NULL, NULL, 'out', 'pdf/' || doc_id::VARCHAR || '.pdf',
       'application/pdf', NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT job_id, 'dest', NULL, 'thumb', NULL, NULL, 'out',
       'thumb/' || doc_id::VARCHAR || '.' || CASE WHEN allp THEN 'png' ELSE 'jpg' END,
       CASE WHEN allp THEN 'image/png' ELSE 'image/jpeg' END, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT job_id, 'dest', NULL, 'text', NULL, NULL, 'out', 'text/' || doc_id::VARCHAR || '.md',
       'text/markdown', NULL, NULL, NULL, NULL FROM d"""

# The four-step template over every document; German documents preview all pages.
DOC_RUN = f"""
  SELECT d.doc_id, 'doc-' || d.doc_id::VARCHAR AS job_id, d.text, d.lang = 'de' AS allp,
         v.clean, v.detail, greatest(1, ceil(length(d.text) / {PAGE_CHARS}.0))::BIGINT AS np,
         CASE WHEN d.lang = 'de' THEN 200 ELSE 400 END AS width
  FROM documents d JOIN ({VERDICTS}) v ON v.file_id = d.doc_id"""

SKIP = "'skipped: prior scan detected a threat'"
SQL["run_jobs"] = f"""
WITH j AS ({DOC_RUN})
SELECT job_id, 0::BIGINT AS op_index, 'scan' AS op_name, 'scan' AS op_type, clean AS success,
       CASE WHEN NOT clean THEN 'virus detected: ' || detail END AS error, clean, detail,
       NULL::BIGINT AS size_bytes, NULL::BIGINT AS page_count, NULL::BIGINT AS md_chars, NULL AS md_sha256 FROM j
UNION ALL
SELECT job_id, 1, 'pdf', 'convert_to_pdf', clean, CASE WHEN NOT clean THEN {SKIP} END, NULL, NULL,
       CASE WHEN clean THEN strlen(text) END, CASE WHEN clean THEN np END, NULL, NULL FROM j
UNION ALL
SELECT job_id, 2, 'thumb', 'thumbnail', clean, CASE WHEN NOT clean THEN {SKIP} END, NULL, NULL,
       CASE WHEN clean THEN strlen(substring(text, 1, width)) END,
       CASE WHEN clean THEN (CASE WHEN allp THEN np ELSE 1 END) END, NULL, NULL FROM j
UNION ALL
SELECT job_id, 3, 'text', 'extract_markdown', clean, CASE WHEN NOT clean THEN {SKIP} END, NULL, NULL,
       NULL, NULL, CASE WHEN clean THEN length(text) END, CASE WHEN clean THEN sha256(text) END FROM j"""

SQL["job_outcome"] = """
SELECT 'doc-' || doc_id::VARCHAR AS job_id,
       CASE WHEN strlen(text) > 32768 THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN strlen(text) > 32768 THEN 'download doc: TOO_LARGE' END AS error
FROM documents"""

SQL["run_page_jobs"] = f"""
WITH p AS (SELECT page_id, html, contains(url, '?') AS q, {markdown_sql('html')} AS md,
             greatest(1, ceil(length(html) / {PAGE_CHARS}.0))::BIGINT AS np
           FROM pages WHERE contains(url, '?') OR NOT contains(url, '#')),
h AS (SELECT page_id, min(item_id) AS sig FROM p
      JOIN benchmark b ON length(b.text) > 0 AND contains(CASE WHEN q THEN html || html ELSE html END, b.text)
      GROUP BY page_id),
j AS (SELECT 'page-' || p.page_id::VARCHAR AS job_id, p.*, sig IS NULL AS clean,
             'Bench.Passage-' || sig::VARCHAR AS detail FROM p LEFT JOIN h ON h.page_id = p.page_id)
SELECT job_id, 0::BIGINT AS op_index, 'md' AS op_name, 'extract_markdown' AS op_type, true AS success,
       NULL::VARCHAR AS error, NULL::BOOLEAN AS clean, NULL::VARCHAR AS detail, NULL::BIGINT AS size_bytes,
       NULL::BIGINT AS page_count, length(md)::BIGINT AS md_chars, sha256(md) AS md_sha256 FROM j WHERE q
UNION ALL
SELECT job_id, 1, 'pdf', 'convert_to_pdf', true, NULL, NULL, NULL, strlen(html), np, NULL, NULL FROM j WHERE q
UNION ALL
SELECT job_id, 2, 'both', 'merge_pdfs', true, NULL, NULL, NULL, 2 * strlen(html), 2 * np, NULL, NULL FROM j WHERE q
UNION ALL
SELECT job_id, CASE WHEN q THEN 3 ELSE 0 END, 'scan', 'scan', clean,
       CASE WHEN NOT clean THEN 'virus detected: ' || detail END, clean, detail, NULL, NULL, NULL, NULL FROM j
UNION ALL
SELECT job_id, 4, 'thumb', 'thumbnail', clean, CASE WHEN NOT clean THEN {SKIP} END, NULL, NULL,
       CASE WHEN clean THEN strlen(substring(html, 1, 400)) END, CASE WHEN clean THEN 1 END, NULL, NULL FROM j WHERE q
UNION ALL
SELECT job_id, 1, 'pdf', 'convert_to_pdf', clean, CASE WHEN NOT clean THEN {SKIP} END, NULL, NULL,
       CASE WHEN clean THEN strlen(html) END, CASE WHEN clean THEN np END, NULL, NULL FROM j WHERE NOT q
UNION ALL
SELECT job_id, 2, 'thumb', 'thumbnail', clean, CASE WHEN NOT clean THEN {SKIP} END, NULL, NULL,
       CASE WHEN clean THEN strlen(substring(html, 1, 200)) END, CASE WHEN clean THEN np END, NULL, NULL
FROM j WHERE NOT q"""

SQL["page_job_outcome"] = """
SELECT 'page-' || page_id::VARCHAR AS job_id,
       CASE WHEN contains(url, '#') AND NOT contains(url, '?') THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN contains(url, '#') AND NOT contains(url, '?') THEN 'download page: NOT_FOUND' END AS error
FROM pages"""

SQL["upload_plan"] = f"""
WITH j AS ({DOC_RUN}), c AS (SELECT * FROM j WHERE clean)
SELECT job_id, 'pdf' AS name, NULL::BIGINT AS page_no, 'out' AS bucket,
       'pdf/' || doc_id::VARCHAR || '.pdf' AS key, 'application/pdf' AS content_type,
       strlen(text)::BIGINT AS size_bytes, 'op' AS source FROM c
UNION ALL
SELECT job_id, 'thumb', NULL, 'out', 'thumb/' || doc_id::VARCHAR || CASE WHEN allp THEN '.png' ELSE '.jpg' END,
       CASE WHEN allp THEN 'image/png' ELSE 'image/jpeg' END, strlen(substring(text, 1, width))::BIGINT, 'op'
FROM c WHERE NOT allp OR np = 1
UNION ALL
SELECT job_id, 'thumb', p::BIGINT, 'out', printf('thumb/%s_%03d.png', doc_id::VARCHAR, p), 'image/png',
       strlen(substring(substring(text, ((p - 1) * {PAGE_CHARS} + 1)::BIGINT, {PAGE_CHARS}), 1, width))::BIGINT, 'op'
FROM c, unnest(range(1, np + 1)) AS r(p) WHERE allp AND np > 1"""

SQL["artifact_files"] = f"""
WITH j AS ({DOC_RUN})
SELECT job_id, 'doc' AS name, 'input' AS source, lang || '/' || doc_id::VARCHAR || '.txt' AS file_name,
       strlen(text)::BIGINT AS size_bytes
FROM j JOIN (SELECT doc_id AS d2, lang FROM documents) l ON l.d2 = j.doc_id
UNION ALL
SELECT job_id, 'pdf', 'op', 'pdf.pdf', strlen(text)::BIGINT FROM j WHERE clean
UNION ALL
SELECT job_id, 'thumb', 'op', 'thumb', strlen(substring(text, 1, width))::BIGINT FROM j WHERE clean"""

PROGRESS = f"""
  WITH j AS ({DOC_RUN})
  SELECT job_id, 0::BIGINT AS seq, 'downloading' AS step, 0::BIGINT AS current, 1::BIGINT AS total FROM j
  UNION ALL SELECT job_id, 1, 'downloading', 1, 1 FROM j
  UNION ALL SELECT job_id, 2, 'scan', 1, 4 FROM j
  UNION ALL SELECT job_id, 3, 'pdf', 2, 4 FROM j WHERE clean
  UNION ALL SELECT job_id, 4, 'thumb', 3, 4 FROM j WHERE clean
  UNION ALL SELECT job_id, 5, 'text', 4, 4 FROM j WHERE clean"""

SQL["progress_events"] = PROGRESS
SQL["progress_reports"] = """
SELECT user_id::VARCHAR AS job_id, event_id AS seq, event_type AS step,
       least(greatest(coalesce(json_extract_string(props, '$.k')::BIGINT, 0), 0), 100) AS current, 100::BIGINT AS total
FROM events"""
SQL["latest_progress"] = """
SELECT user_id::VARCHAR AS job_id, arg_max(event_type, event_id) AS step,
       arg_max(json_extract_string(props, '$.k')::BIGINT, event_id) AS current, 100::BIGINT AS total,
       max(event_id) AS last_seq
FROM events GROUP BY user_id"""


# ---- C / D: routing, merging, previews ---------------------------------------

ROUTED = """
  SELECT 'doc-' || doc_id::VARCHAR AS file_id,
    CASE WHEN ends_with(source, '7') THEN 'application/pdf' WHEN ends_with(source, '3') THEN 'image/png'
         WHEN lang = 'de' THEN 'application/vnd.oasis.opendocument.text' ELSE 'text/plain' END AS content_type,
    strlen(text)::BIGINT AS size_bytes FROM documents
  UNION ALL
  SELECT 'page-' || page_id::VARCHAR, 'text/html', strlen(html)::BIGINT FROM pages"""
ROUTE = """CASE WHEN starts_with(coalesce(content_type, ''), 'image/') THEN 'image'
  WHEN coalesce(content_type, '') = 'application/pdf' THEN 'passthrough' ELSE 'office' END"""

SQL["route_conversion"] = f"SELECT file_id, content_type, {ROUTE} AS route FROM ({ROUTED}) f"
SQL["route_summary"] = f"""
SELECT {ROUTE} AS route, count(*)::BIGINT AS n_files, sum(size_bytes)::BIGINT AS total_bytes
FROM ({ROUTED}) f GROUP BY 1"""

SQL["merge_documents"] = """
WITH bad AS (SELECT DISTINCT conv_id FROM conversations WHERE length(text) < 40 OR text IS NULL),
p AS (
  SELECT conv_id, turn, text, greatest(1, ceil(length(text) / 400.0))::BIGINT AS np
  FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM bad)),
o AS (SELECT *, coalesce(sum(np) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM p)
SELECT conv_id, turn, q::BIGINT AS member_page_no, (off + q)::BIGINT AS page_no,
       substring(text, ((q - 1) * 400 + 1)::BIGINT, 400) AS page_text, NULL::VARCHAR AS error
FROM o, unnest(range(1, np + 1)) AS r(q)
UNION ALL
SELECT conv_id, turn + 1000, NULL, NULL, NULL, 'MEMBER_MISSING' FROM conversations WHERE length(text) < 40
UNION ALL
SELECT conv_id, turn, NULL, NULL, NULL, 'MEMBER_MISSING' FROM conversations WHERE text IS NULL"""

PREVIEW_PLAN = f"""
  WITH req AS (
    SELECT doc_id,
      CASE WHEN lang = 'en' THEN 'png' WHEN lang = 'de' THEN 'WebP' WHEN lang = 'fr' THEN '' ELSE 'JPEG' END AS fmt0,
      CASE WHEN ends_with(source, '1') THEN 0 ELSE 300 END AS w0,
      CASE WHEN ends_with(source, '2') THEN -1 ELSE 72 END AS d0,
      n_chars > 5000 AS allp, 'thumbs/' || doc_id::VARCHAR || '.img' AS dest_key,
      greatest(1, ceil(length(text) / {PAGE_CHARS}.0))::BIGINT AS np
    FROM documents),
  r AS (SELECT *, CASE WHEN fmt0 = '' THEN 'jpg' ELSE fmt0 END AS format,
          CASE WHEN w0 <= 0 THEN 400 ELSE w0 END AS width, CASE WHEN d0 <= 0 THEN 150 ELSE d0 END AS dpi FROM req)
  SELECT doc_id, p::BIGINT AS page_no, format,
    CASE lower(format) WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' ELSE 'image/jpeg' END AS mime,
    width::BIGINT AS width, dpi::BIGINT AS dpi, allp,
    CASE WHEN allp THEN printf('thumbs/%s_%03d.img', doc_id::VARCHAR, p) ELSE dest_key END AS key,
    NULL::VARCHAR AS error
  FROM r, unnest(CASE WHEN allp THEN range(1, np + 1) ELSE [1] END) AS u(p)"""

PREVIEWS = f"""
  SELECT pp.*, substring(d.page_text, 1, pp.width) AS preview,
         strlen(substring(d.page_text, 1, pp.width))::BIGINT AS size_bytes
  FROM ({PREVIEW_PLAN}) pp JOIN ({DOC_PAGES}) d ON d.doc_id = pp.doc_id AND d.page_no = pp.page_no"""

SQL["preview_plan"] = f"""
SELECT doc_id, page_no, format, mime, width, dpi, key, error FROM ({PREVIEW_PLAN}) x"""
SQL["previews_first"] = f"SELECT doc_id, key, preview, size_bytes FROM ({PREVIEWS}) x WHERE NOT allp"
SQL["previews_all"] = f"SELECT doc_id, page_no, key, preview, size_bytes FROM ({PREVIEWS}) x WHERE allp"
SQL["preview_sizes"] = f"""
SELECT doc_id, count(preview)::BIGINT AS n_previews,
       sum(CASE WHEN page_no = 1 THEN size_bytes END)::BIGINT AS first_size,
       sum(size_bytes)::BIGINT AS total_size
FROM ({PREVIEWS}) x GROUP BY doc_id"""


# ---- H: ledger ----------------------------------------------------------------

SUBS = """
  SELECT o.o_orderkey::VARCHAR AS job_id, [o.o_orderpriority, lower(c.c_mktsegment)] AS tags,
         CASE WHEN o.o_orderstatus = 'O' THEN 'c' || o.o_custkey::VARCHAR ELSE '' END AS caller_user,
         o.o_orderdate AS created
  FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey"""

REGISTERED = f"""
  SELECT job_id, 'file_processing' AS job_type,
         list_concat(['file_processing'], coalesce(tags, []),
                     CASE WHEN caller_user <> '' THEN ['user:' || caller_user] ELSE [] END) AS tags,
         created
  FROM ({SUBS}) s"""

LEDGER = """
  SELECT user_id::VARCHAR AS job_id, event_id AS seq, event_type AS step,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running'
      WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
    CASE WHEN event_type = 'error' THEN props END AS error
  FROM events"""

STATE = f"""
  WITH l AS ({LEDGER}),
  fs AS (SELECT job_id, min(seq) AS final_seq FROM l
         WHERE status IN ('completed', 'failed', 'cancelled') GROUP BY job_id),
  f AS (SELECT fs.job_id, l.status AS fstatus, l.error AS ferror, fs.final_seq
        FROM fs JOIN l ON l.job_id = fs.job_id AND l.seq = fs.final_seq),
  a AS (SELECT job_id, arg_max(status, seq) AS lstatus, max(seq) AS last_seq, count(*)::BIGINT AS n_events
        FROM l GROUP BY job_id)
  SELECT a.job_id, coalesce(f.fstatus, a.lstatus) AS status, f.ferror AS error, f.final_seq, a.last_seq,
         a.n_events
  FROM a LEFT JOIN f ON f.job_id = a.job_id"""

REQUESTS = """
  SELECT c_custkey AS request_id,
         CASE WHEN c_acctbal < 0 THEN '' ELSE floor(c_acctbal / 50)::BIGINT::VARCHAR END AS job_id
  FROM customer"""

SQL["register_jobs"] = f"""
SELECT job_id, job_type, array_to_string(tags, ',') AS tags, created FROM ({REGISTERED}) r"""
SQL["job_status"] = STATE
SQL["get_jobs"] = f"""
SELECT r.request_id, r.job_id,
  CASE WHEN r.job_id IS NOT NULL AND r.job_id <> '' AND s.job_id IS NOT NULL THEN s.status END AS status,
  CASE WHEN r.job_id IS NULL OR r.job_id = '' THEN 'JOB_ID_REQUIRED'
       WHEN s.job_id IS NULL THEN 'NOT_FOUND' END AS error
FROM ({REQUESTS}) r LEFT JOIN ({STATE}) s ON s.job_id = r.job_id"""
SQL["list_jobs"] = f"""
SELECT job_id, created, array_to_string(tags, ',') AS tags FROM ({REGISTERED}) r
WHERE list_contains(tags, 'file_processing') AND list_contains(tags, '1-URGENT')
  AND list_contains(tags, 'building')
ORDER BY created DESC, job_id LIMIT 25 OFFSET 10"""
SQL["cancel_jobs"] = f"""
WITH r AS ({REQUESTS}),
f AS (SELECT job_id, min(request_id) AS first_req FROM r GROUP BY job_id)
SELECT r.request_id, r.job_id,
  CASE WHEN r.job_id IS NULL OR r.job_id = '' THEN 'JOB_ID_REQUIRED'
       WHEN s.job_id IS NULL THEN 'NOT_FOUND'
       WHEN s.status IN ('completed', 'failed', 'cancelled') THEN 'ALREADY_FINAL'
       WHEN r.request_id = f.first_req THEN 'CANCELLED' ELSE 'ALREADY_FINAL' END AS outcome
FROM r LEFT JOIN f ON f.job_id = r.job_id LEFT JOIN ({STATE}) s ON s.job_id = r.job_id"""

THUMB_KEY = "'thumb/' || doc_id::VARCHAR"
DECODED = f"""
  WITH j AS ({DOC_RUN}),
  t AS (SELECT doc_id AS d2, p::BIGINT AS page_number,
          CASE WHEN np > 1 THEN printf('thumb/%s_%03d.png', doc_id::VARCHAR, p) ELSE {THUMB_KEY} || '.png' END AS key,
          strlen(substring(substring(text, ((p - 1) * {PAGE_CHARS} + 1)::BIGINT, {PAGE_CHARS}), 1, width))::BIGINT AS size_bytes
        FROM j, unnest(range(1, np + 1)) AS r(p) WHERE allp AND clean),
  th AS (SELECT d2, string_agg(page_number::VARCHAR || ':' || key || ':' || size_bytes::VARCHAR, ',' ORDER BY page_number) AS thumbs,
           string_agg('{{"page_number":' || page_number || ',"destination":{{"bucket":"out","key":"' || key
             || '","content_type":"image/png"}},"size_bytes":' || size_bytes || '}}', ',' ORDER BY page_number) AS pages
         FROM t GROUP BY d2)
  SELECT job_id, 0 AS k, 'scan' AS op_name, clean AS success,
         CASE WHEN NOT clean THEN 'virus detected: ' || detail END AS error, NULL::BIGINT AS size_bytes,
         clean, detail, NULL::VARCHAR AS markdown, NULL::VARCHAR AS dest_key, NULL::VARCHAR AS dest_type,
         NULL::VARCHAR AS thumbs, NULL::VARCHAR AS pages FROM j
  UNION ALL
  SELECT job_id, 1, 'pdf', clean, CASE WHEN NOT clean THEN {SKIP} END, CASE WHEN clean THEN nullif(strlen(text), 0) END,
         NULL, NULL, NULL, CASE WHEN clean THEN 'pdf/' || doc_id::VARCHAR || '.pdf' END,
         CASE WHEN clean THEN 'application/pdf' END, NULL, NULL FROM j
  UNION ALL
  SELECT job_id, 2, 'thumb', clean, CASE WHEN NOT clean THEN {SKIP} END,
         CASE WHEN clean THEN nullif(strlen(substring(text, 1, width)), 0) END, NULL, NULL, NULL,
         CASE WHEN clean AND NOT (allp AND np > 1) THEN {THUMB_KEY} || CASE WHEN allp THEN '.png' ELSE '.jpg' END END,
         CASE WHEN clean AND NOT (allp AND np > 1) THEN CASE WHEN allp THEN 'image/png' ELSE 'image/jpeg' END END,
         thumbs, pages FROM j LEFT JOIN th ON d2 = doc_id
  UNION ALL
  SELECT job_id, 3, 'text', clean, CASE WHEN NOT clean THEN {SKIP} END, NULL, NULL, NULL,
         CASE WHEN clean THEN text END, NULL, NULL, NULL, NULL FROM j"""

SQL["decode_results"] = f"""
SELECT job_id, op_name, success, error, size_bytes, clean, detail, sha256(markdown) AS md_sha256,
       NULL::VARCHAR AS html, CASE WHEN dest_key IS NOT NULL THEN 'out' END AS dest_bucket, dest_key, dest_type, thumbs
FROM ({DECODED}) x"""

# The JSON text itself: absent fields are left out, operations stand in their order.
SQL["results_json"] = f"""
SELECT job_id, '{{"results":{{' || string_agg('"' || op_name || '":{{"success":' || success
    || CASE WHEN error IS NULL THEN '' ELSE ',"error":' || to_json(error) END
    || CASE WHEN op_name <> 'scan' THEN '' ELSE ',"scan":{{"clean":' || clean
         || CASE WHEN detail IS NULL THEN '' ELSE ',"detail":' || to_json(detail) END || '}}' END
    || CASE WHEN markdown IS NULL THEN '' ELSE ',"markdown":{{"markdown":' || to_json(markdown) || '}}' END
    || CASE WHEN pages IS NULL THEN '' ELSE ',"thumbnail_pages":[' || pages || ']' END
    || CASE WHEN dest_key IS NULL THEN '' ELSE ',"destination":{{"bucket":"out","key":"' || dest_key
         || '","content_type":"' || dest_type || '"}}' END
    || CASE WHEN size_bytes IS NULL THEN '' ELSE ',"size_bytes":' || size_bytes END || '}}', ',' ORDER BY k)
  || '}}}}' AS output
FROM ({DECODED}) x GROUP BY job_id"""

SQL["op_status"] = f"""
SELECT op_name, op_type, success, error, count(*)::BIGINT AS n_ops
FROM ({SQL["run_jobs"]}) r GROUP BY ALL"""


# ---- B: more checks -------------------------------------------------------------

SQL["check_destinations"] = f"""
WITH d AS ({ORDER_DESTS})
SELECT job_id, name, {ref_error('bucket', 'key', ['out'])} AS dest_error FROM d
UNION ALL
SELECT o_orderkey::VARCHAR, NULL, NULL FROM orders
WHERE o_orderkey::VARCHAR NOT IN (SELECT job_id FROM d)"""

REQ = ["merge-in", "out", "src0", "src1", "src2", "web"]
SQL["check_requests"] = f"""
SELECT 'convert' AS kind, doc_id::VARCHAR AS request_id,
  coalesce({ref_error('source', "lang || '/' || doc_id::VARCHAR || '.txt'", REQ)},
           CASE WHEN lang = 'es' THEN 'CONTENT_TYPE_REQUIRED' WHEN lang = 'fr' THEN 'BUCKET_NOT_ALLOWED' END) AS error
FROM documents
UNION ALL
SELECT 'merge', o.o_orderkey::VARCHAR,
  CASE WHEN m.n IS NULL THEN 'FILES_REQUIRED' WHEN m.old > 0 THEN 'BUCKET_NOT_ALLOWED'
       WHEN o_orderpriority = '1-URGENT' THEN 'KEY_TRAVERSAL' END
FROM orders o LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS old
  FROM lineitem GROUP BY l_orderkey) m ON m.l_orderkey = o.o_orderkey
UNION ALL
SELECT kind, page_id::VARCHAR,
  CASE WHEN kind = 'scan' THEN NULL WHEN contains(url, '?') THEN 'BUCKET_REQUIRED'
       WHEN contains(url, '#') THEN 'KEY_REQUIRED' END
FROM pages, unnest(['scan', 'thumbnail', 'markdown']) AS k(kind)
UNION ALL
SELECT 'job', request_id::VARCHAR, CASE WHEN job_id IS NULL OR job_id = '' THEN 'JOB_ID_REQUIRED' END
FROM ({REQUESTS}) r"""


def url_check(table: str) -> str:
    """scheme, host and url_error of every row with a url."""
    scheme = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"
    host = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^/?#]*)', 1)"
    return f"""
  SELECT * EXCLUDE (url), CASE
      WHEN regexp_matches(url, '[[:cntrl:]]') OR contains(host, ' ')
        OR regexp_matches(split_part(split_part(url, '#', 1), '?', 1), '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)')
        OR (starts_with(host, '[') AND NOT contains(host, ']'))
        OR regexp_matches(host, ':[0-9]*[^0-9:\\]][^:]*$') THEN 'URL_INVALID'
      WHEN scheme NOT IN ('http', 'https') THEN 'URL_SCHEME' WHEN host = '' THEN 'URL_HOST' END AS url_error
  FROM (SELECT *, {scheme} AS scheme, {host} AS host FROM ({table}) t) u"""


SQL["check_urls"] = url_check("""
  SELECT page_id, 'as_is' AS form, url FROM pages
  UNION ALL SELECT page_id, 'ftp', 'ftp' || substring(url, position(':' IN url)) FROM pages
  UNION ALL SELECT page_id, 'no_host', regexp_replace(url, '//[^/]*', '//') FROM pages
  UNION ALL SELECT page_id, 'blank', replace(url, '//', '//a b') FROM pages
  UNION ALL SELECT page_id, 'port', regexp_replace(url, '//[^/]*', '//h:port') FROM pages
  UNION ALL SELECT page_id, 'bracket', regexp_replace(url, '//[^/]*', '//[::1') FROM pages
  UNION ALL SELECT page_id, 'escape', split_part(split_part(url, '#', 1), '?', 1) || '%zz' FROM pages
  UNION ALL SELECT page_id, 'newline', url || chr(10) FROM pages""")
SQL["url_hosts"] = f"""
SELECT host, count(*)::BIGINT AS n_urls, count(url_error)::BIGINT AS n_bad,
       count(*) FILTER (WHERE scheme = 'https')::BIGINT AS n_https
FROM ({url_check("SELECT url FROM pages")}) c GROUP BY host"""


# ---- I / J ----------------------------------------------------------------------

SQL["stream_jobs"] = SQL["run_jobs"]
SQL["stream_job_state"] = STATE
SQL["apply_backend"] = """
SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines,
       NULL::VARCHAR AS backend_error
FROM documents"""
SQL["stream_jobs_repeated"] = SQL["stream_jobs"]
SQL["job_snapshot"] = STATE
SQL["get_jobs_snapshot"] = SQL["get_jobs"]
SQL["cancel_jobs_repeated"] = f"""
WITH q AS ({REQUESTS}),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY request_id) AS k
      FROM (SELECT * FROM q UNION ALL SELECT * FROM q) u)
SELECT r.request_id, r.job_id,
  CASE WHEN r.job_id IS NULL OR r.job_id = '' THEN 'JOB_ID_REQUIRED'
       WHEN s.job_id IS NULL THEN 'NOT_FOUND'
       WHEN s.status IN ('completed', 'failed', 'cancelled') THEN 'ALREADY_FINAL'
       WHEN r.k = 1 THEN 'CANCELLED' ELSE 'ALREADY_FINAL' END AS outcome
FROM r LEFT JOIN ({STATE}) s ON s.job_id = r.job_id"""

SQL["put_objects"] = """
SELECT source AS bucket, CASE WHEN lang = 'de' THEN '../' ELSE '' END || lang || '/' || doc_id::VARCHAR || '.txt' AS key,
       CASE WHEN lang NOT IN ('de', 'es') THEN strlen(text) END AS size_bytes,
       CASE WHEN lang NOT IN ('de', 'es') THEN sha256(text) END AS content_sha256,
       CASE lang WHEN 'de' THEN 'BAD_KEY' WHEN 'es' THEN 'NO_CONTENT' END AS error
FROM documents"""
SQL["read_ranges"] = "SELECT doc_id, sha256(text) AS content_sha256 FROM documents"

# A header is open from its block up to the next header of its level or of one above.
SQL["heading_paths"] = """
WITH s AS (SELECT doc_id, string_split(text, '. ') AS arr FROM documents),
b AS (SELECT doc_id, (generate_subscripts(arr, 1) - 1)::BIGINT AS pos, unnest(arr) AS raw FROM s),
l AS (SELECT doc_id, pos, raw, length(raw) % 8 AS level FROM b),
h AS (SELECT * FROM l WHERE level BETWEEN 1 AND 6),
o AS (SELECT h.doc_id, h.pos, h.raw, min(n.pos) AS until
      FROM h LEFT JOIN h n ON n.doc_id = h.doc_id AND n.pos > h.pos AND n.level <= h.level
      GROUP BY h.doc_id, h.pos, h.raw)
SELECT l.doc_id, l.pos, CASE WHEN l.level BETWEEN 1 AND 6 THEN 'section_header'
         WHEN l.raw LIKE '- %' THEN 'list_item' ELSE 'text' END AS label,
       coalesce(string_agg(o.raw, ' > ' ORDER BY o.pos), '') AS path, count(o.pos) AS depth,
       max_by(o.raw, o.pos) AS heading
FROM l LEFT JOIN o ON o.doc_id = l.doc_id AND o.pos <= l.pos AND (o.until IS NULL OR l.pos < o.until)
GROUP BY l.doc_id, l.pos, l.raw, l.level"""

STORED_PAGES = f"""
  SELECT 'conv-' || conv_id::VARCHAR AS file_id, (turn + 1)::BIGINT AS page_no, text AS page_text FROM conversations
  UNION ALL
  SELECT 'doc-' || doc_id::VARCHAR, 1, text FROM documents WHERE ends_with(source, '3')
  UNION ALL
  SELECT 'doc-' || doc_id::VARCHAR, p::BIGINT, substring(text, ((p - 1) * {PAGE_CHARS} + 1)::BIGINT, {PAGE_CHARS})
  FROM documents, unnest(range(1, greatest(1, ceil(length(text) / {PAGE_CHARS}.0))::BIGINT + 1)) AS r(p)
  WHERE text IS NOT NULL AND NOT ends_with(source, '3') AND NOT ends_with(source, '7')"""
SQL["paginate_passthrough"] = STORED_PAGES
SQL["page_count_errors"] = f"""
WITH f AS (SELECT 'doc-' || doc_id::VARCHAR AS file_id FROM documents
           UNION ALL SELECT DISTINCT 'conv-' || conv_id::VARCHAR FROM conversations),
n AS (SELECT file_id, count(*)::BIGINT AS n_pages, sum(strlen(page_text))::BIGINT AS size_bytes
      FROM ({STORED_PAGES}) p GROUP BY file_id)
SELECT f.file_id, n.n_pages, n.size_bytes, CASE WHEN n.file_id IS NULL THEN 'NO_PAGES' END AS error
FROM f LEFT JOIN n ON n.file_id = f.file_id"""
