"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans: global windows,
list functions and plain joins where the Spark side has bucketed windows, regular expressions and reused exchanges.
"""

from __future__ import annotations

# Phrases that occur in the test texts (the default phrases do not).
PHRASES = (r"the\.?", "que los", "la la")

_WS = (
    r"\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_WORD = r"\p{L}\p{N}_"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _squeeze(text: str) -> str:
    return _strip(f"regexp_replace({text}, '[{_WS}]+', ' ', 'g')")


def _words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{_WS}]+'))"


def _json(text: str) -> str:
    return f"CAST(to_json({text}) AS VARCHAR)"


_TASKS = """
tasks AS (
  SELECT 't' || d.doc_id AS task_id, d.source || '-' || d.lang AS group_id, 'doc ' || d.doc_id AS title,
         d.text AS specification, d.text AS program, d.text AS reference_program,
         list_transform(
           list_filter(string_split(d.text, chr(10)), lambda line: trim(line) <> ''),
           lambda line, i: {'case_id': 'c' || i, 'stdin': line, 'expected_stdout': 'SUM=' || length(line)}) AS reference_tests,
         list_transform(
           list_filter([0, 1, 2], lambda k: k < d.doc_id % 4),
           lambda k: {'mutant_id': 'm' || k, 'source': 'MUTANT ' || k || ' OF ' || d.doc_id}) AS mutants,
         coalesce(p.url, 'n/a') AS source_url,
         CASE WHEN d.text LIKE '%Apache License%' THEN 'Apache-2.0' WHEN d.text LIKE '%MIT License%' THEN 'MIT'
              WHEN d.text LIKE '%GNU General Public%' THEN 'GPL-3.0' WHEN d.text LIKE '%CC BY-NC%' THEN 'CC-BY-NC-4.0'
              ELSE 'unknown' END AS license_id,
         CASE WHEN l.doc_id IS NULL THEN 'unreviewed' WHEN l.quality = 0 THEN 'rejected'
              WHEN l.toxic = 1 THEN 'revised' ELSE 'accepted' END AS review_status,
         CASE WHEN l.doc_id IS NULL OR d.doc_id % 3 = 0 THEN '' ELSE 'label present' END AS review_notes,
         d.doc_id AS seq
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

# Faulty JSON lines: what each kind of line breaks, by seq % 17.
_LINES = f"""{_TASKS},
lines AS (
  SELECT seq, seq % 17 AS kind, title, len(reference_tests) AS n_tests,
         CASE WHEN seq % 17 = 10 THEN 't' || (seq + 1) ELSE task_id END AS line_id,
         CASE seq % 17
           WHEN 0 THEN 'missing_fields:license_id,mutants' WHEN 1 THEN 'blank:program|not_string:license_id'
           WHEN 2 THEN 'blank:title' WHEN 3 THEN 'bad_status' WHEN 4 THEN 'duplicate_case_ids'
           WHEN 5 THEN 'case_not_strings' WHEN 6 THEN 'mutant_fields' WHEN 7 THEN 'json_decode'
           WHEN 8 THEN 'not_object' WHEN 9 THEN 'json_decode' WHEN 12 THEN 'case_blank'
           WHEN 13 THEN 'case_missing_fields' WHEN 15 THEN 'no_tests' ELSE '' END AS errors
  FROM tasks
)"""

_DIGESTS = f"""
digests AS (SELECT task_id, seq, sha256(lower({_squeeze('program')})) AS h FROM tasks),
firsts AS (SELECT h, arg_min(task_id, seq) AS canonical_id FROM digests GROUP BY h HAVING count(*) > 1),
copies AS (
  SELECT d.task_id, d.seq, f.canonical_id FROM digests d JOIN firsts f ON f.h = d.h WHERE d.task_id <> f.canonical_id
)"""


def _issues(phrases: tuple[str, ...]) -> str:
    vague = f"(?i)(^|[^{_WORD}])(?:{'|'.join(phrases)})($|[^{_WORD}])"
    return f"""{_TASKS},{_DIGESTS},
issues AS (
  SELECT task_id, 'duplicate_program' AS code, 'review' AS severity, 'program duplicates task ' || canonical_id AS detail,
         seq, 1 AS check_ord FROM copies
  UNION ALL SELECT task_id, 'possible_ambiguity', 'review', 'specification contains a configured vague phrase', seq, 2
    FROM tasks WHERE regexp_matches(specification, '{vague}')
  UNION ALL SELECT task_id, 'missing_provenance_url', 'error', 'source_url must identify a reviewable source', seq, 3
    FROM tasks WHERE NOT (source_url LIKE 'https://%' OR source_url LIKE 'http://%')
  UNION ALL SELECT task_id, 'unknown_license', 'error',
    'license must be identified before redistribution or training', seq, 4
    FROM tasks WHERE lower(license_id) IN ('unknown', 'unspecified', 'n/a')
  UNION ALL SELECT task_id, 'missing_review_rationale', 'warning',
    'accepted tasks should record why they passed review', seq, 5
    FROM tasks WHERE review_status = 'accepted' AND {_strip('review_notes')} = ''
)"""


_DEFAULT_PHRASES = (r"etc\.?", "as appropriate", "some cases", "and so on")

_RANKED = f"""{_TASKS},
sizes AS (SELECT group_id, count(*) AS n, md5('2026:' || group_id) AS k FROM tasks GROUP BY group_id),
ranked AS (
  SELECT group_id, n, row_number() OVER w AS rk,
         coalesce(sum(n) OVER (ORDER BY k, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes WINDOW w AS (ORDER BY k, group_id)
)"""
_SPLITS = f"""{_RANKED},
plan AS (
  SELECT sum(n) FILTER (rk <= 3) AS pinned,
         greatest(1, floor(sum(n) * CAST(0.7 AS DOUBLE))) - max(n) FILTER (rk = 1) AS train_room,
         greatest(1, floor(sum(n) * CAST(0.15 AS DOUBLE))) - max(n) FILTER (rk = 2) AS validation_room
  FROM ranked
),
placed AS (SELECT r.*, before - pinned AS x, train_room, validation_room FROM ranked r, plan),
filled AS (SELECT coalesce(sum(n), 0) AS f FROM placed WHERE rk > 3 AND x < train_room),
owners AS (
  SELECT group_id, CASE WHEN rk = 1 THEN 'train' WHEN rk = 2 THEN 'validation' WHEN rk = 3 THEN 'test'
                        WHEN x < train_room THEN 'train' WHEN x - f < validation_room THEN 'validation'
                        ELSE 'test' END AS split
  FROM placed, filled
),
split_tasks AS (SELECT t.*, o.split FROM tasks t JOIN owners o ON o.group_id = t.group_id)"""


def _tree(rows: str, digest: str, name: str) -> str:
    """CTEs of the hash tree over one digest per row; the last one is ``root``."""
    return f"""
leaves AS (SELECT d AS key, d || ':' || count(*) AS node FROM (SELECT {digest} AS d FROM {rows}) GROUP BY d),
level8 AS (SELECT substr(key, 1, 8) AS key, sha256(string_agg(node, ',' ORDER BY node)) AS tree
           FROM leaves GROUP BY substr(key, 1, 8)),
level4 AS (SELECT substr(key, 1, 4) AS key, sha256(string_agg(key || ':' || tree, ',' ORDER BY key || ':' || tree)) AS tree
           FROM level8 GROUP BY substr(key, 1, 4)),
root AS (SELECT sha256(string_agg(key || ':' || tree, ',' ORDER BY key || ':' || tree)) AS {name} FROM level4)"""


def _fields(*names: str) -> str:
    return " || ".join(f"length({n}) || ':' || {n}" for n in names)


_CASE_JSON = (
    "'[' || list_aggregate(list_transform(reference_tests, lambda c: '{\"case_id\": ' || "
    + _json("c.case_id") + " || ', \"expected_stdout\": ' || " + _json("c.expected_stdout")
    + " || ', \"stdin\": ' || " + _json("c.stdin") + " || '}'), 'string_agg', ', ') || ']'"
)
_MUTANT_JSON = (
    "'[' || coalesce(list_aggregate(list_transform(mutants, lambda m: '{\"mutant_id\": ' || " + _json("m.mutant_id")
    + " || ', \"source\": ' || " + _json("m.source") + " || '}'), 'string_agg', ', '), '') || ']'"
)
_TASK_JSON = " || ', ' || ".join(
    f"'\"{name}\": ' || " + {"reference_tests": _CASE_JSON, "mutants": _MUTANT_JSON}.get(name, _json(name))
    for name in sorted((
        "task_id", "group_id", "title", "specification", "program", "reference_program", "reference_tests", "mutants",
        "source_url", "license_id", "review_status", "review_notes",
    ))
)
_TASK_JSON = "'{' || " + _TASK_JSON + " || '}'"
_TARGET = "'{\"cases\": ' || " + _CASE_JSON + " || '}'"
_PROMPT = (
    "'Generate a JSON test suite for this COBOL program. Use only observable behavior from the specification. "
    "Return JSON with a ''cases'' array; each case has ''case_id'', ''stdin'', and ''expected_stdout''. Include boundary "
    "and error cases when specified. Do not include markdown.' || chr(10) || chr(10) || 'Specification:' || chr(10) "
    "|| specification || chr(10) || chr(10) || 'COBOL program:' || chr(10) || program"
)
_ENCODED = f"""{_TASKS},
counted AS (
  SELECT task_id, {_words(_PROMPT)} + 3 AS prompt_tokens, {_words(_PROMPT)} + 2 + {_words(_TARGET)} + 2 AS all_tokens
  FROM tasks
),
encoded AS (
  SELECT task_id, CAST(prompt_tokens AS INTEGER) AS prompt_tokens, CAST(least(all_tokens, 1024) AS INTEGER) AS n_ids
  FROM counted WHERE prompt_tokens < 1024
)"""

_EVENTS = f"""{_TASKS},
events_in AS (
  SELECT event_id, 't' || (event_id % (SELECT count(*) + count(*) // 4 + 1 FROM documents)) AS task_id,
         CASE WHEN user_id % 10 = 0 THEN ' ' ELSE 'r' || user_id END AS reviewer,
         CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'click' THEN 'revised' WHEN 'error' THEN 'rejected'
              WHEN 'view' THEN 'unreviewed' ELSE 'other' END AS status,
         props AS rationale, ts AS created_at
  FROM events
),
judged AS (
  SELECT e.*, CASE WHEN coalesce(trim(reviewer), '') = '' OR coalesce(trim(rationale), '') = ''
                     THEN 'missing_reviewer_or_rationale'
                   WHEN status = 'unreviewed' THEN 'unreviewed_status'
                   WHEN status NOT IN ('accepted', 'revised', 'rejected') THEN 'unknown_status'
                   WHEN NOT EXISTS (SELECT 1 FROM tasks t WHERE t.task_id = e.task_id) THEN 'unknown_task'
              END AS reject_reason
  FROM events_in e
)"""

_CASE_ID = "l_linenumber || '-' || l_partkey || '-' || l_suppkey"
_RUNS = f"""
cases AS (
  SELECT l_orderkey AS task_id, {_CASE_ID} AS case_id, l_linenumber AS case_ord,
         'SUM=' || CAST(min(l_quantity) AS BIGINT) AS expected_stdout
  FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey
),
mutants AS (
  SELECT o_orderkey AS task_id, 'm' || k AS mutant_id, k AS mutant_ord
  FROM orders, (VALUES (0), (1), (2)) AS ks(k) WHERE k < o_custkey % 4
),
ref_runs AS (
  SELECT l_orderkey AS task_id, {_CASE_ID} AS case_id, 'reference' AS program_id,
         CASE WHEN max(l_discount) >= 0.1 THEN NULL WHEN max(l_returnflag) = 'R' THEN 1 ELSE 0 END AS return_code,
         CASE WHEN max(l_tax) >= 0.08 THEN 'SUM=   -1' ELSE 'SUM=   ' || CAST(min(l_quantity) AS BIGINT) END AS stdout,
         'warning ' || max(l_returnflag) AS stderr, max(l_discount) >= 0.1 AS timed_out,
         max(l_extendedprice) / 50000 AS duration_seconds
  FROM lineitem, (VALUES (1), (2)) AS copies(copy)
  WHERE (copy = 1 OR l_orderkey % 13 = 5) AND NOT (l_orderkey % 11 = 3 AND l_linenumber = 1)
  GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, copy
),
mutant_runs AS (
  SELECT c.task_id, c.case_id, m.mutant_id AS program_id,
         CASE WHEN length(c.case_id) % 7 = m.mutant_ord THEN 1 ELSE 0 END AS return_code,
         CASE WHEN length(c.expected_stdout) = 5 AND m.mutant_ord = 1 THEN 'SUM=  0' ELSE c.expected_stdout END AS stdout
  FROM cases c JOIN mutants m ON m.task_id = c.task_id, (VALUES (1), (2)) AS copies(copy)
  WHERE copy = 1 OR c.task_id % 17 = 2
),
validity AS (
  SELECT c.task_id, c.case_id, c.case_ord, c.expected_stdout AS expected,
         bool_and(coalesce(NOT r.timed_out AND r.duration_seconds <= 2 AND r.return_code = 0
                           AND regexp_replace(r.stdout, '^SUM= +', 'SUM=') = c.expected_stdout, FALSE)) AS oracle_valid,
         count(r.case_id) AS reference_run_count
  FROM cases c LEFT JOIN ref_runs r ON r.task_id = c.task_id AND r.case_id = c.case_id GROUP BY ALL
),
matrix AS (
  SELECT v.task_id, v.case_id, v.case_ord, r.program_id AS mutant_id,
         bool_or(r.return_code <> 0 OR regexp_replace(r.stdout, '^SUM= +', 'SUM=') <> v.expected) AS killed,
         count(*) AS record_count
  FROM validity v JOIN mutant_runs r ON r.task_id = v.task_id AND r.case_id = v.case_id WHERE v.oracle_valid
  GROUP BY ALL
),"""
_SCORES = """
mutant_scores AS (
  SELECT m.task_id, m.mutant_id, m.mutant_ord, coalesce(bool_or(x.killed), FALSE) AS killed,
         count(*) FILTER (x.killed) AS kill_count, count(x.case_id) AS run_count,
         CAST(coalesce(sum(x.record_count - 1), 0) AS BIGINT) AS repeated_count
  FROM mutants m LEFT JOIN matrix x ON x.task_id = m.task_id AND x.mutant_id = m.mutant_id GROUP BY ALL
),
per_suite AS (
  SELECT task_id, count(*) AS generated_case_count, count(*) FILTER (oracle_valid) AS oracle_valid_count,
         count(*) FILTER (reference_run_count = 0) AS missing_reference_count,
         sum(greatest(reference_run_count - 1, 0)) AS repeated
  FROM validity GROUP BY task_id
),
per_task AS (
  SELECT task_id, count(*) AS mutant_count, count(*) FILTER (killed) AS mutants_killed,
         CAST(sum(run_count) AS BIGINT) AS run_count, sum(repeated_count) AS repeated_count
  FROM mutant_scores GROUP BY task_id
),
suite_scores AS (
  SELECT s.task_id, generated_case_count, oracle_valid_count,
         generated_case_count - oracle_valid_count - missing_reference_count AS oracle_invalid_count,
         missing_reference_count,
         coalesce(mutant_count, 0) AS mutant_count, coalesce(mutants_killed, 0) AS mutants_killed,
         CAST(mutants_killed AS DOUBLE) / mutant_count AS mutation_score,
         oracle_valid_count * coalesce(mutant_count, 0) - coalesce(run_count, 0) AS missing_run_count,
         CAST(repeated + coalesce(repeated_count, 0) AS BIGINT) AS repeated_run_count,
         CAST(0 AS BIGINT) AS ambiguous_mutant_count
  FROM per_suite s LEFT JOIN per_task p ON p.task_id = s.task_id
)"""
_OUTPUT_RUNS = """
outputs AS (
  SELECT o_orderkey AS task_id, CASE o_orderkey % 8
    WHEN 0 THEN 'model output did not contain a JSON object'
    WHEN 1 THEN 'generated suite must include at least one test case'
    WHEN 2 THEN 'generated case IDs must be unique'
    WHEN 3 THEN 'case_id, stdin, and expected_stdout must be strings'
    WHEN 4 THEN 'generated suite must be a JSON object with a cases list'
    WHEN 5 THEN 'invalid JSON'
    WHEN 6 THEN 'case missing fields: [''stdin'', ''expected_stdout'']' END AS parse_error
  FROM orders
),
validity AS (
  SELECT o_orderkey AS task_id, c.case_id, c.case_ord, NOT (o_orderstatus = 'P' AND c.case_id = 'a') AS oracle_valid,
         CAST(1 AS BIGINT) AS reference_run_count
  FROM orders, (VALUES ('a', 0), ('b', 1)) AS c(case_id, case_ord) WHERE o_orderkey % 8 = 7
),
mutants AS (
  SELECT o_orderkey AS task_id, 'm' || k AS mutant_id, k AS mutant_ord
  FROM orders, (VALUES (0), (1), (2)) AS ks(k) WHERE k < o_custkey % 4
),
matrix AS (
  SELECT v.task_id, v.case_id, v.case_ord, m.mutant_id,
         (m.mutant_ord = 0 AND v.case_id = 'b') OR m.mutant_ord = 1 AS killed, CAST(1 AS BIGINT) AS record_count
  FROM validity v JOIN mutants m ON m.task_id = v.task_id
  WHERE v.oracle_valid AND NOT (m.mutant_ord = 1 AND v.case_id = 'b')
),"""

_LINE_BREAKS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"

ORACLE: dict[str, str] = {
    "load_tasks": f"""WITH {_LINES}
        SELECT 'task' AS kind, line_id AS id, title AS detail, n_tests AS n FROM lines
        WHERE errors = '' AND kind <> 11
        UNION ALL
        SELECT 'quarantine', CASE WHEN kind = 11 THEN 'duplicate_task_id' ELSE string_split(errors, '|')[1] END, '', count(*)
        FROM lines WHERE errors <> '' OR kind = 11 GROUP BY ALL""",
    "quarantine_lines": f"""WITH {_LINES},
        placed AS (
          SELECT *, seq // 500 AS file,
                 sum(CASE WHEN seq % 5 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY seq // 500 ORDER BY seq) AS line_number FROM lines)
        SELECT CAST(file AS BIGINT) AS file, CAST(line_number AS BIGINT) AS line_number,
               CASE WHEN kind = 11 THEN 'duplicate_task_id' ELSE string_split(errors, '|')[1] END AS first_error
        FROM placed WHERE errors <> '' OR kind = 11""",
    "write_tasks_roundtrip": f"""WITH {_TASKS}
        SELECT task_id, group_id, title, specification, program, source_url, license_id, review_status, review_notes,
               CAST(len(reference_tests) AS INTEGER) AS n_tests, reference_tests[-1].expected_stdout AS last_expected,
               CAST(len(mutants) AS INTEGER) AS n_mutants FROM tasks""",
    "task_json": f"WITH {_TASKS} SELECT task_id, {_TASK_JSON} AS task_json FROM tasks",
    "validate_tasks": f"WITH {_LINES} SELECT seq, string_split(errors, '|')[1] AS first_error, errors FROM lines",
    "validate_cases": f"""WITH {_LINES}
        SELECT seq, CAST(i AS INTEGER) AS case_ord,
               CASE kind WHEN 5 THEN errors WHEN 12 THEN errors WHEN 13 THEN errors ELSE '' END AS fault
        FROM (SELECT seq, kind, errors, unnest(range(
                CASE WHEN kind IN (5, 12, 13) THEN 1 WHEN kind = 4 THEN 2 * n_tests
                     WHEN kind IN (7, 8, 9, 15) THEN 0 ELSE n_tests END)) AS i FROM lines)""",
    "duplicate_task_ids": f"""WITH {_LINES}
        SELECT line_id AS task_id, count(*) AS n_rows, min(seq) AS first_seen FROM lines WHERE errors = ''
        GROUP BY line_id HAVING count(*) > 1""",
    "duplicate_programs": f"WITH {_TASKS},{_DIGESTS} SELECT task_id, seq, canonical_id FROM copies",
    "vague_specs": f"WITH {_issues(PHRASES)} SELECT task_id FROM issues WHERE code = 'possible_ambiguity'",
    "missing_provenance": f"""WITH {_TASKS} SELECT task_id, source_url FROM tasks
        WHERE NOT starts_with(source_url, 'https://') AND NOT starts_with(source_url, 'http://')""",
    "unknown_license": f"""WITH {_TASKS} SELECT task_id, license_id FROM tasks
        WHERE lower(license_id) IN ('unknown', 'unspecified', 'n/a')""",
    "missing_rationale": f"""WITH {_TASKS} SELECT task_id FROM tasks
        WHERE review_status = 'accepted' AND trim(review_notes) = ''""",
    "curation_issues": f"WITH {_issues(PHRASES)} SELECT task_id, code, severity, detail, seq, check_ord FROM issues",
    "issues_by_code": f"WITH {_issues(PHRASES)} SELECT code, count(*) AS n FROM issues GROUP BY code",
    "curation_report": f"""WITH {_issues(_DEFAULT_PHRASES)},
        codes AS (SELECT code, count(*) AS n FROM issues GROUP BY code)
        SELECT count(*) AS task_count, count(*) FILTER (review_status = 'accepted') AS accepted_count,
               count(*) FILTER (review_status = 'revised') AS revised_count,
               count(*) FILTER (review_status = 'rejected') AS rejected_count,
               count(*) FILTER (review_status = 'unreviewed') AS unreviewed_count,
               (SELECT '{{' || string_agg('"' || code || '":' || n, ',' ORDER BY code) || '}}' FROM codes) AS issues_by_code
        FROM tasks""",
    "dataset_fingerprint": f"""WITH {_TASKS},{_tree(
        'tasks', f"sha256({_fields('task_id', 'program', 'reference_program', 'specification')})", 'fingerprint')}
        SELECT fingerprint FROM root""",
    "group_sizes": f"WITH {_TASKS} SELECT group_id, count(*) AS n_tasks FROM tasks GROUP BY group_id",
    "make_splits": f"WITH {_SPLITS} SELECT task_id, group_id, split FROM split_tasks",
    "deficit_splits": f"""WITH RECURSIVE {_RANKED},
        lacking(rk, train, validation) AS (
          SELECT CAST(3 AS BIGINT), greatest(1, floor(sum(n) * CAST(0.7 AS DOUBLE))) - max(n) FILTER (rk = 1),
                 greatest(1, floor(sum(n) * CAST(0.15 AS DOUBLE))) - max(n) FILTER (rk = 2) FROM ranked
          UNION ALL
          SELECT r.rk, train - CASE WHEN train >= validation AND train > 0 THEN n ELSE 0 END,
                 validation - CASE WHEN NOT (train >= validation AND train > 0) AND validation > 0 THEN n ELSE 0 END
          FROM lacking l JOIN ranked r ON r.rk = l.rk + 1
        ),
        owners AS (
          SELECT group_id, CASE WHEN r.rk = 1 THEN 'train' WHEN r.rk = 2 THEN 'validation' WHEN r.rk = 3 THEN 'test'
                                WHEN train >= validation AND train > 0 THEN 'train' WHEN validation > 0 THEN 'validation' ELSE 'test' END AS split
          FROM ranked r LEFT JOIN lacking l ON l.rk = r.rk - 1
        )
        SELECT task_id, t.group_id, split FROM tasks t JOIN owners o ON o.group_id = t.group_id""",
    "split_counts": f"""WITH {_SPLITS} SELECT split, count(*) AS n_tasks, count(DISTINCT group_id) AS n_groups
        FROM split_tasks GROUP BY split""",
    "split_manifest": f"""WITH {_SPLITS}
        SELECT CAST(2026 AS INTEGER) AS seed, split, 'task' AS kind, task_id AS id FROM split_tasks
        UNION ALL SELECT DISTINCT 2026, split, 'group', group_id FROM split_tasks""",
    "group_leakage": f"""WITH {_TASKS},
        careless AS (SELECT group_id, CASE WHEN substr(md5(task_id), 1, 1) < 'b' THEN 'train'
                     WHEN substr(md5(task_id), 1, 1) < 'd' THEN 'validation' ELSE 'test' END AS split FROM tasks)
        SELECT group_id FROM careless GROUP BY group_id HAVING count(DISTINCT split) > 1""",
    "spec_leakage": f"""WITH {_SPLITS},
        specs AS (SELECT task_id, split, lower({_squeeze('specification')}) AS spec FROM split_tasks),
        crossing AS (SELECT spec FROM specs GROUP BY spec HAVING count(DISTINCT split) > 1)
        SELECT task_id, split FROM specs WHERE spec IN (SELECT spec FROM crossing)""",
    "training_manifest": f"""WITH {_SPLITS}, train AS (SELECT task_id FROM split_tasks WHERE split = 'train'),
        {_tree('train', 'sha256(task_id)', 'task_id_fingerprint')}
        SELECT 'train' AS split, CAST(2026 AS INTEGER) AS seed, (SELECT count(*) FROM train) AS task_count,
               task_id_fingerprint, FALSE AS validation_used_for_updates, FALSE AS test_accessed FROM root""",
    "features": f"""WITH {_TASKS},
        source AS (SELECT *, upper(replace(program, 'ß', 'ss')) AS src FROM tasks),
        tokens AS (SELECT *, regexp_extract_all(src, '[A-Z][A-Z0-9-]*') AS tok FROM source)
        SELECT task_id, CAST(length(program) AS DOUBLE) AS program_chars,
          CAST(len(list_filter(regexp_split_to_array(src, '{_LINE_BREAKS}'), lambda l: {_strip('l')} <> '')) AS DOUBLE)
            AS program_lines,
          CAST(len(tok) AS DOUBLE) AS token_count,
          CAST(len(list_distinct(tok)) AS DOUBLE) / greatest(1, len(tok)) AS unique_token_ratio,
          CAST(len(list_filter(tok, lambda w: w IN ('ACCEPT', 'ADD', 'CALL', 'COMPUTE', 'DISPLAY', 'DIVIDE', 'EVALUATE',
            'IF', 'MOVE', 'MULTIPLY', 'PERFORM', 'READ', 'SEARCH', 'STOP', 'WRITE'))) AS DOUBLE) AS verb_count,
          CAST(len(list_filter(regexp_split_to_array(src, '[^{_WORD}]+'), lambda w: w = 'COPY')) AS DOUBLE)
            AS copybook_count,
          CAST(len(regexp_extract_all(src, '(?:^|[^{_WORD}])SECTION\\.')) AS DOUBLE) AS section_count,
          CAST(len(regexp_extract_all(src, '(?m)^[A-Z0-9-]+\\.$')) AS DOUBLE) AS paragraph_count,
          CAST({_words('specification')} AS DOUBLE) AS spec_words,
          CAST(len(reference_tests) AS DOUBLE) AS reference_case_count, CAST(len(mutants) AS DOUBLE) AS mutant_count,
          CAST(source_url LIKE 'http%' AS DOUBLE) AS has_source_url,
          CAST(lower(license_id) NOT IN ('unknown', 'unspecified') AS DOUBLE) AS has_known_license
        FROM tokens""",
    "detector_labels": f"""WITH {_TASKS}
        SELECT task_id, CAST(review_status <> 'accepted' AS INTEGER) AS label FROM tasks
        WHERE review_status <> 'unreviewed'""",
    "class_weights": f"""WITH {_TASKS},
        labels AS (SELECT CAST(review_status <> 'accepted' AS INTEGER) AS label FROM tasks
                   WHERE review_status <> 'unreviewed')
        SELECT label, count(*) AS n, CAST((SELECT count(*) FROM labels) AS DOUBLE) / (2 * count(*)) AS weight
        FROM labels GROUP BY label""",
    "detector_roundtrip": f"WITH {_TASKS} SELECT task_id, TRUE AS same, TRUE AS in_range FROM tasks",
    "review_queue": f"""WITH {_TASKS},
        scored AS (
          SELECT t.*, (d.n_chars * 37 % 1001) / CAST(1000 AS DOUBLE) AS p
          FROM tasks t JOIN documents d ON d.doc_id = t.seq WHERE review_status = 'unreviewed'),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY abs(p - 0.5), seq) AS rn FROM scored)
        SELECT task_id, group_id, p AS probability_review_needed, specification, program, source_url AS provenance
        FROM ranked WHERE rn = 1 ORDER BY abs(p - 0.5), seq LIMIT 25""",
    "ledger_import": f"""WITH {_TASKS} SELECT task_id, {_TASK_JSON} AS task_json FROM tasks
        WHERE review_status = 'unreviewed'""",
    "ledger_record": f"""WITH {_EVENTS} SELECT event_id, task_id, reviewer, status, rationale, created_at FROM judged
        WHERE reject_reason IS NULL""",
    "ledger_rejects": f"WITH {_EVENTS} SELECT event_id, reject_reason FROM judged WHERE reject_reason IS NOT NULL",
    "review_history": f"""WITH {_EVENTS} SELECT event_id, task_id, reviewer, status, rationale, created_at FROM judged
        WHERE reject_reason IS NULL ORDER BY task_id, event_id""",
    "task_cases": f"""WITH {_TASKS}, listed AS (SELECT task_id, reference_tests, unnest(range(len(reference_tests))) AS i FROM tasks)
        SELECT task_id, CAST(i AS INTEGER) AS case_ord, reference_tests[i + 1].case_id AS case_id,
               reference_tests[i + 1].stdin AS stdin, reference_tests[i + 1].expected_stdout AS expected_stdout FROM listed""",
    "task_mutants": f"""WITH {_TASKS}, listed AS (SELECT task_id, mutants, unnest(range(len(mutants))) AS i FROM tasks)
        SELECT task_id, CAST(i AS INTEGER) AS mutant_ord, mutants[i + 1].mutant_id AS mutant_id,
               mutants[i + 1].source AS source FROM listed""",
    "ledger_stream": f"WITH {_EVENTS} SELECT event_id, task_id, coalesce(reject_reason, '') AS reject_reason FROM judged",
    "sft_prompts": f"WITH {_TASKS} SELECT task_id, {_PROMPT} AS prompt FROM tasks",
    "sft_targets": f"WITH {_TASKS} SELECT task_id, {_TARGET} AS target FROM tasks",
    "sft_messages": f"""WITH {_TASKS} SELECT task_id, 'user,assistant' AS roles, {_PROMPT} AS user_content,
        {_TARGET} AS assistant_content FROM tasks""",
    "sft_encode": f"""WITH {_ENCODED}
        SELECT task_id, prompt_tokens, n_ids, least(prompt_tokens, n_ids) AS n_masked,
               n_ids - least(prompt_tokens, n_ids) AS n_supervised, n_ids AS n_attended FROM encoded""",
    "sft_rejects": f"""WITH {_ENCODED}
        SELECT task_id, CAST(prompt_tokens AS INTEGER) AS prompt_tokens, 'prompt_exceeds_max_length' AS reject_reason
        FROM counted WHERE prompt_tokens >= 1024""",
    "sft_batches": f"""WITH {_ENCODED},
        placed AS (SELECT task_id, n_ids, row_number() OVER (ORDER BY md5('2026:' || task_id), task_id) - 1 AS pos FROM encoded),
        wide AS (SELECT *, max(n_ids) OVER (PARTITION BY pos // 8) AS width FROM placed)
        SELECT CAST(pos // 8 AS BIGINT) AS batch_no, CAST(pos % 8 AS INTEGER) AS row_no, task_id, width,
               width AS n_ids, width - n_ids AS n_padding FROM wide""",
    "normalize_output": f"""
        SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(replace(
            ' ' || chr(13) || chr(10) || 'SUM=  ' || text || chr(13) || chr(10) || chr(9) || chr(10) || 'SUM=  ' || doc_id
            || ' ' || chr(31) || chr(10), chr(13), ''), chr(10)), lambda l: {_strip('l')}), lambda l: l <> ''),
            lambda l: regexp_replace(l, '^(SUM=)[{_WS}]+', '\\1')), chr(10)) AS normalized
        FROM documents""",
    "run_records": f"""WITH {_RUNS} late AS (
          SELECT *, timed_out OR duration_seconds > 1.5 AS is_late FROM ref_runs)
        SELECT task_id, case_id, program_id, CASE WHEN NOT is_late THEN return_code END AS return_code,
               CASE WHEN is_late THEN '' ELSE regexp_replace(stdout, '^SUM= +', 'SUM=') END AS stdout,
               CASE WHEN is_late THEN 'timeout' ELSE substr(stderr, 1, 4000) END AS stderr,
               is_late AS timed_out, duration_seconds FROM late""",
    "oracle_validity": f"WITH {_RUNS}{_SCORES} SELECT task_id, case_id, oracle_valid FROM validity",
    "kill_matrix": f"WITH {_RUNS}{_SCORES} SELECT task_id, case_id, case_ord, mutant_id, killed, record_count FROM matrix",
    "killing_cases": f"WITH {_RUNS}{_SCORES} SELECT task_id, case_id, case_ord, mutant_id FROM matrix WHERE killed",
    "mutant_scores": f"""WITH {_RUNS}{_SCORES}
        SELECT task_id, mutant_id, killed, kill_count, run_count, repeated_count, CAST(1 AS BIGINT) AS copies,
               FALSE AS ambiguous FROM mutant_scores""",
    "suite_scores": f"WITH {_RUNS}{_SCORES} SELECT * FROM suite_scores",
    "parse_suites": f"""WITH {_OUTPUT_RUNS}{_SCORES}
        SELECT task_id, coalesce(parse_error, '') AS parse_error,
               CAST(CASE WHEN parse_error IS NULL THEN 2 ELSE 0 END AS INTEGER) AS n_cases FROM outputs""",
    "score_outputs": f"""WITH {_OUTPUT_RUNS}{_SCORES}
        SELECT o.task_id, o.parse_error, s.generated_case_count, coalesce(s.oracle_valid_count, 0) AS oracle_valid_count,
               s.oracle_invalid_count, s.missing_reference_count, s.mutant_count, s.mutants_killed, s.mutation_score,
               s.missing_run_count, s.repeated_run_count, s.ambiguous_mutant_count
        FROM outputs o LEFT JOIN suite_scores s ON s.task_id = o.task_id""",
    "suite_reports": f"""WITH {_OUTPUT_RUNS}{_SCORES},
        lists AS (SELECT task_id, mutant_id, string_agg(case_id, ',' ORDER BY case_ord) AS kills FROM matrix
                  WHERE killed GROUP BY ALL)
        SELECT m.task_id, m.mutant_id, m.killed, FALSE AS ambiguous, coalesce(l.kills, '') AS killed_by_cases
        FROM mutant_scores m JOIN suite_scores s ON s.task_id = m.task_id
        LEFT JOIN lists l ON l.task_id = m.task_id AND l.mutant_id = m.mutant_id""",
}

# The same results by other ways.
ORACLE["review_queue_by_index"] = ORACLE["review_queue"]
ORACLE["fingerprint_tree"] = ORACLE["dataset_fingerprint"]
ORACLE["fingerprint_difference"] = f"""WITH {_TASKS}
    SELECT task_id, CAST(1 AS BIGINT) AS mine, CAST(0 AS BIGINT) AS theirs FROM tasks WHERE seq % 10 = 0 AND seq % 100 < 50"""
ORACLE["suite_scores_stream"] = ORACLE["suite_scores"]
ORACLE["feature_matrix"] = f"""WITH features AS ({ORACLE["features"]}),
    listed AS (
      SELECT task_id, [copybook_count, has_known_license, has_source_url, mutant_count, paragraph_count, program_chars, program_lines,
                       reference_case_count, section_count, spec_words, token_count, unique_token_ratio, verb_count] AS f FROM features)
    SELECT task_id, CAST(i AS INTEGER) AS place, f[i + 1] AS value FROM listed, unnest(range(13)) AS t(i)"""
