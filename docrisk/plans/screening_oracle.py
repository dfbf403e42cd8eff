"""DuckDB counterparts of the screening queries, written independently of the Spark expressions.

Common table expressions build up the record: d (documents), r (raw text), l (lines and their compact
forms), p (sections and fields), s (rules). Patterns are RE2's; white space and digits are Unicode's.
"""

from __future__ import annotations

from docrisk import lexicon as lx
from docrisk.plans.screening_queries import PROFILE, RULES

WSI = r"\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WSI}]"
D = r"\p{Nd}"
ENDS = r"\r\n|[\n\x0B\x0C\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TOKEN = rf"{D}{{4}}(?:[./-]{D}{{1,2}})?"
RANGE = rf"({TOKEN}){WS}*(?:--|—|–|-|~|至){WS}*({TOKEN}|至今|现在)"
NOW = 2025 * 12 + 6
WIDE, NARROW = "０１２３４５６７８９", "0123456789"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def grab(x: str, pattern: str, k: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {q(pattern)}, {k}), '')"


def strip(x: str) -> str:
    return sub(x, rf"\A{WS}+|{WS}+\z")


def lines_of(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda y: trim({sub('y', WS + '+', ' ')}, ' ')), lambda y: y <> '')"


def compact(x: str) -> str:
    return sub(x, rf"[{WSI}:：;；、,，.。/\\|_-]+")


def inlist(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def firsts(x: str, n: int) -> str:
    return f"list_slice({x}, 1, {n})"


def distinct_cut(x: str, n: int) -> str:
    cut = f"list_transform({x}, lambda y: left(y, {n}))"
    return f"list_filter({cut}, lambda y, i: list_position({cut}, y) = i)"


def month(t: str) -> str:
    a = f"translate({t}, '{WIDE}', '{NARROW}')"
    return (
        f"CASE WHEN {t} IN ('至今', '现在', '今') THEN {NOW} ELSE try_cast({grab(a, '^([0-9]{4})')} AS INTEGER) * 12"
        f" + coalesce(try_cast({grab(a, '^[0-9]{4}[./-]([0-9]{1,2})')} AS INTEGER), 1) END"
    )


def evidence(x: str, test) -> str:
    cut = f"list_filter(list_transform(regexp_split_to_array({x}, {q(ENDS)}), lambda y: trim({sub('y', WS + '+', ' ')}, ' ')), lambda y: y <> '')"
    return f"coalesce(array_to_string(list_transform({firsts(f'list_filter({cut}, lambda y: {test})', 3)}, lambda y: left(y, 180)), ' | '), '')"


def times(x: str, word: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(word)}, ''))) // {len(word)})"


CLEANED = strip(sub(sub(sub("replace(coalesce(text, ''), chr(13) || chr(10), chr(10))", "[A-Za-z0-9_-]{24,}~~", " "), rf"(?:\n{WS}*){{3,}}", "\n\n"), r"[ \t]{2,}", " "))
DOCS = "d AS (SELECT DISTINCT doc_id, text, name, filename FROM resumes_for_analysis)"
RAW = f"{DOCS}, r AS (SELECT *, {CLEANED} AS raw FROM d)"
LINES = f"{RAW}, l0 AS (SELECT *, {lines_of('raw')} AS lines FROM r), l AS (SELECT *, list_transform(lines, lambda y: {compact('y')}) AS c FROM l0)"


def section(starts) -> str:
    """Indexes of a section's lines: after the first start, before the first other heading after it, without starts."""
    a, h = inlist(starts), inlist(lx.HEADINGS)
    n = "range(1, len(lines) + 1)"
    first = f"list_min(list_filter({n}, lambda i: c[i] IN {a}))"
    stop = f"coalesce(list_min(list_filter({n}, lambda i: i > {first} AND c[i] IN {h} AND c[i] NOT IN {a})), len(lines) + 1)"
    return f"CASE WHEN {first} IS NULL THEN [] ELSE list_transform(list_filter({n}, lambda i: i > {first} AND i < {stop} AND c[i] NOT IN {a}), lambda i: lines[i]) END"


EMPLOYMENT = f"{has('y', RANGE)} AND NOT {has('y', lx.EDUCATION_WORDS + '|教育背景|教育经历')} AND {has('y', lx.ORGANISATION_WORDS)} AND {has('y', lx.JOB_WORDS)}"
PROJECT_LINE = f"(contains(y, '项目') OR ({has('y', lx.PROJECT_WORDS)} AND NOT ({has('y', lx.COMPANY_WORDS)} AND {has('y', lx.ROLE_WORDS)} AND length(y) < 45)))"
# the latest heading before a line, by a scan back over its predecessors
CURRENT = f"list_last(list_filter(list_slice(c, 1, i - 1), lambda z: z IN {inlist(lx.HEADINGS)}))"
INFERRED = (
    f"list_filter(lines, lambda y, i: c[i] NOT IN {inlist(lx.HEADINGS)} AND coalesce({CURRENT}, '') NOT IN {inlist(lx.PROJECT_HEADINGS)}"
    f" AND (NOT contains(y, '项目') OR coalesce({CURRENT}, '') IN {inlist(lx.WORK_HEADINGS)}) AND {EMPLOYMENT})"
)
NAME_PATTERNS = (
    f"姓名[:{WSI}]*([一-龥]{{2,4}})", f"^([一-龥]{{2,3}}){WS}+(?:个人简历|简历|求职)", rf"([一-龥]{{2,4}}){WS}{{1,3}}{D}{{3}}[-\p{{Nd}}]{{7,}}",
    rf"([一-龥]{{2,4}}){WS}{{0,3}}[_~\p{{Nd}}](?:{WS}|$)",
)
LINE_NAME = f"list_first(list_filter(list_transform(lines, lambda y: coalesce({', '.join(grab('y', x) for x in NAME_PATTERNS)})), lambda y: y IS NOT NULL))"
FILE_NAME = r"[-_]([^-_]{2,4})\.[^.]+$"
PARSED = f"""{LINES}, p0 AS (SELECT *, array_to_string(lines, ' ') AS clean, {section(lx.EDUCATION_HEADINGS)} AS es, {section(lx.WORK_HEADINGS)} AS ws,
  {section(lx.PROJECT_HEADINGS)} AS project, {section(lx.SKILL_STARTS)} AS ss, {distinct_cut(INFERRED, 140)} AS inferred FROM l),
p1 AS (SELECT *, {distinct_cut(f"list_filter(CASE WHEN len(es) > 0 THEN es ELSE lines END, lambda y: {has('y', lx.EDUCATION_WORDS)} AND ({has('y', RANGE)} OR {has('y', '统招|学历')}))", 120)} AS education,
  list_min(list_filter(range(1, len(ws) + 1), lambda i: {has('ws[i]', RANGE)})) AS fi,
  {distinct_cut("list_filter(ss, lambda y: length(y) <= 120)", 120)} AS skills FROM p0),
p2 AS (SELECT *, {distinct_cut(f"list_filter(ws, lambda y, i: {has('y', RANGE)} OR (fi IS NOT NULL AND i > fi AND {has('y', lx.DUTY_WORDS)}))", 140)} AS dated FROM p1),
p3 AS (SELECT *, CASE WHEN len(dated) > 0 THEN dated ELSE inferred END AS work,
  list_min(list_filter(range(1, len(lines) + 1), lambda i: c[i] IN {inlist(lx.PROJECT_HEADINGS)})) AS pi,
  coalesce({LINE_NAME}, {grab('left(clean, 200)', '([一-龥]{2,4})')}, '未知') AS name_in_text FROM p2),
p4 AS (SELECT *, CASE WHEN pi IS NULL THEN raw ELSE array_to_string(list_slice(lines, 1, pi - 1), chr(10)) END AS before,
  coalesce(nullif(name, ''), {grab('filename', FILE_NAME)}, name_in_text) AS full_name, coalesce(filename, '') AS file,
  list_filter([CASE WHEN length(raw) < 300 THEN '文本抽取内容较短' END, CASE WHEN len(work) = 0 THEN '未识别到工作经历' END, CASE WHEN len(education) = 0 THEN '未识别到教育经历' END,
    CASE WHEN contains(raw, '项目经历') AND len(project) = 0 THEN '项目经历标题存在但未成功分区' END], lambda y: y IS NOT NULL) AS warnings FROM p3),
p AS (SELECT *, CASE WHEN len(warnings) >= 2 THEN '较差' WHEN len(warnings) = 1 THEN '需复核' ELSE '正常' END AS quality FROM p4)"""
RANGES = (
    f"list_filter(list_transform(work, lambda y, i: {{'s': least({month(f'regexp_extract(y, {q(RANGE)}, 1)')}, {month(f'regexp_extract(y, {q(RANGE)}, 2)')}), 'i': i - 1,"
    f" 'e': greatest({month(f'regexp_extract(y, {q(RANGE)}, 1)')}, {month(f'regexp_extract(y, {q(RANGE)}, 2)')}), 'line': y}}), lambda z: {has('z.line', RANGE)})"
)
PERFECT = rf"100%|99%|98%|97%|96%|95%|增长至?{WS}*{D}+%|提升至?{WS}*{D}+%"
MAJORS = "[" + ", ".join(q(m) for m in lx.OTHER_MAJORS) + "]"
ALL_WORDS = "|".join(lx.STRONG_WORDS + lx.MODERATE_WORDS)
# the overlap as a comparison of every range with the latest end of the ranges before it
OVERLAP = (
    "list_first(list_transform(list_filter(range(2, len(sorted) + 1), lambda k: list_max(list_transform(list_slice(sorted, 1, k - 1), lambda z: z.e)) - sorted[k].s >= 3),"
    " lambda k: sorted[k].line))"
)


def finding(cond: str, dim: str, code: str, level: str, flag: str, ev: str) -> str:
    return f"CASE WHEN {cond} THEN {{'dimension': {q(dim)}, 'code': {q(code)}, 'level': {level}, 'flag': {flag}, 'evidence': left(coalesce({ev}, ''), 500)}} END"


FINDINGS = ",\n".join([
    finding("major IS NOT NULL AND NOT computing", "professional_match", "other_major", "1", "'专业“' || major || '”离数据岗位较远'", f"coalesce(nullif({evidence('raw', 'contains(y, major)')}, ''), left(edu, 180))"),
    finding("overlap IS NOT NULL", "timeline", "overlap", "1", "'任职时段重叠：' || left(overlap, 60)", "overlap"),
    finding(has("vt", lx.VAGUE_EMPLOYER), "vague_language", "vague_employer", "1", "'雇主只有笼统称呼'", f"coalesce(nullif({evidence('vt', has('y', lx.VAGUE_EMPLOYER))}, ''), regexp_extract(vt, {q(lx.VAGUE_EMPLOYER)}))"),
    finding(f"NOT {has('vt', lx.VAGUE_EMPLOYER)} AND {has('vt', lx.VAGUE_DUTY)}", "vague_language", "vague_duty", "1", "'职责只有笼统说法'", f"coalesce(nullif({evidence('vt', has('y', lx.VAGUE_DUTY))}, ''), regexp_extract(vt, {q(lx.VAGUE_DUTY)}))"),
    finding("len(perfect) > 3", "skill_exaggeration", "perfect_numbers", "1", "'近乎完美的数字共' || len(perfect) || '处'", evidence("raw", "len(list_filter(list_slice(perfect, 1, 5), lambda z: contains(y, z))) > 0")),
    finding("excess >= 6 AND years < 3", "skill_exaggeration", "overstated", "2", "years || '年经验，强词' || strong || '处，中等词' || moderate || '处'", evidence("raw", has("y", ALL_WORDS))),
    finding("NOT (excess >= 6 AND years < 3) AND excess >= 4 AND years < 5", "skill_exaggeration", "strong_wording", "1", "years || '年经验，强词' || strong || '处，中等词' || moderate || '处，项目含技术' || tech || '项'", evidence("raw", has("y", ALL_WORDS))),
    finding("len(work) = 0", "work_experience", "no_work", "1", "'没有识别出任职记录'", "coalesce(nullif(array_to_string(warnings, '；'), ''), left(raw, 180))"),
    finding("len(work) > 0 AND len(spans) = 0 AND length(clean) > 1500", "work_experience", "no_dates", "1", "'任职记录没有时段'", "array_to_string(list_slice(work, 1, 3), ' | ')"),
    finding("len(education) = 0", "education", "no_education", "0", "'没有识别出学历'", "left(raw, 180)"),
    finding(f"skill <> '' AND NOT {has('lower(skill)', lx.DATA_SKILLS)} AND (major IS NULL OR computing)", "professional_match", "no_data_skill", "1", "'技能中没有数据类关键词'", "array_to_string(list_slice(skills, 1, 3), ' | ')"),
])


def level_of(key: str) -> str:
    return f"coalesce(list_max(list_transform(list_filter(findings, lambda f: f.dimension = {q(key)}), lambda f: f.level)), 0)"


KEYS = [k for k, _ in lx.DIMENSIONS]
LABEL = "['低', '中', '高']"
SCREENED = f"""{PARSED}, s0 AS (SELECT *, {RANGES} AS spans, array_to_string(education, ' ') AS edu, array_to_string(skills, ' ') AS skill, lower(array_to_string(project, ' ')) AS projects,
  CASE WHEN len(work) > 0 THEN array_to_string(work, chr(10)) ELSE before END AS vt, regexp_extract_all(clean, {q(PERFECT)}) AS perfect,
  {' + '.join(times('clean', w) for w in lx.STRONG_WORDS)} AS strong, {' + '.join(times('clean', w) for w in lx.MODERATE_WORDS)} AS moderate FROM p),
s1 AS (SELECT *, list_sort(list_filter(spans, lambda z: NOT {PROJECT_LINE.replace('(y,', '(z.line,').replace('(y)', '(z.line)')})) AS sorted,
  list_first(list_filter({MAJORS}, lambda m: contains(left(clean, 500), m) OR contains(left(edu, 400), m))) AS major,
  {has('left(clean, 500)', lx.COMPUTING_MAJORS)} OR {has('left(edu, 400)', lx.COMPUTING_MAJORS)} AS computing,
  {' + '.join(f"contains(projects, {q(t)})::INTEGER" for t in lx.TECHNOLOGIES)} AS tech FROM s0),
s2 AS (SELECT *, CAST(coalesce(try_cast(translate({grab('clean', rf'({D}{{1,2}})[+]?{WS}*年(?:工作|经验)')}, '{WIDE}', '{NARROW}') AS INTEGER),
    coalesce(list_sum(list_transform(sorted, lambda z: z.e - z.s)), 0) // 12) AS INTEGER) AS years, {OVERLAP} AS overlap FROM s1),
s3 AS (SELECT *, 2 * greatest(0, strong - years // 2) + greatest(0, moderate - tech // 3) AS excess FROM s2),
s4 AS (SELECT *, list_filter([{FINDINGS}], lambda f: f IS NOT NULL) AS findings FROM s3),
s5 AS (SELECT *, {', '.join(f"{level_of(k)} AS {k}" for k in KEYS)} FROM s4),
s AS (SELECT *, CASE WHEN greatest({', '.join(KEYS)}) >= 2 THEN 2 WHEN greatest({', '.join(KEYS)}) = 1 OR len(list_distinct(list_transform(findings, lambda f: f.dimension))) >= 3 THEN 1 ELSE 0 END AS overall,
  coalesce(nullif(array_to_string(list_filter([{', '.join(f"CASE WHEN len(list_filter(findings, lambda f: f.dimension = {q(k)})) > 0 THEN {q(f'[{v}]')} || {LABEL}[{k}_of + 1] END" for k, v in lx.DIMENSIONS)}], lambda y: y IS NOT NULL), ';'), ''), '无明显风险点') AS summary
  FROM (SELECT *, {', '.join(f"{k} AS {k}_of" for k in KEYS)} FROM s5)),
f AS (SELECT doc_id, full_name, overall, unnest(findings) AS f, {', '.join(KEYS)} FROM s)"""  # fmt: skip
# a level column shadows the name of the section's list: lists are read before s5
SCREENED = SCREENED.replace("s5 AS (SELECT *, ", "s5 AS (SELECT * EXCLUDE (education), ", 1)


def w(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def lined(column: str) -> str:
    return w(PARSED, f"SELECT doc_id, CAST(len({column}) AS INTEGER) AS n, array_to_string({column}, chr(10)) AS lines FROM p WHERE len({column}) > 0")


SECTIONS = {"education": "es", "work_experience": "ws", "project_experience": "project", "skills": "ss"}
SECTION_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS section, {v} AS x FROM p0 WHERE len({v}) > 0" for k, v in SECTIONS.items())
DIM_NO = "CASE f.dimension " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KEYS)) + " END"
DIM_NAME = "CASE f.dimension " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.DIMENSIONS) + " END"
DIM_LEVEL = "CASE f.dimension " + " ".join(f"WHEN '{k}' THEN {k}" for k in KEYS) + " END"
ISSUE = "overall = 1 AND quality IN ('需复核', '较差')"
DISTRIBUTION = "SELECT v.level, count(s.doc_id) AS n, round(count(s.doc_id) / nullif(sum(count(s.doc_id)) OVER (), 0), 6) AS share FROM (VALUES (0, '低'), (1, '中'), (2, '高')) v(o, level) LEFT JOIN s ON s.overall = v.o GROUP BY v.level"
BY_DIMENSION = f"""SELECT dimension, n, CAST(row_number() OVER (ORDER BY n DESC, a, b) AS INTEGER) AS place FROM (
  SELECT dimension, count(*) AS n, min(doc_id) AS a, arg_min(k, (doc_id, k)) AS b FROM (SELECT doc_id, {DIM_NAME} AS dimension, {DIM_NO} AS k FROM f WHERE {DIM_LEVEL} = 1) GROUP BY dimension)"""

ORACLE_SQL: dict[str, str] = {
    "clean_text": w(RAW, "SELECT doc_id, raw AS raw_text FROM r"),
    "line_split": w(LINES, "SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l)"),
    "heading_normalize": w(LINES, f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, c[i] AS heading FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l) WHERE c[i] IN {inlist(lx.HEADINGS)}"),
    "section_extract": w(PARSED, f"SELECT doc_id, section, array_to_string(x, chr(10)) AS lines FROM ({SECTION_ROWS})"),
    "section_counts": w(PARSED, f"SELECT section, count(*) AS n_docs, CAST(sum(len(x)) AS BIGINT) AS n_lines FROM ({SECTION_ROWS}) GROUP BY section"),
    "name_resolve": w(PARSED, "SELECT doc_id, full_name AS name FROM p"),
    "name_in_text": w(PARSED, "SELECT doc_id, name_in_text FROM p"),
    "filename_name": w(DOCS, f"SELECT doc_id, coalesce({grab('filename', FILE_NAME)}, {sub('filename', '[.][^.]+$')}) AS file_name FROM d"),
    "age_extract": w(RAW, f"SELECT doc_id, {grab('raw', rf'({D}{{2}}){WS}*(?:岁|年龄)')} AS age, {grab('raw', rf'({D}{{1,2}})[+]?{WS}*年(?:工作|经验)')} AS work_years FROM r"),
    "experience_years": w(SCREENED, "SELECT doc_id, years FROM s"),
    "education_lines": lined("education"), "work_lines": lined("work"), "work_fallback": lined("inferred"), "project_lines": lined("project"), "skill_lines": lined("skills"),
    "text_before_project": w(PARSED, "SELECT doc_id, before AS text_before_project FROM p"),
    "parse_quality": w(PARSED, "SELECT doc_id, quality, array_to_string(warnings, ',') AS warnings, CAST(length(raw) AS INTEGER) AS text_length, CAST(len(work) AS INTEGER) AS work_experience_count, CAST(len(project) AS INTEGER) AS project_experience_count, CAST(len(education) AS INTEGER) AS education_count FROM p"),
    "date_token": w(LINES, f"SELECT doc_id, line_no, a AS start_token, CAST({month('a')} AS INTEGER) AS start_month, b AS end_token, CAST({month('b')} AS INTEGER) AS end_month FROM (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, regexp_extract(lines[i], {q(RANGE)}, 1) AS a, regexp_extract(lines[i], {q(RANGE)}, 2) AS b FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l) WHERE {has('lines[i]', RANGE)})"),
    "date_ranges": w(PARSED, f"SELECT doc_id, CAST(z.i AS INTEGER) AS line_no, CAST(z.s AS INTEGER) AS start_month, CAST(z.e AS INTEGER) AS end_month, z.line AS line FROM (SELECT doc_id, unnest({RANGES}) AS z FROM p)"),
    "timeline_overlap": w(SCREENED, "SELECT doc_id, overlap AS line FROM s WHERE overlap IS NOT NULL"),
    "project_timeline_filter": w(PARSED, f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, {PROJECT_LINE} AS is_project FROM (SELECT doc_id, i, work[i] AS y FROM (SELECT *, unnest(range(1, len(work) + 1)) AS i FROM p))"),
    "text_score": w(DOCS, f"""SELECT doc_id, CASE WHEN len(x) = 0 THEN -1.0::DOUBLE ELSE round(len(list_filter(x, lambda y: {has('y', '[一-龥A-Za-z]{3,}')})) * 50 + list_sum(list_transform(x, lambda y: length(y)))::DOUBLE / len(x) * 5
      + CASE WHEN {has('x[1]', '[一-龥]{2,4}')} THEN 50 ELSE 0 END - len(list_filter(x, lambda y: length(y) <= 2)) * 10, 6) END AS score
      FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), {q(ENDS)}), lambda y: {strip('y')}), lambda y: y <> '') AS x FROM d)"""),
    "evidence_search": w(RAW, f"SELECT doc_id, {evidence('raw', has('y', ALL_WORDS))} AS evidence FROM r"),
    **{name: w(SCREENED, f"SELECT doc_id, f.code AS code, CAST(f.level AS INTEGER) AS level, f.flag AS flag, f.evidence AS evidence FROM f WHERE f.code IN {inlist(codes)}") for name, codes in RULES.items()},
    "overall_risk": w(SCREENED, f"SELECT doc_id, CAST(overall AS INTEGER) AS overall, {', '.join(f'CAST({k} AS INTEGER) AS {k}' for k in KEYS)} FROM s"),
    "risk_summary": w(SCREENED, "SELECT doc_id, summary FROM s"),
    "skill_counts": w(SCREENED, "SELECT doc_id, CAST(strong AS INTEGER) AS strong, CAST(moderate AS INTEGER) AS moderate, CAST(tech AS INTEGER) AS technologies, CAST(excess AS INTEGER) AS excess FROM s"),
    "report_overview": w(SCREENED, f"SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS seq, doc_id, full_name AS name, file AS filename, CAST(length(raw) AS INTEGER) AS text_length, quality, {LABEL}[overall + 1] AS overall, {', '.join(f'{LABEL}[{k} + 1] AS {k}' for k in KEYS)}, summary FROM s"),
    "report_detail": w(SCREENED, f"SELECT doc_id, full_name AS name, {DIM_NAME} AS dimension, {LABEL}[{DIM_LEVEL} + 1] AS level, f.flag AS flag, f.evidence AS evidence FROM f"),
    "risk_distribution": w(SCREENED, DISTRIBUTION),
    **{name: w(SCREENED, f"SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS seq, full_name AS name, left(summary, 60) AS summary FROM s WHERE overall = {o}") for name, o in (("high_risk_list", 2), ("medium_risk_list", 1))},
    "quality_distribution": w(PARSED, "SELECT quality, count(*) AS n FROM p GROUP BY quality"),
    "medium_by_dimension": w(SCREENED, BY_DIMENSION),
    "medium_parse_issue": w(SCREENED, f"SELECT count(*) FILTER (WHERE {ISSUE}) AS medium_with_parse_issue FROM s"),
    "run_totals": w(SCREENED, "SELECT count(*) AS n, count(*) FILTER (WHERE overall = 2) AS high, count(*) FILTER (WHERE overall = 1) AS medium, count(*) FILTER (WHERE overall = 0) AS low FROM s"),
    "top_medium_candidates": w(SCREENED, "SELECT doc_id, full_name AS name, file AS filename, summary, quality FROM s WHERE overall = 1 ORDER BY CASE WHEN quality = '正常' THEN 0 ELSE 1 END, doc_id LIMIT 10"),
    "summary_stats": w(SCREENED, f"""SELECT 'risk_distribution' AS part, '{{' || string_agg('"' || level || '":' || n, ',' ORDER BY level) || '}}' AS value FROM ({DISTRIBUTION})
      UNION ALL SELECT 'parse_quality_distribution', '{{' || string_agg('"' || quality || '":' || n, ',' ORDER BY quality) || '}}' FROM (SELECT quality, count(*) AS n FROM s GROUP BY quality)
      UNION ALL SELECT 'medium_risk_by_dimension', '{{' || string_agg('"' || dimension || '":' || n, ',' ORDER BY dimension) || '}}' FROM ({BY_DIMENSION})
      UNION ALL SELECT 'medium_with_parse_issue', CAST(count(*) FILTER (WHERE {ISSUE}) AS VARCHAR) FROM s"""),
    "console_digest": w(SCREENED, "SELECT doc_id, ['🟢', '🟡', '🔴'][overall + 1] || ' ' || full_name || ' - ' || summary AS line FROM s"),
    "run_reply": w(SCREENED, f"""SELECT '共 ' || count(*) || ' 份；高风险 ' || count(*) FILTER (WHERE overall = 2) || '，中风险 ' || count(*) FILTER (WHERE overall = 1) || '，低风险 ' || count(*) FILTER (WHERE overall = 0)
      || '；解析正常 ' || count(*) FILTER (WHERE quality = '正常') || '，需复核 ' || count(*) FILTER (WHERE quality = '需复核') || '，较差 ' || count(*) FILTER (WHERE quality = '较差') || '；中风险中解析存疑 ' || count(*) FILTER (WHERE {ISSUE}) || '；主要中风险维度：' || coalesce((SELECT string_agg(dimension || ' ' || n, '、' ORDER BY place) FROM ({BY_DIMENSION})), '无') AS reply FROM s"""),
    "safe_stem": w(DOCS, rf"""SELECT doc_id, coalesce(nullif(trim({sub("CASE WHEN regexp_matches(b, '^.+[.][^.]+$') AND NOT regexp_matches(b, '^[.]+[^.]*$') THEN regexp_replace(b, '[.][^.]+$', '') ELSE b END", '[<>:"/\\|?*\x00-\x1f]+', '_')}, ' ._'), ''), 'document-' || doc_id) AS stem
      FROM (SELECT doc_id, list_last(string_split(coalesce(nullif(filename, ''), 'document-' || doc_id), '/')) AS b FROM d)"""),
}

# --- profile table -------------------------------------------------------------------------------
DEEP = strip(sub(sub(sub(sub("coalesce(text, '')", "[a-f0-9]{32,}"), f"([一-龥]){WS}+([一-龥])", r"\1\2"), f"([a-zA-Z0-9]){WS}+([a-zA-Z0-9])", r"\1\2"), r"\n{3,}", "\n"))
COMPANY = rf"{D}{{4}}[./-]{D}{{1,2}}[-~–]{D}{{4}}[./-]?{D}{{0,2}}[一-龥a-zA-Z0-9（）()]{{4,30}}(?:{lx.PROFILE_COMPANY_ENDS})"
START = f"{has('left(k[i], 8)', lx.PROFILE_SKILL_STARTS)} AND length(k[i]) < 20"
STOP = f"{has('left(k[i], 6)', lx.PROFILE_SKILL_STOPS)} AND length(k[i]) < 15"
SKILLS = f"list_transform(list_filter(range(1, len(k) + 1), lambda i: a IS NOT NULL AND i > a AND i < coalesce(z, len(k) + 1) AND NOT ({START}) AND length(k[i]) > 5), lambda i: k[i])"
X = f"""{DOCS}, x0 AS (SELECT *, {DEEP} AS t FROM d), x1 AS (SELECT *, string_split(t, chr(10)) AS lines FROM x0),
x2 AS (SELECT *, list_transform(lines, lambda y: {sub('y', WS + '+')}) AS k, list_transform(list_slice(lines, 1, 15), lambda y: left(y, 30)) AS top FROM x1),
x3 AS (SELECT *, list_min(list_filter(range(1, len(k) + 1), lambda i: {START})) AS a FROM x2),
x4 AS (SELECT *, list_min(list_filter(range(1, len(k) + 1), lambda i: i > a AND NOT ({START}) AND {STOP})) AS z FROM x3),
x AS (SELECT doc_id, replace(coalesce(filename, ''), '.pdf', '') AS 姓名,
  CASE WHEN len(list_filter(top, lambda y: contains(y, '男'))) > 0 THEN '男' WHEN len(list_filter(top, lambda y: contains(y, '女'))) > 0 THEN '女' ELSE '' END AS 性别,
  coalesce({grab('t', rf'年龄[：:{WSI}]*({D}{{2}})')}, {grab('left(t, 300)', rf'({D}{{2}}){WS}*岁')}, '') AS 年龄,
  coalesce({grab('t', rf'(?:工作|从业){WS}*年{WS}*限[：:{WSI}]*({D}+){WS}*年')} || '年', '') AS 工作年限,
  translate(regexp_extract(t, {q(rf'1[3-9]{D}[{WSI}-]?{D}{{4}}[{WSI}-]?{D}{{4}}')}), ' -', '') AS 手机,
  regexp_extract(t, {q(r'[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+')}) AS 邮箱,
  left({sub(f"regexp_extract(t, {q(rf'目标职能[：:{WSI}]*([^{chr(92)}n]{{5,40}})')}, 1)", WS + '+')}, 40) AS 目标岗位,
  coalesce(array_to_string(list_transform(list_slice(list_filter(k, lambda y, i: {has('y', lx.PROFILE_EDUCATION)} AND length(y) > 6 AND (i = 1 OR NOT {has('k[i - 1]', lx.PROFILE_NOT_AFTER)})), 1, 2), lambda y: left(y, 50)), ' | '), '') AS 学历信息,
  coalesce(array_to_string(list_transform(list_slice(list_filter(k, lambda y: {has('y', COMPANY)}), 1, 3), lambda y: left(y, 70)), ' | '), '') AS 工作经历,
  coalesce(array_to_string(list_transform(list_slice({SKILLS}, 1, 10), lambda y: left(y, 45)), ' '), '') AS 技能特长 FROM x4)"""
ORACLE_SQL |= {"deep_clean": w(X, "SELECT doc_id, t AS cleaned FROM x0"), "profile_summary": w(X, "SELECT * FROM x")}
ORACLE_SQL |= {name: w(X, f"SELECT doc_id, {column} AS value FROM x") for name, column in PROFILE.items()}

# --- earlier profile ------------------------------------------------------------------------------
LEGACY_EDUCATION = rf"{D}{{4}}{WS}*[-–至]{WS}*(?:{D}{{4}}|{D}{{2}})[年.]?{WS}*[一-龥]{{2,10}}(?:大学|学院|学校|研究生|硕士|博士|本科|大专|中专)"


def under(words: str, below: int, least: int, cut: int) -> str:
    """Lines after a heading and no empty line since, that are no heading themselves."""
    head = lambda i: f"({has(f'left(v[{i}], 8)', words)} AND length(v[{i}]) < {below})"
    last = lambda test: f"coalesce(list_max(list_filter(range(1, i), lambda j: {test})), 0)"
    empty = "v[j] = '' AND NOT " + head("j")
    return f"list_transform(list_filter(range(1, len(v) + 1), lambda i: NOT {head('i')} AND v[i] <> '' AND length(v[i]) > {least} AND {last(head('j'))} > {last(empty)}), lambda i: left(v[i], {cut}))"


SIX = [k for k in KEYS if k != "professional_match"]
LEGACY_NAMES = (
    f"姓{WS}*名[：:{WSI}]*([一-龥]{{2,4}})", rf"([一-龥]{{2,3}}){WS}{{1,3}}{D}{{3}}[-\p{{Nd}}]{{7,}}", f"^([一-龥]{{2,3}}){WS}+(?:个人简历|简历|求职)", rf"([一-龥]{{2,4}}){WS}{{0,3}}[_~\p{{Nd}}](?:{WS}|$)",
)
LEGACY_LINE_NAME = f"list_first(list_filter(list_transform(stripped, lambda y: coalesce({', '.join(grab('y', x) for x in LEGACY_NAMES)})), lambda y: y IS NOT NULL))"
LEGACY = f"""{DOCS}, v00 AS (SELECT *, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda y: {strip('y')}), lambda y: y <> '') AS stripped FROM d),
v01 AS (SELECT *, list_transform(stripped, lambda y: {strip(sub('y', '[~`();•–-]'))}) AS v FROM v00),
v0 AS (SELECT doc_id, v, coalesce(nullif(name, ''), {LEGACY_LINE_NAME}, {grab("left(array_to_string(v, ' '), 200)", '([一-龥]{2,4})')}, '未知') AS name FROM v01),
v1 AS (SELECT *, array_to_string(v, ' ') AS clean, list_transform(list_filter(v, lambda y: {has('y', LEGACY_EDUCATION)}), lambda y: left(y, 80)) AS education_lines,
  {under('工作经历|任职|职位|公司', 20, 10, 100)} AS work, {under('个人技能|专业技能|技术专长|擅长', 15, 0, 80)} AS skills FROM v0),
v2 AS (SELECT *, list_distinct(regexp_extract_all(clean, {q(f'201[5-9]|20[23]{D}')})) AS ys, len(regexp_extract_all(clean, {q(PERFECT.replace('至?', '了'))})) AS perfect, {' + '.join(times('clean', x) for x in lx.LEGACY_PHRASES)} AS phrases FROM v1),
v3 AS (SELECT *, list_transform(ys, lambda y: (length(clean) - length(replace(clean, y, ''))) // 4) AS counts FROM v2),
v4 AS (SELECT *, CASE WHEN len(ys) >= 4 AND list_max(counts) > 3 AND list_max(counts)::DOUBLE / list_min(counts) > 2 THEN 'year_counts' END AS c_timeline,
  CASE WHEN {has('clean', '某[知名大型热门]')} THEN 'vague_employer' WHEN {has('clean', r'[\p{L}\p{N}_]{2,4}互联网')} THEN 'broad_company' WHEN {has('clean', lx.VAGUE_DUTY)} THEN 'vague_duty' END AS c_vague,
  CASE WHEN perfect > 3 THEN 'perfect_numbers' END AS c_perfect, CASE WHEN phrases >= 6 THEN 'overstated' WHEN phrases >= 4 THEN 'strong_wording' END AS c_phrases,
  CASE WHEN len(work) = 0 THEN 'no_work' WHEN len(work) < 3 AND length(clean) > 1500 THEN 'few_lines' END AS c_work, CASE WHEN len(education_lines) = 0 THEN 'no_education' END AS c_education FROM v3),
v5 AS (SELECT *, 0 AS education, (c_work IS NOT NULL)::INTEGER AS work_experience, (c_timeline IS NOT NULL)::INTEGER AS timeline, 0 AS salary,
  greatest((c_perfect IS NOT NULL)::INTEGER, CASE c_phrases WHEN 'overstated' THEN 2 WHEN 'strong_wording' THEN 1 ELSE 0 END) AS skill_exaggeration, (c_vague IS NOT NULL)::INTEGER AS vague_language FROM v4),
v6 AS (SELECT *, greatest({', '.join(SIX)}) AS top, list_filter([CASE WHEN c_education IS NOT NULL THEN '[education]' || {LABEL}[education + 1] END, CASE WHEN c_work IS NOT NULL THEN '[work_experience]' || {LABEL}[work_experience + 1] END,
  CASE WHEN c_timeline IS NOT NULL THEN '[timeline]' || {LABEL}[timeline + 1] END, CASE WHEN c_perfect IS NOT NULL OR c_phrases IS NOT NULL THEN '[skill_exaggeration]' || {LABEL}[skill_exaggeration + 1] END,
  CASE WHEN c_vague IS NOT NULL THEN '[vague_language]' || {LABEL}[vague_language + 1] END], lambda y: y IS NOT NULL) AS flagged FROM v5),
v AS (SELECT *, CASE WHEN top >= 2 THEN 2 WHEN top = 1 OR len(flagged) >= 3 THEN 1 ELSE 0 END AS overall, coalesce(nullif(array_to_string(flagged, '；'), ''), '无明显风险点') AS summary FROM v6)"""
LEGACY_FINDINGS = " UNION ALL ".join(
    f"SELECT doc_id, '{dim}' AS dimension, {col} AS code, CAST({lvl} AS INTEGER) AS level FROM v WHERE {col} IS NOT NULL"
    for dim, col, lvl in (
        ("timeline", "c_timeline", "1"), ("vague_language", "c_vague", "1"), ("skill_exaggeration", "c_perfect", "1"),
        ("skill_exaggeration", "c_phrases", "CASE c_phrases WHEN 'overstated' THEN 2 ELSE 1 END"), ("work_experience", "c_work", "1"), ("education", "c_education", "0"),
    )
)
ORACLE_SQL |= {
    "legacy_clean": w(LEGACY, "SELECT doc_id, clean AS clean_text FROM v1"),
    "legacy_sections": w(LEGACY, " UNION ALL ".join(f"SELECT doc_id, '{k}' AS section, CAST(len({c}) AS INTEGER) AS n, array_to_string({c}, chr(10)) AS lines FROM v1 WHERE len({c}) > 0" for k, c in (("education", "education_lines"), ("work_experience", "work"), ("skills", "skills")))),
    "legacy_findings": w(LEGACY, LEGACY_FINDINGS),
    "legacy_overview": w(LEGACY, f"SELECT doc_id, name, {LABEL}[overall + 1] AS overall, {', '.join(f'{LABEL}[{k} + 1] AS {k}' for k in SIX)}, summary FROM v"),
    "legacy_totals": w(LEGACY, f"SELECT {LABEL}[overall + 1] AS level, count(*) AS n FROM v GROUP BY 1"),
}
ORACLE_SQL |= {
    "path_prune": w(DOCS, """SELECT doc_id, path FROM (SELECT doc_id, '/data/' || CASE doc_id % 5 WHEN 0 THEN 'x_Extraction_debug' WHEN 1 THEN '__pycache__' ELSE 'in' END || '/' ||
      CASE doc_id % 7 WHEN 0 THEN '~$' WHEN 1 THEN '风险评估报告-' ELSE '' END || filename AS path FROM d) WHERE doc_id % 5 > 1 AND doc_id % 7 > 1
      AND lower(regexp_extract(path, '[.][^.]*$')) IN ('.pdf', '.docx', '.doc', '.xlsx', '.xls', '.txt') AND NOT regexp_matches(regexp_replace(path, '[.][^.]+$', ''), '风险评估报告|resume_risk_report|推荐表')"""),
    "json_input": w(DOCS, "SELECT doc_id, coalesce(text, '') AS text, name, filename FROM d"),
}

# Texts beside the table's, so that the rules on wording and numbers have something to find (the queries add the same ones).
MADE = "\n UNION ALL ".join(
    f"SELECT {i} AS doc_id, {q(t)} AS text, '周小舟' AS name, 'a.pdf' AS filename"
    for i, t in (
        (-1, "工作经历\n2019.01-2021.06 某知名公司 数据工程师\n负责公司相关数据工作\n教育经历\n2010.09-2014.06 青石大学 计算机 本科"),
        (-2, "工作经历\n2019.01-2021.06 青石科技有限公司 数据工程师\n负责部门业务\n准确率达到99%，覆盖100%，提升至95%，增长至 96%，另有97%"),
        (-3, "工作经历\n2019.01-2021.06 青石科技有限公司 数据工程师\n覆盖100%，留存99%，准确率98%"),
        (-4, "项目经历\n某大型互联网企业项目\n增长至30%，提升至 40%，提升50%，增长20%，98%，97%"),
    )
)
for _name in ("rule_vague", "rule_perfect_numbers"):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace(DOCS, DOCS[:-1] + f" UNION ALL {MADE})", 1)
