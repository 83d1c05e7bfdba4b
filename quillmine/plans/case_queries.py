"""Operators whose inputs no table has: cases of all kinds, dealt over the documents, so that the work grows with them. The SQL computes over the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmine.functions import fixed, text
from quillmine.functions.config import Settings
from quillmine.operators import answers, crawling, indexing, records, retrieval, versions
from quillmine.plans.common import dealt_cases, dealt_values, literal, table, values
from quillmine.sources.shipping import ship


def _cases(spark, rows, schema):
    ship(spark)
    return spark.createDataFrame(rows, schema)


_TITLES = ["2023至24", "2023-24", "2022-23 and thereafter", "2020至21年度至2024至25", "2020至21年度及以后", "2021至22、2022至23", "none", ""]
TITLES = [(k, title, year) for k, (title, year) in enumerate((t, y) for t in _TITLES for y in (2019, 2022, 2023, 2024))]


def year_applicability(spark, sf_dir):
    return dealt_cases(spark, sf_dir, TITLES, "case_id long, title string, year int", "case_id").select("case_id", versions.applies_to_year(F.col("title"), F.col("year")).alias("applies"))


LISTED = [
    ("m", 1, "2020至21及以后", "u1"), ("m", 2, "2023至24", "u2"), ("m", 3, "2021至22及以后", "u3"), ("n", 1, "2021至22及以后", "v1"), ("n", 2, "2020至21及以后", "v2"),
    ("o", 1, "2019至20", "w1"), ("p", 1, "2023至24", "x1"), ("p", 2, "2023-24", "x2"),
]


def document_choice(spark, sf_dir):
    rows = dealt_cases(spark, sf_dir, LISTED, "major string, ordinal int, title string, url string", "major")
    return versions.choose_document(rows, F.lit(2023), ["major"]).select("major", "title", "url")


DOWNLOADS = [(1, None, False, None), (2, "a", True, None), (3, "a", False, "%PDF-1.7"), (4, "a", False, "<html>"), (5, None, True, "%PDF-1.7")]


def download_status(spark, sf_dir):
    rows = dealt_cases(spark, sf_dir, DOWNLOADS, "case_id long, title string, on_disk boolean, body string", "case_id")
    dry = versions.crawl_status(F.col("title"), F.col("on_disk"), dry_run=True)
    return rows.select("case_id", versions.crawl_status(F.col("title"), F.col("on_disk"), content=F.col("body")).alias("status"), dry.alias("dry_status"))


ASKED = [(1, "Library hours"), (2, "bios"), (3, "图书馆在哪"), (4, "Which credits does the LIBRARY card need"), (5, "本科生的奖学金"), (6, "libraryx"), (7, "")]


def question_variants(spark, sf_dir):
    prepared = retrieval.prepare(dealt_cases(spark, sf_dir, ASKED, "qid long, text string", "qid"), Settings())
    return retrieval.variants(prepared).select("qid", F.col("vno").cast("long").alias("vno"), "text")


COURSE_ROWS = [
    (0, "CSC3160", "s.pdf", "4", "CSC3160"), (1, "CSC3160", "s.pdf", "5", "CSC3160 Operating Systems 3"), (2, "CSC3160", "s.pdf", "6", "CSC3160 Operating Systems 3"),
    (3, "MAT1001", "s.pdf", "5", "MAT1001 Calculus 3"), (4, "MAT1001", "t.pdf", "2", "MAT1001 Calculus 3"), (5, "MAT1001", "t.pdf", "3", "MAT1001 Calculus"), (6, "PHY1001", "t.pdf", "3", " PHY1001 Mechanics 4.5 "),
]
COURSE_QUESTIONS = [(1, "what about csc 3160?"), (2, "MAT1001 and CSC3160"), (3, "phy1001"), (4, "no code"), (5, "XMAT10012")]


def catalogue_lookup(spark, sf_dir):
    prepared = retrieval.prepare(dealt_cases(spark, sf_dir, COURSE_QUESTIONS, "qid long, text string", "qid"), Settings())
    rows = _cases(spark, COURSE_ROWS, "ordinal long, course_code string, source_document string, page string, excerpt string")
    return retrieval.catalogue_hits(prepared, rows, 2).select("qid", F.col("rank").cast("long").alias("rank"), "document", "page", "text", "source_type")


PROGRAMMES = [("金融学_适用于2022至23年度入学学生.pdf",), ("金融学_适用于2023至24年度入学学生.pdf",), ("国际金融学_适用于2023至24年度入学学生.pdf",), ("Data Science_适用于2023至24年度入学学生.pdf",), ("手册.pdf",), ("金融学_适用于2023至24年度入学学生.txt",)]
PROGRAMME_QUESTIONS = [(1, "金融学要多少学分"), (2, "国际金融学要多少学分"), (3, "How many credits does data  science need"), (4, "手册"), (5, "金融")]


def named_programmes(spark, sf_dir):
    prepared = retrieval.prepare(dealt_cases(spark, sf_dir, PROGRAMME_QUESTIONS, "qid long, text string", "qid"), Settings())
    return retrieval.target_documents(prepared, _cases(spark, PROGRAMMES, "document string")).select("qid", "document")


NAMES = [(1, "registry "), (2, "图书馆"), (3, "x"), (4, ""), (5, None), (6, "LIBRARY"), (7, " Graduate School"), (8, "学生事务处")]


def departments(spark, sf_dir):
    found = text.bilingual_department(F.col("name"))
    return dealt_cases(spark, sf_dir, NAMES, "case_id long, name string", "case_id").select("case_id", found.zh.alias("zh"), found.en.alias("en"))


FILES = [(1, "a%20b+c.pdf"), (2, "x/y\\z:?."), (3, "50%25"), (4, " .a. "), (5, "%E9%87%91%E8%9E%8D.pdf"), (6, '<a>|"b"*'), (7, "")]


def file_names(spark, sf_dir):
    return dealt_cases(spark, sf_dir, FILES, "case_id long, name string", "case_id").select("case_id", text.safe_filename(F.col("name")).alias("file"))


#: Full-width and ligature forms, traditional characters, split course codes and blanks of several kinds.
FORMS = [(1, "ＣＳＣ ３１６０"), (2, "oﬃce　hours"), (3, "圖書館 開放時間"), (4, "Csc  3160\tand MAT t 1001"), (5, " Plain Text "), (6, ""), (7, None)]


def search_forms(spark, sf_dir):
    rows = dealt_cases(spark, sf_dir, FORMS, "case_id long, text string", "case_id").select("case_id", text.search_text(F.col("text")).alias("form"), text.tokens(F.col("text")).alias("tokens"))
    return rows.select("case_id", "form", F.array_join("tokens", "|").alias("tokens"))


CITED = [
    (1, 1, "guide.pdf", 3, None, "Open at nine 【guide.pdf，第 3 页】."), (1, 2, "guide.pdf", 4, None, "Open at nine 【guide.pdf，第 3 页】."),
    (2, 1, "site", None, "Hours", "See 【site，Hours】"), (2, 2, "site", None, None, "See 【site，Hours】"), (3, 1, "a.pdf", 1, "S", "no label"), (4, 1, "a.pdf", 1, "S", None),
]


def cited_evidence(spark, sf_dir):
    rows = dealt_cases(spark, sf_dir, CITED, "qid long, rank int, document string, page int, section string, answer string", "qid")
    kept = answers.cited(rows.select("qid", "answer").distinct(), rows.drop("answer"))
    return kept.select("qid", F.col("rank").cast("long").alias("rank"), answers.citation_label(F.col("document"), F.col("page"), F.col("section")).alias("label"))


#: Lengths of a question, its number of turns, the role and the length of each turn's text.
REQUESTS = [(1, 1, 0, "user", 1), (2, 0, 0, "user", 1), (3, 2000, 10, "assistant", 4000), (4, 2001, 0, "user", 1), (5, 5, 11, "user", 1), (6, 5, 1, "system", 1), (7, 5, 1, "user", 0), (8, 5, 2, "user", 4001), (9, None, 0, "user", 1)]


def request_validation(spark, sf_dir):
    rows = dealt_cases(spark, sf_dir, REQUESTS, "case_id long, chars int, turns int, role string, size int", "case_id")
    turn = F.struct("role", F.repeat(F.lit("x"), F.col("size")).alias("content"))
    requests = rows.select("case_id", F.repeat(F.lit("q"), F.col("chars")).alias("question"), F.array_repeat(turn, F.col("turns")).alias("history"))
    good, bad = answers.valid_requests(requests)
    return good.select("case_id", F.lit(True).alias("accepted")).unionByName(bad.select("case_id", F.lit(False).alias("accepted")))


ROBOTS = [(k, url, status, rules) for k, (url, status, rules) in enumerate((u, s, r) for u in ("/a/x", "/b") for s, r in ((200, "/a"), (204, "/"), (200, None), (404, "/a"), (503, "/a"), (None, "/a"), (301, "/a")))]


def robots_verdicts(spark, sf_dir):
    rows = dealt_cases(spark, sf_dir, ROBOTS, "case_id long, path string, status int, denied string", "case_id")
    rules = F.when(F.col("denied").isNotNull(), F.concat(F.lit("User-agent: *\nDisallow: "), "denied"))
    return rows.select("case_id", crawling.robots_allow(F.concat(F.lit("https://s.edu"), "path"), F.col("status"), rules).alias("allowed"))


SCHEMES = [
    ("s.pdf", "/d/study_schemes/s.pdf", 1, "Course Code list\nCSC3160 Operating\n Systems 3,\nMAT1001 Calculus 3"), ("s.pdf", "/d/study_schemes/s.pdf", 2, "Course code CSC3160 Operating Systems 3,"),
    ("s.pdf", "/d/study_schemes/s.pdf", 3, "II. Core PHY1001 Physics 4; none" + " x" * 130 + " CHM1001 far"), ("o.pdf", "/d/other/o.pdf", 1, "Course Code CSC9999 X 3"), ("e.pdf", "/d/study_schemes/e.pdf", 1, ""),
]


def scheme_courses(spark, sf_dir):
    rows = dealt_cases(spark, sf_dir, [(0, *r) for r in SCHEMES], "owner long, document string, source_path string, page int, text string", "owner")
    return records.course_catalogue(rows.withColumn("document", F.concat_ws("-", "owner", "document")))


def web_chunk_ids(spark, sf_dir):
    """Addresses of the pages, with the hash of the page's bytes for the hash of its content."""
    return table(spark, sf_dir, "pages").select("page_id", indexing.web_chunk_id(F.col("url"), F.sha2("html", 256), F.lit(2)).alias("chunk_id"))


_REPLY = "Nine o'clock. 【手册.pdf，第 2 页】"
ANSWERED = [(1, "When does it open"), (2, "When does it close"), (3, "How many credits is CSC3160"), (4, "introduce databases"), (5, "几点开门"), (6, "study plan for algebra")]
#: Of 2 the item isn't cited by the reply, 3 has a row of the catalogue.
FOUND = [(1, 1, "手册.pdf", 2, "Opens at nine.", "pdf"), (2, 1, "other.pdf", 1, "Closes.", "pdf"), (3, 1, "s.pdf", 5, "CSC3160 Operating Systems 3", "course_catalog"), (6, 1, "手册.pdf", 2, "Algebra.", "pdf")]


def answer_routes(spark, sf_dir):
    """Answers of a model that always replies the same."""
    evidence = dealt_cases(spark, sf_dir, FOUND, "qid long, rank int, document string, page int, text string, source_type string", "qid", [q for q, _ in ANSWERED])
    evidence = evidence.select("*", F.lit(1.0).alias("score"), *(F.lit(None).cast("string").alias(c) for c in ("source_url", "section", "department", "crawled_at")))
    out = answers.answer(dealt_cases(spark, sf_dir, ANSWERED, "qid long, text string", "qid"), evidence, lambda prompt: F.concat(F.substring(prompt, 1, 0), F.lit(_REPLY)))
    return out.select("qid", "answer", F.size("sources").cast("long").alias("n_sources"), "grounded", "answer_mode", "disclaimer")


QUERIES = {
    f.__name__: f
    for f in (
        year_applicability, document_choice, download_status, question_variants, catalogue_lookup, named_programmes, departments, file_names, search_forms, cited_evidence, request_validation,
        robots_verdicts, scheme_courses, web_chunk_ids, answer_routes,
    )
}

_YEARS = "(20\\d{2})\\s*(?:至|-)\\s*(?:20)?\\d{2}"
_CITE = "'【' || document || case when page is not null then '，第 ' || page || ' 页' when coalesce(section, '') <> '' then '，' || section else '' end || '】'"
_SYNONYMS = [(g, m, word, word.lower()) for g, group in enumerate(fixed.SYNONYM_GROUPS) for m, word in enumerate(group)]
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_OLD, _NEW = "".join(fixed.TRADITIONAL), "".join(fixed.TRADITIONAL.values())


def _joined(form: str) -> str:
    form = f"regexp_replace({form}, '\\b([a-z]{{2,4}})\\s*t\\s*(\\d{{4}}[a-z]?)\\b', '\\1t\\2', 'g')"
    return f"regexp_replace({form}, '\\b([a-z]{{2,4}})\\s+(\\d{{4}}[a-z]?)\\b', '\\1\\2', 'g')"


SQL = {
    "year_applicability": f"""
with c as (select *, regexp_extract_all(title, '{_YEARS}', 1) as starts, regexp_extract(title, '{_YEARS}\\s*年度?\\s*(?:至|to)\\s*{_YEARS}', ['low', 'high']) as span from {dealt_values(TITLES, 'case_id, title, year', 'case_id')})
select case_id::bigint as case_id, coalesce(year between try_cast(span.low as int) and try_cast(span.high as int), false) or list_contains(starts, year::varchar)
  or (len(starts) > 0 and regexp_matches(title, '及以后|或以后|之后|thereafter') and year >= coalesce(try_cast(starts[-1] as int), 9999)) as applies from c""",
    "document_choice": f"""
select major, title, url from {dealt_values(LISTED, 'major, ordinal, title, url', 'major')}
where title like '2023%' or (title like '%及以后' and left(title, 4)::int <= 2023)
qualify row_number() over (partition by major order by title not like '%及以后' desc, ordinal desc) = 1""",
    "download_status": f"""
select case_id::bigint as case_id, case when title is null then 'not_found' when on_disk then 'skipped' when starts_with(body, '%PDF') then 'downloaded' else 'failed' end as status,
  case when title is null then 'not_found' else 'selected' end as dry_status from {dealt_values(DOWNLOADS, 'case_id, title, on_disk, body', 'case_id')}""",
    "question_variants": f"""
with q as (select * from {dealt_values(ASKED, 'qid, text', 'qid')}),
s as (select * from {values(_SYNONYMS, 'g, m, word, form')}),
hit as (select distinct qid, g from q, s where regexp_matches(lower(text), '(^|[^a-z0-9])' || form || '($|[^a-z0-9])')),
parts as (select qid, -1 as g, 0 as m, text from q union all select qid, g, m, word from hit join s using (g)),
firsts as (select * from parts qualify row_number() over (partition by qid, text order by g, m) = 1)
select qid::bigint as qid, row_number() over (partition by qid order by g, m) - 1 as vno, text from firsts""",
    "catalogue_lookup": f"""
with asked as (select distinct qid, unnest(regexp_extract_all(upper({_joined('lower(text)')}), '\\b[A-Z]{{2,4}}\\d{{4}}[A-Z]?\\b')) as course_code from {dealt_values(COURSE_QUESTIONS, 'qid, text', 'qid')}),
c as (select ordinal, course_code, source_document as document, page::int as page, trim(excerpt) as text from {values(COURSE_ROWS, 'ordinal, course_code, source_document, page, excerpt')}),
hits as (
  select * from asked join c using (course_code) where regexp_matches(text, '\\s\\d+(\\.\\d+)?$') and length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > length(course_code)
  qualify row_number() over (partition by qid, course_code, document, text order by ordinal) = 1
)
select qid::bigint as qid, row_number() over (partition by qid order by ordinal) as rank, document, page, text, 'course_catalog' as source_type from hits qualify rank <= 2""",
    "named_programmes": f"""
with p as (select document, lower(split_part(document, '_适用于', 1)) as programme from {values(PROGRAMMES, 'document')} where document like '%适用于%.pdf')
select qid::bigint as qid, document from {dealt_values(PROGRAMME_QUESTIONS, 'qid, text', 'qid')} join p on contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), programme)
qualify rank() over (partition by qid order by length(programme) desc) = 1""",
    "departments": f"""
select case_id::bigint as case_id, case when name <> '' then coalesce(d.zh, trim(name)) end as zh, d.en from {dealt_values(NAMES, 'case_id, name', 'case_id')}
left join (select * from {values(list(fixed.DEPARTMENTS), 'zh, en')}) d on lower(trim(name)) in (d.zh, lower(d.en))""",
    "file_names": f"""
select case_id::bigint as case_id, regexp_replace(regexp_replace(url_decode(name), '[/\\\\:*?"<>|]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') as file from {dealt_values(FILES, 'case_id, name', 'case_id')}""",
    "search_forms": f"""
with f as (select case_id, lower(replace(replace(translate(text, '{_WIDE.replace("'", "''")}', '{_ASCII.replace("'", "''")}'), 'ﬃ', 'ffi'), '　', ' ')) as low from {dealt_values(FORMS, 'case_id, text', 'case_id')}),
g as (select case_id, trim(regexp_replace(translate({_joined('low')}, '{_OLD}', '{_NEW}'), '\\s+', ' ', 'g')) as form from f),
h as (select *, regexp_extract_all(form, '[一-鿿]') as cjk from g)
select case_id::bigint as case_id, form, array_to_string(regexp_extract_all(form, '[a-z0-9]{{2,}}') || cjk || [cjk[i] || cjk[i + 1] for i in range(1, len(cjk))], '|') as tokens from h""",
    "cited_evidence": f"select qid::bigint as qid, rank::bigint as rank, {_CITE} as label from {dealt_values(CITED, 'qid, rank, document, page, section, answer', 'qid')} where contains(answer, {_CITE})",
    "request_validation": f"""
select case_id::bigint as case_id, coalesce(chars between 1 and 2000, false) and turns <= 10 and (turns = 0 or (role in ('user', 'assistant') and size between 1 and 4000)) as accepted
from {dealt_values(REQUESTS, 'case_id, chars, turns, role, size', 'case_id')}""",
    "robots_verdicts": f"""
select case_id::bigint as case_id, case when status between 200 and 299 then not coalesce(starts_with(path, denied), false) else coalesce(status between 400 and 499, false) end as allowed
from {dealt_values(ROBOTS, 'case_id, path, status, denied', 'case_id')}""",
    "scheme_courses": f"""
with s as (
  select document, page, text, string_split(regexp_replace(text, '\\b([A-Z]{{2,4}}\\d{{4}}[A-Z]?)\\b', chr(1) || '\\1', 'g'), chr(1)) as parts from (select owner || '-' || document as document, source_path, page, text from {dealt_values([(0, *r) for r in SCHEMES], 'owner, document, source_path, page, text', 'owner')})
  where list_contains(string_split(source_path, '/'), 'study_schemes')
),
c as (select document, page, text, i, parts[i + 1] as part, right(array_to_string(parts[1:i], ''), 40) as before from s, unnest(range(1, len(parts))) as u(i)),
d as (select *, regexp_extract(part, '^[A-Z]{{2,4}}\\d{{4}}[A-Z]?') as code from c where contains(lower(text), 'course code') or regexp_matches(before, '\\b(I{{1,3}}|IV)\\.'))
select code as course_code, document as source_document, max(page)::varchar as page, trim(regexp_replace(code || ' ' || substr(part, length(code) + 1, 220), '\\s+', ' ', 'g'), ' ,;:') as excerpt from d group by 1, 2, 4""",
    "web_chunk_ids": "select page_id, sha256('web:' || url || ':' || sha256(html) || ':2') as chunk_id from pages",
    "answer_routes": f"""
with a as (
  select qid, text as question, case when regexp_matches(text, '(?i){fixed.LEARNING_PATTERN}') then '{fixed.LEARNING_PLAN}' when regexp_matches(text, '(?i){fixed.COURSE_PATTERN}') then '{fixed.COURSE_EXPLANATION}' else '{fixed.OFFICIAL_FACT}' end as mode,
    case when regexp_matches(text, '[A-Za-z]') then 'en' else 'zh' end as language from {dealt_values(ANSWERED, 'qid, text', 'qid')}
),
e as (select *, '【' || document || '，第 ' || page || ' 页】' as label from {dealt_values(FOUND, 'qid, rank, document, page, text, source_type', 'qid', [q for q, _ in ANSWERED])}),
r as (
  select a.*, label, mode = '{fixed.OFFICIAL_FACT}' as fact, e.text as body, source_type from a left join e using (qid)
),
s as (select *, case when fact and label is null then null when fact and source_type = 'course_catalog' then split_part(body, ' ', 1) || ' is ' || substr(body, length(split_part(body, ' ', 1)) + 2) || ' ' || label else {literal(_REPLY)} end as draft from r),
t as (select *, coalesce(contains(draft, label), false) as shown from s)
select qid::bigint as qid, case when draft is null or (fact and not shown) then case language when 'en' then {literal(fixed.REFUSALS['en'])} else '{fixed.REFUSALS['zh']}' end else draft end as answer,
  shown::int::bigint as n_sources, not (draft is null or (fact and not shown)) as grounded, mode as answer_mode,
  case when mode = '{fixed.COURSE_EXPLANATION}' then '{fixed.DISCLAIMERS[fixed.COURSE_EXPLANATION]}' when mode = '{fixed.LEARNING_PLAN}' then '{fixed.DISCLAIMERS[fixed.LEARNING_PLAN]}' end as disclaimer from t""",
}
