"""The engine's registered queries, each with the SQL that DuckDB runs on the same tables.

A query is a function (spark, sf_dir) -> DataFrame. ``@query(sql)`` registers it under its name; without SQL it has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import geometry as geo
from vellum.functions import strings as st
from vellum.operators import audit, edits, forms, layout, search
from vellum.operators import pages as pg
from vellum.plans import grid
from vellum.plans.paged import Paged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text functions -------------------------------------------------------------------------------------------------------------

WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MARK = r"\x{0300}-\x{036F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}"
MARKS = MARK + r"\x{FE00}-\x{FE0F}\x{200D}\x{200C}\x{FEFF}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_upper(x: str) -> str:
    return f"translate({x}, {lit(st.UPPER_FROM)}, {lit(st.UPPER_TO)})"


def sql_lower(x: str) -> str:
    return f"translate({x}, {lit(st.LOWER_FROM)}, {lit(st.LOWER_TO)})"


def sql_plain(x: str) -> str:
    return f"translate(regexp_replace({x}, '[{MARKS}]', '', 'g'), {lit(st.ACCENTS_FROM)}, {lit(st.ACCENTS_TO)})"


#: texts with what the documents lack: marks, Unicode spaces, carriage returns, Extended-A, long s
SAMPLES = ["héllo wörld", "   café　", "a\r\nb\n\nc\rd", "ſtraße İıłŁ", "́̂x", "", "  ", "hELLO wORLD", "Ærø Þð Ÿÿ", "abcdéf", "abc‍d"]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the samples, under negative ids."""
    extra = spark.range(len(SAMPLES)).select((-F.col("id") - 1).alias("doc_id"), F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("id") + 1).cast("int")).alias("text"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra)


def sql_char(s: str) -> str:
    return "''" if not s else " || ".join(f"chr({ord(c)})" if not 32 <= ord(c) < 127 else lit(c) for c in s)


TEXTS = "t as (select doc_id, text from documents union all values " + ", ".join(f"({-k - 1}, {sql_char(s)})" for k, s in enumerate(SAMPLES)) + ")"


def scalar(sql: str, build) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return texts(spark, sf_dir).select("doc_id", build(F.col("text")).alias("v"))

    run.sql = f"with {TEXTS} select doc_id, {sql} v from t"
    return run


TITLE = f"array_to_string(list_transform(regexp_extract_all(text, '[^{WS}]+|[{WS}]+'), lambda w: {sql_upper('w[1]')} || {sql_lower('w[2:]')}), '')"
SCALARS = {
    "count_code_points": scalar("length(text)::bigint", st.count_code_points),
    "count_words": scalar(f"len(regexp_extract_all(text, '[^{WS}]+'))::bigint", st.count_words),
    "split_lines": scalar(r"array_to_string(string_split_regex(text, '\r\n|\n|\r'), '|')", lambda c: F.array_join(st.split_lines(c), "|")),
    "to_upper_latin": scalar(sql_upper("text"), st.to_upper),
    "to_lower_latin": scalar(sql_lower("text"), st.to_lower),
    "title_case": scalar(TITLE, st.title_case),
    "remove_diacritics": scalar(sql_plain("text"), st.remove_diacritics),
    "strip_marks": scalar(f"regexp_replace(text, '[{MARKS}]', '', 'g')", st.strip_marks),
    "trim_whitespace": scalar(f"regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g')", st.trim_whitespace),
    "is_whitespace": scalar(f"regexp_full_match(text, '[{WS}]*')", st.is_whitespace),
    "truncate_text": scalar(f"case when length(text) <= 4 then text else regexp_replace(text[1:5], '(?s)([^{MARKS}][{MARKS}]*|[{MARKS}]+)$', '') || '...' end", lambda c: st.truncate(c, 4)),
    "grapheme_clusters": scalar(f"len(regexp_extract_all(text, '(?s).[{MARK}]*'))::bigint", lambda c: F.size(st.grapheme_clusters(c)).cast("bigint")),
    "language_tag_valid": scalar(r"regexp_full_match(split_part(text, ' ', 1), '[A-Za-z0-9]{1,8}(-[A-Za-z0-9]{1,8})*')", lambda c: st.valid_language_tag(F.split_part(c, F.lit(" "), F.lit(1)))),
}
for _name, _f in SCALARS.items():
    QUERIES[_name], SQL[_name] = _f, _f.sql


@query("select p_partkey, p_size || '.' as dec, case when p_size <= 26 then chr(64 + p_size) else chr(64 + (p_size - 1) // 26) || chr(65 + (p_size - 1) % 26) end || '.' alpha, ['', 'x', 'xx', 'xxx', 'xl', 'l'][p_size // 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][p_size % 10 + 1] || '.' roman, '•' bullet from part")
def number_label(spark, sf_dir):
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", st.number_label("decimal", n).alias("dec"), st.number_label("upper_alpha", n).alias("alpha"), st.number_label("lower_roman", n).alias("roman"), st.number_label("bullet", n).alias("bullet"))


@query(r"""with a as (select doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+')) x from documents), p as (select a.doc_id, a.x, b.x y from a join a b on b.doc_id = a.doc_id + 1)
select doc_id, round(case when len(x) = 0 and len(y) = 0 then 1.0 when len(x) = 0 or len(y) = 0 then 0.0 else len(list_intersect(x, y))::double / len(x) end, 9) overlap from p""")
def token_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pair = d.select("doc_id", "text").join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    return pair.select("doc_id", F.round(st.token_overlap(F.col("text"), F.col("other")), 9).alias("overlap"))


@query("with t as (select p_partkey, '<</MCID ' || p_partkey || ' /X 1>>' a, '/MCID 99999999999' b, '/Lang (x)' c from part) select p_partkey, nullif(regexp_extract(a, '/MCID\\s*(\\d+)', 1), '')::int mcid, try_cast(nullif(regexp_extract(b, '/MCID\\s*(\\d+)', 1), '') as int) big, try_cast(nullif(regexp_extract(c, '/MCID\\s*(\\d+)', 1), '') as int) none from t".replace("\\\\", "\\"))
def parse_mcid(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", st.parse_mcid(F.concat(F.lit("<</MCID "), F.col("p_partkey").cast("string"), F.lit(" /X 1>>"))).alias("mcid"), st.parse_mcid(F.lit("/MCID 99999999999")).alias("big"), st.parse_mcid(F.lit("/Lang (x)")).alias("none"))


@query("""with p as (select p_partkey, p_type || '(a#b)' || chr(92) || chr(10) || 'é' s from part)
select p_partkey, '/' || replace(replace(replace(replace(replace(replace(s, '#', '#23'), ' ', '#20'), '(', '#28'), ')', '#29'), chr(10), '#0A'), 'é', '#C3#A9') name,
'(' || replace(replace(replace(replace(replace(s, chr(92), chr(92) || chr(92)), '(', chr(92) || '('), ')', chr(92) || ')'), chr(10), chr(92) || 'n'), 'é', chr(92) || '303' || chr(92) || '251') || ')' literal from p""")
def escape_strings(spark, sf_dir):
    s = F.concat("p_type", F.lit("(a#b)\\\né"))
    return table(spark, sf_dir, "part").select("p_partkey", st.escape_name(s).alias("name"), st.escape_literal(s).alias("literal"))


# --- text grid, layout ----------------------------------------------------------------------------------------------------------

GRID = r"""ln as (select doc_id, unnest(range(0, len(ls))) line_no, unnest(ls) line from (select doc_id, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') ls from documents)),
tk as (select doc_id, line_no, unnest(range(0, len(ts))) k, unnest(ts) txt from (select *, string_split(line, ' ') ts from ln)),
pos as (select *, sum(length(txt) + 1) over (partition by doc_id, line_no order by k) - length(txt) - 1 off from tk),
ch as (select doc_id, (line_no // 40)::int page_index, (row_number() over (partition by doc_id, line_no // 40 order by line_no, k) - 1)::int chunk_index, line_no::int line_no, txt, (36 + 6 * off)::double x0, (36 + 6 * (off + length(txt)))::double x1, (780 - 12 * (line_no % 40))::double y,
  case when (line_no % 40) % 7 = 6 then 3 else 0 end mode from pos where txt <> ''),
pgs as (select doc_id, unnest(range(0, max(line_no) // 40 + 1))::int page_index from ln group by doc_id)"""
LINES = """lns as (select doc_id, page_index, line_no, y, string_agg(txt, ' ' order by x0) t from {c} group by all),
ptx as (select doc_id, page_index, string_agg(t, chr(10) order by line_no) t from lns group by all)"""


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def chunks_of(spark: SparkSession, sf_dir: str, modes: bool = False) -> Paged:
    return grid.paged(docs_of(spark, sf_dir), modes)


def box(c: str = "bbox"):
    return [F.col(c)[k].alias(k) for k in "lbrt"]


@query(f"with {GRID} select doc_id, page_index, chunk_index, txt as text, x0, x1, y, x0 l, y - 2 b, x1 r, y + 8 t from ch")
def text_chunks(spark, sf_dir):
    return chunks_of(spark, sf_dir).rows().select("doc_id", "page_index", "chunk_index", "text", "x0", "x1", "y", *box())


@query(f"with {GRID} select doc_id, page_index, chunk_index word_index, txt as text, chunk_index first_chunk, 1 chunk_count, x0 l, x1 r from ch")
def extract_words(spark, sf_dir):
    return layout.words(chunks_of(spark, sf_dir)).select("doc_id", "page_index", "word_index", "text", "first_chunk", "chunk_count", F.col("bbox.l").alias("l"), F.col("bbox.r").alias("r"))


@query(f"with {GRID}, {LINES.format(c='ch')} select doc_id, page_index, (row_number() over (partition by doc_id, page_index order by line_no) - 1)::int line, y, t as text from lns")
def build_lines(spark, sf_dir):
    return layout.build_lines(chunks_of(spark, sf_dir))


@query(f"with {GRID}, {LINES.format(c='ch')} select doc_id, page_index, t as text from ptx")
def page_text(spark, sf_dir):
    return layout.page_text(chunks_of(spark, sf_dir))


@query(f"with {GRID} select doc_id, page_index, string_agg(txt, '' order by chunk_index) as text from ch group by all")
def simple_text(spark, sf_dir):
    return layout.simple_text(chunks_of(spark, sf_dir))


@query(f"with {GRID}, {LINES.format(c='ch')} select doc_id, string_agg(coalesce(t, ''), chr(10) order by page_index) as text from pgs left join ptx using (doc_id, page_index) group by doc_id")
def document_text(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return layout.document_text(grid.pages(docs), layout.page_text(grid.paged(docs)))


REGION = (100.0, 600.0, 300.0, 700.0)


def region():
    return geo.rect(*map(F.lit, REGION))


@query(f"with {GRID}, rg as (select * from ch where x0 <= 300 and x1 >= 100 and y - 2 <= 700 and y + 8 >= 600), {LINES.format(c='rg')} select doc_id, page_index, t as text from ptx")
def region_text(spark, sf_dir):
    return layout.page_text(layout.in_region(chunks_of(spark, sf_dir), REGION))


@query(f"with {GRID} select doc_id, page_index, count(*)::bigint n from ch where x0 >= 100 and x1 <= 300 and y - 2 >= 600 and y + 8 <= 700 group by all")
def region_contained(spark, sf_dir):
    return layout.in_region(chunks_of(spark, sf_dir), REGION, contained=True).rows().groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {GRID}, vs as (select * from ch where mode <> 3), {LINES.format(c='vs')} select doc_id, page_index, t as text from ptx")
def visible_text(spark, sf_dir):
    return layout.page_text(layout.visible(chunks_of(spark, sf_dir, True)))


@query(f"with {GRID} select doc_id, page_index, mode rendering_mode, count(*)::bigint n from ch where mode = 3 group by all")
def render_mode_filter(spark, sf_dir):
    return layout.of_mode(chunks_of(spark, sf_dir, True), 3).rows().groupBy("doc_id", "page_index", "rendering_mode").agg(F.count(F.lit(1)).alias("n"))


# --- search ---------------------------------------------------------------------------------------------------------------------

INDEX = """sp as (select *, coalesce(abs(lag(y) over w - y) > 2 or x0 - lag(x1) over w > 6, false) barrier from ch window w as (partition by doc_id, page_index order by chunk_index)),
sc as (select *, sum(length(txt) + barrier::int) over (partition by doc_id, page_index order by chunk_index)::bigint stop from sp),
s as (select *, stop - length(txt) start from sc),
tx as (select doc_id, page_index, string_agg(case when barrier then chr(10) else '' end || txt, '' order by chunk_index) t from sp group by all)"""


def found_sql(hay: str, pattern: str, where: str = "true") -> str:
    """Matches by pieces: offsets are running sums of what lies between the matches and of the matches."""
    return f"""pc as (select doc_id, page_index, t, string_split_regex({hay}, {lit(pattern)}) ps, regexp_extract_all({hay}, {lit(pattern)}) fs from tx),
oc as (select doc_id, page_index, t, unnest(range(1, len(ps))) k, unnest(ps[1:len(ps) - 1]) p, unnest(fs) f from pc where len(ps) > 1),
o2 as (select *, sum(length(p) + length(f)) over (partition by doc_id, page_index order by k)::bigint stop from oc),
mt as (select doc_id, page_index, (row_number() over (partition by doc_id, page_index order by k) - 1)::int match_no, stop - length(f) start, stop, t[stop - length(f) + 1:stop] matched from o2 where not contains(t[stop - length(f) + 1:stop], chr(10)) and {where})"""


LOW = sql_lower("t")
GEOMETRY = """gm as (select m.doc_id, m.page_index, match_no, m.start, m.stop, matched, min(chunk_index) first_chunk, max(chunk_index) last_chunk, count(*)::bigint n_rects,
 round(min(x0 + (x1 - x0) * strlen(txt[1:greatest(m.start, s.start) - s.start]) / strlen(txt)), 6) l, round(max(x0 + (x1 - x0) * strlen(txt[1:least(m.stop, s.stop) - s.start]) / strlen(txt)), 6) r, min(y - 2) b, max(y + 8) t
 from mt m join s on m.doc_id = s.doc_id and m.page_index = s.page_index and m.start < s.stop and s.start < m.stop group by all)"""


def flat(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "page_index", "match_no", "start", "stop", "matched", "first_chunk", "last_chunk", "n_rects", F.round("bbox.l", 6).alias("l"), F.col("bbox.b").alias("b"), F.round("bbox.r", 6).alias("r"), F.col("bbox.t").alias("t"))


def hits(spark, sf_dir, pattern: str, **options) -> DataFrame:
    return search.matches(search.spans(chunks_of(spark, sf_dir)), pattern, **options)


@query(f"with {GRID}, {INDEX}, {found_sql(LOW, 'inthe')}, {GEOMETRY} select * from gm")
def search_literal(spark, sf_dir):
    """The flagship: a keyword on all pages with chunks and rectangles."""
    return flat(search.find(chunks_of(spark, sf_dir), "INTHE"))


@query(f"with {GRID}, {INDEX} select doc_id, page_index, t as text from tx")
def search_index_text(spark, sf_dir):
    return search.search_text(search.spans(chunks_of(spark, sf_dir)))


@query(f"with {GRID}, {INDEX}, {found_sql('t', 'The')} select * from mt")
def search_case_sensitive(spark, sf_dir):
    return hits(spark, sf_dir, "The", ignore_case=False)


@query(f"with {GRID}, {INDEX}, {found_sql(sql_plain(LOW), 'cion')} select * from mt")
def search_ignore_accents(spark, sf_dir):
    return hits(spark, sf_dir, "ción", ignore_accents=True)


@query(f"with {GRID}, {INDEX}, {found_sql('t', 'th[ae]n?[.,]')}, {GEOMETRY} select * from gm")
def search_regex(spark, sf_dir):
    return flat(search.find(chunks_of(spark, sf_dir), "th[ae]n?[.,]", regex=True, ignore_case=False))


@query(f"with {GRID}, {INDEX}, {found_sql(LOW, 'the')} select * from mt where match_no < 3")
def search_max_matches(spark, sf_dir):
    return hits(spark, sf_dir, "the", most=3)


@query(f"with {GRID}, {INDEX}, {found_sql('t', 'on[a-z]+')} select doc_id, page_index, match_no, start, stop, matched from (select *, row_number() over (partition by doc_id order by page_index, match_no) n from mt) where n <= 5")
def search_regex_global_limit(spark, sf_dir):
    return search.first_overall(hits(spark, sf_dir, "on[a-z]+", regex=True, ignore_case=False), 5)


@query(f"with {GRID}, {INDEX}, {found_sql(LOW, 'en')}, {GEOMETRY} select * from gm where l <= 300 and r >= 100 and b <= 700 and t >= 600")
def search_region(spark, sf_dir):
    return flat(search.in_region(search.find(chunks_of(spark, sf_dir), "en"), region()))


@query(f"with {GRID}, {INDEX}, {found_sql('t', '[.]').replace('[.]', '[.]' + chr(10) + '[A-Z]').replace('not contains(t[stop - length(f) + 1:stop], chr(10)) and ', '')} select * from mt")
def search_across_lines(spark, sf_dir):
    return hits(spark, sf_dir, "[.]\n[A-Z]", regex=True, ignore_case=False, across_lines=True)


@query(f"with {GRID}, {INDEX}, {found_sql(LOW, 'and')} select doc_id, count(*)::bigint n, count(distinct page_index)::bigint pages from mt group by doc_id")
def search_document_counts(spark, sf_dir):
    return hits(spark, sf_dir, "and").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_index").alias("pages"))


@query(f"select doc_id, lang, source from documents where contains({sql_lower('lang')}, 'c1') or contains({sql_lower('source')}, 'c1')")
def search_filter(spark, sf_dir):
    return search.search_filter(table(spark, sf_dir, "documents"), ["lang", "source"], "C1").select("doc_id", "lang", "source")


# --- edits ----------------------------------------------------------------------------------------------------------------------

KEY = f"with {GRID}, {INDEX}, {found_sql(LOW, 'ing')}, {GEOMETRY}"


@query(f"{KEY} select doc_id, page_index, match_no, 'Highlight' subtype, matched contents, l, b - 1 b, r, t + 1 t from gm")
def highlight_matches(spark, sf_dir):
    h = edits.highlights(search.find(chunks_of(spark, sf_dir), "ing"))
    return h.select("doc_id", "page_index", "match_no", "subtype", "contents", F.round("rect.l", 6).alias("l"), F.col("rect.b").alias("b"), F.round("rect.r", 6).alias("r"), F.col("rect.t").alias("t"))


def redaction_rects(spark, sf_dir) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    zones = docs.select("doc_id", F.lit(0).alias("page_index"), region().alias("rect"))
    return edits.redactions(search.find(grid.paged(docs), "ing"), zones)


REDACT = f"{KEY}, rr as (select doc_id, page_index, l - 1 l, b - 1 b, r + 1 r, t + 1 t from gm union all select doc_id, 0, 100.0, 600.0, 300.0, 700.0 from documents)"


@query(f"{REDACT} select doc_id, page_index, round(l, 6)::double l, b::double b, round(r, 6)::double r, t::double t from rr")
def redact_text_rects(spark, sf_dir):
    """A keyword and a region of every document."""
    return redaction_rects(spark, sf_dir).select("doc_id", "page_index", F.round("rect.l", 6).alias("l"), F.col("rect.b").alias("b"), F.round("rect.r", 6).alias("r"), F.col("rect.t").alias("t"))


@query(f"{REDACT} select doc_id, count(*)::bigint redactions, count(distinct page_index)::bigint pages from rr group by doc_id")
def redaction_counts(spark, sf_dir):
    return edits.redaction_counts(redaction_rects(spark, sf_dir))


@query(f"with {GRID}, {INDEX}, {found_sql('t', '[0-9]{3}-[0-9]{4}')}, {GEOMETRY} select doc_id, page_index, round(l - 1, 6) l, b - 1 b, round(r + 1, 6) r, t + 1 t from gm")
def redact_regex_rects(spark, sf_dir):
    r = edits.redactions(search.find(chunks_of(spark, sf_dir), "[0-9]{3}-[0-9]{4}", regex=True))
    return r.select("doc_id", "page_index", F.round("rect.l", 6).alias("l"), F.col("rect.b").alias("b"), F.round("rect.r", 6).alias("r"), F.col("rect.t").alias("t"))


@query("select doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || repeat('█', coalesce(length(f[i]), 0))), '') as text from (select doc_id, string_split_regex(text, '[0-9]+') p, regexp_extract_all(text, '[0-9]+') f from documents)")
def mask_text(spark, sf_dir):
    return edits.mask_text(docs_of(spark, sf_dir), "[0-9]+")


def annotations_of(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page_index"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("subtype"), F.concat(F.lit("/"), "event_type").alias("contents"), F.lit("t").alias("title"))


@query("select user_id doc_id, event_id ordinal, event_type subtype from events where event_type not in ('click', 'view')")
def annotation_remove(spark, sf_dir):
    return edits.remove_annotations(annotations_of(spark, sf_dir), ["/click", "view"]).select("doc_id", "ordinal", "subtype")


@query("select event_id ordinal, event_type = 'click' changed, case when event_type = 'click' then 'seen' else '/' || event_type end contents, case when event_type = 'click' then 'me' else 't' end title from events")
def annotation_update(spark, sf_dir):
    return edits.update_annotations(annotations_of(spark, sf_dir), "/click", "seen", "me").select("ordinal", "changed", "contents", "title")


@query("select a.conv_id doc_id, a.turn + 1 as ordinal, a.text contents, b.text parent_contents from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1")
def reply_threads(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page_index"), (F.col("turn") + 1).alias("ordinal"), F.col("turn").alias("in_reply_to"), F.col("text").alias("contents"))
    return edits.reply_threads(a).select("doc_id", "ordinal", "contents", "parent_contents")


@query("select doc_id, min(doc_id) over (partition by text) keep from documents")
def dedup_streams(spark, sf_dir):
    return edits.deduplicate_streams(docs_of(spark, sf_dir), "text", "doc_id").select("doc_id", "keep")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n = 1")
def incremental_latest(spark, sf_dir):
    return edits.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) n from events) where n = 1")
def xref_first_seen(spark, sf_dir):
    return edits.first_seen(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("select n_nationkey, row_number() over (partition by n_regionkey order by n_nationkey)::int new_num from nation")
def renumber_objects(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("num"))
    return edits.renumber(n).select(F.col("num").alias("n_nationkey"), "new_num")


@query("select user_id doc_id, event_id num from (select *, row_number() over (partition by user_id order by ts, event_id) n from events) where n > 1")
def reachable_objects(spark, sf_dir):
    """A user's events linked each to its successor, from the second one on: chains as long as a user has events."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("num"), F.lead("event_id").over(w).alias("target"), F.row_number().over(w).alias("n"))
    return edits.reachable(e.where("n = 2"), e.where("target is not null").select("doc_id", "num", "target"))


# --- pages ----------------------------------------------------------------------------------------------------------------------

PAGES = f"with {GRID}, n as (select *, max(page_index) over (partition by doc_id) + 1 n from pgs)"


def pages_of(spark, sf_dir) -> DataFrame:
    return grid.pages(docs_of(spark, sf_dir))


def listed(p: DataFrame) -> DataFrame:
    """Each document's pages, last first, as a list of requests."""
    from pyspark.sql import Window

    return p.select("doc_id", "page_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("page_index").desc())) - 1).alias("ordinal"))


@query(f"{PAGES} select doc_id, page_index, n - 1 - page_index new_index from n")
def reorder_pages(spark, sf_dir):
    p = pages_of(spark, sf_dir)
    return pg.reorder(p, listed(p)).select("doc_id", "page_index", "new_index")


@query(f"{PAGES} select doc_id, page_index, (case when n <= 2 then page_index when page_index = 0 then 2 when page_index <= 2 then page_index - 1 else page_index end)::int new_index from n")
def move_page(spark, sf_dir):
    return pg.move(pages_of(spark, sf_dir), 0, 2)


@query(f"{PAGES} select doc_id, page_index, (case when n = 1 then 0 else page_index - 1 end)::int new_index from n where page_index > 0 or n = 1")
def remove_pages(spark, sf_dir):
    p = pages_of(spark, sf_dir)
    gone = p.where("page_index = 0")
    return pg.remove(p, gone.unionByName(gone))


@query(f"{PAGES} select doc_id, page_index, (row_number() over (partition by doc_id order by page_index desc) - 1)::int new_index from n where page_index % 2 = 0")
def extract_pages(spark, sf_dir):
    p = pages_of(spark, sf_dir)
    return pg.extract(p, listed(p.where("page_index % 2 = 0"))).select("doc_id", "page_index", "new_index")


@query(f"{PAGES} select doc_id, page_index, page_index - 1 new_index from n where page_index between 1 and 2")
def extract_range(spark, sf_dir):
    return pg.extract_range(pages_of(spark, sf_dir), 1, 2)


@query(f"{PAGES} select doc_id, page_index, page_index // 2 + 1 part, page_index % 2 new_index from n")
def split_every(spark, sf_dir):
    return pg.split_every(pages_of(spark, sf_dir), 2)


@query(f"{PAGES} select doc_id, page_index, page_index new_index from n union all select doc_id, page_index, 2 * n - 1 - page_index from n")
def duplicate_pages(spark, sf_dir):
    p = pages_of(spark, sf_dir)
    return pg.duplicate(p, listed(p)).select("doc_id", "page_index", "new_index")


@query(f"{PAGES} select doc_id // 10 as target, doc_id, page_index, (row_number() over (partition by doc_id // 10 order by doc_id, page_index) - 1)::int new_index from n")
def merge_documents(spark, sf_dir):
    return pg.merge(pages_of(spark, sf_dir), F.floor(F.col("doc_id") / 10)).select("target", "doc_id", "page_index", "new_index")


@query("with f as (select n_regionkey target, n_nationkey source, left(n_name, 1) as name from nation) select target, source, name, case when row_number() over (partition by target, name order by source) = 1 then name else 'Source' || source || '.' || name end new_name from f")
def merge_field_conflicts(spark, sf_dir):
    f = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("target"), F.col("n_nationkey").alias("source"), F.left("n_name", F.lit(1)).alias("name"), F.lit(0).alias("ordinal"))
    return pg.rename_conflicts(f).select("target", "source", "name", "new_name")


@query("select p_partkey, (((p_size * 90 - 1800) % 360 + 360) % 360)::int rotation from part")
def page_rotation(spark, sf_dir):
    return pg.set_rotation(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("rotation")), F.col("rotation") * 90 - 1800)


@query("select l_orderkey doc_id, string_agg(l_returnflag || l_linenumber, chr(10) order by l_linenumber, l_returnflag) as content, max_by(l_quantity::int * 90, l_linenumber * 100000 + l_quantity::int * 90) filter (where l_returnflag <> 'N') rotation from lineitem group by l_orderkey")
def apply_edits(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_linenumber").alias("request"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("content"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("int") * 90).alias("rotation"))
    return pg.apply_edits(e).drop("page_index")


@query(f"{PAGES} select doc_id, page_index, case when page_index = 0 then 'i' when page_index < 4 then 'P-' || (page_index + 4) else ['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H', 'I', 'J', 'K', 'L', 'M', 'N'][page_index - 3] end as label from n")
def page_labels(spark, sf_dir):
    p = pages_of(spark, sf_dir)
    ranges = p.select("doc_id").distinct().select("doc_id", F.inline(F.array(*(F.struct(F.lit(a).alias("first_page"), F.lit(s).alias("style"), F.lit(x).alias("prefix"), F.lit(n).alias("start_number")) for a, s, x, n in ((0, "r", None, 1), (1, "D", "P-", 5), (4, "A", None, 1))))))
    return pg.labels(p, ranges)


# --- geometry and functions -----------------------------------------------------------------------------------------------------


def items_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


ROW = "l_orderkey, l_linenumber"


def per_item(spark, sf_dir, **columns) -> DataFrame:
    return items_of(spark, sf_dir).select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in columns.items()))


@query(f"select {ROW}, round(0.2 + pow(least(1.0, greatest(0.0, l_discount * 12)), 2.0) * (0.9 - 0.2), 9) red, round(1.0 + pow(least(1.0, greatest(0.0, l_discount * 12)), 2.0) * (0.0 - 1.0), 9) green from lineitem")
def exponential_function(spark, sf_dir):
    red, green = geo.exponential(F.col("l_discount") * 12, [0.2, 1.0], [0.9, 0.0], 2.0)
    return per_item(spark, sf_dir, red=F.round(red, 9), green=F.round(green, 9))


@query(f"select {ROW}, [0.0, 0.25, 0.75, 1.0, 0.5][floor(least(1.0, greatest(0.0, l_tax * 10)) * 4 + 0.5)::int + 1]::double v from lineitem")
def sampled_function(spark, sf_dir):
    return per_item(spark, sf_dir, v=geo.sampled(F.col("l_tax") * 10, [0.0, 0.25, 0.75, 1.0, 0.5]))


@query(f"select {ROW}, (case when l_quantity <= 10 then l_quantity when l_quantity <= 30 then l_quantity * 2 else 0 end)::double v from lineitem")
def stitched_function(spark, sf_dir):
    q = F.col("l_quantity")
    return per_item(spark, sf_dir, v=geo.stitched(q, [10.0, 30.0], [q, q * 2, F.lit(0.0)]))


@query(f"select {ROW}, round(sqrt(abs(l_quantity * l_quantity - l_tax)), 9) v from lineitem")
def calculator_function(spark, sf_dir):
    return per_item(spark, sf_dir, v=F.round(geo.calculator("{ exch dup mul exch sub abs sqrt }", F.col("l_quantity"), F.col("l_tax"))[0], 9))


@query(f"with t as (select {ROW}, (l_quantity * 30 + (l_discount * 100) * 40) / 2500.0 t from lineitem) select {ROW}, round(case when t > 1 then 1.0 when t < 0 then null else t end, 9) v from t")
def axial_shading(spark, sf_dir):
    return per_item(spark, sf_dir, v=F.round(geo.axial(F.col("l_quantity"), F.col("l_discount") * 100, 0, 0, 30, 40, (False, True)), 9))


@query(f"""with p as (select {ROW}, l_quantity - 20 px, l_discount * 100 - 5 py from lineitem), q as (select *, (px * 5 + 2 * 8) h, px * px + py * py - 4 c, 25.0 - 64 a from p),
r as (select *, h * h - a * c d from q), t as (select {ROW}, case when d >= 0 then greatest((h - sqrt(greatest(d, 0))) / a, (h + sqrt(greatest(d, 0))) / a) end t from r)
select {ROW}, round(case when t < 0 or t > 1 then null else t end, 6) v from t""")
def radial_shading(spark, sf_dir):
    return per_item(spark, sf_dir, v=F.round(geo.radial(F.col("l_quantity"), F.col("l_discount") * 100, 20, 5, 2, 25, 5, 10), 6))


@query("select l_orderkey, min(l_quantity) l, min(l_discount) b, max(l_quantity + l_tax) r, max(l_discount + 1) t from lineitem group by l_orderkey")
def rect_union(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return items_of(spark, sf_dir).withColumn("a", geo.rect(q, d, q + F.col("l_tax"), d + 1)).groupBy("l_orderkey").agg(geo.union_of(F.col("a")).alias("u")).select("l_orderkey", *(F.col("u")[k].alias(k) for k in "lbrt"))


@query(f"select {ROW}, l_quantity <= 20 and l_quantity + 5 >= 10 hit, l_quantity >= 10 and l_quantity + 5 <= 20 inner_ from lineitem")
def rect_intersects(spark, sf_dir):
    a = geo.rect(F.col("l_quantity"), F.lit(0.0), F.col("l_quantity") + 5, F.lit(1.0))
    b = geo.rect(F.lit(10.0), F.lit(0.0), F.lit(20.0), F.lit(1.0))
    return per_item(spark, sf_dir, hit=geo.intersects(a, b), inner_=geo.contains(b, a))


@query(f"select {ROW}, 2 * l_quantity + 10 l, 3 * l_discount - 1 b, 2 * (l_quantity + 1) + 10 r, 3 * (l_discount + 1) - 1 t from lineitem".replace("3 * l_discount - 1 b", "round(3 * l_discount - 1, 9) b").replace("3 * (l_discount + 1) - 1 t", "round(3 * (l_discount + 1) - 1, 9) t"))
def rect_transform(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    u = geo.transform_rect([F.lit(x) for x in (2.0, 0.0, 0.0, 3.0, 10.0, -1.0)], geo.rect(q, d, q + 1, d + 1))
    return per_item(spark, sf_dir, l=u["l"], b=F.round(u["b"], 9), r=u["r"], t=F.round(u["t"], 9))


@query(f"""with p as (select {ROW}, l_linenumber * 90 % 360 rot, l_quantity x, l_discount * 100 y from lineitem)
select {ROW}, round((case rot when 90 then y when 180 then 612 - x when 270 then 792 - y else x end) * 2, 6) dx, round((case rot when 90 then x when 180 then y when 270 then 612 - x else 792 - y end) * 2, 6) dy from p""")
def device_mapping(spark, sf_dir):
    dx, dy = geo.page_to_device(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_linenumber") * 90, F.lit(612.0), F.lit(792.0), 2.0)
    return per_item(spark, sf_dir, dx=F.round(dx, 6), dy=F.round(dy, 6))


@query("select p_partkey, ceil((p_size * 12) * (96 / 72.0 * 2))::bigint px, greatest(1, 100 * p_size // (p_size + 7))::bigint fit from part")
def pixel_sizes(spark, sf_dir):
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", geo.pixel_size(n * 12, 96, 2).alias("px"), geo.keep_aspect(n + 7, n, F.lit(100)).alias("fit"))


@query("select p_partkey, round((p_size * 5) * 0.2126::double + (p_partkey % 256) * 0.7152::double + 7 * 0.0722::double)::int gray, round(((p_partkey * 4099) % 256) / 255.0, 9) red from part")
def grayscale(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    color = F.concat(F.lpad(F.hex((k * 4099) % 256), 2, "0"), F.lit("00zz"))
    return p.select("p_partkey", geo.grayscale(F.col("p_size") * 5, k % 256, F.lit(7)).alias("gray"), F.round(geo.hex_color(color)[0], 9).alias("red"))


# --- forms and audits -----------------------------------------------------------------------------------------------------------


@query("select p_partkey, (p_size & 1) <> 0 read_only, (p_size & 2) <> 0 required, ((p_partkey * 32768) & 32768) <> 0 radio, false as combo from part")
def form_flags(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    f = lambda c, k, n: forms.flag(c.cast("bigint"), F.lit(k), n).alias(n)
    return p.select("p_partkey", f(F.col("p_size"), "Tx", "read_only"), f(F.col("p_size"), "Tx", "required"), f(F.col("p_partkey") * 32768, "Btn", "radio"), f(F.lit(1 << 17), "Tx", "combo"))


def tree_of(spark, sf_dir) -> DataFrame:
    """Regions, nations and customers as a field tree: customers inherit type and value from their nation, flags from the region."""
    none = lambda t: F.lit(None).cast(t)
    r = table(spark, sf_dir, "region").select(F.lit(1).alias("doc_id"), F.col("r_regionkey").cast("bigint").alias("num"), none("bigint").alias("parent"), F.col("r_name").alias("partial"), none("string").alias("ft"), F.col("r_regionkey").cast("bigint").alias("ff"), none("string").alias("v"))
    n = table(spark, sf_dir, "nation").select(F.lit(1).alias("doc_id"), (F.col("n_nationkey") + 100).cast("bigint").alias("num"), F.col("n_regionkey").cast("bigint").alias("parent"), F.col("n_name").alias("partial"), F.when(F.col("n_nationkey") % 2 == 0, "Tx").alias("ft"), none("bigint").alias("ff"), F.col("n_name").alias("v"))
    c = table(spark, sf_dir, "customer").select(F.lit(1).alias("doc_id"), (F.col("c_custkey") + 1000).alias("num"), (F.col("c_nationkey") + 100).cast("bigint").alias("parent"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")).alias("partial"), none("string").alias("ft"), none("bigint").alias("ff"), none("string").alias("v"))
    return r.unionByName(n).unionByName(c)


@query("""with n as (select *, r_name || '.' || n_name nm, case when n_nationkey % 2 = 0 then 'Tx' end ft from nation join region on n_regionkey = r_regionkey)
select n_nationkey::bigint + 100 num, nm as name, ft, r_regionkey::bigint ff, n_name v from n where ft is not null or not exists (select 1 from customer where c_nationkey = n_nationkey)
union all select c_custkey + 1000, case when c_custkey % 5 = 0 then nm else nm || '.' || c_name end, ft, r_regionkey::bigint, n_name from customer join n on c_nationkey = n_nationkey""")
def form_hierarchy(spark, sf_dir):
    return forms.hierarchy(tree_of(spark, sf_dir)).select("num", "name", "ft", "ff", "v")


@query("select event_id, lower(event_type) in ('true', '1', 'yes', 'on', 'checked') checked from events")
def form_checked(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", forms.checked(F.col("event_type")).alias("checked"))


@query("select c_custkey, case when c_custkey % 3 = 0 and c_custkey % 2 = 0 then 'new' else c_name end v, case when c_custkey % 2 <> 0 then 'unchanged' when c_custkey % 3 = 1 then 'rejected' when c_custkey % 3 = 2 then 'read_only' else 'set' end status from customer")
def form_set_values(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    f = c.select("c_custkey", k.alias("doc_id"), F.lit("f").alias("name"), F.when(k % 3 == 1, "Sig").otherwise("Tx").alias("ft"), F.when(k % 3 == 2, 1).otherwise(0).cast("bigint").alias("ff"), F.col("c_name").alias("v"))
    u = c.where(k % 2 == 0).select(k.alias("doc_id"), F.lit("f").alias("name"), F.lit("new").alias("value"))
    return forms.set_values(f, u).select("c_custkey", "v", "status")


@query("""with s as (select o_orderkey, floor(o_totalprice)::bigint p from orders) select o_orderkey doc_id, 'a' as name, p::varchar as value, false calculated from s
union all select o_orderkey, 'b', '2', false from s union all select o_orderkey, 'c', (p * 2 + 1)::varchar, true from s union all select o_orderkey, 'd', (p * 2 + 1 - p)::varchar, true from s union all select o_orderkey, 'e', 'x', false from s""")
def form_calculate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.floor("o_totalprice").cast("string").alias("p"))
    rows = [("a", None, None), ("b", "2", None), ("c", "0", "c = a * b + 1"), ("d", None, "d = -(a - c)"), ("e", "x", "e = a / (b - 2)")]
    f = o.select("doc_id", F.posexplode(F.array(*(F.struct(F.lit(n).alias("name"), (F.col("p") if n == "a" else F.lit(v).cast("string")).alias("value"), F.lit(s).cast("string").alias("script")) for n, v, s in rows))).alias("ordinal", "x"))
    return forms.calculate(f.select("doc_id", "ordinal", "x.*")).select("doc_id", "name", "value", "calculated")


def issues_of(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return audit.all_issues(
        audit.issues(d.where("n_chars < 200"), "DOC-SHORT-001", "warning", "text is short"),
        audit.issues(d.where(~st.valid_language_tag(F.concat("lang", F.when(F.col("doc_id") % 7 == 0, F.lit("_")).otherwise(F.lit(""))))), "DOC-LANG-001", "error", "language tag", F.col("lang")),
        audit.issues(d, "VALIDATION-PROFILE", "info", "profile"),
    )


ISSUES = """iss as (select doc_id, 'DOC-SHORT-001' code, 'warning' severity, 'text is short' message, '' as location from documents where n_chars < 200
union all select doc_id, 'DOC-LANG-001', 'error', 'language tag', lang from documents where doc_id % 7 = 0 union all select doc_id, 'VALIDATION-PROFILE', 'info', 'profile', '' from documents)"""


@query(f"with {ISSUES} select * from iss")
def audit_issues(spark, sf_dir):
    return issues_of(spark, sf_dir)


@query(f"with {ISSUES} select doc_id, count(*) filter (where severity = 'error')::bigint errors, count(*) filter (where severity = 'warning')::bigint warnings, count(*) filter (where severity = 'info')::bigint infos, count(*) filter (where severity = 'error') = 0 as valid from iss group by doc_id")
def audit_counts(spark, sf_dir):
    return audit.counts(issues_of(spark, sf_dir))


@query(f"with {ISSUES} select doc_id, code, severity, message, location from (select *, row_number() over (partition by doc_id order by code, location) n from iss) where n <= 2")
def audit_max_issues(spark, sf_dir):
    return audit.first_issues(issues_of(spark, sf_dir), 2)


@query(f"""with {ISSUES} select doc_id, '{{"doc_id":' || doc_id || ',"count":' || count(*) || ',"issues":[' || string_agg('{{"code":"' || code || '","location":"' || location || '","message":"' || message || '","severity":"' || severity || '"}}', ',' order by code, location) || ']}}' report from iss group by doc_id""")
def audit_report_json(spark, sf_dir):
    return audit.report_json(issues_of(spark, sf_dir))


@query(f"with {ISSUES} select doc_id, string_agg('[' || severity || '] ' || code || ' ' || location || ': ' || message, chr(10) order by code, location) report from iss group by doc_id")
def audit_report_text(spark, sf_dir):
    return audit.report_text(issues_of(spark, sf_dir))


@query("select conv_id doc_id, turn seq, lv as level from (select *, lag(lv) over (partition by conv_id order by turn) b from (select *, length(role) - 3 lv from conversations)) where lv > coalesce(b, 0) + 1")
def audit_heading_skips(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return audit.heading_skips(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), (F.length("role") - 3).alias("level"))).select("doc_id", "seq", "level")


@query("select text, count(*)::bigint n from documents group by text having count(*) > 1")
def audit_duplicate_ids(spark, sf_dir):
    return audit.duplicates(table(spark, sf_dir, "documents"), ["text"])


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def audit_orphans(spark, sf_dir):
    return audit.missing(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("select doc_id, 'not in tree' problem from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'not on page' from labels where doc_id not in (select doc_id from documents)")
def audit_set_differences(spark, sf_dir):
    return audit.both_differences(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("select o_custkey, o_orderkey from (select *, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) b from orders) where o_totalprice <= b")
def audit_not_increasing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return audit.not_increasing(o, ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey")


@query("""with recursive m as (select p_partkey // 10 doc_id, p_partkey % 10 role, case when p_size % 4 = 0 then null else (p_partkey * 7 + p_size) % 10 end target from part),
w as (select doc_id, role, target q, 0 n from m union all select w.doc_id, w.role, m.target, n + 1 from w join m on w.doc_id = m.doc_id and w.q = m.role where n < 12)
select doc_id, 'R' || role as role from w where n = 12 and q is not null""")
def audit_role_cycles(spark, sf_dir):
    """Role maps of ten roles a document; some end in a standard role, the others run round."""
    k, n = F.col("p_partkey"), F.col("p_size")
    roles = table(spark, sf_dir, "part").select(F.floor(k / 10).alias("doc_id"), F.concat(F.lit("R"), k % 10).alias("role"), F.when(n % 4 == 0, F.lit("P")).otherwise(F.concat(F.lit("R"), (k * 7 + n) % 10)).alias("target"))
    return audit.role_cycles(roles)


@query("with m as (select event_type, median(value) m from events group by 1) select event_type workload from (select event_type, case when event_type < 'm' then m * 0.5 else m * 2 end base, m from m) where m > base * 1.1 union all select 'absent'")
def regression_gate(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("workload"), F.col("value").alias("seconds"))
    base = t.groupBy("workload").agg(F.percentile("seconds", 0.5).alias("m")).select("workload", F.when(F.col("workload") < "m", F.col("m") * 0.5).otherwise(F.col("m") * 2).alias("base"))
    return audit.regression_gate(base.unionByName(spark.createDataFrame([("absent", 1.0)], "workload string, base double")), t).select("workload")


# --- codecs, content streams, files ---------------------------------------------------------------------------------------------


def round_trip(*names: str):
    from vellum.functions import codecs

    def run(spark, sf_dir):
        d = docs_of(spark, sf_dir).withColumn("packed", codecs.encode(F.encode("text", "UTF-8"), list(names)))
        return d.select("doc_id", F.decode(codecs.decode(F.col("packed"), list(reversed(names))), "UTF-8").alias("text"))

    return run


for _name, _filters in {"ascii85_roundtrip": ["A85"], "runlength_roundtrip": ["RL"], "lzw_roundtrip": ["LZW"], "flate_roundtrip": ["FlateDecode"], "chained_roundtrip": ["FlateDecode", "A85", "AHx"]}.items():
    QUERIES[_name], SQL[_name] = round_trip(*_filters), "select doc_id, text from documents"


@query("select doc_id, lower(hex(encode(text))) || '>' packed, text from documents")
def ascii_hex_roundtrip(spark, sf_dir):
    from vellum.functions import codecs

    d = docs_of(spark, sf_dir).withColumn("packed", codecs.ascii_hex_encode(F.encode("text", "UTF-8")))
    return d.select("doc_id", "packed", F.decode(codecs.ascii_hex_decode(F.col("packed")), "UTF-8").alias("text"))


@query("select doc_id, text from documents")
def predictor_roundtrip(spark, sf_dir):
    """Differences and PNG rows of every document and back; the last row of a text may be short."""
    from vellum.functions import codecs

    d = docs_of(spark, sf_dir).withColumn("tiff", codecs.predict(F.encode("text", "UTF-8"), 2, 4))
    back = codecs.predict(codecs.predict(codecs.predict(F.col("tiff"), 2, 4, back=True), 12, 4), 12, 4, back=True)
    return d.select("doc_id", F.decode(back, "UTF-8").alias("text"))


@query("select p_partkey, ['png', 'jpeg', 'bmp', 'jpeg2000', 'unknown', 'unknown', 'unknown'][p_partkey % 7 + 1] kind from part")
def image_types(spark, sf_dir):
    """Signatures of four kinds, two that are cut short and one that is none, each before a name's bytes."""
    from vellum.functions import codecs

    heads = F.array(*map(F.lit, ("89504E470D0A1A0A", "FFD8FF", "424D", "FF4FFF51", "", "89504E470D0A1A", "FFD8")))
    p = table(spark, sf_dir, "part")
    head = F.element_at(heads, (F.col("p_partkey") % 7 + 1).cast("int"))
    return p.select("p_partkey", codecs.image_type(F.unhex(F.concat(head, F.hex(F.encode("p_name", "UTF-8"))))).alias("kind"))


@query(f"with {GRID} select doc_id, page_index, chunk_index, txt as text, x0, x1, y, round(y - 2, 6) b, round(y + 8, 6) t from ch")
def content_roundtrip(spark, sf_dir):
    """The grid written as content streams, tokenized and extracted again."""
    from vellum.sources import content, pdf

    back = content.content_chunks(pdf.page_streams(chunks_of(spark, sf_dir)))
    return back.select("doc_id", "page_index", "chunk_index", "text", "x0", F.round("x1", 6).alias("x1"), "y", F.round("bbox.b", 6).alias("b"), F.round("bbox.t", 6).alias("t"))


@query("""select p_partkey, 0 chunk_index, p_name || ' ' || p_type as text, 10.0::double x0, round(10 + 5 * (length(p_name) + length(p_type) + 1) + p_size / 10.0 + 6, 6) x1, [-10.0 * p_size, -600.0]::double[] numbers from part""")
def shown_arrays(spark, sf_dir):
    """Arrays of strings and adjustments: all numbers count for the width, one after a string that is wide enough makes a blank."""
    from vellum.sources import content

    parts = [F.lit("BT /F1 10 Tf 1 0 0 1 10 20 Tm ["), F.col("p_size") * -10, F.lit(" "), st.escape_literal(F.col("p_name")), F.lit(" -600 "), st.escape_literal(F.col("p_type")), F.lit("] TJ ET")]
    p = table(spark, sf_dir, "part").select("p_partkey", F.encode(F.concat(*(x.cast("string") for x in parts)), "UTF-8").alias("content"))
    numbers = content.content_events(p).where("op = 'TJ'").select("p_partkey", "numbers")
    return content.content_chunks(p).select("p_partkey", "chunk_index", "text", "x0", F.round("x1", 6).alias("x1")).join(numbers, "p_partkey")


@query("""with a as (select p_partkey, 1.0 + p_size a from part) select p_partkey, seq, kind, list_transform(numbers, lambda x: round(x, 6)) numbers, [round(c, 6) for c in ctm] as ctm, line_width, line_cap, fill from a, lateral (values
  (0, 'save', []::double[], [1.0, 0, 0, 1, 0, 0]::double[], 1.0::double, 0, [0.0]::double[]), (1, 'transform', [a, 0, 0, 2, 3, 4]::double[], [a, 0, 0, 2, 3, 4]::double[], 1.0, 0, [0.0]),
  (2, 'transform', [a, 0, 0, 2, a * 5 + 3, 16]::double[], [a, 0, 0, 2, a * 5 + 3, 16]::double[], 1.0, 0, [0.0]), (3, 'line_width', [a]::double[], [a, 0, 0, 2, a * 5 + 3, 16]::double[], a, 1, [0.0]),
  (4, 'color', [1.0, 0.5, 0.0]::double[], [a, 0, 0, 2, a * 5 + 3, 16]::double[], a, 1, [1.0, 0.5, 0.0]), (5, 'restore', []::double[], [1.0, 0, 0, 1, 0, 0]::double[], 1.0, 0, [0.0])) v(seq, kind, numbers, ctm, line_width, line_cap, fill)""".replace("[round(c, 6) for c in ctm]", "list_transform(ctm, lambda x: round(x, 6))"))
def content_states(spark, sf_dir):
    """Events with the state after each: products of transforms (here in the order of the file format), line settings, held colours, saved and restored."""
    from vellum.sources import content

    a = (F.col("p_size") + 1).cast("string")
    body = F.concat(F.lit("q "), a, F.lit(" 0 0 2 3 4 cm 1 0 0 1 5 6 cm 1 J "), a, F.lit(" w 7 .5 -3 rg Q"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.encode(body, "UTF-8").alias("content"))
    near = lambda c: F.transform(c, lambda x: F.round(x, 6)).alias(c)
    return content.content_events(p, state=True, standard_cm=True).select("p_partkey", "seq", "kind", near("numbers"), near("ctm"), "line_width", "line_cap", "fill")


@query("""select p_partkey, seq, tag, mcid, depth, text from part, lateral (values (0, 'Span', (p_partkey + 1)::int, 1, p_name), (1, 'P', p_partkey::int, 0, p_type || p_name)) v(seq, tag, mcid, depth, text)""")
def marked_spans(spark, sf_dir):
    """Marked spans with their texts; an outer span has the inner one's text too, a transparency group is none."""
    from vellum.sources import content

    k = F.col("p_partkey")
    parts = [F.lit("/P <</MCID "), k, F.lit(">> BDC /G <</Group <</S /Transparency>>>> BDC BT /F1 9 Tf "), st.escape_literal(F.col("p_type")), F.lit(" Tj ET EMC /Span <</MCID "), k + 1, F.lit(">> BDC BT "), st.escape_literal(F.col("p_name")), F.lit(" Tj ET EMC EMC")]
    p = table(spark, sf_dir, "part").select("p_partkey", F.encode(F.concat(*(x.cast("string") for x in parts)), "UTF-8").alias("content"))
    return content.content_spans(p).select("p_partkey", "seq", "tag", "mcid", "depth", "text")


@query(f"with {GRID} select doc_id, page_index, kind, n from (select doc_id, page_index, count(*)::bigint c from ch group by all), lateral (values ('begin_text', 1::bigint), ('end_text', 1), ('set_font', 1), ('text_state', 1), ('set_matrix', c), ('show_text', c)) v(kind, n)")
def content_event_counts(spark, sf_dir):
    from vellum.sources import content, pdf

    return content.content_events(pdf.page_streams(chunks_of(spark, sf_dir))).groupBy("doc_id", "page_index", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {GRID}, {LINES.format(c='ch')} select doc_id, page_index, 612.0::double width, 0 rotation, t as text from ptx")
def pdf_roundtrip(spark, sf_dir):
    """Documents written as PDF files, read again, their pages' text built from the content streams, forms and fonts."""
    from vellum.sources import pdf

    files = pdf.write_pages(chunks_of(spark, sf_dir))
    text = layout.page_text(pdf.paged_chunks(files))
    return text.select("doc_id", "page_index", F.col("media_box")[2].alias("width"), "rotation", "text")


@query(f"with {GRID}, n as (select doc_id, max(page_index) + 1 n from ch group by doc_id) select doc_id, '1.7' as version, n page_count, 5 + 2 * n xref_count, 'document ' || doc_id title from n")
def pdf_documents(spark, sf_dir):
    from vellum.sources import pdf

    return pdf.read_documents(pdf.write_pages(chunks_of(spark, sf_dir))).select("doc_id", "version", "page_count", "xref_count", "title")


@query(f"with {GRID}, n as (select doc_id, max(page_index) + 1 n from ch group by doc_id) select doc_id, obj_type, c from n, lateral (values ('dictionary', (4 + n)::bigint), ('stream', n::bigint)) v(obj_type, c)")
def pdf_objects(spark, sf_dir):
    from vellum.sources import pdf

    return pdf.read_objects(pdf.write_pages(chunks_of(spark, sf_dir))).groupBy("doc_id", "obj_type").agg(F.count(F.lit(1)).alias("c"))


@query("select * from (values (1, 'בא', 'ﺑﺖ', 'é', 'aaa|bb cc'), (2, 'ABC', 'x', 'z', 'abcde|f')) v(id, bidi, arabic, nfc, wrapped)")
def shaping_samples(spark, sf_dir):
    from vellum.functions import shaping

    rows = [(1, "אב", "بت", "é", "aaa bb cc"), (2, "ABC", "x", "z", "abcdef")]
    s = spark.createDataFrame(rows, "id int, a string, b string, c string, d string")
    return s.select("id", shaping.reorder_bidi(F.col("a")).alias("bidi"), shaping.shape_arabic(F.col("b")).alias("arabic"), shaping.normalize_nfc(F.col("c")).alias("nfc"), F.array_join(shaping.word_wrap(F.col("d"), 5), "|").alias("wrapped"))


@query("select event_id % 1000 doc_id, (row_number() over (partition by event_id % 1000 order by event_id // 1000) - 1)::int ordinal, 'Highlight' subtype, 3 page_index, (event_id % 7)::double l, event_type || '\"<&' title, 'c>' || event_id as contents from events")
def xfdf_roundtrip(spark, sf_dir):
    """Annotations exported as XFDF and imported again."""
    from vellum.sources import xfdf

    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    corner = (k % 7).cast("double")
    a = e.select((k % 1000).alias("doc_id"), F.lit(3).alias("page_index"), F.floor(k / 1000).alias("ordinal"), F.lit("Highlight").alias("subtype"), geo.rect(corner, F.lit(1.0), corner + 2, F.lit(5.0)).alias("rect"), F.concat("event_type", F.lit('"<&')).alias("title"), F.concat(F.lit("c>"), k.cast("string")).alias("contents"))
    other = a.limit(0).withColumn("subtype", F.lit("Widget"))
    back = xfdf.import_xfdf(xfdf.export_xfdf(a.unionByName(other)))
    return back.select("doc_id", "ordinal", "subtype", "page_index", F.col("rect.l").alias("l"), "title", "contents")


@query("""select p_partkey, regexp_replace(translate(p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]', '', 'g') || regexp_replace(p_name, '[^a-z ]', '', 'g') || '|fi' two,
  regexp_replace(p_name, '[a-m]', '', 'g') as one from part""")
def cmap_decode(spark, sf_dir):
    """Two-byte codes of a type's capitals (a range), of a name's letters (a range and an array) and a ligature, with codes that the map
    does not have, which vanish whole; one-byte codes of the name, of which a range has empty texts and the others pass."""
    from vellum.sources import cmap

    wide = """1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfrange <0041> <005A> <0061> <0161> <017A> [""" + " ".join(f"<{k:04X}>" for k in range(0x61, 0x7B)) + """] endbfrange
3 beginbfchar <0120> <0020> <0010> <00660069> <0011> <007C> endbfchar"""
    narrow = "1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <61> <6D> [" + "<>" * 13 + "] endbfrange"
    codes = lambda c, high: F.array_join(F.transform(F.split(c, ""), lambda x: F.concat(F.lit(high), F.hex(F.encode(x, "UTF-8")))), "")
    data = F.unhex(F.concat(codes(F.col("p_type"), "00"), codes(F.col("p_name"), "01"), F.lit("00110010FFFE3000")))
    return table(spark, sf_dir, "part").select("p_partkey", cmap.decode(data, F.lit(wide)).alias("two"), cmap.decode(F.encode("p_name", "UTF-8"), F.lit(narrow)).alias("one"))


@query(f"with {GRID}, {LINES.format(c='ch')}, dt as (select doc_id, string_agg(coalesce(t, ''), ' ' order by page_index) t, count(*) n from pgs left join ptx using (doc_id, page_index) group by doc_id) select doc_id, 'pages' || chr(9) || n || chr(10) || 'page_text' || chr(9) || regexp_replace(t, '[\\t\\r\\n]', ' ', 'g') report from dt")
def inspector_report(spark, sf_dir):
    """A tab-separated report of each document; white space in values becomes a blank."""
    docs = docs_of(spark, sf_dir)
    pages = grid.pages(docs)
    text = layout.document_text(pages, layout.page_text(grid.paged(docs)))
    n = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return text.join(n, "doc_id").select("doc_id", F.concat(F.lit("pages\t"), F.col("n").cast("string"), F.lit("\npage_text\t"), F.regexp_replace("text", "[\t\r\n]", " ")).alias("report"))


@query("select doc_id, sha256(text[1:20] || text[41:]) digest from documents")
def signature_digest(spark, sf_dir):
    """The digest of all but a signature's own range (characters 21 to 40 here): two ranges, the second to the end of the text."""
    d = docs_of(spark, sf_dir)
    return d.select("doc_id", F.sha2(F.concat(F.substring("text", 1, 20), F.expr("substring(text, 41)")), 256).alias("digest"))


@query("select p_partkey, text, marked, mcid::int mcid from part, lateral (values (p_type, ['P'], p_partkey * 2), (p_name, ['P', 'Span'], p_partkey * 2 + 1)) v(text, marked, mcid)")
def marked_content(spark, sf_dir):
    """Chunks with the marked spans open around them and the number of the innermost, from streams built of each row."""
    from vellum.sources import content

    k = F.col("p_partkey")
    parts = [F.lit("/P <</MCID "), k * 2, F.lit(">> BDC BT /F1 9 Tf "), st.escape_literal(F.col("p_type")), F.lit(" Tj ET /Span <</MCID "), k * 2 + 1, F.lit(">> BDC BT "), st.escape_literal(F.col("p_name")), F.lit(" Tj ET EMC EMC")]
    p = table(spark, sf_dir, "part").select("p_partkey", F.encode(F.concat(*(x.cast("string") for x in parts)), "UTF-8").alias("content"))
    return content.content_chunks(p).select("p_partkey", "text", "marked", "mcid")


# --- whole files: side tables, revisions, signatures, rules ---------------------------------------------------------------------

TURNS = "tn as (select conv_id doc_id, turn, role, text, (row_number() over (partition by conv_id order by turn) - 1)::int k, count(*) over (partition by conv_id)::int n from conversations)"


def turns_of(spark, sf_dir) -> DataFrame:
    """doc_id and a conversation's turns in order: k, role, text."""
    c = table(spark, sf_dir, "conversations")
    gathered = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return gathered.select("doc_id", F.transform("t", lambda x, k: F.struct(k.alias("k"), x["role"].alias("role"), x["text"].alias("text"))).alias("t"))


def conversation_files(spark, sf_dir, **columns) -> DataFrame:
    """A file a conversation, a page a turn. columns: further columns of the description, made from t."""
    from vellum.sources import authoring

    t = turns_of(spark, sf_dir)
    shown = lambda x: F.concat(F.lit("BT /F1 10 Tf 1 0 0 1 36 700 Tm "), st.escape_literal(F.regexp_replace(x["text"], "\\s+", " ")), F.lit(" Tj ET"))
    pages = F.transform("t", lambda x: F.struct(shown(x).alias("content"), (F.lit(90) * (x["k"] % 4)).alias("rotation"), F.when(x["k"] % 2 == 0, F.concat(F.lit("BT /F1 8 Tf ("), x["role"], F.lit(") Tj ET"))).alias("form")))
    info = F.create_map(F.lit("Title"), F.concat(F.lit("conversation "), F.col("doc_id").cast("string")))
    return authoring.write_documents(t.select("doc_id", pages.alias("pages"), info.alias("info"), *(c.alias(n) for n, c in columns.items())))


def over_turns(make):
    return F.transform("t", lambda x: F.struct(*(v.alias(n) for n, v in make(x).items())))


@query(f"with {TURNS} select doc_id, k seq, role || ' ' || k as title, case when k > 0 and role = 'assistant' then 1 else 0 end depth, k page_index, true is_open from tn")
def pdf_outlines(spark, sf_dir):
    """Outlines written and read: an assistant's turn under the one before it, each with its page."""
    from vellum.sources import pdf

    rows = over_turns(lambda x: {"title": F.concat(x["role"], F.lit(" "), x["k"].cast("string")), "depth": F.when(x["role"] == "assistant", 1).otherwise(0), "page": x["k"]})
    return pdf.read_outlines(conversation_files(spark, sf_dir, outlines=rows)).drop("error")


@query(f"with {TURNS} select doc_id, k page_index, case when k < 2 then ['i', 'ii'][k + 1] else 'T-' || (k + 3) end as label from tn")
def pdf_labels(spark, sf_dir):
    """Label ranges written and read, and each page's label from them."""
    from vellum.sources import pdf

    ranges = F.array(*(F.struct(F.lit(a).alias("first_page"), F.lit(s).alias("style"), F.lit(p).alias("prefix"), F.lit(n).alias("start_number")) for a, s, p, n in ((0, "r", None, 1), (2, "D", "T-", 5))))
    files = conversation_files(spark, sf_dir, labels=ranges)
    return pg.labels(pdf.read_pages(files).select("doc_id", "page_index"), pdf.read_labels(files).drop("error"))


@query(f"with {TURNS} select doc_id, k page_index, 0 ordinal, case when k % 2 = 0 then 'Text' else 'Link' end subtype, [k, 1, k + 20, 11]::double[] rect, text contents, role title, (k % 3 * 4)::int flags, case when k % 2 = 1 then 'URI' end as action, case when k % 2 = 1 then 'http://x/' || k else '' end uri, k % 5 = 0 has_appearance from tn")
def pdf_annotations(spark, sf_dir):
    """Notes and links written and read, a page's each."""
    from vellum.sources import pdf

    k = lambda x: x["k"].cast("double")
    rows = over_turns(lambda x: {"page": x["k"], "subtype": F.when(x["k"] % 2 == 0, "Text").otherwise("Link"), "l": k(x), "b": F.lit(1.0), "r": k(x) + 20, "t": F.lit(11.0), "contents": x["text"], "title": x["role"], "flags": x["k"] % 3 * 4, "uri": F.when(x["k"] % 2 == 1, F.concat(F.lit("http://x/"), x["k"].cast("string"))), "appearance": x["k"] % 5 == 0})
    return pdf.read_annotations(conversation_files(spark, sf_dir, annotations=rows)).select("doc_id", "page_index", "ordinal", "subtype", "rect", "contents", "title", "flags", "action", "uri", "has_appearance")


@query(f"with {TURNS} select doc_id, 'turn.' || role || '.' || k as name, 'Tx' ft, (k % 2)::bigint ff, text v, k page_index from tn")
def pdf_fields(spark, sf_dir):
    """Field trees written and read: full names, inherited entries, values, the widgets' pages."""
    from vellum.sources import pdf

    rows = over_turns(lambda x: {"name": F.concat(F.lit("turn."), x["role"], F.lit("."), x["k"].cast("string")), "ft": F.lit("Tx"), "ff": x["k"] % 2, "v": x["text"], "page": x["k"], "l": F.lit(10.0), "b": F.lit(10.0), "r": F.lit(90.0), "t": F.lit(24.0)})
    nodes = pdf.read_fields(conversation_files(spark, sf_dir, fields=rows))
    typed = nodes.select("doc_id", F.col("num").cast("bigint").alias("num"), F.col("parent").cast("bigint").alias("parent"), "partial", "ft", F.col("ff").cast("bigint").alias("ff"), "v")
    widgets = nodes.select("doc_id", F.col("num").cast("bigint").alias("num"), F.lit(0).alias("ordinal"), "page_index")
    return forms.page_of_field(forms.hierarchy(typed), widgets).select("doc_id", "name", "ft", "ff", "v", "page_index")


@query(f"with {TURNS} select doc_id, '<x:xmpmeta xmlns:x=\"adobe:ns:meta/\"><dc:title>' || doc_id || '</dc:title></x:xmpmeta>' xmp, doc_id::varchar title from tn where k = 0")
def pdf_xmp(spark, sf_dir):
    """Metadata streams written and read as they lie in the file."""
    from vellum.sources import pdf

    xmp = F.concat(F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><dc:title>'), F.col("doc_id").cast("string"), F.lit("</dc:title></x:xmpmeta>"))
    found = pdf.read_xmp(conversation_files(spark, sf_dir, xmp=xmp)).select("doc_id", F.decode("xmp", "UTF-8").alias("xmp"))
    return found.withColumn("title", F.regexp_extract("xmp", "<dc:title>([^<]*)", 1))


@query(f"with {TURNS} select doc_id, 'turn-' || lpad(k::varchar, 4, '0') || '.txt' as name, 'text/plain' mime, 'Data' relationship, strlen(text)::bigint n_bytes, text from tn")
def pdf_embedded(spark, sf_dir):
    """Attachments written and read through the name tree."""
    from vellum.sources import pdf

    rows = over_turns(lambda x: {"name": F.concat(F.lit("turn-"), F.lpad(x["k"].cast("string"), 4, "0"), F.lit(".txt")), "mime": F.lit("text/plain"), "relationship": F.lit("Data"), "data": F.encode(x["text"], "UTF-8")})
    return pdf.read_embedded(conversation_files(spark, sf_dir, attachments=rows)).select("doc_id", "name", "mime", "relationship", "n_bytes", F.decode("data", "UTF-8").alias("text"))


@query(f"with {TURNS} select doc_id, k page_index, 'Page' scope, 'Im' || k as name, k + 1 width, 2 height, 8 bits, 'DeviceGray' color_space, [10, 20, 10 + k + 1, 60]::double[] box, repeat(lower(hex(chr(65 + k % 26))), 2 * (k + 1)) pixels from tn")
def pdf_images(spark, sf_dir):
    """Images where pages paint them, with the box that the transform gives them and their bytes decoded."""
    from vellum.functions import codecs
    from vellum.sources import pdf

    rows = over_turns(lambda x: {"page": x["k"], "width": x["k"] + 1, "height": F.lit(2), "space": F.lit("DeviceGray"), "data": F.encode(F.repeat(F.char(F.lit(65) + x["k"] % 26), 2 * (x["k"] + 1)), "UTF-8"), "l": F.lit(10.0), "b": F.lit(20.0), "r": F.lit(11.0) + x["k"], "t": F.lit(60.0)})
    found = pdf.read_images(conversation_files(spark, sf_dir, images=rows))
    return found.select("doc_id", "page_index", "scope", "name", "width", "height", "bits", "color_space", "box", F.lower(F.hex(codecs.decode(F.col("data"), ["FlateDecode"]))).alias("pixels"))


@query(f"with {TURNS} select doc_id, k page_index, scope, kind, c n from tn, lateral (values ('Page', 'show_text', 1::bigint), ('Page', 'invoke_object', case when k % 2 = 0 then 1 else 0 end), ('Form1', 'show_text', case when k % 2 = 0 then 1 else 0 end)) v(scope, kind, c) where c > 0")
def pdf_events(spark, sf_dir):
    """Events of pages and of the forms they invoke, by scope."""
    from vellum.sources import pdf

    found = pdf.read_events(conversation_files(spark, sf_dir)).where("kind in ('show_text', 'invoke_object')")
    return found.groupBy("doc_id", "page_index", "scope", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {TURNS} select doc_id, true encrypted, -44 permissions, doc_id % 2 = 0 authenticated, case when doc_id % 2 = 0 then 'conversation ' || doc_id end title, n page_count from tn where k = 0")
def pdf_encrypted(spark, sf_dir):
    """Files under a password (odd ids need the user's, which the reader does not have): what opens is decrypted."""
    from vellum.sources import pdf

    files = conversation_files(spark, sf_dir, owner=F.lit("owner"), user=F.when(F.col("doc_id") % 2 == 0, "").otherwise("secret"))
    return pdf.read_documents(files).select("doc_id", "encrypted", "permissions", "authenticated", F.when(F.col("authenticated"), F.col("title")).alias("title"), "page_count")


@query(f"with {TURNS} select doc_id, 'conversation ' || doc_id title, n page_count from tn where k = 0")
def pdf_password(spark, sf_dir):
    """The same files all opened with the owner's password."""
    from vellum.sources import pdf

    files = conversation_files(spark, sf_dir, owner=F.lit("owner"), user=F.lit("secret"))
    return pdf.read_documents(files, pdf.Limits(password=b"owner")).where("authenticated").select("doc_id", "title", "page_count")


@query(f"with {TURNS} select doc_id, key, value from tn, lateral (values ('Info', (3 + 2 * n + (n + 1) // 2 + 1) || ' 0 R'), ('Root', '1 0 R'), ('Size', (3 + 2 * n + (n + 1) // 2 + 2)::varchar)) v(key, value) where k = 0")
def pdf_trailer(spark, sf_dir):
    """The trailer's entries as they would be written again."""
    from vellum.sources import pdf

    return pdf.read_trailer(conversation_files(spark, sf_dir)).drop("error")


@query(f"with {TURNS} select doc_id, kind, c from tn, lateral (values ('free', 1::bigint), ('uncompressed', (4 + 2 * n + (n + 1) // 2)::bigint)) v(kind, c) where k = 0")
def pdf_xref(spark, sf_dir):
    """Cross-reference entries by kind."""
    from vellum.sources import pdf

    return pdf.read_xref(conversation_files(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("c"))


@query(f"with {TURNS} select doc_id, case when doc_id % 3 = 0 then 'conversation ' || doc_id else 'revised ' || n end title, n page_count, doc_id % 3 <> 0 grown from tn where k = 0")
def pdf_revisions(spark, sf_dir):
    """Revisions appended to files: the old bytes stay, the new title is read, a document without a change stays as it is."""
    from vellum.sources import authoring, pdf

    files = conversation_files(spark, sf_dir)

    def change(row: dict, f: pdf.File) -> dict:
        return {} if row["doc_id"] % 3 == 0 else {f.trailer["Info"].num: {"Title": f"revised {len(list(f.pages()))}"}}

    revised = authoring.revise(files, change)
    old = files.select("doc_id", F.col("content").alias("old"))
    grown = revised.join(old, "doc_id").select("doc_id", ((F.length("content") > F.length("old")) & (F.expr("substring(content, 1, length(old))") == F.col("old"))).alias("grown"))
    return pdf.read_documents(revised).select("doc_id", "title", "page_count").join(grown, "doc_id")


@query(f"with {TURNS}, h as (select doc_id, k page_index, unnest(range(1, len(string_split_regex({sql_lower('text')}, 'the')))) i from tn) select doc_id, page_index, 'Highlight' subtype, 'the' contents, count(*)::bigint n from h group by all")
def highlight_files(spark, sf_dir):
    """A keyword found on the pages of files and added to them as highlights, in a revision; read again."""
    from vellum.sources import authoring, pdf

    files = conversation_files(spark, sf_dir)
    chunks = pdf.read_chunks(files).where("error is null")
    found = edits.highlights(search.find(chunks.where("font_size = 10"), "the"))
    marked = authoring.annotate(files, found.select("doc_id", "page_index", "subtype", "rect", F.lower("contents").alias("contents")))
    return pdf.read_annotations(marked).groupBy("doc_id", "page_index", "subtype", "contents").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {TURNS} select doc_id, 'Signature' field, 'signer ' || doc_id as name, true signed, case doc_id % 3 when 0 then 'digest_differs' when 1 then 'digest_matches' else 'out_of_bounds' end status from tn where k = 0")
def pdf_signatures(spark, sf_dir):
    """Signatures with the digest of the file around them: unharmed, changed afterwards, and cut off."""
    from vellum.sources import pdf

    files = conversation_files(spark, sf_dir, signer=F.concat(F.lit("signer "), F.col("doc_id").cast("string")))
    k = F.col("doc_id") % 3
    harmed = F.when(k == 0, F.concat(F.encode(F.lit("%PDF-1.6"), "UTF-8"), F.expr("substring(content, 9)"))).when(k == 1, F.col("content")).otherwise(F.expr("substring(content, 1, length(content) - 2)"))
    return pdf.read_signatures(files.select("doc_id", harmed.alias("content"))).select("doc_id", "field", "name", "signed", "status")


def audited_files(spark, sf_dir) -> DataFrame:
    """A file a part, with what profiles ask for present, wrong or absent by number (k) and size (n)."""
    from vellum.sources import authoring

    k, n = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    li = lambda tag, c: F.concat(F.lit(f"<dc:{tag}><rdf:Alt><rdf:li>"), c, F.lit(f"</rdf:li></rdf:Alt></dc:{tag}>"))
    xmp = F.concat(F.lit("<x:xmpmeta><rdf:RDF><pdfaid:part>"), text(1 + k % 2), F.lit("</pdfaid:part><pdfaid:conformance>A</pdfaid:conformance>"), F.when(k % 4 == 1, "<pdfuaid:part>1</pdfuaid:part>").otherwise(""), li("title", F.concat(F.lit("T"), text(n))), F.when(k % 5 > 0, li("language", F.lit("en-US"))).otherwise(""), F.lit("</rdf:RDF></x:xmpmeta>"))
    head = lambda size, space: F.concat(F.lpad(F.hex(size), 8, "0"), F.lit("00" * 12), F.hex(F.encode(space, "UTF-8")), F.lit("00" * 16 + "61637370" + "00" * 88))
    profile = F.when(k % 8 == 2, F.lit(None).cast("binary")).otherwise(F.unhex(head(F.when(k % 8 == 4, 99).otherwise(128), F.when(k % 8 == 5, F.lit("GRAY")).otherwise(F.lit("RGB ")))))
    intent = F.when(k % 8 > 0, F.struct(F.when(k % 8 != 1, "sRGB").alias("identifier"), F.when(k % 8 == 3, 2).otherwise(3).alias("components"), profile.alias("profile")))
    body = F.concat(F.when(k % 3 > 0, "/P <</MCID 0>> BDC ").otherwise(""), F.lit("BT /T0 9 Tf (x) Tj ET"), F.when((k % 3 > 0) & (k % 7 > 0), " EMC").otherwise(""))
    page = F.struct(body.alias("content"), F.when(k % 2 == 0, "S").alias("tabs"), F.when(k % 4 == 0, 0).alias("struct_parents"))
    note = F.struct(F.lit(0).alias("page"), F.element_at(F.array(*map(F.lit, ("Link", "Movie", "Text"))), (k % 3 + 1).cast("int")).alias("subtype"), F.lit(0.0).alias("l"), F.lit(0.0).alias("b"), F.lit(9.0).alias("r"), F.lit(9.0).alias("t"), F.when(k % 2 == 0, "about").alias("contents"), (n % 8).alias("flags"), F.when(k % 9 == 0, "JavaScript").alias("action"))
    element = lambda role, parent, alt=None: F.struct(F.lit(role).alias("role"), F.lit(parent).cast("int").alias("parent"), F.lit(alt).cast("string").alias("alt"))
    trees = F.array(
        F.array(element("H2", None), element("H4", None), element("Figure", None)), F.array(element("L", None), element("LI", 0), element("LBody", 1), element("Figure", None, "a")),
        F.array(element("Table", None), element("TR", 0), element("TH", 1), element("TD", None)), F.array(element("Own", None), element("Other", None), element("L", None)), F.lit(None),
    )
    attached = F.when(k % 10 == 0, F.array(F.struct(F.lit("a.txt").alias("name"), F.when(k % 20 == 0, "text/plain").alias("mime"), F.when(k % 30 == 0, "Data").alias("relationship"), F.encode("p_name", "UTF-8").alias("data"))))
    parts = authoring.spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "p_partkey")
    return authoring.write_documents(parts.select(
        k.alias("doc_id"), F.when(k % 50 == 49, F.array().cast("array<struct<content:string,tabs:string,struct_parents:int>>")).otherwise(F.array(page)).alias("pages"), F.when(k % 4 == 0, "1.4").otherwise("1.7").alias("version"),
        F.when(k % 3 == 1, "en-US").when(k % 3 == 2, "no tag!").alias("lang"), F.when(k % 2 == 0, k % 4 == 0).alias("marked"), (k % 5 == 0).alias("display_title"),
        F.when(k % 7 > 0, F.create_map(F.lit("Title"), F.concat(F.lit("T"), text(F.when(k % 7 == 1, n + 1).otherwise(n))))).alias("info"), F.when(k % 6 > 0, xmp).alias("xmp"), intent.alias("intent"),
        F.array(F.struct((k % 2 == 0).alias("embedded"), (k % 3 == 0).alias("unicode"))).alias("fonts"), F.when(k % 50 < 49, F.array(note)).alias("annotations"), attached.alias("attachments"),
        F.get(trees, (k % 5).cast("int")).alias("elements"), F.create_map(F.lit("Own"), F.lit("P")).alias("roles"), F.when(k % 11 == 0, "o").alias("owner"), F.when(k % 11 == 0, "").alias("user"),
    ))


def audit_sql(rows: list[tuple[str, str, str]]) -> str:
    """(code, condition on k and n, severity) of every issue that the files are made to have."""
    parts = [f"select k doc_id, '{code}' code, '{severity}' severity, {times}::bigint c from f where {test}" for code, test, severity, times in ((*x, 1)[:4] if len(x) == 3 else x for x in rows)]
    return "with f as (select p_partkey k, p_size n, p_partkey % 50 < 49 page, p_partkey % 5 < 4 tree from part) " + " union all ".join(parts)


E, W = "error", "warning"
STRUCTURE_ISSUES = [
    ("PDFUA-ROLE-001", "k % 5 = 3", E), ("PDFUA-ALT-001", "k % 5 = 0", E), ("PDFUA-SEMANTIC-002", "k % 5 = 2", E), ("PDFUA-TABLE-001", "k % 5 = 2", E), ("PDFUA-LIST-001", "k % 5 = 3", E),
    ("PDFUA-HEADING-002", "k % 5 = 0", W), ("PDFUA-HEADING-003", "k % 5 = 0", W), ("PDFUA-PAGE-001", "tree and page and k % 4 > 0", E), ("PDFUA-PAGE-002", "tree and page and k % 2 > 0", E),
    ("PDFUA-PARENTTREE-016", "tree and page and k % 4 = 0", E), ("PDFUA-MCID-001", "tree and page and k % 3 > 0 and k % 7 = 0", E), ("PDFUA-CONTENT-001", "tree and page and k % 3 = 0", E), ("PDFUA-ANNOT-001", "tree and page", E),
    ("PDFUA-ANNOT-002", "tree and page and k % 2 = 1", E), ("PDFUA-ANNOT-004", "tree and page and (n % 8) & 3 <> 0", E), ("PDFUA-LINK-001", "tree and page and k % 3 = 0 and k % 9 > 0", E),
]
SHARED_ISSUES = [("PDF-PAGE-001", "not page", E), ("META-XMP-001", "k % 6 = 0", E), ("PDFA-FONT-002", "page and k % 2 = 1", E), ("FONT-UNICODE-001", "page and k % 3 > 0", E), ("VALIDATION-PROFILE", "true", "info")]
A_ISSUES = [
    ("PDFA-ENCRYPT-001", "k % 11 = 0", E), ("PDFA-VERSION-001", "k % 4 > 0", E), ("PDFA-OUTPUT-001", "k % 8 = 0", E), ("PDFA-OUTPUT-008", "k % 8 = 1", E), ("PDFA-OUTPUT-003", "k % 8 = 2", E), ("PDFA-OUTPUT-004", "k % 8 = 3", E),
    ("PDFA-OUTPUT-006", "k % 8 = 4", E), ("PDFA-OUTPUT-007", "k % 8 in (3, 5)", E), ("PDFA-TAGGED-001", "not tree", E), ("PDFA-LANG-001", "k % 3 = 0", E), ("PDFA-METADATA-001", "k % 6 > 0 and k % 2 = 1", E), ("PDFA-XMP-EXT-001", "k % 6 > 0 and k % 4 = 1", E),
    ("PDFA-ANNOT-001", "page and k % 3 = 1", E), ("PDFA-ANNOT-002", "page and (n % 8) & 4 = 0", E), ("PDFA-ANNOT-003", "page and (n % 8) & 3 <> 0", E), ("PDFA-ACTION-001", "page and k % 9 = 0", E),
    ("PDFA-AF-001", "k % 10 = 0", E), ("PDFA-AF-002", "k % 10 = 0 and k % 30 > 0", E), ("PDFA-AF-007", "k % 10 = 0 and k % 20 > 0", E), ("PDFA-AF-012", "k % 10 = 0", E),
]
UA_ISSUES = [
    ("PDFUA-VERSION-001", "k % 4 = 0", E), ("PDFUA-TAG-001", "not tree", E), ("PDFUA-MARKED-001", "k % 4 > 0", E), ("PDFUA-LANG-001", "k % 3 = 0", E), ("PDFUA-TITLE-003", "k % 5 > 0", E), ("PDFUA-METADATA-001", "k % 6 > 0 and k % 4 <> 1", E),
    ("PDFUA-TITLE-001", "k % 6 > 0 and k % 7 = 0", E), ("PDFUA-TITLE-002", "k % 6 > 0 and k % 7 = 1", E), ("PDFUA-LANG-002", "k % 6 > 0 and k % 5 = 0", E), ("PDFUA-LANG-003", "k % 6 > 0 and k % 5 > 0 and k % 3 <> 1", E), ("PDFUA-LANG-004", "k % 6 > 0 and k % 3 = 2", E),
]


def audited(spark, sf_dir, profile: str) -> DataFrame:
    from vellum.operators import conformance

    found = conformance.validate(conformance.facts(audited_files(spark, sf_dir)), profile)
    return found.groupBy("doc_id", "code", "severity").agg(F.count(F.lit(1)).alias("c"))


@query(audit_sql(SHARED_ISSUES + A_ISSUES + STRUCTURE_ISSUES))
def audit_archive(spark, sf_dir):
    """Files against the strictest level of the first archive profile: catalog, intents, metadata, fonts, annotations, actions, files, tags."""
    return audited(spark, sf_dir, "PDF/A-1A")


@query(audit_sql(SHARED_ISSUES + UA_ISSUES + STRUCTURE_ISSUES))
def audit_accessible(spark, sf_dir):
    """The same files against the accessibility profile."""
    return audited(spark, sf_dir, "PDF/UA-1")


@query(audit_sql([("PDF-PAGE-001", "not page", E), ("VALIDATION-PROFILE", "true", "info")]))
def audit_plain(spark, sf_dir):
    """The same files against the file format alone."""
    return audited(spark, sf_dir, "PDF 1.7")


# --- drawing, flowing text, bitmaps, files changed ------------------------------------------------------------------------------


def sql_number(x: str) -> str:
    return f"regexp_replace(({x})::decimal(18, 4)::varchar, '\\.?0+$', '')"


def sql_command(op: str, *args: str) -> str:
    return " || ' ' || ".join([*map(sql_number, args), f"'{op}'"])


def sql_together(*parts: str) -> str:
    return "(" + ") || chr(10) || (".join(parts) + ")"


X, Y, R = "(p_size * 1.5)::double", "(p_partkey % 700)::double", "(p_size / 4.0)::double"
KAPPA = "0.5522847498::double"
CURVES = ((f"{X} + {R}", f"{Y} + {R} * {KAPPA}", f"{X} + {R} * {KAPPA}", f"{Y} + {R}", X, f"{Y} + {R}"), (f"{X} - {R} * {KAPPA}", f"{Y} + {R}", f"{X} - {R}", f"{Y} + {R} * {KAPPA}", f"{X} - {R}", Y), (f"{X} - {R}", f"{Y} - {R} * {KAPPA}", f"{X} - {R} * {KAPPA}", f"{Y} - {R}", X, f"{Y} - {R}"), (f"{X} + {R} * {KAPPA}", f"{Y} - {R}", f"{X} + {R}", f"{Y} - {R} * {KAPPA}", f"{X} + {R}", Y))
SHAPES = sql_together("'q'", sql_command("rg", "0.5", "p_size / 50.0", "0"), sql_command("w", "1.25"), "'1 J'", "'0 j'", "'[3 2] 0 d'", sql_command("re", X, Y, "10", "20.5"), "'f'", sql_command("m", "0", "0"), sql_command("l", X, Y), "'S'", sql_command("m", f"{X} + {R}", Y), *(sql_command("c", *c) for c in CURVES), "'B'", "'Q'")


@query(f"select p_partkey, {SHAPES} commands from part")
def canvas_shapes(spark, sf_dir):
    """Colours, line styles, rectangles, lines and circles as drawing commands."""
    from vellum.functions import canvas

    p = table(spark, sf_dir, "part")
    x, y, r = F.col("p_size") * 1.5, (F.col("p_partkey") % 700).cast("double"), F.col("p_size") / 4.0
    body = canvas.saved(canvas.fill_color(0.5, F.col("p_size") / 50.0, 0.0), canvas.line_style(1.25, cap=1, dash=(3.0, 2.0)), canvas.rectangle(x, y, 10.0, 20.5, "f"), canvas.line(0.0, 0.0, x, y), canvas.circle(x, y, r, "B"))
    return p.select("p_partkey", body.alias("commands"))


@query(f"select p_partkey, p_name as text, {X} x0, {Y} y, ['P'] marked, (p_partkey % 9)::int mcid, 9.5::double font_size from part")
def canvas_text(spark, sf_dir):
    """Text drawn within marks, an image and an artifact beside it, found again by the content reader."""
    from vellum.functions import canvas
    from vellum.sources import content

    x, y = F.col("p_size") * 1.5, (F.col("p_partkey") % 700).cast("double")
    body = canvas.together(canvas.artifact(canvas.rectangle(0.0, 0.0, 5.0, 5.0)), canvas.image("Im0", x, y, 10.0, 10.0), canvas.marked("P", F.col("p_partkey") % 9, canvas.text(x, y, 9.5, F.col("p_name"))))
    p = table(spark, sf_dir, "part").select("p_partkey", F.encode(body, "UTF-8").alias("content"))
    return content.content_chunks(p).select("p_partkey", "text", "x0", "y", "marked", "mcid", "font_size")


@query("""with p as (select doc_id, ls, unnest(range(1, len(ls) + 1)) i from (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents)),
w as (select doc_id, i, list_filter(string_split(ls[i], ' '), lambda x: x <> '') ws from p),
f as (select doc_id, i, case when len(ws) = 0 then [''] else string_split(list_reduce(ws, lambda a, x: case when length(regexp_extract(a, '[^\n]*$')) + 1 + length(x) <= 72 then a || ' ' || x else a || chr(10) || x end), chr(10)) end fl from w),
l as (select doc_id, i, unnest(range(1, len(fl) + 1)) j, unnest(fl) t from f),
n as (select doc_id, (row_number() over (partition by doc_id order by i, j) - 1)::int line_no, t as text from l)
select doc_id, line_no, (line_no // 100)::int page_index, (line_no // 50 % 2)::int as column, line_no % 50 as row, text from n""")
def flow_paragraphs(spark, sf_dir):
    """Paragraphs wrapped to lines in two columns a page."""
    from vellum.operators import flow

    return flow.flow_paragraphs(docs_of(spark, sf_dir), 72, 50, 2)


@query(f"with {TURNS} select doc_id, k page_index, 'conversation ' || doc_id as header, 'page ' || (k + 1) || ' of ' || n as footer from tn")
def page_headers(spark, sf_dir):
    """Headers and footers with page numbers."""
    from vellum.operators import flow

    t = turns_of(spark, sf_dir).select("doc_id", F.explode("t").alias("x")).select("doc_id", F.col("x.k").alias("page_index"))
    return flow.headers_and_footers(t, F.concat(F.lit("conversation "), F.col("doc_id").cast("string")))


@query("""with i as (select distinct l_orderkey doc_id, l_linenumber::int seq, (l_linenumber * 7 + l_orderkey) % 3 as level from lineitem),
n as (select a.doc_id, a.seq, a.level, (select count(*) from i b where b.doc_id = a.doc_id and b.level = a.level and b.seq <= a.seq and not exists (select 1 from i c where c.doc_id = a.doc_id and c.level < a.level and c.seq > b.seq and c.seq <= a.seq)) as number from i a)
select doc_id, seq, level, number::int number, case level when 0 then number || '.' when 1 then chr(96 + number::int) || '.' else ['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii'][number] || '.' end label from n""")
def nested_lists(spark, sf_dir):
    """Items of three levels numbered anew after each item above them, in the levels' styles."""
    from vellum.operators import flow

    items = items_of(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("seq"), ((F.col("l_linenumber") * 7 + F.col("l_orderkey")) % 3).alias("level")).distinct()
    return flow.number_items(items).select("doc_id", "seq", "level", "number", "label")


@query("""with c as (select c_nationkey doc_id, c_custkey, c_custkey::varchar as key, c_name as name, c_mktsegment as segment from customer),
w as (select doc_id, greatest(max(length(key)), 3) a, greatest(max(length(name)), 4) b, greatest(max(length(segment)), 7) d from c group by doc_id),
n as (select *, row_number() over (partition by doc_id order by c_custkey) - 1 n from c),
r as (select doc_id, (n // 20)::int page_index, (n % 20 + 1)::int line, key, name, segment from n union all select distinct doc_id, (n // 20)::int, 0, 'key', 'name', 'segment' from n)
select doc_id, page_index, line, rtrim(rpad(key, a::int, ' ') || ' | ' || rpad(name, b::int, ' ') || ' | ' || rpad(segment, d::int, ' ')) as text from r join w using (doc_id)""")
def flow_tables(spark, sf_dir):
    """A table a nation: columns as wide as their widest cell, pages of twenty rows under a repeated header."""
    from vellum.operators import flow

    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("row"), F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return flow.flow_table(c, ["key", "name", "segment"], 20)


def bitmaps_of(spark, sf_dir) -> DataFrame:
    """A small bitmap a part: byte i is (31 k + 17 i) mod 256."""
    k, w, h = F.col("p_partkey"), (F.col("p_size") % 7 + 1).cast("int"), (F.col("p_partkey") % 5 + 1).cast("int")
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), w * h * 3 - 1), lambda i: F.lpad(F.hex((k * 31 + i * 17) % 256), 2, "0")), ""))
    return table(spark, sf_dir, "part").select("p_partkey", F.struct(w.alias("width"), h.alias("height"), data.alias("data")).alias("b"))


BYTES = "b as (select p_partkey k, (p_size % 7 + 1)::int w, (p_partkey % 5 + 1)::int h from part), d as (select *, list_transform(range(w * h * 3), lambda i: ((k * 31 + i * 17) % 256)::int) v from b)"


def sql_bytes(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda y: printf('%02x', y)), '')"


@query(f"with {BYTES} select k p_partkey, lower(hex(encode('P6' || chr(10) || w || ' ' || h || chr(10) || '255' || chr(10)))) || {sql_bytes('v')} ppm, {sql_bytes('v')} png, {sql_bytes('v')} bmp, (54 + h * ((3 * w + 3) // 4 * 4))::int bmp_size from d")
def bitmap_encodings(spark, sf_dir):
    """Bitmaps as PPM byte for byte, and through PNG and BMP and back."""
    from vellum.functions import bitmaps

    low = lambda c: F.lower(F.hex(c))
    b = bitmaps_of(spark, sf_dir).withColumn("bmp", bitmaps.encode(F.col("b"), "bmp")).withColumn("png", bitmaps.encode(F.col("b"), "png"))
    return b.select("p_partkey", low(bitmaps.encode(F.col("b"), "ppm")).alias("ppm"), low(bitmaps.decode(F.col("png"), "png")["data"]).alias("png"), low(bitmaps.decode(F.col("bmp"), "bmp")["data"]).alias("bmp"), F.length("bmp").alias("bmp_size"))


PIXEL = "list_transform(range({n} * 3), lambda i: v[1 + 3 * ({at}) + i % 3])"


@query(f"""with {BYTES} select k p_partkey, len(list_filter(range(w * h), lambda p: v[3 * p + 1] < 128 and v[3 * p + 2] < 128 and v[3 * p + 3] < 128))::bigint dark,
{sql_bytes(PIXEL.format(n='w * h', at='(i // 3) // w * w + w - 1 - (i // 3) % w'))} mirrored, {sql_bytes(PIXEL.format(n='w * h', at='(h - 1 - (i // 3) // w) * w + (i // 3) % w'))} flipped,
{sql_bytes(PIXEL.format(n='w * h', at='(h - 1 - (i // 3) % h) * w + (i // 3) // h'))} turned, {sql_bytes(PIXEL.format(n='4', at='((i // 3) // 2 * h // 2) * w + (i // 3) % 2 * w // 2'))} small,
{sql_bytes('list_transform(range(w * h * 3), lambda i: floor((v[i + 1] / 255.0::double) * (v[w * h * 3 - i] / 255.0::double) * 255 + 0.5)::int)')} multiplied from d""")
def bitmap_changes(spark, sf_dir):
    """Dark pixels counted, bitmaps mirrored, flipped, turned, made small, and multiplied with their reverse."""
    from vellum.functions import bitmaps

    b, low = bitmaps_of(spark, sf_dir), lambda c: F.lower(F.hex(c))
    made = lambda what, *args: low(bitmaps.change(F.col("b"), what, *args)["data"])
    backwards = F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex("b.data"), F.lit("(..)"), F.lit(1))), ""))
    return b.select("p_partkey", bitmaps.dark_pixels(F.col("b")).alias("dark"), made("flip_horizontal").alias("mirrored"), made("flip_vertical").alias("flipped"), made("rotate", 1).alias("turned"), made("resize", 2, 2).alias("small"), low(bitmaps.blended(F.col("b.data"), backwards, "Multiply")).alias("multiplied"))


@query("select p_partkey, round(0.25 + power(least(1.0, p_size / 40.0), 2) * 0.5, 9) two, round(abs(least(1.0, p_size / 40.0) * 3 - 2), 9) four from part")
def parsed_functions(spark, sf_dir):
    """Functions of types 2 and 4 read from their dictionaries' texts."""
    two, four = F.lit("<</FunctionType 2 /Domain [0 1] /C0 [0.25] /C1 [0.75] /N 2>>"), F.lit("<</FunctionType 4 /Domain [0 1] /Range [0 9]>> { 3 mul 2 sub abs }")
    x = F.col("p_size") / 40.0
    return table(spark, sf_dir, "part").select("p_partkey", F.round(geo.parsed_function(two, x)[0], 9).alias("two"), F.round(geo.parsed_function(four, x)[0], 9).alias("four"))


@query("select event_id, case when event_id % 3 < 2 then event_type else '' end v from events")
def string_or_name(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("string"), F.lit("name"), F.lit("integer")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", st.string_or_name(kind, F.col("event_type")).alias("v"))


@query(f"with {TURNS} select doc_id, k page_index, text, 0::bigint left_over from tn")
def pdf_flatten(spark, sf_dir):
    """Fields drawn into their pages: the values are page text, no widget is left."""
    from vellum.sources import authoring, pdf

    rows = over_turns(lambda x: {"name": F.concat(F.lit("f"), x["k"].cast("string")), "ft": F.lit("Tx"), "v": x["text"], "page": x["k"], "l": F.lit(10.0), "b": F.lit(10.0), "r": F.lit(90.0), "t": F.lit(24.0), "appearance": F.lit(True)})
    flat = authoring.flatten(conversation_files(spark, sf_dir, fields=rows))
    left = pdf.read_annotations(flat).groupBy("doc_id").agg(F.count("subtype").alias("n")).unionByName(pdf.read_fields(flat).groupBy("doc_id").agg(F.count("num").alias("n"))).groupBy("doc_id").agg(F.sum("n").alias("n"))
    shown = pdf.read_chunks(flat).where("y < 20 and font_size > 9 and font_size < 10").select("doc_id", "page_index", "text")
    return shown.join(left, "doc_id", "left").select("doc_id", "page_index", "text", F.coalesce("n", F.lit(0)).alias("left_over"))


@query(f"with {TURNS} select doc_id, k page_index, 'DRAFT' as text, 72.0::double x0, 72.0::double y from tn")
def pdf_stamps(spark, sf_dir):
    """A stamp on every page of every file."""
    from vellum.sources import authoring, pdf

    return pdf.read_chunks(authoring.stamp(conversation_files(spark, sf_dir), "DRAFT")).where("font_size = 24").select("doc_id", "page_index", "text", "x0", "y")


@query(f"with {TURNS}, f as (select doc_id, count(distinct role) filter (where k % 2 = 0) forms from tn group by doc_id) select doc_id, 'revised' title, n page_count, (4 + 2 * n + forms)::bigint objects from tn join f using (doc_id) where k = 0")
def pdf_resave(spark, sf_dir):
    """Files with a revision written anew: reachable objects under dense numbers, equal streams (the forms of one role) once."""
    from vellum.sources import authoring, pdf

    revised = authoring.revise(conversation_files(spark, sf_dir), lambda row, f: {f.trailer["Info"].num: {"Title": "revised"}, int(f.trailer["Size"]): {"Unused": True}})
    again = authoring.resave(revised)
    count = pdf.read_objects(again).groupBy("doc_id").agg(F.count("num").alias("objects"))
    return pdf.read_documents(again).select("doc_id", "title", "page_count").join(count, "doc_id")


@query(f"with {GRID}, {INDEX} select doc_id, count(*)::bigint pages, sum(length(t))::bigint characters, sum(strlen(t))::bigint bytes from tx group by doc_id")
def search_statistics(spark, sf_dir):
    """What a search index of all pages would hold."""
    return search.index_statistics(search.search_text(search.spans(chunks_of(spark, sf_dir))))


@query(f"with {GRID}, {INDEX}, {found_sql(LOW, 'ing')}, c as (select doc_id, max(page_index) + 1 n from tx group by doc_id) select doc_id, page_index, match_no, start, ((page_index - 1 + n) % n)::int turn from mt join c using (doc_id)")
def search_from_page(spark, sf_dir):
    """A viewer's search from the second page on, round to the first."""
    found = search.viewer_find(search.spans(chunks_of(spark, sf_dir)), "ing", F.lit(1))
    return found.select("doc_id", "page_index", "match_no", "start", F.col("turn").cast("int").alias("turn"))


@query("select s_suppkey doc_id, 0 page_index, 612 width, 792 height, ((20 + s_suppkey % 7) * 30 - 100 + 1200 + 100 + 200 + 50)::bigint dark from supplier")
def render_pages(spark, sf_dir):
    """Pages rendered at one pixel a point: a light rectangle over a dark one, a ring by the even-odd rule, a clip, a wide line, an image;
    dark pixels counted."""
    from vellum.functions import bitmaps, canvas
    from vellum.sources import authoring, render

    k = F.col("s_suppkey")
    x, y = (k % 50 + 10).cast("double"), (k % 90 + 20).cast("double")
    body = canvas.together(
        canvas.rectangle(x, y, (k % 7 + 20).cast("double"), 30.0, "f"), canvas.saved(canvas.fill_color(0.9, 0.9, 0.9), canvas.rectangle(x + 10, y + 5, 10.0, 10.0, "f")),
        canvas.command("re", 200.0, 200.0, 40.0, 40.0), canvas.rectangle(210.0, 210.0, 20.0, 20.0, "f*"),
        canvas.saved(canvas.rectangle(300.0, 300.0, 10.0, 10.0, "W n"), canvas.rectangle(290.0, 290.0, 100.0, 100.0, "f")),
        canvas.line_style(4.0), canvas.line(100.0, 500.0, 150.0, 500.0),
    )
    image = F.struct(F.lit(0).alias("page"), F.lit(2).alias("width"), F.lit(1).alias("height"), F.lit("DeviceGray").alias("space"), F.unhex(F.lit("00FF")).alias("data"), F.lit(400.0).alias("l"), F.lit(600.0).alias("b"), F.lit(410.0).alias("r"), F.lit(610.0).alias("t"))
    files = authoring.write_documents(authoring.spread(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select(k.alias("doc_id"), F.array(F.struct(body.alias("content"))).alias("pages"), F.array(image).alias("images")))
    return render.render_pages(files, 72, measures={"dark": bitmaps.count_dark}).select("doc_id", "page_index", "width", "height", "dark")


@query(f"with {TURNS} select doc_id, k page_index, 'F1' as name, 'Type1' subtype, 'Helvetica' base_font, '' encoding, null::varchar program, false to_unicode, 0 first_char, 256 widths, 128000.0::double total from tn")
def pdf_fonts(spark, sf_dir):
    """The fonts of pages with their widths."""
    from vellum.sources import pdf

    total = F.aggregate("widths", F.lit(0.0), lambda a, x: a + x).alias("total")
    return pdf.read_fonts(conversation_files(spark, sf_dir)).select("doc_id", "page_index", "name", "subtype", "base_font", "encoding", "program", "to_unicode", "first_char", F.size("widths").alias("widths"), total)


@query(f"with {TURNS} select doc_id, encrypted, case when encrypted then -60 else -1 end permissions, 'conversation ' || doc_id title, n page_count from tn, lateral (values (true), (false)) v(encrypted) where k = 0")
def pdf_protection(spark, sf_dir):
    """Files put under passwords, and taken from under them again."""
    from vellum.sources import authoring, pdf

    shut = authoring.protect(conversation_files(spark, sf_dir), "u", "o", permissions=-60)
    both = pdf.read_documents(shut, pdf.Limits(password=b"u")).unionByName(pdf.read_documents(authoring.unprotect(shut, "o")))
    return both.where("authenticated").select("doc_id", "encrypted", "permissions", "title", "page_count")


@query(f"with {TURNS} select doc_id, 'me' as name, true signed, 'digest_matches' status from tn where k = 0")
def pdf_signing(spark, sf_dir):
    """Signatures added to files in a revision."""
    from vellum.sources import authoring, pdf

    return pdf.read_signatures(authoring.sign(conversation_files(spark, sf_dir), "me")).select("doc_id", "name", "signed", "status")
