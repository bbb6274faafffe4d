"""Registered queries: readers, text functions, chunking, de-identification and the corpus audit."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, corpus, deid, extract, graph, segment
from ..sources import files, records
from ..sources.scratch import shared_dir
from .fixtures import Tables, with_ctes

#: White space that SQL trims; texts of the tables hold no other.
WS = "' ' || chr(9) || chr(10) || chr(13)"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _html_sql() -> str:
    gone = "|".join(["<!--.*?-->", *(f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in (*T.DROPPED, "head"))])
    names = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("#39", "''"), ("nbsp", " "), ("copy", "©"), ("reg", "®"), ("middot", "·"), ("hellip", "…"), ("ndash", "–"), ("mdash", "—"), ("deg", "°"), ("amp", "&"))

    def plain(x: str) -> str:
        for name, char in names:
            x = f"replace({x}, '&{name};', '{char}')"
        return x

    def tidy(x: str) -> str:
        return f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '[ \\t\\r\\f\\v ]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS})"

    title = f"trim(regexp_replace({plain(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title' + chr(92) + 's*>' + chr(39) + ', 1)')}, '\\s+', ' ', 'g'), {WS})"
    body = f"regexp_replace(html, '(?is){gone}', '', 'g')"
    body = f"regexp_replace({body}, '(?i)<!doctype[^>]*>', '', 'g')"
    body = f"regexp_replace({body}, '(?i)<br\\b[^>]*>', chr(10), 'g')"
    body = f"regexp_replace({body}, '(?i)</(td|th)\\s*>', ' | ', 'g')"
    body = f"regexp_replace({body}, '(?i)</?({'|'.join(T.BLOCKS)})\\b[^>]*>', chr(10) || chr(10), 'g')"
    body = tidy(plain(f"regexp_replace({body}, '(?s)</?[a-zA-Z][^>]*>', '', 'g')"))
    body = f"regexp_replace({body}, '(?m)\\s*\\|\\s*$', '', 'g')"
    return f"""WITH p AS (SELECT page_id, {title} AS title, {body} AS body FROM pages)
SELECT page_id, trim(CASE WHEN title <> '' AND NOT starts_with(body, title) THEN title || chr(10) || chr(10) || body ELSE body END, {WS}) AS text FROM p"""


@query(_html_sql())
def html_text(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", T.html_to_text("html").alias("text"))


@query("SELECT page_id, sha256(html) AS text_sha, length(html) AS n FROM pages")
def decode_text(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode("html", "UTF-8"))
    text = T.decode(raw)
    return t.raw("pages").select("page_id", F.sha2(text, 256).alias("text_sha"), F.length(text).cast("long").alias("n"))


@query(f"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\r\\f\\v ]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS})) AS text_sha FROM documents")
def tidy_text(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.sha2(T.tidy("text"), 256).alias("text_sha"))


@query(f"SELECT item_id, regexp_replace(lower(trim(text, {WS})), '\\s+', ' ', 'g') AS term FROM benchmark")
def normalize_terms(t: Tables) -> DataFrame:
    return t.raw("benchmark").select("item_id", T.normalize_term("text").alias("term"))


_DOUBLED = "replace(text, chr(10), chr(10) || ' ' || chr(10))"


@query(f"""SELECT doc_id, unnest(range(len(ps)))::INT AS pos, sha256(unnest(ps)) AS paragraph_sha FROM (
SELECT doc_id, list_filter(list_transform(string_split_regex({_DOUBLED}, '\\n\\s*\\n'), lambda x: trim(x, {WS})), lambda x: x <> '') AS ps FROM documents)""")
def split_paragraphs(t: Tables) -> DataFrame:
    parts = T.paragraphs(F.regexp_replace("text", "\n", "\n \n"))
    return t.raw("documents").select("doc_id", F.posexplode(parts).alias("pos", "p")).select("doc_id", "pos", F.sha2("p", 256).alias("paragraph_sha"))


@query(f"""SELECT doc_id, unnest(range(len(blocks)))::INT AS pos, sha256(unnest(blocks)) AS group_sha FROM (SELECT doc_id, CASE WHEN g.n > 0 THEN list_append(g.blocks, g.cur) ELSE g.blocks END AS blocks FROM (SELECT doc_id, list_reduce(
list_transform(list_filter(list_transform(string_split_regex(text, '[ \\n]+'), lambda x: trim(x, {WS})), lambda x: x <> ''), lambda x: {{'blocks': [x], 'cur': x, 'n': length(x)}}),
lambda a, x: CASE WHEN a.n = 0 THEN {{'blocks': a.blocks, 'cur': x.cur, 'n': x.n}} WHEN a.n + x.n > 1500 THEN {{'blocks': list_append(a.blocks, a.cur), 'cur': x.cur, 'n': x.n}} ELSE {{'blocks': a.blocks, 'cur': a.cur || chr(10) || chr(10) || x.cur, 'n': a.n + x.n}} END,
{{'blocks': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT}}) AS g FROM documents))""")
def group_paragraphs(t: Tables) -> DataFrame:
    """Every word a paragraph, grouped up to the limit of textbooks, so that most texts give several groups."""
    groups = chunk.group_paragraphs(F.regexp_replace("text", "[ \n]+", "\n\n"), chunk.TEXTBOOK_CHARS)
    return t.raw("documents").select("doc_id", F.posexplode(groups).alias("pos", "g")).select("doc_id", "pos", F.sha2("g", 256).alias("group_sha"))


@query(with_ctes("blocks") + "SELECT doc_id, k::INT AS pos, text AS piece FROM blocks WHERE doc_type = 'textbook' AND doc_id IN (SELECT doc_id FROM long_bodies)")
def split_long_paragraphs(t: Tables) -> DataFrame:
    body = T.strip("text")
    rows = t.documents().filter("doc_type = 'textbook'").withColumn("body", body).filter(F.length("body") > chunk.TEXTBOOK_CHARS)
    return rows.select("doc_id", F.posexplode(chunk.split_long_paragraphs(F.col("body"), chunk.TEXTBOOK_CHARS)).alias("pos", "piece"))


@query(with_ctes("chunks") + """SELECT doc_id, "order", text FROM chunks WHERE source_type = 'textbook'""")
def textbook_chunks(t: Tables) -> DataFrame:
    return chunk.chunk_documents(t.documents().filter("doc_type = 'textbook'")).select("doc_id", "order", "text")


@query(with_ctes("chunks") + """SELECT doc_id, "order", text FROM chunks WHERE source_type = 'patient_record'""")
def patient_chunks(t: Tables) -> DataFrame:
    return chunk.chunk_documents(t.documents().filter("doc_type = 'patient_record'")).select("doc_id", "order", "text")


@query(with_ctes("chunks") + "SELECT * FROM chunks")
def chunk_documents(t: Tables) -> DataFrame:
    return t.chunks()


@query(with_ctes("open_chunks") + "SELECT chunk_id, doc_id FROM open_chunks")
def readable_chunks(t: Tables) -> DataFrame:
    return t.chunks().filter(T.readable()).select("chunk_id", "doc_id")


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def assemble_pages(t: Tables) -> DataFrame:
    return files.assemble_pages(t.raw("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text"))


@query(f"""SELECT doc_id, area IS NULL OR area <= 0 OR trim(text, {WS}) = '' OR length(trim(text, {WS})) / area < 0.005 AS needs_ocr
FROM (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 5) * 100000.0::DOUBLE END AS area FROM documents)""")
def ocr_routing(t: Tables) -> DataFrame:
    area = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 5) * 100000.0)
    return t.raw("documents").select("doc_id", T.needs_ocr("text", area).alias("needs_ocr"))


@query("""SELECT path, filename, suffix, reader, source_hash FROM (
SELECT source || '/' || doc_id || e AS path, doc_id || e AS filename, lower(e) AS suffix, CASE lower(e) WHEN '.txt' THEN 'text' WHEN '.htm' THEN 'html' WHEN '.md' THEN 'markdown' ELSE NULL END AS reader, sha256(text) AS source_hash
FROM (SELECT *, (['.txt', '.HTM', '.md', '.exe'])[doc_id % 4 + 1] AS e FROM documents)) WHERE reader IS NOT NULL""")
def intake_files(t: Tables) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".HTM", ".md", ".exe")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = t.raw("documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return files.intake(rows)[0].drop("content")


@query("SELECT event_id AS doc_id, 'k: ' || (props->>'$.k') AS paragraph FROM events")
def flat_json_paragraphs(t: Tables) -> DataFrame:
    return t.raw("events").select(F.col("event_id").alias("doc_id"), records.flat_json_paragraph("props").alias("paragraph"))


@query("""SELECT event_id AS doc_id, unnest([0, 1])::INT AS pos, unnest(['type: ' || event_type || chr(10) || 'new: ' || CASE WHEN event_type = 'signup' THEN 'yes' ELSE 'no' END, 'props' || chr(10) || 'k: ' || (props->>'$.k')]) AS paragraph FROM events""")
def json_paragraphs(t: Tables) -> DataFrame:
    raw = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "new": '), F.when(F.col("event_type") == "signup", "true").otherwise("false"), F.lit(', "none": null, "props": '), "props", F.lit("}"))
    return records.paragraph_rows(t.raw("events").select(F.col("event_id").alias("doc_id"), raw.alias("raw")), "raw", records.json_paragraphs).select("doc_id", "pos", "paragraph")


@query("""SELECT doc_id, pos::INT AS pos, paragraph FROM (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, 'k: ' || (props->>'$.k') AS paragraph FROM events)""")
def jsonl_paragraphs(t: Tables) -> DataFrame:
    lines = t.raw("events").groupBy(F.col("user_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda e: e["props"]), "\n\n").alias("raw"))
    return records.paragraph_rows(lines, "raw", records.jsonl_paragraphs).select("doc_id", "pos", "paragraph")


@query("""SELECT p_partkey AS doc_id, unnest([0, 1])::INT AS pos, unnest(['name: ' || p_name || chr(10) || 'size: ' || p_size, p_brand || ' made of ' || p_type]) AS paragraph FROM part""")
def xml_paragraphs(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("<part><name>"), "p_name", F.lit("</name><p>"), "p_brand", F.lit(" made <i>of</i> "), "p_type", F.lit("</p><size>"), F.col("p_size").cast("string"), F.lit("</size></part>"))
    return records.paragraph_rows(t.raw("part").select(F.col("p_partkey").alias("doc_id"), raw.alias("raw")), "raw", records.xml_paragraphs).select("doc_id", "pos", "paragraph")


@query("""SELECT 'key: ' || p_partkey || chr(10) || 'name: ' || p_name || chr(10) || 'brand: ' || p_brand || chr(10) || 'size: ' || p_size AS paragraph FROM part
UNION ALL SELECT 'a ' || p_type || ' of ' || p_brand FROM part""")
def xml_records(t: Tables) -> DataFrame:
    """One XML file of all parts, read by as many tasks as Spark cuts it into."""
    cell = lambda name, c: F.concat(F.lit(f"<{name}>"), F.col(c).cast("string"), F.lit(f"</{name}>"))
    record = F.concat(F.lit("<part>"), cell("key", "p_partkey"), cell("name", "p_name"), cell("brand", "p_brand"), F.lit("<p>a <b>"), "p_type", F.lit("</b> of "), "p_brand", F.lit("</p>\n"), cell("size", "p_size"), F.lit("</part>"))
    folder = f"{shared_dir(t.spark)}/xml-{uuid.uuid4().hex}"
    t.raw("part").select(record).coalesce(1).write.text(folder)
    return records.xml_records(t.spark, folder, "part").select("paragraph")


@query("SELECT event_id, 'id: ' || event_id || chr(10) || 'type: ' || event_type AS paragraph FROM events")
def jsonl_records(t: Tables) -> DataFrame:
    folder = f"{shared_dir(t.spark)}/jsonl-{uuid.uuid4().hex}"
    t.raw("events").select(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))).write.text(folder)
    return records.jsonl_records(t.spark, folder).select(F.regexp_extract("paragraph", r"^id: (\d+)", 1).cast("long").alias("event_id"), "paragraph")


@query("""SELECT p_partkey, 'p_name: ' || p_name || chr(10) || 'p_brand: ' || p_brand || chr(10) || 'p_type: ' || p_type || chr(10) || 'p_size: ' || p_size AS paragraph FROM part""")
def csv_paragraphs(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", records.row_paragraph(["p_name", "p_brand", "p_type", "p_size"]).alias("paragraph"))


@query(f"""SELECT item_id, trim(regexp_replace(regexp_replace('Item ' || item_id || chr(10) || 'bold and code of' || chr(10) || 'a | b' || chr(10) || text, '[ \\t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), {WS}) AS text FROM benchmark""")
def markdown_text(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("---\nx: 1\n---\n## Item "), F.col("item_id").cast("string"), F.lit(" ##\n- **bold** and `code` [of](http://x)\n| a | b |\n|---|---|\n"), "text")
    return t.raw("benchmark").select("item_id", T.markdown_to_text(raw).alias("text"))


_PSEUDO = "text || CASE WHEN conv_id % 5 = 0 AND role = 'user' THEN ' about P-' || CASE WHEN conv_id * 4 < 10000 THEN lpad((conv_id * 4)::VARCHAR, 4, '0') ELSE (conv_id * 4)::VARCHAR END ELSE '' END"


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({_PSEUDO}, '(?i)\\bP-\\d{{4,}}\\b'), lambda x: upper(x)))), ',') AS pseudonyms FROM conversations")
def find_pseudonyms(t: Tables) -> DataFrame:
    return t.conversations().select("conv_id", "turn", F.array_join(T.find_pseudonyms("text"), ",").alias("pseudonyms"))


TERM_CTE = (
    f"tokens AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(lower({_PSEUDO}), '(?i)\\bp-\\d{{4,}}\\b', ' ', 'g'), '[a-z0-9][a-z0-9''\\-]*') AS t FROM conversations WHERE role = 'user'),\n"
    f"stops AS (SELECT unnest(string_split('{' '.join(T.STOPWORDS)}', ' ')) AS w),\n"
    "grams AS (SELECT conv_id, turn, n, unnest(list_transform(range(1, greatest(len(t) - n + 2, 1)), lambda i: t[i:i + n - 1])) AS g FROM tokens, (SELECT unnest([1, 2, 3, 4]) AS n)),\n"
    "turn_terms AS (SELECT DISTINCT conv_id, turn, array_to_string(g, ' ') AS term FROM grams WHERE g[1] NOT IN (SELECT w FROM stops) AND g[len(g)] NOT IN (SELECT w FROM stops) AND (n > 1 OR length(g[1]) >= 3))"
)


@query(f"WITH {TERM_CTE} SELECT conv_id, turn, term FROM turn_terms")
def question_terms(t: Tables) -> DataFrame:
    return t.conversations().filter("role = 'user'").select("conv_id", "turn", F.explode(T.question_terms("text")).alias("term"))


#: Letters of the passages as Thai characters, vowels as vowels: some are written before their consonant, some after.
_LATIN, _THAI = "abcdefghijklmnopqrstuvwxyz", "ากคดเฟงหิจฉลมนโปฐรสตุวฝฎยซ"
_THAI_SQL = f"""WITH RECURSIVE src AS (SELECT item_id, translate(regexp_replace(lower(text), '[^a-z ]', '', 'g'), '{_LATIN}', '{_THAI}') AS t FROM benchmark),
words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(t, ' ')) AS w FROM src) WHERE length(w) >= 2 AND length(w) % 5 <> 0),
runs AS (SELECT item_id, replace(t, ' ', '') AS r FROM src WHERE trim(t) <> ''),
places AS (SELECT item_id, r, unnest(range(0, length(r) + 1)) AS i FROM runs),
starts AS (SELECT *, lead(i) OVER (PARTITION BY item_id ORDER BY i) AS j FROM places
  WHERE i = 0 OR i = length(r) OR (NOT contains('{segment.TRAILING}', substr(r, i + 1, 1)) AND NOT contains('{segment.LEADING}', substr(r, i, 1)))),
arcs AS (SELECT a.item_id, a.i, list(b.i - a.i) AS ls FROM starts a JOIN starts b ON a.item_id = b.item_id AND b.i > a.i AND b.i - a.i <= (SELECT max(length(w)) FROM words)
  JOIN words ON w = substr(a.r, a.i + 1, b.i - a.i) GROUP BY ALL),
steps AS (SELECT p.item_id, p.i, s.j - p.i AS c, ls FROM places p LEFT JOIN starts s USING (item_id, i) LEFT JOIN arcs USING (item_id, i)),
best AS (SELECT item_id, length(r) AS i, 0::BIGINT AS k, 1::BIGINT << 60 AS u, 0::BIGINT AS l, 0::BIGINT AS c, [0::BIGINT] AS ks, [1::BIGINT << 60] AS us FROM runs
  UNION ALL SELECT item_id, i, k, u, l, c, list_prepend(k, ks), list_prepend(u, us) FROM (
    SELECT item_id, i, c, ks, us, coalesce(e // 1000, 1::BIGINT << 60) AS k, 999 - e % 1000 AS l, CASE WHEN c IS NULL THEN 1::BIGINT << 60 ELSE c * 100000 + least(us[c], ks[c] + 1) END AS u FROM (
      SELECT s.item_id, s.i, s.c, b.ks, b.us, list_min(list_transform(s.ls, lambda x: (1 + least(b.ks[x], b.us[x])) * 1000 + 999 - x)) AS e FROM best b JOIN steps s ON s.item_id = b.item_id AND s.i = b.i - 1))),
walk AS (SELECT item_id, i, i AS began, k <= u AS known, NULL::VARCHAR AS token FROM best WHERE i = 0
  UNION ALL SELECT item_id, to_i, CASE WHEN is_known OR next_known THEN to_i ELSE began END, CASE WHEN is_known THEN nk <= nu ELSE next_known END, CASE WHEN is_known OR next_known THEN substr(r, began + 1, to_i - began) END FROM (
    SELECT w.item_id, w.began, w.known AS is_known, n.i AS to_i, n.k AS nk, n.u AS nu, n.k + 1 <= n.u AS next_known, r.r FROM walk w JOIN best b ON b.item_id = w.item_id AND b.i = w.i
      JOIN best n ON n.item_id = b.item_id AND n.i = b.i + CASE WHEN w.known THEN b.l ELSE b.c END JOIN runs r ON r.item_id = w.item_id WHERE w.i < length(r.r))),
tokens AS (SELECT item_id, list(token ORDER BY i) AS t FROM walk WHERE token IS NOT NULL GROUP BY item_id),
grams AS (SELECT item_id, n, unnest(list_transform(range(1, greatest(len(t) - n + 2, 1)), lambda i: t[i:i + n - 1])) AS g FROM tokens, (SELECT unnest([1, 2, 3, 4]) AS n))
SELECT DISTINCT item_id, unnest([array_to_string(g, ' '), array_to_string(g, '')]) AS term FROM grams WHERE n > 1 OR length(g[1]) >= 2"""


@query(_THAI_SQL)
def thai_terms(t: Tables) -> DataFrame:
    plain = t.raw("benchmark").select("item_id", F.translate(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), _LATIN, _THAI).alias("t"))
    words = plain.select(F.explode(F.split("t", " ")).alias("word")).filter("length(word) >= 2 AND length(word) % 5 <> 0")
    runs = plain.select("item_id", F.replace("t", F.lit(" "), F.lit("")).alias("text"))
    return segment.segment(runs, words).select("item_id", F.explode(T.thai_terms("tokens")).alias("term"))


@query(with_ctes("src") + "SELECT doc_id, CASE WHEN doc_type = 'patient_record' THEN 'Patient ' || pseudonym ELSE filename END AS label FROM src")
def source_labels(t: Tables) -> DataFrame:
    uploaded = F.concat(F.md5(F.col("doc_id").cast("string")), F.lit("_"), "filename")
    return t.documents().select("doc_id", T.source_label("doc_type", uploaded, "pseudonym").alias("label"))


@query(with_ctes("src") + "SELECT doc_id, CASE WHEN ingestion_complete = false THEN 'incomplete' ELSE 'complete' END AS status FROM src")
def document_status(t: Tables) -> DataFrame:
    return t.documents().select("doc_id", graph.document_status())


# --- de-identification


#: One identifier or two of every rule, and what looks like one; a document gets those whose place its id picks.
_PLANTED = (
    "Name: Ann Lee\nMr. John Smith and Dr Ruth Gray\n",
    "mail ann.lee@example.org, x+y@mail.example.com\n",
    "1-2345-67890-12-3 and 3 2345 67890 12 3\n",
    "HN: 12/345, MRN no. A-77, Patient ID: ABC9, ID none\n",
    "call 02-123-4567 or (212) 555-0188, not 1234567\n",
    "on 12/3/2024, 2024-01-05, 5 Jan 2024, March 3, 2024, May 2023, not 123/4/2024\n",
    "3 มกราคม 2567, ๕ ก.พ. พ.ศ. 2566, นายสมชาย ใจดี, นายแพทย์ และ นางสาวมาลี\n",
    "Address: 12 Long Road\nที่อยู่ 99 หมู่ 4\n",
)


def _pattern_sql(patterns, group: int = 0, digit: bool = False) -> str:
    """How often patterns are found. This SQL has no look-around: the character beside a number is matched with it, and
    words that a title is no part of are taken out first."""
    edge = {f"(?<!{deid.DIGIT})": f"(?:^|[^{deid.DIGIT[1:-1]}])", r"(?<!\d)": "(?:^|[^0-9])", f"(?!{deid.DIGIT})": f"(?:$|[^{deid.DIGIT[1:-1]}])", r"(?!\d)": "(?:$|[^0-9])", "(?!แพทย์)": "", "(?!พยาบาล)": ""}

    def count(pattern: str) -> str:
        for look, plain in edge.items():
            pattern = pattern.replace(look, plain)
        found = f"regexp_extract_all(x, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"
        return f"len(list_filter({found}, lambda v: regexp_matches(v, '{deid.DIGIT}')))" if digit else f"len({found})"

    return " + ".join(count(p) for p in patterns)


_PLANTED_SQL = " || ".join(f"CASE WHEN (doc_id >> {i}) & 1 = 1 THEN '{x}' ELSE '' END" for i, x in enumerate(_PLANTED))


@query(f"""WITH t AS (SELECT doc_id, replace(replace({_PLANTED_SQL} || text, 'นายแพทย์', ''), 'นางพยาบาล', '') AS x FROM documents)
SELECT doc_id, {_pattern_sql([deid.EMAIL])} AS emails, {_pattern_sql([deid.THAI_ID])} + {_pattern_sql(deid.LABELLED_IDS, 1, True)} AS ids, {_pattern_sql(deid.PHONES)} AS phones,
{_pattern_sql(deid.DATES)} AS dates, {_pattern_sql([deid.ADDRESS])} AS addresses, {_pattern_sql(deid.NAMES)} AS persons FROM t""")
def deid_pattern_counts(t: Tables) -> DataFrame:
    planted = (F.when(F.shiftright("doc_id", i).bitwiseAND(F.lit(1)) == 1, x).otherwise("") for i, x in enumerate(_PLANTED))
    found = t.raw("documents").select("doc_id", deid.pattern_spans(F.concat(*planted, "text")).alias("spans"))
    kinds = {"emails": "EMAIL", "ids": "ID", "phones": "PHONE", "dates": "DATE", "addresses": "ADDRESS", "persons": "PERSON"}
    return found.select("doc_id", *((F.size("spans") - F.size(F.array_remove(F.col("spans.kind"), kind))).cast("long").alias(name) for name, kind in kinds.items()))


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+', '[EMAIL]', 'g'), '(?:\\+1[ -]?)?\\(?\\d{3}\\)?[ -]\\d{3}-\\d{4}', '[PHONE]', 'g')) AS text_sha FROM documents""")
def redact_typed(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.sha2(deid.redact_typed(F.col("text")), 256).alias("text_sha"))


@query("""SELECT doc_id, 6 AS "start", 14 AS "end" FROM documents WHERE doc_id % 4 = 0""")
def deid_names(t: Tables) -> DataFrame:
    spans = deid.pattern_spans(F.col("text"))
    return t.documents().filter("doc_type = 'patient_record'").select("doc_id", F.explode(spans).alias("s")).filter("s.kind = 'PERSON'").select("doc_id", "s.start", "s.end")


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\bth[a-z]{4}\\b')) AS n FROM documents WHERE regexp_matches(text, '\\bth[a-z]{4}\\b')""")
def deid_extra_ids(t: Tables) -> DataFrame:
    spans = F.filter(deid.pattern_spans(F.col("text"), [r"\bth[a-z]{4}\b"]), lambda s: (s["kind"] == "ID") & (s["end"] - s["start"] == 6) & F.rlike(F.substring(F.col("text"), s["start"] + 1, F.lit(6)), F.lit("^th[a-z]{4}$")))
    return t.raw("documents").select("doc_id", F.size(spans).cast("long").alias("n")).filter("n > 0")


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END AS kept FROM benchmark")
def deid_ner_filter(t: Tables) -> DataFrame:
    after = F.element_at(F.array(F.lit(" disease. "), F.lit(" came. "), F.lit("'s sign "))  , (F.col("item_id") % 3 + 1).cast("int"))
    text = F.concat(F.lit("Bell"), after, "text")
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(k).alias("kind")) for a, b, k in ((0, 4, "PERSON"), (4, 6, "PLACE"), (4, 6, "DATE"))])
    return t.raw("benchmark").select("item_id", F.size(deid.keep_ner_spans(text, spans)).alias("kept"))


_PLACED = "regexp_replace(regexp_replace(text, '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+', '[EMAIL]', 'g'), '(?:\\+1[ -]?)?\\(?\\d{3}\\)?[ -]\\d{3}-\\d{4}', '[PHONE]', 'g')"


@query(f"""SELECT doc_id, 'Name: [PERSON-1]' || chr(10) || 'Subjective:' || chr(10) || {_PLACED} || chr(10) || 'Plan:' || chr(10) || 'Rest and fluids.' AS text FROM documents WHERE doc_id % 4 = 0""")
def deidentify(t: Tables) -> DataFrame:
    return t.documents().filter("doc_type = 'patient_record'").select("doc_id", deid.deidentify(F.col("text")).alias("text"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, (l_partkey % 100)::INT AS "start", (l_partkey % 100 + l_quantity)::INT AS "end" FROM lineitem),
m AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, min("start") AS "start", max("end") AS "end" FROM g GROUP BY doc_id, island""")
def merge_spans(t: Tables) -> DataFrame:
    start = (F.col("l_partkey") % 100).cast("int")
    return deid.merge_spans(t.raw("lineitem").select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (F.col("l_partkey") % 100 + F.col("l_quantity")).cast("int").alias("end")))


@query("""WITH old AS (SELECT doc_id, 'P-' || CASE WHEN doc_id < 10000 THEN lpad(doc_id::VARCHAR, 4, '0') ELSE doc_id::VARCHAR END AS pseudonym FROM documents WHERE doc_id % 12 = 0),
new AS (SELECT doc_id, (SELECT max(doc_id) FROM old) + row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id % 4 = 0 AND doc_id % 12 <> 0)
SELECT * FROM old UNION ALL SELECT doc_id, 'P-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END FROM new""")
def assign_pseudonyms(t: Tables) -> DataFrame:
    docs = t.documents().filter("doc_type = 'patient_record'")
    return deid.assign_pseudonyms(docs, docs.filter("doc_id % 12 = 0").select("doc_id", "pseudonym"))


@query(with_ctes("chunks", "entities", "relations", "src").rstrip() + f""",
pending AS (SELECT * FROM chunks WHERE source_type = 'patient_record' AND NOT deidentified),
gone AS (SELECT entity_id FROM entities WHERE pos % 2 = 0 AND doc_id IN (SELECT doc_id FROM pending)),
top AS (SELECT max(doc_id) AS n FROM src WHERE doc_id % 8 = 0),
numbered AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN doc_id ELSE (SELECT n FROM top) + row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) END AS n FROM src WHERE doc_id % 4 = 0)
SELECT 'chunk' AS kind, chunk_id AS id, sha256(CASE WHEN "order" = 0 THEN 'Mr. [PERSON-1]. ' ELSE '' END || {_PLACED}) AS detail FROM pending
UNION ALL SELECT 'chunk', chunk_id, sha256(CASE WHEN "order" = 0 THEN 'Mr. John Smith. ' ELSE '' END || text) FROM chunks ANTI JOIN pending USING (chunk_id)
UNION ALL SELECT 'entity', entity_id, NULL FROM entities WHERE entity_id NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'edge', source_id, target_id FROM relations WHERE source_id NOT IN (SELECT * FROM gone) AND target_id NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'pseudonym', doc_id::VARCHAR, 'P-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END FROM numbered
UNION ALL SELECT 'updated', doc_id::VARCHAR, count(*)::VARCHAR FROM pending GROUP BY doc_id
UNION ALL SELECT 'removed', p.doc_id::VARCHAR, (SELECT count(*) FROM entities e JOIN gone g USING (entity_id) WHERE e.doc_id = p.doc_id)::VARCHAR FROM (SELECT DISTINCT doc_id FROM pending) p""")
def deid_backfill(t: Tables) -> DataFrame:
    """Every table after the backfill: half of the patients' chunks name a man, whose name their entities hold as well."""
    docs, text = t.documents(), F.when(F.col("order") == 0, F.concat(F.lit("Mr. John Smith. "), "text")).otherwise(F.col("text"))
    chunks = t.stored("chunks")  # before the entities, which read it
    entities = t.stored("entities").select("entity_id", "doc_id", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("Smith "), "name")).otherwise(F.col("name")).alias("name"))
    after = deid.backfill_graph(docs, chunks.withColumn("text", text), entities, t.stored("relations"), docs.filter("doc_id % 8 = 0").select("doc_id", "pseudonym"))
    rows = lambda table, kind, key, detail: after[table].select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), detail.cast("string").alias("detail"))
    parts = [rows("chunks", "chunk", "chunk_id", F.sha2("text", 256)), rows("entities", "entity", "entity_id", F.lit(None)), rows("relations", "edge", "source_id", F.col("target_id")), rows("pseudonyms", "pseudonym", "doc_id", F.col("pseudonym")), rows("counts", "updated", "doc_id", F.col("chunks_updated")), rows("counts", "removed", "doc_id", F.col("entities_removed"))]
    return functools.reduce(DataFrame.unionByName, parts)


# --- corpus audit

_REG = """reg AS (SELECT 'source-' || (page_id - CASE WHEN page_id % 50 = 49 THEN 1 ELSE 0 END) AS name, (['vocabulary', 'corpus', 'patient-record'])[page_id % 3 + 1] AS category,
(['green', 'green', 'amber', 'red', 'green'])[page_id % 5 + 1] AS license_class, url, CASE WHEN page_id % 9 <> 4 THEN 'raw/' || page_id END AS dest,
(['.html', '.xml', '.htm', '.pdf'])[page_id % 4 + 1] AS expected_extension, CASE WHEN page_id % 6 = 5 THEN 1000000 ELSE 10 END AS min_bytes, page_id % 4 <> 1 AS fetchable,
CASE WHEN page_id % 8 <> 1 THEN (['Dead link (404)', 'Cloudflare', 'Registration', 'host unreachable'])[page_id % 4 + 1] END AS skip_reason, html, strlen(html) AS total_bytes, page_id FROM pages)"""
_STATUS = "CASE WHEN total_bytes < min_bytes THEN 'FAIL-SIZE' WHEN kind = 'html' AND expected_extension NOT IN ('.html', '.htm') THEN 'FAIL-HTML' ELSE 'OK' END"
_KIND = "CASE WHEN contains(lower(substr(ltrim(html, ' ' || chr(10) || chr(9)), 1, 512)), '<!doctype html') OR contains(lower(substr(ltrim(html, ' ' || chr(10) || chr(9)), 1, 512)), '<html') THEN 'html' WHEN starts_with(ltrim(html, ' ' || chr(10) || chr(9)), '<') THEN 'xml' END"


@query(f"WITH {_REG} SELECT name, url FROM reg WHERE category = 'corpus' AND license_class = 'green'")
def filter_registry(t: Tables) -> DataFrame:
    return corpus.filter_registry(t.registry(), "corpus", "green").select("name", "url")


@query(f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'gzip' ELSE {_KIND} END AS kind FROM pages")
def sniff_content(t: Tables) -> DataFrame:
    magic = F.element_at(F.array(*[F.lit(bytearray(x)) for x in (b"%PDF", b"PK\x03\x04", b"\x1f\x8b", b" \n", b"")]), (F.col("page_id") % 5 + 1).cast("int"))
    return t.raw("pages").select("page_id", T.sniff(F.concat(magic, F.encode("html", "UTF-8"))).alias("kind"))


@query(f"WITH {_REG} SELECT page_id, {_STATUS} AS status FROM (SELECT *, {_KIND} AS kind FROM reg)")
def verify_content(t: Tables) -> DataFrame:
    return t.registry().select("page_id", corpus.verification().alias("status"))


@query(f"WITH {_REG} SELECT page_id, CASE WHEN skip_reason LIKE '%404%' THEN 'SKIP-DEAD' WHEN skip_reason IN ('Cloudflare', 'host unreachable') THEN 'SKIP-BLOCKED' ELSE 'SKIP-GATED' END AS status FROM reg WHERE NOT fetchable")
def classify_skips(t: Tables) -> DataFrame:
    return t.registry().filter("NOT fetchable").select("page_id", corpus.skip_status().alias("status"))


@query(f"""WITH {_REG} SELECT name, 'fetchable without dest' AS violation FROM reg WHERE fetchable AND dest IS NULL
UNION ALL SELECT name, 'not fetchable without reason' FROM reg WHERE NOT fetchable AND skip_reason IS NULL
UNION ALL SELECT name, 'duplicate name' FROM reg GROUP BY name HAVING count(*) > 1""")
def registry_violations(t: Tables) -> DataFrame:
    return corpus.registry_violations(t.registry())


def _manifest(t: Tables, shift: int) -> DataFrame:
    status = F.when(F.col("fetchable"), corpus.verification()).otherwise(corpus.skip_status())
    sha = F.when(F.col("page_id") % 10 == 7, F.lit("stale")).otherwise(F.substring(F.sha2("content", 256), 1, 12))
    return t.registry().select("name", (F.col("page_id") + shift).alias("seq"), status.alias("status"), "url", F.concat_ws("\t", "category", "license_class").alias("notes"), sha.alias("sha256_12"))


_MANIFEST = f"""{_REG}, manifest AS (SELECT name, CASE WHEN fetchable THEN {_STATUS} WHEN skip_reason LIKE '%404%' THEN 'SKIP-DEAD' WHEN skip_reason IN ('Cloudflare', 'host unreachable') THEN 'SKIP-BLOCKED' ELSE 'SKIP-GATED' END AS status,
url, category || ' ' || license_class AS notes, CASE WHEN page_id % 10 = 7 THEN 'stale' ELSE substr(sha256(html), 1, 12) END AS sha256_12, page_id AS seq FROM (SELECT *, {_KIND} AS kind FROM reg)),
last AS (SELECT name, arg_max(status, seq) AS status, arg_max(url, seq) AS url, arg_max(notes, seq) AS notes, arg_max(sha256_12, seq) AS sha256_12 FROM manifest GROUP BY name)"""


def _latest(t: Tables) -> DataFrame:
    rows = _manifest(t, 0)
    return corpus.manifest_upsert(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"))


@query(f"WITH {_MANIFEST} SELECT * FROM last")
def manifest_upsert(t: Tables) -> DataFrame:
    return _latest(t)


@query(f"WITH {_MANIFEST} SELECT DISTINCT r.name, r.dest FROM reg r JOIN last l USING (name) JOIN pages p ON r.dest = 'raw/' || p.page_id WHERE l.status = 'OK' AND l.sha256_12 = substr(sha256(p.html), 1, 12)")
def verified_sources(t: Tables) -> DataFrame:
    stored = t.registry().select(F.concat(F.lit("raw/"), F.col("page_id").cast("string")).alias("path"), F.sha2("content", 256).alias("sha256"))
    return corpus.verified_sources(t.registry(), _latest(t), stored).distinct()


_RANK = "list_position(['SKIP-GATED', 'SKIP-BLOCKED', 'SKIP-DEAD', 'FAIL-HTML', 'FAIL-SIZE', 'FAIL-TYPE', 'FAIL'], status)::INT"


def _classed(t: Tables) -> DataFrame:
    parts = F.split("notes", " ")
    return _latest(t).withColumns({"category": F.get(parts, 0), "license_class": F.get(parts, 1)})


@query(f"WITH {_MANIFEST} SELECT {_RANK} AS rank, status, name, split_part(notes, ' ', 1) AS category, split_part(notes, ' ', 2) AS license_class, url, notes FROM last WHERE status <> 'OK'")
def skip_report(t: Tables) -> DataFrame:
    return corpus.skip_report(_classed(t))


@query(f"""WITH {_MANIFEST}, r AS (SELECT {_RANK} AS rank, *, split_part(notes, ' ', 1) AS c, split_part(notes, ' ', 2) AS l FROM last)
SELECT rank, name, '- **' || name || '** (`' || c || '`/`' || l || '`) — ' || url || chr(10) || '  ' || notes AS line FROM r WHERE status <> 'OK'
UNION ALL SELECT DISTINCT rank, '', (['## Registration required', '## Confirmed Cloudflare-blocked / unreachable', '## Confirmed dead / 404', '## Failed content verification this run (soft-404 detected)', '## Failed content verification this run (undersized)', '## Failed content verification this run (unexpected type)', '## Other fetch failures'])[rank] FROM r WHERE status <> 'OK'
UNION ALL SELECT 8, '', count(*) FILTER (status = 'OK') || ' source(s) successfully fetched and verified.' FROM last""")
def report_lines(t: Tables) -> DataFrame:
    return corpus.report_lines(_classed(t))


@query(f"WITH {_MANIFEST} SELECT name, status FROM last WHERE name IN (SELECT name FROM reg WHERE license_class = 'green')")
def license_gate(t: Tables) -> DataFrame:
    return corpus.license_gate(_latest(t), t.registry()).select("name", "status")


@query("""WITH e AS (SELECT 'T ' || t[i] AS term, item_id * 100 + i AS seq FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''\\-]*') AS t, unnest(range(1, 9)) AS i FROM benchmark) WHERE i <= len(t))
SELECT lower(term) AS normalized_term, arg_max(term, seq) AS term, 'D' || max(seq) AS definition_text, 'bench' AS source, max(seq)::VARCHAR AS source_id, CAST(NULL AS VARCHAR) AS semantic_type FROM e GROUP BY lower(term)""")
def load_definitions(t: Tables) -> DataFrame:
    tokens = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN), F.lit(0)), 1, 8)
    rows = t.raw("benchmark").select("item_id", F.posexplode(tokens).alias("pos", "token")).withColumn("seq", F.col("item_id") * 100 + F.col("pos") + 1)
    entries = rows.select("seq", F.concat(F.lit("T "), "token").alias("term"), F.concat(F.lit("D"), F.col("seq").cast("string")).alias("definition_text"), F.lit("bench").alias("source"), F.col("seq").cast("string").alias("source_id"), F.lit(None).cast("string").alias("semantic_type"))
    return extract.load_definitions(entries)


@query(ORACLES["load_definitions"].replace("'bench' AS source", "'stub' AS source").replace("max(seq)::VARCHAR AS source_id", "CASE WHEN max(seq) % 2 = 0 THEN max(seq)::VARCHAR END AS source_id").replace("CAST(NULL AS VARCHAR) AS semantic_type", "'symptom' AS semantic_type"))
def read_dictionary(t: Tables) -> DataFrame:
    """The terms of ``load_definitions`` through dictionary files, one for each item, entries without a source."""
    tokens = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN), F.lit(0)), 1, 8)
    rows = t.raw("benchmark").select("item_id", F.posexplode(tokens).alias("pos", "token")).withColumn("seq", F.col("item_id") * 100 + F.col("pos") + 1)
    entry = F.struct("seq", F.concat(F.lit("T "), "token").alias("term"), F.concat(F.lit("D"), F.col("seq").cast("string")).alias("definition_text"), F.when(F.col("seq") % 2 == 0, F.col("seq").cast("string")).alias("source_id"), F.lit("symptom").alias("semantic_type"))
    made = rows.groupBy("item_id").agg(F.sort_array(F.collect_list(entry)).alias("terms"))
    folder = f"{shared_dir(t.spark)}/dictionary-{uuid.uuid4().hex}"
    # files are read in the order of their paths
    made.withColumn("at", F.format_string("%012d", "item_id")).select("at", F.to_json(F.struct("terms")).alias("value")).write.partitionBy("at").text(folder)
    return extract.load_definitions(files.read_dictionary(t.spark, folder))
