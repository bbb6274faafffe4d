"""Column functions on text. All are built-in expressions, which stay inside whole-stage code generation, but for
character references and nested elements of HTML and for UTF-16, which Spark has no expression for: those go through
Arrow batches."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that neither begin nor end a term of a question.
STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have how i if in into is it its may me "
    "my no not of on or our should so than that the their them then there these they this those to was we were what "
    "when where which who why will with would you your about any also tell explain describe give list show patient "
    "patients"
).split()
#: What a term's token looks like, a pseudonym, a Thai character, the prefix of an uploaded file.
TOKEN = r"[a-z0-9][a-z0-9'\-]*"
PSEUDONYM = r"(?i)\bP-\d{4,}\b"
THAI = "[\u0e00-\u0e7f]"
UPLOAD_PREFIX = "^[0-9a-f]{32}_"
#: HTML elements that are dropped whole, and those that stand in paragraphs of their own.
DROPPED = ("script", "style", "noscript", "template", "svg", "iframe", "nav", "footer", "form")
BLOCKS = (
    "address article aside blockquote caption dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hr li "
    "main ol p pre section summary table tr ul"
).split()
MAX_NGRAM = 4

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Text) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def normalize_term(x: Text) -> Column:
    """Lower case, outer space gone, inner runs of space one blank."""
    return F.regexp_replace(strip(F.lower(_c(x))), r"(?U)\s+", " ")


def tidy(x: Text) -> Column:
    """Runs of blanks within a line become one, lines are trimmed, and more than one empty line becomes one."""
    blanks = F.regexp_replace(_c(x), "[ \t\r\f\u000b\u00a0]+", " ")
    trimmed = F.regexp_replace(blanks, r"(?m)^ +| +$", "")
    return strip(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"))


def decode(content: Text) -> Column:
    """Bytes to text: UTF-16 after its byte-order mark, else UTF-8 without one; bad bytes become U+FFFD."""
    content = _c(content)
    utf16 = F.substring(content, 1, 2).isin(bytearray(b"\xff\xfe"), bytearray(b"\xfe\xff"))
    return F.when(utf16, _utf16(F.when(utf16, content))).otherwise(F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", ""))


def paragraphs(x: Text) -> Column:
    """Paragraphs between empty lines, trimmed, without empty ones."""
    parts = F.transform(F.split(_c(x), r"\n(?U:\s)*\n"), strip)
    return F.filter(parts, lambda p: p != "")


@F.pandas_udf(StringType())
def _utf16(content: pd.Series) -> pd.Series:
    """UTF-16 with its byte-order mark; what is no character, and an odd last byte, become U+FFFD."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-16", errors="replace").encode("utf-8", errors="replace").decode())


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _html.unescape(t).encode("utf-8", errors="replace").decode())


def unescape(x: Text) -> Column:
    """Character references of HTML, named and numbered, each once. Only texts that hold one leave the JVM."""
    x = _c(x)
    some = F.contains(x, F.lit("&"))
    return F.coalesce(_unescape(F.when(some, x)), x)  # the text is only made again where nothing was sent


#: What the scan for nested elements stops at: comments, raw text (whose content holds no tags), and tags of the other
#: dropped elements.
_NESTING = tuple(t for t in DROPPED if t not in ("script", "style"))
_STOPS = re.compile(rf"(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|<(/?)({'|'.join(_NESTING)})\b[^>]*>")


def drop_nested(page: str) -> str:
    """The page without its dropped elements, from the outermost start to its own end: one pass over the tags with a
    stack. An end closes the last open element of its name and all that were opened since; an end without a start is
    passed over, and a start without an end cuts nothing."""
    opened: list[tuple[str, int]] = []
    cuts: list[tuple[int, int]] = []
    depth = dict.fromkeys(_NESTING, 0)
    for m in _STOPS.finditer(page):
        if m[2] is None or (not m[1] and m[0].endswith("/>")):
            continue
        name = m[2].lower()
        if not m[1]:
            opened.append((name, m.start()))
            depth[name] += 1
        elif depth[name]:
            closed = None
            while closed != name:
                closed, start = opened.pop()
                depth[closed] -= 1
            # what was cut inside goes with it
            while cuts and cuts[-1][0] > start:
                cuts.pop()
            cuts.append((start, m.end()))
    ends = [0, *(end for _, end in cuts)]
    return "".join(page[a:b] for a, b in zip(ends, [*(s for s, _ in cuts), len(page)], strict=True))


@F.pandas_udf(StringType())
def _drop_nested(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: None if p is None else drop_nested(p))


def html_to_text(html: Text) -> Column:
    """A page as paragraphs: comments and dropped elements gone, title first, rows as cells between bars. Only pages with
    two dropped elements of one kind, which may nest, leave the JVM for that."""
    html = _c(html)
    title = strip(F.regexp_replace(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)), r"(?U)\s+", " "))
    gone = "|".join([r"<!--.*?-->", *(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in (*DROPPED, "head"))])
    nests = F.rlike(html, F.lit(rf"(?is)<({'|'.join(_NESTING)})\b.*<\1\b"))
    body = F.regexp_replace(F.coalesce(_drop_nested(F.when(nests, html)), html), f"(?is){gone}", "")
    body = F.regexp_replace(body, r"(?i)<!doctype[^>]*>", "")
    body = F.regexp_replace(body, r"(?i)<br\b[^>]*>", "\n")
    body = F.regexp_replace(body, r"(?i)</(td|th)\s*>", " | ")
    body = F.regexp_replace(body, rf"(?i)</?({'|'.join(BLOCKS)})\b[^>]*>", "\n\n")
    body = tidy(unescape(F.regexp_replace(body, r"(?s)</?[a-zA-Z][^>]*>", "")))
    body = F.regexp_replace(body, r"(?m)\s*\|\s*$", "")
    # bound once: the expression for the body is long, and what follows reads it three times
    whole = F.transform(F.array(F.struct(title.alias("title"), body.alias("body"))), lambda p: F.when((p["title"] != "") & ~F.startswith(p["body"], p["title"]), F.concat(p["title"], F.lit("\n\n"), p["body"])).otherwise(p["body"]))
    return strip(F.get(whole, F.lit(0)))


#: Markdown syntax and what stays of it, in the order of application.
MARKDOWN = (
    (r"\r\n", "\n"),
    (r"(?s)\A---[ \t]*\n.*?\n---[ \t]*\n", ""),
    (r"(?m)^[ \t]*(```|~~~).*$", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?m)^[ \t]*\[[^\]]+\]:[ \t]+\S+.*$", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\[[^\]]*\]", "$1"),
    (r"<(https?://[^>]+)>", "$1"),
    (r"</?[A-Za-z][^>]*>", ""),
    (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$", "$1"),
    (r"(?m)^[ \t]{0,3}(=+|-+)[ \t]*$", ""),
    (r"(?m)^[ \t]{0,3}([*_][ \t]*){3,}$", ""),
    (r"(?m)^[ \t]{0,3}>[ \t]?", ""),
    (r"(?m)^([ \t]*)[-*+][ \t]+\[[ xX]\][ \t]+", "$1"),
    (r"(?m)^([ \t]*)[-*+][ \t]+", "$1"),
    (r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*\n?", ""),
    (r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", "$2"),
    (r"(?<![\w*])\*(?=\S)(.+?)(?<=\S)\*(?![\w*])", "$1"),
    (r"(?<![\w_])_(?=\S)(.+?)(?<=\S)_(?![\w_])", "$1"),
    (r"~~(.+?)~~", "$1"),
    (r"`([^`]+)`", "$1"),
)


def markdown_to_text(x: Text) -> Column:
    """Markdown without its syntax; table rows as cells between bars."""
    out = _c(x)
    for pattern, kept in MARKDOWN:
        out = F.regexp_replace(out, pattern, kept)
    out = F.regexp_replace(out, r"(?m)^[ \t]*\|(.*)\|[ \t]*$", "\u0001$1\u0001")
    lines = F.transform(
        F.split(out, "\n"),
        lambda line: F.when(line.startswith("\u0001"), F.array_join(F.transform(F.split(F.regexp_replace(line, "\u0001", ""), r"\|"), strip), " | ")).otherwise(line),
    )
    return tidy(F.array_join(lines, "\n"))


def has_thai(x: Text) -> Column:
    return F.rlike(_c(x), F.lit(THAI))


def find_pseudonyms(x: Text) -> Column:
    """Distinct pseudonyms of a text in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(_c(x), F.lit(PSEUDONYM), F.lit(0)), F.upper)))


def question_tokens(x: Text) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.lower(_c(x)), PSEUDONYM, " "), F.lit(TOKEN), F.lit(0))


def term_runs(tokens: Column, least: int | Callable[[Column], Column] = 3, stopwords: tuple | list = STOPWORDS) -> Column:
    """Runs of 1 to 4 tokens that no stopword begins or ends; single tokens need ``least`` characters (a number, or what a
    function says of the token)."""
    stops = F.array(*[F.lit(w) for w in stopwords])

    def runs(bound: Column) -> Column:
        def runs_of(n: int) -> Column:
            last = F.size(bound) - n + 1
            starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))

            def good(i: Column) -> Column:
                ok = ~F.array_contains(stops, F.element_at(bound, i)) & ~F.array_contains(stops, F.element_at(bound, i + (n - 1)))
                one = F.element_at(bound, i)
                return ok & (F.length(one) >= (least(one) if callable(least) else least)) if n == 1 else ok

            return F.transform(F.filter(starts, good), lambda i: F.array_join(F.slice(bound, i, n), " "))

        return F.concat(*(runs_of(n) for n in range(1, MAX_NGRAM + 1)))

    # the tokens as a lambda's variable: as an expression they would be found anew for every place of every run
    return F.array_distinct(F.flatten(F.transform(F.array(tokens), runs)))


def question_terms(x: Text) -> Column:
    """Candidate entity names of a question in Latin script."""
    return term_runs(question_tokens(x))


def thai_terms(tokens: Text, stopwords: tuple | list = STOPWORDS) -> Column:
    """Candidate names from the tokens of a question that holds Thai. Runs with Thai in them count without blanks too;
    single tokens need two characters if they are Thai, else three. Thai stopwords are the user's."""
    runs = term_runs(_c(tokens), lambda token: F.when(has_thai(token), 2).otherwise(3), stopwords)
    return F.array_distinct(F.flatten(F.transform(F.array(runs), lambda r: F.concat(r, F.transform(F.filter(r, has_thai), lambda x: F.replace(x, F.lit(" "), F.lit("")))))))


def needs_ocr(text: Text, area: Text, threshold: float = 0.005) -> Column:
    """Pages whose text layer is too thin for their area, or that have no area to judge by."""
    area, body = _c(area), strip(_c(text))
    return area.isNull() | (area <= 0) | (body == "") | (F.length(body) / area < threshold)


def source_label(doc_type: Text, filename: Text, pseudonym: Text) -> Column:
    """How a source is named: patients by pseudonym alone, other documents by their file's name."""
    patient = F.when(F.coalesce(_c(pseudonym), F.lit("")) != "", F.concat(F.lit("Patient "), _c(pseudonym))).otherwise("Patient record")
    name = F.regexp_replace(F.coalesce(_c(filename), F.lit("")), UPLOAD_PREFIX, "")
    return F.when(_c(doc_type) == "patient_record", patient).otherwise(F.when(name != "", name).otherwise("Unknown document"))


def readable() -> Column:
    """Patient chunks are read only once they are free of identifiers."""
    return (F.col("source_type") != "patient_record") | F.coalesce(F.col("deidentified"), F.lit(False))


def sniff(content: Text) -> Column:
    """Kind of a file by its first bytes: pdf, zip, gzip, html, xml or null."""
    head = F.substring(_c(content), 1, 2048)
    low = F.lower(F.substring(F.regexp_replace(F.make_valid_utf8(head.cast("string")), r"^[ \t\n\r\f\u000b]+", ""), 1, 512))
    magic = F.when(F.substring(head, 1, 4) == F.lit(bytearray(b"%PDF")), "pdf").when(F.substring(head, 1, 4) == F.lit(bytearray(b"PK\x03\x04")), "zip").when(F.substring(head, 1, 2) == F.lit(bytearray(b"\x1f\x8b")), "gzip")
    return magic.when(low.contains("<!doctype html") | low.contains("<html"), "html").when(low.startswith("<"), "xml")
