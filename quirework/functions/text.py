"""Column functions on titles, dates, ids, names and Markdown: JVM expressions throughout, so they fuse with their stage.

Patterns switch Unicode classes on with (?U), since a title's letters go beyond ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip(c: Column) -> Column:
    """Trims white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def match(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing matches."""
    found = F.regexp_extract(c, pattern, group)
    return F.when(found != "", found)


# ---- titles and slugs


def normalized_title(c: Column) -> Column:
    """Trimmed, lower case, without a section number such as `4.2.` or `a.1`, blanks collapsed."""
    low = F.lower(strip(c))
    return strip(F.regexp_replace(F.regexp_replace(low, r"(?U)^(?:\d+(?:\.\d+)*\.?|[a-z](?:\.\d+)+\.?|[a-z]\.)\s+", ""), r"(?U)\s+", " "))


def slug(c: Column, limit: int = 60) -> Column:
    """Lower case; letters, digits, `_` and `-` stay, runs of blanks become `-`."""
    kept = strip(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}_\s-]", ""))
    return F.substring(F.regexp_replace(kept, r"(?U)[\s]+", "-"), 1, limit)


def file_stem(c: Column, limit: int = 80) -> Column:
    """A name that any file system takes: letters, digits, `-`, `_`; cut at the last hyphen if that is beyond 80 %."""
    kept = F.regexp_replace(c, r"[^\p{L}\p{N} _-]", "")
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r" +", "-"), r"-{2,}", "-"), r"^-+|-+$", "")
    cut = F.substring(joined, 1, limit)
    at = F.length(cut) - F.instr(F.reverse(cut), "-")
    trimmed = F.when((F.instr(cut, "-") > 0) & (at > 0.8 * limit), F.substring(cut, F.lit(1), at.cast("int"))).otherwise(cut)
    return F.when(F.length(joined) <= limit, joined).otherwise(F.regexp_replace(trimmed, r"-+$", ""))


def title_stem(c: Column, limit: int = 80) -> Column:
    """A title as a file's name; `Unknown` where nothing of it is left."""
    return F.coalesce(F.nullif(file_stem(c, limit), F.lit("")), F.lit("Unknown"))


def basename(date: Column, title: Column, source: Column, short: Column | None = None, scheme: str = "arxiv-ym", limit: int = 255) -> Column:
    """Output name of a paper: `arxiv-ym` YYYYMM-source-[short-]title, `full-date` with the whole date, `title` alone.

    The title part shrinks until the whole fits `limit`.
    """
    day = F.when(date.rlike(r"^\d{8}$"), date if scheme == "full-date" else F.substring(date, 1, 6))
    head = F.concat_ws("-", day, file_stem(source), *([file_stem(short)] if short is not None else [])) if scheme != "title" else F.lit("")
    room = F.greatest(F.lit(1), F.lit(limit) - F.length(head) - 1)
    tail = F.substring(file_stem(title, 220), F.lit(1), room.cast("int"))
    return F.regexp_replace(F.concat_ws("-", F.when(head != "", head), F.when(tail != "", tail)), r"-+$", "")


# ---- ids


#: Shape of an arXiv id, and the path kinds of its pages.
ARXIV_ID = r"(\d{4}\.\d{4,5}|[a-zA-Z-]+/\d{7})"
PATH_KINDS = ("abs", "pdf", "html")


def arxiv_input(c: Column) -> Column:
    """struct(id, base, version, html_url, ar5iv_url, abs_url, error) of an id, a prefixed id or a page's address."""
    text = strip(c)
    bare = F.regexp_replace(text, r"(?i)^arxiv:\s*", "")
    is_url = bare.rlike(r"(?i)^(?:https?://)?(?:www\.|export\.)?(?:arxiv\.org|ar5iv\.(?:labs\.arxiv\.org|org))/")
    looks = bare.rlike(r"(?i)^https?://|^[\w.-]+\.\w+/") & ~bare.rlike(rf"^{ARXIV_ID}(?:v\d+)?$")
    in_path = F.regexp_extract(bare, rf"(?i)(?:^|/)(?:{'|'.join(PATH_KINDS)})/([^?#]+?)(?:\.pdf)?/?(?:[?#].*)?$", 1)
    ident = F.regexp_replace(F.when(in_path != "", in_path).otherwise(bare), r"(?i)\.pdf$", "")
    good = ident.rlike(rf"^{ARXIV_ID}(?:v\d+)?$") & (~looks | is_url)
    base = F.regexp_extract(ident, rf"^{ARXIV_ID}", 1)
    error = (
        F.when(F.coalesce(text, F.lit("")) == "", "empty input").when(looks & ~is_url, "unsupported host").when(~good, "not an arXiv id")
    )
    ok = lambda x: F.when(error.isNull(), x)
    return F.struct(
        ok(ident).alias("id"), ok(base).alias("base"), ok(F.nullif(F.regexp_extract(ident, r"(v\d+)$", 1), F.lit(""))).alias("version"),
        ok(F.concat(F.lit("https://arxiv.org/html/"), ident)).alias("html_url"), ok(F.concat(F.lit("https://ar5iv.labs.arxiv.org/html/"), ident)).alias("ar5iv_url"),
        ok(F.concat(F.lit("https://arxiv.org/abs/"), ident)).alias("abs_url"), error.alias("error"),
    )


def input_kind(c: Column) -> Column:
    """arxiv, local_html, local_archive, skip (blank or comment) or unknown."""
    text = strip(c)
    path = text.rlike(r"/|^[.~]") & ~text.rlike(r"(?i)^https?://")
    return (
        F.when(text.isNull() | (text == "") | text.startswith("#"), "skip")
        .when(path & text.rlike(r"(?i)\.html?$"), "local_html").when(path & text.rlike(r"(?i)\.(?:tar\.gz|tgz|zip|gz|tar)$"), "local_archive")
        .when(arxiv_input(text)["error"].isNull(), "arxiv").otherwise("unknown")
    )


def date_of_id(ident: Column) -> Column:
    """20YYMM01 of a new-style id, null for another or an impossible month."""
    month = F.regexp_extract(ident, r"^\d{2}(\d{2})\.\d{4,5}", 1)
    return F.when(month.rlike(r"^(?:0[1-9]|1[0-2])$"), F.concat(F.lit("20"), F.substring(ident, 1, 4), F.lit("01")))


def cache_key(base: Column, version: Column) -> Column:
    return F.replace(F.concat(base, F.lit("__"), F.coalesce(version, F.lit("latest"))), F.lit("/"), F.lit("_"))


def is_fresh(modified: Column, now: Column, ttl_s: int) -> Column:
    """A cached copy's state: absent is stale, no ttl is always fresh."""
    if ttl_s <= 0:
        return modified.isNotNull()
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(modified) <= ttl_s, F.lit(False))


#: Date formats besides YYYY-M-D.
DATE_FORMATS = ("d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM yyyy", "MMM yyyy")


def parsed_date(c: Column) -> Column:
    """YYYYMMDD of a date in one of several spellings, or null."""
    text = squeeze(c)
    numeric = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    iso = F.when(text.rlike(numeric), F.concat(F.regexp_extract(text, numeric, 1), F.lpad(F.regexp_extract(text, numeric, 2), 2, "0"), F.lpad(F.regexp_extract(text, numeric, 3), 2, "0")))
    plain = F.when(text.rlike(r"^\d{8}$"), text)
    named = [F.date_format(F.try_to_timestamp(text, F.lit(f)), "yyyyMMdd") for f in DATE_FORMATS]
    return F.coalesce(iso, plain, *named)


# ---- numbers, hashes


def human_count(n: Column) -> Column:
    """`950`, `12.3k`, `1.2M`."""
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fk", n / 1000)).otherwise(n.cast("string"))
    )


def fingerprint(parts: Column) -> Column:
    """SHA-256 over parts, each ended by a newline."""
    return F.sha2(F.concat(F.array_join(parts, "\n"), F.lit("\n")), 256)


# ---- lists of names


def distinct_ci(xs: Column) -> Column:
    """Distinct without regard to case; the first spelling and the order stay."""
    xs = F.filter(F.transform(xs, strip), lambda x: x != "")
    low = F.transform(xs, F.lower)
    return F.filter(xs, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def without_contained(xs: Column) -> Column:
    """Distinct, without those contained in a longer one."""
    d = distinct_ci(xs)
    return F.filter(d, lambda x: ~F.exists(d, lambda y: (F.length(y) > F.length(x)) & F.contains(F.lower(y), F.lower(x))))


def names_match(a: Column, b: Column) -> Column:
    """Equal but for case, blanks and full stops, the same last word, or the family name of a "Last, First" form as the other's last word."""
    whole = lambda n: F.lower(squeeze(F.replace(n, F.lit("."), F.lit(" "))))
    last = lambda n: F.lower(F.substring_index(squeeze(n), " ", -1))
    family = lambda n: F.when(F.contains(n, F.lit(",")), F.lower(strip(F.substring_index(n, ",", 1))))
    said = (strip(a) != "") & (strip(b) != "")
    same = (whole(a) == whole(b)) | (last(a) == last(b)) | F.coalesce(family(a) == last(b), F.lit(False)) | F.coalesce(family(b) == last(a), F.lit(False)) | F.coalesce(family(a) == family(b), F.lit(False))
    return F.coalesce(said & same, F.lit(False))


@F.pandas_udf(StringType())
def folded_name(names: pd.Series) -> pd.Series:
    """Lower case without accents or anything beyond ASCII, trimmed."""
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode("ascii").lower().strip())


#: Words that tell an affiliation.
AFFILIATION_WORDS = [
    "university", "college", "institute", "institution", "laboratory", "lab", "school", "center", "centre", "department", "faculty", "division", "academy",
    "consortium", "corporation", "corp", "inc", "ltd", "gmbh", "research", "google", "microsoft", "meta", "amazon", "apple", "deepmind", "openai", "anthropic",
    "nvidia", "intel", "ibm", "facebook", "twitter", "tesla", "uber", "lyft", "airbnb", "netflix", "stripe", "square", "berkeley", "stanford", "mit",
    "harvard", "caltech", "cmu", "princeton", "yale", "columbia", "cornell", "oxford", "cambridge", "eth", "epfl", "mpi", "inria", "cern", "nasa",
    "flatiron", "allen", "astera",
]
#: Parts of an author list that name nobody; footnote marks.
SKIP_WORDS = ["footnotemark:", "equal contribution", "work performed", "listing order"]
FOOTNOTE_MARKS = r"[\*†‡§¶‖#♯\d]+"
#: A place: a capitalized word, a comma, and another one of two letters or more.
PLACE = r"\b[A-Z][a-z]+,\s*[A-Z]\s*[a-zA-Z]"
_WORDS = "(?i)" + "|".join(AFFILIATION_WORDS)


def looks_like_name(c: Column) -> Column:
    """One to six words without an affiliation's word in them, a comma, an @, or all capitals beyond three letters."""
    t = strip(F.regexp_replace(c, FOOTNOTE_MARKS + "$", ""))
    words = F.size(F.split(F.regexp_replace(t, r"(?U)\s+", " "), " "))
    capitals = (F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) > 3)
    return F.coalesce((t != "") & (words <= 6) & ~t.rlike(_WORDS) & ~F.contains(t, F.lit(",")) & ~capitals & ~F.contains(t, F.lit("@")), F.lit(False))


def looks_like_affiliation(c: Column) -> Column:
    """An affiliation's word, `City, Country`, up to four words with a digit or bracket, or one capitalized word."""
    t = strip(c)
    words = F.size(F.split(F.regexp_replace(t, r"(?U)\s+", " "), " "))
    few = (words <= 4) & (t.rlike(r"[\d()\[\]]") | ((words == 1) & t.rlike(r"^\p{Lu}")))
    return F.coalesce((F.length(t) >= 2) & (t.rlike(_WORDS) | t.rlike(PLACE) | few), F.lit(False))


# ---- identifiers in references


#: Identifiers as references write them.
DOI, ARXIV_REF, URL, PMID = r"(?i)10\.\d{4,}/[^\s\"'<>]+", r"(?i)arXiv:(\d{4}\.\d{4,}(?:v\d+)?)", r"(?i)https?://[^\s<>\"']+", r"(?i)PMID:\s*(\d+)"


def identifiers(c: Column) -> Column:
    """map of doi, arxiv, pmid and url found in a reference; a url only without a doi, and not of the resolver."""
    doi = F.regexp_replace(match(c, DOI, 0), r"\.+$", "")
    url = match(c, URL, 0)
    pairs = {"doi": doi, "arxiv": match(c, ARXIV_REF), "pmid": match(c, PMID), "url": F.when(doi.isNull() & ~url.startswith("https://doi.org/"), url)}
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def orcid(c: Column) -> Column:
    return match(c, r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])")


def without_version(ident: Column) -> Column:
    return F.regexp_replace(ident, r"v\d+$", "")


def is_arxiv_doi(doi: Column) -> Column:
    return F.lower(doi).startswith("10.48550/arxiv.")


# ---- formulas and listings


def without_math_spacing(c: Column) -> Column:
    """Formula without spacing commands at its end."""
    return F.regexp_replace(c, r"(?:\\(?: |,|;|:|!|quad|qquad|hspace\{[^}]*\})\s*)+$", "")


def listing_text(href: Column) -> Column:
    """Text of a base64 data address, null if it isn't one."""
    return F.decode(F.try_to_binary(F.regexp_extract(href, r"(?s)^data:text/plain[^,]*;base64,(.*)$", 1), F.lit("base64")), "utf-8")


# ---- Markdown


def md_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\\[\]])", r"\\$1")


def url_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def tidy_markdown(c: Column) -> Column:
    """At most one empty line in a row, no blanks at line ends, one newline at the end."""
    return F.concat(strip(F.regexp_replace(F.regexp_replace(c, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")), F.lit("\n"))


#: How a page's TeX lifts a symbol, by a raisebox around boxes of no width and height.
LIFTED = r"\\raisebox\{[^}]+\}\{\\hbox to 0\.0\s*pt\{\\hss\\vbox to 0\.0\s*pt\{\\hbox\{\$(?<held>[^$]*)\$\}\\vss\}\}\}"


def simple_display_math(c: Column) -> Column:
    """Body of a display formula: a lifted symbol by itself, no dollar sign before a number at the end, and none that isn't escaped."""
    bare = F.regexp_replace(F.regexp_replace(c, LIFTED, "${held}"), r"\$\s*(?=\(\d+\)\s*$)", "")
    return F.regexp_replace(F.replace(bare, F.lit("$}"), F.lit("}")), r"(?<!\\)\$", "")


_TOKENS = r"(?s)\$\$.*?\$\$|\$\$.*|\$[^$]*\$|\$|[^$]+"


def math_tokens(c: Column) -> Column:
    """Markdown cut into formulas and what is between them."""
    return F.regexp_extract_all(c, F.lit(_TOKENS), F.lit(0))


def spaced_math(c: Column) -> Column:
    """Inline formulas trimmed, on one line and set off by a blank from letters and digits beside them; display ones stay."""
    return spaced_tokens(math_tokens(c))


def spaced_tokens(tokens: Column) -> Column:
    inline = lambda t: t.rlike(r"(?s)^\$[^$]+\$$")
    body = lambda t: without_math_spacing(strip(F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r"\s*\n\s*", " ")))

    def one(t: Column, i: Column) -> Column:
        before, after = F.try_element_at(tokens, i), F.try_element_at(tokens, i + 2)
        before = F.when(i > 0, before)
        left = F.when(before.rlike(r"(?U)(?s).*\w$"), " ").otherwise("")
        right = F.when(after.rlike(r"(?U)(?s)^\w.*"), " ").otherwise("")
        return F.when(inline(t), F.concat(left, F.lit("$"), body(t), F.lit("$"), right)).otherwise(t)

    return F.array_join(F.transform(tokens, one), "")


def formatted_markdown(c: Column, keep_anchors: bool = True) -> Column:
    """Finishing of Markdown: an empty line after anchors, table captions as quotes, single bullets, tidy lines."""
    c = F.regexp_replace(c, r'(?<tag><a id="[^"]+"></a>)\n(?=[^\n]*\S)', "${tag}\n\n")
    c = F.regexp_replace(c, r"\n\*\*(?<caption>Table\s+\d+[^*]*+)\*\*\s*\n(?=\|)", "\n\n> ${caption}\n\n")
    c = F.regexp_replace(c, r"(?m)^(?<bullet>\s*-\s+)[•·◦]\s+", "${bullet}")
    if not keep_anchors:
        c = F.regexp_replace(c, r'<a id="[^"]*"></a>', "")
    return tidy_markdown(c)


def md_table(rows: Column) -> Column:
    """Pipe table of array<array<string>>: padded to the longest row, the first row as head, pipes and newlines escaped."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?<!\\)\|", r"\\|"), "\n", "<br>")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width.cast("int")))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def numbered_references(c: Column) -> Column:
    """Bullets at the line's beginning get `[n]` and an anchor ref-n, in order."""
    lines = F.split(c, "\n", -1)
    is_entry = lambda x: x.rlike(r"^[-*] ")
    n = F.transform(lines, lambda x, i: F.size(F.filter(F.slice(lines, F.lit(1), i + 1), is_entry)))
    mark = F.zip_with(lines, n, lambda x, k: F.when(is_entry(x), F.concat(F.lit('- <a id="ref-'), k.cast("string"), F.lit('"></a>['), k.cast("string"), F.lit("] "), F.substring(x, F.lit(3), F.length(x)))).otherwise(x))
    return F.array_join(mark, "\n")


def joined_output(summary: Column, tree: Column, content: Column, with_tree: bool = True) -> Column:
    """What a run prints: the summary, the sections' tree if it is asked for, the content, an empty line between; parts that are absent leave nothing."""
    parts = [summary, tree, content] if with_tree else [summary, content]
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "\n\n")


# ---- BibTeX


#: Characters of TeX and how BibTeX writes them, in the order in which they are replaced.
BIBTEX_ESCAPES = [
    ("\\", "\\textbackslash{}"), ("{", "\\{"), ("}", "\\}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("^", "\\^{}"), ("~", "\\textasciitilde{}"),
]


def bibtex_escape(c: Column) -> Column:
    for a, b in BIBTEX_ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def citation_key(authors: Column, year: Column, title: Column, index: Column | None = None) -> Column:
    """Family name of the first author and the year; a title's first word only without authors; a number above 0 behind."""
    first = F.try_element_at(F.filter(authors, lambda a: strip(a) != ""), F.lit(1))
    family = F.when(F.contains(first, F.lit(",")), strip(F.substring_index(first, ",", 1))).otherwise(F.substring_index(squeeze(first), " ", -1))
    word = F.when(first.isNull(), F.substring_index(squeeze(title), " ", 1))
    plain = lambda x: F.regexp_replace(x, r"(?U)[^\w]", "")
    k = F.coalesce(index, F.lit(0)) if index is not None else F.lit(0)
    key = F.concat_ws("", plain(family), F.nullif(year, F.lit("")), plain(F.nullif(word, F.lit(""))))
    return F.lower(F.concat(F.when(key != "", key).otherwise(F.concat(F.lit("ref"), k.cast("string"))), F.when(k > 0, k.cast("string")).otherwise("")))


def bibtex_authors(authors: Column) -> Column:
    """`Last, First and Last, First`."""
    one = lambda a: F.when(F.contains(a, F.lit(",")) | ~F.contains(squeeze(a), F.lit(" ")), strip(a)).otherwise(
        F.concat(F.substring_index(squeeze(a), " ", -1), F.lit(", "), F.regexp_extract(squeeze(a), r"^(.*) \S+$", 1))
    )
    return F.array_join(F.transform(F.filter(authors, lambda a: strip(a) != ""), one), " and ")


#: Order of an entry's fields, and the entry types that have them.
BIBTEX_FIELDS = ["title", "author", "year", "journal", "booktitle", "volume", "number", "pages", "doi", "url", "publisher", "abstract", "note"]
BIBTEX_ONLY = {"journal": ("article",), "booktitle": ("inproceedings", "incollection")}


def bibtex_entry(kind: Column, key: Column, fields: dict[str, Column]) -> Column:
    parts = []
    for name in BIBTEX_FIELDS:
        if name in fields:
            value = fields[name]
            text = value if name in ("doi", "url") else bibtex_escape(value)
            there = value.isNotNull() & (value != "")
            if name in BIBTEX_ONLY:
                there &= kind.isin(*BIBTEX_ONLY[name])
            parts.append(F.when(there, F.concat(F.lit(f"  {name} = {{"), text, F.lit("}"))))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(F.array_compact(F.array(*parts)), ",\n"), F.lit("\n}"))


def short_citation(authors: Column, year: Column, title: Column, ident: Column | None = None) -> Column:
    """`A. (year). Title. arXiv:id.`, `A and B`, `A et al.`; a title beyond 60 characters is cut; '' without authors or a title."""
    a = F.filter(authors, lambda x: strip(x) != "")
    who = F.when(F.size(a) == 1, F.get(a, F.lit(0))).when(F.size(a) == 2, F.concat_ws(" and ", a)).otherwise(F.concat(F.get(a, F.lit(0)), F.lit(" et al.")))
    cut = F.when(F.length(title) > 60, F.concat(F.substring(title, 1, 57), F.lit("..."))).otherwise(title)
    given = lambda c: F.nullif(c, F.lit(""))
    parts = [who, F.concat(F.lit("("), given(year), F.lit(")")), cut, F.concat(F.lit("arXiv:"), given(ident)) if ident is not None else F.lit(None).cast("string")]
    there = (F.size(a) > 0) & (F.coalesce(title, F.lit("")) != "")
    return F.when(F.coalesce(there, F.lit(False)), F.concat(F.array_join(F.array_compact(F.array(*parts)), ". "), F.lit("."))).otherwise("")


def paper_bibtex(authors: Column, year: Column, title: Column, ident: Column, category: Column, url: Column) -> Column:
    """`misc` entry of a paper by its id, keyed by the first author's family name, the year and the id up to its point; '' where one of these is missing."""
    a = F.filter(authors, lambda x: strip(x) != "")
    first = F.get(a, F.lit(0))
    family = F.when(F.contains(first, F.lit(",")), F.substring_index(first, ",", 1)).otherwise(F.substring_index(squeeze(first), " ", -1))
    key = F.concat(F.lower(F.regexp_replace(family, "[^a-zA-Z]", "")), year, F.substring_index(ident, ".", 1))
    braces = F.replace(F.replace(title, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    given = lambda c: F.nullif(c, F.lit(""))
    line = lambda name, v: F.concat(F.lit(f"  {name} = {{"), v, F.lit("},"))
    lines = [
        F.concat(F.lit("@misc{"), key, F.lit(",")), line("author", bibtex_authors(a)), line("title", braces), line("year", year), line("eprint", without_version(ident)), F.lit("  archivePrefix = {arXiv},"),
        line("primaryClass", given(category)), line("url", given(url)), F.lit("}"),
    ]
    there = (F.size(a) > 0) & (given(title).isNotNull()) & given(year).isNotNull() & given(ident).isNotNull()
    return F.when(F.coalesce(there, F.lit(False)), F.array_join(F.array_compact(F.array(*lines)), "\n")).otherwise("")
