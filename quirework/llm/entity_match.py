"""Matching entities across sources without keys (problem 1): a deterministic rule cascade.

Citations are matched with catalogue works by exact joins on weaker and weaker attribute combinations. A record is matched by
the strongest rule that fits: a title that one work has resolves it where it is joined, else the candidates of rules 1 to 7 are
gathered and the first rule that names exactly one work counts; only what is left goes on to rules 8 and 9. A rule whose
candidates don't name exactly one work resolves nothing and leaves the record to the next. Titles that several works share
never join by themselves, only together with an author. A rule's confidence is its precision on labelled pairs, smoothed:
the other records of the same bibliography item that the strictest rule matched tell whether its match was right. A record
never labels itself, and items whose records disagree count with their shares.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .arrow import map_columns
from .names import PARTICLES, fold, lcs_ratio

#: Letters of a cut-off title's beginning by which it is looked up, the longest that it has; a beginning below SAYS_ENOUGH needs a year too.
PREFIXES, SAYS_ENOUGH = (24, 12, 6), 24
#: Full stops and colons that a title cut off in a reference line may hold.
TITLE_STOPS = 3
#: Smoothing of a rule's precision: as if PRIOR_N labelled pairs had been seen, PRIOR of them right.
PRIOR_N, PRIOR = 20, 0.9
YEARS = re.compile(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)")


_NOT_TITLE, _SIGNS = re.compile(r"</?[a-zA-Z][^<>]*>|\\[a-zA-Z]+\s*(?=\{)|[{}’'‐-]"), re.compile(r"[<\\{}’'‐-]")
#: Bytes of which words of titles and of names consist, in lower case; all others are blanks.
_TITLE_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else 32 for b in range(256))
_NAME_BYTES = bytes(b if chr(b).isalpha() else 32 for b in _TITLE_BYTES)


def title_words(title: str) -> str:
    """Words of a title without case, accents, braces, entities, markup and line-break hyphens, joined by blanks."""
    t = html.unescape(title) if "&" in title else title
    if "\n" in t:
        t = re.sub(r"-\s*\n\s*", "", t)
    if _SIGNS.search(t):
        t = _NOT_TITLE.sub("", t)
    if not t.isascii():
        t = fold(t)
    if "&" in t:
        t = t.replace("&", " and ")
    # letters of other alphabets part words
    return b" ".join(t.encode("ascii", "replace").translate(_TITLE_BYTES).split()).decode()


def title_key(title: str) -> str:
    return title_words(title).replace(" ", "")


#: Words by which a later part, a new version or a comment differs from the work itself.
SEQUEL = frozenset("ii iii iv v vi 2 3 4 two three part revisited second again corrected correction corrigendum erratum errata extended extension extensions supplement supplementary look reply comment continued".split())


def same_title(a: str, b: str) -> bool:
    """Whether two titles' words differ by a typing error or one missing word only, and not by a sequel's."""
    x, y = a.split(), b.split()
    if len(x) == len(y):
        off = [(p, q) for p, q in zip(x, y) if p != q]
        if len(off) != 1 or off[0][0] in SEQUEL or off[0][1] in SEQUEL or min(map(len, off[0])) < 4:
            return not off
        p, q = off[0]
        return lcs_ratio(p, q) >= 0.75 and abs(len(p) - len(q)) <= 1
    if abs(len(x) - len(y)) != 1:
        return False
    if len(x) > len(y):
        x, y = y, x
    k = next((i for i, p in enumerate(x) if p != y[i]), len(x))
    # two words written as one, or one left out
    if k < len(x) and y[k] + y[k + 1] == x[k] and x[k + 1 :] == y[k + 2 :]:
        return True
    return len(x) >= 4 and x[k:] == y[k + 1 :] and y[k] not in SEQUEL


def is_cut(title: str) -> bool:
    return ("..." in title or "…" in title) and bool(re.search(r"(?:\.{3,}|…)\W*$", title))


def name_tokens(names: list[str]) -> list[str]:
    """Words of author names, two letters at least, joined over apostrophes and hyphens."""
    out: dict[str, None] = {}
    for n in names:
        for w in re.split(r"[^a-z]+", re.sub(r"[’'‐-]", "", fold(n))):
            if len(w) >= 2 and w not in PARTICLES:
                out[w] = None
    return list(out)


def family_names(authors: list[str]) -> list[str]:
    """Family names of catalogue authors ("Family, Given"), without particles."""
    out: dict[str, None] = {}
    for a in authors:
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"[’'‐-]", "", fold(a.split(",")[0]))) if w and w not in PARTICLES]
        if words:
            out[words[-1] if "," not in a else "".join(words)] = None
    return list(out)


#: Where a title may stand in a reference line: in quotes; after the year; after the authors' colon up to "In:"; after the
#: volume, page and year; between full stops.
_STYLES = [
    re.compile(r"[“\"„](.+?),?[”\"]", re.S),
    re.compile(r"\(\d{4}[a-z]?\)\s*[.:,]\s*(.+?)\.(?=\s+[A-Z][^.]*\d|\s+[A-Z]\w*\.|\s*$)", re.S),
    re.compile(r"\(\d{4}[a-z]?\)\s*:\s*(.+?)\s*$", re.S),
    re.compile(r"^\s*(?:\[\w+\]\s*)?[^:]{3,}:\s+(.+?)\.?\s+In:\s", re.S | re.I),
]
_DOT, _NEXT_WORD = re.compile(r"\.\s+"), re.compile(r"[A-Z{][\w}{-]{2,} [\w{]")


def _is_stop(raw: str, dot: int, end: int) -> bool:
    """Whether a full stop ends a segment of a reference line: after a word, after another stop, or after an initial where a capitalized word of a title follows."""
    nxt = raw[end : end + 1]
    if not (nxt == "_" or nxt == "{" or nxt == "“" or nxt.isalnum()):
        return raw[dot - 2 : dot] == "al"
    before = raw[dot - 1 : dot]
    if before == ".":
        return True
    return before.isalpha() and (raw[dot - 2 : dot - 1].isalpha() or bool(_NEXT_WORD.match(raw, end)))


def titles_in(raw: str) -> list[str]:
    """Words of what may be the title in a reference line."""
    found: dict[str, None] = {}
    quoted, dated, within = "“" in raw or '"' in raw or "„" in raw, "(" in raw, "in:" in raw.lower()
    # a style is tried only where its signs are
    for style, there in zip(_STYLES, (quoted, dated, dated, within)):
        if there:
            for m in style.finditer(raw):
                found[title_words(m[1])] = None
    at = [0, *(m.end() for m in _DOT.finditer(raw) if m.start() > 0 and _is_stop(raw, m.start(), m.end())), len(raw)]
    for k in range(1, len(at) - 1):
        found[title_words(raw[at[k] : at[k + 1]])] = None
    return [k for k in found if len(k) >= 6]


_CUT, _QUOTE, _PART = re.compile(r"\.{3,}|…"), re.compile("[“”\"]"), re.compile(r"[.:]\s+")


def cut_titles(title: str, raw: str) -> list[str]:
    """Keys of a title's known beginning, if the record has it cut off: what stands before an ellipsis, since the last quote or ellipsis.

    A reference line has the authors before the title, so each of the last parts between stops may be where it begins.
    """
    out: dict[str, None] = {}
    for text, line in ((title, False), (raw, True)):
        at = 0
        for m in _CUT.finditer(text or ""):
            piece = text[at : m.start()]
            at = m.end()
            quotes = [q.end() for q in _QUOTE.finditer(piece)]
            keys = [title_key(p) for p in _PART.split(piece[quotes[-1] :] if quotes else piece)]
            starts = {0} if not line else ({0} if quotes else set()) | set(range(max(1, len(keys) - 1 - TITLE_STOPS), len(keys)))
            for k in starts:
                if len(key := "".join(keys[k:])) >= PREFIXES[-1]:
                    out[key] = None
    return list(out)


def _years(year: str, raw: str) -> list[int]:
    """The record's own year, else those in its reference line."""
    if m := YEARS.search(year or ""):
        return [int(m[1])]
    return [int(y) for y in YEARS.findall(raw or "")]


@lru_cache(maxsize=200_000)
def _who(token: str) -> int:
    return xxhash.xxh32_intdigest(token) - (1 << 31)


@lru_cache(maxsize=50_000)
def _tokens_of(name: str) -> tuple[str, ...]:
    return tuple(name_tokens([name]))


def _key(words: Column) -> Column:
    return F.xxhash64(F.replace(words, F.lit(" "), F.lit("")))


#: A capital and a small letter alone.
_SHORT_NAMES = re.compile(r"[A-Z](?<!\w[A-Z])[^\W\d_A-Z](?!\w)")
#: What stands between authors in one text; like every sign it parts words of a name.
BETWEEN = "\x1f"


def names_in(raw: str) -> set[str]:
    """Words of three letters at least in a reference line, joined over apostrophes and hyphens, and those of two that their capital tells to be names."""
    t = raw if raw.isascii() else fold(raw).replace("’", "").replace("‐", "")
    out = {w for w in t.encode("ascii", "replace").translate(_NAME_BYTES, b"'-").decode().split() if len(w) > 2}
    out.update(map(fold, _SHORT_NAMES.findall(raw)))
    return out


def _read_citations():
    def f(ids: list, items: list, titles: list, years: list, authors: list, raws: list) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("words", "lines", "cuts", "people", "names", "years")}
        for t, y, au, r in zip(titles, years, authors, raws):
            cut = bool(t) and is_cut(t)
            words = title_words(t) if t and not cut else ""
            people: set[str] = set()
            if au:
                for x in au.split(BETWEEN):
                    people.update(_tokens_of(x))
            within = []
            if r:
                # names in the reference line, of which the title is no part
                people |= names_in(r).difference(words.split(), PARTICLES)
                # the longest first, the likeliest title of a record without one
                within = sorted([w for w in titles_in(r) if w != words], key=len, reverse=True)
            out["words"].append(words or None)
            out["lines"].append(within)
            out["cuts"].append(cut_titles(t if cut else "", r if r and ("..." in r or "…" in r) else "") if cut or r else [])
            out["people"].append(list(map(_who, people)))
            # shorter ones are never a misspelled name's
            out["names"].append(" ".join([p for p in people if len(p) >= 4]) if words else "")
            out["years"].append(_years(y, r))
        return out | {"id": ids, "item": items}

    return f


def _same():
    def f(ids: list, items: list, works: list, a: list, b: list, common: list, near: list) -> dict[str, list]:
        keep = [k for k, (x, y) in enumerate(zip(a, b)) if any(same_title(t, y) for t in x)]
        return {n: [v[k] for k in keep] for n, v in (("id", ids), ("item", items), ("work", works), ("common", common), ("near", near))}

    return f


def _read_works():
    def f(ids: list, titles: list, authors: list, years: list) -> dict[str, list]:
        words = [title_words(t) if t else "" for t in titles]
        people = [family_names([x for x in a or [] if x]) for a in authors]
        return {"work": ids, "wwords": words, "family": [[_who(p) for p in f] for f in people], "fnames": people, "wyear": years}

    return f


def _strongest(candidates: DataFrame, rules: dict[int, Column]) -> DataFrame:
    """(id, item, work, rule): each record's first rule whose best candidates name one work; more authors in common and nearer years are better."""
    # of the best candidates, the largest and the least work
    tops = [
        F.max(F.when(fits, F.struct("common", "near", work.alias("work")))).alias(f"{side}{rule}")
        for rule, fits in rules.items() for side, work in (("top", F.col("work")), ("low", F.bitwise_not("work")))
    ]
    each = candidates.groupBy("id").agg(F.first("item").alias("item"), *tops)
    one = [F.when(F.col(f"top{r}.work") == F.bitwise_not(F.col(f"low{r}.work")), F.struct(F.col(f"top{r}.work").alias("work"), F.lit(r).alias("rule"))) for r in rules]
    return each.select("id", "item", F.coalesce(*one).alias("found")).filter("found is not null").select("id", "item", "found.work", "found.rule")


def _near_year() -> Column:
    """-1 if the years contradict, 0 if one isn't known, 1 a year apart, 2 the same."""
    has = lambda d: F.array_contains("years", F.col("wyear") + d)
    return F.when(F.col("wyear").isNull() | (F.size("years") == 0), 0).when(has(0), 2).when(has(1) | has(-1), 1).otherwise(-1)


END = 16
#: What each rule demands, strongest first.
RULES = {
    1: "title, an author, the year or one off", 2: "title, an author", 3: "title in the reference line, an author, the year or one off", 4: "title in the reference line, an author",
    5: "beginning of a cut-off title, an author, the year or one off", 6: "title that one work has, the year or one off, no author known", 7: "title that one work has, an author's name misspelled",
    8: "an author, the year or one off, a title with a typing error or a word less", 9: "another record of the same item",
}


def match(citations: DataFrame, works: DataFrame) -> DataFrame:
    """(id, item, work, rule) of each citation that a rule matches with one work.

    citations: citation_id, arxiv_id, cite_key, title, pub_year, authors, raw_text; works: work_id, title, authors, pub_year.
    Any of them can be null or empty: a record with neither title nor reference line is matched by rule 9 only, a work
    without a title or authors never by rules that need them. Rows repeated with their id are one record; ties name no work; empty
    tables give an empty result; further columns aren't read.
    """
    item = F.when(F.col("arxiv_id").isNotNull() & F.col("cite_key").isNotNull(), F.xxhash64("arxiv_id", "cite_key")).alias("item")
    c = map_columns(
        citations.select("citation_id", item, "title", "pub_year", F.array_join("authors", BETWEEN).alias("authors"), "raw_text"), _read_citations,
        "id long, item long, words string, lines array<string>, cuts array<string>, people array<int>, names string, years array<int>",
    )
    w = map_columns(works.select("work_id", "title", "authors", F.col("pub_year").cast("int")), _read_works, "work long, wwords string, family array<int>, fnames array<string>, wyear int")
    w = cut_lineage(w.filter("wwords != ''").withColumn("wkey", _key(F.col("wwords"))))
    w = cut_lineage(w.join(w.groupBy("wkey").agg(F.count("*").alias("k")), "wkey"))
    alone, generic = w.filter("k = 1"), w.filter("k > 1").select("wkey").distinct()
    several = w.filter("k > 1").select("work", "wkey", F.explode("family").alias("who"))

    # people are hashes of name words: what moves between tasks is a few numbers a record
    common = F.size(F.array_intersect("people", "family"))
    rest = lambda df, d: df.join(d.select("id"), "id", "left_anti")

    # rules 1, 2, 6, 7: by a title that one work has. Each record moves once, with all that later rules need, and there is one candidate
    # at most. A record without a title goes where its id's hash says, and is told by its lack of words
    sole = alone.select("wkey", F.lit(False).alias("shared"), "work", "family", "fnames", "wyear", (F.length("wwords") >= 20).alias("tells"))
    sole = sole.unionByName(generic.withColumn("shared", F.lit(True)), allowMissingColumns=True)
    c = c.withColumn("wkey", F.when(F.col("words").isNull(), F.xxhash64("id")).otherwise(_key(F.col("words")))).join(sole, "wkey", "left")
    c = c.withColumn("one", F.col("words").isNotNull() & F.col("work").isNotNull()).withColumn("common", F.when(F.col("one"), common)).withColumn("near", F.when(F.col("one"), _near_year()))
    c = c.withColumn("rule", F.when(F.expr("common > 0 and near >= 1"), 1).when(F.expr("common > 0 and near = 0 or common > 1"), 2))
    typo = F.exists(F.split("names", " "), lambda p: F.exists("fnames", lambda f: (F.levenshtein(p, f, 2) >= 0) & (F.length(f) >= 6)))
    # where no author is in common the title must say enough; the author is misspelled, or none is known
    weak = F.when(F.col("tells") & (F.col("common") == 0), F.when(F.size("people") == 0, F.when(F.col("near") >= 1, 6)).when((F.col("near") >= 0) & (F.col("names") != "") & typo, 7))
    kept = [F.when(F.col("rule").isNull(), F.col(x)).alias(x) for x in ("words", "lines", "cuts", "people", "years")]
    c = cut_lineage(c.select("id", "item", "rule", weak.alias("weak"), F.when(F.col("one"), F.col("work")).alias("work"), F.when(F.col("words").isNotNull() & F.col("shared"), F.col("wkey")).alias("wkey"), *kept))
    done = c.filter("rule is not null").select("id", "item", "work", "rule")
    left = c.filter("rule is null")

    # the other candidates of rules 1 to 7: only ids and keys move until a work is found. A title that several works have joins with an author only
    each = lambda df, *by, people="people": df.select(*by, F.explode(people).alias("who"))
    many = each(left.filter("wkey is not null"), "id", "wkey").join(several, ["wkey", "who"])
    # rules 3, 4: by a title in the reference line
    keys = left.select("id", F.explode("lines").alias("t")).select("id", _key(F.col("t")).alias("wkey"))
    lone = keys.join(alone.select("wkey", "work"), "wkey")
    dup = each(keys.join(generic, "wkey", "left_semi").join(left.select("id", "people"), "id"), "id", "wkey").join(several, ["wkey", "who"])
    # rule 5: by the beginning of a title that is cut off, and an author; a short beginning needs the year too
    begins = left.filter(F.size("cuts") > 0).select("id", "people", F.explode("cuts").alias("t"))
    begins = each(begins, "id", F.coalesce(*[F.when(F.length("t") >= n, F.substring("t", 1, n)) for n in PREFIXES]).alias("p"))
    full = F.replace("wwords", F.lit(" "), F.lit(""))
    heads = F.array_distinct(F.array(*[F.substring(full, 1, n) for n in PREFIXES]))
    begin = each(w.select("work", "family", F.explode(heads).alias("p")), "work", "p", people="family")
    both = lambda df, by, key: df.select(by, F.xxhash64(key, "who").alias("h"))
    begun = both(begins, "id", "p").join(both(begin, "work", "p"), "h")
    pairs = [df.select("id", "work", F.lit(k).alias("kind")) for df, k in ((many, 1), (lone, 3), (dup, 3), (begun, 5))]
    pairs = pairs[0].union(pairs[1]).union(pairs[2]).union(pairs[3]).union(left.filter("weak is not null").select("id", "work", "weak"))
    pairs = pairs.join(w.select("work", "family", "wyear", "wwords"), "work").select("id", "work", "kind", "family", "wyear", F.when(F.col("kind") == 5, full).alias("wtitle"))
    pairs = pairs.join(left.select("id", "item", "people", "years", "cuts"), "id").select("id", "item", "work", "kind", common.alias("common"), _near_year().alias("near"), "cuts", "wtitle")
    fits = F.exists("cuts", lambda t: F.col("wtitle").startswith(t) & ((F.col("near") >= 1) | (F.col("near") == 0) & (F.length(t) >= SAYS_ENOUGH)))
    pairs = pairs.withColumn("kind", F.when((F.col("kind") != 5) | (F.col("common") > 0) & fits, F.col("kind"))).drop("cuts", "wtitle").filter("kind is not null")
    second = "common > 0 and near = 0 or common > 1"
    more = cut_lineage(_strongest(pairs, {
        1: F.expr("kind = 1 and common > 0 and near >= 1"), 2: F.expr(f"kind = 1 and ({second})"), 3: F.expr("kind = 3 and common > 0 and near >= 1"), 4: F.expr(f"kind = 3 and ({second})"),
        5: F.expr("kind = 5"), 6: F.expr("kind = 6"), 7: F.expr("kind = 7"),
    }))

    # rule 8: a misspelled title or one without a word, by either end of the title and an author. What stands in the reference
    # line is tried piece by piece, beside the record's own title. Ends that no work has go first; those left join with an
    # author's name only, so that titles with a common ending don't meet by it alone
    texts = F.filter(F.concat(F.array("words"), "lines"), lambda t: F.length(t) >= 14)
    # short titles have short ends, so that an error in the middle leaves one alone; lengths between have both
    pair = lambda t, n: F.array(F.xxhash64(F.lit(f"<{n}"), F.substring(t, 1, n)), F.xxhash64(F.lit(f">{n}"), F.right(t, F.lit(n))))
    none = F.expr("cast(array() as array<bigint>)")
    ends = lambda t: F.concat(F.when(F.length(t) < 2 * END + 2, pair(t, END // 2)).otherwise(none), F.when(F.length(t) >= 2 * END - 6, pair(t, END)).otherwise(none))
    offer = w.select("work", "family", F.explode(ends(full)).alias("e"))
    ask = left.select("id", F.explode(texts).alias("t")).select("id", F.explode(ends(F.replace("t", F.lit(" "), F.lit("")))).alias("e")).join(offer.select("e").distinct(), "e", "left_semi").distinct()
    who = each(ask.join(rest(left.select("id", "people"), more), "id"), "id", "e")
    met = both(who, "id", "e").join(both(each(offer, "work", "e", people="family"), "work", "e"), "h").select("id", "work").distinct()
    near = met.join(w.select("work", "wwords", "family", "wyear"), "work").join(left.select("id", "item", "people", "years", texts.alias("texts")), "id")
    near = near.select("id", "item", "work", "texts", "wwords", common.alias("common"), _near_year().alias("near")).filter("common > 0 and near >= 0")
    near = map_columns(near, _same, "id long, item long, work long, common int, near int")
    last = cut_lineage(_strongest(near, {8: F.lit(True)}))
    done = done.unionByName(more).unionByName(last)

    # rule 9: other records of an item, where they agree
    agreed = done.filter("item is not null").groupBy("item").agg(F.min("work").alias("work"), F.max("work").alias("top")).filter("work = top").select("item", "work")
    others = rest(left.select("id", "item").filter("item is not null"), more.unionByName(last)).join(agreed, "item").join(left.select("id", F.coalesce("words", F.get("lines", F.lit(0))).alias("t"), "lines"), "id").join(w.select("work", "wwords"), "work")
    piece = F.exists("lines", lambda t: (F.length(t) >= 14) & (F.levenshtein(t, "wwords", 6) >= 0))
    fits = F.col("t").isNull() | (F.size("lines") > 0) & (F.levenshtein("t", "wwords", 6) >= 0) | (F.levenshtein("t", "wwords", 4) >= 0) | piece
    return done.unionByName(others.filter(fits).select("id", "item", "work", F.lit(9).alias("rule"))).distinct()


def rule_confidence(matches: DataFrame) -> DataFrame:
    """(rule, labelled, right, confidence): each rule's smoothed precision on records that other records of their item label.

    A record of rules 1 to 8 is labelled by the item's other records that rule 1 matched; where those disagree, it is right by the
    share that has its work. Rule 9, which copies from the item's other records, is tried on records whose own work rule 1
    knows, as if they had none: labelled where all others agree, right where that is the record's own work. Counts by item
    and work suffice for both, so no pairs are made. A rule without labels has the prior's confidence.
    """
    own = matches.filter("rule < 9 and item is not null")
    votes = own.groupBy("item", "work").agg(F.count("*").alias("n"), F.count(F.when(F.col("rule") == 1, 1)).alias("n1"))
    items = votes.groupBy("item").agg(F.sum("n1").alias("all1"), F.count("*").alias("works"))
    each = own.groupBy("item", "work", "rule").agg(F.count("*").alias("m")).join(votes, ["item", "work"]).join(items, "item")
    self1 = (F.col("rule") == 1).cast("long")
    others = F.col("all1") - self1
    usual = each.filter(others > 0).select("rule", F.col("m").cast("double").alias("labelled"), (F.col("m") * (F.col("n1") - self1) / others).alias("right"))
    agree = each.filter("rule = 1 and (n > 1 and works = 1 or n = 1 and works = 2)")
    copied = agree.select(F.lit(9).alias("rule"), F.col("m").cast("double").alias("labelled"), F.when(F.col("n") > 1, F.col("m").cast("double")).otherwise(0.0).alias("right"))
    seen = usual.unionByName(copied).groupBy("rule").agg(F.sum("labelled").alias("labelled"), F.sum("right").alias("right"))
    every = matches.select("rule").distinct().join(seen, "rule", "left").fillna(0.0, ["labelled", "right"])
    return every.withColumn("confidence", (F.col("right") + PRIOR * PRIOR_N) / (F.col("labelled") + PRIOR_N))


def matched(spark, sf_dir: str) -> DataFrame:
    """citation_id, work_id, rule, confidence."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    found = cut_lineage(match(read("citations"), read("works")))
    # at most one row a rule
    conf = rule_confidence(found).select("rule", "confidence")
    return found.join(conf, "rule", "left").select(F.col("id").alias("citation_id"), F.col("work").alias("work_id"), "rule", F.coalesce("confidence", F.lit(PRIOR)).alias("confidence"))


def found(spark, sf_dir: str) -> DataFrame:
    """p1_found."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return match(read("citations"), read("works")).select(F.col("id").alias("citation_id"), F.col("work").alias("work_id"))
