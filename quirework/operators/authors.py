"""Authors with affiliations from page elements and from TeX."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dom import Element, flat, parse
from ..functions.text import AFFILIATION_WORDS, FOOTNOTE_MARKS, PLACE, SKIP_WORDS

Author = tuple[str, list[str]]
_MARKS_ONLY = re.compile(rf"^{FOOTNOTE_MARKS}$")
_MARKS_END = re.compile(FOOTNOTE_MARKS + "$")
_EMAIL = re.compile(r"[^\s@,;]+@[^\s@,;]+\.\w+")
_NO_NAME, _ORGANISATION, _PLACE = re.compile("(?i)[,@]|" + "|".join(AFFILIATION_WORDS)), re.compile("(?i)" + "|".join(AFFILIATION_WORDS)), re.compile(PLACE)
_NOTE = r"ltx_note|ltx_role_footnote"
MAX_PART = 80


def is_name(text: str) -> bool:
    """`looks_like_name` for a reader that works on one page at a time."""
    t = _MARKS_END.sub("", text).strip()
    return 0 < len(t.split()) <= 6 and not _NO_NAME.search(t) and (len(t) <= 3 or not t.isupper())


def is_affiliation(text: str) -> bool:
    """`looks_like_affiliation` for a reader that works on one page at a time."""
    t = text.strip()
    if len(t) > 1 and (_ORGANISATION.search(t) or _PLACE.search(t)):
        return True
    n = len(t.split()) if len(t) > 1 else 0
    return n == 1 and t[0].isupper() or 0 < n <= 4 and any(c.isdigit() or c in "()[]" for c in t)


def _clean(e: Element | str) -> str:
    return flat(e if isinstance(e, str) else e.text(_NOTE)).strip(" ,;&")


def _kept(part: str) -> bool:
    low = part.lower()
    return bool(part) and part != "&" and not _EMAIL.fullmatch(part) and not _MARKS_ONLY.match(part) and not any(w in low for w in SKIP_WORDS) and len(part) <= MAX_PART


def distinct(xs: list[str]) -> list[str]:
    seen: dict[str, str] = {}
    for x in xs:
        seen.setdefault(x.lower(), x)
    return list(seen.values())


def _by_lines(parts: list[str]) -> list[Author]:
    """Lines of a creator: a name begins an author, affiliations follow; a short doubtful line right after a name is its first affiliation."""
    out: list[Author] = []
    for p in filter(_kept, (x.strip().lstrip("&").strip() for x in parts)):
        if out and (is_affiliation(p) or (not out[-1][1] and len(p.split()) <= 4 and not is_name(p))):
            out[-1][1].append(p)
        elif is_name(p):
            out.append((_MARKS_END.sub("", p).strip(), []))
    return out


def _lines(e: Element) -> list[str]:
    lines, todo = [""], list(reversed(e.kids))
    while todo:
        k = todo.pop()
        if k.__class__ is str:
            lines[-1] += k
        elif k.tag == "br":
            lines.append("")
        elif k.tag != "sup" and not k.has(_NOTE):
            todo += reversed(k.kids)
    return [flat(x) for x in lines]


def _spans(e: Element) -> list[Author]:
    """Bold spans with the italic ones after each."""
    out: list[Author] = []
    for s in e.all("span", "ltx_font_bold|ltx_font_italic"):
        t = _clean(s)
        if not _kept(t):
            continue
        if s.has("ltx_font_bold"):
            out.append((t, []))
        elif out:
            out[-1][1].append(t)
    return out


def _structured(box: Element) -> list[Author]:
    out: list[Author] = []
    for c in box.all(cls=r"ltx_creator|ltx_role_author|\bltx_author\b"):
        if any(p.has(r"ltx_creator|ltx_role_author|\bltx_author\b") for p in c.up()):
            continue
        name = c.first(cls="ltx_personname")
        cells = list(c.all("span td", "ltx_td"))
        if cells and (pairs := [a for cell in cells for a in _spans(cell)]):
            out += pairs
            continue
        if name is None:
            continue
        notes = [_clean(x) for x in c.all(cls=r"ltx_role_affiliation|ltx_role_address|ltx_role_institution|ltx_contact")]
        if name.first("br") is not None:
            found = _by_lines(_lines(name))
        else:
            italics = [_clean(s) for s in name.all("span", "ltx_font_italic") if is_affiliation(_clean(s))]
            label = _clean(name)
            for i in italics:
                label = flat(label.replace(i, " "))
            found = [(_MARKS_END.sub("", label).strip(" ,"), italics)] if _kept(label) else []
        if found:
            found[-1][1].extend(n for n in notes if _kept(n))
        out += found
    return out


def _sequential(box: Element) -> list[Author]:
    """Flat children: a bold span or what looks like a name begins an author, affiliations follow; sentences are passed over."""
    out: list[Author] = []
    for k in box.walk():
        if k.kids and all(x.__class__ is str for x in k.kids) and k.tag not in ("script", "style", "sup") and not k.has(_NOTE):
            t = _clean(k)
            if not _kept(t) or t.count(".") > 1 or (t.endswith(".") and len(t) > 40):
                continue
            if k.has("ltx_font_bold") or (is_name(t) and not is_affiliation(t)):
                out.append((_MARKS_END.sub("", t).strip(), []))
            elif out and is_affiliation(t):
                out[-1][1].append(t)
    return out


def page_authors(root: Element) -> list[Author]:
    box = root.first("div", "ltx_authors")
    if box is None:
        return []
    found = _structured(box) or _sequential(box)
    out: dict[str, list[str]] = {}
    for name, affs in found:
        out.setdefault(name, []).extend(affs)
    return [(n, distinct(a)) for n, a in out.items()]


def abstract_page_authors(root: Element) -> tuple[list[str], list[str]]:
    """(names, affiliation hints) of an abstract page."""
    names = [flat(a.text()) for box in root.all("div", r"\bauthors\b") for a in box.all("a")]
    metas = [m.get("content") for m in root.all("meta") if m.get("name").lower() == "citation_author_institution"]
    hints = [flat(x.text()) for x in root.all(cls=r"(?i)affiliation|institution")]
    return [n for n in names if n], distinct([h for h in [*metas, *hints] if h and len(h) < 500])


# ---- TeX


def strip_comments(tex: str) -> str:
    return re.sub(r"(?m)(?<!\\)%.*$", "", tex)


def balanced(text: str, at: int) -> tuple[str, int]:
    """Inside of the braces that open at `at`, and the position behind them; what there is if they never close."""
    depth, k = 0, at
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 2
            continue
        depth += (c == "{") - (c == "}")
        if depth == 0:
            return text[at + 1 : k], k + 1
        k += 1
    return text[at + 1 :], len(text)


def commands(text: str, names: str) -> list[tuple[str, str, str, int]]:
    """(command, option, argument, end) of the given commands, in order."""
    out = []
    for m in re.finditer(rf"\\({names})\*?\s*(?:\[([^\]]*)\])?\s*(?=\{{)", text):
        inner, end = balanced(text, m.end())
        out.append((m[1], m[2] or "", inner, end))
    return out


#: Characters in which the authors of a TeX source are looked for, as in what this is compared with; a region beyond it is read to there.
REGION_CHARS = 300_000


def author_region(tex: str) -> str:
    """From the preamble's or body's first author command up to the abstract, \\maketitle or first section."""
    t = strip_comments(tex)
    body = t.find("\\begin{document}")
    ends = [m.start() for p in (r"\\begin\{abstract\}", r"\\maketitle", r"\\section\b", r"\\chapter\b") for m in [re.search(p, t[max(body, 0) :])] if m]
    stop = max(body, 0) + (min(ends) if ends else len(t))
    head = t[:body] if body > 0 and "\\author" in t[:body] else ""
    return (head + t[max(body, 0) : stop])[:REGION_CHARS]


def plain(tex: str) -> str:
    """TeX of a name or an address as text."""
    t = tex
    while m := re.search(r"\\(?:thanks|footnote\w*|email|href|orcid\w*|IEEEmembership)\s*\{", t):
        t = t[: m.start()] + t[balanced(t, m.end() - 1)[1] :]
    t = re.sub(r"\$[^$]*\$|\\textsuperscript\{[^{}]*\}|\^\{[^{}]*\}|\\[a-zA-Z@]*mark\b(?:\[[^\]]*\])?", " ", t)
    t = re.sub(r"\\(?:\\|newline|linebreak)(?:\[[^\]]*\])?", " ", t)
    t = re.sub(r"\\[a-zA-Z@]+\*?(?:\[[^\]]*\])?", " ", t).replace("~", " ")
    return flat(re.sub(r"[{}]", "", t)).strip(" ,;")


def _icml(t: str) -> list[Author]:
    org = {k.strip(): plain(v) for k, v in re.findall(r"\\icmlaffiliation\{([^{}]*)\}\{((?:[^{}]|\{[^{}]*\})*)\}", t)}
    return [(plain(n), [org[k.strip()] for k in keys.split(",") if k.strip() in org]) for n, keys in re.findall(r"\\icmlauthor\{((?:[^{}]|\{[^{}]*\})*)\}\{([^{}]*)\}", t)]


def _ieee(t: str) -> list[Author]:
    out: list[Author] = []
    for kind, _, inner, _ in commands(t, "IEEEauthorblockN|IEEEauthorblockA"):
        if kind.endswith("N"):
            out += [(plain(n), []) for n in re.split(r"\\and\b|,|\band\b", inner) if plain(n)]
        elif out:
            lines = [plain(x) for x in re.split(r"\\\\", inner)]
            group = [a for a in out if not a[1]]
            for a in group:
                a[1].extend(x for x in lines if x and "@" not in x)
    return out if any(a for _, a in out) else []


def _legend(t: str) -> list[Author]:
    """Superscripts behind names, and a legend of superscripts with institutions."""
    block = " \\\\ ".join(x[2] for x in commands(t, "author"))
    sup = r"(?:\$\s*\^\s*\{?([^{}$]*)\}?\s*\$|\\textsuperscript\{([^{}]*)\})"
    pieces = re.split(r"\\\\|\\and\b|\\AND\b|\n", block)
    org, names = {}, []
    for p in pieces:
        if m := re.match(rf"\s*{sup}\s*(.+)", p, re.S):
            for part in re.split(rf"(?={sup})", p):
                if part and (q := re.match(rf"\s*{sup}\s*(.+)", part, re.S)):
                    org[(q[1] or q[2]).strip()] = plain(q[3])
        else:
            names += [(plain(q[1]), (q[2] or q[3] or "").strip()) for q in re.finditer(rf"([^,$\\]+(?:\\(?!textsuperscript)[a-zA-Z'\"`^~]+[^,$\\]*)*?)\s*{sup}", p)]
    if not org or not names:
        return []

    def of(marks: str) -> list[str]:
        keys = [k for k in re.split(r"[,\s]+", re.sub(r"[*†‡§¶]|\\\w+", "", marks)) if k]
        return [org[x] for k in keys for x in ([k] if k in org else list(k)) if x in org]

    return [(re.sub(r"^and\s+", "", n), of(m)) for n, m in names if n]


def _sequence(t: str) -> list[Author]:
    """\\author commands, each with the affiliation commands after it; without any of its own, an author has the next one's."""
    out: list[Author] = []
    for kind, _, inner, _ in commands(t, "author|affiliation|affil|address|institute|institution"):
        if kind == "author":
            out += [(plain(n), []) for n in re.split(r"\\and\b|\\AND\b", re.split(r"\\\\", inner)[0]) if plain(n)]
        elif out and (a := plain(inner)):
            out[-1][1].append(a)
    for k in range(len(out) - 2, -1, -1):
        if not out[k][1]:
            out[k][1].extend(out[k + 1][1])
    return out if any(a for _, a in out) else []


def _single(t: str) -> list[Author]:
    out = []
    for _, _, inner, _ in commands(t, "author"):
        for one in re.split(r"\\and\b|\\AND\b", inner):
            lines = [x for x in (plain(p) for p in re.split(r"\\\\", one)) if x and "@" not in x]
            if lines:
                out.append((lines[0], lines[1:]))
    return out if any(a for _, a in out) else []


def tex_authors(tex: str | None) -> list[Author]:
    """Authors with affiliations by the first style that gives any."""
    t = author_region(tex or "")
    for style in (_icml, _ieee, _legend, _sequence, _single):
        if found := [(n, distinct([a for a in affs if a])) for n, affs in style(t) if n]:
            return found
    return []


# ---- as tables


def tex_author_rows(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, name, affiliations) of TeX sources; a null text, or one without authors, gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, name, affs) for k, t in zip(pdf["key"], pdf["text"]) for n, (name, affs) in enumerate(tex_authors(t))]
            yield pd.DataFrame(rows, columns=["key", "ord", "name", "affiliations"])

    kind = dict(texts.dtypes)[key]
    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, ord int, name string, affiliations array<string>").withColumnRenamed("key", key)


def abstract_page_rows(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(key, names, hints) of abstract pages; a null page has neither."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *abstract_page_authors(parse(h))) for k, h in zip(pdf["key"], pdf["html"])]
            yield pd.DataFrame(rows, columns=["key", "names", "hints"])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, names array<string>, hints array<string>").withColumnRenamed("key", key)
