"""Parsed pages as tables: one Arrow-batched pass over the markup gives documents, sections, blocks and inline tokens.

Everything after that is DataFrame work: filters, numbers, anchors, order, Markdown and JSON are expressions over these rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.dom import Element, flat, markup, parse
from . import authors as A

#: Inline tokens: op is text, math, image, break, raw, cite, open or close; style names what open and close enclose.
INLINE = "op string, style string, text string, url string, kind string, display boolean"
BLOCK = (
    f"region string, sec_pos int, pos int, kind string, level int, inlines array<struct<{INLINE}>>, caption array<struct<{INLINE}>>, text string, latex string, number int, eq_number string, label string, "
    f"language string, ordered boolean, marker string, indent int, list_no int, quote int, images array<struct<src string, alt string, width string>>, cells array<array<array<struct<{INLINE}>>>>"
)
PAGE = (
    "title string, authors array<struct<name string, affiliations array<string>>>, abstract string, submission_date string, "
    f"sections array<struct<pos int, level int, title string, anchor string>>, blocks array<struct<{BLOCK}>>, svgs array<struct<path string, content string>>"
)
_BLOCK_FIELDS = ["region", "sec_pos", "pos", "kind", "level", "inlines", "caption", "text", "latex", "number", "eq_number", "label", "language", "ordered", "marker", "indent", "list_no", "quote", "images", "cells"]
HEADINGS = "h1 h2 h3 h4 h5 h6"
EQUATION = r"ltx_equationgroup|ltx_eqn_align|ltx_eqn_table|ltx_equation"
STYLES = {"em": "italic", "i": "italic", "strong": "bold", "b": "bold", "u": "underline", "s": "strike", "del": "strike"}
#: Commands by which a listing declared as Python shows to be shell.
SHELL = frozenset("pip conda apt apt-get yum brew npm yarn cargo curl wget git bash sh zsh make cmake gcc g++".split())
_BLANKS = re.compile(r"\s+")
#: Where images of a page are put.
IMAGES = "images"


def _tok(op: str, text: str | None = None, style: str | None = None, url: str | None = None, kind: str | None = None, display: bool | None = None) -> dict:
    return {"op": op, "style": style, "text": text, "url": url, "kind": kind, "display": display}


def tex_of(e: Element) -> str:
    for a in e.all("annotation"):
        if "tex" in a.get("encoding"):
            return normal_tex(a.text())
    return normal_tex(e.get("alttext") or e.text())


#: The independence symbol as pages box it, and how it is written without the box.
_PERP = re.compile(r"\\mbox\{\$?\{\}\\perp(?:\\mkern-[\d.]+mu|(?:\\!)+)\\perp\{\}\$?\}")
#: Colours, drawing commands, a display style and line-continuing comment marks, which leave a blank.
_INVISIBLE = re.compile(r"\\definecolor(?:\[[^\]]*\])?(?:\{[^}]*\}){3}|\\color(?:\[[^\]]*\])?\{[^}]*\}|\\pgfsys@color@[a-z@]+(?:\{[^}]*\}){2}|\\displaystyle\b|(?<!\\)%|[\n\r\t]")
_IN_TEXT = re.compile(r"\\text\{([^{}]*\$[^{}]*)\}")


def _out_of_text(m: re.Match) -> str:
    """`\\text` around the words alone: what stands between dollar signs in it is a formula."""
    return "".join((f"\\text{{{part}}}" if part else "") if k % 2 == 0 else part for k, part in enumerate(re.split(r"\$([^$]*)\$", m[1])))


@lru_cache(maxsize=4_096)
def normal_tex(t: str) -> str:
    """One-line TeX without colour, size and driver commands. What is taken out leaves a blank, so that a command before it doesn't run into what follows."""
    t = re.sub(" {2,}", " ", _INVISIBLE.sub(" ", t))
    t = re.sub(r"\{\s+(?=\\)", "{", t)
    t = re.sub(r"(\\begin\{[a-zA-Z*]+\})\s*\[\s*\]\s*", r"\1", t)
    t = re.sub(" {2,}", " ", _PERP.sub(lambda m: "\\perp \\!\\!\\! \\perp ", t))
    t = re.sub(r"\\mbox(\s*)\{([^{}]*)\}", r"\\text\1{\2}", t)
    return re.sub(r"\\nolinebreak(?:\s*\[[^\]]*\])?", "", _IN_TEXT.sub(_out_of_text, t)).strip()


def cut_at_display(tokens: list[dict]) -> Iterator[tuple[str | None, list[dict]]]:
    """(None, inline tokens) and (formula, []) in turn: a paragraph cut at its display formulas.

    Emphasis and links that are open at a cut are closed before it and opened again behind it. Runs without anything to see are dropped.
    """
    run: list[dict] = []
    held: list[dict] = []

    def seen() -> list[dict]:
        kept = _without_empty([*run, *({**t, "op": "close"} for t in reversed(held))])
        if not any(t["op"] != "text" or t["text"].strip() for t in kept):
            return []
        for side, around, order in ((str.lstrip, "open", range(len(kept))), (str.rstrip, "close", range(len(kept) - 1, -1, -1))):
            for k in order:
                if kept[k]["op"] == "text":
                    kept[k] = kept[k] | {"text": side(kept[k]["text"])}
                if kept[k]["op"] != around and kept[k]["text"] != "":
                    break
        return [t for t in kept if t["op"] != "text" or t["text"]]

    for t in tokens:
        if t["op"] == "math" and t["display"]:
            if shown := seen():
                yield None, shown
            yield t["text"], []
            run = list(held)
            continue
        run.append(t)
        if t["op"] == "open":
            held.append(t)
        elif t["op"] == "close" and held:
            held.pop()
    held = []
    if shown := seen():
        yield None, shown


def _without_empty(tokens: list[dict]) -> list[dict]:
    """Without what encloses blanks only, the blanks stay."""
    if not any(t["op"] == "open" for t in tokens):
        return tokens
    out: list[dict] = []
    opened: list[int] = []
    for t in tokens:
        if t["op"] == "open":
            opened.append(len(out))
        elif t["op"] == "close" and opened:
            k = opened.pop()
            if all(x["op"] == "text" and not x["text"].strip() for x in out[k + 1 :]):
                del out[k]
                continue
        out.append(t)
    return out


def link_kind(href: str) -> tuple[str, str]:
    """(kind, target) of a link: citation, internal or external."""
    if m := re.search(r"#bib\.bib(\d+)", href):
        return "citation", f"ref-{m[1]}"
    if "#" in href and (href.startswith("#") or re.search(r"arxiv\.org/|ar5iv", href)):
        fragment = href.split("#", 1)[1]
        for p, by in ((r"S\d+\.F(\d+)$", r"figure-\1"), (r"[SA]\d+\.T(\d+)$", r"table-\1"), (r"S(\d+)$", r"section-\1"), (r"S(\d+)\.SS(\d+)$", r"section-\1-\2"), (r"alg(\d+)$", r"algorithm-\1")):
            if m := re.match(p, fragment):
                return "internal", m.expand(by)
        return "internal", fragment
    return "external", href


class _Reader:
    """Blocks of one page. Footnotes wait and come after the block that has them."""

    def __init__(self) -> None:
        self.blocks: list[dict] = []
        self.notes: list[tuple[str, list[dict]]] = []
        self.svgs: list[dict] = []
        self.lists = 0
        self.region, self.sec, self.quote, self.indent = "section", None, 0, 0

    # -- inline

    def inlines(self, kids: list) -> list[dict]:
        out: list[dict] = []
        for k in kids:
            out += self.inline(k)
        return out

    def inline(self, k: Element | str) -> list[dict]:
        if k.__class__ is str:
            return [_tok("text", _BLANKS.sub(" ", k))] if k.strip() else ([_tok("text", " ")] if k else [])
        if k.tag == "math":
            return [_tok("math", tex_of(k), display=k.get("display") == "block")]
        if k.tag == "br":
            return [_tok("break")]
        if k.tag == "img":
            return [_tok("image", _alt(k.get("alt")), url=k.get("src"))]
        if k.has("ltx_note|ltx_role_footnote"):
            mark = k.first("sup", "ltx_note_mark")
            name = flat(mark.text()) if mark is not None else str(len(self.notes) + 1)
            body = k.first(cls="ltx_note_content") or k
            self.notes.append((name, self.inlines([x for x in body.kids if x.__class__ is str or not x.has("ltx_note_mark|ltx_tag")])))
            return [_tok("open", style="superscript"), _tok("text", name), _tok("close", style="superscript")]
        if k.has(EQUATION) and k.tag == "table":
            return [_tok("math", _equation(k)[0], display=True)]
        inner = None
        if k.tag == "code":
            return [_tok("open", style="code"), _tok("text", flat(k.text())), _tok("close", style="code")] if k.text().strip() else []
        inner = self.inlines(k.kids)
        if k.tag == "a":
            kind, target = link_kind(k.get("href"))
            if kind == "citation":
                return [_tok("cite", flat("".join(t["text"] or "" for t in inner)), url=target, kind=kind)]
            return [_tok("open", style="link", url=target, kind=kind), *inner, _tok("close", style="link", url=target, kind=kind)] if k.get("href") else inner
        style = STYLES.get(k.tag) or {"sup": "superscript", "sub": "subscript"}.get(k.tag)
        if style is None and k.tag in ("span", "cite", "label", "p"):
            style = "italic" if k.has("ltx_font_italic") else "bold" if k.has("ltx_font_bold") else "code" if k.has("ltx_font_typewriter") else "smallcaps" if k.has("ltx_font_smallcaps") else ""
        if style is None:
            return inner or [_tok("raw", flat(k.text()))] if k.text().strip() else inner
        if not style:
            return inner
        # emphasis around nothing is no emphasis
        return [_tok("open", style=style), *inner, _tok("close", style=style)] if any(t["op"] != "text" or (t["text"] or "").strip() for t in inner) else inner

    # -- blocks

    def add(self, kind: str, **values: object) -> None:
        row = dict.fromkeys(_BLOCK_FIELDS)
        row.update(region=self.region, sec_pos=self.sec, pos=len(self.blocks), kind=kind, quote=self.quote, indent=self.indent, list_no=self.lists if self.indent else None, inlines=[], caption=[], images=[], cells=[])
        row.update(values)
        if "inlines" in values and not row["text"]:
            row["text"] = flat(" ".join(t["text"] or "" for t in row["inlines"] if t["op"] in ("text", "math", "raw", "image", "cite")))
        self.blocks.append(row)

    def flush_notes(self) -> None:
        waiting, self.notes = self.notes, []
        for name, tokens in waiting:
            self.quote += 1
            self.add("paragraph", inlines=[_tok("text", f"Footnote {name}: "), *tokens])
            self.quote -= 1

    def paragraph(self, tokens: list[dict], **values: object) -> None:
        """A paragraph, cut at its display formulas."""
        for latex, run in cut_at_display(tokens):
            if latex is not None:
                self.add("equation", latex=latex)
            else:
                self.add("paragraph", inlines=run, **values)
                values = {}
        self.flush_notes()

    def children(self, e: Element, skip: str | None = None) -> None:
        loose: list = []

        def flush() -> None:
            if loose:
                self.paragraph(self.inlines(loose))
                loose.clear()

        for k in e.kids:
            if k.__class__ is str or k.tag in ("em", "i", "b", "strong", "code", "a", "sup", "sub", "cite", "math") or (k.tag == "span" and not k.has(r"ltx_p\b|ltx_para|ltx_itemize|ltx_enumerate|ltx_listing|" + EQUATION)):
                loose.append(k)
            elif not (skip and k.has(skip)):
                flush()
                self.block(k)
        flush()

    def block(self, e: Element) -> None:
        tag = e.tag
        if tag in ("script", "style", "nav", "svg", "br", "head", "title", "link", "meta"):
            return
        if tag == "div" and e.has(r"ltx_listing\b"):
            code, language = _listing(e)
            self.add("code", text=code, language=language)
        elif tag == "p" or (tag == "span" and e.has(r"ltx_p\b")):
            self.paragraph(self.inlines(e.kids))
        elif tag in ("ul", "ol") or e.has("ltx_enumerate|ltx_itemize"):
            ordered = tag == "ol" or e.has("ltx_enumerate")
            self.items(e, ordered)
        elif tag in ("span", "div", "table") and e.has(EQUATION):
            latex, number = _equation(e)
            if latex:
                self.add("equation", latex=latex, eq_number=number, label=e.get("id") or None)
        elif tag in HEADINGS.split():
            self.add("heading", level=int(tag[1]), inlines=self.inlines(e.kids), label=e.get("id") or None)
        elif tag == "figure":
            self.figure(e)
        elif tag == "table":
            self.table(e)
        elif tag == "blockquote":
            self.quote += 1
            self.children(e)
            self.quote -= 1
        elif tag == "pre":
            self.add("code", text=e.text().strip("\n"), language=None)
        elif tag == "hr":
            self.add("rule")
        elif tag == "math":
            self.add("equation", latex=tex_of(e))
        elif tag == "img":
            self.add("figure", images=[_image(e)])
        elif tag in ("div", "section", "article", "main", "body", "header", "footer", "span", "dl", "dt", "dd", "figcaption", "center", "#root", "html"):
            self.children(e)
        else:
            self.paragraph(self.inlines([e]))

    def items(self, e: Element, ordered: bool) -> None:
        n = 0
        self.lists += self.indent == 0
        for item in e.kids:
            if item.__class__ is str or not (item.tag == "li" or item.has("ltx_item")):
                continue
            n += 1
            at = len(self.blocks)
            self.indent += 1
            self.children(item, skip=r"ltx_tag\b")
            mark_item(self.blocks, at, self.indent, self.quote, f"{n}." if ordered else "-")
            self.indent -= 1

    def figure(self, e: Element) -> None:
        cap = e.first("figcaption") or e.first("span", "ltx_caption")
        caption = [t for t in self.inlines(cap.kids)] if cap is not None else []
        words = flat("".join(t["text"] or "" for t in caption))
        inner = e.first("table")
        if e.has("ltx_float_algorithm|ltx_algorithm"):
            self.add("algorithm", caption=caption, number=_number(words, "Algorithm"), label=e.get("id") or None)
        elif e.has("ltx_table") and inner is not None:
            self.table(inner, e.get("id"))
        else:
            images = [_image(i) for i in e.all("img")]
            if not images:
                svg = e.first("svg")
                if svg is None:
                    return
                path = f"{IMAGES}/figure-{len(self.svgs) + 1}.svg"
                self.svgs.append({"path": path, "content": markup(svg)})
                images = [{"src": path, "alt": _alt(svg.get("alt")), "width": None}]
            self.add("figure", caption=caption, images=images, number=_number(words, "Figure"), label=e.get("id") or None, text=words)

    def table(self, e: Element, label: str = "") -> None:
        cap = next((k for k in e.kids if k.__class__ is Element and k.tag == "caption"), None)
        parts = [k for k in e.kids if k.__class__ is Element and k.tag in ("thead", "tbody", "tfoot")]
        head = [r for p in parts if p.tag == "thead" for r in p.kids if r.__class__ is Element and r.tag == "tr"][:1]
        body = [r for p in parts if p.tag != "thead" for r in p.kids if r.__class__ is Element and r.tag == "tr"]
        rows = head + body if parts else [r for r in e.all("tr")]
        cells = [[self.inlines(c.kids) for c in r.kids if c.__class__ is Element and c.tag in ("td", "th")] for r in rows]
        if any(cells):
            caption = self.inlines(cap.kids) if cap is not None else []
            self.add("table", cells=cells, caption=caption, number=_number(flat("".join(t["text"] or "" for t in caption)), "Table"), label=label or e.get("id") or None)
            self.flush_notes()


def mark_item(blocks: list[dict], at: int, indent: int, quote: int, marker: str) -> None:
    """Blocks from `at` on as one item: paragraphs that follow each other become one line with the marker, again after a nested list or another kind of block."""
    kept: list[dict] = []
    for b in blocks[at:]:
        own = b["kind"] == "paragraph" and b["indent"] == indent and b["quote"] == quote
        if own and kept and kept[-1].get("_own"):
            kept[-1]["inlines"] = [*kept[-1]["inlines"], _tok("text", " "), *b["inlines"]]
            kept[-1]["text"] = f"{kept[-1]['text']} {b['text']}"
        else:
            kept.append(b | ({"marker": marker, "ordered": marker != "-", "_own": True} if own else {}))
    for n, b in enumerate(kept):
        b.pop("_own", None)
        b["pos"] = at + n
    blocks[at:] = kept


def _number(caption: str, kind: str) -> int | None:
    m = re.search(rf"{kind}\s+(\d+)", caption, re.I)
    return int(m[1]) if m else None


def _alt(alt: str) -> str:
    t = re.sub(r"[\[\]]", "", alt).strip()
    return "" if t.lower() in ("refer to caption", "uncaptioned image", "image") else t


def _image(e: Element) -> dict:
    return {"src": e.get("src"), "alt": _alt(e.get("alt")), "width": e.get("width") or None}


def _equation(e: Element) -> tuple[str, str | None]:
    parts = [tex_of(m).strip().strip("$").strip() for m in e.all("math")]
    tag = e.first("span", "ltx_tag_equation") or e.first("td", "ltx_eqn_eqno")
    return re.sub(r"\\tag\{[^{}]*\}", "", " ".join(p for p in parts if p)).strip(), (flat(tag.text()) if tag is not None else None) or None


def _listing(e: Element) -> tuple[str, str]:
    import base64

    language = m[1].lower() if (m := re.search(r"ltx_lst_language_(\w+)", e.get("class"))) else "text"
    code = None
    for a in e.all("a"):
        href = a.get("href")
        if href.startswith("data:text/plain") and ";base64," in href:
            try:
                code = base64.b64decode(href.split(";base64,", 1)[1], validate=True).decode("utf-8")
            except ValueError:
                code = None
            break
    if code is None:
        code = "\n".join(x.text(r"ltx_tag_listingline").rstrip() for x in e.all("div", "ltx_listingline")) or e.text()
    return code.rstrip(), listing_language(code, language)


def listing_language(code: str, declared: str) -> str:
    """Python that doesn't parse is shell if its first word is a shell command, else text."""
    if declared != "python":
        return declared
    try:
        ast.parse(code)
        return "python"
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        words = code.split(None, 1)
        return "bash" if words and words[0].lower() in SHELL else "text"


def _title(root: Element) -> str | None:
    places = [root.first("h1", "ltx_title"), root.first("h1", r"(?:^|\s)(?:title|paper-title)(?:\s|$)")]
    found = [flat(p.text(r"ltx_note")) for p in places if p is not None]
    found += [m.get("content") for m in root.all("meta") if m.get("property") == "og:title"]
    if (t := root.first("title")) is not None:
        found.append(re.sub(r"\s*[|\-–—]\s*(?:arXiv|ar5iv).*$", "", flat(t.text()), flags=re.I))
    for f in found:
        f = flat(re.sub(r"\s*Contents$", "", re.sub(r"^\[[^\]]*\]\s*", "", f)))
        if f.lower() not in ("", "arxiv", "contents"):
            return f
    return None


def _date(root: Element) -> str | None:
    for m in root.all("meta"):
        if m.get("name") == "citation_date" and m.get("content"):
            return m.get("content")
    if (d := root.first(cls="ltx_date|arxiv-date|submission-date")) is not None and d.text().strip():
        return flat(d.text())
    t = root.first("time")
    return (t.get("datetime") or flat(t.text()) or None) if t is not None else None


def read_page(source: str | bytes | None) -> dict:
    """One page as nested values; sections come in document order, without a hierarchy."""
    page = parse(source)
    root = page.first("article", "ltx_document") or page.first("article") or page.first("body") or page
    r = _Reader()
    abstract = root.first(cls="ltx_abstract")
    if abstract is not None:
        r.region = "abstract"
        r.children(abstract)
        if r.blocks and r.blocks[0]["kind"] == "heading" and (r.blocks[0]["text"] or "").strip().lower().rstrip(".") == "abstract":
            r.blocks.pop(0)
        # what stands before the first section: figures and paragraphs of the title block
        if root.first("section", "ltx_section") is not None and abstract.parent is not None:
            r.region = "front_matter"
            after = abstract.parent.kids[next(n for n, k in enumerate(abstract.parent.kids) if k is abstract) + 1 :]
            for k in after:
                if k.__class__ is Element:
                    if k.tag == "section":
                        break
                    if k.has("ltx_logical-block") or any(x.has("ltx_figure|ltx_para") for x in (k, *k.walk())):
                        r.block(k)
        r.region = "section"
    sections = []
    for h in root.all(HEADINGS):
        above = list(h.up())
        if any(p.tag == "nav" or p.has("ltx_abstract") for p in above) or h.has("ltx_title_document"):
            continue
        box = next((p for p in above if p.tag == "section"), None)
        r.sec = len(sections)
        sections.append({"pos": r.sec, "level": int(h.tag[1]), "title": flat(h.text(r"ltx_note")), "anchor": h.get("id") or (h.parent.get("id") if h.parent is not None else "") or None})
        # content is what follows the heading in its own section, without sections below
        if box is None or h.parent is not box:
            continue
        r.region = "bibliography" if box.has("ltx_bibliography") else "section"
        after, seen = Element("div", {}, None), False
        for k in box.kids:
            if k is h:
                seen = True
            elif seen and not (k.__class__ is Element and (k.tag == "section" or k.has(r"ltx_(?:sub)*section\b"))):
                after.kids.append(k)
        r.children(after)
    for n, b in enumerate(r.blocks):
        b["pos"] = n
    return {
        "title": _title(page), "authors": [{"name": n, "affiliations": a} for n, a in A.page_authors(root)], "abstract": re.sub(r"^Abstract[.:]?\s*", "", flat(abstract.text())) if abstract is not None else None,
        "submission_date": _date(page), "sections": sections, "blocks": r.blocks, "svgs": r.svgs,
    }


def parse_pages(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """One row a page: the key and PAGE's columns. A null or empty page has no title, sections or blocks."""
    schema = f"doc_id {dict(pages.dtypes)[key]}, {PAGE}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [read_page(x) for x in b.column(1).to_pylist()]
            columns = [b.column(0), *(pa.array([d[f.name] for d in done], f.type) for f in list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow)

    return pages.select(key, html).mapInArrow(run, schema)


def sections_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("sections"))


def blocks_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("blocks"))


def inlines_of(parsed: DataFrame) -> DataFrame:
    """Inline tokens of all blocks: (doc_id, pos, slot, i, ...)."""
    b = blocks_of(parsed)
    parts = [b.select("doc_id", "pos", F.lit(slot).alias("slot"), F.posexplode(slot).alias("i", "t")).select("doc_id", "pos", "slot", "i", "t.*") for slot in ("inlines", "caption")]
    return parts[0].unionByName(parts[1])
