"""Markup residue in text documents (problem 4): clean text that keeps headings, lists, code, tables and formulas.

A text of any format is read into one tree: HTML into its elements, Markdown and LaTeX into blocks with their code and
formulas set apart. Markup of other formats in the visible text is hung into the tree as tags of its node, each with its
format. Then every node is measured: its composite text density (Sun et al., SIGIR 2011) sets its characters
against its tags, own and foreign, adjusted by the share that links have, and its tags are counted by format on the way. The subtree with
the largest sum of child densities is the
content, and its siblings and its ancestors' stay only if they reach the least density on the path from the body to it.
The formats of the whole tree's tags, other than its own, are the residue; it is
converted too and reported, that of parts left out as well. One narrow Python stage, no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Set

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_columns

#: Elements of HTML.
TAGS = frozenset(
    "a abbr address article aside audio b blockquote body br button canvas caption center cite code col colgroup dd del details dfn div dl dt em embed fieldset figcaption figure "
    "font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta nav noscript object ol option p param pre q s samp script "
    "section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr mi mo mn mrow msub msup mfrac".split()
)
VOID = frozenset("br hr img input meta link col embed wbr param area base source track".split())
BLOCK = frozenset("p div section article main header footer aside nav figure figcaption table tr ul ol li dl dt dd blockquote pre h1 h2 h3 h4 h5 h6 hr body html caption address form fieldset center details summary".split())
UNSEEN = frozenset("script style head noscript template".split())
#: An opening tag of the key closes an open one of the value.
CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
BARRIER = frozenset("table ul ol dl td th div section article body blockquote figure".split())
#: Tables within tables from which on rows come as plain blocks.
TABLES = 20

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)?/?)(?:>|\Z)", re.S)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
_SPACES = re.compile(r"\s+")
_ATTR = re.compile(r"(?:^|\s)(alttext|alt|href|src|encoding|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "chars", "tags", "link_chars", "link_tags", "density", "total", "foreign", "formats")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.kids, self.foreign = tag, attrs, [], ()

    def attr(self, name: str) -> str:
        for m in _ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return ""


def parse_html(text: str) -> Node:
    """DOM of a page or fragment; unclosed elements end with their parent, stray end tags are passed over."""
    root = Node("#root")
    stack, at, n = [root], 0, len(text)
    while at < n:
        m = _TAG.search(text, at)
        if not m:
            stack[-1].kids.append(text[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:-3])
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag == "table" and name != "table" and name in ("p", "span", "b", "i"):
                    break
            continue
        if name in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[name]:
                    del stack[k:]
                    if name != "tr":
                        break
                elif stack[k].tag in BARRIER:
                    break
        elif name in BLOCK and stack[-1].tag == "p":
            stack.pop()
        node = Node(name, m[3] or "")
        stack[-1].kids.append(node)
        if name in _RAW_END:
            end = _RAW_END[name].search(text, at)
            at = end.end() if end else n
        elif name not in VOID and not m[0].endswith("/>"):
            stack.append(node)
    return root


def _measure(root: Node) -> list[Node]:
    """Sets counts, formats and densities; gives the elements, children before parents."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if k.__class__ is Node]
    order.reverse()
    for x in order:
        chars = link_chars = link_tags = 0
        # markup of other formats in a node's own text is tags of it too
        tags, x.formats = len(x.foreign), set(x.foreign)
        for k in x.kids:
            if k.__class__ is Node:
                chars += k.chars
                tags += k.tags + 1
                x.formats |= k.formats
                link_chars += k.link_chars
                link_tags += k.link_tags + (k.tag == "a")
            else:
                chars += len(k) - k.count(" ") if not k.isspace() else 0
        if x.tag in UNSEEN:
            chars = link_chars = 0
        if x.tag in ("a", "button"):
            link_chars = chars
        x.chars, x.tags, x.link_chars, x.link_tags = chars, tags, link_chars, link_tags
    page_ratio = root.link_chars / root.chars if root.chars else 0
    for x in order:
        c, t, lc, lt = x.chars, max(1, x.tags), x.link_chars, max(1, x.link_tags)
        if not c:
            x.density = 0.0
        elif not lc:
            x.density = c / t * math.log2(2 + t)
        else:
            base = math.log(c / max(1, c - lc) * lc + page_ratio * c + math.e)
            x.density = max(0.0, c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9) / math.log(max(base, 1.0001)))
        x.total = sum(k.density for k in x.kids if k.__class__ is Node) or x.density
    return order


def content_root(root: Node) -> tuple[list[Node], float, list[Node]]:
    """All elements, the least density on the way from the body to the subtree with the largest density sum, and the path from the root to that.

    Every node of the body can be it; among equals the outermost one. A fragment without a body is its own body.
    """
    order = _measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    over = {id(k): x for x in order for k in x.kids if k.__class__ is Node}
    # from the top, so that an ancestor wins a tie
    best, todo = body, [body]
    while todo:
        x = todo.pop()
        if x.total > best.total:
            best = x
        todo += [k for k in reversed(x.kids) if k.__class__ is Node and k.tag not in UNSEEN]
    path = [best]
    while path[-1] is not root:
        path.append(over[id(path[-1])])
    path.reverse()
    return order, min(x.density for x in path[next(i for i, x in enumerate(path) if x is body) :]), path


_PAGE_PARTS = frozenset("nav footer aside header".split())
#: Elements that stay beside the content whatever their density: headings, code, formulas, and what has no text.
_KEPT = frozenset("h1 h2 h3 h4 h5 h6 pre textarea code math br hr img".split())


def _boilerplate(order: list[Node], threshold: float, path: list[Node]) -> set[int]:
    """Siblings of the content and of its ancestors that fall below the threshold, and a page's nav, footer, aside and header that do.

    An inline element in running text isn't cut out of it. A fragment that is one section or article is content that
    somebody has picked already: it has no siblings to drop.
    """
    on_path = {id(x) for x in path}
    out = {id(x) for x in order if x.tag in _PAGE_PARTS and x.density < threshold and id(x) not in on_path} if len(path) > 1 else set()
    top = [k for k in path[0].kids if k.__class__ is Node or not k.isspace()]
    if len(top) == 1 and top[0].__class__ is Node and top[0].tag in ("section", "article"):
        return out
    for x in path[:-1]:
        running = any(k.__class__ is str and not k.isspace() for k in x.kids)
        out.update(id(k) for k in x.kids if k.__class__ is Node and id(k) not in on_path and k.density < threshold and k.tag not in _KEPT and (k.tag in BLOCK or not running))
    return out


def _rendered(root: Node, boilerplate: Set[int] = frozenset(), tables: int = 0) -> str:
    """Text of a node with its structure, without boilerplate."""
    out: list[str] = []
    lists: list[list] = []

    def block() -> None:
        while out and out[-1] == " ":
            out.pop()
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    def gap() -> None:
        block()
        if out and not out[-1].endswith("\n\n") and not (len(out) > 1 and out[-1] == "\n" and out[-2].endswith("\n")):
            out.append("\n")

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x.__class__ is tuple:
            x[0]()
            continue
        if x.__class__ is str:
            t = html.unescape(x) if "&" in x else x
            if not t.isspace():
                t = _SPACES.sub(" ", t)
                out.append(t.lstrip() if not out or out[-1].endswith("\n") else t)
            elif out and not out[-1].endswith(("\n", " ")):
                out.append(" ")
            continue
        tag = x.tag
        if tag in UNSEEN:
            continue
        if id(x) in boilerplate:
            continue
        if tag == "br":
            out.append("\n")
        elif tag == "hr":
            gap()
            out.append("---\n\n")
        elif tag == "img":
            out.append(f"![{x.attr('alt')}]({x.attr('src')})")
        elif tag == "math":
            tex = x.attr("alttext") or _annotation(x)
            out.append(f"${tex}$" if tex else _SPACES.sub(" ", _text_of(x)))
        elif tag == "pre" or tag == "textarea":
            gap()
            out.append("```\n" + _text_of(x).strip("\n") + "\n```\n\n")
        elif tag in ("code", "kbd", "samp", "tt", "var"):
            out.append("`" + _SPACES.sub(" ", _text_of(x)).strip() + "`")
        elif tag == "table" and tables < TABLES:
            gap()
            out.append(_table(x, tables + 1) + "\n\n")
        else:
            after = None
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                gap()
                out.append("#" * int(tag[1]) + " ")
                after = gap
            elif tag in ("ul", "ol"):
                block()
                lists.append([tag, 0])

                def after() -> None:
                    lists.pop()
                    block()
            elif tag == "li":
                block()
                if lists:
                    lists[-1][1] += 1
                mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                out.append("  " * max(0, len(lists) - 1) + mark)
                after = block
            elif tag == "blockquote":
                gap()
                out.append("> ")
                after = gap
            elif tag in BLOCK:
                (gap if tag in ("p", "div", "section", "figure", "article") else block)()
                after = gap if tag in ("p", "div", "section", "figure", "article") else block
            if after:
                todo.append((after,))
            todo += reversed(x.kids)
            continue
    return re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", "".join(out))).strip()


def _text_of(x: Node) -> str:
    out, todo = [], [x]
    while todo:
        k = todo.pop()
        if k.__class__ is str:
            out.append(html.unescape(k))
        elif k.tag not in UNSEEN:
            todo += reversed(k.kids)
    return "".join(out)


def _annotation(x: Node) -> str:
    todo = [x]
    while todo:
        k = todo.pop()
        if k.__class__ is Node:
            if k.tag == "annotation" and "tex" in k.attr("encoding"):
                return _text_of(k).strip()
            todo += reversed(k.kids)
    return ""


def _table(x: Node, tables: int) -> str:
    rows, todo = [], list(reversed(x.kids))
    cell = lambda k: _rendered(k, tables=tables).replace("\n", " ").replace("|", "\\|")
    while todo:
        k = todo.pop()
        if k.__class__ is str:
            if not k.isspace():
                rows.append([_SPACES.sub(" ", html.unescape(k)).strip()])
        elif k.tag == "tr":
            rows.append([cell(c) for c in k.kids if c.__class__ is Node])
        elif k.tag in ("td", "th"):
            rows.append([cell(k)])
        else:
            todo += reversed(k.kids)
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows if r]
    if lines:
        lines.insert(1, "|" + " --- |" * width)
    return "\n".join(lines)


# ---- Visible text of other formats

_MD_OPAQUE = re.compile(r"^(`{3,}|~{3,})[^\n]*\n.*?(?:^\1[`~]*[ \t]*$|\Z)|(`+)(?!`).*?(?<!`)\2(?!`)|\$\$.+?\$\$|(?<![\\\w$])\$(?=\S)[^$\n]+?(?<=\S)\$(?!\d)|\\\[.+?\\\]|\\\(.+?\\\)|<(?:https?|mailto|ftp):[^>\s]*>|\\begin\{(equation|align|gather|multline|eqnarray|math|displaymath|array|cases)\*?\}.*?\\end\{\3\*?\}", re.S | re.M)
_TEX_OPAQUE = re.compile(r"\\begin\{(verbatim|lstlisting|minted|equation|align|gather|multline|eqnarray|math|displaymath|tikzpicture|array)\*?\}.*?\\end\{\1\*?\}|\\(?:verb|lstinline)\*?([^\sa-zA-Z*]).*?\2|\\(?:texttt|code|url|path)\{[^{}]*\}|\\href\{[^{}]*\}|\$\$.+?\$\$|(?<!\\)\$[^$]+?(?<!\\)\$|\\\[.+?\\\]|\\\(.+?\\\)|(?<!\\)%[^\n]*", re.S)
_HTML_TEXT_OPAQUE = re.compile(r"\$\$.+?\$\$|(?<![\\\w$])\$(?=\S)[^$\n]+?(?<=\S)\$(?!\d)|\\\(.+?\\\)|\\\[.+?\\\]", re.S)

_NAMES = "|".join(sorted(TAGS, key=len, reverse=True))
#: Residue of each format in visible text. Plain uses (a < b, R&D, x * y, C:\dir, a == b) must not match.
RESIDUE = {
    "html": re.compile(rf"</?(?:{_NAMES})(?:\s+[a-zA-Z:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))*\s*/?>|<!--|&(?:[a-zA-Z][a-zA-Z0-9]+|#\d+|#[xX][0-9a-fA-F]+);", re.I),
    "latex": re.compile(r"\\(?:[a-zA-Z]{2,}\*?\s*(?:\[[^\]\n]*\])?\{|(?:begin|end)\{|(?:noindent|item|par|medskip|smallskip|bigskip|newline|newpage|clearpage|centering|maketitle|hfill|vfill|quad|qquad|ldots|dots|textbackslash|LaTeX|TeX|hline|toprule|midrule|bottomrule|em|it|bf|tt|sc|rm|large|Large|small|footnotesize|tiny|scriptsize|linebreak|pagebreak|indent|left|right|protect|bfseries|itshape|ttfamily|sffamily|appendix)(?![a-zA-Z])|[\"'`^~=.](?:\{[a-zA-Z]\}|(?<=[`'^~=.\"])[aeiouAEIOU](?=[a-z]))|\\(?=\s*(?:\n|$|\[)))|(?<=\w)~\\(?:cite|ref|eqref)"),
    "markdown": re.compile(r"(?<![\w*\\])\*\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*\*(?![\w*])|(?<![\w_\\])__(?=[^\s_])[^_\n]+?(?<=[^\s_])__(?![\w_])|(?:!\[[^\[\]\n]*|\[[^\[\]\n]+)\]\((?:https?://|www\.|mailto:|#|\.{0,2}/|[\w./-]+\.(?:html?|png|jpe?g|svg|pdf|gif|md)\b)[^()\s]*(?:\s+\"[^\"]*\")?\)|(?:^|\n)[ \t]{0,3}#{1,6}[ \t]+\w|(?:^|\n)[ \t]{0,3}(?:```|~~~)|(?<![`\w\\])`(?=[^\s`])[^`\n]+?(?<=[^\s`])`(?![`\w])|(?:^|\n)[ \t]{0,3}>[ \t]+\w|(?:^|\n)\|(?:\s*:?-{3,}:?\s*\|)+|(?<![\w~])~~(?=\S)[^~\n]+?(?<=\S)~~(?![\w~])|(?<![\w*\\])\*(?=[^\s*\d])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?:^|\n)[ \t]{0,3}[-*+][ \t]+\[[ xX]\][ \t]"),
    "wiki": re.compile(r"(?<!')'{2,3}(?=[^'\s])[^'\n]+?(?<=[^'\s])'{2,3}(?!')|\[\[[^\[\]\n|]+(?:\|[^\[\]\n]*)?\]\]|\{\{[a-zA-Z][^{}\n]*\}\}|(?:^|\n)[ \t]*(={2,6})[ \t]*[^=\s][^=\n]*?[ \t]*\1[ \t]*(?:\n|$)|(?:^|\n)\{\||\[https?://[^\s\]]+ [^\]\n]+\]|__(?:TOC|NOTOC|FORCETOC)__|<(?:ref|nowiki|references)\b[^>]*>"),
}
#: Strings without one of which a text can't hold a format's markup.
NEEDS = {
    "html": ("<", "&"), "latex": ("\\",), "markdown": ("**", "__", "](", "# ", "`", "~~", "> ", "|", "*", "- ["), "wiki": ("''", "[[", "{{", "==", "{|", "[http", "__", "<ref", "<nowiki"),
}
#: The formats whose markup a field may hold of its own.
OWN = {"html": ("html",), "latex": ("latex",), "markdown": ("markdown",)}
_TEX_NAMES = re.compile(r"\\(?:[a-zA-Z]{1,}\*?)(?:\[[^\]\n]*\])?")


_MATHS = re.compile(r"\$|\\\[|\\\(|\\begin")


def read_marked(text: str, opaque: re.Pattern) -> Node:
    """Tree of a Markdown or LaTeX text: one article of blocks, parted by empty lines, whose code and formulas are nodes of their own."""
    root, article, block = Node("#root"), Node("article"), Node("p")
    root.kids.append(article)
    at = 0

    def prose(piece: str) -> None:
        nonlocal block
        first, *others = piece.split("\n\n")
        block.kids.append(first)
        for x in others:
            article.kids.append(block)
            block = Node("p")
            block.kids.append(x)

    for m in opaque.finditer(text):
        prose(text[at : m.start()])
        node = Node("math" if _MATHS.match(m[0]) else "code")
        node.kids.append(m[0])
        block.kids.append(node)
        at = m.end()
    prose(text[at:])
    article.kids.append(block)
    return root


def _source(block: Node) -> str:
    return "".join(k if k.__class__ is str else k.kids[0] for k in block.kids)


_UNREAD = UNSEEN | frozenset("math pre textarea code kbd samp tt var img br hr".split())


def _visible(root: Node) -> Iterator[tuple[Node, str]]:
    """(node, text) of what a reader of a page sees, without code and formulas."""
    todo: list = [(root, k) for k in reversed(root.kids)]
    while todo:
        x, k = todo.pop()
        if k.__class__ is str:
            t = html.unescape(k) if "&" in k else k
            if not t.isspace():
                yield x, t
        elif k.tag not in _UNREAD:
            todo += [(k, y) for y in reversed(k.kids)]


def hang_foreign(root: Node, own: str) -> None:
    """Hangs markup of other formats into the tree, to the nodes in whose text it stands. In what a browser shows, tags aren't HTML's own either."""
    if own == "html":
        leaves, joint, skip = list(_visible(root)), "\n", ()
    else:
        leaves, joint, skip = [(b, "".join(k if k.__class__ is str else " \x01 " for k in b.kids)) for b in root.kids[0].kids], "\n\n", (own,)
    text = joint.join(t for _, t in leaves)
    kinds = [k for k in RESIDUE if k not in skip and any(x in text for x in NEEDS[k])]
    if not kinds:
        return
    if own == "html" and ("$" in text or "\\" in text):
        text = _HTML_TEXT_OPAQUE.sub(lambda m: " " + "\x01" * (len(m[0]) - 2) + " ", text)
    starts, at = [], 0
    for _, t in leaves:
        starts.append(at)
        at += len(t) + len(joint)
    for kind in kinds:
        for m in RESIDUE[kind].finditer(text):
            node = leaves[bisect_right(starts, m.start() + (m[0][:1] == "\n")) - 1][0]
            node.foreign = (*node.foreign, kind)


_TEX_HEADS = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}


def latex_text(t: str) -> str:
    """LaTeX as clean text: headings, lists, code and formulas kept, commands replaced by what they print."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        s = m[0]
        if s.startswith("%"):
            return ""
        if m[1] in ("verbatim", "lstlisting", "minted"):
            s = "\n```\n" + re.sub(r"^\\begin\{\w+\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})?\n?|\n?\\end\{\w+\*?\}$", "", s) + "\n```\n"
        elif m[1]:
            s = "\n$$\n" + re.sub(r"^\\begin\{\w+\*?\}|\\end\{\w+\*?\}$", "", s).strip() + "\n$$\n"
        elif s.startswith(("\\verb", "\\lstinline")):
            s = "`" + s[s.index(m[2]) + 1 : -1] + "`"
        elif s.startswith(("\\texttt", "\\code", "\\path")):
            s = "`" + s[s.index("{") + 1 : -1] + "`"
        elif s.startswith("\\url"):
            s = s[5:-1]
        elif s.startswith("\\href"):
            return "\\hrefto"
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    t = _TEX_OPAQUE.sub(keep, t)
    t = re.sub(r"\\(chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", lambda m: f"\n\n{'#' * _TEX_HEADS[m[1]]} {m[2]}\n\n", t)
    t = re.sub(r"\\item\b\s*(?:\[([^\]]*)\])?", lambda m: "\n- " + (f"{m[1]}: " if m[1] else ""), t)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n", t)
    t = re.sub(r"\\(?:label|vspace|hspace|vskip|hskip|bibliographystyle|bibliography|input|include|includegraphics|setlength|setcounter)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", t)
    t = re.sub(r"~?\\(?:cite[a-z]*|ref|eqref|autoref|cref|Cref)\*?(?:\[[^\]]*\])*\{([^{}]*)\}", r" [\1]", t)
    # from the innermost command outwards
    new = None
    while new != t:
        new, t = t, re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\([%&$#_{}])", r"\1", t)
    t = re.sub(r"\\\\(?:\[[^\]]*\])?", "\n", t)
    t = re.sub(r"\\[a-zA-Z]+\*?[ \t]?", "", t)
    t = t.replace("~", " ").replace("``", "“").replace("''", "”").replace("{", "").replace("}", "")
    t = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], t)
    return re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", t)).strip()


def _residue_text(t: str, kinds: list[str]) -> str:
    """Foreign markup in visible text, converted."""
    if "html" in kinds:
        t = re.sub(rf"</?(?:{_NAMES})\b[^<>]*>|<!--.*?-->", "", t, flags=re.I | re.S)
        t = html.unescape(t)
    if "latex" in kinds:
        t = latex_text(t)
    if "wiki" in kinds:
        t = re.sub(r"'{2,5}", "", t)
        t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", t)
        t = re.sub(r"\{\{[^{}]*\}\}", "", t)
        t = re.sub(r"(?m)^[ \t]*(={2,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", lambda m: f"{'#' * len(m[1])} {m[2]}", t)
        t = re.sub(r"\[https?://\S+ ([^\]]*)\]", r"\1", t)
    if "markdown" in kinds:
        t = re.sub(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", t)
        t = re.sub(r"!?\[([^\[\]]*)\]\([^()\s]*\)", r"\1", t)
        t = re.sub(r"(?<![\w*])\*(?=\S)([^*\n]+?)\*(?![\w*])", r"\1", t)
    return t


def clean(text: str, own: str) -> tuple[str, list[str]]:
    """(clean text, other formats whose markup was found) of one text of the format `own`."""
    root = parse_html(text) if own == "html" else read_marked(text, _TEX_OPAQUE if own == "latex" else _MD_OPAQUE)
    hang_foreign(root, own)
    order, threshold, path = content_root(root)
    kinds = [k for k in RESIDUE if k in root.formats]
    if own == "html":
        out = _rendered(root, _boilerplate(order, threshold, path))
    else:
        out = "\n\n".join(map(_source, root.kids[0].kids))
        out = latex_text(out) if own == "latex" else out.strip()
    return (_by_prose(out, kinds) if kinds else out), kinds


def _by_prose(t: str, kinds: list[str]) -> str:
    """Converts residue everywhere but in code and formulas."""
    parts, at = [], 0
    for m in _MD_OPAQUE.finditer(t):
        parts += [_residue_text(t[at : m.start()], kinds), m[0]]
        at = m.end()
    return "".join([*parts, _residue_text(t[at:], kinds)])


def _convert():
    def f(names: list, ids: list, formats: list, texts: list) -> dict[str, list]:
        done = [clean(t, f if f in OWN else "markdown") for f, t in zip(formats, texts)]
        return {"field_name": names, "row_id": ids, "text": [d[0] for d in done], "foreign": [d[1] for d in done]}

    return f


def clean_markup(fields: dict[str, DataFrame]) -> DataFrame:
    """(field_name, row_id, text, foreign) for each non-null text of the given fields.

    `fields` has, by field name, a frame of (row_id, format, text); format is html, latex or markdown, in any case, and
    anything else or null counts as markdown. `foreign` lists the other formats whose markup the visible text held. An
    empty text stays empty. Text inside code and formulas is kept as it is. Repeated rows are converted each.
    """
    every = None
    for name, df in fields.items():
        row_id, fmt, text = df.columns
        one = df.select(F.lit(name).alias("field_name"), F.col(row_id).cast("long").alias("row_id"), F.lower(F.trim(F.col(fmt))).alias("format"), F.col(text).alias("text"))
        every = one if every is None else every.unionByName(one)
    return map_columns(every.filter(F.col("text").isNotNull()), _convert, "field_name string, row_id long, text string, foreign array<string>")


def cleaned(spark, sf_dir: str) -> DataFrame:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return clean_markup({
        "blocks.text_md": read("blocks").select("block_row_id", F.lit("markdown").alias("format"), "text_md"),
        "sections.html": read("sections").select("section_id", F.lit("html").alias("format"), "html"),
        "raw_blocks.content": read("raw_blocks").select("raw_id", "raw_format", "content"),
    })


def found(spark, sf_dir: str) -> DataFrame:
    """p4_found: rows whose conversion met markup that isn't the field's own."""
    return cleaned(spark, sf_dir).filter(F.size("foreign") > 0).select("field_name", "row_id")
