"""Garbled text from wrong character encoding (problem 10): best-first search for the original.

A passage is a line. Its words with anything odd in them are the start state of a graph whose edges are encode, decode
and unescape operations. States are taken cheapest first, each visited once (by hash), until none is left whose cost is
near enough to the cheapest one's; the cost of a state says how
implausible its characters are: control and replacement characters, question marks and symbols inside words, mixed scripts,
accented letters that no one alphabet has together, rare letters. A passage counts as garbled if a clearly cheaper state is
reachable, or if the cheapest one still holds what only lost bytes leave behind. Text shown as an example (code, short
quoted strings) is masked.

The operator is one narrow Python stage over whole texts: no shuffle.
"""

from __future__ import annotations

import heapq
import html
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_columns

#: Letters beyond ASCII of the languages whose words are taken as plausible.
ALPHABETS = {
    "german": "äöüßÄÖÜ", "french": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ", "spanish": "áéíñóúüÁÉÍÑÓÚÜ", "portuguese": "áâãàçéêíóôõúüÁÂÃÀÇÉÊÍÓÔÕÚ",
    "polish": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "czech": "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ", "slovak": "áäčďéíĺľňóôŕšťúýžÁČĎÉÍĽŇÓÔŠŤÚÝŽ", "turkish": "çğıöşüâîûÇĞİÖŞÜ",
    "romanian": "ăâîșțşţĂÂÎȘȚ", "hungarian": "áéíóöőúüűÁÉÍÓÖŐÚÜŰ", "scandinavian": "åäöæøéÅÄÖÆØÉ", "icelandic": "áéíóúýþæöðÁÉÍÓÚÝÞÆÖÐ",
    "croatian": "čćđšžČĆĐŠŽ", "italian": "àèéìíòóùúÀÈÉÌÒÙ", "baltic": "āčēģīķļņšūžąęėįųõäöüĀČĒĢĪĶĻŅŠŪŽĄĘĖĮŲ",
}
#: The commoner half of the Cyrillic letters.
_COMMON_CYRILLIC = "оеаинтсрвлкмдпуяыьгзб"
#: Marks that may stand at the edge of a word or between digits.
_PUNCTUATION = "“”„‟‘’‚«»‹›¿¡…–—‐‑−·•†‡§¶©®™°′″€£¥¢¹²³ªº½¼¾×÷±≤≥≠≈∞→←↔⇒∈∑∏√∫∂∆∇µ¬¤¦¨¯´¸ΩÅ"
BAD_WORD = 3.0
STEP = 0.25
#: How far a state's cost may lie above the cheapest known one's for its edges to be followed: FRONTIER where the edge to it traded one
#: set's characters for another's; FRONTIER_SHORTER and half of what has been gained so far where the text became shorter, as undoing a
#: reading of UTF-8 or an escape makes it.
FRONTIER, FRONTIER_SHORTER = 2.0, 5.0

_LOST_LETTER = re.compile(r"[^\W\d_]\?[^\W\d_]")
_EXAMPLES = re.compile(r"```.*?```|~~~.*?~~~|`[^`\n]*`|\"[^\"\sA-Za-z]{1,8}\"|«[^»\sA-Za-z]{1,8}»|'[^'\sA-Za-z]{1,8}'|“[^”\sA-Za-z]{1,8}”|‘[^’\sA-Za-z]{1,8}’|„[^“”\sA-Za-z]{1,8}[“”]|\(?https?://\S+", re.S)
_ESCAPES = re.compile(r"&(?:[a-zA-Z]{2,8}|#\d{2,6}|#x[0-9a-fA-F]{2,5});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|=[C-F][0-9A-F](?:=[89AB][0-9A-F])+|%[C-F][0-9A-F](?:%[89AB][0-9A-F])+")
_ALPHABET_SETS = [frozenset(v) for v in ALPHABETS.values()]
_ALL_LETTERS = frozenset().union(*_ALPHABET_SETS)
_EDGE = frozenset(_PUNCTUATION)


def _encode(text: str, enc: str) -> bytes:
    """Bytes of `text`; in Windows code pages the undefined places hold the control characters, as browsers have it."""
    if enc in ("cp1252", "cp1250", "cp1254", "cp1251"):
        try:
            return text.encode(enc)
        except UnicodeEncodeError:
            return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode(enc) for c in text)
    return text.encode(enc)


@lru_cache(maxsize=50_000)
def _word(w: str) -> tuple[float, int, bool, bool]:
    """(cost, bits of the alphabets that have all its letters, whether anything in it is odd, whether bytes were lost in it) of one word."""
    cost, usual, script, lost = 0.0, 0.0, set(), False
    alphabets = (1 << len(_ALPHABET_SETS)) - 1
    run = 0
    for i, c in enumerate(w):
        o = ord(c)
        if o < 128:
            run = 0
            if c.isalpha():
                script.add("L")
                if i and c.isupper() and w[i - 1].islower() and ord(w[i - 1]) > 127:
                    cost += 1
            elif c == "?" and 0 < i < len(w) - 1 and w[i - 1].isalpha() and w[i + 1].isalpha() and w[i + 1].islower() and not any(x in w for x in "/=&@"):
                # in the place of a letter
                cost += 8
                lost = True
            continue
        before, after = w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
        inside = before.isalpha() or after.isalpha()
        if c == "�" or o in range(0x80, 0xA0) or 0xE000 <= o <= 0xF8FF:
            cost += 8
            lost = True
        elif 0x2500 <= o <= 0x259F:
            cost += 5
        elif 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF:
            script.add("H")
            cost += (h := _han(c))
            usual += min(h, 0.2)
        elif 0x3000 <= o <= 0x30FF or 0xAC00 <= o <= 0xD7AF or 0xFF00 <= o <= 0xFFEF:
            if o >= 0x3040 and o < 0xFF00:
                script.add("H")
            cost += 3 if 0xFF61 <= o <= 0xFFDC else 0.3 if o < 0x3040 or o >= 0xFF00 else 0.8
            usual += 0.8
        elif 0x400 <= o <= 0x4FF:
            script.add("C")
            low = c.lower()
            cost += (h := 0.1 if low in _COMMON_CYRILLIC else 0.35)
            usual += h + 0.1 * c.isupper()
            if not ("а" <= low <= "я" or low == "ё"):
                cost += 2
            if i and c.isupper() and before.islower():
                cost += 3
            elif c.isupper():
                cost += 0.2
        elif c.isalpha() and c not in "ªºµ":
            run += 1
            script.add("L" if o < 0x250 else "G")
            if c in _ALL_LETTERS:
                cost += (h := 0.6 if run == 1 or w.isupper() else 0.8 if run == 2 else 1.5)
                usual += min(h, 0.8)
                for k, s in enumerate(_ALPHABET_SETS):
                    if c not in s:
                        alphabets &= ~(1 << k)
            elif o < 0x250:
                cost += 2.5
                alphabets = 0
            else:
                cost += 0.6
                usual += 0.6
            if c.isupper() and before and before.isalpha() and before.islower():
                cost += 2.5
            if c in "ĞÐ" and not (before.isalpha() and before.isupper()) and c == "Ğ":
                cost += 3
            continue
        elif c == "\xa0":
            cost += 2.5 if before.isalpha() and after.isalpha() else 1.5 if before.isalpha() and ord(before) > 127 else 0.3
            usual += 0.3
        elif c == "\xad":
            cost += 1.5
        elif c in _EDGE:
            cost += 0.4
            usual += 0.6
            if before.isalpha() and after.isalpha():
                cost += 0.2 if c in "’‘–—‐‑·−°" else 3.5
            elif after.isalpha() and c in "‚„†‡¹²³ªº¼½¾¨¯´¸™•‹›¤¦©®¬":
                cost += 3 if c not in "©®„‚‹•" else 0.8
            elif before.isalpha() and ord(before) > 127 and c in "€™‚„†‡‰‹•¢£¥±²³¶·¹º":
                cost += 1.2
            elif inside and c in "√∂∫≥≠≈∈∏∑∆∞":
                cost += 2.5
            elif before.isalpha() and c in "¨¯´¸¤¦¬¼½¾¶§©¡¿±÷":
                cost += 2.5 if ord(before) > 127 or c in "¨¸¤¦¬¼½¾¡¿" else 0.8
            elif c in "¨¯´¸¤¦¬" and (len(w) > 1):
                cost += 1.5
        elif 0x300 <= o < 0x370:
            cost += 1.2
        elif 0x200B <= o <= 0x200F or o == 0xFEFF:
            cost += 0.5
        else:
            cost += 2.5 if inside else 1
        run = 0
    if len(script) > 1:
        cost += 3
    return cost, alphabets, cost - usual >= 0.75, lost


@lru_cache(maxsize=8192)
def _han(c: str) -> float:
    """Common Chinese characters are the first level of the national set, which its lead byte tells."""
    try:
        lead = c.encode("gb2312")[0]
    except UnicodeEncodeError:
        return 1.6
    return 0.15 if lead <= 0xD7 else 1.2


def cost(words: tuple[str, ...]) -> float:
    """Implausibility of a passage's words: of each, and of their letters under the alphabet that fits most words."""
    total, fits, accented = 0.0, [0] * len(_ALPHABET_SETS), 0
    for w in words:
        c, bits, _, _ = _word(w)
        total += c
        if bits != (1 << len(_ALPHABET_SETS)) - 1:
            accented += 1
            if not bits:
                total += 1
            for k in range(len(fits)):
                fits[k] += bits >> k & 1
    return total + 1.2 * (accented - max(fits)) if accented else total


@lru_cache(maxsize=100_000)
def _recode(w: str, seen: str, was: str) -> str | None:
    """`w` read as `was` in place of `seen`, or None. A word garbled in part is read by its runs, if it was UTF-8."""
    try:
        return _encode(w, seen).decode(was)
    except (UnicodeError, ValueError):
        if was != "utf-8":
            return None
    parts, hit = [], False
    for run in re.split(r"([^\x00-\x7f]+)", w):
        try:
            fixed = _encode(run, seen).decode(was) if not run.isascii() else run
        except (UnicodeError, ValueError):
            fixed = run
        hit |= fixed != run
        parts.append(fixed)
    return "".join(parts) if hit else None


def _high(enc: str, first: int, last: int) -> str:
    """Character class of the bytes first..last as `enc` shows them."""
    shown = set()
    for b in range(first, last + 1):
        try:
            shown.add(bytes([b]).decode(enc))
        except UnicodeError:
            shown.add(chr(b))
    return "[" + re.escape("".join(sorted(shown))) + "]"


#: By each set that may have been read instead of UTF-8, what a two-byte sequence looks like in it.
_UTF8_AS = {
    enc: re.compile(_high(enc, 0xC2, 0xF4) + _high(enc, 0x80, 0xBF))
    for enc in ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "cp1254", "cp866", "koi8-r")
}
_HAN_RUN = re.compile(r"[\u3400-\u9fff\ue000-\uf8ff\ufffd]{2}")
#: One set read as another, as it occurs in practice (what must be seen, seen as, was).
_LATIN_RUN, _LATIN_WORD = re.compile(r"[\u0080-\u017f‚-™]{3}"), re.compile(r"[\u0080-\u00ff‚-™ŒœŠšŽžŸƒ]")
_CYRILLIC, _BOXED = re.compile(r"[\u0400-\u04ff]{2}"), re.compile(r"[\u0400-\u04ff\u2500-\u259f√°·∙]{2}")
_SWAPS = [
    (_CYRILLIC, "cp1251", "koi8-r"), (_CYRILLIC, "koi8-r", "cp1251"), (_BOXED, "cp866", "cp1251"), (_CYRILLIC, "cp1251", "cp866"),
    (_LATIN_RUN, "cp1252", "cp1251"), (_LATIN_RUN, "cp1252", "koi8-r"), (_LATIN_RUN, "cp1252", "cp866"), (_LATIN_RUN, "latin-1", "iso8859-5"),
    (_LATIN_RUN, "cp1252", "gb18030"), (_LATIN_RUN, "cp1252", "big5"), (_LATIN_RUN, "cp1252", "shift_jis"), (_LATIN_RUN, "cp1252", "euc_jp"), (_LATIN_RUN, "cp1252", "euc-kr"),
    (_LATIN_WORD, "cp1252", "cp1250"), (_LATIN_WORD, "latin-1", "iso8859-2"), (_LATIN_WORD, "cp1252", "cp1254"), (_LATIN_WORD, "cp1252", "mac_roman"),
    (_LATIN_WORD, "cp1250", "cp1252"), (_LATIN_WORD, "mac_roman", "cp1252"), (_LATIN_WORD, "cp437", "cp1252"), (_LATIN_WORD, "cp850", "cp1252"), (_LATIN_WORD, "cp1252", "cp850"),
]


def _unescape(w: str) -> str:
    w = html.unescape(w)
    w = re.sub(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2}))", lambda m: chr(int(m[1] or m[2], 16)), w)
    try:
        return re.sub(r"((?:[=%][0-9A-F]{2})+)", lambda m: bytes.fromhex(re.sub("[=%]", "", m[1])).decode("utf-8"), w)
    except UnicodeError:
        return w


def _neighbours(words: tuple[str, ...]):
    """(operation, next state) of each edge that can apply to what is seen.

    Reading as UTF-8 changes the words it can; other sets must be able to read every word, or change implausible ones only.
    """
    seen_text = " ".join(words)
    for enc, look in _UTF8_AS.items():
        if look.search(seen_text):
            yield f"{enc}>utf-8", tuple((None if w.isascii() else _recode(w, enc, "utf-8")) or w for w in words)
    if _HAN_RUN.search(seen_text):
        yield "gb18030>utf-8", tuple((None if w.isascii() else _recode(w, "gb18030", "utf-8")) or w for w in words)
    for look, seen, was in _SWAPS:
        if look.search(seen_text):
            out = [w if w.isascii() else _recode(w, seen, was) for w in words]
            if None not in out:
                yield f"{seen}>{was}", tuple(out)
            # a passage garbled in part: only the words that look it
            some = tuple((_recode(w, seen, was) if _word(w)[0] >= BAD_WORD else None) or w for w in words)
            if some != words:
                yield f"{seen}>{was} in part", some
    if _ESCAPES.search(seen_text):
        yield "unescape", tuple(_unescape(w) if _ESCAPES.search(w) else w for w in words)


def search(words: tuple[str, ...]) -> tuple[float, tuple[str, ...], list[str]]:
    """Cheapest state found best first, and the operations that lead to it.

    The frontier holds every state whose cost lies near enough to the cheapest known one's, see FRONTIER; the search ends when it is
    empty, whatever the number of states. Each step costs STEP, so no chain is followed for ever.
    """
    start = cost(words)
    best = (start, words, [])
    heap, visited = [(start, 0, words, [], False)], {hash(words)}

    def near(c: float, shorter: bool) -> bool:
        return c <= best[0] + (FRONTIER_SHORTER + (start - best[0]) / 2 if shorter else FRONTIER)

    while heap:
        c, _, state, path, shorter = heapq.heappop(heap)
        if not near(c, shorter):
            continue
        length = sum(map(len, state))
        for op, nxt in _neighbours(state):
            if (h := hash(nxt)) in visited:
                continue
            visited.add(h)
            shorter = sum(map(len, nxt)) < length
            if near(d := cost(nxt) + STEP * (len(path) + 1), shorter):
                heapq.heappush(heap, (d, len(visited), nxt, [*path, op], shorter))
                if d < best[0] - 1e-9:
                    best = (d, nxt, [*path, op])
    return best


_WORDS = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")


@lru_cache(maxsize=20_000)
def _passage(words: tuple[str, ...]) -> tuple[bool, tuple[str, ...] | None, bool]:
    """(garbled, restored words or None, restored in full)."""
    odd, every = False, (1 << len(_ALPHABET_SETS)) - 1
    for w in words:
        _, bits, o, _ = _word(w)
        odd |= o
        every &= bits
    if not odd and every or (start := cost(words)) < 1.5:
        return False, None, False
    c, state, path = search(words)
    changed = [w for w, x in zip(words, state) if w != x]
    better = bool(path) and start - c >= max(0.9, 0.25 * cost(tuple(changed)))
    lost = any(_word(w)[3] for w in (state if better else words))
    return better or lost, state if better else None, better and not lost


_TOKENS = re.compile(r"[^ \t\r\n]+")
#: UTF-8 read as quoted-printable or percent escapes, which aren't any writer's own outside addresses.
_BYTES = re.compile(r"=[C-F][0-9A-F](?:=[89AB][0-9A-F])+|%[C-F][0-9A-F](?:%[89AB][0-9A-F])+")
_ADDRESS = re.compile(r"[/?@&:]|^www\.")


@lru_cache(maxsize=20_000)
def _escaped(words: tuple[str, ...]) -> tuple[bool, tuple[str, ...] | None, bool]:
    """As _passage, for ASCII words with escapes: garbled if what they stand for can be restored, or is UTF-8 in bytes.

    An escaped letter that is plausible is markup, and one that can't be restored may be an example.
    """
    seen = tuple(_unescape(w) for w in words)
    _, fixed, whole = _passage(seen)
    raw = {w for w, u in zip(words, seen) if u != w and _BYTES.search(w) and not _ADDRESS.search(w) and not _word(u)[2]}
    if not fixed and not raw:
        return False, None, False
    out = tuple(x if x != u or w in raw else w for w, u, x in zip(words, seen, fixed or seen))
    return True, out, whole or not fixed


def repair(text: str) -> tuple[bool, bool, str]:
    """(garbled, restored in full, text with what could be restored)."""
    if text.isascii() and not any(c in text for c in "?\\=%&"):
        return False, False, text
    masked = _EXAMPLES.sub(lambda m: "".join(" " if c != "\n" else c for c in m[0]), text)
    garbled = whole = False
    whole_all = True
    edits: list[tuple[int, int, str]] = []
    at = 0
    for line in masked.split("\n"):
        marks = "?" in line and _LOST_LETTER.search(line)
        if not line.isascii() or marks or _ESCAPES.search(line):
            if marks:
                spans = [m for m in _TOKENS.finditer(line) if not m[0].isascii() or _LOST_LETTER.search(m[0])]
            else:
                spans = list(_WORDS.finditer(line))
            # the others are ASCII, and of interest for their escapes only
            plain = [m for m in _TOKENS.finditer(line) if m[0].isascii() and _ESCAPES.search(m[0]) and not _unescape(m[0]).isascii()] if _ESCAPES.search(line) else []
            for group, look in ((spans, _passage), (plain, _escaped)):
                if not group:
                    continue
                words = tuple(dict.fromkeys(m[0] for m in group))
                bad, fixed, whole = look(words)
                if bad:
                    garbled = True
                    whole_all &= whole
                    if fixed:
                        now = dict(zip(words, fixed))
                        edits += [(at + m.start(), at + m.end(), now[m[0]]) for m in group if now[m[0]] != m[0]]
        at += len(line) + 1
    out, k = [], 0
    for a, b, w in sorted(edits):
        out += [text[k:a], w]
        k = b
    return garbled, garbled and whole_all, "".join([*out, text[k:]]) if edits else text


def _mend():
    def f(ids: list, texts: list) -> dict[str, list]:
        done = [repair(t) for t in texts]
        return {"id": ids, "restored": [d[1] for d in done], "text": [d[2] if d[0] else None for d in done]}

    return f


def mend_texts(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, restored, text) of the rows with a garbled passage: the text with every passage restored that could be.

    `restored` tells whether nothing garbled is left. Rows without garbling, null or empty texts and an empty table give no
    rows; repeated ids give a row each; other columns aren't read.
    """
    # letters only lose or gain by decoding beyond ASCII, but for escapes and question marks
    suspect = F.col("text").rlike(r"[^\x00-\x7f]|\p{L}\?\p{L}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|=[C-F][0-9A-F]=|%[C-F][0-9A-F]%|&#?\w+;")
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text")).filter(suspect)
    return map_columns(rows, _mend, "id long, restored boolean, text string").filter(F.col("text").isNotNull())


def found(spark, sf_dir: str) -> DataFrame:
    """p10_found."""
    return mend_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"))
