"""Splitting oversized texts at natural boundaries (problem 5): recursive separator hierarchy.

A text above its limit is cut by section; parts still too long by paragraph, then sentence, word and character. The parts
are packed greedily up to the limit, and every piece but the first begins with the last `overlap` characters before it.
Only texts above the limit leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_columns

LEVELS = ("section", "paragraph", "sentence", "word", "character")
_FENCE = re.compile(r"^(?:```|~~~).*?^(?:```|~~~)[ \t]*$", re.M | re.S)
_BREAKS = {
    "section": re.compile(r"(?<=\n)(?=#{1,6}[ \t])"),
    "paragraph": re.compile(r"\n[ \t]*\n\s*"),
    "sentence": re.compile(r"[.!?…][\"'”’»)\]]*\s+(?=[\"'“‘«(\[¿¡]*[^\W_a-z])|[。！？][”’」』]?|\n"),
    "word": re.compile(r"\s+"),
}
#: A full stop after these doesn't end a sentence.
_ABBREVIATIONS = ("al.", "cf.", "e.g.", "i.e.", "eq.", "eqs.", "fig.", "figs.", "sec.", "ref.", "refs.", "no.", "vol.", "pp.", "vs.", "dr.", "prof.", "approx.", "resp.", "bzw.", "z.B.", "p.ex.")


def _cuts(text: str, start: int, end: int, level: str) -> list[int]:
    """Ends of the parts of text[start:end] at one level; a separator belongs to the part before it."""
    if level == "character":
        return []
    fences = [m.span() for m in _FENCE.finditer(text, start, end)] if level in ("section", "paragraph") else []
    out, k = [], 0
    for m in _BREAKS[level].finditer(text, start, end):
        at = m.end()
        while k < len(fences) and fences[k][1] <= at:
            k += 1
        inside = k < len(fences) and fences[k][0] < at < fences[k][1]
        short = level == "sentence" and text[max(start, m.start() - 8) : m.start() + 1].lower().endswith(_ABBREVIATIONS)
        if start < at < end and not inside and not short:
            out.append(at)
    return out


def _parts(text: str, start: int, end: int, room: int, level: int) -> list[tuple[int, int]]:
    """(end, level) of parts of at most `room` characters, in order, without a gap."""
    if end - start <= room:
        return [(end, level)]
    name = LEVELS[level]
    if name == "character":
        out = []
        while end - start > room:
            at = start + room
            while at > start + 1 and (unicodedata.combining(text[at]) or text[at] in "‍️"):
                at -= 1
            if at == start + 1:
                at = start + room
            out.append((at, level))
            start = at
        return [*out, (end, level)]
    out = []
    for at in [*_cuts(text, start, end, name), end]:
        inner = _parts(text, start, at, room, level + 1) if at - start > room else [(at, level)]
        # the last inner part ends where this level's boundary is
        out += [*inner[:-1], (at, level)]
        start = at
    return out


def split_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(begin, fresh, end, boundary) of each piece: text[begin:end] is the piece, text[begin:fresh] what it repeats.

    `boundary` is the level of the cut at its end. A text up to the limit is one piece.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError(f"a limit above the overlap is needed, not {limit} and {overlap}")
    if len(text) <= limit:
        return [(0, 0, len(text), "end")]
    out, begin, fresh, last = [], 0, 0, None
    for end, level in _parts(text, 0, len(text), limit - overlap, 0):
        if last and end - begin > limit:
            out.append((begin, fresh, last[0], LEVELS[last[1]]))
            fresh = last[0]
            begin = max(begin, fresh - overlap)
        last = end, level
    out.append((begin, fresh, len(text), "end"))
    return out


def _split():
    def f(names: list, ids: list, texts: list, limits: list, overlaps: list) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("field_name", "row_id", "piece_no", "begin", "fresh", "end", "boundary", "piece")}
        for name, i, t, limit, overlap in zip(names, ids, texts, limits, overlaps):
            for n, (a, b, c, level) in enumerate(split_spans(t, limit, overlap)):
                for k, v in zip(out, (name, i, n, a, b, c, level, t[a:c])):
                    out[k].append(v)
        return out

    return f


def split_texts(fields: dict[str, DataFrame], limits: DataFrame) -> DataFrame:
    """Pieces of every text above its limit: field_name, row_id, piece_no, begin, fresh, end, boundary, piece.

    `fields` has, by field name, a frame of (row_id, text); `limits` has field_name, max_chars, overlap_chars. Sizes are in
    characters (code points). A piece has at most max_chars; without its first fresh - begin characters, the pieces of a text
    in order make up the text again. A text that doesn't exceed its limit, a null text, a null limit or a field without limits
    gives no piece; a negative overlap, or one not below the limit, is an error. Repeated rows are split each.
    """
    texts = None
    for name, df in fields.items():
        row_id, text = df.columns
        one = df.select(F.lit(name).alias("field_name"), F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
        texts = one if texts is None else texts.unionByName(one)
    known = limits.select("field_name", F.col("max_chars").cast("int"), F.col("overlap_chars").cast("int")).dropna().dropDuplicates(["field_name"])
    over = texts.join(known, "field_name").filter(F.char_length("text") > F.col("max_chars")).select("field_name", "row_id", "text", "max_chars", "overlap_chars")
    return map_columns(over, lambda: _split(), "field_name string, row_id long, piece_no int, begin int, fresh int, end int, boundary string, piece string")


def pieces(spark, sf_dir: str) -> DataFrame:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    fields = {"ingestion_results.content": read("ingestion_results").select("result_id", "content"), "sections.markdown": read("sections").select("section_id", "markdown")}
    return split_texts(fields, read("split_limits"))


def found(spark, sf_dir: str) -> DataFrame:
    """p5_found: texts that came out in several pieces."""
    return pieces(spark, sf_dir).filter("piece_no = 1").select("field_name", "row_id")
