"""Best representative of each duplicate group (problem 2): field-by-field survivorship.

One aggregation takes, for each attribute, the maximum of a composite struct
(usable, -source rank, timestamp, -id, value). Partial maxima are made before the shuffle, so a hot group moves
one row per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stand-ins for "no value", compared trimmed, in lower case.
STAND_INS = [
    "", "-", "--", "---", "–", "—", ".", "..", "...", "?", "??", "???", "/", "*", "n/a", "na", "n.a.", "n.a", "nan", "nil", "null", "none", "(none)", "[none]",
    "unknown", "(unknown)", "[unknown]", "not available", "not applicable", "not given", "not known", "no value", "missing", "undefined", "unspecified", "empty",
    "tba", "t.b.a.", "tbd", "t.b.d.", "to appear", "to be announced", "to be determined", "in press", "forthcoming", "xx", "xxx", "todo", "[s.n.]", "s.n.", "[s.l.]",
    "s.l.", "[s.l.: s.n.]", "[s.l. : s.n.]", "[n.p.]", "n.p.", "[n.d.]", "n.d.", "pp.", "pp", "p.", "p", "doi:", "doi", "#n/a", "0",
]

UNKNOWN_RANK = 1_000_000


def squeezed(c: Column) -> Column:
    """Trimmed of any white space and zero-width marks, lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s ​﻿]+|[\s ​﻿]+$", ""))


def usable_text(c: Column) -> Column:
    return F.coalesce(~squeezed(c).isin(STAND_INS), F.lit(False))


def usable_doi(c: Column) -> Column:
    """Has a prefix (10.NNNN) and a suffix, after any resolver address or label."""
    bare = F.regexp_replace(squeezed(c), r"^(?:https?://)?(?:(?:dx\.)?doi\.org/)?(?:doi:?\s*)?", "")
    return F.coalesce(bare.rlike(r"^10\.\d{4,9}(?:\.\d+)*/\S*[\p{L}\p{N}]"), F.lit(False)) & usable_text(c)


def usable_pages(c: Column) -> Column:
    """Has a first page, which isn't beyond the last one where both are plain numbers.

    Numbers are taken as they stand: in 1472-81 the first page is beyond the last.
    """
    bare = F.regexp_replace(squeezed(c), r"^(?:pages?|pp?|s|seiten?)\s*[.:]?\s*(?=[\p{L}\d])", "")
    has_first = bare.rlike(r"^[\p{L}]{0,4}[.:]?\s*\d")
    first = F.regexp_extract(bare, r"^(\d+)\s*(?:[-‐-―−]+|to)\s*\d+", 1)
    last = F.regexp_extract(bare, r"^\d+\s*(?:[-‐-―−]+|to)\s*(\d+)", 1)
    number = lambda s: s.cast("decimal(38,0)")
    backwards = (first != "") & F.coalesce(number(first) > number(last), F.lit(True))
    return F.coalesce(has_first & ~backwards, F.lit(False)) & usable_text(c)


USABLE = {"doi": usable_doi, "journal": usable_text, "pages": usable_pages, "publisher": usable_text}


def source_ranks(df: DataFrame, sources: DataFrame, kind: str = "source_kind") -> DataFrame:
    """Adds _rank; a source's name counts without regard to case and blanks, an unlisted or null one ranks last."""
    names = sources.select(squeezed(F.col("source_kind")).alias("_kind"), F.col("trust_rank").alias("_r")).groupBy("_kind").agg(F.min("_r").alias("_r"))
    return df.withColumn("_kind", squeezed(F.col(kind))).join(names, "_kind", "left").withColumn("_rank", F.coalesce(F.col("_r").cast("int"), F.lit(UNKNOWN_RANK)))


def survivors(
    df: DataFrame, sources: DataFrame, keys: tuple[str, ...] = ("arxiv_id", "cite_key"), row_id: str = "citation_id",
    fields: tuple[str, ...] = tuple(USABLE), when: str = "fetched_at", kind: str = "source_kind", min_rows: int = 2, values: bool = True,
) -> DataFrame:
    """One row per key with at least `min_rows` rows: for each field its surviving value and, as FIELD_from, the row it is from.

    Among usable values the lowest source rank wins, then the latest timestamp (a null one is the earliest), then the
    lowest row id. Without a usable value the value is null and FIELD_from is 0. Rows with a null in a key name no item and
    are left out; repeated rows are rows of their own; an empty table gives an empty result; further columns aren't read.
    """
    need = df.select(*keys, row_id, *fields, when, kind).dropna(subset=list(keys))
    ranked = source_ranks(need, sources, kind)

    def best(f: str) -> Column:
        parts = [USABLE.get(f, usable_text)(F.col(f)).alias("ok"), (-F.col("_rank")).alias("r"), F.col(when).alias("t"), (-F.col(row_id)).alias("i")]
        return F.max(F.struct(*parts, *([F.col(f).alias("v")] if values else []))).alias(f"_{f}")

    one = ranked.groupBy(*keys).agg(F.count("*").alias("_n"), *[best(f) for f in fields]).filter(F.col("_n") >= min_rows)
    out = list(keys)
    for f in fields:
        b = F.col(f"_{f}")
        out.append(F.when(b["ok"], -b["i"]).otherwise(F.lit(0)).cast("long").alias(f"{f}_from"))
        if values:
            out.append(F.when(b["ok"], b["v"]).alias(f))
    return one.select(*out)


def records(spark, sf_dir: str) -> DataFrame:
    """p2_records: the surviving record of each item, every field with its value and the row it is from."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return survivors(read("citations"), read("citation_sources"))


def found(spark, sf_dir: str) -> DataFrame:
    """p2_found."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return survivors(read("citations"), read("citation_sources"), values=False)


#: Stand-ins as the SQL has them, written out by themselves so that a wrong entry above shows.
_SQL_STAND_INS = """'', '-', '--', '---', '–', '—', '.', '..', '...', '?', '??', '???', '/', '*', 'n/a', 'na', 'n.a.', 'n.a', 'nan', 'nil', 'null', 'none', '(none)', '[none]',
    'unknown', '(unknown)', '[unknown]', 'not available', 'not applicable', 'not given', 'not known', 'no value', 'missing', 'undefined', 'unspecified', 'empty',
    'tba', 't.b.a.', 'tbd', 't.b.d.', 'to appear', 'to be announced', 'to be determined', 'in press', 'forthcoming', 'xx', 'xxx', 'todo', '[s.n.]', 's.n.', '[s.l.]',
    's.l.', '[s.l.: s.n.]', '[s.l. : s.n.]', '[n.p.]', 'n.p.', '[n.d.]', 'n.d.', 'pp.', 'pp', 'p.', 'p', 'doi:', 'doi', '#n/a', '0'"""


def found_sql(values: bool = False) -> str:
    """The same in SQL."""
    names = _SQL_STAND_INS
    low = "lower(regexp_replace({0}, '^[\\s\\x{{00a0}}\\x{{200b}}\\x{{feff}}]+|[\\s\\x{{00a0}}\\x{{200b}}\\x{{feff}}]+$', '', 'g'))"
    text = lambda c: f"coalesce({low.format(c)} NOT IN ({names}), FALSE)"
    doi = f"coalesce(regexp_matches(regexp_replace({low.format('doi')}, '^(?:https?://)?(?:(?:dx\\.)?doi\\.org/)?(?:doi:?\\s*)?', ''), '^10\\.\\d{{4,9}}(?:\\.\\d+)*/\\S*[\\p{{L}}\\p{{N}}]'), FALSE) AND {text('doi')}".replace("{{", "{").replace("}}", "}")
    bare = f"regexp_replace({low.format('pages')}, '^(?:pages?|pp?|s|seiten?)\\s*[.:]?\\s*([\\p{{L}}\\d])', '\\1')".replace("{{", "{").replace("}}", "}")
    first, last = (f"try_cast(nullif(regexp_extract({bare}, '^(\\d+)\\s*(?:[-\\x{{2010}}-\\x{{2015}}\\x{{2212}}]+|to)\\s*(\\d+)', {k}), '') AS HUGEINT)".replace("{{", "{").replace("}}", "}") for k in (1, 2))
    pages = f"coalesce(regexp_matches({bare}, '^[\\p{{L}}]{{0,4}}[.:]?\\s*\\d'), FALSE) AND NOT coalesce({first} > {last}, FALSE) AND {text('pages')}".replace("{{", "{").replace("}}", "}")
    use = {"doi": doi, "journal": text("journal"), "pages": pages, "publisher": text("publisher")}
    order = "ORDER BY r, fetched_at DESC NULLS LAST, citation_id"
    best = ", ".join(f"coalesce(first(citation_id {order}) FILTER (WHERE {ok}), 0) AS {f}_from" + (f", first({f} {order}) FILTER (WHERE {ok}) AS {f}" if values else "") for f, ok in use.items())
    return (
        f"WITH k AS (SELECT {low.format('source_kind')} AS kind, min(trust_rank) AS t FROM citation_sources GROUP BY ALL), "
        f"c AS (SELECT citations.*, coalesce(k.t, 1000000) AS r FROM citations LEFT JOIN k ON k.kind = {low.format('citations.source_kind')}) "
        f"SELECT arxiv_id, cite_key, {best} FROM c WHERE arxiv_id IS NOT NULL AND cite_key IS NOT NULL GROUP BY arxiv_id, cite_key HAVING count(*) >= 2"
    )
