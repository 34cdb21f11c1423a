"""Matching, survivorship, names, near-duplicates, packing, mixing: brute force and edge cases."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quirework.llm import entity_match as E
from quirework.llm import mixing, names, neardup, packing, survivor, tokens

T = datetime.datetime


def test_survivors(spark):
    rows = [
        ("a", "k", 1, None, "J1", "5-9", "tba", T(2020, 1, 1), "crossref"), ("a", "k", 2, "https://doi.org/10.1234/X", " ", "9-5", "P2", T(2021, 1, 1), "BBL "), ("a", "k", 3, "10.1234/", "J3", "pp. 3", "P3", T(2022, 1, 1), "bbl"),
        ("a", "k", 4, "10.1234/y", "n/a", None, "P4", None, "mystery"), ("b", "k", 5, None, None, None, None, None, None), ("c", "k", 6, None, None, None, None, None, None), ("c", "k", 7, "-", "?", "-9", "[s.n.]", None, None), (None, "k", 8, None, None, None, None, None, None),
        ("d", "k", 10, "10.5555/a", "J", "1", "P", T(2020, 1, 1), "bbl"), ("d", "k", 9, "10.5555/a", "J", "1", "P", T(2020, 1, 1), "bbl"),
    ]
    c = spark.createDataFrame(rows, "arxiv_id string, cite_key string, citation_id long, doi string, journal string, pages string, publisher string, fetched_at timestamp, source_kind string").withColumn("trust_rank", F.lit(0)).withColumn("_rank", F.lit(0))
    s = spark.createDataFrame([("crossref", 1), ("bbl", 5)], "source_kind string, trust_rank int")
    got = {r.arxiv_id: r for r in survivor.survivors(c, s).collect()}
    assert set(got) == {"a", "c", "d"}
    assert (got["a"].doi_from, got["a"].journal_from, got["a"].pages_from, got["a"].publisher_from) == (2, 1, 1, 3) and got["a"].journal == "J1"
    assert (got["c"].doi_from, got["c"].journal_from, got["c"].pages_from, got["c"].publisher_from, got["c"].doi) == (0, 0, 0, 0, None)
    assert got["d"].doi_from == 9
    assert survivor.survivors(c.limit(0), s).count() == 0


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(30, 200))] for _ in range(40)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(r.randint(0, 3)):
            c = list(b)
            for _ in range(r.randint(0, max(1, len(c) // 12))):
                k = r.randrange(len(c))
                c[k : k + 1] = r.choice([[], [r.choice(vocabulary)], [c[k], r.choice(vocabulary)]])
            texts.append(" ".join(c))
    texts += ["", "", "one two", "One  two", "long " * 5000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "result_id long, content string").withColumn("keys", F.lit(0)).withColumn("same", F.lit(0))
    links, members = neardup.similar_texts(df, "result_id", "content", 3, 0.7)
    got = {(x.a, x.b) for x in neardup.row_pairs(links, members).collect()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)}

    want = set()
    for (i, s), (j, t) in itertools.combinations([(k, t) for k, t in enumerate(texts) if t is not None], 2):
        a, b = shingles(s), shingles(t)
        if s.lower().split() == t.lower().split() or (a and b and len(a & b) >= 0.7 * len(a | b)):
            want.add((i, j))
    assert got <= want and len(got) >= 0.98 * len(want)
    empty = neardup.similar_texts(df.limit(0), "result_id", "content")
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_lcs_and_names():
    r = random.Random(2)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for k, y in enumerate(b, 1):
                old, row[k] = row[k], old + 1 if x == y else max(row[k], row[k - 1])
        return 2 * row[-1] / (len(a) + len(b))

    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(2))
        assert abs(names.lcs_ratio(a, b) - slow(a, b)) < 1e-12
    assert names.read_person("von der Müller, Becky W.")[1] == names.read_person("Rebecca VON DER MULLER†")[1]
    assert names.read_person("et al.") is None and names.read_organisation(" , ") is None
    orgs = ["Univ. of Foobar", "Department of Physics, University of Foobar", "Universität Foobar", "The University of Foobar, Norvia", "UNIVERSITY OF FOOBAR."]
    assert len({names.read_organisation(o)[1] for o in orgs}) == 1
    assert names.read_organisation("FIT Foobar")[1] == names.read_organisation("Foobar Institute of Technology")[1] != names.read_organisation("University of Foobar")[1]


def test_name_links(spark):
    people = ["Rebecca W. Kinikepur", "Kinikepur, Rebecca W.", "Becky Kinikepur", "R. Kinikepur", "Rebecna Kinikepur", "KINIKEPUR Rebecca", "Priya Kinikepur", "Jane Q. Foolan", "Jane R. Foolan", "Zora Zanzibart", "Zack Zanzibart", "Z. Zanzibart", "", None, "et al."]
    rows = [("person", p, 5 if i < 3 else 1) for i, p in enumerate(people)] + [("organisation", o, 1) for o in ("Saligizart National Laboratory", "Natl Lab Saligizart", "Saligioart National Laboratory", "University of Saligizart")]
    out = names.link_names(spark.createDataFrame(rows, "name_kind string, name string, n int"))
    by = {r.name: r.entity for r in out.collect()}
    assert len({by[p] for p in people[:6]}) == 1 and by["Priya Kinikepur"] != by[people[0]]
    assert by["Jane Q. Foolan"] != by["Jane R. Foolan"] and len({by[p] for p in people[9:12]}) == 3
    assert by["Natl Lab Saligizart"] == by["Saligizart National Laboratory"] == by["Saligioart National Laboratory"] != by["University of Saligizart"]
    assert names.link_names(spark.createDataFrame([], "name_kind string, name string, n int")).count() == 0


def test_short_names_meet(spark):
    people = ["J. Li", "Jane Li", "J. Wu", "J. Mbrin", "Jane Mbin"]
    out = {r.name: r.entity for r in names.link_names(spark.createDataFrame([("person", p, 1) for p in people], "name_kind string, name string, n int")).collect()}
    assert out["J. Li"] == out["Jane Li"] != out["J. Wu"]
    edge = lambda t: set(names._edge_keys(t))
    assert edge("li") and edge("mbrin") & edge("mbin") and edge("haon") & edge("hamn") and edge("abcdef") & edge("abxdef")


def test_common_suffixes_lose_nothing(spark, monkeypatch):
    r = random.Random(5)
    given, family = ["anna", "hanna", "joanna", "jana", "joan", "sanna"], ["ruson", "larson", "parson", "karson", "olson", "nilson"]
    people = {f"{g.title()} {f.title()}" for g in given for f in family} | {f"{g[0].upper()}. {f.title()}" for g in given for f in family[:3]} | {"Jnaa Ruson", "Anna Lrason", "Hanna Nilsonn"}
    orgs = [f"University of {f}{g}" for g in ("ville", "vile", "burg") for f in ("Nor", "Sor", "Tor")]
    rows = [("person", p, r.randint(1, 9)) for p in sorted(people)] + [("organisation", o, r.randint(1, 9)) for o in orgs]
    df = spark.createDataFrame(rows, "name_kind string, name string, n int")
    got = lambda: {(x.name_kind, x.name): x.entity for x in names.link_names(df).collect()}
    want = got()
    monkeypatch.setattr(names, "COMMON", 1)
    assert got() == want


def test_long_chains_of_spellings_end_in_one(spark):
    # each spelling is one edit from the next and rarer, over more steps than a fixed number of rounds would follow
    chain = ["Zed " + "abcdefghijklmnopqrstuvwx"[:8] + "q" * k for k in range(40)]
    out = {x.name: x.entity for x in names.link_names(spark.createDataFrame([("person", c, 100 - k) for k, c in enumerate(chain)], "name_kind string, name string, n int")).collect()}
    assert len(set(out.values())) == 1


def test_titles():
    assert E.same_title("a late theory of things", "late theory of things") and E.same_title("fast search over graphs", "fast saerch over graphs")
    assert not E.same_title("fast search over graphs", "fast search over graphs ii") and not E.same_title("a study of graphs revisited", "a study of graphs")
    assert E.title_words("{F}ast &amp; Slow: Towa-\nrds <b>X</b>") == "fast and slow towards x"
    assert "fast search over graphs" in E.titles_in("Doe, J. and Roe, K.. Fast Search over Graphs. Journal of X, 5(1):1-2, 2020.")


def test_match_rules(spark):
    works = spark.createDataFrame([
        (1, "Fast Search over Large Graphs", ["Doe, Jane", "Roe, K."], 2020), (2, "Fast Search over Large Graphs Revisited", ["Doe, Jane"], 2023), (3, "Editorial", ["Poe, Max"], 2010), (4, "Editorial", ["Loe, Ann"], 2010), (5, None, None, None), (6, "A Rather Long and Telling Title of Work", ["Woodstock, B."], None),
    ], "work_id long, title string, authors array<string>, pub_year int")
    cites = [
        (1, "a", "k1", "fast search over large graphs", "2021", ["Jane Doe"], None), (2, "a", "k2", None, None, [], "[3] J. Doe: {F}ast Search over Large Graphs. In: X, 2020"), (3, "a", "k3", "Fast Search over Lrage Graphs", "2020", ["K. Roe"], None), (4, "a", "k4", "Fast Search over Large Graphs: Part II", "2020", ["Jane Doe"], None),
        (5, "a", "k5", "Editorial", "2010", ["Ann Loe"], None), (6, "a", "k6", "Editorial", "2010", [], None), (7, "a", "k7", "A Rather Long and Telling Title of W...", "2020", ["B. Woodstock"], None), (8, "a", "k1", None, None, None, None), (9, None, None, None, None, None, None), (10, "a", "k8", "Fast Search over Large Graphs", "2020", ["Somebody Else"], None),
        (11, "a", "k9", "A Rather Long and Telling Title of Work", "1999", ["Bo Wodstock"], None), (12, "a", "k10", "Fast Search over Large Graphs Revisited", "(2023)", ["Jane Doe"], None),
    ]
    c = spark.createDataFrame(cites, "citation_id long, arxiv_id string, cite_key string, title string, pub_year string, authors array<string>, raw_text string").withColumn("work", F.lit(9)).withColumn("id", F.lit(9))
    m = E.match(c, works)
    got = {r.id: r.work for r in m.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 4, 7: 6, 8: 1, 11: 6, 12: 2}
    assert E.rule_confidence(m).filter("confidence <= 1 and confidence > 0").count() >= 1
    assert E.match(c.limit(0), works).count() == 0 and E.match(c, works.limit(0)).count() == 0


def test_match_misspelled_in_any_segment(spark):
    works = spark.createDataFrame([(1, "Robust Hypergraph Methods for Active Lattice Models", ["Tehagus, Dmitri", "Dobez, J."], 2017), (2, "Quiet Turbine Glaciers", ["Poe, Max"], 2010)], "work_id long, title string, authors array<string>, pub_year int")
    cites = [
        # the longest segment is the title with venue, volume and year in front; the quoted one with the names after it; a title of another kind beside the line
        (1, "a", "k1", None, "2017", None, "D. Tehagus and J. Dobez, Letters in Orbital Dynamics 16, 90 (2017): Robust Hypergraph Methods for Active Latice Models"),
        (2, "a", "k2", "Letters in Orbital Dynamics", "2017", None, "D. Tehagus and J. Dobez (2017). Robust Hypergraph Methods for Active Lattcie Models. Letters in Orbital Dynamics 16, 90."),
        (3, "a", "k3", None, "2017", None, "D. Tehagus, Letters in Orbital Dynamics 16, 90 (2017): Robust Hypergraph Methods for Active Latice Models Revisited"),
        # an item's other record, the title misspelled twice after a longer segment
        (4, "a", "k4", "Quiet Turbine Glaciers", "2010", ["Max Poe"], None), (5, "a", "k4", None, "2010", None, "M. Poe, Transactions on Computational Polymers and Orbital Dynamics 16, 90 (2010): Qiet Turbine Galciers"),
    ]
    c = spark.createDataFrame(cites, "citation_id long, arxiv_id string, cite_key string, title string, pub_year string, authors array<string>, raw_text string")
    assert {r.id: (r.work, r.rule) for r in E.match(c, works).collect()} == {1: (1, 8), 2: (1, 8), 4: (2, 1), 5: (2, 9)}


def test_match_misspelled_author_with_reference_line(spark):
    works = spark.createDataFrame([(1, "A Rather Telling Title", ["Woodstock, B."], 2020)], "work_id long, title string, authors array<string>, pub_year int")
    cites = [
        (1, "a", "k1", "A Rather Telling Title", "2020", ["Bo Wodstock"], "B. Wodstock (2020). A Rather Telling Title. Ann. X 1, 2."), (2, "a", "k2", "A Rather Telling Title", "2020", None, "B. Woodstokc (2020). A Rather Telling Title. Ann. X 1, 2."),
        (3, "a", "k3", "A Rather Telling Title", "2020", ["Ann Else"], "A. Else, B. Wodstock (2020). A Rather Telling Title. Ann. X 1, 2."), (4, "a", "k4", "A Rather Telling Title", "2020", ["Ann Else"], "A. Else (2020). A Rather Telling Title. Ann. X 1, 2."),
    ]
    c = spark.createDataFrame(cites, "citation_id long, arxiv_id string, cite_key string, title string, pub_year string, authors array<string>, raw_text string")
    assert {r.id: r.rule for r in E.match(c, works).collect()} == {1: 7, 2: 7, 3: 7}


def test_match_short_beginnings_and_short_names(spark):
    works = spark.createDataFrame([(1, "Quiet Lakes of the North", ["Li, Wei"], 2020), (2, "Deep Roots and Other Long Stories of a Rather Long Winter Night", ["Wu, An"], 2019)], "work_id long, title string, authors array<string>, pub_year int")
    cites = [
        (1, "a", "k1", "Quiet Lakes...", "2020", ["W. Li"], None), (2, "a", "k2", "Quiet Lakes...", None, ["W. Li"], None), (3, "a", "k3", None, None, None, "W. Li. Quiet Lakes of the North. J. X 5, 2020."),
        (4, "a", "k4", None, None, None, "A. Wu. " + "Xyz " * 200 + ": Deep Roots and Other Long Stories of a Rat... J. X, 2019."), (5, "a", "k5", None, None, None, "See \u2026 " + "a. " * 3000 + "..."),
    ]
    c = spark.createDataFrame(cites, "citation_id long, arxiv_id string, cite_key string, title string, pub_year string, authors array<string>, raw_text string")
    assert {r.id: (r.work, r.rule) for r in E.match(c, works).collect()} == {1: (1, 5), 3: (1, 3), 4: (2, 5)}


def test_match_moves_records_a_few_times_only(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvz") for _ in range(r.randint(5, 9)))
    works = [(k, " ".join(word() for _ in range(7)).title(), [f"{word().title()}, {word().title()}" for _ in range(3)], 2000 + k % 20) for k in range(300)]
    cites = []
    for i in range(6000):
        _, title, authors, year = works[i % 300] if i % 4 else (0, " ".join(word() for _ in range(7)).title(), [f"{word().title()}, {word().title()}" for _ in range(3)], 2005)
        # a title, a line, or both; every fifth one is misspelled
        title = title[:20] + title[21:] if i % 5 == 0 else title
        line = f"{', '.join(a.split(',')[0] + ' ' + a.split(', ')[1][0] + '.' for a in authors)} ({year}). {title}. Journal of {word().title()} {i % 60}, {i}-{i + 9}."
        cites.append((i, f"p{i // 30}", f"k{i % 15}", title if i % 3 else None, str(year), authors if i % 3 else None, line if i % 3 != 1 else None))
    spark.createDataFrame(works, "work_id long, title string, authors array<string>, pub_year int").write.parquet(f"{tmp_path}/works.parquet")
    spark.createDataFrame(cites, "citation_id long, arxiv_id string, cite_key string, title string, pub_year string, authors array<string>, raw_text string").write.parquet(f"{tmp_path}/citations.parquet")
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if f.is_file())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()
    gw = spark.sparkContext._gateway

    def stages():
        bus.waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, gw.new_array(gw.jvm.double, 0), None)
        return {x.stageId(): x.shuffleWriteBytes() for x in (found.apply(k) for k in range(found.size()))}

    try:
        old = stages()
        m = E.found(spark, str(tmp_path)).collect()
        moved = sum(v for k, v in stages().items() if k not in old)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {x.citation_id: x.work_id for x in m} == {i: i % 300 for i in range(6000) if i % 4} and len(m) == 4500
    assert moved < 6.5 * size, moved / size


def test_match_repeated_and_bare_rows(spark):
    works = spark.createDataFrame([(1, "Fast Search over Large Graphs", ["Doe, Jane"], 2020), (2, "Editorial", ["Poe, Max"], 2010), (3, "Editorial", ["Loe, Ann"], 2010)], "work_id long, title string, authors array<string>, pub_year int")
    cites = [
        # a repeated row is one record; records without a title go each their way, and never meet a work by that
        *[(1, "a", "k1", "Fast Search over Large Graphs", "2020", ["J. Doe"], None)] * 2, (2, "a", "k2", "Editorial", "2010", [None, "", "Ann Loe"], None), *[(3, "a", "k1", None, None, None, None)] * 2, (4, "a", None, None, None, None, None), (5, None, "k1", None, None, None, None),
        *[(100 + k, "b", f"x{k}", None, None, None, None) for k in range(20)],
    ]
    c = spark.createDataFrame(cites, "citation_id long, arxiv_id string, cite_key string, title string, pub_year string, authors array<string>, raw_text string")
    assert sorted((r.id, r.work, r.rule) for r in E.match(c, works).collect()) == [(1, 1, 1), (2, 3, 1), (3, 1, 9)]


def test_names_in_reference_lines():
    assert E.names_in("O’Neill-Smith, J. & d'Arc, Li; ČAPEK ØRSTED (Иванов 2x) xy") == {"oneillsmith", "darc", "li", "capek", "orsted"}
    assert E.title_words("Über β-Sheets & \\emph{More} <i>X²</i>…") == "uber sheets and more x2"


def test_a_wrong_rule_has_less_confidence(spark):
    # rule 8 is wrong on every other item; an item's records may disagree; a lone record labels nothing, itself included
    rows = [x for i in range(200) for x in ((4 * i, i, i, 1), (4 * i + 1, i, i, 3), (4 * i + 2, i, i + i % 2, 8))] + [(9000 + k, 500 + k, k, 1) for k in range(50)] + [(9100, 900, 1, 1), (9101, 900, 2, 1), (9200, 901, 1, 9)]
    got = {r.rule: r for r in E.rule_confidence(spark.createDataFrame(rows, "id long, item long, work long, rule int")).collect()}
    assert got[3].labelled == 200 and got[3].right == 200 and got[8].right == 100 and got[8].confidence < 0.6 < got[3].confidence
    assert (got[1].labelled, got[1].right) == (2, 0)
    assert got[9].right < got[9].labelled


def test_targets_beyond_the_bound_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "MAX_TARGETS", 2)
    monkeypatch.setattr(packing, "MAX_KINDS", 2)
    with pytest.raises(ValueError):
        mixing.mix(docs, spark.createDataFrame([(f"s{k}", 0.3, 1) for k in range(3)], "source string, target_share double, max_repeats int"))
    with pytest.raises(ValueError):
        packing.pack(docs, spark.createDataFrame([(f"k{k}", 4) for k in range(3)], "container_kind string, capacity_tokens int"))


def test_the_seed_alone_decides():
    counts = {3: 4, 11: 3, 13: 1, 7: 2, 5: 5}
    turned = dict(reversed(counts.items()))
    assert all(mixing.knapsack(counts, t, s) == mixing.knapsack(turned, t, s) for t in range(60) for s in range(3))


def test_plan_slots():
    r = random.Random(3)
    for _ in range(40):
        cap = r.randint(5, 60)
        counts = {r.randint(1, cap): r.randint(1, 40) for _ in range(r.randint(1, 12))}
        plan, used = packing.plan_slots(counts, cap)
        load = [0] * used
        for length, n in counts.items():
            runs, firsts = plan[length]
            for rank in range(n):
                k = max(i for i, x in enumerate(runs) if x <= rank)
                load[firsts[k] + rank - runs[k]] += length
        total = sum(x * n for x, n in counts.items())
        assert max(load) <= cap and sum(load) == total and used <= 1.5 * total / cap + 1


def test_pack(spark):
    docs = spark.createDataFrame([(1, "word " * 30), (2, "a"), (3, None), (4, ""), (5, "a"), (5, "a")], "doc_id long, text string").withColumn("tokens", F.lit(0)).withColumn("id", F.lit(0))
    limits = spark.createDataFrame([("s", 8), ("none", 0)], "container_kind string, capacity_tokens int")
    out = packing.pack(docs, limits).collect()
    n = {r.id: 0 for r in out}
    for x in out:
        n[x.id] += x.tokens
    assert set(n) == {1, 2, 5} and n[1] == len(tokens.encoding().encode_ordinary("word " * 30))
    assert [x.tokens for x in sorted(out, key=lambda x: x.piece) if x.id == 1][:-1] == [8] * ((n[1] - 1) // 8)
    assert packing.pack(docs.limit(0), limits).count() == 0 and packing.pack(docs, limits.limit(0)).count() == 0


def test_knapsack_is_exact():
    r = random.Random(6)
    for _ in range(60):
        counts = {r.randint(1, 30): r.randint(1, 4) for _ in range(r.randint(1, 6))}
        target = r.randint(0, 120)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        take = mixing.knapsack(counts, target)
        assert sum(x * n for x, n in take.items()) == max(s for s in sums if s <= target) and all(n <= counts[x] for x, n in take.items())
    big = {x: 1000 for x in range(50, 400)}
    assert sum(x * n for x, n in mixing.choose(big, 3_000_000).items()) == 3_000_000


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, "word " * r.randint(3, 60), "big") for i in range(300)] + [(1000 + i, "word " * r.randint(3, 60), "small") for i in range(20)] + [(2000, "x", None), (2001, "x", "other"), (2002, None, "big"), (2003, "", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    out = mixing.mix(docs, targets).collect()
    total = sum(x.tokens * x.repeats for x in out)
    share = sum(x.tokens * x.repeats for x in out if x.source == "big") / total
    assert abs(share - 0.7) < 0.001 and max(x.repeats for x in out if x.source == "small") <= 3 and max(x.repeats for x in out if x.source == "big") == 1
    assert mixing.mix(docs.limit(0), targets).count() == 0


def test_ranks_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(tokens, "RANK_ROWS", 7)
    d = spark.range(100).withColumn("g", (F.col("id") % 2).cast("int"))
    got = tokens.ranked(d, ["g"], F.xxhash64("id"), 50).collect()
    assert all(sorted(x["rank"] for x in got if x.g == g) == list(range(50)) for g in (0, 1))
