"""Variant spellings of names typed by people (problem 3): suffix blocking.

Every spelling is read into a node: for a person its name tokens in no order, with nicknames by their formal name; for an
institution its place and type. Tokens are indexed by their suffixes from about half their length on (and, read
backwards, their prefixes, so that an edit near the end is found too). A suffix alone is common; it is refined with
the first letter of the other name, or the type of institution, before it joins anything. A suffix that is still common
then is discarded, and its nodes meet by it only with the other names in full, or, where just an initial is known, with all
but one letter of the token: whatever one typing error apart shares the suffix shares one of these too, so nothing is lost.
Nodes that share a block are compared by longest-common-subsequence ratio. A rarer node points to the most frequent one it
resembles, pointers are followed to their end, and initials are attached where just one entity fits.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .arrow import map_columns

MIN_SUFFIX = 3
LCS_RATIO = 0.8
#: Nodes from which on a refined suffix is common, and is refined once more.
COMMON = 200

#: Nicknames and the formal names they stand for.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "al": "albert", "andy": "andrew", "nastya": "anastasia", "toni": "antonia", "tony": "anthony", "ben": "benjamin", "benny": "benjamin",
    "bill": "william", "will": "william", "billy": "william", "liam": "william", "bob": "robert", "bobby": "robert", "rob": "robert", "becky": "rebecca", "bella": "isabella", "izzy": "isabella",
    "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lizzy": "elizabeth", "lisa": "elizabeth", "eliza": "elizabeth", "chris": "christopher", "kit": "christopher", "cathy": "catherine", "kate": "katharina", "kathy": "katharina", "katja": "katharina", "katya": "katharina",
    "dan": "daniel", "danny": "daniel", "dani": "daniela", "dave": "david", "dima": "dmitri", "mitya": "dmitri", "dora": "theodora", "thea": "theodora", "ed": "edgar", "eddie": "edgar", "ned": "edward", "fred": "frederik", "freddy": "frederik", "fritz": "friedrich",
    "paco": "francisco", "pancho": "francisco", "frank": "francis", "gabe": "gabriel", "greta": "margarethe", "grete": "margarethe", "gretchen": "margarethe", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "hans": "johannes", "jack": "john", "johnny": "john", "jim": "james", "jimmy": "james",
    "jo": "josephine", "josie": "josephine", "joe": "joseph", "jen": "jennifer", "jenny": "jennifer", "jon": "jonathan", "judy": "judith", "kostya": "konstantin", "kosta": "konstantin", "larry": "lawrence", "leo": "leonard", "len": "leonard", "lenny": "leonard", "lucy": "lucia", "lupe": "guadalupe",
    "matt": "matthew", "max": "maximilian", "mike": "michael", "mick": "michael", "mina": "wilhelmina", "minnie": "wilhelmina", "willa": "wilhelmina", "nick": "nicholas", "niko": "nikolaus", "klaus": "nikolaus", "nadya": "nadia", "pat": "patricia", "patty": "patricia", "pete": "peter", "phil": "philip", "pasha": "pavel",
    "rick": "richard", "dick": "richard", "ron": "ronald", "rosie": "rosalind", "roz": "rosalind", "ros": "rosalind", "sam": "samuel", "sammy": "samuel", "sandy": "alexandra", "sasha": "alexander", "sepp": "josef", "steve": "steven", "sue": "susan", "susie": "susan", "ted": "theodore", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tommy": "thomas",
    "val": "valentin", "vicky": "victoria", "tori": "victoria", "vic": "victor", "vince": "vincent", "zack": "zachary", "zach": "zachary", "zosia": "zofia", "quin": "quentin", "jule": "julia", "gus": "august", "hank": "henry", "harry": "henry", "kim": "kimberly", "manu": "manuel", "pepe": "jose", "nacho": "ignacio", "lola": "dolores",
}
#: Particles that belong to the family name after them.
PARTICLES = frozenset("van von der den de del della di da das dos do la le ter ten zu zur vom af av bin ibn al el du des".split())
_EXTRA = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ı": "i", "þ": "th", "ð": "d"}
_SPECIAL = re.compile("[" + "".join(_EXTRA) + "]")
_ACCENTS = re.compile("[\u0300-\u036f]")
_NOT_PEOPLE = re.compile(r"^(?:et\.? al\.?|others|and others|anonymous|anon\.?|unknown|n/?a|none|null|et alii|collaboration|[^a-z]*)$")
_SUFFIXES = frozenset("jr sr ii iii iv phd md prof dr".split())


def fold(s: str) -> str:
    """Lower case without accents."""
    if s.isascii():
        return s.lower()
    return _ACCENTS.sub("", unicodedata.normalize("NFKD", _SPECIAL.sub(lambda m: _EXTRA[m[0]], s))).lower()


def read_person(name: str) -> tuple[str, str, list[str], str] | None:
    """(form, key, long tokens, initials): form F with two long tokens at least, I with one and initials, S with one alone."""
    text = fold(name)
    if _NOT_PEOPLE.match(text.strip()):
        return None
    # capitals alone after or before a name in mixed case are initials: "Duvonosan NK"
    for m in re.finditer(r"(?<![\w.])([A-Z]{2,3})(?![\w.])", name):
        if m[1].lower() not in PARTICLES and re.search(r"[a-z]", name) and len(re.findall(r"\w{2,}", name)) > 1:
            text = text.replace(m[1].lower(), " ".join(m[1].lower()), 1) if re.search(rf"(?<!\w){m[1].lower()}(?!\w)", text) else text
    text = re.sub(r"[’'‐-]", "", text)
    words = [w for w in re.split(r"[^a-z]+", text) if w and w not in _SUFFIXES]
    longs, initials, held = [], [], ""
    for w in words:
        if w in PARTICLES and len(w) > 1:
            held += w
        elif len(w) == 1:
            initials.append(w)
        else:
            longs.append(held + w if held else NICKNAMES.get(w, w))
            held = ""
    if held:
        longs.append(held) if not longs else longs.__setitem__(-1, held + longs[-1])
    if not longs:
        return None
    longs.sort()
    if len(longs) > 1:
        return "F", " ".join(longs), longs, "".join(initials)
    return ("I" if initials else "S"), f"{longs[0]} {initials[0] if initials else ''}".strip(), longs, "".join(initials)


#: Words for the type of an institution, in the order in which they decide.
_TYPES = [
    ("academy", re.compile(r"\bacad(?:em\w*)?\b|\bakadem\w*")), ("technology", re.compile(r"\binst\w* (?:of |for |f[uü]r )?tech\w*|\btech(?:nol\w*)?\b|\btechnische\w*|\btechn\w+ univ\w*|\buniv\w* of tech\w*")),
    ("polytechnic", re.compile(r"\b(?:ecole )?polytech\w*|\bpolitec\w*")), ("laboratory", re.compile(r"\blab(?:s|or\w*)?\b")), ("hospital", re.compile(r"\bhosp\w*|\bklinik\w*|\bclinic\w*")),
    ("university", re.compile(r"\buniv\w*|^u\b|\bu\.|\bhochschule\b")), ("college", re.compile(r"\bcoll(?:ege)?\b")), ("institute", re.compile(r"\binst\w*")), ("center", re.compile(r"\bcent(?:er|re|rum)\b|\bzentrum\b")), ("school", re.compile(r"\bsch(?:ool)?\b|\becole\b|\bschule\b")),
]
#: Initials by which a type shows in an acronym, after the initial of the place.
_ACRONYMS = {"as": "academy", "aos": "academy", "it": "technology", "iot": "technology", "nl": "laboratory", "pse": "polytechnic", "ps": "polytechnic", "p": "polytechnic", "u": "university", "tu": "technology"}
_UNIT = re.compile(r"\b(?:dep(?:artmen)?t\w*|fac(?:ulty|ultad|ulte)?|div(?:ision)?|chair|group|section|unit|lehrstuhl|fachbereich|abteilung|laboratoire de|school of (?!eng)|institute of (?!tech)|institute for (?!tech)|center for|centre for|graduate)\b")
_GENERIC = frozenset(
    "the of and for de del la le di du der die das fur university univ universitat universite universidad universita u academy acad academia academie sciences science sci institute institut inst technology technol technical "
    "tech technische polytechnic polytech polytechnique politecnico politecnica school sch engineering eng ecole national natl nat nationl laboratory laboratories lab labs labor research center centre college coll hospital hochschule".split()
)


def read_organisation(name: str) -> tuple[str, str, list[str], str] | None:
    """(form, key, [place], type) of the institution an affiliation names; units in it and places after it don't count."""
    text = re.sub(r"nat['’]l", "natl", fold(name))
    parts = [p.strip() for p in re.split(r"[,;/]|\s+[-–—]\s+", text) if p.strip()]
    if not parts:
        return None
    known = [p for p in parts if not _UNIT.search(p)] or parts
    typed = [p for p in known if any(look.search(p) for _, look in _TYPES)] or known[:1]
    main = typed[0]
    kind = next((k for k, look in _TYPES if look.search(main)), "")
    words = [w for w in re.split(r"[^a-z0-9]+", main) if w]
    place = [w for w in words if w not in _GENERIC]
    if not place:
        # "Institute of Technology, Place": the place is the next part
        after = [p for p in known[known.index(main) + 1 :]]
        place = [w for w in re.split(r"[^a-z0-9]+", after[0]) if w and w not in _GENERIC] if after else []
    if not kind and len(place) > 1:
        for w in place:
            rest = [x for x in place if x != w]
            if 2 <= len(w) <= 5 and w[0] == rest[0][0] and w[1:] in _ACRONYMS:
                kind, place = _ACRONYMS[w[1:]], rest
                break
            if 2 <= len(w) <= 5 and w[-1] == rest[0][0] and w[:-1] in _ACRONYMS:
                kind, place = _ACRONYMS[w[:-1]], rest
                break
    if not place:
        return None
    return "F", f"{' '.join(sorted(place))} {kind}".strip(), ["".join(sorted(place))], kind


def _edge_keys(token: str) -> list[str]:
    """Suffixes and prefixes that two tokens one edit apart have in common with each other."""
    n = len(token)
    if n < MIN_SUFFIX:
        return [f"={token}"]
    sizes = {max(MIN_SUFFIX, (n - 1) // 2), max(MIN_SUFFIX, n // 2)}
    # an edit in the middle of a short one leaves two letters at either end
    if n <= 6:
        sizes.add(2)
    return [k for s in sizes if s <= n for k in ("<" + token[:s], ">" + token[n - s :])]


def block_keys(kind: str, form: str, longs: list[str], rest: str) -> list[str]:
    """Blocks of a node: each suffix refined with another field of the name."""
    if kind == "organisation":
        return [f"o{rest}{k}" for k in _edge_keys(longs[0])]
    if form == "S":
        return []
    if form == "I":
        return [f"p{rest[0]}{k}" for k in _edge_keys(longs[0])]
    out = []
    for i, t in enumerate(longs):
        for o in longs[:i] + longs[i + 1 :]:
            out += [f"p{o[0]}{k}" for k in _edge_keys(t)]
            # the same family name, another first letter in the given name
            out.append(f"={t}>{o[-max(2, len(o) // 2) :]}")
    return out


def finer_keys(key: str, kind: str, form: str, longs: list[str], rest: str) -> set[str]:
    """What a common block of a node is refined to: two nodes that differ in the token whose suffix it is, by one typing error, share one of these."""
    if kind == "organisation":
        return {f"O{rest}|{d}" for d in _but_one(longs[0])}
    if form == "I":
        return {f"I{rest[0]}|{d}" for d in _but_one(longs[0])}
    out = set()
    for i, t in enumerate(longs):
        others = longs[:i] + longs[i + 1 :]
        for o in others:
            if key in (f"p{o[0]}{k}" for k in _edge_keys(t)):
                # full names that differ in this token, and those that have only an initial of the other
                out.add(f"{key}|{' '.join(others)}")
                out |= {f"I{o[0]}|{d}" for d in _but_one(t)}
        # the same family name and another first letter: all tokens but the other one in full
        for j, o in enumerate(longs):
            if j != i and key == f"={t}>{o[-max(2, len(o) // 2) :]}":
                out.add(f"{key}|{' '.join(longs[:j] + longs[j + 1 :])}")
    return out


def _but_one(token: str) -> set[str]:
    """A token, and it without one of its letters: tokens one typing error apart share one of these."""
    return {token, *(token[:k] + token[k + 1 :] for k in range(len(token)))}


def lcs_ratio(a: str, b: str) -> float:
    """2 · longest common subsequence / total length, with one bit per character of `a`."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _near(a: str, b: str) -> bool:
    """One typing error apart: an edit, a doubled or left-out letter, or two letters swapped."""
    if abs(len(a) - len(b)) > 1 or lcs_ratio(a, b) < LCS_RATIO:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[2:] == y[2:] and x[:2] == y[1::-1])


def _both_known(x: int, y: int) -> bool:
    """Two names that many people have, each in its own right, such as Hanna and Sanna."""
    return min(x, y) >= 3 and min(x, y) > 0.1 * max(x, y)


def alike(form_a: str, longs_a: list[str], rest_a: str, form_b: str, longs_b: list[str], rest_b: str, seen_a: list[int] = (), seen_b: list[int] = ()) -> int:
    """0 if two nodes differ, 1 if they are the same up to a typing error, 2 if they agree but for initials.

    seen_a and seen_b tell in how many nodes each long token occurs.
    """
    if form_a == "F" and form_b == "F":
        if len(longs_a) != len(longs_b) or rest_a != rest_b:
            return 0
        left_a = [t for t in longs_a if t not in longs_b]
        left_b = [t for t in longs_b if t not in longs_a]
        if not (len(left_a) == len(left_b) == 1 and _near(left_a[0], left_b[0])):
            return 0
        return int(not (seen_a and _both_known(seen_a[longs_a.index(left_a[0])], seen_b[longs_b.index(left_b[0])])))
    if form_a == "I" and form_b == "I":
        return int(rest_a == rest_b and _near(longs_a[0], longs_b[0]))
    if form_a == "I":
        return alike(form_b, longs_b, rest_b, form_a, longs_a, rest_a)
    best = 0
    for i, t in enumerate(longs_a):
        others = longs_a[:i] + longs_a[i + 1 :]
        if any(o[0] == rest_b[0] for o in others):
            if t == longs_b[0]:
                return 2
            if _near(t, longs_b[0]):
                best = 1
    return best


def _read():
    def f(kinds: list, names: list, counts: list) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("kind", "name", "n", "form", "node", "longs", "rest", "middle")}
        for kind, name, n in zip(kinds, names, counts):
            got = read_person(name) if kind == "person" else read_organisation(name)
            if got:
                form, key, longs, rest = got
                middle = "" if kind == "organisation" else rest if form == "F" else rest[1:]
                for k, v in zip(out, (kind, name, n, form, key, longs, (rest if kind == "organisation" else "" if form == "F" else rest[:1]), middle[:1])):
                    out[k].append(v)
        return out

    return f


def _blocks():
    def f(kinds: list, nodes: list, forms: list, longs: list, rests: list) -> dict[str, list]:
        out: dict[str, list] = {"kind": [], "node": [], "k": []}
        for kind, node, form, ls, r in zip(kinds, nodes, forms, longs, rests):
            for k in set(block_keys(kind, form, ls, r)):
                out["kind"].append(kind), out["node"].append(node), out["k"].append(k)
        return out

    return f


def _finer():
    def f(kinds: list, keys: list, nodes: list, forms: list, longs: list, rests: list) -> dict[str, list]:
        out: dict[str, list] = {"kind": [], "node": [], "k": []}
        for kind, key, node, form, ls, r in zip(kinds, keys, nodes, forms, longs, rests):
            for k in finer_keys(key, kind, form, ls, r):
                out["kind"].append(kind), out["node"].append(node), out["k"].append(k)
        return out

    return f


def _compare():
    def f(kinds, a, b, na, nb, fa, fb, la, lb, ra, rb, sa, sb) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("kind", "a", "b", "na", "nb", "fa", "fb", "how")}
        for row in zip(kinds, a, b, na, nb, fa, fb, la, lb, ra, rb, sa, sb):
            kind, x, y, nx, ny, fx, fy, lx, ly, rx, ry, sx, sy = row
            if how := alike(fx, lx, rx, fy, ly, ry, sx, sy):
                for k, v in zip(out, (kind, x, y, nx, ny, fx, fy, how)):
                    out[k].append(v)
        return out

    return f


def link_names(names: DataFrame) -> DataFrame:
    """(name_kind, name, entity) of every spelling that names something.

    `names` has (name_kind, name, n): `person` or `organisation`, a string and how often it occurs; rows of the same
    string are added up. Null and blank names and stand-ins such as "et al." name nothing. Initials with one family name belong
    to the entity they fit if it is the only one, else to an entity of their own. Names with different middle initials
    are different people; one without a middle initial goes with them if they have just one.
    """
    distinct = names.filter(F.trim("name") != "").groupBy("name_kind", "name").agg(F.sum("n").cast("long").alias("n"))
    read = cut_lineage(map_columns(distinct.select("name_kind", "name", "n"), _read, "kind string, name string, n long, form string, node string, longs array<string>, rest string, middle string"))
    nodes = read.groupBy("kind", "node").agg(
        F.sum("n").alias("n"), F.first("form").alias("form"), F.first("longs").alias("longs"), F.first("rest").alias("rest"),
        F.min(F.when(F.col("middle") != "", F.col("middle"))).alias("mid"), F.countDistinct(F.when(F.col("middle") != "", F.col("middle"))).alias("mids"),
    )
    token = nodes.select("kind", "node", F.posexplode("longs").alias("i", "t"))
    seen = token.join(token.groupBy("kind", "t").agg(F.count("*").alias("s")), ["kind", "t"]).groupBy("kind", "node").agg(F.array_sort(F.collect_list(F.struct("i", "s")))["s"].alias("seen"))
    nodes = cut_lineage(nodes.join(seen, ["kind", "node"]))
    blocks = map_columns(nodes.select("kind", "node", "form", "longs", "rest"), _blocks, "kind string, node string, k string")
    # few suffixes are common: at most one in COMMON rows
    blocks = cut_lineage(blocks)
    common = blocks.groupBy("kind", "k").agg(F.count("*").alias("c")).filter(F.col("c") > COMMON).select("kind", "k")
    again = blocks.join(common, ["kind", "k"], "left_semi").join(nodes.select("kind", "node", "form", "longs", "rest"), ["kind", "node"]).select("kind", "k", "node", "form", "longs", "rest")
    finer = map_columns(again, _finer, "kind string, node string, k string").distinct()
    blocks = blocks.join(common, ["kind", "k"], "left_anti").unionByName(finer)
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, (F.col("x.kind") == F.col("y.kind")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.node") < F.col("y.node"))).select("x.kind", F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    side = lambda s: nodes.select("kind", F.col("node").alias(s), *[F.col(c).alias(f"{c[0]}{s}") for c in ("n", "form", "longs", "rest", "seen")])
    both = pairs.join(side("a"), ["kind", "a"]).join(side("b"), ["kind", "b"]).select("kind", "a", "b", "na", "nb", "fa", "fb", "la", "lb", "ra", "rb", "sa", "sb")
    edges = cut_lineage(map_columns(both, _compare, "kind string, a string, b string, na long, nb long, fa string, fb string, how int"))

    # each node of the same form points to the most frequent one it resembles
    same = edges.filter(F.col("fa") == F.col("fb"))
    ways = same.select("kind", F.col("a").alias("node"), F.col("na").alias("n"), F.struct(F.col("nb").alias("n"), F.col("b").alias("to")).alias("t")).unionByName(
        same.select("kind", F.col("b").alias("node"), F.col("nb").alias("n"), F.struct(F.col("na").alias("n"), F.col("a").alias("to")).alias("t"))
    )
    up = ways.filter(F.struct("n", "node") < F.struct("t.n", "t.to")).groupBy("kind", "node").agg(F.max("t")["to"].alias("to"))
    # each round doubles the steps that pointers have been followed, until none goes on
    root, moves = up, True
    while moves:
        nxt = root.select("kind", F.col("node").alias("to"), F.col("to").alias("further"))
        stored = cut_lineage(root.join(nxt, ["kind", "to"], "left").select("kind", "node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        root, moves = stored.drop("moved"), not stored.filter("moved").isEmpty()

    full = nodes.join(root, ["kind", "node"], "left").withColumn("root", F.coalesce("to", "node")).select("kind", "node", "form", "root", "mid", "mids")
    # initials: the entities they fit, by the exact family name first
    ends = edges.filter(F.col("fa") != F.col("fb")).select(
        "kind", "how", F.when(F.col("fa") == "I", F.col("a")).otherwise(F.col("b")).alias("node"), F.when(F.col("fa") == "I", F.col("b")).otherwise(F.col("a")).alias("of"))
    fits = ends.join(full.select("kind", F.col("node").alias("of"), "root"), ["kind", "of"])
    one = fits.groupBy("kind", "node").agg(F.collect_set(F.when(F.col("how") == 2, F.col("root"))).alias("exact"), F.collect_set("root").alias("near"))
    chosen = one.select("kind", "node", F.when(F.size("exact") == 1, F.get("exact", F.lit(0))).when((F.size("exact") == 0) & (F.size("near") == 1), F.get("near", F.lit(0))).alias("entity")).filter("entity is not null")
    # the root of initials may itself be attached
    entity = full.join(chosen.select("kind", F.col("node").alias("root"), F.col("entity").alias("e2")), ["kind", "root"], "left").join(chosen.select("kind", "node", "entity"), ["kind", "node"], "left")
    entity = entity.select("kind", "node", F.coalesce("entity", "e2", "root").alias("entity"))
    # middle initials part an entity that has several; initials with another middle one than the entity's aren't it
    spelled = read.join(entity, ["kind", "node"])
    given = F.when((F.col("middle") != "") & (F.col("form") == "F"), F.col("middle"))
    mids = spelled.groupBy("kind", "entity").agg(F.countDistinct(given).alias("k"), F.min(given).alias("m"))
    apart = (F.col("k") > 1) | ((F.col("k") == 1) & (F.col("form") == "I") & (F.col("middle") != "") & (F.col("middle") != F.col("m")))
    return spelled.join(mids, ["kind", "entity"]).select(
        F.col("kind").alias("name_kind"), "name", F.when(apart, F.concat_ws("|", "entity", "middle")).otherwise(F.col("entity")).alias("entity")
    )


def all_names(spark, sf_dir: str) -> DataFrame:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    parts = [
        read("papers").select(F.explode("authors").alias("name")), read("citations").select(F.explode("authors").alias("name")), read("paper_authors").select(F.col("author_name").alias("name")),
    ]
    people = parts[0].unionByName(parts[1]).unionByName(parts[2]).select(F.lit("person").alias("name_kind"), "name")
    orgs = read("paper_authors").select(F.lit("organisation").alias("name_kind"), F.explode("affiliations").alias("name"))
    return people.unionByName(orgs).withColumn("n", F.lit(1))


def entities(spark, sf_dir: str) -> DataFrame:
    """p3_entities: every spelling with the entity it names."""
    return link_names(all_names(spark, sf_dir))


def found(spark, sf_dir: str) -> DataFrame:
    """p3_found: pairs of spellings of one entity."""
    linked = link_names(all_names(spark, sf_dir))
    x, y = linked.alias("x"), linked.alias("y")
    return x.join(y, (F.col("x.name_kind") == F.col("y.name_kind")) & (F.col("x.entity") == F.col("y.entity")) & (F.col("x.name") < F.col("y.name"))).select(
        "x.name_kind", F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"))
