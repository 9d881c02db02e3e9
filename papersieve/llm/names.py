"""Variant spellings of people and organisations, by merge and re-match.

Every distinct spelling is parsed once into a profile (surname, given names, initials, middle initials; or place and
content initials of an organisation). Profiles that match are merged: their spellings and initials are united, the
richer profile enters blocking again, and this goes on until no merge occurs.

Blocks are of two kinds. In a wide one (a surname and an initial) only profiles without a given name look for partners,
as two full ones that match meet in a narrow one (surname and given name, either with a letter left out), too; so a wide
block costs in proportion to its size. In a narrow block a profile meets HUBS members before it in one turn, and after
that only members that merged since; every member has its turn.

Defined results: null and empty entries, "et al." and unknown authors are no names; repeated rows and repeated spellings
count once; a spelling with only one form has no pair; ties go to the smaller id.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papersieve.session import cut, read_table

HUBS = 64  # members of a narrow block that the others meet in one turn; the turns go on until all had theirs
WIDE = ("i", "m")  # kinds of blocks in which one side lacks a given name

# Nicknames and the names they stand for.
NICKNAMES = {
    "alex": "alexander", "ben": "benjamin", "bill": "william", "bob": "robert", "domi": "dominique", "fritz": "friedrich", "gabi": "gabriele",
    "harsh": "harshavardhan", "jon": "jonathan", "kate": "katherine", "kit": "christophe", "laxmi": "lakshmi", "liz": "elizabeth",
    "lottie": "charlotte", "mahi": "mahendra", "nate": "nathaniel", "paco": "francisco", "peggy": "margaret", "pepa": "josefina",
    "piu": "priyanka", "raju": "rajendra", "sue": "susannah", "venky": "venkatesh", "yogi": "yogendra", "dick": "richard", "jim": "james",
    "joe": "joseph", "kathy": "katherine", "maggie": "margaret", "mike": "michael", "nick": "nicholas", "pepe": "jose", "sam": "samuel",
    "steve": "stephen", "ted": "edward", "tom": "thomas", "tony": "anthony", "will": "william", "beth": "elizabeth", "dan": "daniel", "dora": "theodora", "ani": "aniruddha",
}
TITLES = frozenset("dr prof mr mrs ms shri smt er sir professor doctor".split())
ORG_WORDS = ("inst", "univ", "dep", "acad", "dir", "fed", "cent", "soc", "counc", "assoc", "found", "board", "lab", "school", "college", "trust", "bureau", "agency", "ministry", "corp")
LINKS = frozenset("of for the and &".split())
NOT_NAMES = frozenset(["", "unknown", "unknown authors", "unknown author", "et al.", "et al", "anonymous", "n/a", "-"])

FIELDS = ["kind", "surname", "given", "form", "initial", "middle", "two"]
PROFILE = "kind string, surname string, given string, form string, initial string, middle string, two boolean"


def _fold(s: str) -> str:
    d = unicodedata.normalize("NFKD", s)
    return unicodedata.normalize("NFC", "".join(c for c in d if not unicodedata.combining(c) or c > "ͯ")).casefold()


def _org(s: str) -> tuple | None:
    m = re.fullmatch(r"\s*([A-Z]{3,6})\s*\(\s*([^()]+?)\s*\)\s*", s)
    if m:
        place = _fold(m[2])
        return ("org", place, "", "acronym", _fold(m[1])[1:], "", False)
    words = [w for w in re.findall(r"[^\s,]+", s)]
    low = [_fold(w).strip(".") for w in words]
    if not any(w.startswith(ORG_WORDS) for w in low) or len(low) < 2:
        return None
    if "," in s:
        head, _, tail = s.rpartition(",")
        place = _fold(tail).strip(" .")
        content = [_fold(w).strip(".") for w in head.split()]
    else:
        low = [w for w in low if w != "the"] if low[0] == "the" else low
        at = next((i for i, w in enumerate(low) if w.startswith(ORG_WORDS)), 0)
        if at == 0:
            return ("org", "", " ".join(w for w in low if w not in LINKS), "full", "".join(w[0] for w in low if w and w not in LINKS), "", False)
        place, content = " ".join(low[:at]), low[at:]
    content = [w for w in content if w and w not in LINKS]
    return ("org", place, " ".join(content), "full", "".join(w[0] for w in content), "", False)


def parse(spelling: str) -> tuple | None:
    """(kind, surname, given, form, initial, middle, two): form is full, abbr or init; two marks a bare pair of names, of
    which either may be the surname. None if the entry is no name."""
    s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", spelling)).strip()
    if _fold(s) in NOT_NAMES or not any(c.isalpha() for c in s):
        return None
    org = _org(s)
    if org:
        return org
    words = s.split(" ")
    while len(words) > 1 and _fold(words[0]).strip(".") in TITLES:
        words = words[1:]
    s = " ".join(words)
    if "," in s:
        surname, rest = (x.strip() for x in s.split(",", 1))
        parts = re.findall(r"[^\s.]+\.?", rest)
    else:
        parts = re.findall(r"[^\s.]+\.?", s)
        if len(parts) == 1:
            return ("person", _fold(parts[0]).strip("."), "", "init", "", "", False)
        last = parts[-1]
        upper_all = s.isupper()
        if last.isalpha() and len(last) <= 3 and last.isupper() and not upper_all and len(parts[0]) > len(last) and not parts[0].endswith("."):
            # Surname first, initials without points behind.
            surname, parts = " ".join(parts[:-1]), [c + "." for c in last]
        else:
            surname, parts = last, parts[:-1]
    surname = _fold(surname).strip(" .")
    if not parts:
        return ("person", surname, "", "init", "", "", False)
    first, more = parts[0], parts[1:]
    given = _fold(first).strip(".")
    middle = "".join(_fold(p)[0] for p in more)
    if len(given) == 1:
        return ("person", surname, "", "init", given, middle[:1], False)
    if first.endswith("."):
        return ("person", surname, given, "abbr", given[0], middle[:1], False)
    two = "," not in s and not more
    return ("person", surname, given, "full", given[0], middle[:1], two)


def spellings(spark: SparkSession, data_dir: str) -> DataFrame:
    """Distinct entries of the three fields; aggregation before the shuffle keeps hot names cheap."""
    a = read_table(spark, data_dir, "bib_refs").select(F.explode(F.split("authors", r";| and | & ")).alias("name"))
    b = read_table(spark, data_dir, "sources").select(F.col("author").alias("name"))
    c = read_table(spark, data_dir, "documents").select(F.col("guide_name").alias("name"))
    blanks = "^[\\s\\u00a0]+|[\\s\\u00a0]+$"
    return a.distinct().unionByName(b.distinct()).unionByName(c.distinct()).select(F.regexp_replace("name", blanks, "").alias("name")).where("name <> ''").distinct()


def _parsed(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(n, *p) for n in pdf["name"] if (p := parse(n))]
            yield pd.DataFrame(rows, columns=["name", *FIELDS])

    return names.mapInPandas(run, f"name string, {PROFILE}")


def oriented(parsed: DataFrame) -> DataFrame:
    """Bare pairs turned round where the first word is a known surname and the last one is not."""
    person = F.col("kind") == "person"
    known = parsed.where(person & ~F.col("two") & (F.col("surname") != "")).groupBy("surname").agg(F.count("*").alias("n"))
    two = parsed.where("two")
    one = two.join(known.select(F.col("surname"), F.col("n").alias("n_last")), "surname", "left").join(known.select(F.col("surname").alias("given"), F.col("n").alias("n_first")), "given", "left")
    turn = F.coalesce("n_first", F.lit(0)) > F.coalesce("n_last", F.lit(0)) * 3
    fixed = one.select("name", "kind", F.when(turn, F.col("given")).otherwise(F.col("surname")).alias("surname"), F.when(turn, F.col("surname")).otherwise(F.col("given")).alias("given"), "form", "middle", "two").withColumn("initial", F.substring("given", 1, 1))
    return parsed.where("not two").select("name", *FIELDS).unionByName(fixed.select("name", *FIELDS))


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def formal(given: str) -> str:
    return NICKNAMES.get(given, given)


def match(p: dict, q: dict) -> bool:
    """Whether two profiles name one entity. A profile holds sets: surnames, givens, abbrs, initials, middles."""
    if p["kind"] != q["kind"]:
        return False
    same = bool(set(p["surnames"]) & set(q["surnames"]))
    close = same or any(near(a, b) for a in p["surnames"] for b in q["surnames"])
    if not close:
        return False
    if p["kind"] == "org":
        if not set(p["initials"]) & set(q["initials"]):
            return False
        if not p["givens"] or not q["givens"]:
            return True  # an acronym, of which the place and all initials fit
        return any(len(x) == len(y) and all(_part(u, v) for u, v in zip(x, y)) for x in (g.split() for g in p["givens"]) for y in (g.split() for g in q["givens"]))
    if p["middles"] and q["middles"] and not set(p["middles"]) & set(q["middles"]):
        return False
    gp, gq = {formal(g) for g in p["givens"]}, {formal(g) for g in q["givens"]}
    if gp and gq:
        if gp & gq:
            return True
        # One slip in all: a slip in the given name needs the same surname.
        return same and any(near(a, b) for a in gp for b in gq)
    starts = lambda abbrs, full: any(g.startswith(a) for a in abbrs for g in full)
    if p["abbrs"] and gq and starts(p["abbrs"], gq) or q["abbrs"] and gp and starts(q["abbrs"], gp):
        return True
    if p["abbrs"] and gq and not gp or q["abbrs"] and gp and not gq:
        return False
    if not set(p["initials"]) & set(q["initials"]):
        return False
    return same or bool(set(p["middles"]) & set(q["middles"])) or not (p["middles"] and q["middles"])


def _part(u: str, v: str) -> bool:
    """One word of an organisation, perhaps shortened: a beginning, or its consonants in order."""
    if u == v or u.startswith(v) or v.startswith(u) or near(u, v):
        return True
    short, long = sorted((u, v), key=len)
    it = iter(long)
    return short[:1] == long[:1] and len(short) <= 5 and all(c in it for c in short)


def _dels(s: str) -> set[str]:
    return {s} | ({s[:i] + s[i + 1 :] for i in range(len(s))} if len(s) >= 4 else set())


def block_keys(p: dict) -> set[str]:
    """Blocks of a profile: exact surname and initial, surname with one letter left out and given name or initials, and
    exact surname with a given name with one letter left out."""
    keys = set()
    if p["kind"] == "org":
        for s in p["surnames"]:
            for i in p["initials"]:
                keys |= {f"o|{d}|{i}" for d in _dels(s)}
        return keys
    inits = set(p["initials"]) | {formal(g)[:1] for g in p["givens"]}
    for s in p["surnames"]:
        keys |= {f"i|{s}|{i}" for i in inits}
        for d in _dels(s):
            keys |= {f"g|{d}|{formal(g)}" for g in p["givens"]}
            keys |= {f"m|{d}|{i}|{m}" for i in inits for m in (p["middles"] or [""])}
            keys |= {f"m|{d}|{i}|" for i in inits}
        for g in p["givens"]:
            keys |= {f"t|{s}|{d}" for x in {g, formal(g)} for d in _dels(x)}
    return keys


_SETS = ("surnames", "givens", "abbrs", "initials", "middles")
_SCHEMA = "kind string, surnames array<string>, givens array<string>, abbrs array<string>, initials array<string>, middles array<string>"


def _as_dict(row) -> dict:
    return {"kind": row["kind"]} | {k: [x for x in row[k] if x] for k in _SETS}


def _keyed(profiles: DataFrame) -> DataFrame:
    """(pid, support, whole, key, wide): the blocks of every profile; whole profiles have a given name or are organisations."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r["pid"], int(r["support"]), r["kind"] == "org" or any(r["givens"]), k, k[0] in WIDE) for r in pdf.to_dict("records") for k in block_keys(_as_dict(r))]
            yield pd.DataFrame(rows, columns=["pid", "support", "whole", "key", "wide"])

    return profiles.mapInPandas(run, "pid long, support long, whole boolean, key string, wide boolean")


def _ordered(pairs: DataFrame) -> DataFrame:
    """(pid, hub) of pairs (a, b) with their supports: the hub has the larger support, or the smaller id. The order is total,
    so links go one way only and can't close a ring."""
    up = (F.col("sa") > F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    return pairs.where("a <> b").select(F.when(up, F.col("b")).otherwise(F.col("a")).alias("pid"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("hub")).distinct()


def _wide_pairs(keyed: DataFrame) -> DataFrame:
    """Profiles without a given name and all others of their wide blocks."""
    w = keyed.where("wide")
    few = w.where("not whole").select("key", F.col("pid").alias("a"), F.col("support").alias("sa"))
    return few.join(w.select("key", F.col("pid").alias("b"), F.col("support").alias("sb")), "key").select("a", "sa", "b", "sb")


def _narrow_pairs(first: DataFrame, keyed: DataFrame) -> DataFrame:
    """The given members of narrow blocks and all others of these."""
    left = first.where("not wide").select("key", F.col("pid").alias("a"), F.col("support").alias("sa"))
    return left.join(keyed.where("not wide").select("key", F.col("pid").alias("b"), F.col("support").alias("sb")), "key").select("a", "sa", "b", "sb")


def _verified(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Candidate (pid, hub) pairs that match."""
    left = profiles.select("pid", F.struct("kind", *_SETS).alias("p"))
    right = profiles.select(F.col("pid").alias("hub"), F.struct("kind", *_SETS).alias("q"), F.col("support").alias("hub_support"), (F.size("givens") > 0).alias("hub_full"))
    both = pairs.join(left, "pid").join(right, "hub")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [match(_as_dict(p), _as_dict(q)) for p, q in zip(pdf["p"], pdf["q"])]
            out = pdf.loc[keep, ["pid", "hub", "hub_support", "hub_full"]].copy()
            out["full"] = [bool(len(p["givens"])) for p in pdf.loc[keep, "p"]]
            yield out

    return both.mapInPandas(run, "pid long, hub long, hub_support long, hub_full boolean, full boolean")


def _merged(profiles: DataFrame, root: DataFrame) -> DataFrame:
    """Profiles united by root: sets are unions, support is the number of spellings."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return profiles.join(root, "pid", "left").withColumn("pid", F.coalesce("root", "pid")).groupBy("pid").agg(F.first("kind").alias("kind"), *(flat(c) for c in _SETS), F.sum("support").alias("support"))


def resolve(names: DataFrame) -> DataFrame:
    """(name, entity): every spelling with the id of its entity, by merging and re-matching until nothing merges."""
    parts = ["kind", "surname", "given", "form", "initial", "middle"]
    atoms = cut(oriented(_parsed(names)))
    forms = cut(atoms.groupBy(*parts).agg(F.count("*").alias("support")).withColumn("pid", F.monotonically_increasing_id()))
    one = lambda c, when: F.array_compact(F.array(F.when(when & (F.col(c) != ""), F.col(c))))
    always = F.lit(True)
    profiles = cut(
        forms.select(
            "pid", "kind", one("surname", always).alias("surnames"), one("given", F.col("form") == "full").alias("givens"), one("given", F.col("form") == "abbr").alias("abbrs"),
            one("initial", always).alias("initials"), one("middle", always).alias("middles"), "support",
        )
    )
    owner = profiles.select("pid", F.col("pid").alias("entity"))
    start = cut(_keyed(profiles))
    # The place of a profile in its narrow blocks is settled at the start, so that each has one turn.
    narrow = start.where("not wide")
    crowded = narrow.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HUBS)
    largest = crowded.agg(F.max("n")).first()[0] or 1
    placed = narrow.join(crowded.select("key"), "key", "left_semi").withColumn("turn", ((F.row_number().over(W.partitionBy("key").orderBy(F.desc("support"), "pid")) - 1) / HUBS).cast("int"))
    placed = cut(placed.select("pid", "key", "turn").unionByName(narrow.join(crowded.select("key"), "key", "left_anti").select("pid", "key", F.lit(0).alias("turn"))))
    keyed, changed, turn = start, None, 0
    while True:
        if changed is None:
            first = keyed.join(placed.where(F.col("turn") == turn).select("pid", "key"), ["pid", "key"], "left_semi")
        else:
            first = keyed.join(changed, "pid", "left_semi")
        pairs = _ordered(_narrow_pairs(first, keyed).unionByName(_wide_pairs(keyed)))
        good = cut(_verified(pairs, profiles))
        # A profile of initials only that fits several full ones which don't fit each other stays alone.
        clash = good.where("not full and hub_full").groupBy("pid").agg(F.collect_set("hub").alias("hubs")).where("size(hubs) > 1")
        listed = clash.select("pid", F.explode("hubs").alias("h"))
        known = good.select(F.col("pid").alias("h"), F.col("hub").alias("h2"))
        linked = listed.join(listed.withColumnRenamed("h", "h2"), "pid").where("h <> h2").join(known, ["h", "h2"]).groupBy("pid").agg(F.count("*").alias("links"))
        unclear = clash.join(linked, "pid", "left").where(F.coalesce("links", F.lit(0)) < F.size("hubs") - 1).select("pid")
        best = cut(good.join(unclear, "pid", "left_anti").groupBy("pid").agg(F.max_by("hub", F.struct("hub_support", F.negative("hub"))).alias("root")))
        if best.isEmpty():
            # The next turn, once nothing merges any more.
            turn, changed = turn + 1, None
            if turn * HUBS >= largest:
                break
            continue
        # Follow the links to their ends by doubling.
        while True:
            up = best.select(F.col("pid").alias("root"), F.col("root").alias("next"))
            step = cut(best.join(up, "root", "left").select("pid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            best = step.select("pid", "root")
            if step.where("moved").isEmpty():
                break
        owner = cut(owner.join(best.select(F.col("pid").alias("entity"), "root"), "entity", "left").select("pid", F.coalesce("root", "entity").alias("entity")))
        profiles = cut(_merged(profiles, best))
        keyed = cut(_keyed(profiles))
        changed = cut(best.select(F.col("root").alias("pid")).distinct())
    return atoms.join(forms.drop("support"), parts).join(owner, "pid").select("name", "entity").distinct()


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    r = cut(resolve(spellings(spark, data_dir)))
    a, b = r.select("entity", F.col("name").alias("name_a")), r.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()


def p3_entities(spark: SparkSession, data_dir: str) -> DataFrame:
    """(name, entity, n_spellings): one row per spelling with its entity, named by the entity's smallest spelling."""
    r = cut(resolve(spellings(spark, data_dir)))
    e = r.groupBy("entity").agg(F.min("name").alias("entity_name"), F.count("*").alias("n_spellings"))
    return r.join(e, "entity").select("name", F.col("entity_name").alias("entity"), "n_spellings")
