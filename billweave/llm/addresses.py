"""Problem 4: postal addresses that denote the same building.

1. Every distinct address is read into street, street type as it is written, house number with
   its letter, postal code and the other parts (town, country); floor, unit, gate and recipient
   do not matter.
2. Towns are learned from all rows. A part named beside many different others is a wider region
   (a country), not a town. The town of a postal code is that of the prefix with the surest
   majority, of any length. A spelling goes by the nearest town that codes confirm, else by its
   most frequent near spelling; a missing town is taken from the code.
3. Distinct forms are banded by MinHash over q-gram shingles of the street together with the
   token shingle (number, town). Candidates are accepted by a threshold on the cost of an
   affine-gap alignment of their tokens; abbreviations cost nothing, another number or another
   type costs more than the threshold.
4. Verified forms are clustered around their most frequent spelling.

Defined results: null, empty or unreadable arrays and arrays without a street and number are
in no pair; repeated rows share a form and are paired; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.matching import (
    band_keys,
    candidate_pairs,
    candidates_between,
    digest,
    edit_distance,
    edit_similarities,
    may_be_similar,
    pairs_within,
    star_clusters,
    tune_bands,
)
from billweave.runtime import materialize

# Street types with the ways they are written.
STREET_TYPES = {
    "strasse": ("straße", "strasse", "str"),
    "gasse": ("gasse", "gaße", "g"),
    "weg": ("weg", "wg"),
    "platz": ("platz", "pl"),
    "allee": ("allee", "all"),
    "ring": ("ring",),
    "damm": ("damm",),
    "ufer": ("ufer",),
    "street": ("street", "str", "st"),
    "road": ("road", "rd"),
    "lane": ("lane", "ln", "la"),
    "avenue": ("avenue", "ave", "av"),
    "boulevard": ("boulevard", "blvd", "boul"),
    "square": ("square", "sq"),
    "drive": ("drive", "dr"),
    "court": ("court", "ct"),
    "terrace": ("terrace", "ter"),
    "close": ("close", "cl"),
    "place": ("place",),
    "way": ("way",),
}
#: Types that end the street's own word.
_COMPOUND = ("strasse", "gasse", "weg", "platz", "allee", "ring", "damm", "ufer")
# Words that name a part of a building or who takes the delivery.
WITHIN = (
    "lager", "hinterhaus", "vorderhaus", "gate", "tor", "rampe", "ramp", "dock", "building", "bldg", "block", "floor", "fl",
    "etage", "stock", "og", "eg", "unit", "suite", "ste", "room", "zimmer", "apt", "wing", "z.hd", "z.h", "zhd", "attn",
    "att", "c/o", "receiving", "wareneingang", "warehouse", "goods in", "dept", "loading bay", "bay", "hof links", "hof rechts",
)
_WITHIN = re.compile(
    r"(?:^|(?<=[\s(]))(?:\d+(?:st|nd|rd|th|\.)?\s*)?(?:" + "|".join(re.escape(w) for w in sorted(WITHIN, key=len, reverse=True))
    + r")(?![a-zäöüß])\.?"
)
_NUMBER = re.compile(r"(?<![\w])(?:(?:no|nr|number|#)\.?\s*)?(\d{1,5})(?:\s*[-/]?\s*([a-z]))?(?![\w])")
# Forms of postal codes, a country's letters before them allowed.
_CODE = re.compile(
    r"(?<![\w])(?:(?:[a-z]{1,3}[- ])?(\d{5,6})(?:-\d{4})?|([a-z]{1,2}\d[a-z\d]? ?\d[a-z]{2})|([a-z]\d[a-z] ?\d[a-z]\d)|(\d{4} ?[a-z]{2})|[a-z]{1,2}-(\d{4}))(?![\w])"
)
_SEPARATOR = re.compile(r"[,;\n|]|\s[-–/]\s")
_CAMEL = re.compile(r"(?<=[a-zäöüß])(?=[A-ZÄÖÜ])")
#: Spelling or type -> the types it can stand for.
_MEANINGS: dict[str, frozenset[str]] = {}
for _type, _ways in STREET_TYPES.items():
    for _way in (_type, *_ways):
        _MEANINGS[_way] = _MEANINGS.get(_way, frozenset()) | {_type}
#: Spellings that stand as a word of their own, and those that end the street's word, the longest first.
_ALONE = {s for t, all_ in STREET_TYPES.items() for s in all_ if t not in _COMPOUND or s not in ("str", "g", "all")}
_ENDINGS = sorted({s for t in _COMPOUND for s in STREET_TYPES[t]}, key=lambda x: (-len(x), x))
_LONG = sorted({s for all_ in STREET_TYPES.values() for s in all_ if len(s) >= 4}, key=lambda x: (-len(x), x))

#: Alignment costs: opening and extending a gap, leaving out a street type, a slip in one, anything that cannot be the same.
OPENED, EXTENDED, OMITTED, TYPE_SLIP, DIFFERENT = 0.7, 0.2, 0.1, 0.05, 2.0
#: Least likeness of two tokens that can be spellings of each other.
TOKEN_LIKENESS = 0.6
#: Most that the alignment of one building's spellings costs: a quarter of the street's letters, a fifth without its type.
MOST_COST = 0.5
#: The least street similarity that this cost leaves, the similarity that bands are tuned for, and their recall.
STREET_SIMILARITY = 1 - MOST_COST / 2
BAND_SIMILARITY, BAND_ROWS, RECALL = 0.33, 1, 0.98
#: A part is a wider region where the parts beside it count as more than this many equally frequent ones.
REGION_SPREAD = 4.0
#: Least similarity of a misspelt town to one that codes confirm, and to any other spelling.
TOWN_SIMILARITY, SPELLING_SIMILARITY = 0.75, 0.85


def _street(words: str) -> tuple[str, str] | None:
    """(name, type as written) of the words of a street without its number; None where no type is seen."""
    words = re.sub(r"[.\-'’]+", " ", words).strip()
    parts = words.split()
    if not parts:
        return None
    last, before = parts[-1], "".join(parts[:-1])
    if before and (last in _ALONE or last == "str"):
        return before, last
    joined = before + last
    for spelling in (*_ENDINGS, *_LONG):
        if joined.endswith(spelling) and len(joined) - len(spelling) >= 4:
            return joined[: -len(spelling)], spelling
    for spelling in _LONG:  # a slip of the pen in the type
        if before and edit_distance(last, spelling, 1) == 1:
            return before, last
        for n in (len(spelling) - 1, len(spelling), len(spelling) + 1):
            if len(joined) - n >= 5 and edit_distance(joined[-n:], spelling, 1) == 1:
                return joined[:-n], joined[-n:]
    return None


def read_address(lines: Sequence[str]) -> tuple[str, str, str, str, list[str]] | None:
    """(street, type as written, number, postal code, other parts), or None without street and number."""
    street = kind = number = code = ""
    loose: list[str] = []
    for line in lines:
        for part in _SEPARATOR.split(_CAMEL.sub(" ", line or "")):
            part = re.sub(r"\s+", " ", part).strip(" .,-").lower()
            if not part or _WITHIN.search(part + " "):
                continue
            found = _CODE.search(part)
            if found and not (found[4] and not number and not street):
                code = code or re.sub(r"\s", "", next(x for x in found.groups() if x))
                part = re.sub(r"\s+", " ", part[: found.start()] + " " + part[found.end() :]).strip(" .,-")
                if not part:
                    continue
                if not re.search(r"\d", part):
                    loose.append(part)
                    continue
            found = _NUMBER.search(part)
            if found:
                words = (part[: found.start()] + " " + part[found.end() :]).strip(" .,-")
                if street and number and words and not code and len(found[1]) >= 4:  # a short code before its town
                    code = found[1]
                    loose.append(words)
                    continue
                number = number or found[1].lstrip("0") + (found[2] or "")
                if words and not street:
                    street, kind = _street(words) or (re.sub(r"[^\w]+", "", words), "")
                continue
            loose.append(part)
    parts = []
    for part in loose:
        read = None if street else _street(part)
        if read:
            street, kind = read
        else:
            parts.append(re.sub(r"[^\w]+", "", part))
    return (street, kind, number, code, [p for p in dict.fromkeys(parts) if p]) if street and number else None


@lru_cache(maxsize=100_000)
def _meaning(token: str) -> tuple[frozenset[str], float]:
    """The street types a token can stand for, and what reading it so costs."""
    if token in _MEANINGS:
        return _MEANINGS[token], 0.0
    near = [s for s in _LONG if abs(len(s) - len(token)) <= 1 and edit_distance(token, s, 1) <= 1]
    return frozenset().union(*(_MEANINGS[s] for s in near)), TYPE_SLIP


def _swap_costs(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Cost of putting one token for the other, of each pair."""
    like = edit_similarities([x for x, _ in pairs], [y for _, y in pairs])
    out = np.where(like >= TOKEN_LIKENESS, (1 - like) * 2, DIFFERENT)
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 0.0
        elif any(c.isdigit() for c in x + y):
            out[i] = DIFFERENT
        else:
            (a, slip_a), (b, slip_b) = _meaning(x), _meaning(y)
            if a and b:
                out[i] = slip_a + slip_b if a & b else DIFFERENT
    return out


def alignment_costs(left: Sequence[Sequence[str]], right: Sequence[Sequence[str]]) -> np.ndarray:
    """Cheapest affine-gap alignment of each pair of token lists, all pairs at a time.

    Like spellings cost twice their unlikeness, abbreviations of one street type nothing, tokens
    with digits that differ and unlike tokens ``DIFFERENT``. A gap costs ``OPENED`` and
    ``EXTENDED``, a street type left out ``OMITTED``; a gap never borders on one of the other side,
    so two different tokens are not passed off as one left out here and one there.
    """
    n = len(left)
    if not n:
        return np.zeros(0)
    la, lb = (np.fromiter(map(len, x), dtype=np.int64, count=n) for x in (left, right))
    rows, columns = int(la.max()), int(lb.max())
    seen: dict[tuple[str, str], int] = {}
    at = np.zeros((n, rows, columns), dtype=np.int64)
    gaps = [np.full((n, k), OPENED) for k in (rows, columns)]
    for p, (a, b) in enumerate(zip(left, right)):
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                at[p, i, j] = seen.setdefault((x, y), len(seen))
        for side, tokens in zip(gaps, (a, b)):
            for i, x in enumerate(tokens):
                if _meaning(x)[0]:
                    side[p, i] = OMITTED
    swap = _swap_costs(list(seen))[at] if seen else np.zeros((n, rows, columns))
    far = np.full(n, 1e9)
    match, in_a, in_b = ([[far] * (columns + 1) for _ in range(rows + 1)] for _ in range(3))
    match[0][0] = np.zeros(n)
    for i in range(rows + 1):
        for j in range(columns + 1):
            if i and j:
                before = np.minimum(np.minimum(match[i - 1][j - 1], in_a[i - 1][j - 1]), in_b[i - 1][j - 1])
                match[i][j] = before + swap[:, i - 1, j - 1]
            if i:
                in_a[i][j] = np.minimum(match[i - 1][j] + gaps[0][:, i - 1], in_a[i - 1][j] + EXTENDED)
            if j:
                in_b[i][j] = np.minimum(match[i][j - 1] + gaps[1][:, j - 1], in_b[i][j - 1] + EXTENDED)
    best = np.array([[np.minimum(np.minimum(match[i][j], in_a[i][j]), in_b[i][j]) for j in range(columns + 1)] for i in range(rows + 1)])
    return best[la, lb, np.arange(n)]


def _read(values: pd.Series) -> pd.DataFrame:
    rows = []
    for value in values:
        try:
            lines = json.loads(value) if value else []
        except ValueError:
            lines = []
        lines = [x for x in lines if isinstance(x, str)] if isinstance(lines, list) else []
        rows.append(read_address(lines) or (None,) * 5)
    return pd.DataFrame(rows, columns=["street", "kind", "number", "code", "parts"])


def _verify(left: pd.DataFrame, right: pd.DataFrame) -> pd.Series:
    """1 / (1 + cost) where the alignment costs at most the threshold, else 0."""
    sides = [[[x for x in row if x] for row in side.itertuples(index=False, name=None)] for side in (left, right)]
    cost = alignment_costs(*sides)
    return pd.Series(np.where(cost <= MOST_COST + 1e-9, 1 / (1 + cost), 0.0))


def _surest(share: Column, n: Column) -> Column:
    """Lower end of the one-sigma interval (Wilson) of a share seen in n rows."""
    return (share + 0.5 / n - F.sqrt(share * (1 - share) / n + 0.25 / (n * n))) / (1 + 1 / n)


def regions(read: DataFrame) -> DataFrame:
    """(part) of the parts that are named beside many different others."""
    several = read.filter(F.size("parts") > 1).select("n", "parts")
    one = several.select("n", "parts", F.explode("parts").alias("part"))
    beside = one.select("n", "part", F.explode(F.filter("parts", lambda x: x != F.col("part"))).alias("other"))
    counted = beside.groupBy("part", "other").agg(F.sum("n").cast("double").alias("n"))
    spread = counted.groupBy("part").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("spread"))
    return spread.filter(F.col("spread") > REGION_SPREAD).select("part")


def code_towns(read: DataFrame) -> DataFrame:
    """(code, of_code) of the codes of ``read`` (code, town, n): the town of the prefix with the surest majority."""
    read = read.filter(F.col("code") != "")
    codes = read.filter(F.col("town").isNotNull()).groupBy("code", "town").agg(F.sum("n").alias("n"))
    lengths = F.sequence(F.lit(1), F.char_length("code"))
    heads = codes.select("town", "n", F.explode(F.transform(lengths, lambda i: F.substring(F.col("code"), F.lit(1), i))).alias("prefix"))
    per_town = heads.groupBy("prefix", "town").agg(F.sum("n").alias("n"))
    top = per_town.groupBy("prefix").agg(F.max(F.struct("n", "town")).alias("top"), F.sum("n").cast("double").alias("all"))
    top = top.select("prefix", F.col("top.town").alias("of_code"), _surest(F.col("top.n") / F.col("all"), F.col("all")).alias("sure"))
    each = read.select("code").distinct()
    each = each.select("code", F.explode(F.transform(lengths, lambda i: F.substring(F.col("code"), F.lit(1), i))).alias("prefix"))
    best = each.join(top, "prefix").groupBy("code").agg(F.max(F.struct("sure", F.length("prefix"), "of_code")).alias("b"))
    return best.select("code", F.col("b.of_code").alias("of_code"))


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """``pairs`` of spellings with their edit similarity, those below ``least`` left out."""
    pairs = pairs.filter(may_be_similar(F.col("id_a"), F.col("id_b"), least)).distinct()
    like = F.pandas_udf(lambda a, b: pd.Series(edit_similarities(list(a), list(b))), "double")("id_a", "id_b")
    return pairs.withColumn("like", like).filter(F.col("like") >= least)


def town_spellings(towns: DataFrame) -> DataFrame:
    """(town, place) of the spellings that go by another one; ``towns`` has (town, n, known).

    An unknown spelling goes by the nearest town that codes confirm; where there is none, by its
    most frequent spelling that is nearer still.
    """
    bands = tune_bands(0.5, 2, RECALL)
    forms = towns.withColumnRenamed("town", "id")
    lone = forms.filter(~F.col("known"))
    near = _alike(candidates_between(lone, forms.filter("known"), F.col("id"), bands, 2, "n"), TOWN_SIMILARITY)
    best = F.max_by("id_b", F.struct("like", "n_b", "id_b"))
    confirmed = materialize(near.groupBy(F.col("id_a").alias("town")).agg(best.alias("place")))
    rest = materialize(lone.join(confirmed.select(F.col("town").alias("id")), "id", "left_anti"))
    pairs = _alike(candidate_pairs(rest, band_keys(F.col("id"), bands, 2), "n"), SPELLING_SIMILARITY)
    ends = [F.struct(F.col(f"n_{x}").alias("n"), F.col(f"id_{x}").alias("id")) for x in "ab"]
    led = pairs.select(F.least(*ends)["id"].alias("town"), F.greatest(*ends).alias("head"))
    return confirmed.unionByName(led.groupBy("town").agg(F.max("head")["id"].alias("place")))


def with_places(read: DataFrame) -> DataFrame:
    """Distinct read addresses with ``place``: the one spelling of their town."""
    wide = materialize(regions(read)).select(F.col("part").alias("town"))
    first = read.select("value", "n", "code", F.posexplode("parts").alias("at", "town"))
    named = first.join(wide, "town", "left_anti").groupBy("value").agg(F.min_by("town", "at").alias("town"))
    read = materialize(read.drop("parts").join(named, "value", "left"))
    of_code = materialize(code_towns(read))
    known = of_code.select(F.col("of_code").alias("town")).distinct().withColumn("is_known", F.lit(True))
    towns = read.filter(F.col("town").isNotNull()).groupBy("town").agg(F.sum("n").alias("n")).join(known, "town", "left")
    towns = materialize(towns.select("town", "n", F.coalesce("is_known", F.lit(False)).alias("known")))
    spelled = materialize(town_spellings(towns))
    placed = read.join(of_code, "code", "left").join(spelled, "town", "left").join(towns.select("town", "known"), "town", "left")
    typed = F.coalesce("place", "town")
    near = may_be_similar(F.col("town"), F.col("of_code"), TOWN_SIMILARITY)
    by_code = F.col("of_code").isNotNull() & (F.col("town").isNull() | near | ~(F.col("known") | F.col("place").isNotNull()))
    place = F.when(by_code, F.col("of_code")).otherwise(F.coalesce(typed, F.nullif(F.col("code"), F.lit(""))))
    return placed.select("value", "n", "street", "kind", "number", place.alias("place"))


def same_buildings(rows: DataFrame, key: str = "party_id", lines: str = "address_lines_json") -> DataFrame:
    """(key, building) of every row whose address is readable."""
    rows = rows.select(F.col(key).alias("key"), F.col(lines).alias("value")).filter(F.col("value").isNotNull())
    distinct = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    parse = F.pandas_udf(_read, "street string, kind string, number string, code string, parts array<string>")
    read = distinct.withColumn("p", parse("value")).select("value", "n", "p.*").filter(F.col("street").isNotNull())
    placed = with_places(materialize(read)).filter(F.col("place").isNotNull())
    fields = ("street", "kind", "number", "place")
    placed = materialize(placed.withColumn("id", digest(*fields)))
    forms = materialize(placed.groupBy("id", *fields).agg(F.sum("n").alias("weight")))
    bands = tune_bands(BAND_SIMILARITY, BAND_ROWS, RECALL)
    keys = band_keys(F.col("street"), bands, BAND_ROWS, F.col("number"), F.col("place"))
    pairs = candidate_pairs(forms, keys, *fields)
    pairs = pairs.filter(may_be_similar(F.col("street_a"), F.col("street_b"), STREET_SIMILARITY)).distinct()
    verify = F.pandas_udf(_verify, "double")
    ends = [F.struct(*[F.col(f"{f}_{x}").alias(f) for f in fields]) for x in "ab"]
    edges = pairs.withColumn("score", verify(*ends)).filter(F.col("score") > 0).select("id_a", "id_b", "score")
    buildings = star_clusters(forms.select("id", "weight"), edges)
    labels = placed.select("value", "id").join(buildings, "id").select("value", F.col("center").alias("building"))
    return rows.join(labels, "value").select(F.col("key").alias(key), "building")


def building_pairs(rows: DataFrame, key: str = "party_id") -> DataFrame:
    """(key_a, key_b) of rows that denote the same building."""
    return pairs_within(materialize(same_buildings(rows, key)), "building", key)
