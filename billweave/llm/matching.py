"""Shared parts of the linking operators: keys, banding, string similarity, star clustering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.runtime import materialize, spread

#: Rows of one band that meet in one task; a larger band is cut into blocks that meet pairwise.
HOT = 512


def digest(*columns: Column | str) -> Column:
    """128-bit key of the values of some columns, by which rows are told apart; null is a value of its own."""
    texts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.md5(F.concat(*parts)))


def gram_hashes(text: str, q: int) -> np.ndarray:
    """Distinct q-grams of a text padded with q - 1 marks on both sides, as numbers; never empty."""
    codes = np.frombuffer(("\x02" * (q - 1) + text + "\x03" * (q - 1)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    grams = np.zeros(max(len(codes) - q + 1, 1), dtype=np.uint64)
    if len(codes) >= q:
        for i in range(q):
            grams = grams * np.uint64(0x110000) + codes[i : len(codes) - q + 1 + i].astype(np.uint64)
    return np.unique(grams)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def min_hash_bands(texts: list[str], bands: int, rows: int, q: int = 2) -> np.ndarray:
    """One key per text and band, of ``rows`` MinHash values over the text's padded q-grams."""
    if not texts:
        return np.zeros((0, bands), dtype=np.int64)
    each = [gram_hashes(x, q) for x in texts]
    starts = np.concatenate([[0], np.cumsum([len(g) for g in each])[:-1]])
    grams = np.concatenate(each)
    keys = np.zeros((len(texts), bands), dtype=np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    for b in range(bands):
        for r in range(rows):
            seed = np.uint64((b * rows + r + 1) * int(step) & 0xFFFFFFFFFFFFFFFF)
            least = np.minimum.reduceat(_mix(grams * step + seed), starts)
            keys[:, b] = _mix(keys[:, b] + least + step)
    return keys.view(np.int64)


def band_keys(text: Column, bands: int, rows: int, *exact: Column, q: int = 2) -> Column:
    """Array of one key per band: ``rows`` MinHash values over the text's q-grams, and the exact columns.

    The exact columns are one token shingle: its only element is its MinHash in every band.
    """

    def keys(texts: pd.Series) -> pd.Series:
        found = min_hash_bands(list(texts), bands, rows, q)
        return pd.Series(list(found), dtype=object)

    made = F.pandas_udf(keys, "array<bigint>")(text)
    return F.transform(made, lambda key, b: F.xxhash64(b, key, *exact))


def banding_recall(similarity: float, bands: int, rows: int) -> float:
    """The collision curve: chance that a pair of this similarity shares a band."""
    return 1 - (1 - similarity**rows) ** bands


def tune_bands(similarity: float, rows: int, recall: float) -> int:
    """Fewest bands of ``rows`` values with at least ``recall`` at ``similarity``."""
    bands = 1
    while banding_recall(similarity, bands, rows) < recall:
        bands += 1
    return bands


def candidates_between(left: DataFrame, right: DataFrame, key: Column, bands: int, rows: int, *carry: str) -> DataFrame:
    """Pairs (id_a, id_b) of a row of ``left`` and one of ``right`` that share a band, with carried columns."""
    sides = []
    for side, x in ((left, "a"), (right, "b")):
        banded = spread(side).select("id", *carry, F.explode(band_keys(key, bands, rows)).alias("band"))
        sides.append(banded.select("band", *[F.col(c).alias(f"{c}_{x}") for c in ("id", *carry)]))
    return sides[0].join(sides[1], "band").drop("band")


def meet(banded: DataFrame, band: str, *carry: str, hot: int = HOT) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of the ids of each band, with carried columns of both.

    A band of more than ``hot`` rows is dealt into slices of about that size; every two slices,
    and every slice with itself, meet in a task of their own, so no pair is lost and no task holds
    a whole band.
    """
    names = ("id", *carry)
    # the window shares the shuffle and the order of the join that follows
    held = banded.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy(band)))

    def side(rows: DataFrame, x: str, *on: str) -> DataFrame:
        return rows.select(*on, *[F.col(c).alias(f"{c}_{x}") for c in names])

    wanted = [f"{c}_{x}" for x in "ab" for c in names]
    few = held.filter((F.col("held") > 1) & (F.col("held") <= hot))
    cold = side(few, "a", band).join(side(few, "b", band), band).filter(F.col("id_a") < F.col("id_b")).select(*wanted)
    slices = F.ceil(F.col("held") / hot)
    cut = held.filter(F.col("held") > hot).withColumn("slice", F.pmod(F.xxhash64("id"), slices))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)))
    cut = cut.withColumns({"low": F.least("slice", "other"), "high": F.greatest("slice", "other")})
    sides = [side(cut, x, band, "low", "high", F.col("slice").alias(f"slice_{x}")) for x in "ab"]
    warm = sides[0].join(sides[1], [band, "low", "high"]).filter(F.col("id_a") < F.col("id_b"))
    warm = warm.filter((F.col("slice_a") != F.col("slice_b")) | (F.col("low") == F.col("high")))
    return cold.unionByName(warm.select(*wanted))


def candidate_pairs(forms: DataFrame, keys: Column, *carry: str, hot: int = HOT) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of ids that share a band, with carried columns of both; once for each band shared."""
    return meet(spread(forms).select("id", *carry, F.explode(keys).alias("band")), "band", *carry, hot=hot)


def _codes(texts: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(texts.astype(f"<U{max(width, 1)}")).view(np.uint32).reshape(len(texts), max(width, 1))


def _short_distances(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Distances of pairs whose first texts have at most 64 characters, all pairs at a time."""
    left, right = _codes(a, int(la.max())), _codes(b, int(lb.max()))
    one = np.uint64(1)
    bits = one << np.arange(left.shape[1], dtype=np.uint64)
    last = one << np.maximum(la - 1, 0).astype(np.uint64)
    n = len(a)
    vp, vn, d0, old = np.full(n, ~np.uint64(0)), *(np.zeros(n, dtype=np.uint64) for _ in range(3))
    distance = la.astype(np.int64)
    for j in range(int(lb.max())):
        equal = np.where(left == right[:, j : j + 1], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        swapped = ((~d0 & equal) << one) & old
        d0 = (((equal & vp) + vp) ^ vp) | equal | vn | swapped
        hp, hn = vn | ~(d0 | vp), d0 & vp
        live = j < lb
        distance += live & ((hp & last) != 0)
        distance -= live & ((hn & last) != 0)
        hp, hn = (hp << one) | one, hn << one
        vp, vn, old = hn | ~(d0 | hp), hp & d0, equal
    return np.where(la == 0, lb, distance)


def _long_distance(a: str, b: str) -> int:
    """The same recurrence over whole numbers of any length."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    vp, vn, d0, old, distance = full, 0, 0, 0, len(a)
    for y in b:
        equal = places.get(y, 0)
        swapped = ((~d0 & equal) << 1) & old
        d0 = ((((equal & vp) + vp) ^ vp) | equal | vn | swapped) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        distance += ((hp & last) > 0) - ((hn & last) > 0)
        hp, hn = (hp << 1 | 1) & full, hn << 1 & full
        vp, vn, old = (hn | ~(d0 | hp)) & full, hp & d0, equal
    return distance


def edit_distances(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Optimal string alignment distance of each pair, neighbouring swaps counting one; bit-parallel."""
    out = np.zeros(len(a), dtype=np.int64)
    if not len(a):
        return out
    first, second = np.array(a, dtype=object), np.array(b, dtype=object)
    la, lb = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (first, second))
    flip = la > lb
    first[flip], second[flip] = second[flip], first[flip]
    la, lb = np.minimum(la, lb), np.maximum(la, lb)
    order = np.argsort(lb, kind="stable")
    order = order[la[order] <= 64]
    at = 0
    while at < len(order):  # texts of like length together, so little of the matrix is padding
        n = min(len(order) - at, 20_000)
        while n > 1 and n * int(lb[order[at + n - 1]]) > 2_000_000:
            n //= 2
        part = order[at : at + n]
        out[part] = _short_distances(first[part], second[part], la[part], lb[part])
        at += n
    for i in np.flatnonzero(la > 64):
        out[i] = 0 if first[i] == second[i] else _long_distance(first[i], second[i])
    return out


def edit_similarities(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """1 - distance / length of the longer, of each pair."""
    longest = np.fromiter((max(len(x), len(y), 1) for x, y in zip(a, b)), dtype=np.float64, count=len(a))
    return 1 - edit_distances(a, b) / longest


def may_be_similar(a: Column, b: Column, similarity: float) -> Column:
    """Whether two texts can have this edit similarity: a bound that no such pair fails.

    A swap is one edit there and two in ``levenshtein``, so twice the allowed edits are let through.
    """
    longest = F.greatest(F.char_length(a), F.char_length(b))
    most = F.floor((1 - similarity) * longest + 1e-9)
    near = F.abs(F.char_length(a) - F.char_length(b)) <= most
    return near & (F.levenshtein(a, b) <= 2 * most)


def edit_distance(a: str, b: str, most: int = 3) -> int:
    """The distance of one pair; above ``most``: most + 1."""
    if a == b:
        return 0
    # one edit changes the lengths by one at most, and two of the signs that only one text has
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    return min(_long_distance(a, b) if a and b else len(a) + len(b), most + 1)


def monge_elkan(a: Sequence[Sequence[str]], b: Sequence[Sequence[str]]) -> np.ndarray:
    """Mean best edit similarity of the tokens of each pair of lists, both ways, the lower of the two."""
    pairs: dict[tuple[str, str], int] = {}
    for left, right in zip(a, b):
        for x in left:
            for y in right:
                pairs.setdefault((x, y), len(pairs))
    like = edit_similarities([x for x, _ in pairs], [y for _, y in pairs]) if pairs else np.zeros(0)
    out = np.zeros(len(a))
    for i, (left, right) in enumerate(zip(a, b)):
        if left and right:
            table = [[like[pairs[x, y]] for y in right] for x in left]
            one = sum(map(max, table)) / len(left)
            other = sum(map(max, zip(*table))) / len(right)
            out[i] = min(one, other)
    return out


def nearest(word: str, words: dict[str, str], most: int) -> str | None:
    """The value of the key closest to ``word`` within ``most`` edits; None if none or two differ."""
    best, found = most + 1, set()
    for key, value in words.items():
        if abs(len(key) - len(word)) <= most:
            d = edit_distance(word, key, most)
            if d < best:
                best, found = d, {value}
            elif d == best <= most:
                found.add(value)
    return found.pop() if best <= most and len(found) == 1 else None


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, center) of every node, by star clustering.

    ``nodes`` has (id, weight), ``edges`` (id_a, id_b, score). In each round every open node
    that outranks its open neighbours, by weight, degree and id, becomes a center, and its open
    neighbours join the most similar center next to them. Nodes without an edge are their own
    center. The rounds end when no open pair is left; each round's state is checkpointed.
    """
    one = edges.select(F.col("id_a").alias("v"), F.col("id_b").alias("u"), "score")
    other = edges.select(F.col("id_b").alias("v"), F.col("id_a").alias("u"), "score")
    open_ = materialize(one.unionByName(other))
    degree = open_.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    w = nodes.join(degree, "id").select("id", F.struct("weight", "degree").alias("weight"))
    open_ = open_.join(w.select(F.col("id").alias("v"), F.col("weight").alias("wv")), "v")
    open_ = materialize(open_.join(w.select(F.col("id").alias("u"), F.col("weight").alias("wu")), "u"))
    decided: list[DataFrame] = []
    while open_.limit(1).count():
        top = open_.groupBy("v").agg(F.max(F.struct("wu", "u")).alias("best"), F.first("wv").alias("wv"))
        centers = top.filter(F.struct("wv", "v") > F.col("best")).select("v")
        joined = open_.join(centers.withColumnRenamed("v", "u"), "u").groupBy("v")
        satellites = joined.agg(F.max(F.struct("score", "wu", "u")).alias("best")).select("v", F.col("best.u").alias("center"))
        done = materialize(satellites.unionByName(centers.select("v", F.col("v").alias("center"))))
        decided.append(done)
        gone = done.select("v")
        rest = open_.join(gone, "v", "left_anti").join(gone.withColumnRenamed("v", "u"), "u", "left_anti")
        open_ = materialize(rest)
    alone = nodes.select("id")
    if not decided:
        return alone.withColumn("center", F.col("id"))
    found = reduce(DataFrame.unionByName, decided)
    return alone.join(found.withColumnRenamed("v", "id"), "id", "left").select(
        "id", F.coalesce("center", "id").alias("center")
    )


def pairs_within(members: DataFrame, cluster: str, key: str, *names: str) -> DataFrame:
    """Every pair of rows of one cluster, the smaller key first: the stated result, not a search."""
    low, high = names or (f"{key}_a", f"{key}_b")
    found = meet(members.select(F.col(cluster).alias("cluster"), F.col(key).alias("id")), "cluster")
    return found.select(F.col("id_a").alias(low), F.col("id_b").alias(high))
