"""The best products of every query of a scope: blocks of queries against chunks of its catalogue, exactly.

Every alias of the scope is compared. Common words and n-grams of a query and all aliases of a chunk
are counted over posting lists at once. The sequence ratio, which costs most, is taken only where
an upper bound reaches the k-th best product: the common characters first, then the longest common
subsequence, which holds all matching blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from billweave.functions.attributes import PROTECTED, extract_attributes
from billweave.functions.scoring import CATEGORY, CONFLICT_FACTOR, NO_CONFLICT, weighted
from billweave.runtime import materialize

#: Queries and aliases of one scope that meet in one task, and pairs of them for which a further task is made.
BLOCK, CHUNK, TASK_PAIRS = 2048, 16384, 1 << 22
#: Scores closer than this may be equal after rounding to six places.
NEAR = 2e-6
#: Characters share this many buckets in the upper bounds; longer texts have the bound of common characters only.
BUCKETS, LONG = 64, 512
#: Aliases of the highest bound that are compared before all others.
AHEAD = 64


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64), lengths


def _grams(texts: list[str], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram as a number) of texts padded by two blanks on both sides."""
    flat, lengths = _characters([f"  {t}  " for t in texts])
    rows = np.repeat(np.arange(len(texts)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    first = np.flatnonzero(np.arange(len(flat)) + n <= ends)
    code = np.zeros(len(first), np.int64)
    for i in range(n):
        code = (code << 21) | flat[first + i]
    return rows[first], code


def _words(texts: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, word as a number) of texts; ``known`` gives the numbers and gets new words."""
    each = [(i, known.setdefault(w, len(known))) for i, t in enumerate(texts) for w in t.split(" ") if w]
    flat = np.array(each, np.int64).reshape(-1, 2)
    return flat[:, 0], flat[:, 1]


class _Shared:
    """Jaccard similarity of the terms of one query and of every alias."""

    def __init__(self, aliases: tuple[np.ndarray, np.ndarray], n: int, queries: tuple[np.ndarray, np.ndarray], m: int):
        self.n = n
        vocabulary, term = np.unique(np.concatenate([aliases[1], queries[1]]), return_inverse=True)
        of_alias = np.unique(term[: len(aliases[0])] * n + aliases[0])
        self.rows, self.size = of_alias % n, np.bincount(of_alias % n, minlength=n)
        self.starts = np.searchsorted(of_alias // n, np.arange(len(vocabulary) + 1))
        of_query = np.unique(queries[0] * len(vocabulary) + term[len(aliases[0]) :])
        self.terms = of_query % max(1, len(vocabulary))
        self.bounds = np.searchsorted(of_query // max(1, len(vocabulary)), np.arange(m + 1))

    def jaccard(self, query: int) -> np.ndarray:
        terms = self.terms[self.bounds[query] : self.bounds[query + 1]]
        lists = [self.rows[a:b] for a, b in zip(self.starts[terms].tolist(), self.starts[terms + 1].tolist()) if a < b]
        both = np.bincount(np.concatenate(lists), minlength=self.n) if lists else np.zeros(self.n, np.int64)
        union = self.size + (len(terms) - both)
        if len(terms):
            return both / union
        return np.where(union == 0, 1.0, 0.0)


class _Bounds:
    """Upper bounds of the characters in the matching blocks of a query and aliases, over buckets of characters."""

    def __init__(self, texts: list[str]):
        flat, self.lengths = _characters(texts)
        rows, longest = np.repeat(np.arange(len(texts)), self.lengths), int(self.lengths.max(initial=0))
        kind = np.uint8 if longest < 256 else np.int64
        counts = np.bincount(flat % BUCKETS * len(texts) + rows, minlength=BUCKETS * len(texts))
        self.counts = counts.reshape(BUCKETS, len(texts)).astype(kind)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        near = at < LONG
        self.places = np.full((min(LONG, longest), len(texts)), BUCKETS, np.uint8)
        self.places[at[near], rows[near]] = flat[near] % BUCKETS

    def common(self, query: str) -> np.ndarray:
        """Characters in both, in any order."""
        total = np.zeros_like(self.counts[0])
        most = np.iinfo(total.dtype).max
        for bucket, n in enumerate(np.bincount(_characters([query])[0] % BUCKETS, minlength=BUCKETS).tolist()):
            if n:
                total += np.minimum(self.counts[bucket], min(n, most))
        return total.astype(np.int64)

    def subsequence(self, query: str, some: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence, of 64 query characters a machine word; both texts up to ``LONG``."""
        words = -(-len(query) // 64)
        masks = np.zeros((words, BUCKETS + 1), np.uint64)
        for i, bucket in enumerate((_characters([query])[0] % BUCKETS).tolist()):
            masks[i // 64, bucket] |= np.uint64(1 << i % 64)
        left = np.full((words, len(some)), ~np.uint64(0))
        for bucket in self.places[: self.lengths[some].max(initial=0), some]:
            carry = None
            for w in range(words):
                v = left[w]
                hit = np.take(masks[w], bucket, mode="clip") & v
                up = v + hit
                over = up < v if words > 1 else None
                if carry is not None:
                    up += carry
                    over |= up < carry
                v -= hit
                v |= up
                carry = over
        return np.bitwise_count(~left).sum(axis=0).astype(np.int64)


def _ratio(matches, length):
    """The ratio of matching characters to all, 1 without any."""
    return np.divide(2.0 * matches, length, out=np.ones(len(length)), where=length > 0)


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Millionths, rounded half up in decimal as the column expression does."""
    values, at = np.unique(scores, return_inverse=True)
    millionths = np.floor(values * 1e6 + 0.5)
    for i in np.flatnonzero(np.abs(values * 1e6 + 0.5 - np.rint(values * 1e6 + 0.5)) < 1e-3):
        millionths[i] = int((Decimal(repr(float(values[i]))) * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP))
    return millionths[at]


class _Chunk:
    """Aliases in the order in which they win ties: by product, then by text."""

    def __init__(self, queries: pd.DataFrame, aliases: pd.DataFrame, k: int, lexical: bool):
        self.k, self.lexical = k, lexical
        self.asked, self.held = queries["q_normalized"].tolist(), aliases["normalized"].tolist()
        asked, held = ([t or "" for t in texts] for texts in (self.asked, self.held))
        self.unread = np.array([t is None for t in self.held])
        numbers: dict[str, int] = {}
        n, m = len(held), len(asked)
        self.words = _Shared(_words(held, numbers), n, _words(asked, numbers), m)
        self.grams = _Shared(_grams(held), n, _grams(asked), m)
        self.bounds = _Bounds(held) if lexical else None
        products = aliases["product_id"].to_numpy()
        self.starts = np.concatenate([[0], np.flatnonzero(products[1:] != products[:-1]) + 1])
        self.product = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, n)))
        self.said = [tuple(x) for x in queries["said"]]
        self.stated = list(zip(*aliases["stated"]))
        self.any = [np.array([x is not None for x in values], bool) for values in self.stated]
        self.equal: dict[tuple[int, str], np.ndarray] = {}

    def _states(self, i: int, value: str) -> np.ndarray:
        """Aliases whose i-th attribute has this value."""
        if (i, value) not in self.equal:
            self.equal[i, value] = np.array([x == value for x in self.stated[i]], bool)
        return self.equal[i, value]

    def _attributes(self, said: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is added for no conflict and for the category, and the factor of a conflict."""
        conflict, same = np.zeros((2, len(self.held)), bool)
        for i, value in enumerate(said):
            if value is not None and i < len(said) - 1:
                conflict |= self.any[i] & ~self._states(i, value)
            elif value is not None:
                same = self._states(i, value)
        return np.where(conflict, 0.0, NO_CONFLICT), np.where(same, CATEGORY, 0.0), np.where(conflict, CONFLICT_FACTOR, 1.0)

    def best(self, query: int) -> Iterator[tuple]:
        """(alias, sequence ratio, token, trigram, conflict, score) of the k best products; no ratio without a text."""
        token, trigram = self.words.jaccard(query), self.grams.jaccard(query)
        no_conflict, category, factor = self._attributes(self.said[query])
        text = self.asked[query]

        def score(ratio, at=slice(None)) -> np.ndarray:
            base = weighted(ratio, token[at], trigram[at]) + no_conflict[at] + category[at]
            base[self.unread[at] if text is not None else slice(None)] = 1.0  # least() passes over null
            return np.minimum(1.0, base) * factor[at]

        if not self.lexical:
            scores = score(0.0)
            tops = np.maximum.reduceat(scores, self.starts)
            least = np.partition(tops, -self.k)[-self.k] if len(tops) > self.k else -1.0
            near = np.flatnonzero(scores >= least - NEAR)
            first = self._first(near, scores[near], np.zeros(len(near)))
        else:
            first = self._first(*self._compared(text or "", score))
        for a, ratio, points in first:
            read = (ratio, float(token[a]), float(trigram[a]))
            if text is None or self.unread[a]:  # a missing text counts as one n-gram of its own
                read = (None, None, float(text is None and self.unread[a]))
            yield a, *read, bool(factor[a] != 1.0), points

    def _compared(self, text: str, score) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The aliases that can be among the best, their scores and sequence ratios."""
        length = self.bounds.lengths + len(text)
        bound = score(_ratio(self.bounds.common(text), length))
        found: list[tuple[int, float, float]] = []
        tops: dict[int, float] = {}
        least = -1.0
        ahead = np.argpartition(bound, -AHEAD)[-AHEAD:] if len(bound) > AHEAD else np.arange(len(bound))
        rest = np.ones(len(bound), bool)
        rest[ahead] = False
        for some in (ahead, None):
            if some is None:
                some = np.flatnonzero(rest & (bound >= least - NEAR))
            upper = bound[some]
            if 0 < len(text) <= LONG:
                short = np.flatnonzero(self.bounds.lengths[some] <= LONG)
                part = some[short]
                upper[short] = score(_ratio(self.bounds.subsequence(text, part), length[part]), part)
            for i in np.argsort(-upper, kind="stable").tolist():
                if upper[i] < least - NEAR:
                    break
                at = some[i : i + 1]
                ratio = SequenceMatcher(None, text, self.held[at[0]] or "").ratio()
                value = float(score(np.array([ratio]), at)[0])
                found.append((int(at[0]), value, ratio))
                product = int(self.product[at[0]])
                if value > tops.get(product, -1.0):
                    tops[product] = value
                    if len(tops) >= self.k:
                        least = sorted(tops.values())[-self.k]
        at, values, ratios = zip(*found)
        return np.array(at), np.array(values), np.array(ratios)

    def _first(self, at: np.ndarray, scores: np.ndarray, ratios: np.ndarray) -> Iterator[tuple[int, float, float]]:
        seen: set[int] = set()
        millionths = _rounded(scores)
        for i in np.lexsort((at, -millionths)).tolist():
            product = int(self.product[at[i]])
            if product not in seen:
                seen.add(product)
                yield int(at[i]), float(ratios[i]), float(millionths[i] / 1e6)
                if len(seen) == self.k:
                    return


def best_pairs(queries: DataFrame, held: DataFrame, scope: tuple[str, ...], k: int, lexical: bool) -> DataFrame:
    """Pairs of a query and an alias of its scope that hold the k best products of every query, with their evidence and score.

    ``queries`` has (query_id, scope, q_normalized), ``held`` (scope, alias_id, normalized, product_id, category,
    attributes_json). Of a product only its best alias of a chunk stays; each chunk gives k products at most.
    """
    keys = sorted(PROTECTED)
    says, states = extract_attributes(F.col("q_normalized")), F.from_json("attributes_json", "map<string,string>")
    sizes = queries.groupBy(*scope).agg(F.count(F.lit(1)).alias("q")).join(held.groupBy(*scope).agg(F.count(F.lit(1)).alias("a")), list(scope))
    parts = [F.ceil(F.col(side) / most).cast("int").alias(f"{side}_parts") for side, most in (("q", BLOCK), ("a", CHUNK))]
    sizes = materialize(sizes.select(*scope, "q", "a", *parts))
    meets, pairs = sizes.agg(F.sum(F.col("q_parts") * F.col("a_parts")), F.sum(F.col("q") * F.col("a"))).first()
    tasks = max(1, min(meets or 0, held.sparkSession.sparkContext.defaultParallelism + (pairs or 0) // TASK_PAIRS))

    def dealt(df: DataFrame, own: str, other: str, *by: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*by), F.col(f"{own}_parts")).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)).alias(other)
        both = df.join(sizes.drop("q", "a"), list(scope))
        new = [F.col(c).alias(c) for c in df.columns]  # both sides may come from one table
        return both.select(*new, part, every).repartition(tasks, *scope, "q", "a")

    said = F.array(*[F.try_element_at(says, F.lit(x)) for x in (*keys, "category_hint")])
    stated = F.array(*[F.try_element_at(states, F.lit(x)) for x in keys], F.col("category"))
    left = dealt(queries.withColumn("said", said), "q", "a", "query_id")
    right = dealt(held.withColumn("stated", stated), "a", "q", "product_id", "alias_id")
    of_query = [f for f in queries.schema if f.name not in scope]
    of_alias = [f for f in held.schema if f.name not in scope]

    reads = {"lexical": "float64", "token": "float64", "trigram": "float64", "conflict": "bool", "score": "float64"}

    def search(asked: pd.DataFrame, aliases: pd.DataFrame) -> pd.DataFrame:
        asked, aliases = (x.astype(object).where(x.notna(), None) for x in (asked.reset_index(drop=True), aliases))
        wins = list(zip(*([(x is not None, x) for x in aliases[c]] for c in ("product_id", "normalized", "alias_id"))))
        aliases = aliases.iloc[sorted(range(len(wins)), key=wins.__getitem__)].reset_index(drop=True)
        found = []
        if len(asked) and len(aliases):
            chunk = _Chunk(asked, aliases, k, lexical)
            found = [(q, *hit) for q in range(len(asked)) for hit in chunk.best(q)]
        q, a = ([x[i] for x in found] for i in range(2))
        mine = asked[[f.name for f in of_query]].iloc[q].reset_index(drop=True)
        theirs = aliases[[f.name for f in of_alias]].iloc[a].reset_index(drop=True)
        evidence = pd.DataFrame({name: pd.Series([x[2 + i] for x in found], dtype=kind) for i, (name, kind) in enumerate(reads.items())})
        return pd.concat([mine, theirs, evidence], axis=1)

    types = [StructField(name, BooleanType() if kind == "bool" else DoubleType()) for name, kind in reads.items()]
    schema = StructType([*of_query, *of_alias, *types])
    together = [*scope, "q", "a"]
    return left.groupBy(*together).cogroup(right.groupBy(*together)).applyInPandas(search, schema)
