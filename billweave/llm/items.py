"""Problem 1: listings of different sellers that describe the same item.

1. Lines and catalogue rows are read into properties and other words (:mod:`listings`). Equal
   wording of one seller is read once.
2. Inside a tenant and a kind, words are banded by MinHash over padded q-grams and clustered with
   their misspellings. Which words name an item is learned: one that stands beside many different
   ones (a brand, an advertisement) names none. A wording belongs to the family of its most
   frequent naming word; one of unknown kind looks its words up under all kinds, one without a
   naming word goes by its part number.
3. A seller's wordings of a family are collapsed to listings, the fullest first. The listings of every two sellers that contradict each other in nothing are scored and matched
   by maximum weight, one to one, in each connected component of the two sellers' listings.
4. Matches are merged heaviest first where the merged item contradicts itself in nothing, holds
   one listing of each seller, and as many matches between its parts lead into it as out of it,
   so a cycle of matches that does not close is not merged.

A family meets in one task only as its matches, which are between distinct listings: their
number is bounded by what can be stated, not by the rows.

Defined results: null and empty wordings, wordings without a naming word and a part number, and
rows without tenant or partner are in no pair; repeated wordings of a seller are the same item;
an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.llm.catalogue import naming_words, read_catalogue, read_values, with_words
from billweave.llm.matching import (
    band_keys,
    candidate_pairs,
    digest,
    edit_similarities,
    may_be_similar,
    pairs_within,
    star_clusters,
    tune_bands,
)
from billweave.runtime import materialize

SLIP_SIMILARITY, ROWS, RECALL = 0.5, 3, 0.98
#: Least edit similarity of two spellings of a word: one slip in five letters. Words with digits have one spelling.
WORD_SIMILARITY = 0.8
_SIGNATURE = ("colour", "measure", "size", "pack", "code")
FAMILY = ("tenant_id", "kind", "family")


def heaviest_matching(weights: list[list[float]]) -> list[tuple[int, int]]:
    """Maximum-weight one-to-one matching (row, column); pairs without weight are left out."""
    n, m = len(weights), len(weights[0]) if weights else 0
    if not n or not m:
        return []
    if n > m:
        return sorted((i, j) for j, i in heaviest_matching([list(c) for c in zip(*weights)]))
    far = float("inf")
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):  # shortest augmenting paths on the negated weights
        match[0], j0 = i, 0
        least, used = [far] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], far, 0
            for j in range(1, m + 1):
                if not used[j]:
                    slack = -weights[i0 - 1][j - 1] - u[i0] - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j] and weights[match[j] - 1][j - 1] > 0)


def _components(pairs: list[tuple]) -> Iterator[list[tuple]]:
    """The pairs (left, right, ...) of each connected component."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for pair in pairs:
        root[find((0, pair[0]))] = find((1, pair[1]))
    parts: dict = defaultdict(list)
    for pair in pairs:
        parts[find((0, pair[0]))].append(pair)
    yield from parts.values()


def match_sellers(pairs: list[tuple]) -> list[tuple]:
    """Of the pairs (left, right, weight, ...) of two sellers' listings those of a maximum-weight matching."""
    out = []
    for part in _components(pairs):
        left, right = (sorted({p[i] for p in part}) for i in (0, 1))
        row, column = ({x: i for i, x in enumerate(side)} for side in (left, right))
        weights = [[0.0] * len(right) for _ in left]
        for p in part:
            weights[row[p[0]]][column[p[1]]] = p[2]
        chosen = {(left[i], right[j]) for i, j in heaviest_matching(weights)}
        out += [p for p in part if (p[0], p[1]) in chosen]
    return out


def merge_matches(matches: list[tuple]) -> dict:
    """The item, named by one of its listings, of each listing of a family's matches.

    A match is (left, right, weight, rows, left seller, right seller, left signature, right signature).
    """
    partner: dict = {}
    root, held, said = {}, {}, {}
    for a, b, _, _, s, t, x, y in matches:
        partner[a, t], partner[b, s] = b, a
        for k, seller, signature in ((a, s, x), (b, t, y)):
            root[k], held[k], said[k] = k, {seller: k}, signature

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def out_of(left: dict, right: dict) -> tuple[int, int]:
        """How many matches of one part's listings lead to the other part, and to another listing of its sellers."""
        ends = [(partner.get((k, t)), right[t]) for k in left.values() for t in right]
        return sum(p == k for p, k in ends), sum(p is not None and p != k for p, k in ends)

    for a, b, *_ in sorted(matches, key=lambda m: (-m[2], -m[3], m[0], m[1])):
        a, b = find(a), find(b)
        if a == b or held[a].keys() & held[b].keys() or any(x and y and x != y for x, y in zip(said[a], said[b])):
            continue
        inside, outside = out_of(held[a], held[b])
        if inside >= outside + out_of(held[b], held[a])[1] or inside * 2 >= len(held[a]) * len(held[b]):
            root[b] = a
            held[a] |= held.pop(b)
            said[a] = tuple(x or y for x, y in zip(said[a], said.pop(b)))
    return {k: find(k) for k in root}


def _each_group(schema_key: int, names: list[str], settle: Callable[[list[tuple]], list[tuple]], out: list[str]):
    """mapInPandas function that settles the groups of one partition, whose rows come sorted by their first columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[tuple] = []
        for batch in batches:
            done: list[tuple] = []
            for _, rows in groupby(batch[names].itertuples(index=False, name=None), key=lambda r: r[:schema_key]):
                new = list(rows)
                if open_ and open_[0][:schema_key] != new[0][:schema_key]:
                    done += settle(open_)
                    open_ = []
                open_ += new
            yield pd.DataFrame(done, columns=out)
        yield pd.DataFrame(settle(open_) if open_ else [], columns=out)

    return run


def word_families(words: DataFrame) -> DataFrame:
    """(tenant_id, kind, word, family): each word with the spelling its family goes by.

    ``words`` has (tenant_id, kind, word, weight), one row each.
    """
    spelt = ~F.col("word").rlike("[0-9]")
    forms = materialize(words.withColumn("id", digest("tenant_id", "kind", "word")))
    bands = tune_bands(SLIP_SIMILARITY, ROWS, RECALL)
    keys = band_keys(F.col("word"), bands, ROWS, F.col("tenant_id"), F.col("kind"))
    pairs = candidate_pairs(forms.filter(spelt), keys, "word")
    pairs = pairs.filter(may_be_similar(F.col("word_a"), F.col("word_b"), WORD_SIMILARITY)).distinct()
    score = F.pandas_udf(lambda a, b: pd.Series(edit_similarities(list(a), list(b))), "double")("word_a", "word_b")
    edges = pairs.withColumn("score", score).filter(F.col("score") >= WORD_SIMILARITY - 1e-9).select("id_a", "id_b", "score")
    centers = star_clusters(forms.select("id", "weight"), edges)
    heads = forms.select(F.col("id").alias("center"), F.col("word").alias("family"))
    return forms.join(centers, "id").join(heads, "center").select("tenant_id", "kind", "word", "family")


def _families(listings: DataFrame) -> DataFrame:
    """(tenant_id, own_kind, names, kind, family) of the phrases that a naming word places."""
    phrases = listings.filter(F.col("names") != "").groupBy("tenant_id", "kind", "names").agg(F.count(F.lit(1)).alias("n"))
    # numbered once they are written: short keys that no two phrases share
    phrases = materialize(phrases.withColumn("pid", F.monotonically_increasing_id()))
    words = with_words(phrases, "pid", "tenant_id", "kind", "n")
    counted = materialize(words.groupBy("tenant_id", "kind", "word").agg(F.sum("n").alias("weight")))
    families = materialize(word_families(counted).join(counted, ["tenant_id", "kind", "word"]))
    # a wording of unknown kind takes its word's most frequent family of a known one
    of_word = families.filter(F.col("kind") != "").groupBy("tenant_id", "word")
    of_word = of_word.agg(F.max_by(F.struct("kind", "family"), F.struct("weight", "kind")).alias("known"))
    known = families.filter(F.col("kind") != "").select("tenant_id", "kind", "word", F.col("kind").alias("to"), "family")
    unknown = families.filter(F.col("kind") == "").join(of_word, ["tenant_id", "word"], "left")
    unknown = unknown.select(
        "tenant_id", "kind", "word", F.coalesce("known.kind", "kind").alias("to"), F.coalesce("known.family", "family").alias("family")
    )
    used = words.join(known.unionByName(unknown), ["tenant_id", "kind", "word"])
    used = materialize(used.groupBy("pid", "tenant_id", "n", F.col("to").alias("kind"), F.col("family").alias("word")).agg(F.lit(1).alias("one")).drop("one"))
    named = naming_words(used, "pid", "tenant_id")
    best = named.groupBy("pid").agg(F.max(F.struct("df", "word", "kind")).alias("b"))
    placed = phrases.join(best, "pid")
    return placed.select("tenant_id", F.col("kind").alias("own_kind"), "names", "b.kind", F.col("b.word").alias("family"))


def _completed(nodes: DataFrame) -> DataFrame:
    """``nodes`` with what their part number says elsewhere in the family, where that is one value."""
    coded = nodes.filter(F.col("code") != "")
    stated = [f for f in _SIGNATURE if f != "code"]
    one = lambda f: F.when(F.count_distinct(F.nullif(f, F.lit(""))) == 1, F.max(f))
    known = coded.groupBy("fid", "code").agg(*[one(f).alias(f"of_{f}") for f in stated])
    full = coded.join(known, ["fid", "code"])
    full = full.withColumns({f: F.when(F.col(f) == "", F.coalesce(f"of_{f}", F.lit(""))).otherwise(F.col(f)) for f in stated})
    return nodes.filter(F.col("code") == "").unionByName(full.select(nodes.columns))


def _agree(test: Callable[[Column, Column], Column], names: tuple[str, ...] = _SIGNATURE) -> Column:
    out = F.lit(True)
    for f in names:
        out = out & test(F.col(f"{f}_a"), F.col(f"{f}_b"))
    return out


def one_seller(signatures: list[tuple], counts: list[int]) -> list[int]:
    """The listing, as the place of its fullest wording, of each wording of one seller and family.

    The fullest wordings come first; each joins the one listing that it contradicts in nothing, and
    opens one of its own where there is none or several.
    """
    order = sorted(range(len(signatures)), key=lambda i: (-sum(map(bool, signatures[i])), -counts[i], signatures[i]))
    said: dict[int, tuple] = {}
    out = list(range(len(signatures)))
    for i in order:
        fits = [k for k, s in said.items() if not any(x and y and x != y for x, y in zip(s, signatures[i]))]
        out[i] = fits[0] if len(fits) == 1 else i
        said[out[i]] = tuple(x or y for x, y in zip(said.get(out[i], signatures[i]), signatures[i]))
    return out


def _settle_seller(rows: list[tuple]) -> list[tuple]:
    at = one_seller([r[4:] for r in rows], [r[3] for r in rows])
    return [(*r, rows[k][2]) for r, k in zip(rows, at)]


def seller_listings(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their ``listing``; the wordings of one seller in one family meet, bounded by what can be stated."""
    names = ["fid", "seller", "nid", "rows", *_SIGNATURE]
    ordered = nodes.select(*names).repartition("fid", "seller").sortWithinPartitions("fid", "seller")
    schema = ", ".join(["fid binary, seller string, nid bigint, rows bigint", *[f"{f} string" for f in _SIGNATURE], "listing bigint"])
    return ordered.mapInPandas(_each_group(2, names, _settle_seller, [*names, "listing"]), schema)


def seller_matches(listings: DataFrame) -> DataFrame:
    """The matched listings (a, b) of every two sellers of a family, with what the merging needs."""
    carried = ("nid", "seller", "rows", *_SIGNATURE)
    both = [listings.select("fid", *[F.col(c).alias(f"{c}_{x}") for c in carried]) for x in "ab"]
    pairs = both[0].join(both[1], "fid").filter(F.col("seller_a") < F.col("seller_b"))
    pairs = pairs.filter(_agree(lambda a, b: (a == "") | (b == "") | (a == b)))
    same = lambda f: ((F.col(f"{f}_a") != "") & (F.col(f"{f}_a") == F.col(f"{f}_b"))).cast("int")
    one_sided = lambda f: ((F.col(f"{f}_a") == "") != (F.col(f"{f}_b") == "")).cast("int")
    stated = [f for f in _SIGNATURE if f != "code"]
    weight = 1.0 + 8.0 * same("code") + 2.0 * sum(map(same, stated)) - 0.5 * sum(map(one_sided, stated))
    pairs = pairs.withColumn("weight", weight)
    # a pair that is the only one of both its listings is a component of its own
    alone = [F.count(F.lit(1)).over(Window.partitionBy("fid", "seller_a", "seller_b", f"nid_{x}")) == 1 for x in "ab"]
    pairs = materialize(pairs.withColumn("alone", alone[0] & alone[1]))
    open_ = pairs.filter(~F.col("alone")).select("fid", "seller_a", "seller_b", "nid_a", "nid_b", "weight")
    names = open_.columns
    settle = lambda rows: [(*rows[0][:3], a, b) for a, b, _ in match_sellers([r[3:] for r in rows])]
    ordered = open_.repartition("fid", "seller_a", "seller_b").sortWithinPartitions("fid", "seller_a", "seller_b")
    chosen = ordered.mapInPandas(_each_group(3, names, settle, names[:5]), "fid binary, seller_a string, seller_b string, nid_a bigint, nid_b bigint")
    return pairs.filter("alone").drop("alone").unionByName(pairs.drop("alone").join(chosen.select("nid_a", "nid_b"), ["nid_a", "nid_b"], "left_semi"))


def _settle_family(rows: list[tuple]) -> list[tuple]:
    k = len(_SIGNATURE)
    matches = [(a, b, w, n, s, t, tuple(rest[:k]), tuple(rest[k:])) for _, a, b, w, n, s, t, *rest in rows]
    return list(merge_matches(matches).items())


def same_items(lines: DataFrame, products: DataFrame) -> DataFrame:
    """(key, item) of lines (L) and catalogue rows (P) that can be placed.

    ``lines`` needs line_id, tenant_id, partner_id and description; ``products`` the catalogue's
    columns. The item identifies a group of equal items of one tenant.
    """
    scope = ("tenant_id", "partner_id")
    scoped = F.col("tenant_id").isNotNull() & F.col("partner_id").isNotNull()
    lines, products = lines.filter(scoped), products.filter(scoped)
    texts = lines.select(*scope, "description").filter(F.col("description").isNotNull()).distinct()
    said = read_values(texts.withColumn("text_key", digest(*scope, "description")), "description").drop("description")
    product_key = F.concat(F.lit("P"), F.col("product_id"))
    held = read_catalogue(products).withColumn("text_key", digest("tenant_id", product_key))
    columns = ("text_key", *scope, "kind", "names", *_SIGNATURE)
    both = said.select(*columns).unionByName(held.select(*columns))
    both = materialize(both.withColumn("pack", F.when(F.col("pack") == "", "1").otherwise(F.col("pack"))))
    placed = both.withColumnRenamed("kind", "own_kind").join(_families(both), ["tenant_id", "own_kind", "names"], "left").drop("own_kind", "names")
    placed = materialize(placed)

    # a part number names one item: the family that most of its wordings give holds for all of them
    coded = placed.filter(F.col("code") != "")
    counted = coded.filter(F.col("family").isNotNull()).groupBy("tenant_id", "code", "kind", "family").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct("kind", "family"), F.struct("n", "kind", "family"))
    by_code = counted.groupBy("tenant_id", "code").agg(best.alias("of_code"))
    coded = coded.join(by_code, ["tenant_id", "code"], "left")
    coded = coded.withColumns(
        {"family": F.coalesce("of_code.family", F.concat(F.lit("#"), "code")), "kind": F.coalesce("of_code.kind", F.lit(""))}
    ).drop("of_code")
    placed = coded.unionByName(placed.filter((F.col("code") == "") & F.col("family").isNotNull()))
    placed = placed.select("text_key", digest(*FAMILY).alias("fid"), F.col("partner_id").alias("seller"), *_SIGNATURE)
    # rows are collapsed to distinct signatures before listings meet; these are numbered once they are written
    of_node = ("fid", "seller", *_SIGNATURE)
    placed = materialize(placed.withColumn("node_key", digest(F.hex("fid"), *of_node[1:])))
    nodes = placed.groupBy("node_key", *of_node).agg(F.count(F.lit(1)).alias("rows"))
    nodes = materialize(nodes.withColumn("nid", F.monotonically_increasing_id()))
    own = materialize(seller_listings(_completed(nodes.drop("node_key"))))
    # what a listing's wordings state is one value or none
    of_listing = own.groupBy("fid", "seller", F.col("listing").alias("nid"))
    matches = seller_matches(of_listing.agg(F.sum("rows").alias("rows"), *[F.max(f).alias(f) for f in _SIGNATURE]))
    carried = ("fid", "nid_a", "nid_b", "weight", "n", "seller_a", "seller_b", *[f"{f}_{x}" for x in "ab" for f in _SIGNATURE])
    ordered = matches.withColumn("n", F.col("rows_a") + F.col("rows_b")).select(*carried).repartition("fid").sortWithinPartitions("fid")
    items = ordered.mapInPandas(_each_group(1, list(carried), _settle_family, ["listing", "item"]), "listing bigint, item bigint")
    labels = own.select("nid", "listing").join(items, "listing", "left").select("nid", F.coalesce("item", "listing").alias("item"))
    labels = nodes.select("node_key", "nid").join(labels, "nid").select("node_key", "item")
    labels = placed.select("text_key", "node_key").join(labels, "node_key").select("text_key", "item")
    line_keys = lines.select(F.concat(F.lit("L"), "line_id").alias("key"), digest(*scope, "description").alias("text_key"))
    product_keys = products.select(product_key.alias("key"), digest("tenant_id", product_key).alias("text_key"))
    return line_keys.unionByName(product_keys).join(labels, "text_key").select("key", "item")


def item_pairs(lines: DataFrame, products: DataFrame) -> DataFrame:
    """(key_a, key_b) of lines and catalogue rows of one tenant that describe the same item."""
    return pairs_within(materialize(same_items(lines, products)), "item", "key")
