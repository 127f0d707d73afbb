"""Scoped retrieval of catalogue aliases: exact lookup, similarity join, best per product, top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.functions.attributes import conflicting_attributes, extract_attributes
from billweave.functions.scoring import hybrid_score
from billweave.functions.text import ngram_jaccard, sequence_similarity, token_jaccard, tokens
from billweave.operators.scope_search import best_pairs

SCOPE = ("tenant_id", "partner_id")
#: Matrices of vectors that one task compares with the queries.
GROUP_CHUNKS = 8


def approved_aliases(aliases: DataFrame, products: DataFrame) -> DataFrame:
    """Approved aliases with their active product; the key covers product, tenant and partner."""
    live = products.filter("active").select(*SCOPE, "product_id", "canonical_description", "category", "attributes_json")
    return aliases.filter("approved").join(live, [*SCOPE, "product_id"])


def orphan_aliases(aliases: DataFrame, products: DataFrame) -> DataFrame:
    """Approved aliases without an active product in their scope."""
    live = products.filter("active").select(*SCOPE, "product_id")
    return aliases.filter("approved").join(live, [*SCOPE, "product_id"], "left_anti")


def exact_lookup(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """``lines`` with the product of their normalised text, null where no approved alias has it.

    ``lines`` has ``normalized``; of several aliases (languages) the least (language, alias_id) wins.
    """
    pick = F.min(F.struct("language", "alias_id", "product_id"))
    keyed = aliases.groupBy(*SCOPE, "normalized").agg(pick.alias("hit"))
    keyed = keyed.select(*SCOPE, "normalized", F.col("hit.product_id").alias("resolved_product_id"))
    return lines.join(keyed, [*SCOPE, "normalized"], "left")


def token_similarity_pairs(left: DataFrame, right: DataFrame, scope: tuple[str, ...], threshold: float) -> DataFrame:
    """Pairs (lid, rid, jaccard) of one scope whose word sets have at least this Jaccard similarity.

    Exact, by prefix filtering: with the words of a text ordered from the rarest, two texts that
    similar must share a word among the first n - ceil(threshold * n) + 1 of each. ``left`` has
    (lid, scope, normalized) and ``right`` (rid, scope, normalized). Empty texts are in no pair.
    """
    both = left.select(*scope, "normalized").unionByName(right.select(*scope, "normalized"))
    words = both.select(F.explode(F.array_distinct(tokens(F.col("normalized")))).alias("word"))
    rarity = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(side: DataFrame, key: str) -> DataFrame:
        each = side.select(key, *scope, F.explode(F.array_distinct(tokens(F.col("normalized")))).alias("word"))
        ordered = each.join(rarity, "word").groupBy(key, *scope)
        # one text's words: bounded by the text itself
        ordered = ordered.agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ws"))
        n = F.size("ws")
        keep = (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int")
        return ordered.select(key, *scope, F.explode(F.slice("ws", F.lit(1), keep)).alias("w")).select(key, *scope, "w.word")

    hits = prefixes(left, "lid").join(prefixes(right, "rid"), [*scope, "word"]).select("lid", "rid").distinct()
    texts = hits.join(left.select("lid", F.col("normalized").alias("a")), "lid")
    texts = texts.join(right.select("rid", F.col("normalized").alias("b")), "rid")
    scored = texts.select("lid", "rid", token_jaccard(F.col("a"), F.col("b")).alias("jaccard"))
    return scored.filter(F.col("jaccard") >= threshold - 1e-12)


def top_k(scored: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    """The k best items of each query, their rank and the margin of the first to the second."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    # the limit stands before the look at the runner-up, so each task keeps its best alone
    best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(k, 2))
    ranked = best.withColumn("__next", F.lead(score).over(w))
    margin = F.when(F.col("rank") == 1, F.round(F.col(score) - F.coalesce("__next", F.lit(0.0)), 6))
    return ranked.withColumn("margin", margin).filter(F.col("rank") <= k).drop("__next")


def _evidence(pairs: DataFrame, lexical: Column, semantic: Column | None, weight: float) -> DataFrame:
    a, b = F.col("q_normalized"), F.col("normalized")
    said = extract_attributes(a)
    held = F.from_json("attributes_json", "map<string,string>")
    conflicts = conflicting_attributes(said, held)
    category = F.coalesce(F.try_element_at(said, F.lit("category_hint")) == F.col("category"), F.lit(False))
    read = pairs.withColumns(
        {
            "lexical": lexical,
            "token": token_jaccard(a, b),
            "trigram": ngram_jaccard(a, b),
            "conflict": F.size(conflicts) > 0,
            "same_category": category,
        }
    )
    score = hybrid_score(*[F.col(c) for c in ("lexical", "token", "trigram", "conflict", "same_category")], semantic, weight)
    return read.withColumn("score", score)


def hybrid_search(
    lines: DataFrame,
    aliases: DataFrame,
    k: int = 5,
    lexical: bool = True,
    min_token: float | None = None,
    semantic: DataFrame | None = None,
    weight: float = 0.2,
) -> DataFrame:
    """The k best products of each distinct query text of a scope.

    ``lines`` has (query_id, scope, q_normalized), ``aliases`` the columns of
    :func:`approved_aliases` and ``normalized``. Without ``min_token`` every alias of the scope
    is compared, in blocks (:func:`best_pairs`); with it, candidates come from the exact similarity
    join of that token threshold. ``semantic`` has (query_id, product_id, semantic); with it and
    without ``min_token`` every pair of a scope is made, which suits scopes of bounded size.
    The best alias of a product is the one of the highest score, then the least normalised text.
    """
    queries = lines.select("query_id", *SCOPE, "q_normalized").dropDuplicates(["query_id"])
    held = aliases.select(*SCOPE, "alias_id", "normalized", "product_id", "category", "attributes_json")
    blocks = min_token is None and semantic is None
    if blocks:
        pairs = best_pairs(queries, held, SCOPE, max(k, 2), lexical)
    elif min_token is None:
        pairs = queries.join(held, list(SCOPE))
    else:
        near = token_similarity_pairs(
            queries.select(F.col("query_id").alias("lid"), *SCOPE, F.col("q_normalized").alias("normalized")),
            held.select(F.col("alias_id").alias("rid"), *SCOPE, "normalized"),
            SCOPE,
            min_token,
        )
        pairs = near.select(F.col("lid").alias("query_id"), F.col("rid").alias("alias_id"))
        pairs = pairs.join(queries, "query_id").join(held.drop(*SCOPE), "alias_id")
    if semantic is not None:
        pairs = pairs.join(semantic, ["query_id", "product_id"], "left")
    like = sequence_similarity(F.col("q_normalized"), F.col("normalized")) if lexical else F.lit(0.0)
    scored = pairs if blocks else _evidence(pairs, like, None if semantic is None else F.col("semantic"), weight)
    best = Window.partitionBy("query_id", "product_id").orderBy(F.desc("score"), "normalized", "alias_id")
    per_product = scored.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")
    kept = per_product.select("query_id", "product_id", F.col("normalized").alias("matched_alias"), "score", "token", "trigram", "conflict")
    return top_k(kept, "query_id", "product_id", "score", k)


def _chunks(side: DataFrame, rows: int) -> DataFrame:
    """Vectors as matrices: (ids, width, data) of at most ``rows`` vectors of one length, made where they are read."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["embedding"].map(len)
            for width, part in batch.groupby(lengths):
                for at in range(0, len(part) if width else 0, rows):
                    some = part.iloc[at : at + rows]
                    data = np.stack(some["embedding"].to_numpy()).astype(np.float64).tobytes()
                    yield pd.DataFrame({"ids": [some["vec_id"].to_numpy(np.int64)], "width": [width], "data": [data]})

    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    return side.filter(whole).select("vec_id", "embedding").mapInPandas(pack, "ids array<bigint>, width int, data binary")


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = 256, rows: int = 2048) -> DataFrame:
    """The k nearest vectors of each query by cosine, the query itself left out.

    Both sides have (vec_id, embedding). The stated queries are dealt into blocks of bounded size
    and every matrix of vectors meets each block once, as one matrix product that keeps k rows a
    query. Zero vectors, vectors with nulls and vectors of another length have no cosine and are
    in no result.
    """
    n = max(1, math.ceil(queries.count() / block))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n))).repartition(n, "block")
    q = _chunks(dealt.drop("block"), block).select(F.col("ids").alias("q_ids"), "width", F.col("data").alias("q"))
    # the queries, a small share of the rows, go to every group of matrices, not the matrices to every block
    groups = max(1, math.ceil(vectors.count() / (rows * GROUP_CHUNKS)))
    q = q.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    v = _chunks(vectors, rows).withColumn("group", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(groups)).cast("int"))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_ids, ids, width, a, b in batch[["q_ids", "ids", "width", "q", "data"]].itertuples(index=False, name=None):
                left, right = (np.frombuffer(x, dtype=np.float64).reshape(-1, width) for x in (a, b))
                norms = np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine = np.round(left @ right.T / norms, 6)
                cosine[(norms == 0) | (np.asarray(q_ids)[:, None] == np.asarray(ids)[None, :])] = np.nan
                for i, name in enumerate(q_ids):
                    there = np.flatnonzero(~np.isnan(cosine[i]))
                    best = there[np.lexsort((ids[there], -cosine[i][there]))[:k]]
                    yield pd.DataFrame({"query_id": name, "vec_id": ids[best], "cosine": cosine[i][best]})

    pairs = v.join(q, ["group", "width"])
    scored = pairs.mapInPandas(nearest, "query_id bigint, vec_id bigint, cosine double")
    return top_k(scored, "query_id", "vec_id", "cosine", k)
