import random

import pandas as pd

from billweave.operators import retrieval as R
from billweave.operators import scope_search as B

ALIAS = "tenant_id string, partner_id string, alias_id string, normalized string, product_id string, category string, attributes_json string"
ASKED = "query_id string, tenant_id string, partner_id string, q_normalized string"
WORDS = ["black", "white", "tee", "t shirt", "socks", "steel", "cotton", "crew", "ab", "abab", "pack", "of", "12", "x3", "ümlaut", "mug"]


def odd_scope(spark, queries, aliases):
    """Equal scores, short, long, empty and missing texts, conflicts, broken attributes, an empty scope."""
    draw = random.Random(5)

    def text():
        kind = draw.random()
        fixed = {0: None, 1: "", 2: "a", 3: "ab" * 160, 4: "tee " * 150 + "black"}
        return fixed[draw.randrange(5)] if kind < 0.1 else " ".join(draw.choices(WORDS, k=draw.choice([1, 2, 3, 5, 20])))

    stated = ["{}", '{"color": "black"}', '{"color": "white", "material": "steel"}', '{"color": null}', "broken", None]
    held = []
    for i in range(aliases):
        held.append(("t", draw.choice("pq"), f"a{i}", text(), f"P{draw.randrange(aliases // 3):03d}", draw.choice(["t-shirt", "socks", None]), draw.choice(stated)))
    asked = [(f"q{i}", "t", draw.choice("ppqqr"), text()) for i in range(queries)]
    return spark.createDataFrame(asked, ASKED), spark.createDataFrame(held, ALIAS)


def compare(spark, asked, held, lexical):
    """Both ways of the search: in blocks, and over every pair (semantic scores are given, but of no product)."""
    none = spark.createDataFrame([], "query_id string, product_id string, semantic double")
    columns = ("query_id", "rank", "product_id", "matched_alias", "score", "margin", "token", "trigram", "conflict")
    want, got = ([tuple(r) for r in R.hybrid_search(asked, held, 5, lexical, semantic=s).select(*columns).collect()] for s in (none, None))
    key = lambda r: r[:2]
    assert want and sorted(got, key=key) == sorted(want, key=key)


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    asked, held = odd_scope(spark, 60, 300)
    compare(spark, asked, held, True)
    monkeypatch.setattr(B, "BLOCK", 9)
    monkeypatch.setattr(B, "CHUNK", 40)
    compare(spark, asked, held, True)


def plan_of(found):
    return found._jdf.queryExecution().executedPlan().toString()


def test_full_score_makes_no_row_for_each_pair(spark):
    asked, held = odd_scope(spark, 10, 30)
    plan = plan_of(R.hybrid_search(asked, held, 5))
    assert "FlatMapCoGroupsInPandas" in plan and "_ratio(" not in plan


def test_few_sequence_ratios(monkeypatch):
    """Of a scope of 3,000 aliases only those whose bound reaches the fifth product are compared by their blocks."""
    draw, calls, matcher = random.Random(1), [], B.SequenceMatcher
    names = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(400)]
    texts = [" ".join(draw.choices(names, k=4)) for _ in range(3000)]
    aliases = pd.DataFrame({"normalized": texts, "product_id": sorted(f"P{i}" for i in range(3000)), "stated": [[None] * 5] * 3000})
    asked = pd.DataFrame({"q_normalized": texts[:20], "said": [[None] * 5] * 20})
    monkeypatch.setattr(B, "SequenceMatcher", lambda *args: calls.append(1) or matcher(*args))
    chunk = B._Chunk(asked, aliases, 5, True)
    assert all(texts[next(chunk.best(q))[0]] == texts[q] for q in range(20))
    assert len(calls) < 20 * 100


def test_native_blocks_give_what_all_pairs_give(spark, monkeypatch):
    asked, held = odd_scope(spark, 60, 300)
    compare(spark, asked, held, False)
    monkeypatch.setattr(B, "BLOCK", 9)
    monkeypatch.setattr(B, "CHUNK", 40)
    compare(spark, asked, held, False)


def test_native_score_makes_no_row_for_each_pair(spark):
    asked, held = odd_scope(spark, 10, 30)
    assert "FlatMapCoGroupsInPandas" in plan_of(R.hybrid_search(asked, held, 5, lexical=False))
