import itertools
import random

import pandas as pd
import pytest

from billweave.llm.addresses import _verify, alignment_costs, building_pairs, read_address
from billweave.llm.matching import candidate_pairs

FIELDS = ["street", "kind", "number", "place"]


def accepted(a, b):
    return bool(_verify(pd.DataFrame([a], columns=FIELDS), pd.DataFrame([b], columns=FIELDS))[0] > 0)


def test_the_alignment_bound_decides():
    assert not accepted(("ab", "street", "7", "town"), ("ac", "street", "7", "town"))
    assert accepted(("raloford", "street", "7", "town"), ("ralofrod", "st", "7", "town"))
    assert accepted(("nofigohof", "", "7", "town"), ("nofigohfo", "ring", "7", "town"))
    assert not accepted(("raloford", "street", "7", "town"), ("raloford", "street", "8", "town"))
    assert not accepted(("raloford", "weg", "7", "town"), ("raloford", "ring", "7", "town"))
    assert accepted(("raloford", "sqaure", "7a", "town"), ("raloford", "sq", "7a", "town"))
    assert not accepted(("raloford", "str", "7a", "town"), ("raloford", "str", "7", "town"))


def brute(a, b):
    """Every way to align two token lists, by recursion over (i, j, last step)."""
    from billweave.llm.addresses import EXTENDED, OMITTED, OPENED, _meaning, _swap_costs

    def best(i, j, last):
        if i == len(a) and j == len(b):
            return 0.0
        found = []
        if i < len(a) and j < len(b):
            found.append(float(_swap_costs([(a[i], b[j])])[0]) + best(i + 1, j + 1, "m"))
        for side, k, step, other in ((a, i, "a", "b"), (b, j, "b", "a")):
            if k < len(side) and last != other:
                cost = EXTENDED if last == step else OMITTED if _meaning(side[k])[0] else OPENED
                found.append(cost + best(i + (step == "a"), j + (step == "b"), step))
        return min(found, default=1e9)

    return best(0, 0, "m")


def test_alignment_against_brute_force():
    rng = random.Random(3)
    words = ["raloford", "ralofrod", "str", "street", "weg", "7", "8a", "town", "twon", "sqaure"]
    lists = [[rng.choice(words) for _ in range(rng.randrange(0, 5))] for _ in range(160)]
    got = alignment_costs(lists[:80], lists[80:])
    assert got == pytest.approx([brute(a, b) for a, b in zip(lists[:80], lists[80:])])


def test_other_forms_of_codes():
    assert read_address(["10 Downing Street", "London SW1A 2AA"]) == ("downing", "street", "10", "sw1a2aa", ["london"])
    assert read_address(["Ringweg 4", "1234 AB Delft"]) == ("ring", "weg", "4", "1234ab", ["delft"]) or read_address(["Ringweg 4", "1234 AB Delft"])[3] == "1234ab"


def slip(rng, word):
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :]])


def variants(spark, buildings=150, each=4, seed=4):
    """Labelled writings of drawn addresses: slips, abbreviations, order, missing parts."""
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(n))
    towns = [(make(3).title() + "stadt", f"{rng.randrange(10, 99)}{i:01d}") for i in range(8)]
    kinds = [("Street", "St."), ("Road", "Rd"), ("Avenue", "Ave"), ("Square", "Sq")]
    rows, label = [], {}
    for b in range(buildings):
        street, (kind, short), (town, code), number = make(4).title(), rng.choice(kinds), rng.choice(towns), rng.randrange(1, 200)
        code += f"{rng.randrange(100):02d}"
        for _ in range(each):
            name = slip(rng, street) if rng.random() < 0.3 else street
            lines = [f"{number} {name} {rng.choice([kind, short])}", rng.choice([f"{code} {town}", f"{town} {code}", code, f"{code} {slip(rng, town)}"])]
            if rng.random() < 0.3:
                lines.insert(rng.randrange(2), rng.choice(["2nd floor", "Gate B", "Attn. Warehouse"]))
            rows.append((len(rows), "[" + ", ".join(f'"{x}"' for x in lines) + "]"))
            label[rows[-1][0]] = b
    truth = {(i, j) for i, j in itertools.combinations(label, 2) if label[i] == label[j]}
    return spark.createDataFrame(rows, "party_id bigint, address_lines_json string"), truth


def test_recall_and_precision_on_labelled_variants(spark):
    df, truth = variants(spark)
    got = {tuple(r) for r in building_pairs(df).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.99 * len(got)


def test_hot_bands_lose_no_pair(spark):
    from pyspark.sql import functions as F

    forms = spark.createDataFrame([(i, f"v{i}") for i in range(60)], "id bigint, v string")
    keys = F.array(F.lit(1), F.col("id") % 3 + 10)
    want = {(a, b) for a, b in itertools.combinations(range(60), 2)}
    for hot in (7, 512):
        pairs = [tuple(r) for r in candidate_pairs(forms, keys, "v", hot=hot).select("id_a", "id_b", "v_a", "v_b").collect()]
        assert {p[:2] for p in pairs} == want and all(p[2:] == (f"v{p[0]}", f"v{p[1]}") for p in pairs)
    assert len(pairs) == len(want) + 3 * 190
