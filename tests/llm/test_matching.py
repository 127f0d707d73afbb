import itertools
import random

import pytest
from pyspark.sql import functions as F

from billweave.llm.addresses import building_pairs, read_address
from billweave.llm.catalogue import map_to_catalogue
from billweave.llm.items import heaviest_matching, item_pairs, match_sellers, merge_matches, one_seller
from billweave.llm.listings import Listing, read_listing, read_product
from billweave.llm.matching import banding_recall, edit_distance, edit_distances, min_hash_bands, monge_elkan, nearest, star_clusters, tune_bands
from billweave.llm.names import first_names_agree, party_pairs, read_organisation, read_person


def test_edit_distance_against_brute_force():
    rng = random.Random(1)

    def slow(a, b):
        best = {(0, 0): 0}
        for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
            options = [best[i - 1, j] + 1] if i else []
            options += [best[i, j - 1] + 1] if j else []
            options += [best[i - 1, j - 1] + (a[i - 1] != b[j - 1])] if i and j else []
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                options.append(best[i - 2, j - 2] + 1)
            best[i, j] = min(options, default=0)
        return best[len(a), len(b)]

    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(2))
        assert edit_distance(a, b, 2) == min(slow(a, b), 3)
    texts = [["".join(rng.choice("abc") for _ in range(rng.choice((0, 3, 9, 64, 66)))) for _ in range(40)] for _ in range(2)]
    assert edit_distances(*texts).tolist() == [slow(a, b) for a, b in zip(*texts)]
    assert nearest("sokc", {"sock": "s", "tee": "t"}, 1) == "s" and nearest("bat", {"cat": "c", "hat": "h"}, 1) is None
    assert monge_elkan([["a", "bb"], []], [["bb", "a"], ["a"]]).tolist() == [1, 0]


def test_bands_follow_the_collision_curve():
    assert banding_recall(0.5, 1, 1) == 0.5 and banding_recall(0.5, tune_bands(0.5, 3, 0.98), 3) >= 0.98
    rng = random.Random(2)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(400)]
    slips = [w[:3] + w[4] + w[3] + w[5:] for w in words]
    bands = tune_bands(0.4, 3, 0.98)
    a, b = min_hash_bands(words, bands, 3), min_hash_bands(slips, bands, 3)
    assert (a == b).any(axis=1).mean() > 0.95 and (a == min_hash_bands(words, bands, 3)).all()
    assert min_hash_bands(["", "x"], 2, 2).shape == (2, 2)


def test_star_clusters(spark):
    nodes = spark.createDataFrame([(i, w) for i, w in enumerate([5, 1, 1, 4, 1, 1, 1])], "id bigint, weight bigint")
    edges = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (0, 2, 0.8), (3, 4, 0.9), (2, 3, 0.7), (4, 5, 0.5)], "id_a bigint, id_b bigint, score double")
    got = {r.id: r.center for r in star_clusters(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}
    assert star_clusters(nodes, edges.limit(0)).filter("id <> center").count() == 0


@pytest.mark.parametrize(
    "lines, want",
    [
        (["Nofigohof-Ring 74 - Hinterhaus - 17095 Wamimeau"], ("nofigohof", "ring", "74", "17095", ["wamimeau"])),
        (["No. 117 Stibreramere Boulevard, 52091, NI"], ("stibreramere", "boulevard", "117", "52091", ["ni"])),
        (["13398 Brarosoheim", "Modanothalg. 53"], ("modanothal", "g", "53", "13398", ["brarosoheim"])),
        (["Timipofordpl. 129 A", "13102 Fekanekirch", "Testern"], ("timipoford", "pl", "129a", "13102", ["fekanekirch", "testern"])),
        (["6, Barahowick Ave", "Gate B", "28146", "NI"], ("barahowick", "ave", "6", "28146", ["ni"])),
        (["Lotolefordstr 44", "KS-91030 Nigitaheim"], ("lotoleford", "str", "44", "91030", ["nigitaheim"])),
        (["2nd floor", "49 Stosefeld Sqaure", "Tawasloham"], ("stosefeld", "sqaure", "49", "", ["tawasloham"])),
        (["pick-up"], None), ([], None), (["same as billing"], None), (["", None], None),
    ],
)
def test_read_address(lines, want):
    assert read_address(lines) == want


def test_building_pairs(spark):
    rows = [
        (1, '["Ralofordstraße 7", "17005 Wamimeau"]'), (2, '["RALOFORDSTR. 7, WAMIMEAU"]'), (3, '["Ralofordstrasse Nr. 7", "2nd floor", "17005"]'),
        (4, '["Ralofrodstr 7", "17005 Wamimaeu"]'), (5, '["Ralofordstraße 7a", "17005 Wamimeau"]'), (6, '["Ralofordweg 7", "17005 Wamimeau"]'),
        (7, '["Ralofordstraße 7", "22005 Andertown"]'), (8, None), (9, "[]"), (10, '["pick-up"]'), (11, "not json"), (12, '["Ralofordstraße 7", "17005 Wamimeau"]'),
        (13, '["' + "x" * 50_000 + '"]'),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "party_id bigint, address_lines_json string, building int")
    got = {tuple(r) for r in building_pairs(df).collect()}
    assert got == set(itertools.combinations([1, 2, 3, 4, 12], 2))
    assert building_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "name, want",
    [
        ("Gutamehar Energy GmbH & Co. KG (Purchasing)", ("gutamehar", "energy")), ("Light'g Vateguban L.L.C.", ("vateguban", "lighting")),
        ("lakatufomachenery gmbh", ("lakatufo", "machinery")), ("Dabo Sugur Engineering Corp.", ("dabosugur", "engineering")),
        ("The VumuvofulBkry LLC", ("vumuvoful", "bakery")), ("Lesetewu R.E. AG", ("lesetewu", "real estate")), ("Firma Zamuro Insturments S.A. - Head Office", ("zamuro", "instruments")),
        ("n/a", None), ("(blank)", None), ("-", None), ("Walk-in", None), (None, None),
    ],
)
def test_read_organisation(name, want):
    got = read_organisation(name)
    assert (got and got[:2]) == want


@pytest.mark.parametrize(
    "contact, want",
    [
        ("Tapaluck, Theodor", ("tapaluck", "theodor", "")), ("Attn: Bob M. Vibiwa", ("vibiwa", "robert", "m")), ("Dr. Hibika", ("hibika", "", "")),
        ("z.Hd. Schudatu", ("schudatu", "", "")), ("Mifuren I.", ("mifuren", "i", "")), ("HANNES SCHATERAN", ("schateran", "johannes", "")), ("n/a", None), (None, None), ("", None),
    ],
)
def test_read_person(contact, want):
    assert read_person(contact) == want


def test_party_pairs(spark):
    rows = [
        (1, "Gutamehar Energy GmbH", "Theodor Tapaluck"), (2, "GUTAMEHAR ENRGY", "Tapaluck, Teddy"), (3, "Gutameahr Energy Ltd", "T. Tapaluck"),
        (4, "Gutamehar Foods GmbH", "Theodor Tapaluck"), (5, "unknown", "Theodor Tapaluck"), (6, None, "Theodor Tapaluck"), (7, "Energy Gutamehar, Einkauf", "Alex Tapaluck"),
        (8, "Gutamehar Energy GmbH", None), (9, "Bobosusin Toys AG", "n/a"), (10, "x" * 20_000, "y" * 20_000),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "party_id bigint, name string, contact_name string, organisation string")
    got = {tuple(r) for r in party_pairs(df).collect()}
    assert {(a, b) for f, a, b in got if f == "name"} == set(itertools.combinations([1, 2, 3, 7, 8], 2))
    assert {(a, b) for f, a, b in got if f == "contact_name"} == {(1, 2), (1, 3), (2, 3)}
    assert party_pairs(df.limit(0)).count() == 0 and first_names_agree(["t", "alexander", ""], ["theodor", "theodor", "x"]).tolist() == [True, False, True]


def test_read_listing():
    assert read_listing("hot deal!! Modelling Paste silver 500g (KT-RUTQ5)") == Listing("clay", "", "silver", "g:500", "", "", "ktrutq5")
    assert read_listing("Poteko Fodafives Gloves Gr. M prpl x12") == Listing("gloves", "poteko fodafives", "purple", "", "m", "12", "")
    assert read_listing("EU36 Dalamas Stocikngs, 1 dozen, 0,25 kW") == Listing("socks", "dalamas", "", "w:250", "eu:36", "12", "")
    assert read_listing(None) == read_listing("") == Listing(*[""] * 7)
    said = read_product("Sobite Milonapis Bottle", '{"content": "5 l", "pack_size": "3", "col": "grn", "article": "MN-4WCY3", "material": "steel"}')
    assert said == Listing("bottle", "sobite milonapis", "green", "ml:5000", "", "3", "mn4wcy3") and read_product("Zavino", "not json").names == "zavino"


PRODUCTS = "product_id string, tenant_id string, partner_id string, canonical_description string, attributes_json string, kind string"


def products(spark):
    rows = [
        ("1", "t", "p", "Vetapax Megapopa Mug 1 l Purple", "{}"), ("2", "t", "p", "Megapopa Mug 1 l Purple Pack of 2", '{"mpn": "MG-5BJQK"}'),
        ("3", "t", "p", "Megapopa Mug 500 ml Purple", None), ("4", "t", "q", "Megapopa Mug", '{"volume": "1000 ml", "col": "prpl"}'), ("5", "t", "q", None, None), ("6", None, "q", "Megapopa Mug", None),
    ]
    return spark.createDataFrame([(*r, "own") for r in rows], PRODUCTS)


def test_map_to_catalogue(spark):
    rows = [
        ("a", "t", "p", "Megapopa Cup, purple tone, 1L"), ("b", "t", "p", "MEGAPPOA MUG 2-PACK 100 CL"), ("c", "t", "p", "Mug #MG5BJQK"), ("d", "t", "p", "Megapopa Mug 2 l"),
        ("e", "t", "p", "Megapopa Mug green 1l"), ("f", "t", "q", "megapopa mug"), ("g", "u", "q", "megapopa mug"), ("h", "t", "p", None), ("i", "t", "p", ""), ("j", "t", "p", "Freight"),
        ("k", None, "q", "Megapopa Mug"), ("l", "t", "p", "x " * 20_000), ("a", "t", "p", "Megapopa Cup, purple tone, 1L"),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "k string, tenant_id string, partner_id string, names string, qid string")
    got = sorted(tuple(r) for r in map_to_catalogue(df, products(spark), "k", "names").collect())
    want = {"a": "1", "b": "2", "c": "2", "f": "4"}
    assert got == sorted((r[0], want.get(r[0], "")) for r in rows)
    assert {r.product_id for r in map_to_catalogue(df, products(spark).limit(0), "k", "names").collect()} == {""}
    assert map_to_catalogue(df.limit(0), products(spark), "k", "names").count() == 0


def test_heaviest_matching_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        w = [[float(rng.choice([0, 0, 1, 2, 3, 5])) for _ in range(m)] for _ in range(n)]
        got = heaviest_matching(w)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and all(w[i][j] > 0 for i, j in got)
        small, big = sorted((n, m))
        best = max(sum(w[i][j] if n <= m else w[j][i] for i, j in enumerate(p)) for p in itertools.permutations(range(big), small))
        assert sum(w[i][j] for i, j in got) == best
    assert heaviest_matching([]) == []


def test_one_seller():
    full, part, blue, other = ("red", "ml:500", "", "1", ""), ("red", "", "", "1", "x1"), ("blue", "ml:500", "", "1", ""), ("", "ml:500", "", "1", "")
    assert len(set(one_seller([full, part], [1, 1]))) == 1
    assert one_seller([full, blue, other], [1, 1, 1]) == [0, 1, 2]  # fits two, so it stays by itself
    assert one_seller([other, full], [9, 1]) == [1, 1]


def test_match_sellers_by_component():
    pairs = [("a", "x", 3.0), ("a", "y", 2.0), ("b", "x", 2.5), ("c", "z", 1.0)]
    assert sorted(match_sellers(pairs)) == [("a", "y", 2.0), ("b", "x", 2.5), ("c", "z", 1.0)]
    assert match_sellers([]) == []


def test_merge_matches_closes_cycles():
    red = ("red", "", "", "1", "")
    edge = lambda a, b, w=3.0: (a, b, w, 2, a[0], b[0], red, red)
    whole = merge_matches([edge("a1", "b1"), edge("b1", "c1"), edge("a1", "c1")])
    assert len(set(whole.values())) == 1 and whole.keys() == {"a1", "b1", "c1"}
    # b1 and c1 belong together, but a1 is matched with c2 and not with c1: two sides of one seller never merge
    split = merge_matches([edge("a1", "b1", 4.0), edge("b1", "c1"), edge("a1", "c2", 4.0)])
    assert split["a1"] == split["b1"] == split["c2"] != split["c1"]
    blue = ("blue", "", "", "1", "")
    apart = merge_matches([("a1", "b1", 1.0, 2, "a", "b", red, ("", "", "", "1", "")), ("b1", "c1", 1.0, 1, "b", "c", ("", "", "", "1", ""), blue)])
    assert apart["a1"] == apart["b1"] != apart["c1"]
    assert merge_matches([]) == {}


def test_item_pairs(spark):
    rows = [
        (1, "t", "r", "Vetapax Megapopa Cup purple 1 l"), (2, "t", "s", "megapopa mug 1000ml prpl hot deal!!"), (3, "t", "s", "Megapopa Mug purple 2 pcs 1 l"), (4, "u", "s", "megapopa mug 1 l purple"),
        (5, "t", "s", None), (6, "t", "s", ""), (7, "t", "r", "Vetapax Megapopa Cup purple 1 l"), (8, "t", "s", "Dosovi Zavino Sock EU 40"), (9, "t", "r", "Zavino Stockings size 40"), (10, None, "s", "megapopa mug 1 l purple"),
        (11, "t", "s", "y " * 20_000),
    ]
    lines = spark.createDataFrame([(*r, "own") for r in rows], "line_id bigint, tenant_id string, partner_id string, description string, kind string")
    got = {tuple(r) for r in item_pairs(lines, products(spark)).collect()}
    one, two, sock = ["L1", "L2", "L7", "P1", "P4"], ["L3", "P2"], ["L8", "L9"]
    assert got == {tuple(sorted(p)) for group in (one, two, sock) for p in itertools.combinations(group, 2)}
    assert item_pairs(lines.limit(0), products(spark).limit(0)).count() == 0


ITEM = "line_id bigint, tenant_id string, partner_id string, description string"


def test_items_of_any_vocabulary(spark):
    rows = [
        (1, "t", "r", "handmade Megapopa mug purple 1 l"), (2, "t", "s", "handmade Zavino mug purple 1 l"),
        (3, "t", "r", "Logitech Mouse M185 grey"), (4, "t", "s", "Mouse Logitech M185, grey"), (5, "t", "s", "Logitech Keyboard K120 grey"),
        (6, "t", "r", "Abo mug green 3 l"), (7, "t", "s", "green Abo cup 3 l"), (8, "u", "r", "Megapopa Vest Mobuko M"), (9, "u", "s", "Mobuko Gilet M"),
    ]
    got = {tuple(r) for r in item_pairs(spark.createDataFrame(rows, ITEM), products(spark).limit(0)).collect()}
    assert got == {("L3", "L4"), ("L6", "L7"), ("L8", "L9")}


def test_queries_run(spark, sf):
    from billweave.llm.queries import QUERIES

    columns = {"p1_found": ["key_a", "key_b"], "p2_found": ["source_key", "product_id"], "p3_found": ["key_a", "key_b"], "p4_found": ["party_id_a", "party_id_b"],
               "p5_found": ["field", "party_id_a", "party_id_b"], "p7_ids": ["doc_id", "ids"]}
    for name, wanted in columns.items():
        df = QUERIES[name](spark, sf)
        assert df.columns == wanted and df.count() > 0
        if name in ("p1_found", "p3_found", "p4_found"):
            a, b = wanted
            assert df.filter(F.col(a) >= F.col(b)).count() == 0 and df.distinct().count() == df.count()
