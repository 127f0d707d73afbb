import itertools
import random

import pytest

from billweave.llm.matching import banding_recall, edit_distance, gram_hashes, min_hash_bands, tune_bands
from billweave.llm.names import PERSON_BANDS, PERSON_SIMILARITY, RECALL, ROWS, SLIP_SIMILARITY, party_pairs, read_organisation

PARTY = "party_id bigint, name string, contact_name string"


def linked(spark, names):
    df = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], PARTY)
    return {(a, b) for f, a, b in (tuple(r) for r in party_pairs(df).collect()) if f == "name"}


PAIRS = [("worukomux", "wovukmoux"), ("fdiegetun", "fiidegetun"), ("sekottupul", "sesotupul"), ("deagawa", "deraiawa"), ("lweetumal", "lewetuaml")]


@pytest.mark.parametrize("a, b", PAIRS)
def test_bands_meet_two_slips(a, b):
    keys = min_hash_bands([a, b], tune_bands(SLIP_SIMILARITY, ROWS, RECALL), ROWS)
    assert edit_distance(a, b) == 2 and (keys[0] == keys[1]).any()


def test_two_slips_without_a_common_form(spark):
    names = [f"{stem} Energy GmbH" for pair in PAIRS for stem in pair]
    assert linked(spark, names) == {(2 * i, 2 * i + 1) for i in range(len(PAIRS))}


def test_two_slips_give_way_to_a_nearer_name(spark):
    # 0-2 and 3-5 are two organisations four slips apart, 6 and 7 one spelling of each, two slips apart
    names = ["Nadomavul Toys AG"] * 3 + ["Namokagux Toys AG"] * 3 + ["Nadokavul Toys AG", "Namokavux Toys AG"]
    got = linked(spark, names)
    assert got == set(itertools.combinations((0, 1, 2, 6), 2)) | set(itertools.combinations((3, 4, 5, 7), 2))


def test_legal_form_without_blanks():
    assert read_organisation("Gutamehar Machinery GmbH&Co.KG")[:2] == ("gutamehar", "machinery")


def test_short_names_that_differ_in_a_letter_stay_apart(spark):
    assert linked(spark, ["ABC Energy GmbH", "ABD Energy GmbH", "A.B.C. Energy", "Rotu Toys AG", "Rotuu Toys AG"]) == {(0, 2), (3, 4)}


def test_bands_of_people_follow_the_collision_curve():
    a, b = (set(gram_hashes(x, 2).tolist()) for x in ("hibika", "hubike"))
    assert PERSON_SIMILARITY <= len(a & b) / len(a | b)
    assert banding_recall(PERSON_SIMILARITY, PERSON_BANDS, 1) >= RECALL > banding_recall(PERSON_SIMILARITY, 8, 1)


def test_branches_of_trade_are_learned(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).title() for _ in range(30)]
    names = [f"{x} Solar Ltd" for x in stems] + [f"{stems[0]} Solar", f"{stems[1]} Nuclear Inc", f"{stems[2]}", f"{stems[3]} SOLAR LLC"]
    assert linked(spark, names) == {(0, 30), (3, 33)}


def slip(rng, word):
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :]])


def test_recall_and_precision_on_labelled_variants(spark):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(n))
    names, label = [], []
    for i in range(200):
        stem, trade = make(4), rng.choice(["Energy", "Toys", "Foods", "Optics"])
        for _ in range(4):
            spelt = slip(rng, stem) if rng.random() < 0.3 else stem
            words = [spelt.title(), slip(rng, trade) if rng.random() < 0.15 else trade]
            names.append(" ".join(words if rng.random() < 0.8 else words[::-1]) + rng.choice(["", " GmbH", " Ltd", " AG - Einkauf"]))
            label.append(i)
    truth = {(a, b) for a, b in itertools.combinations(range(len(names)), 2) if label[a] == label[b]}
    got = linked(spark, names)
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.99 * len(got)
