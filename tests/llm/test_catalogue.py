from billweave.llm.catalogue import map_to_catalogue

PRODUCTS = "product_id string, tenant_id string, partner_id string, canonical_description string, attributes_json string"


def test_a_text_that_fits_several_variants_names_none(spark):
    products = spark.createDataFrame(
        [
            ("1", "t", "p", "Megapopa Mug 1 l Red", None), ("2", "t", "p", "Megapopa Mug 1 l Blue", None), ("3", "t", "p", "Megapopa Mug 2 l Red", None),
            ("4", "t", "q", "Megapopa Mug 1 l Red", None), ("5", "t", "q", "Megapopa Mug Red", '{"volume": "1000 ml"}'), ("6", "t", "q", "Megapopa Mug 1 l Blue", None),
        ],
        PRODUCTS,
    )
    rows = [("a", "t", "p", "megapopa mug 1 l"), ("b", "t", "p", "megapopa mug red 1 l"), ("c", "t", "p", "megapopa mug 2 l"), ("d", "t", "q", "megapopa mug red"), ("e", "t", "q", "megapopa mug 1 l")]
    values = spark.createDataFrame(rows, "k string, tenant_id string, partner_id string, text string")
    got = dict(tuple(r) for r in map_to_catalogue(values, products, "k", "text").collect())
    assert got == {"a": "", "b": "1", "c": "3", "d": "4", "e": ""}


def test_a_tie_between_variants_names_none_however_often_one_is_held(spark):
    rows = [("1", "t", "p", "Megapopa Mug purple 1 l", None), ("2", "t", "p", "Megapopa Mug purple 1 l", None), ("3", "t", "p", "Megapopa Mug green 1 l", None), ("4", "t", "p", "Zavino Mug 1 l", None)]
    products = spark.createDataFrame(rows, PRODUCTS)
    asked = [("a", "t", "p", "Megapopa mug"), ("b", "t", "p", "Megapopa mug purple"), ("c", "t", "p", "Megabopa cup green 1000 ml"), ("d", "t", "p", "Zavinu mug"), ("e", "t", "p", "Kolumbo mug 1 l")]
    values = spark.createDataFrame(asked, "k string, tenant_id string, partner_id string, text string")
    got = dict(tuple(r) for r in map_to_catalogue(values, products, "k", "text").collect())
    assert got == {"a": "", "b": "1", "c": "3", "d": "4", "e": ""}


def test_kinds_outside_the_list(spark):
    rows = [("1", "t", "p", "Logitech Mouse M185", None), ("2", "t", "p", "Logitech Keyboard K120", None), ("3", "t", "p", "Abo Mug 1 l", None)]
    asked = [("a", "t", "p", "mouse logitech M185 grey"), ("b", "t", "p", "K120 keyboard"), ("c", "t", "p", "Abo mug"), ("d", "t", "p", "Logitech M186")]
    values = spark.createDataFrame(asked, "k string, tenant_id string, partner_id string, text string")
    got = dict(tuple(r) for r in map_to_catalogue(values, spark.createDataFrame(rows, PRODUCTS), "k", "text").collect())
    assert got == {"a": "1", "b": "2", "c": "3", "d": ""}
