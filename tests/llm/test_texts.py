import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from billweave.llm.encoding import encode_corpus
from billweave.llm.packing import differencing, fill_containers, pack
from billweave.llm.splitting import split_texts
from billweave.llm.tokens import Encoder, default_path, encoder
from billweave.llm.visual_form import look_alike_pairs, normalise_text, visual_text

ALPHABETS = ["ab", "abcdefghij", "の日本語テキスト", "aé", "  \n", "1234", "=+-", "😀👍"]


def texts(n, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        runs = ["".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randrange(1, 300))) for _ in range(3)]
        yield "".join(rng.choice([*runs, " ", "\n\n", "foo's", " bar", "  ", "don't", "'"]) for _ in range(8))


def test_tree_equals_direct():
    e = Encoder(default_path(), 64)
    rng = random.Random(2)
    for _ in range(300):
        raw = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randrange(1, 900))).encode()
        assert e.tree(raw) == e.piece(raw)
    for text in texts(300):
        direct = e._plain.encode_ordinary(text)
        assert e.text(text) == direct
        cut = list(e.stretches(text, 50))
        assert e.assemble([k for k, _ in cut], [e.stretch(k, x) for k, x in cut]) == direct
        assert b"".join(x for _, x in cut).decode() == text


def corpus(spark):
    rows = [(i % 40, t, "x") for i, t in enumerate(texts(60))]  # repeated keys
    rows += [(100, None, "x"), (101, "", "x"), (102, " \n", "x"), (103, "の" * 20_000, "x"), (104, "lorem ipsum " * 9000, "x"), (None, "no key", "x")]
    rows += [(105, "same", "x"), (105, "same", "x"), (106, " " * 30_000 + "x", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string")


def test_encoding(spark):
    docs = corpus(spark)
    e = encoder(default_path())
    got = encode_corpus(docs, long_chars=500, stretch_chars=200, leaf_bytes=128)
    assert got.columns == ["doc_id", "ids"] and got.schema["ids"].dataType.simpleString() == "array<int>"
    want = sorted((repr(r.doc_id), e._plain.encode_ordinary(r.text) if r.text else []) for r in docs.collect())
    assert sorted((repr(r.doc_id), r.ids) for r in got.collect()) == want
    assert sorted((repr(r.doc_id), r.ids) for r in encode_corpus(docs).collect()) == want
    assert encode_corpus(docs.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(4)
    for _ in range(30):
        sizes = sorted((rng.randrange(0, 100) for _ in range(rng.randrange(1, 80))), reverse=True)
        import numpy as np

        windows, k = pack(np.array(sizes), 100)
        sums = np.bincount(windows, weights=sizes, minlength=k)
        assert len(windows) == len(sizes) and sums.max() <= 100
    assert sorted(np.bincount(differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    docs = corpus(spark)
    got = fill_containers(docs, capacity=256, group_items=20).toPandas()
    e = encoder(default_path())
    assert got.tokens.max() <= 256 and got.groupby("container").tokens.sum().max() <= 256
    assert got.tokens.sum() == sum(len(e.text(r.text)) for r in docs.collect())
    assert len(got[got.piece_no == 0]) == docs.count() == 69
    whole = got[got.doc_id == 103].sort_values("piece_no")
    assert list(whole.first_token) == [256 * i for i in range(len(whole))] and (whole.tokens[:-1] == 256).all()
    assert fill_containers(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit, overlap", [(64, 8), (40, 0), (512, 64)])
def test_splitting(spark, limit, overlap):
    docs = corpus(spark).withColumn("doc_id", F.monotonically_increasing_id())
    e = encoder(default_path())
    whole = {r.doc_id: r.text for r in docs.collect()}
    got = split_texts(docs, limit=limit, overlap=overlap).toPandas().sort_values(["doc_id", "piece_no"])
    assert set(got.doc_id) == set(whole) and got.tokens.max() <= limit
    for doc, pieces in got.groupby("doc_id"):
        text, ids = whole[doc], e.text(whole[doc])
        if len(ids) <= limit:
            assert len(pieces) == 1 and (pieces.piece.iloc[0] == text or text is None)
            continue
        assert max(len(e.text(p)) for p in pieces.piece) <= limit
        end, built = 0, b""
        for at, (first, n, piece) in enumerate(zip(pieces.first_token, pieces.tokens, pieces.piece)):
            assert (at == 0 and first == 0) or overlap <= end - first <= overlap + 3
            assert b"".join(e.bytes_of[i] for i in ids[first : first + n]).decode() == piece
            built += b"".join(e.bytes_of[i] for i in ids[max(end, first) : first + n])
            end = first + n
        assert built.decode() == text


def test_natural_boundaries(spark):
    text = " ".join(f"This is sentence number {i} of the text." for i in range(40)) + "\n\n" + "word " * 200
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    pieces = [r.piece for r in split_texts(docs, limit=100, overlap=10).orderBy("piece_no").collect()]
    assert all(p.rstrip(" ").endswith((".", "\n", "word")) for p in pieces)
    with pytest.raises(ValueError):
        split_texts(docs, limit=20, overlap=15)


def look(text):
    """A plain restatement for the few characters of the fixture."""
    text = unicodedata.normalize("NFC", text).replace("​", "").replace("\xad", "").replace("﻿", "")
    out = "".join(unicodedata.normalize("NFKC", c) if 0xFF00 < ord(c) < 0xFF5F or c in "\xa0　 ﬁ" else c for c in text)
    return out.translate({ord("а"): "a", ord("о"): "o", ord("Ѕ"): "S", ord("‐"): "-"})


def test_visual_forms():
    assert visual_text("Ｆｉｎｅ‐ｃｕｔ　ﬁt") == "Fine-cut fit"
    assert visual_text("Crème") == "Crème" != visual_text("Creme")
    assert visual_text("Ѕоck‍⁠") == "Sock" and visual_text("x²") == "x²" and visual_text("½") == "½"
    assert visual_text("ёлка Ά ў") == visual_text("e\u0308лкa A\u0301 y\u0306") and visual_text("Ⅻ ɡ") == "XII g"
    assert visual_text("й") == "й" != visual_text("и") and visual_text("한글") == "한글"
    assert visual_text("K") == "K" and visual_text("a\tb") == "a b" and visual_text("a  b") == "a  b" and visual_text("") == ""


def test_look_alike_pairs(spark):
    rng = random.Random(5)
    base = ["Sock fit", "sock fit", "Crème", "Creme", "fine-cut", "x²", "x2", ""]
    swap = {"S": "SЅＳ", "o": "oо", "a": "aа", " ": " \xa0　 ", "-": "-‐", "è": ["è", "è"], "c": "cｃ"}
    values = ["".join(rng.choice(swap.get(c, [c])) + rng.choice(["", "", "​", "\xad"]) for c in rng.choice(base)) for _ in range(150)]
    values += ["Sock fit"] * 5 + ["Ｓock fit"] * 5 + [None, "a​" * 20_000, "a" * 20_000]
    df = spark.createDataFrame([(f"L{i}", v, "own") for i, v in enumerate(values)] + [(None, "Sock fit", "own")], "k string, t string, text string")
    got = [tuple(r) for r in look_alike_pairs(df, "k", "t").collect()]
    keyed = [(f"L{i}", v) for i, v in enumerate(values) if v is not None]
    want = {tuple(sorted((a, b))) for i, (a, x) in enumerate(keyed) for b, y in keyed[:i] if x != y and look(x) == look(y)}
    assert len(got) == len(set(got)) and set(got) == want
    forms = {r.k: r.t_form for r in normalise_text(df, "t").collect()}
    assert forms["L150"] == forms["L155"] == "sock fit" and forms["L160"] is None
    assert look_alike_pairs(df.limit(0), "k", "t").count() == 0
