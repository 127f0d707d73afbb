"""Problem 9: texts over a token limit in pieces that end at natural boundaries.

A worker turns each long text into a *shape*: one letter per token that names the boundary
after it. One bounded-quantifier regular expression over the shape then does the cutting, its
alternatives in the order of boundary strength, the last one any character boundary. Offsets,
the look-back that gives the overlap, and the pieces themselves are SQL array functions; the
pieces are cut from the text's bytes before they become rows, so the time is proportional to the
text. Very long texts are encoded in parts (:mod:`encoding`).

=====  =================================================
p, l   end of a paragraph, end of a line
s, c   end of a sentence, end of a clause
w      white space before or after
x, y   between characters (y: before an apostrophe)
z      inside a character; never a cut
=====  =================================================

Every piece has at most ``limit`` tokens. Consecutive pieces share ``overlap`` tokens, up to 3
more where the look-back would start inside a character. Defined results: a text within the
limit is one piece; an empty text is one empty piece and a null text one null piece, both of
0 tokens; repeated rows give their pieces each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.encoding import is_long, long_texts, numbered
from billweave.llm.tokens import Encoder, default_path, encoder

LIMIT = 512
OVERLAP = 64
#: Most tokens that one character can take beyond its first.
_INSIDE = 3

_SENTENCE = ".!?…。！？"
_CLAUSE = ",;:、，；："
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  　"


def _codes(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], dtype=np.uint32)


def boundaries(text: str, lengths: np.ndarray) -> tuple[str, np.ndarray]:
    """The shape of a text, and the byte offset at which each token ends, below zero inside a character."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(lengths)
    begins = np.append((raw & 0xC0) != 0x80, True)  # of each byte, and of the end
    number = np.cumsum(begins[:-1]) - 1
    at = np.append(number, len(chars))[ends]  # number of the character that follows the token
    space, sentence, clause = (np.isin(chars, _codes(x)) for x in (_SPACE, _SENTENCE, _CLAUSE))
    newline, back = chars == 10, np.maximum(at - 1, 0)
    following = np.minimum(at, len(chars) - 1)
    before, twice = newline[back], newline[np.maximum(at - 2, 0)] | (
        (chars[np.maximum(at - 2, 0)] == 13) & newline[np.maximum(at - 3, 0)]
    )
    wide = chars[back] > 0x3000
    letter = np.full(len(ends), "x", dtype="<U1")
    letter[chars[following] == 0x27] = "y"
    letter[space[following] | space[back]] = "w"
    letter[clause[back] & (space[following] | wide)] = "c"
    letter[sentence[back] & (space[following] | wide)] = "s"
    letter[before & ~newline[following]] = "l"
    letter[before & twice & ~newline[following]] = "p"
    letter[~begins[ends]] = "z"
    return "".join(letter.tolist()), np.where(begins[ends], ends, -ends)


SHAPE = "n int, shape string, ends array<int>, raw binary"


def shape_of(e: Encoder, ids: list[int], limit: int) -> tuple:
    """(tokens, shape, byte ends, bytes) of a text by its ids; the last three only over the limit."""
    if len(ids) <= limit:
        return len(ids), None, None, None
    pieces = [e.bytes_of[i] for i in ids]
    raw = b"".join(pieces)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(ids))
    letters, ends = boundaries(raw.decode("utf-8", "surrogatepass"), lengths)
    return len(ids), letters, ends.astype(np.int32), raw


def text_shape(path: str, limit: int):
    """Arrow UDF: text -> (tokens, shape, byte ends, bytes); the last three only of texts over the limit."""

    @F.pandas_udf(SHAPE)
    def shape(texts: pd.Series) -> pd.DataFrame:
        e = encoder(path)
        return pd.DataFrame([shape_of(e, e.text(x), limit) for x in texts], columns=["n", "shape", "ends", "raw"])

    return shape


def cut_pattern(most: int) -> str:
    """Up to ``most`` tokens, ending at the strongest boundary in the second half, else at any."""
    half = max(1, most // 2)
    strong = [f".{{{half - 1},{most - 1}}}{kind}" for kind in "plsc"]
    return "|".join([f".{{1,{most}}}\\z", *strong, f".{{{half - 1},{most - 1}}}w", f".{{0,{most - 1}}}[plscwx]", f".{{0,{most - 1}}}y"])


def running_sums(lengths: str, block: int = 64) -> tuple[Column, Column, Column]:
    """Expressions for three columns made one after the other: sums inside blocks, those of the blocks, all sums.

    A list grows by copying, so one pass over n numbers would cost n squared; blocks keep it near n.
    """

    def grow(numbers: Column, start: Column) -> Column:
        return F.aggregate(numbers, start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)))

    last = F.ceil(F.size(lengths) / block).cast("int") - 1
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(F.col(lengths), k * block + 1, block))
    inside = F.transform(blocks, lambda x: grow(x, F.array().cast("array<int>")))
    before = grow(F.transform("inside", lambda x: F.get(x, F.size(x) - 1)), F.array(F.lit(0)))
    sums = F.flatten(F.transform("inside", lambda x, k: F.transform(x, lambda y: y + F.get("before", k))))
    return inside, before, sums


def _look_back(ends: Column, start: Column) -> Column:
    """``start`` moved back to a character boundary; 0 is one."""
    moved = start - _INSIDE
    for i in range(_INSIDE - 1, -1, -1):
        moved = F.when(F.get(ends, start - i - 1) < 0, moved).otherwise(start - i)
    return F.when(start <= 0, F.lit(0)).otherwise(moved)


def split_texts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    limit: int = LIMIT,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(key, piece_no, first_token, tokens, piece) of every text of ``docs``."""
    most = limit - overlap - _INSIDE
    if overlap < 0 or most < 8:
        raise ValueError("the limit must exceed the overlap by 11 tokens at least")
    path = path or default_path()
    rows = numbered(docs, key, text)
    short = rows.filter(~is_long()).withColumn("s", text_shape(path, limit)("text")).select("key", "text", "s.*")
    whole = lambda e, ids: (*shape_of(e, ids, limit)[:3], b"".join(e.bytes_of[i] for i in ids))
    long = long_texts(rows.filter(is_long()), whole, SHAPE, path)
    long = long.select("key", F.col("raw").cast("string").alias("text"), "n", "shape", "ends", "raw")
    shape, ends = F.col("shape"), F.col("ends")
    lengths = F.transform(F.regexp_extract_all(shape, F.lit(f"(?s){cut_pattern(most)}"), F.lit(0)), F.length)
    inside, before, sums = running_sums("lengths")
    cut = short.unionByName(long).withColumn("lengths", lengths).withColumn("inside", inside).withColumn("before", before)
    # named twice, so that the list is made once and not again inside the lambda
    cut = cut.withColumn("stops", F.when(F.size("before") > 0, sums))
    starts = F.transform(
        F.col("stops"), lambda x, i: F.when(i == 0, F.lit(0)).otherwise(_look_back(ends, F.get("stops", i - 1) - overlap))
    )

    def piece(a: Column, b: Column) -> Column:
        begin = F.when(a == 0, F.lit(0)).otherwise(F.get(ends, a - 1))
        raw = F.substring(F.col("raw"), begin + 1, F.get(ends, b - 1) - begin)
        return F.struct(a.alias("a"), b.alias("b"), raw.cast("string").alias("piece"))

    one = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"), F.col("text").alias("piece")))
    pieces = F.when(shape.isNull(), one).otherwise(F.zip_with(starts, F.col("stops"), piece))
    out = cut.select("key", F.posexplode(pieces).alias("piece_no", "at"))
    return out.select(
        F.col("key").alias(key), "piece_no", F.col("at.a").alias("first_token"), (F.col("at.b") - F.col("at.a")).alias("tokens"),
        F.col("at.piece").alias("piece"),
    )
