"""Problem 7: the whole corpus as token ids.

Texts up to ``long_chars`` are encoded where they are read, without a shuffle. A longer text
is cut into stretches, which become rows of their own and are encoded in parallel; the
stretches of one text meet again only as ids, and the joins inside a piece are settled there.

Defined results: null and empty texts have the empty list; a repeated row or a repeated key
keeps its own result row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.tokens import LEAF_BYTES, Encoder, default_path, encoder

LONG_CHARS = 32_768
STRETCH_CHARS = 16_384


def token_ids(path: str | None = None, leaf_bytes: int = LEAF_BYTES):
    """Arrow UDF: text -> ids."""
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        e = encoder(path, leaf_bytes)
        return pd.Series([e.text(x) for x in texts], dtype=object)

    return ids


def token_counts(path: str | None = None, leaf_bytes: int = LEAF_BYTES):
    """Arrow UDF: text -> number of ids."""
    path = path or default_path()

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        e = encoder(path, leaf_bytes)
        return pd.Series([len(e.text(x)) for x in texts], dtype="int32")

    return count


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, text) of ``docs``; the number keeps repeated keys apart and is stable because it is taken at the scan."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))


def is_long(long_chars: int = LONG_CHARS):
    """Whether a text is long enough to be encoded in parts."""
    return F.coalesce(F.char_length("text") > long_chars, F.lit(False))


def long_texts(
    rows: DataFrame,
    finish: Callable[[Encoder, list[int]], tuple],
    schema: str,
    path: str,
    stretch_chars: int = STRETCH_CHARS,
    leaf_bytes: int = LEAF_BYTES,
) -> DataFrame:
    """(row, key, what ``finish`` makes of the ids) of texts that are encoded in parts, each part a row of its own.

    ``schema`` names and types what ``finish`` returns. Keys travel as text, so that null and large ones stay whole.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path, leaf_bytes)
        for batch in batches:
            for row, name, body in zip(batch["row"], batch["key"], batch["text"]):
                parts = list(e.stretches(body, stretch_chars))
                kinds, raws = [k for k, _ in parts], [x for _, x in parts]
                yield pd.DataFrame({"row": row, "key": [name] * len(parts), "no": range(len(parts)), "kind": kinds, "raw": raws})

    @F.pandas_udf("array<int>")
    def part_ids(kinds: pd.Series, raws: pd.Series) -> pd.Series:
        e = encoder(path, leaf_bytes)
        return pd.Series([e.stretch(k, x) for k, x in zip(kinds, raws)], dtype=object)

    names = [x.split()[0] for x in schema.split(", ")]

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        e = encoder(path, leaf_bytes)
        group = group.sort_values("no")
        made = finish(e, e.assemble(list(group["kind"]), [list(x) for x in group["ids"]]))
        return pd.DataFrame([(group["row"].iloc[0], group["key"].iloc[0], *made)], columns=["row", "key", *names])

    texts = rows.select("row", F.col("key").cast("string").alias("key"), "text")
    parts = texts.mapInPandas(cut, "row bigint, key string, no int, kind int, raw binary")
    spread = parts.repartition("row", "no").select("row", "key", "no", "kind", part_ids("kind", "raw").alias("ids"))
    done = spread.groupBy("row").applyInPandas(whole, f"row bigint, key string, {schema}")
    return done.withColumn("key", F.col("key").cast(rows.schema["key"].dataType))


def encode_corpus(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    long_chars: int = LONG_CHARS,
    stretch_chars: int = STRETCH_CHARS,
    leaf_bytes: int = LEAF_BYTES,
) -> DataFrame:
    """(key, ids) of every row of ``docs``."""
    path = path or default_path()
    rows = numbered(docs, key, text)
    short = rows.filter(~is_long(long_chars)).select("key", token_ids(path, leaf_bytes)("text").alias("ids"))
    long = long_texts(rows.filter(is_long(long_chars)), lambda e, ids: (ids,), "ids array<int>", path, stretch_chars, leaf_bytes)
    return short.unionByName(long.select("key", "ids")).withColumnRenamed("key", key)
