"""Sessions cut into chunks, and texts split without loss."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shipping
from ..functions.text import CHARS_PER_TOKEN

#: How a role is named in a chunk.
ROLE_NAMES = {"user": "用户", "assistant": "助手", "tool": "工具"}


def rendered(role: Column, text: Column) -> Column:
    """A message as a chunk shows it; null for system, unknown and empty messages."""
    name = F.lit(None).cast("string")
    for known, shown in ROLE_NAMES.items():
        name = F.when(role == known, shown).otherwise(name)
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("**"), name, F.lit("**: "), text))


def greedy_chunks(messages: DataFrame, session: str, order: str, chars: str, tokens: int = 12_000, most: int = 80, quirk: bool = False) -> DataFrame:
    """messages(session long, order long, chars long) with (chunk, piece): packed in order into chunks of at most `tokens` estimated tokens or `most` messages.

    A message above the whole budget is flushed before and cut into pieces of as many characters
    as the budget holds, each a chunk of its own.  `quirk` keeps the running count over such a
    message, as the first implementation of this rule did, so that the next chunk may close early.
    Sessions are streamed through tasks in order: what a task holds is one batch and one count.
    """
    shipping.ship(messages.sparkSession)
    budget = int(tokens * CHARS_PER_TOKEN)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chunk, used, n = None, 0, 0, 0
        for batch in batches:
            out = []
            for s, o, c in zip(batch["s"], batch["o"], batch["c"], strict=True):
                if s != now:
                    now, chunk, used, n = s, 0, 0, 0
                size = max(1, int(np.ceil(c / CHARS_PER_TOKEN)))
                if size > tokens:
                    if n:
                        chunk, n, used = chunk + 1, 0, used if quirk else 0
                    pieces = -(-c // budget)
                    out += [(s, o, chunk + i, i) for i in range(pieces)]
                    chunk += pieces
                    continue
                if n and (used + size > tokens or n >= most):
                    chunk, used, n = chunk + 1, 0, 0
                used, n = used + size, n + 1
                out.append((s, o, chunk, 0))
            yield pd.DataFrame(out, columns=["s", "o", "chunk", "piece"])

    kind = messages.schema[session].dataType.simpleString()
    rows = messages.select(F.col(session).alias("s"), F.col(order).cast("long").alias("o"), F.col(chars).cast("long").alias("c"))
    packed = rows.repartition("s").sortWithinPartitions("s", "o").mapInPandas(pack, f"s {kind}, o long, chunk long, piece long")
    return packed.select(F.col("s").alias(session), F.col("o").alias(order), "chunk", "piece")


def _split(text: str, budget: int) -> list[str]:
    out, at = [], 0
    while len(text) - at > budget:
        cut = text.rfind("\n", at + budget // 2, at + budget) + 1
        end = cut if cut > at else at + budget
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if at < len(text) or not out else out


def loss_free_split(text: Column, budget: int) -> Column:
    """Parts of at most `budget` characters that concatenate to the text, cut after a line that ends in their second half if there is one."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _split(t, budget))

    return cut(text)
