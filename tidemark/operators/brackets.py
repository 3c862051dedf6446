"""Matching brackets of many texts at once, in time that grows with the number of brackets.

Texts are unfolded into tokens, a row each. The running depth is a window sum over the tokens of a text. An opening
bracket and the closing one that belongs to it stand at the same level, and between them no other bracket of
that level does, so a bracket's partner is its neighbour among the brackets of its level. Nothing is carried from token to
token, and no group is larger than the text that one task has already read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_partner(tokens: DataFrame, by: Sequence[str], place: str, step: Column) -> DataFrame:
    """Adds ``partner``, the place of the bracket that a bracket matches, null without one.

    ``by`` names a text, ``place`` orders its tokens, and ``step`` is 1 for opening brackets, -1 for closing ones and 0 for
    other tokens. A closing bracket without an open one is plain text, and so is an opening one that is never closed.
    """
    stepped = tokens.withColumn("_step", step)
    depth = F.sum("_step").over(Window.partitionBy(*by).orderBy(place))
    # An opener stands at the depth behind it, its closer at the depth before it; other tokens at none.
    level = F.when(F.col("_step") == 1, depth).when(F.col("_step") == -1, depth + 1)
    levelled = stepped.withColumn("_level", level)
    order = Window.partitionBy(*by, "_level").orderBy(place)
    before = F.when(F.lag("_step").over(order) == 1, F.lag(place).over(order))
    after = F.when(F.lead("_step").over(order) == -1, F.lead(place).over(order))
    partner = F.when(F.col("_step") == -1, before).when(F.col("_step") == 1, after)
    return levelled.withColumn("partner", partner).drop("_step", "_level")
