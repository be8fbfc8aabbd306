"""Line ranges as sets of nodes, so that "which range holds this line" becomes
an equi-join.

A node is one line or one whole block of lines. A range is cut into the single
lines at its ends and the whole blocks between them; a line lies in its own
line node and in its block node. A line is in a range exactly if they share
one node, and they never share two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def _node(level: str, number: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), number.cast("int").alias("number"))


def _span(level: str, first: Column, last: Column) -> Column:
    empty = F.array().cast("array<struct<level:string,number:int>>")
    numbers = F.transform(F.sequence(first, last), lambda n: _node(level, n))
    return F.when(first <= last, numbers).otherwise(empty)


def range_nodes(start: Column, end: Column, block: int = BLOCK) -> Column:
    """Nodes that cover the lines start to end."""
    first_block = F.ceil(start / F.lit(block)).cast("int")
    last_block = (F.floor((end + 1) / F.lit(block)) - 1).cast("int")
    has_block = first_block <= last_block
    head_end = F.when(has_block, first_block * block - 1).otherwise(end)
    tail_start = F.when(has_block, (last_block + 1) * block).otherwise(end + 1)
    return F.concat(
        _span("line", start, head_end),
        _span("block", first_block, last_block),
        _span("line", tail_start, end),
    )


def point_nodes(line: Column, block: int = BLOCK) -> Column:
    """The two nodes a line lies in."""
    return F.array(_node("line", line), _node("block", F.floor(line / F.lit(block))))
