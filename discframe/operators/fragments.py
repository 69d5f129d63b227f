"""Assembly of continuation packets into whole subpictures (batch form)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discframe.operators import ordered as o
from discframe.operators.fold import fold


def _complete(data: str) -> str | None:
    """The hex text cut to the size its first two bytes state, once all of it is in."""
    size = int(data[:4], 16) if len(data) >= 4 else 0
    return data[: size * 2] if size >= 4 and len(data) >= size * 2 else None


def assemble_step(state, pts, chunk, final):
    """State: (time, hex data) of the open subpicture, or empty.

    Returns up to two finished ones: ended by a new time or by size, and (on the final
    row) whatever is still open.
    """
    opened, data = state if state is not None else (None, None)
    ended = (None, None)
    if data is None:
        opened, data = pts, chunk
    elif pts and pts != opened:
        ended = (opened, data)
        opened, data = pts, chunk
        if final:
            return (None, None), (*ended, opened, data)
        return (opened, data), (*ended, None, None)
    else:
        data += chunk
        if pts and not opened:
            opened = pts
    whole = _complete(data)
    if whole is not None:
        return (None, None), (opened, whole, None, None)
    if final:
        return (None, None), (*ended, opened, data)
    return (opened, data), (*ended, None, None)


def assemble(fragments: DataFrame, key: str = "stream_id") -> DataFrame:
    """Whole subpictures ``key, seq, part, pts, data`` from ``key, seq, pts, chunk`` rows.

    A subpicture ends once its stated size is in, when a packet with a new non-zero time
    arrives, or at the end of the stream; ``seq`` is the row that ended it.
    """
    seen = o.ordered(fragments, key, ["seq"], _next=o.lead("seq"))
    coded = seen.select(key, "seq", "pts", F.hex("chunk").alias("_hex"), F.col("_next").isNull().alias("_final"))
    outputs = [
        ("_p1", T.LongType()),
        ("_d1", T.StringType()),
        ("_p2", T.LongType()),
        ("_d2", T.StringType()),
    ]
    folded = fold(coded, key, ["seq"], ["pts", "_hex", "_final"], assemble_step, outputs)
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.col("_p1").alias("pts"), F.unhex("_d1").alias("data")),
        F.struct(F.lit(1).alias("part"), F.col("_p2").alias("pts"), F.unhex("_d2").alias("data")),
    )
    rows = folded.select(key, "seq", F.explode(parts).alias("x")).select(key, "seq", "x.*")
    return rows.filter(F.col("data").isNotNull())
