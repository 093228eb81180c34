"""Column expressions on text that several operators share (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed_hash(seed: str, *keys: Column) -> Column:
    """60 bits of md5 over the seed and the keys, as a non-negative long.

    md5 and not rand(): the same row gets the same number in every partition
    layout, on every retry and in any SQL engine.
    """
    joined = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def without(df, names):
    """df without columns that clash (in any letter case) with names."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def fresh(df, *stems: str) -> list[str]:
    """Names that no column of df has, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, k = f"_{stem}", 0
        while name in taken:
            name, k = f"_{stem}_{k}", k + 1
        taken.add(name)
        out.append(name)
    return out
