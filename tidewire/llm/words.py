"""Words as column expressions, by the classes of characters that the queries name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that part words. SPACES are the six ASCII spaces;
# SIGNS are all of ASCII but letters and digits.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SIGNS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def space_words(text: Column) -> Column:
    """Words between ASCII spaces; none if the text is null or empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def sign_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and everything past ASCII, as they are written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SIGNS), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The table less the columns whose names a result is going to use."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
