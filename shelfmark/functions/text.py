"""Small text expressions shared by the file parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space that trimming removes.
SPACES = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_space(text: Column) -> Column:
    """Trim Unicode white space; by default ``trim`` removes blanks only."""
    return F.btrim(text, F.lit(SPACES))


def failing_on(problem: Column) -> Column:
    """A filter condition that is true, or fails the job where ``problem`` is not null.

    A filter is evaluated whatever columns are read; a failing column could be pruned.
    """
    return F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True)


def without_return(line: Column) -> Column:
    """A line without the carriage return before its break."""
    return F.when(line.endswith("\r"), F.left(line, F.length(line) - 1)).otherwise(line)


def numbered_lines(df, text: str, keys: list[str]):
    """One row per line, numbered from 1; a carriage return before the break goes."""
    return df.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("_pos", "line")).select(
        *keys,
        (F.col("_pos") + 1).alias("line_no"),
        without_return(F.col("line")).alias("line"),
    )
