"""Column names and change types shared by every job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stored column names and change types a target table must keep.
KEY = "sfid"
LAST_MODIFIED = "_oc_last_modified_at"
LAST_EVENT = "_oc_last_event_at"
CHANGE_TYPES = ("CREATE", "UPDATE", "DELETE", "UNDELETE")
CREATE_LIKE = ("CREATE", "UNDELETE")


# Fixed value: what counts as white space around a value.
WHITE_SPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f"


def strip(text) -> Column:
    """The text without white space at its ends, of any kind and not only spaces."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def pinned(df: DataFrame) -> DataFrame:
    """The same rows behind a one-row generator.

    A filter on a computed column would otherwise be pushed below the projections with every
    expression written out again: evaluated twice at best, and beyond any planner where the
    columns build on each other.
    """
    return df.select(F.inline(F.array(F.struct("*"))))
