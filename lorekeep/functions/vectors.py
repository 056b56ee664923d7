"""Vector and embedding columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.constants import QUERY_PREFIX
from lorekeep.functions.text import strip

def query_text(query: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), strip(query))


def tokens(text: Column) -> Column:
    """Lower-cased tokens; a text without any gives the single token ``empty``."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_#@:/.\-]+"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("empty")))


def token_slot(digest: Column, dim: int) -> Column:
    """Vector position of a token from its sha256 hex digest."""
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def token_weight(digest: Column) -> Column:
    sign = F.when(F.pmod(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return sign * (F.lit(1.0) + F.conv(F.substring(digest, 11, 2), 16, 10).cast("double") / 255.0)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Unit vector in double; a zero vector becomes the first unit axis."""
    norm = l2_norm(vector)
    scaled = F.transform(vector, lambda x: x.cast("double") / norm)
    axis = F.transform(vector, lambda _x, i: F.when(i == 0, 1.0).otherwise(0.0))
    return F.when(norm > 0, scaled).otherwise(axis)
