"""Reproducible train/validation/test assignment by hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
DEFAULT_SALT = "vn-news-v1"
#: First-byte limits of the two held-out splits: fixed values.
TEST_BELOW, VAL_BELOW = 26, 52


def first_hash_byte(article_id: Column, salt: str = DEFAULT_SALT) -> Column:
    """First byte, 0-255, of sha256("salt:id"). A null id gives null."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), article_id.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")


def split_bucket(article_id: Column, salt: str = DEFAULT_SALT) -> Column:
    """'test', 'val' or 'train' from the first hash byte; null id counts as 0."""
    byte = first_hash_byte(F.coalesce(article_id.cast("bigint"), F.lit(0)), salt)
    return F.when(byte < TEST_BELOW, "test").when(byte < VAL_BELOW, "val").otherwise("train")
