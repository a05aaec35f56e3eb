"""Reads of stored STIX objects: filters, pages that new objects don't shift, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the stored objects; ``added`` is when a version came in.
OBJECTS = "collection string, stix_id string, type string, added double, line string"


def _of(objects: DataFrame, collection: str, kind: str | None) -> DataFrame:
    x = objects.where(F.col("collection") == collection)
    return x if not kind else x.where(F.col("type") == kind)


def stix_query(objects: DataFrame, collection: str, added_after: float | None = None, kind: str | None = None, limit: int = 100) -> tuple[DataFrame, bool]:
    """The newest ``limit`` objects, oldest first, and whether there were more."""
    x = _of(objects, collection, kind)
    x = x if added_after is None else x.where(F.col("added") > added_after)
    newest = x.orderBy(F.desc("added"), F.desc("stix_id")).limit(limit)
    return newest.orderBy("added", "stix_id"), x.limit(limit + 1).count() > limit


def stix_page(objects: DataFrame, collection: str, after: tuple | None = None, kind: str | None = None, size: int = 100) -> tuple[DataFrame, tuple[float, str, str] | None]:
    """The ``size`` objects that follow ``after``, (added, id) or (added, id, line), and
    the triple that asks for the next page; none at the end.  Objects that come in later
    than a page's last are on later pages, and versions of an object with equal times
    follow each other by line, so pages add up to the whole; of copies of one version,
    equal in all three, those behind a page's end are passed over."""
    x = _of(objects, collection, kind)
    order = ("added", "stix_id", "line")
    if after is not None:
        later = F.lit(False)
        for name, v in reversed([*zip(order, after, strict=False)]):
            later = (F.col(name) > v) | ((F.col(name) == v) & later)
        x = x.where(later)
    page = x.orderBy(*order).limit(size)
    last = page.orderBy(*[F.desc(c) for c in order]).select(*order).first()
    return page, last and tuple(last)


def stix_manifest(objects: DataFrame, collection: str) -> DataFrame:
    """Each object with its first and newest version and their number."""
    x = _of(objects, collection, None).groupBy("stix_id", "type")
    return x.agg(F.min("added").alias("date_added"), F.max("added").alias("version"), F.count(F.lit(1)).alias("versions"), F.lit("application/stix+json;version=2.1").alias("media_type"))


def newest_versions(objects: DataFrame, collection: str) -> DataFrame:
    """Each object's newest version; of equal times the greatest line."""
    x = _of(objects, collection, None).groupBy("stix_id", "type").agg(F.max(F.struct("added", "line")).alias("v"))
    return x.select("stix_id", "type", "v.added", "v.line")
