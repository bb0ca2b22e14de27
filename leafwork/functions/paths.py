"""Column functions over node paths (arrays of sibling positions) and file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH_TYPE = "array<int>"


def depth(path: Column) -> Column:
    return F.size(path) - 1


def parent_of(path: Column) -> Column:
    """Path of the parent; the empty path for a root."""
    return F.slice(path, F.lit(1), F.size(path) - 1)


def root_of(path: Column) -> Column:
    return F.slice(path, 1, 1)


def ordinal_of(path: Column) -> Column:
    return F.element_at(path, -1)


def prefixes(path: Column) -> Column:
    """Paths of all ancestors and of the node itself, root first."""
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, F.lit(1), n))


def level_first_key(path: Column) -> Column:
    """Sort key of the level-first search.

    That search tests a whole sibling list before it descends into any member,
    so at the list where two matches part, the one ending there comes first.
    """
    n = F.size(path)
    return F.transform(
        path, lambda x, i: F.struct(F.when(i == n - 1, 0).otherwise(1).alias("deeper"), x.alias("at"))
    )


def path_key(path: Column) -> Column:
    """The path as text that sorts in document order."""
    return F.array_join(F.transform(path, lambda x: F.lpad(x.cast("string"), 10, "0")), ".")


def posix_join(*parts: Column) -> Column:
    """Join and normalise slash-separated paths, as POSIX path joining does."""
    joined = F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts])
    steps = F.filter(F.split(joined, "/"), lambda s: ~s.isin("", "."))
    absolute = joined.startswith("/")

    def step(acc: Column, s: Column) -> Column:
        can_pop = (s == "..") & (F.size(acc) > 0) & (F.element_at(acc, F.lit(-1)) != "..")
        drop = (s == "..") & absolute & (F.size(acc) == 0)
        return (
            F.when(F.coalesce(can_pop, F.lit(False)), F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(drop, acc)
            .otherwise(F.concat(acc, F.array(s)))
        )

    body = F.array_join(F.aggregate(steps, F.lit([]).cast("array<string>"), step), "/")
    tail = F.when(joined.endswith("/") & (body != ""), F.lit("/")).otherwise(F.lit(""))
    full = F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), body, tail)
    return F.when(full == "", F.when(joined.endswith("/"), F.lit("./")).otherwise(F.lit("."))).otherwise(full)
