"""Array and map column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlake.functions.text import let


def bag(tokens: Column) -> Column:
    """``map<token, count>`` of a token array in one sort, without a shuffle.

    Equal tokens are adjacent after sorting, so the counts are the distances
    between the positions where a new token begins.
    """

    def count_runs(ordered: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(ordered) - 1)
        starts = F.filter(
            positions,
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            starts,
            lambda s: F.map_from_arrays(
                F.transform(s, lambda i: F.get(ordered, i)),
                F.transform(
                    s,
                    lambda i, n: (F.coalesce(F.get(s, n + 1), F.size(ordered)) - i).cast("long"),
                ),
            ),
        )

    empty = F.create_map().cast("map<string,bigint>")
    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), count_runs)).otherwise(empty)


def bag_norm(counts: Column) -> Column:
    """Euclidean length of a bag."""
    return F.sqrt(
        F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda acc, n: acc + n * n).cast("double")
    )


def bag_dot(left: Column, right: Column) -> Column:
    """Sum of count products over shared tokens; ``map_zip_with`` aligns keys by hashing."""
    products = F.map_values(F.map_zip_with(left, right, lambda _, a, b: a * b))
    return F.aggregate(
        products, F.lit(0).cast("long"), lambda acc, n: acc + F.coalesce(n, F.lit(0).cast("long"))
    )


def bag_cosine(left: Column, left_norm: Column, right: Column, right_norm: Column) -> Column:
    """Cosine of two bags, zero when either is empty."""
    product = left_norm * right_norm
    return F.when(product > 0, bag_dot(left, right) / product).otherwise(F.lit(0.0))


def containment(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the distinct query tokens present in the text; zero when either side is empty."""
    size = F.size(query_tokens)
    return F.when(
        size > 0, F.size(F.array_intersect(query_tokens, text_tokens)) / size.cast("double")
    ).otherwise(F.lit(0.0))


def last_n(values: Column, n: int) -> Column:
    """Last ``n`` elements, or all of them when there are fewer."""
    return F.slice(values, F.greatest(F.size(values) - (n - 1), F.lit(1)), n)


def groups_from(values: Column, starts: Column) -> Column:
    """Cut an array at the given zero-based start positions: ``array<array>``."""
    return F.transform(
        starts,
        lambda at, i: F.slice(values, at + 1, F.coalesce(F.get(starts, i + 1), F.size(values)) - at),
    )


def positions(values: Column, test) -> Column:
    """Zero-based positions of the elements that pass ``test``."""
    marked = F.transform(values, lambda value, i: F.when(test(value), i))
    return F.filter(marked, lambda i: i.isNotNull())
