"""Work on one array column: shared values, runs of neighbours, running folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def runs(
    ordered: Column, differs: Callable[[Column, Column], Column], body: Callable[[Column, Column, Column], Column]
) -> Column:
    """`body` (of the array, a run's place and its length) of each run of neighbours that do not differ, in order."""

    def of(a):
        heads = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | differs(F.get(a, i), F.get(a, i - 1)))
        each = lambda h: F.transform(h, lambda b, j: body(a, b, F.coalesce(F.get(h, j + 1), F.size(a)) - b))
        return F.when(F.size(a) > 0, let(heads, each))

    return let(ordered, of)


def running(values: Column, add: Callable[[Column, Column], Column], zero: Column) -> Column:
    """`add` of each element of an array of numbers and all before it, for an associative `add` with its `zero`.

    In blocks of about the square root of the elements, since an array can't grow step by step without copies.
    """

    def of(a):
        width = F.greatest(F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int"), F.lit(1))
        fold = lambda part: F.aggregate(part, zero, add)

        def of_blocks(blocks):
            before = lambda k: fold(F.transform(F.slice(blocks, F.lit(1), k), fold))
            inside = lambda block, first: F.transform(
                block, lambda _, i: add(first, fold(F.slice(block, F.lit(1), i + 1)))
            )
            return F.flatten(F.transform(blocks, lambda block, k: let(before(k), lambda first: inside(block, first))))

        starts = lambda w: F.sequence(F.lit(0), F.size(a) - 1, w)
        cut_up = let(width, lambda w: F.transform(starts(w), lambda b: F.slice(a, b + 1, w)))
        return F.when(F.size(a) > 0, let(cut_up, of_blocks)).otherwise(a)

    return let(values, of)
