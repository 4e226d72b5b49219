"""Building blocks of array expressions: a value bound once, a scan, range minima by doubling, a sorted array's percentile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Results that a scan holds before it sets them aside: an append copies a block, not all that came before.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for each row, however often body or its lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, state: str, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """An array with what step(state, x) gives for each x of an array besides the next state. `state` and `kind` are the
    types of states and results."""
    whole = f"struct<s:{state},block:array<{kind}>,done:array<array<{kind}>>>"
    none = F.struct(zero.cast(state).alias("s"), F.array().cast(f"array<{kind}>").alias("block"), F.array().cast(f"array<array<{kind}>>").alias("done")).cast(whole)

    def one(acc: Column, x: Column) -> Column:
        def put(both: Column) -> Column:
            full = F.size(acc["block"]) >= BLOCK
            block = F.when(full, F.array(both["out"])).otherwise(F.concat(acc["block"], F.array(both["out"])))
            done = F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"])
            return F.struct(both["s"].alias("s"), block.alias("block"), done.alias("done")).cast(whole)

        new, out = step(acc["s"], x)
        return let(F.struct(new.cast(state).alias("s"), out.cast(kind).alias("out")), put)

    return F.aggregate(values, none, one, lambda acc: F.concat(F.flatten(acc["done"]), acc["block"]))


def doubled(values: Column, best: Callable[[Column, Column], Column]) -> Column:
    """A table for ranges: entry k holds, for each place x, the best of values[x - 2 ** k + 1 .. x] (cut at the start)."""
    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(values) + 1)).cast("int") - 1, F.lit(0)))

    def longer(table: Column, k: Column) -> Column:
        last = F.element_at(table, -1)
        return F.concat(table, F.array(let(last, lambda v: F.transform(v, lambda y, x: best(y, F.get(v, x - F.call_function("shiftleft", F.lit(1), k)))))))

    return F.aggregate(levels, F.array(values), longer)


def percentile(ordered: Column, share: float) -> Column:
    """Linear percentile of a sorted array; null if it is empty."""

    def at(h: Column) -> Column:
        low = F.get(ordered, F.floor(h).cast("int"))
        return low + (h - F.floor(h)) * (F.coalesce(F.get(ordered, F.floor(h).cast("int") + 1), low) - low)

    return let(F.lit(share) * (F.size(ordered) - 1), at)
