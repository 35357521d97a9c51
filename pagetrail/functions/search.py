"""Binary search in sorted arrays, inside the row."""

from __future__ import annotations

from .sqltext import S, Sql, expression, let


@expression
def count_up_to(values: Sql, x: Sql) -> Sql:
    """How many elements of an ascending array without nulls are at most ``x``; 0 for a null.

    As many halvings as the size has binary digits, so long arrays cost little more than short ones.
    """

    def halved(v: Sql, bounds: Sql) -> Sql:
        # elements before ``low`` are at most x, those from ``high`` on are greater
        middle = (bounds["low"] + bounds["high"]).cast("int")
        return let(
            S.shiftright(middle, 1),
            lambda m: S.when(~(bounds["low"] < bounds["high"]), bounds)
            .when(S.get(v, m) <= x, S.struct((m + 1).alias("low"), bounds["high"].alias("high")))
            .otherwise(S.struct(bounds["low"].alias("low"), m.alias("high"))),
        )

    def search(v: Sql) -> Sql:
        steps = S.sequence(0, S.length(S.bin(S.size(v))))
        start = S.struct(S.lit(0).alias("low"), S.size(v).alias("high"))
        return S.aggregate(steps, start, lambda bounds, _: halved(v, bounds))["low"]

    return S.when(values.isNull() | x.isNull(), 0).otherwise(search(values))


@expression
def last_up_to(values: Sql, x: Sql) -> Sql:
    """The greatest element of an ascending array that is at most ``x``; null without one."""
    return S.get(values, count_up_to(values, x) - 1)
