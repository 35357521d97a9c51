"""Text of SQL expressions.

The expressions over pages and addresses have hundreds of nodes.  Built from
``Column`` objects, each node is a call into the JVM and planning takes longer
than the job; as text, the whole expression is one call to ``expr``.  ``Sql``
holds such text, ``S.name(...)`` is a call of the SQL function of that name,
plain Python values are literals, and Python lambdas become SQL lambdas.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import wraps
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

_numbers = count()


class Sql:
    """One expression."""

    def __init__(self, text: str):
        self.text = text

    def __str__(self) -> str:
        return self.text

    __hash__ = None

    def _with(self, operator: str, other: object) -> Sql:
        return Sql(f"({self} {operator} {literal(other)})")

    def __eq__(self, other: object) -> Sql:  # type: ignore[override]
        return self._with("=", other)

    def __ne__(self, other: object) -> Sql:  # type: ignore[override]
        return self._with("<>", other)

    def __lt__(self, other: object) -> Sql:
        return self._with("<", other)

    def __gt__(self, other: object) -> Sql:
        return self._with(">", other)

    def __le__(self, other: object) -> Sql:
        return self._with("<=", other)

    def __add__(self, other: object) -> Sql:
        return self._with("+", other)

    def __sub__(self, other: object) -> Sql:
        return self._with("-", other)

    def __mul__(self, other: object) -> Sql:
        return self._with("*", other)

    def __truediv__(self, other: object) -> Sql:
        return self._with("/", other)

    def __and__(self, other: object) -> Sql:
        return self._with("AND", other)

    def __or__(self, other: object) -> Sql:
        return self._with("OR", other)

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self})")

    def __getitem__(self, field: str) -> Sql:
        return Sql(f"{self}.{field}" if self.text.isidentifier() else f"({self}).{field}")

    def isNull(self) -> Sql:
        return Sql(f"({self} IS NULL)")

    def isNotNull(self) -> Sql:
        return Sql(f"({self} IS NOT NULL)")

    def between(self, low: object, high: object) -> Sql:
        return Sql(f"({self} BETWEEN {literal(low)} AND {literal(high)})")

    def isin(self, *values: object) -> Sql:
        return Sql(f"({self} IN ({', '.join(map(literal, values))}))")

    def cast(self, to: str) -> Sql:
        return Sql(f"CAST({self} AS {to})")

    def alias(self, name: str) -> Sql:
        return Sql(f"{self} AS {name}")

    def contains(self, other: object) -> Sql:
        return S.contains(self, other)

    def startswith(self, other: object) -> Sql:
        return S.startswith(self, other)

    def endswith(self, other: object) -> Sql:
        return S.endswith(self, other)

    def rlike(self, pattern: object) -> Sql:
        return S.rlike(self, pattern)


class Case(Sql):
    """``CASE WHEN``; complete with or without ``otherwise``."""

    def __init__(self, branches: str):
        super().__init__(f"CASE{branches} END")
        self._branches = branches

    def when(self, condition: object, value: object) -> Case:
        return Case(f"{self._branches} WHEN {literal(condition)} THEN {literal(value)}")

    def otherwise(self, value: object) -> Sql:
        return Sql(f"CASE{self._branches} ELSE {literal(value)} END")


def literal(value: object) -> str:
    """SQL text of a Python value, a Python lambda or an expression."""
    if isinstance(value, Sql):
        return value.text
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        quoted = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{quoted}'"
    if callable(value):
        names = [f"_v{next(_numbers)}" for _ in inspect.signature(value).parameters]
        body = literal(value(*(Sql(n) for n in names)))
        return f"({', '.join(names)}) -> {body}" if len(names) > 1 else f"{names[0]} -> {body}"
    raise TypeError(f"no SQL text for {value!r}")


class _Functions:
    """``S.upper(x)`` is ``upper(x)``."""

    def __getattr__(self, name: str) -> Callable[..., Sql]:
        return lambda *args: Sql(f"{name}({', '.join(map(literal, args))})")

    @staticmethod
    def when(condition: object, value: object) -> Case:
        return Case("").when(condition, value)

    @staticmethod
    def lit(value: object) -> Sql:
        return Sql(literal(value))


S = _Functions()


def let(value: object, body: Callable[[Sql], Sql]) -> Sql:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Inside lambdas Spark shares no common sub-expressions, so a chain of
    string steps would otherwise be evaluated once per use.
    """
    return S.get(S.transform(S.array(value), body), 0)


def over(body: Callable[..., Sql], *columns: Column) -> Column:
    """The column that ``body`` makes of the values of other columns."""
    names = [f"c{i}" for i in range(len(columns))]

    def unpacked(row: Sql) -> Sql:
        return body(row) if len(columns) == 1 else body(*(row[n] for n in names))

    row = (
        columns[0]
        if len(columns) == 1
        else F.struct(*(c.alias(n) for c, n in zip(columns, names)))
    )
    return F.get(
        F.call_function("transform", F.array(row), F.expr(literal(lambda v: unpacked(v)))),
        F.lit(0),
    )


def expression(function: Callable[..., Sql]) -> Callable[..., Column | Sql]:
    """Lets a function over ``Sql`` text be called with columns as well.

    Parameters annotated ``Sql`` take a column name, a Column, or text from
    other such functions; the result is a Column unless all of them are text.
    """
    parameters = inspect.signature(function).parameters
    wanted = [n for n, p in parameters.items() if p.annotation in ("Sql", Sql)]

    @wraps(function)
    def call(*args, **kwargs):
        given = dict(zip(parameters, args), **kwargs)
        inputs = {n: given.pop(n) for n in wanted}
        if all(isinstance(v, Sql) for v in inputs.values()):
            return function(**inputs, **given)
        if all(isinstance(v, str) for v in inputs.values()):
            return F.expr(str(function(**{n: Sql(v) for n, v in inputs.items()}, **given)))
        columns = [F.col(v) if isinstance(v, str) else v for v in inputs.values()]
        return over(lambda *v: function(**dict(zip(inputs, v)), **given), *columns)

    return call
