"""Robots files: the text of one file as rules and a delay, and the verdict."""

from __future__ import annotations

from . import search
from .sqltext import S, Sql, expression, let
from .text import rest, trim_space

DEFAULT_DELAY = 1.0
ANY_AGENT = "*"

# Duration units in nanoseconds.
_UNITS = {
    "ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000,
    "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000,
}
_UNIT = "|".join(_UNITS)
_DURATION = rf"^\+?(?:(?:[0-9]++\.?+[0-9]*+|\.[0-9]++)(?:{_UNIT})(?=[0-9.]|\z))++\z"
_LARGEST = float(2**63)


@expression
def seconds(text: Sql) -> Sql:
    """Value of a delay such as ``2``, ``0.5`` or ``1m30``; null if not positive.

    A trailing ``s`` is always added first, so ``1m`` is one millisecond and
    ``5s`` is malformed.
    """

    def component(part: Sql) -> Sql:
        number = S.regexp_extract(part, "^[0-9.]+", 0)
        unit = rest(part, S.length(number))
        scale = S.try_element_at(
            S.map(*(x for u, n in _UNITS.items() for x in (u, float(n)))), unit
        )
        return S.floor(number.cast("double") * scale).cast("double")

    def total(given: Sql) -> Sql:
        parts = S.regexp_extract_all(given, "([0-9.]+[^0-9.]+)", 1)
        nanos = S.aggregate(parts, 0.0, lambda acc, p: acc + component(p))
        return let(nanos, lambda n: S.when((n > 0) & (n < _LARGEST), n / 1e9))

    return let(
        S.concat(text, "s"), lambda t: S.when(t.rlike(_DURATION), total(t))
    )


def _entries(body: Sql) -> Sql:
    """Struct(line_no, field, value) of the lines that mean something."""

    def entry(line: Sql, number: Sql) -> Sql:
        return let(
            trim_space(line),
            lambda t: S.struct(
                number.alias("line_no"),
                S.when(t.startswith("#") | ~t.contains(":"), "")
                .otherwise(trim_space(S.lower(S.substring_index(t, ":", 1))))
                .alias("field"),
                trim_space(rest(t, S.length(S.substring_index(t, ":", 1)) + 1)).alias("value"),
            ),
        )

    return S.filter(
        S.transform(S.split(body, "\n", -1), entry),
        lambda e: e["field"].isin("user-agent", "allow", "disallow", "crawl-delay"),
    )


@expression
def rules_of(body: Sql) -> Sql:
    """Array of struct(line_no, agent, path, allow) in file order.

    A rule belongs to the nearest agent line above it; rules without agent or
    path are void.  Works section by section, so its cost is that of the file.
    """

    def rules(entries: Sql, starts: Sql) -> Sql:
        def section(i: Sql) -> Sql:
            start = S.get(starts, i)
            end = S.coalesce(S.get(starts, i + 1), S.size(entries))
            agent = S.get(entries, start)["value"]
            return let(
                agent,
                lambda a: S.transform(
                    S.filter(
                        S.slice(entries, start + 2, end - start - 1),
                        lambda e: (e["field"] != "crawl-delay") & (e["value"] != "") & (a != ""),
                    ),
                    lambda e: S.struct(
                        e["line_no"].alias("line_no"),
                        a.alias("agent"),
                        e["value"].alias("path"),
                        (e["field"] == "allow").alias("allow"),
                    ),
                ),
            )

        return S.flatten(
            S.transform(starts, lambda _, i: section(i))
        )

    def starts(entries: Sql) -> Sql:
        marked = S.transform(
            entries, lambda e, i: S.when(e["field"] == "user-agent", i)
        )
        return S.array_compact(marked)

    return let(_entries(body), lambda e: let(starts(e), lambda s: rules(e, s)))


@expression
def delay_of(body: Sql) -> Sql:
    """Crawl delay in seconds: the last valid one of the file, else 1."""
    delays = S.transform(
        S.filter(_entries(body), lambda e: e["field"] == "crawl-delay"),
        lambda e: seconds(e["value"]),
    )
    return S.coalesce(S.try_element_at(S.array_compact(delays), -1), DEFAULT_DELAY)


def _first_of_each(rows: Sql, *names: str) -> Sql:
    """The first row of every run of equal values in a sorted array."""

    def begins(all_: Sql, row: Sql, i: Sql) -> Sql:
        before = S.get(all_, i - 1)
        same = [row[n] == before[n] for n in names]
        return (i == 0) | ~(same[0] & same[1])

    return let(rows, lambda all_: S.filter(all_, lambda row, i: begins(all_, row, i)))


@expression
def rule_index(rules: Sql) -> Sql:
    """Rules of a file made ready for ``verdict``: struct(entries, lengths); null for null.

    ``entries``: agent, path, line_no, allow of the first line of each agent and path, in their order.  ``lengths``: agent and
    n, the lengths of paths that the agent has.
    """
    entries = S.transform(
        rules,
        lambda r: S.struct(
            r["agent"].alias("agent"), r["path"].alias("path"), r["line_no"].alias("line_no"), r["allow"].alias("allow")
        ),
    )
    sizes = S.transform(rules, lambda r: S.struct(r["agent"].alias("agent"), S.length(r["path"]).alias("n")))
    return S.when(
        rules.isNotNull(),
        S.struct(
            _first_of_each(S.array_sort(entries), "agent", "path").alias("entries"),
            _first_of_each(S.array_sort(sizes), "agent", "n").alias("lengths"),
        ),
    )


@expression
def verdict(index: Sql, path: Sql, agent: Sql) -> Sql:
    """First prefix match of the agent's own rules, else of ``*``, else allowed.

    ``index``: see ``rule_index``.  The path looks up its own prefixes, of the lengths that the agent's rules have, by
    binary search; what it costs hardly grows with the number of rules.  A null path (unparsable address) is denied;
    a null index allows all.
    """

    def at(of: Sql, prefix: Sql) -> Sql:
        last = S.struct(
            of.alias("agent"), prefix.alias("path"), S.lit(2**31 - 1).alias("line_no"), S.lit(True).alias("allow")
        )
        return let(
            search.last_up_to(index["entries"], last),
            lambda e: S.when(
                (e["agent"] == of) & (e["path"] == prefix),
                S.struct(e["line_no"].alias("line_no"), e["allow"].alias("allow")),
            ),
        )

    def first(of: Sql, p: Sql) -> Sql:
        possible = S.filter(index["lengths"], lambda s: (s["agent"] == of) & (s["n"] <= S.length(p)))
        found = S.transform(possible, lambda s: let(S.left(p, s["n"]), lambda prefix: at(of, prefix)))
        return S.array_min(found)["allow"]

    shown = S.when(path == "", "/").otherwise(path)
    return S.when(path.isNull(), False).otherwise(
        let(
            shown,
            lambda p: S.coalesce(first(agent, p), first(S.lit(ANY_AGENT), p), True),
        )
    )
