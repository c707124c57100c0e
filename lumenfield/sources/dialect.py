"""The handful of spellings that differ between Spark SQL and an ANSI checker.

Derived tables are stated once as SQL text; these helpers fill in the spellings, so the rules that
map the given tables onto the catalogue can be evaluated by either engine.
"""

from __future__ import annotations


class SparkText:
    name = "spark"

    def src(self, table: str) -> str:
        return "{" + table + "}"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def plus_minutes(self, ts: str, n: str) -> str:
        return f"({ts} + make_dt_interval(0, 0, cast({n} as int), 0))"

    def ts(self, col: str) -> str:
        return f"cast({col} as timestamp)"

    def array(self, *items: str) -> str:
        return "array(" + ", ".join(items) + ")"

    def json_int(self, col: str, key: str) -> str:
        return f"cast(get_json_object({col}, '$.{key}') as bigint)"


class CheckText(SparkText):
    name = "check"

    def src(self, table: str) -> str:
        return table

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def plus_minutes(self, ts: str, n: str) -> str:
        return f"({ts} + to_minutes(cast({n} as bigint)))"

    def array(self, *items: str) -> str:
        return "[" + ", ".join(items) + "]"

    def json_int(self, col: str, key: str) -> str:
        return f"cast(json_extract_string({col}, '$.{key}') as bigint)"


def frac(x: str) -> str:
    return f"(({x}) - floor({x}))"
