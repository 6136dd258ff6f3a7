"""Expressions that Spark and DuckDB spell differently, so that a query and its oracle come from one text."""

from __future__ import annotations


class Spark:
    name = "spark"

    @staticmethod
    def text(s: str) -> str:
        """A string literal; Spark reads backslashes in it."""
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rlike(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.text(pattern)})"

    def word(self, x: str, terms: list[str]) -> str:
        """Whole ASCII words, in lower-cased x."""
        return self.rlike(x, rf"(?<![A-Za-z0-9_])(?:{'|'.join(terms)})(?![A-Za-z0-9_])")

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def replace_first(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text('(?s)' + pattern + '(.*)$')}, {self.text(by + '$1')})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def words(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.text(pattern)})"

    def found(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, 0)"

    def group(self, x: str, pattern: str, k: int) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {k})"

    def keep(self, xs: str, cond: str) -> str:
        return f"filter({xs}, x -> {cond})"

    def each(self, xs: str, expr: str) -> str:
        return f"transform({xs}, x -> {expr})"

    def distinct(self, xs: str) -> str:
        return f"array_distinct({xs})"

    def size(self, xs: str) -> str:
        return f"size({xs})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(map(self.text, items))})"

    def joined(self, xs: str, sep: str) -> str:
        return f"array_join({xs}, {self.text(sep)})"

    def sorted(self, xs: str) -> str:
        return f"array_sort({xs})"

    def list_where(self, x: str, cond: str) -> str:
        return f"sort_array(collect_list({x}) FILTER (WHERE {cond}))"

    def rows(self, table: str, xs: str, name: str) -> str:
        return f"{table} LATERAL VIEW explode({xs}) AS {name}"

    def minutes_after(self, start: str, n: str) -> str:
        return f"timestampadd(MINUTE, {n}, TIMESTAMP '{start}')"

    def seconds(self, ts: str) -> str:
        return f"unix_timestamp({ts})"

    def micros(self, ts: str) -> str:
        return f"unix_micros(cast({ts} AS timestamp))"

    def integer(self, x: str) -> str:
        return f"cast({x} AS bigint)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS double) * cast(y AS double)), cast(0 AS double), (s, z) -> s + z)"

    def bucket(self, ts: str, minutes: int) -> str:
        return f"window({ts}, '{minutes} minutes').start"

    def json(self, x: str, key: str) -> str:
        return f"cast(get_json_object({x}, '$.{key}') AS bigint)"


class Duck(Spark):
    name = "duck"

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def rlike(self, x, pattern):
        return f"regexp_matches({x}, {self.text(pattern)})"

    def word(self, x, terms):
        return self.rlike(x, rf"\b(?:{'|'.join(terms)})\b")

    def replace_all(self, x, pattern, by):
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def replace_first(self, x, pattern, by):
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def sha256(self, x):
        return f"sha256({x})"

    def words(self, x, pattern):
        return f"string_split_regex({x}, {self.text(pattern)})"

    def found(self, x, pattern):
        return f"regexp_extract_all({x}, {self.text(pattern)})"

    def keep(self, xs, cond):
        return f"list_filter({xs}, lambda x: {cond})"

    def each(self, xs, expr):
        return f"list_transform({xs}, lambda x: {expr})"

    def distinct(self, xs):
        return f"list_distinct({xs})"

    def size(self, xs):
        return f"len({xs})"

    def common(self, a, b):
        return f"list_intersect({a}, {b})"

    def array(self, items):
        return f"[{', '.join(map(self.text, items))}]"

    def joined(self, xs, sep):
        return f"array_to_string({xs}, {self.text(sep)})"

    def sorted(self, xs):
        return f"list_sort({xs})"

    def list_where(self, x, cond):
        return f"coalesce(list_sort(list({x}) FILTER (WHERE {cond})), [])"

    def rows(self, table, xs, name):
        return f"(SELECT *, unnest({xs}) AS {name} FROM {table})"

    def minutes_after(self, start, n):
        return f"(TIMESTAMP '{start}' + to_minutes(cast({n} AS bigint)))"

    def seconds(self, ts):
        return f"epoch({ts})"

    def micros(self, ts):
        return f"epoch_us({ts})"

    def dot(self, a, b):
        return f"list_dot_product(cast({a} AS double[]), cast({b} AS double[]))"

    def bucket(self, ts, minutes):
        return f"time_bucket(INTERVAL {minutes} MINUTE, {ts})"

    def json(self, x, key):
        return f"cast(json_extract_string({x}, '$.{key}') AS bigint)"
