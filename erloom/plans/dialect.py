"""One relational text, two engines: Spark SQL to run and DuckDB SQL to hold it against.

A query is a function of a dialect; the few constructs that differ between the engines are methods here."""

from __future__ import annotations


class Spark:
    name = "spark"

    def __init__(self, sf_dir: str, store=None):
        self.sf_dir, self.store = sf_dir, store

    def t(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def flt(self, a: str, v: str, cond: str) -> str:
        return f"filter({a}, {v} -> {cond})"

    def each(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})"

    def n(self, a: str) -> str:
        return f"cast(size({a}) as bigint)"

    def at(self, a: str, i: str | int) -> str:
        """1-based; null where there is none."""
        return f"get({a}, {i} - 1)"

    def cut(self, a: str, lo: str | int, hi: str) -> str:
        """Elements lo..hi, 1-based and inclusive."""
        return f"slice({a}, {lo}, greatest({hi} - {lo} + 1, 0))"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def united(self, a: str, b: str) -> str:
        return f"array_union({a}, {b})"

    def less(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def ordered(self, a: str) -> str:
        return f"array_sort({a})"

    def words(self, s: str) -> str:
        return f"split({s}, ' ')"

    def chars(self, s: str) -> str:
        return f"filter(split({s}, ''), c -> c <> '')"

    def joined(self, a: str, by: str = " ") -> str:
        return f"array_join({a}, '{by}')"

    def found(self, s: str, p: str) -> str:
        return f"regexp_extract_all({s}, r'{p}', 0)"

    def swap(self, s: str, p: str, r: str) -> str:
        return f"regexp_replace({s}, r'{p}', '{r}')"

    def like(self, s: str, p: str) -> str:
        return f"({s} rlike r'{p}')"

    def rows(self, a: str) -> str:
        return f"explode({a})"

    def upto(self, n: str) -> str:
        """1..n as an array; empty where n < 1."""
        return f"filter(sequence(1, greatest(cast({n} as int), 1)), i -> i <= {n})"

    def div(self, a: str, b: str | int) -> str:
        return f"({a} div {b})"

    def gathered(self, x: str) -> str:
        return f"array_sort(collect_list({x}))"

    def gathered_set(self, x: str) -> str:
        return f"array_sort(collect_set({x}))"

    def listed(self, x: str, order: str) -> str:
        return f"listagg({x}, ',') WITHIN GROUP (ORDER BY {order})"

    def best(self, x: str, *order: str) -> str:
        return f"max_by({x}, struct({', '.join(order)}))"

    def arr(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def total(self, x: str) -> str:
        return f"sum({x})"

    def md5n(self, x: str) -> str:
        return f"cast(conv(substr(md5({x}), 1, 15), 16, 10) as bigint)"

    def merged(self, a: str) -> str:
        return f"flatten({a})"

    def bit(self, m: str, i: str) -> str:
        return f"(shiftright({m}, {i}) % 2 = 1)"

    def each2(self, a: str, v: str, i: str, cond: str) -> str:
        """Elements with their 1-based place for which cond holds."""
        return f"filter({a}, ({v}, {i}0) -> {cond.replace('{' + i + '}', f'({i}0 + 1)')})"

    def every(self, a: str, v: str, cond: str) -> str:
        return f"forall({a}, {v} -> {cond})"

    def values(self, name: str, rows: list[str], *cols: str) -> str:
        return f"(SELECT * FROM VALUES {', '.join(rows)} AS {name}({', '.join(cols)}))"


class Duck(Spark):
    name = "duck"

    def __init__(self):
        super().__init__("")

    def t(self, name):
        return name

    def flt(self, a, v, cond):
        return f"list_filter({a}, lambda {v}: {cond})"

    def each(self, a, v, e):
        return f"list_transform({a}, lambda {v}: {e})"

    def n(self, a):
        return f"len({a})::bigint"

    def at(self, a, i):
        return f"({a})[{i}]"

    def cut(self, a, lo, hi):
        return f"({a})[{lo}:{hi}]"

    def has(self, a, x):
        return f"list_contains({a}, {x})"

    def common(self, a, b):
        return f"list_intersect({a}, {b})"

    def united(self, a, b):
        return f"list_distinct(list_concat({a}, {b}))"

    def less(self, a, b):
        return f"list_distinct(list_filter({a}, lambda z: NOT list_contains({b}, z)))"

    def distinct(self, a):
        return f"list_distinct({a})"

    def ordered(self, a):
        return f"list_sort({a})"

    def words(self, s):
        return f"string_split({s}, ' ')"

    def chars(self, s):
        return f"list_filter(string_split({s}, ''), lambda c: c <> '')"

    def joined(self, a, by=" "):
        return f"array_to_string({a}, '{by}')"

    def found(self, s, p):
        return f"regexp_extract_all({s}, '{p}')"

    def swap(self, s, p, r):
        return f"regexp_replace({s}, '{p}', '{r.replace('$', chr(92))}', 'g')"

    def like(self, s, p):
        return f"regexp_matches({s}, '{p}')"

    def rows(self, a):
        return f"unnest({a})"

    def upto(self, n):
        return f"range(1, {n} + 1)"

    def div(self, a, b):
        return f"({a} // {b})"

    def gathered(self, x):
        return f"coalesce(list_sort(list({x})), [])"

    def gathered_set(self, x):
        return f"coalesce(list_sort(list(DISTINCT {x})), [])"

    def listed(self, x, order):
        return f"string_agg({x}, ',' ORDER BY {order})"

    def best(self, x, *order):
        return f"arg_max({x}, ({', '.join(order)}))"

    def arr(self, *x):
        return f"[{', '.join(x)}]"

    def total(self, x):
        return f"sum({x})::bigint"

    def md5n(self, x):
        return f"('0x' || substr(md5({x}), 1, 15))::bigint"

    def merged(self, a):
        return f"flatten({a})"

    def bit(self, m, i):
        return f"(({m} >> ({i})) % 2 = 1)"

    def each2(self, a, v, i, cond):
        return f"list_filter({a}, lambda {v}, {i}: {cond.replace('{' + i + '}', i)})"

    def every(self, a, v, cond):
        return f"coalesce(list_bool_and(list_transform({a}, lambda {v}: {cond})), true)"

    def values(self, name, rows, *cols):
        return f"(SELECT * FROM (VALUES {', '.join(rows)}) AS {name}({', '.join(cols)}))"
