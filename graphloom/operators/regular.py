"""Regular path queries: paths whose edges spell a word of a regular expression over edge conditions.

``step``, ``seq``, ``alt``, ``many`` and ``maybe`` build an expression; its automaton (one state for each place of a step) is
joined to the edges once, and the closure of pairs (node, state) gives the ends: a cycle of edges or of states is passed
once, whatever number of paths it holds.

``prefixes`` gives the names read on the way, as a tree: from each origin the prefixes of names and the nodes under each. A
read within a cycle leads to a node that is opened under its first prefix only (the shortest, then the smallest);
its further prefixes are leaves, edges back into the tree. So n nodes and m reads that form one cycle give at most
m + 1 prefixes each time the cycle is entered, where the trails over them would be factorially many.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import SMALL, dealt, reach, whole_packages, written
from .components import strong_components, walked


@dataclass(frozen=True)
class Expression:
    """Places of steps (condition, backward); those that may come first and last, those that may follow each; whether it has the empty word."""

    places: tuple[tuple[Column, bool], ...]
    first: frozenset[int]
    last: frozenset[int]
    follow: frozenset[tuple[int, int]]
    empty: bool


def step(condition: Column, backward: bool = False) -> Expression:
    """One edge that meets the condition, or such an edge against its direction."""
    return Expression(((condition, backward),), frozenset({0}), frozenset({0}), frozenset(), False)


def _moved(e: Expression, by: int) -> Expression:
    return Expression(e.places, frozenset(x + by for x in e.first), frozenset(x + by for x in e.last), frozenset((x + by, y + by) for x, y in e.follow), e.empty)


def seq(*parts: Expression) -> Expression:
    def two(a: Expression, b: Expression) -> Expression:
        b = _moved(b, len(a.places))
        follow = a.follow | b.follow | {(x, y) for x in a.last for y in b.first}
        return Expression(a.places + b.places, a.first | (b.first if a.empty else frozenset()), b.last | (a.last if b.empty else frozenset()), follow, a.empty and b.empty)

    return reduce(two, parts)


def alt(*parts: Expression) -> Expression:
    def two(a: Expression, b: Expression) -> Expression:
        b = _moved(b, len(a.places))
        return Expression(a.places + b.places, a.first | b.first, a.last | b.last, a.follow | b.follow, a.empty or b.empty)

    return reduce(two, parts)


def maybe(e: Expression) -> Expression:
    return Expression(e.places, e.first, e.last, e.follow, True)


def many(e: Expression, least: int = 0) -> Expression:
    """Any number of times, at least 0 or 1."""
    if least not in (0, 1):
        raise ValueError("least is 0 or 1")
    return Expression(e.places, e.first, e.last, e.follow | {(x, y) for x in e.last for y in e.first}, e.empty or not least)


def matches(edges: DataFrame, seeds: DataFrame, pattern: Expression, small: int = SMALL) -> DataFrame:
    """package_id, origin, node: the nodes at which a path from a seed (package_id, origin, node) ends whose edges spell the pattern.

    edges: package_id, src, dst and what the conditions use. Node ids times the number of states must be longs; else an error is raised.
    """
    states = len(pattern.places) + 1  # 0: nothing read
    limit = (1 << 63) // states - 1
    fits = lambda c: F.when(F.abs(c) < limit, c * states).when(c.isNotNull(), F.raise_error(F.lit("a node id is too large for the pattern's states")).cast("long"))
    parts = []
    for state, (condition, backward) in enumerate(pattern.places):
        before = sorted([0] * (state in pattern.first) + [x + 1 for x, y in pattern.follow if y == state])
        a, b = ("dst", "src") if backward else ("src", "dst")
        found = edges.where(condition).select("package_id", fits(F.col(a).cast("long")).alias("a"), (fits(F.col(b).cast("long")) + (state + 1)).alias("dst"))
        parts.append(found.select("package_id", F.explode(F.array(*(F.col("a") + x for x in before))).alias("src"), "dst"))
    seeds = seeds.select("package_id", F.col("origin").cast("long").alias("origin"), fits(F.col("node").cast("long")).alias("node"))
    product = reduce(DataFrame.unionByName, parts)
    good = sorted({x + 1 for x in pattern.last} | ({0} if pattern.empty else set()))
    ends = reach(product, seeds, 0, small=small).where(F.pmod("node", F.lit(states)).isin(*good))
    return ends.select("package_id", "origin", F.expr(f"(node - pmod(node, {states})) div {states}").alias("node")).distinct()


_ROWS = "package_id string, origin string, prefix array<string>, node long"


class _Package:
    """One package's edges, for the tree of prefixes."""

    def __init__(self, edges: list[tuple[int, int, str, str]]):
        self.stay: dict[int, list[int]] = {}
        self.read: dict[int, list[tuple[str, int]]] = {}
        self.end: dict[int, list[int]] = {}
        for a, b, kind, name in edges:
            if kind == "read":
                self.read.setdefault(a, []).append((name, b))
            else:
                (self.stay if kind == "stay" else self.end).setdefault(a, []).append(b)
        open_ = [(a, b) for a, b, kind, _ in edges if kind != "end"]
        ids = sorted({x for e in open_ for x in e})
        at = {x: i for i, x in enumerate(ids)}
        out: list[list[int]] = [[] for _ in ids]
        for a, b in open_:
            out[at[a]].append(at[b])
        begin = [0]
        for x in out:
            begin.append(begin[-1] + len(x))
        self.part = {ids[v]: ids[min(c)] for c in walked(begin, [w for x in out for w in x]) for v in c}
        self.near: dict[int, list[int]] = {}
        self.beyond: dict[int, list[int]] = {}

    def _over(self, start: int, steps: Iterable[dict]) -> list[int]:
        seen, todo = {start}, [start]
        while todo:
            v = todo.pop()
            for s in steps:
                for w in s.get(v, ()):
                    w = w[1] if isinstance(w, tuple) else w
                    if w not in seen:
                        seen.add(w)
                        todo.append(w)
        return sorted(seen)

    def spread(self, v: int) -> list[int]:
        if v not in self.near:
            self.near[v] = self._over(v, (self.stay,))
        return self.near[v]

    def after(self, v: int) -> list[int]:
        """What is reached over an end edge of v and then anything."""
        if v not in self.beyond:
            every = (self.stay, self.read, self.end)
            self.beyond[v] = sorted({x for w in self.end.get(v, ()) for x in self._over(w, every)})
        return self.beyond[v]

    def tree(self, seeds: Iterable[int]) -> Iterator[tuple[tuple, int]]:
        """(prefix, node)"""
        part = lambda v: self.part.get(v, v)
        state = {((), v, part(v), ()) for v in seeds}
        opened: set[tuple] = set()
        while state:
            at = {(prefix, w, part(w), entry if part(w) == p else prefix) for prefix, v, p, entry in state for w in self.spread(v)}
            rows = {(prefix, w) for prefix, w, _, _ in at}
            rows |= {(prefix, x) for prefix, w, _, _ in at for x in self.after(w)}
            yield from rows
            first: dict[tuple, tuple] = {}
            for prefix, w, p, entry in at:
                key = (w, p, entry)
                if key not in opened and (key not in first or prefix < first[key]):
                    first[key] = prefix
            opened |= set(first)
            state = set()
            for (w, p, entry), prefix in first.items():
                for name, x in self.read.get(w, ()):
                    longer = (*prefix, name)
                    state.add((longer, x, part(x), entry if part(x) == p else longer))


def _trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["package_id", "origin", "prefix", "node"]
    for table in whole_packages(batches):
        columns = table.to_pydict()
        packages: dict[str, tuple[list, dict[str, list[int]]]] = {}
        for package, a, b, kind, name in zip(columns["package_id"], columns["src"], columns["dst"], columns["kind"], columns["name"], strict=True):
            edges, seeds = packages.setdefault(package, ([], {}))
            if kind == "seed":
                seeds.setdefault(name, []).append(a)
            else:
                edges.append((a, b, kind, name))
        out: list[tuple] = []
        for package, (edges, seeds) in packages.items():
            p = _Package(edges)
            for origin, nodes in seeds.items():
                for prefix, node in p.tree(nodes):
                    out.append((package, origin, list(prefix), node))
                    if len(out) >= 1 << 14:
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.list_(pa.string()), pa.int64()), strict=True)], names=names)
                        out = []
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.list_(pa.string()), pa.int64()), strict=True)], names=names)


def _large(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """As _Package.tree, a round for each length of prefixes."""
    pairs = lambda df: df.select("package_id", "src", "dst")
    own = lambda df, c: df.select("package_id", F.col(c).alias("origin"), F.col(c).alias("node")).distinct()
    stay, read, end = (edges.where(F.col("kind") == k) for k in ("stay", "read", "end"))
    parts = written(strong_components(pairs(edges.where("kind <> 'end'"))).select("package_id", "node", F.col("component").alias("part")))
    of = lambda df, c, to: df.join(parts.select("package_id", F.col("node").alias(c), F.col("part").alias(to)), ["package_id", c], "left").withColumn(to, F.coalesce(to, c))
    starts = own(seeds, "node").unionByName(own(read, "dst")).distinct()
    spread = reach(pairs(stay), starts, 0).select("package_id", F.col("origin").alias("node"), F.col("node").alias("w"))
    spread = written(of(spread, "w", "wp"))
    beyond = reach(pairs(edges), own(end, "dst"), 0).select("package_id", F.col("origin").alias("dst"), F.col("node").alias("x"))
    after = written(pairs(end).join(beyond, ["package_id", "dst"]).select("package_id", F.col("src").alias("w"), "x").distinct())
    read = written(of(read.select("package_id", F.col("src").alias("w"), F.col("dst").alias("x"), "name").distinct(), "x", "xp"))
    key = ["package_id", "origin"]
    none = F.array().cast("array<string>")
    state = written(of(seeds.select(*key, "node", none.alias("prefix"), none.alias("entry")).distinct(), "node", "part"))
    opened, found = state.select(*key, F.col("node").alias("w"), F.col("part").alias("wp"), "entry").where("false"), []
    while not state.isEmpty():
        at = state.join(spread, ["package_id", "node"]).select(*key, "prefix", "w", "wp", F.when(F.col("wp") == F.col("part"), F.col("entry")).otherwise(F.col("prefix")).alias("entry"))
        at = written(at.distinct())
        rows = at.select(*key, "prefix", F.col("w").alias("node")).unionByName(at.join(after, ["package_id", "w"]).select(*key, "prefix", F.col("x").alias("node")))
        found.append(written(rows.distinct()))
        first = at.join(opened, [*key, "w", "wp", "entry"], "left_anti").groupBy(*key, "w", "wp", "entry").agg(F.min("prefix").alias("prefix"))
        first = written(first)
        opened = opened.unionByName(first.drop("prefix"))
        longer = F.array_append("prefix", F.col("name"))
        state = first.join(read, ["package_id", "w"]).select(*key, F.col("x").alias("node"), F.col("xp").alias("part"), longer.alias("prefix"), F.when(F.col("xp") == F.col("wp"), F.col("entry")).otherwise(longer).alias("entry"))
        state = written(state.distinct())
    return reduce(DataFrame.unionByName, found) if found else state.select(*key, "prefix", "node")


def prefixes(edges: DataFrame, seeds: DataFrame, small: int = SMALL) -> DataFrame:
    """package_id, origin, prefix, node: the nodes under each prefix of names from the seeds (package_id, origin string, node) of an origin.

    edges: package_id, src, dst, kind, name. A ``stay`` edge keeps the prefix, a ``read`` edge appends its name (null: *), and
    after an ``end`` edge any edge keeps it. Packages of up to small rows are walked many to a task, in larger ones
    each length of prefixes is a round of joins.
    """
    step_ = edges.select("package_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "kind", F.when(F.col("kind") == "read", F.coalesce("name", F.lit("*"))).alias("name")).distinct()
    seed = seeds.select("package_id", F.col("node").cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit("seed").alias("kind"), F.col("origin").alias("name")).distinct()
    rows = written(step_.where("dst is not null").unionByName(seed).where("package_id is not null and src is not null"))
    big = written(rows.groupBy("package_id").count().where(F.col("count") > small).select("package_id"))
    few = dealt(rows.join(big, "package_id", "left_anti")).mapInArrow(_trees, _ROWS)
    if big.isEmpty():
        return few
    rows = written(rows.join(big, "package_id", "left_semi"))
    large = _large(rows.where("kind <> 'seed'"), rows.where("kind = 'seed'").select("package_id", F.col("name").alias("origin"), F.col("src").alias("node")))
    return few.unionByName(large.select("package_id", "origin", "prefix", "node"))
