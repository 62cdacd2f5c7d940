"""Inclusion-based points-to analysis with property writes and reads.

What a variable may be is the least solution of: x = new o gives o; x = y gives what y may be; o.p = y puts what y may be into
the cell p of whatever o may be; x = o.p gives what is in the cell p of whatever o may be. Writes and reads thus make
copy edges between variables and cells while the solution grows. A property * is not known: a write to it may be to
any, a read of it has all.

Packages of up to ``SMALL`` statements are solved whole, many to a task: objects as bits, and only what is new at a variable
or cell is passed on. In larger packages each round joins what is new with all that is known, both of the contents and of
the copy edges (semi-naive), and is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import SMALL, dealt, whole_packages, written

_OUT = "package_id string, holder long, property string, object long"
_ANY = "*"


def _written_to(prop: str) -> tuple[str, str]:
    """Cells that a write changes: its property's own, and that of all properties."""
    return ("=" + prop, "all")


def _read_from(prop: str) -> tuple[str, ...]:
    return ("all",) if prop == _ANY else ("=" + prop, "=" + _ANY)


def solved(statements: Iterable[tuple[str, int, int, str]]) -> Iterator[tuple[int, str | None, int]]:
    """(holder, property, object) of one package; statements: (kind, target, source, property)."""
    Place = tuple[int, str]
    held: dict[Place, int] = {}
    fresh: dict[Place, int] = {}
    copies: dict[Place, set[Place]] = {}
    writes: dict[int, list[tuple[str, int]]] = {}
    reads: dict[int, list[tuple[str, int]]] = {}
    number: dict[int, int] = {}
    objects: list[int] = []

    def put(place: Place, bits: int) -> None:
        new = bits & ~held.get(place, 0)
        if new:
            held[place] = held.get(place, 0) | new
            fresh[place] = fresh.get(place, 0) | new

    def copy(a: Place, b: Place) -> None:
        after = copies.setdefault(a, set())
        if b not in after:
            after.add(b)
            put(b, held.get(a, 0))

    rows = list(statements)
    for kind, target, source, prop in rows:
        if kind == "write":
            writes.setdefault(target, []).append((prop, source))
        elif kind == "read":
            reads.setdefault(source, []).append((prop, target))
    for kind, target, source, _ in rows:
        if kind == "new":
            if source not in number:
                number[source] = len(objects)
                objects.append(source)
            put((target, ""), 1 << number[source])
        elif kind == "copy":
            copy((source, ""), (target, ""))
    while fresh:
        place, bits = fresh.popitem()
        for b in copies.get(place, ()):
            put(b, bits)
        if place[1] == "":
            here = writes.get(place[0], ()), reads.get(place[0], ())
            while bits and (here[0] or here[1]):
                low = bits & -bits
                bits ^= low
                o = objects[low.bit_length() - 1]
                for prop, source in here[0]:
                    for cell in _written_to(prop):
                        copy((source, ""), (o, cell))
                for prop, target in here[1]:
                    for cell in _read_from(prop):
                        copy((o, cell), (target, ""))
    for (holder, cell), bits in held.items():
        if cell == "all":
            continue
        while bits:
            low = bits & -bits
            bits ^= low
            yield holder, cell[1:] if cell else None, objects[low.bit_length() - 1]


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["package_id", "holder", "property", "object"]
    types = (pa.string(), pa.int64(), pa.string(), pa.int64())
    for table in whole_packages(batches):
        packages: dict[str, list] = {}
        for package, *row in zip(*(table.column(c).to_pylist() for c in ("package_id", "kind", "target", "source", "property")), strict=True):
            packages.setdefault(package, []).append(tuple(row))
        out: list[tuple] = []
        for package, rows in packages.items():
            for row in solved(rows):
                out.append((package, *row))
                if len(out) == 1 << 15:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _large(rows: DataFrame) -> DataFrame:
    of = lambda kind: rows.where(F.col("kind") == kind)
    equal = F.concat(F.lit("="), F.col("property"))
    write = written(of("write").select("package_id", F.col("target").alias("h"), "source", F.explode(F.array(equal, F.lit("all"))).alias("cell")))
    cells = F.when(F.col("property") == _ANY, F.array(F.lit("all"))).otherwise(F.array(equal, F.lit("=" + _ANY)))
    read = written(of("read").select("package_id", F.col("source").alias("h"), "target", F.explode(cells).alias("cell")))
    place, edge = ["package_id", "h", "c"], ["package_id", "h", "c", "h2", "c2"]
    none = F.lit("")
    new_held = written(of("new").select("package_id", F.col("target").alias("h"), none.alias("c"), F.col("source").alias("o")).distinct())
    new_edges = written(of("copy").select("package_id", F.col("source").alias("h"), none.alias("c"), F.col("target").alias("h2"), none.alias("c2")).distinct())
    held, edges = new_held.where("false"), new_edges.where("false")
    while not (new_held.isEmpty() and new_edges.isEmpty()):
        held, edges = written(held.unionByName(new_held)), written(edges.unionByName(new_edges))
        passed = [x.join(y, place).select("package_id", F.col("h2").alias("h"), F.col("c2").alias("c"), "o") for x, y in ((new_held, edges), (held, new_edges))]
        seen = new_held.where("c = ''").select("package_id", "h", "o")
        stored = seen.join(write, ["package_id", "h"]).select("package_id", F.col("source").alias("h"), none.alias("c"), F.col("o").alias("h2"), F.col("cell").alias("c2"))
        loaded = seen.join(read, ["package_id", "h"]).select("package_id", F.col("o").alias("h"), F.col("cell").alias("c"), F.col("target").alias("h2"), none.alias("c2"))
        new_held = written(passed[0].unionByName(passed[1]).distinct().join(held, [*place, "o"], "left_anti").select(*place, "o"))
        new_edges = written(stored.unionByName(loaded).distinct().join(edges, edge, "left_anti").select(*edge))
    found = held.where("c <> 'all'")
    return found.select("package_id", F.col("h").alias("holder"), F.when(F.col("c") != "", F.substring("c", 2, 1 << 30)).alias("property"), F.col("o").alias("object"))


def points_to(statements: DataFrame, small: int = SMALL) -> DataFrame:
    """package_id, holder, property, object: what each variable (property null) and each property of an object may be.

    statements: package_id, kind, target, source, property: ``new`` (target is the object source), ``copy`` (target =
    source), ``write`` (target.property = source), ``read`` (target = source.property; a null property is *). Variables and objects are
    longs of their own. Rows with other nulls are left out, repeated ones count once.
    """
    prop = F.when(F.col("kind").isin("write", "read"), F.coalesce("property", F.lit(_ANY))).otherwise(F.lit(""))
    rows = statements.select("package_id", "kind", F.col("target").cast("long").alias("target"), F.col("source").cast("long").alias("source"), prop.alias("property"))
    rows = written(rows.where("package_id is not null and kind is not null and target is not null and source is not null").distinct())
    big = written(rows.groupBy("package_id").count().where(F.col("count") > small).select("package_id"))
    few = dealt(rows.join(big, "package_id", "left_anti")).mapInArrow(_solve, _OUT)
    if big.isEmpty():
        return few
    return few.unionByName(_large(written(rows.join(big, "package_id", "left_semi"))))
