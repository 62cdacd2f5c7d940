"""Reachability: reflexive or transitive closure of an edge table from seeds.

Packages of up to ``SMALL`` edges and seeds, and at most ``PAIRS`` pairs of one and the other, are closed whole,
many to a task: rows are dealt by package and a task walks the frontiers of some packages at once in numpy. A bit
for each pair of an origin and a node says what is known, so a hop costs what it finds, not what is known.

A larger package is closed by all executors. Without a bound on hops the graph is first contracted: nodes that no
seed starts from and whose removal adds no edges (those on chains, in trees, between two others) are taken out, many
at a time, and put back afterwards, so that a long chain takes a number of rounds that grows with its logarithm.
What is left is closed by doubling where most of its nodes are seeds, else hop by hop. Every round is written to the
checkpoint folder, so that a lost executor repeats one round.
The per-package row counts decide which way is taken; the result is the same.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = 200_000
PAIRS = 4_000_000
_BATCH = 20_000
_KEY = ["package_id", "origin", "node"]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a temporary one only where all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again: for many rounds, as the optimiser's constraints grow over checkpoints."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_rows(df: DataFrame, *order: str) -> DataFrame:
    """As written, for rows that are read many times over: each task's are in order, so that a filter on these columns skips pages.

    Values are stored plainly, as the planner goes by the files' size: rows that repeat would else look small enough to broadcast.
    """
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.sortWithinPartitions(*order).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_packages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some packages each, all rows of them, from rows sorted by package."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and sum(b.num_rows for b in held) > _BATCH:
            last = held[-1].column("package_id")[-1].as_py()
            n = pc.index(pc.not_equal(batch.column("package_id"), last), True).as_py()
            n = batch.num_rows if n < 0 else n
            held.append(batch.slice(0, n))
            if n == batch.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held, batch = [], batch.slice(n)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def spans(table: pa.Table) -> tuple[pa.Array, list[tuple[int, int]]]:
    """The packages of a table of whole_packages, and the rows [from, to) of each."""
    coded = table.column("package_id").combine_chunks().dictionary_encode()
    cuts = np.flatnonzero(np.diff(coded.indices.to_numpy(zero_copy_only=False))) + 1
    edges = [0, *cuts.tolist(), table.num_rows]
    return coded.dictionary, list(zip(edges, edges[1:], strict=False))


def dealt(rows: DataFrame) -> DataFrame:
    """rows with all of a package in one task, in a row."""
    return rows.repartition("package_id").sortWithinPartitions("package_id")


def _walk(batches: Iterable[pa.RecordBatch], min_hops: int, max_hops: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by package: edges and seeds (seed)."""

    def close(table: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = table.column("package_id").combine_chunks().dictionary_encode()
        names, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        seed = table.column("seed").to_numpy(zero_copy_only=False).astype(bool)
        edge = ~seed

        def out(p: np.ndarray, o: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(p), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.record_batch([names.take(pa.array(p[s])), pa.array(o[s]), pa.array(d[s])], names=_KEY)

        # a node is a package and an id, as one number: packages one after the other, each with the ids in order
        ids, number = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y = at * len(ids) + number[: len(a)], at * len(ids) + number[len(a) :]
        # nodes that edges touch
        nodes, code = np.unique(np.concatenate((x[edge], y[edge])), return_inverse=True)
        src, dst = code[: edge.sum()], code[edge.sum() :]
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        n = len(nodes)
        begin = np.searchsorted(src, np.arange(n + 1))
        of_node = nodes // max(len(ids), 1)
        first = np.searchsorted(of_node, np.arange(len(names) + 1))  # nodes of a package are together
        node_id = ids[nodes - of_node * len(ids)]

        origins, origin = np.unique(x[seed], return_inverse=True)
        spots, spot = np.unique(y[seed], return_inverse=True)
        once = np.unique(origin * len(spots) + spot)
        origin, spot = once // max(len(spots), 1), spots[once % max(len(spots), 1)]
        of_origin = origins // max(len(ids), 1)
        origin_id = ids[origins - of_origin * len(ids)]
        node = np.minimum(np.searchsorted(nodes, spot), n - 1)
        there = nodes[node] == spot if n else np.zeros(len(spot), bool)
        if min_hops == 0:
            lone = ~there  # no edge touches them
            yield from out(of_origin[origin[lone]], origin_id[origin[lone]], ids[spot[lone] % max(len(ids), 1)])
        origin, node = origin[there], node[there]
        if min_hops > 0:
            leads = begin[node + 1] > begin[node]
            origin, node = origin[leads], node[leads]
        kept, origin = np.unique(origin, return_inverse=True)
        of_origin, origin_id = of_origin[kept], origin_id[kept]
        width = (first[1:] - first[:-1])[of_origin]
        base = np.concatenate(([0], np.cumsum(width)))[: len(kept)].astype(np.int64) - first[of_origin]
        known = np.zeros(int(width.sum()), bool)
        if min_hops == 0:
            known[base[origin] + node] = True
            yield from out(of_origin[origin], origin_id[origin], node_id[node])
        for _ in range(max_hops):
            count = begin[node + 1] - begin[node]
            ends = np.cumsum(count)
            if not len(ends) or not ends[-1]:
                break
            place = np.arange(ends[-1]) + np.repeat(begin[node] - (ends - count), count)
            o, d = np.repeat(origin, count), dst[place]
            bit = base[o] + d
            bit, one = np.unique(bit[new], return_index=True) if (new := ~known[bit]).any() else (bit[:0], None)
            if one is None:
                break
            origin, node = o[new][one], d[new][one]
            known[bit] = True
            yield from out(of_origin[origin], origin_id[origin], node_id[node])

    for table in whole_packages(batches):
        yield from close(table)


def _small(rows: DataFrame, min_hops: int, max_hops: int) -> DataFrame:
    return dealt(rows).mapInArrow(lambda batches: _walk(batches, min_hops, max_hops), "package_id string, origin long, node long")


def _frontiers(step: DataFrame, seeds: DataFrame, min_hops: int, max_hops: int) -> DataFrame:
    """Hop by hop: the last round's new rows over the edges, without what is known."""
    step = step.select("package_id", F.col("src").alias("node"), F.col("dst").alias("next"))
    frontier, parts, hops = seeds, [seeds] if min_hops == 0 else [], 0
    while hops < max_hops and not frontier.isEmpty():
        found = frontier.join(step, ["package_id", "node"]).select("package_id", "origin", F.col("next").alias("node")).distinct()
        if parts:
            found = found.join(reduce(DataFrame.unionByName, parts), _KEY, "left_anti")
        frontier = checkpointed(found)
        parts.append(frontier)
        if len(parts) > 8:
            parts = [checkpointed(reduce(DataFrame.unionByName, parts))]
        hops += 1
    return reduce(DataFrame.unionByName, parts) if parts else frontier


def _doubled(step: DataFrame) -> DataFrame:
    """All pairs (package_id, src, dst) that one or more edges join: each round doubles the length of the walks."""
    known, length = step.withColumn("d", F.lit(1)), 1
    while True:
        # a shortest walk of over length edges, and up to twice that, is one of exactly length and a shorter one
        last = known.where(F.col("d") == length).select("package_id", "src", F.col("dst").alias("mid"))
        further = last.join(known.select("package_id", F.col("src").alias("mid"), "dst", "d"), ["package_id", "mid"])
        further = further.groupBy("package_id", "src", "dst").agg((F.min("d") + length).alias("d"))
        found = checkpointed(further.join(known, ["package_id", "src", "dst"], "left_anti"))
        if found.isEmpty():
            return known.drop("d")
        known, length = checkpointed(known.unionByName(found)), 2 * length


def _contracted(step: DataFrame, kept: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges between the nodes of kept (package_id, node) and those that could not be taken out; the edges into what each round took out."""
    taken: list[DataFrame] = []
    ends = lambda df: df.select("package_id", F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(df.select("package_id", F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    while True:
        degree = ends(step).groupBy("package_id", "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        # a node without edges onward goes before others: no two are neighbours, so all leaves of a hub go in one round
        rank = F.struct(F.col("o") > 0, F.xxhash64("package_id", "node", F.lit(len(taken))))
        free = checkpointed(degree.where("i * o <= i + o").join(kept, ["package_id", "node"], "left_anti").select("package_id", "node", rank.alias("rank")))
        # of two neighbours the one with the smaller rank
        one = step.join(free.withColumnsRenamed({"node": "src", "rank": "ra"}), ["package_id", "src"]).join(free.withColumnsRenamed({"node": "dst", "rank": "rb"}), ["package_id", "dst"])
        beaten = one.select("package_id", F.when(F.col("ra") > F.col("rb"), F.col("src")).otherwise(F.col("dst")).alias("node"))
        out = checkpointed(free.join(beaten, ["package_id", "node"], "left_anti").select("package_id", "node"))
        if out.isEmpty():
            return step, taken
        as_ = lambda c: out.withColumnRenamed("node", c)
        into = checkpointed(step.join(as_("dst"), ["package_id", "dst"], "left_semi"))
        onward = step.join(as_("src"), ["package_id", "src"], "left_semi")
        over = into.withColumnRenamed("dst", "mid").join(onward.withColumnRenamed("src", "mid"), ["package_id", "mid"]).where("src <> dst").select("package_id", "src", "dst")
        rest = step.join(as_("dst"), ["package_id", "dst"], "left_anti").join(as_("src"), ["package_id", "src"], "left_anti")
        step = checkpointed(rest.select("package_id", "src", "dst").unionByName(over).distinct())
        taken.append(into)


def _large(edges: DataFrame, seeds: DataFrame, min_hops: int, max_hops: int | None) -> DataFrame:
    step = checkpointed(edges.select("package_id", "src", "dst").distinct())
    seeds = checkpointed(seeds.select(*_KEY).distinct())
    if max_hops is not None:
        return _frontiers(step, seeds, min_hops, max_hops)
    if min_hops:  # one hop, then any number
        first = seeds.join(step.select("package_id", F.col("src").alias("node"), F.col("dst").alias("next")), ["package_id", "node"])
        seeds = checkpointed(first.select("package_id", "origin", F.col("next").alias("node")).distinct())
    kept = checkpointed(seeds.select("package_id", "node").distinct())
    core, taken = _contracted(checkpointed(step.where("src <> dst")), kept)
    inner = core.select("package_id", F.col("dst").alias("node")).unionByName(core.select("package_id", F.col("src").alias("node"))).distinct()
    size, own = inner.count(), inner.join(kept, ["package_id", "node"], "left_semi").count()
    if size and size <= 2 * own:
        pairs = _doubled(core).select("package_id", F.col("src").alias("node"), F.col("dst").alias("next"))
        found = seeds.join(pairs, ["package_id", "node"]).select("package_id", "origin", F.col("next").alias("node"))
        known = checkpointed(seeds.unionByName(found).distinct())
    else:
        known = _frontiers(core, seeds, 0, 1 << 30)
    for i, into in enumerate(reversed(taken)):
        found = known.join(into.select("package_id", F.col("src").alias("node"), F.col("dst").alias("next")), ["package_id", "node"]).select("package_id", "origin", F.col("next").alias("node"))
        known = known.unionByName(found.distinct())  # what a round took out was not known before
        known = checkpointed(known) if i % 4 == 3 else known
    return known


def reach(edges: DataFrame, seeds: DataFrame, min_hops: int = 1, max_hops: int | None = None, backward: bool = False, small: int = SMALL, few: bool = False) -> DataFrame:
    """package_id, origin, node: what each origin reaches over edges (package_id, src, dst) from its seeds (package_id, origin, node).

    min_hops 0 has the seeds themselves; with 1 a seed is reached over a cycle only. Rows differ. Edges and seeds are evaluated once.
    few: no package has more than may be closed whole, as was counted before; nothing is written or counted, edges and seeds are evaluated with the result.
    """
    edges = edges.select("package_id", *((F.col("dst").alias("a"), F.col("src").alias("b")) if backward else (F.col("src").alias("a"), F.col("dst").alias("b"))), F.lit(False).alias("seed"))
    seeds = seeds.select("package_id", F.col("origin").alias("a"), F.col("node").alias("b"), F.lit(True).alias("seed"))
    rows = edges.unionByName(seeds).where("package_id is not null and a is not null and b is not null")
    if few:
        return _small(rows, min_hops, (1 << 30) if max_hops is None else max_hops)
    rows = checkpointed(rows)
    e, s = F.count_if(~F.col("seed")), F.count_if("seed")
    size = rows.groupBy("package_id").agg(e.alias("e"), s.alias("s"))
    big = size.where((F.col("e") + F.col("s") > small) | (F.col("e") * F.col("s") > PAIRS)).select("package_id")
    if big.isEmpty():
        return _small(rows, min_hops, (1 << 30) if max_hops is None else max_hops)
    big = checkpointed(big)
    rest, whole = rows.join(big, "package_id", "left_anti"), rows.join(big, "package_id", "left_semi")
    large = _large(whole.where("not seed").select("package_id", F.col("a").alias("src"), F.col("b").alias("dst")), whole.where("seed").select("package_id", F.col("a").alias("origin"), F.col("b").alias("node")), min_hops, max_hops)
    return _small(rest, min_hops, (1 << 30) if max_hops is None else max_hops).unionByName(large)


def reached(edges: DataFrame, seeds: DataFrame, min_hops: int = 1, max_hops: int | None = None, backward: bool = False, small: int = SMALL, few: bool = False) -> DataFrame:
    """package_id, node: what any seed (package_id, node) reaches. Linear in the edges, as origins are not told apart."""
    zero = seeds.select("package_id", F.lit(0).cast("long").alias("origin"), "node")
    return reach(edges, zero, min_hops, max_hops, backward, small, few).select("package_id", "node")


def paths(spark: SparkSession, edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """package_id, path: the node arrays of all walks of up to max_hops edges from the seeds, by a recursive query. For acyclic edges or a small max_hops."""
    return spark.sql(
        f"""WITH RECURSIVE walk(package_id, node, path) AS (
            SELECT package_id, node, array(node) FROM {{seeds}}
            UNION ALL
            SELECT w.package_id, e.dst, array_append(w.path, e.dst) FROM walk w JOIN {{edges}} e
            ON e.package_id = w.package_id AND e.src = w.node WHERE size(w.path) <= {max_hops})
        SELECT package_id, path FROM walk""",
        edges=edges.select("package_id", "src", "dst"),
        seeds=seeds.select("package_id", "node"),
    )
