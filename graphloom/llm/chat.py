"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is lines (conv_id, turn, line, text): turn and line give their order, nothing else. The model's
states are three roles, each beginning a turn or going on with it; a line is seen as its speaker marker (of a role,
or none), whether a blank line is before it, and features of its text (length, question, list or code). Viterbi's best path gives
the roles, a line in a beginning state starts a turn, and turns are rendered without their markers as

    <|role|>
    text<|end|>

Scale: a conversation may be of any length. Lines are cut in blocks of ``BLOCK``; each block becomes a 6 x 6
matrix, the best score from any state before it to any state at its end, which multiply (max-plus) to those of
spans of ``SPAN`` turns and of the whole conversation. States at the borders then go down the same levels, and each block is decoded by
itself between its two border states: exactly Viterbi's path, but no task holds a conversation's lines.

Cases: null texts are empty lines. A conversation without markers is decoded from text features and the order of
roles alone. Null conv_ids are one conversation. Lines that repeat their place are read in order of their text.
Rows with a null turn or line come first. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime

ROLES = ("system", "user", "assistant")
BLOCK = 512
SPAN = 4096
TEXT_KINDS = 12
#: The names that open a turn, by role.
NAMES = {"system": "system|sys", "user": "user|human|you|customer|question|q|instruction|prompt|inst", "assistant": "assistant|ai|bot|gpt|model|agent|answer|a|response"}
_MARKER = r"(?i)^\s*(?:\*\*|#{{1,4}}\s*|<\|(?:im_start\|>)?|\[/?|<<?)?\s*(?:{0})\s*(?:\*\*\s*:|:\s*\*\*|\|>\s*:?|\]\s*:?|>>?\s*:?|:)\s*"
STATES = 2 * len(ROLES)  # role r begins in state 2 r and goes on in 2 r + 1


def marker_of(text: Column) -> Column:
    """0: none, 1 + r: one of role r."""
    out = F.lit(0)
    for i, role in enumerate(ROLES):
        out = F.when(text.rlike(_MARKER.format(NAMES[role])), F.lit(1 + i)).otherwise(out)
    return out


def without_marker(text: Column) -> Column:
    return F.regexp_replace(text, _MARKER.format("|".join(NAMES.values())), "")


def text_kind(text: Column) -> Column:
    """Length in three steps, question or not, list or code or not."""
    size = F.when(F.length(text) < 160, 0).when(F.length(text) < 480, 1).otherwise(2)
    return (size * 4 + F.when(text.rlike(r"\?\s*$"), 2).otherwise(0) + F.when(text.rlike(r"^\s*(?:[-*\d]+[.)]?\s|```|    )"), 1).otherwise(0)).cast("int")


class Model:
    """Log probabilities: first (state), move (state, state), seen (state, marker * 2 + blank, text kind)."""

    def __init__(self, first: np.ndarray, move: np.ndarray, sign: np.ndarray, text: np.ndarray):
        self.first, self.move, self.sign, self.text = first, move, sign, text

    def seen(self, code: np.ndarray) -> np.ndarray:
        """A row of log probabilities for each observation code (marker * 2 + blank) * TEXT_KINDS + text kind."""
        return self.sign[:, code // TEXT_KINDS].T + self.text[:, code % TEXT_KINDS].T


def fit(turns: DataFrame) -> Model:
    """From turns with known roles (conv_id, turn, role, text): how roles follow each other, how many lines a turn has, what a line of each role looks like, and what markers and blank lines the transcripts of these turns have. Counts of all rows, added up by Spark."""
    known = turns.where(F.lower("role").isin(*ROLES)).select("conv_id", "turn", F.lower("role").alias("role"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    index = {r: i for i, r in enumerate(ROLES)}
    role, line = np.ones((3, 3)), np.ones((3, TEXT_KINDS))
    follow = known.select("conv_id", F.col("turn").alias("turn"), "role").join(known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next")), ["conv_id", "turn"])
    for a, b, n in follow.groupBy("role", "next").count().collect():
        role[index[a], index[b]] += n
    first = np.ones(3)
    for a, n in known.where("turn = 0").groupBy("role").count().collect():
        first[index[a]] += n
    more = np.full(3, 0.5)
    for a, lines, n in known.groupBy("role").agg(F.sum(F.size("lines")), F.count("*")).collect():
        more[index[a]] = (lines - n + 1) / (lines + 2)
    texts = known.select("role", F.explode("lines").alias("line")).groupBy("role", text_kind(F.col("line")).alias("kind")).count()
    for a, k, n in texts.collect():
        line[index[a], k] += n
    role, first, line = role / role.sum(1, keepdims=True), first / first.sum(), line / line.sum(1, keepdims=True)
    move = np.zeros((STATES, STATES))
    for a in range(3):
        for s in (2 * a, 2 * a + 1):
            move[s, 2 * a + 1] = more[a]
            move[s, ::2] = (1 - more[a]) * role[a]
    sign = np.full((STATES, 8), 0.1)
    lines = as_transcripts(known.select("conv_id", "turn", "role", F.array_join("lines", "\n").alias("text")))
    lines = lines.join(known.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    signs = lines.groupBy("role", (F.col("line") > 0).alias("on"), (marker_of(F.col("text")) * 2 + F.col("blank_before").cast("int")).alias("sign")).count()
    for a, on, m, n in signs.collect():
        sign[2 * index[a] + on, m] += n
    sign /= sign.sum(1, keepdims=True)
    start = np.zeros(STATES)
    start[::2] = first
    with np.errstate(divide="ignore"):
        return Model(np.log(start), np.log(move), np.log(sign), np.log(np.repeat(line, 2, axis=0)))


def _steps(model: Model, code: np.ndarray, starts: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each line the matrix from the state before it to its own; that of a conversation's first line (at starts, where opens) does not ask for the state before."""
    steps = model.move[None] + model.seen(code)[:, None, :]
    at = starts[opens]
    steps[at] = (model.first[None] + model.seen(code[at]))[:, None, :]
    return steps


def _ordered(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequences from the longest on, their first places, and how many have more than 0, 1, ... members."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    return order, starts, np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")


def products(steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The max-plus product of the matrices of each sequence, all sequences at once."""
    order, starts, many = _ordered(lengths)
    out = steps[starts].copy()
    for t, k in enumerate(many[1:].tolist(), 1):
        out[:k] = (out[:k, :, :, None] + steps[starts[:k] + t][:, None, :, :]).max(axis=2)
    back = np.empty_like(out)
    back[order] = out
    return back


def paths(steps: np.ndarray, lengths: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The states after each matrix on each sequence's best way from before to last (Viterbi), all sequences at once."""
    order, starts, many = _ordered(lengths)
    score = np.full((len(lengths), STATES), -np.inf)
    score[np.arange(len(lengths)), before[order]] = 0
    back = np.empty((len(steps), STATES), np.int8)
    for t, k in enumerate(many.tolist()):
        way = score[:k, :, None] + steps[starts[:k] + t]
        back[starts[:k] + t] = way.argmax(axis=1)
        score[:k] = way.max(axis=1)
    out, state = np.empty(len(steps), np.int32), last[order].astype(np.int64)
    for t in range(len(many) - 1, -1, -1):
        k = int(many[t])
        at = starts[:k] + t
        out[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return out


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some 2^16 members of a list column."""
    n = np.cumsum(batch.column(column).value_lengths().to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(n, (n[lo - 1] if lo else 0) + (1 << 16), side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _by_list(df: DataFrame, column: str, schema: str, make: Callable[[pa.RecordBatch, np.ndarray, pa.Array], list[pa.Array]]) -> DataFrame:
    """Rows made of slices of batches, given the lengths and the members of a list column."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, column):
                lists = part.column(part.schema.get_field_index(column))
                yield pa.record_batch(make(part, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()), names=names)

    return df.mapInArrow(run, schema)


def _matrices(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATES, STATES)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values.reshape(-1)))


def _shifted(states: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The state before each member: that of the one before, or of the sequence."""
    out = np.empty_like(states)
    out[1:] = states[:-1]
    out[np.cumsum(lengths) - lengths] = before
    return out


def observed(lines: DataFrame) -> DataFrame:
    """lines (conv_id, turn, line, text, blank_before) with their blocks and observation codes."""
    text = F.coalesce("text", F.lit(""))
    code = ((marker_of(text) * 2 + F.coalesce(F.col("blank_before").cast("int"), F.lit(0))) * TEXT_KINDS + text_kind(without_marker(text))).cast("int")
    turn, line = (F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in ("turn", "line"))
    return lines.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), line.alias("line"), text.alias("text"), code.alias("code")).withColumn("part", F.floor(F.col("line") / BLOCK)).withColumn("span", F.floor(F.col("turn") / SPAN))


def recover(lines: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn, line, text, state (0-5: role * 2 + whether the line goes on), number of the recovered turn."""
    rows = runtime.stored(observed(lines), "chat-lines")
    spark = lines.sparkSession
    held = spark.sparkContext.broadcast(model)
    place = F.struct("line", "text", "code")
    blocks = rows.groupBy("conv_id", "span", "turn", "part").agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["code"]).alias("codes"))
    head = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "part")).alias("head"))
    same = F.col("conv_id").eqNullSafe(F.col("own"))
    blocks = blocks.join(head.withColumnRenamed("conv_id", "own"), same).withColumn("opens", ((F.col("turn") == F.col("head.turn")) & (F.col("part") == F.col("head.part"))).cast("int")).drop("own", "head")

    def own_steps(part: pa.RecordBatch, n: np.ndarray, codes: pa.Array) -> np.ndarray:
        opens = part.column(part.schema.get_field_index("opens")).to_numpy(zero_copy_only=False) > 0
        return _steps(held.value, codes.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(n) - n, opens)

    def columns(part: pa.RecordBatch, *names: str) -> list[pa.Array]:
        return [part.column(part.schema.get_field_index(c)) for c in names]

    def states_of(part: pa.RecordBatch, *names: str) -> list[np.ndarray]:
        return [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns(part, *names)]

    def block_matrix(part: pa.RecordBatch, n: np.ndarray, codes: pa.Array) -> list[pa.Array]:
        m = products(own_steps(part, n, codes), n)
        return [*columns(part, "conv_id", "span", "turn", "part", "opens", "codes"), _lists(m, np.full(len(n), STATES**2))]

    key = "conv_id long, span long, turn long, part long, "
    blocks = runtime.stored(_by_list(blocks, "codes", key + "opens int, codes array<int>, matrix array<double>", block_matrix), "chat-blocks")
    spans = blocks.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list(F.struct("turn", "part", "matrix"))).alias("parts"))

    def span_matrix(part: pa.RecordBatch, n: np.ndarray, parts: pa.Array) -> list[pa.Array]:
        return [*columns(part, "conv_id", "span"), _lists(products(_matrices(parts.field("matrix")), n), np.full(len(n), STATES**2))]

    whole = _by_list(spans, "parts", "conv_id long, span long, matrix array<double>", span_matrix).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("span", "matrix"))).alias("parts"))

    def span_borders(part: pa.RecordBatch, n: np.ndarray, parts: pa.Array) -> list[pa.Array]:
        m = _matrices(parts.field("matrix"))
        before = np.zeros(len(n), np.int64)  # the first line does not ask for the state before
        states = paths(m, n, before, products(m, n)[:, 0].argmax(axis=1))
        conv = columns(part, "conv_id")[0].take(pa.array(np.repeat(np.arange(len(n)), n)))
        return [conv, parts.field("span"), pa.array(_shifted(states, n, before), pa.int32()), pa.array(states, pa.int32())]

    borders = _by_list(whole, "parts", "conv_id long, span long, before int, last int", span_borders).withColumnsRenamed({"conv_id": "own", "span": "own_span"})
    spans = spans.join(borders, same & (F.col("span") == F.col("own_span"))).drop("own", "own_span")

    def block_borders(part: pa.RecordBatch, n: np.ndarray, parts: pa.Array) -> list[pa.Array]:
        before, last = states_of(part, "before", "last")
        states = paths(_matrices(parts.field("matrix")), n, before, last)
        at = pa.array(np.repeat(np.arange(len(n)), n))
        return [*(c.take(at) for c in columns(part, "conv_id", "span")), parts.field("turn"), parts.field("part"), pa.array(_shifted(states, n, before), pa.int32()), pa.array(states, pa.int32())]

    borders = _by_list(spans, "parts", key + "before int, last int", block_borders).select(*(F.col(c).alias(f"own_{c}") for c in ("conv_id", "turn", "part")), "before", "last")
    found = blocks.join(borders, F.col("conv_id").eqNullSafe(F.col("own_conv_id")) & (F.col("turn") == F.col("own_turn")) & (F.col("part") == F.col("own_part")))

    def decode(part: pa.RecordBatch, n: np.ndarray, codes: pa.Array) -> list[pa.Array]:
        before, last = states_of(part, "before", "last")
        states = paths(own_steps(part, n, codes), n, before, last)
        return [*columns(part, "conv_id", "span", "turn", "part"), _lists(states, n), pa.array(np.add.reduceat((states % 2 == 0).astype(np.int32), np.cumsum(n) - n), pa.int32())]

    found = _by_list(found.drop("own_conv_id", "own_turn", "own_part"), "codes", key + "states array<int>, begins int", decode)
    earlier = Window.partitionBy("conv_id").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("earlier", F.coalesce(F.sum("begins").over(earlier), F.lit(0)))
    texts = rows.groupBy("conv_id", "turn", "part").agg(F.sort_array(F.collect_list(place)).alias("places")).withColumnsRenamed({"conv_id": "own", "turn": "own_turn", "part": "own_part"})
    found = found.join(texts, same & (F.col("turn") == F.col("own_turn")) & (F.col("part") == F.col("own_part")))
    count = F.size(F.filter(F.slice("states", 1, F.col("i") + 1), lambda s: s % 2 == 0))
    each = found.select("conv_id", "turn", "earlier", "states", F.posexplode("places").alias("i", "place"))
    return each.select("conv_id", "turn", F.col("place.line").alias("line"), F.col("place.text").alias("text"), F.col("states")[F.col("i")].alias("state"), (F.col("earlier") + count - 1).alias("number"))


def rendered(lines: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn (recovered, from 0), role, n_lines, rendered: a row for each recovered turn."""
    own = recover(lines, model)
    text = F.when(F.col("state") % 2 == 0, without_marker(F.col("text"))).otherwise(F.col("text"))
    turn = own.groupBy("conv_id", "number").agg(F.max(F.floor(F.col("state") / 2)).alias("role"), F.sort_array(F.collect_list(F.struct("turn", "line", text.alias("text")))).alias("lines"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("role") + 1).cast("int"))
    body = F.trim(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
    return turn.select("conv_id", F.col("number").cast("long").alias("turn"), role.alias("role"), F.size("lines").cast("long").alias("n_lines"), F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("<|end|>")).alias("rendered"))


def held_out(conv_id: Column) -> Column:
    """A fifth of the conversations, of which nothing is learned."""
    return F.coalesce(F.pmod(F.xxhash64("conv_id", F.lit(5)), F.lit(5)) == 0, F.lit(True))


def as_transcripts(turns: DataFrame) -> DataFrame:
    """Lines as a scraped transcript has them, from turns with roles: one of six marker styles for each conversation, a marker missing in about a fifth of the turns.

    A blank line is before most turns, but not before a tenth of them, and before a twentieth of the lines within turns.
    """
    style, miss = F.pmod(F.xxhash64("conv_id"), F.lit(6)), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    name = F.lower("role")
    short = F.when(name == "user", "Q").when(name == "assistant", "A").otherwise("System")
    human = F.when(name == "user", "Human").when(name == "assistant", "AI").otherwise("System")
    order = F.when(name == "user", "### Instruction: ").when(name == "assistant", "### Response: ").otherwise("### System: ")
    mark = F.when(miss, "").when(style == 0, F.concat(F.initcap(name), F.lit(": "))).when(style == 1, F.concat(human, F.lit(": "))).when(style == 2, F.concat(short, F.lit(": "))).when(style == 3, order).when(style == 4, F.concat(F.lit("<|"), name, F.lit("|> "))).otherwise(F.concat(F.lit("**"), F.initcap(name), F.lit(":** ")))
    text = F.concat(F.coalesce(mark, F.lit("")), F.coalesce("text", F.lit("")))
    lines = turns.select("conv_id", "turn", F.posexplode(F.split(text, "\n")).alias("line", "text"))
    chance = F.pmod(F.xxhash64("conv_id", "turn", "line", F.lit(1)), F.lit(20))
    return lines.withColumn("blank_before", F.when(F.col("line") == 0, chance >= 2).otherwise(chance == 0))


def accuracy(turns: DataFrame, model: Model) -> DataFrame:
    """held_out, n_lines, begins and roles right: how many lines of transcripts of turns get back whether they begin a turn, and their role."""
    lines = as_transcripts(turns)
    truth = lines.select(F.col("conv_id").alias("own"), F.col("turn").cast("long").alias("own_turn"), F.col("line").cast("long").alias("own_line")).join(turns.select(F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("t"), F.lower("role").alias("role")), (F.col("own") == F.col("c")) & (F.col("own_turn") == F.col("t")))
    got = recover(lines, model).join(truth, (F.col("conv_id") == F.col("own")) & (F.col("turn") == F.col("own_turn")) & (F.col("line") == F.col("own_line")))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.floor(F.col("state") / 2) + 1).cast("int"))
    return got.groupBy(held_out(F.col("conv_id")).alias("held_out")).agg(F.count("*").alias("n_lines"), F.avg(((F.col("state") % 2 == 0) == (F.col("line") == 0)).cast("int")).alias("begins"), F.avg((role == F.col("role")).cast("int")).alias("roles"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations written as transcripts, then recovered and rendered: a row for each turn."""
    turns = runtime.table(spark, sf_dir, "conversations")
    return rendered(as_transcripts(turns), fit(turns.where(~held_out(F.col("conv_id")))))
