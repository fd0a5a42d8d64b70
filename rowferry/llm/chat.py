"""Roles and turns of raw transcripts by a hidden Markov model over their lines.

A transcript is a text of many lines; who speaks, and where a turn begins, is not
known. Features of a line are the speaker marker at its start, if any, its
length, how it begins and whether it asks. The states are the roles, each as the
first or a later line of a turn; a later line follows lines of its own role only.
Chances of moves and features are counted over labelled lines. Viterbi recovers
the states, runs of them are the turns, and each is rendered in canonical form.

Lines are numbered over the whole table by their order, and dealt by number into
chunks, so no chunk grows with a conversation, with rows that have no number or
with equal rows. A conversation within one chunk is decoded there. The others are
summed up, chunk by chunk, by the best score from each state of the first line to
each state of the next chunk's first line; these tables are joined `FAN` at a
time, level by level, and the states at the borders are handed down again. The
result is as good as that of one long pass; of equal paths another may be taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.config import Sort
from rowferry.llm.columns import fold
from rowferry.llm.shared import Workspace
from rowferry.operators.row_index import row_index_sequence

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role * 2, and 1 more for a later line of a turn
# fixed values: what speakers are called in transcripts
MARKERS = {"system": "system|instructions", "user": "user|human|customer|q", "assistant": "assistant|ai|bot|agent|a"}
MARKED = r"^[ \t]*(?:#+[ \t]*)?\[?({})\]?[ \t]*:[ \t]*"
CHUNK = 1024
FAN = 512
LENGTHS = 16
BEGINNINGS = ("[A-Z]", "[a-z]", "[0-9*-]")
SHAPES = LENGTHS * (len(BEGINNINGS) + 1) * 2
CODES = (len(ROLES) + 1) * SHAPES
NEVER = -np.inf


def marker(line: Column) -> Column:
    """0 without a marker, else the number of its role plus 1."""
    out = F.lit(0)
    for number, role in enumerate(ROLES, 1):
        out = F.when(line.rlike("(?i)" + MARKED.format(MARKERS[role])), F.lit(number)).otherwise(out)
    return out


def code(line: Column) -> Column:
    """The features of a line as one number."""
    size = F.least(F.floor(F.log2(F.length(line) + 1)), F.lit(LENGTHS - 1)).cast("int")
    begins = F.lit(len(BEGINNINGS))
    for number, kind in enumerate(BEGINNINGS):
        begins = F.when(line.rlike(r"^[ \t]*" + kind), F.lit(number)).otherwise(begins)
    asks = line.rlike(r"\?[ \t]*$").cast("int")
    return ((marker(line) * LENGTHS + size) * (len(BEGINNINGS) + 1) + begins) * 2 + asks


def lines_of(said: DataFrame, order: tuple[str, ...] = (), keep: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """The lines of texts (conv, text), numbered: conv, place, chunk, number, text, code and the columns in `keep`.

    Texts of one conversation follow each other by the columns `order`, nulls
    first, and by a hash of the text; lines end at \\n or \\r\\n. A null text is
    one empty line, a null conversation one of its own, equal rows are several.
    """
    text = F.coalesce("text", F.lit(""))
    named = dict.fromkeys([*order, *keep])
    rows = said.select("conv", *named, F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_tie"), F.posexplode(F.split(text, "\r?\n")).alias("number", "text"))
    rows = rows.withColumn("code", code(F.col("text")))
    placed = row_index_sequence(rows, [Sort(c) for c in ("conv", *order, "_hash", "_tie", "number")], batch_size=chunk, index="place", sequence="chunk")
    return placed.select("conv", "place", "chunk", "number", "text", "code", *(c for c in keep))


def learn(lines: DataFrame) -> dict[str, list]:
    """Log chances of first states, moves and codes; columns conv, place, number, code, role.

    Marker and shape of a line count as independent given its state, so a marker
    weighs with every shape. Neighbours are found by a join on the place, so one long conversation is no
    hot key. The driver gets counts by state and code, however many the rows.
    """
    number = F.lit(None).cast("int")
    for k, role in enumerate(ROLES):
        number = F.when(F.col("role") == role, F.lit(2 * k)).otherwise(number)
    rows = lines.select(F.struct("conv").alias("k"), "place", "code", (number + (F.col("number") > 0).cast("int")).alias("state")).filter("state IS NOT NULL")
    before = rows.select(F.col("k").alias("k0"), (F.col("place") + 1).alias("place"), F.col("state").alias("before"))
    moves = rows.join(before, "place", "left").groupBy(F.when(F.col("k") == F.col("k0"), F.col("before")).alias("before"), "state").count().collect()
    first, move = np.ones(STATES), np.ones((STATES, STATES))
    marks, shapes = np.full((STATES, CODES // SHAPES), 0.1), np.full((STATES, SHAPES), 0.1)
    for r in moves:
        if r["before"] is None:
            first[r["state"]] += r["count"]
        else:
            move[r["before"], r["state"]] += r["count"]
    for r in rows.groupBy("state", "code").count().collect():
        marks[r["state"], r["code"] // SHAPES] += r["count"]
        shapes[r["state"], r["code"] % SHAPES] += r["count"]
    emit = (marks / marks.sum(1, keepdims=True))[:, :, None] * (shapes / shapes.sum(1, keepdims=True))[:, None, :]
    state = np.arange(STATES)
    # a later line needs an earlier one of its role
    first[state % 2 == 1] = 0
    move[(state % 2 == 1)[None, :] & (state[:, None] // 2 != state[None, :] // 2)] = 0
    with np.errstate(divide="ignore"):
        shares = (np.log(x / x.sum(-1, keepdims=True)).tolist() for x in (first, move, emit.reshape(STATES, CODES)))
        return dict(zip(("first", "move", "emit"), shares))


def transfer(codes: list[int], move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Best score from each state before the codes to each state at the last one."""
    table = np.where(np.eye(len(move)) > 0, 0.0, NEVER)
    for c in codes:
        table = (table[:, :, None] + move).max(1) + emit[:, c]
    return table


def decode(codes: list[int], start: np.ndarray, move: np.ndarray, emit: np.ndarray, end: int = -1) -> list[int]:
    """Viterbi path; `start` scores the first state with its code, `end` fixes the last one if not negative.

    Of equal paths the one of lower state numbers from the back is taken.
    """
    best, back = start, []
    for c in codes[1:]:
        step = best[:, None] + move
        back.append(step.argmax(0))
        best = step.max(0) + emit[:, c]
    path = [end if end >= 0 else int(best.argmax())]
    for link in reversed(back):
        path.append(int(link[path[-1]]))
    return path[::-1]


def at(state: int) -> np.ndarray:
    """Scores that allow one state only."""
    return np.where(np.arange(STATES) == state, 0.0, NEVER)


def _borders(codes: DataFrame, shared, space: Workspace, levels: int) -> DataFrame:
    """(place, first, ahead, base) of each chunk of a conversation that lies in several.

    place is the chunk's first line and base that of its conversation; first and
    ahead are the states of the chunk's first line and of the next chunk's, the
    latter -1 in a last chunk. `codes`: conv, node, codes, own.
    """
    kind = codes.schema["conv"].dataType.simpleString()
    size = STATES * STATES

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, move, emit = (np.array(shared.value[k]) for k in ("first", "move", "emit"))
        for batch in batches:
            opening, tables = [], []
            for said in batch.column(3).to_pylist():
                opening.append((first + emit[:, said[0]]).tolist())
                tables.append(transfer(said[1:], move, emit).ravel().tolist())
            kinds = pa.list_(pa.float64())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(opening, kinds), pa.array(tables, kinds)], ["conv", "node", "place", "opening", "best"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, opening, tables = [], [], []
            for parts in batch.column(2).to_pylist():
                table = np.array(parts[0]["best"]).reshape(STATES, STATES)
                for part in parts[1:]:
                    table = (table[:, :, None] + np.array(part["best"]).reshape(STATES, STATES)).max(1)
                places.append(parts[0]["place"])
                opening.append(parts[0]["opening"])
                tables.append(table.ravel().tolist())
            kinds = pa.list_(pa.float64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(places, pa.int64()), pa.array(opening, kinds), pa.array(tables, kinds)], ["conv", "node", "place", "opening", "best"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [int((np.array(o) + np.array(t).reshape(STATES, STATES).max(1)).argmax()) for o, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            ahead = pa.array([-1] * batch.num_rows, pa.int32())
            yield pa.record_batch([batch.column(0), pa.array(first, pa.int32()), ahead, batch.column(0)], ["place", "first", "ahead", "base"])

    def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts, first, ahead, base in zip(*(batch.column(c).to_pylist() for c in range(4))):
                best, back = at(first), []
                for part in parts:
                    step = best[:, None] + np.array(part["best"]).reshape(STATES, STATES)
                    back.append(step.argmax(0))
                    best = step.max(0)
                path = [ahead if ahead >= 0 else int(best.argmax())]
                for link in reversed(back):
                    path.append(int(link[path[-1]]))
                path.reverse()
                path[-1] = ahead
                rows += [(part["place"], path[k], path[k + 1], base) for k, part in enumerate(parts)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["place", "first", "ahead", "base"])

    shape = f"conv {kind}, node long, place long, opening array<double>, best array<double>"
    states = "place long, first int, ahead int, base long"
    nodes, lists = codes.select("conv", "node", "place", "codes").mapInArrow(sum_up, shape), []
    for _ in range(levels):
        # at most FAN tables of a fixed size
        grouped = nodes.groupBy("conv", F.floor(F.col("node") / FAN).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "place", "opening", "best"))).alias("parts"))
        lists.append(space.keep(grouped, "tables"))
        nodes = lists[-1].mapInArrow(merge, shape)
    found = nodes.select("place", "opening", "best").mapInArrow(choose, states)
    for level in reversed(lists):
        inner = level.select(F.element_at("parts", 1)["place"].alias("place"), "parts")
        found = inner.join(found, "place").select("parts", "first", "ahead", "base").mapInArrow(hand_down, states)
    return found


def format_turns(lines: DataFrame, model: dict[str, list], chunk: int = CHUNK) -> DataFrame:
    """Turns of transcripts: conv, line, n_lines, opens, role, rendered; `lines` as by `lines_of`.

    line is a turn's first line within its conversation, from 0. A turn that
    goes over the border of a chunk comes in several rows, of which only the
    first opens it; their `rendered`, by line, make up the turn. Markers are
    taken off where a turn opens; all other text stays.
    """
    spark = lines.sparkSession
    space = Workspace(spark)
    kind = lines.schema["conv"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    strip = re.compile(MARKED.format("|".join(MARKERS.values())), re.IGNORECASE)
    last = lines.agg(F.max("chunk")).first()[0] or 0
    levels = 1
    while FAN**levels <= last:
        levels += 1
    # the first line of a chunk also closes the one before
    dealt = lines.withColumn("node", F.explode(F.when((F.col("place") % chunk == 0) & (F.col("place") > 0), F.array("chunk", F.col("chunk") - 1)).otherwise(F.array("chunk"))))

    def grouped(*columns: Column) -> DataFrame:
        rows = dealt.groupBy("conv", "node").agg(F.sort_array(F.collect_list(F.struct("place", *columns))).alias("said"))
        place = F.element_at("said", 1)["place"]
        end = F.element_at("said", -1)["place"]
        return rows.filter(F.floor(place / chunk) == F.col("node")).select("conv", "node", place.alias("place"), (F.floor(end / chunk) > F.col("node")).alias("goes_on"), "said")

    codes = grouped(F.col("code")).filter((F.col("place") % chunk == 0) | F.col("goes_on")).select("conv", "node", "place", F.col("said.code").alias("codes"))
    borders = _borders(codes, shared, space, levels)

    def speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, move, emit = (np.array(shared.value[k]) for k in ("first", "move", "emit"))
        for batch in batches:
            for row in range(batch.num_rows):
                said, opening, ahead, base = (batch.column(c)[row].as_py() for c in (1, 3, 4, 5))
                start, goes_on = said[0]["place"], batch.column(2)[row].as_py()
                path = decode([u["code"] for u in said], first + emit[:, said[0]["code"]] if opening is None else at(opening), move, emit, -1 if ahead is None else ahead)
                base = start if base is None else base
                own = len(said) - goes_on
                cuts = [0, *(k for k in range(1, own) if path[k] % 2 == 0), own]
                out = []
                for a, b in zip(cuts, cuts[1:]):
                    opens = path[a] % 2 == 0
                    body = [u["text"] for u in said[a:b]]
                    if opens:
                        body[0] = strip.sub("", body[0], count=1)
                    role = ROLES[path[a] // 2]
                    closes = b < own or not goes_on or path[own] % 2 == 0
                    out.append((start + a - base, b - a, opens, role, (f"<|{role}|>\n" if opens else "") + "\n".join(body) + ("\n<|end|>\n" if closes else "\n")))
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string())
                conv = pa.array([batch.column(0)[row].as_py()] * len(out), batch.column(0).type)
                yield pa.record_batch([conv, *(pa.array([r[c] for r in out], k) for c, k in enumerate(kinds))], ["conv", "line", "n_lines", "opens", "role", "rendered"])

    texts = grouped(F.col("text"), F.col("code")).join(borders, "place", "left").select("conv", "said", F.col("goes_on").cast("int"), "first", "ahead", "base")
    return texts.mapInArrow(speak, f"conv {kind}, line long, n_lines long, opens boolean, role string, rendered string")


def format_transcripts(transcripts: DataFrame, model: dict[str, list], key: str = "conv_id", text: str = "text") -> DataFrame:
    """The turns of raw transcripts, one text each; see `format_turns`."""
    return format_turns(lines_of(transcripts.select(transcripts[key].alias("conv"), transcripts[text].alias("text"))), model)


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as parts of transcripts: roles become markers in one of three styles, and a quarter has none."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    names = {"system": ("System: ", "[Instructions]: ", "### System: "), "user": ("User: ", "[Human]: ", "### Q: "), "assistant": ("Assistant: ", "[AI]: ", "### A: ")}
    name = F.lit(None).cast("string")
    for role, spellings in names.items():
        name = F.when(F.col("role") == role, F.element_at(F.array(*map(F.lit, spellings)), (style + 1).cast("int"))).otherwise(name)
    silent = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0
    text = F.coalesce("text", F.lit(""))
    return conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", F.when(silent | name.isNull(), text).otherwise(F.concat(name, text)).alias("text"))


def predict(conversations: DataFrame, folds: int = 5) -> DataFrame:
    """Recovered turns of all conversations: conv_id, line, n_lines, opens, held_out, role, rendered.

    Transcripts are made from the conversations. Roles and the borders of
    utterances are learned outside fold 0 and are no input of the decoding, which
    sees lines alone. A null key is a conversation of its own, outside fold 0; a
    null turn comes first, equal turns go by a hash of their text; a null text
    is one empty line; unknown roles are not learned from. Columns besides these
    four are not read, and no rows give none.
    """
    lines = lines_of(raw_transcripts(conversations), ("turn",), ("role",))
    model = learn(lines.filter(fold(F.col("conv"), folds) != 0))
    found = format_turns(lines.drop("role", "number"), model)
    return found.select(F.col("conv").alias("conv_id"), "line", "n_lines", "opens", (fold(F.col("conv"), folds) == 0).alias("held_out"), "role", "rendered")
