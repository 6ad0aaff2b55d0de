"""Conversation structure repair: the cheapest edits that make the turns of each conversation alternate.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Its rows are the layers of a dynamic programme over four
states: nothing yet, after the system's, a user's or an assistant's turn. One macro edit takes the programme over a row: a run of
inserted turns and then Keep, Rerole or Delete of the row, written as the code ``I..I`` and K, R or D. No code is a prefix of
another and each takes one row, so audits of the same rows compare as the pairs (audit up to the row before, code) do, and a
state needs only its cost, the rank of its audit among the four of its layer and a pointer to its parent: no strings. Costs
relative to the least one are small and ranks are below four, so layers repeat and a step from layer to layer is looked up.
The audit of a conversation is read back along the pointers.

Two audits that end in different states differ, so of two ways into a state over different states of an earlier layer the earlier
rank decides. A slice of rows is therefore summed up by the costs and ranks from each of its four entry states; long
conversations are cut into slices, which run apart, and slices are joined in a second programme over their sums.

Ties and nulls: rows of one conversation are ordered by turn (nulls first), then role, then text; rows equal in all of these
are copies. A null role or text counts as one space. Rows with a null conversation are one conversation. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm.common import spread_join, stored

#: The characters that count as blank, and those that end a finished text.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: What the edits cost; a row that stays although it is cut off costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A conversation of more rows is cut into slices of SLICE rows. Fewer than BROADCAST long ones are told by a broadcast list.
LONG, SLICE, BROADCAST = 20_000, 4_096, 1_000_000
ROLES = {"u": "user", "a": "assistant"}
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: State after a turn of that role, for the states in which it may come.
NEXT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
#: Turns inserted at the end to reach a state in which a conversation may end.
TAIL = {START: "", AFTER_S: "ua", AFTER_U: "a", AFTER_A: ""}
NEVER = 1 << 60

#: (least costs of the four states, ranks of their audits; -1 where a state can't be reached)
Layer = tuple[tuple[int, ...], tuple[int, ...]]


def runs(state: int) -> Iterator[tuple[str, int]]:
    """(inserted roles, state behind them): none, one or two turns; a third only leads where the first one does."""
    roles = ""
    for _ in range(3):
        yield roles, state
        role = next(r for r in "ua" if state in NEXT[r])
        roles, state = roles + role, NEXT[role][state]


def macros(initial: str, fault: str) -> list[tuple[int, str, str, int, int]]:
    """The macro edits of a row: (from, code, inserted roles, to, cost), of those between the same states the cheapest with the least code."""
    best: dict[tuple[int, int], tuple[int, str, str]] = {}
    for start in range(4):
        for roles, state in runs(start):
            paid = INSERT * len(roles)
            ways = [("D", state, DELETE)]
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault == "truncated" else 0
                ways += [("K", NEXT[initial][state], more)] if state in NEXT.get(initial, {}) else []
                ways += [("R", NEXT[r][state], REROLE + more) for r in "ua" if state in NEXT[r]]
            for letter, to, cost in ways:
                way = (paid + cost, "I" * len(roles) + letter, roles)
                best[start, to] = min(best.get((start, to), way), way)
    return [(start, code, roles, to, cost) for (start, to), (cost, code, roles) in best.items()]


class Programme:
    """Steps from layer to layer, each worked out once."""

    def __init__(self) -> None:
        self.moves: dict[tuple[str, str], list] = {}
        self.known: dict = {}

    def step(self, layer: Layer, initial: str, fault: str) -> tuple[Layer, int, tuple]:
        """(next layer with costs above its least one, that least cost, for each state its (parent, code, inserted roles))."""
        kind = (initial if initial in NEXT else "", fault)
        found = self.known.get((layer, kind))
        if found is None:
            found = self.known[layer, kind] = self._work_out(layer, kind)
        return found

    def _work_out(self, layer: Layer, kind: tuple[str, str]) -> tuple[Layer, int, tuple]:
        costs, ranks = layer
        if kind not in self.moves:
            self.moves[kind] = macros(*kind)
        best: list = [None] * 4
        for start, code, roles, to, cost in self.moves[kind]:
            if ranks[start] >= 0:
                way = (costs[start] + cost, ranks[start], code, start, roles)
                if best[to] is None or way < best[to]:
                    best[to] = way
        least = min(way[0] for way in best if way)
        order = sorted((way[1], way[2], to) for to, way in enumerate(best) if way)
        rank = [-1] * 4
        for n, (_, _, to) in enumerate(order):
            rank[to] = n
        after = tuple(way[0] - least if way else NEVER for way in best), tuple(rank)
        return after, least, tuple((way[3], way[2], way[4]) if way else None for way in best)


def only(state: int) -> Layer:
    """The layer in which only that state can be reached, at no cost."""
    return tuple(0 if s == state else NEVER for s in range(4)), tuple(0 if s == state else -1 for s in range(4))


def last_state(costs: tuple[int, ...], ranks: tuple[int, ...]) -> int:
    """The state in which the cheapest audit ends, the least of those that cost the same."""
    return min((costs[s] + INSERT * len(TAIL[s]), ranks[s], s) for s in range(4) if ranks[s] >= 0)[2]


def walk(programme: Programme, rows: list[tuple[str, str]], entry: int, leave: int | None) -> tuple[list[tuple[str, str]], int]:
    """((code, inserted roles) of each (initial, fault) from the entry state, state they end in): ``leave``, or the cheapest end."""
    layer, pointers = only(entry), []
    for initial, fault in rows:
        layer, _, parents = programme.step(layer, initial, fault)
        pointers.append(parents)
    state = end = last_state(*layer) if leave is None else leave
    found = []
    for parents in reversed(pointers):
        state, code, roles = parents[state]
        found.append((code, roles))
    return found[::-1], end


def fault_of(text: str, seen_before: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated or none."""
    body = text.rstrip(BLANKS)
    if not body:
        return "blank"
    return "duplicate" if seen_before else "" if body[-1] in ENDS else "truncated"


#: Columns of an edit row besides conv_id: its order in the conversation, the row's turn, role before and fault, the roles inserted
#: before it, the edit, role and text after it and how many equal rows follow, all deleted. The last row of a conversation has
#: the edit "" and may insert too. A row that was only there to name its conversation has the edit null.
EDITS = "at long, turn long, was string, fault string, inserted string, edit string, role string, text string, copies long"


def _schema(turns: DataFrame, conv: str, columns: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", turns.schema[conv].dataType), *T.StructType.fromDDL(columns)])


def _row(conv, at: int, turn, role: str, text: str, fault: str, code: str, roles: str, after: int, copies: int = 0) -> tuple:
    edit = code[-1]
    new = ROLES["u" if after == AFTER_U else "a"] if edit == "R" else role
    return conv, at, turn, role, fault, roles, edit, new, text, copies


def _end(conv, at: int, state: int) -> tuple:
    return conv, at, None, None, None, TAIL[state], "", None, None, 0


class _Out:
    """Rows on their way to batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 2000, size: int = 8 << 20):
        self.schema, self.most, self.size, self.rows, self.letters = schema, rows, size, [], 0

    def add(self, row: tuple, letters: int = 0) -> bool:
        """Whether a batch is due."""
        self.rows.append(row)
        self.letters += letters
        return len(self.rows) >= self.most or self.letters >= self.size

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.letters = self.rows, [], 0
        columns = list(zip(*rows)) if rows else [()] * len(self.schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            yield from zip(*[c.to_pylist() for c in batch.slice(k, 500).columns])


def _after(entry: int, rows: list, codes: list[tuple[str, str]]) -> Iterator[int]:
    """The state behind each row."""
    state = entry
    for (initial, _), (code, roles) in zip(rows, codes):
        for r in roles:
            state = NEXT[r][state]
        if code[-1] == "K":
            state = NEXT[initial][state]
        elif code[-1] == "R":
            state = NEXT[next(r for r in "ua" if state in NEXT[r])][state]
        yield state


def _whole(turns: DataFrame, schema: T.StructType) -> DataFrame:
    """Edit rows of conversations of at most LONG rows: each is one group of one task's sorted rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programme, out, group, name = Programme(), _Out(arrow), [], None

        def repaired() -> Iterator[bool]:
            rows, seen = [], set()
            kept = [(turn, role, text) for turn, role, text, present in group if present]
            for _, role, text in kept:
                rows.append((role[:1], fault_of(text, (role, text) in seen)))
                seen.add((role, text))
            codes, end = walk(programme, rows, START, None)
            if not kept:
                yield out.add((name, -1, *[None] * 7, 0))
            for at, ((turn, role, text), (_, fault), (code, roles), after) in enumerate(zip(kept, rows, codes, _after(START, rows, codes))):
                yield out.add(_row(name, at, turn, role, text, fault, code, roles, after), len(text))
            yield out.add(_end(name, len(kept), end))

        for conv, *row in _records(batches):
            if group and conv != name:
                for due in repaired():
                    if due:
                        yield out.batch()
                group = []
            name = conv
            group.append(row)
        if group:
            for due in repaired():
                if due:
                    yield out.batch()
        yield out.batch()

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(run, schema)


def _sliced(turns: DataFrame, names: DataFrame, schema: T.StructType) -> DataFrame:
    """Edit rows of long conversations, in slices: no task holds a conversation.

    Equal rows of one turn collapse to one with a count. The first turn of a text is found by a partial aggregation and joined
    back with hot texts spread. Rows are put in order by ranges, so a conversation goes to as many tasks as it fills.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    spark = turns.sparkSession
    once = turns.where("present").groupBy("conv_id", "turn", "role", "text").agg((F.count(F.lit(1)) - 1).alias("copies"))
    said = F.sha2(F.to_json(F.struct(F.col("conv_id").cast("string").alias("c"), "role", "text"), {"ignoreNullFields": "false"}), 256)
    order = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    once = stored(once.withColumn("said", said).withColumn("order", order), "turns")
    first = stored(once.groupBy("said").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("met")), "first")
    told = spread_join(once, first, "said", "met", once.count(), F.xxhash64("turn"), "inner").select("conv_id", "turn", "role", "text", "copies", (F.col("order") > F.col("first")).alias("again"))
    keys = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    ranged = told.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    rows = stored(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("slice", F.expr(f"at div {SLICE}")), "ordered")
    body = F.rtrim(F.translate("text", BLANKS[1:], " " * (len(BLANKS) - 1)))
    fault = F.when(body == "", "blank").when(F.col("again"), "duplicate").when(F.right(body, F.lit(1)).isin(*ENDS), "").otherwise("truncated")
    rows = rows.withColumn("fault", fault)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programme, now, layers, paid = Programme(), None, [], []

        def summed() -> pa.RecordBatch:
            (part, conv), costs = now, [[min(c + paid[e], NEVER) for c in layers[e][0]] for e in range(4)]
            ranks = [list(layers[e][1]) for e in range(4)]
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], arrow.field("conv_id").type), pa.array([part], pa.int64()), pa.array([sum(costs, [])], pa.list_(pa.int64())), pa.array([sum(ranks, [])], pa.list_(pa.int64()))],
                ["conv_id", "slice", "costs", "ranks"],
            )

        for part, conv, initial, why in _records(batches):
            if now != (part, conv):
                if now is not None:
                    yield summed()
                now, layers, paid = (part, conv), [only(e) for e in range(4)], [0] * 4
            for e in range(4):
                layers[e], least, _ = programme.step(layers[e], initial, why)
                paid[e] += least
        if now is not None:
            yield summed()

    sums_schema = T.StructType([schema["conv_id"], *T.StructType.fromDDL("slice long, costs array<long>, ranks array<long>")])
    light = rows.select("slice", "conv_id", F.left("role", F.lit(1)).alias("initial"), "fault", "at")
    sums = light.repartition("slice").sortWithinPartitions("slice", "conv_id", "at").drop("at").mapInArrow(sum_up, sums_schema)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One programme over the slices of each conversation; a slice's way in and out of it is read back from the end."""

        def placed(conv, parts: list) -> pa.RecordBatch:
            costs, ranks = only(START)
            pointers = []
            for _, slice_costs, slice_ranks in parts:
                ways: list = [None] * 4
                for e in range(4):
                    for to in range(4):
                        if ranks[e] >= 0 and slice_ranks[4 * e + to] >= 0:
                            way = (costs[e] + slice_costs[4 * e + to], ranks[e], slice_ranks[4 * e + to], e)
                            ways[to] = way if ways[to] is None else min(ways[to], way)
                order = sorted((way[1], way[2], to) for to, way in enumerate(ways) if way)
                place = {to: n for n, (_, _, to) in enumerate(order)}
                costs = tuple(way[0] if way else NEVER for way in ways)
                ranks = tuple(place.get(to, -1) for to in range(4))
                pointers.append([way[3] if way else None for way in ways])
            leave, found = last_state(costs, ranks), []
            for k in range(len(parts) - 1, -1, -1):
                entry = pointers[k][leave]
                found.append((conv, parts[k][0], entry, leave, k == len(parts) - 1))
                leave = entry
            columns = list(zip(*found))
            types = [arrow.field("conv_id").type, pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "slice", "entry", "leave", "last"])

        name, parts = None, []
        for conv, part, slice_costs, slice_ranks in _records(batches):
            if parts and conv != name:
                yield placed(name, parts)
                parts = []
            name = conv
            parts.append((part, slice_costs, slice_ranks))
        if parts:
            yield placed(name, parts)

    ways_schema = T.StructType([schema["conv_id"], *T.StructType.fromDDL("slice long, entry int, leave int, last boolean")])
    ways = stored(sums.repartition("conv_id").sortWithinPartitions("conv_id", "slice").mapInArrow(join_up, ways_schema), "ways")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programme, out, group, now = Programme(), _Out(arrow), [], None

        def repaired() -> Iterator[bool]:
            _, conv, entry, leave, last = now
            rows = [(role[:1], why) for _, _, role, _, why, _ in group]
            codes, _ = walk(programme, rows, entry, leave)
            for (at, turn, role, text, why, copies), (code, roles), after in zip(group, codes, _after(entry, rows, codes)):
                yield out.add(_row(conv, at, turn, role, text, why, code, roles, after, copies), len(text))
            if last:
                yield out.add(_end(conv, group[-1][0] + 1, leave))

        for *key, at, turn, role, text, why, copies in _records(batches):
            if group and key != now:
                for due in repaired():
                    if due:
                        yield out.batch()
                group = []
            now = key
            group.append((at, turn, role, text, why, copies))
        if group:
            for due in repaired():
                if due:
                    yield out.batch()
        yield out.batch()

    met = rows.alias("r").join(ways.alias("w"), F.expr("r.slice = w.slice AND r.conv_id <=> w.conv_id"))
    met = met.select("r.slice", "r.conv_id", "entry", "leave", "last", "at", "turn", "role", "text", "fault", "copies")
    edits = met.repartition("slice").sortWithinPartitions("slice", "conv_id", "at").mapInArrow(write, schema)
    named = names.select("conv_id", F.lit(-1).cast("long").alias("at"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[2:-1]], F.lit(0).cast("long").alias("copies"))
    return edits.unionByName(named)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(edit rows of conversations of at most LONG rows, those of longer ones or None if there are none), with columns conv_id and EDITS.

    Rows of the first one lie in order of conv_id and ``at`` within a partition, all of a conversation in one; rows of the other
    anywhere. Rows without ``present`` take no part but name their conversation. Other columns of ``turns`` aren't read.
    """
    schema = _schema(turns, conv, EDITS)
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), (F.lit(True) if present is None else present).alias("present"),
    )
    long = stored(rows.groupBy("conv_id").count().where(F.col("count") > LONG).select("conv_id"), "long")
    count = long.count()
    if not count:
        return _whole(rows, schema), None
    names = (F.broadcast(long) if count < BROADCAST else long).alias("l")
    told = F.expr("r.conv_id <=> l.conv_id")
    short = rows.alias("r").join(names, told, "left_anti")
    return _whole(short, schema), _sliced(rows.alias("r").join(names, told, "left_semi"), long, schema)


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summary(edits: DataFrame) -> DataFrame:
    """One row for each conversation of edit rows that lie in order within partitions: its faults, cost, audit and digest.

    SHA-256 takes a conversation's texts one after the other, so they pass one task as a stream; it holds one row at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        name, started = None, False

        def fresh() -> dict:
            return {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "last": None, "hash": hashlib.sha256(), "lines": 0}

        def close() -> None:
            gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
            done.append((name, gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], "".join(now["audit"]), now["hash"].hexdigest()))

        def line(role: str, text: str) -> None:
            now["hash"].update(("\n" if now["lines"] else "").encode() + f"{role}:{text}".encode())
            now["lines"] += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * (1 + len(fields))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *types])], ["conv_id", *fields])

        now = fresh()
        for conv, _, turn, was, fault, inserted, edit, role, text, copies in _records(batches):
            if started and conv != name:
                close()
                now = fresh()
                if len(done) >= 1000:
                    yield out()
            name, started = conv, True
            if edit is None:
                continue
            for r in inserted:
                now["audit"].append("I")
                now["cost"] += INSERT
                line(ROLES[r], "")
            if not edit:
                continue
            now["audit"].append(edit + "D" * copies)
            now["cost"] += {"K": 0, "R": REROLE, "D": DELETE}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0) + DELETE * copies
            if edit != "D":
                line(role, text)
            if fault:
                now[fault] += 1
            now["blank" if fault == "blank" else "duplicate"] += copies
            if now["last"] is not None:
                now["illegal"] += now["last"] + was[:1] not in ("su", "ua", "au")
            now["illegal"] += copies
            now["last"] = was[:1]
            if turn is not None:
                now["turns"] += turn != now["high"]
                now["high"] = turn
                now["low"] = turn if now["low"] is None else now["low"]
        if started:
            close()
        yield out()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(edits.schema["conv_id"].dataType)
    fields = [f.name for f in T.StructType.fromDDL(SUMMARY)]
    types = [pa.int64()] * 6 + [pa.string()] * 2
    return edits.mapInArrow(run, T.StructType([edits.schema["conv_id"], *T.StructType.fromDDL(SUMMARY)]))


def damage(turns: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn``: dropped (present is false), emptied, without their ends, repeated, or a user's."""
    nulls = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(nulls("conv_id"), F.lit(":"), nulls("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", nulls("role").alias("role"), nulls("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "time")


def query(spark, sf_dir: str) -> DataFrame:
    """Damage, repair and summary of all conversations, those without a row after damage included."""
    damaged = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    short, long = repair(damaged, present=F.col("present"))
    found = summary(short)
    return found if long is None else found.unionByName(summary(long.repartition("conv_id").sortWithinPartitions("conv_id", "at")))
