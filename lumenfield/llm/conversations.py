"""Faults of conversations and their cheapest repair.

A repaired conversation reads ``(s?(ua)+)?`` in the first letters of its roles. Rows may be kept, given another role,
or deleted, and empty turns inserted. Blank and repeated rows must go; cut-off rows that stay cost extra.

The edits are a shortest path. Nodes are (rows read, state of the pattern), edges one edit each, so the graph has no
cycle once the inserts of a layer are taken in the order user, assistant: a third insert in a row leads back to a
state at a higher cost. A path's weight is one integer: high digits carry its cost, and behind them ``WIDTH`` digits of
three bits hold the letters of its edits from the left, zero where there is none yet. Adding an edge adds its cost
and its letter at the path's next place, and the smaller integer wins. Two paths of one cost in one node never are
each other's beginning, since the longer one would hold paid inserts more; so the zeros behind a path never
decide, and the smaller integer is the cheaper path or the one with the ASCII-least letters.

Rows are dealt by conversation and sorted by turn, and one pass follows four paths a conversation. It holds their
weights, the digests of the turns they keep and no text: a path that cannot win any more is dropped, and letters that
all paths share leave the weights. So memory does not grow with a conversation, but for the letters that are its
result. The digest of a conversation is sequential, so each conversation is read by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: costs of the edits
RENAME, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
BLANK = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LETTERS = " DIKR"
WIDTH = 64
NONE, IS_BLANK, IS_REPEAT, IS_CUT = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
#: the state that a turn of this initial leads to
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
TURN_OF = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text, copy, dropped), damaged by the crc32 of ``conversation:turn`` modulo 20.

    0 drops a row (it stays with ``dropped`` set, so that its conversation is not forgotten), 1 empties its text, 2
    removes ``.!?``, 3 repeats it, 4 makes its role ``user``. Nulls count as one space, except that a null conversation and
    a null turn stay null.
    """
    c, t, r, x = (df[f"`{n}`"] for n in (conversation, turn, role, text))
    space = lambda v: F.coalesce(v.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(c), F.lit(":"), space(t)).cast("binary")) % 20
    rows = df.select(c.alias("conv_id"), t.cast("long").alias("turn"), space(r).alias("role"), space(x).alias("text"), kind.alias("kind"))
    kind = F.col("kind")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
        (kind == 0).alias("dropped"),
    )


def whole(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as :func:`damage` names them, undamaged."""
    space = lambda n: F.coalesce(df[f"`{n}`"].cast("string"), F.lit(" "))
    return df.select(
        df[f"`{conversation}`"].alias("conv_id"),
        df[f"`{turn}`"].cast("long").alias("turn"),
        space(role).alias("role"),
        space(text).alias("text"),
        F.lit(1).alias("copy"),
        F.lit(False).alias("dropped"),
    )


ORDER = ["conv_id", "dropped", "turn", "role", "text", "copy"]


def _blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANK))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``, dealt by conversation: 1 blank, 2 role and text seen earlier, 3 cut off, 0 none."""
    dealt = rows.repartition("conv_id")
    # the window only needs the rows of a conversation together: no second shuffle
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn", "copy"))
    body = _blank(F.col("text"))
    fault = F.when(body == "", IS_BLANK).when(seen > 1, IS_REPEAT).when(~F.substring(body, -1, 1).isin(*ENDS), IS_CUT).otherwise(NONE)
    return dealt.withColumn("fault", fault)


class Path:
    """A path to one node: weight, letters in the weight, turns kept, and the digest of those turns."""

    __slots__ = ("weight", "used", "turns", "digest")

    def __init__(self, weight: int, used: int, turns: int, digest):
        self.weight, self.used, self.turns, self.digest = weight, used, turns, digest

    def keeps(self, role: str, text: str):
        digest = self.digest.copy()
        digest.update((("\n" if self.turns else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        return digest


class Repair:
    """The cheapest edits of one conversation whose rows come in order."""

    def __init__(self) -> None:
        self.width = WIDTH
        self.paths: dict[int, Path] = {START: Path(0, 0, 0, hashlib.sha256())}
        self.done: list[str] = []

    def _edge(self, path: Path, cost: int, letter: str) -> int:
        return path.weight + (cost << 3 * self.width) + (LETTERS.index(letter) << 3 * (self.width - 1 - path.used))

    def _insert(self) -> None:
        """Empty turns before the next row: a user, then an assistant."""
        for to, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            weight, source = min(((self._edge(self.paths[q], INSERT, "I"), q) for q in sources if q in self.paths), default=(None, None))
            if source is not None and (to not in self.paths or weight < self.paths[to].weight):
                path = self.paths[source]
                self.paths[to] = Path(weight, path.used + 1, path.turns + 1, path.keeps(ROLES[to], ""))

    def add(self, role: str, text: str, fault: int) -> None:
        if max(p.used for p in self.paths.values()) + 4 > self.width:
            self._flush()
        self._insert()
        found: dict[int, tuple[int, int, str, str | None]] = {}

        def offer(to: int, source: int, cost: int, letter: str, name: str | None) -> None:
            weight = self._edge(self.paths[source], cost, letter)
            if to not in found or weight < found[to][0]:
                found[to] = (weight, source, letter, name)

        late = CUT_OFF if fault == IS_CUT else 0
        for q in self.paths:
            offer(q, q, DELETE, "D", None)
            if fault in (NONE, IS_CUT):
                if (q, role[:1]) in NEXT:
                    offer(NEXT[q, role[:1]], q, late, "K", role)
                offer(TURN_OF[q], q, RENAME + late, "R", ROLES[TURN_OF[q]])
        new = {}
        for to, (weight, source, _, name) in found.items():
            path = self.paths[source]
            new[to] = Path(weight, path.used + 1, path.turns + (name is not None), path.digest if name is None else path.keeps(name, text))
        self.paths = new
        self._prune()

    def _prune(self) -> None:
        """Drop what can never win: from the state behind an assistant every ending of the others is open, at most one deletion dearer."""
        if ASSISTANT in self.paths:
            cost = {q: p.weight >> 3 * self.width for q, p in self.paths.items()}
            for q, more in ((SYSTEM, 0), (START, DELETE)):
                if q in cost and cost[q] > cost[ASSISTANT] + more:
                    del self.paths[q]

    def _flush(self) -> None:
        """Take the letters that all paths share out of the weights; widen them where too few are shared."""
        low = (1 << 3 * self.width) - 1
        digits = [p.weight & low for p in self.paths.values()]
        differ = 0
        for d in digits:
            differ |= d ^ digits[0]
        same = min((3 * self.width - differ.bit_length()) // 3, *(p.used for p in self.paths.values()), self.width)
        if 2 * same < self.width:
            for p in self.paths.values():
                p.weight <<= 3 * self.width
            self.width *= 2
            return
        self.done.append(self._letters(digits[0], same))
        for p in self.paths.values():
            cost = p.weight >> 3 * self.width
            p.weight = (cost << 3 * self.width) | ((p.weight << 3 * same) & low)
            p.used -= same

    def _letters(self, digits: int, count: int) -> str:
        return "".join(LETTERS[digits >> 3 * (self.width - 1 - i) & 7] for i in range(count))

    def close(self) -> tuple[int, str, str]:
        """Cost, letters and digest of the best path; one that ends where the pattern may end."""
        if max(p.used for p in self.paths.values()) + 4 > self.width:
            self._flush()
        self._insert()
        best = min((self.paths[q] for q in (START, ASSISTANT) if q in self.paths), key=lambda p: p.weight)
        digits = best.weight & ((1 << 3 * self.width) - 1)
        return best.weight >> 3 * self.width, "".join(self.done) + self._letters(digits, best.used), best.digest.hexdigest()


class Report:
    """What is counted of one conversation while its rows pass."""

    def __init__(self) -> None:
        self.repair = Repair()
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.repair.add(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        cost, audit, digest = self.repair.close()
        return gaps, *self.faults[1:], self.illegal, cost, audit, digest


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows`` (as :func:`damage` makes them): counts of faults, and the cheapest repair.

    conv_id; gaps (missing turns between the first and the last), blank, duplicate, truncated (rows by first fault), illegal
    (neighbouring roles that do not follow each other), cost; audit: letters of the edits in order, Delete, Insert, Keep,
    Rerole, the cheapest and among these ASCII-least; repaired_sha256 of the repaired ``role:text`` lines.

    Rows follow by turn, nulls first, then by role and text; a null conversation is one of its own. A conversation without
    rows left has zeros, an empty audit and the digest of nothing. An empty role has no letter that could be kept. Repeated rows are duplicates. An empty table gives
    no rows. Gaps beyond the range of long are its end. Other columns are not read.
    """
    kind = rows.schema["conv_id"].dataType
    marked = faults(rows).sortWithinPartitions(*ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, report = None, None
        for batch in batches:
            made = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "fault"))
            for c, turn, role, text, dropped, fault in zip(*columns, strict=True):
                if report is None or c != conv:
                    if report is not None:
                        made.append((conv, *report.row()))
                    conv, report = c, Report()
                if not dropped:
                    report.add(turn, role, text, fault)
            if made:
                yield packed(made, batch.schema.field("conv_id").type)
            key = batch.schema.field("conv_id").type
        if report is not None:
            yield packed([(conv, *report.row())], key)

    def packed(made: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        kinds = [key, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made, strict=True), kinds, strict=True)], names)

    schema = f"conv_id {kind.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    return marked.select("conv_id", "turn", "role", "text", "dropped", "fault").mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 1), role, text, edit; ``report`` is what :func:`repair` gave."""
    mine = Window.partitionBy("conv_id")
    ordered = Window.partitionBy("conv_id").orderBy(*ORDER[2:])
    numbered = rows.where(~F.col("dropped")).withColumn("row", F.row_number().over(ordered)).select(F.col("conv_id").alias("of"), "row", "role", "text")
    letters = report.select("conv_id", F.posexplode(F.split("audit", "")).alias("place", "edit")).where("edit <> ''")
    upto = mine.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    letters = letters.withColumn("row", F.count(F.when(F.col("edit") != "I", 1)).over(upto)).withColumn("position", F.count(F.when(F.col("edit") != "D", 1)).over(upto))
    found = (letters["conv_id"].eqNullSafe(numbered["of"])) & (letters["row"] == numbered["row"]) & (letters["edit"] != "I")
    both = letters.where("edit <> 'D'").join(numbered, found, "left").select("conv_id", "position", "edit", "role", "text")
    opens = F.max((F.col("position") == 1) & (F.col("edit") == "K") & F.col("role").startswith("s")).over(mine).cast("int")
    turn = F.when((F.col("position") - opens) % 2 == 1, "user").otherwise("assistant")
    return both.withColumn("opens", opens).select(
        "conv_id", F.col("position").cast("long").alias("position"), F.when(F.col("edit") == "K", F.col("role")).otherwise(turn).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit"
    )
