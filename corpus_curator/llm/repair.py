"""Conversation structure repair: the cheapest edits that make roles alternate.

``damaged`` breaks conversations by a rule; ``repair`` finds, for each one, the
cheapest edits after which the role initials read ``(s?(ua)+)?``. Keep costs 0,
Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or assistant
turn) 3, a truncated row that stays 3 more; blank and duplicate rows must go.
Among the cheapest the audit (the edits' initials) that is least in ASCII counts.

``search`` is depth-first branch and bound over one run of rows: an explicit stack,
lower bounds of every suffix, the incumbent (cost, audit), and for each node (rows
done, grammar state) the best prefix so far; worse prefixes and nodes that cannot
beat the incumbent are cut until none is left. The suffix bounds solve a relaxed
problem in which system rows may stay anywhere.

Rows are range-partitioned by (conversation, turn, role, text): no task gets a long
conversation whole. One that lies inside a partition is finished there. One that
spans partitions is cut into runs of ``SEGMENT`` rows, each searched for every pair
of entry and exit state; equally cheap audits of a run are never prefixes of one
another (every audit of a run ends with a row's edit), so that the tables compose,
in a tree, into the optimum of the whole.

Defined results. Null roles and texts count as one space, a null id or turn is
written as one space in the damage rule; a null id is a conversation of its own;
null turns come first; rows of one turn go by role, then text. A conversation whose
rows all vanish gets zeros, an empty audit and the hash of the empty string. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import saved

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
SEGMENT = 64
FAN = 32
BLANKS = r"[\x20\x09-\x0D]"

#: Grammar states: nothing yet, after s, after u, after a. Accepted at the end: 0, 3.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT,
        (ASSISTANT, "u"): USER}
#: The initial that may follow each state, beside a leading s.
NEXT = "uuau"

#: A row: its role initial and its fault ("b", "d", "t" or "").
Row = tuple[str, str]
Best = tuple[int, str]


# ------------------------------------------------------------------ one run of rows

def _suffix_bounds(rows: list[Row], ends: set[int]) -> list[tuple[int, int]]:
    """For every suffix the least cost of a relaxed problem, from a state that asks
    for u (index 0) and from one that asks for a (index 1): system rows may stay
    anywhere, START, SYSTEM and ASSISTANT are one. Never above the true cost."""
    far = 1 << 40
    last = [0 if ends - {USER} else far, 0 if USER in ends else far]
    last = [min(last[0], last[1] + INSERT), min(last[1], last[0] + INSERT)]
    bounds = [tuple(last)]
    for initial, fault in reversed(rows):
        after, here = bounds[-1], []
        for want in (0, 1):
            cost = DELETE + after[want]
            if fault not in ("b", "d"):
                stay = CUT if fault == "t" else 0
                cost = min(cost, stay + REROLE + after[1 - want])
                if initial == "ua"[want]:
                    cost = min(cost, stay + after[1 - want])
                elif initial == "s":
                    cost = min(cost, stay + after[want])
            here.append(cost)
        bounds.append((min(here[0], here[1] + INSERT), min(here[1], here[0] + INSERT)))
    return bounds[::-1]


def _edits(state: int, row: Row) -> Iterator[tuple[int, str, int]]:
    """``(cost, audit, next state)`` of one row, at most one insertion before it (two
    restore the alternation they found). In ASCII order of the audit."""
    initial, fault = row
    yield DELETE, "D", state
    if fault in ("b", "d"):
        return
    stay = CUT if fault == "t" else 0
    filled = STEP[state, NEXT[state]]
    if (filled, initial) in STEP:
        yield INSERT + stay, "IK", STEP[filled, initial]
    yield INSERT + stay + REROLE, "IR", STEP[filled, NEXT[filled]]
    if (state, initial) in STEP:
        yield stay, "K", STEP[state, initial]
    yield stay + REROLE, "R", filled


def _endings(state: int) -> tuple[int, str, int]:
    """What completes the grammar after the last row."""
    n = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
    return INSERT * n, "I" * n, START if state == START else ASSISTANT


def search(rows: list[Row], entry: int = START, exit_: int | None = None) -> Best | None:
    """The cheapest edits of ``rows`` from state ``entry``, ASCII-least among equals:
    to state ``exit_``, or, with None, to the end of a conversation."""
    n = len(rows)
    # a conversation ends after a, or before its first row
    bounds = _suffix_bounds(rows, {ASSISTANT if exit_ is None else exit_})
    incumbent: Best | None = None
    tables: list[dict[int, Best]] = [{} for _ in range(n + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        least = cost + bounds[at][state == USER]
        # a prefix as cheap as the incumbent still counts if its audit may be smaller
        if incumbent and (least > incumbent[0] or (least == incumbent[0]
                                                   and audit > incumbent[1][:len(audit)])):
            continue
        known = tables[at].get(state)
        if known and known < (cost, audit):
            continue
        if at == n:
            if exit_ is None:
                more, tail, _ = _endings(state)
                found = (cost + more, audit + tail)
            elif state == exit_:
                found = (cost, audit)
            else:
                continue
            incumbent = min(incumbent or found, found)
            continue
        nodes = []
        for more, letters, after in _edits(state, rows[at]):
            node = (cost + more, audit + letters)
            best = tables[at + 1].get(after)
            if best is None or node < best:
                tables[at + 1][after] = node
                nodes.append((node[0] + bounds[at + 1][after == USER], node[1], at + 1, after,
                              node[0]))
        # the most promising node is searched first: it is pushed last
        for _, letters, place, after, total in sorted(nodes, reverse=True):
            stack.append((place, after, total, letters))
    return incumbent


Table = dict[str, Best]  # "entry exit" -> (cost, audit)


def table_of(rows: list[Row], entries: tuple[int, ...] = (0, 1, 2, 3)) -> Table:
    found = {f"{i}{j}": search(rows, i, j) for i in entries for j in range(4)}
    return {k: v for k, v in found.items() if v}


def compose(x: Table, y: Table) -> Table:
    """Best edits of two neighbouring runs for every pair of outer states."""
    out: Table = {}
    for k, (cost, audit) in x.items():
        for m, (more, letters) in y.items():
            if k[1] == m[0]:
                now = (cost + more, audit + letters)
                out[k[0] + m[1]] = min(out.get(k[0] + m[1], now), now)
    return out


def finish(table: Table) -> Best:
    ends = []
    for k, (cost, audit) in table.items():
        if k[0] == str(START):
            more, letters, _ = _endings(int(k[1]))
            ends.append((cost + more, audit + letters))
    return min(ends)


class Replay:
    """Applies an audit to rows as they come and hashes what they become."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first = audit, 0, START, True
        self.hash = hashlib.sha256()

    def _put(self, role: str, text: str, state: int) -> None:
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first, self.state = False, state

    def _fill(self, text: str) -> None:
        role = {"u": "user", "a": "assistant"}[NEXT[self.state]]
        self._put(role, text, STEP[self.state, NEXT[self.state]])

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._fill("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role, text, STEP[self.state, role[:1]])
        elif edit == "R":
            self._fill(text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


# ------------------------------------------------------------------ tables

def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage rule: crc32 of ``conv_id:turn``
    mod 20 drops a row (0), empties its text (1), takes its ``.!?`` (2), repeats it
    (3) or makes it a user's (4)."""
    def written(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")),
                  F.lit(20))
    rows = conversations.select("conv_id", "turn", written("role").alias("role"),
                                written("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = (F.when(F.col("kind") == 1, "")
            .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"),
                                           text.alias("text"), F.explode(times).alias("_copy")
                                           ).drop("_copy")


def _faulted(rows: DataFrame) -> DataFrame:
    """Rows with their fault. A row is a duplicate if an earlier one of its conversation
    has its role and text: all but the first of each group. Firsts are found by an
    aggregate and joined back by row, whose key is never hot."""
    text = F.col("text")
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    cut = ~text.rlike(r"[.!?]" + BLANKS + r"*\z")
    rows = saved(rows.select(
        "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("row"),
        F.when(blank, "b").when(cut, "t").otherwise("").alias("fault")), "repair-rows")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn", "row"))
    firsts = (rows.filter("fault <> 'b'").groupBy("conv_id", same.alias("same"))
              .agg(first.alias("m")).select(F.col("m.row").alias("row"), F.lit(True).alias("first")))
    fault = F.when((F.col("fault") != "b") & F.col("first").isNull(), "d").otherwise(
        F.col("fault"))
    return rows.join(firsts, "row", "left").withColumn("fault", fault).drop("first")


class Figures:
    """What a run of rows in order knows; runs that follow one another add up."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns")

    def __init__(self):
        self.sums = dict.fromkeys(self.FIELDS, 0)
        self.low = self.high = self.first = self.last = None
        self.left = ""  # the first row's initial
        self.right = ""

    def add(self, turn, initial: str, fault: str) -> None:
        other = Figures()
        other.sums["turns"] = int(turn is not None)
        other.low = other.high = other.first = other.last = turn
        other.left = other.right = initial or "-"
        for name, letter in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
            other.sums[name] = int(fault == letter)
        self.merge(other)

    def merge(self, other: Figures) -> None:
        for k, v in other.sums.items():
            self.sums[k] += v
        if self.last is not None and self.last == other.first:
            self.sums["turns"] -= 1  # one turn on both sides
        if self.right and other.left and self.right + other.left not in ("su", "ua", "au"):
            self.sums["illegal"] += 1
        known = [x for x in (self.low, self.high, other.low, other.high) if x is not None]
        self.low, self.high = min(known, default=None), max(known, default=None)
        self.first = other.first if not self.right else self.first
        self.last = other.last if other.right else self.last
        self.left, self.right = self.left or other.left, other.right or self.right

    def gaps(self) -> int:
        if self.low is None:
            return 0
        return min(self.high - self.low + 1 - self.sums["turns"], (1 << 63) - 1)

    def dump(self) -> str:
        return json.dumps([self.sums, self.low, self.high, self.first, self.last, self.left,
                           self.right])

    @classmethod
    def load(cls, text: str) -> Figures:
        out = cls()
        out.sums, out.low, out.high, out.first, out.last, out.left, out.right = json.loads(text)
        return out


RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")


def _result(conv, figures: Figures, best: Best, digest: str) -> dict:
    return {"conv_id": conv, "gaps": figures.gaps(),
            **{k: figures.sums[k] for k in ("blank", "duplicate", "truncated", "illegal")},
            "cost": best[0], "audit": best[1], "repaired_sha256": digest}


def repair(rows: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``):
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``."""
    spark = rows.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    piece = (f"conv_id {kind['conv_id']}, {RESULT}, part int, no long, edits string, "
             "figures string, roles array<string>, texts array<string>")
    schema = to_arrow_schema(spark.createDataFrame([], piece).schema)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text",
             "row"]
    placed = (_faulted(rows).repartitionByRange(*order).sortWithinPartitions(*order)
              .select("conv_id", "turn", "role", "text", "fault"))

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows],
                                          schema)

    def runs(batches):
        """Conversations inside a partition as results. Those of more than ``segment``
        rows, and the first and last of the partition (which may go on elsewhere), as
        segments."""
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        out: list[dict] = []
        conv, no, first = None, 0, True

        def figures_of(lines: list[tuple]) -> Figures:
            figures = Figures()
            for turn, role, _, fault in lines:
                figures.add(turn, role[:1], fault)
            return figures

        def cut(lines: list[tuple]) -> None:
            nonlocal no
            found = table_of([(role[:1], fault) for _, role, _, fault in lines])
            out.append({"conv_id": conv, "part": part, "no": no, "edits": json.dumps(found),
                        "figures": figures_of(lines).dump(), "roles": [x[1] for x in lines],
                        "texts": [x[2] for x in lines]})
            no += 1

        def end(last: bool) -> None:
            nonlocal no, first
            if no or first or last:
                cut(held)
            else:
                best = search([(role[:1], fault) for _, role, _, fault in held])
                replay = Replay(best[1])
                for _, role, text, _ in held:
                    replay.row(role, text)
                out.append(_result(conv, figures_of(held), best, replay.digest()))
            held.clear()
            no, first = 0, False

        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and own != conv:
                    end(False)
                conv = own
                held.append(tuple(row))
                if len(held) > segment:
                    cut(held[:segment])
                    del held[:segment]
            if out:
                yield batch_of(out)
                out.clear()
        if held:
            end(True)
            yield batch_of(out)

    found = saved(placed.mapInArrow(runs, piece), "repair-runs")
    segments = found.filter("edits IS NOT NULL")
    columns = ["conv_id", "part", "no", "edits", "figures"]
    level_kind = f"conv_id {kind['conv_id']}, part int, no long, edits string, figures string"
    level_schema = to_arrow_schema(spark.createDataFrame([], level_kind).schema)

    def merged(group: pa.Table) -> pa.Table:
        """Neighbouring segments as one."""
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["no"]))
        table, figures = None, Figures()
        for r in rows:
            edits = {k: tuple(v) for k, v in json.loads(r["edits"]).items()}
            table = compose(table, edits) if table else edits
            figures.merge(Figures.load(r["figures"]))
        return pa.Table.from_pylist(
            [{"conv_id": rows[0]["conv_id"], "part": rows[0]["up_part"], "no": rows[0]["up_no"],
              "edits": json.dumps(table), "figures": figures.dump()}], level_schema)

    now = segments.select(*columns)
    parts, most = (x or 0 for x in now.agg(F.max("part"), F.max("no")).first())
    while most or parts:  # first within every partition, then across partitions
        by = (1, fan) if most else (fan, 1)
        up = [F.floor(F.col(c) / F.lit(n)).cast(t).alias(f"up_{c}")
              for c, n, t in (("part", by[0], "int"), ("no", by[1], "long"))]
        now = saved(now.select("*", *up).groupBy("conv_id", "up_part", "up_no")
                    .applyInArrow(merged, level_kind), "repair-level")
        most, parts = most // by[1], parts // by[0]

    def solved(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                best = finish({k: tuple(v) for k, v in json.loads(r["edits"]).items()})
                out.append({**_result(r["conv_id"], Figures.load(r["figures"]), best, None),
                            "part": -1, "no": 0})
            yield batch_of(out)

    plain = found.filter("edits IS NULL").select("conv_id", *_RESULT_COLUMNS)
    answers = now.mapInArrow(solved, piece)

    def replayed(batches):
        """The answer of a conversation, then its segments in order: the digest is
        sequential, so its rows stream through one task, a batch at a time."""
        answer = replay = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["part"] < 0:
                    if answer:
                        out.append({**answer, "repaired_sha256": replay.digest()})
                    answer, replay = r, Replay(r["audit"])
                else:
                    for role, text in zip(r["roles"], r["texts"]):
                        replay.row(role, text)
            if out:
                yield batch_of(out)
        if answer:
            yield batch_of([{**answer, "repaired_sha256": replay.digest()}])

    spanning = (answers.unionByName(segments).repartition("conv_id")
                .sortWithinPartitions("conv_id", "part", "no").mapInArrow(replayed, piece))
    return plain.unionByName(spanning.select("conv_id", *_RESULT_COLUMNS))


_RESULT_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


def repaired(conversations: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """Damage, then repair: one row for every ``conv_id`` of ``conversations``, also of
    those that lost all their rows."""
    found = repair(damaged(conversations), segment, fan)
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    none = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return (ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("id").alias("conv_id"),
                    *[F.coalesce(c, F.lit(none.get(c, 0))).alias(c) for c in _RESULT_COLUMNS]))
