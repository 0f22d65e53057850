"""Conversation structure repair by an auction algorithm for shortest paths.

A conversation is a lattice: a node is (rows read, what the roles kept so far
end in), and an edit leads from node to node at an integer cost.  The auction
keeps a price for every node, a lower bound of the way to the end, and one path
from the origin.  The path's last node bids: where an arc's cost plus the price
behind it equals the node's price the path is extended along it; otherwise the
price rises to the best such sum and the path contracts by one node.  When the
path meets a node whose price is known to be exact, all prices along it are
exact too.  Origins are taken from the end of the conversation backwards, so a
path soon meets exact nodes.  Converged prices make the arcs of all cheapest
repairs tight; a walk along tight arcs that takes the smallest letter first
gives the least of them (a tight arc into a node not yet exact is settled by an
auction from there).

Rows are sorted by ranges of (conversation, turn, role, text), equal rows being
one row with a count.  A task repairs the conversations that lie inside its
range at once.  Those at its two edges may go on in the next range, so their
rows are stored in pieces, each with the cheapest cost between its four entry
and four exit states (auctions again).  One pass over the pieces' small tables
from the last to the first gives every piece the cost from its exits to the end;
pieces are then traced in parallel, and a pass from the first to the last picks
each one's entry and hashes the repaired text.  So a conversation with a third
of all rows is sorted, priced and traced by many tasks; only the two passes are
in order (SHA-256 has no parallel form), and they hold one piece at a time.

Defined cases: a null role or text counts as one space; null ids are one
conversation; null turns come first and are no gap; rows of one turn are ordered
by role and text; repeated rows are duplicates; an empty role has no initial and
is never kept; empty and very long texts are rows like others, a piece being cut
at ``PIECE_BYTES``; an empty table gives no rows; other columns play no part.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsort.llm.common import WHITE_SPACE, join_hot, partitions, store

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What the roles kept so far end in: nothing, a system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state that a new user or assistant row leads to, from each state.
AFTER = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: At the end: cost from each state, and the edits.
END, CLOSING = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
FAR = 1 << 40
STRIDE = 8
PIECE, PIECE_BYTES = 512, 4 << 20


# ---- the auction -----------------------------------------------------------------

class Lattice:
    """Rows (role initial, truncated) and the cost from each final state on."""

    def __init__(self, rows: list[tuple[str, bool]], ends: tuple = END):
        self.rows, n = rows, len(rows)
        reach = [any(e < FAR for e in ends[s:2] + ends[2:]) if s < USER else any(e < FAR for e in ends[2:]) for s in STATES]
        # only rising states lead on: what ends in a user or assistant row never gets back to nothing or a system row
        reach[SYSTEM] = any(e < FAR for e in ends[1:])
        self.price = [[0 if r else FAR for r in reach] for _ in range(n)] + [list(ends)]
        self.exact = [[not r for r in reach] for _ in range(n)] + [[True] * 4]

    def arcs(self, i: int, s: int) -> Iterator[tuple[str, int, int, int]]:
        """letter, cost, row, state of the edits at a node, letters rising."""
        initial, cut = self.rows[i]
        extra = TRUNCATED if cut else 0
        yield "D", DELETE, i + 1, s
        yield "I", INSERT, i, AFTER[s]
        if (to := KEEPS.get((s, initial))) is not None:
            yield "K", extra, i + 1, to
        yield "R", REROLE + extra, i + 1, AFTER[s]

    def auction(self, i: int, s: int) -> int:
        """The cheapest cost from a node; its path's prices become exact."""
        price, exact, path = self.price, self.exact, [(i, s)]
        while not exact[i][s]:
            best, at = FAR, None
            for _, cost, j, t in self.arcs(i, s):
                if cost + price[j][t] < best:
                    best, at = cost + price[j][t], (j, t)
            if best > price[i][s]:
                price[i][s] = best                       # contract
                if best >= FAR:
                    exact[i][s] = True                   # no way on
                if len(path) > 1:
                    path.pop()
                    i, s = path[-1]
            else:
                i, s = at                                # extend
                path.append(at)
        for a, b in path:
            exact[a][b] = True
        return price[path[0][0]][path[0][1]]

    def settle(self) -> None:
        """Auctions from origins that go backwards."""
        for i in range(len(self.rows) - 1, -1, -STRIDE):
            for s in STATES:
                self.auction(i, s)

    def cost(self, s: int) -> int:
        return self.auction(0, s)

    def trace(self, s: int) -> tuple[list[str], int]:
        """The least of the cheapest edits from the first node (one string for
        every row, the inserts before it included), and the state they end in."""
        self.auction(0, s)
        out, i, here = [], 0, ""
        while i < len(self.rows):
            for letter, cost, j, t in self.arcs(i, s):
                if cost + self.price[j][t] == self.price[i][s] and cost + self.auction(j, t) == self.price[i][s]:
                    break
            here += letter
            if j > i:
                out.append(here)
                here = ""
            i, s = j, t
        return out, s


def crossing(rows: list[tuple[str, bool]]) -> list[int]:
    """Costs from each entry state to each exit state of a piece (row by row)."""
    out = [FAR] * 16
    for t in STATES:
        part = Lattice(rows, tuple(0 if e == t else FAR for e in STATES))
        part.settle()
        for s in STATES:
            out[4 * s + t] = min(FAR, part.cost(s)) if rows else (0 if s == t else FAR)
    return out


def rewritten(edits: list[str], rows: list[tuple[str, str]], s: int, initials: list[str]) -> Iterator[tuple[str, str]]:
    """The (role, text) rows that the edits make, from state ``s``."""
    for word, (role, text), initial in zip(edits, rows, initials):
        for letter in word:
            if letter == "I":
                s = AFTER[s]
                yield ROLE[s], ""
            elif letter == "R":
                s = AFTER[s]
                yield ROLE[s], text
            elif letter == "K":
                s = KEEPS[(s, initial)]
                yield role, text


def closing(s: int) -> Iterator[tuple[str, str]]:
    for _ in CLOSING[s]:
        s = AFTER[s]
        yield ROLE[s], ""


class Digest:
    """SHA-256 of ``role:text`` lines joined by line feeds, as they come."""

    def __init__(self):
        self.hash, self.first = hashlib.sha256(), True

    def add(self, rows: Iterator[tuple[str, str]]) -> None:
        for role, text in rows:
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.first = False


# ---- damage and faults, in SQL ------------------------------------------------------

def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, n: the damaged rows, equal ones as one with a count."""
    space = F.lit(" ")
    c, t = F.col(conv_id), F.col(turn)
    key = F.concat(F.coalesce(c.cast("string"), space), F.lit(":"), F.coalesce(t.cast("string"), space))
    rows = conversations.select(
        c.alias("conv"), t.cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"), (F.crc32(key.cast("binary")) % 20).cast("int").alias("h"))
    rows = rows.where("h <> 0").select(
        "conv", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("h") == 3, 2).otherwise(1).alias("n"))
    return tidy(rows)


def tidy(rows: DataFrame) -> DataFrame:
    """Equal rows as one with a count (``n``)."""
    if "n" not in rows.columns:
        rows = rows.withColumn("n", F.lit(1))
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds blank, repeated (copies that an earlier row makes duplicates), truncated."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE_SPACE))
    rows = rows.withColumn("blank", bare == "").withColumn("truncated", ~F.substring(bare, -1, 1).isin(".", "!", "?"))
    rows = rows.withColumn("same", F.md5(F.concat_ws("\x00", F.coalesce(F.col("conv").cast("string"), F.lit("\x00")), "role", "text")))
    # a null turn is the earliest; a group with one row needs no look at the others
    early = F.coalesce(F.col("turn"), F.lit(-(1 << 63)))
    keys = rows.where(~F.col("blank")).select("same", early.alias("early"))
    firsts = store(keys.groupBy("same").agg(F.min("early").alias("earliest"), F.count(F.lit(1)).alias("members")).where("members > 1"),
                   "conversation-copies")
    seen = join_hot(rows, firsts, "same", "members", int(firsts.agg(F.sum("members")).first()[0] or 0), early)
    return seen.select(
        "conv", "turn", "role", "text", "n", "blank", "truncated",
        F.when(F.col("blank"), 0).when(F.col("earliest") < early, F.col("n")).otherwise(F.col("n") - 1).cast("long").alias("repeated"))


# ---- ranges of conversations ------------------------------------------------------------

COLUMNS = ("conv", "role", "text", "n", "blank", "truncated", "repeated")


class Run:
    """Consecutive rows of one conversation: what stays open to repair (live
    rows), the forced deletions before each, and the pairs of role initials."""

    def __init__(self, conv):
        self.conv, self.live, self.before, self.forced = conv, [], [], 0
        self.cut, self.bytes, self.first, self.last, self.illegal, self.rows = [], 0, None, None, 0, 0

    def add(self, role, text, n, blank, truncated, repeated) -> None:
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.illegal += n - 1                       # a copy follows its equal: no legal pair has two equal initials
        self.last = initial
        self.rows += 1
        if blank or repeated == n:
            self.forced += n
            return
        self.live.append((role, text))
        self.cut.append(bool(truncated))
        self.before.append(self.forced)
        self.bytes += len(role) + len(text)
        self.forced = repeated

    def lattice(self) -> list[tuple[str, bool]]:
        return [(r[:1], c) for (r, _), c in zip(self.live, self.cut)]


def whole(run: Run) -> tuple:
    """conv, illegal, cost, audit, sha of a conversation that lies in one range."""
    lattice = Lattice(run.lattice())
    lattice.settle()
    edits, end = lattice.trace(NOTHING)
    cost = lattice.price[0][NOTHING] + DELETE * (sum(run.before) + run.forced)
    audit = "".join("D" * d + e for d, e in zip(run.before, edits)) + "D" * run.forced + CLOSING[end]
    digest = Digest()
    digest.add(rewritten(edits, run.live, NOTHING, [r[:1] for r, _ in run.live]))
    digest.add(closing(end))
    return run.conv, run.illegal, cost, audit, digest.hash.hexdigest()


PIECE_TYPE = ("part int, at int, illegal long, cost long, audit string, sha string, roles array<string>, texts array<string>, "
              "cut array<boolean>, before array<long>, forced long, first string, last string, table array<long>")


def repair_ranges(conv_type: pa.DataType):
    """Rows in order -> a result for each conversation inside the range, pieces
    for the two at its edges (``audit`` null)."""
    schema = pa.schema([("conv", conv_type), ("part", pa.int32()), ("at", pa.int32()), ("illegal", pa.int64()), ("cost", pa.int64()),
                        ("audit", pa.string()), ("sha", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                        ("cut", pa.list_(pa.bool_())), ("before", pa.list_(pa.int64())), ("forced", pa.int64()), ("first", pa.string()),
                        ("last", pa.string()), ("table", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        out, size, at, edge, now = [], 0, 0, True, None

        def piece(r: Run) -> None:
            nonlocal at, size
            out.append((r.conv, part, at, r.illegal, None, None, None, [x for x, _ in r.live], [x for _, x in r.live], r.cut,
                        r.before, r.forced, r.first, r.last, crossing(r.lattice())))
            at, size = at + 1, size + r.bytes + 500

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

        for b in batches:
            cols = [b.column(c).to_pylist() for c in COLUMNS]
            for conv, *row in zip(*cols):
                if now is None or conv != now.conv:
                    if now is not None:
                        if edge:
                            piece(now)
                        else:
                            done = whole(now)
                            out.append((done[0], None, None, *done[1:], *[None] * 8))
                            size += len(done[3]) + 200
                        edge = False
                    now = Run(conv)
                # a long conversation is an edge of its range or is cut into pieces all the same
                elif len(now.live) >= PIECE or now.bytes >= PIECE_BYTES or now.rows >= 8 * PIECE:
                    edge = True
                    piece(now)
                    now = Run(conv)
                now.add(*row)
            if size > 1 << 22:
                yield batch()
                out, size = [], 0
        if now is not None:
            piece(now)
        if out:
            yield batch()
    return run


def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from the last to the first: the cost from each exit state to the end."""
    conv, ends, started = None, END, False
    for b in batches:
        out = []
        for c, table in zip(b.column("conv").to_pylist(), b.column("table").to_pylist()):
            if not started or c != conv:
                conv, ends, started = c, END, True
            out.append(list(ends))
            # inserts at the border belong to the next piece, which its table counts
            ends = tuple(min(FAR, *(table[4 * s + t] + ends[t] for t in STATES)) for s in STATES)
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("conv", "part", "at")] + [pa.array(out, pa.list_(pa.int64()))],
                                         names=["conv", "part", "at", "ends"])


def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's cheapest edits from each of its entry states: a list of
    strings, one a row, and the exit state."""
    for b in batches:
        edits, exits = [], []
        for roles, cut, ends in zip(*(b.column(c).to_pylist() for c in ("roles", "cut", "ends"))):
            lattice = Lattice([(r[:1], c) for r, c in zip(roles, cut)], tuple(ends))
            lattice.settle()
            found = [lattice.trace(s) if lattice.cost(s) < FAR else (["D"] * len(roles), s) for s in STATES]
            edits.append([e for e, _ in found])
            exits.append([t for _, t in found])
        names = [c for c in b.schema.names if c not in ("ends", "table")]
        yield pa.RecordBatch.from_arrays(
            [b.column(c) for c in names] + [pa.array(edits, pa.list_(pa.list_(pa.string()))), pa.array(exits, pa.list_(pa.int32()))],
            names=[*names, "edits", "exits"])


def joined(conv_type: pa.DataType):
    """Traced pieces in order -> one result for each conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, started, s, last = None, False, NOTHING, None
        illegal, cost, audit, digest = 0, 0, [], Digest()

        def result() -> pa.RecordBatch:
            digest.add(closing(s))
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], conv_type), pa.array([illegal], pa.int64()), pa.array([cost + END[s]], pa.int64()),
                 pa.array(["".join(audit) + CLOSING[s]], pa.string()), pa.array([digest.hash.hexdigest()], pa.string())],
                names=["conv", "illegal", "cost", "audit", "sha"])

        names = ("conv", "illegal", "roles", "texts", "cut", "before", "forced", "first", "last", "edits", "exits")
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in names)):
                c, bad, roles, texts, cut, before, forced, first, final, edits, exits = row
                if not started or c != conv:
                    if started:
                        yield result()
                    conv, started, s, last = c, True, NOTHING, None
                    illegal, cost, audit, digest = 0, 0, [], Digest()
                illegal += bad + (last is not None and last + first not in ("su", "ua", "au"))
                last = final
                words = edits[s]
                for word, d, x in zip(words, before, cut):
                    audit.append("D" * d + word)
                    cost += DELETE * d + sum({"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[e] for e in word)
                    cost += TRUNCATED if x and word[-1] != "D" else 0
                audit.append("D" * forced)
                cost += DELETE * forced
                digest.add(rewritten(words, list(zip(roles, texts)), s, [r[:1] for r in roles]))
                s = exits[s]
        if started:
            yield result()
    return run


# ---- the operator ------------------------------------------------------------------------------

def in_order(df: DataFrame, *order: Column) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "conv").sortWithinPartitions(*order)


def repair_rows(rows: DataFrame) -> DataFrame:
    """conv, illegal, cost, audit, sha of the conversations in ``faults`` rows."""
    spark = rows.sparkSession
    conv_type = pa.int64() if rows.schema["conv"].dataType.typeName() == "long" else pa.string()
    name = rows.schema["conv"].dataType.simpleString()
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = (rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select(*COLUMNS))
    done = store(ranged.mapInArrow(repair_ranges(conv_type), f"conv {name}, {PIECE_TYPE}"), "conversations")
    pieces = done.where(F.col("audit").isNull())
    back = in_order(pieces.select("conv", "part", "at", "table"), F.col("conv"), F.desc("part"), F.desc("at"))
    ends = back.mapInArrow(priced, f"conv {name}, part int, at int, ends array<long>")
    on = pieces["conv"].eqNullSafe(ends["conv"]) & (pieces["part"] == ends["part"]) & (pieces["at"] == ends["at"])
    both = pieces.join(ends, on).select(*[pieces[c] for c in (
        "conv", "part", "at", "illegal", "roles", "texts", "cut", "before", "forced", "first", "last")], "ends")
    shape = (f"conv {name}, part int, at int, illegal long, roles array<string>, texts array<string>, cut array<boolean>, "
             "before array<long>, forced long, first string, last string, edits array<array<string>>, exits array<int>")
    trails = in_order(both.mapInArrow(traced, shape), F.col("conv"), F.col("part"), F.col("at"))
    edge = trails.mapInArrow(joined(conv_type), f"conv {name}, illegal long, cost long, audit string, sha string")
    return done.where(F.col("audit").isNotNull()).select("conv", "illegal", "cost", "audit", "sha").unionByName(edge)


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           damaged: bool = True) -> DataFrame:
    """One row for every conversation: gaps, faults, cost and audit of the
    cheapest repair, digest of the repaired rows.  ``damaged`` puts the test
    damage in first."""
    if damaged:
        rows = damage(conversations, conv_id, turn, role, text)
    else:
        space = F.lit(" ")
        rows = tidy(conversations.select(F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                                         F.coalesce(F.col(role).cast("string"), space).alias("role"),
                                         F.coalesce(F.col(text).cast("string"), space).alias("text")))
    whole_type = conversations.schema[conv_id].dataType.typeName()
    if whole_type not in ("long", "string"):
        rows = rows.withColumn("conv", F.col("conv").cast("string" if whole_type not in ("integer", "short", "byte") else "bigint"))
    rows = store(faults(rows), "conversation-rows")
    live = F.col("n") - F.col("repeated")
    turns = rows.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum("repeated").alias("duplicate"),
        F.sum(F.when(~F.col("blank") & F.col("truncated"), live).otherwise(0)).alias("truncated"))
    counts = turns.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), F.sum("blank").alias("blank"),
        F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"))
    ids = conversations.select(F.col(conv_id).cast(rows.schema["conv"].dataType).alias("conv_id")).distinct()
    fixed = repair_rows(rows)
    a, b = counts.withColumnRenamed("conv", "c1"), fixed.withColumnRenamed("conv", "c2")
    out = ids.join(a, F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(b, F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
