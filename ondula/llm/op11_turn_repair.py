"""Repair of the order of a conversation's turns by a rank-compressed dynamic program.

A repaired conversation's role initials read ``(s?(ua)+)?``.  Edits: keep a turn (K, costs
0), give it the role user or assistant (R, 1), delete it (D, 2; blank turns and repeats must
go), insert an empty user or assistant turn (I, 5); a truncated turn that stays costs 5 more.
The cheapest edits win, among them those whose initials are ASCII-least.

A layer is a turn.  Its macro edits are a run of inserts and then one edit of the turn:
``D, ID, IID, IIK, ... R``.  No macro edit's initials begin another's, so strings of as many macro
edits compare like the lists of their places in that order.  A layer therefore keeps no
strings: each of the four states (nothing yet, after system, after user, after assistant) holds
its cost, its rank among the layer's states and a pointer to its parent, and ranks of the next
layer follow from (rank of the parent, macro edit).  The initials are rebuilt from the
pointers afterwards.

No conversation has to fit a task.  Equal rows of a turn are counted before they are
shuffled; rows are dealt by ranges of (conversation, turn, role, text), so a long conversation lies
in many partitions, and cut into blocks of at most 4,096 turns or about 4 MB.  A conversation
that is one block inside a partition is repaired there.  Of any other, each block gives the costs and ranks
from each of its four states to each; these few numbers meet by conversation, which fixes every block's
states, and each block rebuilds its edits by itself.

Defined results: null roles and texts are one space; turns are ordered with nulls first, ties by role,
then by a hash of the text; the null conversation id is one conversation.  A turn's role counts
by its first character; any other than s, u, a (also none) can't be kept.  A row of 0 copies holds its
conversation's place only: without other rows it has zeros and no edits.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.llm import common

#: Turns and bytes of text of a block.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
SPACES, STOPS = common.SPACES.encode(), b".!?"
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after a system turn, after a user's, after an assistant's. What an inserted or renamed turn leads to.
NONE, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept turn of an initial may stand, and leads to.
KEPT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
RENAME, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: Two inserts lead to every state that more would.
MACROS = sorted("I" * k + edit for k in range(3) for edit in "DKR")
#: State -> inserts that complete a conversation which ends there.
ENDS = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
FAR = 1 << 62


def _moves(kind: str) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, macro edit) of a turn, the best of each pair of states. kind: its initial, a capital if truncated; d must go."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for code, macro in enumerate(MACROS):
        for x in range(4):
            y, cost = x, INSERT * (len(macro) - 1)
            for _ in macro[:-1]:
                y = EXPECTED[y]
            if macro[-1] == "D":
                cost += DELETE
            elif kind == "d":
                continue
            else:
                to = KEPT[kind.lower()].get(y) if macro[-1] == "K" else EXPECTED[y]
                if to is None:
                    continue
                y, cost = to, cost + CUT_SHORT * kind.isupper() + RENAME * (macro[-1] == "R")
            best[x, y] = min(best.get((x, y), (FAR, 0)), (cost, code))
    return [(x, y, cost, code) for (x, y), (cost, code) in best.items()]


MOVES = {kind: _moves(kind) for kind in "suaoSUAOd"}


def layers(kinds: str, entry: int) -> tuple[list[int], list[int], list[list[tuple[int, int] | None]]]:
    """Cost and rank of each state after the turns, from one state before them, and each layer's parents: (state, macro edit)."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[entry] = 0
    parents: list[list[tuple[int, int] | None]] = []
    for kind in kinds:
        best, parent = [(FAR, 0)] * 4, [None] * 4
        for x, y, more, code in MOVES[kind]:
            if cost[x] < FAR and (new := (cost[x] + more, rank[x] << 4 | code)) < best[y]:
                best[y], parent[y] = new, (x, code)
        order = sorted(b[1] for b in best if b[0] < FAR)
        cost = [b[0] for b in best]
        rank = [order.index(b[1]) if b[0] < FAR else 0 for b in best]
        parents.append(parent)
    return cost, rank, parents


def rebuilt(parents: list[list[tuple[int, int] | None]], state: int) -> str:
    out = []
    for parent in reversed(parents):
        state, code = parent[state]
        out.append(MACROS[code])
    return "".join(reversed(out))


def final(cost: list[int], rank: list[int]) -> tuple[int, int]:
    """Total cost and last state of the best repair."""
    total, _, state = min((cost[x] + INSERT * more, rank[x], x) for x, more in ENDS.items())
    return total, state


@lru_cache(1 << 16)
def _short(kinds: str) -> tuple[int, str]:
    cost, rank, parents = layers(kinds, NONE)
    total, state = final(cost, rank)
    return total, rebuilt(parents, state) + "I" * ENDS[state]


def repair(kinds: str) -> tuple[int, str]:
    """Cost and initials of the best edits of a whole conversation."""
    return _short(kinds) if len(kinds) <= 64 else _short.__wrapped__(kinds)


def edited(audit: str, kinds: str, roles: list[str], texts: list[str], state: int = NONE) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits. roles, texts: of the turns that may stay."""
    out_roles, out_texts, turns, kind = [], [], iter(zip(roles, texts)), iter(kinds)
    for edit in audit:
        if edit == "I":
            state = EXPECTED[state]
            out_roles.append(ROLE[state])
            out_texts.append("")
            continue
        k = next(kind)
        if k == "d":
            continue
        role, text = next(turns)
        if edit == "D":
            continue
        state = KEPT[k.lower()][state] if edit == "K" else EXPECTED[state]
        out_roles.append(role if edit == "K" else ROLE[state])
        out_texts.append(text)
    return out_roles, out_texts


class Block:
    """Some of a conversation's turns in order, and what their neighbours need to know of them."""

    def __init__(self, conv):
        self.conv, self.bytes, self.kinds, self.roles, self.texts = conv, 0, [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        ends = text.rstrip(common.SPACES)[-1:]
        if not ends or again:
            self.blank += not ends
            self.duplicate += bool(ends)
            self.kinds.append("d")
            return
        kind = initial if initial in KEPT and initial != "o" else "o"
        if ends not in ".!?":
            self.truncated += 1
            kind = kind.upper()
        self.kinds.append(kind)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)

    def row(self, part: int, no: int, alone: bool) -> dict:
        kinds = "".join(self.kinds)
        out = {k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first", "last", "roles", "texts")}
        out |= {"conv_id": self.conv, "part": part, "no": no, "alone": alone, "kinds": kinds}
        if alone:
            out["cost"], out["audit"] = repair(kinds)
            out["roles"], out["texts"] = edited(out["audit"], kinds, self.roles, self.texts)
        else:
            each = [layers(kinds, x)[:2] for x in range(4)]
            out["costs"], out["ranks"] = [c for cost, _ in each for c in cost], [r for _, rank in each for r in rank]
        return out


#: What block says of itself beside its texts; ``path`` is a whole conversation's.
FACTS = "part int, no int, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first string, last string, costs array<long>, ranks array<int>"
TEXTS = "kinds string, roles array<string>, texts array<string>, audit string"
TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row.get("texts") or ()))
        if len(held) >= most or size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(df: DataFrame, ddl: str) -> tuple[str, pa.Schema]:
    """The DDL with conv_id of df's type before it, and the same for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {ddl}"
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows (conv_id, turn, role, text, n: copies). Those alone in their conversation are repaired already."""
    ddl, schema = _arrow(rows, f"alone boolean, cost long, {FACTS}, {TEXTS}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, no, block, whole = TaskContext.get().partitionId(), 0, None, False
        for batch in batches:
            for conv, turn, role, text, n, later in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "later")]):
                if block is None or conv != block.conv or (conv is None) != (block.conv is None):
                    if block is not None:
                        # The conversation that a partition starts with may have begun in the one before.
                        yield block.row(part, no, whole)
                        no += 1
                    whole, block = block is not None, Block(conv)
                for copy in range(n):
                    if len(block.kinds) >= BLOCK_ROWS or block.bytes >= BLOCK_BYTES:
                        yield block.row(part, no, False)
                        no, whole, block = no + 1, False, Block(conv)
                    block.add(turn, role, text, later or copy > 0)
        if block is not None:
            yield block.row(part, no, False)

    seen = rows.where("n > 0").groupBy("conv_id", "role", F.sha2("text", 256).alias("sha"))
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    seen = common.cut(seen.agg(F.min(order).alias("at"), F.max(order).alias("end")).where("at != end").drop("end"))
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("sha", F.sha2("text", 256))
    s = common.maybe_broadcast(seen.select(*[F.col(c).alias(f"s_{c}") for c in seen.columns]))
    marked = once.join(s, F.col("conv_id").eqNullSafe(F.col("s_conv_id")) & (F.col("role") == F.col("s_role")) & (F.col("sha") == F.col("s_sha")), "left")
    marked = marked.withColumn("later", F.coalesce(order != F.col("s_at"), F.lit(False)))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "sha"]
    dealt = marked.select("conv_id", "turn", "role", "sha", "text", "n", "later").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return dealt.drop("sha").mapInArrow(lambda batches: _batches(cut(batches), schema), ddl)


def _joined(facts: list[dict]) -> tuple[dict, list[tuple[int, int, int, int]]]:
    """Totals of a conversation from its blocks' facts in order, and of each block (part, no, state before, state after)."""
    cost, rank, parents = [0, FAR, FAR, FAR], [0] * 4, []
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    first_turn = last_turn = last = None
    for f in facts:
        best, parent = [(FAR, 0)] * 4, [0] * 4
        for x in range(4):
            for y in range(4):
                more = f["costs"][4 * x + y]
                if cost[x] < FAR and more < FAR and (new := (cost[x] + more, rank[x] << 2 | f["ranks"][4 * x + y])) < best[y]:
                    best[y], parent[y] = new, x
        order = sorted(b[1] for b in best if b[0] < FAR)
        cost, rank = [b[0] for b in best], [order.index(b[1]) if b[0] < FAR else 0 for b in best]
        parents.append(parent)
        for k in total:
            total[k] += f[k]
        if f["first"] is not None:
            total["illegal"] += last is not None and last + f["first"] not in LEGAL
            last = f["last"]
        if f["first_turn"] is not None:
            total["turns"] -= last_turn == f["first_turn"]
            first_turn, last_turn = f["first_turn"] if first_turn is None else first_turn, f["last_turn"]
    total["cost"], state = final(cost, rank)
    total["gaps"] = 0 if first_turn is None else last_turn - first_turn + 1 - total.pop("turns")
    path = []
    for f, parent in zip(reversed(facts), reversed(parents)):
        path.append((f["part"], f["no"], parent[state], state))
        state = parent[state]
    return total, path[::-1]


def repair_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text, n: copies): a row per conversation (conv_id, alone, its counts and cost), and its pieces.

    Pieces (conv_id, part, no, alone, audit, roles, texts): the edits' initials and the repaired turns, in order of part and no.
    """
    whole = common.cut(blocks(rows))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    done = whole.where("alone")
    parts = whole.where("not alone")
    ddl, schema = _arrow(rows, f"{TOTALS}, path array<struct<part:int,no:int,before:int,after:int>>")

    def join(group: pa.Table) -> pa.Table:
        facts = sorted(group.to_pylist(), key=lambda f: (f["part"], f["no"]))
        total, path = _joined(facts)
        path = [dict(zip(("part", "no", "before", "after"), p)) for p in path]
        return pa.Table.from_pylist([total | {"conv_id": facts[0]["conv_id"], "path": path}], schema)

    facts = ["conv_id", *[f.split()[0] for f in FACTS.split(", ")]]
    met = common.cut(parts.select(*facts).groupBy("conv_id").applyInArrow(join, ddl))
    states = common.cut(met.select(F.posexplode("path").alias("at", "p"), (F.size("path") - 1).alias("end")).select("p.*", (F.col("at") == F.col("end")).alias("ends")))
    ddl_piece, schema_piece = _arrow(rows, "part int, no int, alone boolean, audit string, roles array<string>, texts array<string>")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                audit = rebuilt(layers(r["kinds"], r["before"])[2], r["after"]) + "I" * (ENDS[r["after"]] * r["ends"])
                roles, texts = edited(audit, r["kinds"], r["roles"], r["texts"], r["before"])
                yield {"conv_id": r["conv_id"], "part": r["part"], "no": r["no"], "alone": False, "audit": audit, "roles": roles, "texts": texts}

    fixed = parts.select("conv_id", "part", "no", "kinds", "roles", "texts").join(common.maybe_broadcast(states), ["part", "no"])
    pieces = fixed.mapInArrow(lambda batches: _batches(rebuild(batches), schema_piece), ddl_piece)
    totals = done.select("conv_id", F.lit(True).alias("alone"), gaps, *sums).unionByName(met.select("conv_id", F.lit(False).alias("alone"), "gaps", *sums))
    return totals, done.select("conv_id", "part", "no", "alone", "audit", "roles", "texts").unionByName(pieces)


def lines(roles: Column, texts: Column) -> Column:
    return F.zip_with(roles, texts, lambda r, t: F.concat(r, F.lit(":"), t))


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256 of each conversation; one in several pieces is hashed as they stream by in order."""
    ddl, schema = _arrow(pieces, "audit string, repaired_sha256 string")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, state = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != conv:
                    if state is not None:
                        yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": state.hexdigest()}
                    conv, audit, state, between = r["conv_id"], [], hashlib.sha256(), ""
                audit.append(r["audit"])
                if r["lines"]:
                    state.update((between + "\n".join(r["lines"])).encode())
                    between = "\n"
        if state is not None:
            yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": state.hexdigest()}

    held = pieces.select("conv_id", "part", "no", "alone", "audit", lines(F.col("roles"), F.col("texts")).alias("lines"))
    one = held.where("alone").select("conv_id", "audit", F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256"))
    several = held.where("not alone").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return one.unionByName(several.mapInArrow(lambda batches: _batches(stream(batches), schema), ddl))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows damaged by a hash of their conversation and turn; a dropped one has 0 copies."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    held = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("k"))
    gone = F.col("k") == 0
    return held.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("k") == 1), "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals, pieces = repair_turns(damaged(common.read(spark, sf_dir, "conversations")))
    d = digests(pieces).select(F.col("conv_id").alias("d_conv_id"), "audit", "repaired_sha256")
    out = totals.drop("alone").join(d, F.col("conv_id").eqNullSafe(F.col("d_conv_id")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
