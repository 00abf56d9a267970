"""Conversation structure repair: the cheapest edits that bring a conversation's roles into the grammar `(s?(ua)+)?`.

Rows of a conversation are dealt to pieces, and pieces by hash to partitions. Inside a partition DuckDB runs one recursive query
over a batch of pieces: each recursion advances one turn in all of them and keeps, for each state of the grammar, the least cost
and the ASCII-least audit that reach it. A piece is summed up by what it costs to get from any state to any other, so pieces of a
conversation are put together by the same query, FAN_OUT at a time, until each conversation has one. No conversation is too
long: it is many pieces, and the number of rounds grows with the logarithm of its length. Keeping one audit a state is exact,
as of two audits that end in one state at one cost, neither is the start of the other.

Only keys of 16 bytes (MD5 of role and text) take part in this; texts are shuffled once, with the finished audits, to hash what
is repaired. That pass is sequential within a conversation, as the hash is, and keeps the hash and the audit only.

Rows: null roles and texts are one space, and null ids and turns stand for one space in the key of damage(); rows without an id
are one conversation. Rows of a turn are ordered by their keys, so that repeated rows are adjacent; null turns come first. Roles
count by their first character; an empty role has none and is never legal. Conversations without rows have zeros, an empty
audit and the hash of nothing. Empty tables give empty tables; other columns are not read; ids keep their type.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meridian.llm.common import give_back, stored

#: Turns of a piece at first, rows of a piece at most, and pieces put together in a round.
FAN_OUT = 64
#: The costs of edits; a truncated row that is not deleted costs one more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: White space in the sense of this operator.
SPACES = " \t\n\x0b\x0c\r"
#: States are the last role so far, "-" if there is none yet; these roles may follow.
FOLLOW = {"-": "su", "s": "u", "u": "a", "a": "u"}
#: Cost and audit of the inserts that end a conversation in each state.
FINISH = {"-": (0, ""), "s": (2 * INSERT, "II"), "u": (INSERT, "I"), "a": (0, "")}
ROLE = {"u": "user", "a": "assistant"}
_MOVES = "moves array<struct<origin string, state string, cost long, audit string>>"

_ADVANCE = """
WITH RECURSIVE best(piece, origin, state, cost, audit, step) USING KEY (piece, origin, state) AS (
  SELECT piece, s.origin, s.origin, 0::BIGINT, '', 0::BIGINT FROM (SELECT DISTINCT piece FROM steps), (SELECT unnest(['-', 's', 'u', 'a']) AS origin) s
  UNION ALL
  SELECT piece, origin, state, least.cost, least.audit, step FROM (
    SELECT best.piece, best.origin, m.state, best.step + 1 AS step,
           min({'cost': best.cost + m.cost + s.extra * $delete, 'audit': best.audit || m.audit || repeat('D', s.extra)}) AS least
    FROM best JOIN steps s ON s.piece = best.piece AND s.step = best.step + 1 JOIN moves m ON m.kind = s.kind AND m.origin = best.state
    GROUP BY ALL)
)
SELECT piece, list({'origin': origin, 'state': state, 'cost': cost, 'audit': audit}) AS moves FROM best GROUP BY piece ORDER BY piece"""


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text, copies): the rows after damage chosen by crc32 of `id:turn`, modulo 20."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(
        F.col(id_col),
        F.col(turn_col).alias("turn"),
        text_of(role_col).alias("role"),
        text_of(text_col).alias("text"),
        (F.crc32(F.concat_ws(":", text_of(id_col), text_of(turn_col))) % 20).alias("fate"),
    )
    return rows.where("fate <> 0").select(
        id_col,
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def moves() -> list[tuple[str, str, str, int, str]]:
    """(kind of row, state before, state after, cost, audit): the best way from state to state over one row, inserts before it
    included. Kinds are a row's first letter, with a dot if it is truncated, and x for rows that must go."""
    best: dict[tuple[str, str, str], tuple[int, str]] = {}
    for initial in "suaox":
        for truncated in (False, True):
            kind = initial + "." * truncated
            for origin in FOLLOW:
                at = origin
                for inserts in range(3):  # a third one would lead back
                    ends = [(at, DELETE, "D")]
                    if initial != "x":
                        ends += [(initial, KEEP + truncated * TRUNCATED, "K")] if initial in FOLLOW[at] else []
                        ends += [(r, REROLE + truncated * TRUNCATED, "R") for r in FOLLOW[at] if r in ROLE]
                    for state, cost, edit in ends:
                        way = (cost + inserts * INSERT, "I" * inserts + edit)
                        best[kind, origin, state] = min(way, best.get((kind, origin, state), way))
                    at = next(r for r in FOLLOW[at] if r in ROLE)
    return [(*k, *way) for k, way in best.items()]


def _connection():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.mkdtemp(prefix="duck-")})


def _summed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, given: bool) -> Iterator[pa.RecordBatch]:
    """Batches of (id, block, turn, key, ...), sorted, to pieces (id, turn, key, moves): a piece ends where a block or a batch
    does or when it has FAN_OUT rows, and is placed by its first row. `given`: each row has moves of its own."""
    db = _connection()
    known = pa.table(dict(zip(("kind", "origin", "state", "cost", "audit"), zip(*moves()), strict=True)))
    for batch in batches:
        if not batch.num_rows:
            continue
        owners = list(zip(batch.column(0).to_pylist(), batch.column("block").to_pylist(), strict=True))
        firsts: list[int] = []
        pieces: list[int] = []
        steps: list[int] = []
        for i, owner in enumerate(owners):
            if not i or owner != owners[i - 1] or steps[-1] == FAN_OUT:
                firsts.append(i)
            pieces.append(len(firsts) - 1)
            steps.append(i - firsts[-1] + 1)
        kinds = pa.array(range(len(owners)), pa.int64()) if given else batch.column("kind")
        extra = pa.array([0] * len(owners), pa.int64()) if given else batch.column("extra")
        db.register("steps", pa.table({"piece": pa.array(pieces, pa.int64()), "step": pa.array(steps, pa.int64()), "kind": kinds, "extra": extra}))
        if given:
            own = batch.column("moves")
            flat = own.flatten()
            db.register("moves", pa.table({"kind": own.value_parent_indices().cast(pa.int64())} | {n: flat.field(n) for n in ("origin", "state", "cost", "audit")}))
        else:
            db.register("moves", known)
        found = db.execute(_ADVANCE, {"delete": DELETE}).to_arrow_table()
        at = pa.array(firsts, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column("turn").take(at), batch.column("key").take(at), found["moves"].combine_chunks().cast(schema.field("moves").type)], schema=schema
        )
    db.close()
    give_back()


def _advance(rows: DataFrame, id_col: str, given: bool) -> DataFrame:
    """Pieces of rows, dealt by id and block."""
    schema = StructType([rows.schema[id_col], rows.schema["turn"], rows.schema["key"]]).add(StructType.fromDDL(_MOVES)["moves"])
    arrow = to_arrow_schema(schema)
    dealt = rows.repartition(id_col, "block").sortWithinPartitions(id_col, "block", "turn", "key")
    return dealt.mapInArrow(lambda batches: _summed(batches, arrow, given), schema)


def classified(damaged: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turn, key, kind, extra, blank, duplicate, truncated): rows of equal role, text and turn are one, with `extra` more
    that have to go; the counts are of first faults. A row is a duplicate unless no turn before has its key."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    rows = damaged.select(
        id_col,
        "turn",
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("key"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (trimmed == "").alias("is_blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("is_cut"),
        "copies",
    )
    rows = rows.groupBy(id_col, "turn", "key", "initial", "is_blank", "is_cut").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn"))
    first = rows.groupBy(F.col(id_col).alias("_id"), F.col("key").alias("_key")).agg(F.min(place).alias("first"))
    rows = rows.join(first, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    is_first = F.col("first.turn").eqNullSafe(F.col("turn"))
    stays = is_first & ~F.col("is_blank")
    return rows.select(
        id_col,
        "turn",
        "key",
        F.when(stays, F.concat("initial", F.when(F.col("is_cut"), ".").otherwise(""))).otherwise("x").alias("kind"),
        (F.col("copies") - 1).alias("extra"),
        F.when(F.col("is_blank"), F.col("copies")).otherwise(0).alias("blank"),
        F.when(F.col("is_blank"), 0).otherwise(F.col("copies") - is_first.cast("long")).alias("duplicate"),
        (stays & F.col("is_cut")).cast("long").alias("truncated"),
    )


def cheapest(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, cost, audit) of each conversation with rows, as given by classified()."""
    block = F.floor(F.coalesce(F.col("turn"), F.lit(0)) / FAN_OUT)
    pieces = stored(_advance(rows.select(id_col, F.when(F.col("turn").isNotNull(), block).alias("block"), "turn", "key", "kind", "extra"), id_col, False))
    done = None
    own = Window.partitionBy(id_col)
    while True:
        counted = pieces.withColumn("n", F.count(F.lit(1)).over(own))
        single = counted.where("n = 1").drop("n")
        done = single if done is None else done.unionByName(single)
        if pieces.groupBy(id_col).count().where("count > 1").isEmpty():
            break
        order = F.row_number().over(own.orderBy("turn", "key")) - 1
        parts = counted.where("n > 1").withColumn("block", F.floor(order / FAN_OUT))
        pieces = stored(_advance(parts.select(id_col, "block", "turn", "key", "moves"), id_col, True))
    ends = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(c).alias("cost"), F.lit(a).alias("audit")) for s, (c, a) in FINISH.items()])
    begun = F.filter("moves", lambda m: m["origin"] == "-")
    ended = F.transform(begun, lambda m: F.struct((m["cost"] + F.element_at(F.filter(ends, lambda e: e["state"] == m["state"]), 1)["cost"]).alias("cost"), F.concat(m["audit"], F.element_at(F.filter(ends, lambda e: e["state"] == m["state"]), 1)["audit"]).alias("audit")))
    return done.select(id_col, F.array_min(ended).alias("least")).select(id_col, "least.cost", "least.audit")


class _Walk:
    """One conversation in the last pass: rows come in order, with the audit known."""

    def __init__(self, header: dict, id_col: str):
        self.row = {id_col: header[id_col]} | {k: header[k] for k in ("blank", "duplicate", "truncated", "cost", "audit")}
        self.at, self.state, self.sum, self.any = 0, "-", hashlib.sha256(), False
        self.turns = self.illegal = 0
        self.least = self.last = self.before = None

    def _line(self, role: str, text: str) -> None:
        self.sum.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def _next(self) -> str:
        self.state = next(r for r in FOLLOW[self.state] if r in ROLE)
        return ROLE[self.state]

    def _inserted(self) -> None:
        audit = self.row["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            self._line(self._next(), "")
            self.at += 1

    def take(self, turn, role: str, text: str, copies: int) -> None:
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.turns, self.last = self.turns + 1, turn
        for _ in range(copies):
            if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = role[:1]
            self._inserted()
            edit = self.row["audit"][self.at]
            self.at += 1
            if edit == "K":
                self.state = role[0]
                self._line(role, text)
            elif edit == "R":
                self._line(self._next(), text)

    def end(self) -> dict:
        self._inserted()
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return self.row | {"gaps": gaps, "illegal": self.illegal, "repaired_sha256": self.sum.hexdigest()}


def repair(damaged: DataFrame, ids: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each of `ids`, a table with the id; rows as
    damage() gives them. Costs and audits are those of the cheapest edits, the hash that of the edited conversation."""
    rows = stored(classified(damaged, id_col))
    sums = rows.groupBy(F.col(id_col).alias("_id")).agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    audits = cheapest(rows, id_col).withColumnRenamed(id_col, "_owner")
    headers = (
        ids.select(id_col)
        .distinct()
        .join(sums, F.col(id_col).eqNullSafe(F.col("_id")), "left")
        .join(audits, F.col(id_col).eqNullSafe(F.col("_owner")), "left")
        .select(
            id_col,
            F.lit(0).alias("is_row"),
            F.lit(None).cast(damaged.schema["turn"].dataType).alias("turn"),
            F.lit(None).cast("binary").alias("key"),
            F.lit(None).cast("string").alias("role"),
            F.lit(None).cast("string").alias("text"),
            *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "cost")],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.lit(0).cast("long").alias("copies"),
        )
    )
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    body = damaged.select(
        id_col, F.lit(1).alias("is_row"), "turn", key.alias("key"), "role", "text", *[F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "cost")], F.lit("").alias("audit"), "copies"
    )
    whole = headers.unionByName(body).repartition(id_col).sortWithinPartitions(id_col, "is_row", "turn", "key")
    schema = StructType([damaged.schema[id_col]])
    for f in StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"):
        schema.add(f)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["is_row"]:
                    walk.take(row["turn"], row["role"], row["text"], row["copies"])
                else:
                    if walk:
                        out.append(walk.end())
                    walk = _Walk(row, id_col)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if walk:
            yield pa.RecordBatch.from_pylist([walk.end()], schema=arrow)

    return whole.mapInArrow(run, schema)
