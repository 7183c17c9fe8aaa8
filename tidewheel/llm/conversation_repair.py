"""Conversations with structural faults, repaired by an error-correcting Earley parser (earley.py).

Rows are sorted by conversation and turn over a range partitioning whose last key is a row
number, so that no conversation and no group of equal rows has to fit a task. A conversation
that lies inside a partition and is short is parsed, repaired and hashed where it is: texts
are shuffled once. Long ones and those at the edges of partitions are written as rows and go
on in pieces of bounded size: repeated rows are found by grouping, a piece becomes a letter a
row, the parser reads a conversation's letters backwards and writes its audit forwards piece
by piece, and each piece's texts are repaired by its own task. A SHA-256 has no parallel form,
so a conversation's repaired pieces then pass one task as a stream, a piece at a time; like
the audit, a single value of a letter a row, that is what the result asks for.

Defined results: a null role or text is one space, in the damage's key also a null id or
turn; null ids are one conversation; null turns come first; rows of one turn are ordered by
role and the MD5 of the text, so equal rows are neighbours; repeated rows are duplicates; a
role may be any text, and what counts is its first character; a conversation without rows
has zeros and the hash of nothing; texts are hashed whole; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import earley
from tidewheel.session import table
from tidewheel.storage import cut

SPACES = " \t\n\x0b\f\r"
ROLES = {"u": "user", "a": "assistant"}
#: Rows and bytes of text of a piece, above which a conversation is continued in another.
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 22
#: Rows of an Arrow batch that are worked on at once.
SLICE = 1024
#: Neighbouring role initials that are as they should be.
LEGAL = {"su", "ua", "au"}

MEASURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = ", ".join(f"{m} long" for m in MEASURES) + ", audit string, repaired_sha256 string"
ROW = "place long, piece long, turn long, has_turn boolean, role string, text string, kind string, initial string"


def keyed(rows: DataFrame) -> DataFrame:
    """Adds ``conv``, a text that is null for no id."""
    return rows.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) with faults dealt by a hash of id and turn: dropped, emptied, cut, repeated or mistaken rows."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    role = F.when(fault == 4, "user").otherwise(told("role"))
    copies = F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))
    hurt = keyed(rows).where(fault != 0).select("conv", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    return hurt.select("conv", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def _kind(initial: Column) -> Column:
    """The parser's letter of a row, as far as the row alone decides it."""
    text = F.rtrim("text", F.lit(SPACES))
    whole = F.substring(text, -1, 1).isin(".", "!", "?")
    return F.when(text == "", earley.GONE).when(whole, initial).otherwise(F.upper(initial))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their kinds, in order over a range partitioning."""
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    rows = rows.select("*", _kind(initial).alias("kind"), initial.alias("initial"), F.md5("text").alias("digest"), F.monotonically_increasing_id().alias("number"))
    order = ("conv", "turn", "role", "digest", "number")
    told = ("conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("has_turn"), "role", "text", "kind", "initial")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*told)


class Measures:
    """Counts over the rows of a conversation in order, or over its pieces."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initial = None

    def row(self, turn: int | None, initial: str, kind: str, repeated: bool) -> str:
        """Counts a row; returns its kind once repeats are known."""
        self._meet(turn, turn, turn is not None, initial, initial)
        self.blank += kind == earley.GONE
        self.duplicate += repeated and kind != earley.GONE
        self.truncated += kind.isupper() and not repeated
        return earley.GONE if repeated else kind

    def piece(self, p: dict) -> None:
        """Counts a piece that follows."""
        self._meet(p["low"], p["high"], p["turns"], p["first"], p["last"])
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + p[name])

    def _meet(self, low: int | None, high: int | None, turns: int, first: str, last: str) -> None:
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high
        self.illegal += self.initial is not None and self.initial + first not in LEGAL
        self.initial = last

    def result(self, cost: int) -> dict[str, int]:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost}


def repaired(audit: str, roles: str, rows: list[tuple[str, str]]) -> list[str]:
    """The repaired ``role:text`` lines of rows (role, text)."""
    lines, left = [], iter(rows)
    for letter, role in zip(audit, roles, strict=True):
        own, text = ("", "") if letter == earley.INSERT else next(left)
        if letter != earley.DELETE:
            lines.append(f"{own if letter == earley.KEEP else ROLES[role]}:{text}")
    return lines


def _whole(rows: list[dict]) -> dict:
    """The result of a conversation from all its rows in order."""
    measures, kinds, seen = Measures(), [], set()
    for r in rows:
        said = (r["role"], r["text"])
        kinds.append(measures.row(r["turn"] if r["has_turn"] else None, r["initial"], r["kind"], said in seen))
        seen.add(said)
    cost, audit, roles = earley.repair("".join(kinds))
    lines = repaired(audit, roles, [(r["role"], r["text"]) for r in rows])
    return measures.result(cost) | {"audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def _parsed(schema: pa.Schema, piece_rows: int, piece_bytes: int):
    """Rows in order to results of whole conversations, and to rows with place and piece of those that may go on elsewhere."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        own: list[dict] = []
        size = place = piece = 0
        elsewhere = True  # the first conversation may have begun in another partition

        def rows() -> list[dict]:
            nonlocal place, piece, own, size
            out = [r | {"place": part + place + k, "piece": part + piece} for k, r in enumerate(own)]
            place, piece, own, size = place + len(own), piece + 1, [], 0
            return out

        out: list[dict] = []
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                for r in batch.slice(begin, SLICE).to_pylist():
                    if own and own[-1]["conv"] != r["conv"]:
                        out += rows() if elsewhere else [{"conv": own[-1]["conv"]} | _whole(own)]
                        own, size, elsewhere = [], 0, False
                    elif len(own) >= piece_rows or size >= piece_bytes:
                        elsewhere = True
                        out += rows()
                    own.append(r)
                    size += len(r["text"])
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if own:
            yield pa.RecordBatch.from_pylist(rows(), schema)

    return each


def _groups(rows: Iterator[pa.RecordBatch], *key: str) -> Iterator[list[dict]]:
    """Runs of rows of one key."""
    own: list[dict] = []
    for batch in rows:
        for begin in range(0, batch.num_rows, SLICE):
            for r in batch.slice(begin, SLICE).to_pylist():
                if own and any(own[-1][k] != r[k] for k in key):
                    yield own
                    own = []
                own.append(r)
    if own:
        yield own


def _pieces(rows: DataFrame) -> DataFrame:
    """(conv, piece, kinds, counts ...) from rows of pieces that know whether they are repeated."""
    schema = pa.schema([("conv", pa.string()), ("piece", pa.int64()), ("kinds", pa.string()), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64())] + [(c, pa.int64()) for c in ("turns", "blank", "duplicate", "truncated", "illegal")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches, "conv", "piece"):
            m = Measures()
            kinds = "".join(m.row(r["turn"] if r["has_turn"] else None, r["initial"], r["kind"], r["repeated"]) for r in own)
            counts = {"low": m.low, "high": m.high, "turns": m.turns} | {c: getattr(m, c) for c in ("blank", "duplicate", "truncated", "illegal")}
            yield pa.RecordBatch.from_pylist([{"conv": own[0]["conv"], "piece": own[0]["piece"], "kinds": kinds, "first": own[0]["initial"], "last": own[-1]["initial"]} | counts], schema)

    slim = rows.select("conv", "piece", "place", "turn", "has_turn", "initial", "kind", "repeated")
    ordered = slim.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "place")
    return ordered.mapInArrow(each, "conv string, piece long, kinds string, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long")


def _audits(pieces: DataFrame) -> DataFrame:
    """(conv, piece, audit, roles), and the measures on each conversation's first piece."""
    schema = pa.schema([("conv", pa.string()), ("piece", pa.int64()), ("audit", pa.string()), ("roles", pa.string())] + [(m, pa.int64()) for m in MEASURES])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches, "conv"):
            behind, cost, measures = [earley.END], 0, Measures()
            for p in reversed(own):
                more, front = earley.read(behind[-1], p["kinds"])
                behind.append(front)
                cost += more
            for p in own:
                measures.piece(p)
            found = measures.result(cost + behind.pop()[earley.ROOT])
            item = earley.ROOT
            for k, p in enumerate(own):
                audit, roles, item = earley.write(item, behind.pop(), p["kinds"], k + 1 == len(own))
                yield pa.RecordBatch.from_pylist([{"conv": p["conv"], "piece": p["piece"], "audit": audit, "roles": roles} | (found if k == 0 else {})], schema)

    ordered = pieces.repartition("conv").sortWithinPartitions("conv", "piece")
    return ordered.mapInArrow(each, "conv string, piece long, audit string, roles string, " + ", ".join(f"{m} long" for m in MEASURES))


def _repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, piece, said): each piece's repaired lines, joined; null where none is left."""

    def each(key: tuple, own: pa.Table, audit: pa.Table) -> pa.Table:
        told = audit.to_pylist()[0]
        said = own.sort_by("place").select(["role", "text"]).to_pylist()
        lines = repaired(told["audit"], told["roles"], [(r["role"], r["text"]) for r in said])
        return pa.table({"conv": [told["conv"]], "piece": [told["piece"]], "said": pa.array(["\n".join(lines) if lines else None], pa.string())})

    texts = rows.select("conv", "piece", "place", "role", "text")
    return texts.groupBy("conv", "piece").cogroup(audits.select("conv", "piece", "audit", "roles").groupBy("conv", "piece")).applyInArrow(each, "conv string, piece long, said string")


def _hashed(pieces: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256, measures) from pieces (conv, piece, said, audit, measures)."""
    schema = pa.schema([("conv", pa.string())] + [(m, pa.int64()) for m in MEASURES] + [("audit", pa.string()), ("repaired_sha256", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = None
        for batch in batches:
            for k in range(batch.num_rows):
                p = batch.slice(k, 1).to_pylist()[0]
                if p["conv"] != conv:
                    if conv is not None:
                        yield pa.RecordBatch.from_pylist([told | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)
                    conv, audit, digest, any_ = p["conv"], [], hashlib.sha256(), False
                    told = {c: p[c] for c in ("conv", *MEASURES)}
                audit.append(p["audit"])
                if p["said"] is not None:
                    digest.update(("\n" if any_ else "").encode() + p["said"].encode())
                    any_ = True
        if conv is not None:
            yield pa.RecordBatch.from_pylist([told | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

    ordered = pieces.repartition("conv").sortWithinPartitions("conv", "piece")
    return ordered.mapInArrow(each, f"conv string, {RESULT}")


def repairs(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(conv, measures, audit, repaired_sha256) of the conversations in rows (conv, turn, role, text)."""
    names = [pa.field("conv", pa.string())] + [(m, pa.int64()) for m in MEASURES] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
    names += [("place", pa.int64()), ("piece", pa.int64()), ("turn", pa.int64()), ("has_turn", pa.bool_())] + [(c, pa.string()) for c in ("role", "text", "kind", "initial")]
    parsed = cut(_placed(rows).mapInArrow(_parsed(pa.schema(names), piece_rows, piece_bytes), f"conv string, {RESULT}, {ROW}"), "parsed")
    done = parsed.where("piece is null").select("conv", *MEASURES, "audit", "repaired_sha256")
    going = parsed.where("piece is not null").select("conv", "place", "piece", "turn", "has_turn", "role", "text", "kind", "initial")
    if going.isEmpty():
        return done
    # Equal rows meet in partial minima only; the first of them is known by its place, which no other row has.
    said = F.unhex(F.sha2("text", 256))
    first = going.groupBy("conv", "role", said.alias("said")).agg(F.min("place").alias("place")).select("place", F.lit(False).alias("repeated"))
    flagged = going.drop("text").join(first.hint("shuffle_hash"), "place", "left").withColumn("repeated", F.coalesce("repeated", F.lit(True)))
    audits = cut(_audits(_pieces(flagged)), "audits")
    pieces = audits.drop("roles").join(_repaired(going, audits), ["conv", "piece"])
    return done.unionByName(_hashed(pieces).select(done.columns))


def repaired_conversations(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The results ``found`` for every conversation of rows (conv_id, ...), also those without any row left."""
    kind = rows.schema["conv_id"].dataType
    every = keyed(rows).select("conv").distinct().join(found, "conv", "left")
    numbers = [F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES]
    conv_id = F.when(F.col("conv") != "", F.substring("conv", 2, (1 << 31) - 1)).cast(kind).alias("conv_id")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every.select(conv_id, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its hash of every conversation, after damage."""
    rows = table(spark, sf_dir, "conversations")
    return repaired_conversations(rows, repairs(damaged(rows)))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLE_SQL = {
    "op13_conversation_repair": r"""
    WITH RECURSIVE given AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
        FROM conversations),
    dealt AS (
        SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
            lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(j AS BIGINT) FOR j IN range(8)]),
                lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS fault
        FROM given),
    hurt AS (
        SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
               CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM dealt WHERE fault <> 0),
    put AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
        FROM hurt),
    known AS (
        SELECT *, left(role, 1) AS i,
               CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
               lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS then_
        FROM put),
    counts AS (
        SELECT conv_id, max(n) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (then_ IS NOT NULL AND i || then_ NOT IN ('su', 'ua', 'au')) AS illegal
        FROM known GROUP BY conv_id),
    -- The cheapest end (cost, audit) from each state: f0 with nothing yet, f1 after system, f2 after user, f3 after assistant.
    back AS (
        SELECT conv_id, rows_ + 1 AS n, {c: 0, a: ''} AS f0, {c: 10, a: 'II'} AS f1, {c: 5, a: 'I'} AS f2, {c: 0, a: ''} AS f3 FROM counts
        UNION ALL
        SELECT conv_id, n, list_sort([g0, {c: f2.c + 5, a: 'I' || f2.a}])[1], list_sort([g1, {c: f2.c + 5, a: 'I' || f2.a}])[1], f2, f3
        FROM (
            SELECT conv_id, n, g0, g1, list_sort([g2, {c: g3.c + 5, a: 'I' || g3.a}])[1] AS f2, list_sort([g3, {c: g2.c + 5, a: 'I' || g2.a}])[1] AS f3
            FROM (
                SELECT conv_id, n,
                       list_sort([{c: f0.c + 2, a: 'D' || f0.a}, {c: f2.c + u, a: ku || f2.a}, {c: f1.c + s, a: 'K' || f1.a}])[1] AS g0,
                       list_sort([{c: f1.c + 2, a: 'D' || f1.a}, {c: f2.c + u, a: ku || f2.a}])[1] AS g1,
                       list_sort([{c: f2.c + 2, a: 'D' || f2.a}, {c: f3.c + a, a: ka || f3.a}])[1] AS g2,
                       list_sort([{c: f3.c + 2, a: 'D' || f3.a}, {c: f2.c + u, a: ku || f2.a}])[1] AS g3
                FROM (
                    SELECT b.conv_id, k.n, f0, f1, f2, f3,
                           CASE WHEN i = 'u' THEN 'K' ELSE 'R' END AS ku, CASE WHEN i = 'a' THEN 'K' ELSE 'R' END AS ka,
                           stays + CASE WHEN i = 'u' THEN 0 ELSE 1 END AS u, stays + CASE WHEN i = 'a' THEN 0 ELSE 1 END AS a,
                           CASE WHEN i = 's' THEN stays ELSE 1000000000 END AS s
                    FROM back b JOIN (
                        SELECT *, CASE fault WHEN 'blank' THEN 1000000000 WHEN 'duplicate' THEN 1000000000 WHEN 'truncated' THEN 5 ELSE 0 END AS stays FROM known) k
                      ON k.conv_id IS NOT DISTINCT FROM b.conv_id AND k.n = b.n - 1)))),
    best AS (SELECT conv_id, CAST(f0.c AS BIGINT) AS cost, f0.a AS audit FROM back WHERE n = 1),
    letters AS (
        SELECT conv_id, p, letter, sum(CAST(letter <> 'I' AS INTEGER)) OVER w AS n, sum(CAST(letter <> 'D' AS INTEGER)) OVER w AS nth
        FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p, unnest(string_split(audit, '')) AS letter FROM best)
        WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
    lines AS (
        SELECT l.conv_id, p, letter, nth, role, text,
               max(CAST(letter = 'K' AND nth = 1 AND i = 's' AS INTEGER)) OVER (PARTITION BY l.conv_id) AS opened
        FROM letters l LEFT JOIN known k ON k.conv_id IS NOT DISTINCT FROM l.conv_id AND k.n = l.n AND letter <> 'I'),
    said AS (
        SELECT conv_id,
               string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS said
        FROM lines WHERE letter <> 'D' GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM o.conv_id"""
}
