"""Row patterns: sequences of rows of a key that match an expression over row conditions.

A pattern is put together from sym, seq, alt and rep, and becomes an automaton whose states
list what they accept in order of preference (greedy or reluctant, first alternative first).
The match at a row is the preferred one, as a backtracking matcher would find it, but found by
going through the rows backwards once: a state's match ends where the first of its choices
has one.

No key is held by one task. Rows are sorted over a range partitioning and cut into pieces of
at most PIECE rows, in which a row is the set of its conditions. A piece's states are first
resolved up to its end, as lists of states to try behind it; one row a piece and key then
passes a task, which resolves them from the last piece to the first; pieces find their
matches knowing what lies behind; and for matches that must not overlap one row a piece says
where the next one may begin.

Defined results: keys may be null (null is a key); a condition that is null is not met; rows
equal in the order are taken as they come; matches of no row are not reported; an empty table
gives an empty table; columns of any name stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.session import table
from tidewheel.storage import cut

#: Rows of a piece, as a power of two.
PIECE_BITS = 12

Pattern = tuple


def sym(name: str) -> Pattern:
    """A row that meets the condition of this name."""
    return ("sym", name)


def seq(*parts: Pattern | str) -> Pattern:
    """Parts one after the other."""
    return ("seq", *map(_pattern, parts))


def alt(*parts: Pattern | str) -> Pattern:
    """One of the parts, the first if it can be."""
    return ("alt", *map(_pattern, parts))


def rep(part: Pattern | str, least: int = 1, most: int | None = None, greedy: bool = True) -> Pattern:
    """A part from least to most times (None: any number), as often or as seldom as can be."""
    return ("rep", _pattern(part), least, most, greedy)


def _pattern(part: Pattern | str) -> Pattern:
    return sym(part) if isinstance(part, str) else part


class Automaton:
    """choices[state]: what a state can do, preferred first: (condition's number, next state), or None to end the match."""

    def __init__(self, pattern: Pattern | str, names: list[str]):
        self.steps: list[tuple] = []
        self._add(_pattern(pattern), names)
        self.steps.append(("end",))
        entries = [0] + [k + 1 for k, s in enumerate(self.steps) if s[0] == "row"]
        number = {at: k for k, at in enumerate(entries)}
        self.choices = [[None if self.steps[at][0] == "end" else (self.steps[at][1], number[at + 1]) for at in self._reached(entry)] for entry in entries]

    def _add(self, p: Pattern, names: list[str]) -> None:
        kind, steps = p[0], self.steps
        if kind == "sym":
            steps.append(("row", names.index(p[1])))
        elif kind == "seq":
            for part in p[1:]:
                self._add(part, names)
        elif kind == "alt":
            leave = []
            for k, part in enumerate(p[1:], 1):
                if k < len(p) - 1:
                    fork = len(steps)
                    steps.append(())
                    self._add(part, names)
                    leave.append(len(steps))
                    steps.append(())
                    steps[fork] = ("go", fork + 1, len(steps))
                else:
                    self._add(part, names)
            for at in leave:
                steps[at] = ("go", len(steps))
        else:
            _, part, least, most, greedy = p
            for _ in range(least):
                self._add(part, names)
            forks = []
            for _ in range(1 if most is None else most - least):
                forks.append(len(steps))
                steps.append(())
                self._add(part, names)
                if most is None:
                    steps.append(("go", forks[0]))
            for at in forks:
                steps[at] = ("go", *((at + 1, len(steps)) if greedy else (len(steps), at + 1)))

    def _reached(self, entry: int) -> list[int]:
        """Row and end steps reached from a step without a row, preferred first."""
        seen, out, stack = set(), [], [entry]
        while stack:
            at = stack.pop()
            if at in seen:
                continue
            seen.add(at)
            if self.steps[at][0] == "go":
                stack += reversed(self.steps[at][1:])
            else:
                out.append(at)
        return out


#: A match's end is the place of its last row; behind a piece's end, a state is told as -2 - state.
NONE = -1


def _behind(state: int) -> int:
    return -2 - state


def unresolved(choices: list[list], masks: np.ndarray, first: int) -> list[list[int]]:
    """For each state in front of a piece, what to try in turn: states behind it, and at last an end inside it."""
    after = [[_behind(s)] for s in range(len(choices))]
    for k in range(len(masks) - 1, -1, -1):
        mask, now = masks[k], []
        for options in choices:
            tries: list[int] = []
            for option in options:
                if option is None:
                    tries.append(first + k - 1)
                elif mask >> option[0] & 1:
                    tries += [t for t in after[option[1]] if t not in tries]
                if tries and tries[-1] >= 0:
                    break
            now.append(tries)
        after = now
    return after


def ends(choices: list[list], masks: np.ndarray, first: int, behind: list[int]) -> list[list[int]]:
    """[row, state]: the place of the last row of the preferred match from there, NONE for none; one row more for the piece's end."""
    found = [behind]
    for k in range(len(masks) - 1, -1, -1):
        mask, after, now = masks[k], found[-1], []
        for options in choices:
            end = NONE
            for option in options:
                end = first + k - 1 if option is None else after[option[1]] if mask >> option[0] & 1 else NONE
                if end != NONE:
                    break
            now.append(end)
        found.append(now)
    return found[::-1]


def path(choices: list[list], masks: np.ndarray, found: list[list[int]], row: int, state: int) -> Iterator[tuple[int, int, int]]:
    """(row, condition, next state) of the rows that a match goes through in this piece, from a row and state."""
    while row < len(masks):
        for option in choices[state]:
            if option is None:
                return
            if masks[row] >> option[0] & 1 and found[row + 1][option[1]] != NONE:
                yield row, option[0], option[1]
                state = option[1]
                break
        row += 1


def _walk(choices: list[list], masks: np.ndarray, first: int, found: list[list[int]], free: int) -> Iterator[tuple[int, int]]:
    """(row, end) of the matches that do not overlap, the first one behind the place ``free``."""
    k = max(0, free + 1 - first)
    while k < len(masks):
        end = found[k][0]
        if end >= first + k:
            yield k, end
            k = end + 1 - first
        else:
            k += 1


def _grouped(batches: Iterator[pd.DataFrame], keep) -> Iterator[pd.DataFrame]:
    """Rows in order through keep(row, is the key's first); what it returns are rows."""
    last = None
    for batch in batches:
        out = []
        for row in batch.to_dict("records"):
            out.append(keep(row, row["key_"] != last))
            last = row["key_"]
        if out:
            yield pd.DataFrame(out)


class Matcher:
    """Rows of ``df`` by keys and order, with conditions by name, in pieces."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], conditions: dict[str, Column], pattern: Pattern | str, piece_bits: int = PIECE_BITS):
        self.names = list(conditions)
        choices = self.choices = Automaton(pattern, self.names).choices
        mask = sum((F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(conditions.values())), F.lit(0)).cast("long")
        told = F.concat_ws("/", *(F.coalesce(F.concat(F.lit("="), F.hex(F.col(k).cast("string"))), F.lit("null")) for k in keys), F.lit(""))
        sorted_ = df.select(told.alias("key_"), mask.alias("mask_"), F.struct(*df.columns).alias("row_"))
        by = ["key_", *(f"row_.{c}" for c in order)]
        placed = sorted_.repartitionByRange(*by).sortWithinPartitions(*by)
        # Places count up through the partitions and inside them, so those of a key's rows in one partition follow each other.
        self.placed = cut(placed.withColumn("place_", F.monotonically_increasing_id()), "placed")
        piece = F.shiftright("place_", piece_bits).alias("piece_")
        rows = F.sort_array(F.collect_list(F.struct("place_", "mask_")))  # 2 ** piece_bits at most
        pieces = self.placed.groupBy("key_", piece).agg(rows.alias("rows_"))
        self.pieces = cut(pieces.select("key_", "piece_", F.col("rows_")[0]["place_"].alias("first_"), F.col("rows_.mask_").alias("masks_")), "pieces")
        start = lambda row: unresolved(choices, row["masks_"], row["first_"])
        shape = "key_ string, piece_ long, first_ long, last_ long"

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                last = b["first_"] + b["masks_"].map(len) - 1
                yield b[["key_", "piece_", "first_"]].assign(last_=last, front_=[start(r) for r in b.to_dict("records")])

        backwards = self.pieces.mapInPandas(summed, f"{shape}, front_ array<array<long>>").repartition("key_").sortWithinPartitions("key_", F.desc("piece_"))

        def resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            front: list[int] = []
            first = 0

            def keep(row: dict, new: bool) -> dict:
                nonlocal front, first
                # An end in front of the next piece's first row is this piece's last, whose place may be an earlier one, of another partition.
                behind = [row["last_"] if None in options else NONE for options in choices] if new else [row["last_"] if NONE < e < first else e for e in front]
                front = [next((e for e in (t if t >= 0 else behind[-2 - t] for t in tries) if e != NONE), NONE) for tries in row["front_"]]
                first = row["first_"]
                return {c: row[c] for c in ("key_", "piece_", "first_", "last_")} | {"behind_": behind, "front_": front}

            yield from _grouped(batches, keep)

        known = backwards.mapInPandas(resolved, f"{shape}, behind_ array<long>, front_ array<long>")
        self.known = cut(known.join(self.pieces.select("key_", "piece_", "masks_"), ["key_", "piece_"]), "known")

    def every(self) -> DataFrame:
        """Matches at every row that has one (skip to the next row): (the first row's columns, n_rows)."""
        choices = self.choices

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.to_dict("records"):
                    found = np.array([s[0] for s in ends(choices, r["masks_"], r["first_"], list(r["behind_"]))[:-1]], np.int64)
                    at = np.flatnonzero(found >= r["first_"] + np.arange(len(found)))
                    yield pd.DataFrame({"key_": r["key_"], "place_": r["first_"] + at, "end_": found[at]})

        found = self.known.mapInPandas(each, "key_ string, place_ long, end_ long")
        # Rows between two places: those of the pieces between, which a key's rows fill without gaps but for changes of partition.
        counted = found.withColumn("n_rows", F.col("end_") - F.col("place_") + 1)
        same = F.shiftright("place_", 33) == F.shiftright("end_", 33)
        if counted.where(~same).isEmpty():
            return self._rows(counted.select("place_", "n_rows"))
        return self._rows(counted.where(same).select("place_", "n_rows").union(self._across(found.where(~same))))

    def _across(self, found: DataFrame) -> DataFrame:
        """(place_, n_rows) of matches that go on in other partitions, by each key's running count of rows at its pieces."""
        sizes = self.pieces.select("key_", "first_", F.size("masks_").alias("n_"), "piece_")
        parts = sizes.groupBy("key_", F.shiftright("first_", 33).alias("part_")).agg(F.min("first_").alias("first_"), F.sum("n_").alias("n_"))
        between = found.join(parts, "key_").where((F.col("part_") >= F.shiftright("place_", 33)) & (F.col("part_") <= F.shiftright("end_", 33)))
        begin, end = F.greatest("first_", "place_"), F.least(F.col("first_") + F.col("n_") - 1, F.col("end_"))
        return between.groupBy("place_").agg(F.sum(F.greatest(end - begin + 1, F.lit(0))).alias("n_rows"))

    def apart(self) -> DataFrame:
        """Rows of matches that do not overlap (skip past the last row): (the row's columns, match, symbol).

        match is the place of the match's first row, a number that no other match has.
        """
        choices, names = self.choices, self.names

        def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.to_dict("records"):
                    masks, first, last = r["masks_"], r["first_"], r["last_"]
                    found = ends(choices, masks, first, list(r["behind_"]))
                    # Where the next match may begin: at the first row, or behind a match that began before the piece and ends in it.
                    entries = {first - 1} | {e for e in r["front_"] if first <= e < last}
                    ways = []
                    for free in sorted(entries):
                        k, end = None, free
                        for k, end in _walk(choices, masks, first, found, free):
                            pass
                        over = k is not None and end > last
                        state = [s for *_, s in path(choices, masks, found, k, 0)][-1] if over else -1
                        ways.append((free, end if over else last, first + k if over else -1, state))
                    through = [next((s for *_, s in reversed(list(path(choices, masks, found, 0, s)))), s) if e > last else -1 for s, e in enumerate(r["front_"])]
                    out.append({c: r[c] for c in ("key_", "piece_", "first_", "last_")} | {"ways_": ways, "through_": through})
                yield pd.DataFrame(out)

        shape = "key_ string, piece_ long, first_ long, last_ long"
        going = self.known.mapInPandas(exits, f"{shape}, ways_ array<struct<free:long,end:long,start:long,state:int>>, through_ array<int>")
        forwards = going.repartition("key_").sortWithinPartitions("key_", "piece_")

        def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            free, start, state = NONE, -1, -1

            def keep(row: dict, new: bool) -> dict:
                nonlocal free, start, state
                if new:
                    free, start, state = NONE, -1, -1
                out = {"key_": row["key_"], "piece_": row["piece_"], "free_": free, "start_": start, "state_": state}
                if free > row["last_"]:
                    state = int(row["through_"][state])
                elif free == row["last_"]:
                    start = state = -1
                else:
                    entry = free if free >= row["first_"] else row["first_"] - 1
                    way = next(w for w in row["ways_"] if w["free"] == entry)
                    free, start, state = way["end"], way["start"], way["state"]
                return out

            yield from _grouped(batches, keep)

        entered = forwards.mapInPandas(chained, "key_ string, piece_ long, free_ long, start_ long, state_ int")

        def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.to_dict("records"):
                    masks, first = r["masks_"], r["first_"]
                    found = ends(choices, masks, first, list(r["behind_"]))
                    rows = [(first + k, r["start_"], names[s]) for k, s, _ in path(choices, masks, found, 0, r["state_"])] if r["start_"] >= 0 else []
                    for k, _ in _walk(choices, masks, first, found, max(r["free_"], first - 1)):
                        rows += [(first + j, first + k, names[s]) for j, s, _ in path(choices, masks, found, k, 0)]
                    yield pd.DataFrame(rows, columns=["place_", "match", "symbol"])

        found = self.known.join(entered, ["key_", "piece_"]).mapInPandas(labelled, "place_ long, match long, symbol string")
        return self._rows(found)

    def _rows(self, found: DataFrame) -> DataFrame:
        return self.placed.select("place_", "row_").join(found, "place_").select("row_.*", *[c for c in found.columns if c != "place_"])


def click_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' purchases right after a view and clicks: view click+ purchase, matches apart, their rows as measures."""
    events = table(spark, sf_dir, "events")
    kind = {name: F.col("event_type") == name for name in ("view", "click", "purchase")}
    rows = Matcher(events, ["user_id"], ["ts", "event_id"], kind, seq("view", rep("click"), "purchase")).apart()
    of = lambda name, c: F.max(F.when(F.col("symbol") == name, F.col(c)))
    clicks = F.count_if(F.col("symbol") == "click").alias("clicks")
    return rows.groupBy("user_id", "match").agg(of("view", "event_id").alias("view_id"), of("purchase", "event_id").alias("purchase_id"), clicks, of("purchase", "value").alias("value")).drop("match")


def soon_bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sign-up or error with the nearest purchase of the user one to three events later: (signup | error) any{1,3}? purchase, matches at every row."""
    events = table(spark, sf_dir, "events")
    conditions = {name: F.col("event_type") == name for name in ("signup", "error", "purchase")} | {"any": F.lit(True)}
    pattern = seq(alt("signup", "error"), rep("any", 1, 3, greedy=False), "purchase")
    return Matcher(events, ["user_id"], ["ts", "event_id"], conditions, pattern).every().select("user_id", "event_id", "n_rows")


QUERIES = {f"pattern_{f.__name__}": f for f in (click_runs, soon_bought)}
ORACLE_SQL = {
    "pattern_click_runs": """
        WITH e AS (SELECT *, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        b AS (SELECT *, max(CASE WHEN event_type <> 'click' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM e)
        SELECT b.user_id, s.event_id AS view_id, b.event_id AS purchase_id, b.n - b.v - 1 AS clicks, b.value
        FROM b JOIN e s ON s.user_id = b.user_id AND s.n = b.v AND s.event_type = 'view'
        WHERE b.event_type = 'purchase' AND b.n - b.v >= 2""",
    "pattern_soon_bought": """
        WITH e AS (
            SELECT *, lead(event_type, 2) OVER w AS a, lead(event_type, 3) OVER w AS b, lead(event_type, 4) OVER w AS c
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, event_id, CASE WHEN a = 'purchase' THEN 3 WHEN b = 'purchase' THEN 4 ELSE 5 END AS n_rows FROM e
        WHERE event_type IN ('signup', 'error') AND 'purchase' IN (a, b, c)""",
}
