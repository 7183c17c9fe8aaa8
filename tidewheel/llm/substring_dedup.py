"""Exact removal of repeated passages: windows of 35 words that occur more than once.

First pass. Every window is represented by its anchor, the 20-word run in it with the
smallest hash (the leftmost of equals). Equal windows have equal anchors at equal
places, so an anchor occurs at least as often as any window it stands for, and far
fewer anchors than windows need counting. Each task sketches the anchors it meets: it
counts them by cells, numbers that hashes give, and sends the cells met, with their counts,
to where the sketches are merged by sums, cell by cell. So counts are never too low, and
too high only where anchors share a cell. The merged sketch has a cell for every byte of
text, some fifty an anchor, and lies over the tasks of a shuffle; nothing of it is broadcast.
One row of cells takes the place of several with fewer each. What comes back to a text are
the places of its anchors in cells that count more than one. However often a cell occurs,
it sends one row for each 2**18 anchors a task meets.

Second pass. Only windows whose anchor is estimated repeated go on. Windows met twice
within a task's piece of rows are known to be repeated at once: all but the first go on as
spans of neighbouring windows; of the others one row a piece goes to an exact grouping by a 96-bit hash of the window, so a window that
a third of all documents share gives a row for each piece, not for each document.
None is lost: what the sketch passes by occurs once.

A window has no more rows than there are pieces, and no more than the sketch counts of its
anchor. Where both may be over HOT (beyond some 270 GB of text, and for a line such as a
licence's), windows are counted by partial sums instead, and the repeated ones joined back
by salt; their cells, a million at most, are broadcast. All others a task can hold.

Last, each text's repeated windows meet the documents of that text, and words they cover
are removed. Texts are known by 96 bits of two hashes, so neither null nor shared doc_ids
confuse them.

Defined results: a null text has no words; fewer words than a window are all kept;
repeated rows repeat each other's windows and are each reduced; null and shared doc_ids
work like any other; very long texts are worked on whole, one at a time; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.session import table
from tidewheel.storage import cut

WINDOW = 35
ANCHOR = 20
#: Cells of the sketch, at least and at most.
CELLS = (1 << 16, 1 << 62)
#: Words worked on at once by a task, and anchors sketched at once.
PIECE, SKETCHED = 1 << 17, 1 << 18

#: Rows of a window above which it is counted by partial sums, and salts of their join. A cell counts also over
#: 2**-HOT_SHARE of the bytes to be hot: as an anchor takes two bytes at least, hot cells are a million at most.
HOT, SALTS, HOT_SHARE = 1 << 20, 64, 21

#: Neighbouring windows in one row, at most; a span is place * SPAN + windows - 1, and starts no text's set over SPAN times its words.
SPAN = 64

#: Bases of the two run hashes: any odd numbers.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every bit of x over the word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of each run of ``length`` word hashes: a polynomial modulo 2**64 by prefix sums, mixed."""
    n = len(words) - length + 1
    if n < 1:
        return np.empty(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    up = np.cumprod(np.r_[np.uint64(1), np.full(len(words), base, np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(len(words), inverse, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(words * down[:-1], dtype=np.uint64)]
    return _mixed((sums[length:] - sums[:n]) * up[:n])


class Piece:
    """The windows of some whole documents: their places, anchors and, if asked for, hashes."""

    def __init__(self, docs: list[list[bytes]], window: int, anchor: int):
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        self.words = np.fromiter((xxhash.xxh3_64_intdigest(w) for d in docs for w in d), np.uint64, int(lengths.sum()))
        self.window, self.begins = window, np.cumsum(lengths) - lengths
        n = max(len(self.words) - window + 1, 0)
        self.doc = np.repeat(np.arange(len(docs)), lengths)
        #: Starts, in the piece, of the windows that lie within one document.
        self.at = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :]) if n else np.empty(0, np.int64)
        runs = run_hashes(self.words, anchor, BASES[0])
        least, choice = runs[:n].copy(), np.zeros(n, np.int64)
        for step in range(1, window - anchor + 1):
            lower = runs[step : n + step] < least
            least[lower] = runs[step : n + step][lower]
            choice[lower] = step
        #: Where each window's anchor starts, in the piece; never falls from one window to the next.
        self.anchor_at = self.at + choice[self.at]
        self.runs = runs

    def anchor_places(self) -> np.ndarray:
        """Where anchors start, in the piece, each once."""
        at = self.anchor_at
        return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at

    def hashes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(run_hashes(self.words, self.window, base)[self.at[chosen]] for base in BASES)


def _pieces(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[tuple[pa.RecordBatch, int, Piece]]:
    """(batch, first row, piece): whole documents of about PIECE words together."""
    for batch in batches:
        texts, docs, words, first = batch.column("text").cast(pa.binary()), [], 0, 0
        for i, text in enumerate(texts):
            docs.append((text.as_py() or b"").split())
            words += len(docs[-1])
            if words >= PIECE or i + 1 == len(texts):
                piece = Piece(docs, window, anchor)
                docs, words = [], 0
                yield batch, first, piece
                first = i + 1


def cells_for(n_bytes: int) -> int:
    """Cells of the sketch for so many bytes of text: one a byte at least, fifty an anchor or so."""
    return min(max(1 << n_bytes.bit_length(), CELLS[0]), CELLS[1])


def _cells(anchors: np.ndarray, cells: int) -> np.ndarray:
    return _mixed(anchors) & np.uint64(cells - 1)


def _first(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether it is the first of its equals, and how many of them there are."""
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order][1:] != keys[order][:-1]] if len(keys) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    first, count = np.empty(len(keys), bool), np.empty(len(keys), np.int64)
    first[order], count[order] = new, np.bincount(group)[group] if len(keys) else group
    return first, count


def sketch(docs: DataFrame, cells: int, window: int, anchor: int, hot: int | None) -> tuple[DataFrame, np.ndarray]:
    """(text_key, text_hash, anchors): the places in each text of anchors whose cell counts more than one;
    and, in order, the cells that count more than ``hot``, if that is given.

    Texts without such an anchor have no row. The table of anchors is written, so counts are made once.
    """
    names = ["cell", "text_key", "text_hash", "at", "n"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[tuple]) -> pa.RecordBatch:
            cell, key, short, at = (np.concatenate(column) for column in zip(*held, strict=True))
            new, count = _first(cell)
            # Later anchors of a cell are known to repeat and not counted again: they go where
            # a hash of their own leads, and are told apart by a null.
            return pa.record_batch(
                [
                    pa.array(np.where(new, cell, _mixed(cell + at.astype(np.uint64) + np.uint64(1))).view(np.int64)),
                    pa.array(key),
                    pa.array(short),
                    pa.array(at),
                    pa.array(count.astype(np.int32), mask=~new),
                ],
                names,
            )

        held, size = [], 0
        for batch, first, piece in _pieces(batches, window, anchor):
            at = piece.anchor_places()
            doc = piece.doc[at]
            key, short = (batch.column(name).to_numpy(zero_copy_only=False)[first + doc] for name in ("text_key", "text_hash"))
            held.append((_cells(piece.runs[at], cells), key, short, (at - piece.begins[doc]).astype(np.int32)))
            size += len(at)
            if size >= SKETCHED:
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    met = _hashed(docs).drop("doc_id").mapInArrow(partial, "cell long, text_key long, text_hash int, at int, n int")
    counted = met.withColumn("total", F.sum("n").over(Window.partitionBy("cell")))
    is_hot = F.lit(False) if hot is None else F.col("total") > hot
    told = counted.where("n is null or total > 1").withColumn("hot", F.when(is_hot, F.col("cell")))
    told = cut(told.select("text_key", "text_hash", "at", "hot"), "anchors")
    cells_ = [] if hot is None else [r["hot"] for r in told.where("hot is not null").select("hot").distinct().collect()]
    places = told.groupBy("text_key", "text_hash").agg(F.collect_set("at").alias("anchors"))  # no more than the text has words
    return places, np.sort(np.array(cells_, np.int64).view(np.uint64))


def suspects(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, cells: int | None = None, hot: int = HOT) -> tuple[DataFrame, bool]:
    """The windows that the sketch estimates repeated: (one, two, text_key, text_hash, span, known, hot); and whether any is hot.

    One row a window, but for later ones of a piece's equal windows: these have no two, and neighbours share a row.
    """
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = cells or cells_for(n_bytes)
    pieces = n_bytes // (2 * PIECE)  # at most, as a word takes two bytes; batches that end early aside
    asked, often = sketch(docs, cells, window, anchor, max(hot, n_bytes >> HOT_SHARE) if pieces > hot else None)
    sent = docs.sparkSession.sparkContext.broadcast(often)
    # With doc_id, which nothing reads here, the texts are shuffled once for this join and the last one.
    source = _hashed(docs).join(asked.hint("shuffle_hash"), ["text_key", "text_hash"]).select("doc_id", "text", "text_key", "text_hash", "anchors")

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, piece in _pieces(batches, window, anchor):
            marked = np.zeros(len(piece.words), bool)
            for i, begin in enumerate(piece.begins):
                marked[begin + batch.column("anchors")[first + i].values.to_numpy()] = True
            chosen = np.flatnonzero(marked[piece.anchor_at])
            is_hot = np.isin(_cells(piece.runs[piece.anchor_at[chosen]], cells), sent.value)
            one, two = piece.hashes(chosen)
            order = np.lexsort((two, one))
            one, two, at, is_hot = one[order], two[order], piece.at[chosen][order], is_hot[order]
            new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.empty(0, bool)
            group = np.cumsum(new) - 1
            twice = (np.bincount(group) > 1)[group] if len(group) else new
            doc = piece.doc[at]
            # Later members of a group that is known to repeat need no grouping: they go
            # where a hash of their own leads, and are told apart by a null.
            turn = np.arange(len(at)) - np.flatnonzero(new)[group] if len(at) else at
            one = np.where(new, one, _mixed(one + turn.astype(np.uint64)))
            # In the order of places a task's rows compress well, and neighbours among later members make spans.
            order = np.argsort(at, kind="stable")
            at, doc, new, is_hot = at[order], doc[order], new[order], is_hot[order]
            place = at - piece.begins[doc]
            joins = ~new[1:] & ~new[:-1] & (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1]) & (is_hot[1:] == is_hot[:-1]) & (place[1:] % SPAN > 0)
            first_of = np.flatnonzero(np.r_[True, ~joins]) if len(at) else np.empty(0, np.int64)
            n_windows = np.diff(np.r_[first_of, len(at)])
            order = order[first_of]
            row = pa.array(first + doc[first_of])
            yield pa.record_batch(
                [
                    pa.array(one[order].view(np.int64)),
                    pa.array(two[order].view(np.int64).astype(np.int32), mask=~new[first_of]),
                    batch.column("text_key").take(row),
                    batch.column("text_hash").take(row),
                    pa.array(place[first_of] * SPAN + n_windows - 1),
                    pa.array(twice[order]),
                    pa.array(is_hot[first_of]),
                ],
                ["one", "two", "text_key", "text_hash", "span", "known", "hot"],
            )

    return source.mapInArrow(suspected, "one long, two int, text_key long, text_hash int, span long, known boolean, hot boolean"), len(often) > 0


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, cells: int | None = None, hot: int = HOT) -> DataFrame:
    """(text_key, text_hash, span) of every window that starts anywhere else as well: span // SPAN is the place of the first
    window of a span, in words from 0, and span % SPAN the number of windows that follow it."""
    found, any_hot = suspects(docs, window, anchor, cells, hot)
    names = ["text_key", "text_hash", "span"]
    # At most one row a piece of a task has any given hash.
    counted = found.where("not hot").drop("hot") if any_hot else found.drop("hot")
    counted = counted.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("one", "two")))
    usual = counted.where("known or n > 1 and two is not null").select(*names)
    return usual.union(_hot(found.where("hot").drop("hot")).select(*names)) if any_hot else usual


def _hot(found: DataFrame) -> DataFrame:
    """The rows of windows that repeat, of windows that may have very many rows each."""
    found = cut(found, "hot")
    again = found.where("two is not null").groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = found.where("not known").withColumn("salt", F.pmod(F.xxhash64("text_key", "span"), F.lit(SALTS)).cast("int"))
    joined = salted.join(again.withColumn("salt", every), ["one", "two", "salt"], "left_semi")
    return found.where("known").unionByName(joined.drop("salt"))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.hash("text").alias("text_hash"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, cells: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, text, n_words, n_removed): the words no repeated window covers, joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = (
        repeated_windows(docs, window, anchor, cells, hot)
        .groupBy("text_key", "text_hash")
        .agg(F.collect_set("span").alias("spans"))  # no more than SPAN times the text's words
    )

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone = [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True):
                words = (text.as_py() or b"").split()
                total.append(len(words))
                if spans.is_valid:
                    starts, more = np.divmod(spans.values.to_numpy(), SPAN)
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + more + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                ["doc_id", "text", "n_words", "n_removed"],
            )

    joined = _hashed(docs).join(spans.hint("shuffle_hash"), ["text_key", "text_hash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(strip, f"doc_id {kind}, text string, n_words long, n_removed long")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated windows."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
