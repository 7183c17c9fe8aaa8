"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces. Each language has a probability for every
piece; the probability of a word is the sum, over all ways to cut it into pieces, of
the product of their probabilities, which a forward algorithm computes. A text's
probability is the product over its words, and Bayes' rule with the languages' shares
among the training rows gives the answer.

The piece probabilities are fitted by expectation maximisation with the matching
backward pass. They are fitted on a bounded sample of labelled rows: at most
``max_rows`` different texts of each language, those of the smallest hashes, so neither
ids nor copies let more in. Prediction is a map over
whole texts without any shuffle; each task scores a distinct word once, words of one
length together in numpy.

Text is lower-cased, and ASCII characters other than letters separate words. Words are
scored whole, however long: the forward algorithm keeps only the positions that a piece
can still begin at, and scales them so that no probability becomes too small to hold.

Defined results: a null text, or one without a character of Unicode category L, is "und"
with score 0; labels that are null teach nothing; without any labelled row everything is
"und"; ties go to the language first in code point order; very long texts and words are
judged whole; repeated rows get equal answers; a null doc_id counts as not held out; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewheel.session import table

#: Texts of each language, at most, that the model is fitted on.
MAX_ROWS = 500
ROUNDS = 4
#: Added to every piece's expected count.
SMOOTHING = 0.1
UNKNOWN = "und"
#: Words looked up together, characters of distinct words scored together, and distinct words that a task remembers.
PIECE, SCORED, REMEMBERED = 1 << 19, 1 << 18, 1 << 19
#: Languages that those numbers are for: with more of them, fewer words at once.
FEW = 8
#: Positions between two scalings; the least probability of a character to this power is still a number.
STRETCH = 32

_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def words_of(text: str) -> list[bytes]:
    """The words that are scored: lower case, separated by ASCII characters that are no letters."""
    return text.lower().encode().translate(_SPACED).split()


def pieces_of(path: str) -> list[str]:
    """The lower-case pieces of letters in a sentencepiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return [p for p in found if p == p.lower() and p != _START and all(c.isalpha() for c in p.removeprefix(_START))]


class Pieces:
    """Pieces by the hash of their characters, found many at a time.

    Two tables of slots: a piece is in its slot of the first, or, where that is taken, of the second.
    """

    def __init__(self, pieces: list[str], bits: int = 20):
        self.size, self.longest, self.shift = len(pieces), max(map(len, pieces)), np.uint64(64 - bits)
        self.keys = np.zeros((2, 1 << bits), np.uint64)
        self.ids = np.full((2, 1 << bits), -1, np.int32)
        for i, piece in enumerate(pieces):
            key = self.extend(np.zeros(1, np.uint64), np.array([ord(piece[0])], np.uint64))
            for c in piece[1:]:
                key = self.extend(key, np.array([ord(c)], np.uint64))
            for t, slot in enumerate(self.slots(key)):
                if self.ids[t, slot[0]] < 0:
                    self.keys[t, slot[0]], self.ids[t, slot[0]] = key[0], i
                    break
            else:
                raise ValueError(f"no slot left for piece {piece!r}; more bits are needed")

    def extend(self, key: np.ndarray, char: np.ndarray) -> np.ndarray:
        return (key + char) * _BASE

    def slots(self, key: np.ndarray) -> list[np.ndarray]:
        return [(key * k) >> self.shift for k in _SLOTS]

    def find(self, key: np.ndarray) -> np.ndarray:
        """The piece of each key; -1 for none."""
        one, two = self.slots(key)
        found = np.where(self.keys[0][one] == key, self.ids[0][one], -1)
        return np.where((self.ids[1][two] >= 0) & (self.keys[1][two] == key), self.ids[1][two], found)

    def lattice(self, chars: np.ndarray, begin: int, until: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) by end, from begin + 1 to until: which rows of ``chars`` (words of one length) have a piece there.

        Characters that are no piece by themselves are the piece numbered ``size``.
        """
        low = max(begin + 1 - self.longest, 0)
        chars = chars[:, low:until]
        n = chars.shape[1]
        keys = np.zeros_like(chars)
        edges = []
        for length in range(1, min(n, self.longest) + 1):
            keys = self.extend(keys[:, : n - length + 1], chars[:, length - 1 :])
            found = self.find(keys)
            if length == 1:
                found[found < 0] = self.size
            hit = found >= 0
            for start in np.flatnonzero(hit.any(0)).tolist():
                if low + start + length > begin:
                    rows = np.flatnonzero(hit[:, start])
                    edges.append((low + start, low + start + length, rows, found[rows, start]))
        return sorted(edges, key=lambda e: e[1])


@cache
def vocabulary_pieces(path: str) -> Pieces:
    """The table of a vocabulary's pieces, made once a process."""
    return Pieces(pieces_of(path))


def by_length(words: list[bytes], languages: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, characters) of words of one length together."""
    parts = sorted(((i, _START + w.decode()) for i, w in enumerate(words)), key=lambda p: len(p[1]))
    lengths = np.fromiter((len(p) for _, p in parts), np.int64, len(parts))
    for n in np.unique(lengths).tolist():
        a, b = np.searchsorted(lengths, [n, n + 1])
        step = max(1, SCORED // (n * -(-languages // FEW)))
        for k in range(a, b, step):
            own = parts[k : min(k + step, b)]
            chars = np.frombuffer("".join(p for _, p in own).encode("utf-32-le"), "<u4").astype(np.uint64)
            yield np.fromiter((i for i, _ in own), np.int64, len(own)), chars.reshape(len(own), n)


def _stretches(n: int, reach: int) -> list[tuple[int, int]]:
    """(begin, until): positions 1 to n in stretches, none shorter than a piece but the last."""
    step = max(STRETCH, reach)
    return [(begin, min(begin + step, n)) for begin in range(0, n, step)]


def log_chances(pieces: Pieces, chance: np.ndarray, words: list[bytes]) -> np.ndarray:
    """[word, language]: log probability of each word, summed over all cuts into pieces."""
    out = np.zeros((len(words), chance.shape[1]))
    for own, chars in by_length(words, chance.shape[1]):
        rows, n = chars.shape
        reach = pieces.longest
        # The probability of what stands before each position of the stretch and of the reach before it.
        alpha = np.zeros((reach, rows, chance.shape[1]))
        alpha[-1] = 1
        scale = np.zeros((rows, chance.shape[1]))
        for begin, until in _stretches(n, reach):
            base = begin + 1 - reach  # the position at index 0
            alpha = np.concatenate([alpha, np.zeros((until - begin, rows, chance.shape[1]))])
            for start, end, at, piece in pieces.lattice(chars, begin, until):
                alpha[end - base, at] += alpha[start - base, at] * chance[piece]
            alpha = alpha[-reach:]
            most = alpha.max(0)
            alpha = alpha / most
            scale += np.log(most)
        out[own] = scale + np.log(alpha[-1])
    return out


def _expected(pieces: Pieces, chars: np.ndarray, weight: np.ndarray, chance: np.ndarray, edges: list) -> np.ndarray:
    """[piece, language]: how often each piece is expected in the words of one length, weighted.

    Position p is scaled by its stretch: its true value is alpha[p] times the product of
    the stretches' scales up to its own. edges: those of each stretch, or none to find them anew.
    """
    rows, n = chars.shape
    parts = _stretches(n, pieces.longest)
    of = np.zeros(n + 1, np.int64)
    for k, (begin, until) in enumerate(parts):
        of[begin + 1 : until + 1] = k
    alpha = np.zeros((n + 1, rows, chance.shape[1]))
    alpha[0] = 1
    across = [np.ones((rows, chance.shape[1]))]
    found = (lambda k: edges[k]) if edges else (lambda k: pieces.lattice(chars, *parts[k]))
    for k in range(len(parts)):
        if k:
            across.append(1 / alpha[parts[k - 1][0] + 1 : parts[k - 1][1] + 1].max(0))
        for start, end, at, piece in found(k):
            step = alpha[start, at] * chance[piece]
            alpha[end, at] += step if of[start] == k else step * across[k][at]
    beta = np.zeros_like(alpha)
    beta[n] = weight / alpha[n]
    total = np.zeros_like(chance)
    for k in reversed(range(len(parts))):
        for start, end, at, piece in sorted(found(k), key=lambda e: -e[1]):
            after = beta[end, at] * chance[piece]
            after = after if of[start] == k else after * across[k][at]
            beta[start, at] += after
            np.add.at(total, piece, alpha[start, at] * after)
    return total


def fit(pieces: Pieces, words: list[bytes], counts: np.ndarray, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> np.ndarray:
    """[piece, language]: probabilities fitted to counts [word, language]; the last row is any other character."""
    chance = np.full((pieces.size + 1, counts.shape[1]), 1 / (pieces.size + 1))
    groups = []
    for own, chars in by_length(words):
        parts = _stretches(chars.shape[1], pieces.longest)
        groups.append((chars, counts[own], [pieces.lattice(chars, *p) for p in parts] if len(parts) < 3 else []))
    for _ in range(rounds):
        expected = np.full_like(chance, smoothing)
        for chars, weight, edges in groups:
            expected += _expected(pieces, chars, weight, chance, edges)
        chance = expected / expected.sum(0)
    return chance


class Model:
    """Languages, their log shares of the training rows, and piece probabilities."""

    def __init__(self, languages: list[str], prior: np.ndarray, pieces: Pieces | None, chance: np.ndarray | None):
        self.languages, self.prior, self.pieces, self.chance = languages, prior, pieces, chance
        self.place: dict[bytes, int] = {}
        self.known = np.empty((0, len(languages)))

    def __getstate__(self):
        return {**self.__dict__, "place": {}, "known": np.empty((0, len(self.languages)))}

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; the score is the language's posterior probability."""
        answers, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return answers, scores
        held, size = [], 0
        for i, text in enumerate(texts):
            if text is not None and has_letter(text):
                held.append((i, words_of(text)))
                size += len(held[-1][1])
            if held and (size >= PIECE or i + 1 == len(texts)):
                self._judge(held, answers, scores)
                held, size = [], 0
        return answers, scores

    def _judge(self, held, answers, scores) -> None:
        if len(self.place) > REMEMBERED // -(-len(self.languages) // FEW):
            self.place, self.known = {}, self.known[:0]
        place, before = self.place, len(self.place)
        numbers = np.fromiter((place.setdefault(w, len(place)) for _, words in held for w in words), np.int64)
        if len(place) > before:
            fresh = [w for w, i in zip(reversed(place), range(len(place) - before), strict=False)][::-1]
            self.known = np.concatenate([self.known, log_chances(self.pieces, self.chance, fresh)])
        starts = np.cumsum([0, *(len(words) for _, words in held[:-1])])
        total = np.add.reduceat(self.known[numbers], starts, axis=0) + self.prior
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        for (i, _), b, s in zip(held, best, share, strict=True):
            answers[i], scores[i] = self.languages[b], s


def train(labelled: DataFrame, vocabulary: str | None = None, max_rows: int = MAX_ROWS, rounds: int = ROUNDS) -> Model:
    """A model from rows (text, lang): of each language at most max_rows different texts, those of the smallest hashes."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    labelled = labelled.where("lang is not null and text is not null")
    told = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("text").alias("texts")).collect()
    rows, texts = ({r["lang"]: r[c] for r in told} for c in ("n", "texts"))
    languages = sorted(rows)
    if not languages:
        return Model([], np.empty(0), None, None)
    spark = labelled.sparkSession
    # Twice as many as are wanted, so that there are enough different ones in all likelihood; the rest is cut off exactly.
    parts = spark.createDataFrame([(n, min(1.0, 2 * max_rows / max(texts[n], 1))) for n in languages], "lang string, part double")
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 60)) / (1 << 60)
    drawn = labelled.join(F.broadcast(parts), "lang").where(draw < F.col("part")).select("lang", "text").distinct()  # parts: a row for each language
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")  # 2 * max_rows, about
    sample = drawn.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max_rows).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                name = lang.as_py()
                found.update((name, w) for w in words_of(text.as_py()))
            keys = list(found)
            yield pa.record_batch(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array(list(found.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    counted = sample.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = counted.toPandas()  # the words of the sample
    numbers, words = pd.factorize(counted["word"].map(bytes))
    counts = np.zeros((len(words), len(languages)))
    counts[numbers, np.searchsorted(np.array(languages, object), counted["lang"].to_numpy(object))] = counted["n"]
    pieces, words = vocabulary_pieces(vocabulary), list(words)
    total = np.array([rows[n] for n in languages], float)
    return Model(languages, np.log(total / total.sum()), pieces, fit(pieces, words, counts, rounds))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages times the vocabulary
    kept = [c for c in docs.columns if c != "text"]
    schema = StructType([*(docs.schema[c] for c in kept), *docs.select("text").schema]).add("lang_pred", "string").add("score", "double")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = sent.value.judge(batch.column("text").to_pylist())
            columns = [batch.column(c) for c in (*kept, "text")]
            yield pa.record_batch([*columns, pa.array(lang, pa.string()), pa.array(score)], [*kept, "text", "lang_pred", "score"])

    return docs.mapInArrow(each, schema)


def held_out(modulus: int = 4, remainder: int = 2) -> Column:
    """Whether crc32 of the doc_id as text leaves the remainder; null ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op8_language_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("text", "lang"))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


QUERIES = {"op8_language_unigrams": op8_language_unigrams}
ORACLE_SQL: dict[str, str] = {}
