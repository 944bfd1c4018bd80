"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are read as characters: letters and marks in lower case, every run of other characters one gap. The n-grams of 1 to
``LONGEST`` characters are hashed into ``BUCKETS``; an n-gram has a gap at its ends only. Counts of all learnable documents
are summed by Spark, a row for each language and bucket. The matrix of log-probabilities, a row for each bucket and a
column for each language, has a bounded size (``MAX_LANGS``) and is broadcast; texts are scored in numpy as a sparse
product: each n-gram that occurs picks a row, and the rows of a text are summed. Log-probabilities are whole numbers
(``SCALE`` to one nat), so that a sum doesn't depend on its order.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.common import slices

LONGEST = 3
BUCKETS = 1 << 15
MAX_LANGS = 256  # the matrix then has 64 MB
SMOOTHING = 0.5
SCALE = 1 << 16
EVIDENCE = 40  # n-grams of a longer text count so much together: neighbouring n-grams aren't independent
UNKNOWN = "und"
PIECE = 1 << 18  # characters whose n-grams are held at once, at most
ROW_CELLS = 1 << 24  # numbers of the matrix that are held at once for a piece


@functools.cache
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter or mark, 0 for others; and whether it is a letter."""
    lower, letter = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, bool)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LM":
            low = chr(code).lower()
            lower[code] = ord(low) if len(low) == 1 else code
            letter[code] = kind == "L"
    return lower, letter


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters as ``alphabet`` has them, gaps (0) at both ends of each text and never two in a row; where each text
    begins (one more at the end); and whether it has a letter."""
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lower, letter = alphabet()
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    lettered = np.concatenate(([0], np.cumsum(letter[code])))
    n = len(at) - 1
    framed = np.zeros(len(code) + 2 * n, np.uint32)
    framed[np.arange(len(code)) + 2 * np.repeat(np.arange(n), np.diff(at)) + 1] = lower[code]
    first = at + 2 * np.arange(n + 1)
    keep = framed != 0
    keep[1:] |= framed[:-1] != 0
    keep[first[:-1]] = True
    return framed[keep], np.concatenate(([0], np.cumsum(keep)))[first], lettered[at[1:]] > lettered[at[:-1]]


def grams(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and place of each n-gram of ``chars``."""
    total = np.zeros(len(chars), np.uint64)
    letters = chars != 0
    buckets, places = [], []
    fits = np.ones(len(chars), bool)  # no gap in the middle
    for n in range(1, LONGEST + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        total = total[:m] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] + np.uint64(n << 24)
        if n > 2:
            fits = fits[:m] & letters[n - 2 : len(chars) - 1]
        at = np.flatnonzero(fits[:m] & (letters[:m] | letters[n - 1 :] if n < 3 else True))  # two gaps: texts meet there
        h = total[at] * np.uint64(0xD6E8FEB86659FD93)
        buckets.append(((h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int32))
        places.append(at)
    return (np.concatenate(buckets), np.concatenate(places)) if buckets else (np.empty(0, np.int32), np.empty(0, np.int64))


def pieces(chars: np.ndarray, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``grams`` of ``chars``, in pieces; each n-gram once, by the piece that its first character is in."""
    for lo in range(0, len(chars), size):
        bucket, place = grams(chars[lo : lo + size + LONGEST - 1])
        own = place < size
        yield bucket[own], place[own] + lo


def learnable(doc_id: Column) -> Column:
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    """Whether the remainder is 1; a null id has none, and its row may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def counts(docs: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows of ``docs`` with a language and a text; ``bucket`` -1 counts the documents."""

    def run(batches):
        known: dict[str, np.ndarray] = {}

        def rows():
            for lang, n in known.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some - 1, pa.int32()), pa.array(n[some])], ["lang", "bucket", "n"])
            known.clear()

        def of(lang):
            return known.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))

        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(batch.column(0), 1 << 20):
                chars, first, _ = characters(data, offsets)
                own = code[lo:hi]
                for c in np.unique(own).tolist():
                    of(names[c])[0] += np.count_nonzero(own == c)
                for bucket, place in pieces(chars):
                    lang = own[np.searchsorted(first, place, "right") - 1]
                    for c in np.unique(lang).tolist():
                        of(names[c])[1:] += np.bincount(bucket[lang == c], minlength=BUCKETS)
                if len(known) > MAX_LANGS:  # few texts of a slice have another language each; sums go on below
                    yield from rows()
        yield from rows()

    some = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    return some.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of each bucket (rows) in each language (columns), and of the languages themselves."""

    def __init__(self, langs: list[str], prior: np.ndarray, matrix: np.ndarray):
        self.langs, self.prior, self.matrix = langs, prior, matrix

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each text, -1 where it has no letter, and its probability."""
        chars, first, lettered = characters(data, offsets)
        n = len(offsets) - 1
        total, seen = np.zeros((n, len(self.langs)), np.int64), np.zeros(n, np.int64)
        if not self.langs:
            return np.full(n, -1), np.zeros(n)
        for bucket, place in pieces(chars, min(PIECE, ROW_CELLS // (LONGEST * len(self.langs)))):
            text = np.searchsorted(first, place, "right") - 1
            order = np.argsort(text, kind="stable")  # n-grams of one size come after those of another
            text, bucket = text[order], bucket[order]
            edge = np.flatnonzero(np.diff(text, prepend=-1))
            if len(edge):
                total[text[edge]] += np.add.reduceat(self.matrix[bucket], edge, axis=0, dtype=np.int64)
                seen[text[edge]] += np.diff(np.append(edge, len(text)))
        value = total / SCALE * np.minimum(1, EVIDENCE / np.maximum(seen, 1))[:, None] + self.prior
        best = value.argmax(1)  # of equal ones the first by name
        share = 1 / np.exp(value - value.max(1)[:, None]).sum(1)
        return np.where(lettered, best, -1), np.where(lettered, share, 0.0)


def train(docs: DataFrame, prior: bool = True) -> Model:
    """Learnt from all rows of ``docs`` (``text, lang``) with a language: nothing is sampled.

    To the driver comes the matrix, ``MAX_LANGS`` times ``BUCKETS`` numbers at most; more languages are an error. ``prior``
    weighs languages by their documents, else all alike.
    """
    rows = counts(docs).limit(MAX_LANGS * (BUCKETS + 1) + 1).toArrow()
    names = sorted(set(rows.column("lang").unique().to_pylist()))
    if len(names) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    n = np.zeros((BUCKETS + 1, len(names)))
    number = {x: k for k, x in enumerate(names)}
    encoded = rows.column("lang").combine_chunks().dictionary_encode()
    column = np.array([number[x] for x in encoded.dictionary.to_pylist()], np.int64)[encoded.indices.to_numpy(zero_copy_only=False)] if len(rows) else np.empty(0, np.int64)
    n[rows.column("bucket").to_numpy() + 1, column] = rows.column("n").to_numpy()
    matrix = np.log(n[1:] + SMOOTHING) - np.log(n[1:].sum(0) + SMOOTHING * BUCKETS)
    weights = n[0] if prior else np.ones(len(names))
    return Model(names, np.log(np.maximum(weights, 1) / max(1, weights.sum())), np.rint(matrix * SCALE).astype(np.int32))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of the whole text, each row by itself; columns of these names are replaced.

    A null text, and one without a letter, is ``und`` with score 0; so is every text if nothing was learnt. The score is
    the probability of the language under the model. Nothing is shuffled; texts of any length are read in pieces.
    """
    docs = docs.drop("lang_pred", "score")
    shipped = docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.matrix))

    def run(batches):
        known = Model(*shipped.value)
        names = pa.array([*known.langs, UNKNOWN])
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(text_col), 1 << 20):
                best, share = known.score(data, offsets)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(np.round(share, 6))], [*part.schema.names, "lang_pred", "score"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}lang_pred string, score double")


def op13_language(spark, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``documents``.

    Learnt from text and language of the rows that aren't held out. Null and empty texts are ``und``; repeated rows give
    repeated rows, a null id isn't held out, an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(learnable(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
