"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import slices, tune

ORDERS = (1, 2, 3)
BITS = 16
#: Languages at most, a parameter of train(): the broadcast matrix has 2^16 float32 for each (64 MB for 256).
MOST = 256
#: Code points in one numpy slice.
SLICE = 1 << 20
UND = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """The buckets of all n-grams of a text.

    Letters are lower-cased and every run of other characters counts as one
    space, so digits, punctuation and markup say nothing.  The text begins and
    ends with a space.  Long texts go through numpy in slices: the last
    characters of one are carried on to the next, so the n-grams are those of
    the whole text.
    """
    found = []
    last = np.full(1, 32, np.uint64)
    kept = [last] * len(ORDERS)  # for each order the characters that begin n-grams not yet complete
    some = False
    text = text.lower()
    for at in range(0, len(text) + 1, SLICE):
        raw = text[at : at + SLICE].encode("utf-32-le", "surrogatepass")
        c = np.frombuffer(raw, np.uint32)
        c = np.where(letters()[c], c, 32).astype(np.uint64)
        if at + SLICE > len(text):
            c = np.concatenate((c, [np.uint64(32)]))
        before = np.concatenate((last, c))[:-1]
        c = c[(c != 32) | (before != 32)]
        some = some or bool((c != 32).any())
        if len(c):
            last = c[-1:]
        for k, n in enumerate(ORDERS):
            own = np.concatenate((kept[k], c))
            kept[k] = own[max(0, len(own) - n + 1) :]
            key = np.zeros(max(0, len(own) - n + 1), np.uint64)
            for j in range(n):
                key = key * np.uint64(0x110001) + own[j : j + len(key)]
            mixed = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            found.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found) if some else np.zeros(0, np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task adds up its own counts first: a row for each language and bucket at most."""
    total: dict[str, np.ndarray] = {}
    wait: dict[str, list[np.ndarray]] = {}

    def flush(lang: str) -> None:
        if lang not in total:
            total[lang] = np.zeros(1 << BITS, np.int64)
        total[lang] += np.bincount(np.concatenate(wait.pop(lang)), minlength=1 << BITS)

    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            wait.setdefault(lang, []).append(grams(text))
            if len(wait[lang]) >= 200 or len(wait[lang][-1]) > SLICE:
                flush(lang)
    for lang in list(wait):
        flush(lang)
    for lang, n in total.items():
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(hit.astype(np.int32)), pa.array(n[hit])], ["lang", "bucket", "n"])


class Model:
    """Languages and their log-probabilities, a row for each bucket."""

    def __init__(self, langs: list[str], logs: np.ndarray):
        self.langs, self.logs = langs, logs

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior, for equal priors."""
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return names, scores
        at, ids, size = [], [], 0

        def flush() -> None:
            nonlocal at, ids, size
            if at:
                starts = np.cumsum([0, *(len(x) for x in ids[:-1])])
                rows = self.logs[np.concatenate(ids)]
                sums = np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
                best = sums.argmax(axis=1)
                sure = 1 / np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -700)).sum(axis=1)
                for k, b, s in zip(at, best, sure, strict=True):
                    names[k], scores[k] = self.langs[b], float(s)
            at, ids, size = [], [], 0

        most = max(1, (1 << 22) // len(self.langs))
        for k, text in enumerate(texts):
            if not text or not len(g := grams(text)):
                continue
            if len(g) > most:  # a very long text: its n-grams in pieces
                sums = sum(self.logs[g[i : i + most]].sum(axis=0, dtype=np.float64) for i in range(0, len(g), most))
                names[k] = self.langs[int(sums.argmax())]
                scores[k] = float(1 / np.exp(np.maximum(sums - sums.max(), -700)).sum())
                continue
            at.append(k)
            ids.append(g)
            size += len(g)
            if size >= most:
                flush()
        flush()
        return names, scores


def train(labelled: DataFrame, smoothing: float = 0.01, most: int = MOST) -> Model:
    """Count the n-grams of all rows (lang, text); what is collected is languages times buckets.

    Rows with a null in either column are left out; repeated rows count each
    time.  No rows give a model without languages, which answers 'und'.
    ``most`` bounds the matrix: a table with more languages is refused with a
    ValueError before anything is collected.
    """
    tune(labelled.sparkSession)
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    summed = rows.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.limit((most << BITS) + 1).toArrow()
    lang, bucket, n = (found.column(k) for k in ("lang", "bucket", "n"))
    langs = sorted(lang.unique().to_pylist())
    if len(langs) > most:
        raise ValueError(f"more than {most} languages: raise most, for 256 KB of broadcast each")
    counts = np.full((1 << BITS, len(langs)), smoothing)
    if langs:
        place = {x: k for k, x in enumerate(langs)}
        coded = lang.combine_chunks().dictionary_encode()
        col = np.array([place[x] for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        counts[bucket.to_numpy(), col] += n.to_numpy()
    logs = np.log(counts / counts.sum(axis=0)) if langs else counts
    return Model(langs, logs.astype(np.float32))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score: 'und' and 0 where the text is null, empty or has no letters.

    The matrix is broadcast; its size is bounded by train().  Texts are read
    whole; repeated rows stay; columns named lang_pred or score are replaced.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logs))
    out = docs.drop("lang_pred", "score")
    at = out.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in slices(batches):
            lang, score = own.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return out.mapInArrow(predict, StructType(list(out.schema.fields)).add("lang_pred", "string").add("score", "double"))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training; a row without id always is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))
