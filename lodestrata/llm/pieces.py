"""SentencePiece encoding and decoding by one forward pass over a trie of words.

A text is cut into marked words that no piece crosses.  The distinct words of
a slice of texts are sorted; walking them in that order is a depth-first walk
of their trie, and the forward state of a common prefix is computed once.

For a unigram vocabulary the state of a prefix is its best score and last
piece (Viterbi).  In a BPE vocabulary scores only rank merges, and the best sum
is not the encoding.  There the last piece of a prefix's encoding is the one
piece that ends there and may follow the last piece of the shorter prefix, two
pieces being compatible if merging their joined characters gives the two back.
So the same pass with another rule for the last piece gives exactly the
encoding by merges.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .base import slices, tune

MARK = "▁"
#: Characters of text whose distinct words are sorted together.
SLICE = 1 << 20
#: Words whose ids a worker keeps, about: as many again that it met before those.
KEPT = 50_000


class Vocabulary:
    """Pieces by id, with scores; bytes of characters without a piece have ids of their own."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], merges: bool = True):
        self.pieces, self.scores, self.kinds, self.merges = pieces, scores, kinds, merges
        self.ids = {p: k for k, p in enumerate(pieces) if kinds[k] == "piece"}
        self.bytes = {int(p[1:-1], 16): k for k, p in enumerate(pieces) if kinds[k] == "byte"}
        self.unknown = kinds.index("unknown") if "unknown" in kinds else None
        #: Pieces by their characters from last to first: character to (number or None, next, what fits before).
        self.ends: dict[str, tuple] = {}
        for p, k in self.ids.items():
            level = self.ends
            for c in p[:0:-1]:
                level = level.setdefault(c, (None, {}, {}))[1]
            level[p[0]] = (k, level[p[0]][1] if p[0] in level else {}, {})
        self.longest = max(map(len, self.ids), default=1)
        joined = {c for p in self.ids if len(p) > 1 for c in p} - {MARK}
        own = "".join(map(re.escape, sorted(joined)))
        self.split = re.compile(f"{MARK}*[{own}]+|{MARK}+|[^{own}{MARK}]+" if own else f"{MARK}+|[^{MARK}]+").findall
        self.learnt = 0
        self.packs = [np.int32(k).tobytes() for k in range(len(pieces))]
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.mark_bytes = self.pack_char(MARK, literal=True)
        self.raw = [self.raw_of(k) for k in range(len(pieces))]

    @classmethod
    def load(cls, path: str, merges: bool = True) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        kind = ["byte" if m.is_byte(k) else "control" if m.is_control(k) else "unknown" if m.is_unknown(k) else "piece" for k in n]
        return cls([m.id_to_piece(k) for k in n], [m.get_score(k) for k in n], kind, merges)

    def fresh(self) -> Vocabulary:
        """The same without the words it keeps: for a new task."""
        self.kept, self.older = {}, {}
        return self

    def __reduce__(self):
        return Vocabulary, (self.pieces, self.scores, self.kinds, self.merges)

    def raw_of(self, k: int) -> bytes:
        if self.kinds[k] == "byte":
            return bytes([int(self.pieces[k][1:-1], 16)])
        return self.pieces[k].replace(MARK, " ").encode() if self.kinds[k] == "piece" else b""

    def pack_char(self, c: str, literal: bool = False) -> bytes:
        """The ids of one character as packed int32: its piece, or its bytes, or the unknown id."""
        if not literal and c in self.ids:
            return np.int32(self.ids[c]).tobytes()
        raw = c.encode("utf-8", "surrogatepass")
        if all(b in self.bytes for b in raw):
            return np.array([self.bytes[b] for b in raw], np.int32).tobytes()
        if self.unknown is None:
            raise ValueError(f"the vocabulary has neither bytes nor an unknown id for {c!r}")
        return np.int32(self.unknown).tobytes()

    def merge(self, text: str) -> list[str]:
        """The pieces of a string by merging: the pair with the best score first, the leftmost of equals."""
        part = list(text)
        left, right, live = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1)), [True] * len(part)
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(part) and (k := self.ids.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, j, part[i] + part[j]))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if live[i] and live[j] and right[i] == j and part[i] + part[j] == both:
                part[i], live[j], right[i] = both, False, right[j]
                if right[j] < len(part):
                    left[right[j]] = i
                offer(left[i], i)
                offer(i, right[i])
        return [p for p, on in zip(part, live, strict=True) if on]

    def pack(self, parts: list[str]) -> bytes:
        return b"".join(self.pack_char(p) if len(p) == 1 else np.int32(self.ids[p]).tobytes() for p in parts)

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of each word, walking the sorted words as a trie."""
        packs, ends, merges, learnt = self.packs, self.ends, self.merges, 0
        code, longest, scores, size = self.ids.get, self.longest, self.scores, len(self.pieces)
        poorest = min(scores, default=0.0) - 10
        out: dict[str, bytes] = {}
        before = ""
        #: For each prefix length: where its last piece starts, that piece's number, and its score.
        start, last, best = [0], [-1], [0.0]
        for word in sorted(words):
            if merges and word.startswith(MARK * 2):  # runs of marks tie in score: merged as they are
                out[word] = self.pack(self.merge(word))
                continue
            n, same, failed = len(word), 0, False
            top = min(n, len(before))
            while same < top and word[same] == before[same]:
                same += 1
            del start[same + 1 :], last[same + 1 :], best[same + 1 :]
            for i in range(same + 1, n + 1):
                if merges:
                    # Backwards from i, as long as some piece ends so; just one fits what stands before it.
                    level, a = ends, i
                    while a:
                        a -= 1
                        node = level.get(word[a])
                        if node is None:
                            a = -1
                            break
                        k, level, known = node
                        if k is not None:
                            ok = known.get(last[a])
                            if ok is None:
                                both = [word[start[a] : a], word[a:i]] if a else [word[:i]]
                                ok = known[last[a]] = self.merge("".join(both)) == both
                                learnt += 1
                            if ok:
                                break
                    else:
                        a = -1
                    if a < 0:
                        if code(word[i - 1]) is not None:
                            failed = True  # merges that don't follow from pairs
                            break
                        a, k = i - 1, size + ord(word[i - 1])  # a character without a piece
                    start.append(a)
                    last.append(k)
                else:
                    found, at = -float("inf"), i - 1
                    for a in range(max(0, i - longest), i):
                        k = code(word[a:i])
                        s = scores[k] if k is not None else poorest if a + 1 == i else None
                        if s is not None and best[a] + s > found:
                            found, at = best[a] + s, a
                    k = code(word[at:i])
                    start.append(at)
                    last.append(size + ord(word[at]) if k is None else k)
                    best.append(found)
            if failed:
                out[word] = self.pack(self.merge(word))
                before = ""
                del start[1:], last[1:], best[1:]
                continue
            before = word
            parts, i = [], n
            while i:
                k = last[i]
                i = start[i]
                parts.append(packs[k] if k < size else self.pack_char(chr(k - size)))
            parts.reverse()
            out[word] = b"".join(parts)
        self.learnt += learnt
        if self.learnt > 1_000_000:
            self.learnt, levels = 0, [ends]
            while levels:
                for _, level, known in levels.pop().values():
                    known.clear()
                    levels.append(level)
        return out

    def words(self, text: str) -> list[list[str]]:
        """Marked words, a list for each stretch between literal marks in the text."""
        parts = text.split(MARK)
        return [self.split((MARK if not k and (p or len(parts) > 1) else "") + p.replace(" ", MARK)) for k, p in enumerate(parts)]

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Packed int32 ids of each text; null stays null, an empty text has no ids.

        A mark character in a text is spelt by its bytes, so that decoding gives it back.
        """
        out: list[bytes | None] = [None] * len(texts)
        slice_: list[tuple[int, list[list[str]]]] = []
        size = 0

        def flush() -> None:
            here = {w for _, parts in slice_ for p in parts for w in p}
            missing = here - self.kept.keys()
            again = missing & self.older.keys()
            for w in again:
                self.kept[w] = self.older[w]
            self.kept.update(self.encode_words(missing - again))
            get = self.kept.__getitem__
            for k, parts in slice_:
                out[k] = self.mark_bytes.join(b"".join(map(get, p)) for p in parts)
            if len(self.kept) > KEPT:  # words not met again by the next time go
                self.older, self.kept = self.kept, {}
            slice_.clear()

        for k, text in enumerate(texts):
            if text is not None:
                slice_.append((k, self.words(text) if text else []))
                size += len(text)
                if size >= SLICE:
                    flush()
                    size = 0
        flush()
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


def listed(packed: list[bytes | None]) -> pa.Array:
    """Packed ids as an Arrow list column."""
    ends = np.cumsum([0, *(len(p or b"") // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(p or b"" for p in packed), np.int32)), mask=pa.array([p is None for p in packed]))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """docs with ids, array<int>: null for a null text, empty for an empty one.

    No shuffle: words repeat within a slice of texts, and a worker keeps the
    ids of up to KEPT words.  The vocabulary is broadcast; its size is fixed.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    out = docs.drop("ids")
    at = out.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.fresh()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, listed(own.encode(batch.column(at).to_pylist()))], [*batch.schema.names, "ids"])

    return out.mapInArrow(run, StructType(list(out.schema.fields)).add("ids", ArrayType(IntegerType())))


def encode_and_check(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """docs without the text, but with ids (if asked), n_ids, ids_sha256 (of the ids as little-endian int32) and round_trip.

    Encoding and decoding in one pass and one worker: round_trip says whether
    decoding the ids gives the text back.  A null text has no ids and counts
    as given back.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.drop("ids", "n_ids", "ids_sha256", "round_trip")
    at = rows.columns.index(text_col)
    kept = [k for k in range(len(rows.columns)) if k != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.fresh()
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            packed = own.encode(texts)
            made = {
                "n_ids": pa.array([len(p or b"") // 4 for p in packed], pa.int64()),
                "ids_sha256": pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                "round_trip": pa.array([p is None or own.decode(np.frombuffer(p, np.int32)) == t for p, t in zip(packed, texts, strict=True)]),
            }
            made = ({"ids": listed(packed)} if with_ids else {}) | made
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *made.values()], [*(batch.schema.names[k] for k in kept), *made])

    schema = StructType([rows.schema.fields[k] for k in kept])
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    return rows.mapInArrow(run, schema.add("n_ids", "long").add("ids_sha256", "string").add("round_trip", "boolean"))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """rows with decoded (the text, null for null ids) and ids_sha256 (of the ids as little-endian int32)."""
    tune(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    out = rows.drop("decoded", "ids_sha256")
    at = out.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            col = batch.column(at)
            values, ends, null = col.values.to_numpy(zero_copy_only=False).astype(np.int32, copy=False), col.offsets.to_numpy(), col.is_null().to_pylist()
            each = [None if gone else values[ends[k] : ends[k + 1]] for k, gone in enumerate(null)]
            texts = [None if x is None else own.decode(x) for x in each]
            sums = [None if x is None else hashlib.sha256(x.tobytes()).hexdigest() for x in each]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(sums, pa.string())], [*batch.schema.names, "decoded", "ids_sha256"])

    return out.mapInArrow(run, StructType(list(out.schema.fields)).add("decoded", "string").add("ids_sha256", "string"))


def summary(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_ids, ids_sha256 and round_trip of every row."""
    return encode_and_check(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), vocabulary, with_ids=False)
