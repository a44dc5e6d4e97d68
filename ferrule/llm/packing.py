"""Cost-balanced packing of token sequences.

The cost of a piece of L tokens is ``linear * L + quadratic * L ** 2`` (feed-forward and
attention work inside one document). Pieces are assigned in descending length to the
lowest-cost sequence with room for them; where none has room, the piece is cut to fill the
lowest-cost sequence that isn't full, and the rest goes on.

Documents are packed in the task that tokenises them, in groups of about ``group_tokens``
tokens, so no token is shuffled and memory is bounded by a group and one document. A group
fills ``floor(tokens / capacity)`` sequences to the last token and hands what is left (under
one sequence) to the next group of its task. What is left at the end of a task is cut into
sequences whose lengths are powers of two, which need no padding. With a column to pack by, such
as the language, every sequence holds documents of one of its values, and what waits in a task
is bounded by a group and one sequence for each value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ferrule.functions.udf_support import ship_by_value
from ferrule.llm.bpe import _L, _N, _S, Vocabulary, WordIds
from ferrule.llm.common import text_slices, worker_cache

#: Words of this tokenizer over lower-cased text of the first 256 code points (white space is dropped).
#: No two of these start alike but the quoted endings and the last, so letters may come first.
WORDS_LATIN = rf"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_S}{_L}{_N}]+"


class LowerWords:
    """Ids of whole texts under the lower-casing word tokenizer.

    Texts within the first 256 code points (already in composed form, and lower-cased there
    alike by everyone) are split by one pattern and merged through the word cache; any other
    text, and a text that holds a special token's string, goes to the library.
    """

    def __init__(self, spec: str):
        self.vocabulary = Vocabulary(spec)
        self.cache = WordIds(self.vocabulary)
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = re.compile(WORDS_LATIN).findall

    def encode(self, texts: list[str | None]) -> list[bytes]:
        pieces: list[list[str] | None] = []
        for text in texts:
            try:
                (text or "").encode("latin-1")
                pieces.append(None if text and any(s in text for s in self.vocabulary.special) else self.words((text or "").lower()))
            except UnicodeEncodeError:
                pieces.append(None)
        look = self.cache.learn(set().union(*(p for p in pieces if p))).__getitem__
        return [b"".join(map(look, p)) if p is not None else
                np.array(self.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
                for t, p in zip(texts, pieces, strict=True)]


def balance(lengths: np.ndarray, sequences: int, capacity: int, linear: float, quadratic: float) -> tuple[list, list]:
    """Places of pieces: ``[(piece, start, length, sequence, offset)]`` and the parts left over.

    ``lengths`` are the tokens of each piece. Equal lengths and costs go by their order.
    """
    cost, used = np.zeros(sequences), np.zeros(sequences, dtype=np.int64)
    placed, left = [], []
    full = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        start, rest = 0, int(lengths[i])
        while rest:
            if full == sequences:
                left.append((i, start, rest))
                break
            fits = used <= capacity - rest
            at = int(np.where(fits if fits.any() else used < capacity, cost, np.inf).argmin())
            take = min(rest, capacity - int(used[at]))
            placed.append((i, start, take, at, int(used[at])))
            used[at] += take
            cost[at] += linear * take + quadratic * take * take
            full += int(used[at] == capacity)
            start, rest = start + take, rest - take
    return placed, left


class Packer:
    """Collects documents of one task and gives out packed pieces."""

    def __init__(self, first_id: int, capacity: int, group_tokens: int, linear: float, quadratic: float):
        self.next_id, self.capacity, self.group_tokens = first_id, capacity, group_tokens
        self.linear, self.quadratic = linear, quadratic
        self.waiting: dict[object, list[tuple]] = {}        # by value: (key, start, ids, tokens of the document)
        self.held = 0

    def add(self, key, ids: bytes, value=None) -> list[tuple]:
        """Takes a document; gives the pieces of its full sequences, and of its group if that is complete."""
        n, c = len(ids) // 4, self.capacity
        out = []
        for start in range(0, n - n % c, c):
            out.append((key, start, c, n, self.next_id, 0, ids[4 * start:4 * (start + c)], value))
            self.next_id += 1
        if n % c:
            self.waiting.setdefault(value, []).append((key, n - n % c, ids[4 * (n - n % c):], n))
            self.held += n % c
        return out + self.flush() if self.held >= self.group_tokens + c * (len(self.waiting) - 1) else out

    def flush(self) -> list[tuple]:
        """Fills as many sequences as the waiting pieces of each value can fill."""
        out, self.held = [], 0
        for value, waiting in self.waiting.items():
            lengths = np.array([len(w[2]) // 4 for w in waiting], dtype=np.int64)
            sequences = int(lengths.sum()) // self.capacity
            placed, left = balance(lengths, sequences, self.capacity, self.linear, self.quadratic)
            out += [self._piece(waiting[i], start, n, self.next_id + at, offset, value) for i, start, n, at, offset in placed]
            self.next_id += sequences
            self.waiting[value] = [(w[0], w[1] + start, w[2][4 * start:4 * (start + n)], w[3]) for i, start, n in left for w in [waiting[i]]]
            self.held += sum(n for _, _, n in left)
        return out

    def finish(self) -> list[tuple]:
        """The last sequences of the task: for each value full ones, then powers of two in descending order."""
        out = self.flush()
        for value, waiting in self.waiting.items():
            held = sum(len(w[2]) // 4 for w in waiting)
            room = [1 << k for k in range(held.bit_length() - 1, -1, -1) if held >> k & 1]
            used = 0
            for w in waiting:
                start, rest = 0, len(w[2]) // 4
                while rest:
                    take = min(rest, room[0] - used)
                    out.append(self._piece(w, start, take, self.next_id, used, value))
                    start, rest, used = start + take, rest - take, used + take
                    if used == room[0]:
                        room, used, self.next_id = room[1:], 0, self.next_id + 1
        self.waiting, self.held = {}, 0
        return out

    @staticmethod
    def _piece(waiting: tuple, start: int, n: int, sequence: int, offset: int, value) -> tuple:
        key, first, ids, total = waiting
        return key, first + start, n, total, sequence, offset, ids[4 * start:4 * (start + n)], value


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048,
         end_id: int = 1, group_tokens: int = 1_000_000, linear: float = 1.0, quadratic: float = 1 / 2048,
         by: str | None = None) -> DataFrame:
    """Pieces of all documents: ``key, start, length, doc_tokens, sequence_id, offset, ids[, by]``.

    With ``by`` a sequence holds documents of one value of that column (null is one too).
    A document's ids are the tokenizer's, without special tokens, then ``end_id``; null and empty
    texts have that one id. Every id lies in one piece (``ids``: packed little-endian unsigned
    32-bit). Offsets of a sequence leave no gap; ``sequence_id`` is unique (partition number, then
    a counter) and the same when a task is run again. Repeated rows are packed as documents of
    their own; an empty table gives no pieces; other columns aren't read.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())     # bounded: one vocabulary file
    names = ["k", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", *(["v"] if by else [])]
    kind = docs.schema[key].dataType.simpleString()
    values = f", v {docs.schema[by].dataType.simpleString()}" if by else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = shared.value
        words = worker_cache(("pack", hash(spec)), lambda: LowerWords(spec))
        packer = Packer(TaskContext.get().partitionId() << 36, capacity, group_tokens, linear, quadratic)
        key_type = value_type = None
        end = end_id.to_bytes(4, "little")

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:3]),
                                               *(pa.array(c, pa.int64()) for c in columns[3:6]), pa.array(columns[6], pa.binary()),
                                               *([pa.array(columns[7], value_type)] if by else [])], names)

        for part in text_slices(batches, 1, keep="pack"):
            key_type = part.column(0).type
            rows = []
            if by:
                value_type = part.column(2).type
            value = part.column(2).to_pylist() if by else [None] * part.num_rows
            for k, ids, v in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), value, strict=True):
                rows += packer.add(k, ids + end, v)
            if rows:
                yield emit(rows)
        if rows := packer.finish():
            yield emit(rows)

    columns = [F.col(c).alias(n) for c, n in zip((key, text, by), "ktv") if c]
    return docs.select(*columns).mapInArrow(
        work, f"k {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary{values}").toDF(
            *({"k": key, "v": by}.get(n, n) for n in names))


ship_by_value(__name__)
