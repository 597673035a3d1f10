"""Packing tokenised documents into sequences, best-two-fit.

Documents of equal length are interchangeable, so the packing is decided on the counts of
lengths: at most ``capacity`` numbers, however many documents there are. A bin is filled
greedily with the longest length that still fits; when nothing fits any more, its smallest
document is put back if two unpacked documents fill the widened gap more tightly. Bins of the
same content are decided at once, for as many as the counts allow, which gives what filling
them one by one would. The decisions are runs of equal documents: length, numbers from and to,
first sequence, offset.

Documents find their place by their number among those of their length. Tasks number what they
tokenise; totals by length and task, summed up by windows, are added. So a length that a third
of all documents share is numbered by all tasks that hold some of it.

Defined results: a null or empty text is one sequence end; repeated rows and null ids are packed
each; documents longer than a sequence are cut into whole sequences and a rest; words without
blanks of any length are encoded whole; extra columns are ignored unless named in ``keep``; an
empty table gives no rows.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from corpusloom import worker
from corpusloom.arrowmap import bound_batches, give_back
from corpusloom.columns import pick
from corpusloom.llm.bpe import slices
from corpusloom.storage import materialize

#: Words of one generation that a worker remembers, and how long they may be.
REMEMBERED, LONGEST = 600_000, 64
#: Characters of texts that are parted together.
TOGETHER = 1_000_000
#: Marks that may follow a word: ASCII punctuation but the apostrophe, which may share a token
#: with a letter.
MARKS = string.punctuation.replace("'", "")


def parted(text: str) -> list[str]:
    """A text at white space where it may be parted without changing its ids."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable bytes for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts by a tokenizer that drops white space: word by word, remembered.

    The tokenizer takes texts in lower case and keeps letters, digits and marks apart. So a word
    of Latin letters goes to its merges directly, in lower case and without the marks behind it;
    any other word takes the whole tokenizer. When a generation of words is full, it becomes the
    older one; words that come again move to the new one, so frequent words stay known and memory
    is bounded.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.merges = self.tokenizer.model
        self.letters = byte_letters()
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, word: str) -> bytes | None:
        """Ids of a word of lower-case Latin letters; null for words of other letters."""
        if not word.isascii():
            if max(word) >= "\u0250" or word != word.lower() or not unicodedata.is_normalized("NFC", word):
                return None
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merges.tokenize(word)]).tobytes()

    def learn(self, words: set[str]) -> list[str]:
        """Have the ids of all ``words`` at hand; the long ones, which are not to be kept."""
        missing = words.difference(self.seen)
        if len(self.seen) + len(missing) > REMEMBERED:
            self.seen, self.older, missing = {}, self.seen, words
        seen, before, long, odd = self.seen, self.older.get, [], []
        for w in missing:
            got = before(w)
            if got is not None:
                seen[w] = got
                continue
            if len(w) > LONGEST:
                long.append(w)
                continue
            core = w
            if not w.isalpha():
                core = w.rstrip(MARKS)
                if not core.isalpha():
                    odd.append(w)
                    continue
            root = core.lower() if core.isascii() else core
            got = seen.get(root) or before(root) or self.merged(root)
            if got is None:
                odd.append(w)
                continue
            if root is not w:
                seen[root] = got
            if core is not w:
                tail = w[len(core) :]
                if tail not in seen:
                    seen[tail] = self.ids(tail)
                got += seen[tail]
            seen[w] = got
        found = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
        seen.update(zip(odd, [array("I", e.ids).tobytes() for e in found], strict=True))
        seen.update((w, self.ids(w)) for w in long)
        return long

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [parted(t) for t in texts]
        long = self.learn(set().union(*split))
        out = [b"".join(map(self.seen.__getitem__, x)) for x in split]
        for w in long:
            del self.seen[w]
        return out


def _encoder(shared) -> Encoder:
    return worker.held(("words", shared.value[0]), lambda: Encoder(shared.value[1]))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end: int = 1, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """A row a piece: ``keep``, piece, start, length, ids_crc32, ids if asked, and part and nth.

    ``nth`` numbers the pieces of one length within the task ``part``. The tokenizer's file is
    read on the driver and broadcast: a fixed vocabulary, not corpus data.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    shared = spark.sparkContext.broadcast((zlib.crc32(definition.encode()), definition))
    rows = pick(docs, *keep, text).toDF(*keep, "__text")
    kept = [f for f in rows.schema.fields if f.name != "__text"]
    made = StructType.fromDDL("piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids + ", part int, nth bigint")
    kinds = {f.name: to_arrow_type(f.dataType) for f in made.fields}
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(shared), TaskContext.get().partitionId()
        numbered = [0] * (capacity + 1)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in kinds}
            source: list[int] = []
            row = 0
            for texts in slices([t or "" for t in batch.column("__text").to_pylist()], TOGETHER):
                for ids in encoder.encode_many(texts):
                    ids += closing
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        length = len(cut) // 4
                        source.append(row)
                        for name, value in (("piece", piece), ("start", at // 4), ("length", length), ("ids_crc32", zlib.crc32(cut)), ("part", part), ("nth", numbered[length])):
                            out[name].append(value)
                        if with_ids:
                            out["ids"].append(cut)
                        numbered[length] += 1
                    row += 1
            at = pa.array(source, pa.int64())
            columns = [batch.column(f.name).take(at) for f in kept] + [pa.array(out[n], kind) for n, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + list(kinds))
        give_back()

    bound_batches(spark)
    return rows.mapInArrow(run, StructType([*kept, *made.fields]))


class Plan:
    """Places for all documents of given lengths: best-two-fit over counts.

    ``counts[l]`` documents have length l. Runs of equal documents are columns of ``runs``:
    length, first number, sequence of the first number (the next ones follow), offset.
    """

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.used = np.zeros_like(self.left)
        self.sequences = 0
        found: list[tuple[int, int, int, int]] = []
        while True:
            # below[g]: the longest unpacked length of at most g, 0 if none.
            self.below = np.maximum.accumulate(np.where(self.left > 0, np.arange(self.capacity + 1), 0))
            if not self.below[-1]:
                break
            greedy = self.greedy()
            content = self.two_for_smallest(greedy)
            need = dict.fromkeys(greedy, 0)
            for pattern in (greedy, content):
                for length in pattern:
                    need[length] = max(need.get(length, 0), pattern.count(length))
            times = min(int(self.left[x]) // n for x, n in need.items())
            times = max(1, times)
            offset = 0
            for length in content:
                found.append((length, int(self.used[length]), self.sequences, offset))
                self.used[length] += times
                self.left[length] -= times
                offset += length
            self.sequences += times
        found.sort()
        self.runs = np.array(found, np.int64).reshape(-1, 4)

    def greedy(self) -> list[int]:
        """The longest unpacked documents that fit, one after the other."""
        taken: list[int] = []
        gap, reach = self.capacity, self.capacity
        while gap > 0:
            x = int(self.below[min(gap, reach)])
            if not x:
                break
            n = min(gap // x, int(self.left[x]))
            taken += [x] * n
            gap -= n * x
            reach = x - 1
        return taken

    def two_for_smallest(self, taken: list[int]) -> list[int]:
        """``taken`` with two unpacked documents for its last one where that fills the bin better."""
        gap = self.capacity - sum(taken)
        if not gap:
            return taken
        smallest, room = taken[-1], gap + taken[-1]
        free = self.left.copy()
        for x in taken[:-1]:
            free[x] -= 1
        longest = np.maximum.accumulate(np.where(free > 0, np.arange(self.capacity + 1), 0))
        first = np.flatnonzero(free[: room // 2 + 1] > 0)
        if not len(first):
            return taken
        second = longest[room - first]
        # A length is its own partner only if two of it are left.
        alone = (second == first) & (free[first] < 2)
        second = np.where(alone, longest[np.maximum(first - 1, 0)], second)
        filled = np.where(second > 0, first + second, 0)
        best = int(np.argmax(filled))
        if filled[best] <= smallest:
            return taken
        return [*taken[:-1], int(second[best]), int(first[best])]


def place(parts: DataFrame, capacity: int = 4096) -> DataFrame:
    """``parts`` with sequence_id and offset for part and nth.

    Columns length, part and nth are needed. What the driver gets and sends out is bounded by
    the capacity: a count a length, and the runs of the plan.
    """
    spark = parts.sparkSession
    per_task = parts.groupBy("length", "part").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in totals.items():
        counts[length] = n
    runs = spark.sparkContext.broadcast(Plan(counts).runs)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select(F.col("length").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("__before"))
    numbered = parts.join(first, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p")))
    kept = [f for f in parts.schema.fields if f.name not in ("part", "nth")]
    numbered = numbered.select(*[f.name for f in kept], (F.col("__before") + F.col("nth")).alias("__number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = runs.value
        wide = np.int64(1) << np.int64(48)
        starts = plan[:, 0] * wide + plan[:, 1]
        for batch in batches:
            number = batch.column("__number").to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, batch.column("length").to_numpy(zero_copy_only=False) * wide + number, "right") - 1
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(plan[at, 2] + number - plan[at, 1]), pa.array(plan[at, 3])], [*[f.name for f in kept], "sequence_id", "offset"])
        give_back()

    return numbered.mapInArrow(run, StructType([*kept, *StructType.fromDDL("sequence_id bigint, offset bigint").fields]))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end: int = 1, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset; texts are tokenised once."""
    cut = materialize(pieces(docs, tokenizer_path, capacity, end, text, keep, with_ids))
    return place(cut, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """A row a sequence: sequence_id, n_tokens, ids, and the lengths of its pieces in order.

    ``packed`` has the ids of its pieces; a sequence is never larger than the capacity.
    """
    per = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("held"))
    whole = F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return per.select("sequence_id", F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), whole.alias("ids"), F.transform("held", lambda x: x["length"]).alias("lengths"))
