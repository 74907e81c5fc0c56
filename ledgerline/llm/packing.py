"""Packing: documents as token pieces in sequences of bounded length, shortest pack first over the length histogram.

1. Each document is tokenized where it lies; its pieces (all full but the last) are rows of a narrow table.
   Token ids are never shuffled.
2. The histogram of piece lengths, one number for each length, goes to the driver. Lengths are placed
   longest first, each into the packs that hold least so far and still have room. Packs of equal content are one pattern
   with a count, so the work depends on the number of lengths, not of documents.
3. Every piece gets its rank among the pieces of its length; a range of ranks belongs to one place in one
   pattern, which gives the sequence and the offset.

A null text is empty. An empty text has one token, the closing id. Rows that are repeated are packed as
often as they occur. Null ids are packed like others.
"""

from __future__ import annotations

import heapq
import json
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACE, slices, staged, word_bounds, word_hashes

LENGTH = 1024
END_ID = 0
SLICE = 1 << 20

def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a visible character: itself, if it is one, else one from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII."""
    a, b, c = (np.append(data[k:], np.zeros(min(k, len(data)), np.uint8)) for k in range(3))
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & ((b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return np.flatnonzero(two | general | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80))


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks begin that cover a run of texts: byte-level BPE never merges across them.

    A chunk is a word with the one space before it, or white space; of white space before a word
    without such a space, the last character is a chunk of its own.
    """
    starts, _, _ = word_bounds(data, offsets)
    white = SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    follows = starts[(starts > 0) & ~first[starts]]  # words with something of their text before them
    follows = follows[white[follows - 1]]
    spaced = follows[data[follows - 1] == 32] - 1
    alone = follows[data[follows - 1] != 32] - 1
    begin = np.zeros(len(data), bool)
    begin[starts] = True
    begin[spaced + 1] = False
    begin[1:] |= white[1:] & ~white[:-1]
    begin |= white & first[:-1]
    begin[spaced] = True
    begin[alone] = True
    return np.flatnonzero(begin)


class Tokens:
    """Ids of texts. Each distinct chunk of a run of texts is encoded once.

    The vocabulary's merges follow its ids, so many chunks are encoded at once by rank; which ids belong to
    which is told by their lengths. A text with white space beyond ASCII, or with a special token's string,
    is encoded by itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        self.path, self.tokenizer = path, None
        self.special = {t["content"] for t in stored["added_tokens"]}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): n for token, n in stored["model"]["vocab"].items() if token not in self.special}
        self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, n in ranks.items():
            self.sizes[n] = len(token)

    def _whole(self, text: str) -> list[int]:
        """A text with a special token's string, by the tokenizer itself; it is loaded for the first such text."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks, and where those of each begin and end."""
        parts, begin, end, total = [], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), 0
        whole = data.tobytes()
        blank = SPACE[data[ends - 1]]
        spaced = ~blank & (data[starts] == 32)
        for before, places in ((b"", np.flatnonzero(spaced)), (b"\n", np.flatnonzero(~blank & ~spaced))):  # a line feed keeps words apart; it is a token of its own
            for at in range(0, len(places), 10_000):
                part = places[at : at + 10_000]
                text = before + before.join([whole[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist())])
                ids = np.array(self.ranked.encode_ordinary(text.decode()), np.uint32)
                cut = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(ends[part] - starts[part] + len(before))) + 1
                begin[part] = total + np.concatenate(([0], cut[:-1])) + len(before)
                end[part] = total + cut
                parts.append(ids)
                total += len(ids)
        for k in np.flatnonzero(blank):
            ids = np.array(self.ranked.encode_ordinary(whole[starts[k] : ends[k]].decode()), np.uint32)
            begin[k], end[k] = total, total + len(ids)
            parts.append(ids)
            total += len(ids)
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), begin, end

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each of a run of texts."""
        odd = {int(r): False for r in np.unique(np.searchsorted(offsets, _wide_space(data), "right") - 1)}
        whole = data.tobytes()
        for token in self.special:
            at = whole.find(token.encode())
            while at >= 0:
                odd[int(np.searchsorted(offsets, at, "right")) - 1] = True
                at = whole.find(token.encode(), at + 1)
        starts = chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        before = np.searchsorted(starts, offsets)
        _, once, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        usable = np.ones(len(starts), bool)
        for row in odd:
            usable[before[row] : before[row + 1]] = False
        met = np.zeros(len(once), bool)
        met[which[usable]] = True
        place = np.cumsum(met) - 1
        ids, begin, end = self._chunks(data, starts[once[met]], ends[once[met]])
        which = place[which]
        sizes = np.where(usable, (end - begin)[which], 0) if len(begin) else np.zeros(len(starts), np.int64)
        to = np.concatenate(([0], np.cumsum(sizes)))
        source = np.repeat(begin[which] - to[:-1], sizes) + np.arange(to[-1]) if len(begin) else np.zeros(0, np.int64)
        out, row_to = ids[source], to[before]
        for row in range(len(offsets) - 1):
            if row in odd:
                text = whole[offsets[row] : offsets[row + 1]].decode()
                yield np.array(self._whole(text) if odd[row] else self.ranked.encode_ordinary(text), np.uint32)
            else:
                yield out[row_to[row] : row_to[row + 1]]


_TOKENS: dict[str, Tokens] = {}


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: the pieces of every document, all of ``length`` but the last."""
    key = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        if tokenizer not in _TOKENS:
            _TOKENS[tokenizer] = Tokens(tokenizer)
        for batch in batches:
            for at, to, data, offsets in slices(batch.column("text"), SLICE):
                out: list[tuple[int, int, int, int, int]] = []
                for row, found in enumerate(_TOKENS[tokenizer](data, offsets)):
                    ids = found.astype("<u4").tobytes() + end
                    for start in range(0, len(ids), 4 * length):
                        part = ids[start : start + 4 * length]
                        out.append((row, start // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
                row, *columns = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(count, [(piece length, times), ...])`` that hold all pieces of the histogram.

    Lengths are placed longest first. A piece goes to the pack that holds least, if there is room, else into
    a new one. Each length splits one pattern at most and opens two at most, so there are no more than
    three for each length.
    """
    open_packs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)  # by room left
    rooms: list[int] = []  # the same rooms, largest first

    def add(room: int, count: int, content: list[tuple[int, int]]) -> None:
        if count:
            heapq.heappush(rooms, -room)
            open_packs[room].append((count, content))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left and rooms and -rooms[0] >= size:
            room = -heapq.heappop(rooms)
            count, content = open_packs[room].pop()
            used = min(left, count)
            add(room, count - used, content)
            more = [*content[:-1], (size, content[-1][1] + 1)] if content[-1][0] == size else [*content, (size, 1)]
            add(room - size, used, more)
            left -= used
        each = length // size
        add(length - each * size, left // each, [(size, each)])
        add(length - left % each * size, 1 if left % each else 0, [(size, left % each)])
    return [pack for packs in open_packs.values() for pack in packs]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, from_rank, to_rank, times, first_sequence, first_offset``: which ranks of a length go to which place of which pattern.

    The distinct lengths in a pattern add up to no more than the sequence length (1024: 44 of them), so
    this table is bounded by the sequence length alone.
    """
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, content in patterns:
        offset = 0
        for size, times in content:
            out.append((size, rank[size], rank[size] + count * times, times, sequence, offset))
            rank[size] += count * times
            offset += size * times
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece of every row of ``docs`` (``doc_id``, ``text``)."""
    spark: SparkSession = docs.sparkSession
    cut = staged(pieces(docs, tokenizer or default_tokenizer(), length, end_id))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    placed = slots(shortest_pack_first(histogram, length))
    table = spark.createDataFrame(placed, "size long, from_rank long, to_rank long, times long, first_sequence long, first_offset long")

    # rank inside a length: rank inside a bucket of it, after all smaller buckets; as many buckets as rows in one
    buckets = 1 + math.isqrt(sum(histogram.values()))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    found = ranked.join(F.broadcast(table), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    step = F.col("rank") - F.col("from_rank")
    sequence = (F.col("first_sequence") + F.floor(step / F.col("times"))).cast("long").alias("sequence_id")
    offset = (F.col("first_offset") + step % F.col("times") * F.col("length")).cast("long").alias("offset")
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence, offset)
