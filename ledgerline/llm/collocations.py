"""Phrase collocation mining with weighted acyclic automata.

A phrase is a path of words; the weight of the state that it ends in is its count. (Weights sit on states, so
only beginnings are shared: the automaton is a tree.)

1. A *shard*, a run of texts in one task, sorts its windows of words and builds its count transducer from
   them depth by depth. The transducer is cut by the range that a phrase's first words fall into.
2. All parts of a range meet in one task, which unites them: vocabularies are merged as strings, equal paths
   become one, their weights are summed. States below the least count go. No hash decides equality.
3. That is done three times: for words; for pairs of words that are both frequent; for three to five words whose pairs
   are all frequent. A phrase cannot be more frequent than its parts, so nothing is lost. What is frequent
   is told to the shards by a Bloom filter of at most ``MOST_BITS`` bits, whatever the size of the corpus; a word that it
   takes for frequent by mistake costs a state that the union removes, and changes no count.
4. The parts of candidate phrases are looked up by composition: the distinct parts go to the automaton of their range, and are
   walked through it together.

A range is that of a hash of the first one, two or three words (by pass), so the many phrases of one frequent word or pair
are in many ranges, and a shard sends one state for a phrase however often it has it. The number of ranges
grows with the bytes of text.

Text is lower-cased in A-Z, cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. A null text is
empty, a null language ``und``; rows without words give nothing; rows that are repeated count each. Ids and other columns are not
read. Whole texts are read in runs of about ``SHARD_BYTES``, a longer text alone. Empty tables give no rows.
Equal scores: higher count, then the phrase in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import U, mix, slices, staged, word_bounds, word_hashes

LEAST, LONGEST, TOP = 100, 5, 2000
SHARD_BYTES, RANGE_BYTES, LEAST_RANGES = 4 << 20, 24 << 20, 8
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?\n\x0b\x0c\r"]] = True
_SPACE = _CUT.copy()
_SPACE[[0x20, 0x09]] = True
_STEP = U(0x9E3779B97F4A7C15)

#: ``sizes`` has the number of states of each depth, ``packed`` the words and the states.
AUTOMATON = "lang string, range int, sizes array<int>, packed binary"


# ---- words of a shard --------------------------------------------------------------------------


@dataclass
class Shard:
    words: pa.Array  # distinct, in byte order
    hashes: np.ndarray
    codes: np.ndarray  # of each word in the texts
    langs: list[str]
    lang: np.ndarray
    follows: np.ndarray  # whether the next word is in the same piece


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hashes_of(words: pa.Array) -> np.ndarray:
    data, offsets = _bytes_of(words)
    return word_hashes(data, offsets[:-1], offsets[1:])


def _sorted_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in byte order, and the place of each given word among them."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def shards(batch: pa.RecordBatch, most: int = SHARD_BYTES) -> Iterator[Shard]:
    """The words of a batch (``text``, ``lang``) in runs of whole texts."""
    for at, to, data, offsets in slices(batch.column("text"), most):
        data = _LOWER[data]
        starts, ends, before = word_bounds(data, offsets, _SPACE)
        if not len(starts):
            continue
        text = data[~_SPACE[data]]
        ends_at = np.concatenate(([0], np.cumsum(ends - starts)))
        words, codes = _sorted_words(pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(text)]))
        row = np.repeat(np.arange(to - at), np.diff(before))
        piece = np.searchsorted(np.flatnonzero(_CUT[data]), starts) + row
        lang = batch.column("lang").slice(at, to - at).dictionary_encode()
        follows = np.append(piece[1:] == piece[:-1], False)
        del starts, ends, ends_at, data, text, piece
        yield Shard(words, hashes_of(words), codes, lang.dictionary.to_pylist(), lang.indices.to_numpy()[row].astype(np.int64), follows)


def _states(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the place of each key."""
    codes, distinct = pd.factorize(key)
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[codes]


def chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a path and one more word."""
    return mix(before * _STEP + word)


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return mix(hashes_of(pa.array(langs, pa.large_string())))


# ---- what is frequent ------------------------------------------------------------------------


class Bloom:
    """A set of hashes, two bits each; may also hold others."""

    def __init__(self, slots: np.ndarray):
        self.slots, self.mask = slots, U(len(slots) * 64 - 1)

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = U(bits - 1)
        return hashes & mask, (hashes >> U(32)) & mask

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in self.places(hashes, len(self.slots) * 64):
            found &= (self.slots[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) == 1
        return found


def _bits_for(count: int, most: int) -> int:
    bits = LEAST_BITS
    while bits < min(most, BITS_EACH * count):
        bits *= 2
    return bits


def bloom(automata: DataFrame, depth: int, most: int = MOST_BITS) -> Bloom:
    """The paths of ``depth`` words of all automata; bits are set by Spark, and only they reach the driver."""
    bits = _bits_for(automata.agg(F.sum(F.col("sizes")[depth - 1])).first()[0] or 0, most)

    def run(batches):
        for batch in batches:
            for row in _automata(pa.Table.from_batches([batch])):
                for place in Bloom.places(row.hashes()[depth], bits):
                    slot, order = _states((place >> U(6)).astype(np.int64))
                    value = np.zeros(len(slot), np.uint64)
                    np.bitwise_or.at(value, order, U(1) << (place & U(63)))
                    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(value.view(np.int64))], names=["slot", "bits"])

    found = automata.mapInArrow(run, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots = np.zeros(bits // 64, np.uint64)
    slots[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Bloom(slots)


def _kept(shard: Shard, filters: list[Bloom]) -> np.ndarray:
    """How many words a window may have at each place: the longest whose parts the filters know (0: none)."""
    n = len(shard.codes)
    reach = np.ones(n, np.int64)
    if not filters:
        return reach
    v, lang = len(shard.words), _lang_hashes(shard.langs)
    key, state = _states(shard.lang * v + shard.codes)
    own = chained(lang[key // v], shard.hashes[key % v])
    word = filters[0].has(own)[state]
    pair = word & np.append(word[1:], False) & shard.follows
    if len(filters) > 1:
        at = np.flatnonzero(pair)
        key, state = _states(state[at] * v + shard.codes[at + 1])
        pair[at] = filters[1].has(chained(own[key // v], shard.hashes[key % v]))[state]
    reach = np.where(pair, 2, 0)
    run = pair
    for d in range(3, LONGEST + 1) if len(filters) > 1 else ():
        run = run & np.append(pair[d - 2 :], np.zeros(d - 2, bool))
        reach[run] = d
    return reach


# ---- automata ---------------------------------------------------------------------------------


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def shard_automata(shard: Shard, filters: list[Bloom], ranges: int) -> pa.RecordBatch:
    """The count transducer of a shard's windows, one automaton for each language and range."""
    first = len(filters) + 1
    last = LONGEST if first == 3 else first
    v, reach = len(shard.words), _kept(shard, filters)
    at = np.flatnonzero(reach >= first)
    state, levels, hashes = shard.lang[at], [], _lang_hashes(shard.langs)
    for depth in range(1, last + 1):
        if depth > first:
            on = reach[at] >= depth
            at, state = at[on], state[on]
        key, state = _states(state * v + shard.codes[at + depth - 1])
        parent, label = key // v, key % v
        hashes = chained(hashes[parent], shard.hashes[label])
        owner = parent if depth == 1 else levels[-1]["lang"][parent]
        levels.append({"parent": parent, "label": label, "lang": owner, "weight": np.bincount(state, minlength=len(key))})
        if depth == first:
            levels[-1]["root"] = owner * ranges + ((hashes >> U(20)) % U(ranges)).astype(np.int64)
        elif depth > first:
            levels[-1]["root"] = levels[-2]["root"][parent]
    for depth in range(first - 1, 0, -1):  # beginnings that several ranges share
        below, own = levels[depth], levels[depth - 1]
        key, below["parent"] = _states(below["root"] * len(own["label"]) + below["parent"])
        old = key % max(1, len(own["label"]))
        levels[depth - 1] = {"root": key // max(1, len(own["label"])), "parent": own["parent"][old], "label": own["label"][old], "weight": np.zeros(len(key), np.int64)}
    return _packed(levels, shard.words, lambda roots: (pa.array(shard.langs, pa.string()).take(pa.array(roots // ranges)), pa.array((roots % ranges).astype(np.int32))))


def _narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width that holds them all, after that width and their count."""
    low, high = int(numbers.min(initial=0)), int(numbers.max(initial=0))
    kind = next(k for k in ("i1", "i2", "i4", "i8") if -(1 << 8 * int(k[1]) - 1) <= low and high < 1 << 8 * int(k[1]) - 1)
    return np.array([int(kind[1]), len(numbers)], "<i8").tobytes() + numbers.astype(f"<{kind}").tobytes()


def _pack(words: pa.Array, states: list[dict]) -> bytes:
    """Words and states of one automaton, compressed; parents never decrease, so their steps are small."""
    data, offsets = _bytes_of(words)
    parts = [np.diff(offsets), data.view(np.int8)]
    for level in states:
        parts += [np.diff(level["parent"], prepend=0), level["label"], level["weight"]]
    return zstandard.compress(b"".join(map(_narrow, parts)), 1)


def _unpack(packed: bytes) -> tuple[pa.Array, list[dict]]:
    data, at, parts = zstandard.decompress(packed), 0, []
    while at < len(data):
        width, count = np.frombuffer(data, "<i8", 2, at)
        parts.append(np.frombuffer(data, f"<i{width}", count, at + 16).astype(np.int8 if len(parts) == 1 else np.int64))
        at += 16 + int(width * count)
    offsets = _starts(parts[0])
    words = pa.Array.from_buffers(pa.large_string(), len(parts[0]), [None, pa.py_buffer(offsets), pa.py_buffer(parts[1])])
    return words, [{"parent": np.cumsum(p), "label": l, "weight": w} for p, l, w in zip(parts[2::3], parts[3::3], parts[4::3])]


def _packed(levels: list[dict], words: pa.Array, named) -> pa.RecordBatch:
    """Rows of ``AUTOMATON``: one for each root, its states in order of depth and root."""
    roots = np.unique(levels[0]["root"])
    above = None
    for level in levels:
        order = np.argsort(level["root"], kind="stable")
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        parent = level["parent"] if above is None else above["moved"][level["parent"]]
        parent, level["label"], level["weight"] = parent[order], level["label"][order], level["weight"][order]
        place = np.searchsorted(roots, level["root"][order])
        level["parent"] = np.zeros(len(order), np.int64) if above is None else parent - above["from"][place]
        level |= {"moved": moved, "from": _starts(np.bincount(place, minlength=len(roots)))}
        above = level
    cells = []
    for i in range(len(roots)):
        own = [{n: x[n][x["from"][i] : x["from"][i + 1]] for n in ("parent", "label", "weight")} for x in levels]
        known, label = np.unique(np.concatenate([x["label"] for x in own]), return_inverse=True)
        for x, part in zip(own, np.split(label, _starts(np.array([len(x["label"]) for x in own]))[1:-1])):
            x["label"] = part
        cells.append(_pack(words.take(pa.array(known)), own))
    sizes = np.array([np.diff(x["from"]) for x in levels], np.int32).T
    lang, range_no = named(roots)
    offsets = pa.array(np.arange(len(roots) + 1) * len(levels), pa.int32())
    columns = [lang, range_no, pa.ListArray.from_arrays(offsets, pa.array(sizes.ravel())), pa.array(cells, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "range", "sizes", "packed"])


@dataclass
class Automaton:
    lang: str
    words: pa.Array
    levels: list[dict]  # parent, label, weight of the states of each depth

    def hashes(self) -> list[np.ndarray]:
        """Path hashes by depth, from 0, the root."""
        own, out = hashes_of(self.words), [_lang_hashes([self.lang])]
        for level in self.levels:
            out.append(chained(out[-1][level["parent"]], own[level["label"]]))
        return out

    def paths(self) -> list[np.ndarray]:
        """Labels of the path to each state, by depth."""
        out = [np.zeros((1, 0), np.int64)]
        for level in self.levels:
            out.append(np.column_stack([out[-1][level["parent"]], level["label"]]))
        return out[1:]

    def walk(self, words: list[pa.Array]) -> np.ndarray:
        """Weights of paths, all of as many words as lists are given (a list for each depth); 0 for those not here."""
        v, state = max(1, len(self.words)), np.zeros(len(words[0]), np.int64)
        weight = np.zeros(0, np.int64)
        for level, column in zip(self.levels, words):
            code = pc.index_in(column, self.words).fill_null(-1).to_numpy().astype(np.int64)
            keys, wanted = level["parent"].astype(np.int64) * v + level["label"], state * v + code
            place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            here = (state >= 0) & (code >= 0) & (keys[place] == wanted) if len(keys) else np.zeros(len(state), bool)
            state = np.where(here, place, -1)
            weight = np.where(here, level["weight"][place], 0) if len(keys) else np.zeros(len(state), np.int64)
        return weight


def _automata(rows: pa.Table) -> Iterator[Automaton]:
    for lang, packed in zip(rows["lang"].to_pylist(), rows["packed"]):
        yield Automaton(lang, *_unpack(packed.as_buffer()))


def united(rows: pa.Table, first: int, least: int) -> tuple[pa.RecordBatch, int]:
    """The union of automata of one language and range without states below ``least``, and the sum of all weights at depth ``first``."""
    parts = list(_automata(rows))
    words, code = _sorted_words(pa.concat_arrays([p.words for p in parts]))
    code = np.split(code, _starts(np.array([len(p.words) for p in parts]))[1:-1])
    v, above, levels, total = max(1, len(words)), [np.zeros(1, np.int64) for _ in parts], [], 0
    for depth in range(len(parts[0].levels)):
        key = [a[p.levels[depth]["parent"]] * v + c[p.levels[depth]["label"]] for p, a, c in zip(parts, above, code)]
        distinct, place = _states(np.concatenate(key))
        weight = np.zeros(len(distinct), np.int64)
        np.add.at(weight, place, np.concatenate([p.levels[depth]["weight"] for p in parts]))
        above = np.split(place, _starts(np.array([len(k) for k in key]))[1:-1])
        levels.append({"parent": distinct // v, "label": distinct % v, "weight": weight, "root": np.zeros(len(distinct), np.int64)})
        total = int(weight.sum()) if depth + 1 == first else total
    keep = levels[-1]["weight"] >= least
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        if depth:
            used = np.zeros(len(levels[depth - 1]["label"]), bool)
            used[level["parent"][keep]] = True
            moved = np.cumsum(used | (levels[depth - 1]["weight"] >= least)) - 1
        levels[depth] = {n: x[keep] for n, x in level.items()}
        if depth:
            levels[depth]["parent"] = moved[levels[depth]["parent"]]
            keep = used | (levels[depth - 1]["weight"] >= least)
    lang, range_no = rows["lang"][0].as_py(), rows["range"][0].as_py()
    if not len(levels[0]["label"]):  # an automaton without states is one row too: its total counts
        packed = _pack(words.slice(0, 0), [{n: np.zeros(0, np.int64) for n in ("parent", "label", "weight")} for _ in levels])
        return pa.RecordBatch.from_pylist([{"lang": lang, "range": range_no, "sizes": [0] * len(levels), "packed": packed}], schema=_SCHEMA), total
    return _packed(levels, words, lambda roots: (pa.array([lang], pa.string()), pa.array([range_no], pa.int32()))), total


_SCHEMA = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("sizes", pa.list_(pa.int32())), ("packed", pa.binary())])


def count_automata(docs: DataFrame, filters: list[Bloom], ranges: int, least: int) -> DataFrame:
    """Staged rows of ``AUTOMATON`` and ``total``: phrases of 1, of 2 or of 3 to 5 words, by the number of filters."""
    first = len(filters) + 1

    def build(batches):
        for batch in batches:
            for shard in shards(batch):
                made = shard_automata(shard, filters, ranges)
                if made.num_rows:
                    yield made

    def unite(rows: pa.Table) -> pa.Table:
        made, total = united(rows, first, least)
        return pa.Table.from_batches([made]).append_column("total", pa.array([total], pa.int64()))

    parts = docs.mapInArrow(build, AUTOMATON)
    return staged(parts.groupBy("lang", "range").applyInArrow(unite, f"{AUTOMATON}, total long"))


def phrases(automata: DataFrame, first: int) -> DataFrame:
    """``lang, words, f`` of every path of ``first`` words or more."""

    def run(batches):
        for batch in batches:
            for own in _automata(pa.Table.from_batches([batch])):
                for depth, codes in enumerate(own.paths(), 1):
                    if depth >= first and len(codes):
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * depth, pa.int32()), own.words.take(pa.array(codes.ravel())).cast(pa.string()))
                        yield pa.RecordBatch.from_arrays([pa.array([own.lang] * len(codes)), lists, pa.array(own.levels[depth - 1]["weight"])], names=["lang", "words", "f"])

    return automata.mapInArrow(run, "lang string, words array<string>, f long")


def looked_up(parts: DataFrame, automata: DataFrame, ranges: int) -> DataFrame:
    """``lang, part, f`` of distinct parts (``lang``, ``words``): each is walked through the automaton of its pass and range."""

    def route(batches):
        for batch in batches:
            lists = batch.column("words")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            own, starts = hashes_of(lists.flatten().cast(pa.large_string())), _starts(sizes)
            langs = batch.column("lang").dictionary_encode()
            state = _lang_hashes(langs.dictionary.to_pylist())[langs.indices.to_numpy()]
            first = np.minimum(sizes, 3)
            for depth in range(3):
                on = first > depth
                state[on] = chained(state[on], own[starts[:-1][on] + depth])
            places = ((state >> U(20)) % U(ranges)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(first.astype(np.int32)), pa.array(places), lists], names=["lang", "first", "range", "part"])

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            own = next(_automata(right))
            lists = left["part"].combine_chunks()
            sizes = lists.value_lengths().to_numpy()
            for size in np.unique(sizes):
                chosen = left.filter(pa.array(sizes == size))
                flat = chosen["part"].combine_chunks().flatten().cast(pa.large_string())
                weight = own.walk([flat.take(pa.array(np.arange(d, len(flat), size))) for d in range(size)])
                out.append(pa.table({"lang": chosen["lang"], "part": chosen["part"], "f": pa.array(weight, pa.int64())}))
        return pa.concat_tables(out) if out else pa.schema([("lang", pa.string()), ("part", pa.list_(pa.string())), ("f", pa.int64())]).empty_table()

    keys = ["lang", "first", "range"]
    routed = parts.mapInArrow(route, "lang string, first int, range int, part array<string>")
    return routed.groupBy(*keys).cogroup(automata.groupBy(*keys)).applyInArrow(compose, "lang string, part array<string>, f long")


# ---- the operator -------------------------------------------------------------------------------


def count_phrases(docs: DataFrame, least: int = LEAST, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame, int]:
    """Automata of all passes (with ``first``), the number of words by language (``lang, n``), and the number of ranges."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    words = count_automata(rows, [], ranges, least)
    filters = [bloom(words, 1, most_bits)]
    pairs = count_automata(rows, filters, ranges, least)
    filters.append(bloom(pairs, 2, most_bits))
    longer = count_automata(rows, filters, ranges, least)
    both = words.withColumn("first", F.lit(1)).union(pairs.withColumn("first", F.lit(2))).union(longer.withColumn("first", F.lit(3)))
    return both, words.groupBy("lang").agg(F.sum("total").alias("n")), ranges


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, most_bits: int = MOST_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language of ``docs`` (``text``, ``lang``).

    Candidates are phrases of 2 to 5 words that occur ``least`` times or more; the score is that of the worst cut. A phrase
    inside a longer one that is as frequent gives way to it.
    """
    automata, totals, ranges = count_phrases(docs, least, most_bits)
    found = None
    for first in (2, 3):
        own = phrases(automata.where(F.col("first") == first), first)
        found = own if found is None else found.union(own)
    candidates = staged(found.select("lang", "words", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.size("words").alias("k")))

    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", "words", "a", "k", cut)
    cuts = cuts.select("lang", "phrase", "a", "cut", F.slice("words", F.lit(1), F.col("cut")).alias("head"), F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    parts = cuts.select("lang", F.col("head").alias("words")).union(cuts.select("lang", F.col("rest").alias("words"))).distinct()
    counts = staged(looked_up(parts, automata, ranges))
    heads, rests = (counts.select("lang", F.col("part").alias(x), F.col("f").alias(y)) for x, y in (("head", "l"), ("rest", "r")))
    whole = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    # exact whole numbers of 38 digits; each factor is far below its width
    number = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    whole = whole.withColumn("over", number("a", 17) * F.lit(1000).cast("decimal(4,0)") * number("n", 17)).withColumn("under", number("l", 17) * number("r", 17))
    scored = whole.withColumn("score", F.expr("over div under"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "n", "a")).alias("w"))

    # of the phrases that hold one, those of one word more are enough: counts never grow on the way
    inner = candidates.where("k > 2").select("lang", "a", F.explode(F.array(F.slice("words", F.lit(1), F.col("k") - 1), F.slice("words", F.lit(2), F.col("k") - 1))).alias("inside"))
    inner = inner.groupBy("lang", F.array_join("inside", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = worst.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < w.a").select("lang", "phrase", "w.a", "w.l", "w.r", "w.n", "w.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for key in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(64))], ["lang"]):  # a language's best are among the best of its shares
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in SQL.
COLLOCATIONS_SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
),
lists AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM pieces
),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM lists GROUP BY lang),
windows AS (
    SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
    FROM lists, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(words) >= k
),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM windows GROUP BY ALL HAVING count(*) >= {LEAST}),
candidates AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS words FROM counts WHERE k >= 2),
cuts AS (
    SELECT *, array_to_string(words[1:cut], ' ') AS head, array_to_string(words[cut + 1:k], ' ') AS rest
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.cut, h.f AS l, t.f AS r, n, CAST(1000::HUGEINT * c.a * n // (h.f::HUGEINT * t.f) AS BIGINT) AS score
    FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.rest JOIN totals o ON o.lang = c.lang
),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
    SELECT lang, phrase, max(a) AS a FROM (
        SELECT lang, a, array_to_string(words[1:k - 1], ' ') AS phrase FROM candidates WHERE k > 2
        UNION ALL SELECT lang, a, array_to_string(words[2:k], ' ') FROM candidates WHERE k > 2
    ) GROUP BY ALL
)
SELECT w.lang, CAST(row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, w.phrase) AS INTEGER) AS rank, w.phrase, w.a, l, r, n, score
FROM worst w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase
WHERE o.a IS NULL OR o.a < w.a
QUALIFY rank <= {TOP}
"""
