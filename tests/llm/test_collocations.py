import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, words), a in candidates.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words):
                    inside[lang, words[i:j]] = max(inside[lang, words[i:j]], a)
    out = {}
    for (lang, words), a in candidates.items():
        if inside[lang, words] >= a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right, n[lang]))
    return {(lang, i, p.decode(), -a, left, right, m, -s) for lang, own in out.items() for i, (s, a, p, left, right, m) in enumerate(sorted(own)[:top], 1)}


def result(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


def texts(n, seed=4):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "New", "in", "é日", "a", "b", "c|d", "-", "x y", "\x00"]
    passage = "once upon a time there was a king of york"
    rows = []
    for i in range(n):
        own = [rng.choice(words) + rng.choice([" "] * 6 + [". ", "\t", "\n", ",  ", "\r\n"]) for _ in range(rng.randrange(0, 60))]
        rows.append((i, "".join(own) + (passage if i % 3 == 0 else ""), rng.choice(["en", "de", None, ""])))
    return rows


@pytest.mark.parametrize("least,top", [(2, 5000), (5, 7), (12, 100)])
def test_same_as_brute_force(spark, least, top, monkeypatch):
    monkeypatch.setattr(co, "RANGE_BYTES", 500)
    rows = texts(120)
    expected = brute(rows, least, top)
    assert expected and result(co.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least, top)) == expected


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """Where the Bloom filter takes everything for frequent, only the automata grow."""
    monkeypatch.setattr(co, "LEAST_BITS", 64)
    rows = texts(60, seed=9)
    assert result(co.collocations(spark.createDataFrame(rows, SCHEMA), 3, 1000, most_bits=64)) == brute(rows, 3, 1000)


def test_odd_rows(spark, odd, none):
    from pyspark.sql import functions as F

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.select("doc_id", "text", "lang").collect()]
    clash = odd.withColumn("words", F.lit(1)).withColumn("range", F.lit(2)).withColumn("f", F.lit(3)).withColumn("rank", F.lit(4)).withColumn("phrase", F.lit("x"))
    assert result(co.collocations(clash, 100, 2000)) == brute(rows, 100, 2000)
    assert result(co.collocations(clash, 2, 50)) == brute(rows, 2, 50)
    assert co.collocations(none).count() == 0
    assert co.collocations(none.union(odd.select(*none.columns).where("text is null"))).count() == 0


def test_products_beyond_64_bits(spark):
    """a * n * 1000 is about 10 ** 21 where counts stand for themselves: the score's arithmetic is that of wide decimals."""
    row = spark.sql("select cast(4000000000000 as decimal(17,0)) * cast(1000 as decimal(4,0)) * cast(90000000000000 as decimal(17,0)) as over, cast(5000000000000 as decimal(17,0)) * cast(6000000000000 as decimal(17,0)) as under")
    assert row.selectExpr("over div under as s").first()[0] == 4000000000000 * 1000 * 90000000000000 // (5000000000000 * 6000000000000)


def test_shard_automaton_has_every_window():
    batch = pa.RecordBatch.from_pydict({"text": ["a b a b. a", "b a", None], "lang": ["x", "x", "y"]}, schema=pa.schema([("text", pa.string()), ("lang", pa.string())]))
    (shard,) = co.shards(batch)
    everything = co.Bloom(np.full(2, ~np.uint64(0)))
    made = co.shard_automata(shard, [everything], 1)
    (own,) = co._automata(pa.Table.from_batches([made]))
    paths = {" ".join(own.words.take(pa.array(p)).to_pylist()): int(w) for p, w in zip(own.paths()[1], own.levels[1]["weight"])}
    assert paths == {"a b": 2, "b a": 2}
    assert own.walk([pa.array(["b", "a", "q", "a"], pa.large_string()), pa.array(["a", "a", "a", "b"], pa.large_string())]).tolist() == [2, 0, 0, 2]
    deep = co.shard_automata(shard, [everything, everything], 3)
    counts = Counter()
    for own in co._automata(pa.Table.from_batches([deep])):
        for level, codes in zip(own.levels[2:], own.paths()[2:]):
            counts.update({" ".join(own.words.take(pa.array(p)).to_pylist()): int(w) for p, w in zip(codes, level["weight"])})
    assert counts == {"a b a": 1, "b a b": 1, "a b a b": 1}


def test_union_sums_and_drops():
    batch = lambda *t: pa.RecordBatch.from_pydict({"text": list(t), "lang": ["x"] * len(t)}, schema=pa.schema([("text", pa.string()), ("lang", pa.string())]))
    parts = [co.shard_automata(next(co.shards(batch(t))), [], 1) for t in ("a a b", "b c", "a d")]
    made, total = co.united(pa.Table.from_batches(parts), 1, 2)
    (own,) = co._automata(pa.Table.from_batches([made]))
    assert dict(zip(own.words.to_pylist(), own.levels[0]["weight"].tolist())) == {"a": 3, "b": 2} and total == 7
