"""Quality classifier by compression: how much better does a text compress after good text than after bad?

Two zstandard dictionaries are built from labelled text, one of each label. A text is compressed block by block with
both; the normalised difference of the two sizes, and the sizes a byte, go through a logistic function that
is fitted on labelled documents kept apart from the dictionaries.

The fit uses bounded samples, chosen by a hash: ``blocks`` blocks of the texts of ``rows`` labelled documents a label for the
dictionaries, and ``rows`` others a label for the calibration. Scoring covers every document and whole texts.

A text that is null or empty scores 0. Without labelled rows of both kinds, every other text scores the
share of good ones (0.5 if there are no labels). Labels that are null are not used; of a document with
several labels each counts. Repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import held_out, labelled_sample, slices, staged

FOLDS, HELD_OUT = 5, 0
CUT = 0.3
BLOCK_CHARS = 2000
BLOCK_BYTES = 4096
BLOCKS = 3000
ROWS = 2500
DICT_BYTES = 64 << 10
LEVEL = 3
SIZES = ("_raw", "_good", "_bad")


def dictionary(blocks: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained zstandard dictionary; of too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data) if data else None, write_content_size=False, write_dict_id=False)


def sizes(docs: DataFrame, good: bytes, bad: bytes, *keep: str) -> DataFrame:
    """The columns ``keep``, and the bytes of each text: as they are (``_raw``), and compressed after good (``_good``) and after bad text (``_bad``)."""
    schema = docs.select(*keep).schema
    for name in SIZES:
        schema = schema.add(name, "long")

    def run(batches):
        tools = [_compressor(d) for d in (good, bad)]
        for batch in batches:
            out = np.zeros((batch.num_rows, 3), np.int64)
            for at, _, data, offsets in slices(batch.column("text")):
                for i in range(len(offsets) - 1):
                    text = data[offsets[i] : offsets[i + 1]]
                    out[at + i, 0] = len(text)
                    for start in range(0, len(text), BLOCK_BYTES):
                        block = text[start : start + BLOCK_BYTES].tobytes()
                        for k, tool in enumerate(tools):
                            out[at + i, k + 1] += len(tool.compress(block))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(out[:, k]) for k in range(3))], names=[*keep, *SIZES])

    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def _features() -> list[Column]:
    n, good, bad = (F.col(c).cast("double") for c in SIZES)
    plain = [(good - bad) / (good + bad), F.log(good / n), F.log(bad / n)]
    return [*plain, *(x * x for x in plain)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights, the constant last, by Newton's method; both labels weigh the same."""
    x = np.column_stack((x, np.ones(len(x))))
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (p - y)) + ridge * w
        curve = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, known: DataFrame, blocks: int = BLOCKS, rows: int = ROWS) -> tuple[bytes, bytes, Column]:
    """The good and the bad dictionary, and the score as a column over what ``sizes`` returns.

    ``known`` has ``doc_id, label``. Half of the ids serve the dictionaries, the others the calibration.
    """
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(2))
    usable = staged(labelled_sample(docs, known.where(part == 0), rows).where("length(text) > 0"))
    last = F.floor((F.length("text") - 1) / BLOCK_CHARS).cast("int")
    cut = usable.select("label", "text", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("label", F.expr(f"substring(text, at * {BLOCK_CHARS} + 1, {BLOCK_CHARS})").alias("block"))
    found = [[r["block"].encode() for r in cut.where(F.col("label") == label).orderBy(F.xxhash64("block"), "block").limit(blocks).select("block").collect()] for label in (1, 0)]
    good, bad = map(dictionary, found)
    chosen = labelled_sample(docs, known.where(part == 1), rows).where("length(text) > 0")
    table = sizes(chosen, good, bad, "label").select("label", *(f.alias(f"x{i}") for i, f in enumerate(_features()))).collect()
    data = np.array([list(r) for r in table], float).reshape(len(table), 7)
    y, x = data[:, 0], data[:, 1:]
    if len(set(y)) < 2 or not all(found):
        return good, bad, F.lit(float(y.mean()) if len(y) else 0.5)
    middle, width = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = logistic((x - middle) / width, y)
    total = F.lit(float(w[-1]))
    for f, a, m, s in zip(_features(), w, middle, width):
        total = total + (f - float(m)) * float(a / s)
    return good, bad, F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _score(docs: DataFrame, labels: DataFrame, folds: int, fold: int, blocks: int, rows: int) -> tuple[bytes, bytes, Column]:
    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id"), folds, fold))
    good, bad, score = fit(docs, known, blocks, rows)
    return good, bad, F.when(F.col("_raw") == 0, F.lit(0.0)).otherwise(score)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT, cut: float = CUT, blocks: int = BLOCKS, rows: int = ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id``, ``text``).

    ``labels`` (``doc_id``, ``quality``) is used only for rows that are not held out.
    """
    good, bad, score = _score(docs, labels, folds, fold, blocks, rows)
    scored = sizes(docs, good, bad, "doc_id").select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT, cut: float = CUT, blocks: int = BLOCKS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, as they are; no row is shuffled."""
    good, bad, score = _score(docs, labels, folds, fold, blocks, rows)
    return sizes(docs, good, bad, *docs.columns).where(score >= cut).select(*docs.columns)
