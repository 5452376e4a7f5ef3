"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one binary classifier for each bit reads hashed character n-grams.
The language whose codeword loses least, each bit weighted by how well its classifier does on what it
learned from, is chosen; a near tie is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarray.llm import tables
from lexarray.llm.kernels import LOWER, chunks

_CELLS = 1 << 16
_ORDERS = (2, 3, 4)

#: a-z and bytes beyond ASCII as they are, all others a space.
_LETTERS = np.where((np.arange(256) >= 128) | ((np.arange(256) >= 97) & (np.arange(256) <= 122)), np.arange(256), 32).astype(np.uint8)


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1, far apart: all bits that split up to six languages, seeded random ones for more."""
    if n <= 6:
        bits = [[1 if k == 0 or (j >> (k - 1)) & 1 else -1 for k in range(n)] for j in range((1 << (n - 1)) - 1)] if n > 1 else [[1]]
        return np.array(bits, dtype=np.float32).T.copy()
    best, rng, width = None, np.random.default_rng(7), int(10 * np.ceil(np.log2(n)))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        far = (code @ code.T - 2 * code.shape[1] * np.eye(n)).max()
        if best is None or far < best[0]:
            best = (far, code)
    return best[1]


def _grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the cell of every n-gram and where each text's begin; texts are apart, other characters than letters are spaces."""
    data = _LETTERS[data]
    high = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    data[high] += 0x20  # accented capitals of Western European languages
    x = data.astype(np.uint32)
    for n in _ORDERS:
        h = np.zeros(max(0, len(x) - n + 1), np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ x[k : len(x) - n + 1 + k]
        h = h * np.uint32(0x9E3779B1)
        start = np.minimum(at[:-1], len(h))
        stop = np.maximum(start, np.minimum(at[1:] - n + 1, len(h)))
        yield (h >> np.uint32(16)).astype(np.int64), np.stack([start, stop])


#: Languages that are counted in one pass: what a task holds and sends has so many times 3 * 65,536 cells at most.
_BLOCK = 64


def _counts(rows: DataFrame, langs: list[str]) -> np.ndarray:
    """How often each cell's n-grams occur in the texts of each of some languages."""
    size = len(langs) * len(_ORDERS) * _CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), len(_ORDERS), _CELLS), np.uint32)
        place = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            of = [place[x] for x in batch.column(0).to_pylist()]
            for i, _, data, at in chunks(batch.column(1), LOWER):
                for o, (cells, (start, stop)) in enumerate(_grams(data, at)):
                    for k in range(len(start)):
                        if stop[k] > start[k]:
                            found, n = np.unique(cells[start[k] : stop[k]], return_counts=True)
                            counts[of[i + k], o, found] += n.astype(np.uint32)
        yield from tables.emit(counts.reshape(-1))

    own = rows.where(F.col("lang").isin(langs))
    return tables.merge(own.mapInArrow(run, "block int, cells binary"), size, np.uint32, add=True).reshape(len(langs), len(_ORDERS) * _CELLS)


def learn(rows: DataFrame, langs: list[str], smooth: float = 0.5, block: int = _BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codewords, weights by order, cell and bit, weights of the bits) from rows (lang, text), all of them.

    Languages are counted in blocks, one pass over their rows each, and kept as the cells that they have; what is sent
    to the workers has 3 * 65,536 cells for each bit, and bits grow with the logarithm of the languages.
    """
    held = []
    for k in range(0, len(langs), block):
        for row in _counts(rows, langs[k : k + block]):
            cells = np.flatnonzero(row)
            held.append((cells, row[cells].astype(np.float64)))

    def share(i: int) -> np.ndarray:
        """Each language counts alike, however much of it there is."""
        out = np.full(len(_ORDERS) * _CELLS, smooth)
        out[held[i][0]] += held[i][1]
        out = out.reshape(len(_ORDERS), _CELLS)
        return out / out.sum(1, keepdims=True)

    code = codewords(len(langs))
    yes = np.zeros((len(_ORDERS), _CELLS, code.shape[1]))
    no = np.zeros_like(yes)
    for i in range(len(langs)):
        own = share(i)
        yes[:, :, code[i] > 0] += own[:, :, None]
        no[:, :, code[i] < 0] += own[:, :, None]
    n_yes, n_no = (code > 0).sum(0), (code < 0).sum(0)
    weights = np.log(yes / n_yes / np.where(n_no > 0, no / np.maximum(n_no, 1), 1 / _CELLS)).astype(np.float32)
    # how far a bit's margin of each language lies on its right side, on average over the n-grams learned
    right = np.stack([np.einsum("oc,ocb->b", share(i), weights) * code[i] for i in range(len(langs))])
    trust = np.maximum(right.min(0), 0) + 1e-3
    return code, weights, (trust / trust.sum()).astype(np.float64)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2, sharpness: float = 3.0, tie: float = 0.1, block: int = _BLOCK) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and ambiguous for every row of docs.

    Learns from the text and non-null language of all rows whose crc32(doc_id as text) mod folds is not
    held_fold; only the text is an input of a prediction. score: the share of the chosen language in
    exp(-loss); ambiguous: the runner-up's score is within `tie`.

    Cases: null texts and texts without a letter are `und` with score 0, and so are all where nothing was
    learned; rows without doc_id are not learned from and not held out; repeated rows are learned from once each
    and predicted alike; an empty table gives no rows. Texts of any length are read whole, and any number
    of languages is learned.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    learned = rows.where((fold != held_fold) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    langs = [r[0] for r in learned.select("lang").distinct().orderBy("lang").collect()]  # a row a language
    model = tables.sent(spark, learn(learned, langs, block=block) if langs else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if langs:
            code, weights, trust = model.value
        for batch in batches:
            n = len(batch.column(0))
            letters = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            best, score, near = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
            for i, j, data, at in chunks(batch.column(2), LOWER) if langs else ():
                total, seen = np.zeros((j - i, code.shape[1])), np.zeros(j - i)
                for o, (cells, (start, stop)) in enumerate(_grams(data, at)):
                    sums = np.zeros((len(cells) + 1, code.shape[1]), np.float32)
                    np.take(weights[o], cells, axis=0, out=sums[:-1])
                    full = np.flatnonzero(stop > start)
                    if len(full):
                        bounds = np.stack([start[full], stop[full]], 1).reshape(-1)
                        total[full] += np.add.reduceat(sums, bounds, axis=0, dtype=np.float64)[::2]
                        seen[full] += (stop - start)[full]
                margin = np.clip(sharpness * total / np.maximum(seen, 1)[:, None], -3, 3)
                loss = (trust * np.exp(-margin[:, None, :] * code[None])).sum(2)
                like = np.exp(-2 * (loss - loss.min(1, keepdims=True)))
                like /= like.sum(1, keepdims=True)
                order = np.argsort(-like, axis=1, kind="stable")
                best[i:j] = order[:, 0]
                score[i:j] = like[np.arange(j - i), order[:, 0]]
                near[i:j] = (score[i:j] - like[np.arange(j - i), order[:, 1]] < tie) if len(langs) > 1 else False
            sure = letters & bool(langs)
            names = [langs[b] if s else "und" for b, s in zip(best, sure)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(sure, score, 0.0)), pa.array(near & sure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    asked = rows.select("doc_id", F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
