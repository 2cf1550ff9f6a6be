"""Language identification with a blended-spectrum string kernel.

A text is the set of its 2-, 3- and 4-grams of letters (everything else is a
blank), hashed into one presence vector of V bits; the kernel of two texts is the
number of grams they share, normalised. Kernel ridge regression, one language
against the rest, is solved in the Nystroem space of landmark texts. As the
kernel is linear in the presence vectors, landmarks and coefficients fold into a
V x languages matrix, and a batch of texts is scored by one matrix product.

The fit uses a bounded sample: up to PER_LANG texts of every language there is (fewer
where FIT_TEXTS texts over all languages would be exceeded, LEAST at the least), those with the
least hashes of doc_id. Which ones these are is settled by a threshold on the whole 64-bit hash,
taken from counts over all rows, so the sample is as full for 10^11 texts as for a thousand.
Executors turn the sampled texts, whole, into presence vectors; the driver gets these,
V bits each, and no text. Every text is scored whole.

Edge cases: a null text, or one without a letter, is "und" with score 0; if no
labelled row may be learned from, all are; repeated rows are scored each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import cut, draw_below, slices, small

V, GRAMS = 1 << 16, (2, 3, 4)
#: Texts of a language in the fit, texts of all, least texts of a language; landmarks of a language and of all (one each at least).
PER_LANG, FIT_TEXTS, LEAST, LANDMARKS, ALL_LANDMARKS = 400, 12_800, 20, 60, 512
RIDGE, SHARPNESS, BATCH = 1e-3, 4.0, 64
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter, or blank, of each code point of the basic plane."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def presence(text: str, out: np.ndarray) -> bool:
    """Sets out (V zeros) to the presence of the text's grams; whether it has a letter."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if not len(code):
        return False
    high = code >= 1 << 16
    if high.any():
        c = _letters()[np.minimum(code, (1 << 16) - 1)]
        c[high] = [x if chr(x).isalpha() else 32 for x in code[high].tolist()]
    else:
        c = _letters()[code]
    blank = c == 32
    if blank.all():
        return False
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint32)
    one = (c ^ (c >> np.uint32(3))) * np.uint32(0x9E3779B1)
    h = one
    for n in range(2, max(GRAMS) + 1):
        if len(h) < 2:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[n - 1 :]
        if n in GRAMS:
            out[((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE3D)) >> np.uint32(16)] = 1
    return True


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """The languages and the V x languages matrix of their scores, of texts."""
    rows = np.zeros((len(texts), V), np.uint8)
    use = [presence(t, rows[i]) for i, t in enumerate(texts)]
    return fit_packed([np.packbits(r) for r, u in zip(rows, use) if u], [x for x, u in zip(langs, use) if u], landmarks, ridge)


def _unpacked(packed: list[np.ndarray]) -> np.ndarray:
    return np.unpackbits(np.stack(packed), axis=1).astype(np.float32)


def fit_packed(packed: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """The same of presence vectors of V packed bits; only the landmarks, and 128 others at a time, are unpacked."""
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((V, 0), np.float32)
    number = {x: k for k, x in enumerate(names)}
    y = np.array([number[x] for x in langs], np.int64)
    each = min(landmarks, max(1, ALL_LANDMARKS // len(names)))
    chosen = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(names))])
    size = np.sqrt(np.array([np.bitwise_count(r).sum(dtype=np.int64) for r in packed], np.float64))
    base, kernel = np.empty((len(chosen), V), np.float32), np.empty((len(packed), len(chosen)))
    for k in range(0, len(chosen), 128):
        base[k : k + 128] = _unpacked([packed[i] for i in chosen[k : k + 128]])
    base /= size[chosen, None].astype(np.float32)
    for k in range(0, len(packed), 128):
        kernel[k : k + 128] = _unpacked(packed[k : k + 128]) @ base.T
    kernel /= size[:, None]
    values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
    good = values > values.max() * 1e-6
    half = vectors[:, good] / np.sqrt(values[good])
    z, target = kernel @ half, np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    w = np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), z.T @ target)
    return names, base.T @ (half @ w).astype(np.float32)


def score(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text of a batch."""
    rows = np.zeros((len(texts), V), np.uint8)
    known = np.array([bool(names) and t is not None and presence(t, rows[i]) for i, t in enumerate(texts)], bool)
    if not known.any():
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    size = np.sqrt(np.maximum(rows.sum(1, dtype=np.int64), 1))
    f = SHARPNESS * (rows.astype(np.float32) @ matrix) / size[:, None]
    p = np.exp(f - f.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return [names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known)], [float(p[i, k]) if known[i] else 0.0 for i, k in enumerate(best.tolist())]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    h = F.xxhash64(id_col)
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), h.alias("h"), F.col(text_col).alias("text"))
    # a row for each language; the least hash is let in too, so that a language of few distinct ids has a text
    counts = cut(rows.where(F.col("text").rlike(r"\p{L}")).groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")))
    n_langs = counts.count()
    if not n_langs:
        return fit([], [])
    wanted = min(per_lang, max(LEAST, FIT_TEXTS // n_langs))
    chance = small(counts.select("lang", F.greatest(draw_below(F.col("n"), wanted), "least").alias("below")))
    picked = rows.join(chance, "lang").where("h <= below").select("lang", "h", "text")
    # the rank's limit is applied in each partition before anything is shuffled
    first = Window.partitionBy("lang").orderBy("h", "text")
    sample = picked.where(F.col("text").rlike(r"\p{L}")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= wanted).select("lang", "h", "text")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            row, bits = np.zeros(V, np.uint8), []
            for t in b.column(2).to_pylist():
                row[:] = 0
                bits.append(np.packbits(row).tobytes() if presence(t, row) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["lang", "h", "bits"])

    got = sample.mapInArrow(pack, "lang string, h bigint, bits binary").where("bits is not null").toArrow()  # V / 8 bytes each
    got = got.sort_by([("h", "ascending"), ("bits", "ascending")])
    return fit_packed([np.frombuffer(x.as_buffer(), np.uint8) for x in got.column("bits")], got.column("lang").to_pylist())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    names, matrix = learn(docs, id_col, text_col, lang_col, per_lang)
    sent = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        for b in slices(batches, 2):
            lang, prob = [], []
            for k in range(0, b.num_rows, BATCH):
                a, c = score(b.column(2).slice(k, BATCH).to_pylist(), names, matrix)
                lang += a
                prob += c
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(prob, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
