"""Language identification with a blended-spectrum string kernel.

The features of a text are *which* byte n-grams of length 1, 2 and 3 it contains
(presence, not counts), after lower-casing and with ASCII digits, punctuation and
blanks read as a space. Kernel: ``k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|)``.
Landmarks give the Nyström map ``K(x, L) K(L, L)^(-1/2)``; one ridge regression a
language, against the rest, is solved in it.

Scoring is a product of matrices for each batch: ``presence (rows x grams) @
weights (grams x languages)``. The weights are ``landmark presence^T @ alpha``,
multiplied out once, which is the same number as going through the kernel row
``K(x, L) @ alpha`` because the product is associative. With more languages than landmarks
the kernel row is the smaller matrix and is gone through, so what is broadcast is
bounded by the landmarks. Products are taken in slices of bounded size.

The classifier is fitted on at most ``max_train`` labelled rows (or one for each language,
if there are more languages), an equal number for each, chosen by a hash
of the id. What reaches the driver is a presence bitmap of fixed size a row.

A text is *strange* if too few of its features occur in two or more learned texts of its
predicted language, so one mislabelled text vouches for nothing. The floor of a language
is ``STRANGE`` of the share that 95 of 100 of its learned texts reach.

Defined cases: null text, or text without a letter, is ``und`` with score 0; of equal
scores the first language by name wins; a text of any length has its features found in
slices; a null id is an id like any other, and rows that repeat an id and language are
learned from once; no labelled row at all makes every row ``und``; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.llm.common import join_checked, materialize

MAX_TRAIN, LANDMARKS, RIDGE = 1200, 192, 1e-2
STRANGE = 0.78
UNKNOWN = "und"
_TRIGRAMS = 1 << 17
SPACE = 256 + 65536 + _TRIGRAMS
_SLICE = 1 << 17
#: Numbers that a product of matrices gathers at once.
_GATHERED = 1 << 22
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_letter = regex.compile(r"\p{L}")


def presence(text: str, flags: np.ndarray) -> np.ndarray:
    """Sorted feature numbers of a text; ``flags`` is a false scratch array."""
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, len(data), _SLICE):
        b = data[at : at + _SLICE + 2].astype(np.uint32)
        flags[b] = True
        two = b[:-1] << 8 | b[1:]
        flags[two + 256] = True
        if len(b) > 2:
            flags[((two[:-1] << 8 | b[2:]) * np.uint32(2654435761) >> 15) + 65792] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # grams x languages, or grams x landmarks
    bias: np.ndarray
    alpha: np.ndarray | None = None  # landmarks x languages, if the weights are not multiplied out
    known: np.ndarray | None = None  # languages x bits of grams: in two learned texts or more
    floor: np.ndarray | None = None  # least share of known grams by language

    def outputs(self, grams: list[np.ndarray]) -> np.ndarray:
        """Regression outputs of texts by their features."""
        out = np.zeros((len(grams), self.weights.shape[1]))
        step = max(1, _GATHERED // max(1, self.weights.shape[1]))
        at = 0
        while at < len(grams):
            upto, size = at + 1, len(grams[at])
            while upto < len(grams) and size + len(grams[upto]) <= step:
                size += len(grams[upto])
                upto += 1
            if size <= step:
                starts = np.cumsum([0] + [len(g) for g in grams[at : upto - 1]])
                out[at:upto] = np.add.reduceat(self.weights[np.concatenate(grams[at:upto])], starts, axis=0)
            else:  # one text of many features
                for k in range(0, size, step):
                    out[at] += self.weights[grams[at][k : k + step]].sum(axis=0)
            at = upto
        out /= np.sqrt([len(g) for g in grams])[:, None]
        return (out if self.alpha is None else out @ self.alpha) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Labels and scores between 0 and 1 of a batch."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Labels, scores and whether a text is strange to its label's language."""
        labels, scores, strange = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.langs:
            return labels, scores, strange
        flags = np.zeros(SPACE, bool)
        for at in range(0, len(texts), 256):
            rows = [i for i in range(at, min(at + 256, len(texts))) if texts[i] and _letter.search(texts[i])]
            if not rows:
                continue
            grams = [presence(texts[i], flags) for i in rows]
            out = self.outputs(grams)
            best = out.argmax(axis=1)
            for i, k, f in zip(rows, best, out.max(axis=1), strict=True):
                labels[i], scores[i] = self.langs[k], min(1.0, max(0.0, (1.0 + float(f)) / 2))
            for i, k, g in zip(rows, best, grams, strict=True):
                # two deviations of the count are allowed, as short texts have few features
                n, p = len(g), 0.0 if self.floor is None else self.floor[k]
                strange[i] = self.known is not None and (self.known[k, g >> 3] >> (g & 7) & 1).sum() < n * p - 2 * np.sqrt(n * p * (1 - p))
        return labels, scores, strange


def fit(bitmaps: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``bitmaps``: rows x ``SPACE / 8`` bytes. Landmarks are dealt among languages in turn."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((SPACE, 0), np.float32), np.zeros(0))
    y = np.array([langs.index(x) for x in labels])
    turn = np.zeros(len(y), int)
    for c in range(len(langs)):
        turn[y == c] = np.arange((y == c).sum())
    mark = np.lexsort((y, turn))[: min(landmarks, len(y))]
    step = 256  # bytes of bitmap at once
    dot, size = np.zeros((len(y), len(mark))), np.zeros(len(y))
    for at in range(0, bitmaps.shape[1], step):
        bits = np.unpackbits(bitmaps[:, at : at + step], axis=1, bitorder="little").astype(np.float32)
        dot += bits @ bits[mark].T
        size += bits.sum(axis=1)
    k = dot / np.sqrt(np.maximum(size, 1))[:, None] / np.sqrt(np.maximum(size[mark], 1))[None, :]
    value, vector = np.linalg.eigh(k[mark])
    keep = value > 1e-8 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.hstack([k @ root, np.ones((len(y), 1))])
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    penalty = ridge * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(phi.T @ phi + penalty, phi.T @ target)
    alpha = (root @ solved[:-1]) / np.sqrt(np.maximum(size[mark], 1))[:, None]
    whole = len(langs) <= len(mark)
    weights = np.zeros((SPACE, len(langs) if whole else len(mark)), np.float32)
    for at in range(0, bitmaps.shape[1], step):
        bits = np.unpackbits(bitmaps[mark, at : at + step], axis=1, bitorder="little")
        weights[at * 8 : at * 8 + bits.shape[1]] = bits.T.astype(np.float64) @ alpha if whole else bits.T
    known, share = np.zeros((len(langs), SPACE), bool), np.zeros(len(y))
    for at in range(0, bitmaps.shape[1], step):
        bits = np.unpackbits(bitmaps[:, at : at + step], axis=1, bitorder="little")
        for c in range(len(langs)):
            own = bits[y == c]
            times = own.sum(axis=0, dtype=np.int32)
            known[c, at * 8 : at * 8 + bits.shape[1]] = times > 1
            share[y == c] += own[:, times > 1].sum(axis=1, dtype=np.int32)
    share /= np.maximum(size, 1)
    floor = np.array([STRANGE * np.quantile(share[y == c], 0.05) for c in range(len(langs))])
    return Model(langs, weights, solved[-1], None if whole else alpha, np.packbits(known, axis=1, bitorder="little"), floor)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from: ``crc32(id as text) mod 4 = 2``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.
    Languages and ids are counted without reading a text."""
    labelled = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")).distinct()
    langs = materialize(labelled.groupBy("_lang").agg(F.count("*").alias("_n")), "languages")
    known = langs.count()
    if not known:
        return fit(np.zeros((0, SPACE // 8), np.uint8), [])
    quota = max(1, max_train // known)
    # four times what is wanted of each language, so that only few rows are ranked
    some = join_checked(labelled.withColumn("_at", F.xxhash64(F.col("_id").cast("string"), F.lit(3))), langs, "_lang")
    some = some.where(F.pmod("_at", F.lit(1_000_000)) < F.lit(4_000_000.0 * quota) / F.col("_n"))
    some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy("_at", "_id"))).where(F.col("_rank") <= quota)
    picked = F.broadcast(some.select("_id", "_lang").distinct())  # at most quota rows a language
    rows = docs.select(F.col(id_col).alias("_of"), F.col(lang_col).alias("_own"), F.col(text_col).alias("_text")).join(picked, F.col("_of").eqNullSafe(F.col("_id"))).where("_own = _lang")
    # of rows that repeat an id and language one is learned from, so every language has its quota
    rows = rows.groupBy("_id", "_lang").agg(F.min(F.struct(F.xxhash64("_text"), "_text")).alias("_one")).select("_id", "_lang", F.col("_one._text").alias("_text"))

    def bitmap(batches):
        flags = np.zeros(SPACE, bool)
        for batch in batches:
            maps = []
            for t in batch.column(2):
                flags_of = np.zeros(SPACE, np.uint8)
                flags_of[presence(t.as_py() or "", flags)] = 1
                maps.append(np.packbits(flags_of, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(maps, pa.binary())], ["id", "lang", "bits"])

    got = rows.select("_id", "_lang", "_text").mapInArrow(bitmap, "id string, lang string, bits binary").orderBy("lang", "id").limit(quota * known).collect()
    maps = np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), SPACE // 8)
    return fit(maps, [r["lang"] for r in got], landmarks, ridge)


def with_language(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", strange_out: str | None = None) -> DataFrame:
    """``df`` with the prediction added, and if named whether the text is strange; other
    columns pass through."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    if strange_out:
        schema = schema.add(strange_out, T.BooleanType())

    def add(batches):
        for batch in batches:
            labels, scores, strange = shared.value.judge(batch.column(at).to_pylist())
            more, names = [pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [lang_out, score_out]
            if strange_out:
                more, names = [*more, pa.array(strange, pa.bool_())], [*names, strange_out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    return df.mapInArrow(add, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    model = train(docs, id_col, text_col, lang_col, **fitting)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_language(rows, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
