"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1/-1. An n-gram's vector is the product of its letters'
vectors, each permuted (rotated) once for every place it stands before the last; a text's
profile is the sum of its n-grams' vectors. A language's prototype is the sum of the profiles of
its labelled texts, and a text is given the language whose prototype has the greatest cosine.

Letters are the lower-case letters of every script; each run of other characters is one space,
and a space stands at either end. Letters outside the symbol table share its slots by hash.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import kernels as K
from .common import dealt_table, shipped

SCHEMA = "lang string, cosine float, margin float, n_grams int, keep boolean"


@dataclass(frozen=True)
class Settings:
    dims: int = 1024
    order: int = 3  # letters of an n-gram
    symbols: int = 64  # slots for letters; slot 0 is the space
    seed: int = 7
    #: Training takes about so many labelled rows of each language at most.
    rows_per_language: int = 2000
    #: A text is rejected when its best cosine is below this, for texts with enough n-grams to tell.
    min_cosine: float = 0.3
    min_grams: int = 100


@functools.cache
def _letters(s: Settings) -> np.ndarray:
    """order x symbols x dims: the vectors of the symbols, rotated for each place."""
    base = np.random.default_rng(s.seed).choice(np.array([-1, 1], np.int8), (s.symbols, s.dims))
    return np.stack([np.roll(base, s.order - 1 - k, axis=1) for k in range(s.order)])


@functools.cache
def _slots(symbols: int) -> np.ndarray:
    """Slot of each code point of the basic plane: the 26 letters, then Latin letters with marks, one each while there is room; the others by hash."""
    cps = np.arange(0x10000)
    letter = np.fromiter((chr(c).isalpha() for c in cps), bool, len(cps))
    low = K.lowered(cps.astype(np.uint32)).astype(np.int64)
    rest = symbols - 27
    slot = np.where((low >= 97) & (low <= 122), low - 96, 27 + low % rest)
    return np.where(letter, slot, 0).astype(np.uint8)


def _symbols(cp: np.ndarray, at: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts with runs of spaces as one and a space before and after each text, and their offsets."""
    slot = _slots(symbols)[np.minimum(cp, 0xFFFF)]
    if len(cp) and cp.max() > 0xFFFF:
        far = np.flatnonzero(cp > 0xFFFF)
        kinds, inverse = np.unique(cp[far], return_inverse=True)
        slot[far] = np.array([27 + ord(chr(k).lower()[0]) % (symbols - 27) if chr(k).isalpha() else 0 for k in kinds.tolist()], np.uint8)[inverse]
    n = len(at) - 1
    # one space in front of each text and one at the very end
    wide = np.zeros(len(cp) + n + 1, np.uint8)
    row = np.repeat(np.arange(n), np.diff(at))
    wide[np.arange(len(cp)) + row + 1] = slot
    keep = np.ones(len(wide), bool)
    keep[1:] = (wide[1:] != 0) | (wide[:-1] != 0)
    heads = at + np.arange(n + 1)
    keep[heads] = True
    # a text that ends in a space already has its closing one
    offsets = np.cumsum(keep)[heads] - 1
    return wide[keep], offsets


def _gram_counts(texts: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(counts: texts x kinds, the kinds' symbols: kinds x order) of the n-grams; n-grams of spaces alone don't count."""
    cp, at = K.code_points(texts)
    sym, off = _symbols(cp, at, s.symbols)
    n = len(texts)
    if len(sym) < s.order:
        return np.zeros((n, 0), np.float32), np.zeros((0, s.order), np.int64)
    code = np.zeros(len(sym) - s.order + 1, np.int32)
    for k in range(s.order):
        code = code * s.symbols + sym[k : len(sym) - s.order + 1 + k]
    row = np.repeat(np.arange(n), np.diff(off))[: len(code)]
    # a text's n-grams end at the space in front of the next text at the latest, or at its own last one
    last = off[1:] - (sym[off[1:] - 1] == 0)
    ok = (np.arange(len(code)) + s.order - 1 <= last[row]) & (code > 0)
    code, row = code[ok], row[ok]
    there = np.zeros(s.symbols**s.order, bool)
    there[code] = True
    kinds = np.flatnonzero(there)
    index = np.zeros(len(there), np.int32)
    index[kinds] = np.arange(len(kinds))
    counts = np.bincount(row * len(kinds) + index[code], minlength=n * len(kinds)).reshape(n, len(kinds)).astype(np.float32)
    return counts, np.stack([kinds // s.symbols ** (s.order - 1 - k) % s.symbols for k in range(s.order)], axis=1)


def _profiles(counts: np.ndarray, kinds: np.ndarray, s: Settings) -> np.ndarray:
    """texts x dims."""
    letters = _letters(s)
    out = np.zeros((len(counts), s.dims), np.float32)
    for a in range(0, len(kinds), 2048):
        vectors = letters[0][kinds[a : a + 2048, 0]]
        for k in range(1, s.order):
            vectors = vectors * letters[k][kinds[a : a + 2048, k]]
        out += counts[:, a : a + 2048] @ vectors.astype(np.float32)
    return out


def profiles(texts: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(texts x dims profiles, number of n-grams of each)."""
    out, n = np.zeros((len(texts), s.dims), np.float32), np.zeros(len(texts), np.int64)
    for a, b in K.slices(texts, 1 << 19):
        for x in range(a, b, 512):
            y = min(b, x + 512)
            counts, kinds = _gram_counts(texts.slice(x, y - x), s)
            out[x:y], n[x:y] = _profiles(counts, kinds, s), counts.sum(axis=1)
    return out, n


def train(docs: DataFrame, settings: Settings = Settings(), lang: str = "lang", text: str = "text", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """(languages, prototypes of length 1) from the labelled rows of docs.

    Of a language with more than rows_per_language rows, about that many are taken, by a hash of
    key and text's length, the same ones whatever the partitions. Rows without label or text don't count;
    with no labelled rows there are no languages."""
    s = settings
    rows = docs.select(docs[lang].cast("string").alias("l"), docs[text].alias("t"), F.xxhash64(docs[key]).alias("h")).where("l is not null and t is not null")
    share = {r["l"]: min(1.0, s.rows_per_language / r["n"]) for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not share:
        return [], np.zeros((0, s.dims), np.float32)
    bar = F.lit(None)
    for name, x in share.items():
        bar = F.when(F.col("l") == name, F.lit(x)).otherwise(bar)
    taken = rows.where((F.pmod(F.col("h"), F.lit(1 << 20)) / float(1 << 20)) < bar)

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            p, _ = profiles(batch.column("t"), s)
            p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1)
            of = np.array(batch.column("l").to_pylist(), object)
            for name in set(of.tolist()):
                sums[name] = sums.get(name, 0) + p[of == name].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"l": list(sums), "v": [v.astype(np.float64).tobytes() for v in sums.values()]})

    total: dict[str, np.ndarray] = {}
    for r in sorted(taken.select("l", "t").mapInArrow(bundle, "l string, v binary").collect(), key=lambda r: (r["l"], bytes(r["v"]))):
        total[r["l"]] = total.get(r["l"], 0) + np.frombuffer(r["v"], np.float64)
    names = sorted(total)
    protos = np.array([total[k] for k in names]).reshape(len(names), s.dims)
    return names, (protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def classify(texts: pa.Array, names: list[str], protos: np.ndarray, s: Settings) -> pa.StructArray:
    """lang (null without n-grams or languages), cosine with its prototype, margin to the next, n_grams, keep."""
    p, n = profiles(texts, s)
    unit = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1)
    if names:
        cos = unit @ protos.T
        best = cos.argmax(axis=1)
        top = cos[np.arange(len(cos)), best]
        cos[np.arange(len(cos)), best] = -1
        second = cos.max(axis=1) if len(names) > 1 else np.zeros(len(top), np.float32)
    else:
        best, top, second = np.zeros(len(n), np.int64), np.zeros(len(n), np.float32), np.zeros(len(n), np.float32)
    known = (n > 0) & bool(names)
    lang = pa.array(np.array([*names, ""], object)[np.where(known, best, -1)], pa.string(), mask=~known)
    keep = (n < s.min_grams) | (top >= s.min_cosine) if names else np.ones(len(n), bool)
    return pa.StructArray.from_arrays([lang, pa.array(np.where(known, top, 0), pa.float32()), pa.array(np.where(known, top - second, 0), pa.float32()), pa.array(n, pa.int32()), pa.array(keep)], ["lang", "cosine", "margin", "n_grams", "keep"])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, settings: Settings = Settings(), text: str = "text"):
    """Column expression over docs: struct lang, cosine, margin, n_grams, keep.

    keep is false where the text has at least min_grams n-grams and none of the languages comes
    within min_cosine. Null and empty texts, and texts too short to tell, have keep true; where
    a text has no letters, lang is null. Equal texts get equal answers."""
    names, protos = model if model is not None else train(docs, settings)
    held = shipped(docs.sparkSession, (names, protos))

    @arrow_udf(SCHEMA)
    def f(t: pa.Array) -> pa.Array:
        return classify(t, *held.value, settings)

    return f.asNondeterministic()(docs[text])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and verdict of every document."""
    docs = dealt_table(spark, sf_dir, "documents")
    return docs.select("doc_id", identify(docs).alias("v")).select("doc_id", "v.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't rejected, unchanged."""
    names = docs.columns
    free = next(f"tl_v{k}" for k in range(len(names) + 1) if f"tl_v{k}" not in names)
    return docs.withColumn(free, identify(docs)).where(F.col(f"{free}.keep")).select(*[docs[c] for c in names])

