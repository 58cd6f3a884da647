"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; a letter n-gram's vector binds (multiplies) its letters'
vectors, each permuted (rolled) by its place; a text's vector bundles (adds) the vectors of all its n-grams,
and a language's prototype bundles those of its training texts. A text gets the language whose prototype has
the greatest cosine with it. Letter vectors are drawn from the code point, so nothing is stored or shipped
but the prototypes, of ``dims`` numbers for each language.

Training uses a bounded sample: of the rows it may learn from, at most about ``train_rows`` by a hash of
the id (a documented parameter); prediction covers every row and whole texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with nothing to learn from all
are ``und``; ties go to the language first by code point; repeated rows are predicted alike; a null doc_id
counts as held out, so nothing is learned from it; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.sparkkit import map_arrow, read

DIMS = 1024
N = 3
TRAIN_ROWS = 20_000
BATCH_CHARS = 1 << 19
UNKNOWN = "und"


class Profiles:
    """Letter and n-gram vectors, made as they are met."""

    def __init__(self, dims: int = DIMS, n: int = N) -> None:
        self.dims, self.n = dims, n
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(0x110000, np.int8)  # 0 unknown, 1 letter, -1 other

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([code, 4099]).integers(0, 2, self.dims).astype(np.float32) * 2 - 1
        return self.letters[code]

    def fold(self, codes: np.ndarray) -> np.ndarray:
        """Letters as they are, everything else a space."""
        unknown = self.is_letter[codes] == 0
        if unknown.any():
            for c in np.unique(codes[unknown]).tolist():
                self.is_letter[c] = 1 if unicodedata.category(chr(c))[0] == "L" else -1
        return np.where(self.is_letter[codes] == 1, codes, 32)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound vectors of n-grams given as rows of n code points."""
        out = np.ones((len(grams), self.dims), np.float32)
        for place in range(self.n):
            codes, at = np.unique(grams[:, place], return_inverse=True)
            table = np.stack([np.roll(self.letter(c), place) for c in codes.tolist()])
            out *= table[at]
        return out

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, letters): each text's bundled vector, and how many letters it has."""
        codes = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(c) for c in codes])
        flat = self.fold(np.concatenate(codes)).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        letters = np.bincount(doc[flat != 32], minlength=len(texts))
        m = len(flat) - self.n + 1
        place = np.stack([flat[j : j + m] for j in range(self.n)])
        # n-grams within one text, and not those with two spaces in a row
        ok = doc[:m] == doc[self.n - 1 :]
        for j in range(self.n - 1):
            ok &= (place[j] != 32) | (place[j + 1] != 32)
        key = np.zeros(m, np.int64)
        for j in range(self.n):
            key = key * 0x110000 + place[j]
        kinds, at = np.unique(key[ok], return_inverse=True)
        out = np.zeros((len(texts), self.dims), np.float32)
        for lo in range(0, len(kinds), 4096):  # n-gram vectors in pieces, so memory doesn't follow the vocabulary
            some = (at >= lo) & (at < lo + 4096)
            part = kinds[lo : lo + 4096]
            counts = np.bincount(doc[:m][ok][some] * len(part) + at[some] - lo, minlength=len(texts) * len(part)).reshape(len(texts), len(part)).astype(np.float32)
            grams = np.stack([part // 0x110000 ** (self.n - 1 - j) % 0x110000 for j in range(self.n)], axis=1)
            out += counts @ self.vectors(grams)
        return out, letters


def _portions(column: pa.Array, room: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) by at most 256 texts or about ``room`` characters."""
    first, texts, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if texts and (len(texts) == 256 or size + len(text) > room):
            yield first, texts
            first, texts, size = i, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def held_out(doc_id: str = "doc_id", parts: int = 4, kept: int = 2) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == kept, F.lit(True))


def train(documents: DataFrame, rows: int = TRAIN_ROWS, dims: int = DIMS, n: int = N) -> dict[str, np.ndarray]:
    """Prototypes of the languages in rows that may be learned from, from about ``rows`` of them at most."""
    usable = documents.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    there = usable.count()
    if there > rows:
        part = int((1 << 31) * rows / there)
        usable = usable.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 31)) < part)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        profiles, langs, total = Profiles(dims, n), np.array(batch["lang"].to_pylist(), object), {}
        for first, texts in _portions(batch["text"]):
            vectors, _ = profiles.bundle(texts)
            own = langs[first : first + len(texts)]
            for lang in set(own):
                total[lang] = total.get(lang, 0) + vectors[own == lang].sum(axis=0, dtype=np.float64)
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    partial = map_arrow(usable.select("lang", "text"), run, "lang string, vector array<double>")
    # summed place by place: one short row for each language and dimension reaches the driver
    summed = partial.select("lang", F.posexplode("vector").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():
        out.setdefault(r["lang"], np.zeros(dims))[r["place"]] = r["x"]
    return out


def identify(documents: DataFrame, prototypes: dict[str, np.ndarray], dims: int = DIMS, n: int = N) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, cut at 0) of each whole text."""
    langs = sorted(prototypes)
    matrix = np.stack([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-12) for x in langs]) if langs else np.zeros((0, dims))
    shared = documents.sparkSession.sparkContext.broadcast((langs, matrix.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (langs, matrix), profiles = shared.value, Profiles(dims, n)
        for batch in batches:
            best, score = [], []
            for _, texts in _portions(batch["text"]):
                vectors, letters = profiles.bundle(texts)
                if not langs:
                    best += [UNKNOWN] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                cosine = (vectors @ matrix.T) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
                at = cosine.argmax(axis=1)
                top = np.clip(cosine[np.arange(len(at)), at].astype(np.float64), 0, 1)
                best += [langs[a] if k else UNKNOWN for a, k in zip(at.tolist(), letters.tolist(), strict=True)]
                score += np.where(letters > 0, top, 0.0).tolist()
            yield pa.record_batch([batch["doc_id"], pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(documents: DataFrame, rows: int = TRAIN_ROWS, dims: int = DIMS, n: int = N) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, learned from the rows that are not held out."""
    found = identify(documents, train(documents, rows, dims, n), dims, n)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))
