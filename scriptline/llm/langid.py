"""Language identification with language-bitmask n-gram filters.

A language's n-grams are those that make up at least ``min_share`` of its training n-grams and are not ``contrast``
times as frequent in another language. All languages' Bloom filters lie side by side, bit-sliced: row r of the filter
holds one bit per language, so the AND of an n-gram's rows is the mask of all languages that contain it. For a text,
each language's bits are counted over all its n-grams; a filter's false positive rate (its fill to the power of the
number of hash functions) is subtracted, and the highest corrected share wins.

N-grams are three characters around a letter: letters in lower case, anything else as a blank. Counts cover all
training texts. A filter has a fixed number of rows and at most 1 / min_share n-grams per language, so what is sent to
the tasks is bounded whatever the corpus. Texts that are null, empty or without letters are `und` with score 0, and so
is every text if there was nothing to learn from; ties go to the first language in order of names. Repeated rows count
as often as they are there. Only key and results are returned, so further columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptline.llm.bpe import LETTER, character_classes
from scriptline.llm.text import mix, slices

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """rows: length of the filters, a power of two. hashes: rows per n-gram."""

    rows: int = 1 << 18
    hashes: int = 4
    min_share: float = 2e-5
    contrast: float = 8.0


@dataclass(frozen=True)
class LanguageFilters:
    languages: tuple[str, ...]
    bits: np.ndarray  # (rows, words of 64 languages)
    settings: Settings

    def false_positives(self) -> np.ndarray:
        fill = [((self.bits[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.array(fill) ** self.settings.hashes

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Languages containing each n-gram: (n-grams, words)."""
        rows = positions(grams, self.settings)
        out = self.bits[rows[0]]
        for r in rows[1:]:
            out &= self.bits[r]
        return out


def positions(grams: np.ndarray, settings: Settings) -> np.ndarray:
    """The filter rows of each n-gram: (hashes, n-grams)."""
    one = mix(grams.astype(np.uint64) + np.uint64(1))
    two = mix(one) | np.uint64(1)
    return np.stack([((one + np.uint64(i) * two) % np.uint64(settings.rows)).astype(np.int64) for i in range(settings.hashes)])


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams, which of them each occurrence is, offsets of the texts in the occurrences)."""
    texts = [(t or "").lower() for t in column.to_pylist()]
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    kind = character_classes()[codes] == LETTER
    letters = np.where(kind, codes, 0)
    alphabet = np.unique(letters) if len(letters) < 1000 else np.flatnonzero(np.bincount(letters, minlength=1))
    dense = np.zeros(int(alphabet[-1]) + 1, np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    own = dense[letters]
    middle = np.flatnonzero(kind)
    offsets = np.searchsorted(middle, begin + 1)
    size = len(alphabet)
    gram = (own[middle - 1] * size + own[middle]) * size + own[middle + 1]
    if size**3 <= 1 << 23:
        seen = np.flatnonzero(np.bincount(gram, minlength=1))
        place = np.zeros(size**3, np.int32)
        place[seen] = np.arange(len(seen))
        which = place[gram]
    else:
        seen, which = np.unique(gram, return_inverse=True)
    parts = [alphabet[seen // size**2], alphabet[seen // size % size], alphabet[seen % size]]
    return parts[0].astype(np.int64) << 42 | parts[1].astype(np.int64) << 21 | parts[2].astype(np.int64), which, offsets


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) over all texts with a language; each task sums its own slices first."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                for name in pc.unique(part.column("lang")):
                    own = part.filter(pc.equal(part.column("lang"), name))
                    grams, which, _ = trigrams(own.column("text"))
                    counts = np.bincount(which, minlength=len(grams)) if len(grams) else np.zeros(0, np.int64)
                    columns = [pa.array([name.as_py()] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    source = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return source.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", settings: Settings | None = None) -> LanguageFilters:
    """Learn the filters from labelled texts."""
    settings = settings or Settings()
    counts = gram_counts(docs, lang, text)
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    counts = counts.where(F.col("share") >= settings.min_share)
    most = F.max("share").over(Window.partitionBy("gram"))
    chosen = counts.withColumn("most", most).where(F.col("share") * settings.contrast >= F.col("most")).select("lang", "gram")

    def rows_of(batches):
        for batch in batches:
            rows = positions(batch.column("gram").to_numpy(zero_copy_only=False), settings)
            langs = pa.array(np.tile(np.arange(batch.num_rows), settings.hashes))
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(langs), pa.array(rows.ravel())], ["lang", "row"])

    # one row per filter row and language at most: a fixed number
    found = chosen.mapInArrow(rows_of, "lang string, row long").groupBy("row").agg(F.collect_set("lang").alias("langs")).toArrow()
    names = tuple(sorted(set(found.column("langs").combine_chunks().flatten().to_pylist())))
    bits = np.zeros((settings.rows, max(1, -(-len(names) // 64))), np.uint64)
    number = {n: i for i, n in enumerate(names)}
    for row, langs in zip(found.column("row").to_pylist(), found.column("langs").to_pylist(), strict=True):
        for name in langs:
            i = number[name]
            bits[row, i // 64] |= np.uint64(1 << i % 64)
    return LanguageFilters(names, bits, settings)


def predict(docs: DataFrame, model: LanguageFilters, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(kept columns, lang_pred, score, coverage): the winner's part of all corrected shares, and its corrected share of the n-grams."""
    kept = [f"kept_{i}" for i in range(len(keep))]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        filters = sent.value
        names = np.array([*filters.languages, UNKNOWN], object)
        wrong = filters.false_positives()
        for batch in batches:
            for part in slices(batch):
                grams, which, offsets = trigrams(part.column("text"))
                total = np.diff(offsets)
                masks = filters.masks(grams) if len(grams) else np.zeros((0, 1), np.uint64)
                share = np.zeros((len(filters.languages), part.num_rows))
                for i in range(len(filters.languages)):
                    bit = ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
                    until = np.concatenate([[0], np.cumsum(bit[which])])
                    hits = (until[offsets[1:]] - until[offsets[:-1]]) / np.maximum(total, 1)
                    share[i] = np.clip((hits - wrong[i]) / (1 - wrong[i]), 0, 1) if wrong[i] < 1 else hits
                known = (total > 0) & (len(filters.languages) > 0)
                best = share.argmax(axis=0) if len(filters.languages) else np.zeros(part.num_rows, np.int64)
                top = share[best, np.arange(part.num_rows)] if len(filters.languages) else np.zeros(part.num_rows)
                score = np.where(known, top / np.maximum(share.sum(axis=0), 1e-12), 0.0)
                chosen = names[np.where(known, best, len(filters.languages))]
                columns = [pa.array(chosen, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(np.where(known, top, 0.0))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], [*kept, *made])

    made = ["lang_pred", "score", "coverage"]
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, kept, strict=True)), F.col(text).alias("text"))
    kinds = "".join(f"{n} {source.schema[n].dataType.simpleString()}, " for n in kept)
    out = source.mapInArrow(run, f"{kinds}lang_pred string, score double, coverage double")
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, kept, strict=True)), *made)
