"""Language identification by rank-order profiles (operator 6).

A profile is the ranking of the most frequent letter n-grams (one to three letters, with the blanks
around words) of a language. A document is ranked the same way, and the language whose ranking is
nearest by out-of-place distance wins. N-grams are exact numbers: 21 bits for each code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.blocks import Block, blocks, id_and_text, ids_out

#: Length of a ranking.
TOP = 300
UNKNOWN = "und"
#: Stands for the blanks between words; no letter has this code point.
EDGE = 1
_SHIFT = 21


class Letters:
    """Lower-case letters by code point; everything else is ``EDGE``. Looked up once per code point."""

    def __init__(self) -> None:
        self.of = np.full(0x110000, -1, dtype=np.int32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        seen = np.zeros(0x110000, dtype=bool)
        seen[points] = True
        for p in np.flatnonzero(seen & (self.of < 0)).tolist():
            low = chr(p).lower()
            self.of[p] = (ord(low) if len(low) == 1 else p) if chr(p).isalpha() else EDGE
        return self.of[points]


def grams_of(block: Block, letters: Letters, group: np.ndarray, few: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram, count), by group, then n-gram; ``group[d]`` is the group of document ``d``.

    With ``few`` groups, keys are counted in a table when that is no larger than the block.
    """
    text = block.data.tobytes().decode()
    points = letters(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
    sizes = np.fromiter((len(t.decode()) + 1 for t in block.texts), dtype=np.int64, count=len(block))
    blank = points == EDGE
    keep = np.r_[~blank[:1], ~(blank[1:] & blank[:-1])]
    # the edge before the first word, then words with one edge after each: the line feed after a
    # document belongs to it, and is the edge before the first word of the next
    points = np.r_[np.int32(EDGE), points[keep]]
    owner = np.repeat(group, sizes)[keep]
    seen = np.flatnonzero(np.bincount(points))
    dense = np.zeros(seen[-1] + 1, dtype=np.int64)
    dense[seen] = np.arange(len(seen))
    x, a = dense[points], len(seen)
    span = a + a * a + a * a * a
    base = owner * span
    at = np.flatnonzero(points[1:] != EDGE)  # letters, as places in ``owner``; one further on in ``x``
    middle, own = x[at + 1], base[at]
    keys = np.concatenate([own + middle, base + (x[:-1] * a + x[1:] + a), own + ((x[at] * a + middle) * a + x[at + 2] + (a + a * a))])
    if few and few * span <= len(keys):
        total = np.bincount(keys, minlength=few * span)
        keys = np.flatnonzero(total)
        count = total[keys]
    else:
        keys.sort()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        count = np.diff(np.r_[starts, len(keys)])
        keys = keys[starts]
    group, n = np.divmod(keys, span)
    seen = seen.astype(np.int64)
    m1, m2 = n < a, (n >= a) & (n < a + a * a)
    gram = np.empty(len(n), dtype=np.int64)
    gram[m1] = seen[n[m1]]
    r = n[m2] - a
    gram[m2] = (seen[r // a] << _SHIFT) | seen[r % a]
    r = n[~m1 & ~m2] - a - a * a
    gram[~m1 & ~m2] = (seen[r // (a * a)] << (2 * _SHIFT)) | (seen[r // a % a] << _SHIFT) | seen[r % a]
    return group, gram, count


def document_grams(block: Block, letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count), by document, then n-gram."""
    return grams_of(block, letters, np.arange(len(block)))


def profiles(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, gram, place) of the ``top`` n-grams of each language over all rows of ``docs`` with a language.

    Ties go to the smaller n-gram number. Counts are combined in each task and again before the
    shuffle, and only the first ``top`` of a task meet in a language's ranking.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        letters = Letters()
        for block in blocks(batches):
            names, lang = np.unique(np.array(block.extra["lang"], dtype=object).astype(str), return_inverse=True)
            group, gram, count = grams_of(block, letters, lang, len(names))
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array(names[group].tolist(), pa.string()), "gram": gram, "n": pa.array(count, pa.int64())}
            )

    rows = id_and_text(docs.filter("lang IS NOT NULL"), "lang").mapInArrow(run, "lang string, gram long, n long")
    total = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return total.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < top).select("lang", "gram", "place")


class Model:
    """Profiles as one table: for each n-gram its place in every language, ``top`` where it has none."""

    def __init__(self, rows: list, top: int = TOP) -> None:
        self.top = top
        self.langs = sorted({r["lang"] for r in rows})
        at = {x: k for k, x in enumerate(self.langs)}
        self.grams = np.unique(np.array([r["gram"] for r in rows], dtype=np.int64))
        self.places = np.full((len(self.grams) + 1, len(self.langs)), top, dtype=np.int64)
        for r in rows:
            self.places[np.searchsorted(self.grams, r["gram"]), at[r["lang"]]] = r["place"]

    def predict(self, block: Block, letters: Letters) -> tuple[list[str], np.ndarray]:
        """The nearest language (ties: the first by name) and 1 - distance / largest possible distance."""
        n = len(block)
        doc, gram, count = document_grams(block, letters)
        if not len(doc) or not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        by = np.lexsort((gram, -count, doc))
        doc, gram = doc[by], gram[by]
        first = np.searchsorted(doc, np.arange(n))
        place = np.arange(len(doc)) - first[doc]
        top = place < self.top
        doc, gram, place = doc[top], gram[top], place[top]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        known = self.places[at]
        far = np.where(known < self.top, np.abs(known - place[:, None]), self.top)
        has = np.unique(doc)
        distance = np.add.reduceat(far, np.searchsorted(doc, has), axis=0)
        size = np.bincount(doc, minlength=n)[has]
        pick = distance.argmin(axis=1)
        lang = [UNKNOWN] * n
        score = np.zeros(n)
        for d, p in zip(has.tolist(), pick.tolist()):
            lang[d] = self.langs[p]
        score[has] = 1 - distance[np.arange(len(has)), pick] / (size * self.top)
        return lang, score


def fit(docs: DataFrame, top: int = TOP) -> Model:
    """Profiles of all languages; ``top`` rows for each language reach the driver."""
    return Model(profiles(docs, top).collect(), top)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    Only the text decides. A null text and one without letters is ``und`` with score 0, and so is
    all without any profile. Null and repeated ids come back as they are; an empty table gives an
    empty one; other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        letters = Letters()
        for block in blocks(batches):
            lang, score = model.predict(block, letters)
            yield pa.RecordBatch.from_pydict({"doc_id": ids_out(block.ids), "lang_pred": lang, "score": score})

    return id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column, n: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n == rest, F.lit(False))
