"""Quality rules over whole documents (operator 9).

The method: the suffixes of a document's words are sorted by prefix doubling, the longest common
prefixes of neighbours in that order give the maximal repeated substrings, and two limits apply
to the union of their spans: the covered share of the words, and the longest repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelloom.llm.blocks import BLANK, Block, Words, blocks, covered, id_and_text, ids_out, with_row, without_row, words

MIN_WORDS = 50
#: Repeats of fewer words are ordinary language.
MIN_REPEAT = 5
#: Most percent of words that repeats may cover, and most words of the longest repeat.
MAX_COVERED = 40
MAX_LONGEST = 100

#: A block needs about 100 times its size: ranks of all lengths for every word.
LIMIT = 1 << 21

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def suffix_repeats(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest substring from there that repeats in its document.

    ``code`` numbers the words and ``doc`` the documents, in order. Ranks of 1, 2, 4, ... words
    are made by doubling; a suffix alone in its group needs no longer rank. The ranks of all
    lengths then give the longest common prefix of any two neighbours by halving.
    """
    n = len(code)
    best = np.zeros(n, dtype=np.int64)
    if n == 0:
        return best
    last = np.flatnonzero(np.diff(doc, append=-1))
    stop = np.repeat(last + 1, np.diff(last, prepend=-1))  # one past the last word of the document
    group = np.unique(doc * (int(code.max()) + 1) + code, return_inverse=True)[1]
    sizes = np.bincount(group)
    # a rank is the place where the group of a suffix begins in the order of all suffixes
    ranks, step = [(np.cumsum(sizes) - sizes)[group]], 1
    live = np.flatnonzero(sizes[group] > 1)
    while len(live):
        now = ranks[-1]
        ahead = live + step
        pair = np.where(ahead < stop[live], now[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((pair, now[live]))
        live, pair = live[by], pair[by]
        old = now[live]
        old_starts = np.r_[True, old[1:] != old[:-1]]
        starts = old_starts | np.r_[True, pair[1:] != pair[:-1]]
        at = np.arange(len(live))
        after = now.copy()
        after[live] = old + np.maximum.accumulate(np.where(starts, at, 0)) - np.maximum.accumulate(np.where(old_starts, at, 0))
        ranks.append(after)
        step *= 2
        counts = np.diff(np.flatnonzero(np.r_[starts, True]))
        live = live[np.repeat(counts > 1, counts)]
    order = np.argsort(ranks[-1])
    left, right = order[:-1], order[1:]
    lcp = np.zeros(n - 1, dtype=np.int64)
    near = np.flatnonzero(ranks[0][left] == ranks[0][right])
    for level in range(len(ranks) - 1, -1, -1):
        width = 1 << level
        i, j = left[near] + lcp[near], right[near] + lcp[near]
        fits = (i + width <= stop[left[near]]) & (j + width <= stop[right[near]])
        same = fits & (ranks[level][np.minimum(i, n - 1)] == ranks[level][np.minimum(j, n - 1)])
        lcp[near[same]] += width
    np.maximum.at(best, left, lcp)
    np.maximum.at(best, right, lcp)
    return best


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True


def measure(block: Block, w: Words) -> dict[str, np.ndarray]:
    """All figures of a block, one value for each document."""

    def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    repeat = suffix_repeats(w.code, w.doc)
    size = len(w)
    threes, longer = (covered(np.flatnonzero(repeat >= k), k, size) for k in (3, MIN_REPEAT))
    longest = np.zeros(len(block), dtype=np.int64)
    np.maximum.at(longest, w.doc, repeat)
    chars = ((block.data & 0xC0) != 0x80) & ~BLANK[block.data]
    return {
        "n_words": np.diff(w.first),
        "word_chars": per_doc(chars, block.start),
        "n_symbols": per_doc(SYMBOL[block.data], block.start),
        "n_dup_lines": np.fromiter((_dup_lines(t) for t in block.texts), dtype=np.int64, count=len(block)),
        "n_repeat_words": per_doc(threes, w.first),
        "covered_words": per_doc(longer, w.first),
        "longest_repeat": longest,
    }


def verdict(m: dict[str, np.ndarray], max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) for each document."""
    n = m["n_words"]
    failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * n)
    kept = ~failed & (100 * m["covered_words"] <= max_covered * n) & (m["longest_repeat"] <= max_longest)
    return failed, kept


def quality(docs: DataFrame, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its figures, ``base_failed`` and ``kept``.

    A null or blank text has no words and fails. Null and repeated ids come back as they are;
    other columns are ignored. An empty table gives an empty one. No shuffle: documents are
    independent.
    """

    def run(batches):
        for block in blocks(batches, LIMIT):
            m = measure(block, words(block))
            failed, kept = verdict(m, max_covered, max_longest)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids_out(block.ids), **m, "base_failed": failed, "kept": kept}
            )

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of ``docs`` that pass, with all columns. The text is read once; nothing is joined.

    The columns travel as one struct beside the text, so names cannot clash. A null, empty or blank text fails.
    Null and repeated ids and repeated rows stay or go by their texts alone; an empty table gives an empty one.
    """
    plain, schema = with_row(docs)

    def run(batches):
        for batch in batches:
            ok = []
            for block in blocks([batch.select(["doc_id", "text"])], LIMIT):
                ok.append(verdict(measure(block, words(block)), max_covered, max_longest)[1])
            if ok:
                yield batch.filter(pa.array(np.concatenate(ok)))

    return without_row(plain.mapInArrow(run, schema), docs.columns)
