"""Benchmark decontamination (operator 5).

Seeds are pairs of words of a test item with at most one word between them. Two words in a row that
an alignment matches form such a pair unless they stand two edits apart, and an alignment that
reaches the least score has no room for that many edits. So it holds a known number of pairs, and
the most frequent ones, by the word frequencies of the whole corpus, need not be looked up. Where
enough pairs meet, Smith-Waterman alignment of the item with the passage around them scores it, so
edited and paraphrased copies count by what is left of the item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.blocks import NO_ID, Block, blocks, id_and_text, ids_out, with_row, without_row, words
from labelloom.session import settle

#: Share of the pairs an alignment must hold that may be left out of the seeds, the most frequent first.
LEFT_OUT = 0.5
#: Items of so few words count only where they occur whole.
WHOLE = 2
MATCH, MISMATCH, GAP = 2, -1, -1
#: An item counts as copied from this share of the score of an exact copy.
MIN_SCORE = 0.4
#: Items are worked on in blocks of about so much text, so tasks hold a bounded part of them.
ITEM_BYTES = 8 << 20
#: Cells of one alignment matrix row over all passages aligned at once.
CELLS = 1 << 20
#: Seeds found at once, more only in one document.
HITS = 1 << 22

SCHEMA = "doc_id long, item_id long, score double, first_word long, end_word long"
#: ASCII punctuation as blanks.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def _plain(ids: np.ndarray, texts: list[bytes]) -> Block:
    """The texts in lower case and without punctuation."""
    low = [t.decode().lower().encode() for t in texts]
    start = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in low], out=start[1:])
    return Block(ids, low, PLAIN[np.frombuffer(b"\n".join([*low, b""]), dtype=np.uint8)], start)


@dataclass
class Items:
    """A block of test items: their words as numbers, the sorted seeds (a pair of word numbers as one) with the item of
    each, how many seeds a copy holds at least, and how many words of a document it spans at most."""

    vocabulary: pa.Array
    ids: np.ndarray
    code: list[np.ndarray]
    seeds: np.ndarray
    owner: np.ndarray
    need: np.ndarray
    span: np.ndarray

    @property
    def wide(self) -> int:
        """The factor of a pair's first word; its last number stands for no word."""
        return len(self.vocabulary) + 1


def item_classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with equal words are one class: (words, item_id, n_items), a row for each class, with the least id and the
    number of its items; and (item_id, words) of all items. Items without words have no class; an item without id is
    one as any other, and a class without any id has a null one. Counted in Spark, so a class of any size will do.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for block in blocks(batches):
            plain = _plain(block.ids, block.texts)
            own = [b" ".join(plain.data[a:z].tobytes().split()).decode() for a, z in zip(plain.start[:-1], plain.start[1:])]
            yield pa.RecordBatch.from_pydict({"item_id": ids_out(block.ids), "words": pa.array(own, pa.string())})

    named = items.select(F.col("item_id").alias("doc_id"), "text")
    every = settle(id_and_text(named).mapInArrow(run, "item_id long, words string").filter("words <> ''"))
    classes = every.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"))
    return settle(classes), every


def _item_words(rows: list[tuple[int, str]]) -> tuple[pa.Array, list[int], list[np.ndarray]]:
    """(distinct words, ids, word numbers) of items whose words differ."""
    ids = [i for i, _ in rows]
    w = words(_plain(np.array(ids, dtype=np.int64), [t.encode() for _, t in rows]))
    return w.types, ids, [w.code[a:z] for a, z in zip(w.first[:-1], w.first[1:])]


def word_counts(docs: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """How often each word of ``vocabulary`` occurs in all documents; its last entry counts all words."""
    n = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(n + 1, dtype=np.int64)
        for block in blocks(batches):
            w = words(_plain(block.ids, block.texts))
            at = pc.index_in(w.types, vocabulary).fill_null(n).to_numpy(zero_copy_only=False)
            total += np.bincount(at, weights=np.bincount(w.code, minlength=len(w.types)), minlength=n + 1).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    out = np.zeros(n + 1, dtype=np.float64)
    for row in id_and_text(docs).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[row["word"]] = row["n"]
    out[n] = out.sum()
    return out


def seeds_needed(n: int, min_score: float) -> int:
    """How many pairs with at most one edit inside any alignment of ``min_score`` with an item of ``n`` words holds.

    With m words matched and e edits it scores 2 m - e, and each of its m - 1 steps that is no such pair takes two edits:
    2 m - 2 (m - 1 - pairs) = 2 + 2 pairs is at least 2 n ``min_score``.
    """
    return max(1, math.ceil(n * min_score - 1 - 1e-9))


def _seeds(vocabulary: pa.Array, counts: np.ndarray, ids: np.ndarray, code: list[np.ndarray], min_score: float) -> Items:
    wide = len(vocabulary) + 1
    common = np.append(np.log(counts[:-1] + 1e-9), 0.0)
    seeds, owner = [], []
    need, span = np.ones(len(code), dtype=np.int64), np.ones(len(code), dtype=np.int64)
    for k, c in enumerate(code):
        if len(c) <= WHOLE:
            # one seed: the word alone, or both words
            pair = np.array([c[0] * wide + (c[1] if len(c) > 1 else wide - 1)])
            span[k] = len(c)
        else:
            least = seeds_needed(len(c), min_score)
            out = int(LEFT_OUT * least)
            need[k] = least - out
            # 2 m - e >= 2 n s and at least length - m edits: length <= 3 m - 2 n s, and m <= n
            span[k] = math.ceil(len(c) * (3 - 2 * min_score))
            one, two = common[c[:-1]] + common[c[1:]], np.append(common[c[:-2]] + common[c[2:]], -np.inf)
            at = np.argsort(-np.maximum(one, two), kind="stable")[out:]
            far = at[at < len(c) - 2]
            pair = np.unique(np.concatenate([c[at] * wide + c[at + 1], c[far] * wide + c[far + 2]]))
        seeds.append(pair)
        owner.append(np.full(len(pair), k))
    found, item = np.concatenate(seeds), np.concatenate(owner)
    by = np.argsort(found, kind="stable")
    return Items(vocabulary, ids, code, found[by], item[by], need, span)


def item_blocks(docs: DataFrame, classes: DataFrame, min_score: float = MIN_SCORE) -> Iterator[Items]:
    """All classes of items, a bounded block at a time, with seeds by the word counts of all documents."""
    size = classes.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = max(1, math.ceil(size / ITEM_BYTES))
    for k in range(n):
        part = classes.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == k)
        rows = sorted((NO_ID if r["item_id"] is None else r["item_id"], r["words"]) for r in part.collect())
        if rows:
            vocabulary, ids, code = _item_words(rows)
            yield _seeds(vocabulary, word_counts(docs, vocabulary), np.array(ids, dtype=np.int64), code, min_score)


def align(item: np.ndarray, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman with linear gaps: (best score, first word, end) in each passage.

    All passages are padded to one width and advance row by row. A cell carries its score and, in
    its low bits, where its alignment began: among equal scores the earliest wins.
    """
    width = max(map(len, passages))
    unit = np.int64(1) << np.int64(32)
    grid = np.full((len(passages), width), -2, dtype=np.int64)
    for k, p in enumerate(passages):
        grid[k, : len(p)] = p
    place = np.arange(width + 1, dtype=np.int64)
    fresh = unit - 1 - place  # score 0, begins here
    above = np.broadcast_to(fresh, (len(passages), width + 1)).copy()
    best = np.zeros(len(passages), dtype=np.int64)
    end = np.zeros(len(passages), dtype=np.int64)
    for word in item:
        step = np.where(grid == word, MATCH, MISMATCH) * unit
        row = np.maximum(above + GAP * unit, fresh)
        row[:, 1:] = np.maximum(row[:, 1:], above[:, :-1] + step)
        row = np.maximum.accumulate(row - GAP * unit * place, axis=1) + GAP * unit * place
        row = np.maximum(row, fresh)
        top = row.argmax(axis=1)
        value = row[np.arange(len(passages)), top]
        better = value // unit > best // unit
        best, end = np.where(better, value, best), np.where(better, top, end)
        above = row
    return best // unit, unit - 1 - best % unit, end


def _hits(code: np.ndarray, doc: np.ndarray, items: Items) -> Iterator[np.ndarray]:
    """item * len(code) + place, sorted and distinct, of every place where a seed of the item begins; whole documents at a time."""
    n, none = len(code), items.wide - 1
    known = code < none
    found = []
    size = np.zeros(n, dtype=np.int64)
    for step in (0, 1, 2):
        if step == 0 and not (items.seeds % items.wide == none).any():
            continue
        at = np.flatnonzero(known[: n - step] & known[step:] & (doc[: n - step] == doc[step:]))
        pair = code[at] * items.wide + (code[at + step] if step else none)
        lo, hi = np.searchsorted(items.seeds, pair, "left"), np.searchsorted(items.seeds, pair, "right")
        some = hi > lo
        found.append((step, at[some], lo[some], (hi - lo)[some]))
        size[found[-1][1]] += found[-1][3]
    part = np.cumsum(np.bincount(doc, weights=size))[doc] // HITS
    for k in np.unique(part[size > 0]):
        out = []
        for step, at, lo, each in found:
            own = slice(*np.searchsorted(part[at], [k, k + 1]))
            at, lo, each = at[own], lo[own], each[own]
            item = items.owner[np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(each.sum())]
            at = np.repeat(at, each)
            if step == 2:
                # the words of a short item stand side by side
                far = items.span[item] > WHOLE
                item, at = item[far], at[far]
            out.append(item * n + at)
        yield np.unique(np.concatenate(out))


def _passages(hits: np.ndarray, doc: np.ndarray, first: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, first word, end) around places that hold enough seeds of an item for a copy."""
    n = len(doc)
    item, place = hits // n, hits % n
    # a copy begins with one of its seeds at the latest and holds the others within its span
    end = np.minimum(place + items.span[item], first[doc[place] + 1])
    enough = np.searchsorted(hits, item * n + end) - np.arange(len(hits)) >= items.need[item]
    item, place, high = item[enough], place[enough], end[enough]
    own = doc[place]
    low = np.maximum(place - items.span[item] + 1, first[own])
    if not len(item):
        return own, item, low, high
    starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (item[1:] != item[:-1]) | (low[1:] >= high[:-1])])
    return own[starts], item[starts], low[starts], np.maximum.reduceat(high, starts)


def find_in_block(block: Block, items: Items, min_score: float) -> list[tuple[int, int, float, int, int]]:
    """(document, item, score, first word, end) of the best copy of each item in each document."""
    w = words(_plain(block.ids, block.texts))
    if not len(w):
        return []
    code = pc.index_in(w.types, items.vocabulary).fill_null(items.wide - 1).to_numpy(zero_copy_only=False).astype(np.int64)[w.code]
    found = [_passages(hits, w.doc, w.first, items) for hits in _hits(code, w.doc, items)]
    if not found:
        return []
    doc, item, low, high = (np.concatenate(x) for x in zip(*found))
    sizes = np.array([len(c) for c in items.code])
    code[code == items.wide - 1] = -1
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    # passages of one item and of about one length advance together
    by = np.lexsort((high - low, item))
    k = 0
    while k < len(by):
        own = item[by[k]]
        z = k + 1
        while z < len(by) and item[by[z]] == own and (z + 1 - k) * int(high[by[z]] - low[by[z]]) <= CELLS:
            z += 1
        group = by[k:z]
        score, first, end = align(items.code[own], [code[low[g] : high[g]] for g in group])
        for g, s, a, b in zip(group.tolist(), score.tolist(), first.tolist(), end.tolist()):
            share = s / (MATCH * int(sizes[own]))
            if share >= min_score:
                shift = int(low[g] - w.first[doc[g]])
                pair = (int(doc[g]), int(own))
                now = (share, -(a + shift), b + shift)
                if pair not in best or now > best[pair]:
                    best[pair] = now
        k = z
    return [(d, i, s, -a, b) for (d, i), (s, a, b) in sorted(best.items())]


def find_leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document and class of equal test items of which it holds a copy: doc_id, item_id (the least of the
    class), score (0 to 1), first_word, end_word (of the document, in words without case and punctuation).

    ``items``: (item_id, text). ``item_classes`` has the other items of a class; null and blank texts have none. An item
    without id counts like any other; its class has a null id where no item in it has one. Null texts of documents hold nothing; null and
    repeated document ids come back as they are. Empty tables give an empty one. Other columns are
    ignored. Documents are not shuffled. Items go to the tasks in blocks of bounded size; the rows of a block are written
    before the next one is read, so the driver holds one block, whatever the number of items.
    """
    return _copies(docs, item_classes(items)[0], min_score)


def leak_table(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``find_leaks`` with ``same_as`` (null there), and a row for each further item of a class: its id as item_id, the id of
    its class as same_as, all else null. So copies of equal items are told without a row for each pair of them. Repeated ids come once; an
    item without id has no such row.
    """
    classes, every = item_classes(items)
    found = _copies(docs, classes, min_score).withColumn("same_as", F.lit(None).cast("long"))
    more = classes.filter("n_items > 1").select("words", F.col("item_id").alias("same_as"))
    others = every.join(more, "words").filter("item_id <> same_as").select("item_id", "same_as").distinct()
    return found.unionByName(others, allowMissingColumns=True)


def _copies(docs: DataFrame, classes: DataFrame, min_score: float) -> DataFrame:
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for part in item_blocks(docs, classes, min_score):

        def run(batches: Iterator[pa.RecordBatch], part=part):
            for block in blocks(batches):
                rows = find_in_block(block, part, min_score)
                d, i, s, a, b = (list(x) for x in zip(*rows)) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids_out(block.ids[np.array(d, dtype=np.int64)]),
                        "item_id": ids_out(part.ids[np.array(i, dtype=np.int64)]),
                        "score": pa.array(s, pa.float64()),
                        "first_word": pa.array(a, pa.int64()),
                        "end_word": pa.array(b, pa.int64()),
                    }
                )

        out = out.unionByName(settle(id_and_text(docs).mapInArrow(run, SCHEMA)))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold a copy of no item.

    Items without id count like any other; null and blank items match nothing, so without items all rows stay. A
    document without text or words stays; null and repeated ids, and repeated rows, stay or go by their texts alone. An
    empty table gives an empty one. Other columns, whatever their names, come back as they are. Nothing is shuffled. One block of items is in
    the driver at a time; what the blocks before it left is written to the shared folder, so items of up to ``ITEM_BYTES`` cost no copy.
    """
    plain, schema = with_row(docs)
    last = None
    for part in item_blocks(docs, item_classes(items)[0], min_score):

        def run(batches: Iterator[pa.RecordBatch], part=part):
            for batch in batches:
                clean: list[bool] = []
                for block in blocks([batch.select(["doc_id", "text"])]):
                    bad = {d for d, *_ in find_in_block(block, part, min_score)}
                    clean += [d not in bad for d in range(len(block))]
                if clean:
                    yield batch.filter(pa.array(clean))

        if last is not None:
            plain = settle(last)
        last = plain.mapInArrow(run, schema)
    return without_row(plain if last is None else last, docs.columns)
