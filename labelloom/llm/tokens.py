"""Token counts of a unigram vocabulary without the tokens (operator 8).

Words are parted by blanks and start with the word mark. An Aho-Corasick automaton lists the
vocabulary pieces in a word, and one pass from left to right carries the best score and the piece
count of every end. Ties go to the piece that begins first, characters that no piece covers cost
the least score of the vocabulary less ten, and neighbours of that kind are one token or, with byte
pieces, one token for each byte: the rules of the public unigram tokenizers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelloom.llm.blocks import blocks, id_and_text, ids_out, words

MARK = "▁"
PENALTY = 10.0
#: Words whose counts a Python worker remembers; it forgets them all when there are more.
KNOWN_WORDS = 600_000
#: Words whose pieces are found together.
TOGETHER = 20_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; ``bytes_too``: an unknown character is as many tokens as it has bytes."""

    pieces: tuple[tuple[str, float], ...]
    bytes_too: bool = False

    @staticmethod
    def from_model(path: str) -> Vocabulary:
        """The ordinary pieces of a public SentencePiece model file, byte pieces being noted only."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = tuple((model.id_to_piece(i), model.get_score(i)) for i in plain)
        return Vocabulary(pieces, any(model.is_byte(i) for i in ids))


class Counter:
    """The vocabulary as an automaton whose matches carry the piece's number."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        sizes, scores = [], []
        for piece, score in vocabulary.pieces:
            if piece and piece not in self.found:
                self.found.add_word(piece, len(sizes))
                sizes.append(len(piece))
                scores.append(score)
        self.found.make_automaton()
        self.size, self.score = np.array(sizes, dtype=np.int64), np.array(scores, dtype=np.float64)
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - PENALTY
        self.bytes_too = vocabulary.bytes_too

    def _edges(self, text: str, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(end, start, score, unknown) of all pieces in ``text``; ``first[i]``: where the word of character i begins."""
        flat = np.fromiter((x for m in self.found.iter(text) for x in m), dtype=np.int64) if len(self.size) else np.zeros(0, dtype=np.int64)
        end, piece = flat[::2] + 1, flat[1::2]
        start = end - self.size[piece]
        own = start >= first[end - 1]
        end, start, score = end[own], start[own], self.score[piece[own]]
        alone = np.zeros(len(text) + 1, dtype=bool)
        alone[end[end - start == 1]] = True
        bare = np.flatnonzero(~alone[1:] & (first >= 0)) + 1
        flag = np.repeat([False, True], [len(end), len(bare)])
        return np.r_[end, bare], np.r_[start, bare - 1], np.r_[score, np.full(len(bare), self.unknown)], flag

    def count(self, words_: list[str]) -> np.ndarray:
        """Tokens of each word, marks included. All words advance together, one character a step."""
        text = "\n".join([*words_, ""])
        sizes = np.fromiter(map(len, words_), dtype=np.int64, count=len(words_))
        begin = np.cumsum(sizes + 1) - sizes - 1
        first = np.repeat(begin, sizes + 1)
        first[begin + sizes] = -1  # the line feeds between words
        if len(text) == 0:
            return np.zeros(0, dtype=np.int64)
        limit = np.where(first < 0, len(text) + 1, first)
        end, start, score, unknown = self._edges(text, limit)
        usable = first[end - 1] >= 0
        end, start, score, unknown = end[usable], start[usable], score[usable], unknown[usable]
        step = end - first[end - 1]
        by = np.lexsort((start, end, step))
        end, start, score, unknown, step = end[by], start[by], score[by], unknown[by], step[by]
        wide = np.ones(len(text) + 1, dtype=np.int64)
        if self.bytes_too:
            points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            wide[1:] = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        best = np.zeros(len(text) + 1)
        pieces = np.zeros(len(text) + 1, dtype=np.int64)
        run = np.zeros(len(text) + 1, dtype=np.int64)  # tokens of the unknown run that ends here, not yet in ``pieces``
        cuts = np.r_[np.flatnonzero(np.diff(step, prepend=0)), len(step)]
        for a, z in zip(cuts[:-1], cuts[1:]):
            e, s, u = end[a:z], start[a:z], unknown[a:z]
            value = best[s] + score[a:z]
            groups = np.flatnonzero(np.diff(e, prepend=-1))
            top = np.maximum.reduceat(value, groups)
            good = np.flatnonzero(value == np.repeat(top, np.diff(np.r_[groups, len(e)])))
            good = good[np.diff(e[good], prepend=-1) > 0]  # the first start among equal scores
            e, s, u = e[good], s[good], u[good]
            best[e] = top
            pieces[e] = np.where(u, pieces[s], pieces[s] + run[s] + 1)
            run[e] = np.where(u, run[s] + wide[e] if self.bytes_too else 1, 0)
        return (pieces + run)[begin + sizes]


_WORKER: dict[Vocabulary, tuple[Counter, dict[bytes, int]]] = {}


def _worker(vocabulary: Vocabulary) -> tuple[Counter, dict[bytes, int]]:
    """The counter of this Python process and the words it knows; a worker serves many tasks."""
    if vocabulary not in _WORKER:
        _WORKER.clear()
        _WORKER[vocabulary] = (Counter(vocabulary), {})
    return _WORKER[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens of the whole text.

    A null or blank text has none. Null and repeated ids come back as they are; an empty table gives
    an empty one; other columns are ignored. Each distinct word of a block is counted once, and a
    worker remembers the words it knows up to a bound. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        counter, known = _worker(vocabulary)
        for block in blocks(batches):
            w = words(block)
            types = w.types.to_pylist()
            if len(known) + len(types) > KNOWN_WORDS:
                known.clear()
            new = [t for t in types if t not in known]
            for part in range(0, len(new), TOGETHER):
                some = sorted(new[part : part + TOGETHER], key=len)
                known.update(zip(some, counter.count([MARK + t.decode() for t in some]).tolist()))
            each = np.fromiter((known[t] for t in types), dtype=np.int64, count=len(types))
            total = np.concatenate([[0], np.cumsum(each[w.code] if len(w) else np.zeros(0, dtype=np.int64))])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids_out(block.ids), "n_words": np.diff(w.first), "n_tokens": np.diff(total[w.first])}
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
