"""Token counts of a unigram tokenizer without its tokens: a Viterbi pass that carries score and count alone.

A text is parted at ASCII white space and each word gets the word mark in front. An Aho-Corasick automaton of the
vocabulary names all pieces that end at each character; the best score of a segmentation up to there and its number of
pieces follow from those of the pieces' starts. Rules that decide between segmentations are those of the ``tokenizers``
library's unigram model: a character that is no piece by itself may be an unknown piece, scored ten below the lowest
score; of equal scores the one whose last piece starts first wins; neighbouring unknown pieces are one token.

Words are remembered per Python worker, up to a bound. Texts are counted where they are read: no shuffle.

Edge cases: NULL, empty and blank texts have no token; a text of one endless word takes memory in proportion to it;
rows are counted one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from clickmart.llm.common import flat_schema, map_rows, texts_of, utf8

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 400_000
LONGEST_CACHED = 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, the unknown piece first; control and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    unknown = model.unk_id()
    special = lambda i: i == unknown or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
    normal = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]
    return [(model.id_to_piece(unknown), 0.0), *normal]


class Counter:
    """Scores and counts of words by a vocabulary whose first piece is the unknown one."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            self.automaton.add_word(piece, (len(piece), score, i == 0))
        self.automaton.make_automaton()
        self.unknown_score = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[bytes, tuple[float, int, int]] = {}

    def word(self, word: str) -> tuple[float, int, int]:
        """Score, tokens and unknown tokens of the best segmentation."""
        n = len(word)
        score: list[float | None] = [0.0] + [None] * n
        tokens, unknown, ends_unknown = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(word)
        end, piece = next(matches, (n, None))
        for at in range(n):
            to, alone = at + 1, False
            while end == at:  # longest first, so that the earliest start is kept among equal scores
                length, own, is_unknown = piece
                alone = alone or length == 1
                start = to - length
                if score[to] is None or score[start] + own > score[to]:
                    self._step(score, tokens, unknown, ends_unknown, start, to, own, is_unknown)
                end, piece = next(matches, (n, None))
            if not alone and (score[to] is None or score[at] + self.unknown_score > score[to]):
                self._step(score, tokens, unknown, ends_unknown, at, to, self.unknown_score, True)
        return score[n], tokens[n], unknown[n]

    @staticmethod
    def _step(
        score: list, tokens: list, unknown: list, ends_unknown: list, start: int, to: int, own: float, is_unknown: bool
    ) -> None:
        fused = is_unknown and ends_unknown[start]
        score[to] = score[start] + own
        tokens[to] = tokens[start] + (not fused)
        unknown[to] = unknown[start] + (is_unknown and not fused)
        ends_unknown[to] = is_unknown

    def text(self, text: bytes) -> tuple[int, int, int, float]:
        """Words, tokens, unknown tokens and score."""
        words, known = text.split(), self.known
        score, tokens, unknown = 0.0, 0, 0
        for word in words:
            found = known.get(word)
            if found is None:
                found = self.word(MARK + word.decode())
                if len(known) >= CACHED_WORDS:
                    known.clear()
                if len(word) <= LONGEST_CACHED:
                    known[word] = found
            score += found[0]
            tokens += found[1]
            unknown += found[2]
        return len(words), tokens, unknown, score


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


COUNTS = flat_schema("doc_id long, n_words long, n_tokens long, n_unknown long, score double")


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown and the score of the best segmentation by the pieces of the file ``model``."""

    def run(ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        own = counter(model)
        for doc_id, text in zip(ids.to_pylist(), utf8(texts), strict=True):
            yield doc_id, *own.text(text)

    return map_rows(texts_of(docs), run, COUNTS)
