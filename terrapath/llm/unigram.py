"""Token counts without tokens: a Viterbi search that carries the best score and its piece count only.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at each character; the
search keeps, per position, the best score of a segmentation and how many pieces it has. The tie
rules are those of the unigram tokenizer in the ``tokenizers`` library: positions are extended from
left to right and a later candidate wins only with a strictly greater score, so of equal scores the
longest last piece stays; characters without a piece cost the least score minus 10, and a run of
them counts as one piece.

The vocabulary is that of piece_bpe_32k.model, a BPE model, as no unigram model ships with the files: its
negative merge ranks (-1e9 for runs of spaces) serve as scores and its byte pieces are left out, so counts
differ from the model's own BPE counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_text

SPACE = "▁"
UNK_PENALTY = 10.0
#: Distinct words whose counts a worker remembers, and characters of such a word.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a model file with their scores, by id; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in kept]


class Counter:
    """Counts the pieces of words under one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNK_PENALTY
        self.empty = not vocabulary
        self.cache: dict[str, int] = {}

    def pieces(self, text: str) -> int:
        """The number of pieces of the best segmentation of ``text``."""
        n = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(text) if not self.empty else ():
            ending[end + 1].append(found)
        score = [0.0] + [-math.inf] * n
        count = [0] * (n + 1)
        strange = [False] * (n + 1)
        for end in range(1, n + 1):
            best, at, unknown = -math.inf, -1, True
            # Longest first: its start comes first, and a later start must be strictly better.
            for size, piece in sorted(ending[end], reverse=True):
                if (s := score[end - size] + piece) > best:
                    best, at, unknown = s, end - size, False
            if not any(size == 1 for size, _ in ending[end]) and (s := score[end - 1] + self.unknown) > best:
                best, at, unknown = s, end - 1, True
            score[end], strange[end] = best, unknown
            count[end] = count[at] + (not (unknown and at and strange[at]))
        return count[n]

    def word(self, word: str) -> int:
        found = self.cache.get(word)
        if found is None:
            found = self.pieces(word)
            if len(word) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def text(self, text: str | None) -> int:
        """Pieces of a text: its words with the space mark before each, at each space and the start."""
        if not text:
            return 0
        words = text.split(" ")
        if words[0] == "" and len(words) > 1:
            words = words[1:]  # a text that begins with a space gets no second mark
        return sum(map(self.word, [SPACE + w for w in words]))


_KNOWN: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _KNOWN:
        _KNOWN[path] = Counter(load_vocabulary(path))
    return _KNOWN[path]


def count(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_chars, n_tokens) of every row, from its whole text; no tokens are made.

    Null or empty text: 0 tokens. Repeated rows are counted each. An empty table gives an empty result.
    Other columns are not read. The state per word is two numbers per character, so a very long word
    takes memory in proportion to its length.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            n = pa.array([counter.text(x) for x in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_chars"), n], names=["doc_id", "n_chars", "n_tokens"])

    plain = id_text(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return plain.mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
