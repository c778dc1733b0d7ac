"""Token counts of a unigram vocabulary, without the tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary file of a public tokenizer, read on the driver.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: An unknown character scores this much less than the lowest piece.
UNKNOWN = 10.0
#: Words whose counts a worker remembers, and their length at most.
HELD, HELD_LENGTH = 400_000, 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, and whether unknown characters fall back to bytes. A tokenizer's file bounds its size."""

    pieces: dict[str, float]
    bytes_: bool

    @staticmethod
    def read(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        usable = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in usable}, any(model.is_byte(i) for i in ids))

    def digest(self) -> str:
        """Of all pieces with their scores: vocabularies that differ in any have different ones."""
        return hashlib.sha256(repr((self.bytes_, sorted(self.pieces.items()))).encode("utf-8", "surrogatepass")).hexdigest()

    def splits(self) -> bool:
        """Whether no piece has a space mark after another character, so that words can be counted one by one."""
        return not any(SPACE in p.lstrip(SPACE) for p in self.pieces)


class Counter(dict):
    """Number of pieces of the best segmentation of a string; strings seen before are looked up."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.unknown = min(vocabulary.pieces.values()) - UNKNOWN
        self.bytes_ = vocabulary.bytes_
        self.splits = vocabulary.splits()

    def __missing__(self, text: str) -> int:
        n = self.count(text)
        if len(text) <= HELD_LENGTH:
            if len(self) >= HELD:
                self.clear()
            self[text] = n
        return n

    def count(self, text: str) -> int:
        """Viterbi over all pieces that occur, by end position; best score and its number of pieces are all that is kept.

        Of equal scores the longest last piece wins: the automaton gives the pieces of an end longest first, and only a
        higher score replaces one. A character without a piece of its own is an unknown, last in turn; it counts as its
        bytes, or runs of them as one.
        """
        low = float("-inf")
        best, pieces, unknown = [0.0] + [low] * len(text), [0] * (len(text) + 1), [False] * (len(text) + 1)
        found = self.automaton.iter(text)
        end, match = next(found, (len(text), None))
        for i, c in enumerate(text):
            top, n = low, 0
            while end == i:
                score = best[i + 1 - match[0]] + match[1]
                if score > top:
                    top, n = score, pieces[i + 1 - match[0]] + 1
                end, match = next(found, (len(text), None))
            if c not in self.single and (score := best[i] + self.unknown) > top:
                top, n = score, pieces[i] + (len(c.encode("utf-8", "surrogatepass")) if self.bytes_ else not unknown[i])
                unknown[i + 1] = True
            best[i + 1], pieces[i + 1] = top, n
        return pieces[-1]

    def of(self, text: str) -> int:
        """Spaces become marks and one mark goes first; nothing else is changed. An empty text has no tokens."""
        if not text:
            return 0
        if not self.splits:
            return self[SPACE + text.replace(" ", SPACE)]
        words = text.split(" ")
        if "" not in words:
            return sum(map(self.__getitem__, words_marked(words)))
        runs, marks = [], ""
        for word in words:
            marks += SPACE
            if word:
                runs.append(marks + word)
                marks = ""
        return sum(map(self.__getitem__, [*runs, marks] if marks else runs))


def words_marked(words: list[str]) -> list[str]:
    return [SPACE + w for w in words]


_made: dict[str, Counter] = {}


def counted(vocabulary: object) -> Callable:
    """(id, text) to (id, n_chars, n_tokens); vocabulary is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (counter := _made.get(vocabulary.id)) is None:
            counter = _made[vocabulary.id] = Counter(vocabulary.value)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, texts), pa.int64()), pa.array(map(counter.of, texts), pa.int64())], ["id", "n_chars", "n_tokens"])

    return run


class _Shared:
    """A broadcast with a name that workers can keep what they made of it under."""

    def __init__(self, broadcast: object, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | Vocabulary = VOCABULARY) -> DataFrame:
    """One row for each document: doc_id, n_chars, n_tokens.

    Tokens are those of a unigram tokenizer with this vocabulary: the segmentation with the highest sum of scores, in
    double precision. Null and empty texts have none. Texts are worked on whole, in linear time.
    """
    held = vocabulary if isinstance(vocabulary, Vocabulary) else Vocabulary.read(vocabulary)
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(held), held.digest())
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(counted(shared), f"id {kind}, n_chars long, n_tokens long").withColumnRenamed("id", "doc_id")
