"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Words, each with its mark in front, are sorted and read as a trie, depth first.
A trie node keeps the forward state of its prefix, so the prefix that two words
share is scored once. Two kinds of model are supported:

* *unigram*: the forward state is the best score of a segmentation of the prefix
  and its last piece (Viterbi);
* *bpe*: greedy merging also has a forward recursion. A prefix has exactly one
  encoding, every head of an encoding is the encoding of its own text, and a
  piece may follow another iff merging their joint text gives back that pair.
  The forward state is the one last piece that may follow the state before it;
  all other candidates score minus infinity.

With a bpe model the ids equal those of the SentencePiece library. With a
unigram model the total score is the best one; among segmentations of equal
score the longest last piece wins.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemograph.llm.common import col

#: Fixed values of the SentencePiece format.
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0

#: Words that a worker remembers between batches, the longest word it remembers, and pairs and pieces judged.
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 500_000, 32, 1 << 17
#: A word longer than this is read on its own, without the trie's stack of states.
LONG_WORD = 4096


class Model:
    """Pieces, scores and options of a model file."""

    def __init__(self, path: str, model_type: int | None = None):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        self.kind = model_type or m.trainer_spec.model_type
        options = m.normalizer_spec
        if options.precompiled_charsmap or options.remove_extra_whitespaces or not options.escape_whitespaces:
            raise ValueError("only models with the identity normalizer are supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and bpe models are supported")
        self.dummy_prefix = options.add_dummy_prefix
        # Marks are held as the blanks that they stand for; SentencePiece reads both alike.
        self.pieces = [p.piece.replace(MARK, " ") for p in m.pieces]
        self.types = [p.type for p in m.pieces]
        self.ids = {self.pieces[i]: i for i, p in enumerate(m.pieces) if p.type in (NORMAL, USER_DEFINED)}
        if any(p.type == USER_DEFINED for p in m.pieces) or any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece crosses the start of a word, or is user-defined")
        self.scores = [p.score for p in m.pieces]
        self.longest = max(map(len, self.ids))
        self.unknown = next(i for i, t in enumerate(self.types) if t == UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        known = [self.scores[i] for i in self.ids.values()]
        self.unknown_score = min(known) - UNKNOWN_PENALTY
        self.halves = {p: self._halves(p) for p in self.ids} if self.kind == BPE else {}
        self.follows = lru_cache(CACHE_PAIRS)(self._follows)
        self._grow([p for p, halves in self.halves.items() if halves])

    # -- bpe ---------------------------------------------------------------

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes a piece of its own text; None for one character or if greedy merging never makes it."""
        parts, last = list(piece), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                made = self.ids.get(parts[i] + parts[i + 1])
                if made is not None and (best is None or self.scores[made] > best):
                    best, at = self.scores[made], i
            if best is None:
                return None
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return last

    def _follows(self, left: str, right: str) -> bool:
        """Whether the border of two pieces survives greedy merging of their joint text.

        Undoes the two pieces merge by merge, latest first. A merge across the
        border that would have come before the merge just undone breaks it. Of
        equal scores the leftmost merge comes first.
        """
        ids, scores, halves = self.ids, self.scores, self.halves
        limit, ties = float("-inf"), False  # a merge across beats this score, or meets it where ties count
        while True:
            across = ids.get(left + right)
            if across is not None and (scores[across] > limit or (ties and scores[across] == limit)):
                return False
            a = halves.get(left) if len(left) > 1 else None
            b = halves.get(right) if len(right) > 1 else None
            if a is None and b is None:
                return True
            if b is None or (a is not None and scores[ids[left]] < scores[ids[right]]):
                limit, ties, left = scores[ids[left]], False, a[1]
            else:
                limit, ties, right = scores[ids[right]], True, b[0]

    def _grow(self, pieces: list[str]) -> None:
        """An automaton that reads a word and knows at each end which pieces end there, the longest first."""
        self.step: list[dict[str, int]] = [{}]
        self.fail, self.ends = [0], [()]
        for p in pieces:
            node = 0
            for c in p:
                if c not in self.step[node]:
                    self.step[node][c] = len(self.step)
                    self.step.append({})
                    self.fail.append(0)
                    self.ends.append(())
                node = self.step[node][c]
            self.ends[node] = (len(p),)
        level = list(self.step[0].values())
        while level:
            below = []
            for node in level:
                self.ends[node] += self.ends[self.fail[node]]
                for c, child in self.step[node].items():
                    back = self.fail[node]
                    while back and c not in self.step[back]:
                        back = self.fail[back]
                    self.fail[child] = self.step[back].get(c, 0)
                    below.append(child)
            level = below

    def _next(self, node: int, c: str) -> int:
        while node and c not in self.step[node]:
            node = self.fail[node]
        return self.step[node].get(c, 0)

    # -- the trie ----------------------------------------------------------

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, its pieces) of distinct words; shared prefixes are scored once.

        ``last[d]`` is the length of the last piece of the first d characters of
        the word at hand, ``state[d]`` their score in a unigram model, or where
        the automaton is after them.
        """
        before, last, state = "", [0], [0]
        advance = self._best if self.kind == UNIGRAM else self._only
        for word in sorted(words):
            shared, top = 0, min(len(before), len(word))
            while shared < top and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], state[shared + 1 :]
            advance(word, shared, last, state)
            parts, at = [], len(word)
            while at:
                length = last[at]
                parts.append(word[at - length : at])
                at -= length
            parts.reverse()
            yield word, parts
            before = word

    def _best(self, word: str, shared: int, last: list[int], state: list) -> None:
        """Viterbi: for each further end, the best-scored way to end a piece there."""
        for end in range(shared + 1, len(word) + 1):
            best, length = float("-inf"), 0
            for start in range(max(0, end - self.longest), end):
                piece = self.ids.get(word[start:end])
                if piece is not None:
                    s = self.scores[piece]
                elif start == end - 1:
                    s = self.unknown_score
                else:
                    continue
                if (s := s + state[start]) > best:
                    best, length = s, end - start
            last.append(length)
            state.append(best)

    def _only(self, word: str, shared: int, last: list[int], state: list) -> None:
        """Greedy merging: for each further end, the one piece that may end there."""
        step, ends, follows, node, end = self.step, self.ends, self.follows, state[shared], shared
        for c in word[shared:]:
            end += 1
            to = step[node].get(c)
            node = self._next(node, c) if to is None else to
            state.append(node)
            for n in ends[node]:
                start = end - n
                if not start or follows(word[start - last[start] : start], word[start:end]):
                    last.append(n)
                    break
            else:
                # One character always is a piece of its own; no longer one may end here, so this one does.
                last.append(1)

    # -- ids and texts -----------------------------------------------------

    def piece_ids(self, parts: list[str]) -> list[int]:
        """Ids of pieces; an unknown one becomes its bytes, or the unknown id if there are no byte pieces."""
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def marked(self, text: str) -> list[str]:
        """The marked words of a text, which no piece crosses."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        return _WORDS.findall(" " + text if self.dummy_prefix else text)

    @property
    def surface(self) -> list[bytes]:
        """What each id stands for."""
        out = []
        for p, t in zip(self.pieces, self.types, strict=True):
            if t == BYTE:
                out.append(bytes([int(p[1:-1], 16)]))
            elif t == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append(b"" if t == CONTROL else p.encode())
        return out


_WORDS = re.compile(" +[^ ]*|[^ ]+")


def encode_texts(model: Model, texts: list[str], cache: dict[str, bytes]) -> list[np.ndarray]:
    """Ids of each text. ``cache`` keeps the packed ids of words between calls, within its bound."""
    if len(cache) > CACHE_WORDS:
        cache.clear()
    split = [model.marked(t) for t in texts]
    new = set().union(*split) - cache.keys()
    long_ = [w for w in new if len(w) > LONG_WORD]
    for words in (new.difference(long_), *([w] for w in long_)):
        for w, parts in model.segment(words):
            cache[w] = _pack(model.piece_ids(parts))
    out = [np.frombuffer(b"".join(map(cache.__getitem__, words)), np.int32) for words in split]
    for w in new:
        if len(w) > CACHE_CHARS:
            del cache[w]
    return out


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"={len(ids)}i", *ids)


def decode_ids(surface: list[bytes], ids: Iterable[int], dummy_prefix: bool) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD, the mark of the dummy prefix goes."""
    raw = b"".join([surface[i] for i in ids])
    return (raw[1:] if dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


#: About this many characters are encoded at once.
BATCH_CHARS = 2 << 20


def encode(
    docs: DataFrame, key: str, text: str, model_path: str, model_type: int | None = None, with_text: bool = False
) -> DataFrame:
    """(key, ids array<int>) of each row's whole text; ``with_text`` adds the text decoded from the ids.

    ``model_path`` is a file that every executor has. ``model_type`` overrides
    the kind of model named in the file (1 unigram, 2 bpe).

    Defined cases: a null text gives null ids, an empty one no ids; repeated
    rows and null keys pass through; other columns are not read; a word of any
    length is encoded whole; an empty table gives an empty table.
    """
    source = docs.select(col(key).alias("key"), col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, surface, cache = _loaded(model_path, model_type)
        for batch in batches:
            at = 0
            for texts in _portions(batch["text"]):
                found = iter(encode_texts(model, [t for t in texts if t is not None], cache))
                ids = [None if t is None else next(found) for t in texts]
                columns = [batch["key"].slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32()))]
                if with_text:
                    back = [None if x is None else decode_ids(surface, x.tolist(), model.dummy_prefix) for x in ids]
                    columns.append(pa.array(back, pa.string()))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "text"][: len(columns)])

    schema = f"key {kind}, ids array<int>" + ", text string" * with_text
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


@lru_cache(2)
def _loaded(path: str, model_type: int | None) -> tuple[Model, list[bytes], dict[str, bytes]]:
    """A model, its surfaces and its cache of words, kept by a Python worker for its next tasks."""
    model = Model(path, model_type)
    return model, model.surface, {}


def _portions(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in lists of about ``BATCH_CHARS`` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def decode(encoded: DataFrame, key: str, model_path: str, ids: str = "ids") -> DataFrame:
    """(key, ids, text): ids back to text; null ids give a null text, an id outside the model fails the task."""
    source = encoded.select(col(key).alias("key"), col(ids).alias("ids"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_path)
        surface = model.surface
        for batch in batches:
            texts = [None if x is None else decode_ids(surface, x, model.dummy_prefix) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["ids"], pa.array(texts, pa.string())], ["key", "ids", "text"])

    return source.mapInArrow(run, f"key {kind}, ids array<int>, text string").withColumnRenamed("key", key)
