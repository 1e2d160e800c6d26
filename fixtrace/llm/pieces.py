"""SentencePiece encoding and decoding as a weighted finite-state transduction (operator 4)."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose pieces a process remembers in each of two generations, and pairs of pieces whose weight it remembers.
REMEMBERED_WORDS = 100_000
REMEMBERED_PAIRS = 1 << 20
REMEMBERED_LENGTH = 256
#: Models that a process keeps compiled.
REMEMBERED_MODELS = 2
#: Texts that are encoded before their ids leave the task.
GROUP_ROWS, GROUP_CHARACTERS = 512, 1 << 18

_GAP = "▁"  # what a model writes for a space
_USER_MARK = "\0"
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 1, 2, 4, 5, 6
_INFINITE = float("inf")
_START = -1
_CHARACTERS = 1 << 21  # more than there are pieces and characters
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Arcs:
    """Arcs (state, character) -> state of a trie as an open hash table that looks up many at once."""

    def __init__(self, arcs: dict[int, int]):
        self.bits = max(4, (4 * len(arcs)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, dtype=np.int64)
        self.states = np.zeros(len(self.keys), dtype=np.int32)
        keys = np.fromiter(arcs, np.int64, len(arcs))
        self.probes = 1
        for key, place, state in zip(keys.tolist(), self._place(keys).tolist(), arcs.values()):
            at = place
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.states[at] = key, state
            self.probes = max(self.probes, at - place + 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The states that arcs lead to, -1 where there is none."""
        place, found = self._place(keys), np.full(len(keys), -1, dtype=np.int64)
        here = self.keys[place]
        same = here == keys
        found[same] = self.states[place[same]]
        left = np.flatnonzero(~same & (here >= 0))
        for probe in range(1, self.probes):
            if not len(left):
                break
            at = place[left] + probe
            here = self.keys[at]
            same = here == keys[left]
            found[left[same]] = self.states[at[same]]
            left = left[~same & (here >= 0)]
        return found


class Pairs:
    """Weights of neighbours that were asked before, in a table of fixed size with two places for each pair."""

    def __init__(self, weigh):
        self.weigh = weigh
        self.keys = np.full(REMEMBERED_PAIRS, -1, dtype=np.int64)
        self.free = np.zeros(REMEMBERED_PAIRS, dtype=bool)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two neighbouring arcs weigh nothing rather than infinitely much."""
        keys = left * _CHARACTERS + right
        place = ((keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - REMEMBERED_PAIRS.bit_length() + 1)).astype(np.int64)
        found = self.free[place]
        new = np.flatnonzero(self.keys[place] != keys)
        other = place[new] ^ 1
        found[new] = self.free[other]
        new = new[self.keys[other] != keys[new]]
        if len(new):
            asked, at, back = np.unique(keys[new], return_index=True, return_inverse=True)
            free = np.fromiter((self.weigh(k // _CHARACTERS, k % _CHARACTERS) for k in asked.tolist()), bool, len(asked))
            found[new] = free[back]
            place = place[new[at]]
            place ^= self.keys[place] >= 0  # the second place, where the first is taken
            self.keys[place], self.free[place] = asked, free
        return found


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of ranges, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Remembered:
    """Words and their piece ids: a number for each word, and the ids of all words in one array."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        held = len(self.numbers)
        self.numbers.update(zip(words, range(held, held + len(words))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])

    def ids_of(self, words, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and their number by word."""
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words) if count is None else count)
        sizes = self.sizes[number]
        return self.ids[_within(self.starts[number], sizes)], sizes

    def without(self, words: list[str]) -> Remembered:
        kept, left = Remembered(), set(words)
        names = [w for w in self.numbers if w not in left]
        kept.add(names, *self.ids_of(names))
        return kept


class CharacterMap:
    """Transducer of the normaliser's rules: the longest rule that begins at a place is applied there.

    Its states are the nodes of the double array that the model file holds; a step by a byte is an arc, and the value of a
    final node is the place of its output. A character that no rule begins with is written as it is.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.outputs = blob[4 + size:]
        self.known: dict[str, tuple[str, int]] = {}

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def step(self, text: str, at: int) -> tuple[str, int]:
        """Output at a place and the number of characters read."""
        best = (text[at], 1)
        if not self.units:
            return best
        node = self._jump(self.units[0])
        for end in range(at, len(text)):
            for byte in text[end].encode("utf-8", "replace"):
                node ^= byte
                if node >= len(self.units) or self.units[node] & (1 << 31 | 0xFF) != byte:
                    return best
                final = self.units[node] >> 8 & 1
                node ^= self._jump(self.units[node])
            if final:
                place = self.units[node] & ((1 << 31) - 1)
                best = (self.outputs[place:self.outputs.index(b"\0", place)].decode("utf-8"), end - at + 1)
        return best


class PieceTransducer:
    """Normaliser, pieces and byte fallback of a model, compiled for composition with texts.

    Three transducers stand one behind the other. The normaliser rewrites characters, marks spaces and, if the
    model says so, drops repeated ones. The second reads normalised characters along a trie, whose final states write a
    piece id and go back to the start; a character that no piece writes alone goes back by writing its bytes. The third reads
    piece ids and weighs neighbours. A path weighs the sum of its arcs (tropical semiring: sums along a path, the
    minimum over paths); a text's encoding is the output of its lightest path.

    * Unigram models: an arc weighs the negated score of its piece, neighbours nothing.
    * BPE models: an arc weighs nothing; two neighbours weigh nothing if merging their texts alone gives just these two
      pieces, and infinitely much otherwise. Merging a whole text leaves a boundary between two pieces exactly if
      merging the two pieces leaves it, as merges elsewhere do not touch it. So one path of finite weight is left,
      the result of all merges.

    Composition is lazy: only states that a text reaches are made. Between two characters that stand together
    in no piece every path passes the start, so a text falls into parts there; parts that occur again are looked up.
    """

    def __init__(self, path: str):
        self.path, self.ready = path, False

    def __getstate__(self):  # the tables are compiled where they are used
        return {"path": self.path, "ready": False}

    def compile(self) -> PieceTransducer:
        if self.ready:
            return self
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(self.path, "rb") as file:
            model.ParseFromString(file.read())
        self.build(model)
        return self

    def build(self, model) -> None:
        how, kind = model.normalizer_spec, model.trainer_spec
        if not how.escape_whitespaces or kind.treat_whitespace_as_suffix or kind.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models that mark gaps before words are supported")
        self.unigram = kind.model_type == _UNIGRAM
        self.map = CharacterMap(how.precompiled_charsmap)
        self.squeeze, self.prefix = how.remove_extra_whitespaces, _GAP if how.add_dummy_prefix else ""
        self.texts = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == _UNKNOWN), 0)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        user = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _USER}
        if any(_GAP in t or " " in t for t in user) or (not self.unigram and _UNUSED in self.kinds):
            raise ValueError("user pieces with gaps and unused pieces of BPE models are not supported")
        whole = sorted(user, key=len, reverse=True)
        self.user = re.compile("|".join(map(re.escape, whole))) if user else None
        self.user_ids = user
        self.worst = max([-s for s in self.scores.values()], default=0.0) + 10.0
        best = max([0.0, *self.scores.values()])
        weights = {t: -s for t, s in self.scores.items()} if self.unigram else {
            t: 0.0 for t in self.ids if self._merged(t) == [t]}
        if self.unigram:  # user pieces are arcs like others, but for their weight
            weights |= {t: -(len(t.encode()) * best - 0.1) for t in user}
        known = self.ids | user
        nodes, states, self.writes = {}, 1, {}
        for text in weights:
            state = 0
            for character in text:
                key = state * _CHARACTERS + ord(character)
                state = nodes.setdefault(key, states)
                states += state == states
            self.writes[state] = known[text]
        self.arcs = Arcs(nodes)
        #: What a state of the trie writes on its way back to the start, -1 for nothing, and what that weighs.
        self.output = np.full(states, -1, dtype=np.int64)
        self.output[list(self.writes)] = list(self.writes.values())
        self.weights = np.zeros(len(self.texts))
        self.weights[[known[t] for t in weights]] = list(weights.values())
        self.single = np.array(sorted(ord(t) for t in self.ids if len(t) == 1), dtype=np.int64)
        inside = {t[k:k + 2] for t in (*self.ids, *(user if self.unigram else ())) for k in range(len(t) - 1)}
        self.inside = Arcs({ord(p[0]) * _CHARACTERS + ord(p[1]): 1 for p in inside})
        self.gaps_part = not any(p[1] == _GAP and p[0] != _GAP for p in inside)
        #: Words at single spaces are parts if no piece goes on behind a gap that follows something else.
        self.simple = not self.map.units and not self.squeeze and self.user is None and self.prefix == _GAP and self.gaps_part
        #: What an id decodes to by itself; None where that depends on what stands beside it.
        self.plain = [t.replace(_GAP, " ") if k in (_NORMAL, _USER, _UNUSED) else " ⁇ " if k == _UNKNOWN else "" if k != _BYTE else None
                      for t, k in zip(self.texts, self.kinds)]
        for byte, i in self.bytes.items():
            self.plain[i] = chr(byte) if byte < 128 else None
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.young, self.old = Remembered(), Remembered()
        self.pairs = Pairs(self._apart)
        self.ready = True

    # Normaliser

    def normalise(self, text: str) -> str:
        """Output of the first transducer for a whole text."""
        if not self.map.units and not self.squeeze:
            return self.prefix + text.replace(" ", _GAP) if text else ""
        parts, at, after_space = [], 0, self.squeeze
        while at < len(text):
            user = self.user.match(text, at) if self.user else None
            out, read = (user[0], len(user[0])) if user else self.map.step(text, at)
            at += read
            while after_space and out.startswith(" "):
                out = out[1:]
            if out:
                parts.append(out)
                after_space = self.squeeze and out.endswith(" ")
        whole = "".join(parts).replace(" ", _GAP)
        if self.squeeze:
            whole = whole.rstrip(_GAP)
        return self.prefix + whole if whole or (text and not self.squeeze) else ""

    # Weights of neighbours

    def _merged(self, text: str) -> list[str]:
        """All merges of a short text: the best scored neighbours first, the leftmost of equal ones."""
        parts = list(text)
        scores = [self.scores.get(a + b, -_INFINITE) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == -_INFINITE:
                break
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = self.scores.get(parts[at - 1] + parts[at], -_INFINITE)
            if at < len(scores):
                scores[at] = self.scores.get(parts[at] + parts[at + 1], -_INFINITE)
        return parts

    def _text(self, arc: int) -> str:
        return self.texts[arc] if arc < len(self.texts) else chr(arc - len(self.texts))

    def _apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring arcs weigh nothing rather than infinitely much."""
        texts = [self._text(left), self._text(right)]
        return self._merged("".join(texts)) == texts

    # Composition and shortest path

    def _composed(self, characters: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ways of the second transducer from its start back to it, for all places: (first character, end, arc).

        All places step through the trie together, one character at a time, until no way goes on. ``ends`` has for each
        character the end of its part.
        """
        at = np.arange(len(characters))
        state = self.arcs.find(characters)  # arcs of the start have keys of the character alone
        alone = np.isin(characters, self.single, invert=True)
        found = [(at[alone], at[alone] + 1, len(self.texts) + characters[alone])]
        depth = 1
        while True:
            alive = np.flatnonzero(state >= 0)
            at, state = at[alive], state[alive]
            written = self.output[state]
            ways = np.flatnonzero(written >= 0)
            found.append((at[ways], at[ways] + depth, written[ways]))
            more = np.flatnonzero(at + depth < ends[at])
            if not len(more):
                break
            at, state = at[more], state[more]
            state = self.arcs.find(state * _CHARACTERS + characters[at + depth])
            depth += 1
        return tuple(np.concatenate(column) for column in zip(*found))

    def shortest(self, characters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs of the lightest paths through parts of a text, one after the other, and their number by part.

        A state of the composition is a place with the arc that led to it. In a BPE model a place has one such arc of
        finite weight, the last piece of what stands before it; in a unigram model only the lightest matters. So there is
        one state for each place. Places are settled from left to right, at the same distance from the start in all
        parts at once; of equally light paths the one with the longer last piece stays.
        """
        lengths = np.diff(np.append(starts, len(characters)))
        part = np.repeat(np.arange(len(starts)), lengths)
        first, end, arc = self._composed(characters, np.repeat(starts + lengths, lengths))
        own = part[first]
        order = np.argsort(first - starts[own], kind="stable")
        first, end, arc, own = first[order], end[order], arc[order], own[order]
        from_, to = first + own, end + own  # each part has a place more than characters
        weight = np.where(arc < len(self.texts), self.weights[np.minimum(arc, len(self.texts) - 1)], self.worst)
        places = len(characters) + len(starts)
        total, last, back = np.full(places, _INFINITE), np.full(places, _START), np.zeros(places, dtype=np.int64)
        total[starts + np.arange(len(starts))] = 0.0
        bounds = np.searchsorted((first - starts[own]), np.arange(int(lengths.max(initial=0)) + 1))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            here, there, by = from_[low:high], to[low:high], arc[low:high]
            path = total[here] + weight[low:high]
            if not self.unigram:
                path = np.where(last[here] == _START, path, _INFINITE)
                inner = np.flatnonzero(last[here] != _START)
                if len(inner):
                    path[inner[self.pairs.find(last[here[inner]], by[inner])]] = 0.0
            better = np.flatnonzero(path < total[there])
            there = there[better]
            total[there], last[there], back[there] = path[better], by[better], here[better]
        # Back along all paths at once.
        place, which, steps = starts + lengths + np.arange(len(starts)), np.arange(len(starts)), []
        while len(which):
            steps.append((which, last[place]))
            place = back[place]
            more = np.flatnonzero(last[place] != _START)
            place, which = place[more], which[more]
        which, path = np.concatenate([w for w, _ in steps]), np.concatenate([a for _, a in steps])
        return path[::-1][np.argsort(which[::-1], kind="stable")], np.bincount(which, minlength=len(starts))

    def transduce(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of normalised words, one after the other, and their number by word."""
        characters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        opens = np.zeros(len(characters), dtype=bool)
        opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        opens[1:] |= self.inside.find(characters[:-1] * _CHARACTERS + characters[1:]) < 0
        starts = np.flatnonzero(opens)
        path, counts = self.shortest(characters, starts)
        word = np.repeat(np.repeat(np.arange(len(words)), sizes)[starts], counts)
        odd = np.flatnonzero(path >= len(self.texts))
        if len(odd):  # characters that no piece writes
            written = [self._written(arc) for arc in path[odd].tolist()]
            more = np.ones(len(path), dtype=np.int64)
            more[odd] = [len(w) for w in written]
            path, word = np.repeat(path, more), np.repeat(word, more)
            path[_within((np.cumsum(more) - more)[odd], more[odd])] = list(chain.from_iterable(written))
        return path.astype(np.int32), np.bincount(word, minlength=len(words))

    def _written(self, arc: int) -> list[int]:
        return [self.bytes[b] for b in self._text(arc).encode("utf-8", "replace")] if self.bytes else [self.unknown]

    # Texts

    def _words(self, text: str) -> list[str]:
        """Keys of the words of a text: a word at a single space, else a mark and the normalised word, or a mark and a user piece."""
        if self.simple and text[0] != " " and "  " not in text and _GAP not in text:
            return text.split(" ")
        whole = self.normalise(text)
        if self.user is None or self.unigram:
            return self._split(whole)
        words, at = [], 0  # merges stop at user pieces
        for match in self.user.finditer(whole):
            words += [*self._split(whole[at:match.start()]), _USER_MARK + match[0]]
            at = match.end()
        return words + self._split(whole[at:])

    def _split(self, whole: str) -> list[str]:
        if not whole:
            return []
        return [_GAP + w for w in (re.findall(f"{_GAP}*[^{_GAP}]+|{_GAP}+", whole) if self.gaps_part else [whole])]

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of texts, one after the other, without begin and end, and their number by text.

        Words that are not remembered are transduced together.
        """
        self.compile()
        split = [self._words(t) if t else [] for t in texts]
        young, old = self.young, self.old
        new = set(filterfalse(young.numbers.__contains__, chain.from_iterable(split)))
        again = [w for w in new if w in old.numbers]
        if again:
            young.add(again, *old.ids_of(again))
            new.difference_update(again)
        user = [w for w in new if self.user is not None and w.startswith(_USER_MARK)]
        if user:
            young.add(user, np.array([self.user_ids[w[1:]] for w in user], dtype=np.int32), np.ones(len(user), dtype=np.int64))
            new.difference_update(user)
        if new:
            asked = list(new)
            young.add(asked, *self.transduce([w[1:] if w[0:1] == _GAP else _GAP + w for w in asked]))
        words = np.fromiter(map(len, split), np.int64, len(split))
        ids, sizes = young.ids_of(chain.from_iterable(split), int(words.sum()))
        text = np.repeat(np.repeat(np.arange(len(texts)), words), sizes)
        if len(young.numbers) > REMEMBERED_WORDS:
            self.young, self.old = Remembered(), young
        elif any(len(w) > REMEMBERED_LENGTH for w in new):  # rare and large
            self.young = young.without([w for w in new if len(w) > REMEMBERED_LENGTH])
        if not self.bytes:  # neighbouring unknown characters are one unknown piece
            alone = np.ones(len(ids), dtype=bool)
            alone[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown) | (text[1:] != text[:-1])
            ids, text = ids[alone], text[alone]
        return ids, np.bincount(text, minlength=len(texts))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0].tolist()

    # The inverse

    def decode(self, ids: list[int]) -> str:
        """Text of piece ids: the inverse transduction.

        Bytes that are no UTF-8 become U+FFFD; an id that the model has not, or null, counts as the unknown piece.
        """
        self.compile()
        size = len(self.plain)
        try:
            odd = bool(ids) and (min(ids) < 0 or max(ids) >= size)
        except TypeError:  # nulls among them
            odd = True
        if odd:
            ids = [i if i is not None and 0 <= i < size else self.unknown for i in ids]
        found = list(map(self.plain.__getitem__, ids))
        if None in found:
            at = 0
            while at < len(found):
                if found[at] is not None:
                    at += 1
                    continue
                end = at
                while end < len(found) and found[end] is None:
                    end += 1
                raw = bytes(self.byte_of[i] for i in ids[at:end])
                found[at:end] = [raw.decode("utf-8", "replace")] + [""] * (end - at - 1)
                at = end
        if found and self.prefix and self.texts[ids[0]].startswith(_GAP):
            found[0] = found[0][1:]
        return "".join(found)


def compiled(path: str) -> PieceTransducer:
    """The transducer of a model file; a process compiles it once and keeps the last two that it used."""
    import os
    import sentencepiece  # a module of the process itself, so that what hangs on it outlives a task

    held = sentencepiece.__dict__.setdefault("_fixtrace_models", {})
    state = os.stat(path)
    key = (path, state.st_size, state.st_mtime_ns)
    if key not in held:
        while len(held) >= REMEMBERED_MODELS:
            held.pop(next(iter(held)))
        held[key] = PieceTransducer(path).compile()
    return held[key]


def encode_pieces(docs: DataFrame, model: str, text: str = "text", ids: str = "piece_ids", decoded: str | None = None) -> DataFrame:
    """All columns of ``docs`` and the piece ids of the whole text, an array of ints.

    ``model`` is the path of a SentencePiece model file, which has to be readable on all machines. With ``decoded`` a
    column of that name holds what the ids stand for, decoded in the same task. A null text gives nulls, an empty one an
    empty array and text. Rows are independent, so ties, repeats and an empty table need no rule. Columns already
    named ``ids`` or ``decoded`` are replaced.
    """
    kept = docs.drop(ids, *([decoded] if decoded else []))
    if text not in kept.columns:
        raise ValueError("the text cannot be replaced by its ids")
    place = kept.columns.index(text)

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        at, held, texts = 0, 0, []
        for row, value in enumerate(batch.column(place)):
            texts.append(value.as_py())
            held += len(texts[-1] or "")
            if held > GROUP_CHARACTERS or len(texts) == GROUP_ROWS:
                yield batch.slice(at, row + 1 - at), texts
                at, held, texts = row + 1, 0, []
        if texts:
            yield batch.slice(at), texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = compiled(model)
        for batch in batches:
            for part, texts in groups(batch):
                flat, sizes = coder.encode_many(texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=pa.array([t is None for t in texts]))
                columns, names = [*part.columns, lists], [*part.schema.names, ids]
                if decoded:
                    codes = flat.tolist()
                    columns.append(pa.array([None if t is None else coder.decode(codes[a:b])
                                             for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist())], pa.string()))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]
    return kept.mapInArrow(run, T.StructType(fields + ([T.StructField(decoded, T.StringType())] if decoded else [])))


def decode_pieces(docs: DataFrame, model: str, ids: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and the text that piece ids stand for; null for null. ``name`` is replaced.

    An id that the model has not, or a null among the ids, counts as the unknown piece.
    """
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = compiled(model)
        for rows in batches:
            yield pd.Series([None if r is None else coder.decode([None if i is None or i != i else int(i) for i in r]) for r in rows], dtype=object)

    return docs.withColumn(name, decode(F.col(ids)))
