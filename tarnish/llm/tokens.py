"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from tarnish.llm.texts import BYTE_CODES, span_hashes

#: Words whose ids a Python worker remembers between slices, and how many it asks for at a time.
REMEMBERED = 1_000_000
ASKED = 20_000
#: Bytes of texts whose words are looked up together, and what sets words at the start of a text apart.
SLICE, FIRST = 1 << 20, np.uint64(0x5851F42D4C957F2D)
#: Marks after a letter: the vocabulary's pattern keeps letters and marks apart.
MARKS = ".,;:!?*#$%&|<>()"
#: How byte-level vocabularies write bytes: printable ones as themselves, the others as the letters from 256 on.
LETTERS = dict.fromkeys([*range(33), *range(127, 161), 173])
LETTERS = {byte: chr(256 + n) for n, byte in enumerate(LETTERS)}
SPACE_MARK = LETTERS[32]
#: Stands between pieces; no byte is written like this.
SPLIT = " "


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class WordTable:
    """Hashes of words and their ids, in arrays: some 40 bytes a word. A size of -1 marks a word beside which a cut is not safe."""

    def __init__(self) -> None:
        self.hashes, self.places = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.fresh, self.fresh_places = self.hashes, self.places
        self.starts, self.sizes = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int32)
        self.ids = np.zeros(4096, dtype="<u4")
        self.n = self.n_ids = 0

    @staticmethod
    def _found(hashes: np.ndarray, places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return np.where(hashes[at] == wanted, places[at], -1)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where there is none."""
        found = self._found(self.hashes, self.places, wanted)
        missing = np.flatnonzero(found < 0)
        found[missing] = self._found(self.fresh, self.fresh_places, wanted[missing])
        return found

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, len(array) * 3 // 2) - len(array), dtype=array.dtype)])

    def add(self, hashes: np.ndarray, ids: list[bytes | None]) -> np.ndarray:
        """Places of new words, of which None is not safe."""
        sizes = np.array([-1 if x is None else len(x) // 4 for x in ids], dtype=np.int32)
        raw = np.frombuffer(b"".join([x for x in ids if x is not None]), dtype="<u4")
        n, n_ids = self.n + len(ids), self.n_ids + len(raw)
        self.starts, self.sizes, self.ids = self._room(self.starts, n), self._room(self.sizes, n), self._room(self.ids, n_ids)
        places = np.arange(self.n, n)
        ends = np.cumsum(np.maximum(sizes, 0))
        self.starts[places], self.sizes[places] = self.n_ids + ends - np.maximum(sizes, 0), sizes
        self.ids[self.n_ids : n_ids] = raw
        self.n, self.n_ids = n, n_ids
        # new words are merged with the others when they are many, as that moves all of them
        self.fresh, self.fresh_places = self._merged(self.fresh, self.fresh_places, hashes, places)
        if len(self.fresh) > 20_000 + len(self.hashes) // 4:
            self.hashes, self.places = self._merged(self.hashes, self.places, self.fresh, self.fresh_places)
            self.fresh, self.fresh_places = self.hashes[:0], self.places[:0]
        return places

    @staticmethod
    def _merged(hashes: np.ndarray, places: np.ndarray, more: np.ndarray, more_places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([hashes, more])
        order = np.argsort(both, kind="stable")
        return both[order], np.concatenate([places, more_places])[order]

    def bytes_at(self, place: int) -> bytes | None:
        size = self.sizes[place]
        return None if size < 0 else self.ids[self.starts[place] : self.starts[place] + size].tobytes()

    def gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places, one after the other, and where each word's end."""
        sizes = np.maximum(self.sizes[places], 0).astype(np.int64)
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[places] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


def _bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what single spaces part."""
    spaces = np.flatnonzero(data == 32)
    return np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])


class Encoder:
    """Texts to their ids as little-endian unsigned 32-bit integers.

    A byte-level vocabulary whose pattern starts a piece at each single space between two other
    characters gives a word, with the space before it, the same ids everywhere. So the library
    is asked once for each word, less the marks at its end, many in one text; only the first id of
    such a word stands for a string that starts with the space, which tells where its ids begin. Words are
    known by 64-bit hashes, and the ids of a slice of texts are gathered from one array. Texts with
    other spacing, or with a special token's string, are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith(SPACE_MARK)]] = True
        self.table = WordTable()
        self.marks: dict[str, bytes] = {}
        #: the same merges for pieces that are already split and written byte by byte
        self.merger = Tokenizer.from_file(path)
        self.merger.pre_tokenizer = pre_tokenizers.Split(SPLIT, "removed")

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def whole(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def _learned(self, words: list[str]) -> list[bytes | None]:
        """The ids of new words, each with a space before it: the library is asked for what is left of them without marks at the end."""
        found: dict[str, bytes] = {}
        plain, rest, stems = [], [], {}
        for w in words:
            if w.isalpha():
                plain.append(w)
            elif (stem := w.rstrip(MARKS)).isalpha():
                stems[w] = stem
            elif w and not w[0].isspace() and not w[-1].isspace():
                rest.append(w)
        others = list(set(stems.values()).difference(plain))
        if others:
            hashes = self._hashes(others)
            places = self.table.find(hashes)
            known = places >= 0
            found.update((w, self.table.bytes_at(p)) for w, p in zip(others, places) if p >= 0)
            fresh = [w for w, k in zip(others, known) if not k]
        else:
            hashes, known, fresh = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool), []
        # letters alone are one piece, which needs no splitting, only the merges
        asked = plain + fresh
        self._ask(self.merger, SPLIT, [SPACE_MARK + (w if w.isascii() else w.encode().decode("latin-1").translate(LETTERS)) for w in asked], asked, found)
        self._ask(self.tokenizer, "", [" " + w for w in rest], rest, found)
        if fresh:
            self.table.add(hashes[~known], [found[w] for w in fresh])
        for w, stem in stems.items():
            marks = w[len(stem) :]
            if marks not in self.marks:
                self.marks[marks] = self.whole(marks)
            found[w] = found[stem] + self.marks[marks]
        return list(map(found.get, words))

    def _ask(self, tokenizer: Tokenizer, between: str, texts: list[str], words: list[str], found: dict[str, bytes]) -> None:
        for lo in range(0, len(texts), ASKED):
            part = texts[lo : lo + ASKED]
            # the fast form leaves offsets out
            ids = np.array(tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = [*(4 * np.flatnonzero(self.starts[ids])).tolist(), 4 * len(ids)]
            if len(cuts) != len(part) + 1:
                raise ValueError("the vocabulary does not start a piece at each space")
            raw = ids.tobytes()
            found.update(zip(words[lo : lo + ASKED], [raw[a:b] for a, b in zip(cuts, cuts[1:])]))

    def _hashes(self, words: list[str]) -> np.ndarray:
        data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
        return span_hashes(BYTE_CODES[data], *_bounds(data))

    def _places(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The place of each word of texts that are joined by spaces; ``first`` are those that no space stands before."""
        starts, ends = _bounds(data)
        hashes = span_hashes(BYTE_CODES[data], starts, ends)
        hashes[first] ^= FIRST
        different, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        places = self.table.find(different)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(starts[at[missing]].tolist(), ends[at[missing]].tolist())]
            leads = np.isin(at[missing], first)
            inner = np.flatnonzero(~leads)
            ids: list[bytes | None] = [None] * len(words)
            for i, found in zip(inner.tolist(), self._learned([words[i] for i in inner])):
                ids[i] = found
            for i in np.flatnonzero(leads).tolist():
                ids[i] = self.whole(words[i])
            # a stem may have been learnt with the words
            again = self.table.find(different[missing])
            new = again < 0
            again[new] = self.table.add(different[missing][new], [x for x, n in zip(ids, new) if n])
            places[missing] = again
        return places[which]

    def encode(self, texts: list[str]) -> list[bytes]:
        done: list[bytes] = [b""] * len(texts)
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            if any(s in text for s in self.special) or text.split(" ", 1)[0][-1:].isspace():
                done[i] = self.whole(text)
                continue
            held.append((i, text.encode()))
            size += len(held[-1][1])
            if size >= SLICE:
                self._encode(texts, held, done)
                held, size = [], 0
        if held:
            self._encode(texts, held, done)
        return done

    def _encode(self, texts: list[str], held: list[tuple[int, bytes]], done: list[bytes]) -> None:
        if self.table.n > REMEMBERED:
            self.table, self.marks = WordTable(), {}
        counts = np.array([raw.count(b" ") + 1 for _, raw in held])
        first = np.cumsum(counts) - counts
        places = self._places(np.frombuffer(b" ".join([raw for _, raw in held]), dtype=np.uint8), first)
        ids, ends = self.table.gathered(places)
        safe = np.minimum.reduceat(self.table.sizes[places], first) >= 0
        stops = ends[first + counts - 1].tolist()
        for (i, _), lo, hi, good in zip(held, [0, *stops], stops, safe.tolist()):
            done[i] = ids[lo:hi].tobytes() if good else self.whole(texts[i])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    return Encoder(path)
