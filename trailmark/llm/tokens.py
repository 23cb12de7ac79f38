"""Token ids of whole texts by the tokenizers library.

A text is cut before every space that a non-space follows: a byte-level pre-tokenizer
always begins a piece there, so the cut-off units can be encoded on their own and the
ids simply joined. Each different unit is encoded once per batch or taken from a bounded
store that lasts as long as the Python worker.
The vocabulary must be byte-level BPE, one character of a token for each byte. The library
takes a vocabulary's added tokens (``<|endoftext|>``) out of a text before it cuts the rest,
so the few texts that hold such a string are encoded whole.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units and ids (four bytes each) that a worker remembers; further ones are encoded batch
#: by batch.
STORE_UNITS, STORE_IDS = 400_000, 4 << 20
#: Bytes of a unit at most: texts with a longer one, as scripts without spaces have, are
#: encoded whole and none of their units is remembered.
LONGEST = 2048
#: So many new units are encoded as one text.
JOIN = 64


def default_path() -> str:
    """The byte-level vocabulary of the machine's public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def units(text: str) -> list[str]:
    """Parts of text that encode independently; joined they are the text."""
    parts = text.split(" ")
    out = parts[:1] if parts[0] else []
    for p in parts[1:]:
        if not out or p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


def _joins(unit: str) -> bool:
    return unit[0] == " " and len(unit) > 1 and not unit[1].isspace()


def _begins_loose(array: pa.Array, words: list[str]) -> np.ndarray:
    """Which words are empty or begin with white space; only words whose first byte
    leaves it open are looked at one by one."""
    ends = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, 4 * array.offset)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    loose = ends[1:] == ends[:-1]
    full = np.flatnonzero(~loose)
    first = data[ends[:-1][full]]
    for i in full[(first <= 32) | (first >= 128)]:
        loose[i] = words[i][0].isspace()
    return loose


class Encoder:
    """Ids of texts for one vocabulary file, as the library's ``encode(text,
    add_special_tokens=False)`` gives them: no tokens are put in, and the strings of added
    tokens in a text are those tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)  # one character stands for each byte
        # units by their text: what follows a space without it, anything else after "\x20"
        self.slot: dict[str, int] = {" ": 0}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)  # unit k's ids end at ends[k + 1]

    def _store(self, keys: list[str]) -> np.ndarray:
        """Encodes new units, those that begin with a space joined: where one ends follows
        from the ids' byte lengths, and a joined text costs less than as many short ones."""
        after = [i for i, k in enumerate(keys) if k[0] != " "]
        alone = [i for i, k in enumerate(keys) if k[0] == " "]
        texts = [" " + " ".join([keys[j] for j in after[i : i + JOIN]]) for i in range(0, len(after), JOIN)] + [keys[i][1:] for i in alone]
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        k, first = len(self.slot), int(self.ends[len(self.slot)])
        total = sum(map(len, lists))
        while first + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(keys) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, total)
        self.ids[first : first + total] = ids
        order = after + alone
        lengths = pc.binary_length(pa.array(keys)).to_numpy()[order] + np.repeat([1, -1], [len(after), len(alone)])
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(lengths)) + 1
        self.ends[k + 1 : k + 1 + len(keys)] = first + ends
        slots = np.empty(len(keys), np.int64)
        slots[order] = np.arange(k, k + len(keys))
        self.slot.update(zip(keys, slots.tolist()))
        return slots

    def _slots(self, keys: list[str]) -> tuple[np.ndarray, list[str]]:
        """The slots of different keys, and those keys that are new."""
        slots = np.fromiter(map(self.slot.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(slots < 0)
        new = [keys[i] for i in missing]
        if new:
            slots[missing] = self._store(new)
        return slots, new

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of strings (null: none) one after another, and where
        each text's begin (one end more)."""
        texts = pc.fill_null(texts, "")
        marked = np.zeros(len(texts), bool)
        for token in self.added:
            marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return self._apart(texts, marked) if marked.any() else self._encode(texts)

    def _apart(self, texts: pa.Array, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where marked texts are encoded whole."""
        ids, ends = self._encode(pc.if_else(pa.array(marked), "", texts))
        parts = np.split(ids, ends[1:-1])
        whole = self.tokenizer.encode_batch_fast(texts.filter(pa.array(marked)).to_pylist(), add_special_tokens=False)
        for i, e in zip(np.flatnonzero(marked), whole):
            parts[i] = np.array(e.ids, np.uint32)
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts that hold no added token."""
        held = len(self.slot)
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        long = np.flatnonzero(pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > LONGEST)
        if len(long):
            marked = np.zeros(len(texts), bool)
            marked[np.searchsorted(bounds, np.flatnonzero(np.isin(code, long)), side="right") - 1] = True
            return self._apart(texts, marked)
        words = coded.dictionary.to_pylist()
        # a part that is empty or begins with white space belongs to the unit before it
        loose = _begins_loose(coded.dictionary, words)
        first = np.zeros(len(code), bool)
        first[bounds[:-1]] = True
        odd = np.zeros(len(texts), bool)
        if loose.any():
            odd[np.searchsorted(bounds, np.flatnonzero(loose[code] & ~first), side="right") - 1] = True
        # a text's first word is a unit of its own; elsewhere it may not occur
        keep = np.zeros(len(words), bool)
        keep[code[~first]] = True
        keep &= ~loose
        at, new = np.zeros(len(words), np.int64), []
        at[keep], new = self._slots([w for w, k in zip(words, keep) if k])
        at = at[code]
        heads, where = np.unique(code[bounds[:-1]], return_inverse=True)
        heads, more = self._slots([" " + words[c] for c in heads])
        at[bounds[:-1]] = heads[where]
        new += more
        if odd.any():
            parts, sizes = [], []
            for i in np.flatnonzero(odd):
                own = units(texts[int(i)].as_py())
                parts.append([u[1:] if _joins(u) else " " + u for u in own])
                sizes.append(len(own))
            different = dict.fromkeys(u for p in parts for u in p)
            slots, more = self._slots(list(different))
            new += more
            different = dict(zip(different, slots.tolist()))
            slots = np.array([different[u] for p in parts for u in p], np.int64)
            count = np.diff(bounds)
            pieces = np.split(at, bounds[1:-1])
            for i, own in zip(np.flatnonzero(odd), np.split(slots, np.cumsum(sizes)[:-1])):
                pieces[i], count[i] = own, len(own)
            at, bounds = np.concatenate(pieces), np.concatenate([[0], np.cumsum(count)])
        size = self.ends[at + 1] - self.ends[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.ends[at] - ends[:-1], size) + np.arange(ends[-1])]
        if held > STORE_UNITS or self.ends[held] > STORE_IDS:  # full: this batch's new units are forgotten again
            for w in new:
                del self.slot[w]
        return ids, ends[bounds]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
