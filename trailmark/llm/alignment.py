"""Alignment of two tokenizers on the bytes of each text.

A text is encoded by a byte-level BPE (A) and by a sentence-piece BPE (B). The cumulative
byte ends of both token lists are merged; where both have an end, a group ends. Tokens of
one group are linked, and a link's count is the number of documents in the whole corpus
that hold its pair of ids linked.

Both tokenizers always begin a token at a single space between two other characters, so a
text is cut there into units that are encoded and merged on their own. Units that occur more
than once in a batch are remembered by the worker, within a budget of bytes.

Links leave a document as different pairs with the times each occurs; copies of a pair are
never spelt out. Spark counts the documents of each pair by groupBy. The pairs with the
highest counts, a bounded number, are broadcast to the links; the others, which no document
count makes hot, are joined by shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bytes of text worked on at a time, and bytes of units that a worker remembers, about.
SLICE, STORE = 2 << 20, 48 << 20
#: Bytes that a remembered unit takes besides its text, per unit and per token; longer units
#: than this aren't remembered.
UNIT_BYTES, TOKEN_BYTES, LONGEST = 400, 40, 512
#: So many new units are encoded as one text.
JOIN = 64
#: Pairs that are broadcast at most, those with the highest counts.
HEAD = 200_000
#: Links of a group up to which they are made one by one; larger groups count their ids.
WIDE = 256


def default_paths() -> tuple[str, str]:
    """The byte-level and the sentence-piece vocabulary of the machine's public files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_characters() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte: itself
    where it is a printable Latin-1 character, and otherwise the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending lists of ends: the places (i, j) where both have the same end. Two
    pointers run over the lists: for each end of a, the one into b stands at the first end
    that isn't before it."""
    at = np.searchsorted(b, a)
    i = np.flatnonzero((at < len(b)) & (b[np.minimum(at, len(b) - 1)] == a)) if len(b) else at[:0]
    return i, at[i]


class Units:
    """What units are aligned to, one row each: whether they count, their groups as written,
    numbers of A tokens, B tokens, groups and links, and their pairs and times in one array."""

    def __init__(self):
        self.good, self.text = np.zeros(0, bool), []
        self.counts, self.ends = np.zeros((0, 4), np.int64), np.zeros(1, np.int64)
        self.pairs = self.times = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.text)

    def add(self, other: Units) -> None:
        self.good, self.counts = np.concatenate([self.good, other.good]), np.concatenate([self.counts, other.counts])
        self.pairs, self.times = np.concatenate([self.pairs, other.pairs]), np.concatenate([self.times, other.times])
        self.ends = np.concatenate([self.ends, self.ends[-1] + other.ends[1:]])
        self.text += other.text

    def take(self, rows: np.ndarray) -> Units:
        out = Units()
        out.good, out.counts, out.text = self.good[rows], self.counts[rows], [self.text[i] for i in rows.tolist()]
        at, size = self.at(rows)
        out.pairs, out.times, out.ends = self.pairs[at], self.times[at], np.append(0, np.cumsum(size))
        return out

    def at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs of rows are, and how many each row has."""
        size = self.ends[rows + 1] - self.ends[rows]
        first = np.append(0, np.cumsum(size))
        return np.repeat(self.ends[rows] - first[:-1], size) + np.arange(first[-1]), size


class Aligner:
    """Groups and links of texts for two vocabulary files."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte, vocabulary = _byte_characters(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        #: Whether no piece goes on after a word's end, so that texts may be cut there.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.written_a, self.written_b = (list(map(str, range(len(x)))) for x in (self.bytes_a, self.bytes_b))
        self.reset()

    def reset(self) -> None:
        """Forgets every unit."""
        self.slot: dict[str, int] = {}
        self.held, self.units_held = 0, Units()

    # ---- units

    def units(self, text: str) -> list[str]:
        """Parts of " " + text, each without its first space."""
        parts = text.split(" ")
        if not self.cuts:
            return [text]
        out = [parts[0]]
        for before, p in zip(parts, parts[1:]):
            if before and p and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)

    def encode(self, keys: list[str]) -> Units:
        """The alignment of different units. Units without spaces are encoded joined; where
        one ends follows from the tokens' bytes."""
        ids_a, ids_b, lengths, order, bad = [], [], [], [], []
        simple = np.array([bool(k) and len(k) <= LONGEST and " " not in k and not k[0].isspace() for k in keys], bool) & self.cuts
        plain, single = np.flatnonzero(simple).tolist(), np.flatnonzero(~simple).tolist()
        joined = [plain[i : i + JOIN] for i in range(0, len(plain), JOIN)]
        for of in (joined, None):  # None: those that go alone, also for one of theirs that isn't good
            of = [[i] for i in single] if of is None else of
            texts = [" ".join([keys[i] for i in own]) for own in of]
            for own, text, a, b in zip(of, texts, *self._ids(texts)):
                whole = (" " + text).encode()
                if text and self._spelt(a, b) == (whole, whole):
                    ids_a += a
                    ids_b += b
                    order += own
                    lengths += [len(keys[i].encode()) + 1 for i in own] if len(own) > 1 else [len(whole)]
                elif len(own) > 1:
                    single += own
                else:
                    bad += own
        out = self._align(np.array(ids_a, np.int64), np.array(ids_b, np.int64), np.cumsum(lengths, dtype=np.int64))
        empty = Units()
        empty.good, empty.counts, empty.text, empty.ends = np.zeros(len(bad), bool), np.zeros((len(bad), 4), np.int64), [""] * len(bad), np.zeros(len(bad) + 1, np.int64)
        out.add(empty)
        back = np.empty(len(keys), np.int64)
        back[order + bad] = np.arange(len(keys))
        return out.take(back)

    def _spelt(self, ids_a: list[int], ids_b: list[int]) -> tuple[bytes, bytes]:
        return b"".join(map(self.bytes_a.__getitem__, ids_a)), b"".join(map(self.bytes_b.__getitem__, ids_b))

    def _align(self, a: np.ndarray, b: np.ndarray, unit_ends: np.ndarray) -> Units:
        """The alignment of units whose tokens follow each other; unit_ends are the units'
        last bytes."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        i, j = merge_ends(ends_a, ends_b)
        last_a, last_b = i + 1, j + 1
        first_a, first_b = np.append(0, last_a[:-1])[: len(i)], np.append(0, last_b[:-1])[: len(i)]
        size_a, size_b = last_a - first_a, last_b - first_b
        text_a, text_b = [self.written_a[t] for t in a.tolist()], [self.written_b[t] for t in b.tolist()]
        spans = zip(first_a.tolist(), last_a.tolist(), first_b.tolist(), last_b.tolist())
        written = [f"{text_a[i]}|{text_b[k]}" if j - i == m - k == 1 else ",".join(text_a[i:j]) + "|" + ",".join(text_b[k:m]) for i, j, k, m in spans]
        pairs, times, ends = _links(a, b, first_a, first_b, size_a, size_b)
        bounds = np.append(0, np.searchsorted(ends_a[i], unit_ends) + 1)
        totals = [np.append(0, np.cumsum(x))[bounds] for x in (size_a, size_b, np.ones(len(i), np.int64), size_a * size_b)]
        out = Units()
        out.good, out.counts = np.ones(len(unit_ends), bool), np.diff(np.stack(totals, 1), axis=0)
        out.text = [";".join(written[g:e]) for g, e in zip(bounds.tolist(), bounds[1:].tolist())]
        out.pairs, out.times, out.ends = pairs, times, ends[bounds]
        return out

    # ---- texts

    def _slots(self, keys: list[str], often: np.ndarray) -> tuple[np.ndarray, Units]:
        """Rows of different units in a table of all that are remembered and the new ones.
        New units that came often are remembered while there is room."""
        slots = np.fromiter(map(self.slot.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(slots < 0)
        new = [keys[i] for i in missing.tolist()]
        found = self.encode(new)
        letters = np.fromiter(map(len, new), np.int64, len(new))
        size = np.where(often[missing] & (letters <= LONGEST), letters + UNIT_BYTES + TOKEN_BYTES * np.diff(found.ends), 0)
        stay = (size > 0) & (self.held + np.cumsum(size) <= STORE)
        order = np.argsort(~stay, kind="stable")
        slots[missing[order]] = len(self.units_held) + np.arange(len(new))
        self.held += int(size[stay].sum())
        self.slot.update((new[i], int(slots[missing[i]])) for i in np.flatnonzero(stay).tolist())
        self.units_held.add(found.take(order[: int(stay.sum())]))
        table = Units()
        table.add(self.units_held)
        table.add(found.take(order[int(stay.sum()) :]))
        return slots, table

    def align(self, texts: list[str]) -> dict[str, list]:
        """For each text: counts, groups_sha256, and its different links (a, b, times)."""
        array = pa.array(texts, pa.string())
        lists = pc.split_pattern(array, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        loose = np.array([not w or w[0].isspace() for w in words], bool) if self.cuts else np.ones(len(words), bool)
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(bounds, np.flatnonzero(loose[code]), side="right") - 1] = True
        own = {int(i): self.units(texts[i]) for i in np.flatnonzero(odd)}
        even = ~odd[np.repeat(np.arange(len(texts)), np.diff(bounds))]
        times = np.bincount(code[even], minlength=len(words))
        keys = {w: i for i, w in enumerate(words) if times[i]}
        often = {w: times[i] > 1 for w, i in keys.items()}
        for parts in own.values():
            for u in parts:
                often[u] = u in often
        slots, table = self._slots(list(often), np.fromiter(often.values(), bool, len(often)))
        place = dict(zip(often, slots.tolist()))
        by_word = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
        each = [np.fromiter((place[u] for u in own[i]), np.int64, len(own[i])) if i in own else by_word[code[bounds[i] : bounds[i + 1]]] for i in range(len(texts))]
        out: dict[str, list] = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times")}
        for text, rows in zip(texts, each):
            if not text or not table.good[rows].all():
                sums, digest, pairs, many = (0, 0, 0, 0), "", table.pairs[:0], table.times[:0]
            else:
                sums = table.counts[rows].sum(0).tolist()
                digest = hashlib.sha256(";".join(map(table.text.__getitem__, rows.tolist())).encode()).hexdigest()
                at, _ = table.at(rows)
                pairs, many = _together(table.pairs[at], table.times[at])
            for k, v in zip(("n_a", "n_b", "n_groups", "n_links"), sums):
                out[k].append(v)
            out["groups_sha256"].append(digest)
            out["a"].append((pairs >> 32).astype(np.int32))
            out["b"].append((pairs & 0xFFFFFFFF).astype(np.int32))
            out["times"].append(many)
        return out


def _links(a, b, first_a, first_b, size_a, size_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of all groups as a << 32 | b, how often each is meant, and where each
    group's begin (one end more)."""
    wide = np.flatnonzero(size_a * size_b > WIDE)
    if len(wide):
        a, b = a.copy(), b.copy()
        weight_a, weight_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
        size_a, size_b = size_a.copy(), size_b.copy()
        for g in wide.tolist():  # its different ids, moved to its front
            for x, weight, first, size in ((a, weight_a, first_a, size_a), (b, weight_b, first_b, size_b)):
                ids, n = np.unique(x[first[g] : first[g] + size[g]], return_counts=True)
                x[first[g] : first[g] + len(ids)], weight[first[g] : first[g] + len(ids)], size[g] = ids, n, len(ids)
    many = size_a * size_b
    ends = np.append(0, np.cumsum(many))
    of = np.repeat(np.arange(len(many)), many)
    t = np.arange(ends[-1]) - ends[of]
    i, j = first_a[of] + t // size_b[of], first_b[of] + t % size_b[of]
    times = weight_a[i] * weight_b[j] if len(wide) else np.ones(len(of), np.int64)
    return a[i] << 32 | b[j], times, ends


def _together(codes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, ascending, and their times added up."""
    if len(codes) < 2:
        return codes, many
    if many.max() == 1:
        return np.unique(codes, return_counts=True)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.add.reduceat(many[order], first)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner, kept between tasks."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


_LINKED = "id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<long>"


def groups(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups_sha256, and its different
    links as arrays a, b and times."""

    def run(frames):
        own = aligner(path_a, path_b)
        held, size = [], 0

        def done():
            frame = pd.concat(held) if len(held) > 1 else held[0]
            found = own.align(frame["text"].tolist())
            return pd.DataFrame({"id": frame["id"].to_numpy(), **{k: pd.Series(v, dtype=object) if k in ("a", "b", "times") else v for k, v in found.items()}})

        for frame in frames:
            # a batch of long texts is worked off in pieces
            ends = np.cumsum(frame["text"].str.len().to_numpy(np.int64))
            start = 0
            while start < len(frame):
                room = (ends[start - 1] if start else 0) + SLICE - size
                end = min(len(frame), max(start + 1, int(np.searchsorted(ends, room, side="right"))))
                held.append(frame.iloc[start:end])
                size += int(ends[end - 1] - (ends[start - 1] if start else 0))
                start = end
                if size >= SLICE or start < len(frame):
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.mapInPandas(run, _LINKED.format(texts.schema["id"].dataType.simpleString()))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count, best_a, best_b of links (pair), one row for each document that holds it:
    documents with the pair, and whether that is the most of its A id, of its B id."""
    counts = links.groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = counts.withColumn("a", F.shiftright("pair", 32)).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    for side in "ab":
        most = counts.groupBy(side).agg(F.max("count").alias(f"most_{side}"))
        counts = counts.join(most, side)
    return counts.select("pair", "count", (F.col("count") == F.col("most_a")).alias("best_a"), (F.col("count") == F.col("most_b")).alias("best_b"))


def align(df: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per document: its id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum,
    groups_sha256.

    Null and empty texts, and those that a tokenizer doesn't give back byte for byte behind one
    space (U+2581 is a space to B), have no tokens: zeros and the empty string. An empty table
    gives no row; repeated rows count each as a document; ids may be null or repeated. A text
    is worked off whole, with about 100 bytes of memory for each of its own; a group of many
    tokens counts its different ids, so its links are never spelt out one by one. Other columns
    are not read, whatever their names.
    """
    own = default_paths()
    linked = groups(df, path_a or own[0], path_b or own[1], id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    linked = stored(linked, "linked")
    flat = linked.select("row", F.inline(F.arrays_zip("a", "b", "times")))
    flat = flat.select("row", F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair"), "times")
    counts = stored(pair_counts(flat.select("pair")), "pairs")
    columns = ["row", "times", "count", "best_a", "best_b"]
    if counts.count() <= head:
        known = flat.join(F.broadcast(counts), "pair").select(*columns)
    else:
        # the hot pairs are among the broadcast ones; the others' links meet by shuffle
        top = stored(counts.orderBy(F.col("count").desc(), "pair").limit(head), "head")
        both = flat.join(F.broadcast(top), "pair", "left")
        tail = flat.join(F.broadcast(top.select("pair")), "pair", "left_anti").join(counts, "pair")
        known = both.where("count is not null").select(*columns).union(tail.select(*columns))
    sums = known.groupBy("row").agg(
        F.sum(F.when(F.col("best_a"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.when(F.col("best_b"), F.col("times")).otherwise(0)).alias("n_best_b"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = linked.drop("a", "b", "times").join(sums, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("n_best_b"), zero("count_sum"), "groups_sha256")
