"""Personal data: base patterns, and a linear-chain CRF over word shapes.

The CRF labels words as O or one of the kinds. It is trained on a small labelled table
by gradient ascent on the exact likelihood (forward-backward) and decoded by Viterbi in
numpy batches. Its sequences are the words within REACH words of one that holds a digit,
an at sign or a spelled-out or lone at or dot. No other word can be part of what is added: a
span must hold a digit, or an at between a user and a host, of which the user lies within two
words of the at and each part of the host within two words of an at or a dot.
What it finds beside the base spans (local phone numbers, spelled-out or bracketed
addresses of mail and of hosts, cards with other separators) is added if it passes the
kind's own test: the same as for base spans, after spelled-out signs are put back.
"""

from __future__ import annotations

import functools
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, each_slice
from .spans import digest, overlaps, render

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
REACH = 3
#: The labelled table may have at most so many words; it is collected for training.
MAX_TRAINING_WORDS = 200_000
#: Phrases in the invented table.
PHRASES = 800

#: What follows an at sign; a run of digits is tried once, not from each of its digits.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({][\x20\x09-\x0D]*(?:(?i:at|dot)|\.)[\x20\x09-\x0D]*[\])}]|(?<![^\x20\x09-\x0D])[\[({]?(?:(?i:at|dot)|\.)[\])}]?(?![^\x20\x09-\x0D])")
_AT = re.compile(r"[\x20\x09-\x0D]*[\[({][\x20\x09-\x0D]*(?:at|@)[\x20\x09-\x0D]*[\])}][\x20\x09-\x0D]*|[\x20\x09-\x0D]+at[\x20\x09-\x0D]+", re.I)
_DOT = re.compile(r"[\x20\x09-\x0D]*[\[({][\x20\x09-\x0D]*(?:dot|\.)[\x20\x09-\x0D]*[\])}][\x20\x09-\x0D]*|[\x20\x09-\x0D]+dot[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\.[\x20\x09-\x0D]+", re.I)
#: What an added span must be once spelled-out signs are put back.
_ADDED = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+){3}"),
    "card": re.compile(r"[0-9]([\x20._/-]{0,3}[0-9])+"),
    "phone": re.compile(r"[+(]?[0-9][\x20().0-9/-]*[0-9]"),
}
_WORD = re.compile(WORD)
_SPACE = frozenset(" \t\n\x0b\x0c\r")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _good(kind: str, text: str) -> bool:
    if kind == "ip":
        return bool(_ADDED["ip"].fullmatch(text)) and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "card":
        d = _digits(text)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(text)) <= 15
    return True


def _passes(kind: str, text: str) -> bool:
    """Whether text is of the kind once spelled-out signs are put back."""
    plain = _DOT.sub(".", _AT.sub("@", text)) if kind in ("email", "ip") else text
    return bool(_ADDED[kind].fullmatch(plain)) and _good(kind, plain)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind; failing ones are dropped."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append(("email", a, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            found += [(kind, *m.span()) for m in pattern.finditer(text) if _good(kind, m[0])]
    return found


# ---- the CRF


@functools.lru_cache(1 << 16)
def shape(word: str) -> str:
    """Letters as x or X, digits as d, runs of letters cut to one, the rest as it is."""
    if len(word) > 64:
        return "long"
    s = "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return re.sub(r"x+", "x", re.sub(r"X+", "X", s))


#: Words that are features by themselves.
CUES = frozenset(
    "at dot call phone tel telephone mobile cell fax contact reach write mail email e-mail card visa credit pay ip host server address login"
    " order ref reference id no nr number invoice page version build year isbn serial part model sku ticket case article line chapter total".split()
)
#: Cues for numbers of another kind.
OTHER = frozenset("order ref reference id invoice page version build year isbn serial part model sku ticket case article line chapter total".split())


@functools.lru_cache(1 << 16)
def own_features(word: str) -> tuple[str, ...]:
    s, bare = shape(word), word.strip(".,;:!?()[]{}\"'").lower()
    d = sum(c == "d" for c in s)
    core = s.strip(".,;:!?")
    signs = ("a" if _AT.search(f" {word} ") else "") + ("d" if _DOT.search(f" {word} ") else "")
    whole = next((k for k in KINDS if _passes(k, word.strip(".,;:!?"))), "")
    told = (("cue", bare if bare in CUES else ""), ("sign", signs), ("other", "yes" if bare in OTHER else ""), ("whole", whole))
    return (f"s={core}", f"d={min(d, 16)}", f"sep={''.join(sorted(set(core) - set('dxX')))}", f"alpha={'x' in s or 'X' in s}", *(f"{k}={v}" for k, v in told if v))


def features(words: list[str], i: int) -> list[str]:
    """Of the word itself, and what its neighbours say: three cue words and signs on each
    side, two shapes, and pairs of cues around it."""
    out = list(own_features(words[i]))
    told = {}
    for k in (-3, -2, -1, 1, 2, 3):
        j = i + k
        if 0 <= j < len(words):
            f = own_features(words[j])
            told[k] = [x for x in f[4:] if x[0] != "w"]
            out += [f"{k}{x}" for x in told[k]]
            if abs(k) < 3:
                out.append(f"{k}{f[0]}")
        elif abs(k) < 3:
            out.append(f"{k}none")
    out += [f"{a}{x} {b}{y}" for a, b in ((-1, 1), (1, 3)) for x in told.get(a, ()) for y in told.get(b, ())]
    if any(w.strip(".,;:!?#").lower() in OTHER for w in words[max(0, i - 3) : i]):
        out.append("after other")
    return out


@dataclass
class Model:
    index: dict[str, int]
    emit: np.ndarray  # features x labels
    move: np.ndarray  # labels x labels


def train(labelled: list[list[tuple[str, str]]], steps: int = 120, rate: float = 0.15, l2: float = 0.01) -> Model:
    """labelled: sequences of (word, label)."""
    index: dict[str, int] = {}
    seqs = []
    for seq in labelled:
        words = [w for w, _ in seq]
        seqs.append(([[index.setdefault(f, len(index)) for f in features(words, i)] for i in range(len(seq))], [LABELS.index(y) for _, y in seq]))
    n, longest, k = len(seqs), max(len(y) for _, y in seqs), len(LABELS)
    mask, gold = np.zeros((n, longest), bool), np.zeros((n, longest), int)
    rows, cols = [], []
    for s, (fs, y) in enumerate(seqs):
        mask[s, : len(y)], gold[s, : len(y)] = True, y
        for t, f in enumerate(fs):
            rows += [s * longest + t] * len(f)
            cols += f
    rows, cols = np.array(rows), np.array(cols)
    heads = np.flatnonzero(np.diff(rows, prepend=-1))  # every word has features
    w, m = np.zeros((len(index), k)), np.zeros((k, k))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]
    onehot = np.eye(k)[gold] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_move = np.einsum("nti,ntj->ij", onehot[:, :-1] * both[..., None], onehot[:, 1:])
    for step in range(1, steps + 1):
        e = np.zeros((n * longest, k))
        e[rows[heads]] = np.add.reduceat(w[cols], heads)
        node, pair = _marginals(e.reshape(n, longest, k), m, mask)
        miss = (onehot - node).reshape(-1, k)[rows]
        gw = np.stack([np.bincount(cols, miss[:, y], len(index)) for y in range(k)], 1)
        for g, x, a, b in ((gw - l2 * w, w, state[0], state[1]), (gold_move - pair - l2 * m, m, state[2], state[3])):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Model(index, w, m)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _marginals(e, m, mask):
    n, longest, k = e.shape
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for t in range(1, longest):
        alpha[:, t] = np.where(mask[:, t, None], e[:, t] + _lse(alpha[:, t - 1, :, None] + m, 1), alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        beta[:, t] = np.where(mask[:, t + 1, None], _lse(m + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0.0)
    z = _lse(alpha[:, -1], 1)
    node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
    pair = np.zeros((k, k))
    for t in range(1, longest):
        p = np.exp(alpha[:, t - 1, :, None] + m + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
        pair += p[mask[:, t]].sum(0)
    return node, pair


def viterbi(model: Model, sequences: list[list[str]], cache: dict | None = None) -> list[np.ndarray]:
    """Best label indexes of each sequence; sequences of like length share a batch."""
    cache = {} if cache is None else cache
    out: list = [None] * len(sequences)
    k = len(LABELS)
    by_length = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    for first in range(0, len(by_length), 1024):
        part = by_length[first : first + 1024]
        lengths = np.array([len(sequences[i]) for i in part])
        e = np.zeros((len(part), max(lengths, default=0), k))
        for r, i in enumerate(part):
            words = sequences[i]
            for t in range(len(words)):
                near = tuple(words[max(0, t - 3) : t + 4]), min(t, 3)
                row = cache.get(near)
                if row is None:
                    ids = [x for f in features(words, t) if (x := model.index.get(f)) is not None]
                    row = model.emit[ids].sum(0) if ids else np.zeros(k)
                    if len(cache) < 200_000:
                        cache[near] = row
                e[r, t] = row
        score, back = e[:, 0].copy(), np.zeros(e.shape, np.int8)
        finals = np.zeros(len(part), int)
        for t in range(1, e.shape[1]):
            step = score[:, :, None] + model.move
            back[:, t] = step.argmax(1)
            new = step.max(1) + e[:, t]
            score = np.where((t < lengths)[:, None], new, score)
        finals = score.argmax(1)
        for r, i in enumerate(part):
            path = np.empty(lengths[r], np.int8)
            y = finals[r]
            for t in range(lengths[r] - 1, -1, -1):
                path[t] = y
                y = back[r, t, y]
            out[i] = path
    return out


# ---- the labelled table


def labelled_table(seed: int = 11, rows: int = PHRASES) -> list[list[tuple[str, str]]]:
    """A small labelled table of invented phrases, as (word, label) sequences: each kind as
    people write it, and numbers and words that look alike and are none."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    plain = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    filled = lambda form: re.sub(r"\{(\d+)\}", lambda m: digits(int(m[1])), form).split(" ")
    end = lambda: rng.choice(["com", "org", "net", "de", "fr", "es"])

    def name() -> str:
        w = plain()
        return w.capitalize() + rng.choice(["", "", ",", "."]) if rng.random() < 0.3 else w

    def spoken(sign: str) -> str:
        w = rng.choice([sign, sign, sign.upper(), sign.capitalize()])
        return rng.choice(["{}", "{}", "({})", "[{}]"]).format(w)

    def phone() -> list[str]:
        return filled(rng.choice(["{3}-{3}-{4}", "({3}) {3}-{4}", "{3}.{3}.{4}", "0{2} {4} {4}", "({4}) {6}", "1-{3}-{3}-{4}", "0{3}-{7}", "0{3}/{7}", "{3} {3} {4}", "0{2} {2} {2} {2} {2}"]))

    def email() -> list[str]:
        user = plain() + rng.choice(["", "", digits(2), "." + plain()])
        hosts = [plain() for _ in range(rng.choice([1, 1, 2]))] + [end()]
        form = rng.choice([0, 0, 1, 2, 2])
        if form == 0:  # one word: user(at)host(dot)end
            a, d = rng.choice(["(at)", "[at]", "{at}", "(AT)"]), rng.choice([".", "(dot)", "[dot]", "(DOT)"])
            return [user + a + d.join(hosts)]
        if form == 1:  # user at host.end
            return [user, spoken("at"), ".".join(hosts)]
        out = [user, spoken("at"), hosts[0]]
        for h in hosts[1:]:
            out += [spoken("dot"), h]
        return out

    def ip() -> list[str]:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        form = rng.randrange(3)
        if form == 0:
            return [rng.choice(["[.]", "(.)", "(dot)", "[dot]", "[DOT]"]).join(parts)]
        dot = spoken("dot") if form == 1 else "."
        return [parts[0], *(w for p in parts[1:] for w in (dot, p))]

    def card() -> list[str]:
        d = rng.choice("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        groups = [d[i : i + 4] for i in range(0, 16, 4)]
        sep = rng.choice([".", "_", "/", " / ", " - ", " . "])
        return sep.join(groups).split(" ")

    def other() -> list[str]:
        form = rng.randrange(12)
        if form < 5:
            forms = ["{3}-{3}-{4}", "{3}.{3}.{4}", "0{3}-{7}", "{3} {3} {4}", "{4} {3} {4}", "{4}.{4}.{4}.{4}", "{4}_{4}_{4}_{4}", "{2}-{4}-{6}", "{13}", "978-{1}-{2}-{6}-{1}"]
            cue = [rng.choice(sorted(OTHER)) + rng.choice(["", "", ":"])] + rng.choice([[], [], ["no"], ["number"], ["nr."], [name()]])
            return cue + filled(rng.choice(forms))
        if form == 5:  # words around at and dot that are no address
            return rng.choice([[plain(), "at", plain(), "a", "dot", plain()], [plain(), "at", digits(2)], ["the", "dot", plain()], ["at", plain(), "dot"], [plain(), "(at)", plain()]])
        if form == 6:
            return rng.choice([["from", digits(4), "to", digits(4)], ["in", digits(4), digits(3), digits(4), plain()], [digits(3), plain(), digits(3), plain(), digits(4)]])
        return filled(rng.choice(["{1}", "{2}", "{5}", "{9}", "{16}", "{1}.{2}", "{2}:{2}", "20{2}-0{1}-1{1}", "{2}.0{1}.20{2}", "{2}%", "{4}-{4}", "v{1}.{1}.{2}", "{1}.{1}.{1}.", "{3},{3},{3}", "{2}/{2}/20{2}", "{4}$$$"]))

    cues = {
        "phone": ["call", "phone", "tel", "tel:", "fax", "mobile", "reach"],
        "email": ["mail", "contact", "email", "e-mail:", "write"],
        "ip": ["ip", "host", "server", "address"],
        "card": ["card", "visa", "credit", "pay"],
        "O": ["no", "number", "at", "dot", "about"],
    }
    make = {"phone": phone, "email": email, "ip": ip, "card": card, "O": other}
    out = []
    for _ in range(rows):
        seq = [(name(), "O") for _ in range(rng.randint(0, 3))]
        kind = rng.choice(["phone", "phone", "email", "email", "ip", "ip", "card", "O", "O", "O", "O", "O", "O"])
        if rng.random() < 0.4:
            seq.append((rng.choice(cues[kind]), "O"))
        words = make[kind]()
        words[-1] += rng.choice(["", "", ".", ","])
        seq += [(w, kind) for w in words]
        seq += [(name(), "O") for _ in range(rng.randint(0, 3))]
        out.append(seq)
    return out


def labelled_sequences(table: DataFrame, max_words: int = MAX_TRAINING_WORDS) -> list[list[tuple[str, str]]]:
    """Sequences from a table (sequence, position, word, label). It is collected, so a table
    of more than max_words words is refused."""
    rows = table.select("sequence", "position", "word", "label").limit(max_words + 1).collect()
    if len(rows) > max_words:
        raise ValueError(f"more than {max_words} labelled words: give a sample of the sequences")
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence"], r["position"])):
        out.setdefault(r["sequence"], []).append((r["word"], r["label"]))
    return list(out.values())


# ---- texts


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Word spans within REACH words of a trigger, as maximal sequences."""
    out: list[list[tuple[int, int]]] = []
    end = 0
    for m in _TRIGGER.finditer(text):
        if out and m.start() < end:  # inside the last trigger's right-hand words
            a = m.start()
            k = next((i for i in range(len(out[-1]) - 1, -1, -1) if out[-1][i][0] <= a), 0)
            need = REACH - (len(out[-1]) - 1 - k)
        else:
            a = m.start()
            left = []
            while a and text[a - 1] not in _SPACE:
                a -= 1
            b = a
            while b and len(left) < REACH and b > end:
                while b > end and text[b - 1] in _SPACE:
                    b -= 1
                c = b
                while c > end and text[c - 1] not in _SPACE:
                    c -= 1
                if c < b:
                    left.append((c, b))
                b = c
            joined = out and left and b <= end or out and not text[end:a].strip(" \t\n\x0b\x0c\r")
            own = _WORD.match(text, a).span()
            if joined:
                out[-1] += [*left[::-1], own]
            else:
                out.append([*left[::-1], own])
            end, need = own[1], REACH
        while need > 0 and (w := _WORD.search(text, end)):
            out[-1].append(w.span())
            end, need = w.end(), need - 1
    return out


_OUT = pa.schema([("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def added_spans(text: str, spots: list[list[tuple[int, int]]], labels: list[np.ndarray], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The CRF's spans that pass their kind's test and touch no base span."""
    out = []
    for words, path in zip(spots, labels):
        i = 0
        while i < len(words):
            j = i
            while j < len(words) and path[j] == path[i]:
                j += 1
            if path[i]:
                kind, a, b = LABELS[path[i]], words[i][0], words[j - 1][1]
                while b > a and text[b - 1] in ".,;:!?":
                    b -= 1
                if b > a and _passes(kind, text[a:b]) and not overlaps(base, a, b):
                    out.append((kind, a, b))
            i = j
    return out


def find(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and
    spans (base and CRF). Null and empty texts have none, repeated rows the same each, an
    empty table no rows; a text of any length is read whole. Of labellings that score the
    same the one with earlier labels in LABELS wins."""
    model = model or train(labelled_table())

    def run(batches):
        cache: dict = {}
        for batch, texts in each_slice(batches):
            base = [base_spans(t) for t in texts]
            spots = [windows(t) for t in texts]
            paths = viterbi(model, [[t[a:b] for a, b in seq] for t, s in zip(texts, spots) for seq in s], cache)
            rows, at = [], 0
            for t, b, s in zip(texts, base, spots):
                extra = added_spans(t, s, paths[at : at + len(s)], b)
                at += len(s)
                rows.append([*(sum(x[0] == k for x in b) for k in KINDS), digest(b, KINDS), render(b + extra, KINDS)])
            cols = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [batch.schema.names[0], *_OUT.names])

    kind = df.select(F.col(f"`{id_col}`").alias(id_col)).schema[0].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
