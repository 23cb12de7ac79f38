from __future__ import annotations

import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.llm import huffman, mixing, packing, sharding, tokens

PATH = tokens.default_path()


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def brute_ids(texts):
    t = tokenizer()
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- sharding


def test_shards_follow_the_key_law(docs, corpus):
    leaves = sharding.layout(2, 3, 4)
    rows = sharding.shard(docs, leaves).collect()
    assert len(rows) == len(corpus)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in corpus)
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})
    again = sharding.shard(docs.repartition(3), leaves).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_weights_shape_shards_and_confine_movement(spark):
    keys = spark.range(40_000)
    base = sharding.layout(2, 2, 2)
    heavy = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 3 else 1.0) for x in base]
    rows = keys.select(sharding.place(keys["id"], base).alias("a"), sharding.place(keys["id"], heavy).alias("b"), sharding.place(keys["id"], sharding.grown(base)).alias("c")).collect()
    counts = Counter(r.a for r in rows)
    assert max(abs(n / 5000 - 1) for n in counts.values()) < 0.06
    assert abs(Counter(r.b for r in rows)[3] / 12_000 - 1) < 0.05
    # rows leave a shard only for the subtree of region 0 whose weight grew, never the other way
    assert all(r.b in (0, 1, 2, 3) for r in rows if r.a != r.b)
    assert {r.c for r in rows if r.c != r.a} == {8}


def brute_place(key, leaves, seed="tree"):
    import math

    import xxhash

    node = ""
    for level in range(3):
        weight = defaultdict(float)
        for x in leaves:
            parts = [str(x.region), str(x.rack), str(x.shard)]
            if "/".join(parts[:level]) == node:
                weight["/".join(parts[: level + 1])] += x.weight
        best = None
        for path, w in weight.items():
            h = 42
            for part in [] if key is None else [key.to_bytes(8, "little", signed=True)]:
                h = xxhash.xxh64_intdigest(part, h)
            for part in (path.encode(), seed.encode()):
                h = xxhash.xxh64_intdigest(part, h)
            draw = -math.log(((h >> 11) + 0.5) / 2**53) / w
            best = min(best or (draw, path), (draw, path))
        node = best[1]
    return int(node.split("/")[2])


def test_places_match_brute_force(spark, sf):
    """The whole table, recomputed one key at a time."""
    leaves = sharding.layout(2, 3, 4)
    for r in sharding.shard(spark.read.parquet(f"{sf}/documents.parquet"), leaves).collect():
        assert (r.shard, r.grown_shard) == (brute_place(r.doc_id, leaves), brute_place(r.doc_id, sharding.grown(leaves)))
    (r,) = spark.range(1).select(sharding.place(F.lit(None).cast("long"), leaves).alias("s")).collect()
    assert r.s == brute_place(None, leaves)


def test_sharding_empty_and_clashing(empty, clashing):
    assert sharding.shard(empty, sharding.layout(2, 3, 4)).count() == 0
    assert sharding.shard(clashing, sharding.layout(2, 3, 4)).count() == clashing.count()


# ---- mixing


def test_mix_meets_targets_to_the_word(docs, corpus):
    rows = mixing.mix(docs, block=64).collect()
    assert len(rows) == len(corpus)
    sizes = defaultdict(int)
    for r in corpus:
        sizes[r[3]] += len((r[1] or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    assert abs(sum(aims) - sum(sizes.values())) < 1e-6
    for r in rows:
        assert r.taken <= 3 * r["size"] and r.size >= 0
    source = {(r[0], len((r[1] or "").encode().split())): r[3] for r in corpus}
    taken = defaultdict(int)
    for r in rows:
        taken[source[r.doc_id, r["size"]]] += r.taken
    for s, aim in zip(order, aims):
        assert abs(taken[s] - aim) <= 1, s
    again = mixing.mix(docs.repartition(2), block=64).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


@given(st.lists(st.tuples(st.integers(0, 10_000), st.sampled_from([5, 2, 1])), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_targets_share_everything_below_the_cap(sources):
    sizes, weights = [s for s, _ in sources], [w for _, w in sources]
    aims = mixing.targets(sizes, weights)
    assert sum(aims) == pytest.approx(sum(sizes))
    assert all(a <= 3 * s + 1e-6 for a, s in zip(aims, sizes))
    open_ = [a / w for a, s, w in zip(aims, sizes, weights) if a < 3 * s - 1e-6]
    assert not open_ or max(open_) == pytest.approx(min(open_))


def test_schedule_interleaves_evenly(spark):
    need = [300, 120, 5]
    rows = sorted(mixing.schedule(spark, need, chunk_slots=64).collect())
    by = defaultdict(list)
    for r in rows:
        by[r.src].append((r.slot, r["rank"]))
    assert [len(by[s]) for s in range(3)] == need
    for s in range(3):
        assert [k for _, k in sorted(by[s])] == list(range(need[s]))
    first = Counter(r.src for r in rows if r.slot < 212)
    assert abs(first[0] - 150) <= 4 and abs(first[1] - 60) <= 4


def brute_slots(need):
    """The schedule, slot by slot: (source, rank) of each."""
    total, left, out = sum(need), [0] * len(need), []
    ends = [sum(need[: k + 1]) / total for k in range(len(need))]
    for t in range(total):
        point = ((t + 1) * 0x9E3779B97F4A7C15 % 2**64) / 2**64
        s = next((k for k, e in enumerate(ends) if point < e), len(ends) - 1)
        if left[s] < need[s]:
            out.append((t, s, left[s]))
        left[s] += 1
    got = [min(a, b) for a, b in zip(left, need)]
    return out + [(total + (r - got[s]) * len(need) + s, s, r) for s in range(len(need)) for r in range(got[s], need[s])]


class Long(int):
    """An integer that Spark hashes as eight bytes; others are hashed as four."""


def brute_mix(rows, block):
    """(id, size, source size, target, taken, slot, offset) of (id, source, text) rows, from
    plain loops: targets by repeated sharing, streams by hash, slots one by one."""
    import xxhash

    def hashed(*values):
        h = 42
        for v in values:
            if v is not None:
                data = v.encode() if isinstance(v, str) else v.to_bytes(8 if isinstance(v, Long) else 4, "little", signed=True)
                h = xxhash.xxh64_intdigest(data, h)
        return h - (1 << 64) if h >> 63 else h

    docs = defaultdict(list)
    for i, source, text in rows:
        own = None if i is None else Long(i)
        keys = [hashed(k, i is None, source is None, text is None, own, source, text) for k in (1, 2)]
        order = hashed(Long(keys[0]), "mix")
        docs[source].append((order % 2**64 >> 32, order, *keys, i, len((text or "").encode().split())))
    names = sorted(docs, key=lambda s: (s is None, s or ""))
    sizes = [sum(d[-1] for d in docs[n]) for n in names]
    weights, full = [(5, 2, 1)[k % 3] for k in range(len(names))], {}
    while True:
        left = sum(sizes) - sum(full.values())
        share = {k: left * weights[k] / sum(w for j, w in enumerate(weights) if j not in full) for k in range(len(names)) if k not in full}
        above = [k for k, x in share.items() if x > 3 * sizes[k]]
        if not above:
            break
        full |= {k: 3.0 * sizes[k] for k in above}
    aims = full | share
    words = [min(round(aims[k]), 3 * n) for k, n in enumerate(sizes)]
    blocks = [-(-n // block) for n in sizes]
    need = [w // n * b + -(-(w % n) // block) if n else 0 for w, n, b in zip(words, sizes, blocks)]
    slot_of = {(s, r): t for t, s, r in brute_slots(need)} if sum(need) else {}
    out = []
    for k, name in enumerate(names):
        start, n = 0, sizes[k]
        for *_, i, size in sorted(docs[name]):
            taken = words[k] // n * size + max(0, min(size, words[k] % n - start)) if size else 0
            out.append((i, size, n, round(aims[k], 6), taken, slot_of[k, start // block] if taken else None, start % block if taken else None))
            start += size
    return out


@pytest.mark.parametrize("block", [16, 64, mixing.BLOCK])
def test_mix_matches_brute_force(docs, corpus, spark, sf, block):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, table) if block == 64 else (docs,):
        rows = [(r.doc_id, r.source, r.text) for r in df.select("doc_id", "source", "text").collect()]
        got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken, r.slot, r.slot_offset) for r in mixing.mix(df, block=block).collect()]
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(got, key=key) == sorted(brute_mix(rows, block), key=key)


def test_schedule_matches_brute_force(spark):
    for need in ([30, 12, 5, 0, 1], [100], [7, 7, 7]):
        assert sorted(tuple(r) for r in mixing.schedule(spark, need, chunk_slots=32).collect()) == sorted(brute_slots(need))


def test_documents_follow_the_points(docs, clashing):
    """Other points give another order and the same amounts."""
    read = lambda points: {(r.doc_id, r["size"], r.taken): (r.slot, r.slot_offset) for r in mixing.mix(docs, block=64, points=points).collect()}
    in_turn = lambda first, n: np.arange(first, first + n) % 997 / 997
    golden = read(mixing.golden)
    assert all((v[0] is None) == (k[2] == 0) for k, v in golden.items())
    order = [(r.doc_id, r.text) for r in mixing.mixed(clashing, block=64).collect()]
    other = read(in_turn)
    assert golden.keys() == other.keys() and golden != other
    again = [(r.doc_id, r.text) for r in mixing.mixed(clashing, block=64, points=in_turn).collect()]
    assert Counter(order) == Counter(again) and order != again


def test_mixed_corpus_lies_in_the_order_of_slots(docs, spark):
    places = defaultdict(set)
    for r in mixing.mix(docs, block=64).where("slot is not null").collect():
        places[r.doc_id].add((r.slot, r.slot_offset))
    first = {}
    for i, r in enumerate(mixing.mixed(docs, block=64).collect()):
        first.setdefault(r.doc_id, i)
    once = [d for d in first if len(places[d]) == 1]
    by_slot = sorted(once, key=lambda d: min(places[d]))
    assert len(once) > 100 and by_slot == sorted(once, key=first.get)


def test_repeated_rows_are_taken_each_for_itself(spark):
    rows = [(1, "a b c d", "x", k) for k in range(9)] + [(2, "e f g h i", "y", 0), (None, "j k", None, 1), (None, None, "j k", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    taken = Counter()
    for r in mixing.mix(df, block=4).collect():
        taken[r.doc_id] += round(r.taken / r["size"]) if r["size"] else 0
    out = mixing.mixed(df, block=4).collect()
    assert Counter(r.doc_id for r in out) == +taken and {r.copy for r in out if r.doc_id == 1} <= set(range(9))


def test_too_many_sources_are_refused(docs, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(docs)


def test_mixed_rows_and_empty(clashing, empty, spark):
    out = mixing.mixed(clashing, block=64)
    assert out.columns == clashing.columns and out.count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]


# ---- tokens


@given(st.lists(st.text(st.sampled_from(" \n\t 　\x1c\x85a1é.'sB日-"), max_size=24), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_units_encode_like_whole_texts(texts):
    import pyarrow as pa

    ids, ends = tokens.encoder(PATH).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == brute_ids(texts)
    assert all("".join(tokens.units(t)) == t for t in texts)


def test_added_tokens_are_themselves():
    import pyarrow as pa

    ids, ends = tokens.encoder(PATH).encode(pa.array(["a b", "a <|endoftext|> b", None, "<|endoftext|>"]))
    assert ends.tolist() == [0, 2, 6, 6, 7] and ids.tolist() == [64, 275, 64, 220, 50256, 275, 50256]


def test_a_full_store_changes_nothing(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "STORE_UNITS", 20)
    e = tokens.Encoder(PATH)
    for k in range(5):
        texts = [f"some w{k}x{i} words again {i} and  more" for i in range(30)]
        ids, ends = e.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == brute_ids(texts)


# ---- packing


def test_pack_places_each_token_once(docs, corpus):
    rows = packing.pack(docs, with_ids=True).collect()
    want = Counter()
    for r, ids in zip(corpus, brute_ids([r[1] for r in corpus])):
        ids = ids + [0]
        for a in range(0, len(ids), 1024):
            part = ids[a : a + 1024]
            want[r[0], a, len(part), crc(part), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(n for _, n, *_ in (s for p in by.values() for s in p)) / 1024 > 0.9 * len(by)


def test_sequences_are_padded(docs):
    packed = packing.pack(docs, with_ids=True)
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4096


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_patterns_hold_the_histogram(counts):
    patterns = packing.pack_histogram(counts, 64)
    held = Counter()
    for many, pattern in patterns:
        assert sum(s * k for s, k in pattern) <= 64
        for s, k in pattern:
            held[s] += many * k
    assert dict(held) == counts
    covered = defaultdict(list)
    for size, first, last, *_ in packing.blocks(patterns):
        covered[size].append((first, last))
    for size, spans in covered.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == counts[size] - 1
        assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
    least = -(-sum(s * n for s, n in counts.items()) // 64)
    assert sum(m for m, _ in patterns) <= 2 * least + 1


def test_packing_empty_and_clashing(empty, clashing):
    assert packing.pack(empty).count() == 0
    assert packing.pack(clashing).count() >= clashing.count()


# ---- Huffman files


def test_huffman_round_trip(docs, corpus, monkeypatch):
    monkeypatch.setattr(huffman, "FILE_IDS", 4000)
    rows = huffman.round_trip(docs).collect()
    want = sorted(zip([r[0] for r in corpus], brute_ids([r[1] for r in corpus])), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x) + 1, crc(x + [2])) for i, x in want)


def test_huffman_empty_and_clashing(empty, clashing):
    assert huffman.round_trip(empty).count() == 0
    assert huffman.round_trip(clashing).count() == clashing.count()


@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=300), st.integers(9, 16))
@settings(max_examples=100, deadline=None)
def test_code_lengths_are_complete_and_limited(counts, limit):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, limit)
    used = lengths[lengths > 0].astype(float)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max(initial=0) <= limit
    if len(used) > 1:
        assert (2.0**-used).sum() == 1


def test_code_lengths_are_optimal_without_a_limit():
    import heapq

    rng = np.random.default_rng(3)
    counts = rng.integers(1, 1000, 200)
    heap, total = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    assert int((counts * huffman.code_lengths(counts)).sum()) == total


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.01, 70_000) - 1, 4999).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=5000))
    for n in (1, 255, 256, 257, 70_000):
        payload, points = huffman.encode_block(ids[:n], huffman.canonical(lengths), lengths)
        assert (huffman.decode_block(payload, points, n, huffman.decode_table(lengths)) == ids[:n]).all()
        assert len(points) == -(-n // huffman.LANE)


def test_more_ids_than_sixteen_bits_number_go_round():
    rng = np.random.default_rng(9)
    ids = rng.permutation(np.concatenate([np.arange(90_000), np.minimum(rng.geometric(0.001, 60_000), 89_999)])).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids))
    assert 16 < lengths.max() <= huffman.WIDEST and (2.0 ** -lengths[lengths > 0].astype(float)).sum() == 1
    payload, points = huffman.encode_block(ids, huffman.canonical(lengths), lengths)
    assert (huffman.decode_block(payload, points, len(ids), huffman.decode_table(lengths)) == ids).all()


def test_widest_codes_go_round():
    counts = np.array([2**k for k in range(30)])
    lengths = huffman.code_lengths(counts, huffman.WIDEST)
    assert lengths.max() == huffman.WIDEST
    ids = np.random.default_rng(2).integers(0, 30, 5000).astype(np.uint32)
    payload, points = huffman.encode_block(ids, huffman.canonical(lengths), lengths)
    assert (huffman.decode_block(payload, points, len(ids), huffman.decode_table(lengths)) == ids).all()


def test_rows_of_one_id_fill_many_token_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(huffman, "FILE_IDS", 500)
    rows = [(None if i % 3 else 7, f"text number {i} of one id") for i in range(400)]
    manifest = huffman.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert max(r.docs for r in manifest.collect()) < 200 and manifest.count() > 4
    read = huffman.read(manifest).orderBy("start").collect()
    assert [r.doc_id for r in read] == sorted((i for i, _ in rows), key=lambda i: i or 0)
    assert [r.start for r in read] == [sum(x.n_tokens for x in read[:k]) for k in range(len(read))]
    assert len({r.ids_crc32 for r in read}) == 400


def test_no_two_sources_share_a_slot(spark):
    for need in ([40, 20], [1] * 40 + [3] * 20, [1, 200, 1, 1, 9]):
        slots = [r.slot for r in mixing.schedule(spark, need, chunk_slots=16).collect()]
        assert len(slots) == len(set(slots)) == sum(need)


def test_endless_headers_are_refused():
    import io

    from trailmark.llm import warc

    with pytest.raises(ValueError, match="no blank line"):
        warc._Scan(io.BytesIO(b"WARC/1.0\r\n" + b"a: b\r\n" * 400_000)).headers()
