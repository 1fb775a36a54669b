"""Operators on texts against brute force, exact round trips and edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deltaloom.llm import exact_dedup, media, mixing, ngram_join, packing, suffix_dedup, textblocks
from deltaloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, source string, copies int, n int, bucket int, block int, digest string"
EDGES = [None, "", " ", "\n", "a", "É", "A b", "a b", "word " * 5, "x" * 3000, "long text of words " * 2000]


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those that operators use inside."""
    rows = [(i, t, None if k % 7 == 3 else f"s{k % 3}", 1, 2, 3, 4, "d") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# --- suffix-array dedup ---


def removed(rows, length):
    least = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "hot", "block"), [(50, 20_000, 6000), (50, 30, 6000), (20, 5, 1 << 20), (8, 100, 4000)])
def test_suffix_dedup(spark, length, hot, block):
    rng = random.Random(length + hot)
    passages = ["".join(rng.choice("abc déx\0") for _ in range(rng.choice([length - 1, length, length + 1, 2 * length]))) for _ in range(9)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abc ") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(7))) for _ in range(150)]
    texts += [None, "", "a" * 300, "a" * (length - 1), "a" * length, "a" * 120, texts[5], texts[5]]
    ids = [(7 * i) % 140 for i in range(len(texts))]  # some ids twice
    df = docs(spark, texts, ids)
    got = sorted(map(tuple, suffix_dedup.suffix_dedup(df, length=length, hot=hot, block_bytes=block).collect()))
    assert got == removed(list(zip(ids, texts, strict=True)), length)


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.suffix_dedup(docs(spark, []).limit(0)).count() == 0
    df = spark.createDataFrame([(None, "z" * 60), (1, "z" * 60), (None, "z" * 60)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df, with_text=True).collect()}
    assert got == {(1, 0, b"z" * 60), (None, 60, b"")}


def test_interval_expansion_gives_the_common_prefixes():
    rng = np.random.default_rng(1)
    for n, sigma, length in ((200, 2, 5), (500, 3, 8), (300, 200, 3), (64, 1, 9)):
        codes = rng.integers(1, sigma + 1, n).astype(np.uint8)
        codes[rng.integers(0, n, 6)] = 0
        codes[-1] = 0
        order = suffix_dedup.sorted_suffixes(codes, length)
        same = suffix_dedup.expand_intervals(codes[order - 1], length)
        text = codes.tobytes()
        for r in range(1, n):
            a, b = (text[order[k] : order[k] + length] for k in (r - 1, r))
            if len(a) == len(b) == length and 0 not in a and 0 not in b:
                assert same[r] == (a == b)


# --- exact dedup ---


def test_exact_dedup(spark):
    texts = [*EDGES, "ABC", "abc", "aBc", "ÄB", "äb", "Äb", *["hot"] * 300]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    fold = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(fold(t), []).append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    small = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs(spark, ["a", "A", "b"]), smallest=True).collect()}
    assert small == {0: 0, 1: 0, 2: 2}


def test_exact_dedup_with_an_index(spark):
    first = exact_dedup.build_index(docs(spark, ["a", "b", "B"]))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs(spark, ["A", "c", "b"], [-5, -4, 9]), index=first).collect()}
    assert got == {-5: (0, 2), -4: (-4, 1), 9: (9, 3)}
    assert exact_dedup.exact_dedup(docs(spark, []).limit(0)).count() == 0 and exact_dedup.build_index(docs(spark, []).limit(0)).count() == 0
    rows = exact_dedup.exact_dedup(docs(spark, ["a", "a", "b"], [1, 1, None])).collect()
    assert sorted((str(r.doc_id), r.group_size, r.kept) for r in rows) == [("1", 2, True), ("1", 2, True), ("None", 1, True)]


def test_exact_dedup_runs_and_filters(spark):
    """Filters never deny what another run holds; compaction of what they let through gives the groups."""
    rng = random.Random(9)
    entries = [(rng.randrange(4), f"{rng.randrange(900)}".encode(), i, 1) for i in range(2500)]
    runs = exact_dedup.flush(spark.createDataFrame(entries, "run int, digest binary, keep_id long, group_size long").repartition(3), True)
    held = {(r.run, bytes(r.digest)) for r in runs.collect()}
    assert held == {(r, d) for r, d, _, _ in entries} and exact_dedup.filter_rows(10**6) > 100
    for size in (1, 3):
        probed = exact_dedup.probe(runs, exact_dedup.filters(runs, size), size)
        rows = probed.collect()
        assert len(rows) == len(held) and {f.name for f in probed.schema} == {"run", "digest", "keep_id", "group_size", "maybe"}
        shared = [any((o, bytes(r.digest)) in held for o in range(4) if o != r.run) for r in rows]
        assert all(r.maybe for r, s in zip(rows, shared, strict=True) if s) and not all(r.maybe for r in rows)
        got = {bytes(r.digest): (r.keep_id, r.group_size) for r in exact_dedup.compact(probed, True).collect()}
        ids = {}
        for _, d, i, _ in entries:
            ids.setdefault(d, []).append(i)
        assert got == {d: (min(x), len(x)) for d, x in ids.items() if len(x) > 1}


@pytest.mark.parametrize("most", [10**6, 0])
def test_exact_dedup_clash(spark, monkeypatch, most):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("ab" * 32))
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST", most)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs(spark, ["a", "A", "b"])).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (2, 1)}
    first = exact_dedup.build_index(docs(spark, ["b", "x"], [70, 71]))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs(spark, ["a", "A", "b"]), index=first).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (70, 2)}


def test_exact_dedup_without_broadcast(spark, monkeypatch):
    texts = [*EDGES, *["hot"] * 200, *["Cold", "cold"] * 3]
    want = sorted(map(str, exact_dedup.exact_dedup(docs(spark, texts)).collect()))
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST", 0)
    assert sorted(map(str, exact_dedup.exact_dedup(docs(spark, texts)).collect())) == want


# --- n-gram Jaccard join ---


def components(rows, k=5, share=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= share * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("seed", range(3))
def test_ngram_join(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(22):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 12, 40, 150]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words + [rng.choice(vocabulary)] * rng.choice([0, 0, 1, 6])))
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(22))]) for _ in range(80)]
    texts += [None, "", " \n ", "one", "ONE", "A b", "a\tB", "É x", "é x"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, texts), block_bytes=9000).collect()}
    assert got == components(list(enumerate(texts)))


def test_ngram_join_edges(spark):
    assert ngram_join.ngram_join(docs(spark, []).limit(0)).count() == 0
    rows = ngram_join.ngram_join(docs(spark, ["a b", "a b", "A B", None], [1, 1, 0, None])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in rows) == [("0", 1, 0), ("1", 1, 0), ("1", 1, 0), ("None", 0, None)]


@pytest.mark.parametrize("seed", range(2))
def test_ngram_join_with_repeated_ids(spark, seed):
    """Rows that share a doc_id are documents of their own, in whatever order they come."""
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(40)) for _ in range(5)]
    rows = [(1, base[0]), (1, base[1]), (4, base[1].replace(base[1].split()[9], "x")), (2, base[2]), (0, base[2]), (2, base[3]), (3, base[3] + " end"), (2, base[4]), (2, base[4] + " end"), (5, None), (5, base[0] + " more")]
    numbered = components([(i, t) for i, (_, t) in enumerate(rows)])
    least = {}
    for i, (d, _) in enumerate(rows):
        least[numbered[i][1]] = min(d, least.get(numbered[i][1], d))
    want = sorted((d, numbered[i][0], least[numbered[i][1]]) for i, (d, _) in enumerate(rows))
    for _ in range(2):
        rng.shuffle(rows)
        got = ngram_join.ngram_join(docs(spark, [t for _, t in rows], [d for d, _ in rows])).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_ngram_join_deals_hot_postings(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_POSTING", 3)
    rng = random.Random(11)
    passage = [f"w{rng.randrange(3000)}" for _ in range(60)]
    texts = [" ".join(passage + [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(24))]) for _ in range(70)] + ["a b c d e f g", "a b c d e f g h"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, texts)).collect()}
    assert got == components(list(enumerate(texts)))


@pytest.mark.parametrize("with_base", [False, True])
def test_ngram_join_ends_after_few_rounds(spark, monkeypatch, with_base):
    """Edited copies of a text of which no two link: each round used to leave one of them behind."""
    rounds, find = [], ngram_join.connected_components
    monkeypatch.setattr(ngram_join, "connected_components", lambda links: rounds.append(1) or find(links))
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base)] * 2 if with_base else []
    for i in range(40):
        words = list(base)
        for at in (2 * i + 5, (2 * i + 41) % 90 + 5) if i % 10 else (30,):
            words[at] = f"x{i}"
        texts.append(" ".join(words))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, texts)).collect()} == components(list(enumerate(texts)))
    assert len(rounds) <= 5


def test_signatures_never_miss_a_pair():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randrange(5, 90)
        level = {}
        x = rng.sample(range(10_000), n)
        y = list(x)
        for _ in range(rng.randrange(0, max(1, n // 7))):
            y[rng.randrange(len(y))] = rng.randrange(10_000, 20_000)
        y = list(set(y + rng.sample(range(20_000, 30_000), rng.randrange(0, max(1, n // 12)))))
        for t in {*x, *y}:
            level[t] = rng.choice([1, 3, 12, 20, 30]) if t in x and t in y else rng.choice([0, 0, 2, 12, 30])
        common = len({*x} & {*y})
        if 100 * common >= 80 * len({*x, *y}):
            a, b = (set(ngram_join.signatures(sorted(s), [level[t] for t in sorted(s)], 80)) for s in (x, y))
            assert a & b


# --- packing ---


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40) | st.text(alphabet="abZ 'strevmld019%$.,<|>\n\t\x0b\x1céÉßÇ×İſKÅ中̇ﬁ", max_size=30))
def test_word_encoder_equals_the_tokenizer(text):
    e = packing.encoder(tokenizer_path())
    ids, counts = e.encode([text.encode(), b"x"])
    want = e.tokenizer.encode(text, add_special_tokens=False).ids + [0]
    assert ids[: counts[0]].tolist() == want


def test_other_tokenizers_encode_whole_texts():
    """Only what declares the normaliser and splits of the fast way takes it; case, white space and numbers matter else."""
    assert packing.encoder(tokenizer_path()).chunks
    other = packing.WordEncoder(tokenizer_path().replace("word_bpe_49k", "byte_bpe_50k"))
    assert not other.chunks
    texts = ["", "Two  Words\n\nand 2024 more", " don't ", "Two  Words\n"]
    ids, counts = other.encode([t.encode() for t in texts])
    want = [other.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
    ids, counts = other.encode([])
    assert len(ids) == len(counts) == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=20))
def test_plan_is_best_fit_decreasing(counts):
    plan, opened = packing.best_fit_plan(counts, 64)
    room: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, r in enumerate(room) if r >= length]
            if not fits:
                room.append(64)
                fits = [len(room) - 1]
            room[min(fits, key=lambda i: room[i])] -= length
    assert opened == len(room)
    used: dict[int, list[tuple[int, int]]] = {}
    ranks: Counter = Counter()
    for length, rank, n, first, each, offset in plan:
        assert rank == ranks[length]
        ranks[length] += n
        for k in range(n):
            used.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert ranks == Counter({k: v for k, v in counts.items() if v})
    for pieces in used.values():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at <= 64
    assert sorted(64 - r for r in room) == sorted(sum(n for _, n in p) for p in used.values())


def test_pack(spark):
    texts = [*EDGES, "Some words, and more."]
    rows = packing.pack(docs(spark, texts), tokenizer_path(), limit=256, with_ids=True).collect()
    tokenizer = packing.encoder(tokenizer_path()).tokenizer
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in mine for x in r.ids] == ids and [r.start for r in mine] == list(range(0, len(ids), 256))
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes()) for s in range(0, len(ids), 256)]
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack(docs(spark, []).limit(0), tokenizer_path()).count() == 0


# --- media ---


@pytest.mark.parametrize("shape", [(1, 64), (5, 7), (9, 4, 3)])
def test_images_survive(shape):
    x = np.random.default_rng(0).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_pgm(x)) == x).all() and (media.decode(media.encode_bmp(x)) == x).all()


def test_other_netpbm_and_bmp():
    assert media.decode(b"P2 # c\n2 2\n# d\n15\n0 15\n5 10\n").tolist() == [[0, 255], [85, 170]]
    assert media.decode(b"P1\n3 2\n101\n0 1 0").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5\n1 2\n65535\n\xff\xff\x00\x00").tolist() == [[255], [0]]
    for bad in (b"", b"GIF89a", b"P5\n", b"P5\n9 9\n255\nx"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_is_the_mean():
    x = np.random.default_rng(2).integers(0, 256, (12, 18), dtype=np.uint8)
    assert np.allclose(media.area_resize(x, 4, 6), x.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    fine = np.repeat(np.repeat(x[:7, :5], 9, axis=0), 8, axis=1)  # parts of samples
    assert np.allclose(media.area_resize(x[:7, :5], 9, 8), fine.reshape(9, 7, 8, 5).mean(axis=(1, 3)))


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_media_columns(spark, form):
    got = {r.doc_id: r for r in media.media_columns(docs(spark, EDGES), form=form).collect()}
    for i, t in enumerate(EDGES):
        b = (t or "").encode()
        whole = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and media.decode(bytes(r.media)).tobytes() == whole
        import io

        assert np.load(io.BytesIO(bytes(r.tile))).shape == (32, 32)
    assert got[0].feature == got[1].feature and media.media_columns(docs(spark, []).limit(0)).count() == 0


def test_describe_images(spark):
    df = spark.createDataFrame([(1, bytearray(media.encode_bmp(np.eye(8, dtype=np.uint8)))), (2, bytearray(b"no")), (3, None)], "id long, media binary")
    assert {r.id: (r.height, r.width) for r in media.describe_images(df).collect()} == {1: (8, 8), 2: (None, None), 3: (None, None)}


# --- mixing ---


def test_targets_are_reshared():
    got = mixing.source_targets({"a": 10, "b": 100, None: 50, "c": 0}, (3, 1, 2), 1.5, 2.0)
    assert got["a"] == 20 and got["c"] == 0 and abs(sum(got.values()) - 240) < 1e-9 and got[None] == 100 and abs(got["b"] - 120) < 1e-9
    full = mixing.source_targets({"a": 10, "b": 10}, (1,), 3.0, 2.0)
    assert full == {"a": 20, "b": 20}
    assert mixing.source_targets({"a": 0}, (3,), 1.5, 2.0) == {"a": 0}


def test_mix(spark):
    rng = random.Random(8)
    texts = [None if i % 50 == 0 else "w " * rng.choice([1, 5, 40, 300]) for i in range(900)]
    df = docs(spark, texts)
    for block_rows in (2000, 40):
        rows = mixing.mix(df, block_rows=block_rows).collect()
        again = mixing.mix(df.repartition(5), block_rows=block_rows).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(texts)
        sums = Counter()
        for r in rows:
            assert r.size == len((texts[r.doc_id] or "").split()) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
            sums[r.source, r.target, r.source_size] += r.taken
        for (_, target, size), taken in sums.items():
            assert abs(taken - target) <= 0.02 * target + 300 and target <= 2 * size
    assert mixing.mix(docs(spark, []).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [None, ""])).collect()] == [0, 0]


def test_cube_draws_are_unbiased_and_balanced():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1000, 60).tolist()
    hits = np.zeros(60)
    for seed in range(400):
        p = [0.3] * 60
        left = mixing._walk(p, list(range(60)), sizes, np.random.default_rng(seed), 2)
        assert len(left) <= 2 and abs(sum(p) - 18) < 1e-6 and abs(np.dot(p, sizes) - 0.3 * sum(sizes)) < 1e-4
        for c in (1, 0):
            left = mixing._walk(p, left, sizes, np.random.default_rng(seed + 1000), c)
        assert set(p) <= {0.0, 1.0}
        hits += p
    assert abs(hits / 400 - 0.3).max() < 0.1


# --- blocks of texts ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab \t\n\x0b\x1céA", max_size=12), max_size=8))
def test_words_of_blocks(texts):
    b, offsets = textblocks.flat(pa.array(texts, pa.string()))
    starts, ends, counts = textblocks.words(b, offsets)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and [b[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] == [x for w in want for x in w]
    hashes = textblocks.word_hashes(b, starts)
    seen = {}
    for h, w in zip(hashes.tolist(), (x.lower() for w in want for x in w), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30))
def test_packed_numbers(values):
    x = np.array(sorted(values), np.uint64)
    assert textblocks.unpack_sorted(textblocks.pack_sorted(x)).tolist() == x.tolist()


def test_suffixes_are_sorted_by_words_of_ranks():
    """Both ways to sort give the same classes in the same order, and the expansion finds common prefixes of any length."""
    rng = np.random.default_rng(5)
    for length in (1, 3, 8, 13, 50):
        codes = rng.integers(1, 3, 700).astype(np.uint8)
        codes[rng.integers(0, 700, 12)] = 0
        codes[300:420] = codes[100:220]
        codes[-1] = 0
        order = suffix_dedup.sorted_suffixes(codes, length)
        cut = [bytes(codes[i : i + length]) for i in order]
        assert cut == [bytes(codes[i : i + length]) for i in suffix_dedup._sorted_by_ranks(codes, length)] == sorted(cut)
        same = suffix_dedup.expand_intervals(codes[order - 1], length)
        whole = [i for i, x in enumerate(cut) if len(x) == length and 0 not in x]
        assert whole and [same[i] for i in whole] == [i > 0 and cut[i] == cut[i - 1] for i in whole]


def test_packed_numbers_take_what_their_differences_take():
    # The first number took as many bytes for every difference as it has itself.
    x = np.uint64(1 << 47) + np.cumsum(np.full(1000, 1 << 30, np.uint64))
    packed = textblocks.pack_sorted(x)
    assert len(packed) <= 4 * len(x) + 9
    assert textblocks.unpack_sorted(packed).tolist() == x.tolist()
    wide = np.arange(100, dtype=np.uint64) << np.uint64(33)
    assert len(textblocks.pack_sorted(wide)) <= 5 * len(wide) + 9
    assert textblocks.unpack_sorted(textblocks.pack_sorted(wide)).tolist() == wide.tolist()
