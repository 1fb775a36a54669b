"""Suffix-array dedup: repeated byte strings found by interval expansion on Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import block_count
from .textblocks import M1, M4, MULTIPLIERS, U, flat, mix, pack_sorted, unpack_sorted

#: Bytes of text in a block, which is what one task holds at once.
BLOCK_BYTES = 8 << 20
#: Bytes of an anchor; a window is dealt by the anchor of least hash inside it.
ANCHOR = 16
#: From so many occurrences on, windows of an anchor are dealt by their own content.
HOT = 20_000
#: Bytes of the transforms that are built at once, and window starts that are hashed at once.
TRANSFORM_BYTES, CHUNK = 1 << 19, 1 << 17
#: The doc_id by which null counts: larger than all others.
NULL_ID = 2**63 - 1


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of width neighbours."""
    m, c, n = x, 1, len(x) - width + 1
    while 2 * c <= width:
        m = np.minimum(m[:-c], m[c:])
        c *= 2
    return np.minimum(m[:n], m[width - c : width - c + n]) if c < width else m[:n]


def anchor_runs(b: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of length bytes inside one text, as runs of neighbours that share their anchor: first window,
    windows, key. A window's anchor depends on its bytes only, so equal windows have equal keys everywhere."""
    size = min(ANCHOR, length)
    half = min(8, size)
    n = len(b) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    ends = np.repeat(offsets[1:].astype(np.int32), np.diff(offsets))
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    words = np.ndarray((len(b) + 1,), "<u8", padded, 0, (1,))
    short = U(64 - 8 * half)
    starts, keys, spans = [], [], []
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        first, last = words[lo : hi + length - size] << short, words[lo + size - half : hi + length - half] << short
        h = (first * M1) ^ (last * M4)
        h = (h ^ (h >> U(29))) * M1
        x = (h >> U(32) << U(32)) | np.arange(len(h), dtype=np.uint64)
        at = (_least(x, length - size + 1) & U(0xFFFFFFFF)).astype(np.int64)
        good = np.flatnonzero(np.arange(lo + length, hi + length) <= ends[lo:hi])
        if not len(good):
            continue
        at = at[good]
        new = np.ones(len(good), bool)
        new[1:] = (at[1:] != at[:-1]) | (good[1:] != good[:-1] + 1)
        cut = np.flatnonzero(new)
        starts.append(good[cut] + lo)
        spans.append(np.diff(np.append(cut, len(good))))
        keys.append(mix(h[at[cut]]))
    if not starts:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    return np.concatenate(starts), np.concatenate(spans), np.concatenate(keys)


def _rows(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The strings at starts as rows of width bytes, zero behind their ends."""
    padded = np.concatenate([b, np.zeros(width, np.uint8)])
    rows = sliding_window_view(padded, width)[starts]
    rows[np.arange(width) >= sizes[:, None]] = 0
    return rows


def _hashes(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    h = sizes.astype(np.uint64) * M4
    for i, word in enumerate(np.ascontiguousarray(rows).view("<u8").T):
        h = (h ^ (word * U(MULTIPLIERS[i % 5]))) * M1
        h ^= h >> U(31)
    return mix(h)


def _distinct(rows: np.ndarray, sizes: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then hashes, and where in it other strings begin. Neighbours are compared byte by byte."""
    order = np.lexsort((hashes, keys))
    new = np.ones(len(order), bool)
    if len(order):
        near = (hashes[order[1:]] == hashes[order[:-1]]) & (sizes[order[1:]] == sizes[order[:-1]])
        at = np.flatnonzero(near)
        same = np.zeros(len(order) - 1, bool)
        same[at] = (rows[order[at + 1]] == rows[order[at]]).all(axis=1)
        new[1:] = ~same
    return order, np.flatnonzero(new)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    k = keys[order]
    up = np.zeros(len(k), np.uint32)
    up[1:] = k[1:] != k[:-1]
    ranks = np.empty(len(k), np.uint64)
    ranks[order] = np.cumsum(up)
    return order, ranks


def _sorted_by_ranks(codes: np.ndarray, depth: int) -> np.ndarray:
    """sorted_suffixes() of any number of suffixes."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    order, ranks = _ranks(np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64))
    have = 8
    while have < depth:
        step = min(have, depth - have)
        after = np.zeros(n, np.uint64)
        after[: n - step] = ranks[step:] + U(1)
        order, ranks = _ranks((ranks << U(32)) | after)
        have += step
    return order


def sorted_suffixes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first depth symbols (codes below 256), by doubling ranks.

    A rank is where its class of suffixes begins. Two ranks and the suffix itself make one word, so that words are
    sorted and not their places; only suffixes that still share their class are sorted again.
    """
    n = len(codes)
    bits = n.bit_length()
    if 3 * bits > 64:
        return _sorted_by_ranks(codes, depth)
    b, own = U(bits), U((1 << bits) - 1)
    have = min(8, (64 - bits) // 8)
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    words = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64) >> U(64 - 8 * have) << b | np.arange(n, dtype=np.uint64)
    words.sort()
    order = (words & own).astype(np.int64)
    words >>= b
    new = np.ones(n + 1, bool)
    new[1:n] = words[1:] != words[:-1]
    begin = np.flatnonzero(new)
    ranks = np.empty(n, np.uint64)
    ranks[order] = np.repeat(begin[:-1], np.diff(begin)).astype(np.uint64)
    while have < depth:
        step = min(have, depth - have)
        at = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(at):
            break
        some = order[at]
        after = np.where(some + step < n, ranks[np.minimum(some + step, n - 1)] + U(1), U(0))
        words = (ranks[some] << b | after) << b | some.astype(np.uint64)
        words.sort()
        some = (words & own).astype(np.int64)
        order[at] = some
        words >>= b
        fresh = np.ones(len(at), bool)
        fresh[1:] = words[1:] != words[:-1]
        new[at] = fresh
        begin = np.flatnonzero(fresh)
        ranks[some] = np.repeat(at[begin], np.diff(np.append(begin, len(at)))).astype(np.uint64)
        have += step
    return order


def expand_intervals(bwt: np.ndarray, length: int) -> np.ndarray:
    """Which rows share their first length symbols with the row before, from the transform alone; symbol 0
    separates strings and is never part of a common prefix.

    Breadth-first backward extension (Beller, Gog, Ohlebusch and Schnattinger, 2013): the interval of every
    string w found so far is split by the symbol c before it; where the interval of cw ends, rows differ first at
    the length of w, if they did not differ earlier. Intervals are taken by increasing length, so common prefixes come out
    in increasing order, and those of length or more are what is left when the expansion stops there.
    """
    n = len(bwt)
    back = np.argsort(bwt, kind="stable").astype(np.int32)
    forth = np.empty(n, np.int32)
    forth[back] = np.arange(n, dtype=np.int32)
    known = np.zeros(n + 1, bool)  # where a common prefix below length has been derived
    begin = np.zeros(n + 1, bool)  # of the rows of each first symbol
    begin[np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=256))])] = True
    at = np.flatnonzero(begin).astype(np.int32)
    known[at] = True
    # The rows before and after with the same symbol; rows of symbol 0 are never the first or last of an interval.
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    k = np.flatnonzero(~begin[1:n]) + 1
    before[back[k]], after[back[k - 1]] = back[k - 1], back[k]
    before[bwt == 0], after[bwt == 0] = n, -1
    low, high = at[:-1], at[1:] - 1
    single = low[:0]  # intervals of one row are extended without looking at their neighbours
    for _ in range(1, length):
        if not len(low) and not len(single):
            break
        size = high - low + 1
        if (ones := size == 1).any():
            single = np.concatenate([single, low[ones]])
            low, high, size = low[~ones], high[~ones], size[~ones]
        single = forth[single[bwt[single] != 0]]
        single = single[~known[single + 1]]
        known[single + 1] = True
        rows = np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size) + np.arange(size.sum(), dtype=np.int32)
        first, last = before[rows] < np.repeat(low, size), after[rows] > np.repeat(high, size)
        starts, ends = np.sort(forth[rows[first]]), np.sort(forth[rows[last]]) + 1
        fresh = ~known[ends]
        low, high = starts[fresh], ends[fresh] - 1
        known[ends[fresh]] = True
    return ~known[:n]


def least_owner(b: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each window of length bytes of the strings (their bytes in a row), the least owner of a string that has
    it. Builds the transform of all strings and expands its intervals."""
    used = np.zeros(256, bool)
    used[b] = True
    if used.sum() > 255:
        raise ValueError("texts in UTF-8 never have all byte values")
    code = np.cumsum(used).astype(np.uint8)
    n, m = len(b) + len(sizes), len(sizes)
    string = np.repeat(np.arange(m), sizes + 1)
    codes = np.zeros(n, np.uint8)
    ends = np.cumsum(sizes + 1)
    body = np.ones(n, bool)
    body[ends - 1] = False
    codes[body] = code[b]
    order = sorted_suffixes(codes, length)
    same = expand_intervals(codes[order - 1], length)
    starts = np.flatnonzero(~same)
    window = np.arange(n) + length <= ends[string] - 1
    owners = np.where(window, owner[string], np.int64(NULL_ID))[order]
    least = np.minimum.reduceat(owners, starts)
    out = np.empty(n, np.int64)
    out[order] = np.repeat(least, np.diff(np.append(starts, n)))
    return out[window]


class _Block:
    """One block of texts, sorted by doc_id, with its anchors."""

    def __init__(self, docs: pa.Table, length: int, buckets: int):
        docs = docs.sort_by([("order", "ascending"), ("text", "ascending")])
        self.length, self.buckets = length, buckets
        self.ids = docs["order"].to_numpy().astype(np.int64)
        self.out_ids = docs["doc_id"].combine_chunks()
        self.b, self.offsets = flat(docs["text"])
        self.starts, self.spans, self.keys = anchor_runs(self.b, self.offsets, length)
        order = np.argsort(self.keys, kind="stable")
        k = self.keys[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        self.order, self.first = order, np.flatnonzero(new)
        self.distinct = k[self.first]
        self.edges = np.searchsorted(self._bucket(self.distinct), np.arange(buckets + 1))

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> U(32)) * U(self.buckets) >> U(32)).astype(np.int64)

    def text_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, starts, side="right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct key: how often it occurs, and whether in texts of different doc_id."""
        owner = self.ids[self.text_of(self.starts[self.order])] if len(self.order) else np.empty(0, np.int64)
        if not len(owner):
            return np.empty(0, np.int64), np.empty(0, bool)
        return np.diff(np.append(self.first, len(self.order))), np.minimum.reduceat(owner, self.first) != np.maximum.reduceat(owner, self.first)

    def units(self, codes: np.ndarray):
        """What goes to the transforms: strings around shared anchors, and single windows of hot ones; equal ones
        once. Returns starts and sizes of these units by bucket, who has them, and each occurrence's unit."""
        code = np.zeros(len(self.keys), np.uint8)
        code[self.order] = np.repeat(codes, np.diff(np.append(self.first, len(self.order))))
        shared, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        spans = self.spans[hot]
        single = np.repeat(self.starts[hot] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        starts = np.concatenate([self.starts[shared], single])
        windows = np.concatenate([self.spans[shared], np.ones(len(single), np.int64)])
        sizes = windows + self.length - 1
        rows = _rows(self.b, starts, sizes, -(-(2 * self.length - min(ANCHOR, self.length)) // 8) * 8)
        hashes = _hashes(rows, sizes)
        keys = np.concatenate([self.keys[shared], hashes[len(shared) :]])
        order, first = _distinct(rows, sizes, keys, hashes)
        unit = np.empty(len(order), np.int64)
        unit[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        owner = self.ids[self.text_of(starts)]
        least, most = (f.reduceat(owner[order], first) if len(first) else owner for f in (np.minimum, np.maximum))
        head = order[first]
        edges = np.searchsorted(self._bucket(keys[head]), np.arange(self.buckets + 1))
        return starts, windows, owner, unit, (starts[head], windows[head], keys[head], least, most, edges)


def _key_shift(buckets: int) -> np.uint64:
    return U(max(0, 24 - buckets.bit_length()))


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)], names)


def _send_anchors(length: int, buckets: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        block = _Block(docs, length, buckets)
        times, several = block.anchors()
        rows = []
        for i in np.flatnonzero(np.diff(block.edges)).tolist():
            s, e = block.edges[i], block.edges[i + 1]
            rows.append((i, key[0].as_py(), pack_sorted(block.distinct[s:e] >> _key_shift(buckets)), np.minimum(times[s:e], 65535).astype("<u2").tobytes(), np.packbits(several[s:e]).tobytes()))
        return _table(rows, ["bucket", "block", "keys", "times", "several"], [pa.int32(), pa.int32(), *[pa.binary()] * 3])

    return run


def _shared(hot: int):
    """Per block, for the keys it sent: 0 if one document has the anchor, 1 if several do, 2 if very many occur."""

    def run(rows: pa.Table) -> pa.Table:
        sent = [unpack_sorted(x) for x in rows["keys"].to_pylist()]
        times = np.concatenate([np.frombuffer(x, "<u2") for x in rows["times"].to_pylist()]).astype(np.int64)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(rows["several"].to_pylist(), sent, strict=True)])
        every = np.concatenate(sent)
        order = np.argsort(every)
        v = every[order]
        start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        count = np.diff(np.append(start, len(v)))
        sums = np.add.reduceat(times[order], start)
        code = ((count > 1) | (np.maximum.reduceat(several[order], start) > 0)).astype(np.uint8)
        code[(code == 1) & (sums >= hot)] = 2
        out = np.empty(len(every), np.uint8)
        out[order] = np.repeat(code, count)
        ends = np.cumsum([len(x) for x in sent])
        return _table([(b, k, 1, out[e - len(x) : e].tobytes(), None, None) for b, k, x, e in zip(rows["block"].to_pylist(), rows["bucket"].to_pylist(), sent, ends.tolist(), strict=True)], MESSAGE_NAMES, MESSAGE_KINDS)

    return run


MESSAGE_NAMES = ["block", "bucket", "kind", "a", "b", "c"]
MESSAGE_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
MESSAGE_SCHEMA = "block int, bucket int, kind int, a binary, b binary, c binary"


def _codes(block: _Block, messages: pa.Table) -> np.ndarray:
    codes = np.zeros(len(block.distinct), np.uint8)
    for kind, bucket, a in zip(messages["kind"].to_pylist(), messages["bucket"].to_pylist(), messages["a"].to_pylist(), strict=True):
        if kind == 1:
            codes[block.edges[bucket] : block.edges[bucket + 1]] = np.frombuffer(a, np.uint8)
    return codes


def _send_units(length: int, buckets: int):
    def run(key: tuple, docs: pa.Table, messages: pa.Table) -> pa.Table:
        block = _Block(docs, length, buckets)
        *_, (starts, windows, keys, least, most, edges) = block.units(_codes(block, messages))
        rows = []
        for i in np.flatnonzero(np.diff(edges)).tolist():
            s, e = edges[i], edges[i + 1]
            sizes = windows[s:e] + length - 1
            at = np.repeat(starts[s:e] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            # the part of the bucket that a string belongs to: equal windows share it
            part = (keys[s:e] * U(buckets) >> U(56)).astype(np.uint8)
            rows.append((i, key[0].as_py(), block.b[at].tobytes(), windows[s:e].astype("<u2").tobytes(), part.tobytes(), least[s:e].astype("<i8").tobytes(), most[s:e].astype("<i8").tobytes()))
        return _table(rows, ["bucket", "block", "bytes", "windows", "part", "least", "most"], [pa.int32(), pa.int32(), *[pa.binary()] * 5])

    return run


def _expand(length: int):
    """Least owner of each window of the strings that blocks sent to a bucket, for those that a block can use."""

    def run(rows: pa.Table) -> pa.Table:
        def joined(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(rows[name].to_pylist()), kind)

        windows = joined("windows", "<u2").astype(np.int64)
        part, least, most = joined("part", "u1"), joined("least", "<i8"), joined("most", "<i8")
        counts = [len(x) for x in rows["part"].to_pylist()]
        b = joined("bytes", "u1")
        sizes = windows + length - 1
        begin = np.cumsum(sizes) - sizes
        first = np.cumsum(windows) - windows
        answer = np.empty(int(windows.sum()), np.int64)
        by_part = np.argsort(part, kind="stable")
        filled = np.cumsum(sizes[by_part])
        lo = 0
        while lo < len(by_part):  # whole parts, as many as fit
            hi = max(int(np.searchsorted(filled, (filled[lo - 1] if lo else 0) + TRANSFORM_BYTES)), lo + 1)
            hi = int(np.searchsorted(part[by_part], part[by_part[hi - 1]], side="right"))
            own = by_part[lo:hi]
            strings = _rows(b, begin[own], sizes[own], -(-int(sizes[own].max()) // 8) * 8)
            hashes = _hashes(strings, sizes[own])
            order, start = _distinct(strings, sizes[own], part[own], hashes)
            head = own[order[start]]
            owner = np.minimum.reduceat(least[own][order], start)
            at = np.repeat(begin[head] - (np.cumsum(sizes[head]) - sizes[head]), sizes[head]) + np.arange(sizes[head].sum())
            found = least_owner(b[at], sizes[head], owner, length)
            unit = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
            n = windows[own[order]]
            source = np.cumsum(windows[head]) - windows[head]
            steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            answer[np.repeat(first[own[order]], n) + steps] = found[np.repeat(source[unit], n) + steps]
            lo = hi
        out, at = [], 0
        string = np.repeat(np.arange(len(windows)), windows)
        for block, bucket, n in zip(rows["block"].to_pylist(), rows["bucket"].to_pylist(), counts, strict=True):
            s, e = (first[at], first[at + n - 1] + windows[at + n - 1]) if n else (0, 0)
            which, values = string[s:e] - at, answer[s:e]
            new = np.ones(len(which), bool)
            new[1:] = (which[1:] != which[:-1]) | (values[1:] != values[:-1])
            cut = np.flatnonzero(new)
            use = values[cut] < most[at : at + n][which[cut]]
            if use.any():
                run_of = np.diff(np.append(cut, len(which)))
                offset = cut - (first[at : at + n] - s)[which[cut]]
                out.append((block, bucket, 2, which[cut][use].astype("<u4").tobytes(), (offset[use] << 16 | run_of[use]).astype("<u4").tobytes(), values[cut][use].astype("<i8").tobytes()))
            at += n
        return _table(out, MESSAGE_NAMES, MESSAGE_KINDS)

    return run


def _remove(length: int, buckets: int, with_text: bool):
    def run(key: tuple, docs: pa.Table, messages: pa.Table) -> pa.Table:
        block = _Block(docs, length, buckets)
        starts, windows, owner, unit, (*_, edges) = block.units(_codes(block, messages))
        marked = np.zeros(len(block.b) + 1, bool)
        by_unit = np.argsort(unit, kind="stable")
        first = np.searchsorted(unit[by_unit], np.arange(len(windows) + 1))
        for kind, bucket, a, b, c in zip(*(messages[x].to_pylist() for x in ("kind", "bucket", "a", "b", "c")), strict=True):
            if kind != 2:
                continue
            which, runs, least = np.frombuffer(a, "<u4").astype(np.int64) + edges[bucket], np.frombuffer(b, "<u4").astype(np.int64), np.frombuffer(c, "<i8")
            times = first[which + 1] - first[which]
            row = np.repeat(np.arange(len(which)), times)
            occurrence = by_unit[np.repeat(first[which] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            hit = least[row] < owner[occurrence]
            row, occurrence = row[hit], occurrence[hit]
            many, at = runs[row] & 0xFFFF, starts[occurrence] + (runs[row] >> 16)
            marked[np.repeat(at - (np.cumsum(many) - many), many) + np.arange(many.sum())] = True
        n = len(block.b)
        seen = np.zeros(n + 1, np.int32)
        np.cumsum(marked[:-1], out=seen[1:])
        covered = seen[1:] > 0  # less what started too far before:
        covered[length - 1 :] = seen[length:] > seen[: max(0, n - length + 1)]
        begins = covered.copy()
        begins[1:] &= ~covered[:-1]
        texts = block.offsets[:-1][np.diff(block.offsets) > 0]
        begins[texts] = covered[texts]

        def per_text(flags: np.ndarray) -> np.ndarray:
            sums = np.zeros(n + 1, np.int32)
            np.cumsum(flags, out=sums[1:])
            return np.diff(sums[block.offsets]).astype(np.int64)

        sizes, removed, spans = np.diff(block.offsets), per_text(covered), per_text(begins)
        rest = block.b[~covered].tobytes()
        ends = np.cumsum(sizes - removed).tolist()
        kept = [rest[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        columns = [block.out_ids, pa.array(sizes), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns.append(pa.array(kept, pa.binary()))
            names.append("kept")
        return pa.table(columns, names)

    return run


def suffix_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 50, block_bytes: int = BLOCK_BYTES, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes, with with_text).

    A byte of a text (in UTF-8) goes if it is covered by a string of length bytes that also starts in a document with a
    smaller doc_id. Texts are dealt to blocks. Every window of length bytes has an anchor, which equal windows
    share; blocks first learn which anchors several documents have, then send the strings around those, each
    once, to the anchors' buckets. A bucket builds the Burrows-Wheeler transform of its strings and expands its
    intervals up to length; the least doc_id of each class of windows goes back to the blocks.

    Defined results: null text is empty; texts under length keep all; repeated rows of a doc_id never remove from
    each other; null doc_id counts as larger than all others (and equal to itself); an empty table gives an empty
    result; other columns are ignored. Hot passages: a block sends each string once, so a bucket gets one of a kind
    from each block; windows of anchors with very many occurrences are dealt by their own bytes.
    """
    blocks = block_count(docs, block_bytes, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("order"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks)).cast("int"))
    own = rows.groupBy("block")
    anchors = own.applyInArrow(_send_anchors(length, blocks), "bucket int, block int, keys binary, times binary, several binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared(hot), MESSAGE_SCHEMA)
    units = own.cogroup(shared.groupBy("block")).applyInArrow(_send_units(length, blocks), "bucket int, block int, bytes binary, windows binary, part binary, least binary, most binary")
    found = units.groupBy("bucket").applyInArrow(_expand(length), MESSAGE_SCHEMA)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return own.cogroup(shared.unionByName(found).groupBy("block")).applyInArrow(_remove(length, blocks, with_text), schema)
