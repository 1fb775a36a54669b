"""N-gram Jaccard join by token-combination prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .support import block_count, block_of, lean, stage
from .textblocks import M1, M4, U, distinct_in_texts, flat, mix, pack_sorted, shingles, unpack_sorted, word_hashes, words

#: Bytes of text in a block, which is what one task holds at once.
BLOCK_BYTES = 6 << 20
#: Bytes of text whose words are hashed at once.
PART_BYTES = 1 << 19
#: Token classes: from so many texts on, tokens are indexed by combinations of so many.
CLASSES = ((0, 1), (17, 2), (4097, 3))
#: Tokens of a frequent class that fall into one subclass, about; combinations are formed inside subclasses.
SUBCLASS = {2: 2.0, 3: 3.0}
#: From so many members on a posting is hot (or from the 2 ** -16th part of all rows on, so that hot ones are few), and over how many tasks its rows go.
HOT_POSTING, SALTS = 256, 32
#: Postings up to this length are compared pair by pair, longer ones leader by leader. Where all postings up to a
#: greater length have no more pairs than there are rows in the first round's postings, that length counts.
SMALL_POSTING = 8
#: By how much that number of pairs grows with each further round, so that a group of texts of which no two link ends after
#: few rounds, not after one for each text.
ROOM_GROWTH = 4


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, in a row, and how many each has; a few texts at a time."""
    b, offsets = flat(column)
    values, sizes, lo = [], [], 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PART_BYTES, side="right")) - 1)
        part, at = b[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, _, counts = words(part, at)
        v, n = distinct_in_texts(*shingles(word_hashes(part, starts), counts, k))
        values.append(v), sizes.append(n)
        lo = hi
    return (np.concatenate(values), np.concatenate(sizes)) if values else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _digests_of(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(sizes)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values * m), dtype=np.uint64)]) for m in (M1, M4)]
    return [s[ends] - s[ends - sizes] for s in sums]


def _digests(k: int):
    """Per text: size of its shingle set, and 128 bits that are equal for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = _sets(batch.column("text"), k)
            one, two = _digests_of(values, sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["doc_id", "n_shingles", "d1", "d2"])

    return run


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


class _Block:
    """The representatives' shingle sets of one block of texts, and the distinct tokens of the block by bucket."""

    def __init__(self, docs: pa.Table, reps: list[tuple[int, int, int]], k: int, buckets: int):
        rows: dict[int, list[int]] = {d: [] for d, _, _ in reps}
        for i, d in enumerate(docs["doc_id"].to_pylist()):
            if d in rows:
                rows[d].append(i)
        found = {}
        for d, d1, node in reps:
            at = rows[d]
            if len(at) > 1:  # rows that share a doc_id are told apart by their sets
                some = _digests_of(*_sets(docs["text"].combine_chunks().take(pa.array(at, pa.int64())), k))[0].view(np.int64).tolist()
                at = [i for i, x in zip(at, some, strict=True) if x == d1]
            found[at[0]] = node
        keep = sorted(found)
        self.ids = [found[i] for i in keep]
        self.values, self.sizes = _sets(docs["text"].combine_chunks().take(pa.array(keep, pa.int64())), k)
        self.order = np.argsort(self.values)
        v = self.values[self.order]
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        self.first = np.flatnonzero(new)
        self.tokens = v[self.first]
        self.texts = np.diff(np.append(self.first, len(v)))
        self.edges = np.searchsorted(_bucket(self.tokens, buckets), np.arange(buckets + 1))

    def spread(self, per_token: np.ndarray) -> np.ndarray:
        """What is known of each distinct token, for each token of each text."""
        out = np.empty(len(self.values), per_token.dtype)
        out[self.order] = np.repeat(per_token, self.texts)
        return out


def _keys(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Tokens of a bucket (of ascending hashes) as shorter ascending keys, of more bits the more buckets there are.
    Two tokens with one key count together in every block, which keeps the order of tokens the same for all."""
    return tokens >> U(max(0, 24 - buckets.bit_length()))


def _send(k: int, buckets: int):
    """A block's tokens, as one packed row for each bucket of hashes."""

    def run(key: tuple, docs: pa.Table, reps: pa.Table) -> pa.Table:
        block = _Block(docs, list(zip(*(reps[c].to_pylist() for c in ("doc_id", "d1", "node")), strict=True)), k, buckets)
        rows = []
        for i in np.flatnonzero(np.diff(block.edges)).tolist():
            s, e = block.edges[i], block.edges[i + 1]
            rows.append((i, key[0].as_py(), pack_sorted(_keys(block.tokens[s:e], buckets)), np.minimum(block.texts[s:e], 255).astype(np.uint8).tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "tokens", "texts"])

    return run


def _frequencies(rows: pa.Table) -> pa.Table:
    """For each block that sent tokens of this bucket: the logarithmic class of how many texts have each."""
    sent = [unpack_sorted(x) for x in rows["tokens"].to_pylist()]
    texts = [np.frombuffer(x, np.uint8) for x in rows["texts"].to_pylist()]
    every = np.concatenate(sent)
    order = np.argsort(every)
    v = every[order]
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    sums = np.add.reduceat(np.concatenate(texts).astype(np.int64)[order], start)
    # 0 for tokens of one text, else half-octaves of the count and 1
    level = np.where(sums < 2, 0, 1 + np.floor(2 * np.log2(np.maximum(sums, 2)) - 1e-9)).astype(np.uint8)
    out = np.empty(len(every), np.uint8)
    out[order] = np.repeat(level, np.diff(np.append(start, len(v))))
    ends = np.cumsum([len(x) for x in sent])
    return pa.table([rows["block"], rows["bucket"], pa.array([out[e - len(x) : e].tobytes() for x, e in zip(sent, ends.tolist(), strict=True)], pa.binary())], ["block", "bucket", "levels"])


def _least_texts(level: int) -> float:
    return 2 ** ((level - 1) / 2) if level else 1


#: For each level of frequency, how many tokens a combination has.
COMBINED = [max(c for least, c in CLASSES if _least_texts(level) >= least or least == 0) for level in range(256)]


def size_class(n: int, share: int) -> int:
    """Sizes of linked sets differ by the factor 100 / share at most, so by one class at most."""
    return int(math.log(n) / math.log(100 / share) + 1e-9)


def signatures(tokens: list[int], levels: list[int], share: int) -> list[int]:
    """What two sets with share % of their union in common always have one of in common.

    Tokens are ordered from rare to frequent. A set of n misses e = n - ceil(share n / 100) tokens of its partner
    at most, so e + 1 tokens of its prefix are enough for one common token. A subclass of k-token combinations
    may hold k - 1 common tokens without a common combination, so the prefix is extended by k - 1 (or by as many
    tokens as it holds) for each subclass that it touches. Subclasses depend on the class of size; a set is
    indexed under its own and the next one.
    """
    n = len(tokens)
    missed = n - -(-share * n // 100)
    order = sorted(range(n), key=lambda i: (levels[i], tokens[i]))
    out = []
    for size in (own := size_class(n, share), own + 1):
        low, high = math.ceil((100 / share) ** (size - 1)), math.ceil((100 / share) ** (size + 1))
        most = high - -(-share * high // 100) + 1
        parts = {k: max(1, math.ceil(most / per)) for k, per in SUBCLASS.items()}
        combined = most + sum((k - 1) * p for k, p in parts.items()) <= low - 1
        held: dict[tuple[int, int], list[int]] = {}
        free = 0
        for taken, i in enumerate(order):
            if taken - free > missed:
                break
            k = COMBINED[levels[i]] if combined else 1
            if k == 1:
                if levels[i]:
                    out.append(hash((size, 1, tokens[i])))
                continue
            group = held.setdefault((k, tokens[i] % parts[k]), [])
            group.append(tokens[i])
            free += len(group) < k
        for (k, part), group in held.items():
            out += [hash((size, k, part, *sorted(c))) for c in combinations(group, k)]
    return out


def _candidates(k: int, buckets: int, share: int):
    """Texts of a block that can have a partner, with their sets and signatures."""

    def run(key: tuple, docs: pa.Table, messages: pa.Table) -> pa.Table:
        kind = messages["kind"].to_pylist()
        reps = [x[:3] for x in zip(*(messages[c].to_pylist() for c in ("doc_id", "d1", "node")), kind, strict=True) if x[3] == 0]
        block = _Block(docs, reps, k, buckets)
        levels = np.zeros(len(block.tokens), np.uint8)
        for what, bucket, data in zip(kind, messages["bucket"].to_pylist(), messages["levels"].to_pylist(), strict=True):
            if what == 1:
                levels[block.edges[bucket] : block.edges[bucket + 1]] = np.frombuffer(data, np.uint8)
        level = block.spread(levels)
        ends = np.cumsum(block.sizes)
        alone = np.concatenate([[0], np.cumsum(level == 0)])
        alone = alone[ends] - alone[ends - block.sizes]
        missed = block.sizes - -(-share * block.sizes // 100)
        rows = []
        for i in np.flatnonzero((alone <= missed) & (block.sizes > 0)).tolist():
            s, e = ends[i] - block.sizes[i], ends[i]
            own, rank = block.values[s:e], level[s:e]
            found = signatures(own.tolist(), rank.tolist(), share)
            if found:
                rows.append((block.ids[i], len(own), int(alone[i]), -float(rank.mean()), own[rank > 0].view(np.int64), found))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        long = pa.list_(pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), long, long), strict=True)], ["doc_id", "n", "alone", "rare", "tokens", "signatures"])

    return run


def _compared(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Adds to pairs (a, b) of doc_id: the sizes na and nb, how many tokens are common, whether they link, and what
    a has of shared tokens besides b (rest). Ends of many pairs are dealt over several tasks."""
    pairs = stage(pairs, "pairs")
    one = sets.select(F.col("doc_id").alias("ia"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("doc_id").alias("ib"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both, rows = pairs, pairs.count()
    for end, other, table in (("a", "b", one), ("b", "a", two)):
        sized = pairs.groupBy(end).agg(F.count("*").alias("members"))
        both = _Salted(sized, rows, end, other).join(both, table, f"i{end}")
    both = both.withColumn("rest", F.array_except("ta", "tb")).withColumn("common", F.size("ta") - F.size("rest"))
    return both.select("a", "b", "na", "nb", "common", (100 * F.col("common") >= share * (F.col("na") + F.col("nb") - F.col("common"))).alias("linked"), "rest")


class _Salted:
    """Joins rows by a key of which some values are hot with a table that has each value once, such that no task gets more
    than a part of a hot value: its rows carry a salt (of the column other), and the table's row is repeated for each. sized has
    members, the number of rows, for each key. Hot values are few, by their definition, and are broadcast."""

    def __init__(self, sized: DataFrame, rows: int, key: str = "s", other: str = "doc_id"):
        self.key, self.other = key, other
        self.hot = sized.filter(F.col("members") >= max(HOT_POSTING, rows >> 16)).select(F.col(key).alias("hot"))

    def join(self, rows: DataFrame, table: DataFrame, to: str = "t", how: str = "inner") -> DataFrame:
        salt = F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(self.other), F.lit(SALTS)).cast("int"))
        rows = rows.join(F.broadcast(self.hot), F.col(self.key) == F.col("hot"), "left").withColumn("salt", salt).drop("hot")
        salts = F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("table_salt")
        keys = table.join(F.broadcast(self.hot), F.col(to) == F.col("hot"), "left").select(*table.columns, salts)
        return rows.join(keys, (F.col(self.key) == F.col(to)) & (F.col("salt") == F.col("table_salt")), how).drop("salt", "table_salt")


def _reach(share: int):
    """Two texts can link only if share times the size of each is within the reach of the other: tokens that no other text
    has are not common."""
    return (100 + share) * (F.col("n") - F.col("alone")) - share * F.col("n")


def _sized(postings: DataFrame, share: int) -> DataFrame:
    """How many members each posting has (two or more), sums that are equal for equal members, the least size and the greatest reach."""
    h = lambda *seed: F.sum(F.xxhash64("doc_id", *map(F.lit, seed)).cast("decimal(38,0)"))
    return postings.groupBy("s").agg(F.count("*").alias("members"), h().alias("h1"), h(1).alias("h2"), F.min("n").alias("least"), F.max(_reach(share)).alias("most")).filter("members > 1")


def _one_of_each(postings: DataFrame, share: int) -> DataFrame:
    """Postings of two members or more, one of those with the same members, without members that can link with none of the others."""
    sized = stage(_sized(postings, share), "posting-sizes")
    kept = sized.groupBy("members", "h1", "h2").agg(F.min("s").alias("t"), F.min("least").alias("least"), F.max("most").alias("most")).select("t", "members", "least", "most")
    joined = _Salted(sized, sized.agg(F.sum("members")).first()[0] or 0).join(postings, kept)
    return joined.filter((share * F.col("least") <= _reach(share)) & (share * F.col("n") <= F.col("most"))).select("s", "doc_id", "n", "alone", "rare", "component", "members")


def _small(postings: DataFrame, room: int | None) -> tuple[int, int]:
    """Up to which length postings are compared pair by pair, and how many rows all have."""
    sizes = postings.groupBy(F.ceil(F.log2("members")).cast("int").alias("power")).agg(F.sum("members").alias("pairs"), F.count("*").alias("n")).orderBy("power").collect()
    rows = sum(r["n"] for r in sizes)
    most, used = SMALL_POSTING, 0
    for r in sizes:
        used += r["pairs"]
        if used <= (rows if room is None else room):
            most = max(most, 1 << r["power"])
    return most, rows


def _links(found: DataFrame, share: int) -> DataFrame:
    """Labels (node, component) of all texts with links.

    A small posting is compared pair by pair, where alone (tokens that no other text has) lets a pair be close
    enough. A longer one is compared with one leader, the member whose tokens are the most frequent ones on average: of
    edited copies of a text that is the least edited one, outside which the others have little but their own edits. Let x not link
    with its leader l, and y be another member. Without a shared token outside l, what x and y have in common
    is part of l, so that y links with x only if it is smaller than l and enough of l is in both: these pairs are compared.
    Any other y shares a token outside l with x, so both meet again in the posting of l and that token. So each
    round ends with shorter postings, of which only those that span two components matter, and the rounds
    end when no leader has been compared with anything new. Texts of which no two link leave one leader a round behind, so what
    is compared pair by pair grows by ROOM_GROWTH with each round.
    """
    sets = found.select("doc_id", "n", "tokens")
    able = found.select(F.col("doc_id").alias("member"), "n", "alone", "rare")
    postings = found.select("doc_id", "n", "alone", "rare", F.col("doc_id").alias("component"), F.explode(F.array_distinct("signatures")).alias("s"))
    known = labels = close = room = None
    while True:
        postings = stage(_one_of_each(postings, share), "postings")
        length, rows = _small(postings, room)
        room = ROOM_GROWTH * (rows if room is None else room)
        common = F.least(F.col("n") - F.col("alone"), F.col("m") - F.col("lone"))
        possible = 100 * common >= share * (F.col("n") + F.col("m") - common)
        small = postings.filter(F.col("members") <= length)
        other = small.select(F.col("s").alias("t"), F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("alone").alias("lone"), F.col("component").alias("c"))
        if length < HOT_POSTING:
            met = small.join(other, F.col("s") == F.col("t"))
        else:
            met = _Salted(small.groupBy("s").agg(F.first("members").alias("members")), rows).join(small, other)
        pairs = met.filter((F.col("doc_id") < F.col("b")) & (F.col("component") != F.col("c")) & possible).select(F.col("doc_id").alias("a"), "b")
        pairs = (pairs if close is None else pairs.unionByName(close)).distinct()
        large = postings.filter(F.col("members") > length)
        leaders = large.groupBy(F.col("s").alias("t")).agg(F.min(F.struct("rare", "doc_id")).alias("l")).select("t", F.col("l.doc_id").alias("b"))
        salted = _Salted(large.groupBy("s").agg(F.first("members").alias("members")), rows)
        led = salted.join(large, leaders).filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
        if known is not None:
            led = led.join(known.select("a", "b"), ["a", "b"], "left_anti")
        led = stage(_compared(led, sets, share), "led")
        links = _compared(pairs, sets, share).filter("linked").select("a", "b").unionByName(led.filter("linked").select("a", "b"))
        if labels is not None:
            links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = connected_components(links)
        if led.isEmpty():
            return labels
        # Leaders with new members that are in another component than themselves.
        named = lambda column, as_: labels.select(F.col("node").alias(column), F.col("component").alias(as_))  # noqa: E731, B023
        known = led if known is None else known.unionByName(led)
        fresh = led.select(F.col("b").alias("leader"), F.lit(True).alias("fresh")).distinct()
        leaders = known.groupBy(F.col("b").alias("leader")).agg(F.count("*").alias("members")).join(fresh, "leader", "left")
        leaders = stage(leaders.join(named("leader", "cb"), "leader", "left").withColumn("cb", F.coalesce("cb", "leader")), "leaders")
        salted = _Salted(leaders.select(F.col("leader").alias("b"), "members"), leaders.agg(F.sum("members")).first()[0], "b", "a")
        mine = salted.join(known, leaders.filter("fresh").select("leader", "cb"), "leader").drop("leader").join(named("a", "ca"), "a", "left")
        mine = stage(mine.withColumn("ca", F.coalesce("ca", "a")), "led-again")
        split = mine.filter("ca <> cb").select(F.col("b").alias("leader")).distinct()
        mine = stage(salted.join(mine, split, "leader", "left_semi"), "led-open")
        # Members that are smaller than the leader, against those that do not link with it.
        less = mine.filter("na < nb").select(F.col("a").alias("y"), F.col("b").alias("l"), F.col("na").alias("ny"), F.col("common").alias("cy"), F.col("ca").alias("component"))
        both = F.least("common", "cy")
        close = salted.join(mine.filter("not linked"), less, "l").filter((F.col("ca") != F.col("component")) & (100 * both >= share * (F.col("na") + F.col("ny") - both)))
        close = stage(close.select(F.least("a", "y").alias("a"), F.greatest("a", "y").alias("b")).distinct(), "close")
        again = mine.select(F.col("a").alias("doc_id"), "ca", F.col("b").alias("leader"), F.explode("rest").alias("token")).withColumn("s", F.xxhash64("leader", "token"))
        spans = stage(again.groupBy("s").agg(F.min("ca").alias("c1"), F.max("ca").alias("c2"), F.count("*").alias("members")).filter("c1 <> c2").select("s", "members"), "spans")
        salted = _Salted(spans, spans.agg(F.sum("members")).first()[0] or 0)
        postings = salted.join(again, spans.select(F.col("s").alias("t")), how="left_semi").select("s", F.col("doc_id").alias("member"), F.col("ca").alias("component")).distinct()
        postings = postings.join(able, "member").select("s", F.col("member").alias("doc_id"), "n", "alone", "rare", "component")


def ngram_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words_each: int = 5, share: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when share % of the union of their sets of words_each-word shingles is common to both;
    component_id is the smallest doc_id reachable by links. Tokens are 64-bit hashes of shingles. Documents with
    the same set are one class, of which the smallest doc_id goes on; others are linked with it. Rows that share a doc_id
    are documents of their own, each with the component of its set.

    Defined results: null, empty and blank texts have no shingles and are linked with nothing; fewer words than
    words_each make one shingle; repeated rows have the same component and stay as rows, null doc_id have
    a null component; an empty table gives an empty result; other columns are ignored.

    Texts are dealt to blocks by hash of doc_id, so no key is hot; long postings are dealt over SALTS tasks. Frequencies are counted by exchanging packed
    hashes of each block; only texts that can have a partner go on.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sized = stage(rows.mapInArrow(lean(_digests(words_each)), "doc_id long, n_shingles long, d1 long, d2 long"), "shingle-digests")
    real = sized.filter("n_shingles > 0 and doc_id is not null")
    # A class goes by the doc_id of its representative, or by a hash where two classes share one.
    classes = real.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = stage(classes, "shingle-classes")
    shared = stage(classes.groupBy(F.col("rep").alias("twice")).agg(F.count("*").alias("n")).filter("n > 1").select("twice"), "shared-reps")
    unique = shared.isEmpty()
    if unique:
        classes = classes.withColumn("node", F.col("rep"))
    else:
        classes = classes.join(shared, F.col("rep") == F.col("twice"), "left").withColumn("node", F.when(F.col("twice").isNull(), F.col("rep")).otherwise(F.xxhash64("rep", "d1", "d2"))).drop("twice")
    blocks = buckets = block_count(docs, block_bytes, text)
    reps = stage(classes.select(F.col("rep").alias("doc_id"), "d1", "node").withColumn("block", block_of("doc_id", blocks)), "shingle-reps")
    texts = rows.withColumn("block", block_of("doc_id", blocks)).filter("doc_id is not null")
    sent = texts.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(lean(_send(words_each, buckets)), "bucket int, block int, tokens binary, texts binary")
    levels = sent.groupBy("bucket").applyInArrow(lean(_frequencies), "block int, bucket int, levels binary")
    messages = reps.select("block", F.lit(0).alias("kind"), "doc_id", "d1", "node", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("levels")).unionByName(levels.select("block", F.lit(1).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("doc_id", "d1", "node")), "bucket", "levels"))
    found = texts.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(lean(_candidates(words_each, buckets, share)), "doc_id long, n long, alone long, rare double, tokens array<long>, signatures array<long>")
    found = stage(found, "join-candidates")
    links = _links(found, share).withColumnRenamed("node", "linked")
    named = classes.join(links, F.col("node") == F.col("linked"), "left").withColumn("component", F.coalesce("component", "node"))
    if not unique:  # the smallest doc_id of a component is not its label
        labels = named.groupBy(F.col("component").alias("label")).agg(F.min("rep").alias("least"))
        named = named.join(labels, F.col("component") == F.col("label")).withColumn("component", F.col("least"))
    # Classes of one row with no link are their own component; only the others are joined.
    named = named.filter("copies > 1 or component <> rep").select(F.col("n_shingles").alias("n_"), F.col("d1").alias("d1_"), F.col("d2").alias("d2_"), "component")
    same = (F.col("n_shingles") == F.col("n_")) & (F.col("d1") == F.col("d1_")) & (F.col("d2") == F.col("d2_")) & F.col("doc_id").isNotNull()
    return sized.join(named, same, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
