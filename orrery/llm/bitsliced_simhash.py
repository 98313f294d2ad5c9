"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most r of 64 bits agree on all but r of r + 6 equal slices, so
each distinct fingerprint is posted once for every choice of r slices to leave out (28 lists of
48-bit keys at r = 2). No candidate is lost, and as a list's members differ only in the slices
left out, a list holds at most 2**16 distinct values whatever the data: copies share one
fingerprint, and fingerprints are made distinct before they are posted, so a group of copies is
one member. Within lists the comparison is bit-sliced: bit plane b holds bit b of every member,
one XOR of a plane with itself shifted by s compares all members s places apart, carry-save
counters (ones, twos, over) add the 64 planes for 64 lanes a word, and words whose lanes have
all passed the radius are abandoned. A list leaves its spanning forest, not its pairs.
Components come from alternating large-star and small-star rounds on those edges.

``near_duplicates`` links fingerprints. ``similar_groups`` links texts whose sets of word shingles have a Jaccard
similarity of 0.8 or more, at which 64-bit fingerprints are 10 bits apart on average and too far for slices to find. It uses
128-bit fingerprints and draws candidates from LISTS lists keyed by KEY_BITS bits of one half each; a pair that differs in 10 bits of
each half shares one with a probability of 0.99. Within lists the bit-sliced comparison goes up to WIDE bits, nearest pairs first, so a text is
tied to its nearest; the texts of these pairs are then compared by their sets, and only pairs that pass are links. So nothing is linked that is
not similar; a link is missed if no list has it, or if all paths of nearer fingerprints to it fail by their sets. Measured recall: README.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import bit_filter, byte_texts, content_of, external_id, internal_id, partitions, passing, prepared, release_memory, signed

BITS = 64
#: Shingles whose bits are counted at once; bounds memory on very long texts.
CHUNK = 1 << 15
#: similar_groups: lists, bits of a list's key, and the distances at which it links in turn.
LISTS, KEY_BITS, WIDE = 64, 14, (8, 18, 28, 34)
#: Members of a list that are compared as one; longer lists are compared chunk by chunk.
LIST_MEMBERS = 4_096
#: Members whose lists are compared side by side.
SIDE_BY_SIDE = 1 << 18


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of A-Z-lowered word shingles; 0 without words. A bit is set if over half the hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate(([0], ends[: len(words) - width])).tolist()
    last = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(first)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        h = np.fromiter((digest(whole[a:b], seed) for a, b in zip(first[i : i + CHUNK], last[i : i + CHUNK])), np.uint64, min(CHUNK, n - i))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did (internal id), fp (bigint), content (hash of the text) of every row, without a shuffle."""

    def body(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width, seed) for t in byte_texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"did": batch.column(0), "fp": signed(fps), "content": batch.column(2)})

    return docs.select(internal_id(id_col).alias("did"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("content")).mapInArrow(body, "did long, fp long, content long")


def masks(radius: int) -> list[int]:
    """For each choice of radius slices of radius + 6 to leave out, the bits that stay, as bigints."""
    edges = [round(i * BITS / (radius + 6)) for i in range(radius + 7)]
    slices = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]
    kept = [sum(slices) - sum(out) for out in combinations(slices, radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in kept]


def side_by_side(batches, members):
    """The lists of Arrow batches (members: their arrays, from a batch), some SIDE_BY_SIDE members at a time, long lists first, with their sizes."""
    held, size = [], 0

    def taken():
        held.sort(key=len, reverse=True)
        return np.concatenate(held), np.array([len(x) for x in held])

    for batch in batches:
        for part in members(batch):
            held.append(part)
            size += len(part)
            if size >= SIDE_BY_SIDE:
                yield taken()
                held, size = [], 0
    if held:
        yield taken()


def near_lanes(planes: np.ndarray, s: int, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Which of lanes (bit-packed) hold members i and i + s at a distance of at most radius. Planes end with s // 64 + 2 words of no member at least.

    Carry-save counters: a lane goes once its distance passes radius. Words without a lane left are dropped."""
    live = np.flatnonzero(lanes)
    out = np.zeros_like(lanes)
    left = lanes[live].copy()
    skip, bits = divmod(s, 64)
    low, high = np.uint64(bits), np.uint64(64 - bits)
    digits = radius.bit_length()
    exact = [(radius + 1) >> d & 1 for d in range(digits)]
    counters = [np.zeros(len(live), np.uint64) for _ in range(digits)]
    for b, plane in enumerate(planes):
        carry = plane.take(live + skip)
        if bits:
            carry >>= low
            carry |= plane.take(live + (skip + 1)) << high
        carry ^= plane.take(live)
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        left &= ~carry
        if b >= radius and any(exact):
            passed = left.copy()
            for d in range(digits):
                passed &= counters[d] if exact[d] else ~counters[d]
            left ^= passed
        if b % 8 == 7:
            stay = left != 0
            if not stay.any():
                return out
            if 2 * stay.sum() < len(live):
                live, left, counters = live[stay], left[stay], [c[stay] for c in counters]
    out[live] = left
    return out


def bit_planes(fps: np.ndarray, reach: int) -> np.ndarray:
    """Plane b holds bit b of every row of fps (rows of 64-bit words), lane by lane, with room behind for shifts up to reach."""
    n = len(fps)
    words = -(-n // 64) + reach // 64 + 2
    bits = np.zeros((fps.shape[1] * BITS, words * 64), np.uint8)
    bits[:, :n] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (least linked place) after places i and j are linked."""
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        for x in (a, b, i, j):
            np.minimum.at(label, x, low)
        while not np.array_equal(label, up := label[label]):
            label = up
        left = label[i] != label[j]
        i, j = i[left], j[left]
    return label


def near_pairs(planes: np.ndarray, sizes: np.ndarray, radius: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, i, j): for lists laid end to end (sizes sorted downwards), pairs of places within radius whose labels differed when their distance in
    the list came up, and labels with them. Place i is compared with i + s for every s within its list."""
    n = len(label)
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(n)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(1, int(sizes[0])):
        most = int(sizes[sizes > s].sum())  # lists long enough come first
        words = -(-most // 64)
        inside = np.zeros(words * 64, np.uint8)
        inside[:most] = (place[:most] + s < ends[:most]) & (label[:most] != label[np.minimum(place[:most] + s, n - 1)])
        if not inside.any():
            continue
        found = near_lanes(planes, s, np.packbits(inside, bitorder="little").view(np.uint64), radius)
        i = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
        if len(i):
            left.append(i)
            right.append(i + s)
            label = merge(label, i, i + s)
    return label, np.concatenate(left), np.concatenate(right)


def forest(fps: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """For lists of fingerprints laid end to end (sizes sorted downwards), the least linked place of each."""
    return near_pairs(bit_planes(fps.reshape(-1, 1), int(sizes[0])), sizes, radius, np.arange(len(fps)))[0]


def link_edges(distinct: DataFrame, radius: int) -> DataFrame:
    """u, v: edges that connect all distinct fingerprints (fp) within radius, as a forest per list."""
    choices = masks(radius)
    # fingerprints are few bytes, which adaptive plans put into few tasks; each is many rows from here on
    posted = distinct.repartition(partitions(distinct.sparkSession), F.xxhash64("fp")).select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in choices])).alias("list", "key"))
    lists = posted.groupBy("list", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def members(batch):
        column = batch.column(0)
        flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
        return (np.sort(flat[a:z]) for a, z in zip(offsets[:-1], offsets[1:]))

    def body(batches):
        for flat, sizes in side_by_side(batches, members):
            label = forest(flat.view(np.uint64), sizes, radius)
            i = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_pydict({"u": flat[label[i]], "v": flat[i]})
        release_memory()

    return lists.mapInArrow(body, "u long, v long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for the nodes of edges (u, v).

    Large-star then small-star until nothing changes; each round is checkpointed, so lineage stays
    short and a lost executor costs one round. Minima are combined before they are shuffled. The number of rounds grows with the logarithm of
    the longest chain; should rounds not be enough, an error is raised."""
    now = edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).where("hi != lo").distinct().checkpoint()
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        large = large.unionByName(least.where("m < hi").select("hi", F.col("m").alias("lo"))).distinct()
        lower = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lower, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo")
        now = small.unionByName(lower.select("hi", F.col("m").alias("lo"))).distinct().checkpoint()
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def components_of(docs: DataFrame, *, radius: int = 2, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, named): did, fp, content (hash of the text) of every row; fp, least, root (of its component) of every fingerprint."""
    prepared(docs.sparkSession)
    rows = fingerprints(docs, width=width, seed=seed, id_col=id_col, text_col=text_col).checkpoint()
    owners = rows.groupBy("fp").agg(F.min(external_id("did")).alias("least"))
    roots = components(link_edges(owners.select("fp"), radius))
    return rows, owners.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, radius: int = 2, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links) of every row.

    Null and empty texts have fingerprint zero and link like any other. A null id keeps its row;
    component_id is the least id that is not null, and null if there is none. Repeated rows come
    back as often as they came in. An empty table gives an empty result."""
    rows, named = components_of(docs, radius=radius, width=width, seed=seed, id_col=id_col, text_col=text_col)
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(groups, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(classes, "fp").select(external_id("did").alias("doc_id"), hexed.alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each component: the one of the least id, ids that are null last, then of the least text hash; same columns."""
    rows, named = components_of(docs, id_col=id_col, text_col=text_col, **settings)
    # the least row of each fingerprint first, combined before the shuffle
    first = rows.groupBy("fp").agg(F.min(F.struct(external_id("did").isNull().alias("none"), "did", "content")).alias("row"))
    kept = first.join(named, "fp").groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.did").alias("did__"), F.col("row.content").alias("content__"))
    return first_rows(docs, kept, id_col, text_col)


def first_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each of kept (did__, content__)."""
    one = Window.partitionBy("did__", "content__").orderBy("did__")  # the join leaves rows dealt and sorted by both
    key = F.xxhash64("did__", "content__")
    named = docs.withColumns({"did__": internal_id(id_col), "content__": content_of(text_col)})
    # most rows that go are copies; the filter spares them the shuffle
    rows = passing(named, key, bit_filter(kept, key)).join(kept, ["did__", "content__"], "left_semi")
    return rows.withColumn("row__", F.row_number().over(one)).where("row__ = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def shingles(text: bytes, width: int) -> list[bytes]:
    """The distinct word shingles of a text, A-Z lowered; a shorter text is one, a text without words none."""
    words = text.lower().split()
    if not words:
        return []
    width = min(width, len(words))
    return list({b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)})


def wide_fingerprint(text: bytes, width: int) -> tuple[int, int]:
    """The 128 bits that more than half of the distinct shingles' XXH3 hashes have, as two bigints."""
    distinct = shingles(text, width)
    ones = np.zeros(2 * BITS, np.int64)
    for i in range(0, len(distinct), CHUNK):
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct[i : i + CHUNK])), np.uint8).reshape(-1, 16)
        ones += np.unpackbits(h, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return tuple(np.packbits(2 * ones > len(distinct), bitorder="little").view(np.int64).tolist())


def similarity(a: bytes, b: bytes, width: int) -> float:
    """Jaccard similarity of two texts' shingles; of two texts without words 1."""
    x, y = set(shingles(a, width)), set(shingles(b, width))
    return len(x & y) / len(x | y) if x or y else 1.0


def list_masks() -> list[tuple[int, int]]:
    """(which half, mask as a bigint) of each list's key: KEY_BITS bits of one half, drawn with a fixed seed."""
    rng = np.random.default_rng(17)
    out = []
    for i in range(LISTS):
        m = sum(1 << int(b) for b in rng.choice(BITS, KEY_BITS, replace=False))
        out.append((i % 2, m - (1 << BITS) if m >> (BITS - 1) else m))
    return out


def candidate_pairs(prints: DataFrame) -> DataFrame:
    """u, v: pairs of contents whose fingerprints (content, hi, lo; each content once) meet in a list and are near, nearest first."""
    keys = [F.col(("hi", "lo")[half]).bitwiseAND(F.lit(m)) for half, m in list_masks()]
    posted = prints.repartition(partitions(prints.sparkSession), "content").select("content", "hi", "lo", F.posexplode(F.array(*keys)).alias("list", "key"))
    long = posted.groupBy("list", "key").agg(F.count("*").alias("n")).where(F.col("n") > LIST_MEMBERS).select("list", "key", F.ceil(F.col("n") / LIST_MEMBERS).cast("int").alias("chunks")).checkpoint()
    posted = posted.join(F.broadcast(long) if long.count() <= 100_000 else long, ["list", "key"], "left")
    # a long list is compared as pairs of chunks, each member with every chunk, so no task holds more than two chunks of it
    own = F.pmod(F.xxhash64("content", F.lit(5)), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.least(c, own) * F.col("chunks") + F.greatest(c, own))
    lists = posted.withColumn("part", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(others)))
    lists = lists.groupBy("list", "key", "part").agg(F.collect_list(F.struct("content", "hi", "lo")).alias("members")).where(F.size("members") > 1).select("members")

    def members(batch):
        column = batch.column(0)
        rows = np.stack([f.to_numpy() for f in column.flatten().flatten()], axis=1)
        offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
        return (rows[a:z][np.argsort(rows[a:z, 0])] for a, z in zip(offsets[:-1], offsets[1:]))

    def body(batches):
        for flat, sizes in side_by_side(batches, members):
            label, planes = np.arange(len(flat)), bit_planes(np.ascontiguousarray(flat[:, 1:]).view(np.uint64), int(sizes[0]))
            for radius in WIDE:
                label, i, j = near_pairs(planes, sizes, radius, label)
                yield pa.RecordBatch.from_pydict({"u": np.minimum(flat[i, 0], flat[j, 0]), "v": np.maximum(flat[i, 0], flat[j, 0])})
        release_memory()

    return lists.mapInArrow(body, "u long, v long").where("u != v").distinct()


def similar_groups(docs: DataFrame, *, width: int = 5, at_least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, named): did and content (hash of the text) of every row; content and root (of its group) of every content.

    Texts are linked if the Jaccard similarity of their sets of A-Z-lowered width-word shingles is at_least or more; a text of
    fewer words is one shingle, texts without words are linked to each other. Equal texts are one content.
    Groups are what links reach. Null texts are empty. An empty table gives empty results."""
    prepared(docs.sparkSession)

    def prints(batches):
        for batch in batches:
            both = [wide_fingerprint(t, width) for t in byte_texts(batch.column(2))]
            hi, lo = (np.array([b[i] for b in both], np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_pydict({"did": batch.column(0), "content": batch.column(1), "hi": hi, "lo": lo})

    texts = docs.select(internal_id(id_col).alias("did"), content_of(text_col).alias("content"), F.col(text_col).cast("string").alias("text"))
    rows = texts.mapInArrow(prints, "did long, content long, hi long, lo long").checkpoint()
    distinct = rows.groupBy("content").agg(F.min("hi").alias("hi"), F.min("lo").alias("lo"), F.min("did").alias("did")).checkpoint()
    pairs = candidate_pairs(distinct.select("content", "hi", "lo")).checkpoint()
    # the texts of the pairs, each once: of the least id that has it
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("content")).distinct().join(distinct.select("content", "did"), "content").checkpoint()
    some = passing(texts, F.xxhash64("did", "content"), bit_filter(wanted, F.xxhash64("did", "content"))).join(wanted, ["did", "content"], "left_semi").groupBy("content").agg(F.first("text").alias("text"))
    both = pairs.join(some.select(F.col("content").alias("u"), F.col("text").alias("a")), "u").join(some.select(F.col("content").alias("v"), F.col("text").alias("b")), "v")

    def linked(batches):
        for batch in batches:
            passed = [similarity(a, b, width) >= at_least for a, b in zip(byte_texts(batch.column(2)), byte_texts(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(passed, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    links = both.select("u", "v", "a", "b").mapInArrow(linked, "u long, v long")
    roots = components(links)
    named = distinct.select("content").join(roots, F.col("content") == F.col("node"), "left").select("content", F.coalesce("root", "content").alias("root"))
    return rows.select("did", "content"), named


def one_per_similar_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each of similar_groups: the one of the least id, ids that are null last, then of the least text hash; same columns."""
    rows, named = similar_groups(docs, id_col=id_col, text_col=text_col, **settings)
    first = rows.groupBy("content").agg(F.min(F.struct(external_id("did").isNull().alias("none"), "did", "content")).alias("row"))
    kept = first.join(named, "content").groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.did").alias("did__"), F.col("row.content").alias("content__"))
    return first_rows(docs, kept, id_col, text_col)
