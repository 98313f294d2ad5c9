"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A parse reads a text from left to right. Where the 20-word window at hand is in the index of the reference, its earliest
place there is the anchor: the words are compared one by one from the anchor on, and the factor is as long as they agree.
The windows that straddle the factor's end are looked up themselves, and the parse goes on with the first of them that is found, or
behind the factor. A factor has 20 words or more, and all its windows start earlier at its source, so factors cover just the repeated windows.

1. Each task cuts its documents into reference blocks of a bounded number of words, indexes each block and factors the block's
   documents against it. What a block holds twice is settled here, and only first occurrences leave the task, so a
   passage in a third of all documents leaves one row for each block.
2. What is left is dealt to the reference blocks of the whole corpus. The address of a
   window is its least 8-word hash (a minimizer): equal windows meet in one reference block, and
   windows in a row mostly share an address, so they travel as one row, a stretch. Each reference block is
   its stretches in (document, position) order; they are parsed against it the same way, window by window.
3. The factors of a document become spans, and words under a span are removed.

A count beforehand finds the number of stretches, which sets the number of reference blocks, and the addresses that have more
than one in HOT of all stretches, at most HOT of them: their windows are dealt one by one, by their own hash, so that a
common phrase in many contexts does not fill one block.

A window is removed if its words also start earlier (smaller id, or the same document further
left). Words are 64-bit hashes, compared one by one in step 1; in step 2 a window is one 64-bit hash, compared within a block. Judged on the input.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import byte_texts, external_id, gram_hashes, hash_words, internal_id, mixed, partitions, prepared, signed

#: Words of a reference block within a task; bounds the memory of step 1.
BLOCK_WORDS = 1_500_000
#: Words of an address.
ADDRESS = 8
#: Stretches of a reference block in step 2.
BLOCK_STRETCHES = 16_384
#: An address with more than one in so many of all stretches is split.
HOT = 1 << 16
#: Stretches of an address in a task's block from which on the count beforehand knows it.
SEEN = 8

ROWS = "address long, did long, sub long, start int, windows binary, stop int, src long, src_start int"
FACTORS = "did long, sub long, start int, stop int, src long, src_start int"


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each width entries in a row."""
    n, size = len(a) - width + 1, 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[:n], a[width - size : width - size + n])


def first_places(values: np.ndarray) -> np.ndarray:
    """For each entry the place of the first equal one."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(values), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))]
    return out


def agreement(symbols: np.ndarray, a: int, b: int, most: int) -> int:
    """How many symbols from a on equal those from b on, at most most."""
    done, size = 0, 32
    while done < most:
        size = min(size, most - done)
        differ = symbols[a + done : a + done + size] != symbols[b + done : b + done + size]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, size = done + size, size * 4
    return done


def parse(symbols: np.ndarray, ends: np.ndarray, at: np.ndarray, anchor: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, source) of the factors of the stretches that symbols are.

    ends: the end of each place's stretch; at: the places, ascending, whose window of width symbols is indexed at anchor, further left."""
    out: list[tuple[int, int, int]] = []
    places, anchors = at.tolist(), anchor.tolist()
    i, n = 0, len(places)
    while i < n:
        a, b = places[i], anchors[i]
        length = agreement(symbols, a, b, int(min(ends[a] - a, ends[b] - b)))
        if length < width:  # equal hashes of different words
            i += 1
            continue
        out.append((a, length, b))
        i = bisect_left(places, a + length - width + 1, i + 1)  # the first window over the factor's end
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def factors(symbols, ends, at, anchor, doc, pos, width: int, words: int) -> dict:
    """parse's factors as columns of FACTORS with document numbers; a window of width symbols is words words."""
    place, length, source = parse(symbols, ends, at, anchor, width)
    start = pos[place]
    return {"did": doc[place], "start": start.astype(np.int32), "stop": (start + length - width + words).astype(np.int32), "src": doc[source], "src_start": pos[source].astype(np.int32)}


def named(found: dict, did: np.ndarray, sub: np.ndarray) -> dict:
    """Factors of document numbers as factors of ids."""
    return {"did": did[found["did"]], "sub": sub[found["did"]], **{k: found[k] for k in ("start", "stop")}, "src": did[found["src"]], "src_start": found["src_start"]}


def packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Bytes of the runs of values that begin at at."""
    ends = np.append(at, len(values)).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def windows_of(docs: list[np.ndarray], width: int) -> tuple[np.ndarray, ...]:
    """flat (the words of all documents), begin (of each document), and of each window: doc, pos, address."""
    flat = np.concatenate(docs)
    sizes = np.array([len(w) for w in docs])
    begin = np.cumsum(sizes) - sizes
    starts = sizes - width + 1
    doc = np.repeat(np.arange(len(docs)), starts)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts)
    size = min(ADDRESS, width)
    return flat, begin, doc, pos, signed(sliding_min(gram_hashes(flat, size), width - size + 1)[begin[doc] + pos])


def stretches(doc: np.ndarray, pos: np.ndarray, address: np.ndarray) -> np.ndarray:
    """Where runs of windows in a row with one address begin."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (address[1:] != address[:-1])
    return np.flatnonzero(new)


def block_census(block: list[np.ndarray], width: int) -> pa.RecordBatch:
    """Stretches of the addresses that have SEEN or more, and (under null) of all."""
    docs = [w for w in block if len(w) >= width]
    address, n = np.zeros(0, np.int64), 0
    if docs:
        _, _, doc, pos, address = windows_of(docs, width)
        address, counts = np.unique(address[stretches(doc, pos, address)], return_counts=True)
        n, address, counts = counts.sum(), address[counts >= SEEN], counts[counts >= SEEN]
    return pa.RecordBatch.from_pydict({"address": pa.array([None, *address.tolist()], pa.int64()), "n": pa.array([n, *(counts.tolist() if len(address) else [])], pa.int64())})


def block_rows(block: list[tuple[int, int, np.ndarray]], width: int, hot: np.ndarray) -> pa.RecordBatch:
    """Factors within the block, and the windows that the block has first, stretch by stretch."""
    ids = {}
    for did, sub, words in block:
        if len(words) >= width:
            ids.setdefault((did, sub), words)
    docs = sorted(ids.items())
    schema = pa.schema([("address", pa.int64()), ("did", pa.int64()), ("sub", pa.int64()), ("start", pa.int32()), ("windows", pa.binary()), ("stop", pa.int32()), ("src", pa.int64()), ("src_start", pa.int32())])
    if not docs:
        return pa.RecordBatch.from_pylist([], schema)
    flat, begin, doc, pos, address = windows_of([w for _, w in docs], width)
    place = begin[doc] + pos
    window = gram_hashes(flat, width)[place]
    ids, subs = (np.array([k[i] for k, _ in docs], np.int64) for i in (0, 1))
    first = first_places(window)
    again = np.flatnonzero(first != np.arange(len(first)))
    whose = np.repeat(np.arange(len(docs)), [len(w) for _, w in docs])
    found = factors(flat, np.append(begin[1:], len(flat))[whose], place[again], place[first[again]], whose, np.arange(len(flat)) - begin[whose], width, width)
    own = named(found, ids, subs)
    n_own = len(own["did"])
    kept = np.flatnonzero(first == np.arange(len(first)))
    window, doc, pos, address = window[kept], doc[kept], pos[kept], address[kept]
    if len(hot):
        address = np.where(np.isin(address, hot), signed(window), address)
    at = stretches(doc, pos, address)
    n = len(at)
    none = pa.nulls
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([address[at], signed(mixed(own["did"].view(np.uint64)))])),
            pa.array(np.concatenate([ids[doc[at]], own["did"]])),
            pa.array(np.concatenate([subs[doc[at]], own["sub"]])),
            pa.array(np.concatenate([pos[at].astype(np.int32), own["start"]])),
            pa.concat_arrays([packed(window, at), none(n_own, pa.binary())]),
            pa.concat_arrays([none(n, pa.int32()), pa.array(own["stop"])]),
            pa.concat_arrays([none(n, pa.int64()), pa.array(own["src"])]),
            pa.concat_arrays([none(n, pa.int32()), pa.array(own["src_start"])]),
        ],
        schema=schema,
    )


def reference_block(table: pa.Table, width: int) -> pa.Table:
    """Factors of a reference block's stretches against the block, besides those found before."""
    names = ["did", "sub", "start", "stop", "src", "src_start"]
    done = table.filter(pc.is_valid(table["stop"])).select(names)
    rows = table.filter(pc.is_valid(table["windows"])).select(["did", "sub", "start", "windows"]).sort_by([("did", "ascending"), ("sub", "ascending"), ("start", "ascending")])
    if not rows.num_rows:
        return done
    lists = rows["windows"].combine_chunks()
    window = np.frombuffer(b"".join(lists.to_pylist()), np.uint64)
    sizes = pc.binary_length(lists).to_numpy() // 8
    ids, subs = rows["did"].to_numpy(), rows["sub"].to_numpy()
    new = np.append(False, (ids[1:] != ids[:-1]) | (subs[1:] != subs[:-1]))
    ids, subs = (x[np.append(0, np.flatnonzero(new))] for x in (ids, subs))
    doc = np.repeat(np.cumsum(new), sizes)
    pos = np.repeat(rows["start"].to_numpy().astype(np.int64) - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(window))
    first = first_places(window)
    again = np.flatnonzero((doc[first] != doc) | (pos[first] != pos))
    at = stretches(doc, pos, doc)
    ends = np.repeat(np.append(at[1:], len(doc)), np.diff(np.append(at, len(doc))))
    found = named(factors(window, ends, again, first[again], doc, pos, 1, width), ids, subs)
    return pa.concat_tables([done, pa.table(found, schema=done.schema)])


def sub_keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did, sub, text: sub tells the different texts of an id apart. It is 0 but for ids (by buckets, at most 2**20 rows broadcast) that have some."""
    rows = docs.select(internal_id(id_col).alias("did"), F.col(text_col).cast("string").alias("text"))
    content, bucket = F.xxhash64(F.coalesce("text", F.lit(""))), F.pmod(F.xxhash64("did"), F.lit(1 << 20))
    various = rows.select("did", content.alias("c")).groupBy("did").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select(bucket.alias("bucket"), F.lit(True).alias("various")).distinct()
    return rows.withColumn("at", bucket).join(F.broadcast(various), F.col("at") == F.col("bucket"), "left").select("did", F.when(F.col("various"), content).otherwise(F.lit(0)).alias("sub"), "text")


def duplicate_factors(docs: DataFrame, *, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did (internal id), start, stop (words, stop exclusive), src, src_start: factors of width words or more that start earlier elsewhere."""
    return keyed_factors(sub_keyed(docs, id_col, text_col), width).drop("sub")


def keyed_factors(rows: DataFrame, width: int) -> DataFrame:
    """duplicate_factors of rows did, sub, text, with sub."""
    spark = prepared(rows.sparkSession)

    def blocks_of(batches):
        block, size = [], 0
        for batch in batches:
            for did, sub, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2))):
                block.append((did, sub, hash_words(text.split())))
                size += len(block[-1][2])
                if size >= BLOCK_WORDS:
                    yield block
                    block, size = [], 0
        yield block

    def census(batches):
        for block in blocks_of(batches):
            yield block_census([words for _, _, words in block], width)

    counted = rows.mapInArrow(census, "address long, n long").groupBy("address").agg(F.sum("n").alias("n")).checkpoint()
    total = counted.where("address is null").select("n").first()
    total = total[0] if total else 0
    # those with more than one in HOT of all stretches are at most HOT
    hot = np.array(sorted(r[0] for r in counted.where(F.col("address").isNotNull() & (F.col("n") > total / HOT) & (F.col("n") > BLOCK_STRETCHES / 4)).select("address").toLocalIterator()), np.int64)

    def local(batches):
        for block in blocks_of(batches):
            yield block_rows(block, width, hot)

    rows = rows.mapInArrow(local, ROWS)
    blocks = max(partitions(spark), -(-total // BLOCK_STRETCHES))
    # the block stands for the address from here on, which saves eight bytes a row of shuffle
    dealt = rows.select(F.pmod("address", F.lit(blocks)).cast("int").alias("block"), "did", "sub", "start", "windows", "stop", "src", "src_start")
    return dealt.groupBy("block").applyInArrow(lambda table: reference_block(table, width), FACTORS)


def remove_repeats(docs: DataFrame, *, width: int = 20, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by a space), kept_sha256, spans of every row of docs.

    kept_text is null unless with_text. spans are [start, stop) in words, merged. A null text has no words. A null id sorts first. A
    document is an id and a text: rows that repeat both do not remove each other and share their spans; different texts of an id are ordered by hash. Fewer than
    width words: nothing is removed. An empty table gives an empty result."""
    texts = sub_keyed(docs, id_col, text_col)
    spans = keyed_factors(texts, width).groupBy("did", "sub").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def pack(batches):  # texts make most of this shuffle, so they travel compressed
        codec = pa.Codec("zstd")
        for batch in batches:
            texts = byte_texts(batch.column(2))
            yield pa.RecordBatch.from_pydict({"did": batch.column(0), "sub": batch.column(1), "size": pa.array(map(len, texts), pa.int32()), "packed": pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())})

    def body(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            out = {k: [] for k in ("n_words", "n_removed", "kept_text", "kept_sha256", "spans")}
            for size, text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = codec.decompress(text, size, asbytes=True).split()
                merged: list[list[int]] = []
                for a, z in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], z)
                    else:
                        merged.append([a, z])
                for a, z in reversed(merged):
                    del words[a:z]
                kept = b" ".join(words)
                removed = sum(z - a for a, z in merged)
                for k, v in zip(out, (len(words) + removed, removed, kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": z} for a, z in merged])):
                    out[k].append(v)
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_text"], pa.string()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], span)], names=["did", *out])

    packed_texts = texts.mapInArrow(pack, "did long, sub long, size int, packed binary")
    kept = packed_texts.join(spans, ["did", "sub"], "left").drop("sub").mapInArrow(body, "did long, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<start:int,stop:int>>")
    return kept.select(external_id("did").alias("doc_id"), "n_words", "n_removed", "kept_text", "kept_sha256", "spans")


#: The same rows by comparing all 20-word windows as strings; for small tables.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d
), s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM g
), f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM s
), p AS (SELECT doc_id, i + unnest(range(0, 20)) AS p FROM f WHERE nth > 1
), r AS (SELECT doc_id, list(DISTINCT p) AS ps FROM p GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
