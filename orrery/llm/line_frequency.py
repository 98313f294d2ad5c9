"""Quality rules: base counts of a text, and cross-document line frequency per host.

Lines are normalised (lower case, white space collapsed) and hashed, and for each host the
distinct documents that hold a line are counted. Documents are distinct if their whole texts are, both
among those that hold a line and among those of the host, so a page copied a thousand times is one
document and does not make its own prose look like boilerplate; copies with edits are documents of
their own. Lines above the limit are removed; a document that keeps too little is depleted and rejected.

Lines are hashed in one pass over the texts, which leaves an array of keys for each document. Counting is two aggregates with
map-side partial sums, so a line of a third of all documents arrives as one row per task. The lines above the limit are counted, and
broadcast if they are few; else they are copied SALTS times and joined by a salted key, as the lines looked for are the frequent ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, byte_texts, content_of, external_id, gram_hashes, hash_words, internal_id, mixed, prepared, release_memory

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Words whose windows are compared at once.
WORK_WORDS = 1 << 20
#: Most rows of lines above the limit that are broadcast, and the copies of them otherwise.
BROADCAST_LINES, SALTS = 100_000, 16


def base_counts(texts: list[bytes], window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    out = {k: np.zeros(len(texts), np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    held: list[np.ndarray] = []
    first = size = 0

    def repeats() -> None:
        out["n_repeat_words"][first : first + len(held)] = repeated_words(held, window)

    for i, text in enumerate(texts):
        words = text.split()
        out["n_words"][i] = len(words)
        out["word_chars"][i] = sum(map(len, words)) - (0 if text.isascii() else len(text) - len(text.translate(None, _CONTINUATION)))
        out["n_symbols"][i] = len(text.translate(None, _NOT_SYMBOLS))
        lines = [x for x in text.split(b"\n") if x.strip()]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        held.append(hash_words(words))
        size += len(words)
        if size >= WORK_WORDS:
            repeats()
            first, size, held = i + 1, 0, []
    repeats()
    return out


def repeated_words(docs: list[np.ndarray], window: int) -> np.ndarray:
    """For each document (word hashes) the words under windows that it has twice or more."""
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate([*docs, np.zeros(0, np.uint64)])
    begin = np.cumsum(sizes) - sizes
    starts = np.maximum(sizes - window + 1, 0)
    doc = np.repeat(np.arange(len(docs)), starts)
    if not len(doc):
        return np.zeros(len(docs), np.int64)
    place = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(len(doc))
    key = mixed(gram_hashes(flat, window)[place] ^ mixed(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, place[again], 1)
    np.add.at(cover, place[again] + window, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(np.repeat(np.arange(len(docs)), sizes)[covered], minlength=len(docs)).astype(np.int64)


def normal_line(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, f"[{SPACES}]+", " ")))


def line_key(line: Column) -> Column:
    """64 bits of hash of a normalised line."""
    return F.xxhash64(normal_line(line))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACES}]+")).cast("long")


def has_word(line: Column) -> Column:
    return line.rlike(f"[^{SPACES}]")


def line_table(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """did, host, content (hash of the whole text), lines (structs key, words: of each line with a word) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    items = F.transform(F.filter(F.split(text, "\n"), has_word), lambda x: F.struct(line_key(x).alias("key"), word_count(x).alias("words")))
    return docs.select(internal_id(id_col).alias("did"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("content"), items.alias("lines"))


def frequent_lines(table: DataFrame, *, min_docs: int, share: float) -> DataFrame:
    """host, key of lines in more than min_docs and more than share of the host's distinct documents."""
    found = table.select("host", "content", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key")).distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    hosts = table.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    return found.join(hosts, "host").where(F.col("n") > F.col("docs") * F.lit(share)).select("host", "key")


def lines_to_remove(docs: DataFrame, *, min_docs: int = 5, share: float = 0.05, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """did (internal id), content, gone (keys of the lines above the limit that it holds), gone_words. Only documents (id and text) with any."""
    table = line_table(docs, id_col, text_col, host_col).checkpoint()
    over = frequent_lines(table, min_docs=min_docs, share=share).checkpoint()
    lines = table.select("did", "content", "host", F.posexplode("lines").alias("line", "item")).select("did", "content", "host", "line", "item.*")
    if over.count() <= BROADCAST_LINES:
        held = lines.join(F.broadcast(over), ["host", "key"])
    else:
        copies = over.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        held = lines.withColumn("salt", F.pmod("content", F.lit(SALTS)).cast("int")).join(copies, ["host", "key", "salt"])
    # a set of (place, words), so that rows that repeat a document count once
    gone = held.groupBy("did", "content").agg(F.collect_set("key").alias("gone"), F.collect_set(F.struct("line", "words")).alias("places"))
    return gone.select("did", "content", "gone", F.aggregate("places", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("gone_words"))


def stripped(text: Column, gone: Column) -> Column:
    """The text without the lines whose key is in gone (null: the text as it is)."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(has_word(x) & F.array_contains(gone, line_key(x)))), "\n")
    return F.when(gone.isNull(), text).otherwise(kept)


def quality(docs: DataFrame, *, min_docs: int = 5, share: float = 0.05, min_words: int = 10, max_repeat_percent: int = 20, min_kept: float = 0.3, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Base counts and verdict of every row of docs.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words_kept,
    depleted and kept.

    A line goes if more than min_docs and more than share of its host's distinct documents hold it. A document is depleted if
    lines went and fewer than min_words words or min_kept of its words stay. base_failed: fewer than
    min_words words, or over max_repeat_percent of the words under repeated 5-word windows.

    A null text has no words; a null host is the host ''; a null id is an id of its own; rows that repeat
    an id are judged each by its own text and removals. An empty table gives an empty result."""
    rules = {"min_docs": min_docs, "share": share, "min_words": min_words, "max_repeat_percent": max_repeat_percent, "min_kept": min_kept}
    rows = verdicts(docs, **rules, id_col=id_col, text_col=text_col, host_col=host_col)
    return rows.select(external_id("did").alias("doc_id"), *COUNTS, "base_failed", "n_words_kept", "depleted", "kept")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdicts(docs: DataFrame, *, min_docs: int = 5, share: float = 0.05, min_words: int = 10, max_repeat_percent: int = 20, min_kept: float = 0.3, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """did, content, quality's columns and gone (keys of the lines to remove, or null) of every row of docs."""
    prepared(docs.sparkSession)

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"did": batch.column(0), "content": batch.column(1), **base_counts(byte_texts(batch.column(2)))})
        release_memory()

    texts = docs.select(internal_id(id_col).alias("did"), content_of(text_col).alias("content"), F.col(text_col).cast("string").alias("text"))
    gone = lines_to_remove(docs, min_docs=min_docs, share=share, id_col=id_col, text_col=text_col, host_col=host_col)
    rows = texts.mapInArrow(counted, ", ".join(f"{c} long" for c in ("did", "content", *COUNTS))).join(gone, ["did", "content"], "left")
    kept = F.col("n_words") - F.coalesce("gone_words", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (kept < F.col("n_words")) & ((kept < min_words) | (kept < F.col("n_words") * F.lit(min_kept)))
    return rows.select("did", "content", *COUNTS, failed.alias("base_failed"), kept.alias("n_words_kept"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"), "gone")


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **rules) -> DataFrame:
    """docs without the rejected documents and without the lines above the limit; same columns.

    Rows that repeat an id stay or go each by its own text."""
    named = verdicts(docs, id_col=id_col, text_col=text_col, host_col=host_col, **rules)
    marked = named.where("kept").groupBy(F.col("did").alias("did__"), F.col("content").alias("content__")).agg(F.max(F.sort_array("gone")).alias("gone__"))
    rows = docs.join(marked, (internal_id(id_col) == F.col("did__")) & (content_of(text_col) == F.col("content__")))
    text = stripped(docs[text_col].cast("string"), F.col("gone__"))
    return rows.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])


#: The same rows with lines, windows and documents as strings.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d
), g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM places
), c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g
), covered AS (SELECT doc_id, i + unnest(range(0, 5)) AS p FROM c WHERE n > 1
), rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM covered GROUP BY doc_id
), l AS (SELECT doc_id, host, text, unnest(lines) AS line FROM d
), k AS (SELECT doc_id, host, md5(text) AS t, line, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS key, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM k GROUP BY doc_id
), found AS (SELECT host, key, count(DISTINCT t) AS n FROM k GROUP BY host, key
), hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host
), over AS (SELECT f.host, f.key FROM found f JOIN hosts h ON f.host = h.host WHERE f.n > 5 AND f.n > h.docs * 0.05::DOUBLE
), gone AS (SELECT doc_id, sum(words) AS n FROM k SEMI JOIN over ON k.host = over.host AND k.key = over.key GROUP BY doc_id
), m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(gone.n, 0))::BIGINT AS n_words_kept
  FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id
), v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words_kept < n_words AND (n_words_kept < 10 OR n_words_kept < n_words * 0.3::DOUBLE) AS depleted FROM m)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM v
"""
