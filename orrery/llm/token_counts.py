"""Token counts: lengths only, from Arrow batches balanced by bytes.

Only the number of tokens of a text is wanted, so no ids leave the worker. A text is cut at
its ASCII white space. That is a safe boundary for a vocabulary that drops white space before
its merges (``word_bpe_49k.json``): neither a merge, a special string, a case fold nor NFC
reaches across it, so the count of a text is the sum over its pieces. Pieces recur (a task's
text has about one distinct piece in ten), so each worker encodes a distinct piece once, in
encode_batch calls of a bounded number of bytes, and keeps the lengths in a bounded table.
Other vocabularies take whole texts, batched by bytes alike; ``drops_space`` tells from the vocabulary's own file which it
is. A text without white space is one piece, and is handed to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_texts, prepared

#: Bytes of text handed to the library at once, and worked on at once.
ENCODE_BYTES, WORK_BYTES = 1 << 18, 4 << 20
#: Distinct pieces whose lengths a worker keeps; the table starts anew when it is full.
KEPT = 400_000


#: What drops_space puts on either side of white space: letters, marks, digits, signs, contractions, cased and composed letters.
PROBES = ("a", "Word", "é", "e\u0301", "\u0301", "İΣ", "7", "42", "'", "'s", "it's", "-", "...", "(x)", "日本", "😀", "<|endoftext|>", "_")


def drops_space(path: str, model) -> bool:
    """Whether a vocabulary can be counted piece by piece between ASCII white space.

    Its file must say that it splits texts before its merges and drops what is between, with no added string that holds or takes
    white space; and no probe may count otherwise beside white space than alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    splitter = spec.get("pre_tokenizer") or {"type": ""}
    first = splitter["pretokenizers"][0] if splitter["type"] == "Sequence" else splitter
    if first["type"] not in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer") and not (first["type"] == "Split" and first.get("behavior") == "Removed"):
        return False
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t["content"] != "".join(t["content"].split()) for t in spec.get("added_tokens") or []):
        return False
    sizes = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    alone = sizes(list(PROBES))
    pairs = [(i, j, gap) for i in range(len(PROBES)) for j in range(len(PROBES)) for gap in " \t\n\r\x0b\x0c"]
    return sizes([PROBES[i] + gap + PROBES[j] for i, j, gap in pairs]) == [alone[i] + alone[j] for i, j, _ in pairs]


class Counter:
    """Counts tokens; one per Python worker and task."""

    def __init__(self, path: str, split: bool | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.split, self.known = bool(split), {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            if split is None:
                self.split = drops_space(path, model)

    def lengths(self, texts: list[str]) -> list[int]:
        """Tokens of each text, ENCODE_BYTES at a time."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text) + 16
            if size >= ENCODE_BYTES:
                out += self.encode(held)
                held, size = [], 0
        return out + (self.encode(held) if held else [])

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.split:
            return self.lengths([t.decode() for t in texts])
        pieces = [t.split() for t in texts]
        if len(self.known) > KEPT:
            self.known = {}
        new = list(set().union(*pieces) - self.known.keys())
        self.known.update(zip(new, self.lengths([w.decode() for w in new])))
        known = self.known.__getitem__
        return [sum(map(known, p)) for p in pieces]


def by_bytes(texts: list[bytes], most: int):
    """Runs of texts of about most bytes each."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:]


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 2048, split: bool | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs, whole texts, no shuffle.

    Args:
        tokenizer: path of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file, readable on executors.
        limit: over_limit is n_tokens > limit.
        split: cut at white space, only right for vocabularies that drop it; left out, ``drops_space`` decides.

    A null text counts as empty (0 bytes, 0 tokens, not over); a null id stays null; repeated
    rows are counted each; an empty table gives an empty result."""
    prepared(docs.sparkSession)

    def body(batches):
        counter = Counter(tokenizer, split)
        for batch in batches:
            texts = byte_texts(batch.column(1))
            n = [x for run in by_bytes(texts, WORK_BYTES) for x in counter.counts(run)]
            n = np.array(n, np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": np.array([len(t) for t in texts], np.int64), "n_tokens": n, "over_limit": n > limit})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(body, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
