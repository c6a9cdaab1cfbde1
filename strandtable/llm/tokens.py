"""Token counts kept by deltas.

A change set has one row per change: ``sign`` +1 (a text comes in) or -1 (a text goes out); a revised
text is one row of each. ``commit`` counts the tokens of the changed texts, sums signed documents, tokens
and characters by (source, lang, tokenizer) and writes that rollup as one batch under its id. Totals are
sums over all batches, so they cost as much as the rollups, whatever the corpus holds.

Idempotence. A batch is written aside and then renamed to its final name, which a store does at once; a
batch that is already there is left alone, so a repeated or retried commit changes nothing. Batches can be
committed in any order, as sums are additive.

Scale. Texts are tokenised where they are read, encoders are built once per Python worker, and counts are
combined in the map tasks; only sums by key are shuffled, so a hot source is a few rows per task. Very
long texts are encoded whole.

Nulls and odd rows: a null text has no tokens but is a document; null sources and languages are keys of
their own; rows with a null sign count as inserts; repeated rows count each time. Extra columns are
ignored. Empty change sets commit an empty batch.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator
from functools import cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how GPT-2 style byte-level BPE cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


@cache
def encoder(name: str, folder: str = TOKENIZERS) -> tiktoken.Encoding:
    """A byte-level BPE from a rank file of ``folder``, built once per process."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(changes: DataFrame, tokenizers: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """One row per change and tokenizer: doc_id (null if there is none), source, lang, tokenizer, sign, n_tokens, n_chars.

    Written as a table, it is a ledger of counts from which documents can be taken out again by narrow joins.
    """
    sign = F.coalesce(F.col("sign").cast("int"), F.lit(1)) if "sign" in changes.columns else F.lit(1)
    doc_id = F.col("doc_id").cast("long") if "doc_id" in changes.columns else F.lit(None).cast("long")
    rows = changes.select(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), sign.alias("sign"), doc_id.alias("doc_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            texts = [(t or "").encode("utf-8", "replace").decode() for t in b["text"]]
            for name in tokenizers:
                n = [len(x) for x in map(encoder(name, folder).encode_ordinary, texts)]
                yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "lang": b["lang"], "tokenizer": name, "sign": b["sign"], "n_tokens": n, "n_chars": [len(t) for t in texts]})

    return rows.mapInPandas(run, "doc_id long, source string, lang string, tokenizer string, sign int, n_tokens long, n_chars long")


def rollup(rows: DataFrame) -> DataFrame:
    signed = lambda c: F.sum(F.col("sign") * c).cast("long")
    return rows.groupBy(*KEYS).agg(signed(F.lit(1)).alias("n_docs"), signed(F.col("n_tokens")).alias("n_tokens"), signed(F.col("n_chars")).alias("n_chars"))


class Totals:
    """Additive totals in a folder of committed batches."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")

    def _at(self, name: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        at, store = self._at(f"batch={batch}")
        return store.exists(at)

    def commit(self, batch: str, changes: DataFrame, tokenizers: list[str], folder: str = TOKENIZERS) -> bool:
        """Count and commit a change set; False if the batch was there already."""
        return self.commit_rollup(batch, rollup(counted(changes, tokenizers, folder)))

    def commit_rollup(self, batch: str, rows: DataFrame) -> bool:
        """Commit signed sums by key."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError("a batch id has letters, digits, - and _ only")
        if self.committed(batch):
            return False
        aside = f"_aside-{uuid.uuid4().hex}"
        rows.select(*KEYS, *SUMS).write.parquet(f"{self.path}/{aside}")
        (source, store), (target, _) = self._at(aside), self._at(f"batch={batch}")
        if not store.exists(target) and store.rename(source, target):
            return True
        store.delete(source, True)
        return False

    def totals(self) -> DataFrame:
        """Sums over all committed batches; keys whose sums are all zero are left out."""
        rows = self.spark.read.schema(_SCHEMA + ", batch string").parquet(self.path)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where(" or ".join(f"{c} <> 0" for c in SUMS))
