"""Token counts through a cache keyed by digests of content and tokenizer version.

A text's digest is joined with the counts already stored for this version of the
tokenizer. Of the misses every distinct content is encoded once, and the new counts are
appended to the cache, from which the answer is read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall.llm.bpe import vocabulary
from pitwall.llm.common import columns_of, giving_back, narrowed, stage, text_rows, whole
from pitwall.session import staging_root

LIMIT = 1024
#: Misses that are encoded in one call.
BATCH = 512

CACHE = "tokenizer string, content binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of how it is called here."""
    content = Path(path).read_bytes()
    return hashlib.sha256(content + b"no added special tokens, no truncation, no padding").hexdigest()


class _ByteLevel:
    """Byte-level BPE files: by the fragments of `bpe`, whose ids are those of the tokenizers library."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.vocabulary.encode_batch(texts)]

    def forget(self) -> None:
        self.vocabulary.forget()


class _Json:
    """Other files of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def forget(self) -> None:
        """Nothing is remembered."""


class _Piece:
    """Counts by the sentencepiece library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]

    def forget(self) -> None:
        """Nothing is remembered."""


def _is_byte_level(path: str) -> bool:
    """Whether the file holds nothing that `bpe` does not do."""
    content = json.loads(Path(path).read_text(encoding="utf-8"))
    split, model = content.get("pre_tokenizer") or {}, content["model"]
    return (
        content.get("normalizer") is None and content.get("post_processor") is None
        and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in content["added_tokens"])
    )


_COUNTERS: dict[str, _ByteLevel | _Json | _Piece] = {}


def counter(path: str) -> _ByteLevel | _Json | _Piece:
    """Loaded once for each Python worker: .model files by sentencepiece, others as tokenizers gives them."""
    if path not in _COUNTERS:
        kind = _Piece if path.endswith(".model") else _ByteLevel if _is_byte_level(path) else _Json
        _COUNTERS[path] = kind(path)
    return _COUNTERS[path]


def shared_cache(spark: SparkSession, path: str) -> str:
    """The cache of a tokenizer that all runs of a cluster share: one folder for each version, beside the staged tables."""
    return f"{staging_root(spark)}/pitwall/token-counts/{tokenizer_version(path)[:32]}"


def token_counts(docs: DataFrame, path: str, cache_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    `cache_path` is a folder all executors share; it is made on first use, and a later
    run with the same tokenizer file encodes only contents it has not seen. Content is
    normalised by reading null as empty, and in no other way, as any other change would
    change counts. Repeated rows are repeated with the same count; an empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path)
    docs = columns_of(docs, "doc_id", "text").withColumn("text", whole())
    docs = docs.withColumn("content", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = stage(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "count_rows")

    spark.createDataFrame([], CACHE).coalesce(1).write.mode("ignore").parquet(cache_path)

    def stored() -> DataFrame:
        cache = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version)
        return cache.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    firsts = rows.groupBy("content").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("first"))
    misses = stage(firsts.join(stored().select("content"), "content", "left_anti"), "count_misses")

    @giving_back()
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = counter(path), []

        def flush() -> pa.RecordBatch:
            counts = own.counts([t for _, t in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in held], pa.binary()), pa.array(counts, pa.int64())], names=["content", "n_tokens"]
            )

        size = 0
        for row in text_rows(batches, "content", "text"):
            held.append(row)
            size += len(row[1])
            if len(held) >= BATCH or size >= 1 << 21:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        own.forget()

    # Texts whose counts are stored stay where they are.
    chosen = narrowed(docs, misses, "content").join(
        misses.withColumnRenamed("content", "wanted"),
        (F.coalesce("doc_id", F.lit(-1)) == F.col("first")) & (F.col("content") == F.col("wanted")),
        "left_semi",
    )
    # Rows that repeat both id and text come twice.
    new = chosen.select("content", "text").mapInArrow(encode, "content binary, n_tokens long").dropDuplicates(["content"])
    if not misses.isEmpty():
        new.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache_path)
    return rows.join(stored(), "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
