"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch are one ragged array of symbols; each round merges the
lowest-rank pair of every pre-token at once (``bytepair.rank_synchronous_merge``), and the
symbols that survive are counted.  There is no shuffle.

Edge cases: a null text is an empty text with 0 bytes and 0 tokens; a special token's
string inside a text is one token, as the library takes it by default; texts of any length
are whole; repeated rows each give a row; further columns are kept by ``count_tokens``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import arrays as A
from .bpe_encoding import tokenizer_path
from .bytepair import Encoder, merges_vocabulary, rank_synchronous_merge
from .frames import with_text_columns
from .storage import read

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512


def count_tokens(frame: DataFrame, path: str, column: str = "text", limit: int = LIMIT) -> DataFrame:
    """n_bytes, n_tokens and over_limit in place of each text."""

    def make():
        encoder = Encoder(merges_vocabulary(path), rank_synchronous_merge)

        def values(chunk: A.Chunk) -> list:
            n = encoder.counts(chunk)
            return [chunk.ends - chunk.starts, n, n > limit]

        return values

    return with_text_columns(frame, column, "n_bytes long, n_tokens long, over_limit boolean", make)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_path(TOKENIZER))
