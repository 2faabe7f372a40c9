"""From raw documents to token ids: five stages, each of which takes (spark, docs, sf_dir) and returns a DataFrame.

1. toxicity: documents that the classifier rejects go
2. line_dedup: lines that more than 1 % of a source's documents share go from their texts
3. near_dedup: of each group of near copies the document with the least doc_id stays
4. decontamination: documents that contain a benchmark item go
5. bpe: the token ids of every document, and digests of ids and decoded text

All but the last return the columns of documents. A stage's result is written and read again before the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import bpe, common, decontaminate, linedup, minhash, toxicity


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of every document."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", linedup.stage),
    ("near_dedup", minhash.stage),
    ("decontamination", decontaminate.stage),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; what lies between is written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, function in STAGES[:-1]:
        docs = common.staged(function(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            common.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
