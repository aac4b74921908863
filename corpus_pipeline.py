"""A corpus pipeline: toxicity, exact dedup, SimHash near-dedup, personal data, packing.

Each stage works on all rows that the one before kept; run() writes what a stage returns to the shared folder, reads it again as
the next stage's documents, and drops what the stage and the one before it had written. All but the last return the columns of
documents, which may have any name and type besides doc_id and text. In every stage a null text counts as empty, repeated rows
are rows like any others, very long texts are read whole, and an empty table gives no row; each function says what else it does
with odd rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import exact_dedup, packing, pii, simhash, toxicity
from tempora.llm.common import documents, new_path
from tempora.sources.staging import drop_path, drop_since, staged_so_far

#: Documents of this score or more are rejected.
TOXIC_SCORE = 0.5
#: Executors still hold what the stages before have touched, so packing caches less than it does alone and its workers keep nothing for later stages.
CACHE_BYTES = 8 << 20
#: Near copies differ by some words, each of which changes as many shingles as a shingle has words: shorter shingles and a wider radius than op6's link more of them, as do several fingerprints. What is linked is then compared.
SHINGLE_WORDS, RADIUS = 2, 6


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the score. The model learns from the labelled rows among docs that aren't held out.

    Empty and null texts are scored as well; rows without a doc_id are scored and never learnt from; without labelled rows none is rejected.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model, TOXIC_SCORE)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the one of the smallest doc_id (null last), then the first in its file.

    Null and empty texts and those of white space are one group; of rows that repeat in full one stays.
    """
    return exact_dedup.survivors(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but for those whose five-word shingles have a similarity of 0.8 or more with a linked one's of smaller doc_id.

    Texts without words are alike; rows without a doc_id stay; rows that repeat a doc_id stay or go together.
    """
    return simhash.unlike(docs, RADIUS, SHINGLE_WORDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their text replaced by its kind. A null text stays null, and n_chars follows the text."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences. An empty or null text is one id, that of the document's end; equal rows are pieces each."""
    return packing.pack(docs, cache_bytes=CACHE_BYTES, keep_caches=False)


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Trained scores, fingerprint components and packing aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), None
    for name, apply in STAGES[:-1]:
        before = staged_so_far()
        out, path = apply(spark, docs, sf_dir), new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        drop_since(spark, before, keep=path)
        if held:
            drop_path(spark, held)
        docs, held = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
