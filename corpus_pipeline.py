"""From raw documents to packed token sequences, in five stages that each write Parquet for the next.

Every stage takes texts of any length whole and gives an empty table for an empty one. All but the last return the columns
of the documents; further columns, whatever their names, come along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.llm.common import staged
from rillspark.llm.exact_dedup import exact_dedup
from rillspark.llm.minhash import near_dedup
from rillspark.llm.mixing import mixed_documents
from rillspark.llm.queries import packed, read, scored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores below one half.

    Null, empty and blank texts score as a text without words, by the share of toxic labels; repeated rows score alike;
    every window of a very long text counts. Without labels of both kinds each text scores the labels' mean.
    """
    return scored(spark, docs, sf_dir, "toxicity score").where(F.col("toxicity score") < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id.

    Null texts equal empty ones, and one of all these stays. Null ids lose to others. Rows equal in id and text: one stays.
    """
    return exact_dedup(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the one with the smallest doc_id.

    Texts without words all stay. Rows that share an id are one document of a group; of several of them that would stay,
    one does. Null ids are only dropped as copies of equal word sequences.
    """
    return near_dedup(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 in turn, 1.5 times all words in all, no document more than twice.

    The null source takes part as the last one. Texts without words take no place and go. A document that is taken twice
    comes out twice; the one at a source's cut keeps its first words.
    """
    return mixed_documents(docs, weights=[5, 2, 1], budget=1.5, passes=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024: doc_id, piece, start, length, ids_crc32, sequence_id, offset; no other columns.

    Null and empty texts are one piece, the end mark. Repeated rows are packed as often as they come.
    """
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
