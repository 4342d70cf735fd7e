"""Documents made ready for training: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainlens.llm.common import clear, scratch_tables, table, written
from chainlens.llm.langid import keep_known
from chainlens.llm.packing import pack
from chainlens.llm.simhash import keep_one
from chainlens.llm.substring import remove_repeats
from chainlens.llm.toxicity import keep_civil

#: SQL has no tokenizer, classifiers or XXH64: the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no language that the labelled ones teach.

    Those have no letters (null and empty texts among them), or n-grams that lie far off what any taught language has.
    Rows without lang teach nothing but are judged like others; repeated rows stay or go together; of languages that are as
    likely the first by name counts. A very long text is read in slices. All columns come back as they are, whatever their
    names; an empty table gives an empty one.
    """
    return keep_known(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose grade is more likely over 0 than not.

    Labels whose doc_id or toxic is null, or whose documents are not there, teach nothing; where none is left, all
    documents stay, as do null and empty texts. Repeated rows stay or go together; a document just at the bound stays.
    All columns come back as they are, whatever their names; an empty table gives an empty one.
    """
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the first by doc_id, null ones last.

    Of repeated rows one stays; null, empty and blank texts are copies of one another.
    """
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut from texts; documents of which nothing is left go.

    Texts too short to hold a passage stay as they are, null and empty ones too. Repeated rows repeat each other whole.
    """
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences; null and empty texts are one piece of one id, repeated rows each have their own pieces.

    Ties along the curve go by doc_id; other columns than doc_id and text are left behind; an empty table gives no piece.
    """
    return pack(docs)


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before kept, written and read again.

    Once a stage is written, what it read and its own scratch tables are deleted; those of the last one stay for its result.
    An empty table of documents gives an empty result; columns beyond doc_id and text go along as they are, lang teaches.
    """
    docs, own = table(spark, sf_dir, "documents"), len(scratch_tables(spark))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        clear(spark, scratch_tables(spark)[own:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
