"""A corpus pipeline of five training-data operators over documents; part of the subpackage lineweave.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the folder that
driver and executors share and reads again as the next stage's docs.

Every stage decides by rows, not by ids: rows without an id or with the same one are told apart. A null or empty text is
not toxic, has no duplicates, loses nothing, leaks nothing and takes no words, so such rows stay until the mix. Texts of
any length are worked on whole. An empty table gives an empty result. Columns keep their names and values, whatever these
are, but for the text and n_chars of documents that lose a passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineweave.llm import containment, mixing, setsketch, substrings, toxicity
from lineweave.llm.common import Scratch, load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, fitted on the labelled documents of the input, does not reject. Rows with equal texts
    fare alike; without labels of both classes and a majority of toxic ones, none is rejected."""
    model = toxicity.fit(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return toxicity.civil(spark, docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is similar to 0.8 or more on shingles of five words: that with the smallest id;
    of equal ids, and of rows without any, any one of them. Texts of fewer than five words are one shingle."""
    return setsketch.one_of_each(spark, docs, k=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that are covered by 35 consecutive ones that stand anywhere else, too, in the same
    document or in another row, whatever its id."""
    return substrings.without_repeats(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, that is, less than 0.8 of the shingles of five words of any; items that are
    null or empty match nothing."""
    return containment.clean_of(spark, docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with how many words it takes of each (size, source_size, target, taken). A null source is
    a source of its own; documents that no words are taken of, empty ones among them, are not in the mix."""
    return mixing.mixed(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The lexicon of the first stage is learned in a way that SQL does not express; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    s = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        before, docs = docs, s.write(stage(spark, docs, sf_dir), name)
        s.drop(before)
    return docs
