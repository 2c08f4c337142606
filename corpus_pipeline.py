"""A corpus pipeline: toxicity, line dedup, SimHash near-dedup, decontamination, mixing.

Each stage works on all that the one before it kept and is written before the next one reads.
Null or empty texts, repeated rows and rows without an id are treated as the operators say.
"""

from cartlens.llm import decontam, line_dedup, mixing, simhash, toxicity
from cartlens.llm.common import table
from cartlens.session import materialise


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity score rejects go."""
    return toxicity.drop_toxic(spark, docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark, docs, sf_dir):
    """Lines that repeat an earlier line of the corpus, exactly or nearly, go."""
    return line_dedup.drop_repeated_lines(docs, whole=True)


def dedup_documents(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents with an item of the benchmark go."""
    return decontam.drop_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Documents are repeated to the target weights of their sources and shuffled."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix_sources),
]

# The scores of a trained model, near-line classes and XXH64 fingerprints have no SQL; the
# stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over ``documents``; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
