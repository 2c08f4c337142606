"""The registered queries of the operators, and the SQL of those that SQL can express."""

import corpus_pipeline
from cartlens.llm import (
    clustering,
    compression_quality,
    decontam,
    license_scan,
    line_dedup,
    merkle,
    mixing,
    neighbours,
    pii,
    quality_rules,
    simhash,
    toxicity,
    url_filter,
)
from cartlens.llm.common import table

QUERIES = {}
ORACLES = {}


def register(function):
    QUERIES[function.__name__] = function
    return function


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@register
def op1_decontamination(spark, sf_dir):
    return decontam.query(spark, documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@register
def op2_pii(spark, sf_dir):
    return pii.query(documents(spark, sf_dir))


@register
def op3_line_dedup(spark, sf_dir):
    return line_dedup.query(documents(spark, sf_dir), whole=True)


@register
def op4_compression_quality(spark, sf_dir):
    return compression_quality.query(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@register
def op5_url_filter(spark, sf_dir):
    return url_filter.query(table(spark, sf_dir, "pages"))


ORACLES["op5_url_filter"] = url_filter.SQL


@register
def op6_license_scan(spark, sf_dir):
    return license_scan.query(documents(spark, sf_dir))


@register
def op7_mixing(spark, sf_dir):
    return mixing.query(documents(spark, sf_dir))


ORACLES["op7_mixing"] = mixing.SQL


@register
def op8_toxicity(spark, sf_dir):
    return toxicity.query(spark, documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@register
def op9_quality_rules(spark, sf_dir):
    return quality_rules.query(documents(spark, sf_dir))


@register
def op10_simhash(spark, sf_dir):
    return simhash.query(documents(spark, sf_dir))


@register
def op11_merkle_manifest(spark, sf_dir):
    return merkle.query(documents(spark, sf_dir))


ORACLES["op11_merkle_manifest"] = merkle.SQL


@register
def op12_centroid_clustering(spark, sf_dir):
    return clustering.query(table(spark, sf_dir, "embeddings"))


ORACLES["op12_centroid_clustering"] = clustering.SQL


@register
def op13_multi_index(spark, sf_dir):
    return neighbours.query(table(spark, sf_dir, "embeddings"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
