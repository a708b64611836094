"""The registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, decontaminate, fuzzylines, licences, maintext, mixing, periodic, pieces, quality, simhash, substrings, toxicity, whitening
from .common import held_out, table


def op3_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontaminate.digest(found)


def op10_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a file named by its id in a directory for its source and, below, its language."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    found = licences.scan(table(spark, sf_dir, "documents").select(path.alias("path"), "text"))
    return found.select(F.expr("try_cast(element_at(split(path, '/'), -1) as bigint)").alias("doc_id"), "licence", F.round("score", 9).alias("score"), "origin", "inherited_from")


def op9_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_spans(table(spark, sf_dir, "documents"), keep=["doc_id"], finish="sha256")
    return substrings.digest(found)


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, rules, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op4_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.digest(maintext.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"]))


def op5_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.search(table(spark, sf_dir, "embeddings"))


def op6_minhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzylines.summary(table(spark, sf_dir, "documents"))


def op7_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, net, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_lpf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = periodic.made_periodic(periodic.words_of("text"), "doc_id").alias("words")
    return periodic.digest(periodic.periodic_runs(docs.select("doc_id", words), keep=["doc_id"]))


def op12_residue_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])


def op13_merge_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digest(pieces.encode(table(spark, sf_dir, "documents"), model, keep=["doc_id"], packed=True, decoded=True))


QUERIES = {
    "op1_rule_ensemble": op1_rule_ensemble,
    "op2_pareto_mix": op2_pareto_mix,
    "op3_wu_manber": op3_wu_manber,
    "op4_block_rules": op4_block_rules,
    "op5_bitsliced": op5_bitsliced,
    "op6_minhash_lines": op6_minhash_lines,
    "op7_convolution": op7_convolution,
    "op8_licences": op8_licences,
    "op9_fingerprint_index": op9_fingerprint_index,
    "op10_simhash_popcount": op10_simhash_popcount,
    "op11_lpf_runs": op11_lpf_runs,
    "op12_residue_whitening": op12_residue_whitening,
    "op13_merge_backtracking": op13_merge_backtracking,
}
ORACLES = {
    "op2_pareto_mix": mixing.ORACLE,
    "op3_wu_manber": decontaminate.ORACLE,
    "op5_bitsliced": bitsliced.ORACLE,
    "op9_fingerprint_index": substrings.ORACLE,
}
