"""One registered query an operator, with its contract's columns, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undulate.llm import op3_blob_ledger, op4_nn_descent, op7_simhash_planes, op11_trie_bpe, op12_va_file_clusters, op13_prefix_trie
from undulate.llm.common import table
from undulate.llm.op1_attention_score import score
from undulate.llm.op2_language_filters import identify
from undulate.llm.op5_block_search import search
from undulate.llm.op6_source_mix import mix
from undulate.llm.op8_url_rules import judge
from undulate.llm.op9_token_records import read_records, token_positions, write_records
from undulate.llm.op10_packing import pack


def op1_attention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op2_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_blob_ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _, _ = op3_blob_ledger.scan(table(spark, sf_dir, "documents"))
    return op3_blob_ledger.digest(report)


def op4_nn_descent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_simhash_planes.digest(op7_simhash_planes.near_duplicates(table(spark, sf_dir, "documents")))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_records(table(spark, sf_dir, "documents"))
    return token_positions(read_records(index))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_trie_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_trie_bpe.round_trip(table(spark, sf_dir, "documents"))


def op12_va_file_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_va_file_clusters.digest(*op12_va_file_clusters.clusters(table(spark, sf_dir, "embeddings")))


def op13_prefix_trie_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_attention_score, op2_language_filters, op3_blob_ledger_scan, op4_nn_descent_links, op5_block_search, op6_source_mix, op7_simhash_near_duplicates, op8_url_rules, op9_token_records, op10_packing, op11_trie_bpe_round_trip, op12_va_file_assignment, op13_prefix_trie_nodes, pipeline)}
