"""The registered queries of the operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowprofile.llm import ann_tree, bpe, chat, collocations, decontaminate, lengths, mixing, prefix_trie, simhash, token_files, topk_bits, toxicity, url_filter
from flowprofile.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_ann_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest vectors found for every hundredth id."""
    return ann_tree.nearest_neighbours(read(spark, folder, "embeddings", "vec_id", "embedding"), F.col("id") % 100 == 0)


def op2_token_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram of the encoded lengths of all documents with its suffix sums."""
    encoded = bpe.encode_documents(read(spark, folder, "documents", "text"), keep=())
    return lengths.suffix_sums(lengths.length_histogram(encoded))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written to token files and read back."""
    files = token_files.write_token_files(read(spark, folder, "documents", "doc_id", "text"))
    return token_files.read_token_files(files, with_ids=False)


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return url_filter.judge_urls(read(spark, folder, "pages", "page_id", "url"))


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted texts."""
    turns = chat.with_extra_conversation(spark, read(spark, folder, "conversations", "conv_id", "turn", "role", "text"))
    return chat.digests(chat.format_conversations(turns))


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return bpe.round_trip(read(spark, folder, "documents", "doc_id", "text")).drop("ids")


def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(read(spark, folder, "documents", "doc_id", "text", "source"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op8_topk_bits(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth id."""
    return topk_bits.top_inner_products(read(spark, folder, "embeddings", "vec_id", "embedding"), F.col("id") % 20 == 0)


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.fingerprint_components(read(spark, folder, "documents", "doc_id", "text"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    documents = read(spark, folder, "documents", "doc_id", "text")
    labels = read(spark, folder, "labels", "doc_id", "toxic")
    model = toxicity.fit_toxicity(documents, labels, where=toxicity.learned_from())
    return toxicity.score_documents(documents, model)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(read(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 strongest phrases of each language."""
    return collocations.collocations(read(spark, folder, "documents", "text", "lang"))


def op13_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that passages of the benchmark cover, and the items they come from."""
    found = decontaminate.find_passages(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "benchmark", "item_id", "text"))
    return decontaminate.contamination(found)


def queries() -> dict[str, Query]:
    found = [
        op1_ann_tree, op2_token_lengths, op3_token_files, op4_url_filter, op5_chat_format, op6_byte_bpe, op7_mix_sources, op8_topk_bits, op9_simhash, op10_toxicity,
        op11_prefix_trie, op12_collocations, op13_decontaminate,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": url_filter.verdict_sql(), "op5_chat_format": chat.digests_sql(), "op8_topk_bits": topk_bits.top_sql(), "op11_prefix_trie": prefix_trie.prefix_trie_sql(), "op12_collocations": collocations.collocations_sql(), "op13_decontaminate": decontaminate.contamination_sql()}
