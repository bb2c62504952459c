"""The registered ``opN_*`` queries: each applies one operator, with its
production parameters, to the whole of its table and derives the contract's
columns from the operator's results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from abundance.llm import bpe, decontaminate, licenses, pii, piece_bpe, prefix_trie, quality, quotes, simhash, structure_repair, substring, toxicity, warc
from abundance.llm.common import read_table
from abundance.llm.oracles import ORACLES  # noqa: F401  (read by the entry point)
from abundance.session import checkpoint_dir, cut_lineage


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", F.round("expected_severity", 6).alias("expected_severity"), "severity", "toxic")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, pii.KINDS))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(written(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        F.round("quality", 6).alias("quality"))


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns are first given mail form (each under quotes of the two turns
    before it), by Spark, from the whole table."""
    mail = quotes.quoted_mail(read_table(spark, sf_dir, "conversations"), levels=2)
    found = quotes.conversations(mail)
    return found.select("conv_id", "turn", "role", "reply_to", "root", "depth", "n_quotes", F.sha2("text", 256).alias("text_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4()}"
    warc.write_archives(read_table(spark, sf_dir, "pages"), folder, min_bytes=0)
    h = F.col("headers")
    return warc.read_archives(spark, folder).where("kind = 'record'").select(
        h["x-page-id"].cast("long").alias("page_id"), h["x-payload-length"].cast("long").alias("payload_bytes"),
        F.substring_index(h["warc-payload-digest"], ":", -1).alias("payload_digest"), h["warc-type"].alias("record_type"),
        h["x-refers-to-page"].cast("long").alias("refers_to"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license", F.round("license_score", 6).alias("license_score"), F.size("licenses").cast("long").alias("n_licenses"))


def op7_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, tokenizer or tokenizer_file("byte_bpe_50k.json"), null_as_empty=True)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(read_table(spark, sf_dir, "documents"), width=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, bits=4)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.flag(decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), width=13), share=20)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are rebuilt (``share_openings``) before the trie is built."""
    said = read_table(spark, sf_dir, "conversations")
    turns = cut_lineage(prefix_trie.ordered_turns(said))
    nodes = prefix_trie.prefix_trie(cut_lineage(prefix_trie.share_openings(turns)), said.select(F.col("conv_id").cast("long")))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_bpe.round_trip(docs, model or tokenizer_file("piece_bpe_32k.model"), digest="ids_sha256", null_as_empty=True)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows are damaged first (``structure_repair.damage``)."""
    said = read_table(spark, sf_dir, "conversations")
    return structure_repair.repair_report(structure_repair.damage(said), said.select(F.col("conv_id").cast("long")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_quotes": op4_quotes,
    "op5_warc": op5_warc,
    "op6_licenses": op6_licenses,
    "op7_bpe": op7_bpe,
    "op8_substring": op8_substring,
    "op9_simhash": op9_simhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_pieces": op12_pieces,
    "op13_repair": op13_repair,
}
