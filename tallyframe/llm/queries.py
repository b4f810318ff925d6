"""The registered query of each operator: the whole intended table, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import chat
from tallyframe.llm.decontaminate import overlaps
from tallyframe.llm.host_rules import host_quality
from tallyframe.llm.line_templates import drop_recurring_lines
from tallyframe.llm.minhash import near_duplicates
from tallyframe.llm.oracles import ORACLE_SQL  # noqa: F401  read by the entry module
from tallyframe.llm.packing import pack
from tallyframe.llm.ppm import score
from tallyframe.llm.prefix_trie import rebuilt_trie
from tallyframe.llm.secrets import KINDS, find_secrets
from tallyframe.llm.shared import table
from tallyframe.llm.url_filter import judge
from tallyframe.llm.warc import archived
from tallyframe.llm.whitening import whiten
from tallyframe.llm.wrapper import extract_text


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    digest = F.sha2(joined(of("assign", "access", "hex")), 256).alias("base_sha256")
    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", *counts[:3], digest, joined("spans").alias("spans"), counts[3])


def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = host_quality(docs, drop_text=True)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "soft_failed", "host_bad", "host_rate"]
    out = out.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])
    return out.withColumn("host_rate", F.round("host_rate", 9))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), drop_html=True)
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", *[F.col(f"judged.{n}").alias(n) for n in ("host", "path", "rule", "verdict", "blocked_probability")])


#: A conversation whose texts hold the template's own control strings.
ADVERSARIAL = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(ADVERSARIAL, "conv_id long, turn long, role string, text string"))
    loss = chat.loss_text(F.col("turns"))
    return chat.format_conversations(turns).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(chat.source_text(F.col("turns")), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=85).drop("text_key")


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where a long can't hold it; deviation_exact has it then."""
    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = out.select("vec_id", "whitening", F.posexplode("whitening.whitened").alias("k", "whitened"))
    return each.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        "whitening.n",
        F.expr("try_cast(whitening.deviation as bigint)").alias("deviation"),
        "whitened",
        F.col("whitening.explained")[F.col("k")].alias("explained"),
        "whitening.identity_error",
        F.col("whitening.deviation").alias("deviation_exact"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_line_dedup,
        op3_ppm_scores,
        op4_secret_scan,
        op5_host_quality,
        op6_html_extraction,
        op7_url_filter,
        op8_chat_formatting,
        op9_minhash_near_dedup,
        op10_harmonic_packing,
        op11_warc_archives,
        op12_conversation_trie,
        op13_embedding_whitening,
    )
}
