"""The registered queries of this subpackage."""

from __future__ import annotations

import hashlib
import os
import secrets
import uuid
import warnings
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, bpe, chat, fingerprints, language_id, media, near_dup, negatives, neighbours, packing, phrases, pii, quality
from .common import id_crc, shared_dir, table
from .resharding import lay_out_anew

#: Old and new numbers of shards of op2.
OLD_SHARDS, NEW_SHARDS = 32, 40


def op2_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents from files of 32 hashed shards into files of 40 of equal bytes.

    All that is returned is read from the rewritten files; rows with another
    shard than ``old_shard`` have moved, ``least_moved`` bytes had to.
    """
    old_shard = F.coalesce(F.pmod(id_crc(), F.lit(OLD_SHARDS)).cast("int"), F.lit(0))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lay_out_anew(docs, old_shard, size, NEW_SHARDS, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    return out.select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), old_shard.alias("old_shard"), "least_moved",
    )


def tokenizer(name: str) -> str:
    """A public vocabulary's file; the folder can be set by LATTICA_TOKENIZERS."""
    folder = os.environ.get("LATTICA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def pii_key() -> bytes:
    """The secret key of pseudonyms, from LATTICA_PII_KEY; if that isn't set, one drawn for this process.

    With a drawn key equal values are linked within all that this process
    makes, and with nothing made elsewhere or later.
    """
    given = os.environ.get("LATTICA_PII_KEY")
    if given:
        return hashlib.blake2b(given.encode(), digest_size=64).digest()
    warnings.warn("LATTICA_PII_KEY isn't set; pseudonyms get a key drawn for this process", stacklevel=2)
    return secrets.token_bytes(64)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with format-preserving pseudonyms, and counts by kind."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key())


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and their decoding, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.pmod(id_crc(), F.lit(4)) == 2)
    model = language_id.fit(docs.where(~F.coalesce("held_out", F.lit(False))).select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text"), model).drop("text")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from the transcripts of all conversations.

    Roles are learned from the conversations whose crc32(conv_id) mod 4 isn't 2.
    """
    return chat.parse(table(spark, sf_dir, "conversations"), F.pmod(id_crc("conv_id"), F.lit(4)) != 2)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit samples in archives, read back and described."""
    return media.round_trip(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited versions, and their likeness."""
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in few sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every text, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(F.pmod(id_crc(), F.lit(5)) != 0).select("doc_id", "quality")
    model = quality.fit(quality.labelled(docs, labels))
    held_out = F.coalesce(F.pmod(id_crc(), F.lit(5)) == 0, F.lit(False))
    return quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingles are 80 % alike."""
    return near_dup.link(table(spark, sf_dir, "documents"), words=2, percent=80)


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of each twentieth vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of each fiftieth vector; each seventh label is off by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    good = table(spark, sf_dir, "embeddings").where(blocks.usable("embedding"))
    return negatives.mine(good.select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("v")), F.col("id") % 50 == 0)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two to four words."""
    return phrases.mine(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op3_chat": op3_chat,
    "op4_media": op4_media,
    "op5_fingerprints": op5_fingerprints,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_bpe": op9_bpe,
    "op10_near_dedup": op10_near_dedup,
    "op2_resharding": op2_resharding,
    "op11_neighbours": op11_neighbours,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_phrases": op13_phrases,
}
#: The others have no SQL; see tests/llm.
ORACLES: dict[str, str] = {
    "op11_neighbours": """
WITH good AS (SELECT vec_id::BIGINT vec_id, embedding::DOUBLE[] v, row_number() OVER () n FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM (SELECT q.n, q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v) score FROM good q JOIN good c ON c.n <> q.n AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0) QUALIFY rank <= 20""",
    "op12_hard_negatives": """
WITH good AS MATERIALIZED (SELECT vec_id::BIGINT id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v, row_number() OVER () n
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (SELECT a.n an, a.id anchor_id, c.n cn, c.id, a.label = c.label same, list_inner_product(a.v, c.v)::BIGINT score FROM good a JOIN good c ON c.n <> a.n AND len(c.v) = len(a.v) WHERE a.id % 50 = 0),
positives AS (SELECT an, anchor_id, cn pn, id positive_id, score positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY an ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY an, pn ORDER BY score DESC, id)::INT AS rank, id negative_id, positive_score, score negative_score
FROM positives p JOIN pairs USING (an, anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
    "op13_phrases": r"""
WITH t AS (SELECT row_number() OVER () d, coalesce(lang, 'und') lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') parts FROM documents),
p AS (SELECT d, lang, generate_subscripts(parts, 1) k, regexp_extract_all(unnest(parts), '[^\x20\x09]+') words FROM t),
w AS (SELECT d, lang, k, generate_subscripts(words, 1) i, unnest(words) w1 FROM p),
g AS (SELECT lang, w1, lead(w1, 1) OVER s w2, lead(w1, 2) OVER s w3, lead(w1, 3) OVER s w4 FROM w WINDOW s AS (PARTITION BY d, k ORDER BY i)),
f AS MATERIALIZED (SELECT lang, [w1] ws, count(*) f FROM g GROUP BY ALL UNION ALL SELECT lang, [w1, w2], count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, ws, f a FROM f WHERE len(ws) > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.ws, c.a, k, x.f l, y.f r, (2000000::HUGEINT * c.a) // (x.f + y.f) score FROM c, range(1, 4) q(k) JOIN f x ON x.lang = c.lang AND x.ws = c.ws[:k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[k + 1:] WHERE k < len(c.ws)),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
cover AS (SELECT lang, ws[i:j] ws, max(a) most FROM c, range(1, 5) x(i), range(1, 5) y(j) WHERE i < j AND j <= len(ws) AND j - i + 1 < len(ws) GROUP BY ALL),
n AS (SELECT lang, count(*)::BIGINT n FROM w GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(ws, ' '))) AS rank, array_to_string(ws, ' ') phrase, a::BIGINT a, l::BIGINT l, r::BIGINT r, n, score::BIGINT score
FROM low LEFT JOIN cover USING (lang, ws) JOIN n USING (lang) WHERE most IS NULL OR 100 * most < 80 * a QUALIFY rank <= 2000""",
}
