"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, importance, language, licences, minhash, mixing, ngrams, oracles, phrases, pii, substrings, tokens, topk, toxicity
from ._store import work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS),
        F.sha2(pii.joined(of(*pii.BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("max_score"),
    )


#: Target weights of the mixture: named sources get more than their share of 1, all others 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0}


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a digest that SQL has, too
    digest = F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit(""))).cast("binary"))
    key = F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS, key=key)
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_release", "mix_due")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


#: Texts with more tokens than this are marked.
TOKEN_LIMIT = 2048


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    spec = tokens.read_spec(public_tokenizers.path("word_bpe_49k.json"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, ["doc_id"], work_dir(spark, "token-cache"), spec)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


#: Rows whose crc32 of the id leaves this remainder are not learned from.
LM_FOLDS, LM_HELD = 5, 1


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(LM_FOLDS)) == LM_HELD
    model = ngrams.train(docs, ~held)
    scored = ngrams.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licence_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    of = lambda c: F.transform(c, lambda x: x["label"])
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("places", lambda x: x["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        text(of("places")).alias("base_labels"),
        text(F.concat(of("places"), of("covers"))).alias("labels"),
        F.greatest("best_share", F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


#: Rows whose crc32 of the id leaves this remainder are held out of the fit.
TOXIC_FOLDS, TOXIC_HELD = 4, 2


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(TOXIC_FOLDS)) == TOXIC_HELD
    model = toxicity.fit_model(docs, _table(spark, sf_dir, "labels"), fold=~held)
    return toxicity.score(docs, model, ["doc_id"], lang="lang").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic"
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_hits(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=2, percent=80)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


#: Rows whose crc32 of the id leaves this remainder are held out of the fit.
LANG_FOLDS, LANG_HELD = 5, 0


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"), LANG_FOLDS, LANG_HELD)
    model = language.fit(docs.where(~held))
    return language.predict(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# The parts of the operators' results that SQL can express, for a comparison with it.


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of personal data."""
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def licence_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the plain phrases."""
    return op7_licences(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold, the counts and the score by single tokens."""
    return op6_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def queries() -> dict:
    return {
        "op1_repeated_substrings": op1_repeated_substrings,
        "op2_pii": op2_pii,
        "op3_mix": op3_mix,
        "op4_top_k": op4_top_k,
        "op5_token_counts": op5_token_counts,
        "op6_lm_score": op6_lm_score,
        "op7_licences": op7_licences,
        "op8_toxicity": op8_toxicity,
        "op9_decontaminate": op9_decontaminate,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_collocations": op11_collocations,
        "op12_language": op12_language,
        "op13_resample": op13_resample,
        "pii_base": pii_base,
        "licence_base": licence_base,
        "lm_base": lm_base,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
