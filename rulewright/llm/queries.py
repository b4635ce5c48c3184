"""The corpus operators as registered queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm import chat_format, clustering, decontaminate, edit_counts, language_id, packing, quality_classifier, quality_rules, runs, sharding, simhash, suffix_tree, toxicity
from rulewright.llm.common import id_remainder, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 7) == 2
    return suffix_tree.score(documents, ~held_out).withColumn("held_out", held_out)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "longest", "longest_item", "longest_start")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def sample_edits(documents: DataFrame) -> DataFrame:
    """doc_id, text and two edits a document: a replacement a third in, and an insertion at the middle of what results."""
    n = F.length(F.coalesce("text", F.lit("")))
    note = F.concat(F.lit(" [edited "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("]"))
    edits = F.array(*(F.struct(a.cast("long").alias("start"), F.lit(b).cast("long").alias("length"), c.alias("insert")) for a, b, c in ((F.floor(n / 3), 17, note), (F.floor(n / 2), 0, F.lit("so it  goes\non, ")))))
    return documents.select("doc_id", "text", edits.alias("edits"))


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.apply_edits(sample_edits(table(spark, sf_dir, "documents")), tokenizer_path()).drop("text_after", "leaf_chars", "leaf_tokens")


def toxicity_model(spark: SparkSession, documents: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.train(documents, labels.where(id_remainder(F.col("doc_id"), 4) != 2))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = toxicity.score(documents, toxicity_model(spark, documents, sf_dir))
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    weights = quality_classifier.train(documents, labels.where(id_remainder(F.col("doc_id"), 5) != 0))
    found = quality_classifier.score(documents, weights)
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def conversations_with_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts look like control strings."""
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = chat_format.format_windows(conversations_with_probe(spark, sf_dir))
    read = windows.select("conv_id", F.struct("window", chat_format.read_turns(F.col("text"), F.col("repeated")).alias("turns"), chat_format.read_loss(F.col("text"), F.col("loss")).alias("loss"), F.length("text").alias("chars")).alias("w"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w")).select("conv_id", F.flatten("w.turns").alias("turns"), F.array_join("w.loss", "").alias("loss"), F.aggregate("w.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    model = language_id.train(documents.where(~held_out))
    return language_id.predict(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def with_repeats(documents: DataFrame) -> DataFrame:
    """doc_id and text; of every document whose crc32(doc_id) is divisible by ten, words from a place of its own on repeat with a period of its own."""
    mark = id_remainder(F.col("doc_id"), 1 << 32)
    words = F.array_remove(F.split("text", "[ \\x09-\\x0D]+"), "")
    g, n = F.floor(mark / 10), F.size("w")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    at = lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    repeated = documents.select("doc_id", "text", F.when((mark % 10 == 0) & F.col("text").isNotNull(), words).alias("w"), g.alias("g"))
    repeated = repeated.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    return repeated.select("doc_id", F.when(n > 0, F.array_join(F.transform("w", at), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_repeats(table(spark, sf_dir, "documents")))
    # the greatest length, then the smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best)).withColumns({"start": -F.col("best.back"), "length": F.col("best.length"), "period": -F.col("best.short")})
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_inertia(*clustering.cluster(table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_packing, op2_simhash, op3_suffix_tree, op4_decontamination, op5_quality_rules, op6_edit_counts, op7_toxicity, op8_quality_classifier, op9_chat_format, op10_language_id, op11_periodic_runs, op12_sharding, op13_centroid_clustering)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def _kmeans_sql(k: int = 16, rounds: int = 3) -> str:
    """op13's rows: vectors unnested by component, and a common table for each round."""
    steps = [
        """v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    nearest = "SELECT vec_id, x, min(d) AS distance, arg_min(c, (d, c)) AS c FROM (SELECT vec_id, v.x, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v CROSS JOIN {centroids} c) GROUP BY vec_id, x"
    for r in range(rounds):
        steps.append(f"a{r} AS ({nearest.format(centroids=f'c{r}')})")
        steps.append(f"m{r} AS (SELECT c, list(floor(s / n)::BIGINT ORDER BY i) AS x FROM (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY c, i) GROUP BY c)")
        steps.append(f"c{r + 1} AS (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c))")
    steps.append(f"z AS ({nearest.format(centroids=f'c{rounds}')})")
    return f"WITH {', '.join(steps)} SELECT vec_id, z.c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY z.c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(e.x, ',')) AS centroid_sha256 FROM z JOIN c{rounds} e ON e.c = z.c"


def oracle_sql() -> dict[str, str]:
    return {"op13_centroid_clustering": _kmeans_sql()}
