"""Corpora to tables: documents, sentences, scores, features, and the tables made of them.

    python -m tessera.plans.pipeline MANIFEST ROOT OUT
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalise import to_text
from ..operators import checks, estimate, features, filters, order, scoring, selection, summary
from ..operators.sentences import sentence_table
from ..sources import readers, sinks


def documents(spark: SparkSession, manifest: str, root: str) -> DataFrame:
    """``corpus_id, doc_path, content`` as plain text, of all corpora of a manifest."""
    out = None
    for corpus in readers.manifest(manifest):
        include, exclude = (corpus.get(k) or [] for k in ("include", "exclude"))
        include, exclude = ([x] if isinstance(x, str) else x for x in (include or ["**/*"], exclude))
        found = readers.documents(spark, f"{root.rstrip('/')}/{corpus.get('path', corpus['id'])}", include, exclude)
        part = found.select(F.lit(corpus["id"]).alias("corpus_id"), "doc_path", to_text(F.col("doc_path"), F.col("content")).alias("content"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise checks.Violation("the manifest names no corpus")
    return out


def run(spark: SparkSession, manifest: str, root: str, out: str, scorer: scoring.Scorer | None = None) -> dict[str, DataFrame]:
    """Write every table as Parquet under ``out`` and return them by name; gates run before anything is written."""
    sentences = sinks.written(sentence_table(documents(spark, manifest, root), repaired=True), "sentences")
    checks.require(checks.duplicates(sentences, "sent_id"), "sentence ids are not unique")
    sinks.refuse_empty(sentences)
    scores = sinks.written(scoring.score(sentences.select("sent_id", F.col("sent_text").alias("text")), scorer or scoring.HashScorer()).select("sent_id", "score"), "scores")
    checks.require(checks.out_of_bounds(scores, "score", 0.0, 1.0), "scores out of bounds")
    checks.require(checks.key_mismatch({"sentences": sentences, "scores": scores}, "sent_id"), "sentences and scores differ")
    table = sinks.written(features.feature_table(sentences), "features")
    rows = sinks.written(table.join(scores, "sent_id"), "analysis")
    decisions = sinks.written(filters.strict(rows), "strict")
    ranked = selection.proxy_index(rows, ["tfidf_mean_nonzero", "technical_token_ratio", "token_count"], ["corpus_id"])
    tables = {
        "sentences": sentences,
        "scores": scores,
        "features": table.drop("doc_path", "sent_idx", "sent_text"),
        "score_stats": summary.score_stats(rows),
        "strict_score_stats": summary.score_stats(decisions.where("keep")),
        "strict_manifest": decisions.select("corpus_id", "sent_id", "keep", "reason_codes"),
        "histogram": summary.histogram(rows, "score", ("corpus_id",)),
        "spearman": estimate.spearman(rows, "score", "token_count", ["corpus_id"]),
        "divergence": selection.divergence(ranked, "score", "proxy_index", "sent_id", ["corpus_id"]),
        "ranks": order.mid_rank(rows.select("corpus_id", "sent_id", "score"), "score", ["corpus_id"]),
    }
    for name, t in tables.items():
        t.write.mode("errorifexists").parquet(f"{out.rstrip('/')}/{name}")
    return {name: spark.read.parquet(f"{out.rstrip('/')}/{name}") for name in tables}


def main(manifest: str, root: str, out: str) -> None:
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with open(manifest) as f:
        tables = run(spark, f.read(), root, out)
    for row in tables["score_stats"].orderBy("corpus_id").collect():
        print(row.asDict())


if __name__ == "__main__":
    main(*sys.argv[1:])
