"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor
kept, and returns a DataFrame. All but the last return the columns of
``documents``. ``run`` writes every stage's result to the shared folder and reads
it back, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm import decontaminate, jaccard, packing, secret_scan, shared, toxicity


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is trained on the labelled documents among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return toxicity.clean(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal or linked texts stays; documents without a text stay.

    Of rows that repeat a document's id and text, the first by the other columns, in their order, missing values first, stays.
    """
    classes = jaccard.jaccard_links(docs)
    kept = classes.filter(F.col("text_md5") == F.col("class_md5")).select("class_id", "class_md5").distinct()
    kept = kept.select(F.struct("class_id", "class_md5").alias(name := shared.fresh(docs, "kept")[0]))
    (md5,) = shared.fresh(docs, "md5")
    named = docs.withColumn(md5, F.md5("text"))
    match = (F.col(md5) == F.col(f"{name}.class_md5")) & F.col("doc_id").eqNullSafe(F.col(f"{name}.class_id"))
    # rows that repeat a document's id and text are one document; the digest stands for the text
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    (nth,) = shared.fresh(named, "nth")
    first = Window.partitionBy(md5, "doc_id").orderBy(*others or [F.lit(0)])
    chosen = named.join(kept, match, "left_semi").withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1)
    return _columns(chosen, docs).unionByName(docs.filter(F.col("text").isNull()))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, benchmark)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mark; n_chars is counted anew where it is known."""
    repository, spans = shared.fresh(docs, "repository", "secrets")
    named = docs.withColumn(repository, F.concat_ws("/", "source", "lang"))
    found = secret_scan.scan(named, "source", repository, carry=tuple(docs.columns), into=spans)
    text = F.when(F.col("text").isNotNull(), secret_scan.redacted(F.col("text"), F.col(spans)))
    changed = found.withColumn("text", text)
    length = F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return _columns(changed.withColumn("n_chars", length), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs, special=True), loss="loss")


STAGES = [
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", leaks),
    ("secret scans", secrets),
    ("packing", packed),
]

#: SQL cannot express trained models, MinHash pruning or byte-pair encoding; tests/llm has brute-force checks
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
