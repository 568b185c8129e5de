"""The corpus pipeline: five stages over ``documents``, each reading what the one before it wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Stages decide by row, not by id; every row that a stage does not reject is kept once for each time
it stands in its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floetrack.llm import decontaminate, hilbert, jaccard, mixing, queries, store, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The near-duplicate stage's own settings: words of a shingle, least Jaccard similarity of a link in hundredths.
STAGE_SHINGLE, STAGE_NUMERATOR, STAGE_DENOMINATOR = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled rows not held out, does not reject."""
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that links join, one row: the least by id, rows without an id last, then by text.

    Rows are told apart by id and text, so rows that share an id but no link both stay. Of rows equal in both
    one stays. Null and empty texts link with nothing and stay, all of them. Empty tables stay empty.
    """
    with store.scratch(spark):
        found = jaccard.near_duplicates(docs, shingle=STAGE_SHINGLE, numerator=STAGE_NUMERATOR, denominator=STAGE_DENOMINATOR)
        found = found.where("NOT kept OR (repeats > 1 AND n_shingles > 0)").select("id", "th1", "th2", "kept").distinct()
        found = store.materialise(found, "decisions", keep=True)
    # Texts of which no row goes stay where they are.
    met, clear = store.apart(docs.select(*[F.col(c) for c in docs.columns], *store.text_keys("text")), found, "th1")

    def same(part: DataFrame):
        return met["doc_id"].eqNullSafe(part["id"]) & (met["th1"] == part["th1"]) & (met["th2"] == part["th2"])

    once = found.where("kept")
    left = clear.unionByName(met.join(found, same(found), "left_anti")).select(*docs.columns)
    if once.isEmpty():
        return left
    # Equal rows are combined before they are moved, so many of them are no burden to one task.
    again = met.join(once, same(once), "left_semi").groupBy("doc_id", "th1", "th2").agg(F.max(F.struct(*docs.columns)).alias("row"))
    return left.unionByName(again.select("row.*").select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, or with less than a twentieth of their words in them.

    Rows are told apart by id and text; null and empty texts have no words and stay.
    """
    with store.scratch(spark):
        found = decontaminate.report(decontaminate.find(docs, queries.table(spark, sf_dir, "benchmark")), "th1", "th2")
        gone = found.where("contaminated").select(F.col("doc_id").alias("_id"), "th1", "th2").distinct()
        gone = store.materialise(gone, "contaminated", keep=True)
    met, clear = store.apart(docs.select(*[F.col(c) for c in docs.columns], *store.text_keys("text")), gone, "th1")
    left = met.join(gone, met["doc_id"].eqNullSafe(gone["_id"]) & (met["th1"] == gone["th1"]) & (met["th2"] == gone["th2"]), "left_anti")
    return clear.unionByName(left).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files in the order of the mix; the shards keep it."""
    return mixing.in_order(mixing.mix(docs)).select(*docs.columns)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard of eight and the slot in it.

    The curve decides on the shard, the order of the rows in the files of ``docs``, which is that of the mix, on
    the slot: read by its slots a shard has its sources as they are mixed. Texts are moved once.
    """
    placed = store.numbered(docs, "place")
    cut = hilbert.shard(placed.select("place", "doc_id", "text", "lang", "source"), dimensions=queries.DIMENSIONS, n_shards=8, law="rows", keep_text=False, order="place")
    return placed.join(cut.select("place", "size", "cell", "shard", "slot"), "place").select(*docs.columns, "size", "cell", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: Neither a trained network nor components of links are within SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over ``documents``, every stage written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
