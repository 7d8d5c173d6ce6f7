"""Sources and sinks, as round trips through the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.catalog.entry import query
from labelloom.catalog.evaluation import SQL_HOLDOUT, SQL_RANKED, SQL_REPORT, rounded, sql_classes
from labelloom.catalog.inputs import SQL_CLASSIFIED, SQL_SENTENCES, bare_sentences, classified, table
from labelloom.operators import evaluate as E
from labelloom.operators.split import stratified_split
from labelloom.session import scratch_path
from labelloom.sources import sinks, tables
from labelloom.sources.label_files import read_label_file

SENTENCES = "title string, review_id long, sentence_id long, text string, label_m int"


@query("s1_csv", f"WITH {SQL_SENTENCES} SELECT * FROM bare")
def csv(spark, folder):
    path = scratch_path(spark, "csv")
    sinks.write_csv(bare_sentences(spark, folder), path)
    return tables.read_csv(spark, path, SENTENCES, multi_line=True)


@query("s2_tsv", f"WITH {SQL_CLASSIFIED} SELECT text, label FROM cls")
def tsv(spark, folder):
    path = scratch_path(spark, "tsv")
    raw = classified(spark, folder).select(F.col("text").alias("Text"), F.col("label").alias("LABEL"))
    sinks.write_tsv(raw, path)
    return tables.read_tsv(spark, path, "Text string, LABEL int", multi_line=True)


@query("s3_semicolon", f"WITH {SQL_SENTENCES} SELECT * FROM bare")
def semicolon(spark, folder):
    path = scratch_path(spark, "semicolon")
    sinks.write_delimited(bare_sentences(spark, folder), path, tables.SEMICOLON)
    return tables.read_semicolon(spark, path, SENTENCES, multi_line=True)


@query(
    "s4_label_file",
    "SELECT row_number() OVER (ORDER BY doc_id) AS review_order, CAST(quality + toxic AS INTEGER) AS label FROM labels",
)
def label_file(spark, folder):
    path = scratch_path(spark, "labels")
    word = F.element_at(F.array(F.lit(" Negativno"), F.lit("neutral\n"), F.lit("2 ")), F.col("quality") + F.col("toxic") + 1)
    lines = table(spark, folder, "labels").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    lines.select(word.alias("value")).write.text(path)
    return read_label_file(spark, path)


@query("s5_parquet", "SELECT doc_id, lang, source, n_chars FROM documents")
def parquet(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")


@query(
    "k1_csv_write",
    f"WITH {SQL_CLASSIFIED} SELECT text, prediction AS prediction_label, label AS truth_label FROM cls",
)
def csv_write(spark, folder):
    path = scratch_path(spark, "predictions")
    sinks.write_csv(E.prediction_table(classified(spark, folder), "text", "label", "prediction"), path)
    return tables.read_csv(spark, path, "text string, prediction_label int, truth_label int", multi_line=True)


@query(
    "k2_split_write",
    f"WITH {SQL_CLASSIFIED}, {SQL_RANKED}, {SQL_HOLDOUT} SELECT text, placed.label, split FROM placed JOIN cls USING (doc_id)",
)
def split_write(spark, folder):
    path = scratch_path(spark, "splits")
    sinks.write_splits(stratified_split(classified(spark, folder).select("doc_id", "text", "label"), "label", "doc_id"), path)
    parts = [
        tables.read_csv(spark, f"{path}/split={s}", "text string, label int", multi_line=True).withColumn("split", F.lit(s))
        for s in ("train", "val", "test")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("k3_tsv_write", f"WITH {SQL_SENTENCES} SELECT * FROM bare")
def tsv_write(spark, folder):
    path = scratch_path(spark, "tsv")
    sinks.write_tsv(bare_sentences(spark, folder), path)
    return tables.read_tsv(spark, path, SENTENCES, multi_line=True)


@query(
    "k6_metric_report",
    f"""WITH {sql_classes('lang')}, {SQL_REPORT}
        SELECT dataset, metric, class, round(value, 6) AS value FROM (
          SELECT dataset, 'precision' AS metric, class, precision AS value FROM report UNION ALL
          SELECT dataset, 'recall', class, recall FROM report UNION ALL
          SELECT dataset, 'f1', class, f1 FROM report UNION ALL
          SELECT dataset, 'support', class, CAST(support AS DOUBLE) FROM report) WHERE value IS NOT NULL""",
)
def metric_report(spark, folder):
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(E.metric_table(classified(spark, folder), "label", "prediction", "lang"), path)
    return rounded(spark.read.schema("dataset string, metric string, class string, value double").json(path))
