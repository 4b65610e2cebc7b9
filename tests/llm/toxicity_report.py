"""python tests/llm/toxicity_report.py FOLDER...: op10 on the held-out labels of each folder of tables."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession

from plinth.llm import queries
from plinth.sources.tables import table


def report(spark: SparkSession, folder: str) -> str:
    labels = table(spark, folder, "labels").where("toxic IS NOT NULL").select("doc_id", "toxic")
    rows = queries.op10_toxicity(spark, folder).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    bad, good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic != 1]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    hit, said = sum(r.predicted and r.toxic == 1 for r in rows), sum(r.predicted for r in rows)
    return f"{folder}: {len(rows)} held out, {len(bad)} toxic, AUC {wins / max(1, len(bad) * len(good)):.2f}, precision {hit / max(1, said):.2f}, recall {hit / max(1, len(bad)):.2f}"


if __name__ == "__main__":
    session = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for path in sys.argv[1:]:
        print(report(session, path), flush=True)
