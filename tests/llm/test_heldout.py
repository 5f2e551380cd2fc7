"""The trained operators on labelled rows that their weights never saw."""

import os

import pandas as pd
import pytest
from kinledger.llm import quality, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def area(label: pd.Series, score: pd.Series) -> float:
    """The share of pairs of a row with label 1 and one with label 0 that the scores order rightly."""
    good = label.sum()
    return (score.rank()[label > 0].sum() - good * (good + 1) / 2) / (good * (len(label) - good))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity(spark, labels):
    rows = toxicity.op3_toxicity(spark, SF).join(labels, "doc_id").where("held_out and toxic is not null").toPandas()
    found = area(rows.toxic, rows.score)
    print(f"toxicity: {len(rows)} rows, area {found:.4f}")
    assert found >= 0.9
    print(f"recall {rows.predicted[rows.toxic == 1].mean():.4f}, false positives {rows.predicted[rows.toxic == 0].sum()} of {(rows.toxic == 0).sum()}")
    assert rows.predicted[rows.toxic == 1].mean() >= 0.8 and rows.predicted[rows.toxic == 0].mean() <= 0.1


def test_quality(spark, labels):
    """The fold that neither trains nor calibrates."""
    fold = labels.where(toxicity.held_out(F.col("doc_id")))
    rows = quality.op10_quality(spark, SF).join(fold, "doc_id").where("quality is not null").toPandas()
    found = area(rows.quality, rows.quality_probability)
    good, bad = rows.kept[rows.quality == 1].mean(), rows.kept[rows.quality == 0].mean()
    print(f"quality: {len(rows)} rows, area {found:.4f}, kept {good:.4f} of the good and {bad:.4f} of the others")
    assert found >= 0.9 and good >= 0.9 and bad <= 0.2
