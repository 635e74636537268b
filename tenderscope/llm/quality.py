"""Quality classifier: boosted trees over native document statistics.

The statistics are DataFrame expressions. The trees are fitted on a bounded
sample of labelled rows (``max_rows``, the first in hash order), flattened into
arrays and sent to the tasks, which walk a batch of rows through all trees with
array indexing; texts never leave the JVM.

Defined results: a null text counts as empty; a statistic with an empty
denominator is 0, so empty texts get the score of all-zero statistics; labels
that are null are not learnt from, nor labels of the null id; an id that occurs
several times in the labels or the documents is learnt from once for each pair
of its rows; without labelled rows every score is 0.5;
repeated rows get equal scores; an empty table gives no rows; columns of the
input are kept, unless one is named like the score, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, WORD, let
from .trees import Forest, boosted

#: rows that the trees are fitted on, at most
MAX_ROWS = 20_000


def document_statistics(text: Column) -> dict[str, Column]:
    """Named numeric statistics of a text column."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    words = F.regexp_count(text, F.lit(WORD))
    def share(count: Column, of: Column) -> Column:
        return F.when(of > 0, count / of).otherwise(F.lit(0.0)).cast("double")
    def chars(of: str) -> Column:
        return n - F.length(F.translate(text, of, ""))
    upper = chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "log_words": F.log1p(words).cast("double"),
        "word_length": share(F.length(F.regexp_replace(text, SPACE, "")), words),
        "symbols": share(chars("#*$%&|<>"), words),
        "upper": share(upper, n),
        "digits": share(chars("0123456789"), n),
        "points": share(chars(".,;:"), words),
        "shouts": share(chars("!?"), words),
        "bars": share(chars("|"), words),
        "beyond_ascii": share(F.octet_length(text) - n, n),
        "distinct_words": let(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: share(F.size(F.array_distinct(w)), F.size(w))),
        "distinct_lines": let(lines, lambda x: share(F.size(F.array_distinct(x)), F.size(x))),
        "words_per_line": share(words, chars("\n") + 1),
    }


FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "points", "shouts", "bars", "beyond_ascii",
            "distinct_words", "distinct_lines", "words_per_line")


def _features(text_col: str) -> Column:
    stats = document_statistics(F.col(text_col))
    return F.array(*[stats[f] for f in FEATURES])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
                    max_rows: int = MAX_ROWS) -> DataFrame:
    """(features, label) of at most ``max_rows`` labelled ids, the first in hash order."""
    chosen = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label"))
              .orderBy(F.xxhash64("_id"), "_id", "label").limit(max_rows))
    # max_rows bounds the broadcast side
    return (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
            .select(F.xxhash64("_id").alias("_h"), "_id", _features("_text").alias("features"), "label"))


def fit(sample: DataFrame, max_rows: int = MAX_ROWS, **params) -> Forest:
    """Boosted trees on a sample that ``max_rows`` bounds."""
    rows = sample.orderBy("_h", "_id", "label", "features").limit(max_rows).select("features", "label").collect()
    x = np.array([r[0] for r in rows], float).reshape(len(rows), len(FEATURES))
    return boosted(x, np.array([r[1] for r in rows], float), **params)


def score(df: DataFrame, model: Forest, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` with the estimated chance of label 1."""
    return df.withColumn(out_col, _scorer(model)(_features(text_col)))


def _scorer(model: Forest):

    @F.pandas_udf(T.DoubleType())
    def scored(features: pd.Series) -> pd.Series:
        x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, len(FEATURES)))
        return pd.Series(1 / (1 + np.exp(-model.raw(x))))
    return scored
