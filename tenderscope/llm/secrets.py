"""Secret scan: candidate strings, judged by a random forest.

Candidates are long runs of key characters, values assigned to a name that
speaks of a credential, and private-key headers. A candidate's features are its
length, its character transitions, how much of its letters dictionary words
cover, its path, and its neighbouring words. The dictionary is made of the words
that hold at least ``DICTIONARY_SHARE`` of all words of the corpus, counted over
all rows; by that share it has at most 1 / DICTIONARY_SHARE entries.

The forest is fitted on labelled findings: (features, label) rows, at most
``max_findings`` of each label, the first in hash order. ``annotate`` labels the
findings whose nature their surroundings settle (a mixed value assigned to a
credential name is one, a plain word, number or dictionary compound elsewhere is
not) and leaves the others to the forest. Both labels come with the surroundings
blanked out as well, so that a key without its name is still recognised.

Defined results: a null or empty text has no candidates; null ids and paths are
kept; repeated rows give repeated findings; an empty table gives no rows; without
labelled findings of both kinds the forest gives one score to all (0 without any);
further columns are ignored by ``scan`` and kept by ``redact``; texts are read
whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, written
from .trees import Forest, random_forest

DICTIONARY_SHARE = 1e-5
MAX_FINDINGS = 10_000

#: names that speak of a credential
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "credential",
         "private_key", "bearer")
#: path parts of places that hold examples
EXAMPLES = ("test", "example", "sample", "doc", "demo", "mock", "fixture")

_CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?i:(?:" + "|".join(NAMES) + r")[\w.-]{0,30}[\"']?\s{0,4}(?:=|:)\s{0,4}[\"']?)(?P<value>[^\s\"'|]{8,})"
    r"|[A-Za-z0-9+/_=-]{16,}")
_NAMED = re.compile(r"(?i:(?:" + "|".join(NAMES) + r")[\w.-]{0,30}[\"']?\s{0,4}(?:=|:)\s{0,4}[\"']?)$")
_AROUND = 48

FEATURES = ("length", "distinct", "entropy", "digits", "upper", "lower", "marks", "changes", "digit_letter", "lower_upper",
            "vowel_pairs", "coverage", "longest_run", "hex", "assigned", "named", "quoted", "word_before", "word_after",
            "path_example", "path_depth")


def candidates(text: str):
    """(start, end) of the candidate strings of a text, in order."""
    for m in _CANDIDATE.finditer(text):
        yield m.span("value") if m.group("value") else m.span()


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of the letters of ``value`` that dictionary words of 3 letters or more cover, longest first from the left."""
    letters = covered = 0
    for run in re.findall(r"[a-z]+", value.lower()):
        letters, k = letters + len(run), 0
        while k < len(run):
            n = next((n for n in range(min(8, len(run) - k), 2, -1) if run[k:k + n] in words), 0)
            covered, k = covered + n, k + max(n, 1)
    return covered / letters if letters else 0.0


def features(value: str, before: str, after: str, path: str, words: frozenset[str]) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "m" for c in value]
    counts = np.array([value.count(c) for c in set(value)], float) / n
    pairs = list(zip(kinds, kinds[1:]))
    vowels = [c in "aeiouAEIOU" for c in value]
    run = longest = 0
    for a in kinds:
        run = run + 1 if a in "lu" else 0
        longest = max(longest, run)
    left, right = before.split()[-2:], after.split()[:2]
    path = path.lower()
    return [n, len(set(value)) / n, float(-(counts * np.log2(counts)).sum()), kinds.count("d") / n, kinds.count("u") / n,
            kinds.count("l") / n, kinds.count("m") / n, sum(a != b for a, b in pairs) / max(n - 1, 1),
            sum("d" in p and p[0] != p[1] for p in pairs) / max(n - 1, 1), sum({*p} == {"l", "u"} for p in pairs) / max(n - 1, 1),
            sum(a != b for a, b in zip(vowels, vowels[1:])) / max(n - 1, 1), coverage(value, words), longest / n,
            sum(c in "0123456789abcdefABCDEF" for c in value) / n, float(bool(re.search(r"[=:]\s*[\"']?$", before))),
            float(bool(_NAMED.search(before))), float(before[-1:] in "\"'" and before[-1:] != ""),
            float(bool(left) and left[-1].isalpha()), float(bool(right) and right[0].strip("\"'.,;").isalpha()),
            float(any(x in path for x in EXAMPLES)), float(path.count("/"))]


def annotate(values: list[float], private_key: bool) -> int | None:
    """The label that a finding's surroundings settle, or none."""
    f = dict(zip(FEATURES, values))
    mixed = f["digits"] > 0 and f["lower"] + f["upper"] > 0
    if private_key or f["named"] and (mixed and f["entropy"] > 2.5 or f["coverage"] < 0.3 and f["entropy"] > 3):
        return 1
    if not f["named"] and (f["digits"] + f["marks"] == 1 or f["coverage"] > 0.5 or f["digits"] == 0 and not f["assigned"]):
        return 0
    return None


def dictionary(df: DataFrame, text_col: str = "text", share: float = DICTIONARY_SHARE) -> frozenset[str]:
    """Words of 3 to 8 letters that hold at least ``share`` of all such words: at most 1 / share of them."""
    words = (df.select(F.explode(F.split(F.lower(F.col(text_col)), "[^a-z]+")).alias("w"))
             .where(F.length("w").between(3, 8)).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    words = written(words)
    total = words.agg(F.sum("n")).first()[0] or 0
    return frozenset(r[0] for r in words.where(F.col("n") >= max(2.0, share * total)).select("w").collect())


def scan(df: DataFrame, words: frozenset[str], id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
         keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per candidate: id, start, length, value, label (null: open), features; ``keep`` names columns to carry."""
    import pyarrow as pa

    batches_of(df.sparkSession, 500)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), path.alias("path"), *keep)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("value", T.StringType()),
                           T.StructField("label", T.IntegerType()), T.StructField("features", T.ArrayType(T.FloatType()))]
                          + [rows.schema[k] for k in keep])
    dictionary_words = df.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        known = dictionary_words.value
        for batch in batches:
            at, out = [], []
            for k, (text, where) in enumerate(zip(batch.column("text").to_pylist(), batch.column("path").to_pylist())):
                for a, b in candidates(text):
                    found = features(text[a:b], text[max(0, a - _AROUND):a], text[b:b + _AROUND], where, known)
                    at.append(k)
                    out.append((a, b - a, text[a:b], annotate(found, text[a:b].startswith("-----BEGIN")), found))
            at = pa.array(at, pa.int64())
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float32())))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), *columns, *[batch.column(c).take(at) for c in keep]],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


def fit(findings: DataFrame, max_findings: int = MAX_FINDINGS, **params) -> Forest:
    """A forest on at most ``max_findings`` labelled findings of each label."""
    rows = []
    for label in (0, 1):
        chosen = findings.where(F.col("label") == label).select("id", "start", "value", "features", "label")
        # by finding, not by value: a value with many copies takes its share only
        rows += chosen.orderBy(F.xxhash64("id", "start", "value"), "id", "start", "value").limit(max_findings).collect()
    x = np.array([r["features"] for r in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([r["label"] for r in rows], float)
    alone = x.copy()
    alone[:, [FEATURES.index(f) for f in ("assigned", "named", "quoted", "word_before", "word_after")]] = 0.0
    return random_forest(np.vstack((x, alone)), np.concatenate((y, y)), **params)


def judge(findings: DataFrame, model: Forest, threshold: float = 0.5) -> DataFrame:
    """``findings`` with score and is_secret."""

    @F.pandas_udf(T.DoubleType())
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.stack(x.to_numpy()).astype(float)) if len(x) else [], dtype=float)
    return findings.withColumn("score", F.round(scored("features"), 9)).withColumn("is_secret", F.col("score") >= threshold)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
                 max_findings: int = MAX_FINDINGS) -> DataFrame:
    """All candidates of ``df`` with score and is_secret."""
    found = written(scan(df, dictionary(df, text_col), id_col, text_col, path_col))
    return judge(found, fit(found, max_findings)).withColumnRenamed("id", id_col)


def redact_found(df: DataFrame, judged: DataFrame, key: Column, text_col: str = "text", mark: str = "[SECRET]",
                 broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``df`` with the confirmed secrets of ``judged`` replaced by ``mark``, in the JVM: no text is scanned again.

    ``key`` is the id under which ``judged`` names a row of ``df``: rows that share a
    key must share their text."""
    spans = written(judged.where("is_secret").groupBy(F.col("id").alias("_id"))
                    .agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("_spans")))
    n, total = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_spans")), F.lit(0))).first()
    if 100 * n + 32 * total <= broadcast_bytes:  # an id and 16 bytes a span, and what a hash table adds; beyond, a shuffled join
        spans = F.broadcast(spans)
    text = F.col(text_col)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("s"))
    done = F.aggregate("_spans", begin, lambda acc, x: F.struct(
        (x["start"] + x["length"]).alias("at"),
        F.concat(acc["s"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("s")))
    rest = F.substring(text, (done["at"] + 1).cast("int"), F.length(text))
    return (df.withColumn("_key", key).join(spans, F.col("_key").eqNullSafe(F.col("_id")), "left")
            .withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(F.concat(done["s"], rest)))
            .drop("_key", "_id", "_spans"))


def redact(df: DataFrame, words: frozenset[str], model: Forest, text_col: str = "text", path_col: str | None = "source",
           mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """``df`` with each confirmed secret in the text replaced by ``mark``."""

    batches_of(df.sparkSession, 500)
    known = df.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf(T.StringType())
    def cleaned(texts: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for text, path in zip(texts, paths):
            spans = list(candidates(text)) if text else []
            if spans:
                x = [features(text[a:b], text[max(0, a - _AROUND):a], text[b:b + _AROUND], path, known.value) for a, b in spans]
                sure = np.round(model.raw(np.array(x, np.float32).astype(float)), 9) >= threshold
                for (a, b), secret in reversed(list(zip(spans, sure))):
                    text = text[:a] + mark + text[b:] if secret else text
            out.append(text)
        return pd.Series(out, dtype=object)

    path: Column = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    return df.withColumn(text_col, cleaned(F.col(text_col), path))
