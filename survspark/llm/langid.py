"""Language identification by compression: the language whose dictionary makes the text smallest.

Fitting concatenates a bounded sample of labelled texts to one raw-content dictionary for each
language.  Prediction compresses a whole text, in blocks, against every dictionary; the summed sizes
are compared and narrow margins are rejected.

Defined cases: a null text, or one without a letter, is ``und`` and rejected; a label seen in
training only with such texts is not learned; without any labelled text everything is ``und``;
repeated rows are predicted alike; ties go to the alphabetically first language and are rejected;
extra columns pass through, and outputs replace input columns of the same name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import crc_mod, slices, small_batches

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    """``dictionaries`` holds at most ``dict_bytes`` for each label."""

    dictionaries: dict[str, bytes]
    level: int = 6
    block_bytes: int = 1024
    tie_block_bytes: int = 64
    _made: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_made": {}}

    def compressors(self) -> dict[str, zstandard.ZstdCompressor]:
        if not self._made:
            for name in sorted(self.dictionaries):
                d = zstandard.ZstdCompressionDict(self.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._made[name] = zstandard.ZstdCompressor(
                    level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return self._made

    def _sizes(self, raw: bytes, step: int, lead: bytes = b"") -> np.ndarray:
        blocks = [lead + raw[i: i + step] for i in range(0, len(raw), step)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors().values()])

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole lower-cased text with each dictionary, in order of the labels.

        If the two smallest are equal, the sizes in much smaller blocks, where a text helps itself less
        and the dictionary more, are added; there a compressible lead keeps zstandard from storing a short
        text as it is."""
        raw = text.lower().encode()
        out = self._sizes(raw, self.block_bytes)
        low = np.sort(out)[:2]
        return out + self._sizes(raw, self.tie_block_bytes, bytes(64)) if len(low) > 1 and low[0] == low[1] else out


def fit_languages(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
                  rows_per_language: int = 400, chars_per_row: int = 300, dict_bytes: int = 110_000) -> LanguageModel:
    """Dictionaries from at most ``rows_per_language`` labelled rows of each language (the documented
    bound of the sample): those with the smallest distinct hashes of their text, so copies count once."""
    rows = df.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where(
        F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("k", F.pmod("h", F.lit(1 << 30)))
    # a bound that some 8 x rows_per_language distinct hashes of each label stay under, however many copies
    # there are: the smallest are among them, and the final ranks see that many rows for any input
    share = rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).withColumn(
        "below", F.when(F.col("n") > 8 * rows_per_language, 8.0 * rows_per_language / F.col("n")).otherwise(1.0))
    picked = (rows.join(F.broadcast(share), "l")  # one row a label
              .where(F.col("k") < F.col("below") * (1 << 30))
              .groupBy("l", "k", "h").agg(F.min(F.lower(F.substring("t", 1, chars_per_row))).alias("t"))
              .withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("k", "h")))
              .where(F.col("r") <= rows_per_language).select("l", "r", "t").collect())
    parts: dict[str, list[bytes]] = {}
    for r in sorted(picked, key=lambda r: (r["l"], r["r"])):
        parts.setdefault(r["l"], []).append(r["t"].encode())
    return LanguageModel({name: b"\n".join(p)[:dict_bytes] for name, p in parts.items()})


def predict_languages(df: DataFrame, model: LanguageModel, text: str = "text", min_margin: float = 0.0,
                      noise: float = 0.3) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (1 - smallest / second smallest size, between 0 and 1), ``margin_bytes``
    and ``rejected``: no letter, no model, a tie, a score under ``min_margin``, or a margin under ``noise`` times
    the square root of the text's UTF-8 bytes, as chance leads grow with it."""
    small_batches(df.sparkSession)
    added = {"lang_pred": "string", "score": "double", "margin_bytes": "long", "rejected": "boolean"}
    kept = [c for c in df.columns if c not in added]
    src = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*src.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in added.items()]])

    def run(batches):
        names = sorted(model.dictionaries)
        for batch in (s for whole in batches for s in slices(whole, text)):  # bounded batches go back
            out = [], [], [], []
            for t in batch.column(text):
                t = t.as_py()
                best, score, margin, bad = UNKNOWN, 0.0, 0, True
                if t is not None and names and LETTER.search(t):
                    size = model.sizes(t)
                    order = np.argsort(size, kind="stable")
                    best = names[order[0]]
                    low, high = int(size[order[0]]), int(size[order[min(1, len(order) - 1)]])
                    margin, score = high - low, 1.0 - low / high
                    if len(names) == 1:
                        score, margin = 1.0, low
                    bad = margin == 0 or score < min_margin or margin < noise * len(t.lower().encode()) ** 0.5
                for o, v in zip(out, (best, score, margin, bad)):
                    o.append(v)
            cols = [*batch.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()),
                    pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *added])

    return src.mapInArrow(run, schema)


def training_rows(df: DataFrame, folds: int = 5) -> Column:
    return crc_mod("doc_id", folds) != 0


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.where(training_rows(docs)))
    return predict_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "margin_bytes", "rejected")
