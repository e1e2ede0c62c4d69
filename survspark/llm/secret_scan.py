"""Secret scan: fixed patterns plus a battery of randomness tests on token-like runs.

All of it is DataFrame functions.  Every run of 20 or more token characters is a candidate.  Its
encoding is inferred from its characters; then, with the characters as numbers of that alphabet,

* chi-squared test of uniform use of the alphabet,
* Wald-Wolfowitz runs test about the alphabet's middle,
* lag-one serial correlation

give p-values for "random", combined by Fisher's method.  The other hypothesis is "ordinary token of
the same encoding and length": the same three properties (use of the alphabet, runs, serial product), and
the changes of character class, are fitted on ordinary tokens (``ordinary``) and their weighted sum gives
one p-value.  A candidate is a discovery if "ordinary" falls under Benjamini-Hochberg control within its
band of lengths and "random" stands.

Defined cases: a null text is empty and has no spans; a text of any length is scanned whole; equal
starts are ordered by kind as listed; repeated rows are scanned alike, each for itself; an empty table
gives an empty result; extra columns are ignored (the operator reads ``doc_id`` and ``text``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.scalar import norm_sf
from . import ordinary
from .common import let, stored
from .spans import match_spans

#: Kinds in the order of ties; the method's own spans come last.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run is one match, so the least length can be part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: (name, pattern of the whole token, alphabet): the first that fits is the inferred encoding.
ENCODINGS = [
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", r"^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]


def find_spans(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, base spans with kind, candidates) of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = lambda spans, kind: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))
    assign = F.filter(match_spans(F.col("text"), ASSIGN),
                      lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 12)
    raw = docs.select(F.col("doc_id"), text.alias("text")).select(
        "doc_id", assign.alias("a"), match_spans(F.col("text"), ACCESS).alias("k"),
        match_spans(F.col("text"), HEX).alias("h"), match_spans(F.col("text"), CANDIDATE).alias("c"))
    return raw.select(
        F.monotonically_increasing_id().alias("row_key"), "doc_id",
        F.concat(named(F.col("a"), "assign"), named(F.col("k"), "access"), named(F.col("h"), "hex")).alias("base"),
        F.col("c").alias("candidates"))


def _two_sided(z: Column) -> Column:
    return F.greatest(F.lit(2.0) * norm_sf(F.abs(z)), F.lit(1e-300))


def battery(tokens: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``encoding``, ``p_random`` (Fisher's combination) and ``p_ordinary`` to rows with a token."""
    v = F.col(value)
    which = F.lit(len(ENCODINGS) - 1)
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        which = F.when(v.rlike(pattern), i).otherwise(which)
    fits = [ordinary.fit(name, letters) for name, _, letters in ENCODINGS]
    numbers = lambda x: "array(%s)" % ",".join(f"{y!r}D" for y in x)
    of = lambda rows: F.element_at(F.expr("array(%s)" % ",".join(map(numbers, rows))), F.col("_i") + 1)
    text_of = lambda x: F.element_at(F.array(*[F.lit(y) for y in x]), F.col("_i") + 1)
    df = let(tokens, _i=which, _n=F.length(v).cast("double"))
    df = let(df, encoding=text_of([e[0] for e in ENCODINGS]), _abc=text_of([e[2] for e in ENCODINGS]), _use=of([f.use for f in fits]),
             _rank=of([f.rank for f in fits]), _fit=of([[*f.weights, f.mu, *f.spread] for f in fits]))
    each = f"transform(sequence(1, length(`{value}`)), i -> %s)"
    kind = "case when substr(`%s`, i, 1) rlike '[0-9]' then 0 when substr(`%s`, i, 1) rlike '[a-z]' then 1 when substr(`%s`, i, 1) rlike '[A-Z]' then 2 else 3 end"
    df = let(df, _k=F.length("_abc").cast("double"),
             _x=F.expr(each % f"cast(locate(substr(`{value}`, i, 1), _abc) - 1 as double)"),
             _r=F.expr(each % f"_rank[locate(substr(`{value}`, i, 1), _abc) - 1]"),
             _fitted=F.expr("_fit[0] * " + "aggregate(" + each % f"_use[locate(substr(`{value}`, i, 1), _abc) - 1]" + ", 0D, (a, y) -> a + y)"),
             _class=F.expr(each % (kind % (value, value, value))))
    pairs = "zip_with(slice({0}, 1, size({0}) - 1), slice({0}, 2, size({0}) - 1), (y, z) -> {1})"
    df = let(df, _squares=F.expr("aggregate(sequence(0, cast(_k as int) - 1), 0D, (a, c) -> a + pow(size(filter(_x, y -> y = c)), 2))"),
             _mean=F.expr("aggregate(_x, 0D, (a, y) -> a + y) / _n"),
             _high=F.expr("cast(size(filter(_x, y -> y >= _k / 2)) as double)"),
             _runs=F.expr("1D + size(filter(" + pairs.format("_x", "(y >= _k / 2) <> (z >= _k / 2)") + ", b -> b))"),
             _changes=F.expr("cast(size(filter(" + pairs.format("_class", "y <> z") + ", b -> b)) as double)"))
    df = let(df, _var=F.expr("aggregate(_x, 0D, (a, y) -> a + (y - _mean) * (y - _mean))"),
             _cov=F.expr("aggregate(" + pairs.format("_x", "(y - _mean) * (z - _mean)") + ", 0D, (a, y) -> a + y)"),
             _chi=F.expr("greatest(_k / _n * _squares - _n, 0D)"), _df=F.expr("_k - 1"),
             _em=F.expr("1 + 2 * _high * (_n - _high) / _n"))
    knot = " ".join(f"when _n >= {m} then _fit[{5 + i}]" for i, m in reversed(list(enumerate(ordinary.KNOTS))))
    z = F.expr("(_fitted + _fit[1] * size(filter(" + pairs.format("_r", "(y > 0) <> (z > 0)") + ", b -> b)) + _fit[2] * aggregate("
               + pairs.format("_r", "y * z") + f", 0D, (a, y) -> a + y) + _fit[3] * _changes - _fit[4] * _n) / (sqrt(_n) * case {knot} else _fit[5] end)")
    df = let(df, _z1=F.expr("(pow(_chi / _df, 1D / 3) - (1 - 2 / (9 * _df))) / sqrt(2 / (9 * _df))"),  # Wilson-Hilferty
             _z2=F.expr("case when _em > 2 then (_runs - _em) / sqrt((_em - 1) * (_em - 2) / (_n - 1)) else 9D end"),
             _z3=F.expr("case when _var > 0 then _cov / _var * sqrt(_n) else 9D end"), _z4=z)
    df = let(df, _half=-(F.log(F.greatest(norm_sf(F.col("_z1")), F.lit(1e-300))) + F.log(_two_sided(F.col("_z2")))
                         + F.log(_two_sided(F.col("_z3")))))
    df = let(df, p_random=F.expr("exp(-_half) * (1 + _half + _half * _half / 2)"),  # chi-squared, 6 degrees
             p_ordinary=F.greatest(norm_sf(F.col("_z4")), F.lit(1e-300)))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def discoveries(tested: DataFrame, q: float = 0.001, alpha: float = 1e-4) -> DataFrame:
    """Rows where "ordinary" is rejected at false-discovery rate ``q`` among tokens of similar length
    (bands by powers of two) while "random" is not rejected at ``alpha``.

    The step-up rule runs on a histogram of p-values (quarter decades), whose size does not grow with
    the rows; the upper edge of a step is used, so control holds.
    """
    t = tested.withColumn("band", F.floor(F.log2(F.length("value")))).withColumn(
        "step", F.floor(-F.log10("p_ordinary") * 4).cast("int"))
    hist = t.groupBy("band", "step").agg(F.count("*").alias("n"))
    w = Window.partitionBy("band")
    limit = (hist.withColumn("rank", F.sum("n").over(w.orderBy(F.desc("step"))))
             .withColumn("m", F.sum("n").over(w))
             .where(F.pow(F.lit(10.0), -F.col("step") / 4) <= q * F.col("rank") / F.col("m"))
             .groupBy("band").agg(F.min("step").alias("least")))  # one row for each power of two
    return t.join(F.broadcast(limit), "band").where(
        (F.col("step") >= F.col("least")) & (F.col("p_random") >= alpha)).drop("step", "least")


def scan_secrets(docs: DataFrame, q: float = 0.001, alpha: float = 1e-4) -> DataFrame:
    """One row for each row of ``docs``: ``base`` and ``spans``, sorted arrays of (start, kind, end), with
    kind as its place in ``KINDS``.  Discoveries that overlap a base span are not reported again."""
    found = stored(find_spans(docs), "secret_spans")
    # a run inside an assignment or a hex run belongs to that span already
    tokens = found.select("row_key", "base", F.explode("candidates").alias("c")).where(
        F.expr("not exists(base, b -> b.start < c.end and c.start < b.end)")).select("row_key", "c.start", "c.end", "c.value")
    extra = discoveries(battery(tokens), q, alpha).groupBy("row_key").agg(F.collect_list(F.struct(
        "start", F.lit(KINDS.index("random")).alias("kind"), "end")).alias("extra"))
    return found.join(extra, "row_key", "left").select(
        "doc_id", F.array_sort("base").alias("base"),
        F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def span_text(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"),
                      F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
