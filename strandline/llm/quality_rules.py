"""Quality rules: base counts and a hashed n-gram likelihood ratio, with DataFrame functions only.

Base: words, code points in words, symbols, repeated lines, words inside 8-word
windows that occur more than once. All is computed inside the row by array
functions, so no text is shuffled. Windows are compared by 64-bit hashes, built
by doubling (pairs, fours, eights).

Verdict: each word, the last two characters of each word, and each pair of
neighbouring words is an n-gram, hashed into one of ``BUCKETS`` buckets. Two multinomials
with add-``SMOOTH`` smoothing are counted over all documents: of the trusted
target (rows with ``labels.quality`` = 1, found behind a Bloom filter of their ids) and
of the raw corpus, which needs no join. A document's
score is the sum of log(target/raw) over its n-grams divided by their number; it
is kept if the score is at least ``THRESHOLD``. Weights are whole numbers (1e-6),
so sums do not depend on the order of rows.

Defined cases: null and empty text has no words and fails the base rule; its
score is null. Repeated rows count as often as they stand; a document with
several label rows is trusted if any has quality 1; with no trusted documents
(or no labels) every weight is 0 and the base rule alone decides. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.joins import FILTER_BITS, id_filter
from strandline.llm.words import words
from strandline.runtime import table

BUCKETS = 1 << 16
SMOOTH = 1.0
#: In the gap between the two kinds: of 17 242 trusted documents (base rules passed) none scores below -0.05, of
#: 1 397 labelled as low 95 in a hundred score below -1.7; any threshold from -0.4 to -0.1 gives the same verdicts but for one row.
THRESHOLD = -0.2
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30  # percent
TAIL = 2


def _pairwise(a: Column, step: int) -> Column:
    """Element i combined with element i + step, where both exist."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """``df`` with _q_n_repeat_words in place of _q_g: words covered by windows whose hash occurs twice or more.

    Each step is a column of its own: a lambda evaluates what it refers to once for each element."""
    # sorted (hash, place): neighbours with equal hash repeat
    twice = F.size(F.array_distinct("_q_g")) < F.size("_q_g")
    df = df.withColumn("_q_p", F.when(twice, F.array_sort(F.transform("_q_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_q_g")
    same = lambda p, i, d: F.coalesce(F.get("_q_p", i + d)["h"] == p["h"], F.lit(False))
    df = df.withColumn("_q_s", F.array_sort(F.transform(F.filter("_q_p", lambda p, i: same(p, i, -1) | same(p, i, 1)), lambda p: p["i"]))).drop("_q_p")
    # union of [s, s + WINDOW): each start adds what the one before does not cover
    less = F.size("_q_s") - 1
    gaps = F.zip_with(F.slice("_q_s", F.lit(2), less), F.slice("_q_s", F.lit(1), less), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda acc, g: acc + g)
    return df.withColumn("_q_n_repeat_words", F.when(F.col("_q_s").isNull(), 0).otherwise(covered).cast("bigint")).drop("_q_s")


def with_words(docs: DataFrame) -> DataFrame:
    """``docs`` with _q_w (words), _q_h (their hashes) and _q_e (hashes of their last two characters)."""
    df = docs.withColumn("_q_w", words(F.col("text")))
    return df.withColumns({"_q_h": F.transform("_q_w", lambda w: F.xxhash64(w)), "_q_e": F.transform("_q_w", lambda w: F.xxhash64(F.substring(w, -TAIL, TAIL)))})


def with_pairs(df: DataFrame) -> DataFrame:
    """``df`` (with words) and _q_b: hashes of neighbouring words, which score and windows share."""
    return df.withColumn("_q_b", _pairwise(F.col("_q_h"), 1))


def with_base(df: DataFrame) -> DataFrame:
    """``df`` (with words) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, each behind ``_q_``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    signs = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_q_lines": lines, "_q_n_symbols": signs.cast("bigint"), "_q_word_chars": F.length(F.array_join("_q_w", "")).cast("bigint"), "_q_n_words": F.size("_q_h").cast("bigint"), "_q_g": F.col("_q_b") if "_q_b" in df.columns else _pairwise(F.col("_q_h"), 1)}).drop("_q_w", "_q_h", "_q_b")
    df = df.withColumns({"_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("bigint"), "_q_g": _pairwise(F.col("_q_g"), 2)}).drop("_q_lines")
    df = _with_repeat_words(df.withColumn("_q_g", _pairwise(F.col("_q_g"), 4)))
    return df.withColumn("_q_base_failed", (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > MAX_REPEAT * F.col("_q_n_words")))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets).cast("bigint")).cast("int")


def trusted_rows(docs: DataFrame, labels: DataFrame, most: int = FILTER_BITS) -> DataFrame:
    """Rows of ``docs`` that a label calls good: a Bloom filter of their ids (``most`` bits at most) lets few others
    through to an exact semi-join, so that hardly any text moves but theirs."""
    kind = dict(docs.dtypes)["doc_id"]
    ids = labels.where("quality = 1").select(F.col("doc_id").cast(kind).alias("_id")).where("_id is not null")
    some = docs.where(id_filter(ids, most)(F.col("doc_id")))
    return some.join(ids.hint("merge"), some["doc_id"] == ids["_id"], "left_semi")  # the same way at every size


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, pairs: bool = True) -> dict[int, int]:
    """N-grams in each bucket over every row of ``docs``."""
    found = with_words(docs.select("text"))
    found = with_pairs(found) if pairs else found
    grams = found.select(F.explode(F.concat("_q_h", "_q_e", *["_q_b"] * pairs)).alias("gram")).groupBy(_bucket(F.col("gram"), buckets).alias("bucket"))
    return {r["bucket"]: r["n"] for r in grams.agg(F.count("*").alias("n")).collect()}  # at most `buckets` rows


def bucket_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smooth: float = SMOOTH, pairs: bool = True) -> list[int]:
    """Weight of each bucket: log ratio in 1e-6, counted over every document."""
    some = docs.select("doc_id", "text")
    good = bucket_counts(trusted_rows(some, labels), buckets, pairs)
    if not good:
        return [0] * buckets
    raw = bucket_counts(some, buckets, pairs)
    all_raw, all_good, out = sum(raw.values()), sum(good.values()), [0] * buckets
    for b, n in raw.items():
        out[b] = round(1e6 * math.log((good.get(b, 0) + smooth) / (all_good + smooth * buckets) / ((n + smooth) / (all_raw + smooth * buckets))))
    return out


def with_score(df: DataFrame, weights: list[int]) -> DataFrame:
    """``df`` (with words, and with pairs if they count) and ``_q_score``: mean log ratio of the n-grams of the text, null without any."""
    table_ = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folds to one constant
    add = lambda acc, g: acc + F.get(table_, _bucket(g, len(weights)))
    total = F.aggregate("_q_e", F.aggregate("_q_h", F.lit(0).cast("bigint"), add), add)
    n = 2 * F.size("_q_h")
    if "_q_b" in df.columns:
        total, n = F.aggregate("_q_b", total, add), n + F.size("_q_b")
    return df.withColumn("_q_score", F.when(n > 0, total / n / F.lit(1e6))).drop("_q_e")


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the columns RESULTS, each behind ``_q_``; one narrow pass after the counting pass.

    The results leave through a generator of one row: a later filter on them would
    else be pushed below and compute the arrays anew for each of its references."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    scored = with_base(with_score(with_pairs(with_words(docs)), bucket_weights(docs, labels)))
    scored = scored.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.coalesce("_q_score", F.lit(-1e9)) >= threshold))
    return scored.select(*cols, F.inline(F.array(F.struct(*[F.col(f"_q_{n}").alias(f"_q_{n}") for n in RESULTS]))))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return judge(docs.select(row, "doc_id", "text"), labels, threshold).where("_q_kept").select("_row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.col(f"_q_{n}").alias(n) for n in RESULTS])
