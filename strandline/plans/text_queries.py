"""Queries on texts, tokens and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import itn, kana, text
from strandline.operators import matching, stats
from strandline.plans.registry import query
from strandline.runtime import durable, join_small, ship, table
from strandline.schema import notes as notes_of

_SPLIT = r"list_filter(string_split_regex({}, '[ \t\n]+'), lambda x: x <> '')"


def _tokens(c):
    return F.filter(F.split(c, r"[ \t\n]+"), lambda x: x != "")


def literals(spark, rows, schema):
    """A small table of literal cases; it stays on the driver's side."""
    return spark.createDataFrame(rows, schema)


@query(
    r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z]+(?:[''’\-][A-Za-z]+)*', ' ', 'g'), '[!-/:-@\[-`{-~]+', ' ', 'g'), '\s+', ' ', 'g'), ' ') ELSE text END AS clean FROM documents"""
)
def text_sanitize(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.sanitize_recognized(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "zh").otherwise("en")).alias("clean"))


@query("SELECT * FROM (VALUES (1, '北京欢迎你'), (2, '北京欢迎你'), (3, 'hi welcome'), (4, 'きょう')) t(id, clean)")
def text_sanitize_cjk(spark, sf_dir):
    d = literals(spark, [(1, "zh", "hi welcome 北京欢迎你"), (2, "zh", "北 京 欢迎, 你"), (3, "en", "hi welcome"), (4, "ja", "きょ う!")], "id int, lang string, t string")
    return d.select("id", text.sanitize_recognized(F.col("t"), F.col("lang")).alias("clean"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')) AS INT) AS n, md5(array_to_string(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?'), ' ')) AS digest FROM documents")
def split_tokens(spark, sf_dir):
    t = text.english_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


@query("SELECT * FROM (VALUES (1, '北|京|1|2|ab|きょ|う'), (2, '欢|迎')) t(id, parts)")
def split_cjk(spark, sf_dir):
    d = literals(spark, [(1, "北京12 ab，きょう"), (2, "欢、迎")], "id int, t string")
    return d.select("id", F.array_join(text.tokens(F.col("t")), "|").alias("parts"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 5 IN (0, 1) THEN 'pinyin' ELSE 'hanzi' END
  WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 5 = 3 THEN 'kana' ELSE 'romaji' END ELSE 'hanzi' END AS shown FROM documents"""
)
def display_mode(spark, sf_dir):
    """A language (zh, ja, the document's own) and a mode by remainders of doc_id."""
    lang = F.when(F.col("doc_id") % 3 == 0, "ZH").when(F.col("doc_id") % 3 == 1, "ja").otherwise(F.col("lang"))
    mode = F.get(F.array(*[F.lit(x) for x in ("拼音", "Pinyin", "汉字", "假名", None)]), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.output_mode(lang, mode).alias("shown"))


@query(
    r"""SELECT page_id, replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), ' ', '_') AS stem, replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), ' ', '_') || '_' || substr(md5(html), 1, 8) AS key FROM pages"""
)
def safe_stem(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.safe_stem(F.col("url")).alias("stem"), text.source_key(F.col("url"), F.md5(F.col("html").cast("binary"))).alias("key"))


@query("SELECT doc_id, md5(text) AS content_md5 FROM documents")
def md5_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_md5"))


_PAIRS = "WITH p AS (SELECT conv_id, turn, " + _SPLIT.format("text") + " AS a, lead(" + _SPLIT.format("text") + ") OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)\n"


def _turns(spark, sf_dir):
    """Each turn with the next one of its conversation, as tokens."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", _tokens(F.col("text")).alias("a"))
    return c.withColumn("b", F.lead("a").over(W.partitionBy("conv_id").orderBy("turn"))).where("b is not null")


@query(
    _PAIRS
    + """, x AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS t FROM p WHERE b IS NOT NULL) GROUP BY ALL), y AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS t FROM p WHERE b IS NOT NULL) GROUP BY ALL),
s AS (SELECT x.conv_id, x.turn, CAST(sum(least(x.n, y.n)) AS INT) AS shared FROM x JOIN y USING (conv_id, turn, t) GROUP BY ALL)
SELECT p.conv_id, p.turn, coalesce(shared, 0) AS shared FROM p LEFT JOIN s USING (conv_id, turn) WHERE b IS NOT NULL"""
)
def token_overlap(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", stats.token_overlap(F.col("a"), F.col("b")).alias("shared"))


@query(_PAIRS + "SELECT conv_id, turn, CAST(list_sum(list_transform(range(least(len(a), len(b))), lambda i: CASE WHEN a[i + 1] <> b[i + 1] THEN 1 ELSE 0 END)) + abs(len(a) - len(b)) AS INT) AS diff FROM p WHERE b IS NOT NULL")
def diff_count(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", stats.difference_count(F.col("a"), F.col("b")).alias("diff"))


@query("SELECT item_id, d.doc_id, CAST(levenshtein(substr(regexp_replace(b.text, '[^ -~]', '', 'g'), 1, 60), substr(regexp_replace(d.text, '[^ -~]', '', 'g'), 1, 60)) AS INT) AS distance FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 7")
def edit_distance(spark, sf_dir):
    """Between the first 60 ASCII characters of texts paired by id, as its SQL has it; ``turn_edit_distance`` compares whole texts."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("bt"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(b), F.col("doc_id") == F.col("item_id") * 7)
    return d.select("item_id", "doc_id", F.levenshtein(*[F.substring(F.regexp_replace(c, "[^ -~]", ""), 1, 60) for c in ("bt", "text")]).alias("distance"))


@query()
def turn_edit_distance(spark, sf_dir):
    """Levenshtein distance, in tokens, of each whole turn and the next one."""
    ship(spark)

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(c, t, matching.edit_distance(list(x), list(y))) for c, t, x, y in zip(b["conv_id"], b["turn"], b["a"], b["b"], strict=True)]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "distance"])

    return _turns(spark, sf_dir).where("a is not null").mapInPandas(run, "conv_id bigint, turn bigint, distance int")


@query(
    "WITH b AS (SELECT item_id, q FROM (SELECT item_id, " + _SPLIT.format("text") + " AS q FROM benchmark) WHERE len(q) >= 5), d AS (SELECT doc_id, " + _SPLIT.format("text") + " AS r FROM documents),\n"
    "t AS (SELECT doc_id, unnest(r) AS w, unnest(range(len(r))) AS i FROM d),\n"
    "f AS (SELECT doc_id, i, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),\n"
    "h AS (SELECT item_id, f.doc_id, i, q FROM b JOIN f ON w1 = q[1] AND w2 = q[2] AND w3 = q[3] AND w4 = q[4] AND w5 = q[5])\n"
    "SELECT item_id, h.doc_id, CAST(min(i) AS INT) AS place FROM h JOIN d ON d.doc_id = h.doc_id WHERE r[i + 1 : i + len(q)] = q GROUP BY item_id, h.doc_id"
)
def exact_window_match(spark, sf_dir):
    """First place of each whole benchmark item of five words or more in each document that holds it."""
    b = table(spark, sf_dir, "benchmark").select("item_id", _tokens(F.col("text")).alias("query")).where(F.size("query") >= 5)
    b = durable(b.withColumn("k", F.xxhash64(F.slice("query", 1, 5))))
    d = table(spark, sf_dir, "documents").select("doc_id", _tokens(F.col("text")).alias("ref"))
    k = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ref") - 4), lambda i: F.xxhash64(F.slice("ref", i, 5))))
    hit = join_small(d.where(F.size("ref") >= 5).select("doc_id", "ref", F.explode(k).alias("k")), b, ["k"])
    return hit.select("item_id", "doc_id", matching.find_exact(F.col("ref"), F.col("query")).alias("place")).where("place >= 0")


#: Words in a row that make a document a candidate.
RUN = 5


def _runs(tokens, n):
    """Hashes of the runs of ``n`` tokens."""
    some = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.xxhash64(F.slice(tokens, i, n))))
    return F.when(F.size(tokens) >= n, some).otherwise(F.array().cast("array<bigint>"))


def _candidates(spark, sf_dir, how="inner"):
    """Benchmark items with the documents that hold any five words in a row of theirs, all of them if they
    are fewer: an equi-join on word runs. ``left`` keeps items without such a document, with no words to match."""
    b = table(spark, sf_dir, "benchmark").select("item_id", _tokens(F.coalesce("text", F.lit(""))).alias("query"))
    d = table(spark, sf_dir, "documents").select("doc_id", _tokens(F.coalesce("text", F.lit(""))).alias("ref"))
    n = F.least(F.size("query"), F.lit(RUN))
    sizes = sorted(r["n"] for r in b.where(n > 0).select(n.alias("n")).distinct().collect()) or [RUN]  # at most RUN of them
    own = F.coalesce(*[F.when(n == k, _runs("query", k)) for k in sizes])
    k = F.concat(*[_runs("ref", k) for k in sizes])
    hit = d.select("doc_id", F.explode(k).alias("k")).join(b.select("item_id", F.explode(own).alias("k")), "k").select("doc_id", "item_id").distinct()
    return b.join(hit, "item_id", how).join(d, "doc_id", how).withColumn("ref", F.coalesce("ref", F.array().cast("array<string>")))


def _window_match(candidates):
    return matching.match_rows(candidates, "query", "ref", "ref", "item_id", "doc_id").select("item_id", "doc_id", "found", "exact", "start", "end", "distance", "reason")


@query()
def window_match(spark, sf_dir):
    """The best stretch of a document for each benchmark item of which it holds five words in a row, or all of fewer."""
    return _window_match(_candidates(spark, sf_dir))


@query()
def match_counters(spark, sf_dir):
    """Of ``window_match``, and of items that no document holds words of: these have no match."""
    return matching.match_counters(_window_match(_candidates(spark, sf_dir, "left")))


@query()
def highlight_turns(spark, sf_dir):
    """Two turns in a row with what differs in parentheses."""
    ship(spark)

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(c, t, *matching.highlight(list(x), list(y), list(y))) for c, t, x, y in zip(b["conv_id"], b["turn"], b["a"], b["b"], strict=True)]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "said", "next", "text", "distance"])

    return _turns(spark, sf_dir).mapInPandas(run, "conv_id bigint, turn bigint, said string, next string, text string, distance int")


@query("SELECT * FROM (VALUES ('カタカナ', 'かたかな', 'カタカナ'), ('ひらがな', 'ひらがな', 'ヒラガナ'), ('ラーメン', 'らーめん', 'ラーメン')) t(t, hira, kata)")
def kana_convert(spark, sf_dir):
    d = literals(spark, [("カタカナ",), ("ひらがな",), ("ラーメン",)], "t string")
    return d.select("t", kana.to_hiragana(F.col("t")).alias("hira"), kana.to_katakana(F.col("t")).alias("kata"))


@query("SELECT * FROM (VALUES ('キャット', 'kya cl to', 'きゃ っ と'), ('ラーメン', 'ra a me n', 'ら あ め ん'), ('きょう', 'kyo u', 'きょ う'), ('ンー', 'n', 'ん')) t(t, moras, kana)")
def kata_moras(spark, sf_dir):
    ship(spark)
    d = literals(spark, [("キャット",), ("ラーメン",), ("きょう",), ("ンー",)], "t string")
    return d.select("t", F.array_join(kana.romaji_moras(F.col("t")), " ").alias("moras"), F.array_join(kana.kana_moras(F.col("t")), " ").alias("kana"))


@query("SELECT * FROM (VALUES (1, 'ka ki', 'か き'), (2, 'shi n AP tsu', 'し ん つ'), (3, 'kya cl to', 'きゃ っ と'), (4, 'ni cho', 'に ちょ')) t(id, moras, shown)")
def mora_join(spark, sf_dir):
    d = literals(spark, [(1, "k a k i"), (2, "sil sh i N AP ts u"), (3, "ky a cl t o"), (4, "ny I pau ty o")], "id int, t string")
    d = d.select("id", F.transform(F.split("t", " "), lambda x: text.phoneme(x)).alias("p")).select("id", kana.join_phonemes(F.col("p")).alias("m"))
    return d.select("id", F.array_join("m", " ").alias("moras"), F.array_join(kana.display_moras(F.col("m"), F.lit(True)), " ").alias("shown"))


@query(
    """SELECT * FROM (VALUES ('二零二五年十月', '2025年10月'), ('三四百', '300~400'), ('百分之五十', '50%'), ('三分之一', '1/3'), ('三比二', '3:2'), ('八点三十分十五秒', '08:30:15'), ('一', '一'), ('乱七八糟', '乱七八糟'),
 ('几百', '几百'), ('一万二千', '12000'), ('三千克', '3kg'), ('一九二点一六八点一点一', '192.168.1.1'), ('十一十二', '11 12'), ('两百三十四点五', '234.5')) t(t, digits)"""
)
def inverse_text_normalization(spark, sf_dir):
    ship(spark)
    cases = "二零二五年十月 三四百 百分之五十 三分之一 三比二 八点三十分十五秒 一 乱七八糟 几百 一万二千 三千克 一九二点一六八点一点一 十一十二 两百三十四点五".split()
    return literals(spark, [(c,) for c in cases], "t string").select("t", itn.digits_written(F.col("t")).alias("digits"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS name, CASE WHEN lang IN ('en', 'fr') THEN upper(lang[1]) || lang[2] END AS odd FROM documents")
def language_names(spark, sf_dir):
    """Full names of the documents' languages, by code and by a name in another case; a language and a half is none."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.language_name(F.col("lang")).alias("name"), "lang")
    again = text.language_name(F.upper("name"))
    odd = F.when(text.language_name(F.concat("lang", F.lit("x"))).isNull() & F.col("lang").isin("en", "fr"), F.initcap("lang"))
    return d.select("doc_id", again.alias("name"), odd.alias("odd"))


@query()
def edit_counts(spark, sf_dir):
    """Edits from a track's onsets, in frames of 20 ms, to those on the grid of sixteenths; marks are lyrics."""
    n = notes_of(spark, sf_dir)
    tier = lambda t: F.transform(F.array_sort(F.collect_list(F.struct("note_idx", t.alias("t"), F.col("lyric").alias("mark")))), lambda x: F.struct(x["t"].alias("t"), x["mark"].alias("mark")))
    rows = n.groupBy("track_id").agg(tier(F.col("onset") * 50).alias("pred"), tier(F.rint(F.col("onset") * 8) / 8 * 50).alias("target"))
    return matching.edit_count_rows(rows, "track_id").withColumn("ratio", F.round(F.col("edits") / F.col("most"), 6))


@query()
def matched_pairs(spark, sf_dir):
    """Places of the longest common subsequence of each turn and the next one."""
    return matching.matched_pair_rows(_turns(spark, sf_dir).where("a is not null"), "a", "b", "conv_id", "turn")


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 480 WHEN 1 THEN 240 WHEN 2 THEN 120 WHEN 3 THEN 60 WHEN 4 THEN 30 ELSE 0 END AS ticks FROM events")
def note_values(spark, sf_dir):
    label = F.get(F.array(*[F.lit(x) for x in ("1/4", " 1/8", "1/16", "1/32 ", "1/64", "none", "1/3")]), (F.col("event_id") % 7).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.note_value_ticks(label).alias("ticks"))


@query("SELECT * FROM (VALUES ('Smart slicing', 'smart'), ('网格搜索', 'grid'), ('pitch', 'pitch'), ('静音切片', 'default'), (NULL, 'default')) t(label, method)")
def method_names(spark, sf_dir):
    return literals(spark, [("Smart slicing",), ("网格搜索",), ("pitch",), ("静音切片",), (None,)], "label string").select("label", text.slicing_method(F.col("label")).alias("method"))


@query("SELECT doc_id, md5(translate(text, 'āáǎàōóǒòēéěèīíǐìūúǔùǖǘǚǜüḿǹ', 'aaaaooooeeeeiiiiuuuuvvvvvmn')) AS plain FROM documents")
def pinyin_plain(spark, sf_dir):
    """Whole texts without tone marks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.without_tone(F.col("text")).cast("binary")).alias("plain"))


@query(
    r"""WITH p AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[ \t\n]+')) AS raw FROM documents),
t AS (SELECT doc_id, trim(string_split(raw, '/')[-1], ' ') AS raw FROM p)
SELECT doc_id, count(CASE WHEN lower(raw) NOT IN ('', 'sp') AND CASE WHEN doc_id % 2 = 0 THEN lower(raw) IN ('a', 'i', 'u', 'e', 'o') OR raw = 'N' ELSE lower(raw) NOT IN ('n', 'ng', 'm') AND regexp_matches(lower(raw), '[aeiouv]') END THEN 1 END) AS singable FROM t GROUP BY doc_id"""
)
def singable_phones(spark, sf_dir):
    """Singable ones among all words of a text taken as phones, of ja in even documents."""
    lang = F.when(F.col("doc_id") % 2 == 0, "ja").otherwise("zh")
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), r"[ \t\n]+")).alias("phone"))
    return d.groupBy("doc_id").agg(F.count(F.when(text.is_singable(F.col("phone"), lang), 1)).alias("singable"))
