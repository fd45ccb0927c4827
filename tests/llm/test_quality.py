import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from riftsplit.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, None),
    (2, ""),
    (3, "a b c a b c x"),
    (4, "a a a a a a"),
    (5, "one\n\n two \ntwo\n two \n\t\none\x0bone"),
    (6, GOOD),
    (7, "$$$ &&& é é " * 30),
    (8, "same words here " * 4000),
    (8, "same words here " * 4000),
    (None, GOOD),
]


def brute(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines),
        len(lines) - len(set(lines)),
        len(hit),
    )


def test_counts_equal_brute_force(docs):
    rows = quality.text_counts(docs(TEXTS).select("doc_id", F.col("text"), F.col("text").alias("copy"))).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"))
        assert got == brute(r["copy"])


def test_buckets_hold_their_values(spark):
    values = spark.sql("SELECT explode(array(0L, 1L, 63L, 64L, 65L, 127L, 128L, 1000L, 999999L, 1000000L, 123456789012L)) AS v")
    for r in values.select("v", quality.least_value(quality.bucket(F.col("v"))).alias("low")).collect():
        assert r["low"] <= r["v"] <= r["low"] * (1 + 1 / 64)


def test_junk_goes_and_clean_stays(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 997}" for j in range(80)), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, " ".join(f"w{(i + j) % 91}$$$" for j in range(80)), "en", "s0") for i in range(10)]
    rows += [(2000, rows[0][1], None, None), (2001, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] for i in range(300)) and got[2000]
    assert not any(got[1000 + i] for i in range(10)) and not got[2001]


def test_repeats_are_judged_by_rate_and_count(spark):
    plain = [(i, " ".join(f"w{10_000 + i * 500 + j}" for j in range(80)), "en", "s0") for i in range(100)]
    again = " ".join(f"again{j}" for j in range(8))
    short = f"{again}\n" + " ".join(f"rest{j}" for j in range(40)) + f"\n{again}"  # 16 of 56 words, 1 of 3 lines
    long = " ".join(f"long{j % 330}" for j in range(660)) + " " + " ".join(f"more{j}" for j in range(1540))  # 30 of 100 words
    pairs = [(f"line{k % 60} ends{k % 60}", f"next{k} last{k}") for k in range(100)]
    lines = "\n".join(x for pair in pairs for x in pair) + "\n" + "\n".join(f"line{k} ends{k}\nthird{k}" for k in range(60))
    df = spark.createDataFrame([*plain, (1000, short, "en", "s0"), (1001, long, "en", "s0"), (1002, lines, "en", "s0")], "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert all(got[i]["kept"] for i in range(100)) and got[1000]["kept"]
    assert not got[1001]["base_failed"] and got[1001]["failed"] == ["repeat_rate"]
    assert not got[1002]["base_failed"] and got[1002]["failed"] == ["dup_line_rate"]


def test_dirty_source_does_not_widen_its_fence(spark):
    def row(i, source, junk):
        stem = "$$$$" if junk else "word"
        return (i, " ".join(f"{stem}{(i * 7 + j) % 997}" for j in range(60)), "en", source)

    # 500 rows of one source, of which 30, 50 and 70 of 100 are junk, beside 1,600 clean rows
    for share in (30, 50, 70):
        rows = [row(i, "hot", i % 100 < share) for i in range(500)] + [row(1000 + i, f"s{i % 2}", False) for i in range(1600)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
        got = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
        assert all(kept == (i >= 1000 or i % 100 >= share) for i, kept in got.items()) and len(got) == len(rows)


def test_languages_keep_their_word_lengths(spark):
    rows = [(i, " ".join(f"w{10_000 + (i * 7 + j) % 997}" for j in range(60)), "en", "s0") for i in range(900)]
    rows += [(1000 + i, " ".join(f"{'long' * 5}{100 + (i * 7 + j) % 97}" for j in range(60)), "xx", "s0") for i in range(450)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert quality.judge(df).filter("NOT kept").isEmpty()


def test_empty_table(docs):
    assert quality.judge(docs([])).count() == 0
    assert quality.judge(docs([]).withColumn("n_words", F.lit("x"))).count() == 0


def test_groups_of_ten_to_ten_thousand_rows_equal_the_twin(spark):
    """Sources and languages of all sizes, dirty and clean, by the SQL twin in another engine."""
    rng = random.Random(6)
    rows = []
    for lang, source, n, junk, length in [("en", "big", 6000, 0.02, 5), ("en", "mid", 900, 0.5, 5), ("en", "few", 90, 0.2, 5), ("xx", "mid", 150, 0.1, 14), ("xx", "one", 10, 0.4, 14), (None, None, 12, 0.3, 6)]:
        for _ in range(n):
            bad = rng.random() < junk
            words = ["".join(rng.choices("abcdefgh", k=max(1, round(rng.gauss(length, 2))))) + rng.choice(["$$", "&", ""] if bad else ["", "", ""]) for _ in range(rng.choice([52, 60]))]
            rows.append((len(rows), " ".join(words), lang, source))
    rows += [(len(rows), None, "en", "few"), (len(rows) + 1, "", None, "big"), (len(rows) + 2, "a b", "zz", "big")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    con.register("documents", documents)
    wanted = {r[0]: r[6:] for r in con.execute(queries.SQL["op7_quality_rules"]).fetchall()}
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(df).collect()}
    assert got == wanted
    assert 0 < sum(not k for b, k in got.values() if not b) < len(rows) / 2


def test_small_groups_follow_the_wider_level_without_a_step(spark):
    """A fence moves little when a group grows by one row, at every size."""
    def fence(n):
        rows = [(i, 5_000_000, "en", "s0") for i in range(2000)] + [(5000 + i, 12_000_000, "xx", "s1") for i in range(n)]
        df = spark.createDataFrame([(i, 100, v // 10_000, lang, source) for i, v, lang, source in rows], "id bigint, n_words bigint, word_chars bigint, lang string, source string")
        counts = df.withColumns({c: F.lit(0).cast("bigint") for c in ("n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")})
        return quality.adaptive_fences(counts, ["lang", "source"]).filter("lang = 'xx'").first()["fence_long_words"]

    at = {n: fence(n) for n in (1, 49, 50, 51, 399, 400)}
    assert at[1] < at[49] < at[50] < at[51] < at[399] <= at[400]
    assert at[50] - at[49] < 200_000 and at[51] - at[50] < 200_000 and at[400] - at[399] < 50_000


def test_clashing_names_are_replaced_or_passed_through(spark):
    rows = [(1, GOOD, "en", "s0", "mine", "a", "b", "c", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, N_WORDS string, _by_lang string, _level string, `odd.name` string, kept int")
    got = quality.judge(df).first().asDict()
    assert got["n_words"] == 60 and got["kept"] is True and "N_WORDS" not in got
    assert got["_by_lang"] == "a" and got["_level"] == "b" and got["odd.name"] == "c" and got["lang"] == "en"
