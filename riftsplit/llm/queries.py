"""Registered queries of the operators, each over its whole table, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftsplit.llm import chat, conversation_repair, decontamination, embedding_dups, html_text, licenses, near_duplicates, packing, quality, secrets, sharding, toxicity, vector_codes
from riftsplit.plans.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    # rows hold whole texts: a batch of Spark's 10,000 would take tens of megabytes on both sides of every Python task
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base shapes and entropy stretches."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = [k for k, *_ in secrets.SHAPES]
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(secrets.spans_text(F.col("secrets"), base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("secrets")).alias("spans"),
        *[count(c.kind).alias(f"n_{c.kind}") for c in secrets.CLASSES],
    )


CONTROL_TEXT = r"\### Assistant: </turn> ok"

OP3_SQL = rf"""WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
t AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS i FROM said
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, before IS NULL OR before <> role AS first,
  length(replace(replace(role, '&', '&a;'), '<|', '&l;|')) AS r,
  length(replace(replace(text, '&', '&a;'), '<|', '&l;|')) AS x FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(x + CASE WHEN first THEN r + 8 + 8 + 7 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op3_chat_format", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation, then read turns and loss texts back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))]))
    extra = spark.range(1).select(hard.alias("t")).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("t.turn").cast("bigint").alias("turn"), "t.role", F.lit(CONTROL_TEXT).alias("text")
    )
    made = chat.format_conversations(rows.unionByName(extra))
    back = made.withColumn("said", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "")
    )
    lines = F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("said").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _bucket_sql(v: str) -> str:
    return f"CASE WHEN {v} < 64 THEN {v} ELSE 64 * (length(bin({v})) - 7) + ({v} >> (length(bin({v})) - 7)) END"


def _least_sql(b: str) -> str:
    return f"CASE WHEN {b} < 64 THEN {b} ELSE (64 + {b} % 64) << CAST({b} // 64 - 1 AS INTEGER) END"


def _level_sql(name: str, keys: list[str]) -> str:
    by = "".join(f"{k}, " for k in keys)
    at = ", ".join(f"min(CASE WHEN 100 * upto >= {q} * n THEN bucket END) AS b{q}" for q in (25, 50, 75))
    least = ", ".join(f"{_least_sql(f'b{q}')} AS q{q}" for q in (25, 50, 75))
    return f"""{name} AS (SELECT {by}rule, n, {least} FROM (SELECT {by}rule, max(n) AS n, {at} FROM (
      SELECT {by}rule, bucket, sum(c) OVER (PARTITION BY {by}rule ORDER BY bucket) AS upto, sum(c) OVER (PARTITION BY {by}rule) AS n
      FROM (SELECT {by}rule, bucket, count(*) AS c FROM rates GROUP BY ALL)) GROUP BY ALL))"""


def _quality_sql() -> str:
    rates = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{r.name}' AS rule, "
        f"CASE WHEN {r.base} > 0 THEN {r.top} * {quality.MILLION} // {r.base} ELSE 0 END AS rate FROM counts"
        for r in quality.RULES
    )
    rules = ", ".join(f"('{r.name}', {str(r.upper).upper()}, {r.slack}, {str(r.by_language).upper()})" for r in quality.RULES)

    def drawn(name: str, own: str, wide: str, rest: str, own_mid: str, kept: str) -> str:
        """A level held to the wider one and drawn towards it."""
        held = f"""CASE WHEN {own_mid} THEN {own}.q50 WHEN up_side THEN least({own}.q50, {wide}.mid + slack) ELSE greatest({own}.q50, {wide}.mid - slack) END"""
        mean = lambda x, c: f"CAST((CAST({own}.n AS HUGEINT) * ({x}) + {quality.PRIOR_ROWS} * {wide}.{c}) // ({own}.n + {quality.PRIOR_ROWS}) AS BIGINT) AS {c}"
        down, up = f"least({own}.q50 - {own}.q25, {wide}.down)", f"least({own}.q75 - {own}.q50, {wide}.up)"
        return f"{name} AS (SELECT {kept}, up_side, slack, by_language, {mean(held, 'mid')}, {mean(down, 'down')}, {mean(up, 'up')} FROM {own} JOIN {wide} ON {rest})"

    steps = ",\n  ".join([
        "l0 AS (SELECT a.rule, up_side, slack, by_language, q50 AS mid, q50 - q25 AS down, q75 - q50 AS up FROM a JOIN rules USING (rule))",
        drawn("l1", "l", "l0", "l.rule = l0.rule", "by_language", "lang, l.rule"),
        drawn("l2", "g", "l1", "g.rule = l1.rule AND g.lang IS NOT DISTINCT FROM l1.lang", "false", "g.lang, source, g.rule"),
    ])
    return f"""WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  grams AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
  twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
  covered AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM twice, range(3) r(k) GROUP BY doc_id),
  lines AS (SELECT doc_id, lang, source, w, text,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM words),
  counts AS (SELECT lines.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words
    FROM lines LEFT JOIN covered ON lines.doc_id = covered.doc_id),
  raw AS ({rates}),
  rates AS (SELECT *, {_bucket_sql("rate")} AS bucket FROM raw),
  {_level_sql("g", ["lang", "source"])}, {_level_sql("l", ["lang"])}, {_level_sql("a", [])},
  rules AS (SELECT * FROM (VALUES {rules}) t(rule, up_side, slack, by_language)),
  {steps},
  broken AS (SELECT r.doc_id, bool_or(CASE WHEN up_side THEN rate > mid + greatest({quality.REACH} * up, f.slack)
      ELSE rate < mid - greatest({quality.REACH} * down, f.slack) END) AS bad FROM rates r JOIN l2 f
    ON r.rule = f.rule AND r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source GROUP BY r.doc_id),
  base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
  SELECT base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT bad AS kept FROM base JOIN broken ON base.doc_id = broken.doc_id"""


@query("op7_quality_rules", _quality_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive quality rules over all documents."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _licenses_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in licenses.KNOWN)
    return f"""WITH known AS (SELECT form, min(license) AS license FROM (
      SELECT license, {licenses.sql_canonical("t")} AS form FROM (VALUES {known}) v(license, t)) WHERE form <> '' GROUP BY form),
    lines AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
      WHERE regexp_matches(lower(line), '{licenses.SPEAKS}')),
    hits AS (SELECT doc_id, license FROM lines LEFT JOIN known ON {licenses.sql_canonical("line")} = form),
    noted AS (SELECT doc_id, count(*) AS n_lines, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM hits GROUP BY doc_id),
    whole AS (SELECT doc_id, {licenses.sql_canonical("text")} AS form FROM documents)
    SELECT whole.doc_id, CASE WHEN whole.form <> '' THEN sha256(whole.form) END AS digest, known.license AS text_license,
      coalesce(n_lines, 0) AS n_lines, coalesce(notices, '') AS notices
    FROM whole LEFT JOIN known ON whole.form = known.form LEFT JOIN noted ON whole.doc_id = noted.doc_id"""


@query("op8_license_scan", _licenses_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences of every document, by digest."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on a ring of 40 shards with bounded loads."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op10_minhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies: 85 of 100 three-word shingles shared."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates.near_duplicate_classes(documents, width=3, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain four fifths of the five-word shingles of a benchmark item."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminated(documents, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of at most 2048 tokens."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(documents, public_tokenizers.path("word_bpe_49k.json"))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: two thirds of the ids."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from two thirds of the labels."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.learn_grammar(documents, training_labels(table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    scored = toxicity.score_toxicity(documents, grammar)
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.extract_text(pages, html_text.learn_field(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def _codes_sql(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    xs = [f"x{i}" for i in range(width)]
    cut = ", ".join(f"v[{width} * part + {i + 1}] AS x{i}" for i in range(width))
    far = " + ".join(f"(p.{x} - b.{x}) * (p.{x} - b.{x})" for x in xs)
    mean = ", ".join(f"CAST(coalesce(floor(CAST(m.{x} AS DOUBLE) / m.n), b.{x}) AS BIGINT) AS {x}" for x in xs)
    total = ", ".join(f"sum({x}) AS {x}" for x in xs)
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT p.r, p.part, {", ".join(f"p.{x}" for x in xs)}, min({{'d': {far}, 'e': entry}}) AS best
          FROM p JOIN b{r} b ON p.part = b.part GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS (SELECT b.part, b.entry, {mean} FROM b{r} b LEFT JOIN
              (SELECT part, best.e AS entry, count(*) AS n, {total} FROM a{r} GROUP BY ALL) m ON b.part = m.part AND b.entry = m.entry)""")
    numbers = " || ',' || ".join(xs)
    return f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
      p AS (SELECT r, part, {cut} FROM kept, range({parts}) t(part)),
      b0 AS (SELECT part, r - 1 AS entry, {", ".join(xs)} FROM p WHERE r <= {entries}), {", ".join(steps)},
      coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
      book AS (SELECT sha256(string_agg({numbers}, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
      FROM kept JOIN coded USING (r), book"""


@query("op11_vector_codes", _codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings."""
    made = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = vector_codes.with_label_errors(made.rows)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(made.books.sha256()).alias("codebooks_sha256"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations by rule and repair them at least cost."""
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    found = conversation_repair.digests(conversation_repair.repair(rows, times=F.col("times")))
    counts = [c for c in conversation_repair.REPORT if c != "cost"]
    return found.select(F.col("conv").alias("conv_id"), *counts, "cost", "audit", "repaired_sha256")


@query("op13_embedding_near_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of vectors with a cosine of 0.9 or more."""
    found = embedding_dups.near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
