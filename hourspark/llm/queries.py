"""Registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourspark.llm import chat, decontaminate, exact_copies, mixing, quality, search, sharding, simhash, spelling, substring, token_counts, token_files, toxicity
from hourspark.llm.common import written
from hourspark.session import run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER, END_ID = "word_bpe_49k.json", 2
WORDS_SQL = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""


def query(sql: str | None = None):  # type: ignore[no-untyped-def]
    def register(fn: Callable[[SparkSession, str], DataFrame]):  # type: ignore[no-untyped-def]
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the public vocabulary lies; it is installed beside the library and not part of it."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def not_held_out(doc_id: str = "doc_id"):  # type: ignore[no-untyped-def]
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


@query()
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to target weights by weighted fair queueing."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query()
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to 8 shards of near equal bytes by longest processing time."""
    dealt = sharding.sharded(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by nearest labelled examples; held-out rows are never learnt from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    told = toxicity.toxicity(docs, labels, not_held_out())
    return told.select("doc_id", (~not_held_out()).alias("held_out"), "score", "predicted", "evidence")


@query()
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Huffman-coded token files, and what the files give back."""
    folder = run_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path(), END_ID)
    return token_files.read_token_files(spark, folder)


@query(rf"""WITH d AS (SELECT doc_id, source, lang, len({WORDS_SQL}) AS words, length(coalesce(text, '')) AS chars,
    md5(coalesce(text, '')) AS key, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS feeds FROM documents),
  k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS copy FROM d),
  live AS (SELECT * FROM k WHERE copy = 1 AND words > 0)
  SELECT source, lang, 'words-2' AS version, count(*) AS documents, sum(words + feeds)::BIGINT AS tokens FROM live GROUP BY ALL
  UNION ALL SELECT source, lang, 'chars-1', count(*), sum((chars + 3) // 4)::BIGINT FROM live GROUP BY ALL""")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals kept up to date by deltas: all documents are counted, recounted by a newer tokenizer version,
    counted by a second tokenizer, and copies and empty documents deleted; one batch is delivered twice."""
    return rolled_up(table(spark, sf_dir, "documents"))


def rolled_up(docs: DataFrame) -> DataFrame:
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    feeds = F.length(text) - F.length(F.translate(text, "\n", ""))
    rows = docs.select("doc_id", "source", "lang", mixing.word_count().alias("words"), F.length(text).alias("chars"), feeds.alias("feeds"), F.md5(text).alias("text_key"))
    told = F.max(F.struct("source", "lang", "words", "chars", "feeds")).alias("t")
    counted = rows.groupBy("doc_id", "text_key").agg(told, F.count(F.lit(1)).alias("copies")).select("doc_id", "text_key", "t.*", "copies")
    counted = written(counted, "counted")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id")  # null ids come last
    firsts = written(counted.groupBy("text_key").agg(F.min(place).alias("first")), "firsts")
    ranked = written(counted.join(firsts, "text_key").withColumn("leads", place == F.col("first")), "ranked")
    dropped = ranked.where("NOT leads OR words = 0")
    single = ranked.where("leads AND words > 0 AND copies > 1").withColumn("copies", F.lit(1).cast("long"))
    old, new, other = "words-1", "words-2", "chars-1"
    words_2, chars_1 = F.col("words") + F.col("feeds"), F.floor((F.col("chars") + 3) / 4)
    recounted = token_counts.puts(counted, old, F.lit(0), "delete").unionByName(token_counts.puts(counted, new, words_2))
    gone = token_counts.puts(dropped, new, F.lit(0), "delete").unionByName(token_counts.puts(dropped, other, F.lit(0), "delete"))
    gone = gone.unionByName(token_counts.puts(single, new, words_2)).unionByName(token_counts.puts(single, other, chars_1))
    folder = run_dir(spark, "token-counts")
    batches = [
        ("1-load", token_counts.puts(counted, old, F.col("words"))), ("2-recount", recounted),
        ("3-second", token_counts.puts(counted, other, chars_1)), ("2-recount", recounted), ("4-drop", gone),
    ]
    for batch, changes in batches:
        token_counts.commit(spark, folder, batch, changes)
    return token_counts.totals(spark, folder)


_ODD_TURN = r"\### Assistant: </turn> ok"


@query(rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{_ODD_TURN}' UNION ALL SELECT -7, 1, 'assistant', '{_ODD_TURN}'),
  e AS (SELECT *, CASE WHEN regexp_matches(text, '(?s)\\.|###|</turn>')
      THEN replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') ELSE text END AS body FROM t)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length(role) + length(body) + 15)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""")
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one odd one, formatted, written, and read back."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    odd = spark.range(1).select(odd.alias("t")).select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(_ODD_TURN).alias("text"))
    return chat.digests(written(chat.formatted(told.unionByName(odd)), "chat"))


_COUNTS_SQL = rf"""w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS_SQL} AS words FROM documents),
  x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
  g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s AS gram FROM x WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
  r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL),
  c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(3) AS t(k) WHERE n > 1),
  p AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
  l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
  m AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
  f AS (SELECT doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
    FROM w LEFT JOIN m USING (doc_id) LEFT JOIN p USING (doc_id)),
  v AS (SELECT *, n_words < {quality.FEWEST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed,
      1000 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_symbols // greatest(n_words, 1) AS symbols,
      1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM f)"""


def _fences_sql(name: str, keys: str) -> str:
    by = f"{keys}, rule" if keys else "rule"
    cases = {"slack": " ".join(f"WHEN '{r}' THEN {slack}" for r, (slack, _) in quality.RULES.items()),
             "low": ", ".join(f"'{r}'" for r, (_, low) in quality.RULES.items() if low)}
    lead = f"{keys}, " if keys else ""
    return f"""{name} AS (SELECT {by}, q3 + {quality.FENCE} * (q3 - q1) + CASE rule {cases["slack"]} END AS most,
      CASE WHEN rule IN ({cases["low"]}) THEN q1 - {quality.FENCE} * (q3 - q1) - CASE rule {cases["slack"]} END END AS least, total FROM (
        SELECT {by}, min(bin) FILTER (WHERE upto >= 0.25 * total) AS q1, min(bin) FILTER (WHERE upto >= 0.75 * total) AS q3, max(total) AS total FROM (
          SELECT {lead}rule, bin, sum(sum(n)) OVER (PARTITION BY {by} ORDER BY bin) AS upto, sum(sum(n)) OVER (PARTITION BY {by}) AS total
          FROM k GROUP BY {by}, bin) GROUP BY {by}))"""


_QUALITY_SQL = f"""WITH {_COUNTS_SQL},
  u AS (UNPIVOT (SELECT doc_id, lang, source, base_failed, word_length, symbols, dup_lines, repeats FROM v) ON word_length, symbols, dup_lines, repeats INTO NAME rule VALUE value),
  b AS (SELECT *, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS bin FROM u),
  k AS (SELECT lang, source, rule, bin, count(*) AS n FROM b WHERE NOT base_failed GROUP BY ALL),
  {_fences_sql("own", "lang, source")}, {_fences_sql("wide", "lang")}, {_fences_sql("whole", "")},
  j AS (SELECT b.doc_id, bool_or(value > CASE WHEN own.total >= {quality.GROUP_ROWS} THEN own.most WHEN wide.total >= {quality.GROUP_ROWS} THEN wide.most ELSE whole.most END
      OR coalesce(value < CASE WHEN own.total >= {quality.GROUP_ROWS} THEN own.least WHEN wide.total >= {quality.GROUP_ROWS} THEN wide.least ELSE whole.least END, FALSE)) AS failed
    FROM b JOIN own ON own.lang IS NOT DISTINCT FROM b.lang AND own.source IS NOT DISTINCT FROM b.source AND own.rule = b.rule
    JOIN wide ON wide.lang IS NOT DISTINCT FROM b.lang AND wide.rule = b.rule JOIN whole ON whole.rule = b.rule GROUP BY b.doc_id)
  SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(failed, FALSE) AS kept
  FROM v LEFT JOIN j USING (doc_id)"""


@query(_QUALITY_SQL)
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts of all documents and the verdict of adaptive thresholds."""
    return quality.judged(table(spark, sf_dir, "documents")).drop("failed")


@query(rf"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
  x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM w),
  g AS (SELECT doc_id, i, n, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), ' ') AS run FROM x),
  d AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS again FROM g WHERE i + 19 <= n),
  s AS (SELECT x.doc_id, x.word, x.i, coalesce(bool_or(again) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), FALSE) AS gone
    FROM x LEFT JOIN d ON d.doc_id = x.doc_id AND d.i = x.i)
  SELECT w.doc_id, max(len(words)) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
  FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id""")
def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that repeat earlier passages of 20 words or more."""
    docs = table(spark, sf_dir, "documents")
    done = substring.removal(docs)
    return done.select(F.when(F.col("o") != 2**63 - 1, F.col("o")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by SimHash."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query("""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)
  SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY low ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
    sha256(low) AS text_sha256 FROM t WINDOW g AS (PARTITION BY low)""")
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents by composable fingerprints and chunkwise comparison."""
    return exact_copies.copies(table(spark, sf_dir, "documents"))


@query()
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents by a variable-length gram index."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


_TERMS_SQL = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(f"""WITH t AS (SELECT doc_id, unnest({_TERMS_SQL}) AS term FROM documents),
  f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
  s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n), d AS (SELECT term, count(*) AS df FROM f GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM d, s),
  m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // terms AS m FROM n, s),
  q AS (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
  c AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL),
  r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM c WHERE score > 0)
  SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {search.TOP}""")
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
