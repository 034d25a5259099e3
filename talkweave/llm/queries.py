"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import chat_windows, read_back
from .collocations import phrases
from .common import table
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .language_id import identify_languages
from .lm_scoring import lm_scores
from .line_dedup import MIN_PAGES, RATIO, line_dedup
from .mixing import mix_sources
from .sentence_piece import decode_documents, encode_documents
from .simhash import simhash_dedup
from .suffix_dedup import suffix_dedup
from .top_k import top_k
from .url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


@query("op2_mix_sources")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op3_sentence_piece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decode_documents(encoded).select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("decoded_sha256"),
        "tokens",
    )


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    lengths = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.length)
    return found.select(
        "doc_id",
        "n_bytes",
        lengths.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op5_top_k",
    """WITH usable AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM usable q, usable c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
    FROM scored QUALIFY rank <= 20""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query(
    "op6_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op7_simhash_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold another template's control strings.
ODD_CONVERSATION = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))

ESCAPED = "replace(replace({}, '\\', '\\\\'), '<|', '<\\|')"


@query("op8_chat_format")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "conv_id long, turn long, role string, text string"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = given.unionByName(spark.createDataFrame(ODD_CONVERSATION, schema))
    read = read_back(chat_windows(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


@query("op9_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels")
    bad = marks.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long").alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), bad, URL_RULES)


@query(
    "op10_line_dedup",
    f"""WITH pages AS (
      SELECT doc_id, source, rowid_ AS rid, string_split(coalesce(text, ''), chr(10)) AS lines
      FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
    totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY 1),
    seen AS (SELECT DISTINCT rid, source, unnest(lines) AS line FROM pages),
    common AS (
      SELECT s.source, s.line FROM seen s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
      WHERE trim(s.line, ' ') <> '' GROUP BY 1, 2
      HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * max(t.pages)),
    sets AS (SELECT source, list(line) AS drops FROM common GROUP BY 1),
    kept AS (
      SELECT doc_id, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(drops, x), false)) AS rest
      FROM pages p LEFT JOIN sets s ON p.source IS NOT DISTINCT FROM s.source)
    SELECT doc_id, len(lines) AS n_lines, len(lines) - len(rest) AS n_dropped,
      sha256(array_to_string(rest, chr(10))) AS kept_sha256 FROM kept""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return clean.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


@query(
    "op11_hard_negatives",
    """WITH usable AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
      FROM usable a, usable c WHERE a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.positive_id,
      row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank,
      n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
      AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
    QUALIFY rank <= 3""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    "op12_collocations",
    f"""WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')), '[ \t]+'), lambda w: w <> '') AS w
      FROM documents),
    grams AS (
      SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase,
      FROM pieces, range(1, 4) AS sizes(k)),
    f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL),
    sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
    frequent AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
    parts AS (
      SELECT c.lang, c.k, c.phrase, c.a, c.w, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
      FROM frequent c, range(1, 3) AS cuts(cut) WHERE cut < c.k),
    scored AS (
      SELECT p.lang, p.k, p.phrase, p.a, x.a AS l, y.a AS r, cut,
        ((1000000::HUGEINT * p.a * p.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM parts p JOIN f x ON x.lang = p.lang AND x.k = cut AND x.phrase = p.head
        JOIN f y ON y.lang = p.lang AND y.k = p.k - cut AND y.phrase = p.rest),
    chosen AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    around AS (
      SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM frequent WHERE k = 3),
    most AS (SELECT lang, phrase, max(a) AS a FROM around GROUP BY ALL)
    SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank,
      c.phrase, c.a, c.l, c.r, s.n, c.score
    FROM chosen c JOIN sizes s ON s.lang = c.lang LEFT JOIN most m ON m.lang = c.lang AND m.phrase = c.phrase AND c.k = 2
    WHERE coalesce(100 * m.a < 50 * c.a, true) QUALIFY rank <= 2000""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


@query("op13_lm_scoring")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return lm_scores(table(spark, sf_dir, "documents"), held_out)
