"""Redaction and other text operators over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.redaction import RULES, redact_frame, redact_text, redaction_summary, redaction_total, token
from ..functions.scores import dominant, round4, tone_from_logits
from ..functions.vectors import cosine, fit_vector
from ..operators import search
from ..sources.calendar import availability_label, status_label
from ..sources.driver_tables import query_vector, table
from .catalog import query

# --- redaction --------------------------------------------------------------

_CARD = """(length({d}) BETWEEN 13 AND 19 AND replace({d}, substr({d}, 1, 1), '') <> ''
  AND list_sum(list_transform(range(1, length({d}) + 1), lambda k:
    CASE WHEN k % 2 = 1 THEN CAST(substr({d}, length({d}) - k + 1, 1) AS INT)
         ELSE CAST(substr({d}, length({d}) - k + 1, 1) AS INT) * 2
              - CASE WHEN CAST(substr({d}, length({d}) - k + 1, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"""
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_CHECKS = {
    "payment card": _CARD.format(d=_DIGITS),
    "IP address": "list_max(list_transform(string_split(x, '.'), lambda o: CAST(o AS INT))) <= 255",
    "phone number": f"(NOT regexp_full_match(trim(x), '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND length({_DIGITS}) >= 7)",
}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _redaction_sql() -> tuple[str, str]:
    """One CTE per rule, each reading the text of the one before, and the counts of its hits.

    RE2 has no look-around, so the location rule spells its borders out.
    """
    ctes, last, counts = [], "documents", []
    for i, rule in enumerate(RULES):
        pattern, flags = rule.pattern, "gi" if rule.ignore_case else "g"
        border = pattern.startswith("(?<!")
        if border:
            core = pattern[len(r"(?<![\d.])"):-len(r"(?![\d.])")]
            pattern = rf"(^|[^\d.])({core})($|[^\d.])"
        replacement = r"\1" + "\x01" + r"\2" + "\x01" + r"\3" if border else "\x01\\0\x01"
        marked = f"string_split(regexp_replace(text, {_quote(pattern)}, {_quote(replacement)}, '{flags}'), chr(1))"
        check = _CHECKS.get(rule.category, "TRUE")
        pieces = (
            f"list_transform({marked}, lambda x, i: CASE WHEN i % 2 = 0 AND {check} "
            f"THEN {{'t': {_quote(token(rule.category))}, 'h': 1}} ELSE {{'t': x, 'h': 0}} END)"
        )
        kept = "".join(f", h{j}" for j in range(i))
        ctes.append(
            f"r{i} AS (SELECT doc_id, array_to_string(list_transform(p, lambda s: s.t), '') AS text{kept}, "
            f"list_sum(list_transform(p, lambda s: s.h)) AS h{i} FROM (SELECT *, {pieces} AS p FROM {last}))"
        )
        last = f"r{i}"
        counts.append(f"SELECT {_quote(rule.category)} AS category, sum(h{i}) AS n FROM r{len(RULES) - 1}")
    head = "WITH " + ",\n".join(ctes) + "\n"
    totals = f"SELECT category, CAST(sum(n) AS BIGINT) AS n FROM ({' UNION ALL '.join(counts)}) GROUP BY 1 HAVING sum(n) > 0"
    return head + f"SELECT doc_id, text FROM {last}", head + totals


_REDACTED, _COUNTS = _redaction_sql()


@query("redacted_documents", _REDACTED)
def redacted_documents(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return redact_text(documents, "text")


@query("redaction_counts", _COUNTS)
def redaction_counts(spark, sf):
    return redaction_summary(table(spark, sf, "documents").select("text"))


@query("redaction_total", f"SELECT CAST(sum(n) AS BIGINT) AS total, string_agg(category, ',' ORDER BY category) AS categories FROM ({_COUNTS})")
def redaction_totals(spark, sf):
    rows = redaction_total(table(spark, sf, "documents").select("text"))
    return rows.select("total", F.array_join("categories", ",").alias("categories"))


@query("redacted_frame", """SELECT event_id, event_type AS kind,
  concat('mail [redacted: email address] now') AS note, '[redacted: link]' AS link, user_id AS number FROM events""")
def redacted_frame(spark, sf):
    nested = table(spark, sf, "events").selectExpr(
        "event_id",
        "event_type AS kind",
        "named_struct('note', concat('mail u', user_id, '@example.com now'), 'number', user_id) AS s",
        "array(concat('https://x.org/', event_id)) AS links",
        "map('kept@example.com', concat('www.x.org/', event_id)) AS m",
    )
    shown = redact_frame(nested)
    return shown.select(
        "event_id", "kind", "s.note",
        F.when(F.col("m")["kept@example.com"] == F.col("links")[0], F.col("links")[0]).alias("link"),
        "s.number",
    )


# --- scalar text ------------------------------------------------------------


@query("private_attachment_names", """SELECT page_id, '[attachment]' || lower(regexp_extract(trim(url), '\\.[A-Za-z0-9]{1,10}$')) AS plain,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE '[attachment].pdf' END AS file FROM pages""")
def private_attachment_names(spark, sf):
    rows = table(spark, sf, "pages")
    file = F.expr("CASE WHEN page_id % 4 = 0 THEN '  ' ELSE concat('a b ', page_id, '.PDF ') END")
    return rows.select(
        "page_id",
        tx.private_attachment_name(F.col("url")).alias("plain"),
        tx.private_attachment_name(file).alias("file"),
    )


@query("masked_links", r"""SELECT page_id, regexp_replace(url || ' and ' || html, 'https?://[^ \t\n\r\f\x0b]+|www\.[^ \t\n\r\f\x0b]+', 'http', 'g') AS text FROM pages""")
def masked_links(spark, sf):
    rows = table(spark, sf, "pages")
    return rows.select("page_id", tx.mask_links(F.concat("url", F.lit(" and "), "html")).alias("text"))


@query("clipped_titles", r"""SELECT doc_id, CASE WHEN length(t) <= 64 THEN t ELSE substr(t, 1, 61) || '…' END AS title
  FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def clipped_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clip_title(F.col("text")).alias("title"))


@query("normalized_answers", r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(
    replace(replace(text, '. ', '.'), chr(10), chr(10) || chr(10) || chr(10) || chr(10)), '([.!?])([A-Z][a-z])', '\1 \2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS text
  FROM conversations""")
def normalized_answers(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", r"replace(replace(text, '. ', '.'), '\n', '\n\n\n\n') AS text"
    )
    return rows.withColumn("text", tx.normalize_answer(F.col("text")))


@query("occurrences", """SELECT doc_id, unnest(range(0, CAST(n AS INT))) AS occurrence FROM (
  SELECT doc_id, (length(t) - length(replace(t, 'reele', ''))) / 5 AS n
  FROM (SELECT doc_id, strip_accents(lower(text)) AS t FROM documents)) WHERE n > 0""")
def occurrences(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return search.find_occurrences(documents, "doc_id", "text", " RéELe ")


@query("document_tokens", r"""SELECT doc_id, count(*) AS words, count(DISTINCT token) AS distinct_words, min(token) AS first_word, max(token) AS last_word
  FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS token FROM documents) GROUP BY 1""")
def document_tokens(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    rows = documents.select("doc_id", tx.tokens(F.col("text")).alias("w"))
    return rows.filter(F.size("w") > 0).select(
        "doc_id",
        F.size("w").alias("words"),
        F.size(F.array_distinct("w")).alias("distinct_words"),
        F.array_min("w").alias("first_word"),
        F.array_max("w").alias("last_word"),
    )


@query("enum_labels", """SELECT p_partkey, CASE p_size % 6 WHEN 1 THEN 'confirmed' WHEN 2 THEN 'tentative' WHEN 3 THEN 'canceled' ELSE 'none' END AS status,
  CASE p_size % 6 - 1 WHEN 0 THEN 'busy' WHEN 1 THEN 'free' WHEN 2 THEN 'tentative' WHEN 3 THEN 'unavailable' ELSE 'not_supported' END AS availability FROM part""")
def enum_labels(spark, sf):
    code = F.col("p_size") % 6
    return table(spark, sf, "part").select(
        "p_partkey", status_label(code).alias("status"), availability_label(code - 1).alias("availability")
    )


# --- vectors and scores -----------------------------------------------------


@query("vector_lengths", "SELECT vec_id, len(embedding) AS dims FROM embeddings")
def vector_lengths(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("dims"))


@query("cosine_similarity", """SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.v, lambda x: x::DOUBLE)), 5) AS similarity
  FROM embeddings a, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) b""")
def cosine_similarity(spark, sf):
    rows = table(spark, sf, "embeddings")
    first = F.lit(query_vector(spark, sf))
    return rows.select("vec_id", F.round(cosine(F.col("embedding"), first), 5).alias("similarity"))


@query("fitted_vectors", """SELECT vec_id, 96 AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / greatest(n * n, 1e-300), 4) AS norm,
  round(embedding[1]::DOUBLE / n, 4) AS first_value, 0.0::DOUBLE AS last_value
  FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)""")
def fitted_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", fit_vector(F.col("embedding"), 96).alias("v")
    )
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    return rows.select(
        "vec_id",
        F.size("v").alias("dims"),
        F.round(norm, 4).alias("norm"),
        F.round(F.col("v")[0].cast("double"), 4).alias("first_value"),
        F.col("v")[95].cast("double").alias("last_value"),
    )


@query("tone_from_logits", """SELECT vec_id, triple, round(e1 / t, 4) AS negative, round(e2 / t, 4) AS neutral, round(e3 / t, 4) AS positive,
  round(e3 / t - e1 / t, 4) AS valence, round(greatest(e1, e2, e3) / t, 4) AS confidence,
  CASE WHEN e1 >= e2 AND e1 >= e3 THEN 'negative' WHEN e2 >= e3 THEN 'neutral' ELSE 'positive' END AS dominant
  FROM (SELECT *, e1 + e2 + e3 AS t FROM (SELECT vec_id, triple, exp(embedding[3 * triple + 1]::DOUBLE) AS e1, exp(embedding[3 * triple + 2]::DOUBLE) AS e2, exp(embedding[3 * triple + 3]::DOUBLE) AS e3
    FROM (SELECT vec_id, embedding, unnest(generate_series(0, len(embedding) // 3 - 1)) AS triple FROM embeddings)))""")
def tone_from_logit_columns(spark, sf):
    """Every three components of a vector, as if they were logits."""
    triples = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.size("embedding") / 3) - 1))
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", triples.alias("triple"))
    e = [F.get("embedding", (3 * F.col("triple") + i).cast("int")).cast("double") for i in range(3)]
    rows = rows.select("vec_id", "triple", tone_from_logits(*e).alias("s"))
    names = ("negative", "neutral", "positive", "valence", "confidence")
    return rows.select(
        "vec_id",
        "triple",
        *[round4(F.col(f"s.{n}")).alias(n) for n in names],
        dominant(F.col("s.negative"), F.col("s.neutral"), F.col("s.positive")).alias("dominant"),
    )
