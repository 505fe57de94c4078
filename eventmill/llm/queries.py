"""The operators as queries over the whole given tables, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from eventmill.llm import (
    bestfit,
    divergence,
    embeddings,
    html_text,
    infill,
    licenses,
    minhash,
    mixing,
    packing,
    quality,
    quotations,
    sharding,
    url_filter,
)

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_mixing(spark, sf_dir):
    pieces = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixing.taken(pieces).drop("row_key")


def op6_sharding(spark, sf_dir):
    return sharding.kd_tree(_table(spark, sf_dir, "documents"), 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_url_filter(spark, sf_dir):
    """The labels are those of the document whose number a url's path names."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    _, path = url_filter.host_and_path(F.col("url"))
    number = F.try_to_number(F.regexp_extract(path, r"/(\d{1,18})", 1), F.lit("9" * 18)).cast("long")
    named = pages.select("page_id", number.alias("number"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge(pages, named.join(labels, F.col("number") == F.col("doc_id")).select("page_id", "bad"))


def op10_licenses(spark, sf_dir):
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.array_join("notices", ","))


def op2_quotations(spark, sf_dir):
    return quotations.conversations(_table(spark, sf_dir, "conversations"))


def op4_html_text(spark, sf_dir):
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op3_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_quality(spark, sf_dir):
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.withColumn("rules", F.array_join(F.array_sort("rules"), ","))


def op5_packing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, WORD_TOKENIZER).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "tier",
        "step_group",
    )


def op11_bestfit(spark, sf_dir):
    return bestfit.pack(_table(spark, sf_dir, "documents"), BYTE_TOKENIZER).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op12_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_infill(spark, sf_dir):
    found = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_quotations": op2_quotations,
    "op3_embeddings": op3_embeddings,
    "op4_html_text": op4_html_text,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "op11_bestfit": op11_bestfit,
    "op12_divergence": op12_divergence,
    "op13_infill": op13_infill,
}

# The given conversations hold no quotes, so SQL can say what is left of them; tests
# with planted quotes cover the rest.
NO_QUOTES = """SELECT conv_id, turn, role, coalesce(text, '') AS text, 0 AS n_quotes, 0 AS n_linked,
  CAST(NULL AS BIGINT) AS reply_to, turn AS thread, 0 AS depth,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations"""

VECTOR_LINKS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id, vec_id AS node FROM v UNION
  SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON p.a = r.node),
least AS (SELECT vec_id, min(node) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, component_id,
  component_id = vec_id AS kept FROM least"""



def _tail(p: str) -> str:
    """P(X <= k) of a binomial X of n draws, as quality.binomial_at_most counts it."""
    return f"""CASE WHEN k >= n * {p} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) END"""


QUALITY = f"""WITH w AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
grams AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM often) GROUP BY doc_id),
c AS (SELECT doc_id, stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_marks,
    length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_capitals,
    length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w)
  LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
s AS (SELECT doc_id, stratum, base_failed, unnest([
    {{'rule': 'symbols', 'score': n_symbols / nullif(n_symbols + n_words, 0)}},
    {{'rule': 'marks', 'score': n_marks / nullif(n_marks + n_words, 0)}},
    {{'rule': 'capitals', 'score': n_capitals / nullif(n_letters, 0)}},
    {{'rule': 'dup_lines', 'score': n_dup_lines / nullif(n_lines, 0)}},
    {{'rule': 'repeats', 'score': n_repeat_words / nullif(n_words, 0)}}]) AS x FROM b),
scored AS (SELECT doc_id, stratum, base_failed, x.rule AS rule, coalesce(x.score, 0) AS score FROM s),
marked AS (SELECT DISTINCT scored.*, good FROM scored JOIN (
  SELECT doc_id, bool_and(quality = 1) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
  WHERE NOT base_failed),
tests AS (SELECT {quality.ERROR} / 2 / count(DISTINCT coalesce(stratum, '')) AS level FROM marked WHERE good),
tried AS (SELECT stratum, rule, step, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS n_bad,
    count(*) FILTER (good AND score > ({quality.GRID} - step) / {quality.GRID} + 1e-9) AS k,
    count(*) FILTER (NOT good AND score > ({quality.GRID} - step) / {quality.GRID} + 1e-9) AS k_bad
  FROM marked, (SELECT unnest(range(1, {quality.GRID})) AS step) GROUP BY ALL),
bounds AS (SELECT *, {_tail("p")} AS tail
  FROM tried, (SELECT {quality.MAX_FALSE / len(quality.RULES)} AS p)),
passed AS (SELECT *, max(tail) OVER (PARTITION BY stratum, rule ORDER BY step) AS worst,
    k_bad / nullif(n_bad, 0) - {quality.PRICE} * (k / nullif(n, 0)) AS worth FROM bounds),
own AS (SELECT stratum, rule, ({quality.GRID} - step) / {quality.GRID} AS cut FROM (
  SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY worth DESC, step) AS place
  FROM passed, tests WHERE worst <= level / {len(quality.RULES)} AND worth > 0) WHERE place = 1),
others AS (SELECT stratum, rule, step, sum(n) OVER w - n AS n, sum(n_bad) OVER w - n_bad AS n_bad,
    sum(k) OVER w - k AS k, sum(k_bad) OVER w - k_bad AS k_bad FROM tried WINDOW w AS (PARTITION BY rule, step)),
proposed AS (SELECT *, k_bad / nullif(n_bad, 0) - {quality.PRICE} * (k / nullif(n, 0)) AS worth FROM others),
lent AS (SELECT stratum, rule, ({quality.GRID} - step) / {quality.GRID} AS cut,
    row_number() OVER (PARTITION BY stratum ORDER BY worth DESC, rule) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY worth DESC, step) AS pick
  FROM proposed WHERE worth > 0) WHERE pick = 1),
hits AS (SELECT doc_id, m.stratum, good, min(place) AS hit FROM marked m LEFT JOIN lent
  ON lent.rule = m.rule AND lent.stratum IS NOT DISTINCT FROM m.stratum AND score > cut + 1e-9 GROUP BY ALL),
tested AS (SELECT lent.stratum, place, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS n_bad,
    count(*) FILTER (good AND hit <= place) AS k, count(*) FILTER (NOT good AND hit <= place) AS k_bad, any_value(p) AS p
  FROM lent JOIN hits ON lent.stratum IS NOT DISTINCT FROM hits.stratum, (SELECT {quality.MAX_FALSE} AS p) GROUP BY ALL),
proved AS (SELECT *, max({_tail("p")}) OVER (PARTITION BY stratum ORDER BY place) AS worst,
    k_bad / nullif(n_bad, 0) - {quality.PRICE} * (k / nullif(n, 0)) AS worth FROM tested),
sets AS (SELECT stratum, place FROM (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY worth DESC, place) AS pick
  FROM proved, tests WHERE worst <= level AND worth > 0) WHERE pick = 1),
cutoff AS (SELECT * FROM own UNION ALL SELECT lent.stratum, rule, cut FROM lent JOIN sets
  ON lent.stratum IS NOT DISTINCT FROM sets.stratum AND lent.place <= sets.place
  WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.stratum IS NOT DISTINCT FROM lent.stratum)),
rejected AS (SELECT doc_id, array_to_string(list_sort(list(scored.rule)), ',') AS rules FROM scored JOIN cutoff
  ON cutoff.rule = scored.rule AND cutoff.stratum IS NOT DISTINCT FROM scored.stratum
  WHERE score > cut + 1e-9 GROUP BY doc_id)
SELECT b.*, coalesce(rules, '') AS rules, NOT base_failed AND rules IS NULL AS kept
FROM b LEFT JOIN rejected USING (doc_id)"""

DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS t, coalesce(lang, '') AS lang,
  coalesce(source, '') AS source FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(
  translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT row) >= {divergence.MIN_DOCS}),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(total), 0) AS lang_n
  FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, v, lang_n, coalesce(sum(n), 0) AS own_n FROM (SELECT DISTINCT lang, source FROM d)
  JOIN langs USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, total,
    CAST(1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (own_n + 5 * v) AS BIGINT) AS p,
    CAST(1 + 1000000000::HUGEINT * (total + 5) // (lang_n + 5 * v) AS BIGINT) AS q
  FROM sizes JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM rows)
WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""

INFILL = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1,
  CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
  greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
  array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle)
    ELSE concat('<P>', prefix, '<S>', suffix, '<M>', middle) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ORACLES: dict[str, str] = {
    "op2_quotations": NO_QUOTES,
    "op3_embeddings": VECTOR_LINKS,
    "op9_quality": QUALITY,
    "op10_licenses": licenses.oracle(),
    "op12_divergence": DIVERGENCE,
    "op13_infill": INFILL,
}
