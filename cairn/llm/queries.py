"""The opN_ queries: thin wrappers that hand whole tables to the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, embeddings, forest, html, jaccard, licenses, mixing, quality, repair, resample, sst, substrings, warc
from cairn.session import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe.digest_frame(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op10_sst_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids as sorted-string-table shards and read them back."""
    return sst.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, END_ID)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives, normalise them and read them back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
t AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t
"""


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate documents so that sources' shares of characters follow size ** 0.7."""
    made = mixing.replicate(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "source", "lang", "text", F.col("copy").cast("long").alias("copy"))


OP1_SQL = """
WITH RECURSIVE sizes AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY source),
totals AS (SELECT sum(size)::DOUBLE AS all_size, sum(pow(size::DOUBLE, 0.7)) AS all_target FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 AND all_target > 0 THEN pow(size::DOUBLE, 0.7) / all_target * all_size / size ELSE 1 END AS rate FROM sizes, totals),
steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS total FROM rates
  UNION ALL
  SELECT source, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
),
u AS (SELECT *, (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT doc_id, u.source, lang, text, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM u.source AND s.total < u.u) AS n FROM u)
SELECT doc_id, source, lang, text, unnest(range(1, n + 1)) AS copy FROM counted
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document by the base counts and by the distance of its histograms to its language's, as the pipeline's first stage does."""
    made = quality.judge(table(spark, sf_dir, "documents"), quality.STEADY)
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op2_sql() -> str:
    rules = quality.STEADY
    listed = lambda xs: f"[{', '.join(repr(x) for x in xs)}]"
    langs = ", ".join(f"('{name}', {listed(ws)}, {listed(shares := quality.WORD_PROFILES[name])}::DOUBLE[], {quality._without_common(shares)!r}::DOUBLE, {shares[-1]!r}::DOUBLE)" for name, ws in quality.COMMON_WORDS.items())
    left, chain = "body", []
    for k, pattern in enumerate(quality.CLASSES):
        chain.append(f"r{k} AS (SELECT *, regexp_replace({left}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS left{k} FROM {'d' if k == 0 else f'r{k - 1}'})")
        left = f"left{k}"
    n, n_bins = len(quality.CLASSES), len(next(iter(quality.COMMON_WORDS.values()))) + 1
    sizes = ", ".join([f"length({'body' if k == 0 else f'left{k - 1}'}) - length(left{k})" for k in range(n)] + [f"length(left{n - 1})"])
    distance = lambda c, q: f"sqrt(greatest(list_sum([(CASE WHEN x[1] > 0 THEN x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) ELSE 0 END) + (CASE WHEN x[2] > 0 THEN x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) ELSE 0 END) FOR x IN list_transform(list_zip({c}, {q}), lambda y: [y[1] / list_sum({c}), y[2]])]) / 2, 0))"
    return f"""
WITH langs(lang, common, rw, ceiling, rest) AS (VALUES {langs}),
d AS (SELECT doc_id, documents.lang, coalesce(text, '') AS body, common, rw, ceiling, rest FROM documents LEFT JOIN langs ON documents.lang = langs.lang),
{", ".join(chain)},
w AS (SELECT *, list_filter(string_split_regex(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, [{sizes}] AS classes,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM r{n - 1}),
h AS (SELECT *, list_transform(common, lambda b: len(list_filter(words, lambda x: x = b))) AS bins FROM w),
f AS (SELECT *, list_append(bins, len(words) - list_sum(bins)) AS hist FROM h),
refs AS (
  SELECT lang, [{", ".join(f"sum(classes[{i + 1}])" for i in range(n + 1))}] AS cs, [{", ".join(f"sum(hist[{i + 1}])" for i in range(n_bins))}] AS ws
  FROM f WHERE common IS NOT NULL GROUP BY lang
),
shares AS (SELECT lang, list_transform(cs, lambda x: x / list_sum(cs)) AS rc, list_transform(ws, lambda x: x / list_sum(ws)) AS cw FROM refs WHERE list_sum(cs) > 0 AND list_sum(ws) > 0),
win AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(i - before, 8)))::BIGINT AS n_repeat_words FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM rep) GROUP BY doc_id),
j AS (
  SELECT f.doc_id, len(words)::BIGINT AS n_words, (length(body) - classes[{quality.SPACE_CLASS + 1}])::BIGINT AS word_chars, classes[{quality.SYMBOL_CLASS + 1}]::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CASE WHEN length(body) >= {rules.min_chars} AND rc IS NOT NULL THEN {distance("classes", "rc")} END AS cd,
    CASE WHEN len(words) >= {rules.min_words_for_distance} AND cw IS NOT NULL THEN {distance("hist", "cw")} END AS corpus_wd,
    CASE WHEN len(words) >= {rules.min_words_for_distance} AND rw IS NOT NULL THEN {distance("hist", "rw")} END AS wd, ceiling, rest, hist
  FROM f LEFT JOIN cov ON f.doc_id = cov.doc_id LEFT JOIN shares ON f.lang = shares.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)
    AND NOT coalesce(cd > {rules.char_distance}, false) AND NOT coalesce(corpus_wd > {rules.word_distance}, false)
    AND NOT coalesce(wd > ceiling * least({rules.word_share} + {rules.word_noise} / sqrt(n_words), 0.99) AND hist[-1] > rest * n_words, false) AS kept
FROM j
"""


OP2_SQL = _op2_sql()


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every word under a 20-word window that starts earlier elsewhere."""
    return substrings.digest(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM d WHERE len(words) >= 20),
keyed AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS k FROM win),
flagged AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM keyed) WHERE n > 1),
w AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM d WHERE len(words) > 0),
covered AS (SELECT w.doc_id, w.i, word, max(f.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM w LEFT JOIN flagged f ON w.doc_id = f.doc_id AND w.i = f.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM covered GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more."""
    return jaccard.digest(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
raw AS (
  SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM d WHERE len(words) BETWEEN 1 AND 4
),
sets AS (SELECT DISTINCT doc_id, s FROM raw),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_of AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY x, y),
links AS (SELECT x, y FROM both_of JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * both_n >= 75 * (p.n + q.n - both_n)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT x, y FROM sym UNION SELECT reach.a, sym.y FROM reach JOIN sym ON reach.b = sym.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), d.doc_id)) AS component_id
FROM d LEFT JOIN sizes ON d.doc_id = sizes.doc_id
"""


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of equal label with a cosine of 0.98 or more."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
  FROM embeddings
),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.good AND b.good AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT x, y FROM links UNION SELECT reach.a, links.y FROM reach JOIN links ON reach.b = links.x)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE x = v.vec_id) AS n_links, least(v.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = v.vec_id), v.vec_id)) AS component_id,
  least(v.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = v.vec_id), v.vec_id)) = v.vec_id AS kept
FROM v
"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, host templates removed."""
    return html.extract(table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document's paragraphs, by a classifier trained on seeds and a bounded sample."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


#: The 256 steps of CRC-32 by their rule, and the CRC-32 of a string's UTF-8 bytes as a list expression; `steps` must be in scope.
CRC_STEPS = "list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"


def crc_sql(text: str) -> str:
    data = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw a tenth of the documents towards the benchmark's words."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
each AS (SELECT doc_id, unnest(ws) AS w FROM words),
table_of AS (SELECT {CRC_STEPS} AS steps),
coded AS (SELECT w, {crc_sql("w")} % 10000 AS b FROM (SELECT w FROM each UNION SELECT w FROM wanted), table_of),
s AS (SELECT b, count(*) AS n FROM each JOIN coded USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM wanted JOIN coded USING (w) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM each) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE)))::BIGINT AS g
  FROM (SELECT DISTINCT b FROM coded) LEFT JOIN s USING (b) LEFT JOIN t USING (b)
),
weights AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM each JOIN coded USING (w) JOIN gain USING (b) GROUP BY doc_id),
h AS (SELECT doc_id, len(ws)::BIGINT AS n_features, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h FROM words),
scored AS (
  SELECT h.doc_id, n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score
  FROM h LEFT JOIN weights ON h.doc_id IS NOT DISTINCT FROM weights.doc_id
),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank FROM scored LEFT JOIN placed ON scored.doc_id = placed.doc_id
"""


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product for every vector whose id is divisible by 20."""
    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage every conversation and repair its structure at the least cost."""
    return repair.report(repair.repair(repair.damage(table(spark, sf_dir, "conversations")), F.col("copies")))


def _op13_sql() -> str:
    """Forward dynamic programming over the rows: for each state the least (cost, audit) with the text so far."""

    def moved(state: str, cost: str, letter: str, line: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"

    def inserted(state: str, role: str) -> str:
        return moved(state, "3", "I", f"chr(10) || '{role}:'")

    def gone(state: str) -> str:
        return moved(state, "4", "D", "''")

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN f NOT IN (1, 2) AND role[1] = '{initial}' THEN {moved(state, 'late', 'K', 'chr(10) || role || chr(58) || text')} END"

    def given(state: str, role: str) -> str:
        return f"CASE WHEN f NOT IN (1, 2) THEN {moved(state, '(3 + late)', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END"

    to_u = ", ".join(f"{kept(x, 'u')}, {given(x, 'user')}" for x in ("v0", "vs", "va"))
    close_u = ", ".join(inserted(x, "user") for x in ("v0", "vs", "va"))
    start = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    return f"""
WITH RECURSIVE table_of AS (SELECT {CRC_STEPS} AS steps),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT keyed.*, {crc_sql("k")} % 20 AS code FROM keyed, table_of),
harmed AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0
),
convs AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS n FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT n, turn, role, text, row_number() OVER w AS i, lag(role[1]) OVER w AS before, row_number() OVER (PARTITION BY n, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM harmed JOIN convs ON harmed.conv_id IS NOT DISTINCT FROM convs.conv_id WINDOW w AS (PARTITION BY n ORDER BY turn NULLS FIRST, role, sha256(text), copy)
),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 3 ELSE 0 END AS f FROM placed
),
input AS (SELECT *, CASE WHEN f = 3 THEN 3 ELSE 0 END AS late FROM faulty),
walk(n, i, v0, vs, vu, va) AS (
  SELECT n, 0::BIGINT, {start}, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), {{'c': 3::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}}, {{'c': 6::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} FROM convs
  UNION ALL
  SELECT n, i, v0, vs, vu, list_min([va, {inserted("vu", "assistant")}]) FROM (
    SELECT n, i, v0, vs, list_min([vu, {close_u}]) AS vu, va FROM (
      SELECT walk.n, input.i, {gone("v0")} AS v0, list_min([{gone("vs")}, {kept("v0", "s")}]) AS vs, list_min([{gone("vu")}, {to_u}]) AS vu, list_min([{gone("va")}, {kept("vu", "a")}, {given("vu", "assistant")}]) AS va
      FROM walk JOIN input ON input.n = walk.n AND input.i = walk.i + 1
    )
  )
),
best AS (SELECT n, arg_max(list_min([v0, va]), i) AS b FROM walk GROUP BY n),
counts AS (
  SELECT n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 3) AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM input GROUP BY n
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.c AS cost, b.a AS audit, sha256(substr(b.t, 2)) AS repaired_sha256
FROM convs JOIN best USING (n) LEFT JOIN counts USING (n)
"""


OP13_SQL = _op13_sql()
