"""The registered queries of the training-data operators, over their whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import collocations, decontaminate, fingerprint, html_text, mixing, ordinal, packing, prefix_trie, quality_rules, simhash, token_files, toxicity, warc
from rolecall.llm.common import table
from rolecall.llm.tokens import default_path


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nothing else in this query needs the memory that its encoders take
    return token_files.round_trip(table(spark, sf_dir, "documents"), default_path(), memo_pieces=1_000_000)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.versions(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nothing else in this query needs the memory that its encoders take
    return packing.pack(table(spark, sf_dir, "documents"), default_path(), with_ids=False, memo_pieces=1_200_000).drop("loss_tokens")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.placed(table(spark, sf_dir, "conversations"))))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OPERATORS = (
    op1_toxicity, op2_quality_classifier, op3_warc_revisits, op4_html_text, op5_token_files, op6_simhash, op7_fingerprints, op8_mixing, op9_packing,
    op10_quality_rules, op11_collocations, op12_prefix_trie, op13_decontaminate,
)
QUERIES = {f.__name__: f for f in OPERATORS}

OP3_SQL = r"""
WITH heads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, 1 + 5 * (k // 4)::INT, 5))::BIGINT >> (5 * (3 - k % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM heads
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM named)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM firsts
"""

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
    [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - (coalesce(sum(source_size) OVER before, 0) * 2)::DOUBLE)
      / (sum(weight) OVER (before_or_at ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    before_or_at AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
), leveled AS (
  SELECT *, first(level) OVER (ORDER BY CASE WHEN level * weight <= source_size * 2 THEN 0 ELSE 1 END, source_size::DOUBLE / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
  FROM levels
), sources AS (
  SELECT source, source_size, n_docs, least(final * weight, (source_size * 2)::DOUBLE) AS target,
    ('0x' || substr(md5('mix:' || coalesce('s:' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM leveled
), placed AS (
  SELECT d.doc_id, d.source, d.size, s.source_size, s.target, s.shift,
    CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS rate,
    2 * length(bin(d.size)) + CASE WHEN substr(bin(d.size), 2, 1) = '1' THEN 1 ELSE 0 END AS class,
    floor(('0x' || substr(md5('mix:d:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE * ceil(s.n_docs / 20000.0::DOUBLE)) AS block
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
), lined AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, block, size, doc_id) AS place FROM placed
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(floor(place * rate + shift) - floor((place - 1) * rate + shift), 2)) * size)::BIGINT AS taken
FROM lined
"""

OP11_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size))
  GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang
), candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM grams WHERE size > 1 AND f >= 30
), inner_phrases AS (
  SELECT lang, array_to_string(w[i : i + n - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, size, n, unnest(range(1, size - n + 2)) AS i FROM candidates, (SELECT unnest([2, 3]) AS n) WHERE n < size) GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_phrases p ON p.lang = c.lang AND p.phrase = c.phrase
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept) c
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[: c.k], ' ') JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 :], ' ')
), weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts
), best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN totals USING (lang) WHERE rank <= 2000
"""

OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), heads AS (
  SELECT c.conv_id, t.role, t.text, pos AS pos FROM convs c JOIN turns t ON t.conv_id = c.base WHERE pos < h
), steps AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth
  FROM (SELECT *, 0 AS own FROM heads UNION ALL SELECT conv_id, role, text, pos, 1 FROM turns JOIN convs USING (conv_id) WHERE pos >= h)
), prefixes AS (
  SELECT conv_id, depth, octet_length(encode(text)) AS bytes, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM steps
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs
), ends AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN e.conv_id IS NOT NULL THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes LEFT JOIN ends e USING (conv_id, depth) GROUP BY path, depth
), children AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), marked AS (SELECT *, coalesce(n_children, 0) AS below FROM nodes LEFT JOIN children USING (path)
), below AS (
  SELECT path, sum(CASE WHEN below = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM (SELECT path[:up] AS path, below, n_convs, bytes FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM marked)) GROUP BY path
)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.below AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, m.ends_sha256
FROM marked m JOIN below b ON b.path = m.path LEFT JOIN nodes p ON m.depth > 0 AND p.depth = m.depth - 1 AND p.path = m.path[:m.depth - 1]
"""

OP13_SQL = r"""
WITH lined AS (
  SELECT row_number() OVER () AS rid, doc_id, w FROM (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents)
), lined_items AS (
  SELECT item_id, w, least(10, len(w)) AS width FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item_id, width, array_to_string(w[i : i + width - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM lined_items)
), placed AS (
  SELECT rid, i, width, array_to_string(w[i : i + width - 1], ' ') AS gram
  FROM (SELECT rid, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM lined, (SELECT DISTINCT width FROM grams))
), hits AS (SELECT rid, i, width, item_id FROM placed JOIN grams USING (width, gram)
), hit_words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + width)) AS k FROM hits) GROUP BY rid
), hit_items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lined LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""

ORACLES = {"op11_collocations": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_decontaminate": OP13_SQL, "op3_warc_revisits": OP3_SQL, "op8_mixing": OP8_SQL}
