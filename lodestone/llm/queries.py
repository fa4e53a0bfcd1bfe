"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Mapping

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bag_minhash import near_classes
from lodestone.llm.bpe import round_trip
from lodestone.llm.common import read_table
from lodestone.llm.filter_audit import audit_filters
from lodestone.llm.hnsw import near_vectors
from lodestone.llm.html_text import extract_main_text
from lodestone.llm.language_id import fit, held_out, identify
from lodestone.llm.license_scan import PHRASES, STRETCH, all_templates, scan_licenses, words_of
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.media import media_features, store_texts
from lodestone.llm.packing import pack_documents
from lodestone.llm.resampling import resampled
from lodestone.llm.sharding import shard_rows
from lodestone.llm.suffix_dedup import remove_repeats


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=("doc_id", "held_out"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2, with_ids=False, special_literals=True)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"), keep=("doc_id",)).drop("matches", "wrapped")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, length=200, keep_first=False).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return round_trip(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_classes(docs, size=5, similarity=0.8).select("doc_id", "class_id", "class_size", "kept")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(read_table(spark, sf_dir, "documents"))
    return media_features(stored, keep=("doc_id", "text_bytes")).withColumnRenamed("text_bytes", "n_bytes")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"), keep=("page_id", "url"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"), similarity=0.98)


def hnsw_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over all vectors and a changed copy of each, so that there are links to find: its components go off by up to 8 in a hundred."""
    own = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    changed = F.expr("transform(embedding, (x, i) -> CAST(x * (1D + ((vec_id * 31 + i * 17) % 11 - 5) * 0.016D * (vec_id % 6)) AS FLOAT))")
    copies = own.select((F.col("vec_id") + 10_000_000).alias("vec_id"), changed.alias("embedding"), "label")
    return near_vectors(own.unionByName(copies), similarity=0.98)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_rows(docs, shards=24, keep_text=False)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = (read_table(spark, sf_dir, t).select(*c) for t, c in (("documents", ("doc_id", "text")), ("benchmark", ("text",))))
    return resampled(docs, targets, runs=1, buckets=10_000, percent=10, min_words=20, seed=2024, keep=("doc_id",)).drop("n_words")


def license_sql(templates: Mapping[str, str], phrases: Mapping[str, str], threshold: float = 0.9) -> str:
    """Words; places of phrases; for each template the distinct words that a stretch of a text holds, within a line or across line ends."""
    found = [(k, label, [w.decode() for w in words_of(text.encode())]) for k, (text, label) in enumerate(templates.items())]
    needs = [(k, label, STRETCH * len(words), max(1, math.ceil(threshold * len(set(words)) - 1e-9)), len(set(words))) for k, label, words in found]
    rows = lambda some: ", ".join(map(repr, some))
    places = " UNION ALL ".join(
        f"SELECT doc_id, pos, '{label}' AS label FROM ahead WHERE " + " AND ".join(f"w{i} = '{w}'" for i, w in enumerate(phrase.split())) for phrase, label in phrases.items()
    )
    return f"""
WITH templates(k, label, longest, need, size) AS (VALUES {rows(needs)}),
template_words(k, w) AS (VALUES {rows((k, w) for k, _, words in found for w in sorted(set(words)))}),
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
in_lines AS (
  SELECT doc_id, n, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
    SELECT doc_id, n, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM lines)),
words AS (SELECT doc_id, n, w, row_number() OVER (PARTITION BY doc_id ORDER BY n, i) - 1 AS pos FROM in_lines),
ahead AS (
  SELECT doc_id, pos, w AS w0, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2, lead(w, 3) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
hits AS (SELECT doc_id, pos, k, w FROM words JOIN template_words USING (w)),
held AS (SELECT doc_id, k FROM hits JOIN templates USING (k) GROUP BY doc_id, k, need HAVING count(DISTINCT w) >= need),
near AS (SELECT h.* FROM hits h JOIN held USING (doc_id, k)),
stretches AS (
  SELECT a.doc_id, a.k, a.pos, count(DISTINCT b.w) AS c
  FROM near a JOIN templates USING (k) JOIN near b ON a.doc_id = b.doc_id AND a.k = b.k AND b.pos <= a.pos AND b.pos > a.pos - longest GROUP BY ALL),
met AS (SELECT doc_id, k, max(c) AS c FROM stretches JOIN templates USING (k) WHERE c >= need GROUP BY doc_id, k),
labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
    SELECT doc_id, label FROM met JOIN templates USING (k) UNION ALL SELECT doc_id, label FROM places) GROUP BY doc_id),
scores AS (SELECT doc_id, max(c / size) AS score FROM met JOIN templates USING (k) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS score
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN scores USING (doc_id)
"""


OP3_SQL = license_sql(all_templates(), PHRASES)

OP4_SQL = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
begins AS (SELECT doc_id, n, h, unnest(range(0, n - 199, 500)) AS b FROM texts WHERE n >= 200),
blocks AS (SELECT doc_id, b, least(500, n - 199 - b) AS m, substr(h, 2 * b + 1, 1398) AS part FROM begins),
strings AS (SELECT doc_id, b, part, unnest(range(0, m)) AS i FROM blocks),
hashed AS (SELECT doc_id, b + i AS s, md5(substr(part, 2 * i + 1, 400)) AS k FROM strings),
repeated AS (SELECT k FROM hashed GROUP BY k HAVING count(*) > 1),
starts AS (SELECT doc_id, s, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS run FROM hashed JOIN repeated USING (k)),
runs AS (SELECT doc_id, min(s) AS b, max(s) + 200 AS e FROM starts GROUP BY doc_id, run),
edges AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR b > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY b) AS span FROM edges),
spans AS (SELECT doc_id, span, min(b) AS b, max(e) AS e FROM numbered GROUP BY doc_id, span),
pieces AS (
  SELECT t.doc_id, b AS until, coalesce(lag(e) OVER (PARTITION BY t.doc_id ORDER BY b), 0) AS since, h FROM spans JOIN texts t USING (doc_id)
  UNION ALL SELECT t.doc_id, n, coalesce((SELECT max(e) FROM spans s WHERE s.doc_id = t.doc_id), 0), h FROM texts t),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (until - since)), '' ORDER BY since, until) AS k FROM pieces GROUP BY doc_id)
SELECT t.doc_id, n::BIGINT AS n_bytes, coalesce((SELECT sum(e - b) FROM spans s WHERE s.doc_id = t.doc_id), 0)::BIGINT AS n_removed,
       (SELECT count(*) FROM spans s WHERE s.doc_id = t.doc_id) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM texts t JOIN kept USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE texts AS (
  SELECT text, min(doc_id) AS id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text),
words AS (
  SELECT id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w
  FROM texts),
places AS (
  SELECT id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0),
bags AS (
  SELECT id, array_to_string(w[i : i + k - 1], ' ') AS run, count(*) AS n FROM places GROUP BY 1, 2),
totals AS (SELECT id, sum(n) AS total FROM bags GROUP BY id),
shared AS (
  SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS m
  FROM bags a JOIN bags b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN totals x ON x.id = a JOIN totals y ON y.id = b
  WHERE m >= 0.8 * (x.total + y.total - m) - 1e-9),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT id AS a, id AS b FROM texts
  UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
classes AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a),
sizes AS (SELECT class_id, sum(copies) AS class_size FROM classes JOIN texts USING (id) GROUP BY class_id)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(s.class_size, 1)::BIGINT AS class_size,
       coalesce(c.class_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN texts t ON d.text = t.text LEFT JOIN classes c ON t.id = c.id
LEFT JOIN sizes s ON c.class_id = s.class_id
"""

OP9_SQL = """
WITH RECURSIVE vectors AS (SELECT vec_id, embedding, label FROM embeddings),
v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding::DOUBLE[], lambda x: x IS NOT NULL AND isfinite(x))), false) AS clean
  FROM vectors),
good AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE clean AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM vectors
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM parts LEFT JOIN counts USING (vec_id)
"""

COPIES_SQL = OP9_SQL.replace(
    "SELECT vec_id, embedding, label FROM embeddings",
    """SELECT vec_id, embedding, label FROM embeddings UNION ALL
  SELECT vec_id + 10000000, list_transform(embedding, lambda x, i: (x * (1::DOUBLE + ((vec_id * 31 + (i - 1) * 17) % 11 - 5) * 0.016::DOUBLE * (vec_id % 6)))::FLOAT), label FROM embeddings""",
)

OP10_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, r.first_doc IS NOT NULL AND k.doc_id <> r.first_doc AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP11_SQL = r"""
WITH features AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy
  FROM documents),
failures AS (
  SELECT part, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), copy] AS f
  FROM features LEFT JOIN labels USING (doc_id)),
cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM failures GROUP BY part, f),
letters AS (SELECT unnest(range(1, 6)) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
counted AS (
  SELECT part, o, step, n, good, toxic, f[o[step]] AS fails, list_bool_or(list_transform(o[1 : step - 1], lambda k: f[k])) IS TRUE AS earlier,
         len(list_filter(f, lambda y: y)) = 1 AS single
  FROM cells CROSS JOIN steps),
summed AS (
  SELECT part, o, step, sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND single THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k::INT, 1)), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley
FROM summed
"""

OP13_SQL = r"""
WITH bits(k) AS (SELECT unnest(range(0, 256))),
crc_table AS (
  SELECT list(list_reduce(list_prepend(k, range(0, 8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY k) AS crcs FROM bits),
texts AS (
  SELECT 0 AS side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, doc_id, unnest(regexp_extract_all(t, '[a-z0-9\x{80}-\x{10FFFF}]+')) AS w FROM texts),
counts AS (SELECT side, doc_id, w, count(*) AS n FROM words GROUP BY ALL),
spelt AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM counts)),
checksums AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                                        lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM spelt, crc_table),
sides AS (SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END)::DOUBLE AS t FROM counts JOIN checksums USING (w) GROUP BY bucket),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sides),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS gain FROM sides, totals),
weights AS (SELECT doc_id, sum(n) AS n, floor(sum(n * gain) / sum(n)) AS weight FROM counts JOIN checksums USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
hashed AS (SELECT doc_id, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents),
scores AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM hashed LEFT JOIN weights USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS eligible FROM scores WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= eligible * 10 // 100 THEN rank END AS rank FROM scores s LEFT JOIN ranks USING (doc_id)
"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_license_scan": op3_license_scan,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_bag_minhash": op6_bag_minhash,
    "op7_media": op7_media,
    "op8_html_text": op8_html_text,
    "op9_hnsw": op9_hnsw,
    "hnsw_of_copies": hnsw_of_copies,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_sharding": op12_sharding,
    "op13_resampling": op13_resampling,
}
ORACLE_SQL = {"op3_license_scan": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op6_bag_minhash": OP6_SQL, "op9_hnsw": OP9_SQL, "hnsw_of_copies": COPIES_SQL, "op10_line_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL, "op13_resampling": OP13_SQL}
