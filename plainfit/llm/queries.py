"""The registered queries of this subpackage, op1 to op13 and the pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flac, huffman, importance, lm, near, packing, piece_bpe, pii, quality, suffixes, topk, toxicity, vector_codes
from .common import materialise, text_or_empty, with_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the registered queries' surrogates; users give their own.
KEY = b"registered queries"


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0



def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, KEY)


def _flac_digest(doc_id, n_bytes, media, blocks, error):
    if error:
        raise ValueError(f"stored form of {doc_id}: {error}")
    pcm = np.concatenate([x[0] for _, x in blocks])
    payload = (pcm + 128).astype(np.uint8).tobytes()
    crossings = int((np.signbit(pcm[1:]) != np.signbit(pcm[:-1])).sum())
    feature = f"frames={len(blocks)};peak={int(np.abs(pcm).max())};sum={int(pcm.sum())};energy={int((pcm * pcm).sum())};crossings={crossings};offsets={zlib.crc32(np.array([f for f, _ in blocks], dtype='<i8').tobytes())}"
    return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's bytes as a FLAC stream in a stored table, read back and decoded with all checksums verified."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    stored = materialise(flac.encode_flac(table(spark, sf_dir, "documents"), "doc_id", "text"), "flac")
    return flac.media_features(stored, _flac_digest, schema)


def op3_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's mean log score under the bigram counts of all others."""
    return lm.backoff_scores(table(spark, sf_dir, "documents"), 2).withColumn("score", F.round("score", 6))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS b, unnest(range(1, len(ws) + 1)) AS i, unnest(list_concat(CASE WHEN len(ws) > 0 THEN [NULL] ELSE [] END, ws[1:len(ws) - 1])) AS a FROM w),
u AS (SELECT b AS g, count(*) AS c FROM t GROUP BY 1), ud AS (SELECT doc_id, b AS g, count(*) AS c FROM t GROUP BY 1, 2),
v AS (SELECT a, b, count(*) AS c FROM t WHERE a IS NOT NULL GROUP BY 1, 2), vd AS (SELECT doc_id, a, b, count(*) AS c FROM t WHERE a IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM u) AS v),
s AS (SELECT t.doc_id, t.n,
        CASE WHEN t.a IS NOT NULL AND v.c - vd.c > 0 THEN ln((v.c - vd.c) / (ua.c - uad.c))
             ELSE CASE WHEN t.a IS NULL THEN 0 ELSE ln(0.4) END + ln((ub.c - ubd.c + 1) / (k.n - t.n + k.v + 1)) END AS s
      FROM t CROSS JOIN k JOIN u ub ON ub.g = t.b JOIN ud ubd ON ubd.g = t.b AND ubd.doc_id = t.doc_id
      LEFT JOIN u ua ON ua.g = t.a LEFT JOIN ud uad ON uad.g = t.a AND uad.doc_id = t.doc_id
      LEFT JOIN v ON v.a = t.a AND v.b = t.b LEFT JOIN vd ON vd.a = t.a AND vd.b = t.b AND vd.doc_id = t.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, round(avg(s.s), 6) AS score FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id, w.ws
"""


def op3_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's mean log score under the trigram counts of all others, backing off to bigrams and words."""
    return lm.backoff_scores(table(spark, sf_dir, "documents"), 3).withColumn("score", F.round("score", 6))


OP3_TRIGRAMS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS b, unnest(list_concat(CASE WHEN len(ws) > 0 THEN [NULL] ELSE [] END, ws[1:len(ws) - 1])) AS a,
        unnest(list_concat(CASE WHEN len(ws) > 1 THEN [NULL, NULL] WHEN len(ws) = 1 THEN [NULL] ELSE [] END, ws[1:greatest(len(ws) - 2, 0)])) AS z FROM w),
u AS (SELECT b AS g, count(*) AS c FROM t GROUP BY 1), ud AS (SELECT doc_id, b AS g, count(*) AS c FROM t GROUP BY 1, 2),
v AS (SELECT a, b, count(*) AS c FROM t WHERE a IS NOT NULL GROUP BY 1, 2), vd AS (SELECT doc_id, a, b, count(*) AS c FROM t WHERE a IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT z, a, b, count(*) AS c FROM t WHERE z IS NOT NULL GROUP BY 1, 2, 3), xd AS (SELECT doc_id, z, a, b, count(*) AS c FROM t WHERE z IS NOT NULL GROUP BY 1, 2, 3, 4),
k AS (SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM u) AS v),
s AS (SELECT t.doc_id,
        CASE WHEN t.z IS NOT NULL AND x.c - xd.c > 0 THEN ln((x.c - xd.c) / (va.c - vad.c))
             ELSE CASE WHEN t.z IS NULL THEN 0 ELSE ln(0.4) END
                + CASE WHEN t.a IS NOT NULL AND v.c - vd.c > 0 THEN ln((v.c - vd.c) / (ua.c - uad.c))
                       ELSE CASE WHEN t.a IS NULL THEN 0 ELSE ln(0.4) END + ln((ub.c - ubd.c + 1) / (k.n - t.n + k.v + 1)) END END AS s
      FROM t CROSS JOIN k JOIN u ub ON ub.g = t.b JOIN ud ubd ON ubd.g = t.b AND ubd.doc_id = t.doc_id
      LEFT JOIN u ua ON ua.g = t.a LEFT JOIN ud uad ON uad.g = t.a AND uad.doc_id = t.doc_id
      LEFT JOIN v ON v.a = t.a AND v.b = t.b LEFT JOIN vd ON vd.a = t.a AND vd.b = t.b AND vd.doc_id = t.doc_id
      LEFT JOIN v va ON va.a = t.z AND va.b = t.a LEFT JOIN vd vad ON vad.a = t.z AND vad.b = t.a AND vad.doc_id = t.doc_id
      LEFT JOIN x ON x.z = t.z AND x.a = t.a AND x.b = t.b LEFT JOIN xd ON xd.z = t.z AND xd.a = t.a AND xd.b = t.b AND xd.doc_id = t.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, round(avg(s.s), 6) AS score FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id, w.ws
"""


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for each vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), 20, "vec_id", "embedding", lambda c: c % 20 == 0)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def grade():
    """Ratings of three grades: poor; good but toxic; good."""
    return F.col("quality") * (2 - F.col("toxic"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's expected grade and its chance of being at least good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), grade(), 3)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).cast("int").alias("selected"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's piece ids and the text they decode to, as digests."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    raw = piece_bpe.ship(spark, path)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def digest(texts):
        model = piece_bpe.load_once(piece_bpe.PieceBpe, raw.value)
        rows = []
        for text in texts:
            ids = model.encode(text).tolist()
            rows.append((len(ids), sha(",".join(map(model.decimal.__getitem__, ids))), sha(model.decode(ids))))
        return [list(c) for c in zip(*rows, strict=True)] or [[], [], []]

    fields = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_columns(docs, text_or_empty(), digest, fields).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of similarity 0.8 and more on runs of five words: each document's class and number of links."""
    return near.jaccard_join(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS class_id,
       least(d.doc_id, coalesce((SELECT min(y) FROM l WHERE l.x = d.doc_id AND same), d.doc_id)) AS copy_id,
       CAST((SELECT count(*) FROM l WHERE l.x = d.doc_id) AS BIGINT) AS n_links
FROM documents d
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's noisy-or of its sentences; labels of the held-out fifth are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out()), F.col("toxic"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def _ids_digest(doc_ids, starts, ids):
    cols = [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op10_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as Huffman blocks in order of doc_id and read back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return huffman.store_and_read(table(spark, sf_dir, "documents"), path, _ids_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weights towards the benchmark's words, a tenth of them drawn and ranked."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


OP11_SQL = r"""
WITH k AS (SELECT list(c ORDER BY n) AS steps FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
      UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
t AS (SELECT side, id, unnest(ws) AS g FROM w),
d AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM t)),
e AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM d CROSS JOIN k),
f AS (SELECT side, id, bucket FROM t JOIN e USING (g)),
c AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f GROUP BY 1),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM c),
b AS (SELECT bucket, CAST(floor(1000 * ln(CAST((c.t + 1) * (z.s + 10000) AS DOUBLE) / CAST((c.s + 1) * (z.t + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM c CROSS JOIN z),
m AS (SELECT id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (bucket) WHERE side = 0 GROUP BY id),
x AS (SELECT w.id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || w.id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m ON m.id = w.id WHERE side = 0),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= 20)
SELECT y.*, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank FROM y LEFT JOIN r ON r.doc_id = y.doc_id
"""


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors' codes of four parts, their errors and those of their labels."""
    coded, books = vector_codes.encode_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    coded = vector_codes.with_group_error(materialise(coded, "coded"), "label", "label_error")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def _rounds(last: int) -> str:
    """Assignments a0 to a``last`` of the parts, each followed but for the last by the next round's entries."""
    assigned = """a{r} AS MATERIALIZED (SELECT vec_id, q.pos, min(struct_pack(d := q.xx - 2 * list_inner_product(q.x, c.x) + c.xx, entry := c.entry)) AS best FROM q JOIN c{r} c ON c.pos = q.pos GROUP BY 1, 2)"""
    updated = """u{n} AS (SELECT a.pos, best.entry AS entry, i, floor(sum(x[i]) / count(*)) AS m FROM a{r} a JOIN q ON q.vec_id = a.vec_id AND q.pos = a.pos CROSS JOIN k JOIN range(1, 1000) t(i) ON i <= k.w GROUP BY 1, 2, 3),
l{n} AS (SELECT pos, entry, list(m ORDER BY i) AS x FROM u{n} GROUP BY 1, 2),
c{n} AS MATERIALIZED (SELECT c.pos, c.entry, coalesce(l.x, c.x) AS x, list_inner_product(coalesce(l.x, c.x), coalesce(l.x, c.x)) AS xx FROM c{r} c LEFT JOIN l{n} l ON l.pos = c.pos AND l.entry = c.entry)"""
    return ",\n".join(x.format(r=r, n=r + 1) for r in range(last + 1) for x in ([assigned, updated] if r < last else [assigned]))


OP12_SQL = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS (SELECT max(len(e)) // 4 AS w FROM v),
p AS (SELECT vec_id, pos, e[pos * w + 1:pos * w + w] AS x FROM v CROSS JOIN k CROSS JOIN range(4) t(pos)),
q AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM p),
c0 AS MATERIALIZED (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, x, xx FROM q QUALIFY entry < 256),
{_rounds(4)},
o AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY pos) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY 1),
h AS (SELECT sha256(string_agg(CAST(m AS BIGINT)::VARCHAR, ',' ORDER BY pos, entry, i)) AS codebooks_sha256 FROM (SELECT pos, entry, unnest(x) AS m, unnest(range(len(x))) AS i FROM c4))
SELECT o.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id) CROSS JOIN h
"""


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of any 400-byte string that also starts elsewhere."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), suffixes.kept, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def queries() -> dict:
    return {f.__name__: f for f in (op1_surrogates, op2_flac, op3_backoff, op3_trigrams, op4_topk, op5_quality, op6_pieces, op7_jaccard, op8_packing, op9_toxicity, op10_huffman, op11_importance, op12_codes, op13_repeats)}


def oracle_sql() -> dict[str, str]:
    return {"op3_backoff": OP3_SQL, "op3_trigrams": OP3_TRIGRAMS_SQL, "op4_topk": OP4_SQL, "op7_jaccard": OP7_SQL, "op11_importance": OP11_SQL, "op12_codes": OP12_SQL}
