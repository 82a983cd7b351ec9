"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op8_token_counts(spark, sf_dir):
    import public_tokenizers
    from .token_counts import count_tokens
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024).drop("text")


@register
def op9_byte_bpe(spark, sf_dir):
    import public_tokenizers
    from .byte_bpe import encode_decode
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@register
def op10_suffix_dedup(spark, sf_dir):
    from .repeats import remove_repeats
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, size=400, keep="none").select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_removed", "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"))


@register
def op4_ngram_jaccard(spark, sf_dir):
    from .jaccard_join import near_duplicates
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, k=5, num=80, den=100).select("doc_id", "n_shingles", "component_id")


@register
def op5_language_id(spark, sf_dir):
    from .language_id import held_out, identify, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = held_out("doc_id", 4, 2)
    model = train(docs.filter(~fold))
    return identify(docs.drop("lang"), model).select("doc_id", fold.alias("held_out"), "lang_pred", "score")


@register
def op6_decontamination(spark, sf_dir):
    from .decontaminate import find_leaks
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark"))


@register
def op1_warc(spark, sf_dir):
    from .warc import new_folder, read_archives, write_archives
    folder = new_folder(spark)
    written = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(written, folder, keep_chunks=False).select(
        F.col("id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url")


SQL["op1_warc"] = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
             max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to, url
FROM d
"""


#: The rules that the URL query applies.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@register
def op2_url_rules(spark, sf_dir):
    from .url_rules import judge
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, default="allow").select("page_id", "host", "path", "rule", "verdict")


SQL["op2_url_rules"] = """
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, h || p AS rule, v,
             row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC, length(h) DESC, v DESC) AS n
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.n = 1
"""


@register
def op7_toxicity(spark, sf_dir):
    from .language_id import held_out
    from .toxicity import score, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = held_out("doc_id", 3, 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs, labels.filter(~fold))
    return score(docs, model, threshold=0.7).select("doc_id", fold.alias("held_out"), "score", "predicted")


@register
def op3_nn_descent(spark, sf_dir):
    from .neighbours import search
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % 100 == 0), k=10)


@register
def op13_prefix_trie(spark, sf_dir):
    from .prefix_trie import prefix_trie, shared_heads, turns
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(*shared_heads(turns(rows), group=5, heads=9))


SQL["op13_prefix_trie"] = """
WITH c AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS p
           FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
             xor(4294967295, list_reduce([4294967295] || list_transform(regexp_extract_all(CAST(conv_id AS VARCHAR), '.'), lambda x: CAST(ascii(x) AS BIGINT)),
                 lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0],
                     lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM c)),
part AS (SELECT v.conv_id, p, r, t FROM v JOIN c ON c.conv_id = v.base WHERE p < h
         UNION ALL SELECT v.conv_id, p, r, t FROM v JOIN c ON c.conv_id = v.conv_id WHERE p >= h),
seq AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d,
               sha256(octet_length(encode(r)) || ':' || r || sha256(t)) AS u, octet_length(encode(t)) AS nb FROM part),
pre AS (SELECT conv_id, d, nb, string_agg(u, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM seq
        UNION ALL SELECT conv_id, 0, 0, '' FROM v),
node AS (SELECT k, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(nb) AS nb FROM pre GROUP BY k),
kid AS (SELECT left(k, length(k) - 64) AS k, count(*) AS n FROM node WHERE k <> '' GROUP BY 1),
sub AS (SELECT left(node.k, 64 * a.i) AS k, sum((kid.n IS NULL)::INT) AS leaves, sum((n_convs - 1) * nb) AS saved
        FROM node LEFT JOIN kid ON kid.k = node.k, LATERAL (SELECT unnest(range(0, CAST(node.depth AS BIGINT) + 1)) AS i) a GROUP BY 1),
fin AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
        FROM (SELECT conv_id, arg_max(k, d) AS k FROM pre GROUP BY conv_id) GROUP BY k)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kid.n, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(fin.ids, '')) AS ends_sha256
FROM node LEFT JOIN kid ON kid.k = node.k JOIN sub ON sub.k = node.k LEFT JOIN fin ON fin.k = node.k
LEFT JOIN node up ON node.k <> '' AND up.k = left(node.k, length(node.k) - 64)
"""


@register
def op12_best_fit_packing(spark, sf_dir):
    import public_tokenizers
    from .packing import pack, token_pieces
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, end=1), size=4096)


@register
def op11_token_alignment(spark, sf_dir):
    import public_tokenizers
    from .alignment import align
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
